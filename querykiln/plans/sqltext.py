"""DuckDB expressions for the text scalars that the SQL of several queries needs."""

from __future__ import annotations

# Fixed values, written out here so that the SQL doesn't follow the engine's lists.
_P = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
STOP_TOPIC = "string_split('a an the of in on at to for and or but with by from as is are be been being was were that this it its about between into through during', ' ')"
STOP_BM25 = "string_split('the a an and or but if for from with into over under of in on at to by as that this is are was were be been have has had do does did not no so we it', ' ')"
STOP_LABEL = "string_split('the a an and or but if for from with into over under through using find determine compute calculate what which when where why how does do can could would is are was were be of in on at to by as that this it its not no we you they document query result', ' ')"
OPENERS = "what|which|when|where|why|how|who|is|are|was|were|do|does|did|can|could|would|find|determine|compute|calculate|evaluate|identify|prove|show|given|suppose|let"


def ws(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def lower_ws(x: str) -> str:
    return ws(f"lower({x})")


def compact(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def tok_topic(x: str) -> str:
    return rf"list_filter(string_split_regex(translate(lower({x}), '{_P}', ''), '\s+'), lambda t: t <> '')"


def tok_bm25(x: str) -> str:
    return rf"list_filter({tok_topic(x)}, lambda t: length(t) >= 2 AND NOT list_contains({STOP_BM25}, t) AND NOT regexp_full_match(t, '\d+'))"


def alnum(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({STOP_LABEL}, t) AND NOT regexp_full_match(t, '[0-9]+')))"
