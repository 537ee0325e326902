"""Text scalars as Column functions: normal forms, tokenizers, parsers, predicates.

All are built-in expressions, so they stay in the JVM. White space is Python's:
Unicode spaces and the separators U+001C to U+001F.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)[\s\x1c-\x1f]+"
EDGE_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# ASCII punctuation, the stop words of topics, of retrieval and of labels, and query openers.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOP_TOPIC = "a an the of in on at to for and or but with by from as is are be been being was were that this it its about between into through during".split()
STOP_BM25 = "the a an and or but if for from with into over under of in on at to by as that this is are was were be been have has had do does did not no so we it".split()
STOP_LABEL = "the a an and or but if for from with into over under through using find determine compute calculate what which when where why how does do can could would is are was were be of in on at to by as that this it its not no we you they document query result".split()
OPENERS = "what which when where why how who is are was were do does did can could would find determine compute calculate evaluate identify prove show given suppose let".split()
#: Digits as Python's isdigit has them: decimal digits and super- and subscripts.
DIGITS = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _nn(x) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def bound(x: Column, f) -> Column:
    """``f`` of ``x``, which is worked out once: inside a lambda an expression is otherwise worked out at each place that names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip_ws(x) -> Column:
    return F.regexp_replace(_nn(x), EDGE_WS, "")


def _strip_chars(x: Column, chars: str) -> Column:
    return F.regexp_replace(x, f"^[{chars}]+|[{chars}]+$", "")


def normalize_ws(x) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_nn(x), WS, " "))


def strip_quotes(x) -> Column:
    """White space, then double quotes, then single quotes go from both ends."""
    return _strip_chars(_strip_chars(strip_ws(x), '"'), "'")


def norm_lower(x) -> Column:
    return normalize_ws(F.lower(_nn(x)))


def normalize_compact(x) -> Column:
    """ASCII letters and digits of the lower-cased text, joined."""
    return F.regexp_replace(F.lower(_nn(x)), "[^a-z0-9]", "")


def split_topic(x) -> Column:
    """Lower-case, punctuation deleted, split at white space; blanks at the ends stay."""
    return F.split(F.translate(F.lower(_nn(x)), PUNCTUATION, ""), WS)


def is_term_bm25(t) -> Column:
    """Whether a word of ``split_topic`` is a term: no stop word, number, single character, blank or null."""
    return (F.length(_c(t)) >= 2) & ~_c(t).isin(STOP_BM25) & ~_c(t).rlike(DIGITS)


def tokens_topic(x) -> Column:
    """Lower-case, punctuation deleted, split at white space; duplicates stay."""
    return F.filter(split_topic(x), lambda t: t != "")


def tokens_bm25(x) -> Column:
    """As ``tokens_topic`` without stop words, numbers and single characters."""
    return F.filter(split_topic(x), is_term_bm25)


def tokens_alnum(x) -> Column:
    """The set of runs of ASCII letters and digits of at least three, no stop words, no numbers."""
    stop = F.array(*map(F.lit, STOP_LABEL))
    runs = F.regexp_extract_all(F.lower(_nn(x)), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$")))


def truncate_sentence(x, most: int) -> Column:
    """At most ``most`` characters, cut after the last sentence end beyond 60 percent, with an ellipsis if cut."""
    t = normalize_ws(x)
    cut = F.substring(t, 1, most)
    last = F.greatest(*(F.when(F.locate(c, F.reverse(cut)) > 0, F.length(cut) - F.locate(c, F.reverse(cut))).otherwise(-1) for c in ".?!"))
    body = F.when(last > most * 0.6, F.left(cut, last + 1)).otherwise(F.regexp_replace(cut, r"(?U)[\s\x1c-\x1f]+$", ""))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(body, F.lit(" …")))


def _split_clean(x: Column, sep: str, clean) -> Column:
    return F.filter(F.transform(F.split(x, sep), clean), lambda t: t != "")


_TOPIC_LINES = (
    r'Document\s*Key\s*Topics\\?":\s*"([^"\n]+)"',
    r'Document\s*Key\s*Topics\\?":\s*([^"\n]+)',
    r'Key\s*Topics\\?":\s*([^"\n]+)',
    r"Document\s*Key\s*Topics\s*:\s*([^\n]+)",
)


def topics_from_keywords(x) -> Column:
    """Comma-separated topics of a labelled line, or of the whole text, first occurrences in order."""
    payload = F.coalesce(*(F.nullif(F.regexp_extract(_nn(x), p, 1), F.lit("")) for p in _TOPIC_LINES), _nn(x))
    return F.array_distinct(_split_clean(strip_quotes(payload), ",", normalize_ws))


def topics_from_list(x) -> Column:
    return F.array_distinct(F.filter(F.flatten(F.transform(F.filter(_c(x), lambda k: k.isNotNull()), lambda k: F.transform(F.split(k, ","), normalize_ws))), lambda t: t != ""))


def _first_by(terms: Column, key) -> Column:
    """The terms whose key is not empty, the first of each key."""
    pairs = F.filter(F.transform(terms, lambda t: F.struct(key(t).alias("k"), t.alias("t"))), lambda p: p.k != "")
    keep = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q.k), p.k) == i + 1)
    return F.transform(keep, lambda p: p.t)


def leakage_terms(keywords, topics) -> Column:
    """Terms after the last colon, then the topics, one of each compact form."""
    tail = F.element_at(F.split(_nn(keywords), ":"), -1)
    own = F.filter(F.transform(F.split(tail, r"[,\n;]+"), strip_quotes), lambda t: F.length(t) >= 2)
    more = F.filter(F.transform(F.coalesce(_c(topics), F.array().cast("array<string>")), strip_ws), lambda t: t != "")
    return _first_by(F.concat(F.when(strip_ws(keywords) == "", F.array().cast("array<string>")).otherwise(own), more), normalize_compact)


def keyword_phrases(x) -> Column:
    """Phrases after the first colon if there is one, split at commas, semicolons, bars and newlines, lower-cased."""
    s = strip_ws(x)
    body = F.when(F.contains(s, F.lit(":")), F.regexp_extract(s, r"(?s)^[^:]*:(.*)$", 1)).otherwise(s)
    return F.array_distinct(_split_clean(strip_quotes(body), r"[,\n;|]+", norm_lower))


def keyword_phrases_list(x) -> Column:
    return F.array_distinct(F.filter(F.transform(F.filter(_c(x), lambda k: k.isNotNull()), norm_lower), lambda t: t != ""))


def split_candidates(x, budget: int = 8) -> Column:
    """Shorter search phrases of a topic: prefixes of 2 to 4 content words, then bigrams, aligned with the topic."""
    stop = F.array(*map(F.lit, STOP_TOPIC))
    content = F.filter(tokens_topic(x), lambda t: ~F.array_contains(stop, t))
    long = F.filter(content, lambda t: F.length(t) >= 2)
    n = F.size(content)
    joined = lambda a: F.array_join(a, " ")
    heads = F.filter(F.array(*(F.when(n >= k, joined(F.slice(content, 1, k))) for k in (2, 3, 4))), lambda t: t.isNotNull())
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: joined(F.slice(content, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    fine = F.filter(F.array_distinct(F.concat(heads, grams)), lambda t: (t != norm_lower(x)) & (F.size(F.array_except(F.split(t, " "), long)) == 0) & F.contains(t, F.lit(" ")))
    return F.slice(fine, 1, budget)


def has_leakage(query, terms) -> Column:
    """Whether a compound term's compact form is in the query's, or a longer single term is one of its words."""
    words = F.regexp_extract_all(F.lower(_nn(query)), F.lit("[a-z0-9]+"), F.lit(0))

    def hit(asked: Column, t: Column) -> Column:
        return (t != "") & F.when(t.rlike("[ -]"), F.contains(asked.q, normalize_compact(t))).otherwise((F.length(normalize_compact(t)) >= 6) & F.array_contains(asked.words, F.lower(t)))

    asked = F.struct(normalize_compact(query).alias("q"), words.alias("words"))
    return bound(asked, lambda a: F.exists(F.transform(F.coalesce(_c(terms), F.array().cast("array<string>")), strip_ws), lambda t: hit(a, t)))


def phrase_hits(query, phrases) -> Column:
    """The phrases in the query: with a space as a substring, else as a whole word."""
    q = norm_lower(query)

    def hit(p: Column) -> Column:
        quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
        return (p != "") & F.when(F.contains(p, F.lit(" ")), F.contains(q, p)).otherwise(F.regexp_like(q, quoted))

    return F.filter(F.coalesce(_c(phrases), F.array().cast("array<string>")), hit)


def keyword_score(hits) -> Column:
    n = F.size(_c(hits)) if not isinstance(hits, Column) else F.size(hits)
    return score_of_hits(n)


def score_of_hits(n) -> Column:
    n = _c(n)
    return F.when(n == 0, 100).when(n == 1, 70).when(n == 2, 40).otherwise(10)


def clean_query(x) -> Column:
    """A well-formed question or instruction of at least five words, else null."""
    q = _strip_chars(strip_ws(x), "\"'")
    q = normalize_ws(F.regexp_replace(q, r"(?iU)^(?:query|question|answer)[\s\x1c-\x1f]*:[\s\x1c-\x1f]*", ""))

    def formed(q: Column) -> Column:
        opens = q.rlike(r"(?iU)^(?:" + "|".join(OPENERS) + r")\b")
        enough = F.size(F.filter(F.split(q, WS), lambda t: t != "")) >= 5
        ends = F.endswith(q, F.lit("?"))
        return F.when(enough, F.when(ends, q).when(opens, F.concat(F.regexp_replace(q, "[.,;:]+$", ""), F.lit("?"))))

    cut = bound(q, lambda q: F.when(F.contains(q, F.lit("?")), F.concat(strip_ws(F.substring_index(q, "?", 1)), F.lit("?"))).otherwise(q))
    return bound(cut, formed)


def abstract_structure(x) -> Column:
    """Shape of a query: numbers as NUM, words of one or two letters as V."""
    s = F.regexp_replace(F.lower(_nn(x)), r"(?U)\b\d+\.?\d*\b", "NUM")
    return normalize_ws(F.regexp_replace(s, r"(?U)\b[a-z]{1,2}\b", "V"))


def one_line(x) -> Column:
    return strip_ws(F.replace(_nn(x), F.lit("\n"), F.lit(" ")))


def property_code(code: str) -> str | None:
    """A property code with its P; None if blank."""
    code = code.strip()
    return None if not code else code if code.startswith("P") else f"P{code}"


