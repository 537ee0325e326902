"""Model output: parsing and coercion of JSON as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querykiln.functions.text import _c, _nn, bound, strip_ws

KEYS = ("queries", "generated_queries", "candidates", "items")
TYPES = ("analytical", "causal", "deductive", "analogical")


def _variant(x: Column) -> Column:
    return F.try_parse_json(x)


def parse_output(x) -> Column:
    """Candidates (array of variant objects) of a model's answer; empty if it can't be read.

    A fenced block is taken if there is one; the whole text is tried, then what lies
    between the first { and the last }; a list counts, or the first list under KEYS.
    """
    empty = F.array().cast("array<variant>")

    def lists(v: Column) -> Column:
        return bound(v, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in KEYS)))

    def read(t: Column) -> Column:
        return F.coalesce(lists(_variant(t)), lists(_variant(F.regexp_extract(t, r"(?s)\{.*\}", 0))), empty)

    def whole(t: Column) -> Column:
        fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1)
        return bound(fenced, lambda inner: F.when(inner != "", strip_ws(inner)).otherwise(t))

    got = bound(bound(strip_ws(x), whole), read)
    return F.filter(got, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))


def parse_judgement(x) -> Column:
    """The object between the first { and the last }, as a variant; null if it can't be read."""
    v = _variant(F.regexp_extract(_nn(x), r"(?s)\{.*\}", 0))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def _field(v, name: str) -> tuple[Column, Column]:
    part = F.try_variant_get(_c(v), f"$.{name}", "variant")
    return part, F.coalesce(F.schema_of_variant(part), F.lit("ABSENT"))


def is_failure(v) -> Column:
    """An unreadable or empty judgement, or a score equal to 0 without a reason."""
    score, kind = _field(v, "connectivity_score")
    reason = strip_ws(F.try_variant_get(_c(v), "$.reason", "string"))
    zero = F.when(kind == "BOOLEAN", ~F.try_variant_get(score, "$", "boolean")).when(kind.rlike("BIGINT|DECIMAL|DOUBLE|FLOAT"), F.try_variant_get(score, "$", "double") == 0)
    return _c(v).isNull() | F.schema_of_variant(_c(v)).isin("OBJECT<>", "OBJECT") | (F.coalesce(zero, F.lit(False)) & (reason == ""))


def _number(part: Column, kind: Column) -> Column:
    text = F.try_variant_get(part, "$", "string")
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(part, "$", "double")).when(kind == "STRING", strip_ws(text).try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def coerce_int(v, name: str = "connectivity_score", default: int = 0) -> Column:
    """0 to 100, halves to even; what isn't a finite number is the default."""
    n = _number(*_field(v, name))
    return F.when(n.isNotNull(), F.least(F.greatest(F.bround(n, 0), F.lit(0.0)), F.lit(100.0)).cast("int")).otherwise(default)


def coerce_float(v, name: str = "confidence", default: float = 0.5) -> Column:
    """0 to 1; what isn't a finite number is the default."""
    n = _number(*_field(v, name))
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0))).otherwise(default)


def reasoning_type(item) -> Column:
    """The first of type and reasoning_type that isn't empty, if known, else analytical."""
    said = lambda k: bound(F.try_variant_get(_c(item), f"$.{k}", "string"), lambda t: F.nullif(t, F.lit("")))
    kind = F.lower(F.coalesce(said("type"), said("reasoning_type"), F.lit("analytical")))
    return bound(kind, lambda k: F.when(k.isin(*TYPES), k).otherwise("analytical"))


def edge_ids(item, edges: int | Column) -> Column:
    """Distinct indexes in range, of the first of three keys that holds something."""
    ids = F.coalesce(*(bound(F.try_variant_get(_c(item), f"$.{k}", "array<string>"), lambda i: F.nullif(i, F.array().cast("array<string>"))) for k in ("used_edge_ids", "used_edges", "edge_ids")), F.array().cast("array<string>"))
    numbers = F.transform(F.filter(ids, lambda i: i.rlike("^[0-9]+$")), lambda i: i.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda i: i.isNotNull() & (i < edges)))


def final_score(keyword, connectivity, kw_weight: float = 0.2, conn_weight: float = 0.8) -> Column:
    return _c(keyword) * kw_weight + _c(connectivity) * conn_weight
