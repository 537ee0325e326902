"""Scalars as temporary SQL functions, so that SQL calls them without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

# SQL bodies over the one argument x; Catalyst inlines them.
_WS = r"(?U)[\\s\\x1c-\\x1f]+"
BODIES = {
    "qk_normalize_ws": ("STRING", rf"trim(regexp_replace(coalesce(x, ''), '{_WS}', ' '))"),
    "qk_norm_lower": ("STRING", rf"trim(regexp_replace(lower(coalesce(x, '')), '{_WS}', ' '))"),
    "qk_compact": ("STRING", "regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]', '')"),
}


def register(spark: SparkSession) -> None:
    """Create ``BODIES`` as temporary functions of the session."""
    for name, (kind, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
