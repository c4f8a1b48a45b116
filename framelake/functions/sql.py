"""The package's rules as SQL functions of a session, for queries written in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments and result, and body.
SCALARS = {
    "safe_divide": ("a DOUBLE, b DOUBLE, fallback DOUBLE DEFAULT 0", "DOUBLE", "coalesce(try_divide(a, b), fallback)"),
    "srgb_to_linear": ("x DOUBLE", "DOUBLE", "CASE WHEN x <= 0.04045 THEN greatest(x, 0) / 12.92 ELSE power((least(x, 1) + 0.055) / 1.055, 2.4) END"),
    "framing": (
        "share DOUBLE, faces INT", "STRING",
        "CASE WHEN faces <= 0 THEN 'unknown' WHEN faces >= 2 THEN 'pair' WHEN share < 0.04 THEN 'wide' WHEN share < 0.12 THEN 'full-body'"
        " WHEN share < 0.20 THEN 'three-quarter' WHEN share < 0.33 THEN 'half-body' ELSE 'close-up' END",
    ),
}
TABLES = {
    "path_prefixes": ("path STRING", "depth INT, prefix STRING", "SELECT pos + 1, array_join(slice(split(path, '[.]'), 1, pos + 1), '.') FROM posexplode(split(path, '[.]'))"),
}


def register(spark: SparkSession) -> list[str]:
    """Define the functions for this session; their names. They are expressions to the optimizer, not calls into Python."""
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, (arguments, result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({result}) RETURN {body}")
    return [*SCALARS, *TABLES]
