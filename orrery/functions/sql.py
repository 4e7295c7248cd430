"""The scalar functions under SQL names, as SQL-bodied functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, result type, body)
FUNCTIONS = {
    "haversine_km": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", "2 * 6371.0D * asin(sqrt(least(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2), 1.0D)))"),
    "proximity": ("distance DOUBLE, scale DOUBLE", "DOUBLE", "exp(-distance / scale)"),
    "month_number": ("ts TIMESTAMP", "BIGINT", "CAST(year(ts) AS BIGINT) * 12 + month(ts) - 1"),
    "quarter_key": ("m BIGINT", "STRING", "concat(CAST(m div 12 AS STRING), 'Q', CAST(m % 12 div 3 + 1 AS STRING))"),
    "round_cut": ("x DOUBLE", "DOUBLE", "CASE WHEN x = 0 THEN 0.0D ELSE rint(x * pow(10.0D, greatest(2 - floor(log10(abs(x))), 0))) / pow(10.0D, greatest(2 - floor(log10(abs(x))), 0)) END"),
    "tercile": ("x DOUBLE, low DOUBLE, high DOUBLE", "INT", "CASE WHEN x >= high THEN 3 WHEN x >= low THEN 2 ELSE 1 END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions callable from spark.sql in this session."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
