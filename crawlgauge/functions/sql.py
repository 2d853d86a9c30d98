"""SQL functions for use in ``spark.sql``: defined in SQL, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = {
    "strip_tags": r"(html STRING) RETURNS STRING RETURN "
    r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' '), '(?U)\\s+', ' '))",
    "syllables": r"(word STRING) RETURNS BIGINT RETURN "
    r"greatest(1L, CAST(regexp_count(lower(word), '[aąeęioóuyźż]+') AS BIGINT))",
    "srgb_channel": r"(c DOUBLE) RETURNS DOUBLE RETURN "
    r"CASE WHEN c <= 0.03928 THEN c / 12.92 ELSE pow((c + 0.055) / 1.055, 2.4) END",
    "luminance": r"(hex6 STRING) RETURNS DOUBLE RETURN "
    r"0.2126 * srgb_channel(CAST(conv(substr(hex6, 1, 2), 16, 10) AS DOUBLE) / 255) + "
    r"0.7152 * srgb_channel(CAST(conv(substr(hex6, 3, 2), 16, 10) AS DOUBLE) / 255) + "
    r"0.0722 * srgb_channel(CAST(conv(substr(hex6, 5, 2), 16, 10) AS DOUBLE) / 255)",
    "contrast_ratio": r"(a STRING, b STRING) RETURNS DOUBLE RETURN "
    r"(greatest(luminance(a), luminance(b)) + 0.05) / (least(luminance(a), luminance(b)) + 0.05)",
    "jaccard": r"(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN "
    r"CASE WHEN size(array_union(a, b)) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
}


def register(spark: SparkSession) -> None:
    for name, definition in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
