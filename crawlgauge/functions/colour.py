"""WCAG contrast as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _channel(hex6: Column, start: int) -> Column:
    c = F.conv(F.substring(hex6, start, 2), 16, 10).cast("double") / 255
    return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def full_hex(colour: Column) -> Column:
    """Six hex digits of ``#abc`` or ``#aabbcc``; longer values keep their first six, others are NULL."""
    digits = F.regexp_replace(colour, "^#+", "")
    doubled = F.regexp_replace(digits, "(.)", "$1$1")
    return F.when(F.length(digits) == 3, doubled).when(F.length(digits) >= 6, F.substring(digits, 1, 6))


def luminance(colour: Column) -> Column:
    digits = full_hex(colour)
    return 0.2126 * _channel(digits, 1) + 0.7152 * _channel(digits, 3) + 0.0722 * _channel(digits, 5)


def ratio_of_luminance(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def contrast_ratio(a: Column, b: Column) -> Column:
    return ratio_of_luminance(luminance(a), luminance(b))


def contrast_band(ratio: Column) -> Column:
    return F.when(ratio >= 7, "AAA").when(ratio >= 4.5, "AA").when(ratio >= 3, "large_text_only").otherwise("fail")
