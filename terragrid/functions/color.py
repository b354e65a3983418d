"""Colour strings: ``#rrggbb``, ``rgb(r, g, b)`` and greys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted colour spellings and defaults.
RGB_PATTERN = r"rgb\((\d+),\s*(\d+),\s*(\d+)\)"
HEX_PATTERN = r"(?i)^#?([a-f\d]{2})([a-f\d]{2})([a-f\d]{2})$"
BLACK = "rgba(0, 0, 0, 1)"
DEFAULT_RGB = "rgb(128, 128, 128)"
DEFAULT_HEX = "#888888"
NODATA_HEX = "#000000"


def round_half_up(v: Column) -> Column:
    """Round to the nearest integer, halves up, also for negative values."""
    return F.floor(v + F.lit(0.5))


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def rgb_channels(text: Column) -> Column:
    """``rgb(r, g, b)`` -> struct of ints; null when the text is not of that form."""
    ints = [_group(text, RGB_PATTERN, i).cast("int").alias(n) for i, n in ((1, "r"), (2, "g"), (3, "b"))]
    return F.when(text.rlike(RGB_PATTERN), F.struct(*ints))


def rgb_unit(text: Column) -> Column:
    """``rgb(r, g, b)`` -> three doubles in 0..1, mid grey when unreadable."""
    c = rgb_channels(text)
    scaled = F.array(*[c[n] / F.lit(255.0) for n in "rgb"])
    grey = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5))
    return F.when(text.isNull(), F.lit(None)).when(c.isNull(), grey).otherwise(scaled)


def luma(r: Column, g: Column, b: Column) -> Column:
    return round_half_up(F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b)


def grayscale(text: Column, alpha: float | int = 1) -> Column:
    """Grey ``rgba`` text of a colour; null and other spellings pass through."""
    c = rgb_channels(text)
    g = luma(c["r"], c["g"], c["b"]).cast("string")
    grey = F.concat(F.lit("rgba("), g, F.lit(", "), g, F.lit(", "), g, F.lit(f", {alpha:g})"))
    return F.when(c.isNull(), text).otherwise(grey)


def hex_to_rgb(text: Column, strict: bool = True) -> Column:
    """``#rrggbb`` -> ``r,g,b``; a bad spelling is an error, or null if not strict."""
    nums = [F.conv(_group(text, HEX_PATTERN, i), 16, 10) for i in (1, 2, 3)]
    bad = F.raise_error(F.concat(F.lit("Invalid hex color: "), text)) if strict else F.lit(None).cast("string")
    return F.when(text.isNull(), F.lit(None).cast("string")).when(
        text.rlike(HEX_PATTERN), F.concat_ws(",", *nums)
    ).otherwise(bad)


def hex_to_css(text: Column, strict: bool = True) -> Column:
    """``#rrggbb`` -> ``rgb(r,g,b)``."""
    return F.concat(F.lit("rgb("), hex_to_rgb(text, strict), F.lit(")"))


def rgb_to_hex(text: Column) -> Column:
    """``rgb(r, g, b)`` -> ``#rrggbb``; null when unreadable."""
    c = rgb_channels(text)
    pair = [F.lower(F.lpad(F.hex(c[n]), 2, "0")) for n in "rgb"]
    return F.when(c.isNotNull(), F.concat(F.lit("#"), *pair))


def css_of(r: Column, g: Column, b: Column) -> Column:
    """Channel columns -> ``rgb(r, g, b)``."""
    return F.concat(
        F.lit("rgb("), r.cast("string"), F.lit(", "), g.cast("string"), F.lit(", "), b.cast("string"), F.lit(")")
    )
