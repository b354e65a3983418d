"""Predicates over reserved cluster-id ranges, and the k of a raster key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terragrid import schema as S


def is_nodata(v: Column) -> Column:
    return v == S.NODATA


def is_selected(v: Column) -> Column:
    return v == S.SELECTED


def is_unlabeled_id(v: Column) -> Column:
    return v == S.UNLABELED_ID


def is_synthetic(v: Column) -> Column:
    return (v >= S.SYNTHETIC_START) & (v < S.FINE_GRAIN_START)


def is_fine_grain(v: Column) -> Column:
    return (v >= S.FINE_GRAIN_START) & (v < S.COMPOSITE_START)


def is_regular(v: Column) -> Column:
    return (v >= 0) & (v < S.SYNTHETIC_START)


def k_of(key: Column) -> Column:
    """``k12_x`` -> 12; null when the key holds no ``k<digits>``."""
    return F.nullif(F.regexp_extract(key, r"k(\d+)", 1), F.lit("")).cast("int")


def is_labeled(path: Column) -> Column:
    """False for null, empty and the sentinel path."""
    return F.coalesce((path != "") & (path != S.UNLABELED), F.lit(False))


def outside_reserved(number: Column) -> Column:
    """A running number as an id: those that would be reserved ones (9999 and above) move to ``COMPOSITE_START`` and beyond, in order."""
    return F.when(number < S.UNLABELED_ID, number).otherwise(number + S.COMPOSITE_START)
