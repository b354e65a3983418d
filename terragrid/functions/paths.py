"""Dotted class paths: truncation, ancestors, keys and display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terragrid.functions.ids import is_labeled


def depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def truncate(path: Column, level: int | Column | None) -> Column:
    """First ``level`` segments; null, empty and "unlabeled" pass through."""
    if level is None:
        return path
    parts = F.split(path, r"\.")
    level = level if isinstance(level, Column) else F.lit(level)
    return F.when(is_labeled(path), F.array_join(F.slice(parts, F.lit(1), level), ".")).otherwise(path)


def prefixes(path: Column, max_level: int | None = None) -> Column:
    """All prefixes, shortest first: ``a.b.c`` -> ``[a, a.b, a.b.c]``."""
    parts = F.split(path, r"\.")
    n = F.size(parts) if max_level is None else F.least(F.size(parts), F.lit(max_level))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def parent(path: Column) -> Column:
    """Path without its last segment; null for a root."""
    return F.nullif(F.regexp_replace(path, r"\.?[^.]*$", ""), F.lit(""))


def leaf_name(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def display_name(path: Column) -> Column:
    return F.replace(leaf_name(path), F.lit("_"), F.lit(" "))


def display_path(path: Column) -> Column:
    return F.replace(path, F.lit("."), F.lit(" > "))


def kebab(text: Column) -> Column:
    """Lower case, every run outside ``a-z0-9`` one dash, no dash at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
