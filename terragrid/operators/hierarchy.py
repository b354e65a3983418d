"""Class hierarchies: flattening, colours, roll-ups and building from attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions import paths as P
from terragrid.functions.color import DEFAULT_HEX, hex_to_css
from terragrid.functions.ids import is_labeled
from terragrid.plans.sizing import Dim, spread_rows

_MAP = "map<string,string>"


def _children(json: Column) -> Column:
    entries = F.map_entries(F.from_json(json, _MAP))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return F.filter(F.coalesce(entries, empty), lambda e: ~e["key"].startswith("_"))


def nesting(json: Column) -> Column:
    """How deep the objects of a JSON text are nested: braces outside of strings."""
    braces = F.regexp_replace(F.regexp_replace(json, r'"(?:\\.|[^"\\])*"', ""), "[^{}]", "")
    step = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    chars = F.filter(F.split(F.coalesce(braces, F.lit("")), "", -1), lambda c: c != "")
    return F.aggregate(chars, step, count, lambda acc: acc["most"])


def flatten_hierarchy(docs: DataFrame) -> DataFrame:
    """P20: rows of nested hierarchy documents.

    ``docs`` has a JSON text column ``hierarchy``; other columns are carried
    along.  Keys that start with ``_`` are attributes.  ``order_key`` sorts the
    rows of one document in pre-order; ``level`` counts from 0.  Every step
    emits a node next to its children, so the plan is one chain of generators
    without a union.  There are as many steps as the deepest document has levels,
    which one pass over the documents tells.
    """
    carried = [c for c in docs.columns if c != "hierarchy"]
    docs = spread_rows(docs)
    node = "struct<path:array<string>,pos:array<int>,json:string,open:boolean>"
    make = lambda path, pos, json, is_open: F.struct(path, pos, json, is_open).cast(node)
    none_s, none_i = F.array().cast("array<string>"), F.array().cast("array<int>")
    here = docs.select(*carried, make(none_s, none_i, F.col("hierarchy"), F.lit(True)).alias("_n"))
    n = F.col("_n")
    for _ in range(docs.agg(F.max(nesting(F.col("hierarchy")))).first()[0] or 0):
        kids = F.transform(
            _children(n["json"]),
            lambda e, i: make(
                F.concat(n["path"], F.array(e["key"])), F.concat(n["pos"], F.array(i)), e["value"], F.lit(True)
            ),
        )
        closed = F.array(make(n["path"], n["pos"], n["json"], F.lit(False)))
        here = here.select(*carried, F.explode(F.when(n["open"], F.concat(closed, kids)).otherwise(closed)).alias("_n"))
    leaf = F.size(_children(n["json"])) == 0
    return here.filter(F.size(n["path"]) > 0).select(
        *carried,
        F.array_join(n["path"], ".").alias("path"),
        F.array_join(n["path"], " > ").alias("display_path"),
        (F.size(n["path"]) - 1).alias("level"),
        F.element_at(n["path"], -1).alias("name"),
        leaf.alias("is_leaf"),
        n["pos"].alias("order_key"),
    )


def selectable_options(flat: DataFrame) -> DataFrame:
    """P20: the flattened rows with the "unlabeled" choice in front."""
    spark = flat.sparkSession
    first = spark.range(1).select(
        F.lit(S.UNLABELED).alias("path"),
        F.lit("Unlabeled").alias("display_path"),
        F.lit(0).alias("level"),
        F.lit("Not yet classified").alias("description"),
        F.lit(True).alias("is_leaf"),
        F.array().cast("array<int>").alias("order_key"),
    )
    rest = flat.select("path", "display_path", "level", F.col("name").alias("description"), "is_leaf", "order_key")
    return first.unionByName(rest).orderBy("order_key")


def by_prefix(hierarchy: DataFrame, prefix: str) -> DataFrame:
    """rows whose path starts with the text (not segment aware)."""
    return hierarchy.filter(F.col("path").startswith(prefix))


def path_colors(
    paths: DataFrame, colors: DataFrame, strict: bool = True, fallback: str | None = None, level: int | None = None
) -> DataFrame:
    """Colour of each distinct ``path``: its own, else the nearest ancestor's.

    With ``strict`` a path without any colour is an error when read, otherwise it
    gets ``fallback``.  ``level`` truncates first.  Unlabelled paths have no
    colour.  Adds ``hex`` and ``css``.
    """
    distinct = paths.select("path").distinct()
    shown = distinct.withColumn("_shown", P.truncate(F.col("path"), level)).filter(is_labeled(F.col("path")))
    steps = shown.select("path", "_shown", F.posexplode(P.prefixes(F.col("_shown"))).alias("_depth", "_prefix"))
    known = colors.filter(F.col("hex") != "").select(F.col("path").alias("_prefix"), "hex")
    # both sides have one row per class, never per pixel
    best = (
        steps.join(known, "_prefix", "left")
        .groupBy("path", "_shown")
        .agg(F.max_by("hex", F.when(F.col("hex").isNotNull(), F.col("_depth"))).alias("hex"))
    )
    if strict:
        missing = F.raise_error(F.concat(F.lit("No color mapping found for path: "), F.col("_shown"))).cast("string")
    else:
        missing = F.lit(fallback).cast("string")
    best = best.select("path", F.when(F.col("hex").isNull(), missing).otherwise(F.col("hex")).alias("hex"))
    labeled = best.select("path", "hex", hex_to_css(F.col("hex"), strict).alias("css"))
    none = F.lit(None).cast("string")
    rest = distinct.filter(~is_labeled(F.col("path"))).select("path", none.alias("hex"), none.alias("css"))
    return labeled.unionByName(rest)


def items_at_level(hierarchy: DataFrame, colors: DataFrame, level: int) -> DataFrame:
    """entries at a level (counted from 1) with their colour, by name."""
    rows = hierarchy.filter(P.depth(F.col("path")) == level).select("path").distinct()
    colored = path_colors(rows, colors, strict=True)
    return colored.select(
        "path",
        P.leaf_name(F.col("path")).alias("name"),
        P.display_path(F.col("path")).alias("display_path"),
        F.concat(F.lit("#"), F.ltrim(F.col("hex"), F.lit("#"))).alias("hex"),
    ).orderBy("name", "path")


def hierarchy_rollup(registry: DataFrame, level: int, colors: DataFrame | None = None) -> DataFrame:
    """Labelled paths and their area under every prefix up to ``level``.

    The registry is reduced to one row per path before prefixes are generated.
    """
    used = (
        registry.filter(is_labeled(F.col("classification_path")))
        .groupBy(F.col("classification_path").alias("path"))
        .agg(F.sum("area_ha").cast("decimal(18,2)").alias("area_ha"))
    )
    steps = used.withColumn("prefix", F.explode(P.prefixes(F.col("path"), level)))
    nodes = steps.groupBy(F.col("prefix").alias("path")).agg(
        F.count(F.lit(1)).alias("n_paths"),
        F.sum("area_ha").cast("decimal(18,2)").alias("area_ha"),
        F.max(F.col("prefix") == F.col("path")).alias("has_direct"),
    )
    out = nodes.select(
        "path",
        P.parent(F.col("path")).alias("parent_path"),
        P.leaf_name(F.col("path")).alias("name"),
        P.depth(F.col("path")).alias("level"),
        "n_paths",
        "area_ha",
        "has_direct",
    )
    if colors is None:
        return out
    shades = path_colors(out, colors, strict=False, fallback=DEFAULT_HEX)
    return out.join(shades.select("path", "hex"), "path", "left")


def _attribute(features: DataFrame, field: str) -> Column:
    return F.btrim(F.col("properties")[field])


def _known_fields(features: DataFrame, of_first: bool) -> DataFrame:
    """Field names of all features, or of the first one only."""
    rows = features.agg(F.min_by("properties", "feature_id").alias("properties")) if of_first else features
    return rows.select(F.explode(F.map_keys("properties")).alias("field")).distinct()


def field_profile(features: DataFrame, samples: int = 5, of_first: bool = False) -> DataFrame:
    """Per attribute the first distinct values, distinct and filled counts.

    ``of_first`` profiles the fields of the first feature only.

    Values are counted per (field, value) first, so the sample list only keeps
    ``samples`` rows per field and a frequent value is one row.
    """
    values = features.select("feature_id", F.explode("properties").alias("field", "value")).filter("value IS NOT NULL")
    per_value = values.groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("_n"), F.min("feature_id").alias("_first")
    )
    fields = Dim(_known_fields(features, of_first))
    per_value = fields.join(per_value, ["field"], how="left_semi")
    stats = per_value.groupBy("field").agg(
        F.sum("_n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct")
    )
    # the rank filter is applied before the shuffle, so each task sends at most ``samples`` rows per field
    ranked = per_value.withColumn("_rn", F.row_number().over(Window.partitionBy("field").orderBy("_first", "value")))
    firsts = ranked.filter(F.col("_rn") <= samples).groupBy("field").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rn", "value"))), lambda s: s["value"]).alias("samples")
    )
    profile = stats.join(firsts, "field")
    empty = fields.df.join(stats, "field", "left_anti").select(
        "field", F.lit(0).cast("long").alias("n_values"), F.lit(0).cast("long").alias("n_distinct"),
        F.array().cast("array<string>").alias("samples"),
    )
    return profile.select("field", "n_values", "n_distinct", "samples").unionByName(empty)


def flat_hierarchy(features: DataFrame, field: str) -> DataFrame:
    """One class per distinct attribute value, the last spelling wins."""
    original = _attribute(features, field)
    rows = features.select("feature_id", original.alias("_o")).filter("_o IS NOT NULL")
    named = rows.groupBy(P.kebab(F.col("_o")).alias("path")).agg(F.max_by("_o", "feature_id").alias("name"))
    return named.select(
        "path", F.lit(None).cast("string").alias("parent_path"), "name", F.lit(1).alias("level"), F.lit(True).alias("is_leaf")
    )


def two_level_hierarchy(features: DataFrame, parent_field: str, child_field: str) -> DataFrame:
    """Parents with children, the first spelling wins at both levels."""
    rows = features.select(
        "feature_id", _attribute(features, parent_field).alias("_p"), _attribute(features, child_field).alias("_c")
    ).filter("_p IS NOT NULL AND _c IS NOT NULL")
    keyed = rows.select("*", P.kebab(F.col("_p")).alias("_pk"), P.kebab(F.col("_c")).alias("_ck"))
    pairs = keyed.groupBy("_pk", "_ck").agg(
        F.min_by("_c", "feature_id").alias("name"), F.min_by("_p", "feature_id").alias("_pname"),
        F.min("feature_id").alias("_first"),
    )
    children = pairs.select(
        F.concat_ws(".", "_pk", "_ck").alias("path"), F.col("_pk").alias("parent_path"), "name",
        F.lit(2).alias("level"), F.lit(True).alias("is_leaf"), F.lit(0).cast("long").alias("n_children"),
    )
    parents = pairs.groupBy(F.col("_pk").alias("path")).agg(
        F.min_by("_pname", "_first").alias("name"), F.count(F.lit(1)).alias("n_children")
    )
    parents = parents.select(
        "path", F.lit(None).cast("string").alias("parent_path"), "name", F.lit(1).alias("level"),
        F.lit(False).alias("is_leaf"), "n_children",
    )
    return parents.unionByName(children)
