"""Raster tables derived from the driver's star schema.

The grid is 50 pixels wide: order keys are dense, so every order is one pixel.
The twin of each table as SQL text is in ``plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions.geo import TILE_SIZE  # noqa: F401
from terragrid.operators.registry import build_registry
from terragrid.plans.sizing import stage

WIDTH = 50
KS = (5, 10, 20)
TILE = 10
PIXEL = 0.0625


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _class_path() -> Column:
    region = F.lower(F.regexp_replace("r_name", " ", "-"))
    return F.concat_ws(".", region, F.lower(F.regexp_replace("n_name", "_", "-")))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Three rasters k5, k10, k20 with nodata; k20 has more of it."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rasters = F.array(*[F.struct(F.lit(f"k{k}").alias("raster_key"), F.lit(k).alias("k")) for k in KS])
    px = o.select("*", F.explode(rasters).alias("r")).select("o_orderkey", "o_custkey", "r.raster_key", "r.k")
    y, x = F.floor(F.col("o_orderkey") / WIDTH), F.col("o_orderkey") % WIDTH
    value = (
        F.when(F.col("o_custkey") % 13 == 0, F.lit(-1))
        .when((F.col("k") == 20) & (F.col("o_custkey") % 17 == 0), F.lit(-1))
        .when(F.col("o_custkey") % 11 == 0, F.col("o_custkey") % F.col("k"))
        .otherwise((F.floor(x / 5) + 3 * F.floor(F.col("o_orderkey") / 250)) % F.col("k"))
    )
    return px.select("raster_key", y.cast("int").alias("y"), x.cast("int").alias("x"), value.cast("int").alias("value"))


def raster_meta(spark: SparkSession, sf: str) -> DataFrame:
    top = table(spark, sf, "orders").agg(F.max("o_orderkey").alias("m"))
    height = (F.floor(F.col("m") / WIDTH) + 1).cast("int")
    keyed = top.select(height.alias("height"), F.explode(F.array(*[F.lit(k) for k in KS])).alias("k"))
    return keyed.select(
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("raster_key"), "k", F.lit(80.0).alias("xmin"),
        (F.lit(12.0) - F.col("height") * PIXEL).alias("ymin"), F.lit(80.0 + WIDTH * PIXEL).alias("xmax"),
        F.lit(12.0).alias("ymax"), F.lit(PIXEL).alias("pixel_width"), F.lit(PIXEL).alias("pixel_height"),
        F.lit(WIDTH).alias("width"), "height", F.lit(-1).alias("nodata"), F.lit(4326).alias("epsg"),
    )


def nations(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("path", _class_path())


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region")
    key = F.lower(F.regexp_replace("r_name", " ", "-"))
    top = r.select(key.alias("path"), F.lit(None).cast("string").alias("parent_path"), F.col("r_name").alias("name"),
                   F.lit(1).alias("level"), F.lit(False).alias("is_leaf"))
    leaf = nations(spark, sf).select("path", F.substring_index("path", ".", 1).alias("parent_path"),
                                     F.col("n_name").alias("name"), F.lit(2).alias("level"), F.lit(True).alias("is_leaf"))
    return top.unionByName(leaf)


def hierarchy_colors(spark: SparkSession, sf: str) -> DataFrame:
    """Every third leaf has no colour of its own."""
    r = table(spark, sf, "region")
    key = F.lower(F.regexp_replace("r_name", " ", "-"))
    top = r.select(key.alias("path"), F.concat(F.lit("#"), (F.col("r_regionkey") + 10).cast("string"), F.lit("4080")).alias("hex"))
    leaf = nations(spark, sf).filter("n_nationkey % 3 <> 0").select(
        "path", F.concat(F.lit("#"), (F.col("n_nationkey") + 40).cast("string"), F.lit("2060")).alias("hex"))
    return top.unionByName(leaf)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """About half of the clusters of each raster."""
    rasters = F.array(*[F.struct(F.lit(f"k{k}").alias("raster_key"), F.lit(k).alias("k")) for k in KS])
    n = nations(spark, sf).select("n_nationkey", "path", F.explode(rasters).alias("r"))
    n = n.filter((F.col("n_nationkey") < F.col("r.k")) & ((F.col("n_nationkey") + F.floor(F.col("r.k") / 10)) % 2 == 0))
    return n.select("r.raster_key", F.col("n_nationkey").cast("int").alias("cluster_id"), "path")


def palette(spark: SparkSession, sf: str) -> DataFrame:
    """Channels per cluster from its pixel count; a third of the clusters have none."""
    n = registry(spark, sf).filter("cluster_id % 3 <> 2")
    c = lambda m: ((F.col("pixel_count") * m + F.col("cluster_id") * 31) % 256).cast("int")
    return n.select("raster_key", "cluster_id", c(1).alias("r"), c(3).alias("g"), c(7).alias("b"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    return build_registry(pixels(spark, sf), labels(spark, sf))


def colored_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Registry whose colour follows from the id; every fourth cluster has none."""
    i = F.col("cluster_id")
    css = F.concat(F.lit("rgb("), (i * 9 % 256).cast("string"), F.lit(", "), (i * 5 % 256).cast("string"),
                   F.lit(", "), (i * 12 % 256).cast("string"), F.lit(")"))
    return registry(spark, sf).withColumn("color", F.when(i % 4 != 3, css))


def segmented(spark: SparkSession, sf: str, colored: bool = False) -> S.SegmentedRaster:
    reg = colored_registry(spark, sf) if colored else registry(spark, sf)
    return S.SegmentedRaster(pixels(spark, sf), stage(reg, "registry"), raster_meta(spark, sf))


def _ring(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(x.alias("lng"), y.alias("lat")) for x, y in points])


def features(spark: SparkSession, sf: str) -> DataFrame:
    """One polygon per customer: rectangles and, every third, a right triangle.

    They overlap, cover the whole grid and pass its right edge; sides lie a
    quarter pixel off the grid, so no pixel centre touches an edge.
    """
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    x0, y0 = (k * 7) % 45, F.floor(k / 5)
    w, h = 4 + 2 * (k % 4), 3 + 2 * (k % 3)
    px = lambda v: F.lit(80.0) + (v + 0.25) * PIXEL
    py = lambda v: F.lit(12.0) - (v + 0.25) * PIXEL
    west, east, north, south = px(x0), px(x0 + w), py(y0), py(y0 + h)
    box = _ring([(west, north), (east, north), (east, south), (west, south), (west, north)])
    tri = _ring([(west, north), (east, north), (west, south), (west, north)])
    props = F.create_map(
        F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.concat(F.lit(" Nation "), F.col("c_nationkey").cast("string")),
        F.lit("code"), F.when(k % 4 != 1, F.concat(F.lit("C"), (k % 97).cast("string"))),
    )
    return c.select(
        (k + 1).cast("int").alias("feature_id"), F.array(F.when(k % 3 == 0, tri).otherwise(box)).alias("rings"), props.alias("properties")
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Some fall east or south of the grid."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    return e.select(
        F.col("event_id").alias("point_id"),
        (F.lit(80.0) + ((F.col("user_id") * 7) % 60 + 0.5) * PIXEL).alias("lng"),
        (F.lit(12.0) - ((F.col("event_id") * 11) % 40 + 0.5) * PIXEL).alias("lat"),
    )


def label_events(spark: SparkSession, sf: str) -> DataFrame:
    """Edit log; ids from 10 of k10 do not exist."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    n = nations(spark, sf).select("n_nationkey", F.col("path").alias("_path"))
    e = e.join(n, F.col("event_id") % 25 == F.col("n_nationkey"))
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("event_id") % 2 == 0, F.lit("k10")).otherwise(F.lit("k20")).alias("raster_key"),
        (F.col("user_id") % 20).cast("int").alias("cluster_id"),
        F.when(F.col("event_type") == "view", F.lit(S.UNLABELED)).otherwise(F.col("_path")).alias("path"),
    )


def tile_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """RGB tiles of 10 x 10: zoom 6, and zoom 5 as rounded 2 x 2 means.

    Some zoom 6 tiles are parents blown up.
    """
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    v = F.col("o_custkey")
    c = o.select(
        (F.col("o_orderkey") % WIDTH).cast("int").alias("gx"), F.floor(F.col("o_orderkey") / WIDTH).cast("int").alias("gy"),
        (v % 256).cast("int").alias("r"), (v * 3 % 256).cast("int").alias("g"), (v * 7 % 256).cast("int").alias("b"),
    )
    half = lambda n: F.floor(F.col(n) / 2).cast("int")
    p = c.groupBy(half("gx").alias("hx"), half("gy").alias("hy")).agg(
        *[F.floor(F.avg(b) + 0.5).cast("int").alias(f"p{b}") for b in "rgb"]
    )
    fake = (F.floor(F.col("gx") / TILE) + F.floor(F.col("gy") / TILE)) % 7 == 3
    f = c.withColumn("hx", half("gx")).withColumn("hy", half("gy")).join(p, ["hx", "hy"]).select(
        "gx", "gy", *[F.when(fake, F.col(f"p{b}")).otherwise(F.col(b)).alias(b) for b in "rgb"]
    )
    up = p.select(F.col("hx").alias("gx"), F.col("hy").alias("gy"), *[F.col(f"p{b}").alias(b) for b in "rgb"])
    cut = lambda df, z: df.select(
        F.lit(z).alias("z"), F.floor(F.col("gx") / TILE).cast("int").alias("x"), F.floor(F.col("gy") / TILE).cast("int").alias("y"),
        (F.col("gy") % TILE).alias("py"), (F.col("gx") % TILE).alias("px"), "r", "g", "b",
    )
    return cut(f, 6).unionByName(cut(up, 5))


def detection_payloads(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    conf = F.concat(s(F.col("p_size") % 10), F.lit("e-1"))
    obj = F.concat(F.lit('{"objects":[{"id":"'), s(k), F.lit('","class":"'), F.lower("p_type"), F.lit('","confidence":'), conf,
                   F.lit(',"bbox":['), F.concat_ws(",", s(k % 32), s(k % 16), s(k % 32 + 8), s(k % 16 + 4)), F.lit("]}]}"))
    arr = F.concat(F.lit('[{"id":"'), s(k), F.lit('","label":"'), F.lower("p_type"), F.lit('","confidence":'), conf,
                   F.lit(',"box_2d":['), F.concat_ws(",", s(k % 500), s(k % 400), s(k % 500 + 250), s(k % 400 + 125)), F.lit("]}]"))
    return p.select(F.col("p_partkey").alias("payload_id"), F.when(k % 2 == 0, obj).otherwise(arr).alias("payload"))
