"""Mosaics of rasters, reprojection and coarsening on pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions.geo import MERCATOR_RADIUS, mercator_y
from terragrid.plans.sizing import Dim, number_rows, shuffled


#: Cells on a side of the squares in which a source is reprojected.
SQUARE = 16


def filter_collection(images: DataFrame, year: int) -> DataFrame:
    """images of a year by ``ts``; the last day is excluded, as in the date filter it follows."""
    start, end = F.lit(f"{year}-01-01").cast("timestamp_ntz"), F.lit(f"{year}-12-31").cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    return images.filter((ts >= start) & (ts < end))


def clip(pixels: DataFrame, area_pixels: DataFrame) -> DataFrame:
    """pixels inside the burnt area ``(y, x)``."""
    return pixels.join(shuffled(area_pixels.select("y", "x")), ["y", "x"], "left_semi")


def merge_first(pixels: DataFrame, order: str = "source", nodata: int = S.NODATA, last: bool = False) -> DataFrame:
    """R2: one raster from overlapping ones; the first valid value by ``order`` wins.

    ``last`` turns the order round (the newest image on top).  Sources are ranked
    once; pixels then need one small integer each, and a single shuffle.
    """
    ranks = number_rows(pixels.select(order).distinct(), [order], "_rank")
    ranked = Dim(ranks).join(pixels.filter(F.col("value") != nodata), [order], how="inner")
    pick = F.max_by("value", "_rank") if last else F.min_by("value", "_rank")
    return ranked.groupBy("y", "x").agg(pick.alias("value"))


def target_grid(src: dict) -> dict:
    """Geographic grid of a mercator raster that keeps the pixels along the diagonal.

    ``src`` holds ``west, north, resolution, width, height`` in metres.
    """
    deg = lambda m: math.degrees(math.atan(math.sinh(m / MERCATOR_RADIUS)))
    east = src["west"] + src["width"] * src["resolution"]
    south = src["north"] - src["height"] * src["resolution"]
    west_d, east_d = (math.degrees(v / MERCATOR_RADIUS) for v in (src["west"], east))
    north_d, south_d = deg(src["north"]), deg(south)
    size = math.hypot(east_d - west_d, north_d - south_d) / math.hypot(src["width"], src["height"])
    return {
        "xmin": west_d, "ymax": north_d, "pixel": size,
        "width": int((east_d - west_d) / size + 0.5), "height": int((north_d - south_d) / size + 0.5),
    }


def reproject(pixels: DataFrame, src: dict, dst: dict, band: str = "v", nodata=None, method: str = "bilinear") -> DataFrame:
    """Mercator pixels onto a geographic grid.

    Every output pixel looks up where its centre falls in the source.  For "bilinear"
    the source travels once, as squares of ``SQUARE`` cells with the row and column
    behind them; each square makes the output pixels that fall into it, so these are
    neither shuffled nor joined, however many a source pixel has.  Missing inputs drop
    out of the weights; an output pixel without any input is absent.
    """
    lng = lambda x: F.lit(dst["xmin"]) + (x + 0.5) * F.lit(dst["pixel"])
    lat = lambda y: F.lit(dst["ymax"]) - (y + 0.5) * F.lit(dst["pixel"])
    sx = lambda x: (F.radians(lng(x)) * F.lit(MERCATOR_RADIUS) - F.lit(src["west"])) / F.lit(src["resolution"]) - 0.5
    sy = lambda y: (F.lit(src["north"]) - mercator_y(lat(y)) * F.lit(MERCATOR_RADIUS)) / F.lit(src["resolution"]) - 0.5
    if method == "nearest":
        n = dst["width"] * dst["height"]
        cells = pixels.sparkSession.range(n).select(
            F.floor(F.col("id") / dst["width"]).cast("int").alias("y"), (F.col("id") % dst["width"]).cast("int").alias("x")
        )
        at = cells.select("y", "x", F.floor(sy(F.col("y")) + 0.5).cast("int").alias("_y"), F.floor(sx(F.col("x")) + 0.5).cast("int").alias("_x"))
        one = pixels.select(F.col("y").alias("_y"), F.col("x").alias("_x"), band)
        return at.join(shuffled(one), ["_y", "_x"]).select("y", "x", band)
    squares = _squares(pixels if nodata is None else pixels.filter(F.col(band) != nodata), band)
    # source place -> output row and column, to find those of a square; the exact place decides
    south = lambda r: F.degrees(F.atan(F.sinh((F.lit(src["north"]) - (r + 0.5) * F.lit(src["resolution"])) / F.lit(MERCATOR_RADIUS))))
    row_at = lambda r: (F.lit(dst["ymax"]) - south(r)) / F.lit(dst["pixel"]) - 0.5
    east = lambda c: F.degrees((F.lit(src["west"]) + (c + 0.5) * F.lit(src["resolution"])) / F.lit(MERCATOR_RADIUS))
    column_at = lambda c: (east(c) - F.lit(dst["xmin"])) / F.lit(dst["pixel"]) - 0.5

    def inside(df: DataFrame, axis: str, square: str, inverse, place, size: int) -> DataFrame:
        """A row for each output ``axis`` whose place lies in the square: ``_<axis>`` within it and the fraction."""
        begin = F.col(square) * F.lit(float(SQUARE))
        low = F.greatest(F.floor(inverse(begin)) - 1, F.lit(0))
        high = F.least(F.ceil(inverse(begin + F.lit(float(SQUARE)))) + 1, F.lit(size - 1))
        some = df.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
        some = some.withColumn(axis, F.explode(F.sequence("_low", "_high"))).drop("_low", "_high").withColumn("_s", place(F.col(axis)))
        some = some.filter(F.floor(F.floor("_s") / SQUARE) == F.col(square))
        return some.withColumn(f"_{axis}", (F.floor("_s") - F.col(square) * SQUARE).cast("int")).withColumn(f"_f{axis}", F.col("_s") - F.floor("_s")).drop("_s")

    met = inside(inside(squares, "y", "_by", row_at, sy, dst["height"]), "x", "_bx", column_at, sx, dst["width"])
    weight, total = F.lit(0.0), F.lit(0.0)
    for dy in (0, 1):
        for dx in (0, 1):
            w = (F.col("_fy") if dy else 1 - F.col("_fy")) * (F.col("_fx") if dx else 1 - F.col("_fx"))
            v = F.get(F.get("_rows", F.col("_y") + dy), F.col("_x") + dx)
            weight = weight + F.when(v.isNotNull(), w).otherwise(0.0)
            total = total + F.coalesce(w * v, F.lit(0.0))
    return met.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), weight.alias("_w"), total.alias("_t")).filter("_w > 0").select(
        "y", "x", (F.col("_t") / F.col("_w")).alias(band)
    )


def _squares(pixels: DataFrame, band: str) -> DataFrame:
    """``_by, _bx, _rows``: the pixels of a square of ``SQUARE`` cells, with the row and column behind it; the largest of repeated ones."""
    of = lambda c: F.floor(F.col(c) / SQUARE)
    before = lambda c: F.floor((F.col(c) - 1) / SQUARE)
    sent = pixels.select("y", "x", band, F.explode(F.sequence(before("y"), of("y"))).alias("_by")).select("*", F.explode(F.sequence(before("x"), of("x"))).alias("_bx"))
    # as many tasks as that, however few bytes they read: a square may stand for many output pixels
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.select("_by", "_bx", (F.col("y") - F.col("_by") * SQUARE).cast("int").alias("_r"), (F.col("x") - F.col("_bx") * SQUARE).cast("int").alias("_c"), band)
    # both groupings agree with the one shuffle by square
    rows = sent.repartition(n, "_by", "_bx").groupBy("_by", "_bx", "_r").agg(F.array(*[F.max(F.when(F.col("_c") == c, F.col(band))) for c in range(SQUARE + 1)]).alias("_row"))
    packed = rows.groupBy("_by", "_bx").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_row"))).alias("_m"))
    return packed.select("_by", "_bx", F.array(*[F.col("_m")[r] for r in range(SQUARE + 1)]).alias("_rows"))


def coarsen(pixels: DataFrame, factor: int, method: str = "nearest", nodata: int = S.NODATA) -> DataFrame:
    """One pixel per ``factor`` x ``factor`` block.

    "nearest" takes the pixel under the block's centre, at the right and bottom
    edge under the centre moved into the raster: a filter that needs no shuffle.
    "mean" averages the valid pixels.
    """
    by, bx = F.floor(F.col("y") / factor).cast("int"), F.floor(F.col("x") / factor).cast("int")
    if method == "nearest":
        mid = factor // 2
        edge = Dim(pixels.groupBy("raster_key").agg(F.max("y").alias("_my"), F.max("x").alias("_mx")))  # a row per raster
        placed = edge.join(pixels, ["raster_key"], how="inner", spread=["y", "x"])
        picked = placed.filter((F.col("y") == F.least(by * factor + mid, "_my")) & (F.col("x") == F.least(bx * factor + mid, "_mx")))
        return picked.select("raster_key", by.alias("y"), bx.alias("x"), "value")
    if method != "mean":
        raise ValueError("method must be 'nearest' or 'mean'")
    valid = pixels.filter(F.col("value") != nodata)
    return valid.groupBy("raster_key", by.alias("y"), bx.alias("x")).agg(F.avg("value").alias("value"))
