"""Map tiles: inventory, work lists, mosaics and the up-sampling audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terragrid.functions.geo import TILE_SIZE, tile_origin, tile_resolution
from terragrid.plans.sizing import Dim, number_rows, stage, staged_rows

# Cubic kernel weights of the four taps of an up-sampled pixel, in 1/128,
# for even and odd output positions, and the fixed-point bits of the image library.
TAPS_EVEN = ((-2, -3), (-1, 29), (0, 111), (1, -9))
TAPS_ODD = ((-1, -9), (0, 111), (1, 29), (2, -3))
WEIGHT_BITS = 22
# Grey weights in 1/65536.
GREY = {"r": 19595, "g": 38470, "b": 7471}
THRESHOLD = 3.0
BAD_SHARE = 0.05


def drop_bad_tiles(tiles: DataFrame, tile_size: int = TILE_SIZE) -> tuple[DataFrame, DataFrame]:
    """tiles whose ``values`` hold a full square, and the number of the others."""
    full = F.coalesce(F.size("values") == tile_size * tile_size, F.lit(False))
    return tiles.filter(full), tiles.agg(F.count_if(~full).alias("n_bad"))


def tile_pixels_from_arrays(tiles: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """One row per pixel from tiles with a row-major ``values`` array."""
    i = F.col("_i")
    return tiles.select("z", "x", "y", F.posexplode("values").alias("_i", "v")).select(
        "z", "x", "y", F.floor(i / tile_size).cast("int").alias("py"), (i % tile_size).alias("px"), "v"
    )


def missing_tiles(needed: DataFrame, inventory: DataFrame) -> DataFrame:
    """Needed tiles without a non-empty file."""
    present = inventory.filter("size > 0").select("z", "x", "y")
    return needed.join(present, ["z", "x", "y"], "left_anti")


def parent_tiles(children: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each child with its parent, its quadrant (0/1) and whether the parent exists."""
    have = inventory.select(
        F.col("z").alias("pz"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"), F.lit(True).alias("_have")
    ).distinct()
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    keyed = children.select(
        "z", "x", "y", (F.col("z") - 1).alias("pz"), half("x").alias("parent_x"), half("y").alias("parent_y"),
        (F.col("x") % 2).alias("qx"), (F.col("y") % 2).alias("qy"),
    )
    joined = keyed.join(have, ["pz", "parent_x", "parent_y"], "left")
    return joined.select(
        "z", "x", "y", "parent_x", "parent_y", "qx", "qy", F.coalesce("_have", F.lit(False)).alias("has_parent")
    )


def spread_sample(tiles: DataFrame, samples: int = 200) -> DataFrame:
    """Evenly spread tiles: sorted by (x, y), every n-th, at most ``samples``."""
    ranked = number_rows(tiles.select("z", "x", "y").distinct(), ["x", "y"], "_rn", within=["z"])
    ranked = stage(ranked, "ranked")
    sizes = ranked.groupBy("z").agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / samples)).cast("int")
    picked = Dim(sizes).join(ranked, ["z"], how="inner").withColumn("_step", step)
    return picked.filter((F.col("_rn") % F.col("_step") == 0) & (F.col("_rn") / F.col("_step") < samples)).select("z", "x", "y")


def mosaic_extent(tiles: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Columns, rows and north-west corner of the mosaic of each zoom level."""
    ext = tiles.groupBy("z").agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.count_distinct("x", "y").alias("n_tiles"),
    )
    corner = tile_origin(F.col("min_x"), F.col("min_y"), F.col("z"), tile_size)
    return ext.select(
        "z", "min_x", "min_y", "n_tiles",
        ((F.col("max_x") - F.col("min_x") + 1) * tile_size).alias("width"),
        ((F.col("max_y") - F.col("min_y") + 1) * tile_size).alias("height"),
        corner["west"].alias("west"), corner["north"].alias("north"),
        tile_resolution(F.col("z"), tile_size).alias("resolution"),
    )


def mosaic(tile_pixels: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Tile pixels on the grid of their mosaic; missing tiles are absent rows (0).

    The extent is one row per zoom level; placing is arithmetic, without a shuffle.
    """
    ext = Dim(tile_pixels.groupBy("z").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y")))
    bands = [c for c in tile_pixels.columns if c not in ("z", "x", "y", "py", "px")]
    placed = ext.join(tile_pixels, ["z"], how="inner")
    return placed.select(
        "z",
        ((F.col("y") - F.col("min_y")) * tile_size + F.col("py")).alias("y"),
        ((F.col("x") - F.col("min_x")) * tile_size + F.col("px")).alias("x"),
        *bands,
    )


def feature_bounds(features: DataFrame, configured: tuple | None = None) -> DataFrame:
    """Bounds of all vertices, else the configured ones; an error if there are neither."""
    v = features.select(F.explode(F.flatten("rings")).alias("v")).agg(
        F.min("v.lng").alias("west"), F.min("v.lat").alias("south"), F.max("v.lng").alias("east"), F.max("v.lat").alias("north")
    )
    out = []
    for i, c in enumerate(("west", "south", "east", "north")):
        other = F.lit(float(configured[i])) if configured else F.raise_error(F.lit("neither features nor bounds given")).cast("double")
        out.append(F.when(F.col(c).isNull(), other).otherwise(F.col(c)).alias(c))
    return v.select(*out)


def cubic_taps(spark, edge: int) -> DataFrame:
    """Weights of every source position for a doubled edge: ``src, dst, w``.

    Taps outside the edge are dropped and the rest renormalised; weights are
    fixed-point integers.  The table has at most ``8 * edge`` rows.
    """
    taps = lambda t: F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in t])
    dst = spark.range(2 * edge).select(F.col("id").cast("int").alias("dst"))
    m = F.floor(F.col("dst") / 2).cast("int")
    all_taps = dst.withColumn("t", F.explode(F.when(F.col("dst") % 2 == 0, taps(TAPS_EVEN)).otherwise(taps(TAPS_ODD))))
    inside = all_taps.select("dst", (m + F.col("t.o")).alias("src"), F.col("t.w").alias("w")).filter(
        (F.col("src") >= 0) & (F.col("src") < edge)
    )
    total = F.sum("w").over(Window.partitionBy("dst"))
    scaled = F.col("w") / total * float(1 << WEIGHT_BITS)
    fixed = F.when(scaled >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5))
    return inside.select("dst", "src", fixed.cast("long").alias("w"))


def _stretch(pixels: DataFrame, taps: DataFrame, keys: list[str], axis: str, bands: list[str]) -> DataFrame:
    """Double one axis: every pixel adds its weighted value to up to eight outputs."""
    spread = pixels.join(F.broadcast(taps.select(F.col("src").alias(axis), "dst", "w")), [axis])
    sums = [F.sum(F.col(b).cast("long") * F.col("w")).alias(b) for b in bands]
    added = spread.groupBy(*keys, F.col("dst").alias(axis)).agg(*sums)
    level = lambda b: F.shiftright(F.col(b) + (1 << (WEIGHT_BITS - 1)), WEIGHT_BITS)
    clip = [F.greatest(F.lit(0), F.least(F.lit(255), level(b))).cast("int").alias(b) for b in bands]
    return added.select(*keys, axis, *clip)


def upsample_quadrant(pixels: DataFrame, edge: int, keys: list[str], bands: list[str]) -> DataFrame:
    """Double ``edge`` x ``edge`` quadrants by cubic interpolation, 8 bit per pass.

    ``pixels`` has ``keys, py, px`` and integer ``bands``; the kernel stays inside
    the quadrant.  ``taps`` is bounded by the tile edge and broadcast.
    """
    taps = stage(cubic_taps(pixels.sparkSession, edge), "taps")
    wide = _stretch(pixels, taps, keys + ["py"], "px", bands)
    return _stretch(wide, taps, keys + ["px"], "py", bands)


def grey_level() -> Column:
    """Luminance of integer ``r, g, b`` as the image library computes it."""
    weighted = sum((F.col(c) * w for c, w in GREY.items()), F.lit(0x8000))
    return F.shiftright(weighted.cast("long"), 16)


def laplacian_variance(pixels: DataFrame, keys: list[str], edge: int, value: str) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian over interior pixels.

    Each pixel adds its share to itself and its neighbours; sums are integers,
    so the result does not depend on their order.
    """
    shares = F.array(
        *[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w"))
          for dy, dx, w in ((0, 0, 4), (-1, 0, -1), (1, 0, -1), (0, -1, -1), (0, 1, -1))]
    )
    spread = pixels.select(*keys, "py", "px", value, F.explode(shares).alias("s"))
    lap = spread.groupBy(*keys, (F.col("py") + F.col("s.dy")).alias("py"), (F.col("px") + F.col("s.dx")).alias("px")).agg(
        F.sum(F.col(value).cast("long") * F.col("s.w")).alias("_l")
    )
    inner = lap.filter((F.col("py") > 0) & (F.col("py") < edge - 1) & (F.col("px") > 0) & (F.col("px") < edge - 1))
    n, s, q = F.count(F.lit(1)), F.sum("_l"), F.sum(F.col("_l") * F.col("_l"))
    sums = inner.groupBy(*keys).agg(n.alias("_n"), s.alias("_s"), q.alias("_q"))
    var = (F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s")) / (F.col("_n") * F.col("_n"))
    return sums.select(*keys, var.cast("double").alias("lap_var"))


def tile_audit(
    tile_pixels: DataFrame, z: int, samples: int | None = None, threshold: float = THRESHOLD, tile_size: int = TILE_SIZE,
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Compare tiles with their up-sampled parents: all of them, or an evenly spread sample.

    ``tile_pixels`` has ``z, x, y, py, px, r, g, b``; ``tile_size`` must be even.
    Without an ``inventory`` of tiles it is read from the pixels.  Only pixels of
    chosen tiles and their parents go through the shuffles.  Tiles without a
    parent are left out; ``parent_tiles`` lists them.
    """
    bands = ["r", "g", "b"]
    tile = ["x", "y"]
    inv = stage((tile_pixels if inventory is None else inventory).select("z", "x", "y").distinct(), "inventory")
    level = inv.filter(F.col("z") == z)
    chosen = level if samples is None else spread_sample(level, samples)
    pairs = Dim(parent_tiles(chosen, inv).filter("has_parent").drop("has_parent"))
    child = pairs.join(tile_pixels.filter(F.col("z") == z), ["z", "x", "y"], how="left_semi", bounded=True).select(*tile, "py", "px", *bands)
    half = tile_size // 2
    up = tile_pixels.filter(F.col("z") == z - 1).select(
        F.col("x").alias("parent_x"), F.col("y").alias("parent_y"),
        F.floor(F.col("px") / half).cast("int").alias("qx"), F.floor(F.col("py") / half).cast("int").alias("qy"),
        (F.col("py") % half).alias("py"), (F.col("px") % half).alias("px"), *bands,
    )
    quads = Dim(pairs.df.select("parent_x", "parent_y", "qx", "qy", "x", "y")).join(
        up, ["parent_x", "parent_y", "qx", "qy"], how="inner", bounded=True
    )
    quad = stage(upsample_quadrant(quads.select(*tile, "py", "px", *bands), half, tile, bands), "upsampled")
    child = stage(child, "children")
    both = child.join(quad.select(*tile, "py", "px", *[F.col(b).alias(f"q{b}") for b in bands]), [*tile, "py", "px"])
    diff = sum((F.abs(F.col(b) - F.col(f"q{b}")) for b in bands), F.lit(0))
    mae = both.groupBy(*tile).agg((F.sum(diff) / (F.count(F.lit(1)) * len(bands))).alias("mae"))
    lap_c = laplacian_variance(child.withColumn("_g", grey_level()), tile, tile_size, "_g").withColumnRenamed("lap_var", "lap_child")
    lap_q = laplacian_variance(quad.withColumn("_g", grey_level()), tile, tile_size, "_g").withColumnRenamed("lap_var", "lap_parent")
    ratio = F.when(F.col("lap_parent") > 0, F.try_divide(F.col("lap_child"), F.col("lap_parent"))).otherwise(F.lit(float("inf")))
    joined = mae.join(lap_c, tile).join(lap_q, tile).withColumn("detail_ratio", ratio)
    return joined.select("x", "y", "mae", "lap_child", "lap_parent", "detail_ratio", (F.col("detail_ratio") < threshold).alias("suspect"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Spread of both measures, suspects, and the verdict (more than 5 % is bad)."""
    held = stage(audit, "audit")
    middle = {c: _median(held, c) for c in ("mae", "detail_ratio")}
    return held.agg(
        F.count(F.lit(1)).alias("n_tiles"),
        F.min("mae").alias("mae_min"), F.lit(middle["mae"]).cast("double").alias("mae_median"), F.max("mae").alias("mae_max"),
        F.min("detail_ratio").alias("ratio_min"), F.lit(middle["detail_ratio"]).cast("double").alias("ratio_median"),
        F.max("detail_ratio").alias("ratio_max"), F.count_if("suspect").alias("n_suspect"),
    ).withColumn("bad", F.col("n_suspect") > F.col("n_tiles") * BAD_SHARE)


def _median(rows: DataFrame, column: str) -> float | None:
    """Exact median by the numbers of the ordered rows; no task holds all values."""
    some = stage(rows.select(column).filter(F.col(column).isNotNull()), "values")
    n = staged_rows(some)
    places = [(n - 1) // 2, n // 2]
    return number_rows(some, [column], "_rn").filter(F.col("_rn").isin(places)).agg(F.avg(column)).first()[0] if n else None


def weakest_tiles(audit: DataFrame, n: int = 5) -> DataFrame:
    """The tiles closest to an interpolated parent."""
    return audit.orderBy("detail_ratio", "x", "y").limit(n)


def suspect_tiles(audit: DataFrame, n: int = 12) -> DataFrame:
    """The first suspects by (x, y)."""
    return audit.filter("suspect").orderBy("x", "y").limit(n)
