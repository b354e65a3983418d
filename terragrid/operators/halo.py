"""Stencils on blocks: a halo exchange, then work on arrays.

Every block sends its border rows, columns and corners to the eight blocks around it;
nothing else is shuffled when the blocks are laid out by their place already (as
``store.pack_blocks`` leaves them).  The padded block, ``(block + 2)`` squared and null
where the raster ends, then answers for every pixel and its neighbours at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions.ids import is_labeled
from terragrid.operators.region import OFFSETS_8
from terragrid.operators.store import PLACE, block_of, cell_of
from terragrid.plans.sizing import Dim

#: Raster keys by which blocks are left out; they are named in the plan.
RASTERS = 1000


def with_halo(blocks: DataFrame, block: int) -> DataFrame:
    """``raster_key, by, bx, padded``: the values of each block inside a rim of its neighbours' pixels."""
    v = F.col("values")
    row = lambda r: F.slice(v, r * block + 1, block)
    column = lambda c: F.array(*[v[r * block + c] for r in range(block)])
    one = lambda r, c: F.array(v[r * block + c])
    end = block - 1
    # (where the strip goes, its place around that block, the strip)
    sent = [
        (-1, -1, one(0, 0)), (-1, 0, row(0)), (-1, 1, one(0, end)), (0, -1, column(0)),
        (0, 1, column(end)), (1, -1, one(end, 0)), (1, 0, row(end)), (1, 1, one(end, end)),
    ]
    strips = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), s.alias("strip")) for dy, dx, s in sent])
    moved = blocks.select(*PLACE, F.explode(strips).alias("s")).select("raster_key", (F.col("by") + F.col("s.dy")).alias("by"), (F.col("bx") + F.col("s.dx")).alias("bx"), "s.dy", "s.dx", "s.strip")
    side = lambda dy, dx: F.first(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col("strip")), True).alias(f"_{dy}_{dx}".replace("-", "m"))
    rim = moved.groupBy(*PLACE).agg(*[side(dy, dx) for dy, dx, _ in sent])
    met = blocks.join(rim, PLACE, "left")
    none = F.array_repeat(F.lit(None).cast("int"), block)
    # a strip that was sent upward comes from the block below
    got = lambda dy, dx: F.coalesce(F.col(f"_{-dy}_{-dx}".replace("-", "m")), none if 0 in (dy, dx) else F.array(F.lit(None).cast("int")))
    middle = [part for r in range(block) for part in (F.array(F.get(got(0, -1), F.lit(r))), row(r), F.array(F.get(got(0, 1), F.lit(r))))]
    top, bottom = F.concat(got(-1, -1), got(-1, 0), got(-1, 1)), F.concat(got(1, -1), got(1, 0), got(1, 1))
    # through a generator, so that the optimiser does not put the whole expression wherever a cell is read
    return met.select(*PLACE, F.explode(F.array(F.concat(top, *middle, bottom))).alias("padded"))


def around(i: Column, block: int, dy: int, dx: int) -> Column:
    """Place in the padded block of the neighbour of cell ``i``."""
    return ((F.floor(i / block) + 1 + dy) * (block + 2) + i % block + 1 + dx).cast("int")


def stencil(padded: DataFrame, block: int, fn: Callable[[Callable[[int, int], Column]], Column]) -> DataFrame:
    """Focal operator: ``fn(at)`` gives the new value of a cell, ``at(dy, dx)`` its neighbours (null beyond the raster).

    Returns ``raster_key, by, bx, values``; cells that the raster lacks stay null.
    """
    p = F.col("padded")

    def cell(i: Column) -> Column:
        at = lambda dy, dx: F.get(p, around(i, block, dy, dx))
        return F.when(at(0, 0).isNotNull(), fn(at))

    return padded.select(*PLACE, F.transform(F.sequence(F.lit(0), F.lit(block * block - 1)), cell).alias("values"))


def neighbor_votes_blocks(regions: DataFrame, padded: DataFrame, registry: DataFrame, block: int) -> DataFrame:
    """A8/O3 on padded blocks: classes around each region, by how often a region pixel touches them.

    The cells of a region are one list per block, so what meets the blocks is a row per
    region and block, not a row per touch.  Blocks of rasters without a region are left
    out before their rims are exchanged.
    """
    cells = regions.select("region_id", "raster_key", block_of("y", block).alias("by"), block_of("x", block).alias("bx"), cell_of(block).alias("cell"))
    lists = Dim(cells.groupBy("region_id", *PLACE).agg(F.collect_list("cell").alias("cells")), name="cells")
    keys = [r["raster_key"] for r in lists.df.select("raster_key").distinct().limit(RASTERS + 1).collect()]
    if len(keys) <= RASTERS:  # else all blocks stay
        padded = padded.filter(F.col("raster_key").isin(keys))
    met = lists.join(padded, PLACE, how="inner", bounded=True)
    # cell by cell, so that generated code does it: a lambda over the list is interpreted
    each = met.select("region_id", "raster_key", "padded", F.explode("cells").alias("_i"))
    touched = F.array(*[F.get("padded", around(F.col("_i"), block, dy, dx)) for dx, dy in OFFSETS_8])
    each = each.select("region_id", "raster_key", F.explode(touched).alias("cluster_id")).filter("cluster_id IS NOT NULL")
    counts = each.groupBy("region_id", "raster_key", "cluster_id").agg(F.count(F.lit(1)).alias("_t"))
    labeled = registry.filter(is_labeled(F.col("classification_path"))).select("raster_key", "cluster_id", F.col("classification_path").alias("path"))
    votes = counts.join(labeled, ["raster_key", "cluster_id"]).groupBy("region_id", "path").agg(F.sum("_t").alias("votes"))
    order = Window.partitionBy("region_id").orderBy(F.desc("votes"), "path")
    return votes.withColumn("rank", F.row_number().over(order))


def majority(padded: DataFrame, block: int, nodata: int = S.NODATA) -> DataFrame:
    """Smoothing by votes of the 3 x 3 cells around each: the most frequent value, the smallest of a tie, nodata aside."""

    def vote(at: Callable[[int, int], Column]) -> Column:
        near = F.array_sort(F.filter(F.array(at(0, 0), *[at(dy, dx) for dx, dy in OFFSETS_8]), lambda v: v.isNotNull() & (v != nodata)))
        # along the sorted values: the run so far, and the longest one
        start = F.struct(F.lit(None).cast("int").alias("v"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("best"), F.lit(0).alias("most"))

        def step(acc: Column, v: Column) -> Column:
            n = F.when(acc["v"] == v, acc["n"] + 1).otherwise(1)
            longer = n > acc["most"]
            return F.struct(v.alias("v"), n.alias("n"), F.when(longer, v).otherwise(acc["best"]).alias("best"), F.when(longer, n).otherwise(acc["most"]).alias("most"))

        return F.when(at(0, 0) == nodata, F.lit(nodata)).otherwise(F.aggregate(near, start, step, lambda acc: acc["best"]))

    return stencil(padded, block, vote)
