"""Growth of regions with a match function, over blocks.

A pixel belongs to a region when the match function holds between the seed's value and
its own and it is reached from the seed through such pixels.  As two seeds judge a pixel
differently, components of the raster do not serve; every region floods on its own.

Each block is flooded alone from the cells where a front enters it; cells that are
reached on its border become fronts in the blocks beside it.  Rounds go on until no
front reaches anything new, so their number is that of the blocks along the longest way.
What was reached is a bit per cell for each region and block.

Regions that are still growing after ``ROUNDS_FLOODED`` rounds are found another way: all
seeds of one value judge pixels alike, so their regions are components of the pixels that
match this value, labelled in squares of blocks and merged over the squares' borders in
rounds that grow with the logarithm only.  Where seeds stand so dense that the rounds left
would flood more blocks than labelling every block for every value takes, this is done at once.

Components are kept as pieces of rows; the result has a row for each cell of each region
that wants a piece, so pieces are dealt over as many tasks as these rows need.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terragrid.operators.region import _contract, _united, offsets
from terragrid.operators.store import PLACE, block_of, cell_of, pack_blocks
from terragrid.plans.sizing import Dim, shuffled, stage, staged_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rounds whose results are kept apart before they are written as one table.
ROUNDS_KEPT = 8
#: Rounds of flooding before regions that still grow are found as components.
ROUNDS_FLOODED = 8
#: Blocks that are labelled in the time in which a region floods one.
LABELLED = 6
#: About the side of the squares of blocks that are labelled as one.
SIDE = 256
#: Cells of a row that a piece of a component has at most.
PIECE = 64
#: Rows of the result that one task makes.
ROWS_A_TASK = 20_000_000
#: Pieces of components: the component's first cell in its square, part of a row, its cells and those on the square's border.
_PIECES = "_key string, node long, y int, _c int, xs array<int>, rim array<int>"
#: A region in one block, and the fronts it sends: a block beside it and the cell where they enter.
_FLOODED = "region_id long, raster_key string, by int, bx int, reached binary, exits array<struct<by:int,bx:int,cell:int>>"


def _flood(fits: np.ndarray, reached: np.ndarray, cells: np.ndarray, side: int, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells newly reached from ``cells`` in one block, front by front; and the cells beyond the block that they touch, as (y, x)."""
    wide = side + 2
    free = np.zeros((wide, wide), bool)
    free[1:-1, 1:-1] = (fits & ~reached).reshape(side, side)
    free = free.ravel()
    rim = np.ones((wide, wide), bool)
    rim[1:-1, 1:-1] = False
    rim = rim.ravel()
    jump = np.array([dy * wide + dx for dx, dy in steps])
    front = (cells // side + 1) * wide + cells % side + 1
    front = np.unique(front[free[front]])
    found, left = [], []
    while len(front):
        free[front] = False
        found.append(front)
        near = (front[:, None] + jump).ravel()
        left.append(near[rim[near]])
        front = np.unique(near[free[near]])
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    new, out = np.concatenate(found), np.unique(np.concatenate(left))
    return (new // wide - 1) * side + new % wide - 1, np.stack([out // wide - 1, out % wide - 1], axis=1)


def grow_regions_matched(
    seeds: DataFrame,
    pixels: DataFrame | None,
    match: Callable[[Column, Column], Column],
    diagonal: bool = True,
    block: int = 64,
    blocks: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """G1 with a match function: ``region_id, raster_key, y, x`` of all pixels that belong to each seed.

    ``match(seed_value, value)`` is a Column; where it is null the pixel does not belong.  A seed
    outside its raster, or one that does not match itself, gives no rows.  ``blocks`` replaces
    ``pixels``: packed blocks, or a reader that is asked for ``raster_key, by, bx`` in each round
    (growth then goes on by rounds, so that only blocks in reach are read).
    """
    if blocks is None:
        blocks = stage(pack_blocks(pixels, block), "blocks")
    read = blocks if callable(blocks) else lambda wanted: blocks
    key = ["region_id", *PLACE]
    start = seeds.select(F.col("region_id").cast("long").alias("region_id"), "raster_key", block_of("y", block).alias("by"), block_of("x", block).alias("bx"), cell_of(block).alias("cell"))
    start = stage(start, "seeds", measure=True)
    at_home = Dim(start, derived=False).join(read(start), PLACE, how="inner", bounded=True)
    valued = at_home.select(*key, "cell", F.get("values", F.col("cell")).alias("seed_value")).filter("region_id IS NOT NULL AND seed_value IS NOT NULL")
    valued = stage(valued, "seeds", measure=True)
    fronts = valued.select(*key, F.array("cell").alias("cells"))
    seed_values = Dim(valued.select("region_id", "seed_value"), derived=False)
    steps = list(offsets(diagonal))
    to_label = 0 if callable(blocks) else _blocks_to_label(valued, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for region, raster, by, bx, before, cells, fits in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6), strict=True):
                fits = np.asarray(fits.values.to_numpy(zero_copy_only=False), bool)
                reached = np.unpackbits(np.frombuffer(before, np.uint8), count=len(fits)).astype(bool) if before else np.zeros(len(fits), bool)
                new, out = _flood(fits, reached, np.array(cells), block, steps)
                if not len(new):
                    continue
                reached[new] = True
                y, x = out[:, 0], out[:, 1]
                exits = zip((by + y // block).tolist(), (bx + x // block).tolist(), (y % block * block + x % block).tolist(), strict=True)
                rows.append((region, raster, by, bx, np.packbits(reached).tobytes(), [{"by": a, "bx": b, "cell": c} for a, b, c in exits]))
            names = ("region_id", "raster_key", "by", "bx", "reached", "exits")
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("by", pa.int32()), ("bx", pa.int32()), ("cell", pa.int32())])))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    fits = F.transform("values", lambda v: F.coalesce(match(F.col("seed_value"), v), F.lit(False)))
    n_rounds = 0
    rounds: list[DataFrame] = []  # of each round the regions and blocks that grew, as they are then; the latest counts
    while True:
        fronts = stage(fronts, "fronts", measure=True)
        left = ROUNDS_FLOODED - n_rounds
        if not staged_rows(fronts) or (not callable(blocks) and (left <= 0 or to_label <= LABELLED * left * staged_rows(fronts))):
            break
        n_rounds += 1
        near = seed_values.join(Dim(fronts, derived=False).join(read(fronts), PLACE, how="inner", bounded=True), ["region_id"], how="inner", spread=PLACE)
        before = near.join(_latest(rounds, key), key, "left") if rounds else near.withColumn("reached", F.lit(None).cast("binary"))
        grown = stage(before.select(*key, "reached", "cells", fits.alias("fits")).mapInArrow(run, _FLOODED), "flooded")
        rounds.append(grown.select(*key, "reached"))
        if len(rounds) > ROUNDS_KEPT:
            rounds = [stage(_latest(rounds, key), "reached")]
        out = grown.select("region_id", "raster_key", F.explode("exits").alias("e")).filter("e.by >= 0 AND e.bx >= 0")
        fronts = out.groupBy("region_id", "raster_key", F.col("e.by").alias("by"), F.col("e.bx").alias("bx")).agg(F.collect_set("e.cell").alias("cells"))
    if not staged_rows(fronts):
        if not rounds:
            return fronts.select("region_id", "raster_key", F.lit(0).alias("y"), F.lit(0).alias("x"))
        return _flooded_cells(_latest(rounds, key), block)
    if not rounds:
        return _matched_components(valued, blocks, match, diagonal, block)
    growing = Dim(fronts.select("region_id").distinct())
    done = growing.join(_latest(rounds, key), ["region_id"], how="left_anti", spread=PLACE)
    seeds_left = growing.join(valued, ["region_id"], how="left_semi")
    return _flooded_cells(done, block).unionByName(_matched_components(seeds_left, blocks, match, diagonal, block))


def _cell_place(block: int, cell: str) -> tuple[Column, Column]:
    """y and x of a cell of a block."""
    return (F.col("by") * block + F.floor(F.col(cell) / block)).cast("int"), (F.col("bx") * block + F.col(cell) % block).cast("int")


def _flooded_cells(state: DataFrame, block: int) -> DataFrame:
    """``region_id, raster_key, y, x`` of what regions have reached in their blocks."""
    cells = state.select("region_id", *PLACE, F.explode(_set_bits("reached", block * block)).alias("_i"))
    y, x = _cell_place(block, "_i")
    return cells.select("region_id", "raster_key", y.alias("y"), x.alias("x"))


def _blocks_to_label(seeds: DataFrame, blocks: DataFrame) -> int:
    """Blocks of each raster, once for every value of a seed in it."""
    values = seeds.groupBy("raster_key").agg(F.count_distinct("seed_value").alias("_n"))
    of_raster = blocks.groupBy("raster_key").agg(F.count(F.lit(1)).alias("_blocks"))
    return values.join(of_raster, "raster_key").agg(F.sum(F.col("_n") * F.col("_blocks")).alias("n")).first()["n"] or 0


def _roots(fits: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set cells of a grid in row order as y, x, and for each the place in this order of its component's first cell.

    Runs of a row are joined with those of the row above.
    """
    wide = fits.shape[1] + 2
    padded = np.zeros((fits.shape[0] + 2, wide), bool)
    padded[1:-1, 1:-1] = fits
    at = np.flatnonzero(padded)
    first = np.flatnonzero(~padded.ravel()[at - 1])
    run = np.zeros(padded.size, np.int64)
    begins = np.zeros(len(at), np.int64)
    begins[first] = 1
    run[at] = np.cumsum(begins) - 1
    a, b = [], []
    for dx, dy in steps:
        if dy < 0:
            above = at + dy * wide + dx
            hit = padded.ravel()[above]
            a.append(run[at[hit]])
            b.append(run[above[hit]])
    root = _united(np.concatenate(a), np.concatenate(b), len(first))
    y, x = np.divmod(at, wide)
    return y - 1, x - 1, first[root[run[at]]]


def _label(batches: Iterator[pa.RecordBatch], block: int, side: int, steps: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Pieces of the components of each square; a row holds the blocks of one square."""
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    for batch in batches:
        squares = batch.column(1)
        rows, cols, bits = (squares.values.field(i) for i in range(3))
        rows, cols, ends, starts = (c.to_numpy() for c in (rows, cols, squares.offsets, bits.offsets))
        for i, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            by, bx = rows[low:high].astype(np.int64), cols[low:high].astype(np.int64)
            top, west = by.min(), bx.min()
            grid = np.zeros((by.max() - top + 1, bx.max() - west + 1, block, block), bool)
            grid[by - top, bx - west] = bits.values.slice(starts[low], starts[high] - starts[low]).to_numpy(zero_copy_only=False).reshape(-1, block, block)
            y, x, first = _roots(grid.swapaxes(1, 2).reshape(grid.shape[0] * block, -1), steps)
            if not len(y):
                continue
            y, x = y + top * block, x + west * block
            node = (y[first] << 32) + x[first]
            order = np.argsort(first, kind="stable")
            y, x, node, part = y[order], x[order], node[order], x[order] // PIECE
            new = np.ones(len(y), bool)
            new[1:] = (node[1:] != node[:-1]) | (y[1:] != y[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(new)
            cut = np.append(at, len(y))
            rim = (y % side == side - 1) | (x % side == side - 1) | (y % side == 0) & (y > 0) | (x % side == 0) & (x > 0)
            xs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32()))
            on_rim = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rim))[cut], pa.int32()), pa.array(x[rim], pa.int32()))
            columns = (pa.repeat(batch.column(0)[i], len(at)), pa.array(node[at]), pa.array(y[at], pa.int32()), pa.array(part[at], pa.int32()), xs, on_rim)
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=["_key", "node", "y", "_c", "xs", "rim"])


def _matched_components(seeds: DataFrame, blocks: DataFrame, match: Callable[[Column, Column], Column], diagonal: bool, block: int) -> DataFrame:
    """Regions of ``seeds`` (region_id, place, cell, seed_value) as components of the pixels that match each value.

    A raster's pixels are taken once for every value of a seed in it; the value and the
    raster stand for the raster's key in the labelling.
    """
    steps, wide = list(offsets(diagonal)), max(1, SIDE // block)
    side = wide * block
    of_value = F.concat_ws(":", F.col("seed_value").cast("string"), "raster_key").alias("_key")
    values = Dim(seeds.select("raster_key", "seed_value").distinct().select("*", of_value))
    fits = F.transform("values", lambda v: F.coalesce(match(F.col("seed_value"), v), F.lit(False)))
    square = ["_key", F.floor(F.col("by") / wide).alias("_sy"), F.floor(F.col("bx") / wide).alias("_sx")]
    asked = values.join(blocks, ["raster_key"], how="inner", spread=["by", "bx"]).select(*square, F.struct("by", "bx", fits.alias("fits")).alias("_b"))
    place = ["_key", "_sy", "_sx"]
    n_cores = asked.sparkSession.sparkContext.defaultParallelism
    # labelling is much work for few bytes
    dealt = asked.repartition(4 * n_cores, *place)
    squares = dealt.groupBy(*place).agg(F.collect_list("_b").alias("_blocks")).select("_key", "_blocks")
    pieces = stage(squares.mapInArrow(lambda batches: _label(batches, block, side, steps), _PIECES), "pieces")
    # half of the offsets: each pair of cells is met once
    half = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps if dy > 0 or (dy == 0 and dx > 0)])
    rim = pieces.filter(F.size("rim") > 0).select("_key", "node", "y", F.explode("rim").alias("x"))
    out = rim.select("_key", F.col("node").alias("a"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(half).alias("_o"))
    out = out.withColumn("y", F.col("_y") + F.col("_o.dy")).withColumn("x", F.col("_x") + F.col("_o.dx"))
    leaves = (F.floor(F.col("y") / side) != F.floor(F.col("_y") / side)) | (F.floor(F.col("x") / side) != F.floor(F.col("_x") / side))
    met = out.filter(leaves).join(shuffled(rim.withColumnRenamed("node", "b")), ["_key", "y", "x"])
    named = Dim(_contract(met.select("_key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "_key"))
    component = F.coalesce("root", "node").alias("component")
    y, x = _cell_place(block, "cell")
    starts = Dim(seeds.select("region_id", "raster_key", of_value, y.alias("y"), x.alias("_x"), F.floor(x / PIECE).cast("int").alias("_c")))
    # a row of a square has at most SIDE pieces
    of_seed = starts.join(pieces, ["_key", "y", "_c"], how="inner", bounded=True).filter(F.array_contains("xs", F.col("_x")))
    of_seed = named.join(of_seed, ["_key", "node"], bounded=True).select("region_id", "raster_key", "_key", component).distinct()
    of_seed = Dim(of_seed)
    wanted = Dim(of_seed.df.groupBy("_key", "component").agg(F.count(F.lit(1)).alias("_regions")))
    parts = named.join(pieces, ["_key", "node"], bounded=True).select("_key", component, "y", "_c", "xs")
    parts = stage(wanted.join(parts, ["_key", "component"], how="inner", spread=["y", "_c"]), "parts")
    n_rows = parts.agg(F.sum(F.size("xs") * F.col("_regions")).alias("n")).first()["n"] or 0
    n_tasks = max(n_cores, 1 + n_rows // ROWS_A_TASK)
    dealt = parts.drop("_regions").repartition(n_tasks, "_key", "component", "y", "_c")
    # a component may be wanted by many seeds and hold most pixels
    joined = of_seed.join(dealt, ["_key", "component"], how="inner", spread=["y", "_c"]).select("region_id", "raster_key", "y", "xs")
    # coalesce keeps join and explode apart: compiled as one they hold all rows of a piece, of every region, at once
    return joined.coalesce(n_tasks).select("region_id", "raster_key", "y", F.explode("xs").alias("x"))


def _latest(rounds: list[DataFrame], key: list[str]) -> DataFrame:
    """What each region has reached in each block, of tables in the order of their rounds."""
    every = [r.withColumn("_n", F.lit(i)) for i, r in enumerate(rounds)]
    return reduce(DataFrame.unionByName, every).groupBy(*key).agg(F.max_by("reached", "_n").alias("reached"))


def _set_bits(column: str, n: int) -> Column:
    """Places of the set bits of a binary column, first bit first."""

    @F.pandas_udf("array<int>")
    def places(data: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), count=n)).astype(np.int32) for b in data])

    return places(column)
