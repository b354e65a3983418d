"""Contiguous regions: neighbours, components, seeded growth, votes, labelling."""

from __future__ import annotations

from functools import reduce
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions.ids import is_labeled, is_synthetic
from terragrid.operators.hierarchy import path_colors
from terragrid.operators.registry import area_ha, count_pixels
from terragrid.plans import sizing
from terragrid.plans.sizing import Dim, number_rows, salted_join, shuffled, stage, staged_rows

# executors get the two helpers below by value and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Neighbour offsets (dx, dy) in visiting order.
OFFSETS_8 = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
OFFSETS_4 = ((0, -1), (-1, 0), (1, 0), (0, 1))

# The size at which capped growth usually stops.
MAX_REGION = S.SYNTHETIC_START
# Half widths of the windows in which the first pixels of a capped region are
# looked for, before the window that holds them for certain.
WINDOWS = (64, 512)


def offsets(diagonal: bool) -> tuple:
    return OFFSETS_8 if diagonal else OFFSETS_4


def offset_array(diagonal: bool) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
            for i, (dx, dy) in enumerate(offsets(diagonal))
        ]
    )


def neighbors(cells: DataFrame, pixels: DataFrame, diagonal: bool = False) -> DataFrame:
    """The neighbours that exist of each ``(raster_key, y, x)`` with their values."""
    spread = cells.select("*", F.explode(offset_array(diagonal)).alias("_o"))
    moved = spread.select(
        *cells.columns, F.col("_o.i").alias("offset"),
        (F.col("y") + F.col("_o.dy")).alias("ny"), (F.col("x") + F.col("_o.dx")).alias("nx"),
    )
    around = pixels.select(
        "raster_key", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("value").alias("neighbor_value")
    )
    return moved.join(shuffled(around), ["raster_key", "ny", "nx"])


def neighbor_votes(regions: DataFrame, seg: S.SegmentedRaster) -> DataFrame:
    """Classes around each region, by how often a region pixel touches them.

    ``regions`` has ``region_id, raster_key, y, x``.  Touches are counted per
    neighbour cell before the join with the pixels, and per cluster before the
    class lookup, so both joins see reduced input.
    """
    spread = regions.select("region_id", "raster_key", "y", "x", F.explode(offset_array(True)).alias("_o"))
    touches = spread.groupBy(
        "region_id", "raster_key", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")
    ).agg(F.count(F.lit(1)).alias("_t"))
    # few touched cells are sent to the pixels, which then need no shuffle
    per_cluster = (
        Dim(touches)
        .join(seg.pixels, ["raster_key", "y", "x"], how="inner", bounded=True)
        .groupBy("region_id", "raster_key", F.col("value").alias("cluster_id"))
        .agg(F.sum("_t").alias("_t"))
    )
    labeled = seg.registry.filter(is_labeled(F.col("classification_path"))).select(
        "raster_key", "cluster_id", F.col("classification_path").alias("path")
    )
    votes = per_cluster.join(labeled, ["raster_key", "cluster_id"]).groupBy("region_id", "path").agg(F.sum("_t").alias("votes"))
    order = Window.partitionBy("region_id").orderBy(F.desc("votes"), "path")
    return votes.withColumn("rank", F.row_number().over(order))


# --- connected components ------------------------------------------------------------


def _pack(y: Column, x: Column) -> Column:
    return F.shiftleft(y.cast("long"), 32).bitwiseOR(x.cast("long"))


def _label_block(pdf: pd.DataFrame, diagonal: bool) -> pd.DataFrame:
    """Components inside one block: each pixel gets the position of the first pixel of its own."""
    y, x, v = (pdf[c].to_numpy().astype(np.int64) for c in ("y", "x", "value"))
    y0, x0 = y.min(), x.min()
    h, w = int(y.max() - y0 + 1), int(x.max() - x0 + 1)
    slot = np.full((h + 2, w + 2), -1, dtype=np.int64)
    order = np.lexsort((x, y))
    y, x, v = y[order], x[order], v[order]
    n = len(v)
    slot[y - y0 + 1, x - x0 + 1] = np.arange(n)
    us, vs = [], []
    for dx, dy in offsets(diagonal)[: len(offsets(diagonal)) // 2]:
        other = slot[y - y0 + 1 + dy, x - x0 + 1 + dx]
        hit = np.flatnonzero(other >= 0)
        hit = hit[v[hit] == v[other[hit]]]
        us.append(hit)
        vs.append(other[hit])
    a, b = np.concatenate(us), np.concatenate(vs)
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    node = (y[root] << 32) | x[root]
    return pd.DataFrame(
        {"raster_key": pdf["raster_key"].iloc[0], "y": y.astype("int32"), "x": x.astype("int32"), "value": v.astype("int32"), "node": node}
    )


def _united(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The first node of the component of each of ``n`` nodes, by edges from ``a`` to ``b``.

    In each round a root hangs below the earliest that an edge joins it with; all others below what they hang on.
    """
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _unite(pdf: pd.DataFrame, key: str) -> pd.DataFrame:
    """Root of every node of the edges of one key."""
    nodes, at = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    root = _united(at[::2], at[1::2], len(nodes))
    return pd.DataFrame({key: pdf[key].iloc[0], "node": nodes, "rep": nodes[root]})


def _contract(edges: DataFrame, key: str) -> DataFrame:
    """Root of every node that has an edge: ``key, node, root``.

    Each round every node joins the neighbour (or itself) with the smallest
    hash, and edges are rewritten to the joined nodes.  The hash changes per
    round, so chains shrink by a constant share and the number of rounds grows
    with the logarithm of the longest chain.  A node with very many edges is
    pre-aggregated before its shuffle and salted in the joins.  Each round is
    written to the scratch folder, which cuts the lineage.  Edges that are few
    enough for one task, at first or after some rounds, are united at once.
    """
    edges = stage(edges, "edges")
    rounds: list[DataFrame] = []
    while staged_rows(edges):
        if staged_rows(edges) <= sizing.SINGLE_TASK_ROWS:
            rounds.append(stage(edges.groupBy(key).applyInPandas(lambda pdf: _unite(pdf, key), f"{key} string, node long, rep long"), "reps"))
            break
        h = lambda c: F.xxhash64(F.col(c), F.lit(len(rounds)))  # noqa: B023, E731
        both = edges.select(key, "a", "b").unionByName(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(key, "a").agg(F.min_by("b", h("b")).alias("_n"))
        joined = F.when(h("_n") < h("a"), F.col("_n")).otherwise(F.col("a"))
        reps = stage(best.select(key, F.col("a").alias("node"), joined.alias("rep")), "reps")
        rounds.append(reps)
        left = salted_join(edges, reps.select(key, F.col("node").alias("a"), F.col("rep").alias("ra")), [key, "a"], "inner", ["b"])
        right = salted_join(left, reps.select(key, F.col("node").alias("b"), F.col("rep").alias("rb")), [key, "b"], "inner", ["a"])
        edges = stage(
            right.filter("ra <> rb").select(key, F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if not rounds:
        return edges.select(key, F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[-1].select(key, "node", F.col("rep").alias("root"))
    for reps in reversed(rounds[:-1]):
        higher = found.select(key, F.col("node").alias("rep"), "root")
        merged = salted_join(reps, higher, [key, "rep"], "left", ["node"])
        found = stage(merged.select(key, "node", F.coalesce("root", "rep").alias("root")), "roots")
    return found


def _components(pixels: DataFrame, diagonal: bool, block: int) -> DataFrame:
    """Pixels with ``node``, the packed position of the first pixel of their component."""
    cells = pixels.select(
        "raster_key", "y", "x", "value",
        F.floor(F.col("y") / block).cast("int").alias("_by"), F.floor(F.col("x") / block).cast("int").alias("_bx"),
    )
    local = cells.groupBy("raster_key", "_by", "_bx").applyInPandas(
        lambda pdf: _label_block(pdf, diagonal), "raster_key string, y int, x int, value int, node long"
    )
    local = stage(local, "local")
    py, px = F.col("y") % block, F.col("x") % block
    rim = local.filter((py == 0) | (py == block - 1) | (px == 0) | (px == block - 1))
    # half of the offsets: each pair of cells is met once
    half = [(dx, dy) for dx, dy in offsets(diagonal) if dy > 0 or (dy == 0 and dx > 0)]
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in half])
    out = rim.select("raster_key", "y", "x", "value", "node", F.explode(steps).alias("_o")).select(
        "raster_key", "value", F.col("node").alias("a"), F.col("y").alias("_y"), F.col("x").alias("_x"),
        (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"),
    )
    leaves = (F.floor(F.col("y") / block) != F.floor(F.col("_y") / block)) | (
        F.floor(F.col("x") / block) != F.floor(F.col("_x") / block)
    )
    met = out.filter(leaves).join(
        shuffled(rim.select("raster_key", "y", "x", "value", F.col("node").alias("b"))), ["raster_key", "y", "x", "value"]
    )
    edges = met.select("raster_key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = _contract(edges, "raster_key")
    firsts = roots.groupBy("raster_key", "root").agg(F.min("node").alias("first"))
    named = salted_join(roots, firsts, ["raster_key", "root"], "inner", ["node"]).select("raster_key", "node", "first")
    # a node has at most block * block pixels, so no salt is needed
    joined = Dim(named).join(local, ["raster_key", "node"], bounded=True)
    return joined.select("raster_key", "y", "x", "value", F.coalesce("first", "node").alias("node"))


def components(pixels: DataFrame, meta: DataFrame, diagonal: bool = True, block: int = 256) -> DataFrame:
    """Component of equal value of every pixel, id = smallest ``y * width + x``.

    Blocks are labelled on their own, then joined across block borders.
    """
    found = _components(pixels, diagonal, block)
    widths = Dim(meta.select("raster_key", "width"), derived=False)
    wide = widths.join(found, ["raster_key"])
    first_y, first_x = F.shiftright("node", 32), F.col("node").bitwiseAND(F.lit((1 << 32) - 1))
    return wide.select("raster_key", "y", "x", "value", (first_y * F.col("width") + first_x).alias("component_id"))


def component_sizes(found: DataFrame) -> DataFrame:
    """Pixels per component."""
    return found.groupBy("raster_key", "component_id", "value").agg(F.count(F.lit(1)).alias("pixel_count"))


# --- seeded growth ------------------------------------------------------------------------


def _ranks_of_region(pdf: pd.DataFrame, radius: int, cap: int, diagonal: bool) -> pd.DataFrame:
    """The first ``cap`` pixels of one region in breadth-first order, a front at a time.

    The group holds the pixels of the seed's component in its window.  A front
    is an array of positions in visiting order; its neighbours, in the order
    (place in the front, offset), become the next front at their first mention.
    One row of rank -1 says that a front came to the border of the window.
    """
    sy, sx = int(pdf["sy"].iloc[0]), int(pdf["sx"].iloc[0])
    side = 2 * radius + 1
    open_ = np.zeros((side + 2) * (side + 2), dtype=bool)  # a rim of closed cells around the window
    at = lambda y, x: (y - sy + radius + 1) * (side + 2) + (x - sx + radius + 1)
    open_[at(pdf["y"].to_numpy("int64"), pdf["x"].to_numpy("int64"))] = True
    steps = np.array([dy * (side + 2) + dx for dx, dy in offsets(diagonal)])
    front = np.array([at(sy, sx)])
    open_[front] = False
    region, n, cut = [front], 1, False
    while n < cap and len(front):
        row, col = np.divmod(front, side + 2)
        if ((row == 1) | (row == side) | (col == 1) | (col == side)).any():
            cut = True
            break
        near = (front[:, None] + steps).ravel()
        near = near[open_[near]]
        _, first = np.unique(near, return_index=True)
        front = near[np.sort(first)]
        open_[front] = False
        region.append(front)
        n += len(front)
    cells = np.concatenate(region)[:1 if cut else cap]
    y, x = np.divmod(cells, side + 2)
    return pd.DataFrame(
        {
            "region_id": pdf["region_id"].iloc[0], "raster_key": pdf["raster_key"].iloc[0],
            "y": (y - 1 - radius + sy).astype("int32"), "x": (x - 1 - radius + sx).astype("int32"),
            "rank": np.full(1, -1, "int32") if cut else np.arange(len(cells), dtype="int32"),
        }
    )


_RANKED = "region_id long, raster_key string, y int, x int, rank int"


def _rank_in_windows(seeds: DataFrame, cells: DataFrame, radius: int, cap: int, diagonal: bool) -> DataFrame:
    """One window per seed, bounded by its area; only pixels of the seed's own component enter it.

    Pixels carry their block, so a seed meets the blocks of its window, not the whole component.
    """
    size = 2 * radius
    block = lambda c: F.floor(c / size).cast("int")
    around = lambda c: F.sequence(block(F.col(c) - radius), block(F.col(c) + radius))
    want = seeds.withColumn("_by", F.explode(around("sy"))).withColumn("_bx", F.explode(around("sx")))
    placed = cells.withColumn("_by", block(F.col("y"))).withColumn("_bx", block(F.col("x")))
    near = placed.join(want, ["raster_key", "node", "_by", "_bx"]).filter(
        (F.abs(F.col("y") - F.col("sy")) <= radius) & (F.abs(F.col("x") - F.col("sx")) <= radius)
    )
    return near.select("region_id", "raster_key", "sy", "sx", "y", "x").groupBy("region_id").applyInPandas(
        lambda pdf: _ranks_of_region(pdf, radius, cap, diagonal), _RANKED
    )


def grow_regions(
    seeds: DataFrame, pixels: DataFrame, max_pixels: int | None = None, diagonal: bool = True, windows: tuple = WINDOWS, block: int = 256
) -> DataFrame:
    """Region of equal value around each seed: ``region_id, raster_key, y, x, rank``.

    ``seeds`` has ``region_id, raster_key, y, x``; a seed outside the raster
    gives no rows.  A region is the seed's connected component (G2), found over
    the classes that hold a seed, so it has no size limit; ``rank`` is null then.
    With ``max_pixels`` growth stops after that many pixels in breadth-first
    order, ``rank`` from 0: they are at most that far away, so a window of this
    radius holds them; smaller windows are tried first.
    """
    start = seeds.select(F.col("region_id").cast("long").alias("region_id"), "raster_key", "y", "x")
    here = stage(Dim(start).join(pixels, ["raster_key", "y", "x"], how="inner", bounded=True).select("region_id", "raster_key", "y", "x", "value"), "seeds")
    classes = Dim(here.select("raster_key", "value").distinct(), derived=False)
    asked = classes.join(pixels.select("raster_key", "y", "x", "value"), ["raster_key", "value"], how="left_semi")
    found = stage(_components(asked.select("raster_key", "y", "x", "value"), diagonal, block), "components")
    of_seed = here.join(found, ["raster_key", "y", "x", "value"]).select(
        "region_id", "raster_key", "node", F.col("y").alias("sy"), F.col("x").alias("sx")
    )
    of_seed = stage(of_seed, "seeds")
    if max_pixels is None:
        # a component may be wanted by many seeds and hold most pixels: small seeds are sent to the pixels, else salted
        out = Dim(of_seed, derived=False).join(found, ["raster_key", "node"], how="inner", spread=["y", "x"])
        return out.select("region_id", "raster_key", "y", "x", F.lit(None).cast("int").alias("rank"))
    nodes = Dim(of_seed.select("raster_key", "node").distinct(), derived=False)
    cells = nodes.join(found, ["raster_key", "node"], how="left_semi").select("raster_key", "node", "y", "x")
    done, left = [], of_seed
    for radius in [w for w in windows if w < max_pixels] + [max_pixels]:
        ranked = stage(_rank_in_windows(left, cells, radius, max_pixels, diagonal), "ranked")
        done.append(ranked.filter("rank >= 0"))
        left = stage(left.join(ranked.filter("rank < 0").select("region_id"), "region_id", "left_semi"), "seeds")
        if not staged_rows(left):
            break
    return reduce(DataFrame.unionByName, done)


# --- labelling ----------------------------------------------------------------------------


def synthetic_ids(paths: DataFrame, registry: DataFrame) -> DataFrame:
    """Synthetic id of each class path: the one in use, else the next free ones.

    ``paths`` has ``path, seq``; new ids follow the first ``seq`` of a path.
    """
    firsts = paths.groupBy("path").agg(F.min("seq").alias("_seq"))
    used = registry.groupBy(F.col("classification_path").alias("path")).agg(F.min("cluster_id").alias("synthetic_id"))
    known = firsts.join(used, "path").select("path", "synthetic_id")
    top = registry.agg(F.max(F.when(is_synthetic(F.col("cluster_id")), F.col("cluster_id"))).alias("m")).first()["m"]
    start = S.SYNTHETIC_START if top is None else top + 1
    new = number_rows(firsts.join(used, "path", "left_anti"), ["_seq", "path"], "synthetic_id", start=start)
    full = F.raise_error(F.lit(f"no synthetic id is left below {S.FINE_GRAIN_START}")).cast("int")
    checked = F.when(F.col("synthetic_id") < S.FINE_GRAIN_START, F.col("synthetic_id")).otherwise(full)
    return known.unionByName(new.select("path", checked.alias("synthetic_id")))


def fill_region(pixels: DataFrame, region: DataFrame, value: int) -> DataFrame:
    """Write one value into the cells ``(raster_key, y, x)`` of a region."""
    marks = region.select("raster_key", "y", "x", F.lit(True).alias("_in")).distinct()
    joined = Dim(marks).join(pixels, ["raster_key", "y", "x"], bounded=True)
    return joined.select(
        "raster_key", "y", "x", F.when(F.col("_in"), F.lit(value)).otherwise(F.col("value")).alias("value")
    )


def label_regions(
    regions: DataFrame,
    paths: DataFrame,
    synthetic: S.SegmentedRaster,
    colors: DataFrame | None = None,
    level: int | None = None,
) -> S.SegmentedRaster:
    """Write regions into the synthetic raster as classes; the later label wins.

    ``regions`` has ``region_id, y, x``, ``paths`` has ``region_id, path, seq``.
    Counts are taken from the resulting pixels, so relabelled pixels leave their
    old class.
    """
    ids = stage(synthetic_ids(paths, synthetic.registry), "synthetic_ids")
    labels = paths.join(ids, "path").select("region_id", "seq", "synthetic_id")
    marks = Dim(labels).join(regions.select("region_id", "y", "x"), ["region_id"], how="inner")
    newest = marks.groupBy("y", "x").agg(F.max_by("synthetic_id", "seq").alias("_new"))
    pixels = Dim(newest).join(synthetic.pixels, ["y", "x"], bounded=True).select(
        "raster_key", "y", "x", F.coalesce("_new", "value").alias("value")
    )
    added = ids.select("synthetic_id", "path")
    if colors is not None:
        shade = path_colors(added.select("path"), colors, level=level).select("path", "css")
        added = added.join(shade, "path", "left")
    else:
        added = added.withColumn("css", F.lit(None).cast("string"))
    old = synthetic.registry.select("raster_key", "cluster_id", "classification_path", "color")
    new = added.join(old.select(F.col("cluster_id").alias("synthetic_id")), "synthetic_id", "left_anti")
    new = new.select(
        F.lit(S.SYNTHETIC_KEY).alias("raster_key"), F.col("synthetic_id").alias("cluster_id"),
        F.col("path").alias("classification_path"), F.col("css").alias("color"),
    )
    counts = count_pixels(pixels)
    registry = old.unionByName(new).join(counts, ["raster_key", "cluster_id"], "left")
    n = F.coalesce("pixel_count", F.lit(0))
    registry = registry.select(
        "raster_key", "cluster_id", n.alias("pixel_count"), "classification_path", "color", area_ha(n).alias("area_ha")
    )
    return S.SegmentedRaster(pixels, registry, synthetic.meta)


def pick_regions(
    points: DataFrame, meta: DataFrame, seg: S.SegmentedRaster, max_pixels: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points -> unlabelled pixels (F8) -> regions -> sizes and suggestions.

    Returns region sizes ``(region_id, raster_key, pixel_count)``, ranked
    suggestions and the region pixels.
    """
    from terragrid.operators.zonal import sample_points

    hit = sample_points(points, meta, seg).filter(F.col("cluster_id").isNotNull() & ~is_labeled(F.col("path")))
    seeds = hit.select(F.col("point_id").alias("region_id"), "raster_key", "y", "x")
    regions = stage(grow_regions(seeds, seg.pixels, max_pixels), "regions")
    sizes = regions.groupBy("region_id", "raster_key").agg(F.count(F.lit(1)).alias("pixel_count"))
    return sizes, neighbor_votes(regions, seg), regions
