"""Components, seeded growth, votes and labelling against plain Python."""

from __future__ import annotations

from collections import deque

import pytest
from pyspark.sql import functions as F
from test_rasters import back, grid

from terragrid import schema as S
from terragrid.operators import overlay, region, registry

SNAKE = [
    [1, 1, 1, 1, 1, 1, 1],
    [0, 0, 0, 0, 0, 0, 1],
    [1, 1, 1, 1, 1, 0, 1],
    [1, 0, 0, 0, 1, 0, 1],
    [1, 0, 1, 1, 1, 0, 1],
    [1, 0, 0, 0, 0, 0, 1],
    [1, 1, 1, 1, 1, 1, 1],
]
MIXED = [[(x * x + 3 * y * x + y * y * y) // 5 % 3 for x in range(13)] for y in range(11)]


def meta(spark, key, g):
    return spark.createDataFrame([(key, len(g[0]), len(g))], "raster_key string, width int, height int")


def bfs(g, x, y, cap, diagonal):
    h, w = len(g), len(g[0])
    if not (0 <= x < w and 0 <= y < h):
        return []
    seen, out, queue = set(), [], deque([(x, y)])
    while queue and len(out) < cap:
        p = queue.popleft()
        if p in seen:
            continue
        seen.add(p)
        if g[p[1]][p[0]] == g[y][x]:
            out.append((p[1], p[0]))
            for dx, dy in region.offsets(diagonal):
                if 0 <= p[0] + dx < w and 0 <= p[1] + dy < h:
                    queue.append((p[0] + dx, p[1] + dy))
    return out


def component_of(g, diagonal):
    h, w = len(g), len(g[0])
    out = [[None] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            if out[y][x] is None:
                for py, px in bfs(g, x, y, h * w, diagonal):
                    out[py][px] = y * w + x
    return out


@pytest.mark.parametrize(
    ("g", "diagonal", "block"), [(SNAKE, True, 2), (SNAKE, False, 3), (MIXED, True, 3), (MIXED, False, 2), (SNAKE, True, 256), (MIXED, False, 256)]
)
def test_components_do_not_depend_on_blocks(spark, g, diagonal, block):
    found = region.components(grid(spark, k=g), meta(spark, "k", g), diagonal, block)
    assert back(found, "component_id") == component_of(g, diagonal)


def test_components_over_a_long_chain(spark):
    g = [[0 if (y % 2 == 0 or x == (39 if y % 4 == 1 else 0)) else 1 + y for x in range(40)] for y in range(40)]
    found = region.components(grid(spark, k=g), meta(spark, "k", g), diagonal=False, block=4)
    assert back(found, "component_id") == component_of(g, False)


SEEDS = [(1, 0, 0), (2, 3, 1), (3, 2, 4), (4, 6, 6), (5, 9, 99), (6, 5, 3)]


@pytest.mark.parametrize(
    ("g", "cap", "windows"),
    [(SNAKE, 10000, (64,)), (SNAKE, 3, (64,)), (SNAKE, 10, (2, 3)), (MIXED, 10, (2, 3)), (MIXED, 1, (64,)), (MIXED, 10000, (64,)), (SNAKE, 10, ()), (MIXED, 10000, ())],
)
def test_growth_order(spark, g, cap, windows):
    seeds = spark.createDataFrame([(i, "k", y, x) for i, x, y in SEEDS], "region_id long, raster_key string, y int, x int")
    for diagonal in (True, False) if cap == 10 else (True,):
        rows = region.grow_regions(seeds, grid(spark, k=g), cap, diagonal, windows, block=3).orderBy("region_id", "rank").collect()
        for i, x, y in SEEDS:
            got = [(r["y"], r["x"]) for r in rows if r["region_id"] == i]
            assert got == bfs(g, x, y, cap, diagonal), (i, diagonal)
            assert [r["rank"] for r in rows if r["region_id"] == i] == list(range(len(got)))


def test_growth_without_a_cap(spark):
    side = 160  # 25,600 pixels: more than capped growth usually keeps
    px = spark.range(side * side).select(
        F.lit("k").alias("raster_key"), F.floor(F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"),
        F.when(F.col("id") == 5, 1).otherwise(0).alias("value"))
    seeds = spark.createDataFrame([(1, "k", 3, 3), (2, "k", 0, 5), (3, "k", 900, 0)], "region_id long, raster_key string, y int, x int")
    sizes = {r["region_id"]: r["count"] for r in region.grow_regions(seeds, px, block=64).groupBy("region_id").count().collect()}
    assert sizes == {1: side * side - 1, 2: 1}


def test_synthetic_ids_end_before_the_fine_grain_range(spark):
    reg = spark.createDataFrame([("synthetic_seg", 49999, "a")], "raster_key string, cluster_id int, classification_path string")
    paths = spark.createDataFrame([("b", 1)], "path string, seq long")
    with pytest.raises(Exception, match="no synthetic id is left"):
        region.synthetic_ids(paths, reg).collect()


def test_votes_count_a_neighbour_once_per_region_pixel(spark):
    px = grid(spark, k=[[0, 0, 0], [2, 1, 2]])
    attrs = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "raster_key string, cluster_id int, path string")
    regions = spark.createDataFrame([(7, "k", 0, x) for x in range(3)], "region_id long, raster_key string, y int, x int")
    got = region.neighbor_votes(regions, S.SegmentedRaster(px, registry.build_registry(px, attrs))).orderBy("rank").collect()
    assert [(r["path"], r["votes"], r["rank"]) for r in got] == [("b", 4, 1), ("a", 3, 2)]


def test_equal_votes_are_ordered_by_path(spark):
    px = grid(spark, k=[[2, 0, 1]])
    attrs = spark.createDataFrame([("k", 1, "b"), ("k", 2, "a")], "raster_key string, cluster_id int, path string")
    regions = spark.createDataFrame([(7, "k", 0, 1)], "region_id long, raster_key string, y int, x int")
    got = region.neighbor_votes(regions, S.SegmentedRaster(px, registry.build_registry(px, attrs))).orderBy("rank").collect()
    assert [r["path"] for r in got] == ["a", "b"]


def test_labelling_recounts(spark):
    base = overlay.synthetic_raster(grid(spark, k=[[0, 0, 0, -1]]), "k")
    regions = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 1), (3, 0, 2)], "region_id long, y int, x int")
    paths = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "a", 3)], "region_id long, path string, seq long")
    once = region.label_regions(regions, paths, base)
    assert back(once.pixels) == [[10000, 10001, 10000, -1]]
    counts = lambda s: {(r["cluster_id"], r["pixel_count"]) for r in s.registry.collect()}
    assert counts(once) == {(9999, 0), (10000, 2), (10001, 1)}
    again = region.label_regions(
        spark.createDataFrame([(9, 0, 0)], "region_id long, y int, x int"),
        spark.createDataFrame([(9, "c", 1)], "region_id long, path string, seq long"), once)
    assert back(again.pixels) == [[10002, 10001, 10000, -1]]
    assert counts(again) == {(9999, 0), (10000, 1), (10001, 1), (10002, 1)}


def test_pick_regions_starts_on_unlabelled_pixels_only(spark):
    g = [[0, 0, 1], [0, 2, 1]]
    px = grid(spark, k=g)
    attrs = spark.createDataFrame([("k", 1, "a")], "raster_key string, cluster_id int, path string")
    m = spark.createDataFrame([("k", 0.0, 2.0, 1.0, 1.0, 3, 2)], "raster_key string, xmin double, ymax double, pixel_width double, pixel_height double, width int, height int")
    pts = spark.createDataFrame([(1, 0.5, 1.5), (2, 2.5, 1.5), (3, 1.5, 0.5), (4, 9.0, 0.5)], "point_id long, lng double, lat double")
    sizes, votes, _ = region.pick_regions(pts, m, S.SegmentedRaster(px, registry.build_registry(px, attrs)))
    assert {(r["region_id"], r["pixel_count"]) for r in sizes.collect()} == {(1, 3), (3, 1)}
    assert {(r["region_id"], r["path"], r["votes"]) for r in votes.collect()} == {(1, "a", 2), (3, "a", 2)}


def test_neighbours_are_clipped(spark):
    px = grid(spark, k=[[0, 1], [2, 3]])
    n = lambda d: region.neighbors(px.select("raster_key", "y", "x"), px, d).count()
    assert n(False) == 8 and n(True) == 12
