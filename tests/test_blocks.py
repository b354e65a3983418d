"""Growth with a match function, halos, the block store and its summaries against plain Python."""

from __future__ import annotations

import re
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F
from test_rasters import back, grid
from test_regions import MIXED, SNAKE

from terragrid import schema as S
from terragrid.operators import blocks, growth, halo, region, registry, store, zonal
from terragrid.plans import sizing

RAMP = [[(x + 2 * y) // 3 for x in range(19)] for y in range(14)]
HOLES = [[-1 if (x + y) % 5 == 0 else x // 4 + y // 6 for x in range(17)] for y in range(9)]


def grown(g, x, y, match, diagonal):
    h, w = len(g), len(g[0])
    if not (0 <= x < w and 0 <= y < h) or not match(g[y][x], g[y][x]):
        return set()
    seen, queue = {(y, x)}, deque([(y, x)])
    while queue:
        cy, cx = queue.popleft()
        for dx, dy in region.offsets(diagonal):
            n = cy + dy, cx + dx
            if 0 <= n[0] < h and 0 <= n[1] < w and n not in seen and match(g[y][x], g[n[0]][n[1]]):
                seen.add(n)
                queue.append(n)
    return seen


@pytest.mark.parametrize(("g", "diagonal", "block"), [(SNAKE, False, 2), (SNAKE, True, 3), (MIXED, True, 4), (MIXED, False, 3), (RAMP, True, 5), (HOLES, False, 64)])
def test_growth_with_a_tolerance(spark, g, diagonal, block):
    """One match function, seeds that judge the same pixels differently, one of them outside."""
    places = [(0, 0), (3, 2), (5, 5), (len(g[0]) - 1, len(g) - 1), (99, 0)]
    seeds = spark.createDataFrame([(i, "k", y, x) for i, (x, y) in enumerate(places)], "region_id int, raster_key string, y int, x int")
    px = grid(spark, k=g, other=[[0] * 30] * 30)
    got = {}
    for r in growth.grow_regions_matched(seeds, px, lambda seed, v: F.abs(v - seed) <= 1, diagonal, block).collect():
        got.setdefault(r["region_id"], []).append((r["y"], r["x"]))
    want = {i: grown(g, x, y, lambda a, b: abs(a - b) <= 1, diagonal) for i, (x, y) in enumerate(places)}
    assert {i: set(c) for i, c in got.items()} == {i: c for i, c in want.items() if c}
    assert all(len(c) == len(set(c)) for c in got.values())


@pytest.mark.parametrize(("g", "diagonal", "block", "few"), [(SNAKE, False, 2, 0), (SNAKE, True, 1, 100_000), (RAMP, True, 3, 0), (HOLES, True, 4, 100_000), (HOLES, False, 2, 100_000)])
def test_dense_seeds_are_labelled_at_once(spark, monkeypatch, g, diagonal, block, few):
    """Seeds at every third pixel need no rounds; components cross squares and rows cross pieces, and tasks follow the rows of the result."""
    for name, n in (("SIDE", 4), ("PIECE", 3), ("ROWS_A_TASK", 50), ("LABELLED", 1_000)):
        monkeypatch.setattr(growth, name, n)
    monkeypatch.setattr(sizing, "SINGLE_TASK_ROWS", few)
    asked, kept = [], growth.stage
    monkeypatch.setattr(growth, "stage", lambda df, name="stage", measure=False: asked.append(name) or kept(df, name, measure))
    places = [(i, i % len(g[0]), i // len(g[0])) for i in range(0, len(g) * len(g[0]), 3)]
    rows = [(i, "k", y, x) for i, x, y in [*places, *places[:5]]] + [(-1, "k", 900, 0), (None, "k", 0, 0)]  # some twice, one outside, one without an id
    seeds = spark.createDataFrame(rows, "region_id int, raster_key string, y int, x int")
    got = growth.grow_regions_matched(seeds, grid(spark, k=g, other=g), lambda seed, v: F.abs(v - seed) <= 1, diagonal, block)
    want = [(i, "k", *c) for i, x, y in places for c in grown(g, x, y, lambda a, b: abs(a - b) <= 1, diagonal)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "flooded" not in asked and got.rdd.getNumPartitions() >= 1 + len(want) // 50


def test_growth_of_equal_values_is_a_component_and_odd_matches(spark, monkeypatch):
    monkeypatch.setattr(growth, "ROUNDS_KEPT", 2)
    seeds = spark.createDataFrame([(7, "k", 0, 0), (8, "k", 2, 2)], "region_id int, raster_key string, y int, x int")
    px = grid(spark, k=SNAKE)
    same = growth.grow_regions_matched(seeds, px, lambda seed, v: v == seed, block=2)
    assert {tuple(r) for r in same.collect()} == {tuple(r)[:4] for r in region.grow_regions(seeds, px).collect()}
    never = growth.grow_regions_matched(seeds, px, lambda seed, v: v > seed, block=2)  # a seed does not match itself
    assert never.collect() == [] and never.columns == same.columns
    null = growth.grow_regions_matched(seeds, px, lambda seed, v: F.lit(None).cast("boolean"), block=2)
    assert null.collect() == []
    assert growth.grow_regions_matched(seeds.limit(0), px, lambda seed, v: v == seed).collect() == []


def test_few_edges_are_united_at_once(spark, monkeypatch):
    """A star, a chain against the order of its nodes, and the same nodes under another key; as by rounds."""
    pairs = [("k", 500, i) for i in range(300)] + [("k", 1000 + 7 * i % 400, 1000 + 7 * (i + 1) % 400) for i in range(390)] + [("other", 3, 1), ("other", 500, 4)]
    edges = spark.createDataFrame([(k, min(a, b), max(a, b)) for k, a, b in pairs], "raster_key string, a long, b long")
    parts = {}
    for few in (0, 100, 100_000):
        monkeypatch.setattr(sizing, "SINGLE_TASK_ROWS", few)
        found = {}
        for r in region._contract(edges, "raster_key").collect():
            found.setdefault((r["raster_key"], r["root"]), set()).add(r["node"])
        parts[few] = sorted((k, sorted(nodes)) for (k, _), nodes in found.items())
    assert parts[0] == parts[100] == parts[100_000] and len(parts[0]) == 4


def test_packing_by_built_in_functions(spark):
    px = grid(spark, k=MIXED).filter("y <> 3 AND NOT (y = 5 AND x = 5)")
    packed = store.pack_blocks(px, 4)
    assert {(r["by"], r["bx"]): len(r["values"]) for r in packed.collect()} == {(by, bx): 16 for by in range(3) for bx in range(4)}
    again = blocks.pixels_from_blocks(packed, 4).filter("value IS NOT NULL")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in px.collect()}


@pytest.mark.parametrize("block", [1, 3, 4, 16])
def test_halo_and_stencils(spark, block):
    padded = halo.with_halo(store.pack_blocks(grid(spark, k=MIXED), block), block)
    total = halo.stencil(padded, block, lambda at: sum((F.coalesce(at(dy, dx), F.lit(0)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)), F.lit(0)))
    h, w = len(MIXED), len(MIXED[0])
    near = lambda y, x: [MIXED[b][a] for b in range(max(0, y - 1), min(h, y + 2)) for a in range(max(0, x - 1), min(w, x + 2))]
    assert back(blocks.pixels_from_blocks(total, block).filter("value IS NOT NULL")) == [[sum(near(y, x)) for x in range(w)] for y in range(h)]
    best = lambda values: min(Counter(values).items(), key=lambda e: (-e[1], e[0]))[0]
    smooth = blocks.pixels_from_blocks(halo.majority(padded, block), block).filter("value IS NOT NULL")
    assert back(smooth) == [[best(near(y, x)) for x in range(w)] for y in range(h)]


def test_votes_equal_those_of_pixels(spark):
    px = grid(spark, k=MIXED)
    reg = registry.build_registry(px, lambda c: (F.when(c < 2, F.concat(F.lit("c"), c.cast("string"))), F.lit(None).cast("string")))
    cells = px.filter("value = 1 OR y > 7").select((F.col("x") % 3).cast("long").alias("region_id"), "raster_key", "y", "x")
    want = region.neighbor_votes(cells, S.SegmentedRaster(px, reg))
    got = halo.neighbor_votes_blocks(cells, halo.with_halo(store.pack_blocks(px, 4), 4), reg, 4)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(*got.columns).collect()} != set()


def test_votes_leave_out_rasters_without_a_region_and_pack_each_map_once(spark):
    px = grid(spark, k=MIXED, other=MIXED, third=MIXED)
    reg = registry.build_registry(px, lambda c: (F.concat(F.lit("c"), c.cast("string")), F.lit(None).cast("string")))
    cells = px.filter("raster_key <> 'third' AND y > 3").select((F.col("x") % 3).cast("long").alias("region_id"), "raster_key", "y", "x")
    cells = cells.unionByName(cells.limit(5))  # repeated cells count again
    votes = halo.neighbor_votes_blocks(cells, halo.with_halo(store.pack_blocks(px, 4), 4), reg, 4)
    want = region.neighbor_votes(cells, S.SegmentedRaster(px, reg)).select(*votes.columns)
    assert {tuple(r) for r in votes.collect()} == {tuple(r) for r in want.collect()} != set()
    plan = votes._jdf.queryExecution().optimizedPlan().toString()
    assert "raster_key" in plan and " IN (" in plan and "third" not in plan.split(" IN (")[1].split(")")[0]
    assert not re.search(r"lambdafunction\([^\n]*map_from_entries", store.pack_blocks(px, 4)._jdf.queryExecution().optimizedPlan().toString())
    none = halo.neighbor_votes_blocks(cells.limit(0), halo.with_halo(store.pack_blocks(px, 4), 4), reg, 4)
    assert none.collect() == [] and none.columns == votes.columns


def test_z_order_is_the_interleaved_bits(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (5, 9), (2**30 - 1, 2**30 - 1), (123456, 654321)], "y int, x int")
    plain = lambda y, x: sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(30))
    assert all(r["z"] == plain(r["y"], r["x"]) for r in df.withColumn("z", store.z_order(F.col("y"), F.col("x"))).collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    big = [[(x // 7 + y // 5) % 6 for x in range(64)] for y in range(64)]
    px = grid(spark, a=big, b=big[:20])
    path = str(tmp_path_factory.mktemp("store") / "s")
    store.write_store(store.pack_blocks(px, 4), path, 16)
    return px, path


def test_only_files_with_wanted_blocks_are_read(spark, stored):
    px, path = stored
    every = spark.read.parquet(f"{path}/blocks").inputFiles()
    corner = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 99, 99)], "raster_key string, by int, bx int")
    files = store.files_with(spark, path, corner)
    assert len(every) > 8 and len(files) == 1
    got = store.read_store(spark, path, corner)
    assert {(r["raster_key"], r["by"], r["bx"]) for r in got.collect()} == {("a", 0, 0), ("a", 1, 1)}
    assert store.read_store(spark, path, corner.filter("by > 50")).collect() == []
    assert store.read_store(spark, path).count() == 256 + 80
    # growth opens what its fronts reach
    asked = []
    read = lambda wanted: asked.append(wanted) or store.read_store(spark, path, wanted)
    seeds = spark.createDataFrame([(1, "a", 1, 1)], "region_id int, raster_key string, y int, x int")
    cells = growth.grow_regions_matched(seeds, None, lambda seed, v: v == seed, diagonal=False, block=4, blocks=read)
    want = region.grow_regions(seeds, px, diagonal=False)
    assert {tuple(r) for r in cells.collect()} == {tuple(r)[:4] for r in want.collect()} and len(asked) > 1


def test_points_from_the_store(spark, stored):
    px, path = stored
    meta = spark.createDataFrame(
        [(k, 1, 0.0, 64.0 - h, 64.0, 64.0, 1.0, 1.0, 64, h, -1, 4326) for k, h in (("a", 64), ("b", 20))], S.RASTER_META
    )
    reg = registry.build_registry(px)
    points = spark.createDataFrame([(1, 3.5, 60.5), (2, 63.5, 0.5), (3, 70.0, 3.0), (4, 3.5, 60.5)], "point_id int, lng double, lat double")
    want = zonal.sample_points(points, meta, S.SegmentedRaster(px, reg, meta)).collect()
    got = store.sample_points_stored(points, meta, reg, path, 4).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 8
    one = store.sample_points_stored(points.withColumn("raster_key", F.lit("b")), meta, reg, path, 4).collect()
    assert sorted(map(str, one)) == sorted(str(r) for r in want if r["raster_key"] == "b")


def test_zones_from_summaries_leave_inner_blocks_unread(spark, stored):
    px, path = stored
    meta = spark.createDataFrame([("a", 1, 0.0, 0.0, 64.0, 64.0, 1.0, 1.0, 64, 64, -1, 4326)], S.RASTER_META)
    px = px.filter("raster_key = 'a'")
    ring = lambda *c: [[{"lng": float(a), "lat": float(b)} for a, b in c]]
    shapes = [
        (1, ring((1.2, 62.9), (50.7, 62.9), (50.7, 10.1), (1.2, 10.1))), (2, ring((20.2, 40.2), (60.3, 44.2), (40.3, 2.2))),
        (3, ring((16.0, 48.0), (32.0, 48.0), (32.0, 32.0), (16.0, 32.0))), (4, ring((90, 3), (95, 3), (95, 9))),
    ]
    features = spark.createDataFrame(shapes, "feature_id int, rings array<array<struct<lng:double,lat:double>>>")
    counts, asked = store.pyramid(store.pack_blocks(px, 4), 4), []

    def read(wanted):
        asked.extend((r["by"], r["bx"]) for r in wanted.collect())
        return store.read_store(spark, path, wanted)

    got = store.zonal_intersection_stored(features, meta, counts, read, 4, 4, min_pct=1.0)
    want = zonal.zonal_intersection(px, zonal.burn(features, meta), 1.0)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(*got.columns).collect()}
    burnt = {(r["y"], r["x"]): r["feature_id"] for r in zonal.rasterize(features, meta).collect()}
    of = lambda by, bx: {burnt.get((by * 4 + i, bx * 4 + j)) for i in range(4) for j in range(4)}
    assert asked and all(len(of(*b)) > 1 for b in asked)  # blocks of one feature are never asked for
    cover, border = store.zone_cover(features, meta, 4, 4)
    places = cover.collect()
    assert {r["level"] for r in places} >= {0, 1, 2} and border.count() == len(asked)
