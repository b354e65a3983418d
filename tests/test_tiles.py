"""Tile arithmetic, mosaics, resampling and the up-sampling audit."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rasters import back, grid

from terragrid.functions import geo as G
from terragrid.operators import resample, tiles

PX = "z int, x int, y int, py int, px int, r int, g int, b int"


# tile numbers of places as published map services show them: lon, lat, z, x, y
PLACES = [(-0.1278, 51.5074, 10, 511, 340), (13.405, 52.52, 10, 550, 335), (0.0, 0.0, 1, 1, 1), (-180.0, 85.0, 3, 0, 0), (179.9, -85.0, 3, 7, 7)]


def tile_column(df):
    return df.select("*", G.lonlat_to_tile(F.col("lon"), F.col("lat"), F.col("z")).alias("t"))


def test_tiles_of_known_places(spark):
    rows = tile_column(spark.createDataFrame(PLACES, "lon double, lat double, z int, x int, y int")).collect()
    assert [(r["t"]["x"], r["t"]["y"]) for r in rows] == [(r["x"], r["y"]) for r in rows]


def test_places_lie_in_their_tiles(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-180, 180), rng.uniform(-85, 85), rng.randint(0, 19)) for _ in range(300)]
    t = tile_column(spark.createDataFrame(rows, "lon double, lat double, z int"))
    corners = t.select(
        "lon", "lat", G.tile_origin(F.col("t.x"), F.col("t.y"), F.col("z")).alias("a"), G.tile_origin(F.col("t.x") + 1, F.col("t.y") + 1, F.col("z")).alias("b"))
    east = F.radians("lon") * G.MERCATOR_RADIUS
    north = G.mercator_y(F.col("lat")) * G.MERCATOR_RADIUS
    inside = (east >= F.col("a.west") - 0.01) & (east <= F.col("b.west") + 0.01) & (north <= F.col("a.north") + 0.01) & (north >= F.col("b.north") - 0.01)
    assert corners.filter(~inside).count() == 0


def test_poles_and_borders_are_clipped(spark):
    rows = [(a, b, z) for a in (-180.0, 180.0) for b in (-90.0, -85.06, 85.06, 90.0) for z in (0, 1, 19)]
    for r in tile_column(spark.createDataFrame(rows, "lon double, lat double, z int")).collect():
        last = 2 ** r["z"] - 1
        assert (r["t"]["x"], r["t"]["y"]) == (0 if r["lon"] < 0 else last, 0 if r["lat"] > 0 else last), r


def test_box_inside_one_tile(spark):
    areas = spark.createDataFrame([(1, -0.128, 51.507, -0.127, 51.508)], "id int, west double, south double, east double, north double")
    assert [(r["x"], r["y"]) for r in G.tiles_for_bbox(areas, 10).collect()] == [(511, 340)]


def test_origin_returns_to_its_tile(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    o = df.select("x", "y", G.tile_origin(F.col("x"), F.col("y"), 3).alias("o"))
    lng = F.degrees((F.col("o.west") + 1) / G.MERCATOR_RADIUS)
    lat = F.degrees(F.atan(F.sinh((F.col("o.north") - 1) / G.MERCATOR_RADIUS)))
    assert o.select("x", "y", G.lonlat_to_tile(lng, lat, 3).alias("t")).filter("t.x <> x OR t.y <> y").count() == 0


def test_points_and_pixels(spark):
    m = spark.range(40).selectExpr("id AS x", "id % 7 AS y", "10.0 AS xmin", "5.0 AS ymax", "0.25D AS pixel_width", "0.5D AS pixel_height", "40 AS width", "7 AS height")
    c = m.select("*", G.pixel_to_latlng(F.col("y"), F.col("x")).alias("c"))
    p = c.select("x", "y", G.latlng_to_pixel(F.col("c.lat"), F.col("c.lng")).alias("p"))
    assert p.filter("p.x <> x OR p.y <> y OR p IS NULL").count() == 0
    out = m.limit(1).select(G.latlng_to_pixel(F.lit(5.1), F.lit(10.0)).alias("a"), G.latlng_to_pixel(F.lit(5.0), F.lit(20.0)).alias("b"), G.latlng_to_pixel(F.lit(5.0), F.lit(10.0)).alias("c"))
    assert tuple(out.first()) == (None, None, (0, 0))


def cubic(a, n):
    """Doubling of one axis: 8 bit in, 8 bit out, taps renormalised at the edges."""
    def w(t):
        t = abs(t)
        return (1.5 * t - 2.5) * t * t + 1 if t < 1 else -0.5 * (((t - 5) * t + 8) * t - 4) if t < 2 else 0.0

    out = []
    for i in range(2 * n):
        c = (i + 0.5) / 2
        taps = [(j, w(j + 0.5 - c)) for j in range(max(0, int(c - 1.5) if c > 1.5 else 0), min(n, int(c + 2.5)))]
        total = sum(k for _, k in taps)
        out.append(math.floor(min(255, max(0, sum(a[j] * k for j, k in taps) / total)) + 0.5))
    return out


def test_upsampling_matches_a_direct_computation(spark):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (6, 6))
    px = spark.createDataFrame([(0, y, x, int(img[y, x])) for y in range(6) for x in range(6)], "t int, py int, px int, v int")
    up = tiles.upsample_quadrant(px, 6, ["t"], ["v"]).collect()
    wide = np.array([cubic(row, 6) for row in img])
    want = np.array([cubic(col, 6) for col in wide.T]).T
    got = np.zeros((12, 12), int)
    for r in up:
        got[r["py"], r["px"]] = r["v"]
    # renormalised weights at the rim are fixed-point numbers: ties may fall the other way
    assert len(up) == 144 and (got == want)[4:-4, 4:-4].all() and np.abs(got - want).max() <= 1


def scene(spark, size, fakes):
    """4 x 4 children of ``size`` pixels with noise, their parents, some children made from parents."""
    rng = np.random.default_rng(7)
    full = rng.integers(0, 256, (4 * size, 4 * size, 3))
    half = full.reshape(2 * size, 2, 2 * size, 2, 3).mean(axis=(1, 3)).round().astype(int)
    rows = []
    for ty in range(4):
        for tx in range(4):
            t = full[ty * size:(ty + 1) * size, tx * size:(tx + 1) * size]
            if (tx, ty) in fakes:
                q = half[ty * size // 2:(ty + 1) * size // 2, tx * size // 2:(tx + 1) * size // 2]
                n = size // 2
                t = np.stack([np.array([cubic(c, n) for c in np.array([cubic(r, n) for r in q[:, :, b]]).T]).T for b in range(3)], axis=2)
            rows += [(9, tx, ty, y, x, *map(int, t[y, x])) for y in range(size) for x in range(size)]
    for ty in range(2):
        for tx in range(2):
            t = half[ty * size:(ty + 1) * size, tx * size:(tx + 1) * size]
            rows += [(8, tx, ty, y, x, *map(int, t[y, x])) for y in range(size) for x in range(size)]
    return spark.createDataFrame(rows, PX)


def test_audit_finds_injected_parents(spark):
    fakes = {(x, y) for x in range(4) for y in range(3)}  # twelve
    audit = tiles.tile_audit(scene(spark, 16, fakes), 9, tile_size=16).cache()
    rows = audit.collect()
    assert {(r["x"], r["y"]) for r in rows if r["suspect"]} == fakes and len(rows) == 16
    assert all(r["detail_ratio"] < 1.25 and r["mae"] < 1 for r in rows if r["suspect"])
    s = tiles.audit_summary(audit).first()
    assert s["bad"] and s["n_suspect"] == 12
    assert [r["x"] for r in tiles.suspect_tiles(audit, 2).collect()] == [0, 0]


def test_audit_passes_real_tiles_and_skips_orphans(spark):
    px = scene(spark, 8, set()).filter("NOT (z = 8 AND x = 1 AND y = 1)")
    s = tiles.audit_summary(tiles.tile_audit(px, 9, tile_size=8)).first()
    assert not s["bad"] and s["n_suspect"] == 0 and s["n_tiles"] == 12


def test_flat_parent_gives_an_infinite_ratio(spark):
    rows = [(1, 0, 0, y, x, (x * y) % 9, 0, 0) for y in range(8) for x in range(8)] + [(0, 0, 0, y, x, 5, 5, 5) for y in range(8) for x in range(8)]
    r = tiles.tile_audit(spark.createDataFrame(rows, PX), 1, tile_size=8).first()
    assert math.isinf(r["detail_ratio"]) and not r["suspect"]


def test_bilinear_keeps_a_plane(spark):
    src = {"west": 8900000.0, "north": 1300000.0, "resolution": 100.0, "width": 20, "height": 15}
    px = spark.createDataFrame([(y, x, 3.0 * x + 10) for y in range(15) for x in range(20)], "y int, x int, v double")
    dst = resample.target_grid(src)
    assert abs(dst["width"] - 20) <= 1 and abs(dst["height"] - 15) <= 1
    out = resample.reproject(px, src, dst).collect()
    assert len(out) >= 0.9 * dst["width"] * dst["height"]
    for r in out:
        lng = dst["xmin"] + (r["x"] + 0.5) * dst["pixel"]
        sx = (math.radians(lng) * G.MERCATOR_RADIUS - src["west"]) / 100.0 - 0.5
        assert abs(r["v"] - (3.0 * min(19, max(0, sx)) + 10)) < 1e-6


@pytest.mark.parametrize("finer", [0.3, 1.0, 2.7])
def test_bilinear_equals_plain_python_and_shuffles_source_pixels_only(spark, finer):
    """Rows may be missing, null or repeated (the largest counts); the target may be finer or coarser, and reach beyond the source."""
    src = {"west": 8900000.0, "north": 1300000.0, "resolution": 1000.0, "width": 37, "height": 41}
    rows = [(y, x, (7 * x + 13 * y * y) % 101 if (x + y) % 9 else None) for y in range(41) for x in range(37) if (x * y) % 11 != 5]
    rows += [(5, 5, 1000), (5, 5, -3), (None, 4, 9), (4, None, 9)]
    dst = resample.target_grid(src)
    dst = {"xmin": dst["xmin"] - 0.02, "ymax": dst["ymax"] + 0.03, "pixel": dst["pixel"] * finer, "width": int(dst["width"] / finer) + 9, "height": int(dst["height"] / finer) + 9}
    out = resample.reproject(spark.createDataFrame(rows, "y int, x int, v int"), src, dst)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    held = {}
    for y, x, v in rows:
        if None not in (y, x, v):
            held[y, x] = max(v, held.get((y, x), v))
    want = {}
    for y in range(dst["height"]):
        for x in range(dst["width"]):
            sx = (math.radians(dst["xmin"] + (x + 0.5) * dst["pixel"]) * G.MERCATOR_RADIUS - src["west"]) / 1000.0 - 0.5
            sy = (src["north"] - math.asinh(math.tan(math.radians(dst["ymax"] - (y + 0.5) * dst["pixel"]))) * G.MERCATOR_RADIUS) / 1000.0 - 0.5
            r, c = math.floor(sy), math.floor(sx)
            taps = [(abs(1 - dy - (sy - r)) * abs(1 - dx - (sx - c)), held.get((r + dy, c + dx))) for dy in (0, 1) for dx in (0, 1)]
            total = sum(w for w, v in taps if v is not None)
            if total > 0:
                want[y, x] = sum(w * v for w, v in taps if v is not None) / total
    got = {(r["y"], r["x"]): r["v"] for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-6) for k in want)


def test_mosaics(spark):
    px = spark.createDataFrame([("b", 0, 0, 1), ("a", 0, 0, -1), ("c", 0, 0, 3), ("a", 0, 1, 7), ("c", 0, 1, 9)], "source string, y int, x int, value int")
    got = lambda df: {(r["y"], r["x"]): r["value"] for r in df.collect()}
    assert got(resample.merge_first(px)) == {(0, 0): 1, (0, 1): 7}
    assert got(resample.merge_first(px, last=True)) == {(0, 0): 3, (0, 1): 9}


def test_coarsen(spark):
    px = grid(spark, k=[[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [-1, 13, 14, 15]])
    assert back(resample.coarsen(px, 2)) == [[5, 7], [13, 15]]
    assert back(resample.coarsen(px, 2, "mean"))[1][0] == 10.0
    ragged = grid(spark, k=[[5 * y + x for x in range(5)] for y in range(5)])
    assert back(resample.coarsen(ragged, 4)) == [[12, 14], [22, 24]]
    with pytest.raises(ValueError):
        resample.coarsen(px, 2, "mode")


def test_spread_sample_takes_a_stride(spark):
    t = spark.range(23).select(F.lit(5).alias("z"), F.floor(F.col("id") / 5).cast("int").alias("x"), (F.col("id") % 5).cast("int").alias("y"))
    got = tiles.spread_sample(t, 10).orderBy("x", "y").collect()
    assert [r["x"] * 5 + r["y"] for r in got] == list(range(0, 20, 2))


def test_bounds_need_features_or_configuration(spark):
    none = spark.createDataFrame([], "feature_id int, rings array<array<struct<lng:double,lat:double>>>")
    assert tuple(tiles.feature_bounds(none, (1, 2, 3, 4)).first()) == (1.0, 2.0, 3.0, 4.0)
    with pytest.raises(Exception, match="neither features nor bounds"):
        tiles.feature_bounds(none).collect()
