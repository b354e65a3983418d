"""Tables that files underrate, heavy rows in few files, regions that cross many blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terragrid.operators import blocks, growth, hierarchy, region, resample, zonal
from terragrid.plans import sizing
from terragrid.sources import manifest


@pytest.fixture
def px(spark, tmp_path):
    """Pixels behind a generator, over a file of one row."""
    path = str(tmp_path / "one.parquet")
    spark.range(1).write.parquet(path)
    cells = spark.read.parquet(path).select(F.explode(F.sequence(F.lit(0), F.lit(199))).alias("i"))
    return cells.select(F.lit("k").alias("raster_key"), F.floor(F.col("i") / 10).cast("int").alias("y"), (F.col("i") % 10).cast("int").alias("x"), (F.col("i") % 3).cast("int").alias("value"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_pixels_are_not_broadcast(spark, px):
    near = region.neighbors(px.select("raster_key", "y", "x"), px)
    assert "Broadcast" not in plan(near) and near.count() == 2 * (2 * 20 * 10 - 20 - 10)
    kept = resample.clip(px, px.filter("y < 4").select("y", "x", "value"))
    assert "Broadcast" not in plan(kept) and kept.count() == 40


def test_salted_tables_are_not_broadcast(spark, px, monkeypatch):
    joined = sizing.salted_join(px, px.select("y", "x", F.col("value").alias("v")), ["y", "x"], "inner", ["value"])
    assert "Broadcast" not in plan(joined) and joined.count() == 200
    monkeypatch.setattr(sizing, "BROADCAST_MAX_ROWS", 0)
    dim = sizing.Dim(px.select("y", "x", F.col("value").alias("v")))
    met = dim.join(px, ["y", "x"], how="inner", bounded=True)
    assert "Broadcast" not in plan(met) and met.count() == 200


def test_burnt_pixels_are_not_broadcast(spark):
    ring = [(0.0, 4.0), (3.0, 4.0), (3.0, 1.0), (0.0, 1.0), (0.0, 4.0)]
    features = spark.createDataFrame([(1, [[{"lng": a, "lat": b} for a, b in ring]])], "feature_id int, rings array<array<struct<lng:double,lat:double>>>")
    grid = spark.createDataFrame([("k", 0.0, 4.0, 1.0, 1.0, 5, 4)], "raster_key string, xmin double, ymax double, pixel_width double, pixel_height double, width int, height int")
    filled = zonal.rasterize(features, grid, fill=True)
    assert "Broadcast" not in plan(filled)
    assert sorted((r["y"], r["x"]) for r in filled.collect() if r["feature_id"]) == [(y, x) for y in range(3) for x in range(3)] and filled.count() == 20


def test_documents_are_dealt_over_tasks(spark):
    docs = spark.range(40).coalesce(1).select("id", F.lit('{"a":{"b":{}},"c":{}}').alias("hierarchy"))
    flat = hierarchy.flatten_hierarchy(docs)
    assert flat.rdd.getNumPartitions() > 8 and flat.count() == 120
    bad = manifest.manifest_violations(docs.select("id", F.lit("{nope").alias("manifest")))
    assert bad.rdd.getNumPartitions() > 8 and bad.count() == 40 and bad.columns == ["id", "message"]


@pytest.mark.parametrize(("batch", "block"), [(3, 4), (7, 3), (1000, 16)])
def test_blocks_that_span_batches(spark, px, batch, block):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        packed = blocks.blocks_from_pixels(px.unionByName(px.withColumn("raster_key", F.lit("other"))).filter("y <> 5"), block)
        rows = packed.collect()
        back = blocks.pixels_from_blocks(packed, block).filter("value <> -1").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == len({(r["raster_key"], r["by"], r["bx"]) for r in rows}) and {len(r["values"]) for r in rows} == {block * block}
    assert sorted(map(tuple, back)) == sorted((k, y, x, (10 * y + x) % 3) for k in ("k", "other") for y in range(20) if y != 5 for x in range(10))


@pytest.mark.parametrize("diagonal", [True, False])
def test_long_regions_need_few_rounds(spark, monkeypatch, diagonal):
    """A strip over 20 blocks beside a short one; seeds of different values judge it differently."""
    cells = [("k", y, x, (1 if x == 0 else 9 if x == 1 else 2 if y < 3 else 0 if y % 2 else 5)) for y in range(40) for x in range(4)]
    px = spark.createDataFrame(cells, "raster_key string, y int, x int, value int")
    seeds = spark.createDataFrame([(1, "k", 0, 0), (2, "k", 20, 0), (3, "k", 1, 2), (4, "k", 0, 1), (5, "k", 900, 0)], "region_id int, raster_key string, y int, x int")
    monkeypatch.setattr(growth, "ROUNDS_FLOODED", 2)
    asked = []
    flood = growth.stage
    monkeypatch.setattr(growth, "stage", lambda df, name="stage", measure=False: asked.append(name) or flood(df, name, measure))
    got = growth.grow_regions_matched(seeds, px, lambda seed, v: F.abs(v - seed) <= 1, diagonal, 2)
    cells = {i: set() for i in range(1, 6)}
    for r in got.collect():
        assert (r["y"], r["x"]) not in cells[r["region_id"]]
        cells[r["region_id"]].add((r["y"], r["x"]))
    strip = {(y, 0) for y in range(40)}
    assert cells[1] == cells[2] == strip
    assert cells[3] == {(y, x) for y in range(3) for x in (2, 3)} and cells[4] == {(y, 1) for y in range(40)} and cells[5] == set()
    assert asked.count("flooded") == 2
