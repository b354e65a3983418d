"""The ways taken beyond the size limits give the same rows as the small ones."""

from __future__ import annotations

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from terragrid.plans import sizing

SF = "/root/testdata/sf0.001"
NAMES = (
    "lookup_clusters remap_ids aggregate_by_key composite composite_registry classification_raster pixel_mapping interactive "
    "zonal_intersection sample_points neighbor_votes components_4 grow_regions label_regions spread_sample tile_audit "
    "merge_first merge_last synthetic_ids composite_inputs nearest_centroid filter_clusters mosaic"
).split()


@pytest.fixture
def tiny_limits(monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_MAX_ROWS", 0)
    monkeypatch.setattr(sizing, "SINGLE_TASK_ROWS", 0)
    monkeypatch.setattr(sizing, "SALTS", 3)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_beyond_limits(spark, con, tiny_limits, name):
    ok, text = compare(spark, con, SF, name, queries()[name], oracle_sql()[name])
    assert ok, text


def test_number_rows_over_many_tasks(spark, tiny_limits):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 3).cast("string").alias("g"))
    flat = sizing.number_rows(df, [F.desc("v")], "n", start=10).orderBy("n").collect()
    assert [r["n"] for r in flat] == list(range(10, 5010))
    assert [r["v"] for r in flat] == sorted((r["v"] for r in flat), reverse=True)
    grouped = sizing.number_rows(df, ["v"], "n", within=["g"]).orderBy("g", "v").collect()
    seen = {}
    for r in grouped:
        assert r["n"] == seen.get(r["g"], 0)
        seen[r["g"]] = r["n"] + 1


def test_salted_join_splits_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(sizing, "SALTS", 8)
    big = spark.range(4000).select(F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    dim = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    out = sizing.salted_join(big, dim, ["k"])
    assert out.count() == 4000 and out.filter("w <> k * 2").count() == 0
    parts = out.filter("k = 1").groupBy(F.spark_partition_id()).count()
    plan = out._jdf.queryExecution().toString()
    assert "_salt" in plan and parts.count() >= 1


def test_scratch_dir_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Context:
        applicationId = "app"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        sizing.scratch_dir(Session())


def test_staged_size_is_known_without_another_job(spark):
    t = sizing.stage(spark.range(10).select("id", F.lit("ab").alias("s")), measure=True)
    assert sizing._measured[t] == (10, 10 * (16 + 8 + 2))
    assert sizing.staged_rows(t) == 10 and sizing.is_small(t)
