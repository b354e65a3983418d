"""K-means over pixel embeddings, centroid assignment and cluster colours."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.plans.sizing import BROADCAST_MAX_BYTES, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def is_valid_embedding(e: Column) -> Column:
    """No missing and no NaN component."""
    return e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v))


def flatten_bands(bands: DataFrame, n_bands: int) -> DataFrame:
    """A multi-band raster ``(vec_id, band, value)`` as one embedding per pixel.

    Bands count from 0; a band without a value is NaN.  A group has one row per band.
    """
    entry = F.map_from_entries(F.collect_list(F.struct("band", "value")))
    packed = bands.groupBy("vec_id").agg(entry.alias("_m"))
    value = lambda i: F.coalesce(F.col("_m")[i], F.lit(float("nan"))).cast("float")
    return packed.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), value).alias("embedding"))


def valid_count(embeddings: DataFrame) -> DataFrame:
    """All and valid embeddings."""
    ok = is_valid_embedding(F.col("embedding"))
    return embeddings.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_valid"))


def kmeans_range(
    embeddings: DataFrame, k_values: Sequence[int], sample: float = 0.25, seed: int = 42, id_col: str = "vec_id"
) -> tuple[DataFrame, DataFrame]:
    """K1: one clustering per k, fitted on a sample, for all embeddings.

    Returns assignments ``(raster_key, id, cluster_id)`` with nodata for invalid
    embeddings, and centroids ``(raster_key, cluster_id, centroid)``.  The sample
    is staged once for all fits; all models run over the embeddings in one pass.
    """
    if not k_values or min(k_values) < 2:
        raise ValueError("k_values must hold numbers of at least 2")
    ok = is_valid_embedding(F.col("embedding"))
    valid = embeddings.filter(ok)
    # drawn by a hash of the id, so the fit doesn't depend on files or partitions
    share = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) < int(sample * (1 << 20))
    drawn = valid.filter(share) if sample < 1 else valid
    train = stage(drawn.select(id_col, "embedding"), "train").select(array_to_vector("embedding").alias("features"))
    scored = embeddings.filter(ok).select(id_col, array_to_vector("embedding").alias("features"))
    centers = []
    for k in k_values:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol=f"_k{k}").fit(train)
        scored = model.transform(scored)
        centers += [(f"k{k}", i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    each = lambda value: F.array(
        *[F.struct(F.lit(f"k{k}").alias("raster_key"), value(k).alias("cluster_id")) for k in k_values]
    )
    hits = scored.select(id_col, F.explode(each(lambda k: F.col(f"_k{k}"))).alias("a"))
    misses = embeddings.filter(~ok).select(id_col, F.explode(each(lambda k: F.lit(S.NODATA))).alias("a"))
    found = hits.unionByName(misses).select("a.raster_key", id_col, F.col("a.cluster_id").cast("int").alias("cluster_id"))
    table = embeddings.sparkSession.createDataFrame(centers, "raster_key string, cluster_id int, centroid array<double>")
    return found, table


def nearest_centroid(embeddings: DataFrame, centroids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """K2: closest centroid of each embedding by squared distance, ties to the smaller id.

    ``centroids`` has ``cluster_id, centroid``; they are sent to the tasks after
    their size is checked, in several parts when they exceed the limit.
    Embeddings stay where they are: no shuffle.
    """
    spark = embeddings.sparkSession
    dim = centroids.select(F.size("centroid").alias("d")).first()
    if dim is None:
        raise ValueError("no centroids given")
    per_part = max(1, BROADCAST_MAX_BYTES // (8 * dim["d"]))
    n = centroids.count()
    parts = -(-n // per_part)
    best = None
    for i in range(parts):
        rows = centroids if parts == 1 else centroids.filter(F.pmod(F.xxhash64("cluster_id"), F.lit(parts)) == i)
        got = rows.orderBy("cluster_id").select("cluster_id", "centroid").collect()
        if not got:
            continue
        shared = spark.sparkContext.broadcast(
            (np.array([r["cluster_id"] for r in got], "int32"), np.array([r["centroid"] for r in got], "float64"))
        )
        cand = _closest(shared)(F.col("embedding"))
        best = cand if best is None else F.least(best, cand)
    ok = is_valid_embedding(F.col("embedding"))
    hit = embeddings.withColumn("_b", F.when(ok, best))
    return hit.select(id_col, F.coalesce("_b.cluster_id", F.lit(S.NODATA)).alias("cluster_id"), F.col("_b.dist").alias("dist"))


def _closest(shared):
    @F.pandas_udf("dist double, cluster_id int")
    def closest(e: pd.Series) -> pd.DataFrame:
        ids, centers = shared.value
        dist = np.full(len(e), np.nan)
        best = np.full(len(e), S.NODATA, "int32")
        usable = np.array([v is not None for v in e], dtype=bool)
        if usable.any():
            x = np.stack([np.asarray(v, "float64") for v in e[usable]])
            # |x - c|^2 but for |x|^2, as one product; the distance itself is taken from the winner
            near = ((centers**2).sum(axis=1) - 2 * (x @ centers.T)).argmin(axis=1)
            dist[usable], best[usable] = ((x - centers[near]) ** 2).sum(axis=1), ids[near]
        return pd.DataFrame({"dist": dist, "cluster_id": best})

    return closest


def hsl_channel(h: Column, s: Column, lightness: Column, n: int) -> Column:
    """One RGB channel (n = 0, 8, 4 for red, green, blue) of a colour in 0..255."""
    k = (F.lit(n) + h / 30.0) % 12.0
    a = s * F.least(lightness, 1 - lightness)
    v = lightness - a * F.greatest(F.lit(-1.0), F.least(k - 3.0, 9.0 - k, F.lit(1.0)))
    return F.floor(v * 255 + 0.5).cast("int")


def cluster_palette(centroids: DataFrame, families: int, seed: int = 42) -> DataFrame:
    """K3: colours where similar clusters share a hue.

    Centroids of one raster are grouped into families; a family is a hue, the
    rank inside it a lightness.  Output ``raster_key, cluster_id, family, r, g, b``.
    """
    if families < 2:
        raise ValueError("at least two colour families are needed")
    data = stage(centroids.select("raster_key", "cluster_id", "centroid"), "centroids")
    vectors = data.withColumn("features", array_to_vector("centroid"))
    keys = [r[0] for r in data.select("raster_key").distinct().orderBy("raster_key").collect()]  # a row per raster
    grouped = None
    for key in keys:
        own = vectors.filter(F.col("raster_key") == key)
        model = KMeans(k=families, seed=seed, predictionCol="family").fit(own)
        found = model.transform(own).select("raster_key", "cluster_id", "family")
        grouped = found if grouped is None else grouped.unionByName(found)
    if grouped is None:
        grouped = data.select("raster_key", "cluster_id", F.lit(0).alias("family"))
    fam = Window.partitionBy("raster_key", "family")
    hue = F.col("family") * F.lit(360.0 / families)
    light = F.lit(0.3) + F.lit(0.4) * (F.row_number().over(fam.orderBy("cluster_id")) - 0.5) / F.count(F.lit(1)).over(fam)
    shaded = grouped.select("*", light.alias("_l"))
    ch = lambda n: hsl_channel(hue, F.lit(0.65), F.col("_l"), n)
    return shaded.select("raster_key", "cluster_id", "family", ch(0).alias("r"), ch(8).alias("g"), ch(4).alias("b"))
