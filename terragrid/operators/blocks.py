"""Overlays on block storage: ``raster_key, by, bx, values ARRAY<INT>``.

A block row carries four bytes per pixel where a pixel row carries its key with
every value, so an overlay has less to shuffle.  All arrays of one table have the
same length; cells outside the grid hold nodata.
"""

from __future__ import annotations

import sys

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.operators.overlay import composite_ids, composite_inputs
from terragrid.plans.sizing import Dim

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FREE = (1 << 31) - 1


def pixels_from_blocks(blocks: DataFrame, block: int) -> DataFrame:
    """M1: unpack one row per block (row-major ``values``) into pixels."""
    i = F.col("_i")
    return blocks.select("raster_key", "by", "bx", F.posexplode("values").alias("_i", "value")).select(
        "raster_key",
        (F.col("by") * block + F.floor(i / block)).cast("int").alias("y"),
        (F.col("bx") * block + i % block).cast("int").alias("x"),
        "value",
    )


def _pack(batches: Iterator[pa.RecordBatch], block: int, nodata: int) -> Iterator[pa.RecordBatch]:
    """Pack pixels that come sorted by block; the block that a batch ends in stays open for the next."""
    size = block * block
    names, kinds = ("raster_key", "by", "bx", "values"), (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()))

    def rows(places: list, values: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * size, pa.int32()), pa.array(values.ravel(), pa.int32()))
        columns = list(zip(*places, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds[:3], strict=True)], lists], names=list(names))

    last, open_ = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, by, bx, y, x, value = (batch.column(i) for i in range(6))
        raster = key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        y, x, value, rows_y, rows_x = (c.to_numpy(zero_copy_only=False) for c in (y, x, value, by, bx))
        new = np.ones(len(y), bool)
        new[1:] = (raster[1:] != raster[:-1]) | (rows_y[1:] != rows_y[:-1]) | (rows_x[1:] != rows_x[:-1])
        first = np.flatnonzero(new)
        places = [(key[i].as_py(), int(rows_y[i]), int(rows_x[i])) for i in first.tolist()]
        values = np.full((len(first), size), nodata, "int32")
        if places[0] == last:
            values[0] = open_[0]
        elif last is not None:
            yield rows([last], open_)
        values[np.cumsum(new) - 1, (y % block) * block + x % block] = value
        last, open_ = places[-1], values[-1:]
        if len(places) > 1:
            yield rows(places[:-1], values[:-1])
    if last is not None:
        yield rows([last], open_)


def blocks_from_pixels(pixels: DataFrame, block: int, nodata: int = S.NODATA) -> DataFrame:
    """M1: pack pixels into square blocks, absent pixels as nodata.

    Pixels are sorted by block and packed as they pass, one open block at a time;
    writing into an array by position is what built-in functions lack.
    """
    by, bx = F.floor(F.col("y") / block).cast("int"), F.floor(F.col("x") / block).cast("int")
    place = ["raster_key", "by", "bx"]
    cells = pixels.select("raster_key", by.alias("by"), bx.alias("bx"), "y", "x", "value")
    return cells.repartition(*place).sortWithinPartitions(*place).mapInArrow(lambda batches: _pack(batches, block, nodata), S.BLOCKS)


def count_pixels_blocks(blocks: DataFrame, nodata: int = S.NODATA) -> DataFrame:
    """A1 on blocks: values are unpacked and counted in the same stage."""
    cells = blocks.select("raster_key", F.explode("values").alias("cluster_id")).filter(F.col("cluster_id") != nodata)
    return cells.groupBy("raster_key", "cluster_id").agg(F.count(F.lit(1)).alias("pixel_count"))


def composite_blocks(blocks: DataFrame, registry: DataFrame, priority: str = "highest_k") -> DataFrame:
    """J2 on blocks: smallest composite id per cell, nodata where the leading raster has none.

    The ids that occur in a block are looked up once each and kept beside its
    values, so any id will do; the arrays of a block, one per raster, meet in one
    shuffle on ``(by, bx)``.
    """
    inputs = composite_inputs(registry, priority)
    first = inputs.filter("prio = 1").first()
    if first is None:
        raise ValueError("no rasters to build a composite from")
    ids = Dim(composite_ids(registry, priority, inputs).select("raster_key", "cluster_id", "uid"))
    place = ["raster_key", "by", "bx"]
    seen = blocks.select(*place, F.explode(F.array_distinct("values")).alias("cluster_id"))
    known = ids.join(seen, ["raster_key", "cluster_id"], how="inner", spread=["by", "bx"])
    of_block = known.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "uid"))).alias("_uids"))
    met = blocks.join(of_block, place, "left")
    is_ref = F.col("raster_key") == first["raster_key"]
    uid = lambda v: F.coalesce(F.try_element_at("_uids", v), F.lit(_FREE))
    lead = F.transform("values", lambda v: F.when(v == S.NODATA, F.lit(S.NODATA)).otherwise(uid(v)))
    coded = met.filter(is_ref | F.col("_uids").isNotNull()).select(
        "by", "bx", is_ref.alias("_ref"), F.when(is_ref, lead).otherwise(F.transform("values", uid)).alias("_v")
    )
    stacked = coded.groupBy("by", "bx").agg(F.collect_list("_v").alias("_all"), F.max("_ref").alias("_has"))
    low = F.aggregate(
        F.slice("_all", F.lit(2), F.size("_all")), F.col("_all")[0], lambda acc, v: F.zip_with(acc, v, lambda a, b: F.least(a, b))
    )
    final = F.transform(low, lambda v: F.when(v == _FREE, F.lit(S.UNLABELED_ID)).otherwise(v))
    return stacked.filter("_has").select(F.lit(S.COMPOSITE_KEY).alias("raster_key"), "by", "bx", final.alias("values"))
