"""Physical choices that depend on the size of a table.

* :func:`stage` cuts lineage with a Parquet table in the shared scratch folder.
* :class:`Dim` is a dimension table that is broadcast only after its row count
  and byte size were measured; larger ones are joined by a salted shuffle, so a
  hot key (one cluster holding a third of all pixels) never lands in one task.
* :func:`shuffled` keeps Spark from broadcasting a table whose size it underrates.
* :func:`number_rows` hands out dense ids without sorting a large table in one task.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 48 * 1024 * 1024
SINGLE_TASK_ROWS = 100_000
SALTS = 32

#: Of local sessions without a named folder; removed when Python ends.
_local_scratch: dict[str, tempfile.TemporaryDirectory] = {}
_measured: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.TemporaryDirectory(prefix="terragrid-", ignore_cleanup_errors=True)
    return _local_scratch[app].name


def _row_bytes(df: DataFrame) -> Column:
    """Approximate size of a row: text length, JSON length of nested values, 8 otherwise."""
    total = F.lit(16)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            size = F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = F.coalesce(F.length(F.to_json(F.struct(c.alias("v")))), F.lit(0))
        else:
            size = F.lit(8)
        total = total + size
    return total.cast("long")


def stage(df: DataFrame, name: str = "stage", measure: bool = False) -> DataFrame:
    """Write ``df`` to the scratch folder and return the table read back.

    The rows, and with ``measure`` the bytes, are counted by the write itself,
    see :func:`staged_rows` and :func:`is_small`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    if measure:
        metrics.append(F.sum(_row_bytes(df)).alias("bytes"))
    df.observe(seen, *metrics).write.parquet(path)
    got = seen.get
    back = spark.read.schema(df.schema).parquet(path)
    _measured[back] = (got["rows"], (got["bytes"] or 0) if measure else None)
    return back


def staged_rows(df: DataFrame) -> int:
    """Rows of a staged table, known from its write; other tables are counted."""
    return _measured[df][0] if df in _measured else df.count()


def is_small(df: DataFrame) -> bool:
    """True when the rows and bytes of ``df`` are safe to broadcast."""
    rows, size = _measured.get(df, (None, None))
    if size is None:
        got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
        rows, size = got["n"], got["b"] or 0
    return rows <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES


def shuffled(df: DataFrame) -> DataFrame:
    """Mark one side of an equality join as too large to be broadcast.

    Spark takes a table for as large as the files below it, whatever generators make of
    their rows, so it would send exploded tables through the driver.
    """
    return df.hint("merge")


def spread_rows(df: DataFrame) -> DataFrame:
    """Deal rows over several tasks a core: few bytes of input may stand for much work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


class Dim:
    """A dimension table with a measured size.

    ``derived`` tables (results of a query over pixels) are staged first, so
    that measuring and joining do not compute them twice.
    """

    def __init__(self, df: DataFrame, derived: bool = True, name: str = "dim"):
        self.df = stage(df, name, measure=True) if derived else df
        self.small = is_small(self.df)

    def join(self, big: DataFrame, on: Sequence[str], how: str = "left", spread: Sequence[str] | None = None, bounded: bool = False) -> DataFrame:
        """Join ``big`` (left) with this table on equal columns.

        Each key must be unique here for ``how='left'`` to keep row counts.
        ``spread`` names the columns of ``big`` whose hash salts hot keys; by
        default all columns that are not keys.  ``bounded`` says that no key of
        ``big`` can have many rows, so a plain shuffle join will do.
        """
        on = list(on)
        if self.small:
            return big.join(F.broadcast(self.df), on, how)
        if bounded:
            return big.join(shuffled(self.df), on, how)
        return salted_join(big, self.df, on, how, spread)


def salted_join(big: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left", spread: Sequence[str] | None = None) -> DataFrame:
    """Shuffle join that splits every key of ``big`` over ``SALTS`` tasks.

    The salt is a hash of other columns of the row, so a retried task repeats
    it.  ``dim`` is repeated once per salt.
    """
    on = list(on)
    cols = list(spread) if spread else [c for c in big.columns if c not in on]
    plain = [c for c in cols if big.schema[c].dataType.typeName() not in ("map", "variant")]
    salt = F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int") if plain else F.lit(0)
    left = big.withColumn("_salt", salt)
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(shuffled(right), on + ["_salt"], how).drop("_salt")


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """Add dense ids ``start, start+1, ...`` in the given order.

    ``within`` restarts the numbering per group.  Small tables use one window;
    larger ones are range-sorted over many tasks and numbered by the sizes of
    the preceding partitions, so no task sees the whole table.
    """
    within = list(within)
    staged = stage(df, "number")
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if staged_rows(staged) <= SINGLE_TASK_ROWS:
        w = Window.partitionBy(*within).orderBy(*order)
        return staged.withColumn(name, (F.row_number().over(w) - 1 + start).cast("int"))
    keys = [F.col(c) for c in within] + order
    ordered = staged.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = ordered.withColumn("_part", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    ordered = stage(ordered, "numbered")
    # one row per partition: bounded by the number of tasks
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = Dim(offsets).join(ordered, ["_part"]).withColumn("_g", F.col("_off") + F.col("_pos"))
    if within:
        firsts = out.groupBy(*within).agg(F.min("_g").alias("_g0"))
        out = Dim(firsts).join(out, within)
    else:
        out = out.withColumn("_g0", F.lit(0))
    ident = (F.col("_g") - F.col("_g0") + start).cast("int").alias(name)
    return out.select(*[F.col(c) for c in df.columns], ident)
