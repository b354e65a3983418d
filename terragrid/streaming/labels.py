"""A stream of label edits folded into a table of current labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terragrid.functions.ids import is_labeled
from terragrid.operators.labels import latest_labels

EVENTS = "seq BIGINT, ts TIMESTAMP_NTZ, raster_key STRING, cluster_id INT, path STRING"


def read_label_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Edit log as a stream of Parquet files."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def fold_label_stream(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each batch, reduced to its last edits, to the label log ``table``.

    One folder per batch id, overwritten when the batch is repeated after a
    failure, so the log holds every edit once.  Readers take the newest edit
    (:func:`current_labels`), hence batch and stream give the same labels; the
    log is never rewritten as a whole.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        latest_labels(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_labels(spark: SparkSession, table: str) -> DataFrame:
    """Labels after all batches written so far."""
    return latest_labels(spark.read.schema(EVENTS).parquet(table))


def compact_labels(spark: SparkSession, table: str, target: str) -> None:
    """Write the current labels as a fresh log to ``target``."""
    current_labels(spark, table).write.mode("overwrite").parquet(f"{target}/batch=-1")


def newest_edits(stream: DataFrame) -> DataFrame:
    """One state row per cluster: its newest edit so far."""
    newest = stream.groupBy("raster_key", "cluster_id").agg(F.max(F.struct("ts", "seq", "path")).alias("_e"))
    return newest.select("raster_key", "cluster_id", F.col("_e.path").alias("path"))


def label_progress(labels: DataFrame) -> DataFrame:
    """Labelled and all clusters per raster of a label table."""
    return labels.groupBy("raster_key").agg(
        F.count_if(is_labeled(F.col("path"))).alias("labeled"), F.count(F.lit(1)).alias("total")
    )


def write_progress(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep ``table`` at the progress per raster after each batch.

    The stream aggregates edits to clusters in ``complete`` mode; the sink counts
    those rows per raster and replaces the small result.
    """

    def publish(batch: DataFrame, _: int) -> None:
        label_progress(batch).write.mode("overwrite").parquet(table)

    writer = newest_edits(stream).writeStream.outputMode("complete").foreachBatch(publish)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
