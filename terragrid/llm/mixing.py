"""Mixing sources to target weights by systematic sampling.

The share of each source follows from its weight, up to a highest number of
passes over it.  Every document of a source expects the same number of copies;
the expected copies are summed up along the source, one offset is added, and a
document comes out once for every whole number that its stretch crosses.

Defined results: a null text has size 0; a null source is a source of its own,
after all others; a source without words expects no copies; repeated rows are
separate documents; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terragrid.llm.text import n_words
from terragrid.plans.sizing import stage

#: A document may come out this often at most.
MOST_PASSES = 3.0


def cyclic_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, 1, 2, 3, ... along the sources in code point order, null last."""
    return (F.pmod(rank, F.lit(3)) + 1).cast("double")


def source_targets(sizes: DataFrame, weight: Callable[[Column], Column] = cyclic_weight, most: float = MOST_PASSES) -> DataFrame:
    """``source, source_size, target`` from a table ``source, size``.

    Targets share the total size by weight, none above ``most`` times its
    source's size; what is cut off is shared again by weight.  Only sums over
    the table of sources reach the driver.
    """
    by_source = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = stage(_rank(by_source).withColumn("weight", weight(F.col("rank"))), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level = 0.0  # target per unit of weight; rises until no source stands above its cap
    while total:
        capped = cap <= F.col("weight") * level
        got = ranked.agg(
            F.sum(F.when(capped, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not got["free"]:
            break
        rise = (total - got["held"]) / got["free"]
        if rise <= level:
            break
        level = rise
    target = F.least(cap, F.col("weight") * level).cast("double")
    return ranked.select("source", "source_size", target.alias("target"))


def _rank(sources: DataFrame) -> DataFrame:
    """Number the sources from 0 in code point order, null last, by a range sort."""
    last = F.col("source").isNull()
    ordered = sources.repartitionByRange(last.cast("int"), "source").sortWithinPartitions(last.cast("int"), "source")
    return _positions(ordered, []).withColumnRenamed("_rank", "rank").drop("_part", "_pos")


def _positions(ordered: DataFrame, within: list[str]) -> DataFrame:
    """Rank from 0, within each group, of rows that are range-sorted over the partitions.

    A rank is the place in the partition plus the rows of the same group in the
    partitions before: one row per partition and group is summed up, no more.
    """
    part = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    part = stage(part, "placed")
    firsts = part.groupBy("_part", *within).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    offsets = firsts.select("_part", *[F.col(c).alias(f"_{c}") for c in within], offset.alias("_offset"))
    same = part["_part"] == offsets["_part"]
    for c in within:
        same = same & part[c].eqNullSafe(offsets[f"_{c}"])
    joined = part.join(offsets, same).drop(offsets["_part"]).drop(*[f"_{c}" for c in within])
    return joined.withColumn("_rank", F.col("_pos") + F.col("_offset")).drop("_offset")


def mix(
    docs: DataFrame,
    weight: Callable[[Column], Column] = cyclic_weight,
    size: Column | None = None,
    most: float = MOST_PASSES,
    seed: int = 1,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every row of ``docs``.

    Documents of a source are laid out by size, then by a keyed hash, so the
    words taken differ from the target by about one document.  The result
    depends on the rows and the seed only, not on files or partitions.
    """
    size = n_words(F.col("text")) if size is None else size
    slim = stage(docs.select("doc_id", "source", size.cast("long").alias("size")), "sizes")
    targets = source_targets(slim.select("source", "size"), weight, most)
    key = [F.col("source"), F.col("size"), F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    placed = _positions(slim.repartitionByRange(*key).sortWithinPartitions(*key), ["source"])
    t = targets.withColumnRenamed("source", "_source")
    rows = placed.join(t, placed["source"].eqNullSafe(t["_source"])).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # one offset in [0, 1) per source
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    upto = lambda rank: F.floor(rank * rate + offset)
    copies = (upto(F.col("_rank") + 1) - upto(F.col("_rank"))).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    chosen = mix(docs, **options)
    # equal ids may stand for several rows: number of copies per row, matched by id, source and size
    taken = chosen.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies")).alias("_copies"))
    size = options.get("size") if options.get("size") is not None else n_words(F.col("text"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*cols).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_src"), size.cast("long").alias("_size"))
    same = keyed["_id"].eqNullSafe(taken["doc_id"]) & keyed["_src"].eqNullSafe(taken["source"]) & (keyed["_size"] == taken["size"])
    joined = keyed.join(taken, same).select("_row", "_id", "_src", "_size", "_copies")
    # rows of one id, source and size are told apart by their order; nearly always there is one
    one = F.size("_copies") == 1
    single = joined.filter(one).select("_row", F.element_at("_copies", 1).alias("_k"))
    w = Window.partitionBy("_id", "_src", "_size").orderBy(F.xxhash64("_row"))
    several = joined.filter(~one).withColumn("_i", F.row_number().over(w)).select("_row", F.element_at("_copies", F.col("_i")).alias("_k"))
    out = single.unionByName(several).filter(F.col("_k") > 0)
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).select("_row.*")
