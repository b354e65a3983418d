"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is its lines with a word, trimmed and hashed; every ``GRAM``
consecutive line hashes make a run hash.  Of every ``WINDOW`` consecutive run
hashes the smallest (the last of equals) is a fingerprint, so two documents that
share ``GRAM + WINDOW - 1`` lines in a row are guaranteed to share one in them.
Each fingerprint leads to its earliest place; from there the match is extended
both ways, by comparing line hashes along the same distance of positions.  Runs
of ``GRAM`` lines or more that match there are deleted, the earliest place stays.

Earlier means a smaller doc_id, or a smaller position in the same document.

Defined results: a null text stays null and has no lines; documents of fewer
lines than ``GRAM`` lose nothing (with ``gram=1`` every repeated line goes); lines without a word are not counted and stay;
null ids neither delete nor lose lines; rows with one id and different texts are
ordered by a hash of the text, rows equal in both lose the same lines; other
columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terragrid.llm.text import SPACES, free_name
from terragrid.plans.sizing import stage

#: Shortest run of lines that is deleted.
GRAM = 3
#: Run hashes of which one is selected.
WINDOW = 1
WORDY = r"[^\x20\x09-\x0D]"


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once per row, however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, lines``: number among all lines and hash of every line with a word."""
    split = F.split("text", "\n", -1)
    numbered = F.transform(split, lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(WORDY), F.xxhash64(F.trim(x, F.lit(SPACES)))).alias("h")))
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select("doc_id", F.xxhash64("text").alias("tag"), F.filter(numbered, lambda s: s["h"].isNotNull()).alias("lines")).distinct()


def fingerprints(hashed: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``h, doc_id, tag, pos, n``: each selected run hash and its first line; ``n`` is the number of lines."""

    def choose(h: Column) -> Column:
        def smallest(i: Column) -> Column:
            # of equal hashes the last: positions count down behind the hash
            part = F.transform(F.slice(h, i, window), lambda x, j: F.struct(x.alias("h"), (-(i - 1 + j)).alias("back")))
            return F.array_min(part)

        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (window - 1))), smallest))

    rows = hashed.filter(F.size("lines") >= gram)
    lines = F.transform("lines", lambda s: s["h"])
    runs = bind(lines, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (gram - 1)), lambda i: F.xxhash64(F.slice(h, i, gram))))
    out = rows.select("doc_id", "tag", F.size("lines").alias("n"), F.explode(bind(runs, choose)).alias("f"))
    return out.select(F.col("f.h").alias("h"), "doc_id", "tag", (-F.col("f.back")).alias("pos"), "n")


def matches(prints: DataFrame) -> DataFrame:
    """``doc_id, tag, src_id, src_tag, shift, n``: later documents and where they match the earliest one."""
    place = F.struct("doc_id", "tag", "pos")
    first = prints.groupBy("h").agg(F.min(place).alias("src"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    later = prints.join(first, "h").filter(place > F.col("src"))
    return later.select(
        "doc_id", "tag", "n", F.col("src.doc_id").alias("src_id"), F.col("src.tag").alias("src_tag"), (F.col("pos") - F.col("src.pos")).alias("shift")
    ).distinct()


def repeated_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, tag, gone``: numbers of the lines to delete, ascending."""
    hashed = stage(line_hashes(docs), "lines")
    found = matches(fingerprints(hashed, gram, window))
    hashes = F.transform("lines", lambda s: s["h"])
    source = hashed.select(F.col("doc_id").alias("src_id"), F.col("tag").alias("src_tag"), hashes.alias("src"))
    # of the earlier document only the stretch beside the later one travels on
    begin = F.greatest(F.lit(0), -F.col("shift"))
    beside = found.join(source, ["src_id", "src_tag"]).select(
        "doc_id", "tag", (F.col("shift") + begin).alias("offset"), F.slice("src", begin + 1, F.greatest(F.lit(1), F.col("n"))).alias("src")
    )

    def runs(same: Column) -> Column:
        whole = lambda p: F.forall(F.sequence(F.lit(0), F.lit(gram - 1)), lambda k: F.coalesce(F.get(same, p + k), F.lit(False)))
        starts = F.filter(F.sequence(F.lit(0), F.size(same) - 1), whole)
        return F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + gram - 1))))

    def gone(lines: Column) -> Column:
        at = lambda p: F.when(p >= F.col("offset"), F.get(F.col("src"), p - F.col("offset")))
        same = F.transform(lines, lambda s, p: F.coalesce(s["h"] == at(p), F.lit(False)))
        return F.transform(bind(same, runs), lambda p: F.get(lines, p)["i"])

    each = beside.join(hashed, ["doc_id", "tag"]).select("doc_id", "tag", gone(F.col("lines")).alias("gone")).filter(F.size("gone") > 0)
    # all numbers belong to one document and are at most as many as its lines times its matches
    return each.groupBy("doc_id", "tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def without(lines: Column, gone: Column) -> Column:
    """The lines whose numbers are not in the ascending array ``gone``: the stretches between them."""
    edges = F.concat(F.array(F.lit(-1)), gone)
    upto = F.concat(gone, F.array(F.size(lines)))

    def cut(e: Column) -> Column:
        return bind(upto, lambda u: F.flatten(F.transform(e, lambda a, i: F.slice(lines, a + 2, F.get(u, i) - a - 1))))

    return bind(edges, cut)


def remove_repeated_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` without repeated runs of lines; adds ``n_lines`` and ``n_removed``."""
    drop = repeated_lines(docs, gram, window).withColumnsRenamed({"doc_id": "_gone_id", "tag": "_gone_tag", "gone": "_gone"})
    split, counted, removed = free_name(docs, "split_"), free_name(docs, "n_lines"), free_name(docs, "n_removed")
    joined = docs.join(drop, (docs["doc_id"] == drop["_gone_id"]) & (F.xxhash64(docs["text"]) == drop["_gone_tag"]), "left")
    rows = joined.withColumn(split, F.split("text", "\n", -1))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(bind(F.col(split), lambda x: without(x, F.col("_gone"))), "\n"))
    return rows.withColumns(
        {
            counted: F.coalesce(F.size(F.filter(split, lambda x: x.rlike(WORDY))), F.lit(0)).cast("long"),
            removed: F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
            "text": text,
        }
    ).select(*[F.col(f"`{c}`") for c in docs.columns], counted, removed)
