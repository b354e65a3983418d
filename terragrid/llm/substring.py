"""Substring dedup by super-k-mers: runs of words that an earlier document holds.

A window is ``WINDOW`` consecutive words; its minimiser is the run of ``MINIMISER``
words with the smallest hash in it.  Consecutive windows with one minimiser
travel as one packed string to the minimiser's bucket.  Equal windows have equal
minimisers, so a bucket holds every occurrence of its windows: there they
are sorted, compared word by word, and each is marked that begins in a document
with a smaller id as well.

Minimisers fall into ``BINS`` bins, counted over all documents first.  A bin that
holds more than its share (one passage in a large part of the corpus) goes
another way: its windows are keyed by their whole text, reduced to the smallest
id before the shuffle, and joined back, which splits over any number of tasks.
Of these, at most ``HEAVY`` windows can make up more than one in ``HEAVY`` each; they
and their smallest ids are a table of bounded size, so they are told where the
text is read and make no row each in a join.

Defined results: a null text has no words; a null id neither removes nor loses
words; rows with equal ids are judged each for itself and never against each
other; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrid.llm.vectors import Words, chunks, run_hashes
from terragrid.plans.sizing import stage

WINDOW = 13
MINIMISER = 3
BINS = 1 << 16
#: A bin with more than so many times the mean number of windows is split by window.
HOT_BIN = 24
#: Windows that make up more than one in so many of those in hot bins are told by a table in the task.
HEAVY = 1 << 15
#: Longer windows are in no such table, so that it holds ``HEAVY * HEAVY_BYTES`` bytes at most.
HEAVY_BYTES = 1024
#: Distinct windows of hot bins that a task sums up at once.
HELD = 1 << 16
#: Windows of a bucket in the mean, beyond ``LEAST_BUCKETS`` buckets.
BUCKET_WINDOWS = 1 << 20
LEAST_BUCKETS = 1024
#: Compression level (zstd) of the packed strings and of texts that are shuffled.
LEVEL = 3

_PACK = struct.Struct("<I")


class SuperKmers:
    """Windows of the words of some texts, as runs with one minimiser."""

    def __init__(self, texts: list[bytes | None], window: int = WINDOW, m: int = MINIMISER):
        self.words = w = Words(texts)
        self.window = window
        if len(w) < window:
            self.at = self.n = self.bin = self.key = np.zeros(0, np.int64)
            return
        small = run_hashes(w.hashes(), m)
        view = np.lib.stride_tricks.sliding_window_view(small, window - m + 1)
        place = view.argmin(axis=1) + np.arange(len(view))
        valid = w.doc[: len(view)] == w.doc[window - 1 :]
        starts = np.flatnonzero(valid)
        # a new run where the minimiser moves on, or windows of another text begin
        new = np.ones(len(starts), bool)
        new[1:] = (place[starts[1:]] != place[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        #: first word, number of windows, bin, and other bits of the minimiser of each run
        self.at = starts[first]
        self.n = np.diff(np.concatenate([first, [len(starts)]]))
        least = small[place[self.at]]
        self.bin = (least & np.uint64(BINS - 1)).astype(np.int64)
        self.key = (least >> np.uint64(16)).astype(np.int64)

    def windows_of(self, runs: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """First word and text of every window of some runs."""
        n = self.n[runs]
        at = np.repeat(self.at[runs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text, begins = self.words.packed()
        return at, [text[a:b] for a, b in zip(begins[at].tolist(), (begins[at + self.window] - 1).tolist(), strict=True)]


def bin_counts(docs: DataFrame) -> np.ndarray:
    """Windows per bin over all documents: ``BINS`` numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for _, texts in chunks(batches):
            k = SuperKmers(texts)
            total += np.bincount(k.bin, weights=k.n, minlength=BINS).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bin", "n"])

    sums = docs.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    out = np.zeros(BINS, np.int64)
    for r in sums.collect():  # BINS rows at most
        out[r["bin"]] = r["n"]
    return out


def _pack(parts: list[bytes], *columns: np.ndarray) -> bytes:
    import zstandard

    lengths = np.fromiter(map(len, parts), np.int32, len(parts))
    body = b"".join([_PACK.pack(len(parts)), *(c.tobytes() for c in columns), lengths.tobytes(), *parts])
    return zstandard.ZstdCompressor(level=LEVEL).compress(body)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """doc ids, tags, places, numbers of windows and packed strings of a row."""
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, columns = _PACK.unpack_from(body), 4, []
    for dtype in (np.int64, np.int32, np.int32, np.int32, np.int32):
        columns.append(np.frombuffer(body, dtype, n, at))
        at += n * np.dtype(dtype).itemsize
    ends = at + np.cumsum(columns[4])
    return *columns[:4], [body[e - k : e] for e, k in zip(ends.tolist(), columns[4].tolist(), strict=True)]


def _told(k: SuperKmers, hot_runs: np.ndarray, ids: np.ndarray, heavy: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of windows of the stretches of heavy windows that a smaller id holds as well."""
    at, made = k.windows_of(hot_runs)
    none = np.iinfo(np.int64).max
    first = np.fromiter((heavy.get(w, none) for w in made), np.int64, len(made))
    at = at[first < ids[k.words.doc[at]]]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (k.words.doc[at[1:]] != k.words.doc[at[:-1]])
    head = np.flatnonzero(new)
    return at[head], np.diff(np.concatenate([head, [len(at)]]))


def super_kmers(rows: DataFrame, hot: np.ndarray, buckets: int, heavy: dict[bytes, int]) -> DataFrame:
    """``bucket, packed``: the runs of all texts outside the hot bins, a row per chunk and bucket.

    Stretches of heavy windows are packed with no text; a negative bucket marks them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, most=3 << 20):
            k = SuperKmers(texts)
            is_hot = hot[k.bin]
            all_ids, all_tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            out_bucket, out = [], []
            cold = np.flatnonzero(~is_hot)
            if len(cold):
                bucket = k.key[cold] % buckets
                order = np.argsort(bucket, kind="stable")
                cold, bucket = cold[order], bucket[order]
                text, begins = k.words.packed()
                at, n = k.at[cold], k.n[cold]
                lo, hi = begins[at].tolist(), (begins[at + n + k.window - 1] - 1).tolist()
                parts = [text[a:b] for a, b in zip(lo, hi, strict=True)]
                doc = k.words.doc[at]
                ids, tags = all_ids[doc], all_tags[doc]
                place, n = (at - k.words.first[doc]).astype(np.int32), n.astype(np.int32)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                out = [_pack(parts[a:b], ids[a:b], tags[a:b], place[a:b], n[a:b]) for a, b in spans]
                out_bucket = bucket[cuts[:-1]].tolist()
            if heavy and is_hot.any():
                at, n = _told(k, np.flatnonzero(is_hot), all_ids, heavy)
                if len(at):
                    doc = k.words.doc[at]
                    place = (at - k.words.first[doc]).astype(np.int32)
                    out.append(_pack([b""] * len(at), all_ids[doc], all_tags[doc], place, n.astype(np.int32)))
                    out_bucket.append(-1 - int(all_ids[doc[0]]) % buckets)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "packed"])

    return rows.mapInArrow(run, "bucket int, packed binary")


def _later(hashes: np.ndarray, ids: np.ndarray, same) -> np.ndarray:
    """Marks the windows that also begin in a document with a smaller id.

    ``same(i, j)`` compares the words of windows; hashes only bring equal ones together.
    """
    order = np.lexsort((ids, hashes))
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)][group]  # the smallest id of each group stands first
    marked = np.zeros(len(h), bool)
    more = np.flatnonzero(~new)
    for at, i, j in zip(more.tolist(), order[more].tolist(), first[more].tolist(), strict=True):
        if same(i, j):
            marked[i] = ids[i] > ids[j]
        else:  # two texts with one hash: the group is compared one by one
            own = order[group == group[at]]
            marked[i] = any(ids[x] < ids[i] and same(i, x) for x in own.tolist())
    return marked


def _bucket_runs(packed: list[bytes], window: int = WINDOW) -> pa.RecordBatch:
    """Marked windows of one bucket, as runs ``doc_id, tag, at, n``."""
    parts = [_unpack(p) for p in packed]
    ids, tags, place, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
    texts = [t for p in parts for t in p[4]]
    words = Words(texts)
    begin = words.first[:-1]
    # one entry per window: its run, and its number within the run
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[run] + step
    hashes = run_hashes(words.hashes(), window)[at]
    text = words.data.tobytes()
    lo, hi = words.start[at], words.end[at + window - 1]

    def same(i: int, j: int) -> bool:
        return text[lo[i] : hi[i]] == text[lo[j] : hi[j]]

    marked = np.flatnonzero(_later(hashes, ids[run], same))
    first = np.ones(len(marked), bool)
    first[1:] = (run[marked[1:]] != run[marked[:-1]]) | (marked[1:] != marked[:-1] + 1)
    head = np.flatnonzero(first)
    own = run[marked[head]]
    length = np.diff(np.concatenate([head, [len(marked)]])).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[own]), pa.array(tags[own]), pa.array((place[own] + step[marked[head]]).astype(np.int32)), pa.array(length)],
        names=["doc_id", "tag", "at", "n"],
    )


RUNS = "doc_id long, tag int, at int, n int"


def _told_runs(packed: bytes) -> pa.RecordBatch:
    ids, tags, place, n, _ = _unpack(packed)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags), pa.array(place), pa.array(n)], names=["doc_id", "tag", "at", "n"])


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by bucket; one bucket is held at a time."""
    held, now = [], None
    for batch in batches:
        for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if bucket < 0:  # these come before all buckets
                yield _told_runs(packed)
                continue
            if bucket != now and held:
                yield _bucket_runs(held)
                held = []
            now = bucket
            held.append(packed)
    if held:
        yield _bucket_runs(held)


def hot_window_counts(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """``window, first, n`` of the windows in the hot bins: smallest id and number.

    A task sums up what it reads before it hands it on, ``HELD`` distinct windows at a time.
    """

    def batch_of(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        first, n = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["window", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        size = 0
        for batch, texts in chunks(batches):
            k = SuperKmers(texts)
            at, made = k.windows_of(np.flatnonzero(hot[k.bin]))
            ids = batch.column("doc_id").to_numpy()[k.words.doc[at]].tolist()
            for w, i in zip(made, ids, strict=True):
                known = held.get(w)
                if known is None:
                    held[w] = [i, 1]
                    size += len(w)
                else:
                    known[0] = min(known[0], i)
                    known[1] += 1
            if len(held) >= HELD or size >= HELD * HEAVY_BYTES:
                yield batch_of(held)
                held, size = {}, 0
        if held:
            yield batch_of(held)

    some = rows.mapInArrow(run, "window binary, first long, n long")
    return some.groupBy("window").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def _hot_windows(rows: DataFrame, hot: np.ndarray, heavy: dict[bytes, int]) -> DataFrame:
    """``window, doc_id, tag, at`` of every window in the hot bins that is not told in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            k = SuperKmers(texts)
            own = np.flatnonzero(hot[k.bin])
            if not len(own):
                continue
            at, made = k.windows_of(own)
            if heavy:
                rest = [i for i, w in enumerate(made) if w not in heavy]
                at, made = at[np.array(rest, np.int64)], [made[i] for i in rest]
            doc = k.words.doc[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(made, pa.binary()), pa.array(batch.column("doc_id").to_numpy()[doc]), pa.array(batch.column("tag").to_numpy()[doc]),
                    pa.array((at - k.words.first[doc]).astype(np.int32)),
                ],
                names=["window", "doc_id", "tag", "at"],
            )

    return rows.mapInArrow(run, "window binary, doc_id long, tag int, at int")


def heavy_windows(first: DataFrame, total: int) -> dict[bytes, int]:
    """Smallest id of the windows that occur more than ``total / HEAVY`` times: fewer than ``HEAVY`` of them."""
    few = first.filter((F.col("n") > F.lit(total / HEAVY)) & (F.octet_length("window") <= HEAVY_BYTES))
    return {bytes(r["window"]): r["first"] for r in few.select("window", "first").toLocalIterator()}


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, at, n``: ``n`` windows from word ``at`` on that an earlier document holds.

    ``tag`` tells rows with one id apart by a hash of their text.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.hash("text").alias("tag")
    )
    counts = bin_counts(rows)
    hot = counts > max(1000.0, HOT_BIN * counts.sum() / BINS)
    buckets = max(LEAST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // BUCKET_WINDOWS)
    heavy: dict[bytes, int] = {}
    if hot.any():
        # a window that occurs once is no repeat
        first = stage(hot_window_counts(rows, hot).filter("n > 1"), "windows")
        heavy = heavy_windows(first, int(counts[hot].sum()))
    cold = super_kmers(rows, hot, buckets, heavy).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_in_buckets, RUNS)
    if not hot.any():
        return cold
    later = _hot_windows(rows, hot, heavy).join(first.drop("n"), "window").filter(F.col("doc_id") > F.col("first"))
    return cold.unionByName(later.select("doc_id", "tag", "at", F.lit(1).alias("n")))


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    import zstandard

    to = zstandard.ZstdCompressor(level=LEVEL)
    for batch, texts in chunks(batches):
        small = [None if t is None else to.compress(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(small, pa.binary())], names=["doc_id", "tag", "text"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            words, removed, kept = [], [], []
            for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                own = plain.decompress(text).split() if text else []
                gone = bytearray(len(own))
                for run in runs or []:
                    a, b = run["at"], run["at"] + run["n"] + WINDOW - 1
                    gone[a:b] = b"\x01" * (b - a)
                words.append(len(own))
                removed.append(sum(gone))
                kept.append(b" ".join([w for w, g in zip(own, gone, strict=True) if not g] if runs else own).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row: the words left, joined by one space."""
    runs = stage(repeated_runs(docs), "runs")
    by_row = runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.hash("text").alias("tag"))
    small = rows.mapInArrow(_shrunk, "doc_id long, tag int, text binary")
    return small.join(by_row, ["doc_id", "tag"], "left").select("doc_id", "text", "runs").mapInArrow(
        _apply, "doc_id long, n_words long, n_removed long, kept string"
    )
