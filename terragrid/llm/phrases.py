"""Phrase collocation mining with stripes.

Each prefix keys an associative counter of its next words; stripes of one prefix
are merged elementwise.  Of merged stripes come the phrases (prefix and next word),
the totals of prefixes (all next words, the end of a piece included) and, by a
maximum over a phrase's extensions to either side, what subsumes it.

Two rounds: stripes of words give counts of words and pairs, stripes of pairs give
triples.  A triple is counted only where both of its pairs are frequent; a table of
bits, sized by the number of frequent pairs and bounded by ``MOST_BITS``, tells them in
the tasks.  Where that table is too small it lets more pass, and results stay exact,
for counts decide in the end.  Tasks cut the texts into words and count pairs with
numpy, a few MB of text at once; stripes travel as arrays to their prefix.  The
stripes of hot prefixes are split by a hash of the next word: which words are hot is
told by a sample of texts, which pairs by their counts; both lists are bounded, and a
hot prefix that is missing there only makes its task longer.

Defined results: null texts are empty, a null ``lang`` is ``und``; words are compared
with A-Z lowered; copies count as often as they occur; ties in rank are broken by the
phrase; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terragrid.llm.vectors import Words, chunks, run_hashes
from terragrid.plans.sizing import stage, staged_rows

#: Bytes of text whose stripes are merged before they travel.
CHUNK = 3 << 20
#: A prefix with one in so many words is hot; its stripes go to so many tasks.
HOT_SHARE, SPLITS = 1000, 32
#: Texts, at most, and bytes of each that tell the hot words; results do not depend on them.
SAMPLE_TEXTS, SAMPLE_BYTES = 2000, 2000
#: Bits for each frequent pair, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 27

#: Fixed by the contract of phrases: what parts pieces, and words within them.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"
_to_gap = bytes.maketrans(PIECE_ENDS, b"\n" * len(PIECE_ENDS))

#: Next words are joined by spaces (the end of a piece is an empty one); counts are 32-bit numbers, absent where all are one.
STRIPES = "lang string, prefix string, split int, nexts string, counts binary"


class Pieces(Words):
    """Words of pieces; ``joined`` tells whether a word and the next stand in one piece."""

    def __init__(self, texts: list[bytes | None]):
        cut = [(t or b"").translate(_to_gap) for t in texts]
        super().__init__(cut, lower=True)
        ends = np.concatenate([[0], np.cumsum(self.data == 0x0A)])  # a newline parts texts as well
        self.joined = np.zeros(len(self), bool)
        if len(self) > 1:
            self.joined[:-1] = ends[self.start[1:]] == ends[self.end[:-1]]


def _hash_pairs(langs: list[str], first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Hash of each pair of words of a language, as :func:`_stripes` computes it."""
    w = Words([a + b" " + b for a, b in zip(first, second, strict=True)])
    pair = run_hashes(w.hashes(), 2)[::2]
    return pair ^ _lang_hashes(langs)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    """Hash of each label by its bytes, blanks and all."""
    of = {lang: run_hashes(np.frombuffer(lang.encode() + b"\x00", np.uint8).astype(np.uint64), len(lang.encode()) + 1)[0] for lang in set(langs)}
    return np.array([of[lang] for lang in langs], np.uint64)


class _Stripes:
    """Stripes of some texts: of words (``depth`` 1), or of pairs that may be frequent (2)."""

    def __init__(self, depth: int, hot: set[tuple[str, str]], bits: np.ndarray | None):
        self.depth, self.hot, self.bits = depth, hot, bits

    def _frequent(self, pairs: np.ndarray) -> np.ndarray:
        at = pairs & np.uint64(8 * len(self.bits) - 1)
        return self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0

    def of(self, langs: list[str], texts: list[bytes | None]) -> Iterator[tuple]:
        names = sorted(set(langs))
        index = {lang: i for i, lang in enumerate(names)}
        w = Pieces(texts)
        if not len(w):
            return
        h = w.hashes()
        lang = np.array([index[x] for x in langs])[w.doc]
        _, first, word = np.unique(h, return_index=True, return_inverse=True)
        spelt = [w.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
        n = len(spelt)  # the word number n is the end of a piece
        if self.depth == 1:
            after = np.where(w.joined, np.concatenate([word[1:], [0]]), n)
            prefix, at = word, np.arange(len(w))
        else:
            pair = np.concatenate([run_hashes(h, 2), np.zeros(1, np.uint64)]) ^ _lang_hashes(names)[lang]
            good = w.joined & self._frequent(pair)
            at = np.flatnonzero(good[:-1] & good[1:])  # triples whose pairs both pass
            if not len(at):
                return
            _, prefix = np.unique(word[at] * np.int64(n) + word[at + 1], return_inverse=True)
            after = word[at + 2]
        key = (lang[at] * np.int64(prefix.max() + 1) + prefix, after)
        order = np.lexsort(key[::-1])
        a, b = key[0][order], key[1][order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        begin = np.flatnonzero(new)
        count = np.diff(np.concatenate([begin, [len(a)]]))
        a, b, at = a[begin], b[begin], at[order[begin]]
        edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
        nexts = pa.array([*spelt, ""], pa.string()).take(pa.array(b))
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            i = int(at[x])
            text = spelt[word[i]] if self.depth == 1 else f"{spelt[word[i]]} {spelt[word[i + 1]]}"
            name = names[lang[i]]
            if (name, text) not in self.hot:
                yield name, text, 0, (x, y)
                continue
            # splits of hot prefixes begin at 1; the end of a piece goes with the first
            split = 1 + (h[first[np.minimum(b[x:y], n - 1)]] % np.uint64(SPLITS)).astype(np.int64)
            split[b[x:y] == n] = 1
            for s in np.unique(split).tolist():
                yield name, text, s, x + np.flatnonzero(split == s)
        self.nexts, self.count = nexts, count


def _batches(stripes: _Stripes, langs: list[str], texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
    rows = list(stripes.of(langs, texts))
    for lo in range(0, len(rows), 50_000):
        some = rows[lo : lo + 50_000]
        take = [np.arange(*at) if isinstance(at, tuple) else at for *_, at in some]
        flat = np.concatenate(take)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in take])])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stripes.nexts.take(pa.array(flat)))
        counts = stripes.count[flat].astype("<u4")
        more = np.maximum.reduceat(counts, offsets[:-1]) > 1
        data, bounds = counts.tobytes(), (4 * offsets).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in some], pa.string()), pa.array([r[1] for r in some], pa.string()), pa.array([r[2] for r in some], pa.int32()),
                pc.binary_join(lists, " "), pa.array([data[x:y] if m else None for x, y, m in zip(bounds, bounds[1:], more.tolist(), strict=False)], pa.binary()),
            ],
            names=["lang", "prefix", "split", "nexts", "counts"],
        )


def stripes(rows: DataFrame, depth: int, hot: set[tuple[str, str]], bits: np.ndarray | None = None) -> DataFrame:
    """Unmerged stripes of ``rows`` (lang, text)."""
    make = _Stripes(depth, hot, bits)
    shared = rows.sparkSession.sparkContext.broadcast(make)  # bounded: the bits and at most HOT_SHARE words a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        texts: list[bytes | None] = []
        size = 0
        for batch, some in chunks(batches):
            own = sum(len(t or b"") for t in some)
            if texts and size + own > CHUNK:
                yield from _batches(shared.value, langs, texts)
                langs, texts, size = [], [], 0
            langs += batch.column("lang").to_pylist()
            texts += some
            size += own
        yield from _batches(shared.value, langs, texts)

    return rows.select("lang", "text").mapInArrow(run, STRIPES)


def merged(parts: DataFrame, least: int) -> DataFrame:
    """Stripes merged elementwise: ``lang, prefix, next, n``.

    A row without ``next`` is the total of a prefix, or of its split; a row without
    ``prefix`` either is the total of a language.  Next words with fewer than
    ``least`` and totals that are smaller are left out.
    """
    schema = StructType().add("lang", "string").add("prefix", "string").add("next", "string").add("n", "long")
    arrow = to_arrow_schema(schema)

    def folded(table: pa.Table, sums: Counter) -> Iterator[pa.RecordBatch]:
        """Of whole stripes: all rows of each prefix and split are in ``table``."""
        nexts = pc.split_pattern(table["nexts"].combine_chunks(), " ")
        parents, sizes = pc.list_parent_indices(nexts), pc.list_value_length(nexts).to_numpy(zero_copy_only=False)
        counts = np.ones(len(parents), np.int64)
        more = pc.is_valid(table["counts"]).to_numpy()
        counts[np.repeat(more, sizes)] = np.frombuffer(b"".join(table["counts"].drop_null().to_pylist()), "<u4")
        flat = pa.table({**{c: table[c].take(parents) for c in ("lang", "prefix", "split")}, "next": pc.list_flatten(nexts), "n": pa.array(counts)})
        each = flat.group_by(["lang", "prefix", "split", "next"], use_threads=False).aggregate([("n", "sum")])
        total = each.group_by(["lang", "prefix", "split"], use_threads=False).aggregate([("n_sum", "sum")])
        for lang, n in zip(*(total.group_by("lang", use_threads=False).aggregate([("n_sum_sum", "sum")])[c].to_pylist() for c in ("lang", "n_sum_sum_sum")), strict=True):
            sums[lang] += n
        each = each.filter(pc.and_(pc.greater_equal(each["n_sum"], least), pc.not_equal(each["next"], "")))
        # a split of a hot prefix counts, however small
        total = total.filter(pc.or_(pc.greater_equal(total["n_sum_sum"], least), pc.greater(total["split"], 0)))
        for some, names in ((each, ("lang", "prefix", "next", "n_sum")), (total, ("lang", "prefix", None, "n_sum_sum"))):
            cols = [some[c] if c else pa.nulls(len(some), pa.string()) for c in names]
            yield from pa.table(cols, schema=arrow).to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < 4 << 20:
                continue
            table = pa.Table.from_batches(held)
            last = table.slice(len(table) - 1).to_pylist()[0]
            open_ = pc.and_(pc.and_(pc.equal(table["lang"], last["lang"]), pc.equal(table["prefix"], last["prefix"])), pc.equal(table["split"], last["split"]))
            whole = table.filter(pc.invert(open_))
            if len(whole):
                yield from folded(whole.combine_chunks(), sums)
            held = table.filter(open_).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield from folded(pa.Table.from_batches(held).combine_chunks(), sums)
        if sums:
            yield from pa.table([list(sums), [None] * len(sums), [None] * len(sums), list(sums.values())], schema=arrow).to_batches()

    keys = ["lang", "prefix", "split"]
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def hot_words(rows: DataFrame) -> set[tuple[str, str]]:
    """Words that take a large share of the words of some texts, chosen by a hash."""
    key = F.xxhash64("lang", "text")
    bar = rows.filter(F.length("text") > 0).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not bar:
        return set()
    share = min(1.0, SAMPLE_TEXTS / bar)
    some = rows.filter((F.length("text") > 0) & (F.abs(key % 1_000_003) < int(share * 1_000_003) + 1))
    seen: Counter = Counter()
    for r in some.select("lang", F.substring("text", 1, SAMPLE_BYTES).alias("text")).limit(2 * SAMPLE_TEXTS).toLocalIterator():
        words = re.split(rb"[\x20\x09-\x0D.,;:!?]+", r["text"].encode().lower())
        seen.update((r["lang"], w.decode("utf-8", "replace")) for w in words if w)
    total = seen.total()
    return {w for w, n in seen.items() if n * HOT_SHARE > total}


def pair_bits(pairs: DataFrame, n: int) -> np.ndarray:
    """Bits at the hashes of frequent pairs (lang, prefix, next): about one in ``BITS_EACH`` is set."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, int(n * BITS_EACH).bit_length()))
    schema = StructType().add("w", "integer").add("v", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _hash_pairs(b.column(0).to_pylist(), *(b.column(i).cast(pa.binary()).to_pylist() for i in (1, 2))) & np.uint64(size - 1)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(5)).astype(np.int32)), pa.array((np.uint64(1) << (h & np.uint64(31))).astype(np.int64))], names=["w", "v"])

    out = np.zeros(size // 32, np.uint32)
    for r in pairs.select("lang", "prefix", "next").mapInArrow(run, schema).groupBy("w").agg(F.bit_or("v").alias("v")).toLocalIterator():  # size / 32 rows at most
        out[r["w"]] = r["v"]
    return out.astype("<u4").view(np.uint8)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    return F.expr(f"(1000000 * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)})").cast("long")


def collocations(docs: DataFrame, least: int = 10, subsumed_percent: int = 50) -> DataFrame:
    """All candidates that are not subsumed: ``lang, phrase, a, l, r, n, score``.

    A candidate is a phrase of two or three words with ``a >= least`` occurrences within
    pieces; ``l`` and ``r`` are the counts of its parts at the lowest-scoring cut.  One
    that stands in a longer candidate with ``subsumed_percent`` of its count is dropped.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found = stage(merged(stripes(rows, 1, hot_words(rows)), least), "pairs")
    pairs = stage(found.filter("next is not null").groupBy("lang", "prefix", "next").agg(F.sum("n").alias("a")), "pairs")
    words = found.filter("next is null and prefix is not null").groupBy("lang", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    sizes = found.filter("prefix is null").groupBy("lang").agg(F.sum("n").alias("n"))
    every = pairs.agg(F.sum("a")).first()[0] or 0
    name = F.concat_ws(" ", "prefix", "next")
    hot = pairs.filter(F.col("a") * HOT_SHARE > every).select("lang", name.alias("p"))
    hot_pairs = {(r["lang"], r["p"]) for r in hot.collect()}  # HOT_SHARE rows at most
    bits = pair_bits(pairs, staged_rows(pairs))
    triples = stage(merged(stripes(rows, 2, hot_pairs, bits), least).filter("next is not null"), "triples")

    word = lambda c, as_: words.select(F.col("lang").alias("lang"), F.col("prefix").alias(c), F.col("n").alias(as_))
    pair = lambda c, as_: pairs.select("lang", name.alias(c), F.col("a").alias(as_))
    two = pairs.select("lang", F.col("prefix").alias("w1"), F.col("next").alias("w2"), "a").join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    # the longest extension to either side decides whether a pair is subsumed
    head, tail = F.col("prefix").alias("p"), F.concat_ws(" ", F.substring_index("prefix", " ", -1), "next").alias("p")
    longer = triples.select("lang", head, "n").unionAll(triples.select("lang", tail, "n")).groupBy("lang", "p").agg(F.max("n").alias("longest"))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("p"), "a", "l", "r").join(longer, ["lang", "p"], "left")
    two = two.filter(F.coalesce(100 * F.col("longest") < subsumed_percent * F.col("a"), F.lit(True)))
    two = two.select("lang", F.col("p").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    three = triples.select("lang", F.col("prefix").alias("p12"), F.substring_index("prefix", " ", 1).alias("w1"), tail.alias("p23"), F.col("next").alias("w3"), F.col("n").alias("a"))
    three = three.join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"]).join(pair("p23", "r1"), ["lang", "p23"]).join(pair("p12", "l2"), ["lang", "p12"])
    three = three.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    three = three.select("lang", F.concat_ws(" ", "p12", "w3").alias("phrase"), "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    return two.unionByName(three).join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best_collocations(docs: DataFrame, most: int = 2000, least: int = 10) -> DataFrame:
    """The first ``most`` of each language by score, count and phrase: ``lang, rank, phrase, a, l, r, n, score``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = collocations(docs, least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
