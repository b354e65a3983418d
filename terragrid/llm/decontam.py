"""Benchmark decontamination by latent semantic retrieval.

The corpus is cut into passages of ``PASSAGE`` words; each is a TF-IDF vector over
``TERMS`` hashed words.  A randomised SVD, two passes over all passages, gives
the space of their largest singular vectors.  Benchmark items and, in every
document, stretches of a few lengths at every ``STEP``-th word are folded into it,
and pairs with a high cosine are candidates.  So are, whatever their cosine, all
places that hold enough of an item's rarest words for ``SHARED`` of the item to
stand within ``SPREAD`` times its length: no stretch of that length that meets
the limits below is missed.  Each candidate is then read: the longest common subsequence of words, and the share of the item's answer (its
last sentence) that the stretch holds, decide.

    verbatim    the subsequence holds ``NEAR`` of the item's words
    paraphrase  it holds ``SHARED`` of them, and the stretch ``ANSWERED`` of the answer

Only tables of fixed size (terms x rank) reach the driver and the tasks; benchmark
items travel in parts of ``ITEMS_AT_ONCE``.

Words are lower-cased (A-Z) and parted by white space and ASCII signs.

Defined results: a null or empty text holds nothing; an item without words is
never found; rows with one id are searched each for itself; repeated rows get
equal results; a document may hold several items; an empty table of documents or
items gives no pairs; documents shorter than a stretch are one stretch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrid.llm.vectors import Words, chunks

TERMS = 1 << 14
RANK = 64
#: Columns of the random sketch beyond the rank.
OVERSAMPLE = 8
PASSAGE = 32
#: Passages that are multiplied at once.
DENSE = 32
STEP = 12
#: Lengths of the stretches that are compared, in steps.
LENGTHS = (1, 2, 4)
#: Words in a larger share of the passages weigh nothing in the latent space; items are looked for by them all the same.
COMMON = 0.05
COSINE = 0.7
#: Words of a stretch in which an item is looked for by its words, per word of the item.
SPREAD = 1.5
#: Pairs of a word of the texts and an item with it that are sorted at once.
HITS = 1 << 21
NEAR = 0.8
SHARED = 0.6
ANSWERED = 0.6
ITEMS_AT_ONCE = 4000
#: Bytes of text that are searched at once: the vectors of their blocks stay in the processor's cache.
SEARCHED = 1 << 18
#: Rows of a table of terms that one task adds up.
BLOCK = 512


def _term(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(TERMS - 1)).astype(np.int32)


def _passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Passage of every word, and number of passages; a text's last one may be short."""
    place = np.arange(len(w)) - w.first[w.doc]
    new = place % PASSAGE == 0
    return np.cumsum(new) - 1, int(new.sum())


def _sum_rows(parts: DataFrame, width: int) -> np.ndarray:
    """Add up ``block, values`` (float64 rows of a table of terms); the table has a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("values").to_pylist(), strict=True):
                values = np.frombuffer(data, np.float32)
                total[block] = total[block] + values if block in total else values.astype(np.float64)
        names = ["block", "values"]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=names)

    out = np.zeros((TERMS, width))
    summed = parts.repartition("block").mapInArrow(add, "block int, values binary")
    for r in summed.collect():  # TERMS / BLOCK rows
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["values"]).reshape(-1, width)
    return out


def _emit(table: np.ndarray) -> pa.RecordBatch:
    blocks = range(TERMS // BLOCK)
    data = [np.ascontiguousarray(table[b * BLOCK : (b + 1) * BLOCK], np.float32).tobytes() for b in blocks]
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(data, pa.binary())], names=["block", "values"])


def term_rarity(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Inverse passage frequency of every term over all documents, above 0; and which terms are too common for the space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(TERMS, np.int64), 0
        for _, texts in chunks(batches):
            w = Words(texts, lower=True, plain=True)
            passage, some = _passages(w)
            pairs = np.sort(passage * TERMS + _term(w.hashes()))
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:] != pairs[:-1]
            seen += np.bincount(pairs[new] % TERMS, minlength=TERMS)
            n += some
        yield pa.RecordBatch.from_arrays([pa.array([*range(TERMS), -1]), pa.array([*seen, n])], names=["term", "n"])

    sums = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # TERMS + 1 rows at most
    seen = np.zeros(TERMS + 1)
    seen[got["term"].to_numpy()] = got["n"].to_numpy()  # that of -1 comes last
    n, seen = int(seen[-1]), seen[:-1]
    return np.log((n + 2) / (seen + 1)).astype(np.float32), seen > COMMON * n


def term_weights(docs: DataFrame) -> np.ndarray:
    """Weights of the terms in the latent space: their rarity, 0 for common ones."""
    rarity, common = term_rarity(docs)
    return np.where(common, np.float32(0), rarity)


def _weighted(w: Words, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Terms, unit-length weights and passages of the words that weigh something."""
    term = _term(w.hashes())
    passage, n = _passages(w)
    own = np.flatnonzero(weight[term] > 0)
    term, passage = term[own], passage[own]
    x = weight[term]
    norm = np.sqrt(np.bincount(passage, weights=x.astype(np.float64) ** 2, minlength=n))
    return term, (x / np.maximum(norm, 1e-9)[passage]).astype(np.float32), passage, n


def gram_times(docs: DataFrame, weight: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'(A right) for the matrix A of all passages: one pass over the documents."""
    right = right.astype(np.float32, copy=False)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(right.shape, np.float32)
        for _, texts in chunks(batches, most=1 << 19):
            term, x, passage, n = _weighted(Words(texts, lower=True, plain=True), weight)
            bounds = np.arange(0, n + DENSE, DENSE)
            cuts = np.searchsorted(passage, bounds).tolist()
            # the different terms of every few passages, by one sort; ``place`` is that of a word's term among them
            key = passage // DENSE * TERMS + term
            order = np.argsort(key)
            ranked = key[order]
            new = np.ones(len(key), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            place = np.empty(len(key), np.int64)
            place[order] = np.cumsum(new) - 1
            terms = ranked[new]
            firsts = np.searchsorted(terms, bounds // DENSE * TERMS).tolist()
            terms %= TERMS
            for lo, hi, begin, end in zip(cuts[:-1], cuts[1:], firsts[:-1], firsts[1:], strict=True):
                if hi > lo:  # a few passages over the terms that occur in them: small enough to be dense
                    own, column = terms[begin:end], place[lo:hi] - begin
                    row = passage[lo:hi] - passage[lo]
                    cells = np.bincount(row * len(own) + column, weights=x[lo:hi], minlength=(int(row[-1]) + 1) * len(own))
                    part = cells.reshape(-1, len(own)).astype(np.float32)
                    product = part.T @ (part @ np.take(right, own, axis=0, mode="clip"))
                    product += np.take(total, own, axis=0, mode="clip")
                    total[own] = product
        yield _emit(total)

    return _sum_rows(docs.select("text").mapInArrow(multiply, "block int, values binary"), right.shape[1])


def latent_space(docs: DataFrame, rank: int = RANK, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Rarity of the terms, common ones as well, and the map (terms x rank) that folds words into the space of all passages."""
    rarity, common = term_rarity(docs)
    weight = np.where(common, np.float32(0), rarity)
    # the driver holds few of these tables at once: each takes 9 MB, and the factorisation three more
    sketch = np.random.default_rng(seed).normal(size=(TERMS, rank + OVERSAMPLE)).astype(np.float32)
    image = gram_times(docs, weight, sketch)
    del sketch
    basis, _ = np.linalg.qr(image)
    image = gram_times(docs, weight, basis)
    values, turn = np.linalg.eigh(basis.T @ image)
    best = np.argsort(values)[::-1][:rank]
    best = best[values[best] > 1e-9 * max(values.max(), 1e-30)]
    # folded in by the inverse singular values: else the first few, languages and plain style, rule every cosine
    return rarity, (basis @ turn[:, best] / np.sqrt(values[best]) * weight[:, None]).astype(np.float32)


@dataclass(frozen=True)
class Items:
    """A part of the benchmark, folded into the latent space."""

    ids: list
    latent: np.ndarray
    words: list[np.ndarray]
    #: the different words of each item, and of its answer
    own: list[frozenset]
    answers: list[frozenset]
    #: ``rare``: hashes of the items' rarest words, ascending; the items of each are a slice of ``holders`` from ``first`` on
    rare: np.ndarray
    first: np.ndarray
    holders: np.ndarray
    #: a stretch of ``reach`` words that holds an item holds ``need`` of its rarest words
    need: np.ndarray
    reach: np.ndarray


_sentence = re.compile(r"(?<=[.!?])\s+|\n+")


def _least(item: np.ndarray) -> int:
    """Words that a subsequence must hold to be ``SHARED`` of the item."""
    return max(1, math.ceil(SHARED * len(item) - 1e-9))


def _rare_words(words: list[np.ndarray], rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``rare, first, holders, need, reach`` of :class:`Items`."""
    need = [max(1, _least(x) // 2) for x in words]
    # a subsequence leaves out len - least places at most, so of that many and ``need`` more it holds ``need``
    rare = [np.unique(x[np.argsort(-rarity[_term(x)], kind="stable")[: len(x) - _least(x) + n]]) for x, n in zip(words, need, strict=True)]
    key = np.concatenate([np.zeros(0, np.uint64), *rare])
    holder = np.repeat(np.arange(len(rare)), [len(r) for r in rare])
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    reach = [math.ceil(SPREAD * len(x)) for x in words]
    return keys, np.append(first, len(key)), holder[order], np.array(need, np.int64), np.array(reach, np.int64)


def fold_items(rows: list[tuple], space: np.ndarray, rarity: np.ndarray) -> Items:
    kept = []
    for item, text in rows:
        w = Words([(text or "").encode()], lower=True, plain=True)
        if len(w):
            sentences = [s for s in _sentence.split(text) if len(Words([s.encode()], plain=True)) >= 3] or [text]
            kept.append((item, w.hashes(), frozenset(Words([sentences[-1].encode()], lower=True, plain=True).hashes().tolist())))
    latent = np.array([space[_term(h)].sum(axis=0) for _, h, _ in kept], np.float32).reshape(len(kept), space.shape[1])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    own = [frozenset(k[1].tolist()) for k in kept]
    return Items([k[0] for k in kept], latent, [k[1] for k in kept], own, [k[2] for k in kept], *_rare_words([k[1] for k in kept], rarity))


def common_subsequence(item: np.ndarray, stretch: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    masks: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for x in stretch:
        hit = row & masks.get(x, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def _places(w: Words, h: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """``doc, item, lo, hi``: where the texts hold enough of an item's rarest words; ranges of one item do not meet."""
    # by 16 bits of the hash nearly all words are told apart from the rare ones
    maybe = np.zeros(1 << 16, bool)
    maybe[items.rare.astype(np.uint16)] = True
    at = np.flatnonzero(maybe[h.astype(np.uint16)])
    key = np.minimum(np.searchsorted(items.rare, h[at]), len(items.rare) - 1)
    same = items.rare[key] == h[at]
    at, key = at[same], key[same]
    often = np.bincount(key, minlength=len(items.rare))
    hits = np.bincount(items.holders, weights=np.repeat(often, np.diff(items.first)), minlength=len(items.ids))
    part = (np.cumsum(hits) // HITS).astype(np.int64)[items.holders]
    for p in np.unique(part):
        own = part == p
        first = np.concatenate([[0], np.cumsum(own)])[items.first]
        times = np.diff(first)[key]
        before = np.cumsum(times) - times
        index = np.repeat(first[key] - before, times) + np.arange(int(times.sum()))
        item, pos = np.divmod(np.sort(items.holders[own][index] * len(h) + np.repeat(at, times)), len(h))
        last = np.arange(len(pos)) + items.need[item] - 1
        some = np.flatnonzero(last < len(pos))
        last = last[some]
        reach = items.reach[item[some]]
        some = some[(item[last] == item[some]) & (pos[last] - pos[some] < reach) & (w.doc[pos[last]] == w.doc[pos[some]])]
        if not len(some):
            continue
        item, begin, end = item[some], pos[some], pos[some + items.need[item[some]] - 1]
        doc = w.doc[begin]
        lo = np.maximum(end - items.reach[item] + 1, w.first[doc])
        hi = np.minimum(begin + items.reach[item], w.first[doc + 1])
        new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])]))
        yield from zip(doc[new].tolist(), item[new].tolist(), lo[new].tolist(), hi[np.append(new[1:], len(hi)) - 1].tolist(), strict=True)


def _read(h: np.ndarray, lo: int, hi: int, item: np.ndarray, answer: frozenset, reach: int) -> tuple[float, float, int] | None:
    """``lcs, answered, begin`` of the best stretch of about ``reach`` words in a range that meets the limits."""
    own = np.unique(item)
    words = h[lo:hi]
    held = own[np.minimum(np.searchsorted(own, words), len(own) - 1)] == words
    count = np.concatenate([[0], np.cumsum(held)])
    starts = np.flatnonzero(held)
    starts = starts[count[np.minimum(starts + reach, len(words))] - count[starts] >= _least(item)]
    if not len(starts) or common_subsequence(item, words.tolist()) < _least(item):
        return None
    # stretches are a little longer than ``reach``, so that not every word has to begin one
    step = 1 + reach // 16
    best = None
    for a in (np.unique(starts // step) * step).tolist():
        stretch = words[a : a + reach + step].tolist()
        lcs = common_subsequence(item, stretch) / len(item)
        if lcs < SHARED:
            continue
        answered = len(answer.intersection(stretch)) / len(answer)
        if (lcs >= NEAR or answered >= ANSWERED) and (best is None or (lcs, answered) > best[:2]):
            best = lcs, answered, lo + a
            if lcs == 1:
                break
    return best


def search(texts: list[bytes | None], space: np.ndarray, items: Items) -> Iterator[tuple[int, int, float, float, float, int]]:
    """``text, item, cosine, lcs, answer, at`` of what the texts hold; the best stretch of each pair."""
    w = Words(texts, lower=True, plain=True)
    if not len(w) or not items.ids:
        return
    h = w.hashes()
    # every STEP-th word of each text begins a block; stretches are sums of blocks
    place = np.arange(len(w)) - w.first[w.doc]
    begin = np.flatnonzero(place % STEP == 0)
    doc_of, last = w.doc[begin], w.first[w.doc[begin] + 1]
    term = _term(h)
    grid = np.full((STEP, len(begin)), len(space), np.int32)  # what a short block lacks is a row of zeros
    grid[place % STEP, np.cumsum(place % STEP == 0) - 1] = term
    rows = np.concatenate([space, np.zeros((1, space.shape[1]), space.dtype)])
    blocks = np.zeros((len(begin), space.shape[1]), np.float32)
    some = np.empty_like(blocks)
    for column in grid:
        blocks += np.take(rows, column, axis=0, out=some, mode="clip")
    found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    stretch, length = blocks.copy(), 1
    for wanted in LENGTHS:
        while length < wanted:
            same = doc_of[length:] == doc_of[:-length]
            stretch[: len(same)] += np.multiply(blocks[length:], same[:, None], out=some[: len(same)])
            length += 1
        cosine = stretch @ items.latent.T
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", stretch, stretch)), 1e-9)
        near = np.flatnonzero(cosine.max(axis=1) >= COSINE * norm)
        cosine = cosine[near] / norm[near, None]
        row, item = np.nonzero(cosine >= COSINE)
        at = near[row]
        end = np.minimum(begin[at] + wanted * STEP, last[at])
        for doc, k, c, x, y in zip(doc_of[at].tolist(), item.tolist(), cosine[row, item].tolist(), begin[at].tolist(), end.tolist(), strict=True):
            found.setdefault((doc, k), []).append((c, x, y))
    read: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for doc, k, lo, hi in _places(w, h, items):
        got = _read(h, lo, hi, items.words[k], items.answers[k], int(items.reach[k]))
        if got:
            lcs, answered, a = got
            v = space[term[a : min(a + int(items.reach[k]), int(w.first[doc + 1]))]].sum(axis=0)
            cosine = float(v @ items.latent[k] / max(float(np.linalg.norm(v)), 1e-9))
            read[doc, k] = max(read.get((doc, k), (0.0,)), (lcs, answered, cosine, int(a - w.first[doc])))
    at, of_text = -1, frozenset()
    for doc, k in sorted(found.keys() | read.keys()):
        stretches = found.get((doc, k), [])
        item, answer, own = items.words[k], items.answers[k], items.own[k]
        best = read.get((doc, k))
        if best and best[0] == 1:
            stretches = []
        if stretches and doc != at:
            at, of_text = doc, frozenset(h[w.first[doc] : w.first[doc + 1]].tolist())
        if stretches and len(own & of_text) < SHARED * len(own):  # no stretch can hold more than the text
            stretches = []
        tried = set()
        for cosine, a, b in sorted(stretches, reverse=True):
            middle, reach = (a + b) // 2, max(len(item), b - a) // 2 + len(item) // 4 + STEP
            lo, hi = max(w.first[doc], middle - reach), min(w.first[doc + 1], middle + reach)
            if (lo // STEP, hi // STEP) in tried:
                continue
            tried.add((lo // STEP, hi // STEP))
            words = h[lo:hi].tolist()
            if len(own.intersection(words)) < SHARED * len(own):  # no subsequence can hold more
                continue
            lcs = common_subsequence(item, words) / len(item)
            answered = len(answer.intersection(words)) / len(answer)
            if lcs >= NEAR or lcs >= SHARED and answered >= ANSWERED:
                best = max(best or (0.0,), (lcs, answered, cosine, int(lo - w.first[doc])))
                if lcs == 1:
                    break
        if best:
            yield doc, k, best[2], best[0], best[1], best[3]


def _item_parts(benchmark: DataFrame) -> Iterator[list[tuple]]:
    part = []
    for r in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        part.append((r[0], r[1]))
        if len(part) == ITEMS_AT_ONCE:
            yield part
            part = []
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, answer, at``: what benchmark items the documents hold, and from which word on."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id long, item_id {kind}, cosine double, lcs double, answer double, at long"
    rarity, space = latent_space(rows)
    out = None
    for part in _item_parts(benchmark):
        items = fold_items(part, space, rarity)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch, texts in chunks(batches, most=SEARCHED):
                hits = list(search(texts, space, items))
                if not hits:
                    continue
                doc, k, cosine, lcs, answer, at = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array([items.ids[i] for i in k]), pa.array(cosine), pa.array(lcs), pa.array(answer), pa.array(at)],
                    names=["doc_id", "item_id", "cosine", "lcs", "answer", "at"],
                )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    rarity, space = latent_space(docs.select(F.col("text").cast("string")))
    out = docs
    for part in _item_parts(benchmark):
        items = fold_items(part, space, rarity)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch, texts in chunks(batches, most=SEARCHED):
                gone = {hit[0] for hit in search(texts, space, items)}
                yield batch.take(pa.array([i for i in range(len(texts)) if i not in gone], pa.int64()))

        out = out.mapInArrow(run, docs.schema)
    return out
