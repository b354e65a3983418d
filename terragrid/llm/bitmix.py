"""Language-model scores by online logistic context mixing of bit predictors.

A text is its words, A-Z lowered, and an end.  Words are written as the bits of a
Huffman code of bytes (a space behind each, a line feed for the end), and every bit is
predicted by several hashed contexts:

* the word so far, whatever its length (a trie of all words of the training texts);
* the last one, two and three bytes, in three tables of ``SLOTS`` hashed contexts;
* in the text itself, the word that stood behind the previous word, behind the
  previous two, and the last word with the same first ``HEAD`` bits.

Predictions are combined in the logistic domain.  Weights of the first four are gated
by how often the word so far was seen; they are fitted on all words of the training
texts by their counts, each without one of its own occurrences: bits whose predictions
lie in one cell of a fixed grid enter as their number and mean.  Weights of that mix and of the predictors
within the text are gated by which of them predict and how long they have been right;
they start afresh in each text and are learned while it is read, block by block, and
so are the offsets by which the mixed confidence is refined at last.  The sum of the
bits' costs is the score.

All counts come from all training texts.  On Spark: texts meet in chunks; each gives
its distinct words, whose counts are summed.  The vocabulary is cut into runs of the
sorted code, at keys from a sample; each run sums its part of the trie, and a few
numbers for each border complete the nodes that cross it.  So each distinct word of
the corpus is predicted twice, for the weights and with them.  Predictions go back to the
chunks that hold the word, where texts stream past them.  What is broadcast or fetched has
a fixed size (tables, cells, weights), or a few numbers for each run of ``RUN_WORDS`` words.

Defined results: null texts are empty and hold the end only; rows with a null id are
learned from; repeated rows count as often as they occur and score alike; without any
training text every count is 0; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terragrid.llm.vectors import Words, chunks, hashes_at, mix, small_batches
from terragrid.plans.sizing import stage, staged_rows

#: Bytes of text in a chunk; only its distinct words are held.
CHUNK_BYTES = 32 << 20
#: Bytes of text scored at once, and about how many words have their bits held.
SLICE, ROUND = 1 << 18, 30_000
#: Hashed contexts of each order.
SLOTS, ORDERS = 1 << 17, 3
#: Words of the vocabulary in one task, and cut candidates for each.
RUN_WORDS, KEYS_A_RUN = 100_000, 100
#: Words of all chunks that are packed together before they travel.
PACKED = 300_000
#: Texts, in bytes, that a task packs together before they travel to their chunks.
PACKED_BYTES = 8 << 20
#: The bits of a gate weigh as so many at most against equal weights, which decide where predictions say the same.
FITTED = 1 << 15
#: Limits between the cells of one prediction's logit, and parts of a logit in sums over a cell (whole numbers add up alike in any order).
EDGES, PARTS = (-5.0, -3.5, -2.25, -1.25, -0.5, 0.25, 1.0, 1.75, 2.5, 3.25, 4.0, 5.0, 6.5, 8.0, 10.0), 1 << 12
#: Bits of a word that have a trie and predictions within the text.
DEPTH = 64
#: First bits that the last predictor within the text waits for.
HEAD = 16
#: Bits read before weights are learned from them, and the step.
BLOCK, RATE = 1024, 0.1
#: Predictions are passed on in twelfths, as bytes.
SCALE = 12
#: Beyond this logit, either way, the first mix is final: such bits cost what it says and are not mixed again.
SETTLED = 5
SEEN_GATES, MATCH_GATES, SURE = 16, 32, 12
END = "\n"
_U64 = np.uint64


@dataclass(frozen=True)
class Code:
    """Prefix code of bytes: paths through the tree, flat, and where each byte's begins."""

    nodes: np.ndarray
    bits: np.ndarray
    start: np.ndarray
    length: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        # no byte is rarer than one in 2^16, so that paths stay short
        heap = [(max(int(c), int(counts.sum()) >> 16, 1), i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        child, fresh = {}, 256
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            child[fresh] = x, y
            heapq.heappush(heap, (a + b, fresh, fresh))
            fresh += 1
        paths: dict[int, list[tuple[int, int]]] = {heap[0][2]: []}
        for node in range(fresh - 1, 255, -1):
            for bit, below in enumerate(child[node]):
                paths[below] = [*paths[node], (node - 256, bit)]
        each = [paths[i] for i in range(256)]
        length = np.array([len(p) for p in each])
        value = np.array([int("".join(str(b) for _, b in p), 2) for p in each], _U64)
        flat = [s for p in each for s in p]
        return Code(np.array([n for n, _ in flat], np.uint8), np.array([b for _, b in flat], np.uint8), np.cumsum(length) - length, length, value)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices ``start[i], start[i] + 1, ...`` of ``size[i]`` entries each, one after the other."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(int(size.sum()))


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins, with the end."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", kind)
    return data[at[0] : at[-1]], at - at[0]


class Coded:
    """Words as bytes with their ends, and their bits."""

    def __init__(self, words: pa.Array | list[bytes], code: Code):
        words = pa.array(words, pa.binary()) if isinstance(words, list) else words.cast(pa.binary())
        self.is_end = pc.equal(words, b"\n").to_numpy(zero_copy_only=False)
        space = pc.if_else(pa.array(self.is_end), b"", b" ")
        self.data, at = _flat(pc.binary_join_element_wise(words, space, b""), np.uint8)
        self.start, self.size, self.code = at[:-1], np.diff(at), code
        size = self.size
        length = code.length[self.data]
        ends = np.concatenate([[0], np.cumsum(length)])
        self.first_bit = ends[self.start]
        self.n_bits = ends[self.start + size] - self.first_bit
        self._length = length
        at = ends[:-1] - np.repeat(self.first_bit, size)
        over = at + length - DEPTH
        shifted = np.where(over <= 0, code.value[self.data] << np.clip(-over, 0, 63).astype(_U64), code.value[self.data] >> np.clip(over, 0, 63).astype(_U64))
        shifted[at >= DEPTH] = 0
        self.key = np.add.reduceat(shifted, self.start) if len(words) else np.zeros(0, _U64)

    def hashes(self) -> np.ndarray:
        """Hash of each word, of the end too (which is no word: a number of its own)."""
        return np.where(self.is_end, END_HASH, hashes_at(self.data, self.start, self.start + self.size - ~self.is_end))

    def slots(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For each bit of all words: the slot of each order, and the bit."""
        path = ragged(self.code.start[self.data], self._length)
        node, bit = self.code.nodes[path], self.code.bits[path]
        begin = np.zeros(len(self.data), bool)
        begin[self.start] = True
        word = np.cumsum(begin) - 1
        context = np.zeros(len(self.data), _U64)
        out = []
        for k in range(1, ORDERS + 1):
            before = np.arange(len(self.data)) - k
            inside = before >= self.start[word]
            byte = np.where(inside, self.data[np.maximum(before, 0)], np.where(before == self.start[word] - 1, 0x20, 0))
            context = (context << _U64(8)) | byte.astype(_U64)
            out.append((mix(np.repeat(context, self._length) * _U64(512) + node + _U64(k << 40)) & _U64(SLOTS - 1)).astype(np.int64))
        return out, bit


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of 64-bit values."""
    high, low = (x >> _U64(32)).astype(np.float64), (x & _U64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]).astype(np.int64)


class Run:
    """A sorted run of the vocabulary: counts of all words that share the first bits of each."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.key, self.count = key, count
        self.common = np.zeros(len(key), np.int64)
        self.common[1:] = _leading(key[1:] ^ key[:-1])

    def border(self) -> tuple[list[int], list[int]]:
        """For 0 to DEPTH bits: counts of the words that share them with the first, and with the last word."""
        out = []
        for end in (self.key[0], self.key[-1]):
            own = np.bincount(_leading(self.key ^ end), weights=self.count, minlength=DEPTH + 1)
            out.append(np.cumsum(own[::-1])[::-1].astype(np.int64).tolist())
        return out[0], out[1]

    def nodes(self, left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
        """Counts at the node of each word after 0 to DEPTH bits; ``left`` and ``right`` come from other runs."""
        for d in range(DEPTH + 1):
            begin = np.flatnonzero(self.common < d)
            if not len(begin) or begin[0] != 0:
                begin = np.concatenate([[0], begin])
            total = np.add.reduceat(self.count, begin)
            total[0] += left[d]
            total[-1] += right[d]
            yield np.repeat(total, np.diff(np.concatenate([begin, [len(self.key)]])))


class Borders:
    """First and last key of each run and what they share, by which a run learns what the others hold."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["run"])
        self.at = {r["run"]: i for i, r in enumerate(rows)}
        self.first, self.last = (np.array([r[c] for r in rows], np.int64).view(_U64) for c in ("first", "last"))
        self.with_first, self.with_last = (np.array([r[c] for r in rows], np.int64).reshape(len(rows), DEPTH + 1) for c in ("with_first", "with_last"))

    def beside(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words before and behind a run that share 0 to DEPTH bits with its first and last word."""
        i, depth = self.at[run], np.arange(DEPTH + 1)
        out = []
        for mine, theirs, shared in ((self.first[i], self.last[:i], self.with_last[:i]), (self.last[i], self.first[i + 1 :], self.with_first[i + 1 :])):
            common = _leading(theirs ^ mine)
            out.append((shared * (common[:, None] >= depth)).sum(axis=0).astype(np.int64))
        return out[0], out[1]

    def complete(self, run: int, key: int, nodes: np.ndarray) -> np.ndarray:
        """Counts at the nodes of one word, from those of its own run."""
        left, right = self.beside(run)
        i, depth = self.at[run], np.arange(DEPTH + 1)
        mine = np.array([key], np.int64).view(_U64)
        return nodes + left * (_leading(mine ^ self.first[i]) >= depth) + right * (_leading(mine ^ self.last[i]) >= depth)


def _stretch(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    return np.log((yes + 0.4) / (no + 0.4)).astype(np.float32)


def _seen_gate(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n.astype(np.float64))[1], SEEN_GATES - 1)


@dataclass
class Tables:
    """Counts of ones and of all at the hashed contexts of each order."""

    ones: np.ndarray
    every: np.ndarray

    def features(self, coded: Coded, yes: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Logits of the actual bit by all predictors; ``yes`` and ``seen`` are counts of the trie at each bit."""
        slots, bit = coded.slots()
        out = np.empty((len(bit), 1 + ORDERS), np.float32)
        out[:, 0] = _stretch(yes, seen - yes)
        at = bit.astype(np.int64) * SLOTS
        for k, slot in enumerate(slots):
            out[:, k + 1] = self.logits[k].take(at + slot, mode="clip")
        return out

    @cached_property
    def logits(self) -> np.ndarray:
        """Logits of a bit at the contexts of each order: first of zeros, then of ones."""
        zeros = self.every - self.ones
        return np.concatenate([_stretch(zeros, self.every - zeros), _stretch(self.ones, zeros)], axis=1)


#: Cell of a logit in eighths, from -32 to 32.
_CELL = np.searchsorted(np.array(EDGES), np.arange(-256, 257) / 8, side="right").astype(np.int32)


def cells(x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Number of the gate and of the cells of all logits of each bit."""
    out = gate.astype(np.int32)
    for column in x.T:
        out = out * np.int32(len(EDGES) + 1) + _CELL[np.clip(np.floor(column * 8), -256, 256).astype(np.int32) + 256]
    return out


def fit(x: np.ndarray, gate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights for each gate by Newton's method: the actual bit has logit ``x @ w``, ``weight`` times."""
    out = np.full((SEEN_GATES, x.shape[1]), 1 / x.shape[1])
    for g in np.unique(gate):
        a, c, w = x[gate == g].astype(np.float64), weight[gate == g].astype(np.float64), out[g]
        c *= min(1.0, FITTED / c.sum())
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hessian = (a * (c * p * (1 - p))[:, None]).T @ a + np.eye(a.shape[1])
            step = np.linalg.solve(hessian, a.T @ (c * (1 - p)) - (w - 1 / a.shape[1]))
            w = w + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        out[g] = w
    return out


#: A case is what the predictors within the text say of a bit: three bits tell which of them say the wrong one, three which of them predict, two how far the word is.
_WRONG = np.arange(8)[:, None] >> np.arange(3) & 1
_LIVE = (np.arange(MATCH_GATES)[:, None] >> np.arange(3) & 1).astype(np.float32)
_SAYS = (1 - 2 * _WRONG).astype(np.float32)
CASES = MATCH_GATES * len(_SAYS)


class TextScores:
    """Costs in nats of the bits of some texts, weights learned in each of them on its own."""

    def __init__(self, n: int):
        self.weight = np.zeros((n, MATCH_GATES, 4), np.float32)
        self.weight[..., 0], self.weight[..., 1:] = 1, 0.7
        self.square = np.ones(self.weight.shape, np.float32)
        self.offset, self.offset_square = np.zeros((n, SURE), np.float32), np.ones((n, SURE), np.float32)
        self.cost = np.zeros(n)

    def read(self, text: np.ndarray, z: np.ndarray, case: np.ndarray, ends: np.ndarray) -> None:
        """Score bits and learn from them, up to each of ``ends`` at a time.

        ``z`` is the logit of the actual bit by the training texts, ``case`` what the predictors within the
        text say of it; the texts of a step are the first ones.  A case's logit is the same for all its bits in
        a text and step, so it is added up once, and so is what its bits teach.
        """
        at, cells, sures = 0, text * CASES + case, text * (2 * SURE)
        for end in ends.tolist():
            x, cell, n = z[at:end], cells[at:end], int(text[end - 1]) + 1
            weight = self.weight[:n]
            said = (weight[..., 1:] * _LIVE)[:, :, None] * _SAYS
            mixed = np.repeat(weight[..., 0].ravel(), len(_SAYS)).take(cell, mode="clip")
            mixed *= x
            mixed += said[..., 0].ravel().take(cell, mode="clip")
            mixed += (said[..., 1] + said[..., 2]).ravel().take(cell, mode="clip")
            sure = np.abs(mixed)
            sure *= 1.5
            place = np.minimum(sure, SURE - 1, out=sure).astype(np.int64)
            place += sures[at:end]
            place += np.signbit(mixed).view(np.uint8) * np.uint8(SURE)
            mixed += np.concatenate([self.offset[:n], -self.offset[:n]], axis=1).ravel().take(place, mode="clip")
            np.negative(mixed, out=mixed)
            np.maximum(mixed, -16, out=mixed)
            odds = np.exp(np.minimum(mixed, 16, out=mixed), out=mixed)
            whole = odds + 1
            miss = odds / whole  # one less the probability of the actual bit
            x = (miss * x).astype(np.float64)
            miss = miss.astype(np.float64)
            k = n * CASES
            self.cost[:n] += np.bincount(text[at:end], weights=np.log(whole, out=whole), minlength=n)
            rise = np.empty(weight.shape, np.float32)
            taught = np.bincount(cell, weights=miss, minlength=k).reshape(-1, len(_SAYS))
            rise[..., 1:] = (taught @ _SAYS).reshape(n, MATCH_GATES, 3) * _LIVE
            back = np.bincount(place, weights=miss, minlength=n * 2 * SURE).reshape(n, 2, SURE)
            rise[..., 0] = np.bincount(cell, weights=x, minlength=k).reshape(n, MATCH_GATES, -1).sum(axis=2)
            self.square[:n] += rise * rise
            weight += RATE * rise / np.sqrt(self.square[:n])
            rise = (back[:, 0] - back[:, 1]).astype(np.float32)
            self.offset_square[:n] += rise * rise
            self.offset[:n] += RATE * rise / np.sqrt(self.offset_square[:n])
            at = end


def _groups(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last earlier place with an equal value, -1 where there is none, and a number for its value.

    ``value`` must be small enough to be sorted together with its place.
    """
    n = len(value)
    shift = max(1, n - 1).bit_length()
    if n and int(value.max()) >> (63 - shift):
        value = np.unique(value, return_inverse=True)[1]
    both = np.sort(value << shift | np.arange(n))
    order, both = both & ((1 << shift) - 1), both >> shift
    same = both[1:] == both[:-1]
    earlier, number = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    earlier[order[1:][same]] = order[:-1][same]
    number[order[1:]] = np.cumsum(~same)
    return earlier, number


def score_texts(token: np.ndarray, text: np.ndarray, n: int, lexicon: Lexicon) -> np.ndarray:
    """Nats of each of ``n`` texts; ``token`` are rows of the lexicon, texts one after the other."""
    key = lexicon.key[token]
    # words are told apart by their rows; row 0 stands for what is before a text
    word = np.concatenate([[0], token[:-1] + 1])
    first = np.searchsorted(text, np.arange(n))
    word[first[first < len(word)]] = 0
    before = np.concatenate([[0], word[:-1]])
    before[first[first < len(word)]] = 0
    rows = len(lexicon.hash) + 1
    one, number = _groups(text * rows + word)
    two, _ = _groups(number * rows + before)
    three, _ = _groups(text << HEAD | (key >> _U64(64 - HEAD)).astype(np.int64))
    common = [np.where(at >= 0, np.minimum(_leading(key ^ key[at]), DEPTH), -1).astype(np.int8) for at in (one, two, three)]
    bits = lexicon.n_open[token]
    ends = np.concatenate([[0], np.cumsum(bits)])
    in_text = ends[:-1] - ends[first[text]]
    # the longest text first: the texts that a block holds are then the first ones
    length = np.bincount(text, weights=bits, minlength=n)
    longest = np.argsort(-length, kind="stable")
    label = np.empty(n, np.int64)
    label[longest] = np.arange(n)
    label, block = label[text], in_text // BLOCK
    order = np.lexsort((label, block))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]])
    scores, lo = TextScores(n), 0
    while lo < len(edges) - 1:  # as many blocks at once as hold about ROUND words
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + ROUND, side="right")) - 1)
        some = order[edges[lo] : edges[hi]]
        size = bits[some]
        stops = np.cumsum(size)
        at = np.arange(stops[-1]) + np.repeat(lexicon.start[token[some]] - stops + size, size)
        j, z = lexicon.j.take(at, mode="clip"), lexicon.z.take(at, mode="clip").astype(np.float32)
        z *= np.float32(1 / SCALE)
        wrong, live, right = np.zeros(len(j), np.uint8), np.zeros(len(j), np.uint8), j < DEPTH
        for i, c in enumerate(common):
            c = np.repeat(c[some], size)
            says = (j <= c) & right
            if i == 2:
                says &= j >= HEAD
            live |= says.view(np.uint8) << np.uint8(i)
            says &= j == c
            wrong |= says.view(np.uint8) << np.uint8(i)
        depth = np.minimum(j >> np.int8(3), 3).view(np.uint8) * (live > 0)
        if len(at):
            scores.read(np.repeat(label[some], size), z, wrong | live << np.uint8(3) | depth << np.uint8(6), np.unique(stops[edges[lo + 1 : hi + 1] - edges[lo] - 1]))
        lo = hi
    out = np.empty(n)
    out[longest] = scores.cost
    return out + np.bincount(text, weights=lexicon.settled[token], minlength=n)


class Lexicon:
    """The words of a chunk, sorted by hash: their counts, keys, lengths and open bits; the cost of settled ones is known.

    ``parts`` are batches of word, c, z, a few thousand words each.
    """

    def __init__(self, parts: list[pa.RecordBatch], code: Code):
        cost = np.log1p(np.exp(-np.arange(-128, 128) / SCALE)).astype(np.float32)
        columns, z, places = [], [], []
        while parts:
            batch = parts.pop()
            coded = Coded(batch.column("word"), code)
            bits, _ = _flat(batch.column("z"), np.int8)
            first = np.cumsum(coded.n_bits) - coded.n_bits
            open_ = np.abs(bits) < SETTLED * SCALE
            settled = np.add.reduceat(np.where(open_, np.float32(0), cost[bits.astype(np.int16) + 128]), first)
            n_open = np.add.reduceat(open_.astype(np.int64), first)
            columns.append((coded.hashes(), coded.key, n_open, batch.column("c").to_numpy(), coded.size, settled))
            z.append(bits[open_])
            places.append(np.minimum(np.arange(len(bits)) - np.repeat(first, coded.n_bits), DEPTH + 1).astype(np.int8)[open_])
        h, key, n_open, count, length, settled = (np.concatenate(c) for c in zip(*columns, strict=True))
        self.z, self.j = np.concatenate(z), np.concatenate(places)
        order = np.argsort(h)
        start = np.cumsum(n_open) - n_open
        self.hash, self.key, self.n_open, self.count, self.length, self.start, self.settled = h[order], key[order], n_open[order], count[order], length[order], start[order], settled[order]

    def rows(self, h: np.ndarray) -> np.ndarray:
        """Rows of words by their hashes; equal words of a text are looked up once."""
        some, inverse = np.unique(h, return_inverse=True)
        return np.searchsorted(self.hash, some)[inverse]


END_HASH = _U64(0x5851F42D4C957F2D)


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every token, the end of each text behind its words."""
    w = Words(texts, lower=True)
    at = w.first[1:]  # ends stand before the next text's first word
    h = np.insert(w.hashes(), at, END_HASH)
    return h, np.insert(w.doc, at, np.arange(len(texts)))


def chunk_words(rows: DataFrame) -> DataFrame:
    """``chunk, word, n`` of ``rows`` (chunk, text, learn): distinct words of each chunk, ``n`` of them in training texts."""
    schema = StructType().add("chunk", "integer").add("word", "string").add("n", "long")
    arrow = to_arrow_schema(schema)

    def fold(parts: list[tuple]) -> tuple:
        h, chunk, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        words = pa.concat_arrays([p[3] for p in parts])
        _, first, inverse = np.unique(h ^ mix(chunk.astype(_U64)), return_index=True, return_inverse=True)
        return h[first], chunk[first], np.bincount(inverse, weights=n).astype(np.int64), words.take(pa.array(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch, texts in chunks(batches):
            w = Words(texts, lower=True)
            doc = w.doc
            chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
            h = np.concatenate([w.hashes(), np.full(len(texts), END_HASH)])
            doc = np.concatenate([doc, np.arange(len(texts))])
            key, first, inverse = np.unique(h ^ mix(chunk[doc].astype(_U64)), return_index=True, return_inverse=True)
            # the bytes of each first occurrence, one after the other; an end is the last line feed of the data
            start, end = np.append(w.start, len(w.data) - 1), np.append(w.end, len(w.data))
            at = np.minimum(first, len(w))
            size = end[at] - start[at]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            spelt = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(w.data[ragged(start[at], size)].tobytes()))
            parts.append((h[first], chunk[doc][first], np.bincount(inverse, weights=learn[doc]).astype(np.int64), spelt))
            held += len(key)
            if held > 1_000_000:
                parts = [fold(parts)]
                held = len(parts[0][0])
                if held > 800_000:  # many chunks in one task: what is held goes out, and counts are summed later
                    yield from _words_out(parts.pop(), arrow)
                    held = 0
        if parts:
            yield from _words_out(fold(parts), arrow)

    return rows.mapInArrow(run, schema)


def _words_out(part: tuple, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    _, chunk, n, words = part
    yield from pa.table([pa.array(chunk, pa.int32()), words, pa.array(n)], schema=arrow).to_batches(max_chunksize=50_000)


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def byte_code(vocabulary: DataFrame) -> Code:
    """Huffman code of the bytes of all training texts."""
    schema = StructType().add("byte", "integer").add("n", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for b in batches:
            words, c = _as_bytes(b.column("word")), b.column("c").to_numpy()
            size = np.array([len(w) for w in words])
            total += np.bincount(np.frombuffer(b"".join(words), np.uint8), weights=np.repeat(c, size), minlength=256)
            total[0x20] += c.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total.astype(np.int64))], names=["byte", "n"])

    counts = np.zeros(256, np.int64)
    for r in vocabulary.select("word", "c").mapInArrow(run, schema).groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        counts[r["byte"]] = r["n"]
    return Code.of(counts)


def order_tables(vocabulary: DataFrame, code: Code) -> Tables:
    """Counts of the hashed contexts over all training texts: every word once, by its count."""
    schema = StructType().add("at", "integer").add("ones", "long").add("every", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, every = np.zeros((ORDERS, SLOTS)), np.zeros((ORDERS, SLOTS))
        for whole in batches:
            for lo in range(0, whole.num_rows, 20_000):
                b = whole.slice(lo, 20_000)
                coded = Coded(b.column("word"), code)
                slots, bit = coded.slots()
                c = np.repeat(b.column("c").to_numpy(), coded.n_bits)
                for k, at in enumerate(slots):
                    every[k] += np.bincount(at, weights=c, minlength=SLOTS)
                    ones[k] += np.bincount(at, weights=c * bit, minlength=SLOTS)
        flat = np.flatnonzero(every.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int32()), pa.array(ones.ravel()[flat].astype(np.int64)), pa.array(every.ravel()[flat].astype(np.int64))], names=["at", "ones", "every"])

    sums = vocabulary.filter("c > 0").select("word", "c").mapInArrow(run, schema).groupBy("at").agg(F.sum("ones").alias("ones"), F.sum("every").alias("every")).toArrow()
    out = np.zeros((2, ORDERS * SLOTS))  # ORDERS * SLOTS rows at most
    at = sums["at"].to_numpy()
    out[0, at], out[1, at] = sums["ones"].to_numpy(), sums["every"].to_numpy()
    return Tables(*(x.reshape(ORDERS, SLOTS).astype(np.float32) for x in out))


def _sorted_run(table: pa.Table) -> tuple[pa.Table, Run]:
    table = table.sort_by("key").combine_chunks()
    key = table["key"].to_numpy().view(_U64) ^ _U64(1 << 63)
    return table, Run(key, table["c"].to_numpy())


class Predictors:
    """Everything that tells how the bits of a word are predicted by the training texts."""

    def __init__(self, vocabulary: DataFrame):
        """``vocabulary``: word, c (occurrences in training texts)."""
        self.code = code = byte_code(vocabulary)
        keyed = StructType([*vocabulary.select("word", "c").schema.fields]).add("key", "long")

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                coded = Coded(b.column("word"), code)
                # unsigned order as signed numbers
                yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array((coded.key ^ _U64(1 << 63)).view(np.int64))], names=["word", "c", "key"])

        self.words = stage(vocabulary.select("word", "c").mapInArrow(keys, keyed), "vocabulary")
        self.tables = order_tables(self.words, code)
        n = staged_rows(self.words)
        runs = -(-n // RUN_WORDS) if n else 1
        self.cuts = np.zeros(0, np.int64)
        if runs > 1:
            share = min(1.0, runs * KEYS_A_RUN / n)
            some = self.words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("key").toArrow()["key"].to_numpy()
            self.cuts = np.unique(np.quantile(some, np.arange(1, runs) / runs, method="nearest"))
        self._fit()

    def in_runs(self) -> DataFrame:
        cuts = [int(c) for c in self.cuts]
        total = self.words.withColumn("run", F.lit(0))
        if cuts:
            bounds = np.array(cuts, np.int64)

            @F.pandas_udf("int")
            def run_of(key):
                import pandas as pd

                return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

            total = self.words.withColumn("run", run_of("key"))
        return total

    def _fit(self) -> None:
        total = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
        self.n, self.v = total["n"], total["v"]
        schema = "run int, first long, last long, with_first array<bigint>, with_last array<bigint>, pack binary"

        def packed(table: pa.Table) -> pa.Table:
            number = table["run"][0].as_py()
            table, run = _sorted_run(table)
            row = (number, *run.key[[0, -1]].view(np.int64).tolist(), *run.border(), _stream(table.select(["word", "c", "key"])))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["run", "first", "last", "with_first", "with_last", "pack"])

        # the runs are sorted and laid down once: the passes over them shuffle nothing
        some = self.in_runs().repartition(len(self.cuts) + 1, "run")
        self.runs = stage(some.groupBy("run").applyInArrow(packed, schema), "runs")
        self.borders = Borders(self.runs.drop("pack").collect())  # a row for each run
        self.weights = self._weights()

    def _weights(self) -> np.ndarray:
        """Weights of the first mix, from the bits of all words of the training texts by their counts."""
        shared = self.words.sparkSession.sparkContext.broadcast((self.code, self.tables, self.borders))  # fixed, and about 1 KB a run
        n = SEEN_GATES * (len(EDGES) + 1) ** (1 + ORDERS)
        names = ["n", *(f"x{k}" for k in range(1 + ORDERS))]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, tables, borders = shared.value
            total = np.zeros((len(names), n))
            for table, run, nodes in _runs_of(batches, borders):
                learned = np.flatnonzero(run.count > 0)
                for lo in range(0, len(learned), 10_000):
                    some = learned[lo : lo + 10_000]
                    coded = Coded(_one(table["word"].take(pa.array(some))), code)
                    yes, seen = at_bits(nodes[some] - 1, coded.n_bits)  # one occurrence is the one to be predicted
                    x = tables.features(coded, np.maximum(yes, 0), np.maximum(seen, 0))
                    cell, c = cells(x, _seen_gate(np.maximum(seen, 0))), np.repeat(run.count[some], coded.n_bits)
                    total[0] += np.bincount(cell, weights=c, minlength=n)
                    for k in range(1 + ORDERS):
                        total[k + 1] += np.bincount(cell, weights=c * np.rint(x[:, k] * PARTS), minlength=n)
            at = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(t[at].astype(np.int64)) for t in total)], names=["cell", *names])

        schema = "cell int, " + ", ".join(f"{c} long" for c in names)
        parts = self.runs.select("run", "pack").mapInArrow(count, schema)
        sums = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).toArrow().sort_by("cell")  # n rows at most
        c = sums["n"].to_numpy()
        x = np.stack([sums[name].to_numpy() / (c * float(PARTS)) for name in names[1:]], axis=1)
        return fit(x, sums["cell"].to_numpy() // (len(EDGES) + 1) ** (1 + ORDERS), c)

    def predictions(self) -> DataFrame:
        """``word, c, z``: the logit of each actual bit, in bytes."""
        shared = self.words.sparkSession.sparkContext.broadcast((self.code, self.tables, self.weights, self.borders))  # fixed, and about 1 KB a run

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, tables, weights, borders = shared.value
            for table, _, nodes in _runs_of(batches, borders):
                for lo in range(0, table.num_rows, 10_000):
                    part = table.slice(lo, 10_000).combine_chunks()
                    coded = Coded(_one(part["word"]), code)
                    yes, seen = at_bits(nodes[lo : lo + 10_000], coded.n_bits)
                    x, gate = tables.features(coded, yes, seen), _seen_gate(seen)
                    z = sum(x[:, k] * weights[:, k].take(gate) for k in range(1 + ORDERS))
                    data, ends = np.clip(np.rint(z * SCALE), -127, 127).astype(np.int8).tobytes(), np.cumsum(coded.n_bits).tolist()
                    out = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([_one(part["word"]), _one(part["c"]), pa.array(out, pa.binary())], names=["word", "c", "z"])

        return self.runs.select("run", "pack").mapInArrow(predict, "word string, c long, z binary")


def _runs_of(batches: Iterator[pa.RecordBatch], borders: Borders) -> Iterator[tuple[pa.Table, Run, np.ndarray]]:
    """Words of each run (run, pack), and the counts at the nodes of each."""
    for batch in batches:
        for number, pack in zip(batch.column("run").to_pylist(), batch.column("pack"), strict=True):
            table = pa.ipc.open_stream(pack.as_buffer()).read_all()
            run = Run(table["key"].to_numpy().view(_U64) ^ _U64(1 << 63), table["c"].to_numpy())
            yield table, run, np.stack(list(run.nodes(*borders.beside(number))), axis=1)


def _stream(table: pa.Table) -> bytes:
    """A compressed stream of record batches."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def at_bits(nodes: np.ndarray, n_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts behind and at the node of each bit of each word; 0 beyond DEPTH bits."""
    wide = np.minimum(n_bits, DEPTH)
    at = ragged(np.arange(len(n_bits)) * (DEPTH + 1), wide)
    flat = nodes.ravel()
    yes, seen = flat.take(at + 1, mode="clip"), flat.take(at, mode="clip")
    if (n_bits > DEPTH).any():
        shallow = ragged(np.cumsum(n_bits) - n_bits, wide)
        out = np.zeros((2, int(n_bits.sum())), np.int64)
        out[0, shallow], out[1, shallow] = yes, seen
        yes, seen = out
    return yes, seen


def _chunks_of(docs: DataFrame) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    cores = spark.sparkContext.defaultParallelism
    n = max(1, -(-size // CHUNK_BYTES), min(cores, size >> 21))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def packs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows of each chunk as compressed record batches: ``chunk, pack``."""

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by("chunk").combine_chunks()
        chunk = table["chunk"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        body = table.select(columns)
        done = [_stream(body.slice(lo, hi - lo)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[edges[:-1]], pa.int32()), pa.array(done, pa.binary())], names=["chunk", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n, size = n + batch.num_rows, size + batch.nbytes
            if n >= PACKED or "text" in columns and size >= PACKED_BYTES:
                yield from out(held)
                held, n, size = [], 0, 0
        if held:
            yield from out(held)

    return rows.select("chunk", *columns).mapInArrow(run, "chunk int, pack binary")


def scores(docs: DataFrame, learn: Column) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text) by a model of those that ``learn`` names.

    Returns ``doc_id, learned, n_tokens, n_known, train_tokens, base_score, n_bytes, bits,
    score``: tokens that training texts hold, the log10 probability by their counts alone, the
    model's bits for the ``n_bytes`` of the words and their ends, and as a log10 probability.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    small_batches(docs.sparkSession)
    rows, n = _chunks_of(rows)
    lexicon = stage(chunk_words(rows.select("chunk", "text", "learn").repartition(n, "chunk")), "lexicon")
    model = Predictors(stage(lexicon.groupBy("word").agg(F.sum("n").alias("c")), "words"))
    code, total, base = model.code, model.n, math.log10(model.n + 0.5 * (model.v + 1))
    known = packs(lexicon.select("chunk", "word").join(model.predictions(), "word"), ["word", "c", "z"]).withColumn("kind", F.lit(0))
    read = packs(rows, ["text", "doc_id", "learn"]).withColumn("kind", F.lit(1))
    both = known.unionByName(read).repartition(n, "chunk").sortWithinPartitions("chunk", "kind")
    schema = StructType([docs.schema["doc_id"]]).add("learned", "boolean")
    for c in ("n_tokens", "n_known", "train_tokens"):
        schema = schema.add(c, "long")
    schema = schema.add("base_score", "double").add("n_bytes", "long").add("bits", "double").add("score", "double")
    arrow = to_arrow_schema(schema)

    def scored(batch: pa.RecordBatch, texts: list[bytes], known: Lexicon) -> pa.RecordBatch:
        h, text = tokens_of(texts)
        token = known.rows(h)
        c = known.count[token]
        per = lambda w: np.bincount(text, weights=w, minlength=len(texts))
        nats = score_texts(token, text, len(texts), known)
        size = per(known.length[token])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("learn"), pa.array(per(np.ones(len(h))).astype(np.int64)), pa.array(per(c > 0).astype(np.int64)), pa.array(np.full(len(texts), total)),
                pa.array(per(np.log10(c + 0.5) - base)), pa.array(size.astype(np.int64)), pa.array(nats / math.log(2)), pa.array(-nats / math.log(10)),
            ],
            schema=arrow,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None
        for whole in batches:
            chunk = whole.column("chunk").to_numpy()
            kind = whole.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(chunk)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = whole.slice(lo, hi - lo)
                if lo == hi:
                    continue
                if chunk[lo] != now:
                    now, held, known = chunk[lo], [], None
                if kind[lo] == 0:
                    for pack in part.column("pack"):
                        held += pa.ipc.open_stream(pack.as_buffer()).read_all().to_batches(max_chunksize=20_000)
                    continue
                if known is None:
                    known = Lexicon(held, code)
                for pack in part.column("pack"):
                    some = pa.ipc.open_stream(pack.as_buffer()).read_all().combine_chunks().to_batches()
                    for batch, texts in chunks(iter(some), most=SLICE):
                        yield scored(batch, texts, known)

    return both.mapInArrow(run, schema)


def corpus_scores(docs: DataFrame) -> DataFrame:
    """:func:`scores` learned from the documents whose crc32 of the id, modulo 5, is not 1."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    out = scores(docs, ~held)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits", "n_bytes")
