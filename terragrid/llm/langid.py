"""Language identification: averaged hashed subword embeddings with a linear softmax.

Every run of 2, 3 and 4 bytes of the lower-cased text, and every word, is
hashed to a row of an embedding table; a text is the mean of its rows, and a
linear layer with softmax gives the languages.  Both are trained by stochastic
gradient descent in numpy, on a bounded sample of labelled rows.  A temperature
fitted on rows kept from the training makes the highest probability a score;
texts scored below the threshold found on the same rows are rejected.

After training, table and layer are one product, a row of logits per bucket
(``buckets x languages`` floats, a fixed size), so a text costs one histogram
of its buckets.  That product is all that tasks receive.

Defined results: ``und`` and score 0 for a null text or one without a letter,
rejected; languages are the non-null labels of the sample, ties go to the first
in code point order; without any labelled row every text is ``und``; repeated
rows are predicted alike; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terragrid.llm.text import free_name
from terragrid.llm.vectors import chunks, small_batches

BUCKETS = 1 << 15
DIM = 16
#: At most so many labelled rows are fetched for training, whole texts.
SAMPLE_ROWS = 3000
#: Training sees a run of so many characters of each sampled text, taken at random, and a few words beside it.
TRAIN_CHARS = 2000
EPOCHS = 6
UNKNOWN = "und"
#: Share of rightly named texts that the threshold may reject.
REJECTED_RIGHT = 0.0005
#: Bytes hashed at once; bounds memory for very long texts.
SPAN = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")


def _spread(h: np.ndarray) -> np.ndarray:
    """Multiplicative hash of 32-bit values to buckets."""
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


def subwords(data: bytes) -> np.ndarray:
    """Bucket of every run of 2, 3 and 4 bytes; spaces mark the edges of words."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = b[:-1] | b[1:] << np.uint32(8)
    three = two[:-1] | b[2:] << np.uint32(16)
    four = three[:-1] | b[3:] << np.uint32(24)
    return np.concatenate([_spread(two ^ np.uint32(0x9E3779B9)), _spread(three ^ np.uint32(0x85EBCA6B)), _spread(four)])


def histogram(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    data = b" " + text.lower().encode("utf-8", "replace") + b" "
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), SPAN):  # runs over a border of spans are seen by the overlap
        total += np.bincount(subwords(data[at : at + SPAN + 3]), minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logits: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = (means + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def mean_logits(self, text: str) -> np.ndarray:
        data = b" " + text.lower().encode("utf-8", "replace") + b" "
        if len(data) < 2048:
            ids = subwords(data)
            return self.logits[ids].mean(axis=0)
        counts = histogram(text)
        return counts.astype(np.float32) @ self.logits / max(1, counts.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit on ``(text, lang)`` rows; every fifth row is kept for calibration."""
    rows = [(t, lang) for t, lang in rows if t and _LETTER.search(t)]
    langs = tuple(sorted({lang for _, lang in rows}))
    if not langs:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    # short pieces beside the whole texts, so that short documents are seen in training as well;
    # kept as bytes, since the buckets of a piece take twelve times as much of the driver's memory
    samples: list[tuple[bytes, int, bool]] = []
    for i, (text, lang) in enumerate(rows):
        held = i % 5 == 0
        words = text.split()
        at = int(rng.integers(0, max(1, len(words) - 12)))
        run = int(rng.integers(0, max(1, len(text) - TRAIN_CHARS)))
        pieces = [text[run : run + TRAIN_CHARS], " ".join(words[at : at + int(rng.integers(1, 13))])]
        for piece in pieces:
            data = b" " + piece.lower().encode("utf-8", "replace") + b" "
            samples.append((data, langs.index(lang), held))
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    fit = [s for s in samples if not s[2]]
    steps, done, size = max(1, EPOCHS * len(fit) // 16), 0, 16
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for start in range(0, len(order), size):
            some = [(subwords(fit[i][0]), *fit[i][1:]) for i in order[start : start + size]]
            x = np.stack([table[ids].mean(axis=0) for ids, _, _ in some])
            y = np.array([k for _, k, _ in some])
            err = _softmax(x @ layer + bias)
            err[np.arange(len(y)), y] -= 1
            rate = np.float32(0.5 * (1 - done / (steps + 1)))
            back = err @ layer.T
            layer -= rate * (x.T @ err) / len(y)
            bias -= rate * err.mean(axis=0)
            for (ids, _, _), g in zip(some, back, strict=True):
                seen, often = np.unique(ids, return_counts=True)
                # the mean spreads a text's gradient thinly over its rows: a larger step for them
                table[seen] -= rate * 40 * (often / len(ids))[:, None].astype(np.float32) * g
            done += 1
    product = table @ layer
    held = [s for s in samples if s[2]] or samples
    held = [(product[subwords(data)].mean(axis=0) + bias, k) for data, k, _ in held]
    z, y = np.stack([h[0] for h in held]), np.array([h[1] for h in held])

    def loss(t: float) -> float:
        p = _softmax(z / t)[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=loss)
    best = _softmax(z / temperature)
    right = np.sort(best.max(axis=1)[best.argmax(axis=1) == y])
    threshold = float(right[int(REJECTED_RIGHT * len(right))]) if len(right) else 0.0
    return Model(langs, product.astype(np.float32), bias, temperature, min(threshold, 0.999 / max(1, len(langs)) + 0.2))


def labelled_sample(docs: DataFrame, learnable: Column, most: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``most`` labelled rows, chosen by a hash of the id, the same on every run."""
    rows = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))
    # the ids are chosen first, so that only the chosen texts travel
    bar = rows.select(key.alias("k")).orderBy("k").limit(most).agg(F.max("k")).first()[0]
    if bar is None:
        return []
    chosen = rows.filter(key <= bar).select("text", "lang", key.alias("k")).orderBy("k", F.xxhash64("text")).limit(most)
    return [(r["text"], r["lang"]) for r in chosen.toLocalIterator()]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred, score, accepted`` to ``docs``; reads the column ``text`` only."""
    small_batches(docs.sparkSession)
    names = {c: free_name(docs, c) for c in ("lang_pred", "score", "accepted")}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets x languages

    def score(texts: list[str | None]) -> tuple[list, list, list]:
        m = shared.value
        named, scores, kept = [], [], []
        for t in texts:
            if t is None or not m.langs or not _LETTER.search(t):
                named.append(UNKNOWN), scores.append(0.0), kept.append(False)
                continue
            p = m.probabilities(m.mean_logits(t))
            k = int(p.argmax())
            named.append(m.langs[k]), scores.append(float(p[k])), kept.append(bool(p[k] >= m.threshold))
        return named, scores, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            named, scores, kept = score([None if t is None else t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())],
                names=[*batch.schema.names, *names.values()],
            )

    schema = StructType([*docs.schema.fields]).add(names["lang_pred"], "string").add(names["score"], "double").add(names["accepted"], "boolean")
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """Train on the rows that are not held out and predict all of ``docs``."""
    model = train(labelled_sample(docs, ~held_out(F.col("doc_id")), most))
    return predict(docs, model)



def accepted(docs: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score above the threshold."""
    name = free_name(docs, "accepted")
    return identify(docs, most).filter(F.col(name)).select(*[F.col(f"`{c}`") for c in docs.columns])
