"""Context mixing scores against plain counting, plain sums over a trie, and a bit-by-bit mixer."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terragrid.llm import bitmix
from terragrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*(w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())), b"\n"]


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in QUERIES["op11_lm_scores"](spark, SF).collect()}


def test_base_and_counts_equal_plain_python(scored, texts):
    learned = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i in texts}
    c = Counter(t for i, text in texts.items() if learned[i] for t in tokens(text))
    n, v = c.total(), len(c)
    assert set(scored) == set(texts)
    for i, text in texts.items():
        r, ts = scored[i], tokens(text)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learned[i], len(ts), sum(c[t] > 0 for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert math.isclose(r["score"], -r["bits"] * math.log10(2), rel_tol=1e-9) and r["n_bytes"] == sum(len(t) + (t != b"\n") for t in ts)


def test_better_than_single_bytes_on_texts_not_learned(scored, texts):
    """Bits per byte of held-out texts: below their order-0 entropy, by far."""
    held = [i for i in texts if scored[i]["held_out"]]
    data = b"".join(b" ".join(tokens(texts[i])) for i in held)
    share = np.bincount(np.frombuffer(data, np.uint8)) / len(data)
    entropy = -sum(p * math.log2(p) for p in share if p)
    assert sum(scored[i]["bits"] for i in held) / sum(scored[i]["n_bytes"] for i in held) < 0.7 * entropy


def test_runs_and_borders_equal_sums_over_all_words():
    rng = np.random.default_rng(1)
    key = np.unique(np.concatenate([rng.integers(0, 1 << 63, 60, dtype=np.uint64), rng.integers(0, 40, 60, dtype=np.uint64), (rng.integers(0, 9, 60, dtype=np.uint64) << np.uint64(60)) + np.uint64(7)]))
    key = np.sort(np.concatenate([key, key[:5]]))  # words longer than the depth share a key
    count = rng.integers(0, 20, len(key))
    cuts = [0, 1, 2, 40, 41, 42, 80, len(key)]
    runs = [bitmix.Run(key[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    rows = [dict(zip(("run", "first", "last", "with_first", "with_last"), (i, *r.key[[0, -1]].view(np.int64).tolist(), *r.border()), strict=True)) for i, r in enumerate(runs)]
    borders = bitmix.Borders(rows)
    for i, r in enumerate(runs):
        got = np.stack(list(r.nodes(*borders.beside(i))), axis=1)
        alone = np.stack(list(r.nodes(np.zeros(65, int), np.zeros(65, int))), axis=1)
        for j, k in enumerate(r.key):
            want = [int(count[(key >> np.uint64(64 - d)) == (k >> np.uint64(64 - d))].sum()) if d else int(count.sum()) for d in range(65)]
            assert got[j].tolist() == want
            assert borders.complete(i, int(r.key[j : j + 1].view(np.int64)[0]), alone[j]).tolist() == want


def test_code_is_a_prefix_code_and_keys_hold_its_bits():
    counts = np.random.default_rng(2).integers(0, 10**7, 256) ** 2
    code = bitmix.Code.of(counts)
    assert sum(2.0**-n for n in code.length.tolist()) == 1.0  # probabilities of all texts add up to one
    words = [b"a", b"\n", b"word", "é漢".encode(), b"x" * 200]
    coded = bitmix.Coded(words, code)
    for w, key, n in zip(words, coded.key.tolist(), coded.n_bits.tolist(), strict=True):
        bits = "".join(format(int(code.value[b]), f"0{code.length[b]}b") for b in (w if w == b"\n" else w + b" "))
        assert n == len(bits) and format(key, "064b") == bits[:64].ljust(64, "0")


def test_words_are_coded_from_the_bytes_of_a_column():
    import pyarrow as pa

    from terragrid.llm.vectors import Words

    code = bitmix.Code.of(np.arange(256))
    words = ["skipped", "a", "\n", "word", "é漢", "x" * 200, "last"]
    column = pa.array(words).slice(1, 5)
    coded, plain = bitmix.Coded(column, code), [w.encode() for w in words[1:6]]
    assert coded.data.tobytes() == b"".join(w if w == b"\n" else w + b" " for w in plain)
    assert coded.key.tolist() == bitmix.Coded(plain, code).key.tolist()
    real = [i for i, w in enumerate(plain) if w != b"\n"]
    assert coded.hashes()[real].tolist() == Words([plain[i] for i in real]).hashes().tolist() and coded.hashes()[1] == bitmix.END_HASH
    assert len(bitmix.Coded([], code).key) == 0


def test_logits_of_slots_and_places_of_equal_values():
    rng = np.random.default_rng(5)
    every = rng.integers(0, 50, (bitmix.ORDERS, bitmix.SLOTS)).astype(np.float32)
    ones = np.floor(every * rng.random(every.shape)).astype(np.float32)
    tables = bitmix.Tables(ones, every)
    assert (tables.logits[:, bitmix.SLOTS :] == bitmix._stretch(ones, every - ones)).all()
    assert (tables.logits[:, : bitmix.SLOTS] == bitmix._stretch(every - ones, ones)).all()
    for value in (rng.integers(0, 9, 200), rng.integers(0, 9, 200) << 58, np.zeros(0, np.int64), np.zeros(1, np.int64)):
        earlier, number = bitmix._groups(value)
        assert earlier.tolist() == [max((j for j in range(i) if value[j] == value[i]), default=-1) for i in range(len(value))]
        assert len(set(number.tolist())) == len(set(value.tolist())) == len(set(zip(value.tolist(), number.tolist(), strict=True)))


def plain_cost(words, lex):
    """One text, bit by bit."""
    w = np.tile(np.array([1, 0.7, 0.7, 0.7], np.float32), (bitmix.MATCH_GATES, 1))
    g2, off, off2 = np.ones_like(w), np.zeros(bitmix.SURE, np.float32), np.ones(bitmix.SURE, np.float32)
    seen, cost, position, block = [{}, {}, {}], 0.0, 0, 0
    rise, off_rise = np.zeros_like(w), np.zeros_like(off)
    before = (0, 0)
    for token in words:
        if position // bitmix.BLOCK != block:  # weights move between blocks
            g2 += rise * rise
            w += bitmix.RATE * rise / np.sqrt(g2)
            off2 += off_rise * off_rise
            off += bitmix.RATE * off_rise / np.sqrt(off2)
            rise[:], off_rise[:], block = 0, 0, position // bitmix.BLOCK
        key = int(lex.key[token])
        contexts = (before[0], before, key >> (64 - bitmix.HEAD))
        told = [lex.key[seen[i][c]].item() if c in seen[i] else None for i, c in enumerate(contexts)]
        cost += lex.settled[token]
        for at in range(int(lex.start[token]), int(lex.start[token] + lex.n_open[token])):
            j, x, gate = int(lex.j[at]), [float(lex.z[at]) / bitmix.SCALE, 0.0, 0.0, 0.0], 0
            for i, other in enumerate(told):
                if other is None or j >= 64 or (i == 2 and j < bitmix.HEAD) or (key >> (64 - j) if j else 0) != (other >> (64 - j) if j else 0):
                    continue
                gate |= 1 << i
                x[i + 1] = 1.0 if (key >> (63 - j) & 1) == (other >> (63 - j) & 1) else -1.0
            gate += 8 * min(j // 8, 3) if gate else 0
            mixed = float(np.dot(x, w[gate]))
            sure = int(min(abs(mixed) * 1.5, bitmix.SURE - 1))
            odds = math.exp(min(16, max(-16, -mixed - math.copysign(1, mixed) * off[sure])))
            cost += math.log(1 + odds)
            rise[gate] += np.array(x, np.float32) * (odds / (1 + odds))
            off_rise[sure] += math.copysign(1, mixed) * odds / (1 + odds)
        for i, c in enumerate(contexts):
            seen[i][c] = token
        before = (int(lex.hash[token]), before[0])
        position += int(lex.n_open[token])
    return cost


def test_mixing_equals_a_loop_over_bits(monkeypatch):
    import pyarrow as pa

    code, rng = bitmix.Code.of(np.bincount(np.frombuffer(b"the quick brown fox jumps over a lazy dog and then some", np.uint8), minlength=256)), np.random.default_rng(4)
    words = [b"\n", b"the", b"then", b"quick", b"brown", b"thexxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", b"fox", b"jumps"]
    z = [rng.integers(-30, 90, n).astype(np.int8).tobytes() for n in bitmix.Coded(words, code).n_bits.tolist()]
    lex = bitmix.Lexicon([pa.RecordBatch.from_pydict({"word": words, "c": [1] * len(words), "z": z})], code)
    every = [[int(k) for k in rng.integers(0, len(words), n)] for n in (1, 3, 400, 90)]
    token, text = np.concatenate(every), np.repeat(np.arange(4), [len(t) for t in every])
    for held in (30_000, 7):  # however many words have their bits held at once
        monkeypatch.setattr(bitmix, "ROUND", held)
        got = bitmix.score_texts(token, text, 4, lex)
        assert np.allclose(got, [plain_cost(t, lex) for t in every], rtol=1e-4)


def test_scores_do_not_depend_on_chunks_and_runs(spark, docs, scored, monkeypatch):
    monkeypatch.setattr(bitmix, "CHUNK_BYTES", 1 << 16)
    monkeypatch.setattr(bitmix, "RUN_WORDS", 700)
    monkeypatch.setattr(bitmix, "SLICE", 1 << 12)
    again = {r["doc_id"]: r for r in bitmix.corpus_scores(docs.repartition(3)).collect()}
    assert again.keys() == scored.keys()
    assert all(math.isclose(again[i]["score"], scored[i]["score"], rel_tol=1e-4) for i in scored)


def test_weights_are_fitted_on_all_training_words(spark, monkeypatch):
    monkeypatch.setattr(bitmix, "RUN_WORDS", 9000)
    words = sorted({f"{'abcde'[i % 5]}{i * 7919 % 99991:x}" for i in range(25_000)})
    count = np.array([1 + i % 3 for i in range(len(words))])
    seen, fit = [], bitmix.fit
    monkeypatch.setattr(bitmix, "fit", lambda *a: seen.append(a) or fit(*a))
    rows = [*zip(words, count.tolist(), strict=True), ("onlyheldout", 0)]
    model = bitmix.Predictors(spark.createDataFrame(rows, "word string, c long").repartition(3))
    coded = bitmix.Coded([w.encode() for w in words], model.code)
    assert len(model.cuts) > 0 and seen[0][2].sum() == (count * coded.n_bits).sum()
    order = np.argsort(coded.key, kind="stable")
    run = bitmix.Run(coded.key[order], count[order])
    zero = np.zeros(bitmix.DEPTH + 1, np.int64)
    coded = bitmix.Coded([words[i].encode() for i in order], model.code)
    yes, past = bitmix.at_bits(np.stack(list(run.nodes(zero, zero)), axis=1) - 1, coded.n_bits)
    x, gate, c = model.tables.features(coded, np.maximum(yes, 0), np.maximum(past, 0)), bitmix._seen_gate(np.maximum(past, 0)), np.repeat(run.count, coded.n_bits)
    cost = lambda w: (c * np.logaddexp(0, -np.einsum("ij,ij->i", x, w[gate]))).sum()
    assert cost(model.weights) <= 1.01 * cost(fit(x, gate, c))  # cells hold bits of unlike predictions


def test_odd_rows_and_empty_table(spark, odd, empty):
    rows = bitmix.corpus_scores(odd).collect()
    assert len(rows) == 12 and all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_tokens"] == by[2][0]["n_tokens"] == by[3][0]["n_tokens"] == 1 and by[1][0]["score"] == by[2][0]["score"]
    assert by[4][0]["score"] == by[4][1]["score"] and by[5][0]["score"] == by[6][0]["score"] == by[7][0]["score"]
    assert by[None][0]["held_out"] is False
    assert bitmix.corpus_scores(empty).collect() == []
    from pyspark.sql import functions as F

    none = bitmix.scores(odd, F.lit(False)).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)
