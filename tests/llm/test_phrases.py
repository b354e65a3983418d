"""Collocations against plain counting, on hot prefixes and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terragrid.llm import phrases


def plain(rows, least=10, percent=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = set()
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(100 * b >= percent * a and b >= least for (la, v), b in f.items() if la == lang and len(v) == 3 and w in (v[:2], v[1:])):
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.add((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "new", "york", "city", "é", "漢字", "a\x00b", "x" * 300]
    out = [("en", " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    out += [("de", t) for _, t in out[:20]] + [("en", "go go go go go")] * 15 + [(None, "und hier und hier und hier; und hier\tund hier")] * 4
    return out + [("en", None), ("fr", ""), (None, None), ("fr", " .. \n"), ("e n", "odd label here " * 12), ("", "empty label here " * 12)]


def test_collocations_equal_plain_counting(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("prefix", F.lit("extra")).withColumn("n", F.lit(0)).repartition(5)
    assert {tuple(r) for r in phrases.collocations(df).collect()} == plain(rows)
    assert {tuple(r) for r in phrases.collocations(df, least=3, subsumed_percent=90).collect()} == plain(rows, 3, 90)


def test_small_tables_and_all_words_hot(spark, rows, monkeypatch):
    """Neither the split of prefixes, nor chunks, nor a table of few bits changes a count."""
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(phrases, "HOT_SHARE", 10**9)
    monkeypatch.setattr(phrases, "CHUNK", 500)
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 10)
    assert {tuple(r) for r in phrases.collocations(df).collect()} == plain(rows)
    monkeypatch.setattr(phrases, "HOT_SHARE", 1)
    assert {tuple(r) for r in phrases.collocations(df).collect()} == plain(rows)


def test_rank_and_empty_table(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    want = sorted(plain(rows), key=lambda r: (r[0].encode(), -r[6], -r[2], r[1].encode()))
    got = sorted(phrases.best_collocations(df, most=4).collect(), key=lambda r: (r["lang"].encode(), r["rank"]))
    for lang in {r[0] for r in want}:
        assert [r["phrase"] for r in got if r["lang"] == lang] == [r[1] for r in want if r[0] == lang][:4]
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.best_collocations(spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")).collect() == []
