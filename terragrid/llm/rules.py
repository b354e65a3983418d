"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition under which a document is rejected.  The cost of each
rule and the share of rows that it rejects are estimated on a sample; rules run
in the order of rejections per cost.  The cascade is one CASE expression: a rule
is evaluated only for rows that every rule before it has let through, and
the measures that only one rule reads are written into that rule.

The order changes the cost, not the verdict: a row is kept when no rule rejects.

Defined results: a null text has no words and all counts 0; a rule whose
condition is null does not reject; repeated rows are judged alike; columns of the
input that bear the name of a measure are replaced, others pass through; an empty
table gives an empty table, with the rules in the given order.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terragrid.llm.text import free_name, words
from terragrid.plans.sizing import stage

#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 400
SAMPLE_SHARE = 0.02

SYMBOLS = r"[#*$%&|<>]"
WORDY = r"[^\x20\x09-\x0D]"
SPAN = 8


@dataclass(frozen=True)
class Rule:
    """Rejects the rows where ``rejects`` is true."""

    name: str
    rejects: Column


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once per row, however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def word_chars(tokens: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(tokens, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORDY))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(tokens: Column, span: int = SPAN) -> Column:
    """Words in runs of ``span`` words found twice or more in the text, the first included.

    Runs are compared by a 64-bit hash of the hashes of their words.  A text
    without two equal hashes, the common case, is done after one sort.
    """

    def covered(runs: Column) -> Column:
        # equal runs stand side by side after the sort; the marked starts, in order, cover up to span words each
        def starts(pairs: Column) -> Column:
            same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
            marked = F.filter(pairs, lambda p, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.array_sort(F.transform(marked, lambda p: p["i"]))

        pairs = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def length(at: Column) -> Column:
            reach = F.transform(at, lambda p, i: F.least(F.lit(span), F.coalesce(F.get(at, i + 1) - p, F.lit(span))))
            return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

        return bind(bind(pairs, starts), length)

    def repeated(runs: Column) -> Column:
        distinct = F.size(F.array_distinct(runs))
        return F.when(distinct == F.size(runs), F.lit(0)).otherwise(covered(runs))

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    runs = bind(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (span - 1)), lambda i: F.xxhash64(F.slice(h, i, span))))
    return F.when(F.size(tokens) <= span, F.lit(0)).otherwise(bind(runs, repeated)).cast("long")


def base_columns(docs: DataFrame) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    tokens = free_name(docs, "words_")
    text = F.col("text")
    with_words = docs.withColumn(tokens, words(text))
    measured = with_words.withColumns(
        {
            "n_words": F.size(tokens).cast("long"),
            "word_chars": word_chars(F.col(tokens)),
            "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text),
            "n_repeat_words": n_repeat_words(F.col(tokens)),
        }
    ).drop(tokens)
    return measured.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def standard_rules() -> list[Rule]:
    """Rules over a text and its base measures; each rejects a kind of junk."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.col("n_words")
    ratio = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),  # a symbol on more than every tenth word
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)),
        Rule("duplicate_lines", 3 * F.col("n_dup_lines") > F.size(F.split(text, "\n"))),
        Rule("capitals", 2 * ratio(r"\p{Lu}") > ratio(r"\p{L}")),
        Rule("exclaimed", 5 * ratio(r"!!") > n),
        Rule("letters", 2 * ratio(r"\p{L}") < F.col("word_chars")),
        Rule("columns", 4 * ratio(r" \| ") > n),
    ]


def ranked(sample: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """Rules with their seconds a row and share of rejections on the sample, best first.

    Each rule is timed alone over the sample, after a first run that compiles it.
    """
    held = stage(sample, "rule_sample")
    n = held.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    found = []
    for at, rule in enumerate(rules):
        hits = held.agg(F.count(F.when(rule.rejects, 1)).alias("n"))
        times = []
        for _ in range(2):
            began = time.perf_counter()
            rejected = hits.first()["n"]
            times.append(time.perf_counter() - began)
        cost, share = min(times) / n, rejected / n
        found.append((-share / max(cost, 1e-9), at, rule, cost, share))
    return [(rule, cost, share) for _, _, rule, cost, share in sorted(found, key=lambda x: x[:2])]


def drawn(rows: DataFrame, most: int = SAMPLE_ROWS, share: float = SAMPLE_SHARE) -> DataFrame:
    """A few rows to estimate costs on."""
    return rows.sample(fraction=share, seed=5).limit(most)


def cascade(rows: DataFrame, rules: Sequence[Rule], sample: DataFrame, first: Column | None = None) -> DataFrame:
    """Add ``failed_rule``: the first rule of the cascade that rejects the row, or null.

    ``first`` is a condition known already; rows that meet it are not tried.
    ``sample`` has the columns of ``rows`` and serves the order only; it never
    decides about a row.
    """
    chain = F.when(first, F.lit("base")) if first is not None else F.when(F.lit(False), F.lit(""))
    for rule, _, _ in ranked(sample, rules):
        chain = chain.when(rule.rejects, F.lit(rule.name))
    return rows.withColumn("failed_rule", chain)


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Base measures, ``base_failed``, ``failed_rule`` and ``kept`` for every document."""
    # drawn before the measures are taken, so that these are taken of the sample only
    sample = base_columns(drawn(docs))
    judged = cascade(base_columns(docs), rules if rules is not None else standard_rules(), sample, first=F.col("base_failed"))
    return judged.withColumn("kept", F.col("failed_rule").isNull())
