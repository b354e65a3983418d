"""Conversation repair against exhaustive search, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from terragrid.llm import dialogue

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """Initial and fault of each row of one conversation, already in order."""
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.rstrip(SPACE)
        kind = "blank" if not solid.strip(SPACE) else "dup" if (role, text) in seen else "cut" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], kind))
    return out


def cheapest(marked, most_inserts=3):
    """All edit strings by brute force: the least cost, then the ASCII-least letters."""
    right = re.compile(r"(s?(ua)+)?\Z")
    best = None
    for n in range(most_inserts + 1):
        for places in itertools.combinations_with_replacement(range(len(marked) + 1), n):
            for new in itertools.product("ua", repeat=n):
                for acts in itertools.product("KRrD", repeat=len(marked)):  # R to user, r to assistant
                    cost, letters, initials = 3 * n, [], []
                    for i in range(len(marked) + 1):
                        for p, role in zip(places, new, strict=True):
                            if p == i:
                                letters.append("I"), initials.append(role)
                        if i == len(marked):
                            continue
                        (initial, kind), act = marked[i], acts[i]
                        if kind in ("blank", "dup") and act != "D":
                            break
                        cost += {"K": 0, "R": 3, "r": 3, "D": 4}[act] + (3 if kind == "cut" and act != "D" else 0)
                        letters.append(act.upper())
                        if act != "D":
                            initials.append(initial if act == "K" else "u" if act == "R" else "a")
                    else:
                        if right.match("".join(initials)):
                            found = cost, "".join(letters)
                            best = found if best is None else min(best, found)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_edits_equal_exhaustive_search(seed):
    rng = random.Random(seed)
    for _ in range(6):
        rows = [(i, rng.choice(["user", "user", "assistant", "system", "tool", ""]), rng.choice(["", "a.", "b", "c!", " \n", "d? "])) for i in range(rng.randint(0, 4))]
        marked = faults(rows)
        code = bytes("sua".find(i) + 5 * ["", "blank", "dup", "cut"].index(k) if i in ("s", "u", "a") else (4 if i == "" else 3) + 5 * ["", "blank", "dup", "cut"].index(k) for i, k in marked)
        assert dialogue.edits([code] if code else []) == cheapest(marked)
        assert dialogue.edits([code[i : i + 1] for i in range(len(code))]) == cheapest(marked)  # a checkpoint behind every row


def plain_report(rows):
    """The whole report of one conversation in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    marked = faults(rows)
    code = bytes((("sua".find(i) if i and i in "sua" else 4 if i == "" else 3) + 5 * ["", "blank", "dup", "cut"].index(k)) for i, k in marked)
    cost, audit = dialogue.edits([code])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[0] + b[0]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    out, state, left = [], 0, iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        keeps = letter == "K"
        role = row[1] if keeps else ("assistant" if state == 2 else "user")
        out.append(role + ":" + (row[2] if row else ""))
        state = state if keeps and row[1] == "" else 1 if keeps and row[1][0] == "s" else 3 if state == 2 else 2
    kinds = [k for _, k in marked]
    return gaps, kinds.count("blank"), kinds.count("dup"), kinds.count("cut"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_report_and_rows_of_odd_conversations(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            rows.append((conv, rng.choice([None, turn, turn, turn * 2]), rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice([None, "", "Yes.", "No", "x " * 500, "é!", "a\x00b?"])))
    rows += [(99, t % 3000, "user" if t % 2 else "assistant", f"line {t % 500}.") for t in range(5000)]  # many blocks, many copies
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("extra")).withColumn("head", F.lit(1)).repartition(7)
    got = {r["conv_id"]: tuple(r)[1:] for r in dialogue.repair_report(df).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: plain_report(some) for conv, some in by.items()}
    initials = {}
    for r in dialogue.repaired(df).orderBy("conv_id", "turn").collect():
        initials[r["conv_id"]] = initials.get(r["conv_id"], "") + r["role"][:1]
    assert all(re.fullmatch("(s?(ua)+)?", v) for v in initials.values()) and len(initials) > 20


def test_empty_table_and_lost_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert dialogue.repair_report(none).collect() == [] and dialogue.repaired(none).collect() == [] and dialogue.structure_report(none).collect() == []
    lost = next(i for i in range(1000) if __import__("zlib").crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = dialogue.structure_report(spark.createDataFrame([(lost, 0, "user", "Hi.")], schema)).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
