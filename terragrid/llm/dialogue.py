"""Repair of conversation structure: a checkpointed dynamic programme over edits.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``.  Its
rows, in order of turn, are kept (K, cost 0), given the other role (R, 3) or
deleted (D, 4; blank rows and duplicates must be), and empty rows are inserted (I,
3); a truncated row that stays costs 3 more.  Of the cheapest edits those with the
ASCII-least letters are taken.

The programme runs backward over one byte a row.  Only at the ends of blocks the
vector of costs (one for each of four states) is stored; blocks are recomputed from
their vector while the walk goes forward and emits tight edits.  Blocks grow with
the square root of the rows before them, so vectors and recomputed rows are about
``2 * sqrt(n)`` each.

On Spark: rows without their texts are range-sorted, so a long conversation is cut
into blocks by many tasks; one row per block then meets its conversation.  Texts are
shuffled once, to be written behind the edits; they stream past and are never held.
What one task handles of a conversation is a byte a row and one text at a time
(a digest of the whole text is sequential by nature).

Defined results: null roles and texts are one space; rows come in order of turn,
nulls first, then role, then SHA-256 of the text; a row is blank without any
character but white space, a duplicate when an earlier row has its role and text,
truncated when its last character that is no white space is none of ``.!?``; the
first of these counts.  A row with an empty role adds no initial and may be kept.
Rows with a null ``conv_id`` are one conversation; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terragrid.llm.text import SPACES
from terragrid.llm.vectors import chunks
from terragrid.plans.sizing import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A byte of a row is its initial (s, u, a, another, none) and five times its fault.
INITIALS, OTHER, NO_ROLE = "sua", 3, 4
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: States: nothing yet, after s, after u, after a.  The role that may follow, and the state behind it.
ROLE_AFTER = ("user", "user", "assistant", "user")
STATE_AFTER = (2, 2, 3, 2)
FINAL = (0, 3)
NEVER = 1 << 60
LEAST_BLOCK = 64

Vector = tuple[int, int, int, int]


def _kept_state(state: int, initial: int) -> int | None:
    """State behind a row that is kept, None where it may not be."""
    if initial == NO_ROLE:
        return state
    if initial == 0:
        return 1 if state == 0 else None
    if initial == OTHER:
        return None
    return STATE_AFTER[state] if (initial == 2) == (state == 2) else None


#: For each byte and state: (letter, cost, next state) of the edits of a row, in ASCII order.
EDITS = [
    [
        sorted(
            [("D", DELETE, q)]
            + ([("K", KEEP + extra, _kept_state(q, initial))] if fault in (SOUND, CUT) and _kept_state(q, initial) is not None else [])
            + ([("R", REROLE + extra, STATE_AFTER[q])] if fault in (SOUND, CUT) else [])
        )
        for q in range(4)
    ]
    for fault in range(4)
    for extra in [TRUNCATED if fault == CUT else 0]
    for initial in range(5)
]
#: Adjacent initials that are right.
_LEGAL = np.zeros((5, 5), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


def _inserted(costs: list[int]) -> Vector:
    """Costs when rows may be inserted first; after u and a they lead to each other."""
    after_u, after_a = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return min(costs[0], INSERT + after_u), min(costs[1], INSERT + after_u), after_u, after_a


END: Vector = _inserted([0 if q in FINAL else NEVER for q in range(4)])


def _before(byte: int, after: Vector) -> Vector:
    return _inserted([min(cost + after[to] for _, cost, to in EDITS[byte][q]) for q in range(4)])


def edits(blocks: list[bytes]) -> tuple[int, str]:
    """Cost and letters of the cheapest, then ASCII-least edits of a conversation."""
    checkpoints, now = [], END
    for block in reversed(blocks):
        checkpoints.append(now)
        for byte in reversed(block):
            now = _before(byte, now)
    total, state, letters = now[0], 0, []

    def tight(costs: Vector, after: Vector, at: int, byte: int) -> Iterator[tuple[str, int]]:
        """Letters that cost no more than need be, in ASCII order but for I, and the states behind them."""
        return ((letter, to) for letter, cost, to in EDITS[byte][at] if costs[at] == cost + after[to])

    for block in blocks:
        vectors = [checkpoints.pop()]
        for byte in reversed(block):
            vectors.append(_before(byte, vectors[-1]))
        vectors.reverse()
        for i, byte in enumerate(block):
            costs, after = vectors[i], vectors[i + 1]
            letter, to = next(tight(costs, after, state, byte), ("", 0))
            while letter != "D" and costs[state] == INSERT + costs[STATE_AFTER[state]]:
                letters.append("I")
                state = STATE_AFTER[state]
                letter, to = next(tight(costs, after, state, byte), ("", 0))
            letters.append(letter)
            state = to
    while state not in FINAL:
        letters.append("I")
        state = STATE_AFTER[state]
    return total, "".join(letters)


def _marked(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, text`` with nulls replaced."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _fault(text: Column) -> Column:
    """Blank, truncated or sound; duplicates are told apart later."""
    last = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)


def symbols(marked: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, byte, later``: ``later`` where an earlier turn has the same role and text."""
    initial = F.when(F.col("role") == "", NO_ROLE)
    for i, c in enumerate(INITIALS):
        initial = initial.when(F.col("role").startswith(c), i)
    small = marked.select("conv_id", "turn", "role", "digest", (initial.otherwise(OTHER) + 5 * _fault(F.col("text"))).cast("int").alias("byte"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = small.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(turn).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return small.join(first, same).select(*small.columns, (turn > F.col("first")).alias("later"))


def blocks(rows: DataFrame) -> DataFrame:
    """Conversations cut into blocks: ``conv_id, part, seq`` (their order), the bytes of the rows, known turns."""
    schema = StructType([rows.schema["conv_id"]]).add("part", "integer").add("seq", "integer").add("bytes", "binary").add("low", "long").add("high", "long").add("turns", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done: list[tuple] = []
        block, turns, seq, before = bytearray(), [], 0, 0
        now = previous = None

        def close() -> None:
            nonlocal block, turns, seq, before
            if block:
                done.append((now, part, seq, bytes(block), turns[0] if turns else None, turns[-1] if turns else None, len(turns)))
                before += len(block)
            block, turns, seq = bytearray(), [], seq + 1

        for batch in batches:
            for conv, turn, role, digest, byte, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if previous is not None and conv != now:
                    close()
                    before = seq = 0
                elif len(block) >= max(LEAST_BLOCK, before**0.5):
                    close()
                now, row = conv, (conv, turn, role, digest)
                # equal rows are neighbours: a range sort keeps them in one partition
                again = (later or row == previous) and byte // 5 != BLANK
                block.append(byte % 5 + 5 * DUPLICATE if again else byte)
                if turn is not None and (not turns or turns[-1] != turn):
                    turns.append(turn)
                previous = row
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*done, strict=True), strict=True)), arrow)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*done, strict=True), strict=True)), arrow)

    ordered = rows.select("conv_id", "turn", "role", "digest", "byte", "later").repartitionByRange(*_order()).sortWithinPartitions(*_order())
    return ordered.mapInArrow(run, schema)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(cut: DataFrame) -> DataFrame:
    """One row per conversation: the counts of ``REPORT`` and the letters of its edits."""
    schema = StructType([cut.schema["conv_id"]])
    for name in REPORT:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string")
    arrow = to_arrow_schema(schema)

    def judged(conv, parts: list[tuple]) -> tuple:
        data = b"".join(p[0] for p in parts)
        seen = np.frombuffer(data, np.uint8)
        fault, initial = seen // 5, seen % 5
        known = [p[1:] for p in parts if p[1] is not None]
        gaps = 0
        if known:
            turns = sum(n for _, _, n in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:], strict=False))
            gaps = known[-1][1] - known[0][0] + 1 - turns
        cost, letters = edits([p[0] for p in parts])
        illegal = int((~_LEGAL[initial[:-1], initial[1:]]).sum())
        return conv, gaps, *(int((fault == f).sum()) for f in (BLANK, DUPLICATE, CUT)), illegal, cost, letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, started = None, [], False
        for batch in batches:
            done = []
            for conv, *block in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "bytes", "low", "high", "turns")), strict=True):
                if started and conv != now:
                    done.append(judged(now, parts))
                    parts = []
                now, started = conv, True
                parts.append(tuple(block))
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*done, strict=True), strict=True)), arrow)
        if started:
            yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(judged(now, parts), strict=True), strict=True)), arrow)

    order = [F.asc_nulls_first("conv_id"), "part", "seq"]
    return cut.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _written(marked: DataFrame, judged: DataFrame, make, schema: StructType) -> DataFrame:
    """Texts behind their conversation's edits, in order; ``make()`` gives an object with ``start, row, end``."""
    heads = judged.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), F.struct(*judged.columns[1:]).alias("head"))
    body = marked.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
    both = heads.unionByName(body).repartition("conv_id")
    both = both.sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", *_order()[1:]).select("conv_id", "kind", "role", "text", "head")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch, texts in chunks(batches):
            out = []
            for conv, kind, role, head, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "head")), texts, strict=True):
                if kind == 0:
                    out += writer.close() if writer else []
                    writer = make(conv, head)
                else:
                    out += writer.row(role, text)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*out, strict=True), strict=True)), arrow)
        if writer and (out := writer.close()):
            yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*out, strict=True), strict=True)), arrow)

    return both.mapInArrow(run, schema)


class _Walk:
    """Follows the letters of a conversation while its rows pass."""

    def __init__(self, conv, head: dict):
        self.conv, self.head, self.letters, self.at, self.state, self.n = conv, head, head["audit"], 0, 0, 0

    def put(self, role: str, text: bytes) -> list[tuple]:
        raise NotImplementedError

    def _inserts(self) -> list[tuple]:
        out = []
        while self.letters[self.at : self.at + 1] == "I":
            out += self.put(ROLE_AFTER[self.state], b"")
            self.state = STATE_AFTER[self.state]
            self.at += 1
        return out

    def row(self, role: str, text: bytes) -> list[tuple]:
        out = self._inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            out += self.put(ROLE_AFTER[self.state], text)
            self.state = STATE_AFTER[self.state]
        elif letter == "K":
            out += self.put(role, text)
            self.state = _kept_state(self.state, NO_ROLE if role == "" else INITIALS.index(role[0]))
        return out

    def close(self) -> list[tuple]:
        return self._inserts()


class _Rows(_Walk):
    def put(self, role: str, text: bytes) -> list[tuple]:
        self.n += 1
        return [(self.conv, self.n - 1, role, text.decode("utf-8", "replace"))]


class _Digest(_Walk):
    def __init__(self, conv, head: dict):
        super().__init__(conv, head)
        self.sha = hashlib.sha256()

    def put(self, role: str, text: bytes) -> list[tuple]:
        self.sha.update(b"\n" * (self.n > 0) + role.encode() + b":")
        self.sha.update(text)
        self.n += 1
        return []

    def close(self) -> list[tuple]:
        self._inserts()
        return [(self.conv, *self.head.values(), self.sha.hexdigest())]


def _judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = _marked(rows)
    return marked, stage(audits(stage(blocks(symbols(marked)), "blocks")), "audits")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text): ``conv_id, turn`` (from 0, without gaps), ``role, text``."""
    marked, judged = _judged(rows)
    schema = StructType([marked.schema["conv_id"]]).add("turn", "long").add("role", "string").add("text", "string")
    return _written(marked, judged, _Rows, schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``REPORT``, ``audit``, ``repaired_sha256`` of its ``role:text`` lines."""
    marked, judged = _judged(rows)
    return _written(marked, judged, _Digest, StructType([*judged.schema.fields]).add("repaired_sha256", "string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Test damage by crc32 of ``conv_id:turn`` modulo 20: row gone, text emptied, ends of sentences gone, row twice, role user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    how = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text)
    kept = rows.filter(how != 0).select("conv_id", "turn", F.when(how == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(how == 3, 2).otherwise(1))).alias("copy"))
    return kept.drop("copy")


def structure_report(conversations: DataFrame) -> DataFrame:
    """:func:`repair_report` of the damaged conversations, with a row of zeros for those that lost all rows."""
    found = repair_report(damaged(conversations))
    back = found.withColumnRenamed("conv_id", "found_id")
    every = conversations.select("conv_id").distinct().join(back, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in REPORT], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
