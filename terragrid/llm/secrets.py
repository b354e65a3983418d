"""Secret scan: fixed patterns, and words that a public vocabulary encodes badly.

Text that people write falls into few tokens for its length; random strings
fall into many.  A word of key-like characters is reported when its characters
per token stand below ``CHARS_PER_TOKEN``, after digests of known lengths,
UUIDs and identifiers (words joined by ``_``, ``-`` or ``.``, camel case, paths,
plain numbers) are set aside.  Letters that change case too often for camel case
are judged by their tokens.

Defined results: a null text is an empty one and has no spans; repeated rows
are scanned alike; offsets count code points, ends are exclusive; spans are
ordered by start, then as ``KINDS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the base kinds
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}
DIGESTS = (32, 40, 56, 64, 96, 128)  # hex digits of md5, sha1, sha224, sha256, sha384, sha512

#: A word is judged by its tokens from this length on.
SHORTEST = 20
#: Letters that the parts of an identifier have on average; random letters in both cases have under three between changes of case.
PART_LETTERS = 4
#: English prose has about 4 characters a token, random base64 about 1.5.
CHARS_PER_TOKEN = 2.2

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_access = re.compile(ACCESS)
# a run of hex digits ends where the next character is none, so runs of 16 and more can be asked for at once
_hex = re.compile(r"[0-9a-f]{16,}")
_candidate = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
_uuid = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_hex_only = re.compile(r"[0-9a-fA-F]+")
_identifier = re.compile(r"[A-Za-z]+([_/-]+[A-Za-z]+)*[_/-]*[0-9]{0,4}")
_part = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_spaced_number = re.compile(r"[0-9+/_=-]+")


class Vocabulary:
    """Token counts of ASCII words under a tiktoken vocabulary."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def chars_per_token(self, word: str) -> float:
        return len(word) / max(1, len(self.encoding.encode_ordinary(word)))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, leftmost and not overlapping within a kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in _hex.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def is_known(word: str) -> bool:
    """Digests, UUIDs, identifiers and numbers: random to a tokenizer, but no secret by themselves."""
    if _hex_only.fullmatch(word) and len(word) in DIGESTS or _uuid.fullmatch(word):
        return True
    if _identifier.fullmatch(word):
        parts = _part.findall(word)
        if sum(map(len, parts)) >= PART_LETTERS * len(parts):
            return True
    if _spaced_number.fullmatch(word):
        return True
    digits, upper, lower = (any(f(c) for c in word) for f in (str.isdigit, str.isupper, str.islower))
    return digits + upper + lower < 2


def random_spans(text: str, vocab: Vocabulary, most: float = CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    found = []
    for m in _candidate.finditer(text):
        word = m.group()
        if not is_known(word) and vocab.chars_per_token(word) < most:
            found.append((m.start(), m.end(), "random"))
    return found


SPAN_SCHEMA = "base array<struct<start:int,end:int,kind:string>>, spans array<struct<start:int,end:int,kind:string>>"


def find_secrets(docs: DataFrame, vocab_path: str, most: float = CHARS_PER_TOKEN) -> DataFrame:
    """``doc_id, base, spans``: spans of the fixed patterns, and these with the random strings."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                own = base_spans(text) if text else []
                more = random_spans(text, vocab, most) if text else []
                base.append(as_rows(own))
                spans.append(as_rows(sorted(own + more, key=lambda s: (s[0], KINDS.index(s[2])))) if more else base[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(spans, kind)], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, " + SPAN_SCHEMA)


def joined(spans: str):
    """``kind:start:end`` of a column of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

