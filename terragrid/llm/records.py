"""Token ids in files of length-delimited binary records.

A shard starts with ``MAGIC`` and one byte, the width of an id (2 or 4 bytes).
Records follow in ascending order of doc_id, each framed as

    length   8 bytes, little endian: bytes of the payload
    check    4 bytes: masked checksum of the length's 8 bytes
    payload  ids, little endian, of the shard's width
    check    4 bytes: masked checksum of the payload

The offset index is a separate Parquet table ``shard, doc_id, offset, length,
n_tokens, start``; with it any record is read alone, in any order.  A task
writes its shard under a name of its own; only shards of tasks that ended well
are in the index, so a lost executor or a second attempt does no harm.

Checksums are CRC-32 (zlib) under the usual rotation and constant.

Defined results: a null text is an empty one and holds the end id only; null
ids come first; repeated ids follow each other, ordered by a hash of the text;
an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terragrid.plans.sizing import scratch_dir, stage

MAGIC = b"TGREC\x00\x01"
HEAD = len(MAGIC) + 1
FRAME = 16
MASK_DELTA = 0xA282EAD8
#: Bytes that a reader fetches at once, and that a writer collects before it writes.
READ_SPAN = 8 << 20
#: Pieces of text whose ids a worker remembers; the next ones push out those not met since as many more.
CACHED_PIECES = 250_000
LONGEST_CACHED = 48
#: Bytes of text that are taken apart at once, and characters in one call of the tokenizer: its results take a hundred bytes an id.
BATCH_BYTES, CALL_CHARS = 1 << 20, 1 << 17


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview) -> memoryview:
    """The payload of one framed record; raises when a length or checksum is wrong."""
    size = bytes(data[:8])
    (length,) = struct.unpack("<Q", size)
    if struct.unpack("<I", data[8:12])[0] != masked(size) or length != len(data) - FRAME:
        raise ValueError("damaged length of a record")
    payload = data[12 : 12 + length]
    if struct.unpack("<I", data[12 + length :])[0] != masked(payload):
        raise ValueError("damaged payload of a record")
    return payload


class PieceEncoder:
    """Ids of texts as bytes, through a cache of pieces between single spaces.

    The tokenizer splits before every single space that stands between two
    other characters, so the pieces of such a text are encoded on their own.
    A text with white space in any other arrangement is encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.spaced = np.array([t.startswith("\u0120") for t in names])  # how the vocabulary writes a space
        white = [c for c in map(chr, range(0x3001)) if c.isspace()]
        self.white = {False: white, True: [c for c in white if c.isascii()]}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def uneven(self, text: str) -> bool:
        """Whether white space stands beside a space; most texts hold few kinds of it, so a search for each is quick."""
        return any(c in text and (" " + c in text or c + " " in text) for c in self.white[text.isascii()])

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        ends = np.cumsum([len(t) for t in texts])
        at = 0
        while at < len(texts):
            upto = (ends[at - 1] if at else 0) + CALL_CHARS
            to = max(at + 1, int(np.searchsorted(ends, upto, side="right")))
            for e in self.tokenizer.encode_batch_fast(texts[at:to], add_special_tokens=False):
                yield np.array(e.ids, self.dtype).tobytes()
            at = to

    def _encode_pieces(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of pieces, each with a space before it, from one call for many.

        A piece holds no space, so only its first id can begin with one.
        """
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            (e,) = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(self.spaced[ids]) * self.dtype.itemsize
            if len(cuts) != len(some):  # ids of another vocabulary may join pieces
                yield from self._encode([" " + p for p in some])
                continue
            data, cuts = ids.tobytes(), [*cuts.tolist(), ids.nbytes]
            for i in range(len(some)):
                yield data[cuts[i] : cuts[i + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Payload bytes of each text, without an end id."""
        whole = [i for i, t in enumerate(texts) if self.uneven(t)]
        out: list[bytes | None] = [None] * len(texts)
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        pieces = [(i, t.split(" ")) for i, t in enumerate(texts) if out[i] is None]
        firsts = list(self._encode([p[0] for _, p in pieces]))
        if len(self.cache) > CACHED_PIECES:
            self.older, self.cache = self.cache, {}
        need = set()
        for _, p in pieces:
            need.update(p[1:])
        need.difference_update(self.cache.keys() & need)
        kept = self.older.keys() & need
        self.cache.update((p, self.older[p]) for p in kept)
        need -= kept
        fresh = list(need)
        ids = self.cache
        ids.update(zip(fresh, self._encode_pieces(fresh), strict=True))
        for (i, p), first in zip(pieces, firsts, strict=True):
            out[i] = first + b"".join(map(ids.__getitem__, p[1:]))
        for p in fresh:
            if len(p) > LONGEST_CACHED:  # long pieces are not kept
                del ids[p]
        return out


def give_back() -> None:
    """Return memory that earlier tasks of this worker freed: Spark keeps workers, and allocators keep what was freed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _bounded(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of text, ``BATCH_BYTES`` unless named, one row at least."""
    most = most or BATCH_BYTES
    for batch in batches:
        size = max(1, batch.nbytes)
        step = max(1, int(batch.num_rows * most / size)) if batch.num_rows else 1
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


INDEX_SCHEMA = "part int, shard string, doc_id long, offset long, length long, n_tokens long, before long"


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode ``doc_id, text`` into shards below ``folder``; returns the offset index.

    ``start`` is the number of ids in all documents before this one.
    """
    spark = docs.sparkSession
    base = folder or f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/records-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        name = f"shard-{part:06d}-{uuid.uuid4().hex}.rec"
        sink, at, before = None, HEAD, 0
        for batch in _bounded(batches):
            if sink is None:
                store, path = pafs.FileSystem.from_uri(base)
                store.create_dir(path, recursive=True)
                sink = store.open_output_stream(f"{path}/{name}", buffer_size=READ_SPAN)
                sink.write(MAGIC + bytes([enc.dtype.itemsize]))
            ids = batch.column("doc_id")
            payloads = [p + end for p in enc.encode([t or "" for t in batch.column("text").to_pylist()])]
            sink.write(b"".join(map(frame, payloads)))
            length = np.array([len(p) for p in payloads], np.int64)
            tokens = length // enc.dtype.itemsize
            offset = at + np.cumsum(length + FRAME) - length - FRAME
            first = before + np.cumsum(tokens) - tokens
            n = len(payloads)
            at, before = int(at + (length + FRAME).sum()), int(before + tokens.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array([name] * n), ids, pa.array(offset), pa.array(length + FRAME), pa.array(tokens), pa.array(first)],
                names=["part", "shard", "doc_id", "offset", "length", "n_tokens", "before"],
            )
        if sink is not None:
            sink.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    key = [F.col("doc_id"), F.xxhash64("text")]
    index = stage(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(write, INDEX_SCHEMA), "index")
    # one row per shard
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return index.join(offsets, "part").select(
        F.concat(F.lit(base + "/"), "shard").alias("shard"), "doc_id", "offset", "length", "n_tokens", (F.col("before") + F.col("_ahead")).alias("start")
    )


def map_records(index: DataFrame, schema: str, derive: Callable[[np.ndarray], tuple], carry: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Read records back; ``derive`` turns the ids of one into the columns of ``schema``.

    The index may come in any order, whole or in part.  Rows that follow each
    other in a shard are fetched together.  The result has the columns
    ``carry`` of the index, then those of ``schema``.
    """
    kinds = dict(index.dtypes)
    full = ", ".join([*(f"{c} {kinds[c]}" for c in carry), schema])
    made_schema = to_arrow_schema(StructType.fromDDL(schema))
    names = made_schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width: dict[str, int] = {}
        for batch in batches:
            order = np.lexsort((batch.column("offset").to_numpy(), np.array(batch.column("shard").to_pylist(), object)))
            batch = batch.take(pa.array(order))
            shards, offsets, lengths = batch.column("shard").to_pylist(), batch.column("offset").to_numpy(), batch.column("length").to_numpy()
            made, at, n = [], 0, batch.num_rows
            while at < n:
                to = at + 1
                while to < n and shards[to] == shards[at] and offsets[to] == offsets[to - 1] + lengths[to - 1] and offsets[to] + lengths[to] - offsets[at] <= READ_SPAN:
                    to += 1
                store, path = pafs.FileSystem.from_uri(shards[at])
                with store.open_input_file(path) as f:
                    if shards[at] not in width:
                        head = f.read(HEAD)
                        if head[:-1] != MAGIC:
                            raise ValueError(f"not a shard: {shards[at]}")
                        width[shards[at]] = head[-1]
                    f.seek(int(offsets[at]))
                    data = memoryview(f.read(int(offsets[to - 1] + lengths[to - 1] - offsets[at])))
                dtype = np.dtype(f"<u{width[shards[at]]}")
                for i in range(at, to):
                    own = int(offsets[i] - offsets[at])
                    made.append(derive(np.frombuffer(unframe(data[own : own + int(lengths[i])]), dtype)))
                at = to
            cols = list(zip(*made, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(pa.array(c, made_schema.field(n).type) for n, c in zip(names, cols, strict=True))], names=[*carry, *names])

    return index.select(*dict.fromkeys([*carry, "shard", "offset", "length"])).mapInArrow(read, full)


def read_records(index: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of the records in an index."""
    return map_records(index, "ids array<int>", lambda ids: (ids.astype(np.int32).tolist(),))


def _digest(ids: np.ndarray) -> tuple[int, int]:
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def record_digests(index: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` as read back from the shards."""
    return map_records(index, "n_tokens long, ids_crc32 long", _digest)
