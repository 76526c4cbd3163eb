"""Token ids as binary segments with Elias-Fano document boundaries.

A segment is one self-contained byte string, stored as one row of a Parquet folder that Spark writes
and any executor can read:

    magic ``ELF1`` | u8 id width | u8 low bits | u16 0 | u64 documents | u64 ids | u64 high bytes |
    document ids (i64 each) | null flags of the ids (bitmap) | low bits | high bits | select samples (u32) | token ids

The n + 1 document boundaries (0 first, the number of ids last) are Elias-Fano coded: their low bits
stand packed, their high bits in unary, about 2 + log2(ids / documents) bits for each instead of 64.
``Segment.select`` finds a boundary from the nearest sample; no table of offsets is kept.

Cases: null and empty texts give a document of the end id alone; rows that repeat a doc_id stay apart,
ordered by a hash of their texts; null doc_ids come first; an empty table gives no rows; other columns
of the input are never read. A document is never split, so a segment is as long as its longest document
or the segment bound.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ship, shared_dir

HEADER = np.dtype([("magic", "S4"), ("width", "u1"), ("low", "u1"), ("pad", "<u2"), ("docs", "<u8"), ("ids", "<u8"), ("high", "<u8")])
#: One select sample for so many boundaries.
SAMPLE = 64
SEGMENT_SCHEMA = "part int, start long, n_docs long, n_ids long, data binary"


def elias_fano(values: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """(low bits, packed lows, unary highs, select samples) of non-decreasing values up to universe."""
    n = len(values)
    low = max(0, int(universe // max(n, 1)).bit_length() - 1)
    v = values.astype(np.uint64)
    lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    return low, np.packbits(lows.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()


def write_segment(doc_ids: list, lengths: list[int], ids: bytes, width: int) -> bytes:
    """One segment of documents whose ids (unsigned 32-bit) stand one after the other."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))])
    low, lows, highs, samples = elias_fano(ends, int(ends[-1]))
    head = np.zeros(1, HEADER)
    head[0] = (b"ELF1", width, low, 0, len(doc_ids), ends[-1], len(highs))
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.packbits(np.array([d is None for d in doc_ids], np.uint8), bitorder="little").tobytes()
    body = np.frombuffer(ids, "<u4")
    return b"".join([head.tobytes(), keys, nulls, lows, highs, samples, (body.astype("<u2") if width == 2 else body).tobytes()])


class Segment:
    """Reads one segment."""

    def __init__(self, data: bytes):
        h = np.frombuffer(data, HEADER, 1)[0]
        if h["magic"] != b"ELF1":
            raise ValueError("not a segment")
        self.n, self.n_ids, self.low = int(h["docs"]), int(h["ids"]), int(h["low"])
        at = HEADER.itemsize

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return data[at - size : at]

        m = self.n + 1
        self.doc_ids = np.frombuffer(take(8 * self.n), "<i8")
        self.nulls = np.unpackbits(np.frombuffer(take((self.n + 7) // 8), np.uint8), count=self.n, bitorder="little").astype(bool)
        self.lows = np.unpackbits(np.frombuffer(take((m * self.low + 7) // 8), np.uint8), count=m * self.low, bitorder="little").reshape(m, self.low)
        self.high = np.frombuffer(take(int(h["high"])), np.uint8)
        self.samples = np.frombuffer(take(4 * -(-m // SAMPLE)), "<u4")
        self.ids = np.frombuffer(data, "<u2" if h["width"] == 2 else "<u4", self.n_ids, at)

    def _low(self, i):
        return self.lows[i].astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def select(self, i: int) -> int:
        """Boundary i: where document i begins, or for i = documents, where the last one ends."""
        start = int(self.samples[i // SAMPLE])
        byte, rest = start >> 3, i % SAMPLE
        span = 64
        while True:
            bits = np.unpackbits(self.high[byte : byte + span], bitorder="little")
            bits[: start - 8 * byte] = 0
            ones = np.flatnonzero(bits)
            if len(ones) > rest:
                return (8 * byte + int(ones[rest]) - i << self.low) + int(self._low(i))
            span *= 4

    def bounds(self) -> np.ndarray:
        """All boundaries."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((ones - np.arange(len(ones))) << self.low) + self._low(slice(None))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 20, path: str | None = None) -> str:
    """Encode every document and write segments in ascending order of id_col; returns the folder.

    The order is by range partition, then by segment within it; a segment holds its start within its partition. Rows of
    one id are parted by the hash of their texts too. Memory in a worker is bounded by segment_ids and the longest document.
    """
    import uuid

    ship(docs.sparkSession)
    path = path or f"{shared_dir(docs.sparkSession)}/auditloom/tokens-{uuid.uuid4().hex}"

    def encode(batches):
        from pyspark import TaskContext

        from auditloom.llm.tokens import encoder

        enc = encoder(tokenizer)
        width = 2 if enc.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        part, start = TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        keys, lengths, parts, held = [], [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "start": pa.array([start], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "data": pa.array([write_segment(keys, lengths, b"".join(parts), width)], pa.binary())})

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                got = enc.ids(text.as_py())
                keys.append(key)
                parts += (got, end)
                lengths.append(len(got) // 4 + 1)
                held += lengths[-1]
                if held >= segment_ids:
                    yield flush()
                    start += held
                    keys, lengths, parts, held = [], [], [], 0
        if keys:
            yield flush()

    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    order = ("_id", F.xxhash64("_text"))
    plain.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """(start, data) of each segment of a folder, start counted over all of them. Segments stay where they are read.

    The driver adds up the ids of the range partitions, a number for each.
    """
    segs = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sums = sorted((r["part"], r["n"]) for r in segs.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in sums]).tolist()
    starts = spark.createDataFrame([(part, at) for (part, _), at in zip(sums, before)], "_part int, _before long")
    return segs.join(F.broadcast(starts), F.col("part") == F.col("_part")).select((F.col("start") + F.col("_before")).alias("start"), "data")


def decode(placed: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of placed segments, read through their Elias-Fano boundaries."""

    def rows(batches):
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1)):
                s = Segment(data.as_py())
                at = s.bounds()
                raw = s.ids.astype("<u4").tobytes()
                out = {
                    "doc_id": pa.array(s.doc_ids, pa.int64(), mask=s.nulls), "start": pa.array(at[:-1] + start, pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s.ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return placed.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, with_ids: bool = False, **kw) -> DataFrame:
    """Write the segments of docs and read every document back from them."""
    return decode(read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, end_id, **kw)), with_ids)
