"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups.

A document's ids (with its end id) are cut at multiples of the sequence length; whole cuts are
sequences of their own. What remains of each document is one item. Items of a group (by a hash of the
document's id and ids, which no order of rows changes; rows that repeat a document within a task are told apart by their
count, so that they are spread over groups) are packed first-fit decreasing: the tree holds each
bin's free room, its inner nodes the most room below, and the descent to the left finds the first bin
that fits. Bins left with more than ``max_pad`` free slots are dissolved: their items are cut into
lengths of powers of two, which fill whole sequences and at the end sequences of power-of-two lengths,
neither of which needs padding.

Cases: null and empty texts are a document of the end id alone; repeated rows are packed as often as
they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ship

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """Tournament tree over bins: the first bin with enough room, in logarithmic time."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take size from the first bin that has it; its number."""
        most, i = self.most, 1
        while i < self.leaves:
            i *= 2
            if most[i] < size:
                i += 1
        most[i] -= size
        at = i - self.leaves
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return at


def first_fit_decreasing(sizes: list[int], room: int) -> list[int]:
    """The bin of each item; ties keep their order."""
    out = [0] * len(sizes)
    if not sizes:
        return out
    tree = RoomTree(len(sizes), room)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[k] = tree.place(sizes[k])
    return out


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_group(docs: list[tuple], room: int, max_pad: int) -> list[tuple]:
    """Pieces (row, start, length, crc, sequence, offset) of one group's (length, whole crcs, rest crc, crcs of the rest's powers)."""
    out, seq = [], 0
    items: list[tuple[int, int, int, int]] = []  # row, start, length, crc
    for row, (n, whole, rest_crc, _) in enumerate(docs):
        for k, crc in enumerate(whole):
            out.append((row, k * room, room, crc, seq, 0))
            seq += 1
        if n % room:
            items.append((row, n - n % room, n % room, rest_crc))
    bins: dict[int, list] = {}
    for item, b in zip(items, first_fit_decreasing([x[2] for x in items], room)):
        bins.setdefault(b, []).append(item)
    loose = []
    for b in sorted(bins):
        held = sum(x[2] for x in bins[b])
        if room - held <= max_pad or held & (held - 1) == 0:
            at = 0
            for x in bins[b]:
                out.append((*x, seq, at))
                at += x[2]
            seq += 1
        else:
            for row, start, n, _ in bins[b]:
                for size, crc in zip(powers(n), docs[row][3]):
                    loose.append((row, start, size, crc))
                    start += size
    loose.sort(key=lambda x: (-x[2], x[0], x[1]))
    left = sum(x[2] for x in loose)
    capacity = at = 0
    for x in loose:  # falling powers of two end exactly where a sequence of power-of-two length ends
        if at == capacity:
            capacity, at = min(room, 1 << (left.bit_length() - 1)), 0
            left -= capacity
            seq += 1
        out.append((*x, seq - 1, at))
        at += x[2]
    return out


def measure(docs: DataFrame, tokenizer: str, end_id: int, groups: int, room: int, id_col: str, text_col: str) -> DataFrame:
    """Each document's length and the checksums of its possible pieces; no ids leave the worker."""

    def rows(batches):
        from pyspark import TaskContext

        from auditloom.llm.tokens import encoder

        enc, end, met = encoder(tokenizer), int(end_id).to_bytes(4, "little"), Counter()
        part = TaskContext.get().partitionId()
        for b in batches:
            cols: dict[str, list] = {"doc_id": [], "n": [], "whole": [], "rest": [], "bits": [], "grp": []}
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.ids(text.as_py()) + end
                n = len(ids) // 4
                at = n - n % room
                cols["doc_id"].append(key)
                cols["n"].append(n)
                cols["whole"].append([zlib.crc32(ids[4 * a : 4 * (a + room)]) for a in range(0, at, room)])
                cols["rest"].append(zlib.crc32(ids[4 * at :]))
                bits = []
                for size in powers(n % room):
                    bits.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at += size
                cols["bits"].append(bits)
                name = f"{key}/{n}/{zlib.crc32(ids)}"
                met[again := hash(name)] += 1
                copy = f"/{part}/{met[again]}" if met[again] > 1 else ""
                cols["grp"].append(zlib.crc32(f"{name}{copy}".encode()) % groups)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(cols["doc_id"], pa.int64()), "n": pa.array(cols["n"], pa.int64()), "whole": pa.array(cols["whole"], pa.list_(pa.int64())), "rest": pa.array(cols["rest"], pa.int64()), "bits": pa.array(cols["bits"], pa.list_(pa.int64())), "grp": pa.array(cols["grp"], pa.int32())})

    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return plain.mapInArrow(rows, "doc_id long, n long, whole array<long>, rest long, bits array<long>, grp int")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, room: int = 4096, group_docs: int = 2048, max_pad: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it comes from, its checksum, and its sequence and place there.

    ``sequence_id`` is the group's number times 2**32 plus the sequence within the group.
    """
    if room & (room - 1):
        raise ValueError("room must be a power of two")
    ship(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))

    def one(key, table):
        d = table.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("rest", "ascending")])
        ids, n = d.column("doc_id").to_pylist(), d.column("n").to_pylist()
        got = pack_group(list(zip(n, d.column("whole").to_pylist(), d.column("rest").to_pylist(), d.column("bits").to_pylist())), room, max_pad)
        base = key[0].as_py() << 32
        rows, start, length, crc, seq, at = zip(*got) if got else ((),) * 6
        return pa.table({
            "doc_id": pa.array([ids[r] for r in rows], pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array([n[r] for r in rows], pa.int64()), "sequence_id": pa.array(np.array(seq, np.int64) + base, pa.int64()), "offset": pa.array(at, pa.int64()),
        })

    return measure(docs, tokenizer, end_id, groups, room, id_col, text_col).groupBy("grp").applyInArrow(one, PIECES)
