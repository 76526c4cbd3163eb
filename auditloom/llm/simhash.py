"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are taken over word shingles; a bit is set if it is in over half of the shingles' hashes. They
are joined within a ``Budget``: ``total`` differing bits of a whole fingerprint, and of each of its ``words``
(stretches of ``word_bits`` bits) at most ``word`` for a pair to be met there. The words of a fingerprint are joined one
by one: a word's bits, dealt from one of its ``word`` + 1 blocks, then from the others, form a binary trie;
node pairs are descended together, adding up differing bits, and a pair of nodes is dropped once they exceed what its depth
allows. Of ``word`` + 1 blocks one is whole wherever ``word`` bits differ, so each table of a word allows no
error in its first block and pairs of different first blocks are never met: a fingerprint is copied once for each
table, however many there are. What meets at a leaf is counted over the whole fingerprint.

With one word (the default: 64 bits, 4 differing) all pairs within the budget are found. With several (``WIDE``: 256 bits,
ten words of 25) so are those of which some word keeps its budget.

A task takes the fingerprints that share a table and the first bits of its block. A group of over ``most`` fingerprints
is cut into parts by a hash, and each pair of parts is a task, so no task grows with a dense group. A
task returns a spanning forest of its links, not all pairs, so a group of thousands of copies costs a
row for each member; node pairs that are one component already are not compared again. Components of the forests are those of all links.

Cases: null, empty and blank texts have no words and fingerprint zero, which links like any other;
fewer words than a shingle are one shingle; rows with equal doc_id and text are one document; the
smallest doc_id ignores nulls and is null where a group has no other; an empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ship, stash, unstash
from auditloom.llm.graph import components
from auditloom.llm.hashing import groups, ranges_hashed, word_hashes

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Node pairs of at most so many fingerprints on a side are compared outright.
LEAF = 16
#: Odd; its powers spread a shingle's hash over more lanes.
MIX = 0xD6E8FEB86659FD93
#: Shingles that are spread at once.
STRETCH = 1 << 15
#: Node pairs that are expanded at once: bounds a task's memory.
CHUNK = 1 << 15
LINKS = "src long, dst long"


@dataclass(frozen=True)
class Budget:
    """How fingerprints of ``bits`` bits are compared."""

    bits: int = 64
    word_bits: int = 64
    word: int = 4
    total: int = 4

    @property
    def lanes(self) -> int:
        return self.bits // 64

    @property
    def tables(self) -> list[np.ndarray]:
        """Of each table the places of the 64 bits by which its trie descends: a block of a word, the rest of it, then others."""
        out = []
        for at in range(0, self.bits - self.word_bits + 1, self.word_bits):
            for k in range(self.word + 1):
                turn = (np.arange(self.word_bits) + k * self.word_bits // (self.word + 1)) % self.word_bits
                rest = (np.arange(64 - self.word_bits) + self.word_bits) if self.word_bits < 64 else np.empty(0, np.int64)
                out.append((np.concatenate([turn, rest]) + at) % self.bits)
        return out

    @property
    def block(self) -> int:
        """Bits of the smallest block."""
        return self.word_bits // (self.word + 1)

    def allowed(self, depth: int) -> int:
        """Differing bits that the first depth bits of a table may hold."""
        return 0 if depth <= self.block else self.word if depth <= self.word_bits else self.total


#: Jaccard similarity 0.8 of shingle sets means that 38.7 of 256 bits differ on average, with a deviation of 5.7.
WIDE = Budget(256, 25, 2, 44)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (n x lanes, unsigned 64-bit) have each bit, the lowest of the first lane first."""
    n, raw = len(hashes), np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(len(hashes), -1)
    if n < 256:
        return np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.concatenate([np.bincount(raw[:, j], minlength=256) @ BITS for j in range(raw.shape[1])])


def majority(counts: np.ndarray, n: int) -> bytes:
    """The bits that over half of n hashes have."""
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def fingerprint(text: str | None, size: int = 4) -> int:
    """The unsigned 64-bit SimHash of a whole text, by XXH64 (seed 42) of its shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z changes, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([xxh64_intdigest(joined[a:z], 42) for a, z in zip(starts.tolist(), ends[size - 1 :].tolist())], np.uint64)
    return int.from_bytes(majority(bit_counts(hashes[:, None]), len(hashes)), "little")


def wide_fingerprints(texts: list, size: int, lanes: int) -> list[bytes]:
    """SimHashes of lanes x 64 bits of whole texts, repeated shingles counted once; no words: zero."""
    x, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    out = []
    factors = np.array([pow(MIX, k + 1, 1 << 64) for k in range(lanes)], np.uint64)
    for a, z in zip((ends - counts).tolist(), ends.tolist()):
        if a == z:
            out.append(bytes(8 * lanes))
            continue
        first = np.arange(a, max(a + 1, z - size + 1))
        h = np.unique(ranges_hashed(x[a:z], first - a, np.minimum(first + size, z) - a))
        counts = np.zeros(64 * lanes, np.int64)
        for k in range(0, len(h), STRETCH):
            with np.errstate(over="ignore"):
                spread = h[k : k + STRETCH, None] * factors
                spread = (spread ^ spread >> np.uint64(32)) * factors[0]
            counts += bit_counts(spread ^ spread >> np.uint64(32))
        out.append(majority(counts, len(h)))
    return out


def fingerprints(docs: DataFrame, size: int = 4, budget: Budget = Budget(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint, a signed long for each 64 bits."""
    ship(docs.sparkSession)

    def rows(batches):
        for b in batches:
            for i, j in groups(b.column(2)):
                part = b.slice(i, j - i)
                if budget.lanes == 1:
                    fps = np.array([fingerprint(t.as_py(), size) for t in part.column(2)], np.uint64)
                else:
                    fps = np.frombuffer(b"".join(wide_fingerprints(part.column(2).to_pylist(), size, budget.lanes)), "<u8")
                held = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, budget.lanes), pa.int32()), pa.array(fps.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), held], ["doc_id", "text_hash", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    return plain.mapInArrow(rows, "doc_id long, text_hash long, fp array<bigint>")


def link(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Union of the sets of u[i] and v[i]; label holds each element's smallest fellow, kept flat."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return
        u, v = u[differ], v[differ]
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(flat := label[label], label):
            label[:] = flat


def trie_links(keys: tuple, fps: tuple, budget: Budget) -> np.ndarray:
    """Labels over all elements of one side, or of two, once all pairs within the budget are linked.

    keys: sorted unsigned 64-bit keys of each side, by which the trie descends; fps: their whole fingerprints (n x lanes).
    """
    same = len(keys) == 1
    x, y, p, q = keys[0], keys[-1], fps[0], fps[-1]
    shift = 0 if same else len(x)
    label = np.arange(len(x) + (0 if same else len(y)))
    stack = [(0, np.array([[0, len(x), 0, len(y), 0]]))]
    lane = np.arange(LEAF)
    while stack:
        d, nodes = stack.pop()
        if len(nodes) > CHUNK:
            stack.append((d, nodes[CHUNK:]))
            nodes = nodes[:CHUNK]
        # what is one component already needs no look
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        xa, xb, ya, yb, _ = nodes.T
        joined = (label[xa] == label[ya + shift]) & (change[xb - 1] == change[xa]) & (change[yb - 1 + shift] == change[ya + shift])
        nodes = nodes[~joined]
        small = (nodes[:, 1] - nodes[:, 0] <= LEAF) & (nodes[:, 3] - nodes[:, 2] <= LEAF)
        leaves = nodes[small]
        for k in range(0, len(leaves), CHUNK // 16):
            xa, xb, ya, yb, _ = leaves[k : k + CHUNK // 16].T
            i, j = xa[:, None] + lane, ya[:, None] + lane
            a, b = np.minimum(i, len(x) - 1), np.minimum(j, len(y) - 1)
            apart = np.zeros((len(xa), LEAF, LEAF), np.int64)
            for lane_ in range(budget.lanes):
                apart += np.bitwise_count(p[a, lane_][:, :, None] ^ q[b, lane_][:, None, :])
            near = (apart <= budget.total) & (i < xb[:, None])[:, :, None] & (j < yb[:, None])[:, None, :]
            n, a, b = np.nonzero(near)
            if len(n):
                link(label, i[n, a], j[n, b] + shift)
        nodes = nodes[~small]
        if not len(nodes):
            continue
        mids = []
        for v, lo, hi in ((x, nodes[:, 0], nodes[:, 1]), (y, nodes[:, 2], nodes[:, 3])):
            if d < 64:
                bit, mask = np.uint64(1 << (63 - d)), np.uint64(((1 << d) - 1) << (64 - d))
                mids.append(np.clip(np.searchsorted(v, v[lo] & mask | bit), lo, hi))
            else:  # equal keys: halves
                mids.append((lo + hi) // 2)
        xs = ((nodes[:, 0], mids[0]), (mids[0], nodes[:, 1]))
        ys = ((nodes[:, 2], mids[1]), (mids[1], nodes[:, 3]))
        below = []
        for s in (0, 1):
            for t in (0, 1):
                err = nodes[:, 4] + (s != t and d < 64)
                keep = (err <= budget.allowed(d + 1)) & (xs[s][0] < xs[s][1]) & (ys[t][0] < ys[t][1])
                if same:  # a pair of nodes is met once
                    keep &= xs[s][0] <= ys[t][0]
                below.append(np.stack([xs[s][0], xs[s][1], ys[t][0], ys[t][1], err], 1)[keep])
        found = np.concatenate(below)
        stack.append((d + 1, found[np.argsort(found[:, 4], kind="stable")]))
    return label


def keyed(fps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits of n x lanes fingerprints at 64 places (0: the highest of the first lane), as unsigned 64-bit keys."""
    if fps.shape[1] == 1:
        turn = np.uint64(places[0])
        v = fps[:, 0]
        return v << turn | v >> (np.uint64(64) - turn) if turn else v.copy()
    bits = np.unpackbits(np.ascontiguousarray(fps).astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
    return np.ascontiguousarray(np.packbits(bits[:, places], axis=1)).view(">u8").ravel().astype(np.uint64)


def nodes_of(fps: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each fingerprint: itself if it is no longer."""
    if fps.shape[1] == 1:
        return fps[:, 0].view(np.int64)
    at = np.arange(len(fps)) * fps.shape[1]
    return ranges_hashed(np.ascontiguousarray(fps).ravel(), at, at + fps.shape[1]).view(np.int64)


def lanes_of(column: pa.Array, lanes: int) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, lanes)


def near_links(classes: DataFrame, budget: Budget = Budget(), usual: int = 1 << 14, most: int = 1 << 20) -> DataFrame:
    """(src, dst): spanning forests that link every two fingerprints within the budget. classes: distinct ones in column fp.

    usual: about how many fingerprints a task takes; most: how many at most.
    """
    spark = classes.sparkSession
    ship(spark)
    tables = budget.tables
    shown = min(budget.block, max(0, (classes.count() // usual).bit_length()))

    def prefixes(v: np.ndarray, t: int) -> np.ndarray:
        return (keyed(v, tables[t]) >> np.uint64(64 - shown) if shown else np.zeros(len(v), np.uint64)).astype(np.int64) + (t << shown)

    def count(batches):
        held = np.zeros(len(tables) << shown, np.int64)
        for b in batches:
            v = lanes_of(b.column(0), budget.lanes)
            for t in range(len(tables)):
                held += np.bincount(prefixes(v, t), minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["prefix", "n"])

    # at most a row for each table and prefix, of which there are tables x 2^block at most
    sizes = classes.select("fp").mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
    parts = spark.sparkContext.broadcast({r["prefix"]: -(-2 * r["n"] // most) for r in sizes})

    def part_of(v: np.ndarray, k: int) -> np.ndarray:
        return ((nodes_of(v).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(k)).astype(np.int64)

    def deal(batches):
        """A fingerprint goes to each table, and in a large group to each pair of its own part with another."""
        for b in batches:
            v = lanes_of(b.column(0), budget.lanes)
            for t in range(len(tables)):
                prefix = prefixes(v, t)
                rows, first, second = [np.arange(len(v))], [np.zeros(len(v), np.int64)], [np.zeros(len(v), np.int64)]
                for large in set(np.unique(prefix).tolist()) & parts.value.keys():
                    k, at = parts.value[large], np.flatnonzero(prefix == large)
                    own, other = part_of(v[at], k)[:, None], np.arange(k)
                    first[0][at], second[0][at] = -1, -1
                    rows.append(np.repeat(at, k))
                    first.append(np.minimum(own, other).ravel())
                    second.append(np.maximum(own, other).ravel())
                at, one, two = map(np.concatenate, (rows, first, second))
                keep = one >= 0
                at, one, two = at[keep], one[keep], two[keep]
                yield pa.RecordBatch.from_arrays([pa.array(prefix[at]), pa.array(one), pa.array(two), b.column(0).take(pa.array(at))], ["prefix", "one", "two", "fp"])

    def join(key, table):
        prefix, one, two = (k.as_py() for k in key)
        v = lanes_of(table.column("fp").combine_chunks(), budget.lanes)
        sides = [v]
        if one != two:
            part = part_of(v, parts.value[prefix])
            sides = [v[part == one], v[part == two]]
        if not all(map(len, sides)):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
        keys = []
        for n, side in enumerate(sides):
            k = keyed(side, tables[prefix >> shown])
            by = np.argsort(k, kind="stable")
            keys.append(k[by])
            sides[n] = side[by]
        label = trie_links(tuple(keys), tuple(sides), budget)
        own = np.flatnonzero(label != np.arange(len(label)))
        names = nodes_of(np.concatenate(sides))
        return pa.table({"src": names[own], "dst": names[label[own]]})

    return classes.select("fp").mapInArrow(deal, "prefix long, one long, two long, fp array<bigint>").groupBy("prefix", "one", "two").applyInArrow(join, LINKS)


def near_duplicates(docs: DataFrame, size: int = 4, budget: Budget = Budget(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id, keeper) of every row.

    root names the component; keeper marks the rows of its first document by (doc_id, text_hash).
    """

    def named(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(nodes_of(lanes_of(b.column(0), budget.lanes))), *b.columns], ["node", "fp", "least", "first"])

    prints = stash(fingerprints(docs, size, budget, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
    classes = stash(distinct.mapInArrow(named, "node long, fp array<bigint>, least long, first struct<doc_id:bigint,text_hash:bigint>"), "classes")
    linked = components(near_links(classes, budget))
    roots = linked.withColumnRenamed("node", "_n").join(classes, F.col("_n") == F.col("node"), "right").select("fp", F.coalesce("root", "node").alias("root"), "least", "first")
    roots = stash(roots, "class-roots")
    unstash(classes)
    whole = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("keeper"))
    placed = stash(roots.join(whole, "root").select("fp", "root", "component_id", "keeper"), "class-components")
    unstash(roots)
    return prints.join(placed, "fp").select("doc_id", "text_hash", "fp", "root", "component_id", F.struct("doc_id", "text_hash").eqNullSafe(F.col("keeper")).alias("keeper"))


def keep_one_each(docs: DataFrame, size: int = 5, budget: Budget = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near-duplicates of a kept document: one row of each component stays, columns as they are.

    The defaults link fingerprints of five-word shingles that differ by at most 44 of 256 bits, which texts of a Jaccard similarity of 0.8
    or more mostly do and others seldom: an estimate without an exact check, of which the README has the measured shares.
    """
    kept = near_duplicates(docs, size, budget, id_col, text_col).where("keeper").select(F.col("doc_id").alias("__k_id"), F.col("text_hash").alias("__k_text")).distinct()
    return rows_of(docs, kept, id_col, text_col)


def rows_of(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each (__k_id, __k_text), id and text hash, of kept: of rows that differ in other columns only, the first in their order."""
    from pyspark.sql import Window

    kept = stash(kept, "keepers")
    rows = docs.withColumn("__k_key", F.xxhash64(text_col))
    out = rows.join(kept, rows[id_col].eqNullSafe(kept["__k_id"]) & (rows["__k_key"] == kept["__k_text"]), "left_semi")
    others = [c for c, kind in docs.dtypes if c not in (id_col, text_col) and not kind.startswith(("map", "variant", "interval"))]
    w = Window.partitionBy(id_col, "__k_key").orderBy(*(others or [F.lit(1)]))
    return out.withColumn("__k_n", F.row_number().over(w)).where("__k_n = 1").drop("__k_key", "__k_n")
