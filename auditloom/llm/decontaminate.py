"""Benchmark decontamination with suffix arrays over shards of the training documents.

A task reads its documents in shards of bounded size. A shard's words become numbers (the benchmark's
vocabulary; any other word ends every suffix, as no benchmark text can match across it), and the
positions of known words are sorted into a suffix array. Every suffix of every benchmark item that is long enough to
begin a window is then binary-searched in it: the range of suffixes that begin with its window gives all occurrences of that
window. The longest verbatim match of each occurrence is the longest prefix it shares with its neighbours among the sorted
suffixes of the benchmark, so it costs one value a position, however often the benchmark repeats its words; a document's longest
is told with its item and place. Documents are never shuffled, and a shard's answer is complete for its documents.

The benchmark is broadcast in blocks of at most ``block_words`` words. A larger one is searched block
by block, each in its own pass; a document's hits of all passes are then united by word position.

Cases: null and blank texts have no words, no hits, and are clean; items without words have no window;
items that repeat an item_id count once; null item_ids are left out of the lists; repeated rows each
get their own result; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ship, stash
from auditloom.llm.hashing import powers, ranges_hashed

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of the suffixes that one sort key holds.
STEP = 4


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased; in UTF-8 any byte of a character beyond ASCII is part of a word."""
    return WORD.findall((text or "").encode().lower())


class Numbers(dict):
    """word -> number; 0 for words that the benchmark lacks."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Benchmark:
    """A block of items as word numbers (from 1), with its windows."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names = [x for x, _ in items]
        texts = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(t)], np.int64) for _, t in items]
        self.lookup = Numbers(self.numbers)
        gap = np.zeros(1, np.int64)
        self.flat = np.concatenate([np.concatenate([t, gap]) for t in texts] + [gap])
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        sizes = np.minimum(window, self.lengths)
        count = np.where(sizes > 0, self.lengths - sizes + 1, 0)
        item = np.repeat(np.arange(len(texts)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.starts[item]
        size = sizes[item]
        # places by window: equal ones stand together
        name = ranges_hashed(self.flat.astype(np.uint64), at, at + size)
        order = np.lexsort((at, name))
        new = np.ones(len(order), bool)
        new[1:] = name[order][1:] != name[order][:-1]
        places, first = at[order], np.append(np.flatnonzero(new), len(order))
        #: of each window one place in flat and its length
        self.at, self.size = places[first[:-1]], size[order][first[:-1]]
        if compare(self.flat, places, self.flat, np.repeat(self.at, np.diff(first)), size[order]).any():
            raise ValueError("two windows have one hash")
        # the items of each window, each once
        which = np.repeat(np.arange(len(self.at)), np.diff(first))
        pairs = np.unique(np.stack([which, item[order]], 1), axis=0)
        self.owners = pairs[:, 1]
        self.owned = np.searchsorted(pairs[:, 0], np.arange(len(self.at) + 1))
        # the suffixes that a longer match can go on in, and of each whole window where they stand
        self.window = window
        self.sa = suffix_array(self.flat, len(self.numbers), window)
        self.item_at = np.repeat(np.arange(len(texts)), self.lengths + 1)
        self.prefixes = Prefixes(self.flat)
        self.low, self.high = (np.where(self.size == window, search(self.flat, self.sa, self.flat, self.at, self.size, right), 0) for right in (False, True))

    def longest(self, text: Prefixes, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each occurrence, the words of its longest match, and the range of suffixes that have so many.

        The suffixes with one's longest common prefix stand where it would: one search in those that share the window.
        """
        low, high = self.low[which], self.high[which]
        run, a, z = self.size[which].copy(), low.copy(), high.copy()
        some = np.flatnonzero(high > low)
        x, lo, hi = at[some], low[some], high[some]
        first, last = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            n = common(text, x[open_], self.prefixes, self.sa[mid])
            up = text.flat[x[open_] + n] > self.flat[self.sa[mid] + n]
            lo[open_[up]], hi[open_[~up]] = mid[up] + 1, mid[~up]
        best = np.zeros(len(x), np.int64)
        for there, off in ((lo > first, -1), (lo < last, 0)):
            k = np.flatnonzero(there)
            best[k] = np.maximum(best[k], common(text, x[k], self.prefixes, self.sa[lo[k] + off]))
        run[some] = best
        for right in (False, True):
            lo, hi = first.copy(), last.copy()
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                n = np.minimum(common(text, x[open_], self.prefixes, self.sa[mid]), best[open_])
                whole = n == best[open_]
                more = text.flat[x[open_] + np.where(whole, 0, n)] > self.flat[self.sa[mid] + np.where(whole, 0, n)]
                up = more | whole if right else more
                lo[open_[up]], hi[open_[~up]] = mid[up] + 1, mid[~up]
            (z if right else a)[some] = lo
        return run, a, z

    def first_owner(self, which: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The first item of each range of suffixes, or of the window where the range is empty."""
        out = self.owners[self.owned[which]] if len(which) else which
        some = np.flatnonzero(z > a)
        if len(some):
            ranges, back = np.unique(np.stack([a[some], z[some]], 1), axis=0, return_inverse=True)
            out[some] = np.array([self.item_at[self.sa[x:y]].min() for x, y in ranges.tolist()])[back.ravel()]
        return out


def suffix_array(flat: np.ndarray, words: int, least: int = 1) -> np.ndarray:
    """Positions of flat sorted by the words that follow up to the next 0. flat ends in 0s.

    The first key holds ``STEP`` words; then what is tied is sorted by the rank of what follows, over twice as many words each
    time, so repeated words cost a logarithm of their number. Suffixes of fewer than ``least`` words are left out: no window can
    begin there. Equal suffixes stand in any order.
    """
    base = words + 1
    step = STEP if base < 1 << 15 else 3 if base < 1 << 20 else 2
    padded = np.concatenate([flat, np.zeros(step, np.int64)])
    # only runs of words that hold a long enough suffix; their shorter suffixes are sorted with them, as what follows others
    ends = np.flatnonzero(padded == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = np.where(ends - starts >= least, ends - starts, 0)
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    if not len(at):
        return at
    stop = np.repeat(ends, size)  # where each suffix ends
    k, open_ = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for j in range(step):
        open_ &= at + j < stop
        k = k * base + np.where(open_, padded[at + j], 0)
    by = np.argsort(k, kind="stable")
    order, stop, k = at[by], stop[by], k[by]
    new = np.ones(len(order), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank = np.full(len(flat) + 1, -1, np.int64)  # of the suffix at each position: the place of its group
    rank[order] = first
    depth = step
    while True:
        tied = np.zeros(len(order), bool)
        tied[1:] = first[1:] == first[:-1]
        tied[:-1] |= tied[1:]
        # those that have ended are equal to their fellows and stand before those that go on
        go = np.flatnonzero(tied)
        if not len(go) or not (order[go] + depth < stop[go]).any():
            break
        o, s, g = order[go], stop[go], first[go]
        k = np.where(o + depth < s, rank[np.minimum(o + depth, len(flat))], -1)
        by = np.lexsort((k, g))
        o, s, g, k = o[by], s[by], g[by], k[by]
        order[go], stop[go] = o, s
        fresh = np.ones(len(go), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        first[go] = np.maximum.accumulate(np.where(fresh, go, 0))
        rank[o] = first[go]
        depth *= 2
    return order[stop - order >= least]


class Prefixes:
    """Hashes of ranges of word numbers, read off prefix sums, and by them common prefixes."""

    def __init__(self, flat: np.ndarray):
        x = np.append(flat, 0).astype(np.uint64)
        power, self.back = powers(len(x))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(x) * power)])
        self.flat = flat
        ends = np.flatnonzero(np.append(flat, 0) == 0)
        self.left = ends[np.searchsorted(ends, np.arange(len(x)))] - np.arange(len(x))  # words up to the next 0

    def hashed(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[a + n] - self.sums[a]) * self.back[a]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def common(x: Prefixes, at: np.ndarray, y: Prefixes, to: np.ndarray) -> np.ndarray:
    """Words that the suffixes x[at] and y[to] have in common, by halving."""
    low, high = np.zeros(len(at), np.int64), np.minimum(x.left[at], y.left[to])
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_] + 1) // 2
        same = x.hashed(at[open_], mid) == y.hashed(to[open_], mid)
        low[open_[same]], high[open_[~same]] = mid[same], mid[~same] - 1
    return low


def compare(flat: np.ndarray, at: np.ndarray, query: np.ndarray, q_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sign of suffix at[i] against the first size[i] words of query from q_at[i]."""
    out = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for j in range(int(size.max(initial=0))):
        live = live[size[live] > j]
        if not len(live):
            break
        d = flat[np.minimum(at[live] + j, len(flat) - 1)] - query[q_at[live] + j]
        out[live] = np.sign(d)
        live = live[d == 0]
    return out


def search(flat: np.ndarray, sa: np.ndarray, query: np.ndarray, q_at: np.ndarray, size: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each query prefix: the first suffix not below it (right: above it)."""
    lo, hi = np.zeros(len(q_at), np.int64), np.full(len(q_at), len(sa), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        c = compare(flat, sa[mid], query, q_at[open_], size[open_])
        up = c <= 0 if right else c < 0
        lo[open_[up]], hi[open_[~up]] = mid[up] + 1, mid[~up]
    return lo


class Shard:
    """Documents as one array of word numbers, each ended by a 0, and its suffix array.

    least: the shortest suffix indexed; 0 stands for the shortest window.
    """

    def __init__(self, texts: list, bench: Benchmark, least: int = 0):
        get, lists = bench.lookup.__getitem__, []
        self.n_words = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            ws = words_of(t)
            self.n_words[i] = len(ws)
            lists.append(np.fromiter(map(get, ws), np.int64, len(ws)))
            lists.append(np.zeros(1, np.int64))
        self.flat = np.concatenate(lists + [np.zeros(1, np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])[:-1]
        self.bench = bench
        self.sa = suffix_array(self.flat, len(bench.numbers), least or int(bench.size.min(initial=1 << 30)))

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence of every window of the benchmark."""
        b = self.bench
        low = search(self.flat, self.sa, b.flat, b.at, b.size, False)
        high = search(self.flat, self.sa, b.flat, b.at, b.size, True)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        first = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return self.sa[first + np.arange(len(which))], which

    def hits(self) -> tuple[np.ndarray, list[list], np.ndarray]:
        """Which words of the shard are hit, and of each document the numbers of its items and its longest match.

        A longest match is (words, item, first word in the document); of equals the first in the document, then the first item.
        """
        b = self.bench
        at, which = self.occurrences()
        edge = np.zeros(len(self.flat) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + b.size[which], -1)
        mask = np.cumsum(edge)[:-1] > 0
        items: list[list] = [[] for _ in self.starts]
        longest = np.zeros((len(self.starts), 3), np.int64)
        if not len(at):
            return mask, items, longest
        doc = np.searchsorted(self.starts, at, side="right") - 1
        # of each document its windows, each once, then their items
        seen = np.unique(np.stack([doc, which], 1), axis=0)
        for d, rows in _runs(seen[:, 0].tolist()):
            items[d] = sorted({k for w in seen[rows.start : rows.stop, 1].tolist() for k in b.owners[b.owned[w] : b.owned[w + 1]].tolist()})
        run, a, z = b.longest(Prefixes(self.flat), at, which)
        best = np.lexsort((at, -run, doc))
        new = np.ones(len(best), bool)
        new[1:] = (doc[best][1:] != doc[best][:-1]) | (run[best][1:] != run[best][:-1]) | (at[best][1:] != at[best][:-1])
        # at one place a window of a short item and a longer one's may end alike: the first item counts
        owner = b.first_owner(which[best], a[best], z[best]) if len(best) < 1 << 12 else None
        head = np.flatnonzero(new)
        lead = head[np.unique(doc[best][head], return_index=True)[1]]
        ends = np.append(head, len(best))[np.searchsorted(head, lead) + 1]
        for x, y in zip(lead.tolist(), ends.tolist()):
            own = owner[x:y] if owner is not None else b.first_owner(which[best[x:y]], a[best[x:y]], z[best[x:y]])
            i = best[x]
            longest[doc[i]] = run[i], own.min(), at[i] - self.starts[doc[i]]
        return mask, items, longest


def spans(mask: np.ndarray) -> list[list[int]]:
    """Runs of True as [first, end)."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).tolist()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """The items in blocks of bounded size, read one row at a time."""
    held, n = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).orderBy(item_col).toLocalIterator():
        size = len(words_of(text))
        if held and n + size > block_words:
            yield held
            held, n = [], 0
        held.append((item, text))
        n += size
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1_000_000, shard_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items, spans, longest, longest_item, longest_at) per row.

    items: sorted as strings; spans: of hit words, [first, end); longest: the words of the document's longest verbatim match
    of a window or more, with its item and first word (0, null and null where there is none).
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    schema = "doc_id long, text_hash long, n_words long, n_hit long, items array<string>, spans array<array<int>>, longest long, longest_item string, longest_at long"

    def one_pass(items):
        held = spark.sparkContext.broadcast(items)

        def rows(batches):
            bench = Benchmark(held.value, window)
            for b in batches:
                ids, hashes, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
                sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
                cut = np.cumsum(sizes) // shard_bytes
                for _, part in _runs(cut):
                    shard = Shard([t.as_py() for t in texts[part.start : part.stop]], bench)
                    mask, found, longest = shard.hits()
                    none = longest[:, 0] == 0
                    out = [mask[a : a + n] for a, n in zip(shard.starts, shard.n_words)]
                    names = [sorted({bench.names[k] for k in f if bench.names[k] is not None}) for f in found]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids[part.start : part.stop], pa.int64()), "text_hash": pa.array(hashes[part.start : part.stop], pa.int64()), "n_words": pa.array(shard.n_words), "n_hit": pa.array([int(m.sum()) for m in out], pa.int64()),
                        "items": pa.array(names, pa.list_(pa.string())), "spans": pa.array([spans(m) if m.any() else [] for m in out], pa.list_(pa.list_(pa.int32()))),
                        "longest": pa.array(longest[:, 0]), "longest_item": pa.array([None if x else bench.names[k] for x, k in zip(none.tolist(), longest[:, 1].tolist())], pa.string()), "longest_at": pa.array(longest[:, 2], mask=none),
                    })

        return plain.mapInArrow(rows, schema)

    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return one_pass(first)
    parts = [stash(one_pass(x), "contamination") for x in (first, second)] + [stash(one_pass(x), "contamination") for x in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    words = F.flatten(F.transform("spans", lambda s: F.sequence(s[0], s[1] - 1)))
    whole = every.distinct().groupBy("doc_id", "text_hash", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))).alias("hit"), F.min(F.struct((-F.col("longest")).alias("n"), "longest_at", "longest_item")).alias("m"))
    united = whole.select("doc_id", "text_hash", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", F.transform("hit", lambda w: F.array(w, w + 1)).alias("spans"), (-F.col("m.n")).alias("longest"), F.col("m.longest_item").alias("longest_item"), F.col("m.longest_at").alias("longest_at"))
    back = plain.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    return back.join(united, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash"))).select(united.columns)


def _runs(cut):
    """(value, range) of each run of equal values."""
    start = 0
    for k in range(1, len(cut) + 1):
        if k == len(cut) or cut[k] != cut[start]:
            yield cut[start], range(start, k)
            start = k


def contaminated(n_hit, n_words):
    """The rule: some hit, and at least a twentieth of the words hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def items_digest(items):
    """Hex digest of the item_ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without the contaminated ones, columns as they are."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **kw).where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("__c_id"), F.col("text_hash").alias("__c_text")).distinct()
    bad = stash(bad, "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__c_id"]) & (F.xxhash64(docs[text_col]) == bad["__c_text"]), "left_anti")
