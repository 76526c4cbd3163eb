"""A quality classifier: gradient-boosted trees over histograms of document statistics.

A worker turns each whole text into ``FEATURES``, numbers that come from its words, lines and characters alone, for many texts at
once in numpy. Boosting looks at bins only: each statistic is cut at quantiles of the sample, a tree grows level by level from histograms of
the logistic loss's first and second derivatives, and every tree is a complete one. So a forest is two arrays (feature and bin of each
inner node) and one of leaf values, and scoring is ``depth`` steps of array look-ups for all texts and trees.

Training: at most ``sample_docs`` labelled documents of each label, drawn by a hash of doc_id, weighted so that both labels count
as often as they occur; only their statistics come to the driver, never a text. Documents held out (crc32 of the id as text, mod 5, is 0)
take no part.

Cases: null and empty texts have the statistics of no words and get a score like any other; labels that are null, of unknown ids or held
out don't count, of labels that disagree on one id the greater counts; without labels of both kinds the score is their share, or 0.5
without any; rows that repeat get equal scores; other columns are not read; an empty table has no scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ship
from auditloom.llm.hashing import BLANK, STRETCH, groups, ranges_hashed

FEATURES = (
    "log_words", "word_length", "word_length_deviation", "distinct_words", "commonest_word", "repeated_pairs", "capitals", "capital_words", "title_words", "digits", "symbols", "symbol_words",
    "exclaimed_words", "sentence_ends", "commas", "beyond_ascii", "log_lines", "words_a_line", "repeated_lines", "lines_ended", "short_words", "long_words", "letter_entropy", "marks",
)

_BYTE = np.arange(256)
UPPER, LOWER, DIGIT = ((_BYTE >= a) & (_BYTE <= z) for a, z in ((65, 90), (97, 122), (48, 57)))
BEYOND = _BYTE >= 0xC0  # first bytes of characters beyond ASCII
INSIDE = (_BYTE >= 0x80) & (_BYTE < 0xC0)
SYMBOL = np.isin(_BYTE, list(b"#$%&*|@^~_=+<>{}[]\\`/"))
MARK = (_BYTE > 32) & (_BYTE < 127) & ~UPPER & ~LOWER & ~DIGIT


def repeats(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner, its number of distinct hashes, and how often its commonest occurs."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(o)))
    most = np.zeros(n)
    np.maximum.at(most, o[new], size)
    return np.bincount(o[new], minlength=n).astype(np.float64), most


def words_of(data: np.ndarray) -> dict[str, np.ndarray]:
    """The words of bytes that end in a blank: start, hash (A-Z lower-cased), characters, kind of capitals, first and last byte, line.

    Works in stretches, which end between words, and inside one only where it is longer than a stretch.
    """
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("start", "hash", "length", "shouted", "first", "last", "line")}
    at, line = 0, 0
    while at < len(data):
        z = min(len(data), at + STRETCH)
        while z < min(len(data), at + 2 * STRETCH) and not BLANK[data[z - 1]]:
            z += 1
        part = data[at:z]
        edge = np.diff(BLANK[part].view(np.int8), prepend=np.int8(1), append=np.int8(1))
        a, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = {k: np.concatenate([[0], np.cumsum(v, dtype=np.int32)]) for k, v in (("in", INSIDE[part]), ("up", UPPER[part]), ("low", LOWER[part]), ("feed", part == 10))}
        of = lambda k: sums[k][e] - sums[k][a]  # noqa: E731, B023
        lower = np.where(UPPER[part], part + 32, part).astype(np.uint64) + np.uint64(1)
        rows = (a + at, ranges_hashed(lower, a, e), (e - a - of("in")).astype(np.float64), (of("up") > 1) & (of("low") == 0), part[a], part[e - 1], line + sums["feed"][a])
        for k, v in zip(found, rows):
            found[k].append(v)
        line += int(sums["feed"][-1])
        at = z
    return {k: np.concatenate(v) for k, v in found.items()}


def statistics(texts: list[str | None]) -> np.ndarray:
    """The features of each text, whole texts, rows in order. A line is one that holds a word; lines of equal words are equal."""
    long = [i for i, t in enumerate(texts) if t and len(t) > STRETCH // 4]
    if long and len(texts) > 1:  # those that fill a stretch alone, so that their company changes nothing
        out = np.zeros((len(texts), len(FEATURES)))
        rest = sorted(set(range(len(texts))) - set(long))
        for own in [*([i] for i in long), rest]:
            out[own] = statistics([texts[i] for i in own])
        return out
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = len(raw)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)])
    hist = np.zeros((n, 256))
    for d in range(n):
        for a in range(cuts[d], cuts[d + 1] - 1, STRETCH):
            hist[d] += np.bincount(data[a : min(a + STRETCH, cuts[d + 1] - 1)], minlength=256)
    w = words_of(data)
    owner = np.searchsorted(cuts, w["start"], side="right") - 1
    words = np.bincount(owner, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    of = lambda flags: np.bincount(owner, flags, n) / some
    length, h, last = w["length"], w["hash"], w["last"]
    mean = of(length)
    distinct, most = repeats(owner, h, n)
    with np.errstate(over="ignore"):
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    together = owner[:-1] == owner[1:]
    pairs, _ = repeats(owner[:-1][together], pair[together], n)
    new = np.ones(len(h), bool)
    new[1:] = w["line"][1:] != w["line"][:-1]
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(h)).astype(np.int64)[: len(first)]
    line_owner = owner[first]
    lines = np.bincount(line_owner, minlength=n).astype(np.float64)
    different, _ = repeats(line_owner, ranges_hashed(h, first, end), n)
    count = lambda kind: hist[:, kind].sum(1)
    chars, letters = np.maximum(count(~INSIDE), 1), np.maximum(count(UPPER | LOWER), 1)
    folded = hist.copy()
    folded[:, 97:123] += folded[:, 65:91]
    folded[:, 65:91] = 0
    share = folded / np.maximum(folded.sum(1, keepdims=True), 1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    columns = (
        np.log1p(words), mean, np.sqrt(np.maximum(of(length**2) - mean**2, 0)), distinct / some, most / some, 1 - pairs / np.maximum(words - 1, 1) * (words > 1), count(UPPER) / letters, of(w["shouted"]),
        of(UPPER[w["first"]]), count(DIGIT) / chars, count(SYMBOL) / chars, of(SYMBOL[last]), of(last == 33), of(last == 46), of(last == 44), count(BEYOND) / chars,
        np.log1p(lines), words / np.maximum(lines, 1), 1 - different / np.maximum(lines, 1) * (lines > 0), np.bincount(line_owner, np.isin(last[end - 1], (46, 33, 63)), n) / np.maximum(lines, 1), of(length <= 2), of(length >= 12), entropy, count(MARK) / chars,
    )
    return np.stack(columns, 1)


class Forest:
    """Complete trees of one depth as arrays: feature and bin of the inner nodes, values of the leaves."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, value: np.ndarray, start: float):
        self.edges, self.feature, self.cut, self.value, self.start = edges, feature, cut, value, start

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1).astype(np.int32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        tree = np.arange(len(self.feature))
        for a in range(0, len(x), 2048) if len(self.feature) else ():
            b = self.bins(x[a : a + 2048])
            row = np.arange(len(b))[:, None]
            node = np.zeros((len(b), len(tree)), np.int64)
            while node[0, 0] < inner:
                node = 2 * node + 1 + (b[row, self.feature[tree, node]] > self.cut[tree, node])
            out[a : a + len(b)] += self.value[tree, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(bins: np.ndarray, n_bins: int, g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree from histograms: features and bins of its inner nodes, its leaves' values, and the leaf of each row."""
    n, k = bins.shape
    feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, n_bins, np.int64)
    node = np.zeros(n, np.int64)
    flat = np.arange(k) * n_bins + bins
    for level in range(depth):
        width, first = 1 << level, (1 << level) - 1
        cell = ((node - first)[:, None] * (k * n_bins) + flat).ravel()
        hist = [np.bincount(cell, np.repeat(v, k), width * k * n_bins).reshape(width, k, n_bins).cumsum(2) for v in (g, h)]
        left_g, left_h = hist
        all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
        gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
        gain = np.where((left_h >= least) & (all_h - left_h >= least), gain, 0).reshape(width, -1)
        best = gain.argmax(1)
        good = gain[np.arange(width), best] > 1e-9
        feature[first : first + width] = np.where(good, best // n_bins, 0)
        cut[first : first + width] = np.where(good, best % n_bins, n_bins)
        node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > cut[node])
    leaf = node - ((1 << depth) - 1)
    width = 1 << depth
    value = -np.bincount(leaf, g, width) / (np.bincount(leaf, h, width) + ridge)
    return feature, cut, value, leaf


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, n_bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Boosting of the logistic loss. y: 0 or 1; weight: how often each row counts."""
    share = float((y * weight).sum() / weight.sum()) if len(y) else 0.5
    start = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    if len(set(y.tolist())) < 2:
        return Forest(edges, np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 2)), start)
    bins = Forest(edges, *[np.zeros((0, 1))] * 3, 0).bins(x)
    raw, made = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        feature, cut, value, leaf = grow(bins, n_bins, (p - y) * weight, p * (1 - p) * weight, depth, ridge, least)
        made.append((feature, cut, rate * value))
        raw += rate * value[leaf]
    return Forest(edges, *(np.stack(c) for c in zip(*made)), start)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def described(rows: DataFrame, columns: str) -> DataFrame:
    """The columns named and ``x``, the features of _text, for rows whose last column is _text."""
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            out, texts = np.zeros((b.num_rows, len(FEATURES))), b.column(b.num_columns - 1)
            for a, z in groups(texts):
                out[a:z] = statistics([t.as_py() for t in texts[a:z]])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(out), pa.list_(pa.float64()))], [*names, "x"])

    return rows.mapInArrow(run, f"{columns}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """The forest of a bounded sample of labelled rows."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long"))).groupBy(F.col("doc_id").cast("long").alias("_d")).agg(F.max(label_col).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    share = F.when(F.col("_y") == 1, min(1.0, 1.5 * sample_docs / max(1, counts.get(1, 0)))).otherwise(min(1.0, 1.5 * sample_docs / max(1, counts.get(0, 0))))
    hashed = F.pmod(F.xxhash64("_d"), F.lit(1 << 40)) / F.lit(1 << 40)
    drawn = known.where(hashed < share).orderBy(F.xxhash64("_d")).limit(3 * sample_docs).collect()
    wanted: list[tuple[int, int]] = []
    for y in (0, 1):
        wanted += [(r["_d"], y) for r in drawn if r["_y"] == y][:sample_docs]
    if not wanted:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0))
    picked = F.broadcast(spark.createDataFrame(wanted, "_d long, _y int"))  # 2 * sample_docs rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(picked, F.col("_id") == F.col("_d")).select("_id", "_y", "_text")
    # of rows that repeat an id one is enough: the sample stays bounded
    got = described(rows, "_id long, _y int").groupBy("_id").agg(F.min(F.struct("x", "_y")).alias("r")).orderBy("_id").collect()
    y = np.array([r["r"]["_y"] for r in got], np.int64)
    x = np.array([r["r"]["x"] for r in got]).reshape(-1, len(FEATURES))
    part = np.array([counts.get(k, 0) for k in (0, 1)]) / np.maximum(np.bincount(y, minlength=2), 1)
    weight = part[y]
    return train(x, y, weight / weight.mean() if len(y) else weight)


def score(docs: DataFrame, forest: Forest, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            texts, out = b.column(2), np.zeros(b.num_rows)
            for a, z in groups(texts):
                out[a:z] = shared.value.scores(statistics([t.as_py() for t in texts[a:z]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
