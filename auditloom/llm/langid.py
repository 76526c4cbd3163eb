"""Language identification by a linear-chain conditional random field over words.

Each word of a line is labelled with a language: affix, character n-gram, whole-word and lexicon
features give its emission scores, learned transitions tie neighbours, and forward-backward gives each
word's probabilities. A document's score for a language is the mean over its words, so code-switched
text gets the language of most of it. A chain is a line, or ``CHAIN`` words of a longer one; every
word of a text is labelled.

Training, on the driver, by gradient steps on the chain likelihood: the sample is bounded by
``sample_docs`` documents and ``sample_chars`` characters for each language, drawn by a hash of doc_id.
Some training lines are spliced from two languages, which is what the transitions learn from.

Cases: null texts and texts without letters are ``und`` with score 0; without any labelled row every
document is; a null doc_id is not held out and not learned from; repeated rows get equal results; other
columns are not read.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ship

TOKEN = re.compile(r"[^\W\d_]+|\n")
CHAIN = 256
BITS = 16
MASK = (1 << BITS) - 1
#: Which features training saw is kept by more bits than weights are, so that few others share their places.
SEEN_SHIFT = 12
#: What is not a label.
UNKNOWN = "und"


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features (32 bits) of a lower-case word: affixes, n-grams, itself, and the languages whose lexicon has it."""
    b = f"<{word}>".encode()
    n = len(b)
    out = [crc32(b[i : i + 3]) for i in range(n - 2)]
    out += [crc32(b[i : i + 2], 1) for i in range(n - 1)]
    # affixes of four and five bytes with the edge, the word, and what lexicons say of it
    out += (crc32(b[:4], 2), crc32(b[-4:], 3), crc32(b[:5], 2), crc32(b[-5:], 3), crc32(b, 4), crc32(b"%d" % lexicon.get(word, 0), 5))
    return out


def emissions(words: list[str], model: Model) -> np.ndarray:
    """Scores (words x languages), and in a last column the share of a word's features that training saw."""
    if not words:
        return np.zeros((0, len(model.langs) + 1), np.float32)
    lists = [features(w, model.lexicon) for w in words]
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter((k for x in lists for k in x), np.int64)
    sums = np.add.reduceat(np.column_stack([model.weights[flat & MASK], model.seen[flat >> SEEN_SHIFT]]), np.cumsum(sizes) - sizes, axis=0)
    sums[:, -1] /= sizes
    return sums


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward over chains that stand one after the other; all chains advance together.

    Returns the label probabilities of each word, the log-likelihood normaliser, and, with pairs, the
    expected transition counts.
    """
    n, k = scores.shape
    e = np.exp(scores - scores.max(1, keepdims=True))
    t, s = np.exp(trans), np.exp(start - start.max())
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    begin, length = begin[order], lengths[order]
    alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.ones(n)
    a = None
    for i, m in enumerate(alive):
        at = begin[:m] + i
        a = e[at] * (s if i == 0 else a[:m] @ t)
        scale[at] = z = a.sum(1)
        a = a / z[:, None]
        alpha[at] = a
    for i in range(len(alive) - 2, -1, -1):
        m = alive[i + 1]
        at = begin[:m] + i
        beta[at] = (e[at + 1] * beta[at + 1]) @ t.T / scale[at + 1][:, None]
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    if not pairs:
        return p
    inner = np.ones(n, bool)
    inner[begin] = False
    b = np.flatnonzero(inner)
    xi = np.einsum("nj,nk->jk", alpha[b - 1], e[b] * beta[b] / scale[b][:, None]) * t
    return p, xi


class Model:
    """seen: which features the training words had."""

    def __init__(self, langs, weights, trans, start, lexicon, seen):
        self.langs, self.weights, self.trans, self.start, self.lexicon, self.seen = langs, weights, trans, start, lexicon, seen


def lines_of(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in TOKEN.findall(text.lower()):
        if w == "\n" or len(out[-1]) == CHAIN:
            out.append([])
        if w != "\n" and w.isalpha():
            out[-1].append(w)
    return [x for x in out if x]


def train(rows: list[tuple[str, str]], steps: int = 25, lexicon_size: int = 500, seed: int = 7, rate: float = 0.15, decay: float = 1e-5) -> Model:
    """Fit to (lang, text) rows."""
    langs = sorted({x for x, _ in rows})
    code = {x: i for i, x in enumerate(langs)}
    k = len(langs)
    chains = [(code[x], line) for x, text in rows for line in lines_of(text)]
    counts: list[dict[str, int]] = [{} for _ in langs]
    for y, line in chains:
        for w in line:
            counts[y][w] = counts[y].get(w, 0) + 1
    lexicon: dict[str, int] = {}
    for y, c in enumerate(counts):
        for w in sorted(c, key=lambda w: (-c[w], w))[:lexicon_size]:
            lexicon[w] = lexicon.get(w, 0) | 1 << y
    r = np.random.default_rng(seed)
    labels = [[y] * len(line) for y, line in chains]
    texts = [line for _, line in chains]
    for a, b in r.integers(0, max(1, len(chains)), (len(chains) // 8, 2)).tolist():
        ha, hb = (len(texts[a]) + 1) // 2, len(texts[b]) // 2
        if a != b and ha and hb:
            labels.append(labels[a][:ha] + labels[b][hb:])
            texts.append(texts[a][:ha] + texts[b][hb:])
    types = sorted({w for line in texts for w in line})
    number = {w: i for i, w in enumerate(types)}
    tokens = np.array([number[w] for line in texts for w in line], np.int64)
    gold = np.array([y for line in labels for y in line], np.int64)
    lengths = np.array([len(x) for x in texts], np.int64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(lengths) - lengths] = False
    b = np.flatnonzero(inner)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[b - 1], gold[b]), 1)
    lists = [features(w, lexicon) for w in types]
    sizes = np.array([len(x) for x in lists])
    ends, full = np.cumsum(sizes) - sizes, np.fromiter((f for x in lists for f in x), np.int64)
    flat = full & MASK
    weights, trans, start = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, trans)]
    one = np.eye(k)[gold]
    freq = np.bincount(tokens, minlength=len(types)).astype(float)
    for step in range(1, steps + 1):
        scores = np.add.reduceat(weights[flat], ends, axis=0)
        p, xi = marginals(scores[tokens], lengths, trans, start, pairs=True)
        # gradient by word type, then by feature
        by_type = np.stack([np.bincount(tokens, (one - p)[:, y], len(types)) for y in range(k)], 1)
        spread = np.repeat(by_type, sizes, axis=0)
        grad = np.stack([np.bincount(flat, spread[:, y], 1 << BITS) for y in range(k)], 1) / freq.sum() - decay * weights
        for value, g, (m, v) in ((weights, grad, moments[0]), (trans, (gold_pairs - xi) / freq.sum() - 1e-3 * trans, moments[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(langs, weights.astype(np.float32), trans, start, lexicon, np.bincount(full >> SEEN_SHIFT, minlength=1 << 32 - SEEN_SHIFT) > 0)


class Labeller(dict):
    """word -> row of the emission table; rows of new words are filled before they are read. Emptied when it holds ``limit`` words."""

    def __init__(self, model: Model, limit: int = 100_000):
        super().__init__()
        self.model, self.limit, self.new = model, limit, []
        self.table = self.blank()

    def blank(self) -> np.ndarray:
        return np.zeros((1 << 14, len(self.model.langs) + 1), np.float32)

    def __missing__(self, word: str) -> int:
        if word == "\n":
            return -1
        if not word.isalpha() and not any(c.isalpha() for c in word):
            return -2
        row = self[word] = len(self)
        self.new.append(word)
        return row

    def fill(self) -> None:
        if self.new:
            end, first = len(self), len(self) - len(self.new)
            if end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(end, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.float32)])
            self.table[first:end] = emissions(self.new, self.model)
            self.new = []

    def label(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language or -1, its mean probability, mean share of known features) of each whole text."""
        if len(self) > self.limit:
            self.clear()
            self.table = self.blank()
        get, rows = self.__getitem__, []
        for t in texts:
            ws = TOKEN.findall(t.lower()) if t else []
            rows.append(np.fromiter(map(get, ws), np.int64, len(ws)))
        self.fill()
        sizes = np.array([len(x) for x in rows], np.int64)
        flat, doc = np.concatenate(rows + [np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), sizes)
        word = flat >= 0
        # a chain ends at a line's end, a document's end and after CHAIN words
        line = np.cumsum(flat == -1) + doc
        flat, doc, line = flat[word], doc[word], line[word]
        best, score, known = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
        if not len(flat):
            return best, score, known
        new = np.ones(len(flat), bool)
        new[1:] = line[1:] != line[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))
        new |= (np.arange(len(flat)) - first) % CHAIN == 0
        at = np.flatnonzero(new)
        drawn = self.table[flat]
        p = marginals(drawn[:, :-1].astype(np.float64), np.diff(np.append(at, len(flat))), self.model.trans, self.model.start)
        n = np.bincount(doc, minlength=len(texts))
        mean = np.stack([np.bincount(doc, p[:, y], len(texts)) for y in range(p.shape[1])], 1) / np.maximum(n, 1)[:, None]
        some = n > 0
        best[some] = mean[some].argmax(1)
        score[some] = np.clip(mean[some].max(1), 0, 1)
        known[some] = np.bincount(doc, drawn[:, -1], len(texts))[some] / n[some]
        return best, score, known


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, sample_docs: int, sample_chars: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Bounded training rows: for each language the documents of smallest hash, up to both bounds."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = {r[0]: r[1] for r in labelled.groupBy("_lang").count().collect()}
    if not counts:
        return []
    share = F.lit(None).cast("double")
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("_lang") == lang, min(1.0, 2 * sample_docs / n)).otherwise(share)
    # the hash of an id, even over [0, 1)
    drawn = labelled.withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / F.lit(1 << 40)).where(F.col("_h") < share)
    picked, held = [], {}
    # of rows that repeat an id in one language the shortest text, so that they take one place and no more is collected than was picked
    heads = drawn.groupBy("_lang", "_id", "_h").agg(F.min(F.length("_text")).alias("n"))
    for r in heads.orderBy("_h").limit(4 * sample_docs * len(counts)).collect():
        docs_, chars = held.get(r["_lang"], (0, 0))
        if docs_ < sample_docs and (not docs_ or chars + r["n"] <= sample_chars) and r["n"] <= sample_chars:
            held[r["_lang"]] = (docs_ + 1, chars + r["n"])
            picked.append((r["_id"], r["_lang"]))
    long = sorted(set(counts) - set(held))  # languages of longer texts only: each one's shortest, as far as the bound goes
    extra = [(r[0], r[1]) for r in labelled.where(F.col("_lang").isin(long)).groupBy("_lang").agg(F.min_by(F.substring("_text", 1, sample_chars), F.struct(F.length("_text"), "_id"))).collect()] if long else []
    wanted = docs.sparkSession.createDataFrame(sorted(set(picked)), "_want long, _as string") if picked else None
    if wanted is None:
        return sorted(extra)
    mine = drawn.join(F.broadcast(wanted), (F.col("_id") == F.col("_want")) & (F.col("_lang") == F.col("_as")))
    rows = mine.groupBy("_id", "_lang").agg(F.min_by("_text", F.struct(F.length("_text"), "_text")).alias("_text")).collect()
    return [(r["_lang"], r["_text"]) for r in sorted(rows, key=lambda r: (r["_id"], r["_lang"], r["_text"]))] + sorted(extra)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 250, sample_chars: int = 200_000, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, known) of every row, then the columns named in extra, under their own names.

    known: the mean share of a word's features (n-grams, affixes) that training saw, 0 to 1.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = sample(docs, sample_docs, sample_chars, id_col, text_col, lang_col)
    model = spark.sparkContext.broadcast(train(rows) if rows else None)

    def label(batches):
        work = Labeller(model.value) if model.value is not None else None
        names = np.array([*(model.value.langs if work is not None else []), UNKNOWN], object)
        for b in batches:
            texts, sizes = b.column(2), 0
            best, score, known = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.zeros(b.num_rows)
            first = 0
            for i in range(b.num_rows if work is not None else 0):
                sizes += len(texts[i].as_buffer()) if texts[i].is_valid else 0
                if sizes > 1 << 20 or i == b.num_rows - 1:
                    at = slice(first, i + 1)
                    best[at], score[at], known[at] = work.label([t.as_py() for t in texts[at]])
                    first, sizes = i + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(known), *b.columns[3:]], ["doc_id", "held_out", "lang_pred", "score", "known", *(f"x{i}" for i in range(len(extra)))])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)])
    out = plain.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double, known double" + "".join(f", x{i} {kinds[c]}" for i, c in enumerate(extra)))
    return out.withColumnsRenamed({f"x{i}": c for i, c in enumerate(extra)}) if extra else out


def keep_identified(docs: DataFrame, least: float = 0.3, familiar: float = 0.6, languages: tuple[str, ...] | None = None, **kw) -> DataFrame:
    """docs without rejected ones, columns as they are.

    Rejected are texts without letters, those of no language of score ``least`` or more, those whose words know less than
    ``familiar`` of their features (a score is shared out among learned languages only, so it can be high for a text in
    none of them), and those of a language that is not wanted. A table without labelled rows keeps nothing.
    """
    found = identify(docs, extra=tuple(docs.columns), **kw).toDF("__i_id", "__i_out", "__i_lang", "__i_score", "__i_known", *docs.columns)
    good = (F.col("__i_lang") != UNKNOWN) & (F.col("__i_score") >= least) & (F.col("__i_known") >= familiar)
    return found.where(good & F.col("__i_lang").isin(list(languages)) if languages else good).drop("__i_id", "__i_out", "__i_lang", "__i_score", "__i_known")
