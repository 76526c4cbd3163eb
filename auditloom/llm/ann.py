"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one from each of several residual codebooks;
the code is found by beam search, which keeps the best partial sums at every codebook. With the code
goes the stored norm of the sum. A query's score for a vector is a sum of table look-ups, one per
codebook; a share of each block of the index, its best by look-ups, is scored again exactly, in double precision, and the
blocks' winners are merged. A task works on one block and a slice of the queries, so it holds rows x slice scores.

Equal vectors are one row of the index, with the smallest ``k`` + 1 of their ids: copies take one place of a
shortlist and are told apart, smaller ids first, after the exact scores.

Codebooks are fitted on a sample of at most ``train_rows`` rows, drawn by a hash of the id; every distinct
vector is coded and indexed. Queries are broadcast in passes of at most ``pass_rows`` rows, each against all
rows in blocks; index blocks are cut by a row count, so no task holds more than one block.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, and neither does a null id; vectors
of different lengths are no candidates of each other, so each length is searched on its own; where rows repeat an id with
other vectors, a pair of ids stands once, at its best score; fewer candidates than asked for are all returned; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import ship, stash

#: Queries scored at once.
SLICE = 128


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(rounds):
        near = (x @ c.T * 2 - (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        sums = (near == np.arange(k)[:, None]).astype(np.float32) @ x
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes (rows x codebooks) of least squared error found with so many partial sums kept."""
    n, (m, k, d) = len(x), books.shape
    norms = (books * books).sum(2)
    rest, error, codes = x[:, None, :], (x * x).sum(1)[:, None], np.zeros((n, 1, 0), np.uint8)
    for j in range(m):
        cost = error[:, :, None] - 2 * (rest @ books[j].T) + norms[j]
        width = min(beam, cost.shape[1] * k)
        flat = cost.reshape(n, -1)
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        parent, word = best // k, best % k
        error = np.take_along_axis(flat, best, 1)
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - books[j][word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[np.arange(n), error.argmin(1)]


def fit(x: np.ndarray, books: int, words: int, beam: int, seed: int = 3) -> np.ndarray:
    """Residual codebooks, then one joint least-squares update against beam-searched codes."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32), []
    for _ in range(books):
        c = kmeans(rest, words, rng)
        out.append(c)
        rest = rest - c[(rest @ c.T * 2 - (c * c).sum(1)).argmax(1)]
    found = np.stack(out)
    codes = beam_encode(x.astype(np.float32), found, beam).astype(np.int64) + np.arange(books) * words
    hot = np.zeros((len(x), books * words), np.float32)
    np.put_along_axis(hot, codes, 1, 1)
    gram = hot.T @ hot + 0.1 * np.eye(books * words, dtype=np.float32)
    prior = 0.1 * found.reshape(books * words, -1)
    return np.linalg.solve(gram.astype(np.float64), (hot.T @ x + prior).astype(np.float64)).reshape(found.shape).astype(np.float32)


def look_ups(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """codebook x word x query: the inner product of each query with each codeword."""
    m, k, d = books.shape
    return (books.reshape(m * k, d) @ q.T.astype(np.float32)).reshape(m, k, len(q))


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; components as doubles, lengths as they are."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, books: int = 24, words: int = 64, beam: int = 4, rerank: int = 200, share: float = 0.04, train_rows: int = 8192, pass_rows: int = 65_536, block_rows: int = 32_768, distance: bool = False, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for each row whose id is divisible by ``every``, its own row left out.

    (query_id, rank, vec_id, score), score in double precision on the original vectors. share: the part of a block's rows,
    the best by look-up score, that each query scores exactly, but no fewer than ``rerank`` rows. distance: rank by smallest Euclidean
    distance instead, by look-ups and the stored norms; the score is then minus its square.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = usable(vectors, id_col, vec_col)
    out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for r in good.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect():  # a row for each length
        if r["count"] > 1:
            out = out.unionByName(_search(good.where(F.size("vec") == r["d"]), r["d"], r["count"], every, k, books, words, beam, rerank, share, train_rows, pass_rows, block_rows, distance))
    return _top(out, k).select("query_id", "rank", "vec_id", "score")


def _search(good: DataFrame, dim: int, total: int, every: int, k: int, books: int, words: int, beam: int, rerank: int, share: float, train_rows: int, pass_rows: int, block_rows: int, distance: bool) -> DataFrame:
    """(query_id, vec_id, score) of vectors of one length, more than the best k."""
    spark = good.sparkSession
    kinds = "query_id long, vec_id long, score double"
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(min(1.0, 1.2 * train_rows / total) * (1 << 40))
    taken = good.where(draw).orderBy(F.xxhash64("id")).limit(train_rows).select("vec").toArrow()
    x = matrix(taken.column("vec").combine_chunks(), dim) if taken.num_rows else np.ones((1, dim))
    model = spark.sparkContext.broadcast(fit(x, books, min(words, 256), beam))

    def encode(batches):
        held = model.value
        for b in batches:
            v = matrix(b.column(1), dim)
            codes = np.concatenate([beam_encode(v[i : i + 2048].astype(np.float32), held, beam) for i in range(0, len(v), 2048)]) if len(v) else np.zeros((0, books), np.uint8)
            norm = np.square(decode(codes, held)).sum(1) if len(v) else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float32()), b.column(1)], ["ids", "code", "norm", "vec"])

    # k other ids are left whichever id asks
    place = Window.partitionBy("vec").orderBy("id")
    ids = good.withColumn("n", F.dense_rank().over(place)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    index = stash(ids.select("ids", "vec").mapInArrow(encode, "ids array<bigint>, code binary, norm float, vec array<double>"), "aq-index")
    asked = good.where(F.pmod("id", F.lit(every)) == 0)
    n_queries = asked.count()
    passes = max(1, -(-n_queries // (pass_rows * 3 // 4)))
    out = None
    for p in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(passes)) == p).select("id", "vec").distinct().orderBy("id").toArrow()
        if not mine.num_rows:
            continue
        batch = spark.sparkContext.broadcast((mine.column("id").to_numpy(), matrix(mine.column("vec").combine_chunks(), dim)))

        def search(batches):
            q_ids, q = batch.value
            held = model.value
            for ids, codes, norms, v in _blocks(batches, block_rows, books, dim):
                for a in range(0, len(q), SLICE):
                    mine = q[a : a + SLICE]
                    tables = look_ups(mine, held)
                    yield _best(q_ids[a : a + SLICE], mine, tables, ids, codes, norms if distance else None, v, k, max(rerank, -int(-share * len(ids) // 1)))

        part = index.mapInArrow(search, kinds)
        part = stash(_top(part, k).select("query_id", "vec_id", "score"), "aq-found") if passes > 1 else part
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], kinds) if out is None else out


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(batches, rows: int, books: int, dim: int):
    """Index batches gathered to blocks of about so many rows."""
    held, n = [], 0

    def give():
        ids = [x for b in held for x in np.split(b.column(0).flatten().to_numpy(), np.cumsum(b.column(0).value_lengths().to_numpy())[:-1])]
        codes = np.frombuffer(b"".join(x.as_py() for b in held for x in b.column(1)), np.uint8).reshape(-1, books)
        norms = np.concatenate([b.column(2).to_numpy() for b in held])
        return ids, codes, norms, np.concatenate([matrix(b.column(3), dim) for b in held])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield give()
            held, n = [], 0
    if held:
        yield give()


def _best(q_ids, q, tables, ids, codes, norms, v, k: int, rerank: int) -> pa.RecordBatch:
    """Each query's k best of a block: look-up scores for all rows, exact scores for the best of those. ids: those of each row, sorted."""
    least, most = np.array([x[0] for x in ids]), np.array([x[-1] for x in ids])
    # the smallest id besides the smallest
    second = np.array([x[np.searchsorted(x, x[0], "right")] if x[0] != x[-1] else x[0] for x in ids])
    score = np.zeros((len(ids), len(q)), np.float32)
    for j in range(codes.shape[1]):
        score += tables[j][codes[:, j]]
    if norms is not None:
        score = 2 * score - norms[:, None]
    score = np.ascontiguousarray(score.T)  # a query's scores side by side
    score[(q_ids[:, None] == least) & (least == most)] = -np.inf
    width = min(rerank, len(ids))
    short = np.argpartition(score, len(ids) - width, axis=1)[:, len(ids) - width :]
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        at = short[i][np.isfinite(score[i, short[i]])]
        exact = v[at] @ q[i] if norms is None else -np.square(v[at] - q[i]).sum(1)
        order = np.lexsort((np.where(least[at] == q_ids[i], second[at], least[at]), -exact))
        for most in (k, len(order)):  # all of the shortlist only where ids repeat
            rows = order[:most]
            others = [ids[j][ids[j] != q_ids[i]][:k] for j in at[rows]]
            named = np.concatenate([*others, np.empty(0, np.int64)]).astype(np.int64)
            scores = np.repeat(exact[rows], [len(x) for x in others])
            own = np.lexsort((named, -scores))
            own = own[np.sort(np.unique(named[own], return_index=True)[1])][:k]
            if len(own) == k:
                break
        out_q.append(np.full(len(own), q_ids[i]))
        out_v.append(named[own])
        out_s.append(scores[own])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))], ["query_id", "vec_id", "score"])
