import numpy as np

from auditloom.llm.ann import SLICE, _best, beam_encode, decode, fit, look_ups, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score double, norm int, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 2, "v") for i, v in rows], SCHEMA)


def test_beam_is_no_worse_than_greedy():
    x = np.random.default_rng(0).normal(size=(600, 16)).astype(np.float32)
    books = fit(x, 6, 16, 4)
    errors = [np.square(decode(beam_encode(x, books, b), books) - x).sum() for b in (1, 8)]
    assert errors[1] < errors[0] < np.square(x).sum()


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(900, 24)).astype(np.float32)
    v[5] = v[6]
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] + [1.0] * 23), (2080, [1.0] * 3), (None, [1.0] * 24), (2100, [float("inf")] * 24)]
    got = nearest(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)] + bad), rerank=100, pass_rows=30).collect()
    ids, d = np.arange(900), v.astype(np.float64)
    by = {}
    for x in sorted(got, key=lambda x: x["rank"]):
        by.setdefault(x.query_id, []).append(x)
    assert sorted(by) == list(range(0, 900, 20))
    hit = 0
    for i, found in by.items():
        s = d @ d[i]
        s[i] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]]
        assert [x["rank"] for x in found] == list(range(1, 21)) and all(abs(x.score - s[x.vec_id]) < 1e-9 for x in found)
        assert [x.vec_id for x in found] == [y for _, y in sorted((-x.score, x.vec_id) for x in found)]
        hit += len(set(top) & {x.vec_id for x in found})
    assert hit >= 0.9 * 20 * len(by)


def test_few_and_none(spark):
    got = nearest(frame(spark, [(0, [1.0, 0.0]), (3, [1.0, 1.0]), (7, [2.0, 0.0]), (8, [2.0, 5.0])])).collect()
    assert [(x["rank"], x.vec_id, x.score) for x in sorted(got, key=lambda x: x["rank"])] == [(1, 7, 2.0), (2, 8, 2.0), (3, 3, 1.0)]
    assert nearest(frame(spark, [])).count() == 0


def test_thousands_of_copies_take_one_place(spark):
    r = np.random.default_rng(4)
    v = r.integers(-8, 9, size=(5000, 8)).astype(np.float32)
    group = r.permutation(5000)[:3500]
    v[group] = v[group[0]]
    got = nearest(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)]), every=250)
    ids, d = np.arange(5000), v.astype(np.float64)
    by = {}
    for x in sorted(got.collect(), key=lambda x: x["rank"]):
        by.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert sorted(by) == list(range(0, 5000, 250))
    near_group = 0
    for i, found in by.items():
        s = d @ d[i]
        s[i] = -np.inf
        top = np.lexsort((ids, -s))[:20]
        assert found == [(int(j), s[j]) for j in top]
        near_group += len(set(top.tolist()) & set(group.tolist()))
    assert near_group >= 20


def test_look_ups_find_the_nearest_where_few_are_scored_exactly():
    """One block of 20,000 rows without structure, 2 % of it reranked."""
    r = np.random.default_rng(5)
    x = r.normal(size=(20_000, 32))
    books = fit(x[:4096], 24, 64, 4)
    codes = np.concatenate([beam_encode(x[i : i + 2000].astype(np.float32), books, 4) for i in range(0, len(x), 2000)])
    q, at = x[::400], np.arange(0, len(x), 400)
    tables = np.einsum("qd,mkd->qmk", q.astype(np.float32), books)
    score, exact = sum(tables[:, j][:, codes[:, j]] for j in range(24)), q @ x.T
    score[np.arange(len(q)), at] = exact[np.arange(len(q)), at] = -np.inf
    short, top = np.argsort(-score, axis=1)[:, :400], np.argsort(-exact, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(top.tolist(), short.tolist())]) >= 0.9


def test_repeated_ids_and_lengths(spark):
    """A pair of ids stands once, at its best score; each length has its own candidates."""
    r = np.random.default_rng(2)
    rows = [(k, r.normal(size=6).tolist()) for k in range(60)] + [(100 + k, r.normal(size=4).tolist()) for k in range(5)]
    rows += [(0, r.normal(size=6).tolist()), (7, r.normal(size=6).tolist()), (20, rows[20][1]), (500, [1.0] * 9)]
    got = nearest(frame(spark, rows), rerank=100).collect()
    want = {}
    for q, x in rows:
        for v, y in rows:
            if q % 20 == 0 and v != q and len(x) == len(y):
                want.setdefault(q, {})[v] = max(want.get(q, {}).get(v, -np.inf), float(np.dot(np.float32(x).astype(float), np.float32(y).astype(float))))
    assert {x.query_id for x in got} == {0, 20, 40, 100}
    for q, held in want.items():
        top = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:20]
        assert [x.vec_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])] == [v for v, _ in top]


def test_a_share_of_a_full_block_is_enough():
    """A block of 32,768 rows without structure: recall with the default share, and the memory that a slice of queries takes."""
    import tracemalloc

    r = np.random.default_rng(6)
    n = 32_768
    x = r.normal(size=(n, 32))
    books = fit(x[:4096], 24, 64, 4)
    codes = np.concatenate([beam_encode(x[i : i + 2000].astype(np.float32), books, 4) for i in range(0, n, 2000)])
    at = np.arange(0, n, n // SLICE)[:SLICE]
    ids, q = [np.array([i]) for i in range(n)], x[at]
    tracemalloc.start()
    got = _best(at, q, look_ups(q, books), ids, codes, None, x, 20, int(0.04 * n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    exact, found = q @ x.T, got["vec_id"].to_numpy().reshape(SLICE, 20)
    exact[np.arange(SLICE), at] = -np.inf
    top = np.argsort(-exact, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(top.tolist(), found.tolist())]) >= 0.95
