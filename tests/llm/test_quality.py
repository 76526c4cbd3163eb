import math
import random
from collections import Counter
from zlib import crc32

import numpy as np

from auditloom.llm.quality import FEATURES, Forest, fit, score, statistics, train

from .helpers import odd_rows, words


def plain(t):
    """Some features of one text without numpy."""
    import re

    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in w]
    lines = [x.split() for x in re.sub("[A-Z]", lambda m: m.group().lower(), re.sub(r"[\x0B-\x0D\x09]", " ", t)).split("\n")]
    lines = [tuple(x for x in line if x) for line in lines if line]
    n = max(1, len(w))
    byte = Counter(re.sub("[A-Z]", lambda m: m.group().lower(), t).encode())
    total = sum(byte.values())
    return {
        "log_words": math.log1p(len(w)), "word_length": sum(map(len, w)) / n, "distinct_words": len(set(low)) / n, "commonest_word": max(Counter(low).values(), default=0) / n,
        "repeated_pairs": 1 - len(set(zip(low, low[1:]))) / max(1, len(w) - 1) * (len(w) > 1), "capitals": len(re.findall("[A-Z]", t)) / max(1, len(re.findall("[A-Za-z]", t))), "title_words": sum("A" <= x[0] <= "Z" for x in w) / n,
        "exclaimed_words": sum(x[-1] == "!" for x in w) / n, "sentence_ends": sum(x[-1] == "." for x in w) / n, "log_lines": math.log1p(len(lines)), "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)) * bool(lines),
        "long_words": sum(len(x) >= 12 for x in w) / n, "digits": len(re.findall("[0-9]", t)) / max(1, len(t)), "letter_entropy": -sum(c / total * math.log2(c / total) for c in byte.values()),
    }


def test_statistics():
    texts = [t for _, t in odd_rows(4)] + ["A\n\nB b\n", "!!", "ÉÉ É\tx\r\n9#", "Same line\nSame line\nsame line"]
    got = statistics(texts)
    assert got.shape == (len(texts), len(FEATURES)) and np.isfinite(got).all()
    for t, row in zip(texts, got):
        for k, v in plain(t).items():
            assert abs(row[FEATURES.index(k)] - v) < 1e-9, (k, t)
    assert np.array_equal(np.concatenate([statistics([t]) for t in texts]), got)


def test_very_long_texts_take_bounded_memory():
    import tracemalloc

    r = random.Random(6)
    long = [words(r, 400) + "\n" for _ in range(50)]
    text = "".join(r.choice(long) for _ in range(3000))  # some 6 MB
    tracemalloc.start()
    (row,) = statistics([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(text), peak / len(text)
    for k, v in plain(text).items():
        assert abs(row[FEATURES.index(k)] - v) < 1e-9, k
    blob = "é" * 2_000_000  # one word
    assert np.isfinite(statistics([blob, "a b", None])).all() and np.array_equal(statistics(["x", blob])[1], statistics([blob])[0])


def walked(forest: Forest, x):
    """A score node by node."""
    total = forest.start
    for feature, cut, value in zip(forest.feature, forest.cut, forest.value):
        node = 0
        while node < len(feature):
            k = feature[node]
            node = 2 * node + 1 + int((forest.edges[k] <= x[k]).sum() > cut[node])
        total += value[node - len(feature)]
    return 1 / (1 + math.exp(-total))


def test_flat_trees_and_boosting():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, len(FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(int)
    forest = train(x[:2000], y[:2000], np.ones(2000))
    p = forest.scores(x)
    assert np.allclose(p[:50], [walked(forest, v) for v in x[:50]])
    assert ((p[2000:] > 0.5) == y[2000:]).mean() > 0.9
    # a single cut is found where it is, and the mean of probabilities is the weighted share
    y = (x[:, 5] > 1).astype(int)
    assert set(train(x, y, np.ones(3000), trees=1, depth=1).feature.ravel()) == {5}
    w = np.where(y == 1, 10.0, 1.0)
    assert abs((train(x[:, :], y, w).scores(x) * w).sum() - (y * w).sum()) < 0.02 * w.sum()


def test_scores_hold_out_and_odd_rows(spark):
    r = random.Random(3)
    rows = odd_rows(5) + [(1000 + k, (words(r, r.randint(20, 200)).capitalize() + ".") if k % 4 else " ".join(w + r.choice(("!!", "###", "&&&")) for w in words(r, 60).upper().split())) for k in range(900)]
    labels = [(d, int(d % 4 != 0), None) for d, _ in rows if d and d >= 1000] + [(1001, None, 1), (None, 1, 1), (5, 1, 0), (77777, 0, 0)]
    docs = spark.createDataFrame([(*x, 1, 0.5, 3) for x in rows], "doc_id long, text string, quality int, score double, _y int")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    forest = fit(docs, said)
    got = {(x.doc_id, x.held_out): x for x in score(docs, forest).collect()}
    assert score(docs, forest).count() == len(rows)
    for d, _ in rows:
        assert (d, d is not None and crc32(str(d).encode()) % 5 == 0) in got
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    out = [x for x in got.values() if x.held_out and x.doc_id >= 1000]
    assert len(out) > 100 and sum(x.predicted == int(x.doc_id % 4 != 0) for x in out) / len(out) > 0.97
    # labels of held-out rows are not read
    turned = spark.createDataFrame([(d, 1 - q if d and crc32(str(d).encode()) % 5 == 0 and q is not None else q, t) for d, q, t in labels], said.schema)
    assert np.array_equal(fit(docs, turned).value, forest.value) and np.array_equal(fit(docs.orderBy("text").repartition(3), said).value, forest.value)


def test_empty(spark):
    docs, said = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert [x.score for x in score(docs, fit(docs, said)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert all(x.score > 0.9 for x in score(docs, fit(docs, one)).collect())
    assert score(docs.limit(0), fit(docs.limit(0), one)).count() == 0
