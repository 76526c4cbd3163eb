import itertools
import random
from zlib import crc32

import numpy as np

from auditloom.llm.langid import Labeller, identify, keep_identified, marginals, sample, train

SYLLABLES = {"aa": ["ka", "ki", "ko", "ta", "ti"], "bb": ["zu", "zö", "gru", "schi", "ung"], "cc": ["eau", "oi", "é", "lle", "qu"]}


def text(r, lang, n):
    return "\n".join(" ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(8)) for _ in range(max(1, n // 8))).capitalize()


def rows(n=240):
    r = random.Random(0)
    langs = list(SYLLABLES)
    out = [(k, text(r, langs[k % 3], r.randint(8, 80)), langs[k % 3] if k % 11 else None) for k in range(n)]
    return out + [(n, None, "aa"), (n + 1, "", "aa"), (n + 2, "12 34 !?", "bb"), (None, text(r, "cc", 20), "cc"), out[0], out[0], (n + 3, text(r, "aa", 5000).replace("\n", " "), "aa")]


def frame(spark, data):
    return spark.createDataFrame([(d, t, x, "s", 0.5, "q") for d, t, x in data], "doc_id long, text string, lang string, lang_pred string, score double, held_out string")


def test_marginals_are_those_of_all_paths():
    r = np.random.default_rng(0)
    s, t, b = r.normal(size=(4, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    want, pairs, z = np.zeros((4, 3)), np.zeros((3, 3)), 0
    for p in itertools.product(range(3), repeat=4):
        w = np.exp(b[p[0]] + sum(s[i, y] for i, y in enumerate(p)) + sum(t[x, y] for x, y in itertools.pairwise(p)))
        z += w
        for i, y in enumerate(p):
            want[i, y] += w
        for x, y in itertools.pairwise(p):
            pairs[x, y] += w
    both = np.concatenate([s, s[:2]])
    got, xi = marginals(both, np.array([4, 2]), t, b, pairs=True)
    assert np.allclose(got[:4], want / z)
    alone, xi2 = marginals(s[:2], np.array([2]), t, b, pairs=True)
    assert np.allclose(got[4:], alone) and np.allclose(xi - xi2, pairs / z)


def test_code_switched_line():
    m = train([(x, t) for _, t, x in rows() if x and t])
    r = random.Random(5)
    best, score, known = Labeller(m).label([text(r, "bb", 30) + " " + text(r, "cc", 8), "", None, "7"])
    assert known[0] > 0.9 and not known[1:].any()
    assert m.langs[best[0]] == "bb" and 0.5 < score[0] < 0.95 and list(best[1:]) == [-1, -1, -1]


def test_held_out_accuracy_and_odd_rows(spark):
    data = rows()
    got = identify(frame(spark, data)).collect()
    assert len(got) == len(data)
    truth = {d: "aabbcc"[d % 3 * 2 : d % 3 * 2 + 2] for d, _, _ in data if d is not None and d < 240}
    out = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(out) > 30 and sum(x.lang_pred == truth[x.doc_id] for x in out) >= 0.95 * len(out)
    assert all(x.held_out == (x.doc_id is not None and crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert {x.lang_pred for x in got if x.doc_id in (240, 241, 242)} == {"und"}
    assert all(0 <= x.score <= 1 for x in got)


def test_keep(spark):
    docs = frame(spark, rows())
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert keep_identified(spark.createDataFrame([], docs.schema)).count() == 0


def test_unlearned_languages_go(spark):
    r = random.Random(4)
    noise = [" ".join("".join(r.choices("bdfghjmnpqrvwxy", k=r.randint(2, 9))) for _ in range(60)) for _ in range(5)]
    noise += ["Это текст на языке, которого никто не учил, и его здесь быть не должно", "nikt nigdy nie widział takich dziwnych wyrazów w żadnym zbiorze"]
    data = rows() + [(1000 + k, t, None) for k, t in enumerate(noise)]
    kept = {x.doc_id for x in keep_identified(frame(spark, data)).collect()}
    assert not kept & set(range(1000, 1010)) and kept >= set(range(240))


def test_few_words_held_at_once():
    m = train([(x, t) for _, t, x in rows() if x and t])
    r = random.Random(6)
    texts = [text(r, "aabbcc"[k % 3 * 2 :][:2], 60) for k in range(30)]
    small, large = Labeller(m, limit=40), Labeller(m)
    for t in texts:
        assert [x.tolist() for x in small.label([t])] == [x.tolist() for x in large.label([t])]
    assert len(small) < len(large)


def test_a_language_of_long_texts_only_is_learned(spark):
    r = random.Random(7)
    data = [(4 * k, text(r, "aa", 40), "aa") for k in range(30)] + [(4 * k + 1, text(r, "bb", 900), "bb") for k in range(8)]
    got = identify(frame(spark, data), sample_chars=3000).collect()
    assert all(len(t) > 3000 for _, t, x in data if x == "bb") and {x.lang_pred for x in got if x.doc_id % 4 == 1} == {"bb"}


def test_an_id_of_many_texts_gives_one_training_row(spark):
    """Rows that repeat an id in a language with other texts: the shortest is learned from, so the driver gets no more than was picked."""
    k = next(k for k in range(100) if crc32(str(k).encode()) % 4 != 2)
    rows = [(k, f"the cat sat on mat {'x' * n}", "en") for n in range(300)] + [(k, "le chat est ici", "fr"), (k, None, "fr"), (None, "no id", "en")]
    got = sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 250, 200_000, "doc_id", "text", "lang")
    assert sorted(got) == [("en", "the cat sat on mat "), ("fr", "le chat est ici")]
    few = sample(spark.createDataFrame(rows + [(k + 4 * n, f"dog {n}", "en") for n in range(1, 90)], "doc_id long, text string, lang string"), 250, 200_000, "doc_id", "text", "lang")
    assert len(few) == 2 + sum(crc32(str(k + 4 * n).encode()) % 4 != 2 for n in range(1, 90))
