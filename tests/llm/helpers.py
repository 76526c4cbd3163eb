"""Tables with nulls, repeats, ties and clashing column names."""

import random

VOCAB = "the a of river stone cloud amber silver quick brown lazy dog jumps over fence north wind sun light under bridge".split()
CLASH = "doc_id long, text string, lang string, fp long, root string, text_hash long, _id string, _text string, unit int, pair long, spans string, __k string, gone int, x0 string, h long"


def words(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def odd_rows(seed=0, n=40):
    r = random.Random(seed)
    rows = [(k, words(r, r.randint(0, 120))) for k in range(n)]
    rows += [(n, rows[3][1]), (n + 1, rows[3][1] + " end"), (n + 2, None), (n + 3, ""), (n + 4, " \t\n "), (None, "alone with no id at all"), rows[5], rows[5], (n + 5, words(r, 3000)), (n + 6, "Éa 😀 é ü ŁÓDŹ"), (n + 7, "x"), (n + 8, "x")]
    return rows


def odd_docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, "r", 2, "i", "t", 3, 4, "s", "k", 5, "x", 6) for d, t in rows], CLASH)


def key(x):
    return (x[0] is not None, x[0] or 0, tuple(map(str, x[1:])))
