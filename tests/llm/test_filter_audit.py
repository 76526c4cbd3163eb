import random
import re
from itertools import permutations

from auditloom.llm.filter_audit import audit, failures, lattice

from .helpers import odd_rows, words


def brute(docs, labels):
    """Every order applied document by document."""
    fails = []
    for d, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in docs)}
        fails.append((part or "", {k for k, v in own.items() if v}, any(i == d and q == 1 for i, q, _ in labels), any(i == d and x == 1 for i, _, x in labels)))
    out, shapley = {}, {}
    for part in {p for p, *_ in fails}:
        rows = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(f in r[1] and bool(r[1] & set(order[:step])) for r in rows), sum(r[1] == {f} for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_edges():
    assert len(lattice()) == 80 == len(set(lattice())) and all(not s >> f & 1 for s, f in lattice())


def test_every_order_against_brute_force(spark):
    r = random.Random(2)
    rows = [(d, t, r.choice((None, "", "x", "y"))) for d, t in odd_rows(3)]
    for k in range(60):
        t = words(r, r.choice((3, 150, 260)))
        for f in r.sample(("caps", "sign", "many", "copy"), r.randint(0, 3)):
            t = t.upper() if f == "caps" else t + " #" if f == "sign" else t + "".join(f" {r.random()}" for _ in range(250)) if f == "many" else rows[r.randrange(len(rows))][1]
        rows.append((200 + k, t, r.choice(("x", "y", "z\tz"))))
    labels = [(d, r.choice((0, 1, None)), r.choice((0, 1, None))) for d, *_ in rows if r.random() < 0.5] + [(None, 1, 1), (9999, 1, 1), (200, 1, 0), (200, 0, 1)]
    docs = spark.createDataFrame([(*x, 1, "q", 2) for x in rows], "doc_id long, text string, source string, failed int, part string, quality int")
    said = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, source string")
    got = audit(failures(docs, said)).collect()
    want = brute(rows, [x for x in labels if x[0] is not None])
    assert {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in got} == want and len(got) == len(want) == 600 * 4
    none = spark.createDataFrame([], docs.schema)
    assert audit(failures(none, said)).count() == 0
    assert {tuple(x)[4:6] for x in audit(failures(docs.limit(0).union(docs.where("doc_id = 3")), spark.createDataFrame([], said.schema))).select("*", "step").collect()} and audit(failures(docs, spark.createDataFrame([], said.schema))).where("good_lost > 0 or toxic_lost > 0").count() == 0
