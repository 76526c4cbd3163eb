"""Line dedup against a brute-force version of its rule."""

import random

import pytest

from auditloom.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, gone string, lines int"


def signed_hash(spark, texts):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in texts], "t string").distinct().select("t", F.xxhash64("t").alias("h")).collect()
    return {r.t: r.h for r in rows}


def brute(docs, keys, run, long_words):
    """Removed line numbers by (doc_id, text): every window is compared with all earlier ones."""
    seen, out = {}, {}
    order = sorted({(d, t) for d, t in docs}, key=lambda x: (x[0] is not None, x[0] or 0, keys[x[1]]))
    for d, t in order:
        gone = set()
        solid = [(i, x.replace("\t", " ").replace("\r", " ").strip(" ")) for i, x in enumerate((t or "").split("\n"))] if t is not None else []
        solid = [x for x in solid if x[1]]
        for size in {run, 1}:
            for s in range(len(solid) - size + 1):
                part = solid[s : s + size]
                if size == 1 and run > 1 and len(part[0][1].split()) < long_words:
                    continue
                name = (size, tuple(x for _, x in part))
                if name not in seen:
                    seen[name] = (d, t, part[-1][0])
                elif seen[name][:2] != (d, t) or part[0][0] > seen[name][2]:
                    gone |= {i for i, _ in part}
        out[d, t] = sorted(gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [f"line {k}" for k in range(6)] + ["", "  ", "w " * 55 + "end", "\tline 1 "]
    docs = [(k if r.random() < 0.9 else k // 2, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for k in range(40)]
    docs += [(None, None), (None, "line 1\nline 2\nline 3"), (50, None), (51, ""), docs[0], docs[0]]
    want = brute(docs, signed_hash(spark, [t for _, t in docs]), 3, 50)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    got = dedup_lines(df, report=True).collect()
    assert len(got) == len(docs)
    whole = dedup_lines(df)
    assert whole.columns == df.columns
    texts = sorted((x.doc_id is not None, x.doc_id or 0, x.text or "") for x in got)
    assert texts == sorted((x.doc_id is not None, x.doc_id or 0, x.text or "") for x in whole.collect())
    expected = []
    for d, t in docs:
        gone = want[d, t]
        text = t if t is None or not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        expected.append((d, text, gone))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", x[2])
    assert sorted(((x.doc_id, x.text, x.removed) for x in got), key=key) == sorted(expected, key=key)


def test_empty_table_and_self_overlap(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "\n".join("aaaaaaa"))], "doc_id long, text string")
    assert dedup_lines(df).first().text == "a\na\na"


def brute_with_pairs(docs, keys, long_words):
    """As brute, with windows of two shorter lines that hold long_words words together."""
    seen, out = {}, {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0, keys[x[1]])):
        gone = set()
        solid = [(i, x.strip(" ")) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        for size in (1, 2, 3):
            for s in range(len(solid) - size + 1):
                part = solid[s : s + size]
                n = [len(x.split()) for _, x in part]
                if (size == 1 and n[0] < long_words) or (size == 2 and (max(n) >= long_words or sum(n) < long_words)):
                    continue
                first = seen.setdefault(tuple(x for _, x in part), (d, t, part[-1][0]))
                if first[:2] != (d, t) or part[0][0] > first[2]:
                    gone |= {i for i, _ in part}
        out[d, t] = sorted(gone)
    return out


def test_two_lines_that_are_long_together_match_brute_force(spark):
    r = random.Random(9)
    pool = [" ".join(f"w{k}" for _ in range(n)) for k, n in enumerate((10, 24, 25, 26, 40, 49, 50))] + ["", " "]
    docs = [(k, "\n".join(r.choice(pool + [f"own {r.random()}"] * 5) for _ in range(r.randint(0, 14)))) for k in range(60)]
    docs += [(90, f"a\n{pool[4]}\n\n{pool[1]}\nb"), (91, f"c\n{pool[4]}\n{pool[1]}\nd\n{pool[4]}\n{pool[1]}"), (None, None), docs[0], docs[0]]
    want = brute_with_pairs(docs, signed_hash(spark, [t for _, t in docs]), 50)
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), report=True).collect()
    by = {d: want[d, t] for d, t in docs}
    assert len(got) == len(docs) and all(x.removed == by[x.doc_id] for x in got)
    assert by[91] == [1, 2, 4, 5]
