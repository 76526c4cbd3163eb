import random

import pytest

from auditloom.llm.substring_dedup import remove_repeats, units_of

from .helpers import key, odd_docs, words
from .test_line_dedup import signed_hash


def brute(docs, hashes, least, unit):
    seen, out = set(), {}
    for d, t in sorted({x for x in docs}, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]])):
        if t is None:
            out[d, t] = (None, [])
            continue
        places, marks = units_of(t, unit), []
        for a, z in places:
            w = tuple(t[a:z].lower().split())
            marks.append(None if not w else w in seen)
            if w:
                seen.add(w)
        spans, run = [], []
        for k, m in [*enumerate(marks), (-1, False)]:
            if m:
                run.append(places[k])
            elif m is False:
                if sum(len(t[a:z].split()) for a, z in run) >= least:
                    spans += run
                run = []
        kept = [t[a:z] for a, z in places if (a, z) not in spans or a == z]
        out[d, t] = (t if not spans else ("\n" if unit == "line" else "\n\n").join(kept), [list(s) for s in spans])
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_matches_brute_force(spark, unit):
    r = random.Random(4)
    pool = [words(r, n) for n in (3, 8, 15, 15, 40)] + ["", " "]
    docs = [(k, "\n".join(r.choice(pool + [words(r, 6)]) for _ in range(r.randint(0, 9)))) for k in range(30)]
    docs += [(None, None), (None, pool[4]), (40, ""), docs[2], docs[2], (41, pool[4].upper() + "\n" + words(r, 2000))]
    want = brute(docs, signed_hash(spark, [t for _, t in docs]), 30, unit)
    df = odd_docs(spark, docs)
    got = remove_repeats(df, unit=unit, report=True).collect()
    assert sorted(((x.doc_id, x.text, x["spans"]) for x in got), key=key) == sorted(((d, *want[d, t]) for d, t in docs), key=key)
    whole = remove_repeats(df, unit=unit)
    assert whole.columns == df.columns and sorted(((x.doc_id, x.text) for x in whole.collect()), key=key) == sorted(((d, want[d, t][0]) for d, t in docs), key=key)


def test_passages_go_and_short_lines_stay(spark):
    r = random.Random(5)
    passage, short = words(r, 60), words(r, 6)
    docs = [(k, f"{words(r, 20)}\n{short}\n{passage}\n{words(r, 20)}") for k in range(12)]
    got = {x.doc_id: x for x in remove_repeats(odd_docs(spark, docs), report=True).collect()}
    assert got[0].n_removed == 0 and all(passage not in got[k].text and docs[k][1].startswith(got[k].text.split("\n")[0]) for k in range(1, 12))
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_words(docs, hashes, size):
    """Word numbers that a document loses: those in windows that stand earlier without overlap."""
    first, out = {}, {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]])):
        w, gone = (t or "").lower().split(), set()
        for s in range(len(w) - size + 1):
            at = first.setdefault(tuple(w[s : s + size]), (d, t, s))
            if at[:2] != (d, t) or s >= at[2] + size:
                gone.update(range(s, s + size))
        out[d, t] = gone
    return out


def test_passages_inside_lines_match_brute_force(spark):
    r = random.Random(6)
    pool = [words(r, n).split() for n in (49, 50, 51, 70, 130)]
    docs = []
    for k in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(pool)
            a = r.randint(0, 12)
            w += words(r, r.randint(1, 30)).split() + (p[a : len(p) - r.randint(0, 12)] if r.random() < 0.6 else p)
        docs.append((k, "".join(x + r.choice(" " * 19 + "\n") for x in w) + words(r, 5)))
    docs += [(None, None), (None, docs[7][1]), (70, ""), docs[2], docs[2], (71, docs[9][1].upper()), (72, "again " * 300), (73, "x " + "to and fro " * 90)]
    want = brute_words(docs, signed_hash(spark, [t for _, t in docs]), 50)
    assert sum(map(bool, want.values())) > 30
    got = remove_repeats(odd_docs(spark, docs), least_words=10**6, report=True, passage_words=50).collect()
    assert len(got) == len(docs)
    for x in got:
        t = next(t for d, t in docs if d == x.doc_id and ((t is None) == (x.text is None)) and (d, t) in want)
        kept = [w for n, w in enumerate((t or "").split()) if n not in want[x.doc_id, t]]
        assert (x.text or "").split() == kept, x.doc_id
        assert x.removed_chars == sum(e - s for s, e in x["spans"]) and all(a[1] <= b[0] for a, b in zip(x["spans"], x["spans"][1:]))


def test_query_cuts_a_passage_that_begins_and_ends_inside_lines(spark, tmp_path):
    from auditloom.llm.queries import op3_substring_dedup

    r = random.Random(7)
    passage = words(r, 61)
    docs = [(k, f"{words(r, 9)}\n{words(r, 12)} {passage} {words(r, 14)}\n{words(r, 8)}") for k in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[0].n_removed == 0 and all(got[k].n_removed == 1 and passage not in got[k].text and got[k].text.count("\n") == 2 for k in (1, 2, 3))
