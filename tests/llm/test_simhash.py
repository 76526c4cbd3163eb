import random
import re

import numpy as np
from xxhash import xxh64_intdigest

import corpus_pipeline
from auditloom.llm import simhash
from auditloom.llm.simhash import WIDE, Budget, fingerprint, keep_one_each, keyed, near_duplicates, near_links, trie_links, wide_fingerprints

from .helpers import odd_docs, odd_rows, words


def slow_print(text, size=4):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hs = [xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints, budget=4):
    """Smallest id reachable, by comparing all pairs."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= budget:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprint():
    for _, t in odd_rows(1):
        assert fingerprint(t) == slow_print(t)


def test_trie_join_matches_all_pairs():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 62, 60).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)) for _ in range(600)], np.uint64)
    v = np.unique(np.concatenate([np.repeat(base, 10) ^ flips, np.uint64(1) << np.arange(64, dtype=np.uint64)]))
    for word in (0, 2, 4):
        budget, want = Budget(word=word, total=word), groups([int(x) for x in v], word)
        together = {k: {k} for k in range(len(v))}
        for table in budget.tables:
            keys = keyed(v[:, None], table)
            by = np.argsort(keys)
            half = len(v) // 2
            one, two = np.sort(keys[:half]), np.sort(keys[half:])
            label = trie_links((keys[by],), (v[by, None],), budget)
            for k, g in enumerate(label.tolist()):
                together[int(by[k])].add(int(by[g]))
            # two sides: links across, and none other than those of one side alone
            across = trie_links((one, two), (v[:half][np.argsort(keys[:half]), None], v[half:][np.argsort(keys[half:]), None]), budget)
            assert (np.bincount(across) > 1).sum() <= (np.bincount(label) > 1).sum() + half
        found = list(range(len(v)))
        for k, others in together.items():
            for o in others:
                a, b = found[k], found[o]
                found = [min(a, b) if x in (a, b) else x for x in found]
        assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_large_groups_are_cut_into_pairs_of_parts(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 62, 20).astype(np.uint64)
    v = np.unique(np.repeat(base, 20) ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)))
    df = spark.createDataFrame([([x],) for x in v.view(np.int64).tolist()], "fp array<bigint>")
    want = groups([int(x) for x in v])
    number = {x: k for k, x in enumerate(v.view(np.int64).tolist())}
    for usual, most in ((1 << 14, 1 << 20), (1 << 5, 60), (1 << 14, 100)):
        found = list(range(len(v)))
        for e in near_links(df, usual=usual, most=most).collect():
            a, b = found[number[e.src]], found[number[e.dst]]
            found = [min(a, b) if x in (a, b) else x for x in found]
        assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_components(spark):
    rows = odd_rows(2)
    got = near_duplicates(odd_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [slow_print(t) for _, t in rows]
    label = groups(prints)
    least = {}
    for (d, _), g in zip(rows, label):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    want = sorted(((d, p, least.get(g)) for (d, _), p, g in zip(rows, prints, label)), key=str)
    assert sorted(((x.doc_id, x.fp[0] % (1 << 64), x.component_id) for x in got), key=str) == want


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def altered(r, text, n):
    w = text.split()
    for k in range(n):
        w[r.randrange(len(w))] = f"changed{k}{r.random()}"
    return " ".join(w)


def test_one_of_each_stays(spark):
    """Against all pairs of wide fingerprints, and against Jaccard similarity on five-word shingles."""
    r = random.Random(3)
    rows = odd_rows(3)
    for k in range(15):
        base = words(r, r.randint(80, 400))
        rows += [(1000 + 20 * k + j, altered(r, base, r.randint(0, len(base.split()) // 60))) for j in range(6)]
    docs = odd_docs(spark, rows)
    got = keep_one_each(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    prints = [int.from_bytes(x, "big") for x in wide_fingerprints([t for _, t in rows], 5, WIDE.lanes)]
    label = groups(prints, WIDE.total)
    assert len(kept) == len(set(label))
    held = [sets(t) for _, t in rows]
    near = {(i, j) for i in range(len(rows)) for j in range(i) if len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j])}
    assert len(near) > 100 and sum(label[i] == label[j] for i, j in near) >= 0.97 * len(near)
    assert all(len(held[i] & held[j]) >= 0.6 * len(held[i] | held[j]) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= WIDE.total)
    empty = spark.createDataFrame([], docs.schema)
    assert keep_one_each(empty).count() == 0 and near_duplicates(empty).count() == 0


def test_stage_joins_near_copies_more_than_four_bits_apart(spark):
    r = random.Random(8)
    rows = []
    while len(rows) < 20:
        base = words(r, 200)
        copy = altered(r, base, 3)
        if (fingerprint(base) ^ fingerprint(copy)).bit_count() > 4 and len(sets(base) & sets(copy)) >= 0.8 * len(sets(base) | sets(copy)):
            rows += [(len(rows), base), (len(rows) + 1, copy)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in got.collect()) == list(range(0, 20, 2))


def test_a_long_text_is_spread_in_stretches(monkeypatch):
    text = words(random.Random(1), 3000)
    whole = wide_fingerprints([text, "x", None], 5, 4)
    monkeypatch.setattr(simhash, "STRETCH", 100)
    assert wide_fingerprints(["", text], 5, 4) == [whole[2], whole[0]] and not any(whole[2])


def test_rows_that_differ_in_other_columns_have_a_defined_keeper(spark):
    from auditloom.llm.simhash import keep_one_each

    docs = spark.createDataFrame([(1, "a b c d e f g", n, {"k": "v"}) for n in ("z", "m", "b", "q")] + [(2, None, "x", None)], "doc_id long, text string, source string, extra map<string,string>")
    for n in (1, 3):
        assert {(x.doc_id, x.source) for x in keep_one_each(docs.repartition(n)).collect()} == {(1, "b"), (2, "x")}
