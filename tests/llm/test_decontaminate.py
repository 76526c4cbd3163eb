import random
import re

import pytest

from auditloom.llm.decontaminate import clean_documents, contaminated, contamination, words_of

from .helpers import key, odd_docs, odd_rows, words


def split(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(rows, bench, window=13):
    out = []
    for d, t in rows:
        w, hit, items = split(t), set(), set()
        for name, text in bench:
            b = split(text)
            n = min(window, len(b))
            for s in range(len(b) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[s : s + n]:
                        hit |= set(range(i, i + n))
                        if name is not None:
                            items.add(str(name))
        out.append((d, len(w), len(hit), sorted(items)))
    return out


def tables(spark, seed):
    r = random.Random(seed)
    bench = [(k, words(r, 30)) for k in range(8)] + [(8, "amber river"), (9, None), (10, " . "), (10, words(r, 20)), (None, words(r, 15)), (11, "Éa 😀")]
    rows = odd_rows(seed, 20)
    for k in range(10):
        b = (bench[k][1] or "").upper().replace(" ", ", ")
        rows.append((100 + k, words(r, 5) + " " + b + ". " + words(r, 400 * (k % 2))))
    return rows, bench, spark.createDataFrame([(a, b, 1) for a, b in bench], "item_id long, text string, doc_id int")


def test_words():
    for _, t in odd_rows(1):
        assert [w.decode() for w in words_of(t)] == split(t)


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_matches_brute_force(spark, block_words):
    rows, bench, table = tables(spark, 7)
    docs = odd_docs(spark, rows)
    got = contamination(docs, table, block_words=block_words).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in got), key=key) == sorted(brute(rows, bench), key=key)
    kept = clean_documents(docs, table, block_words=block_words)
    bad = [d for d, n, h, _ in brute(rows, bench) if h and 20 * h >= n]
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(bad) > 0 and bad


def brute_longest(text, bench, window=13):
    """Words, item and place of the longest match that holds a window."""
    w, best = split(text), (0, None, None)
    for name, item in bench:
        b = split(item)
        for i in range(len(w)):
            for s in range(len(b)):
                n = 0
                while i + n < len(w) and s + n < len(b) and w[i + n] == b[s + n]:
                    n += 1
                if n >= min(window, len(b)) and (n > best[0] or (n == best[0] and i < best[2])):
                    best = (n, name, i)
    return best


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_longest_matches(spark, block_words):
    rows, bench, table = tables(spark, 5)
    bench = [(k, t) for k, t in bench if k is not None and k != 10]
    table = spark.createDataFrame(bench, "item_id long, text string")
    r = random.Random(3)
    for k in range(6):
        b = bench[k][1].split()
        rows.append((200 + k, words(r, 20) + " zzz " + " ".join(b[k : k + 14 + k]) + " zzz " + " ".join(b[: 13 + 2 * (k % 2)])))
    got = contamination(odd_docs(spark, rows), table, block_words=block_words).collect()
    want = [(d, *brute_longest(t, bench)) for d, t in rows]
    assert sum(x[1] > 13 for x in want) > 8
    # of equal matches at one place either item may be named
    assert sorted(((x.doc_id, x.longest, x.longest_at) for x in got), key=key) == sorted(((d, n, at) for d, n, _, at in want), key=key)
    held = {(x.doc_id, x.longest_at): x.longest_item for x in got}
    assert sum(held[d, at] == (None if name is None else str(name)) for d, _, name, at in want) >= len(want) - 2


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).first()
    assert (got.n_words, got.n_hit) == (2, 0)
    assert contamination(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
    assert contaminated(1, 20) and not contaminated(1, 21) and not contaminated(0, 0)


def test_repeated_words_take_bounded_memory_and_time():
    import time
    import tracemalloc

    from auditloom.llm.decontaminate import Benchmark, Shard

    for items, text in (([(1, "a " * 1000)], "a " * 100_000), ([(k, "b") for k in range(5000)], "b " * 100_000), ([(1, "a b " * 500), (2, "b a " * 20)], "a b " * 50_000)):
        bench = Benchmark(items, 13)
        began = time.time()
        tracemalloc.start()
        shard = Shard([text], bench)
        mask, found, longest = shard.hits()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100e6 and time.time() - began < 30, (peak, time.time() - began)
        assert mask[: shard.n_words[0]].all() and len(found[0]) == len(items) and longest[0].tolist() == [min(len(items[0][1].split()), 1000), 0, 0]


def test_suffix_order():
    import numpy as np

    from auditloom.llm.decontaminate import suffix_array

    r = random.Random(4)
    for _ in range(60):
        n = r.randint(0, 80)
        flat = np.array([r.choice((0, 1, 1, 1, 2, 3)) for _ in range(n)] + [0, 0], np.int64)
        for least in (1, 3):
            rest = [tuple(flat[i : i + list(flat[i:]).index(0)].tolist()) for i in range(n)]
            want = sorted(x for x in rest if len(x) >= least)
            got = suffix_array(flat, 3, least).tolist()
            assert [rest[i] for i in got] == want and len(set(got)) == len(got)
