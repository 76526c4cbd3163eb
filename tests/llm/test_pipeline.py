"""The whole pipeline against brute force, on a small corpus with everything in it that a stage looks for."""

import random
from collections import defaultdict
from zlib import crc32

import pytest

import corpus_pipeline
from auditloom.llm import queries
from auditloom.llm.simhash import WIDE, wide_fingerprints

from .test_decontaminate import brute
from .test_langid import SYLLABLES, text
from .test_line_dedup import brute_with_pairs, signed_hash
from .test_simhash import groups

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id string, __k_n int, lang_pred string, fp long, h0 int, prefix string"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
            out = spark.createDataFrame(out.toPandas(), docs.schema)
            assert 0 < out.count() <= n
            n, docs = out.count(), out
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def corpus():
    """(rows, benchmark items, ids that language identification rejects)."""
    r = random.Random(2)
    langs = list(SYLLABLES)
    rows = [(k, text(r, langs[k % 3], r.randint(60, 200)), langs[k % 3]) for k in range(150)]
    passage = "\n".join(text(r, "aa", 16) for _ in range(4))
    for k in range(150, 156):
        rows.append((k, f"{text(r, 'aa', 80)}\n{passage}\n{text(r, 'aa', 80)}", "aa"))
    for k in range(156, 166, 2):  # in one line each, so that line dedup leaves them
        w = text(r, "bb", 160).split()
        rows.append((k, " ".join(w), "bb"))
        w[r.randrange(len(w))] = "zuschi"
        rows.append((k + 1, " ".join(w), "bb"))
    rows += [(166, rows[3][1], None), (167, rows[3][1], None)]
    bench = [(k, text(r, "bb", 24).replace("\n", " ")) for k in range(4)] + [(4, None), (4, " ")]
    rows += [(170 + k, f"{text(r, 'bb', 60)}\n{bench[k][1]}\n{text(r, 'bb', 40)}", "bb") for k in range(4)]
    bad = [(180, None, "aa"), (181, "", "aa"), (182, "12 34 !?", "bb"), (183, " ".join("".join(r.choices("dfghjmnpqvwxy", k=6)) for _ in range(50)), None)]
    rows += bad + [(190, text(r, "cc", 9000), "cc"), (None, text(r, "cc", 90), "cc"), rows[7], rows[7]]
    return rows, bench, {d for d, *_ in bad}


def expected(rows, bench, rejected, hashes):
    """doc_id and text of what is packed."""
    kept = [(d, t) for d, t, _ in rows if d not in rejected]
    gone = brute_with_pairs(kept, hashes, 50)
    kept = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t])) for d, t in kept]
    label = groups([int.from_bytes(x, "big") for x in wide_fingerprints([t for _, t in kept], 5, WIDE.lanes)], WIDE.total)
    first = {}
    for (d, t), g in zip(kept, label):
        key = (d is not None, d or 0)
        if g not in first or key < first[g][0]:
            first[g] = (key, d, t)
    kept = [(d, t) for _, d, t in first.values()]
    bad = {d for d, n, hit, _ in brute(kept, bench) if hit and 20 * hit >= n}
    return [(d, t) for d, t in kept if d not in bad], bad, sum(map(bool, gone.values())), len(label) - len(first)


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, bench, rejected = corpus()
    laid = [(k, t, x, "s", None if t is None else len(t), "i", 1, "p", 2, 3, "q") for k, t, x in rows]
    spark.createDataFrame(laid, COLUMNS).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    hashes = signed_hash(spark, [t for _, t, _ in rows])
    return corpus_pipeline.run(spark, d).collect(), expected(rows, bench, rejected, hashes)


def test_run_matches_brute_force(packed):
    from tokenizers import Tokenizer

    pieces, (want, contaminated, shortened, near) = packed
    assert len(contaminated) == 4 and shortened >= 5 and near >= 8
    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    assert got.keys() == {d for d, _ in want}
    for d, t in want:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        at = 0
        for start, n, crc, whole in sorted(got[d]):
            assert start == at and whole == len(ids) and crc == crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + n]))
            at += n
        assert at == len(ids)
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for held in by.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *held], held)) and sum(held[-1]) <= 4096


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
