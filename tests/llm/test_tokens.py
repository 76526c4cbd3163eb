import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auditloom.llm.binary_output import Segment, token_files, write_segment
from auditloom.llm.packing import first_fit_decreasing, pack, pack_group, powers
from auditloom.llm.tokens import Encoder

from .helpers import key, odd_docs, odd_rows


def slow_ids(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_equals_library(name):
    e = Encoder(public_tokenizers.path(name), memo=50)
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    for text in [x for _, x in odd_rows(4)] + ["It's  we'll   x\n\n y", "a1b22 3.14 ÀÉß çà!?", "'s 'S don't", "<|endoftext|> a", "tab\tx\r\ny", "é ﬁ", " lead", "trail  ", "×÷²½"]:
        assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_segment_round_trip():
    r = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 500):
        sizes = r.integers(0, 90, n).tolist()
        ids = r.integers(0, 60000, sum(sizes)).astype("<u4")
        keys = [None if i % 7 == 3 else i * 5 for i in range(n)]
        for width in (2, 4):
            s = Segment(write_segment(keys, sizes, ids.tobytes(), width))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            assert s.bounds().tolist() == ends.tolist() and [s.select(i) for i in range(n + 1)] == ends.tolist()
            assert s.ids.tolist() == ids.tolist() and [None if z else int(d) for d, z in zip(s.doc_ids, s.nulls)] == keys


def test_token_files(spark):
    rows = odd_rows(5)
    got = token_files(odd_docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), segment_ids=300).collect()
    want = []
    for d, t in rows:
        ids = slow_ids("byte_bpe_50k.json", t) + [0]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((x.doc_id, x.n_tokens, x.ids_crc32) for x in got), key=key) == sorted(want, key=key)
    order = sorted(got, key=lambda x: x.start)
    assert [x.start for x in order] == np.concatenate([[0], np.cumsum([x.n_tokens for x in order])[:-1]]).tolist()
    assert [x.doc_id for x in order] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert token_files(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_first_fit_is_first_fit():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 100, 300).tolist()
    rooms, want = [], {}
    for k in sorted(range(300), key=lambda k: -sizes[k]):
        b = next((i for i, room in enumerate(rooms) if room >= sizes[k]), len(rooms))
        if b == len(rooms):
            rooms.append(100)
        rooms[b] -= sizes[k]
        want[k] = b
    assert first_fit_decreasing(sizes, 100) == [want[k] for k in range(300)]


def check_pieces(rows, room):
    """rows: (doc, start, length, doc_tokens, sequence, offset). The padding share."""
    by_doc, by_seq = {}, {}
    for d, s, n, total, q, o in rows:
        by_doc.setdefault((d, total), []).append((s, n))
        by_seq.setdefault(q, []).append((o, n))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= room
    pads = sum(0 if (n := sum(x for _, x in p)) & (n - 1) == 0 else room - n for p in by_seq.values())
    return pads / sum(r[2] for r in rows), by_doc


def test_group_covers_each_id_once_with_little_padding():
    r = np.random.default_rng(2)
    lengths = [1, 4096, 4097, 20000] + r.integers(1, 3000, 200).tolist()
    docs = [(n, [0] * (n // 4096), 0, [0] * len(powers(n % 4096))) for n in lengths]
    got = pack_group(docs, 4096, 64)
    pad, by_doc = check_pieces([(d, s, n, lengths[d], q, o) for d, s, n, _, q, o in got], 4096)
    assert pad < 0.02
    for (d, total), parts in by_doc.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == total == lengths[d]


def test_pack(spark):
    rows = odd_rows(6)
    got = pack(odd_docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), room=256, group_docs=20).collect()
    pad, by_doc = check_pieces([(x.doc_id, x.start, x.length, x.doc_tokens, x.sequence_id, x.offset) for x in got], 256)
    for d, t in set(rows):
        ids = np.array(slow_ids("word_bpe_49k.json", t) + [2], "<u4")
        mine = [x for x in got if x.doc_id == d and x.doc_tokens == len(ids)]
        times = sum(y == (d, t) for y in rows)
        assert sum(x.length for x in mine) == len(ids) * times
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in mine)
    assert pack(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).count() == 0
