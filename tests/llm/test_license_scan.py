import random

from auditloom.llm.license_scan import TEMPLATES, WORD, Template, align, increasing, scan, scan_licenses

from .helpers import odd_docs, odd_rows, words


def test_longest_increasing():
    r = random.Random(0)
    for _ in range(200):
        v = [r.randint(0, 9) for _ in range(r.randint(0, 9))]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
        got = increasing(v)
        assert len(got) == max(best, default=0) and all(v[a] < v[b] for a, b in zip(got, got[1:]))


def test_alignment_is_a_common_subsequence_with_all_anchors():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([str(r.randint(0, 30)) for _ in range(r.randint(0, 40))] for _ in range(2))
        got = align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:]))
    assert len(align(a := "w x y z".split(), a)) == 4


HELD = [Template(*t, 0.8) for t in TEMPLATES]
SHORT = {t[0]: t[1] for t in reversed(TEMPLATES) if len(t[1].split()) < 10}


def test_every_notice_is_found_whole_altered_and_twice():
    r = random.Random(2)
    for name, notice in TEMPLATES:
        text = f"{words(r, 40)}\n{notice}\n{words(r, 300)}. {notice.upper()} {words(r, 5)}"
        got = [x for x in scan(text, HELD) if x[0] == name]
        assert len(got) == 2 and all(x[3] == 1.0 for x in got), name
        assert text[got[0][1] : got[0][2]] in notice
    assert scan(words(r, 3000), HELD) == [] and scan(None, HELD) == []


def test_any_word_may_differ():
    """Each word of each notice but those that leave too little of it."""
    for (name, notice), t in zip(TEMPLATES, HELD):
        for k in range(len(t.words)) if len(t.words) - t.enough else ():
            text = " ".join(["lead", *t.words[:k], "otherwise", *t.words[k + 1 :], "trail"])
            assert scan(text, [t]), (name, t.words[k])
        w = t.words
        spare = len(w) - t.enough
        keyless = [x for x in w if x not in t.keys]
        assert len(keyless) < t.enough and (spare > 0 or t.keys)


def brute(text):
    """Licenses of which some stretch of the text holds enough, whatever its words."""
    w, out = [m.group().lower() for m in WORD.finditer(text or "")], {}
    for t in HELD:
        for k in range(len(w)):
            n = len(align(t.words, w[k : k + len(t.words) + len(t.words) // 4]))
            if n >= t.enough:
                out[t.license] = max(out.get(t.license, 0), n)
    return out


def test_table_matches_every_stretch(spark):
    r = random.Random(4)
    other = lambda: " ".join(r.choices("river stone cloud amber silver quick brown lazy dog".split(), k=r.randint(0, 30)))
    rows = odd_rows(2, 6)
    for k in range(40):
        notice = r.choice([t for t in TEMPLATES if len(t[1]) < 500])[1].split()
        for _ in range(r.randint(0, max(1, len(notice) // 4))):
            notice[r.randrange(len(notice))] = r.choice(["river", ""])
        rows.append((100 + k, f"{other()} {' '.join(notice)} {other()}"))
    rows = [x for x in rows if len(x[1] or "") < 3000]
    found = {}
    for x in scan_licenses(odd_docs(spark, rows)).collect():
        found.setdefault(x.doc_id, set()).add(x.license)
    hits = 0
    for d, t in rows:
        want, got = brute(t), found.get(d, set())
        hits += bool(want)
        assert got <= want.keys() and bool(got) == bool(want), (d, t, want, got)
        assert not want or {x for x, n in want.items() if n == max(want.values())} & got
    assert hits > 20


def test_table(spark):
    rows = odd_rows(2, 10) + [(77, f"a b c\n{SHORT['MIT']}"), (78, f"{SHORT['Apache-2.0']} All rights reserved."), (79, "// SPDX-License-Identifier: MIT"), (80, "It is licensed under apache 2.0, as ever")]
    got = scan_licenses(odd_docs(spark, rows)).collect()
    assert sorted((x.doc_id, x.license, x.start) for x in got) == [(77, "MIT", 6), (78, "Apache-2.0", 0), (78, "reserved", 48), (79, "MIT", 3), (80, "Apache-2.0", 6)]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
