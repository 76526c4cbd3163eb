import hashlib
import itertools
import random
import re

import numpy as np

from auditloom.llm.pii import BITS, KINDS, LABELS, Field, base_spans, features, find, personal_data, redact, skips, tokens, train

from .helpers import key, odd_docs, odd_rows


def brute(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_patterns():
    r = random.Random(0)
    for _ in range(20000):
        t = "".join(r.choice("ab1234567890..@@+-% ()é1") for _ in range(r.randint(0, 40)))
        assert base_spans(t) == brute(t)
    assert base_spans("9" * 50000) == brute("9" * 50000)
    for t in ("0" * 5000 + ".1.1.1", "1." + "0" * 4301 + ".1.1", "1.2." + "0" * 9000 + "255.4", "1.2.3." + "0" * 9000 + "256"):
        assert base_spans(t) == brute(t) and find(t, None)[0] == brute(t)
    assert [k for _, k, _ in base_spans("0" * 5000 + ".1.1.1")] == [1]


def test_repeated_number_is_found_without_its_code():
    r = random.Random(1)
    texts = [f"call +1 (555) {r.randint(100, 999)}-{r.randint(1000, 9999)} or mail a{k}@b.example.com from 10.0.{k % 250}.1 and pay {r.randint(1, 99)} euros" for k in range(150)]
    texts += [f"reach +1{r.randint(10**9, 10**10 - 1)} today" for _ in range(150)]
    field = train(texts)
    base, added = find("Reach +15551234567 today. Some words stand here. Once more: reach 15551234567 now, and 40 others.", field)
    assert [KINDS[k] for _, k, _ in base] == ["phone"] and [(a, KINDS[k]) for a, k, _ in added] == [(66, "phone")]
    assert find("only words, no digits", field) == ([], []) and find("pay 40 euros in 2024", field) == ([], [])


def test_query_shape(spark):
    rows = odd_rows(1, 15) + [(500 + k, f"é write to me{k}@x.example.org, card 4111 1111 1111 1111 or +49 30 1234567{k} from 1.2.3.4 not 1.2.3.400") for k in range(5)]
    got = personal_data(odd_docs(spark, rows)).collect()
    want = []
    for d, t in rows:
        s = brute(t)
        want.append((d, *(sum(x[1] == k for x in s) for k in range(4)), hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in s).encode()).hexdigest()))
    assert sorted((tuple(x)[:6] for x in got), key=key) == sorted(want, key=key)
    x = next(x for x in got if x.doc_id == 500)
    assert "[EMAIL]" in redact(dict(rows)[500], x.spans) and x.n_card == x.n_ip == x.n_phone == 1
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def enumerated(field, found, seen):
    """Marginals by all labelings."""
    n = len(found)
    unary = [field.weights[features(core, before)].sum(0) for _, _, core, before, _ in found]
    edges = [(i, i + 1, 0 if found[i + 1][4] == found[i][4] + 1 else 1) for i in range(n - 1)] + [(i, j, 2) for i, j in skips(found)]
    out = np.zeros((n, LABELS))
    for y in itertools.product(range(LABELS), repeat=n):
        if any(s and s != k for s, k in zip(seen, y)):
            continue
        score = sum(u[k] for u, k, s in zip(unary, y, seen) if not s) + sum(field.edge[kind][y[i], y[j]] for i, j, kind in edges)
        out[np.arange(n), y] += np.exp(score)
    return out / out.sum(1, keepdims=True), len(edges)


def test_marginals_by_messages_and_by_enumeration():
    r = np.random.default_rng(3)
    field = Field(r.normal(size=(1 << BITS, LABELS)), *(r.normal(size=(3, LABELS, LABELS))))
    chain = tokens("a1 b22 and c333, d4 then e55")
    want, edges = enumerated(field, chain, np.array([0, 0, 0, 0, 0]))
    assert edges == 4 and np.allclose(field.marginals(chain, np.zeros(5, int), rounds=100), want, atol=1e-6)
    seen = np.array([0, 3, 0, 0, 1])
    assert np.allclose(field.marginals(chain, seen, rounds=100), enumerated(field, chain, seen)[0], atol=1e-6)
    # with a skip edge the messages go in a loop, and are near
    loop = tokens("call 5551234 or x1 else 5551234 now")
    weak = Field(field.weights / 4, *(e / 4 for e in field.edge))
    want, edges = enumerated(weak, loop, np.zeros(3, int))
    assert edges == 3 and np.allclose(weak.marginals(loop, np.zeros(3, int), rounds=100), want, atol=0.05)
