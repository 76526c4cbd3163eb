import hashlib
import random
import re
from zlib import crc32

import pytest

from auditloom.llm.turn_repair import ENDED, Layers, damage_and_repair, damaged, inserted, repair, solve

from .helpers import words


def cheapest(turns):
    """All edit sequences of least cost, by trying every one: (cost, audit, roles)."""
    best = [2 * len(turns) + 1, None, None]

    def go(i, cost, audit, roles):
        if cost > best[0]:
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", "".join(r[0][:1] if r[0] else "?" for r in roles)):
            if (cost, audit) < (best[0], best[1] or "~"):
                best[:] = cost, audit, roles
        if not re.fullmatch("s?(ua)*u?", "".join(r[0][:1] if r[0] else "?" for r in roles)):
            return
        if not audit.endswith("II"):
            for made in ("user", "assistant"):
                go(i, cost + 5, audit + "I", roles + ((made, ""),))
        if i == len(turns):
            return
        role, text, fault = turns[i]
        go(i + 1, cost + 2, audit + "D", roles)
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            go(i + 1, cost + more, audit + "K", roles + ((role, text),))
            for made in ("user", "assistant"):
                go(i + 1, cost + more + 1, audit + "R", roles + ((made, text),))

    go(0, 0, "", ())
    return best


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def brute(rows):
    """The contract's row of each conversation, from its rows before damage."""
    out = []
    for conv in {c for c, *_ in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            k = crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            kept += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [t for t, *_ in kept if t is not None]
        found = faults_of([x[1:] for x in kept])
        cost, audit, made = cheapest(found)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f[2] == k for f in found) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return out


def test_layers_against_every_edit_sequence():
    r = random.Random(1)
    for _ in range(1500):
        rows = [(r.choice(("user", "assistant", "user", "assistant", "system", "tool", "")), r.choice(("a.", "b!", "c?", "cut", " \n", "é 😀."))) for _ in range(r.randint(0, 5))]
        found = faults_of(rows)
        edits = solve([(role[:1], ("", "blank", "duplicate", "truncated").index(f)) for role, _, f in found])
        assert "".join(e for e, _ in edits) == cheapest(found)[1], found


def test_layers_are_wide_enough():
    """No state's cost lies further above the least than the layers reach."""
    from auditloom.llm.turn_repair import before

    r = random.Random(2)
    for _ in range(300):
        here = Layers(inserted(Layers.of(list(ENDED)).bits))
        costs = [0, 10, 5, 0]
        assert [here.cost(s) for s in range(4)] == costs
        for _ in range(60):
            initial, fault = r.choice("suax"), r.choice((0, 0, 1, 3))
            here = before(here, initial, fault)
            own = [c + 2 for c in costs]
            if fault != 1:
                for p, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
                    own[p] = min(own[p], costs[to] + (5 if fault == 3 else 0) + (initial != ("" if to == 0 else " sua"[to])))
                if initial == "s":
                    own[0] = min(own[0], costs[1] + (5 if fault == 3 else 0))
            for _ in range(2):
                own = [min(own[p], own[3 if p == 2 else 2] + 5) for p in range(4)]
            costs = own
            assert [here.cost(s) for s in range(4)] == costs


def odd_conversations(seed=0, n=160):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        last = ""
        for t in range(r.randint(1, 5)):
            role = r.choice(("user", "assistant")) if r.random() < 0.2 else ("user", "assistant")[t % 2] if r.random() < 0.9 else r.choice(("system", None, "", "tool", "Σύστημα"))
            text = last if r.random() < 0.1 else r.choice((None, "", " \t\r\n", "no end", words(r, 4) + ".", "é 😀!", "x ", words(r, 9) + "?\n"))
            last = text
            rows.append((c if c else None, None if r.random() < 0.08 else t + (t > 2 and r.random() < 0.3) * 3, role, text))
    return rows + [rows[5], rows[5], (900, 1, "user", words(r, 3000) + "."), (901, 3, "system", "Be kind.")]


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "u", 2) for x in rows], "conv_id long, turn long, role string, text string, place int, fault string, _conv int")


def key(x):
    return (x[0] is not None, x[0] or 0)


@pytest.mark.parametrize("long_rows", [20_000, 2])
def test_damage_and_repair(spark, long_rows):
    rows = odd_conversations(3)
    got = sorted(map(tuple, damage_and_repair(frame(spark, rows), long_rows=long_rows).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert {"D", "K", "R"} == set("".join(x[7] for x in got)) and any(x[7] == "" for x in got)


def test_one_long_conversation_in_parts(spark):
    r = random.Random(5)
    rows = [(7, k, r.choice(("user", "assistant", "user", "assistant", "system")), r.choice(("yes.", "no.", f"say {k}.", f"cut {k}", ""))) for k in range(3000)] + [(8, 0, "user", "same.")] * 700 + [(9, None, "user", f"{k}.") for k in range(300)]
    docs = frame(spark, rows)
    whole, parts = (sorted(map(tuple, damage_and_repair(docs, long_rows=n).collect())) for n in (20_000, 100))
    assert whole == parts and len(whole) == 3 and len(whole[0][7]) > 2500
    a, b = (sorted(map(tuple, repair(docs, long_rows=n).collect()), key=lambda x: x[:2]) for n in (20_000, 100))
    assert a == b and [x[1] for x in a if x[0] == 7] == list(range(sum(x[0] == 7 for x in a)))


def test_empty(spark):
    none = frame(spark, [(1, 1, "user", "a.")]).limit(0)
    assert damage_and_repair(none).count() == repair(none).count() == damaged(none).count() == 0
