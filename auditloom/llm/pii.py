"""Personal data: fixed patterns, and a skip-chain conditional random field that makes them consistent.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers; what they find
always stays. The field then labels all tokens of a document that hold a digit or an ``@`` (any other
token is taken as no personal data): a chain ties each to the next, and skip edges tie distant tokens
that repeat one another or share their last digits, from one occurrence to the next, so edges grow with
the tokens. Tokens inside a pattern's match are observed; loopy sum-product passes their labels on, and a
token outside all matches becomes a span if its label is at least ``sure``. So a phone number written
once with its country code is also found where it stands without.

Training: token weights by logistic regression on the patterns' own labels, edge potentials by the
association of the labels at their ends (with a prior that tokens which repeat each other are alike), over a sample of at most ``sample_docs`` documents of at most
``sample_chars`` characters each, drawn by a hash of doc_id.

Cases: a null or empty text has no spans; repeated rows get equal results; a table without any digit
gets patterns only; other columns are not read. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ship

KINDS = ("email", "ip", "card", "phone")
# The base patterns. The IP's first part may begin only where a run of digits does: a
# match begun within a run would end where the run's own match ends, or fail as it does.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
EDGE = ".,;:!?\"'<>[]{}"
BITS = 14
LABELS = len(KINDS) + 1  # 0: none


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches: an address begins where the run of local characters before its @ does."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every pattern match, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, z) for a, z in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or "0") <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int, str, str, int]]:
    """(start, end, token, word before, number among all tokens) of each token with a digit or an @."""
    out, before = [], ""
    for n, m in enumerate(TOKEN.finditer(text)):
        word = m.group()
        if HINT.search(word):
            core = word.lstrip(EDGE)
            start = m.start() + len(word) - len(core)
            core = core.rstrip(EDGE)
            out.append((start, start + len(core), core, before, n))
        before = word
    return out


def features(core: str, before: str) -> list[int]:
    digits = sum(c.isdigit() for c in core)
    shape = re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]+", "a", core[:64]))
    names = (f"s{shape}", f"d{min(digits, 24)}", f"l{min(len(core), 40)}", f"h{digits * 4 // max(1, len(core))}", f"a{'@' in core}", f"p{core[:1]}", f"b{before.lower().strip(EDGE)[:20]}", "bias")
    return [crc32(x.encode()) & ((1 << BITS) - 1) for x in names]


def skips(found: list) -> list[tuple[int, int]]:
    """Edges between tokens that repeat or resemble each other: each to the last one before it."""
    last: dict[str, int] = {}
    out = set()
    for i, (_, _, core, _, _) in enumerate(found):
        digits = "".join(c for c in core if "0" <= c <= "9")
        keys = ["t" + core.lower()]
        if len(digits) >= 7:
            keys += ["d" + digits, "e" + digits[-7:]]
        if "@" in core:
            keys.append("m" + core.lower().partition("@")[0])
        for k in keys:
            if k in last:
                out.add((last[k], i))
            last[k] = i
    return sorted(out)


def observed(found: list, spans: list) -> np.ndarray:
    """The label of each token that overlaps a pattern's match, else 0. Matches of a kind are in order."""
    labels = np.zeros(len(found), np.int64)
    k, live = 0, []
    for i, (start, end, *_) in enumerate(found):
        while k < len(spans) and spans[k][0] < end:
            live.append(spans[k])
            k += 1
        live = [s for s in live if s[2] > start]
        if live:
            labels[i] = min(s[1] for s in live) + 1
    return labels


class Field:
    """Token weights, and log-potentials of near and far chain edges and of skip edges."""

    def __init__(self, weights: np.ndarray, near: np.ndarray, far: np.ndarray, skip: np.ndarray):
        self.weights, self.edge = weights, (near, far, skip)

    def marginals(self, found: list, seen: np.ndarray, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Loopy sum-product over one document's tokens."""
        n = len(found)
        unary = np.stack([self.weights[features(core, before)].sum(0) for _, _, core, before, _ in found])
        unary[seen > 0] = -30
        unary[seen > 0, seen[seen > 0]] = 0
        pairs = [(i, i + 1, 0 if found[i + 1][4] == found[i][4] + 1 else 1) for i in range(n - 1)] + [(i, j, 2) for i, j in skips(found)]
        unary = np.exp(unary - unary.max(1, keepdims=True))
        if not pairs:
            return unary / unary.sum(1, keepdims=True)
        a, b, kind = np.array(pairs).T
        src, dst, m = np.concatenate([a, b]), np.concatenate([b, a]), len(a)
        table = np.exp(np.stack(self.edge))[kind]
        table = np.concatenate([table, table.transpose(0, 2, 1)])  # of each direction: from src's label to dst's
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        msg = np.full((2 * m, LABELS), 1 / LABELS)
        for _ in range(rounds):
            log = np.log(msg)
            total = np.zeros((n, LABELS))
            for y in range(LABELS):
                total[:, y] = np.bincount(dst, log[:, y], n)
            out = total[src] - log[back]
            out = unary[src] * np.exp(out - out.max(1, keepdims=True))
            new = np.einsum("ej,ejk->ek", out, table) + 1e-300
            msg = damping * msg + (1 - damping) * new / new.sum(1, keepdims=True)
        log = np.log(msg)
        belief = np.stack([np.bincount(dst, log[:, y], n) for y in range(LABELS)], 1)
        belief = unary * np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)


def association(a: np.ndarray, b: np.ndarray, alike: float = 0) -> np.ndarray:
    """Bounded log-association of labels at the ends of edges, both ways alike; alike: prior count of equal labels."""
    joint = np.full((LABELS, LABELS), 0.1) + alike * np.eye(LABELS)
    np.add.at(joint, (a, b), 1)
    np.add.at(joint, (b, a), 1)
    joint /= joint.sum()
    side = joint.sum(1)
    return np.clip(np.log(joint / np.outer(side, side)), -4, 4)


def train(texts: list[str], steps: int = 60) -> Field | None:
    feats, gold, pairs = [], [], ([], [], [])
    for t in texts:
        found = tokens(t)
        y = observed(found, base_spans(t))
        feats += [features(core, before) for _, _, core, before, _ in found]
        gold += y.tolist()
        for i in range(len(found) - 1):
            pairs[0 if found[i + 1][4] == found[i][4] + 1 else 1].append((y[i], y[i + 1]))
        pairs[2].extend((y[i], y[j]) for i, j in skips(found))
    if not feats:
        return None
    x, y = np.array(feats), np.array(gold)
    w, m, v = np.zeros((1 << BITS, LABELS)), 0, 0
    for step in range(1, steps + 1):
        s = w[x].sum(1)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        spread = np.repeat(p, x.shape[1], axis=0)
        g = np.stack([np.bincount(x.ravel(), spread[:, k], 1 << BITS) for k in range(LABELS)], 1) / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    near, far, skip = (np.array(e, np.int64).reshape(-1, 2).T for e in pairs)
    return Field(w, association(*near), association(*far), association(*skip, alike=10))


def find(text: str | None, field: Field | None, sure: float = 0.9) -> tuple[list, list]:
    """(base spans, added spans) of a whole text."""
    if not text or not HINT.search(text):
        return [], []
    base = base_spans(text)
    if field is None:
        return base, []
    found = tokens(text)
    seen = observed(found, base)
    if not (seen == 0).any():
        return base, []
    p = field.marginals(found, seen)
    best = p.argmax(1)
    return base, [(found[i][0], int(best[i]) - 1, found[i][1]) for i in np.flatnonzero((best > 0) & (seen == 0) & (p.max(1) >= sure)) if found[i][0] < found[i][1]]


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def personal_data(docs: DataFrame, sure: float = 0.9, sample_docs: int = 1500, sample_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts are of base spans, spans are all."""
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    part = min(1.0, 8 * sample_docs / max(1, docs.count()))
    drawn = plain.where((F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(part * (1 << 30))) & F.col("_text").rlike("[0-9@]") & (F.length("_text") <= sample_chars))
    texts = [r["_text"] for r in drawn.orderBy(F.xxhash64("_id"), F.xxhash64("_text")).limit(sample_docs).collect()]
    field = spark.sparkContext.broadcast(train(texts))

    def rows(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column(1):
                base, added = find(t.as_py(), field.value, sure)
                for k in range(4):
                    cols[k].append(sum(s[1] == k for s in base))
                cols[4].append(hashlib.sha256(listed(base).encode()).hexdigest())
                cols[5].append(listed(base + added))
                cols[6].append(len(added))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return plain.mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: str) -> str:
    """text with each listed span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for s in filter(None, spans.split(",")):
        kind, a, z = s.split(":")
        a, z = int(a), int(z)
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])
