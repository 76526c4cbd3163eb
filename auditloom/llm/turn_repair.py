"""Repairs the turns of conversations: the cheapest edits after which the roles follow the grammar ``(s?(ua)+)?``.

Edits of a turn: Keep costs 0, Rerole to user or assistant 1, Delete 2; Insert, anywhere, of an empty user or assistant turn 5.
A blank turn and one that repeats an earlier turn's role and text must be deleted; a truncated one that stays adds 5.

Method: layers of bitsets, as in approximate matching with costs. For every turn, layer c is the set of the grammar's four
states from which the rest of the conversation can be repaired at cost c or less. Turns are read from the last to the first;
the layers of a turn are those of the next one, shifted by each edit's cost. The first layer that holds the start state before the first
turn gives the cost, and a trace through the bits forwards takes the least letter (D, I, K, R) that keeps to it, so of the
cheapest audits it is the ASCII-least. From any state any other that can still end well is a few edits away, so of a turn's layers only the
``LAYERS`` lowest can matter: they are one integer, and a turn costs a few shifts.

Conversations of at most ``long_rows`` turns and ``long_chars`` characters are dealt out whole. A longer one is split over tasks: its
turns are range-sorted, each part is summed up by the costs between its ends' states (min-plus matrices compose), and once those are
combined each part is traced on its own; only a few numbers a part pass through one task.

Cases: a null role or text is one space, so such a turn is blank or its role must be changed; null turns come first; turns of equal number are in order of
role, then text; a null conv_id is a conversation of its own; an empty role is like any unknown one; rows that repeat are
duplicates; other columns are not read; an empty table has no conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ship, stash

START, S, U, A = range(4)
LAYERS = 16
#: A bit of each layer.
EACH = sum(1 << 4 * i for i in range(LAYERS + 8))
FULL = (1 << 4 * LAYERS) - 1
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SOLID = re.compile(r"[^\x20\x09-\x0D]")
FAULTS = ("", "blank", "duplicate", "truncated")
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Where a role's initial leads from each state.
NEXT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
MADE = {U: "user", A: "assistant"}
UNREACHED = 1 << 60


def before_user(w: int) -> int:
    """The states from which a user turn leads into the sets w, layer by layer."""
    x = w >> U & EACH
    return x << START | x << S | x << A


def before_assistant(w: int) -> int:
    return (w >> A & EACH) << U


class Layers:
    """The bitsets before one turn: bit 4 * c + state says that the rest costs base + c or less from that state."""

    __slots__ = ("base", "bits")

    def __init__(self, bits: int, base: int = 0):
        while bits and not bits & 15:
            bits >>= 4
            base += 1
        self.bits, self.base = bits & FULL, base

    def within(self, state: int, cost: int) -> bool:
        c = min(cost - self.base, LAYERS - 1)
        return c >= 0 and bool(self.bits >> 4 * c + state & 1)

    def cost(self, state: int) -> int:
        return next((self.base + c for c in range(LAYERS) if self.bits >> 4 * c + state & 1), UNREACHED)

    @staticmethod
    def of(costs: list[int]) -> Layers:
        """Layers with these costs of the states, as far as the layers reach."""
        base = min(costs)
        return Layers(sum((1 << s) << 4 * c for s, x in enumerate(costs) for c in range(LAYERS) if base + c >= x), base)


#: After the last turn, before anything is inserted there.
ENDED = (0, UNREACHED, UNREACHED, 0)


def inserted(w: int) -> int:
    """w with up to two inserted turns before it; more would lead back."""
    for _ in range(2):
        w |= (before_user(w) | before_assistant(w)) << 4 * INSERT
    return w


def before(after: Layers, initial: str, fault: int) -> Layers:
    """The layers before a turn, from those after it."""
    w = after.bits
    w |= (w >> 4 * (LAYERS - 1)) * (EACH << 4 * LAYERS & (FULL << 64))  # the highest layer goes on
    out = w << 4 * DELETE
    if fault not in (BLANK, DUPLICATE):
        u, a = before_user(w), before_assistant(w)
        kept = u if initial == "u" else a if initial == "a" else (w >> S & EACH) << START if initial == "s" else 0
        out |= (kept | (u | a) << 4 * REROLE) << 4 * (TRUNCATED if fault == CUT else 0)
    return Layers(inserted(out), after.base)


def traced(turns: list[tuple[str, int]], heres: list[Layers], thens: list[Layers], copies: list[int], state: int) -> tuple[list[tuple[str, int]], int]:
    """The (letter, state) of each edit from a state before the first turn, and the state after the last.

    heres, thens: the layers before and after each turn; copies: how many more of it follow, which are deleted without a letter
    here. What is inserted behind the last turn belongs to what follows.
    """
    left, out = heres[0].cost(state), []
    for (initial, fault), here, then, more_copies in zip(turns, heres, thens, copies):
        more, keep = TRUNCATED if fault == CUT else 0, NEXT.get(initial, {}).get(state)
        while True:
            if then.within(state, left - DELETE):
                left -= DELETE
                out.append(("D", state))
                break
            to = A if state == U else U
            if here.within(to, left - INSERT):
                left, state = left - INSERT, to
                out.append(("I", state))
                keep = NEXT.get(initial, {}).get(state)
                continue
            if keep is not None and fault not in (BLANK, DUPLICATE) and then.within(keep, left - more):
                left, state = left - more, keep
                out.append(("K", state))
            else:
                left, state = left - more - REROLE, to
                out.append(("R", state))
            break
        left -= DELETE * more_copies
    return out, state


def tail(state: int) -> list[tuple[str, int]]:
    """What is inserted behind the last turn to end well from a state."""
    return {START: [], A: [], U: [("I", A)], S: [("I", U), ("I", A)]}[state]


def solve(turns: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The edits of a whole conversation."""
    layers = [Layers(inserted(Layers.of(list(ENDED)).bits))]
    for initial, fault in reversed(turns):
        layers.append(before(layers[-1], initial, fault))
    layers.reverse()
    edits, state = traced(turns, layers[:-1], layers[1:], [0] * len(turns), START) if turns else ([], START)
    return edits + tail(state)


def fault(role: str, text: str, seen: set) -> int:
    """The first fault of a turn; seen: digests of the turns before it."""
    if not SOLID.search(text):
        return BLANK
    h = hashlib.blake2b(f"{role}\0{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest() if len(text) > 64 else (role, text)
    if h in seen:
        return DUPLICATE
    seen.add(h)
    return CUT if text.rstrip(" \t\n\v\f\r")[-1] not in ".!?" else 0


class Report:
    """Counts, audit and digest of one conversation, from its edited turns in order; keeps no texts."""

    def __init__(self):
        self.faults, self.illegal, self.cost, self.audit, self.sha = [0] * 4, 0, 0, [], hashlib.sha256()
        self.last = self.low = self.high = None
        self.turns, self.kept = 0, False

    def add(self, turn, role: str | None, text: str, found: int, edit: str, made: str) -> None:
        """role: as it was, None for an inserted turn; made: as it becomes."""
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if found == CUT and edit != "D" else 0)
        if role is not None:
            self.faults[found] += 1
            if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.last = role[:1]
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if edit != "D":
            self.sha.update(f"{chr(10) if self.kept else ''}{made}:{text}".encode("utf-8", "surrogatepass"))
            self.kept = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITED = "conv_id long, place long, turn long, role string, text string, fault string, edit string, new_role string"


def edited(rows: list[tuple], edits: list[tuple[str, int]], faults: list[int]):
    """(turn, role, text, fault, edit, new role) of every turn, with those inserted."""
    it = iter(zip(rows, faults))
    for letter, state in edits:
        if letter == "I":
            yield None, None, "", 0, "I", MADE[state]
            continue
        (turn, role, text), found = next(it)
        yield turn, role, text, found, letter, None if letter == "D" else role if letter == "K" else MADE[state]


def conversations_of(batches):
    """(conv_id, [(turn, role, text)]) of rows that come sorted by conversation."""
    held, conv = [], None
    for b in batches:
        for c, *row in zip(*(x.to_pylist() for x in b.columns)):
            if held and c != conv:
                yield conv, held
                held = []
            conv = c
            held.append(tuple(row))
    if held:
        yield conv, held


def packed(rows, schema: pa.Schema, most: int = 4096, chars: int = 4 << 20):
    """Record batches of rows, bounded in rows and in characters of text."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == most or n > chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in schema.split(", "))])


def plain_rows(conversations: DataFrame) -> DataFrame:
    """(_conv, _turn, _role, _text), nulls of role and text a space."""
    return conversations.select(F.col("conv_id").cast("long").alias("_conv"), F.col("turn").cast("long").alias("_turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(f"_{c}") for c in ("role", "text")])


def repair(conversations: DataFrame, report: bool = False, long_rows: int = 20_000, long_chars: int = 16_000_000) -> DataFrame:
    """Every turn with its edit, and those inserted, as ``EDITED`` (place counts within a conversation); with report one row a conversation, as ``REPORT``.

    A repaired conversation is the rows other than deleted ones, in order of place, with new_role and text.
    """
    ship(conversations.sparkSession)
    rows = plain_rows(conversations)
    sizes = rows.groupBy("_conv").agg(F.count("*").alias("n"), F.sum(F.length("_text").cast("long")).alias("chars"))
    long = stash(sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("_conv").alias("_long")), "long-conversations")
    count = long.count()
    if not count:
        return _whole(rows, report)
    from auditloom.llm.turn_repair_long import repair_long

    named = F.broadcast(long) if count < 100_000 else long
    same = F.col("_conv").eqNullSafe(F.col("_long"))
    return _whole(rows.join(named, same, "left_anti"), report).unionByName(repair_long(rows.join(named, same, "left_semi"), report))


def _whole(rows: DataFrame, report: bool) -> DataFrame:
    """Conversations that a task may hold one by one."""

    def solved(batches):
        for conv, turns in conversations_of(batches):
            seen: set = set()
            faults = [fault(role, text, seen) for _, role, text in turns]
            edits = solve([(role[:1], f) for (_, role, _), f in zip(turns, faults)])
            yield conv, edited(turns, edits, faults)

    def reports(batches):
        def each():
            for conv, turns in solved(batches):
                r = Report()
                for t in turns:
                    r.add(*t)
                yield conv, *r.row()

        yield from packed(each(), arrow(REPORT))

    def turns_out(batches):
        yield from packed(((conv, k, turn, role, text, FAULTS[f], edit, made) for conv, turns in solved(batches) for k, (turn, role, text, f, edit, made) in enumerate(turns)), arrow(EDITED))

    laid = rows.repartition("_conv").sortWithinPartitions("_conv", F.asc_nulls_first("_turn"), "_role", "_text")
    return laid.mapInArrow(reports if report else turns_out, REPORT if report else EDITED)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with faults planted by a checksum of conv_id and turn: of twenty remainders five drop, empty, unpunctuate, repeat or rerole a row.

    Nulls of any column are one space, in the checksum too; null numbers stay null elsewhere.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    plain = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = plain.where("_d <> 0").select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
    return out.drop("_copy")


def damage_and_repair(conversations: DataFrame, **kw) -> DataFrame:
    """The report of every original conversation after damage; one without rows left has zeros, no edits and the digest of nothing."""
    found = repair(damaged(conversations), report=True, **kw)
    every = conversations.select(F.col("conv_id").cast("long").alias("_every")).distinct()
    out = every.join(found, F.col("_every").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
