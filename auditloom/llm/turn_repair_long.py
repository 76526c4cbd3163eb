"""Repairs conversations too long for one task: by parts, whose ends are tied together by a few numbers each.

1. Equal rows are counted, and the rest are range-sorted into parts; a row's ``pos`` is its place.
2. The first place of each role and text, a minimum reduced before its shuffle, tells duplicates.
3. Each part is summed up: the costs from each state before it to each state after it.
4. From a conversation's last part to its first these give what the rest costs from each state after a part.
5. Each part is traced from each state before it; then from the first part to the last the states that the trace passes are known.
6. The edits of those states go back to the texts by place.

Only steps 4 and 5 see a conversation whole, as 16 numbers a part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import stash
from auditloom.llm.turn_repair import BLANK, CUT, DELETE, DUPLICATE, EDITED, ENDED, FAULTS, MADE, REPORT, START, UNREACHED, Layers, Report, arrow, before, inserted, packed, tail, traced

CODES = "_conv long, _part long, _pos long, _initial string, _fault int, _copies long"


def turns_of(table: pa.Table) -> tuple[list[int], list[tuple[str, int]], list[int]]:
    """Places, turns and numbers of further copies of a part, in order."""
    t = table.sort_by("_pos")
    return t["_pos"].to_pylist(), list(zip(t["_initial"].to_pylist(), t["_fault"].to_pylist())), [n - 1 for n in t["_copies"].to_pylist()]


def back(turns: list[tuple[str, int]], more: list[int], after: Layers) -> tuple[list[Layers], list[Layers]]:
    """The layers before each turn, and those after it but before its copies, which are deleted at a known cost."""
    heres, thens = [], []
    for (initial, fault), n in zip(reversed(turns), reversed(more)):
        thens.append(Layers(after.bits, after.base + DELETE * n))
        after = before(thens[-1], initial, fault)
        heres.append(after)
    return heres[::-1], thens[::-1]


def summed(key, table):
    _, turns, more = turns_of(table)
    costs = []
    for q in range(4):
        first = back(turns, more, Layers.of([0 if s == q else UNREACHED for s in range(4)]))[0][0]
        costs += [first.cost(p) for p in range(4)]
    return pa.table({"_conv": pa.array([key[0].as_py()], pa.int64()), "_part": pa.array([key[1].as_py()], pa.int64()), "_costs": pa.array([costs], pa.list_(pa.int64()))})


def rests(key, table):
    """Of one conversation: what the rest costs from each state after each part."""
    t = table.sort_by([("_part", "descending")])
    held = Layers(inserted(Layers.of(list(ENDED)).bits))
    now, out = [held.cost(s) for s in range(4)], []
    for costs in t["_costs"].to_pylist():
        out.append(now)
        now = [min(min(costs[4 * q + p] + now[q] for q in range(4)), UNREACHED) for p in range(4)]
    return pa.table({"_conv": t["_conv"], "_part": t["_part"], "_rest": pa.array(out, pa.list_(pa.int64()))})


def traces(key, codes, rest):
    """Of one part: the edits at each place from each state before the part; at the last place, where they lead and how many they are."""
    pos, turns, more = turns_of(codes)
    costs = rest["_rest"][0].as_py()
    heres, thens = back(turns, more, Layers.of(costs))
    letters, leads, counts = [[] for _ in pos], [], []
    for p in range(4):
        if heres[0].cost(p) >= UNREACHED:
            for x in letters:
                x.append("")
            leads.append(0)
            counts.append(0)
            continue
        n = 0
        edits, state = traced(turns, heres, thens, more, p)
        at = iter(edits)
        for x, copies in zip(letters, more):
            own = ""
            for letter, to in at:
                own += f"{letter}{to}"
                if letter != "I":
                    break
            x.append(own)
            n += len(own) // 2 + copies
        leads.append(state)
        counts.append(n)
    last = [None] * (len(pos) - 1)
    return pa.table({"_conv": pa.array([key[0].as_py()] * len(pos), pa.int64()), "_part": pa.array([key[1].as_py()] * len(pos), pa.int64()), "_pos": pa.array(pos, pa.int64()), "_letters": pa.array(letters, pa.list_(pa.string())), "_leads": pa.array([*last, leads], pa.list_(pa.int64())), "_counts": pa.array([*last, counts], pa.list_(pa.int64()))})


def passed(key, table):
    """Of one conversation: the state before each part, the number of edits before it, and what is inserted behind its last turn."""
    t = table.sort_by("_part")
    state, n, enter, first, ends = START, 0, [], [], []
    for leads, counts in zip(t["_leads"].to_pylist(), t["_counts"].to_pylist()):
        enter.append(state)
        first.append(n)
        ends.append("")
        n += counts[state]
        state = leads[state]
    ends[-1] = "".join(f"{letter}{to}" for letter, to in tail(state))
    return pa.table({"_c": t["_conv"], "_p": t["_part"], "_last": t["_pos"], "_enter": pa.array(enter, pa.int32()), "_before": pa.array(first, pa.int64()), "_end": pa.array(ends, pa.string())})


def repair_long(rows: DataFrame, report: bool) -> DataFrame:
    """As repair(), for rows of long conversations."""
    order = ("_conv", "_turn", "_role")
    counted = rows.groupBy("_conv", "_turn", "_role", "_text").agg(F.count("*").alias("_copies"))
    sorted_ = counted.repartitionByRange(*order, F.substring("_text", 1, 64)).sortWithinPartitions(*order, "_text")
    laid = stash(sorted_.withColumn("_pos", F.monotonically_increasing_id()), "turns")
    blank, ended = ~F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.col("_text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    firsts = laid.where(~blank).groupBy("_conv", "_role", F.sha2("_text", 256)).agg(F.min("_pos").alias("_first")).select("_first")
    fault = F.when(blank, BLANK).when(F.col("_first").isNull(), DUPLICATE).when(~ended, CUT).otherwise(0)
    marked = laid.join(firsts, F.col("_pos") == F.col("_first"), "left")
    codes = stash(marked.select("_conv", F.shiftright("_pos", 33).alias("_part"), "_pos", F.substring("_role", 1, 1).alias("_initial"), fault.alias("_fault"), "_copies"), "turn-codes")
    part = codes.groupBy("_conv", "_part")
    sums = part.applyInArrow(summed, "_conv long, _part long, _costs array<long>")
    rest = sums.groupBy("_conv").applyInArrow(rests, "_conv long, _part long, _rest array<long>")
    traced_ = stash(part.cogroup(rest.groupBy("_conv", "_part")).applyInArrow(traces, "_conv long, _part long, _pos long, _letters array<string>, _leads array<long>, _counts array<long>"), "turn-edits")
    through = traced_.where("_leads is not null").groupBy("_conv").applyInArrow(passed, "_c long, _p long, _last long, _enter int, _before long, _end string")
    own = traced_.join(through, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p"))).select(F.col("_pos").alias("_at"), F.get("_letters", "_enter").alias("_edits"), F.when(F.col("_pos") == F.col("_last"), F.col("_end")).otherwise("").alias("_end"), "_before", "_c", "_p")
    whole = laid.join(codes.select(F.col("_pos").alias("_q"), "_fault"), F.col("_pos") == F.col("_q")).join(own, F.col("_pos") == F.col("_at"))
    # places count on within a part from the edits before it
    flat = whole.select("_conv", "_p", "_before", "_pos", "_turn", "_role", "_text", "_fault", "_edits", "_end", "_copies")

    def turns_out(batches):
        def each():
            part_, place = None, 0
            for b in batches:
                for conv, p, first, _, turn, role, text, fault, edits, end, copies in zip(*(x.to_pylist() for x in b.columns)):
                    if part_ != (conv, p):
                        part_, place = (conv, p), first
                    made = [(edits[i], int(edits[i + 1])) for i in range(0, len(edits), 2)]
                    again = BLANK if fault == BLANK else DUPLICATE
                    rows = [(letter, to, fault) for letter, to in made] + [("D", 0, again)] * (copies - 1) + [(end[i], int(end[i + 1]), 0) for i in range(0, len(end), 2)]
                    for letter, to, f in rows:
                        if letter == "I":
                            yield conv, place, None, None, "", "", "I", MADE[to]
                        else:
                            yield conv, place, turn, role, text, FAULTS[f], letter, None if letter == "D" else role if letter == "K" else MADE[to]
                        place += 1

        yield from packed(each(), arrow(EDITED))

    edits = flat.repartition("_conv", "_p").sortWithinPartitions("_conv", "_p", "_pos").mapInArrow(turns_out, EDITED)
    if not report:
        return edits

    def reports(batches):
        def each():
            conv, r = None, None
            for b in batches:
                for c, _, turn, role, text, fault, edit, made in zip(*(x.to_pylist() for x in b.columns)):
                    if r is None or c != conv:
                        if r is not None:
                            yield conv, *r.row()
                        conv, r = c, Report()
                    r.add(turn, role, text, FAULTS.index(fault), edit, made)
            if r is not None:
                yield conv, *r.row()

        yield from packed(each(), arrow(REPORT))

    # a digest runs over its conversation from end to end: its turns stream through one task, which holds none of them
    return edits.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(reports, REPORT)
