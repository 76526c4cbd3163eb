"""Substring dedup by line or paragraph hashing, and by windows of words that know no line breaks.

A document's units are its lines (or its paragraphs, parted by blank lines), normalised by case and
white space. Their digests are grouped over the whole table. Of each digest the occurrence of lowest
rank, by (doc_id, text hash, place), stays; the others are repeats. A run of repeats that follow one
another (blank units between them don't count) is removed if it holds ``least_words`` words or more, so
passages go, whether they are one long line or many, while a short common line alone stays. Removed
parts are reported as offsets in the original text.

Each task reduces its own occurrences of a digest to their count and minimum, so a digest that half
the documents hold costs the shuffle a row a task; occurrences are then compared with their digest's
minimum in a join whose skewed side adaptive execution may split.

Passages (``passage_words``). A word also goes if it stands in a window of so many words whose copy comes
earlier, by the same rank, and does not overlap it; so a repeated passage goes from its first word to its
last, wherever lines break. A window is named by the smallest hash of the ``SHINGLE``-word shingles in it (its
print, the leftmost of equals) and its own hash; the neighbouring windows of one print are a block.
Prints that occur once are dropped; equal blocks are compared with their earliest, and only the earliest
of differing blocks of a print are opened into windows, from their documents' texts. Words are parted by ASCII white
space and hashed all at once, by prefix sums over bytes.

Cases: null text stays null; units without words are never repeats; repeated rows (equal doc_id and
text) are one document and get the same result; null doc_ids rank first; an empty table gives no rows;
extra columns are not read by the report and carried through ``remove_repeats``.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ship, stash, unstash
from auditloom.llm.hashing import groups, ranges_hashed, rolled, word_hashes

#: What parts units.
PARTS = {"line": re.compile("\n"), "paragraph": re.compile(r"\n(?:[^\S\n]*\n)+")}

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of the shingles of which a window's least is its print.
SHINGLE = 20


def units_of(text: str, unit: str) -> list[tuple[int, int]]:
    """[start, end) of each unit, in code points."""
    out, at = [], 0
    for m in PARTS[unit].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def repeated_units(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _key, unit): the numbers, from 0, of units that an occurrence of lower rank repeats."""
    ship(docs.sparkSession)

    def digests(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                ids, keys, numbers, found = [], [], [], []
                for d, k, t in zip(b.column(0)[i : i + 256].to_pylist(), b.column(1)[i : i + 256].to_pylist(), b.column(2)[i : i + 256]):
                    t = t.as_py() or ""
                    for n, (a, z) in enumerate(units_of(t, unit)):
                        words = t[a:z].lower().split()
                        if words:
                            ids.append(d)
                            keys.append(k)
                            numbers.append(n)
                            found.append(blake2b(" ".join(words).encode(), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(found, pa.binary())], ["_id", "_key", "unit", "digest"])

    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    every = stash(plain.mapInArrow(digests, "_id long, _key long, unit int, digest binary"), "units")
    rank = F.struct("_id", "_key", "unit")
    first = every.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first")
    first = stash(first, "first-units")
    return every.join(first, F.col("digest") == F.col("_digest")).where(~rank.eqNullSafe(F.col("first"))).select("_id", "_key", "unit")


def least_of(x: np.ndarray, k: int) -> np.ndarray:
    """The smallest of every k neighbouring elements."""
    span = 1
    while span < k:
        step = min(span, k - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


def blocks_of(texts: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: its text's number, print, name, first window and number of windows."""
    x, counts = word_hashes(texts)
    none = np.empty(0, np.int64)
    if len(x) < size:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    short = min(SHINGLE, size)
    text = np.repeat(np.arange(len(texts)), counts)
    whole = np.flatnonzero(text[: len(x) - size + 1] == text[size - 1 :])  # windows inside one text
    if not len(whole):
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    prints, windows, text = least_of(rolled(x, short), size - short + 1)[whole], rolled(x, size)[whole], text[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (text[1:] != text[:-1])
    # a print that stands often in a short stretch: no block is so long that two of its windows lie apart
    run = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    new |= (np.arange(len(new)) - run) % (size - short + 1) == 0
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(whole))
    first = (np.cumsum(counts) - counts)[text[begin]]
    return text[begin], prints[begin], ranges_hashed(windows, begin, end), whole[begin] - first, end - begin


def repeated_passages(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _key, a, z): word numbers [a, z) that windows with an earlier copy cover."""
    ship(docs.sparkSession)

    def blocks(batches):
        for b in batches:
            for i, j in groups(b.column(2)):
                part = b.slice(i, j - i)
                text, prints, names, first, n = blocks_of(part.column(2).to_pylist(), size)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(prints.view(np.int64)), pa.array(names.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["_id", "_key", "fp", "block", "s", "n"])

    def windows(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = rolled(word_hashes([b.column(2)[i].as_py()])[0], size)
                wanted = b.column(3)[i].values
                fp, s, n = (wanted.field(k).to_numpy() for k in range(3))
                which = np.repeat(np.arange(len(n)), n)
                at = s[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
                for k in range(0, len(which), 1 << 16):
                    w, m = at[k : k + (1 << 16)], which[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(w)), pa.repeat(b.column(1)[i], len(w)), pa.array(fp[m]), pa.array(x[w].view(np.int64)), pa.array(w.astype(np.int32))], ["_id", "_key", "fp", "w", "s"])

    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    every = stash(plain.mapInArrow(blocks, "_id long, _key long, fp long, block long, s int, n int"), "blocks")
    often = every.groupBy("fp").agg(F.count("*").alias("k"), (F.min("block") != F.max("block")).alias("many")).where("k > 1").select(F.col("fp").alias("_fp"), "many")
    held = stash(every.join(often, F.col("fp") == F.col("_fp")).drop("_fp"), "frequent-blocks")
    unstash(every)
    same = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_key") == F.col("first._key"))
    later = ~same | (F.col("s") >= F.col("first.s") + size)
    rank = F.struct("_id", "_key", "s")
    least = held.groupBy("fp", "block").agg(F.min(rank).alias("first"), F.count("*").alias("k")).where("k > 1").select(F.col("fp").alias("_fp"), F.col("block").alias("_block"), "first")
    known = held.join(least, (F.col("fp") == F.col("_fp")) & (F.col("block") == F.col("_block")), "left").select("_id", "_key", "fp", "s", "n", "many", (F.col("first").isNotNull() & later).alias("gone"))
    known = stash(known, "known-blocks")
    unstash(held)
    whole = known.where("gone").select("_id", "_key", F.col("s").alias("a"), (F.col("s") + F.col("n") - 1 + size).alias("z"))
    # windows of prints with one block only are never opened
    wanted = known.where(~F.col("gone") & F.col("many")).groupBy(F.col("_id").alias("_d"), F.col("_key").alias("_k")).agg(F.collect_set(F.struct("fp", "s", "n")).alias("wanted"))
    texts = plain.join(wanted, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))).select("_id", "_key", "_text", "wanted")
    opened = stash(texts.mapInArrow(windows, "_id long, _key long, fp long, w long, s int"), "passage-windows")
    least = opened.groupBy("fp", "w").agg(F.min(rank).alias("first"), F.count("*").alias("k")).where("k > 1").select(F.col("fp").alias("_fp"), F.col("w").alias("_w"), "first")
    single = opened.join(least, (F.col("fp") == F.col("_fp")) & (F.col("w") == F.col("_w"))).where(later).select("_id", "_key", F.col("s").alias("a"), (F.col("s") + size).alias("z"))
    return whole.unionByName(single)


def passages_in(text: str, ranges: list) -> list[list[int]]:
    """[start, end) in code points of the joined ranges of words."""
    joined: list[list[int]] = []
    for a, z in sorted((r["a"], r["z"]) for r in ranges):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(z, joined[-1][1])
        else:
            joined.append([a, z])
    places = [m.span() for m in WORD.finditer(text)]
    return [[places[a][0], places[z - 1][1]] for a, z in joined]


def cut(text: str, gone: list[int], unit: str, least_words: int, passages: list[list[int]] = ()) -> tuple[str, list[list[int]]]:
    """text without long enough runs of its repeated units and without its passages, and what was removed."""
    places, repeated, spans = units_of(text, unit), set(gone), []
    run: list[int] = []
    words = 0

    def close():
        nonlocal words
        if run and words >= least_words:
            spans.extend([places[n][0], places[n][1]] for n in run)
        run.clear()
        words = 0

    for n, (a, z) in enumerate(places):
        if n in repeated:
            run.append(n)
            words += len(text[a:z].split())
        elif text[a:z].strip():
            close()
    close()
    whole = {tuple(s) for s in spans}
    partly: dict[int, list[list[int]]] = {}
    at = 0
    for n, (a, z) in enumerate(places):
        if (a, z) in whole:
            continue
        while at < len(passages) and passages[at][1] <= a:
            at += 1
        inside = []
        for p in passages[at:]:
            if p[0] >= z:
                break
            inside.append([max(a, p[0]), min(z, p[1])])
        if not inside:
            continue
        left = []
        for s, e in inside:
            # the blanks after a passage go with it, at the end of a unit those before it
            e += len(text[e:z]) - len(text[e:z].lstrip())
            if e == z:
                s = a + len(text[a:s].rstrip())
            if s < e:
                left.append([s, e])
        kept = text[a : left[0][0]] + "".join(text[x[1] : y[0]] for x, y in zip(left, left[1:])) + text[left[-1][1] : z] if left else text[a:z]
        if kept.strip():
            partly[n] = left
        elif text[a:z].strip():
            whole.add((a, z))
            left = [[a, z]]
        else:
            left = []  # a blank unit inside a passage stays
        spans.extend(left)
    if not spans:
        return text, spans
    spans.sort()
    out = []
    for n, (a, z) in enumerate(places):
        if (a, z) in whole and a != z:
            continue
        start = a
        piece = ""
        for s, e in partly.get(n, ()):
            piece += text[start:s]
            start = e
        out.append(piece + text[start:z])
    return ("\n" if unit == "line" else "\n\n").join(out), spans


def remove_repeats(docs: DataFrame, least_words: int = 30, unit: str = "line", id_col: str = "doc_id", text_col: str = "text", report: bool = False, passage_words: int = 0) -> DataFrame:
    """docs without repeated passages in its text, other columns as they are.

    passage_words: repeated passages of so many words go too, wherever they begin and end in a unit; 0: units only.

    report: (doc_id, text, n_removed, removed_chars, spans) instead, spans as [start, end) in code
    points of the original text, the breaks between units left out.
    """
    marks = repeated_units(docs, unit, id_col, text_col).select("_id", "_key", "unit", F.lit(None).cast("struct<a:int,z:int>").alias("part"))
    if passage_words:
        marks = marks.unionByName(repeated_passages(docs, passage_words, id_col, text_col).select("_id", "_key", F.lit(None).cast("int").alias("unit"), F.struct("a", "z").alias("part")))
    found = marks.groupBy("_id", "_key").agg(F.struct(F.collect_set("unit").alias("units"), F.collect_set("part").alias("parts")).alias("__s_gone")).withColumnsRenamed({"_id": "__s_id", "_key": "__s_text"})
    rows = docs.withColumn("__s_key", F.xxhash64(text_col))
    both = rows.join(found, rows[id_col].eqNullSafe(found["__s_id"]) & (rows["__s_key"] == found["__s_text"]), "left")
    others = [c for c in docs.columns if c != text_col] if not report else [id_col]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    laid = both.select(rows[text_col].alias("_text"), F.col("__s_gone").alias("_gone"), *[rows[c].alias(f"x{i}") for i, c in enumerate(others)])

    def rebuild(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts, spans = [], []
                for t, gone in zip(part.column(0), part.column(1)):
                    new, out = t.as_py(), []
                    if gone.is_valid and t.is_valid:
                        marked = gone.as_py()
                        new, out = cut(new, marked["units"], unit, least_words, passages_in(new, marked["parts"]) if marked["parts"] else [])
                    texts.append(new)
                    spans.append(out)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), *part.columns[2:]], ["text", "spans", *(f"x{i}" for i in range(len(others)))])

    done = laid.mapInArrow(rebuild, "text string, spans array<array<bigint>>" + "".join(f", x{i} {kinds[c]}" for i, c in enumerate(others)))
    if report:
        chars = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
        return done.select(F.col("x0").alias("doc_id"), "text", F.size("spans").cast("long").alias("n_removed"), chars.alias("removed_chars"), "spans")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"x{others.index(c)}").alias(c) for c in docs.columns])
