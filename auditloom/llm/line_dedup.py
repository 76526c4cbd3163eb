"""Line dedup by winnowing over line hashes. DataFrame functions only.

Rule. Lines are split at newlines; blank lines are never counted and never removed. Over a document's
other lines a *window* is ``run`` consecutive lines, or a single line of at least ``long_words`` words, or two
consecutive shorter lines that hold so many words together.
A line is removed if it stands in a window whose lines (trimmed) also stand, in the same order, in a
window that comes earlier (by doc_id, then text hash, then position) and does not overlap it. So every
repeated run of ``run`` lines or more goes wholly, whatever stands around it, and its first copy stays.

Method. A line is a row with a 64-bit and a 32-bit hash. Each window's smallest line hash is its fingerprint;
neighbouring windows mostly choose the same place, and a repeated window is bound to choose the same
place in each copy. Fingerprints that stand at one place only are dropped, with their windows. The
positions of the others are joined: each with the earliest of its window, never with all of them. Matches that
continue one another, in the document and in its source, are extended both ways into one run, and
the lines of the runs are deleted.

Cases: null text stays null, empty text stays empty; repeated rows (equal doc_id and text) count as one
document and get the same result; null doc_ids come first and are documents like others; an empty table
gives no rows; extra columns, whatever their names, are carried through ``dedup_lines`` and not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import stash, unstash


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _norm(line: Column) -> Column:
    return F.trim(F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")))


def _words(s: Column) -> Column:
    """Words of a trimmed line; a regular expression is only needed where other white space or several blanks part them."""
    odd = s.contains("  ") | s.contains("\x0b") | s.contains("\f")
    return F.when(odd, F.size(F.split(s, r"\s+"))).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1)


def _windows(docs: DataFrame, run: int, long_words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per window: (_id, _key, p, size, fp, new, w1, w2, a, z).

    p: the number of its first line among the solid ones; a, z: the line numbers of its first and last line; fp:
    its smallest line hash; new: whether the window before chose another place; w1, w2: hashes of all its lines.
    """
    each = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.posexplode(_lines(F.col(text_col))).alias("i0", "line"))
    solid = each.select("_id", "_key", "i0", _norm(F.col("line")).alias("s")).where("s <> ''")
    rows = solid.select("_id", "_key", "i0", F.xxhash64("s").alias("h0"), (F.crc32(F.col("s").cast("binary")) - (1 << 31)).cast("int").alias("c0"), _words(F.col("s")).alias("n0")).dropDuplicates(["_id", "_key", "i0"])
    w = Window.partitionBy("_id", "_key").orderBy("i0")
    ahead = {f"{c}{k}": F.lead(f"{c}0", k).over(w) for c in "hci" for k in range(1, run)} | {f"{c}1": F.lead(f"{c}0", 1).over(w) for c in "hcin"}
    laid = rows.withColumns(ahead | {"p": F.row_number().over(w)})

    def window(size: int, new: Column) -> Column:
        held = [F.col(f"h{k}") for k in range(size)]
        least = F.least(*held) if size > 1 else held[0]
        return F.struct(F.lit(size).alias("size"), least.alias("fp"), new.alias("new"), F.xxhash64(*held).alias("w1"), F.hash(*[F.col(f"c{k}") for k in range(size)]).alias("w2"), F.col("i0").alias("a"), F.col(f"i{size - 1}").alias("z"))

    always = F.lit(True)
    kinds = [F.when((F.col("n0") >= long_words) | F.lit(run == 1), window(1, always))]
    if run > 2:
        short = (F.col("n0") < long_words) & (F.col("n1") < long_words)
        kinds.append(F.when(short & (F.col("n0") + F.col("n1") >= long_words), window(2, always)))
    if run > 1:
        # the place of the least hash, the first of equals, and that of the window one line before
        least = F.least(*[F.col(f"h{k}") for k in range(run)])
        place = F.col("p") + F.coalesce(*[F.when(F.col(f"h{k}") == least, k) for k in range(run)])
        laid = laid.withColumn("place", F.when(F.col(f"h{run - 1}").isNotNull(), place))
        laid = laid.withColumn("before", F.lag("place", 1).over(w))
        kinds.append(F.when(F.col("place").isNotNull(), window(run, F.coalesce(F.col("before") != F.col("place"), always))))
    return laid.select("_id", "_key", "p", F.explode(F.array(*kinds)).alias("x")).where("x is not null").select("_id", "_key", "p", "x.*")


def repeated_runs(docs: DataFrame, run: int = 3, long_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _key, a, z, from_id, from_key, from_a): each run of lines a to z that has an earlier copy, which begins at from_a.

    A document whose parts were first seen in several places has a run for each, and runs may overlap.
    """
    every = stash(_windows(docs, run, long_words, id_col, text_col), "winnowed")
    often = every.where("new").groupBy("size", "fp").agg(F.count("*").alias("n")).where("n > 1").select(F.col("size").alias("_size"), F.col("fp").alias("_fp"))
    held = stash(every.join(often, (F.col("size") == F.col("_size")) & (F.col("fp") == F.col("_fp")), "left_semi").drop("fp", "new"), "candidates")
    unstash(every)
    name = ["size", "w1", "w2"]
    first = held.groupBy(*name).agg(F.min(F.struct("_id", "_key", "a", "z", "p")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(*[F.col(c).alias(f"_{c}") for c in name], *[F.col(f"first.{c}").alias(f"from{c if c[0] == '_' else '_' + c}") for c in ("_id", "_key", "a", "z", "p")])
    first = stash(first, "earliest")  # read anew, so that adaptive execution may split a window that many documents hold
    found = held.join(first, reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in name]))
    same = F.col("_id").eqNullSafe(F.col("from_id")) & (F.col("_key") == F.col("from_key"))
    matches = found.where(~same | (F.col("a") > F.col("from_z"))).withColumn("far", F.col("p") - F.col("from_p"))
    # matches at one distance from their copies, each begun inside or right behind the one before, are one run
    side = ["_id", "_key", "from_id", "from_key", "far"]
    w = Window.partitionBy(*side).orderBy("p", "size")
    reach = F.max(F.col("p") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = matches.withColumn("begins", F.coalesce((F.col("p") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("k", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*side, "k").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min("from_a").alias("from_a")).select("_id", "_key", "a", "z", "from_id", "from_key", "from_a")


def dedup_lines(docs: DataFrame, run: int = 3, long_words: int = 50, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """docs with the later copies of repeated runs removed from its text; other columns as they are.

    report: instead (doc_id, text, n_lines, n_removed, removed, runs): removed holds the original line numbers, from 0,
    blank lines counted, and runs (first line, last line, doc_id and first line of the earlier copy).
    """
    runs = repeated_runs(docs, run, long_words, id_col, text_col)
    gone = runs.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.struct("a", "z", "from_id", "from_a"))).alias("__l_runs")).withColumnsRenamed({"_id": "__l_id", "_key": "__l_text"})
    rows = docs.withColumn("__l_key", F.xxhash64(text_col))
    both = rows.join(gone, rows[id_col].eqNullSafe(gone["__l_id"]) & (rows["__l_key"] == gone["__l_text"]), "left")
    both = both.withColumn("__l_lines", F.when(F.col("__l_runs").isNotNull(), _lines(rows[text_col])))
    inside = F.array_distinct(F.flatten(F.transform("__l_runs", lambda r: F.sequence(r["a"], r["z"]))))
    both = both.withColumn("__l_gone", F.array_sort(F.filter(inside, lambda k: _norm(F.get("__l_lines", k)) != "")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__l_lines") - 1), F.col("__l_gone"))
    kept = F.array_join(F.transform(stay, lambda k: F.get("__l_lines", k)), "\n")
    text = F.when(F.col("__l_runs").isNull(), rows[text_col]).otherwise(kept)
    if report:
        removed = F.coalesce("__l_gone", F.array().cast("array<int>"))
        n_lines = F.when(rows[text_col].isNull(), 0).otherwise(F.length(rows[text_col]) - F.length(F.replace(rows[text_col], F.lit("\n"))) + 1)
        runs = F.coalesce("__l_runs", F.array().cast(gone.schema["__l_runs"].dataType))
        return both.select(rows[id_col].alias("doc_id"), text.alias("text"), n_lines.cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), runs.alias("runs"))
    return both.select(*[text.alias(c) if c == text_col else rows[c] for c in docs.columns])
