"""How filters interact: what each removes in every order, from the edges of the lattice of applied subsets.

A document's failures are one bit a filter. An edge of the lattice is (the subset of filters already applied, the next filter);
for five filters there are 80. Documents are first counted by part and failure bits, so at most 32 rows a part meet the 80 edges,
and each order of the filters is a path of five edges: 600 steps for 120 orders, joined to the edges.

Copies: a document fails the last filter if its text stands under a smaller id, anywhere in the table. The smallest id of each
text's SHA-256 is a minimum, reduced before it is shuffled, and goes back to the one document that bears it: no task gathers the
copies of a text.

Cases: a null text is an empty one (and so a copy of one); a null part is the empty string; a null id is no copy, and no text is
a copy of it; rows that repeat an id with its text fail alike, as no smaller id has the text; of repeated labels one that says 1
counts; other columns are not read; an empty table has no parts.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters by letter; the bit of each is its place here.
LETTERS = "ABCDE"


def failed(text: Column) -> Column:
    """Bits of the filters that look at one text only, A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    rules = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text), text.rlike("[#$%&*|]"))
    out = F.lit(0)
    for k, rule in enumerate(rules):
        out = out + F.when(rule, 1 << k).otherwise(0)
    return out


def failures(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, failed, good, toxic) of each document: failed has a bit for each filter."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    firsts = docs.where(F.col(id_col).isNotNull()).groupBy(digest.alias("_same")).agg(F.min(F.col(id_col).cast("long")).alias("_first"))
    own = docs.select(F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("_id"), digest.alias("_digest"), failed(text).alias("_failed"))
    marked = own.join(firsts, (F.col("_id") == F.col("_first")) & (F.col("_digest") == F.col("_same")), "left")
    copy = F.when(F.col("_id").isNotNull() & F.col("_first").isNull(), 1 << 4).otherwise(0)
    said = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    both = marked.select("part", "_id", (F.col("_failed") + copy).alias("failed")).join(said, F.col("_id") == F.col("_labelled"), "left")
    return both.select("part", "failed", *[F.coalesce(F.col(c), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])


def lattice(letters: str = LETTERS) -> list[tuple[int, int]]:
    """(applied subset, next filter) of every edge, as bits and a bit's place."""
    k = len(letters)
    return [(sum(1 << i for i in s), f) for f in range(k) for n in range(k) for s in combinations([i for i in range(k) if i != f], n)]


def edges(found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, applied, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part and edge."""
    k = len(letters)
    counted = found.groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    every = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(1 << f).alias("bit"), F.lit(factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1"))).cast("long").alias("orders")) for s, f in lattice(letters)])
    met = counted.select("*", F.explode(every).alias("e")).select("part", "failed", "n", "good", "toxic", "e.*")
    fails, arrives = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("applied")) == 0
    total = lambda c, when, name: F.sum(F.when(when, F.col(c)).otherwise(0)).alias(name)
    out = met.groupBy("part", "applied", "next", "orders").agg(
        total("n", arrives & ~fails, "kept"), total("n", arrives & fails, "removed"), total("n", fails & ~arrives, "redundant"), total("n", F.col("failed") == F.col("bit"), "unique_fails"),
        total("good", arrives & fails, "good_lost"), total("toxic", arrives & fails, "toxic_lost"),
    )
    shares = out.groupBy(F.col("part").alias("_p"), F.col("next").alias("_n")).agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return out.join(shares, (F.col("part") == F.col("_p")) & (F.col("next") == F.col("_n"))).drop("_p", "_n", "orders")


def audit(found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, counts) for every order of the filters: each order's path through the lattice."""
    paths = []
    for order in permutations(range(len(letters))):
        applied = 0
        for step, f in enumerate(order):
            paths.append(("".join(letters[i] for i in order), step + 1, applied, f))
            applied |= 1 << f
    steps = found.sparkSession.createDataFrame(paths, "filter_order string, step int, _applied int, _next int")
    # the steps are 600 rows whatever the corpus
    met = edges(found, letters).join(F.broadcast(steps), (F.col("applied") == F.col("_applied")) & (F.col("next") == F.col("_next")))
    return met.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
