"""Sitemap files of any size, a row an entry: a file is split where its entries begin, so no cell or task holds one whole.

``operators.lint.sitemap`` takes a sitemap as one text; this is the way for files that are too large for that, and for trees of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.html import decode


def _rows(spark: SparkSession, paths: str | list[str], tag: str, names: tuple[str, ...]) -> DataFrame:
    """A row an element: the closing tag parts the records of a text source, which can be split anywhere."""
    records = spark.read.option("lineSep", f"</{tag}>").text(paths).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*+)?>(.*)\z", 1).alias("_body")).where("_body <> ''")

    def part(name: str) -> Column:
        return F.nullif(decode(F.trim(F.regexp_extract("_body", rf"(?s)<{name}(?:\s[^>]*+)?>([^<]*+)</{name}\s*+>", 1))), F.lit("")).alias(name)

    return records.select("file", *[part(n) for n in names])


def entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, loc, priority, changefreq, lastmod) of every <url> of the files; absent and empty values are NULL."""
    return _rows(spark, paths, "url", ("loc", "priority", "changefreq", "lastmod"))


def indexed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, loc) of every <sitemap> of the files."""
    return _rows(spark, paths, "sitemap", ("loc",))


def tree(spark: SparkSession, root: str, to_path: Callable[[Column], Column], rounds: int = 4) -> DataFrame:
    """The entries of a sitemap and of all that its indexes name, followed ``rounds`` deep; each file is read once, so a cycle ends.

    to_path: from a <loc> to where its file is stored. Only names of files come to the driver, which an index bounds at 50,000.
    """
    found, level, seen = entries(spark, root), [root], {root}
    for _ in range(rounds):
        named = indexed(spark, level).select(to_path(F.col("loc")).alias("path")).where("path IS NOT NULL").distinct()
        level = sorted({r["path"] for r in named.collect()} - seen)
        if not level:
            break
        seen |= set(level)
        found = found.unionByName(entries(spark, level))
    return found


def rules(rows: DataFrame) -> DataFrame:
    """(file, n, rule) of the rules that fire on each file: E33, I30, I31, I32, as for sitemaps read as one text. Counts are reduced before their shuffle."""
    have = [F.count(c).alias(c) for c in ("priority", "changefreq", "lastmod")]
    counted = rows.groupBy("file").agg(F.count("*").alias("n"), *have)
    fires = F.array(F.when(F.col("n") >= 10000, "E33"), *[F.when(F.col(c) > 0, r) for r, c in (("I30", "priority"), ("I31", "changefreq"), ("I32", "lastmod"))])
    return counted.select("file", "n", F.explode(F.array_compact(fires)).alias("rule"))
