"""Run-scoped reports over crawl_urls; all sections of a composite report come from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.sources.database import database_rows

LISTED = ("address", "timestamp", "status_code")


def _ci(c: Column) -> Column:
    """Compared without case and trailing spaces, as the tables' text was."""
    return F.lower(F.rtrim(c))


def in_run(urls: DataFrame, run_id: str) -> DataFrame:
    return urls.where(_ci(F.col("run_id")) == run_id.rstrip(" ").lower())


def _code(prefix: str) -> Column:
    return F.col("status_code").cast("string").like(prefix + "%")


#: name -> (the columns that its predicate reads, the predicate, the value column reported beside address and timestamp)
def _sections() -> dict[str, tuple[tuple[str, ...], object, str]]:
    page = lambda c: lambda: (_ci(F.col("content_type")) == "text/html") & F.col(c).isNull()
    above = lambda c: lambda: F.col(c) > 0
    return {
        "5xx or 0 status codes": (("status_code",), lambda: _code("5") | (F.col("status_code") == 0), "status_code"), "4xx status codes": (("status_code",), lambda: _code("4"), "status_code"),
        "missing canonical": (("content_type", "canonical"), page("canonical"), "content_type"), "missing title": (("content_type", "title_1"), page("title_1"), "content_type"),
        "missing meta description": (("content_type", "meta_description_1"), page("meta_description_1"), "content_type"), "lint level critical": (("lint_critical",), above("lint_critical"), "lint_critical"), "lint level error": (("lint_error",), above("lint_error"), "lint_error"),
    }


def sections() -> dict[str, tuple[Column, str]]:
    """name -> (predicate of a row, value column)."""
    return {n: (where(), value) for n, (_, where, value) in _sections().items()}


def columns(names: tuple[str, ...]) -> tuple[str, ...]:
    """What these sections read of crawl_urls."""
    held = _sections()
    return ("id", "run_id", "address", "external", "timestamp", *dict.fromkeys(c for n in names for c in held[n][0]))


BUILD = ("5xx or 0 status codes", "4xx status codes", "missing canonical", "missing title", "missing meta description", "lint level critical", "lint level error")
STATUS = BUILD[:2]


def latest_run(urls: DataFrame) -> DataFrame:
    return urls.select("run_id", "timestamp", "id").orderBy(F.desc("timestamp"), F.desc("id")).limit(1).select("run_id")


def all_report(urls: DataFrame, run_id: str) -> DataFrame:
    return in_run(urls, run_id).orderBy(F.desc("timestamp"), F.desc("id"))


def section(urls: DataFrame, run_id: str, name: str) -> DataFrame:
    where, value = sections()[name]
    columns = ("address", "timestamp") + ((value,) if value != "content_type" else ("content_type",))
    return in_run(urls, run_id).where((F.col("external") == 0) & where).orderBy("timestamp", "id").select("id", *columns)


def composite(urls: DataFrame, run_id: str, names: tuple[str, ...] = BUILD) -> DataFrame:
    """(section_ord, section, id, address, timestamp, value) of all sections, from one scan of the run's internal rows."""
    held = sections()
    marks = F.array(*[F.when(held[n][0], F.struct(F.lit(i).alias("section_ord"), F.lit(n).alias("section"), F.col(held[n][1]).cast("string").alias("value"))) for i, n in enumerate(names)])
    rows = in_run(urls, run_id).where("external = 0").select("id", "address", "timestamp", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
    return rows.select("m.section_ord", "m.section", "id", "address", "timestamp", "m.value").orderBy("section_ord", "timestamp", "id")


def build_report(urls: DataFrame, run_id: str) -> DataFrame:
    return composite(urls, run_id, BUILD)


def status_code_report(urls: DataFrame, run_id: str) -> DataFrame:
    return composite(urls, run_id, STATUS)


def parts(urls: DataFrame, kind: str, run_id: str) -> list[tuple[str, list[str], DataFrame]]:
    """(section, columns rendered, rows in report order) of a report; the report of all rows is one section of all columns."""
    if kind == "all":
        rows = all_report(urls, run_id)
        return [("all", [c for c in rows.columns if c != "run_id"], rows)]
    if kind not in REPORTS:
        raise ValueError(f"unknown report type {kind}")
    held = sections()
    return [(n, ["address", "timestamp", held[n][1]], section(urls, run_id, n)) for n in (BUILD if kind == "build" else STATUS)]


def stored_urls(spark, source: str, run_id: str | None = None, **options: str) -> DataFrame:
    """Stored rows of crawl_urls: a table of the catalog, a Parquet folder, or jdbc:... with its options (dbtable, user, password, partitions).

    With a run id, only that run's partitions are read.
    """
    if source.startswith("jdbc:"):
        urls = database_rows(spark, source, run_id, int(options.pop("partitions", 16)), **options)
    else:
        urls = spark.read.parquet(source) if "/" in source else spark.table(source)
    urls = urls.withColumn("run_id", F.col("run_id").cast("string")).drop("round") if "round" in urls.columns else urls
    return urls if run_id is None else urls.where(F.col("run_id") == run_id)


REPORTS = {"build": build_report, "status_code": status_code_report, "all": all_report}


def report(urls: DataFrame, kind: str, run_id: str | None = None) -> DataFrame:
    if kind not in REPORTS:
        raise ValueError(f"unknown report type {kind}")
    run_id = run_id or (latest_run(urls).first() or [None])[0]
    if run_id is None:
        raise ValueError("there is no run")
    return REPORTS[kind](urls, run_id)


def run_page(urls: DataFrame, run_id: str, page: int = 1, length: int = 50) -> DataFrame:
    return in_run(urls, run_id).where("external = 0").orderBy("timestamp", "id").offset((page - 1) * length).limit(length)


def run_count(urls: DataFrame, run_id: str) -> DataFrame:
    """External rows included."""
    return in_run(urls, run_id).agg(F.count("id").alias("n"))


def run_ids(urls: DataFrame) -> DataFrame:
    return urls.groupBy("run_id").agg(F.min("timestamp").alias("first_seen")).orderBy("first_seen", "run_id")


def paging(count: int, page: int = 1, length: int = 50) -> dict:
    """next_page by integer division of the run's count, as listings had it; has_more is exact for that count."""
    return {"page": page, "page_length": length, "prev_page": page - 1 if page > 1 else None, "next_page": page + 1 if page < count // length else None, "has_more": page * length < count}


def junit_sections(urls: DataFrame, run_id: str, names: tuple[str, ...] = BUILD) -> DataFrame:
    """(section_ord, section, errors, addresses) for every section, empty ones too; addresses comma-joined in report order."""
    spark = urls.sparkSession
    rows = composite(urls, run_id, names).groupBy("section_ord").agg(F.count("*").alias("errors"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id", "address"))), lambda x: x["address"]), ", ").alias("addresses"))
    listed = spark.createDataFrame(list(enumerate(names)), "section_ord int, section string")
    return listed.join(rows, "section_ord", "left").select("section_ord", "section", F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"), F.coalesce("addresses", F.lit("")).alias("addresses"))
