"""From fetched responses to the crawl_urls table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.html import FIELDS, parse
from auditloom.functions.urls import content_hash, netloc, path
from auditloom.operators.lint import fields as rule_fields
from auditloom.operators.lint import level_count, lint_html, results_json

# The 38 columns of a crawled URL, in order.
URL_SCHEMA = (
    "id bigint, run_id string, level int, content_hash string, address string, domain string, path string, external int, status_code int, status string, body string, size bigint, "
    "address_length int, encoding string, content_type string, response_time float, redirect_uri string, canonical string, title_1 string, title_length_1 int, title_occurences_1 int, "
    "meta_description_1 string, meta_description_length_1 int, meta_description_occurrences_1 int, h1_1 string, h1_length_1 int, h1_2 string, h1_length_2 int, h1_count int, meta_robots string, "
    "rel_next string, rel_prev string, lint_critical int, lint_error int, lint_warn int, lint_info int, lint_results string, timestamp timestamp"
)
LINK_SCHEMA = "id bigint, run_id string, type string, from_url_id bigint, to_url_id bigint, link_text string, alt_text string, rel string"


def is_html(code: Column, content_type: Column) -> Column:
    return F.coalesce((code == 200) & (content_type == "text/html"), F.lit(False))


#: What of a parsed document the page details read.
DETAIL_FIELDS = ("has_head", "canonical", "title", "has_description", "description", "h1s", "h1_count", "robots", "rel_next", "rel_prev")


def parse_responses(responses: DataFrame, parts: tuple[str, ...] = FIELDS, lint: bool = True) -> DataFrame:
    """Adds ``doc`` (and ``lint``) to responses (url, code, content_type, content, ...); NULL for what is no HTML page."""
    gated = responses.withColumn("page__", F.when(is_html(F.col("code"), F.col("content_type")), F.coalesce("content", F.lit(""))))
    parsed = parse(gated, "page__", "url", (*parts, *(rule_fields() if lint else ())))
    return (lint_html(parsed) if lint else parsed).drop("page__")


def details(d: Column) -> dict[str, object]:
    """The stored page details, each as what builds it; all NULL without a head. The description's length is stored as 0, as it always was."""
    on = lambda name, c: lambda: F.when(F.coalesce(d["has_head"], F.lit(False)), c())
    h1 = lambda k: F.try_element_at(d["h1s"], F.lit(k))
    values = {
        "canonical": lambda: d["canonical"], "title_1": lambda: d["title"], "title_length_1": lambda: F.length(d["title"]), "meta_description_1": lambda: d["description"],
        "meta_description_length_1": lambda: F.lit(0), "h1_1": lambda: h1(1), "h1_length_1": lambda: F.coalesce(F.length(h1(1)), F.lit(0)), "h1_2": lambda: h1(2),
        "h1_length_2": lambda: F.coalesce(F.length(h1(2)), F.lit(0)), "h1_count": lambda: d["h1_count"], "meta_robots": lambda: d["robots"], "rel_next": lambda: d["rel_next"], "rel_prev": lambda: d["rel_prev"],
    }
    return {name: on(name, c) for name, c in values.items()}


def crawl_urls(parsed: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The 38 columns, or those named, from parsed responses with id, run_id, url, external, code, reason, content, size, encoding, content_type, response_time, timestamp, doc, lint."""
    u, body, lint = F.col("url"), F.coalesce("content", F.lit("")), F.col("lint")
    null, counted = lambda: F.lit(None), lambda letter: lambda: level_count(lint, letter)
    values = {
        "id": lambda: F.col("id"), "run_id": lambda: F.col("run_id"), "level": lambda: F.lit(0), "content_hash": lambda: content_hash(body), "address": lambda: u, "domain": lambda: netloc(u), "path": lambda: path(u), "external": lambda: F.col("external"),
        "status_code": lambda: F.col("code"), "status": lambda: F.col("reason"), "body": lambda: body, "size": lambda: F.greatest(F.lit(0), F.coalesce(F.col("size").cast("bigint"), F.lit(0))), "address_length": lambda: F.length(u),
        "encoding": lambda: F.col("encoding"), "content_type": lambda: F.col("content_type"), "response_time": lambda: F.col("response_time"), "redirect_uri": null, **details(F.col("doc")), "title_occurences_1": null, "meta_description_occurrences_1": null,
        "lint_critical": counted("C"), "lint_error": counted("E"), "lint_warn": counted("W"), "lint_info": counted("I"), "lint_results": lambda: results_json(lint), "timestamp": lambda: F.col("timestamp"),
    }
    return parsed.select(*[values[name]().cast(kind).alias(name) for name, kind in (c.split(" ") for c in URL_SCHEMA.split(", ")) if columns is None or name in columns])


def build_urls(responses: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of crawl_urls from fetched responses; with columns, pages are parsed and linted for these only."""
    if columns is None:
        return crawl_urls(parse_responses(responses, DETAIL_FIELDS))
    lint = any(c.startswith("lint_") for c in columns)
    reads = {"title_1": ("title",), "title_length_1": ("title",), "meta_description_1": ("description",), "h1_1": ("h1s",), "h1_length_1": ("h1s",), "h1_2": ("h1s",), "h1_length_2": ("h1s",), "meta_robots": ("robots",)}
    named = set(details(F.col("doc"))) & set(columns)
    parts = {p for c in named for p in reads.get(c, (c,))} & set(FIELDS) | ({"has_head"} if named else set())
    parsed = parse_responses(responses, tuple(parts), lint) if parts or lint else responses
    return crawl_urls(parsed, columns)


def with_occurrences(urls: DataFrame) -> DataFrame:
    """Optional: fills the two occurrence counts (how often a title or description stands in its run).

    Counts are reduced before the shuffle and joined back in many tasks, so a title that most pages share is no hot one.
    """
    from auditloom.operators.site_rules import with_counts

    filled = {"title_occurences_1": "title_1", "meta_description_occurrences_1": "meta_description_1"}
    out = with_counts(urls.drop(*filled), {count: F.col(value) for count, value in filled.items()}, "id", ("run_id",)).withColumns({c: F.col(c).cast("int") for c in filled})
    return out.select(*urls.columns)


def write_urls(urls: DataFrame, table: str) -> None:
    """Append to a table partitioned by run."""
    urls.write.mode("append").partitionBy("run_id").saveAsTable(table)


def create_tables(spark) -> None:
    """The crawl_urls and crawl_links tables, emptied if they are there."""
    for name, schema in (("crawl_urls", URL_SCHEMA), ("crawl_links", LINK_SCHEMA)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY (run_id)")
