"""Command lines: python -m auditloom.cli crawl | lint | report."""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENT = "auditloom"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="auditloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    c = commands.add_parser("crawl", help="crawl URLs into crawl_urls and crawl_links")
    source = c.add_mutually_exclusive_group(required=True)
    source.add_argument("-f", "--file", help="a file with a URL a line")
    source.add_argument("-u", "--base-url", help="one URL to begin with")
    source.add_argument("-y", "--yaml", help="a YAML file with a list of URLs")
    source.add_argument("-r", "--run-id", help="a stopped run to go on with")
    c.add_argument("--yaml-key", default="urls", help="where the YAML file holds its list")
    c.add_argument("-i", "--internal", action="store_true", help="follow links within the site")
    c.add_argument("-l", "--limit", type=int, default=0, help="queue no more once so many URLs are queued")
    c.add_argument("--user-agent", default=AGENT)
    c.add_argument("--delay", type=int, default=0, help="milliseconds between requests to a host")
    c.add_argument("--rounds", type=int, help="stop after so many rounds; the job can be gone on with")
    c.add_argument("--web", help="a folder of stored responses instead of the network")
    c.add_argument("--jobs", default="jobs", help="the folder of crawls that go on: each holds its rounds and commits; all executors must see it")
    c.add_argument("--urls", default="crawl_urls", help="a table, or the folder of one, that a round's rows are stored in, by run and round")
    c.add_argument("--links", default="crawl_links")
    c.add_argument("-o", "--output", help="write the build report as JUnit XML to this file")

    n = commands.add_parser("lint", help="lint one HTML page, sitemap or robots file; exit status 1 for errors")
    n.add_argument("path", nargs="?", help="the file; standard input without")
    n.add_argument("-f", "--format", choices=("auto", "html", "xml", "txt"), default="auto")

    r = commands.add_parser("report", help="a report of a run")
    r.add_argument("-r", "--run-id", help="the run; the latest without")
    r.add_argument("-t", "--type", choices=("build", "status_code", "all"), default="build")
    r.add_argument("-f", "--format", choices=("junit", "csv", "xls", "sql", "html_files"), default="junit")
    r.add_argument("--urls", default="crawl_urls", help="a table, a Parquet folder, or jdbc:...")
    r.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="an option of a jdbc source; AUDITLOOM_DB_USER and the like give some by the environment")
    r.add_argument("--option-file", help="a file of such options, one a line")
    r.add_argument("-o", "--output", help="the file, or the folder of html_files; standard output without")
    return top


def crawl(spark: SparkSession, a: argparse.Namespace) -> int:
    from auditloom.operators import render, reports
    from auditloom.operators.crawl import crawl as run
    from auditloom.sources import seeds
    from auditloom.sources.fetch import fetch
    from auditloom.sources.jobs import Job, Stored

    web = spark.read.parquet(a.web) if a.web else lambda urls, full: fetch(urls, a.user_agent, full, a.delay)
    run_id = a.run_id or str(uuid.uuid4())
    job = f"{a.jobs}/{run_id}"
    start = None
    if a.file:
        start = seeds.url_file(spark, a.file)
    elif not a.run_id:
        start = seeds.seed(spark, a.base_url) if a.base_url else seeds.yaml_urls(spark, a.yaml, a.yaml_key)
    urls, links = Stored(spark, a.urls), Stored(spark, a.links)

    def sink(number: int, pages: DataFrame | None, edges: DataFrame) -> None:
        if pages is not None:
            urls.put(pages.drop("depth"), run_id, number)
        links.put(edges, run_id, number)

    def discard(number: int) -> None:
        urls.discard(run_id, number)
        links.discard(run_id, number)

    found = run(spark, start, web, job, a.internal, a.limit, run_id, max_rounds=a.rounds, sink=sink, discard=discard)
    if found.frontier.isEmpty():
        Job(spark, job).delete()
    if a.output:
        render.write_report(render.report_pieces(reports.stored_urls(spark, a.urls, found.run_id), "build", "junit", found.run_id), a.output)
    print(found.run_id)
    return 0


def lint(spark: SparkSession, a: argparse.Namespace) -> int:
    from auditloom.operators import lint as L

    if a.path:
        with open(a.path, encoding="utf-8", errors="replace") as f:
            text = f.read()
    else:
        text = sys.stdin.read()
    one = spark.createDataFrame([(text, "")], "text string, url string")
    form = one.select(L.sniff(F.col("text"))).first()[0] if a.format == "auto" else a.format
    if form == "html":
        found = L.lint_pages(one, "text")
    else:
        value = L.sitemap_results(L.sitemap(F.col("text"))) if form == "xml" else L.robots_results(L.robots(F.col("text")))
        found = one.withColumn("lint", value)
    status = 0
    for r in L.printed(found).orderBy("rule_ord").collect():  # a row for each rule at most
        print(r["line"])
        if r["found"]:
            print(f"\t{r['found']}")
        status |= int(r["failed"])
    return status


def report(spark: SparkSession, a: argparse.Namespace) -> int:
    from auditloom.operators import render, reports
    from auditloom.sources.database import settings

    options = settings(dict(x.split("=", 1) for x in a.option), a.option_file) if a.urls.startswith("jdbc:") else {}
    run_id = a.run_id or (reports.latest_run(reports.stored_urls(spark, a.urls, **options)).first() or [None])[0]
    if run_id is None:
        print("there is no run", file=sys.stderr)
        return 1
    if a.format == "html_files":
        if not a.output:
            print("html_files need a folder (-o)", file=sys.stderr)
            return 1
        render.write_html_files(reports.stored_urls(spark, a.urls, run_id, **options), a.output)
        print("Done.")
        return 0
    render.write_report(render.report_pieces(reports.stored_urls(spark, a.urls, run_id, **options), a.type, a.format, run_id), a.output)
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if spark is None:
        from auditloom.session import local_session

        spark = SparkSession.getActiveSession() or local_session(name="auditloom")
    return {"crawl": crawl, "lint": lint, "report": report}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
