"""Audit inputs derived from the pages table by arithmetic on page_id, in Spark and in SQL alike.

Raw pages fire a fixed few rules and hold no link graph; the recipe gives them run ids, status codes,
content types, times with ties, and thirteen variants of their markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources.jobs import Folder

TITLE = r"(?s)<title>(.*?)</title>"
HEAD = r"(?s)<head>.*</head>"
H1 = r"(?s)<h1>.*?</h1>"
START = 1704067200  # 2024-01-01
LONG = "word " * 31
IMAGES = '<img src="/a.png" alt="a"><img src="/b.png" alt=""><img src="http://cdn.example.com/c.png#x">'


#: Bytes of stored pages for a task: a stored megabyte may be four of markup, and the variants' markup five times that.
TASK_BYTES = 1 << 20
#: Rows for a task: files store a page that repeats once, as an entry of a dictionary, so stored bytes alone may stay as they are while rows grow.
TASK_ROWS = 2000


def spread(df: DataFrame, path: str) -> DataFrame:
    """A table of fewer splits than there are cores, or than its rows or stored bytes ask for, dealt over so many tasks; others are left as they are, unshuffled.

    A file's row groups are never split, so a table of a few large files has few tasks, which grow with it. Rows are counted without reading a column.
    """
    stored = Folder(df.sparkSession, path)
    size = stored.fs.getContentSummary(stored._path(stored.path)).getLength()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES), -(-df.count() // TASK_ROWS))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/pages.parquet"
    return spread(spark.read.parquet(path).select("page_id", "url", "html"), path)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html) with the markup of page_id % 13."""
    p = pages(spark, sf_dir)
    h, t, v = F.col("html"), F.regexp_extract("html", TITLE, 1), F.col("page_id") % 13
    before = lambda mark, *what: F.replace(h, F.lit(mark), F.concat(*[F.lit(w) if isinstance(w, str) else w for w in what], F.lit(mark)))
    made = (
        F.when(v == 1, before("</head>", '<meta name="description" content="', t, '">'))
        .when(v == 2, before("</head>", f'<meta name="description" content="{LONG}">'))
        .when(v == 3, before("</head>", '<link rel="canonical" href="', F.col("url"), '"><link rel="next nofollow" href="/next"><link rel="prev" href="/prev">'))
        .when(v == 4, before("</head>", '<meta name="robots" content="noindex, nofollow">'))
        .when(v == 5, F.regexp_replace(h, HEAD, ""))
        .when(v == 6, F.regexp_replace(h, TITLE, "<title></title>"))
        .when(v == 7, before("</article>", IMAGES))
        .when(v == 8, before("</article>", "<h1>Second <b>heading</b> &amp; more</h1>"))
        .when(v == 9, before("</article>", F.repeat(F.lit('<a href="/x">x</a>'), 300)))
        .when(v == 10, before("</article>", F.repeat(F.lit('<a href="/x">x</a>'), 1000)))
        .when(v == 11, before("</article>", F.repeat(F.lit("x"), 204800)))
        .when(v == 12, F.regexp_replace(h, H1, ""))
        .otherwise(h)
    )
    return p.select("page_id", "url", made.alias("html"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages, as the ingest operator takes them."""
    n = F.col("page_id")
    c = n % 20
    code = F.when(c == 0, 500).when(c == 1, 503).when(c == 2, 404).when(c == 3, 410).when(c == 4, 0).when(c == 5, 301).otherwise(200)
    kind = F.when(n % 11 == 0, "application/pdf").when(n % 11 == 1, "TEXT/HTML").otherwise("text/html")
    return variants(spark, sf_dir).select(
        n.alias("id"), F.concat(F.lit("run-"), n % 3).alias("run_id"), "url", (n % 7 == 0).cast("int").alias("external"), code.alias("code"), F.lit("reason").alias("reason"), F.col("html").alias("content"),
        F.when(n % 2 == 0, n * 10 - 30).alias("size"), F.lit("utf-8").alias("encoding"), kind.alias("content_type"), F.lit(0.5).cast("float").alias("response_time"), F.timestamp_seconds(F.lit(START) + F.floor(n / 2)).alias("timestamp"),
    )


HREFS = ("/a/b?x=1#top", "", "?q=2", "#part", "sub/page", "//other.example.org/z", "http://abs.example.com/q#f", "mailto:a@b.example", "../up", "HTTP://UP.example.com/")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, href): each page with one of ten references."""
    return pages(spark, sf_dir).select("page_id", "url", F.get(F.array(*map(F.lit, HREFS)), (F.col("page_id") % len(HREFS)).cast("int")).alias("href"))


def robots_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    parts = [F.when(n % 4 != 0, F.concat(F.lit("Sitemap: "), "url", F.lit("\n"))).otherwise(""), F.when(n % 3 != 0, "Disallow: /search\nDisallow: /x\n").otherwise("Disallow:\n"), F.when(n % 5 != 0, "User-agent: *\n").otherwise("user-agent: *\n")]
    return pages(spark, sf_dir).select("page_id", F.concat(*parts).alias("txt"))


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, u = F.col("page_id"), F.col("url")
    one = F.concat(F.lit("<url><loc>"), u, F.lit("</loc>"), F.when(n % 2 == 0, "<priority>0.5</priority>").otherwise("<priority></priority>"), F.when(n % 3 == 0, "<lastmod>2024-01-01</lastmod>").otherwise(""), F.when(n % 5 == 0, "<changefreq>daily</changefreq>").otherwise(""), F.lit("</url>"))
    xml = F.when(n % 6 == 0, F.concat(F.lit("<sitemapindex><sitemap><loc>"), u, F.lit("</loc></sitemap></sitemapindex>"))).when(n % 6 == 1, "<urlset></urlset>").when(n % 6 == 2, "<nothing/>").otherwise(F.concat(F.lit("<urlset>"), F.repeat(one, F.when(n % 30 == 3, 10000).otherwise(2).cast("int")), F.lit("</urlset>")))
    return pages(spark, sf_dir).select("page_id", xml.alias("xml"))


def link_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web whose page n links to pages 2n+1 and 2n+2, to itself, to a mailto, to one external URL, and to 2n+1 again."""
    p = pages(spark, sf_dir).select("page_id")
    at = lambda k: F.concat(F.lit("http://site.example.com/p"), k)
    n = F.col("page_id")
    link = lambda k, t: F.concat(F.lit('<a href="'), k, F.lit(f'">{t}</a>'))
    body = F.concat(F.lit("<html><head><title>page "), n, F.lit("</title></head><body><h1>page</h1>"), link(at(2 * n + 1), "left"), link(at(2 * n + 2), "right"), link(at(n), "self"), link(F.lit("mailto:x@y.example"), "mail"), link(F.concat(F.lit("http://out.example.org/"), n % 5), "out"), link(at(2 * n + 1), "again"), F.lit('<img src="http://cdn.example.net/logo.png" alt="logo"></body></html>'))
    return p.select(at(n).alias("url"), F.lit(200).alias("code"), F.lit("OK").alias("reason"), body.alias("content"), F.lit("text/html").alias("content_type"), F.lit(None).cast("bigint").alias("size"), F.lit("utf-8").alias("encoding"), F.lit(0.1).cast("float").alias("response_time"))


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _before(mark: str, what: str) -> str:
    return f"replace(html, {q(mark)}, {what} || {q(mark)})"


VARIANTS_SQL = f"""base AS (SELECT page_id, url, html, page_id % 13 AS v, regexp_extract(html, {q(TITLE)}, 1) AS t0 FROM pages),
variants AS (SELECT page_id, url, CASE v
 WHEN 1 THEN {_before("</head>", q('<meta name="description" content="') + " || t0 || " + q('">'))}
 WHEN 2 THEN {_before("</head>", q(f'<meta name="description" content="{LONG}">'))}
 WHEN 3 THEN {_before("</head>", q('<link rel="canonical" href="') + " || url || " + q('"><link rel="next nofollow" href="/next"><link rel="prev" href="/prev">'))}
 WHEN 4 THEN {_before("</head>", q('<meta name="robots" content="noindex, nofollow">'))}
 WHEN 5 THEN regexp_replace(html, {q(HEAD)}, '', 'g')
 WHEN 6 THEN regexp_replace(html, {q(TITLE)}, '<title></title>', 'g')
 WHEN 7 THEN {_before("</article>", q(IMAGES))}
 WHEN 8 THEN {_before("</article>", q("<h1>Second <b>heading</b> &amp; more</h1>"))}
 WHEN 9 THEN {_before("</article>", "repeat(" + q('<a href="/x">x</a>') + ", 300)")}
 WHEN 10 THEN {_before("</article>", "repeat(" + q('<a href="/x">x</a>') + ", 1000)")}
 WHEN 11 THEN {_before("</article>", "repeat('x', 204800)")}
 WHEN 12 THEN regexp_replace(html, {q(H1)}, '', 'g')
 ELSE html END AS html FROM base)"""

RESPONSES_SQL = f"""{VARIANTS_SQL},
web AS (SELECT page_id AS id, 'run-' || (page_id % 3) AS run_id, url, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS external,
 CASE page_id % 20 WHEN 0 THEN 500 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 410 WHEN 4 THEN 0 WHEN 5 THEN 301 ELSE 200 END AS code, html AS content,
 CASE WHEN page_id % 2 = 0 THEN page_id * 10 - 30 END AS size, CASE page_id % 11 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'TEXT/HTML' ELSE 'text/html' END AS content_type,
 {START} + page_id // 2 AS ts FROM variants)"""
