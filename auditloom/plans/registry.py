"""Registry of the audit queries and their SQL counterparts.

Timestamps are reported as epoch seconds and array columns as joined text, so both engines print alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions import html as H
from auditloom.functions import sql as sql_functions
from auditloom.functions import urls as U
from auditloom.functions.keywords import STOP_WORDS, keywords, match_count
from auditloom.operators import crawl as C
from auditloom.operators import ingest, lint, render, reports, site_rules
from auditloom.plans import fixtures as X
from auditloom.plans.fixtures import q
from auditloom.session import shared_dir
from auditloom.sources import sitemaps
from auditloom.sources.jobs import Stored

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# ---- SQL counterparts of the column functions ------------------------------------------------
# These have patterns of their own, plain ones that suffice for the fixtures' markup; tests/test_html.py holds the
# parse against the standard library's parser.

ENTITIES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;?", "\u00a0"), ("&copy;?", "\u00a9"), ("&middot;?", "\u00b7"), ("&amp;?", "&"))
S_HEAD, S_LEADING = r"(?i)<head[\s>]", r"(?is)^\s*(?:<!doctype[^>]*>)?\s*(?:<html[^>]*>)?\s*<(?:title|meta|link|base|style|script)\b"


def s_tag(name: str) -> str:
    return rf"(?is)<(?:{name})\b(?:[^>\"']+|\"[^\"]*\"|'[^']*')*>"


def s_attribute(name: str) -> str:
    return rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def s_decode(c: str) -> str:
    for pattern, to in ENTITIES:
        c = f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"
    return c


def s_attr(tag: str, name: str) -> str:
    p = q(s_attribute(name))
    return f"CASE WHEN regexp_matches({tag}, {p}) THEN {s_decode(' || '.join(f'regexp_extract({tag}, {p}, {k})' for k in (1, 2, 3)))} END"


def s_tags(c: str, name: str) -> str:
    return f"regexp_extract_all({c}, {q(s_tag(name))}, 0)"


def s_keywords(c: str) -> str:
    stop = ", ".join(map(q, STOP_WORDS))
    return f"list_transform(list_filter(string_split_regex(regexp_replace(coalesce({c}, 'None'), {q(chr(91) + '^A-Za-z0-9' + chr(92) + '-' + chr(39) + chr(93))}, ' ', 'g'), ' +'), lambda w: length(w) >= 3 AND NOT list_contains([{stop}], w)), lambda w: lower(w))"


def s_match(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform({a}, lambda x: len(list_filter({b}, lambda y: y = x)))), 0)::BIGINT"


def s_netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def s_full(u: str) -> str:
    return f"regexp_matches({u}, {q(U.FULL_URL)})"


def s_clean(c: str) -> str:
    c = f"regexp_replace({c}, '(?s)<!--.*?-->', '', 'g')"
    for name in ("script", "style"):
        c = f"regexp_replace({c}, {q(f'(?is)(<{name}{chr(92)}b[^>]*>).*?(</{name}>)')}, '\\1\\2', 'g')"
    return c


def s_parsed(source: str, html: str = "html", keep: str = "page_id, url") -> str:
    """CTEs that end in ``parsed``."""
    named = lambda n: f"list_filter(metas, lambda t: coalesce(({s_attr('t', 'name')}) = {q(n)}, false))[1]"
    linked = lambda n: f"list_filter(rels, lambda t: coalesce(list_contains(string_split_regex({s_attr('t', 'rel')}, '\\s+'), {q(n)}), false))[1]"
    head_end = q(r"(?is)(?:</head>|<body\b).*\z")
    return f"""s0 AS (SELECT {keep}, length({html}) AS size, {s_clean(html)} AS c FROM {source}),
s1 AS (SELECT *, regexp_matches(c, {q(S_HEAD)}) OR regexp_matches(c, {q(S_LEADING)}) AS has_head, regexp_replace(c, {head_end}, '') AS h FROM s0),
s2 AS (SELECT *, CASE WHEN has_head THEN {s_tags('h', 'meta')} ELSE [] END AS metas, CASE WHEN has_head THEN {s_tags('h', 'link')} ELSE [] END AS rels, regexp_extract_all(c, {q(chr(40) + '?is)<h1' + chr(92) + 'b[^>]*>(.*?)(?:</h1>|' + chr(92) + 'z)')}, 1) AS h1,
 len({s_tags('c', 'a')}) AS link_count, {s_tags('c', 'img')} AS imgs,
 CASE WHEN regexp_matches(c, '(?i)<title\\b[^>]*>') THEN {s_decode("regexp_extract(c, '(?is)<title\\b[^>]*>(.*?)(?:</title>|\\z)', 1)")} ELSE 'None' END AS title FROM s1),
s3 AS (SELECT *, {named('description')} AS desc_tag, {named('robots')} AS robots_tag, {linked('canonical')} AS canon_tag, {linked('next')} AS next_tag, {linked('prev')} AS prev_tag,
 list_transform(h1, lambda x: {s_decode("regexp_replace(x, '(?s)<[^>]*>', '', 'g')")}) AS h1s FROM s2),
s4 AS (SELECT *, {s_attr('desc_tag', 'content')} AS description, {s_attr('robots_tag', 'content')} AS robots, {s_attr('canon_tag', 'href')} AS canonical, {s_attr('next_tag', 'href')} AS rel_next, {s_attr('prev_tag', 'href')} AS rel_prev,
 len(h1) AS h1_count, len(list_filter(imgs, lambda t: coalesce({s_attr('t', 'alt')}, '') = '')) AS img_no_alt FROM s3),
parsed AS (SELECT *, {s_keywords('title')} AS tk, CASE WHEN h1_count > 0 THEN {s_keywords('h1s[1]')} ELSE [] END AS hk, CASE WHEN desc_tag IS NOT NULL THEN {s_keywords("coalesce(description, 'None')")} ELSE [] END AS dk FROM s4)"""


#: rule -> (condition, number, text) over ``parsed``, all but C22 for documents with a head.
RULES_SQL = {
    "C22": ("NOT has_head", "NULL", "NULL"), "E02": ("title = ''", "NULL", "NULL"), "W03": ("length(title) > 58", "NULL", "NULL"), "E05": ("desc_tag IS NULL", "NULL", "NULL"),
    "W06": ("desc_tag IS NOT NULL AND length(coalesce(description, '')) > 150", "NULL", "NULL"), "E08": ("canon_tag IS NULL", "NULL", "NULL"), "E09": ("h1_count = 0", "NULL", "NULL"), "I10": ("next_tag IS NULL", "NULL", "NULL"),
    "I11": ("prev_tag IS NULL", "NULL", "NULL"), "W16": ("link_count >= 300", "link_count", "NULL"), "E17": ("link_count >= 1000", "link_count", "NULL"), "E18": ("size >= 204800", "size", "NULL"),
    "I20": ("contains(coalesce(robots, ''), 'nofollow')", "NULL", "robots"), "I21": ("contains(coalesce(robots, ''), 'noindex')", "NULL", "robots"), "W23": ("h1_count >= 1", "h1_count", "NULL"),
    "E12": ("m1 < 1", "m1", "NULL"), "E13": ("m2 < 1", "m2", "NULL"), "W14": ("m1 < 3", "m1", "NULL"), "W15": ("m2 < 3", "m2", "NULL"), "W19": ("img_no_alt > 0", "img_no_alt", "NULL"),
}


def s_lint(keep: str = "page_id") -> str:
    """CTE ``lint`` over ``parsed``: a row for each rule that fires."""
    level = {k: v for k, v in lint.LEVELS.items()}
    parts = [f"SELECT {keep}, {q(r)} AS rule, {q(level[r[0]][0])} AS level, {level[r[0]][1]} AS level_no, ({n})::BIGINT AS int_value, ({t})::VARCHAR AS str_value FROM matched WHERE {'' if r == 'C22' else 'has_head AND '}{cond}" for r, (cond, n, t) in RULES_SQL.items()]
    return f"matched AS (SELECT *, {s_match('tk', 'hk')} AS m1, {s_match('tk', 'dk')} AS m2 FROM parsed), lint AS ({' UNION ALL '.join(parts)})"


PARSED = f"WITH {X.VARIANTS_SQL}, {s_parsed('variants')}"
LINT = f"{PARSED}, {s_lint()}"


def parsed(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return H.parse(X.variants(spark, sf_dir), parts=parts)


def linted(spark: SparkSession, sf_dir: str, *rules: str) -> DataFrame:
    return lint.lint_pages(X.variants(spark, sf_dir), rules=rules or lint.HTML_RULES)


def results(spark: SparkSession, sf_dir: str, *rules: str) -> DataFrame:
    return linted(spark, sf_dir, *rules).select("page_id", F.explode("lint").alias("r")).select("page_id", "r.*")


# ---- URLs ------------------------------------------------------------------------------------

_REFS = f"WITH refs AS (SELECT page_id, url, [{', '.join(map(q, X.HREFS))}][page_id % {len(X.HREFS)} + 1] AS href FROM pages)"


@query("url_is_full", f"{_REFS} SELECT page_id, href, {s_full('href')} AS is_full, {s_full('url')} AS page_is_full FROM refs")
def url_is_full(spark, sf_dir):
    return X.refs(spark, sf_dir).select("page_id", "href", U.is_full_url(F.col("href")).alias("is_full"), U.is_full_url(F.col("url")).alias("page_is_full"))


@query("url_netloc", f"SELECT page_id, {s_netloc('url')} AS netloc FROM pages")
def url_netloc(spark, sf_dir):
    return X.pages(spark, sf_dir).select("page_id", U.netloc(F.col("url")).alias("netloc"))


@query("url_path", f"SELECT page_id, string_split(url, {s_netloc('url')})[-1] AS path FROM pages")
def url_path(spark, sf_dir):
    return X.pages(spark, sf_dir).select("page_id", U.path(F.col("url")).alias("path"))


_INSIDE = "(NOT {f} OR {a} = {b} OR ends_with({a}, {b}) OR ends_with({b}, {a}))"


@query("url_internal", f"{_REFS} SELECT page_id, {_INSIDE.format(f=s_full('href'), a=s_netloc('href'), b=s_netloc('url'))} AS internal FROM refs")
def url_internal(spark, sf_dir):
    return X.refs(spark, sf_dir).select("page_id", U.same_site(F.col("href"), F.col("url")).alias("internal"))


_SITE, _BPATH, _DIR = r"regexp_extract(url, '^[a-z]+://[^/?#]*')", r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)", r"regexp_extract(url, '^[a-z]+://[^/?#]*((?:[^?#]*/)?)', 1)"


@query("url_resolve", f"""{_REFS} SELECT page_id, href, CASE page_id % 10 WHEN 0 THEN {_SITE} || '/a/b?x=1' WHEN 1 THEN regexp_extract(url, '^[^#]*') WHEN 2 THEN {_SITE} || {_BPATH} || '?q=2' WHEN 3 THEN regexp_extract(url, '^[^#]*')
 WHEN 4 THEN {_SITE} || CASE WHEN {_DIR} = '' THEN '/' ELSE {_DIR} END || 'sub/page' WHEN 5 THEN regexp_extract(url, '^[a-z]+') || '://other.example.org/z' WHEN 6 THEN 'http://abs.example.com/q' WHEN 7 THEN 'mailto:a@b.example'
 WHEN 8 THEN {_SITE} || CASE WHEN {_DIR} IN ('', '/') THEN '/../up' ELSE regexp_replace({_DIR}, '[^/]+/$', '') || 'up' END
 WHEN 9 THEN CASE WHEN starts_with(url, 'http:') THEN 'http://UP.example.com/' ELSE 'HTTP://UP.example.com/' END END AS resolved FROM refs""")  # fmt: skip
def url_resolve(spark, sf_dir):
    return X.refs(spark, sf_dir).select("page_id", "href", U.resolve(F.col("href"), F.col("url")).alias("resolved"))


# ---- extraction ------------------------------------------------------------------------------

_ON = "CASE WHEN has_head THEN {} END"
_DETAILS = {
    "title": _ON.format("title"), "title_length": _ON.format("length(title)::BIGINT"), "description": _ON.format("description"), "canonical": _ON.format("canonical"), "rel_next": _ON.format("rel_next"), "rel_prev": _ON.format("rel_prev"),
    "robots": _ON.format("robots"), "h1_1": _ON.format("h1s[1]"), "h1_2": _ON.format("h1s[2]"), "h1_count": _ON.format("h1_count::BIGINT"),
}


@query("page_details", f"{PARSED} SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _DETAILS.items())} FROM parsed")
def page_details(spark, sf_dir):
    got = ingest.details(F.col("doc"))
    kept = {"title": "title_1", "title_length": "title_length_1", "description": "meta_description_1", "canonical": "canonical", "rel_next": "rel_next", "rel_prev": "rel_prev", "robots": "meta_robots", "h1_1": "h1_1", "h1_2": "h1_2", "h1_count": "h1_count"}
    long = ("title_length", "h1_count")
    return parsed(spark, sf_dir, *ingest.DETAIL_FIELDS).select("page_id", *[(got[v]().cast("bigint") if k in long else got[v]()).alias(k) for k, v in kept.items()])


@query("page_links", rf"""WITH a AS (SELECT page_id, url, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS t FROM (SELECT page_id, url, regexp_extract_all({s_clean('html')}, {q(r"(?is)<a\b(?:[^>\"']+|\"[^\"]*\"|'[^']*')*>.*?(?:</a>|\z)")}, 0) AS m FROM pages))
SELECT page_id, pos::BIGINT AS pos, {_SITE} || {s_attr('t', 'href')} AS link, {s_decode("regexp_replace(t, '(?s)<[^>]*>', '', 'g')")} AS text FROM a""")  # fmt: skip
def page_links(spark, sf_dir):
    return H.parse(X.pages(spark, sf_dir), parts=("links",)).select("page_id", F.posexplode("doc.links").alias("pos", "x")).select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("x.url").alias("link"), F.col("x.text").alias("text"))


@query("page_links_sql", ORACLES["page_links"])
def page_links_sql(spark, sf_dir):
    X.pages(spark, sf_dir).createOrReplaceTempView("audited_pages")
    return sql_functions.page_links(spark, "audited_pages")


_RAW = f"trim(coalesce(nullif(({s_attr('t', 'src')}), ''), ({s_attr('t', 'href')}), ''))"


@query("page_sources", f"""{PARSED}, held AS (SELECT page_id, url, unnest({s_tags('c', 'img|link|script|style|meta')}) AS t FROM parsed),
raw AS (SELECT page_id, url, {_RAW} AS r, {s_attr('t', 'alt')} AS alt FROM held) SELECT page_id, CASE WHEN {s_full('r')} THEN r ELSE {_SITE} || r END AS source, alt FROM raw WHERE r <> ''""")  # fmt: skip
def page_sources(spark, sf_dir):
    return parsed(spark, sf_dir, "sources").select("page_id", F.explode("doc.sources").alias("x")).select("page_id", F.col("x.url").alias("source"), F.col("x.alt").alias("alt"))


@query("page_h1", f"{PARSED} SELECT page_id, i::BIGINT AS pos, h1s[i] AS h1 FROM (SELECT page_id, h1s, unnest(range(1, len(h1s) + 1)) AS i FROM parsed)")
def page_h1(spark, sf_dir):
    return parsed(spark, sf_dir, "h1s").select("page_id", F.posexplode("doc.h1s").alias("p", "h1")).select("page_id", (F.col("p") + 1).cast("bigint").alias("pos"), "h1")


_COUNTED = ("link_count", "img_count", "img_no_alt")


@query("link_counts", f"{PARSED} SELECT page_id, link_count::BIGINT AS link_count, len(imgs)::BIGINT AS img_count, img_no_alt::BIGINT AS img_no_alt FROM parsed")
def link_counts(spark, sf_dir):
    return parsed(spark, sf_dir, *_COUNTED).select("page_id", *[F.col(f"doc.{c}").cast("bigint").alias(c) for c in _COUNTED])


_KEYWORDS = ("title_keywords", "h1_keywords", "description_keywords")


@query("keywords_title", f"{PARSED} SELECT page_id, array_to_string(tk, ' ') AS title_keywords, array_to_string(hk, ' ') AS h1_keywords, array_to_string(dk, ' ') AS description_keywords FROM parsed")
def keywords_title(spark, sf_dir):
    return parsed(spark, sf_dir, *_KEYWORDS).select("page_id", *[F.array_join(f"doc.{c}", " ").alias(c) for c in _KEYWORDS])


@query("keywords_documents", f"SELECT doc_id, len(k)::BIGINT AS n_keywords, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {s_keywords('text')} AS k FROM documents)")
def keywords_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", keywords(F.col("text")).alias("k")).select("doc_id", F.size("k").cast("bigint").alias("n_keywords"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("keyword_match", f"{PARSED} SELECT page_id, {s_match('tk', 'hk')} AS title_h1, {s_match('tk', 'dk')} AS title_description FROM parsed")
def keyword_match(spark, sf_dir):
    return parsed(spark, sf_dir, *_KEYWORDS).select("page_id", match_count(F.col("doc.title_keywords"), F.col("doc.h1_keywords")).cast("bigint").alias("title_h1"), match_count(F.col("doc.title_keywords"), F.col("doc.description_keywords")).cast("bigint").alias("title_description"))


# ---- lint ------------------------------------------------------------------------------------


def _one_rule(rule: str):
    def run(spark, sf_dir):
        return results(spark, sf_dir, rule).select("page_id", "rule", "int_value", "str_value")

    query(f"lint_{rule.lower()}", f"{LINT} SELECT page_id, rule, int_value, str_value FROM lint WHERE rule = {q(rule)}")(run)


for _rule in lint.HTML_RULES:
    _one_rule(_rule)


@query("lint_all_long", f"{LINT} SELECT page_id, rule, level, level_no::BIGINT AS level_no, int_value, str_value FROM lint")
def lint_all_long(spark, sf_dir):
    return results(spark, sf_dir).select("page_id", "rule", "level", F.col("level_no").cast("bigint").alias("level_no"), "int_value", "str_value")


_COUNT = "count(*) FILTER (WHERE starts_with(rule, '{}'))"
_COUNTS = ", ".join(f"{_COUNT.format(k)} AS {v}" for k, v in (("C", "critical"), ("E", "error"), ("W", "warn"), ("I", "info")))


@query("lint_level_counts", f"{LINT} SELECT page_id, {_COUNTS} FROM lint GROUP BY page_id")
def lint_level_counts(spark, sf_dir):
    return linted(spark, sf_dir).select("page_id", *[lint.level_count(F.col("lint"), k).cast("bigint").alias(v) for k, v in (("C", "critical"), ("E", "error"), ("W", "warn"), ("I", "info"))])


@query("lint_totals", f"{LINT} SELECT rule, count(*) AS n FROM lint GROUP BY rule")
def lint_totals(spark, sf_dir):
    return results(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"))


@query("lint_min_level", f"{LINT} SELECT page_id, rule FROM lint WHERE level_no <= 1")
def lint_min_level(spark, sf_dir):
    return linted(spark, sf_dir).select("page_id", F.explode(lint.at_level(F.col("lint"), 1)).alias("r")).select("page_id", "r.rule")


_LABELS = ", ".join(f"({i}, {q(r)}, {q(t)})" for i, (r, t) in enumerate(lint.CATALOGUE))


@query("lint_printed", f"{LINT} SELECT page_id, rule_ord::BIGINT AS rule_ord, rule || ': ' || label || ' (' || level || ')' AS line, 'found: ' || coalesce(CASE WHEN int_value <> 1 THEN int_value::VARCHAR END, str_value) AS found, level_no <= 1 AS failed FROM lint JOIN (VALUES {_LABELS}) AS r(rule_ord, rule_id, label) ON rule = rule_id")
def lint_printed(spark, sf_dir):
    return lint.printed(linted(spark, sf_dir), keys=("page_id",)).withColumn("rule_ord", F.col("rule_ord").cast("bigint"))


@query("lint_exit_status", f"{LINT} SELECT page_id, max(CASE WHEN level_no <= 1 AND rule <> 'E18' THEN 1 ELSE 0 END)::BIGINT AS exit_status FROM lint GROUP BY page_id")
def lint_exit_status(spark, sf_dir):
    return linted(spark, sf_dir).select("page_id", F.coalesce(F.exists("lint", lambda r: (r["level_no"] <= 1) & (r["rule"] != "E18")).cast("bigint"), F.lit(0)).alias("exit_status"))


@query("rules_catalogue", f"""{LINT}, c AS (SELECT rule, count(*) AS n FROM lint GROUP BY rule)
SELECT rule_ord::BIGINT AS rule_ord, r.rule, label, coalesce(n, 0)::BIGINT AS pages FROM (VALUES {_LABELS}) AS r(rule_ord, rule, label) LEFT JOIN c ON c.rule = r.rule""")
def rules_catalogue(spark, sf_dir):
    """Every declared rule, with the number of pages that it fires on."""
    counts = results(spark, sf_dir).groupBy(F.col("rule").alias("_rule")).agg(F.count("*").alias("pages"))
    rules = lint.catalogue(spark).where("declared")
    return rules.join(counts, F.col("rule") == F.col("_rule"), "left").select(F.col("rule_ord").cast("bigint").alias("rule_ord"), "rule", "label", F.coalesce("pages", F.lit(0)).alias("pages"))


_SITE_RULE = "SELECT page_id, '{r}' AS rule, 'warning' AS level, count(*) OVER (PARTITION BY site, {c}) AS n FROM heads WHERE {c} <> ''"


@query("lint_site_rules", f"""{PARSED}, heads AS (SELECT page_id, {s_netloc('url')} AS site, title, description FROM parsed WHERE has_head),
bytes AS (SELECT page_id, encode(html) || CASE WHEN page_id % 17 = 0 THEN '\\xC3'::BLOB ELSE ''::BLOB END AS b FROM variants)
SELECT page_id, rule, level, n::BIGINT AS int_value FROM ({_SITE_RULE.format(r='W04', c='title')} UNION ALL {_SITE_RULE.format(r='W07', c='description')}) WHERE n > 1
UNION ALL SELECT page_id, 'E01', 'error', NULL::BIGINT FROM bytes WHERE TRY(decode(b)) IS NULL""")
def lint_site_rules(spark, sf_dir):
    """Titles and descriptions that pages of a host share, and pages whose bytes (of every seventeenth, with half a character behind) are no UTF-8."""
    pages = X.variants(spark, sf_dir).withColumn("site", U.netloc(F.col("url"))).withColumn("bytes", F.concat(F.encode("html", "UTF-8"), F.when(F.col("page_id") % 17 == 0, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))))
    parsed_ = H.parse(pages, parts=("has_head", "title", "description")).drop("html")
    found = site_rules.with_site_rules(parsed_, "page_id", ("site",), "bytes")
    return found.select("page_id", F.explode("lint").alias("r")).select("page_id", "r.rule", "r.level", "r.int_value")


@query("lint_sitemap", """WITH k AS (SELECT page_id, page_id % 6 AS v, CASE WHEN page_id % 6 IN (0) THEN 1 WHEN page_id % 6 IN (1, 2) THEN 0 WHEN page_id % 30 = 3 THEN 10000 ELSE 2 END AS n FROM pages)
SELECT page_id, 'C26' AS rule FROM k WHERE v = 2 UNION ALL SELECT page_id, 'C27' FROM k WHERE v = 1 UNION ALL SELECT page_id, 'E33' FROM k WHERE n >= 10000
UNION ALL SELECT page_id, 'I30' FROM k WHERE v > 2 AND page_id % 2 = 0 UNION ALL SELECT page_id, 'I31' FROM k WHERE v > 2 AND page_id % 5 = 0 UNION ALL SELECT page_id, 'I32' FROM k WHERE v > 2 AND page_id % 3 = 0""")  # fmt: skip
def lint_sitemap(spark, sf_dir):
    return X.sitemaps(spark, sf_dir).select("page_id", F.explode(F.array(lint.sitemap(F.col("xml")))).alias("s")).select("page_id", F.explode(lint.sitemap_results(F.col("s"))).alias("r")).select("page_id", "r.rule")


@query("sitemap_entries", "SELECT page_id, count(*) AS n, url AS loc FROM (SELECT page_id, url, unnest(range(CASE WHEN page_id % 6 = 0 THEN 1 WHEN page_id % 30 = 3 THEN 10000 ELSE 2 END)) FROM pages WHERE page_id % 6 NOT IN (1, 2)) GROUP BY page_id, url")
def sitemap_entries(spark, sf_dir):
    return X.sitemaps(spark, sf_dir).select("page_id", F.explode(F.array(lint.sitemap(F.col("xml"), ("loc",)))).alias("s")).select("page_id", F.explode("s.entries").alias("e")).groupBy("page_id", F.col("e.loc").alias("loc")).agg(F.count("*").alias("n"))


_ROBOTS = "WITH r AS (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN 'Sitemap: ' || url || chr(10) ELSE '' END || CASE WHEN page_id % 3 <> 0 THEN 'Disallow: /search' || chr(10) || 'Disallow: /x' || chr(10) ELSE 'Disallow:' || chr(10) END || CASE WHEN page_id % 5 <> 0 THEN 'User-agent: *' || chr(10) ELSE 'user-agent: *' || chr(10) END AS txt FROM pages), k AS (SELECT page_id, regexp_extract_all(txt, 'Sitemap:\\s+([^\\n]+)', 1) AS s, regexp_extract_all(txt, 'Disallow:\\s+([^\\n]+)', 1) AS d, regexp_extract_all(txt, 'User-agent:\\s+([^\\n]+)', 1) AS u FROM r)"


@query("robots_parse", f"{_ROBOTS} SELECT page_id, array_to_string(s, '|') AS sitemap, array_to_string(d, '|') AS disallow, array_to_string(u, '|') AS user_agent FROM k")
def robots_parse(spark, sf_dir):
    return X.robots_texts(spark, sf_dir).withColumn("r", lint.robots(F.col("txt"))).select("page_id", *[F.array_join(f"r.{c}", "|").alias(c) for c in ("sitemap", "disallow", "user_agent")])


@query("sitemap_files", """WITH k AS (SELECT page_id % 3 AS file, count(*) AS n, count(*) FILTER (WHERE page_id % 2 = 0) AS p, count(*) FILTER (WHERE page_id % 5 = 0) AS c, count(*) FILTER (WHERE page_id % 7 = 0) AS l FROM pages GROUP BY 1)
SELECT file::BIGINT AS file, n, r AS rule FROM (SELECT file, n, unnest([CASE WHEN n >= 10000 THEN 'E33' END, CASE WHEN p > 0 THEN 'I30' END, CASE WHEN c > 0 THEN 'I31' END, CASE WHEN l > 0 THEN 'I32' END]) AS r FROM k) WHERE r IS NOT NULL""")
def sitemap_files(spark, sf_dir):
    """The rules of three sitemap files that hold all pages, written and read an entry a row."""
    n = F.col("page_id")
    has = lambda k, tag, value: F.when(n % k == 0, f"<{tag}>{value}</{tag}>").otherwise("")
    line = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), has(2, "priority", "0.5"), has(5, "changefreq", "daily"), has(7, "lastmod", "2024-01-01"), F.lit("</url>"))
    folder = f"{shared_dir(spark)}/sitemaps-{uuid.uuid4().hex}"
    X.pages(spark, sf_dir).select((n % 3).alias("map"), line.alias("value")).write.partitionBy("map").text(folder)
    rows = sitemaps.entries(spark, f"{folder}/*").withColumn("file", F.regexp_extract("file", "map=([0-9]+)", 1).cast("bigint"))
    return sitemaps.rules(rows)


@query("lint_robots", f"{_ROBOTS} SELECT page_id, 'C23' AS rule FROM k WHERE len(s) = 0 UNION ALL SELECT page_id, 'I24' FROM k WHERE len(s) > 0 AND len(d) = 0 UNION ALL SELECT page_id, 'I25' FROM k WHERE len(s) > 0 AND len(u) = 0")
def lint_robots(spark, sf_dir):
    return X.robots_texts(spark, sf_dir).withColumn("r", lint.robots(F.col("txt"))).select("page_id", F.explode(lint.robots_results(F.col("r"))).alias("x")).select("page_id", "x.rule")


@query("format_sniff", "WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN substr(html, 16) ELSE 'User-agent: *' END AS x FROM pages) SELECT page_id, CASE WHEN NOT starts_with(x, '<') THEN 'txt' WHEN NOT starts_with(x, '<html') THEN 'xml' ELSE 'html' END AS format FROM t")
def format_sniff(spark, sf_dir):
    n = F.col("page_id") % 3
    x = F.when(n == 0, F.col("html")).when(n == 1, F.expr("substr(html, 16)")).otherwise("User-agent: *")
    return X.pages(spark, sf_dir).select("page_id", lint.sniff(x).alias("format"))


# ---- ingest and reports ----------------------------------------------------------------------


@query("content_hash", "SELECT page_id, CASE WHEN html <> '' THEN sha256(regexp_replace(html, '[^\\x00-\\x7F]', '', 'g')) END AS content_hash FROM pages")
def content_hash(spark, sf_dir):
    return X.pages(spark, sf_dir).select("page_id", U.content_hash(F.col("html")).alias("content_hash"))


def crawled(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """crawl_urls rows of the fixture; of a page only what the named columns (all, if none) need is parsed."""
    return ingest.build_urls(X.responses(spark, sf_dir), columns or None)


_PAGE = "coalesce(code = 200 AND content_type = 'text/html', false)"
URLS_SQL = f"""WITH {X.RESPONSES_SQL}, gated AS (SELECT *, id AS page_id FROM web WHERE {_PAGE}), {s_parsed('gated', 'content', 'page_id, url')}, {s_lint()},
counts AS (SELECT page_id, {_COUNTS} FROM lint GROUP BY page_id),
urls AS (SELECT w.id, w.run_id, w.url AS address, {s_netloc('w.url')} AS domain, w.external, w.code AS status_code, w.content_type, greatest(0, coalesce(w.size, 0)) AS size, w.ts, w.content AS body,
 CASE WHEN p.has_head THEN p.canonical END AS canonical, CASE WHEN p.has_head THEN p.title END AS title_1, CASE WHEN p.has_head THEN p.description END AS meta_description_1, CASE WHEN p.has_head THEN p.h1_count END AS h1_count,
 coalesce(c.critical, 0) AS lint_critical, coalesce(c.error, 0) AS lint_error, coalesce(c.warn, 0) AS lint_warn, coalesce(c.info, 0) AS lint_info
 FROM web w LEFT JOIN parsed p ON w.id = p.page_id LEFT JOIN counts c ON w.id = c.page_id)"""


@query("crawl_urls_build", f"{URLS_SQL} SELECT id, run_id, address, domain, external::BIGINT AS external, status_code::BIGINT AS status_code, content_type, size::BIGINT AS size, sha256(regexp_replace(body, '[^\\x00-\\x7F]', '', 'g')) AS content_hash, canonical, title_1, meta_description_1, h1_count::BIGINT AS h1_count, lint_critical::BIGINT AS lint_critical, lint_error::BIGINT AS lint_error, lint_warn::BIGINT AS lint_warn, lint_info::BIGINT AS lint_info, ts::BIGINT AS ts FROM urls")
def crawl_urls_build(spark, sf_dir):
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return crawled(spark, sf_dir).select("id", "run_id", "address", "domain", long("external"), long("status_code"), "content_type", long("size"), "content_hash", "canonical", "title_1", "meta_description_1", long("h1_count"), long("lint_critical"), long("lint_error"), long("lint_warn"), long("lint_info"), F.unix_timestamp("timestamp").alias("ts"))


@query("duplicate_occurrences", f"{URLS_SQL} SELECT id, CASE WHEN title_1 IS NOT NULL THEN count(*) OVER (PARTITION BY run_id, title_1) END AS title_occurences, CASE WHEN meta_description_1 IS NOT NULL THEN count(*) OVER (PARTITION BY run_id, meta_description_1) END AS description_occurrences FROM urls")
def duplicate_occurrences(spark, sf_dir):
    return ingest.with_occurrences(crawled(spark, sf_dir, "id", "run_id", "title_1", "title_occurences_1", "meta_description_1", "meta_description_occurrences_1")).select("id", F.col("title_occurences_1").cast("bigint").alias("title_occurences"), F.col("meta_description_occurrences_1").cast("bigint").alias("description_occurrences"))


RUN = "run-1"
_RUN = f"lower(rtrim(run_id)) = {q(RUN)}"
_HTML = "lower(rtrim(content_type)) = 'text/html'"
_WHERE = {
    "5xx or 0 status codes": ("(status_code::VARCHAR LIKE '5%' OR status_code = 0)", "status_code"), "4xx status codes": ("status_code::VARCHAR LIKE '4%'", "status_code"), "missing canonical": (f"{_HTML} AND canonical IS NULL", "content_type"),
    "missing title": (f"{_HTML} AND title_1 IS NULL", "content_type"), "missing meta description": (f"{_HTML} AND meta_description_1 IS NULL", "content_type"), "lint level critical": ("lint_critical > 0", "lint_critical"), "lint level error": ("lint_error > 0", "lint_error"),
}


def s_report(names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS section_ord, {q(n)} AS section, id, address, ts::BIGINT AS ts, {_WHERE[n][1]}::VARCHAR AS value FROM urls WHERE {_RUN} AND external = 0 AND {_WHERE[n][0]}" for i, n in enumerate(names))


@query("stored_report", f"{URLS_SQL} {s_report(reports.STATUS)}")
def stored_report(spark, sf_dir):
    """The status report of a run whose rows were stored by run and round, one round twice: only the run's partitions are read."""
    folder = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    rows, store = crawled(spark, sf_dir, *reports.columns(reports.STATUS)), Stored(spark, folder)
    for number in (0, 1, 1):
        store.put(rows.where((F.col("run_id") == RUN) & (F.col("id") % 2 == number)), RUN, number)
    store.put(rows.where("run_id = 'run-2'"), "run-2", 0)
    return reports.composite(reports.stored_urls(spark, folder, RUN), RUN, reports.STATUS).select(F.col("section_ord").cast("bigint").alias("section_ord"), "section", "id", "address", F.unix_timestamp("timestamp").alias("ts"), "value")


def _composite(names):
    def run(spark, sf_dir):
        return reports.composite(crawled(spark, sf_dir, *reports.columns(names)), RUN, names).select(F.col("section_ord").cast("bigint").alias("section_ord"), "section", "id", "address", F.unix_timestamp("timestamp").alias("ts"), "value")

    return run


query("report_build", f"{URLS_SQL} {s_report(reports.BUILD)}")(_composite(reports.BUILD))
query("report_status_code", f"{URLS_SQL} {s_report(reports.STATUS)}")(_composite(reports.STATUS))

for _name, _query in (("5xx or 0 status codes", "status_5xx"), ("4xx status codes", "status_4xx"), ("missing canonical", "missing_canonical"), ("missing title", "missing_title"), ("missing meta description", "missing_description"), ("lint level critical", "lint_critical_pages"), ("lint level error", "lint_error_pages")):

    def _section(spark, sf_dir, name=_name):
        value = reports.sections()[name][1]
        return reports.section(crawled(spark, sf_dir, *reports.columns((name,))), RUN, name).select("id", "address", F.unix_timestamp("timestamp").alias("ts"), F.col(value).cast("string").alias("value"))

    query(_query, f"{URLS_SQL} SELECT id, address, ts::BIGINT AS ts, {_WHERE[_name][1]}::VARCHAR AS value FROM urls WHERE {_RUN} AND external = 0 AND {_WHERE[_name][0]}")(_section)


@query("report_all", f"{URLS_SQL} SELECT id, address, status_code::BIGINT AS status_code, title_1, ts::BIGINT AS ts FROM urls WHERE {_RUN}")
def report_all(spark, sf_dir):
    return reports.all_report(crawled(spark, sf_dir, "id", "run_id", "address", "status_code", "title_1", "timestamp"), RUN).select("id", "address", F.col("status_code").cast("bigint").alias("status_code"), "title_1", F.unix_timestamp("timestamp").alias("ts"))


def bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without what only a parse gives."""
    return crawled(spark, sf_dir, "id", "run_id", "address", "external", "status_code", "content_type", "body", "timestamp")


@query("latest_run", f"WITH {X.RESPONSES_SQL} SELECT run_id FROM web ORDER BY ts DESC, id DESC LIMIT 1")
def latest_run(spark, sf_dir):
    return reports.latest_run(bare(spark, sf_dir))


@query("run_ids", f"WITH {X.RESPONSES_SQL} SELECT run_id, min(ts)::BIGINT AS first_seen FROM web GROUP BY run_id")
def run_ids(spark, sf_dir):
    return reports.run_ids(bare(spark, sf_dir)).select("run_id", F.unix_timestamp("first_seen").alias("first_seen"))


@query("run_count", f"WITH {X.RESPONSES_SQL} SELECT count(id) AS n FROM web WHERE run_id = {q(RUN)}")
def run_count(spark, sf_dir):
    return reports.run_count(bare(spark, sf_dir), RUN)


@query("run_page", f"WITH {X.RESPONSES_SQL} SELECT id, url AS address, ts::BIGINT AS ts FROM web WHERE run_id = {q(RUN)} AND external = 0 ORDER BY ts, id LIMIT 50 OFFSET 50")
def run_page(spark, sf_dir):
    return reports.run_page(bare(spark, sf_dir), RUN, 2).select("id", "address", F.unix_timestamp("timestamp").alias("ts"))


@query("processed_urls", f"WITH {X.RESPONSES_SQL} SELECT url, max(id) AS id FROM web WHERE run_id = {q(RUN)} GROUP BY url")
def processed_urls(spark, sf_dir):
    return C.processed_urls(bare(spark, sf_dir), RUN)


_JUNIT = ", ".join(f"({i}, {q(n)})" for i, n in enumerate(reports.BUILD))


@query("junit_summary", f"{URLS_SQL}, rep AS ({s_report(reports.BUILD)}) SELECT s.o::BIGINT AS section_ord, s.n AS section, count(rep.id) AS errors, coalesce(string_agg(address, ', ' ORDER BY ts, id), '') AS addresses FROM (VALUES {_JUNIT}) AS s(o, n) LEFT JOIN rep ON rep.section = s.n GROUP BY s.o, s.n")
def junit_summary(spark, sf_dir):
    return reports.junit_sections(crawled(spark, sf_dir, *reports.columns(reports.BUILD)), RUN).withColumn("section_ord", F.col("section_ord").cast("bigint"))


_CSV = ["address", "status_code"]


@query("csv_lines", f"{URLS_SQL} SELECT id, {q(RUN + ',4Xx Status Codes,')} || address || ',' || coalesce(status_code::VARCHAR, 'None') AS line FROM urls WHERE {_RUN} AND external = 0 AND {_WHERE['4xx status codes'][0]}")
def csv_lines(spark, sf_dir):
    return render.csv_lines(reports.section(crawled(spark, sf_dir, *reports.columns(("4xx status codes",))), RUN, "4xx status codes"), RUN, "4xx status codes", _CSV).select("id", "line")


def s_escape(c: str) -> str:
    for a, b in (("chr(92)", "chr(92) || chr(92)"), ("chr(39)", "chr(92) || chr(39)"), ("chr(34)", "chr(92) || chr(34)"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'")):
        c = f"replace({c}, {a}, {b})"
    return c


@query("sql_lines", f"{URLS_SQL} SELECT id, {q('INSERT INTO `audit_report` (`run_id`,`report_type`,`address`,`title_1`) VALUES (' + chr(39) + RUN + chr(39) + ',' + chr(39) + 'All' + chr(39) + ',' + chr(39))} || {s_escape('address')} || {q(chr(39) + ',' + chr(39))} || {s_escape(chr(99) + 'oalesce(title_1, ' + q('None') + ')')} || {q(chr(39) + ');')} AS line FROM urls WHERE {_RUN}")
def sql_lines(spark, sf_dir):
    return render.sql_lines(reports.all_report(crawled(spark, sf_dir, "id", "run_id", "address", "title_1", "timestamp"), RUN), RUN, "all", ["address", "title_1"]).select("id", "line")


@query("html_file_names", f"WITH {X.RESPONSES_SQL}, f AS (SELECT replace(replace(replace(substr(url, 1, 50), 'http://', ''), 'https://', ''), '/', '__') || '.html' AS file_name, content, ts, id FROM web WHERE content_type = 'text/html') SELECT file_name, length(arg_max(content, ts * 1000000 + id))::BIGINT AS size FROM f GROUP BY file_name")
def html_file_names(spark, sf_dir):
    return render.html_files(bare(spark, sf_dir)).select("file_name", F.length("body").cast("bigint").alias("size"))


# ---- the link graph --------------------------------------------------------------------------

_GRAPH = "WITH RECURSIVE p AS (SELECT page_id AS n FROM pages), e AS (SELECT n, 2 * n + 1 AS m FROM p UNION ALL SELECT n, 2 * n + 2 FROM p), reach(n, d) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT e.m, r.d + 1 FROM reach r JOIN e ON r.n = e.n)"
_AT = "'http://site.example.com/p' || "


def _folder(spark: SparkSession, name: str) -> str:

    return f"{shared_dir(spark)}/crawl-{name}-{uuid.uuid4().hex}"


def crawl_site(spark: SparkSession, sf_dir: str, **kw):
    return C.crawl(spark, ["http://site.example.com/p0"], X.link_web(spark, sf_dir), _folder(spark, "site"), run_id="bfs", clock=F.timestamp_seconds(F.lit(X.START)), **kw)


@query("crawl_bfs", f"{_GRAPH} SELECT {_AT}n AS address, d::BIGINT AS depth, CASE WHEN n IN (SELECT n FROM p) THEN 200 ELSE 0 END::BIGINT AS status_code FROM reach")
def crawl_bfs(spark, sf_dir):
    urls = crawl_site(spark, sf_dir, internal=True).urls
    return urls.where("address like 'http://site.example.com/%'").select("address", F.col("depth").cast("bigint").alias("depth"), F.col("status_code").cast("bigint").alias("status_code"))


_LIMITED = "WITH s AS (SELECT count(*) AS n FROM pages), q AS (SELECT unnest(range(CASE WHEN n > 17 THEN 37 ELSE 2 * n + 1 END)) AS k, n FROM s)"


# Page k finds k + 1 URLs queued and adds two, so the second link of page 17 makes the queue 20 long.
@query("crawl_limit", f"""{_LIMITED} SELECT {_AT}k AS address, floor(log2(k + 1))::BIGINT AS depth, CASE WHEN k < n THEN 200 ELSE 0 END::BIGINT AS status_code, 0::BIGINT AS external FROM q
UNION ALL SELECT 'http://out.example.org/' || k, floor(log2(k + 1))::BIGINT, 0, 1 FROM q WHERE k < 5 UNION ALL SELECT 'http://cdn.example.net/logo.png', 0, 0, 1""")  # fmt: skip
def crawl_limit(spark, sf_dir):
    return crawl_site(spark, sf_dir, internal=True, limit=20).urls.select("address", *[F.col(c).cast("bigint").alias(c) for c in ("depth", "status_code", "external")])


@query("links_resolved", f"{_GRAPH}, src AS (SELECT n FROM reach WHERE n IN (SELECT n FROM p)) SELECT {_AT}n AS from_address, {_AT}(2 * n + k.k) AS to_address, 'anchor' AS type FROM src, (VALUES (1), (2)) AS k(k) UNION ALL SELECT {_AT}n, 'http://out.example.org/' || (n % 5), 'anchor' FROM src UNION ALL SELECT {_AT}n, 'http://cdn.example.net/logo.png', 'asset' FROM src")
def links_resolved(spark, sf_dir):
    found = crawl_site(spark, sf_dir, internal=True)
    urls, links = found.urls, found.links
    a = urls.select(F.col("id").alias("from_url_id"), F.col("address").alias("from_address"))
    b = urls.select(F.col("id").alias("to_url_id"), F.col("address").alias("to_address"))
    return links.join(a, "from_url_id").join(b, "to_url_id").select("from_address", "to_address", "type")


@query("external_links", "SELECT 'http://out.example.org/0' AS address, 1::BIGINT AS external UNION ALL SELECT 'http://cdn.example.net/logo.png', 1")
def external_links(spark, sf_dir):
    return crawl_site(spark, sf_dir).urls.where("external = 1").select("address", F.col("external").cast("bigint").alias("external"))


@query("crawl_pages", f"WITH l AS ({ORACLES['page_links']}) SELECT url AS address, 200::BIGINT AS status_code, 0::BIGINT AS depth, 0::BIGINT AS external FROM pages UNION ALL SELECT DISTINCT link, 0::BIGINT, 1::BIGINT, 0::BIGINT FROM l WHERE link NOT IN (SELECT url FROM pages)")
def crawl_pages(spark, sf_dir):
    """A crawl of the pages' own markup, each page a seed: what they link to within their sites is asked in the next round, and not there."""
    p = X.pages(spark, sf_dir)
    turn = F.row_number().over(Window.partitionBy("url").orderBy("page_id")) - 1  # pages may share a URL
    web = p.select("url", turn.alias("turn"), F.lit(200).alias("code"), F.lit("OK").alias("reason"), F.col("html").alias("content"), F.lit("text/html").alias("content_type"), F.lit(None).cast("bigint").alias("size"), F.lit("utf-8").alias("encoding"), F.lit(0.1).cast("float").alias("response_time"))
    found = C.crawl(spark, p.select("url", F.col("page_id").alias("pos")), web, _folder(spark, "pages"), internal=True, run_id="pages", clock=F.timestamp_seconds(F.lit(X.START)))
    return found.urls.select("address", *[F.col(c).cast("bigint").alias(c) for c in ("status_code", "depth", "external")])


@query("frontier_new_urls", f"WITH l AS (SELECT DISTINCT {_AT}m AS url, m FROM (SELECT page_id, unnest([2 * page_id + 1, 2 * page_id + 2, page_id]) AS m FROM pages)) SELECT url FROM l WHERE m NOT IN (SELECT page_id FROM pages)")
def frontier_new_urls(spark, sf_dir):
    """Links of all pages that are no page: new to a frontier that has processed them all."""
    web = X.link_web(spark, sf_dir)
    found = H.parse(web, "content", parts=("links",)).select(F.explode("doc.links.url").alias("url")).where(U.netloc(F.col("url")) == "site.example.com").distinct()
    return found.join(web.select("url"), "url", "left_anti")


@query("assets", f"SELECT {_AT}page_id AS page, 'http://cdn.example.net/logo.png' AS asset, 'logo' AS alt FROM pages")
def assets(spark, sf_dir):
    return H.parse(X.link_web(spark, sf_dir), "content", parts=("sources",)).select(F.col("url").alias("page"), F.explode("doc.sources").alias("x")).select("page", F.col("x.url").alias("asset"), F.col("x.alt").alias("alt"))
