"""The rule catalogue and its predicates over parsed documents, sitemaps and robots files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import built_once
from auditloom.functions.html import parse
from auditloom.functions.keywords import match_count
from auditloom.functions.urls import let

LEVELS = {"C": ("critical", 0), "E": ("error", 1), "W": ("warning", 2), "I": ("info", 3)}
# Rule ids with their printed labels, in catalogue order.
CATALOGUE = (
    ("C22", "has head"), ("E02", "has title"), ("E05", "has meta description"), ("E08", "has canonical"), ("E09", "has h1"),
    ("E12", "title matches <1 h1 word"), ("E13", "title matches <1 meta description word"), ("E17", "<1000 outlinks on page"),
    ("W03", "title < 58 chars"), ("W06", "meta description < 150 chars"), ("W14", "title matches <3 h1 words"), ("W15", "title matches <3 meta description word"),
    ("W16", "<300 outlinks on page"), ("W18", "size < 200K"), ("W19", "all img tags have alt attribute"), ("W23", "h1 count > 1"),
    ("I10", "missing rel=prev"), ("I11", "missing rel=next"), ("I20", "has robots=nofollow"), ("I21", "has robots=noindex"),
    ("C23", "has sitemap"), ("I24", "has disallow"), ("I25", "has user-agent"),
    ("C26", "is valid xml"), ("C27", "has locs"), ("E33", "<1000 locs in index"), ("I30", "has priority"), ("I31", "has changefreq"), ("I32", "has lastmod"),
)
#: What the HTML rules emit; E18 is emitted though the catalogue declares W18.
HTML_RULES = ("C22", "E02", "W03", "E05", "W06", "E08", "E09", "I10", "I11", "W16", "E17", "E18", "I20", "I21", "W23", "E12", "E13", "W14", "W15", "W19")
RESULT = "struct<rule:string,level:string,level_no:int,int_value:bigint,str_value:string,left_kw:array<string>,right_kw:array<string>>"


def catalogue(spark: SparkSession) -> DataFrame:
    """(rule_ord, rule, label, level, level_no, declared)."""
    rows = [(i, r, label, *LEVELS[r[0]], True) for i, (r, label) in enumerate(CATALOGUE)] + [(len(CATALOGUE), "E18", "size < 200K", *LEVELS["E"], False)]
    return spark.createDataFrame(rows, "rule_ord int, rule string, label string, level string, level_no int, declared boolean")


def _result(rule: str, fires: Column, number: Column | None = None, text: Column | None = None, left: Column | None = None, right: Column | None = None) -> Column:
    level, no = LEVELS[rule[0]]
    none = F.lit(None)
    value = F.struct(F.lit(rule), F.lit(level), F.lit(no), (none if number is None else number).cast("bigint"), (none if text is None else text).cast("string"), (none if left is None else left).cast("array<string>"), (none if right is None else right).cast("array<string>"))
    return F.when(fires, value.cast(RESULT))


def _rules(d: Column) -> dict[str, tuple[tuple[str, ...], object]]:
    """rule -> (the fields it reads, what builds it), in evaluation order; all but C22 are for documents with a head."""
    def words(fields: str, rule: str, most: int):
        shared = match_count(d["title_keywords"], d[fields])
        return _result(rule, shared < most, shared, left=d["title_keywords"], right=d[fields])

    description, robots = lambda: F.coalesce(d["description"], F.lit("")), lambda: F.coalesce(d["robots"], F.lit(""))
    keyed, described = ("title_keywords", "h1_keywords"), ("title_keywords", "description_keywords")
    return {
        "E02": (("title",), lambda: _result("E02", d["title"] == "")),
        "W03": (("title",), lambda: _result("W03", F.length(d["title"]) > 58)),
        "E05": (("has_description",), lambda: _result("E05", ~d["has_description"])),
        "W06": (("has_description", "description"), lambda: _result("W06", d["has_description"] & (F.length(description()) > 150))),
        "E08": (("has_canonical",), lambda: _result("E08", ~d["has_canonical"])),
        "E09": (("h1_count",), lambda: _result("E09", d["h1_count"] == 0)),
        "I10": (("has_next",), lambda: _result("I10", ~d["has_next"])),
        "I11": (("has_prev",), lambda: _result("I11", ~d["has_prev"])),
        "W16": (("link_count",), lambda: _result("W16", d["link_count"] >= 300, d["link_count"])),
        "E17": (("link_count",), lambda: _result("E17", d["link_count"] >= 1000, d["link_count"])),
        "E18": (("size",), lambda: _result("E18", d["size"] >= 204800, d["size"])),
        "I20": (("robots",), lambda: _result("I20", robots().contains("nofollow"), text=robots())),
        "I21": (("robots",), lambda: _result("I21", robots().contains("noindex"), text=robots())),
        "W23": (("h1_count",), lambda: _result("W23", d["h1_count"] >= 1, d["h1_count"])),
        "E12": (keyed, lambda: words("h1_keywords", "E12", 1)),
        "E13": (described, lambda: words("description_keywords", "E13", 1)),
        "W14": (keyed, lambda: words("h1_keywords", "W14", 3)),
        "W15": (described, lambda: words("description_keywords", "W15", 3)),
        "W19": (("img_no_alt",), lambda: _result("W19", d["img_no_alt"] > 0, d["img_no_alt"])),
    }


def fields(rules: tuple[str, ...] = HTML_RULES) -> tuple[str, ...]:
    """The parsed fields that the rules read."""
    held = _rules({n: None for n in ("title_keywords", "h1_keywords", "description_keywords")})
    return ("has_head", *dict.fromkeys(f for r in rules if r in held for f in held[r][0]))


def html_results(d: Column, rules: tuple[str, ...] = HTML_RULES) -> Column:
    """Those of the rules that fire on a parsed document, in evaluation order; a document without head has C22 alone."""
    none = F.array().cast(f"array<{RESULT}>")
    fired = [build() for r, (_, build) in _rules(d).items() if r in rules]
    alone = F.array(_result("C22", F.lit(True))) if "C22" in rules else none
    return F.when(d["has_head"], F.filter(F.array(*fired), lambda r: r.isNotNull()) if fired else none).otherwise(alone)


@built_once
def _results_of(doc: str, *rules: str) -> Column:
    return F.when(F.col(doc).isNotNull(), html_results(F.col(doc), rules))


def lint_html(parsed: DataFrame, doc: str = "doc", rules: tuple[str, ...] = HTML_RULES) -> DataFrame:
    """Adds ``lint``. The Generate keeps a filter on the results from computing the parse again."""
    held = parsed.select("*", F.explode(F.array(F.struct(F.col(doc).alias("d")))).alias("_g"))
    return held.withColumn("lint", _results_of("_g.d", *rules)).drop("_g")


def lint_pages(pages: DataFrame, html: str = "html", url: str = "url", rules: tuple[str, ...] = HTML_RULES) -> DataFrame:
    """pages with ``lint``: of each page only what the rules read is parsed."""
    return lint_html(parse(pages, html, url, fields(rules)), rules=rules).drop("doc")


def at_level(results: Column, level_no: int) -> Column:
    """Results of at least this severity (0 critical .. 3 info)."""
    return F.filter(results, lambda r: r["level_no"] <= level_no)


def level_count(results: Column, letter: str) -> Column:
    return F.coalesce(F.size(F.filter(results, lambda r: r["rule"].startswith(letter))), F.lit(0))


def results_json(results: Column) -> Column:
    return F.to_json(F.map_from_arrays(F.transform(results, lambda r: r["rule"]), F.transform(results, lambda r: F.coalesce(r["int_value"].cast("string"), r["str_value"], F.lit("true")))))


def sniff(text: Column) -> Column:
    """txt, xml or html by the first characters, as written."""
    return F.when(~text.startswith("<"), "txt").when(~text.startswith("<html"), "xml").otherwise("html")


ENTRY = ("loc", "priority", "changefreq", "lastmod")


def sitemap(xml: Column, names: tuple[str, ...] = ENTRY) -> Column:
    """struct<kind, entries>: an index wins over a url set; kind NULL where neither root is there. names: what is read of an entry.

    Explode it in an array before its entries are: Spark filters on what is exploded, and would read the entries for that too.
    """
    found = F.when(xml.rlike(r"(?i)<sitemapindex[\s>]"), "index").when(xml.rlike(r"(?i)<urlset[\s>]"), "urlset")
    held = lambda name: rf"(?is)(?=<{name}\b)<{name}\b[^>]*>((?:[^<]++|<(?!/{name}>))*+)(?:</{name}>)?"
    items = lambda name: F.regexp_extract_all(xml, F.lit(held(name)), 1)
    # absent elements and empty ones are NULL
    part = lambda item, name: let(F.regexp_extract(item, held(name), 1), lambda v: F.when(v != "", v))
    entries = lambda kind: F.transform(F.when(kind == "index", items("sitemap")).when(kind == "urlset", items("url")), lambda i: F.struct(*(part(i, n).alias(n) for n in names)))
    return let(found, lambda kind: F.struct(kind.alias("kind"), entries(kind).alias("entries")))


def sitemap_results(s: Column) -> Column:
    n = F.coalesce(F.size(s["entries"]), F.lit(0))
    have = lambda name: F.exists(s["entries"], lambda e: e[name].isNotNull())
    rules = [_result("E33", n >= 10000, n)] + [_result(r, (s["kind"] == "urlset") & have(c)) for r, c in (("I30", "priority"), ("I31", "changefreq"), ("I32", "lastmod"))]
    return F.when(s["kind"].isNull(), F.array(_result("C26", F.lit(True)))).when(n == 0, F.array(_result("C27", F.lit(True)))).otherwise(F.filter(F.array(*rules), lambda r: r.isNotNull()))


def robots(txt: Column) -> Column:
    """struct of all values of each key, by exact case; white space after the colon may cross lines."""
    found = lambda key: F.regexp_extract_all(txt, F.lit(key + r":\s+([^\n]+)"), 1)
    return F.struct(found("Sitemap").alias("sitemap"), found("Disallow").alias("disallow"), found("User-agent").alias("user_agent"))


def robots_results(r: Column) -> Column:
    rules = F.array(_result("I24", F.size(r["disallow"]) == 0), _result("I25", F.size(r["user_agent"]) == 0))
    return F.when(F.size(r["sitemap"]) == 0, F.array(_result("C23", F.lit(True)))).otherwise(F.filter(rules, lambda x: x.isNotNull()))


def printed(results: DataFrame, results_col: str = "lint", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rule_ord, line, found, failed) in catalogue order; undeclared rules vanish."""
    flat = results.select(*keys, F.explode(results_col).alias("r")).select(*keys, "r.*")
    rules = F.broadcast(catalogue(results.sparkSession).where("declared").select("rule_ord", F.col("rule").alias("_rule"), "label"))  # 29 rows
    joined = flat.join(rules, flat["rule"] == F.col("_rule"))
    value = F.coalesce(F.when(F.col("int_value") != 1, F.col("int_value").cast("string")), F.col("str_value"))
    return joined.select(*keys, "rule_ord", F.format_string("%s: %s (%s)", "rule", "label", "level").alias("line"), F.when(value.isNotNull(), F.concat(F.lit("found: "), value)).alias("found"), (F.col("level_no") <= 1).alias("failed"))


