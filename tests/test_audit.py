"""URL functions, rules at their boundaries, robots and sitemaps, renderers, sources, streaming."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from auditloom.functions import urls as U
from auditloom.functions.html import parse
from auditloom.functions.keywords import keywords, match_count
from auditloom.operators import lint, render, reports
from auditloom.plans import fixtures, registry
from auditloom.sources import seeds


def test_urls(spark):
    full = {"http://a.b": False, "http://a.co": True, "http://localhost/x": False, "http://1.2.3.4/": False, "HTTP://a.com": False, "https://my_host-1.com/x": True, "//cdn.com/x": False, "": False}
    got = spark.createDataFrame([(u,) for u in full], "u string").select("u", U.is_full_url(F.col("u")).alias("f")).collect()
    assert {r.u: r.f for r in got} == full
    base = "http://h.com/a/b/c?q=1#f"
    want = {"": "http://h.com/a/b/c?q=1", "#x": "http://h.com/a/b/c?q=1", "?q=2": "http://h.com/a/b/c?q=2", "../a": "http://h.com/a/a", "/a/../b": "http://h.com/a/../b", "//o.com/x": "http://o.com/x", "d": "http://h.com/a/b/d", ".": "http://h.com/a/b/", "..": "http://h.com/a/", "../../../z": "http://h.com/../z", "mailto:x@y": "mailto:x@y", "https://s.com/q#z": "https://s.com/q", "javascript:void(0)": "javascript:void(0)"}
    got = spark.createDataFrame([(h, base) for h in want], "h string, b string").select("h", U.resolve(F.col("h"), F.col("b")).alias("r")).collect()
    assert {r.h: r.r for r in got} == want
    sites = [("http://a.com/x", "http://a.com/y", True), ("http://s.a.com/", "http://a.com/", True), ("http://a.com/", "http://s.a.com/", True), ("http://evil-a.com/", "http://a.com/", True), ("http://b.com/", "http://a.com/", False), ("/x", "http://a.com/", True), ("http://a.com:81/", "http://a.com/", False)]
    got = spark.createDataFrame(sites, "u string, s string, want boolean").select("want", U.same_site(F.col("u"), F.col("s")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    r = spark.createDataFrame([("http://a.com/x/a.com/y?z#f", "é")], "u string, b string").select(U.path(F.col("u")).alias("p"), U.content_hash(F.col("b")).alias("h"), U.content_hash(F.lit("")).alias("n")).first()
    assert r.p == "/y?z#f" and r.h == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" and r.n is None


def test_keywords(spark):
    r = spark.createDataFrame([("The the well-known isn't ab Cat cat é",)], "t string").select(keywords(F.col("t")).alias("k"), keywords(F.lit(None).cast("string")).alias("n"), match_count(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("a"), F.lit("a"), F.lit("b"))).alias("m")).first()
    assert r.k == ["the", "well-known", "isn't", "cat", "cat"] and r.n == ["none"] and r.m == 4


def rules(spark, *pages):
    df = spark.createDataFrame([(i, p, "http://h.com/") for i, p in enumerate(pages)], "i int, html string, url string")
    rows = lint.lint_html(parse(df)).orderBy("i").select(F.transform("lint", lambda r: r["rule"]).alias("r")).collect()
    return [None if r.r is None else set(r.r) for r in rows]


def page(head="", body=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def test_rule_boundaries(spark):
    t = lambda n: page(f"<title>{'x' * n}</title>")
    d = lambda n: page(f'<meta name="description" content="{"y" * n}">')
    a = lambda n: page("", "<a href='/'>l</a>" * n)
    big = page("", "z" * (204800 - len(page())))
    got = rules(spark, t(58), t(59), d(150), d(151), a(299), a(300), a(999), a(1000), big[:-8] + "</html>", big, "<p>none</p>", None, page("<title></title>"), page(), page("<title>one two three</title>", "<h1>one two three</h1><img alt=''><img src=x alt=y>"), page('<link rel="next nofollow"><link rel="prev"><link rel="canonical" href="/"><meta name="robots" content="noindex, nofollow">'))
    assert ["W03" in x for x in got[:2]] == [False, True] and ["W06" in x for x in got[2:4]] == [False, True]
    assert ["W16" in x for x in got[4:8]] == [False, True, True, True] and ["E17" in x for x in got[4:8]] == [False, False, False, True]
    assert ["E18" in x for x in got[8:10]] == [False, True]
    assert got[10] == {"C22"} and got[11] is None
    assert "E02" in got[12] and "E02" not in got[13] and "W03" not in got[12]
    assert {"W23", "W19"} <= got[14] and not {"E09", "E12", "W14"} & got[14] and {"E05", "E13", "W15"} <= got[14]
    assert {"I20", "I21"} <= got[15] and not {"I10", "I11", "E08"} & got[15]
    for x in got[:10] + got[12:]:
        for cause, effect in (("E09", {"E12", "W14"}), ("E05", {"E13", "W15"}), ("E12", {"W14"}), ("E13", {"W15"}), ("E17", {"W16"})):
            assert cause not in x or effect <= x


def test_markup_traps(spark):
    html = page("<title>A &amp b</title><script>var x='<h1>no</h1>';</script><!-- <h1>no</h1> -->", "<H1 class='q'>Yes <b>it</b> is</H1><a>no href</a><a href='mailto:x@y'>m</a><a href=\"/p#f\" rel='nofollow me'>t</a><img src='/i.png#k'><script src='http://c.example.com/s.js#k'></script>")
    d = parse(spark.createDataFrame([(html, "http://h.com/d/")], "html string, url string")).first().doc
    assert d.title == "A & b" and d.h1s == ["Yes it is"] and d.link_count == 3
    assert [(x.url, x.text, x.rel) for x in d.links] == [("http://h.com/d/", "no href", None), ("http://h.com/p", "t", ["nofollow", "me"])]
    assert [x.url for x in d.sources] == ["http://h.com/i.png", "http://c.example.com/s.js#k"]


def test_entries_of_sitemaps_are_read_once(spark):
    from auditloom.plans import registry

    plan = registry.sitemap_entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_pages_are_dealt_by_their_bytes(spark, tmp_path):
    import secrets

    from auditloom.plans import fixtures

    rows = [(k, f"http://a.example.com/{k}", secrets.token_hex(1 << 19)) for k in range(12)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert fixtures.pages(spark, str(tmp_path)).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert fixtures.pages(spark, str(tmp_path)).count() == 12


def test_robots_sitemaps_sniff(spark):
    texts = ["", "Sitemap: http://a/x\nSitemap: http://a/y\r\n", "Sitemap: s\nDisallow:\nUser-agent: *\n", "sitemap: s\n"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("r", lint.robots(F.col("t"))).orderBy("i").select("r", F.transform(lint.robots_results(F.col("r")), lambda x: x["rule"]).alias("x")).collect()
    assert [r.x for r in got] == [["C23"], ["I24", "I25"], ["I25"] if not got[2].r.user_agent else [], ["C23"]]
    assert got[2].r.disallow == ["User-agent: *"]
    u = "<url><loc>l</loc><priority></priority></url>"
    maps = ["<x/>", "<urlset></urlset>", f"<urlset>{u * 9999}</urlset>", f"<urlset>{u * 10000}</urlset>", "<sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex><urlset></urlset>"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(maps)], "i int, t string").withColumn("s", lint.sitemap(F.col("t"))).orderBy("i").select(F.col("s.kind").alias("k"), F.transform(lint.sitemap_results(F.col("s")), lambda x: x["rule"]).alias("x")).collect()
    assert [r.x for r in got] == [["C26"], ["C27"], [], ["E33"], []] and got[4].k == "index"
    kinds = {"": "txt", "text": "txt", "<?xml": "xml", "<html": "html", "<HTML": "xml", "<!DOCTYPE html>": "xml", " <html": "txt"}
    got = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", lint.sniff(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == kinds


def test_paging_and_titles():
    assert [reports.paging(n, 1)["next_page"] for n in (0, 50, 75, 100, 101)] == [None, None, None, 2, 2]
    assert reports.paging(75, 1)["has_more"] and not reports.paging(50, 1)["has_more"]
    assert render.title_case("5xx or 0 status codes") == "5Xx Or 0 Status Codes" and render.title_case("status_code") == "Status Code"


def test_renderers(spark):
    rows = spark.createDataFrame([(1, "http://a/x,y'\"&", None), (2, "https://b/" + "p/" * 40, 404)], "id long, address string, status_code int")
    assert [r.line for r in render.csv_lines(rows, "r", "all", ["address", "status_code"]).orderBy("id").collect()][0] == "r,All,http://a/x,y'\"&,None"
    assert render.sql_lines(rows, "r", "all", ["address", "status_code"]).orderBy("id").first().line == "INSERT INTO `audit_report` (`run_id`,`report_type`,`address`,`status_code`) VALUES ('r','All','http://a/x,y\\'\\\"&','None');"
    assert rows.orderBy("id").select(render.html_file_name(F.col("address")).alias("f")).collect()[1].f == "b__" + "p__" * 20 + ".html"
    s = spark.createDataFrame([(0, "one", 2, "a, b"), (1, "two", 0, "")], "section_ord int, section string, errors long, addresses string")
    out = render.junit(s, "build", "r", datetime(2024, 1, 1), 0.5)
    assert 'tests="2"' in out and 'errors="2"' in out and out.count("<error") == 1 and out.count("<testcase") == 2
    assert render.sql_table(["address", "address", "id"]).count("`address`") == 1
    assert 'ss:ExpandedColumnCount="4"' in render.xls(iter([("all", ["id", "address"], rows)]), "r")


def test_sources(spark, tmp_path):
    f = tmp_path / "urls.txt"
    f.write_text(" http://a.com/x \n\nhttp://b.com/\n")
    assert [r.url for r in seeds.url_file(spark, str(f)).orderBy("pos").collect()] == ["http://a.com/x", "", "http://b.com/"]


def test_stream(spark, tmp_path):
    from auditloom.streaming import lint_stream

    spark.createDataFrame([(1, "http://h.com/", page("<title>t</title>"))], lint_stream.PAGES).write.parquet(str(tmp_path / "in"))
    q = lint_stream.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert "E09" in {r.rule for r in spark.read.parquet(str(tmp_path / "out")).select(F.explode("lint").alias("r")).select("r.rule").collect()}


def test_unknown_report(spark):
    with pytest.raises(ValueError):
        reports.report(None, "nonesuch", "r")


def test_lint_command(spark, tmp_path, capsys):
    from auditloom import cli

    files = {"page.html": "<html><head></head><body></body></html>", "map.xml": "<urlset></urlset>", "good.txt": "Sitemap: http://h.com/s\nDisallow: /x\nUser-agent: *\n", "robots.txt": "Disallow: /x\n"}
    status = {}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
        status[name] = cli.main(["lint", str(tmp_path / name)], spark)
    out = capsys.readouterr().out
    assert status == {"page.html": 1, "map.xml": 1, "good.txt": 0, "robots.txt": 1}
    assert "E09: has h1 (error)" in out and "C27: has locs (critical)" in out and "C23: has sitemap (critical)" in out
    assert cli.main(["lint", "-f", "txt", str(tmp_path / "page.html")], spark) == 1


def test_fetch_with_an_opener(spark):
    from email.message import Message

    from auditloom.sources.fetch import fetch_one

    class Response:
        def __init__(self, url, method):
            self.url, self.status, self.reason, self.headers = url, 200, "OK", Message()
            self.headers["content-type"] = "text/html; charset=latin-1"
            self.body = "é".encode("latin-1") if method == "GET" else b""

        def read(self):
            return self.body

    class Opener:
        asked = []

        def open(self, req, timeout):
            self.asked.append((req.get_method(), req.full_url, req.get_header("User-agent"), timeout))
            if "slow" in req.full_url:
                raise TimeoutError
            if "gone" in req.full_url:
                raise OSError("refused")
            return Response(req.full_url, req.get_method())

    opener = Opener()
    got = fetch_one("http://h.com/", "me", True, opener)
    assert (got["content"], got["content_type"], got["encoding"], got["code"]) == ("é", "text/html", "iso-8859-1", 200) or got["encoding"] == "latin-1"
    assert [x[:3] for x in opener.asked] == [("HEAD", "http://h.com/", "me"), ("GET", "http://h.com/", "me")] and opener.asked[0][3] == 16
    assert fetch_one("http://h.com/", None, False, opener)["content"] == "" and len(opener.asked) == 3
    assert fetch_one("http://slow.com/", None, True, opener)["reason"] == "Timeout 16" and fetch_one("http://gone.com/", None, True, opener)["code"] == 0


def test_yaml_list(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "u.yaml").write_text("urls:\n- http://a.com/\n- http://b.com/\n")
    assert [r.url for r in seeds.yaml_urls(spark, str(tmp_path / "u.yaml")).orderBy("pos").collect()] == ["http://a.com/", "http://b.com/"]
    assert seeds.yaml_urls(spark, str(tmp_path / "u.yaml"), "none").count() == 0


def test_pages_that_repeat_are_dealt_by_rows(spark, tmp_path):
    """A dictionary stores repeated pages once: the file stays small, and no task gets more rows as it grows."""
    n = 40 * fixtures.TASK_ROWS
    spark.range(n).select(F.col("id").alias("page_id"), F.lit("http://h.com/").alias("url"), F.lit(page("", "x" * 1000)).alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    held = [r.n for r in fixtures.variants(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == n and max(held) <= fixtures.TASK_ROWS + 1


@pytest.mark.parametrize("name", ["lint_level_counts", "lint_exit_status", "rules_catalogue"])
def test_lint_queries_deal_pages_by_rows(spark, tmp_path, name):
    spark.range(40 * fixtures.TASK_ROWS).select(F.col("id").alias("page_id"), F.lit("http://h.com/").alias("url"), F.lit(page()).alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert "RoundRobinPartitioning(40)" in registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
