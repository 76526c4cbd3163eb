import re

from pyspark.sql import functions as F

from auditloom.functions import html as H
from auditloom.functions import sql
from auditloom.functions.urls import resolve

PAGES = [
    '<a href="x?a=1&amp;b=2#f">one &lt;b&gt; &eacute &#128; &#0; &#x1F600; &nosuch; &notit</a><a HREF=\'../up/./q\' rel="nofollow me" alt=pic>two<b>x</b>',
    "<a href=//other.example/p>r</a><a href=mailto:x@y.example>m</a><a>none</a><a href=''>empty</a><a href='http://[bad/x'>bad</a><a href=?q>q</a>",
    "<!-- <a href=hidden>h</a> --><script>'<a href=s>'</script><a href=open <a href='b'>x<a title=\"href=no\" href=yes>z",
    "<a href='ftp://f.example/a'>f</a><a href='/rooted/../x'>r</a><a href='..'>u</a><a href='  sp ace  '>s</a><a href=a&b>t</a>",
    "",
    "no links",
    None,
]
BASES = ["http://a.example/c/d/e?x=1", "https://a.example", None]


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_links_in_sql_are_those_of_the_column_functions(spark):
    sql.register(spark)
    pages = [(k, u, h) for k, (u, h) in enumerate((u, h) for u in BASES for h in PAGES)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.createOrReplaceTempView("sql_pages")
    want = H.parse(df, parts=("links",)).select("page_id", F.posexplode("doc.links").alias("pos", "x"))
    want = rows(want.select("page_id", F.col("pos").cast("long").alias("pos"), "x.*"))
    assert len(want) > 20
    assert rows(spark.sql("SELECT page_id, l.* FROM sql_pages, LATERAL extract_links(html, url) l")) == want
    whole = sql.page_links(spark, "sql_pages")
    assert rows(whole) == rows(spark.sql("SELECT page_id, l.pos, l.url AS link, l.text FROM sql_pages, LATERAL extract_links(html, url) l"))


def test_the_view_form_is_narrow_and_without_python(spark):
    spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").createOrReplaceTempView("sql_pages_plan")
    plan = sql.page_links(spark, "sql_pages_plan")._jdf.queryExecution().executedPlan().toString()
    nodes = set(re.findall(r"(?m)^[\s:*+-]*(?:\(\d+\) )?([A-Z]\w+)", plan))
    assert nodes == {"Project", "Filter", "Generate", "Scan"}
    assert plan.count("<!--") == 1  # no filter computes the links once more


def test_small_functions(spark):
    sql.register(spark)
    hrefs = ["../b?x#y", "", "?q", "#f", "//h.example/p", "https:x", "mailto:a@b", "./", "a/../../../c", " s "]
    df = spark.createDataFrame([(h, b) for h in hrefs for b in BASES], "href string, base string")
    assert df.select(F.expr("url_join(href, base)").eqNullSafe(resolve(F.col("href"), F.col("base"))).alias("same")).where("not same").count() == 0
    texts = ["<b>x &amp; y&eacute &#65;</b>", "a < b & c", "", None, "&#x80;&#xD800;&#99999999999;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~F.expr("html_text(t)").eqNullSafe(H.text_of(F.col("t")))).count() == 0
    tags = ['<a href="x&lt;" alt>', "<a title='alt=1' alt=2>", "<a>", None]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert df.where(~F.expr("html_attribute(t, 'alt')").eqNullSafe(H.attribute(F.col("t"), "alt"))).count() == 0
