"""Site-wide rules, databases and the file sink."""

import os
import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import render, reports, site_rules
from auditloom.sources.database import database_rows, settings
from auditloom.sources.files import write_files


def test_site_rules(spark):
    r = random.Random(1)
    rows = [(k, r.choice(("x", "y", None)), r.choice(("one", "two", "", None, "common", "common", "common")), r.choice(("d", None, f"own {k}")), k % 9 != 0, b"\xc3" if k % 7 == 0 else None if k % 7 == 1 else "é".encode()) for k in range(300)]
    pages = spark.createDataFrame([(k, s, (t, d, h), b, "u") for k, s, t, d, h, b in rows], "page long, run_id string, doc struct<title:string,description:string,has_head:boolean>, bytes binary, same string")
    for scope, of in (((), lambda x: None), (("run_id",), lambda x: x[1])):
        found = site_rules.with_site_rules(pages, "page", scope, "bytes")
        assert found.columns == [*pages.columns, "lint"]
        got = sorted((x.page, y.rule, y.level, y.int_value) for x in found.collect() for y in x.lint)
        want = []
        for x in rows:
            want += [(x[0], "E01", "error", None)] if x[5] == b"\xc3" else []
            for rule, c in (("W04", 2), ("W07", 3)):
                n = sum(y[4] and y[c] == x[c] and of(y) == of(x) for y in rows)
                want += [(x[0], rule, "warning", n)] if x[4] and x[c] and n > 1 else []
        assert got == sorted(want) and len(got) > 200
    assert site_rules.with_site_rules(pages.limit(0), "page", (), "bytes").count() == 0
    # a value that most rows share is joined in many tasks
    plan = site_rules.with_counts(pages, {"n": F.col("doc.title")}, "page")._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(page" in plan and "= cast(_to" in plan and "Generate explode" in plan, plan


def test_database_reads_are_split_and_filtered_there(spark, tmp_path):
    url = f"jdbc:derby:memory:d{os.getpid()};create=true"
    rows = [(k * 1000, f"run-{k % 3}", f"http://h.com/{k}", k % 600, "t" * (k % 5)) for k in range(1, 400)]
    spark.createDataFrame(rows, "id long, run_id string, address string, status_code int, body string").write.format("jdbc").options(url=url, dbtable="crawl_urls", createTableColumnTypes="run_id VARCHAR(64)").save()
    found = database_rows(spark, url, "run-1", partitions=5)
    assert sorted(x.id for x in found.collect()) == [x[0] for x in rows if x[1] == "run-1"]
    narrow = reports.stored_urls(spark, url, "run-1", partitions="5").select("address")
    assert narrow.rdd.getNumPartitions() == 5 and narrow.count() == 133
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(run_id,run-1)" in plan and "ReadSchema: struct<address:string>" in plan and "numPartitions=5" in plan
    assert database_rows(spark, url, "no'ne").count() == 0 and database_rows(spark, url).count() == 399
    assert reports.report(reports.stored_urls(spark, url).withColumn("timestamp", F.timestamp_seconds("id")).withColumn("external", F.lit(0)), "all", "run-2").count() == 133


def test_settings(tmp_path):
    f = tmp_path / "db"
    f.write_text("# a comment\npassword = a=b\nuser=file\n\n")
    assert settings({"dbtable": "t"}, str(f), {"AUDITLOOM_DB_USER": "env", "AUDITLOOM_DB_DRIVER": "d", "OTHER": "x"}) == {"user": "file", "driver": "d", "password": "a=b", "dbtable": "t"}


def test_file_sink(spark, tmp_path):
    folder = f"{tmp_path}/pages"
    rows = spark.createDataFrame([(f"p{k}.html", f"é {k}\n" if k else None) for k in range(20)], "file_name string, body string").repartition(4)
    write_files(rows, f"file://{folder}")
    assert sorted(os.listdir(folder)) == sorted(f"p{k}.html" for k in range(20)) and open(f"{folder}/p7.html", encoding="utf-8").read() == "é 7\n" and open(f"{folder}/p0.html").read() == ""
    with pytest.raises(Exception, match="broken"):
        write_files(rows.withColumn("body", F.when(F.col("file_name") == "p3.html", F.raise_error(F.lit("broken"))).otherwise("new")), f"file://{folder}")
    assert sorted(os.listdir(folder)) == sorted(f"p{k}.html" for k in range(20)) and open(f"{folder}/p7.html", encoding="utf-8").read() == "é 7\n"
    urls = spark.createDataFrame([(1, "http://h.com/a/b", "text/html", "<p>1", 0), (2, "http://h.com/a/b", "text/html", "<p>2", 0), (3, "http://h.com/c", "text/plain", "no", 0)], "id long, address string, content_type string, body string, timestamp int")
    render.write_html_files(urls, f"{tmp_path}/html")
    assert os.listdir(f"{tmp_path}/html") == ["h.com__a__b.html"] and open(f"{tmp_path}/html/h.com__a__b.html").read() == "<p>2"


def test_sitemaps_of_many_entries_and_their_index(spark, tmp_path):
    from auditloom.sources import sitemaps

    names = [f"http://h.com/map{k}.xml" for k in range(20)]
    for k in range(20):
        n = 12_000 if k == 7 else 300
        with open(tmp_path / f"map{k}.xml", "w") as f:
            f.write('<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
            f.writelines(f"<url><loc>http://h.com/{k}/{i}?a=1&amp;b=2</loc>{'<priority>0.5</priority>' if k % 2 else '<priority></priority>'}<other>x</other></url>\n" for i in range(n))
            f.write("</urlset>")
    for name, held in (("index.xml", [*names[:10], "http://h.com/more.xml", "http://elsewhere.org/x"]), ("more.xml", [*names[8:], "http://h.com/index.xml"])):
        (tmp_path / name).write_text("<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in held) + "</sitemapindex>")
    to_path = lambda c: F.when(c.startswith("http://h.com/"), F.concat(F.lit(f"{tmp_path}/"), F.substring_index(c, "/", -1)))
    found = sitemaps.tree(spark, f"{tmp_path}/index.xml", to_path)
    assert found.count() == 19 * 300 + 12_000 and found.select("loc").distinct().count() == 19 * 300 + 12_000
    assert found.where("loc = 'http://h.com/7/3?a=1&b=2'").count() == 1
    got = {(x.file.rsplit("/", 1)[1], x.n, x.rule) for x in sitemaps.rules(found).collect()}
    assert got == {("map7.xml", 12_000, "E33")} | {(f"map{k}.xml", 12_000 if k == 7 else 300, "I30") for k in range(1, 20, 2)}
    # one file is read by several tasks
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    assert sitemaps.entries(spark, f"{tmp_path}/map7.xml").rdd.getNumPartitions() > 3 and sitemaps.entries(spark, f"{tmp_path}/map7.xml").count() == 12_000
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
