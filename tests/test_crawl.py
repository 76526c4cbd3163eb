"""The crawl against a plain sequential model of the same rules."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from auditloom.operators.crawl import crawl, processed_urls

FULL = re.compile(r"https?://[a-zA-Z0-9_-]+\.[a-zA-Z]+[^\n]")
NAMES = ("url", "code", "reason", "content", "content_type", "size", "encoding", "response_time")
SCHEMA = "url string, code int, reason string, content string, content_type string, size bigint, encoding string, response_time float"


def loc(u):
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", u)
    return m.group(1) if m else ""


def inside(u, source):
    return not FULL.match(u) or loc(u) == loc(source) or loc(u).endswith(loc(source)) or loc(source).endswith(loc(u))


def model(seeds, web, internal, limit):
    """(address, status, external) per row, and (from, to, type) edges by address, taken one URL at a time."""
    rows, edges, done, queue, waiting, stopped, ids = [], [], {}, list(seeds), {}, False, {}

    def store(url, code, external):
        rows.append((url, code, external))
        return len(rows)

    def get(url):
        return web.get(url, (0, None, [], []))

    while queue:
        url = queue[0]
        if not FULL.match(url):
            done[url] = queue.pop(0) and None
            continue
        done[url] = None
        code, kind, links, assets = get(url)
        me = done[url] = store(url, code, 0)
        if code == 200 and kind == "text/html":
            waiting[url] = {}
            for u in links:
                if "mailto:" in u:
                    continue
                if not inside(u, url):
                    if u not in done:
                        done[u] = store(u, get(u)[0], 1)
                    edges.append((me, done[u], "anchor"))
                elif internal and u not in done and u not in queue:
                    if not stopped:
                        queue.append(u)
                        stopped = bool(limit) and len(queue) >= limit
                    waiting[url][u] = True
            for u in assets:
                if u not in done:
                    done[u] = store(u, get(u)[0], int(not inside(u, url)))
                edges.append((me, done[u], "asset"))
        queue.pop(0)
    for a, found in waiting.items():
        for b in found:
            if done.get(a) and done.get(b) and done[a] != done[b]:
                edges.append((done[a], done[b], "anchor"))
    name = lambda k: rows[k - 1][0]
    del ids
    return rows, sorted((name(a), name(b), t) for a, b, t in edges if a and b)


def build(seed, n=14):
    r = random.Random(seed)
    pages = [f"http://a.example.com/{k}" for k in range(n)]
    others = [f"http://b.example.org/{k}" for k in range(4)] + ["http://sub.a.example.com/s"]
    files = [f"http://cdn.example.net/{k}.png" for k in range(3)] + pages[:2]
    web = {}
    for k, p in enumerate(pages[: n - 2]):
        links = [r.choice(pages + others + ["mailto:x@y.z"]) for _ in range(r.randint(0, 7))]
        web[p] = (200, "text/html" if k % 5 else "text/plain", links, [r.choice(files) for _ in range(r.randint(0, 3))])
    web[pages[0]] = (200, "text/html", pages[1:5] + others, files)
    for o in others[:3]:
        web[o] = (200, "text/html", [], [])
    return pages, web


@pytest.mark.parametrize("seed,internal,limit", [(0, False, 0), (1, True, 0), (2, True, 4), (3, True, 2)])
def test_crawl_follows_the_sequential_rules(spark, tmp_path, seed, internal, limit):
    pages, web = build(seed)
    seeds = [pages[0], "not-absolute", pages[3]]
    rows = []
    for u, (code, kind, links, assets) in web.items():
        body = "<html><head><title>t</title></head><body>" + "".join(f'<a href="{x}">l</a>' for x in links) + "".join(f'<img src="{x}" alt="i">' for x in assets) + "</body></html>"
        rows.append((u, code, "OK", body, kind, None, "utf-8", 0.1))
    _, urls, links, left, _ = crawl(spark, seeds, spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}", internal=internal, limit=limit, run_id="r", clock=F.timestamp_seconds(F.lit(0)))
    want_rows, want_edges = model(seeds, web, internal, limit)
    got = urls.select("id", "address", "status_code", "external").orderBy("id").collect()
    assert [(x.address, x.status_code, x.external) for x in got] == want_rows
    name = {x.id: x.address for x in got}
    assert sorted((name[x.from_url_id], name[x.to_url_id], x.type) for x in links.collect()) == want_edges
    assert left.count() == 0
    assert {x.url: name[x.id] for x in processed_urls(urls, "r").collect()} == {x.address: x.address for x in got}


def test_rounds_of_few_urls_have_few_tasks(spark):
    from auditloom.operators.crawl import _buckets

    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert _buckets(spark) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_a_seed_that_repeats_gets_each_response_once(spark, tmp_path):
    page = lambda k: f'<html><head></head><body><a href="/{k}">l</a></body></html>'
    at = "http://a.example.com/"
    rows = [(f"{at}s", k, 200, "OK", page(k), "text/html", None, "utf-8", 0.1) for k in (0, 1)] + [(f"{at}0", 0, 200, "OK", page("s"), "text/html", None, "utf-8", 0.1)]
    web = spark.createDataFrame(rows, SCHEMA.replace("url string", "url string, turn int"))
    found = crawl(spark, [f"{at}s", f"{at}s"], web, f"file://{tmp_path}", internal=True, run_id="r", clock=F.timestamp_seconds(F.lit(0)))
    got = found.urls.orderBy("id").collect()
    assert [(x.address, x.status_code, x.depth) for x in got] == [(f"{at}s", 200, 0), (f"{at}s", 200, 0), (f"{at}0", 200, 1), (f"{at}1", 0, 1)]
    assert len({x.id for x in got}) == 4


def test_redirect_hops_become_rows(spark, tmp_path):
    hop = [("http://a.example.com/old", 301, "Moved", "", "text/html", 0, None, 0.0)]
    web = spark.createDataFrame([("http://a.example.com/new", 200, "OK", "<html><head></head></html>", "text/html", None, "utf-8", 0.1, hop)], SCHEMA + f", hops array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    _, urls, edges, _, _ = crawl(spark, ["http://a.example.com/new", "http://gone.example.com/x"], web, f"file://{tmp_path}", run_id="r")
    got = urls.orderBy("id").collect()
    assert [(x.address, x.status_code) for x in got] == [("http://a.example.com/new", 200), ("http://a.example.com/old", 301), ("http://gone.example.com/x", 0)]
    assert got[1].lint_results is None and got[0].title_1 == "None"


def hopping_model(seeds, web):
    """As model, for links within the site, with redirect chains and malformed links: rows and edges by row number."""
    rows, edges, done, queue, waiting = [], [], {}, list(seeds), {}

    def store(url, code, external):
        rows.append((url, code, external))
        return len(rows)

    def get(url):
        final, code, kind, links, assets, hops = web.get(url, (url, 0, None, [], [], []))
        return [(final, code)] + [(h, 301) for h in hops], kind, links, assets

    while queue:
        url = queue[0]
        results, kind, links, assets = get(url)
        mine = None
        for k, (u, code) in enumerate(results):
            done[url] = store(u, code, 0)
            mine = mine or done[url]
            if k or code != 200 or kind != "text/html":
                continue
            waiting[url] = {}
            for link in links:
                if "[" in link:
                    done[link] = store(link, 0, 0)
                    edges.append((mine, done[link], "anchor"))
                elif not inside(link, url):
                    if link in done:
                        edges.append((mine, done[link], "anchor"))
                        continue
                    for v, c in get(link)[0]:
                        done[v] = store(v, c, 1)
                        edges.append((mine, done[v], "anchor"))
                elif link not in done and link not in queue:
                    queue.append(link)
                    waiting[url][link] = True
            for asset in assets:
                if asset in done:
                    edges.append((mine, done[asset], "asset"))
                    continue
                for v, c in get(asset)[0]:
                    done[asset] = store(v, c, int(not inside(v, url)))
                    edges.append((mine, done[asset], "asset"))
        queue.pop(0)
    for a, found in waiting.items():
        edges += [(done[a], done[b], "anchor") for b in found if done.get(b) and done[a] != done[b]]
    return rows, sorted(edges)


def hopping_web(asset_hops=3):
    at = lambda k: f"http://a.example.com/{k}"
    out = lambda k: f"http://b.example.org/{k}"
    chain = lambda name, n: [f"{name}"] + [f"{name}/hop{k}" for k in range(1, n)] if n else []
    web = {out(k): (out(k) if not k else f"http://c.example.org/{k}", 200, "text/html", [], [], chain(out(k), k)) for k in range(10)}
    web["http://cdn.example.net/i.png"] = ("http://cdn.example.net/final.png" if asset_hops else "http://cdn.example.net/i.png", 200, "image/png", [], [], chain("http://cdn.example.net/i.png", asset_hops))
    web[at(0)] = (at(0), 200, "text/html", [at(1), out(9), "http://[bad", at(2), out(0), out(9), "http://[bad"], ["http://cdn.example.net/i.png"] * 2, [])
    web[at(1)] = (at("moved"), 200, "text/html", [out(k) for k in range(10)] + [at(3), at(0)], ["http://cdn.example.net/i.png", "http://cdn.example.net/none.png"], chain(at(1), 4))
    web[at(2)] = (at(2), 200, "text/html", [at(1), at(3), at(4), out(5)], [], [])
    web[at(3)] = (at(3), 404, "text/html", [], [], [])
    web[at(4)] = (at(4), 200, "text/html", [at(0), at(5), "http://[bad"], [], [])
    return web


def answers(spark, web):
    hop = f"array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
    rows = []
    for asked, (final, code, kind, links, assets, hops) in web.items():
        body = "<html><head><title>t</title></head><body>" + "".join(f'<a href="{x}">l</a>' for x in links) + "".join(f'<img src="{x}" alt="i">' for x in assets) + "</body></html>"
        rows.append((asked, final, code, "OK", body, kind, None, "utf-8", 0.1, [(h, 301, "Moved", "", "text/html", 0, None, 0.0) for h in hops]))
    return spark.createDataFrame(rows, f"asked string, {SCHEMA}, hops {hop}")


def compare(urls, links, web, seeds):
    want_rows, want_edges = hopping_model(seeds, web)
    got = urls.select("id", "address", "status_code", "external").orderBy("id").collect()
    assert [(x.address, x.status_code, x.external) for x in got] == want_rows
    number = {x.id: k + 1 for k, x in enumerate(got)}
    held = links.collect()
    assert len(number) == len(got) and len({x.id for x in held}) == len(held)
    assert sorted((number[x.from_url_id], number[x.to_url_id], x.type) for x in held) == want_edges


def test_hops_and_malformed_links(spark, tmp_path):
    web, seeds = hopping_web(), ["http://a.example.com/0", "http://a.example.com/2"]
    found = crawl(spark, seeds, answers(spark, web), f"file://{tmp_path}", internal=True, run_id="r", clock=F.timestamp_seconds(F.lit(0)))
    compare(found.urls, found.links, web, seeds)
    assert found.frontier.count() == 0 and found.pending.count() == 0


def lines(d):
    return ["-i", "--web", f"{d}/web", "--jobs", f"{d}/jobs", "--urls", f"{d}/urls", "--links", f"{d}/links"]


def test_stops_and_resumes_give_what_one_crawl_gives(spark, tmp_path, monkeypatch):
    from auditloom import cli
    from auditloom.operators import crawl as C
    from auditloom.operators import reports

    monkeypatch.setattr(C, "COMPACT", 2)
    web, d = hopping_web(), str(tmp_path)
    answers(spark, web).write.parquet(f"{d}/web")
    common = lines(d)
    assert cli.main(["crawl", "-u", "http://a.example.com/0", "--rounds", "1", *common], spark) == 0
    run_id = reports.latest_run(reports.stored_urls(spark, f"{d}/urls")).first()[0]
    for n in ("0", "1", "9"):
        assert os.path.exists(f"{d}/jobs/{run_id}") and cli.main(["crawl", "-r", run_id, "--rounds", n, *common], spark) == 0
    compare(reports.stored_urls(spark, f"{d}/urls", run_id), spark.read.parquet(f"{d}/links"), web, ["http://a.example.com/0"])
    assert not os.path.exists(f"{d}/jobs/{run_id}") and len([n for n in os.listdir(f"{d}/urls/run_id={run_id}") if n.startswith("round=")]) == 4
    with pytest.raises(ValueError, match="has no URLs"):
        cli.main(["crawl", "-r", run_id, *common], spark)
    # reports of the stored table
    for kind in ("build", "status_code", "all"):
        for form in ("junit", "csv", "xls", "sql"):
            assert cli.main(["report", "-t", kind, "-f", form, "--urls", f"{d}/urls", "-o", f"{d}/{kind}.{form}"], spark) == 0
    assert "http://a.example.com/3" in open(f"{d}/build.junit").read()
    assert open(f"{d}/status_code.csv").read().splitlines()[0] == "Run Id,Name,Address,Timestamp,Status Code"
    assert open(f"{d}/build.junit").read().count("<testcase") == 7 and open(f"{d}/all.xls").read().count("<Row>") == 1 + spark.read.parquet(f"{d}/urls").count()
    plan = reports.run_count(reports.stored_urls(spark, f"{d}/urls", run_id), run_id)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "regexp" not in plan and "body" not in plan


class Killed(Exception):
    pass


def test_a_crawl_killed_between_any_two_writes_loses_nothing(spark, tmp_path, monkeypatch):
    from auditloom.operators import crawl as C
    from auditloom.sources import jobs

    web, seeds = hopping_web(), ["http://a.example.com/0", "http://a.example.com/2"]
    table = answers(spark, web)
    left = [0]

    def guarded(kind, name):
        real = getattr(kind, name)

        def write(*a, **kw):
            if left[0] == 0:
                raise Killed
            left[0] -= 1
            return real(*a, **kw)

        monkeypatch.setattr(kind, name, write)

    for kind, name in ((C.Store, "put"), (jobs.SeenLog, "put"), (jobs.Job, "commit"), (jobs.Stored, "put"), (jobs.SeenLog, "keep")):
        guarded(kind, name)
    monkeypatch.setattr(C, "COMPACT", 2)
    deaths = 0
    # the writes after which each attempt dies: between both tables, before a commit, amid a round, behind a commit, amid the last links
    for trial, (tables, budgets) in enumerate((("folder", (15, 14, 22)), ("catalog", (17, 33)))):
        d = f"{tmp_path}/{trial}"
        names = [f"{d}/urls", f"{d}/links"] if tables == "folder" else [f"killed_urls_{trial}", f"killed_links_{trial}"]
        urls, links = (jobs.Stored(spark, n) for n in names)

        def sink(number, pages, edges):
            if pages is not None:
                urls.put(pages.drop("depth"), "r", number)
            links.put(edges, "r", number)

        def discard(number):
            urls.discard("r", number)
            links.discard("r", number)

        for budget in (*budgets, -1):
            left[0] = budget
            begun = jobs.Job(spark, f"file://{d}/job").latest() is not None
            try:
                C.crawl(spark, None if begun else seeds, table, f"file://{d}/job", internal=True, run_id="r", clock=F.timestamp_seconds(F.lit(0)), sink=sink, discard=discard)
            except Killed:
                deaths += 1
        left[0] = -1
        compare(*(spark.read.parquet(n) if "/" in n else spark.table(n) for n in names), web, seeds)
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}") if "/" not in n else None
    assert deaths == 5


def test_a_round_shuffles_what_it_meets_not_what_was_seen(spark, tmp_path):
    from auditloom.sources.jobs import SeenLog

    log = SeenLog(spark, f"file://{tmp_path}/seen", 8)
    log.put(spark.range(5000).selectExpr("concat('http://x/', id) AS url", "id"), 2)
    log.put(spark.createDataFrame([("http://x/7", 9007), ("http://x/8", None), ("http://y/", None)], "url string, id long"), 4)
    wanted = spark.createDataFrame([(f"http://x/{k}",) for k in (7, 8, 9, 99999)] + [("http://y/",)] * 3, "url string")
    found = log.find(wanted, 0, 4)
    assert {x.url: x.id for x in found.collect()} == {"http://x/7": 9007, "http://x/8": 8, "http://x/9": 9, "http://y/": None}
    assert {x.url: x.id for x in log.find(wanted, 0, 2).collect()} == {"http://x/7": 7, "http://x/8": 8, "http://x/9": 9}
    for joins in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
        plan = log.find(wanted, 0, 4)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(_w" in plan, plan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert log.compact(0, 4) == 5 and log.parts() == [2, 4, 5]
    log.keep(5, 6)
    again = SeenLog(spark, f"file://{tmp_path}/seen", 8)
    assert again.parts() == [5] and {x.url: x.id for x in again.find(wanted, 5, 6).collect()} == {"http://x/7": 9007, "http://x/8": 8, "http://x/9": 9, "http://y/": None}
    again.close()
