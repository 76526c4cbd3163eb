"""Frontier expansion over a web snapshot, in rounds that keep first-in-first-out order.

Each URL of a round has a rank. What happens while a page is processed is an event with a place in
the sequence (rank, phase, position): its own turn, its links, its assets. Whether a link is queued or
an external address fetched depends only on earlier events of the same URL, so a round is one
projection, a few anti-joins and minima by URL; nothing but counts comes to the driver. What earlier rounds have seen is a log in buckets
of the URL: a round looks up the URLs it meets and appends its own, so what it shuffles grows with the round, not with the crawl.

``web`` holds a response per URL: url, code, reason, content, content_type, size, encoding,
response_time, and optionally ``asked``, the address that it answers where that is not its own, and ``hops``, an array of
such structs for the redirects before it. Where it holds several responses for a URL, ``turn`` numbers them from 0: a seed that comes up
again gets the next one, whatever else asks for the URL the first. URLs that it lacks get code 0. Each response, hops too, is a row and, for links
and assets, an edge.

Ids of rows and edges are their places in the sequence, packed: 31 bits of the page's rank, one for its assets, 21 of the
position on the page and 10 of the hop. So they are unique and ascend as a sequential crawl would insert; what doesn't fit fails.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.urls import ascii_only, is_full_url, same_site
from auditloom.operators.ingest import LINK_SCHEMA, URL_SCHEMA, crawl_urls, parse_responses
from auditloom.sources.jobs import Job, SeenLog

RESPONSE = ("url", "code", "reason", "content", "content_type", "size", "encoding", "response_time")
TURN, LINKS, ASSETS = 0, 1, 2
#: The position, among assets, of the redirects before a page.
LAST = (1 << 21) - 2


class Store:
    """Tables of a crawl's rounds; each is written once, so a lost executor repeats no round. A round's next attempt replaces its tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.round, self.n = spark, folder.rstrip("/"), 0, 0

    def begin(self, number: int) -> None:
        self.round, self.n = number, 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/round-{self.round:05d}/{self.n:02d}-{name}"
        df.write.mode("overwrite").parquet(path)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[str], first: int, name: str, store: Store) -> DataFrame:
    """df with ``rank`` counting from first in the given order: a range sort and the partitions' own counts, no single-task sort."""
    laid = store.put(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), name)
    sizes = laid.groupBy("_pid").agg(F.count("*").alias("n"))  # a row per partition, summed up in one task
    before = sizes.select(F.col("_pid").alias("_p"), F.coalesce(F.sum("n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_pid").orderBy(*order)
    return laid.join(F.broadcast(before), F.col("_pid") == F.col("_p")).withColumn("rank", F.row_number().over(w) + F.col("_before") + (first - 1)).drop("_pid", "_p", "_before")


def _fetch(urls: DataFrame, web: DataFrame) -> DataFrame:
    """(all columns of urls, hop, response): the final response first, then redirect hops. urls may have a ``turn``; without, it is 0."""
    has_hops = "hops" in web.columns
    key = F.coalesce("w.asked", "w.url") if "asked" in web.columns else F.col("w.url")
    one = F.struct(*[F.col(f"w.{c}").alias(c) for c in RESPONSE])
    missing = F.struct(F.col("u.url").alias("url"), F.lit(0).alias("code"), F.lit("Connection Error").alias("reason"), *[F.lit(None).cast(web.schema[c].dataType).alias(c) for c in RESPONSE[3:]])
    found = F.when(F.col("w.url").isNull(), F.array(missing)).otherwise(F.concat(F.array(one), F.coalesce(F.col("w.hops"), F.array())) if has_hops else F.array(one))
    asks = F.col("u.url") == key
    if "turn" in web.columns:
        asks &= F.col("w.turn") == (F.col("u.turn") if "turn" in urls.columns else F.lit(0))
    return urls.alias("u").join(web.alias("w"), asks, "left").select("u.*", F.posexplode(found).alias("hop", "r"))


def _id(rank: Column, phase: Column, pos: Column, hop: Column) -> Column:
    """The packed place. The page's own turn has position 0, its links and assets are counted from 1, and its redirects come last."""
    fits = (rank < (1 << 31)) & (pos <= LAST) & (hop < (1 << 10))
    packed = rank * (1 << 32) + (phase == ASSETS).cast("long") * (1 << 31) + (pos + 1).cast("long") * (1 << 10) + hop
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("a crawl of more pages, links a page or redirects than ids have room for")).cast("long"))


class Crawl(NamedTuple):
    run_id: str
    urls: DataFrame
    links: DataFrame
    #: (url, rank) of what is still queued, and the links found but not yet resolved: what a later part needs.
    frontier: DataFrame
    pending: DataFrame


PENDING = "from_url string, to_url string, text string, alt string, rel string, seq struct<rank:bigint,phase:int,pos:int>"
FRONTIER = "url string, rank bigint"
#: Rounds after which the seen URLs are rewritten as one part.
COMPACT = 16


def _buckets(spark: SparkSession) -> int:
    """Buckets of the seen URLs: each round writes and reads them all, so a few for each core rather than as many as a large shuffle has."""
    return max(4, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def crawl(spark: SparkSession, seeds: list[str] | DataFrame | None, web, folder: str, internal: bool = False, limit: int = 0, run_id: str | None = None, clock: Column | None = None, max_rounds: int | None = None, full_graph: bool = False, sink=None, discard=None) -> Crawl:
    """Crawls web from seeds: URLs in order, or a table of (url, pos). Without seeds, goes on with the crawl that folder holds.

    web: the table of responses, or what fetches one: web(urls, full) for a table of urls, full where pages are wanted
    with their bodies; what it returns is stored before it is read.
    internal: follow links within the site. limit: stop queuing for good once the queue is this long. full_graph: record
    every internal link, not only first discoveries. max_rounds: stop after so many rounds.
    sink(number, urls, links): stores a round's rows, before the round is committed; links between pages, which are resolved when the
    queue is empty, as either end may be fetched later, come last, with urls None. discard(number): drops what was stored for rounds after it.

    The folder holds the state: each round ends with a commit, and a crawl that dies goes on from the last one.
    """
    job = Job(spark, folder)
    state = job.latest()
    clock = F.current_timestamp() if clock is None else clock
    store = Store(spark, job.path)
    if seeds is None:
        if state is None or state["done"]:
            raise ValueError(f"the job {folder} has no URLs left")
        frontier, total, stopped, depth, run_id = spark.read.schema(FRONTIER).parquet(state["frontier"]), state["total"], state["stopped"], state["depth"], state["run_id"]
        waiting = [spark.read.schema(PENDING).parquet(p) for p in state["pending"]]
    else:
        if state is not None:
            raise ValueError(f"the folder {folder} holds a crawl")
        run_id = run_id or str(uuid.uuid4())
        start = seeds if isinstance(seeds, DataFrame) else spark.createDataFrame([(i, u) for i, u in enumerate(seeds)], "pos long, url string")
        frontier = store.put(start.select("url", F.col("pos").cast("long").alias("rank")), "frontier")
        total, stopped, depth, waiting = (frontier.agg(F.max("rank")).first()[0] or 0) + 1, False, 0, []
        state = {"round": 0, "run_id": run_id, "frontier": store.last, "total": total, "stopped": False, "depth": 0, "pending": [], "floor": 0, "buckets": _buckets(spark), "done": False}
        job.commit(0, state)
    log = SeenLog(spark, f"{job.path}/seen", state["buckets"])
    number = state["round"]
    log.keep(state["floor"], 2 * number)
    if discard is not None:
        discard(number)
    pages, edges, rounds = [], [], 0
    zero = F.lit(0)

    def answers(urls: DataFrame, full: bool) -> DataFrame:
        return _fetch(urls, store.put(web(urls.select("url"), full), "responses") if callable(web) else web)

    while not frontier.isEmpty() and (max_rounds is None or rounds < max_rounds):
        rounds, number = rounds + 1, number + 1
        store.begin(number)
        floor = state["floor"]
        if len([p for p in log.parts() if p >= floor]) >= COMPACT:
            floor = log.compact(floor, 2 * (number - 1))
        turn = frontier.where(is_full_url(F.col("url")))
        if number == 1 and not callable(web) and "turn" in web.columns:
            turn = turn.withColumn("turn", F.row_number().over(Window.partitionBy("url").orderBy("rank")) - 1)  # only seeds repeat
        got = answers(turn, True).withColumn("asked", F.col("url")).select("rank", "hop", "asked", "r.*")
        parsed = store.put(parse_responses(got), "parsed")
        first = F.col("hop") == 0
        own = parsed.withColumn("id", F.when(first, _id(F.col("rank"), F.lit(TURN), F.lit(-1), zero)).otherwise(_id(F.col("rank"), F.lit(ASSETS), F.lit(LAST), F.col("hop")))).withColumn("external", zero)
        html = own.where(F.col("doc").isNotNull() & first)
        none = F.lit(None).cast("string")
        base = ("rank", "asked", F.col("id").alias("from_id"))
        links = html.select(*base, F.posexplode("doc.links").alias("pos", "x")).select("rank", "asked", "from_id", F.lit(LINKS).alias("phase"), "pos", "x.url", "x.valid", "x.text", "x.alt", F.array_join("x.rel", " ").alias("rel"))
        assets = html.select(*base, F.posexplode("doc.sources").alias("pos", "x")).select("rank", "asked", "from_id", F.lit(ASSETS).alias("phase"), "pos", "x.url", F.lit(True).alias("valid"), none.alias("text"), "x.alt", none.alias("rel"))
        inside = same_site(F.col("url"), F.col("asked"))
        kind = F.when(F.col("phase") == ASSETS, "asset").when(~F.col("valid"), "malformed").when(~inside, "external").otherwise("internal")
        seq = F.struct("rank", "phase", "pos")
        events = store.put(links.unionByName(assets).withColumn("kind", kind).withColumn("seq", seq), "events")
        # of the URLs seen in earlier rounds, those that this one meets
        known = store.put(log.find(events, floor, 2 * number - 1), "known")
        # a URL's first event that marks it processed: its own turn, a malformed link, an external or asset fetch
        turns = frontier.select("url", F.struct("rank", F.lit(TURN).alias("phase"), F.lit(-1).alias("pos")).alias("seq"))
        marks = turns.unionByName(events.where("kind <> 'internal'").select("url", "seq")).groupBy("url").agg(F.min("seq").alias("first"))
        outer = events.where("kind in ('external', 'asset')")
        fetches = outer.join(known.select(F.col("url").alias("_s")), F.col("url") == F.col("_s"), "left_anti").join(marks.select(F.col("url").alias("_m"), "first"), F.col("url") == F.col("_m")).where(F.col("seq") == F.col("first")).drop("_m", "first")
        fetches = store.put(fetches, "fetches")
        fetched = answers(fetches.withColumn("link", F.col("url")), False).select("rank", "phase", "pos", "kind", "asked", "link", "from_id", "text", "alt", "rel", "hop", "r.*")
        fetched = fetched.withColumn("id", _id(F.col("rank"), F.col("phase"), F.col("pos"), F.col("hop")))
        fetched = store.put(fetched.withColumn("external", F.when(F.col("kind") == "external", 1).otherwise((~same_site(F.col("url"), F.col("asked"))).cast("int"))), "fetched")
        bad = events.where("kind = 'malformed'").select("rank", "url", "seq", "from_id", "text", "alt", "rel", _id(F.col("rank"), F.col("phase"), F.col("pos"), zero).alias("id"))
        taken = ("link", "from_id", "text", "alt", "rel", "kind", "phase", "pos")
        rows = own.unionByName(fetched.drop(*taken), allowMissingColumns=True).unionByName(bad.select("id", "url", zero.alias("code"), zero.alias("external")), allowMissingColumns=True)
        stamped = rows.withColumn("run_id", F.lit(run_id)).withColumn("timestamp", clock)
        pages.append(store.put(crawl_urls(stamped).withColumn("depth", F.lit(depth)), "pages"))
        # ids by URL: the last row of an asked URL stands for it; an external response stands for its own address too
        ids = own.select(F.col("asked").alias("url"), "id").unionByName(fetched.select(F.col("link").alias("url"), "id")).unionByName(fetched.where("kind = 'external'").select("url", "id")).unionByName(bad.select("url", "id"))
        answered = fetched.where("kind = 'external' and url = link").select("url", F.col("id").alias("_own"))
        skipped = frontier.where(~is_full_url(F.col("url"))).select("url", F.lit(None).cast("long").alias("id"))
        latest = ids.unionByName(skipped).groupBy("url").agg(F.max("id").alias("id"))
        own_answer = answered.groupBy(F.col("url").alias("_u")).agg(F.max("_own").alias("_own"))
        fresh_ids = log.put(latest.join(own_answer, F.col("url") == F.col("_u"), "left").select("url", F.coalesce("_own", "id").alias("id")), 2 * number)
        # ids of later rounds are greater, so the greatest is the newest
        held_ids = known.unionByName(fresh_ids).groupBy("url").agg(F.max("id").alias("id"))
        named = F.when(F.col("kind") == "asset", "asset").otherwise("anchor").alias("type")
        later = outer.join(fetches.select(F.col("seq").alias("_q")), F.col("seq") == F.col("_q"), "left_anti").join(held_ids.select(F.col("url").alias("_t"), F.col("id").alias("to_id")), F.col("url") == F.col("_t"))
        out = fetched.select("id", "from_id", F.col("id").alias("to_id"), named, "text", "alt", "rel")
        out = out.unionByName(later.select(_id(F.col("rank"), F.col("phase"), F.col("pos"), zero).alias("id"), "from_id", "to_id", named, "text", "alt", "rel"))
        out = out.unionByName(bad.select("id", "from_id", F.col("id").alias("to_id"), F.lit("anchor").alias("type"), "text", "alt", "rel"))
        edges.append(store.put(out, "edges"))
        frontier_at, pending_at = None, state["pending"]
        if internal:
            inner = events.where("kind = 'internal'")
            # what was queued earlier has had its turn, and so has been seen
            queued = known.select("url").unionByName(frontier.select("url")).distinct().withColumnRenamed("url", "_k")
            new = inner.join(queued, F.col("url") == F.col("_k"), "left_anti").join(marks.withColumnsRenamed({"url": "_m"}), F.col("url") == F.col("_m"), "left").where(F.col("first").isNull() | (F.col("seq") < F.col("first"))).drop("_m", "first")
            firsts = new.groupBy("url").agg(F.min("seq").alias("seq")).select("url", "seq", F.col("seq.rank").alias("parent"), F.col("seq.pos").alias("pos"))
            placed = ranked(firsts, ["parent", "pos"], total, "ranked", store)
            if limit:
                # queue length when a candidate comes: all queued before it, less those popped before its parent
                length = F.col("rank") + 1 - F.col("parent")
                cut = None if stopped else placed.where(length >= limit).agg(F.min("rank")).first()[0]
                placed = placed.where(F.lit(False)) if stopped else placed.where(F.col("rank") <= cut) if cut is not None else placed
                stopped = stopped or cut is not None
            # a queued URL is pending from the page that queued it; one past the limit, from every page that links to it
            by = placed.select(F.col("url").alias("_p"), F.col("seq").alias("_seq"))
            every = inner if full_graph else new.join(by, F.col("url") == F.col("_p"), "left").where(F.col("_seq").isNull() | (F.col("seq") == F.col("_seq")))
            waiting.append(store.put(every.select(F.col("asked").alias("from_url"), F.col("url").alias("to_url"), "text", "alt", "rel", "seq"), "pending"))
            pending_at = [*pending_at, store.last]
        fresh = placed.select("url", F.col("rank").cast("long").alias("rank")) if internal else spark.createDataFrame([], FRONTIER)
        frontier = store.put(fresh, "frontier")
        frontier_at, depth = store.last, depth + 1
        total += frontier.count()
        if sink is not None:
            sink(number, pages[-1], _named(edges[-1], run_id))
        state = state | {"round": number, "frontier": frontier_at, "total": total, "stopped": stopped, "depth": depth, "pending": pending_at, "floor": floor}
        job.commit(number, state)
        log.keep(floor, 2 * number)
    held = _union(waiting, spark, PENDING)
    if frontier.isEmpty():
        store.begin(number + 1)
        # of repeated discoveries of a link by one page, the last stands
        last = held.groupBy("from_url", "to_url").agg(F.max("seq").alias("seq"), F.max_by(F.struct("text", "alt", "rel"), "seq").alias("x"))
        ends = store.put(log.find(held.select(F.explode(F.array("from_url", "to_url")).alias("url")), state["floor"], 2 * number), "ends")
        f, t = ends.select(F.col("url").alias("_f"), F.col("id").alias("from_id")), ends.select(F.col("url").alias("_t"), F.col("id").alias("to_id"))
        found = last.join(f, F.col("from_url") == F.col("_f")).join(t, F.col("to_url") == F.col("_t")).where("from_id <> to_id")
        edges.append(store.put(found.select(_id(F.col("seq.rank"), F.col("seq.phase"), F.col("seq.pos"), zero).alias("id"), "from_id", "to_id", F.lit("anchor").alias("type"), "x.text", "x.alt", "x.rel"), "resolved"))
        if sink is not None:
            sink(number + 1, None, _named(edges[-1], run_id))
        job.commit(number + 1, state | {"done": True})
        held = held.limit(0)
    log.close()
    urls = _union(pages, spark, URL_SCHEMA + ", depth int")
    links_out = _union(edges, spark, "id long, from_id long, to_id long, type string, text string, alt string, rel string")
    return Crawl(run_id, urls, _named(links_out, run_id), frontier, held)


def _named(edges: DataFrame, run_id: str) -> DataFrame:
    """Edges with both ends as rows of crawl_links."""
    keep = lambda c: F.when(F.col(c) != "", ascii_only(F.col(c)))
    named = edges.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select("id", F.lit(run_id).alias("run_id"), "type", F.col("from_id").alias("from_url_id"), F.col("to_id").alias("to_url_id"), keep("text").alias("link_text"), keep("alt").alias("alt_text"), "rel")
    return named.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in LINK_SCHEMA.split(", ")])


def _union(parts: list[DataFrame], spark: SparkSession, schema: str | None) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema or "id long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def processed_urls(urls: DataFrame, run_id: str) -> DataFrame:
    """(url, id) of a run: of rows with one address, the last."""
    return urls.where(F.col("run_id") == run_id).groupBy(F.col("address").alias("url")).agg(F.max("id").alias("id"))
