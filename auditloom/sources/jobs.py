"""The durable state of a crawl: a log of commits, the URLs it has seen, and rows stored by run and round.

A crawl that stops anywhere goes on from its last commit. Whatever was written after it (a round's tables, a part of the seen
URLs, partitions of the stored rows) bears the number of a round that was not committed, and is dropped or replaced by that round's
next attempt; so each row is stored once, wherever the crawl stopped.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = self.fs.makeQualified(self._path(path)).toString()

    def names(self, below: str = "") -> list[str]:
        p = self._path(f"{self.path}/{below}" if below else self.path)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A whole file or none: written aside, then renamed."""
        aside, to = self._path(f"{self.path}/.{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(to.getParent())
        if not self.fs.rename(aside, to):
            raise OSError(f"{to.toString()} can't be written")

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(f"{self.path}/{name}" if name else self.path), True)


class Job(Folder):
    """A crawl's folder. Commits are files in ``commits``, numbered by round; the last one counts."""

    def commit(self, number: int, state: dict) -> None:
        self.write(f"commits/{number:08d}.json", json.dumps(state | {"round": number}))

    def latest(self) -> dict | None:
        held = [n for n in self.names("commits") if n.endswith(".json") and not n.startswith(".")]
        return json.loads(self.read(f"commits/{held[-1]}")) if held else None


class SeenLog:
    """Seen URLs with their ids, as a table in buckets of the URL that is only appended to: a part for each round.

    Looking URLs up shuffles them to the buckets, never the log. The newest part that has an id for a URL counts. Now and then all parts
    are rewritten as one, with an odd number between those of the rounds (round n is part 2 * n), so a look-up opens few files.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.buckets, self.held = spark, buckets, Folder(spark, folder)
        self.name = f"auditloom_seen_{hashlib.md5(self.held.path.encode()).hexdigest()[:16]}"
        self.held.fs.mkdirs(self.held._path(self.held.path))
        place = self.held.path.replace("'", "\\'")
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # the folder stays
        spark.sql(f"CREATE TABLE {self.name} (url STRING, id BIGINT, part BIGINT) USING parquet PARTITIONED BY (part) CLUSTERED BY (url) INTO {buckets} BUCKETS LOCATION '{place}'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def parts(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.held.names() if n.startswith("part="))

    def keep(self, first: int, last: int) -> None:
        """Drops the parts outside of these bounds."""
        for p in self.parts():
            if not first <= p <= last:
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (part = {p})")
                self.held.delete(f"part={p}")

    @staticmethod
    def newest() -> Column:
        return F.max(F.struct(F.when(F.col("id").isNotNull(), F.col("part")).otherwise(-1).alias("p"), F.col("id")))["id"]

    def put(self, urls: DataFrame, part: int) -> DataFrame:
        """Writes (url, id) as a part, in place of what an attempt before wrote, and reads it back."""
        view = f"{self.name}_new"
        urls.select("url", F.col("id").cast("long").alias("id")).repartition(self.buckets, "url").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (part = {part}) SELECT url, id FROM {view}")
        self.spark.catalog.dropTempView(view)
        return self.spark.table(self.name).where(F.col("part") == part).select("url", "id")

    def find(self, urls: DataFrame, first: int, last: int) -> DataFrame:
        """(url, id) of those of ``url`` that the parts within these bounds hold."""
        wanted = urls.select(F.col("url").alias("_w")).repartition(self.buckets, "_w").distinct()
        log = self.spark.table(self.name).where(F.col("part").between(first, last))
        return log.join(wanted, F.col("url") == F.col("_w")).groupBy("url").agg(self.newest().alias("id"))

    def compact(self, first: int, last: int) -> int:
        """Rewrites the parts within these bounds as the part behind them; they may go once that is committed."""
        log, aside = self.spark.table(self.name).where(F.col("part").between(first, last)), f"{self.held.path}-compacted"
        log.groupBy("url").agg(self.newest().alias("id")).write.mode("overwrite").parquet(aside)  # a table can't be read and written at once
        self.put(self.spark.read.parquet(aside), last + 1)
        return last + 1

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class Stored:
    """Rows of crawls in a catalog table, or the folder of one, partitioned by run_id and round; a round replaces its own partition only."""

    def __init__(self, spark: SparkSession, to: str):
        self.spark, self.to, self.is_folder = spark, to, "/" in to

    def put(self, rows: DataFrame, run_id: str, number: int) -> None:
        cols = [c for c in rows.columns if c not in ("run_id", "round")]
        laid = rows.select(*cols, F.lit(run_id).alias("run_id"), F.lit(number).alias("round"))
        if self.is_folder:
            laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "round").parquet(self.to)
            return
        if not self.spark.catalog.tableExists(self.to):
            laid.limit(0).write.partitionBy("run_id", "round").saveAsTable(self.to)
        view = f"auditloom_{uuid.uuid4().hex}"
        laid.createOrReplaceTempView(view)
        held = ", ".join(f"`{c}`" for c in self.spark.table(self.to).columns if c not in ("run_id", "round"))
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.to} PARTITION (run_id = '{run_id}', round = {number}) SELECT {held} FROM {view}")
        self.spark.catalog.dropTempView(view)

    def discard(self, run_id: str, after: int) -> None:
        """Drops a run's rounds behind one: what an attempt wrote that was not committed."""
        if self.is_folder:
            run = Folder(self.spark, f"{self.to}/run_id={run_id}")
            for n in run.names():
                if n.startswith("round=") and int(n.split("=")[1]) > after:
                    run.delete(n)
        elif self.spark.catalog.tableExists(self.to):
            for (spec,) in self.spark.sql(f"SHOW PARTITIONS {self.to} PARTITION (run_id = '{run_id}')").collect():  # a row for each round of the run
                n = int(spec.rsplit("=", 1)[1])
                if n > after:
                    self.spark.sql(f"ALTER TABLE {self.to} DROP IF EXISTS PARTITION (run_id = '{run_id}', round = {n})")
