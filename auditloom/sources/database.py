"""Stored rows in a database: reads split by id, with the run's filter and the columns wanted pushed down to it."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

PREFIX = "AUDITLOOM_DB_"


def settings(given: Mapping[str, str] | None = None, file: str | None = None, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of a jdbc source: from the environment (``AUDITLOOM_DB_USER`` is ``user``), over it from a file of NAME=VALUE lines, over both those given.

    So a password need not stand on a command line.
    """
    env = os.environ if env is None else env
    out = {k.removeprefix(PREFIX).lower(): v for k, v in env.items() if k.startswith(PREFIX)}
    if file:
        with open(file, encoding="utf-8") as f:
            for line in f:
                name, equals, value = line.strip().partition("=")
                if equals and not name.startswith("#"):
                    out[name.strip()] = value.strip()
    return out | dict(given or {})


def database_rows(spark: SparkSession, url: str, run_id: str | None = None, partitions: int = 16, key: str = "id", **options: str) -> DataFrame:
    """Rows of a table (``dbtable``, crawl_urls without) in ``partitions`` ranges of its key.

    The ranges lie between the least and the greatest key of the run, which the database tells; rows without a key are in the first.
    With a run id only its rows are read. A table without rows is one range.
    """
    options = {"dbtable": "crawl_urls"} | options
    quote = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    where = "" if run_id is None else f" WHERE {quote('run_id')} = '{run_id.replace(chr(39), chr(39) * 2)}'"
    plain = {k: v for k, v in options.items() if k != "dbtable"}
    bounds = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({quote(key)}) AS lo, MAX({quote(key)}) AS hi FROM {options['dbtable']}{where}", **plain).load().first()
    if bounds[0] is not None:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1] + 1), "numPartitions": str(partitions)}
    rows = spark.read.format("jdbc").options(url=url, **options).load()
    return rows if run_id is None else rows.where(rows["run_id"] == run_id)
