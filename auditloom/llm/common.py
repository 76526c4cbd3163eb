"""What the corpus operators share: table access, shipping the code to executors, and stashed tables.

Column convention: operators first select their inputs under private names (``_id``, ``_text``), so
further columns of a table, whatever they are called, never meet the operators' own.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import shared_dir, ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/auditloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that no later plan reads."""
    sc = df.sparkSession.sparkContext
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
