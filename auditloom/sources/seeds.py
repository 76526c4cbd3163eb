"""Where URLs come from: files, single seeds, YAML lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def url_file(spark: SparkSession, path: str) -> DataFrame:
    """(pos, url): a stripped URL per line in file order, blank lines kept as ''."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("pos", "url"))
    return lines.select(F.col("pos").cast("long").alias("pos"), F.regexp_replace("url", r"^\s+|\s+$", "").alias("url"))


def seed(spark: SparkSession, url: str) -> DataFrame:
    return spark.createDataFrame([(0, url)], "pos long, url string")


def yaml_urls(spark: SparkSession, path: str, key: str = "urls") -> DataFrame:
    """The list under a key; none if it is absent."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML lists need the yaml package") from e
    with open(path, encoding="utf-8") as f:
        urls = (yaml.safe_load(f) or {}).get(key) or []
    return spark.createDataFrame(list(enumerate(urls)), "pos long, url string")


def document(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one ``text``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
