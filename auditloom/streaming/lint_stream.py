"""Lint a stream of pages: the projection has no shuffle and no state, so it streams as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.operators.lint import lint_pages

PAGES = "page_id bigint, url string, html string"


def pages_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def lint_stream(pages: DataFrame) -> DataFrame:
    return lint_pages(pages).select("page_id", "url", "lint")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Append lint results to a Parquet folder until stopped; exactly once through the checkpoint."""
    return lint_stream(pages_stream(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
