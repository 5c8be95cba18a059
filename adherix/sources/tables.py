"""Sinks and sources of the engine's own tables: the similarity index, results and their explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(index: DataFrame, path: str) -> None:
    """The index as Parquet, one folder per commit and domain; the commits written replace their earlier versions only."""
    spark = index.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        index.repartition("commit_id", "domain").write.mode("overwrite").partitionBy("commit_id", "domain").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read_index(spark: SparkSession, path: str, commit: str | None = None, domains: list[str] | None = None) -> DataFrame:
    """The index; a commit and domains are pruned to their folders."""
    df = spark.read.parquet(path)
    if commit is not None:
        df = df.where(F.col("commit_id") == commit)
    return df if domains is None else df.where(F.col("domain").isin(domains))


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as JSON lines; timestamps and numbers as text that reads back."""
    results.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def explain_file(results: DataFrame, path: str) -> DataFrame:
    """The result rows of one file."""
    return results.where(F.col("path") == path)


def excluded(path: Column) -> Column:
    """Whether a scan leaves a path out: tool folders, tests and generated files."""
    low = F.lower(path)
    return path.rlike(r"__pycache__|\.git|node_modules|\.venv|dist|build|\.next") | low.rlike(r"test_|_test\.|\.test\.|spec_|_spec\.|\.spec\.") | path.rlike(r"\.generated\.|_generated\.|\.d\.ts")
