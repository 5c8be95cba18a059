"""Commits: metadata, parents, changed lines, arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adherix.functions.records import latest


def commits(raw: DataFrame) -> DataFrame:
    """One record per commit: its last delivery, with null counts as 0 and an empty message for none."""
    one = latest(raw, ["commit_id"], ["ingested_at"])
    return one.withColumns({"message": F.coalesce("message", F.lit("")), "insertions": F.coalesce("insertions", F.lit(0)), "deletions": F.coalesce("deletions", F.lit(0))})


def resolve_parent(raw: DataFrame) -> DataFrame:
    """commit_id, repo, parent_id, indexed_commit: the first parent where there is one that is known, else the commit itself."""
    c = commits(raw).select("commit_id", "repo", F.try_element_at("parent_ids", F.lit(1)).alias("parent_id"))
    known = c.select(F.col("commit_id").alias("parent_id"), F.col("commit_id").alias("found"))
    return c.join(known, "parent_id", "left").select("commit_id", "repo", "parent_id", F.coalesce("found", "commit_id").alias("indexed_commit"))


def changed_lines(patch: Column) -> Column:
    """The added lines of a patch: those that begin with one plus sign, without it."""
    added = F.filter(F.split(patch, "\n", -1), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(added, lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")


def lateness(raw: DataFrame, days: int = 2) -> DataFrame:
    """Per repo: commits, those that arrived more than ``days`` days late, and the longest delay in seconds."""
    d = F.unix_timestamp("ingested_at") - F.unix_timestamp("committed_at")
    return commits(raw).withColumn("delay", d).groupBy("repo").agg(F.count("*").alias("commits"), F.count_if(F.col("delay") > days * 86400).alias("late"), F.max("delay").alias("longest"))
