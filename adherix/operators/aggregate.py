"""Weighted aggregation of scores, and the roll-ups of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("weighted_average", "weighted_harmonic_mean", "weighted_geometric_mean")
_LEAST = 1e-8


def check_weights(weights: dict[str, float], scores: dict[str, float] | None = None, method: str | None = None) -> None:
    """Raises ValueError unless the weights are non-negative and add up to 1, the scores lie in [0, 1] and the method is known."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    total = sum(weights.values())
    if abs(total - 1.0) > 0.01:
        raise ValueError(f"weights must add up to 1, not {total}")
    if any(not 0 <= s <= 1 for s in (scores or {}).values()):
        raise ValueError("scores must lie between 0 and 1")
    if method is not None and method not in METHODS:
        raise ValueError(f"unknown method {method}")


def checked(scores: DataFrame) -> DataFrame:
    """The rows, failing where a score leaves [0, 1] or a weight is negative."""
    fine = F.col("score").between(0, 1) & (F.col("weight") >= 0)
    return scores.withColumn("score", F.when(fine | F.col("score").isNull() | F.col("weight").isNull(), F.col("score")).otherwise(F.raise_error(F.lit("score or weight out of range")).cast("double")))


def dimension_mean(scores: DataFrame, group: str = "analyzer") -> DataFrame:
    """Mean score per engine, without the files of unknown domain where some are known."""
    known = F.col("domain") != "unknown"
    return scores.groupBy(group).agg(F.coalesce(F.avg(F.when(known, F.col("score"))), F.avg("score")).alias("score"), F.count("*").alias("files"))


def aggregate(scores: DataFrame, keys: list[str], dimension: str = "dimension") -> DataFrame:
    """Per group of ``keys`` the three weighted means, the confidence and the spread of (dimension, score, weight) rows.

    Weights are normalised to 1; where they add up to 0 all weigh the same.  Null
    scores and weights take no part; a group without any gives no row.
    """
    df = scores.where("score IS NOT NULL AND weight IS NOT NULL")
    total = F.sum("weight").over(Window.partitionBy(*keys))
    n = F.count("*").over(Window.partitionBy(*keys))
    w = F.when(total == 0, 1.0 / n).otherwise(F.try_divide("weight", total))
    df = df.withColumn("w", w)
    s = F.greatest(F.col("score"), F.lit(_LEAST))
    entropy = -F.sum(F.when(F.col("w") > 0, F.col("w") * F.ln(F.col("w") + _LEAST)).otherwise(0.0))
    g = df.groupBy(*keys).agg(
        F.sum(F.col("score") * F.col("w")).alias("weighted_average"), (1 / F.sum(F.col("w") / s)).alias("weighted_harmonic_mean"), F.exp(F.sum(F.col("w") * F.ln(s))).alias("weighted_geometric_mean"),
        F.var_pop("score").alias("_var"), entropy.alias("_h"), F.avg("score").alias("mean"), F.percentile("score", 0.5).alias("median"), F.stddev_pop("score").alias("std"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"),
    )
    confidence = F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 / (1 + F.col("_var")) + 0.3 * F.try_divide("_h", F.ln(F.col("n").cast("double"))) + 0.3 * F.col("mean"))))
    return g.select(*keys, *METHODS, confidence.alias("confidence"), "mean", "median", "std", "low", "high", (F.col("high") - F.col("low")).alias("range"), "n")


def importance(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each dimension in the sum of the absolute contributions of its group."""
    c = F.abs(F.col("score") * F.col("weight"))
    return scores.select(*keys, "dimension", c.alias("contribution")).withColumn("importance", F.coalesce(F.try_divide("contribution", F.sum("contribution").over(Window.partitionBy(*keys))), F.lit(0.0)))


def code_focused(scores: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """Mean score weighted by the domain's importance, without unknown rows where any row of the group is known."""
    w = F.coalesce(F.create_map(*[x for d, v in weights.items() for x in (F.lit(d), F.lit(v))])[F.col("domain")], F.lit(0.5))
    known = F.col("domain") != "unknown"
    g = scores.withColumn("w", w).groupBy(*keys).agg(F.sum(F.when(known, F.col("score") * F.col("w"))).alias("a"), F.sum(F.when(known, F.col("w"))).alias("b"), F.sum(F.col("score") * F.col("w")).alias("c"), F.sum("w").alias("d"))
    return g.select(*keys, F.coalesce(F.try_divide("a", "b"), F.try_divide("c", "d"), F.lit(0.0)).alias("code_focused_score"))


def domain_breakdown(scores: DataFrame) -> DataFrame:
    """Per domain: rows, distinct files, mean, lowest and highest score.  The files themselves are the rows of ``scores``."""
    return scores.groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"), F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))


def band(score: "str | Column") -> "Column":
    """The reading of a score."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= 0.9, "Excellent").when(c >= 0.8, "Very Good").when(c >= 0.7, "Good").when(c >= 0.6, "Fair").when(c >= 0.5, "Needs Improvement").otherwise("Poor")
