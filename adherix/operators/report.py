"""Report views: ranked feedback, best files, comparisons, gates and the result document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adherix.session import broadcast_below


def severity_rank(c: Column) -> Column:
    """critical 0, error 1, warning 2, info 3."""
    return F.when(c == "critical", 0).when(c == "error", 1).when(c == "warning", 2).otherwise(3)


def feedback(recommendations: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` recommendations of each file by severity and category, in the order in which the engines speak.

    A rule that fires several times in a file gives as many recommendations, each of
    which counts towards ``most``.  Rows without ``times`` count once, rows without
    ``seq`` follow each other by engine and rule.
    """
    times = F.col("times") if "times" in recommendations.columns else F.lit(1)
    each = recommendations.withColumn("nth", F.explode(F.sequence(F.lit(1), F.least(times, F.lit(most)).cast("int"))))
    w = Window.partitionBy("file_id").orderBy("severity_rank", "category", *["seq"] * ("seq" in recommendations.columns), "analyzer", "rule_id", "nth")
    ranked = each.withColumn("severity_rank", severity_rank(F.col("severity")).cast("long")).withColumn("place", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("place") <= most)


def top_issues(feedback_rows: DataFrame, domains: DataFrame, code_domains: tuple = ("backend", "frontend", "testing", "database"), per_domain: int = 2, most: int = 3) -> DataFrame:
    """The first errors and warnings of the first ``most`` code domains that have any, ``per_domain`` each.

    Where no code domain has one, the first five recommendations of all stand in, with a null domain.
    """
    order = F.array_position(F.array(*[F.lit(d) for d in code_domains]), F.col("domain"))
    known = feedback_rows.join(domains.select("file_id", "domain"), "file_id")
    serious = known.where(F.col("severity").isin("error", "warning") & F.col("domain").isin(*code_domains)).withColumn("_o", order)
    keys = ["severity_rank", "category", "file_id", "place"]
    first = serious.withColumn("n", F.row_number().over(Window.partitionBy("_o").orderBy(*keys))).where(F.col("n") <= per_domain)
    shown = first.withColumn("_d", F.dense_rank().over(Window.orderBy("_o"))).where(F.col("_d") <= most)  # a few rows a domain
    rest = feedback_rows.orderBy(*keys).limit(5).withColumn("n", F.row_number().over(Window.orderBy(*keys))).withColumn("domain", F.lit(None).cast("string"))
    cols = ["domain", "n", "file_id", "analyzer", "rule_id", "severity", "category"]
    none = shown.limit(1).agg(F.count("*").alias("_any"))
    return shown.select(*cols).unionByName(rest.join(F.broadcast(none), F.col("_any") == 0).select(*cols)).withColumn("n", F.col("n").cast("long"))


def colour(score: Column) -> Column:
    """The colour of a score."""
    return F.when(score >= 0.8, "green").when(score >= 0.6, "yellow").otherwise("red")


def severity_colour(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s == "critical", "bright_red").when(s == "error", "red").when(s == "warning", "yellow").when(s == "info", "blue").otherwise("white")


def divergence_level(diff: Column) -> Column:
    return F.when(diff > 0.15, "HIGH").when(diff > 0.08, "MEDIUM").otherwise("LOW")


def top_files(scores: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` best files of each domain; ties go to the smaller id."""
    w = Window.partitionBy("domain").orderBy(F.desc("score"), "file_id")
    return scores.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)


def roll_up(scores: DataFrame, patterns: DataFrame, recommendations: DataFrame) -> DataFrame:
    """A row per file: the map of its scores by engine, and how many patterns and recommendations it has."""
    s = scores.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("analyzer", "score")))).alias("scores"))
    p = patterns.groupBy("file_id").agg(F.sum("matches").alias("patterns_count"))
    r = recommendations.groupBy("file_id").agg(F.sum("times").alias("recommendations_count"))
    return s.join(p, "file_id", "left").join(r, "file_id", "left").fillna(0, ["patterns_count", "recommendations_count"])


def compare(means: DataFrame, base: str, key: str, dimension: str) -> DataFrame:
    """Each group against the base group, per dimension: difference and per cent of the base where that is above 0."""
    b = means.where(F.col(key) == base).select(F.col(dimension).alias("_d"), F.col("score").alias("base_score"))
    j = means.where(F.col(key) != base).join(broadcast_below(b, b.count(), 64), F.col(dimension) == F.col("_d")).drop("_d")
    return j.withColumn("difference", F.col("score") - F.col("base_score")).withColumn("per_cent", F.when(F.col("base_score") > 0, F.try_divide(F.col("difference") * 100, "base_score")))


def batch_summary(scores: DataFrame, key: str) -> DataFrame:
    """One row: mean, lowest and highest score, and who has them (the smaller key on ties)."""
    return scores.agg(F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.min_by(key, F.struct("score", key)).alias("lowest"), F.min_by(key, F.struct(-F.col("score"), key)).alias("highest"), F.count("*").alias("n"))


def gate(scores: DataFrame, least: float) -> DataFrame:
    return scores.withColumn("passed", F.col("score") >= least)


def document(overall: DataFrame, path: str) -> None:
    """Writes result rows as JSON documents, one line each."""
    overall.write.mode("overwrite").json(path)
