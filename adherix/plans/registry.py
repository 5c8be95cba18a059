"""The registered queries of the core library; their SQL is in ``sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adherix.functions import paths, rules
from adherix.functions.records import latest
from adherix.operators import aggregate, classify, functions, history, report, scan, similarity, training
from adherix.plans import sql
from adherix.session import cut, table
from adherix.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
SOURCE = ["repo", "file_path", "function_code"]


def files(s: SparkSession, d: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each chunk as a file, its last delivery."""
    one = latest(table(s, d, "function_chunks").where("chunk_id IS NOT NULL").select("chunk_id", "ingested_at", *SOURCE), ["chunk_id"], ["ingested_at"], SOURCE)
    base = scan.as_files(one, "chunk_id", "file_path", "function_code")
    return base.join(one.select(F.col("chunk_id").alias("file_id"), *extra), "file_id") if extra else base


def index(s: SparkSession, d: str) -> DataFrame:
    """The usable vectors of the similarity index, one record per ref_id."""
    raw = table(s, d, "pattern_index").where("ref_id IS NOT NULL AND domain IS NOT NULL").select("ref_id", "ref_ord", "domain", "file_path", "commit_id", "embedding")
    return latest(raw, ["ref_id"], ["ref_ord"], ["domain", "file_path", "commit_id", "embedding"]).where(similarity.usable(F.col("embedding"), 64))


def near(s: SparkSession, d: str) -> DataFrame:
    """The log of an earlier search: one record per query and rank, similarities held to [-1, 1]."""
    one = latest(table(s, d, "neighbors"), ["query_id", "rank"], ["searched_at"]).where("similarity IS NOT NULL")
    return one.withColumn("similarity", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "similarity")))


def knn(s: SparkSession, d: str) -> DataFrame:
    i = index(s, d).select("ref_id", "domain", "embedding")
    return similarity.knn(i.where("ref_id % 50 = 0").withColumnRenamed("ref_id", "query_id"), i)


def dims(s: SparkSession, d: str) -> DataFrame:
    return near(s, d).select("query_id", F.col("rank").cast("string").alias("dimension"), F.col("similarity").alias("score"), (1.0 / F.col("rank")).alias("weight"))


def scored(s: SparkSession, d: str) -> DataFrame:
    return near(s, d).groupBy(F.col("ref_file").alias("file_id"), "domain").agg(F.max("similarity").alias("score"))


def every_recommendation(f: DataFrame) -> DataFrame:
    out = scan.recommendations(f, scan.ANALYZERS[0])
    for a in scan.ANALYZERS[1:]:
        out = out.unionByName(scan.recommendations(f, a))
    return out


def rounded_scores(f: DataFrame) -> DataFrame:
    """The scores of the four engines, to six places."""
    return scan.all_scores(f).select("file_id", "analyzer", F.round("score", 6).alias("score"))


def by_domain(f: DataFrame) -> DataFrame:
    """The scores of the four engines with the domain of their file."""
    return rounded_scores(f).join(classify.classify(f).select("file_id", "domain"), "file_id")


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def FLAGSHIP(s: SparkSession, d: str) -> DataFrame:  # noqa: N802
    """Mean adherence per domain: normalise, exact top 5 within the domain, adaptive score, roll-up."""
    return similarity.adaptive(knn(s, d)).groupBy("domain").agg(F.count("*").alias("queries"), F.round(F.avg("score"), 6).alias("mean_adherence"), F.sum("hits").alias("neighbours"))


def _signals(s: SparkSession, d: str) -> DataFrame:
    x = classify.signals(files(s, d)).where("combined > 0").select("file_id", "domain", "path_score", "import_score", "content_score", "combined")
    return r6(x, "path_score", "import_score", "content_score", "combined")


def _divergence(s: SparkSession, d: str) -> DataFrame:
    i = cut(index(s, d))
    q = i.select("ref_id", "domain", "embedding")
    n = similarity.knn(q.where("ref_id % 50 = 0").withColumnRenamed("ref_id", "query_id"), q)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("diff", 9)), "dim")
    return r6(similarity.divergence(i, n).withColumn("p", F.row_number().over(w)).where("p <= 20").drop("p"), "diff")


def _code_focused(s: SparkSession, d: str) -> DataFrame:
    return r6(aggregate.code_focused(by_domain(cut(files(s, d))), classify.DOMAIN_IMPORTANCE, ["analyzer"]), "code_focused_score")


def _code_focused_overall(s: SparkSession, d: str) -> DataFrame:
    """One ratio over all rows of engine and file."""
    return r6(aggregate.code_focused(by_domain(cut(files(s, d))), classify.DOMAIN_IMPORTANCE, []), "code_focused_score")


def _patterns_by_type(s: SparkSession, d: str) -> DataFrame:
    f = cut(files(s, d))
    all_ = scan.pattern_matches(f, scan.ANALYZERS[0])
    for a in scan.ANALYZERS[1:]:
        all_ = all_.unionByName(scan.pattern_matches(f, a))
    return all_.groupBy("pattern_type").agg(F.sum("matches").alias("matches"), F.count("*").alias("files"), F.round(F.sum(F.col("confidence") * F.col("matches")) / F.sum("matches"), 6).alias("mean_confidence"))


def _compare(s: SparkSession, d: str) -> DataFrame:
    f = cut(files(s, d, ("repo",)))
    means = cut(rounded_scores(f).join(f.select("file_id", "repo"), "file_id").groupBy("repo", "analyzer").agg(F.avg("score").alias("score")))
    base = means.agg(F.min("repo")).first()[0]
    return r6(report.compare(means, base, "repo", "analyzer").select("repo", "analyzer", "difference", "per_cent"), "difference", "per_cent")


def _secondaries(s: SparkSession, d: str) -> DataFrame:
    return r6(classify.classify(files(s, d)).select("file_id", F.explode("secondaries").alias("x")).select("file_id", "x.domain", "x.score"), "score")


def _functions(s: SparkSession, d: str) -> DataFrame:
    return functions.extract_functions(files(s, d)).groupBy("path").agg(F.count("*").alias("chunks"), F.count_if("is_method").alias("methods"), F.sum(F.length("code")).alias("chars"))


def _embedded(s: SparkSession, d: str) -> DataFrame:
    f = files(s, d).where("content <> ''")
    e = similarity.embed(f).join(f.select("file_id", scan.F.regexp_extract("name", r"\.([^.]+)$", 1).alias("domain")), "file_id").where(similarity.usable(F.col("embedding"), 64))
    i = cut(e.select(F.col("file_id").alias("ref_id"), "domain", "embedding"))
    return r6(similarity.knn(i.where("ref_id % 50 = 0").withColumnRenamed("ref_id", "query_id"), i), "similarity")


def pattern_files(s: SparkSession, d: str) -> DataFrame:
    """The snippets of the similarity index as files, under their ref_id."""
    raw = table(s, d, "pattern_index").where("ref_id IS NOT NULL").select("ref_id", "ref_ord", "file_path", "snippet")
    return scan.as_files(latest(raw, ["ref_id"], ["ref_ord"], ["file_path", "snippet"]), "ref_id", "file_path", "snippet")


def _judged(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Usable vectors, the neighbours of the queries, their adaptive scores and the classification of their snippets."""
    n = cut(knn(s, d))
    return index(s, d), n, similarity.adaptive(n), cut(classify.classify(pattern_files(s, d)))


def _adherence_metrics(s: SparkSession, d: str) -> DataFrame:
    _, _, scores, c = _judged(s, d)
    return r6(similarity.adherence(scores, c), "overall_adherence", "domain_adherence", "confidence", "domain_match_quality")


def _adherence_recommendations(s: SparkSession, d: str) -> DataFrame:
    i, _, scores, c = _judged(s, d)
    return similarity.adherence_recommendations(i.where("ref_id % 50 = 0").select(F.col("ref_id").alias("query_id")), scores, c).drop("category")


def _adherence_patterns(s: SparkSession, d: str) -> DataFrame:
    _, n, scores, c = _judged(s, d)
    return r6(similarity.adherence_patterns(scores, n, c), "confidence")


def _divergence_summary(s: SparkSession, d: str) -> DataFrame:
    i = cut(index(s, d).select("ref_id", "domain", "embedding"))
    q = i.where("ref_id % 50 = 0")
    n = similarity.knn(q.withColumnRenamed("ref_id", "query_id"), i)
    return r6(similarity.divergence_summary(i, n).join(q.select(F.col("ref_id").alias("query_id")), "query_id"), "mean_difference", "cosine")


def _payload(s: SparkSession, d: str) -> DataFrame:
    i = cut(index(s, d).select("ref_id", "domain", "embedding"))
    n = similarity.knn(i.where("ref_id % 50 = 0").withColumnRenamed("ref_id", "query_id"), i)
    own = F.transform("vector", lambda x: x.cast("double"))
    total = F.aggregate(F.transform("references", lambda r: similarity.dot(own, r["v"])), F.lit(0.0), lambda a, x: a + x)
    return similarity.payload(i, n).select("query_id", F.size("references").cast("long").alias("refs"), F.round(total, 4).alias("checksum"))


def _top_issues(s: SparkSession, d: str) -> DataFrame:
    f = cut(files(s, d))
    return report.top_issues(cut(report.feedback(every_recommendation(f))), classify.classify(f))


def _roll_up(s: SparkSession, d: str) -> DataFrame:
    f = cut(files(s, d))
    patterns = scan.pattern_matches(f, scan.ANALYZERS[0])
    for a in scan.ANALYZERS[1:]:
        patterns = patterns.unionByName(scan.pattern_matches(f, a))
    rolled = report.roll_up(rounded_scores(f), patterns, every_recommendation(f))
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x)
    return rolled.select("file_id", F.size("scores").cast("long").alias("engines"), F.round(total, 5).alias("total"), "patterns_count", "recommendations_count")


def _negative_mix(s: SparkSession, d: str) -> DataFrame:
    rows = index(s, d).select(F.col("ref_id").alias("id"), "domain").join(pattern_files(s, d).select(F.col("file_id").alias("id"), "content"), "id")
    return training.negatives(rows).select("anchor_id", "other_id", "pair_type", F.md5("corrupted").alias("digest"))


def _triplets(s: SparkSession, d: str) -> DataFrame:
    rows = cut(index(s, d).select(F.col("ref_id").alias("id"), "domain"))
    return training.triplets(training.positive_pairs(rows), cut(training.cross_domain_negatives(rows)))


def _masked(s: SparkSession, d: str) -> DataFrame:
    one = latest(table(s, d, "pairs").where("anchor IS NOT NULL AND pair_id IS NOT NULL").select("pair_id", "ingested_at", "anchor"), ["pair_id"], ["ingested_at", "anchor"], ["anchor"])
    ids = F.transform(F.regexp_extract_all("anchor", F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long"), F.lit(30000)))
    m = training.mask_tokens(one.select("pair_id", ids.alias("t")), "pair_id", "t", 103, 30000, (0,))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    chosen = F.size(F.filter("labels", lambda x: x != -100))
    return m.where(F.size("t") > 0).select("pair_id", F.size("t").cast("long").alias("tokens"), chosen.cast("long").alias("chosen"), add("input_ids").alias("input_sum"), add("labels").alias("label_sum"))


def _statistics(s: SparkSession, d: str) -> DataFrame:
    names = ["mean", "median", "std", "low", "high", "range"]
    six = {c: F.round(F.col(c).cast("decimal(18,9)"), 6).cast("double") for c in names}
    return aggregate.aggregate(dims(s, d), ["query_id"]).select("query_id", "n", *names).withColumns(six)


def _filters(f: DataFrame) -> DataFrame:
    return f.select("file_id", F.col("path").rlike(paths.pattern(paths.EXCLUDED_NAMES)).alias("excluded"), F.lower("path").rlike(paths.pattern(paths.TEST_MARKS)).alias("is_test"), F.col("path").rlike(paths.pattern(paths.GENERATED_MARKS)).alias("is_generated"))


def _training_scan(s: SparkSession, d: str) -> DataFrame:
    f = cut(files(s, d))
    return training.scan(f, classify.classify(f)).select("file_id", "domain", "tokens")


def _compatible(s: SparkSession, d: str) -> DataFrame:
    own = latest(table(s, d, "pattern_index").where("ref_id IS NOT NULL").select("ref_id", "ref_ord", "file_path"), ["ref_id"], ["ref_ord"], ["file_path"])
    n = near(s, d).join(own.select(F.col("ref_id").cast("string").alias("query_id"), F.col("file_path").alias("query_file")), "query_id")
    return r6(similarity.best_compatible(n), "similarity")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for a in scan.ANALYZERS:
        out[f"patterns_{a}"] = lambda s, d, a=a: scan.pattern_matches(files(s, d), a)
        out[f"recommendations_{a}"] = lambda s, d, a=a: scan.recommendations(files(s, d), a)
        out[f"scores_{a}"] = lambda s, d, a=a: r6(scan.scores(files(s, d), a).drop("path"), "score")
    agg = lambda s, d: aggregate.aggregate(dims(s, d), ["query_id"])
    out |= {
        "file_suffixes": lambda s, d: files(s, d).groupBy(F.regexp_extract("name", r"^.+(\.[^.]+)$", 1).alias("suffix")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")),
        "file_filters": lambda s, d: _filters(files(s, d)),
        "file_scopes": lambda s, d: files(s, d).select("file_id", *[paths.in_scope(F.col("path"), e).alias(f"{e}_scope") for e in paths.SUFFIXES]),
        "compatible_match": _compatible,
        "training_scan": _training_scan,
        "path_kinds": lambda s, d: files(s, d).selectExpr("file_id", f"{rules.COMPONENT} AS component", f"{rules.APP} AS app_router", f"{rules.API} AS api_route", f"{rules.PAGE} AS page", f"{rules.LAYOUT} AS layout"),
        "import_lines": lambda s, d: scan.import_lines(files(s, d)),
        "import_grouping": lambda s, d: r6(scan.import_grouping(files(s, d)), "organisation"),
        "lines_and_nesting": lambda s, d: scan.complexity(files(s, d)).select("file_id", "lines", "nesting"),
        "import_organisation": lambda s, d: r6(scan.import_organisation(files(s, d)), "organisation"),
        "file_metrics": lambda s, d: scan.metrics(files(s, d)),
        "complexity": lambda s, d: r6(scan.complexity(files(s, d)), "mean_length"),
        "every_match": lambda s, d: scan.every_match(cut(files(s, d))).groupBy("count_name", "pattern_no").agg(F.count("*").alias("matches"), F.count_distinct("file_id").alias("files"), F.sum("char_offset").alias("offsets"), F.sum("line_number").alias("line_numbers")),
        "classifier_recommendations": lambda s, d: classify.recommendations(classify.classify(files(s, d))).drop("category"),
        "domain_diagnostics": lambda s, d: r6(classify.diagnostics(files(s, d)).select("file_id", "domain", "category", F.size("matched").cast("long").alias("matched"), "score"), "score"),
        "missing_patterns": lambda s, d: classify.missing_summary(classify.diagnostics(files(s, d))).groupBy("domain", "missing").agg(F.count("*").alias("files")),
        "adherence_metrics": _adherence_metrics,
        "adherence_recommendations": _adherence_recommendations,
        "adherence_patterns": _adherence_patterns,
        "divergence_summary": _divergence_summary,
        "embedding_payload": _payload,
        "top_issues": _top_issues,
        "file_roll_up": _roll_up,
        "negative_mix": _negative_mix,
        "training_triplets": _triplets,
        "masked_tokens": _masked,
        "match_details": lambda s, d: scan.match_details(files(s, d), "type_guards"),
        "domain_signals": _signals,
        "domain_classification": lambda s, d: r6(classify.classify(files(s, d)).select("file_id", "domain", "confidence"), "confidence"),
        "domain_secondaries": _secondaries,
        "index_members": lambda s, d: similarity.index_members(classify.classify(files(s, d))).select("file_id", "domain"),
        "vector_norms": lambda s, d: r6(index(s, d).select("ref_id", "domain", similarity.norm(F.col("embedding")).alias("norm")), "norm"),
        "knn_top5": lambda s, d: r6(knn(s, d), "similarity"),
        "adaptive_scores": lambda s, d: r6(similarity.adaptive(knn(s, d)).drop("best"), "score"),
        "file_adherence": lambda s, d: r6(similarity.file_adherence(index(s, d).where("ref_id % 50 = 0"), similarity.adaptive(knn(s, d))), "score"),
        "adherence_by_domain": FLAGSHIP,
        "adherence_confidence": lambda s, d: r6(similarity.adaptive(knn(s, d)).select("query_id", ((0.5 + F.least(F.lit(1.0), F.col("hits") / 5.0) + F.col("best")) / 3).alias("confidence")), "confidence"),
        "divergence_top20": _divergence,
        "index_stats": lambda s, d: index(s, d).groupBy("domain").agg(F.count("*").alias("vectors"), F.count_distinct("file_path").alias("files"), F.count_distinct("commit_id").alias("commits")),
        "best_compatible": lambda s, d: r6(near(s, d).where(F.col("ref_file").rlike(r"\.(ts|tsx|js|jsx)$")).groupBy("query_id").agg(F.max_by("ref_file", F.struct("similarity", "ref_file")).alias("ref_file"), F.max("similarity").alias("similarity")), "similarity"),
        "neighbour_log": lambda s, d: r6(near(s, d).select("query_id", F.col("rank").cast("long").alias("rank"), "ref_id", "domain", "similarity"), "similarity"),
        "embedded_knn": _embedded,
        "extracted_functions": _functions,
        "weighted_means": lambda s, d: r6(agg(s, d).select("query_id", *aggregate.METHODS), *aggregate.METHODS),
        "score_confidence": lambda s, d: r6(agg(s, d).select("query_id", "confidence"), "confidence"),
        "score_statistics": _statistics,
        "importance": lambda s, d: r6(aggregate.importance(dims(s, d), ["query_id"]).drop("contribution"), "importance"),
        "score_bands": lambda s, d: scored(s, d).groupBy(aggregate.band("score").alias("band")).agg(F.count("*").alias("n")),
        "domain_breakdown": lambda s, d: r6(aggregate.domain_breakdown(scored(s, d)), "mean", "low", "high"),
        "top_files": lambda s, d: r6(report.top_files(scored(s, d)), "score"),
        "batch_summary": lambda s, d: r6(report.batch_summary(scored(s, d), "file_id"), "mean", "low", "high"),
        "quality_gate": lambda s, d: report.gate(scored(s, d), 0.7).groupBy("domain").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed")),
        "dimension_means": lambda s, d: r6(aggregate.dimension_mean(by_domain(cut(files(s, d)))), "score"),
        "code_focused": _code_focused,
        "code_focused_overall": _code_focused_overall,
        "patterns_by_type": _patterns_by_type,
        "file_level_pivot": lambda s, d: rounded_scores(cut(files(s, d))).groupBy("file_id").pivot("analyzer", list(scan.ANALYZERS)).agg(F.max("score")),
        "feedback": lambda s, d: report.feedback(every_recommendation(cut(files(s, d))), 3).select("file_id", "analyzer", "rule_id", "severity", "category", "place"),
        "feedback_full": lambda s, d: report.feedback(every_recommendation(cut(files(s, d)))).select("file_id", "analyzer", "rule_id", "severity", "category", "place"),
        "compare_repos": _compare,
        "commit_metadata": lambda s, d: history.commits(table(s, d, "commits")).select("commit_id", "repo", "author", "message", F.size("parent_ids").cast("long").alias("parents"), F.col("insertions").cast("long").alias("insertions"), F.col("deletions").cast("long").alias("deletions")),
        "parent_commits": lambda s, d: history.resolve_parent(table(s, d, "commits")),
        "commit_lateness": lambda s, d: history.lateness(table(s, d, "commits")),
        "changed_lines": lambda s, d: files(s, d).where(F.contains("content", F.lit("\n+")) | F.startswith("content", F.lit("+"))).select("file_id", history.changed_lines(F.col("content")).alias("added")),
        "training_samples": lambda s, d: training.samples(files(s, d)).select("file_id", F.length("content").cast("long").alias("chars")),
        "positive_pairs": lambda s, d: training.positive_pairs(index(s, d).select(F.col("ref_id").alias("id"), "domain")),
        "negative_pairs": lambda s, d: training.cross_domain_negatives(index(s, d).select(F.col("ref_id").alias("id"), "domain")),
        "corrupted_code": lambda s, d: files(s, d).where("content <> ''").select("file_id", F.md5(training.corrupt(F.col("content"), "file_id")).alias("digest")),
        "triplet_split": lambda s, d: training.split(table(s, d, "pairs").select("pair_id").distinct(), "pair_id").groupBy("split").agg(F.count("*").alias("n")),
        "infonce_loss": lambda s, d: r6(training.infonce(near(s, d).groupBy("query_id").agg(F.max("similarity").alias("positive"), F.min("similarity").alias("negative"), F.count("*").alias("k")).where("k > 1")), "loss"),
        "token_budget": lambda s, d: files(s, d).select("file_id", F.regexp_count("content", F.lit(r"\w+|[^\w\s]")).cast("long").alias("tokens")).where("tokens <= 2048"),
        "compressed_code": lambda s, d: files(s, d).select("file_id", F.length("content").cast("long").alias("chars"), functions.compress(F.col("content"), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))).alias("short")).select("file_id", "chars", F.length("short").cast("long").alias("kept"), F.md5("short").alias("digest")),
        "data_share": lambda s, d: r6(files(s, d).select("file_id", functions.data_share(F.col("content")).alias("share")), "share"),
        "event_windows": lambda s, d: windows.event_windows(table(s, d, "events")).withColumn("total", F.round("total", 4)),
        "event_sessions": lambda s, d: windows.sessions(table(s, d, "events")),
    }
    return out


def oracle_sql() -> dict[str, str]:
    known = queries()
    return {k: v for k, v in sql.oracle_sql().items() if k in known}
