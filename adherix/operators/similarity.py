"""Similarity within a domain: normalise, exact top k, adaptive scores, divergence, index building.

The exact top k is the reference operator over one commit's index; for every vector
against all others there is the inverted-file search in the training-data package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adherix.functions import paths

#: Rows of a block of index or query vectors: what one task multiplies at once.
BLOCK = 4096


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays as it is.  The norm is bound once, not once an element."""
    bound = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))
    return bound[0]


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers, not all zero."""
    big = F.lit(float("inf"))
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _block_topk(k: int, least: float):
    def run(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            a, b = np.stack(q["v"].to_numpy()), np.stack(r["v"].to_numpy())
            ids = r["ref_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            a, b, ids = a, b[order], ids[order]
            take = min(k + 1, len(ids))
            for at in range(0, len(a), 1024):
                s = np.round(a[at : at + 1024] @ b.T, 12)
                best = np.argsort(-s, axis=1, kind="stable")[:, :take]
                for i, own in enumerate(q["query_id"].to_numpy()[at : at + 1024]):
                    for j in best[i]:
                        if ids[j] != own and s[i, j] >= least:
                            out.append((own, key[0], ids[j], s[i, j]))
        return pd.DataFrame(out, columns=["query_id", "domain", "ref_id", "similarity"])

    return run


def knn(queries: DataFrame, index: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """query_id, domain, rank, ref_id, similarity: exact top k by cosine within the domain, itself left out.

    Both sides have an id, a domain and a usable vector ``embedding``.  Sides are cut
    into blocks by id hash, every block pair is one task with one matrix product,
    and the lists are merged by a bounded window.  Ties go to the smaller ref_id.
    """
    size = index.groupBy("domain").count().select("domain", F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)).cast("int").alias("n"))
    asked = queries.groupBy("domain").count().select("domain", F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)).cast("int").alias("nq"))
    shape = size.join(asked, "domain")
    q = queries.join(shape, "domain").select("query_id", "domain", unit(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("bq"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("br"))
    r = index.join(shape, "domain").select("ref_id", "domain", unit(F.col("embedding")).alias("v"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"), F.pmod(F.xxhash64("ref_id"), F.col("n")).cast("int").alias("br"))
    q, r = q.toDF("query_id", "domain", "v", "bq", "br"), r.toDF("ref_id", "domain", "v", "bq", "br")  # of their own lineage, as both may come from one table
    keys = ["domain", "bq", "br"]
    lists = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(_block_topk(k, least), "query_id long, domain string, ref_id long, similarity double")
    w = Window.partitionBy("query_id", "domain").orderBy(F.desc("similarity"), "ref_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "domain", F.col("rank").cast("long").alias("rank"), "ref_id", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "similarity")).alias("similarity"))


def adaptive(neighbours: DataFrame, strong: float = 0.85) -> DataFrame:
    """query_id, domain, score, hits: the best similarity where it is strong, else the mean of the first three."""
    best, mean = F.max("similarity"), F.avg(F.when(F.col("rank") <= 3, F.col("similarity")))
    return neighbours.groupBy("query_id", "domain").agg(F.when(best >= strong, best).otherwise(mean).alias("score"), F.count("*").alias("hits"), best.alias("best"))


def file_adherence(index: DataFrame, scored: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Mean score over the scored functions of each file; where none was scored that of the whole file, else 0.

    ``whole`` holds file_path and score of searches with whole files; of several for a file the best counts.
    """
    j = index.join(scored.select(F.col("query_id").alias("ref_id"), "score"), "ref_id", "left")
    g = j.groupBy("file_path").agg(F.avg("score").alias("score"), F.count("*").alias("functions"), F.count("score").alias("scored"))
    if whole is not None:
        g = g.join(whole.groupBy("file_path").agg(F.max("score").alias("_whole")), "file_path", "left").withColumn("score", F.coalesce("score", "_whole")).drop("_whole")
    return g.withColumn("score", F.coalesce("score", F.lit(0.0)))


def best_compatible(neighbours: DataFrame) -> DataFrame:
    """query_id, ref_file, similarity: the most similar neighbour whose file may be compared with ``query_file``; ties go to the later path."""
    fit = neighbours.where(paths.compatible(F.col("query_file"), F.col("ref_file")))
    return fit.groupBy("query_id").agg(F.max_by("ref_file", F.struct("similarity", "ref_file")).alias("ref_file"), F.max("similarity").alias("similarity"))


def divergence(index: DataFrame, neighbours: DataFrame) -> DataFrame:
    """query_id, dim, diff: absolute difference of a vector to the mean of its neighbours' normalised vectors."""
    v = index.select("ref_id", unit(F.col("embedding")).alias("v"))
    mean = neighbours.join(v, "ref_id").select("query_id", F.posexplode("v").alias("dim", "x")).groupBy("query_id", "dim").agg(F.avg("x").alias("mean"))
    own = index.select(F.col("ref_id").alias("query_id"), F.posexplode("embedding").alias("dim", "x"))
    return mean.join(own, ["query_id", "dim"]).select("query_id", F.col("dim").cast("long").alias("dim"), F.abs(F.col("x").cast("double") - F.col("mean")).alias("diff"))


def divergence_summary(index: DataFrame, neighbours: DataFrame) -> DataFrame:
    """query_id, mean_difference, cosine: a vector against the mean of its neighbours' normalised vectors; 1 and 0 without neighbours."""
    v = index.select("ref_id", unit(F.col("embedding")).alias("v"))
    mean = neighbours.join(v, "ref_id").select("query_id", F.posexplode("v").alias("dim", "x")).groupBy("query_id", "dim").agg(F.avg("x").alias("mean"))
    own = index.select(F.col("ref_id").alias("query_id"), F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    g = own.join(mean, ["query_id", "dim"], "left").groupBy("query_id").agg(F.avg(F.abs(F.col("x") - F.col("mean"))).alias("d"), F.sum(F.col("x") * F.col("mean")).alias("dp"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("a"), F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("b"))
    return g.select("query_id", F.coalesce("d", F.lit(1.0)).alias("mean_difference"), F.coalesce(F.col("dp") / (F.col("a") * F.col("b") + 1e-9), F.lit(0.0)).alias("cosine"))


def payload(index: DataFrame, neighbours: DataFrame) -> DataFrame:
    """query_id, vector (as it is), references (rank, ref_id, normalised vector): what an explanation of a score shows."""
    refs = neighbours.join(index.select("ref_id", unit(F.col("embedding")).alias("v")), "ref_id")
    listed = refs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref_id", "v"))).alias("references"))
    return listed.join(index.select(F.col("ref_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def adherence(scored: DataFrame, classified: DataFrame) -> DataFrame:
    """The adherence of each query: similarity of patterns, domain adherence, confidence and quality of the domain match.

    ``scored`` comes from ``adaptive``, ``classified`` from the classification of the
    queries under file_id.  Overall adherence is the similarity of patterns as it is.
    """
    j = scored.join(classified.select(F.col("file_id").alias("query_id"), F.col("confidence").alias("domain_match_quality")), "query_id")
    confidence = (F.col("domain_match_quality") + F.least(F.lit(1.0), F.col("hits") / 5.0) + F.col("best")) / 3
    return j.select("query_id", "domain", F.col("score").alias("overall_adherence"), (F.col("domain_match_quality") * 0.5 + F.col("score") * 0.5).alias("domain_adherence"), confidence.alias("confidence"), "hits", "domain_match_quality")


def adherence_recommendations(queries: DataFrame, scored: DataFrame, classified: DataFrame) -> DataFrame:
    """query_id, rule_id, severity, category: what is said of each of ``queries`` (query_id); one without neighbours has adherence 0."""
    q = queries.select("query_id").join(scored.select("query_id", "score", "hits"), "query_id", "left").fillna(0, ["score", "hits"])
    q = q.join(classified.select(F.col("file_id").alias("query_id"), "confidence"), "query_id")
    low = F.when(F.col("score") < 0.4, F.struct(F.lit("LOW_DOMAIN_ADHERENCE").alias("rule_id"), F.when(F.col("score") < 0.25, "error").otherwise("warning").alias("severity"), F.lit("domain_adherence").alias("category")))
    unclear = F.when(F.col("confidence") < 0.6, F.struct(F.lit("UNCLEAR_DOMAIN_ENHANCED").alias("rule_id"), F.when(F.col("confidence") < 0.3, "error").when(F.col("confidence") < 0.5, "warning").otherwise("info").alias("severity"), F.lit("domain_classification").alias("category")))
    alone = F.when(F.col("hits") == 0, F.struct(F.lit("NO_SIMILAR_PATTERNS").alias("rule_id"), F.lit("info").alias("severity"), F.lit("pattern_similarity").alias("category")))
    return q.select("query_id", F.explode(F.filter(F.array(low, unclear, alone), lambda x: x.isNotNull())).alias("x")).select("query_id", "x.*")


def adherence_patterns(scored: DataFrame, neighbours: DataFrame, classified: DataFrame) -> DataFrame:
    """query_id, pattern_name, confidence: the domain adherence of each query and its three nearest patterns."""
    own = adherence(scored, classified).join(classified.select(F.col("file_id").alias("query_id"), F.col("domain").alias("d")), "query_id")
    return own.select("query_id", F.concat(F.lit("domain_adherence_"), "d").alias("pattern_name"), "confidence").unionByName(neighbours.where("rank <= 3").select("query_id", F.concat(F.lit("similar_pattern_"), F.col("rank").cast("string")).alias("pattern_name"), F.col("similarity").alias("confidence")))


def index_members(classified: DataFrame, most: int = 1000, least: int = 3) -> DataFrame:
    """The first ``most`` files of each known domain that has at least ``least``, in file order."""
    known = classified.where("domain <> 'unknown'")
    enough = known.groupBy("domain").count().where(F.col("count") >= least).select("domain")
    w = Window.partitionBy("domain").orderBy("file_id")
    return known.join(enough, "domain").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def hashed_embedding(dim: int = 64):
    """A deterministic stand-in for a model: signed feature hashing of a text's words, as a mapInPandas function."""
    import re
    import zlib

    word = re.compile(r"\w+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), dim), np.float32)
            for i, text in enumerate(b["content"]):
                for w in word.findall(text or ""):
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h & 1024 else -1
            yield pd.DataFrame({"file_id": b["file_id"], "embedding": list(out)})

    return run


def embed(files: DataFrame, dim: int = 64, model=None) -> DataFrame:
    """file_id, embedding: each distinct content is embedded once; ``model`` is a mapInPandas function of (file_id, content)."""
    key = F.xxhash64("content")
    distinct = files.groupBy(key.alias("file_id")).agg(F.first("content").alias("content"))
    vectors = distinct.mapInPandas(model or hashed_embedding(dim), "file_id long, embedding array<float>").withColumnRenamed("file_id", "h")
    return files.select("file_id", key.alias("h")).join(vectors, "h").select("file_id", "embedding")
