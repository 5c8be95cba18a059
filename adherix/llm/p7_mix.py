"""Problem 7: a mix of sources at target weights, in tokens of a public tokenizer.

Copies are removed before anything is tokenised.  Every text gets a hash-random key.
Keys are cut into ranges per source and ranges into blocks; token sums of the ranges,
summed up in order within blocks and over blocks, tell where each range begins, so the
running sums within a range are global ones and no source meets in one task.  Each
source is cut at its exact budget, after as many whole epochs as it holds.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adherix.session import broadcast_below, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern published with the vocabulary above (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RANGE_ROWS = 2000
#: Ranges of a block, whose sums are summed up before those of the blocks.
BLOCK_RANGES = 1024
#: As ``total_tokens``: a mix of the size of all listed sources together, small sources repeated up to their caps.
ALL = -1
#: As ``total_tokens``: the largest mix in which every source that occurs reaches its weight within its cap.
EXACT = -2


def source_key(c: Column) -> Column:
    """Spellings of one source told apart only by case, spaces, hyphens and the like are one."""
    return F.regexp_replace(F.trim(F.lower(c)), r"[\s\-./]+", "_")


def _count_tokens(name: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": n})

    return run


def sized(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, n_tokens: each distinct text of the listed sources once, under its smallest doc_id.

    The vocabulary file is read where the job is started and shipped to the executors.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    listed = targets.select(source_key(F.col("source")).alias("source")).distinct()
    docs = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text")
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != "")).join(listed, "source", "left_semi")
    one = docs.groupBy(F.xxhash64("text").alias("h1"), F.xxhash64(F.reverse("text"), F.lit(1)).alias("h2")).agg(F.min(F.struct("doc_id", "source", "text")).alias("x"))
    return one.select("x.*").mapInPandas(_count_tokens(os.path.basename(tokenizer), pattern), "doc_id long, source string, n_tokens long").where("n_tokens > 0")


def _plan(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: weight, cap, available tokens and texts."""
    t = targets.where("source IS NOT NULL").select(source_key(F.col("source")).alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    t = t.groupBy("source").agg(F.sum("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("texts"))
    plan = t.join(have, "source", "left").fillna(0, ["available_tokens", "texts"])
    return plan.withColumn("usable", (F.col("available_tokens") > 0) & (F.col("target_weight") > 0) & (F.col("max_repeats") > 0))


def _starts(sums: DataFrame) -> DataFrame:
    """source, range, start: the tokens of a source before each of its ranges, summed within blocks and over blocks."""
    sums = sums.withColumn("block", F.floor(F.col("range") / BLOCK_RANGES))
    within = Window.partitionBy("source", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("source", "block").agg(F.sum("s").alias("b")).select("source", "block", F.coalesce(F.sum("b").over(over), F.lit(0)).alias("before"))
    each = sums.select("source", "block", "range", F.coalesce(F.sum("s").over(within), F.lit(0)).alias("inner"))
    return each.join(blocks, ["source", "block"]).select("source", "range", (F.col("before") + F.col("inner")).alias("start"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, n_tokens, repeats) and the report of the shares reached.

    ``total_tokens`` is the size of the whole mix.  By default (or ``ALL``) it is that
    of all listed sources together: small sources are repeated, up to their caps, and
    large ones cut.  A source that cannot fill its budget at the cap gives all it has;
    ``missing_tokens`` and ``missing_share`` of the report tell how much of its weight
    is lacking.  With ``EXACT`` the mix is the largest in which no source falls short.
    A listed source without texts keeps its row in the report with a share of 0; its
    weight is divided over the others in proportion (``target_share``).  Null
    max_repeats means once; null, blank or unlisted sources and null or blank texts
    take no part; a text that recurs under other ids or sources counts as one.  Each
    source is cut where its running sum comes nearest to its budget.  Empty tables
    give no selection.
    """
    texts = cut(sized(documents, targets, tokenizer))
    plan = cut(_plan(texts, targets))
    room = F.col("available_tokens") * F.col("max_repeats") / F.col("target_weight")
    known = plan.where("usable").agg(F.sum("target_weight").alias("weight"), F.sum("available_tokens").alias("all"), F.min(room).alias("room"), F.count("*").alias("n")).first()
    weight, listed = known["weight"] or 1.0, plan.count()
    if total_tokens is None or total_tokens == ALL:
        total_tokens = known["all"] or 0
    elif total_tokens == EXACT:
        total_tokens = int((known["room"] or 0) * weight)
    share = F.when(F.col("usable"), F.col("target_weight") / F.lit(weight)).otherwise(0.0)
    budget = F.least(share * F.lit(total_tokens), F.col("available_tokens") * F.col("max_repeats"))
    planned = plan.withColumn("target_share", share).withColumn("budget", budget).withColumn("epochs", F.when(F.col("usable"), F.floor(F.col("budget") / F.col("available_tokens"))).otherwise(0).cast("int"))
    planned = planned.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available_tokens")).withColumn("ranges", F.greatest(F.lit(1), F.floor(F.col("texts") / RANGE_ROWS)).cast("int"))
    budgets = planned.where("usable").select("source", "epochs", "rest", "ranges", F.col("max_repeats").alias("cap"))

    keyed = texts.join(broadcast_below(budgets, listed, 256), "source").withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    keyed = keyed.withColumn("range", F.least(F.col("ranges") - 1, F.floor((F.col("key") / float(1 << 64) + 0.5) * F.col("ranges")).cast("int")))
    starts = _starts(keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("s")))
    inner = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(starts, ["source", "range"]).withColumn("upto", F.col("start") + F.sum("n_tokens").over(inner))
    more = (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("epochs") < F.col("cap")) & (F.col("rest") > 0)
    chosen = placed.withColumn("repeats", F.col("epochs") + more.cast("int")).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")

    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("texts_used"), F.max("repeats").alias("most_repeats"))
    shares = planned.select("source", "target_weight", "max_repeats", "available_tokens", "texts", "target_share").join(reached, "source", "left").fillna(0, ["tokens", "texts_used", "most_repeats"])
    shares = cut(shares)
    whole = shares.agg(F.sum("tokens")).first()[0] or 0
    lacking = F.greatest(F.lit(0), F.floor(F.col("target_share") * F.lit(total_tokens)).cast("long") - F.col("tokens"))
    lacking = F.when(F.col("tokens") >= F.col("available_tokens") * F.col("max_repeats"), lacking).otherwise(F.lit(0))  # a text of rounding is not lacking
    report = shares.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.lit(whole)), F.lit(0.0))).withColumn("missing_tokens", lacking)
    return chosen, report.withColumn("missing_share", F.coalesce(F.try_divide(F.col("missing_tokens").cast("double"), F.lit(total_tokens)), F.lit(0.0)))
