"""Contrastive training data as tables: samples, positive and negative pairs, corrupted code, triplets and their loss.

Where the order is random it comes from a seeded hash of the keys, so a run can be
repeated and no task needs to see a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adherix.functions import paths
from adherix.session import broadcast_below


def order_key(*cols: str | Column) -> Column:
    """A seeded order that any engine can follow: md5 over the keys joined by a bar."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def samples(files: DataFrame, least: int = 50) -> DataFrame:
    """Files of at least ``least`` characters that are not blank."""
    return files.where((F.length("content") >= least) & (F.trim("content") != ""))


def scan(files: DataFrame, classified: DataFrame, tests: bool = False, generated: bool = False, most: int | None = None, longest: int = 512) -> DataFrame:
    """file_id, path, content, domain, tokens: the code files that training takes, with their domain.

    Excluded folders, tests, generated files, suffixes other than code's and blank
    files are left out.  ``tokens`` counts words and marks, ``longest`` at most.  With
    ``most`` the scan ends after so many files in the order of their ids.
    """
    path = F.col("path")
    kept = files.where(~paths.excluded(path, tests, generated, paths.TRAINING_EXCLUDED_NAMES) & paths.in_scope(path, "training") & F.rlike("content", F.lit(r"\S")))
    tokens = F.least(F.lit(longest), F.regexp_count("content", F.lit(r"\w+|[^\w\s]"))).cast("long")
    out = kept.join(classified.select("file_id", "domain"), "file_id").select("file_id", "path", "content", "domain", tokens.alias("tokens"))
    return out if most is None else out.orderBy("file_id").limit(most)


def _ranked(rows: DataFrame, seed: int, *more: str) -> DataFrame:
    """id, domain, pos, n: the place of each row in the seeded order of its domain, from 0, and the rows of the domain.

    The order is laid by ranges of the hash, so no task needs to see a whole domain.
    """
    keyed = rows.select("id", "domain", *more).withColumn("k", order_key(F.lit(seed), "id"))
    w = Window.partitionBy("domain", "bucket").orderBy("k", "id", *more)
    bucketed = keyed.withColumn("bucket", F.substring("k", 1, 2))
    local = bucketed.withColumn("r", F.row_number().over(w))
    sizes = bucketed.groupBy("domain", "bucket").count()  # at most 256 rows a domain
    before = sizes.select("domain", "bucket", F.coalesce(F.sum("count").over(Window.partitionBy("domain").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy("domain")).alias("n"))
    return local.join(before, ["domain", "bucket"]).select("id", "domain", *more, (F.col("r") + F.col("before") - 1).alias("pos"), "n")


def positive_pairs(rows: DataFrame, per_anchor: int = 3, seed: int = 7) -> DataFrame:
    """anchor_id, other_id, domain: for each row the ``per_anchor`` next rows of its domain in a seeded circular order.

    A domain of any size is paired without a self-join: each row meets only its successors.
    """
    ranked = _ranked(rows, seed)
    step = F.explode(F.sequence(F.lit(1), F.least(F.lit(per_anchor), F.col("n") - 1).cast("int")))
    anchors = ranked.where("n > 1").select(F.col("id").alias("anchor_id"), "domain", F.col("pos").alias("at"), "n", step.alias("step")).withColumn("pos", F.pmod(F.col("at") + F.col("step"), F.col("n")))
    return anchors.join(ranked.select(F.col("id").alias("other_id"), "domain", "pos"), ["domain", "pos"]).select("anchor_id", "other_id", "domain", F.col("step").cast("long").alias("step"))


def cross_domain_negatives(rows: DataFrame, seed: int = 11) -> DataFrame:
    """anchor_id, other_id, domains: each row with a row of the next domain at the same place of its seeded order.

    Where the next domain is smaller its order is gone through again, so every row
    gets a partner; only a sole domain gives none.
    """
    ranked = _ranked(rows, seed)
    sizes = rows.groupBy("domain").agg(F.count("*").alias("m")).withColumn("d", F.dense_rank().over(Window.orderBy("domain")) - 1)  # a row per domain
    n = sizes.count()
    following = sizes.select("domain", F.pmod(F.col("d") + 1, n).cast("int").alias("d")).join(sizes.select(F.col("domain").alias("other_domain"), "m", "d"), "d").select("domain", "other_domain", "m").where("domain <> other_domain")
    anchors = ranked.join(broadcast_below(following, n, 64), "domain").select(F.col("id").alias("anchor_id"), "domain", "other_domain", F.pmod("pos", "m").alias("pos"))
    return anchors.join(ranked.select(F.col("id").alias("other_id"), F.col("domain").alias("other_domain"), "pos"), ["other_domain", "pos"]).select("anchor_id", "other_id", "domain", "other_domain")


def _chance(seed: int, n: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from a seeded hash of the keys."""
    return F.conv(F.substring(order_key(F.lit(f"{seed}.{n}"), *keys), 1, 8), 16, 10).cast("double") / float(1 << 32)


def snake_case(code: Column) -> Column:
    """Camel case identifiers in snake case, all other text as it is."""
    p = r"\b[a-z]+[A-Z][a-zA-Z]*\b"
    words = F.transform(F.regexp_extract_all(code, F.lit(p), F.lit(0)), lambda w: F.lower(F.regexp_replace(w, r"([a-z])([A-Z])", "$1_$2")))
    return F.array_join(F.zip_with(F.split(code, p, -1), words, lambda a, w: F.concat(a, F.coalesce(w, F.lit("")))), "")


def corrupt(code: Column, key: str | Column, share: float = 0.3, seed: int = 5) -> Column:
    """Style corruption: each of four changes is made with the probability ``share``, by a seeded hash of the key.

    In this order: camel case to snake case, semicolons left out (or put before line
    ends where there are none), const to var, double quotes to single ones.
    """
    does = lambda n, changed, c: F.when(_chance(seed, n, key) < share, changed).otherwise(c)
    c = does(1, snake_case(code), code)
    c = does(2, F.when(F.contains(c, F.lit(";")), F.replace(c, F.lit(";"), F.lit(""))).otherwise(F.replace(c, F.lit("\n"), F.lit(";\n"))), c)
    c = does(3, F.regexp_replace(c, r"\bconst\b", "var"), c)
    return does(4, F.replace(c, F.lit('"'), F.lit("'")), c)


def negatives(rows: DataFrame, code: str = "content", corrupted: float = 0.3, least: int = 50, seed: int = 13) -> DataFrame:
    """anchor_id, other_id, pair_type, corrupted: a negative for each row, of another domain or its own text corrupted.

    About ``corrupted`` of the rows, by a seeded hash of their id, get their own text
    with another style; rows too short for that and all others get a row of the next
    domain.  A sole domain leaves only the corrupted ones.
    """
    styled = (_chance(seed, 9, "id") < corrupted) & (F.length(code) >= least)
    own = rows.where(styled).select(F.col("id").alias("anchor_id"), F.col("id").alias("other_id"), F.lit("synthetic_corruption").alias("pair_type"), corrupt(F.col(code), "id").alias("corrupted"))
    crossed = cross_domain_negatives(rows.select("id", "domain")).join(rows.where(~F.coalesce(styled, F.lit(False))).select(F.col("id").alias("anchor_id")), "anchor_id")
    return crossed.select("anchor_id", "other_id", F.concat(F.lit("cross_domain_"), "domain", F.lit("_vs_"), "other_domain").alias("pair_type"), F.lit(None).cast("string").alias("corrupted")).unionByName(own)


def triplets(positives: DataFrame, negative_pairs: DataFrame, seed: int = 17) -> DataFrame:
    """anchor_id, positive_id, negative_id, step: each positive pair with the other side of a negative drawn from all of them.

    Negatives are numbered in a seeded order laid by hash ranges; the draw is a hash of the
    pair modulo their number.
    """
    pool = _ranked(negative_pairs.select(F.col("anchor_id").alias("id"), F.lit("all").alias("domain"), F.col("other_id").alias("other")), seed, "other")
    place = F.conv(F.substring(order_key(F.lit(seed), "anchor_id", "other_id"), 1, 8), 16, 10).cast("long")
    size = pool.agg(F.max("n")).first()[0] or 0
    drawn = positives.withColumn("pos", F.pmod(place, F.lit(max(1, size))))
    return drawn.join(pool.select("pos", F.col("other").alias("negative_id")), "pos").select("anchor_id", F.col("other_id").alias("positive_id"), "negative_id", "step")


def mask_tokens(rows: DataFrame, key: str, tokens: str, mask_id: int, vocabulary: int, special: tuple[int, ...] = (), share: float = 0.15, seed: int = 19) -> DataFrame:
    """The rows with ``input_ids`` and ``labels``: masked language modelling by a seeded hash of key and place.

    Of the chosen tokens 80 % become the mask, 10 % another token and 10 % stay;
    labels are the old token where chosen and -100 elsewhere.  Special tokens are
    never chosen; a null or empty array stays as it is.
    """

    def places(n: int):
        return lambda x, i: _chance(seed, n, key, i)

    t = F.col(tokens)
    chosen = F.transform(t, lambda x, i: (places(1)(x, i) < share) & ~(x.isin(list(special)) if special else F.lit(False)))
    other = lambda x, i: F.pmod(F.conv(F.substring(order_key(F.lit(f"{seed}.4"), key, i), 1, 8), 16, 10).cast("long"), F.lit(vocabulary))
    changed = F.transform(t, lambda x, i: F.when(places(2)(x, i) < 0.8, F.lit(mask_id).cast("long")).when(places(3)(x, i) < 0.5, other(x, i)).otherwise(x.cast("long")))
    masked = rows.withColumn("_c", chosen).withColumn("_m", changed)
    ids = F.transform(t, lambda x, i: F.when(F.get("_c", i), F.get("_m", i)).otherwise(x.cast("long")))
    labels = F.transform(t, lambda x, i: F.when(F.get("_c", i), x.cast("long")).otherwise(F.lit(-100).cast("long")))
    return masked.withColumn("input_ids", ids).withColumn("labels", labels).drop("_c", "_m")


def split(rows: DataFrame, key: str, validation: float = 0.1, seed: int = 3) -> DataFrame:
    """The rows with a split of train or validation, by a seeded hash of the key."""
    place = F.conv(F.substring(order_key(F.lit(seed), key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(place < validation, "validation").otherwise("train"))


def infonce(triplets: DataFrame, temperature: float = 0.07) -> DataFrame:
    """The mean loss -log softmax of the positive similarity against the negative one."""
    p, n = F.col("positive") / temperature, F.col("negative") / temperature
    most = F.greatest(p, n)
    return triplets.agg(F.avg(most + F.ln(F.exp(p - most) + F.exp(n - most)) - p).alias("loss"), F.count("*").alias("n"))
