"""Domain classification of files by path, imports and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adherix.functions import domain_patterns as dp
from adherix.functions.regexdialect import from_start, java
from adherix.operators.scan import worth_matching

# Domains in order (ties go to the first), and weights of the three signals.
DOMAINS = ("frontend", "backend", "database", "infrastructure", "testing", "configuration", "documentation")
PATH_WEIGHT = {"backend": 0.8, "frontend": 0.8, "database": 0.9, "infrastructure": 0.9, "testing": 0.9, "configuration": 0.8, "documentation": 0.7}
IMPORT_WEIGHT = {"frontend": 0.8, "backend": 0.8, "database": 0.9, "testing": 0.9}
CONTENT_WEIGHT = {"frontend": 0.7, "backend": 0.8, "database": 0.9, "testing": 0.9}
#: Importance of a domain in the code-focused score.
DOMAIN_IMPORTANCE = {"backend": 1.0, "frontend": 1.0, "testing": 0.9, "database": 0.8, "infrastructure": 0.7, "unknown": 0.5, "configuration": 0.3, "documentation": 0.2}


def _hits(files: DataFrame) -> DataFrame:
    """One column per pattern: whether a path or import pattern matches, how often a content pattern does (5 at most).

    So many columns keep the stage out of one huge generated method; Spark then
    compiles the expressions in pieces.
    """
    cols = [F.when(F.rlike("path", F.lit(from_start("|".join(f"(?:{p})" for p in dp.PATHS[d]), "i"))), F.lit(PATH_WEIGHT[d])).otherwise(0.0).alias(f"r_{d}") for d in DOMAINS]

    def guarded(p: str, value: Column, none: Column) -> Column:
        may = worth_matching(p, F.col("low"), True)
        return value if may is None else F.when(may, value).otherwise(none)

    for d, ps in dp.IMPORTS.items():
        cols += [guarded(p, F.rlike("content", F.lit(java(p, "im"))), F.lit(False)).cast("int").alias(f"i_{d}_{n}") for n, p in enumerate(ps)]
    for d, ps in dp.CONTENT.items():
        cols += [guarded(p, F.least(F.lit(5), F.regexp_count("content", F.lit(java(p, "im")))), F.lit(0)).alias(f"c_{d}_{n}") for n, p in enumerate(ps)]
    return files.withColumn("low", F.lower("content")).select("file_id", "path", *cols)


def _scored(files: DataFrame) -> tuple[DataFrame, list[Column]]:
    """file_id, path and the scores of the domains, and for each domain the struct of domain, ord, path_score, import_score, content_score, combined."""

    def share(prefix: str, table: dict, weights: dict, d: str, times: int) -> Column:
        if d not in table:
            return F.lit(0.0)
        n = len(table[d])
        hits = F.aggregate(F.array(*[F.col(f"{prefix}_{d}_{i}") for i in range(n)]), F.lit(0), lambda a, x: a + x)
        return F.least(F.lit(1.0), hits / float(times * n) * weights[d])

    hits = _hits(files).withColumn("most", F.greatest(*[F.col(f"r_{d}") for d in DOMAINS]))
    cols, rows = [], []
    for n, d in enumerate(DOMAINS):
        path = F.when(F.col("most") > 0, F.col(f"r_{d}") / F.col("most")).otherwise(0.0)
        cols += [path.alias(f"p_{d}"), share("i", dp.IMPORTS, IMPORT_WEIGHT, d, 1).alias(f"i_{d}"), share("c", dp.CONTENT, CONTENT_WEIGHT, d, 3).alias(f"c_{d}")]
        p, i, c = (F.col(f"{x}_{d}") for x in "pic")
        rows.append(F.struct(F.lit(d).alias("domain"), F.lit(n).alias("ord"), p.alias("path_score"), i.alias("import_score"), c.alias("content_score"), (p * 0.4 + i * 0.3 + c * 0.3).alias("combined")))
    return hits.select("file_id", "path", *cols), rows


def signals(files: DataFrame) -> DataFrame:
    """file_id, path, domain, ord, path_score, import_score, content_score, combined: a row per file and domain."""
    scored, rows = _scored(files)
    return scored.select("file_id", "path", F.explode(F.array(*rows)).alias("x")).select("file_id", "path", "x.*")


def classify(files: DataFrame) -> DataFrame:
    """file_id, path, domain, confidence, secondaries (domain, score): the classification of each file.

    Ties go to the domain named first.  A file without a signal of 0.3 is unknown
    with a confidence of at least 0.5; empty content leaves the path to decide.
    The seven domains of a file are ranked within its row, without a shuffle;
    repeated rows give repeated results.
    """
    scored, rows = _scored(files)
    ordered = F.array_sort(F.array(*[F.struct((-r["combined"]).alias("o"), r["ord"].alias("n"), r.alias("x")) for r in rows]))
    # a generator of one row: the ranking is worked out once, however often it is used below
    best = scored.select("file_id", "path", F.inline(F.array(F.struct(ordered.alias("ranked")))))
    one, two = F.get("ranked", F.lit(0))["x"], F.get("ranked", F.lit(1))["x"]
    top = one["combined"]
    gate = ((one["domain"] == "testing") & (top >= 0.35)) | ((top >= 0.3) & (top - two["combined"] >= 0.05))
    parts = [one[c] for c in ("path_score", "import_score", "content_score")]
    n1, n15, n2 = (sum(((c > low).cast("int") if low == 0.1 else (c >= low).cast("int") for c in parts), F.lit(0)) for low in (0.1, 0.15, 0.2))
    most = F.greatest(*parts)
    factor = F.when(~gate, 1.0).when((most >= 0.8) & (n15 == 1), 2.2).when((n1 >= 2) & (most >= 0.7), F.when(n2 >= 2, 1.8).otherwise(1.5)).when((most >= 0.7) & (n1 == 1), 1.4).otherwise(1.0)
    judged = best.withColumn("b", F.least(F.lit(1.0), top * factor))
    unknown = F.col("b") < 0.3
    shown = F.filter("ranked", lambda y: y["x"]["combined"] > 0.1)
    secondaries = F.transform(F.slice(F.when(unknown, shown).otherwise(F.slice(shown, 2, 3)), 1, 3), lambda y: F.struct(y["x"]["domain"].alias("domain"), y["x"]["combined"].alias("score")))
    return judged.select("file_id", "path", F.when(unknown, "unknown").otherwise(one["domain"]).alias("domain"), F.when(unknown, F.greatest(F.lit(0.5), F.col("b"))).otherwise(F.col("b")).alias("confidence"), secondaries.alias("secondaries"))


def recommendations(classified: DataFrame) -> DataFrame:
    """file_id, rule_id, severity, category: what the classification says of each file."""
    said = F.array(
        F.when(F.col("confidence") < 0.6, F.struct(F.lit("LOW_DOMAIN_CONFIDENCE").alias("rule_id"), F.lit("info").alias("severity"))),
        F.when(F.col("domain") == "unknown", F.struct(F.lit("UNKNOWN_DOMAIN").alias("rule_id"), F.lit("warning").alias("severity"))),
        F.when(F.size("secondaries") > 2, F.struct(F.lit("MIXED_DOMAIN_CONCERNS").alias("rule_id"), F.lit("info").alias("severity"))),
    )
    return classified.select("file_id", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x")).select("file_id", "x.*", F.lit("domain_classification").alias("category"))


def diagnostics(files: DataFrame) -> DataFrame:
    """file_id, domain, category, matched, missing, score: per domain and kind of signal the patterns that a file holds and lacks.

    ``matched`` and ``missing`` list the patterns themselves; of the missing ones the
    first five.  Domains without patterns of a kind give no row of it.
    """
    hits = _hits(files)
    rows = []
    for d in DOMAINS:
        path = [F.rlike("path", F.lit(from_start(f"(?:{p})", "i"))).cast("int") for p in dp.PATHS[d]]
        kinds = [("path", dp.PATHS[d], path, PATH_WEIGHT[d], 0)]
        if d in dp.IMPORTS:
            kinds.append(("import", dp.IMPORTS[d], [F.col(f"i_{d}_{i}") for i in range(len(dp.IMPORTS[d]))], IMPORT_WEIGHT[d], 1))
        if d in dp.CONTENT:
            kinds.append(("content", dp.CONTENT[d], [F.col(f"c_{d}_{i}") for i in range(len(dp.CONTENT[d]))], CONTENT_WEIGHT[d], 3))
        for kind, patterns, found, weight, times in kinds:
            pairs = F.arrays_zip(F.array(*[F.lit(p) for p in patterns]).alias("p"), F.array(*found).alias("n"))
            total = F.aggregate(F.array(*found), F.lit(0), lambda a, x: a + x)
            score = F.when(total > 0, F.lit(weight)).otherwise(0.0) if kind == "path" else F.least(F.lit(1.0), total / float(times * len(patterns)) * weight)
            held, lacked = F.filter(pairs, lambda x: x["n"] > 0), F.filter(pairs, lambda x: x["n"] == 0)
            rows.append(F.struct(F.lit(d).alias("domain"), F.lit(kind).alias("category"), F.transform(held, lambda x: x["p"]).alias("matched"), F.slice(F.transform(lacked, lambda x: x["p"]), 1, 5).alias("missing"), score.alias("score")))
    return hits.select("file_id", F.explode(F.array(*rows)).alias("x")).select("file_id", "x.*")


def missing_summary(rows: DataFrame) -> DataFrame:
    """file_id, domain, missing: of the diagnostics the three most useful patterns that a domain lacks, imports first, then content, then path."""
    rank = F.when(F.col("category") == "import", 0).when(F.col("category") == "content", 1).otherwise(2)
    few = F.slice("missing", 1, F.when(F.col("category") == "import", 3).when(F.col("category") == "content", 2).otherwise(1))
    g = rows.groupBy("file_id", "domain").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), few.alias("m")))).alias("all"))
    return g.select("file_id", "domain", F.slice(F.array_distinct(F.flatten(F.transform("all", lambda x: x["m"]))), 1, 3).alias("missing"))
