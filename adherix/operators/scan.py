"""Rule scan: files times rules, as columns.

``files`` is any DataFrame with ``file_id``, ``path`` and ``content``; all functions
are projections (with one grouping where a roll-up is asked for), so they take
streaming frames as well.  Null content counts as empty, a null path matches no
path rule.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adherix.functions import rules
from adherix.functions.regexdialect import java, needles, sql_string

ANALYZERS = tuple(rules.SCOPES)
_IMPORTS = [  # fixed values: the four forms of an import line, the first that matches counts
    r"import\s*\{\s*([^}]+)\s*\}\s*from\s*['\"]([^'\"]+)['\"]",
    r"import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]",
    r"import\s*\*\s*as\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]",
    r"import\s+['\"]([^'\"]+)['\"]",
]


def as_files(df: DataFrame, file_id: str, path: str, content: str) -> DataFrame:
    """Any table as files; the name is the last part of the path."""
    return df.select(F.col(file_id).alias("file_id"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"([^/\\]*)$", 1).alias("name"), F.coalesce(F.col(content), F.lit("")).alias("content"))


def worth_matching(pattern: str, text: Column, lower: bool = False) -> Column | None:
    """Whether a text holds the literals of a pattern; None if the pattern shows none."""
    lists = needles(pattern)
    if lists is None:
        return None
    every = [reduce(and_, [F.contains(text, F.lit(x.lower() if lower else x)) for x in dict.fromkeys(xs)]) for xs in lists]
    return reduce(or_, every)


def count_column(name: str) -> Column:
    """How often the patterns of a count match; a literal that each match holds is looked for first."""
    spec = rules.COUNTS[name]
    total = None
    for p in spec.patterns:
        n = F.regexp_count("content", F.lit(java(p, spec.flags)))
        may = worth_matching(p, F.col("content"))
        n = n if may is None else F.when(may, n).otherwise(0)
        total = n if total is None else total + n
    return total.cast("long").alias(f"c_{name}")


def used(texts: Iterable[str]) -> list[str]:
    """Names of the counts that SQL texts mention, in the order of the tables."""
    joined = " ".join(texts)
    return [n for n in (*rules.COUNTS, *rules.DERIVED) if f"c_{n} " in joined + " " or f"c_{n})" in joined or f"c_{n}," in joined]


def imports_of(content: Column) -> Column:
    """The imports of a text in their order, as an array of (module, kind); no shuffle and no row per line."""
    lines = F.filter(F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.startswith("import"))

    def module(x: Column) -> Column:
        out = None
        for i, p in enumerate(_IMPORTS):
            hit, got = F.rlike(x, F.lit("^(?:" + p + ")")), F.regexp_extract(x, r"^(?:" + p + ")", 1 if i == 3 else 2)
            out = F.when(hit, got) if out is None else out.when(hit, got)
        return out

    kind = lambda m: F.when(m.startswith("@/"), "absolute_internal").when(m.startswith("./") | m.startswith("../"), "relative").when(~m.startswith("."), "external").otherwise("unknown")
    known = F.filter(F.transform(lines, module), lambda m: m.isNotNull())
    none = F.array().cast("array<struct<module:string,kind:string>>")
    return F.when(F.contains(content, F.lit("import")), F.transform(known, lambda m: F.struct(m.alias("module"), kind(m).alias("kind")))).otherwise(none)


#: An effect with its dependency list: what it does and what it lists.
EFFECT = r"useEffect\s*\(\s*\(\s*\)\s*=>\s*\{([^}]*)\},\s*\[([^\]]*)\]"


def derived_column(name: str) -> Column:
    """A count that is derived from the imports in ``_imports`` or from the effects of a text."""
    kinds = F.transform("_imports", lambda x: x["kind"])
    if name == "imports":
        n = F.size("_imports")
    elif name == "absolute_imports":
        n = F.size(F.filter(kinds, lambda k: k == "absolute_internal"))
    elif name == "deep_relative":
        n = F.size(F.filter("_imports", lambda x: (x["kind"] == "relative") & (F.regexp_count(x["module"], F.lit(r"\.\./")) > 2)))
    elif name == "ungrouped":  # external, then internal, then relative ones; two imports are too few to tell
        inf = F.lit(1 << 30)
        place = lambda k: F.when(F.array_position(kinds, k) == 0, inf).otherwise(F.array_position(kinds, k))
        back = F.array_position(F.reverse(kinds), "external")
        last = F.when(back == 0, 0).otherwise(F.size("_imports") - back + 1)
        n = ((F.size("_imports") >= 3) & ~((last < place("absolute_internal")) & (place("absolute_internal") < place("relative")))).cast("int")
    else:
        p = F.lit(java(EFFECT))
        both = F.arrays_zip(F.regexp_extract_all("content", p, F.lit(1)).alias("body"), F.regexp_extract_all("content", p, F.lit(2)).alias("deps"))
        stale = F.size(F.filter(both, lambda e: F.regexp_count(e["body"], F.lit(java(r"\b[a-zA-Z_]\w*\b"))) > F.size(F.filter(F.split(e["deps"], ","), lambda d: F.trim(F.regexp_replace(d, r"\s+", " ")) != "")) + 2))
        n = F.when(F.contains("content", F.lit("useEffect")), stale).otherwise(0)
    return n.cast("long").alias(f"c_{name}")


def counted(files: DataFrame, analyzer: str, texts: Iterable[str]) -> DataFrame:
    """The files in an engine's scope with the counts that SQL texts mention."""
    scope = f"{rules.SCOPES[analyzer]} AND NOT {rules.EXCLUDED}"
    names = used(texts)
    base = files.where(scope).select("file_id", "path", "name", "content")
    if any(n in rules.DERIVED[:4] for n in names):
        base = base.withColumn("_imports", imports_of(F.col("content")))
    return base.select("file_id", "path", "name", "content", *[derived_column(n) if n in rules.DERIVED else count_column(n) for n in names])


def emitters(analyzer: str) -> list[tuple]:
    return [e for e in rules.EMITTERS if e[0] == analyzer]


def recommendations_of(analyzer: str) -> list[tuple]:
    return [r for r in rules.RECOMMENDATIONS if r[0] == analyzer]


def emitted(e: tuple) -> str:
    """SQL of the number of matches that an emitter gives for a file."""
    return f"CASE WHEN {e[4]} THEN CAST({e[5]} AS BIGINT) ELSE 0 END"


def pattern_matches(files: DataFrame, analyzer: str) -> DataFrame:
    """file_id, analyzer, pattern_name, pattern_type, confidence, matches: one row per file and pattern found."""
    es = emitters(analyzer)
    structs = ", ".join(f"named_struct('pattern_name', {sql_string(e[1])}, 'pattern_type', {sql_string(e[2])}, 'confidence', CAST({e[3]} AS DOUBLE), 'matches', {emitted(e)})" for e in es)
    wide = counted(files, analyzer, [e[5] for e in es]).selectExpr("file_id", f"inline(array({structs}))")
    return wide.where("matches > 0").select("file_id", F.lit(analyzer).alias("analyzer"), "pattern_name", "pattern_type", "confidence", "matches")


def recommendations(files: DataFrame, analyzer: str) -> DataFrame:
    """file_id, analyzer, rule_id, severity, category, times, seq: one row per file and rule that fires.

    ``seq`` is the place of the rule in the order in which the engines speak.

    A file whose first line is empty and that trips one of the fragile rules gives
    the single row ANALYSIS_ERROR instead.
    """
    rs = recommendations_of(analyzer)
    base = counted(files, analyzer, [r[4] for r in rs])
    structs = ", ".join(f"named_struct('rule_id', {sql_string(r[1])}, 'severity', {sql_string(r[2])}, 'category', {sql_string(r[3])}, 'times', CAST({r[4]} AS BIGINT), 'seq', {rules.RECOMMENDATIONS.index(r)})" for r in rs)
    failed = failure(analyzer)
    error = f"array(named_struct('rule_id', 'ANALYSIS_ERROR', 'severity', 'error', 'category', 'analysis', 'times', CAST(1 AS BIGINT), 'seq', {rules.RECOMMENDATIONS.index(rs[0])}))"
    wide = base.selectExpr("file_id", f"inline(CASE WHEN {failed} THEN {error} ELSE array({structs}) END)")
    return wide.where("times > 0").select("file_id", F.lit(analyzer).alias("analyzer"), "rule_id", "severity", "category", "times", "seq")


def failure(analyzer: str) -> str:
    """SQL of whether an engine breaks off on a file."""
    fragile = [r[4] for r in recommendations_of(analyzer) if r[1] in rules.FRAGILE]
    return f"(content LIKE '\n%' AND ({' + '.join(fragile)}) > 0)" if fragile else "FALSE"


def score_sql(analyzer: str, complexity: str = "0") -> str:
    """SQL of an engine's score over the counts; ``complexity`` is what quality takes off for long code."""
    bonus, other = rules.BONUS[analyzer]
    key = 2 if analyzer == "quality" else 1
    gains = [f"{round(bonus.get(e[key], other) * e[3], 6)} * ({emitted(e)})" for e in emitters(analyzer)]
    losses = [f"{rules.PENALTY[analyzer][r[2]]} * ({r[4]})" for r in recommendations_of(analyzer)]
    total = f"CAST({rules.BASE_SCORE[analyzer]} AS DOUBLE) + {' + '.join(gains)} - ({' + '.join(losses)})"
    if analyzer == "quality":
        total = f"{total} + {rules.QUALITY_BONUS} - {complexity}"
    if analyzer == "typescript":
        total = f"({total} + {rules.STRICT_TYPING}) / 2"
    return f"CASE WHEN {failure(analyzer)} THEN 0.0 ELSE greatest(0.0, least(1.0, {total})) END"


def nesting(content: Column) -> Column:
    """Deepest running balance of braces over the lines that are no comments."""
    lines = F.filter(F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("/*"))
    balance = F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}")))
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("most"))
    return F.aggregate(balance, start, lambda a, d: F.struct((a["cur"] + d).alias("cur"), F.greatest(a["most"], a["cur"] + d).alias("most")))["most"]


_HEADER = r"(function\s+\w+|const\s+\w+\s*=\s*.*=>|\w+\s*\(.*\)\s*\{)"


def function_lengths(content: Column) -> Column:
    """Lengths in lines of the functions that a scan for headers and balanced braces finds."""
    lines = F.transform(F.split(content, "\n", -1), lambda x: F.struct(F.rlike(x, F.lit(java(_HEADER))).alias("h"), (F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}"))).alias("d")))
    empty = F.array().cast("array<int>")
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("n"), F.lit(0).alias("b"), empty.alias("lens"))

    def step(a: Column, x: Column) -> Column:
        inside = a["open"]
        b = F.when(inside, a["b"] + x["d"]).otherwise(x["d"])
        n = F.when(inside, a["n"] + 1).otherwise(F.lit(1))
        begun = inside | x["h"]
        lens = F.when(begun & (b == 0), F.concat(a["lens"], F.array(n))).otherwise(a["lens"])
        return F.struct((begun & (b > 0)).alias("open"), n.alias("n"), b.alias("b"), lens.alias("lens"))

    return F.aggregate(lines, start, step)["lens"]


def complexity(files: DataFrame) -> DataFrame:
    """file_id, lines, nesting, functions, mean_length, penalty."""
    lens = function_lengths(F.col("content"))
    df = files.select("file_id", F.size(F.split("content", "\n", -1)).cast("long").alias("lines"), nesting(F.col("content")).cast("long").alias("nesting"), lens.alias("_l"))
    mean = F.try_divide(F.aggregate("_l", F.lit(0.0), lambda a, x: a + x), F.size("_l"))
    df = df.select("file_id", "lines", "nesting", F.size("_l").cast("long").alias("functions"), F.coalesce(mean, F.lit(0.0)).alias("mean_length"))
    return df.withColumn("penalty", complexity_penalty())


def complexity_penalty() -> Column:
    return F.expr("CASE WHEN lines > 1000 THEN 0.08D WHEN lines > 500 THEN 0.04D WHEN lines > 300 THEN 0.02D ELSE 0D END + CASE WHEN nesting > 5 THEN 0.06D WHEN nesting > 3 THEN 0.03D ELSE 0D END + CASE WHEN mean_length > 50 THEN 0.05D WHEN mean_length > 30 THEN 0.02D ELSE 0D END")


def scores(files: DataFrame, analyzer: str) -> DataFrame:
    """file_id, path, analyzer, score, failed of every file in an engine's scope."""
    texts = [e[5] for e in emitters(analyzer)] + [r[4] for r in recommendations_of(analyzer)] + [rules.QUALITY_BONUS] * (analyzer == "quality") + [rules.STRICT_TYPING] * (analyzer == "typescript")
    base = counted(files, analyzer, texts)
    if analyzer == "quality":
        c = F.col("content")
        base = base.withColumn("_l", function_lengths(c)).withColumn("lines", F.size(F.split(c, "\n", -1))).withColumn("nesting", nesting(c))
        base = base.withColumn("mean_length", F.coalesce(F.try_divide(F.aggregate("_l", F.lit(0.0), lambda a, x: a + x), F.size("_l")), F.lit(0.0))).withColumn("penalty", complexity_penalty())
    return base.selectExpr("file_id", "path", f"'{analyzer}' AS analyzer", f"CAST({score_sql(analyzer, 'penalty')} AS DOUBLE) AS score", f"{failure(analyzer)} AS failed")


def all_scores(files: DataFrame) -> DataFrame:
    """The scores of the four engines, one projection each."""
    out = scores(files, ANALYZERS[0])
    for a in ANALYZERS[1:]:
        out = out.unionByName(scores(files, a))
    return out


def import_lines(files: DataFrame) -> DataFrame:
    """file_id, line_number, module, import_type: the lines that one of the import forms matches."""
    lines = files.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "raw")).select("file_id", (F.col("pos") + 1).cast("long").alias("line_number"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line")).where(F.col("line").startswith("import"))
    module = None
    for i, p in enumerate(_IMPORTS):
        got = F.regexp_extract("line", r"^(?:" + p + ")", 1 if i == 3 else 2)
        module = F.when(F.rlike("line", F.lit("^(?:" + p + ")")), got) if module is None else module.when(F.rlike("line", F.lit("^(?:" + p + ")")), got)
    m = F.col("module")
    kind = F.when(m.startswith("@/"), "absolute_internal").when(m.startswith("./") | m.startswith("../"), "relative").when(~m.startswith("."), "external").otherwise("unknown")
    return lines.withColumn("module", module).where("module IS NOT NULL").select("file_id", "line_number", "module", kind.alias("import_type"))


def import_grouping(files: DataFrame) -> DataFrame:
    """file_id, imports, absolute, deep_relative, grouped, organisation: how the imports of a file are ordered."""
    i = import_lines(files).withColumn("k", F.row_number().over(_by_file()))
    g = i.groupBy("file_id").agg(
        F.count("*").alias("imports"),
        F.count_if(F.col("import_type") == "absolute_internal").alias("absolute"),
        F.count_if((F.col("import_type") == "relative") & (F.regexp_count("module", F.lit(r"\.\./")) > 2)).alias("deep_relative"),
        F.max(F.when(F.col("import_type") == "external", F.col("k"))).alias("_e"),
        F.min(F.when(F.col("import_type") == "absolute_internal", F.col("k"))).alias("_a"),
        F.min(F.when(F.col("import_type") == "relative", F.col("k"))).alias("_r"),
    )
    inf = F.lit(1 << 30)
    ordered = (F.coalesce("_e", F.lit(0)) < F.coalesce("_a", inf)) & (F.coalesce("_a", inf) < F.coalesce("_r", inf))
    grouped = (F.col("imports") < 3) | ordered
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.when(F.col("absolute") > 0, 0.2).otherwise(0.0) + F.when(grouped, 0.2).otherwise(0.0) - F.when(F.col("deep_relative") > 0, 0.1).otherwise(0.0)))
    return g.select("file_id", "imports", "absolute", "deep_relative", grouped.alias("grouped"), score.alias("organisation"))


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("file_id").orderBy("line_number")


def import_organisation(files: DataFrame) -> DataFrame:
    """file_id, organisation of every file; 1 where nothing is imported."""
    known = import_grouping(files).select("file_id", "organisation")
    return files.select("file_id").join(known, "file_id", "left").select("file_id", F.coalesce("organisation", F.lit(1.0)).alias("organisation"))


def metrics(files: DataFrame) -> DataFrame:
    """Per file in scope the counts that the engines report beside their scores, in one projection."""
    names = ["imports", "interfaces", "aliases", "generic_components", "generic_interfaces", "any_usage", "return_types", "react_hooks", "function_component"]
    base = counted(files, "quality", [f"c_{n} " for n in names])
    return base.select(
        "file_id", F.col("c_imports").alias("import_count"), F.size(F.split("content", "\n", -1)).cast("long").alias("file_size_lines"), F.col("c_interfaces").alias("interfaces_defined"), F.col("c_aliases").alias("type_aliases_defined"),
        (F.col("c_generic_components") + F.col("c_generic_interfaces")).alias("generic_usage_count"), F.col("c_any_usage").alias("any_usage_count"), F.col("c_return_types").alias("function_return_types"), F.col("c_react_hooks").alias("hooks_count"),
        (F.col("c_function_component") > 0).alias("function_component"), F.expr(rules.API).alias("api_route"), F.expr(rules.PAGE).alias("page_component"), F.expr(rules.LAYOUT).alias("layout_component"),
    )


def user_rules(files: DataFrame, emitters: list[tuple], recommendations: list[tuple] = (), base: float = 0.6) -> DataFrame:
    """file_id, path, score, patterns, recommendations under rules of one's own: the extension point of the engines.

    An emitter is (name, confidence, bonus, SQL of how often it is found) and a
    recommendation (rule, severity, penalty, SQL of how often it fires); both may use
    ``path``, ``name`` and ``content``.  The score is the base with bonuses times
    confidences added and penalties taken off, held to [0, 1].
    """
    for kind in (emitters, recommendations):
        bad = [r[0] for r in kind if len(r) != 4]
        if bad:
            raise ValueError(f"rules need four parts: {bad}")
    gain = " + ".join(f"{e[1]} * {e[2]} * ({e[3]})" for e in emitters) or "0.0"
    loss = " + ".join(f"{r[2]} * ({r[3]})" for r in recommendations) or "0.0"
    found = ", ".join(f"named_struct('name', {sql_string(e[0])}, 'times', CAST({e[3]} AS BIGINT))" for e in emitters)
    fired = ", ".join(f"named_struct('name', {sql_string(r[0])}, 'times', CAST({r[3]} AS BIGINT))" for r in recommendations)
    none = "CAST(array() AS ARRAY<STRUCT<name: STRING, times: BIGINT>>)"
    return files.selectExpr(
        "file_id", "path", f"CAST(greatest(0.0D, least(1.0D, CAST({base} AS DOUBLE) + {gain} - ({loss}))) AS DOUBLE) AS score",
        f"filter({f'array({found})' if found else none}, x -> x.times > 0) AS patterns", f"filter({f'array({fired})' if fired else none}, x -> x.times > 0) AS recommendations",
    )


def every_match(files: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """count_name, pattern_no and the columns of ``match_details`` for all patterns of all counts."""
    out = None
    for name in names or rules.COUNTS:
        for i in range(len(rules.COUNTS[name].patterns)):
            one = match_details(files, name, i).select(F.lit(name).alias("count_name"), F.lit(i).cast("long").alias("pattern_no"), "file_id", "nth", "char_offset", "line_number", "matched_text")
            out = one if out is None else out.unionByName(one)
    return out


def match_details(files: DataFrame, name: str, pattern: int = 0) -> DataFrame:
    """file_id, nth, char_offset, line_number, matched_text: every match of one pattern of a count, without a UDF.

    The pieces between matches are as many as the matches and one more, so the
    offset of a match is the length of what stands before it.
    """
    spec = rules.COUNTS[name]
    p = java(spec.patterns[pattern], spec.flags)
    found = files.where(F.rlike("content", F.lit(p))).select("file_id", "content", F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("m"), F.split("content", p, -1).alias("b"))
    rows = found.select("file_id", "content", "m", "b", F.posexplode("m").alias("i", "matched_text"))
    before = F.aggregate(F.slice("b", 1, F.col("i") + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("m", 1, F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
    return rows.withColumn("char_offset", before.cast("long")).select("file_id", (F.col("i") + 1).cast("long").alias("nth"), "char_offset", (F.regexp_count(F.substring("content", F.lit(1), F.col("char_offset").cast("int")), F.lit("\n")) + 1).cast("long").alias("line_number"), "matched_text")
