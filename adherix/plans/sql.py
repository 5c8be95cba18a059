"""The registered queries as SQL for DuckDB, built from the same rule tables."""

from __future__ import annotations

from adherix.functions import domain_patterns as dp
from adherix.functions import rules
from adherix.functions.regexdialect import duck, sql_string
from adherix.operators import classify, scan

FILES = (
    "files AS (SELECT chunk_id AS file_id, coalesce(file_path, '') AS path, regexp_extract(coalesce(file_path, ''), '([^/\\\\]*)$', 1) AS name, coalesce(function_code, '') AS content, repo "
    "FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) AS _n FROM function_chunks WHERE chunk_id IS NOT NULL) WHERE _n = 1)"
)
INDEX = (
    "usable AS (SELECT ref_id, domain, file_path, commit_id, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY ref_ord DESC) AS _n FROM pattern_index WHERE ref_id IS NOT NULL AND domain IS NOT NULL) "
    "WHERE _n = 1 AND embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64 AND len([x FOR x IN embedding IF x <> 0]) > 0)"
)
NEIGHBOURS = (
    "near AS (SELECT query_id, rank, ref_file, ref_id, domain, greatest(-1.0, least(1.0, similarity)) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY searched_at DESC) AS _n FROM neighbors) WHERE _n = 1 AND similarity IS NOT NULL)"
)
KNN = INDEX + (
    ", knn AS (SELECT query_id, domain, ref_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, ref_id) AS rank FROM "
    "(SELECT q.ref_id AS query_id, q.domain, r.ref_id, list_cosine_similarity(q.v, r.v) AS similarity FROM usable q JOIN usable r ON q.domain = r.domain AND q.ref_id <> r.ref_id WHERE q.ref_id % 50 = 0) WHERE similarity >= 0.3 QUALIFY rank <= 5)"
)
ADAPTIVE = KNN + ", scored AS (SELECT query_id, domain, CASE WHEN max(similarity) >= 0.85 THEN max(similarity) ELSE avg(CASE WHEN rank <= 3 THEN similarity END) END AS score, count(*) AS hits, max(similarity) AS best FROM knn GROUP BY ALL)"


IMPORT_LINES = (
    "l AS (SELECT file_id, generate_subscripts(string_split(content, chr(10)), 1) AS line_number, unnest(string_split(content, chr(10))) AS raw FROM files), t AS (SELECT file_id, line_number, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l), m AS (SELECT file_id, line_number, CASE "
    + " ".join(f"WHEN regexp_matches(line, {sql_string('^(?:' + p + ')')}) THEN regexp_extract(line, {sql_string('^(?:' + p + ')')}, {1 if i == 3 else 2})" for i, p in enumerate(scan._IMPORTS))
    + " END AS module FROM t WHERE line LIKE 'import%'), im AS (SELECT file_id, CAST(line_number AS BIGINT) AS line_number, module, CASE WHEN module LIKE '@/%' THEN 'absolute_internal' WHEN module LIKE './%' OR module LIKE '../%' THEN 'relative' WHEN module NOT LIKE '.%' THEN 'external' ELSE 'unknown' END AS import_type FROM m WHERE module IS NOT NULL)"
)
GROUPED = (
    "gi AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS k FROM im), ga AS (SELECT file_id, count(*) AS imports, count(*) FILTER (import_type = 'absolute_internal') AS absolute, count(*) FILTER (import_type = 'relative' AND len(regexp_extract_all(module, '\\.\\./')) > 2) AS deep_relative, "
    "coalesce(max(CASE WHEN import_type = 'external' THEN k END), 0) AS e, coalesce(min(CASE WHEN import_type = 'absolute_internal' THEN k END), 1 << 30) AS a, coalesce(min(CASE WHEN import_type = 'relative' THEN k END), 1 << 30) AS r FROM gi GROUP BY file_id), gg AS (SELECT *, imports < 3 OR (e < a AND a < r) AS grouped FROM ga)"
)
_DERIVED = {
    "imports": "coalesce(imports, 0)", "absolute_imports": "coalesce(absolute, 0)", "deep_relative": "coalesce(deep_relative, 0)", "ungrouped": "CASE WHEN NOT coalesce(grouped, TRUE) THEN 1 ELSE 0 END",
    "stale_effects": f"len([x FOR x IN list_zip(regexp_extract_all(content, {sql_string(scan.EFFECT)}, 1), regexp_extract_all(content, {sql_string(scan.EFFECT)}, 2)) IF len(regexp_extract_all(x[1], '\\b[a-zA-Z_]\\w*\\b')) > len([y FOR y IN string_split(x[2], ',') IF trim(regexp_replace(y, '\\s+', ' ', 'g')) <> '']) + 2])",
}


def count_sql(name: str) -> str:
    if name in _DERIVED:
        return _DERIVED[name]
    spec = rules.COUNTS[name]
    if name == "img_without_alt":
        return "len([x FOR x IN regexp_extract_all(content, '<img[^>]*') IF NOT contains(x, 'alt=')])"
    if name == "button_without_aria":
        return "len([x FOR x IN regexp_extract_all(content, '<button[^>]*') IF NOT contains(x, 'aria-')])"
    return " + ".join(f"len(regexp_extract_all(content, {sql_string(duck(p, spec.flags))}))" for p in (spec.plain or spec.patterns))


def counted(analyzer: str, texts: list[str]) -> str:
    names = scan.used(texts)
    cols = "".join(f", CAST({count_sql(n)} AS BIGINT) AS c_{n}" for n in names)
    scope = f"WHERE {rules.SCOPES[analyzer]} AND NOT {rules.EXCLUDED}"
    if any(n in _DERIVED and n != "stale_effects" for n in names):
        return f"{FILES}, {IMPORT_LINES}, {GROUPED}, counted AS (SELECT file_id, path, name, content{cols} FROM files LEFT JOIN gg USING (file_id) {scope})"
    return f"{FILES}, counted AS (SELECT file_id, path, name, content{cols} FROM files {scope})"


def patterns(analyzer: str) -> str:
    es = scan.emitters(analyzer)
    parts = " UNION ALL ".join(f"SELECT file_id, {sql_string(analyzer)} AS analyzer, {sql_string(e[1])} AS pattern_name, {sql_string(e[2])} AS pattern_type, CAST({e[3]} AS DOUBLE) AS confidence, CAST({scan.emitted(e)} AS BIGINT) AS matches FROM counted" for e in es)
    return f"WITH {counted(analyzer, [e[5] for e in es])} SELECT * FROM ({parts}) WHERE matches > 0"


def recommendations(analyzer: str) -> str:
    rs = scan.recommendations_of(analyzer)
    failed = scan.failure(analyzer)
    parts = " UNION ALL ".join(f"SELECT file_id, {sql_string(analyzer)} AS analyzer, {sql_string(r[1])} AS rule_id, {sql_string(r[2])} AS severity, {sql_string(r[3])} AS category, CAST(CASE WHEN {failed} THEN 0 ELSE {r[4]} END AS BIGINT) AS times, {rules.RECOMMENDATIONS.index(r)} AS seq FROM counted" for r in rs)
    error = f" UNION ALL SELECT file_id, {sql_string(analyzer)}, 'ANALYSIS_ERROR', 'error', 'analysis', 1, {rules.RECOMMENDATIONS.index(rs[0])} FROM counted WHERE {failed}"
    return f"WITH {counted(analyzer, [r[4] for r in rs])} SELECT * FROM ({parts}{error}) WHERE times > 0"


NESTING = (
    "nl AS (SELECT file_id, generate_subscripts(string_split(content, chr(10)), 1) AS n, regexp_replace(unnest(string_split(content, chr(10))), '^\\s+|\\s+$', '', 'g') AS x FROM files), "
    "nd AS (SELECT file_id, sum(len(regexp_extract_all(x, '\\{')) - len(regexp_extract_all(x, '\\}'))) OVER (PARTITION BY file_id ORDER BY n) AS cur FROM nl WHERE x <> '' AND x NOT LIKE '//%' AND x NOT LIKE '/*%'), "
    "nest AS (SELECT file_id, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines, CAST(greatest(0, coalesce(most, 0)) AS BIGINT) AS nesting FROM files LEFT JOIN (SELECT file_id, max(cur) AS most FROM nd GROUP BY file_id) USING (file_id))"
)
# the balance of braces is followed line by line: (inside, lines of this function, balance, functions, lines of all)
LENGTHS = (
    f"fl AS (SELECT file_id, list_transform(string_split(content, chr(10)), lambda x: {{'h': regexp_matches(x, {sql_string(scan._HEADER)}), 'd': CAST(len(regexp_extract_all(x, '\\{{')) - len(regexp_extract_all(x, '\\}}')) AS BIGINT), 'o': FALSE, 'n': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'f': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT)}}) AS ls FROM files), "
    "ff AS (SELECT file_id, list_reduce(list_prepend({'h': FALSE, 'd': CAST(0 AS BIGINT), 'o': FALSE, 'n': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'f': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT)}, ls), lambda a, x: {"
    "'h': a.o OR x.h, 'd': x.d, 'o': (a.o OR x.h) AND (CASE WHEN a.o THEN a.b + x.d ELSE x.d END) > 0, 'n': CASE WHEN a.o THEN a.n + 1 ELSE 1 END, 'b': CASE WHEN a.o THEN a.b + x.d ELSE x.d END,"
    " 'f': a.f + CASE WHEN (a.o OR x.h) AND (CASE WHEN a.o THEN a.b + x.d ELSE x.d END) = 0 THEN 1 ELSE 0 END, 't': a.t + CASE WHEN (a.o OR x.h) AND (CASE WHEN a.o THEN a.b + x.d ELSE x.d END) = 0 THEN (CASE WHEN a.o THEN a.n + 1 ELSE 1 END) ELSE 0 END}) AS z FROM fl), "
    "comp AS (SELECT file_id, lines, nesting, z.f AS functions, coalesce(z.t / nullif(z.f, 0), 0.0) AS mean_length FROM nest JOIN ff USING (file_id)), "
    "penal AS (SELECT *, CASE WHEN lines > 1000 THEN 0.08 WHEN lines > 500 THEN 0.04 WHEN lines > 300 THEN 0.02 ELSE 0.0 END + CASE WHEN nesting > 5 THEN 0.06 WHEN nesting > 3 THEN 0.03 ELSE 0.0 END + CASE WHEN mean_length > 50 THEN 0.05 WHEN mean_length > 30 THEN 0.02 ELSE 0.0 END AS penalty FROM comp)"
)


def scores(analyzer: str) -> str:
    texts = [e[5] for e in scan.emitters(analyzer)] + [r[4] for r in scan.recommendations_of(analyzer)] + [rules.STRICT_TYPING] * (analyzer == "typescript") + [rules.QUALITY_BONUS] * (analyzer == "quality")
    extra, source = (f", {NESTING}, {LENGTHS}", "counted JOIN penal USING (file_id)") if analyzer == "quality" else ("", "counted")
    return f"WITH {counted(analyzer, texts)}{extra} SELECT file_id, analyzer, round(score, 6) AS score, failed FROM (SELECT file_id, '{analyzer}' AS analyzer, CAST({scan.score_sql(analyzer, 'penalty')} AS DOUBLE) AS score, {scan.failure(analyzer)} AS failed FROM {source})"


def architectural_by_hand() -> str:
    """The architectural score written from its conditions, apart from the rule tables."""
    return f"""WITH {FILES}, {IMPORT_LINES}, {GROUPED},
        f AS (SELECT file_id, path, name, content, coalesce(imports, 0) AS imports, coalesce(absolute, 0) AS absolute, coalesce(deep_relative, 0) AS deep, coalesce(grouped, TRUE) AS grouped FROM files LEFT JOIN gg USING (file_id)
          WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AND NOT regexp_matches(path, 'node_modules|\\.git|dist|build|\\.next|__pycache__')),
        p AS (SELECT file_id,
          CAST(regexp_matches(path, '^src/app/\\[[^/]+\\]/') AS INT) + CAST(regexp_matches(path, '^src/app/.*/layout\\.tsx?$') AS INT) + CAST(regexp_matches(path, '^src/app/.*/page\\.tsx?$') AS INT)
            + CAST(regexp_matches(path, '^src/app/.*/loading\\.tsx?$') AS INT) + CAST(regexp_matches(path, '^src/app/.*/error\\.tsx?$') AS INT) + CAST(regexp_matches(path, '^src/app/api/.*/route\\.ts?$') AS INT) AS router,
          len(regexp_extract_all(content, 'export\\s+(const\\s+)?metadata\\s*[:=]')) + len(regexp_extract_all(content, 'export\\s+(const\\s+)?viewport\\s*[:=]')) + len(regexp_extract_all(content, 'export\\s+async\\s+function\\s+generateMetadata')) AS metadata,
          CAST(regexp_matches(path, '/(page|layout|loading|error)\\.') AND regexp_matches(content, 'export\\s+default\\s+function\\s+(\\w+)') AS INT) AS default_export,
          CAST(contains(path, 'src/components/') OR contains(path, 'src/app/') AS INT) AS structure, CAST(regexp_matches(path, '\\.(tsx|jsx)$') AND regexp_matches(name, '^[A-Z]') AS INT) AS pascal,
          CAST(absolute > 0 AS INT) AS absolute_imports, CAST(imports > 0 AND grouped AS INT) AS grouped_imports,
          CAST(deep > 0 AS INT) * 0.05 + CAST(NOT grouped AS INT) * 0.02
            + CAST(regexp_matches(path, '\\.(tsx|jsx)$') AND contains(path, 'components') AND NOT regexp_matches(name, '^[A-Z]') AS INT) * 0.05
            + CAST(NOT (contains(path, 'src/') OR contains(path, 'app/') OR contains(path, 'components/') OR contains(path, 'lib/') OR contains(path, 'types/')) AS INT) * 0.02
            + CAST(contains(path, '/layout.') AND NOT contains(content, 'metadata') AS INT) * 0.02
            + CAST(contains(path, '/page.') AND contains(content, 'async') AND NOT contains(content, 'use client') AND NOT regexp_matches(content, 'export\\s+default\\s+async\\s+function') AS INT) * 0.05 AS losses FROM f)
        SELECT file_id, 'architectural' AS analyzer, round(greatest(0.0, least(1.0, CAST(0.6 + 0.15 * 0.9 * router + 0.1 * 0.9 * metadata + 0.02 * 0.9 * default_export + 0.05 * 0.7 * structure + 0.05 * 0.8 * pascal + 0.1 * 0.9 * absolute_imports + 0.05 * 0.8 * grouped_imports - losses AS DOUBLE))), 6) AS score, FALSE AS failed FROM p"""


_LOOK = {r"src/app/(?!api).*\.(tsx?|jsx?)$": ("src/app/.*\\.(tsx?|jsx?)$", "src/app/api")}


def _path_hit(d: str) -> str:
    out = []
    for p in dp.PATHS[d]:
        if "(?!" in p:
            head, _, tail = p.partition("(?!")
            without, _, rest = tail.partition(")")
            out.append(f"(regexp_matches(path, {sql_string('(?i)^(?:' + head + rest + ')')}) AND NOT regexp_matches(path, {sql_string('(?i)^(?:' + head + '(?:' + without + '))')}))")
        else:
            out.append(f"regexp_matches(path, {sql_string('(?i)^(?:' + p + ')')})")
    return "(" + " OR ".join(out) + ")"


def signals(files: str = FILES) -> str:
    raw = ", ".join(f"CASE WHEN {_path_hit(d)} THEN {classify.PATH_WEIGHT[d]} ELSE 0 END AS r_{d}" for d in classify.DOMAINS)
    most = "greatest(" + ", ".join(f"r_{d}" for d in classify.DOMAINS) + ")"
    parts = []
    for n, d in enumerate(classify.DOMAINS):
        i = "0.0"
        if d in dp.IMPORTS:
            hits = " + ".join(f"CAST(regexp_matches(content, {sql_string('(?im)' + p)}) AS INT)" for p in dp.IMPORTS[d])
            i = f"least(1.0, ({hits}) / CAST({len(dp.IMPORTS[d])} AS DOUBLE) * {classify.IMPORT_WEIGHT[d]})"
        c = "0.0"
        if d in dp.CONTENT:
            hits = " + ".join(f"least(5, len(regexp_extract_all(content, {sql_string('(?im)' + p)})))" for p in dp.CONTENT[d])
            c = f"least(1.0, ({hits}) / CAST({3 * len(dp.CONTENT[d])} AS DOUBLE) * {classify.CONTENT_WEIGHT[d]})"
        parts.append(f"SELECT file_id, '{d}' AS domain, {n} AS ord, CASE WHEN {most} > 0 THEN CAST(r_{d} AS DOUBLE) / {most} ELSE 0 END AS p, CAST({i} AS DOUBLE) AS i, CAST({c} AS DOUBLE) AS c FROM hit")
    return f"{files}, hit AS (SELECT file_id, path, content, {raw} FROM files), sig AS (SELECT *, 0.4 * p + 0.3 * i + 0.3 * c AS combined FROM ({' UNION ALL '.join(parts)}))"


PATTERN_FILES = (
    "files AS (SELECT ref_id AS file_id, coalesce(file_path, '') AS path, regexp_extract(coalesce(file_path, ''), '([^/\\\\]*)$', 1) AS name, coalesce(snippet, '') AS content "
    "FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY ref_ord DESC) AS _n FROM pattern_index WHERE ref_id IS NOT NULL) WHERE _n = 1)"
)
CLASSIFY = (
    ", ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY combined DESC, ord) AS place, coalesce(lead(combined) OVER (PARTITION BY file_id ORDER BY combined DESC, ord), 0) AS second FROM sig)"
    ", won AS (SELECT *, greatest(p, i, c) AS most, CAST(p > 0.1 AS INT) + CAST(i > 0.1 AS INT) + CAST(c > 0.1 AS INT) AS n1, CAST(p >= 0.15 AS INT) + CAST(i >= 0.15 AS INT) + CAST(c >= 0.15 AS INT) AS n15, CAST(p >= 0.2 AS INT) + CAST(i >= 0.2 AS INT) + CAST(c >= 0.2 AS INT) AS n2 FROM ranked WHERE place = 1)"
    ", boosted AS (SELECT file_id, domain, CASE WHEN NOT ((domain = 'testing' AND combined >= 0.35) OR (combined >= 0.3 AND combined - second >= 0.05)) THEN combined WHEN most >= 0.8 AND n15 = 1 THEN least(1.0, combined * 2.2) WHEN n1 >= 2 AND most >= 0.7 THEN least(1.0, combined * CASE WHEN n2 >= 2 THEN 1.8 ELSE 1.5 END) WHEN most >= 0.7 AND n1 = 1 THEN least(1.0, combined * 1.4) ELSE combined END AS b FROM won)"
    ", classified AS (SELECT file_id, CASE WHEN b < 0.3 THEN 'unknown' ELSE domain END AS domain, CASE WHEN b < 0.3 THEN greatest(0.5, b) ELSE b END AS confidence FROM boosted)"
)
ENGINES = scan.ANALYZERS


def _six(x: str) -> str:
    """To six places by way of a decimal, so that both engines see the same tie."""
    return f"CAST(round(CAST({x} AS DECIMAL(18, 9)), 6) AS DOUBLE)"


def _sub(name: str, sql: str) -> str:
    return f"{name} AS ({sql})"


ALL_SCORES = "all_scores AS (" + " UNION ALL ".join(f"SELECT * FROM ({scores(a)})" for a in ENGINES) + ")"
ALL_RECS = "all_recs AS (" + " UNION ALL ".join(f"SELECT * FROM ({recommendations(a)})" for a in ENGINES) + ")"
FEEDBACK = ALL_RECS + (
    ", ea AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS rank, unnest(range(1, CAST(least(times, 10) AS BIGINT) + 1)) AS nth FROM all_recs), "
    "fb AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rank, category, seq, nth) AS place FROM ea QUALIFY place <= 10)"
)
WEIGHTED = NEIGHBOURS + ", dims AS (SELECT query_id, CAST(rank AS VARCHAR) AS dimension, similarity AS score, 1.0 / rank AS weight FROM near)"
SCORED = NEIGHBOURS + ", s AS (SELECT ref_file AS file_id, domain, max(similarity) AS score FROM near GROUP BY ALL)"
NEGATIVE = (
    "nr AS (SELECT ref_id AS id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('11|' || ref_id), ref_id) - 1 AS pos, count(*) OVER (PARTITION BY domain) AS m FROM usable), nm AS (SELECT domain, dense_rank() OVER (ORDER BY domain) - 1 AS d, count(*) OVER () AS nd FROM (SELECT DISTINCT domain FROM nr)), "
    "nx AS (SELECT a.domain, b.domain AS other_domain FROM nm a JOIN nm b ON b.d = (a.d + 1) % a.nd WHERE a.domain <> b.domain), neg AS (SELECT a.id AS anchor_id, b.id AS other_id, a.domain, b.domain AS other_domain FROM nr a JOIN nx USING (domain) JOIN nr b ON b.domain = nx.other_domain AND b.pos = a.pos % b.m)"
)


def _chance(seed: int, n: int, *keys: str) -> str:
    return f"(('0x' || substring(md5('{seed}.{n}|' || {" || '|' || ".join(keys)}), 1, 8))::BIGINT / 4294967296.0)"


def corrupted(code: str, key: str) -> str:
    word = "'\\b[a-z]+[A-Z][a-zA-Z]*\\b'"
    snake = f"array_to_string([x[1] || coalesce(x[2], '') FOR x IN list_zip(regexp_split_to_array({code}, {word}), [lower(regexp_replace(y, '([a-z])([A-Z])', '\\1_\\2', 'g')) FOR y IN regexp_extract_all({code}, {word})])], '')"
    c = f"CASE WHEN {_chance(5, 1, key)} < 0.3 THEN {snake} ELSE {code} END"
    c = f"CASE WHEN {_chance(5, 2, key)} < 0.3 THEN (CASE WHEN contains({c}, ';') THEN replace({c}, ';', '') ELSE replace({c}, chr(10), ';' || chr(10)) END) ELSE {c} END"
    c = f"CASE WHEN {_chance(5, 3, key)} < 0.3 THEN regexp_replace({c}, '\\bconst\\b', 'var', 'g') ELSE {c} END"
    return f"CASE WHEN {_chance(5, 4, key)} < 0.3 THEN replace({c}, chr(34), chr(39)) ELSE {c} END"


COMMITS = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at DESC) AS _n FROM commits) WHERE _n = 1)"


def oracle_sql() -> dict[str, str]:
    out = {f"patterns_{a}": patterns(a) for a in scan.ANALYZERS}
    out |= {f"recommendations_{a}": recommendations(a) for a in scan.ANALYZERS}
    out |= {f"scores_{a}": scores(a) for a in ENGINES}
    ext = "regexp_extract(name, '^.+(\\.[^.]+)$', 1)"
    out |= {
        "file_suffixes": f"WITH {FILES} SELECT {ext} AS suffix, count(*) AS n, sum(length(content)) AS chars FROM files GROUP BY ALL",
        "file_filters": f"WITH {FILES} SELECT file_id, regexp_matches(path, '__pycache__|\\.git|node_modules|\\.venv|dist|build|\\.next') AS excluded, regexp_matches(lower(path), 'test_|_test\\.|\\.test\\.|spec_|_spec\\.|\\.spec\\.') AS is_test, regexp_matches(path, '\\.generated\\.|_generated\\.|\\.d\\.ts') AS is_generated FROM files",
        "file_scopes": f"WITH {FILES}, x AS (SELECT file_id, regexp_extract(path, '[^/\\\\](\\.[^./\\\\]+)$', 1) AS s FROM files) SELECT file_id, s IN ('.ts', '.tsx', '.js', '.jsx') AS default_scope, s IN ('.ts', '.tsx') AS typescript_scope, s IN ('.ts', '.tsx', '.js', '.jsx', '.py', '.sql', '.md', '.mdx', '.json', '.yml', '.yaml', '.css', '.scss', '.less') AS adherence_scope, s IN ('.ts', '.tsx', '.js', '.jsx', '.py', '.sql', '.md', '.mdx', '.json', '.yml', '.yaml', '.css', '.scss', '.less', '.html', '.htm', '.tf', '.dockerfile', '.sh', '.env', '.txt') AS classifier_scope, lower(s) IN ('.ts', '.tsx', '.js', '.jsx', '.py', '.java', '.cpp', '.c', '.h', '.go', '.rs', '.rb', '.php', '.cs', '.sql') AS training_scope FROM x",
        "path_kinds": f"WITH {FILES} SELECT file_id, {rules.COMPONENT} AS component, {rules.APP} AS app_router, {rules.API} AS api_route, {rules.PAGE} AS page, {rules.LAYOUT} AS layout FROM files",
        "import_lines": f"WITH {FILES}, {IMPORT_LINES} SELECT * FROM im",
    }
    grouping = f"WITH {FILES}, {IMPORT_LINES}, {GROUPED} SELECT file_id, imports, absolute, deep_relative, grouped, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN absolute > 0 THEN 0.2 ELSE 0 END + CASE WHEN grouped THEN 0.2 ELSE 0 END - CASE WHEN deep_relative > 0 THEN 0.1 ELSE 0 END)), 6) AS organisation FROM gg"
    out["import_grouping"] = grouping
    out["import_organisation"] = f"SELECT file_id, coalesce(organisation, 1.0) AS organisation FROM (WITH {FILES} SELECT file_id FROM files) LEFT JOIN ({grouping}) USING (file_id)"
    out["scores_architectural"] = architectural_by_hand()
    out["complexity"] = f"WITH {FILES}, {NESTING}, {LENGTHS} SELECT file_id, lines, nesting, CAST(functions AS BIGINT) AS functions, round(mean_length, 6) AS mean_length, penalty FROM penal"
    names = {"imports": "import_count", "interfaces": "interfaces_defined", "aliases": "type_aliases_defined", "any_usage": "any_usage_count", "return_types": "function_return_types", "react_hooks": "hooks_count"}
    asked = [f"c_{n} " for n in (*names, "generic_components", "generic_interfaces", "function_component")]
    out["file_metrics"] = f"WITH {counted('quality', asked)} SELECT file_id, {', '.join(f'c_{n} AS {a}' for n, a in names.items())}, CAST(len(string_split(content, chr(10))) AS BIGINT) AS file_size_lines, c_generic_components + c_generic_interfaces AS generic_usage_count, c_function_component > 0 AS function_component, {rules.API} AS api_route, {rules.PAGE} AS page_component, {rules.LAYOUT} AS layout_component FROM counted"
    out["lines_and_nesting"] = f"WITH {FILES}, {NESTING} SELECT * FROM nest"
    p = sql_string(rules.COUNTS["type_guards"].patterns[0])
    out["match_details"] = f"""WITH {FILES}, m AS (SELECT file_id, content, regexp_extract_all(content, {p}) AS m, regexp_split_to_array(content, {p}) AS b FROM files WHERE regexp_matches(content, {p})),
        r AS (SELECT file_id, content, m, b, unnest(range(1, len(m) + 1)) AS i FROM m),
        o AS (SELECT file_id, i, m[i] AS matched_text, content, CAST(list_sum([length(x) FOR x IN b[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS char_offset FROM r)
        SELECT file_id, i AS nth, char_offset, CAST(length(substring(content, 1, char_offset)) - length(replace(substring(content, 1, char_offset), chr(10), '')) + 1 AS BIGINT) AS line_number, matched_text FROM o"""
    out["domain_signals"] = f"WITH {signals()} SELECT file_id, domain, round(p, 6) AS path_score, round(i, 6) AS import_score, round(c, 6) AS content_score, round(combined, 6) AS combined FROM sig WHERE combined > 0"
    out["training_scan"] = f"WITH {signals()}{CLASSIFY} SELECT file_id, domain, CAST(least(512, len(regexp_extract_all(content, '\\w+|[^\\w\\s]'))) AS BIGINT) AS tokens FROM files JOIN classified USING (file_id) WHERE NOT regexp_matches(path, '__pycache__|\\.git|node_modules|\\.venv|dist|build|\\.next|coverage|\\.pytest_cache') AND NOT regexp_matches(lower(path), 'test_|_test\\.|\\.test\\.|spec_|_spec\\.|\\.spec\\.') AND NOT regexp_matches(path, '\\.generated\\.|_generated\\.|\\.d\\.ts') AND regexp_matches(lower(path), '[^/\\\\]\\.(ts|tsx|js|jsx|py|java|cpp|c|h|go|rs|rb|php|cs|sql)$') AND regexp_matches(content, '\\S')"
    out["domain_classification"] = f"WITH {signals()}{CLASSIFY} SELECT file_id, domain, round(confidence, 6) AS confidence FROM classified"
    out["domain_secondaries"] = f"WITH {signals()}{CLASSIFY} SELECT s.file_id, s.domain, round(s.combined, 6) AS score FROM ranked s JOIN classified c ON s.file_id = c.file_id WHERE s.combined > 0.1 AND s.domain <> c.domain QUALIFY row_number() OVER (PARTITION BY s.file_id ORDER BY s.combined DESC, s.ord) <= 3"
    out["index_members"] = f"WITH {signals()}{CLASSIFY}, k AS (SELECT file_id, domain, row_number() OVER (PARTITION BY domain ORDER BY file_id) AS n, count(*) OVER (PARTITION BY domain) AS size FROM classified WHERE domain <> 'unknown') SELECT file_id, domain FROM k WHERE size >= 3 AND n <= 1000"
    out |= {
        "vector_norms": f"WITH {INDEX} SELECT ref_id, domain, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM usable",
        "knn_top5": f"WITH {KNN} SELECT query_id, domain, rank, ref_id, round(similarity, 6) AS similarity FROM knn",
        "adaptive_scores": f"WITH {ADAPTIVE} SELECT query_id, domain, round(score, 6) AS score, hits FROM scored",
        "file_adherence": f"WITH {ADAPTIVE} SELECT file_path, round(coalesce(avg(score), 0), 6) AS score, count(*) AS functions, count(score) AS scored FROM usable LEFT JOIN scored ON ref_id = query_id WHERE ref_id % 50 = 0 GROUP BY file_path",
        "adherence_by_domain": f"WITH {ADAPTIVE} SELECT domain, count(*) AS queries, round(avg(score), 6) AS mean_adherence, sum(hits) AS neighbours FROM scored GROUP BY domain",
        "adherence_confidence": f"WITH {ADAPTIVE} SELECT query_id, round((0.5 + least(1.0, hits / 5.0) + best) / 3, 6) AS confidence FROM scored",
        "adherence_metrics": f"WITH {PATTERN_FILES}, {signals('').lstrip(', ')}{CLASSIFY}, {ADAPTIVE} SELECT query_id, s.domain, round(score, 6) AS overall_adherence, round(confidence * 0.5 + score * 0.5, 6) AS domain_adherence, round((confidence + least(1.0, hits / 5.0) + best) / 3, 6) AS confidence, hits, round(confidence, 6) AS domain_match_quality FROM scored s JOIN classified ON file_id = query_id",
        "adherence_recommendations": f"WITH {PATTERN_FILES}, {signals('').lstrip(', ')}{CLASSIFY}, {ADAPTIVE}, q AS (SELECT ref_id AS query_id, coalesce(score, 0) AS score, coalesce(hits, 0) AS hits, confidence FROM usable JOIN classified ON file_id = ref_id LEFT JOIN scored ON query_id = ref_id WHERE ref_id % 50 = 0) SELECT query_id, rule_id, severity FROM (SELECT query_id, 'LOW_DOMAIN_ADHERENCE' AS rule_id, CASE WHEN score < 0.25 THEN 'error' ELSE 'warning' END AS severity FROM q WHERE score < 0.4 UNION ALL SELECT query_id, 'UNCLEAR_DOMAIN_ENHANCED', CASE WHEN confidence < 0.3 THEN 'error' WHEN confidence < 0.5 THEN 'warning' ELSE 'info' END FROM q WHERE confidence < 0.6 UNION ALL SELECT query_id, 'NO_SIMILAR_PATTERNS', 'info' FROM q WHERE hits = 0)",
        "adherence_patterns": f"WITH {PATTERN_FILES}, {signals('').lstrip(', ')}{CLASSIFY}, {ADAPTIVE} SELECT query_id, 'domain_adherence_' || c.domain AS pattern_name, round((confidence + least(1.0, hits / 5.0) + best) / 3, 6) AS confidence FROM scored s JOIN classified c ON file_id = query_id UNION ALL SELECT query_id, 'similar_pattern_' || rank, round(similarity, 6) FROM knn WHERE rank <= 3",
        "divergence_summary": f"WITH {KNN}, u AS (SELECT ref_id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS w, v FROM usable), m AS (SELECT query_id, dim, avg(w[dim]) AS mean FROM knn JOIN u USING (ref_id), range(1, 65) t(dim) GROUP BY ALL), z AS (SELECT query_id, avg(abs(v[dim] - mean)) AS mean_difference, sum(v[dim] * mean) AS dp, sqrt(sum(v[dim] * v[dim])) AS a, sqrt(sum(mean * mean)) AS b FROM m JOIN u ON query_id = u.ref_id GROUP BY query_id) SELECT ref_id AS query_id, round(coalesce(mean_difference, 1.0), 6) AS mean_difference, round(coalesce(dp / (a * b + 1e-9), 0.0), 6) AS cosine FROM usable LEFT JOIN z ON query_id = ref_id WHERE ref_id % 50 = 0",
        "embedding_payload": f"WITH {KNN} SELECT query_id, count(*) AS refs, round(sum(list_dot_product(q.v, [x / sqrt(list_dot_product(r.v, r.v)) FOR x IN r.v])), 4) AS checksum FROM knn JOIN usable q ON q.ref_id = query_id JOIN usable r ON r.ref_id = knn.ref_id GROUP BY query_id",
        "classifier_recommendations": f"WITH {signals()}{CLASSIFY}, sc AS (SELECT s.file_id, least(3, count(*) FILTER (s.combined > 0.1 AND s.domain <> c.domain)) AS n FROM ranked s JOIN classified c USING (file_id) GROUP BY 1) SELECT file_id, rule_id, severity FROM (SELECT file_id, 'LOW_DOMAIN_CONFIDENCE' AS rule_id, 'info' AS severity FROM classified WHERE confidence < 0.6 UNION ALL SELECT file_id, 'UNKNOWN_DOMAIN', 'warning' FROM classified WHERE domain = 'unknown' UNION ALL SELECT file_id, 'MIXED_DOMAIN_CONCERNS', 'info' FROM sc WHERE n > 2)",
        "divergence_top20": f"WITH {KNN}, u AS (SELECT ref_id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS w, v FROM usable), m AS (SELECT query_id, dim, avg(w[dim]) AS mean FROM knn JOIN u USING (ref_id), range(1, 65) t(dim) GROUP BY ALL) SELECT query_id, CAST(dim - 1 AS BIGINT) AS dim, round(abs(v[dim] - mean), 6) AS diff FROM m JOIN u ON query_id = u.ref_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(abs(v[dim] - mean), 9) DESC, dim) <= 20",
        "index_stats": f"WITH {INDEX} SELECT domain, count(*) AS vectors, count(DISTINCT file_path) AS files, count(DISTINCT commit_id) AS commits FROM usable GROUP BY domain",
        "compatible_match": f"WITH {NEIGHBOURS}, own AS (SELECT CAST(ref_id AS VARCHAR) AS query_id, max_by(file_path, ref_ord) AS query_file FROM pattern_index WHERE ref_id IS NOT NULL GROUP BY 1), s AS (SELECT near.*, regexp_extract(query_file, '[^/\\\\](\\.[^./\\\\]+)$', 1) AS a, regexp_extract(ref_file, '[^/\\\\](\\.[^./\\\\]+)$', 1) AS b FROM near JOIN own USING (query_id)) SELECT query_id, max_by(ref_file, (similarity, ref_file)) AS ref_file, round(max(similarity), 6) AS similarity FROM s WHERE a = b OR (a IN ('.ts', '.tsx', '.js', '.jsx', '.py') AND b IN ('.ts', '.tsx', '.js', '.jsx', '.py')) GROUP BY query_id",
        "best_compatible": f"WITH {NEIGHBOURS} SELECT query_id, max_by(ref_file, (similarity, ref_file)) AS ref_file, round(max(similarity), 6) AS similarity FROM near WHERE regexp_matches(ref_file, '\\.(ts|tsx|js|jsx)$') GROUP BY query_id",
        "neighbour_log": f"WITH {NEIGHBOURS} SELECT query_id, CAST(rank AS BIGINT) AS rank, ref_id, domain, round(similarity, 6) AS similarity FROM near",
        "weighted_means": f"WITH {WEIGHTED}, t AS (SELECT *, weight / sum(weight) OVER (PARTITION BY query_id) AS w FROM dims) SELECT query_id, round(sum(score * w), 6) AS weighted_average, round(1 / sum(w / greatest(score, 1e-8)), 6) AS weighted_harmonic_mean, round(exp(sum(w * ln(greatest(score, 1e-8)))), 6) AS weighted_geometric_mean FROM t GROUP BY query_id",
        "score_confidence": f"WITH {WEIGHTED}, t AS (SELECT *, weight / sum(weight) OVER (PARTITION BY query_id) AS w FROM dims) SELECT query_id, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0.0, least(1.0, 0.4 / (1 + var_pop(score)) + 0.3 * -sum(w * ln(w + 1e-8)) / ln(count(*)) + 0.3 * avg(score))) END, 6) AS confidence FROM t GROUP BY query_id",
        "score_statistics": f"WITH {WEIGHTED} SELECT query_id, count(*) AS n, {_six('avg(score)')} AS mean, {_six('median(score)')} AS median, {_six('stddev_pop(score)')} AS std, {_six('min(score)')} AS low, {_six('max(score)')} AS high, {_six('max(score) - min(score)')} AS range FROM dims GROUP BY query_id",
        "importance": f"WITH {WEIGHTED} SELECT query_id, dimension, round(coalesce(abs(score * weight) / nullif(sum(abs(score * weight)) OVER (PARTITION BY query_id), 0), 0), 6) AS importance FROM dims",
        "score_bands": f"WITH {SCORED} SELECT CASE WHEN score >= 0.9 THEN 'Excellent' WHEN score >= 0.8 THEN 'Very Good' WHEN score >= 0.7 THEN 'Good' WHEN score >= 0.6 THEN 'Fair' WHEN score >= 0.5 THEN 'Needs Improvement' ELSE 'Poor' END AS band, count(*) AS n FROM s GROUP BY 1",
        "domain_breakdown": f"WITH {SCORED} SELECT domain, count(*) AS n, count(DISTINCT file_id) AS files, round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high FROM s GROUP BY domain",
        "top_files": f"WITH {SCORED} SELECT domain, file_id, round(score, 6) AS score, row_number() OVER (PARTITION BY domain ORDER BY score DESC, file_id) AS place FROM s QUALIFY place <= 20",
        "batch_summary": f"WITH {SCORED} SELECT round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high, min_by(file_id, (score, file_id)) AS lowest, min_by(file_id, (-score, file_id)) AS highest, count(*) AS n FROM s",
        "quality_gate": f"WITH {SCORED} SELECT domain, count(*) AS n, count(*) FILTER (score >= 0.7) AS passed FROM s GROUP BY domain",
        "dimension_means": f"WITH {signals()}{CLASSIFY}, {ALL_SCORES} SELECT analyzer, round(coalesce(avg(score) FILTER (domain <> 'unknown'), avg(score)), 6) AS score, count(*) AS files FROM all_scores JOIN classified USING (file_id) GROUP BY analyzer",
        "code_focused": f"WITH {signals()}{CLASSIFY}, {ALL_SCORES}, j AS (SELECT analyzer, score, domain, CASE domain WHEN 'backend' THEN 1.0 WHEN 'frontend' THEN 1.0 WHEN 'testing' THEN 0.9 WHEN 'database' THEN 0.8 WHEN 'infrastructure' THEN 0.7 WHEN 'unknown' THEN 0.5 WHEN 'configuration' THEN 0.3 ELSE 0.2 END AS w FROM all_scores JOIN classified USING (file_id)) SELECT analyzer, round(coalesce(sum(score * w) FILTER (domain <> 'unknown') / sum(w) FILTER (domain <> 'unknown'), sum(score * w) / sum(w)), 6) AS code_focused_score FROM j GROUP BY analyzer",
        "code_focused_overall": f"WITH {signals()}{CLASSIFY}, {ALL_SCORES}, j AS (SELECT analyzer, score, domain, CASE domain WHEN 'backend' THEN 1.0 WHEN 'frontend' THEN 1.0 WHEN 'testing' THEN 0.9 WHEN 'database' THEN 0.8 WHEN 'infrastructure' THEN 0.7 WHEN 'unknown' THEN 0.5 WHEN 'configuration' THEN 0.3 ELSE 0.2 END AS w FROM all_scores JOIN classified USING (file_id)) SELECT round(coalesce(sum(score * w) FILTER (domain <> 'unknown') / sum(w) FILTER (domain <> 'unknown'), sum(score * w) / sum(w), 0), 6) AS code_focused_score FROM j",
        "patterns_by_type": "WITH a AS (" + " UNION ALL ".join(f"SELECT * FROM ({patterns(a)})" for a in scan.ANALYZERS) + ") SELECT pattern_type, CAST(sum(matches) AS BIGINT) AS matches, count(*) AS files, round(sum(confidence * matches) / sum(matches), 6) AS mean_confidence FROM a GROUP BY pattern_type",
        "file_level_pivot": f"WITH {ALL_SCORES} SELECT file_id, max(score) FILTER (analyzer = 'architectural') AS architectural, max(score) FILTER (analyzer = 'quality') AS quality, max(score) FILTER (analyzer = 'typescript') AS typescript, max(score) FILTER (analyzer = 'framework') AS framework FROM all_scores GROUP BY file_id",
        "feedback": f"WITH {FEEDBACK} SELECT file_id, analyzer, rule_id, severity, category, place FROM fb WHERE place <= 3",
        "feedback_full": f"WITH {FEEDBACK} SELECT file_id, analyzer, rule_id, severity, category, place FROM fb",
        "top_issues": f"WITH {signals()}{CLASSIFY}, {FEEDBACK}, k AS (SELECT fb.*, domain, list_position(['backend', 'frontend', 'testing', 'database'], domain) AS o FROM fb JOIN classified USING (file_id) WHERE severity IN ('error', 'warning') AND domain IN ('backend', 'frontend', 'testing', 'database')), n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY rank, category, file_id, place) AS n, dense_rank() OVER (ORDER BY o) AS d FROM k) SELECT domain, n, file_id, analyzer, rule_id, severity, category FROM n WHERE n <= 2 AND d <= 3",
        "file_roll_up": f"WITH {ALL_SCORES}, {ALL_RECS}, pm AS (" + " UNION ALL ".join(f"SELECT * FROM ({patterns(a)})" for a in ENGINES) + "), s AS (SELECT file_id, count(*) AS engines, round(sum(score), 5) AS total FROM all_scores GROUP BY 1), p AS (SELECT file_id, CAST(sum(matches) AS BIGINT) AS patterns_count FROM pm GROUP BY 1), r AS (SELECT file_id, CAST(sum(times) AS BIGINT) AS recommendations_count FROM all_recs GROUP BY 1) SELECT file_id, engines, total, coalesce(patterns_count, 0) AS patterns_count, coalesce(recommendations_count, 0) AS recommendations_count FROM s LEFT JOIN p USING (file_id) LEFT JOIN r USING (file_id)",
        "compare_repos": f"WITH {ALL_SCORES}, {FILES}, m AS (SELECT repo, analyzer, avg(score) AS score FROM all_scores JOIN files USING (file_id) GROUP BY ALL), b AS (SELECT analyzer, score AS base_score FROM m WHERE repo = (SELECT min(repo) FROM m)) SELECT repo, analyzer, round(score - base_score, 6) AS difference, round((score - base_score) * 100 / base_score, 6) AS per_cent FROM m JOIN b USING (analyzer) WHERE repo <> (SELECT min(repo) FROM m)",
        "commit_metadata": f"WITH {COMMITS} SELECT commit_id, repo, author, coalesce(message, '') AS message, CAST(len(parent_ids) AS BIGINT) AS parents, CAST(coalesce(insertions, 0) AS BIGINT) AS insertions, CAST(coalesce(deletions, 0) AS BIGINT) AS deletions FROM one",
        "parent_commits": f"WITH {COMMITS} SELECT c.commit_id, c.repo, c.parent_ids[1] AS parent_id, coalesce(p.commit_id, c.commit_id) AS indexed_commit FROM one c LEFT JOIN one p ON c.parent_ids[1] = p.commit_id",
        "commit_lateness": f"WITH {COMMITS} SELECT repo, count(*) AS commits, count(*) FILTER (epoch(ingested_at)::BIGINT - epoch(committed_at)::BIGINT > 172800) AS late, CAST(max(floor(epoch(ingested_at)) - floor(epoch(committed_at))) AS BIGINT) AS longest FROM one GROUP BY repo",
        "changed_lines": f"WITH {FILES} SELECT file_id, array_to_string([substring(x, 2) FOR x IN string_split(content, chr(10)) IF starts_with(x, '+') AND NOT starts_with(x, '+++')], chr(10)) AS added FROM files WHERE contains(content, chr(10) || '+') OR starts_with(content, '+')",
        "training_samples": f"WITH {FILES} SELECT file_id, CAST(length(content) AS BIGINT) AS chars FROM files WHERE length(content) >= 50 AND trim(content, ' ') <> ''",
        "positive_pairs": f"WITH {INDEX}, r AS (SELECT ref_id AS id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('7|' || ref_id), ref_id) - 1 AS pos, count(*) OVER (PARTITION BY domain) AS n FROM usable) SELECT a.id AS anchor_id, b.id AS other_id, a.domain, step FROM r a, range(1, 4) t(step) JOIN r b ON a.domain = b.domain AND b.pos = (a.pos + step) % a.n WHERE step <= a.n - 1",
        "negative_pairs": f"WITH {INDEX}, {NEGATIVE} SELECT anchor_id, other_id, domain, other_domain FROM neg",
        "negative_mix": f"WITH {INDEX}, {NEGATIVE}, x AS (SELECT u.ref_id AS id, coalesce(o.snippet, '') AS content FROM usable u JOIN (SELECT ref_id, max_by(snippet, ref_ord) AS snippet FROM pattern_index GROUP BY 1) o USING (ref_id)), c AS (SELECT *, {_chance(13, 9, 'id')} < 0.3 AND length(content) >= 50 AS styled FROM x) SELECT anchor_id, other_id, 'cross_domain_' || domain || '_vs_' || other_domain AS pair_type, CAST(NULL AS VARCHAR) AS digest FROM neg JOIN c ON c.id = anchor_id WHERE NOT styled UNION ALL SELECT id, id, 'synthetic_corruption', md5({corrupted('content', 'id')}) FROM c WHERE styled",
        "training_triplets": f"WITH {INDEX}, {NEGATIVE}, r AS (SELECT ref_id AS id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('7|' || ref_id), ref_id) - 1 AS pos, count(*) OVER (PARTITION BY domain) AS n FROM usable), pp AS (SELECT a.id AS anchor_id, b.id AS positive_id, step FROM r a, range(1, 4) t(step) JOIN r b ON a.domain = b.domain AND b.pos = (a.pos + step) % a.n WHERE step <= a.n - 1), pool AS (SELECT other_id, row_number() OVER (ORDER BY md5('17|' || anchor_id), anchor_id, other_id) - 1 AS pos, count(*) OVER () AS n FROM neg) SELECT anchor_id, positive_id, other_id AS negative_id, step FROM pp JOIN pool ON pool.pos = ('0x' || substring(md5('17|' || anchor_id || '|' || positive_id), 1, 8))::BIGINT % pool.n",
        "masked_tokens": f"WITH p AS (SELECT pair_id, max_by(anchor, (ingested_at, anchor)) AS anchor FROM pairs WHERE anchor IS NOT NULL GROUP BY pair_id), w AS (SELECT pair_id, list_transform(regexp_extract_all(anchor, '[A-Za-z0-9_]+'), lambda x: ('0x' || substring(md5(x), 1, 6))::BIGINT % 30000) AS t FROM p), e AS (SELECT pair_id, unnest(range(0, len(t))) AS i, unnest(t) AS x FROM w), m AS (SELECT pair_id, x, {_chance(19, 1, 'pair_id', 'i')} < 0.15 AND x <> 0 AS chosen, CASE WHEN {_chance(19, 2, 'pair_id', 'i')} < 0.8 THEN 103 WHEN {_chance(19, 3, 'pair_id', 'i')} < 0.5 THEN ('0x' || substring(md5('19.4|' || pair_id || '|' || i), 1, 8))::BIGINT % 30000 ELSE x END AS other FROM e) SELECT pair_id, count(*) AS tokens, count(*) FILTER (chosen) AS chosen, CAST(sum(CASE WHEN chosen THEN other ELSE x END) AS BIGINT) AS input_sum, CAST(sum(CASE WHEN chosen THEN x ELSE -100 END) AS BIGINT) AS label_sum FROM m GROUP BY pair_id",
        "corrupted_code": f"WITH {FILES} SELECT file_id, md5({corrupted('content', 'file_id')}) AS digest FROM files WHERE content <> ''",
        "triplet_split": "SELECT CASE WHEN ('0x' || substring(md5('3|' || pair_id), 1, 8))::BIGINT / 4294967296.0 < 0.1 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM (SELECT DISTINCT pair_id FROM pairs) GROUP BY 1",
        "infonce_loss": f"WITH {NEIGHBOURS}, t AS (SELECT query_id, max(similarity) AS p, min(similarity) AS n FROM near GROUP BY query_id HAVING count(*) > 1) SELECT round(avg(greatest(p, n) / 0.07 + ln(exp((p - greatest(p, n)) / 0.07) + exp((n - greatest(p, n)) / 0.07)) - p / 0.07), 6) AS loss, count(*) AS n FROM t",
        "token_budget": f"WITH {FILES}, x AS (SELECT file_id, CAST(len(regexp_extract_all(content, '\\w+|[^\\w\\s]')) AS BIGINT) AS tokens FROM files) SELECT file_id, tokens FROM x WHERE tokens <= 2048",
        "data_share": f"WITH {FILES} SELECT file_id, round(coalesce(coalesce(list_sum([strlen(x) FOR x IN regexp_extract_all(content, '\"(?:[^\"\\\\\\n]|\\\\.)*\"|''(?:[^''\\\\\\n]|\\\\.)*''|`(?:[^`\\\\]|\\\\.)*`')]), 0) / nullif(strlen(content), 0), 0), 6) AS share FROM files",
        "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' > ts THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, sid",
    }
    return out
