"""Classification, aggregation, similarity, history, training and reports on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from adherix.functions.records import latest
from adherix.operators import aggregate, classify, functions, history, report, scan, similarity, training
from adherix.streaming import windows


@pytest.mark.parametrize(
    "path, domain, confidence",
    [
        ("src/components/Button.tsx", "frontend", 0.88), ("src/app/api/users/route.ts", "backend", 0.88), ("migrations/001_create_users.sql", "database", 0.88),
        ("tests/test_user.py", "testing", 0.88), ("src/components/Button.test.tsx", "testing", 0.88), ("package.json", "configuration", 0.88), ("src/lib/database.ts", "backend", 0.88),
    ],
)
def test_paths_decide_where_content_is_empty(spark, path, domain, confidence):
    f = scan.as_files(spark.createDataFrame([(1, path, "")], "i long, p string, c string"), "i", "p", "c")
    r = classify.classify(f).first()
    assert (r["domain"], round(r["confidence"], 6)) == (domain, confidence)


def test_unknown_domain(spark):
    f = scan.as_files(spark.createDataFrame([(1, "src/utils.js", None)], "i long, p string, c string"), "i", "p", "c")
    r = classify.classify(f).first()
    assert (r["domain"], r["confidence"]) == ("unknown", 0.5)


def test_weighted_means(spark):
    df = spark.createDataFrame([("c", d, s, 0.2) for d, s in zip("abcde", (0.8, 0.7, 0.9, 0.6, 0.75))], "k string, dimension string, score double, weight double")
    r = aggregate.aggregate(df, ["k"]).first()
    assert round(r["weighted_average"], 6) == 0.75
    assert round(r["weighted_harmonic_mean"], 6) == 0.736411
    assert round(r["weighted_geometric_mean"], 6) == 0.743239
    assert round(r["confidence"], 6) == 0.921040
    assert round(r["std"], 6) == 0.1


def test_weights_of_zero_are_equal(spark):
    df = spark.createDataFrame([("c", "a", 0.2, 0.0), ("c", "b", 0.6, 0.0), ("c", "n", None, 0.0)], "k string, dimension string, score double, weight double")
    assert aggregate.aggregate(df, ["k"]).first()["weighted_average"] == pytest.approx(0.4)


def test_code_focused_ignores_unknown_where_some_are_known(spark):
    df = spark.createDataFrame([("x", "backend", 0.8), ("x", "unknown", 0.0), ("y", "unknown", 0.4)], "k string, domain string, score double")
    got = {r["k"]: r["code_focused_score"] for r in aggregate.code_focused(df, classify.DOMAIN_IMPORTANCE, ["k"]).collect()}
    assert got == {"x": pytest.approx(0.8), "y": pytest.approx(0.4)}


def test_knn_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype("float32")
    v[7] = v[3]
    df = spark.createDataFrame([(i, "ab"[i % 2], v[i].tolist()) for i in range(60)], "ref_id long, domain string, embedding array<float>")
    got = {}
    for r in similarity.knn(df.withColumnRenamed("ref_id", "query_id"), df, 3, -1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["ref_id"]
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for i in range(60):
        others = sorted((j for j in range(60) if j % 2 == i % 2 and j != i), key=lambda j: (-round(float(u[i] @ u[j]), 12), j))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == others


def test_adaptive(spark):
    df = spark.createDataFrame([(1, "d", 1, 0.9), (1, "d", 2, 0.1), (2, "d", 1, 0.6), (2, "d", 2, 0.5), (2, "d", 3, 0.4), (2, "d", 4, 0.3)], "query_id long, domain string, rank int, similarity double")
    got = {r["query_id"]: r["score"] for r in similarity.adaptive(df).collect()}
    assert got == {1: 0.9, 2: pytest.approx(0.5)}


def test_changed_lines(spark):
    df = spark.createDataFrame([("+++ b/x\n+one\n-two\n three\n+\n++four",), ("",)], "p string")
    assert [r[0] for r in df.select(history.changed_lines(F.col("p"))).collect()] == ["one\n\n+four", ""]


def test_latest_record(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, None)], "k int, t int, v string")
    assert sorted((r["k"], r["v"]) for r in latest(df, ["k"], ["t"]).collect()) == [(1, "b"), (2, None)]
    assert latest(df.limit(0), ["k"], ["t"]).count() == 0


def test_positive_pairs_are_of_one_domain(spark):
    df = spark.createDataFrame([(i, "a" if i < 9 else "b" if i < 10 else "c") for i in range(12)], "id long, domain string")
    got = training.positive_pairs(df).collect()
    per = {}
    for r in got:
        assert r["anchor_id"] != r["other_id"]
        per.setdefault(r["anchor_id"], set()).add(r["other_id"])
    assert {k: len(v) for k, v in per.items()} == {**{i: 3 for i in range(9)}, 10: 1, 11: 1}


def test_every_row_has_a_negative_of_the_next_domain(spark):
    domain = {i: "a" if i < 40 else "b" if i < 43 else "c" for i in range(44)}
    df = spark.createDataFrame(list(domain.items()), "id long, domain string")
    got = training.cross_domain_negatives(df).collect()
    assert sorted(r["anchor_id"] for r in got) == list(range(44))
    for r in got:
        assert (domain[r["anchor_id"]], domain[r["other_id"]]) == (r["domain"], r["other_domain"])
        assert r["other_domain"] == {"a": "b", "b": "c", "c": "a"}[r["domain"]]
    uses = [sum(r["other_id"] == i for r in got) for i in (40, 41, 42)]
    assert sorted(uses) == [13, 13, 14]
    assert training.cross_domain_negatives(df.where("domain = 'a'")).count() == 0


def test_infonce(spark):
    df = spark.createDataFrame([(0.9, 0.1), (0.5, 0.5)], "positive double, negative double")
    want = sum(-math.log(math.exp(p / 0.07) / (math.exp(p / 0.07) + math.exp(n / 0.07))) for p, n in ((0.9, 0.1), (0.5, 0.5))) / 2
    assert training.infonce(df).first()["loss"] == pytest.approx(want)


def test_feedback_cap(spark):
    df = spark.createDataFrame([(1, "q", f"R{i}", s, "c") for i, s in enumerate(["info", "error", "warning", "critical"])], "file_id long, analyzer string, rule_id string, severity string, category string")
    assert [r["rule_id"] for r in report.feedback(df, 3).orderBy("place").collect()] == ["R3", "R1", "R2"]


def test_functions_of_python_files(spark):
    f = scan.as_files(spark.createDataFrame([(1, "a/b.py", "class A:\n    def m(self):\n        pass\n\ndef f():\n    return 1\n"), (2, "a/c.ts", "x"), (3, "d.py", "def (")], "i long, p string, c string"), "i", "p", "c")
    got = {(r["file_id"], r["function_name"], r["is_method"], r["start_line"]) for r in functions.extract_functions(f).collect()}
    assert got == {(1, "m", True, 2), (1, "f", False, 5), (2, "file_c", False, 1), (3, "file_d", False, 1)}


def test_compression(spark):
    long = 'x = "' + "a" * 2000 + '"'
    df = spark.createDataFrame([(long,), ("y = 1",)], "c string")
    assert [r[0] for r in df.select(functions.compress(F.col("c"))).collect()] == ['x = "..."', "y = 1"]


def test_sessions(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:29:59"), (1, "2024-01-01 01:00:00")], "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert sorted(r["n"] for r in windows.sessions(df).collect()) == [1, 2]


def test_roll_ups_hold_all_four_engines(spark, tmp_path):
    from adherix.plans import registry

    rows = [
        (1, "r1", "src/app/api/users/route.ts", "export async function GET() {\n  const x = await fetch('/u');\n  return x;\n}\n"),
        (2, "r2", "src/components/Button.tsx", "export function Button() {\n  return <img src='a' onClick={() => console.log(1)} />;\n}\n"),
        (3, "r1", "src/utils.js", "foo().then(bar);\n"),
    ]
    spark.createDataFrame(rows, "chunk_id long, repo string, file_path string, function_code string").withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/function_chunks.parquet")
    q, d = registry.queries(), str(tmp_path)
    f = registry.files(spark, d)
    domain = {r["file_id"]: r["domain"] for r in classify.classify(f).collect()}
    assert [domain[i] == "unknown" for i in (1, 2, 3)] == [False, False, True]
    score = {(r["file_id"], a): round(r["score"], 6) for a in scan.ANALYZERS for r in scan.scores(f, a).collect()}
    assert {a for _, a in score} == {"architectural", "quality", "typescript", "framework"}

    pivot = {r["file_id"]: r for r in q["file_level_pivot"](spark, d).collect()}
    assert all(pivot[i][a] == score.get((i, a)) for i in (1, 2, 3) for a in scan.ANALYZERS)

    means = {r["analyzer"]: r["score"] for r in q["dimension_means"](spark, d).collect()}
    focused = {r["analyzer"]: r["code_focused_score"] for r in q["code_focused"](spark, d).collect()}
    compared = {r["analyzer"]: r["difference"] for r in q["compare_repos"](spark, d).collect()}
    for a in scan.ANALYZERS:
        known = [(score[i, a], classify.DOMAIN_IMPORTANCE[domain[i]]) for i in (1, 2) if (i, a) in score]
        assert means[a] == pytest.approx(sum(x for x, _ in known) / len(known), abs=2e-6)
        assert focused[a] == pytest.approx(sum(x * w for x, w in known) / sum(w for _, w in known), abs=2e-6)
        base = [score[i, a] for i in (1, 3) if (i, a) in score]
        assert compared[a] == pytest.approx(score[2, a] - sum(base) / len(base), abs=2e-6)

    rank = {"critical": 0, "error": 1, "warning": 2, "info": 3}
    want = {}
    for a in scan.ANALYZERS:
        for r in scan.recommendations(f, a).collect():
            want.setdefault(r["file_id"], []).append((rank[r["severity"]], r["category"], a, r["rule_id"]))
    got = {}
    for r in q["feedback"](spark, d).orderBy("place").collect():
        got.setdefault(r["file_id"], []).append((rank[r["severity"]], r["category"], r["analyzer"], r["rule_id"]))
    assert got == {k: sorted(v)[:3] for k, v in want.items()}
    assert (1, "async_error_handling", "quality", "MISSING_ASYNC_ERROR_HANDLING") in got[1]


def test_corruptions_one_by_one(spark):
    from adherix.operators import training

    code = 'const myName = "a"; call(myName, XmlHttp, get2Items);\nconst b = 1'
    df = spark.createDataFrame([(i, code) for i in range(400)] + [(1000 + i, "a\nb") for i in range(60)], "id long, c string")
    got = {r["id"]: r["x"] for r in df.select("id", training.corrupt(F.col("c"), "id").alias("x")).collect()}
    snake = code.replace("myName", "my_name")
    assert spark.createDataFrame([(code,)], "c string").select(training.snake_case(F.col("c")).alias("x")).first()["x"] == snake
    kinds = [sum("my_name" in got[i] for i in range(400)), sum(";" not in got[i] for i in range(400)), sum("var" in got[i] for i in range(400)), sum('"' not in got[i] for i in range(400))]
    assert all(80 <= n <= 160 for n in kinds)  # each with a probability of 0.3
    assert {got[1000 + i] for i in range(60)} == {"a\nb", "a;\nb"}  # none to leave out, so they are added
    assert sum(got[i] == code for i in range(400)) > 50


def test_negatives_triplets_and_masks(spark):
    from adherix.operators import training

    rows = spark.createDataFrame([(i, "abc"[i % 7 % 3], "const value = fetchAll();\n" * 4) for i in range(210)], "id long, domain string, content string")
    neg = training.negatives(rows).collect()
    domain = {i: "abc"[i % 7 % 3] for i in range(210)}
    assert sorted(r["anchor_id"] for r in neg) == list(range(210))
    styled = [r for r in neg if r["pair_type"] == "synthetic_corruption"]
    assert 40 <= len(styled) <= 85 and all(r["anchor_id"] == r["other_id"] for r in styled)
    assert all(domain[r["anchor_id"]] != domain[r["other_id"]] for r in neg if r["corrupted"] is None)
    pos = training.positive_pairs(rows.select("id", "domain"))
    tri = training.triplets(pos, training.cross_domain_negatives(rows.select("id", "domain"))).collect()
    assert len(tri) == 630 and len({r["negative_id"] for r in tri}) > 60
    tokens = spark.createDataFrame([(i, list(range(200))) for i in range(30)] + [(99, None), (98, [])], "k long, t array<long>")
    out = {r["k"]: (r["input_ids"], r["labels"]) for r in training.mask_tokens(tokens, "k", "t", 1000, 1000, (0,)).collect()}
    assert out[99] == (None, None) and out[98] == ([], [])
    chosen = [(i, x, y) for k in range(30) for i, (x, y) in enumerate(zip(*out[k])) if y != -100]
    assert all(y == i for i, _, y in chosen) and not any(i == 0 for i, _, _ in chosen)
    assert all(x == i for k in range(30) for i, (x, y) in enumerate(zip(*out[k])) if y == -100)
    assert 0.12 < len(chosen) / 5970 < 0.18 and 0.74 < sum(x == 1000 for _, x, _ in chosen) / len(chosen) < 0.86


def test_weights_are_checked():
    import pytest

    from adherix.operators import aggregate

    aggregate.check_weights({"a": 0.5, "b": 0.5}, {"a": 1.0}, "weighted_average")
    for bad in (({"a": 0.5},), ({"a": 1.5, "b": -0.5},), ({"a": 1.0}, {"a": 2.0}), ({"a": 1.0}, None, "no")):
        with pytest.raises(ValueError):
            aggregate.check_weights(*bad)


def test_path_predicates(spark):
    from adherix.functions import paths

    rows = [("src/a.ts", False, ".ts"), ("latest_news.ts", True, ".ts"), (".env", False, ""), (".env.local", False, ".local"), ("x/build/a.js", True, ".js"), ("a.d.ts", True, ".ts"), ("Makefile", False, ""), ("A.PY", False, ".PY"), ("", False, ""), (None, False, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "path string")
    got = {r["path"]: (r["x"], r["s"]) for r in df.select("path", paths.excluded(F.col("path")).alias("x"), paths.suffix(F.col("path")).alias("s")).collect()}
    assert got == {p: (x, s) for p, x, s in rows}
    assert all(paths.left_out(p) == x for p, x, _ in rows if p is not None)
    pairs = spark.createDataFrame([("a.ts", "b.py"), ("a.sql", "b.sql"), ("a.sql", "b.py"), ("a.md", "b.ts"), ("a.md", "b.md")], "a string, b string")
    assert [r[0] for r in pairs.select(paths.compatible(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, True]


def test_training_scan(spark):
    from adherix.operators import training

    rows = [(1, "a.py", "x = 1"), (2, "a_test.py", "x = 1"), (3, "coverage/a.py", "x"), (4, "b.py", " \n"), (5, "B.GO", "y " * 600), (6, "notes.md", "text"), (7, "c.d.ts", "z")]
    files = spark.createDataFrame(rows, "file_id long, path string, content string")
    domains = files.select("file_id", F.lit("backend").alias("domain"))
    assert {(r["file_id"], r["tokens"]) for r in training.scan(files, domains).collect()} == {(1, 3), (5, 512)}
    assert [r["file_id"] for r in training.scan(files, domains, tests=True, most=2).collect()] == [1, 2]
    assert training.scan(files.limit(0), domains).count() == 0


def test_whole_file_where_no_function_was_scored(spark):
    from adherix.operators import similarity

    index = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "ref_id long, file_path string")
    scored = spark.createDataFrame([(1, 0.4)], "query_id long, score double")
    whole = spark.createDataFrame([("a", 0.9), ("b", 0.7), ("b", 0.6)], "file_path string, score double")
    assert {r["file_path"]: r["score"] for r in similarity.file_adherence(index, scored, whole).collect()} == {"a": 0.4, "b": 0.7, "c": 0.0}
    assert {r["file_path"]: r["score"] for r in similarity.file_adherence(index, scored).collect()} == {"a": 0.4, "b": 0.0, "c": 0.0}


def test_classification_of_repeated_rows_and_secondaries(spark):
    from adherix.operators import classify

    rows = [(1, "tests/api/test_views.py", "import pytest\ndef test_a():\n    assert 1"), (1, "tests/api/test_views.py", "import pytest\ndef test_a():\n    assert 1"), (2, "", "")]
    got = classify.classify(spark.createDataFrame(rows, "file_id long, path string, content string")).orderBy("file_id").collect()
    assert [r["domain"] for r in got] == ["testing", "testing", "unknown"] and got[0] == got[1]
    assert got[2]["confidence"] == 0.5 and got[2]["secondaries"] == []
    for r in got:
        assert r["domain"] not in [x["domain"] for x in r["secondaries"]] and len(r["secondaries"]) <= 3


SCRIPT = """import a from 'a';
export async function top<T>(x: T): Promise<{ y: T }> { if (x) { return { y: x } } }
const arrow = (x) => {
  return x; // } not the end
};
const short = x => x + 1;
const typed = (x: string): string => `${x}`;
class K extends L {
  private async run(a = "}"): Promise<void> {
    for (const b of a) { go(b); }
  }
  static get size() { return 1 }
}
export default function () { return 0 }
"""


@pytest.mark.parametrize(
    "kind, text, names",
    [
        ("ts", SCRIPT, [("top", False, 2, 2), ("arrow", False, 3, 5), ("short", False, 6, 6), ("typed", False, 7, 7), ("run", True, 9, 11), ("size", True, 12, 12), ("func_line_14", False, 14, 14)]),
        ("go", "package p\n\nfunc (s *S) Run(x interface{}) (int, error) {\n\treturn 1, nil\n}\n\nfunc New[T any](v T) map[string]interface{} {\n\treturn nil\n}\n", [("Run", True, 3, 5), ("New", False, 7, 9)]),
        ("java", "class A {\n  @Override\n  public List<String> get(int x) throws E, F {\n    if (x > 1) { call(x); }\n    return new B(x) { };\n  }\n  abstract void none();\n}\n", [("get", True, 2, 6)]),
        ("py", "if x:\n    def f():\n        def g():\n            pass\nclass A:\n    async def m(self): pass\n", [("f", False, 2, 4), ("g", False, 3, 4), ("m", True, 6, 6)]),
        ("py", "def (", []), ("md", "function f() {}", []), ("ts", "", []), ("ts", "function f( {", []),
    ],
)
def test_functions_by_language(kind, text, names):
    assert [(n, m, a, b) for n, m, _, a, b in functions.functions_of(text, kind)] == names


def test_compression_of_arrays_and_objects(spark):
    numbers = "const a = [" + ", ".join(str(i) for i in range(600)) + "];"
    objects = "const o = {" + ", ".join(f"k{i}: [1, 2]" for i in range(200)) + "};\nfunction f() { return 1; }"
    block = "function f() {" + "g(1);" * 400 + "}"
    table = 'var t = []string{' + ", ".join('"abc"' for _ in range(300)) + "}"
    rows = [(numbers, "ts", "const a = [0, 1, 2, 3, 4, /* ... */];"), (objects, "js", "const o = {/* ... */};\nfunction f() { return 1; }"), (block, "ts", block), (table, "go", "var t = []string{/* ... */}"), ("", "ts", ""), (None, "ts", None), ("x = [1]", None, "x = [1]")]
    df = spark.createDataFrame([(c, k) for c, k, _ in rows], "c string, k string")
    assert [r[0] for r in df.select(functions.compress(F.col("c"), F.col("k"))).collect()] == [w for *_, w in rows]


def whole(text: str, kind: str) -> bool:
    """Whether a chunk can hold a function at all: Python that parses, in other languages brackets that all match."""
    import ast

    from adherix.functions.lexing import outline

    if kind == "py":
        try:
            return bool(ast.parse(text))
        except SyntaxError:
            return False
    o = outline(text, kind)
    return 2 * len(o.pairs) == sum(o.code.count(c) for c in "()[]{}")


def test_functions_of_the_given_chunks_are_found_again(spark):
    """Each whole chunk of the table is one function whose name the table holds; truncated and merged chunks, planted there, are left out."""
    path = "/root/testdata/sf0.001/function_chunks.parquet"
    try:
        raw = spark.read.parquet(path)
    except Exception:
        pytest.skip("no test data here")
    one = latest(raw.where("chunk_id IS NOT NULL").select("chunk_id", "ingested_at", "file_path", "function_name", "function_code"), ["chunk_id"], ["ingested_at"], ["file_path", "function_name", "function_code"])
    one = one.where("function_code <> '' AND NOT startswith(function_name, 'file_') AND file_path IS NOT NULL")
    files = one.select(F.col("chunk_id").alias("file_id"), F.col("file_path").alias("path"), F.col("function_code").alias("content"))
    got = functions.extract_functions(files).groupBy("file_id").agg(F.collect_set(F.lower("function_name")).alias("names"))
    rows = one.join(got, one["chunk_id"] == got["file_id"]).select("file_path", "function_code", "function_name", "names").collect()
    judged = [r["function_name"].lower() in r["names"] for r in rows if whole(r["function_code"], r["file_path"].rsplit(".", 1)[-1].lower())]
    assert len(judged) > 0.85 * len(rows) and sum(judged) >= 0.99 * len(judged)
