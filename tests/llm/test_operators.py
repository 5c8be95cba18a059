"""The dealt operators on small fixtures, edge cases and against brute force."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from adherix.llm import p1_overlap, p2_split, p3_provenance, p4_syntax, p5_neighbours, p6_leaks, p7_mix, p8_residue

T0 = dt.datetime(2024, 1, 1)
CHUNKS = "chunk_id long, repo string, commit_id string, file_path string, function_name string, is_method boolean, imports string, function_code string, start_line int, end_line int, ingested_at timestamp, _n int, cls long, kind string, _r string, digests string, code string"
PAIRS = "pair_id long, split string, source string, anchor string, comparison string, is_positive boolean, pair_type string, created_at timestamp, ingested_at timestamp, tid long, at string, side int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, repo string, doc_kind string, created_at timestamp, ingested_at timestamp, term string, pos int, item_id long, key long"
ITEMS = "item_id long, split string, suite string, text string, doc_id long"
INDEX = "ref_id long, commit_id string, domain string, ref_ord long, file_path string, function_name string, is_method boolean, snippet string, embedding array<float>, cls long, vec string"
LIBS = "lib_file_id int, lib_name string, lib_version string, file_name string, content string, digest long"
TARGETS = "source string, target_weight double, max_repeats int, range int"


def frame(spark, schema, rows):
    n = len(schema.split(", "))
    return spark.createDataFrame([tuple(r) + (None,) * (n - len(r)) for r in rows], schema)


def chunk(i, path, code, repo="r", method=False, line=1, late=0):
    return (i, repo, "c", path, "f", method, "", code, line, line, T0 + dt.timedelta(days=late))


# problem 1
def code(rng, n=60):
    return "\n".join(f"  const {rng.choice('abcdef')}{rng.randrange(999)} = call{rng.randrange(999)}(x{rng.randrange(99)}, 'w{rng.randrange(999)}');" for _ in range(n // 4))


def change(text, share, rng):
    places = [m.end() for m in re.finditer(r"\w+", text)]
    for at in sorted(rng.sample(places, int(len(places) * share)), reverse=True):
        text = text[:at] + "Q" + text[at:]
    return "// note\n" + text.replace("\n", "\r\n  ") + "\n/* end */"


def test_p1_finds_near_records_and_only_those(spark):
    rng = random.Random(5)
    base = [(code(rng), code(rng)) for _ in range(40)]
    rows = [(i, "train", "s", a, c) for i, (a, c) in enumerate(base)]
    want = set()
    for i in range(0, 30, 3):
        a, c = base[i]
        rows.append((100 + i, "test", "t", change(a, 0.05, rng), change(c, 0.05, rng)))
        want.add((i, 100 + i))
        a, c = base[i + 1]
        rows.append((100 + i + 1, "validation", "t", c, change(a, 0.04, rng)))  # crosswise
        want.add((i + 1, 100 + i + 1))
        a, c = base[i + 2]
        rows.append((100 + i + 2, "test", "t", a, change(c, 0.5, rng)))  # only one text is shared
    rows += [rows[45], (900, "test", "t", None, base[0][1]), (901, None, "t", *base[0]), (None, "test", "t", *base[0])]
    df = frame(spark, PAIRS, rows)
    got = {(r[0], r[1]) for r in p1_overlap.found(df).collect()}
    assert got == want
    rep = {(r["split"], r["source"]): (r["records"], r["overlapping"]) for r in p1_overlap.report(df).collect()}
    assert rep["validation", "t"] == (10, 10)
    assert rep["test", "t"][1] == 10


def test_p1_hot_anchor(spark):
    rng = random.Random(6)
    hot = code(rng)
    comps = [code(rng) for _ in range(60)]
    rows = [(i, "train" if i < 50 else "test", "s", hot, comps[i]) for i in range(60)] + [(100, "test", "s", hot, comps[3])]
    got = {(r[0], r[1]) for r in p1_overlap.found(frame(spark, PAIRS, rows)).collect()}
    assert got == {(3, 100)}


def test_p1_short_texts_with_scattered_changes_and_boilerplate(spark, monkeypatch):
    monkeypatch.setattr(p1_overlap, "SHARE", 10)
    rng = random.Random(15)
    head = "\n".join(f"import {{ alpha{i}, beta{i} }} from 'lib{i}';" for i in range(6)) + "\n"  # a third of every text
    texts = [(head + code(rng, 48), head + code(rng, 48)) for _ in range(90)]
    rows = [(i, "train", "s", a, c) for i, (a, c) in enumerate(texts)]
    scattered = lambda x: change(x, 0.09, rng)
    rows += [(1000 + i, "test", "t", scattered(a), scattered(c)) for i, (a, c) in enumerate(texts[:60])]
    got = {(r[0], r[1]) for r in p1_overlap.found(frame(spark, PAIRS, rows)).collect()}
    want = {(i, 1000 + i) for i in range(60)}
    assert got <= want and len(got) >= 57  # texts of 90 words with a tenth changed may keep less than the least overlap


def test_p1_words_leave_out_comments_and_layout():
    assert p1_overlap.words("a = 'b // c' # d\n/* e */ f(1.5) // g\n") == ["a", "b", "c", "f", "1", "5"]
    assert p1_overlap.words("") == []


def test_p1_chunks_resynchronise():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    g = np.concatenate([h[:100], rng.integers(1, 1 << 60, 3).astype(np.uint64), h[100:]])
    a, la = p1_overlap.chunks(h)
    b, lb = p1_overlap.chunks(g)
    assert la.sum() == 400 and lb.sum() == 403
    assert len(set(a) & set(b)) > 0.9 * len(a)


# problem 2
def texts():
    rng = random.Random(3)
    lines = "\n".join("  " * rng.randrange(4) + f"line {i} " + "x" * rng.randrange(60) + rng.choice([";", "", "{", "}"]) for i in range(700))
    return {"lines": lines, "one line": "a(b);c{d}" * 3000, "no boundary": "x" * 9000, "long lines": "\n".join("y " * 1700 for _ in range(9)), "crlf": lines.replace("\n", "\r\n"), "accents": "é\n" * 5000, "blank": "\n" * 9000, "astral": "\U0001f600 x\n" * 3000}


@pytest.mark.parametrize("name", texts())
def test_p2_pieces(name):
    text = texts()[name]
    parts = p2_split.cuts(text)
    at = 0
    for k, (begin, body, end, kind) in enumerate(parts):
        assert body == at and end > body and end - begin <= 4000
        if end < len(text) and kind != "line":
            assert "\n" not in text[body : min(len(text), begin + 4000)]
        if k:
            repeated = text[begin:body]
            full = text[parts[k - 1][0] : body]
            assert repeated.count("\n") <= 5 and full.endswith(repeated)
            unit = text.find("\n", body) + 1 or len(text)
            tail = full[:-1].rsplit("\n", 5)[1:] if full.count("\n") > 5 else None
            if tail and len("\n".join(tail)) + 1 + unit - body <= 4000:
                assert repeated.rstrip("\n").count("\n") == 4 or full.endswith("\n" * 5)
        at = end
    assert at == len(text)


def test_p2_edits_move_only_neighbouring_cuts():
    text = texts()["lines"]
    a = {text[b:e] for _, b, e, _ in p2_split.cuts(text)}
    edited = text[:9000] + "inserted();\n" + text[9000:]
    b = {edited[x:e] for _, x, e, _ in p2_split.cuts(edited)}
    assert len(a & b) >= len(a) // 2


def test_p2_table(spark):
    big = texts()["lines"]
    df = frame(spark, CHUNKS, [chunk(1, "a.ts", big, line=10), chunk(1, "a.ts", big, line=10), chunk(2, "b.ts", "x" * 4000), chunk(3, "c.ts", None), chunk(4, "d.ts", ""), chunk(5, "e.ts", "x" * 4001, line=None), chunk(6, "f.ts", big), chunk(6, "f.ts", "small", late=3)])
    assert sorted(r[0] for r in p2_split.found(df).collect()) == [1, 5]
    rows = p2_split.split_oversized(df).where("chunk_id = 1").orderBy("piece_no").collect()
    lines = big.split("\n")
    for r in rows:
        assert r["piece"].split("\n")[0] == lines[r["start_line"] - 10]
        assert r["piece"].rstrip("\n").split("\n")[-1] == lines[r["end_line"] - 10]
    assert "".join(r["piece"][r["overlap_chars"] :] for r in rows) == big
    assert p2_split.split_oversized(df).where("chunk_id = 5").first()["start_line"] is None


# problem 3
def test_p3_kinds(spark):
    rng = random.Random(8)
    hand = "\n".join(f"export function f{i}(a) {{\n  const b = a.get{i}('x');\n  return b;\n}}\n" for i in range(12))
    lib = "\n".join(f"function lib{rng.randrange(9999)}(v{i}) {{\n  return v{i}.call{rng.randrange(9999)}(w{rng.randrange(9999)});\n}}" for i in range(30))
    mini = "".join(f"function a{i}(b){{var c=b+{i};return c>b?c:b}}if(d){{e({i})}};" for i in range(40))
    data = "export default [\n" + "".join(f"  {rng.randrange(99999)}, {rng.randrange(99999)},\n" for _ in range(60)) + "];\n"
    rows = [
        chunk(1, "src/a.js", hand), chunk(2, "src/b.js", mini), chunk(3, "src/c.js", data), chunk(4, "src/d.js", "/* header */\n" + lib.replace("\n", "\r\n")), chunk(5, "src/e.js", "// Code generated by tool. DO NOT EDIT.\n" + hand),
        chunk(6, "src/vendors/f.js", hand), chunk(7, "x/node_modules/q/g.js", hand), chunk(8, "src/h_pb2.py", "x = 1"), chunk(9, "src/i.js", "const BANNER = '// Code generated by x. DO NOT EDIT.';\n// generated ids are skipped\n" + hand),
        chunk(10, "src/j.ts", '{"a": [' + ", ".join(['"text"'] * 90) + "]}"), chunk(11, "src\\vendor\\quill\\k.js", None), chunk(12, None, hand), chunk(13, "src/l.js", ""), chunk(14, "src/a.js", hand),
        chunk(15, "src/m.js", "/*\n * This module generates code; it is written by hand\n */\n" + hand),
    ]
    libs = frame(spark, LIBS, [(1, "q", "1", "lib.js", lib), (2, "e", "1", "e.js", None)])
    df = frame(spark, CHUNKS, rows)
    got = {r["file_path"]: r["kind"] for r in p3_provenance.provenance(df, libs).collect()}
    assert {k: v for k, v in got.items() if v} == {"src/b.js": "minified", "src/c.js": "data", "src/d.js": "vendored", "src/e.js": "generated", "x/node_modules/q/g.js": "vendored", "src/h_pb2.py": "generated", "src\\vendor\\quill\\k.js": "vendored"}
    assert set(got) == {r[3] for r in rows}
    assert p3_provenance.hand_written(df, libs).count() == len(rows) - 7


def test_p3_serial_code_and_claims_of_others(spark):
    rng = random.Random(12)
    serial = "\n".join(f"export function getSlot{i:04d}(b) {{\n  return b.slot({i});\n}}" for i in range(40))
    hand = "\n".join(f"export function {rng.choice('pqrst')}{rng.randrange(99)}(a) {{\n  const b = a.{rng.choice('uvwxyz')}{rng.choice('uvwxyz')}('{rng.choice('klmn')}');\n  return b {rng.choice('+-*/')} {rng.choice('ghij')};\n}}\n" for i in range(12))
    long_head = "/*\n" + " * changes of the release\n" * 400 + " */\n// @generated by bindtool from a.yaml\n"
    rows = [
        chunk(1, "a.js", serial), chunk(2, "b.js", long_head + hand), chunk(3, "c.js", "/*! quillo v2.7.5 */\n" + hand), chunk(4, "d.js", "// Copyright (C) the glimt authors.\n// Licensed under Apache-2.0\n" + hand),
        chunk(5, "e.js", "/*\n * Copyright (c) 2023 the brisk-desk team\n * Released under the MIT license\n */\n" + hand, repo="brisk-desk"), chunk(6, "f.js", "/*\n * vendored glimt code was removed in favour of our own\n */\n" + hand),
        chunk(7, "g.js", "x" * 30), *[chunk(100 + i, "h.js", f"export function getSlot{i:04d}(b) {{\n  return b.slot({i});\n}}", line=4 * i + 1) for i in range(60)], *[chunk(300, "i.js", hand)] * 5,
    ]
    got = {r["file_path"]: (r["kind"], r["evidence"]) for r in p3_provenance.provenance(frame(spark, CHUNKS, rows), frame(spark, LIBS, [])).collect()}
    assert got == {"a.js": ("generated", "uniformity"), "b.js": ("generated", "header"), "c.js": ("vendored", "header"), "d.js": ("vendored", "header"), "e.js": (None, None), "f.js": (None, None), "g.js": (None, None), "h.js": ("generated", "uniformity"), "i.js": (None, None)}


def test_p3_canonical_layout():
    x = p3_provenance.layout("/* a */\nfor (let i = 0; i < n; i++) { f(i); g1(i); g2(i); }\n", False)
    assert (x["lines"], x["canonical"], x["statements"], x["distinct"], x["said"]) == (1, 5, 4, 3, "/* a */")
    x = p3_provenance.layout("#\n# b\ndef f(x):\n    return {1: 2,\n  3: 4}; g(x)\n", True)
    assert (x["lines"], x["canonical"], x["said"]) == (3, 3, "#\n# b")
    assert p3_provenance.layout("", True)["canonical"] == 0


# problem 4
def test_p4_files_and_rates(spark):
    rows = [chunk(1, "a.TS", "const x = 1;"), chunk(2, "a.TS", "const x = ;"), chunk(2, "a.TS", "const x = ;"), chunk(3, "b.py", "def f(:"), chunk(4, "c.md", "(("), chunk(5, "d.go", None), chunk(6, "e.js", ""), chunk(7, "f.java", "int m() { return 1; }", method=True), chunk(8, None, "(("), chunk(9, "g.js", "f(", repo=None)]
    df = frame(spark, CHUNKS, rows)
    assert sorted((r[0] or "", r[1]) for r in p4_syntax.found(df).collect()) == [("", "g.js"), ("r", "a.TS"), ("r", "b.py")]
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid_files"]) for r in p4_syntax.rates(df).collect()}
    assert rates["r", "typescript"] == (1, 1) and rates["r", "go"] == (1, 0) and rates[None, "javascript"] == (1, 1)
    assert {r["chunk_id"] for r in p4_syntax.valid_rows(df).collect()} == {4, 5, 6, 7, 8}


def test_p4_maps_are_composed_by_spark(spark, monkeypatch):
    from adherix.llm.grammar import states

    rng = random.Random(21)
    lines = ["f(a, [1, 2])", "x = {", "}", "(", ")", "[", "]", "/* open", "close */", "`raw {", "end`", "s := \"((\"", "// ((", "y"]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(1, 400))) for _ in range(120)] + ["func f() {\n" + "  g(`a\n(`)\n" * 2000 + "}\n", "func f() {\n" + "  g(1)\n" * 4000]
    rows = [(i, "r", f"{i}.go", i, "go", False, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "key long, repo string, file_path string, chunk_id long, kind string, is_method boolean, function_code string")
    monkeypatch.setattr(p4_syntax, "PIECE", 200)
    read = df.mapInPandas(p4_syntax._judge, "key long, repo string, file_path string, chunk_id long, kind string, reason string, piece int, exits array<int>, closing array<string>, opening array<string>")
    got = {r["key"] for r in p4_syntax.unbalanced(read.where("piece IS NOT NULL")).collect()}
    assert got == {i for i, t in enumerate(texts) if not states.balanced(t, "go", 10**9)} and 120 not in got and 121 in got


# problem 5
def vectors(n, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 8 + 1, 64))
    return (centre[rng.integers(0, len(centre), n)] + 0.5 * rng.normal(size=(n, 64))).astype(np.float32)


def brute(v, dom, k):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    out = {}
    for i in range(len(v)):
        others = [j for j in range(len(v)) if dom[j] == dom[i] and j != i]
        out[i] = sorted(others, key=lambda j: (-round(float(u[i] @ u[j]), 5), j))[:k]
    return u, out


def test_p5_recall_and_mutual_pairs(spark, monkeypatch):
    monkeypatch.setattr(p5_neighbours, "CELL", 60)
    monkeypatch.setattr(p5_neighbours, "BLOCK", 128)
    v = vectors(900)
    v[10] = v[11] * 3
    dom = ["a" if i % 3 else "b" for i in range(900)]
    rows = [(i, "c", dom[i], i, "f", "g", None, None, v[i].tolist()) for i in range(900)]
    bad = [None, [0.0] * 64, [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63]
    rows += [(2000 + i, "c", "a", i, "f", "g", None, None, b) for i, b in enumerate(bad)] + [(3000, "c", None, 1, "f", "g", None, None, v[0].tolist()), rows[5]]
    df = frame(spark, INDEX, rows)
    near = p5_neighbours.most_similar(df)
    got = {}
    for r in near.collect():
        got.setdefault(r["ref_id"], {})[r["rank"]] = (r["near_id"], r["similarity"])
    u, want = brute(v, dom, 10)
    assert set(got) == set(range(900)) and all(sorted(x) == list(range(1, 11)) for x in got.values())
    hit = sum(len({x[0] for x in got[i].values()} & set(want[i])) for i in want)
    assert hit >= 0.9 * 9000
    pairs = {(i, j) for i in want for j in want[i] if i < j and i in want[j] and u[i] @ u[j] >= 0.9}
    found = {(r[0], r[1]) for r in p5_neighbours.found(df).collect()}
    assert (10, 11) not in pairs or (10, 11) in found
    assert len(found & pairs) >= 0.97 * len(pairs) and len(found - pairs) <= 0.03 * len(pairs)


def test_p5_recall_in_a_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3600, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:1200] = v[0] + 0.1 * v[:1200]  # cosines of 0.99 among a third of the rows
    v = v.astype(np.float32)
    rows = [(i, "c", "a", i, "f", "g", None, None, v[i].tolist()) for i in range(len(v))]
    got = {}
    for r in p5_neighbours.most_similar(frame(spark, INDEX, rows)).collect():
        got.setdefault(r["ref_id"], set()).add(r["near_id"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = u @ u.T
    np.fill_diagonal(cosine, -2)
    hits = [len(got[i] & set(near.tolist())) for i, near in enumerate(np.argsort(-cosine, axis=1)[:, :10])]
    assert sum(hits[:1200]) >= 0.95 * 12000 and sum(hits[1200:]) >= 0.9 * 24000


def test_p5_copies_and_small_domains(spark):
    v = vectors(40)
    rows = [(i, "c", "hot", i, "f", "g", None, None, v[0].tolist()) for i in range(300)] + [(1000 + i, "c", "hot", i, "f", "g", None, None, v[i].tolist()) for i in range(1, 20)] + [(5000, "c", "one", 1, "f", "g", None, None, v[3].tolist())]
    got = {}
    for r in p5_neighbours.most_similar(frame(spark, INDEX, rows)).collect():
        got.setdefault(r["ref_id"], []).append((r["rank"], r["near_id"]))
    assert [x for _, x in sorted(got[200])] == list(range(10))
    assert [x for _, x in sorted(got[3])] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert 5000 not in got and all(len(x) == 10 for x in got.values())


# problem 6
def test_p6_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choices(vocab, k=n)) for n in (5, 17, 18, 19, 30, 60, 90, 90)] + ["", None, "!!"]
    docs = []
    for i in range(160):
        ws = rng.choices(vocab, k=rng.randrange(5, 120))
        t = rng.choice(items[:8]).split()
        a = rng.randrange(len(t))
        part = t[a : a + rng.choice([3, 17, 18, 19, 60])]
        at = rng.randrange(len(ws))
        docs.append(" ".join(ws[:at]) + "\n> " + "\n> ".join(p.upper() + rng.choice(["", ",", " -"]) for p in part) + "\n" + " ".join(ws[at:]))
    docs += ["", None, " ".join(items[4].split()[:17]), items[0] + "."]
    want = set()
    for d, text in enumerate(docs):
        ws = p6_leaks.words(text or "")
        for i, it in enumerate(items):
            t = p6_leaks.words(it or "")
            n = min(18, len(t))
            if n and {tuple(t[k : k + n]) for k in range(len(t) - n + 1)} & {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}:
                want.add((d, i))
    ddf = frame(spark, DOCS, [(i, t) for i, t in enumerate(docs)] + [(0, docs[0])])
    idf = frame(spark, ITEMS, [(i, "test", "s", t) for i, t in enumerate(items)] * 2)
    assert {(r[0], r[1]) for r in p6_leaks.found(ddf, idf).collect()} == want
    assert {r["item_id"] for r in p6_leaks.report(ddf, idf).collect()} == {i for _, i in want}


def test_p6_proximity_and_small_bit_table(spark, monkeypatch):
    monkeypatch.setattr(p6_leaks, "BITS", 64)  # nearly every word passes; the joins must tell
    rng = random.Random(7)
    item = [f"t{i}" for i in range(40)]
    pad = lambda n: [f"p{rng.randrange(999)}" for _ in range(n)]
    texts = [pad(20) + item[5:25] + pad(5), pad(9) + item[0:11] + ["x", "y"] + item[11:22] + pad(9), pad(9) + item[0:12] + pad(8) + item[12:24], pad(50), pad(5) + item[10:22] + item[24:34] + pad(3)]
    docs = frame(spark, DOCS, [(i, " ".join(t)) for i, t in enumerate(texts)])
    items = frame(spark, ITEMS, [(1, "test", "s", " ".join(item))])
    assert {r[0] for r in p6_leaks.found(docs, items).collect()} == {0}
    near = {r["doc_id"]: (r["matched_words"], r["span"]) for r in p6_leaks.proximity(docs, items).collect()}
    assert near == {0: (20, 20), 1: (22, 24), 4: (22, 22)}


# problem 7
def test_p7_shares_caps_and_copies(spark):
    rng = random.Random(9)
    docs, k = [], 0
    for source, n in (("Big Source", 400), ("small", 20), ("other", 100), ("unlisted", 50)):
        for _ in range(n):
            docs.append((k, " ".join(f"tok{rng.randrange(999)}" for _ in range(rng.randrange(5, 60))), "en", rng.choice([source, source.upper(), source.replace(" ", "-")])))
            k += 1
    docs += [(k + i, docs[i][1], "en", "other") for i in range(5)] + [(k + 9, None, "en", "small"), (k + 10, "  ", "en", "small"), (k + 11, "x", "en", None)]
    targets = frame(spark, TARGETS, [("big_source", 0.6, 2), ("small", 0.1, 3), ("other", 0.2, None), ("absent", 0.1, 4)])
    df = frame(spark, DOCS, docs)
    chosen, shares = p7_mix.mix(df, targets, total_tokens=p7_mix.EXACT)
    rows = chosen.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and not {r["doc_id"] for r in rows} & set(range(520, 600))
    cap = {"big_source": 2, "small": 3, "other": 1}
    assert all(1 <= r["repeats"] <= cap[r["source"]] for r in rows)
    got = {r["source"]: r["actual_share"] for r in shares.collect()}
    assert got["absent"] == 0 and abs(got["big_source"] - 0.6 / 0.9) < 0.01 and abs(got["small"] - 0.1 / 0.9) < 0.01 and abs(got["other"] - 0.2 / 0.9) < 0.01
    full = {r["source"]: r for r in p7_mix.mix(df, targets, total_tokens=p7_mix.ALL)[1].collect()}
    assert full["small"]["most_repeats"] > 1
    assert sorted(map(tuple, p7_mix.mix(df, targets, total_tokens=p7_mix.EXACT)[0].collect())) == sorted(map(tuple, rows))


def test_p7_default_is_as_large_as_the_sources(spark, monkeypatch):
    monkeypatch.setattr(p7_mix, "RANGE_ROWS", 8)
    monkeypatch.setattr(p7_mix, "BLOCK_RANGES", 4)
    rng = random.Random(11)
    docs, k = [], 0
    for source, n in (("big", 700), ("small", 60), ("tiny", 10)):
        for _ in range(n):
            docs.append((k, " ".join(f"tok{rng.randrange(999)}" for _ in range(rng.randrange(5, 60))), "en", source))
            k += 1
    df = frame(spark, DOCS, docs + [(k + i, docs[0][1], "en", "big") for i in range(300)])
    targets = frame(spark, TARGETS, [("big", 0.6, 1), ("small", 0.3, 5), ("tiny", 0.1, 2)])
    chosen, shares = p7_mix.mix(df, targets)
    rows = chosen.collect()
    size = {r["doc_id"]: r["n_tokens"] for r in p7_mix.sized(df, targets).collect()}
    assert set(size) == set(range(770))  # copies are one text, under its smallest id
    total = sum(size.values())
    got = {r["source"]: r.asDict() for r in shares.collect()}
    spent = {s: sum(r["n_tokens"] * r["repeats"] for r in rows if r["source"] == s) for s in got}
    assert all(got[s]["tokens"] == spent[s] for s in got)
    assert abs(spent["big"] - 0.6 * total) < 100 and abs(spent["small"] - 0.3 * total) < 100  # within a text of the budget
    assert {r["repeats"] for r in rows if r["source"] == "tiny"} == {2} and got["tiny"]["missing_tokens"] > 0  # all it has, twice
    repeats = [r["repeats"] for r in rows if r["source"] == "small"]
    assert len(repeats) == 60 and max(repeats) - min(repeats) == 1 and max(repeats) <= 5
    assert got["big"]["missing_tokens"] == 0 and abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9


# problem 8
def test_p8_cases(spark):
    real = "We moved the parser out of the layer because many callers depended on it. Reviewers asked to document the queue. "
    cases = ["Dear {{name}}, thanks for the review of {{module}} last week.", real * 3 + "Copyright [Your team] by the <%= owner %> team, all rights reserved.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt ut labore.", "# Title\n\n404 Not Found\n\nTry again later.\n\nproxyd/1.2", "Home | Docs | About\nPlease enable JavaScript to view this page.", "Seite nicht gefunden\n\nSie haben keine Berechtigung für diese Seite.", "blah blah blah\nTBD\nComing soon"]
    fine = [real * 5, "", None, "   ", "Placeholders such as `{{ name }}` are filled before the job is sent. " + real, "```js\nconst a = `x ${b}`;\n```\n" + real, "The route `a/b` returns 404 Not Found when the node is valid. " + real, "The template engine replaces ${name} with the value, so nothing may escape it. " + real, "We removed the lorem ipsum text from the page and wrote a real section. " + real, "x = f\"a {b}\"; y = {c: d}; return x;"]
    rows = [(i, t) for i, t in enumerate(cases)] + [(100 + i, t) for i, t in enumerate(fine)] + [(0, cases[0])]
    df = frame(spark, DOCS, rows)
    assert sorted(r[0] for r in p8_residue.found(df).collect()) == list(range(len(cases)))
    assert p8_residue.real_texts(df).count() == len(fine)


def test_p8_pages_of_any_length_and_in_any_words(spark):
    rng = random.Random(2)
    words = [f"v{c}{d}" for c in "abcdefgh" for d in "klmnopq"]
    real = [" ".join(rng.choices(words, k=40)) + "." for _ in range(60)]
    latin = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt ut labore. " * 60
    trace = "Traceback (most recent call last):\n" + "\n".join(f'  File "/srv/app/a{i}.py", line {i}, in run' for i in range(200)) + "\nValueError: bad value"
    unknown = [f"Kapcsolat megszakadt. A lap nem jelent meg ({rng.randrange(10**8)}). Kod {rng.randrange(10**6):x}a1." for _ in range(5)]
    versions = [real[0] + " " + real[1] + " Try again later. An unexpected error occurred while rendering this page. " + real[2 + i] for i in range(6)]  # of one text
    assert len(latin.split()) > 800 and len(trace) > 3600
    rows = [(i, t) for i, t in enumerate([latin, trace, *unknown])] + [(100 + i, t) for i, t in enumerate(versions + real)]
    assert sorted(r[0] for r in p8_residue.found(frame(spark, DOCS, rows)).collect()) == list(range(7))


def test_p8_slots_are_induced(spark):
    rng = random.Random(3)
    own = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(12)) + ". "
    lines = ["Dear ~~{}~~, thanks for the review.", "Dear ^{}^, thanks for the review.", "Dear {{{}}}, thanks for the review.", "Dear |*{}*|, thanks for the review."]
    rows = [(i, own() + x.replace("{}", n) + own()) for i, (x, n) in enumerate(zip(lines, ["a_name", "team", "owner", "x" * 90]))]
    rows = [r for r in rows if "~~" not in r[1]]
    rows += [(10 + i, own() + "Version {version} of the guide is out. " + own()) for i in range(4)]  # retained in each of them
    rows += [(20 + i, own() + f"The set {{{n}}} of {own()}") for i, n in enumerate("pqrst")] + [(30 + i, own() + f"See [{n}] of the list {own()}") for i, n in enumerate("pqrst")]
    rows += [(40, own() + "{{ a_name_of_more_than_forty_characters_that_nobody_filled }} " + own())]
    assert sorted(r[0] for r in p8_residue.found(frame(spark, DOCS, rows)).collect()) == [1, 2, 3, 10, 11, 12, 13, 40]


# empty tables
def test_empty_tables(spark):
    c, p, d, i, x, l, t = (frame(spark, s, []) for s in (CHUNKS, PAIRS, DOCS, ITEMS, INDEX, LIBS, TARGETS))
    assert p1_overlap.found(p).count() == 0 and p1_overlap.report(p).count() == 0
    assert p2_split.found(c).count() == 0
    assert p3_provenance.found(c, l).count() == 0
    assert p4_syntax.found(c).count() == 0 and p4_syntax.rates(c).count() == 0
    assert p5_neighbours.found(x).count() == 0
    assert p6_leaks.found(d, i).count() == 0
    assert p7_mix.mix(d, t)[0].count() == 0
    assert p8_residue.found(d).count() == 0
