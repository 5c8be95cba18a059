"""Problem 3: generated, minified, vendored and data files among source files.

Each chunk is lexed once into a token sequence and re-emitted in a canonical layout,
one statement a line.  Comparing the two layouts tells minified code (extreme expansion),
the shapes of the re-emitted statements tell serially produced code (perfect uniformity:
hardly any distinct statements once numbers are left out), and the tokens tell data saved
as code (literal dominance).  The comments before the code are read for what they claim:
a tool that wrote the file, or a package, version and holder that are not this
repository's.  Copies of third-party files are found by content-defined chunk digests
shared with the library files, whatever their path or layout.  Paths add what tools and
package managers write by convention.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adherix.llm.p1_overlap import chunks
from adherix.session import broadcast_below, cut, spread

#: Lines of the canonical layout for each line as it stands, from which code is minified.
EXPANSION = 5.0
#: Characters a line from which code on few lines is minified, however few its statements.
DENSITY = 300.0
#: Share of literals in the code from which a file is data.
LITERALS = 0.6
#: Share of re-emitted statements that repeat the shape of another one, from which a file is serially produced.
UNIFORMITY = 0.6
#: Share of a file's words that also stand in one library file, from which it is a copy.
COPIED = 0.5
#: Lines, characters and shapes added to each side of a ratio, so that short files need more evidence and none is left out.
FEW_LINES, FEW_CHARS, FEW_SHAPES, FEW_WORDS = 2.0, 80.0, 12.0, 10.0

_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_REST = r"|[^\W\d][\w$]*|\d[\w.]*|\n|[^\w\s]"
_LEX = {
    True: re.compile(r"\#[^\n]*|\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z)|" + _STRING + _REST, re.S),
    False: re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|" + _STRING + r"|`(?:[^`\\]|\\.)*`" + _REST, re.S),
}
_DIGITS = re.compile(r"\d+")
# Headers by which tools mark what they write, in the languages they speak.
_HEADER = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?\s?generated\b|\bautomatically generated\b|\bmachine[- ]generated\b|\bcode generated by\b|\bfile (?:is|was) (?:auto\w*[- ])?generated\b|\bthis (?:file|code|module) (?:is|was|has been) (?:auto\w*[- ])?(?:generated|produced|created|emitted|built|written) (?:by|from|with|using)\b"
    r"|\bgenerated (?:by|from|using|with|on|at) [\w./-]+(?:[^\n]{0,40}\bby\b)?[^\n]{0,60}(?:do not|don't|instead|\.(?:proto|ya?ml|json|xml|graphql|sql|thrift)\b|\d)|\bgenerated on [\d-]+ by\b"
    r"|\b(?:is|was) (?:produced|emitted|built) by \w+|\b(?:built|produced|emitted|written) by \w+[^\n]{0,60}(?:overwritten|do not edit|edits)"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bautomatiquement par\b|\bg[ée]n[ée]r[ée] automatiquement\b|\bgenerado autom[áa]ticamente\b|\bgenerado por\b|\bedits? (?:will be|get|are) (?:lost|overwritten)\b|\bedit [\w./-]+\.\w+ and run\b",
    re.I,
)
_DENIED = re.compile(r"\bwritten by hand\b|\bhand[- ]written\b|\bby hand\b(?! edit)|\bgenerates\b", re.I)
# Places and names that package managers and generators use.
_VENDORED_PATH = r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|third[_-]?party|vendor|external|externals|godeps)/|/[a-z][a-z0-9_.]*-\d+\.\d+\.\d+/"
_GENERATED_PATH = r"(?:^|/)(?:gen|generated|__generated__|auto[_-]?gen(?:erated)?)/|(?:\.gen|\.generated|_generated|\.g|\.designer|_pb2|_pb2_grpc|\.pb|\.pb\.gw)\.[a-z]+$"
_MINIFIED_PATH = r"[.\-_]min(?:ified)?\.[a-z]+$|\.(?:bundle|chunk|packed)\.js$"


# How a header names a package with its version, a holder of rights and a licence.
_PACKAGE = re.compile(r"(?:@license|@preserve|\b(?:taken|copied|adapted|imported|vendored) from|^)[\s*#/!;]*@?([a-z][\w./-]*?)(?:@|\s+)v?\d+\.\d+(?:\.\d+)*\b", re.I | re.M)
_HOLDER = re.compile(r"(?:copyright(?:[ \t]*\(c\))?|\(c\)|©)[ \t]*(?:\d{4}[\d, \t–-]*)?(?:by[ \t]+)?(?:the[ \t]+)?([^\W\d][^\n|,;<(]*)", re.I)
_LICENCE = re.compile(r"@licen[sc]e\b|\blicen[sc]ed? under\b|\b(?:released|distributed) under\b|\blicen[sc]e\b|\bSPDX-|\A\s*/\*!|\b(?:MIT|ISC|MPL-2\.0|(?:Apache|BSD|GPL|LGPL)-?\d)", re.I)
_GENERIC = frozenset("the and authors contributors developers maintainers team project all rights reserved".split())
_NAME = re.compile(r"[a-z0-9]+")


def normal_path(c: Column) -> Column:
    """A path with forward slashes, without a leading ./, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(?:\./)+", ""))


def claimed_by_others(said: str, repo: str, path: str) -> bool:
    """Whether leading comments name a package with version and licence, or a holder, that are not this repository's.

    A name is the repository's own if its words stand in the repository's name or the
    other way round; a package is also if it is a folder of the path.
    """
    own = set(_NAME.findall(repo.lower()))

    def foreign(name: str) -> bool:
        parts = set(_NAME.findall(name.lower())) - _GENERIC
        return bool(parts) and not parts <= own and not (own and own <= parts)

    for m in _HOLDER.finditer(said):
        if foreign(m[1]):
            return True
    folders = set(re.split(r"[/\\]", path.lower())[:-1])
    return bool(_LICENCE.search(said)) and any(foreign(m[1]) and m[1].lower() not in folders for m in _PACKAGE.finditer(said))


class _Tokens(dict):
    """Token text to a number, under which its class, length, hash and hash without digits stand in tables.

    Classes: c comment, d documentation string, s string, 0 number, i word; marks stand for
    themselves.  Spellings seen are kept in bounded number, long ones not at all.
    """

    def __init__(self, room: int = 400_000) -> None:
        super().__init__()
        self.resize(room)

    def resize(self, room: int) -> None:
        self.clear()
        self.used, self.room = 0, room
        self.kind, self.size = np.zeros(room, np.uint8), np.zeros(room, np.int64)
        self.hash, self.shape = np.zeros(room, np.uint64), np.zeros(room, np.uint64)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        if self.used + len(tokens) > self.room:
            self.resize(max(400_000, 2 * len(tokens)))
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def __missing__(self, t: str) -> int:
        c, at = t[0], self.used
        self.used += 1
        if c == "#" or t[:2] in ("//", "/*"):
            kind = "c"
        elif c in "\"'`" and len(t) > 1:
            kind = "d" if t[:3] in ('"""', "'''") else "s"
        elif c.isdigit():
            kind = "0"
        elif c.isalpha() or c == "_":
            kind = "i"
        else:
            kind = c if c < "\x7f" else "?"
        self.kind[at], self.size[at] = ord(kind), len(t)
        if kind != "c":
            self.hash[at] = xxhash.xxh3_64_intdigest(t)
            self.shape[at] = 7 if kind == "0" else xxhash.xxh3_64_intdigest(_DIGITS.sub("0", t))
        if len(t) < 64:
            self[t] = at
        return at


def _among(marks: str) -> np.ndarray:
    """A table that tells for each class whether it is one of ``marks``."""
    return np.isin(np.arange(256), [ord(c) for c in marks])


_seen = _Tokens()
_IS_LITERAL, _IS_HASHED, _IS_BREAK, _IS_CURLY = _among("s0d"), _among("s0i"), _among(";{}"), _among("{}")
_DEPTH = _among("([{").astype(np.int64) - _among(")]}")
_ROUND = _among("(").astype(np.int64) - _among(")")


def lexed(text: str, python: bool) -> tuple[np.ndarray, np.ndarray, str]:
    """Number and class of each token, and the comments before the code."""
    tokens = _LEX[python].findall(text)
    ids = _seen.numbers(tokens)
    kinds = _seen.kind[ids]
    code = (kinds != 99) & (kinds != 10)
    if python:
        code &= kinds != 100
    first = int(np.argmax(code)) if code.any() else len(tokens)
    return ids, kinds, "\n".join(t for t in tokens[:first] if t != "\n")


def re_emitted(kinds: np.ndarray, python: bool) -> np.ndarray:
    """Of the tokens of code, without comments, the number of the canonical line each one goes to.

    Brace languages break after ; { and } but not within the head of a loop; Python
    breaks at line ends and semicolons outside of brackets, and after the colon of a
    statement written on one line.
    """
    if python:
        depth = np.cumsum(_DEPTH[kinds])
        ends = (depth <= 0) & ((kinds == 10) | (kinds == 59) | ((kinds == 58) & (np.append(kinds[1:], 10) != 10)))
    else:
        ends = _IS_BREAK[kinds]
        semi = np.flatnonzero(kinds == 59)
        if len(semi):  # a semicolon within round brackets opened since the last curly one ends no statement
            depth = np.cumsum(_ROUND[kinds])
            curly = np.maximum.accumulate(np.where(_IS_CURLY[kinds], np.arange(len(kinds)), -1))[semi]
            ends[semi[depth[semi] > np.where(curly >= 0, depth[curly], 0)]] = False
    return np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(kinds) else np.zeros(0, np.int64)


def layout(text: str, python: bool) -> dict:
    """What the tokens of a text and its canonical layout tell, and the digests of its words."""
    ids, kinds, said = lexed(text, python)
    newline, kept = kinds == 10, kinds != 99
    code = kept & ~newline
    in_lines = np.cumsum(newline)[code]
    at = re_emitted(kinds[kept], python)[~newline[kept]]
    canonical = statements = distinct = shape = 0
    if len(at):
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        length = np.diff(np.append(starts, len(at)))
        place = (np.arange(len(at)) - np.repeat(starts, length)).astype(np.uint64)
        h = _seen.shape[ids[code]]
        mixed = (h ^ (h >> np.uint64(31))) * (np.uint64(2) * place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        digests = np.add.reduceat(mixed ^ (mixed >> np.uint64(27)), starts)
        digests = digests[(length > 1) | ~_IS_BREAK[kinds[code][starts]]]  # a lone bracket is no statement of its own
        canonical, statements, distinct = len(starts), len(digests), len(np.unique(digests))
        shape = int(np.add.reduce(digests).view(np.int64)) if statements else 0
    hashed = _IS_HASHED[kinds]
    d, n = chunks(_seen.hash[ids[hashed]])
    size = _seen.size[ids]
    return {
        "code": int(size[code].sum()), "literal": int(size[_IS_LITERAL[kinds]].sum()), "lines": 1 + int(np.count_nonzero(np.diff(in_lines))) if len(in_lines) else 0,
        "canonical": canonical, "statements": statements, "distinct": distinct, "shape": shape, "said": said, "words": int(hashed.sum()), "digests": d, "lengths": n,
    }


def _is_format(text: str) -> bool:
    """Whether the text is JSON and not code: a matter of validity, not of origin."""
    if text.lstrip()[:1] not in "{[":
        return False
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


_COLUMNS = ["code", "literal", "lines", "canonical", "statements", "distinct", "shape", "words"]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for repo, path, key, python, text in zip(b["repo"], b["file_path"], b["chunk"], b["python"], b["function_code"]):
            x = layout(text, python)
            said = x["said"]
            header = bool(_HEADER.search(said)) and not _DENIED.search(said)
            others = claimed_by_others(said, repo or "", path or "")
            data = x["literal"] > LITERALS * x["code"] and _is_format(text)
            rows.append((repo, path, key, *(x[c] for c in _COLUMNS), header, others, data, x["digests"], x["lengths"]))
        yield pd.DataFrame(rows, columns=["repo", "file_path", "chunk", *_COLUMNS, "header", "others", "format", "digests", "lengths"])


_SCHEMA = f"repo string, file_path string, chunk long, {', '.join(c + ' long' for c in _COLUMNS)}, header boolean, others boolean, format boolean, digests array<long>, lengths array<int>"


def _library(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for key, python, text in zip(b["lib_file_id"], b["python"], b["content"]):
            yield pd.DataFrame({"digest": np.unique(layout(text, python)["digests"])}).assign(lib_file_id=key)[["lib_file_id", "digest"]]


def _is_python(path: str) -> Column:
    return F.coalesce(F.lower(F.col(path)).rlike(r"\.py[iw]?$"), F.lit(False)).alias("python")


def provenance(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """A row per file (repo, file_path): its layout figures and the kinds found, null where it is hand-written.

    Columns: repo, file_path, kind (the first of vendored, data, minified,
    generated), evidence, expansion, literal_share, uniformity, copied_share, lib_file_id.
    Empty or null code gives no evidence, so a file of nothing but such chunks is
    judged by its path; chunks of the same text count once; null repos or paths form files of
    their own; empty tables give no rows.
    """
    known = libraries.where("content IS NOT NULL AND lib_file_id IS NOT NULL").select("lib_file_id", _is_python("file_name"), "content").distinct()
    lib = cut(known.mapInPandas(_library, "lib_file_id long, digest long").distinct())
    n_lib = lib.count()
    slim = files.select("repo", "file_path", _is_python("file_path"), F.coalesce("function_code", F.lit("")).alias("function_code")).withColumn("chunk", F.xxhash64("function_code"))
    parts = cut(spread(slim).mapInPandas(_features, _SCHEMA))

    file = ["repo", "file_path"]
    figures = ["code", "literal", "lines", "canonical", "statements", "distinct", "words", "header", "others", "format"]
    chunk = parts.groupBy(*file, "chunk", "shape").agg(*[F.max(c).alias(c) for c in figures])
    # chunks of one shape hold the same statements: each counts, their distinct shapes count once
    shape = chunk.groupBy(*file, "shape").agg(
        F.max((F.col("canonical") / (F.col("lines") + FEW_LINES))).alias("expansion"), F.max(F.when(~F.col("format"), (F.col("code") - FEW_CHARS) / (F.col("lines") + 1.0))).alias("density"),
        *[F.sum(c).alias(c) for c in ("code", "literal", "statements", "words")], F.max("distinct").alias("distinct"), *[F.max(c).alias(c) for c in ("header", "others", "format")],
    )
    per_file = shape.groupBy(*file).agg(F.max("expansion").alias("expansion"), F.max("density").alias("density"), *[F.sum(c).alias(c) for c in ("code", "literal", "statements", "words", "distinct")], *[F.max(c).alias(c) for c in ("header", "others", "format")])

    # hits carry two hashes of their file; summed within each row first, as rows of the same text count once
    key = [F.xxhash64(F.lit(n), *[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in file]).alias(f"k{n}") for n in (1, 2)]
    rows = parts.where(F.size("digests") > 0).withColumn("row", F.monotonically_increasing_id()).select(*key, "chunk", "row", F.arrays_zip("digests", "lengths").alias("x"))
    hits = rows.select("k1", "k2", "chunk", "row", F.explode("x").alias("x")).select("k1", "k2", "chunk", "row", F.col("x.digests").alias("digest"), F.col("x.lengths").alias("length"))
    met = hits.join(broadcast_below(lib, n_lib, 16), "digest").groupBy("k1", "k2", "chunk", "row", "lib_file_id").agg(F.sum("length").alias("length"))
    once = met.groupBy("k1", "k2", "chunk", "lib_file_id").agg(F.max("length").alias("length"))
    shared = once.groupBy("k1", "k2", "lib_file_id").agg(F.sum("length").alias("shared"))
    best = shared.groupBy("k1", "k2").agg(F.max("shared").alias("shared"), F.max_by("lib_file_id", F.struct("shared", "lib_file_id")).alias("lib_file_id"))
    joined = per_file.withColumns({f"k{n}": k for n, k in zip((1, 2), key)}).join(best, ["k1", "k2"], "left")

    p = normal_path(F.col("file_path"))
    copied = F.coalesce(F.try_divide("shared", "words"), F.lit(0.0))
    copy = F.coalesce(F.col("shared") / (F.col("words") + FEW_WORDS), F.lit(0.0)) >= COPIED
    literal = F.coalesce(F.try_divide("literal", "code"), F.lit(0.0))
    uniformity = F.greatest(F.lit(0.0), F.coalesce(1 - F.try_divide(F.col("distinct") + FEW_SHAPES, F.col("statements")), F.lit(0.0)))
    vendored = F.when(copy, "copy").when(F.col("others"), "header").when(p.rlike(_VENDORED_PATH), "path")
    generated = F.when(uniformity >= UNIFORMITY, "uniformity").when(F.col("header"), "header").when(p.rlike(_GENERATED_PATH), "path")
    dense = (F.col("density") >= DENSITY) & (literal < LITERALS)
    minified = F.when((F.col("expansion") >= EXPANSION) | dense, "layout").when(p.rlike(_MINIFIED_PATH), "path")
    data = F.when((F.col("literal") / (F.col("code") + FEW_CHARS) >= LITERALS) & ~F.col("format"), "literals")
    kind = F.when(vendored.isNotNull(), "vendored").when(data.isNotNull(), "data").when(minified.isNotNull(), "minified").when(generated.isNotNull(), "generated")
    return joined.select("repo", "file_path", kind.alias("kind"), F.coalesce(vendored, data, minified, generated).alias("evidence"), F.col("expansion"), literal.alias("literal_share"), uniformity.alias("uniformity"), copied.alias("copied_share"), F.when(copy, F.col("lib_file_id")).alias("lib_file_id"))


def found(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """repo, file_path of the files that nobody wrote by hand."""
    return provenance(files, libraries).where("kind IS NOT NULL").select("repo", "file_path")


def hand_written(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """The rows of ``files`` whose file is hand-written, with all their columns."""
    gone = found(files, libraries).toDF("_repo", "_path")
    return files.join(gone, files["repo"].eqNullSafe(gone["_repo"]) & files["file_path"].eqNullSafe(gone["_path"]), "left_anti")
