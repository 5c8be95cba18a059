"""Problem 4: source files that do not parse.

Each chunk is cut into pieces of whole lines, and each piece becomes a lexer-state
map: for every state in which it may be entered, the state in which it is left and the
summary of its unmatched brackets.  Spark brings the maps of a chunk together by key and
composes them in order; a chunk whose composed map does not lead from code to code with
all brackets matched is not valid.  This holds for Python, Java and Go, whose lexers need
no grammar; JavaScript's does, for markup, regular expressions and nested templates, so
its brackets are matched where its statements are parsed.  The statements of every chunk
are parsed as class strings with the local grammars in ``grammar``; a statement whose
class string was accepted before is not parsed again in the same task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adherix.llm.grammar import go, java, python, script, states
from adherix.session import broadcast_below, cut, spread

# Languages by suffix.
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "java": "java", "go": "go"}

#: Characters of a piece, at least; it ends with the line.
PIECE = 4096
#: Languages whose pieces have lexer-state maps.
MAPPED = ("py", "java", "go")


def suffix(path: Column) -> Column:
    """The suffix in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def why_invalid(text: str, kind: str, method: bool) -> str | None:
    """Why a chunk is no valid syntax for the suffix ``kind``; None if it is valid."""
    if kind in ("java", "go") and len(text) > 2 * PIECE and not states.balanced(text.replace("\r\n", "\n"), kind, PIECE):
        return "not balanced"  # told before any statement of a long text is parsed
    if kind == "py":
        return python.check(text, method)
    if kind == "java":
        return java.check(text, method)
    if kind == "go":
        return go.check(text)
    return script.check(text, method, kind in ("ts", "tsx"), kind in ("jsx", "tsx"))


def _maps(text: str, kind: str) -> list[tuple[list[int], list[str], list[str]]]:
    """Of each piece the exit state, closing and opening brackets for each entry state; exit -1 where brackets cross."""
    names = states.states(kind)
    out = []
    for i, piece in enumerate(states.pieces(text.replace("\r\n", "\n").replace("\r", "\n"), PIECE)):
        ends = [states.run(piece, kind, s) for s in names[: 1 if i == 0 else None]]  # the first piece is entered in code
        out.append(([names.index(e[0]) if e else -1 for e in ends], [e[1] if e else "" for e in ends], [e[2] if e else "" for e in ends]))
    return out


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per chunk with the verdict of its statements, and rows for the maps of its pieces under the chunk's key."""
    sys.setrecursionlimit(6000)
    for b in batches:
        rows = []
        for repo, path, chunk, key, kind, method, text in zip(b["repo"], b["file_path"], b["chunk_id"], b["key"], b["kind"], b["is_method"], b["function_code"]):
            rows.append((key, repo, path, chunk, kind, why_invalid(text, kind, bool(method)), None, None, None, None))
            if kind in MAPPED:
                rows += [(key, None, None, None, None, None, n, *m) for n, m in enumerate(_maps(text, kind))]
        out = pd.DataFrame(rows, columns=["key", "repo", "file_path", "chunk_id", "kind", "reason", "piece", "exits", "closing", "opening"])
        yield out.astype({"chunk_id": "Int64", "piece": "Int32"})


def _compose(a: Column, m: Column) -> Column:
    """The state and unmatched brackets after one more piece (brackets that meet must fit)."""
    at = a["at"]
    closing, opening, end = F.get(m["closing"], at), F.get(m["opening"], at), F.get(m["exits"], at)
    n = F.least(F.length(a["opening"]), F.length(closing))
    kept = F.length(a["opening"]) - n
    fits = F.translate(F.substring(closing, F.lit(1), n), ")]}", "([{") == F.reverse(F.substring(a["opening"], kept + 1, n))
    return F.struct(
        F.greatest(end, F.lit(0)).alias("at"), F.concat(a["closing"], F.substring(closing, n + 1, F.length(closing))).alias("closing"),
        F.concat(F.substring(a["opening"], F.lit(1), kept), opening).alias("opening"), (a["bad"] | (end < 0) | ~fits).alias("bad"),
    )


def unbalanced(pieces: DataFrame) -> DataFrame:
    """key of the chunks whose composed map does not lead from code to code with all brackets matched.

    Repeated rows have the same key and the same pieces, which count once.
    """
    chunk = pieces.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("piece", "exits", "closing", "opening"))).alias("maps"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("closing"), F.lit("").alias("opening"), F.lit(False).alias("bad"))
    end = F.aggregate("maps", start, _compose)
    return chunk.select("key", end.alias("end")).where("end.bad OR end.at <> 0 OR end.closing <> '' OR end.opening <> ''").select("key")


def judged(chunks: DataFrame) -> DataFrame:
    """repo, file_path, chunk_id, kind, reason: every chunk with code in a known language; reason is null where it is valid.

    Null and empty code is no case and gives no row; a null is_method counts as
    false; suffixes of other languages give no row.  Code nested too deeply for the
    parser's stack is judged by its maps alone.
    """
    known = chunks.select("repo", "file_path", "chunk_id", suffix(F.col("file_path")).alias("kind"), F.coalesce("is_method", F.lit(False)).alias("is_method"), "function_code")
    texts = known.where(F.col("kind").isin(*LANGUAGES) & (F.length("function_code") > 0)).withColumn("key", F.xxhash64("kind", "function_code"))
    schema = "key long, repo string, file_path string, chunk_id long, kind string, reason string, piece int, exits array<int>, closing array<string>, opening array<string>"
    read = cut(spread(texts).mapInPandas(_judge, schema))
    open_ = cut(unbalanced(read.where("piece IS NOT NULL").select("key", "piece", "exits", "closing", "opening")))
    verdicts = read.where("piece IS NULL").select("key", "repo", "file_path", "chunk_id", "kind", "reason")
    told = verdicts.join(broadcast_below(open_.withColumn("open", F.lit(True)), open_.count(), 16), "key", "left")
    return told.select("repo", "file_path", "chunk_id", "kind", F.coalesce("reason", F.when(F.col("open"), "not balanced")).alias("reason"))


def invalid_files(chunks: DataFrame) -> DataFrame:
    """repo, file_path, invalid_chunks, reason: files with at least one chunk that is not valid; repeated rows count once."""
    bad = judged(chunks).where("reason IS NOT NULL").groupBy("repo", "file_path", "chunk_id").agg(F.min("reason").alias("reason"))
    return bad.groupBy("repo", "file_path").agg(F.count("*").alias("invalid_chunks"), F.min("reason").alias("reason"))


def found(chunks: DataFrame) -> DataFrame:
    """repo, file_path."""
    return invalid_files(chunks).select("repo", "file_path")


def rates(chunks: DataFrame) -> DataFrame:
    """Per repo and language: files, invalid files and their share; files without code count as valid."""
    bad = found(chunks).withColumn("bad", F.lit(1))
    kind = suffix(F.col("file_path"))
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    files = chunks.select("repo", "file_path").where(kind.isin(*LANGUAGES)).distinct()
    key = files["repo"].eqNullSafe(bad["repo"]) & files["file_path"].eqNullSafe(bad["file_path"])
    each = files.join(bad, key, "left").select(files["repo"], names[suffix(files["file_path"])].alias("language"), "bad")
    total = each.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count("bad").alias("invalid_files"))
    return total.withColumn("share", F.col("invalid_files") / F.col("files"))


def valid_rows(chunks: DataFrame) -> DataFrame:
    """The rows of the files without an invalid chunk, with all their columns."""
    gone = found(chunks).toDF("_repo", "_path")
    return chunks.join(gone, chunks["repo"].eqNullSafe(gone["_repo"]) & chunks["file_path"].eqNullSafe(gone["_path"]), "left_anti")
