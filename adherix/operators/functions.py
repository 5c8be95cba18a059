"""Functions of files: chunks of a file, token budget and data-heavy code."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adherix.functions.lexing import data_spans, outline

CHUNKS = "file_id long, path string, function_name string, is_method boolean, code string, start_line int, end_line int"


# Words before a bracket that make no function, and how functions are declared, per family of languages.
_CONTROL = {"if", "for", "while", "switch", "catch", "function", "return", "with", "synchronized", "try", "do", "else", "new", "super", "this"}
_SCRIPT = re.compile(
    r"(?P<function>(?:\basync\s+)?\bfunction\b\s*+\*?\s*+(?P<name>[\w$]*+)\s*+(?:<[^()]*?>\s*+)?(?=\())"
    r"|\b(?:const|let|var)\s++(?P<arrow>(?P<bound>[\w$]++)\s*+(?::[^=;]*?)?=\s*+(?:async\b\s*+)?(?:<[^()=]*?>\s*+)?(?:(?=\()|[\w$]++\s*+(?==>)))"
    r"|(?:^|[{};,])[ \t]*+(?P<method>(?:(?:public|private|protected|static|override|readonly|async|get|set)\s++)*\*?\s*+(?P<member>#?[\w$]++)\s*+(?:<[^()]*?>\s*+)?(?=\())",
    re.M,
)
_GO = re.compile(r"^func\s+(?P<receiver>\([^)\n]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]\n]*\])?(?=\()", re.M)
_JAVA = re.compile(r"(?<=[\w>\]])\s+(?P<name>[\w$]+)\s*(?=\()")


def _body(code: str, pairs: dict[int, int], at: int, arrow: bool) -> int | None:
    """End of the body that follows the parameters closed before ``at``; None where there is none."""
    m = re.compile(r"\s*(?::|throws\b|(?=[\w*\[(]))?").match(code, at)
    at = m.end()
    while at < len(code):
        c = code[at]
        if arrow and code.startswith("=>", at):
            at = re.compile(r"=>\s*").match(code, at).end()
            if code[at : at + 1] == "{":
                return pairs.get(at, len(code) - 1) + 1
            while at < len(code) and code[at] not in ";)]},\n":
                at = pairs.get(at, at) + 1
            return at
        if c == "{":
            end = pairs.get(at)
            if end is None:
                return None
            # braces of a type: more of the type, the arrow or the body follows
            if not re.search(r"\b(?:interface|struct)\s*$", code[max(0, at - 20) : at]) and not re.compile(r"\s*(?:[{|&\[]|=>)").match(code, end + 1) and not arrow:
                return end + 1
            at = end + 1
        elif c in "([" and at in pairs:
            at = pairs[at] + 1
        elif c in ";)]}=" and not (c == "=" and code.startswith("=>", at)):
            return None
        else:
            at += 1
    return None


def _declared(text: str, kind: str) -> Iterator[tuple[str, bool, int, int]]:
    """name, whether it is a method, begin and end of the functions of a text in JavaScript, TypeScript, Go or Java."""
    o = outline(text, kind)
    code, pairs = o.code, o.pairs
    for m in (_GO if kind == "go" else _JAVA if kind == "java" else _SCRIPT).finditer(code):
        g, at = m.groupdict(), m.end()
        arrow, begin = bool(g.get("arrow")), m.start()
        if kind == "go":
            name, method = m["name"], bool(m["receiver"])
        elif kind == "java":
            name, method = m["name"], True
            begin = max(code.rfind(x, 0, m.start()) for x in ";{}") + 1
            begin += len(code[begin : m.end()]) - len(code[begin : m.end()].lstrip())
            if name in _CONTROL or re.search(r"\b(?:new|return|else|throw|case)$", code[begin : m.start()].rstrip()) or re.search(r"[=(]", re.sub(r"@[\w.]+\s*(?:\([^)]*\))?", "", code[begin : m.start()])):
                continue
        else:
            part = next(x for x in ("function", "arrow", "method") if g[x] is not None)
            name, method, begin = g["name"] or g["bound"] or g["member"] or "", part == "method", m.start(part)
            if part == "method" and (name in _CONTROL or name == "function"):
                continue
        if code[at : at + 1] == "(":
            if at not in pairs:
                continue
            at = pairs[at] + 1
        end = _body(code, pairs, at, arrow)
        if end is not None:
            yield name or f"func_line_{text.count(chr(10), 0, begin) + 1}", method, begin, end


def _python(text: str) -> Iterator[tuple[str, bool, int, int]]:
    """name, whether it is a method, first and last line of the functions of a Python text, those of branches and functions included."""
    todo = [(ast.parse(text), False)]
    while todo:
        node, inside = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                yield child.name, inside, child.lineno, child.end_lineno
                todo.append((child, False))
            elif isinstance(child, ast.ClassDef):
                todo.append((child, True))
            elif isinstance(child, ast.stmt | ast.ExceptHandler | ast.match_case):
                todo.append((child, inside))


def functions_of(text: str, kind: str) -> list[tuple[str, bool, str, int, int]]:
    """name, is_method, code, first and last line of the functions of a text in their order; empty where none is found."""
    if kind == "py":
        lines = text.split("\n")
        try:
            found = [(n, m, "\n".join(lines[a - 1 : b]), a, b) for n, m, a, b in _python(text)]
        except (SyntaxError, ValueError, RecursionError):
            return []
    elif kind in ("js", "jsx", "ts", "tsx", "go", "java"):
        found = [(n, m, text[a:b], text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 1) for n, m, a, b in _declared(text, kind)]
    else:
        return []
    once = {(x[0], x[3]): x for x in sorted(found, key=lambda x: not x[1])}  # a function before a method of its name and line
    return sorted(once.values(), key=lambda x: (x[3], x[4], x[0]))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, path, text in zip(b["file_id"], b["path"], b["content"]):
            stem, _, kind = path.replace("\\", "/").rsplit("/", 1)[-1].rpartition(".")
            found = functions_of(text, kind.lower())
            rows += [(key, path, *x) for x in found] or [(key, path, f"file_{stem or kind}", False, text, 1, text.count("\n") + 1)]
        yield pd.DataFrame(rows, columns=["file_id", "path", "function_name", "is_method", "code", "start_line", "end_line"])


def extract_functions(files: DataFrame) -> DataFrame:
    """The functions and methods of files in Python, JavaScript, TypeScript, Go and Java.

    Any other file, one without functions and Python that does not parse are one chunk named after the file.
    Functions without a name are called after their line.
    """
    return files.select("file_id", "path", "content").mapInPandas(_extract, CHUNKS)


def within_budget(chunks: DataFrame, code: str, imports: str, most: int = 2048) -> DataFrame:
    """The text to embed: imports and code where they fit ``most`` tokens, else the code alone; chunks that never fit are left out.

    Tokens are counted as words and marks, an upper bound within the JVM.
    """

    def tokens(c: Column) -> Column:
        return F.regexp_count(c, F.lit(r"\w+|[^\w\s]"))

    whole = F.concat_ws("\n\n", F.when(F.trim(imports) != "", F.col(imports)), F.col(code))
    text = F.when(tokens(whole) <= most, whole).when(tokens(F.col(code)) <= most, F.col(code))
    return chunks.withColumn("snippet", text).where("snippet IS NOT NULL")


def data_share(code: Column) -> Column:
    """Share of the bytes of a text that stand in string literals."""
    # possessive, so that Java matches long literals in a loop and not by recursion
    strings = F.regexp_extract_all(code, F.lit(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`"), F.lit(0))
    size = F.aggregate(strings, F.lit(0), lambda a, x: a + F.octet_length(x))
    return F.coalesce(F.try_divide(size, F.octet_length(code)), F.lit(0.0))


def placeholder(literal: str, items: int = 5) -> str:
    """A long literal in short: a string by its delimiters, an array by its first ``items`` items, an object by its braces."""
    first = literal[0]
    if literal[:3] in ('"""', "'''"):
        return literal[:3] + "..." + literal[:3]
    if first in "\"'`":
        return first + "..." + first
    if first == "[":
        parts = [x for x in (y.strip() for y in literal[1:-1].split(",")) if x]
        return "[" + ", ".join(parts[:items]) + ", /* ... */]" if len(parts) > items else literal
    return "{/* ... */}"


def compress(code: Column, kind: Column | None = None, share: float = 0.7, least_bytes: int = 1000, longest: int = 100, items: int = 5) -> Column:
    """Data-heavy text with its outermost literals of more than ``longest`` bytes in short; other text as it is.

    Heavy is a text of which literals make up more than ``share`` and at least
    ``least_bytes`` bytes.  ``kind`` is the suffix of the file; null text stays null.
    """

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        def one(text: str | None, k: str) -> str | None:
            if text is None or len(text.encode()) < least_bytes:
                return text
            spans = data_spans(text, k)
            sizes = [len(text[b:e].encode()) for b, e in spans]
            if sum(sizes) < least_bytes or sum(sizes) <= share * len(text.encode()):
                return text
            out, at = [], 0
            for (b, e), n in zip(spans, sizes):
                if n > longest:
                    out += [text[at:b], placeholder(text[b:e], items)]
                    at = e
            return "".join([*out, text[at:]])

        return pd.Series([one(t, k) for t, k in zip(texts, kinds)], dtype=object)

    return shorten(code, F.coalesce(kind, F.lit("")) if kind is not None else F.lit(""))
