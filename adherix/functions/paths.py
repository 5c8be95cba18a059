"""Predicates on paths: what a scan leaves out, and which suffixes an engine looks at."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a path that a scan leaves out, and marks of tests and generated files.
EXCLUDED_NAMES = ("__pycache__", ".git", "node_modules", ".venv", "dist", "build", ".next")
TRAINING_EXCLUDED_NAMES = (*EXCLUDED_NAMES, "coverage", ".pytest_cache")
TEST_MARKS = ("test_", "_test.", ".test.", "spec_", "_spec.", ".spec.")
GENERATED_MARKS = (".generated.", "_generated.", ".d.ts")
# Suffixes by engine; the first four compare the case of letters, training does not.
SUFFIXES = {
    "default": (".ts", ".tsx", ".js", ".jsx"),
    "typescript": (".ts", ".tsx"),
    "adherence": (".ts", ".tsx", ".js", ".jsx", ".py", ".sql", ".md", ".mdx", ".json", ".yml", ".yaml", ".css", ".scss", ".less"),
    "classifier": (".ts", ".tsx", ".js", ".jsx", ".py", ".sql", ".md", ".mdx", ".json", ".yml", ".yaml", ".css", ".scss", ".less", ".html", ".htm", ".tf", ".dockerfile", ".sh", ".env", ".txt"),
    "training": (".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".cpp", ".c", ".h", ".go", ".rs", ".rb", ".php", ".cs", ".sql"),
}
# Code files that may be compared with each other.
COMPARABLE = (".ts", ".tsx", ".js", ".jsx", ".py")


def pattern(parts: tuple[str, ...]) -> str:
    """A regular expression that finds any of the parts."""
    return "|".join(re.escape(x) for x in parts)


def left_out(path: str, tests: bool = False, generated: bool = False) -> bool:
    """Whether a scan leaves a path out; test and generated files are kept only where asked for."""
    return any(x in path for x in EXCLUDED_NAMES) or not tests and any(x in path.lower() for x in TEST_MARKS) or not generated and any(x in path for x in GENERATED_MARKS)


def excluded(path: Column, tests: bool = False, generated: bool = False, names: tuple[str, ...] = EXCLUDED_NAMES) -> Column:
    """``left_out`` as a column; a null path is kept."""
    out = F.rlike(path, F.lit(pattern(names)))
    if not tests:
        out = out | F.rlike(F.lower(path), F.lit(pattern(TEST_MARKS)))
    if not generated:
        out = out | F.rlike(path, F.lit(pattern(GENERATED_MARKS)))
    return F.coalesce(out, F.lit(False))


def suffix(path: Column) -> Column:
    """The last suffix of the name with its dot; empty where the only dot leads."""
    return F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1)


def in_scope(path: Column, engine: str) -> Column:
    """Whether an engine looks at files of this suffix."""
    s = suffix(F.lower(path) if engine == "training" else path)
    return s.isin(*SUFFIXES[engine])


def compatible(a: Column, b: Column) -> Column:
    """Whether two paths may be compared: the same suffix, or code with code."""
    x, y = suffix(a), suffix(b)
    return (x == y) | (x.isin(*COMPARABLE) & y.isin(*COMPARABLE))
