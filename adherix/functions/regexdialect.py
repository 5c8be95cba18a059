"""Patterns written once, in the form that Java takes and means the same in other dialects."""

from __future__ import annotations

import re

#: Unix lines and Unicode classes, as a pattern in Python's dialect means them.
BASE = "dU"
_PIECE = re.compile(r"\\.|\[[^\]]*\]|\(\?[^)]*\)|[()|?*+{}.^$]|[^\\\[()|?*+{}.^$]+")


def java(pattern: str, flags: str = "") -> str:
    """The pattern with its flags (of i, m, s) for Java."""
    return f"(?{BASE}{flags}){pattern}"


def from_start(pattern: str, flags: str = "") -> str:
    """The pattern anchored where a match from the start begins."""
    return f"(?{BASE}{flags})\\A(?:{pattern})"


def duck(pattern: str, flags: str = "") -> str:
    """The pattern with its flags for DuckDB."""
    return f"(?{flags}){pattern}" if flags else pattern


def _literals(branch: str, least: int) -> list[str]:
    pieces, depth, out = _PIECE.findall(branch), 0, []
    for i, p in enumerate(pieces):
        depth += (p == "(") - (p == ")")
        if depth or not re.fullmatch(r"[\w\- @/<=]+", p):
            continue
        after = pieces[i + 1][:1] if i + 1 < len(pieces) else ""
        lit = p[:-1] if after and after in "?*{" else p
        if len(lit) >= least:
            out.append(lit)
    return out


def needles(pattern: str, least: int = 3) -> list[list[str]] | None:
    """Literals of which every match holds all of one list; None if some branch of the pattern has none to see.

    Branches are those of alternatives outside of groups.
    """
    if "(?" in pattern:
        return None
    branches, depth = [""], 0
    for p in _PIECE.findall(pattern):
        depth += (p == "(") - (p == ")")
        if p == "|" and not depth:
            branches.append("")
        else:
            branches[-1] += p
    found = [_literals(b, least) for b in branches]
    return found if all(found) else None


def sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
