"""Lexer-state maps: what a piece of a text does to the state of the lexer, whatever that state is.

A piece is a run of whole lines.  Its map gives, for every state in which it may be
entered, the state in which it is left and the bracket summary of the code in it.
Maps of consecutive pieces are joined by ``compose``, which is associative, so a text
of any length can be cut anywhere between lines and reduced in any grouping.
"""

from __future__ import annotations

import re
from functools import reduce

from adherix.llm.grammar.base import Invalid, join

# How texts other than code begin and end, per language; a state is the mark that opened it.
_LONG = {"java": ('"""',), "go": ("`",), "py": ('"""', "'''")}
_OPEN = {
    "java": re.compile(r"\"\"\"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|//[^\n]*|/\*|[()\[\]{}]"),
    "go": re.compile(r"`|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|//[^\n]*|/\*|[()\[\]{}]"),
    "py": re.compile(r"\"\"\"|'''|\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'|#[^\n]*|[()\[\]{}]"),
}
_CLOSE = {'"""': re.compile(r"(?:\\[\s\S]|[^\\])*?\"\"\""), "'''": re.compile(r"(?:\\[\s\S]|[^\\])*?'''"), "`": re.compile(r"[^`]*`"), "/*": re.compile(r"[\s\S]*?\*/")}
CODE = ""

#: state -> (state, closing brackets, opening brackets), or None where brackets cross
Map = dict[str, tuple[str, str, str] | None]


def states(kind: str) -> tuple[str, ...]:
    return (CODE, *_LONG[kind], *(() if kind == "py" else ("/*",)))


def run(text: str, kind: str, state: str) -> tuple[str, str, str] | None:
    """State, closing and opening brackets after a piece entered in ``state``; None where brackets cross."""
    at, brackets = 0, []
    long_marks = states(kind)
    while True:
        if state:
            m = _CLOSE[state].match(text, at)
            if m is None:
                break
            at, state = m.end(), CODE
        m = _OPEN[kind].search(text, at)
        if m is None:
            break
        at = m.end()
        if m[0] in long_marks:
            state = m[0]
        elif m[0] in "()[]{}":
            brackets.append(m[0])
    try:
        closing, opening = reduce(join, [(b, "") if b in ")]}" else ("", b) for b in brackets], ("", ""))
    except Invalid:
        return None
    return state, closing, opening


def piece_map(text: str, kind: str) -> Map:
    """The map of a piece of whole lines."""
    return {s: run(text, kind, s) for s in states(kind)}


def compose(a: Map, b: Map) -> Map:
    """The map of two consecutive pieces."""
    out: Map = {}
    for s, first in a.items():
        second = b[first[0]] if first else None
        if second is None:
            out[s] = None
            continue
        try:
            out[s] = (second[0], *join(first[1:], second[1:]))
        except Invalid:
            out[s] = None
    return out


def pieces(text: str, size: int) -> list[str]:
    """The text cut at line ends into pieces of at least ``size`` characters."""
    out, begin = [], 0
    while len(text) - begin > size:
        end = text.find("\n", begin + size) + 1
        while end and text.endswith("\\\n", begin, end):  # a line that goes on
            end = text.find("\n", end) + 1
        if not end:
            break
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]]


def balanced(text: str, kind: str, size: int = 8192) -> bool:
    """Whether a text ends in code with all its brackets matched, by reducing the maps of its pieces."""
    end = reduce(compose, [piece_map(p, kind) for p in pieces(text, size)])[CODE]
    return end == (CODE, "", "")
