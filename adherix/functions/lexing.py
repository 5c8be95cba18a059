"""The outline of a source text: what is code, which brackets belong together, which literals hold data."""

from __future__ import annotations

import re
from typing import NamedTuple

_STRINGS = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
_PYTHON = re.compile(r"(?P<string>\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*+'''|" + _STRINGS + r")|(?P<other>#[^\n]*)")
_BRACES = re.compile(r"(?P<string>\"\"\"[\s\S]*?\"\"\"|" + _STRINGS + r"|`(?:[^`\\]|\\[\s\S])*+`)|(?P<other>//[^\n]*|/\*[\s\S]*?\*/|(?<=[=(,:\[!&|?{};])[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/)")
_PARTNER = {")": "(", "]": "[", "}": "{"}


class Outline(NamedTuple):
    #: The text with strings, comments and regular expressions blanked, of the same length.
    code: str
    #: Begin and end of the strings.
    strings: list[tuple[int, int]]
    #: Position of each opening bracket to that of its closing one; unmatched ones are absent.
    pairs: dict[int, int]


def outline(text: str, kind: str) -> Outline:
    """The outline of a text; ``kind`` is its suffix without the dot.  Unknown suffixes are read like those with braces."""
    strings, parts, at = [], [], 0
    for m in (_PYTHON if kind == "py" else _BRACES).finditer(text):
        if m["string"] is not None:
            strings.append(m.span())
        parts += [text[at : m.start()], re.sub(r"[^\n]", " ", m[0])]
        at = m.end()
    code = "".join([*parts, text[at:]])
    pairs, stack = {}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m[0]
        if c in "([{":
            stack.append(m.start())
        elif stack and code[stack[-1]] == _PARTNER[c]:
            pairs[stack.pop()] = m.start()
    return Outline(code, strings, pairs)


def data_spans(text: str, kind: str) -> list[tuple[int, int]]:
    """Begin and end of the outermost data literals: strings, arrays and objects that stand where a value does."""
    o, found, end = outline(text, kind), [], 0
    marks = [(b, e) for b, e in o.strings] + [(b, e + 1) for b, e in o.pairs.items() if text[b] in "[{" and _is_value(o.code, b, kind)]
    for b, e in sorted(marks, key=lambda x: (x[0], -x[1])):
        if b >= end:
            found.append((b, e))
            end = e
    return found


def _is_value(code: str, at: int, kind: str) -> bool:
    """Whether a bracket opens a literal: it follows an operator, not a name, an index or the head of a block."""
    before = code[max(0, at - 200) : at].rstrip()  # a few words are looked at
    if not before:
        return code[at] == "["
    if kind == "go" and code[at] == "{" and code[at - 1] not in " \t\n" and (before[-1].isalnum() or before[-1] in "_}"):
        return True
    if kind == "java" and code[at] == "{" and before[-1] == "]":
        return True
    return before[-1] in "=(,:[?+|&" or before.endswith("return") or code[at] == "[" and before[-1] in "{;>"
