"""Python 3: line structure and brackets first, then the interpreter's own parser on balanced top-level blocks."""

from __future__ import annotations

import ast
import re
import warnings

#: What a top-level line may begin with and still belong to the block before.
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]")
_SPECIAL = re.compile(r"[rbuftRBUFT]{0,3}(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|#[^\n]*|[()\[\]{}]|\n(?=[^\s#])|\\\n|[\"']")
_PAIR = {")": "(", "]": "[", "}": "{"}


def blocks(text: str) -> list[str] | None:
    """The text cut at its top-level statements; None if brackets cross or a string stays open."""
    cut, stack, carry = [0], [], 0
    for m in _SPECIAL.finditer(text):
        t = m[0]
        if t in "([{":
            stack.append(t)
        elif t in ")]}":
            if not stack or stack.pop() != _PAIR[t]:
                return None
        elif t == "\n":
            if not stack and not _GOES_ON.match(text, m.end()):
                carry = text[cut[-1] : cut[-1] + 1] == "@"
                if not (carry and not re.search(r"^(?:async\s+def|def|class)\b", text[cut[-1] : m.end()], re.M)):
                    cut.append(m.end())
        elif t in "\"'":
            return None
    return None if stack else [text[a:b] for a, b in zip(cut, [*cut[1:], len(text)])]


def _parses(source: str) -> str | None:
    try:
        ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return str(e)[:60]
    except (RecursionError, MemoryError):
        return None
    return None


def _lead(text: str) -> str:
    """The indentation that the first line of a method lost: that of a line after a decorator, else half of its body's."""
    m = re.match(r"(@)?[^\n]*(?:\n\s*)*?\n([ \t]+)\S", text)
    if m is None:
        return "    "
    if m[1]:
        return m[2]
    head = re.match(r"(?:async\s+)?def\b[^\n]*:\s*(?:#[^\n]*)?\n(?:\s*\n)*([ \t]+)", text)
    return head[1][: len(head[1]) // 2] or " " if head else "    "


def check(text: str, method: bool) -> str | None:
    """Why the text is invalid as a module or, if ``method``, in a class body; None if it is valid."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        return "null character"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        if method:
            if _parses(f"class _:\n{_lead(text)}{text}") is None:
                return None
        parts = blocks(text)
        if parts is None:  # told by the exact parser, which knows every form of string
            return _parses(text)
        for part in parts:
            why = _parses(part)
            if why is not None:
                return _parses(text)
    return None
