"""What the grammars share: token classes, bracket summaries and a cursor over a class string.

A token is one character of a class string: each keyword and punctuator has a
character of its own, other tokens have the character of their kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

IDENT, NUMBER, STRING, TEMPLATE, REGEX, MARKUP, BAD = "i", "0", "s", "t", "r", "J", "\x01"
OPEN, CLOSE = "([{", ")]}"
_PAIR = dict(zip(CLOSE, OPEN))


class Invalid(Exception):
    """The text is no sentence of the language."""


class Classes(dict):
    """Token text to its class; spellings seen are kept, in bounded number."""

    def __init__(self, symbols: Iterable[str]) -> None:
        super().__init__()
        self.symbol: dict[str, str] = {}
        for x in symbols:
            self.symbol[x] = x if len(x) == 1 and not x.isalnum() else chr(0x100 + len(self.symbol))
        self.symbol["\n"] = "\n"
        self.update(self.symbol)

    def __missing__(self, token: str) -> str:
        c = token[0]
        if c.isalpha() or c in "_$#@" or c > "\x7f" and c.isidentifier():
            got = IDENT if c not in "#@" or len(token) > 1 else BAD
        elif c.isdigit() or c == "." and len(token) > 1:
            got = NUMBER
        elif c in "\"'":
            got = STRING if len(token) > 1 else BAD
        elif c == "`":
            got = TEMPLATE if len(token) > 1 else BAD
        else:
            got = BAD
        if len(self) > 200_000:
            self.clear()
            self.update(self.symbol)
        self[token] = got
        return got


def summary(classes: str) -> tuple[str, str]:
    """Unmatched closing and opening brackets of a piece of a class string; raises if a pair does not fit.

    Summaries of consecutive pieces are joined by ``join``, in any grouping.
    """
    stack: list[str] = []
    closing: list[str] = []
    for m in re.finditer(r"[()\[\]{}]", classes):
        c = m[0]
        if c in OPEN:
            stack.append(c)
        elif not stack:
            closing.append(c)
        elif stack.pop() != _PAIR[c]:
            raise Invalid("brackets cross")
    return "".join(closing), "".join(stack)


def join(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    """The summary of two consecutive pieces (associative)."""
    opened, closed = a[1], b[0]
    n = min(len(opened), len(closed))
    for o, c in zip(reversed(opened[len(opened) - n :]), closed):
        if _PAIR[c] != o:
            raise Invalid("brackets cross")
    return a[0] + closed[n:], opened[: len(opened) - n] + b[1]


def partners(classes: str) -> dict[int, int]:
    """Position of each opening bracket to that of its closing one; raises if the text is not balanced."""
    stack: list[int] = []
    found: dict[int, int] = {}
    for m in re.finditer(r"[()\[\]{}]", classes):
        c, at = m[0], m.start()
        if c in OPEN:
            stack.append(at)
        elif not stack or classes[stack[-1]] != _PAIR[c]:
            raise Invalid("unmatched bracket")
        else:
            found[stack.pop()] = at
    if stack:
        raise Invalid("bracket never closed")
    return found


class Cursor:
    """A position in a class string that ends with the character NUL."""

    def __init__(self, classes: str) -> None:
        self.s = classes + "\0"
        self.p = 0
        self.match = partners(classes)

    def take(self, c: str) -> None:
        if self.s[self.p] != c:
            raise Invalid(f"expected {c!r} at {self.p}")
        self.p += 1

    def eat(self, c: str) -> bool:
        if self.s[self.p] == c:
            self.p += 1
            return True
        return False

    def attempt(self, f, *args) -> bool:
        """Whether ``f`` succeeds here; the position stays if not."""
        at = self.p
        try:
            f(*args)
        except Invalid:
            self.p = at
            return False
        return True
