"""JavaScript and TypeScript, with and without markup."""

from __future__ import annotations

import re

from adherix.llm.grammar.base import BAD, IDENT, MARKUP, NUMBER, REGEX, STRING, TEMPLATE, Classes, Cursor, Invalid

# The words and marks of the language.
RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield null true false enum await".split()
CONTEXTUAL = "async of get set static let type interface namespace module declare abstract readonly as satisfies is keyof infer from implements private public protected override accessor unique asserts global require out".split()
MARKS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #".split()
CLS = Classes(RESERVED + CONTEXTUAL + [m for m in MARKS if m != "#"])
K = CLS.symbol

_REGEX = r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_NUM = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])"
_NAME = r"#?[^\W\d][\w$]*|#?\$[\w$]*"
_STR = r"\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_HOLE = r"\$\{(?:[^{}`'\"/]|\"[^\"\n]*\"|'[^'\n]*'|/(?![/*])|\{[^{}`'\"]*\})*\}"
_TPL = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|{_HOLE})*`"
_MARK = "|".join(re.escape(m) for m in MARKS if m not in (">>", ">>>", ">=", ">>=", ">>>="))
LEX = re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|\n|(?:[(,=:\[!&|?{{;+\-*%~^<>]|\breturn|\btypeof|\bcase)[ \t]*(?:\r?\n[ \t]*)?{_REGEX}|{_NAME}|{_NUM}|{_STR}|{_TPL}|{_MARK}|\S")
_OPENING = re.compile(r"[(,=:\[!&|?{;+\-*%~^<>]|return|typeof|case")
_HOLES = re.compile(_HOLE)
_SIMPLE_HOLE = re.compile(r"\$\{\s*[\w$]+(?:\??\.[\w$]+)*\s*\}")
_TAG = re.compile(r"<\s*(?P<close>/)?\s*(?P<name>[\w$]+(?:[.:\-][\w$]+)*)?")
_ATTR = re.compile(r"\s*(?:(?P<name>[\w$]+(?:[:\-][\w$\-]+)*)(?:\s*=\s*(?P<value>\"[^\"]*\"|'[^']*'|\{|<))?|(?P<spread>\{)|(?P<end>/?\s*>))")
_TEXT = re.compile(r"[^<{}>]*")

_STARTS = set(K[x] for x in "( , = : [ ! & | ? { } ; + - * % ~ ^ && || ?? => == === != !== += -= return typeof case default in of do else await void delete ...".split() if x in K) | {"\0"}
_WORDS = set(K[x] for x in RESERVED + CONTEXTUAL)
_IDENTS = {IDENT} | {K[x] for x in CONTEXTUAL} | {K["await"], K["yield"]}
_ASSIGN = {K[x] for x in "= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()}
_BINARY = {K[x] for x in "== != === !== <= && || ?? << ** < > + - * / % & | ^ instanceof".split()}
_PREFIX = {K[x] for x in "! ~ + - typeof void delete await ++ --".split()}
_LITERAL = {NUMBER, STRING, REGEX, MARKUP, K["this"], K["super"], K["null"], K["true"], K["false"]}
_MODIFIERS = {K[x] for x in "static readonly private public protected override abstract declare accessor async".split()}
_SIMPLE = re.compile(r"[^;{}\0]{1,120};")
_NEWLINES = re.compile(r"\n")


class Text:
    """A text as class string; ``nl`` holds the positions that a line end precedes."""

    __slots__ = ("classes", "nl")

    def __init__(self, classes: str, nl: set[int]) -> None:
        self.classes, self.nl = classes, nl


def _flat(raw: str) -> Text:
    if "\n" not in raw:
        return Text(raw, set())
    nl, out, at = set(), [], 0
    for part in raw.split("\n"):
        if at or out:
            nl.add(at)
        out.append(part)
        at += len(part)
    return Text("".join(out), nl)


def _token(t: str, ts: bool) -> str:
    """Classes of one lexeme of ``LEX``."""
    c = t[0]
    if c == "/" and len(t) > 1:
        if t[1] == "/":
            return ""
        if t[1] == "*":
            return "\n" if "\n" in t else ""
    if c == "`" and len(t) > 1:
        _holes(t, ts)
        return TEMPLATE
    if len(t) > 2 and t[-1] not in "\"'`" and "/" in t:
        m = _OPENING.match(t)
        if m and t[m.end() :].lstrip()[:1] == "/":
            return CLS[m[0]] + REGEX
    return CLS[t]


def _holes(t: str, ts: bool) -> None:
    if "${" in t:
        for m in _HOLES.finditer(t):
            if not _SIMPLE_HOLE.fullmatch(m[0]):
                expression(m[0][2:-1], ts, False)


_SPECIAL = re.compile(r"/[/*]|`|/")


def lex(text: str, ts: bool, markup: bool) -> Text:
    """The class string of a text; raises Invalid at what no token begins with."""
    if markup and ("</" in text or "/>" in text):
        raw, end = _lex_markup(text, 0, ts, False)
        if end != len(text):
            raise Invalid("closing brace")
    else:
        tokens = LEX.findall(text)
        raw = "".join([CLS[t] if len(t) == 1 or not (t[0] == "/" or t[0] == "`" or t[-1] == "/" or "/" in t) else _token(t, ts) for t in tokens])
    if "`" in text and BAD in raw:
        raw, _ = _lex_markup(text, 0, ts, False, False)
    if BAD in raw:
        raise Invalid("no token")
    return _flat(raw)


def _lex_markup(text: str, at: int, ts: bool, inner: bool, markup: bool = True) -> tuple[str, int]:
    """Token by token from ``at``, with markup elements as one token; ``inner`` ends at the closing brace."""
    out: list[str] = []
    last, depth, n = "\0", 0, len(text)
    match = LEX.match
    while at < n:
        c = text[at]
        if c in " \t\r\f\v ﻿  ":
            at += 1
            continue
        if markup and c == "<" and (last in _STARTS) and re.match(r"<\s*(?:[A-Za-z_$]|>)", text[at : at + 40]) and not re.match(r"<\s*\w+\s*(?:,|extends\b|=[^=>\"'{]*>\s*\()", text[at : at + 60]):
            at = _element(text, at, ts)
            out.append(MARKUP)
            last = MARKUP
            continue
        if c == "`":
            at = _template(text, at, ts, markup)
            out.append(TEMPLATE)
            last = TEMPLATE
            continue
        m = match(text, at)
        if m is None:
            raise Invalid("no token")
        t = m[0]
        got = CLS[t] if len(t) == 1 else _token(t, ts)
        if inner:
            if c == "{" and t == "{" or got[:1] == "{":
                depth += 1
            elif t == "}":
                if not depth:
                    return "".join(out), at
                depth -= 1
        out.append(got)
        if got.strip("\n"):
            last = got[-1]
        at = m.end()
    if inner:
        raise Invalid("brace never closed")
    return "".join(out), at


def _template(text: str, at: int, ts: bool, markup: bool) -> int:
    at += 1
    while at < len(text):
        c = text[at]
        if c == "`":
            return at + 1
        if c == "\\":
            at += 2
        elif c == "$" and text[at + 1 : at + 2] == "{":
            raw, at = _lex_markup(text, at + 2, ts, True, markup)
            _inner(raw, ts, False)
            at += 1
        else:
            at += 1
    raise Invalid("template never closed")


def _inner(raw: str, ts: bool, empty: bool) -> None:
    t = _flat(raw)
    if BAD in t.classes:
        raise Invalid("no token")
    if not t.classes:
        if empty:
            return
        raise Invalid("empty")
    p = Parser(t, ts, True)
    p.eat(K["..."])
    p.expr()
    p.end()


def expression(text: str, ts: bool, markup: bool) -> None:
    """Checks a text that must be one expression."""
    t = lex(text, ts, markup)
    p = Parser(t, ts, markup)
    p.expr()
    p.end()


def _element(text: str, at: int, ts: bool) -> int:
    """The end of the markup element that begins at ``at``; its braces are checked as expressions."""
    names: list[str] = []
    while True:
        m = _TAG.match(text, at)
        if m is None:
            raise Invalid("markup")
        at, name = m.end(), m["name"] or ""
        if m["close"]:
            at = _skip(text, at, ">")
            if not names or names.pop() != name:
                raise Invalid("tags cross")
        else:
            closed = False
            if ts and text[at : at + 1] == "<":
                g = re.compile(r"<[\w\s.,\[\]|<>'\"]*>").match(text, at)
                if g is None:
                    raise Invalid("markup")
                at = g.end()
            while True:
                a = _ATTR.match(text, at)
                if a is None:
                    raise Invalid("attribute")
                at = a.end()
                if a["end"]:
                    closed = a["end"][0] == "/"
                    break
                if not name:
                    raise Invalid("attribute of a fragment")
                if a["spread"] or a["value"] == "{":
                    raw, at = _lex_markup(text, at, ts, True)
                    _inner(raw, ts, False)
                    at += 1
                elif a["value"] == "<":
                    at = _element(text, at - 1, ts)
            if not closed:
                names.append(name)
        if not names:
            return at
        while True:  # children
            at = _TEXT.match(text, at).end()
            c = text[at : at + 1]
            if c == "{":
                raw, at = _lex_markup(text, at + 1, ts, True)
                _inner(raw, ts, True)
                at += 1
            elif c == "<":
                break
            else:
                raise Invalid("markup text")


def _skip(text: str, at: int, c: str) -> int:
    while text[at : at + 1].isspace():
        at += 1
    if text[at : at + 1] != c:
        raise Invalid("tag")
    return at + 1


_known: dict[tuple[bool, bool], dict[str, bool]] = {(t, m): {} for t in (True, False) for m in (True, False)}


class Parser(Cursor):
    """Recursive descent over a class string; ``ts`` admits types."""

    def __init__(self, text: Text, ts: bool, markup: bool = False) -> None:
        super().__init__(text.classes)
        self.nl, self.ts, self.markup = text.nl, ts, markup
        self.known = _known[ts, markup]

    def end(self) -> None:
        if self.s[self.p] != "\0":
            raise Invalid(f"left over at {self.p}")

    def semi(self) -> None:
        c = self.s[self.p]
        if c == ";":
            self.p += 1
        elif c not in "}\0" and self.p not in self.nl:
            raise Invalid(f"expected ; at {self.p}")

    def ident(self) -> None:
        if self.s[self.p] not in _IDENTS:
            raise Invalid(f"expected a name at {self.p}")
        self.p += 1

    def name(self) -> None:
        c = self.s[self.p]
        if c != IDENT and c not in _WORDS:
            raise Invalid(f"expected a name at {self.p}")
        self.p += 1

    # statements
    def program(self) -> None:
        while self.s[self.p] != "\0":
            self.item()

    def item(self) -> None:
        c = self.s[self.p]
        if c == K["import"] and self.s[self.p + 1] not in "(" + K["."]:
            self.imports()
        elif c == K["export"]:
            self.exports()
        else:
            self.statement()

    def imports(self) -> None:
        self.p += 1
        if self.s[self.p] == STRING:
            self.p += 1
            self.attributes()
            return self.semi()
        if self.ts and self.s[self.p] == K["type"] and self.s[self.p + 1] in _IDENTS | {"{", K["*"]} and self.s[self.p + 1] != K["from"]:
            self.p += 1
        if self.s[self.p] in _IDENTS:
            self.p += 1
            if self.ts and self.eat(K["="]):
                self.expr()
                return self.semi()
            if not self.eat(","):
                self.take(K["from"])
                self.take(STRING)
                self.attributes()
                return self.semi()
        if self.eat(K["*"]):
            self.take(K["as"])
            self.ident()
        else:
            self.specifiers()
        self.take(K["from"])
        self.take(STRING)
        self.attributes()
        self.semi()

    def attributes(self) -> None:
        if self.s[self.p] == K["with"] and self.s[self.p + 1] == "{":
            self.p += 1
            self.object()

    def specifiers(self) -> None:
        self.take("{")
        while not self.eat("}"):
            if self.ts and self.s[self.p] == K["type"] and self.s[self.p + 1] not in "," + "}" + K["as"]:
                self.p += 1
            if not self.eat(STRING):
                self.name()
            if self.eat(K["as"]) and not self.eat(STRING):
                self.name()
            if self.s[self.p] != "}":
                self.take(",")

    def exports(self) -> None:
        self.p += 1
        c, d = self.s[self.p], self.s[self.p + 1]
        if self.ts and c == K["type"] and d in ("{", K["*"]):
            self.p += 1
            c = d
        if c == "{":
            self.specifiers()
            if self.eat(K["from"]):
                self.take(STRING)
                self.attributes()
            return self.semi()
        if c == K["*"]:
            self.p += 1
            if self.eat(K["as"]) and not self.eat(STRING):
                self.name()
            self.take(K["from"])
            self.take(STRING)
            self.attributes()
            return self.semi()
        if c == K["default"]:
            self.p += 1
            c = self.s[self.p]
            if c == K["function"] or c == K["async"] and self.s[self.p + 1] == K["function"]:
                return self.function(False)
            if c in (K["class"], "@") or self.ts and c == K["abstract"]:
                return self.class_(False)
            if self.ts and c == K["interface"]:
                return self.statement()
            self.assign()
            return self.semi()
        if self.ts and c == K["="]:
            self.p += 1
            self.expr()
            return self.semi()
        if self.ts and c == K["as"] and d == K["namespace"]:
            self.p += 2
            self.ident()
            return self.semi()
        if c in (K["var"], K["const"], K["let"], K["function"], K["class"], K["async"], "@") or self.ts and c in (K["interface"], K["type"], K["enum"], K["namespace"], K["module"], K["declare"], K["abstract"], K["import"]):
            if c == K["import"]:
                return self.imports()
            return self.statement()
        raise Invalid("export")

    def block(self) -> None:
        self.take("{")
        while not self.eat("}"):
            self.statement()

    def statement(self) -> None:
        m = _SIMPLE.match(self.s, self.p)
        if m is not None:
            key = m[0]
            ok = self.known.get(key)
            if ok is None:
                end = m.end()
                if any(self.p < x < end for x in self.nl) if len(self.nl) < 40 else not self.nl.isdisjoint(range(self.p + 1, end)):
                    return self._statement()
                at = self.p
                self._statement()
                if self.p == end and at + len(key) == end:
                    if len(self.known) > 200_000:
                        self.known.clear()
                    self.known[key] = True
                return None
            self.p = m.end()
            return None
        return self._statement()

    def _statement(self) -> None:
        c, d = self.s[self.p], self.s[self.p + 1]
        if c == "{":
            return self.block()
        if c == ";":
            self.p += 1
            return None
        f = _STATEMENTS.get(c)
        if f is not None:
            return f(self)
        if c == K["let"] and (d in _IDENTS or d in "[{"):
            return self.declaration()
        if c == K["async"] and d == K["function"] and self.p + 1 not in self.nl:
            return self.function(True)
        if c == "@":
            return self.class_(True)
        if self.ts:
            if c == K["interface"] and d in _IDENTS:
                return self.interface()
            if c == K["type"] and d in _IDENTS:
                return self.alias()
            if c == K["enum"] or c == K["const"] and d == K["enum"]:
                return self.enum()
            if c in (K["namespace"], K["module"], K["global"]) and (d in _IDENTS or d in (STRING, "{")):
                self.p += 1
                if not self.eat(STRING):
                    while self.s[self.p] in _IDENTS:
                        self.p += 1
                        if not self.eat("."):
                            break
                if self.s[self.p] == "{":
                    self.p += 1
                    while not self.eat("}"):
                        self.item()
                    return None
                return self.semi()
            if c == K["declare"] and (d in _WORDS):
                self.p += 1
                return self.statement()
            if c == K["abstract"] and d == K["class"]:
                return self.class_(True)
        if c in _IDENTS and d == ":":
            self.p += 2
            return self.statement()
        if c == K["import"] and d not in "(" + K["."]:
            raise Invalid("import inside")
        self.expr()
        return self.semi()

    def declaration(self, loop: bool = False) -> None:
        const = self.s[self.p] == K["const"]
        if self.ts and const and self.s[self.p + 1] == K["enum"]:
            return self.enum()
        self.p += 1
        while True:
            plain = self.s[self.p] in _IDENTS
            self.binding()
            if self.ts:
                self.eat(K["!"])
                self.annotation()
            if self.eat(K["="]):
                self.assign(loop)
            elif not loop and (const or not plain) and not self.ts:
                raise Invalid("no initial value")
            if not self.eat(","):
                break
        if not loop:
            self.semi()
        return None

    def annotation(self) -> None:
        if self.ts and self.eat(":"):
            self.type()

    def binding(self) -> None:
        c = self.s[self.p]
        if c == "[":
            self.p += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                if self.eat(K["..."]):
                    self.binding()
                else:
                    self.binding()
                    if self.eat(K["="]):
                        self.assign()
                if self.s[self.p] != "]":
                    self.take(",")
        elif c == "{":
            self.p += 1
            while not self.eat("}"):
                if self.eat(K["..."]):
                    self.binding()
                else:
                    short = self.s[self.p] in _IDENTS
                    self.key()
                    if self.eat(":"):
                        self.binding()
                    elif not short:
                        raise Invalid("pattern")
                    if self.eat(K["="]):
                        self.assign()
                if self.s[self.p] != "}":
                    self.take(",")
        else:
            self.ident()

    def key(self) -> None:
        c = self.s[self.p]
        if c == "[":
            self.p += 1
            self.assign()
            self.take("]")
        elif c in (STRING, NUMBER):
            self.p += 1
        else:
            self.name()

    def if_(self) -> None:
        self.p += 1
        self.parenthesised()
        self.statement()
        if self.eat(K["else"]):
            self.statement()

    def parenthesised(self) -> None:
        self.take("(")
        self.expr()
        self.take(")")

    def for_(self) -> None:
        self.p += 1
        self.eat(K["await"])
        self.take("(")
        c, d = self.s[self.p], self.s[self.p + 1]
        if c == ";":
            pass
        elif c in (K["var"], K["const"]) or c == K["let"] and (d in _IDENTS or d in "[{"):
            self.declaration(True)
        else:
            self.expr(True)
        if self.eat(K["of"]) or self.eat(K["in"]):
            self.expr()
        else:
            self.take(";")
            if self.s[self.p] != ";":
                self.expr()
            self.take(";")
            if self.s[self.p] != ")":
                self.expr()
        self.take(")")
        self.statement()

    def while_(self) -> None:
        self.p += 1
        self.parenthesised()
        self.statement()

    def do(self) -> None:
        self.p += 1
        self.statement()
        self.take(K["while"])
        self.parenthesised()
        self.eat(";")

    def jump(self) -> None:
        self.p += 1
        if self.s[self.p] in _IDENTS and self.p not in self.nl:
            self.p += 1
        self.semi()

    def return_(self) -> None:
        self.p += 1
        if self.s[self.p] not in ";}\0" and self.p not in self.nl:
            self.expr()
        self.semi()

    def throw(self) -> None:
        self.p += 1
        if self.p in self.nl:
            raise Invalid("throw")
        self.expr()
        self.semi()

    def try_(self) -> None:
        self.p += 1
        self.block()
        caught = self.eat(K["catch"])
        if caught:
            if self.eat("("):
                self.binding()
                self.annotation()
                self.take(")")
            self.block()
        if self.eat(K["finally"]):
            self.block()
        elif not caught:
            raise Invalid("try alone")

    def switch(self) -> None:
        self.p += 1
        self.parenthesised()
        self.take("{")
        while not self.eat("}"):
            if self.eat(K["case"]):
                self.expr()
            else:
                self.take(K["default"])
            self.take(":")
            while self.s[self.p] not in (K["case"], K["default"], "}"):
                self.statement()

    def debugger(self) -> None:
        self.p += 1
        self.semi()

    def never(self) -> None:
        raise Invalid("misplaced word")

    def function_statement(self) -> None:
        self.function(True)

    def class_statement(self) -> None:
        self.class_(True)

    # functions and classes
    def function(self, named: bool) -> None:
        self.eat(K["async"])
        self.take(K["function"])
        self.eat(K["*"])
        if named:
            self.ident()
        elif self.s[self.p] in _IDENTS:
            self.p += 1
        self.signature()
        if self.s[self.p] == "{" or not self.ts:
            self.block()
        else:
            self.semi()

    def signature(self) -> None:
        if self.ts and self.s[self.p] == K["<"]:
            self.type_parameters()
        self.parameters()
        if self.ts and self.eat(":"):
            self.return_type()

    def parameters(self) -> None:
        self.take("(")
        while not self.eat(")"):
            while self.s[self.p] == "@":
                self.decorator()
            if self.ts:
                while self.s[self.p] in _MODIFIERS and self.s[self.p + 1] in _IDENTS | {"{", "["}:
                    self.p += 1
            if self.eat(K["..."]):
                self.binding()
                self.annotation()
            else:
                if self.ts and self.s[self.p] == K["this"]:
                    self.p += 1
                else:
                    self.binding()
                if self.ts:
                    self.eat(K["?"])
                    self.annotation()
                if self.eat(K["="]):
                    self.assign()
            if self.s[self.p] != ")":
                self.take(",")

    def decorator(self) -> None:
        self.take("@")
        if self.s[self.p] == "(":
            self.parenthesised()
        else:
            self.ident()
            while self.eat("."):
                self.name()
        if self.s[self.p] == "(":
            self.arguments()

    def class_(self, named: bool) -> None:
        while self.s[self.p] == "@":
            self.decorator()
        self.eat(K["export"]) and self.eat(K["default"])
        if self.ts:
            self.eat(K["abstract"])
        self.take(K["class"])
        c = self.s[self.p]
        if c in _IDENTS and c != K["implements"]:
            self.p += 1
        elif named:
            raise Invalid("class without a name")
        if self.ts and self.s[self.p] == K["<"]:
            self.type_parameters()
        if self.eat(K["extends"]):
            self.postfix()
            if self.ts and self.s[self.p] == K["<"]:
                self.type_arguments()
        if self.ts and self.eat(K["implements"]):
            self.type()
            while self.eat(","):
                self.type()
        self.take("{")
        while not self.eat("}"):
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return None
        while self.s[self.p] == "@":
            self.decorator()
        if self.s[self.p] == K["static"] and self.s[self.p + 1] == "{":
            self.p += 1
            return self.block()
        ends = {"(", ";", "}", "=", ":", K["?"], K["!"], K["<"], "\0", ","}
        words = _MODIFIERS if self.ts else {K["static"], K["async"], K["accessor"]}
        while self.s[self.p] in words and self.s[self.p + 1] not in ends:
            self.p += 1
        self.eat(K["*"])
        if self.s[self.p] in (K["get"], K["set"]) and self.s[self.p + 1] not in ends:
            self.p += 1
        if self.ts and self.s[self.p] == "[" and self.s[self.p + 1] in _IDENTS and self.s[self.p + 2] == ":":
            self.p += 3
            self.type()
            self.take("]")
            self.annotation()
            return self.semi()
        self.key()
        if self.ts and not self.eat(K["?"]):
            self.eat(K["!"])
        if self.s[self.p] == "(" or self.ts and self.s[self.p] == K["<"]:
            self.signature()
            if self.s[self.p] == "{" or not self.ts:
                return self.block()
            return self.semi()
        self.annotation()
        if self.eat(K["="]):
            self.assign()
        return self.semi()

    # expressions
    def expr(self, no_in: bool = False) -> None:
        self.assign(no_in)
        while self.eat(","):
            self.assign(no_in)

    def assign(self, no_in: bool = False) -> None:
        s, p = self.s, self.p
        c = s[p]
        if c == K["yield"]:
            self.p += 1
            if self.s[self.p] not in ");]},:\0" and self.p not in self.nl:
                self.eat(K["*"])
                self.assign(no_in)
            return
        q = p + 1 if c == K["async"] and s[p + 1] in _IDENTS | {"(", K["<"]} and s[p + 1] != K["=>"] else p
        if s[q] in _IDENTS and s[q + 1] == K["=>"]:
            self.p = q + 1
            return self.arrow(no_in)
        if s[q] == "(":
            after = s[self.match[q] + 1]
            if after == K["=>"]:
                self.p = q
                self.parameters()
                return self.arrow(no_in)
            if self.ts and after == ":" and self.attempt(self.typed_arrow, q, no_in):
                return None
        if self.ts and s[q] == K["<"] and self.attempt(self.typed_arrow, q, no_in):
            return None
        kind = self.conditional(no_in)
        if self.s[self.p] in _ASSIGN:
            if not kind:
                raise Invalid("assignment to no target")
            self.p += 1
            self.assign(no_in)
        return None

    def typed_arrow(self, q: int, no_in: bool) -> None:
        self.p = q
        self.signature()
        if self.s[self.p] != K["=>"]:
            raise Invalid("arrow")
        self.arrow(no_in)

    def arrow(self, no_in: bool) -> None:
        if self.p in self.nl:
            raise Invalid("arrow on a new line")
        self.take(K["=>"])
        if self.s[self.p] == "{":
            self.block()
        else:
            self.assign(no_in)

    def conditional(self, no_in: bool) -> bool:
        target = self.binary(no_in)
        if self.s[self.p] == K["?"]:
            self.p += 1
            self.assign()
            self.take(":")
            self.assign(no_in)
            return False
        return target

    def binary(self, no_in: bool) -> bool:
        target = self.unary()
        while True:
            c = self.s[self.p]
            if c in _BINARY:
                if c == K[">"]:  # longer marks of > come in pieces, as generics close with them
                    self.p += 1
                    n = 1
                    while self.s[self.p] == K[">"] and n < 3:
                        self.p, n = self.p + 1, n + 1
                    if self.s[self.p] == K["="]:
                        self.p += 1
                        if n > 1:
                            if not target:
                                raise Invalid("assignment to no target")
                            self.assign(no_in)
                            return False
                    elif self.s[self.p] in (K["=="], K["==="]):
                        raise Invalid("operator")
                else:
                    self.p += 1
            elif c == K["in"] and not no_in:
                self.p += 1
            elif self.ts and c in (K["as"], K["satisfies"]) and self.p not in self.nl:
                self.p += 1
                if not self.eat(K["const"]):
                    self.type()
                continue
            else:
                return target
            target = False
            self.unary()

    def unary(self) -> bool:
        c = self.s[self.p]
        if c in _PREFIX:
            if c == K["await"] and self.s[self.p + 1] in ");,.=\0" + K["=>"]:
                return self.postfix()
            self.p += 1
            self.unary()
            return False
        if self.ts and c == K["<"] and not self.markup:
            self.p += 1
            self.type()
            self.take(K[">"])
            self.unary()
            return False
        return self.postfix()

    def postfix(self) -> bool:
        target = self.chain(self.primary(), True)
        if self.s[self.p] in (K["++"], K["--"]) and self.p not in self.nl:
            if not target:
                raise Invalid("no target")
            self.p += 1
            return False
        return target

    def chain(self, target: bool, calls: bool) -> bool:
        while True:
            c = self.s[self.p]
            if c == ".":
                self.p += 1
                self.name()
                target = True
            elif c == "[":
                self.p += 1
                self.expr()
                self.take("]")
                target = True
            elif c == "(" and calls:
                self.arguments()
                target = False
            elif c == K["?."] and calls:
                self.p += 1
                d = self.s[self.p]
                if d == "(":
                    self.arguments()
                elif d == "[":
                    self.p += 1
                    self.expr()
                    self.take("]")
                else:
                    self.name()
                target = False
            elif c == TEMPLATE:
                self.p += 1
                target = False
            elif self.ts and c == K["!"] and self.p not in self.nl:
                self.p += 1
            elif self.ts and c == K["<"]:
                at = self.p
                if self.attempt(self.type_arguments) and self.s[self.p] in ("(", TEMPLATE, ")", ";", ",", "."):
                    continue
                self.p = at
                return target
            else:
                return target

    def arguments(self) -> None:
        self.take("(")
        while not self.eat(")"):
            self.eat(K["..."])
            self.assign()
            if self.s[self.p] != ")":
                self.take(",")

    def primary(self) -> bool:
        c = self.s[self.p]
        if c == IDENT:
            self.p += 1
            return True
        if c in _LITERAL or c == TEMPLATE:
            self.p += 1
            return False
        if c == "(":
            self.p += 1
            self.expr()
            self.take(")")
            return True
        if c == "[":
            self.p += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat(K["..."])
                self.assign()
                if self.s[self.p] != "]":
                    self.take(",")
            return True
        if c == "{":
            self.object()
            return True
        if c == K["function"] or c == K["async"] and self.s[self.p + 1] == K["function"] and self.p + 1 not in self.nl:
            self.function(False)
            return False
        if c == K["class"] or c == "@":
            self.class_(False)
            return False
        if c == K["new"]:
            self.p += 1
            if self.eat("."):
                self.name()
                return False
            if self.s[self.p] == K["new"]:
                self.primary()
            else:
                self.chain(self.primary(), False)
            if self.ts and self.s[self.p] == K["<"]:
                self.attempt(self.type_arguments)
            if self.s[self.p] == "(":
                self.arguments()
            return False
        if c == K["import"]:
            self.p += 1
            if self.eat("."):
                self.name()
            else:
                self.arguments()
            return False
        if c in _IDENTS:
            self.p += 1
            return True
        raise Invalid(f"expected an expression at {self.p}")

    def object(self) -> None:
        self.take("{")
        while not self.eat("}"):
            if self.eat(K["..."]):
                self.assign()
            else:
                after = {",", ":", "(", "}", "=", K["<"]}
                if self.s[self.p] == K["async"] and self.s[self.p + 1] not in after:
                    self.p += 1
                star = self.eat(K["*"])
                if self.s[self.p] in (K["get"], K["set"]) and self.s[self.p + 1] not in after:
                    self.p += 1
                short = self.s[self.p] in _IDENTS
                self.key()
                c = self.s[self.p]
                if c == "(" or self.ts and c == K["<"]:
                    self.signature()
                    self.block()
                elif star:
                    raise Invalid("generator")
                elif self.eat(":"):
                    self.assign()
                elif not short:
                    raise Invalid("property")
                elif self.eat(K["="]):
                    self.assign()
            if self.s[self.p] != "}":
                self.take(",")

    # types
    def interface(self) -> None:
        self.p += 1
        self.ident()
        if self.s[self.p] == K["<"]:
            self.type_parameters()
        if self.eat(K["extends"]):
            self.type()
            while self.eat(","):
                self.type()
        self.type_object()

    def alias(self) -> None:
        self.p += 1
        self.ident()
        if self.s[self.p] == K["<"]:
            self.type_parameters()
        self.take(K["="])
        self.type()
        self.semi()

    def enum(self) -> None:
        self.eat(K["const"])
        self.take(K["enum"])
        self.ident()
        self.take("{")
        while not self.eat("}"):
            self.key()
            if self.eat(K["="]):
                self.assign()
            if self.s[self.p] != "}":
                self.take(",")

    def type_parameters(self) -> None:
        self.take(K["<"])
        while not self.eat(K[">"]):
            while self.s[self.p] in (K["const"], K["in"], K["out"]) and self.s[self.p + 1] in _IDENTS:
                self.p += 1
            self.ident()
            if self.eat(K["extends"]):
                self.type()
            if self.eat(K["="]):
                self.type()
            if self.s[self.p] != K[">"]:
                self.take(",")

    def type_arguments(self) -> None:
        self.take(K["<"])
        self.type()
        while self.eat(","):
            self.type()
        self.take(K[">"])

    def return_type(self) -> None:
        if self.s[self.p] == K["asserts"] and self.s[self.p + 1] in _IDENTS | {K["this"]} and self.p + 1 not in self.nl:
            self.p += 2
            if self.eat(K["is"]):
                self.type()
            return
        if self.s[self.p] in _IDENTS | {K["this"]} and self.s[self.p + 1] == K["is"]:
            self.p += 2
        self.type()

    def type(self) -> None:
        s, p = self.s, self.p
        if s[p] == K["<"]:
            self.type_parameters()
            self.parameters()
            self.take(K["=>"])
            return self.return_type()
        if s[p] in (K["new"], K["abstract"]) and s[p + 1] in ("(", K["<"], K["new"]):
            while self.s[self.p] not in "(" + K["<"]:
                self.p += 1
            if self.s[self.p] == K["<"]:
                self.type_parameters()
            self.parameters()
            self.take(K["=>"])
            return self.return_type()
        if s[p] == "(" and s[self.match[p] + 1] == K["=>"]:
            self.parameters()
            self.take(K["=>"])
            return self.return_type()
        self.eat(K["|"]) or self.eat(K["&"])
        self.type_operand()
        while self.s[self.p] in (K["|"], K["&"]):
            self.p += 1
            self.type_operand()
        if self.s[self.p] == K["extends"] and self.p not in self.nl:
            at = self.p
            self.p += 1
            self.type_operand()
            while self.s[self.p] in (K["|"], K["&"]):
                self.p += 1
                self.type_operand()
            if not self.eat(K["?"]):
                self.p = at
                return None
            self.type()
            self.take(":")
            self.type()
        return None

    def type_operand(self) -> None:
        c, d = self.s[self.p], self.s[self.p + 1]
        if c in (K["keyof"], K["unique"], K["readonly"]) and d not in ">,);=]|&{" or c == K["keyof"]:
            self.p += 1
            return self.type_operand()
        if c == K["infer"] and d in _IDENTS:
            self.p += 2
        elif c == K["typeof"]:
            self.p += 1
            if self.s[self.p] == K["import"]:
                self.p += 1
                self.take("(")
                self.take(STRING)
                self.take(")")
            else:
                self.name()
            while self.eat("."):
                self.name()
            if self.s[self.p] == K["<"]:
                self.type_arguments()
        elif c == "(":
            self.p += 1
            self.type()
            self.take(")")
        elif c == "[":
            self.p += 1
            while not self.eat("]"):
                self.eat(K["..."])
                if self.s[self.p] in _IDENTS and (self.s[self.p + 1] == ":" or self.s[self.p + 1] == K["?"] and self.s[self.p + 2] == ":"):
                    self.p += 1
                    self.eat(K["?"])
                    self.take(":")
                self.type()
                self.eat(K["?"])
                if self.s[self.p] != "]":
                    self.take(",")
        elif c == "{":
            self.type_object()
        elif c in (STRING, NUMBER, TEMPLATE, K["null"], K["true"], K["false"], K["this"], K["void"]):
            self.p += 1
        elif c == K["-"] and d == NUMBER:
            self.p += 2
        elif c == K["import"]:
            self.p += 1
            self.take("(")
            self.take(STRING)
            self.take(")")
            while self.eat("."):
                self.name()
            if self.s[self.p] == K["<"]:
                self.type_arguments()
        else:
            self.ident()
            while self.eat("."):
                self.name()
            if self.s[self.p] == K["<"] and self.p not in self.nl:
                self.type_arguments()
        while self.s[self.p] == "[" and self.p not in self.nl:
            self.p += 1
            if not self.eat("]"):
                self.type()
                self.take("]")
        return None

    def type_object(self) -> None:
        self.take("{")
        while not self.eat("}"):
            self.type_member()
            if self.s[self.p] != "}" and not (self.eat(";") or self.eat(",")) and self.p not in self.nl:
                raise Invalid("type member")

    def type_member(self) -> None:
        s = self.s
        ends = {"(", ";", "}", ":", K["?"], K["<"], ","}
        if s[self.p] in (K["+"], K["-"]):
            self.p += 1
            if s[self.p] != K["readonly"]:
                raise Invalid("modifier")
        if s[self.p] == K["readonly"] and s[self.p + 1] not in ends:
            self.p += 1
        if s[self.p] in (K["get"], K["set"]) and s[self.p + 1] not in ends:
            self.p += 1
        if s[self.p] == K["new"] and s[self.p + 1] in ("(", K["<"]):
            self.p += 1
        if s[self.p] in ("(", K["<"]):
            return self.signature()
        if s[self.p] == "[" and s[self.p + 1] in _IDENTS and s[self.p + 2] in (":", K["in"]):
            mapped = s[self.p + 2] == K["in"]
            self.p += 3
            self.type()
            if mapped and self.eat(K["as"]):
                self.type()
            self.take("]")
            if self.s[self.p] in (K["+"], K["-"]):
                self.p += 1
            self.eat(K["?"])
            return self.annotation()
        self.key()
        self.eat(K["?"])
        if self.s[self.p] in ("(", K["<"]):
            return self.signature()
        return self.annotation()


_STATEMENTS = {
    K["var"]: Parser.declaration, K["const"]: Parser.declaration, K["function"]: Parser.function_statement, K["class"]: Parser.class_statement, K["if"]: Parser.if_, K["for"]: Parser.for_,
    K["while"]: Parser.while_, K["do"]: Parser.do, K["break"]: Parser.jump, K["continue"]: Parser.jump, K["return"]: Parser.return_, K["throw"]: Parser.throw, K["try"]: Parser.try_,
    K["switch"]: Parser.switch, K["debugger"]: Parser.debugger, K["export"]: Parser.never, K["with"]: Parser.never,
}


def check(text: str, method: bool, ts: bool, markup: bool) -> str | None:
    """Why the text is invalid as a module or, if ``method``, as members of a class body; None if it is valid."""
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    try:
        t = lex(text.removeprefix("﻿"), ts, markup)
        p = Parser(t, ts, markup)
        if method:
            try:
                while p.s[p.p] != "\0":
                    p.member()
                return None
            except Invalid as e:
                as_member = str(e)
                p.p = 0
                try:
                    p.program()
                except Invalid:
                    return as_member
                return None
        p.program()
    except Invalid as e:
        return str(e)
    except RecursionError:
        return None
    return None
