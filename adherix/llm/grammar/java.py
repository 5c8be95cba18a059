"""Java."""

from __future__ import annotations

import re

from adherix.llm.grammar.base import BAD, IDENT, NUMBER, STRING, Classes, Cursor, Invalid

# The words and marks of the language.
PRIMITIVE = "boolean byte char double float int long short".split()
RESERVED = PRIMITIVE + "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
CONTEXTUAL = "var yield record sealed permits when module".split()
MARKS = ">>>= ... >>>  >>= <<= -> :: == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << { } ( ) [ ] ; , . < > + - * / % & | ^ ! ~ ? : = @".split()
CLS = Classes(RESERVED + CONTEXTUAL + MARKS)
K = CLS.symbol
_MARK = "|".join(re.escape(m) for m in MARKS if m not in (">>>", ">=", ">>=", ">>>="))
_STR = r"\"\"\"[ \t\f]*\r?\n(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'"
_NUM = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$])"
LEX = re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|[^\W\d][\w$]*|\$[\w$]*|{_NUM}|{_STR}|{_MARK}|\S")
_DROP = ("//", "/*")
_PRIM = {K[x] for x in PRIMITIVE}
_IDENTS = {IDENT} | {K[x] for x in CONTEXTUAL}
_MODIFIERS = {K[x] for x in "public protected private static abstract final native synchronized transient volatile strictfp default sealed".split()}
_ASSIGN = {K[x] for x in "= += -= *= /= %= &= |= ^= <<=".split()}
_BINARY = {K[x] for x in "== != <= && || << < > + - * / % & | ^".split()}
_SIMPLE = re.compile(r"[^;{}\0]{1,120};")


def lex(text: str) -> str:
    raw = "".join([CLS[t] for t in LEX.findall(text) if len(t) == 1 or t[:2] not in _DROP])
    if BAD in raw:
        raise Invalid("no token")
    return raw


class Parser(Cursor):
    known: dict[str, bool] = {}

    def end(self) -> None:
        if self.s[self.p] != "\0":
            raise Invalid(f"left over at {self.p}")

    def ident(self) -> None:
        if self.s[self.p] not in _IDENTS:
            raise Invalid(f"expected a name at {self.p}")
        self.p += 1

    def qualified(self) -> None:
        self.ident()
        while self.s[self.p] == "." and self.s[self.p + 1] in _IDENTS:
            self.p += 2

    # declarations
    def unit(self) -> None:
        at = self.p
        self.annotations()
        if self.eat(K["package"]):
            self.qualified()
            self.take(";")
        else:
            self.p = at
        while self.eat(K["import"]):
            self.eat(K["static"])
            self.qualified()
            if self.eat("."):
                self.take(K["*"])
            self.take(";")
            while self.eat(";"):
                pass
        while self.s[self.p] != "\0":
            if not self.eat(";"):
                self.modifiers()
                self.type_declaration()

    def annotations(self) -> None:
        while self.s[self.p] == "@" and self.s[self.p + 1] != K["interface"]:
            self.p += 1
            self.qualified()
            if self.s[self.p] == "(":
                self.p += 1
                while not self.eat(")"):
                    if self.s[self.p] in _IDENTS and self.s[self.p + 1] == K["="]:
                        self.p += 2
                    self.element()
                    if self.s[self.p] != ")":
                        self.take(",")

    def element(self) -> None:
        if self.s[self.p] == "@":
            self.annotations()
        elif self.s[self.p] == "{":
            self.p += 1
            while not self.eat("}"):
                self.element()
                if self.s[self.p] != "}":
                    self.take(",")
        else:
            self.conditional()

    def modifiers(self) -> None:
        while True:
            if self.s[self.p] == "@" and self.s[self.p + 1] != K["interface"]:
                self.annotations()
            elif self.s[self.p] in _MODIFIERS and not (self.s[self.p] == K["default"] and self.s[self.p + 1] in ":" + K["->"]):
                self.p += 1
            elif self.s[self.p] == IDENT and self.s[self.p + 1] == K["-"] and self.s[self.p + 2] == K["sealed"]:
                self.p += 3
            else:
                return

    def type_declaration(self) -> None:
        c = self.s[self.p]
        if c == "@":
            self.p += 1
            c = self.s[self.p]
            if c != K["interface"]:
                raise Invalid("annotation")
        if c not in (K["class"], K["interface"], K["enum"]) and not (c == K["record"] and self.s[self.p + 1] in _IDENTS):
            raise Invalid(f"expected a type at {self.p}")
        self.p += 1
        self.ident()
        if self.s[self.p] == K["<"]:
            self.type_parameters()
        if c == K["record"]:
            self.parameters()
        for word in ("extends", "implements", "permits"):
            if self.eat(K[word]):
                self.type()
                while self.eat(","):
                    self.type()
        self.body(c == K["enum"])

    def body(self, enum: bool = False) -> None:
        self.take("{")
        if enum:
            while self.s[self.p] not in ";}":
                self.annotations()
                self.ident()
                if self.s[self.p] == "(":
                    self.arguments()
                if self.s[self.p] == "{":
                    self.body()
                if not self.eat(","):
                    break
            if self.s[self.p] != "}":
                self.take(";")
        while not self.eat("}"):
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return None
        if self.s[self.p] == "{" or self.s[self.p] == K["static"] and self.s[self.p + 1] == "{":
            self.eat(K["static"])
            return self.block()
        self.modifiers()
        c, d = self.s[self.p], self.s[self.p + 1]
        if c in (K["class"], K["interface"], K["enum"], "@") or c == K["record"] and d in _IDENTS and self.s[self.p + 2] in ("(", K["<"]):
            return self.type_declaration()
        if c == K["<"]:
            self.type_parameters()
            self.annotations()
        if self.s[self.p] in _IDENTS and self.s[self.p + 1] in "({":
            self.p += 1
            if self.s[self.p] == "(":
                self.parameters()
                self.throws()
            return self.block()
        if not self.eat(K["void"]):
            self.type()
        self.ident()
        if self.s[self.p] == "(":
            self.parameters()
            self.dims()
            self.throws()
            if self.eat(K["default"]):
                self.element()
            if self.eat(";"):
                return None
            return self.block()
        self.declarators()
        return self.take(";")

    def throws(self) -> None:
        if self.eat(K["throws"]):
            self.type()
            while self.eat(","):
                self.type()

    def parameters(self) -> None:
        self.take("(")
        while not self.eat(")"):
            self.modifiers()
            self.type()
            self.annotations()
            self.eat(K["..."])
            if not self.eat(K["this"]):
                self.ident()
            self.dims()
            if self.s[self.p] != ")":
                self.take(",")
                if self.s[self.p] == ")":
                    raise Invalid("parameter")

    def dims(self) -> None:
        while True:
            at = self.p
            self.annotations()
            if self.s[self.p] == "[" and self.s[self.p + 1] == "]":
                self.p += 2
            else:
                self.p = at
                return

    def declarators(self) -> None:
        while True:
            self.dims()
            if self.eat(K["="]):
                self.initial()
            if not self.eat(","):
                return
            self.ident()

    def initial(self) -> None:
        if self.s[self.p] == "{":
            self.p += 1
            while not self.eat("}"):
                self.initial()
                if self.s[self.p] != "}":
                    self.take(",")
        else:
            self.expr()

    def type(self) -> None:
        self.annotations()
        if self.s[self.p] in _PRIM:
            self.p += 1
        else:
            self.class_type()
        self.dims()

    def class_type(self) -> None:
        while True:
            self.annotations()
            self.ident()
            if self.s[self.p] == K["<"]:
                self.type_arguments()
            if self.s[self.p] == "." and self.s[self.p + 1] in _IDENTS | {"@"}:
                self.p += 1
            else:
                return

    def type_arguments(self) -> None:
        self.take(K["<"])
        if self.eat(K[">"]):
            return
        while True:
            self.annotations()
            if self.eat(K["?"]):
                if self.eat(K["extends"]) or self.eat(K["super"]):
                    self.type()
            else:
                self.type()
            if not self.eat(","):
                break
        self.take(K[">"])

    def type_parameters(self) -> None:
        self.take(K["<"])
        while True:
            self.annotations()
            self.ident()
            if self.eat(K["extends"]):
                self.type()
                while self.eat(K["&"]):
                    self.type()
            if not self.eat(","):
                break
        self.take(K[">"])

    # statements
    def block(self) -> None:
        self.take("{")
        while not self.eat("}"):
            self.statement()

    def statement(self) -> None:
        m = _SIMPLE.match(self.s, self.p)
        if m is None:
            return self._statement()
        key = m[0]
        if key in self.known:
            self.p = m.end()
            return None
        end = m.end()
        self._statement()
        if self.p == end:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = True
        return None

    def local(self) -> None:
        self.modifiers()
        self.type()
        self.ident()
        if self.s[self.p] not in ("=", ";", ",", "[", ":"):
            raise Invalid("declaration")
        self.declarators()

    def _statement(self) -> None:
        c, d = self.s[self.p], self.s[self.p + 1]
        if c == "{":
            return self.block()
        if c == ";":
            self.p += 1
            return None
        f = _STATEMENTS.get(c)
        if f is not None and not (c == K["synchronized"] and d != "("):
            return f(self)
        if c == K["yield"] and d not in "=.([" + K["++"] + K["--"]:
            self.p += 1
            self.expr()
            return self.take(";")
        if c in _IDENTS and d == ":":
            self.p += 2
            return self.statement()
        if c in (K["class"], K["interface"], K["enum"], K["abstract"], K["static"], K["strictfp"]) or c == K["record"] and d in _IDENTS and self.s[self.p + 2] in ("(", K["<"]):
            self.modifiers()
            return self.type_declaration()
        if c in (K["final"], "@"):
            at = self.p
            self.modifiers()
            if self.s[self.p] in (K["class"], K["interface"], K["enum"], K["record"]) and self.s[self.p + 1] in _IDENTS and self.s[self.p + 2] not in "=;":
                return self.type_declaration()
            self.p = at
            self.local()
            return self.take(";")
        if (c in _PRIM or c in _IDENTS) and self.attempt(self.local):
            return self.take(";")
        if not self.expr():
            raise Invalid("not a statement")
        return self.take(";")

    def parenthesised(self) -> None:
        self.take("(")
        self.expr()
        self.take(")")

    def if_(self) -> None:
        self.p += 1
        self.parenthesised()
        self.statement()
        if self.eat(K["else"]):
            self.statement()

    def for_(self) -> None:
        self.p += 1
        self.take("(")
        if self.s[self.p] != ";":
            if not self.attempt(self.local):
                self.expressions()
            if self.eat(":"):
                self.expr()
                self.take(")")
                return self.statement()
        self.take(";")
        if self.s[self.p] != ";":
            self.expr()
        self.take(";")
        if self.s[self.p] != ")":
            self.expressions()
        self.take(")")
        return self.statement()

    def expressions(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def while_(self) -> None:
        self.p += 1
        self.parenthesised()
        self.statement()

    def do(self) -> None:
        self.p += 1
        self.statement()
        self.take(K["while"])
        self.parenthesised()
        self.take(";")

    def jump(self) -> None:
        self.p += 1
        if self.s[self.p] in _IDENTS:
            self.p += 1
        self.take(";")

    def return_(self) -> None:
        self.p += 1
        if self.s[self.p] != ";":
            self.expr()
        self.take(";")

    def throw(self) -> None:
        self.p += 1
        self.expr()
        self.take(";")

    def assert_(self) -> None:
        self.p += 1
        self.expr()
        if self.eat(":"):
            self.expr()
        self.take(";")

    def synchronized(self) -> None:
        self.p += 1
        self.parenthesised()
        self.block()

    def try_(self) -> None:
        self.p += 1
        resources = self.eat("(")
        if resources:
            while not self.eat(")"):
                if not self.attempt(self.local):
                    self.expr()
                if self.s[self.p] != ")":
                    self.take(";")
        self.block()
        caught = resources
        while self.eat(K["catch"]):
            caught = True
            self.take("(")
            self.modifiers()
            self.type()
            while self.eat(K["|"]):
                self.type()
            self.ident()
            self.take(")")
            self.block()
        if self.eat(K["finally"]):
            self.block()
        elif not caught:
            raise Invalid("try alone")

    def switch(self) -> bool:
        self.p += 1
        self.parenthesised()
        self.take("{")
        while not self.eat("}"):
            if self.eat(K["case"]):
                self.label()
                while self.eat(","):
                    self.label()
                if self.eat(K["when"]):
                    self.expr()
            else:
                self.take(K["default"])
            if self.eat(K["->"]):
                if self.s[self.p] == "{":
                    self.block()
                elif self.s[self.p] == K["throw"]:
                    self.throw()
                else:
                    self.expr()
                    self.take(";")
            else:
                self.take(":")
                while self.s[self.p] not in (K["case"], K["default"], "}"):
                    self.statement()
        return False

    def label(self) -> None:
        if not self.eat(K["default"]) and not self.attempt(self.pattern):
            self.conditional(True)

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.eat("("):
            while not self.eat(")"):
                self.pattern()
                if self.s[self.p] != ")":
                    self.take(",")
            if self.s[self.p] in _IDENTS and self.s[self.p] != K["when"]:
                self.p += 1
        else:
            self.ident()

    def never(self) -> None:
        raise Invalid("misplaced word")

    # expressions: each returns whether it can stand as a statement
    def expr(self) -> bool:
        s, p = self.s, self.p
        if s[p] in _IDENTS and s[p + 1] == K["->"]:
            self.p += 1
            return self.lambda_()
        if s[p] == "(" and s[self.match[p] + 1] == K["->"]:
            if not self.attempt(self.parameters):
                self.take("(")
                while not self.eat(")"):
                    self.ident()
                    if self.s[self.p] != ")":
                        self.take(",")
            return self.lambda_()
        alone = self.conditional()
        if self.s[self.p] in _ASSIGN:
            self.p += 1
            self.expr()
            return True
        if self.s[self.p] == K[">"] and self.s[self.p + 1] == K[">"]:
            while self.eat(K[">"]):
                pass
            self.take(K["="])
            self.expr()
            return True
        return alone

    def lambda_(self) -> bool:
        self.take(K["->"])
        if self.s[self.p] == "{":
            self.block()
        else:
            self.expr()
        return False

    def conditional(self, label: bool = False) -> bool:
        alone = self.binary()
        if self.s[self.p] == K["?"]:
            self.p += 1
            self.expr()
            self.take(":")
            if self.s[self.p] in _IDENTS and self.s[self.p + 1] == K["->"] or self.s[self.p] == "(":
                self.expr()
            else:
                self.conditional(label)
            return False
        return alone

    def binary(self) -> bool:
        alone = self.unary()
        while True:
            c = self.s[self.p]
            if c == K["instanceof"]:
                self.p += 1
                self.eat(K["final"])
                if not self.attempt(self.pattern):
                    self.type()
                alone = False
                continue
            if c not in _BINARY:
                return alone
            if c == K[">"]:
                at, n = self.p, 0
                while self.s[self.p] == K[">"] and n < 3:
                    self.p, n = self.p + 1, n + 1
                if self.s[self.p] == K["="]:
                    if n > 1:
                        self.p = at
                        return alone
                    self.p += 1
            else:
                self.p += 1
            alone = False
            self.unary()

    def unary(self) -> bool:
        c = self.s[self.p]
        if c in (K["++"], K["--"]):
            self.p += 1
            self.unary()
            return True
        if c in (K["+"], K["-"], K["!"], K["~"]):
            self.p += 1
            self.unary()
            return False
        if c == "(" and self.attempt(self.cast):
            return False
        return self.postfix()

    def cast(self) -> None:
        self.take("(")
        primitive = self.s[self.p] in _PRIM
        self.type()
        while self.eat(K["&"]):
            self.type()
        self.take(")")
        c = self.s[self.p]
        if primitive and self.s[self.p - 2] in _PRIM:
            self.unary()
        elif c in _IDENTS or c in (STRING, NUMBER, "(", K["!"], K["~"], K["new"], K["this"], K["super"], K["true"], K["false"], K["null"], K["switch"]) or c in _PRIM:
            if c in _IDENTS and self.s[self.p + 1] == K["->"] or c == "(" and self.s[self.match[self.p] + 1] == K["->"]:
                self.expr()
            else:
                self.unary()
        else:
            raise Invalid("cast")

    def postfix(self) -> bool:
        alone = self.primary()
        while True:
            c = self.s[self.p]
            if c == ".":
                self.p += 1
                if self.s[self.p] == K["<"]:
                    self.type_arguments()
                if self.s[self.p] == K["new"]:
                    alone = self.new()
                    continue
                if not (self.eat(K["this"]) or self.eat(K["super"]) or self.eat(K["class"])):
                    self.ident()
                alone = False
            elif c == "(":
                if self.s[self.p - 1] not in _IDENTS and self.s[self.p - 1] not in (K["this"], K["super"]):
                    raise Invalid("call of no name")
                self.arguments()
                alone = True
            elif c == "[":
                self.p += 1
                self.expr()
                self.take("]")
                alone = False
            elif c == K["::"]:
                self.p += 1
                if self.s[self.p] == K["<"]:
                    self.type_arguments()
                if not self.eat(K["new"]):
                    self.ident()
                alone = False
            elif c in (K["++"], K["--"]):
                self.p += 1
                alone = True
            else:
                return alone

    def arguments(self) -> None:
        self.take("(")
        if self.eat(")"):
            return
        self.expressions()
        self.take(")")

    def new(self) -> bool:
        self.take(K["new"])
        if self.s[self.p] == K["<"]:
            self.type_arguments()
        self.annotations()
        if self.s[self.p] in _PRIM:
            self.p += 1
        else:
            self.class_type()
        if self.s[self.p] == "(":
            self.arguments()
            if self.s[self.p] == "{":
                self.body()
            return True
        if self.s[self.p] != "[":
            raise Invalid("new")
        while self.s[self.p] == "[":
            self.p += 1
            if not self.eat("]"):
                self.expr()
                self.take("]")
        if self.s[self.p] == "{":
            self.initial()
        return False

    def reference(self) -> None:
        self.type()
        if self.s[self.p] == "." and self.s[self.p + 1] == K["class"]:
            self.p += 2
        elif self.s[self.p] != K["::"]:
            raise Invalid("type")

    def primary(self) -> bool:
        c = self.s[self.p]
        if c in _IDENTS:
            if self.s[self.p + 1] in (K["<"], "[", ".") and self.attempt(self.reference):
                return False
            self.p += 1
            return False
        if c in (STRING, NUMBER, K["this"], K["super"], K["true"], K["false"], K["null"]):
            self.p += 1
            return False
        if c == "(":
            self.parenthesised()
            return False
        if c == K["new"]:
            return self.new()
        if c == K["switch"]:
            return self.switch()
        if c in _PRIM or c == K["void"]:
            if c == K["void"]:
                self.p += 1
                self.take(".")
                self.take(K["class"])
            else:
                self.reference()
            return False
        raise Invalid(f"expected an expression at {self.p}")


_STATEMENTS = {
    K["if"]: Parser.if_, K["for"]: Parser.for_, K["while"]: Parser.while_, K["do"]: Parser.do, K["break"]: Parser.jump, K["continue"]: Parser.jump, K["return"]: Parser.return_,
    K["throw"]: Parser.throw, K["try"]: Parser.try_, K["switch"]: Parser.switch, K["assert"]: Parser.assert_, K["synchronized"]: Parser.synchronized, K["import"]: Parser.never, K["package"]: Parser.never,
}


def check(text: str, method: bool) -> str | None:
    """Why the text is invalid as a file or, if ``method``, as members of a class body; None if it is valid."""
    try:
        p = Parser(lex(text.removeprefix("﻿")))
        if method:
            try:
                while p.s[p.p] != "\0":
                    p.member()
                return None
            except Invalid as e:
                as_member = str(e)
                p.p = 0
                try:
                    p.unit()
                except Invalid:
                    return as_member
                return None
        p.unit()
    except Invalid as e:
        return str(e)
    except RecursionError:
        return None
    return None
