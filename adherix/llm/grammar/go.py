"""Go."""

from __future__ import annotations

import re

from adherix.llm.grammar.base import BAD, IDENT, NUMBER, STRING, Classes, Cursor, Invalid

# The words and marks of the language.
RESERVED = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
MARKS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ { } ( ) [ ] , ; . : < > + - * / % & | ^ ! = ~".split()
CLS = Classes(RESERVED + MARKS)
K = CLS.symbol
_NUM = r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w)"
_STR = r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|.))'"
_MARK = "|".join(re.escape(m) for m in MARKS)
LEX = re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|\n|[^\W\d]\w*|{_NUM}|{_STR}|{_MARK}|\S")
_ENDS = "".join([IDENT, NUMBER, STRING, ")", "]", "}"] + [K[x] for x in ("break", "continue", "fallthrough", "return", "++", "--")])
_LINE_END = re.compile(f"([{re.escape(_ENDS)}])\n")
_ASSIGN = {K[x] for x in "= := += -= *= /= %= &= |= ^= <<= >>= &^=".split()}
_BINARY = {K[x] for x in "== != <= >= && || << >> &^ < > + - * / % & | ^".split()}
_PREFIX = {K[x] for x in "+ - ! ^ * & <- ~".split()}
_SIMPLE = re.compile(r"[^;{}\0]{1,120};")


def lex(text: str) -> str:
    raw = "".join([CLS[t] if len(t) < 2 or t[0] not in "/`" else STRING if t[0] == "`" else "" if t[1] == "/" else ("\n" if "\n" in t else "") if t[1] == "*" else CLS[t] for t in LEX.findall(text)])
    if BAD in raw:
        raise Invalid("no token")
    return _LINE_END.sub(r"\1;", raw + "\n").replace("\n", "")


class Parser(Cursor):
    known: dict[str, bool] = {}

    def __init__(self, classes: str) -> None:
        super().__init__(classes)
        self.literals = True  # composite literals of bare type names are allowed here

    def unit(self) -> None:
        if self.eat(K["package"]):
            self.take(IDENT)
            self.semi()
        while self.eat(K["import"]):
            self.group(self.import_spec)
            self.semi()
        while self.s[self.p] != "\0":
            c = self.s[self.p]
            if c == K["func"]:
                self.function()
            elif c in (K["var"], K["const"], K["type"]):
                self.declaration()
            else:
                raise Invalid(f"expected a declaration at {self.p}")
            self.semi()

    def semi(self) -> None:
        c = self.s[self.p]
        if c == ";":
            self.p += 1
        elif c not in ")}\0":
            raise Invalid(f"expected a line end at {self.p}")

    def group(self, spec) -> None:
        if self.eat("("):
            while not self.eat(")"):
                spec()
                self.semi()
        else:
            spec()

    def import_spec(self) -> None:
        if self.s[self.p] in (IDENT, "."):
            self.p += 1
        self.take(STRING)

    def declaration(self) -> None:
        c = self.s[self.p]
        self.p += 1
        self.group({K["var"]: self.var_spec, K["const"]: self.const_spec, K["type"]: self.type_spec}[c])

    def names(self) -> None:
        self.take(IDENT)
        while self.eat(","):
            self.take(IDENT)

    def var_spec(self) -> None:
        self.names()
        if self.s[self.p] != K["="]:
            self.type()
        if self.eat(K["="]):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if self.s[self.p] not in (K["="], ";", ")"):
            self.type()
        if self.eat(K["="]):
            self.expressions()

    def type_spec(self) -> None:
        self.take(IDENT)
        if self.s[self.p] == "[" and self.s[self.p + 1] == IDENT and self.s[self.p + 2] not in "]":
            at = self.p
            if not self.attempt(self.type_parameters):
                self.p = at
        self.eat(K["="])
        self.type()

    def type_parameters(self) -> None:
        self.take("[")
        while True:
            self.names()
            self.constraint()
            if not self.eat(",") or self.s[self.p] == "]":
                break
        self.take("]")

    def constraint(self) -> None:
        while True:
            self.eat(K["~"])
            self.type()
            if not self.eat(K["|"]):
                return

    def function(self) -> None:
        self.take(K["func"])
        if self.s[self.p] == "(":
            self.parameters()
        self.take(IDENT)
        if self.s[self.p] == "[":
            self.type_parameters()
        self.signature()
        if self.s[self.p] == "{":
            self.body()

    def body(self) -> None:
        before, self.literals = self.literals, True
        self.block()
        self.literals = before

    def signature(self) -> None:
        self.parameters()
        c = self.s[self.p]
        if c == "(":
            self.parameters()
        elif c in (IDENT, "[", K["*"], K["func"], K["map"], K["chan"], K["struct"], K["interface"], K["<-"]):
            self.type()

    def parameters(self) -> None:
        """Names and types are told apart only by what follows, so each item is a type or a name with a type."""
        self.take("(")
        while not self.eat(")"):
            if self.s[self.p] == IDENT and self.s[self.p + 1] not in ",)." and self.attempt(self.named_parameter):
                pass
            else:
                self.eat(K["..."])
                self.type()
            if self.s[self.p] != ")":
                self.take(",")

    def named_parameter(self) -> None:
        self.take(IDENT)
        self.eat(K["..."])
        self.type()
        if self.s[self.p] not in ",)":
            raise Invalid("parameter")

    def type(self) -> None:
        c = self.s[self.p]
        self.p += 1
        if c == IDENT:
            if self.s[self.p] == "." and self.s[self.p + 1] == IDENT:
                self.p += 2
            if self.s[self.p] == "[" and self.s[self.p + 1] != "]":
                self.attempt(self.type_arguments)
        elif c == K["*"]:
            self.type()
        elif c == "[":
            if not self.eat("]"):
                if not self.eat(K["..."]):
                    self.expr()
                self.take("]")
            self.type()
        elif c == K["map"]:
            self.take("[")
            self.type()
            self.take("]")
            self.type()
        elif c == K["chan"]:
            self.eat(K["<-"])
            self.type()
        elif c == K["<-"]:
            self.take(K["chan"])
            self.type()
        elif c == K["func"]:
            self.signature()
        elif c == K["struct"]:
            self.take("{")
            while not self.eat("}"):
                if self.s[self.p] == IDENT and self.s[self.p + 1] not in ";}." + STRING:
                    self.names()
                    self.type()
                else:
                    self.type()
                self.eat(STRING)
                self.semi()
        elif c == K["interface"]:
            self.take("{")
            while not self.eat("}"):
                if self.s[self.p] == IDENT and self.s[self.p + 1] == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.constraint()
                self.semi()
        elif c == "(":
            self.type()
            self.take(")")
        else:
            self.p -= 1
            raise Invalid(f"expected a type at {self.p}")

    def type_arguments(self) -> None:
        self.take("[")
        self.type()
        while self.eat(","):
            self.type()
        self.take("]")

    # statements
    def block(self) -> None:
        self.take("{")
        while not self.eat("}"):
            self.statement()
            self.semi()

    def statement(self) -> None:
        m = _SIMPLE.match(self.s, self.p) if self.literals else None
        if m is None:
            return self._statement()
        key = m[0]
        if key in self.known:
            self.p = m.end() - 1
            return None
        end = m.end() - 1
        self._statement()
        if self.p == end:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = True
        return None

    def _statement(self) -> None:
        c = self.s[self.p]
        if c == "{":
            return self.block()
        if c in ";}":
            return None
        f = _STATEMENTS.get(c)
        if f is not None:
            return f(self)
        if c == IDENT and self.s[self.p + 1] == ":":
            self.p += 2
            if self.s[self.p] != "}":
                self.statement()
            return None
        return self.simple()

    def simple(self) -> None:
        self.expressions()
        c = self.s[self.p]
        if c in _ASSIGN:
            self.p += 1
            if self.eat(K["range"]):
                self.expr()
            else:
                self.expressions()
        elif c in (K["++"], K["--"]):
            self.p += 1
        elif c == K["<-"]:
            self.p += 1
            self.expr()

    def header(self, f) -> None:
        before, self.literals = self.literals, False
        f()
        self.literals = before

    def if_(self) -> None:
        self.p += 1
        self.header(self.condition)
        self.body()
        if self.eat(K["else"]):
            if self.s[self.p] == K["if"]:
                self.if_()
            else:
                self.body()

    def condition(self) -> None:
        if self.s[self.p] != ";":
            self.simple()
        if self.eat(";"):
            self.simple()

    def for_(self) -> None:
        self.p += 1
        self.header(self.loop)
        self.body()

    def loop(self) -> None:
        if self.s[self.p] == "{":
            return
        if self.eat(K["range"]):
            self.expr()
            return
        if self.s[self.p] != ";":
            self.simple()
        if self.eat(";"):
            if self.s[self.p] != ";":
                self.simple()
            self.take(";")
            if self.s[self.p] != "{":
                self.simple()

    def switch(self) -> None:
        self.p += 1
        self.header(self.subject)
        self.cases()

    def subject(self) -> None:
        if self.s[self.p] not in "{;":
            self.simple()
        if self.eat(";") and self.s[self.p] != "{":
            self.simple()

    def cases(self) -> None:
        before, self.literals = self.literals, True
        self.take("{")
        while not self.eat("}"):
            if self.eat(K["case"]):
                self.case()
            else:
                self.take(K["default"])
            self.take(":")
            while self.s[self.p] not in (K["case"], K["default"], "}"):
                self.statement()
                self.semi()
        self.literals = before

    def case(self) -> None:
        while True:
            if not (self.attempt(self.simple) and self.s[self.p] in ",:"):
                raise Invalid("case")
            if not self.eat(","):
                return

    def select(self) -> None:
        self.p += 1
        self.cases()

    def return_(self) -> None:
        self.p += 1
        if self.s[self.p] not in ";}":
            self.expressions()

    def jump(self) -> None:
        self.p += 1
        self.eat(IDENT)

    def call(self) -> None:
        self.p += 1
        self.expr()

    # expressions
    def expressions(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def expr(self) -> None:
        while True:
            while self.s[self.p] in _PREFIX:
                self.p += 1
                if self.s[self.p - 1] == K["<-"] and self.s[self.p] == K["chan"]:
                    self.p -= 1
                    break
            self.operand()
            if self.s[self.p] not in _BINARY:
                return
            self.p += 1

    def operand(self) -> None:
        c = self.s[self.p]
        named = False
        if c == IDENT:
            self.p += 1
            named = True
        elif c in (NUMBER, STRING):
            self.p += 1
        elif c == "(":
            self.p += 1
            before, self.literals = self.literals, True
            if not (self.attempt(self.expr) and self.s[self.p] == ")"):
                self.p = self.p if self.s[self.p] != ")" else self.p
                self.type()
            self.literals = before
            self.take(")")
        elif c == K["func"]:
            self.p += 1
            self.signature()
            if self.s[self.p] == "{":
                self.body()
        elif c in ("[", K["map"], K["struct"], K["chan"], K["interface"], K["<-"]):
            self.type()
            if self.s[self.p] == "{":
                self.composite()
        else:
            raise Invalid(f"expected an operand at {self.p}")
        while True:
            c = self.s[self.p]
            if c == ".":
                self.p += 1
                if self.eat("("):
                    if not self.eat(K["type"]):
                        self.type()
                    self.take(")")
                    named = False
                else:
                    self.take(IDENT)
            elif c == "(":
                self.arguments()
                named = False
            elif c == "[":
                self.index()
            elif c == "{" and named and self.literals:
                self.composite()
                named = False
            else:
                return

    def index(self) -> None:
        self.take("[")
        before, self.literals = self.literals, True
        colons = 0
        while self.s[self.p] != "]":
            if self.eat(":"):
                colons += 1
                continue
            if not (self.attempt(self.expr) and self.s[self.p] in "]:,"):
                self.type()
            if self.s[self.p] == ",":
                self.p += 1
            elif self.s[self.p] not in "]:":
                raise Invalid("index")
        if self.s[self.p - 1] == "[":
            raise Invalid("index")
        self.literals = before
        self.take("]")

    def arguments(self) -> None:
        self.take("(")
        before, self.literals = self.literals, True
        while not self.eat(")"):
            if not (self.attempt(self.expr) and self.s[self.p] in ",)" + K["..."]):
                self.type()
            self.eat(K["..."])
            if self.s[self.p] != ")":
                self.take(",")
        self.literals = before

    def composite(self) -> None:
        before, self.literals = self.literals, True
        self.take("{")
        while not self.eat("}"):
            self.value()
            if self.eat(":"):
                self.value()
            if self.s[self.p] != "}":
                self.take(",")
        self.literals = before

    def value(self) -> None:
        if self.s[self.p] == "{":
            self.composite()
        else:
            self.expr()


_STATEMENTS = {
    K["if"]: Parser.if_, K["for"]: Parser.for_, K["switch"]: Parser.switch, K["select"]: Parser.select, K["return"]: Parser.return_, K["break"]: Parser.jump, K["continue"]: Parser.jump, K["goto"]: Parser.jump,
    K["fallthrough"]: Parser.jump, K["go"]: Parser.call, K["defer"]: Parser.call, K["var"]: Parser.declaration, K["const"]: Parser.declaration, K["type"]: Parser.declaration,
}


def check(text: str) -> str | None:
    """Why the text is invalid as a file or as top-level declarations; None if it is valid."""
    try:
        Parser(lex(text.removeprefix("﻿"))).unit()
    except Invalid as e:
        return str(e)
    except RecursionError:
        return None
    return None
