"""The grammar of Go source files."""

from __future__ import annotations

import re

from skerry.llm.grammar.base import Invalid, Parser, Token
from skerry.llm.grammar.statements import ARITHMETIC, DOUBLE, NAME, NUMBER, NUMBER_ROW, S, comma_list, plain_statement

#: Reserved words.
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
ASSIGN = frozenset("= := += -= |= ^= *= /= %= <<= >>= &= &^=".split())

_ESC = r"\\(?:[abfnrtv\\]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_LEX = re.compile(
    rf"""(?P<skip>[ \t\r]+|//[^\n]*)
    |(?P<block>/\*(?s:.*?)\*/)
    |(?P<feed>\n)
    |(?P<str>`[^`]*`|"(?:[^"\\\n]|{_ESC}|\\")*"|'(?:[^'\\\n]|{_ESC}|\\')')
    |(?P<num>0[xX](?:_?[0-9a-fA-F])+(?:\.(?:_?[0-9a-fA-F])*)?(?:[pP][+-]?[0-9]+)?i?|0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?|(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?i?)
    |(?P<id>[^\W\d]\w*+)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^!<>=~:;,.(){{}}\[\]])""",
    re.X,
)
_TYPE = rf"(?:\[\]|\*)*+{NAME}(?:\.{NAME})?"
#: Conditions of names and numbers, in which no brace can be taken for a literal.
_OPERAND = rf"!?{NAME}(?:\.{NAME})*+(?:\(\))?|{NUMBER}"
_HEAD = rf"(?:{_OPERAND})(?:{S}{ARITHMETIC}{S}(?:{_OPERAND}))*+"
_PLAIN = plain_statement(
    KEYWORDS, rf"(?:{DOUBLE.replace('0]', ']')}|`[^`]*+`|'(?:[^'\\\n]|\\[abfnrtv'\\])')", "true|false|nil",
    lambda ex: (rf"&?(?:map\[{NAME}\]{NAME}|\[\]{NAME}|{NAME}(?:\.{NAME})?)\{{" + comma_list(rf"(?:{ex}{S}:{S})?+{ex}", r"\}"),), ARITHMETIC, lambda ex: rf"(?:defer|go)[ ]+{NAME}(?:\.{NAME})*+\(" + comma_list(ex, r"\)"), r"(?=\n|//)", ternary=False, define=True, words="map",
    heads=lambda top: (rf"if[ ]+(?P<cond>{_HEAD})[ ]+(?=\{{)", rf"for[ ]+(?P<head>{_HEAD})[ ]+(?=\{{)", rf"for[ ]+(?:{NAME}(?:,{S}{NAME})?[ ]+:=[ ]+)?range[ ]+(?P<head>{NAME}(?:\.{NAME})*+)[ ]+(?=\{{)"),
    member=rf"func[ ]+(?:\({NAME}[ ]+\*?{NAME}\)[ ]+)?{NAME}\({S}(?:{NAME}[ ]+{_TYPE}{S}(?:,(?!{S}\)){S}|(?=\))))*+\)(?:[ ]+{_TYPE})?[ ]+(?=\{{)", types="func",
)
_ENDS = frozenset("break continue fallthrough return".split())


def _tokens(text: str, plain=None) -> list[Token]:
    """Tokens, with the semicolons that line ends stand for.

    With ``plain`` a statement that it matches, on a new line after a brace or a semicolon, is one
    token of kind stmt.
    """
    out: list[Token] = []
    at, n = 0, len(text)

    def feed() -> None:
        if out:
            t = out[-1]
            if t.kind in ("id", "num", "str") or (t.kind == "kw" and t.text in _ENDS) or (t.kind == "op" and t.text in ("++", "--", ")", "]", "}")):
                out.append(Token("op", ";", at, 1))

    fresh = False
    while at < n:
        if fresh and plain is not None and out and out[-1][1] in ("{", ";") and (found := plain.read(text, at)) is not None:
            out.append(Token("stmt" if found[0] == "returned" else found[0], "", at, 0))
            if found[0] in ("stmt", "returned"):
                out.append(Token("op", ";", at, 1))
            at = found[1]
            fresh = False
            continue
        if out and out[-1][1] in ("{", "[", "(", ",") and out[-1][0] == "op" and (m := NUMBER_ROW.match(text, at)) is not None:
            at = m.end()  # numbers with commas, before one more number
            continue
        m = _LEX.match(text, at)
        if m is None or m.end() == at:
            raise Invalid(f"no token {text[at : at + 20]!r} at {at}")
        kind, word = m.lastgroup, m.group()
        if kind == "feed" or (kind == "block" and "\n" in word):
            feed()
            fresh = True
        elif kind not in ("skip", "block"):
            fresh = False
            out.append(Token("kw" if kind == "id" and word in KEYWORDS else kind, word, at, 0))
        at = m.end()
    feed()
    out.append(Token("eof", "", n, 0))
    return out


class Go(Parser):
    #: Whether a brace after a type name starts a composite literal; not in the head of a statement.
    literals = True

    def end(self) -> None:
        if self.text not in (")", "}") and self.kind != "eof":
            self.need(";")

    def unit(self) -> None:
        self.need("package")
        self.name()
        self.need(";")
        while self.op("import"):
            self.group(self.import_spec)
            self.end()
        while self.kind != "eof":
            if self.kind == "member":
                self.i += 1
                self.block()
            elif self.text == "func":
                self.function_declaration()
            elif self.text == "import":
                self.fail("late")
            elif not self.declaration():
                self.fail()
            self.end()

    def group(self, rule) -> None:
        if self.op("("):
            while not self.op(")"):
                rule()
                self.end()
        else:
            rule()

    def import_spec(self) -> None:
        if self.kind == "id" or self.text == ".":
            self.i += 1
        if self.kind != "str" or self.tokens[self.i].text[0] == "'":
            self.fail("path expected, not")
        self.i += 1

    def declaration(self) -> bool:
        if self.op("var"):
            self.group(self.var_spec)
        elif self.op("const"):
            self.group(self.const_spec)
        elif self.op("type"):
            self.group(self.type_spec)
        else:
            return False
        return True

    def names(self) -> None:
        self.name()
        while self.op(","):
            self.name()

    def var_spec(self) -> None:
        self.names()
        if self.op("="):
            self.expressions()
            return
        self.type()
        if self.op("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if self.text not in ("=", ";", ")"):
            self.type()
        if self.op("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.text == "[" and self.ahead().text != "]":
            at = self.i
            if not self.attempt(self.type_parameters) or self.text in (";", ")"):
                self.i = at
        self.op("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        self.comma_list(self.type_parameter, "]", trailing=True)

    def type_parameter(self) -> None:
        self.names()
        self.constraint()

    def constraint(self) -> None:
        while True:
            self.op("~")
            self.type()
            if not self.op("|"):
                return

    def function_declaration(self) -> None:
        self.need("func")
        if self.text == "(":
            self.parameters()
        self.name()
        if self.text == "[":
            self.type_parameters()
        self.signature()
        if self.text == "{":
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.text == "(":
            self.parameters()
        elif self.is_type():
            self.type()

    def parameters(self) -> None:
        self.need("(")
        self.comma_list(self.parameter, ")", trailing=True)

    def parameter(self) -> None:
        if self.op("..."):
            self.type()
            return
        if self.kind == "id" and self.ahead().text != "." and self.ahead().text not in (",", ")"):
            at = self.i
            self.i += 1
            self.op("...")
            if self.attempt(self.type) and self.text in (",", ")"):
                return
            self.i = at
        self.type()

    def is_type(self) -> bool:
        return self.kind == "id" or self.text in ("[", "*", "(", "<-", "struct", "func", "interface", "map", "chan")

    def type(self) -> None:
        if self.kind == "id":
            self.i += 1
            if self.op("."):
                self.name()
            if self.text == "[" and self.ahead().text != "]":
                self.i += 1
                self.comma_list(self.type, "]", trailing=True)
        elif self.op("("):
            self.type()
            self.need(")")
        elif self.op("*"):
            self.type()
        elif self.op("["):
            if not self.op("]"):
                if not self.op("..."):
                    self.inside(self.expression)
                self.need("]")
            self.type()
        elif self.op("map"):
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif self.op("chan"):
            self.op("<-")
            self.type()
        elif self.op("<-"):
            self.need("chan")
            self.type()
        elif self.op("func"):
            self.signature()
        elif self.op("struct"):
            self.need("{")
            while not self.op("}"):
                self.field()
                self.end()
        elif self.op("interface"):
            self.need("{")
            while not self.op("}"):
                if self.kind == "id" and self.ahead().text == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            self.fail("type expected, not")

    def field(self) -> None:
        if self.text == "*" or (self.kind == "id" and self.ahead().text in (".", ";", "}")) or (self.kind == "id" and self.ahead().kind == "str"):
            self.type()
        elif self.kind == "id" and self.ahead().text == "[":
            at = self.i
            self.i += 1
            if not self.attempt(self.type):
                self.i = at
                self.type()
        else:
            self.names()
            self.type()
        if self.kind == "str":
            self.i += 1

    # statements

    def block(self) -> None:
        self.need("{")
        self.inside(self.statements)
        self.need("}")

    def statements(self) -> None:
        while self.text not in ("}", "case", "default") or self.kind == "id":
            if self.op(";"):
                continue
            if self.kind == "eof":
                self.fail("end")
            self.statement()
            if self.text != "}":
                self.need(";")

    def statement(self) -> None:
        kind = self.tokens[self.i][0]
        if kind == "stmt":
            self.i += 1
            return
        if kind == "cond" or kind == "head":
            self.i += 1
            self.block()
            if kind == "cond" and self.op("else"):
                if self.tokens[self.i][0] == "cond":
                    self.statement()
                elif self.op("if"):
                    self.if_rest()
                else:
                    self.block()
            return
        t = self.text if self.kind in ("kw", "op") else ""
        if self.declaration():
            pass
        elif t == "{":
            self.block()
        elif self.op("return"):
            if self.text not in (";", "}"):
                self.expressions()
        elif t in ("break", "continue", "goto"):
            self.i += 1
            if self.kind == "id":
                self.i += 1
            elif t == "goto":
                self.fail("label expected, not")
        elif self.op("fallthrough"):
            pass
        elif t in ("go", "defer"):
            self.i += 1
            if self.expression() != "call":
                self.fail("call expected before")
        elif self.op("if"):
            self.if_rest()
        elif self.op("for"):
            self.for_rest()
        elif self.op("switch"):
            self.switch_rest()
        elif self.op("select"):
            self.need("{")
            self.clauses(self.simple)
        elif self.kind == "id" and self.ahead().text == ":" and self.ahead().kind == "op":
            self.i += 2
            if self.text != "}":
                if not self.op(";"):
                    self.statement()
        else:
            self.simple()

    def head(self, rule) -> None:
        held, self.literals = self.literals, False
        try:
            rule()
        finally:
            self.literals = held

    def inside(self, rule):
        """Within brackets literals are plain again."""
        held, self.literals = self.literals, True
        try:
            return rule()
        finally:
            self.literals = held

    def if_rest(self) -> None:
        def condition() -> None:
            if self.text != ";" and self.simple(in_head=True) is not None and self.text == "{":
                return
            self.need(";")
            self.expression()

        self.head(condition)
        self.block()
        if self.op("else"):
            if self.op("if"):
                self.if_rest()
            else:
                self.block()

    def for_rest(self) -> None:
        def clause() -> None:
            if self.text == "{":
                return
            if self.op("range"):
                self.expression()
                return
            if self.text != ";":
                self.simple(in_head=True, ranges=True)
                if self.text == "{":
                    return
            self.need(";")
            if self.text != ";":
                self.expression()
            if self.text == "{":  # the line end after the condition was taken as its semicolon
                return
            self.need(";")
            if self.text != "{":
                self.simple(in_head=True)

        self.head(clause)
        self.block()

    def switch_rest(self) -> None:
        def tag() -> None:
            if self.text == "{":
                return
            if self.text != ";":
                self.simple(in_head=True)
            if self.op(";") and self.text != "{":
                self.simple(in_head=True)

        self.head(tag)
        self.need("{")

        def case() -> None:
            self.case_item()
            while self.op(","):
                self.case_item()

        self.clauses(case)

    def case_item(self) -> None:
        at = self.i
        if self.attempt(self.expression) and self.text in (",", ":"):
            return
        self.i = at
        self.type()

    def clauses(self, rule) -> None:
        while not self.op("}"):
            if not self.op("default"):
                self.need("case")
                self.inside(rule)
            self.need(":")
            self.inside(self.statements)

    def simple(self, in_head: bool = False, ranges: bool = False) -> str | None:
        """A simple statement; None for one that isn't an expression."""
        kind = self.expression()
        count = 1
        while self.op(","):
            self.expression()
            count += 1
        t = self.tokens[self.i]
        if t.kind == "op" and t.text in ASSIGN:
            self.i += 1
            if ranges and t.text in ("=", ":=") and self.op("range"):
                self.expression()
                return "range"
            self.expressions()
            return "assign"
        if count > 1:
            self.fail("assignment expected, not")
        if self.op("++") or self.op("--"):
            return "step"
        if self.op("<-"):
            self.expression()
            return "send"
        if not in_head and kind not in ("call", "receive"):
            self.fail("no statement before")
        return kind

    # expressions

    def expressions(self) -> None:
        self.expression()
        while self.op(","):
            self.expression()

    def expression(self) -> str:
        kind = self.unary()
        while self.kind == "op" and self.text in BINARY:
            self.i += 1
            self.unary()
            kind = "value"
        return kind

    def unary(self) -> str:
        if self.kind == "op" and self.text in ("+", "-", "!", "^", "*", "&", "~"):
            self.i += 1
            self.unary()
            return "value"
        if self.text == "<-" and self.kind == "op":
            if self.ahead().text == "chan":
                self.type()
                return self.postfix("value")
            self.i += 1
            self.unary()
            return "receive"
        return self.postfix(self.primary())

    def primary(self) -> str:
        t = self.tokens[self.i]
        if t.kind in ("num", "str"):
            self.i += 1
            return "value"
        if t.kind == "id":
            self.i += 1
            return "name"
        if t.kind == "op" and t.text == "(":
            self.i += 1

            def within() -> str:
                at = self.i
                kind = "value"
                if not (self.attempt(lambda: self.expression()) and self.text == ")"):
                    self.i = at
                    self.type()
                else:
                    self.i = at
                    kind = self.expression()
                return kind

            kind = self.inside(within)
            self.need(")")
            return kind if kind in ("call", "receive") else "paren"
        if t.text == "func":
            self.i += 1
            self.signature()
            if self.text == "{":
                self.inside(self.block)
            return "value"
        if t.text in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if self.text == "{":
                self.literal()
            elif self.text != "(" and self.text not in (",", ")", ":", "]"):
                self.fail()
            return "value"
        self.fail()
        return ""

    def literal(self) -> None:
        self.need("{")

        def element() -> None:
            self.element()
            if self.op(":"):
                self.element()

        self.inside(lambda: self.comma_list(element, "}", trailing=True))

    def element(self) -> None:
        if self.text == "{":
            self.literal()
        else:
            self.expression()

    def postfix(self, kind: str) -> str:
        named = kind == "name"
        while True:
            if self.op("."):
                if self.op("("):
                    if not self.op("type"):
                        self.type()
                    self.need(")")
                    named = False
                else:
                    self.name()
                kind = "value"
            elif self.text == "[" and self.kind == "op":
                self.i += 1
                self.inside(self.index)
                kind = "value"
            elif self.text == "(" and self.kind == "op":
                self.i += 1
                self.inside(lambda: self.comma_list(self.argument, ")", trailing=True))
                kind = "call"
                named = False
            elif self.text == "{" and named and self.literals:
                self.literal()
                kind = "value"
                named = False
            else:
                return "value" if kind in ("name", "paren") else kind

    def argument(self) -> None:
        at = self.i
        if not (self.attempt(lambda: self.expression()) and self.text in (",", ")", "...")):
            self.i = at
            self.type()
        self.op("...")

    def index(self) -> None:
        colons = 0
        while not self.op("]"):
            if self.op(":"):
                colons += 1
                if colons > 2:
                    self.fail()
            elif self.op(","):
                pass
            else:
                at = self.i
                if not (self.attempt(lambda: self.expression()) and self.text in (":", "]", ",")):
                    self.i = at
                    self.type()
                if self.text not in (":", "]", ","):
                    self.fail()


def parse_go(text: str) -> None:
    text = text.lstrip("\ufeff")
    try:
        Go(_tokens(text, _PLAIN)).unit()
    except Invalid:  # a plain statement where none may stand, or a text that isn't valid
        Go(_tokens(text)).unit()
