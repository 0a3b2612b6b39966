"""The grammar of Java source files."""

from __future__ import annotations

import re

from skerry.llm.grammar.base import Invalid, Parser, Token
from skerry.llm.grammar.statements import ARITHMETIC, DOUBLE, NAME, NUMBER_ROW, S, plain_statement

#: Reserved words.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements"
    " import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw"
    " throws transient try void volatile while true false null _".split()
)
PRIMITIVES = frozenset("boolean byte char short int long float double".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
BINARY = frozenset("+ - * / % & | ^ && || == != < > <= >= <<".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())

_ESCAPE = r"\\(?:[btnfrs\"'\\\n]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})"
_LEX = re.compile(
    rf'''(?P<skip>(?:[ \t\f\r\n]+|//[^\n]*|/\*(?s:.*?)\*/)+)
    |(?P<str>"""[ \t\f]*\n(?:[^\\"]|\\(?s:.)|"(?!""))*"""|"(?!"")(?:[^"\\\n]|{_ESCAPE})*"|""|'(?:[^'\\\n]|{_ESCAPE})'|'[\U00010000-\U0010ffff]')
    |(?P<num>0[xX](?:[0-9a-fA-F_]*\.?[0-9a-fA-F_]+\.?[pP][+-]?[0-9_]+[fFdD]?|[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?)|0[bB][01](?:[01_]*[01])?[lL]?|(?:[0-9](?:[0-9_]*[0-9])?\.?(?:[0-9](?:[0-9_]*[0-9])?)?|\.[0-9](?:[0-9_]*[0-9])?)(?:[eE][+-]?[0-9](?:[0-9_]*[0-9])?)?[fFdDlL]?)
    |(?P<id>(?:[^\W\d]|\$)[\w$]*+)
    |(?P<op><<=|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|->|::|\.\.\.|[-+*/%&|^!~<>=?:;,.@(){{}}\[\]])''',
    re.X,
)


_TYPE = rf"{NAME}(?:<{NAME}(?:,{S}{NAME})?>)?(?:\[\])?"
_PLAIN = plain_statement(
    KEYWORDS, rf"(?:{DOUBLE}|'(?:[^'\\\n]|\\[btnfr\"'\\])')", "true|false|null", lambda ex: (), ARITHMETIC,
    lambda ex: rf"(?:int|long|boolean|char|double|float|byte|short|{NAME}(?:<{NAME}(?:,{S}{NAME})?>)?)(?:\[\])?[ ]+{NAME}{S}=(?!=){S}{ex}", ";", arrow="->",
    heads=lambda top: (rf"if{S}\({S}(?P<cond>{top}){S}\){S}(?=\{{)", rf"(?:while|synchronized){S}\({S}(?P<head>{top}){S}\){S}(?=\{{)", rf"for{S}\({S}{_TYPE}[ ]+{NAME}{S}:{S}(?P<head>{top}){S}\){S}(?=\{{)"),
    member=rf"(?:(?:public|protected|private|static|final)[ ]+)*+(?:void|{_TYPE})[ ]+{NAME}\({S}(?:{_TYPE}[ ]+{NAME}{S}(?:,(?!{S}\)){S}|(?=\))))*+\){S}(?=\{{)",
    types="public protected private static final void int long boolean char double float byte short",
)


def tokens_of(text: str, lex, keywords: frozenset[str], plain=None) -> list[Token]:
    """Tokens; with ``plain`` a statement that it matches, right after a brace or a semicolon, is one token of kind stmt."""
    out = []
    at, n = 0, len(text)
    match = lex.match
    start = False  # whether a statement may start here
    while at < n:
        if start and plain is not None and (found := plain.read(text, at)) is not None:
            out.append(Token("stmt" if found[0] == "returned" else found[0], "", at, 0))
            at = found[1]
            start = found[0] in ("stmt", "returned")
            continue
        if out and out[-1][1] in ("{", "[", "(", ",") and out[-1][0] == "op" and (m := NUMBER_ROW.match(text, at)) is not None:
            at = m.end()  # numbers with commas, before one more number
            continue
        m = match(text, at)
        if m is None or m.end() == at:
            raise Invalid(f"no token {text[at : at + 20]!r} at {at}")
        kind = m.lastgroup
        end = m.end()
        if kind != "skip":
            word = m.group()
            if kind == "num" and end < n and (text[end].isalnum() or text[end] == "_"):
                raise Invalid(f"bad number at {at}")
            out.append(Token("kw" if kind == "id" and word in keywords else kind, word, at, 0))
            start = False
        elif out:
            last = out[-1]
            start = last[0] == "stmt" or last[0] == "op" and last[1] in "{};"
        at = end
    out.append(Token("eof", "", n, 0))
    return out


class Java(Parser):
    def unit(self) -> None:
        start = self.i
        self.annotations()
        if self.op("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = start
        while True:
            if self.op("import"):
                self.op("static")
                self.name()
                while self.op("."):
                    if self.op("*"):
                        break
                    self.name()
                self.need(";")
            elif not self.op(";"):
                break
        if self.is_module():
            self.module()
        while self.kind != "eof":
            if not self.op(";"):
                self.modifiers()
                if not self.type_declaration():
                    self.fail()

    def is_module(self) -> bool:
        k = self.ahead(1) if self.text == "open" else self.tokens[self.i]
        return k.text == "module" and k.kind == "id" and self.ahead(2 if self.text == "open" else 1).kind == "id"

    def module(self) -> None:
        self.word("open")
        self.word("module")
        self.qualified()
        end = self.closing()
        self.need("{")
        while self.i < end:
            if self.kind not in ("id", "kw"):
                self.fail()
            while not self.op(";"):
                if self.i >= end or not (self.kind in ("id", "kw") or self.text in (".", ",")):
                    self.fail()
                self.i += 1
        self.need("}")

    def qualified(self) -> None:
        self.name()
        while self.text == "." and self.ahead().kind == "id":
            self.i += 2

    def annotations(self) -> None:
        while self.text == "@" and self.ahead().text != "interface":
            self.i += 1
            self.qualified()
            if self.op("("):
                if self.op(")"):
                    continue
                if self.kind == "id" and self.ahead().text == "=":
                    self.comma_list(self.pair, ")")
                else:
                    self.element()
                    self.need(")")

    def pair(self) -> None:
        self.name()
        self.need("=")
        self.element()

    def element(self) -> None:
        if self.text == "@":
            self.annotations()
        elif self.op("{"):
            self.comma_list(self.element, "}", trailing=True)
        else:
            self.expression()

    def modifiers(self) -> None:
        while True:
            if self.text == "@" and self.ahead().text != "interface":
                self.annotations()
            elif self.kind == "kw" and self.text in MODIFIERS and not (self.text == "default" and self.ahead().text in (":", "->")):
                self.i += 1
            elif self.text in ("sealed",) and (self.ahead().kind in ("id", "kw")):
                self.i += 1
            elif self.text == "non" and self.ahead().text == "-" and self.ahead(2).text == "sealed":
                self.i += 3
            else:
                return

    # types

    def type(self, array: bool = True) -> None:
        self.annotations()
        if self.kind == "kw" and self.text in PRIMITIVES:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.text == "." and (self.ahead().kind == "id" or self.ahead().text == "@"):
                self.i += 1
                self.annotations()
                self.name()
                self.type_arguments()
        if array:
            self.dimensions()

    def dimensions(self) -> None:
        while True:
            at = self.i
            self.annotations()
            if self.text == "[" and self.ahead().text == "]":
                self.i += 2
            else:
                self.i = at
                return

    def type_arguments(self) -> None:
        if self.op("<"):
            if self.op(">"):
                return
            self.comma_list(self.type_argument, ">")

    def type_argument(self) -> None:
        self.annotations()
        if self.op("?"):
            if self.op("extends") or self.op("super"):
                self.type()
        else:
            self.type()

    def type_parameters(self) -> None:
        if self.op("<"):
            self.comma_list(self.type_parameter, ">")

    def type_parameter(self) -> None:
        self.annotations()
        self.name()
        if self.op("extends"):
            self.type()
            while self.op("&"):
                self.type()

    def types(self) -> None:
        self.type()
        while self.op(","):
            self.type()

    # declarations

    def type_declaration(self) -> bool:
        if self.op("class"):
            self.name()
            self.type_parameters()
            if self.op("extends"):
                self.type()
            if self.op("implements"):
                self.types()
            if self.word("permits"):
                self.types()
            self.body()
        elif self.op("interface"):
            self.name()
            self.type_parameters()
            if self.op("extends"):
                self.types()
            if self.word("permits"):
                self.types()
            self.body()
        elif self.op("enum"):
            self.name()
            if self.op("implements"):
                self.types()
            self.enum_body()
        elif self.text == "@" and self.ahead().text == "interface":
            self.i += 2
            self.name()
            self.body()
        elif self.text == "record" and self.ahead().kind == "id" and self.ahead(2).text in ("(", "<"):
            self.i += 1
            self.name()
            self.type_parameters()
            self.need("(")
            self.comma_list(self.parameter, ")")
            if self.op("implements"):
                self.types()
            self.body()
        else:
            return False
        return True

    def enum_body(self) -> None:
        self.need("{")
        while self.kind == "id" or self.text == "@":
            self.annotations()
            self.name()
            if self.op("("):
                self.comma_list(self.expression, ")")
            if self.text == "{":
                self.body()
            if not self.op(","):
                break
        if self.op(";"):
            self.members()
        self.need("}")

    def body(self) -> None:
        self.need("{")
        self.members()
        self.need("}")

    def members(self) -> None:
        while self.text != "}":
            if self.tokens[self.i][0] == "member":
                self.i += 1
                self.block()
                continue
            if self.op(";"):
                continue
            if self.text == "{" or (self.text == "static" and self.ahead().text == "{"):
                self.op("static")
                self.block()
                continue
            self.modifiers()
            if self.type_declaration():
                continue
            self.type_parameters()
            self.annotations()
            if self.kind == "id" and self.ahead().text == "(":
                self.i += 1
                self.method_rest(constructor=True)
            elif self.kind == "id" and self.ahead().text == "{":  # compact constructor
                self.i += 1
                self.block()
            elif self.op("void"):
                self.name()
                self.method_rest()
            else:
                self.type()
                self.name()
                if self.text == "(":
                    self.method_rest()
                else:
                    self.declarators_rest()
                    self.need(";")

    def method_rest(self, constructor: bool = False) -> None:
        self.need("(")
        self.comma_list(self.parameter, ")")
        self.dimensions()
        if self.op("throws"):
            self.types()
        if self.text == "{":
            self.block()
            return
        if self.op("default"):
            self.element()
        if constructor:
            self.fail("body expected, not")
        self.need(";")

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        self.annotations()
        self.op("...")
        if self.op("this"):
            return
        if self.kind == "id" and self.ahead().text == "." and self.ahead(2).text == "this":
            self.i += 3
            return
        if not self.op("_"):
            self.name()
        self.dimensions()

    def declarators_rest(self) -> None:
        """After the first name."""
        while True:
            self.dimensions()
            if self.op("="):
                self.initializer()
            if not self.op(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.op("{"):
            self.comma_list(self.initializer, "}", trailing=True)
        else:
            self.expression()

    # statements

    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement(True)

    def declaration_start(self) -> bool:
        """Reads a type and a name, if a local declaration starts here."""

        def rule() -> None:
            self.type()
            if not self.op("_"):
                self.name()
            if self.text not in ("=", ";", ",", "[", ":"):
                raise Invalid

        return (self.kind in ("id", "kw") or self.text == "@") and self.attempt(rule)

    def statement(self, declarations: bool = False) -> None:
        kind = self.tokens[self.i][0]
        if kind == "stmt":
            self.i += 1
            return
        if kind == "cond" or kind == "head":
            self.i += 1
            self.block()
            if kind == "cond" and self.op("else"):
                self.statement()
            return
        t = self.text
        if t == "{":
            self.block()
        elif self.op(";"):
            pass
        elif self.op("if"):
            self.condition()
            self.statement()
            if self.op("else"):
                self.statement()
        elif self.op("while"):
            self.condition()
            self.statement()
        elif self.op("do"):
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif self.op("for"):
            self.for_rest()
        elif self.op("return"):
            if not self.op(";"):
                self.expression()
                self.need(";")
        elif self.op("throw"):
            self.expression()
            self.need(";")
        elif self.op("break") or self.op("continue"):
            if self.kind == "id":
                self.i += 1
            self.need(";")
        elif self.op("assert"):
            self.expression()
            if self.op(":"):
                self.expression()
            self.need(";")
        elif t == "synchronized" and self.ahead().text == "(":
            self.i += 1
            self.condition()
            self.block()
        elif self.op("try"):
            self.try_rest()
        elif self.kind == "kw" and t == "switch":
            self.i += 1
            self.switch_rest()
            if self.text in (".", "?") or self.text in BINARY:
                self.fail()
        elif t == "yield" and self.kind == "id" and self.ahead().text not in ("=", ".", "(", "[", "++", "--", "+=", "-="):
            self.i += 1
            self.expression()
            self.need(";")
        elif self.kind == "id" and self.ahead().text == ":" and self.ahead().kind == "op":
            self.i += 2
            self.statement()
        else:
            if declarations:
                at = self.i
                self.modifiers()
                if self.type_declaration():
                    return
                if self.declaration_start():
                    self.declarators_rest()
                    self.need(";")
                    return
                if self.i != at:
                    self.fail()
            self.expression_statement()
            self.need(";")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def expression_statement(self) -> None:
        if self.expression() not in ("assign", "call", "new", "step"):
            self.fail("no statement before")

    def for_rest(self) -> None:
        self.need("(")
        at = self.i
        self.modifiers()
        if self.declaration_start():
            if self.op(":"):
                self.expression()
                self.need(")")
                self.statement()
                return
            self.declarators_rest()
        else:
            if self.i != at:
                self.fail()
            if self.text != ";":
                self.expression_statement()
                while self.op(","):
                    self.expression_statement()
        self.need(";")
        if self.text != ";":
            self.expression()
        self.need(";")
        if self.text != ")":
            self.expression_statement()
            while self.op(","):
                self.expression_statement()
        self.need(")")
        self.statement()

    def try_rest(self) -> None:
        resources = False
        if self.op("("):
            resources = True
            while True:
                self.modifiers()
                if self.declaration_start():
                    self.need("=")
                self.expression()
                if self.op(";"):
                    if self.op(")"):
                        break
                    continue
                self.need(")")
                break
        self.block()
        handlers = False
        while self.op("catch"):
            handlers = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.op("|"):
                self.type()
            if not self.op("_"):
                self.name()
            self.need(")")
            self.block()
        if self.op("finally"):
            handlers = True
            self.block()
        if not (handlers or resources):
            self.fail("catch expected, not")

    def switch_rest(self) -> None:
        self.condition()
        self.need("{")
        while not self.op("}"):
            if self.op("default"):
                pass
            else:
                self.need("case")
                self.case_label()
                while self.op(","):
                    self.case_label()
                if self.word("when"):
                    self.expression(arrow_ends=True)
            if self.op("->"):
                if self.text == "{":
                    self.block()
                elif self.op("throw"):
                    self.expression()
                    self.need(";")
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not (self.text in ("}", "case") or (self.text == "default" and self.ahead().text in (":", "->"))):
                    self.statement(True)

    def case_label(self) -> None:
        if self.op("default"):
            return
        if not self.attempt(self.case_pattern):
            self.expression(arrow_ends=True)

    def case_pattern(self) -> None:
        self.pattern()
        if self.text not in (":", "->", ",", "when"):
            raise Invalid

    def pattern(self) -> None:
        self.modifiers()
        if self.op("_"):
            return
        self.type()
        if self.op("("):
            self.comma_list(self.pattern, ")")
            if self.kind == "id" and self.text != "when":
                self.i += 1
        elif not self.op("_"):
            self.name()

    # expressions; each rule gives what it has read: assign, call, new, step, target or value

    def is_lambda(self) -> bool:
        if self.kind == "id" or self.text == "_":
            return self.ahead().text == "->" and self.ahead().kind == "op"
        if self.text == "(":
            t = self.tokens[self.closing() + 1]
            return t.kind == "op" and t.text == "->"
        return False

    def lambda_(self) -> None:
        if self.op("("):
            self.comma_list(self.lambda_parameter, ")")
        else:
            self.i += 1
        self.need("->")
        if self.text == "{":
            self.block()
        else:
            self.expression()

    def lambda_parameter(self) -> None:
        if (self.kind == "id" or self.text == "_") and self.ahead().text in (",", ")"):
            self.i += 1
        else:
            self.parameter()

    def expression(self, arrow_ends: bool = False) -> str:
        if not arrow_ends and self.is_lambda():
            self.lambda_()
            return "value"
        kind = self.unary(arrow_ends)
        while True:
            t = self.tokens[self.i]
            if t.kind == "op" and t.text in ASSIGN:
                if kind != "target":
                    self.fail("no target before")
                self.i += 1
                self.expression()
                return "assign"
            if t.kind == "op" and t.text in BINARY:
                self.i += 1
                if t.text == ">":  # shifts are read as adjacent signs
                    at = t.at
                    while self.text == ">" and self.tokens[self.i].at == at + 1:
                        at += 1
                        self.i += 1
                    if self.text == ">=" and self.tokens[self.i].at == at + 1:
                        if kind != "target":
                            self.fail("no target before")
                        self.i += 1
                        self.expression()
                        return "assign"
                if not arrow_ends and self.is_lambda():
                    self.fail()
                self.unary(arrow_ends)
                kind = "value"
            elif self.op("instanceof"):
                if not self.attempt(self.pattern):
                    self.modifiers()
                    self.type()
                kind = "value"
            elif self.op("?"):
                self.expression()
                self.need(":")
                self.expression(arrow_ends)
                return "value"
            else:
                return kind

    def is_cast(self) -> bool:
        """Whether a type in parentheses and an operand start here."""
        end = self.closing()
        primitive = self.ahead().text in PRIMITIVES and self.ahead().kind == "kw"
        at = self.i

        def rule() -> None:
            self.i += 1
            self.type()
            while self.op("&"):
                self.type()
            if self.i != end:
                raise Invalid

        found = self.attempt(rule)
        self.i = at
        if not found:
            return False
        after = self.tokens[end + 1]
        if primitive and self.tokens[end - 1].text != "]":
            return True
        return after.kind in ("id", "num", "str") or (after.kind == "op" and after.text in ("(", "!", "~")) or (after.kind == "kw" and after.text in ("this", "super", "new", "true", "false", "null", "switch") or after.text in PRIMITIVES)

    def unary(self, arrow_ends: bool = False) -> str:
        t = self.text
        if self.kind == "op":
            if t in ("++", "--"):
                self.i += 1
                if self.unary(arrow_ends) != "target":
                    self.fail("no target before")
                return "step"
            if t in ("+", "-", "!", "~"):
                self.i += 1
                self.unary(arrow_ends)
                return "value"
            if t == "(" and self.is_cast():
                self.i = self.closing() + 1
                if not arrow_ends and self.is_lambda():
                    self.lambda_()
                else:
                    self.unary(arrow_ends)
                return "value"
        return self.postfix(self.primary())

    def primary(self) -> str:
        t = self.tokens[self.i]
        if t.kind in ("num", "str"):
            self.i += 1
            return "value"
        if t.kind == "id":
            # a generic type before a method reference
            def rule() -> None:
                self.type()
                if self.text != "::":
                    raise Invalid

            if self.ahead().text in ("<", "[") and self.attempt(rule):
                return "value"
            self.i += 1
            return "target"
        if t.kind == "kw":
            if t.text in ("true", "false", "null"):
                self.i += 1
                return "value"
            if t.text in ("this", "super"):
                self.i += 1
                if self.text == "(":
                    return "value"
                if t.text == "super" and self.text not in (".", "::"):
                    self.fail()
                return "value"
            if t.text == "new":
                self.i += 1
                return self.creation()
            if t.text == "switch":
                self.i += 1
                self.switch_rest()
                return "value"
            if t.text in PRIMITIVES or t.text == "void":
                self.i += 1
                self.dimensions()
                if self.text == "::" and self.ahead().text == "new":
                    return "value"
                self.need(".")
                self.need("class")
                return "value"
        if self.op("("):
            kind = self.expression()
            self.need(")")
            return "target" if kind == "target" else "value"
        self.fail()
        return ""

    def creation(self) -> str:
        self.type_arguments()
        self.type(array=False)
        if self.text == "[":
            sized = False
            while self.text == "[" and self.ahead().text != "]":
                self.i += 1
                self.expression()
                self.need("]")
                sized = True
            self.dimensions()
            if self.text == "{":
                if sized:
                    self.fail()
                self.initializer()
            elif not sized:
                self.fail()
            return "value"
        self.need("(")
        self.comma_list(self.expression, ")")
        if self.text == "{":
            self.body()
        return "new"

    def postfix(self, kind: str) -> str:
        while True:
            if self.op("."):
                self.type_arguments()
                if self.op("new"):
                    kind = self.creation()
                elif self.op("class") or self.op("this") or self.op("super"):
                    kind = "value"
                else:
                    self.name()
                    kind = "target"
            elif self.text == "[":
                if self.ahead().text == "]":
                    self.dimensions()
                    if self.text != "::":
                        self.need(".")
                        self.need("class")
                    kind = "value"
                else:
                    self.i += 1
                    self.expression()
                    self.need("]")
                    kind = "target"
            elif self.text == "(" and self.kind == "op":
                if kind == "value" and self.tokens[self.i - 1].text not in ("this", "super"):
                    self.fail()
                if kind not in ("target", "value"):
                    self.fail()
                self.i += 1
                self.comma_list(self.expression, ")")
                kind = "call"
            elif self.op("::"):
                self.type_arguments()
                if not self.op("new"):
                    self.name()
                kind = "value"
            elif self.text in ("++", "--") and self.kind == "op":
                if kind != "target":
                    self.fail("no target before")
                self.i += 1
                kind = "step"
            else:
                return kind


def parse_java(text: str) -> None:
    text = text.lstrip("\ufeff").removesuffix("\x1a")
    try:
        Java(tokens_of(text, _LEX, KEYWORDS, _PLAIN)).unit()
    except Invalid:  # a plain statement where none may stand, or a text that isn't valid
        Java(tokens_of(text, _LEX, KEYWORDS)).unit()
