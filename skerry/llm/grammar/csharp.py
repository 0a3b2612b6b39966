"""The grammar of C# source files."""

from __future__ import annotations

import re

from skerry.llm.grammar.base import Invalid, Parser, Token
from skerry.llm.grammar.statements import ARITHMETIC, DOUBLE, NAME, NUMBER_ROW, S, comma_list, plain_statement

#: Reserved words.
KEYWORDS = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false"
    " finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private"
    " protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked"
    " unsafe ushort using virtual void volatile while".split()
)
PREDEFINED = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
MODIFIERS = frozenset("abstract const extern fixed internal new override private protected public readonly ref sealed static unsafe virtual volatile".split())
SOFT_MODIFIERS = frozenset("async partial required file scoped".split())
BINARY = frozenset("+ - * / % & | ^ && || ?? == != < > <= >= << ..".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= ??=".split())
OVERLOADABLE = frozenset("+ - ! ~ ++ -- true false * / % & | ^ << == != < > <= >=".split())

_ESC = r"\\(?:['\"\\0abfnrtve]|x[0-9a-fA-F]{1,4}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_LEX = re.compile(
    rf'''(?P<skip>(?:[\s\ufeff]+|//[^\n]*|/\*(?s:.*?)\*/)+)
    |(?P<str>(?P<raw>"{{3,}})(?s:.*?)(?P=raw)"*(?:u8)?|@"(?:[^"]|"")*"(?:u8)?|"(?:[^"\\\n]|{_ESC})*"(?:u8)?|'(?:[^'\\\n]|{_ESC})')
    |(?P<hole>\$+@?"|@\$")
    |(?P<num>0[xX](?:_*[0-9a-fA-F])+[uUlL]{{0,2}}|0[bB](?:_*[01])+[uUlL]{{0,2}}|(?:[0-9](?:_*[0-9])*)?\.?[0-9](?:_*[0-9])*(?:[eE][+-]?[0-9](?:_*[0-9])*)?(?:[fFdDmM]|[uUlL]{{0,2}}))
    |(?P<id>@?[^\W\d]\w*+)
    |(?P<op><<=|\?\?=|\+\+|--|&&|\|\||\?\?|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|->|=>|::|\.\.|[-+*/%&|^!~<>=?:;,.(){{}}\[\]])''',
    re.X,
)
_TYPE = rf"{NAME}(?:<{NAME}(?:,{S}{NAME})?>)?(?:\[\])?\??"
_PLAIN = plain_statement(
    KEYWORDS | {"await", "yield", "from"}, rf"(?:{DOUBLE}|@\"[^\"\n]*+\"(?!\")|'(?:[^'\\\n]|\\[btnfr\"'\\0])')", "true|false|null", lambda ex: (), rf"(?:\?\?(?!=)|{ARITHMETIC})",
    lambda ex: rf"(?:int|long|bool|char|double|float|string|object|{NAME}(?:<{NAME}(?:,{S}{NAME})?>)?)(?:\[\])?[ ]+{NAME}{S}=(?![=>]){S}{ex}|await[ ]+{NAME}(?:\.{NAME})*+\(" + comma_list(ex, r"\)"), ";", arrow="=>",
    heads=lambda top: (rf"if{S}\({S}(?P<cond>{top}){S}\){S}(?=\{{)", rf"(?:while|lock){S}\({S}(?P<head>{top}){S}\){S}(?=\{{)", rf"foreach{S}\({S}{_TYPE}[ ]+{NAME}[ ]+in[ ]+(?P<head>{top}){S}\){S}(?=\{{)"),
    member=rf"(?:(?:public|protected|private|internal|static|override|virtual|async)[ ]+)*+(?:void|{_TYPE})[ ]+{NAME}\({S}(?:{_TYPE}[ ]+{NAME}{S}(?:,(?!{S}\)){S}|(?=\))))*+\){S}(?=\{{)",
    types="public protected private internal static override virtual void int long bool char double float string object byte short decimal",
)
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w+)?[ \t]*(.*)$")


def _condition(text: str) -> bool:
    """A preprocessor condition with no symbol defined."""
    words = re.findall(r"\w+|&&|\|\||[!()]|==|!=", re.sub(r"//.*", "", text))
    table = {"&&": " and ", "||": " or ", "!": " not ", "(": "(", ")": ")", "==": "==", "!=": "!=", "true": "True", "false": "False"}
    try:
        return bool(eval("".join(table.get(w, "False") for w in words), {"__builtins__": {}}))  # noqa: S307 - only the words of the table
    except SyntaxError as e:
        raise Invalid("bad condition") from e


_LITERAL = re.compile(r'"{3,}(?s:.*?)"{3,}|\$?@\$?"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'|//[^\n]*|/\*(?s:.*?)\*/')


def _preprocessed(text: str) -> str:
    """The text with directives and disabled parts blanked, positions and lines kept."""
    if not re.search(r"^[ \t]*#", text, re.M):
        return text
    inside: set[int] = set()  # starts of lines that lie in a literal or a comment
    for m in _LITERAL.finditer(text):
        for f in re.finditer("\n", m.group()):
            inside.add(m.start() + f.end())
    out, stack, at = [], [], 0
    for line in text.split("\n"):
        m = _DIRECTIVE.match(line) if at not in inside or (stack and not stack[-1][0]) else None
        active = all(s[0] for s in stack)
        if m is None:
            out.append(line if active else "")
        else:
            out.append("")
            word, rest = m.group(1), m.group(2)
            if word == "if":
                on = active and _condition(rest)
                stack.append([on, on or not active])
            elif word in ("elif", "else", "endif"):
                if not stack:
                    raise Invalid(f"#{word} without #if")
                if word == "endif":
                    stack.pop()
                else:
                    on = not stack[-1][1] and (word == "else" or _condition(rest))
                    stack[-1] = [on, stack[-1][1] or on]
            elif active and word not in ("region", "endregion", "define", "undef", "pragma", "nullable", "line", "error", "warning", "r", "load"):
                raise Invalid(f"bad directive {line[:30]!r}")
        at += len(line) + 1
    if stack:
        raise Invalid("#if without #endif")
    return "\n".join(out)


def _interpolated(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """The end of the interpolated string that starts at ``at``, and its holes."""
    m = re.compile(r'(\$*)(@?)(\$?)("+)').match(text, at)
    dollars = len(m.group(1)) + len(m.group(3))
    verbatim = m.group(2) == "@"
    quotes = len(m.group(4))
    raw = quotes >= 3 and not verbatim
    if not raw:
        if quotes >= 2 and not verbatim:
            return m.start(4) + 2, []
        i = m.start(4) + 1
    else:
        i = m.end()
    holes = []
    n = len(text)
    while i < n:
        c = text[i]
        if c == '"':
            if raw:
                k = i
                while k < n and text[k] == '"':
                    k += 1
                if k - i >= quotes:
                    return k, holes
                i = k
                continue
            if verbatim and text.startswith('""', i):
                i += 2
                continue
            return i + 1, holes
        if c == "\\" and not verbatim and not raw:
            i += 2
            continue
        if c == "\n" and not verbatim and not raw:
            break
        if c == "{":
            k = i
            while k < n and text[k] == "{":
                k += 1
            run = k - i
            if raw:
                if run < dollars:
                    i = k
                    continue
            elif run % 2 == 0:
                i = k
                continue
            end = _hole_end(text, k)
            holes.append((k, end))
            i = end + (dollars if raw else 1)
            continue
        if c == "}" and not raw:
            if not text.startswith("}}", i):
                break
            i += 2
            continue
        i += 1
    raise Invalid(f"unclosed string at {at}")


def _hole_end(text: str, at: int) -> int:
    """Where the hole that starts at ``at`` ends, at its closing brace."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == '"' or text.startswith(('$"', '@"', '$@"', '@$"'), i):
            if c == '"':
                m = _LEX.match(text, i)
                if m is None:
                    break
                i = m.end()
            elif text.startswith('@"', i):
                m = _LEX.match(text, i)
                if m is None:
                    break
                i = m.end()
            else:
                i, _ = _interpolated(text, i)
            continue
        if c == "'":
            m = _LEX.match(text, i)
            if m is None or m.lastgroup != "str":
                i += 1  # within a format
                continue
            i = m.end()
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if c == "}" and depth == 0:
                return i
            depth -= 1
        i += 1
    raise Invalid(f"unclosed hole at {at}")


def _tokens(text: str, plain=None) -> list[Token]:
    """Tokens; with ``plain`` a statement that it matches, right after a brace or a semicolon, is one token of kind stmt."""
    out: list[Token] = []
    at, n = 0, len(text)
    start = False
    while at < n:
        if start and plain is not None and (found := plain.read(text, at)) is not None:
            out.append(Token("stmt" if found[0] == "returned" else found[0], "", at, 0))
            at = found[1]
            start = found[0] in ("stmt", "returned")
            continue
        if out and out[-1][1] in ("{", "[", "(", ",") and out[-1][0] == "op" and (m := NUMBER_ROW.match(text, at)) is not None:
            at = m.end()  # numbers with commas, before one more number
            continue
        m = _LEX.match(text, at)
        if m is None or m.end() == at:
            raise Invalid(f"no token {text[at : at + 20]!r} at {at}")
        kind, end = m.lastgroup, m.end()
        if kind == "raw":
            kind = "str"
        if kind == "hole":
            end, holes = _interpolated(text, at)
            for a, b in holes:
                _hole(text[a:b])
            out.append(Token("str", "", at, 0))
            start = False
        elif kind == "skip":
            start = bool(out) and (out[-1][0] == "stmt" or out[-1][0] == "op" and out[-1][1] in "{};")
        else:
            start = False
            word = m.group()
            if kind == "num" and end < n and (text[end].isalnum() or text[end] == "_"):
                raise Invalid(f"bad number at {at}")
            out.append(Token("kw" if kind == "id" and word in KEYWORDS else kind, word, at, 0))
        at = end
    out.append(Token("eof", "", n, 0))
    return out


def _hole(text: str) -> None:
    """The hole of an interpolated string: expression, alignment, format."""
    depth = 0
    cut = len(text)
    i = 0
    while i < len(text):
        c = text[i]
        if c == '"' or c == "'" or text.startswith(('$"', '@"', '$@"', '@$"'), i):
            m = _LEX.match(text, i)
            if m is None:
                raise Invalid("bad hole")
            i = _interpolated(text, i)[0] if m.lastgroup == "hole" else m.end()
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            if text.startswith("::", i):
                i += 2
                continue
            cut = i
            break
        i += 1
    p = CSharp(_tokens(text[:cut]))
    p.expression()
    if p.op(","):
        p.expression()
    if p.kind != "eof":
        p.fail()


class CSharp(Parser):
    def unit(self) -> None:
        while self.text == "extern" and self.ahead().text == "alias":
            self.i += 2
            self.name()
            self.need(";")
        while self.is_using():
            self.using_directive()
        while self.text == "[" and self.ahead().text in ("assembly", "module"):
            self.attributes()
        self.namespace_members(top=True)
        if self.kind != "eof":
            self.fail()

    def is_using(self) -> bool:
        if self.text == "global" and self.ahead().text == "using":
            return True
        return self.text == "using" and self.ahead().text != "(" and not (self.ahead().text == "var" or self.ahead(1).kind == "kw" and self.ahead(1).text in PREDEFINED and self.ahead(2).kind == "id" or self.ahead(1).text == "await") and not (self.ahead(1).kind == "id" and self.ahead(2).kind == "id")

    def using_directive(self) -> None:
        self.word("global")
        self.need("using")
        self.op("static")
        self.op("unsafe")
        if self.kind == "id" and self.ahead().text == "=":
            self.i += 2
        self.type()
        self.need(";")

    def namespace_members(self, top: bool = False) -> None:
        seen = False
        while self.kind != "eof" and self.text != "}":
            if self.op(";"):
                continue
            if not seen and self.is_using():
                self.using_directive()
                continue
            if self.text == "namespace":
                self.i += 1
                self.name()
                while self.op("."):
                    self.name()
                if self.op(";"):
                    while self.is_using():
                        self.using_directive()
                    self.namespace_members()
                else:
                    self.need("{")
                    self.namespace_members()
                    self.need("}")
                    self.op(";")
                seen = True
                continue
            at = self.i
            self.attributes()
            self.modifiers()
            if self.type_declaration():
                seen = True
            elif top and not seen:
                self.i = at
                self.statement()
            else:
                self.fail()

    def attributes(self) -> None:
        while self.op("["):
            if (self.kind in ("id", "kw")) and self.ahead().text == ":" and self.ahead().kind == "op":
                self.i += 2
            while not self.op("]"):
                self.type(array=False)
                if self.op("("):
                    self.comma_list(self.argument, ")")
                if self.text != "]":
                    self.need(",")

    def modifiers(self) -> None:
        while True:
            t = self.tokens[self.i]
            if t.kind == "kw" and t.text in MODIFIERS and not (t.text == "new" and self.ahead().text == "("):
                self.i += 1
            elif t.kind == "id" and t.text in SOFT_MODIFIERS and self.ahead().kind in ("id", "kw") and self.ahead().text not in ("is", "as", "in"):
                self.i += 1
            else:
                return

    # types

    def type(self, array: bool = True, nullable: bool = True) -> None:
        if self.op("ref"):
            self.op("readonly")
        if self.op("delegate"):
            self.need("*")
            if self.word("managed") or self.word("unmanaged"):
                if self.op("["):
                    self.comma_list(self.name, "]")
            self.need("<")
            self.comma_list(self.type, ">")
        elif self.kind == "kw" and self.text in PREDEFINED:
            self.i += 1
        elif self.op("("):
            self.comma_list(self.tuple_element, ")")
        else:
            self.name()
            if self.op("::"):
                self.name()
            self.type_arguments()
            while self.text == "." and self.ahead().kind == "id":
                self.i += 1
                self.name()
                self.type_arguments()
        while True:
            if nullable and self.text == "?" and self.kind == "op":
                self.i += 1
            elif self.text == "*" and self.kind == "op" and self.ahead().kind == "id" or self.text == "*" and self.ahead().text in ("*", ")", ">", ","):
                self.i += 1
            elif array and self.text == "[" and self.ahead().text in ("]", ","):
                self.i += 1
                while self.op(","):
                    pass
                self.need("]")
            else:
                return

    def tuple_element(self) -> None:
        self.type()
        if self.kind == "id":
            self.i += 1

    def type_arguments(self) -> None:
        if self.text == "<" and self.kind == "op":
            self.i += 1
            if self.text in (",", ">") and self.kind == "op":
                while self.op(","):
                    pass
                self.need(">")
                return
            self.comma_list(self.type_argument, ">")

    def type_argument(self) -> None:
        self.attributes()
        self.op("in") or self.op("out")
        self.type()

    def constraints(self) -> None:
        while self.text == "where" and self.kind == "id":
            self.i += 1
            self.name()
            self.need(":")
            while True:
                if self.op("new"):
                    self.need("(")
                    self.need(")")
                elif self.op("class") or self.op("struct"):
                    self.op("?")
                elif self.op("default"):
                    pass
                elif self.text == "allows":
                    self.i += 1
                    self.need("ref")
                    self.need("struct")
                else:
                    self.type()
                if not self.op(","):
                    break

    # declarations

    def type_declaration(self) -> bool:
        if self.op("class") or self.op("struct") or self.op("interface") or (
            self.text == "record" and self.kind == "id" and (self.ahead().kind == "id" or self.ahead().text in ("class", "struct")) and self.ahead(2).text in ("(", "{", ";", ":", "<", "where") + (() if self.ahead().kind == "id" else (self.ahead(2).text,)) and self.record()
        ):
            self.name()
            self.type_arguments()
            if self.op("("):
                self.comma_list(self.parameter, ")")
            if self.op(":"):
                while True:
                    self.type()
                    if self.op("("):
                        self.comma_list(self.argument, ")")
                    if not self.op(","):
                        break
            self.constraints()
            if not self.op(";"):
                self.need("{")
                while not self.op("}"):
                    if not self.op(";"):
                        self.member()
                self.op(";")
        elif self.op("enum"):
            self.name()
            if self.op(":"):
                self.type()
            self.need("{")
            while not self.op("}"):
                self.attributes()
                self.name()
                if self.op("="):
                    self.expression()
                if self.text != "}":
                    self.need(",")
            self.op(";")
        elif self.text == "delegate" and self.ahead().text not in ("(", "{", "*"):
            self.i += 1
            self.type()
            self.name()
            self.type_arguments()
            self.need("(")
            self.comma_list(self.parameter, ")")
            self.constraints()
            self.need(";")
        else:
            return False
        return True

    def record(self) -> bool:
        self.i += 1
        self.op("class") or self.op("struct")
        return True

    def member(self) -> None:
        if self.tokens[self.i][0] == "member":
            self.i += 1
            self.block()
            return
        self.attributes()
        self.modifiers()
        if self.type_declaration():
            return
        if self.op("~"):
            self.name()
            self.need("(")
            self.need(")")
            self.method_body()
            return
        if self.op("event"):
            self.type()
            self.member_name()
            if self.text == "{":
                self.accessors()
            else:
                self.declarators_rest()
                self.need(";")
            return
        if self.op("implicit") or self.op("explicit"):
            self.need("operator")
            self.op("checked")
            self.type()
            self.need("(")
            self.comma_list(self.parameter, ")")
            self.method_body()
            return
        if self.kind == "id" and self.ahead().text == "(" and self.ahead().kind == "op" and self.tokens[self.match[self.i + 1] + 1].text in ("{", "=>", ":", ";"):
            self.i += 2
            self.comma_list(self.parameter, ")")
            if self.op(":"):
                if not (self.op("base") or self.op("this")):
                    self.fail()
                self.need("(")
                self.comma_list(self.argument, ")")
            self.method_body()
            return
        self.type()
        if self.op("operator"):
            self.op("checked")
            if self.text not in OVERLOADABLE:
                self.fail()
            self.i += 1
            while self.text == ">":
                self.i += 1
            self.need("(")
            self.comma_list(self.parameter, ")")
            self.method_body()
            return
        if self.text == "this" or self.attempt(self.explicit_indexer):
            self.need("this")
            self.need("[")
            self.comma_list(self.parameter, "]")
            if self.op("=>"):
                self.expression()
                self.need(";")
            else:
                self.accessors()
            return
        self.member_name()
        if self.op("("):
            self.comma_list(self.parameter, ")")
            self.constraints()
            self.method_body()
        elif self.text == "{":
            self.accessors()
            if self.op("="):
                self.initializer()
                self.need(";")
        elif self.op("=>"):
            self.expression()
            self.need(";")
        else:
            self.declarators_rest()
            self.need(";")

    def explicit_indexer(self) -> None:
        while True:
            self.name()
            self.type_arguments()
            self.need(".")
            if self.text == "this":
                return

    def member_name(self) -> None:
        self.name()
        self.type_arguments()
        while self.op(".") or self.op("::"):
            self.name()
            self.type_arguments()

    def method_body(self) -> None:
        if self.op("=>"):
            self.expression()
            self.need(";")
        elif self.text == "{":
            self.block()
        else:
            self.need(";")

    def accessors(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.attributes()
            self.modifiers()
            if self.text not in ("get", "set", "init", "add", "remove"):
                self.fail("accessor expected, not")
            self.i += 1
            self.method_body()

    def parameter(self) -> None:
        self.attributes()
        while self.text in ("ref", "out", "in", "params", "this", "readonly") and self.kind == "kw" or self.text == "scoped" and self.ahead().kind in ("id", "kw"):
            self.i += 1
        self.type()
        self.name()
        if self.op("="):
            self.expression()

    def declarators_rest(self) -> None:
        while True:
            if self.op("["):
                self.expression()
                self.need("]")
            if self.op("="):
                self.initializer()
            if not self.op(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.op("{"):
            self.comma_list(self.initializer, "}", trailing=True)
        else:
            self.op("ref")
            self.expression()

    # statements

    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement()

    def declaration_start(self) -> bool:
        def rule() -> None:
            self.word("scoped") if self.ahead().kind == "id" else None
            self.type()
            if self.text in ("is", "as", "when"):
                raise Invalid
            self.name()
            if self.text not in ("=", ";", ",", "in", "[", ")"):
                raise Invalid

        return self.attempt(rule)

    def local_function(self) -> bool:
        at = self.i

        def rule() -> None:
            self.attributes()
            self.modifiers()
            self.type()
            self.name()
            self.type_arguments()
            if self.text != "(" or self.tokens[self.closing() + 1].text not in ("{", "=>", "where", ";"):
                raise Invalid
            if self.tokens[self.closing() + 1].text == ";" and self.tokens[at].text != "extern":
                raise Invalid
            self.i += 1
            self.comma_list(self.parameter, ")")

        if not self.attempt(rule):
            return False
        self.constraints()
        self.method_body()
        return True

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
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
        rule = getattr(self, f"{t}_statement", None) if self.kind == "kw" else None
        if t == "{" and self.kind == "op":
            self.block()
        elif self.op(";"):
            pass
        elif t in ("checked", "unchecked", "unsafe") and self.ahead().text == "{":
            self.i += 1
            self.block()
        elif rule is not None:
            self.i += 1
            rule()
        elif t == "yield" and self.ahead().text in ("return", "break"):
            self.i += 2
            if self.tokens[self.i - 1].text == "return":
                self.expression()
            self.need(";")
        elif t == "await" and self.ahead().text in ("foreach", "using"):
            self.i += 1
            self.statement()
        elif self.kind == "id" and self.ahead().text == ":" and self.ahead().kind == "op":
            self.i += 2
            self.statement()
        elif t == "var" and self.ahead().text == "(" and self.tokens[self.match[self.i + 1] + 1].text == "=":
            self.i = self.match[self.i + 1] + 2
            self.expression()
            self.need(";")
        elif self.op("const"):
            self.type()
            self.name()
            self.declarators_rest()
            self.need(";")
        elif t == "await" and self.kind == "id" and self.ahead().kind in ("id", "kw") and self.attempt(self.await_statement):
            pass
        elif (self.kind in ("id", "kw") or t in ("(", "[")) and self.local_function():
            pass
        elif (self.kind in ("id", "kw") or t == "(") and self.declaration_start():
            self.declarators_rest()
            self.need(";")
        else:
            if self.expression() not in ("assign", "call", "new", "step", "await"):
                self.fail("no statement before")
            self.need(";")

    def await_statement(self) -> None:
        self.i += 1
        self.unary()
        self.need(";")

    def if_statement(self) -> None:
        self.condition()
        self.statement()
        if self.op("else"):
            self.statement()

    def while_statement(self) -> None:
        self.condition()
        self.statement()

    lock_statement = while_statement

    def do_statement(self) -> None:
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def for_statement(self) -> None:
        self.need("(")
        if self.text != ";":
            if self.declaration_start():
                self.declarators_rest()
            else:
                self.expression()
                while self.op(","):
                    self.expression()
        self.need(";")
        if self.text != ";":
            self.expression()
        self.need(";")
        if self.text != ")":
            self.expression()
            while self.op(","):
                self.expression()
        self.need(")")
        self.statement()

    def foreach_statement(self) -> None:
        self.need("(")
        if not self.declaration_start():
            self.word("var")
            self.expression(stop_in=True)
        self.need("in")
        self.expression()
        self.need(")")
        self.statement()

    def fixed_statement(self) -> None:
        self.need("(")
        if not self.declaration_start():
            self.fail()
        self.declarators_rest()
        self.need(")")
        self.statement()

    def using_statement(self) -> None:
        if self.op("("):
            if self.declaration_start():
                self.declarators_rest()
            else:
                self.expression()
            self.need(")")
            self.statement()
        else:
            if not self.declaration_start():
                self.fail()
            self.declarators_rest()
            self.need(";")

    def return_statement(self) -> None:
        if not self.op(";"):
            self.op("ref")
            self.expression()
            self.need(";")

    def throw_statement(self) -> None:
        if not self.op(";"):
            self.expression()
            self.need(";")

    def break_statement(self) -> None:
        self.need(";")

    continue_statement = break_statement

    def goto_statement(self) -> None:
        if self.op("case"):
            self.expression()
        elif not self.op("default"):
            self.name()
        self.need(";")

    def try_statement(self) -> None:
        self.block()
        handled = False
        while self.op("catch"):
            handled = True
            if self.op("("):
                self.type()
                if self.kind == "id":
                    self.i += 1
                self.need(")")
            if self.word("when"):
                self.condition()
            self.block()
        if self.op("finally"):
            handled = True
            self.block()
        if not handled:
            self.fail("catch expected, not")

    def switch_statement(self) -> None:
        self.need("(")
        self.comma_list(self.argument, ")")
        self.need("{")
        while not self.op("}"):
            if self.op("default"):
                pass
            else:
                self.need("case")
                self.pattern()
                if self.word("when"):
                    self.expression()
            self.need(":")
            while not (self.text in ("case", "}") and self.kind in ("kw", "op") or self.text == "default" and self.ahead().text == ":"):
                self.statement()

    # patterns

    def pattern(self) -> None:
        self.simple_pattern()
        while self.text in ("and", "or") and self.kind == "id":
            self.i += 1
            self.simple_pattern()

    def simple_pattern(self) -> None:
        if self.text == "not" and self.kind == "id":
            self.i += 1
            self.simple_pattern()
        elif self.kind == "op" and self.text in ("<", ">", "<=", ">=", "==", "!="):
            self.i += 1
            self.shift()
        elif self.op("["):
            self.comma_list(self.list_item, "]", trailing=True)
            self.designation()
        elif self.text == "{" and self.kind == "op":
            self.property_pattern()
            self.designation()
        elif self.text == "(" and self.kind == "op" and self.attempt(self.positional):
            pass
        elif self.attempt(self.typed_pattern):
            pass
        else:
            self.shift()

    def list_item(self) -> None:
        if self.op(".."):
            if self.text not in (",", "]"):
                self.pattern()
        else:
            self.pattern()

    def positional(self) -> None:
        self.need("(")
        self.comma_list(self.subpattern, ")")
        if self.text == "{":
            self.property_pattern()
        self.designation()
        if self.text in (".", "(") or self.text in BINARY:
            raise Invalid

    def subpattern(self) -> None:
        at = self.i
        if self.kind == "id":
            self.i += 1
            while self.op("."):
                self.name()
            if self.op(":"):
                self.pattern()
                return
            self.i = at
        self.pattern()

    def property_pattern(self) -> None:
        self.need("{")
        self.comma_list(self.subpattern, "}", trailing=True)

    def typed_pattern(self) -> None:
        self.type(nullable=False)
        if self.text == "{" and self.kind == "op":
            self.property_pattern()
            self.designation()
        elif self.text == "(" and self.kind == "op":
            self.i += 1
            self.comma_list(self.subpattern, ")")
            if self.text == "{":
                self.property_pattern()
            self.designation()
        else:
            self.designation()
        if self.kind == "op" and self.text in ("+", "-", "*", "/", "%", ".", "<<", "("):
            raise Invalid

    def designation(self) -> None:
        if self.kind == "id" and self.text not in ("and", "or", "when"):
            self.i += 1

    def shift(self) -> None:
        """A constant: operands joined by arithmetic."""
        self.unary()
        while self.kind == "op" and self.text in ("+", "-", "*", "/", "%", "<<", "&", "|", "^"):
            self.i += 1
            self.unary()

    # expressions

    def is_lambda(self) -> bool:
        at = self.i
        while self.text in ("async", "static") and self.ahead().text not in ("=>", "=", ".", ",", ")", ";"):
            self.i += 1
        k = self.i
        self.i = at
        t = self.tokens[k]
        if t.kind == "id":
            return self.tokens[k + 1].text == "=>" and self.tokens[k + 1].kind == "op"
        if t.kind == "op" and t.text == "(":
            after = self.tokens[self.match[k] + 1]
            return after.kind == "op" and after.text == "=>"
        return False

    def lambda_(self) -> None:
        while self.text in ("async", "static") and self.ahead().text != "=>":
            self.i += 1
        if self.op("("):
            self.comma_list(self.lambda_parameter, ")")
        else:
            self.name()
        self.need("=>")
        if self.text == "{" and self.kind == "op":
            self.block()
        else:
            self.op("ref")
            self.expression()

    def lambda_parameter(self) -> None:
        if self.kind == "id" and self.ahead().text in (",", ")"):
            self.i += 1
        elif self.text in ("ref", "out", "in") and self.ahead().kind == "id" and self.ahead(2).text in (",", ")"):
            self.i += 2
        else:
            self.parameter()

    def expression(self, stop_in: bool = False) -> str:
        if self.is_lambda():
            self.lambda_()
            return "value"
        if self.op("throw"):
            self.expression()
            return "value"
        if self.text == "from" and self.kind == "id" and self.ahead().kind in ("id", "kw") and self.ahead(1).text not in ("is", "as") and (self.ahead(2).text == "in" or self.ahead(3).text == "in"):
            self.query()
            return "value"
        kind = self.unary()
        while True:
            t = self.tokens[self.i]
            if t.kind == "op" and t.text in ASSIGN:
                if kind not in ("target", "tuple"):
                    self.fail("no target before")
                self.i += 1
                self.op("ref")
                if self.text == "{" and self.kind == "op":
                    self.initializer()
                else:
                    self.expression()
                return "assign"
            if t.kind == "op" and t.text in BINARY:
                self.i += 1
                if t.text == ">":
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
                if t.text == ".." and (self.text in ("]", ")", ",", ";") and self.kind == "op"):
                    kind = "value"
                    continue
                if t.text == "??" and self.op("throw"):
                    self.expression()
                    return "value"
                if t.text in ("??", "||", "&&") and self.is_lambda():
                    self.lambda_()
                    return "value"
                self.unary()
                kind = "value"
            elif t.text == "is" and t.kind == "kw":
                self.i += 1
                self.pattern()
                kind = "value"
            elif t.text == "as" and t.kind == "kw":
                self.i += 1
                self.type()
                kind = "value"
            elif t.text == "switch" and t.kind == "kw" and self.ahead().text == "{":
                self.i += 1
                self.switch_arms()
                kind = "value"
            elif t.text == "with" and t.kind == "id" and self.ahead().text == "{":
                self.i += 1
                self.object_initializer()
                kind = "value"
            elif t.text == "?" and t.kind == "op":
                self.i += 1
                self.op("ref")
                self.expression()
                self.need(":")
                self.op("ref")
                self.expression()
                return "value"
            else:
                return kind

    def switch_arms(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.pattern()
            if self.word("when"):
                self.expression()
            self.need("=>")
            self.expression()
            if self.text != "}":
                self.need(",")

    def query(self) -> None:
        self.query_from()
        while True:
            if self.text == "from":
                self.query_from()
            elif self.word("let"):
                self.name()
                self.need("=")
                self.expression()
            elif self.word("where"):
                self.expression()
            elif self.word("join"):
                if self.ahead().text != "in":
                    self.type()
                self.name()
                self.need("in")
                self.expression()
                if not self.word("on"):
                    self.fail()
                self.expression()
                if not self.word("equals"):
                    self.fail()
                self.expression()
                if self.word("into"):
                    self.name()
            elif self.word("orderby"):
                while True:
                    self.expression()
                    self.word("ascending") or self.word("descending")
                    if not self.op(","):
                        break
            elif self.word("select"):
                self.expression()
                if not self.word("into"):
                    return
                self.name()
            elif self.word("group"):
                self.expression()
                if not self.word("by"):
                    self.fail()
                self.expression()
                if not self.word("into"):
                    return
                self.name()
            else:
                self.fail("query clause expected, not")

    def query_from(self) -> None:
        self.word("from")
        if self.ahead().text != "in":
            self.type()
        self.name()
        self.need("in")
        self.expression()

    def is_cast(self) -> bool:
        end = self.closing()
        predefined = self.ahead().kind == "kw" and self.ahead().text in PREDEFINED
        at = self.i

        def rule() -> None:
            self.i += 1
            self.type()
            if self.i != end:
                raise Invalid

        found = self.attempt(rule)
        self.i = at
        if not found:
            return False
        after = self.tokens[end + 1]
        if after.kind == "id":
            return after.text not in ("and", "or", "when", "with", "on", "equals", "by", "into", "ascending", "descending", "select", "where", "orderby", "group", "join", "let", "from") or self.ahead(end + 2 - self.i).text in (".", "(")
        if after.kind in ("num", "str"):
            return True
        if after.kind == "kw":
            return after.text not in ("is", "as", "in", "switch")
        return after.text in ("(", "!", "~") or predefined and after.text in ("+", "-", "++", "--", "*", "&", "[", "^")

    def unary(self) -> str:
        t = self.text
        if self.kind == "op":
            if t in ("++", "--"):
                self.i += 1
                if self.unary() != "target":
                    self.fail("no target before")
                return "step"
            if t in ("+", "-", "!", "~", "&", "*", "^"):
                self.i += 1
                self.unary()
                return "target" if t == "*" else "value"
            if t == "..":
                self.i += 1
                if self.text not in ("]", ")", ",", ";"):
                    self.unary()
                return "value"
            if t == "(" and self.is_cast():
                self.i = self.closing() + 1
                self.unary()
                return "value"
        elif t == "await" and self.kind == "id" and (self.ahead().kind in ("id", "kw", "str") and self.ahead().text not in ("is", "as", "in") or self.ahead().text == "(" and False):
            self.i += 1
            self.unary()
            return "await"
        return self.postfix(self.primary())

    def primary(self) -> str:
        t = self.tokens[self.i]
        if t.kind in ("num", "str"):
            self.i += 1
            return "value"
        if t.kind == "id":
            self.i += 1
            if self.text == "::":
                self.i += 1
                self.name()
            self.generic_suffix()
            return "target"
        if t.kind == "kw":
            if t.text in ("true", "false", "null"):
                self.i += 1
                return "value"
            if t.text == "this" or t.text == "base":
                self.i += 1
                if t.text == "base" and self.text not in (".", "["):
                    self.fail()
                return "target"
            if t.text in PREDEFINED and t.text != "void":
                if self.ahead().text == "." or self.ahead().text == "?" and self.ahead(2).text == ".":
                    self.i += 1
                    return "value"
                if self.ahead().kind == "id":  # a variable declared in an argument or a deconstruction
                    self.i += 2
                    return "target"
                self.fail()
            if t.text in ("typeof", "sizeof"):
                self.i += 1
                self.need("(")
                self.type()
                self.need(")")
                return "value"
            if t.text == "default":
                self.i += 1
                if self.op("("):
                    self.type()
                    self.need(")")
                return "value"
            if t.text in ("checked", "unchecked"):
                self.i += 1
                self.condition()
                return "value"
            if t.text == "new":
                self.i += 1
                return self.creation()
            if t.text == "stackalloc":
                self.i += 1
                if self.text != "[":
                    self.type(array=False)
                self.need("[")
                if not self.op("]"):
                    self.expression()
                    self.need("]")
                if self.text == "{":
                    self.initializer()
                return "value"
            if t.text == "delegate":
                self.i += 1
                if self.op("("):
                    self.comma_list(self.parameter, ")")
                self.block()
                return "value"
            if t.text == "ref":
                self.i += 1
                self.unary()
                return "value"
        if self.op("("):
            first = self.element()
            many = False
            while self.op(","):
                many = True
                self.element()
            self.need(")")
            return "tuple" if many else ("target" if first == "target" else "value")
        if self.op("["):
            while not self.op("]"):
                if self.op(".."):
                    pass
                self.expression()
                if self.text != "]":
                    self.need(",")
            return "value"
        self.fail()
        return ""

    def element(self) -> str:
        if self.kind == "id" and self.ahead().text == ":" and self.ahead().kind == "op":
            self.i += 2
        if self.declared():
            return "target"
        return self.expression()

    def declared(self) -> bool:
        """Reads a type and a name, as in ``out int n`` or ``(var a, var b)``."""

        def rule() -> None:
            self.type()
            self.name()
            if self.text not in (",", ")"):
                raise Invalid

        return (self.kind in ("id", "kw")) and self.ahead().text not in (",", ")", ".", "(") and self.attempt(rule)

    def generic_suffix(self) -> None:
        """Type arguments after a name, where what follows can't follow a comparison."""
        if self.text != "<" or self.kind != "op":
            return

        def rule() -> None:
            self.type_arguments()
            t = self.tokens[self.i]
            if not (t.kind == "eof" or t.kind == "op" and t.text in ("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "|", "^", "&&", "||", "&", "[", "=>", "{", "?.")):
                raise Invalid

        self.attempt(rule)

    def creation(self) -> str:
        if self.op("["):  # implicitly typed array
            while self.op(","):
                pass
            self.need("]")
            self.initializer()
            return "value"
        if self.text == "{" and self.kind == "op":  # anonymous type
            self.i += 1
            self.comma_list(self.anonymous_member, "}", trailing=True)
            return "new"
        if self.op("("):
            self.comma_list(self.argument, ")")
            if self.text == "{":
                self.object_initializer()
            return "new"
        self.type(array=False)
        if self.op("["):
            if self.text in ("]", ",") and self.kind == "op":
                while self.op(","):
                    pass
                self.need("]")
                while self.text == "[":
                    self.i += 1
                    while self.op(","):
                        pass
                    self.need("]")
                self.initializer()
                return "value"
            self.comma_list(self.expression, "]")
            while self.text == "[" and self.ahead().text in ("]", ","):
                self.i += 1
                while self.op(","):
                    pass
                self.need("]")
            if self.text == "{":
                self.initializer()
            return "value"
        if self.op("("):
            self.comma_list(self.argument, ")")
            if self.text == "{" and self.kind == "op":
                self.object_initializer()
        else:
            self.object_initializer()
        return "new"

    def anonymous_member(self) -> None:
        if self.kind == "id" and self.ahead().text == "=":
            self.i += 2
        self.expression()

    def object_initializer(self) -> None:
        self.need("{")
        while not self.op("}"):
            if self.text == "{" and self.kind == "op":
                self.i += 1
                self.comma_list(self.expression, "}")
            elif self.text == "[" and self.kind == "op" and self.tokens[self.closing() + 1].text == "=":
                self.i += 1
                self.comma_list(self.argument, "]")
                self.need("=")
                self.value()
            elif self.kind == "id" and self.ahead().text == "=" and self.ahead().kind == "op":
                self.i += 2
                self.value()
            else:
                self.expression()
            if self.text != "}":
                self.need(",")

    def value(self) -> None:
        if self.text == "{" and self.kind == "op":
            self.object_initializer()
        else:
            self.expression()

    def argument(self) -> None:
        if self.kind == "id" and self.ahead().text == ":" and self.ahead().kind == "op":
            self.i += 2
        elif self.kind == "id" and self.ahead().text == "=" and self.ahead().kind == "op" and False:
            self.i += 2
        if self.op("ref") or self.op("in"):
            self.expression()
        elif self.op("out"):
            if not self.declared():
                self.expression()
        else:
            self.expression()

    def postfix(self, kind: str) -> str:
        while self.kind in ("op", "id", "kw"):
            t = self.text
            if self.kind != "op":
                return kind
            if t == "." or t == "->":
                self.i += 1
                self.name()
                self.generic_suffix()
                kind = "target"
            elif t == "?" and self.ahead().text == "." and self.ahead().kind == "op" and self.ahead(2).kind == "id":
                self.i += 2
                self.name()
                self.generic_suffix()
                kind = "target"
            elif t == "?" and self.ahead().text == "[" and self.conditional_index():
                kind = "target"
            elif t == "[":
                if self.ahead().text in ("]", ","):
                    self.fail()
                self.i += 1
                self.comma_list(self.argument, "]")
                kind = "target"
            elif t == "(":
                if kind in ("new", "step", "await"):
                    self.fail()
                self.i += 1
                self.comma_list(self.argument, ")")
                kind = "call"
            elif t in ("++", "--"):
                if kind != "target":
                    self.fail("no target before")
                self.i += 1
                kind = "step"
            elif t == "!" and self.ahead().text != "=":
                self.i += 1
            else:
                return kind
        return kind

    def conditional_index(self) -> bool:
        """``a?[i]``, unless it is the start of a conditional with a collection."""
        end = self.match[self.i + 1]
        if self.tokens[end + 1].text == ":":
            return False
        self.i += 2
        self.comma_list(self.argument, "]")
        return True


def parse_csharp(text: str) -> None:
    text = _preprocessed(text.lstrip("\ufeff"))
    try:
        CSharp(_tokens(text, _PLAIN)).unit()
    except Invalid:  # a plain statement where none may stand, or a text that isn't valid
        CSharp(_tokens(text)).unit()
