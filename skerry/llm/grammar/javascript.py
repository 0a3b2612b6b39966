"""The grammar of JavaScript, as a module where the text imports or exports, as a script elsewhere.

Tokens are read on demand, as only the parser knows whether a slash begins a regular expression
and whether a brace ends a hole of a template.
"""

from __future__ import annotations

import re

from skerry.llm.grammar.base import Invalid, Token
from skerry.llm.grammar.statements import ARITHMETIC, DOUBLE, SINGLE, NAME, NUMBER_ROW, S, comma_list, plain_statement

#: Reserved words.
KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null"
    " return super switch this throw true try typeof var void while with".split()
)
STRICT = frozenset("implements interface let package private protected public static yield".split())
BINARY = frozenset("+ - * / % ** & | ^ && || ?? == != === !== < > <= >= << >> >>>".split())
ASSIGN = frozenset("= += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??=".split())

_SPACE = re.compile(r"(?:[\s\ufeff]++|//[^\n\r\u2028\u2029]*+|/\*(?s:.*?)\*/)+")
_FEED = re.compile(r"[\n\r\u2028\u2029]")
_WORD = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*+"
_LEX = re.compile(
    rf"""(?P<id>\#?{_WORD})
    |(?P<num>0[xX](?:_?[0-9a-fA-F])+n?|0[bB](?:_?[01])+n?|0[oO](?:_?[0-7])+n?|(?:[0-9](?:_?[0-9])*(?:n|\.(?:[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9]+)?|(?:[eE][+-]?[0-9]+)?)|\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9]+)?))
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|u\{{[0-9a-fA-F]+\}}|[^xu]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|u\{{[0-9a-fA-F]+\}}|[^xu]))*')
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.(){{}}\[\]@`])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+/([\w$]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*(`|\$\{)")
_LITERAL_REGEX = r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[gimsuy]?(?![A-Za-z0-9_$])"
_PLAIN = plain_statement(
    KEYWORDS | STRICT | {"await", "async", "of", "get", "set"}, _LITERAL_REGEX + rf"|(?:{DOUBLE}|{SINGLE}|`(?:[^`\\$]|\\[btnfr`\\$]|\$(?!\{{)|\$\{{{NAME}(?:\.{NAME})*+\}})*+`)", "true|false|null",
    lambda ex: (
        r"\[" + comma_list(rf"(?:\.\.\.)?{ex}", r"\]"), r"\{" + comma_list(rf"{NAME}{S}:{S}{ex}", r"\}"),
    ), rf"(?:[=!]==|\?\?(?!=)|{ARITHMETIC})",
    lambda ex: rf"(?:var|let|const)[ ]+{NAME}{S}=(?![=>]){S}{ex}|delete[ ]+{NAME}(?:\.{NAME})++", ";", arrow="=>", spread=True,
    heads=lambda top: (rf"if{S}\({S}(?P<cond>{top}){S}\){S}(?=\{{)", rf"while{S}\({S}(?P<head>{top}){S}\){S}(?=\{{)", rf"for{S}\({S}(?:const|let|var)[ ]+{NAME}[ ]+of[ ]+(?P<head>{top}){S}\){S}(?=\{{)"),
)
_METHOD = re.compile(rf"{NAME}\({S}(?:{NAME}{S}(?:,(?!{S}\)){S}|(?=\))))*+\){S}(?=\{{)").match
_RESERVED = re.compile(rf"(?<![A-Za-z0-9_$])(?:{'|'.join(sorted(KEYWORDS | STRICT | {'await', 'get', 'set'}))})(?![A-Za-z0-9_$])").search
_MODULE = re.compile(r"^[ \t]*(?:import\b(?!\s*[(.])|export\b)", re.M)


class JavaScript:
    def __init__(self, text: str, module: bool) -> None:
        self.source = text
        self.module = module
        self.cache: dict[int, tuple[Token, bool, int]] = {}
        self.in_function = False
        self.in_async = module
        self.in_generator = False
        self.no_in = False
        self.at = 0
        if text.startswith("#!"):
            m = _FEED.search(text)
            self.at = m.start() if m else len(text)
        self.move(self.at)

    # tokens

    def read(self, at: int) -> tuple[Token, bool, int]:
        found = self.cache.get(at)
        if found is None:
            m = _SPACE.match(self.source, at)
            start, feed = at, False
            if m:
                start = m.end()
                feed = _FEED.search(m.group()) is not None
            if start >= len(self.source):
                found = (Token("eof", "", start, 0), feed, start)
            else:
                m = _LEX.match(self.source, start)
                if m is None or self.source.startswith("/*", start):
                    raise Invalid(f"no token {self.source[start : start + 20]!r} at {start}")
                kind, word, end = m.lastgroup, m.group(), m.end()
                if kind == "num" and end < len(self.source) and (self.source[end].isalnum() or self.source[end] in "_$"):
                    raise Invalid(f"bad number at {start}")
                if kind == "id" and word in KEYWORDS:
                    kind = "kw"
                found = (Token(kind, word, start, 0), feed, end)
            self.cache[at] = found
        return found

    def move(self, at: int) -> None:
        self.here = at
        self.token, self.feed, self.after = self.read(at)

    def next(self) -> None:
        self.move(self.after)

    def ahead(self) -> tuple[Token, bool]:
        token, feed, _ = self.read(self.after)
        return token, feed

    @property
    def text(self) -> str:
        return self.token.text if self.token.kind in ("op", "kw", "id") else ""

    @property
    def kind(self) -> str:
        return self.token.kind

    def fail(self, what: str = "unexpected") -> None:
        raise Invalid(f"{what} {self.token.text[:30]!r} at {self.token.at}")

    def op(self, text: str) -> bool:
        if self.token.text == text and self.token.kind in ("op", "kw"):
            self.next()
            return True
        return False

    def word(self, text: str) -> bool:
        if self.token.text == text and self.token.kind == "id":
            self.next()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail(f"{text} expected, not")

    def semicolon(self) -> None:
        if self.op(";") or self.text == "}" and self.kind == "op" or self.kind == "eof" or self.feed:
            return
        self.fail("; expected, not")

    def binding_name(self) -> None:
        t = self.token
        if t.kind != "id" or t.text[0] == "#" or (self.module and (t.text in STRICT or t.text == "await")):
            self.fail("name expected, not")
        self.next()

    def property_word(self) -> None:
        if self.kind not in ("id", "kw"):
            self.fail("name expected, not")
        self.next()

    # statements

    def program(self) -> None:
        while self.kind != "eof":
            self.statement(top=True)

    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement()

    def statement(self, top: bool = False, single: bool = False) -> None:
        if self.token[0] != "op":
            found = None if single and self.token[1] in ("let", "const") else self.plain(self.token[2], single)
            if found is not None:
                if found in ("cond", "head"):
                    self.block()
                    if found == "cond" and self.op("else"):
                        self.statement(single=True)
                return
        t, kind = self.text, self.kind
        if kind == "op":
            if t == "{":
                self.block()
                return
            if self.op(";"):
                return
            if t == "@":
                self.decorators()
                if self.text == "export":
                    self.export()
                else:
                    self.class_()
                return
        elif kind == "kw":
            if t in ("var", "const"):
                if single and t == "const":
                    self.fail()
                self.next()
                self.declarators(t == "const")
                self.semicolon()
                return
            if t == "function":
                self.function(statement=True)
                return
            if t == "class":
                if single:
                    self.fail()
                self.class_(named=True)
                return
            if t == "import" and self.ahead()[0].text not in ("(", "."):
                if not (top and self.module):
                    self.fail()
                self.import_()
                return
            if t == "export":
                if not (top and self.module):
                    self.fail()
                self.export()
                return
            rule = getattr(self, f"{t}_statement", None)
            if rule is not None:
                self.next()
                rule()
                return
        elif kind == "id":
            after, feed = self.ahead()
            if t == "let" and (after.kind == "id" or after.text in ("[", "{")) and after.kind in ("id", "op"):
                if single and not (feed and after.text != "["):
                    self.fail()
                self.next()
                self.declarators(False)
                self.semicolon()
                return
            if t == "async" and after.text == "function" and not feed:
                self.function(statement=True)
                return
            if after.text == ":" and after.kind == "op":
                self.next()
                self.next()
                self.statement(single=True)
                return
        self.expression()
        self.semicolon()

    def plain(self, at: int, single: bool) -> str | None:
        """Reads a plain statement that starts at ``at`` and all that follow right after it; gives the kind of the last one read."""
        source, last = self.source, None
        while True:
            found = _PLAIN.read(source, at)
            if found is None or found[0] == "returned" and not self.in_function:
                break
            last, end = found
            if single or last in ("cond", "head"):
                break
            m = _SPACE.match(source, end)
            at = end if m is None else m.end()
        if last is not None:
            self.move(end)
        return last

    def parenthesised(self) -> None:
        self.need("(")
        self.whole(self.expression)
        self.need(")")

    def whole(self, rule):
        """Within brackets ``in`` is an operator again."""
        held, self.no_in = self.no_in, False
        try:
            return rule()
        finally:
            self.no_in = held

    def if_statement(self) -> None:
        self.parenthesised()
        self.statement(single=True)
        if self.op("else"):
            self.statement(single=True)

    def while_statement(self) -> None:
        self.parenthesised()
        self.statement(single=True)

    def do_statement(self) -> None:
        self.statement(single=True)
        self.need("while")
        self.parenthesised()
        self.op(";")

    def for_statement(self) -> None:
        if self.text == "await" and self.in_async:
            self.next()
        self.need("(")
        held, self.no_in = self.no_in, True
        try:
            kind = None
            if self.text == ";":
                pass
            elif self.text in ("var", "const") or (self.text == "let" and (self.ahead()[0].kind == "id" and self.ahead()[0].text not in ("of",) or self.ahead()[0].text in ("[", "{"))):
                self.next()
                self.declarators(False, head=True)
                kind = "target"
            else:
                kind = self.expression()
        finally:
            self.no_in = held
        if self.text in ("of", "in") and kind is not None:
            if kind != "target":
                self.fail("no target before")
            of = self.text == "of"
            self.next()
            self.assignment() if of else self.expression()
        else:
            self.need(";")
            if self.text != ";" or self.kind != "op":
                self.expression()
            self.need(";")
            if self.text != ")" or self.kind != "op":
                self.expression()
        self.need(")")
        self.statement(single=True)

    def return_statement(self) -> None:
        if not self.in_function:
            self.fail("return outside a function before")
        if not self.feed and self.text not in (";", "}") and self.kind != "eof" or self.kind in ("str", "num") and not self.feed:
            self.expression()
        self.semicolon()

    def throw_statement(self) -> None:
        if self.feed:
            self.fail()
        self.expression()
        self.semicolon()

    def break_statement(self) -> None:
        if self.kind == "id" and not self.feed:
            self.next()
        self.semicolon()

    continue_statement = break_statement

    def debugger_statement(self) -> None:
        self.semicolon()

    def with_statement(self) -> None:
        if self.module:
            self.fail("with before")
        self.parenthesised()
        self.statement(single=True)

    def try_statement(self) -> None:
        self.block()
        handled = False
        if self.op("catch"):
            handled = True
            if self.op("("):
                self.binding()
                self.need(")")
            self.block()
        if self.op("finally"):
            handled = True
            self.block()
        if not handled:
            self.fail("catch expected, not")

    def switch_statement(self) -> None:
        self.parenthesised()
        self.need("{")
        default = False
        while not self.op("}"):
            if self.op("default"):
                if default:
                    self.fail("second default before")
                default = True
            else:
                self.need("case")
                self.expression()
            self.need(":")
            while self.text not in ("case", "default", "}") or self.kind not in ("kw", "op"):
                self.statement()

    # bindings

    def declarators(self, const: bool, head: bool = False) -> None:
        while True:
            pattern = self.text in ("[", "{") and self.kind == "op"
            self.binding()
            if self.op("="):
                self.assignment()
            elif (const or pattern) and not (head and (self.text in ("of", "in", ",", ";"))):
                self.fail("value expected, not")
            if not self.op(","):
                return

    def binding(self) -> None:
        if self.op("["):
            while not self.op("]"):
                if self.op(","):
                    continue
                rest = self.op("...")
                self.binding_element()
                if self.text != "]":
                    if rest:
                        self.fail()
                    self.need(",")
        elif self.op("{"):
            while not self.op("}"):
                if self.op("..."):
                    self.binding_name()
                else:
                    plain = self.kind == "id"
                    self.property_name()
                    if self.op(":"):
                        self.binding_element()
                    else:
                        if not plain:
                            self.fail()
                        if self.op("="):
                            self.whole(self.assignment)
                if self.text != "}":
                    self.need(",")
        else:
            self.binding_name()

    def binding_element(self) -> None:
        self.binding()
        if self.op("="):
            self.whole(self.assignment)

    def property_name(self) -> None:
        if self.op("["):
            self.whole(self.assignment)
            self.need("]")
        elif self.kind in ("id", "kw", "str", "num"):
            self.next()
        else:
            self.fail("property expected, not")

    # functions and classes

    def parameters(self) -> None:
        self.need("(")
        while not self.op(")"):
            rest = self.op("...")
            self.whole(self.binding_element)
            if self.text != ")":
                if rest:
                    self.fail()
                self.need(",")

    def function_body(self, is_async: bool, generator: bool, parameters: bool = True) -> None:
        held = self.in_function, self.in_async, self.in_generator
        self.in_function, self.in_async, self.in_generator = True, is_async, generator
        try:
            if parameters:
                self.parameters()
            self.whole(self.block)
        finally:
            self.in_function, self.in_async, self.in_generator = held

    def function(self, statement: bool = False, optional: bool = False) -> None:
        is_async = self.word("async")
        self.need("function")
        generator = self.op("*")
        if self.kind == "id":
            self.next()
        elif statement and not optional:
            self.fail("name expected, not")
        self.function_body(is_async, generator)

    def decorators(self) -> None:
        while self.op("@"):
            if self.text == "(":
                self.parenthesised()
            else:
                self.property_word()
                while self.op("."):
                    self.property_word()
                if self.text == "(":
                    self.arguments()

    def class_(self, named: bool = False) -> None:
        self.decorators()
        self.need("class")
        if self.kind == "id":
            self.next()
        elif named:
            self.fail("name expected, not")
        if self.op("extends"):
            self.left_hand_side()
        self.need("{")
        while not self.op("}"):
            if not self.op(";"):
                self.member()

    def member(self) -> None:
        if self.token[0] == "id":
            m = _METHOD(self.source, self.token[2])
            if m is not None and not _RESERVED(self.source, m.start(), m.end()):
                self.move(m.end())
                self.function_body(False, False, parameters=False)
                return
        self.decorators()

        def ends() -> bool:
            after, _ = self.ahead()
            return after.kind == "eof" or after.kind == "op" and after.text in ("(", "=", ";", "}")

        if self.text == "static" and not ends():
            self.next()
            if self.text == "{" and self.kind == "op":
                held, self.in_function = self.in_function, False
                self.whole(self.block)
                self.in_function = held
                return
        is_async = generator = accessor = False
        if self.text == "async" and self.kind == "id" and not ends() and not self.ahead()[1]:
            self.next()
            is_async = True
        if self.op("*"):
            generator = True
        elif self.text in ("get", "set") and self.kind == "id" and not ends() and not (self.ahead()[1] and self.ahead()[0].text != "["):
            self.next()
            accessor = True
        self.property_name()
        if self.text == "(" and self.kind == "op":
            self.function_body(is_async, generator)
            return
        if is_async or generator or accessor:
            self.fail("( expected, not")
        if self.op("="):
            self.whole(self.assignment)
        self.semicolon()

    # modules

    def string(self) -> None:
        if self.kind != "str":
            self.fail("string expected, not")
        self.next()

    def attributes(self) -> None:
        if self.op("with") or (self.text == "assert" and not self.feed and self.word("assert")):
            self.object()

    def import_(self) -> None:
        self.next()
        if self.kind == "str":
            self.next()
        else:
            more = True
            if self.kind == "id":
                self.next()
                more = self.op(",")
            if more:
                if self.op("*"):
                    if not self.word("as"):
                        self.fail()
                    self.binding_name()
                else:
                    self.specifiers()
            if not self.word("from"):
                self.fail("from expected, not")
            self.string()
        self.attributes()
        self.semicolon()

    def specifiers(self) -> None:
        self.need("{")
        while not self.op("}"):
            if self.kind == "str":
                self.next()
            else:
                self.property_word()
            if self.word("as"):
                if self.kind == "str":
                    self.next()
                else:
                    self.property_word()
            if self.text != "}":
                self.need(",")

    def export(self) -> None:
        self.next()
        if self.op("*"):
            if self.word("as"):
                if self.kind == "str":
                    self.next()
                else:
                    self.property_word()
            if not self.word("from"):
                self.fail("from expected, not")
            self.string()
            self.attributes()
            self.semicolon()
        elif self.text == "{" and self.kind == "op":
            self.specifiers()
            if self.word("from"):
                self.string()
                self.attributes()
            self.semicolon()
        elif self.op("default"):
            if self.text == "function" or (self.text == "async" and self.ahead()[0].text == "function"):
                self.function(statement=True, optional=True)
            elif self.text in ("class", "@"):
                self.class_()
            else:
                self.assignment()
                self.semicolon()
        elif self.text in ("var", "let", "const", "function", "class", "async", "@"):
            self.statement()
        else:
            self.fail()

    # expressions; a rule gives target, pattern or value

    def expression(self) -> str:
        kind = self.assignment()
        while self.op(","):
            self.assignment()
            kind = "value"
        return kind

    def arrow_body(self, is_async: bool) -> None:
        self.need("=>")
        if self.text == "{" and self.kind == "op":
            self.function_body(is_async, False, parameters=False)
            return
        held = self.in_function, self.in_async, self.in_generator
        self.in_async, self.in_generator = is_async, False
        try:
            self.assignment()
        finally:
            self.in_function, self.in_async, self.in_generator = held

    def try_arrow(self, is_async: bool) -> bool:
        """Reads an arrow function with parameters in parentheses, if one starts here."""
        at = self.here
        held = self.in_function, self.in_async, self.in_generator
        try:
            self.parameters()
            found = self.text == "=>" and not self.feed
        except Invalid:
            found = False
        self.in_function, self.in_async, self.in_generator = held
        if not found:
            self.move(at)
            return False
        self.arrow_body(is_async)
        return True

    def assignment(self) -> str:
        if self.kind == "id":
            if self.text == "yield" and self.in_generator:
                self.next()
                if not self.feed and not (self.kind == "op" and self.text in (")", "]", "}", ",", ";", ":")) and self.kind != "eof":
                    self.op("*")
                    self.assignment()
                return "value"
            after, feed = self.ahead()
            if after.text == "=>" and not feed and self.text[0] != "#":
                self.next()
                self.arrow_body(False)
                return "value"
            if self.text == "async" and not feed:
                if after.kind == "id":
                    at = self.here
                    self.next()
                    if self.ahead()[0].text == "=>":
                        self.next()
                        self.arrow_body(True)
                        return "value"
                    self.move(at)
                elif after.text == "(" and after.kind == "op":
                    at = self.here
                    self.next()
                    if self.try_arrow(True):
                        return "value"
                    self.move(at)
        elif self.text == "(" and self.kind == "op" and self.try_arrow(False):
            return "value"
        kind = self.conditional()
        if self.kind == "op" and self.text in ASSIGN:
            if kind != "target" and not (kind == "pattern" and self.text == "="):
                self.fail("no target before")
            self.next()
            self.assignment()
            return "value"
        return kind

    def conditional(self) -> str:
        kind = self.binary()
        if self.op("?"):
            self.whole(self.assignment)
            self.need(":")
            self.assignment()
            return "value"
        return kind

    def binary(self) -> str:
        if self.kind == "id" and self.text[0] == "#" and self.ahead()[0].text == "in":
            self.next()
            self.next()
            kind = self.unary() and "value"
        else:
            kind = self.unary()
        while True:
            if self.kind == "op" and self.text in BINARY or self.kind == "kw" and (self.text == "instanceof" or self.text == "in" and not self.no_in):
                self.next()
                self.unary()
                kind = "value"
            else:
                return kind

    def unary(self) -> str:
        t = self.text
        if self.kind == "op" and t in ("++", "--"):
            self.next()
            if self.unary() != "target":
                self.fail("no target before")
            return "value"
        if self.kind == "op" and t in ("+", "-", "!", "~") or self.kind == "kw" and t in ("delete", "void", "typeof"):
            self.next()
            self.unary()
            if self.text == "**" and self.kind == "op":
                self.fail()
            return "value"
        if t == "await" and self.kind == "id" and self.in_async:
            self.next()
            self.unary()
            return "value"
        kind = self.left_hand_side()
        if self.kind == "op" and self.text in ("++", "--") and not self.feed:
            if kind != "target":
                self.fail("no target before")
            self.next()
            return "value"
        return kind

    def arguments(self) -> None:
        self.need("(")

        def rest() -> None:
            while not self.op(")"):
                self.op("...")
                self.assignment()
                if self.text != ")" or self.kind != "op":
                    self.need(",")

        self.whole(rest)

    def template(self) -> None:
        at = self.token.at + 1
        while True:
            m = _TEMPLATE.match(self.source, at)
            if m is None:
                raise Invalid(f"unclosed template at {self.token.at}")
            if m.group(1) == "`":
                self.move(m.end())
                return
            self.move(m.end())
            self.whole(self.expression)
            if self.text != "}" or self.kind != "op":
                self.fail("} expected, not")
            at = self.token.at + 1

    def regular_expression(self) -> None:
        m = _REGEX.match(self.source, self.token.at)
        if m is None or any(f not in "dgimsuvy" for f in m.group(1)) or len(set(m.group(1))) < len(m.group(1)):
            self.fail("bad regular expression")
        self.move(m.end())

    def left_hand_side(self) -> str:
        if self.op("new"):
            if self.op("."):
                if not self.word("target"):
                    self.fail()
                kind = "value"
            else:
                self.callee()
                if self.text == "(" and self.kind == "op":
                    self.arguments()
                kind = "value"
        else:
            kind = self.primary()
        return self.chain(kind)

    def callee(self) -> None:
        if self.op("new"):
            if self.op("."):
                if not self.word("target"):
                    self.fail()
            else:
                self.callee()
                if self.text == "(" and self.kind == "op":
                    self.arguments()
        else:
            self.primary()
        self.chain("value", calls=False)

    def chain(self, kind: str, calls: bool = True) -> str:
        optional = False
        while self.kind == "op":
            if self.op("."):
                self.property_word()
                kind = "value" if optional else "target"
            elif calls and self.op("?."):
                optional = True
                if self.text == "(" and self.kind == "op":
                    self.arguments()
                elif self.op("["):
                    self.whole(self.expression)
                    self.need("]")
                else:
                    self.property_word()
                kind = "value"
            elif self.op("["):
                self.whole(self.expression)
                self.need("]")
                kind = "value" if optional else "target"
            elif self.text == "(" and calls:
                self.arguments()
                kind = "value"
            elif self.text == "`":
                self.template()
                kind = "value"
            else:
                break
        return kind

    def primary(self) -> str:
        t = self.token
        if t.kind in ("num", "str"):
            self.next()
            return "value"
        if t.kind == "id":
            if t.text == "async" and self.ahead()[0].text == "function" and not self.ahead()[1]:
                self.function()
                return "value"
            if t.text[0] == "#" or (self.module and t.text in STRICT):
                self.fail()
            self.next()
            return "target"
        if t.kind == "kw":
            if t.text in ("this", "null", "true", "false"):
                self.next()
                return "value"
            if t.text == "function":
                self.function()
                return "value"
            if t.text == "class":
                self.class_()
                return "value"
            if t.text == "super":
                self.next()
                if self.text not in (".", "[", "("):
                    self.fail()
                return "value"
            if t.text == "import":
                self.next()
                if self.op("."):
                    self.property_word()
                    return "value"
                self.arguments()
                return "value"
        elif t.kind == "op":
            if t.text == "(":
                self.next()
                kind = self.whole(self.expression)
                self.need(")")
                return "target" if kind == "target" else "value"
            if t.text == "[":
                self.next()
                self.whole(self.array)
                return "pattern"
            if t.text == "{":
                self.object()
                return "pattern"
            if t.text == "`":
                self.template()
                return "value"
            if t.text in ("/", "/="):
                self.regular_expression()
                return "value"
            if t.text == "@":
                self.class_()
                return "value"
        self.fail()
        return ""

    def array(self) -> None:
        m = NUMBER_ROW.match(self.source, self.token[2])
        if m is not None:
            self.move(m.end())
        while not self.op("]"):
            if self.op(","):
                continue
            self.op("...")
            self.assignment()
            if self.text != "]" or self.kind != "op":
                self.need(",")

    def object(self) -> None:
        self.need("{")
        self.whole(self.properties)

    def properties(self) -> None:
        while not self.op("}"):
            if self.op("..."):
                self.assignment()
            else:
                self.property()
            if self.text != "}" or self.kind != "op":
                self.need(",")

    def property(self) -> None:
        def ends() -> bool:
            after, _ = self.ahead()
            return after.kind == "op" and after.text in ("(", ":", ",", "}", "=")

        is_async = generator = accessor = False
        if self.text == "async" and self.kind == "id" and not ends():
            self.next()
            is_async = True
        if self.op("*"):
            generator = True
        elif self.text in ("get", "set") and self.kind == "id" and not ends():
            self.next()
            accessor = True
        plain = self.kind == "id"
        self.property_name()
        if self.text == "(" and self.kind == "op":
            self.function_body(is_async, generator)
        elif is_async or generator or accessor:
            self.fail("( expected, not")
        elif self.op(":"):
            self.assignment()
        else:
            if not plain:
                self.fail(": expected, not")
            if self.op("="):  # only right in a pattern; read as if it were one
                self.assignment()


def parse_javascript(text: str) -> None:
    JavaScript(text, module=_MODULE.search(text) is not None).program()
