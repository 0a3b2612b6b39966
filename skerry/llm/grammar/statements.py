"""Plain statements and the heads of plain blocks, read by one regular expression.

Most statements of a source file are plain: an assignment, a call, a declaration or a return of an
expression without blocks, nested no deeper than a call within a call. One expression reads such a
statement, or the head of a condition, loop or method, as one token, many times faster than the parser proper. It matches valid statements only;
whatever it doesn't match, the parser reads in full.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Levels of nesting that are written out, as the expressions of ``re`` can't call themselves.
NESTING = 1

DOUBLE = r"\"(?:[^\"\\\n]|\\[btnfr\"'\\0])*+\""
SINGLE = r"'(?:[^'\\\n]|\\[btnfr\"'\\0])*+'"
ARITHMETIC = r"(?:==|!=|<=|>=|&&|\|\||[<>](?![=<>])|\+(?![+=])|-(?![-=>])|\*(?![=*])|/(?![=/*])|%(?!=)|&(?![&=^])|\|(?![|=])|\^(?!=))"
S = r"[ \t]*+"
#: The start of a long row of numbers, each with its comma, as tables of data have them.
NUMBER_ROW = re.compile(r"(?:[0-9]++(?:\.[0-9]++)?,[ \t]*+\n?[ \t]*+){5,}(?=[0-9])")
NUMBER = r"[0-9]++(?:\.[0-9]++)?(?![A-Za-z0-9_.])"


NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+"


class Plain:
    """A pattern of statements (stmt) and of heads of conditions (cond), other blocks (head) and members (member), each up to its brace."""

    def __init__(self, pattern: str, reserved: frozenset[str], types: frozenset[str]) -> None:
        words = lambda w: re.compile(rf"(?<![A-Za-z0-9_$])(?:{'|'.join(sorted(w))})(?![A-Za-z0-9_$])").search
        self.match = re.compile(pattern).match
        self.reserved = words(reserved)
        self.no_type = words(reserved - types)
        self.word = re.compile(NAME).match

    def read(self, text: str, at: int) -> tuple[str, int] | None:
        """Kind and end of what starts at ``at``, a return being a kind of its own; None where a reserved word stands in a name's place."""
        m = self.match(text, at)
        if m is None:
            return None
        kind, end = m.lastgroup, m.end()
        if kind is None:
            return None if self.reserved(text, at, end) else ("stmt", end)
        if kind in ("declared", "returned"):
            return None if self.reserved(text, self.word(text, at).end(), end) else ("stmt" if kind == "declared" else kind, end)
        if kind == "member":
            return None if self.no_type(text, at, end) else ("member", end)
        return None if self.reserved(text, m.start(kind), end) else ("cond" if kind == "cond" else "head", end)


def comma_list(item: str, end: str) -> str:
    """Items between commas, none at all included, up to ``end``, which is read."""
    return rf"{S}(?:{item}{S}(?:,(?!{S}{end}){S}|(?={end})))*+{end}"


def plain_statement(
    reserved: frozenset[str],
    strings: str,
    literals: str,
    operands: Callable[[str], tuple[str, ...]],
    binary: str,
    declaration: Callable[[str], str],
    end: str,
    arrow: str | None = None,
    spread: bool = False,
    ternary: bool = True,
    define: bool = False,
    returns: bool = True,
    words: str = "",
    heads: Callable[[str], tuple[str, ...]] = lambda top: (),
    member: str | None = None,
    types: str = "",
) -> Plain:
    """The plain statements of one language; every repetition is possessive, so no text is read twice."""
    name = NAME

    def within(ex: str | None) -> tuple[str, str]:
        """An operand, and a step after a name, whose inner expressions are ``ex``; without it only empty brackets."""
        item = None if ex is None else (r"(?:\.\.\.)?" if spread else "") + ex
        call = r"\(\)" if item is None else r"\(" + comma_list(item, r"\)")
        step = rf"(?:\.{name}|{call}" + ("" if ex is None else rf"|\[{S}{ex}{S}\]") + ")"
        parts = [NUMBER, rf"{strings}(?:\.{name}{call})*+", rf"(?:{literals})(?![A-Za-z0-9_$])", rf"new[ ]+{name}(?:\.{name})*+{call}(?:{step})*+", rf"(?:this(?![A-Za-z0-9_$])|{name})(?:{step})*+"]
        if ex is not None:
            parts = [*operands(ex), *parts, rf"\({S}{ex}{S}\)(?:{step})*+"]
        return rf"(?>!?(?:-(?!-))?(?:{'|'.join(parts)}))", step

    def expression(operand: str) -> str:
        chain = rf"{operand}(?:{S}{binary}{S}{operand})*+"
        if arrow:
            chain = rf"(?:(?:{name}|\({S}(?:{name}(?:,{S}{name})*+)?\)){S}{arrow}{S}(?!\{{))?+{chain}"
        return f"(?>{chain})"

    ex = None
    for _ in range(NESTING):
        ex = expression(within(ex)[0])
    operand, step = within(ex)
    top = expression(operand)
    if ternary:
        top = rf"{top}(?:{S}\?(?![.?\[]){S}{ex}{S}:{S}{ex})?+"
    head = rf"(?:this(?![A-Za-z0-9_$])|{name})"
    target = rf"{head}(?:\.{name}|\[{S}{ex}{S}\])*+"
    assign = r"(?:=(?![=>])|(?:\+|-|\*|/|%|&|\||\^|<<|>>)=" + ("|:=" if define else "") + ")"
    made = declaration(top)
    forms = [f"(?P<declared>{made})"] if made else []
    forms += [rf"{target}(?:{S}{assign}{S}{top}|\+\+|--)", rf"{head}(?:{step})*+(?<=\))"]
    if returns:
        forms.append(rf"(?P<returned>return(?![A-Za-z0-9_$])(?:[ ]+{top})?+)")
    whole = [rf"(?>{'|'.join(forms)}){S}{end}"]
    # the named group of a head is its expression, where names are checked
    whole += [h.replace("(?P<head>", f"(?P<head{i}>") for i, h in enumerate(heads(top))]
    if member:
        whole.append(f"(?P<member>{member})")
    kept = reserved - {"this", "new", *literals.split("|"), *words.split()}
    return Plain(rf"(?>{'|'.join(whole)})", kept, frozenset(types.split()))
