"""Lexer-state maps and bracket summaries of pieces of a source file.

A piece of whole lines is represented by what it does to a lexer: for each state in which
its first line may begin (code, a block comment, a long string) the state after its last
line, the brackets that it closes without having opened them, those it leaves open, and
whether it is broken in itself. Such maps compose associatively, so the pieces of a file
can be scanned anywhere and reduced in any grouping that keeps their order. A scanner can
be misled, by a slash that may divide or begin an expression, or by quotes in a string's
hole; a piece with such a thing says so, and then only the grammar decides.
"""

from __future__ import annotations

from typing import NamedTuple

import re


class Effect(NamedTuple):
    exit: str
    closes: str
    opens: str
    broken: bool
    unsure: bool = False  # whether the piece has something that can mislead the scanner


StateMap = dict[str, Effect]

_PAIRS = {"(": ")", "[": "]", "{": "}"}

_TEXT = r'"(?:[^"\\\n]|\\.)*+"'
_CHAR = r"'(?:[^'\\\n]|\\.)*+'"
_BLOCK = (r"/\*", r"(?s:.)*?\*/")
#: For each language what a scanner skips: tokens that end on their line, and for each state its start and the rest up to its end. Each begins
#: with a character of its own, so that a search needn't try them all at every place; the signs before C#'s strings matter to no bracket.
_LEXERS: dict[str, tuple[list[str], dict[str, tuple[str, str]]]] = {
    "java": ([r"//[^\n]*", _TEXT, _CHAR], {"block": _BLOCK, "text": ('"""', r'(?:[^"\\]|\\(?s:.)|"(?!""))*+"""')}),
    "csharp": ([r"//[^\n]*", _TEXT, _CHAR], {"block": _BLOCK, "text": ('"""', r'(?s:.)*?"""+'), "verbatim": (r'@\$?"', r'(?:[^"]|"")*+"(?!")')}),
    "go": ([r"//[^\n]*", _TEXT, _CHAR], {"block": _BLOCK, "raw": ("`", r"[^`]*+`")}),
    "javascript": ([r"//[^\n]*", _TEXT, _CHAR], {"block": _BLOCK, "raw": ("`", r"(?:[^`\\]|\\(?s:.))*+`")}),
    "python": (
        [r"\#[^\n]*", r'"(?:[^"\\\n]|\\(?s:.))*+"', r"'(?:[^'\\\n]|\\(?s:.))*+'"],
        {"long": ('"""', r'(?:[^"\\]|\\(?s:.)|"(?!""))*+"""'), "single": ("\'\'\'", r"(?:[^'\\]|\\(?s:.)|'(?!''))*+\'\'\'")},
    ),
    "json": ([_TEXT], {}),
}
#: What can mislead the scanner of a language, wherever in a piece: holes of strings that a quote or bracket lies in, directives, escaped code points.
_MISLEADING = {
    "python": re.compile(r"""(?<!\w)(?:[fFtT][rR]?|[rR][fFtT])(?:\"\"\"|'''|(["'])(?:(?!\1)[^\n])*\{(?:(?!\1)[^}\n])*\1)"""),
    "javascript": re.compile(r"\$\{[^}]*[`'\"{]|<!--|-->"),
    "csharp": re.compile(r"^[ \t]*\#|\"{4}|\$+\"\"\"|(?:\$@?|@\$)\"[^\"\n]*\{[^}\"\n]*\"", re.M),
    "java": re.compile(r"\\u+00"),
}
#: Texts, one of which is in each piece that these patterns find something in.
_HINTS = {
    "python": tuple(c + q for c in "fFtTrR" for q in "\"'"),
    "javascript": ("${", "<!--", "-->"),
    "csharp": ("#", '""""', "$"),
    "java": ("\\u",),
}

CODE = "code"


class _Scanner:
    """What is skipped, as one pattern; a long token that doesn't end is skipped up to the end of the text."""

    def __init__(self, simple: list[str], longs: dict[str, tuple[str, str]]) -> None:
        comment = [p for p in simple if p.endswith(r"[^\n]*")]
        self.skip = re.compile("|".join([*comment, *(f"{a}{z}" for a, z in longs.values()), *(rf"{a}(?s:.)*\Z" for a, _ in longs.values()), *(p for p in simple if p not in comment)]))
        self.starts = {state: re.compile(a).match for state, (a, _) in longs.items()}
        self.rests = {state: re.compile(z).match for state, (_, z) in longs.items()}

    def open_state(self, text: str) -> str:
        """The state that the last token of a text is left in."""
        *_, last = self.skip.finditer(text)
        return next(state for state, start in self.starts.items() if start(text, last.start()))


#: Stands behind the last line; only a token that doesn't end takes it.
_END = "\n\x00"
_SCANNERS = {lang: _Scanner(*tokens) for lang, tokens in _LEXERS.items()}
_NO_BRACKETS = re.compile(r"[^()\[\]{}]+").sub
_OUTER = re.compile(r"([)\]}]*)([(\[{]*)").fullmatch
#: Levels of brackets that are taken off one by one before a stack takes over.
_LEVELS = 100


def states(lang: str) -> list[str]:
    return [CODE, *_SCANNERS[lang].rests]


def _brackets(marks: str) -> tuple[str, str, bool]:
    """What brackets close and open on the outside, and whether two that meet don't fit."""
    for _ in range(_LEVELS):
        before = len(marks)
        marks = marks.replace("()", "").replace("{}", "").replace("[]", "")
        if len(marks) == before:
            outer = _OUTER(marks)
            if outer:
                return outer[1], outer[2], False
            break
    closes: list[str] = []
    opens: list[str] = []
    broken = False
    for c in marks:
        if c in _PAIRS:
            opens.append(c)
        elif opens:
            broken |= _PAIRS[opens.pop()] != c
        else:
            closes.append(c)
    return "".join(closes), "".join(opens), broken


def scan(lang: str, text: str, entry: str = CODE) -> Effect:
    """The effect of ``text`` on a lexer that is in the state ``entry`` at its start."""
    scanner = _SCANNERS[lang]
    unsure = any(h in text for h in _HINTS.get(lang, ())) and _MISLEADING[lang].search(text) is not None
    text += _END
    if entry != CODE:
        m = scanner.rests[entry](text)
        if m is None:
            return Effect(entry, "", "", False, unsure)
        text = text[m.end() :]
    rest = scanner.skip.sub("", text)
    state = CODE if rest.endswith(_END) else scanner.open_state(text)
    closes, opens, broken = _brackets(_NO_BRACKETS("", rest))
    return Effect(state, closes, opens, broken or '"' in rest or "'" in rest, unsure or lang == "javascript" and "/" in rest)


def state_map(lang: str, text: str, first: bool = False) -> StateMap:
    """The map of a piece; of the first piece of a file only the entry in code is needed."""
    return {s: scan(lang, text, s) for s in ([CODE] if first else states(lang))}


def then(a: Effect, b: Effect) -> Effect:
    n = min(len(a.opens), len(b.closes))
    broken = a.broken or b.broken or any(_PAIRS[o] != c for o, c in zip(reversed(a.opens), b.closes[:n]))
    return Effect(b.exit, a.closes + b.closes[n:], a.opens[: len(a.opens) - n] + b.opens, broken, a.unsure or b.unsure)


def compose(a: StateMap, b: StateMap) -> StateMap:
    """The map of two pieces, the one right after the other; associative."""
    return {s: then(e, b[e.exit]) for s, e in a.items()}


def balanced(e: Effect) -> bool:
    return e.exit == CODE and not e.closes and not e.opens and not e.broken


def surely_invalid(e: Effect) -> bool:
    """Whether the map of a whole file shows by itself that it isn't valid."""
    return not e.unsure and not balanced(e)
