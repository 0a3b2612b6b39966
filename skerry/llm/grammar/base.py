"""Tokens and the parts of a recursive-descent parser that the brace languages share.

Only validity matters, so chains of binary operators are read flat: whatever their
precedence, a chain is valid if its operands are.
"""

from __future__ import annotations

from typing import NamedTuple


class Invalid(Exception):
    """The text isn't valid."""


class Token(NamedTuple):
    kind: str  # id, kw, num, str, op, eof
    text: str
    at: int
    line: int  # counted where a language needs it, else 0


_CLOSERS = {"(": ")", "[": "]", "{": "}"}


def match_brackets(tokens: list[Token]) -> list[int]:
    """For each opening bracket the index of its closing one."""
    match = [-1] * len(tokens)
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in _CLOSERS:
            stack.append(i)
        elif t.text in (")", "]", "}"):
            if not stack or _CLOSERS[tokens[stack[-1]].text] != t.text:
                raise Invalid(f"unmatched {t.text} at {t.at}")
            match[stack.pop()] = i
    if stack:
        raise Invalid(f"unclosed {tokens[stack[-1]].text} at {tokens[stack[-1]].at}")
    return match


class Parser:
    """A cursor over tokens that end with one of kind eof."""

    def __init__(self, tokens: list[Token]) -> None:
        self.tokens = tokens
        self.match = match_brackets(tokens)
        self.i = 0

    @property
    def text(self) -> str:
        """The present token as operator, keyword or name; '' for literals and at the end."""
        t = self.tokens[self.i]
        return t.text if t.kind in ("op", "kw", "id") else ""

    @property
    def kind(self) -> str:
        return self.tokens[self.i].kind

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def fail(self, what: str = "") -> None:
        t = self.tokens[self.i]
        raise Invalid(f"{what or 'unexpected'} {t.text[:30]!r} at {t.at}")

    def op(self, text: str) -> bool:
        """Takes an operator or keyword, if it is the present token."""
        t = self.tokens[self.i]
        if t.text == text and t.kind in ("op", "kw"):
            self.i += 1
            return True
        return False

    def word(self, text: str) -> bool:
        """Takes a contextual keyword."""
        t = self.tokens[self.i]
        if t.text == text and t.kind in ("id", "kw"):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail(f"{text} expected, not")

    def name(self) -> str:
        t = self.tokens[self.i]
        if t.kind != "id":
            self.fail("name expected, not")
        self.i += 1
        return t.text

    def attempt(self, rule) -> bool:
        """Whether the rule can be read from here; if not, nothing is taken."""
        at = self.i
        try:
            rule()
        except Invalid:
            self.i = at
            return False
        return True

    def closing(self) -> int:
        """Index of the bracket that closes the present one."""
        return self.match[self.i]

    def comma_list(self, rule, end: str, trailing: bool = False) -> None:
        """``rule`` between commas up to ``end``, which is taken."""
        if self.op(end):
            return
        while True:
            rule()
            if self.op(end):
                return
            self.need(",")
            if trailing and self.op(end):
                return
