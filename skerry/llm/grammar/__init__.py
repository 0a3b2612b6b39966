"""Local grammars: is a text syntactically valid in its language?"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings

from skerry.llm.grammar.base import Invalid
from skerry.llm.grammar.csharp import parse_csharp
from skerry.llm.grammar.golang import parse_go
from skerry.llm.grammar.java import parse_java
from skerry.llm.grammar.javascript import parse_javascript


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ast.parse(text)


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<mark>[\[\]{},:])|(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<plain>true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?))')


def _deep_json(text: str) -> None:
    """JSON of any depth, with a stack of its own."""
    stack: list[str] = []
    at, want = 0, "value"  # or: first (value or end of list), name, first name, colon, next, end
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        at, kind, token = m.end(), m.lastgroup, m.group(m.lastgroup)
        if want in ("value", "first") and (kind != "mark" or token in "[{"):
            if kind == "mark":
                stack.append(token)
                want = "first" if token == "[" else "first name"
            else:
                want = "next" if stack else "end"
        elif want in ("name", "first name") and kind == "text":
            want = "colon"
        elif want == "colon" and token == ":":
            want = "value"
        elif want == "next" and token == ",":
            want = "value" if stack[-1] == "[" else "name"
        elif stack and (stack[-1] == "[" and token == "]" and want in ("first", "next") or stack[-1] == "{" and token == "}" and want in ("first name", "next")):
            stack.pop()
            want = "next" if stack else "end"
        else:
            raise ValueError(f"no JSON at {at}")
    if want != "end":
        raise ValueError("unfinished JSON")


def _json(text: str) -> None:
    try:
        json.loads(text, parse_constant=_constant)
    except RecursionError:
        _deep_json(text)


PARSERS = {"python": _python, "json": _json, "javascript": parse_javascript, "java": parse_java, "csharp": parse_csharp, "go": parse_go}


#: Frames that a parser may use for each character, and at least; its rules are plain Python, which takes no room on the machine's stack.
_FRAMES_A_CHAR = 64
_FRAMES = 20_000


def why_invalid(lang: str, text: str) -> str | None:
    """What is wrong with the syntax of ``text``, None if nothing.

    Python that the interpreter's own parser can't read for its depth counts as valid here.
    """
    held = sys.getrecursionlimit()
    sys.setrecursionlimit(min(max(held, _FRAMES, _FRAMES_A_CHAR * len(text)), 2**31 - 1))
    try:
        PARSERS[lang](text)
    except (RecursionError, MemoryError):
        if lang != "python":
            raise
        return None
    except (Invalid, SyntaxError, ValueError) as e:
        return str(e)[:200] or "invalid"
    finally:
        sys.setrecursionlimit(held)
    return None
