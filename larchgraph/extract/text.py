"""Source text with comments and literals blanked out. Offsets and line breaks stay as they are."""

from __future__ import annotations

import re

_PLAIN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.S)
_MARK = re.compile(r"//|/\*|[\"'`/{}]")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
#: A template's text up to its end or to the next hole, and a regular expression with what may stand before it.
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{)", re.S)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_BEFORE_PATTERN = re.compile(r"(?:\A|[(,=:\[!&|?{};+\-*%~^]|=>|\b(?:return|typeof|case|in|of|delete|void|throw|do|else|yield|await))\s*\Z")


def blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def plain(source: str) -> str:
    """Code of languages with C's comments and strings."""
    return _PLAIN.sub(lambda m: blank(m[0]), source)


def script(source: str) -> tuple[str, str]:
    """(code without comments and literals, source without comments) of a script. Code in a
    template's holes stays code."""
    code: list[str] = []
    text: list[str] = []
    holes: list[int] = []  # braces open inside each template hole that is open
    at = 0

    def put(end: int, in_code: bool, in_text: bool = True) -> None:
        nonlocal at
        part = source[at:end]
        code.append(part if in_code else blank(part))
        text.append(part if in_text else blank(part))
        at = end

    def template(start: int) -> None:
        found = _TEMPLATE.match(source, start)
        if not found:
            raise SyntaxError("unclosed template")
        if found[1] == "${":  # a hole's braces stay
            put(found.end() - 1, False)
            put(found.end(), True)
            holes.append(0)
        else:
            put(found.end(), False)

    while m := _MARK.search(source, at):
        put(m.start(), True)
        token = m[0]
        if token in ("//", "/*"):
            found = _COMMENT.match(source, at)
            if not found:
                raise SyntaxError("unclosed comment")
            put(found.end(), False, False)
        elif token == "`":
            template(at + 1)
        elif token == "}" and holes and not holes[-1]:
            holes.pop()
            put(at + 1, True)
            template(at)
        elif token in "{}":
            if holes:
                holes[-1] += 1 if token == "{" else -1
            put(at + 1, True)
        elif token == "/":
            found = _PATTERN.match(source, at) if _BEFORE_PATTERN.search(source[max(0, at - 40) : at]) else None
            put(found.end(), False) if found else put(at + 1, True)
        else:
            found = _STRING.match(source, at)
            put(found.end(), False) if found else put(at + 1, True)
    put(len(source), True)
    if holes:
        raise SyntaxError("unclosed template")
    return "".join(code), "".join(text)
