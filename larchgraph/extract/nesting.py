"""The nesting of one source file: a tree of its brackets as sorted arrays, and small walks along it.

The walks skip whole groups by their partner, so types, parameters and results with brackets of their
own are passed at once, and the work grows with the text's length, not with its depth.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_BRACKET = re.compile(r"[()\[\]{}]")
_PAIR = {"(": ")", "[": "]", "{": "}"}
_WORD = re.compile(r"[\w$#]+")
_SPACE = re.compile(r"\s*")
_ANGLE = re.compile(r"[<>;(){}\[\]]|=>|->")
_STOP = re.compile(r"[()\[\]{},;\n]")
_GOES_ON = re.compile(r"\s*[.?:&|+*/=<>-]")
#: What cannot be: a declaration without a name (the name of a default export may be missing).
_NAMELESS = re.compile(r"\b(?:const|let|var)\s*=|(?:^|[;{}])[ \t\r\n]*(?:async[ \t]+)?function[ \t\r\n]*\*?[ \t\r\n]*\(")
#: Words after which a type goes on.
_PREFIX = set("keyof typeof readonly infer unique asserts new abstract is extends".split())


class Nesting:
    """Brackets by opening: opens, closes, parent (its index, or -1). SyntaxError if they don't pair up."""

    def __init__(self, code: str):
        self.code = code
        self.opens: list[int] = []
        self.closes: list[int] = []
        self.parent: list[int] = []
        self.index: dict[int, int] = {}
        self.opened: dict[int, int] = {}
        stack: list[int] = []
        for m in _BRACKET.finditer(code):
            c, at = m[0], m.start()
            if c in _PAIR:
                self.index[at] = len(self.opens)
                self.parent.append(stack[-1] if stack else -1)
                stack.append(len(self.opens))
                self.opens.append(at)
                self.closes.append(-1)
            else:
                if not stack or _PAIR[code[self.opens[stack[-1]]]] != c:
                    raise SyntaxError("unbalanced bracket")
                i = stack.pop()
                self.closes[i] = at
                self.opened[at] = self.opens[i]
        if stack:
            raise SyntaxError("unclosed bracket")

    def close(self, at: int) -> int:
        return self.closes[self.index[at]]

    def around(self, at: int) -> int:
        """The index of the innermost bracket around a place, or -1."""
        i = bisect_right(self.opens, at - 1) - 1
        while i >= 0 and self.closes[i] < at:
            i = self.parent[i]
        return i

    def skip(self, at: int) -> int:
        return _SPACE.match(self.code, at).end()

    def char(self, at: int) -> str:
        return self.code[at] if at < len(self.code) else ""

    def before(self, at: int) -> int:
        """The place after the last character before `at` that is no white space."""
        while at and self.code[at - 1].isspace():
            at -= 1
        return at

    def word_before(self, at: int) -> tuple[str, int]:
        """The word that ends where white space before `at` begins, and its place."""
        end = self.before(at)
        i = end
        while i and (self.code[i - 1].isalnum() or self.code[i - 1] in "_$#"):
            i -= 1
        return self.code[i:end], i

    def angle_end(self, at: int) -> int | None:
        """The place after the angle brackets that open at `at`."""
        depth = 0
        while m := _ANGLE.search(self.code, at):
            c, at = m[0], m.end()
            if c == "<":
                depth += 1
            elif c == ">":
                depth -= 1
                if not depth:
                    return at
            elif c in _PAIR:
                at = self.close(m.start()) + 1
            elif c not in ("=>", "->"):
                return None
        return None

    def angle_start(self, end: int) -> int | None:
        """The opening of the angle brackets that end before `end`, within a bounded stretch."""
        depth, i = 0, end - 1
        while i >= max(0, end - 400):
            c = self.code[i]
            if c == ">" and self.code[i - 1 : i] not in ("=", "-"):
                depth += 1
            elif c == "<":
                depth -= 1
                if not depth:
                    return i
            elif c in ")]}":
                i = self.opened[i]
            elif c in ";([{":
                return None
            i -= 1
        return None

    def type_end(self, at: int) -> tuple[int, int | None]:
        """Where the type that begins at `at` ends, and where the braces open that it ends with, if any."""
        need, braces, conditional, group = True, None, 0, False
        while True:
            i = self.skip(at)
            c = self.char(i)
            if c and c in "([{" and (need or c == "["):
                braces, group = (i if c == "{" else None), c == "("
                at, need = self.close(i) + 1, False
                continue
            elif c == "<":
                end = self.angle_end(i)
                if end is None:
                    return at, braces
                at, braces = end, None
            elif c and c in "|&.":
                at, need = i + 1, True
            elif group and self.code.startswith("=>", i):  # a function's type; else the arrow ends the type
                at, need = i + 2, True
            elif c == "?" and not need:
                at, need, conditional = i + 1, True, conditional + 1
            elif c == ":" and not need and conditional:
                at, need, conditional = i + 1, True, conditional - 1
            elif (m := _WORD.match(self.code, i)) and (need or m[0] in ("is", "extends")):
                at, need, braces = m.end(), m[0] in _PREFIX, None
            else:
                return at, braces
            group = False

    def expression_end(self, at: int) -> int:
        """Where the expression that begins at `at` ends: before a comma, semicolon or closing bracket of
        its own depth, or a line break that nothing carries on."""
        begin = self.skip(at)
        i = begin
        while m := _STOP.search(self.code, i):
            c = m[0]
            if c in _PAIR:
                i = self.close(m.start()) + 1
                continue
            if c != "\n":
                return m.start()
            last = self.before(m.start())
            if last > begin and not _GOES_ON.match(self.code, m.start()) and self.code[last - 1] not in ".?:&|+*/=<>,(-":
                return m.start()
            i = m.end()
        return len(self.code)


def checked(code: str) -> Nesting:
    """The nesting of a script's code without comments and literals; SyntaxError where it cannot be a
    script. Function extraction, import health and contracts share this one check."""
    tree = Nesting(code)
    if m := _NAMELESS.search(code):
        raise SyntaxError(f"a declaration without a name at {m.start()}")
    return tree
