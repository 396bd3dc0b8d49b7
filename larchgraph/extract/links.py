"""Names of a script that stand for other names: imports, exports, re-exports, aliases and bases.

A link says (kind, name, spec, symbol): `import` binds a local name to a symbol of another file,
`alias` and `instance` a local name to another one (or to the class that it is made of), `export` an
exported name to a local one, `reexport` an exported name to a symbol of another file, `star` all exports of
another file, `base` a class to the class that it extends. The symbol `*` is a whole module, `default` its
default export, which module.exports is too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from larchgraph.extract.nesting import Nesting

_NAME = r"[A-Za-z_$][\w$]*"
_IMPORT = re.compile(rf"\bimport\s+(?:type\s+)?(?:({_NAME})\s*,?\s*)?(?:\*\s*as\s+({_NAME})|\{{([^}}]*)\}})?\s*from\s*(['\"])([^'\"\n]+)\4")
_REQUIRE = re.compile(rf"(?:\b(?:const|let|var)\s+({_NAME}|\{{[^}}]*\}})\s*(?::[^=;]+)?|\bimport\s+({_NAME})\s*)=\s*require\s*\(\s*(['\"])([^'\"\n]+)\3\s*\)(?:\s*\.\s*({_NAME}))?")
_FROM = re.compile(rf"\bexport\s+(?:type\s+)?(?:(\*)(?:\s*as\s+({_NAME}))?|\{{([^}}]*)\}})\s*from\s*(['\"])([^'\"\n]+)\4")
_LIST = re.compile(r"\bexport\s+(?:type\s+)?\{([^}]*)\}(?!\s*from)")
_DECLARED = re.compile(rf"\bexport\s+(default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:(?:const|let|var)\s+|function\s*\*?\s*|class\s+)({_NAME})")
_DEFAULT = re.compile(rf"(?:\bexport\s+default\s+|\bmodule\.exports\s*=\s*)({_NAME})\s*(?=;|\n|\}}|$)")
_MEMBER = re.compile(rf"\b(?:module\.)?exports\.({_NAME})\s*=\s*({_NAME})\s*(?=;|\n|\}}|$)")
_OBJECT = re.compile(r"\bmodule\.exports\s*=\s*\{([^{}]*)\}")
_ALIAS = re.compile(rf"\b(?:const|let|var)\s+({_NAME})\s*(?::[^=;\n]+)?=\s*(new\s+)?({_NAME})\s*(?=;|,|\n|$|\()")
_PART = re.compile(rf"^\s*(?:type\s+)?({_NAME})(?:\s+as\s+|\s*:\s*)?({_NAME})?\s*$")
_RESERVED = set("function class async await new require import null undefined true false this typeof void".split())


def _parts(text: str) -> Iterator[tuple[str, str]]:
    """(first, last) names of `a`, `a as b` and `a: b` in a list."""
    for part in text.split(","):
        if m := _PART.match(part):
            yield m[1], m[2] or m[1]


def links_of(code: str, text: str, tree: Nesting, classes: list) -> list[dict]:
    """The links of one file, in order. text: the source without comments, code: also without literals.
    Aliases count at the file's own level only; those of functions are a matter of their scope."""
    out: list[dict] = []

    def add(kind: str, at: int, name: str | None, spec: str | None = None, symbol: str | None = None) -> None:
        out.append({"kind": kind, "pos": at, "name": name, "spec": spec, "symbol": symbol})

    def real(pattern: re.Pattern) -> Iterator[re.Match]:
        return (m for m in pattern.finditer(text) if code[m.start()] == text[m.start()] and code[m.start()].strip())

    for m in real(_IMPORT):
        if m[1]:
            add("import", m.start(), m[1], m[5], "default")
        if m[2]:
            add("import", m.start(), m[2], m[5], "*")
        for symbol, name in _parts(m[3] or ""):
            add("import", m.start(), name, m[5], symbol)
    for m in real(_REQUIRE):
        name = m[1] or m[2]
        if name.startswith("{"):
            for symbol, local in _parts(name[1:-1]):
                add("import", m.start(), local, m[4], symbol)
        else:
            add("import", m.start(), name, m[4], m[5] or "*")
    for m in real(_FROM):
        if m[1] and not m[2]:
            add("star", m.start(), None, m[5])
        elif m[2]:
            add("reexport", m.start(), m[2], m[5], "*")
        for symbol, name in _parts(m[3] or ""):
            add("reexport", m.start(), name, m[5], symbol)
    for m in real(_LIST):
        for local, name in _parts(m[1]):
            add("export", m.start(), name, None, local)
    for m in real(_DECLARED):
        if m[2] not in _RESERVED:
            add("export", m.start(), "default" if m[1] else m[2], None, m[2])
    for m in real(_DEFAULT):
        if m[1] not in _RESERVED:
            add("export", m.start(), "default", None, m[1])
    for m in real(_MEMBER):
        add("export", m.start(), m[1], None, m[2])
    for m in real(_OBJECT):
        for name, local in _parts(m[1]):
            add("export", m.start(), name, None, local)
    for m in real(_ALIAS):
        if m[3] not in _RESERVED and tree.around(m.start()) < 0 and (m[2] or text[m.end() : m.end() + 1] != "("):
            add("instance" if m[2] else "alias", m.start(), m[1], None, m[3])
    for at, _, name, base in classes:
        if name and base and tree.parent[tree.index[at]] < 0:
            add("base", at, name, None, base)
    return out
