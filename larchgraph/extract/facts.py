"""Definitions and call sites of source files, one Arrow pass over source_files(project_id, path, content).

Each row says what one file shows by itself: `def`, `call` and `import` facts, and a `file` fact with
exports, shebang, lines and parse errors. What a call refers to is settled by joins, in operators.resolve. Python
is read with the standard library's syntax tree; languages with braces by walks along the nesting of
text whose comments and literals are blanked out (definitions, nesting). Both are helpers for one file, in
time that grows with its length; Spark spreads the files. A script also tells `link` facts: what its names stand for.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from larchgraph.extract import definitions as D
from larchgraph.extract import text
from larchgraph.extract.links import links_of
from larchgraph.extract.nesting import Nesting, checked

SCHEMA = (
    "project_id string, path string, lang string, fact string, pos int, line int, name string, owner string, display string, complexity int, body string, "
    "caller int, receiver string, bound_module string, bound_name string, level int, target int, awaited boolean, exports int, shebang boolean, parse_error boolean, loc int"
)
FIELDS = [x.split() for x in SCHEMA.split(", ")]
ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}

# Languages by file ending, and the words that add a branch in each. A loop with its
# condition at the end has one `while`; a word after a dot is a name.
LANGUAGES = {
    "python": "py pyi", "java": "java", "go": "go", "c": "c h", "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs", "js": "cjs mjs js jsx ts tsx",
}
#: Scripts whose imports count, but whose functions do not.
IMPORTS_ONLY = ("mts", "cts")
BRANCHES = {
    "java": r"(?<![.$])\b(?:if|for|while|catch)\b|\b(?:case\b[^:>]*|default\s*):(?!:)|\?(?![.>,])",
    "go": r"(?<![.$])\b(?:if|for|case)\b",
    "c": r"(?<![.$])\b(?:if|for|while|case|default)\b|\?",
    "cpp": r"(?<![.$])\b(?:if|for|while|case|default|catch)\b|\?",
    "csharp": r"(?<![.$])\b(?:if|for|foreach|while|case|default|catch)\b|\?(?![.?\[>,])(?=[^;]*:)",
    "js": r"(?<![.$])\b(?:if|for|while|case|catch)\b(?!\s*:)|&&|\|\||\?(?![.?:,)])(?<!\?\?)",
}
ENDINGS = {e: lang for lang, es in LANGUAGES.items() for e in es.split()}
#: Words before a parenthesis that are no calls, unless they stand after a dot.
_COMMON = set("if for while switch catch return new else do case super sizeof throw".split())
_KEYWORDS = {lang: _COMMON | set(words.split()) for lang, words in {
    "js": "function typeof await delete import require void yield", "java": "synchronized", "go": "func go defer select", "c": "", "cpp": "delete", "csharp": "foreach lock using when typeof nameof await",
}.items()}
_IMPORT = re.compile(r"(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)(['\"])([^'\"\n]+)\1")
_EXPORT = re.compile(r"^\s*export\b(?:\s*\{([^}]*)\})?(?!\s*\*)", re.M)
_CALL = re.compile(r"(?:(?P<recv>[\w.\]\)]+(?:(?:\.|->|::)\w+)*)\s*(?P<sep>\?\.|\.|->|::)\s*)?(?P<name>\w+)\s*\(")
_SCRIPT_CALL = re.compile(r"(?:(?P<recv>[\w$#.\]\)]+)\s*(?P<sep>\?\.|\.)\s*)?(?P<name>[\w$#]+)\s*(?:<[^<>()=;{}]*(?:<[^<>()=;{}]*>[^<>()=;{}]*)*>)?\(")
#: What an arrow's expression may be itself.
_OPERATOR = re.compile(r"&&|\|\||(?<!\?)\?(?![.?:,)])")
#: How far back the words before a call are looked for.
_BACK = 200


def _python(source: str) -> tuple[list[dict], int]:
    tree, out = ast.parse(source), []
    bound: dict[str, tuple] = {}
    for node in tree.body:  # bindings at module level; a later one wins
        if isinstance(node, ast.Import):
            for a in node.names:
                bound[a.asname or a.name] = (a.name, None, 0)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                if a.name != "*":
                    bound[a.asname or a.name] = (node.module or "", a.name, node.level)
    branches = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.match_case, ast.IfExp)

    def complexity(node: ast.AST) -> int:
        n = 0
        for x in ast.iter_child_nodes(node):
            if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                n += isinstance(x, branches) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) + (1 + len(x.ifs) if isinstance(x, ast.comprehension) else 0) + complexity(x)
        return n

    def refer(node: ast.Call, owner: str | None) -> dict | None:
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        receiver = ast.unparse(f.value) if isinstance(f, ast.Attribute) else None
        if name is None:
            return None
        fact = {"name": name, "receiver": receiver}
        parts = receiver.split(".") if receiver else [name]
        for k in range(len(parts), 0, -1):  # the longest bound prefix
            if hit := bound.get(".".join(parts[:k])):
                module, symbol, level = hit
                rest = [*parts[k:], *([name] if receiver else [])]
                fact |= {"bound_module": module, "level": level, "bound_name": ".".join([symbol or "", *rest]) if symbol is not None else "." + ".".join(rest)}
                break
        return fact

    def visit(node: ast.AST, owner: str | None, caller: int | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                pos = len(out)
                out.append({"fact": "def", "pos": pos, "line": x.lineno, "name": x.name, "owner": owner, "display": f"{owner}.{x.name}" if owner else x.name, "complexity": 1 + complexity(x), "body": ast.unparse(x)})
                visit(x, owner, pos)
            elif isinstance(x, ast.ClassDef):
                visit(x, x.name, caller)
            else:
                if isinstance(x, ast.Call) and caller is not None and (fact := refer(x, owner)):
                    out.append({"fact": "call", "pos": len(out), "line": x.lineno, "caller": caller, "owner": owner, "awaited": False} | fact)
                visit(x, owner, caller)

    visit(tree, None, None)
    return out, 0


class _Sweep:
    """The innermost of nested stretches (start, end, what) around places that are asked in order."""

    def __init__(self, stretches: list[tuple[int, int, object]]):
        self.todo = sorted(stretches, key=lambda x: (x[0], -x[1]))
        self.next, self.open = 0, []

    def at(self, place: int) -> object | None:
        while self.next < len(self.todo) and self.todo[self.next][0] <= place:
            while self.open and self.open[-1][1] <= self.todo[self.next][0]:
                self.open.pop()
            self.open.append(self.todo[self.next])
            self.next += 1
        while self.open and self.open[-1][1] <= place:
            self.open.pop()
        return self.open[-1][2] if self.open else None


def _complexities(code: str, lang: str, tree: Nesting, found: D.Found) -> None:
    """1 and the branches of each body, without functions inside it. What an arrow's expression is
    itself does not count."""
    by_begin = {d["begin"]: d for d in found.defs}
    for d in found.defs:
        d["complexity"] = 1
    sweep = _Sweep([(start, end, begin) for start, begin, end in found.spans])
    roots: set[int] = set()
    for m in re.finditer(BRANCHES[lang], code):
        begin = sweep.at(m.start())
        d = by_begin.get(begin)
        if d and m.start() >= begin:
            d["complexity"] += 1
            if d["bare"] and begin not in roots and _OPERATOR.match(code, m.start()) and tree.around(m.start()) == tree.around(begin):
                roots.add(begin)
                d["complexity"] -= 1


class _Scopes:
    """What names stand for inside one script: functions, aliases, and what hides them."""

    def __init__(self, code: str, tree: Nesting, found: D.Found):
        self.code, self.tree, self.params = code, tree, found.params
        self.names: dict[tuple[int, str], object] = {}
        for m in re.finditer(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?(?:=\s*(new\s+)?([A-Za-z_$][\w$]*)\s*(?=;|,|\n|\(|$))?", code):
            scope = self.scope(m.start())
            if scope >= 0:  # of the file's own level, links tell
                whole = m[3] and (m[2] or code[m.end() : m.end() + 1] != "(")
                self.names.setdefault((scope, m[1]), ("name", m[3]) if whole else None)
        for d in found.defs:
            if d.get("lexical"):
                self.names[self.scope(d["pos"]), d["name"]] = d["pos"]
        self.hidden = {begin: set(re.findall(r"[A-Za-z_$][\w$]*", code[a : b + 1])) for begin, (a, b) in found.params.items()}
        self.bare = _Sweep([(begin, end, begin) for _, begin, end in found.spans if code[begin : begin + 1] != "{"])

    def scope(self, at: int) -> int:
        """The opening of the innermost braces around a place, or -1."""
        i = self.tree.around(at)
        while i >= 0 and self.code[self.tree.opens[i]] != "{":
            i = self.tree.parent[i]
        return self.tree.opens[i] if i >= 0 else -1

    def find(self, name: str, at: int) -> tuple[int | None, str | None]:
        """(the function, the file's own name) that a name at a place stands for; places in order."""
        arrow = self.bare.at(at)
        scope = self.scope(at)
        for _ in range(20):  # aliases of aliases
            while scope >= 0:
                if arrow is not None and arrow > scope and name in self.hidden.get(arrow, ()):
                    return None, None
                if (scope, name) in self.names:
                    break
                if name in self.hidden.get(scope, ()):
                    return None, None
                scope = self.scope(scope)
            else:
                if arrow is not None and name in self.hidden.get(arrow, ()):
                    return None, None
            hit = self.names.get((scope, name), name if scope < 0 else None)
            if isinstance(hit, int):
                return hit, name if scope < 0 else None
            if isinstance(hit, tuple) and hit[1] != name:
                name = hit[1]
                continue
            return None, hit if isinstance(hit, str) else None
        return None, None


def _braces(source: str, lang: str) -> tuple[list[dict], int]:
    code, bare_text = text.script(source) if lang == "js" else (text.plain(source), source)
    tree = checked(code) if lang == "js" else Nesting(code)
    found = D.found(tree, lang)
    defs = found.defs
    lines = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_right(lines, at - 1) + 1
    _complexities(code, lang, tree, found)
    for d in defs:
        d["line"], d["body"] = line(d["pos"]), source[d["begin"] : d["end"]]
    out = list(defs)
    named = {d["pos"] for d in defs}
    scopes = _Scopes(code, tree, found) if lang == "js" else None
    bodies = _Sweep([(d["begin"], d["end"], d) for d in defs])
    within = _Sweep([(a, b, n) for a, b, n, _ in found.classes])
    for m in (_SCRIPT_CALL if lang == "js" else _CALL).finditer(code):
        at, name = m.start("name"), m["name"]
        back = code[max(0, at - _BACK) : at]
        if not m["recv"] and name in _KEYWORDS[lang] or at in named or re.search(r"\bnew\s+[\w.]*$", back) or code[max(0, m.start() - 5) : m.start()] == "func ":
            continue
        d = bodies.at(at)
        if d and (lang != "c" or not m["recv"]) and not (lang == "cpp" and m["sep"] == "::"):
            receiver = m["recv"].replace("->", ".").replace("::", ".") if m["recv"] else None
            if receiver and receiver == d["self"] or receiver in ("this", "self"):
                receiver = "this"
            elif receiver and receiver.startswith(("this.", "self.")):
                receiver = receiver[5:]
            row = {"fact": "call", "pos": at, "line": line(at), "caller": d["pos"], "owner": d["owner"], "name": name, "receiver": receiver, "awaited": bool(re.search(r"\bawait\s+[\w.]*$", back))}
            if scopes:
                row["owner"] = within.at(at)
                if receiver is None:
                    row["target"], row["bound_name"] = scopes.find(name, at)
                elif receiver != "this" and re.fullmatch(r"[A-Za-z_$][\w$]*", receiver):
                    row["bound_name"] = scopes.find(receiver, at)[1]
            out.append(row)
    if lang != "js":
        return out, 0
    # a specifier counts where its word is code
    out += [{"fact": "import", "pos": m.start(), "line": line(m.start()), "name": m[2]} for m in _IMPORT.finditer(source) if code[m.start()] == source[m.start()]]
    out += [{"fact": "link", "pos": x["pos"], "name": x["name"], "owner": x["kind"], "bound_module": x["spec"], "bound_name": x["symbol"]} for x in links_of(code, bare_text, tree, found.classes)]
    return out, sum(len([x for x in m[1].split(",") if x.strip()]) if m[1] is not None else 1 for m in _EXPORT.finditer(code))


def facts_of(path: str, content: str) -> list[dict]:
    """The facts of one file; a file that cannot be read has its `file` fact alone, with parse_error."""
    ending = path.rsplit(".", 1)[-1].lower()
    lang = ENDINGS.get(ending)
    loc = content.count("\n") + 1 if content else 0
    file = {"fact": "file", "lang": lang, "shebang": content.startswith("#!"), "parse_error": False, "exports": 0, "loc": loc}
    if lang is None and ending not in IMPORTS_ONLY:
        return [file]
    try:
        rows, file["exports"] = _python(content) if lang == "python" else _braces(content, lang or "js")
    except (SyntaxError, ValueError, RecursionError, KeyError):
        return [file | {"parse_error": True}]
    return [file, *({"lang": lang} | r for r in rows if lang or r["fact"] == "import")]


def extract(source_files: DataFrame) -> DataFrame:
    """All facts of SCHEMA. Files without a path are left out; null content is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for project, path, content in zip(*(batch.column(c).to_pylist() for c in ("project_id", "path", "content")), strict=True):
                rows += [{"project_id": project, "path": path} | r for r in facts_of(path, content or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], ARROW[k]) for n, k in FIELDS], [n for n, _ in FIELDS])

    return source_files.filter("path is not null").select("project_id", "path", "content").mapInArrow(run, SCHEMA)
