"""Call expressions of scripts with their arguments, one Arrow pass over source_files.

Each row says what stands in one file: `call` rows, exported names, `link` rows (see links), `class` and `method` rows with
decorators, and a `file` row with the text without comments. Who a receiver is and what a call means is settled by joins and
column functions, in extract.http.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from larchgraph.extract import definitions as D
from larchgraph.extract import text as T
from larchgraph.extract.links import links_of
from larchgraph.extract.nesting import Nesting, checked

ARGUMENT = "struct<kind:string,text:string,names:array<string>,props:map<string,string>,first:int,last:int>"
SCHEMA = (
    f"project_id string, path string, fact string, pos int, line int, name string, receiver string, args array<{ARGUMENT}>, assigned string, "
    "scope string, first int, last int, decorators map<string,string>, text string, parse_error boolean"
)
_PAIRS = pa.map_(pa.string(), pa.string())
_ARGUMENT = pa.struct([("kind", pa.string()), ("text", pa.string()), ("names", pa.list_(pa.string())), ("props", _PAIRS), ("first", pa.int32()), ("last", pa.int32())])
ARROW = {
    "project_id": pa.string(), "path": pa.string(), "fact": pa.string(), "pos": pa.int32(), "line": pa.int32(), "name": pa.string(), "receiver": pa.string(), "args": pa.list_(_ARGUMENT),
    "assigned": pa.string(), "scope": pa.string(), "first": pa.int32(), "last": pa.int32(), "decorators": _PAIRS, "text": pa.string(), "parse_error": pa.bool_(),
}
_CONTROL = set("if for while switch catch with".split())
_NO_CALL = _CONTROL | set("function return typeof await new case throw in of do else import super void delete yield".split())
_NAMED = re.compile(r"([\w$]+)\s*(?:<[^<>()=;]*>)?\s*\(")
_BODY = re.compile(r"\s*(?::[^{};=()]+)?\{")
_FUNCTION = re.compile(r"(?:async\s+)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{]+)?=>|[\w$]+\s*=>)")
_KEY = re.compile(r"\s*(?:async\s+)?([\"']?)([\w$-]+)\1\s*(:|\(|\Z)")
_ASSIGNED = re.compile(r"(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]+)?=\s*(?:await\s+)?\Z")
_AFTER_DECORATORS = re.compile(r"\s*(?:(?:export|default|abstract|public|private|protected|static|async|readonly|override)\s+)*(?:class\s+(?P<class>[\w$]+)[^{]*(?P<open>\{)|(?P<method>[\w$]+)\s*\()")


def _pairs(tree: Nesting) -> dict[int, int]:
    """Each bracket's partner."""
    return dict(zip(tree.opens, tree.closes, strict=True)) | tree.opened


def _split(code: str, pair: dict[int, int], a: int, b: int) -> list[tuple[int, int]]:
    """The parts between top-level commas."""
    out, i, start = [], a, a
    while i < b:
        if code[i] in "([{":
            i = pair[i]
        elif code[i] == ",":
            out.append((start, i))
            start = i + 1
        i += 1
    return [(x, y) for x, y in [*out, (start, b)] if code[x:y].strip() or y > x]


def _argument(code: str, text: str, pair: dict[int, int], a: int, b: int) -> dict | None:
    raw = text[a:b]
    a += len(raw) - len(raw.lstrip())
    raw = raw.strip()
    if not raw:
        return None
    out = {"kind": "other", "text": raw, "names": [], "props": [], "first": a, "last": a + len(raw)}
    inner = code[a : a + len(raw)].strip()
    if raw[0] in "\"'`" and raw[-1] == raw[0] and not inner:
        out["kind"] = "literal"
    elif raw[0] == raw[-1] == "`":
        out["kind"] = "template"
    elif raw[0] == "{" and pair.get(a) == a + len(raw) - 1:
        out["kind"] = "object"
        for x, y in _split(code, pair, a + 1, a + len(raw) - 1):
            if key := _KEY.match(text[x:y].rstrip()):
                out["names"].append(key[2])
                if key[3] == ":":
                    out["props"].append((key[2], text[x + key.end() : y].strip()))
        out["props"] = list(dict(out["props"]).items())
    elif _FUNCTION.match(raw):
        out["kind"] = "function"
    elif re.fullmatch(r"[\w$]+", raw):
        out["kind"] = "name"
    return out


def _start(code: str, pair: dict[int, int], at: int) -> tuple[int, int | None]:
    """Where the expression begins whose last name is at `at`, and where its receiver ends."""
    i, dot = at, None
    while True:
        j = i - 1
        while j >= 0 and code[j].isspace():
            j -= 1
        if j < 0 or code[j] != ".":
            return i, dot
        dot = j if dot is None else dot
        j -= 2 if code[j - 1] == "?" else 1
        while j >= 0 and code[j].isspace():
            j -= 1
        while j >= 0 and code[j] in ")]":
            j = pair[j] - 1
        while j >= 0 and (code[j].isalnum() or code[j] in "_$"):
            j -= 1
        i = j + 1


def calls_of(source: str) -> list[dict]:
    """The rows of one file, or its `file` row with parse_error."""
    try:
        code, text = T.script(source)
        tree = checked(code)
        pair = _pairs(tree)
    except SyntaxError:
        return [{"fact": "file", "text": "", "parse_error": True}]
    lines = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_right(lines, at - 1) + 1
    arguments = lambda a: [x for x in (_argument(code, text, pair, *p) for p in _split(code, pair, a + 1, pair[a])) if x]
    spans = [(m.start(), pair[m.end() - 1]) for m in re.finditer(r"=>\s*\{", code)]
    rows, calls = [{"fact": "file", "text": text, "parse_error": False}], []
    for m in _NAMED.finditer(code):
        at, opened, before = m.start(), m.end() - 1, code[max(0, m.start() - 30) : m.start()].rstrip()
        body = _BODY.match(code, pair[opened] + 1)
        member = before.endswith(".")
        if body and m[1] not in _CONTROL and not before.endswith(tuple("?:=(&|!.<>+-")):
            spans.append((at, pair[body.end() - 1]))
        elif (member or m[1] not in _NO_CALL) and not before.endswith("@") and not re.search(r"\bfunction\s*\*?\Z", before):
            calls.append((at, opened, m[1]))
    for at, opened, name in calls:
        first, dot = _start(code, pair, at)
        head = code[max(0, first - 200) : first]
        if re.search(r"\bnew\s+\Z", head):
            continue
        assigned = _ASSIGNED.search(head)
        row = {"fact": "call", "pos": first, "line": line(first), "name": name, "receiver": re.sub(r"\s+", "", text[first:dot]).replace("?", "") if dot else None, "args": arguments(opened), "last": pair[opened] + 1}
        if assigned:
            inside = max(((a, b) for a, b in spans if a < first < b), default=(0, len(text)))
            row |= {"assigned": assigned[1], "scope": text[inside[0] : inside[1]]}
        rows.append(row)
    for m in re.finditer(r"\bexport\s+(?:async\s+)?(?:function\s*\*?|const|let|var)\s+([\w$]+)", code):
        rows.append({"fact": "export", "pos": m.start(), "line": line(m.start()), "name": m[1]})
    rows += [{"fact": "link", "pos": x["pos"], "line": line(x["pos"]), "name": x["name"], "receiver": x["spec"], "assigned": x["symbol"], "scope": x["kind"]} for x in links_of(code, text, tree, D.classes(tree, "js"))]
    run: dict[str, str] = {}
    end = start = 0
    for m in re.finditer(r"@([\w$.]+)\s*(\()?", code):
        if not run or code[end : m.start()].strip():
            run, start = {}, m.start()
        given = arguments(m.end() - 1) if m[2] else []
        run[m[1]] = given[0]["text"] if given else ""
        end = pair[m.end() - 1] + 1 if m[2] else m.end()
        if follows := _AFTER_DECORATORS.match(code, end):
            opened = follows.end() - 1
            if follows["class"]:
                rows.append({"fact": "class", "pos": start, "line": line(start), "name": follows["class"], "first": opened, "last": pair[opened], "decorators": list(run.items())})
            elif body := _BODY.match(code, pair[opened] + 1):
                inside = text[body.end() : pair[body.end() - 1]]
                rows.append({"fact": "method", "pos": start, "line": line(start), "name": follows["method"], "first": body.end() - 1, "last": pair[body.end() - 1], "decorators": list(run.items()), "args": arguments(opened), "scope": inside})
    return rows


def extract(files: DataFrame) -> DataFrame:
    """The rows of SCHEMA of files(project_id, path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for project, path, content in zip(*(batch.column(c).to_pylist() for c in ("project_id", "path", "content")), strict=True):
                rows += [{"project_id": project, "path": path} | r for r in calls_of(content or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in ARROW.items()], list(ARROW))

    return files.select("project_id", "path", "content").mapInArrow(run, SCHEMA)
