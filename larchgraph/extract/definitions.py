"""Functions, methods and classes of one source file, found by walking its nesting.

A small table per language says what may stand between a parameter list and a body. Each walk begins
at a keyword or a parameter list and skips bracketed groups whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from larchgraph.extract.nesting import Nesting

# Words of the languages.
#: Words before a parenthesis that are no names of definitions.
CONTROL = set("if for while switch catch return new else do case super sizeof throw foreach lock using when typeof nameof await synchronized with function yield fixed".split())
#: Words and marks after which a function is an expression.
_EXPRESSION_WORDS = set("return typeof void new await yield case in of delete throw".split())
_EXPRESSION_MARKS = "=([,:!&|?+-*/%^~<>."
_MODIFIERS = set("public private protected static async override readonly abstract declare get set export default".split())
#: Words between a C++ parameter list and a body.
_QUALIFIERS = set("const noexcept override final volatile throw try mutable __attribute__ constexpr requires".split())
_CLASS_WORDS = {"js": "class", "java": "class|interface|enum|record", "go": "", "c": "", "cpp": "class|struct", "csharp": "class|interface|struct|record|enum"}
_NAME = re.compile(r"[A-Za-z_$#][\w$]*")
_FUNCTION = re.compile(r"\bfunction\b")
_ARROW = re.compile(r"=>")
_DECLARED = re.compile(r"\b(?:const|let|var)\s+")
_HEAD = re.compile(r"(?:[\w$.]+|extends|implements|permits|,|:|&|\s)+")


@dataclass
class Found:
    """What one file holds. spans: (start, begin, end) of all functions, `start` where the head begins."""

    defs: list[dict] = field(default_factory=list)
    spans: list[tuple[int, int, int]] = field(default_factory=list)
    classes: list[tuple[int, int, str | None, str | None]] = field(default_factory=list)
    params: dict[int, tuple[int, int]] = field(default_factory=dict)  # by where the body begins

    def add(self, name: str, at: int, begin: int, end: int, owner: str | None = None, bare: bool = False, own: str | None = None, lexical: bool = False) -> None:
        self.defs.append({"fact": "def", "pos": at, "lexical": lexical, "name": name, "owner": owner, "display": f"{owner}.{name}" if owner else name, "begin": begin, "end": end, "self": own, "bare": bare})
        self.spans.append((at, begin, end))


def classes(tree: Nesting, lang: str) -> list[tuple[int, int, str | None, str | None]]:
    """(opening brace, closing brace, name, base) of class bodies; an anonymous class has no name."""
    out = []
    words = _CLASS_WORDS[lang]
    if not words:
        return out
    for m in re.finditer(rf"(?<![.$\w])(?:{words})\b", tree.code):
        i = tree.skip(m.end())
        named = _NAME.match(tree.code, i)
        name = named[0] if named and named[0] not in ("extends", "implements") else None
        i = named.end() if name else i
        base = None
        while True:
            c = tree.char(i)
            if c == "{":
                out.append((i, tree.close(i), name, base))
                break
            if c == "<":
                end = tree.angle_end(i)
                if end is None:
                    break
                i = end
            elif c == "(":
                i = tree.close(i) + 1
            elif head := _HEAD.match(tree.code, i):
                if base is None and (of := re.search(r"\bextends\s+([\w$.]+)", head[0])):
                    base = of[1]
                i = head.end()
            else:
                break
    return out


def _bodies(tree: Nesting, close: int) -> tuple[int, bool] | None:
    """Where a script's body begins after its parameters, and whether it is an arrow's expression."""
    i = tree.skip(close + 1)
    if tree.char(i) == ":":
        end, braces = tree.type_end(i + 1)
        i = tree.skip(end)
        if tree.char(i) != "{" and not tree.code.startswith("=>", i):
            return (braces, False) if braces is not None else None
    if tree.char(i) == "{":
        return i, False
    if tree.code.startswith("=>", i):
        i = tree.skip(i + 2)
        return (i, False) if tree.char(i) == "{" else (i, True)
    return None


def _end(tree: Nesting, begin: int, bare: bool) -> int:
    return tree.expression_end(begin) if bare else tree.close(begin) + 1


def _initializer(tree: Nesting, at: int) -> tuple[int, bool, tuple[int, int]] | None:
    """(body, whether it is an expression, parameters) if a function stands at `at`."""
    i = tree.skip(at)
    if word := re.compile(r"async\b\s*").match(tree.code, i):
        i = word.end() if tree.char(word.end()) and (tree.char(word.end()) in "(<" or _NAME.match(tree.code, word.end())) else i
    if m := _FUNCTION.match(tree.code, i):
        opened = tree.code.find("(", m.end())
        head = tree.code[m.end() : opened] if opened >= 0 else ""
        if opened < 0 or re.search(r"[;{}=]", head):
            return None
        found = _bodies(tree, tree.close(opened))
        return (found[0], False, (opened, tree.close(opened))) if found and not found[1] else None
    if tree.char(i) == "<":
        end = tree.angle_end(i)
        i = tree.skip(end) if end else i
    if tree.char(i) == "(":
        close = tree.close(i)
        found = _bodies(tree, close)
        after = tree.code[close + 1 : found[0]] if found else ""
        return (*found, (i, close)) if found and "=>" in after else None
    if name := _NAME.match(tree.code, i):
        j = tree.skip(name.end())
        if tree.code.startswith("=>", j):
            begin = tree.skip(j + 2)
            return begin, tree.char(begin) != "{", (i, name.end())
    return None


def _variables(tree: Nesting, out: Found) -> None:
    for m in _DECLARED.finditer(tree.code):
        i = m.end()
        while True:
            name = _NAME.match(tree.code, i)
            if name:
                i = tree.skip(name.end())
            elif tree.char(i) and tree.char(i) in "{[":
                i = tree.skip(tree.close(i) + 1)
            else:
                break
            if tree.char(i) == "!":
                i = tree.skip(i + 1)
            if tree.char(i) == ":":
                i = tree.skip(tree.type_end(i + 1)[0])
            if tree.char(i) == "=" and not tree.code.startswith(("==", "=>"), i):
                given = _initializer(tree, i + 1)
                if given and name:
                    begin, bare, params = given
                    end = _end(tree, begin, bare)
                    rest = tree.skip(end)
                    if bare or tree.char(rest) not in "(.?&|+*/%-<=" or tree.char(rest) == "":
                        out.add(name[0], name.start(), begin, end, bare=bare, lexical=True)
                    else:
                        out.spans.append((params[0], begin, end))
                    out.params[begin] = params
                i = tree.expression_end(i + 1)
            if tree.char(i) != ",":
                break
            i = tree.skip(i + 1)


def _script(tree: Nesting, out: Found) -> None:
    code = tree.code
    bodies = {a: name for a, _, name, _ in out.classes}
    _variables(tree, out)
    taken = {d["begin"] for d in out.defs} | {b for _, b, _ in out.spans}
    for m in _FUNCTION.finditer(code):
        if code[m.start() - 1 : m.start()] == ".":
            continue
        opened = code.find("(", m.end())
        if opened < 0 or re.search(r"[;{}=]", code[m.end() : opened]):
            continue
        close = tree.close(opened)
        found = _bodies(tree, close)
        if not found or found[1] or found[0] in taken:
            continue
        word, at = tree.word_before(m.start())
        if word == "async":
            word, at = tree.word_before(at)
        mark = code[tree.before(at + len(word)) - 1 : tree.before(at + len(word))] if not word else ""
        name = _NAME.search(code, m.end(), opened)
        begin = found[0]
        out.params[begin] = (opened, close)
        if name and word not in _EXPRESSION_WORDS and (not mark or mark not in _EXPRESSION_MARKS):
            out.add(name[0], name.start(), begin, tree.close(begin) + 1, lexical=True)
        else:
            out.spans.append((m.start(), begin, tree.close(begin) + 1))
        taken.add(begin)
    for i, opened in enumerate(tree.opens):  # methods: a name and its parameters, in a class or an object
        if code[opened] != "(":
            continue
        parent = tree.parent[i]
        if parent < 0 or code[tree.opens[parent]] != "{":
            continue
        end = tree.before(opened)
        if code[end - 1 : end] == ">":
            start = tree.angle_start(end)
            end = tree.before(start) if start is not None else end
        end = tree.before(end - 1) if code[end - 1 : end] == "?" else end
        name, at = tree.word_before(end)
        if not name or name in CONTROL or not _NAME.fullmatch(name):
            continue
        head, mark_at = at, tree.before(at)
        words = []
        while True:
            if code[mark_at - 1 : mark_at] == "*":
                mark_at = tree.before(mark_at - 1)
            word, begin_word = tree.word_before(mark_at)
            if word not in _MODIFIERS:
                break
            words.append(word)
            head, mark_at = begin_word, tree.before(begin_word)
        in_class = tree.opens[parent] in bodies
        mark = code[mark_at - 1 : mark_at]
        if in_class:
            if word in _EXPRESSION_WORDS or mark in "=.,:?&|+-/%!<" or (mark == ")" and "\n" not in code[mark_at:head] and not re.search(r"@[\w$.]+$", code[max(0, tree.opened[mark_at - 1] - 60) : tree.opened[mark_at - 1]])):
                continue
        elif mark not in "{," or not _object(tree, parent):
            continue
        close = tree.closes[i]
        found = _bodies(tree, close)
        if not found or found[1] or "=>" in code[close + 1 : found[0]] or found[0] in taken:
            continue
        begin = found[0]
        taken.add(begin)
        out.params[begin] = (opened, close)
        if words and words[0] in ("get", "set") or in_class and name == "constructor":
            out.spans.append((at, begin, tree.close(begin) + 1))
        else:
            out.add(name, at, begin, tree.close(begin) + 1, bodies.get(tree.opens[parent]))
    for m in _ARROW.finditer(code):
        begin = tree.skip(m.end())
        if begin in taken:
            continue
        bare = tree.char(begin) != "{"
        at = tree.before(m.start())
        if code[at - 1 : at] == ")":
            out.params[begin] = (tree.opened[at - 1], at - 1)
        elif word := tree.word_before(at):
            out.params[begin] = (word[1], at)
        out.spans.append((m.start(), begin, _end(tree, begin, bare)))


def _object(tree: Nesting, i: int) -> bool:
    """Whether braces are an object literal."""
    at = tree.before(tree.opens[i])
    if tree.code[max(0, at - 2) : at] == "=>":
        return False
    mark = tree.code[at - 1 : at]
    return bool(mark) and mark in "=([,:?&|" or tree.word_before(at)[0] in ("return", "default", "yield", "await")


def _go(tree: Nesting, out: Found) -> None:
    code = tree.code
    for m in re.finditer(r"\bfunc\b", code):
        i, own, owner = tree.skip(m.end()), None, None
        if tree.char(i) == "(":
            close = tree.close(i)
            after = tree.skip(close + 1)
            if name := _NAME.match(code, after):
                receiver = re.match(r"\s*(?:(\w+)\s+)?\*?\s*(\w+)", code[i + 1 : close])
                own, owner = (receiver[1], receiver[2]) if receiver else (None, None)
                i = after
            else:
                continue  # a literal's branches count for the function around it
        name = _NAME.match(code, i)
        if not name:
            continue
        i = tree.skip(name.end())
        if tree.char(i) == "[":
            i = tree.skip(tree.close(i) + 1)
        if tree.char(i) == "(":
            _go_body(tree, out, name.start(), tree.close(i) + 1, (name[0], owner, own))


def _go_body(tree: Nesting, out: Found, at: int, i: int, named: tuple) -> None:
    while i < len(tree.code):
        c = tree.code[i]
        if c in "([":
            i = tree.close(i) + 1
        elif c == "{":
            if tree.word_before(i)[0] in ("struct", "interface"):
                i = tree.close(i) + 1
                continue
            out.add(named[0], at, i, tree.close(i) + 1, named[1], own=named[2])
            return
        elif c in "\n;,)=}":
            return
        else:
            i += 1


def _after(tree: Nesting, lang: str, close: int) -> tuple[int, bool] | None:
    """The body after a parameter list in the languages with C's braces."""
    code, i = tree.code, tree.skip(close + 1)
    while True:
        c = tree.char(i)
        if c == "{":
            return i, False
        word = _NAME.match(code, i)
        if lang == "java" and word and word[0] == "throws":
            m = re.compile(r"[\w$.,@\s<>]*").match(code, word.end())
            i = m.end()
        elif lang == "csharp" and word and word[0] == "where":
            end = code.find("{", i)
            arrow = code.find("=>", i)
            stop = code.find(";", i)
            i = min(x for x in (end, arrow, stop, len(code)) if x >= 0)
            if i == stop or i == len(code):
                return None
        elif lang == "csharp" and code.startswith("=>", i):
            return tree.skip(i + 2), True
        elif lang == "csharp" and c == ":" and (m := re.compile(r":\s*(?:base|this)\s*\(").match(code, i)):
            i = tree.skip(tree.close(m.end() - 1) + 1)
        elif lang == "cpp" and word and word[0] in _QUALIFIERS:
            i = tree.skip(word.end())
            if tree.char(i) == "(":
                i = tree.skip(tree.close(i) + 1)
        elif lang == "cpp" and c in "&*":
            i = tree.skip(i + 1)
        elif lang == "cpp" and code.startswith("->", i):
            i = tree.skip(i + 2)
            while (c := tree.char(i)) and (c.isalnum() or c in "_:*&<( "):
                end = tree.angle_end(i) if c == "<" else tree.close(i) + 1 if c == "(" else i + 1
                if end is None:
                    return None
                i = tree.skip(end)
        elif lang == "cpp" and c == ":" and not code.startswith("::", i):
            i = tree.skip(i + 1)
            while m := re.compile(r"[\w:]+\s*").match(code, i):
                i = m.end()
                if tree.char(i) == "<":
                    i = tree.skip(tree.angle_end(i) or i + 1)
                if tree.char(i) not in ("(", "{"):
                    return None
                i = tree.skip(tree.close(i) + 1)
                if code.startswith("...", i):
                    i = tree.skip(i + 3)
                if tree.char(i) != ",":
                    break
                i = tree.skip(i + 1)
        elif lang == "c" and word and word[0] == "__attribute__":
            i = tree.skip(word.end())
            i = tree.skip(tree.close(i) + 1) if tree.char(i) == "(" else i
        else:
            return None


def _braces(tree: Nesting, out: Found, lang: str) -> None:
    """Java, C, C++ and C#: a name, a parameter list, what may follow it, and a body."""
    code = tree.code
    bodies = {a: name for a, _, name, _ in out.classes}
    owners: list[str | None] = []
    for i, opened in enumerate(tree.opens):  # a bracket's parent comes before it
        parent = owners[tree.parent[i]] if tree.parent[i] >= 0 else None
        owners.append(bodies[opened] if opened in bodies else parent)
    heads: list[tuple[int, int]] = []
    inside: list[int] = []  # ends of bodies that are open
    for i, opened in enumerate(tree.opens):
        if code[opened] != "(" or heads and heads[-1][0] < opened < heads[-1][1]:
            continue
        while inside and inside[-1] <= opened:
            inside.pop()
        parent = tree.parent[i]
        if parent >= 0 and code[tree.opens[parent]] != "{":
            continue
        end = tree.before(opened)
        if lang in ("csharp", "cpp") and code[end - 1 : end] == ">":
            start = tree.angle_start(end)
            end = tree.before(start) if start is not None else end
        name, at = tree.word_before(end)
        if not name or name in CONTROL or not _NAME.fullmatch(name):
            continue
        name_at = at
        while lang == "cpp" and code[at - 1 : at] in ("~", ":"):
            if code[at - 1] == "~":
                at, name = at - 1, "~" + name
                name_at = at
            elif code[at - 2 : at] == "::":
                at = tree.word_before(at - 2)[1]
            else:
                break
        word, _ = tree.word_before(at)
        mark = code[tree.before(at) - 1 : tree.before(at)] if tree.before(at) else ""
        if word in CONTROL | {"in", "is", "as", "goto", "record", "delegate", "and", "or", "not"} or mark in tuple(".(,=!+-/%|^?<") and not (lang == "csharp" and mark == "?"):
            continue
        if lang in ("c", "cpp") and inside and not (parent >= 0 and tree.opens[parent] in bodies):
            continue
        found = _after(tree, lang, tree.closes[i])
        if not found:
            continue
        begin, bare = found
        if bare and not (parent >= 0 and tree.opens[parent] in bodies and (word or mark in (">", "]", "?", ")"))):
            continue
        finish = _end(tree, begin, bare)
        heads.append((opened, begin))
        inside.append(finish)
        out.add(name, name_at, begin, finish, owners[parent] if parent >= 0 else None, bare=False)


def found(tree: Nesting, lang: str) -> Found:
    """All functions of a file; defs in order of their bodies."""
    out = Found(classes=classes(tree, lang))
    if lang == "js":
        _script(tree, out)
    elif lang == "go":
        _go(tree, out)
    else:
        _braces(tree, out, lang)
    unique: dict[int, dict] = {}
    for d in out.defs:
        unique.setdefault(d["begin"], d)
    out.defs = sorted(unique.values(), key=lambda d: d["begin"])
    return out
