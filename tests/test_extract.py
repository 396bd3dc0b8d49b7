"""Source files to call graphs: small projects with known edges and complexities."""

import time

import pytest

from larchgraph.extract import facts as X
from larchgraph.operators import resolve as V


def graph(spark, files):
    df = spark.createDataFrame([("p", p, c) for p, c in files.items()], "project_id string, path string, content string")
    f = X.extract(df).cache()
    nodes = {r["id"]: r["complexity"] for r in V.functions(f).collect()}
    found = {(r["src"], r["dst"]): r["resolution"] for r in V.edges(V.calls(f)).collect()}
    return nodes, found


CASES = [
    ({"a.py": "def f():\n    g()\ndef g():\n    f()\n"}, {("a.py#f", "a.py#g"): "same-file", ("a.py#g", "a.py#f"): "same-file"}),
    ({"a.py": "class A:\n def run(self):\n  self.help()\n def help(self): pass\nclass B:\n def help(self): pass\n"}, {("a.py#A.run", "a.py#A.help"): "exact"}),
    ({"a.py": "def f(): pass", "b.py": "def f(): pass", "c.py": "def g(): f()"}, {}),
    ({"a.py": "def f(): pass", "c.py": "def g(): f()"}, {}),
    ({"pkg/__init__.py": "", "pkg/mod.py": "def f(): pass", "m.py": "import pkg.mod\nimport pkg.mod as x\ndef a(): pkg.mod.f()\ndef b(): x.f()"}, {("m.py#a", "pkg/mod.py#f"): "import", ("m.py#b", "pkg/mod.py#f"): "import"}),
    ({"src/pkg/__init__.py": "", "src/pkg/mod.py": "def f(): pass", "src/pkg/use.py": "from . import mod\nfrom .mod import f as g\ndef a(): mod.f()\ndef b(): g()"}, {("src/pkg/use.py#a", "src/pkg/mod.py#f"): "import", ("src/pkg/use.py#b", "src/pkg/mod.py#f"): "import"}),
    ({"m.py": "class C:\n def m(self): pass\n", "u.py": "from m import C\ndef a(): C.m()\ndef b(c): c.m()"}, {("u.py#a", "m.py#C.m"): "import"}),
    ({"m.py": "def f(): pass", "u.py": "from m import f\ndef f(): pass\ndef a(): f()"}, {("u.py#a", "u.py#f"): "same-file"}),
    ({"A.java": "class A { int total(){ return price()+tax(); } int price(){ return 1; } int tax(){ return total(); } }"}, {("A.java#A.total", "A.java#A.price"): "exact", ("A.java#A.total", "A.java#A.tax"): "exact", ("A.java#A.tax", "A.java#A.total"): "exact"}),
    ({"A.java": "class A { void run(){ this.help(); } void help(){} } class B { void help(){} }"}, {("A.java#A.run", "A.java#A.help"): "exact"}),
    ({"A.java": "class A { void run(B b){ b.go(); } } class B { void go(){} }"}, {}),
    ({"s.go": "package m\nfunc (s *Svc) Run() { s.help() }\nfunc (s *Svc) help() {}\n"}, {("s.go#Svc.Run", "s.go#Svc.help"): "exact"}),
    ({"a.c": "int add(int a) { return a; }\nint main() { return add(1); }"}, {("a.c#main", "a.c#add"): "same-file"}),
    ({"a.ts": "const ping = () => 1;\nexport const a = () => ping();", "b.ts": "const ping = () => 2;\nconst b = () => { return ping(); };"}, {("a.ts#a", "a.ts#ping"): None, ("b.ts#b", "b.ts#ping"): None}),
    ({"a.js": "function outer() { function inner() { leaf(); } }\nfunction leaf() { /* leaf() */ return 'leaf()'; }"}, {("a.js#inner", "a.js#leaf"): None}),
    ({"a.js": "export function login() { check(); }", "b.js": "export function check() {}"}, {("a.js#login", "b.js#check"): None}),
    ({"a.ts": "function f() { f(); }", "a.py": "def f():\n f()"}, {("a.ts#f", "a.ts#f"): None, ("a.py#f", "a.py#f"): "same-file"}),
]


FORMS = {
    # path: (source, {display: complexity})
    "destructured.js": ("function f({ a, b } = {}) { if (a) { g(b); } }", {"f": 2}),
    "component.tsx": ("export function App({ title }: Props) { return h(title) || null; }", {"App": 2}),
    "object_type.ts": ("function f(): { a: number } { if (a) g(); }\nconst k = (): { b: string }[] => { for (;;) {} };", {"f": 2, "k": 2}),
    "named.js": ("const a = function named() { b(); }; call(function other() { if (x) {} });", {"a": 1}),
    "methods.ts": ("class A<T extends { x: number }> extends B<T> { #p() {} get v() { return 1; } static async *z<U>(a: U): Promise<U[]> { return q(a); } constructor(a) { if (a) {} } w = () => 1; @D({ k: 1 }) m?(): void { } }", {"A.#p": 1, "A.z": 1, "A.m": 1}),
    "objects.js": ("const o = { m() { q(); }, async n({ z }) { w(); }, get g() { return 1; }, p: (a) => a };\nmodule.exports = { r(a) { return a ? 1 : 2; } };", {"m": 1, "n": 1, "r": 2}),
    "types.ts": ("const f: (a: number) => void = (a) => { g(a); }, h = <T,>(x: T): x is Y => x && k(x);\nfunction ov(a: string): void;\nfunction ov(a) { return function inner() { if (b) {} }; }", {"f": 1, "h": 1, "ov": 1}),
    "anonymous.js": ("export default class { run() { if (a) {} } }\nexport default function () { if (a) {} }", {"run": 2}),
    "curried.js": ("const a = x => y => x ? y : 1;\nconst b = async x => { await a(x)(1); }\nconst c = useCallback(() => { if (x) {} }, [x]);", {"a": 1, "b": 1}),
    "g.go": ("package m\nfunc Map[T any](xs []T, f func(T) int) map[string]struct{} { for range xs { f(1) }; return nil }\nfunc (s *S[T]) M() (int, error) { s.M() }\nfunc (S) N() { }\nfunc x() func(int) error { return func(a int) error { if a > 1 { y() }; return nil } }\ntype I interface { Q(a int) }", {"Map": 2, "S.M": 1, "S.N": 1, "x": 2}),
    "c.cs": ("class C { void M<T>() where T : class, new() { N(); } int X() => 1; int N() { return X() + this.X(); } C(int a) : base(a) { N(); } int? Q(int x) => x > 1 ? N() : 2; List<int> L(int a = F(1)) { return xs.Select(x => F(x)); } public override string ToString() => $\"{a}\"; }", {"C.M": 1, "C.X": 1, "C.N": 1, "C.C": 1, "C.Q": 2, "C.L": 1, "C.ToString": 1}),
    "x.cpp": ("X::X(int a) : a_(a), b_{a} { go(); }\nauto f(int a) -> std::vector<int> { return g(a); }\nclass Y { public: Y(int b) noexcept : b_(b) { } ~Y() { } template<class T> T get() const override { if (b_) { } return h(); } };\nint main() { if (a) { f(1); } else if (b) { } return 0; }\nnamespace n { static int* q(const char* s) { return 0; } }", {"X": 1, "f": 1, "Y.Y": 1, "Y.~Y": 1, "Y.get": 2, "main": 3, "q": 1}),
    "A.java": ("class A { <T extends B> T m(List<T> x) throws E, F { return n(x); } A(int q) { this.m(q); } Runnable r = () -> { m(1); }; record P(int x) { int y() { return x; } } enum K { A, B; int v() { return 1; } } @Override public int[] w(int[] a) { if (a != null) { } return a; } abstract void z(); Object o = new Object() { public String toString() { return s(); } }; }", {"A.m": 1, "A.A": 1, "P.y": 1, "K.v": 1, "A.w": 2, "A.toString": 1}),
    "a.c": ("static inline int add(int a, int (*f)(int)) { return f(a) ? 1 : 2; }\nstruct s *make(void) { while (1) { } }\nint decl(int a);\nvoid attr(void) __attribute__((noinline)) { add(1, g); }", {"add": 2, "make": 2, "attr": 1}),
}


@pytest.mark.parametrize("path", FORMS)
def test_everyday_forms(path):
    source, want = FORMS[path]
    facts = X.facts_of(path, source)
    assert not facts[0]["parse_error"]
    assert {r["display"]: r["complexity"] for r in facts if r["fact"] == "def"} == want


@pytest.mark.parametrize("code", ["function (", "f(]", "const = 1;", "if (a { }", "x) {", "a = { b: [1, 2 };", "async function (a) { }"])
def test_scripts_that_cannot_be_read(code):
    from larchgraph.extract import calls

    assert X.facts_of("a.ts", code)[0]["parse_error"] and calls.calls_of(code)[0]["parse_error"]
    fine = "export default function (a) { }\nconst f = function () { }, g = [function () { }];"
    assert not X.facts_of("a.ts", fine)[0]["parse_error"] and not calls.calls_of(fine)[0]["parse_error"]


def test_extraction_grows_with_a_files_length():
    """A bundled script of 800 KB takes seconds; twice the text about twice the time."""
    source = "".join(f"function f{i}(a, {{ b }}) {{ if (a && b) {{ return g{i}(a); }} return xs.map(x => x ? h(x) : 1); }}\n" for i in range(9000))
    took = []
    for part in (source[: source.index("\n", len(source) // 4)], source):
        began = time.time()
        X.facts_of("a.js", part)
        took.append(time.time() - began)
    assert len(source) > 750_000 and took[1] < 12 and took[1] < 9 * took[0]


def test_names_over_files(spark):
    """Imports, re-exports, stars, aliases and default exports, against a second function of each name."""
    chain = {f"c{i}.js": f"export {{ n{i - 1} as n{i} }} from './c{i - 1}';" if i % 3 else f"import {{ n{i - 1} }} from './c{i - 1}';\nconst n{i} = n{i - 1};\nexport {{ n{i} }};" for i in range(1, 20)}
    files = chain | {
        "c0.js": "export function n0() {}", "other.js": "export function run() {}\nexport function deep() {}\nfunction n0() {}\nfunction other() {}\nfunction dflt() {}\nfunction cjs() {}",
        "a.js": "export function run() {}\nexport default function dflt() {}",
        "one.js": "import { run } from './a';\nfunction first() { run(); }",
        "two.js": "import { run as other } from './a';\nfunction second() { other(); }",
        "three.js": "import * as ns from './a';\nfunction third() { ns.run(); }",
        "four.js": "import d from './a';\nfunction fourth() { d(); }",
        "s1.js": "export * from './s2';\nexport * from './c19';", "s2.js": "export * from './s3';", "s3.js": "export * from './s1';\nexport function deep() {}",
        "five.js": "import { deep, n19 } from './s1';\nfunction fifth() { deep(); n19(); }",
        "loop1.js": "export { q } from './loop2';", "loop2.js": "export { q } from './loop1';", "six.js": "import { q } from './loop1';\nfunction sixth() { q(); }",
        "cjs.js": "function cjs() {}\nmodule.exports = { cjs, named: cjs };", "seven.js": "const { named } = require('./cjs');\nconst m = require('./cjs');\nfunction seventh() { named(); m.cjs(); }",
        "whole.js": "function only() {}\nmodule.exports = only;", "nine.js": "const w = require('./whole');\nfunction ninth2() { w(); }\nfunction only() {}",
        "eight.js": "import { run } from './a';\nfunction eighth(run) { run(); }\nfunction ninth() { const go = run; go(); }",
    }
    found = {(a.split("#")[1], b) for a, b in graph(spark, files)[1]}
    assert found == {
        ("first", "a.js#run"), ("second", "a.js#run"), ("third", "a.js#run"), ("fourth", "a.js#dflt"), ("fifth", "s3.js#deep"), ("fifth", "c0.js#n0"),
        ("seventh", "cjs.js#cjs"), ("ninth", "a.js#run"), ("ninth2", "whole.js#only"),
    }


def test_this_and_classes(spark):
    files = {
        "a.js": "export class A { m() {} n() { this.m(); } k() { this.up(); } }\nclass B { m() {} n() { const f = () => this.m(); f(); } }\nA.prototype;",
        "b.js": "import { A } from './a';\nclass C extends A { o() { this.m(); } static s() {} up() {} }\nclass D extends C { p() { this.m(); this.up(); D.s(); C.s(); } }\nfunction u() { const a = new A(); a.n(); unknown.m(); }\nconst d = new D();\nfunction v() { d.p(); d.o(); }",
    }
    found = {(a.split("#")[1], b.split("#")[1]) for a, b in graph(spark, files)[1]}
    assert found == {("A.n", "A.m"), ("B.n", "f"), ("f", "B.m"), ("C.o", "A.m"), ("D.p", "A.m"), ("D.p", "C.up"), ("D.p", "C.s"), ("u", "A.n"), ("v", "D.p"), ("v", "C.o")}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_edges(spark, k):
    files, want = CASES[k]
    assert graph(spark, files)[1] == want


def test_complexity():
    of = lambda path, code: {r["name"]: r["complexity"] for r in X.facts_of(path, code) if r["fact"] == "def"}
    assert of("a.py", "def f(x):\n for i in x:\n  if i:\n   while i: pass\n") == {"f": 4}
    assert of("a.py", "def f(a):\n if a and 1: pass\n elif a: pass\n match a:\n  case 1: pass\n  case _: pass\ndef g(x): return [i for i in x if i]") == {"f": 6, "g": 3}
    assert of("a.js", "function f(a) { if (a && a.b || 1) { for (;;) {} } return a ? 1 : 2; }") == {"f": 6}


def test_complexity_of_loops_callbacks_and_expressions():
    of = lambda path, code: {r["display"]: r["complexity"] for r in X.facts_of(path, code) if r["fact"] == "def"}
    assert of("a.js", "function f() { do { x(); } while (a); p.catch(h); }") == {"f": 2}
    assert of("A.java", "class A { int f(int x) { do { x--; } while (x > 0); while (x > 1) { } return x; } }") == {"A.f": 3}
    assert of("a.js", "function f() { return xs.map(x => x ? 1 : 2).filter(function (y) { if (y) { } return y && 1; }); }") == {"f": 1}
    assert of("a.js", "const f = a => a ? 1 : (b && c);\nconst g = a => a && b || c;\nconst h = () =>\n  a\n  .b(c || d);\nconst k = 1;") == {"f": 2, "g": 2, "h": 2}
    assert of("a.ts", "const f = async <T,>(a: T): Promise<T> => { if (a) { } return a; };\nclass A { constructor(x) { if (x) { } } get y() { return 1; } *z() { } }") == {"f": 2, "A.z": 1}
    assert of("a.js", "function f() { if (/[{]\\{/.test(s) || a / b / c) { } return `if ${x ? 1 : 2} while`; }") == {"f": 4}
    assert of("a.cpp", "class X { int go(int a) { return a; } int select(int b) { return b; } };") == {"X.go": 1, "X.select": 1}


def test_calls_in_template_holes_and_after_dots():
    calls = [(r["name"], r["receiver"]) for r in X.facts_of("a.js", "function f() { return `a${g(1)} b ${h({ a: k() })} c()`; db.delete(1); p.catch(e); delete(x); }") if r["fact"] == "call"]
    assert calls == [("g", None), ("h", None), ("k", None), ("delete", "db"), ("catch", "p")]


def test_imports_are_code_only():
    of = lambda path, code: [r["name"] for r in X.facts_of(path, code) if r["fact"] == "import"]
    source = "import a from './a'; // from './no'\nexport * from './b';\nconst s = \"from './no'\"; /* require('./no') */ require('./c'); import('./d');\nimport './e';"
    assert of("x.ts", source) == of("x.mts", source) == ["./a", "./b", "./c", "./d", "./e"]
    file = X.facts_of("x.ts", "#!/usr/bin/env node\nexport const a = 1;\nexport { b, c as d };\nexport default 1;")[0]
    assert (file["exports"], file["shebang"], file["loc"], file["parse_error"]) == (4, True, 4, False)
    assert [f["fact"] for f in X.facts_of("x.mts", "function f() {}")] == ["file"]


@pytest.mark.parametrize("code", ["f(`${", "/* open", "`a${`b${c}`}`", "x = {", "const r = /\\{/;", "if (a) { } // }"])
def test_scripts_that_close_or_not(code):
    assert X.facts_of("a.js", code)[0]["parse_error"] == (code in ("f(`${", "/* open", "x = {"))


def test_parse_errors_and_odd_files(spark):
    df = spark.createDataFrame([("p", "a.py", "def ("), ("p", "b.js", "function f() {"), ("p", "c.txt", "x"), ("p", "d.py", None), ("p", None, "x"), ("p", "e.js", "#!/x\nexport const a = 1;")], "project_id string, path string, content string")
    got = {r["path"]: (r["parse_error"], r["shebang"], r["exports"]) for r in X.extract(df).filter("fact = 'file'").collect()}
    assert got == {"a.py": (True, False, 0), "b.js": (True, False, 0), "c.txt": (False, False, 0), "d.py": (False, False, 0), "e.js": (False, True, 1)}
