"""Everyday forms of seven languages, and names that lead over many files, dealt to the pages.

A page's language is page_id % 7 and its form (page_id / 7) % 10; what each form must give is written
beside it. In `chains`, files of twenty pages in a row hand one name on, each in another way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larchgraph.extract import facts as X
from larchgraph.functions.tables import stored, table
from larchgraph.operators import resolve as V

Q: dict = {}
SQL: dict[str, str] = {}

#: For each language: the file, and forms (text, what it defines: display name, line, complexity). § stands for the page.
FORMS = [
    ("js/f§.ts", [
        ("function f§({ a, b } = {}) {\n  if (a) { g(b); }\n}", [("f§", 1, 2)]),
        ("export function App§({ title }: Props) { return h(title) || null; }", [("App§", 1, 2)]),
        ("function f§(): { a: number } { if (a) g(); }\nconst k§ = (): { b: string }[] => { for (;;) {} };", [("f§", 1, 2), ("k§", 2, 2)]),
        ("const a§ = function named() { b(); };\ncall(function other() { if (x) {} });", [("a§", 1, 1)]),
        ("class A§<T extends { x: number }> extends B<T> {\n  #p() {}\n  get v() { return 1; }\n  static async *z<U>(a: U): Promise<U[]> { return q(a); }\n  constructor(a) { if (a) {} }\n  m?(): void { }\n}", [("A§.#p", 2, 1), ("A§.z", 4, 1), ("A§.m", 6, 1)]),
        ("const o = { m§() { q(); }, async n§({ z }) { w(); }, get g() { return 1; }, p: (a) => a };", [("m§", 1, 1), ("n§", 1, 1)]),
        ("const f§: (a: number) => void = (a) => { g(a); }, h§ = <T,>(x: T): x is Y => x && k(x);\nfunction ov§(a: string): void;\nfunction ov§(a) { return function inner() { if (b) {} }; }", [("f§", 1, 1), ("h§", 1, 1), ("ov§", 3, 1)]),
        ("export default class { run§() { if (a) {} } }\nexport default function () { if (a) {} }", [("run§", 1, 2)]),
        ("const a§ = x => y => x ? y : 1;\nconst b§ = async x => { await a§(x)(1); };\nconst c§ = memo(() => { if (x) {} }, [x]);", [("a§", 1, 1), ("b§", 2, 1)]),
        ("export const t§ = (s) => `if ${s ? 1 : 2} {`;\nconst r§ = (s) => /[{(]/.test(s) && t§(s) && { a: s ?? 1 };", [("t§", 1, 2), ("r§", 2, 2)]),
    ]),
    ("py/f§.py", [
        ("def f§(a, *, b=None, **k):\n    return a if b else k\n", [("f§", 1, 2)]),
        ("async def f§(x):\n    async for y in x:\n        await g(y)\n", [("f§", 1, 2)]),
        ("class A§:\n    @property\n    def p(self): return 1\n    @staticmethod\n    def s(x):\n        while x: x -= 1\n", [("A§.p", 3, 1), ("A§.s", 5, 2)]),
        ("def outer§(x):\n    def inner§(y):\n        if y: return 1\n    return inner§(x) or x\n", [("outer§", 1, 2), ("inner§", 2, 2)]),
        ("def f§(x):\n    try:\n        g(x)\n    except (A, B):\n        pass\n    except C:\n        pass\n", [("f§", 1, 3)]),
        ("def f§(x): return [y for z in x if z for y in z if y and z]\n", [("f§", 1, 6)]),
        ("def f§(x):\n    match x:\n        case 1: pass\n        case [a, b] if a: pass\n        case _: pass\n", [("f§", 1, 4)]),
        ("f = lambda x: x if x else 1\ndef f§(s: 'str | None' = \"def no(): if\") -> dict[str, int]:\n    return {k: 1 for k in s}\n", [("f§", 2, 2)]),
        ("class A§:\n    class B§:\n        def m(self): return self.n()\n        def n(self): pass\n", [("B§.m", 3, 1), ("B§.n", 4, 1)]),
        ("if True:\n    def f§(): pass\nelse:\n    def g§(x):\n        return x and y and z\n", [("f§", 2, 1), ("g§", 4, 3)]),
    ]),
    ("java/F§.java", [
        ("class A§ { <T extends B> T m(List<T> x) throws E, F { return n(x); } }", [("A§.m", 1, 1)]),
        ("class A§ { A§(int q) { this.m(q); }\n int m(int q) { return q > 0 ? 1 : 2; } }", [("A§.A§", 1, 1), ("A§.m", 2, 2)]),
        ("record P§(int x) { int y() { return x; } }", [("P§.y", 1, 1)]),
        ("enum K§ { A, B; int v() { switch (this) { case A: return 1; default: return 2; } } }", [("K§.v", 1, 3)]),
        ("class A§ { @Override\n public int[] w(int[] a) { if (a != null) { } return a; } }", [("A§.w", 2, 2)]),
        ("interface I§ { void z(); default int d(int x) { return x; } }", [("I§.d", 1, 1)]),
        ("class A§ { void r() { Runnable q = () -> { m(); }; xs.forEach(x -> { if (x) { } }); } }", [("A§.r", 1, 2)]),
        ("class A§ { class B§ { void in() { } } static void out(final Map<String, List<Integer>> m) { for (var e : m) { } } }", [("B§.in", 1, 1), ("A§.out", 1, 2)]),
        ("class A§ { Object o = new Object() { public String toString() { return s(); } }; }", [("A§.toString", 1, 1)]),
        ("class A§ { int f(String s) { try { return g(\"if {\"); } catch (E e) { while (true) { } } finally { } } }", [("A§.f", 1, 3)]),
    ]),
    ("go/f§.go", [
        ("package m\nfunc Map§[T any](xs []T, f func(T) int) map[string]struct{} { for range xs { f(1) }; return nil }", [("Map§", 2, 2)]),
        ("package m\nfunc (s *S§[T]) M() (int, error) { s.M() }", [("S§.M", 2, 1)]),
        ("package m\nfunc (S§) N() { }", [("S§.N", 2, 1)]),
        ("package m\nfunc x§() func(int) error { return func(a int) error { if a > 1 { y() }; return nil } }", [("x§", 2, 2)]),
        ("package m\ntype I§ interface { Q(a int) }\nfunc f§(i I§) { }", [("f§", 3, 1)]),
        ("package m\nfunc f§(c chan<- int) struct{ a int } { switch { case true: } ; return struct{ a int }{1} }", [("f§", 2, 2)]),
        ("package m\nfunc f§(x int) (y int, err error) {\n\tif x := g(); x > 1 {\n\t}\n\treturn\n}", [("f§", 2, 2)]),
        ("package m\nvar v§ = func() { if a { } }\nfunc f§() { go func() { h() }() }", [("f§", 3, 1)]),
        ("package m\nfunc f§(a ...interface{}) *T { for { } }", [("f§", 2, 2)]),
        ("package m\nfunc init() { s := `func no() {`; _ = s }\nfunc f§() []map[string]int { return nil }", [("init", 2, 1), ("f§", 3, 1)]),
    ]),
    ("c/f§.c", [
        ("static inline int add§(int a, int (*f)(int)) { return f(a) ? 1 : 2; }", [("add§", 1, 2)]),
        ("struct s *make§(void) { while (1) { } }", [("make§", 1, 2)]),
        ("int decl§(int a);\nint def§(int a)\n{\n  return decl§(a);\n}", [("def§", 2, 1)]),
        ("void attr§(void) __attribute__((noinline)) { add(1, g); }", [("attr§", 1, 1)]),
        ("int f§(int a) { switch (a) { case 1: case 2: return 1; default: return 2; } }", [("f§", 1, 4)]),
        ("int f§(int a) { do { a--; } while (a); if (a) { } else if (a > 1) { } return 0; }", [("f§", 1, 4)]),
        ("static const char *names[] = { \"if (\", \"{\" };\nchar c§(int i) { return '{'; }", [("c§", 2, 1)]),
        ("int f§(struct { int x; } *p) { return p->x; }", [("f§", 1, 1)]),
        ("unsigned long long f§(int a[], ...) { for (int i = 0; i < 1; i++) { } return 0; }", [("f§", 1, 2)]),
        ("/* int no(void) { } */\nint f§(void) { // if (\n  return 1; }", [("f§", 2, 1)]),
    ]),
    ("cpp/f§.cpp", [
        ("X§::X§(int a) : a_(a), b_{a} { go(); }", [("X§", 1, 1)]),
        ("auto f§(int a) -> std::vector<int> { return g(a); }", [("f§", 1, 1)]),
        ("class Y§ { public: Y§(int b) noexcept : b_(b) { } ~Y§() { } };", [("Y§.Y§", 1, 1), ("Y§.~Y§", 1, 1)]),
        ("class Y§ { template<class T> T get() const override { if (b_) { } return h(); } };", [("Y§.get", 1, 2)]),
        ("namespace n { static int* q§(const char* s) { return 0; } }", [("q§", 1, 1)]),
        ("int f§() { auto l = [&](int a) { if (a) { } return a; }; return l(1); }", [("f§", 1, 2)]),
        ("struct S§ { int v; int g() && { return v; } int w() const& { for (auto x : xs) { } return v; } };", [("S§.g", 1, 1), ("S§.w", 1, 2)]),
        ("std::map<int, std::string> f§(const std::vector<std::pair<int, int>>& v) { try { } catch (...) { } return {}; }", [("f§", 1, 2)]),
        ("int A§::B::run(int a) const { return a ? 1 : 2; }", [("run", 1, 2)]),
        ("template <typename T>\nT max§(T a, T b) {\n  return a > b ? a : b;\n}\nint use§() { return max§<int>(1, 2); }", [("max§", 2, 2), ("use§", 5, 1)]),
    ]),
    ("cs/f§.cs", [
        ("class C§ { void M<T>() where T : class, new() { N(); } }", [("C§.M", 1, 1)]),
        ("class C§ { int X() => 1; int? Q(int x) => x > 1 ? N() : 2; }", [("C§.X", 1, 1), ("C§.Q", 1, 2)]),
        ("class C§ : B { C§(int a) : base(a) { N(); } }", [("C§.C§", 1, 1)]),
        ("class C§ { List<int> L(int a = F(1)) { return xs.Select(x => F(x)); } }", [("C§.L", 1, 1)]),
        ("class C§ { public override string ToString() => $\"{a}\"; }", [("C§.ToString", 1, 1)]),
        ("interface I§ { void A(); int B() { return 1; } }", [("I§.B", 1, 1)]),
        ("class C§ { async Task<int> R(string[] a) { foreach (var x in a) { await G(x); } return 1; } }", [("C§.R", 1, 2)]),
        ("namespace N { static class C§ { public static (int, string) T(this int a) { while (a > 0) { a--; } return (a, \"\"); } } }", [("C§.T", 1, 2)]),
        ("record R§(int A) { int S() { return A switch { 1 => 2, _ => F(A) }; } }", [("R§.S", 1, 1)]),
        ("class C§ { int P { get { return 1; } set { } } void V() { try { } catch (E e) when (e.A) { } lock (x) { } } }", [("C§.V", 1, 2)]),
    ]),
]


def _said(text: str):
    parts = text.split("§")
    out = [F.lit(parts[0])]
    for part in parts[1:]:
        out += [F.col("page_id").cast("string"), F.lit(part)]
    return F.concat(*out)


def form_sources(spark, d):
    pages = table(spark, d, "pages").select("page_id")
    path = content = None
    for k, (name, forms) in enumerate(FORMS):
        for j, (text, _) in enumerate(forms):
            here = (F.col("page_id") % 7 == k) & (F.floor(F.col("page_id") / 7) % 10 == j)
            path = F.when(here, _said(name)) if path is None else path.when(here, _said(name))
            content = F.when(here, _said(text)) if content is None else content.when(here, _said(text))
    return pages.select(F.lit("p").alias("project_id"), path.alias("path"), content.alias("content"))


_ROWS = ", ".join(f"({k}, {j}, '{name}', '{display}', {line}, {c})" for k, (name, forms) in enumerate(FORMS) for j, (_, defs) in enumerate(forms) for display, line, c in defs)

SQL["source_forms"] = f"""SELECT replace(name, '§', CAST(page_id AS VARCHAR)) || '#' || replace(display, '§', CAST(page_id AS VARCHAR)) AS id, CAST(line AS INT) AS line, CAST(complexity AS INT) AS complexity
FROM pages JOIN (VALUES {_ROWS}) f(l, j, name, display, line, complexity) ON page_id % 7 = l AND (page_id // 7) % 10 = j"""


def source_forms(spark, d):
    return V.functions(X.extract(form_sources(spark, d))).select("id", "line", "complexity")


Q["source_forms"] = source_forms

#: How a file hands on what the file before it gives, by page_id % 5; each file calls it too.
_ON = [
    "export {{ run }} from './c{b}';\nimport {{ run }} from './c{b}';",
    "import {{ run }} from './c{b}';\nexport {{ run }};",
    "import {{ run as was }} from './c{b}';\nconst run = was;\nexport {{ run }};",
    "export * from './c{b}';\nimport {{ run }} from './c{b}';",
    "import * as all from './c{b}';\nconst {{ run }} = require('./c{b}');\nmodule.exports = {{ run }};",
]


def chain_sources(spark, d):
    """Files in chains of 20: the first defines run, the others hand it on."""
    pages = table(spark, d, "pages").select("page_id")
    me, before = F.col("page_id").cast("string"), (F.col("page_id") - 1).cast("string")

    def said(text: str):
        out = []
        for part in text.replace("{{", "\u0001").replace("}}", "\u0002").split("{b}"):
            out += [F.lit(part.replace("\u0001", "{").replace("\u0002", "}")), before]
        return F.concat(*out[:-1])

    on = None
    for k, text in enumerate(_ON):
        on = F.when(F.col("page_id") % 5 == k, said(text)) if on is None else on.when(F.col("page_id") % 5 == k, said(text))
    head = F.when(F.col("page_id") % 20 == 0, F.lit("export function run() { }")).otherwise(on)
    return pages.select(F.lit("p").alias("project_id"), F.concat(F.lit("c"), me, F.lit(".js")).alias("path"), F.concat(head, F.lit("\nfunction use"), me, F.lit("(a) { if (a) { run(); } return run(a); }")).alias("content"))


# a chain is whole where all its pages are there
SQL["name_chains"] = """SELECT 'c' || p.page_id || '.js#use' || p.page_id AS src, 'c' || h.page_id || '.js#run' AS dst, CAST(2 AS BIGINT) AS cnt FROM pages p JOIN pages h ON h.page_id = p.page_id - p.page_id % 20
WHERE (SELECT count(*) FROM pages b WHERE b.page_id BETWEEN h.page_id AND p.page_id) = p.page_id % 20 + 1"""


def name_chains(spark, d):
    return V.edges(V.calls(stored(X.extract(chain_sources(spark, d))))).select("src", "dst", "cnt")


Q["name_chains"] = name_chains
