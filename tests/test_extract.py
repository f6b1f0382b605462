"""Declarations, scopes and calls of the scanned languages, on what simple patterns get wrong."""

import re

import pytest
from pyspark.sql import functions as F

from loomdex.sources import extract


def symbols(path, source):
    return {s.fqn.split("::", 1)[1]: s for s in extract.parse(path, source)[0]}


def calls(path, source):
    return {(a.partition("::")[2], b) for a, b, kind in extract.parse(path, source)[1] if kind == "calls"}


def test_rust_literals_and_lifetimes():
    source = """fn a() { let c = '"'; let d = '\\''; b(); }
fn d<'a>(x: &'a str) -> &'a str { x }
let s = r#"fn no() { "x" }"#;
fn e() { println!("{}", 1); std::mem::swap(p, q) }
"""
    assert set(symbols("x.rs", source)) == {"a", "d", "e"}
    assert calls("x.rs", source) == {("a", "b"), ("e", "println"), ("e", "swap")}


def test_rust_items():
    source = """pub trait T { fn m(&self); fn n(&self) -> i32 { 1 } }
impl<'a> T for Foo<'a> { fn m(&self) { self.y(); } }
macro_rules! mac { () => {} }
pub(crate) const MAX: u32 = 3;
pub mod inner { pub async fn go() {} }
"""
    got = symbols("x.rs", source)
    assert {k: v.kind for k, v in got.items()} == {"T": "trait", "T::m": "method", "T::n": "method", "Foo::m": "method", "mac": "macro", "MAX": "variable", "inner": "module", "inner::go": "function"}
    assert got["MAX"].exported and not got["T::m"].exported and got["inner::go"].exported
    assert calls("x.rs", source) == {("Foo::m", "y")}


def test_typescript_members():
    source = """export class A<T> { #p() { return 1 } static s() { q(); } async get(a: {b: number}): Promise<{c: number}> { return load(a) }
  constructor(private x: number) { super(); }
  abstract foo(): void;
  field = (y) => { z(y) };
  get v(): number { return this.x }
  m<K extends {a: 1}>(k: K, r = /["{]/): void { k.go() }
}
interface I { m(a: number): void; }
"""
    got = symbols("x.ts", source)
    assert {k for k, v in got.items() if v.kind == "method"} == {"A::#p", "A::s", "A::get", "A::constructor", "A::v", "A::m"}
    assert got["A"].exported and not got["A::s"].exported and got["I"].kind == "interface"
    assert calls("x.ts", source) == {("A::s", "q"), ("A::get", "load"), ("A::constructor", "super"), ("", "z"), ("A::m", "go")}


def test_typescript_variables():
    source = """const a = async <T,>(x: T) => { inner(x) };
export const b = (x: number): {a: number} => x;
export const c: Map<string, number> = make();
const quiet = 7;
export function f(a: {b: string}, ...r): void { g() }
export default class Z { }
"""
    got = symbols("x.ts", source)
    assert {k: v.kind for k, v in got.items()} == {"a": "function", "b": "function", "c": "variable", "f": "function", "Z": "class"}
    assert calls("x.ts", source) == {("a", "inner"), ("", "make"), ("f", "g")}


def test_javascript_patterns_and_one_liners():
    source = """class A { b() {} c(x) { return b(x) } }
var re = /"[^"/]*{/; function k() { return a / b / c; }
"""
    assert {k: v.kind for k, v in symbols("x.js", source).items()} == {"A": "class", "A::b": "method", "A::c": "method", "k": "function"}
    assert calls("x.js", source) == {("A::c", "b")}


def test_cpp_members():
    source = """namespace a::b {
class V : public B { public: V() : a(0), b{1} { init(); } ~V() {}
  template <typename T> T get(T x) const noexcept { return conv<T>(x); }
  int decl(int a);
  static std::vector<int> mk() { return {}; }
  V& operator=(const V&) = default;
private: int a; };
void V::outer(int x) { y(); }
const char* s = R"(class No { void f() {} };)";
}
template <class T> T maxi(T a, T b) { return a; }
"""
    got = symbols("x.cpp", source)
    assert {k: v.kind for k, v in got.items()} == {"a::b": "module", "a::b::V": "class", "a::b::V::V": "method", "a::b::V::~V": "method", "a::b::V::get": "method", "a::b::V::mk": "method", "a::b::outer": "function", "maxi": "function"}
    assert got["a::b::V::V"].signature == "V()"
    assert {("a::b::V::V", "init"), ("a::b::outer", "y")} <= calls("x.cpp", source)
    assert not {"decl", "outer", "V"} & {b for _, b in calls("x.cpp", source)}


@pytest.mark.parametrize(("path", "source", "names", "called"), [
    ("x.java", "public class A { public A(int y) { x = y; } public <T> List<T> f(T t) throws E { return g(t); } interface I { void h(); } }", {"A", "A::A", "A::f", "A::I", "A::I::h"}, {("A::f", "g")}),
    ("x.cs", 'namespace N { public class C { public void M<T>(T a) where T : class { D(a); } string s = @"a""b { "; } }', {"N", "N::C", "N::C::M"}, {("N::C::M", "D")}),
    ("x.php", "<?php class A { public function f($x) { return g($x); } private function h() {} } function top() {}", {"A", "A::f", "A::h", "top"}, {("A::f", "g")}),
    ("x.go", "package a\nfunc (s *S) M(x int) error { fmt.Println(x); return nil }\ntype S struct { a int }\nfunc main() { M(1) }\n", {"M", "S", "main"}, {("M", "Println"), ("main", "M")}),
    ("x.rb", "module M\n  class A\n    def f(x)\n      g(x)\n    end\n  end\nend\n", {"M", "M::A", "M::A::f"}, {("M::A::f", "g")}),
    ("x.py", "class A:\n    def m(self):\n        def inner(): pass\n        return inner()\n", {"A", "A::m", "A::inner"}, {("A::m", "inner")}),
])
def test_other_languages(path, source, names, called):
    assert set(symbols(path, source)) == names and calls(path, source) == called


def test_broken_sources_give_nothing_or_go_on():
    assert extract.parse("x.py", "def (") == ([], [])
    assert set(symbols("x.ts", "function f() { if (a { } \nfunction g() { h( }")) >= {"f"}
    assert extract.parse("x.unknown", "fn a() {}") == ([], [])


def test_files_are_parsed_by_many_tasks(spark, tmp_path):
    """One small table of files, read by one task, is parsed by all cores; so is one where several begin with the same path."""
    rows = [(f"src/f{i}.py", f"def f{i}(x):\n    return g{i}(x)\n") for i in range(400)]
    spark.createDataFrame(rows, "path string, content string").coalesce(1).write.parquet(f"{tmp_path}/t")
    parsed = extract.parse_files(spark.read.parquet(f"{tmp_path}/t"))
    held = [r["n"] for r in parsed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 400 and len(held) >= 4 and max(held) <= 150
    assert {(r["path"], r["to_name"]) for r in extract.edges_of(parsed).collect()} == {(f"src/f{i}.py", f"g{i}") for i in range(400)}


def test_skipping_to_what_can_begin_changes_nothing():
    """Every text of a few characters that matter is blanked as it is character by character."""
    import itertools

    class Every:
        def search(self, source, at):
            return re.compile(r"(?s).").search(source, at)

    for lang in extract.LANGUAGES:
        for chars in itertools.product("a/'\"`#@R(*\n", repeat=4):
            source = "".join(chars) + "r\"x\" b"
            got = extract.blank(source, lang)
            kept, extract._BEGINS[lang.name] = extract._BEGINS[lang.name], Every()
            try:
                assert got == extract.blank(source, lang), (lang.name, source)
            finally:
                extract._BEGINS[lang.name] = kept
