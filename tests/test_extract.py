"""Parsers: own fixtures with known counts, and inputs that nobody should write."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusframe.operators.extract import chunks_of, file_of, files_of, parse, parsed, symbols_of
from corpusframe.operators.imports import READERS
from corpusframe.operators.languages import BY_SUFFIX, PROFILES, all_suffixes
from corpusframe.operators.windows import MAX_CHARS, line_windows

JAVA = '''package org.shapes.core;

import java.util.Map;
import static org.shapes.util.Strings.join;
import org.shapes.model.*;

/** A class { with braces } in its comment. */
@Named("x, {y}")
public final class Circle<T extends Comparable<T>> extends Shape<T> implements Drawable, Comparable<Circle<T>> {
    private static final String NAME = "a { \\" b";
    protected Map<String, Point> points = new HashMap<>() {{ put("a", null); }};
    int a = 1, b = 2;

    static { System.out.println("{"); }

    public Circle(double radius, final String... names) { super(); }

    @Override
    public int compareTo(Circle<T> other) { return other == this ? 0 : 1; }

    abstract void nothing(int[] x, Map<String, List<Integer>> y);

    enum Colour implements Named { RED("r") { void f() {} }, BLUE; private int code; int code() { return code; } }

    interface Visitor extends Base { void visit(Circle<?> c); }
}

record Pair(int a) {}
'''


def by_kind(got):
    out = {}
    for s in got.symbols:
        out.setdefault(s.kind, []).append(s)
    return out


def test_java():
    got = parse("core/src/main/java/org/shapes/core/Circle.java", JAVA)
    kinds = by_kind(got)
    assert not got.error and got.package == "org.shapes.core"
    assert got.imports == ["java.util.Map", "org.shapes.util.Strings.join", "org.shapes.model.*"]
    circle = kinds["class"][0]
    assert (circle.extends_class, circle.implements) == ("Shape<T>", "Drawable, Comparable<Circle<T>>")
    assert (circle.visibility, circle.annotations, circle.module) == ("public", "Named", "core")
    assert circle.id.endswith("::class::org.shapes.core.Circle") and circle.line_start == 8
    assert [s.signature for s in kinds["constructor"]] == ["Circle(double, String...)"]
    assert {s.signature for s in kinds["method"]} == {"compareTo(Circle<T>)", "nothing(int[], Map<String, List<Integer>>)", "code()", "visit(Circle<?>)"}
    assert [s.name for s in kinds["field"]] == ["NAME", "points", "a", "code"]
    assert [s.name for s in kinds["enum"]] == ["Colour"] and kinds["enum"][0].parent_class == "Circle"
    assert kinds["interface"][0].implements == "Base"
    assert kinds["enum"][0].qualified_name == "org.shapes.core.Colour"
    nested = parse("a.java", JAVA, nested_names=True)
    assert by_kind(nested)["enum"][0].qualified_name == "org.shapes.core.Circle.Colour"
    assert "Point" in circle.type_references and "String" not in circle.type_references.split(", ")
    names = [c.id.split("::")[1] for c in got.chunks]
    assert names[-1] == "class_summary" and got.chunks[-1].content.startswith("// core/src/main/java/org/shapes/core/Circle.java :: org.shapes.core.Circle\nclass Circle extends")
    assert "public compareTo(Circle<T>)" in got.chunks[-1].content
    assert file_of("x/Circle.java", JAVA, got)["class_names"] == "Circle"


def test_a_long_method_is_split_and_stops():
    body = "\n".join(f"        total += compute(input, {i}, other);" for i in range(200))
    text = f"class Long {{\n    int run() {{\n{body}\n    }}\n}}\n"
    parts = [c for c in parse("Long.java", text).chunks if c.kind == "method"]
    assert 1 < len(parts) < 8 and all("::part" in c.id for c in parts)
    assert len([c for c in parse("Long.java", text, tail="cascade").chunks if c.kind == "method"]) > len(parts)


def test_python():
    code = "import os\nfrom a.b import c, d\n\nLIMIT: int = 3\n\n@wrap(1)\nclass Box(Base, Other):\n    size = 1\n    async def open(self):\n        def inner(): pass\n        return Thing()\n\nif LIMIT:\n    def _maybe():\n        pass\n"
    got = parse("pkg/box.py", code)
    assert [(s.kind, s.name, s.parent_class) for s in got.symbols] == [("field", "LIMIT", ""), ("class", "Box", ""), ("method", "open", "Box"), ("function", "_maybe", "")]
    box = got.symbols[1]
    assert (box.extends_class, box.implements, box.annotations, box.line_start) == ("Base", "Other", "wrap", 6)
    assert got.symbols[3].visibility == "protected" and "Thing" in got.symbols[2].type_references
    assert "a.b" in got.imports and "os" in got.imports


@pytest.mark.parametrize(
    ("path", "text", "names"),
    [
        ("a.go", "package m\n\nimport (\n\t\"fmt\"\n)\n\ntype Box struct {\n\tn int\n}\n\nfunc (b *Box) Open() int {\n\treturn b.n\n}\n", {"Box", "Open"}),
        ("a.ts", "import {x} from './x';\nexport class Box extends Base {\n  private open(a: string): number {\n    return 1;\n  }\n}\ninterface Shape { area: number }\nfunction run() { return '}'; }\n", {"Box", "open", "Shape", "run"}),
        ("a.js", "class A { m() { return 1; } }\nfunction f(x) { if (x) { return 2; } }\n", {"A", "m", "f"}),
        ("a.rs", "use std::io;\npub struct P { x: i32 }\ntrait T { fn t(&self); }\nfn main() { println!(\"{}\"); }\n", {"P", "T", "main"}),
        ("a.cs", "using System;\nnamespace N {\n  public class C : B, I {\n    public int Get(int a) { return a; }\n  }\n}\n", {"C", "Get"}),
        ("a.c", "#include <stdio.h>\nstatic int add(int a, int b) {\n  return a + b;\n}\nstruct P { int x; };\n", {"add", "P"}),
        ("a.cpp", "class A : public B {\n  int f() { return 1; }\n};\nint A::g(int x) const {\n  return x;\n}\n", {"A", "f", "A::g"}),
        ("a.rb", "require 'json'\nclass A < B\n  def run\n    1\n  end\nend\n", {"A", "run"}),
        ("a.kt", "package p\nimport q.R\nclass A(val x: Int) : B() {\n  fun f(): Int { return 1 }\n}\n", {"A", "f"}),
        ("a.scala", "package p\nobject A extends B {\n  def f(x: Int): Int = { x }\n}\ntrait T { }\n", {"A", "f", "T"}),
    ],
)
def test_other_languages(path, text, names):
    got = parse(path, text)
    assert not got.error and {s.name for s in got.symbols} == names
    assert got.imports or path in ("a.js", "a.cpp", "a.scala")


@pytest.mark.parametrize(
    ("path", "text", "imports", "package"),
    [
        ("A.java", "/* import no.no; */ package  a . b ;\nimport static  x.Y.z ;\nimport q.*;\nclass A { String s = \"import t.t;\"; }", ["x.Y.z", "q.*"], "a.b"),
        ("a.py", "import os, sys as s\nfrom . import x\nfrom ..a.b import (c,\n d)\nif s:\n  import json\n't = 1; import no'\n", ["os", "sys", ".x", "..a.b", "json"], ""),
        ("a.cs", "using System;\nglobal using A.B;\nusing static X.Y;\nusing Z = Q.R<int>;\n// using no.no;\nnamespace N.M;\nclass C { void f() { using (var x = 1) {} using var y = Foo(); } }", ["System", "A.B", "X.Y", "Q.R"], "N.M"),
        ("a.kt", "package p.q\nimport a.b.C as D\nimport x.*\nimport `in`.y;\n// import no.no\nclass A { }", ["a.b.C", "x.*", "`in`.y"], "p.q"),
        ("a.scala", "package p\nimport a.b.{C, D => E, F => _}, g.h\nimport q._\nobject A { }", ["a.b.C", "a.b.D", "g.h", "q._"], "p"),
        ("a.go", '// package no\npackage m\n\nimport "fmt" // "no"\nimport (\n\tx "a/b"\n\t. "c"\n\t_ `d/e`\n\t/* "no" */ "f"; "g"\n)\nvar s = "import \\"no\\""\nfunc f() { import_("no") }\n', ["fmt", "a/b", "c", "d/e", "f", "g"], "m"),
        ("b.go", "import \"a\"\n", ["a"], ""),
        (
            "a.rs",
            "#![x]\nuse std::io;\npub(crate) use a::{b, c as d, e::{self, f::*}, g};\nuse ::h::i as _;\nuse j::*;\nextern crate k as l;\n// use no;\nmod m { use super::n; }\nfn f<'a>(x: &'a str) { let s = \"use no;\"; use o::p; }\nuse {q, r::s};\nmod no;\n",
            ["std::io", "a::b", "a::c", "a::e", "a::e::f::*", "a::g", "::h::i", "j::*", "k", "super::n", "o::p", "q", "r::s"],
            "",
        ),
        ("a.rb", "require 'json'\nrequire(\"a/b\")\nrequire_relative 'c' # require 'no'\nload \"d.rb\" if x\nautoload :E, 'e'\nobj.require 'no'\ndef load(x); end\n=begin\nrequire 'no'\n=end\ns = \"require 'no'\"\nrequire name\n", ["json", "a/b", "c", "d.rb", "e"], ""),
        ("a.c", "#include <stdio.h>\n  #  include \"a/b.h\"\n#include CONFIG_H\n#include_next <n.h>\n// #include <no.h>\n/*\n#include <no.h>\n*/\nchar *s = \"#include <no.h>\";\nint import;\n", ["stdio.h", "a/b.h", "CONFIG_H", "n.h"], ""),
        ("a.cpp", "#include <v>\nimport std.core;\nexport import :part;\nimport <h>;\nimport \"q.h\";\nusing namespace no;\nnamespace no2 = x::y;\nnamespace a::b { inline namespace c {\nclass D { };\n} }\n", ["v", "std.core", ":part", "h", "q.h"], "a::b::c"),
        ("b.cpp", "module;\nexport module m.n;\nnamespace { int x; }\n", [], "m.n"),
        ("a.ts", "import a from 'a';\nimport {b,\n  c as d} from \"b\"\nimport 'c';\nimport type {T} from './t';\nimport * as n from 'n';\nexport * from 'e';\nexport {x} from 'f';\nexport const y = 'no';\nconst z = require('g'), w = await import('h');\n// import 'no'\nconst s = `import 'no'`;\nimport eq = require('i');\n", ["a", "b", "c", "./t", "n", "e", "f", "g", "h", "i"], ""),
    ],
)
def test_imports(path, text, imports, package):
    got = parse(path, text)
    assert (got.imports, got.package) == (imports, package)


@given(st.text(alphabet="use import{}()\"'`;:\n#<>/*=,.ab \\", max_size=80))
def test_any_text_has_some_imports_or_none(text):
    for imports, package in READERS.values():
        assert all(isinstance(x, str) for x in imports(text)) and isinstance(package(text), str)


def test_all_references_are_kept():
    names = [f"Type{k}" for k in range(120)]
    fields = "".join(f"  {n} x{n};\n" for n in names)
    got = parse("A.java", f"class A {{\n{fields}}}\n")
    assert got.symbols[0].type_references == ", ".join(sorted(names))


def test_profiles():
    assert len(PROFILES) == 13 and BY_SUFFIX[".kt"].name == "kotlin" and ".tsx" in all_suffixes() and ".gradle" in all_suffixes()


@pytest.mark.parametrize("text", ["", "class", "class A {", "}}}}", "class A { void f( { } }", "\x00\x01", "def f(:\n", "class Ü { int é; }", "class A {" * 100, "x" * 1_000_000, '"""', "/*", "'"])
@pytest.mark.parametrize("path", ["A.java", "a.py", "a.go", "a.ts", "a.rb", "notes.txt"])
def test_broken_sources_never_raise(path, text):
    got = parse(path, text)
    assert file_of(path, text, got)["loc"] == text.count("\n") + 1


@given(st.lists(st.integers(0, 900), max_size=120))
def test_windows_cover_all_lines_in_order(lengths):
    found = list(line_windows(lengths))
    assert bool(found) == bool(lengths)
    if found:
        assert found[0][0] == 0 and found[-1][1] == len(lengths)
        for (a, b), (c, d) in zip(found, found[1:], strict=False):
            assert a < c <= b < d
        assert all(sum(lengths[a : b - 1]) + b - a - 1 < MAX_CHARS for a, b in found if b - a > 1)


def test_tables(spark):
    rows = spark.createDataFrame([("core/src/Circle.java", JAVA), ("run.sh", "echo 1\n" * 200), ("none.txt", None)], "path string, content string")
    got = parsed(rows).cache()
    assert symbols_of(got).count() == 12  # a class, an enum, an interface, a constructor, four methods, four fields
    assert chunks_of(got).where("file_path = 'run.sh'").count() == 1
    assert {r.path: r.loc for r in files_of(got).collect()} == {"core/src/Circle.java": JAVA.count("\n") + 1, "run.sh": 201, "none.txt": 1}


def test_texts_of_one_small_file_are_many_tasks(spark, tmp_path):
    rows = [(f"p/C{k}.java", f"package p;\nclass C{k} {{ void run() {{ }} }}\n") for k in range(200)]
    spark.createDataFrame(rows, "path string, content string").coalesce(1).write.parquet(str(tmp_path / "sources"))
    table = parsed(spark.read.parquet(str(tmp_path / "sources")))
    seen = table.select("path", F.spark_partition_id().alias("task")).collect()
    assert {r.path for r in seen} == {p for p, _ in rows} and len(seen) == 200
    assert len({r.task for r in seen}) > 3
