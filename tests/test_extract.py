"""Declarations, references and re-exports of source files."""

import pytest

from tessera.sources import extract
from tessera.syntax.braces import parse, walk


def names(path, text):
    return sorted(s[0] for s in extract.parse_file(path, text)[0])


@pytest.mark.parametrize("path", ["class.ts", "class.js", "class.tsx"])
def test_class_members(path):
    assert names(path, "class A {\n  foo() {}\n  bar = () => {}\n}\nfunction top() {}\n") == ["A", "bar", "foo", "top"]


def test_component():
    symbols, _ = extract.parse_file("c.tsx", "export function Greeting() { return <main>Hello</main>; }\n")
    assert symbols[0][0] == "Greeting" and symbols[0][4] == "export function Greeting() { return <main>Hello</main>; }"


def test_large_comment():
    assert names("a.ts", f"/* {'x' * 40_000} */\nexport function afterLargeComment() {{ return true; }}\n") == ["afterLargeComment"]


def test_references():
    text = 'import { helper } from "./helper";\ninterface Base {}\nclass Child extends Base {\n  run() { return this.work(helper()); }\n  work(value: unknown) { return value; }\n}\nexport function helper() { return helper; }'
    by = {s[0]: s[5] for s in extract.parse_file("refs.ts", text)[0]}
    assert ("Base", "implements", None) in by["Child"]
    assert ("helper", "call", None) in by["run"] and ("work", "call", None) in by["run"] and ("helper", "import", "./helper") in by["run"]
    assert not any(r[0] == "helper" for r in by["helper"])


def test_python():
    text = "@decorator\ndef fn():\n    return 1\n\nclass Klass:\n    def method(self):\n        return fn()\n\n@data\nclass Decorated:\n    def hidden(self): pass\n"
    got = {s[0]: s[1] for s in extract.parse_file("mod.py", text)[0]}
    assert got == {"fn": "function", "Klass": "class", "method": "function", "Decorated": "function"}
    assert names("bad.py", "def f(:\n  x\n\nclass K:\n  y\n") == ["K", "f"]


def test_kinds_of_exports():
    got = {s[0]: s[1] for s in extract.parse_file("exp.ts", "export class A {}\nexport function f() {}\nexport interface I {}\nexport const g = () => {};\nexport type T = A;\n")[0]}
    assert got == {"A": "class", "f": "function", "I": "interface", "g": "variable", "T": "type"}


def test_reexports():
    symbols, reexports = extract.parse_file("barrel.ts", "export * from './origin';\nexport { a, b as c } from './other';\n// export * from './no';\nconst local = 1;\nexport { local };")
    assert reexports == [("./origin", "*", "*"), ("./other", "a", "a"), ("./other", "b", "c")]
    assert [s[0] for s in symbols] == ["local"]


def test_other_languages():
    assert names("main.go", "package main\ntype S struct{}\ntype I interface{}\nfunc Top() {}\nfunc (s S) Method() {}\n") == ["I", "Method", "S", "Top"]
    assert names("g.go", "package main\ntype (\n\tA int\n\tB struct{ x int }\n)\n") == ["A", "B"]
    assert names("lib.rs", "pub struct Thing;\npub trait Work {}\npub enum Choice { A }\ntype Alias = Thing;\npub fn run() {}\n") == ["Alias", "Choice", "Thing", "Work", "run"]
    assert names("Demo.java", "class Demo { Demo() {} void run() {} } interface Api {} enum Mode { A }") == ["Api", "Demo", "Demo", "Mode", "run"]
    kinds = {s[0]: s[1] for s in extract.parse_file("lib.rs", "struct S;\nimpl<T> Work for S<T> { fn go(&self) -> Result<u8, E> { 1 } }\n")[0]}
    assert kinds == {"S": "function", "go": "function"}
    calls = {s[0]: s[5] for s in extract.parse_file("a.go", "func A() {\n b.Run(x)\n helper()\n}\n")[0]}
    assert calls["A"] == [("Run", "call", None), ("helper", "call", None)]


def test_strings_and_comments_hide_brackets_and_imports():
    text = "// import { z } from './z';\nclass Service {\n  open() {\n    const s = \"}\";\n    a();\n  }\n  run() {}\n  stop() {}\n}\nexport default function main() { z(); }\nexport const arrow = async x => x + 1\nconst rx = /[{}]/g;\n"
    symbols, _ = extract.parse_file("s.ts", text)
    by = {s[0]: s for s in symbols}
    assert (by["Service"][2], by["Service"][3]) == (2, 9) and (by["open"][2], by["open"][3]) == (3, 6)
    assert {"run", "stop", "main", "arrow", "rx"} <= set(by)
    assert ("a", "call", None) in by["open"][5] and not any(r[1] == "import" for r in by["main"][5])
    assert "export default function main" in by["main"][4]


def test_members_of_an_exported_class_are_part_of_it():
    assert names("k.ts", "export class K {\n  m() {}\n}\n") == ["K"]


def test_by_lines():
    text = "function a() {\n  x\n}\nfunction b()\nz\nfunction c() {\n" + "y\n" * 80
    assert extract.braces_by_lines(text, "ts") == [("a", "function", 1, 3), ("b", "function", 4, 5), ("c", "function", 6, 56)]


@pytest.mark.parametrize("text", ["", "{", "}", "((((", "class", "class {", "const = ;", "function (", "type X", "a = = b", "x: : y", "`${`", "/*", "'", "fn f(", "impl", "export", "@", "= function", "=> {"])
def test_broken_text_is_passed_over(text):
    for ext in ("ts", "go", "rs", "java"):
        masked, nodes = parse(text, ext)
        assert len(masked) == len(text) and all(0 <= n.start <= n.end <= len(text) for n in walk(nodes))
        extract.parse_file(f"a.{ext}", text)


def test_unknown_and_diagnostics(spark):
    assert extract.parse_file("notes.txt", "function ignored() {}") == ([], [])
    assert {"typescript", "tsx", "python", "go", "rust", "java"} <= {d[0] for d in extract.diagnostics()}
    rows = [("a.ts", "function f() { g(); }"), ("b.ts", None), ("c.txt", "x"), ("d.ts", ""), ("a.ts", "function f() { g(); }")]
    df = spark.createDataFrame(rows, "file_path string, content string").selectExpr("*", "'x' as name")
    got = extract.extract_symbols(df).collect()
    assert [r["name"] for r in got] == ["f", "f"] and got[0]["refs"][0]["name"] == "g"
    assert extract.extract_symbols(df.where("false")).count() == 0
