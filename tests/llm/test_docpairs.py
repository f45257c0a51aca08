import pytest

from tessera.llm.docpairs import documented, function_pairs

CASES = [
    ("ts", "/** Reads the cache before the graph. */\nexport async function readCache(a = {}) {\n  return a;\n}", ["readCache"]),
    ("ts", "// Reads the cache before the graph.\n\nfunction f() {}", []),  # a blank line between
    ("ts", "/**\n * @param a the thing that is read\n * @returns the other thing\n */\nfunction f(a) {}", []),
    ("ts", "// eslint-disable-next-line no-console\n// Reads the whole cache lazily.\nfunction f() {}", ["f"]),
    ("ts", "// const x = read(cache, graph);\nfunction f() {}", []),
    ("ts", "/** The read cache function. */\nfunction readCache() {}", []),
    ("ts", "export class K {\n  // Closes all of the sockets.\n  @memo()\n  private close(a: string): void {\n    // Opens all of the sockets.\n    if (a) { go(); }\n  }\n  run = async (x) => { return x; }\n}", ["close"]),
    ("ts", "/** Reads the cache before the graph. */\nconst f = (a) => {\n};\n/** Not a function at all here. */\nconst T = { a: 1 };", ["f"]),
    ("js", "/** Reads the cache before the graph. */\nexports.go = function (a) {\n};", ["go"]),
    ("js", "const s = `\n/** Reads the cache before the graph. */\nfunction f() {}\n`;", []),
    ("go", "// MergeTimer merges each timer into one.\nfunc (r *T) MergeTimer(a string) error {\n}", ["MergeTimer"]),
    ("rs", "/// Reads the cache before the graph.\n#[inline]\npub async fn read<'a>(x: &'a str) -> u8 {\n    // c\n}", ["read"]),
    ("java", "class A {\n  /**\n   * Reads the cache before the graph.\n   */\n  @Override\n  public static List<Row> read(List<Row> a) throws X {\n  }\n}", ["read"]),
    ("py", 'def f():\n    """Reads the cache before the graph."""\n    def g():\n        # Reads the cache before the graph.\n        pass\n', ["f"]),
    ("py", "# Reads the cache before the graph.\n@cached\ndef f():\n    return 1\n", ["f"]),
    ("py", "class K:\n    '''Reads the cache before the graph.'''\n    def m(self):\n        r'''Args:\n            a: the thing that is read\n        '''\n", []),
    ("py", "    def m(self):\n        '''Reads the cache before the graph.'''\n        return 1", ["m"]),
    ("py", 'def f(a): """Reads the cache before the graph.""" return a', ["f"]),
    ("py", "# Reads the cache before the graph.\nf = lambda x: x\n", ["f"]),
    ("ts", "", []),
    ("ts", "/** unclosed", []),
]


@pytest.mark.parametrize(("language", "text", "want"), CASES)
def test_functions(language, text, want):
    assert [p[0] for p in documented(text, language)] == want
    assert [p[0] for p in documented(text.replace("\n", "\r\n"), language)] == want


def test_ranges():
    text = "/** Reads the cache before the graph. */\nexport function f(a) {\n  return { a };\n}\nlet x = 1;"
    name, start, end, code, said = documented(text, "ts")[0]
    assert code == "export function f(a) {\n  return { a };\n}" and said == "Reads the cache before the graph."


def test_rows(spark):
    good = CASES[0][1]
    rows = [(1, "a.ts", good), (2, "b.ts", None), (3, "c.ts", ""), (4, None, good), (5, "x.ts", "/* " + "long " * 50_000), (1, "a.ts", good)]
    df = spark.createDataFrame(rows, "id long, file_path string, content string").selectExpr("*", "'n' as name", "1 as row_id", "'p' as path")
    assert sorted((r["row_id"], r["func_name"]) for r in function_pairs(df, "id", "content", "file_path").collect()) == [(1, "readCache"), (1, "readCache"), (4, "readCache")]
    assert function_pairs(df.where("false"), "id", "content").count() == 0


DOCUMENTED = [
    'def f(path): # noqa: C901\n    """Reads the cache before the graph."""\n',
    "def f(path):\n    'Reads the cache before the graph.'\n",
    'def f(path):\n    "Reads the cache before the graph."\n    return path\n',
    "def f(path):\n\n\n    ('Reads the cache '\n     'before the graph.')\n",
    "def\tf(path): \\\n    'Reads the cache before the graph.'\n",
]


@pytest.mark.parametrize("text", DOCUMENTED)
def test_every_docstring_passes_the_gate(text):
    assert [p[0] for p in documented(text, "py")] == ["f"]


def test_every_docstring_reaches_the_parser(spark):
    df = spark.createDataFrame([(k, "a.py", t) for k, t in enumerate(DOCUMENTED)], "id long, file_path string, content string")
    assert sorted(r["row_id"] for r in function_pairs(df, "id", "content", "file_path").collect()) == list(range(len(DOCUMENTED)))
