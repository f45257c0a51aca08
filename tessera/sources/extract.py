"""Symbols of source files: declarations with their ranges, references and re-exports.

Python files go through Python's parser, the languages with braces through tessera.syntax. What
is no valid Python is read by its indentation. Imports, calls and re-exports are found in masked
text, so comments and strings never count.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.syntax.braces import Node, brackets, mask, parse

LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java"}
SCRIPTS = ("typescript", "tsx", "javascript")
UNCLOSED = 50  # lines that a declaration without an end is given

#: Kind of a symbol by the kind of its node; what isn't named here is a function.
_KINDS = {"class": "class", "interface": "interface", "type": "type", "variable": "variable", "field": "variable"}
#: Kinds of nodes that are symbols, by language.
_SYMBOLS = {
    "typescript": ("function", "class", "interface", "type", "variable", "method", "field"), "tsx": ("function", "class", "interface", "type", "variable", "method", "field"),
    "javascript": ("function", "class", "variable", "method", "field"), "go": ("function", "type"), "rust": ("function", "method", "struct", "interface", "impl", "enum", "type"), "java": ("method", "class", "interface", "enum"),
}

SYMBOL = "file_path string, name string, type string, start_line int, end_line int, content string, refs array<struct<name:string,type:string,specifier:string>>, error string"
EXPORT = "file_path string, specifier string, imported string, exported string"


def language(path: str) -> str | None:
    return LANGUAGES.get(path.rpartition(".")[2].lower())


# --- declarations


def _nodes(nodes: list[Node], lang: str) -> list[Node]:
    """The symbols among the nodes: of the file, of its modules, and what a class or implementation holds.

    The members of an exported class of a script aren't symbols of their own.
    """
    out: list[Node] = []
    wanted = _SYMBOLS[lang]
    for n in nodes:
        if n.kind == "module" and lang == "rust":
            out += [m for m in n.children if m.kind in wanted]
        if n.kind in wanted or n.exported and lang in SCRIPTS:
            out.append(n)
        if n.kind in ("class", "impl") and not (n.exported and lang in SCRIPTS):
            out += [m for m in n.children if m.kind in wanted]
    return out


def _python(text: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, first line, last line). A decorated definition is a function, and nothing below it is a symbol."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    out, todo = [], [(n, True) for n in tree.body]
    while todo:
        node, top = todo.pop()
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        plain_class = isinstance(node, ast.ClassDef) and not node.decorator_list
        first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
        out.append((node.name, "class" if plain_class else "function", first, node.end_lineno))
        if plain_class and top:
            todo += [(n, False) for n in node.body]
    return sorted(out, key=lambda s: (s[2], s[3]))


_PY_HEAD = re.compile(r"^([ \t]*)(?:@[\w.]+(?:\([^)\n]*\))?[ \t]+)*(?:async[ \t]+)?(def|class)[ \t]+(\w+)")


def python_by_lines(text: str) -> list[tuple[str, str, int, int]]:
    """Definitions at the left edge of a text that isn't valid Python; each ends before the next line that is no deeper."""
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip()) if x.strip() else 1 << 30 for x in lines]
    out = []
    for k, line in enumerate(lines):
        if (m := _PY_HEAD.match(line)) and not m[1]:
            end = next((j for j in range(k + 2, len(lines)) if depth[j] <= depth[k]), len(lines))
            out.append((m[3], "class" if m[2] == "class" else "function", k + 1, end))
    return out


_HEAD = re.compile(r"^[ \t]*(?:(?:export|default|public|private|protected|static|final|abstract|pub(?:\([\w:]+\))?|async|unsafe)\s+)*(function\*?|class|interface|trait|enum|struct|fn|func|type)\s+(?:\([^)\n]*\)\s*)?(\w+)", re.M)


def braces_by_lines(text: str, ext: str) -> list[tuple[str, str, int, int]]:
    """Heads of declarations in a text whose tree shows none, up to where their bracket closes.

    Without a bracket on its line or the next one a declaration ends on the next line, with one
    that never closes after UNCLOSED lines.
    """
    masked = mask(text, ext)
    closes, starts = brackets(masked), [0, *[m.end() for m in re.finditer("\n", masked)]]
    out = []
    for m in _HEAD.finditer(masked):
        line = bisect.bisect_right(starts, m.start(1)) - 1
        second = starts[line + 2] if line + 2 < len(starts) else len(masked)
        opened = masked.find("{", m.end(), second)
        if opened < 0:
            end = min(line + 1, len(starts) - 1)
        elif closes[opened] >= len(masked):
            end = min(line + UNCLOSED, len(starts) - 1)
        else:
            end = bisect.bisect_right(starts, closes[opened]) - 1
        kind = {"trait": "interface"}.get(m[1], m[1])
        out.append((m[2], kind if kind in ("class", "interface", "type") else "function", line + 1, end + 1))
    return out


# --- imports and references

_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\*\s+as\s+([A-Za-z_$][\w$]*)|\{([^}]*)\})?\s*from\s*(\x02+)")
_REEXPORT = re.compile(r"\bexport\s+(?:type\s+)?(?:(\*)(?:\s+as\s+\w+)?|\{([^}]*)\})\s*from\s*(\x02+)")
_CALL = re.compile(r"(?<![\w$])(?:[\w$]+\s*(?:\?\.|\.|::)\s*)*([A-Za-z_$][\w$]*)\s*(?:<[\w\s,.<>\[\]]*>)?\(")
_HERITAGE = re.compile(r"\b(?:extends|implements)\s+([\w$.,\s<>]+?)(?=\bextends\b|\bimplements\b|\{|$)")
_NOT_CALLS = frozenset("if for while switch catch return function await typeof new super throw else do in of fn func match loop constructor import async".split())
_ALIAS = re.compile(r"\s*(?:type\s+)?([\w$]+|\*)(?:\s+as\s+([\w$]+))?\s*\Z")


def named(list_text: str) -> list[tuple[str, str]]:
    """(name, local name) of a list of imports or exports."""
    return [(m[1], m[2] or m[1]) for part in list_text.split(",") if (m := _ALIAS.match(part.replace("\x01", " ")))]


def _specifier(text: str, m: re.Match, group: int) -> str:
    return text[m.start(group) + 1 : m.end(group) - 1]


def imports_of(text: str, masked: str | None = None) -> list[tuple[str, str]]:
    """(local name, specifier) of a script's imports."""
    out = []
    for m in _IMPORT.finditer(mask(text, "ts") if masked is None else masked):
        specifier = _specifier(text, m, 4)
        out += [(n, specifier) for n in (m[1], m[2]) if n]
        out += [(local, specifier) for _, local in named(m[3] or "")]
    return out


def reexports_of(text: str, masked: str | None = None) -> list[tuple[str, str, str]]:
    """(specifier, imported, exported) of a script's re-exports."""
    out = []
    for m in _REEXPORT.finditer(mask(text, "ts") if masked is None else masked):
        specifier = _specifier(text, m, 3)
        out += [(specifier, "*", "*")] if m[1] else [(specifier, a, b) for a, b in named(m[2])]
    return out


def references_of(masked: str, name: str, imports: list[tuple[str, str]], heritage: bool, inner: frozenset[int] = frozenset()) -> list[tuple[str, str, str | None]]:
    """(name, type, specifier) in the masked text of a declaration: calls, heritage, and the imports they use.

    Of a kind and name the first counts, the declaration's own name never. inner are the places
    of names that are declared, not called.
    """
    found: dict[tuple[str, str], str | None] = {}
    for m in _CALL.finditer(masked):
        if m[1] != name and m[1] not in _NOT_CALLS and m.start(1) not in inner:
            found.setdefault(("call", m[1]), None)
    if heritage:
        for m in _HERITAGE.finditer(masked.split("{")[0] + "{"):
            for part in re.sub(r"<[^<>]*>", "", m[1]).split(","):
                if part.strip():
                    found.setdefault(("implements", part.strip().split(".")[-1].split()[0]), None)
    used = {n for _, n in found}
    for local, specifier in imports:
        if local in used:
            found.setdefault(("import", local), specifier)
    return [(n, kind, spec) for (kind, n), spec in found.items()]


# --- files


def parse_file(path: str, text: str) -> tuple[list[tuple], list[tuple[str, str, str]]]:
    """Symbols (name, type, first line, last line, content, references) and re-exports of one file; an unknown language has none."""
    lang = language(path)
    if lang is None:
        return [], []
    text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    content = lambda a, b: "\n".join(lines[a - 1 : b])
    if lang == "python":
        try:
            spans = _python(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            spans = python_by_lines(text)
        return [(n, k, a, b, content(a, b), []) for n, k, a, b in spans], []
    ext = path.rpartition(".")[2].lower()
    masked, tree = parse(text, ext)
    script = lang in SCRIPTS
    imports = imports_of(text, masked) if script else []
    reexports = reexports_of(text, masked) if script else []
    symbols = _nodes(tree, lang)
    if not symbols and not tree:
        return [(n, k, a, b, content(a, b), []) for n, k, a, b in braces_by_lines(text, ext)], reexports
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    line_of = lambda p: bisect.bisect_right(starts, p)
    declared = frozenset(n.at for n in symbols if n.kind == "method")
    out = []
    for n in symbols:
        a, b = line_of(n.start), line_of(max(n.start, n.end - 1))
        refs = []
        if lang != "java":
            inner = frozenset(p - n.start for p in declared if n.start <= p < n.end)
            refs = references_of(masked[n.start : n.end], n.name, imports, script, inner)
        out.append((n.name, _KINDS.get(n.kind, "function"), a, b, text[n.start : n.end], refs))
    return out, reexports


def diagnostics() -> list[tuple[str, str, str]]:
    """(language, extension, parser) of what can be read."""
    return [(lang, ext, "syntax tree of the language" if lang == "python" else "tree of declarations") for ext, lang in LANGUAGES.items()]


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files(file_path, content binary or string); a file that can't be read gives one row with its error.

    One narrow pass over the files. A file without symbols gives no row, and a null content neither.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["file_path"], pdf["content"]):
                try:
                    text = raw.decode() if isinstance(raw, (bytes, bytearray)) else raw
                    symbols, _ = parse_file(path, text)
                    out += [(path, n, k, a, b, c, [{"name": x, "type": y, "specifier": z} for x, y, z in refs], None) for n, k, a, b, c, refs in symbols]
                except Exception as e:  # noqa: BLE001 - the file's last good rows must stay
                    out.append((path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["file_path", "name", "type", "start_line", "end_line", "content", "refs", "error"])

    return files.where(F.col("content").isNotNull()).select("file_path", "content").mapInPandas(run, SYMBOL)


def extract_reexports(files: DataFrame) -> DataFrame:
    """(file_path, specifier, imported, exported) of files(file_path, content binary or string)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["file_path"], pdf["content"]):
                text = raw.decode(errors="replace") if isinstance(raw, (bytes, bytearray)) else raw
                if language(path) in SCRIPTS:
                    out += [(path, *r) for r in reexports_of(text)]
            yield pd.DataFrame(out, columns=["file_path", "specifier", "imported", "exported"])

    return files.where(F.col("content").isNotNull()).select("file_path", "content").mapInPandas(run, EXPORT)
