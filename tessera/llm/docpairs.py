"""Functions paired with their documentation, from syntax trees.

Python is parsed by its own parser. The languages with braces (ts, js, go, rs, java) are parsed
into a tree of declarations by tessera.syntax. Function nodes of the file, of classes and the like
and of object literals are visited, never those inside a function's body, so a body's own comments
are never taken. A node's place gives the exact source range and the comments attached to it.
"""

from __future__ import annotations

import ast
import re
import textwrap
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.syntax.braces import COMMENT, STRING, Node, parse

LEAST_WORDS = 4

class Function(NamedTuple):
    name: str
    start: int  # of the declaration, decorators included, in characters of the content
    end: int
    doc: str


# --- masking

_MASK_PY = re.compile(
    r"""\#[^\n]*|(?i:[rbuf]{0,2})(?:\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""",
    re.X,
)
_NOT_LINE = re.compile(r"[^\n]")


def _fill(m: re.Match) -> str:
    text = m[0]
    mark = COMMENT if text[0] == "#" else STRING
    return mark * len(text) if "\n" not in text else _NOT_LINE.sub(mark, text)


# --- languages with braces


def parse_braces(text: str, language: str) -> list[Function]:
    masked, nodes = parse(text, language)
    out: list[Function] = []
    todo: list[tuple[Node, int]] = [(n, 0) for n in nodes]
    while todo:
        node, low = todo.pop()
        if node.callable:
            start = _declared_at(masked, node.at, low)
            doc = _doc_above(text, masked, start, node.at, low)
            if doc:
                out.append(Function(node.name, start, node.end, doc))
        else:
            todo += [(n, node.at) for n in node.children]
    return out


_DECORATOR = re.compile(r"\s*(?:@[\w.]+(?:\s*\(.*\))?|#!?\[.*\])\s*")
_MODIFIERS = re.compile(r"(?:(?:export|default|declare|async|public|private|protected|static|final|abstract|override|readonly|synchronized|native|pub(?:\(\w+\))?|unsafe|extern|const|get|set|\*|[\w$]+(?:<[^;{}()]*>)?(?:\[\])?|@[\w.]+(?:\([^()]*\))?|#\[[^\]]*\])\s+)*$")


def _declared_at(masked: str, at: int, low: int) -> int:
    """Start of the declaration around at: its modifiers on the same line."""
    line = masked.rfind("\n", low, at) + 1
    before = masked[max(line, low) : at]
    cut = max(before.rfind(c) for c in ";{}" + COMMENT) + 1
    m = _MODIFIERS.search(before, cut)
    return max(line, low) + (m.start() if m else cut)


def _doc_above(text: str, masked: str, start: int, at: int, low: int) -> str:
    """The comments directly above a declaration, decorators between skipped; a blank line ends them."""
    line = masked.rfind("\n", low, start) + 1
    line = max(line, low)
    before = masked[line:start]
    if before.strip():
        tail = before.rstrip()
        if not tail.endswith(COMMENT):
            return ""
        if tail.strip(COMMENT + " \t"):
            head = len(tail.rstrip(COMMENT + " \t"))
            return text[line + head : start].strip()
    docs = [text[line:start]] if before.strip() else []
    p = line
    while p > low:
        prior = max(masked.rfind("\n", low, p - 1) + 1, low)
        content = masked[prior : p - 1]
        bare = content.strip()
        if not bare:
            if not text[prior : p - 1].strip():
                break
            break
        if not bare.strip(COMMENT + " \t"):
            docs.append(text[prior : p - 1])
        elif not docs_end(bare):
            break
        p = prior
    return "\n".join(reversed(docs)).strip("\n")


def docs_end(bare: str) -> bool:
    """Whether a line above a declaration belongs to it: a decorator, an attribute, an annotation, modifiers alone."""
    return bool(_DECORATOR.fullmatch(bare.replace(STRING, "s").replace(COMMENT, " ").rstrip())) or bare in ("export", "async", "public", "static", "pub", "export default")


# --- Python

_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(", re.M)
_LAMBDA = re.compile(r"^([ \t]*)(\w+)[ \t]*(?::[^=\n]+)?=[ \t]*lambda\b", re.M)
_FIRST_STRING = re.compile(r"""[^\n:]*?:\s*((?i:[rbuf]{0,2})(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"[^"\n]*"|'[^'\n]*'))""")


def parse_python(text: str) -> list[Function]:
    masked = _MASK_PY.sub(_fill, text)
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    dented = textwrap.dedent(text)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(dented)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_lines(text, masked)
    out: list[Function] = []
    todo: list[tuple[ast.stmt, bool]] = [(node, False) for node in tree.body]
    while todo:
        node, inside = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            line = min([node.lineno, *[d.lineno for d in node.decorator_list]])
            docs = [ast.get_docstring(node, clean=False) or ""]
            if not inside:
                docs.append(_doc_above(text, masked, starts[line - 1], starts[line - 1], 0))
                if line != node.lineno:
                    docs.append(_doc_above(text, masked, starts[node.lineno - 1], starts[node.lineno - 1], starts[line - 1]))
            end = starts[node.end_lineno] if node.end_lineno < len(starts) else len(text)
            out += [Function(node.name, starts[line - 1], end, d) for d in docs if d]
            todo += [(child, True) for child in node.body]
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            if isinstance(node.value, ast.Lambda) and not inside:
                target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                doc = _doc_above(text, masked, starts[node.lineno - 1], starts[node.lineno - 1], 0)
                name = getattr(target, "id", getattr(target, "attr", ""))
                if doc and name:
                    out.append(Function(name, starts[node.lineno - 1], starts[node.end_lineno] if node.end_lineno < len(starts) else len(text), doc))
        elif isinstance(node, _COMPOUND):
            for part in ("body", "orelse", "finalbody", "handlers", "cases"):
                for child in getattr(node, part, ()):
                    todo += [(c, inside) for c in child.body] if part in ("handlers", "cases") else [(child, inside)]
    return out


_COMPOUND = (ast.ClassDef, ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)


def _python_by_lines(text: str, masked: str) -> list[Function]:
    """Functions of a text that isn't valid Python, by their indentation."""
    out: list[Function] = []
    body = 1 << 30
    heads = sorted([*_DEF.finditer(masked), *_LAMBDA.finditer(masked)], key=lambda m: m.start())
    for m in heads:
        indent, name = len(m[1].expandtabs()), m[2]
        if indent > body:
            inside = True
        else:
            inside, body = False, indent if m.re is _DEF else body
        after = re.compile(rf"^[ \t]{{0,{len(m[1])}}}[^\s\x01]", re.M).search(masked, text.find("\n", m.end()) + 1 or len(text))
        end = after.start() if after else len(text)
        docs = []
        close = _closing(masked, m.end() - 1) if m.re is _DEF else -1
        if close > 0 and (s := _FIRST_STRING.match(text, close)) and s.end() <= max(end, close):
            docs.append(s[1].lstrip("rRbBuUfF").strip("\"'"))
        if not inside:
            docs.append(_doc_above(text, masked, m.start(), m.start(), 0))
        out += [Function(name, m.start(), end, d) for d in docs if d]
        if indent < body:
            body = indent
    return out


def _closing(masked: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[()]").finditer(masked, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    return -1


# --- what is left of a documentation

_TAG = re.compile(r"^\s*(?:@\w+|\\(?:param|return|brief)\b|:(?:param|type|returns?|rtype|raises?|yields?|arg)\b[^:]*:)")
_SECTION = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Throws|Examples?|Attributes|Note|Notes|See Also)\s*:?\s*$", re.I)
_DIRECTIVE = re.compile(
    r"^\s*(?:eslint\b|eslint-|tslint:|prettier-|jshint\b|jscs:|istanbul\b|c8\s|v8\s|@ts-|ts-|webpackChunkName|noqa\b|pylint:|pyright:|mypy:|type:\s*ignore|flake8|isort:|black:|fmt:\s*(?:off|on|skip)|ruff:|yapf:|pragma\b|nosec\b|nolint|go:|\+build|lint:|clippy|rustfmt|cargo-|coverage:|sonar|NOSONAR|CHECKSTYLE|@formatter|region\b|endregion\b|#region|#endregion|spell-?checker|cspell|-\*-|vim:|biome-ignore|deno-|codeql|skipcq|nolint|noinspection|SuppressWarnings|!)",
    re.I,
)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:const|let|var|return|await|import|from|export|def|class|func|fn|pub|public|private|static|assert|raise|throw|print|if|for|while|else|elif|try|del|use|package|log\.|logger\.|debug!|console\.)\b.*[=(){}\[\];:]|^\s*[\w.$\[\]'\"]+\s*(?::=|\+=|-=|=)\s*\S|^\s*[\w.$]+\([^()]*\)\s*;?\s*$|=>|&&|\|\||^\s*@\w+\(.*\)\s*$|^\s*[)\]}]+[;,]?\s*$"
)
_MARKS = re.compile(r"^\s*(?:/\*+|\*+/|///?!?|//+|#+!?|\*(?!\w*\*\w)|--)?\s?|\s*\*+/\s*$")
_DOCWORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")


def description(doc: str) -> str:
    """The documentation without marks, tags with their arguments, directives and commented-out code."""
    out, skip = [], -1
    for line in doc.split("\n"):
        bare = _MARKS.sub("", line.strip())
        bare = _MARKS.sub("", bare) if bare[:2] in ("//", "/*") else bare
        if not bare.strip():
            if skip == 0:
                skip = -1
            continue
        if _SECTION.match(bare):
            skip = 1
            continue
        if _TAG.match(bare):
            skip = 0
            continue
        if skip >= 0:
            continue  # what follows a tag or a section belongs to it
        if _DIRECTIVE.match(bare) or _CODE.search(bare):
            continue
        out.append(bare.strip())
    return re.sub(r"\{@\w+[^}]*\}", "", " ".join(out)).strip()


def own_words(text: str, name: str) -> list[str]:
    """The words of a description that aren't the function's name or words of it."""
    parts = {p.lower() for p in _CAMEL.findall(name)} | {name.lower()}
    out = []
    for token in _TOKEN.findall(text):
        if token.lower() != name.lower():
            out += [w for w in _DOCWORD.findall(token) if w.lower() not in parts and not w.isdigit()]
    return out


_TOKEN = re.compile(r"[\w$]+(?:['’]\w+)?")


def _may_document(text: str, language: str) -> bool:
    """Whether there is anything that can be a documentation: a comment's mark, or in Python a function and a quote."""
    if language == "py":
        return ("def" in text or "lambda" in text) and any([c in text for c in "\"'#"])
    return "//" in text or "/*" in text


_LONE_RETURN = re.compile(r"\r(?!\n)")


def documented(text: str, language: str) -> list[tuple[str, int, int, str, str]]:
    """(name, start, end, code, description) of the functions with a real description."""
    plain = _LONE_RETURN.sub("\n", text)  # as long as text, so places are the same
    if not _may_document(plain, language):
        return []
    found = parse_python(plain) if language == "py" else parse_braces(plain, language)
    out, seen = [], set()
    for f in sorted(found, key=lambda f: (f.start, f.name)):
        said = description(f.doc)
        if (f.name, f.start) not in seen and len(own_words(said, f.name)) >= LEAST_WORDS:
            seen.add((f.name, f.start))
            out.append((f.name, f.start, f.end, text[f.start : f.end], said))
    return out


def language_of(path: str | None, text: str) -> str:
    tail = re.sub(r"[^a-z0-9]+$", "", (path or "").lower()).rpartition(".")[2]
    if tail in ("py", "pyi"):
        return "py"
    if tail in ("rs", "go", "java", "ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"):
        return tail
    return "py" if re.search(r"^\s*(?:async\s+)?def \w+\s*\(.*\)?.*:?\s*$", text, re.M) and "{" not in text.split("\n")[0] else "ts"


def function_pairs(symbols: DataFrame, key: str, content: str, path: str | None = None) -> DataFrame:
    """(row_id, func_name, start, end, code, description) of every documented function.

    A function, method or function-valued variable counts if the comment directly above it
    (decorators, attributes and annotations may stand between) or its docstring has LEAST_WORDS
    words left without marks, tags with their arguments, directives, commented-out code and the
    words of its own name. start and end are the exact range of code in the content, in code
    points, whatever its line ends. Nested functions count by their docstring only. Code that can't be parsed whole gives
    what can be read; null and empty contents and those without comment or docstring give no
    row; what goes to the parser is everything with a comment's mark, or with def and a quote. Repeated rows each count. No shuffle.
    """
    with_path = path is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row_id, p, text in zip(pdf["row_id"], pdf["path"], pdf["content"]):
                out += [(row_id, *f) for f in documented(text, language_of(p, text))]
            yield pd.DataFrame(out, columns=["row_id", "func_name", "start", "end", "code", "description"])

    c = F.col("content")
    rows = symbols.select(F.col(key).alias("row_id"), (F.col(path) if with_path else F.lit(None).cast("string")).alias("path"), F.col(content).alias("content"))
    rows = rows.where(c.contains("//") | c.contains("/*") | c.contains("#") | c.contains("def") & (c.contains('"') | c.contains("'")))
    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"row_id {kind}, func_name string, start int, end int, code string, description string")
