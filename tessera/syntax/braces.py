"""A tolerant syntax tree of the languages with braces: TypeScript, JavaScript, Go, Rust and Java.

Strings and comments are masked first, at the same length, so that every place in the tree is a
place in the text. Brackets are matched over the masked text. A level (the file, a class, an
object literal) is then read token by token, a bracket with all it holds being one token, and its
declarations become nodes with their own levels below them. What can't be read is passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

COMMENT, STRING = "\x01", "\x02"

_MASK_C = re.compile(
    r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)
      |"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)
      |'(?:\\.|[^'\\\n])*'
      |`(?:\\[\s\S]|[^`\\])*(?:`|\Z)""",
    re.X,
)
_MASK_JAVA = re.compile(r'"""[\s\S]*?(?:"""|\Z)|' + _MASK_C.pattern, re.X)
_MASK_RUST = re.compile(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|r(\#*)"[\s\S]*?"\1|b?"(?:\\[\s\S]|[^"\\])*(?:"|\Z)|b?'(?:\\.[^'\n]{0,8}|[^'\\\n])'""", re.X)
#: A regular expression literal: a slash where a value begins.
_PATTERN = re.compile(r"(?<=[=(,:;!&|?{}\[\n])(\s*)(/(?![*/\x01])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)")
_NOT_LINE = re.compile(r"[^\n]")
_BRACKETS = re.compile(r"[{}()\[\]]")
_CLOSE = {")": "(", "}": "{", "]": "["}
_TOKEN = re.compile(r"[A-Za-z_$#@][\w$]*|\d[\w.]*|=>|->|::|\x01+|\x02+|[^\s\w]")
_NAME = re.compile(r"#?[A-Za-z_$][\w$]*\Z")

Token = tuple[str, int, int]


def _fill(m: re.Match) -> str:
    text = m[0]
    mark = COMMENT if text[:2] in ("//", "/*") else STRING
    return mark * len(text) if "\n" not in text else _NOT_LINE.sub(mark, text)


def mask(text: str, language: str) -> str:
    """text with the characters of comments and strings replaced by marks, line ends kept."""
    out = (_MASK_RUST if language == "rs" else _MASK_JAVA if language == "java" else _MASK_C).sub(_fill, text)
    if language not in ("rs", "java", "go") and "/" in out:
        out = _PATTERN.sub(lambda m: m[1] + STRING * len(m[2]), out)
    return out


def brackets(masked: str) -> dict[int, int]:
    """Where each bracket closes; what is never closed reaches to the end."""
    closes: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in _BRACKETS.finditer(masked):
        c, at = m[0], m.start()
        if c in "{([":
            stack.append((c, at))
            continue
        want = _CLOSE[c]
        while stack and stack[-1][0] != want and any(s[0] == want for s in stack):
            stack.pop()
        if stack and stack[-1][0] == want:
            closes[stack.pop()[1]] = at
    for _, at in stack:
        closes[at] = len(masked)
    return closes


@dataclass(slots=True)
class Node:
    """A declaration: kind is function, method, class, interface, type, enum, struct, impl, module, variable, field or export."""

    kind: str
    name: str
    start: int  # with modifiers and decorators
    at: int  # of the keyword or name
    end: int
    callable: bool = False  # a function, or a variable, field or property that holds one
    exported: bool = False
    header: int = 0  # where the body begins
    children: list[Node] = field(default_factory=list)


_CLASSLIKE = {"class": "class", "interface": "interface", "trait": "interface", "enum": "enum", "struct": "struct", "record": "struct", "impl": "impl", "namespace": "module", "module": "module", "mod": "module", "object": "class", "extension": "class"}
_MODIFIERS = frozenset("export default declare async public private protected static final abstract override readonly synchronized native pub unsafe extern const get set * accessor sealed open internal inner data".split())
_NO_METHOD = frozenset("if for while switch catch with function return synchronized new do else try match loop unsafe async await typeof using when sizeof fn func super this".split())
_BINARY = frozenset("= + - * / % & | ^ ! ? : < , . => -> :: ( && || extends implements where throws in of".split())
_JOINS = frozenset(". + - * / % & | ^ ? : < > , => -> :: = { ( [".split())


class _Reader:
    def __init__(self, masked: str, language: str):
        self.masked, self.language = masked, language
        self.closes = brackets(masked)
        self.script = language not in ("go", "rs", "java")

    def tokens(self, a: int, b: int) -> list[Token]:
        out: list[Token] = []
        masked, closes, search = self.masked, self.closes, _TOKEN.search
        while m := search(masked, a, b):
            text, at, a = m[0], m.start(), m.end()
            if text in "{([":
                a = min(closes.get(at, b) + 1, b)
                a = max(a, at + 1)
            elif text[0] == COMMENT:
                continue
            out.append((text[0] if text[0] == STRING else text, at, a))
        return out

    def broken(self, t: list[Token], k: int) -> bool:
        """Whether a line ends before token k."""
        return "\n" in self.masked[t[k - 1][2] : t[k][1]]

    def generics(self, t: list[Token], k: int) -> int:
        """The token after <...> at k, or k."""
        if k >= len(t) or t[k][0] != "<":
            return k
        depth = 0
        for j in range(k, min(len(t), k + 80)):
            c = t[j][0]
            depth += (c == "<") - (c == ">")
            if not depth:
                return j + 1
            if c in (";", "{") and depth and c == ";":
                break
        return k

    def body(self, t: list[Token], k: int) -> tuple[int, int, int]:
        """(next token, end, header end) of a function whose parameters end before token k."""
        n, first = len(t), k
        while k < n:
            if t[k][0] == "<" and (g := self.generics(t, k)) > k:
                k = g
                continue
            c = t[k][0]
            if c == "{" and not (k > first and t[k - 1][0] in (":", "|", "&") and self.script):
                return k + 1, t[k][2], t[k][1]
            if c == ";":
                return k + 1, t[k][2], t[k][1]
            if c in (",", "}") or k > first and self.broken(t, k) and c not in _JOINS and c not in ("throws", "where") and t[k - 1][0] not in _BINARY:
                break
            k += 1
        end = t[k - 1][2] if k else 0
        return k, end, end

    def expression(self, t: list[Token], k: int, comma: bool) -> tuple[int, int]:
        """(next token, end) of the expression that begins at token k."""
        n, first = len(t), k
        while k < n:
            c = t[k][0]
            if c == ";":
                return k + 1, t[k][2]
            if comma and c == ",":
                return k + 1, t[k - 1][2] if k > first else t[k][1]
            if k > first and self.broken(t, k) and t[k - 1][0] not in _BINARY and (c not in _JOINS or c == "{") and c != STRING:
                break
            k += 1
        return k, t[k - 1][2] if k else 0

    def value(self, t: list[Token], k: int, node: Node, comma: bool) -> int:
        """Reads what is assigned to node from token k on; the next token."""
        n = len(t)
        j = k + (k < n and t[k][0] in ("async", "move"))
        c = t[j][0] if j < n else ""
        if c in ("function", "func"):
            p = j + 1
            while p < n and t[p][0] != "(" and p < j + 6:
                p += 1
            if p < n and t[p][0] == "(":
                node.callable = True
                nxt, node.end, node.header = self.body(t, p + 1)
                return nxt
        g = self.generics(t, j)
        if g < n and (t[g][0] == "(" or _NAME.match(t[g][0])):
            p = g + 1
            if t[g][0] == "(" and p < n and t[p][0] == ":":
                while p < n and t[p][0] not in ("=>", ";", "=") and p < g + 60:
                    p += 1
            if p < n and t[p][0] == "=>":
                node.callable = True
                node.header = t[p][2]
                if p + 1 < n and t[p + 1][0] == "{":
                    last = p + 1 + (p + 2 < n and t[p + 2][0] == ";")
                    node.end = t[last][2]
                    return last + 1
                nxt, node.end = self.expression(t, p + 1, comma)
                return nxt
        if c == "|" and self.language == "rs":
            node.callable = True
        if c == "class":
            p = j
            while p < n and t[p][0] not in ("{", ";"):
                p += 1
            if p < n and t[p][0] == "{":
                node.children = self.level(t[p][1] + 1, t[p][2] - 1, "class")
        if c == "{":
            node.children = self.level(t[j][1] + 1, t[j][2] - 1, "object")
        nxt, node.end = self.expression(t, k, comma)
        return nxt

    def start(self, t: list[Token], k: int) -> tuple[int, bool]:
        """(where the declaration at token k begins with its modifiers, whether it is exported)."""
        exported = False
        while k:
            c = t[k - 1][0]
            if c in _MODIFIERS or c.startswith("@"):
                exported = exported or c == "export"
                k -= 1
            elif c == "(" and k > 1 and (t[k - 2][0].startswith("@") or t[k - 2][0] == "pub"):
                k -= 2
            elif c == "[" and k > 1 and t[k - 2][0] == "#":
                k -= 2
            elif c == "." and k > 2 and t[k - 3][0].startswith("@") or c == "(" and k > 3 and t[k - 3][0] == ".":
                k -= 1
            elif _NAME.match(c) and k > 1 and t[k - 2][0] == "." or c in ("function", "fn", "func"):
                k -= 1
            elif self.language == "java" and (_NAME.match(c) and c not in _NO_METHOD or c in (">", "[", "<", "?", ",")) and not (c == "," and not any(x[0] == "<" for x in t[max(0, k - 12) : k])):
                k -= 1  # a type before a method's name
            else:
                break
        return t[k][1], exported

    def declaration(self, t: list[Token], k: int, inside: str) -> tuple[Node | None, int]:
        """(the declaration that begins at token k, if any; the next token)."""
        n = len(t)
        c, at, end = t[k]
        before = t[k - 1][0] if k else ""
        after = t[k + 1][0] if k + 1 < n else ""

        def node(kind: str, name: str, j: int = k, **more) -> Node:
            start, exported = self.start(t, j)
            return Node(kind, name.lstrip("#"), start, at, end, exported=exported, **more)

        if before != "." or after == "=":
            if c in ("function", "fn", "func") and self._keyword(c):
                j = k + 1
                if c == "func" and after == "(":
                    j += 1  # a receiver
                j += j < n and t[j][0] == "*"
                name = t[j][0] if j < n and _NAME.match(t[j][0]) else ""
                j += bool(name)
                p = self.generics(t, j)
                p += p < n and c == "func" and t[p][0] == "["
                if p < n and t[p][0] == "(" and (name or before == "default"):
                    made = node("method" if inside in ("class", "impl") else "function", name or "default", callable=True)
                    nxt, made.end, made.header = self.body(t, p + 1)
                    return made, nxt
                return None, k + 1
            if c in _CLASSLIKE and self._keyword(c) and (_NAME.match(after) or c == "impl" or before == "default"):
                return self._classlike(t, k, node)
            if c == "type" and _NAME.match(after) and (self.script or self.language in ("go", "rs")):
                return self._type(t, k, node)
            if c == "type" and after == "(" and self.language == "go":
                made = node("group", "")
                made.children = self._specs(t[k + 1])
                made.end = t[k + 1][2]
                return made, k + 2
            if c in ("const", "let", "var", "val") and (_NAME.match(after) or after == "mut"):
                j = k + 1 + (after == "mut")
                if j < n and t[j][0] in ("fn", "enum"):
                    return None, k + 1
                made = node("variable", t[j][0] if j < n else "")
                j = self._annotation(t, j + 1)
                if j < n and t[j][0] == "=":
                    return made, self.value(t, j + 1, made, False)
                nxt, made.end = self.expression(t, k, False)
                return made, nxt
        if _NAME.match(c) and c not in _NO_METHOD and not (before == "." and after != "="):
            return self._member(t, k, inside, before, node)
        if c == "{" and before in ("=", "default", "return"):
            made = Node("group", "", at, at, end, children=self.level(at + 1, end - 1, "object"))
            return made, k + 1
        return None, k + 1

    def _keyword(self, c: str) -> bool:
        return {"fn": self.language in ("rs",), "func": self.language in ("go",), "function": self.script, "impl": self.language == "rs", "trait": self.language == "rs", "struct": self.language == "rs", "mod": self.language == "rs", "record": self.language == "java", "interface": self.language != "go", "namespace": self.script, "module": self.script, "object": False, "extension": False}.get(c, self.language != "go")

    def _classlike(self, t: list[Token], k: int, node) -> tuple[Node | None, int]:
        n, c = len(t), t[k][0]
        made = node(_CLASSLIKE[c], t[k + 1][0] if k + 1 < n and _NAME.match(t[k + 1][0]) and t[k + 1][0] not in ("extends", "implements") else "default")
        p = k + 1
        while p < n and t[p][0] not in ("{", ";"):
            p += 1
        if c == "impl":
            depth, plain = 0, []
            for x, _, _ in t[self.generics(t, k + 1) : p]:
                depth += (x == "<") - (x == ">")
                if not depth and _NAME.match(x):
                    plain.append(x)
            kept = plain[plain.index("for") + 1 :] if "for" in plain else plain
            made.name = (kept or ["impl"])[0]
        if p < n and t[p][0] == "{":
            made.end, made.header = t[p][2], t[p][1]
            made.children = self.level(t[p][1] + 1, t[p][2] - 1, "module" if made.kind == "module" else "class")
            return made, p + 1
        made.end = t[p][2] if p < n else t[n - 1][2]
        made.header = made.end
        return made, p + 1

    def _type(self, t: list[Token], k: int, node) -> tuple[Node | None, int]:
        n = len(t)
        if self.language == "go":
            made = node("type", t[k + 1][0])
            p = k + 2
            while p < n and not (p > k + 2 and self.broken(t, p)):
                p += 1
            made.end = t[p - 1][2]
            return made, p
        p = self.generics(t, k + 2)
        if p < n and t[p][0] == "=":
            made = node("type", t[k + 1][0])
            nxt, made.end = self.expression(t, p + 1, False)
            return made, nxt
        return None, k + 1

    def _specs(self, group: Token) -> list[Node]:
        """The types of a grouped declaration, one on each line."""
        t, out = self.tokens(group[1] + 1, group[2] - 1), []
        for k, (c, at, _) in enumerate(t):
            if _NAME.match(c) and (not k or self.broken(t, k) or t[k - 1][0] == ";"):
                p = k + 1
                while p < len(t) and not self.broken(t, p) and t[p][0] != ";":
                    p += 1
                out.append(Node("type", c, at, at, t[p - 1][2]))
        return out

    def _annotation(self, t: list[Token], k: int) -> int:
        """The token after a type annotation at k."""
        n = len(t)
        k += k < n and t[k][0] in ("?", "!")
        if k < n and t[k][0] == ":":
            first = k
            while k < n and t[k][0] not in ("=", ";") and not (k > first and self.broken(t, k) and t[k - 1][0] not in _BINARY and t[k][0] not in _JOINS):
                if t[k][0] == "," and not any(x[0] == "<" for x in t[first:k]):
                    break
                k += 1
        return k

    def _member(self, t: list[Token], k: int, inside: str, before: str, node) -> tuple[Node | None, int]:
        """A method, a field, a property that holds a function, or an assignment of one."""
        n, c = len(t), t[k][0]
        after = t[k + 1][0] if k + 1 < n else ""
        if after == "=" and (k + 2 >= n or t[k + 2][0] != "=") and before not in ("=", "!", "<", ">"):
            made = node("field" if inside == "class" else "variable", c)
            j = k
            while j > 1 and t[j - 1][0] == "." and _NAME.match(t[j - 2][0]):
                j -= 2
            made.at = t[j][1]
            nxt = self.value(t, k + 2, made, inside == "object")
            keep = made.callable or made.children or inside == "class"
            if c == "exports" and before == ".":
                made.kind = "group"
            return (made if keep else None), nxt if keep else k + 2
        if after == ":" and inside != "class" and self.script and before not in ("?", "case"):
            made = node("field", c)
            p = k + 2 + (k + 2 < n and t[k + 2][0] == "async")
            if p < n and (t[p][0] == "function" or t[p][0] == "(" and p + 1 < n and t[p + 1][0] == "=>"):
                return made, self.value(t, k + 2, made, True)
            return None, k + 2
        p = self.generics(t, k + 1 + (after == "?"))
        if p < n and t[p][0] == "(" and before not in ("new", "return", "await", "=", "=>", "?"):
            q = p + 1
            while q < n and t[q][0] not in ("{", ";", "=", "}") and q < p + 60 and not (self.broken(t, q) and t[q][0] not in _JOINS and t[q][0] not in ("throws", "where") and t[q - 1][0] not in _BINARY):
                if q == p + 1 and t[q][0] not in (":", "throws", "->"):
                    return None, k + 1
                q += 1
            if q < n and t[q][0] == "{":
                made = node("method", c, callable=True)
                nxt, made.end, made.header = self.body(t, p + 1)
                return made, nxt
            if inside == "class" and q < n and t[q][0] == ";" and self.language == "java":
                made = node("method", c, callable=True)
                made.end = made.header = t[q][2]
                return made, q + 1
            return None, k + 1
        if inside == "class" and self.script and after in (":", ";", "?", "!", "") and before in ("", ";", "{", "}", *_MODIFIERS):
            p = self._annotation(t, k + 1)
            made = node("field", c)
            if p < n and t[p][0] == "=":
                return made, self.value(t, p + 1, made, False)
            nxt, made.end = self.expression(t, k, False)
            return made, nxt
        return None, k + 1

    def level(self, a: int, b: int, inside: str) -> list[Node]:
        t, out, k = self.tokens(a, b), [], 0
        while k < len(t):
            made, nxt = self.declaration(t, k, inside)
            if made:
                if made.kind == "group":
                    out += made.children
                else:
                    out.append(made)
            k = max(nxt, k + 1)
        return out


def parse(text: str, language: str) -> tuple[str, list[Node]]:
    """(masked text, declarations of the file with those below them); language is a file's extension."""
    masked = mask(text, language)
    return masked, _Reader(masked, language).level(0, len(masked), "file")


def walk(nodes: list[Node]) -> list[Node]:
    """All nodes, each before what is below it."""
    out: list[Node] = []
    todo = list(reversed(nodes))
    while todo:
        n = todo.pop()
        out.append(n)
        todo += reversed(n.children)
    return out
