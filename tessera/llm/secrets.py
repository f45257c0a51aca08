"""Credentials in code, commands and messages: a conditional random field over lexical tokens.

A line with any evidence of a credential (a word that can announce one, an issuer's prefix, a URL,
a key block, a long literal with digits) is cut into lexical tokens: quoted literals, the password
part of a URL, bare words, placeholders, flags. The field labels each token as the name that
announces a secret, as the secret, or as other; Viterbi's path says which literal characters are
redacted. Private keys are lexed as one token over all their lines. The model is trained here, on
lines that a generator writes from publicly documented formats of credentials and of things that
look like them, family by family, with random words around them.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.crf import Crf

TRAINING_LINES = 10000

_ISSUED = r"(?:gh[pousr]_|github_pat_|glpat-|npm_|xox[abeprs]-|sk-|sk_|pk_|rk_|key_live_|key_test_|AKIA|ASIA|AIza|eyJ|hf_|ya29\.|dop_v1_|SG\.)"
#: Evidence that a line may hold a credential, in lower case; without any of it, and without a long literal with a digit,
#: there is nothing that the field could go by. Plain searches over the whole text cost a fraction of an expression.
EVIDENCE = (
    "pass", "pwd", "secret", "token", "key", "auth", "cred", "pem", "sign", "bearer", "basic", "login", "literal", "://", "-----begin", "-a", "-p", "-u",
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "xox", "sk-", "sk_", "pk_", "rk_", "akia", "asia", "aiza", "eyj", "hf_", "ya29", "dop_v1_", "sg.",
)
_LONG = re.compile(r"[A-Za-z0-9_+/-]{20,}")
_LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def evident_lines(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines with evidence, in order."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case; their places would not fit
        low = "".join([c.lower() if len(c.lower()) == 1 else c for c in text])
    places: list[int] = []
    for needle in EVIDENCE:
        at = low.find(needle)
        while at >= 0:
            if len(needle) > 2 or not (at and (low[at - 1].isalnum() or low[at - 1] in "-_")):
                places.append(at)
            at = low.find(needle, at + 1)
    places += [m.start() for m in _LONG.finditer(text) if not m[0].isalpha() and any([c.isdigit() for c in m[0]])]
    if not places:
        return []
    places.sort()
    ends = [(0, 0), *[m.span() for m in _LINE_END.finditer(text)], (len(text), len(text))]
    out: list[tuple[int, int]] = []
    k, last = 0, len(ends) - 1
    for at in places:
        if out and at < out[-1][1]:
            continue
        while k + 1 < last and ends[k + 1][0] <= at:
            k += 1
        out.append((ends[k][1], ends[k + 1][0]))
    return out


PRIVATE = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN)[\s\S])*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
PUBLIC = r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE(?: REQUEST)?)-----(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z0-9 ]+-----"
_BLOCK = re.compile(rf"(?P<private>{PRIVATE})|(?P<public>{PUBLIC})")

_LEX = re.compile(
    r"""(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*://)(?:(?P<user>[^\s:/@'"`<>]*):(?P<upass>[^\s@'"`]+)(?=@))?
      | (?P<hole>\$\{\{?[^}\s]*\}?\}|\$[A-Za-z_]\w*|\$\([^)\s]*\)|<[^<>\s]{1,40}>|\[[A-Za-z_ -]{3,30}\](?!\s*[=\]])|\{\{[^}]*\}\}|[*•]{3,}|x{4,}(?!\w)|X{4,}(?!\w))
      | (?P<str>(?<=["'`])[^\s"'`$<\[{\\](?:[^\s"'`\\]|\\(?!["'`]))*(?=\\?["'`]))
      | (?P<flag>(?<![\w"'-])-[pa](?=[A-Za-z0-9]*(?:[0-9][A-Za-z]|[a-z][A-Z]|[!\#%^&*])[^\s:,]*(?:\s|$))|(?<![\w"'])--?[A-Za-z][\w-]*)
      | (?P<b64>(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{16,}={1,2}(?=["'`\s]|$))
      | (?P<b64s>(?<=[\s=:"'`])[+/](?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{20,}={0,2}(?![\w.-]))
      | (?P<lit>[A-Za-z0-9_](?:[\w+/.~%!\#*^&$-]*[\w!\#*%$^&+/-])?(?:={1,2}(?![\w"'`=$<\[]))?)
      | (?P<op>:=|=>|==|[^\s\w])""",
    re.X,
)

KINDS = ("scheme", "user", "upass", "hole", "str", "flag", "lit", "op")

_WORDS = {
    "pass": "PASS", "passwd": "PASS", "password": "PASS", "pwd": "PASS", "passphrase": "PASS", "secret": "SECRET", "secrets": "SECRET", "token": "TOKEN", "tokens": "TOKEN",
    "key": "KEY", "keys": "KEY", "apikey": "KEY", "auth": "AUTH", "authorization": "AUTH", "credential": "CRED", "credentials": "CRED", "cred": "CRED", "bearer": "SCHEME", "basic": "SCHEME",
    "pem": "PEM", "signing": "KEY", "access": "ACCESS", "client": "ACCESS", "api": "ACCESS", "field": "NOT", "label": "NOT", "budget": "NOT", "count": "NOT", "max": "NOT", "limit": "NOT",
    "name": "NOT", "type": "NOT", "path": "NOT", "file": "NOT", "policy": "NOT", "sha": "SUM", "hash": "SUM", "checksum": "SUM", "digest": "SUM", "integrity": "SUM", "commit": "SUM", "request": "SUM", "trace": "SUM",
    "etag": "SUM", "revision": "SUM", "build": "SUM", "uuid": "SUM", "public": "PUB", "pub": "PUB", "user": "USER", "dsn": "URL", "url": "URL", "remote": "URL", "env": "REF", "getenv": "REF", "environ": "REF", "vault": "REF", "process": "REF",
    "login": "USER", "username": "USER", "literal": "LIT", "string": "TYPE", "str": "TYPE", "number": "TYPE", "boolean": "TYPE", "bool": "TYPE", "int": "TYPE", "any": "TYPE", "text": "TYPE", "true": "TYPE", "false": "TYPE",
    "null": "TYPE", "none": "TYPE", "nil": "TYPE", "undefined": "TYPE", "required": "TYPE", "optional": "TYPE", "void": "TYPE", "bytes": "TYPE", "changeme": "HOLE", "example": "HOLE", "placeholder": "HOLE", "todo": "HOLE", "your": "HOLE", "redacted": "HOLE", "dummy": "HOLE",
}
_ANNOUNCING = frozenset(["PASS", "SECRET", "TOKEN", "KEY", "AUTH", "CRED", "SCHEME", "LIT"])
_ENDS = re.compile(r"(password|passwd|pass|pwd|secret|token|apikey|key|auth)$")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def _classes(word: str) -> list[str]:
    out = []
    for part in _PART.findall(word):
        part = part.lower()
        c = _WORDS.get(part) or (_WORDS[m[1]] if len(part) > 5 and (m := _ENDS.search(part)) else None)
        if c and c not in out:
            out.append(c)
    return out


_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z")
_ISSUE = re.compile(_ISSUED + r"[\w./+-]{8,}")
_SHAPES = (
    (re.compile(r"\d+(?:\.\d+)*\Z"), "number"),
    (_UUID, "uuid"),
    (re.compile(r"(?i:sha\d{1,3})-[A-Za-z0-9+/]+=*\Z"), "integrity"),
    (re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+\Z"), "dotted"),
    (re.compile(r"[a-z]+(?:-[a-z]+)+-\d+\Z"), "words-number"),
    (re.compile(r"[A-Z][a-z]+\d{2,}\W?\Z"), "Word9999"),
    (re.compile(r"[a-z]+(?:[_-][a-z]+)*\Z"), "words"),
    (re.compile(r"[a-z]{2,}(?:[A-Z][a-z]+)+\d?\Z"), "camel"),
    (re.compile(r"[A-Z][a-z]+(?:[A-Z][a-z]{2,})*\Z"), "Capital"),
    (re.compile(r"[A-Za-z]+(?:[_-]+[A-Za-z]+)*[_-]+[A-Za-z]{0,9}\d{0,4}[A-Za-z]{0,2}\Z"), "slug"),
    (re.compile(r"[A-Z][A-Z0-9_]*\Z"), "CONSTANT"),
    (re.compile(r"[A-Za-z]\w*(?:::?[A-Za-z][\w-]*)+\Z"), "scoped"),
)


_PATH = re.compile(r"[\w.@~:-]*(?:[/\\][\w.@:~-]+)+[/\\]?\Z")
_RUN = re.compile(r"[A-Za-z0-9+]{10,}")


def _random(run: str) -> bool:
    return any(c.islower() for c in run) and any(c.isupper() for c in run) and any(c.isdigit() for c in run)


def _shape(v: str) -> str:
    if ("/" in v or "\\" in v) and _PATH.match(v) and not any(_random(r) for r in _RUN.findall(v)):
        return "path"
    for pattern, name in _SHAPES:
        if pattern.match(v):
            return name
    if _HEX.match(v):
        return "hex"
    has = (any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() for c in v))
    return "".join(x for x, y in zip("aA9#", has) if y)


def _length(n: int) -> str:
    return str(n) if n in (20, 32, 40, 64) else "s" if n < 4 else "4" if n < 8 else "8" if n < 12 else "12" if n < 16 else "16" if n < 24 else "24" if n < 48 else "48"


def _entropy(v: str) -> int:
    n = len(v)
    return int(2 * -sum((k := v.count(c)) / n * math.log2(k / n) for c in set(v)))


def lex(line: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of the lexical tokens of a line; white space is left out."""
    out = []
    for m in _LEX.finditer(line):
        if m.lastgroup == "upass":
            out += [("scheme", m["scheme"], *m.span("scheme")), ("user", m["user"], *m.span("user")), ("upass", m["upass"], *m.span("upass"))]
        else:
            out.append(("lit" if m.lastgroup in ("b64", "b64s") else m.lastgroup, m[0], *m.span()))
    return out


_VOWELS = re.compile(r"[aeiouy]", re.I)
#: (kind, classes, shape, size, issued, entropy, share of vowels) of a token, and what stands around it.
Signature = tuple[str, tuple[str, ...], str, str, bool, int, int]
Context = tuple[str, str, tuple[str, ...], tuple[str, ...], str, tuple[str, ...], str]


def _signature(kind: str, text: str) -> Signature:
    word = kind in ("str", "lit", "upass")
    return (
        kind, tuple(_classes(text)) if len(text) < 60 else (), _shape(text) if word else kind, _length(len(text)), bool(word and _ISSUE.match(text)), _entropy(text) if word else -1,
        4 * len(_VOWELS.findall(text)) // len(text) if word else -1,
    )


class Lexicon:
    """Signatures of the tokens seen, remembered: code repeats its words."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], Signature] = {}

    def of(self, kind: str, text: str) -> Signature:
        got = self.known.get((kind, text))
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[kind, text] = _signature(kind, text)
        return got


def described(tokens: list[tuple[str, str, int, int]], lexicon: Lexicon) -> tuple[list[int], list[tuple[Signature, Context]]]:
    """Numbers of the tokens that are labelled (all but operators), their signatures and contexts."""
    at, out, op, gap_end, flag = [], [], "", 0, ("", -9)
    c1, k1, c2 = (), "start", ()
    seen: tuple[str, ...] = ()  # what was announced in the line so far
    n = len(tokens)
    for k, (kind, text, start, end) in enumerate(tokens):
        if kind == "op":
            op = (op + text)[-3:]
            gap_end = end
            continue
        signature = lexicon.of(kind, text)
        follows = tokens[k + 1][1] if k + 1 < n and tokens[k + 1][0] == "op" and tokens[k + 1][2] == end else "_" if k + 1 < n else "$"
        if kind == "str" and k + 2 < n and tokens[k + 2][0] == "op":
            follows += tokens[k + 2][1]
        link = op.strip("\"'`)]") or ("|" if start > gap_end else "")
        near = ""
        if kind == "flag":
            flag = (text[:12].lower(), len(at))
        elif len(at) - flag[1] <= 2:
            near = f"{flag[0]},{len(at) - flag[1]}"
        out.append((signature, (follows, k1, c1, c2, link, seen, near)))
        at.append(k)
        classes = signature[1]
        c2, c1, k1 = c1, classes, kind
        if classes:
            seen = tuple(sorted({*seen, *[c for c in classes if c in _ANNOUNCING]}))
        op, gap_end = "", end
    return at, out


def feature_names(signature: Signature, context: Context) -> list[str]:
    kind, classes, shape, size, issued, entropy, vowels = signature
    follows, k1, c1, c2, link, seen, near = context
    word = entropy >= 0
    named = "+".join(c1) or "-"
    fs = ["b", f"k={kind}", f"s={shape}", f"k,l={kind},{size}", f"k,s,l={kind},{shape},{size}", f"n={follows}", f"k,op={kind},{link}", f"p={k1}", f"c1={named}", f"c2={'+'.join(c2) or '-'}"]
    fs += [f"c1,op,k={named},{link},{kind}", f"c1,op,s={named},{link},{shape}", f"c1,s,l={named},{shape},{size}", f"s,op={shape},{link}"]
    fs += [f"c={c}" for c in classes] or ["c=-"]
    if "NOT" in c1 or "SUM" in c1 or "PUB" in c1 or "REF" in classes:
        fs.append(f"not,k={kind}")
    fs += [f"has={c},{kind},{link}" for c in c1]
    if word:
        fs += [f"e={entropy}", f"e,k={entropy},{kind},{size}", f"v={vowels},{shape}", f"n,s={follows},{shape}"]
        if seen:
            announced = "+".join(seen)
            fs += [f"seen={announced},{kind},{shape}", f"seen,l={announced},{kind},{size}", f"seen,op={announced},{link},{shape}"]
    if issued:
        fs += ["issued", f"issued,k={kind}", f"issued,{size}"]
    if near:
        fs.append(f"fl={near},{link}")
    return fs


_NOUNS = "alpha bravo cargo delta engine falcon garden harbor island jungle kernel lantern meadow nickel orbit pillar quartz river summit temple union valley winter yellow zephyr token key secret session cache header configuration transaction permission dependency certificate subscription processing".split()
_PASS_NAMES = "password passwd pass pwd passphrase DB_PASSWORD smtp_passwd adminPass dbPwd userPassword MYSQL_PWD PGPASSWORD REDIS_PASS root_password loginPwd spring.datasource.password db.pass".split()
_KEY_NAMES = "api_key apiKey apiSecret SIGNING_SECRET client_key client_secret access_token authToken auth_token ACCESS_KEY AWS_SECRET_ACCESS_KEY secretKey GITHUB_TOKEN token secret refresh_token webhookSecret encryption_key x-api-key SLACK_TOKEN app.secret".split()
K, S = "\x01", "\x02"


class Generator:
    """Lines of publicly documented notations, by family, with what announces (K) and what is secret (S) marked."""

    POSITIVE = ("assignment", "config", "environment", "flag", "url", "header", "issued", "call", "message")

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    # values

    def some(self, chars: str, a: int, b: int | None = None) -> str:
        return "".join(self.rng.choice(chars) for _ in range(self.rng.randint(a, b or a)))

    def one(self, *options):
        return self.rng.choice(options)

    def noun(self) -> str:
        return self.rng.choice(_NOUNS)

    def mixed(self, a: int, b: int) -> str:
        out = self.some(_ALNUM, a, b)
        return out if any(c.isdigit() for c in out) or self.rng.random() < 0.4 else out[:-1] + self.some(_DIGITS, 1)

    def weak(self) -> str:
        n = self.noun
        return self.one(
            lambda: f"{n()}-{n()}-{self.some(_DIGITS, 1, 3)}", lambda: n().title() + self.some(_DIGITS, 1, 5) + self.one("", "!", "#", "*", "%", "-"), lambda: self.mixed(8, 16), lambda: self.mixed(4, 9) + self.rng.choice("!#*-_%^&") + self.mixed(2, 6),
            lambda: n() + self.some(_DIGITS, 1, 4), lambda: f"{n()}{self.some(_DIGITS, 1, 2)}-{n()}", lambda: n().title() + n().title() + self.some(_DIGITS, 1, 3),
        )()

    def letters(self) -> str:
        return self.one(lambda: self.some(_LOWER, 8, 14), lambda: self.some(_LOWER + _UPPER, 9, 16))()

    def hexes(self, *sizes: int) -> str:
        return self.some(_DIGITS + "abcdef", self.rng.choice(sizes))

    def uuid(self) -> str:
        return "-".join(self.hexes(n) for n in (8, 4, 4, 4, 12))

    def token(self) -> str:
        m = self.mixed
        return self.one(
            lambda: "gh" + self.rng.choice("pousr") + "_" + m(36, 36), lambda: "github_pat_" + m(22, 22) + "_" + m(30, 59), lambda: "glpat-" + self.some(_ALNUM + "-_", 20), lambda: "npm_" + m(36, 36), lambda: "xox" + self.rng.choice("bpars") + "-" + self.some(_DIGITS, 10, 12) + "-" + m(24, 24),
            lambda: "sk-" + self.one("", "proj-") + m(24, 48), lambda: self.one("sk", "rk") + "_" + self.one("live", "test") + "_" + m(24, 24), lambda: "key_" + self.one("live", "test") + "_" + m(20, 28), lambda: self.one("AKIA", "ASIA") + self.some(_UPPER + _DIGITS, 16), lambda: "AIza" + self.some(_ALNUM + "-_", 35),
            lambda: "eyJ" + m(15, 40) + ".eyJ" + m(30, 60) + "." + m(30, 48), lambda: "hf_" + m(34, 34), lambda: "dop_v1_" + self.hexes(64), lambda: "SG." + m(22, 22) + "." + m(43, 43),
        )()

    def strong(self) -> str:
        return self.one(self.token, lambda: self.mixed(20, 44), lambda: self.hexes(32, 40, 64), self.uuid, lambda: self.some(_ALNUM + "+/", 30, 42) + self.one("", "=", "=="))()

    def value(self, name: str) -> str:
        weak = any(p in name.lower() for p in ("pass", "pwd"))
        return (self.one(self.weak, self.weak, self.weak, self.letters, self.strong) if weak else self.one(self.strong, self.strong, self.strong, self.weak))()

    def name(self) -> str:
        return self.rng.choice(self.one(_PASS_NAMES, _KEY_NAMES))

    def quoted(self, text: str) -> str:
        q = self.rng.choice("\"'\"'`")
        return q + text + q

    def host(self) -> str:
        return f"{self.noun()}.{self.noun()}.{self.one('com', 'net', 'io', 'example', 'local', 'test')}"

    def words(self, a: int, b: int) -> str:
        return " ".join(self.one(self.noun, self.noun, lambda: self.some(_DIGITS, 1, 5), lambda: self.noun() + self.noun().title(), lambda: f"{self.noun()}/{self.noun()}.{self.one('ts', 'go', 'py')}", lambda: f"{self.noun()}_{self.noun()}{self.some(_DIGITS, 0, 3)}")() for _ in range(self.rng.randint(a, b)))

    def command(self) -> str:
        tool = self.one("make", "npm run", "go test", "pytest", "cargo test --", "docker run", "curl", "git push", "node", "deploy", "kubectl apply", "helm upgrade", "mvn", "gradle")
        return f"{tool} {self.words(1, 2)}"

    def around(self, core: str) -> str:
        """Something that a log or a person may have written on the same line."""
        if self.rng.random() < 0.4:
            return core
        head = self.one("", self.words(1, 4) + self.one(": ", " - ", "; ", ", ", " ", " with ", " for "), f"{self.one('ERROR', 'WARN', 'info:', '[debug]')} {self.words(0, 2)} ")
        tail = self.one("", "", self.one(" ", "; ", ", ", " -> ", ". ") + self.words(1, 4), self.one(".", ";", " &", " |"))
        return f"{head}{core}{tail}"

    def declared(self, name: str) -> str:
        head = self.one("const ", "let ", "var ", "", "String ", "    ", "  this.", "export const ", "private static final String ", "static ", "self.", "pub const ")
        return head + K + name + K + self.one("", "", ": string", ": &str", ": str")

    def end(self) -> str:
        return self.one(";", "", ";", ",", ")")

    # credentials

    def assignment(self) -> str:
        name = self.name()
        value = S + self.value(name) + S
        return self.one(
            lambda: self.declared(name) + self.one(" = ", " := ", "=", " => ", ": ") + self.quoted(value) + self.end(),
            lambda: self.declared(name) + " = " + self.one(f"env[{self.quoted(name.upper())}]", f"process.env.{self.noun().upper()}", f"ENV.fetch({self.quoted(name.upper())})", "opts." + self.noun()) + self.one(" || ", " ?? ", " or ") + self.quoted(value) + self.end(),
            lambda: self.declared(name) + f" = {self.one('os.getenv', 'os.environ.get', 'getenv', 'config.get')}({self.quoted(name.upper())}, {self.quoted(value)})",
            lambda: f"{self.noun()}[{self.quoted(K + name + K)}] = {self.quoted(value)}" + self.end(),
            lambda: f"{self.one('const ', '')}{self.noun()} = {{ {self.one('user', 'id', 'name')}: {self.quoted(self.noun())}, {K}{name}{K}: {self.quoted(value)} }}" + self.end(),
            lambda: f"{self.one('const ', 'let ', '')}{self.one('k', 'v', 't', 'tmp', 'cfg', 'value', 'header', self.noun())} = {self.quoted(S + self.token() + S)}" + self.end(),
        )()

    def config(self) -> str:
        name = self.name()
        value = S + self.value(name) + S
        return self.one(
            lambda: f"{self.one('', '  ', '- ')}{K}{name}{K}{self.one(': ', '=', ' = ', ':')}{value}", lambda: f'"{K}{name}{K}": "{value}"{self.one("", ",", "}")}', lambda: f"<{K}{name}{K}>{value}</{name}>",
            lambda: f"{{{self.quoted(self.noun())}: {self.quoted(self.noun())}, {self.quoted(K + name + K)}: {self.quoted(value)}}}", lambda: f'<add key="{K}{name}{K}" value="{value}" />', lambda: f"machine {self.host()} login {self.noun()} {K}password{K} {S}{self.weak()}{S}",
        )()

    def environment(self) -> str:
        name = self.name().upper().replace(".", "_").replace("-", "_")
        pair = f"{K}{name}{K}={self.one(lambda v: v, lambda v: v, self.quoted)(S + self.value(name) + S)}"
        return self.one(lambda: f"{pair} {self.command()}", lambda: f"export {pair}", lambda: f"docker run -e {pair} {self.noun()}/{self.noun()}", lambda: f"{self.noun().upper()}={self.words(1, 1)} {pair} {self.command()}", lambda: self.around(f"{pair} {self.one('HOME=/root', 'PATH=/bin', 'CI=1')}"), lambda: f"ENV {pair}")()

    def flag(self) -> str:
        strong, weak = S + self.strong() + S, S + self.weak() + S
        tail = self.one("", "", " --limit=3", " -v", " --dry-run", " ;", " && echo done")
        return self.one(
            lambda: f"{self.command()} {K}--{self.one('token', 'api-key', 'secret', 'auth-token', 'access-token', 'client-secret', 'key')}{K}{self.one('=', ' ')}{self.one(strong, self.quoted(strong))}{tail}",
            lambda: f"{self.command()} {K}--{self.one('password', 'pass', 'db-password', 'http-passwd')}{K}{self.one('=', ' ')}{self.one(weak, self.quoted(weak))}{tail}",
            lambda: f"{self.command()} {K}-u{K} {self.one(self.noun(), self.noun() + '_' + self.noun())}:{weak}{tail}", lambda: f"{self.one('mysql', 'mysqldump')} -u{self.noun()} {K}-p{K}{S}{self.noun().title()}{self.some(_DIGITS, 1, 3)}{self.some(_LOWER, 1, 4)}{S} {self.noun()}",
            lambda: f"{K}sshpass{K} -p {self.one(weak, self.quoted(weak))} ssh {self.noun()}@{self.host()}", lambda: f"redis-cli -h {self.host()} {K}-a{K} {weak}{tail}",
            lambda: f"kubectl create secret generic {self.noun()} {K}--from-literal{K}={self.one('db', self.noun(), 'password', 'token')}={weak}{tail}", lambda: f"docker login {self.one('-u', '--username')} {self.noun()} {K}{self.one('-p', '--password')}{K} {weak} {self.host()}",
        )()

    def url(self) -> str:
        scheme = self.one("postgres", "postgresql", "mysql", "amqp", "redis", "mongodb", "https", "http", "mongodb+srv", "ftp")
        inner = f"{scheme}://{self.one('', self.noun(), self.noun() + '_' + self.noun(), 'root', 'svc')}:{S}{self.one(self.weak, self.weak, self.letters, self.strong)()}{S}@{self.host()}{self.one('', ':5432')}/{self.noun()}"
        return self.one(lambda: self.around(inner), lambda: f"{self.one('const ', '')}{self.noun()} = {self.quoted(inner)}{self.end()}", lambda: f"{self.noun()}: {inner}", lambda: f"{self.command()} {inner}")()

    def header(self) -> str:
        value = S + self.strong() + S
        basic = S + self.some(_LOWER + _UPPER, 3, 5) + self.mixed(11, 30) + self.one("", "=", "==") + S
        scheme, secret = self.one((self.one("Bearer", "bearer", "Token", "token"), value), ("Basic", basic))
        core = f"{self.one('Authorization', 'authorization', 'Proxy-Authorization')}: {K}{scheme}{K} {secret}"
        return self.one(
            lambda: f"{self.command()} -H {self.quoted(core)}", lambda: self.around(core), lambda: f"{self.noun()}[{self.quoted('Authorization')}] = {self.quoted(f'{K}{scheme}{K} {secret}')}{self.end()}", lambda: f"{self.noun()}({self.quoted(core)})",
            lambda: self.around(f"{K}{self.one('x-api-key', 'X-Auth-Token', 'Private-Token', 'X-Api-Key')}{K}: {value}"), lambda: f"headers: {{ Authorization: {self.quoted(f'{K}{scheme}{K} {secret}')} }}",
        )()

    def issued(self) -> str:
        value = S + self.token() + S
        return self.one(lambda: self.around(value), lambda: f"{self.noun()}({self.quoted(value)}){self.end()}", lambda: f"# {self.words(1, 3)} {value}", lambda: f"{self.noun()} = {self.quoted(value)}")()

    def call(self) -> str:
        name = self.rng.choice(_PASS_NAMES[:8])
        value = self.quoted(S + self.weak() + S)
        return self.one(
            lambda: f"{self.noun()}.{K}{self.one('credentials', 'login', 'authenticate', 'withCredentials', 'setPassword', 'basicAuth')}{K}({self.quoted(self.noun())}, {value}){self.end()}", lambda: f"{K}credentials{K}({self.quoted(self.noun())},{value})", lambda: f"{self.noun()}({self.quoted(self.noun())}, {K}{name}{K}={value}){self.end()}",
            lambda: f"{self.noun()}.{K}{self.one('setPassword', 'setSecret', 'setToken')}{K}({value});", lambda: f"auth=({self.quoted(self.noun())}, {value})", lambda: f"new {self.noun().title()}{K}{self.one('Credential', 'Auth')}{K}({self.quoted(self.noun())}, {value})",
        )()

    def message(self) -> str:
        name = self.one("password", "passwd", "pwd", "token", "api_key", "access_token", "secret", "api key")
        value = S + self.value(name) + S
        return self.around(self.one(
            f"{K}{name}{K}{self.one('=', ': ', ' = ', '=')}{self.one(value, self.quoted(value))}", f"{{{self.quoted(self.noun())}: {self.quoted(self.noun())}, {self.quoted(K + name + K)}: {self.quoted(value)}}}",
            f"invalid {K}{name}{K} {self.one(S + self.token() + S, self.quoted(value))}",
        ))

    # what looks like credentials

    def negative(self) -> str:
        n, name = self.noun, self.name()
        hole = lambda: self.one("********", "[REDACTED]", "<redacted>", "${API_KEY}", "$API_KEY", "<YOUR_TOKEN>", "changeme", "${{ secrets.TOKEN }}", "xxxxxxxx", "your-api-key", "example", "$DB_PASS", "{{token}}", "placeholder", "null", "undefined", "TODO", "process.env.TOKEN", "%s", "...", "<password>", "{password}", "***")
        slug = lambda: "_".join(n() for _ in range(self.rng.randint(1, 3))) + self.one("", "_" + self.some(_DIGITS, 1, 3), "_" + self.some(_ALNUM[:36], 2, 4))
        upper = name.upper().replace(".", "_")
        line = self.one(
            lambda: f"{self.one('missing', 'unset', 'no', 'check')} {self.one('env ', '', 'variable ')}{upper}{self.one('; ', ', ', ': ', ' - ', '. ')}{self.words(1, 3)} {self.one('failed', 'aborted', 'exceeded', n())} {self.words(0, 2)}",
            lambda: self.around(f"{self.one('', 'mail ', 'reply-to=', 'Contact: ', '(')}{n()}{self.one('', n())}{self.some(_DIGITS, 1, 3)}{self.one('@', ' at ', ' (at) ', '[at]')}{self.host()}"), lambda: f"{n()} = {n()}({n()}) if not {n()}: return None {n()}[{self.quoted(n())}] = {self.some(_DIGITS, 1, 3)}",
            lambda: f"{self.command()} ./{n()}/{n()}/{slug()}/... -run=Test{self.one('Token', 'Key', 'Auth', n().title())} -timeout={self.some(_DIGITS, 2, 4)}s -count={self.some(_DIGITS, 1)} {self.one('-v', '-race')}",
            lambda: f"npm run {self.quoted(self.one('test', 'build', n()) + self.one('-', ':') + self.one('e2e', 'unit', n()))} -- {self.quoted(n() + '/' + slug() + '.test')}",
            lambda: self.one("const ", "", "let ") + name + self.one(" = ", ": ", "=") + self.one(self.quoted(hole()), hole()) + self.end(),
            lambda: self.one("const ", "") + name + " = " + self.one(f"process.env.{upper}", f"os.environ[{self.quoted(upper)}]", f"os.Getenv({self.quoted(upper)})", f"env({self.quoted(upper)})", f"System.getenv({self.quoted(upper)})", f"vault({self.quoted(n() + '/token')})", f"config.get({self.quoted('db.password')})", f"load{n().title()}({n()})", f"{n()}.{n()}Token", "getSecret(name)", "next.token", f"{n()}({n()}.password)", f"{n()}[{n()}]") + self.end(),
            lambda: self.one("const ", "", "  ") + self.one("passwordField", "tokenType", "keyName", "secretLabel", "authMode", "tokenPolicy", "secretName", "keyPath", "PASSWORD_FILE", "key", "keyId") + self.one(" = ", ": ") + self.quoted(self.one("password", "token", "bearer", "basic", "api_key", n(), "/etc/keys/main.pem", "user-password", f"{n()}-{n()}", f"{n()}.{n()}")) + self.end(),
            lambda: self.one("const ", "", "--", "  ") + self.one("tokenBudget", "maxTokens", "max-tokens", "keyCount", "token_limit", "tokens", "token", "passCount", "passed", "keys") + self.one(" = ", ": ", "=") + self.some(_DIGITS, 1, 6) + self.end(),
            lambda: self.one("const ", "", "  ") + self.one("commitSha", "checksum", "digest", "contentHash", "etag", "revision", "treeHash", "sha256", "md5") + self.one(" = ", ": ", "=") + self.one(self.quoted, lambda v: v)(self.hexes(7, 12, 32, 40, 64)) + self.end(),
            lambda: self.one("const ", "", "  ") + self.one("requestId", "traceId", "buildId", "uuid", "sessionUuid", "runId", "X-Request-Id") + self.one(" = ", ": ", "=") + self.one(self.quoted, lambda v: v)(self.uuid()) + self.end(),
            lambda: '"integrity"' + self.one(" = ", ": ") + self.quoted(f"sha{self.one('512', '256', '1')}-" + self.some(_ALNUM + "+/", 27, 86) + self.one("=", "==")) + self.end(),
            lambda: self.one("dsn = ", "url: ", "", f"{n()} ") + self.one(self.quoted, lambda v: v)(f"{self.one('postgres', 'https', 'redis')}://{n()}:{self.one('${DB_PASS}', '$DB_PASS', '********', '<password>', '[REDACTED]', '{password}', '${password}', '***')}@{self.host()}/{n()}"),
            lambda: f"{self.one('label', 'prompt', 'placeholder', 'title')} = " + self.quoted(self.one("Password: ", "Enter token", "API key", "password")) + self.end(),
            lambda: f"{n()}{self.one('Token', 'Key', '.token', '.key')}({self.one(n(), 'token', 'password')}, {self.one('password', n() + '.token', 'key')}){self.end()}",
            lambda: f"{self.one(n(), 'token', 'key', 'secret', 'password', 'auth')}{self.one('?', '')}: {self.one('password', 'string', 'number', 'boolean', 'Token', 'any', 'str', 'String', 'int', 'bytes', 'Optional[str]', 'null', 'true', 'required')}{self.end()}",
            lambda: f"{n()}['{self.one('token', 'key', 'secret')}'] = {self.one(self.some(_DIGITS, 1, 4), n(), n() + '.' + n(), n() + '()')}{self.end()}",
            lambda: f"{n()} = {n()}{self.one('Token', 'Key', 'Secret')}({n()}, limit={self.some(_DIGITS, 1, 3)})",
            lambda: f"{self.command()} --{self.one('token', 'api-key', 'secret', 'password')}{self.one('=', ' ')}{self.one('$API_KEY', '<redacted>', self.quoted('${CI_TOKEN}'), '********', '$TOKEN', '<REDACTED>', '[REDACTED]')}",
            lambda: f"{upper}={self.one('$DB_PASS', '${TOKEN}', '********', '$(cat key)', '<redacted>')} {self.command()}",
            lambda: f"{self.command()} {self.one('--password-stdin', '--max-tokens=' + self.some(_DIGITS, 1, 3), '--key ' + n(), '-k=' + n(), '-k ' + n(), '--features=token', '--tag=token/' + slug(), '-p ' + self.some(_DIGITS, 2, 4), '-p8080:80', '-u ' + n(), '-parallel', '-p ' + n() + '/' + n(), '--author=' + n(), '-a', '--sign-off', '-u origin main')}",
            lambda: self.around(self.one("token <redacted> expired", "Bearer [REDACTED] rejected", "password: ******** refused", f"missing env {upper}", f"token budget {self.some(_DIGITS, 1, 4)} exceeded", "Authorization: Bearer $TOKEN", "Authorization: Basic <redacted>", "invalid password", f"unexpected token {self.one('=', '{', n())}", f"key {self.quoted(n())} not found", f"no auth for {n()}")),
            lambda: self.around(f"{self.one('checksum', 'Commit', 'commit', 'sha256', 'revision', 'object', 'digest')} {self.hexes(7, 10, 40, 64)}"), lambda: self.around(f"{self.one('request', 'trace', 'run', 'id')} {self.uuid()}"),
            lambda: f"{self.one('//', '#', '*')} {self.words(1, 3)} the {self.one('token', 'key', 'password', 'basic auth', 'bearer', 'secret', 'signature')} of a {n()} before the {n()}.",
            lambda: self.around(f"{n()}{self.one('Token', 'Key', 'Auth', 'Secret')}{n().title()} (src/{n()}/{n()}.ts)"),
            lambda: f"{self.one('cargo test --', 'use', 'run', 'Cargo Test --')} {self.one('', chr(34), chr(39), chr(8220))}{self.one(str, str, str.title, str.upper)(n() + '::' + slug())}{self.one('', chr(34), chr(39), chr(8221))}",
            lambda: f"{self.one('pytest', 'go test')} {n()}/{n()}_test.{self.one('py', 'go')}::{self.one('test_', 'Test')}{slug()}", lambda: f"npm run {self.one('test:unit', 'build:prod', 'lint:fix')} -- {n()}/{slug()}.test.ts",
            lambda: f"{n()} = {{ ...{n()}, {self.one('token', 'key', 'secret', 'auth', 'password')}: {self.quoted(n())} }}{self.end()}",
            lambda: f"{self.command()} --{self.one('run-id', 'request-id', 'build-id', 'commit', 'sha', 'revision', 'digest', 'id')}{self.one('=', ' ')}{self.one(self.uuid(), self.hexes(40), 'sha256:' + self.hexes(64))}",
            lambda: f"{n()} {self.one('passport no.', 'Passport:', 'SSN', 'Keyboard:', 'Author:', 'Passed:', 'license', 'Signed-off-by:', 'Keywords:', 'Design:')} {self.one(self.some(_UPPER, 2) + self.some(_DIGITS, 7), self.some(_DIGITS, 9), n().title(), f'{n().title()} {n().title()}')}",
            lambda: f"{n()}: {n()}, {n()} = {slug()}{self.end()}", lambda: f"ssh-{self.one('rsa', 'ed25519')} AAAA{self.some(_ALNUM + '+/', 60)} {n()}@{n()}",
            lambda: f"{self.one('const ', '')}{self.one('publicKey', 'pub', 'fingerprint', 'public_key')} = {self.quoted(self.one(self.mixed(40, 60), 'pk_live_' + self.mixed(24, 24), 'SHA256:' + self.some(_ALNUM + '+/', 43)))}{self.end()}",
            lambda: f"{self.one('const ', '')}{n()} = {self.quoted(self.one(n(), n() + '-' + n(), self.mixed(4, 7), self.host(), f'/{n()}/{n()}.json', self.some(_DIGITS, 4, 8), slug()))}{self.end()}",
            lambda: self.around(f"{self.one('https', 'http')}://{self.host()}{self.one('', ':8080')}/{n()}/{self.some(_DIGITS, 2, 4)}{self.one('', '?tab=' + n(), '@' + self.some(_DIGITS, 1) + '.2')}"), lambda: f"git@{self.host()}:{n()}/{n()}.git",
            lambda: f"import {{ {n()}Token, {n()} }} from {self.quoted('./' + n() + '/token')};", lambda: f"if ({n()}.{self.one('key', 'token')} {self.one('==', '===', '!=')} {self.one(self.quoted(n()), n(), 'null', self.some(_DIGITS, 1, 3))}) {{",
            lambda: f"{self.one('login', 'credentials', 'authenticate', 'setPassword', 'sign')}({self.one('user, password', n(), 'req.body.password', n() + '.' + n(), 'token')}){self.end()}", lambda: f"{n()}{self.one('.', '->')}{self.one('get', 'set', 'find')}({self.quoted(self.one('password', 'token', n() + '_key', 'auth.' + n()))}){self.end()}",
        )()
        return self.one(str.upper, str.title)(line) if self.rng.random() < 0.08 else line  # commands are typed in any case


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOWER + _DIGITS + _UPPER


def _generate(count: int, seed: int, families: tuple[str, ...] = Generator.POSITIVE, share: float = 0.45) -> list[tuple[str, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Lines with the places of their secrets and of the names that announce them; share of them from families, the rest without secrets."""
    make = Generator(seed)
    out = []
    for _ in range(count):
        marked = getattr(make, make.rng.choice(families))() if make.rng.random() < share else make.negative()
        line, secrets, names, opened = "", [], [], -1
        for c in marked:
            if c in (K, S):
                if opened < 0:
                    opened = len(line)
                else:
                    (names if c == K else secrets).append((opened, len(line)))
                    opened = -1
            else:
                line += c
        out.append((line, secrets, names))
    return out


def held_out_recall(family: str, train: int = 3000, test: int = 300) -> float:
    """Share of the secrets of one family found whole by a field that was trained without that family."""
    others = tuple(f for f in Generator.POSITIVE if f != family)
    crf = Crf().fit(examples(train, 11, others))
    lines, finder = _generate(test, 12, (family,), 1.0), Finder(crf)
    return sum(len(set(finder.spans(line)) & set(want)) for line, want, _ in lines) / sum(len(want) for _, want, _ in lines)


def examples(count: int, seed: int, families: tuple[str, ...] = Generator.POSITIVE) -> list[tuple[list[list[str]], list[int]]]:
    out, lexicon = [], Lexicon()
    for line, secrets, names in _generate(count, seed, families):
        tokens = lex(line)
        at, rows = described(tokens, lexicon)
        inside = lambda k, spans: any(a <= tokens[k][2] and tokens[k][3] <= b for a, b in spans)
        out.append(([feature_names(*r) for r in rows], [2 if inside(k, secrets) else 1 if inside(k, names) else 0 for k in at]))
    return out


_MODEL: list[Crf] = []


def model() -> Crf:
    """The field, trained once in a process on TRAINING_LINES generated lines."""
    if not _MODEL:
        _MODEL.append(Crf().fit(examples(TRAINING_LINES, 7)))
    return _MODEL[0]


class Finder:
    """The field applied to lines. Emissions are remembered by signature and context; only lines in which the label
    of a secret can be on the best path at all go through Viterbi."""

    def __init__(self, crf: Crf):
        self.crf, self.lexicon = crf, Lexicon()
        self.memo: dict[tuple[Signature, Context], list[float]] = {}
        moves = crf.moves
        #: The most that a secret's moves can gain over another label's at one place, whatever its neighbours.
        gain = max([moves[x][2] - moves[x][0] for x in range(3)]) + max([moves[2][y] - moves[0][y] for y in range(3)])
        self.margin = max(0.0, gain, max([moves[x][2] - moves[x][0] for x in range(3)]), max([moves[2][y] - moves[0][y] for y in range(3)]))

    def spans(self, line: str) -> list[tuple[int, int]]:
        tokens = lex(line)
        at, rows = described(tokens, self.lexicon)
        emit, possible, memo = [], False, self.memo
        for row in rows:
            e = memo.get(row)
            if e is None:
                if len(memo) > 400_000:
                    memo.clear()
                e = memo[row] = self.crf.emit([feature_names(*row)])[0]
            emit.append(e)
            possible = possible or e[2] + self.margin >= e[0]
        if not possible:
            return []
        spans: list[tuple[int, int]] = []
        for k, label in zip(at, self.crf.best(emit)):
            if label == 2:
                _, _, a, b = tokens[k]
                if spans and spans[-1][1] == a:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
        return spans


def find_in_line(crf: Crf, line: str) -> list[tuple[int, int]]:
    return Finder(crf).spans(line)


def find_secrets(finder: Finder, text: str) -> list[tuple[int, int]]:
    """(start, end) of every secret of a text, in order."""
    spans: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        masked = text
        for m in _BLOCK.finditer(text):
            if m.lastgroup == "private":
                spans.append(m.span())
            masked = masked[: m.start()] + re.sub(r"[^\r\n]", " ", m[0]) + masked[m.end() :]
    else:
        masked = text
    for a, b in evident_lines(masked):
        spans += [(a + x, a + y) for x, y in finder.spans(masked[a:b])]
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """Each secret replaced by a word that needs no quoting, equal secrets by equal words."""
    out, last = [], 0
    for a, b in spans:
        out += [text[last:a], "REDACTED_" + hashlib.blake2s(text[a:b].encode(), digest_size=4).hexdigest()]
        last = b
    return "".join([*out, text[last:]])


def secrets_in(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, secrets, redacted) of every text that holds a secret.

    secrets is an array of (secret, start, end), in code points and in order; a secret that stands
    twice is in it twice. redacted is the whole text with all its secrets masked, the code around
    them unchanged. Null and empty texts and texts without secrets give no row, repeated rows are
    searched each by itself. Lines without any EVIDENCE aren't lexed; everything else is up to the
    field. No shuffle; the model's weights, of fixed size, go to the executors.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value)
        for pdf in batches:
            out = []
            for row_id, t in zip(pdf["row_id"], pdf["text"]):
                spans = find_secrets(finder, t)
                if spans:
                    out.append((row_id, [{"secret": t[a:b], "start": a, "end": b} for a, b in spans], redact(t, spans)))
            yield pd.DataFrame(out, columns=["row_id", "secrets", "redacted"])

    some = rows.select(F.col(key).alias("row_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    kind = some.schema["row_id"].dataType.simpleString()
    return some.mapInPandas(run, f"row_id {kind}, secrets array<struct<secret: string, start: int, end: int>>, redacted string")
