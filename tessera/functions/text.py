"""Text expressions shared by the operators; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_word(pattern: str, first: str = "") -> str:
    """pattern between ASCII word boundaries, which Java's \\b are not.

    first names the characters it can begin with: they are looked at before anything else, so most places fail at once.
    """
    look = f"(?=[{first}])" if first else ""
    return rf"{look}(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def first_letters(phrase: str) -> str:
    """Both cases of the letters that a phrase or a group of phrases can begin with."""
    letters = {w[0] for w in phrase.removeprefix("(?:").removesuffix(")").split("|")}
    return "".join(sorted({c for x in letters for c in (x.lower(), x.upper())}))


def once(value: Column, use) -> Column:
    """use(value), with value computed a single time in each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def slugify(text: Column, fallback: Column | str = "") -> Column:
    """Lower case, other characters than a-z and 0-9 joined to one dash, no dash at the ends, 80 characters at most."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.substring(slug, 1, 80)
    return F.when(F.length(slug) > 0, slug).otherwise(fallback if isinstance(fallback, Column) else F.lit(fallback))


def memory_id(text: Column) -> Column:
    """An id as the project reads it: every name between slashes as a slug."""
    return F.array_join(F.transform(F.split(text, "/"), lambda part: slugify(part)), "/")


# Phrase rules of prose compression, applied in this order between word boundaries.
PHRASES = (
    ("please", ""),
    ("make sure to", ""),
    ("you should", ""),
    ("you need to", ""),
    ("it is important to", ""),
    ("in order to", "to"),
    ("due to the fact that", "because"),
    ("at this point in time", "now"),
    ("for the purpose of", "for"),
    ("the ability to", "can"),
    ("utilize", "use"),
    ("approximately", "~"),
    ("additional", "more"),
    ("currently", "now"),
    ("therefore", "so"),
    ("however", "but"),
    ("because", "bc"),
    ("without", "w/o"),
    ("with", "w/"),
    ("and", "&"),
    ("that", ""),
    ("(?:the|a|an)", ""),
    ("(?:just|very|really|actually|basically|simply|probably|maybe|perhaps|kind of|sort of)", ""),
)
# Punctuation rules of prose compression, applied after the phrases, in this order.
PUNCTUATION = (
    (r"\s+([,.;:!?])", 1),
    (r"([,;:!?])\1+", 1),
    (r"\s{2,}", " "),
    (r"\s+-\s+", " — "),
)
# Credential shapes that are removed before sharing.
BEARER = r"Bearer\s+[A-Za-z0-9._~+/-]+=*"
TOKEN_SHAPES = r"(?:github_pat_[A-Za-z0-9_]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-(?:proj-)?[A-Za-z0-9_-]{16,}|xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16})"
KEY_VALUES = r"""((?:api[_-]?key|access[_-]?token|auth[_-]?token|token|secret|password|passwd|authorization)\s*[:=]\s*)(?:"[^"\n]*"|'[^'\n]*'|[^\s,;]+)"""
# Words that make a line worth keeping.
KEYWORDS = "(?:decision|decided|todo|fixme|remember|constraint|invariant|architecture|root cause|bug|follow[- ]?up)"
# Signals of a task's scale.
LARGE = "(?:refactor|redesign|migrate|rewrite|architecture|multiple|system|platform|across|all)"
SMALL = "(?:fix|typo|rename|add|update|change|one|single|simple)"
# Commands that destroy more than they should.
FOOTGUNS = (
    r"rm\s+-rf\s+/\*?(?:$|\s)",
    r"rm\s+-rf\s+(?:~|\$HOME)(?:$|\s)",
    r"rm\s+-rf\s+(?:\.|\./|\*)(?:$|\s)",
    r"git\s+clean\s+.*-[^\s]*[fx]",
    r"git\s+reset\s+--hard",
    r"mkfs(?:[^A-Za-z0-9_]|$)",
    r"dd\s+if=.*of=/dev",
    r":\(\)\{.*\}",
    r"(?:curl|wget)[^A-Za-z0-9_][^|;]*[|;]\s*(?:sh|bash)(?:[^A-Za-z0-9_]|$)",
)
# Files that commonly hold credentials.
SECRET_FILES = (".npmrc", ".netrc", ".pgpass", ".htpasswd", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials", ".git-credentials")
SECRET_NAMES = (r"^\.env(?:\..+)?$", r"\.(?:pem|key|p12|pfx|keystore|jks)$", r"^service[-_]?account.*\.json$")
SECRET_FOLDERS = (".aws", ".docker", ".ssh")
# Paths of tests.
TEST_FILES = (r"[/\\]test[/\\]", r"[/\\]__tests__[/\\]", r"\.test\.[jt]sx?$", r"\.spec\.[jt]sx?$", r"_test\.(?:go|py|rs)$", r"test_.*\.py$")
# Labels of a version control status code.
STATUS_CODES = {
    "M ": "modified (staged)", " M": "modified", "A ": "added", " D": "deleted", "D ": "deleted (staged)", "??": "untracked", "R ": "renamed", "AM": "added+modified", "UU": "conflict",
}


def any_match(text: Column, patterns: tuple[str, ...], flags: str = "") -> Column:
    """Whether one of the patterns is found; one pass of one expression."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def compress_prose(text: Column) -> Column:
    """Prose with filler removed and common phrases shortened; blank text stays as it is."""
    body = text
    for phrase, short in PHRASES:
        body = F.regexp_replace(body, ascii_word(f"(?i:{phrase})", first_letters(phrase)), short)
    # most texts hold some phrase, few hold all: a text without any skips these passes
    some = "|".join(p for p, _ in PHRASES)
    body = F.when(text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{some})(?![A-Za-z0-9_])"), body).otherwise(text)
    for pattern, to in PUNCTUATION:
        body = F.regexp_replace(body, pattern, f"${to}" if isinstance(to, int) else to)
    body = trim_all(body)
    lead = F.regexp_extract(text, r"^\s*", 0)
    trail = F.when(text.rlike(r"\s$"), F.regexp_extract(text, r"(\s+)$", 1)).otherwise("")
    return F.when(trim_all(text) == "", text).otherwise(once(body, lambda b: F.when(b == "", "").otherwise(F.concat(lead, b, trail))))


def redact(text: Column, roots: tuple[str, ...] = ()) -> Column:
    """Local paths and the usual credential shapes removed; the longest root first."""
    out = text
    for root in sorted({r for r in roots if len(r) > 1}, key=lambda r: (-len(r), r)):
        out = F.replace(out, F.lit(root), F.lit("[REDACTED_PATH]"))
    out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z0-9_]){BEARER}", "Bearer [REDACTED]")
    out = F.regexp_replace(out, ascii_word(TOKEN_SHAPES), "[REDACTED_SECRET]")
    return F.regexp_replace(out, f"(?i){KEY_VALUES}", "$1[REDACTED]")


def cap_text(text: Column, limit: int = 100_000) -> Column:
    """A text cut to a number of characters, with a line that says how many are left out."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit("\n… "), (F.length(text) - limit).cast("string"), F.lit(" more characters truncated")))


def has_keyword(line: Column, keywords: str = KEYWORDS) -> Column:
    return line.rlike(ascii_word(f"(?i:{keywords})"))


def is_test_file(path: Column) -> Column:
    return any_match(path, TEST_FILES)


def is_secret_path(path: Column) -> Column:
    parts = F.split(path, r"[/\\]")
    base, folder = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    return base.isin(*SECRET_FILES) | any_match(base, SECRET_NAMES, "(?i)") | F.coalesce(folder.isin(*SECRET_FOLDERS), F.lit(False))


def is_footgun(command: Column) -> Column:
    return any_match(command, FOOTGUNS)


def valid_scope(scope: Column) -> Column:
    return scope.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,78}[a-z0-9])?$")


def remote_path(remote: Column) -> Column:
    """A remote's path without scheme, login, host and .git; null if nothing is left."""
    raw = trim_all(remote)
    path = F.when(raw.contains("://"), F.regexp_extract(raw, r"^[^:]+://[^/]*(/.*)?$", 1)).when(raw.rlike(r"^(?:[^@/]+@)?[^:/]+:.+$"), F.regexp_extract(raw, r"^(?:[^@/]+@)?[^:/]+:(.+)$", 1)).otherwise(raw)
    path = F.regexp_replace(F.replace(F.regexp_replace(path, r"[?#].*$", ""), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    path = F.regexp_replace(path, r"(?i)\.git$", "")
    return F.when(F.length(path) > 0, path)


def project_scope(base: Column, key: Column, digits: int = 8) -> Column:
    slug = F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-")
    return F.concat(F.when(F.length(slug) > 0, slug).otherwise("project"), F.lit("-"), F.substring(F.sha2(key, 256), 1, digits))


def collection_for(kind: Column) -> Column:
    return F.when(kind == "Decision", "decisions").when(kind == "FailureRecord", "failures").otherwise("general")


def task_scale(task: Column) -> Column:
    words = F.size(F.split(task, r"\s+"))
    return F.when((words > 50) | task.rlike(ascii_word(f"(?i:{LARGE})")), "large").when((words < 15) & task.rlike(ascii_word(f"(?i:{SMALL})")), "small").otherwise("medium")


def html_escape(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def describe_status(code: Column) -> Column:
    out = F.coalesce(F.when(F.trim(code) != "", F.trim(code)), F.lit("changed"))
    for k, label in reversed(STATUS_CODES.items()):
        out = F.when(code == k, label).otherwise(out)
    return out


def strip_json_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"/\*[\s\S]*?\*/", ""), r"(?m)(?<!:)//.*$", "")


def next_path(body: Column) -> Column:
    return F.when(body.rlike(r"→ \*\*Next path:\*\*\s*.+"), F.trim(F.regexp_extract(body, r"→ \*\*Next path:\*\*\s*(.+)", 1)))


def legacy_command(body: Column) -> Column:
    """The command that a failure's body names; null without one."""
    return F.nullif(F.regexp_extract(body, r"(?m)^\*\*Command:\*\* `(.*)`$", 1), F.lit(""))


def do_not_retry(body: Column) -> Column:
    """The advice against another try in a failure's body; null without any."""
    return F.nullif(F.trim(F.regexp_extract(body, r"(?m)^⚠️ \*\*Do NOT retry:\*\* (.+)$", 1)), F.lit(""))


def percent_text(value: Column) -> Column:
    """A share in percent with one decimal."""
    return F.concat(F.format_string("%.1f", (value * 100).cast("double")), F.lit("%"))


def signed_text(value: Column, suffix: str = "") -> Column:
    """A number with its sign, one decimal unless it is whole; zero has no sign."""
    number = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(F.format_string("%.1f", value.cast("double")))
    return F.concat(F.when(value > 0, "+").otherwise(""), number, F.lit(suffix))


def bounded_int(value: Column, low: int, high: int, fallback: int) -> Column:
    """Whole number of a string or number within bounds; blank, unreadable and non-finite values give the fallback."""
    read = value.try_cast("double")
    good = read.isNotNull() & ~F.isnan(read) & (F.abs(read) < 9e15)
    return F.when(good, F.least(F.lit(high), F.greatest(F.lit(low), F.floor(read)))).otherwise(F.lit(fallback)).cast("long")


def percent_saved(part: Column, whole: Column) -> Column:
    """Share saved in percent, halves rounded up."""
    return F.when(whole > 0, F.floor((1 - part / whole) * 100 + 0.5)).otherwise(0).cast("long")


TOKENS = r"\p{L}+|\p{Nd}{1,3}|[^\s\p{L}\p{Nd}]"


def count_tokens(text: Column) -> Column:
    """Surrogate token count: letter runs, up to three digits, other single characters."""
    return F.regexp_count(text, F.lit(TOKENS))
