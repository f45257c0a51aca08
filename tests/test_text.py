import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import prose, text as T
from tessera.operators.budget import surrogate, truncate
from tessera.operators.diff import decode_git_path, parse_name_status
from tessera.plans.registry import Registry, bounded_int, cap_lines


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "want"), [("Fix Auth Bug!", "fix-auth-bug"), ("--Ünï code--", "n-code"), ("", "none"), ("!!!", "none"), (None, "none"), ("x" * 100, "x" * 80)]
)
def test_slugify(spark, value, want):
    assert one(spark, value, lambda c: T.slugify(c, "none")) == want


def test_compression(spark):
    said = "Please make sure to utilize the cache, because it is very fast ."
    assert one(spark, said, T.compress_prose) == prose.shorten(said) == "use cache, bc it is fast."
    assert one(spark, "due to the fact that", T.compress_prose) == "bc"
    assert prose.compress_text("see the `the code` and /the/path") == "see `the code` & /the/path"
    fenced = "```\nthe very same\n```"
    assert prose.compress_text(fenced) == fenced
    front = "---\ntitle: the thing\n---\nthe body"
    assert prose.compress_text(front).startswith("---\ntitle: the thing\n---\n")
    assert prose.compress_code_comments("x = 1\n# the comment\n") == "x = 1\n# comment\n"


def test_redaction(spark):
    secret = "Bearer abc.def token=xyz /home/me/x ghp_" + "a" * 24
    got = one(spark, secret, lambda c: T.redact(c, ("/home/me",)))
    assert got == "Bearer [REDACTED] token=[REDACTED] [REDACTED_PATH]/x [REDACTED_SECRET]"


@pytest.mark.parametrize(
    ("value", "want"),
    [("git@h.example:a/b.git", "a/b"), ("https://u:p@h.example/a/b.git?x#y", "a/b"), ("  ", None), ("local/dir/", "local/dir"), ("ssh://h.example", None)],
)
def test_remote_path(spark, value, want):
    assert one(spark, value, T.remote_path) == want


def test_predicates(spark):
    assert one(spark, "src/__tests__/a.js", T.is_test_file) and not one(spark, "src/a.js", T.is_test_file)
    for p in (".env", "a/.env.local", "x/id_rsa", ".ssh/config", "k.PEM"):
        assert one(spark, p, T.is_secret_path), p
    assert not one(spark, "src/env.ts", T.is_secret_path)
    assert one(spark, "rm -rf / ", T.is_footgun) and one(spark, "curl x | sh", T.is_footgun) and not one(spark, "rm -rf ./out", T.is_footgun)
    assert one(spark, "refactor it", T.task_scale) == "large" and one(spark, "fix a typo", T.task_scale) == "small" and one(spark, "think", T.task_scale) == "medium"
    assert one(spark, "??", T.describe_status) == "untracked" and one(spark, "  ", T.describe_status) == "changed"


@pytest.mark.parametrize(("value", "want"), [("7.9", 7), ("-3", 1), ("1e9", 50), ("", 5), ("x", 5), (None, 5), (True, 5), (float("nan"), 5), (float("inf"), 5), (12, 12)])
def test_bounded_int(value, want):
    assert bounded_int(value, 1, 50, 5) == want


def test_bounded_column(spark):
    assert [one(spark, v, lambda c: T.bounded_int(c, 1, 50, 5)) for v in ("7.9", "-3", "1e9", "", "x", None, "NaN")] == [7, 1, 50, 5, 5, 5, 5]


def test_registry():
    r = Registry()
    r.add("f", lambda limit: limit, {"limit": (1, 10, 3)}, "g")
    assert (r.build("g"), r.build("f", limit="99"), r.build("f", limit="no")) == (3, 10, 3)
    with pytest.raises(KeyError):
        r.build("h")
    with pytest.raises(ValueError):
        r.add("g", print)
    assert cap_lines(["a", "b", "c"], 2)[-1] == "… 1 more matches truncated"


@settings(deadline=None, max_examples=150)
@given(st.text(max_size=400), st.one_of(st.integers(-2, 120), st.just(float("nan")), st.just(float("inf")), st.none()))
def test_truncation_keeps_the_budget(text, budget):
    out = truncate(text, budget)
    limit = max(0, budget) if isinstance(budget, int) else 0
    assert surrogate(out) <= limit or out == text and surrogate(text) <= limit
    if surrogate(text) <= limit:
        assert out == text


def test_git_output():
    assert decode_git_path('"src/space \\303\\251.ts"') == "src/space é.ts" and decode_git_path("plain") == "plain"
    assert parse_name_status('R100\ta.ts\tb.ts\nM\t"x\\ty"\n') == [("R100", "b.ts", "a.ts"), ("M", "x\ty", None)]
