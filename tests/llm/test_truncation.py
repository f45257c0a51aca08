import random

import numpy as np

from tessera.llm import truncation as X


def test_censored_fit():
    rng = np.random.default_rng(1)
    full = np.exp(rng.normal(6, 0.7, 20_000)).astype(int) + 1
    cut = np.minimum(full, 600)
    n, c = np.unique(cut, return_counts=True)
    seen, lost = np.where(n < 600, c, 0).astype(float), np.where(n == 600, c, 0).astype(float)
    mu, sigma = X._fit(np.log(n), seen, lost)
    assert abs(mu - 6) < 0.05 and abs(sigma - 0.7) < 0.05


def documents(rng, count):
    nouns = ["cache", "graph", "token", "index", "merger", "window"]
    rows = []
    for k in range(count):
        parts = []
        while sum(map(len, parts)) < rng.choice([100, 300, 600, 900]):
            parts.append(rng.choice([f"The {rng.choice(nouns)} keeps a copy of the {rng.choice(nouns)} until it is rebuilt. ", f"\n\n- drop the stale {rng.choice(nouns)}\n- add a test for {rng.choice(nouns)}\n\n"]))
        text = "".join(parts).strip() + rng.choice(["", f"\n\n- drop the old {rng.choice(nouns)}", "\n\nStatus: resolved", "\n\nSee also: src/a.py", "\n\n```\nx = 1\n```"])
        rows.append([k, text, "log", False])
    return rows


def test_finds_the_cut_ones(spark):
    rng = random.Random(5)
    rows = documents(rng, 1500)
    whole = X._END
    for r in rows[:1000]:
        if len(r[1]) > 400:
            cut = r[1][:400]
            line = cut.split("\n")[-1]
            r[1], r[3] = cut, not whole.search(cut.rstrip()) and not any(line.strip().endswith(w) for w in ("cache", "graph", "token", "index", "merger", "window", "resolved", ".py", "```", ""))
    df = spark.createDataFrame([tuple(r[:3]) for r in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in X.truncated_texts(df, "doc_id", "text", "source").collect()}
    assert len(got) == 1500
    assert all(got[r[0]]["truncated"] for r in rows if r[3])
    assert sum(got[r[0]]["truncated"] for r in rows[1000:]) == 0
    assert {r["n"] for r in got.values() if r["posterior"] > 0} == {400}
    rate = X.truncation_rates(X.truncated_texts(df, "doc_id", "text", "source")).first()
    assert rate["n_texts"] == 1500 and rate["n_truncated"] >= sum(r[3] for r in rows) and 0 < rate["expected_censored"] <= rate["n_at_limits"]


def test_limit_decides_where_a_line_looks_whole(spark):
    rng = random.Random(3)
    nouns = ["cache", "graph", "token", "index", "merger", "window"]
    line = lambda: f"- the {rng.choice(nouns)} the {rng.choice(nouns)} the {rng.choice(nouns)} the {rng.choice(nouns)} the {rng.choice(nouns)}"
    texts = ["\n".join(line() for _ in range(rng.randrange(3, 12))) for _ in range(8000)]
    inside = {k for k, t in enumerate(texts) if t[400:401] == " " and t[:400].endswith(tuple(nouns))}
    df = spark.createDataFrame([(k, t[:400], "log") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in X.truncated_texts(df, "doc_id", "text", "source").collect()}
    assert len(inside) >= 20 and all(got[k]["ending"] == "list" and got[k]["posterior"] > 0.9 and got[k]["truncated"] for k in inside)
    assert not [r for r in got.values() if r["truncated"] and r["n"] < 400 and r["posterior"] == 0]


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "whole.", None), (4, "cut in the mid", None), (4, "cut in the mid", None), (5, "x" * 300_000, "a"), (6, "lost ch�", "a")]
    df = spark.createDataFrame(rows, "k long, t string, s string").selectExpr("*", "1 as n", "'e' as ending")
    got = [(r["doc_id"], r["source"], r["truncated"]) for r in X.truncated_texts(df, "k", "t", "s").collect()]
    assert sorted(got, key=repr) == sorted([(2, None, False), (3, None, False), (4, None, True), (4, None, True), (5, "a", True), (6, "a", True)], key=repr)
    assert X.truncated_texts(df.where("false"), "k", "t", "s").count() == 0


def test_odds_come_from_counts():
    """A tenth of the texts is cut; whole ones end on sentences and known list words, cuts mostly inside prose."""
    cuts = {"prose/": 700, "list/other": 150, "list/word": 50, "sentence/": 100}
    whole = {"prose/": 0, "list/other": 0, "list/word": 3000, "sentence/": 6000}
    odds = X.Odds({e: (whole[e] + cuts[e], cuts[e]) for e in cuts})
    assert 0.08 < odds.share < 0.12
    assert odds.of("prose", "") + odds.prior > 3 and odds.of("list", "other") + odds.prior > 2
    assert odds.of("list", "word") + odds.prior < -2
    assert odds.of("sentence", "") == -9 and odds.of("mark", "") == 9 and odds.of("never", "seen") == 0
    assert X.Odds({}).share == 0.01


def test_the_posterior_turns_a_verdict_over(spark):
    """The same ending is whole where it stands and cut at the limit of its source."""
    rng = random.Random(6)
    nouns = ["cache", "graph", "token", "index", "merger", "window"]
    line = lambda: f"- the {rng.choice(nouns)} the {rng.choice(nouns)} the {rng.choice(nouns)} the {rng.choice(nouns)} the {rng.choice(nouns)}"
    texts = ["\n".join(line() for _ in range(rng.randrange(3, 12))) for _ in range(6000)]
    df = spark.createDataFrame([(k, t[:400], "log") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = X.truncated_texts(df, "doc_id", "text", "source").where("alone <> truncated").collect()
    assert len(got) >= 10 and all(r["truncated"] and not r["alone"] and r["n"] == 400 and r["posterior"] > 0.9 for r in got)
