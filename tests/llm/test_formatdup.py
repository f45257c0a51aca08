import random
import re

from tessera.llm.formatdup import collapse_formatting

DASHES = "-‐‑‒–—―−"
DASH = re.escape(DASHES)


def canonical(command):
    words = [re.sub(rf"^[^\w{DASH}]+|^_+", "", w) for w in command.lower().split() if re.search(r"[^\W_]", w)]
    plain = lambda s: " ".join(re.findall(r"[^\W_]+", s))
    settings, k = [], 0
    while k < len(words) and re.match(r"[^\W\d]\w*=", words[k]):
        settings.append(plain(words[k]))
        k += 1
    options, others = [], []
    while k < len(words):
        w = words[k]
        if w[0] in DASHES:
            if "=" not in w and k + 1 < len(words) and words[k + 1][0] not in DASHES:
                w += " " + words[k + 1]
                k += 1
            options.append(plain(w))
        else:
            others.append(plain(w))
        k += 1
    return tuple(sorted(settings)), tuple(others), tuple(sorted(options))


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        env = [f"{n}={v}" for n, v in rng.sample([("CI", "1"), ("TZ", "utc"), ("LOG_LEVEL", "debug")], rng.randint(0, 2))]
        opts = rng.sample(["--brief", "--unified=3", "--unified 3", "-x", "--scope a", "—tb=short"], rng.randint(0, 3))
        words = [rng.choice(["diff", "make"]), rng.choice(["a/b_c.json", "a\\b_c.json"]), rng.choice(["out", "'out'"])]
        sep = rng.choice([" ", "  ", "\t", " \\\n  ", "\u00a0"])
        c = sep.join([*env, *words, *opts])
        c = rng.choice([str, str.upper, str.title])(c)
        rows.append((k, rng.choice(["", "$ ", "`", " "]) + c + rng.choice(["", " ;", ".", " &", "\r\n"])))
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, ""), (904, "***"), (905, "--")]
    df = spark.createDataFrame(rows, "failure_id long, command string")
    got = {(r["rep_id"], r["n_copies"]) for r in collapse_formatting(df, "failure_id", "command").collect()}
    groups = {}
    for i, c in rows:
        if c is not None:
            groups.setdefault(canonical(c), []).append(i)
    assert got == {(min(v), len(v)) for v in groups.values()}


def test_near_misses_stay_apart(spark):
    rows = [(1, "cp a dist/m"), (2, "cp a dist/m2"), (3, "cp dist/m a"), (4, "cp a -r x dist"), (5, "cp a dist -r x"), (6, "A=1 B=2 run"), (7, "B=2 A=1 RUN"), (8, "run A=1 B=2"), (9, "run B=2 A=1")]
    df = spark.createDataFrame(rows, "rec long, command string").selectExpr("rec", "command", "1 as n", "'x' as raw")
    assert {(r["rep_id"], r["n_copies"]) for r in collapse_formatting(df, "rec", "command").collect()} == {(1, 1), (2, 1), (3, 1), (4, 2), (6, 2), (8, 1), (9, 1)}
    assert collapse_formatting(df.where("false"), "rec", "command").count() == 0
