import random

import pytest

from tessera.operators.hierarchy import contract, descendants, resolve_hierarchy


def brute(links):
    known = dict(links)
    out = {}
    for n in known:
        path, at = [], n
        while at not in path and known.get(at) in known:
            path.append(at)
            at = known[at]
        if at in path:
            out[n] = (min(path[path.index(at) :]), -1, None)
        else:
            path.append(at)
            out[n] = (at, len(path) - 1, path[::-1])
    return out


def resolved(spark, links, paths=True, last=20_000):
    df = spark.createDataFrame(links, "node string, parent string")
    return {r["node_id"]: (r["root_id"], r["depth"], r["path"] if paths else None) for r in resolve_hierarchy(df, "node", "parent", paths, last).collect()}


@pytest.mark.parametrize("last", [0, 40, 20_000])
def test_trees_chains_and_cycles(spark, last):
    links = [(f"c{k:03d}", f"c{k - 1:03d}" if k else None) for k in range(60)]  # a chain
    links += [(f"w{k}", "c030") for k in range(40)]  # a wide family on it
    links += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y1", "x2"), ("y2", "y1"), ("self", "self"), ("below", "self"), ("two_a", "two_b"), ("two_b", "two_a")]
    links += [("lost", "nothing"), ("empty", ""), ("lone", None)]
    assert resolved(spark, links, last=last) == brute(links)


@pytest.mark.parametrize("last", [0, 30, 20_000])
def test_random_forest(spark, last):
    rng = random.Random(2)
    names = [f"n{k}" for k in range(120)]
    links = [(n, rng.choice([*names, None, "gone"])) for n in names]
    want = brute(links)
    assert resolved(spark, links, False, last) == {n: (r, d, None) for n, (r, d, _) in want.items()}


def test_descendants(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "a")]
    df = resolve_hierarchy(spark.createDataFrame(links, "node string, parent string"), "node", "parent", True)
    assert {tuple(r) for r in descendants(df).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}


def test_odd_tables(spark):
    assert resolved(spark, []) == {} == resolved(spark, [], last=0)
    # repeated rows, null nodes, several parents, clashing column names
    df = spark.createDataFrame([("a", None, 1, "x"), ("a", "b", 1, "x"), ("b", None, 2, "y"), (None, "a", 3, "z"), ("a", "b", 1, "x")], "node string, parent string, depth int, root_id string")
    assert {tuple(r) for r in resolve_hierarchy(df, "node", "parent").collect()} == {("a", "b", 1), ("b", "b", 0)}


def test_one_task_contracts_like_the_rounds():
    rng = random.Random(8)
    for size in (1, 2, 3, 10, 60):
        for _ in range(60):
            names = [f"n{k}" for k in range(size)]
            links = [(n, rng.choice([*names, None])) for n in names]
            got = contract([(n, p, 1, n, []) for n, p in links])
            assert {n: (r, d, p) for n, r, d, p in got} == brute(links)
