import random

from tasselworks.llm.components import match_groups, seed_tree_components
from tasselworks.session import Workspace


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(rows):
    parent = {}
    for r in rows:
        r = [x for x in (r or []) if x is not None]
        for x in r:
            parent.setdefault(x, x)
        for x in r[1:]:
            a, b = find(parent, r[0]), find(parent, x)
            parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in parent}


def check(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "members array<string>")
    out = match_groups(df, "members", Workspace(spark, "t")).collect()
    want = brute(rows)
    assert len(out) == len(want)
    assert {r.image_path: r.group_path for r in out} == want


def test_random_chains_and_hub(spark):
    rng = random.Random(3)
    rows = [[f"/é{rng.randrange(900)}", f"/p{rng.randrange(900)}"] for _ in range(500)]
    rows += [[f"/chain/{i:04d}", f"/chain/{i + 1:04d}"] for i in range(200)]
    rows += [["/hub", f"/spoke/{i}"] for i in range(300)]
    rows += [["/a", "/a"], ["/lonely"], None, [], [None, "/x"], ["/hub", "/spoke/1"]]
    check(spark, rows)


def test_empty(spark):
    df = spark.createDataFrame([], "members array<string>")
    assert match_groups(df, "members", Workspace(spark, "t")).count() == 0


def test_hot_vertices_take_the_broadcast_path(spark, monkeypatch):
    import tasselworks.llm.components as c
    from tasselworks.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(c, "HOT_ROWS", 5)
    rows = [["/hub", f"/spoke/{i}"] for i in range(300)] + [[f"/spoke/{i}", f"/z/{i}"] for i in range(0, 300, 2)]
    check(spark, rows)


def test_self_loops_and_null_ends(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 3), (5, None)], "u long, v long")
    out = {r.vertex: r.seed for r in seed_tree_components(df, Workspace(spark, "t")).collect()}
    assert out == {1: 1, 2: 1}
