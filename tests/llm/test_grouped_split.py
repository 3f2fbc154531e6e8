import random
from collections import Counter, defaultdict

import pytest

from tasselworks.llm.grouped_split import contract, grouped_split
from tasselworks.session import Workspace

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
SCHEMA = "row_id long, image_path string, contributor string, split string"


def brute(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None:
            continue
        if a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
            parent[find(a)] = find(b)
    return {x: find(x) for x in parent}


def partition(labels):
    groups = defaultdict(set)
    for v, c in labels.items():
        groups[c].add(v)
    return {frozenset(g) for g in groups.values()}


def test_contract_against_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 90)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.vertex: r.component for r in contract(df, Workspace(spark, "t"), 1).collect()}
    assert partition(got) == partition(brute(edges))
    assert contract(df.limit(0), Workspace(spark, "t"), 1).count() == 0


def make(rng, n):
    rows = []
    for k in range(n):
        c = rng.randrange(120) if rng.random() > 0.1 else 0
        plot = f"plot_{c}-{rng.randrange(3)}/" if rng.random() < 0.5 else ""
        path = rng.choice([f"clean/x/real/{plot}{k}.jpg"] * 9 + [f"./clean/x/real/{rng.randrange(60)}.jpg", None])
        rows.append((k, path, rng.choice([f"ctr-{c}"] * 9 + [None, " "]), "old"))
    return rows


def test_related_rows_stay_together(spark):
    rows = make(random.Random(1), 3000)
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA)
    out = grouped_split(df, Workspace(spark, "t"), SHARES).collect()
    assert Counter(r.row_id for r in out) == Counter(r[0] for r in rows)
    split = {r.row_id: r.split for r in out}
    seen = {}
    for i, path, who, _ in rows:
        keys = [("c", who)] if who and who.strip() else []
        if path:
            keys += [("x", path.replace("./", ""))] + [("p", s) for s in path.split("/") if s.startswith("plot_")]
        for key in keys:
            assert seen.setdefault(key, split[i]) == split[i], key
    again = grouped_split(df.repartition(7), Workspace(spark, "t"), SHARES).collect()
    assert {r.row_id: r.split for r in again} == split


def test_shares_and_edges(spark):
    rows = [(k, f"clean/x/{k}.jpg", f"ctr-{k // 4}", None) for k in range(4000)] + [(5000 + k, None, None, None) for k in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    n = Counter(r.split for r in grouped_split(df, Workspace(spark, "t"), SHARES).collect())
    assert all(abs(n[s] / 4010 - share) < 0.002 for s, share in SHARES.items())
    assert grouped_split(df.limit(0), Workspace(spark, "t"), SHARES).count() == 0
    with pytest.raises(ValueError):
        grouped_split(df, Workspace(spark, "t"), {"a": 0.5})
