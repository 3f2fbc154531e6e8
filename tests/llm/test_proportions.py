import random
from collections import Counter

from tasselworks.llm import proportions
from tasselworks.llm.proportions import allocate, proportional_sample
from tasselworks.session import Workspace

ROWS = "row_id long, label string, environment string, code string, rank int"
TARGETS = "label string, environment string, target_share double, min_rows long"


def test_allocate():
    assert allocate([0.5, 0.5], [0, 0], [100, 100], 50) == [25, 25]
    assert allocate([0.5, 0.5], [0, 0], [10, 100], 50) == [10, 40]
    got = allocate([0.9, 0.1], [0, 10], [100, 100], 50)
    assert abs(sum(got) - 50) < 1e-6 and got[1] == 10
    assert allocate([0.5, 0.5], [3, 3], [1, 2], 50) == [1, 2]
    assert allocate([], [], [], 0) == []


def run(spark, rows, targets):
    t = spark.createDataFrame(targets, TARGETS)
    sample, report = proportional_sample(spark.createDataFrame(rows, ROWS).repartition(3), t, Workspace(spark, "t"))
    return sample.collect(), {(r.label, r.environment): r for r in report.collect()}


def test_shares_floors_and_report(spark, monkeypatch):
    monkeypatch.setattr(proportions, "BLOCK_ROWS", 300)
    rng = random.Random(9)
    spell = {"healthy": ["healthy", " Healthy ", "HEALTHY"], "common_rust": ["common_rust", "Common Rust", "common-rust"], "blight": ["blight"]}
    rows = []
    for k in range(4000):
        lab = rng.choices(list(spell), [80, 15, 5])[0]
        rows.append((k, rng.choice(spell[lab]), rng.choice(["real", "REAL "]), "x", 1))
    rows += [(5000, None, "real", None, None), (5001, "healthy", None, None, None), (5002, "otros", "real", None, None)]
    targets = [("healthy", "real", 0.3, 20), ("common_rust", "real", 0.2, 20), ("blight", "real", 0.48, 10), ("absent", "lab", 0.02, 5)]
    sample, report = run(spark, rows, targets)
    n = Counter((r.label, r.environment) for r in sample)
    assert len({r.row_id for r in sample}) == len(sample)
    assert abs(len(sample) - len(rows) / 5) <= 1
    assert {k for k, r in report.items() if r.impossible} == {("blight", "real"), ("absent", "lab")}
    assert n["blight", "real"] == report["blight", "real"].available
    for key, r in report.items():
        assert r.selected == n[key] and abs(r.selected - r.planned) < 1
    again, _ = run(spark, rows[::-1], targets)
    assert {r.row_id for r in again} == {r.row_id for r in sample}


def test_floor_wins_over_share(spark):
    rows = [(k, "a" if k < 990 else "b", "lab", None, None) for k in range(1000)]
    sample, report = run(spark, rows, [("a", "lab", 1.0, 1), ("b", "lab", 0.0, 8)])
    assert Counter(r.label for r in sample) == {"a": 192, "b": 8}
    assert not any(r.impossible for r in report.values())


def test_empty(spark):
    assert run(spark, [], [("a", "lab", 1.0, 1)])[0] == []
    assert run(spark, [(1, "a", "lab", None, None)], []) == ([], {})
