import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tasselworks.llm import ledger as module
from tasselworks.llm.ledger import Ledger, keyed, ledger_sample
from tasselworks.operators.compaction import ConflictError
from tasselworks.session import Workspace

SCHEMA = "row_id long, image_path string, label string, loaded_at timestamp_ntz, key string, stratum string"
START = datetime(2024, 1, 1)


def rows_of(n, first=0, day=0, days=30):
    rng = random.Random(first)
    labels = ["Healthy", "healthy ", "common-rust", "common_rust", None]
    out = [(first + k, f"/p/{first + k // 2}.jpg", rng.choice(labels), START + timedelta(days=day + k * days // n, hours=k % 24), "k", "s") for k in range(n)]
    return out + [(first + n, None, "healthy", START, None, None), (first + n + 1, " ", "healthy", None, None, None)]


def extended(spark, path, rows, rate=0.2, **more):
    ledger = Ledger(spark, path)
    ledger.extend(spark.createDataFrame(rows, SCHEMA), rate, Workspace(spark, "t"), **more)
    return {r.key for r in ledger.load()[0].where("selected").collect()}


def test_three_sessions_keep_members_and_meet_every_quota(spark, tmp_path):
    loads = [rows_of(1500, 0, 0), rows_of(700, 10_000, 30), rows_of(900, 20_000, 60)]
    before = set()
    for n in (1, 2, 3):
        # each run opens the folder anew and is given all rows so far; earlier ones change nothing
        rows = [r for load in loads[:n] for r in load]
        now = extended(spark, f"{tmp_path}/l", rows, close=True)
        assert before < now and Ledger(spark, f"{tmp_path}/l").load()[1] == n
        before = now
        keys = keyed(spark.createDataFrame(rows, SCHEMA), "image_path", "label", "loaded_at").collect()
        per, got = Counter(k.stratum for k in keys), Counter(k.stratum for k in keys if k.key in now)
        assert set(per) == {"healthy", "common_rust", ""} and all(got[s] >= math.ceil(n * 0.2) for s, n in per.items())
        assert len(now) <= 0.24 * len(keys)
    # one run over all, and a run that is given only the new rows of each load, give the same
    assert extended(spark, f"{tmp_path}/once", [r for load in loads for r in load][::-1], close=True) == before
    for load in loads:
        apart = extended(spark, f"{tmp_path}/apart", load, close=True)
    assert apart == before
    assert extended(spark, f"{tmp_path}/l", loads[1], close=True) == before and Ledger(spark, f"{tmp_path}/l").load()[1] == 3


def test_of_two_writers_one_wins(spark, tmp_path):
    extended(spark, f"{tmp_path}/l", rows_of(100))
    ledger = Ledger(spark, f"{tmp_path}/l")
    part = ledger.load()[0].drop("version")
    ledger.append(part.limit(0), 2)
    with pytest.raises(ConflictError):
        ledger.append(part, 2)
    assert ledger.load()[0].count() == part.count()


def test_rows_of_a_path_go_together(spark, tmp_path, monkeypatch):
    from tasselworks.operators import skew

    rows = rows_of(400) + [(9000 + k, "/p/7.jpg", "healthy", START, "k", "s") for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    extended(spark, f"{tmp_path}/l", rows)
    ledger = Ledger(spark, f"{tmp_path}/l").load()[0]
    rows_per = Counter(r[1] for r in rows)
    for most in (200_000, 100):
        monkeypatch.setattr(skew, "HOT_ROWS", most)
        got = Counter(r.image_path for r in ledger_sample(df, ledger).collect())
        assert len(got) == ledger.where("selected").count() and all(n == rows_per[p] for p, n in got.items())
    with pytest.raises(ValueError):
        ledger_sample(df.withColumnRenamed("key", "selected_in"), ledger)


def test_empty_input_leaves_the_ledger_as_it_was(spark, tmp_path):
    assert extended(spark, f"{tmp_path}/l", []) == set() and Ledger(spark, f"{tmp_path}/l").load()[1] == 0
    first = extended(spark, f"{tmp_path}/l", rows_of(300))
    assert extended(spark, f"{tmp_path}/l", []) == first and Ledger(spark, f"{tmp_path}/l").load()[1] == 1


def test_fewer_loads_select_a_subset(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "LEVEL_BITS", 3)
    rows = rows_of(2500, days=40)
    before = set()
    for n in (0, 300, 1251, 1252, 2400, 2500):
        now = extended(spark, f"{tmp_path}/{n}", rows[:n], 0.1)
        assert before <= now
        before = now
    assert 125 <= len(before) <= 180
