import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tasselworks.functions.constants import CLASSES, resolve_classes
from tasselworks.functions.paths import category, number_in_name, plain_path, plot_folder, source_in_name
from tasselworks.operators import dedup, evaluate, labels, moves, sampling, stats
from tasselworks.operators.prefix import global_row_number, rank_in_group, running_sum
from tasselworks.operators import skew
from tasselworks.operators.skew import hot_join, hot_keys, salted_join
from tasselworks.session import Workspace


def ws(spark):
    return Workspace(spark, "t")


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, k) for k in range(4900, 5000)] + [(3, 3)]
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dedup.components(spark.createDataFrame(edges, "a long, b long"), ws(spark))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in parent}
    assert dedup.components(spark.createDataFrame([], "a long, b long"), ws(spark)).count() == 0


def test_band_join_is_brute_force(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(32) for _ in range(30)]
    rows = [(k, rng.choice(base) ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)), k % 2) for k in range(200)] + [(900, None, 0)]
    df = spark.createDataFrame(rows, "k long, h long, c int")
    for t in (0, 2, 3):
        got = [(r.a, r.b, r.distance) for r in dedup.hamming_pairs(df, "k", "h", 32, t).collect()]
        want = {(a[0], b[0], (a[1] ^ b[1]).bit_count()) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and (a[1] ^ b[1]).bit_count() <= t}
        assert set(got) == want and len(got) == len(want)


def test_exact_dedup(spark):
    df = spark.createDataFrame([(3, "x", "a"), (1, "x", "b"), (2, "y", "a"), (4, None, "a"), (5, "y", "a")], "id long, body string, folder string")
    assert sorted(r.id for r in dedup.keep_first(df, F.col("body"), ["id"]).collect()) == [1, 2]
    assert sorted(r.id for r in dedup.keep_first(df, F.col("body"), ["id"], ["folder"]).collect()) == [1, 2, 3]
    assert dedup.dedup_counters(df, F.col("body")).first() == (5, 1, 2, 2)
    assert dedup.dedup_counters(df.limit(0), F.col("body")).first() == (0, 0, 0, 0)


def test_split_properties(spark):
    rng = random.Random(1)
    rows = [(k, rng.choices("abc", [70, 25, 5])[0], rng.choice(["lab", "real"])) for k in range(1001)]
    df = spark.createDataFrame(rows, "id long, label string, environment string")
    out = sampling.stratified_split(df, ["label", "environment"], "id").collect()
    n = Counter(r.split for r in out)
    assert (n["train"], n["test"], n["val"]) == (700, 151, 150) and len({r.id for r in out}) == 1001
    strata = Counter((r.label, r.environment) for r in out)
    for s, total in strata.items():
        got = sum(r.split == "train" for r in out if (r.label, r.environment) == s)
        assert abs(got - total * 700 / 1001) < 1
    again = sampling.stratified_split(df.repartition(7), ["label", "environment"], "id").collect()
    assert {(r.id, r.split) for r in again} == {(r.id, r.split) for r in out}
    with pytest.raises(ValueError):
        sampling.stratified_split(df.unionByName(spark.createDataFrame([(9999, "rare", "lab")], df.schema)), ["label", "environment"], "id")


def test_published_split_size(spark):
    rows = [(k, f"c{k % 4}", "real") for k in range(2000)]
    n = Counter(r.split for r in sampling.stratified_split(spark.createDataFrame(rows, "id long, label string, environment string"), ["label", "environment"], "id").collect())
    assert n == {"train": 1400, "val": 300, "test": 300}


def test_cap(spark):
    rows = [(k, "a" if k < 50 else "b") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, label string")
    out = sampling.cap_per_group(df, ["label"], "id", 20)
    assert Counter(r.label for r in out.collect()) == {"a": 20, "b": 10}
    assert sampling.cap_per_group(out, ["label"], "id", 20).count() == 30
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_next_valid(spark):
    rows = [(k, k in (3, 4, 9), f"v{k}") for k in range(12)]
    df = spark.createDataFrame(rows, "k long, ok boolean, v string")
    got = {r.k: r.v for r in sampling.next_valid(df, "k", F.col("ok"), ["v"], ws(spark)).collect()}
    assert got == {0: "v3", 1: "v3", 2: "v3", 3: "v3", 4: "v4", 5: "v9", 6: "v9", 7: "v9", 8: "v9", 9: "v9", 10: "v3", 11: "v3"}
    none = sampling.next_valid(df.withColumn("ok", F.lit(False)), "k", F.col("ok"), ["v"], ws(spark)).collect()
    assert len(none) == 12 and all(r.v is None for r in none)


def test_unique_suffixes(spark):
    df = spark.createDataFrame([(k,) for k in range(60)], "k long")
    used = spark.createDataFrame([(k,) for k in range(10, 35)], "n long")
    out = sampling.unique_suffixes(df, "k", used, "n", ws(spark), digits=2).collect()
    assert len(out) == 60 and len({r.suffix for r in out}) == 60 and all(35 <= r.suffix <= 99 for r in out)
    with pytest.raises(RuntimeError):
        sampling.unique_suffixes(df, "k", used.union(df.where("k >= 35 AND k < 50")), "n", ws(spark), digits=2)


def test_prefix_helpers(spark):
    rows = [(k, f"{k * 2654435761 % 2**32:08x}", "g" if k % 5 else "h") for k in range(500)]
    df = spark.createDataFrame(rows, "k long, o string, g string").repartition(6)
    got = {r.k: r.n for r in rank_in_group(df, ["g"], "o", ["k"], "n").collect()}
    for g in "gh":
        for n, r in enumerate(sorted((r for r in rows if r[2] == g), key=lambda r: r[1]), 1):
            assert got[r[0]] == n
    num = {r.k: r.n for r in global_row_number(df, ["o", "k"], "n", ws(spark)).collect()}
    assert num == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: r[1]), 1)}
    run = running_sum(df.withColumn("b", (F.col("k") / 100).cast("int")), "b", ["k"], "k", "s")
    assert {r.k: r.s for r in run.collect()} == {k: k * (k + 1) // 2 for k in range(500)}


def test_skew_joins(spark, monkeypatch):
    many = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(900)] + [(None, -1)], "key long, v long")
    one = spark.createDataFrame([(k, f"x{k}") for k in range(0, 900, 2)] + [(1, "x1")], "key long, name string")
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    counted = many.groupBy("key").agg(F.count("*").alias("n"))
    hot = hot_keys(counted, "key", "n")
    assert [r.key for r in hot.collect()] == [1] and hot_keys(counted, "key", "n", 10) is None and hot_keys(counted.where("n < 9"), "key", "n") is None
    for how in ("inner", "left"):
        want = Counter(map(tuple, many.join(one, "key", how).collect()))
        assert Counter(map(tuple, hot_join(many, one, "key", hot, how).collect())) == want
        assert Counter(map(tuple, salted_join(many, one, "key", 4, F.xxhash64("v"), how).select("key", "v", "name").collect())) == want


def test_labels(spark):
    df = spark.createDataFrame([(1, "5 .1 .1 .2 .2\r\n2 .1 .1 .2 .2\n2 .3 .3 .1 .1 .2 .2"), (2, "5 a\n2 b"), (3, "x y\n1 z"), (4, ""), (5, None), (6, "9 q\n\n")], "id long, body string")
    lines = labels.annotation_lines(df, "body", ["id"])
    assert [r.kind for r in lines.where("id = 1").orderBy("pos").collect()] == ["box", "box", "polygon"]
    assert {r.id: r.class_id for r in labels.dominant_class(lines, "id").collect()} == {1: 2, 2: 5, 3: 1, 6: 9}
    flags = spark.createDataFrame([("1", "0"), (" 1 ", "1"), ("0", None), (None, "1")], "GLS string, CR string")
    n, dest = labels.onehot_route({"GLS": F.col("GLS"), "CR": F.col("CR")})
    assert [r[0] for r in flags.select(dest).collect()] == ["GLS", "multi_label", "no_label", "CR"]
    l = spark.createDataFrame([("healthy",), ("common_rust",), (None,), ("odd",)], "label string")
    assert [tuple(r) for r in labels.class_index(l, "label").orderBy("index").collect()] == [("common_rust", 0), ("healthy", 1)]
    with pytest.raises(ValueError, match="odd"):
        labels.check_labels(l, "label")
    labels.check_labels(l.where("label = 'healthy'"), "label")
    assert labels.exclude(l, "label", ["odd"]).count() == 3
    assert resolve_classes([], ["healthy"]) == ("healthy",) and resolve_classes() == CLASSES


def test_evaluation_small_case(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 0)], "t int, p int")
    assert evaluate.accuracy(df, "t", "p").first().accuracy == 0.5
    assert evaluate.macro_f1(df, "t", "p").first().macro_f1 == 0.4
    assert {r.name: r.support for r in evaluate.report(df, "t", "p").collect()}["macro avg"] == 6


def test_plans(spark):
    rows = spark.createDataFrame([("a/x.jpg", "d/x.jpg"), ("b/x.jpg", "d/x.jpg"), ("a/y.jpg", "d/y.jpg"), ("a/z.jpg", "d/z.jpg"), ("a/gone.jpg", "d/g.jpg"), ("a/noext", "d/noext"), ("a/.jpg", "d/.jpg")], "src string, dst string")
    existing = spark.createDataFrame([("d/y.jpg",)], "dst string")
    there = rows.where("src <> 'a/gone.jpg'")
    got = {r.src: r.status for r in moves.plan(rows, "move", existing, there).collect()}
    assert got == {"a/x.jpg": "collision", "b/x.jpg": "collision", "a/y.jpg": "exists", "a/z.jpg": "planned", "a/gone.jpg": "missing", "a/noext": "no_extension", "a/.jpg": "no_extension"}
    assert moves.collisions(rows).first().n_sources == 2


def test_stats_edges(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", None)], "g string, x double")
    assert [(r.bin, r.n) for r in stats.histogram(df, "x").collect()] == [(1, 2)]
    assert stats.histogram(df.limit(0), "x").count() == 0
    d = stats.describe(df, ["x"]).first()
    assert (d.n, d["mean"], d["std"]) == (2, 5.0, 0.0)
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1280,), (1024**4 * 5000,)], "n long").select(stats.human_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "5000.0 TB"]
    zero = spark.createDataFrame([(0, 0)], "a int, b int").select(stats.ratio(F.col("a"), F.col("b"), 1)).first()[0]
    assert zero is None


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(40)) if rng.random() < 0.9 else None) for _ in range(700)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: tuple(r)[1:] for r in stats.exact_quantiles(df, ["g"], "x", {"q1": 0.25, "m": 0.5, "p99": 0.99}, ws(spark)).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([x for k, x in rows if k == g and x is not None], [0.25, 0.5, 0.99]))
    assert stats.exact_quantiles(df.limit(0), ["g"], "x", {"m": 0.5}, ws(spark)).count() == 0


def test_paths(spark):
    p = "file:///srv/x/clean/healthy/real/plot%5F7-8/Healthy%5FMaize-Field  real 00012345678 (1).JPG?rev=3"
    c = F.lit(p)
    r = spark.range(1).select(source_in_name(c), number_in_name(c), plot_folder(c), category(F.lit(" Common-Rust  ")), plain_path(F.lit(".\\clean\\\\a\\b.jpg"))).first()
    assert tuple(r) == ("maize_field", 12345678, "plot_7-8", "common_rust", "clean/a/b.jpg")
    bad = F.lit("100%zz/maize_field.jpg")
    assert tuple(spark.range(1).select(source_in_name(bad), number_in_name(bad), source_in_name(F.lit(None).cast("string"))).first()) == ("maize_field", None, None)
