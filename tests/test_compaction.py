import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tasselworks.operators.compaction import ConflictError, VersionedTable, compact
from tasselworks.session import Workspace

COLUMNS = ("id", "note", "part")


def write_many(spark, path, parts, columns=("part",)):
    data = [(k, f"{part}-{k}", *(part if isinstance(part, tuple) else (part,))) for part, n in parts.items() for k in range(n)]
    df = spark.createDataFrame(data * 2, "id long, note string, " + ", ".join(f"{c} string" for c in columns))
    df.repartitionById(max(parts.values()), F.col("id").cast("int")).write.mode("append").partitionBy(*columns).parquet(path)


def rows(table, columns=COLUMNS):
    return Counter(tuple(r) for r in table.read().select(*columns).collect())


def live(table):
    got = table.files(Workspace(table.spark, "t")).where("live").groupBy("directory").count().collect()
    return {r["directory"]: r["count"] for r in got}


def test_only_crowded_partitions_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/a b/t"
    write_many(spark, path, {"a b/ü+%": 7, None: 6, "calm": 2})
    table = VersionedTable(spark, path)
    want = rows(table)
    assert sum(want.values()) == 30 and {k[2] for k in want} == {"a b/ü+%", None, "calm"}
    calm = sorted(os.listdir(f"{path}/part=calm"))
    info = compact(table, sort=("id",))
    assert rows(table) == want and sorted(live(table).values()) == [1, 1, 2] and sorted(os.listdir(f"{path}/part=calm")) == calm
    assert info["version"] == 1 and sum(r["files_before"] for r in info["rewritten"]) == 13
    assert compact(table) == table.manifest(1)
    write_many(spark, path, {"a b/ü+%": 5})
    want = rows(table)
    assert compact(table)["version"] == 2 and rows(table) == want and sum(want.values()) == 40
    assert sorted(live(table).values()) == [1, 1, 2]


@pytest.mark.parametrize("hook", ["before_check", "before_publish"])
def test_a_late_append_is_kept(spark, tmp_path, hook):
    path = f"{tmp_path}/t"
    write_many(spark, path, {"a": 6})
    table = VersionedTable(spark, path)
    late = spark.createDataFrame([(n, "late", "a") for n in range(100)], "id long, note string, part string")
    compact(table, **{hook: lambda: late.coalesce(1).write.mode("append").partitionBy("part").parquet(path)})
    assert table.version() == 1 and sum(rows(table).values()) == 112 and live(table) == {"part=a": 2}


def test_a_changed_source_is_a_conflict(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_many(spark, path, {"a": 6})
    table = VersionedTable(spark, path)
    victim = next(f for f in os.listdir(f"{path}/part=a") if f.endswith(".parquet"))
    with pytest.raises(ConflictError):
        compact(table, before_check=lambda: os.remove(f"{path}/part=a/{victim}"))
    assert table.version() == 0 and sum(rows(table).values()) == 10 and os.listdir(f"{path}/_compacted") == []


def test_of_two_writers_one_wins(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_many(spark, path, {"a": 6})
    table = VersionedTable(spark, path)
    for hook in ("before_check", "before_publish"):
        with pytest.raises(ConflictError):
            compact(table, **{hook: lambda: compact(VersionedTable(spark, path))})
        assert sum(rows(table).values()) in (12, 24)
        write_many(spark, path, {"a": 6})
    assert table.version() == 2


def test_a_dead_writer_blocks_nobody(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_many(spark, path, {"a": 6})
    table = VersionedTable(spark, path)

    class Died(BaseException):
        pass

    def die():
        raise Died

    for hook in ("before_check", "before_publish"):
        with pytest.raises(Died):
            compact(table, **{hook: die})
    assert sum(rows(table).values()) == 12 and len([d for d in os.listdir(f"{path}/_compacted")]) == 2
    assert compact(table)["version"] == 1 and sum(rows(table).values()) == 12
    assert table.vacuum(orphans_older_than=-1) == 6
    assert len([d for d in os.listdir(f"{path}/_compacted")]) == 1 and not [f for f in os.listdir(f"{path}/part=a") if f.endswith(".parquet")]
    assert sum(rows(table).values()) == 12 and table.version() == 2 and table.vacuum() == 0


def test_two_partition_levels(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_many(spark, path, {("2024", "01"): 6, ("2024", "02"): 2, ("2025", None): 5}, ("y", "m"))
    table = VersionedTable(spark, path)
    columns = ("id", "note", "y", "m")
    want = rows(table, columns)
    assert {d["directory"] for d in compact(table)["rewritten"]} == {"y=2024/m=01", "y=2025/m=__HIVE_DEFAULT_PARTITION__"}
    assert rows(table, columns) == want and sum(want.values()) == 26 and live(table)["y=2024/m=02"] == 2


def test_new_files_are_even(spark, tmp_path):
    path = f"{tmp_path}/t"
    rng = [(k, os.urandom(40).hex(), "a") for k in range(16_000)]
    spark.createDataFrame(rng, "id long, note string, part string").repartition(200).write.partitionBy("part").parquet(path)
    table = VersionedTable(spark, path)
    total = table.files(Workspace(spark, "t")).agg(F.sum("bytes")).first()[0]
    info = compact(table, target_bytes=total // 16)
    n = info["rewritten"][0]["files_after"]
    per = [r["count"] for r in table.read().groupBy(F.input_file_name()).count().collect()]
    assert len(per) == n == 17 and sum(per) == 16_000 and max(per) < 1.2 * 16_000 / n and min(per) > 0.8 * 16_000 / n


def test_flat_tables_large_files_and_differing_columns(spark, tmp_path):
    path = f"{tmp_path}/t"
    for k in range(5):
        spark.createDataFrame([(k, "x")], "id long, note string").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(9, 2.5)], "id long, extra double").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(100 + k, os.urandom(200).hex()) for k in range(500)], "id long, note string").coalesce(1).write.mode("append").parquet(path)
    table = VersionedTable(spark, path)
    want = rows(table, ("id", "note", "extra"))
    info = compact(table, small_bytes=50_000)
    assert info["rewritten"][0]["files_before"] == 6 and rows(table, ("id", "note", "extra")) == want and live(table) == {"": 2}


def test_empty_tables_and_clashes(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/nothing")
    assert compact(table)["version"] == 0 and table.read().count() == 0
    schema = spark.createDataFrame([], "id long, part string").schema
    assert table.read(schema).columns == ["id", "part"]
    path = f"{tmp_path}/t"
    for k in range(6):
        spark.createDataFrame([(k, "inside")], "id long, part string").coalesce(1).write.mode("append").parquet(f"{path}/part=x")
    with pytest.raises(ValueError):
        compact(VersionedTable(spark, path))
