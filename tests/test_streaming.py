from datetime import datetime, timedelta

from tasselworks.streaming import incremental


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "k string, ts timestamp_ntz"

    def load(rows):
        spark.createDataFrame([(k, t0 + timedelta(minutes=m)) for k, m in rows], schema).write.mode("append").parquet(f"{tmp_path}/in")

    load([("a", 0), ("b", 1), ("a", 2)])
    schema_ = spark.read.parquet(f"{tmp_path}/in").schema

    def run():
        s = incremental.stream_table(spark, f"{tmp_path}/in", schema_, max_files=1)
        incremental.run_available(incremental.incremental_manifest(s, "k", "ts", "2 hours"), f"{tmp_path}/out", f"{tmp_path}/ck")
        return sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == ["a", "b"]
    load([("b", 5), ("c", 6)])
    assert run() == ["a", "b", "c"]
