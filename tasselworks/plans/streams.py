"""Streaming queries over events and loads; each runs to the end of what is there and returns the sink's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Registry, table
from ..session import Workspace
from ..streaming import incremental

REGISTRY = Registry()
Q = REGISTRY.add


def _run(spark, sf, name, source, make):
    """Streams the table's rows. A table that is a single file, which a file stream cannot follow, is first written
    into a folder; a folder is followed as it is."""
    ws = Workspace(spark, name)
    rows = table(spark, sf, source)
    folder = f"{sf}/{source}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder = f"{ws.root}/in"
        rows.write.parquet(folder)
    out = make(incremental.stream_table(spark, folder, rows.schema))
    incremental.run_available(out, f"{ws.root}/out", f"{ws.root}/state")
    return spark.read.schema(out.schema).parquet(f"{ws.root}/out")


@Q("st01_windowed_counts", """WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
   SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def st01(spark, sf):
    """Events per hour and type; the windows still open at the end are not emitted."""
    rows = _run(spark, sf, "st01", "events", lambda s: incremental.windowed_counts(s, "ts", "10 minutes", "1 hour", ["event_type"]))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@Q("st02_sessions", """WITH e AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE) IS NOT TRUE AS new FROM events),
   s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
   SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def st02(spark, sf):
    rows = _run(spark, sf, "st02", "events", lambda s: incremental.sessions(s, "ts", "10 minutes", "30 minutes", "user_id"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@Q("st03_incremental_manifest", "SELECT count(DISTINCT event_id) AS n, count(*) AS n_rows FROM events")
def st03(spark, sf):
    """Insert-if-unseen over the event stream: every key once."""
    kept = _run(spark, sf, "st03", "events", lambda s: incremental.incremental_manifest(s, "event_id", "ts", "30 days").select("event_id", "ts"))
    return kept.agg(F.count_distinct("event_id").alias("n"), F.count("*").alias("n_rows"))
