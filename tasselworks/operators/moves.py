"""File plans: what would be moved, copied, renamed or deleted, as data. Nothing touches the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extension(c: Column) -> Column:
    """Lower-case suffix with its point; empty for none, and for a name that is only a suffix (F-01)."""
    name = F.element_at(F.split(c, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def plan(rows: DataFrame, action: str, existing: DataFrame | None = None, present: DataFrame | None = None, carry: tuple = ()) -> DataFrame:
    """(src, dst, action, status) from rows (src, dst).

    no_extension: the source has none; missing: not among ``present``; exists: the destination is taken already;
    collision: several sources share the destination; else planned. Running the plan twice changes nothing.
    """
    df = rows.select("src", "dst", *carry)
    if present is not None:
        df = df.join(present.select("src").distinct().withColumn("__there", F.lit(True)), "src", "left")
    else:
        df = df.withColumn("__there", F.lit(True))
    if existing is not None:
        df = df.join(existing.select("dst").distinct().withColumn("__taken", F.lit(True)), "dst", "left")
    else:
        df = df.withColumn("__taken", F.lit(None).cast("boolean"))
    # counted per destination first; destinations of several sources are few, all others need no partner
    shared = rows.groupBy("dst").agg(F.min("src").alias("__a"), F.max("src").alias("__b")).where("__a <> __b").select("dst", F.lit(True).alias("__shared"))
    df = df.join(shared, "dst", "left")
    status = (
        F.when(extension(F.col("src")) == "", "no_extension").when(F.col("__there").isNull(), "missing").when(F.col("__taken"), "exists").when(F.col("__shared"), "collision").otherwise("planned")
    )
    return df.select("src", "dst", F.lit(action).alias("action"), status.alias("status"), *carry)


def collisions(rows: DataFrame, most: int = 1000) -> DataFrame:
    """(dst, n_sources, first_src, last_src) of destinations with more than one source (A-23)."""
    g = rows.groupBy("dst").agg(F.count_distinct("src").alias("n_sources"), F.min("src").alias("first_src"), F.max("src").alias("last_src"))
    return g.where("n_sources > 1")
