"""Sinks: split manifests, audit, duplicate lists, metrics and a catalogue table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_output_dir(base: str, suffix: str = "") -> str:
    """base, or base_suffix for a profile (R-08)."""
    return f"{base.rstrip('/')}_{suffix}" if suffix else base.rstrip("/")


def write_splits(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One folder per split (K-01); rows of a split stay spread over files."""
    df.write.mode("overwrite").partitionBy("split").option("header", True).format(kind).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file (K-02)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def duplicates_name(label: str, at: datetime) -> str:
    return f"duplicates_{label}_{at:%Y%m%d_%H%M%S}.csv"


def write_duplicates(groups: DataFrame, path: str) -> None:
    """original_path and a JSON list, quotes doubled (K-03)."""
    rows = groups.select(F.col("keeper").alias("original_path"), F.to_json("dups").alias("duplicate_paths"))
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics rows as JSON, numbers of type double rounded to six digits (K-04)."""
    six = [F.bround(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*six).coalesce(1).write.mode("overwrite").json(path)


def write_catalogue(samples: DataFrame, path: str, replace: bool = False) -> int:
    """Catalogue of samples (K-10): replaced or, if it is there already, left as it is; none is written for no samples.
    Returns the number of samples in it."""
    spark = samples.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jpath) and not replace:
        return spark.read.parquet(path).count()
    if samples.limit(1).isEmpty():
        if fs.exists(jpath):
            fs.delete(jpath, True)
        return 0
    samples.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).count()
