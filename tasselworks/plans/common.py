"""Shared inputs of the core queries, in DataFrame and in SQL form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CLASSES, ENVIRONMENTS
from ..functions.paths import category
from ..registry import table

SPLITS = ("train", "val", "test")


def listed(spark, sf_dir) -> DataFrame:
    """All listed pictures with their split."""
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, s).withColumn("split", F.lit(s)) for s in SPLITS])


def manifest(spark, sf_dir) -> DataFrame:
    """Rows whose class, environment and extension are allowed, in normal spelling (S-01, P-01, P-02, P-03)."""
    rows = listed(spark, sf_dir).withColumns({"label": category(F.col("label")), "environment": category(F.col("environment"))})
    return rows.where(F.col("label").isin(*CLASSES) & F.col("environment").isin(*ENVIRONMENTS) & F.lower("image_path").rlike(r"\.(png|jpe?g)$"))


def cat_sql(c: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g')"


_IN = ", ".join(f"'{c}'" for c in CLASSES)
#: CTEs ``a`` (all rows with split) and ``m`` (the manifest).
BASE_SQL = rf"""
a AS (SELECT *, 'train' AS split FROM train UNION ALL SELECT *, 'val' FROM val UNION ALL SELECT *, 'test' FROM test),
m AS (SELECT * FROM (SELECT * REPLACE ({cat_sql("label")} AS label, {cat_sql("environment")} AS environment) FROM a)
      WHERE label IN ({_IN}) AND environment IN ('lab', 'real') AND regexp_matches(lower(image_path), '\.(png|jpe?g)$'))
"""
