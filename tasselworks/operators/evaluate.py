"""Classifier evaluation on (truth, prediction) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """(label, tp, fp, fn) for labels seen in truth or prediction: one shuffle of pair counts, then a bounded table."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    hit = F.col("t") == F.col("p")
    sides = F.when(hit, F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("fn")))).otherwise(
        F.array(
            F.struct(F.col("t").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.col("n").alias("fn")),
            F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("bigint").alias("fn")),
        )
    )
    return pairs.select(F.explode(sides).alias("s")).groupBy("s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "fp", "fn")])


def scores(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, support; 0 where the denominator is 0."""
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("label", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def accuracy(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.agg(F.bround(F.avg((F.col(truth) == F.col(prediction)).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


def macro_f1(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return scores(class_counts(df, truth, prediction)).agg(F.bround(F.avg("f1"), 6).alias("macro_f1"))


def report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg."""
    s = scores(class_counts(df, truth, prediction))
    per = s.select(F.col("label").cast("string").alias("name"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    acc = F.sum(F.col("recall") * F.col("support")) / total
    summary = [
        s.agg(F.lit("accuracy").alias("name"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), total.alias("support")),
        s.agg(F.lit("macro avg").alias("name"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")),
        s.agg(F.lit("weighted avg").alias("name"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")),
    ]
    rows = reduce(DataFrame.unionByName, summary, per)
    return rows.select("name", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def confusion(df: DataFrame, truth: str, prediction: str, labels: list) -> DataFrame:
    """A row per true label, a column per predicted one of the given labels."""
    return df.groupBy(F.col(truth).alias("truth")).agg(*[F.count_if(F.col(prediction) == v).alias(f"pred_{v}") for v in labels])


def arg_max(values: Column) -> Column:
    """Index from 0 of the largest element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
