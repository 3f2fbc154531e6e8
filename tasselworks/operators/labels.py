"""Label routing, dominant classes, encodings and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import CLASSES


def annotation_lines(df: DataFrame, body: str, keep: list[str]) -> DataFrame:
    r"""One row per annotation line: pos, class_id (null for a bad token), n_values, kind (box with four values,
    polygon with more). Both kinds of line end; blank lines give no row (S-08, D11)."""
    lines = F.filter(F.transform(F.split(F.col(body), "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.select(*keep, F.posexplode(lines).alias("pos", "line"))
    tokens = F.split("line", r"\s+")
    n = F.size(tokens) - 1
    return rows.select(*keep, "pos", F.expr(r"try_cast(element_at(split(line, '\\s+'), 1) AS int)").alias("class_id"), n.alias("n_values"), F.when(n == 4, "box").when(n > 4, "polygon").otherwise("short").alias("kind"))


def dominant_class(lines: DataFrame, key: str, class_id: str = "class_id", pos: str = "pos") -> DataFrame:
    """Most frequent class id per key; ties go to the id seen first; bad tokens do not count; none gives null (A-07)."""
    per = lines.groupBy(key, class_id).agg(F.count("*").alias("n"), F.min(pos).alias("p"))
    best = F.max_by(class_id, F.when(F.col(class_id).isNotNull(), F.struct("n", (-F.col("p")).alias("p"))))
    return per.groupBy(key).agg(best.alias("class_id"))


def onehot_route(flags: dict[str, Column], none: str = "no_label", several: str = "multi_label") -> tuple[Column, Column]:
    """(number of active flags, destination): no flag, one flag's name, or several (P-11). A flag is active if its
    trimmed text is 1; a missing cell counts as 0."""
    active = F.filter(F.array(*[F.when(F.trim(c) == "1", F.lit(name)) for name, c in flags.items()]), lambda x: x.isNotNull())
    n = F.size(active)
    return n, F.when(n == 0, none).when(n == 1, F.element_at(active, 1)).otherwise(several)


def class_index(present: DataFrame, label: str, configured: tuple = CLASSES) -> DataFrame:
    """(label, index): configured order, restricted to the classes present, numbered from 0 (J-06, X-05). Computed
    once and joined everywhere, so that all splits share one mapping."""
    spark = present.sparkSession
    order = spark.createDataFrame([(c, k) for k, c in enumerate(configured)], f"{label} string, __k int")
    seen = order.join(present.select(label).distinct(), label, "left_semi")
    return seen.select(label, (F.row_number().over(W.orderBy("__k")) - 1).alias("index"))


def unknown_labels(present: DataFrame, label: str, configured: tuple = CLASSES) -> DataFrame:
    """Labels that are present but not configured (X-04, P-18)."""
    return present.where(F.col(label).isNotNull() & ~F.col(label).isin(*configured)).select(label).distinct()


def check_labels(present: DataFrame, label: str, configured: tuple = CLASSES) -> None:
    """Raises with the sorted list of unknown labels; reads one row more than it shows."""
    bad = [r[0] for r in unknown_labels(present, label, configured).orderBy(label).limit(21).collect()]
    if bad:
        raise ValueError(f"unknown labels: {', '.join(bad[:20])}{' ...' if len(bad) > 20 else ''}")


def class_weights(df: DataFrame, label: str, index: DataFrame | None = None) -> DataFrame:
    """Balanced weights N / (C n) and inverse-frequency weights 1 / n per class (A-09, A-10)."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = W.partitionBy()
    return c.select(label, "n", F.bround(F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")), 6).alias("balanced"), F.bround(1.0 / F.col("n"), 6).alias("inverse"))


def exclude(df: DataFrame, label: str, excluded: list[str]) -> DataFrame:
    """Rows whose label is not excluded; a null label stays (P-04)."""
    return df.where(F.coalesce(~F.col(label).isin(*excluded), F.lit(True))) if excluded else df


def longest_source(text: Column, names: tuple) -> Column:
    """The longest known name that the text contains, else unknown (J-12); an ordered CASE, no join."""
    out = F.lit("unknown")
    for name in sorted(names, key=lambda n: (len(n), n)):
        out = F.when(F.contains(text, F.lit(name)), name).otherwise(out)
    return out
