"""Distributions, shares, quantiles and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Workspace


def class_environment_counts(df: DataFrame, label: str = "label", environment: str = "environment") -> DataFrame:
    """One row per class: lab, real, total (A-01); absent combinations are 0."""
    e = F.col(environment)
    return df.groupBy(label).agg(F.count_if(e == "lab").alias("lab"), F.count_if(e == "real").alias("real"), F.count("*").alias("total"))


def with_share(counts: DataFrame, n: str = "total", out: str = "share", digits: int = 2) -> DataFrame:
    """Share of the grand total in percent, half-even (A-03); meant for a bounded table of counts."""
    return counts.withColumn(out, F.bround(F.col(n) * 100.0 / F.sum(n).over(W.partitionBy()), digits))


def ratio(a: Column, b: Column, digits: int) -> Column:
    """100 a / b, half-even; null where b is 0."""
    return F.bround(F.try_divide(a * F.lit(100.0), b), digits)


def exact_quantiles(df: DataFrame, groups: list[str], column: str, probabilities: dict[str, float], ws: Workspace) -> DataFrame:
    """Interpolated quantiles per group, exact, without one group ever being in one task.

    Equal values are counted before the shuffle, the counts are range-sorted by group and value and written; sums per
    range (ranges x groups rows at most) give every value the positions it covers, and only the values at the wanted
    positions go on. Groups must be bounded in number; null values do not count. One row a group: groups, columns
    named as in ``probabilities``.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.select(*groups, F.col(column).cast("double").alias("__x")).where("__x IS NOT NULL").groupBy(*groups, "__x").agg(F.count("*").alias("__c"))
    kept = ws.keep(counts.repartitionByRange(tasks, *groups, "__x").withColumn("__p", F.spark_partition_id()))
    per = kept.groupBy(*groups, "__p").agg(F.sum("__c").alias("__s"))
    g = W.partitionBy(*groups)
    offsets = per.select(*groups, "__p", (F.sum("__s").over(g.orderBy("__p")) - F.col("__s")).alias("__off"), F.sum("__s").over(g).alias("__total"))
    inside = W.partitionBy(*groups, "__p").orderBy("__x").rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum("__c").over(inside)
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"o.{c}")) for c in groups]
    placed = (
        kept.withColumn("__upto", upto).alias("v").join(F.broadcast(offsets.alias("o")), [F.col("v.__p") == F.col("o.__p"), *same])
        .select(*[F.col(f"v.{c}") for c in groups], "__x", (F.col("__off") + F.col("__upto") - F.col("__c")).alias("__from"), (F.col("__off") + F.col("__upto")).alias("__to"), "__total")
    )
    at = {n: (F.col("__total") - 1) * F.lit(float(q)) for n, q in probabilities.items()}
    covers = lambda i: (F.col("__from") <= i) & (i < F.col("__to"))
    hit = reduce(lambda a, b: a | b, [covers(f(p)) for p in at.values() for f in (F.floor, F.ceil)])
    picked = [F.max(F.when(covers(f(p)), F.col("__x"))).alias(f"__{n}_{k}") for n, p in at.items() for k, f in (("lo", F.floor), ("hi", F.ceil))]
    part = [F.max(p - F.floor(p)).alias(f"__{n}_part") for n, p in at.items()]
    found = placed.where(hit).groupBy(*groups).agg(*picked, *part)
    return found.select(*groups, *[(F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_part")).alias(n) for n in at])


def describe(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns, one row a column (A-11); moments in one combined
    aggregate, quartiles by ``exact_quantiles``."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    moments = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    quartiles = exact_quantiles(long, ["column"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, Workspace(df.sparkSession, "describe"))
    rows = moments.join(F.broadcast(quartiles), "column", "left")
    return rows.select("column", "n", *[F.bround(k, digits).alias(k) for k in ("mean", "std", "min", "q1", "median", "q3", "max")])


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts of equal bins over min..max, the last bin closed (A-21); null values are left out. Two passes: the
    range, one row, is broadcast."""
    x = F.col(column).cast("double")
    span = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    place = F.coalesce(F.floor((x - F.col("__lo")) * bins / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))), F.lit(0)) + 1
    rows = df.where(x.isNotNull()).crossJoin(F.broadcast(span))
    return rows.groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box_plot(df: DataFrame, group: str, column: str, digits: int = 6) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and outliers per group (A-22)."""
    x = F.col(column).cast("double")
    q = exact_quantiles(df, [group], column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, Workspace(df.sparkSession, "box"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    # the group keys are classes: a bounded side
    rows = df.join(F.broadcast(q), group)
    return rows.groupBy(group, "q1", "median", "q3").agg(F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"), F.count_if(~inside).alias("outliers")).select(
        group, *[F.bround(c, digits).alias(c) for c in ("q1", "median", "q3", "low", "high")], "outliers"
    )


def imbalance(counts: DataFrame, label: str, n: str) -> DataFrame:
    """max(n) / n per class with a band (A-15, P-12): above 10 high, above 5 medium, else low."""
    r = F.max(n).over(W.partitionBy()) / F.col(n)
    return counts.select(label, n, F.bround(r, 6).alias("ratio"), F.when(r > 10, "high").when(r > 5, "medium").otherwise("low").alias("band"))


def usage_rollup(df: DataFrame, levels: list[str], size: Column) -> DataFrame:
    """Count and bytes at every folder level and in all, in one scan (A-19)."""
    names = [F.col(c) for c in levels]
    out = df.rollup(*names).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(size).alias("bytes"))
    return out.select(*levels, F.col("level").cast("int").alias("level"), "n", "bytes")


def human_size(n: Column) -> Column:
    """B, KB, MB, GB, TB by 1024 with one decimal, half-even (F-14)."""
    x = n.cast("double")
    steps = [(1024.0**k, u) for k, u in enumerate(("B", "KB", "MB", "GB"))]
    text = lambda v, u: F.concat(F.bround(v, 1).cast("decimal(20,1)").cast("string"), F.lit(f" {u}"))
    out = text(x / 1024.0**4, "TB")
    for f, u in reversed(steps):
        out = F.when(x < f * 1024, text(x / f, u)).otherwise(out)
    return out


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Lines (line_no, line) of a left-aligned Markdown table (K-05). For small report tables."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns], F.row_number().over(W.orderBy(*order)).alias("__n"))
    widths = text.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(f"__w{k}") for k, c in enumerate(columns)])
    joined = text.crossJoin(F.broadcast(widths))
    line = F.concat_ws(" | ", *[F.rpad(c, F.col(f"__w{k}"), F.lit(" ")) for k, c in enumerate(columns)])
    body = joined.select((F.col("__n") + 1).alias("line_no"), line.alias("line"))
    head = widths.select(F.lit(0).alias("line_no"), F.concat_ws(" | ", *[F.rpad(F.lit(c), F.col(f"__w{k}"), F.lit(" ")) for k, c in enumerate(columns)]).alias("line"))
    rule = widths.select(F.lit(1).alias("line_no"), F.concat_ws(" | ", *[F.repeat(F.lit("-"), F.col(f"__w{k}")) for k in range(len(columns))]).alias("line"))
    return reduce(DataFrame.unionByName, [head, rule, body])
