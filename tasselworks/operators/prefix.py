"""Running sums over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Number of blocks of a running sum; what reaches the single-task step is one row a block, whatever the table's size.
BLOCKS = 4096


def running_sum(df: DataFrame, block: str, order: list, weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over all rows that come earlier, the row itself included.

    Rows are ordered by ``block`` (an integer that follows the wanted order, at most BLOCKS values), then by
    ``order``. Blocks are summed first (map-side combined), the few block sums are accumulated in one small task and
    broadcast, and a window inside each block does the rest. A hot block is the caller's matter: derive it from a
    uniform hash, so that blocks are even.
    """
    sums = df.groupBy(block).agg(F.sum(weight).alias("__s"))
    before = sums.select(block, (F.sum("__s").over(W.orderBy(block)) - F.col("__s")).alias("__before"))
    inside = W.partitionBy(block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__in", F.sum(weight).over(inside)).join(F.broadcast(before), block).withColumn(out, F.col("__before") + F.col("__in")).drop("__before", "__in")


def rank_in_group(df: DataFrame, groups: list[str], order: str, tie: list[str], out: str) -> DataFrame:
    """1, 2, 3, ... inside each group along ``order``, a column of evenly spread hexadecimal text (a hash).

    The group is cut by the first two digits of the hash, so that a group with a third of all rows spreads over 256
    tasks. The number of groups must be bounded (classes, strata): groups x 256 counts are broadcast.
    """
    df = df.withColumn("__b", F.substring(order, 1, 2))
    counts = df.groupBy(*groups, "__b").agg(F.count("*").alias("__c"))
    upto = W.partitionBy(*groups).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*groups, "__b", F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__before"))
    inside = df.withColumn("__r", F.row_number().over(W.partitionBy(*groups, "__b").orderBy(order, *tie)))
    return inside.join(F.broadcast(before), [*groups, "__b"]).withColumn(out, (F.col("__before") + F.col("__r")).cast("bigint")).drop("__b", "__before", "__r")


def global_row_number(df: DataFrame, order: list, out: str, ws, tasks: int | None = None) -> DataFrame:
    """1, 2, 3, ... over the whole table in the order of ``order`` (which must be total), by a range sort.

    The sorted table is written once, so that the numbering of a partition cannot change if a task runs again; only
    one count a partition is gathered.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = ws.keep(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    counts = kept.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    before = counts.select("__p", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.col("__m").bitwiseAND((1 << 33) - 1)
    return kept.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(out, (F.col("__before") + inside + 1).cast("bigint")).drop("__p", "__m", "__before")
