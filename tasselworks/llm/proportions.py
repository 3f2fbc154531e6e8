"""Sample that matches target category proportions: systematic unequal-probability sampling.

Sample counts are settled on category counts alone: shares are scaled so that the counts, clipped between each
category's floor and what it has, sum to the sample size. Rows are then ordered by category and, inside a category,
at random (by hash). The inclusion probabilities are summed along that order across partitions, one random start is
drawn, and a row is selected where its running sum crosses the next integer. Each category thus gets its real-valued
count rounded down or up; a floor that rounding broke is repaired from the rows next in order.

Defined results: labels and environments are compared without letter case, outer blanks and kind of separator; rows
of null or untargeted categories are never selected but count for the size; repeated rows count; targets that repeat
a category are added up; categories that cannot reach their share or floor are reported and give all they have; an
empty table or empty targets give an empty sample.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import category
from ..operators.prefix import running_sum
from ..session import Workspace

#: Rows in one block of the running sum; a category has as many blocks as its rows need.
BLOCK_ROWS = 200_000
#: The targets are the one table that is brought to the driver; more rows than this are refused.
MAX_TARGETS = 100_000


def allocate(shares: list[float], floors: list[int], caps: list[int], size: float) -> list[float]:
    """Counts clip(scale x share, floor, cap) with the scale that makes them sum to size (or to all there is)."""
    if sum(caps) <= size:
        return [float(c) for c in caps]
    counts = lambda scale: [min(max(scale * s, min(f, c)), c) for s, f, c in zip(shares, floors, caps)]
    if abs(sum(counts(size)) - size) < 1e-9 * max(size, 1):
        return counts(size)
    low, high = 0.0, max((c / s for s, c in zip(shares, caps) if s > 0), default=0.0)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(counts(mid)) < size else (low, mid)
    return counts(high)


def random_start(seed: int) -> float:
    return int(hashlib.sha256(f"start:{seed}".encode()).hexdigest()[:12], 16) / 16**12


def proportional_sample(
    rows: DataFrame, targets: DataFrame, ws: Workspace, row_id: str = "row_id", label: str = "label", environment: str = "environment", divisor: int = 5, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(sample, report). The sample has (row_id, label, environment), with categories spelled as in the targets; its
    size is the number of rows divided by ``divisor``. The report has a row per target category."""
    spark = rows.sparkSession
    wanted = targets.groupBy(category(F.col("label")).alias("__l"), category(F.col("environment")).alias("__e")).agg(
        F.min("label").alias("label"), F.min("environment").alias("environment"), F.sum("target_share").alias("share"), F.max("min_rows").alias("floor")
    )
    wanted = wanted.where("__l IS NOT NULL AND __e IS NOT NULL").limit(MAX_TARGETS + 1)
    known = sorted(wanted.collect())
    if len(known) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target categories")
    codes = spark.createDataFrame([(r["__l"], r["__e"], n) for n, r in enumerate(known)], "__l string, __e string, code int")
    total = rows.count()
    # the category of a raw spelling is worked out once per spelling pair and partition, not once per row
    tagged = ws.keep(
        rows.select(F.col(row_id).alias("row_id"), category(F.col(label)).alias("__l"), category(F.col(environment)).alias("__e"))
        .join(F.broadcast(codes), ["__l", "__e"])
        .select("row_id", "code")
    )
    have = dict(tagged.groupBy("code").count().collect())
    caps = [have.get(n, 0) for n in range(len(known))]
    shares = [float(r["share"] or 0.0) for r in known]
    floors = [int(r["floor"] or 0) for r in known]
    counts = allocate(shares, floors, caps, total / divisor)

    u = random_start(seed)
    base, first, blocks, before, plan = 0.0, 0, 0, 0, []
    for n, cap in enumerate(caps):
        size = max(1, -(-cap // BLOCK_ROWS))
        plan.append((n, cap, base, counts[n] / cap if cap else 0.0, before, blocks, size))
        base, before, blocks = base + counts[n], before + cap, blocks + size
    steps = F.broadcast(spark.createDataFrame(plan, "code int, cap long, base double, pi double, before long, block0 int, blocks int"))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string"))), 1, 15), 16, 10).cast("bigint")
    # the top bits of the hash choose the block, so that blocks follow the order and are even
    slot = F.shiftright(F.shiftright(F.col("__o"), 28) * F.col("blocks"), 32).cast("int")
    placed = tagged.join(steps, "code").withColumn("__o", order).withColumn("__b", F.col("block0") + slot).withColumn("__one", F.lit(1))
    placed = running_sum(placed, "__b", ["__o", "row_id"], "__one", "__n")
    rank = F.col("__n") - F.col("before")
    upto = lambda r: F.floor(F.lit(u) + F.col("base") + r * F.col("pi"))
    drawn = placed.select("row_id", "code", rank.alias("rank"), (upto(rank) > upto(rank - 1)).alias("hit"))
    drawn = ws.keep(drawn.where(F.col("hit") | (F.col("rank") <= 2 * max([1, *floors]))))
    got = dict(drawn.where("hit").groupBy("code").count().collect())
    short = [(n, min(f, c) - got.get(n, 0)) for n, (f, c) in enumerate(zip(floors, caps)) if got.get(n, 0) < min(f, c)]
    sample = drawn.where("hit").select("row_id", "code")
    if short:
        lacking = F.broadcast(spark.createDataFrame(short, "code int, lack long"))
        extra = drawn.where("NOT hit").join(lacking, "code").withColumn("__r", F.row_number().over(W.partitionBy("code").orderBy("rank")))
        sample = sample.unionByName(extra.where("__r <= lack").select("row_id", "code"))
    names = spark.createDataFrame([(n, r["label"], r["environment"], c, s, f, float(x)) for n, (r, c, s, f, x) in enumerate(zip(known, caps, shares, floors, counts))],
                                  "code int, label string, environment string, available long, target_share double, min_rows long, planned double")
    selected = sample.groupBy("code").agg(F.count("*").alias("selected"))
    # decimals as the share is written, so that no rounding decides whether it is reachable
    too_few = (F.col("available") * divisor).cast("decimal(20,0)") < F.col("target_share").cast("decimal(17,15)") * F.lit(total).cast("decimal(20,0)")
    report = names.join(selected, "code", "left").select(
        "label", "environment", "target_share", "min_rows", "available", F.bround("planned", 6).alias("planned"), F.coalesce("selected", F.lit(0)).alias("selected"),
        ((F.coalesce("selected", F.lit(0)) < F.col("min_rows")) | too_few).alias("impossible"),
    )
    return sample.join(F.broadcast(names.select("code", "label", "environment")), "code").select("row_id", "label", "environment"), report
