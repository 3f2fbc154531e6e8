"""Caps, stratified splits, draws and deterministic orders. Every choice follows a content hash, never ``rand()``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import SEED
from .prefix import global_row_number, rank_in_group


def hash_order(key: Column, seed: int = SEED) -> Column:
    """The order key that both engines share: sha2 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def cap_per_group(df: DataFrame, group: list[str], key: str, k: int, seed: int = SEED) -> DataFrame:
    """At most k rows a group, in hash order; row numbers above k are cut before the shuffle (R-01, W-01, R-03)."""
    w = W.partitionBy(*group).orderBy("__o", key)
    return df.withColumn("__o", hash_order(F.col(key), seed)).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__o", "__n")


def largest_remainder(strata: DataFrame, n: str, order: list[str], wanted: Column, total: Column, out: str) -> DataFrame:
    """Integer shares of ``wanted`` proportional to ``n``, summing to it exactly; ties go by ``order``. In whole
    numbers. For a bounded table of strata."""
    exact = F.col(n) * wanted
    low = F.expr("0") + F.floor(exact / F.nullif(total, F.lit(0)))
    rest = F.pmod(exact, F.nullif(total, F.lit(0)))
    whole = W.partitionBy()
    place = F.row_number().over(W.orderBy(F.desc("__rest"), *order))
    df = strata.withColumns({"__low": F.coalesce(low, F.lit(0)).cast("bigint"), "__rest": F.coalesce(rest, F.lit(0)), "__wanted": wanted})
    df = df.withColumn("__add", (place <= F.col("__wanted") - F.sum("__low").over(whole)).cast("bigint"))
    return df.withColumn(out, F.col("__low") + F.col("__add")).drop("__low", "__rest", "__wanted", "__add")


def split_plan(strata: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Per stratum n_train and n_test for 70/15/15: train is floor(0.7 n), test ceil of half the rest, both apportioned
    by largest remainder; the remainder is val."""
    total = F.sum(n).over(W.partitionBy())
    t = strata.withColumn("__t", total).withColumn("__want", F.floor(F.col("__t") * 7 / 10))
    t = largest_remainder(t, n, by, F.col("__want"), F.col("__t"), "n_train")
    t = t.withColumn("__left", F.col(n) - F.col("n_train")).withColumn("__rest_all", F.col("__t") - F.col("__want")).withColumn("__want2", F.ceil(F.col("__rest_all") / 2))
    t = largest_remainder(t, "__left", by, F.col("__want2"), F.col("__rest_all"), "n_test")
    return t.drop("__t", "__want", "__left", "__rest_all", "__want2")


def stratified_split(df: DataFrame, by: list[str], key: str, seed: int = SEED, least: int = 2) -> DataFrame:
    """Adds ``split`` (R-02). A stratum with fewer than ``least`` rows is an error, as in the usual splitters."""
    strata = df.groupBy(*by).agg(F.count("*").alias("n"))
    small = strata.where(F.col("n") < least).limit(1).collect()
    if small:
        raise ValueError(f"stratum {tuple(small[0][c] for c in by)} has fewer than {least} rows")
    plan = split_plan(strata, by)
    ranked = rank_in_group(df.withColumn("__o", hash_order(F.col(key), seed)), by, "__o", [key], "__k").join(F.broadcast(plan.drop("n")), by)
    split = F.when(F.col("__k") <= F.col("n_train"), "train").when(F.col("__k") <= F.col("n_train") + F.col("n_test"), "test").otherwise("val")
    return ranked.withColumn("split", split).drop("__o", "__k", "n_train", "n_test")


def split_audit(df: DataFrame, label: str = "label", environment: str = "environment", split: str = "split") -> DataFrame:
    """Cross-tab of rows by class, environment and split with their sum; absent combinations are 0 (A-05, A-06)."""
    s = F.col(split)
    return df.groupBy(label, environment).agg(*[F.count_if(s == x).alias(f"{x}_count") for x in ("train", "val", "test")]).withColumn(
        "total_count", F.col("train_count") + F.col("val_count") + F.col("test_count")
    )


def digest_number(text: Column) -> Column:
    """60 bits of md5 as a bigint, the same in both engines."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def weighted_draws(df: DataFrame, label: str, key: str, draws: int | None = None, seed: int = SEED) -> DataFrame:
    """(draw, label, key): draws with replacement, every class with the same weight (R-05); as many as rows by default.

    Draw i takes class hash(i) mod C and in it the row number hash'(i) mod n of the class in hash order; both sides
    are then joined on (class, number). Only the bounded table of class counts is broadcast.
    """
    spark = df.sparkSession
    ranked = rank_in_group(df.select(label, key).withColumn("__o", hash_order(F.col(key), seed)), [label], "__o", [key], "__k").select(label, key, "__k")
    classes = df.groupBy(label).agg(F.count("*").alias("__n")).withColumn("__c", (F.row_number().over(W.orderBy(label)) - 1).cast("bigint"))
    classes = classes.withColumn("__classes", F.count("*").over(W.partitionBy()))
    count, rows = df.agg(F.count_distinct(label), F.count("*")).first()
    draws = rows if draws is None else draws
    if not count:
        return spark.createDataFrame([], df.select(F.lit(0).cast("bigint").alias("draw"), label, key).schema)
    tag = lambda t: digest_number(F.concat(F.lit(f"{seed}:{t}:"), F.col("draw").cast("string")))
    d = spark.range(draws).withColumnRenamed("id", "draw").withColumn("__c", F.pmod(tag("class"), F.lit(count))).join(F.broadcast(classes), "__c")
    d = d.withColumn("__k", F.pmod(tag("row"), F.col("__n")) + 1)
    return d.join(ranked, [label, "__k"]).select("draw", label, key)


def view_limit(df: DataFrame, order: str, limit: int = 500) -> DataFrame:
    """The first rows of a view; a limit of 0 or less is none (L-06)."""
    return df.orderBy(order).limit(limit) if limit > 0 else df


#: Rounds of hashed candidates before free numbers are enumerated.
HASH_ROUNDS = 20


def unique_suffixes(df: DataFrame, key: str, used: DataFrame, number: str, ws, digits: int = 8) -> DataFrame:
    """Adds ``suffix``: an unused number of ``digits`` digits for every row, the same in every run (W-07).

    Candidates come from a hash of the key; of rows that meet on one candidate the first keeps it, the others (and
    those whose candidate is used) try the next hash. Each round leaves a small share; rounds are written."""
    span = 9 * 10 ** (digits - 1)
    todo, taken = ws.keep(df), used.select(F.col(number).cast("bigint").alias("suffix")).distinct()
    done = None
    for attempt in range(HASH_ROUNDS):
        candidate = F.pmod(digest_number(F.concat(F.lit(f"{attempt}:"), F.col(key).cast("string"))), F.lit(span)) + 10 ** (digits - 1)
        first = W.partitionBy("suffix").orderBy(key)
        tried = todo.withColumn("suffix", candidate).join(taken.withColumn("__used", F.lit(True)), "suffix", "left").withColumn("__n", F.row_number().over(first))
        tried = ws.keep(tried)
        good = (F.col("__n") == 1) & F.col("__used").isNull()
        placed = tried.where(good).drop("__n", "__used")
        done = placed if done is None else done.unionByName(placed)
        todo = tried.where(~good).drop("__n", "__used", "suffix")
        taken = taken.unionByName(placed.select("suffix"))
        if todo.isEmpty():
            return done.select(*df.columns, "suffix")
    # hardly a number is free: the rest take the free numbers in order
    rest = global_row_number(todo, [F.col(key)], "__r", ws)
    free = df.sparkSession.range(10 ** (digits - 1), 10**digits).withColumnRenamed("id", "suffix").join(taken, "suffix", "left_anti")
    placed = ws.keep(rest.join(global_row_number(free, [F.col("suffix")], "__r", ws), "__r").drop("__r"), n=F.count(F.lit(1)))
    if placed.observed["n"] == todo.count():
        return done.unionByName(placed).select(*df.columns, "suffix")
    raise RuntimeError("no free numbers are left")


def next_valid(df: DataFrame, order: str, valid: Column, values: list[str], ws) -> DataFrame:
    """Every invalid row takes ``values`` of the next valid row in order, the last ones wrap to the first (W-05);
    without any valid row they are null.

    The table is cut into ranges; a window inside each range finds the next valid row there, and rows at a range's end
    take the first valid row of a later range, of which there is one a range.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = F.when(valid, F.struct(*values))
    kept = ws.keep(df.withColumn("__v", packed).repartitionByRange(tasks, order).withColumn("__p", F.spark_partition_id()))
    heads = kept.where("__v IS NOT NULL").groupBy("__p").agg(F.min_by("__v", order).alias("__h"))
    ranges = kept.groupBy("__p").agg(F.min(order).alias("__m")).join(heads, "__p", "left")
    # backwards, so that the frame grows from its start and each row costs the same
    later = W.orderBy(F.desc("__m")).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("__next", F.coalesce(F.last("__h", True).over(later), F.first("__h", True).over(W.orderBy("__m").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    inside = W.partitionBy("__p").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    out = kept.withColumn("__w", F.last("__v", True).over(inside)).join(F.broadcast(ranges.select("__p", "__next")), "__p")
    rest = [c for c in df.columns if c not in values]
    v = F.coalesce("__w", "__next")
    return out.select(*rest, *[v[c].alias(c) for c in values])
