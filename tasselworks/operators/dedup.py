"""Exact and perceptual duplicates, components and removal plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Workspace
from .skew import hot_join, hot_keys


def keep_first(df: DataFrame, content: Column, order: list[str], scope: list[str] = ()) -> DataFrame:
    """The first row (by ``order``, which must be total) of each content hash, over the whole table or per scope.

    Row numbers above 1 are cut before the shuffle, so a content with a third of all rows sends one row a task. Rows
    with null content are unreadable and left out.
    """
    w = W.partitionBy(*scope, "__hash").orderBy(*order)
    return df.withColumn("__hash", F.sha2(content, 256)).where("__hash IS NOT NULL").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__hash")


def dedup_counters(df: DataFrame, content: Column) -> DataFrame:
    """total, unreadable, kept and duplicates; one row. Hashes are counted before they are shuffled."""
    per = df.groupBy(F.sha2(content, 256).alias("h")).agg(F.count("*").alias("n"))
    readable = F.col("h").isNotNull()
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(~readable, F.col("n"))), F.lit(0)).alias("unreadable"),
        F.count_if(readable).alias("kept"), F.coalesce(F.sum(F.when(readable, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
    )


def sign_hash(embedding: Column, bits: int = 16) -> Column:
    """Text of 0 and 1: signs of the first dimensions."""
    return F.array_join(F.transform(F.slice(embedding, 1, bits), lambda x: F.when(x > 0, "1").otherwise("0")), "")


def hamming_pairs(hashes: DataFrame, key: str, value: str, bits: int, threshold: int, scope: list[str] = ()) -> DataFrame:
    """(a, b, distance) for integer hashes that differ in at most ``threshold`` bits, by representatives.

    The representative of a hash (and scope) is its smallest key. Rows with distance 0 say which key ``b`` belongs to
    which representative ``a``; all others link two representatives, a < b. Copies are not expanded into pairs, so a
    hash that a third of all rows share gives a row a member.

    The hash is cut into threshold + 1 bands; two hashes within the threshold agree in one band at least, so an
    equi-join on (band, bits) misses nothing; a pair is kept for its first band only. The join is over different
    hashes, a bucket of which is bounded by the bits that the other bands leave, and adaptive execution splits it.
    """
    bands = threshold + 1
    edges = [bits * k // bands for k in range(bands + 1)]
    # scope columns come along as one struct, so that scope null meets scope null
    tagged = hashes.select(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in scope], F.lit(0).alias("_")).alias("s"), F.col(key).alias("k"), F.col(value).cast("bigint").alias("h")).where("h IS NOT NULL")
    distinct = tagged.groupBy("s", "h").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    masks = [-1 if edges[n + 1] - edges[n] == 64 else (1 << (edges[n + 1] - edges[n])) - 1 for n in range(bands)]
    band_bits = lambda c, n: F.shiftrightunsigned(c, edges[n]).bitwiseAND(F.lit(masks[n]).cast("bigint"))
    # members meet their representative by a hash of scope and value, split by hot_join where one value is frequent
    one = lambda d, k: d.select(F.xxhash64("s", "h").alias("x"), "s", "h", F.col("k").alias(k))
    several = distinct.where("n > 1")
    most = several.groupBy(F.xxhash64("s", "h").alias("x")).agg(F.sum("n").alias("n"))
    same = hot_join(one(tagged, "b"), one(several, "a").groupBy("x").agg(F.collect_list(F.struct("s", "h", "a")).alias("r")), "x", hot_keys(most, "x", "n"))
    # values that share the 64-bit hash are told apart here
    same = same.select("b", F.filter("r", lambda r: (r["s"] == F.col("s")) & (r["h"] == F.col("h")))[0]["a"].alias("a")).where("a <> b").select("a", "b", F.lit(0).alias("distance"))
    if not threshold:
        return same
    parts = F.array(*[F.struct(F.lit(n).alias("band"), band_bits(F.col("h"), n).alias("bits")) for n in range(bands)])
    banded = distinct.select("s", "h", "k", F.explode(parts).alias("p"))
    differ = F.col("l.h").bitwiseXOR(F.col("r.h"))
    first = reduce(lambda acc, n: F.when(band_bits(differ, n) == 0, n).otherwise(acc), reversed(range(bands)), F.lit(bands))
    near = (
        banded.alias("l").join(banded.alias("r"), (F.col("l.s") == F.col("r.s")) & (F.col("l.p") == F.col("r.p")) & (F.col("l.h") < F.col("r.h")))
        .where((F.bit_count(differ) <= threshold) & (first == F.col("l.p.band")))
        .select(F.least("l.k", "r.k").alias("a"), F.greatest("l.k", "r.k").alias("b"), F.bit_count(differ).cast("int").alias("distance"))
    )
    return near.unionByName(same)


def components(edges: DataFrame, ws: Workspace, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of each undirected component, by star contraction (large star, small star).

    Links alternate between hanging larger neighbours and smaller neighbours under the smallest one until nothing
    changes; every round halves the depth and is written to the shared folder.
    """
    pairs = ws.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ws.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")), most=F.max("n"))
        hot = hot_keys(low, "a", "n", low.observed["most"] or 0)
        large = hot_join(both.where("b > a"), low.select("a", "m"), "a", hot).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = ws.keep(large)
        down = ws.keep(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), most=F.max("n"))
        hung = hot_join(large, down.select("a", "m"), "a", hot_keys(down, "a", "n", down.observed["most"] or 0))
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        new = ws.keep(small)
        # a table of stars: no node is both a child and a parent, or a child twice
        roles = new.select("a", F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(new.select(F.col("b").alias("a"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        done = roles.groupBy("a").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 OR (c > 0 AND p > 0)").isEmpty()
        ws.drop(pairs, low, large, down)
        pairs = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def duplicate_groups(labels: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """(keeper, dups): the smallest member keeps, the others are listed in order (D6, L-03). For reports on groups of
    moderate size; removal lists of any size come from ``removals``."""
    g = labels.groupBy(root).agg(F.array_sort(F.collect_set(node)).alias("m"))
    return g.select(F.element_at("m", 1).alias("keeper"), F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))).alias("dups")).where(F.size("dups") > 0)


def removals(labels: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """(keeper, duplicate): every non-keeper with its keeper (U-06)."""
    return labels.where(F.col(node) != F.col(root)).select(F.col(root).alias("keeper"), F.col(node).alias("duplicate"))
