"""Splits that keep related records together: random-mate contraction of the links between entities.

The entities of a record are its contributor, its plot folder and its path. Records meet through entities, so the
graph has one vertex per entity, and a plot or path that occurs with a single anchor only (contributor, else plot, else
the path itself) is folded into that anchor before the loop. In each round every vertex draws head or tail from a hash of (seed, round, vertex); a tail with a
head among its neighbours collapses into one of them, and joins rename the edges' ends. When no edge is left, the
collapses are unwound from the last round to the first, which labels every vertex with its component's survivor.

Components are then cut into splits by cumulative weight (rows). Those heavier than ``heavy`` of all rows come first
and so fall into the first split; the rest follow in hash order. A component belongs to the split that holds its
middle, so each split's share is off by at most half of the component on its border.

Defined results: every row gets exactly one split; a row without contributor and path stands alone; rows that repeat
go together; blank contributors count as null; an empty table gives an empty result. Same rows, same splits, in any
order and partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.paths import plain_path, plot_folder
from ..operators.prefix import BLOCKS, running_sum
from ..operators.skew import HOT_ROWS, hot_join, hot_keys
from ..session import Workspace

MAX_ROUNDS = 300


def _heads(vertex: Column, seed: int, round_: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(round_), vertex).bitwiseAND(F.lit(1)) == 1


def contract(edges: DataFrame, ws: Workspace, seed: int) -> DataFrame:
    """(vertex, component) for all vertices of ``edges`` (a bigint, b bigint); repeated edges, loops and nulls add nothing."""
    spark = edges.sparkSession
    tidy = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    count = F.count(F.lit(1))
    graph = ws.keep(tidy(edges), size=count)
    vertices = ws.keep(graph.select(F.explode(F.array("a", "b")).alias("vertex")).distinct())
    collapses = []
    for k in range(MAX_ROUNDS):
        size = graph.observed["size"]
        if not size:
            break
        a, b = F.col("a"), F.col("b")
        pair = F.when(~_heads(a, seed, k) & _heads(b, seed, k), F.struct(a.alias("tail"), b.alias("head"))).when(
            _heads(a, seed, k) & ~_heads(b, seed, k), F.struct(b.alias("tail"), a.alias("head"))
        )
        mates = ws.keep(graph.select(pair.alias("p")).where("p IS NOT NULL").groupBy("p.tail").agg(F.min("p.head").alias("head")), size=count)
        collapses.append((mates, mates.observed["size"]))
        # no vertex can be hot in a graph of few edges
        degrees = graph.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
        hot = hot_keys(degrees, "v", "n", size if size <= HOT_ROWS else None)
        renamed = graph
        for end in ("a", "b"):
            to = mates.select(F.col("tail").alias(end), F.col("head").alias("__to"))
            renamed = hot_join(renamed, to, end, hot and hot.withColumnRenamed("v", end), "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
        old, graph = graph, ws.keep(tidy(renamed), size=count)
        ws.drop(old)
    else:
        raise RuntimeError("edges are left after the last round")
    # unwound: survivors keep their own name; who collapsed in round k is named after his mate, whose name is known then
    if not collapses:
        return spark.createDataFrame([], "vertex long, component long")
    gone = reduce(DataFrame.unionByName, [m.select(F.col("tail").alias("vertex")) for m, _ in collapses])
    labels = [ws.keep(vertices.join(gone, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component")))]
    for mates, size in reversed(collapses):
        known = reduce(DataFrame.unionByName, labels).withColumnRenamed("vertex", "head")
        hot = hot_keys(mates.groupBy("head").agg(F.count("*").alias("n")), "head", "n", size if size <= HOT_ROWS else None)
        labels.append(ws.keep(hot_join(mates, known, "head", hot).select(F.col("tail").alias("vertex"), "component")))
    return reduce(DataFrame.unionByName, labels)


def cut_by_weight(components: DataFrame, shares: dict[str, float], seed: int, heavy: float) -> DataFrame:
    """(component, weight, split) from (component, weight)."""
    total = components.agg(F.sum("weight")).first()[0] or 0
    first = F.col("weight") > F.lit(heavy * total)
    order = F.xxhash64(F.lit(seed), F.col("component"))
    block = F.when(first, F.lit(0)).otherwise(F.lit(1) + F.pmod(F.shiftrightunsigned(order, 40), F.lit(BLOCKS - 1)))
    placed = running_sum(components.withColumn("__o", order).withColumn("__b", block), "__b", [F.desc(F.when(first, F.col("weight"))), "__o", "component"], "weight", "__upto")
    middle = F.col("__upto") - F.col("weight") / 2
    choice, bound = F.lit(list(shares)[-1]), 0.0
    steps = []
    for name, share in shares.items():
        bound += share
        steps.append((name, bound * total))
    for name, end in reversed(steps[:-1]):
        choice = F.when(middle <= F.lit(float(end)), F.lit(name)).otherwise(choice)
    return placed.select("component", "weight", choice.alias("split"))


def grouped_split(
    rows: DataFrame,
    ws: Workspace,
    shares: dict[str, float],
    row_id: str = "row_id",
    path: str = "image_path",
    contributor: str = "contributor",
    carry: tuple[str, ...] = (),
    seed: int = 42,
    heavy: float = 0.01,
) -> DataFrame:
    """(row_id, carried columns, component, split)."""
    if abs(sum(shares.values()) - 1.0) > 1e-9:
        raise ValueError("shares must sum to 1")
    clash = {"row_id", "component", "split"} & set(carry)
    if clash:
        raise ValueError(f"carried columns clash with the result: {', '.join(sorted(clash))}")
    while True:
        placed = _place(rows, ws, shares, row_id, path, contributor, carry, seed, heavy)
        if placed is not None:
            return placed
        seed += 1  # two entities shared a hash


def _place(rows, ws, shares, row_id, path, contributor, carry, seed, heavy) -> DataFrame | None:
    """The split with entities as 64-bit hashes of this seed, None if a second hash shows that two entities share one."""
    who, plot, file = F.trim(F.col(contributor)), plot_folder(F.col(path)), plain_path(F.col(path))
    entity = lambda kind, c: F.when(F.trim(c) != "", F.struct(F.xxhash64(F.lit(seed), F.lit(kind), c).alias("h"), F.xxhash64(F.lit(~seed), F.lit(kind), c).alias("check")))
    plot, file = entity("plot", plot), entity("path", file)
    anchor = F.coalesce(entity("contributor", who), plot, file, entity("row", F.col(row_id).cast("string")), F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("check")))
    base = ws.keep(rows.select(F.col(row_id).alias("row_id"), *[F.col(c) for c in carry], plot.alias("__p"), file.alias("__x"), anchor.alias("__a")))

    # an entity with one anchor only (which may be itself) is a leaf and changes no component; of the others, every
    # anchor is linked with the smallest
    seen = base.select(F.explode(F.array_compact(F.array("__p", "__x", "__a"))).alias("e"), F.col("__a.h").alias("b")).select("e.h", "e.check", "b")
    several = seen.groupBy(F.col("h").alias("a")).agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n"), (F.min("check") != F.max("check")).alias("met"))
    watch = Observation()
    several = several.observe(watch, F.count_if("met").alias("met"), F.max("n").alias("most")).where("lo <> hi").drop("met")
    spread = ws.keep(several)
    if watch.get["met"]:
        return None
    hot = hot_keys(spread, "a", "n", watch.get["most"] or 0)
    links = hot_join(seen.select(F.col("h").alias("a"), "b"), spread.select("a", "lo"), "a", hot).select("b", F.col("lo").alias("a"))
    labels = contract(links.select("a", "b"), ws, seed)
    anchors = base.groupBy(F.col("__a.h").alias("__anchor")).agg(F.count("*").alias("n")).join(labels.withColumnRenamed("vertex", "__anchor"), "__anchor", "left")
    anchors = ws.keep(anchors.select("__anchor", "n", F.coalesce("component", "__anchor").alias("component")), most=F.max("n"))
    components = ws.keep(anchors.groupBy("component").agg(F.sum("n").alias("weight")))
    cut = cut_by_weight(components, shares, seed, heavy).select("component", "split")
    placed = ws.keep(anchors.join(cut, "component"))
    hot = hot_keys(anchors, "__anchor", "n", anchors.observed["most"] or 0)
    base = base.select("row_id", *carry, F.col("__a.h").alias("__anchor"))
    return hot_join(base, placed.select("__anchor", "component", "split"), "__anchor", hot).select("row_id", *carry, "component", "split")
