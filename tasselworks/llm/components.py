"""Consolidating pairwise matches into groups: connected components by seed-tree pruning.

Each round every vertex proposes the minimum of its neighbourhood to all members of that neighbourhood. Vertices that
nobody proposes are no minimum anywhere: they leave the graph and hang under the smallest proposal they got, in the
propagation forest. The survivors are linked through their own proposals and go on. Vertices without neighbours are
the seeds. At the end the seeds' ids flow down the forest, last round first. The number of rounds grows with the
logarithm of the longest chain, each vertex is written to the forest once.

Defined results: an empty edge table gives an empty result; self-loops, repeated edges and edges with a null end add
nothing; hubs are joined by a broadcast of the bounded set of hot vertices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, hot_join, hot_keys
from ..session import Workspace

MAX_ROUNDS = 60


def _symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each different edge once; one direction is made unique before it is turned round."""
    one = edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    return one.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def seed_tree_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(vertex, seed) for every vertex of ``edges`` (u bigint, v bigint) that has a neighbour; seed is the component's
    surviving minimum, equal for all vertices linked directly or indirectly."""
    spark = edges.sparkSession
    count = F.count(F.lit(1))
    graph = ws.keep(_symmetric(edges), size=count)
    forest: list[tuple[DataFrame, int]] = []
    for _ in range(MAX_ROUNDS):
        if not graph.observed["size"]:
            break
        minima = ws.keep(graph.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), most=F.max("n"))
        hot = hot_keys(minima, "u", "n", minima.observed["most"])
        proposals = ws.keep(
            hot_join(graph, minima.select("u", "m"), "u", hot)
            .select(F.col("v").alias("x"), "m")
            .unionByName(minima.select(F.col("u").alias("x"), "m"))
            .distinct()
        )
        chosen = proposals.groupBy("x").agg(F.min("m").alias("low"), F.max(F.col("m") == F.col("x")).alias("stays"), F.count("*").alias("n"))
        chosen = ws.keep(chosen, most=F.max("n"), leave=F.count_if(~F.col("stays")))
        ws.drop(graph, minima)
        forest.append((chosen.where("not stays").select(F.col("x").alias("child"), F.col("low").alias("parent")), chosen.observed["leave"]))
        hot = hot_keys(chosen, "x", "n", chosen.observed["most"])
        several = chosen.where("n > 1").select("x", "low")
        graph = ws.keep(_symmetric(hot_join(proposals, several, "x", hot).select(F.col("m").alias("u"), F.col("low").alias("v"))), size=count)
        ws.drop(proposals)
    else:
        raise RuntimeError("the graph did not shrink to its seeds")
    if not forest:
        return spark.createDataFrame([], "vertex long, seed long")

    children = reduce(DataFrame.unionByName, [t.select(F.col("child").alias("vertex")) for t, _ in forest])
    parents = reduce(DataFrame.unionByName, [t.select(F.col("parent").alias("vertex")) for t, _ in forest]).distinct()
    labels = ws.keep(parents.join(children, "vertex", "left_anti").select("vertex", F.col("vertex").alias("seed")))
    flowed = [labels]
    for tree, size in reversed(forest):
        known = reduce(DataFrame.unionByName, flowed).withColumnRenamed("vertex", "parent")
        hot = hot_keys(tree.groupBy("parent").agg(F.count("*").alias("n")), "parent", "n", size if size <= HOT_ROWS else None)
        flowed.append(ws.keep(hot_join(tree, known, "parent", hot).select(F.col("child").alias("vertex"), "seed")))
    return reduce(DataFrame.unionByName, flowed)


def match_groups(rows: DataFrame, members: str, ws: Workspace, seed: int = 0) -> DataFrame:
    """(image_path, group_path) from rows whose array column ``members`` holds values that are linked with each other.

    Values meet as 64-bit hashes. The dictionary of values shows any collision; then another seed is taken, so that
    the result is exact. ``group_path`` is the smallest value (by code points) of the group; a value without a
    partner is its own group. Null and empty arrays, and null values in them, add nothing.
    """
    # written once: what makes the members may be costly, and they are read for the dictionary and for the edges
    clean = ws.keep(rows.select(F.array_distinct(F.array_compact(F.col(members))).alias("m")).where(F.size("m") > 0))
    while True:
        h = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        names = clean.select(F.explode("m").alias("image_path")).groupBy(h(F.col("image_path")).alias("vertex")).agg(F.min("image_path").alias("image_path"), F.max("image_path").alias("other"))
        names = ws.keep(names, met=F.count_if(F.col("image_path") != F.col("other")))
        if not names.observed["met"]:
            break
        ws.drop(names)
        seed += 1
    names = names.drop("other")
    # all values of a row are linked, so a star around one of them links them alike with n - 1 edges instead of n squared
    edges = clean.where(F.size("m") > 1).select(h(F.array_min("m")).alias("u"), F.explode(F.transform("m", h)).alias("v"))
    labels = seed_tree_components(edges, ws)
    named = ws.keep(names.join(labels, "vertex", "left").select("image_path", F.coalesce("seed", "vertex").alias("seed")))
    groups = ws.keep(named.groupBy("seed").agg(F.min("image_path").alias("group_path"), F.count("*").alias("n")), most=F.max("n"))
    hot = hot_keys(groups, "seed", "n", groups.observed["most"] or 0)
    return hot_join(named, groups.select("seed", "group_path"), "seed", hot).select("image_path", "group_path")
