"""Reproducible sample that stays stable as data grows: a persisted ledger of selected keys.

A key is the 60-bit hash of an image path, and its own priority; all rows of a selected path are in the sample. The
ledger is a folder that outlives the session: a table of every key seen so far (with its quota group, the day it was
first loaded and whether it is selected), extended by a part a version and published by a manifest, so that of two
writers one wins and a dead one leaves nothing that counts. ``extend`` joins the keys of new rows with the ledger,
keeps whatever is there as it is, and decides on unseen keys only.

A period is a day of loading. Unseen keys below ``rate`` of the hash range go in as soon as they are seen. When a period
has closed, its further unseen keys follow, lowest hash first, until the label's quota, ceil(rate x keys so far), is
met. What a period adds depends on the counts before it and on its own keys, so all periods are settled in one pass
over the counts, and a run over days 1 to n followed by a run over the rest gives what one run over all gives. The
newest period of a run is open, as more rows of that day may come: there each key is decided by itself, so that a run
that knows fewer rows selects a subset of what a run that knows more selects, even if it has no ledger to start from.
A caller who knows that the newest period is complete closes it with ``close``; the ledger then keeps what it took.

The label of a key is its smallest normalised label in its first load; the ledger remembers it, so a key never moves
between quotas. Defined results: rows with a null or blank path have no key and are never selected; keys without a
label form a quota of their own; rows without a load time count as loaded before all others; repeated rows of a path
go in together; a label may exceed its quota by what the hash gave it, a selected key is never dropped; a key that is
no longer among the rows stays in the ledger; an empty table leaves the ledger as it was.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import category
from ..operators.compaction import VersionedTable
from ..operators.skew import hot_join, hot_keys
from ..session import Workspace

#: Bits of the hash that one level of the search for the lowest keys looks at, and the number of levels.
LEVEL_BITS, LEVELS = 10, 2
LEDGER = "key long, stratum string, day date, selected boolean, version int"
EVER = "1900-01-01"


def path_key(path: Column, seed: int) -> Column:
    """60 bits of md5, the same in every engine; two paths that share a key go in or out together."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), path)), 1, 15), 16, 10).cast("bigint")


def keyed(rows: DataFrame, path: str, label: str, loaded: str, seed: int = 42) -> DataFrame:
    """(key, stratum, day): the keys of the rows, partially combined before the shuffle."""
    tag = F.coalesce(category(F.col(label)), F.lit(""))
    first = F.min(F.struct(F.col(loaded).alias("t"), tag.alias("s")))
    keys = rows.where(F.trim(path) != "").groupBy(path_key(F.col(path), seed).alias("key")).agg(first.alias("f"))
    return keys.select("key", F.col("f.s").alias("stratum"), F.coalesce(F.col("f.t").cast("date"), F.lit(EVER).cast("date")).alias("day"))


class Ledger:
    """The folder of a ledger. Every version adds a part to those before it; all parts of the newest are the ledger."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, VersionedTable(spark, path)

    def load(self) -> tuple[DataFrame, int]:
        """(ledger, version); an empty one of version 0 where none was saved."""
        manifest = self.store.manifest()
        if not manifest["areas"]:
            return self.spark.createDataFrame([], LEDGER), manifest["version"]
        return self.spark.read.schema(LEDGER).parquet(*[self.store._root(a) for a in manifest["areas"]]), manifest["version"]

    def append(self, part: DataFrame, version: int) -> None:
        """Publishes ``version``: the ledger before it and this part. Raises ConflictError if another writer has it."""
        manifest = self.store.manifest(version - 1)
        area = f"{version:08d}-{uuid.uuid4().hex[:12]}"
        part.withColumn("version", F.lit(version)).write.parquet(self.store._root(area))
        self.store.publish(manifest | {"version": version, "areas": [*manifest["areas"], area]})

    def extend(self, rows: DataFrame, rate: float, ws: Workspace, path: str = "image_path", label: str = "label", loaded: str = "loaded_at", seed: int = 42, close: bool = False) -> int:
        """Adds the unseen keys of ``rows`` and returns the version. Rows that an earlier version has seen may be given
        again or left out: they change nothing."""
        held, version = self.load()
        fresh = keyed(rows, path, label, loaded, seed).join(held.select("key"), "key", "left_anti")
        fresh = ws.keep(fresh.withColumn("low", F.col("key") < int(rate * 2**60)), n=F.count(F.lit(1)), newest=F.max("day"))
        if not fresh.observed["n"]:
            return version
        # a row a label and day
        counts = fresh.groupBy("stratum", "day").agg(F.count("*").alias("n"), F.count_if("low").alias("sure"))
        before = held.groupBy("stratum").agg(F.count("*").alias("had"), F.count_if("selected").alias("got"))
        counts = counts.join(before, "stratum", "left").fillna(0, ["had", "got"])
        plan = ws.keep(counts.groupBy("stratum").applyInPandas(_settle(rate), "stratum string, day date, fill long").where("fill > 0"))
        if not close:
            plan = plan.where(F.col("day") < F.lit(fresh.observed["newest"]))
        added = lowest(fresh.where("NOT low"), plan, ws)
        part = fresh.join(added.withColumn("filled", F.lit(True)), "key", "left")
        self.append(part.select("key", "stratum", "day", (F.col("low") | F.col("filled").isNotNull()).alias("selected")), version + 1)
        return version + 1


def _settle(rate: float):
    def run(days: pd.DataFrame) -> pd.DataFrame:
        """How many keys each day of a label must add beyond those that are sure."""
        days = days.sort_values("day")
        seen, taken, fill = int(days["had"].iloc[0]), int(days["got"].iloc[0]), []
        for n, sure in zip(days["n"], days["sure"]):
            seen, taken = seen + n, taken + sure
            more = min(max(math.ceil(seen * rate) - taken, 0), n - sure)
            taken += more
            fill.append(more)
        return days[["stratum", "day"]].assign(fill=fill)

    return run


def lowest(keys: DataFrame, plan: DataFrame, ws: Workspace) -> DataFrame:
    """(key): of each (stratum, day) of the plan the ``fill`` lowest keys. Counts by the top bits of the hash say which
    keys are in as a whole; the one bucket on the border is looked at again by its next bits, so that what is sorted in
    one task at last is a millionth of a label's day."""
    group = ["stratum", "day"]
    rest = keys.join(plan, group)
    out = None
    for level in range(1, LEVELS + 1):
        rest = rest.withColumn("b", F.shiftright("key", 60 - LEVEL_BITS * level))
        counts = rest.groupBy(*group, "b").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(W.partitionBy(*group).orderBy("b"))
        counts = counts.withColumn("upto", upto)
        rest = ws.keep(rest.join(counts, [*group, "b"]).where(F.col("upto") - F.col("c") < F.col("fill")))
        whole = rest.where("upto <= fill").select("key")
        out = whole if out is None else out.unionByName(whole)
        rest = rest.where("upto > fill").select("key", *group, (F.col("fill") - F.col("upto") + F.col("c")).alias("fill"))
    border = rest.withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy("key"))).where("r <= fill")
    return out.unionByName(border.select("key"))


def ledger_sample(rows: DataFrame, ledger: DataFrame, path: str = "image_path", seed: int = 42) -> DataFrame:
    """Rows of selected keys, with the day on which their path was first loaded; rows of hot paths are split."""
    if "selected_in" in rows.columns:
        raise ValueError("output column 'selected_in' clashes with a column of the input")
    picked = ledger.where("selected").select(F.col("key").alias("__key"), F.col("day").cast("string").alias("selected_in"))
    rows = rows.where(F.trim(path) != "").withColumn("__key", path_key(F.col(path), seed))
    hot = hot_keys(rows.groupBy("__key").agg(F.count("*").alias("__n")), "__key", "__n")
    return hot_join(rows, picked, "__key", hot).drop("__key")
