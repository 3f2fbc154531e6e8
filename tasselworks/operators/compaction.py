"""Consolidating small files: partition-local compaction with snapshot versions and conflict checks.

A table is a directory of parquet files, flat or with any number of ``column=value`` levels. Appending writers put
files into it as they like. ``compact`` lists the files, takes the partitions that hold more than a number of small
ones, and rewrites the small files of these partitions only. What it writes goes beside the old files, into an area
of the version it prepares, with dynamic partition overwrite, so that a write that is tried again after lost executors
replaces its own leavings partition by partition. Then it lists again: if a file it has read is gone or has changed,
or another version has appeared, it raises ``ConflictError`` and removes its area. Otherwise it publishes the version,
a manifest that says which files are replaced and which areas count, by a rename that only one writer can win.

Readers follow the newest manifest: all files that no version has replaced. A file that is appended at any moment is
in no manifest's list and therefore stays, also between the check and the publication. A writer that dies leaves an
area that no manifest names; it blocks nobody, and ``vacuum`` removes it together with replaced files.

The files of a partition are cut into slots of even bytes by a running sum over the listing, and a row goes to its
slot's task by partition id, so sizes follow ``target_bytes`` and no task gets two slots. Data are shuffled once; the
listing is made by Spark's file index and stays a DataFrame; only one row a rewritten partition reaches the driver.

Defined results: every row is there exactly once, repeated rows as often as before; null and empty partition values
share the null partition; files without rows vanish; an empty table stays empty; files with differing columns are
merged, a column that a file lacks is null; a data column that repeats a partition column's name raises ValueError, as
do directories of different partition columns. Appends need no protocol; files must not be deleted or rewritten by
hand, use a version.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import Workspace

TARGET_BYTES = 128 * 1024 * 1024
SMALL_BYTES = 32 * 1024 * 1024
MAX_SMALL_FILES = 4
#: Files of one hash bucket of a partition's running sum.
BUCKET_FILES = 100_000
#: Up to so many replaced files (about 200 bytes each) their slots are broadcast; beyond, rows meet them by a shuffle.
BROADCAST_FILES = 100_000
ATTEMPTS = 2
NULL_VALUE = "__HIVE_DEFAULT_PARTITION__"
_VERSIONS, _AREAS = "_versions", "_compacted"
FILES = "area string, directory string, file string, bytes long, changed timestamp"


class ConflictError(RuntimeError):
    """The table changed between the snapshot and the publication."""


@contextmanager
def _few_tasks(spark: SparkSession):
    """Listings are split by the number of cores, not by the bytes of the files that are listed."""
    names = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": str(1 << 60)}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def partition_columns(directories: list[str]) -> list[str]:
    """The columns of ``a=1/b=2`` directories, which must agree."""
    found = {tuple(level.partition("=")[0] for level in d.split("/") if level) for d in directories}
    if len(found) > 1:
        raise ValueError(f"directories of different partition columns: {sorted(found)[:3]}")
    return [unquote(c) for c in next(iter(found), ())]


def partition_value(directory: Column, level: int) -> Column:
    """The value at a level (from 0) of a directory, null for the null partition."""
    raw = F.substring_index(F.get(F.split(directory, "/"), F.lit(level)), "=", -1)
    return F.when(raw != NULL_VALUE, _decoded(raw))


def _decoded(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


class VersionedTable:
    """A parquet directory with manifests beside its data."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    # ------------------------------------------------------------ manifests
    def version(self) -> int:
        """The newest published version, 0 before the first."""
        log = self._at(_VERSIONS)
        if not self._fs.exists(log):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """areas: live areas; replaced: attempts whose list of replaced files counts; rewritten: what was done."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "areas": [], "replaced": [], "rewritten": []}
        stream = self._fs.open(self._at(_VERSIONS, f"{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """Makes a version visible at once, or raises ConflictError if another writer was first."""
        jvm, name = self._jvm, f"{manifest['version']:08d}.json"
        draft = self._at(_VERSIONS, f"{name}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        once = self.spark.sparkContext._gateway.new_array(option, 1)
        once[0] = option.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(_VERSIONS, name)), once)
        except Exception as e:
            self._fs.delete(draft, False)
            raise ConflictError(f"version {manifest['version']} was published by another writer") from e

    # -------------------------------------------------------------- listings
    def _root(self, area: str) -> str:
        return f"{self.path}/{_AREAS}/{area}" if area else self.path

    def listing(self, areas: list[str], directories: list[str] | None = None) -> DataFrame:
        """(area, directory, file, bytes, changed) of all data files in the plain table ("") and the areas, or in some
        of their directories. No file is opened; the file index lists directories in parallel."""
        parts = []
        for area in areas:
            root = self._jvm.org.apache.hadoop.fs.Path(self._root(area))
            if not self._fs.exists(root):
                continue
            wanted = [self._root(area)]
            if directories is not None:
                wanted = [p for p in (f"{self._root(area)}/{d}" if d else self._root(area) for d in directories) if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(p))]
            if not wanted:
                continue
            start = self._fs.makeQualified(root).toUri().getRawPath().rstrip("/")
            raw = F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?(?=/)", "")
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(wanted)
            files = files.select(F.substring(raw, len(start) + 2, 1 << 30).alias("p"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("changed"))
            at = F.length("p") - F.length(F.substring_index("p", "/", -1))
            parts.append(
                files.select(F.lit(area).alias("area"), _decoded(F.left("p", F.greatest(at - 1, F.lit(0)))).alias("directory"), _decoded(F.substring_index("p", "/", -1)).alias("file"), "bytes", "changed")
            )
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], FILES)

    def _replaced(self, manifest: dict) -> DataFrame:
        lists = [self.spark.read.schema(f"{FILES}, slot int").parquet(f"{self.path}/{_VERSIONS}/{a}") for a in manifest["replaced"]]
        return reduce(DataFrame.unionByName, lists).select("area", "directory", "file") if lists else self.spark.createDataFrame([], "area string, directory string, file string")

    def files(self, ws: Workspace, manifest: dict | None = None) -> DataFrame:
        """The listing of all files with ``live``: no version has replaced it."""
        manifest = manifest or self.manifest()
        with _few_tasks(self.spark):
            listed = ws.keep(self.listing(["", *manifest["areas"]]))
        gone = self._replaced(manifest).withColumn("__gone", F.lit(True))
        return listed.join(gone, ["area", "directory", "file"], "left").select(*listed.columns, F.col("__gone").isNull().alias("live"))

    # --------------------------------------------------------------- readers
    def _data_schema(self, paths: list[str]) -> StructType:
        return self.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(*paths).schema

    def read(self, schema: StructType | None = None, ws: Workspace | None = None) -> DataFrame:
        """The rows of all live files. Without a schema, the files' columns are merged and partition values are text."""
        ws = ws or Workspace(self.spark, "read")
        # a directory without replaced files is read as a whole, else its live files by name: those appended since and
        # large ones
        per = self.files(ws).groupBy("area", "directory").agg(
            F.count("*").alias("n"), F.count_if("live").alias("n_live"), F.min("live").alias("whole"), F.collect_list(F.when(F.col("live"), F.col("file"))).alias("names")
        )
        found = per.where("n_live > 0").select("area", "directory", "whole", F.when(~F.col("whole"), F.col("names")).alias("names")).collect()
        columns = partition_columns([r["directory"] for r in found])
        paths: dict[str, list[str]] = {}
        for r in found:
            at = f"{self._root(r['area'])}/{r['directory']}".rstrip("/")
            paths.setdefault(r["area"], []).extend([at] if r["whole"] else [f"{at}/{name}" for name in r["names"]])
        if schema is None:
            if not paths:
                return self.spark.createDataFrame([], "empty string").drop("empty")
            data = self._data_schema([p for own in paths.values() for p in own])
            schema = StructType([*data, *[StructField(c, StringType()) for c in columns]])
        if not paths:
            return self.spark.createDataFrame([], schema)
        reads = [self.spark.read.schema(schema).option("basePath", self._root(area)).parquet(*own) for area, own in sorted(paths.items())]
        return reduce(DataFrame.unionByName, [r.select(*[F.col(f"`{f.name}`") for f in schema]) for r in reads])

    # ---------------------------------------------------------------- vacuum
    def vacuum(self, orphans_older_than: float = 86_400.0) -> int:
        """Deletes replaced files and areas of dead writers, and publishes a version without them; returns the number
        of files. Call it when no reader of an older version is left."""
        manifest = self.manifest()
        n, known = 0, {*manifest["areas"], *manifest["replaced"]}
        # file by file in the driver, as the file system's client lives there; what is streamed is bounded by a partition of the list
        for r in self._replaced(manifest).toLocalIterator():
            at = self._jvm.org.apache.hadoop.fs.Path("/".join(x for x in (self._root(r["area"]), r["directory"], r["file"]) if x))
            n += bool(self._fs.delete(at, False))
        for folder in (_AREAS, _VERSIONS):
            if self._fs.exists(self._at(folder)):
                for s in self._fs.listStatus(self._at(folder)):
                    if s.isDirectory() and s.getPath().getName() not in known and s.getModificationTime() / 1000 < time.time() - orphans_older_than:
                        self._fs.delete(s.getPath(), True)
        if manifest["replaced"]:
            self.publish(manifest | {"version": manifest["version"] + 1, "replaced": [], "rewritten": []})
        return n


def slotted(small: DataFrame, target_bytes: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(files with ``slot``, census). Slots number the new files over all partitions; those of a partition hold even bytes.

    The census has one row a partition: directory, n_files, bytes, new_files, first slot.
    """
    census = small.groupBy("directory").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("total"))
    census = census.withColumn("new_files", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(target_bytes))).cast("int")).withColumn("buckets", F.ceil(F.col("n_files") / F.lit(BUCKET_FILES)).cast("int"))
    census = ws.keep(census.withColumn("first", (F.sum("new_files").over(W.orderBy("directory")) - F.col("new_files")).cast("int")))  # a row a partition
    files = small.join(census, "directory").withColumn("b", F.pmod(F.xxhash64("file"), F.col("buckets")))
    before = files.groupBy("directory", "b").agg(F.sum("bytes").alias("s"))
    before = before.select("directory", "b", (F.sum("s").over(W.partitionBy("directory").orderBy("b")) - F.col("s")).alias("before"))
    inside = F.sum("bytes").over(W.partitionBy("directory", "b").orderBy("area", "file").rowsBetween(W.unboundedPreceding, 0))
    middle = F.col("inside") + F.col("before") - F.col("bytes") / 2
    slot = F.col("first") + F.least(F.col("new_files") - 1, F.floor(middle * F.col("new_files") / F.greatest(F.col("total"), F.lit(1)))).cast("int")
    return files.withColumn("inside", inside).join(before, ["directory", "b"]).select("area", "directory", "file", "bytes", "changed", slot.alias("slot")), census


def _check_rows(table: VersionedTable, sources: DataFrame, targets: DataFrame, area: str) -> None:
    """Raises unless the area holds as many rows as the files it replaces; only footers are read for it."""
    counts = targets.select("__at").join(sources.groupBy("__at").agg(F.count("*").alias("__n")), "__at", "left")
    total, silent = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count_if(F.col("__n").isNull())).first()
    if silent:  # files without rows, or lost ones
        names = [r["__at"].partition("/") for r in counts.where("__n IS NULL").select("__at").collect()]
        total += table.spark.read.parquet(*[f"{table._root(a)}/{rest}" for a, _, rest in names]).count()
    if (written := table.spark.read.parquet(area).count() if total else 0) != total:
        raise RuntimeError(f"{written} of {total} rows were written")


def compact(
    table: VersionedTable, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, max_small: int = MAX_SMALL_FILES, sort: tuple[str, ...] = (), before_check=None, before_publish=None
) -> dict:
    """Rewrites the small files of crowded partitions and publishes a version; returns its manifest, or the present one
    if no partition is crowded. The hooks are called between the steps (tests make conflicts with them)."""
    spark, ws = table.spark, Workspace(table.spark, "compact")
    seen = table.manifest()
    listed = ws.keep(table.files(ws, seen))
    small = listed.where(F.col("live") & (F.col("bytes") < small_bytes)).drop("live")
    crowded = small.groupBy("directory").agg(F.count("*").alias("__n")).where(F.col("__n") > max_small).select("directory")
    attempt = f"{seen['version'] + 1:08d}-{uuid.uuid4().hex[:12]}"
    plan, census = slotted(small.join(crowded, "directory", "left_semi"), target_bytes, ws)
    rewritten = census.orderBy("directory").collect()  # a row a partition that is rewritten
    if not rewritten:
        return seen
    columns = partition_columns([r["directory"] for r in rewritten])
    lists = f"{table.path}/{_VERSIONS}/{attempt}"
    area = table._root(attempt)
    try:
        plan.write.parquet(lists)
        plan = spark.read.schema(f"{FILES}, slot int").parquet(lists)
        # a directory of which every file is rewritten is read as a whole, of others the files that are
        per = listed.join(plan.select("area", "directory", "file", "slot"), ["area", "directory", "file"], "left").groupBy("area", "directory")
        per = per.agg(F.count("slot").alias("n"), F.count("*").alias("all"), F.collect_list(F.when(F.col("slot").isNotNull(), F.col("file"))).alias("names")).where("n > 0")
        paths: dict[str, list[str]] = {}
        for r in per.select("area", "directory", F.when(F.col("n") < F.col("all"), F.col("names")).alias("names")).collect():
            at = f"{table._root(r['area'])}/{r['directory']}".rstrip("/")
            paths.setdefault(r["area"], []).extend([at] if r["names"] is None else [f"{at}/{name}" for name in r["names"]])
        schema = table._data_schema([p for own in paths.values() for p in own])
        clash = {f.name for f in schema} & {*columns, "__file", "__at", "__slot"}
        if clash:
            raise ValueError(f"columns of the files clash with partition columns or names used here: {', '.join(sorted(clash))}")
        values = [partition_value(F.col("directory"), k).alias(c) for k, c in enumerate(columns)]
        inside = F.concat(F.when(F.col("directory") == "", "").otherwise(F.concat("directory", F.lit("/"))), "file")
        targets = plan.select(F.concat("area", F.lit("/"), inside).alias("__at"), F.col("slot").alias("__slot"), *values)
        if sum(r["n_files"] for r in rewritten) <= BROADCAST_FILES:
            targets = F.broadcast(targets)
        reads = []
        for name, own in sorted(paths.items()):
            start = table._fs.makeQualified(table._jvm.org.apache.hadoop.fs.Path(table._root(name))).toUri().getRawPath().rstrip("/")
            raw = F.regexp_replace(F.input_file_name(), r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?(?=/)", "")
            rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*own)
            reads.append(rows.withColumn("__at", F.concat(F.lit(f"{name}/"), _decoded(F.substring(raw, len(start) + 2, 1 << 30)))))
        # files that came after the listing have no slot and are left where they are
        sources = reduce(DataFrame.unionByName, reads)
        rows = sources.join(targets, "__at").drop("__at")
        n = sum(r["new_files"] for r in rewritten)
        rows = rows.repartitionById(n, F.col("__slot")).sortWithinPartitions(*[F.col(f"`{c}`") for c in (*columns, *sort)], "__slot").drop("__slot")
        for turn in range(ATTEMPTS):
            try:
                writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                (writer.partitionBy(*columns) if columns else rows.write.mode("overwrite")).parquet(area)
                break
            except Exception:
                if turn + 1 == ATTEMPTS:
                    raise
        _check_rows(table, sources, targets, area)
        if before_check is not None:
            before_check()
        if table.version() != seen["version"]:
            raise ConflictError(f"version {seen['version'] + 1} was published by another writer")
        with _few_tasks(spark):
            now = ws.keep(table.listing(["", *seen["areas"]], [r["directory"] for r in rewritten]))
        if not plan.join(now, ["area", "directory", "file", "bytes", "changed"], "left_anti").isEmpty():
            raise ConflictError("a file that was rewritten has changed since it was listed")
        if before_publish is not None:
            before_publish()
        done = [{"directory": r["directory"], "files_before": r["n_files"], "files_after": r["new_files"], "bytes_before": r["total"]} for r in rewritten]
        manifest = {"version": seen["version"] + 1, "areas": [*seen["areas"], attempt], "replaced": [*seen["replaced"], attempt], "rewritten": done, "at": time.time()}
        table.publish(manifest)
        return manifest
    except Exception:
        for leaving in (area, lists):
            table._fs.delete(table._jvm.org.apache.hadoop.fs.Path(leaving), True)
        raise
