"""Readers and sinks: rows are written into the shared folder, read back, and compared with what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Registry, table
from ..session import Workspace
from ..sources import corpus, sinks
from .common import BASE_SQL, manifest

REGISTRY = Registry()
Q = REGISTRY.add


def _folder(spark, name):
    return f"{Workspace(spark, name).root}/files"


def _onehot(spark, sf, flags):
    """A one-hot table over the annotation files: flag n is set where file_id divided by the flags leaves n; every
    seventh path is blank."""
    path = F.when(F.col("file_id") % 7 == 0, F.lit(" ")).otherwise(F.col("file_path"))
    cells = [(F.col("file_id") % len(flags) == n).cast("int").cast("string").alias(f) for n, f in enumerate(flags)]
    return table(spark, sf, "annot_files").select(F.col("file_id").alias("imgID_id"), path.alias("filePath"), *cells)


def _read_onehot(spark, sf, name, flags, fixed):
    at = _folder(spark, name)
    _onehot(spark, sf, flags).write.option("header", True).csv(at)
    rows, found = corpus.onehot_csv(spark, at, fixed)
    long = rows.select(F.col("imgID_id").cast("bigint").alias("id"), F.explode(F.array(*[F.when(F.coalesce(c, F.lit("0")) == "1", F.lit(c)) for c in found])).alias("flag"))
    return long.where("flag IS NOT NULL")


_DYNAMIC = ("rust", "blight", "healthy")
_onehot_sql = lambda flags: f"SELECT file_id AS id, [{', '.join(repr(f) for f in flags)}][file_id % {len(flags)} + 1] AS flag FROM annot_files WHERE file_id % 7 <> 0 AND trim(file_path) <> ''"


@Q("s10_onehot_dynamic", _onehot_sql(_DYNAMIC))
def s10(spark, sf):
    """Flag columns are those that the header has besides the id and the path."""
    return _read_onehot(spark, sf, "s10", _DYNAMIC, False)


@Q("s11_onehot_fixed", _onehot_sql(corpus.ONEHOT_FIXED))
def s11(spark, sf):
    """The eight known flag columns."""
    return _read_onehot(spark, sf, "s11", corpus.ONEHOT_FIXED, True)


def _groups(spark, sf, label):
    names = F.array(F.concat("c_name", F.lit(f'/{label} "1", x.jpg')), F.concat("c_mktsegment", F.lit(".jpg")))
    return table(spark, sf, "customer").select(F.col("c_name").alias("keeper"), F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(names).alias("dups"))


_GROUPS_SQL = """SELECT '{label}' AS clase, c_name AS original_path, unnest([c_name || '/{label} "1", x.jpg', c_mktsegment || '.jpg']) AS dup FROM customer WHERE c_custkey % 3 <> 0"""


@Q("s12_duplicate_reader", "SELECT original_path, dup FROM (" + _GROUPS_SQL.format(label="healthy") + ")")
def s12(spark, sf):
    """Duplicate lists as they are written (K-03) and read: quotes doubled, JSON arrays, empty lists dropped."""
    at = _folder(spark, "s12")
    sinks.write_duplicates(_groups(spark, sf, "healthy"), at)
    return corpus.duplicate_csvs(spark, at).select("original_path", F.explode("dups").alias("dup"))


@Q("s13_latest_file", "SELECT regexp_extract(shard_path, '^(.*)/[^/]*$', 1) AS folder, max(shard_path) AS shard_path FROM train WHERE shard_path IS NOT NULL GROUP BY 1")
def s13(spark, sf):
    """The file with the largest name in every folder."""
    files = table(spark, sf, "train").where("shard_path IS NOT NULL").select("shard_path", F.regexp_extract("shard_path", "^(.*)/[^/]*$", 1).alias("folder"))
    return corpus.latest_file(files, "shard_path", "folder")


@Q("s14_class_of_file", " UNION ALL ".join(_GROUPS_SQL.format(label=c) for c in ("healthy", "common_rust")))
def s14(spark, sf):
    """Several result files read as one; the class comes from the file's name."""
    at, jvm = _folder(spark, "s14"), spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for label in ("healthy", "common_rust"):
        sinks.write_duplicates(_groups(spark, sf, label).coalesce(1), f"{at}/{label}")
        written = next(s.getPath() for s in fs.listStatus(path(f"{at}/{label}")) if s.getPath().getName().endswith(".csv"))
        fs.rename(written, path(f"{at}/duplicates_{label}_20260608_193638.csv"))
        fs.delete(path(f"{at}/{label}"), True)
    return corpus.duplicate_csvs(spark, at).select("clase", "original_path", F.explode("dups").alias("dup"))


def _written_splits(spark, sf, name):
    at = _folder(spark, name)
    sinks.write_splits(manifest(spark, sf).select("image_path", "label", "environment", "split"), at)
    return at


@Q("k01_split_files", f"WITH {BASE_SQL} SELECT split, label, environment, count(*) AS n, count(DISTINCT image_path) AS n_paths FROM m GROUP BY ALL")
def k01(spark, sf):
    """The split manifests, written as CSV in a folder a split and read back whole."""
    back = spark.read.schema(corpus.MANIFEST_SCHEMA + ", split string").option("header", True).csv(_written_splits(spark, sf, "k01"))
    return back.groupBy("split", "label", "environment").agg(F.count("*").alias("n"), F.count_distinct("image_path").alias("n_paths"))


@Q("s15_manifest_csv", f"WITH {BASE_SQL} SELECT image_path, label, environment FROM m WHERE split = 'train'")
def s15(spark, sf):
    """One split's manifest with its fixed schema."""
    return corpus.manifest_csv(spark, f"{_written_splits(spark, sf, 's15')}/split=train")


@Q("s16_manifest_labels", f"WITH {BASE_SQL} SELECT DISTINCT label FROM m WHERE split = 'val'")
def s16(spark, sf):
    """The labels of a written manifest."""
    return corpus.manifest_csv(spark, f"{_written_splits(spark, sf, 's16')}/split=val").select("label").distinct()


@Q("k02_report_csv", f"WITH {BASE_SQL} SELECT label, environment, count(*) AS n FROM m GROUP BY ALL")
def k02(spark, sf):
    """A report of a few rows as one CSV file."""
    at = _folder(spark, "k02")
    sinks.write_report(manifest(spark, sf).groupBy("label", "environment").agg(F.count("*").alias("n")), at)
    return spark.read.schema("label string, environment string, n long").option("header", True).csv(at)
