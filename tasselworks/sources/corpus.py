"""Scans of a corpus tree and of the text and CSV files around it. Paths become columns; bytes are read only on demand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CLASSES, ENVIRONMENTS, MANIFEST_EXTENSIONS, SUMMARY_EXTENSIONS

MANIFEST_SCHEMA = "image_path string, label string, environment string"
DUPLICATES_SCHEMA = "original_path string, duplicate_paths string"
#: The flag columns of the reader with a known header.
ONEHOT_FIXED = ("GLS", "NCLB", "PLS", "CR", "SR", "NoFoliarSymptoms", "Other", "UnidentifiedDisease")


def _suffix(extensions) -> str:
    return r"(?i)\.(" + "|".join(extensions) + ")$"


def scan_files(spark: SparkSession, root: str, content: bool = False, glob: str = "") -> DataFrame:
    """(path, relative, length[, content]) of every file below root. Without ``content`` no byte of a file is read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{base}/{glob}" if glob else base)
    plain = F.regexp_replace("path", "^file:/+", "/")
    at = F.regexp_replace(F.lit(base), "^file:/+", "/")
    relative = F.ltrim(F.substring(plain, F.length(at) + 1, F.length(plain)), F.lit("/"))
    return files.select("path", relative.alias("relative"), "length", *(["content"] if content else []))


def scan_corpus(spark: SparkSession, root: str, classes=CLASSES, environments=ENVIRONMENTS, extensions=MANIFEST_EXTENSIONS, content: bool = False) -> DataFrame:
    """Two-level scan <class>/<environment>/<file> with allow-lists (S-01): (label, environment, path, image_path,
    length[, content]). The allow-lists also go into the listing, so other folders are never entered."""
    glob = "{" + ",".join(classes) + "}/{" + ",".join(environments) + "}"
    try:
        files = scan_files(spark, root, content, glob)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ValueError(f"no pictures under {root}") from e
        raise
    plain = F.regexp_replace("path", "^file:/+", "/")
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/+", "/")
    rel = F.ltrim(F.substring(plain, F.length(base) + 1, F.length(plain)), F.lit("/"))
    parts = F.split(rel, "/")
    keep = ["content"] if content else []
    rows = files.select(F.get(parts, F.lit(0)).alias("label"), F.get(parts, F.lit(1)).alias("environment"), "path", rel.alias("image_path"), "length", *keep, F.size(parts).alias("__n"))
    return rows.where(F.col("label").isin(*classes) & F.col("environment").isin(*environments) & (F.col("__n") == 3) & F.col("image_path").rlike(_suffix(extensions))).drop("__n")


def require_pictures(manifest: DataFrame) -> DataFrame:
    """Raises on an empty corpus; looks at one row."""
    if manifest.limit(1).isEmpty():
        raise ValueError("the corpus holds no pictures")
    return manifest


def images_below(spark: SparkSession, root: str, extensions=SUMMARY_EXTENSIONS) -> DataFrame:
    """Recursive listing by extension (S-02, S-05)."""
    return scan_files(spark, root).where(F.col("relative").rlike(_suffix(extensions)))


def files_with_extension(spark: SparkSession, root: str) -> DataFrame:
    """Every file that has an extension (S-06)."""
    return scan_files(spark, root).where(F.col("relative").rlike(r"[^/]\.[^./]+$"))


def folder_usage(files: DataFrame) -> DataFrame:
    """Count and bytes per top folder and in all (S-05, A-19)."""
    return files.rollup(F.split_part("relative", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def labelled_samples(files: DataFrame, relative: str = "relative") -> DataFrame:
    """(path, label): first folder is the label, ``_unlabeled`` is null, names with a leading point are skipped (S-07)."""
    label = F.split_part(relative, F.lit("/"), F.lit(1))
    return files.where(~label.startswith(".")).select("path", F.nullif(label, F.lit("_unlabeled")).alias("label"))


def annotation_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of annotation texts, a row a file (S-08, S-09)."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def split_annotations(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "valid", "test"), folder: str = "labels") -> DataFrame:
    """(split_no, split, name, body) of the annotation texts below <root>/<split>/<folder>, the splits in the given
    order; one that is not there is skipped (S-09). Sort by split_no and name where the order matters."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for n, split in enumerate(splits):
        at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{split}/{folder}")
        if at.getFileSystem(conf).exists(at):
            parts.append(annotation_files(spark, at.toString()).select(F.lit(n).alias("split_no"), F.lit(split).alias("split"), F.substring_index("path", "/", -1).alias("name"), "body"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "split_no int, split string, name string, body string")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """Listed paths, blank lines dropped (S-18)."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Split manifest with a fixed schema (S-15, S-16); a missing file raises when it is read."""
    return spark.read.schema(MANIFEST_SCHEMA).option("header", True).csv(path)


def onehot_csv(spark: SparkSession, path: str, fixed: bool = False) -> tuple[DataFrame, list[str]]:
    """(rows, flag columns). Dynamic (S-10): every column but imgID_id and filePath. Fixed (S-11): the eight known
    ones; a missing one is an error. Rows with a blank filePath are left out."""
    df = spark.read.option("header", True).csv(path)
    flags = list(ONEHOT_FIXED) if fixed else [c for c in df.columns if c not in ("imgID_id", "filePath")]
    absent = [c for c in flags if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {', '.join(absent)}")
    return df.where(F.trim(F.coalesce("filePath", F.lit(""))) != ""), flags


def duplicate_csvs(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, clase, original_path, dups) of one or many result files; empty lists are dropped (S-12, S-14)."""
    raw = spark.read.schema(DUPLICATES_SCHEMA).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    name = F.col("_metadata.file_name")
    clase = F.regexp_replace(F.regexp_replace(name, r"\.csv$", ""), r"^duplicates_|_\d{8}_\d{6}$", "")
    dups = F.from_json("duplicate_paths", "array<string>")
    return raw.select(name.alias("file_name"), clase.alias("clase"), "original_path", dups.alias("dups")).where(F.size("dups") > 0)


def latest_file(files: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """The file with the largest name, per group or in all (S-13, L-04)."""
    g = files.groupBy(group) if group else files.groupBy()
    return g.agg(F.max(name).alias(name))
