"""Queries of the general data problems: packed fields and small files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.compaction import MAX_SMALL_FILES, VersionedTable, compact, partition_value
from ..operators.packed import split_packed
from ..registry import Registry, table
from ..session import Workspace

REGISTRY = Registry()
DUPLICATES = "duplicates_healthy_20260608_193638"

#: Lexer of the oracle: the same grammar as the fold, written as one regular expression per value.
PACKED_SQL = rf"""
WITH s AS (
  SELECT row_id, regexp_replace(duplicate_paths, '^\s+|\s+$', '', 'g') AS s FROM {DUPLICATES} WHERE duplicate_paths IS NOT NULL
), w AS (
  SELECT row_id, CASE WHEN regexp_matches(s, '^"\s*[\[{{](?s:.*)[\]}}]\s*"$')
                      THEN regexp_replace(replace(substr(s, 2, length(s) - 2), '""', '"'), '^\s+|\s+$', '', 'g') ELSE s END AS s FROM s
), b AS (
  SELECT row_id, CASE WHEN (s[1] = '[' AND s[-1] = ']') OR (s[1] = '{{' AND s[-1] = '}}') THEN substr(s, 2, length(s) - 2) ELSE s END AS s FROM w
), t AS (
  SELECT row_id, regexp_extract_all(s, '(?:^|[,;|\n\r\t])[ ]*(?:"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|[^,;|\n\r\t]*)', 0) AS m FROM b
), v AS (
  SELECT row_id, list_transform(m, lambda x: regexp_replace(regexp_replace(x, '^[,;|\n\r\t]', ''), '^\s+|\s+$', '', 'g')) AS v FROM t
), q AS (
  SELECT row_id, list_transform(v, lambda x: CASE WHEN x[1] IN ('"', '''') AND length(x) > 1 AND x[-1] = x[1] THEN substr(x, 2, length(x) - 2) ELSE x END) AS v FROM v
), e AS (
  SELECT row_id, list_filter(list_transform(v, lambda x: trim(CASE WHEN contains(x, '\') THEN json_extract_string('["' || x || '"]', '$[0]') ELSE x END)),
                             lambda x: x <> '') AS v FROM q
)
SELECT row_id, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS image_path FROM e
"""


@REGISTRY.add("p7_found", PACKED_SQL)
def p7_found(spark, sf_dir):
    """Every single path in duplicate_paths with its position, repeated ones too."""
    rows = table(spark, sf_dir, DUPLICATES).select("row_id", "duplicate_paths")
    return split_packed(rows, "duplicate_paths", "image_path")


#: Deliveries of small files: each brings one file to every partition of which it has rows.
DELIVERIES = 64


def _delivery(c):
    """Number of the delivery that a source file came with, the same in every engine."""
    return F.coalesce(F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint"), F.lit(DELIVERIES)), F.lit(0)).cast("int")


def _land(rows, delivery, path, partitions):
    """Appends rows as small files, one a delivery and partition."""
    rows.repartitionById(DELIVERIES, delivery).sortWithinPartitions(*partitions).write.mode("append").partitionBy(*partitions).parquet(path)


def _compacted(spark, rows, file, partitions, early):
    """Two periods of small files on disk, each followed by a compaction: the table and what each version rewrote."""
    path = f"{Workspace(spark, 'p5').root}/table"
    target = VersionedTable(spark, path)
    early = F.coalesce(early, F.lit(False))
    done = []
    for period in (early, ~early):
        _land(rows.where(period), _delivery(F.col(file)), path, partitions)
        done.append(compact(target))
    return target, done


def _shard_rows(spark, sf_dir):
    """Train lines with the partition of the tiny file they came in: year and month of its folder."""
    day = F.regexp_extract("shard_path", r"/(\d{4}-\d{2})-\d{2}/[^/]*$", 1)
    rows = table(spark, sf_dir, "train")
    return rows.withColumns({"year": F.nullif(F.left(day, F.lit(4)), F.lit("")), "month": F.nullif(F.right(day, F.lit(2)), F.lit(""))})


def _annotation_rows(spark, sf_dir):
    """Annotation files by the environment folder of their picture and the year they were written in."""
    folder = F.regexp_extract(F.lower(F.regexp_replace("image_path", r"[\\]+", "/")), r"/(lab|real)/", 1)
    return table(spark, sf_dir, "annot_files").withColumns({"folder": F.nullif(folder, F.lit("")), "written": F.year("written_at").cast("string")})


TRAIN_FILES_SQL = r"""
SELECT *, nullif(regexp_extract(shard_path, '/(\d{4})-\d{2}-\d{2}/[^/]*$', 1), '') AS year, nullif(regexp_extract(shard_path, '/\d{4}-(\d{2})-\d{2}/[^/]*$', 1), '') AS month FROM train
"""


def _train_table(spark, sf_dir):
    rows = _shard_rows(spark, sf_dir)
    return (*_compacted(spark, rows, "shard_path", ["year", "month"], F.col("year") <= FIRST_PERIOD), rows.schema)


#: Lines of this year and before land first and are compacted before the others come.
FIRST_PERIOD = "2024"


@REGISTRY.add("p5_compact_train", TRAIN_FILES_SQL)
def p5_compact_train(spark, sf_dir):
    """All lines of train after their small files landed on disk and were compacted twice: every row exactly once."""
    target, _, schema = _train_table(spark, sf_dir)
    return target.read(schema)


@REGISTRY.add(
    "p5_compact_annotations",
    r"SELECT *, nullif(regexp_extract(lower(replace(image_path, chr(92), '/')), '/(lab|real)/', 1), '') AS folder, year(written_at)::VARCHAR AS written FROM annot_files",
)
def p5_compact_annotations(spark, sf_dir):
    """All annotation files, read back from few files; files that were delivered twice stay two rows."""
    rows = _annotation_rows(spark, sf_dir)
    target, _ = _compacted(spark, rows, "file_path", ["folder", "written"], F.col("written") <= FIRST_PERIOD)
    return target.read(rows.schema)


#: Files on disk as the rule has them: one a delivery and partition before; after, one a crowded partition (their bytes
#: are far below the target size at test scales), the same as before in the others.
P5_REPORT_SQL = f"""
WITH r AS (SELECT year, month, coalesce(('0x' || substr(md5(shard_path), 1, 8))::BIGINT % {DELIVERIES}, 0) AS delivery FROM ({TRAIN_FILES_SQL.strip()})),
p AS (SELECT year, month, count(DISTINCT delivery) AS files_before, count(*) AS rows FROM r GROUP BY ALL)
SELECT year, month, rows, files_before, CASE WHEN files_before > {MAX_SMALL_FILES} THEN 1 ELSE files_before END AS files_after,
       CASE WHEN files_before <= {MAX_SMALL_FILES} THEN 0 WHEN coalesce(year, '9999') <= '{FIRST_PERIOD}' OR NOT EXISTS (SELECT 1 FROM p WHERE year <= '{FIRST_PERIOD}' AND files_before > {MAX_SMALL_FILES}) THEN 1 ELSE 2 END AS version
FROM p
"""


@REGISTRY.add("p5_report", P5_REPORT_SQL)
def p5_report(spark, sf_dir):
    """Rows and files on disk per partition of train: files that landed, files that count now, and the version that
    rewrote the partition (0: it was calm)."""
    target, done, schema = _train_table(spark, sf_dir)
    rows = target.read(schema).groupBy("year", "month").agg(F.count("*").alias("rows"))
    level = lambda k: partition_value(F.col("directory"), k)
    files = target.files(Workspace(spark, "p5r")).select(level(0).alias("year"), level(1).alias("month"), "area", "live")
    files = files.groupBy("year", "month").agg(F.count_if(F.col("area") == "").alias("files_before"), F.count_if("live").alias("files_after"))
    # a row a partition that was rewritten
    versions = [(r["directory"], m["version"]) for m in {m["version"]: m for m in done}.values() for r in m["rewritten"]]
    versions = spark.createDataFrame(versions, "directory string, version int").select(level(0).alias("year"), level(1).alias("month"), "version")
    same = lambda a, b: a["year"].eqNullSafe(b["year"]) & a["month"].eqNullSafe(b["month"])
    out = rows.join(files, same(rows, files)).join(versions, same(rows, versions), "left")
    return out.select(rows["year"], rows["month"], "rows", "files_before", "files_after", F.coalesce("version", F.lit(0)).alias("version"))
