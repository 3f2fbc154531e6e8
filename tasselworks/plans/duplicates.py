"""Exact and near duplicates, their groups, totals and removal plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import source_in_name
from ..operators import dedup
from ..operators.packed import packed_values
from ..operators.skew import hot_join, hot_keys
from ..registry import Registry, table
from ..session import Workspace
from .common import BASE_SQL, manifest
from .storage import DUPLICATES, PACKED_SQL

REGISTRY = Registry()
Q = REGISTRY.add


@Q("w02_exact_dedup", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def w02(spark, sf):
    return dedup.keep_first(table(spark, sf, "documents"), F.col("text"), ["doc_id"]).select("doc_id", "source")


@Q("u01_dedup_counters", "SELECT count(*) AS total, count(*) FILTER (text IS NULL) AS unreadable, count(DISTINCT text) AS kept, count(text) - count(DISTINCT text) AS duplicates FROM documents")
def u01(spark, sf):
    return dedup.dedup_counters(table(spark, sf, "documents"), F.col("text"))


@Q("u02_folder_dedup_plan", "SELECT doc_id, source, 'delete' AS action FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def u02(spark, sf):
    """Later copies inside one folder; unreadable rows are skipped."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "source", F.sha2(F.concat(F.sha2("text", 256), F.coalesce(F.concat(F.lit("/"), "source"), F.lit(""))), 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("k"), F.count("*").alias("n")).where("n > 1")
    later = hot_join(d, first.select("h", "k"), "h", hot_keys(first, "h", "n")).where("doc_id <> k")
    return later.select("doc_id", "source", F.lit("delete").alias("action"))


@Q("u03_sign_hash", "SELECT vec_id, array_to_string(list_transform(embedding[1:16], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings")
def u03(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", dedup.sign_hash(F.col("embedding")).alias("bits"))


_HASH16 = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN embedding[i] > 0 THEN (1 << (16 - i)) ELSE 0 END))::BIGINT"


def _hash16(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.conv(dedup.sign_hash(F.col("embedding")), 2, 10).cast("bigint").alias("h"))


#: Links by representatives: the smallest key of each hash, and its members at distance 0.
_PAIRS = f"""
e AS (SELECT vec_id, h, {{scope}} AS s FROM (SELECT *, {_HASH16} AS h FROM embeddings)), d AS (SELECT s, h, min(vec_id) AS k FROM e GROUP BY ALL),
p AS (SELECT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM d x JOIN d y ON x.h < y.h AND x.s IS NOT DISTINCT FROM y.s AND bit_count(xor(x.h, y.h)) <= {{t}}
      UNION ALL SELECT d.k, e.vec_id, 0 FROM e JOIN d ON e.h = d.h AND e.s IS NOT DISTINCT FROM d.s WHERE e.vec_id <> d.k)"""


@Q("j09_hamming_pairs", "WITH " + _PAIRS.format(t=1, scope="0") + " SELECT * FROM p")
def j09(spark, sf):
    return dedup.hamming_pairs(_hash16(spark, sf), "vec_id", "h", 16, 1)


@Q("j09_hamming_pairs_per_class", "WITH " + _PAIRS.format(t=2, scope="label") + " SELECT * FROM p")
def j09_class(spark, sf):
    return dedup.hamming_pairs(_hash16(spark, sf), "vec_id", "h", 16, 2, ["label"])


@Q("j09_equal_hash", "SELECT a, row_id AS b, 0::INT AS distance FROM train JOIN (SELECT lower(phash) AS h, min(row_id) AS a FROM train WHERE length(trim(phash)) = 16 GROUP BY 1) ON lower(phash) = h WHERE row_id <> a")
def j09_equal(spark, sf):
    """Threshold 0 over the perceptual hashes of train."""
    half = lambda a: F.conv(F.substring("phash", a, 8), 16, 10).cast("bigint")
    h = F.when(F.length(F.trim("phash")) == 16, F.shiftleft(half(1), 32).bitwiseOR(half(9)))
    return dedup.hamming_pairs(table(spark, sf, "train").withColumn("h", h), "row_id", "h", 64, 0)


_REACH = """, s AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
 r AS (SELECT x AS node, x AS other FROM s UNION SELECT r.node, s.y FROM r JOIN s ON r.other = s.x), c AS (SELECT node, min(other) AS root FROM r GROUP BY node)"""


def _components(spark, sf, name):
    return dedup.components(dedup.hamming_pairs(_hash16(spark, sf), "vec_id", "h", 16, 1), Workspace(spark, name))


@Q("u05_components", "WITH RECURSIVE " + _PAIRS.format(t=1, scope="0") + _REACH + " SELECT * FROM c")
def u05(spark, sf):
    return _components(spark, sf, "u05")


@Q("u06_removals", "WITH RECURSIVE " + _PAIRS.format(t=1, scope="0") + _REACH + " SELECT root AS keeper, node AS duplicate FROM c WHERE node <> root")
def u06(spark, sf):
    return dedup.removals(_components(spark, sf, "u06"))


@Q("l03_group_members", "WITH RECURSIVE " + _PAIRS.format(t=1, scope="0") + _REACH + " SELECT root AS keeper, list(node ORDER BY node) FILTER (node <> root) AS dups FROM c GROUP BY root")
def l03(spark, sf):
    return dedup.duplicate_groups(_components(spark, sf, "l03"))


_REPLAY = "WITH RECURSIVE x AS (" + PACKED_SQL.strip() + "), o AS (SELECT row_id, image_path FROM x UNION SELECT row_id, original_path FROM " + DUPLICATES + " WHERE trim(original_path) <> ''), f AS (SELECT row_id, min(image_path) AS a FROM o GROUP BY row_id), p AS (SELECT DISTINCT a, image_path AS b FROM o JOIN f USING (row_id) WHERE a <> image_path)" + _REACH


def _replayed(spark, sf, name):
    """Groups of the recorded duplicate lists, collapsed again over shared members (S-12, U-07)."""
    d = table(spark, sf, DUPLICATES)
    m = F.array_distinct(F.array_compact(F.concat(F.array(F.when(F.trim("original_path") != "", F.col("original_path"))), packed_values(F.col("duplicate_paths")))))
    rows = d.select(m.alias("m")).where(F.size("m") > 1)
    return dedup.components(rows.select(F.array_min("m").alias("a"), F.explode("m").alias("b")), Workspace(spark, name))


@Q("u07_replayed_removals", _REPLAY + " SELECT root AS keeper, node AS duplicate FROM c WHERE node <> root")
def u07(spark, sf):
    return dedup.removals(_replayed(spark, sf, "u07"))


@Q("a16_dup_totals", _REPLAY + " SELECT count(DISTINCT root) AS n_groups, count(*) FILTER (node <> root) AS n_remove FROM c")
def a16(spark, sf):
    per = _replayed(spark, sf, "a16").groupBy("root").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_remove"))


_SRC = "coalesce(nullif(regexp_extract('_' || regexp_replace(lower(regexp_extract({c}, '[^/]*$')), '[\\s_-]+', '_', 'g') || '_', '_(corn_leaf_roboflow|maize_nutrient|maize_desease|multi_desease|maize_africa|maize_field|cropdg)[_.]', 1), ''), 'unknown')"


@Q("a17_dup_summary", _REPLAY + ", n AS (SELECT root, " + _SRC.format(c="node") + " AS src, count(*) AS n FROM c WHERE node <> root GROUP BY ALL)"
   " SELECT root AS keeper, sum(n)::BIGINT AS eliminated, string_agg(src || ':' || n, ', ' ORDER BY src) AS sources FROM n GROUP BY root")
def a17(spark, sf):
    """Eliminated copies per group with counts per source, rendered in order of the source."""
    src = F.coalesce(source_in_name(F.col("node")), F.lit("unknown"))
    n = _replayed(spark, sf, "a17").where("node <> root").groupBy("root", src.alias("src")).agg(F.count("*").alias("n"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("src", "n"))), lambda s: F.concat(s["src"], F.lit(":"), s["n"].cast("string")))
    return n.groupBy(F.col("root").alias("keeper")).agg(F.sum("n").alias("eliminated"), F.array_join(texts, ", ").alias("sources"))


@Q("a18_dup_rate", f"""WITH {BASE_SQL}, d AS (SELECT label, count(*) - count(DISTINCT image_path) AS removed, count(DISTINCT image_path) AS kept FROM m GROUP BY label)
   SELECT label, kept, removed, round_even(removed * 100.0::DOUBLE / nullif(kept + removed, 0), 6) AS rate FROM d""")
def a18(spark, sf):
    """Copies among all rows per class; counted per path first, so no class is gathered."""
    per = manifest(spark, sf).groupBy("label", "image_path").agg(F.count("*").alias("n"))
    d = per.groupBy("label").agg(F.count("*").alias("kept"), F.sum(F.col("n") - 1).alias("removed"))
    return d.select("label", "kept", "removed", F.bround(F.try_divide(F.col("removed") * 100.0, F.col("kept") + F.col("removed")), 6).alias("rate"))


@Q("k08_delete_plan", "SELECT x AS src, CASE WHEN x IN (SELECT image_path FROM train WHERE image_path IS NOT NULL) THEN 'planned' ELSE 'missing' END AS status FROM (SELECT DISTINCT image_path AS x FROM annot_files WHERE image_path IS NOT NULL)")
def k08(spark, sf):
    """Unique paths to delete, those that are not there marked missing; nothing is deleted."""
    paths = table(spark, sf, "annot_files").where("image_path IS NOT NULL").select(F.col("image_path").alias("src")).distinct()
    there = table(spark, sf, "train").where("image_path IS NOT NULL").select(F.col("image_path").alias("src")).distinct().withColumn("there", F.lit(True))
    return paths.join(there, "src", "left").select("src", F.when(F.col("there"), "planned").otherwise("missing").alias("status"))


@Q("k07_report", _REPLAY + " SELECT root AS keeper, string_agg(regexp_extract(node, '[^/]*$'), ', ' ORDER BY node) FILTER (node <> root) AS removed FROM c GROUP BY root")
def k07(spark, sf):
    """The report's lines: the kept path and the file names that go."""
    return dedup.duplicate_groups(_replayed(spark, sf, "k07")).select("keeper", F.array_join(F.transform("dups", lambda d: F.element_at(F.split(d, "/"), -1)), ", ").alias("removed"))


@Q("j14_content_leakage", "SELECT DISTINCT t.row_id FROM train t JOIN (SELECT phash FROM val UNION SELECT phash FROM test) e ON lower(t.phash) = lower(e.phash)")
def j14(spark, sf):
    """Train rows whose content also stands in an evaluation split."""
    key = F.lower("phash")
    e = table(spark, sf, "val").select(key.alias("h")).union(table(spark, sf, "test").select(key.alias("h"))).distinct()
    return table(spark, sf, "train").select("row_id", key.alias("h")).join(e, "h", "left_semi").select("row_id")
