"""Predicates, set operations and small projections that the larger queries also use, one query each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ANNOTATION_CLASSES, BASELINE_CLASSES, ENVIRONMENTS, resolve_classes
from ..functions.paths import category
from ..operators.sampling import digest_number
from ..registry import Registry, table
from .common import BASE_SQL, SPLITS, cat_sql, listed, manifest

REGISTRY = Registry()
Q = REGISTRY.add

_BASE = ", ".join(f"'{c}'" for c in BASELINE_CLASSES)


@Q("p01_allow_list", f"SELECT row_id, label FROM (SELECT row_id, {cat_sql('label')} AS label FROM train) WHERE label IN ({_BASE})")
def p01(spark, sf):
    """Classes by precedence: an empty list on the call falls through to the profile."""
    rows = table(spark, sf, "train").select("row_id", category(F.col("label")).alias("label"))
    return rows.where(F.col("label").isin(*resolve_classes([], BASELINE_CLASSES)))


@Q("p02_environments", f"SELECT row_id, environment FROM (SELECT row_id, {cat_sql('environment')} AS environment FROM test) WHERE environment IN ('lab', 'real')")
def p02(spark, sf):
    rows = table(spark, sf, "test").select("row_id", category(F.col("environment")).alias("environment"))
    return rows.where(F.col("environment").isin(*ENVIRONMENTS))


@Q("p03_extensions", r"SELECT row_id FROM train WHERE regexp_matches(lower(image_path), '\.(png|jpe?g)$')")
def p03(spark, sf):
    return table(spark, sf, "train").where(F.lower("image_path").rlike(r"\.(png|jpe?g)$")).select("row_id")


@Q("p05_name_contains", "SELECT row_id FROM train WHERE contains(regexp_extract(image_path, '[^/]*$'), 'cropdg')")
def p05(spark, sf):
    return table(spark, sf, "train").where(F.contains(F.element_at(F.split("image_path", "/"), -1), F.lit("cropdg"))).select("row_id")


@Q("p07_flagged_paths", "SELECT doc_id, image_path FROM documents WHERE n_chars < 100 AND image_path IS NOT NULL")
def p07(spark, sf):
    return table(spark, sf, "documents").where("n_chars < 100 AND image_path IS NOT NULL").select("doc_id", "image_path")


@Q("s11_filled_rows", r"SELECT doc_id FROM documents WHERE regexp_replace(coalesce(image_path, ''), '[ \t\n\r]', '', 'g') <> '' AND regexp_replace(coalesce(text, ''), '[ \t\n\r]', '', 'g') <> ''")
def s11(spark, sf):
    """Rows whose path and text are not blank (P-10)."""
    filled = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r]", "") != ""
    return table(spark, sf, "documents").where(filled("image_path") & filled("text")).select("doc_id")


@Q("p12_rate_bands", f"""WITH {BASE_SQL}, d AS (SELECT label, (count(*) - count(DISTINCT image_path)) * 100.0::DOUBLE / count(*) AS r FROM m GROUP BY label)
   SELECT label, CASE WHEN r > 30 THEN 'high' WHEN r > 10 THEN 'medium' ELSE 'low' END AS band FROM d""")
def p12(spark, sf):
    per = manifest(spark, sf).groupBy("label", "image_path").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("kept"))
    r = (F.col("n") - F.col("kept")) * 100.0 / F.col("n")
    return per.select("label", F.when(r > 30, "high").when(r > 10, "medium").otherwise("low").alias("band"))


@Q("p20_known_splits", "SELECT row_id, split_part(shard_path, '/', 3) AS split FROM val WHERE split_part(shard_path, '/', 3) IN ('train', 'valid', 'val', 'test')")
def p20(spark, sf):
    split = F.split_part("shard_path", F.lit("/"), F.lit(3))
    return table(spark, sf, "val").select("row_id", split.alias("split")).where(F.col("split").isin("train", "valid", "val", "test"))


@Q("x01_union_all", f"WITH {BASE_SQL} SELECT split, label, count(*) AS n FROM a GROUP BY ALL")
def x01(spark, sf):
    return listed(spark, sf).groupBy("split", "label").agg(F.count("*").alias("n"))


@Q("x07_distinct_paths", "SELECT image_path, max(row_id) AS last_row FROM train WHERE image_path IS NOT NULL GROUP BY image_path")
def x07(spark, sf):
    """Distinct paths, the last row of each kept."""
    return table(spark, sf, "train").where("image_path IS NOT NULL").groupBy("image_path").agg(F.max("row_id").alias("last_row"))


@Q("x08_used_numbers", r"SELECT DISTINCT regexp_extract(image_path, '_(\d{8})\.', 1) AS number FROM (SELECT image_path FROM train UNION ALL SELECT image_path FROM val UNION ALL SELECT image_path FROM test) WHERE regexp_matches(image_path, '_(\d{8})\.')")
def x08(spark, sf):
    """Union of the number suffixes in use over all destinations."""
    parts = [table(spark, sf, s).select(F.nullif(F.regexp_extract("image_path", r"_(\d{8})\.", 1), F.lit("")).alias("number")) for s in SPLITS]
    return reduce(DataFrame.unionByName, parts).where("number IS NOT NULL").distinct()


@Q("f03_relative_path", "SELECT row_id, regexp_replace(image_path, '^clean/', '') AS relative FROM train WHERE starts_with(image_path, 'clean/')")
def f03(spark, sf):
    return table(spark, sf, "train").where(F.col("image_path").startswith("clean/")).select("row_id", F.substr("image_path", F.lit(7)).alias("relative"))


@Q("f06_replace_word", "SELECT row_id, replace(image_path, '_real_', '_') AS name FROM train WHERE image_path IS NOT NULL")
def f06(spark, sf):
    return table(spark, sf, "train").where("image_path IS NOT NULL").select("row_id", F.replace("image_path", F.lit("_real_"), F.lit("_")).alias("name"))


@Q("f09_first_separator", "SELECT row_id, split_part(image_path, '/', 1) AS head FROM val WHERE image_path IS NOT NULL")
def f09(spark, sf):
    return table(spark, sf, "val").where("image_path IS NOT NULL").select("row_id", F.split("image_path", "/", 2)[0].alias("head"))


@Q("f12_integer_parse", r"SELECT file_id, CASE WHEN regexp_full_match(t, '[+-]?\d{1,9}') THEN t::INT END AS number FROM (SELECT file_id, unnest(regexp_extract_all(body, '[^ \t\r\n]+')) AS t FROM annot_files)")
def f12(spark, sf):
    """Whole numbers among all tokens of the bodies; any other token is null."""
    tokens = table(spark, sf, "annot_files").select("file_id", F.explode(F.regexp_extract_all("body", F.lit(r"[^ \t\r\n]+"), F.lit(0))).alias("t"))
    return tokens.select("file_id", F.when(F.col("t").rlike(r"\A[+-]?[0-9]{1,9}\z"), F.col("t").cast("int")).alias("number"))


@Q("f16_half_even", "SELECT p_partkey, round_even(p_retailprice / 8, 1) AS r1, round_even(p_retailprice / 8, 2) AS r2, round_even(p_size / 8, 0) AS r0 FROM part")
def f16(spark, sf):
    x, s = F.col("p_retailprice") / 8, F.col("p_size") / 8
    return table(spark, sf, "part").select("p_partkey", F.bround(x, 1).alias("r1"), F.bround(x, 2).alias("r2"), F.bround(s, 0).alias("r0"))


@Q("f19_digit_check", r"SELECT doc_id, regexp_full_match(trim(text), '\d+') AS is_number FROM documents WHERE text IS NOT NULL")
def f19(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.trim("text").rlike(r"\A[0-9]+\z").alias("is_number"))


@Q("f22_fast_hash", "SELECT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h FROM documents")
def f22(spark, sf):
    """Short content hash: 60 bits of md5, the same in every engine; null for a null text."""
    return table(spark, sf, "documents").select("doc_id", digest_number(F.col("text")).alias("h"))


@Q("f26_name_assembly", "SELECT file_id, 'leaf_' || (10000000 + file_id) || '.txt' AS name FROM annot_files")
def f26(spark, sf):
    return table(spark, sf, "annot_files").select("file_id", F.concat(F.lit("leaf_"), (F.col("file_id") + 10_000_000).cast("string"), F.lit(".txt")).alias("name"))


@Q("l04_latest_shard", "SELECT max(shard_path) AS shard_path FROM train")
def l04(spark, sf):
    return table(spark, sf, "train").agg(F.max("shard_path").alias("shard_path"))


@Q("s04_entries_per_class", rf"""SELECT split_part(image_path, '/', 2) AS label, count(*) FILTER (split_part(image_path, '/', 3) = 'lab') AS lab, count(*) FILTER (split_part(image_path, '/', 3) = 'real') AS real, count(*) AS total
   FROM train WHERE starts_with(image_path, 'clean/') AND split_part(image_path, '/', 3) IN ('lab', 'real') GROUP BY 1""")
def s04(spark, sf):
    """Every entry of the two environment folders, whatever its extension."""
    part = lambda k: F.split_part("image_path", F.lit("/"), F.lit(k))
    rows = table(spark, sf, "train").where(F.col("image_path").startswith("clean/")).select(part(2).alias("label"), part(3).alias("e")).where(F.col("e").isin(*ENVIRONMENTS))
    return rows.groupBy("label").agg(F.count_if(F.col("e") == "lab").alias("lab"), F.count_if(F.col("e") == "real").alias("real"), F.count("*").alias("total"))


@Q("s05_count_and_bytes", r"SELECT count(*) AS n, sum(n_bytes)::BIGINT AS bytes FROM annot_files WHERE regexp_matches(lower(image_path), '\.(png|jpe?g|bmp|webp|tiff?)$')")
def s05(spark, sf):
    return table(spark, sf, "annot_files").where(F.lower("image_path").rlike(r"\.(png|jpe?g|bmp|webp|tiff?)$")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))


@Q("j08_index_names", "SELECT vec_id, name FROM embeddings JOIN (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(ANNOTATION_CLASSES)) + ") v(label, name) USING (label)")
def j08(spark, sf):
    names = spark.createDataFrame(list(enumerate(ANNOTATION_CLASSES)), "label int, name string")
    return table(spark, sf, "embeddings").join(F.broadcast(names), "label").select("vec_id", "name")


@Q("j10_not_there_yet", "SELECT DISTINCT image_path FROM val WHERE image_path IS NOT NULL AND image_path NOT IN (SELECT image_path FROM train WHERE image_path IS NOT NULL)")
def j10(spark, sf):
    """Idempotence: only what the destination does not hold."""
    v = table(spark, sf, "val").where("image_path IS NOT NULL").select("image_path").distinct()
    return v.join(table(spark, sf, "train").select("image_path"), "image_path", "left_anti")
