"""Scalar functions on names, paths, numbers and tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.moves import extension
from ..registry import Registry, table
from .storage import DUPLICATES, PACKED_SQL

REGISTRY = Registry()
Q = REGISTRY.add


@Q("f01_suffix", r"SELECT row_id, lower(regexp_extract(regexp_extract(image_path, '[^/]*$'), '^.+(\.[^.]+)$', 1)) AS suffix FROM train WHERE image_path IS NOT NULL")
def f01(spark, sf):
    return table(spark, sf, "train").where("image_path IS NOT NULL").select("row_id", extension(F.col("image_path")).alias("suffix"))


@Q("s03_count_by_extension", r"SELECT count(*) FILTER (regexp_matches(lower(image_path), '\.(png|jpe?g)$')) AS manifest, count(*) FILTER (regexp_matches(lower(image_path), '\.(png|jpe?g|bmp|webp)$')) AS eda, count(*) FILTER (regexp_matches(lower(image_path), '\.(png|jpe?g|bmp|webp|tiff?)$')) AS summary FROM train")
def s03(spark, sf):
    """The three extension sets count differently on purpose."""
    p = F.lower("image_path")
    return table(spark, sf, "train").agg(*[F.count_if(p.rlike(rf"\.({e})$")).alias(n) for n, e in (("manifest", "png|jpe?g"), ("eda", "png|jpe?g|bmp|webp"), ("summary", "png|jpe?g|bmp|webp|tiff?"))])


@Q("f04_name_parts", r"SELECT row_id, regexp_extract(image_path, '[^/]*$') AS name, regexp_replace(regexp_extract(image_path, '[^/]*$'), '\.[^.]*$', '') AS stem, regexp_extract(image_path, '([^/]*)/[^/]*$', 1) AS parent FROM train WHERE image_path IS NOT NULL")
def f04(spark, sf):
    name = F.element_at(F.split("image_path", "/"), -1)
    return table(spark, sf, "train").where("image_path IS NOT NULL").select("row_id", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract("image_path", "([^/]*)/[^/]*$", 1).alias("parent"))


@Q("f05_class_from_name", r"SELECT file_id, regexp_replace(replace('duplicates_' || split_part(image_path, '/', 2) || strftime(written_at, '_%Y%m%d_%H%M%S'), 'duplicates_', ''), '_\d{8}_\d{6}$', '') AS clase FROM annot_files")
def f05(spark, sf):
    """Class name of a result file duplicates_<class>_<date>_<time>."""
    name = F.concat(F.lit("duplicates_"), F.split_part("image_path", F.lit("/"), F.lit(2)), F.date_format("written_at", "_yyyyMMdd_HHmmss"))
    return table(spark, sf, "annot_files").select("file_id", F.regexp_replace(F.replace(name, F.lit("duplicates_"), F.lit("")), r"_\d{8}_\d{6}$", "").alias("clase"))


@Q("f08_slug", "SELECT c_custkey, regexp_replace(replace(lower(c_name || ' ' || c_mktsegment), ' ', '-'), '[^a-z0-9-]', '', 'g') AS slug FROM customer")
def f08(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.regexp_replace(F.replace(F.lower(F.concat("c_name", F.lit(" "), "c_mktsegment")), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "").alias("slug"))


@Q("f07_dataset_name", "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS name FROM part")
def f07(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("name"))


@Q("p17_path_parts", "SELECT row_id, coalesce(nullif(split_part(image_path, '/', 2), ''), '?') AS clase, coalesce(nullif(split_part(image_path, '/', 3), ''), '?') AS tipo FROM train WHERE image_path IS NOT NULL")
def p17(spark, sf):
    part = lambda k: F.coalesce(F.nullif(F.split_part("image_path", F.lit("/"), F.lit(k)), F.lit("")), F.lit("?"))
    return table(spark, sf, "train").where("image_path IS NOT NULL").select("row_id", part(2).alias("clase"), part(3).alias("tipo"))


@Q("f10_stratum_key", "SELECT row_id, label || '_' || environment AS stratum FROM train")
def f10(spark, sf):
    """Label and environment; null if either is."""
    return table(spark, sf, "train").select("row_id", F.concat("label", F.lit("_"), "environment").alias("stratum"))


@Q("f13_trailing_number", r"SELECT row_id, nullif(regexp_extract(regexp_replace(image_path, '\.[^.]*$', ''), '_(\d{1,18})$', 1), '')::BIGINT AS number FROM train")
def f13(spark, sf):
    stem = F.regexp_replace("image_path", r"\.[^.]*$", "")
    return table(spark, sf, "train").select("row_id", stem.alias("s")).select("row_id", F.nullif(F.regexp_extract("s", r"_(\d{1,18})$", 1), F.lit("")).cast("bigint").alias("number"))


@Q("f15_thousands", "SELECT o_orderkey, format('{:,}', o_custkey * 1000 + o_orderkey) AS text FROM orders")
def f15(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.format_string("%,d", F.col("o_custkey") * 1000 + F.col("o_orderkey")).alias("text"))


@Q("f17_json_roundtrip", "SELECT event_id, (props->>'$.k')::INT AS k, '{\"k\":' || (props->>'$.k') || '}' AS text FROM events")
def f17(spark, sf):
    parsed = F.from_json("props", "k int")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("text"))


@Q("f18_timestamp_format", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, ts::TIMESTAMP AS back FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def f18(spark, sf):
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    return table(spark, sf, "events").select("event_id", stamp.alias("stamp"), F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz").alias("back"))


@Q("f20_comma_list", "SELECT p_partkey, list_filter(list_transform(string_split(p_brand || ' , ' || p_type || ',,' || p_size, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM part")
def f20(spark, sf):
    text = F.concat("p_brand", F.lit(" , "), "p_type", F.lit(",,"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "").alias("items"))


@Q("f21_content_hash", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def f21(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@Q("f23_url_parts", r"SELECT s_suppkey, 'root' AS who, regexp_extract(u, '^ssh://([^@]+)@([^:/]+):(\d+)', 2) AS host, regexp_extract(u, '^ssh://([^@]+)@([^:/]+):(\d+)', 3)::INT AS port FROM (SELECT s_suppkey, 'ssh://root@' || lower(replace(s_name, '#', '-')) || ':' || (s_suppkey + 1000) AS u FROM supplier)")
def f23(spark, sf):
    url = F.concat(F.lit("ssh://root@"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(":"), (F.col("s_suppkey") + 1000).cast("string"))
    part = lambda k: F.regexp_extract(url, r"^ssh://([^@]+)@([^:/]+):(\d+)", k)
    return table(spark, sf, "supplier").select("s_suppkey", part(1).alias("who"), part(2).alias("host"), part(3).cast("int").alias("port"))


@Q("f25_pad", "SELECT n_nationkey, rpad(n_name, 20, ' ') || '|' || lpad(n_regionkey::VARCHAR, 6, ' ') AS line FROM nation")
def f25(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.concat(F.rpad("n_name", 20, " "), F.lit("|"), F.lpad(F.col("n_regionkey").cast("string"), 6, " ")).alias("line"))


@Q("f27_zscore", "SELECT vec_id, list_transform(embedding, lambda x: round_even((x::DOUBLE / 255 - 0.485) / 0.229, 6)) AS z FROM embeddings")
def f27(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.bround((x.cast("double") / 255 - 0.485) / 0.229, 6)).alias("z"))


@Q("f29_tensor_range", "SELECT vec_id, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings")
def f29(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.array_min("embedding").cast("double").alias("low"), F.array_max("embedding").cast("double").alias("high"))


@Q("a34_second_difference", """WITH d AS (SELECT vec_id, unnest(list_transform(range(2, 64), lambda i: embedding[i - 1]::DOUBLE - 2 * embedding[i]::DOUBLE + embedding[i + 1]::DOUBLE)) AS x FROM embeddings)
   SELECT vec_id, round_even(var_pop(x), 6) AS sharpness FROM d GROUP BY vec_id""")
def a34(spark, sf):
    """Twin of the sharpness measure: population variance of the second difference, inside each row."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    d = F.transform(F.sequence(F.lit(2), F.lit(63)), lambda i: at(i - 1) - 2 * at(i) + at(i + 1))
    n = F.lit(62.0)
    mean = F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / n
    return (
        table(spark, sf, "embeddings").select("vec_id", d.alias("d")).withColumn("m", mean)
        .select("vec_id", F.bround(F.aggregate("d", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / n, 6).alias("sharpness"))
    )


@Q("l09_truncate", "SELECT doc_id, CASE WHEN length(text) > 110 THEN left(text, 110) || '...' ELSE text END AS head FROM documents")
def l09(spark, sf):
    """Texts cut to 110 characters for display."""
    return table(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 110, F.concat(F.left("text", F.lit(110)), F.lit("..."))).otherwise(F.col("text")).alias("head"))


@Q("k03_duplicate_csv", "WITH x AS (" + PACKED_SQL.strip() + "), g AS (SELECT row_id, list(image_path ORDER BY pos) AS v FROM x GROUP BY row_id) SELECT row_id, coalesce(original_path, '') || '|' || array_to_string(v, '|') AS record FROM g JOIN " + DUPLICATES + " USING (row_id)")
def k03(spark, sf):
    """The record that a duplicate CSV would hold: original, then the parsed list (compared as values, not as JSON text)."""
    from ..operators.packed import packed_values

    d = table(spark, sf, DUPLICATES).select("row_id", "original_path", packed_values(F.col("duplicate_paths")).alias("v")).where(F.size("v") > 0)
    back = F.from_json(F.to_json("v"), "array<string>")
    return d.select("row_id", F.concat(F.coalesce("original_path", F.lit("")), F.lit("|"), F.array_join(back, "|")).alias("record"))


_PAR = "('0x' || substr(md5('42:{t}:' || row_id), 1, 6))::BIGINT / 16777216.0::DOUBLE"


@Q("i02_transform_parameters", f"""SELECT row_id, {_PAR.format(t='h')} < 0.5 AS h_flip, {_PAR.format(t='v')} < 0.5 AS v_flip, round_even(({_PAR.format(t='r')} * 2 - 1) * 15, 6) AS angle,
   round_even(1 + ({_PAR.format(t='b')} * 2 - 1) * 0.1, 6) AS brightness, round_even(1 + ({_PAR.format(t='c')} * 2 - 1) * 0.1, 6) AS contrast FROM train""")
def i02(spark, sf):
    """Pseudo-random parameters of the training pipeline, from a hash of seed, parameter and row."""
    u = lambda t: F.conv(F.substring(F.md5(F.concat(F.lit(f"42:{t}:"), F.col("row_id").cast("string"))), 1, 6), 16, 10).cast("double") / 16777216.0
    return table(spark, sf, "train").select(
        "row_id", (u("h") < 0.5).alias("h_flip"), (u("v") < 0.5).alias("v_flip"), F.bround((u("r") * 2 - 1) * 15, 6).alias("angle"),
        F.bround(1 + (u("b") * 2 - 1) * 0.1, 6).alias("brightness"), F.bround(1 + (u("c") * 2 - 1) * 0.1, 6).alias("contrast"),
    )
