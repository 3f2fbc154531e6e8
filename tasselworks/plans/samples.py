"""Caps, splits, draws, numbering and substitution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BASELINE_CAP, BASELINE_CLASSES
from ..functions.paths import category
from ..operators import dedup, sampling
from ..operators.prefix import global_row_number
from ..registry import Registry, table
from ..session import Workspace
from .common import BASE_SQL, cat_sql, manifest

REGISTRY = Registry()
Q = REGISTRY.add

_BASE = ", ".join(f"'{c}'" for c in BASELINE_CLASSES)
_CAPPED = f"""{BASE_SQL}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256(image_path) ORDER BY row_id) AS n FROM m WHERE label IN ({_BASE})) WHERE n = 1),
 c AS (SELECT row_id, image_path, label, environment FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || row_id), row_id) AS k FROM d) WHERE k <= {BASELINE_CAP})"""
#: Strata with a single row (which the splitter refuses) are left out before the split.
_SPLIT = """, z AS (SELECT label, environment, count(*) AS n FROM {src} GROUP BY ALL HAVING count(*) >= 2), t AS (SELECT sum(n)::BIGINT AS total FROM z),
 f AS (SELECT z.*, total, (total * 7 // 10)::BIGINT AS want FROM z, t),
 g AS (SELECT *, n * want // total AS low, n * want % total AS rest FROM f),
 h AS (SELECT *, low + (row_number() OVER (ORDER BY rest DESC, label, environment) <= want - sum(low) OVER ())::INT AS n_train FROM g),
 i AS (SELECT *, n - n_train AS lft, total - want AS rest_all, ((total - want) + 1) // 2 AS want2 FROM h),
 j AS (SELECT *, lft * want2 // rest_all AS low2, lft * want2 % rest_all AS rest2 FROM i),
 q AS (SELECT *, low2 + (row_number() OVER (ORDER BY rest2 DESC, label, environment) <= want2 - sum(low2) OVER ())::INT AS n_test FROM j),
 r AS (SELECT s.*, row_number() OVER (PARTITION BY label, environment ORDER BY sha256('42:' || row_id), row_id) AS k FROM {src} s),
 split AS (SELECT r.row_id, r.label, r.environment, CASE WHEN k <= n_train THEN 'train' WHEN k <= n_train + n_test THEN 'test' ELSE 'val' END AS split FROM r JOIN q USING (label, environment))"""


def _capped(spark, sf):
    rows = manifest(spark, sf).where(F.col("label").isin(*BASELINE_CLASSES)).select("row_id", "image_path", "label", "environment")
    once = dedup.keep_first(rows, F.col("image_path"), ["row_id"])
    return sampling.cap_per_group(once, ["label"], "row_id", BASELINE_CAP)


def _splittable(df):
    """Without strata of one row; strata are classes by environments, a bounded side."""
    alone = df.groupBy("label", "environment").agg(F.count("*").alias("n")).where("n < 2").drop("n")
    return df.join(F.broadcast(alone), ["label", "environment"], "left_anti")


@Q("w01_class_cap", f"WITH {_CAPPED} SELECT row_id, label, environment FROM c")
def w01(spark, sf):
    """The reduced profile: exact dedup by path, then at most 500 rows of each of its classes."""
    return _capped(spark, sf).select("row_id", "label", "environment")


@Q("r02_stratified_split", f"WITH {BASE_SQL}{_SPLIT.format(src='m')} SELECT * FROM split")
def r02(spark, sf):
    """70/15/15 over the whole manifest by class and environment."""
    return sampling.stratified_split(_splittable(manifest(spark, sf).select("row_id", "label", "environment")), ["label", "environment"], "row_id")


@Q("a05_split_audit", f"""WITH {_CAPPED}{_SPLIT.format(src='c')} SELECT label, environment, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count,
   count(*) FILTER (split = 'test') AS test_count, count(*) AS total_count FROM split GROUP BY label, environment""")
def a05(spark, sf):
    """Flagship: manifest, exact dedup, class cap, stratified split, audit cross-tab."""
    split = sampling.stratified_split(_splittable(_capped(spark, sf)), ["label", "environment"], "row_id")
    return sampling.split_audit(split)


@Q("a05_listed_audit", f"""WITH {BASE_SQL} SELECT label, environment, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count,
   count(*) FILTER (split = 'test') AS test_count, count(*) AS total_count FROM m GROUP BY label, environment""")
def a05_listed(spark, sf):
    return sampling.split_audit(manifest(spark, sf))


@Q("a35_split_totals", f"WITH {BASE_SQL} SELECT split, count(*) AS n FROM a GROUP BY split")
def a35(spark, sf):
    from .common import listed

    return listed(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


@Q("j01_outer_align", "WITH " + ", ".join(f"n_{s} AS (SELECT coalesce({cat_sql('label')}, '') AS label, coalesce({cat_sql('environment')}, '') AS environment, count(*) AS n FROM {s} GROUP BY ALL)" for s in ("train", "val", "test"))
   + " SELECT label, environment, coalesce(n_train.n, 0) AS n_train, coalesce(n_val.n, 0) AS n_val, coalesce(n_test.n, 0) AS n_test FROM n_train FULL JOIN n_val USING (label, environment) FULL JOIN n_test USING (label, environment)")
def j01(spark, sf):
    """Three count series aligned on class and environment; what is missing in one is 0. One aggregation in place of
    two full joins."""
    parts = [table(spark, sf, s).select(F.coalesce(category(F.col("label")), F.lit("")).alias("label"), F.coalesce(category(F.col("environment")), F.lit("")).alias("environment"), F.lit(s).alias("split")) for s in ("train", "val", "test")]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("label", "environment").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")])


@Q("r03_sample_per_class", f"WITH {BASE_SQL} SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || row_id), row_id) AS k FROM m) WHERE k <= 400")
def r03(spark, sf):
    return sampling.cap_per_group(manifest(spark, sf).select("row_id", "label"), ["label"], "row_id", 400)


@Q("r04_flagged_examples", "SELECT doc_id FROM documents WHERE n_chars < 100 ORDER BY sha256('42:' || doc_id), doc_id LIMIT 6")
def r04(spark, sf):
    """Six flagged examples in hash order (a top-k, planned without a full sort)."""
    return table(spark, sf, "documents").where("n_chars < 100").orderBy(sampling.hash_order(F.col("doc_id")), "doc_id").limit(6).select("doc_id")


_NUM = "('0x' || substr(md5('42:{t}:' || draw), 1, 15))::BIGINT"


@Q("r05_weighted_draws", f"""WITH n AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS c, count(*) OVER () AS classes FROM embeddings GROUP BY label),
   e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || vec_id), vec_id) AS k FROM embeddings),
   d AS (SELECT range AS draw FROM range((SELECT count(*) FROM embeddings))), p AS (SELECT draw, label, {_NUM.format(t='row')} % n + 1 AS k FROM d JOIN n ON c = {_NUM.format(t='class')} % classes)
   SELECT draw, label, vec_id FROM p JOIN e USING (label, k)""")
def r05(spark, sf):
    return sampling.weighted_draws(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id")


@Q("r06_shuffled_order", "SELECT p_partkey, row_number() OVER (ORDER BY sha256('42:' || p_partkey), p_partkey) AS place FROM part")
def r06(spark, sf):
    p = table(spark, sf, "part").select("p_partkey").withColumn("o", sampling.hash_order(F.col("p_partkey")))
    return global_row_number(p, ["o", "p_partkey"], "place", Workspace(spark, "r06")).select("p_partkey", "place")


@Q("w04_renumber", "SELECT p_partkey, p_name || '_' || row_number() OVER (ORDER BY p_name, p_partkey) AS new_name FROM part WHERE p_name LIKE '% %'")
def w04(spark, sf):
    """Numbers from 1 in sorted order, after the filter, over the whole table."""
    p = table(spark, sf, "part").where(F.col("p_name").contains(" ")).select("p_partkey", "p_name")
    n = global_row_number(p, ["p_name", "p_partkey"], "n", Workspace(spark, "w04"))
    return n.select("p_partkey", F.concat("p_name", F.lit("_"), F.col("n").cast("string")).alias("new_name"))


@Q("w08_batches", "SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) // 64)::BIGINT AS batch FROM part")
def w08(spark, sf):
    n = global_row_number(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], "n", Workspace(spark, "w08"))
    return n.select("p_partkey", F.floor((F.col("n") - 1) / 64).alias("batch"))


@Q("w05_next_valid", """WITH v AS (SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN event_id END AS i FROM events),
   w AS (SELECT event_id, coalesce(first_value(i IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), (SELECT min(i) FROM v)) AS src FROM v)
   SELECT w.event_id, src AS source_id, e.event_type FROM w LEFT JOIN events e ON e.event_id = src""")
def w05(spark, sf):
    """An unreadable row (event type error) takes its values from the next readable one, with wrap-around."""
    e = table(spark, sf, "events").select("event_id", F.col("event_id").alias("source_id"), "event_type")
    return sampling.next_valid(e, "event_id", F.col("event_type") != "error", ["source_id", "event_type"], Workspace(spark, "w05"))


def suffix_sql(rows: str, key: str, used: str, rounds: int = 4) -> str:
    """CTEs that end in ``suffixes`` (key, suffix): in each round a hash of the key names a number of eight digits; the
    smallest of several keys takes it if it is free. Four rounds are more than any test table needs."""
    parts = [f"todo0 AS ({rows})", f"used0 AS ({used})"]
    for n in range(rounds):
        parts += [
            f"try{n} AS (SELECT {key}, ('0x' || substr(md5('{n}:' || {key}), 1, 15))::BIGINT % 90000000 + 10000000 AS suffix FROM todo{n})",
            f"good{n} AS (SELECT {key}, suffix FROM (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY {key}) AS k FROM try{n}) WHERE k = 1 AND suffix NOT IN (SELECT suffix FROM used{n} WHERE suffix IS NOT NULL))",
            f"todo{n + 1} AS (SELECT {key} FROM todo{n} WHERE {key} NOT IN (SELECT {key} FROM good{n}))",
            f"used{n + 1} AS (SELECT suffix FROM used{n} UNION SELECT suffix FROM good{n})",
        ]
    return ", ".join(parts) + ", suffixes AS (" + " UNION ALL ".join(f"SELECT * FROM good{n}" for n in range(rounds)) + ")"


def used_sql(name: str) -> str:
    return rf"SELECT nullif(regexp_extract(image_path, '_(\d{{8}})\.', 1), '')::BIGINT AS suffix FROM {name}"


@Q("w07_unique_suffixes", f"WITH {suffix_sql('SELECT p_partkey FROM part', 'p_partkey', used_sql('train'))} SELECT * FROM suffixes")
def w07(spark, sf):
    """An eight-digit number for every part, none of them used by a picture name of train."""
    used = table(spark, sf, "train").select(F.try_to_number(F.nullif(F.regexp_extract("image_path", r"_(\d{8})\.", 1), F.lit("")), F.lit("99999999")).cast("bigint").alias("n")).where("n IS NOT NULL")
    return sampling.unique_suffixes(table(spark, sf, "part").select("p_partkey"), "p_partkey", used, "n", Workspace(spark, "w07"))


@Q("s26_view_limit", "SELECT doc_id FROM documents WHERE doc_kind = 'note' ORDER BY doc_id LIMIT 500")
def s26(spark, sf):
    return sampling.view_limit(table(spark, sf, "documents").where("doc_kind = 'note'"), "doc_id").select("doc_id")


@Q("l06_no_limit", "SELECT doc_id FROM documents WHERE doc_kind = 'note'")
def l06(spark, sf):
    """A limit of 0 or less is none."""
    return sampling.view_limit(table(spark, sf, "documents").where("doc_kind = 'note'"), "doc_id", 0).select("doc_id")


@Q("x02_sampled_union", " UNION ALL ".join(f"SELECT row_id, '{s}' AS split FROM (SELECT row_id, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || row_id), row_id) AS k FROM (SELECT row_id, {cat_sql('label')} AS label FROM {s})) WHERE k <= 50" for s in ("train", "val", "test")))
def x02(spark, sf):
    """The union of samples that are drawn from each split for itself, at most 50 of a class."""
    parts = [table(spark, sf, s).select("row_id", category(F.col("label")).alias("label"), F.lit(s).alias("split")) for s in ("train", "val", "test")]
    return reduce(DataFrame.unionByName, [sampling.cap_per_group(p, ["label"], "row_id", 50).select("row_id", "split") for p in parts])
