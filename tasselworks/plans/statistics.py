"""Distribution, share, quantile and rollup queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import category
from ..operators import stats
from ..registry import Registry, table
from ..session import Workspace
from .common import BASE_SQL, cat_sql, listed, manifest

REGISTRY = Registry()
Q = REGISTRY.add


@Q("a01_class_env_counts", f"WITH {BASE_SQL} SELECT label, count(*) FILTER (environment = 'lab') AS lab, count(*) FILTER (environment = 'real') AS real, count(*) AS total FROM m GROUP BY label")
def a01(spark, sf):
    return stats.class_environment_counts(manifest(spark, sf))


@Q("a02_global_totals", f"WITH {BASE_SQL} SELECT count(*) FILTER (environment = 'lab') AS lab, count(*) FILTER (environment = 'real') AS real, count(*) AS total FROM m")
def a02(spark, sf):
    return stats.class_environment_counts(manifest(spark, sf)).agg(*[F.sum(c).alias(c) for c in ("lab", "real", "total")])


@Q("a03_share", "SELECT l_returnflag, l_linestatus, count(*) AS total, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS share FROM lineitem GROUP BY ALL")
def a03(spark, sf):
    return stats.with_share(table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("total")))


@Q("a04_row_share", f"""WITH {BASE_SQL} SELECT label, round_even(count(*) FILTER (environment = 'lab') * 100.0::DOUBLE / count(*), 1) AS lab_share,
   round_even(count(*) FILTER (environment = 'real') * 100.0::DOUBLE / count(*), 1) AS real_share FROM m GROUP BY label""")
def a04(spark, sf):
    c = stats.class_environment_counts(manifest(spark, sf))
    return c.select("label", stats.ratio(F.col("lab"), F.col("total"), 1).alias("lab_share"), stats.ratio(F.col("real"), F.col("total"), 1).alias("real_share"))


@Q("p13_visible_shares", f"""WITH {BASE_SQL}, k AS (SELECT label, environment, count(*) AS n FROM m GROUP BY label, environment), c AS (SELECT label, environment, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY label) AS s FROM k)
   SELECT label, environment, round_even(s, 1) AS share FROM c WHERE s > 5""")
def p13(spark, sf):
    c = manifest(spark, sf).groupBy("label", "environment").agg(F.count("*").alias("n"))
    s = F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("label"))
    return c.select("label", "environment", s.alias("s")).where("s > 5").select("label", "environment", F.bround("s", 1).alias("share"))


@Q("a08_label_frequencies", "SELECT label, count(*) AS n FROM train GROUP BY label")
def a08(spark, sf):
    return table(spark, sf, "train").groupBy("label").agg(F.count("*").alias("n"))


def _describe_sql(source, columns):
    one = "SELECT '{c}' AS \"column\", count({c}) AS n, " + ", ".join(
        f"round_even({e}, 6) AS {k}"
        for e, k in (("avg({c}::DOUBLE)", "mean"), ("stddev_samp({c}::DOUBLE)", "std"), ("min({c})::DOUBLE", "min"), ("quantile_cont({c}::DOUBLE, 0.25)", "q1"), ("quantile_cont({c}::DOUBLE, 0.5)", "median"), ("quantile_cont({c}::DOUBLE, 0.75)", "q3"), ("max({c})::DOUBLE", "max"))
    ) + " FROM {s}"
    return " UNION ALL ".join(one.format(c=c, s=source) for c in columns)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@Q("a11_describe", _describe_sql("lineitem", _LINE))
def a11(spark, sf):
    return stats.describe(table(spark, sf, "lineitem"), _LINE)


@Q("a12_min_med_max", """SELECT p_brand, min(p_size) AS smallest, round_even(quantile_cont(p_size::DOUBLE, 0.5), 6) AS median, max(p_size) AS largest,
   round_even(sum(p_size * p_retailprice) / 1e6, 3) AS mpx FROM part GROUP BY p_brand""")
def a12(spark, sf):
    """Extremes and median, with the derived scalar of P-16."""
    part = table(spark, sf, "part")
    ends = part.groupBy("p_brand").agg(F.min("p_size").alias("smallest"), F.max("p_size").alias("largest"), F.bround(F.sum(F.col("p_size") * F.col("p_retailprice")) / 1e6, 3).alias("mpx"))
    median = stats.exact_quantiles(part, ["p_brand"], "p_size", {"median": 0.5}, Workspace(spark, "a12"))
    return ends.join(F.broadcast(median), "p_brand").withColumn("median", F.bround("median", 6))


@Q("p16_derived_scalars", "SELECT p_partkey, round_even(p_size * p_retailprice / 1e6::DOUBLE, 3) AS mpx, round_even(p_retailprice / p_size, 3) AS aspect FROM part")
def p16(spark, sf):
    w, h = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.bround(w * h / 1e6, 3).alias("mpx"), F.bround(F.try_divide(w, h), 3).alias("aspect"))


@Q("a13_quality_flags", """SELECT source, count(*) AS n, count(*) FILTER (n_chars < 100) AS n_blurry, round_even(avg((n_chars < 40)::INT) * 100, 6) AS dark_share,
   round_even(avg((n_chars > 230)::INT) * 100, 6) AS bright_share FROM documents WHERE n_chars IS NOT NULL GROUP BY source""")
def a13(spark, sf):
    """Strict quality predicates (P-06) on the measured value, their counts and shares per group."""
    x = F.col("n_chars")
    share = lambda c: F.bround(F.avg(c.cast("int")) * 100, 6)
    return table(spark, sf, "documents").where(x.isNotNull()).groupBy("source").agg(F.count("*").alias("n"), F.count_if(x < 100).alias("n_blurry"), share(x < 40).alias("dark_share"), share(x > 230).alias("bright_share"))


@Q("a14_median_order", "SELECT source, round_even(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS median, row_number() OVER (ORDER BY quantile_cont(n_chars::DOUBLE, 0.5), source)::INT AS place FROM documents WHERE n_chars IS NOT NULL GROUP BY source")
def a14(spark, sf):
    g = stats.exact_quantiles(table(spark, sf, "documents"), ["source"], "n_chars", {"m": 0.5}, Workspace(spark, "a14"))
    return g.select("source", F.bround("m", 6).alias("median"), F.row_number().over(W.orderBy("m", "source")).alias("place"))


@Q("a15_imbalance", f"""WITH {BASE_SQL}, c AS (SELECT label, count(*) AS n FROM m GROUP BY label), r AS (SELECT label, n, max(n) OVER () / n AS r FROM c)
   SELECT label, n, round_even(r, 6) AS ratio, CASE WHEN r > 10 THEN 'high' WHEN r > 5 THEN 'medium' ELSE 'low' END AS band FROM r""")
def a15(spark, sf):
    return stats.imbalance(manifest(spark, sf).groupBy("label").agg(F.count("*").alias("n")), "label", "n")


@Q("a15_extremes", f"""WITH {BASE_SQL}, c AS (SELECT label, count(*) AS n FROM m GROUP BY label)
   SELECT arg_max(label, (n, label)) AS largest, arg_min(label, (n, label)) AS smallest, round_even(max(n) / min(n), 6) AS ratio FROM c""")
def a15_extremes(spark, sf):
    c = manifest(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    key = F.struct("n", "label")
    return c.agg(F.max_by("label", key).alias("largest"), F.min_by("label", key).alias("smallest"), F.bround(F.max("n") / F.min("n"), 6).alias("ratio"))


_USAGE = "r_name, n_name, c_mktsegment"


@Q("a19_usage_rollup", f"""SELECT {_USAGE}, grouping({_USAGE})::INT AS level, count(*) AS n, sum(length(c_name))::BIGINT AS bytes
   FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP ({_USAGE})""")
def a19(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return stats.usage_rollup(c, ["r_name", "n_name", "c_mktsegment"], F.length("c_name"))


@Q("a19_corpus_usage", rf"""WITH b AS (SELECT regexp_extract(image_path, '^clean/([^/]+)/', 1) AS top, regexp_extract(image_path, '^clean/[^/]+/([^/]+)/', 1) AS sub, n_bytes FROM annot_files WHERE image_path LIKE 'clean/%')
   SELECT top, sub, grouping(top, sub)::INT AS level, count(*) AS n, sum(n_bytes)::BIGINT AS bytes FROM b GROUP BY ROLLUP (top, sub)""")
def a19_corpus(spark, sf):
    rows = table(spark, sf, "annot_files").where(F.col("image_path").startswith("clean/"))
    rows = rows.select(F.regexp_extract("image_path", "^clean/([^/]+)/", 1).alias("top"), F.regexp_extract("image_path", "^clean/[^/]+/([^/]+)/", 1).alias("sub"), "n_bytes")
    return stats.usage_rollup(rows, ["top", "sub"], F.col("n_bytes"))


_SIZE_SQL = "CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1024^2 THEN printf('%.1f KB', b / 1024) WHEN b < 1024^3 THEN printf('%.1f MB', b / 1024^2) WHEN b < 1024^4 THEN printf('%.1f GB', b / 1024^3) ELSE printf('%.1f TB', b / 1024^4) END"


@Q("f14_human_size", f"WITH b AS (SELECT o_orderkey, floor(o_totalprice * o_totalprice / 8)::DOUBLE AS b FROM orders) SELECT o_orderkey, {_SIZE_SQL} AS size FROM b")
def f14(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", stats.human_size(F.floor(F.col("o_totalprice") * F.col("o_totalprice") / 8)).alias("size"))


@Q("k06_disk_report", rf"""WITH b AS (SELECT regexp_extract(image_path, '^clean/([^/]+)/', 1) AS top, n_bytes FROM annot_files WHERE image_path LIKE 'clean/%'),
   g AS (SELECT coalesce(top, 'TOTAL') AS top, count(*) AS n, sum(n_bytes)::DOUBLE AS b FROM b GROUP BY ROLLUP (top))
   SELECT top, '  ' || rpad(top, 52, ' ') || '  ' || lpad(n::VARCHAR, 6, ' ') || '  ' || lpad({_SIZE_SQL}, 10, ' ') AS line FROM g""")
def k06(spark, sf):
    """Fixed-width lines of the disk report."""
    rows = table(spark, sf, "annot_files").where(F.col("image_path").startswith("clean/")).select(F.regexp_extract("image_path", "^clean/([^/]+)/", 1).alias("top"), "n_bytes")
    g = rows.rollup("top").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).withColumn("top", F.coalesce("top", F.lit("TOTAL")))
    line = F.concat(F.lit("  "), F.rpad("top", 52, " "), F.lit("  "), F.lpad(F.col("n").cast("string"), 6, " "), F.lit("  "), F.lpad(stats.human_size(F.col("b")), 10, " "))
    return g.select("top", line.alias("line"))


@Q("a20_mean_per_line", "SELECT o_orderstatus, round_even(sum(o_totalprice) / count(*), 6) AS mean, (sum(floor(o_totalprice)::BIGINT) // count(*))::BIGINT AS floor_mean FROM orders GROUP BY o_orderstatus")
def a20(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderstatus")
    return g.agg(F.bround(F.sum("o_totalprice") / F.count("*"), 6).alias("mean"), F.expr("sum(floor(o_totalprice)) div count(*)").alias("floor_mean"))


@Q("a21_histogram", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
   SELECT least(floor((l_extendedprice - lo) * 50 / (hi - lo))::INT + 1, 50) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1""")
def a21(spark, sf):
    return stats.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50)


@Q("a22_boxplot", """WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1),
   r AS (SELECT q.*, l_quantity AS x, l_quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM lineitem JOIN q USING (l_returnflag))
   SELECT l_returnflag, round_even(q1, 6) AS q1, round_even(median, 6) AS median, round_even(q3, 6) AS q3, min(x) FILTER (inside) AS low, max(x) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS outliers
   FROM r GROUP BY ALL""")
def a22(spark, sf):
    return stats.box_plot(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@Q("a24_folder_counts", f"WITH {BASE_SQL} SELECT coalesce(label, 'TOTAL') AS folder, count(*) AS n FROM m GROUP BY ROLLUP (label)")
def a24(spark, sf):
    return manifest(spark, sf).rollup("label").agg(F.count("*").alias("n")).select(F.coalesce("label", F.lit("TOTAL")).alias("folder"), "n")


@Q("a33_column_widths", "SELECT max(length(n_name)) AS n_name, max(length(n_nationkey::VARCHAR)) AS n_nationkey, max(length(n_regionkey::VARCHAR)) AS n_regionkey FROM nation")
def a33(spark, sf):
    n = table(spark, sf, "nation")
    return n.agg(*[F.max(F.length(F.col(c).cast("string"))).cast("bigint").alias(c) for c in ("n_name", "n_nationkey", "n_regionkey")])


_MD = f"""WITH {BASE_SQL}, c AS (SELECT label, count(*) FILTER (environment = 'lab') AS lab, count(*) FILTER (environment = 'real') AS real, count(*) AS total FROM m GROUP BY label),
 w AS (SELECT greatest(5, max(length(label)))::INT AS a, greatest(3, max(length(lab::VARCHAR)))::INT AS b, greatest(4, max(length(real::VARCHAR)))::INT AS c, greatest(5, max(length(total::VARCHAR)))::INT AS d FROM c)
 SELECT 0 AS line_no, rpad('label', a, ' ') || ' | ' || rpad('lab', b, ' ') || ' | ' || rpad('real', c, ' ') || ' | ' || rpad('total', d, ' ') AS line FROM w
 UNION ALL SELECT 1, repeat('-', a) || ' | ' || repeat('-', b) || ' | ' || repeat('-', c) || ' | ' || repeat('-', d) FROM w
 UNION ALL SELECT (row_number() OVER (ORDER BY label) + 1)::INT, rpad(label, a, ' ') || ' | ' || rpad(lab::VARCHAR, b, ' ') || ' | ' || rpad(real::VARCHAR, w.c, ' ') || ' | ' || rpad(total::VARCHAR, d, ' ') FROM c, w"""


@Q("k05_markdown", _MD)
def k05(spark, sf):
    return stats.markdown_table(stats.class_environment_counts(manifest(spark, sf)), ["label", "lab", "real", "total"], ["label"])


@Q("l01_sorted_classes", f"WITH {BASE_SQL} SELECT label, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, label)::INT AS place FROM m GROUP BY label")
def l01(spark, sf):
    c = manifest(spark, sf).groupBy("label").agg(F.count("*").alias("total"))
    return c.withColumn("place", F.row_number().over(W.orderBy(F.desc("total"), "label")))


@Q("a32_distinct_labels", f"SELECT DISTINCT {cat_sql('label')} AS label FROM train WHERE label IS NOT NULL")
def a32(spark, sf):
    return table(spark, sf, "train").where("label IS NOT NULL").select(category(F.col("label")).alias("label")).distinct()


@Q("x06_source_union", r"""WITH a AS (SELECT image_path FROM train UNION ALL SELECT image_path FROM val UNION ALL SELECT image_path FROM test),
   s AS (SELECT DISTINCT regexp_extract(image_path, '_(corn_leaf_roboflow|maize_africa|maize_desease|maize_field|cropdg|maize_nutrient|multi_desease)_', 1) AS source FROM a)
   SELECT string_agg(source, ', ' ORDER BY source) AS sources FROM s WHERE source <> ''""")
def x06(spark, sf):
    """Distinct union of the source names, sorted and joined (X-06, F-28)."""
    s = listed(spark, sf).select(F.regexp_extract("image_path", "_(corn_leaf_roboflow|maize_africa|maize_desease|maize_field|cropdg|maize_nutrient|multi_desease)_", 1).alias("s")).where("s <> ''")
    return s.agg(F.array_join(F.array_sort(F.collect_set("s")), ", ").alias("sources"))
