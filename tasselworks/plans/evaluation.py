"""Evaluation queries. Truth is the label a train row states, prediction the class folder of its path; for vectors,
truth is the stored label and prediction an arg-max over ten sums of dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import CLASSES
from ..functions.paths import category
from ..operators import evaluate
from ..registry import Registry, table
from .common import cat_sql

REGISTRY = Registry()
Q = REGISTRY.add

_IN = ", ".join(f"'{c}'" for c in CLASSES)
_PRED_SQL = f"p AS (SELECT * FROM (SELECT {cat_sql('label')} AS y, regexp_extract(image_path, 'clean/([a-z_]+)/', 1) AS p FROM train) WHERE y IN ({_IN}) AND p IN ({_IN}))"
_COUNT_SQL = """, l AS (SELECT y AS label FROM p UNION SELECT p FROM p), k AS (SELECT label, count(*) FILTER (y = label AND p.p = label)::DOUBLE AS tp, count(*) FILTER (y <> label AND p.p = label) AS fp, count(*) FILTER (y = label AND p.p <> label) AS fn
 FROM l JOIN p ON y = label OR p.p = label GROUP BY label),
 s AS (SELECT label, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fn)::BIGINT AS support FROM k)"""


def _predictions(spark, sf):
    rows = table(spark, sf, "train").select(category(F.col("label")).alias("y"), F.regexp_extract("image_path", "clean/([a-z_]+)/", 1).alias("p"))
    return rows.where(F.col("y").isin(*CLASSES) & F.col("p").isin(*CLASSES))


@Q("a26_accuracy", f"WITH {_PRED_SQL} SELECT round_even(avg((y = p)::INT), 6) AS accuracy, count(*) AS n FROM p")
def a26(spark, sf):
    return evaluate.accuracy(_predictions(spark, sf), "y", "p")


@Q("a27_macro_f1", f"WITH {_PRED_SQL}{_COUNT_SQL} SELECT round_even(avg(f1), 6) AS macro_f1 FROM s")
def a27(spark, sf):
    return evaluate.macro_f1(_predictions(spark, sf), "y", "p")


@Q("a28_report", f"""WITH {_PRED_SQL}{_COUNT_SQL}, r AS (SELECT label AS name, precision, recall, f1, support FROM s
   UNION ALL SELECT 'accuracy', sum(recall * support) / sum(support), sum(recall * support) / sum(support), sum(recall * support) / sum(support), sum(support)::BIGINT FROM s
   UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM s
   UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM s)
   SELECT name, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) AS f1, support FROM r""")
def a28(spark, sf):
    return evaluate.report(_predictions(spark, sf), "y", "p")


@Q("a31_confusion", f"WITH {_PRED_SQL} SELECT y AS truth, " + ", ".join(f"count(*) FILTER (p = '{c}') AS pred_{c}" for c in CLASSES) + " FROM p GROUP BY y")
def a31(spark, sf):
    return evaluate.confusion(_predictions(spark, sf), "y", "p", list(CLASSES))


@Q("a29_weighted_loss", "SELECT o_orderpriority, round_even(sum(o_totalprice * (o_custkey % 7 + 1)) / sum(o_custkey % 7 + 1), 4) AS loss FROM orders GROUP BY 1")
def a29(spark, sf):
    """Mean of batch losses weighted by batch size."""
    n = F.col("o_custkey") % 7 + 1
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.bround(F.sum(F.col("o_totalprice") * n) / F.sum(n), 4).alias("loss"))


@Q("a30_best_epoch", """WITH e AS (SELECT o_custkey AS run, o_orderkey AS epoch, floor(o_totalprice / 50000) AS f1 FROM orders)
   SELECT run, arg_max(epoch, (f1, -epoch)) AS best_epoch, max(f1) AS best FROM e GROUP BY run""")
def a30(spark, sf):
    """First epoch that reaches the maximum."""
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("f1"))
    return e.groupBy("run").agg(F.max_by("epoch", F.struct("f1", -F.col("epoch"))).alias("best_epoch"), F.max("f1").alias("best"))


@Q("f24_arg_max", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS predicted FROM embeddings")
def f24(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", evaluate.arg_max(F.col("embedding")).alias("predicted"))


@Q("m03_nearest_centroid", """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL),
   d AS (SELECT x.vec_id, c.label, round_even(sum((v - m) * (v - m)), 6) AS d FROM x JOIN c USING (i) GROUP BY ALL),
   n AS (SELECT vec_id, arg_min(label, (d, label)) AS predicted FROM d GROUP BY vec_id)
   SELECT label AS truth, predicted, count(*) AS n FROM n JOIN embeddings USING (vec_id) GROUP BY ALL""")
def m03(spark, sf):
    """Stand-in classifier: nearest class centroid. The centroids (classes x dimensions) are the broadcast side."""
    e = table(spark, sf, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(F.struct(F.col("label"), F.transform("s", lambda x: x["m"]).alias("m")).alias("c"))
    centroids = c.agg(F.array_sort(F.collect_list("c")).alias("cs"))
    dist = lambda k: F.bround(F.aggregate(F.zip_with("embedding", k["m"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda acc, x: acc + x), 6)
    best = F.array_min(F.transform("cs", lambda k: F.struct(dist(k).alias("d"), k["label"].alias("label"))))
    return e.crossJoin(F.broadcast(centroids)).select(F.col("label").alias("truth"), best["label"].alias("predicted")).groupBy("truth", "predicted").agg(F.count("*").alias("n"))


@Q("k04_metrics_json", f"""WITH {_PRED_SQL}{_COUNT_SQL}, r AS (SELECT round_even(avg(f1), 6)::DECIMAL(10,6) AS f FROM s), u AS (SELECT round_even(avg((y = p)::INT), 6)::DECIMAL(10,6) AS a FROM p)
   SELECT '{{"model":"folder","test_accuracy":' || a || ',"test_macro_f1":' || f || '}}' AS document FROM r, u""")
def k04(spark, sf):
    """The metrics document, floats with six digits."""
    p = _predictions(spark, sf)
    six = lambda c: F.col(c).cast("decimal(10,6)")
    both = evaluate.accuracy(p, "y", "p").crossJoin(evaluate.macro_f1(p, "y", "p"))
    return both.select(F.to_json(F.struct(F.lit("folder").alias("model"), six("accuracy").alias("test_accuracy"), six("macro_f1").alias("test_macro_f1"))).alias("document"))
