"""Label routing, encoding and weighting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import ANNOTATION_CLASSES, CLASSES, MINORITY_CLASSES
from ..functions.paths import SOURCES, category
from ..operators import labels
from ..registry import Registry, table
from .common import BASE_SQL, cat_sql, manifest

REGISTRY = Registry()
Q = REGISTRY.add

_IN = ", ".join(f"'{c}'" for c in CLASSES)
_LINES = r"""l AS (SELECT file_id, regexp_split_to_array(body, '\r\n|\r|\n') AS b FROM annot_files),
 t AS (SELECT file_id, list_filter(list_transform(b, lambda x: trim(x)), lambda x: x <> '') AS b FROM l),
 e AS (SELECT file_id, unnest(b) AS line, generate_subscripts(b, 1) - 1 AS pos FROM t),
 c AS (SELECT file_id, pos::INT AS pos, CASE WHEN regexp_full_match(regexp_split_to_array(line, '\s+')[1], '[+-]?\d{1,9}') THEN regexp_split_to_array(line, '\s+')[1]::INT END AS class_id, (len(regexp_split_to_array(line, '\s+')) - 1)::INT AS n_values FROM e)"""
_DOM = ", g AS (SELECT file_id, class_id, count(*) AS n, min(pos) AS p FROM c WHERE class_id IS NOT NULL GROUP BY ALL), d AS (SELECT file_id, class_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, p) AS k FROM g) WHERE k = 1)"


@Q("s08_annotation_lines", f"WITH {_LINES} SELECT file_id, pos, class_id, n_values, CASE WHEN n_values = 4 THEN 'box' WHEN n_values > 4 THEN 'polygon' ELSE 'short' END AS kind FROM c")
def s08(spark, sf):
    return labels.annotation_lines(table(spark, sf, "annot_files"), "body", ["file_id"])


def _dominant(spark, sf):
    files = table(spark, sf, "annot_files").select("file_id", "body")
    best = labels.dominant_class(labels.annotation_lines(files, "body", ["file_id"]), "file_id")
    return files.select("file_id").join(best, "file_id", "left")


@Q("a07_dominant_class", f"WITH {_LINES}{_DOM} SELECT file_id, class_id FROM annot_files LEFT JOIN d USING (file_id)")
def a07(spark, sf):
    return _dominant(spark, sf)


_ANN = ", ".join(f"({k}, '{c}')" for k, c in enumerate(ANNOTATION_CLASSES))


@Q("j11_class_names", f"WITH {_LINES}{_DOM} SELECT file_id, name FROM d JOIN (VALUES {_ANN}) v(class_id, name) USING (class_id)")
def j11(spark, sf):
    """Dominant class id to class name; unknown ids are dropped after dominance is decided."""
    names = spark.createDataFrame(list(enumerate(ANNOTATION_CLASSES)), "class_id int, name string")
    return _dominant(spark, sf).join(F.broadcast(names), "class_id").select("file_id", "name")


_STEM = r"regexp_replace(regexp_extract({c}, '[^/]*$'), '\.[^.]*$', '')"


def _stem(c):
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")


@Q("j04_stem_join", f"SELECT file_id, row_id FROM (SELECT file_id, {_STEM.format(c='file_path')} AS s FROM annot_files) a JOIN (SELECT row_id, {_STEM.format(c='image_path')} AS s FROM train) t USING (s)")
def j04(spark, sf):
    a = table(spark, sf, "annot_files").select("file_id", _stem("file_path").alias("s"))
    return a.join(table(spark, sf, "train").select("row_id", _stem("image_path").alias("s")), "s").select("file_id", "row_id")


@Q("j04_images_absent", f"SELECT file_id FROM (SELECT file_id, {_STEM.format(c='file_path')} AS s FROM annot_files) a ANTI JOIN (SELECT {_STEM.format(c='image_path')} AS s FROM train WHERE label = 'healthy') t USING (s)")
def j04_absent(spark, sf):
    a = table(spark, sf, "annot_files").select("file_id", _stem("file_path").alias("s"))
    return a.join(table(spark, sf, "train").where("label = 'healthy'").select(_stem("image_path").alias("s")), "s", "left_anti").select("file_id")


@Q("j05_missing_files", "SELECT image_path FROM (SELECT DISTINCT image_path FROM documents WHERE image_path IS NOT NULL) ANTI JOIN annot_files USING (image_path)")
def j05(spark, sf):
    """Listed pictures without a file."""
    d = table(spark, sf, "documents").where("image_path IS NOT NULL").select("image_path").distinct()
    return d.join(table(spark, sf, "annot_files").select("image_path"), "image_path", "left_anti")


@Q("l05_first_missing", "SELECT image_path FROM (SELECT DISTINCT image_path FROM documents WHERE image_path IS NOT NULL) ANTI JOIN annot_files USING (image_path) ORDER BY image_path LIMIT 10")
def l05(spark, sf):
    return j05(spark, sf).orderBy("image_path").limit(10)


_FLAGS_SQL = "f AS (SELECT doc_id, CASE WHEN lang = 'en' THEN ' 1' ELSE '0' END AS english, CASE WHEN image_path IS NOT NULL THEN '1 ' ELSE '0' END AS pictured, CASE WHEN n_chars > 1000 THEN '1' WHEN n_chars IS NULL THEN NULL ELSE '0' END AS long FROM documents), r AS (SELECT *, (coalesce(trim(english), '0') = '1')::INT + (coalesce(trim(pictured), '0') = '1')::INT + (coalesce(trim(long), '0') = '1')::INT AS n_active FROM f)"
_DEST_SQL = "CASE WHEN n_active = 0 THEN 'no_label' WHEN n_active > 1 THEN 'multi_label' WHEN trim(english) = '1' THEN 'english' WHEN trim(pictured) = '1' THEN 'pictured' ELSE 'long' END"


def _onehot(spark, sf):
    d = table(spark, sf, "documents")
    flags = {
        "english": F.when(F.col("lang") == "en", " 1").otherwise("0"),
        "pictured": F.when(F.col("image_path").isNotNull(), "1 ").otherwise("0"),
        "long": F.when(F.col("n_chars") > 1000, "1").when(F.col("n_chars").isNull(), F.lit(None)).otherwise("0"),
    }
    n, dest = labels.onehot_route(flags)
    return d.select("doc_id", "image_path", n.alias("n_active"), dest.alias("destination"))


@Q("p11_onehot_route", f"WITH {_FLAGS_SQL} SELECT doc_id, n_active, {_DEST_SQL} AS destination FROM r")
def p11(spark, sf):
    return _onehot(spark, sf).select("doc_id", "n_active", "destination")


@Q("a25_run_counters", f"""WITH {_FLAGS_SQL}, j AS (SELECT r.*, d.image_path, EXISTS (SELECT 1 FROM annot_files a WHERE a.image_path = d.image_path) AS there FROM r JOIN documents d USING (doc_id))
   SELECT count(*) FILTER (there) AS moved, count(*) FILTER (NOT there) AS missing, count(*) FILTER (n_active > 1) AS multi, count(*) FILTER (n_active = 0) AS unlabeled FROM j""")
def a25(spark, sf):
    """Counters of a routing run; multi and unlabeled are counted before the existence check."""
    there = table(spark, sf, "annot_files").select("image_path").distinct().withColumn("there", F.lit(True))
    rows = _onehot(spark, sf).join(there, "image_path", "left")
    ok = F.coalesce("there", F.lit(False))
    return rows.agg(F.count_if(ok).alias("moved"), F.count_if(~ok).alias("missing"), F.count_if(F.col("n_active") > 1).alias("multi"), F.count_if(F.col("n_active") == 0).alias("unlabeled"))


_MIN = ", ".join(f"'{c}'" for c in MINORITY_CLASSES)


@Q("p14_minority_routing", f"WITH {BASE_SQL} SELECT row_id, CASE WHEN label IN ({_MIN}) THEN 'minority' ELSE 'standard' END AS pipeline FROM m WHERE split = 'train'")
def p14(spark, sf):
    return manifest(spark, sf).where("split = 'train'").select("row_id", F.when(F.col("label").isin(*MINORITY_CLASSES), "minority").otherwise("standard").alias("pipeline"))


@Q("x04_unknown_labels", f"SELECT DISTINCT {cat_sql('label')} AS label FROM train WHERE {cat_sql('label')} NOT IN ({_IN})")
def x04(spark, sf):
    return labels.unknown_labels(table(spark, sf, "train").select(category(F.col("label")).alias("label")), "label")


_ORDER = ", ".join(f"('{c}', {k})" for k, c in enumerate(CLASSES))


@Q("j06_label_encode", f"""WITH {BASE_SQL}, o AS (SELECT label, (row_number() OVER (ORDER BY k) - 1)::INT AS "index" FROM (VALUES {_ORDER}) v(label, k) SEMI JOIN (SELECT label FROM m WHERE split = 'val') USING (label))
   SELECT row_id, "index" FROM m JOIN o USING (label) WHERE split = 'val'""")
def j06(spark, sf):
    rows = manifest(spark, sf).where("split = 'val'").select("row_id", "label")
    return rows.join(F.broadcast(labels.class_index(rows, "label")), "label").select("row_id", "index")


@Q("x05_present_classes", f"""SELECT label, (row_number() OVER (ORDER BY k) - 1)::INT AS "index" FROM (VALUES {_ORDER}) v(label, k) SEMI JOIN (SELECT {cat_sql('label')} AS label FROM test WHERE environment = 'lab') USING (label)""")
def x05(spark, sf):
    """Configured classes that are present, in configured order."""
    return labels.class_index(table(spark, sf, "test").where("environment = 'lab'").select(category(F.col("label")).alias("label")), "label")


@Q("p04_exclude", "SELECT row_id, label FROM train WHERE label IS NULL OR label NOT IN ('healthy', 'common_rust')")
def p04(spark, sf):
    return labels.exclude(table(spark, sf, "train").select("row_id", "label"), "label", ["healthy", "common_rust"])


@Q("a09_class_weights", f"""WITH {BASE_SQL}, c AS (SELECT label, count(*) AS n FROM m WHERE split = 'train' GROUP BY label)
   SELECT label, n, round_even(sum(n) OVER () / (count(*) OVER () * n), 6) AS balanced, round_even(1.0::DOUBLE / n, 6) AS inverse FROM c""")
def a09(spark, sf):
    return labels.class_weights(manifest(spark, sf).where("split = 'train'"), "label")


@Q("a10_sample_weights", "SELECT vec_id, label, round_even(1.0::DOUBLE / count(*) OVER (PARTITION BY label), 9) AS weight FROM embeddings")
def a10(spark, sf):
    """1 / n of the row's class; counts are combined first, so no class is gathered in one task (J-07)."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    return e.join(F.broadcast(n), "label").select("vec_id", "label", F.bround(1.0 / F.col("n"), 9).alias("weight"))


_DISPLAY = {c: c.replace("_", " ").title() for c in CLASSES if not c.endswith("deficiency")}
_DISPLAY_SQL = ", ".join(f"('{k}', '{v}')" for k, v in _DISPLAY.items())


@Q("j02_display_names", f"WITH {BASE_SQL} SELECT label, coalesce(name, label) AS name, count(*) AS n FROM m LEFT JOIN (VALUES {_DISPLAY_SQL}) v(label, name) USING (label) GROUP BY ALL")
def j02(spark, sf):
    """Display name with fallback to the key."""
    names = spark.createDataFrame(list(_DISPLAY.items()), "label string, name string")
    c = manifest(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(names), "label", "left").select("label", F.coalesce("name", "label").alias("name"), "n")


@Q("j03_reindexed_counts", f"SELECT v.label, count(r.label) AS n FROM (VALUES {_ORDER}, ('aphids', 9)) v(label, k) LEFT JOIN (SELECT label FROM test WHERE environment = 'lab') r USING (label) GROUP BY v.label")
def j03(spark, sf):
    """Counts aligned to a class list; absent classes are 0."""
    wanted = spark.createDataFrame([(c,) for c in (*CLASSES, "aphids")], "label string")
    c = table(spark, sf, "test").where("environment = 'lab'").groupBy("label").agg(F.count("*").alias("n"))
    return wanted.join(c, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


_SRC_CASE = "CASE " + " ".join(f"WHEN contains(s, '{n}') THEN '{n}'" for n in sorted(SOURCES, key=lambda n: (-len(n), n))) + " ELSE 'unknown' END"


@Q("j12_source_lookup", f"SELECT row_id, {_SRC_CASE} AS source FROM (SELECT row_id, coalesce({_STEM.format(c='image_path')}, '') AS s FROM train)")
def j12(spark, sf):
    s = F.coalesce(_stem("image_path"), F.lit(""))
    return table(spark, sf, "train").select("row_id", labels.longest_source(s, SOURCES).alias("source"))


@Q("l08_names_longest_first", "SELECT name, row_number() OVER (ORDER BY length(name) DESC, name)::INT AS place FROM (VALUES " + ", ".join(f"('{s}')" for s in SOURCES) + ") v(name)")
def l08(spark, sf):
    from pyspark.sql import Window as W

    n = spark.createDataFrame([(s,) for s in SOURCES], "name string")
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.length("name")), "name")))


@Q("s07_labelled_samples", r"""WITH s AS (SELECT doc_id, regexp_replace(image_path, '^clean/', '') AS rel FROM documents WHERE image_path IS NOT NULL UNION ALL SELECT doc_id, doc_kind || '.jpg' FROM documents WHERE image_path IS NULL AND doc_kind <> 'log'
   UNION ALL SELECT doc_id, '.cache/x.jpg' FROM documents WHERE doc_kind = 'log' UNION ALL SELECT doc_id, '_unlabeled/x.jpg' FROM documents WHERE lang IS NULL)
   SELECT doc_id, nullif(split_part(rel, '/', 1), '_unlabeled') AS label FROM s WHERE NOT starts_with(rel, '.')""")
def s07(spark, sf):
    """Label = first path component; names that start with a point are skipped, _unlabeled is null, a file at the root is its own label."""
    d = table(spark, sf, "documents")
    pick = lambda cond, c: d.where(cond).select("doc_id", c.alias("rel"))
    rel = (
        pick("image_path IS NOT NULL", F.regexp_replace("image_path", "^clean/", ""))
        .unionByName(pick("image_path IS NULL AND doc_kind <> 'log'", F.concat("doc_kind", F.lit(".jpg"))))
        .unionByName(pick("doc_kind = 'log'", F.lit(".cache/x.jpg")))
        .unionByName(pick("lang IS NULL", F.lit("_unlabeled/x.jpg")))
    )
    return rel.where(~F.col("rel").startswith(".")).select("doc_id", F.nullif(F.split("rel", "/", 2)[0], F.lit("_unlabeled")).alias("label"))
