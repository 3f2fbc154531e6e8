"""Move, copy and rename plans over the listed pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import ANNOTATION_CLASSES
from ..operators import moves, sampling
from ..operators.prefix import global_row_number
from ..registry import Registry, table
from ..session import Workspace
from .labels import _ANN, _DEST_SQL, _DOM, _FLAGS_SQL, _LINES, _dominant, _onehot
from .samples import suffix_sql, used_sql

REGISTRY = Registry()
Q = REGISTRY.add

_NAME = "regexp_extract({c}, '[^/]*$')"
_EXT = r"lower(regexp_extract({n}, '^.+(\.[^.]+)$', 1))"
#: Status over a CTE ``p`` (src, dst), destinations taken ``x`` (dst) and sources present ``h`` (src).
_STATUS = f"""SELECT src, dst, '{{action}}' AS action, CASE WHEN {_EXT.format(n=_NAME.format(c='src'))} = '' THEN 'no_extension' WHEN src NOT IN (SELECT src FROM h) THEN 'missing'
 WHEN dst IN (SELECT dst FROM x) THEN 'exists' WHEN dst IN (SELECT dst FROM p GROUP BY dst HAVING count(DISTINCT src) > 1) THEN 'collision' ELSE 'planned' END AS status FROM p"""


def _name(c):
    return F.element_at(F.split(c, "/"), -1)


def _train(spark, sf):
    return table(spark, sf, "train").where("image_path IS NOT NULL").select(F.col("image_path").alias("src")).distinct()


_TRAIN = "SELECT DISTINCT image_path AS src FROM train WHERE image_path IS NOT NULL"
_PRESENT = ", h AS (SELECT DISTINCT image_path AS src FROM annot_files UNION SELECT image_path FROM train WHERE label = 'healthy' AND image_path IS NOT NULL)"


def _present(spark, sf):
    a = table(spark, sf, "annot_files").select(F.col("image_path").alias("src"))
    return a.union(table(spark, sf, "train").where("label = 'healthy' AND image_path IS NOT NULL").select("image_path"))


@Q("n05_copy_skip_existing", f"WITH p AS (SELECT src, 'clean/all/' || {_NAME.format(c='src')} AS dst FROM ({_TRAIN})), x AS (SELECT 'clean/all/' || {_NAME.format(c='image_path')} AS dst FROM annot_files), h AS ({_TRAIN}) {_STATUS.format(action='copy')}")
def n05(spark, sf):
    t = _train(spark, sf)
    taken = table(spark, sf, "annot_files").select(F.concat(F.lit("clean/all/"), _name("image_path")).alias("dst"))
    return moves.plan(t.select("src", F.concat(F.lit("clean/all/"), _name("src")).alias("dst")), "copy", taken, t)


@Q("n06_move_skip_existing", f"WITH p AS (SELECT src, 'clean/gray_leaf_spot/' || {_NAME.format(c='src')} AS dst FROM ({_TRAIN})), x AS (SELECT 'clean/gray_leaf_spot/' || {_NAME.format(c='image_path')} AS dst FROM annot_files), h AS ({_TRAIN}) {_STATUS.format(action='move')}")
def n06(spark, sf):
    t = _train(spark, sf)
    taken = table(spark, sf, "annot_files").select(F.concat(F.lit("clean/gray_leaf_spot/"), _name("image_path")).alias("dst"))
    return moves.plan(t.select("src", F.concat(F.lit("clean/gray_leaf_spot/"), _name("src")).alias("dst")), "move", taken, t)


@Q("n07_move_matching", f"WITH p AS (SELECT src, replace(src, '/real/', '/lab/') AS dst FROM ({_TRAIN}) WHERE contains({_NAME.format(c='src')}, 'cropdg') AND contains(src, '/real/')), x AS (SELECT image_path AS dst FROM train WHERE label = 'healthy'), h AS ({_TRAIN}) {_STATUS.format(action='move')}")
def n07(spark, sf):
    """Pictures whose name holds a word move to the other environment; what is there already is skipped."""
    t = _train(spark, sf)
    rows = t.where(F.contains(_name("src"), F.lit("cropdg")) & F.contains("src", F.lit("/real/"))).select("src", F.replace("src", F.lit("/real/"), F.lit("/lab/")).alias("dst"))
    return moves.plan(rows, "move", table(spark, sf, "train").where("label = 'healthy'").select(F.col("image_path").alias("dst")), t)


@Q("n08_rename_substring", f"WITH p AS (SELECT src, replace(src, '_desease_', '_') AS dst FROM ({_TRAIN}) WHERE contains(src, '_desease_')), x AS (SELECT image_path AS dst FROM train), h AS ({_TRAIN}) {_STATUS.format(action='rename')}")
def n08(spark, sf):
    t = _train(spark, sf)
    rows = t.where(F.contains("src", F.lit("_desease_"))).select("src", F.replace("src", F.lit("_desease_"), F.lit("_")).alias("dst"))
    return moves.plan(rows, "rename", t.select(F.col("src").alias("dst")), t)


@Q("n09_copy_listed", f"WITH p AS (SELECT src, 'multi/' || {_NAME.format(c='src')} AS dst FROM (SELECT DISTINCT trim(image_path) AS src FROM documents WHERE trim(image_path) <> '')), x AS (SELECT 'multi/' || {_NAME.format(c='image_path')} AS dst FROM val){_PRESENT} {_STATUS.format(action='copy')}")
def n09(spark, sf):
    """A list of paths (blank lines dropped, S-18) with three outcomes: planned, exists, missing."""
    listed = table(spark, sf, "documents").select(F.trim("image_path").alias("src")).where("src <> ''").distinct()
    taken = table(spark, sf, "val").where("image_path IS NOT NULL").select(F.concat(F.lit("multi/"), _name("image_path")).alias("dst"))
    return moves.plan(listed.select("src", F.concat(F.lit("multi/"), _name("src")).alias("dst")), "copy", taken, _present(spark, sf))


_ROUTED = f"WITH {_FLAGS_SQL}, p AS (SELECT DISTINCT d.image_path AS src, {_DEST_SQL} || '/' || {_NAME.format(c='d.image_path')} AS dst FROM r JOIN documents d USING (doc_id) WHERE d.image_path IS NOT NULL)"


def _routed(spark, sf):
    return _onehot(spark, sf).where("image_path IS NOT NULL").select(F.col("image_path").alias("src"), F.concat("destination", F.lit("/"), _name("image_path")).alias("dst")).distinct()


@Q("n10_route_plan", f"{_ROUTED}, x AS (SELECT 'multi_label/' || {_NAME.format(c='image_path')} AS dst FROM annot_files){_PRESENT} {_STATUS.format(action='move')}")
def n10(spark, sf):
    """One-hot routing with existence, idempotence and collision checks."""
    taken = table(spark, sf, "annot_files").select(F.concat(F.lit("multi_label/"), _name("image_path")).alias("dst"))
    return moves.plan(_routed(spark, sf), "move", taken, _present(spark, sf))


@Q("n10_folder_totals", f"{_ROUTED} SELECT coalesce(split_part(dst, '/', 1), 'TOTAL') AS folder, count(*) AS n FROM p GROUP BY ROLLUP (split_part(dst, '/', 1))")
def n10_totals(spark, sf):
    r = _routed(spark, sf).select(F.split("dst", "/")[0].alias("folder")).rollup("folder").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("folder", F.lit("TOTAL")).alias("folder"), "n")


@Q("a23_collisions", "WITH p AS (SELECT DISTINCT doc_id::VARCHAR AS src, sha256(text) AS dst FROM documents WHERE text IS NOT NULL) SELECT dst, count(DISTINCT src) AS n_sources, min(src) AS first_src, max(src) AS last_src FROM p GROUP BY dst HAVING count(DISTINCT src) > 1")
def a23(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("src"), F.sha2("text", 256).alias("dst"))
    return moves.collisions(d)


@Q("n12_dominant_copy", f"""WITH {_LINES}{_DOM}, w AS (SELECT image_path, name FROM d JOIN (VALUES {_ANN}) v(class_id, name) USING (class_id) JOIN annot_files USING (file_id)),
   s AS (SELECT name, count(*) AS n_new FROM w GROUP BY name), o AS (SELECT label AS name, count(*) AS n_there FROM val GROUP BY label)
   SELECT name, n_new, coalesce(n_there, 0) AS n_there, CASE WHEN coalesce(n_there, 0) >= n_new THEN 'exists' ELSE 'planned' END AS status FROM s LEFT JOIN o USING (name)""")
def n12(spark, sf):
    """A class is skipped when its destination already holds at least as many files."""
    names = spark.createDataFrame(list(enumerate(ANNOTATION_CLASSES)), "class_id int, name string")
    new = _dominant(spark, sf).join(F.broadcast(names), "class_id").groupBy("name").agg(F.count("*").alias("n_new"))
    there = table(spark, sf, "val").groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n_there"))
    n = F.coalesce("n_there", F.lit(0))
    return new.join(there, "name", "left").select("name", "n_new", n.alias("n_there"), F.when(n >= F.col("n_new"), "exists").otherwise("planned").alias("status"))


@Q("n04_sequential_rename", rf"""WITH t AS (SELECT src, {_NAME.format(c='src')} AS name, {_EXT.format(n=_NAME.format(c='src'))} AS ext FROM ({_TRAIN} AND image_path LIKE 'clean/gray_leaf_spot/%'))
   SELECT src, 'clean/gray_leaf_spot/gray_leaf_spot_' || row_number() OVER (ORDER BY name, src) || ext AS dst FROM t WHERE ext <> ''""")
def n04(spark, sf):
    """Sequential numbers from 1 in name order; files without an extension are skipped."""
    t = _train(spark, sf).where(F.col("src").startswith("clean/gray_leaf_spot/")).select("src", _name("src").alias("name"), moves.extension(F.col("src")).alias("ext")).where("ext <> ''")
    n = global_row_number(t, ["name", "src"], "n", Workspace(spark, "n04"))
    return n.select("src", F.concat(F.lit("clean/gray_leaf_spot/gray_leaf_spot_"), F.col("n").cast("string"), F.col("ext")).alias("dst"))


@Q("n01_move_with_suffix", f"""WITH s AS (SELECT src FROM ({_TRAIN}) WHERE contains(src, 'maize_africa') AND {_EXT.format(n=_NAME.format(c='src'))} <> ''),
   {suffix_sql("SELECT src FROM s", "src", used_sql("val"))}
   SELECT src, 'clean/lethal_necrosis/real/lethal_necrosis_maize_africa_real_' || suffix || {_EXT.format(n=_NAME.format(c='src'))} AS dst, 'move' AS action, 'planned' AS status FROM suffixes""")
def n01(spark, sf):
    """Recursive move under a prefix and an unused eight-digit number (N-01, N-02, N-03); the suffix follows a hash."""
    t = _train(spark, sf).where(F.contains("src", F.lit("maize_africa")) & (moves.extension(F.col("src")) != ""))
    used = table(spark, sf, "val").select(F.try_to_number(F.nullif(F.regexp_extract("image_path", r"_(\d{8})\.", 1), F.lit("")), F.lit("99999999")).cast("bigint").alias("n")).where("n IS NOT NULL")
    s = sampling.unique_suffixes(t, "src", used, "n", Workspace(spark, "n01"))
    rows = s.select("src", F.concat(F.lit("clean/lethal_necrosis/real/lethal_necrosis_maize_africa_real_"), F.col("suffix").cast("string"), moves.extension(F.col("src"))).alias("dst"))
    return moves.plan(rows, "move", None, t)
