"""Queries of the training-data operators."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import plot_folder
from ..operators.packed import packed_values
from ..plans.storage import DUPLICATES, PACKED_SQL
from ..registry import Registry, table
from ..session import Workspace
from .abuse import THRESHOLD, fit, plain_form, score_documents, source_rates
from .components import match_groups
from .grouped_split import grouped_split
from .leakage import leaked_spans
from .ledger import Ledger, ledger_sample
from .overlap import _EDGES, _LINES, MAX_BITS, coverage, cross_split_matches, row_pairs
from .proportions import proportional_sample, random_start
from .tokenize import encode_corpus

REGISTRY = Registry()
TOKENIZERS = os.environ.get("TASSELWORKS_TOKENIZERS", "/opt/tokenizers")


P1_SQL = f"""
WITH RECURSIVE x AS ({PACKED_SQL.strip()}),
o AS (SELECT row_id, image_path FROM x UNION SELECT row_id, original_path FROM {DUPLICATES} WHERE trim(original_path) <> ''),
f AS (SELECT row_id, min(image_path) AS a FROM o GROUP BY row_id),
s AS (SELECT a AS x, image_path AS y FROM o JOIN f USING (row_id) UNION SELECT image_path, a FROM o JOIN f USING (row_id)),
r AS (SELECT DISTINCT image_path, image_path AS other FROM o UNION SELECT r.image_path, s.y FROM r JOIN s ON r.other = s.x)
SELECT image_path, min(other) AS group_path FROM r GROUP BY image_path
"""


@REGISTRY.add("p1_found", P1_SQL)
def p1_found(spark, sf_dir):
    """Every different path with the smallest path of all that are linked with it, directly or indirectly."""
    rows = table(spark, sf_dir, DUPLICATES).select("original_path", "duplicate_paths")
    members = F.concat(F.array(F.when(F.trim("original_path") != "", F.col("original_path"))), packed_values(F.col("duplicate_paths")))
    return match_groups(rows.select(members.alias("members")), "members", Workspace(spark, "p1"))


def _evaluation(spark, sf_dir):
    columns = ["row_id", "image_path", "phash"]
    val, test = (table(spark, sf_dir, t).select(*columns, F.lit(t).alias("split")) for t in ("val", "test"))
    return val.unionByName(test)


P2_SQL = r"""
WITH a AS (
  SELECT row_id, phash, 'train' AS split, image_path FROM train UNION ALL SELECT row_id, phash, 'val', image_path FROM val
  UNION ALL SELECT row_id, phash, 'test', image_path FROM test
), n AS (
  SELECT row_id, split, CASE WHEN regexp_full_match(trim(phash), '[0-9A-Fa-f]{16}') THEN ('0x' || trim(phash))::UBIGINT END AS h,
         '_' || regexp_replace(lower(regexp_extract(regexp_replace(replace(url_decode(replace(image_path, '+', '%2B')), chr(92), '/'), '[?#][^/]*$', ''), '[^/]*$')), '[\s_-]+', '_', 'g') || '_' AS f
  FROM a
), k AS (
  SELECT row_id, split, h, nullif(regexp_extract(f, '_(corn_leaf_roboflow|maize_africa|maize_desease|maize_field|cropdg|maize_nutrient|multi_desease)[_.]', 1), '') AS src,
         nullif(regexp_extract(f, '(?:^|[^0-9])0*([1-9][0-9]{7,8})(?:[^0-9]|$)', 1), '') AS num FROM n
), p AS (
  SELECT t.row_id AS x, e.row_id AS y FROM k t JOIN k e ON t.src = e.src AND t.num = e.num AND t.split = 'train' AND e.split <> 'train'
  UNION
  SELECT t.row_id, e.row_id FROM k t JOIN k e ON t.split = 'train' AND e.split <> 'train' AND bit_count(xor(t.h, e.h)) <= 4
)
SELECT least(x, y) AS row_id_a, greatest(x, y) AS row_id_b FROM p
"""


@REGISTRY.add("p2_found", P2_SQL)
def p2_found(spark, sf_dir):
    """Pairs of a train row and a val or test row of the same picture, or with hashes at most 4 bits apart."""
    train = table(spark, sf_dir, "train").select("row_id", "image_path", "phash")
    return row_pairs(cross_split_matches(train, _evaluation(spark, sf_dir), Workspace(spark, "p2")))


def _cover_sql() -> str:
    """Bands that two hashes ``t.h`` and ``e.h`` share in whole lines, as a bit set."""
    parts = []
    for line in _LINES:
        mask = sum(((1 << (_EDGES[band + 1] - _EDGES[band])) - 1) << _EDGES[band] for band in line)
        parts.append(f"CASE WHEN xor(t.h, e.h) & {mask}::UBIGINT = 0 THEN {sum(1 << band for band in line)} ELSE 0 END")
    return " | ".join(parts)


P2_COVERAGE_SQL = P2_SQL[: P2_SQL.index("), p AS (")] + f"""), m AS (
  SELECT e.row_id, true AS near, ({_cover_sql()})::BIGINT AS cover FROM k t JOIN k e ON t.split = 'train' AND e.split <> 'train' AND bit_count(xor(t.h, e.h)) <= {MAX_BITS}
  UNION ALL
  SELECT e.row_id, false, {1 << len(_EDGES)} FROM k t JOIN k e ON t.src = e.src AND t.num = e.num AND t.split = 'train' AND e.split <> 'train'
), c AS (SELECT row_id, bit_or(cover) AS cover, count(*) FILTER (near) AS n_near, count(*) FILTER (NOT near) AS n_same FROM m GROUP BY row_id)
SELECT split, coalesce(src, 'unknown') AS source, count(*) AS n_records, count(cover) AS n_leaked, count(*) FILTER (n_same > 0) AS n_same_picture, count(*) FILTER (n_near > 0) AS n_near_hash,
       coalesce(sum(n_near), 0)::BIGINT AS near_pairs, coalesce(sum(n_same), 0)::BIGINT AS same_pairs, round(avg(bit_count(cover) / 10.0), 6) AS mean_coverage
FROM k LEFT JOIN c USING (row_id) WHERE split <> 'train' GROUP BY ALL
"""


@REGISTRY.add("p2_coverage", P2_COVERAGE_SQL)
def p2_coverage(spark, sf_dir):
    """Cross-split overlaps per split and source."""
    train = table(spark, sf_dir, "train").select("row_id", "image_path", "phash")
    evaluation = _evaluation(spark, sf_dir)
    return coverage(cross_split_matches(train, evaluation, Workspace(spark, "p2c")), evaluation)


LEDGER_RATE = 0.1

P3_SQL = r"""
WITH RECURSIVE r AS (
  SELECT row_id, image_path, label, loaded_at, ('0x' || substr(md5('42:' || image_path), 1, 15))::BIGINT AS key,
         coalesce(regexp_replace(lower(regexp_replace(label, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g'), '') AS tag
  FROM train WHERE trim(image_path) <> ''
), k AS (
  SELECT key, tag AS stratum, coalesce(loaded_at::DATE, DATE '1900-01-01') AS day, key < 115292150460684697 AS low
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY loaded_at NULLS FIRST, tag) AS n FROM r) WHERE n = 1
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY day) AS seen, row_number() OVER (PARTITION BY stratum ORDER BY day) AS k
  FROM (SELECT stratum, day, count(*) AS n, count(*) FILTER (low) AS sure FROM k GROUP BY stratum, day)
), f AS (
  SELECT stratum, 0::BIGINT AS k, 0::BIGINT AS taken, 0::BIGINT AS fill FROM (SELECT DISTINCT stratum FROM c)
  UNION ALL
  SELECT c.stratum, c.k, (taken + sure + least(greatest(ceil(seen * 0.1::DOUBLE)::BIGINT - taken - sure, 0), n - sure))::BIGINT, least(greatest(ceil(seen * 0.1::DOUBLE)::BIGINT - taken - sure, 0), n - sure)::BIGINT
  FROM f JOIN c ON c.stratum = f.stratum AND c.k = f.k + 1
), s AS (
  SELECT key, day FROM (
    SELECT k.*, CASE WHEN k.day < (SELECT max(day) FROM k) THEN fill ELSE 0 END AS fill, row_number() OVER (PARTITION BY k.stratum, k.day, low ORDER BY key) AS n
    FROM k JOIN c ON k.stratum = c.stratum AND k.day = c.day JOIN f ON f.stratum = c.stratum AND f.k = c.k
  ) WHERE low OR n <= fill
)
SELECT row_id, image_path, label, day::VARCHAR AS selected_in FROM r JOIN s USING (key)
"""


@REGISTRY.add("p3_ledger_sample", P3_SQL)
def p3_ledger_sample(spark, sf_dir):
    """A tenth of the train paths of each label, by a ledger that grows with every day of loading and is saved."""
    train = table(spark, sf_dir, "train").select("row_id", "image_path", "label", "loaded_at")
    ws = Workspace(spark, "p3")
    ledger = Ledger(spark, f"{ws.root}/ledger")
    ledger.extend(train, LEDGER_RATE, ws)
    return ledger_sample(train.drop("loaded_at"), ledger.load()[0])


SPLIT_SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}


@REGISTRY.add("p4_grouped_split")
def p4_grouped_split(spark, sf_dir):
    """Every train row with its split; rows of one contributor, plot folder or path are in the same."""
    return grouped_split(table(spark, sf_dir, "train"), Workspace(spark, "p4"), SPLIT_SHARES, carry=("label", "environment"))


P4_AUDIT_SQL = r"""
WITH t AS (SELECT row_id, trim(contributor) AS c, image_path AS p, lower(regexp_extract(regexp_replace(replace(url_decode(replace(image_path, '+', '%2B')), chr(92), '/'), '[?#][^/]*$', ''), '(?i)/(plot_[^/]+)/', 1)) AS f FROM train)
SELECT 'contributor' AS kind, count(DISTINCT nullif(c, '')) AS things, 0::BIGINT AS wrong FROM t
UNION ALL SELECT 'plot', count(DISTINCT nullif(f, '')), 0 FROM t
UNION ALL SELECT 'path', count(DISTINCT p), 0 FROM t WHERE trim(p) <> ''
UNION ALL SELECT 'row', count(*), 0 FROM t
UNION ALL SELECT 'share', 3, 0
"""


@REGISTRY.add("p4_audit", P4_AUDIT_SQL)
def p4_audit(spark, sf_dir):
    """What must not be torn: contributors, plots and paths in more than one split, rows without exactly one split,
    and splits whose share of the rows is off by more than a twentieth."""
    ws = Workspace(spark, "p4a")
    rows = table(spark, sf_dir, "train").select("row_id", "image_path", "contributor")
    split = ws.keep(grouped_split(rows, ws, SPLIT_SHARES, carry=("image_path", "contributor")))
    parts = []
    for kind, entity in (("contributor", F.trim("contributor")), ("plot", plot_folder(F.col("image_path"))), ("path", F.when(F.trim("image_path") != "", F.col("image_path"))), ("row", F.col("row_id").cast("string"))):
        per = split.select(entity.alias("e"), "split").where("e <> ''").groupBy("e").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.count("*").alias("n"))
        wrong = (F.col("lo") != F.col("hi")) | ((F.col("n") != 1) if kind == "row" else F.lit(False))
        parts.append(per.agg(F.lit(kind).alias("kind"), F.count("*").alias("things"), F.count_if(wrong).alias("wrong")))
    wanted = spark.createDataFrame(list(SPLIT_SHARES.items()), "split string, share double")
    shares = split.groupBy("split").agg(F.count("*").alias("n")).join(wanted, "split").withColumn("off", F.abs(F.col("n") / F.sum("n").over(W.partitionBy()) - F.col("share")))
    parts.append(shares.agg(F.lit("share").alias("kind"), F.count("*").alias("things"), F.count_if(F.col("off") > 0.05).alias("wrong")))
    return reduce(DataFrame.unionByName, parts)


P6_SQL = r"""
WITH t AS (
  SELECT regexp_replace(lower(regexp_replace(label, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') AS l,
         regexp_replace(lower(regexp_replace(environment, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') AS e FROM train
), c AS (SELECT l, e, count(*) AS n FROM t GROUP BY ALL)
SELECT s.label, s.environment FROM target_shares s LEFT JOIN c ON c.l = s.label AND c.e = s.environment
WHERE coalesce(n, 0) < min_rows OR coalesce(n, 0) * 5000 < round(target_share * 1000)::BIGINT * (SELECT count(*) FROM train)
"""


@REGISTRY.add("p6_found", P6_SQL)
def p6_found(spark, sf_dir):
    """Target categories whose share or floor the sample could not meet."""
    _, report = proportional_sample(table(spark, sf_dir, "train"), table(spark, sf_dir, "target_shares"), Workspace(spark, "p6"))
    return report.where("impossible").select("label", "environment")


#: Counts by the scale at which the clipped shares sum to a fifth of train; where a category's running sum of
#: probabilities crosses an integer, a row is in.
P6_PLAN_SQL = P6_SQL[: P6_SQL.index("SELECT s.label")].replace("WITH t AS", "WITH RECURSIVE t AS").rstrip() + f""",
w AS (SELECT label, environment, l, e, target_share, min_rows, coalesce(n, 0) AS n FROM (SELECT *, label AS l, environment AS e FROM target_shares) LEFT JOIN c USING (l, e)),
z AS (SELECT (SELECT count(*) FROM train) / 5.0::DOUBLE AS size),
b AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, (SELECT max(n / target_share) FROM w WHERE target_share > 0)::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN s < size THEN mid ELSE low END, CASE WHEN s < size THEN high ELSE mid END
  FROM (SELECT step, low, high, (low + high) / 2 AS mid, (SELECT sum(least(greatest((low + high) / 2 * target_share, least(min_rows, n)), n)) FROM w) AS s FROM b), z WHERE step < 200
),
a AS (
  SELECT *, CASE WHEN (SELECT sum(n) FROM w) <= size THEN n
                 WHEN abs((SELECT sum(least(greatest(size * target_share, least(min_rows, n)), n)) FROM w) - size) < 1e-9 * greatest(size, 1) THEN least(greatest(size * target_share, least(min_rows, n)), n)
                 ELSE least(greatest((SELECT high FROM b WHERE step = 200) * target_share, least(min_rows, n)), n) END::DOUBLE AS planned
  FROM w, z
),
p AS (SELECT *, {random_start(42)!r}::DOUBLE + coalesce(sum(planned) OVER (ORDER BY l, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, CASE WHEN n > 0 THEN planned / n ELSE 0 END AS pi FROM a),
r AS (
  SELECT row_id, p.label, p.environment, p.l, p.e, floor(base + k * pi) > floor(base + (k - 1) * pi) AS hit FROM (
    SELECT row_id, l, e, row_number() OVER (PARTITION BY l, e ORDER BY ('0x' || substr(md5('42:' || row_id), 1, 15))::BIGINT, row_id) AS k
    FROM (SELECT row_id, {P6_SQL[P6_SQL.index("regexp_replace"): P6_SQL.index(" AS l,")]} AS l, {P6_SQL[P6_SQL.index("regexp_replace(lower(regexp_replace(environment"): P6_SQL.index(" AS e FROM")]} AS e FROM train)
  ) JOIN p USING (l, e)
)
"""


@REGISTRY.add("p6_sample", P6_PLAN_SQL + "SELECT row_id, label, environment FROM r WHERE hit")
def p6_sample(spark, sf_dir):
    """The sample of one fifth of train itself."""
    return proportional_sample(table(spark, sf_dir, "train"), table(spark, sf_dir, "target_shares"), Workspace(spark, "p6s"))[0]


@REGISTRY.add(
    "p6_report",
    P6_PLAN_SQL
    + """, g AS (SELECT l, e, count(*) FILTER (hit) AS selected FROM r GROUP BY ALL)
SELECT label, environment, target_share, min_rows, n AS available, round(planned, 6) AS planned, coalesce(selected, 0) AS selected,
       coalesce(selected, 0) < min_rows OR n * 5000 < round(target_share * 1000)::BIGINT * (SELECT count(*) FROM train) AS impossible FROM p LEFT JOIN g USING (l, e)""",
)
def p6_report(spark, sf_dir):
    """Available, planned and selected rows of every target category."""
    return proportional_sample(table(spark, sf_dir, "train"), table(spark, sf_dir, "target_shares"), Workspace(spark, "p6r"))[1]


@REGISTRY.add("p8_ids")
def p8_ids(spark, sf_dir):
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


P9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM heldout_items WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
e AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM e JOIN g USING (p)
"""


@REGISTRY.add("p9_found", P9_SQL)
def p9_found(spark, sf_dir):
    """Documents and the held-out items of which they hold at least 12 words in a row."""
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), Workspace(spark, "p9")).select("doc_id", "item_id").distinct()


#: Runs of words that document and item share are runs of consecutive phrases in the document.
P9_SPANS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, split, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM heldout_items WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, split, array_to_string(w[k:k + 11], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM i)),
e AS (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
m AS (SELECT DISTINCT doc_id, item_id, split, k FROM e JOIN g USING (p)),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS s FROM (SELECT *, CASE WHEN k - lag(k, 1, -99) OVER (PARTITION BY doc_id, item_id ORDER BY k) > 12 THEN 1 ELSE 0 END AS new FROM m))
SELECT doc_id, item_id, split, min(k) - 1 AS first_word, max(k) + 11 AS end_word FROM n GROUP BY doc_id, item_id, split, s
"""


@REGISTRY.add("p9_removal_spans", P9_SPANS_SQL)
def p9_removal_spans(spark, sf_dir):
    """The merged word spans behind p9_found, with the item's split: what a removal would cut from a document."""
    items = table(spark, sf_dir, "heldout_items")
    spans = leaked_spans(table(spark, sf_dir, "documents"), items, Workspace(spark, "p9s"))
    return spans.join(items.select("item_id", "split"), "item_id").select("doc_id", "item_id", "split", "first_word", "end_word")


def _scored(spark, sf_dir, name):
    table_ = plain_form(table(spark, sf_dir, "documents"), Workspace(spark, name))
    _, weights = fit(table_, table(spark, sf_dir, "content_labels"))
    return score_documents(table_, weights)


@REGISTRY.add("p10_found")
def p10_found(spark, sf_dir):
    """Documents with an abusive, hateful or sexually explicit passage."""
    return _scored(spark, sf_dir, "p10").where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


@REGISTRY.add("p10_scores")
def p10_scores(spark, sf_dir):
    """The score of every document."""
    return _scored(spark, sf_dir, "p10s")


@REGISTRY.add("p10_rates")
def p10_rates(spark, sf_dir):
    """Documents, flagged documents and their share per source."""
    return source_rates(_scored(spark, sf_dir, "p10r"))
