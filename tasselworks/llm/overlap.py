"""Same or near-same records across splits: Aho-Corasick automata over sharded passages of the evaluation records.

Every record is normalised into a text of short passages. The first names source and picture number; the others are
cut from the 64-bit perceptual hash. The hash falls into nine bands, seen as the points of the affine plane of order
three; each of its twelve lines (three bands, 21 or 22 bits) is a passage. At most four differing bits touch at most
four bands, and no four points meet all twelve lines, so two hashes within four bits always share a whole passage:
the search misses nothing. A match is then verified bit by bit.

Evaluation passages are sharded by content, an automaton a shard, and training passages are routed to the shard that
may hold them, so each is scanned once and no task depends on the size of either side. Exact copies enter the scan
once (distinct passages and hashes); they are expanded to rows only at the end.

Defined results: a null or malformed path (no known source or no number) and a null or malformed hash give no
passages of that kind; a row without an id cannot be named and is left
out; repeated rows match as rows of their own; an empty side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import SOURCES, number_in_name, source_in_name
from ..operators.skew import salted_join
from ..session import Workspace

MAX_BITS = 4
#: Evaluation passages in one automaton (about 40 MB), and training passages that are scanned as one text.
SHARD_PASSAGES = 150_000
SALTS = 8
#: A passage with more evaluation values is cut into parts of about this many; its training values are salted.
HOT_VALUES = 20_000
HOT_SALTS = 16
#: Candidate pairs that are verified at once (about 200 MB while they are).
SLICE_PAIRS = 2_000_000
IDENTITY = 0
_EDGES = [0] + [8 + 7 * k for k in range(9)]  # nine bands of 8, 7, 7, ... bits
_LINES = sorted({tuple(sorted((x + t * dx) % 3 * 3 + (y + t * dy) % 3 for t in range(3))) for x in range(3) for y in range(3) for dx, dy in ((1, 0), (0, 1), (1, 1), (1, 2))})
#: Hexadecimal digits of a passage, without its leading kind character.
_DIGITS = {0: 9} | {k: 6 for k in range(1, len(_LINES) + 1)}


def _line_parts(line: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(shift right, mask, shift left) of the bands of a line."""
    parts, at = [], 0
    for band in line:
        width = _EDGES[band + 1] - _EDGES[band]
        parts.append((_EDGES[band], (1 << width) - 1, at))
        at += width
    return parts


def _line_key(h: Column, line: tuple[int, ...]) -> Column:
    pieces = [F.shiftleft(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(m)), at) for s, m, at in _line_parts(line)]
    return pieces[0].bitwiseOR(pieces[1]).bitwiseOR(pieces[2])


def _np_line_key(h: np.ndarray, line: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    for s, m, at in _line_parts(line):
        out |= ((h >> np.uint64(s)) & np.uint64(m)) << np.uint64(at)
    return out


def parsed_hash(phash: Column) -> Column:
    """16 hexadecimal digits as a bigint, anything else null."""
    p = F.trim(phash)
    half = lambda a: F.conv(F.substring(p, a, 8), 16, 10).cast("bigint")
    return F.when(p.rlike("^[0-9A-Fa-f]{16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def identity(path: Column) -> Column:
    """Source and picture number as one bigint, null if the name lacks one."""
    number = F.array_position(F.array(*map(F.lit, SOURCES)), source_in_name(path))
    return number * F.lit(1_000_000_000).cast("bigint") + number_in_name(path)


def _units(rows: DataFrame, row_id: str, path: str, phash: str) -> DataFrame:
    """(row_id, near, value): one row per identity and per hash of a record."""
    kinds = F.array(F.struct(F.lit(False).alias("near"), F.col("i").alias("value")), F.struct(F.lit(True).alias("near"), F.col("h").alias("value")))
    return (
        rows.select(F.col(row_id).cast("bigint").alias("row_id"), identity(F.col(path)).alias("i"), parsed_hash(F.col(phash)).alias("h"))
        .select("row_id", F.explode(kinds).alias("k"))
        .select("row_id", "k.near", "k.value")
        .where("value IS NOT NULL AND row_id IS NOT NULL")
    )


def _passages(units: DataFrame) -> DataFrame:
    """(kind, key, value): a row per passage."""
    h = F.col("value")
    passage = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    lines = F.array(*[passage(k, _line_key(h, line)) for k, line in enumerate(_LINES, 1)])
    return units.select(F.explode(F.when(F.col("near"), lines).otherwise(F.array(passage(IDENTITY, h)))).alias("p"), "value").select("p.kind", "p.key", "value")


def _routed(passages: DataFrame, train: bool, shards: int, hot: DataFrame | None) -> DataFrame:
    """(route, value); route = shard, side and kind, so that it sorts evaluation before training.

    A hot passage is cut into ``parts`` of evaluation values and HOT_SALTS of training values; each part meets each
    salt in a shard of its own.
    """
    cell = F.lit(0)
    if hot is not None:
        passages = passages.join(F.broadcast(hot), ["kind", "key"], "left")
        own = F.pmod(F.xxhash64(F.lit(1), "value"), F.lit(HOT_SALTS) if train else F.col("parts"))
        others = F.sequence(F.lit(0), (F.col("parts") if train else F.lit(HOT_SALTS)).cast("int") - 1)
        cells = F.transform(others, lambda x: (x * HOT_SALTS + own if train else own * HOT_SALTS + x).cast("bigint") + 1)
        passages = passages.withColumn("cell", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(cells)))
        cell = F.col("cell")
    route = F.pmod(F.xxhash64("kind", "key", cell), F.lit(shards)) * 32 + (16 if train else 0) + F.col("kind")
    return passages.select(route.alias("route"), "value")


def _texts(kind: int, key: np.ndarray) -> np.ndarray:
    """Code points of the passages: a kind character, then lower-case hexadecimal digits; one row a passage."""
    digits = _DIGITS[kind]
    out = np.empty((len(key), digits + 1), np.uint32)
    out[:, 0] = 65 + kind
    for d in range(digits):
        nibble = ((key >> np.uint64(4 * (digits - 1 - d))) & np.uint64(15)).astype(np.uint32)
        out[:, d + 1] = np.where(nibble < 10, nibble + 48, nibble + 87)
    return out


class ShardAutomaton:
    """Automaton over the evaluation passages of one shard."""

    def __init__(self, kinds: np.ndarray, values: np.ndarray):
        self.automaton = ahocorasick.Automaton()
        self.values: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for kind in np.unique(kinds):
            own = np.sort(values[kinds == kind])
            key = own if kind == IDENTITY else _np_line_key(own, _LINES[kind - 1])
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.values[int(kind)] = (np.append(first, len(own)), own)
            block = np.ascontiguousarray(_texts(int(kind), key[first])).tobytes().decode("utf-32-le")
            size = _DIGITS[int(kind)] + 1
            for n in range(len(first)):
                self.automaton.add_word(block[n * size : (n + 1) * size], n)
        self.automaton.make_automaton()

    def scan(self, kind: int, train: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Verified (training value, evaluation value, bit set of the passages' matched intervals), in slices of at most
        about SLICE_PAIRS candidates."""
        if kind not in self.values:
            return
        key = train if kind == IDENTITY else _np_line_key(train, _LINES[kind - 1])
        text = np.ascontiguousarray(_texts(kind, key)).tobytes().decode("utf-32-le")
        hits = np.array(list(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        if not len(hits):
            return
        starts, own = self.values[kind]
        at, pattern = hits[:, 0] // (_DIGITS[kind] + 1), hits[:, 1]
        size = starts[pattern + 1] - starts[pattern]
        upto = np.cumsum(size)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(SLICE_PAIRS, upto[-1], SLICE_PAIRS)), [len(size)]]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield self._verify(kind, train[at[lo:hi]], own, starts[pattern[lo:hi]], size[lo:hi])

    @staticmethod
    def _verify(kind: int, train: np.ndarray, own: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.repeat(np.arange(len(size)), size)
        b = own[begin[k] + np.arange(len(k)) - (np.cumsum(size) - size)[k]]
        a = train[k]
        if kind == IDENTITY:
            return a, b, np.full(len(a), 1 << len(_EDGES), np.int64)
        differ = a ^ b
        near = np.bitwise_count(differ) <= MAX_BITS
        a, b, differ = a[near], b[near], differ[near]
        # matched intervals of all lines merge into the set of covered bands; only the first matching line reports
        cover, first = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for n, line in enumerate(_LINES, 1):
            same = _np_line_key(differ, line) == 0
            cover |= np.where(same, sum(1 << band for band in line), 0)
            first = np.where((first == 0) & same, n, first)
        mine = first == kind
        return a[mine], b[mine], cover[mine]


def _scan_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted passages: a shard's evaluation rows first (they are held), then its training rows (they pass)."""
    shard, held, automaton = None, [], None
    for batch in batches:
        route = batch.column(0).to_numpy()
        value = batch.column(1).to_numpy().view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(route)) + 1, [len(route)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            r = int(route[lo])
            if r >> 5 != shard:
                shard, held, automaton = r >> 5, [], None
            kind = r & 15
            if not r & 16:
                held.append((np.full(hi - lo, kind), value[lo:hi]))
                continue
            if not held:
                continue
            if automaton is None:
                automaton = ShardAutomaton(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))
            for a, b, cover in automaton.scan(kind, value[lo:hi]):
                if not len(a):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind != IDENTITY)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(cover)], names=["near", "train_value", "value", "cover"])


def matched_values(train_units: DataFrame, eval_units: DataFrame, ws: Workspace) -> DataFrame:
    """(near, train_value, value, cover): pairs of equal identities and of hashes within MAX_BITS, each once."""
    spark = train_units.sparkSession
    once = ws.keep(eval_units.select("near", "value").distinct(), count=F.sum(F.when(F.col("near"), len(_LINES)).otherwise(1)))
    count = once.observed["count"] or 0
    if not count:
        return spark.createDataFrame([], "near boolean, train_value long, value long, cover long")
    tasks = max(-(-count // SHARD_PASSAGES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = 4 * tasks  # several a task, so that tasks come out even
    # passages with many evaluation values, count / HOT_VALUES at most; only hashes can share a passage
    hot = _passages(once.where("near")).groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_VALUES)
    hot = ws.keep(hot.select("kind", "key", F.ceil(F.col("n") / F.lit(HOT_VALUES)).alias("parts")), n=F.count(F.lit(1)))
    hot = hot if hot.observed["n"] else None
    both = _routed(_passages(once), False, shards, hot).unionByName(_routed(_passages(train_units.select("near", "value").distinct()), True, shards, hot))
    routed = both.repartition(tasks, F.shiftright("route", 5)).sortWithinPartitions("route")
    return ws.keep(routed.mapInArrow(_scan_shards, "near boolean, train_value long, value long, cover long"))


def cross_split_matches(train: DataFrame, evaluation: DataFrame, ws: Workspace, row_id: str = "row_id", path: str = "image_path", phash: str = "phash") -> DataFrame:
    """(train_row, row_id, near, cover): a row per matching pair of rows and kind of match."""
    train_units, eval_units = _units(train, row_id, path, phash), _units(evaluation, row_id, path, phash)
    pairs = matched_values(train_units, eval_units, ws)
    rows = salted_join(eval_units, pairs, ["near", "value"], SALTS, F.xxhash64("row_id")).select("near", F.col("train_value").alias("value"), "row_id", "cover")
    found = salted_join(train_units.withColumnRenamed("row_id", "train_row"), rows, ["near", "value"], SALTS, F.xxhash64("train_row"))
    return found.select("train_row", "row_id", "near", "cover")


def row_pairs(matches: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), the smaller id first, each pair once."""
    return matches.select(F.least("train_row", "row_id").alias("row_id_a"), F.greatest("train_row", "row_id").alias("row_id_b")).distinct()


def coverage(matches: DataFrame, evaluation: DataFrame, split: str = "split", row_id: str = "row_id", path: str = "image_path") -> DataFrame:
    """Per split and source: evaluation records, those with a match, by kind, matching pairs and mean covered share.

    The share is that of the record's passages (identity and nine bands) in merged matched intervals.
    """
    per = matches.groupBy("row_id").agg(
        F.bit_or("cover").alias("cover"), F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_same")
    )
    rows = evaluation.select(F.col(row_id).alias("row_id"), split, F.coalesce(source_in_name(F.col(path)), F.lit("unknown")).alias("source")).join(per, "row_id", "left")
    return rows.groupBy(split, "source").agg(
        F.count("*").alias("n_records"),
        F.count("cover").alias("n_leaked"),
        F.count_if(F.col("n_same") > 0).alias("n_same_picture"),
        F.count_if(F.col("n_near") > 0).alias("n_near_hash"),
        F.coalesce(F.sum("n_near"), F.lit(0)).alias("near_pairs"),
        F.coalesce(F.sum("n_same"), F.lit(0)).alias("same_pairs"),
        F.bround(F.avg(F.bit_count("cover") / F.lit(10.0)), 6).alias("mean_coverage"),
    )
