"""Evaluation texts leaking into training text: FM-index of every training shard, backward search of test phrases.

A shard is a bounded stretch of training words. All of its suffixes are sorted and the Burrows-Wheeler transform, the
vocabulary and the sampled suffix positions are written: the index of a shard stands by itself and is built once. For a
search the transform goes into a wavelet matrix, and the evaluation phrases of PHRASE words are searched backwards at
once. Occurrences are located by walking to the next sampled suffix position; those of phrases with the same owners
are merged into spans of words that a removal would cut, then owners are named and their spans merged.

Words are the longest runs of letters and digits, in lower case and without accents. Defined results: null, empty and
short texts have no match; whole texts of any length are searched (a text longer than a shard is a shard of its own);
repeated rows are found again; an empty side gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

PHRASE = 12
SHARD_WORDS = 400_000
#: Words of evaluation items that are gathered and broadcast at once (about 20 MB).
BLOCK_WORDS = 1_000_000
SAMPLE = 16
_WORD = re.compile(r"[^\W_]+")
_MARKS = regex.compile(r"\p{M}+")


def words_of(text: str | None) -> list[str]:
    """Normalised words of a text."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(text.lower())


class WaveletMatrix:
    """Rank over a sequence of small integers, for whole arrays of questions at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            count = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often symbol[k] stands in the first upto[k] places."""
        begin, end = np.zeros_like(upto), upto
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            set_ = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin, end = np.where(set_, zeros + b, begin - b), np.where(set_, zeros + e, end - e)
        return end - begin


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; every separator (0) counts as a different symbol. Only suffixes that
    still share their rank are sorted again, so repeated texts cost no more rounds for the others."""
    n = len(seq)
    symbol = seq.astype(np.int64) + np.count_nonzero(seq == 0)
    symbol[seq == 0] = np.arange(np.count_nonzero(seq == 0))
    rank = np.zeros(n, np.int64)  # where the group of a suffix begins in the order
    open_, second, step = np.arange(n), symbol, 0
    order = np.empty(n, np.int64)
    while len(open_):
        if step:
            after = open_ + step
            second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[open_] * (n + int(second.max()) + 2) + second
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        new_group, old_group = np.ones(len(by), bool), np.ones(len(by), bool)
        new_group[1:], old_group[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        at = np.arange(len(by))
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        new = old + start - np.maximum.accumulate(np.where(old_group, at, 0))
        rank[open_] = new
        alone = new_group & np.append(new_group[1:], True)
        order[new[alone]] = open_[alone]
        open_ = open_[~alone]
        step = 2 * step or 1
    return order


class FMIndex:
    """Index of a sequence of word ids > 0 with separators 0; the last symbol must be a separator.

    What is stored is the Burrows-Wheeler transform and the sampled suffix positions; ranks are made from them.
    """

    def __init__(self, before: np.ndarray, samples: np.ndarray, sampled: np.ndarray, n_words: int):
        self.matrix = WaveletMatrix(before.astype(np.int64), max(1, int(n_words).bit_length()))
        self.start = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=n_words + 1))]).astype(np.int64)
        self.before, self.n, self.samples, self.sampled = before, len(before), samples, sampled
        self.sample_no = np.cumsum(sampled) - 1

    @staticmethod
    def parts(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(transform, sampled positions, which rows are sampled)."""
        order = suffix_array(seq)
        before = seq[order - 1].astype(np.int32)  # of the first suffix: the final separator
        # sampled: every SAMPLE-th position, and each first word of a text, so that no walk crosses a separator
        kept = (order % SAMPLE == 0) | (before == 0)
        return before, order[kept].astype(np.int32), kept

    @classmethod
    def build(cls, seq: np.ndarray, n_words: int) -> FMIndex:
        return cls(*cls.parts(seq), n_words)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 row of the suffixes that begin with each phrase (a row of ``phrases``)."""
        m = len(phrases)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.start[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.start[c] + self.matrix.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        dead = np.ones(m, bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.sampled[rows])
        while len(walk):
            c = self.before[rows[walk]].astype(np.int64)
            rows[walk] = self.start[c] + self.matrix.rank(c, rows[walk])
            steps[walk] += 1
            walk = walk[~self.sampled[rows[walk]]]
        return self.samples[self.sample_no[rows]] + steps


class Phrases:
    """All different phrases of a block of evaluation items (their words), with the items that hold them."""

    def __init__(self, items: np.ndarray, words: pa.ListArray):
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary: list[str] = coded.dictionary.to_pylist()
        sizes = np.diff(words.offsets.to_numpy())
        starts, which = _ranges(np.cumsum(sizes) - sizes, np.maximum(sizes - PHRASE + 1, 0))
        if not len(starts):
            self.matrix = np.empty((0, PHRASE), np.int64)
            return
        every = np.lib.stride_tricks.sliding_window_view(codes, PHRASE)[starts]
        self.matrix, back = np.unique(every, axis=0, return_inverse=True)
        pair = np.unique(np.stack([back.ravel(), items[which]], 1), axis=0)
        # phrases with the same owners are a class; spans are merged by class before owners are named
        bounds = np.flatnonzero(np.append(True, pair[1:, 0] != pair[:-1, 0]))
        classes: dict[bytes, int] = {}
        self.class_of = np.array([classes.setdefault(own.tobytes(), len(classes)) for own in np.split(pair[:, 1], bounds[1:])], np.int64)
        own = [np.frombuffer(o, np.int64) for o in classes]
        self.owner_at = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int64)
        self.owners = np.concatenate(own)


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated begin[k] .. begin[k]+size[k]-1, and k for each."""
    k = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    return begin[k] + np.arange(len(k)) - first[k], k


def _merged(doc: np.ndarray, kind: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of the same document and kind that touch or overlap become one."""
    order = np.lexsort((first, kind, doc))
    doc, kind, first, end = doc[order], kind[order], first[order], end[order]
    group = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1])))
    # the furthest end so far inside a group: ends are raised by a step a group, so that a plain running maximum does it
    wide = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    new = np.append(True, (group[1:] != group[:-1]) | (first[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], kind[at], first[at], reach[np.append(at[1:], len(doc)) - 1]


def search_shard(phrases: Phrases, shard: dict) -> tuple[np.ndarray, ...]:
    """Matches in a shard: text number, item, first and last+1 word of each merged span."""
    none = (np.empty(0, np.int64),) * 4
    known = {w: k for k, w in enumerate(shard["words"], 1)}
    local = np.array([known.get(w, 0) for w in phrases.vocabulary], np.int64)
    ids = local[phrases.matrix]
    there = np.flatnonzero((ids > 0).all(1))  # a phrase with a word that the shard lacks is not in it
    if not len(there):
        return none
    index = FMIndex(np.frombuffer(shard["transform"], np.int32), np.frombuffer(shard["samples"], np.int32).astype(np.int64), np.frombuffer(shard["sampled"], bool), len(shard["words"]))
    lo, hi = index.search(ids[there])
    rows, which = _ranges(lo, hi - lo)
    if not len(rows):
        return none
    at = index.locate(rows)
    starts = np.frombuffer(shard["starts"], np.int64)
    text = np.searchsorted(starts, at, side="right") - 1
    word = at - starts[text]
    text, kind, first, end = _merged(text, phrases.class_of[there[which]], word, word + PHRASE)
    slot, occ = _ranges(phrases.owner_at[kind], phrases.owner_at[kind + 1] - phrases.owner_at[kind])
    return _merged(text[occ], phrases.owners[slot], first[occ], end[occ])


INDEX = "docs array<bigint>, words array<string>, starts binary, transform binary, samples binary, sampled binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("docs", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), *[(n, pa.binary()) for n in ("starts", "transform", "samples", "sampled")]])
    docs: list[int | None] = []
    texts: list[list[int]] = []
    vocabulary: dict[str, int] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        seq = np.concatenate([np.append(np.array(t, np.int64), 0) for t in texts])
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]).astype(np.int64)
        row = [docs, list(vocabulary), starts.tobytes(), *[part.tobytes() for part in FMIndex.parts(seq)]]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, schema)], schema=schema)

    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(value)
            if len(words) < PHRASE:
                continue
            docs.append(key)
            texts.append([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words])
            size += len(words) + 1
            if size >= SHARD_WORDS:
                yield flush()
                docs, texts, vocabulary, size = [], [], {}, 0
    if texts:
        yield flush()


def build_index(documents: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index: a row a shard of at most SHARD_WORDS words and one text. It knows nothing of the items, so it
    serves any number of searches."""
    docs = documents.select(F.col(doc_id).cast("long"), text).where(F.length(text) >= 2 * PHRASE - 1)
    return ws.keep(docs.mapInArrow(_shards, INDEX))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array([len(w) for w in words], pa.int64())], names=["item_id", "words", "n"])


def search_index(index: DataFrame, items: DataFrame, ws: Workspace, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, end_word): merged spans of at least PHRASE words that a document shares with an item.

    The items are cut into blocks of about BLOCK_WORDS words; one block at a time is gathered, sent to the executors
    and searched in every shard, and its result is written, so that neither the driver nor a broadcast grows with the
    items. An item longer than a block is a block of its own.
    """
    spark = index.sparkSession
    schema = f"{doc_id} long, {item_id} long, first_word long, end_word long"
    picked = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    count = ws.keep(picked.mapInArrow(_item_words, "item_id long, words array<string>, n long").where(F.col("n") >= PHRASE), n=F.sum("n"))
    blocks = -(-(count.observed["n"] or 0) // BLOCK_WORDS)
    if not blocks:
        return spark.createDataFrame([], schema)
    parted = ws.keep(count.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")))
    found = []
    for b in range(blocks):
        block = parted.where(F.col("block") == b).select("item_id", "words").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast((block.column(0).chunk(0), block.column(1).chunk(0)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, words = sent.value
            phrases = Phrases(ids.to_numpy(), words)
            for batch in batches:
                for shard in batch.to_pylist():
                    text, item, first, end = search_shard(phrases, shard)
                    keys = pa.array(shard["docs"], pa.int64()).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(item), pa.array(first), pa.array(end)], names=[doc_id, item_id, "first_word", "end_word"])

        found.append(ws.keep(index.mapInArrow(run, schema)))
        sent.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def leaked_spans(documents: DataFrame, items: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``search_index`` over ``build_index``."""
    return search_index(build_index(documents, ws, doc_id, text), items, ws, doc_id, item_id, item_text)
