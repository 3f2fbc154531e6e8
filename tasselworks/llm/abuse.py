"""Abusive, hateful or sexual content by weak supervision.

Every document is cut into passages (sentences and lines). A passage is brought into a plain form that undoes common
disguises: look-alike letters, zero-width characters, digits for letters, stretched, spelled-out and masked words. On
the plain form vote the lexicons and patterns of ``voters.py``, in three languages, some of them for harmless talk
about pests, plants, tools and pictures.

The label model takes the classes as hidden. What it knows of a voter is alpha, the probability that a passage on which
it fires is abusive. Alpha is estimated from what else speaks about these passages: the other voters that fire there
and the raters' judgements of their documents; a firing that nothing else speaks about says nothing about alpha, so a
voter cannot vouch for itself. Raters err: how often they do is estimated, too. Correlations between voters are those
of their firing within the abusive class; a voter's evidence is divided by one plus its correlations with the others
that fire on the same passage. Priors are worth PRIOR_FIRINGS firings a voter; there are no bounds on any estimate.

A linear classifier over content words and votes is trained on the posterior labels of a bounded, stratified
sample of passages (TRAIN_PER_PATTERN a pattern, TRAIN_SILENT without votes). A document's score is that of its worst
passage. The corpus is read and brought into plain form once; counts and scores are taken from the written plain form.

Defined results: null, empty and blank texts have score 0; whole texts are read; repeated rows are scored again; null
sources are reported as null; without ratings the label model works from the voters alone.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Workspace
from .voters import AGAINST, FUNCTION_WORDS, NAMES, PLAIN_WORDS, STRONG_WORDS, TELLING, WEAK, pattern_votes

TRAIN_PER_PATTERN = 60
TRAIN_SILENT = 4000
#: Largest training set, whatever the number of patterns.
TRAIN_MOST = 20_000
THRESHOLD = 0.5
EM_ROUNDS = 60
#: What a voter is believed to be worth before anything is counted, and how many firings that belief weighs.
PRIOR = {"telling": 0.8, "weak": 0.03, "against": 0.002}
PRIOR_FIRINGS = 10.0
#: Belief how often an abusive passage escapes all telling voters.
MISSED = 0.2
_DISGUISE = len(NAMES)
N_VOTERS = len(NAMES) + 1

# ---------------------------------------------------------------- plain form
#: Letters of other alphabets that look like Latin ones.
_ALIKE = str.maketrans("аеорсухіјѕткмнвԁԛɡαεορτυνικ", "aeopcyxijstkmhbdqgaeoptuvik")
_LEET = str.maketrans("013457@$!|", "oieast" + "asil")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Cf}]+")
_ODD_LETTER = regex.compile(r"[\p{Cyrillic}\p{Greek}ɡ]")
_BOTH_ALPHABETS = regex.compile(r"[a-z][\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][a-z]")
_SPELLED = re.compile(r"(?<![a-z0-9])[a-z0-9](?:[-_.*+~|·][a-z0-9]){2,}(?![a-z0-9])|(?<![a-z0-9])[a-z0-9](?: [a-z0-9]){3,}(?![a-z0-9])")
_STRETCH = re.compile(r"[a-z]*([a-z])\1\1[a-z]*")
_MIXED = re.compile(r"(?<![a-z0-9_/.@$!|-])(?:[a-z]+[0-9@$!|]|[0-9@$!|]+[a-z])[a-z0-9@$!|]*(?![a-z0-9_/-])")
_STAGE = re.compile(r"[vr]\d+|\d+[a-z]{1,2}")
_MASKED = re.compile(r"(?<![a-z_])[a-z]{1,9}(?:[#*@]+[a-z]{0,9}|_+[a-z]{1,9})(?![a-z_*])")
_TOKEN = re.compile(r"[a-z]+")
_CUT = re.compile(r"[!?\n\r]+|\.+(?=\s|$)")
_KNOWN = frozenset(STRONG_WORDS)
#: Stands behind a word whose disguise was undone.
_UNDONE = "\x02"


@lru_cache(20_000)
def _unmask(token: str) -> str:
    """The strong word that fits a masked token, of equal length; the token itself without one."""
    pattern = re.compile(re.sub(r"[#*@_]", "[a-z]", token))
    return next((w for w in STRONG_WORDS if len(w) == len(token) and pattern.fullmatch(w)), token)


@lru_cache(50_000)
def _unleet(token: str) -> str:
    """The known word that digits and signs stand for; the token itself without one."""
    tail = token.rstrip("!|$@")
    for t in (token, tail):
        plain = _unstretch(t.translate(_LEET))
        if plain != t and plain in PLAIN_WORDS and not _STAGE.fullmatch(t):
            return plain + token[len(t) :]
    return token


@lru_cache(20_000)
def _unstretch(token: str) -> str:
    """The known word of which a letter was stretched; a single letter without one."""
    one = re.sub(r"([a-z])\1{2,}", r"\1", token)
    for end in (one, re.sub(r"([a-z])\1{2,}", r"\1\1", token), re.sub(r"(.)\1+$", r"\1\1", one + one[-1:])):
        if end in _KNOWN:
            return end
    return one


@lru_cache(20_000)
def _segmented(run: str) -> str:
    """A run of spelled-out letters as words if known words make it up, in as few pieces as possible."""
    run = run.translate(_LEET)
    if run in _KNOWN or len(run) > 60:
        return run
    best: list[tuple[int, str] | None] = [(0, "")] + [None] * len(run)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - 14), end):
            if best[start] is not None and run[start:end] in PLAIN_WORDS and (best[end] is None or best[start][0] + 1 < best[end][0]):
                best[end] = (best[start][0] + 1, f"{best[start][1]} {run[start:end]}")
    return best[-1][1].strip() if best[-1] is not None else run


def _joined(token: str) -> str:
    letters = re.sub(r"[^a-z0-9]", "", token)
    return _segmented(letters) if re.search("[a-z].*[a-z]", letters) else token


_THREE = [3 * c for c in "abcdefghijklmnopqrstuvwxyz"]


def _undo(change):
    def replace(m: re.Match) -> str:
        plain = change(m[0])
        return m[0] if plain == m[0] else plain + _UNDONE

    return replace


_DISGUISES = [(_SPELLED, _undo(_joined)), (_STRETCH, _undo(_unstretch)), (_MASKED, _undo(_unmask)), (_MIXED, _undo(_unleet))]


def passages(text: str | None) -> list[tuple[str, bool]]:
    """Plain passages of a text, with whether a disguise was undone."""
    if not text:
        return []
    disguised = False
    text = text.lower().replace(_UNDONE, " ")
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
        if _ODD_LETTER.search(text):
            # letters of two alphabets in one word are a disguise, a sentence in another alphabet is none
            disguised = _BOTH_ALPHABETS.search(text) is not None
            text = text.translate(_ALIKE)
    for pattern, replace in _DISGUISES:
        if pattern is not _STRETCH or any(three in text for three in _THREE):
            text = pattern.sub(replace, text)
    out = []
    for part in _CUT.split(text):
        part = part.strip()
        if _UNDONE in part:
            out.append((part.replace(_UNDONE, ""), True))
        elif part:
            out.append((part, disguised))
    return out


def votes(passage: str, hidden: bool, words: list[str] | None = None) -> int:
    """Bit set of the voters that fire; undoing a disguise counts only where a telling voter speaks against the passage."""
    bits = pattern_votes(passage, _TOKEN.findall(passage) if words is None else words)
    return bits | (1 << _DISGUISE if hidden and bits & TELLING else 0)


# --------------------------------------------------------------- label model
class LabelModel:
    """Hidden class of every pattern. Patterns are votes + rating << N_VOTERS, where the rating of the passage's
    document is 0 (none), 1 (harmless) or 2 (abusive)."""

    def __init__(self, counts: dict[int, int]):
        patterns = sorted(counts)
        n = np.array([counts[p] for p in patterns], float)
        v = _matrix(patterns)
        rating = np.array([p >> N_VOTERS for p in patterns], int)
        kind = ["against" if x in AGAINST else "weak" if x in WEAK else "telling" for x in NAMES] + ["weak"]
        prior = np.array([PRIOR[k] for k in kind])
        self.alpha, self.share = prior.copy(), 0.005
        self.corr = np.zeros((N_VOTERS, N_VOTERS))
        #: P(rated abusive | rated, class): how often raters say so of documents with passages of either class.
        self.said = np.array([0.3, 0.9])
        rated, abusive = rating > 0, rating == 2
        telling = np.array([(p & TELLING) != 0 for p in patterns], bool)
        # in documents of passages that no telling voter speaks against
        plain = rated & ~telling
        base = (3.0 + n[plain & abusive].sum()) / (10.0 + n[plain].sum())
        for step in range(EM_ROUNDS):
            weight = self._weights(v)
            evidence = v * weight * (_logit(self.alpha) - _logit(self.share))
            heard = np.where(rated, np.log(np.where(abusive, self.said[1] / self.said[0], (1 - self.said[1]) / (1 - self.said[0]))), 0.0)
            own = _sigmoid(_logit(self.share) + evidence.sum(1))
            both = _sigmoid(_logit(self.share) + evidence.sum(1) + heard)
            alpha = self.alpha.copy()
            for j in range(N_VOTERS):
                fires = v[:, j] > 0
                # what others say about the passages on which j fires; the class is as likely beforehand as alpha says
                rest = evidence[fires].sum(1) - evidence[fires, j] + heard[fires]
                speaks = (v[fires].sum(1) > 1) | rated[fires]
                if kind[j] != "telling":
                    # that no telling voter fires speaks, too
                    rest, speaks = rest + np.where(telling[fires], 0.0, math.log(MISSED)), np.ones(int(fires.sum()), bool)
                post = _sigmoid(_logit(self.alpha[j]) + rest)
                known = n[fires][speaks]
                alpha[j] = (PRIOR_FIRINGS * prior[j] + known @ post[speaks]) / (PRIOR_FIRINGS + known.sum())
            at = rated & telling
            self.said = np.array([base, (4.5 + (n * own)[at & abusive].sum()) / (5.0 + (n * own)[at].sum())])
            self.share = (0.5 + (n * both)[telling].sum()) / (100.0 + n.sum())
            if step >= 3:
                self.corr = self._correlations(v[telling], (n * both)[telling])
            moved, self.alpha = np.abs(alpha - self.alpha).max(), alpha
            if step > 5 and moved < 1e-6:
                break
        self.posterior = dict(zip(patterns, self.judge(patterns).tolist()))

    def judge(self, patterns: list[int]) -> np.ndarray:
        """Probability that a passage of each pattern of votes (whatever its rating) is abusive."""
        v = _matrix(patterns)
        return _sigmoid(_logit(self.share) + (v * self._weights(v) * (_logit(self.alpha) - _logit(self.share))).sum(1))

    def _weights(self, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + v @ self.corr)

    @staticmethod
    def _correlations(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Positive correlations of the voters' firing within a class, zero on the diagonal."""
        if w.sum() <= 0:
            return np.zeros((N_VOTERS, N_VOTERS))
        mean = w @ v / w.sum()
        cov = (v * w[:, None]).T @ v / w.sum() - np.outer(mean, mean)
        sd = np.sqrt(np.diag(cov))
        r = np.divide(cov, np.outer(sd, sd), out=np.zeros_like(cov), where=np.outer(sd, sd) > 0)
        np.fill_diagonal(r, 0)
        return np.maximum(r, 0)


def _matrix(patterns: list[int]) -> np.ndarray:
    return ((np.array(patterns, np.int64)[:, None] >> np.arange(N_VOTERS)) & 1).astype(float).reshape(-1, N_VOTERS)


def _logit(p):
    return np.log(p) - np.log1p(-p)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


# --------------------------------------------------------- linear classifier
def features(words: list[str], bits: int) -> set[str]:
    """Content words and votes (``#k``)."""
    return {*words, *(f"#{k}" for k in range(N_VOTERS) if bits >> k & 1)} - FUNCTION_WORDS


def training_set(model: LabelModel, sample: list[tuple[str, int]]) -> list[tuple[str, int, float]]:
    """Passages with their posterior, and for every voter what the model holds of it alone, as PRIOR_FIRINGS rows
    without words: few passages show a voter by itself."""
    alone = [("", 1 << k) for k in range(N_VOTERS)] * int(PRIOR_FIRINGS)
    rows = sample + alone
    return [(p, b, float(t)) for (p, b), t in zip(rows, model.judge([b for _, b in rows]))]


def train_linear(rows: list[tuple[str, int, float]], rounds: int = 200, l2: float = 5.0, l2_votes: float = 0.01) -> dict[str, float]:
    """Weights of a logistic regression on (words of the passage, votes, target); '' is the intercept. Votes are
    penalised less than words, so that what the voters say carries over to words that were not seen."""
    parts = [features(p.split(), b) for p, b, _ in rows]
    seen = Counter(f for own in parts for f in own)
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 3 or f[0] == "#"))}
    row, col = [], []
    for r, part in enumerate(parts):
        own = sorted(index[f] for f in part if f in index)
        row += [r] * len(own)
        col += own
    row, col = np.array(row, int), np.array(col, int)
    y = np.array([t for _, _, t in rows])
    penalty = np.where(np.array([f[0] == "#" for f in sorted(index, key=index.get)], bool), l2_votes, l2)
    w, b = np.zeros(len(index)), -3.0
    g2, b2 = np.full(len(index), 1e-8), 1e-8
    for _ in range(rounds):
        d = _sigmoid(np.bincount(row, w[col], len(rows)) + b) - y
        g = np.bincount(col, d[row], len(index)) + penalty * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        b2 += d.sum() ** 2
        b -= 0.5 * d.sum() / math.sqrt(b2)
    return {"": float(b)} | {f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-4}


def score_plain(plain: list[str], bits: list[int], weights: dict[str, float]) -> float:
    """Probability that the worst of the passages is abusive."""
    get, base, worst = weights.get, weights[""], -60.0
    for p, b in zip(plain, bits):
        z = base
        for w in set(p.split()):
            z += get(w, 0.0)
        k = 0
        while b:
            if b & 1:
                z += get(f"#{k}", 0.0)
            b >>= 1
            k += 1
        if z > worst:
            worst = z
    return 1 / (1 + math.exp(-worst)) if worst > -60 else 0.0


def score(text: str | None, weights: dict[str, float]) -> float:
    """Score of one text."""
    found = [(_TOKEN.findall(p), p, hidden) for p, hidden in passages(text)]
    return score_plain([" ".join(w) for w, _, _ in found], [votes(p, hidden, w) for w, p, hidden in found], weights)


# ----------------------------------------------------------------- operators
PLAIN = "doc_id long, source string, plain array<string>, bits array<int>, sample string, pattern int, h long"


def _plain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plain passages and votes of every document; at the end, of each pattern the partition's different passages of
    lowest hash as training candidates."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("plain", pa.list_(pa.string())), ("bits", pa.list_(pa.int32())), ("sample", pa.string()), ("pattern", pa.int32()), ("h", pa.int64())])
    lowest: dict[int, tuple[list[tuple[int, str]], set[str]]] = {}
    crc = zlib.crc32
    for batch in batches:
        plain, bits = [], []
        for value in batch.column(2).to_pylist():
            own_plain, own_bits = [], []
            for p, hidden in passages(value):
                words = _TOKEN.findall(p)
                b = votes(p, hidden, words)
                p = " ".join(words)
                own_plain.append(p)
                own_bits.append(b)
                heap, held = lowest.setdefault(b, ([], set()))
                item = (-crc(p.encode()), p)
                if len(heap) < (TRAIN_PER_PATTERN if b else TRAIN_SILENT):
                    if p not in held:
                        heapq.heappush(heap, item)
                        held.add(p)
                elif item > heap[0] and p not in held:
                    held.discard(heapq.heapreplace(heap, item)[1])
                    held.add(p)
            plain.append(own_plain)
            bits.append(own_bits)
        none = [None] * len(plain)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip((plain, bits, none, none, none), schema.types[2:])]], schema=schema)
    rest = [(p, b, -h) for b, (heap, _) in lowest.items() for h, p in heap]
    if rest:
        none = [None] * len(rest)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, none, *zip(*rest)), schema.types)], schema=schema)


def plain_form(documents: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The written plain form: a row a document, and training candidates in rows of their own (``sample`` not null)."""
    picked = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return ws.keep(picked.mapInArrow(_plain_rows, PLAIN))


def _training_rows(table: DataFrame) -> list:
    """(pattern, sample), of each pattern those of lowest hash; repeated passages count once. Ranks are taken in 256
    groups of a pattern first, so that no task ranks what all partitions kept of it."""
    kept = table.where("sample IS NOT NULL").select("pattern", "h", "sample", F.pmod("h", F.lit(256)).alias("g"))
    out = []
    for some, most in ((kept.where("pattern <> 0"), TRAIN_PER_PATTERN), (kept.where("pattern = 0"), TRAIN_SILENT)):
        for groups in (["pattern", "g"], ["pattern"]):
            w = W.partitionBy(*groups).orderBy("h", "sample")
            some = some.withColumn("k", F.dense_rank().over(w)).where(F.col("k") <= most)
        out.append(some.select("pattern", "h", "sample", "k").distinct())
    return out[0].unionByName(out[1]).orderBy("k", "pattern", "sample").limit(TRAIN_MOST).collect()


def fit(table: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", rating: str = "is_abusive") -> tuple[LabelModel, dict[str, float]]:
    """The label model over all passages of a plain form, and the classifier trained on its posterior labels."""
    said = ratings.where(F.col(rating).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.avg(rating).alias("a"))
    said = said.where("a <> 0.5").select("doc_id", F.when(F.col("a") > 0.5, 2).otherwise(1).alias("r"))
    # patterns are counted in the document before the join with the ratings; at most 3 x 2^N_VOTERS rows reach the
    # driver, whatever the corpus, and some thousands in practice
    each = table.where("sample IS NULL").select("doc_id", F.explode("bits").alias("b")).groupBy("doc_id", "b").agg(F.count("*").alias("n"))
    counts = each.join(said, "doc_id", "left").groupBy((F.col("b") + F.shiftleft(F.coalesce("r", F.lit(0)), N_VOTERS)).alias("pattern")).agg(F.sum("n").alias("n")).collect()
    model = LabelModel({r["pattern"]: r["n"] for r in counts})
    rows = _training_rows(table)
    if not rows:
        return model, {"": -20.0}
    return model, train_linear(training_set(model, [(r["sample"], r["pattern"]) for r in rows]))


def score_documents(table: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc_id, source, score) of every document of a plain form. The model is bounded by the training sample."""
    sent = table.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            scores = [score_plain(p, b, weights) for p, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "source", "score"])

    return table.where("sample IS NULL").select("doc_id", "source", "plain", "bits").mapInArrow(run, "doc_id long, source string, score double")


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, flagged documents and their share."""
    flagged = F.count_if(F.col("score") >= threshold)
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), flagged.alias("n_flagged"), F.bround(flagged / F.count("*"), 6).alias("rate"))
