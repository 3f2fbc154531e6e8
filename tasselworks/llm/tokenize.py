"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Bytes are mapped to Latin-1 characters, so that one pyahocorasick automaton over all tokens finds, in a single pass,
the longest token at each position of a pre-token. From there the encoder takes longest matches and backtracks: a
token may follow its predecessor only if the pair is one that merging would have left side by side, which is decided
by undoing merges in reverse rank order and memoised by pair. Each position is given up at most once. A pre-token of n bytes costs O(n) times the number of tokens that
end at a position, which the vocabulary bounds (its runs of one character). Ids are those of exact merging.

Defined results: a null or empty text has an empty list; special tokens are ordinary text; repeated rows are encoded
again; the vocabulary file is a parameter, is read by the driver and sent to the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pre-token pattern of the vocabulary.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens and pairs remembered by one worker; a full memory is emptied, results do not depend on it.
REMEMBER = 300_000
REMEMBER_LENGTH = 64


def _printable_bytes() -> dict[str, str]:
    """Vocabulary character -> Latin-1 character: printable bytes stand for themselves, the others for 256, 257, ..."""
    table, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[chr(b)] = chr(b)
        else:
            table[chr(extra)] = chr(b)
            extra += 1
    return table


class BacktrackingBPE:
    """Exact BPE of single pre-tokens in linear time."""

    def __init__(self, path: str, text: str | None = None):
        """``text`` is the vocabulary file's content; without it the file is read."""
        if text is None:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        model = json.loads(text)["model"]
        alphabet = _printable_bytes()
        latin = {"".join(map(alphabet.get, text)): i for text, i in model["vocab"].items() if all(c in alphabet for c in text)}
        to_latin = lambda text: "".join(map(alphabet.get, text))
        self.length: dict[int, int] = {i: len(text) for text, i in latin.items()}
        self.rank: dict[int, int] = {i: -1 for i in self.length}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (to_latin(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = latin[a + b]
            self.merged[latin[a], latin[b]] = rank
            self.halves.setdefault(whole, (latin[a], latin[b]))
            self.rank[whole] = rank if self.rank[whole] < 0 else self.rank[whole]
        reachable = {t: i for t, i in latin.items() if i in self.halves or len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        for text, i in reachable.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.shorter = {i: next((reachable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in reachable), None) for t, i in reachable.items()}
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """True if merging leaves ``left`` and ``right`` side by side."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= REMEMBER:
                self._fits.clear()
            known = self._fits[left, right] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        # Merges are undone from the last one backwards. At every moment the two parts that touch must not have a
        # merge that would have come before the merge that is undone next on either side.
        rank, halves = self.rank, self.halves
        bound = len(self.merged) + 1
        while True:
            touch = self.merged.get((left, right))
            if touch is not None and touch < bound:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                # the left merge is the later one; a merge across the border of equal rank lies to its right and waits
                bound, left = rank[left], halves[left][1]
            else:
                bound, right = rank[right] + 1, halves[right][0]

    def encode(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 characters."""
        n = len(piece)
        if n == 1:
            return [self.automaton.get(piece)]
        length, shorter = self.length, self.shorter
        longest = [0] * n
        best = [0] * n
        for end, token in self.automaton.iter(piece):
            size = length[token]
            if size > best[end + 1 - size]:
                best[end + 1 - size], longest[end + 1 - size] = size, token
        open_end = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if open_end[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token is None:  # nothing shorter fits here: this border is impossible, take the last token back
                open_end[at] = 0
                last = out.pop()
                at -= length[last]
                token = shorter[last]


_ENCODERS: dict[str, tuple[BacktrackingBPE, dict[str, list[int]], "regex.Pattern"]] = {}


def _encoder(path: str, content: str | None = None):
    if path not in _ENCODERS:
        _ENCODERS[path] = (BacktrackingBPE(path, content), {}, regex.compile(PRETOKEN))
    return _ENCODERS[path]


def encode_text(path: str, text: str | None, content: str | None = None) -> list[int]:
    """Ids of a text; null and empty texts give an empty list. ``content`` is that of the vocabulary file, where the
    file itself is out of reach."""
    bpe, words, pattern = _encoder(path, content)
    ids: list[int] = []
    for piece in pattern.findall(text or ""):
        known = words.get(piece)
        if known is None:
            known = bpe.encode(piece.encode("utf-8").decode("latin-1"))
            if len(piece) <= REMEMBER_LENGTH:
                if len(words) >= REMEMBER:
                    words.clear()
                words[piece] = known
        ids += known
    return ids


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer_json: str) -> DataFrame:
    """(key, ids array<int>) for every row of ``df``; no shuffle, whole texts, streamed in Arrow batches."""
    kind = df.schema[key].dataType.simpleString()
    # a few MB of fixed size: executors need not see the file
    with open(tokenizer_json, encoding="utf-8") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat: list[np.ndarray] = []
            ends = [0]
            for value in batch.column(1).to_pylist():
                ids = encode_text(tokenizer_json, value, sent.value)
                flat.append(np.array(ids, dtype=np.int32))
                ends.append(ends[-1] + len(ids))
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
