"""Token counts of descriptions by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NONE = np.int32(1 << 30)
BLOCK, SLICE, PORTION, KNOWN = 64, 1 << 20, 1 << 19, 1 << 19


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all rows, one row after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + length, length)


class Merges:
    """The merges of a SentencePiece BPE model with byte fallback, as arrays.

    Two neighbouring symbols merge if what they spell is a piece. Its rank comes from its score: in a text the pair of the lowest rank
    merges first, of equals the leftmost one. A character without a piece counts as its UTF-8 bytes.
    """

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        if not any(m.is_byte(i) for i in range(size)) or min((m.get_score(i) for i in range(size)), default=0) > -500:
            raise ValueError("a model of merges with byte fallback is needed")
        pieces = {m.id_to_piece(i): i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        order = {s: r for r, s in enumerate(sorted({m.get_score(i) for i in pieces.values()}, reverse=True))}
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - pieces.keys()):  # characters that occur in pieces only
            symbols[c] = size + len(symbols) - len(pieces)
        self.rank = np.full(size + 1, NONE, dtype=np.int32)
        self.safe = np.ones(len(order), dtype=bool)  # ranks after whose merges no lower or equal one can turn up beside the new symbols
        found = []
        for p, i in pieces.items():
            self.rank[i] = order[m.get_score(i)]
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    found.append((a << 32 | b, i))
        for p, i in pieces.items():
            for part in {p[:k] for k in range(1, len(p))} | {p[k:] for k in range(1, len(p))}:
                j = pieces.get(part)
                if j is not None and self.rank[i] <= self.rank[j]:
                    self.safe[self.rank[j]] = False
        found.sort()
        self.keys = np.array([k for k, _ in found], dtype=np.int64)
        self.to = np.array([i for _, i in found], dtype=np.int32)
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        self.width = 1 + (np.arange(0x110000) > 0x7F).astype(np.int8) + (np.arange(0x110000) > 0x7FF) + (np.arange(0x110000) > 0xFFFF)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        self.width[[ord(p) for p in pieces if len(p) == 1]] = 1
        self.pretoken = _pretokens([p for p in pieces if len(p) > 1])

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair spells and its rank; NONE where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        piece = np.where(hit, self.to[at], len(self.rank) - 1)
        return piece, self.rank[piece]

    def counts(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each word when all merges are done.

        All words are merged at once. In each round every word applies its pair of the lowest rank: at all places where it stands, if
        no lower rank can come up beside the new symbol, else at the leftmost. Words are held as blocks of up to 64 places with the
        lowest rank of each, so that a round of a long word looks at its blocks and at the places that change.
        """
        length = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(points)
        if not n:
            return np.zeros(len(words), dtype=np.int64)
        start = np.cumsum(length) - length
        weight = self.width[points].astype(np.int64)
        symbol = np.append(self.symbol[points], np.int32(-1))
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # place n stands for none
        full = length > 0
        after[start[full] + length[full] - 1], before[start[full]] = n, n
        blocks = -(-length // BLOCK)
        within = ragged(np.zeros(len(words), dtype=np.int64), blocks)
        block_start = np.repeat(start, blocks) + BLOCK * within
        block_size = np.minimum(BLOCK, np.repeat(length, blocks) - BLOCK * within)
        block_of = np.repeat(np.arange(len(block_start)), block_size)
        word_of = np.repeat(np.arange(len(words)), blocks)
        piece, rank = self.pair(symbol[:n], symbol[after[:n]])
        lowest = np.minimum.reduceat(rank, block_start)
        first, live = np.cumsum(blocks) - blocks, np.flatnonzero(full)
        while len(live):
            own = ragged(first[live], blocks[live])
            low = np.minimum.reduceat(lowest[own], np.cumsum(blocks[live]) - blocks[live])
            target = np.repeat(low, blocks[live])
            hit = own[(lowest[own] == target) & (target < NONE)]
            live = live[low < NONE]
            if not len(live):
                break
            many, word = self.safe[lowest[hit]], word_of[hit]
            hit = hit[many | np.r_[True, word[1:] != word[:-1]]]
            at = ragged(block_start[hit], block_size[hit])
            at = at[rank[at] == np.repeat(lowest[hit], block_size[hit])]
            word = word_of[block_of[at]]
            new = np.r_[True, word[1:] != word[:-1]]
            chained = ~new & np.r_[False, after[at[:-1]] == at[1:]]  # overlaps the place before it
            begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            a = at[np.where(self.safe[rank[at]], (np.arange(len(at)) - begin) % 2 == 0, new)]
            b = after[a]
            c = after[b]
            symbol[a], weight[a], weight[b], rank[b] = piece[a], 1, 0, NONE
            after[a], before[c] = c, a
            left = before[a]
            changed = np.concatenate([a, left[left < n]])
            piece[changed], rank[changed] = self.pair(symbol[changed], symbol[after[changed]])
            touched = np.unique(block_of[np.concatenate([changed, b])])
            places = ragged(block_start[touched], block_size[touched])
            lowest[touched] = np.minimum.reduceat(rank[places], np.cumsum(block_size[touched]) - block_size[touched])
        total = np.concatenate([[0], np.cumsum(weight)])
        return total[start + length] - total[start]


def _pretokens(pieces: list[str]) -> re.Pattern:
    """Pattern of the stretches of a text that merge apart from each other: no piece reaches over their ends.

    ``pieces`` are those of more than one character. Characters that none of them holds stand alone; a space begins a stretch if
    none of them has one after another character.
    """
    joining = {c for p in pieces for c in p}
    own = "".join(re.escape(c) for c in sorted(joining - {SPACE}))
    if not own:
        return re.compile(f"{SPACE}+|[^{SPACE}]", re.S)
    if any(b == SPACE != a for p in pieces for a, b in zip(p, p[1:])):
        return re.compile(f"[{own}{SPACE}]+|[^{own}{SPACE}]", re.S)
    return re.compile(f"{SPACE}*[{own}]+|{SPACE}+|[^{own}{SPACE}]", re.S)


def _slices(pattern: re.Pattern, text: str) -> Iterator[list[str]]:
    """The stretches of a text, some at a time; a stretch is never cut."""
    at, step = 0, SLICE
    while at < len(text):
        found = pattern.findall(text, at, at + step)
        if at + step < len(text):
            if len(found) == 1:
                step *= 2
                continue
            found.pop()
        at, step = at + sum(map(len, found)), SLICE
        yield found


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Token counts of texts; keeps those of stretches seen before, up to a bound, and merges the new ones of a portion together."""

    def __init__(self, path: str):
        self.merges, self.known = merges(path), {}

    def count(self, texts: list[str | None]) -> list[int]:
        normal = [self.merges.model.normalize(t) if t else "" for t in texts]
        totals, held, size = [0] * len(texts), [], 0
        for k, text in enumerate(normal):
            for words in _slices(self.merges.pretoken, text):
                held.append((k, words))
                size += sum(map(len, words)) if len(text) > SLICE else 0
                if size > SLICE:
                    self._add(held, totals)
                    held, size = [], 0
        self._add(held, totals)
        return totals

    def _add(self, held: list[tuple[int, list[str]]], totals: list[int]) -> None:
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list(set(chain.from_iterable(w for _, w in held)) - self.known.keys())
        self.known.update(zip(new, self.merges.counts(new).tolist()))
        for k, words in held:
            totals[k] += sum(map(self.known.__getitem__, words))
        for w in new:
            if len(w) > BLOCK:  # long stretches seldom come again
                del self.known[w]


def _portions(texts: pd.Series) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        if size > PORTION:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    yield part


def count_tokens(catalog: DataFrame, model: str, id: str = "id", description: str = "description", limit: int = 4096) -> DataFrame:
    """Tokens of each record's whole description in the SentencePiece BPE model at the path ``model``: what a request to a language model costs.

    One row per record: id (as it is), n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens, the default being the most that
    an extraction request asks for). Begin, end and other special tokens are not counted, and their names in a text are plain
    text. The counts are those of the library; the pre-tokens of a portion of records are held as ragged arrays, and each round merges
    the pair of the lowest rank of every pre-token at once. No shuffle.

    A null or empty description has 0 bytes and 0 tokens and is not over the limit. Repeated records, ties and records without id have a
    row each; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(model)
        for texts in batches:
            yield pd.Series([n for part in _portions(texts) for n in counter.count(part)], dtype="int64")

    text = F.coalesce(F.col(description), F.lit(""))
    rows = catalog.select(F.col(id).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
