"""Packing of descriptions into training sequences along a space-filling curve."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from .records import written

# Fixed value: how byte-level tokenizers of this kind part a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMENSIONS, BITS, RANGE = 4, 10, 64 << 20


def _byte_of_sign() -> dict[str, int]:
    """Signs that stand for bytes in such vocabularies: printable bytes for themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids (special tokens are found in a text, none is added) with the vocabulary at ``path``, a file of ``tokenizers``.

    Byte-level vocabularies whose merges are in the order of their ids run on tiktoken, which gives the same ids several times
    faster; texts with the name of a special token, and other vocabularies, run on ``tokenizers``.
    """
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    slow = Tokenizer.from_file(path)
    special = [t["content"] for t in read.get("added_tokens") or []]

    def plain(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    model, pre = read["model"], read.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges") or []]
    order = [model["vocab"].get(a + b) for a, b in merges]
    simple = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
              and not read.get("normalizer") and None not in order and order == sorted(order) and not model.get("ignore_merges"))
    if not simple:
        return plain
    signs = _byte_of_sign()
    ranks = {bytes(signs[c] for c in t): n for t, n in model["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        return plain(text) if any(s in text for s in special) else np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


def projection(size: int, seed: int = 5) -> np.ndarray:
    """Random signs per token id for each dimension: the columns of a random projection of token counts to few dimensions.

    The signs of an id, as 0 and 2, are the 16-bit fields of one number, so that one sum over a document adds up all dimensions.
    """
    signs = np.random.default_rng(seed).choice(np.array([0, 2], dtype=np.uint64), (size, DIMENSIONS))
    return (signs << (16 * np.arange(DIMENSIONS)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)


def coordinates(ids: np.ndarray, fields: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The projected mean of a document's hashed token vector, as whole numbers of ``bits`` bits."""
    total, step = np.zeros(DIMENSIONS), 1 << 14  # so many ids fill no field
    for at in range(0, len(ids), step):
        part = int(fields[ids[at:at + step] % len(fields)].sum())
        total += [part >> 16 * k & 0xFFFF for k in range(DIMENSIONS)]
    mean = total / max(1, len(ids)) - (len(ids) > 0)
    return ((np.tanh(4 * mean) + 1) / 2 * ((1 << bits) - 1)).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point (a row of coordinates) on the Hilbert curve."""
    x = points.T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of each level
        for i in range(n):
            set_ = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(set_, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] = np.where(set_, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def id_width(tokenizer: str, end: int) -> int:
    """Bytes for an id of the vocabulary: 2 where all fit, else 4."""
    with open(tokenizer, encoding="utf-8") as f:
        read = json.load(f)
    listed = read["model"]["vocab"]
    most = max([end, *(listed.values() if isinstance(listed, dict) else [len(listed)]), *(t["id"] for t in read.get("added_tokens") or [])])
    return 2 if most < 1 << 16 else 4


def tokenize(catalog: DataFrame, tokenizer: str, end: int, width: int, id: str = "id", description: str = "description") -> DataFrame:
    """(id, ids, curve) per record: token ids with the end id, as little-endian numbers of ``width`` bytes, and the place on the curve."""
    rows = catalog.select(F.col(id).alias("id"), F.coalesce(F.col(description), F.lit("")).alias("description"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fields = encoder(tokenizer), projection(1 << 16)
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                points = np.array([coordinates(x, fields) for x in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.append(x, np.uint32(end)).astype(f"<u{width}").tobytes() for x in ids], pa.binary()),
                                                  pa.array(hilbert(points), pa.int64())], ["id", "ids", "curve"])

    return rows.mapInArrow(run, rows.select("id").schema.add("ids", "binary").add("curve", "long"))


class _Open:
    """The sequence being filled: pieces (id, start, bytes of ids, tokens of the document)."""

    def __init__(self, first: int, length: int):
        self.number, self.length, self.pieces, self.filled = first, length, [], 0

    def add(self, row, ids: bytes) -> list[tuple]:
        out, at, total = [], 0, len(ids) // 4
        while at < total:
            n = min(total - at, self.length - self.filled)
            self.pieces.append((row, at, ids[4 * at:4 * (at + n)], total))
            self.filled += n
            at += n
            if self.filled == self.length:
                out += self.close()
        return out

    def close(self) -> list[tuple]:
        out, offset = [], 0
        for row, start, ids, total in self.pieces:
            out.append((row, start, len(ids) // 4, ids, total, self.number, offset))
            offset += len(ids) // 4
        self.number, self.pieces, self.filled = self.number + 1, [], 0
        return out

    def rest(self) -> list[tuple]:
        """What is left, cut into sequences whose lengths are powers of two: they need no padding."""
        left, pieces, out = self.filled, self.pieces, []
        self.pieces, self.filled = [], 0
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                small, rest = _Open(self.number, 1 << bit), []
                for row, start, ids, total in pieces:
                    n = min(len(ids) // 4, small.length - small.filled)
                    if n:
                        small.pieces.append((row, start, ids[:4 * n], total))
                        small.filled += n
                    if 4 * n < len(ids):
                        rest.append((row, start + n, ids[4 * n:], total))
                out += small.close()
                self.number, pieces = small.number, rest
        return out


def pack_catalog(catalog: DataFrame, tokenizer: str, id: str = "id", description: str = "description", length: int = 2048, end: int = 1) -> DataFrame:
    """Descriptions as sequences of ``length`` tokens without padding: one row per piece of a record.

    Columns: id, start (the record's tokens before the piece), length, ids (little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id, offset (in the sequence, gapless from 0). A record's tokens are those of its whole description and ``end``; records
    are cut where a sequence is full. Records that lie near each other on a Hilbert curve through projected token vectors share
    sequences: the tokens are written once, range-sorted by curve place and id, in ranges of about 64 MB, and each is packed as a stream. What is
    left at a range's end is cut into sequences with powers of two as lengths, so nothing is padded.

    A null or empty description has the end id only. Repeated records are packed each; records without id too. Ids are of any type that
    has an order, and keep it. Other columns are ignored. An empty table gives no rows.
    """
    width, size = id_width(tokenizer, end), Observation()
    tokens = written(tokenize(catalog, tokenizer, end, width, id, description).observe(size, F.sum(F.octet_length("ids")).alias("bytes")), "tokens")
    parts = max(int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size.get["bytes"] or 0) // RANGE)
    ranged = tokens.repartitionByRange(parts, "curve", "id", F.xxhash64("ids")).sortWithinPartitions("curve", "id", "ids")
    schema = tokens.select("id").schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    target = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(target), target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Open(TaskContext.get().partitionId() << 33, length)
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                yield batch([p for row, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for p in held.add(row, np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())])
        yield batch(held.rest())

    return ranged.select("id", "ids").mapInArrow(run, schema)
