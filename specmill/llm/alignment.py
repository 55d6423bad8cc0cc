"""Two tokenizers' tokens of the same descriptions, aligned by merge-path partitioning, and scores of what they link."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .packing import SPLIT, _byte_of_sign
from .records import written
from .tokens import ragged

WORK, PORTION, LINKS, BLOCK = 256, 1 << 19, 1 << 16, 1 << 20
LAST = np.iinfo(np.int64).max


class ByteLevel:
    """A byte-level BPE vocabulary of ``tokenizers``: ids of texts, and the bytes of each id. Special tokens' names are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        if (read.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or read["model"]["type"] != "BPE" or read.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        signs, special = _byte_of_sign(), {t["content"] for t in read.get("added_tokens") or []}
        vocab = read["model"]["vocab"]
        spelled = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in read.get("added_tokens") or [])]))
        for t, i in vocab.items():
            if t not in special:
                spelled[i] = bytes(signs[c] for c in t)
        self.spelled = spelled
        merges = [m if isinstance(m, list) else m.split(" ") for m in read["model"].get("merges") or []]
        order = [vocab.get(a + b) for a, b in merges]
        pre = read["pre_tokenizer"]
        self.fast = None
        if not pre.get("add_prefix_space") and pre.get("use_regex", True) and None not in order and order == sorted(order) and not read["model"].get("ignore_merges"):
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={b: i for i, b in enumerate(spelled) if b}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, after a space; no ids for an empty one."""
        if self.fast is None:
            return [e.ids if t else [] for t, e in zip(texts, self.slow.encode_batch([" " + t for t in texts], add_special_tokens=False))]
        return [self.fast.encode_ordinary(" " + t) if t else [] for t in texts]


class Pieces:
    """A SentencePiece model that puts a space before a text: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i)
                        else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


@lru_cache(maxsize=2)
def tokenizers(first: str, second: str) -> tuple:
    """Both vocabularies, their ids' bytes as arrays, and for the groups' texts each id's decimal text with ``,``, ``|`` and ``;`` after it."""
    a, b = ByteLevel(first), Pieces(second)
    out = []
    for v in (a, b):
        out.append((pa.array(v.spelled, pa.large_binary()), np.array([len(x) for x in v.spelled], dtype=np.int64)))
    names = [np.array([f"{i}{end}" for i in range(max(len(a.spelled), len(b.spelled)))], dtype=object) for end in ",|;"]
    return a, b, *out, names


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, int]:
    """Groups of two rising arrays of token ends: (group of each a, group of each b, groups). A group ends where both have an end.

    The merge of both arrays is a path through the grid of a and b. Diagonals cut it into pieces of ``work`` steps; where each one
    crosses the path is found by binary search, for all diagonals at once. The pieces are then walked side by side, step by step, each
    by itself: it notes the shared ends it passes. The pieces' numbers of shared ends, summed up, are what the group numbers of the
    next pieces start from; a group that goes over a piece's end is put together by that.
    """
    total = len(a) + len(b)
    if not total:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    diagonal = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    a_, b_ = np.append(a, LAST), np.append(b, LAST)
    while (open_ := low < high).any():  # of equal ends a's goes first: the least i with a[i] > b[d - i - 1]
        mid = (low + high) // 2
        right = a_[mid] <= b_[np.maximum(diagonal - mid - 1, 0)]
        low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
    i, j = low[:-1].copy(), (diagonal - low)[:-1].copy()
    seen = np.zeros(len(i), dtype=np.int64)
    group_a, group_b = np.empty(len(a), dtype=np.int64), np.empty(len(b), dtype=np.int64)
    steps = np.diff(diagonal)
    piece_a, piece_b = np.empty(len(a), dtype=np.int64), np.empty(len(b), dtype=np.int64)
    for step in range(int(steps.max())):
        live = slice(0, len(i) if step < steps[-1] else len(i) - 1)  # only the last piece can be shorter
        own, at_a, at_b, count = np.arange(len(i))[live], i[live], j[live], seen[live]
        take = a_[at_a] <= b_[at_b]
        both = take & (a_[at_a] == b_[at_b])
        x = at_a[take]
        group_a[x], piece_a[x] = count[take], own[take]
        y = at_b[~take]
        late = (at_a[~take] > 0) & (a_[at_a[~take] - 1] == b_[y])  # its end was a's last one: the group is the one that has just ended
        group_b[y], piece_b[y] = count[~take] - late, own[~take]
        seen[live] += both
        i[live] += take
        j[live] += ~take
    before = np.cumsum(seen) - seen
    return group_a + before[piece_a], group_b + before[piece_b], int(seen.sum())


def _linked(group_a: np.ndarray, group_b: np.ndarray, n: int, ids_a: np.ndarray, ids_b: np.ndarray, doc: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of links per group, distinct keys, how often each): a key is (document, a id, b id) as one number; ``doc`` is each group's document."""
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    links = count_a * count_b
    start_a, start_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    keys, times = [], []
    ends = np.cumsum(links)
    at = 0
    while at < n:  # some groups at a time; one with very many links by its distinct ids
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * LINKS, side="right")))
        if to == at + 1 and links[at] > LINKS:
            xa, ca = np.unique(ids_a[start_a[at]:start_a[at] + count_a[at]], return_counts=True)
            xb, cb = np.unique(ids_b[start_b[at]:start_b[at] + count_b[at]], return_counts=True)
            for p in range(0, len(xa), max(1, 4 * LINKS // len(xb))):
                q = slice(p, p + max(1, 4 * LINKS // len(xb)))
                keys.append(((doc[at] * wide + xa[q])[:, None] * wide + xb[None, :]).ravel())
                times.append((ca[q][:, None] * cb[None, :]).ravel())
        else:
            g = slice(at, to)
            own = np.repeat(np.arange(at, to), count_a[g])
            a = np.repeat(ids_a[start_a[at]:start_a[at] + len(own)], count_b[own])
            b = ids_b[ragged(start_b[own], count_b[own])]
            found, many = np.unique((np.repeat(doc[own], count_b[own]) * wide + a) * wide + b, return_counts=True)
            keys.append(found)
            times.append(many)
        at = to
    if not keys:
        return links, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return links, found, np.bincount(place, weights=np.concatenate(times), minlength=len(found)).astype(np.int64)


def align_texts(texts: list[str], first: str, second: str) -> list[tuple]:
    """Per text (n_a, n_b, n_groups, n_links, groups, keys, times); keys are a id * 2**32 + b id."""
    a, b, (bytes_a, size_a), (bytes_b, size_b), names = tokenizers(first, second)
    flat, own, ends, good = [], [], [], np.ones(len(texts), dtype=bool)
    want = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    for v, spelled, size in ((a, bytes_a, size_a), (b, bytes_b, size_b)):
        found = v.encode(texts)
        count = np.array([len(x) for x in found], dtype=np.int64)
        ids = np.fromiter((i for x in found for i in x), dtype=np.int64, count=int(count.sum()))
        stops = np.cumsum(size[ids])
        upto = np.concatenate([[0], stops])[np.cumsum(np.concatenate([[0], count]))]
        raw = memoryview(spelled.take(pa.array(ids)).buffers()[2] or b"").cast("B")
        good &= [raw[x:y] == w for x, y, w in zip(upto[:-1].tolist(), upto[1:].tolist(), want)]
        flat.append(ids)
        own.append(np.repeat(np.arange(len(texts)), count))
        ends.append(stops - upto[own[-1]])
    length = np.array([len(w) for w in want], dtype=np.int64) * good
    base = np.cumsum(length) - length
    for k in range(2):
        keep = good[own[k]]
        flat[k], own[k], ends[k] = flat[k][keep], own[k][keep], ends[k][keep]
        ends[k] = ends[k] + base[own[k]]
    group_a, group_b, n = merge_path(ends[0], ends[1])
    doc = np.empty(n, dtype=np.int64)  # a text's last end is shared, so its groups are its own
    doc[group_a] = own[0]
    wide = len(names[0])
    links, keys, times = _linked(group_a, group_b, n, flat[0], flat[1], doc, wide)
    n_a, n_b, n_groups = (np.bincount(x, minlength=len(texts)) for x in (own[0], own[1], doc))
    n_links = np.bincount(doc, weights=links, minlength=len(texts)).astype(np.int64)
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    shown = np.empty(len(group_a) + len(group_b), dtype=object)
    shown[np.arange(len(group_a)) + (np.cumsum(count_b) - count_b)[group_a]] = np.where(last_a, names[1][flat[0]], names[0][flat[0]])
    shown[np.arange(len(group_b)) + np.cumsum(count_a)[group_b]] = np.where(last_b, names[2][flat[1]], names[0][flat[1]])
    shown = shown.tolist()
    own_keys = keys // (wide * wide)
    keys = (keys // wide % wide) << 32 | keys % wide
    at, cuts = 0, np.searchsorted(own_keys, np.arange(len(texts) + 1))
    out = []
    for k, (x, y, g, m) in enumerate(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist())):
        out.append((x, y, g, m, "".join(shown[at:at + x + y])[:-1], keys[cuts[k]:cuts[k + 1]], times[cuts[k]:cuts[k + 1]]))
        at += x + y
    return out


def _portions(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    at, total = 0, 0
    for i, n in enumerate(pa.compute.binary_length(b.column(column)).to_pylist()):
        if total + n > PORTION and i > at:
            yield b.slice(at, i - at)
            at, total = i, 0
        total += n
    if b.num_rows > at:
        yield b.slice(at)


def align_catalog(catalog: DataFrame, first: str, second: str, id: str = "id", description: str = "description") -> DataFrame:
    """Each record's description in two tokenizers, cut into groups where tokens of both end at the same byte.

    ``first`` is a byte-level BPE file (its text gets a space before it), ``second`` a SentencePiece model that puts one there itself.
    One row per record: id (as it is), n_a, n_b (tokens), n_groups, n_links (pairs of tokens of a group), groups (``a1,a2|b1;a3|b2``: ids in
    order), pairs (distinct linked id pairs as 64-bit numbers, the first id above the second one's 32 bits), times (how often each is
    linked, 32-bit numbers). Names of special tokens in a text are plain text. No shuffle.

    A null or empty description has no tokens, nor has one whose tokens do not spell it byte by byte: zeros and an empty text. Repeated
    records have a row each; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = catalog.select(F.col(id).alias("id"), F.coalesce(F.col(description), F.lit("")).alias("description"))
    schema = rows.select("id").schema.add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("n_links", "long").add("groups", "string").add("pairs", "binary").add("times", "binary")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _portions(b, 1):
                out = [(*r[:5], r[5].astype("<i8").tobytes(), r[6].astype("<i4").tobytes()) for r in align_texts(part.column(1).to_pylist(), first, second)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], schema.names)

    return rows.mapInArrow(run, schema)


def score_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` (columns ``pairs`` and ``times`` as ``align_catalog`` gives them) with n_best and count_sum instead of these two.

    An id pair's count is the number of rows that have it linked. ``n_best`` are a row's links whose count is the highest that any pair
    with the same first id has, ties included; ``count_sum`` adds up the counts of all links. A row without pairs has zeros; all
    other columns stay as they are, whatever their names.

    Rows are taken in blocks of about a million pairs, and a block asks for each of its distinct pairs once. So no pair has more rows than
    there are blocks, however many documents link it, and counting starts from the blocks' sums.
    """
    columns = [c for c in aligned.columns if c not in ("pairs", "times")]
    held = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("held")
    rows = aligned.select(held, "pairs", "times")
    held_field = T.StructField("held", rows.schema["held"].dataType)  # a block's own row has none
    blocks = written(rows.mapInArrow(_blocks, T.StructType([held_field]).add("block", "long").add("places", "binary").add("times", "binary").add("asked", "binary").add("rows", "binary")), "aligned")
    asked = blocks.where("asked IS NOT NULL").select("block", "asked", "rows").mapInArrow(_asked, "block long, place int, a int, b int, docs long")
    counts = written(asked.groupBy("a", "b").agg(F.sum("docs").alias("count")), "counts")
    best = written(counts.withColumn("best", F.max("count").over(W.partitionBy("a")) == F.col("count")), "best")  # an id has at most a vocabulary of partners
    told = asked.select("block", "place", "a", "b").join(best, ["a", "b"]).select("block", "place", "count", "best")
    met = blocks.where("asked IS NULL").select("block", "held", "places", "times").unionByName(told, allowMissingColumns=True)
    scored = T.StructType([held_field]).add("n_best", "long").add("count_sum", "long")
    found = met.select("block", "place", "count", "best", "held", "places", "times").repartition("block").sortWithinPartitions("block", F.asc_nulls_last("place")).mapInArrow(_scores, scored)
    return found.select(*(F.col(f"held.`{c}`").alias(c) for c in columns), "n_best", "count_sum")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their pairs as places in their block's list, and a row with the list after each block's rows."""
    part, number = TaskContext.get().partitionId(), 0
    held, size = [], 0

    def close():
        nonlocal held, size, number
        keys = [np.frombuffer(x, dtype="<i8") for r in held for x in r.column(1).to_pylist()]
        asked, place, docs = np.unique(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64), return_inverse=True, return_counts=True)
        place, at, name = place.astype("<i4"), 0, part << 32 | number
        for r in held:
            out = []
            for x in r.column(1).to_pylist():
                out.append(place[at:at + len(x) // 8].tobytes())
                at += len(x) // 8
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array([name] * r.num_rows, pa.int64()), pa.array(out, pa.binary()), r.column(2),
                                              pa.nulls(r.num_rows, pa.binary()), pa.nulls(r.num_rows, pa.binary())], ["held", "block", "places", "times", "asked", "rows"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, held[0].column(0).type), pa.array([name], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                                              pa.array([asked.astype("<i8").tobytes()], pa.binary()), pa.array([docs.astype("<i8").tobytes()], pa.binary())], ["held", "block", "places", "times", "asked", "rows"])
        held, size, number = [], 0, number + 1

    for b in batches:
        for at in range(0, b.num_rows, 100):
            some = b.slice(at, 100)
            held.append(some)
            size += sum(pa.compute.binary_length(some.column(1)).to_pylist()) // 8
            if size > BLOCK:
                yield from close()
    yield from close()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, asked, docs in zip(*(c.to_pylist() for c in b.columns)):
            keys, docs = np.frombuffer(asked, dtype="<i8"), np.frombuffer(docs, dtype="<i8")
            for at in range(0, len(keys), 50_000):
                k = keys[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(np.arange(at, at + len(k), dtype=np.int32)), pa.array((k >> 32).astype(np.int32)),
                                                  pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(docs[at:at + 50_000])], ["block", "place", "a", "b", "docs"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a block come first, in order; its rows look them up."""
    block, parts, counts, best = None, [], None, None
    for b in batches:
        names = b.column(0).to_numpy()
        for at, to in zip(starts := np.flatnonzero(np.r_[True, names[1:] != names[:-1]]), [*starts[1:].tolist(), len(names)]):
            some = b.slice(int(at), to - int(at))
            if names[at] != block:
                block, parts, counts = names[at], [], None
            told = some.num_rows - some.column(1).null_count
            if told:
                head = some.slice(0, told)
                parts.append((head.column(2).to_numpy(), head.column(3).to_numpy(zero_copy_only=False).astype(bool)))
            rest = some.slice(told)
            if not rest.num_rows:
                continue
            if counts is None:
                counts, best = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, dtype=np.int64), np.empty(0, dtype=bool))
            n_best, total = [], []
            for places, times in zip(rest.column(5).to_pylist(), rest.column(6).to_pylist()):
                places, times = np.frombuffer(places, dtype="<i4"), np.frombuffer(times, dtype="<i4").astype(np.int64)
                n_best.append(int(times[best[places]].sum()))
                total.append(int((times * counts[places]).sum()))
            yield pa.RecordBatch.from_arrays([rest.column(4), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], ["held", "n_best", "count_sum"])
