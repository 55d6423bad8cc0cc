"""One JSON document read by many tasks: records of an array, found by a prefix scan over the parts of the file.

Spark's text reader parts a file at ``}``, wherever it stands, so every part of a file of any store is read by a task of its own.
What a part means depends on what is before it: whether it begins inside a quoted text, after a backslash, and how many brackets are
open. A first pass tells for each of these beginnings how the part ends; put together in the order of the parts, that gives every
part its true beginning. A second pass counts the records that begin in each part, a third one reads them. Records that go over
a part's end come in pieces, at most two per part, and are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLOSED, QUOTED, ESCAPED = 0, 1, 2
_PAIR = re.compile(rb"\\.", re.S)
_DELTA = np.zeros(256, dtype=np.int64)
_DELTA[[ord("{"), ord("[")]], _DELTA[[ord("}"), ord("]")]] = 1, -1
_CONTEXT = 128


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, size, bytes): a file's stretches up to each ``}``; ``at`` is where the part begins that they lie in. In order within a part."""
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"),
                       F.col("value").cast("binary").alias("bytes"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """Runs of a part's bytes, with the separators put back; a part may come in several runs."""
    for b in batches:
        files, starts, sizes = (b.column(k).to_pylist() for k in range(3))
        values, i = b.column(3).to_pylist(), 0
        while i < len(values):
            j = i + 1
            while j < len(values) and starts[j] == starts[i] and files[j] == files[i]:
                j += 1
            yield files[i], starts[i], sizes[i], b"}".join(values[i:j]) + b"}"
            i = j


def _quotes(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bytes, whether each is inside a quoted text, state after them) from the state before."""
    plain = _PAIR.sub(b"  ", b" " + data[1:] if state == ESCAPED and data else data)
    codes = np.frombuffer(plain, dtype=np.uint8)
    marks = codes == ord('"')
    inside = (np.cumsum(marks) + (state != CLOSED)) % 2 == 1
    end = QUOTED if len(codes) and inside[-1] else CLOSED if len(codes) else state
    return codes, inside, ESCAPED if end == QUOTED and plain.endswith(b"\\") else end


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How a part ends and how many brackets it opens, from each state it may begin in."""
    seen: dict[tuple[str, int], list] = {}
    for file, at, size, data in _parts(batches):
        row = seen.setdefault((file, at), [file, at, size, 0, [CLOSED, QUOTED, ESCAPED], [0, 0, 0], b""])
        row[3] += len(data)
        row[6] = (row[6] + data)[-_CONTEXT:]
        done: dict[int, tuple[int, int]] = {}
        for k in range(3):
            state = row[4][k]
            if state not in done:
                codes, inside, end = _quotes(data, state)
                done[state] = end, int(_DELTA[codes[~inside]].sum())
            row[4][k], more = done[state]
            row[5][k] += more
    rows = [r for r in seen.values()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))],
                                     ["file", "at", "size", "length", "ends", "opened", "context"])


@dataclass
class Beginning:
    """What is known of a part before it is read: quoting, open brackets, the bytes before it, and the records of the file so far."""

    state: int
    depth: int
    context: bytes
    level: int = 0
    inside: bool = False
    count: int = 0
    opened: list = field(default_factory=list)


class _Scan:
    """Brackets and commas of a part, run by run."""

    def __init__(self, b: Beginning):
        self.state, self.depth, self.context, self.at = b.state, b.depth, b.context, 0

    def next(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, brackets opened after each, where it is outside quoted texts)."""
        codes, inside, self.state = _quotes(data, self.state)
        outside = ~inside
        depth = self.depth + np.cumsum(np.where(outside, _DELTA[codes], 0))
        self.depth = int(depth[-1]) if len(depth) else self.depth
        return codes, depth, outside

    def key(self, data: bytes, place: int) -> str | None:
        """The name of the value that begins at ``place``."""
        before = (self.context + data[:place])[-_CONTEXT:]
        found = re.search(rb'"([A-Za-z_]\w*)"\s*:\s*\Z', before)
        return found[1].decode() if found else None

    def done(self, data: bytes) -> None:
        self.context, self.at = (self.context + data)[-_CONTEXT:], self.at + len(data)


def _counts(known: dict[tuple[str, int], Beginning], names: tuple[str, ...]):
    """Per part the commas between records on each of two levels, and the arrays that begin and end on them, in order.

    An event is (level, 1 for a beginning or -1 for an end, offset, name, commas of that level since the event before).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans: dict[tuple[str, int], list] = {}
        for file, at, _, data in _parts(batches):
            b = known[file, at]
            scan, events, commas = scans.setdefault((file, at), [_Scan(b), [], {1: 0, 2: 0}])
            codes, depth, outside = scan.next(data)
            for level in (1, 2):
                comma = np.flatnonzero((codes == ord(",")) & outside & (depth == level))
                open_ = np.flatnonzero((codes == ord("[")) & outside & (depth == level))
                close = np.flatnonzero((codes == ord("]")) & outside & (depth == level - 1))
                if level == 2:
                    open_ = [x for x in open_ if scan.key(data, int(x)) in names]
                last = 0
                for place, way in sorted([(int(x), 1) for x in open_] + [(int(x), -1) for x in close]):
                    n = int(np.searchsorted(comma, place))
                    events.append((level, way, scan.at + place, (scan.key(data, place) or "") if level == 2 else "", commas[level] + n - last))
                    commas[level], last = 0, n
                commas[level] += len(comma) - last
            scan.done(data)
        kind = pa.list_(pa.struct([("level", pa.int64()), ("way", pa.int64()), ("place", pa.int64()), ("name", pa.string()), ("commas", pa.int64())]))
        told = [[dict(zip(("level", "way", "place", "name", "commas"), e)) for e in events] for _, events, _ in scans.values()]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in scans], pa.string()), pa.array([k[1] for k in scans], pa.int64()), pa.array(told, kind),
                                          pa.array([[r[2][1], r[2][2]] for r in scans.values()], pa.list_(pa.int64()))], ["file", "at", "events", "commas"])

    return run


def _records(known: dict[tuple[str, int], Beginning]):
    """(file, pos, part, text, whole): the records that begin in a part, and pieces of those that go over its beginning or end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()))], ["file", "pos", "part", "text", "whole"])

        for file, at, _, data in _parts(batches):
            b, out = known[file, at], []
            if (file, at) not in held:  # scan, inside the array, number of the record under way, its bytes so far, whether it began here
                held[file, at] = [_Scan(b), b.inside, b.count - 1, b"", False]
            mine = held[file, at]
            scan = mine[0]
            codes, depth, outside = scan.next(data)
            ends = (codes == ord("]")) & (depth == b.level - 1) | (codes == ord(",")) & (depth == b.level)
            opens = {p - scan.at for p in b.opened}
            places = np.flatnonzero(ends & outside).tolist()
            begin = 0
            for place in sorted({*places, *(p for p in opens if 0 <= p < len(data))}):
                if place in opens:
                    mine[1:] = [True, 0, b"", True]
                elif mine[1]:
                    text = mine[3] + data[begin:place]
                    if text.strip() or not mine[4]:
                        out.append((file, mine[2], at, text, mine[4]))
                    inside = codes[place] == ord(",")
                    mine[1:] = [inside, mine[2] + 1, b"", True]
                begin = place + 1
            if mine[1]:
                mine[3] += data[begin:]
            scan.done(data)
            yield batch(out)
        yield batch([(file, number, at, text, False) for (file, at), (_, inside, number, text, _) in held.items() if inside])

    return run


def split_records(spark: SparkSession, path: str, names: tuple[str, ...] = ("data", "products"), on_bad: str = "raise") -> DataFrame:
    """(_file, _pos, record) of JSON documents of any size: the elements of a bare array, or of the first of ``names`` an object has as an array.

    ``record`` is the element's JSON text, ``_pos`` its place in the array. A document is read by as many tasks as Spark parts its file in
    (``spark.sql.files.maxPartitionBytes``), three times. The driver sees one short row per part. A document with brackets or texts
    that do not end is an error; one without such an array is too, or has no rows with ``on_bad='empty'``. Beyond the records only
    brackets and texts are looked at. Empty arrays have no rows.
    """
    fragments = _fragments(spark, path)
    passed = fragments.mapInArrow(_endings, "file string, at long, size long, length long, ends array<long>, opened array<long>, context binary").collect()
    files: dict[str, list] = {}
    for r in sorted(passed, key=lambda r: (r.file, r.at)):
        files.setdefault(r.file, []).append(r)
    known: dict[tuple[str, int], Beginning] = {}
    for file, parts in files.items():
        state, depth, context = CLOSED, 0, b""
        over = sum(r.length for r in parts) - parts[0].size
        for r in parts:
            known[file, r.at] = Beginning(state, depth, context)
            last = r is parts[-1] and over in (1, -2)  # the file has no separator at its end (and maybe a byte order mark)
            extra = int(last and r.ends[state] == CLOSED)
            state, depth, context = r.ends[state], depth + r.opened[state] + extra, r.context
        if depth or state != CLOSED:
            raise ValueError(f"no readable JSON in {file}: it ends with {depth} open brackets" + " inside a text" * (state != CLOSED))

    told = {(r.file, r.at): r for r in fragments.mapInArrow(_counts(known, names), "file string, at long, events array<struct<level:long,way:long,place:long,name:string,commas:long>>, commas array<long>").collect()}
    for file, parts in files.items():
        target = _target(file, [(r.at, told[file, r.at].events) for r in parts], names)
        if target is None and on_bad == "raise":
            raise ValueError(f"no record array in {file}")
        level, start = target or (-1, None)
        count, inside = 0, False
        for r in parts:
            b, row = known[file, r.at], told[file, r.at]
            b.level, b.inside, b.count = level, inside, count
            for e in row.events if target else ():
                if e.level != level:
                    continue
                count += e.commas * inside
                if e.way == 1 and (r.at, e.place) == start:
                    b.opened.append(e.place)
                    inside, count = True, count + 1
                elif e.way == -1:
                    inside = False
            if target:
                count += row.commas[level - 1] * inside
    rows = fragments.mapInArrow(_records(known), "file string, pos long, part long, text binary, whole boolean")
    one = rows.where("whole").select("file", "pos", F.col("text").cast("string").alias("record"))
    pieces = rows.where("NOT whole").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("part", F.col("text").cast("string").alias("text")))).alias("p"))
    joined = pieces.select("file", "pos", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("record")).where(F.col("record").rlike(r"\S"))
    return one.unionByName(joined).select(F.substring_index("file", "/", -1).alias("_file"), F.col("pos").alias("_pos"), "record")


def _target(file: str, parts: list[tuple[int, list]], names: tuple[str, ...]) -> tuple[int, tuple[int, int]] | None:
    """(level, (part, offset)) of the array of records."""
    found: dict[str, tuple[int, int]] = {}
    for at, events in parts:
        for e in events:
            if e.way == 1 and e.level == 1:
                return 1, (at, e.place)
            if e.way == 1:
                found[e.name] = (at, e.place)
    return next(((2, found[n]) for n in names if n in found), None)
