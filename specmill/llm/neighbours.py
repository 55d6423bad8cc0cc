"""Near-duplicate descriptions: Jaccard join of word shingles by parity sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .graph import components, free, maybe_in
from .grams import Table
from .records import written

GROWTH, CHUNK = 1.5, 4 << 20
#: Block signatures that are no XOR: a block that needs no bucket, and an empty one that does.
DROPPED, EMPTY = 0, -1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def table() -> Table:
    return Table(lambda w: (xxhash.xxh64_intdigest(w),), 1)


def shingle_hashes(text: str | None, words: Table, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Words are parted by the six ASCII blanks, A-Z are lower-cased.

    A text of fewer words is one shingle; a text without words has none.
    """
    w = words.rows((text or "").encode("utf-8", "surrogatepass").lower().split())[:, 0]
    if not len(w):
        return np.empty(0, dtype=np.uint64)
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1, dtype=np.uint64) + np.uint64(n)
    for i in range(n):
        h = (h ^ w[i:len(w) - n + 1 + i]) * _A
        h = (h ^ (h >> np.uint64(32))) * _B
    return np.unique(h ^ (h >> np.uint64(29)))


class Bands:
    """Size bands, and what two sets of a band may differ by.

    Sets with sizes a <= b link if their Jaccard similarity is ``percent`` % or more; then a >= percent % of b, and they differ by at most
    (a + b) (100 - percent) / (100 + percent) shingles. The band of a pair is that of b. A band for sizes up to U has more blocks than
    two sets of size U may differ by, so some blocks of a linked pair hold no differing shingle (pigeonhole), and so many more that
    nearly every set has such blocks that are not empty, too.
    """

    def __init__(self, percent: int):
        self.percent = percent
        first = max(1, -(-(100 + percent) // (2 * (100 - percent)))) if percent < 100 else 1 << 40
        self.bounds = [first]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * GROWTH)))

    def differ(self, total):
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[int]:
        """Bands in which a set of size ``n`` may have a partner: its own, and the next if a larger partner may lie there."""
        own = int(np.searchsorted(self.bounds, n, side="right")) - 1
        out = [own] if own >= 0 else []
        if own + 1 < len(self.bounds) and 100 * n >= self.percent * self.bounds[own + 1]:
            out.append(own + 1)
        return out

    def blocks(self, band: int) -> int:
        top = self.bounds[band + 1] - 1
        least = self.differ(2 * top) + 2
        empty = least * math.exp(-top / least)
        return least + math.ceil(empty + 6 * math.sqrt(empty))

    def most(self, n: int, band: int) -> int:
        """What a set of size ``n`` and a partner of the band may differ by."""
        return self.differ(n + min(100 * n // self.percent, self.bounds[band + 1] - 1))

    def keys(self, signs: np.ndarray, n: int, band: int) -> tuple[np.ndarray, int]:
        """The signatures, folded to 32 bits, under which a set of size ``n`` looks for partners, and how many of them it may leave out.

        With q filled blocks and d shingles that it may differ by, a set agrees with each partner in q - d filled blocks or more: empty ones,
        which many sets have in common, are dropped, and of the filled ones any q - d - 1 may be left out, if both sets leave out the
        last ones in the same order of all signatures: the first one they share is then among those that stay. A set with d filled
        blocks or fewer keeps all, the empty ones too.
        """
        filled = signs != 0
        folded = (signs ^ (signs >> np.uint64(32))).astype(np.uint32).view(np.int32) | np.int32(2)  # neither 0 nor -1
        folded[folded == EMPTY] ^= 1
        spare = int(filled.sum()) - self.most(n, band) - 1
        return np.where(filled, folded, np.int32(DROPPED if spare >= 0 else EMPTY)), max(0, spare)


def parity_sketch(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketch of a set, in two forms: a signature per block, and folded bits.

    Each shingle flips one bit of its block. A block has a bit for every hash, so what is kept of it is the XOR of the hashes whose bits
    are set: equal signatures mean equal blocks, and a block without shingles has 0. Folded to 16 bits per block, the sketches of two sets
    differ in no more bits than the sets differ in shingles, since shared shingles flip the same bits.
    """
    signs, bits = np.zeros(blocks, dtype=np.uint64), np.zeros(-(-blocks // 4), dtype=np.uint64)
    mixed = hashes * _C
    np.bitwise_xor.at(signs, ((mixed >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), mixed ^ (mixed >> np.uint64(29)))
    place = (mixed >> np.uint64(8)) % np.uint64(64 * len(bits))
    np.bitwise_xor.at(bits, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return signs, bits


def signed(catalog: DataFrame, percent: int, words: int, id: str = "id", description: str = "description") -> DataFrame:
    """(id, text_hash, n, sig, bands) per record: size and hash of its shingle set, and its sketches (band, blocks, spare, bits); sig is null without shingles."""
    rows = catalog.select(F.col(id).alias("id"), F.xxhash64(description).alias("text_hash"), F.col(description).alias("description"))
    bands = Bands(percent)
    kind = pa.list_(pa.struct([("band", pa.int32()), ("blocks", pa.list_(pa.int32())), ("spare", pa.int32()), ("bits", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table()
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                n, sig, sketches = [], [], []
                for text in part.column(2).to_pylist():
                    h = shingle_hashes(text, known, words)
                    n.append(len(h))
                    sig.append(int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64)) if len(h) else None)
                    sketches.append([{"band": k, "blocks": keys, "spare": spare, "bits": f.view(np.int64)} for k in bands.of(len(h)) for s, f in [parity_sketch(h, bands.blocks(k))]
                                     for keys, spare in [bands.keys(s, len(h), k)]]
                                    if len(h) else [])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(sketches, kind)],
                                                 ["id", "text_hash", "n", "sig", "bands"])

    sketch = T.StructType().add("band", "integer").add("blocks", T.ArrayType(T.IntegerType())).add("spare", "integer").add("bits", T.ArrayType(T.LongType()))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType)]).add("text_hash", "long").add("n", "long").add("sig", "long").add("bands", T.ArrayType(sketch)))


def _verified(pairs: DataFrame, members: DataFrame, catalog: DataFrame, percent: int, words: int, id: str, description: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their whole shingle sets.

    Texts are fetched for the sets that occur in a pair only. A pair goes to its b, in up to 16 shares so that no b is a hot key; the
    set of b is sent once for each share.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(members.select("sig", "id", "text_hash"), "sig")
    rows = catalog.select(F.col(id).alias("id"), F.col(description).alias("description"))
    maybe, never = maybe_in(rows, "id", needed, "id")
    rows = maybe.unionByName(never.where("id IS NULL")).withColumn("text_hash", F.xxhash64("description"))
    named = needed.withColumnsRenamed({"id": "id_", "text_hash": "text_hash_"})
    texts = rows.join(named, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("text_hash_"))).select("sig", "description").dropDuplicates(["sig"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t, known, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["sig", "hashes"])

    sets = written(texts.mapInArrow(hashed, "sig long, hashes binary"), "sets")
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a", F.lit(31)), F.lit(16)).cast("int").alias("share"))
    left = dealt.join(sets.withColumnRenamed("sig", "a"), "a").select("b", "share", F.col("a").cast("long").alias("a"), "hashes")
    right = dealt.select("b", "share").distinct().join(sets.withColumnRenamed("sig", "b"), "b").select("b", "share", F.lit(None).cast("long").alias("a"), "hashes")
    met = right.unionByName(left).repartition("b", "share").sortWithinPartitions("b", "share", F.asc_nulls_first("a"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for r in batches:
            out = []
            for b, a, h in zip(r.column(0).to_pylist(), r.column(2).to_pylist(), r.column(3).to_pylist()):
                h = np.frombuffer(h, dtype=np.uint64)
                if a is None:
                    current = h
                    continue
                same = len(np.intersect1d(current, h, assume_unique=True))
                if 100 * same >= percent * (len(current) + len(h) - same):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return written(met.mapInArrow(similar, "a long, b long"), "links")


def _close_in_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members from different components whose sketches are close enough for a link.

    ``rows``: key, sig, component, n, bits, size (members of the bucket). A bucket is cut into chunks of a few megabytes of
    sketches, and a task sees two chunks at once, so none holds a whole bucket. Only close pairs leave the task.
    """
    chunks = F.ceil(F.col("size") * 8 * F.size("bits") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("sig", F.lit(37)), F.col("chunks")).cast("int")
    spread = rows.withColumn("chunks", F.greatest(F.lit(1), chunks)).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sig", "component", "n", "bits")
    met = spread.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "sig")
    bands = Bands(percent)

    def close(run: list[tuple]) -> list[tuple[int, int]]:
        sig, part, comp, n = (np.array([r[i] for r in run], dtype=np.int64) for i in (4, 3, 5, 6))
        sketch = np.array([r[7] for r in run], dtype=np.int64).view(np.uint64)
        out = []
        for i in range(len(run) - 1):
            j = np.arange(i + 1, len(run))
            j = j[(comp[j] != comp[i]) & ((part[j] != part[i]) | (run[0][1] == run[0][2]))
                  & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
            if len(j):
                apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                out += [(int(sig[k]), int(sig[i])) for k in j[apart <= bands.differ(n[i] + n[j])]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][:3] != row[:3]:
                    out += close(held)
                    held = []
                held.append(row)
            yield emit(out)
        yield emit(close(held) if held else [])

    return met.mapInArrow(run, "a long, b long").distinct()


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, sig, n, band, size): the keys by which sets look for partners; ``size`` is how many sets have the key at all.

    Each set leaves out as many of its most frequent keys as it may, so a passage or an ending that many texts share brings few together.
    """
    keyed = classes.select("sig", "n", F.inline("bands")).select("sig", "n", "band", "spare", F.posexplode("blocks").alias("block", "sign")).where(F.col("sign") != DROPPED).select(
        F.xxhash64("band", "block", "sign").alias("key"), "sig", "n", "band", "spare")
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    often = F.row_number().over(W.partitionBy("sig", "band").orderBy(F.desc("size"), F.desc("key")))  # as many as a set has blocks
    ranked = maybe_in(keyed, "key", shared, "key")[0].join(shared, "key").withColumn("often", often)
    return written(ranked.where("often > spare").select("key", "sig", "n", "band", "size"), "met")


def near_duplicates(catalog: DataFrame, id: str = "id", description: str = "description", percent: int = 90, words: int = 3) -> DataFrame:
    """Components of records whose ``words``-word shingle sets have a Jaccard similarity of ``percent`` % or more.

    One row (id, n_shingles, set_id, component_id) per record; set_id tells equal sets, component_id is the smallest id that can be
    reached by links, the record's own included. No link between different sets is lost; equal sets are told by a 64-bit hash.

    Records with the same set are one class, and only classes are joined. Each class puts the blocks of its parity sketch, per size
    band, into buckets; two classes that may link share a bucket. In each bucket every class is held against one other, the class
    that shares most: this joins groups of copies without their pairs. Then only members of a bucket that are still in different
    components are compared, by the bits their sketches differ in, and what is close enough is verified by the whole sets.

    A record with a null description or without words has no shingles and is alone; without id its component is null unless a
    linked record has one. Repeated records are linked. Ids are of any type that has an order and keep it; other columns are ignored.
    """
    return _grouped(catalog, id, description, percent, words).select("id", F.col("n").alias("n_shingles"), F.col("sig").alias("set_id"), "component_id")


def _grouped(catalog: DataFrame, id: str, description: str, percent: int, words: int) -> DataFrame:
    """(id, text_hash, n, sig, component_id, component_hash) per record; the last two are of the first record of its component."""
    all_rows = written(signed(catalog, percent, words, id, description), "signed")
    first = F.struct(F.col("id").isNull().alias("null_"), "id", "text_hash")
    classes = written(all_rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min_by(F.struct("id", "text_hash", "n", "bands"), first).alias("r")).select("sig", "r.*"), "classes")

    met = _buckets(classes)
    scores = met.groupBy("sig").agg(F.sum("size").alias("score"))
    leaders = written(met.join(scores, "sig").groupBy("key").agg(F.max(F.struct("score", "sig", "n")).alias("r"), F.count("*").alias("members")).where("members > 1").select(
        "key", F.col("r.sig").alias("leader"), F.col("r.n").alias("m"), "members"), "leaders")
    led = met.join(leaders, "key").where("sig <> leader")
    bits = F.map_from_entries(F.transform("bands", lambda b: F.struct(b["band"], b["bits"]))).alias("sketch")
    members = written(classes.join(scores.select("sig"), "sig").select("sig", "id", "text_hash", "n", bits), "members")

    sketches = members.select("sig", "sketch")
    alike = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    pairs = led.where(alike).select("sig", "leader", "band", "n", "m").distinct().withColumn(
        "share", F.pmod(F.xxhash64("sig", F.lit(41)), F.lit(16)).cast("int"))
    leading = pairs.select("leader", "share").distinct().join(sketches.select(F.col("sig").alias("leader"), F.col("sketch").alias("other")), "leader")
    looked = pairs.join(sketches, "sig").join(leading, ["leader", "share"])  # in shares, so that no leader is a hot key
    apart = F.aggregate(F.zip_with(F.expr("sketch[band]"), F.expr("other[band]"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = looked.where(apart <= F.floor((F.col("n") + F.col("m")) * (100 - percent) / (100 + percent)))
    star = _verified(close.select(F.col("sig").alias("a"), F.col("leader").alias("b")).distinct(), members, catalog, percent, words, id, description)

    # what the leaders have not joined
    joined = components(star).withColumnsRenamed({"node": "sig"})
    rest = led.where("members > 2").select("key", "band", "sig", F.col("members").alias("size")).join(joined, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    mixed = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rest = rest.join(mixed, "key")
    rows = rest.join(members.select("sig", "n", "sketch"), "sig").select("key", "sig", "component", "n", F.expr("sketch[band]").alias("bits"), "size")
    more = _verified(written(_close_in_buckets(rows, percent), "close"), members, catalog, percent, words, id, description)

    links = more
    for end in ("a", "b"):
        links = links.join(joined.select(F.col("sig").alias(end), F.col("component").alias("label")), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    again = components(links).withColumnsRenamed({"node": "label", "component": "lower"})  # of components only
    nodes = joined.unionByName(again.select(F.col("label").alias("sig"), F.col("label").alias("component"))).distinct()
    found = nodes.join(again, F.col("component") == F.col("label"), "left").select("sig", F.coalesce("lower", "component").alias("component")).distinct()
    lowest = classes.select("sig", "id", "text_hash").join(found, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    named = lowest.join(lowest.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("null_"), "id", "text_hash")).alias("first")), "component").select(
        "sig", F.col("first.id").alias("component_id"), F.col("first.text_hash").alias("component_hash"))
    alone = F.col("sig").isNull()
    return all_rows.select("id", "text_hash", "n", "sig").join(named, "sig", "left").select(
        "id", "text_hash", "n", "sig", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("text_hash")).otherwise(F.col("component_hash")).alias("component_hash"))


def keep_first(catalog: DataFrame, id: str = "id", description: str = "description", percent: int = 90, words: int = 3) -> DataFrame:
    """Catalogue records without near-duplicates: of each component the record with the smallest id stays, all columns as they are.

    Rows are told apart by id and description, so unlike texts with the same id stay, each for its own component; of rows with the
    same id and description, or of one component's rows with its smallest id, one stays. Records without id can't be named and all
    stay. Only rows whose id may be among those to go are shuffled.
    """
    goes = ~(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_hash")))
    found = written(_grouped(catalog, id, description, percent, words).select("id", "text_hash", goes.alias("goes")), "found")
    doubtful = found.where("id IS NOT NULL").groupBy("id", "text_hash").agg(F.count("*").alias("n"), F.max("goes").alias("goes")).where("n > 1 OR goes").select(
        F.col("id").alias("doubtful_id"), F.col("text_hash").alias("doubtful_hash"), "goes")
    own, text_hash = free(catalog.columns, "own_id", "own_hash")
    rows = catalog.withColumn(own, F.col(id)).withColumn(text_hash, F.xxhash64(description))
    maybe, stays = maybe_in(rows, own, doubtful, "doubtful_id")
    held = maybe.select(F.struct(*(F.col(f"`{c}`") for c in catalog.columns)).alias("held"), F.col(own).alias("own_id"), F.col(text_hash).alias("own_hash"))
    looked = held.join(doubtful, (F.col("own_id") == F.col("doubtful_id")) & (F.col("own_hash") == F.col("doubtful_hash")), "left").where("goes IS NULL OR NOT goes")
    again = looked.where("goes IS NOT NULL").withColumn("place", F.row_number().over(W.partitionBy("own_id", "own_hash").orderBy("own_id"))).where("place = 1")
    kept = looked.where("goes IS NULL").select("held").unionByName(again.select("held"))
    return stays.drop(own, text_hash).unionByName(kept.select(*(F.col(f"held.`{c}`").alias(c) for c in catalog.columns)))
