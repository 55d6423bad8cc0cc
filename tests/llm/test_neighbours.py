"""Near-duplicates and components against brute force."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from specmill.llm import graph, language, neighbours, q_neighbours, q_quality, secrets


def shingles(text, words=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(texts, percent=90, words=3):
    sets, root = {i: shingles(t, words) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def edited(words, n, rnd):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10 ** 6)}"
    return " ".join(out)


def test_groups_of_copies(spark):
    rnd, texts = random.Random(6), {}
    for g in range(12):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 9, 10, 11, 12, 25, 60, 120, 300]))]
        for _ in range(25):
            texts[len(texts)] = edited(words, rnd.choice([0, 0, 1, 1, 2, 3, 4, 6]), rnd)
            words = texts[len(texts) - 1].split() if rnd.random() < 0.2 else words  # copies of copies
    texts |= {1_000: "", 1_001: None, 1_002: "one", 1_003: "One", 1_004: "one two", 1_005: "\tone  TWO\n"}
    df = spark.createDataFrame(list(texts.items()), "id long, description string")
    for percent, words in ((90, 3), (75, 3), (80, 5)):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in neighbours.near_duplicates(df, percent=percent, words=words).collect()}
        assert got == brute(texts, percent, words)


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q_neighbours.op4_jaccard_join(spark, sf).collect()}
    assert got == brute(texts)


def test_buckets_leave_no_close_pair(spark):
    """What the leaders leave open is compared in chunks, however many there are."""
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 62, 4, dtype=np.int64)
    rows = [(1, i, i, 40, [int(x) for x in base ^ (np.int64(1) << rnd.integers(0, 60, 4))], 60) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, sig long, component long, n long, bits array<long>, size long")
    whole = {tuple(sorted((r["a"], r["b"]))) for r in neighbours._close_in_buckets(df, 75).collect()}
    size, neighbours.CHUNK = neighbours.CHUNK, 200
    try:
        parts = {tuple(sorted((r["a"], r["b"]))) for r in neighbours._close_in_buckets(df, 75).collect()}
    finally:
        neighbours.CHUNK = size
    apart = {(i, j): sum(bin((x ^ y) & (2 ** 64 - 1)).count("1") for x, y in zip(rows[i][4], rows[j][4])) for i in range(60) for j in range(i + 1, 60)}
    assert whole == parts == {k for k, d in apart.items() if d <= 80 * 25 // 175}


def test_frequent_passages_make_no_large_buckets(spark):
    """Unlike texts with a common passage and a common end: what is compared stays in proportion to the texts."""
    rnd, rows = random.Random(12), []
    common = " ".join(f"c{i}" for i in range(14))
    for i in range(6_000):
        rows.append((i, f"{common} {' '.join(f'w{rnd.randrange(10 ** 6)}' for _ in range(26))} the end of it"))
    for percent, words in ((90, 3), (80, 5)):
        compared = []
        for n in (2_000, 6_000):
            classes = neighbours.signed(spark.createDataFrame(rows[:n], "id long, description string"), percent, words)
            compared.append(neighbours._buckets(classes).groupBy("key").count().selectExpr("sum(count * (count - 1) / 2) AS n").first()["n"] or 0)
        assert compared[1] < 4 * compared[0] + 1_000 and compared[1] < 10 * 6_000, (percent, compared)



def test_few_sets_look_by_empty_blocks():
    rnd = np.random.default_rng(13)
    for percent in (80, 90):
        bands, kept = neighbours.Bands(percent), 0
        for _ in range(2_000):
            h = rnd.integers(0, 1 << 63, int(rnd.integers(9, 700)), dtype=np.uint64)
            for k in bands.of(len(h)):
                signs = neighbours.parity_sketch(h, bands.blocks(k))[0]
                keys, spare = bands.keys(signs, len(h), k)
                assert ((keys == neighbours.DROPPED) | (keys == neighbours.EMPTY))[signs == 0].all() and not np.isin(keys[signs != 0], (neighbours.DROPPED, neighbours.EMPTY)).any()
                assert bands.blocks(k) >= bands.differ(2 * (bands.bounds[k + 1] - 1)) + 2
                kept += (keys == neighbours.EMPTY).any()
                assert spare == 0 or spare == (signs != 0).sum() - bands.most(len(h), k) - 1
        assert kept < 10


def test_sketch_bounds_the_difference():
    rnd, bands = np.random.default_rng(7), neighbours.Bands(90)
    for _ in range(300):
        n = int(rnd.integers(9, 900))
        a = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        d = int(rnd.integers(0, max(1, n // 20)))
        b = np.r_[a[d:], rnd.integers(0, 1 << 63, d, dtype=np.uint64)]
        for k in set(bands.of(len(a))) & set(bands.of(len(b))):
            (s, f), (t, g) = (neighbours.parity_sketch(x, bands.blocks(k)) for x in (a, b))
            assert np.bitwise_count(f ^ g).sum() <= 2 * d
            if 2 * d <= bands.differ(len(a) + len(b)):
                assert (s == t).any()


def test_components(spark):
    rnd = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in links)}


def test_marks(spark):
    rows, members = spark.range(2_000).selectExpr("IF(id = 7, NULL, id) AS k", "id AS w_x"), spark.range(0, 2_000, 10).selectExpr("id AS m")
    maybe, never = graph.maybe_in(rows, "k", members, "m")
    hits = {r["k"] for r in maybe.collect()}
    assert hits >= set(range(0, 2_000, 10)) and len(hits) < 300 and maybe.count() + never.count() == 2_000 and never.where("k IS NULL").count() == 1


def test_pipeline(spark, sf):
    """Each stage on its own input against a plain version."""
    records, before, inputs = corpus_pipeline.records, None, {}
    docs = records.documents(spark, sf)
    rows = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, records.written(stage(spark, docs.withColumn("key", docs["doc_id"]), sf), name)
        inputs[name] = rows(before)
        if name != "packing":
            assert docs.columns == list(records.DOCUMENT)
            found = rows(docs)
            assert len(found) == docs.count()
            if name != "secret_scans":
                assert all(found[i] == {c: inputs[name][i][c] for c in records.DOCUMENT} for i in found)
        texts = {i: r["text"] for i, r in inputs[name].items()}
        if name == "quality_classifier":
            assert set(found) == {r["doc_id"] for r in q_quality.op8_quality(spark, sf).collect() if r["predicted"] == 1}
        elif name == "language_id":
            learned = language.fit_languages(before.where(records.fold("doc_id", 5) != 0), "doc_id", "text", "lang")
            clear = {r["id"] for r in language.identify_language(records.as_catalog(before), learned).collect() if not r["rejected"]}
            assert set(found) == clear and all(re.search(r"[^\W\d_]", texts[i]) for i in found)
        elif name == "jaccard_join":
            assert set(found) == {c for _, c in brute(texts, 80, 5).values()}
        elif name == "secret_scans":
            assert set(found) == set(texts)
            for i, t in texts.items():
                spans, out, at = secrets.find_spans(t), [], 0
                for kind, start, end in spans:
                    if start >= at:
                        out += [t[at:start], f"<{kind}>"]
                    at = max(at, end)
                assert found[i]["text"] == "".join(out) + t[at:] and found[i]["n_chars"] == len(found[i]["text"])
                assert not re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", found[i]["text"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    pieces = docs.toPandas()
    assert set(pieces.doc_id) == set(inputs["packing"])
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        ids, at = tokenizer.encode(inputs["packing"][i]["text"], add_special_tokens=False).ids + [1], 0
        for r in g.itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at:at + r.length], dtype="<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, run.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "start", "ids_crc32").collect()))
