"""Rules, licenses, fingerprints, packing and segmentations against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from specmill.llm import fingerprints, licenses, packing, q_fingerprints, q_licenses, q_packing, q_rules, q_segments, segments

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_rules(spark, sf, texts):
    for r in q_rules.op5_quality_rules(spark, sf).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        seen = Counter(windows)
        covered = {i + j for i, g in enumerate(windows) if seen[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_rules_are_native(spark, sf):
    plan = q_rules.op5_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_license_base(spark, sf, texts):
    for r in q_licenses.op10_license_scan(spark, sf).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r["doc_id"]] or "").translate(LOWER))
        found = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        base = sorted({x[1] for x in found})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(found), min((x[0] for x in found), default=None), max((x[0] for x in found), default=None), ",".join(base))
        assert set(base) <= set(r["labels"].split(",")) | ({""} - set(base))


def test_license_templates(spark):
    notice = dict(licenses.TEMPLATES[:1])["mit"]
    w = notice.split()
    rows = [(1, "Some words first. " + notice + " And more."), (2, " ".join(w[:20] + ["inserted"] + w[20:60] + w[62:])), (3, " ".join(w[:12])), (4, notice.upper()),
            (5, " ".join(reversed(w)))]
    spans = {r["id"]: r for r in licenses.license_spans(spark.createDataFrame(rows, "id long, description string")).where("label = 'mit'").collect()}
    assert set(spans) == {1, 2, 4}
    assert (spans[1]["first_word"], spans[1]["covered"]) == (3, 1.0)
    assert 0.9 < spans[2]["covered"] < 1


def grams(text):
    """Five-word shingles by the library's own words, as tuples: no hash."""
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, sf, texts):
    got = {r["doc_id"]: r for r in q_fingerprints.op9_fingerprints(spark, sf).collect()}
    order = sorted(texts, reverse=True)
    prints, errors = {}, {}
    for i, d in enumerate(order):
        t, following = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        edited = t[:len(t) - len(t) // 3] + following[:len(t) // 3]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for text, shown in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(frozenset(grams(text)), shown) == shown  # the same for the same shingles
        for other, near in ((edited, r["near_edited"]), (following, r["near_next"])):
            a, b = grams(t), grams(other)
            if a and b:
                errors.setdefault(min(len(a), len(b)).bit_length(), []).append(near - len(a & b) / min(len(a), len(b)))
    kept = {h for shown in prints.values() for h in re.findall("." * 12, shown)}
    assert all(int(h, 16) < fingerprints.FRACTION * 2 ** 48 for h in kept)
    whole = len({g for gs in prints for g in gs})
    assert abs(len(kept) / whole - fingerprints.FRACTION) < 0.02
    for bits, found in errors.items():  # the estimate's error falls with the root of the kept hashes
        assert np.sqrt(np.mean(np.square(found))) < max(0.02, 0.6 / np.sqrt(2 ** (bits - 1) * fingerprints.FRACTION)), bits
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.3


def test_containment_is_estimated():
    rnd, eighth = np.random.default_rng(3), 1 / 8
    w = [f"w{x}" for x in rnd.integers(0, 10 ** 6, 8_000)]
    words = fingerprints.table()
    whole, part = fingerprints.sketch(" ".join(w), words, eighth), fingerprints.sketch(" ".join(w[2_000:3_000]), words, eighth)
    assert abs(len(whole) / 8_000 - 1 / 8) < 0.02 and fingerprints.likeness(whole, part) == 1
    mixed = fingerprints.sketch(" ".join(w[:500] + [f"v{i}" for i in range(500)]), words, eighth)
    assert 0.35 < fingerprints.likeness(whole, mixed) < 0.65
    left, right = fingerprints.sketch(" ".join(w[:4_000]), words, eighth), fingerprints.sketch(" ".join(w[3_996:]), words, eighth)
    assert set(whole) == set(left) | set(right)


def test_errors_by_text_length():
    """Containment of unequal and of edited texts, against the true one; texts of any length come through the same threshold."""
    rnd, words = np.random.default_rng(4), fingerprints.table()
    for n, bound in ((9, 0.35), (20, 0.2), (60, 0.11), (200, 0.06), (2_000, 0.03), (6_000, 0.02)):
        errors = []
        for _ in range(max(6, 2_000 // n)):
            part = [f"p{x}" for x in rnd.integers(0, 10 ** 6, n)]
            longer = [f"l{x}" for x in rnd.integers(0, 10 ** 6, 600)]
            a, b = fingerprints.sketch(" ".join(part), words), fingerprints.sketch(" ".join(longer[:300] + part + longer[300:]), words)
            assert set(a) <= set(b) and fingerprints.likeness(a, b) == fingerprints.likeness(b, a) == float(len(a) > 0)
            edited = part[:n - n // 3] + [f"e{x}" for x in range(n // 3)]
            x, y = grams(" ".join(part)), grams(" ".join(edited))
            errors.append(fingerprints.likeness(a, fingerprints.sketch(" ".join(edited), words)) - len(x & y) / min(len(x), len(y)))
        assert np.sqrt(np.mean(np.square(errors))) < bound, n
    assert fingerprints.likeness(*[fingerprints.sketch("", words)] * 2) == 1


def test_sketches_of_parts_merge():
    w, words = [f"w{i}" for i in range(4_000)], fingerprints.table()
    for size in (7, 200, 1_500):
        parts = [fingerprints.sketch(" ".join(w[max(0, at - 4):at + size]), words) for at in range(0, 4_000, size)]
        assert set(np.concatenate(parts)) == set(fingerprints.sketch(" ".join(w), words))
    half, quarter = fingerprints.sketch(" ".join(w), words), fingerprints.sketch(" ".join(w), words, 1 / 4)
    assert quarter.tolist() == half[half < 2 ** 46].tolist()


def test_packing(spark, sf, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = q_packing.op3_packing(spark, sf).toPandas()
    for d, g in got.sort_values("start").groupby("doc_id"):
        ids, at = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [1], 0
        for r in g.itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(got.doc_id) == set(texts)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        total = int(g.length.sum())
        assert total == 2048 or total & (total - 1) == 0 and total < 2048


@pytest.mark.parametrize("text", ["", "a", " \n\n  x", "<|endoftext|>", "a<|endoftext|> b", "it's ÉTÉ 漢字 🙂\r\n\t١٢", "x" * 5_000, "\x00\x7f"])
def test_encoder_is_the_tokenizers(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_are_neighbours(dimensions, bits):
    grid = np.array(np.meshgrid(*[range(1 << bits)] * dimensions)).reshape(dimensions, -1).T
    key = packing.hilbert(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_segmentations_of_documents(spark, sf, texts):
    read = segments.decode_segmentations(q_segments.sampled(spark, sf), public_tokenizers.path(q_segments.MODEL)).collect()
    assert all(r["text"] == (texts[r["id"]] or "") for r in read)
    rows = q_segments.op6_sampled_segmentations(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert len({(r["doc_id"], r["ids_crc32"]) for r in rows}) == len(rows) == 2 * len(texts)
    again = q_segments.op6_sampled_segmentations(spark, sf).collect()
    assert sorted((r["doc_id"], r["rank"], r["ids_crc32"]) for r in rows) == sorted((r["doc_id"], r["rank"], r["ids_crc32"]) for r in again)


def test_query_decodes_its_segmentations(spark, sf, texts):
    for r in q_segments.op6_sampled_segmentations(spark, sf).collect():
        assert r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_spelled_as_the_model_decodes():
    v, rnd = segments.vocabulary(public_tokenizers.path("piece_bpe_32k.model")), np.random.default_rng(9)
    rows = [rnd.integers(0, high, rnd.integers(0, 9)).astype(np.uint32) for high in (4, 300, 32_000) for _ in range(2_000)]
    rows += [np.array(v.model.encode(t), dtype=np.uint32) for t in ("", " ", "  a ", "\n", "漢字 🙂 \u0378 é\x00", "\u2581 x")]
    assert v.spell(rows) == [v.decode(x) for x in rows] and v.spell([]) == []


def test_segmentations_are_draws_without_replacement():
    v, n, text = segments.vocabulary(public_tokenizers.path("piece_bpe_32k.model")), 20_000, "hello ab\nc"
    got = segments.sample_batch(v, [text] * n, segments._mixed(np.arange(n, dtype=np.uint64)), 3)
    p = {y[0].tobytes(): float(np.exp(y[1])) for x in got for y in x}
    assert sum(p.values()) > 0.999
    seen = Counter(tuple(y[0].tobytes() for y in x) for x in got)
    for (a, b, c), m in seen.most_common(8):
        expected = p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b])
        assert abs(m / n - expected) < 5 * np.sqrt(expected / n) + 1e-3
    assert all(x[i][2] >= x[i + 1][2] for x in got[:500] for i in range(2))
    assert abs(np.mean([sum(np.exp(y[1]) / y[3] for y in x) for x in got]) - 1) < 0.02  # inclusion weights give unbiased sums


def test_all_segmentations_of_a_short_text():
    v = segments.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    (found,) = segments.sample_batch(v, ["ab c"], np.zeros(1, dtype=np.uint64), 1_000)

    def ways(t):
        return [[]] if not t else [[t[:i], *w] for i in range(1, len(t) + 1) if v.model.piece_to_id(t[:i]) != 0 for w in ways(t[i:])]

    assert len({y[0].tobytes() for y in found}) == len(found) == len(ways("▁ab")) * len(ways("▁c"))
    assert sum(np.exp(y[1]) for y in found) == pytest.approx(1.0)
    assert all(v.decode(y[0]) == "ab c" and y[3] == 1.0 for y in found)


def test_coordinates_are_projected_means():
    fields = packing.projection(1 << 16)
    ids = np.random.default_rng(6).integers(0, 50_257, 70_000).astype(np.uint32)
    signs = np.array([[(int(f) >> 16 * k & 0xFFFF) - 1 for k in range(packing.DIMENSIONS)] for f in fields[ids[:40_000]]])
    assert set(np.unique(signs)) == {-1, 1}
    expected = ((np.tanh(4 * signs.mean(axis=0)) + 1) / 2 * 1023).astype(np.int64)
    assert np.abs(packing.coordinates(ids[:40_000], fields) - expected).max() <= 1
    assert packing.coordinates(ids[:0], fields).tolist() == [511] * packing.DIMENSIONS
