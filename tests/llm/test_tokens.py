"""Token counts and tokenizer alignment against the tokenizer libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specmill.llm import alignment, q_alignment, q_tokens, tokens

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a▁b", "<s>x</s><|endoftext|>", "\n\n\t", "漢字🙂éß", "word " * 3_000, "Zz9-" * 5_000, "é", "\x00", " " * 300, "aaaa" * 50, "a" * 200 + " " * 77 + "the"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=SECOND)


def test_counts_of_the_table(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in q_tokens.op11_token_counts(spark, sf).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}


def test_counts_of_odd_texts(library):
    random.seed(5)
    signs = "aabbcc   the in er on\n\t.,<s></s>▁éß漢🙂0123\x00"
    texts = ODD + ["".join(random.choices(signs, k=random.randint(0, 400))) for _ in range(400)] + [" " * k for k in range(140)] + ["ab" * k for k in range(90)]
    counter = tokens.Counter(SECOND)
    assert counter.count(texts) == [len(library.encode(t)) for t in texts] == counter.count(texts)
    assert counter.count([None]) == [0]


def test_merges_need_a_model_of_merges(monkeypatch):
    held = tokens.merges(SECOND)
    words = ["▁hello", "▁" * 9, "q", "漢", "▁the▁", ""]
    # each word alone gives what all give together
    assert held.counts(words).tolist() == [int(held.counts([w])[0]) for w in words]


def test_awkward_records(spark):
    rows = [("p-1", "Hoist with 500 kg."), ("p-1", "Hoist with 500 kg."), (None, "no id"), ("p-2", None), ("p-3", ""), ("p-4", "x " * 9_000)]
    df = spark.createDataFrame(rows, "id string, description string").select("*", *(F.lit("z").alias(c) for c in ("n_tokens", "n_bytes", "pairs", "held", "n_a", "block", "a", "text")))
    got = tokens.count_tokens(df, SECOND, limit=5).collect()
    assert Counter((r["id"], r["over_limit"]) for r in got) == Counter({("p-1", True): 2, (None, False): 1, ("p-2", False): 1, ("p-3", False): 1, ("p-4", True): 1})
    assert tokens.count_tokens(df.limit(0), SECOND).collect() == []
    aligned = alignment.align_catalog(df, FIRST, SECOND)
    assert Counter((r["id"], r["n_a"] > 0) for r in aligned.collect()) == Counter({("p-1", True): 2, (None, True): 1, ("p-2", False): 1, ("p-3", False): 1, ("p-4", True): 1})
    scored = alignment.score_links(aligned.withColumn("place", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("count", F.lit(3)))
    assert scored.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "place", "a.b", "count", "n_best", "count_sum"]
    by = {r["id"]: r for r in scored.collect()}
    assert (by["p-2"]["n_best"], by["p-2"]["count_sum"], by["p-2"]["groups"]) == (0, 0, "") and by["p-1"]["count_sum"] >= 2 * by["p-1"]["n_links"]
    assert alignment.score_links(alignment.align_catalog(df.limit(0), FIRST, SECOND)).collect() == []


@pytest.mark.parametrize("work", [1, 2, 3, 7, 256])
def test_merge_path(work):
    random.seed(work)
    for size in (0, 1, 5, 40, 400):
        a, b = (np.array(sorted(random.sample(range(3 * size + 1), size)), dtype=np.int64) for _ in range(2))
        top = np.int64(3 * size + 5)
        a, b = np.append(a, top), np.append(b, top)
        shared = sorted(set(a.tolist()) & set(b.tolist()))
        group_a, group_b, n = alignment.merge_path(a, b, work)
        assert n == len(shared)
        assert group_a.tolist() == np.searchsorted(shared, a).tolist() and group_b.tolist() == np.searchsorted(shared, b).tolist()


def brute(texts: dict) -> dict:
    slow, pieces = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    slow.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    links, rows = {}, {}
    for i, t in texts.items():
        a = slow.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        bytes_a = [bytes(byte[c] for c in slow.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(pieces.id_to_piece(x)[3:5], 16)]) if pieces.is_byte(x) else pieces.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        groups, x, y, at_a, at_b = [], 0, 0, 0, 0
        while x < len(a):
            left, right = [a[x]], [b[y]]
            at_a, at_b, x, y = at_a + len(bytes_a[x]), at_b + len(bytes_b[y]), x + 1, y + 1
            while at_a != at_b:
                if at_a < at_b:
                    left.append(a[x])
                    at_a, x = at_a + len(bytes_a[x]), x + 1
                else:
                    right.append(b[y])
                    at_b, y = at_b + len(bytes_b[y]), y + 1
            groups.append((left, right))
        links[i] = Counter((p, q) for left, right in groups for p in left for q in right)
        shown = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        rows[i] = (len(a), len(b), len(groups), sum(links[i].values()), hashlib.sha256(shown.encode()).hexdigest() if shown else "")
    count = Counter(p for found in links.values() for p in found)
    best = defaultdict(int)
    for (p, _), c in count.items():
        best[p] = max(best[p], c)
    return {i: (*rows[i][:4], sum(m for p, m in links[i].items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in links[i].items()), rows[i][4]) for i in texts}


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 2_000)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in q_alignment.op13_tokenizer_alignment(spark, sf).collect()}
    assert got == brute(texts)


def test_alignment_of_odd_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 50)
    texts = dict(enumerate(ODD))
    spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in q_alignment.op13_tokenizer_alignment(spark, str(tmp_path)).collect()}
    assert got == brute(texts)
