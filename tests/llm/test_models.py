"""Learned operators: held-out accuracy, and the parts against plain versions."""

import duckdb
import numpy as np
import pytest

from specmill.llm import language, q_language, q_quality, q_toxicity, quality, toxicity

SF = "/root/testdata/sf0.01"


def truth():
    return duckdb.sql(f"SELECT d.doc_id, d.lang, l.quality, l.toxic FROM '{SF}/documents.parquet' d LEFT JOIN '{SF}/labels.parquet' l USING (doc_id)").df()


@pytest.mark.parametrize("query,label,least", [(q_toxicity.op2_toxicity, "toxic", 0.9), (q_quality.op8_quality, "quality", 0.93), (q_language.op7_language, "lang", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    got = query(spark, SF).toPandas()
    assert len(got) == got.doc_id.nunique() == 1000
    assert got.score.between(0, 1).all()
    m = got.merge(truth(), on="doc_id")
    m = m[m.held_out & m[label].notna()]
    assert (m["lang_pred" if label == "lang" else "predicted"] == m[label]).mean() >= least
    again = query(spark, SF).toPandas()
    assert (got.sort_values("doc_id").score.to_numpy() == again.sort_values("doc_id").score.to_numpy()).all()


def test_ftrl_is_sparse_and_learns():
    rnd = np.random.default_rng(1)
    samples = [(np.unique(np.r_[rnd.integers(0, 200, 20), [250] if y else []]).astype(np.int64), int(y)) for y in rnd.random(800) < 0.3]
    w, n = toxicity.ftrl(samples, bits=8)
    assert w[250] > 2 and (w != 0).sum() < 60 and (n > 0).sum() > 150


def test_dual_coordinate_descent_meets_the_margins():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 5))
    y = np.where(x @ np.array([1.0, -2, 0.5, 0, 0]) > 0, 1, -1)
    w = quality.dual_coordinate_descent([(np.arange(5), r, int(k)) for r, k in zip(x, y)], 5, cost=10.0, epochs=60)
    assert (np.sign(x @ w) == y).mean() > 0.98
    primal = 0.5 * w @ w + 10 * np.maximum(0, 1 - y * (x @ w)).sum()
    for _ in range(200):  # no small step makes it better
        v = w + rnd.normal(size=5) * 0.01
        assert 0.5 * v @ v + 10 * np.maximum(0, 1 - y * (x @ v)).sum() > primal - 1.0


def test_log_count_ratios():
    r = quality.log_count_ratios(np.array([9.0, 0, 4, 1]), np.array([0.0, 9, 4, 1]))
    assert r[0] > 0.7 and r[1] < -0.7 and r[2] == r[3] == 0


def test_narrow_margins_are_rejected():
    looks = [language.Compressors({"a": b"red green blue yellow " * 20, "b": b"rouge vert bleu jaune " * 20})]
    assert language.classify("green yellow red blue green", looks, 1)[::2] == ("a", False)
    assert language.classify("vert jaune rouge bleu", looks, 1)[::2] == ("b", False)
    name, score, rejected = language.classify("qqq", looks, 1)
    assert rejected and score == 0.5 and name == "a"
