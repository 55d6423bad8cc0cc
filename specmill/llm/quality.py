"""Quality of descriptions: naive Bayes support vectors over n-gram indicators, fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import TOKEN, Table, hash64, pair, places
from .samples import labelled_sample

BITS = 18


def _shape(token: str) -> str:
    if token[0].isdigit():
        return "9"
    if not token[0].isalpha():
        return token
    if len(token) > 1 and token.isupper():
        return "A"
    return "T" if token[0].isupper() else "a"


def _table() -> Table:
    return Table(lambda t: (hash64(t.lower(), 1), hash64(_shape(t), 2)), 2)


def features(text: str | None, table: Table, bits: int = BITS) -> np.ndarray:
    """Places of the distinct indicators of a whole text: words, pairs of words, and runs of up to four word shapes.

    A shape is capitals, first capital, small letters, number, the sign itself, or "the same word as before".
    """
    rows = table.rows(TOKEN.findall(text or ""))
    word, shape = rows[:, 0], rows[:, 1].copy()
    shape[1:][word[1:] == word[:-1]] = 1
    two = pair(shape[:-1], shape[1:], 3)
    three = pair(two[:-1], shape[2:], 4)
    four = pair(three[:-1], shape[3:], 5)
    return np.unique(places(np.concatenate([word, pair(word[:-1], word[1:], 6), shape * np.uint64(0x9E3779B97F4A7C15), two, three, four]), bits))


@dataclass(frozen=True)
class QualityModel:
    """``weights[place]`` is log-count ratio times support-vector weight; ``slope`` and ``shift`` turn a margin into a probability."""

    places: np.ndarray
    weights: np.ndarray
    ratios: np.ndarray
    constant: float
    slope: float
    shift: float
    bits: int


def log_count_ratios(good: np.ndarray, bad: np.ndarray, least: int = 6, weak: float = 0.7) -> np.ndarray:
    """log of (share among good) / (share among bad) per place, counts raised by one.

    0 where fewer than ``least`` records have the place, or where the ratio is under ``weak``: such places tell nothing.
    """
    p, q = good + 1.0, bad + 1.0
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where((good + bad >= least) & (np.abs(r) >= weak), r, 0.0)


def _vector(at: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indicators scaled by their ratios, to length 1; with a constant 1 at the last place."""
    x = ratios[at]
    at, x = at[x != 0], x[x != 0]
    return np.append(at, len(ratios)), np.append(x / max(1e-9, float(np.sqrt((x * x).sum()))), 1.0)


def dual_coordinate_descent(samples: list[tuple[np.ndarray, np.ndarray, int]], size: int, cost: float = 1.0, epochs: int = 12,
                            seed: int = 7) -> np.ndarray:
    """Weights of the linear hinge-loss model: one dual variable at a time, kept in 0..``cost``; labels are 1 and -1."""
    w, a = np.zeros(size), np.zeros(len(samples))
    norm = [float((x * x).sum()) for _, x, _ in samples]
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in random.permutation(len(samples)):
            at, x, y = samples[k]
            new = min(cost, max(0.0, a[k] - (y * float(w[at] @ x) - 1) / norm[k]))
            if new != a[k]:
                w[at] += (new - a[k]) * y * x
                a[k] = new
    return w


def _calibrated(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps with a small ridge."""
    x, b = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        g = x.T @ (p - label) + 1e-2 * b
        b = b - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), g)
    return float(b[0]), float(b[1])


def fit_quality(catalog: DataFrame, ratings: DataFrame, id: str = "id", description: str = "description", most: int = 20_000,
                per_shard: int = 5_000, bits: int = BITS) -> QualityModel:
    """Model of good descriptions, learned from rated records: ``ratings`` has (id, rating), 1 for good.

    At most about ``most`` rated records are used, chosen by a hash of the id; one in eight of them is kept out of the fit, for the
    probability curve. Spark counts the indicators by class; groups of about ``per_shard`` records fit a support-vector model each,
    whose weights are averaged. The model's size is bounded by 2**bits.

    Nulls in id or rating are left out; a null description has no words. Without ratings, or with one class only, the margin is
    0 for all and the score is about the share of good records.
    """
    sample, count = labelled_sample(catalog, ratings, id, description, most)
    shards = max(1, round(count / per_shard))
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(8))
    dealt = sample.withColumn("kept_out", part == 0).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)))
    rows = dealt.where("NOT kept_out")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, seen = _table(), np.zeros((2, 1 << bits), dtype=np.int64)
        for b in batches:
            for t, y in zip(b["description"], b["rating"]):
                seen[int(y), features(t, table, bits)] += 1
        at = np.flatnonzero(seen.sum(0))
        yield pd.DataFrame({"place": at, "bad": seen[0, at], "good": seen[1, at]})

    counts = rows.mapInPandas(counted, "place long, bad long, good long").groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = counts.toArrow()
    good, bad = np.zeros(1 << bits), np.zeros(1 << bits)
    good[found["place"].to_numpy()], bad[found["place"].to_numpy()] = found["good"].to_numpy(), found["bad"].to_numpy()
    ratios = log_count_ratios(good, bad)
    used = np.flatnonzero(ratios)
    packed = (used, ratios[used].astype(np.float32))

    def spread() -> np.ndarray:
        out = np.zeros(1 << bits)
        out[packed[0]] = packed[1]
        return out

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        table, r = _table(), spread()
        w = dual_coordinate_descent([(*_vector(features(t, table, bits), r), 1 if y else -1) for t, y in zip(b["description"], b["rating"])], (1 << bits) + 1)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at, "weight": w[at]})

    fitted = rows.groupBy("shard").applyInPandas(fit, "place long, weight double").groupBy("place").agg((F.sum("weight") / shards).alias("weight")).toArrow()
    w = np.zeros((1 << bits) + 1)
    w[fitted["place"].to_numpy()] = fitted["weight"].to_numpy()
    at = np.flatnonzero(w[:-1])
    model = QualityModel(at.astype(np.int32), w[at].astype(np.float32), ratios[at].astype(np.float32), float(w[-1]), 1.0, 0.0, bits)
    out = dealt.where("kept_out").select("rating", _scorer(model, True)(F.col("description")).alias("margin")).toArrow()
    slope, shift = _calibrated(out["margin"].to_numpy(), out["rating"].to_numpy()) if out.num_rows else (1.0, 0.0)
    return QualityModel(model.places, model.weights, model.ratios, model.constant, slope, shift, bits)


def score_quality(catalog: DataFrame, model: QualityModel, id: str = "id", description: str = "description") -> DataFrame:
    """One row (id, quality) per record: the probability, from whole descriptions, that a record is good. No shuffle.

    A null or empty description is scored by the constant alone. Repeated records give repeated rows; other columns are ignored.
    """
    return catalog.select(F.col(id).alias("id"), _scorer(model, False)(F.col(description)).alias("quality"))


def keep_good(catalog: DataFrame, model: QualityModel, description: str = "description", least: float = 0.5) -> DataFrame:
    """The records with a quality of ``least`` or more, all columns as they are."""
    return catalog.where(_scorer(model, False)(F.col(description)) >= least)


def _scorer(model: QualityModel, margin: bool):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, r, w = _table(), np.zeros((1 << model.bits) + 1, dtype=np.float32), np.zeros((1 << model.bits) + 1, dtype=np.float32)
        r[model.places], w[model.places] = model.ratios, model.weights

        def one(text):
            at = features(text, table, model.bits)
            x = r[at]
            m = float(w[at] @ x) / max(1e-9, float(np.sqrt((x * x).sum()))) + model.constant
            return m if margin else 1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -35, 35)))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return score
