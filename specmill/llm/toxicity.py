"""Toxicity of descriptions: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import WORD, Table, hash64, pair, places
from .samples import labelled_sample

BITS = 22


def _table() -> Table:
    return Table(lambda w: (hash64(w, 1), hash64(w[:5], 2)), 2)


def features(text: str | None, table: Table, bits: int = BITS) -> np.ndarray:
    """Places of the distinct grams of a whole text: words, their first five letters, pairs, and pairs with one word between."""
    rows = table.rows(WORD.findall((text or "").lower()))
    word, stem = rows[:, 0], rows[:, 1]
    return np.unique(places(np.concatenate([word, stem, pair(word[:-1], word[1:], 3), pair(word[:-2], word[2:], 4)]), bits))


def ftrl(samples: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0,
         l2: float = 0.5, epochs: int = 8, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and sums of squared gradients after ``epochs`` passes; the last place is the constant's."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    random = np.random.default_rng(seed)

    def weights(i):
        return np.where(np.abs(z[i]) > l1, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for k in random.permutation(len(samples)):
            at, label = samples[k]
            at = np.append(at, 1 << bits)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None)), n


def fit_toxicity(catalog: DataFrame, ratings: DataFrame, id: str = "id", description: str = "description",
                 most: int = 20_000, per_shard: int = 5_000, bits: int = BITS) -> np.ndarray:
    """Weights of the hashed grams, constant last, learned from rated records: ``ratings`` has (id, rating), 1 for toxic.

    At most about ``most`` rated records are used, chosen by a hash of the id. They are dealt to groups of about ``per_shard``;
    each fits its own model, and the weights are averaged per place with the squared gradients as evidence, so that a word only some shards
    have seen keeps its weight. The result has 2**bits + 1 numbers whatever the input's size, nearly all zero.

    Nulls in id or rating are left out; a null description has no words. Without ratings all weights are 0.
    """
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        table = _table()
        w, n = ftrl([(features(t, table, bits), int(y)) for t, y in zip(rows["description"], rows["rating"])], bits)
        at = np.flatnonzero(n)
        return pd.DataFrame({"place": at, "weight": w[at], "evidence": n[at]})

    sample, count = labelled_sample(catalog, ratings, id, description, most)
    shards = max(1, round(count / per_shard))
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)))
    found = (dealt.groupBy("shard").applyInPandas(fit, "place long, weight double, evidence double").groupBy("place")
             .agg((F.sum(F.col("weight") * F.col("evidence")) / F.sum("evidence")).alias("weight"))
             .where("weight <> 0").toArrow())
    out = np.zeros((1 << bits) + 1)
    out[found["place"].to_numpy()] = found["weight"].to_numpy()
    return out


def score_toxicity(catalog: DataFrame, weights: np.ndarray, id: str = "id", description: str = "description") -> DataFrame:
    """One row (id, toxicity) per record: the probability, from whole descriptions, that a record is toxic. No shuffle.

    ``weights`` go to the executors with the task: their size is fixed by the number of hash bits. A null or empty description
    gets the probability of the constant alone. Repeated records give repeated rows; other columns are ignored.
    """
    places_used = np.flatnonzero(weights)
    values, size = weights[places_used], len(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, w = _table(), np.zeros(size, dtype=np.float32)
        w[places_used] = values
        bits = (size - 1).bit_length() - 1
        for texts in batches:
            yield pd.Series([1 / (1 + np.exp(-np.clip(w[features(t, table, bits)].sum() + w[-1], -35, 35))) for t in texts])

    return catalog.select(F.col(id).alias("id"), score(F.col(description)).alias("toxicity"))
