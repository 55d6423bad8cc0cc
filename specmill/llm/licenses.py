"""License scan of descriptions: rolling word grams vote for the diagonals of license templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The base phrases with their labels, as the contract of the query states them.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Public license notices, as their publishers word them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
     "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
     "agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
     "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
     "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
     "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
     "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)

GRAM, APART, LEAST_COVERED, LEAST_DENSE = 4, 3, 0.6, 0.5


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and non-ASCII characters."""
    return F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _grams(w: Column, k: int = GRAM) -> Column:
    """Hashes of all ``k`` words in a row; none for fewer words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(
        F.array().cast("array<bigint>"))


def templates(spark: SparkSession, texts=TEMPLATES) -> DataFrame:
    """(template, label, n_template, hash, at, gram): a row for each word gram of a template."""
    listed = F.array(*(F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(t).alias("text")) for n, (label, t) in enumerate(texts)))
    rows = spark.range(1).select(F.inline(listed)).withColumn("w", words(F.col("text")))
    return rows.select("template", "label", F.size("w").alias("n_template"), "w", F.posexplode(_grams(F.col("w"))).alias("at", "hash")).withColumn(
        "gram", F.slice("w", F.col("at") + 1, GRAM)).drop("w")


def _starts(w: Column, phrase: str) -> Column:
    """Places of the words at which the phrase stands."""
    parts = phrase.split()
    at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.get(w, i) == parts[0]) & F.array(*(F.get(w, i + j) for j in range(1, len(parts)))).eqNullSafe(
        F.array(*(F.lit(p) for p in parts[1:]))))
    return F.when(F.array_contains(w, parts[0]), at).otherwise(F.array().cast("array<int>"))


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def license_spans(catalog: DataFrame, id: str = "id", description: str = "description", texts=TEMPLATES) -> DataFrame:
    """Verified places of license templates: (id, text_hash, template, label, first_word, last_word, covered).

    All rolling grams of four words are joined to the template positions by hash, and a hit counts only if its words are the
    template's. Hits vote for (record, template, diagonal), the diagonal being word place minus template place; diagonals at most
    three apart, as insertions and deletions make them, are merged. A span is verified if the hits cover 60 % of the template and half
    of the words from the first to the last. The template table is fixed and small, so it is broadcast; only hits are shuffled.

    A null or short description has no spans; repeated records have one and the same set. Other columns are ignored.
    """
    known = templates(catalog.sparkSession, texts)
    rows = catalog.select(F.col(id).alias("id"), F.xxhash64(F.col(description)).alias("text_hash"), words(F.col(description)).alias("w"))
    rolled = rows.select("id", "text_hash", "w", F.posexplode(_grams(F.col("w"))).alias("place", "hash"))
    hits = rolled.join(F.broadcast(known), "hash").where(F.slice("w", F.col("place") + 1, GRAM) == F.col("gram")).select(
        "id", "text_hash", "template", "label", "n_template", (F.col("place") - F.col("at")).alias("diagonal"), "place", "at")
    votes = hits.groupBy("id", "text_hash", "template", "label", "n_template", "diagonal").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("at").alias("at"))
    by = W.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > APART, F.lit(True))
    merged = votes.withColumn("begins", begins).withColumn("band", F.sum(F.col("begins").cast("int")).over(by)).groupBy(
        "id", "text_hash", "template", "label", "n_template", "band").agg(
        F.min("low").alias("first_word"), (F.max("high") + GRAM - 1).alias("last_word"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    covered = F.aggregate(F.transform("at", lambda x, k: F.coalesce(F.least(F.lit(GRAM), F.get(F.col("at"), k + 1) - x), F.lit(GRAM))), F.lit(0), lambda a, x: a + x)
    return merged.withColumn("words", covered).where(
        (F.col("words") >= LEAST_COVERED * F.col("n_template")) & (F.col("words") >= LEAST_DENSE * (F.col("last_word") - F.col("first_word") + 1))).select(
        "id", "text_hash", "template", "label", "first_word", "last_word", (F.col("words") / F.col("n_template")).alias("covered"))


def scan_licenses(catalog: DataFrame, id: str = "id", description: str = "description", texts=TEMPLATES) -> DataFrame:
    """One row per record: id, n_words, n_base, first_word, last_word, base_labels, license_labels, score.

    Base: the places where the words of a phrase of ``PHRASES`` stand in a row: how many, the first and the last, and the labels.
    ``license_labels`` adds those of the verified templates (``license_spans``). ``score``: 1 with a phrase, else the largest covered
    share of a verified template, else 0. Whole texts, DataFrame functions only.

    A null description is empty: no words, null places, empty label lists, score 0. Records are told apart by id and text, so
    repeated ids (nulls too) get the labels of their own text. Other columns are ignored.
    """
    def based(w):
        starts = [_starts(w, p) for p, _ in PHRASES]
        return _let(F.concat(*starts), lambda s: F.struct(
            F.size(w).cast("long").alias("n_words"), F.size(s).cast("long").alias("n_base"), F.array_min(s).cast("long").alias("first_word"),
            F.array_max(s).cast("long").alias("last_word"),
            F.array_compact(F.array(*(F.when(F.size(x) > 0, F.lit(label)) for x, (_, label) in zip(starts, PHRASES)))).alias("base_labels")))

    text = F.coalesce(F.col(description), F.lit(""))
    base = catalog.select(F.col(id).alias("id"), F.xxhash64(F.col(description)).alias("text_hash"), _let(words(text), based).alias("b")).select("id", "text_hash", "b.*")
    spans = license_spans(catalog, id, description, texts).groupBy("id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("covered").alias("covered")).select(
        F.col("id").alias("id_"), F.col("text_hash").alias("text_hash_"), "more", "covered")
    both = base.join(spans, base["id"].eqNullSafe(spans["id_"]) & (base["text_hash"] == spans["text_hash_"]), "left")
    listed = lambda a: F.array_sort(F.array_distinct(a))
    return both.select("id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base_labels")).alias("base_labels"),
                       listed(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("license_labels"),
                       F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("covered", F.lit(0.0))).alias("score"))
