"""Every operator on the same awkward catalogue: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from specmill.llm import alignment, conversations, fingerprints, language, licenses, neighbours, packing, quality, rules, secrets, segments, tokens, toxicity
from specmill.plans import inputs

GOOD = "The hoist lifts loads of up to five hundred kilograms at eight metres per minute and holds them safely on its brake. "
ROWS = [
    (1, GOOD * 3, "Kito"), (2, None, "Kito"), (3, "", None), (4, " \t\n\x0b", "Demag"), (5, "!!! ??? ---", "Demag"), (6, "x", "x"),
    (7, GOOD * 3, "Kito"), (7, GOOD * 3, "Kito"), (7, "another text for the same id", "Kito"), (None, "a record without an id", None),
    (None, None, None), (8, "ß ſ K é 漢字 🙂 " * 40, "Ünï"), (9, "word " * 30_000, "long"), (10, "password=abcdef0123456789 " + "a" * 70_000, "long"),
]
COUNT = len(ROWS)
SCHEMA = "id long, description string, manufacturer string"
#: Names that an operator might use inside, here as columns of the table.
EXTRA = ["b_", "m_", "goes", "id_", "hash_", "place_", "word", "bit", "marks", "own_id", "own_hash", "held", "doubtful_id", "hash", "name", "guest", "a.b", "spans", "secrets", "sig", "n", "w_", "key", "part", "language", "score", "ids", "text", "text_hash", "n_words", "kept", "component_id", "quality", "doc_id"]


@pytest.fixture(scope="module", params=["long", "string"])
def kind(request):
    return request.param


def named(rows, kind):
    """Ids as they are, or as texts such as catalogues have."""
    return rows if kind == "long" else rows.withColumn("id", F.concat(F.lit("p-"), F.col("id").cast("string")))


def plain(i):
    return int(i[2:]) if isinstance(i, str) else i


@pytest.fixture(scope="module")
def catalog(spark, kind):
    return named(spark.createDataFrame(ROWS, SCHEMA), kind).select("*", *(F.lit(f"extra {c}").alias(c) for c in EXTRA)).repartition(3)


@pytest.fixture(scope="module")
def ratings(spark, kind):
    return named(spark.createDataFrame([(1, 1), (5, 0), (7, 1), (9, 0), (9, 1), (None, 1), (6, None), (99, 1)], "id long, rating int"), kind)


def operators(spark, ratings, catalog):
    weights = toxicity.fit_toxicity(catalog, ratings)
    model = quality.fit_quality(catalog, ratings)
    spoken = catalog.withColumn("language", F.when(F.col("description").startswith("!!!"), None).otherwise(F.lit("en")))
    vocabulary, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return {
        "secrets": secrets.scan_secrets(catalog), "masked": secrets.mask_secrets(catalog), "toxicity": toxicity.score_toxicity(catalog, weights),
        "quality": quality.score_quality(catalog, model), "language": language.identify_language(catalog, language.fit_languages(spoken)),
        "rules": rules.judge(catalog), "licenses": licenses.scan_licenses(catalog), "neighbours": neighbours.near_duplicates(catalog),
        "fingerprint": fingerprints.fingerprint(catalog), "compared": fingerprints.compare_with_next(catalog, per_part=3),
        "tokens": packing.pack_catalog(catalog, vocabulary), "segments": segments.sample_segmentations(catalog, pieces, k=2),
        "counts": tokens.count_tokens(catalog, pieces), "aligned": alignment.score_links(alignment.align_catalog(catalog, vocabulary, pieces)),
    }


def test_awkward_rows(spark, catalog, ratings):
    for name, df in operators(spark, ratings, catalog).items():
        rows = df.collect()
        assert df.schema["id"].dataType == catalog.schema["id"].dataType, name
        ids = sorted(str(plain(r["id"])) for r in rows)
        if name not in ("tokens", "segments"):
            assert ids == sorted(str(r[0]) for r in ROWS), name
        else:
            assert set(ids) == {str(r[0]) for r in ROWS}, name


def test_no_rows(spark, ratings):
    none = spark.createDataFrame([], SCHEMA + ", language string").withColumn("id", F.col("id").cast(ratings.schema["id"].dataType))
    for name, df in operators(spark, ratings.limit(0), none).items():
        assert df.collect() == [], name
    assert neighbours.keep_first(none).collect() == []


def test_nulls_are_defined(spark, catalog, ratings):
    made = operators(spark, ratings, catalog)
    by = {name: {plain(r["id"]): r for r in df.collect() if plain(r["id"]) in (2, 3, 4)} for name, df in made.items() if name not in ("tokens", "segments")}
    for i in (2, 3, 4):
        assert by["secrets"][i]["secrets"] == []
        assert (by["language"][i]["language"], by["language"][i]["score"], by["language"][i]["rejected"]) == ("und", 0.0, True)
        assert (by["rules"][i]["n_words"], by["rules"][i]["n_repeat_words"], by["rules"][i]["base_failed"], by["rules"][i]["kept"]) == (0, 0, True, False)
        assert (by["licenses"][i]["n_words"], by["licenses"][i]["first_word"], by["licenses"][i]["license_labels"]) == (0, None, [])
        assert (by["neighbours"][i]["n_shingles"], plain(by["neighbours"][i]["component_id"])) == (0, i)
        assert by["fingerprint"][i]["fingerprint"] == b""
        assert 0 <= by["toxicity"][i]["toxicity"] <= 1 and 0 <= by["quality"][i]["quality"] <= 1
    assert by["masked"][2]["description"] is None
    assert {plain(r["id"]): r["doc_tokens"] for r in made["tokens"].collect() if plain(r["id"]) in (2, 3)} == {2: 1, 3: 1}
    assert [(r["rank"], len(r["ids"])) for r in made["segments"].collect() if plain(r["id"]) == 2] == [(1, 0)]
    assert {plain(r["id"]): (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in made["counts"].collect() if plain(r["id"]) in (2, 3)} == {2: (0, 0, False), 3: (0, 0, False)}
    assert {plain(r["id"]): (r["n_a"], r["n_links"], r["count_sum"], r["groups"]) for r in made["aligned"].collect() if plain(r["id"]) in (2, 3)} == {2: (0, 0, 0, ""), 3: (0, 0, 0, "")}


def test_repeated_rows(spark, catalog):
    found = [(plain(r["id"]), plain(r["component_id"])) for r in neighbours.near_duplicates(catalog).collect() if r["n_shingles"] > 10]
    assert sorted(x for x in found if x[0] in (1, 7)) == [(1, 1), (7, 1), (7, 1)]


def test_unlike_rows_of_an_id_stay(spark, catalog):
    kept = neighbours.keep_first(catalog).collect()
    expected = {(i, text) for i, text, _ in ROWS if (i, text) != (7, GOOD * 3)}
    assert {(plain(r["id"]), r["description"]) for r in kept} == expected and len(kept) == len(expected)
    assert kept[0].__fields__ == catalog.columns
    assert all(r[c] == f"extra {c}" for r in kept for c in EXTRA)
    makers = {(i, text): maker for i, text, maker in ROWS}
    assert all(r["manufacturer"] == makers[plain(r["id"]), r["description"]] for r in kept)


def test_rows_of_an_id(spark):
    rows = [(1, "one two three four"), (1, "five six seven eight"), (1, "five six seven eight"), (2, "five  six seven eight"), (2, "nine ten"), (3, ""), (3, "")]
    kept = neighbours.keep_first(spark.createDataFrame(rows, "id long, description string")).collect()
    assert sorted(map(tuple, kept)) == [(1, "five six seven eight"), (1, "one two three four"), (2, "nine ten"), (3, "")]


def test_catalogue_records(spark, sf):
    """Each operator on records of the catalogue itself, whose ids are texts."""
    records = inputs.raw_catalog(spark, sf).withColumn("description", F.concat_ws(" ", "manufacturer", "model", "series", "loadCapacity")).limit(60)
    ids = sorted(r["id"] for r in records.collect())
    rated = records.select("id", (F.col("_pos") % 2).cast("int").alias("rating"))
    assert all(isinstance(i, str) for i in ids)
    made = operators(spark, rated, records)
    for name, df in made.items():
        found = [r["id"] for r in df.collect()]
        assert set(found) == set(ids) and (name in ("tokens", "segments") or len(found) == len(ids)), name
    kept = neighbours.keep_first(records)
    assert kept.schema == records.schema and {r["id"] for r in kept.collect()} <= set(ids)


def test_conversations_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.repair_conversations(none).collect() == []
