import json
import random

"""Literal vectors of the scalar functions."""

from pyspark.sql import functions as F

from specmill.functions import jsonrepair, mining, names, units, values, web


def run(spark, fn, inputs, schema="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {schema}")
    return [r[0] for r in df.orderBy("i").select(fn("x").alias("y")).collect()]


def test_capacity(spark):
    got = run(spark, units.capacity_kg, ["500 kg", "1000kg", "2.5 kg", "1000 lbs", "1 ton", "2 tonnes", "0.5t", None, "", "unknown format", "1,000 kg"])
    assert got == [500, 1000, 2.5, 454, 1000, 2000, 500, None, None, None, 0]


def test_speed(spark):
    assert run(spark, units.speed_mpm, ["8 m/min", "0.5 m/min", "10 ft/min", "20 fpm", "0.1 m/s", None]) == [8, 0.5, 3.0, 6.1, 6, None]


def test_normalized_texts(spark):
    assert run(spark, units.normalize_capacity, ["500 kg", "1000 lbs", "2 ton", "0.5t", "125-400 kg", None, "2.5kg"]) == [
        "500 kg (1102 lbs)", "454 kg (1000 lbs)", "2000 kg (4000 lbs)", "0.5t", "400 kg (882 lbs)", "", "2.5 kg (6 lbs)"]
    assert run(spark, units.normalize_speed, ["4 m/min", "16 fpm", "0.1 m/s", ""]) == ["4 m/min (13 ft/min)", "4.9 m/min (16 ft/min)", "0.1 m/s", ""]
    assert run(spark, units.normalize_power, ["1.5 kW", "2 HP", "x"]) == ["1.5 kW (2.0 HP)", "1.49 kW (2 HP)", "x"]


def test_has_value(spark):
    assert run(spark, lambda x: values.has_value(x, "a"), [None, " ", "-", "500 kg", " "]) == [False, False, False, True, False]
    assert run(spark, lambda x: values.has_value(x, "a", "list"), [[], ["item"], None], "array<string>") == [False, True, False]
    assert run(spark, lambda x: values.has_value(x, "a", "number"), [0.0, None], "double") == [True, False]
    assert run(spark, lambda x: values.has_value(x, "c", "number"), [0.0, 1.0], "double") == [False, True]
    assert run(spark, lambda x: values.has_value(x, "c"), [" ", "", "-"]) == [True, False, False]


def test_completeness(spark):
    cols = "loadCapacity string, liftingSpeed string, motorPower string, classification array<string>, dutyCycle string, voltageOptions array<string>, weight string, protectionClass string, series string"
    full = ("a", "b", "c", ["d8"], "e", ["400V"], "w", "p", "s")
    none = (None,) * 9
    rows = [none, full, full[:5] + none[5:], none[:5] + full[5:], ("a", "b", "c") + none[3:6] + ("w", "p", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + cols)
    assert [r[0] for r in df.orderBy("i").select(values.completeness()).collect()] == [0, 100, 70, 30, 57]


def test_vendor_model_class(spark):
    assert run(spark, values.clean_manufacturer, ["CM", "CM Works", "Stagemaker", "KITO", "Demag", None]) == [
        "Columbus McKinnon", "Columbus McKinnon", "Verlinde", "KITO", "Demag", ""]
    assert run(spark, values.clean_model, ["Lodestar Electric Chain Hoist", "ER2 Series", " Hoists "]) == ["Lodestar", "ER2", ""]
    assert run(spark, lambda x: F.array_join(values.normalize_classes(x), "|"), [["bgv-d8", "D8"], ["d8plus", "bgv-d8+"], ["bgvd8", " CE "], None], "array<string>") == ["d8", "d8+", "d8|ce", ""]
    assert run(spark, values.to_bool, ["yes", "Yes", "YES", "true", "no", "false", None]) == [True] * 4 + [False] * 3


def test_buckets(spark):
    kg = [100.0, 250.0, 300.0, 500.0, 750.0, 1000.0, 1500.0, 2000.0, 3000.0, None]
    b = units.CAPACITY_BUCKETS
    assert run(spark, units.capacity_bucket, kg, "double") == [b[0], b[0], b[1], b[1], b[2], b[2], b[3], b[3], b[4], None]


def test_any_unit_quirk(spark):
    x = ["1000 kg (2205 lbs)", "1,5 ton", "2 short tons"]
    assert run(spark, lambda c: units.capacity_any_unit(c, "compat"), x) == [454, 1500, 1814]
    assert run(spark, units.capacity_any_unit, x) == [1000, 1500, 1814]


def test_dedupe_key_modes(spark):
    df = spark.createDataFrame([("Kito", "Kito ER2 Chain  Hoist - X model")], "m string, x string")
    r = df.select(names.dedupe_key("m", "x"), names.dedupe_key("m", "x", "compat")).first()
    assert r[0] == "kito:er2 -x" or r[0] == "kito:er2  -x" or r[0].startswith("kito:er2")
    assert "hoist" not in r[0] and r[1].startswith("kito:er2 chain  hoi")


def test_device_names(spark):
    n = ["[000-015] Lodestar Model JJ 500kg 16m/min (64fpm) - [PRG Red Tag]", "Winch 250 kg 13mm/s"]
    df = spark.createDataFrame([(x,) for x in n], "name string")
    a = [tuple(r) for r in df.select(*names.device_numbers("name").values()).collect()]
    assert a == [(500.0, 16.0, 64.0), (250.0, 13.0, None)]
    assert df.select(names.device_numbers("name", "fixed")["liftingSpeedMpm"]).collect()[1][0] == 0.78
    assert run(spark, names.model_from_name, n) == ["Lodestar Model JJ", "Winch"]


def test_media_names(spark):
    f = lambda mode: (lambda x: F.to_json(names.parse_media_name(x, mode)))
    got = run(spark, f("typed"), ["abus_gm_2_datasheet_3.pdf", "a_b.pdf"])
    assert got == ['{"vendor":"abus","product":"gm_2","type":"datasheet","index":3}', None]
    assert run(spark, f("titled"), ["rm-mat_lk-5.pdf", "plain.pdf"]) == [
        '{"vendor":"Rm mat","product":"lk 5","type":"document","index":0}', '{"vendor":"Unknown","product":"plain","type":"document","index":0}']
    assert run(spark, f("image"), ["kito_er2_0.jpg", "nobody_x_1.png"]) == ['{"vendor":"Kito","product":"er2","type":"jpg","index":0}', None]


def test_match_key_drops_suffix_anywhere(spark):
    assert run(spark, names.match_key, ["Demag GmbH", "GIS AG"]) == ["dem", "gis"]


def test_unique_ids_pass_over_other_bases(spark):
    rnd = random.Random(3)
    names_ = ["a", "a-1", "a-2", "a-1-1", "a-1-x", "a-01", "b", "a-3", "b-1", "a-99999999999999999999"]
    for bases in (["a", "a", "a-1", "a-1-x"], [rnd.choice(names_) for _ in range(60)]):
        df = spark.createDataFrame(list(enumerate(bases)), "_pos long, base string")
        got = [r.unique_id for r in names.unique_id(df, "base").orderBy("_pos").collect()]
        natural, count, want = set(bases), {}, []
        for x in bases:  # the first row keeps the base, the next take the next free counter
            n = count.get(x)
            if n is None:
                count[x] = 0
                want.append(x)
                continue
            n += 1
            while f"{x}-{n}" in natural:
                n += 1
            count[x] = n
            want.append(f"{x}-{n}")
        assert got == want and len(set(got)) == len(got)


def test_long_numbers(spark):
    assert run(spark, units.label_number, ["12345678901 kg", "99999999999999999999999 kg", "x"]) == [12345678901, 0, 0]
    got = run(spark, lambda x: names.parse_media_name(x, "typed"), ["kito_er2_document_20250731123456.pdf", "kito_er2_document_99999999999999999999999.pdf"])
    assert [g["index"] for g in got] == [20250731123456, None]
    assert run(spark, units.normalize_capacity, ["99999999999999999999 kg"])[0].startswith("100000000000000000000 kg (220461999")
    assert "9223372036854775807" not in run(spark, units.normalize_capacity, ["99999999999999999999 kg"])[0]



def test_urls(spark):
    df = spark.createDataFrame([(h,) for h in ["/für", "b c", "../z", "?a=1", "#t", "//h/p", "mailto:x", "http://q"]], "h string")
    got = [r[0] for r in df.select(web.absolute_url("h", F.lit("http://a.com/x/y?q=1#f"))).collect()]
    assert got == ["http://a.com/f%C3%BCr", "http://a.com/x/b%20c", "http://a.com/z", "http://a.com/x/y?a=1", "http://a.com/x/y?q=1#t", "http://h/p", "mailto:x", "http://q"]


def test_tolerant_json(spark):
    texts = ['{"a": 1}', 'so:\n```json\n{"a": 2}\n```', 'x {"a": 3} y', "x {'a': 4, } y", "SWL: 500 kg", "garbage", "", "42"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = jsonrepair.parse_llm_json(df, "t").orderBy("i").select(
        "parse_strategy", F.try_variant_get("parsed", "$.a", "int"), F.try_variant_get("parsed", "$.loadCapacity", "string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, None), (2, 2, None), (3, 3, None), (4, 4, None), (5, None, "500 kg"), (0, None, None), (0, None, None), (0, None, None)]


def test_json_repair_keeps_quoted_texts(spark):
    texts = ["{'url': \"http://a.b/c:d\", time: '12:30', list: [1, 2, ], note: 'say \"hi\", }', ok: true/false, conf: 0.0 to 1.0, }",
             'see {"a": "x, }", b: "true/false",} end', "no braces"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [json.loads(r[0]) if r[0] else r[0] for r in df.orderBy("i").select(jsonrepair.repaired("t")).collect()]
    assert got[0] == {"url": "http://a.b/c:d", "time": "12:30", "list": [1, 2], "note": 'say "hi", }', "ok": True, "conf": 0.5}
    assert got[1] == {"a": "x, }", "b": "true/false"} and not got[2]
    whole = "x" * 900
    row = jsonrepair.parse_llm_json(spark.createDataFrame([(whole,)], "t string"), "t").select(F.try_variant_get("parsed", "$.rawResponse", "string")).first()
    assert row[0] == whole


def test_mining(spark):
    t = "Dimensions: 10 x 20 x 30 mm, Weight: 12 kg, built 2015 kg, Gewicht 7 kg net"
    df = spark.createDataFrame([(t,)], "t string")
    d, w = df.select(mining.mine_dimensions("t"), mining.mine_weights("t")).first()
    assert d == ["Dimensions: 10 x 20 x 30 mm", "10 x 20 x 30 mm"]
    assert w == ["Weight: 12 kg", "Gewicht 7 kg", "12 kg", "7 kg net"]
    assert df.select(mining.best_weight(mining.mine_weights("t"))).first()[0] == "Weight: 12 kg"


def test_spec_keys_last_wins(spark):
    df = spark.sql("select map('capacity', '1', 'rated load', '2', 'net weight', '3', 'lift speed', '4') m")
    r = df.select(mining.map_specs("m").alias("p")).select("p.*").first()
    assert (r.loadCapacity, r.weight, r.liftingSpeed, r.motorPower) == ("2", "3", "4", None)
