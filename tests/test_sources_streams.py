"""Readers, writers, snapshots, pages and streams."""

import json

import pytest
from pyspark.sql import functions as F

from specmill.operators import devices, extract
from specmill.operators.normalize import process_catalog
from specmill.plans import inputs
from specmill.sources import readers, writers
from specmill.streaming import streams

RECORDS = [
    {"id": "a", "manufacturer": "CM", "model": "Lodestar 1000 Hoist", "loadCapacity": "1000 kg", "voltageOptions": "400V", "classification": "BGV-D8, CE",
     "quietOperation": "yes", "images": ["x.jpg"], "certifications": {"ce": "1"}, "price": {"value": 5, "currency": "EUR"}, "lastUpdated": "2025-07-31T21:35:07.934Z", "odd": [1, 2]},
    {"id": "b", "manufacturer": "Kito", "model": "ER2", "voltageOptions": ["230V", "400V"], "classification": ["d8"], "images": [{"url": "y.jpg", "alt": "n"}], "confidence": 0.8},
    {"id": "c", "manufacturer": "Kito"},
]


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: {"data": r, "version": "3"}, lambda r: {"products": r}])
def test_read_catalog_shapes(spark, tmp_path, wrap):
    f = tmp_path / "db.json"
    f.write_text(json.dumps(wrap(RECORDS), indent=2))
    df = readers.read_catalog(spark, str(f))
    rows = {r.id: r for r in df.collect()}
    assert [r._pos for r in df.orderBy("_pos").collect()] == [0, 1, 2]
    a, b = rows["a"], rows["b"]
    assert a.voltageOptions == ["400V"] and b.voltageOptions == ["230V", "400V"]
    assert a.classification == ["BGV-D8", " CE"] and b.classification == ["d8"]
    assert a.images[0].url == "x.jpg" and b.images[0].alt == "n"
    assert a.quietOperation is True and a.price.value == 5 and a.certifications == {"ce": "1"}
    assert a.lastUpdated.year == 2025 and a.extras == {"odd": "[1,2]"}
    done = process_catalog(df)
    got = {r.id: r for r in done.collect()}
    assert set(got) == {"a", "b"} and got["a"].classification == ["d8", "ce"] and got["a"].series == "Lodestar"


def test_read_catalog_bad_shape(spark, tmp_path):
    f = tmp_path / "bad.json"
    f.write_text('{"x": 1}')
    assert readers.read_catalog(spark, str(f), on_bad="empty").count() == 0
    with pytest.raises(Exception, match="no record array"):
        readers.read_catalog(spark, str(f)).collect()


def test_read_catalog_unreadable_always_raises(spark, tmp_path):
    for i, text in enumerate(['[{"id": "a"}, {"id":', '{"data": [{"id": "a"}', "no json"]):
        f = tmp_path / f"cut{i}.json"
        f.write_text(text)
        with pytest.raises(Exception, match="no readable JSON"):
            readers.read_catalog(spark, str(f), on_bad="empty").collect()


@pytest.mark.parametrize("wrap", [False, True])
def test_read_catalog_beyond_one_variant(spark, tmp_path, wrap):
    """A document of over 150 MB, more than one VARIANT holds, gives all its records."""
    import shutil

    if shutil.disk_usage(tmp_path).free < 2 << 30:
        pytest.skip("disk is full")
    f, filler = tmp_path / "large.json", "x" * 7_600
    with f.open("w") as out:
        out.write('{"products": [' if wrap else "[")
        for i in range(20_000):
            out.write(("," if i else "") + json.dumps({"id": f"p{i}", "manufacturer": "Kito", "description": filler}))
        out.write("]}" if wrap else "]")
    assert f.stat().st_size > 150_000_000
    got = readers.read_catalog(spark, str(f), on_bad="empty").agg(F.count("*"), F.countDistinct("id"), F.max("_pos"), F.sum(F.length("description"))).first()
    assert tuple(got) == (20_000, 20_000, 19_999, 20_000 * 7_600)
    f.unlink()


XML = """<?xml version="1.0" encoding="utf-8"?>
<MotorModel ManufacturerId="{m}" ProductId="{p}"><Name>[{m}-{p}] Lodestar F 500kg 4m/min (16fpm)</Name><ImageFile></ImageFile>
<VariableSpeedControl><MinSpeedClamp>30</MinSpeedClamp><MaxSpeedClamp>0</MaxSpeedClamp></VariableSpeedControl><OverloadLimit>500</OverloadLimit><EncoderScaling>0</EncoderScaling>
<TuningParameter ParameterIndex="1"><TuningParameterName>Gain</TuningParameterName><TuningParameterValue>5</TuningParameterValue></TuningParameter>
<TuningParameter ParameterIndex="2"><TuningParameterName>Gain</TuningParameterName><TuningParameterValue>bad</TuningParameterValue></TuningParameter></MotorModel>"""


def test_device_xml(spark, tmp_path):
    d = tmp_path / "xml" / "000 - Lodestar"
    d.mkdir(parents=True)
    (d / "one.xml").write_text(XML.format(m="000", p="001"))
    (d / "two.xml").write_text(XML.format(m="007", p="2"))
    (d / "skip.xxml").write_text(XML.format(m="000", p="9"))
    man = tmp_path / "makers.man"
    man.write_text('<Manufacturers><Manufacturer ManufacturerId="000"><ManufacturerName>000 - Lodestar</ManufacturerName></Manufacturer></Manufacturers>')
    raw = readers.read_devices(spark, str(tmp_path / "xml"))
    makers = readers.read_device_makers(spark, str(man))
    df = devices.parse_devices(raw)
    df = devices.enrich_devices(df, makers, "variableSpeedControl.minSpeed", "variableSpeedControl.maxSpeed")
    rows = {r.productId: r for r in df.collect()}
    assert set(rows) == {"001", "2"}
    r = rows["001"]
    assert (r.manufacturerId, r.manufacturer, r.loadCapacity, r.liftingSpeed, r.liftingSpeedFpm) == ("000", "Lodestar", "500 kg", "4 m/min", 16.0)
    assert r.variableSpeedControl.minSpeed == 30 and r.variableSpeedControl.maxSpeed is None and r.tuningParameters == {"Gain": 0.0}
    assert r.overloadLimit == 500 and r.encoderScaling is None and r.fileName == "one.xml" and r.manufacturerBrand == "CM Lodestar"
    assert rows["2"].manufacturer == "Unknown (007)"
    rep = devices.device_report(df)
    assert len(rep.columns) == 16 and rep.filter("`Min Speed` = '30'").count() == 2
    assert len(devices.device_enriched_report(df).columns) == 18
    cat = {r.id: r for r in devices.device_to_catalog(df.withColumn("_pos", F.lit(1))).collect()}
    assert cat["personality-000-001"].classification == ["entertainment", "unknown"]


def test_media_report_and_csv(spark, tmp_path):
    m = tmp_path / "m"
    m.mkdir()
    for n in ("a.pdf", "b.PNG", "c.txt"):
        (m / n).write_bytes(b"123")
    assert sorted(r.filename for r in readers.list_media(spark, str(m), readers.IMAGE_TYPES).collect()) == ["b.PNG"]
    (tmp_path / "r.json").write_text('{"f1": {"error": "x"}, "f2": {"ok": 1}}')
    assert sorted(r.key for r in readers.read_report(spark, str(tmp_path / "r.json")).select("key").collect()) == ["f1", "f2"]
    (tmp_path / "h.json").write_text('{"runs": [{"id": "1", "success": true, "duration": 2.5}, {"id": "2", "success": false}]}')
    assert readers.read_runs(spark, str(tmp_path / "h.json")).filter("success").count() == 1
    (tmp_path / "v.csv").write_text('"Manufacturer","Website","Region"\n"Kito","https://k","Japan, global"\n')
    assert readers.read_vendor_regions(spark, str(tmp_path / "v.csv")).first().Region == "Japan, global"


def test_exports(spark, sf, tmp_path):
    d = process_catalog(inputs.raw_catalog(spark, sf)).withColumn("certifications", F.create_map(F.lit("ce"), F.lit("1")))
    writers.export_json(d, str(tmp_path / "j"), {"manufacturer": "brand#1"}, "2025-01-01")
    n = d.filter(F.lower("manufacturer").contains("brand#1")).count()
    assert spark.read.json(str(tmp_path / "j/data")).count() == n
    assert spark.read.json(str(tmp_path / "j/metadata")).first().totalRecords == n
    writers.export_all(d, str(tmp_path / "all"), when="2025-01-01", map_keys={"certifications": ["ce"]})
    back = spark.read.csv(str(tmp_path / "all/csv"), header=True, escape='"')
    assert back.count() == d.count() and "certification_ce" in back.columns


def test_csv_headers_are_found(spark, tmp_path):
    """The header is the union of the keys of all rows."""
    d = spark.createDataFrame([("a", {"ce": "1"}, None), ("b", {"ip": "54", "ce": None}, {"x y": "2"}), ("c", None, {})], "id string, certifications map<string,string>, extras map<string,string>")
    assert writers.header_keys(d) == {"certifications": ["ce", "ip"], "extras": ["x y"]} and writers.header_keys(d.select("id")) == {}
    writers.export_csv(d, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"')
    assert back.columns == ["id", "certification_ce", "certification_ip", "extras_x y"]
    assert sorted(map(tuple, back.fillna("").collect())) == [("a", "1", "", ""), ("b", "", "54", "2"), ("c", "", "", "")]
    writers.export_csv(d, str(tmp_path / "j"), expand_maps=False)
    assert "extras" in spark.read.csv(str(tmp_path / "j"), header=True, escape='"').columns


def test_snapshots(spark, sf, tmp_path):
    root = str(tmp_path / "snap")
    r = inputs.raw_catalog(spark, sf).select("id", "model")
    for i, ts in enumerate(["2024-01-01T00-00-00", "2024-01-02T00-00-00", "2024-01-03T00-00-00"]):
        writers.snapshot(r.limit(10 * (i + 1)), root, ts)
    got = [(x.snapshot_ts, x.rows) for x in writers.list_snapshots(spark, root).collect()]
    assert got == [("2024-01-03T00-00-00", 30), ("2024-01-02T00-00-00", 20), ("2024-01-01T00-00-00", 10)]
    assert writers.restore(spark, root, "2024-01-01T00-00-00", r.limit(5), "2024-01-04T00-00-00").count() == 10
    assert writers.retain(spark, root, 2) == ["2024-01-02T00-00-00", "2024-01-01T00-00-00"] or len(writers.list_snapshots(spark, root).collect()) == 2


PAGE = """<html><head><script>var a='<a href="/no.pdf">x</a>'</script></head><body><h1>GM4 <b>Chain Hoist</b></h1>
<table><tr><th>Load Capacity</th><td>500 kg</td></tr><tr><td>Lifting speed</td><td>4 m/min</td></tr></table>
<dl><dt>Noise</dt><dd>60 dB</dd></dl><div class="spec"><span class="label">Duty</span><span class="value">M5</span></div>
<img data-src="/a.jpg" width="40"><img src="b.jpg" alt="CE mark"><img src="/icon.png"><img src="b.jpg">
<a href="/get/sheet.pdf">Datasheet</a><a href='manual.PDF' title="T"></a><a href="/get/sheet.pdf">again</a><a href="/x">Download</a>
<iframe src="https://www.youtube.com/embed/abcdefghijk"></iframe><video><source src="/v.mp4"></video>
<div class="product"><h3>Card A</h3><p>Text</p><img src="/c.png"></div><div class="product"><h3>X</h3></div></body></html>"""


def test_page_extraction(spark):
    p = spark.createDataFrame([(1, "http://s.com/d/p.html", PAGE)], "page_id long, url string, html string")
    assert extract.page_titles(p).first().model == "GM4"
    s = extract.extract_parsed_specs(p).select("parsed.*").first()
    assert (s.loadCapacity, s.liftingSpeed, s.dutyCycle, s.noiseLevel) == ("500 kg", "4 m/min", "M5", "60 dB")
    docs = {r.link: (r.type, r.title) for r in extract.extract_doc_links(p).collect()}
    assert docs == {"http://s.com/get/sheet.pdf": ("datasheet", "Datasheet"), "http://s.com/d/manual.PDF": ("manual", "T"), "http://s.com/x": ("document", "Download")}
    assert sorted(r.link for r in extract.extract_images(p).collect()) == ["http://s.com/c.png", "http://s.com/d/b.jpg"]
    assert sorted(r.video_url for r in extract.extract_videos(p).collect()) == ["http://s.com/v.mp4", "https://www.youtube.com/watch?v=abcdefghijk"]
    c = extract.extract_cards(p).collect()
    assert [(x.model, x.images[0].url) for x in c] == [("Card A", "http://s.com/c.png")]
    kinds = sorted((r.kind, r.value) for r in extract.extract_badges(p).collect())
    assert kinds == [("certification", "CE mark"), ("datasheet", "http://s.com/get/sheet.pdf")]


def test_product_record_is_one_pass(spark):
    """Pages that share an id stay apart, long texts stay whole, and no row is shuffled."""
    long = "word " * 600
    html = PAGE.replace("<p>Text</p>", f"<p>{long}</p>") + f'<div class="description">{long}</div><table><tr><td>{"L" * 80}</td><td>v</td></tr></table>'
    p = spark.createDataFrame([(1, "http://s.com/a", html), (1, "http://s.com/b", html), (2, "http://s.com/c", None), (3, "http://s.com/d", "<p>no heading")],
                              "page_id long, url string, html string")
    d = extract.extract_product(p, "Kito")
    rows = {r.url: r for r in d.collect()}
    assert set(rows) == {"http://s.com/a", "http://s.com/b"}
    a = rows["http://s.com/a"]
    assert (a.manufacturer, a.scrapedFrom, a.loadCapacity, len(a.description), a.rawSpecifications["l" * 80]) == ("Kito", "http://s.com/a", "500 kg", len(long.strip()), "v")
    assert [i.url for i in a.images] == ["http://s.com/b.jpg", "http://s.com/c.png"] and len(a.pdfs) == 3 and [v.type for v in a.videos] == ["youtube", "mp4"]
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    assert {len(r.description) for r in extract.extract_cards(p).collect() if r.description} == {len(long.strip())}


def test_pages_are_parsed_in_small_batches(spark):
    pages = spark.createDataFrame([(i, "http://a.b/", f'<div class="product"><h3>Card {i}</h3></div>' if i % 3 else None) for i in range(300)], "page_id int, url string, html string")
    cards = extract.extract_cards(pages)
    assert {(r.page_id, r.model) for r in cards.collect()} == {(i, f"Card {i}") for i in range(300) if i % 3}
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def _stream(spark, df, path, n=3):
    df.repartitionByRange(n, "ts").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_match_batch(spark, sf, tmp_path):
    e = inputs.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = _stream(spark, e, str(tmp_path / "ev"))
    far = spark.createDataFrame([(-1, "2099-01-01 00:00:00", -1, "view", 0.0, "{}")], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    far.write.mode("append").parquet(str(tmp_path / "ev"))
    q = streams.rate_windows(s, "event_type", "1 day", None, 5, watermark="40 days").writeStream.format("memory").queryName("rates").outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.event_type, str(r.window_start), r.n) for r in df.collect())
    assert key(spark.table("rates").filter("window_start < '2090-01-01'")) == key(streams.rate_windows(e, "event_type", "1 day", None, 5))
    h = s.withColumn("hash", F.sha2(F.col("event_type"), 256))
    q = streams.stream_dedupe(h, "hash", "60 days").writeStream.format("memory").queryName("dd").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dd").filter("event_id >= 0").count() == e.select("event_type").distinct().count()


def test_ttl_gates_and_sessions_on_a_stream(spark, sf, tmp_path):
    """The streaming forms give what the static ones give, on the same events."""
    e = inputs.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value")
    source = str(tmp_path / "ev")
    day = "CAST(floor(datediff(ts, '2024-01-01') / 8) AS INT)"
    for i in sorted(r[0] for r in e.selectExpr(day).distinct().collect()):  # one file after the other, in the order of the events
        e.filter(F.expr(day) == i).coalesce(1).write.mode("append").parquet(source)
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    spark.sql("SELECT -1L AS event_id, timestamp'2099-01-01' AS ts, -1L AS user_id, 'far' AS event_type, 0D AS value").write.mode("append").parquet(source)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(240)
        return spark.table(name)

    ttl = run(streams.stream_dedupe(s, "event_type", "3 days"), "ttl").filter("event_type <> 'far'")
    static = streams.stream_dedupe(e, "event_type", "3 days", pos="event_id")
    at = lambda df: sorted((r.event_type, r.ts) for r in df.collect())
    assert at(ttl) == at(static) and ttl.count() > e.select("event_type").distinct().count()
    missing, limits = {"value": F.col("value") < 20}, {"value": 50.0}
    gates = run(streams.rolling_gates(s, missing, limits, watermark="40 days"), "gates").filter("window_start < '2090-01-01'")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(gates) == key(streams.rolling_gates(e, missing, limits)) and gates.count() > 10
    idle = run(streams.idle_sessions(s, "user_id", 3600, watermark="40 days"), "idle").filter("user_id >= 0")
    cols = ["user_id", "session_start", "stale_at", "n"]
    assert key(idle.select(*cols)) == key(streams.idle_sessions(e, "user_id", 3600).select(*cols))


def test_stream_upsert_reaches_batch_state(spark, sf, tmp_path):
    e = inputs.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("_pos"), "ts", "event_type", F.when(F.col("value") > 20, F.col("value")).alias("value"))
    t = streams.UpsertTable(str(tmp_path / "table"))
    n, path = rows.count(), str(tmp_path / "in")
    for i in range(3):  # one file after the other: the file source reads them in that order
        rows.filter((F.col("_pos") * 3 >= i * n) & (F.col("_pos") * 3 < (i + 1) * n)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    streams.stream_upsert(stream, t, str(tmp_path / "ck")).awaitTermination(120)
    want = rows.groupBy("id").agg(F.max_by("event_type", "_pos").alias("event_type"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("_pos"))).alias("value"))
    key = lambda df: sorted((r.id, r.event_type, r.value or 0) for r in df.collect())
    assert key(t.current(spark)) == key(want)
    t.compact(spark)
    assert key(t.current(spark)) == key(want)


def test_upsert_table_keeps_new_queries_and_columns(spark, tmp_path):
    t = streams.UpsertTable(str(tmp_path / "t"))
    mk = lambda rows, cols: spark.createDataFrame(rows, cols)
    t.append(mk([("a", 1, "x"), ("b", 2, "y")], "id string, _pos long, v string"), 0, "first")
    t.append(mk([("a", 3, "z")], "id string, _pos long, v string"), 1, "first")
    assert t.compact(spark) == 1
    t.append(mk([("c", 4, "w", 7), ("a", 5, None, 8)], "id string, _pos long, v string, extra int"), 0, "second")  # a new checkpoint begins at 0
    t.append(mk([("a", 3, "z")], "id string, _pos long, v string"), 1, "first")  # a retry of a batch that the base holds
    want = [("a", "z", 8), ("b", "y", None), ("c", "w", 7)]
    assert sorted((r.id, r.v, r.extra) for r in t.current(spark).collect()) == want
    assert t.compact(spark) == 2
    assert sorted((r.id, r.v, r.extra) for r in t.current(spark).collect()) == want


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    src = str(tmp_path / "late")
    mk([("a", "2024-01-10 00:00:00"), ("b", "2024-01-10 01:00:00")]).coalesce(1).write.parquet(src)
    s = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)

    def run():
        q = streams.rate_windows(s, "k", "1 hour", None, 0, watermark="1 hour").writeStream.format("parquet").outputMode("append") \
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])

    assert run() == 0
    mk([("a", "2024-01-01 00:00:00")]).coalesce(1).write.mode("append").parquet(src)
    assert run() == 1


def test_stored_table_is_built_once(spark):
    from specmill.session import stored

    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert stored(spark, "t-once", build).count() == 5 and stored(spark, "t-once", build).count() == 5
    assert len(calls) == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from specmill.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_stored_tables_follow_their_source(spark, tmp_path):
    from specmill.session import source_key, stored

    path = str(tmp_path / "source")
    for n in (3, 4):
        spark.range(n).write.mode("overwrite").parquet(path)
        source = spark.read.parquet(path)
        assert stored(spark, f"follows-{source_key(source)}", lambda: source).count() == n


def test_workers_import_the_package_from_any_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""import sys; sys.path.insert(0, {str(root)!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", __spark_entry__.queries()["x06_extract_cards"](spark, "/root/testdata/sf0.001").count())"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "rows 50" in done.stdout, done.stderr[-2000:]


def test_documents_of_a_large_group_are_bounded(spark, sf, tmp_path, monkeypatch):
    from specmill.plans import q_sources

    monkeypatch.setattr(q_sources, "RECORDS", 50)
    rows = spark.range(1_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") >= 10, "large").alias("maker"))
    q_sources._documents(rows, "maker", str(tmp_path / "d"), "products")
    sizes = [len(json.loads(f.read_text())["products"]) for f in (tmp_path / "d").glob("*/*.txt")]
    assert sum(sizes) == 1_000 and len(sizes) >= 20 and max(sizes) < 150
    events = spark.read.parquet(f"{sf}/events.parquet")
    for query in (q_sources.src4, q_sources.src4_runs):
        assert query(spark, sf).count() == events.count()
