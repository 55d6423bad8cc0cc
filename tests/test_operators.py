"""Invariants and brute-force comparisons on small data."""

import random
import re

import pytest
from pyspark.sql import functions as F

from specmill.operators import dedupe, linkage, merge, quality, reports, rules, search
from specmill.plans import inputs
from specmill.plans.q_records import catalog, search_catalog


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_filters_only_shrink_and_split_is_a_partition(spark, sf):
    d = catalog(spark, sf)
    all_ids = set(ids(d))
    for f in (search.filter_catalog(d, "brand#1"), search.text_search(d, "red"), search.capacity_range(d, 500, 900)):
        assert set(ids(f)) <= all_ids
    good, bad = rules.split_valid(inputs.raw_catalog(spark, sf))
    assert sorted(ids(good) + ids(bad)) == sorted(all_ids)


def test_dedupe_is_idempotent(spark, sf):
    once = dedupe.dedupe_fold(catalog(spark, sf)).drop("_merged")
    twice = dedupe.dedupe_fold(once.drop("_key"))
    assert once.count() == twice.count()
    assert twice.agg(F.max("_merged")).first()[0] == 1


def test_dedupe_fold_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("AB"), rng.choice(["x", "y"]), rng.choice([None, "", "s", "long", "looo"]), rng.choice([None, 1.0, 2.0]),
             rng.choice([None, [], ["a"], ["b", "a"], ["c"]])) for i in range(200)]
    df = spark.createDataFrame(rows, "_pos long, manufacturer string, model string, weight string, confidence double, bodyColor array<string>")
    want = {}
    for pos, m, mo, w, conf, arr in rows:
        e = want.setdefault(f"{m}:{mo}", {"w": None, "c": None, "a": None})
        if w and (e["w"] is None or len(w) > len(e["w"])):
            e["w"] = w
        if conf is not None and e["c"] is None:
            e["c"] = conf
        if arr is not None:
            e["a"] = (e["a"] or []) + [x for x in dict.fromkeys(arr) if x not in (e["a"] or [])]
    got = dedupe.dedupe_fold(df, key=F.concat_ws(":", "manufacturer", "model"), recompute=False).collect()
    assert len(got) == len(want)
    for r in got:
        e = want[r._key]
        assert (r.weight or None, r.confidence, r.bodyColor) == (e["w"], e["c"], e["a"])


def test_inline_media(spark, sf):
    d = catalog(spark, sf)
    total = d.agg(F.sum(F.size("images"))).first()[0]
    inline = dedupe.dedupe_fold(d, media="inline", recompute=False)
    assert inline.agg(F.sum(F.size("images"))).first()[0] == total == dedupe.fold_media(d, "images").count()


def test_merge_never_loses_a_base_row(spark, sf):
    r = inputs.raw_catalog(spark, sf)
    m = merge.merge_catalogs(r.filter("_pos % 2 = 0"), r.filter("_pos % 3 = 0"))
    assert set(ids(r.filter("_pos % 2 = 0"))) <= set(ids(m))
    assert m.count() == m.select("id").distinct().count()


def test_gates_are_monotone(spark, sf):
    d = catalog(spark, sf)
    ok = lambda **k: {r.gate: r.passed for r in quality.processor_gates(d, **k).collect()}
    loose, tight = ok(loadCapacity=100), ok(loadCapacity=0)
    assert loose["Missing loadCapacity"] and not tight["Missing loadCapacity"]
    empty = {r.gate: r.passed for r in quality.processor_gates(d.limit(0)).collect()}
    assert not any(empty.values())


def test_paging_edges(spark, sf):
    d = catalog(spark, sf)
    n = d.count()
    pos = lambda df: [r._pos for r in df.collect()]
    assert pos(search.paginate(d, 0, 0)) == pos(search.paginate(d, 1, 50))
    assert pos(search.paginate(d, 99999, 50)) == []
    assert pos(search.paginate(d, -1, 50)) == list(range(n - 100, n - 50))
    with pytest.raises(ValueError):
        search.paginate(d, -1, 50, mode="strict")
    with pytest.raises(ValueError):
        search.by_tier(d, "best")


def test_navigation_agrees_with_batch_form(spark, sf):
    d = catalog(spark, sf)
    batch = {r.id: r for r in search.navigate_all(d, "capacity", "desc").collect()}
    for i in ("p-0", "p-17", "p-199"):
        one = search.navigate(d, i, "capacity", "desc").first()
        assert (one.prev_id, one.next_id, one.position) == (batch[i].prev_id, batch[i].next_id, batch[i].position)


def test_containment_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("ab-") for _ in range(rng.randint(0, k)))
    a, b = [(rng.choice("xy"), word(4)) for _ in range(60)], [(rng.choice("xy"), word(9)) for _ in range(60)]
    da, db = spark.createDataFrame(a, "k string, s string").distinct(), spark.createDataFrame(b, "k string, t string").distinct()
    got = {tuple(r) for r in linkage.containment(da, db, "s", "t", ["k"]).select("k", "s", "t").collect()}
    assert got == {(k, s, t) for k, s in set(a) for j, t in set(b) if k == j and s and s in t}


@pytest.mark.parametrize("compat", [False, True])
def test_link_docs_against_brute_force(spark, compat):
    rng = random.Random(3)
    p = [(f"p{i}", rng.choice(["Kito", "Kito Hoists", "Demag", ""]), rng.choice(["ER2", "ER", "", "DC Pro"]), rng.choice(["", "ER", "DC"])) for i in range(40)]
    d = [(f"f{i}", rng.choice(["kito", "demag", "kito-hoists"]), rng.choice(["er2", "dc-pro-x", "e", ""])) for i in range(12)]
    got = {tuple(r) for r in linkage.link_docs(spark.createDataFrame(p, "id string, manufacturer string, model string, series string"),
                                               spark.createDataFrame(d, "filename string, vendor string, product string"), compat).collect()}
    both = lambda x, y: ((x in y) or (y in x)) and (compat or bool(x and y))
    want = {(f, i) for f, v, q in d for i, m, mo, s in p
            if both(v.replace("-", " "), m.lower()) and (both(q.replace("-", " "), mo.lower()) or both(q.replace("-", " "), s.lower()))}
    assert got == want


def test_link_images_against_brute_force(spark):
    rng = random.Random(4)
    toks = ["red", "redd", "pro", "max", "dc", "chain"]
    slug = lambda k: "-".join(rng.choice(toks) for _ in range(rng.randint(1, k)))
    p = [(f"v-{slug(2)}-{i}", rng.choice("AB"), slug(4).replace("-", " "), i % 2) for i in range(40)]
    im = sorted({(rng.choice("AB"), slug(3), rng.randint(0, 1)) for _ in range(25)})
    prods = spark.createDataFrame(p, "id string, manufacturer string, model string, n_images int")
    imgs = spark.createDataFrame([(v, s, i, f"{v}/{s}/{i}") for v, s, i in im], "vendor string, page string, index int, url string")
    got = {(r.id, r.url, r.how) for r in linkage.link_images(prods, imgs).collect()}

    def hit(ps, ms, ds):
        if ms in ps or ps in ms or ds in ps or ps in ds:
            return True
        mt = [m for m in ms.split("-") if len(m) > 2]
        return sum(any(t in m or m in t for m in mt) for t in ps.split("-") if len(t) > 2) >= 2

    want = set()
    for i, m, mo, n in p:
        ms, ds = mo.lower().replace(" ", "-"), i.split("-", 1)[1]
        hits = {(i, f"{v}/{s}/{x}", "match") for v, s, x in im if v == m and hit(s, ms, ds)}
        if not hits and n == 0:
            hits = {(i, f"{m}/{s}/0", "fallback") for s in sorted({s for v, s, x in im if v == m and x == 0})[:3]}
        want |= hits
    assert got == want


def test_growing_sides_of_links_are_not_sent_to_the_driver(spark):
    prods = spark.createDataFrame([(f"a-{i}", "A", f"red pro {i}", i % 2) for i in range(30)], "id string, manufacturer string, model string, n_images int")
    imgs = spark.createDataFrame([("A", "red-pro", 0, "u"), ("A", "pro-x-red", 1, "w")], "vendor string, page string, index int, url string")
    links = linkage.link_images(prods, imgs)
    assert links.count() == 60
    links.collect()
    built = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", links._jdf.queryExecution().executedPlan().toString())
    assert {re.sub(r"#\d+", "", keys) for keys in built} <= {"v", "manufacturer", "_q"}  # vendors and at most four sizes


def test_latency_percentiles_against_sorting(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else "b", float(rng.choice([1, 2, 2.5, 7, 100])) if i % 2 else rng.random()) for i in range(500)] + [("one", 3.0)]
    got = {r.k: r for r in reports.latency_summary(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", F.lit(True), 50).collect()}
    for k in ("hot", "b", "one"):
        v = sorted(x for kk, x in rows if kk == k)
        assert (got[k].median, got[k].p95, got[k].p99) == (v[len(v) // 2], v[int(len(v) * .95)], v[int(len(v) * .99)])


def test_one_outlier_does_not_make_one_range(spark):
    """A long-tailed hot key is spread over the ranges by its values."""
    df = spark.range(20_000).selectExpr("'hot' AS k", "IF(id = 0, 1e12, id / 7.0) AS v")
    got = reports.latency_summary(df, ["k"], "v", F.lit(True)).first()
    v = sorted([1e12] + [i / 7.0 for i in range(1, 20_000)])
    assert [got.median, got.p95, got.p99] == [pytest.approx(v[int(20_000 * q)]) for q in (0.5, 0.95, 0.99)]


def test_pages_by_number_and_by_key(spark, sf):
    d = catalog(spark, sf)
    for by, order in ((None, "asc"), ("capacity", "desc"), ("model", "asc")):
        whole = [r.id for r in search.sort_catalog(d, by, order).collect()]
        assert [r.id for r in search.paginate(d, 3, 25, by, order).collect()] == whole[50:75]
        assert [r.id for r in search.paginate(d, -1, 25, by, order).collect()] == whole[-50:-25]
        assert search.paginate(d, 99_999, 25, by, order).count() == 0
        last = search.paginate(d, 2, 25, by, order).select("_pos", *([search.sort_key(by).alias("k")] if by else [])).collect()[-1]
        assert [r.id for r in search.paginate(d, limit=25, by=by, order=order, after=(last.k, last["_pos"]) if by else last["_pos"]).collect()] == whole[50:75]


def test_deep_pages_by_selection(spark, monkeypatch):
    """Pages far from both ends, with many equal keys, found with few sorted and drawn keys."""
    monkeypatch.setattr(search, "TOP", 40)
    monkeypatch.setattr(search, "DRAWN", 150)
    rng = random.Random(5)
    rows = [(i, f"p-{i}", rng.choice([f"{rng.randrange(40)} kg", "5 kg", "5 kg", None]), rng.choice(["Émile", "emile", "Zed", "alpha", "Beta"]) + str(rng.randrange(30))) for i in range(3_000)]
    d = spark.createDataFrame(rows, "_pos long, id string, loadCapacity string, model string").repartition(4).cache()
    for by, order, collate in ((None, "asc", False), ("capacity", "desc", False), ("capacity", "asc", False), ("model", "asc", True), ("model", "desc", False)):
        whole = [r.id for r in search.sort_catalog(d, by, order, collate).collect()]
        for page in (2, 17, 60, 118, 120, 121, -1, -60, -119, -120):
            skip = (page - 1) * 25 if page > 0 else len(whole) + (page - 1) * 25
            want = whole[skip:skip + 25] if skip >= 0 else []
            assert [r.id for r in search.paginate(d, page, 25, by, order, collate).collect()] == want, (by, order, page)
    plan = search.paginate(d, 60, 25, "capacity")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan and "Window" not in plan


def test_ttl_rounds_are_few(spark):
    """Hundreds of kept rows of one key take a few rounds."""
    from specmill.streaming.streams import stream_dedupe

    df = spark.range(3_000).selectExpr("'k' AS hash", "timestamp_seconds(id * 3600 * 8) AS ts", "id")
    kept = [r.id for r in stream_dedupe(df, "hash", "1 day", pos="id").orderBy("id").collect()]
    assert kept == list(range(0, 3_000, 3))


def test_confidence_rule(spark):
    df = spark.createDataFrame([("a", "old", 0.5), ("b", "old", 0.9), ("c", "", 0.9), ("d", "old", None)], "id string, weight string, confidence double")
    ext = spark.createDataFrame([(x, "new", 0.85) for x in "abcd"], "id string, weight string, confidence double")
    got = {r.id: (r.weight, r.confidence) for r in merge.merge_confident(df, ext).collect()}
    assert got == {"a": ("new", 0.85), "b": ("old", 0.9), "c": ("new", 0.9), "d": ("old", 0.85)}


def test_plan_shapes(spark, sf):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = plan(search.filter_catalog(catalog(spark, sf), "brand").select("id"))
    assert "Exchange" not in p and "PushedFilters" in p
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    stored_ = search_catalog(spark, sf)
    pushed = lambda df: re.search(r"PushedFilters: \[(.*?)\], ReadSchema", df.select("id")._jdf.queryExecution().executedPlan().toString(), re.S)[1]
    f02 = pushed(search.filter_catalog(stored_, "Brand#1", "RED", "D8", 500, 40000))
    assert "GreaterThanOrEqual(_kg" in f02 and "StringContains(_manufacturer,brand#1" in f02
    assert "GreaterThanOrEqual(_kg,1000" in pushed(search.capacity_range(stored_, lo=1000))
    assert "EqualTo(_bucket," in pushed(search.facet_filter(stored_, capacity="501-1000 kg", dataQuality="hasImages"))
    raw = plan(inputs.raw_catalog(spark, sf).select("id", "loadCapacity"))
    assert "lineitem" not in raw and "Join" not in raw
    for df in (merge.upsert(inputs.raw_catalog(spark, sf), inputs.raw_catalog(spark, sf).select("id", "_pos", "weight")),
               dedupe.duplicate_groups(catalog(spark, sf))):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)
    first = plan(search.paginate(catalog(spark, sf), 1, 10, "capacity"))
    assert "TakeOrderedAndProject" in first
    deep = plan(search.paginate(catalog(spark, sf), 100_000, 50, "capacity"))
    assert "TakeOrderedAndProject" not in deep and "limit=50000" not in deep


def _hot(n=900):
    rng = random.Random(7)
    return [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}", 1700000000 + rng.randint(0, 400000)) for i in range(n)]


def test_hot_key_numbering(spark):
    from specmill.functions.names import numbered

    rows = _hot()
    got = {r._pos: r.n for r in numbered(spark.createDataFrame(rows, "_pos long, k string, t long"), "k", "n").collect()}
    seen = {}
    for pos, k, _ in rows:
        assert got[pos] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


def test_static_sessions_equal_session_windows(spark):
    from specmill.streaming.streams import idle_sessions

    df = spark.createDataFrame(_hot(), "_pos long, k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    want = df.groupBy(F.session_window("ts", "3600 seconds").alias("s"), "k").count().select("k", "s.start", "s.end", "count").collect()
    got = idle_sessions(df, "k", 3600).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_ttl_dedupe_against_a_loop(spark):
    from specmill.streaming.streams import stream_dedupe

    rows = _hot(300)
    kept, last = set(), {}
    for pos, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t >= last[k] + 86400:
            kept.add(pos)
            last[k] = t
    df = spark.createDataFrame(rows, "_pos long, k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert {r._pos for r in stream_dedupe(df, "k", "1 day", pos="_pos").collect()} == kept


def test_rank_matches_keeps_the_best_of_a_hot_vendor(spark):
    prods = [(f"p{i}", i, "Hot", f"Model {i % 50}" if i % 2 else "Model", "S") for i in range(400)]
    files = [("hot_model-7_document_0.pdf", 0, "Hot", "model 7", "", "", "")]
    got = linkage.rank_matches(spark.createDataFrame(prods, "id string, _pos long, manufacturer string, model string, series string"),
                               spark.createDataFrame(files, "filename string, _pos long, vendor string, slug string, ext_manufacturer string, ext_model string, ext_series string"))
    conf = lambda m: 0.7 + (0.2 if m.lower() in "model 7" else 0)
    fits = [(i, pos, conf(m)) for i, pos, _, m, _ in prods if "model 7" in m.lower() or m.lower() in "model 7"]
    want = [i for i, _, _ in sorted(fits, key=lambda x: (-x[2], x[1]))[:5]]
    assert [r.id for r in got.orderBy("rank").collect()] == want


def test_schema_errors_name_elements_and_say_why(spark):
    df = spark.sql("""SELECT 'a' AS id, 'Kito' AS manufacturer, CAST(NULL AS STRING) AS model, 'nowhere' AS url,
      array(named_struct('url', '', 'type', 'photo'), named_struct('url', '/x.jpg', 'type', 'logo')) AS images, array('http://a', 'b') AS manualSources,
      named_struct('minSpeed', 3, 'maxSpeed', 'x') AS variableSpeedControl, 101.0D AS dataCompleteness""")
    errors = lambda **o: {(e.field, e.type): e.message for e in quality.schema_errors(df, **o).first().errors}
    assert errors() == {
        ("model", "any.required"): '"model" is required', ("url", "string.uri"): '"url" must be a valid uri',
        ("images.0.url", "any.required"): '"images.0.url" is required', ("images.0.type", "any.only"): '"images.0.type" must be one of [product, diagram, detail, logo]',
        ("manualSources.1", "string.uri"): '"manualSources.1" must be a valid uri', ("variableSpeedControl.minSpeed", "string.base"): '"variableSpeedControl.minSpeed" must be a string',
        ("dataCompleteness", "number.max"): '"dataCompleteness" must be less than or equal to 100'}
    assert set(errors(strict=True)) == set(errors())
    assert ("url", "any.required") in {(e.field, e.type) for e in quality.schema_errors(df.withColumn("url", F.lit(None).cast("string")), strict=True).first().errors}


def test_enrichment_takes_one_row_per_id_and_stamps(spark):
    df = spark.createDataFrame([("a", "", 0.5), ("b", "old", 0.9)], "id string, weight string, confidence double")
    ext = spark.createDataFrame([("a", 1, "first", 0.9), ("a", 2, "last", 0.9), ("a", 2, "last", 0.9)], "id string, _pos long, weight string, confidence double")
    for out in (merge.fill_from(df, ext, ["weight"], now="2025-01-02 03:04:05", provider="p"), merge.merge_confident(df, ext, ["weight"], now="2025-01-02 03:04:05", provider="p")):
        rows = {r.id: r for r in out.collect()}
        assert len(rows) == out.count() == 2
        assert (rows["a"].weight, rows["a"].llmEnriched, str(rows["a"].llmEnrichedDate), rows["a"].llmProvider) == ("last", True, "2025-01-02 03:04:05", "p")
        assert (rows["b"].weight, rows["b"].llmEnriched) == ("old", None)
