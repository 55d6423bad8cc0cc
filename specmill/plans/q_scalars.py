"""Scalar functions over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonrepair, mining, names, units, values, web
from ..functions.text import c, content_hash, truncate_text
from . import inputs
from .oracle import (CAP_KG, KG, MPM, NUM, SPEED, bucket, classes, dev, f, model, norm_capacity, norm_power, norm_speed, num, power_bucket,
                     present, raw, speed_bucket, vendor)
from .registry import query


def rawq(name, exprs: dict, sql: str):
    """Query over the raw catalogue: id plus computed columns."""
    cols = ", ".join(f"{v} AS {k}" for k, v in sql.items())

    @query(name, raw(f"SELECT id, {cols} FROM raw"))
    def run(spark, sf):
        return inputs.raw_catalog(spark, sf).select("id", *[v().alias(k) for k, v in exprs.items()])


rawq("s01_capacity_kg", {"kg": lambda: units.capacity_kg("loadCapacity")}, {"kg": f(CAP_KG, "loadCapacity")})
rawq("s02_speed_mpm", {"mpm": lambda: F.round(units.speed_mpm("liftingSpeed"), 6)}, {"mpm": f"round({f(SPEED, 'liftingSpeed')}, 6)"})
rawq("s03_normalize_capacity", {"t": lambda: units.normalize_capacity("loadCapacity")}, {"t": norm_capacity("loadCapacity")})
rawq("s04_normalize_speed", {"t": lambda: units.normalize_speed("liftingSpeed")}, {"t": norm_speed("liftingSpeed")})
rawq("s05_normalize_power", {"t": lambda: units.normalize_power("motorPower")}, {"t": norm_power("motorPower")})
rawq("s06_normalize_classes", {"t": lambda: F.array_join(values.normalize_classes("classification"), "|")},
     {"t": f"array_to_string({classes('classification_raw')}, '|')"})
rawq("s07_to_bool", {"b": lambda: values.to_bool("quietOperation"), "n": lambda: values.to_bool("confidence", "number")},
     {"b": "coalesce(lower(quietOperation) IN ('yes', 'true', 'y', '1'), false)", "n": "coalesce(confidence <> 0, false)"})
rawq("s08_clean_manufacturer", {"t": lambda: values.clean_manufacturer("manufacturer")}, {"t": vendor("manufacturer")})
rawq("s09_clean_model", {"t": lambda: values.clean_model("model")}, {"t": model("model")})
rawq("s10_has_value", {
    "a": lambda: values.has_value("loadCapacity", "a"), "a_speed": lambda: values.has_value("liftingSpeed", "a"),
    "b": lambda: values.has_value("images", "b", "list"), "c": lambda: values.has_value("motorPower", "c"),
    "c_num": lambda: values.has_value("confidence", "c", "number"), "d": lambda: values.has_value("motorPower", "d"),
    "d_dim": lambda: values.has_value("dimensions", "d", display="dimensions")},
    {"a": present("loadCapacity"), "a_speed": present("liftingSpeed"), "b": "n_images > 0",
     "c": "coalesce(motorPower, '') NOT IN ('', '-')", "c_num": "coalesce(confidence, 0) <> 0",
     "d": "coalesce(motorPower, '') NOT IN ('', '-', 'Not specified')",
     "d_dim": "coalesce(dimensions, '') NOT IN ('', '-', 'Not specified', 'Not visible')"})
rawq("s11_slugs", {
    "a": lambda: names.slug("model"), "b": lambda: names.slug("url", "runs"), "c": lambda: names.slug("model", "chars"),
    "d": lambda: names.vendor_model_id(mode="joined")},
    {"a": "regexp_replace(regexp_replace(lower(model), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')",
     "b": "regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g')",
     "c": "regexp_replace(lower(model), '[^a-z0-9]', '-', 'g')",
     "d": "regexp_replace(regexp_replace(lower(manufacturer || '--' || model), '[^a-z0-9]', '-', 'g'), '-+', '-', 'g')"})
rawq("s13_capacity_bucket", {
    "a": lambda: units.capacity_bucket(units.search_capacity("loadCapacity")),
    "b": lambda: units.capacity_bucket(units.first_integer("loadCapacity"), "tight"),
    "c": lambda: units.capacity_bucket(F.coalesce(F.when(c("loadCapacity").isNotNull() & (c("loadCapacity") != ""), units.leading_integer("loadCapacity")).otherwise(0.0)))},
    {"a": bucket(f(KG, "loadCapacity")), "b": bucket(num("loadCapacity", r"(\d+)"), "tight"),
     "c": bucket(f"(CASE WHEN coalesce(loadCapacity, '') = '' THEN 0 ELSE {num('loadCapacity', '^([0-9]+)')} END)")})
rawq("s14_speed_bucket", {"a": lambda: units.speed_bucket(units.search_speed("liftingSpeed")),
                          "b": lambda: units.speed_bucket(units.speed_mpm("liftingSpeed"), "page")},
     {"a": speed_bucket(f(MPM, "liftingSpeed")), "b": speed_bucket(f(SPEED, "liftingSpeed"), ">8 m/min")})
rawq("s15_power_bucket", {"t": lambda: units.power_bucket("motorPower")}, {"t": power_bucket("motorPower")})
_C = [present(x) for x in ("loadCapacity", "liftingSpeed", "motorPower", "dutyCycle")] + [f"(len({classes('classification_raw')}) > 0)"]
_S = [present(x) for x in ("weight", "protectionClass", "series")] + ["(voltage_raw IS NOT NULL)"]
_SUM_C, _SUM_S = (" + ".join(f"{x}::INT" for x in y) for y in (_C, _S))
rawq("s16_completeness", {"a": lambda: values.completeness("a"), "c": lambda: values.completeness("c"), "b": lambda: F.round(values.completeness("b"), 6)},
     {"a": f"CAST(floor(0.5 + 70.0 * ({_SUM_C}) / 5 + 30.0 * ({_SUM_S}) / 4) AS INT)",
      "c": f"CAST(floor(0.5 + 70.0 * ({_SUM_C}) / 5 + 30.0 * ({_SUM_S}) / 4) AS INT)",
      "b": f"round(0.7 * ({_SUM_C}) / 5 + 0.3 * ({_SUM_S}) / 4, 6)"})
_T = [f"(coalesce({x}, '') NOT IN ('', '-'))" for x in ("loadCapacity", "liftingSpeed", "motorPower", "url")]
_T += [f"(coalesce({x}, '') NOT IN ('', '-', 'Not specified', 'Not visible'))" for x in ("weight", "dimensions")]
_T += [f"(len({classes('classification_raw')}) > 0)", "(n_images > 0)", "(n_pdfs > 0 OR n_downloads > 0)"]
_DISP = f"CAST(floor(0.5 + 100.0 * ({' + '.join(x + '::INT' for x in _T)}) / 9) AS INT)"
rawq("s17_display_completeness", {"score": lambda: values.display_completeness(), "cls": lambda: values.display_class(values.display_completeness())},
     {"score": _DISP, "cls": f"CASE WHEN {_DISP} >= 80 THEN 'high' WHEN {_DISP} >= 50 THEN 'medium' ELSE 'low' END"})
rawq("s18_quality_tier", {"t": lambda: values.quality_tier((c("_pos") % 101).cast("int"))},
     {"t": "CASE WHEN _pos % 101 >= 80 THEN 'complete' WHEN _pos % 101 >= 60 THEN 'partial' WHEN _pos % 101 >= 30 THEN 'incomplete' ELSE 'minimal' END"})
rawq("s20_has_complete_specs", {"a": lambda: values.has_complete_specs("a"), "c": lambda: values.has_complete_specs("c")},
     {"a": " AND ".join(_C[:3]), "c": " AND ".join(_T[:3])})
rawq("s21_ensure_array", {"t": lambda: F.array_join(values.ensure_array("weight"), ","), "n": lambda: F.size(values.ensure_map(F.lit(None).cast("map<string,string>")))},
     {"t": "weight", "n": "CAST(0 AS INT)"})


@query("s22_vendor_rules", raw(f"""SELECT id, CASE WHEN m = 'Columbus McKinnon' AND contains(model, 'Lodestar') THEN 'Lodestar'
    WHEN m = 'Verlinde' AND contains(model, 'SR') THEN 'Stagemaker SR' WHEN m = 'Verlinde' AND contains(model, 'SL') THEN 'Stagemaker SL' ELSE series END AS series,
    CASE WHEN coalesce(classification_raw, '') <> '' THEN 'given' WHEN m = 'Columbus McKinnon' AND contains(model, 'Lodestar') THEN 'd8'
         WHEN m = 'Chainmaster' AND contains(model, 'D8+') THEN 'd8+' WHEN m = 'Chainmaster' AND contains(model, 'D8') THEN 'd8' ELSE '' END AS cls
  FROM (SELECT *, {vendor('manufacturer')} AS m FROM raw)"""))
def s22(spark, sf):
    r = inputs.raw_catalog(spark, sf).withColumn("manufacturer", values.clean_manufacturer("manufacturer"))
    had = F.size("classification") > 0
    r = r.withColumn("_had", had)
    out = values.apply_vendor_rules(r)
    return out.select("id", "series", F.when(c("_had"), "given").otherwise(F.array_join("classification", ",")).alias("cls"))


@query("s23_source", raw("""SELECT id, CASE WHEN coalesce(source, '') <> '' THEN source WHEN llmEnriched THEN 'llm_enriched'
  WHEN coalesce(url, '') <> '' THEN 'scraped' ELSE 'unknown' END AS source, nullif(url, '') AS source_url FROM raw"""))
def s23(spark, sf):
    r = inputs.raw_catalog(spark, sf)
    return r.select("id", values.source_of(r).alias("source"), values.source_url_of(r).alias("source_url"))


rawq("s25_search_numbers", {"kg": lambda: units.search_capacity("loadCapacity"), "speed": lambda: units.search_speed("liftingSpeed")},
     {"kg": f(KG, "loadCapacity"), "speed": f(MPM, "liftingSpeed")})
_ANYV = num("replace(regexp_extract(loadCapacity, '(\\d+(?:[.,]\\d+)?)', 1), ',', '.')", "(.+)")
_ANY = (f"round(CASE WHEN regexp_matches(lower(loadCapacity), 'lb|pound') THEN {_ANYV} * 0.453592 WHEN contains(lower(loadCapacity), 'ton') "
        f"THEN {_ANYV} * CASE WHEN contains(lower(loadCapacity), 'short') THEN 907.185 ELSE 1000 END ELSE {_ANYV} END)")
rawq("s26_capacity_any_unit", {"kg": lambda: units.capacity_any_unit("loadCapacity", "compat"),
                               "kg_fixed": lambda: units.capacity_any_unit("loadCapacity")},
     {"kg": _ANY, "kg_fixed": f"coalesce(round({f(KG, 'loadCapacity')}), {_ANY})"})
_EST = ("CASE WHEN {0} <= 0 THEN NULL WHEN {0} <= 125 THEN '0.18-0.25 kW' WHEN {0} <= 250 THEN '0.25-0.37 kW' WHEN {0} <= 500 THEN '0.37-0.75 kW' "
        "WHEN {0} <= 1000 THEN '0.75-1.5 kW' WHEN {0} <= 2000 THEN '1.5-3.0 kW' WHEN {0} <= 5000 THEN '3.0-7.5 kW' "
        "WHEN {0} <= 10000 THEN '7.5-15 kW' WHEN {0} > 10000 THEN '15+ kW' END")
rawq("s27_estimate_power", {"t": lambda: values.estimate_power(units.capacity_kg("loadCapacity"))}, {"t": f(_EST, f(CAP_KG, "loadCapacity"))})
rawq("s28_is_placeholder", {"p": lambda: values.is_placeholder("motorPower"), "d": lambda: values.is_placeholder("dimensions"), "l": lambda: values.is_placeholder("loadCapacity")},
     {k: f"coalesce(trim({x}) = '' OR regexp_matches(trim({x}), '(?i)^not\\s*(specified|visible|available|applicable)|^n/?a$|^-$|^unknown$|^tbd$|^varies$|^see\\s+spec|^contact'), true)"
      for k, x in (("p", "motorPower"), ("d", "dimensions"), ("l", "loadCapacity"))})

_DSPEED = "coalesce(" + num("name", "(?i)" + NUM + r"\s*m/?(?:min|pm)") + ", " + num("name", "(?i)" + NUM + r"\s*mm/?(?:s|ps)") + ")"
_DSPEED_FIX = "coalesce(" + num("name", "(?i)" + NUM + r"\s*m/?(?:min|pm)") + ", round(" + num("name", "(?i)" + NUM + r"\s*mm/?(?:s|ps)") + " * 60 / 1000, 6))"
_DKG, _DFPM = num("name", "(?i)" + NUM + r"\s*kg"), num("name", "(?i)" + NUM + r"\s*fpm")


@query("s29_parse_device_name", dev(f"SELECT productId AS id, {_DKG} AS kg, {_DSPEED} AS mpm, {_DSPEED_FIX} AS mpm_fixed, {_DFPM} AS fpm FROM devices_raw"))
def s29(spark, sf):
    n, x = names.device_numbers("name"), names.device_numbers("name", "fixed")
    return inputs.raw_devices(spark, sf).select(
        c("productId").alias("id"), n["loadCapacityKg"].alias("kg"), n["liftingSpeedMpm"].alias("mpm"),
        x["liftingSpeedMpm"].alias("mpm_fixed"), n["liftingSpeedFpm"].alias("fpm"))


@query("s30_tuning_map", """SELECT event_id, CASE WHEN event_type = 'view' THEN value + 1 ELSE event_id END AS view_value, CAST(0 AS DOUBLE) AS bad,
  CAST(CASE WHEN event_type = 'view' THEN 2 ELSE 3 END AS INT) AS n FROM events""")
def s30(spark, sf):
    from ..operators.devices import tuning_map

    def item(name, value):
        return F.struct(name.alias("TuningParameterName"), value.alias("TuningParameterValue"))

    e = inputs.table(spark, sf, "events")
    arr = F.array(item(c("event_type"), c("value").cast("string")), item(F.lit("view"), c("event_id").cast("string")),
                  item(F.lit("bad"), F.lit("x")), item(F.lit(""), F.lit("1")), item(c("event_type"), (c("value") + 1).cast("string")))
    m = e.select("event_id", tuning_map(arr).alias("m"))
    return m.select("event_id", F.try_element_at("m", F.lit("view")).alias("view_value"), F.try_element_at("m", F.lit("bad")).alias("bad"), F.size("m").alias("n"))


@query("s31_num_or_null", dev("""SELECT productId AS id, nullif(TRY_CAST(minSpeedRaw AS DOUBLE), 0) AS lo, nullif(TRY_CAST(underloadRaw AS DOUBLE), 0) AS under,
  nullif(TRY_CAST(encoderRaw AS DOUBLE), 0) AS enc FROM devices_raw"""))
def s31(spark, sf):
    return inputs.raw_devices(spark, sf).select(
        c("productId").alias("id"), names.num_or_null("minSpeedRaw").alias("lo"), names.num_or_null("underloadRaw").alias("under"),
        names.num_or_null("encoderRaw").alias("enc"))


DEV_MODEL = (r"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(name, '^\[\d+-\d+\]\s*', ''), '(?i)\d+(?:\.\d+)?\s*kg.*$', '')), "
             r"'\s*-\s*\[.*\]$', ''), '\s+', ' ', 'g'))")
DEV_CATEGORY = ("CASE WHEN contains(lower(name), 'trolley') THEN 'Beam Trolley' WHEN contains(lower(name), 'winch') THEN 'Winch' "
                "WHEN contains(lower(name), 'revolve') OR contains(lower(name), 'turntable') OR contains(lower(name), 'rotator') THEN 'Revolve/Turntable' "
                "WHEN contains(lower(name), 'fly') THEN 'Flying System' ELSE 'Electric Chain Hoist' END")
DEV_LO, DEV_HI = "nullif(TRY_CAST(minSpeedRaw AS DOUBLE), 0)", "nullif(TRY_CAST(maxSpeedRaw AS DOUBLE), 0)"
DEV_SPEED = ("CASE WHEN regexp_matches(lower(name), 'varispeed|variable|varistar') THEN 'Variable Speed' "
             "WHEN regexp_matches(lower(name), 'fixed speed|fixspeed') THEN 'Fixed Speed' "
             f"WHEN {DEV_LO} IS NOT NULL AND {DEV_HI} IS NOT NULL AND {DEV_LO} <> {DEV_HI} THEN 'Variable Speed' ELSE 'Unknown' END")


@query("s32_search_terms", dev(f"SELECT productId AS id, {DEV_MODEL} AS model, 'V ' || {DEV_MODEL} || ' electric chain hoist specifications' AS q FROM devices_raw"))
def s32(spark, sf):
    return inputs.raw_devices(spark, sf).select(c("productId").alias("id"), names.model_from_name("name").alias("model"),
                                                names.search_query("name", F.lit("V")).alias("q"))


@query("s33_device_category", dev(f"SELECT productId AS id, {DEV_CATEGORY} AS category FROM devices_raw"))
def s33(spark, sf):
    return inputs.raw_devices(spark, sf).select(c("productId").alias("id"), names.device_category("name", names.model_from_name("name")).alias("category"))


@query("s34_speed_type", dev(f"SELECT productId AS id, {DEV_SPEED} AS speed_type FROM devices_raw"))
def s34(spark, sf):
    return inputs.raw_devices(spark, sf).select(c("productId").alias("id"), names.speed_type(
        "name", names.num_or_null("minSpeedRaw"), names.num_or_null("maxSpeedRaw")).alias("speed_type"))


ENT = " OR ".join(f"contains(lower({{0}}), '{n.lower()}')" for n in names.ENTERTAINMENT)


@query("s35_is_entertainment", dev(f"SELECT \"manufacturerId\" AS id, {f(ENT, 'coalesce(\"fullName\", chr(32))')} AS ent FROM makers"))
def s35(spark, sf):
    return inputs.makers(spark, sf).select(c("manufacturerId").alias("id"), names.is_entertainment("fullName").alias("ent"))


@query("s36_media_names", f"""WITH docs AS ({inputs.DOCS_SQL})
  SELECT filename, p[1] AS t_vendor, p[2] AS t_product, p[3] AS t_type, TRY_CAST(p[4] AS BIGINT) AS t_index,
    upper(substr(replace(p[1], '-', ' '), 1, 1)) || substr(replace(p[1], '-', ' '), 2) AS u_vendor, replace(p[2], '-', ' ') AS u_product,
    p[1] || '-' || p[2] AS doc_id, image_vendor, image_page
  FROM (SELECT filename, string_split(replace(filename, '.pdf', ''), '_') AS p,
          CASE _pos % 3 WHEN 0 THEN 'Kito' WHEN 1 THEN 'Demag' END AS image_vendor, CASE WHEN _pos % 3 < 2 THEN 'page' || CAST(_pos AS VARCHAR) END AS image_page FROM docs)""")
def s36(spark, sf):
    d = inputs.doc_files(spark, sf)
    img = F.concat(F.when(c("_pos") % 3 == 0, "kito").when(c("_pos") % 3 == 1, "demag").otherwise("nobody"), F.lit("_page"), c("_pos").cast("string"), F.lit("_0.jpg"))
    d = d.withColumns({"a": names.parse_media_name("filename"), "b": names.parse_media_name("filename", "titled"),
                       "e": names.parse_media_name("filename", "id"), "m": names.parse_media_name(img, "image")})
    return d.select("filename", c("a.vendor").alias("t_vendor"), c("a.product").alias("t_product"), c("a.type").alias("t_type"),
                    c("a.index").alias("t_index"), c("b.vendor").alias("u_vendor"), c("b.product").alias("u_product"),
                    c("e.product").alias("doc_id"), c("m.vendor").alias("image_vendor"), c("m.product").alias("image_page"))


MK = "regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g'), 'gmbh|ag|ltd|inc|llc|corp', '', 'g')"
rawq("s37_match_key", {"k": lambda: names.match_key("manufacturer"), "m": lambda: names.match_key("model")}, {"k": f(MK, "manufacturer"), "m": f(MK, "model")})


@query("s39_parse_llm_json", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 0 END AS strategy,
  CASE WHEN event_id % 7 < 4 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 7 = 4 THEN CAST(event_id AS VARCHAR) || ' kg' END AS cap FROM events""")
def s39(spark, sf):
    e = inputs.table(spark, sf, "events")
    n = c("event_id") % 7
    p = c("props")
    text = (F.when(n == 0, p).when(n == 1, F.concat(F.lit("Result:\n```json\n"), p, F.lit("\n```")))
            .when(n == 2, F.concat(F.lit("Here you are: "), p, F.lit(" done")))
            .when(n == 3, F.concat(F.lit("x {'k': "), F.get_json_object("props", "$.k"), F.lit(", } y")))
            .when(n == 4, F.concat(F.lit("SWL: "), c("event_id").cast("string"), F.lit(" kg")))
            .when(n == 5, F.lit("nothing here")).otherwise(F.lit("")))
    d = jsonrepair.parse_llm_json(e.select("event_id", text.alias("t")), "t")
    return d.select("event_id", c("parse_strategy").alias("strategy"), F.try_variant_get("parsed", "$.k", "bigint").alias("k"),
                    F.try_variant_get("parsed", "$.loadCapacity", "string").alias("cap"))


@query("s40_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def s40(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", content_hash("text").alias("h"))


rawq("s41_doc_type", {"t": lambda: web.doc_type(F.concat(F.lit("/x/"), F.when(c("_pos") % 4 == 0, "Datasheet.pdf").when(c("_pos") % 4 == 1, "spec.pdf").otherwise("a.pdf")),
                                                F.when(c("_pos") % 5 == 0, "User Manual").otherwise("click"))},
     {"t": "CASE WHEN _pos % 4 = 0 THEN 'datasheet' WHEN _pos % 5 = 0 THEN 'manual' WHEN _pos % 4 = 1 THEN 'specification' ELSE 'document' END"})


@query("s42_map_specs", raw("""SELECT id, CASE WHEN _pos % 2 = 0 THEN weight ELSE loadCapacity END AS cap, dutyCycle AS duty, liftingSpeed AS speed FROM raw"""))
def s42(spark, sf):
    r = inputs.raw_catalog(spark, sf)
    m = F.when(c("_pos") % 2 == 0, F.create_map(F.lit("capacity"), c("loadCapacity"), F.lit("lift speed"), c("liftingSpeed"), F.lit("rated load"), c("weight"), F.lit("duty"), c("dutyCycle"))
               ).otherwise(F.create_map(F.lit("max load"), c("weight"), F.lit("lifting speed"), c("liftingSpeed"), F.lit("swl"), c("loadCapacity"), F.lit("cycle"), c("dutyCycle")))
    p = r.select("id", mining.map_specs(m).alias("p"))
    return p.select("id", c("p.loadCapacity").alias("cap"), c("p.dutyCycle").alias("duty"), c("p.liftingSpeed").alias("speed"))


@query("s43_absolute_url", """SELECT page_id, o || '/a/b.pdf' AS root_link, regexp_extract(url, '^(https?):', 1) || '://cdn.example.org/x' AS scheme_link,
  regexp_replace(url, '#.*$', '') || '#top' AS frag_link, 'https://other.example.org/q' AS abs_link,
  o || folder || 'p' || page_id || '.pdf' AS relative_link, o || regexp_replace(folder, '[^/]+/$', '') || 'p' || page_id || '?v=' || page_id AS up_link,
  o || folder || 'x/y' AS dot_link, o || path || '?q=' || page_id AS query_link
  FROM (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path,
    regexp_replace(coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/'), '[^/]*$', '') AS folder FROM pages)""")
def s43(spark, sf):
    p = inputs.table(spark, sf, "pages")
    id_ = c("page_id").cast("string")
    a = lambda *h: web.absolute_url(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in h]), "url")
    return p.select("page_id", a("/a/b.pdf").alias("root_link"), a("//cdn.example.org/x").alias("scheme_link"), a("#top").alias("frag_link"),
                    a("https://other.example.org/q").alias("abs_link"), a("p", id_, ".pdf").alias("relative_link"), a("../p", id_, "?v=", id_).alias("up_link"),
                    a("./x/./z/../y").alias("dot_link"), a("?q=", id_).alias("query_link"))


@query("s46_has_product_content", "SELECT page_id, (" + " + ".join(
    f"contains(lower(html), '{w}')::INT" for w in web.PRODUCT_WORDS) + ") >= 3 AS ok FROM pages")
def s46(spark, sf):
    return inputs.table(spark, sf, "pages").select("page_id", web.has_product_content("html").alias("ok"))


rawq("s47_video_ref", {"kind": lambda: _video()["type"], "vid": lambda: _video()["id"], "url2": lambda: _video()["url"]},
     {"kind": "CASE _pos % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'vimeo' WHEN 2 THEN 'mp4' END",
      "vid": "CASE _pos % 4 WHEN 0 THEN lpad(CAST(_pos AS VARCHAR), 11, 'x') WHEN 1 THEN CAST(_pos AS VARCHAR) END",
      "url2": "CASE _pos % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || lpad(CAST(_pos AS VARCHAR), 11, 'x') WHEN 1 THEN 'https://vimeo.com/' || CAST(_pos AS VARCHAR) WHEN 2 THEN '/v/a.mp4' END"})


def _video():
    n, p = c("_pos") % 4, c("_pos").cast("string")
    return web.video_ref(F.when(n == 0, F.concat(F.lit("//www.youtube.com/embed/"), F.lpad(p, 11, "x")))
                         .when(n == 1, F.concat(F.lit("https://player.vimeo.com/video/"), p)).when(n == 2, "/v/a.mp4").otherwise("/x"))


_STRICT = "|".join(web.SKIP_IMAGE["strict"])
rawq("s48_skip_image", {"a": lambda: web.skip_image("url"), "b": lambda: web.skip_image("url", c("_pos") % 60, mode="small"), "c": lambda: web.skip_image("url", c("_pos") % 100, mode="page")},
     {"a": f"coalesce(regexp_matches(lower(url), '{_STRICT}') OR lower(url) LIKE '%.gif', false)",
      "b": "coalesce(regexp_matches(url, 'pixel|tracking|icon') OR (_pos % 60 > 0 AND _pos % 60 < 50), false)",
      "c": "coalesce(regexp_matches(url, 'pixel|tracking|icon|logo|avatar|placeholder') OR (_pos % 100 > 0 AND _pos % 100 < 80), false)"})
rawq("s49_url_key", {"k": lambda: web.url_key("url")}, {"k": "regexp_replace(lower(url), '/$', '')"})
rawq("s51_label_number", {"n": lambda: units.label_number("loadCapacity")}, {"n": f"CAST(coalesce({num('loadCapacity', r'([0-9]+)')}, 0) AS BIGINT)"})


@query("s52_truncate_text", """SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS t FROM documents""")
def s52(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", truncate_text("text", 500).alias("t"))


@query("s53_mime_type", f"""WITH docs AS ({inputs.DOCS_SQL}) SELECT filename, 'application/pdf' AS a, CASE WHEN _pos % 20 = 0 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS b FROM docs""")
def s53(spark, sf):
    d = inputs.doc_files(spark, sf)
    other = F.when(c("_pos") % 20 == 0, "/a/b.JPG").otherwise("/a.d/b")
    return d.select("filename", web.mime_type("filename").alias("a"), web.mime_type(other).alias("b"))


@query("s54_percent", """SELECT user_id, round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 1) AS pct,
  repeat('█', CAST(floor(0.5 + round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 1) / 5) AS INT))
    || repeat('░', 20 - CAST(floor(0.5 + round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 1) / 5) AS INT)) AS bar
  FROM events GROUP BY user_id""")
def s54(spark, sf):
    e = inputs.table(spark, sf, "events").groupBy("user_id").agg(F.count_if(c("event_type") == "view").alias("v"), F.count("*").alias("n"))
    return e.select("user_id", values.pct("v", "n").alias("pct"), values.pct_bar(values.pct("v", "n")).alias("bar"))
