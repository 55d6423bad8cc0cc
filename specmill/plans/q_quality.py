"""Quality gates, schema checks and missing-data reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..functions.text import c
from ..operators import quality
from .oracle import cat
from .q_records import catalog
from .registry import query

_MISS = {"loadCapacity": "NOT has_cap", "liftingSpeed": "NOT has_speed", "motorPower": "NOT has_power", "classification": "NOT has_cls",
         "dutyCycle": "NOT has_duty", "images": "n_images = 0"}


def gate(name, limit, actual, op):
    return f"SELECT '{name}' AS gate, CAST({limit} AS DOUBLE) AS threshold, round(CAST({actual} AS DOUBLE), 6) AS actual, {actual} {op} {limit} AS passed FROM catalog"


def share(cond):
    return f"(count(*) FILTER ({cond}) * 100.0 / count(*))"


@query("a12_processor_gates", cat(" UNION ALL ".join(
    [gate("Minimum Records", 10, "count(*)", ">=")]
    + [gate(f"Missing {k}", lim, share(_MISS[k]), "<=") for k, lim in (("loadCapacity", 80), ("liftingSpeed", 85), ("motorPower", 95), ("classification", 50))]
    + [gate("Source Tracking", 90, share("coalesce(source, '') NOT IN ('', 'unknown')"), ">=")])))
def a12(spark, sf):
    return quality.processor_gates(catalog(spark, sf))


_URI = r"url <> '' AND NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*:\S+$')"
_BAD = {"id": "len(id) > 200", "model": "coalesce(model, '') = '' OR len(model) > 200", "url": _URI,
        "speedType": "speedType NOT IN ('Variable Speed', 'Fixed Speed', 'Unknown', '')", "source": "source NOT IN ('scraped', 'personality', 'manual', 'merged')"}
_MESSAGE = {"id": "'\"id\" length must be less than or equal to 200 characters long'", "model": "CASE WHEN model IS NULL THEN '\"model\" is required' WHEN model = '' THEN '\"model\" is not allowed to be empty' ELSE '\"model\" length must be less than or equal to 200 characters long' END",
            "url": "'\"url\" must be a valid uri'", "speedType": "'\"speedType\" must be one of [Variable Speed, Fixed Speed, Unknown, ]'", "source": "'\"source\" must be one of [scraped, personality, manual, merged]'"}
_INVALID = "(" + " OR ".join(f"coalesce({v}, false)" for v in _BAD.values()) + ")"


@query("f21_schema_errors", cat(" UNION ALL ".join(f"SELECT id, '{k}' AS field, {_MESSAGE[k]} AS message FROM catalog WHERE {v}" for k, v in _BAD.items())))
def f21(spark, sf):
    return quality.schema_errors(catalog(spark, sf)).select("id", F.explode("errors").alias("e")).select("id", c("e.field").alias("field"), c("e.message").alias("message"))


# fixed values: the field formats, as the rules state them
_FMT = {"loadCapacity": r"^\d+(?:\.\d+)?\s*(?:kg|lbs?|tons?|t|tonnes?)(?:\s*\([^)]+\))?$",
        "liftingSpeed": r"^\d+(?:\.\d+)?(?:\s*-\s*\d+(?:\.\d+)?)?\s*(?:m/min|ft/min|fpm|m/s)$",
        "motorPower": r"^\d+(?:\.\d+)?\s*(?:kW|HP|W)(?:\s*\([^)]+\))?$", "dutyCycle": r"^(?:FEM\s*\d+[a-z]*m?|M[1-8]|\d+%?\s*ED|H[1-4]|ISO\s*M[1-8]).*$",
        "protectionClass": r"^IP\d{2}[A-Z]?$", "voltage": r"^\d+V(?:\s*(?:1|3)ph)?(?:\s*\d+Hz)?$", "weight": r"^\d+(?:\.\d+)?\s*(?:kg|lbs?)$"}


@query("f22_pattern_ok", cat("SELECT id, " + ", ".join(f"coalesce(regexp_matches({'voltage_raw' if k == 'voltage' else k}, '(?i){p}'), false) AS {k}" for k, p in _FMT.items()) + " FROM catalog"))
def f22(spark, sf):
    return catalog(spark, sf).select("id", *[values.pattern_ok(F.try_element_at("voltageOptions", F.lit(1)) if k == "voltage" else k, k).alias(k) for k in values.FORMATS])


@query("a13_validation_summary", cat(" UNION ALL ".join(
    f"SELECT '{n}' AS item, count(*) FILTER ({v}) AS n, round(count(*) FILTER ({v}) * 100.0 / count(*), 1) AS pct FROM catalog"
    for n, v in [("total", "true"), ("valid", f"NOT {_INVALID}"), ("invalid", _INVALID)] + [(f"missing {k}", _MISS[k] if k != "liftingSpeed" else "coalesce(liftingSpeed, '') IN ('', '-')") for k in quality.SUMMARY_FIELDS])))
def a13(spark, sf):
    return quality.validation_summary(catalog(spark, sf))


@query("a13_validation_errors", cat(f"SELECT id, model FROM catalog WHERE {_INVALID} "))
def a13_errors(spark, sf):
    return quality.validation_errors(catalog(spark, sf)).select("id", "model")


@query("a14_schema_gates", cat(" UNION ALL ".join(
    [gate("Minimum Records", 10, "count(*)", ">="), gate("Schema Validity", 5, share(_INVALID), "<=")]
    + [gate(f"Missing {k}", lim, share(_MISS[k]), "<=") for k, lim in (("loadCapacity", 80), ("liftingSpeed", 85), ("motorPower", 95), ("classification", 50), ("images", 60))])))
def a14(spark, sf):
    return quality.schema_gates(catalog(spark, sf))


_HAVE = {"loadCapacity": "has_cap", "liftingSpeed": "has_speed", "motorPower": "has_power", "classification": "has_cls", "dutyCycle": "has_duty",
         "voltageOptions": "has_volt", "weight": "has_weight", "protectionClass": "has_ip", "series": "has_series", "images": "n_images > 0"}
_RATIO = ("(0.7 * (has_cap::INT + has_speed::INT + has_power::INT + has_cls::INT + has_duty::INT) / 5 + 0.3 * (has_volt::INT + has_weight::INT + has_ip::INT + has_series::INT) / 4)")


def _gate_sql():
    out = []
    for g, limits in quality.RELEASE_GATES.items():
        act = {k: (f"round((SELECT avg({_RATIO}) FROM catalog), 9)" if k == "overallCompleteness" else f"round((SELECT avg(({_HAVE[k]})::INT) FROM catalog), 9)") for k in limits}
        whole = " AND ".join(f"{act[k]} >= {t}" for k, t in limits.items())
        out += [f"SELECT '{g}' AS gate, '{k}' AS field, CAST({t} AS DOUBLE) AS threshold, round({act[k]}, 6) AS actual, round({act[k]} - {t}, 6) AS delta, {act[k]} >= {t} AS passed, {whole} AS gate_passed"
                for k, t in limits.items()]
    return " UNION ALL ".join(out)


@query("a15_release_gates", cat(_gate_sql()))
def a15(spark, sf):
    return quality.release_gates(catalog(spark, sf))


@query("a15_field_coverage", cat(" UNION ALL ".join(f"SELECT '{k}' AS field, count(*) FILTER ({v}) AS count, count(*) AS total, round(avg(({v})::INT), 9) AS percentage FROM catalog" for k, v in _HAVE.items())))
def a15_coverage(spark, sf):
    return quality.field_coverage(catalog(spark, sf)).withColumn("percentage", F.round("percentage", 9))


_LACK = "concat_ws('|', " + ", ".join(f"CASE WHEN NOT ({_HAVE[k]}) THEN '{k}' END" for k in ("loadCapacity", "liftingSpeed", "motorPower", "classification", "dutyCycle", "images")) + ")"


@query("a16_incomplete", cat(f"""SELECT id, missing, completeness FROM (SELECT id, _pos, {_LACK} AS missing, round({_RATIO}, 6) AS completeness FROM catalog)
  WHERE missing <> '' """))
def a16(spark, sf):
    return quality.incomplete(catalog(spark, sf)).select("id", F.array_join("missing", "|").alias("missing"), "completeness")


@query("a17_recommend", cat("SELECT CASE WHEN p < 0.5 THEN 'high' ELSE 'medium' END AS priority, field, round(p * 100, 1) AS current, missing FROM cov WHERE p < 0.8 UNION ALL "
  f"SELECT 'high', 'vendor:' || manufacturer, NULL, n FROM (SELECT manufacturer, count(*) AS n FROM catalog WHERE {_LACK} <> '' GROUP BY manufacturer )",
  "cov AS (" + " UNION ALL ".join(f"SELECT '{k}' AS field, avg(({v})::INT) AS p, count(*) FILTER (NOT ({v})) AS missing FROM catalog" for k, v in _HAVE.items()) + ")"))
def a17(spark, sf):
    return quality.recommend(catalog(spark, sf))


_COLS = {"series": "t", "loadCapacity": "t", "liftingSpeed": "t", "motorPower": "t", "dutyCycle": "t", "weight": "t", "dimensions": "t", "protectionClass": "t",
         "url": "t", "category": "t", "speedType": "t", "confidence": "n", "capacityKg": "n", "speedMMin": "n", "lastUpdated": "n"}


@query("a11_missing_fields", cat("SELECT field, count, round(s * 100, 1) AS pct FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS field, count(*) FILTER ({k} IS NULL{' OR ' + k + chr(61) + chr(39) * 2 if t == 't' else ''}) AS count, "
    f"count(*) FILTER ({k} IS NULL{' OR ' + k + chr(61) + chr(39) * 2 if t == 't' else ''}) * 1.0 / count(*) AS s FROM catalog" for k, t in _COLS.items()) + ") WHERE s >= 0.4"))
def a11(spark, sf):
    return quality.missing_fields(catalog(spark, sf), columns=list(_COLS))


_GAP = {"loadCapacity": "coalesce(loadCapacity, '') = ''", "liftingSpeed": "coalesce(liftingSpeed, '') = ''", "images": "n_images = 0", "pdfs": "n_pdfs = 0", "classification": "len(cls) = 0"}


@query("a21_missing_by_vendor", cat("""SELECT field, manufacturer, n, CAST(rank AS INT) AS rank, missing FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, manufacturer) AS rank,
  CAST(sum(n) OVER (PARTITION BY field) AS BIGINT) AS missing FROM g) WHERE rank <= 5""",
  "g AS (" + " UNION ALL ".join(f"SELECT '{k}' AS field, manufacturer, count(*) AS n FROM catalog WHERE {v} GROUP BY manufacturer" for k, v in _GAP.items()) + ")"))
def a21(spark, sf):
    return quality.missing_by_vendor(catalog(spark, sf), 5)
