"""Schema checks, quality gates, missing-data reports and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import c, truthy
from ..functions.values import completeness, has_value, pct
from ..schema import CRITICAL, SECONDARY, kind
from .facets import has_list
from .tidy import limited, lines, top_k

# fixed values: length limits of optional texts
MAX_LENGTH = {
    "series": 200, "chainFall": 50, "liftHeight": 100, "dimensions": 200, "brakeType": 200, "chainSpecification": 200,
    "controlType": 200, "noiseLevel": 50, "operatingTemperature": 100, "warranty": 200,
}
SPEED_TYPES = ["Variable Speed", "Fixed Speed", "Unknown", ""]
SOURCES = ["scraped", "personality", "manual", "merged"]
NOT_NULL_TEXT = ["loadCapacity", "liftingSpeed", "motorPower", "dutyCycle", "protectionClass", "weight"]
URI = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:\S+$"


# fixed values: element types of media lists
MEDIA_TYPES = {"images": ["product", "diagram", "detail", "logo"], "pdfs": ["datasheet", "manual", "brochure", "certificate", "document"]}
MEDIA_TYPES["downloadedPDFs"] = MEDIA_TYPES["pdfs"]

# fixed values: message per rule type
MESSAGES = {
    "any.required": "is required", "string.empty": "is not allowed to be empty", "string.max": "length must be less than or equal to {0} characters long",
    "string.base": "must be a string", "string.uri": "must be a valid uri", "any.only": "must be one of [{0}]", "number.min": "must be greater than or equal to {0}",
    "number.max": "must be less than or equal to {0}", "alternatives.types": "must be one of [string]",
}


def _error(field, rule: str, limit="") -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(name.alias("field"), F.lit(rule).alias("type"),
                    F.concat(F.lit('"'), name, F.lit('" ' + MESSAGES[rule].format(limit))).alias("message"))


def _of_no_type(types: list[str]):
    return lambda m: ~m["type"].isin("", *types)


def _elements(column: str, bad, field, rule: str, limit="") -> Column:
    """An error per element that fails, named by its place."""
    found = F.filter(F.transform(c(column), lambda x, i: F.struct(bad(x).alias("bad"), i.cast("string").alias("i"))), lambda x: F.coalesce(x["bad"], F.lit(False)))
    return F.transform(found, lambda x: _error(F.concat(F.lit(column + "."), x["i"], F.lit(field)), rule, limit))


def schema_errors(df: DataFrame, out: str = "errors", null_is_error: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Add an array of (field, type, message) for every violated rule; elements of lists are named by their place.

    A column read from a table cannot tell an absent key from an explicit null. Fields listed in ``null_is_error`` treat NULL as an
    explicit null, which the record schema rejects; with ``strict`` every declared field is required.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    checks: list[Column] = []
    add = lambda bad, field, rule, limit="": checks.append(F.when(bad, F.array(_error(field, rule, limit))))
    for f in ("id", "manufacturer", "model"):
        add(c(f).isNull(), f, "any.required")
        add(c(f) == "", f, "string.empty")
        add(F.length(f) > 200, f, "string.max", 200)
    for f, n in MAX_LENGTH.items():
        if f in kinds:
            add(F.length(f) > n, f, "string.max", n)
    for f in null_is_error:
        add(c(f).isNull(), f, "alternatives.types" if f in NOT_NULL_TEXT else "string.base")
    for f in ("url", "datasheet"):
        if f in kinds:
            add((c(f) != "") & ~c(f).rlike(URI), f, "string.uri")
    for f, allowed in (("speedType", SPEED_TYPES), ("source", SOURCES)):
        if f in kinds:
            add(~c(f).isin(*allowed), f, "any.only", ", ".join(allowed))
    for f, types in MEDIA_TYPES.items():
        if f in kinds:
            checks.append(_elements(f, lambda m: F.coalesce(m["url"], F.lit("")) == "", ".url", "any.required"))
            if "type" in kinds[f].elementType.fieldNames():
                checks.append(_elements(f, _of_no_type(types), ".type", "any.only", ", ".join(types)))
    if "manualSources" in kinds:
        checks.append(_elements("manualSources", lambda x: ~x.rlike(URI), "", "string.uri"))
    if isinstance(kinds.get("variableSpeedControl"), T.StructType):  # its fields are texts; another type is an error where it has a value
        for f in kinds["variableSpeedControl"].fields:
            if not isinstance(f.dataType, T.StringType):
                add(c(f"variableSpeedControl.{f.name}").isNotNull(), f"variableSpeedControl.{f.name}", "string.base")
    for f, lo, hi in (("capacityKg", 0, None), ("speedMMin", 0, None), ("dataCompleteness", 0, 100)):
        if f in kinds:
            add(c(f) < lo, f, "number.min", lo)
            if hi is not None:
                add(c(f) > hi, f, "number.max", hi)
    if strict:
        for f in kinds:
            if not f.startswith("_") and f not in ("id", "manufacturer", "model", "extras"):
                add(c(f).isNull(), f, "any.required")
    none = F.array().cast("array<struct<field:string,type:string,message:string>>")
    return df.withColumn(out, F.flatten(F.array(*[F.coalesce(x, none) for x in checks])))


def _missing(f: str, how: str) -> Column:
    if kind(f) == "list":
        return ~has_list(f)
    return ~has_value(f, how)


def _gate_rows(row: DataFrame, gates: list[tuple[str, float, str, Column]]) -> DataFrame:
    """(gate, threshold, actual, passed) per gate; an undefined share (no rows) fails."""
    out = []
    for name, limit, sense, actual in gates:
        ok = actual >= limit if sense == ">=" else actual <= limit
        out.append({"gate": F.lit(name), "threshold": F.lit(float(limit)), "actual": F.round(actual.cast("double"), 6),
                    "passed": F.coalesce(ok, F.lit(False))})
    return lines(row, out)


PROCESSOR_LIMITS = {"minRecords": 10, "loadCapacity": 80, "liftingSpeed": 85, "motorPower": 95, "classification": 50,
                    "minSourceTracking": 90}


def processor_gates(df: DataFrame, **limits) -> DataFrame:
    lim = {**PROCESSOR_LIMITS, **limits}
    fields = ["loadCapacity", "liftingSpeed", "motorPower", "classification"]
    row = df.agg(F.count("*").alias("n"), *[F.count_if(_missing(f, "a")).alias(f) for f in fields],
                 F.count_if(truthy("source") & (c("source") != "unknown")).alias("src"))
    share = lambda x: F.try_divide(F.col(x) * 100.0, F.col("n"))
    return _gate_rows(row, [("Minimum Records", lim["minRecords"], ">=", F.col("n"))]
                      + [(f"Missing {f}", lim[f], "<=", share(f)) for f in fields]
                      + [("Source Tracking", lim["minSourceTracking"], ">=", share("src"))])


SCHEMA_LIMITS = {"minTotalRecords": 10, "maxInvalidPercent": 5, "loadCapacity": 80, "liftingSpeed": 85,
                 "motorPower": 95, "classification": 50, "images": 60}
SUMMARY_FIELDS = ["loadCapacity", "liftingSpeed", "motorPower", "classification", "dutyCycle", "images"]


def _validated(df: DataFrame) -> DataFrame:
    checked = schema_errors(df)
    return checked.agg(F.count("*").alias("n"), F.count_if(F.size("errors") > 0).alias("invalid"),
                       *[F.count_if(_missing(f, "c")).alias(f) for f in SUMMARY_FIELDS])


def schema_gates(df: DataFrame, **limits) -> DataFrame:
    lim = {**SCHEMA_LIMITS, **limits}
    share = lambda x: F.try_divide(F.col(x) * 100.0, F.col("n"))
    return _gate_rows(_validated(df), [("Minimum Records", lim["minTotalRecords"], ">=", F.col("n")),
                                       ("Schema Validity", lim["maxInvalidPercent"], "<=", share("invalid"))]
                      + [(f"Missing {f}", lim[f], "<=", share(f)) for f in
                         ("loadCapacity", "liftingSpeed", "motorPower", "classification", "images")])


def validation_summary(df: DataFrame) -> DataFrame:
    row = _validated(df)
    one = lambda k, v: {"item": F.lit(k), "n": v, "pct": pct(v, F.col("n"))}
    return lines(row, [one("total", F.col("n")), one("valid", F.col("n") - F.col("invalid")), one("invalid", F.col("invalid"))]
                 + [one(f"missing {f}", F.col(f)) for f in SUMMARY_FIELDS])


def validation_errors(df: DataFrame, k: int | None = None) -> DataFrame:
    """Invalid rows with their violations; with k the first k by position."""
    out = schema_errors(df).filter(F.size("errors") > 0)
    return out if k is None else out.orderBy("_pos").limit(k)


# fixed values: release thresholds per gate
RELEASE_GATES = {
    "alpha": {"loadCapacity": 0.50, "liftingSpeed": 0.40, "motorPower": 0.30, "classification": 0.40, "images": 0.30,
              "overallCompleteness": 0.35},
    "beta": {"loadCapacity": 0.80, "liftingSpeed": 0.70, "motorPower": 0.60, "classification": 0.60, "images": 0.50,
             "overallCompleteness": 0.60},
    "release": {"loadCapacity": 0.95, "liftingSpeed": 0.95, "motorPower": 0.90, "classification": 0.85, "images": 0.80,
                "overallCompleteness": 0.85},
}
COVERAGE_FIELDS = CRITICAL + SECONDARY + ["images"]


def _present_b(f: str) -> Column:
    return has_list(f) if kind(f) == "list" else has_value(f, "b", kind(f))


def field_coverage(df: DataFrame) -> DataFrame:
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(_present_b(f)).alias(f) for f in COVERAGE_FIELDS])
    return lines(row, [{"field": F.lit(f), "count": F.col(f), "total": F.col("_n"),
                        "percentage": F.coalesce(F.try_divide(F.col(f).cast("double"), F.col("_n")), F.lit(0.0))}
                       for f in COVERAGE_FIELDS])


def release_gates(df: DataFrame, target: str | None = None, gates: dict | None = None) -> DataFrame:
    """Every check of every gate with actual, delta and verdict, plus the verdict of the whole gate."""
    gates = gates or RELEASE_GATES
    if target and target not in gates:
        raise ValueError(f"unknown gate {target}")
    fields = sorted({f for g in gates.values() for f in g} - {"overallCompleteness"})
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(_present_b(f)).alias(f) for f in fields],
                 F.avg(completeness("b")).alias("overallCompleteness"))
    checks = []
    for g, limits in gates.items():
        if target and g != target:
            continue
        actual = {f: (F.col(f) if f == "overallCompleteness" else F.try_divide(F.col(f).cast("double"), F.col("_n")))
                  for f in limits}
        # a rounding step below the last printed digit keeps the verdict independent of summation order
        exact = {f: F.round(F.coalesce(a, F.lit(0.0)), 9) for f, a in actual.items()}
        whole = F.lit(True)
        for f, t in limits.items():
            whole = whole & (exact[f] >= t)
        checks += [{"gate": F.lit(g), "field": F.lit(f), "threshold": F.lit(t), "actual": F.round(exact[f], 6),
                    "delta": F.round(exact[f] - t, 6), "passed": exact[f] >= t, "gate_passed": whole}
                   for f, t in limits.items()]
    return lines(row, checks)


def _lacking() -> Column:
    return F.array_compact(F.array(*[F.when(~_present_b(f), F.lit(f)) for f in CRITICAL + ["images"]]))


def incomplete(df: DataFrame, k: int | None = None) -> DataFrame:
    """Rows lacking critical fields or images; with k the k most incomplete ones."""
    out = (df.withColumn("missing", _lacking()).filter(F.size("missing") > 0)
           .select("_pos", "id", "manufacturer", "model", "missing", F.round(completeness("b"), 6).alias("completeness")))
    return out if k is None else out.orderBy(F.size("missing").desc(), "_pos").limit(k)


def recommend(df: DataFrame, vendors: int | None = None) -> DataFrame:
    """Fields below 80 % coverage (high priority below 50 %), then the vendors with most incomplete rows."""
    p = F.col("percentage")
    fields = (field_coverage(df).filter(p < 0.8)
              .select(F.when(p < 0.5, "high").otherwise("medium").alias("priority"), "field",
                      F.round(p * 100, 1).alias("current"), (F.col("total") - F.col("count")).alias("missing")))
    worst = (df.filter(F.size(_lacking()) > 0).groupBy("manufacturer").agg(F.count("*").alias("missing"))
             .orderBy(F.col("missing").desc(), "manufacturer"))
    worst = (limited(worst, vendors)
             .select(F.lit("high").alias("priority"), F.concat(F.lit("vendor:"), F.col("manufacturer")).alias("field"),
                     F.lit(None).cast("double").alias("current"), "missing"))
    return fields.unionByName(worst)


def missing_fields(df: DataFrame, threshold: float = 0.4, columns: list[str] | None = None) -> DataFrame:
    """Share of NULL or '' per column, for columns at or above the threshold; one pass for all columns."""
    kinds = dict(df.dtypes)
    cols = columns or [x for x in df.columns if not x.startswith("_")]
    empty = lambda f: (c(f).isNull() | (c(f) == "")) if kinds[f] == "string" else c(f).isNull()
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(empty(f)).alias(f) for f in cols])
    out = lines(row, [{"field": F.lit(f), "count": F.col(f), "share": F.try_divide(F.col(f).cast("double"), F.col("_n"))}
                      for f in cols])
    return out.filter(F.col("share") >= threshold).select("field", "count", F.round(F.col("share") * 100, 1).alias("pct"))


def missing_by_vendor(df: DataFrame, k: int | None = None) -> DataFrame:
    """Five fields: how many rows lack each, and the vendors that lack it, most first (with k the first k)."""
    gaps = {f: (~truthy(f) if kind(f) == "text" else ~has_list(f))
            for f in ("loadCapacity", "liftingSpeed", "images", "pdfs", "classification")}
    per = df.groupBy("manufacturer").agg(*[F.count_if(g).alias(f) for f, g in gaps.items()])
    long = lines(per, [{"field": F.lit(f), "n": F.col(f)} for f in gaps], ["manufacturer"]).filter("n > 0")
    total = long.groupBy("field").agg(F.sum("n").alias("missing"))
    return top_k(long, ["field"], [F.col("n").desc(), F.col("manufacturer")], k).join(F.broadcast(total), "field")
