"""Device records: numbers from names and attributes, classification, and conversion into catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import (device_category, device_numbers, is_entertainment, model_from_name, num_or_null,
                               search_query, speed_type)
from ..functions.text import c, js_number
from .linkage import with_brand, with_maker
from .tidy import pairs, with_zeros

# source field -> result field of the variable speed control block
VSC = {
    "MinSpeedClamp": "minSpeed", "MaxSpeedClamp": "maxSpeed", "MinAccelClamp": "minAccel", "MaxAccelClamp": "maxAccel",
    "MinDecelClamp": "minDecel", "MaxDecelClamp": "maxDecel", "ErrorStopClamp": "errorStop", "DefaultSpeed": "defaultSpeed",
    "DefaultAccel": "defaultAccel", "DefaultDecel": "defaultDecel",
}
LIMITS = {"UnderloadLimit": "underloadLimit", "OverloadLimit": "overloadLimit", "LoadcellScaling": "loadcellScaling",
          "EncoderScaling": "encoderScaling"}

DEVICE_CATEGORIES = ["Electric Chain Hoist", "Beam Trolley", "Winch", "Revolve/Turntable", "Flying System"]
DEVICE_SPEEDS = ["Variable Speed", "Fixed Speed", "Unknown"]


def tuning_map(arr) -> Column:
    """(name, value) elements -> map; unparsable values are 0, the last of equal names wins."""
    named = F.filter(c(arr), lambda p: F.coalesce(p["TuningParameterName"] != "", F.lit(False)))
    rev = F.reverse(named)
    names = F.transform(rev, lambda p: p["TuningParameterName"])
    # of equal names keep the last: the first one in reversed order
    last = F.reverse(F.filter(rev, lambda p, i: F.array_position(names, p["TuningParameterName"]) == i + 1))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(
        p["TuningParameterName"].alias("k"), F.coalesce(num_or_null(p["TuningParameterValue"]), F.lit(0.0)).alias("v"))))


def parse_devices(df: DataFrame, mode: str = "compat") -> DataFrame:
    """Add load and speed read from the name and, where the source columns exist, the numeric blocks."""
    n = device_numbers("name", mode)
    out = df.withColumns(n)
    text = lambda v, unit: F.when(F.col(v).isNotNull(), F.concat(js_number(v), F.lit(unit)))
    out = out.withColumns({"loadCapacity": text("loadCapacityKg", " kg"), "liftingSpeed": text("liftingSpeedMpm", " m/min")})
    vsc = [num_or_null(f"VariableSpeedControl.{k}").alias(v) for k, v in VSC.items()] if "VariableSpeedControl" in df.columns else []
    if vsc:
        out = out.withColumn("variableSpeedControl", F.struct(*vsc))  # takes the place of the text block
    limits = {v: num_or_null(k) for k, v in LIMITS.items() if k in df.columns}
    out = out.withColumns(limits) if limits else out
    return out.withColumn("tuningParameters", tuning_map("TuningParameter")) if "TuningParameter" in df.columns else out


def with_search_terms(df: DataFrame) -> DataFrame:
    """Model and web query per device; unknown vendors are searched as 'Unknown'."""
    mfr = F.when(c("manufacturerFullName").isNull(), "Unknown").otherwise(c("manufacturer"))
    return df.withColumns({"model": model_from_name("name"), "searchQuery": search_query("name", mfr)})


def search_queries(df: DataFrame) -> DataFrame:
    """Distinct queries with the position of their first device."""
    return df.groupBy("searchQuery").agg(F.min("_pos").alias("first_pos"))


def enrich_devices(df: DataFrame, makers: DataFrame | None = None, min_speed: str = "minSpeed", max_speed: str = "maxSpeed") -> DataFrame:
    """Vendor, search terms, category, speed type, entertainment flag, brand and website."""
    if makers is not None:
        df = with_search_terms(with_maker(df, makers))
    out = df.withColumns({"category": device_category("name", "model"), "speedType": speed_type("name", min_speed, max_speed),
                          "entertainmentIndustry": is_entertainment("manufacturer")})
    return with_brand(out)


def device_to_catalog(df: DataFrame, now=None) -> DataFrame:
    """Device rows as catalogue records."""
    st = F.replace(F.lower("speedType"), F.lit(" "), F.lit("-"))
    none = F.lit(None).cast("string")
    text = lambda t, n, unit: F.coalesce(c(t), F.when(F.coalesce(c(n) != 0, F.lit(False)), F.concat(js_number(n), F.lit(unit))))
    empty_map = F.create_map().cast("map<string,boolean>")
    fixed = {
        "motorPower": none, "scrapedFrom": F.lit("personality-xml"), "confidence": F.lit(0.95), "updateCount": F.lit(0),
        "quietOperation": F.lit(False), "source": F.lit("personality"),
        "controlCompatibility": empty_map, "certifications": empty_map,
    }
    cols = {
        "_pos": c("_pos"), "id": F.concat_ws("-", F.lit("personality"), "manufacturerId", "productId"),
        "personalityId": F.concat_ws("-", "manufacturerId", "productId"),
        "manufacturer": F.coalesce("manufacturerBrand", "manufacturer", F.lit("Unknown")),
        "model": F.coalesce(F.nullif(c("model"), F.lit("")), c("name")), "series": c("manufacturer"),
        "loadCapacity": text("loadCapacity", "loadCapacityKg", " kg"),
        "liftingSpeed": text("liftingSpeed", "liftingSpeedMpm", " m/min"),
        "classification": F.when(c("entertainmentIndustry"), F.array(F.lit("entertainment"), st)).otherwise(F.array(st)),
        "url": c("manufacturerWebsite"), "category": c("category"), "speedType": c("speedType"),
        "entertainmentIndustry": c("entertainmentIndustry"), "dynamicLifting": c("speedType") == "Variable Speed",
        "liftingOverPeople": F.coalesce("entertainmentIndustry", F.lit(False)),
        "positionFeedback": F.when(c("encoderScaling").isNotNull(), F.create_map(F.lit("encoder"), F.lit(True))).otherwise(empty_map),
        "personalityFileName": c("fileName"), "personalityName": c("name"),
    }
    optional = ["variableSpeedControl", "tuningParameters", "underloadLimit", "overloadLimit", "loadcellScaling",
                "encoderScaling", "liftingSpeedMpm", "liftingSpeedFpm", "loadCapacityKg", "images"]
    cols.update({x: c(x) for x in optional if x in df.columns})
    cols.update(fixed)
    if now is not None:
        t = F.lit(now).cast("timestamp")
        cols.update({"lastUpdated": t, "createdDate": t, "processedDate": t})
    return df.select(*[v.alias(k) for k, v in cols.items()])


def device_summary(df: DataFrame) -> DataFrame:
    """Totals, rows per category and speed type (zeros kept) and per vendor, as (section, key, n)."""
    p = pairs(df, {"category": c("category"), "speedType": c("speedType"), "manufacturer": c("manufacturer"),
                   "total": F.lit("products"), "flag": F.when(c("entertainmentIndustry"), "entertainment")}, "section", "key")
    n = p.groupBy("section", "key").agg(F.count("*").alias("n"))
    keys = ([("category", k) for k in DEVICE_CATEGORIES] + [("speedType", k) for k in DEVICE_SPEEDS]
            + [("total", "products"), ("flag", "entertainment")])
    fixed = with_zeros(n.filter("section != 'manufacturer'"), keys, ["section", "key"])
    vendors = n.filter("section = 'manufacturer'")
    count = vendors.agg(F.lit("total").alias("section"), F.lit("manufacturers").alias("key"), F.count("*").alias("n"))
    return fixed.unionByName(vendors).unionByName(count)


def _blank_number(x) -> Column:
    return F.coalesce(js_number(F.nullif(c(x).cast("double"), F.lit(0.0))), F.lit(""))


# fixed values: headers of the device reports
REPORT_COLUMNS = {
    "Manufacturer": "manufacturer", "Name": "name", "Model": "model", "Load Capacity (kg)": "loadCapacityKg",
    "Lifting Speed (m/min)": "liftingSpeedMpm", "Lifting Speed (fpm)": "liftingSpeedFpm", "Min Speed": "minSpeed",
    "Max Speed": "maxSpeed", "Default Speed": "defaultSpeed", "Default Accel": "defaultAccel",
    "Default Decel": "defaultDecel", "Underload Limit": "underloadLimit", "Overload Limit": "overloadLimit",
    "Encoder Scaling": "encoderScaling", "Loadcell Scaling": "loadcellScaling", "Search Query": "searchQuery",
}
ENRICHED_COLUMNS = {
    "Manufacturer": "manufacturer", "Brand": "manufacturerBrand", "Name": "name", "Model": "model", "Category": "category",
    "Speed Type": "speedType", "Entertainment Industry": "entertainmentIndustry", "Load Capacity (kg)": "loadCapacityKg",
    "Lifting Speed (m/min)": "liftingSpeedMpm", "Lifting Speed (fpm)": "liftingSpeedFpm", "Min Speed": "minSpeed",
    "Max Speed": "maxSpeed", "Default Speed": "defaultSpeed", "Underload Limit": "underloadLimit",
    "Overload Limit": "overloadLimit", "Encoder Scaling": "encoderScaling", "Website": "manufacturerWebsite",
    "Image URL": "imageUrl",
}


def _report(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    kinds = dict(df.dtypes)
    nested = {}
    if kinds.get("variableSpeedControl", "").startswith("struct"):
        nested = {n: F.col(f"variableSpeedControl.{n}") for n in df.schema["variableSpeedControl"].dataType.names}
    out = []
    for title, f in columns.items():
        if f == "imageUrl" and f not in kinds and "images" in kinds:
            v = F.coalesce(F.try_element_at("images", F.lit(1))["url"], F.lit(""))
        elif f not in kinds and f not in nested:
            v = F.lit("")
        elif kinds.get(f) == "boolean":
            v = F.when(c(f), "Yes").otherwise("No")
        elif kinds.get(f) == "string":
            v = F.coalesce(c(f), F.lit(""))
        else:
            v = _blank_number(nested.get(f, F.col(f) if f in kinds else None))
        out.append(v.alias(title))
    return df.select(*out)


def device_report(df: DataFrame) -> DataFrame:
    return _report(df, REPORT_COLUMNS)


def device_enriched_report(df: DataFrame) -> DataFrame:
    return _report(df, ENRICHED_COLUMNS)
