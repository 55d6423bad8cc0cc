"""Presence tests, scores, tiers and value normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CRITICAL, REQUIRED_SPECS, SECONDARY, kind
from .text import all_of, c, count_true, js_trim, lit_map, lookup, not_blank, truthy

# fixed values: classification aliases
CLASS_ALIASES = {
    "d8": ["d8", "bgv-d8", "bgvd8", "d8standard"],
    "d8+": ["d8+", "d8plus", "bgv-d8+", "bgvd8+", "bgv-d8plus"],
    "bgv-c1": ["bgv-c1", "bgvc1", "c1"],
    "ansi": ["ansi", "asme"],
}

# fixed values: vendor name aliases
VENDOR_ALIASES = {
    "Columbus McKinnon (CM)": "Columbus McKinnon",
    "CM": "Columbus McKinnon",
    "CM Lodestar": "Columbus McKinnon",
    "CM Works": "Columbus McKinnon",
    "Chainmaster GmbH": "Chainmaster",
    "Verlinde (Stagemaker)": "Verlinde",
    "Stagemaker": "Verlinde",
    "Movecat GmbH": "Movecat",
    "GIS AG Switzerland": "GIS AG",
}

# fixed values: vendor rules (vendor, model part, series to set, class to set when none is known), first match wins
VENDOR_RULES = [
    ("Columbus McKinnon", "Lodestar", "Lodestar", "d8"),
    ("Chainmaster", "D8+", None, "d8+"),
    ("Chainmaster", "D8", None, "d8"),
    ("Verlinde", "SR", "Stagemaker SR", None),
    ("Verlinde", "SL", "Stagemaker SL", None),
]

# fixed values: texts that mean "no value"
PLACEHOLDERS = [
    r"^not\s*(specified|visible|available|applicable)", r"^n/?a$", r"^-$", r"^unknown$", r"^tbd$", r"^varies$",
    r"^see\s+spec", r"^contact",
]


def normalize_classes(x, aliases: dict[str, list[str]] | None = None) -> Column:
    """Array of class names -> canonical, lower-case, distinct in order; empty array for NULL."""
    flat = {a: std for std, names in (aliases or CLASS_ALIASES).items() for a in names}
    table = lit_map(flat)
    kept = F.filter(c(x), lambda e: F.coalesce(e != "", F.lit(False)))
    names = F.transform(kept, lambda e: F.lower(js_trim(e)))
    return F.coalesce(
        F.array_distinct(F.transform(names, lambda e: F.coalesce(F.try_element_at(table, e), e))),
        F.array().cast("array<string>"))


def split_classes(x) -> Column:
    """Delimited class text -> raw array (NULL and '' give an empty array)."""
    return F.when(truthy(x), F.split(c(x), "[,;/]")).otherwise(F.array().cast("array<string>"))


def to_bool(x, kind: str = "text") -> Column:
    x = c(x)
    if kind == "bool":
        v = x
    elif kind == "number":
        v = x != 0
    else:
        v = F.lower(js_trim(x)).isin("yes", "true", "y", "1")
    return F.coalesce(v, F.lit(False))


def variant_to_bool(v) -> Column:
    """The same rule for a VARIANT value, dispatched on its stored type."""
    v = c(v)
    t = F.schema_of_variant(v)
    return (
        F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(t == "STRING", to_bool(F.try_variant_get(v, "$", "string")))
        .when(t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double") != 0)
        .otherwise(F.lit(False)))


def clean_manufacturer(x, aliases: dict[str, str] | None = None) -> Column:
    return F.coalesce(lookup(x, aliases or VENDOR_ALIASES), c(x), F.lit(""))


def clean_model(x) -> Column:
    x = c(x)
    for p in ("electric chain hoists?", "chain hoists?", "hoists?", "series"):
        x = F.regexp_replace(x, f"(?i){p}", "")
    return F.coalesce(js_trim(x), F.lit(""))


def is_placeholder(x) -> Column:
    t = js_trim(x)
    return F.coalesce((t == "") | t.rlike("(?i)" + "|".join(PLACEHOLDERS)), F.lit(True))


def has_value(x, rule: str = "a", kind: str = "text", display: str | None = None) -> Column:
    """Presence under one of four rules.

    a: NULL, blank, '-' and empty lists are missing; b: also empty maps; c: truthiness (blank-only text counts as
    present, 0 and false do not); d: display rule, 'Not specified' is missing too ('Not visible' for
    ``display`` = weight or dimensions).
    """
    x = c(x)
    if kind == "list":
        return F.coalesce(F.size(x) > 0, F.lit(False))
    if kind == "map":
        return F.coalesce(F.size(x) > 0, F.lit(False)) if rule == "b" else x.isNotNull()
    if kind == "number":
        return F.coalesce(x != 0, F.lit(False)) if rule in ("c", "d") else x.isNotNull()
    if kind == "bool":
        return F.coalesce(x, F.lit(False)) if rule in ("c", "d") else x.isNotNull()
    if rule in ("a", "b"):
        return F.coalesce((x != "-") & not_blank(x), F.lit(False))
    present = (x != "") & (x != "-")
    if rule == "d":
        present = present & (x != "Not specified")
        if display in ("weight", "dimensions"):
            present = present & (x != "Not visible")
    return F.coalesce(present, F.lit(False))


def _present(field: str, rule: str) -> Column:
    return has_value(field, rule, kind(field))


def completeness(rule: str = "a", critical=CRITICAL, secondary=SECONDARY) -> Column:
    """0-100 score, 70 % critical and 30 % secondary fields; rule b gives the unrounded 0-1 ratio."""
    crit = count_true([_present(f, rule) for f in critical]) / F.lit(float(len(critical)))
    sec = count_true([_present(f, rule) for f in secondary]) / F.lit(float(len(secondary)))
    if rule == "b":
        return crit * 0.7 + sec * 0.3
    return F.floor(crit * 70 + sec * 30 + 0.5).cast("int")


DISPLAY_FIELDS = ["loadCapacity", "liftingSpeed", "motorPower", "weight", "dimensions", "classification", "images",
                  "pdfs", "url"]


def display_presence(field: str) -> Column:
    """Presence on the detail page; a document counts whether linked or already downloaded."""
    if field == "pdfs":
        return has_value("pdfs", "c", "list") | has_value("downloadedPDFs", "c", "list")
    return has_value(field, "d" if field in ("weight", "dimensions") else "c", kind(field), field)


def display_completeness(fields=tuple(DISPLAY_FIELDS)) -> Column:
    n = count_true([display_presence(f) for f in fields])
    return F.floor(n * 100.0 / len(fields) + 0.5).cast("int")


def display_class(score) -> Column:
    s = c(score)
    return F.when(s >= 80, "high").when(s >= 50, "medium").otherwise("low")


def quality_tier(score) -> Column:
    s = F.coalesce(c(score), F.lit(0))
    return F.when(s >= 80, "complete").when(s >= 60, "partial").when(s >= 30, "incomplete").otherwise("minimal")


PRESENCE_FIELDS = ["loadCapacity", "liftingSpeed", "motorPower", "classification"]


def field_presence(present: bool = True, fields=tuple(PRESENCE_FIELDS)) -> Column:
    """Names of the fields that hold (or lack) a value."""
    return F.array_compact(F.array(*[
        F.when(_present(f, "a") if present else ~_present(f, "a"), F.lit(f)) for f in fields]))


def has_complete_specs(rule: str = "a") -> Column:
    return all_of([_present(f, rule) for f in REQUIRED_SPECS])


def ensure_array(x) -> Column:
    """Scalar text -> one-element list; NULL and '' stay NULL."""
    return F.when(truthy(x), F.array(c(x)))


def variant_array(v) -> Column:
    """VARIANT that is a list or a scalar -> ARRAY<STRING>."""
    v = c(v)
    return F.coalesce(F.try_variant_get(v, "$", "array<string>"),
                      ensure_array(F.try_variant_get(v, "$", "string")))


def ensure_map(m) -> Column:
    return F.coalesce(c(m), F.create_map().cast("map<string,string>"))


def vendor_series(manufacturer="manufacturer", model="model", series="series", rules=tuple(VENDOR_RULES)) -> Column:
    out = None
    for vendor, part, set_series, _ in rules:
        hit = (c(manufacturer) == vendor) & c(model).contains(part)
        val = F.lit(set_series) if set_series else c(series)
        out = F.when(hit, val) if out is None else out.when(hit, val)
    return out.otherwise(c(series))


def vendor_default_class(manufacturer="manufacturer", model="model", classes="classification",
                         rules=tuple(VENDOR_RULES)) -> Column:
    out = F.when(F.size(c(classes)) > 0, c(classes))
    for vendor, part, _, cls in rules:
        hit = (c(manufacturer) == vendor) & c(model).contains(part)
        out = out.when(hit, F.array(F.lit(cls)) if cls else c(classes))
    return out.otherwise(c(classes))


def apply_vendor_rules(df: DataFrame, rules=tuple(VENDOR_RULES)) -> DataFrame:
    return df.withColumns({"series": vendor_series(rules=rules),
                           "classification": vendor_default_class(rules=rules)})


def source_of(df: DataFrame) -> Column:
    """Keep a given source; else manual, llm_enriched, scraped or unknown by what the record carries."""
    col = lambda n, default: c(n) if n in df.columns else default
    no = F.lit(False)
    none = F.lit(None).cast("string")
    urls = [truthy(col(n, none)) for n in ("scrapedFrom", "sourceUrl", "url")]
    return (F.when(truthy(col("source", none)), col("source", none))
            .when(F.coalesce(col("_manuallyCreated", no), no), "manual")
            .when(F.coalesce(col("llmEnriched", no), no), "llm_enriched")
            .when(urls[0] | urls[1] | urls[2], "scraped")
            .otherwise("unknown"))


def source_url_of(df: DataFrame) -> Column:
    cols = [F.when(truthy(n), c(n)) for n in ("sourceUrl", "scrapedFrom", "url") if n in df.columns]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def pattern_ok(x, what: str) -> Column:
    return F.coalesce(c(x).rlike("(?i)" + FORMATS[what]), F.lit(False))


# fixed values: accepted text formats
FORMATS = {
    "loadCapacity": r"^\d+(?:\.\d+)?\s*(?:kg|lbs?|tons?|t|tonnes?)(?:\s*\([^)]+\))?$",
    "liftingSpeed": r"^\d+(?:\.\d+)?(?:\s*-\s*\d+(?:\.\d+)?)?\s*(?:m/min|ft/min|fpm|m/s)$",
    "motorPower": r"^\d+(?:\.\d+)?\s*(?:kW|HP|W)(?:\s*\([^)]+\))?$",
    "dutyCycle": r"^(?:FEM\s*\d+[a-z]*m?|M[1-8]|\d+%?\s*ED|H[1-4]|ISO\s*M[1-8]).*$",
    "protectionClass": r"^IP\d{2}[A-Z]?$",
    "voltage": r"^\d+V(?:\s*(?:1|3)ph)?(?:\s*\d+Hz)?$",
    "weight": r"^\d+(?:\.\d+)?\s*(?:kg|lbs?)$",
}


def estimate_power(kg) -> Column:
    """Typical motor power range for a capacity."""
    kg = c(kg)
    out = F.when(kg <= 0, F.lit(None).cast("string"))
    # fixed values: capacity limit in kg and power range
    for top, text in [(125, "0.18-0.25 kW"), (250, "0.25-0.37 kW"), (500, "0.37-0.75 kW"), (1000, "0.75-1.5 kW"),
                      (2000, "1.5-3.0 kW"), (5000, "3.0-7.5 kW"), (10000, "7.5-15 kW")]:
        out = out.when(kg <= top, text)
    return out.when(kg > 10000, "15+ kW")


def pct(part, whole) -> Column:
    return F.round(F.try_divide(c(part) * 100.0, c(whole).cast("double")), 1)


def pct_bar(p, width: int = 20) -> Column:
    n = F.floor(c(p) / 5 + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))
