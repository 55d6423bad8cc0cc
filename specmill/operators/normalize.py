"""Record processing: raw catalogue rows to normalised, scored and tiered rows in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units, values
from ..functions.text import truthy
from ..schema import LIST_FIELDS, MAP_FIELDS

FLAGS = ["quietOperation", "dynamicLifting", "liftingOverPeople"]


def process_catalog(df: DataFrame, vendor_aliases=None, class_aliases=None, vendor_rules=None) -> DataFrame:
    """Drop rows without vendor or model, then clean, parse, score and classify the rest. No shuffle."""
    out = df.filter(truthy("model") & truthy("manufacturer"))
    kinds = dict(out.dtypes)
    # numbers and units are parsed once, in a projection of their own, and used several times by the next
    out = out.withColumns({"_cap": units.measure("loadCapacity"), "_spd": units.measure("liftingSpeed", units.SPEED_UNIT),
                           "_pow": units.measure("motorPower")})
    fix = {
        "manufacturer": values.clean_manufacturer("manufacturer", vendor_aliases),
        "model": values.clean_model("model"),
        "loadCapacity": units.normalize_capacity("loadCapacity", "_cap"),
        "liftingSpeed": units.normalize_speed("liftingSpeed", "_spd"),
        "motorPower": units.normalize_power("motorPower", "_pow"),
    }
    classes = "classification"
    raw = F.col(classes) if kinds[classes].startswith("array") else values.split_classes(classes)
    fix[classes] = values.normalize_classes(raw, class_aliases)
    for f in FLAGS:
        if f in kinds:
            fix[f] = values.to_bool(f, "bool" if kinds[f] == "boolean" else "text")
    for f in LIST_FIELDS[1:]:
        if f in kinds and kinds[f] == "string":
            fix[f] = values.ensure_array(f)
    for f in MAP_FIELDS[:3]:
        if f in kinds:
            fix[f] = values.ensure_map(f)
    out = out.withColumns(fix).drop("_cap", "_spd", "_pow")
    out = values.apply_vendor_rules(out, *([tuple(vendor_rules)] if vendor_rules else []))
    return score(out)


def score(df: DataFrame) -> DataFrame:
    """(Re)compute everything derived from the normalised fields."""
    out = df.withColumns({
        "capacityKg": units.capacity_kg("loadCapacity"),
        "speedMMin": units.speed_mpm("liftingSpeed"),
        "dataCompleteness": values.completeness("a"),
        "hasCompleteSpecs": values.has_complete_specs("a"),
        "source": values.source_of(df),
        "sourceUrl": values.source_url_of(df),
    })
    return out.withColumns({
        "dataQualityTier": values.quality_tier("dataCompleteness"),
        "populatedFields": values.field_presence(True),
        "missingFields": values.field_presence(False),
    })
