"""The catalogue record: fixed columns plus an open ``extras`` map, and the field groups rules refer to."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, B = T.StringType(), T.DoubleType(), T.BooleanType()
STRS = T.ArrayType(S)
SMAP = T.MapType(S, S)
IMAGE = T.StructType([T.StructField(n, S) for n in ("url", "alt", "type", "localPath", "title")])
DOC = T.StructType([T.StructField(n, S) for n in ("url", "title", "type", "localPath")])
VIDEO = T.StructType([T.StructField(n, S) for n in ("type", "url", "embed", "id")])

TEXT_FIELDS = [
    "id", "manufacturer", "model", "series", "loadCapacity", "liftingSpeed", "motorPower", "dutyCycle", "weight",
    "dimensions", "protectionClass", "chainFall", "liftHeight", "brakeType", "chainSpecification", "controlType",
    "noiseLevel", "operatingTemperature", "warranty", "url", "datasheet", "sourceUrl", "scrapedFrom", "source",
    "category", "speedType", "description", "productType",
]
LIST_FIELDS = ["classification", "voltageOptions", "bodyColor", "commonApplications", "additionalSafety"]
MAP_FIELDS = ["controlCompatibility", "positionFeedback", "certifications", "supportInfo", "safetyFeatures"]
BOOL_FIELDS = ["quietOperation", "dynamicLifting", "liftingOverPeople", "entertainmentIndustry", "hasCompleteSpecs",
               "llmEnriched"]
MEDIA_FIELDS = {"images": IMAGE, "pdfs": DOC, "downloadedPDFs": DOC, "videos": VIDEO}
DATE_FIELDS = ["lastUpdated", "createdDate", "processedDate"]

CATALOG = T.StructType(
    [T.StructField("_pos", T.LongType())]
    + [T.StructField(n, S) for n in TEXT_FIELDS]
    + [T.StructField(n, STRS) for n in LIST_FIELDS]
    + [T.StructField(n, SMAP) for n in MAP_FIELDS]
    + [T.StructField(n, B) for n in BOOL_FIELDS]
    + [T.StructField(n, T.ArrayType(t)) for n, t in MEDIA_FIELDS.items()]
    + [T.StructField("price", T.StructType([T.StructField("value", D), T.StructField("currency", S)])),
       T.StructField("rentalRate", T.StructType([T.StructField("daily", D), T.StructField("weekly", D)]))]
    + [T.StructField(n, D) for n in ("confidence", "capacityKg", "speedMMin", "dataCompleteness")]
    + [T.StructField("dataQualityTier", S)]
    + [T.StructField(n, T.TimestampType()) for n in DATE_FIELDS]
    + [T.StructField("extras", SMAP)]
)

CRITICAL = ["loadCapacity", "liftingSpeed", "motorPower", "classification", "dutyCycle"]
SECONDARY = ["voltageOptions", "weight", "protectionClass", "series"]
REQUIRED_SPECS = ["loadCapacity", "liftingSpeed", "motorPower"]
TIERS = ["complete", "partial", "incomplete", "minimal"]
ENRICHABLE = [
    "loadCapacity", "liftingSpeed", "motorPower", "dutyCycle", "weight", "dimensions", "voltageOptions",
    "classification", "certifications", "protectionClass", "noiseLevel", "brakeType", "chainSpecification",
    "operatingTemperature", "applications",
]
CONFIDENCE_FIELDS = [
    "loadCapacity", "liftingSpeed", "motorPower", "dutyCycle", "weight", "dimensions", "voltageOptions",
    "classification", "safetyFeatures", "certifications", "warranty", "noiseLevel", "protectionClass",
    "applications", "features",
]


def kind(field: str) -> str:
    """How presence is tested for a field: text, list or map."""
    if field in LIST_FIELDS or field in MEDIA_FIELDS:
        return "list"
    return "map" if field in MAP_FIELDS else "text"
