"""Known products of vendors whose pages yield nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import c
from ..operators.merge import union_catalogs

# fixed values: vendor id, model, series, load, lifting speed, classes (joined by ','), over people, quiet
KNOWN = [
    ("columbus-mckinnon", "Lodestar Classic", "Lodestar", "250-2000 kg", "4-16 m/min", "d8", None, None),
    ("columbus-mckinnon", "Lodestar VS", "Lodestar", "125-2000 kg", "Variable 0-8 m/min", "d8+", None, None),
    ("columbus-mckinnon", "Prostar", "Prostar", "125-1000 kg", "4-24 m/min", "d8+", True, None),
    ("konecranes", "CLX Chain Hoist", "CLX", "125-5000 kg", "4-8 m/min", "d8", None, None),
    ("konecranes", "SLX Chain Hoist", "SLX", "63-2000 kg", "8-24 m/min", "d8+", None, None),
    ("demag", "DC-Pro", "DC-Pro", "125-2000 kg", "4-20 m/min", "d8+", None, True),
    ("demag", "DC-Com", "DC-Com", "125-2000 kg", "4-12 m/min", "d8", None, None),
    ("chainmaster", "D8+", "D8+", "125-2000 kg", "2-24 m/min", "d8+,bgv-c1", True, True),
    ("chainmaster", "BGV-D8", "BGV-D8", "125-2000 kg", "4-16 m/min", "d8", None, None),
    ("verlinde", "Stagemaker SR", "Stagemaker", "125-2000 kg", "4-24 m/min", "d8+,bgv-c1", True, None),
    ("verlinde", "Stagemaker SL", "Stagemaker", "63-500 kg", "8-32 m/min", "d8+", None, None),
    ("movecat", "VMK-S", "VMK", "160-2000 kg", "4-24 m/min", "d8+,bgv-c1", True, None),
    ("movecat", "P12 D8+", "P12", "125-1000 kg", "4-16 m/min", "d8+", None, None),
    ("liftket", "LIFTKET Star", "Star", "125-2500 kg", "2-24 m/min", "d8+,bgv-c1", True, True),
    ("liftket", "LIFTKET Nova", "Nova", "125-1000 kg", "4-16 m/min", "d8", None, None),
    ("liftket", "LIFTKET Star Plus", "Star Plus", "250-2000 kg", "2-16 m/min", "d8+", True, None),
    ("kito", "ER2", "ER2", "250-5000 kg", "2.5-8 m/min", "d8", None, None),
    ("kito", "EQ", "EQ", "500-20000 kg", "1.25-5 m/min", "d8", None, None),
    ("gis-ag", "GP Series", "GP", "125-2500 kg", "2-16 m/min", "d8+", None, True),
    ("harrington", "NER/NER2", "NER", "250-5000 kg", "5-16 m/min", "ansi", None, None),
    ("harrington", "SNER", "SNER", "500-10000 kg", "1.25-8 m/min", "ansi", None, None),
    ("abus", "GM4", "GM", "125-2500 kg", "4-12 m/min", "d8", None, None),
    ("abus", "GM6", "GM", "2000-6300 kg", "1-4 m/min", "d8", None, None),
    ("hitachi", "Electric Chain Hoist", "Standard", "250-5000 kg", "2.5-8 m/min", "d8,jis", None, None),
    ("donati", "DRH", "DRH", "125-5000 kg", "4-12 m/min", "d8", None, None),
    ("gorbel", "GS Series", "GS", "250-2000 kg", "4-16 m/min", "ansi", None, None),
    ("planeta", "PH Chain Hoist", "PH", "125-5000 kg", "4-8 m/min", "d8", None, None),
    ("yale", "YJL", "YJL", "250-5000 kg", "3-12 m/min", "ansi", None, None),
    ("yale", "YK", "YK", "500-10000 kg", "2-8 m/min", "ansi", None, None),
    ("yale", "KEL", "KEL", "125-3000 kg", "4-16 m/min", "d8", None, None),
    ("ingersoll-rand", "ML Series", "ML", "250-3000 kg", "4-12 m/min", "ansi", None, None),
    ("ingersoll-rand", "CLK Series", "CLK", "500-5000 kg", "2-8 m/min", "ansi", None, None),
    ("coffing", "JLC", "JLC", "125-3000 kg", "8-16 m/min", "ansi", None, None),
    ("coffing", "EC", "EC", "250-5000 kg", "4-12 m/min", "ansi", None, None),
    ("budgit", "BEH", "BEH", "250-5000 kg", "4-16 m/min", "ansi", None, None),
    ("budgit", "Man Guard", "Man Guard", "500-3000 kg", "8-12 m/min", "ansi", None, None),
    ("rm-materials", "Spacemaster SX", "SX", "125-5000 kg", "4-20 m/min", "d8", None, None),
    ("rm-materials", "LK Series", "LK", "250-2000 kg", "8-16 m/min", "d8", None, None),
    ("street-crane", "SC Series", "SC", "125-5000 kg", "4-12 m/min", "d8", None, None),
    ("street-crane", "Profi", "Profi", "250-2000 kg", "6-16 m/min", "d8+", None, None),
    ("swf", "Nova", "Nova", "125-5000 kg", "4-20 m/min", "d8", None, None),
    ("swf", "SK Series", "SK", "250-2500 kg", "4-12 m/min", "d8", None, None),
    ("jdn", "Air Hoist Profi", "Profi", "125-50000 kg", "1-12 m/min", "atex", None, None),
    ("jdn", "Mini", "Mini", "125-980 kg", "6-12 m/min", "atex", None, None),
    ("elephant", "FA Series", "FA", "250-5000 kg", "4-12 m/min", "d8", None, None),
    ("elephant", "FB Series", "FB", "500-10000 kg", "2-8 m/min", "d8", None, None),
    ("liftingsafety", "LS Electric Hoist", "LS", "250-5000 kg", "4-12 m/min", "d8", None, None),
    ("tiger", "ROV", "ROV", "250-5000 kg", "4-12 m/min", "d8+", True, None),
    ("tiger", "BCH", "BCH", "500-10000 kg", "2-8 m/min", "d8", None, None),
    ("stahl", "ST Chain Hoist", "ST", "125-6300 kg", "2-20 m/min", "d8+", None, None),
    ("stahl", "AS7 Explosion Proof", "AS7", "125-5000 kg", "4-12 m/min", "atex", None, None),
    ("nitchi", "MH-5", "MH", "250-5000 kg", "4-12 m/min", "jis", None, None),
    ("nitchi", "EC-4", "EC", "500-10000 kg", "2-8 m/min", "jis", None, None),
    ("txk", "TXK-A", "A", "250-10000 kg", "3-12 m/min", "ce", None, None),
    ("txk", "TXK-B", "B", "500-20000 kg", "2-8 m/min", "ce", None, None),
    ("carl-stahl", "Electric Chain Hoist CS", "CS", "125-2000 kg", "4-12 m/min", "d8", None, None),
    ("hoist-uk", "Stage Hoist D8+", "Stage", "250-2000 kg", "4-16 m/min", "d8+,bgv-c1", True, None),
    ("hoist-uk", "Industrial Chain Hoist", "Industrial", "500-5000 kg", "2-8 m/min", "d8", None, None),
    ("prolyft", "Aetos", "Aetos", "250-2000 kg", "4-24 m/min", "d8+,bgv-c1", True, None),
    ("prolyft", "Aetos SL", "Aetos", "125-1000 kg", "8-32 m/min", "d8+", None, None),
    ("jr-clancy", "PowerLift", "PowerLift", "125-2000 kg", "4-16 m/min", "ansi,d8+", True, None),
    ("jr-clancy", "Scenery Hoist", "Scenery", "500-5000 kg", "2-8 m/min", "ansi", None, None),
    ("cheng-day", "EH Series", "EH", "500-5000 kg", "3-10 m/min", "ce", None, None),
]


def known_products(spark: SparkSession, known=tuple(KNOWN)) -> DataFrame:
    schema = ("vendor_id string, model string, series string, loadCapacity string, liftingSpeed string, classes string, "
              "liftingOverPeople boolean, quietOperation boolean")
    df = spark.createDataFrame(list(known), schema)
    return df.withColumn("classification", F.split("classes", ",")).drop("classes")


def seed_products(catalog: DataFrame, vendors: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Known products of every vendor that has no row in the catalogue.

    ``vendors``: vendor_id, name, website. Returns the new rows; append them with ``union_catalogs``.
    """
    known = known if known is not None else known_products(catalog.sparkSession)
    bare = vendors.join(catalog.select(c("manufacturer").alias("name")).distinct(), "name", "left_anti")
    rows = bare.join(known, "vendor_id")
    safe = F.regexp_replace(F.regexp_replace(F.lower("model"), "[^a-z0-9]", "-"), "-+", "-")
    return rows.select(
        F.lower(F.concat_ws("-", "vendor_id", safe)).alias("id"), c("name").alias("manufacturer"), "model", "series",
        "loadCapacity", "liftingSpeed", "classification", "liftingOverPeople", "quietOperation", c("website").alias("url"),
        F.lit("known-data").alias("scrapedFrom"), F.lit(0.9).alias("confidence"))


def with_seeds(catalog: DataFrame, vendors: DataFrame, known: DataFrame | None = None) -> DataFrame:
    return union_catalogs(catalog, seed_products(catalog, vendors, known))
