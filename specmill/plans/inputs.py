"""Views of the driver tables in the shape of a product catalogue.

``CATALOG_SQL`` is written in the part of SQL that Spark and DuckDB share, so both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import split_classes

CATALOG_SQL = """
SELECT p_partkey AS _pos,
       concat('p-', CAST(p_partkey AS STRING)) AS id,
       CASE WHEN p_brand = 'Brand#1' THEN 'CM' WHEN p_brand = 'Brand#2' THEN 'Chainmaster GmbH'
            WHEN p_brand = 'Brand#3' THEN 'Stagemaker' ELSE p_brand END AS manufacturer,
       concat(p_name, CASE p_partkey % 7 WHEN 0 THEN ' Lodestar' WHEN 1 THEN ' D8+' WHEN 2 THEN ' SR' ELSE '' END,
              ' Hoist') AS model,
       p_type AS series,
       CASE p_partkey % 6
            WHEN 0 THEN concat(CAST(p_size * 50 AS STRING), ' kg')
            WHEN 1 THEN concat(CAST(p_size * 110 AS STRING), ' lbs')
            WHEN 2 THEN concat(CAST(p_size AS STRING), ' ton')
            WHEN 3 THEN concat('125-', CAST(p_size * 40 AS STRING), ' kg')
            WHEN 4 THEN '-' END AS loadCapacity,
       CASE p_partkey % 5
            WHEN 0 THEN concat(CAST(p_size % 12 + 1 AS STRING), ' m/min')
            WHEN 1 THEN concat(CAST(p_size % 30 + 5 AS STRING), ' fpm')
            WHEN 2 THEN '0.1 m/s'
            WHEN 3 THEN '' END AS liftingSpeed,
       CASE p_partkey % 4
            WHEN 0 THEN concat(CAST(p_size % 5 + 1 AS STRING), ' kW')
            WHEN 1 THEN concat(CAST(p_size % 5 + 1 AS STRING), ' HP')
            WHEN 2 THEN 'Not specified' END AS motorPower,
       CASE p_partkey % 5
            WHEN 0 THEN 'BGV-D8, CE' WHEN 1 THEN 'd8plus;ansi'
            WHEN 2 THEN 'c1/ATEX' WHEN 3 THEN '' END AS classification_raw,
       CASE p_partkey % 3 WHEN 0 THEN 'FEM 2m' WHEN 1 THEN 'M5' END AS dutyCycle,
       CASE WHEN p_partkey % 2 = 0 THEN concat(CAST(p_size AS STRING), ' kg') END AS weight,
       CASE WHEN p_partkey % 9 = 0 THEN concat(CAST(p_size AS STRING), ' x 30 x 20 cm')
            WHEN p_partkey % 9 = 1 THEN 'Not visible' END AS dimensions,
       CASE WHEN p_partkey % 4 = 0 THEN 'IP54' END AS protectionClass,
       CASE WHEN p_partkey % 8 = 0 THEN '400V' WHEN p_partkey % 8 = 1 THEN '230V 1ph' END AS voltage_raw,
       CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'no' END AS quietOperation,
       CASE WHEN p_partkey % 11 = 5 THEN NULL
            WHEN p_partkey % 13 = 0 THEN concat('http://vendor.example.com/news/', CAST(p_partkey AS STRING))
            WHEN p_partkey % 17 = 0 THEN 'http://vendor.example.com/'
            ELSE concat('http://vendor.example.com/item/', CAST(p_partkey % 700 AS STRING)) END AS url,
       CASE p_partkey % 5 WHEN 0 THEN 'Electric Chain Hoist' WHEN 1 THEN 'Winch' WHEN 2 THEN 'Beam Trolley'
                          WHEN 3 THEN 'Unknown' END AS category,
       CASE p_partkey % 3 WHEN 0 THEN 'Variable Speed' WHEN 1 THEN 'Unknown' END AS speedType,
       CASE p_partkey % 10 WHEN 0 THEN 'manual' WHEN 1 THEN 'personality' END AS source,
       CASE p_partkey % 10 WHEN 2 THEN true ELSE false END AS llmEnriched,
       CAST(p_partkey % 3 AS INT) AS n_images,
       CAST(p_partkey % 4 AS INT) AS n_pdfs,
       CAST(CASE WHEN p_partkey % 6 = 3 THEN 1 ELSE 0 END AS INT) AS n_downloads,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 10 AS DOUBLE) / 10 END AS confidence,
       m.last_ship AS lastUpdated
FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_partkey) m
  ON m.l_partkey = p_partkey
"""

# Device rows as the XML source delivers them (attributes, free-text name, numeric texts)
DEVICES_SQL = """
SELECT p_partkey AS _pos,
       CAST(100 + CAST(substr(p_brand, 7) AS INT) AS STRING) AS manufacturerId,
       CAST(p_partkey AS STRING) AS productId,
       concat('[', CAST(100 + CAST(substr(p_brand, 7) AS INT) AS STRING), '-', CAST(p_partkey AS STRING), '] ', p_name,
              CASE p_partkey % 7 WHEN 0 THEN ' Varispeed' WHEN 1 THEN ' Trolley' WHEN 2 THEN ' Fixed Speed'
                                 WHEN 3 THEN ' Winch' WHEN 4 THEN ' Rotator' WHEN 5 THEN ' Flying' ELSE '' END,
              ' ', CAST(p_size * 25 AS STRING), 'kg ',
              CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size % 9 + 1 AS STRING), 'm/min')
                                 WHEN 1 THEN concat(CAST(p_size % 9 + 10 AS STRING), 'mm/s')
                                 WHEN 2 THEN concat(CAST(p_size + 3 AS STRING), 'fpm') ELSE '' END,
              CASE WHEN p_partkey % 5 = 0 THEN ' - [Blue Tag]' ELSE '' END) AS name,
       concat('m', CAST(p_partkey AS STRING), '.xml') AS fileName,
       CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN '0' END AS minSpeedRaw,
       CASE p_partkey % 3 WHEN 0 THEN CAST(p_size + p_partkey % 2 AS STRING) WHEN 1 THEN '100' END AS maxSpeedRaw,
       CAST(p_size % 4 AS STRING) AS underloadRaw,
       CAST(p_size * 30 AS STRING) AS overloadRaw,
       CASE WHEN p_partkey % 2 = 0 THEN '0.5' ELSE 'n/a' END AS encoderRaw,
       CASE WHEN p_partkey % 6 = 0 THEN concat('/media/d', CAST(p_partkey AS STRING), '.png') END AS imageUrl
FROM part
"""

# Vendor names of the devices: '100 - Name', keyed by id; two ids have no entry
MAKERS_SQL = """
SELECT DISTINCT CAST(100 + CAST(substr(p_brand, 7) AS INT) AS STRING) AS manufacturerId,
       concat(CAST(100 + CAST(substr(p_brand, 7) AS INT) AS STRING), ' - ',
              CASE CAST(substr(p_brand, 7) AS INT) % 5 WHEN 0 THEN 'Lodestar ' WHEN 1 THEN 'GIS ' ELSE 'Works ' END,
              substr(p_brand, 7)) AS fullName
FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#8')
"""

# A document file about every part, with what was read from it
DOCS_SQL = """
SELECT p_partkey AS _pos,
       concat(lower(replace(p_brand, '#', '-')), '_', replace(p_name, ' ', '-'), '_document_',
              CAST(p_partkey % 3 AS STRING), '.pdf') AS filename,
       CASE WHEN p_partkey % 20 = 0 THEN p_brand ELSE '' END AS ext_manufacturer,
       CASE WHEN p_partkey % 30 = 0 THEN p_name ELSE '' END AS ext_model,
       CASE WHEN p_partkey % 40 = 0 THEN p_type ELSE '' END AS ext_series,
       concat(CAST(p_size * 10 AS STRING), ' kg') AS ext_capacity,
       CASE WHEN p_partkey % 70 = 0 THEN 'unreadable' END AS error
FROM part
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark, sf_dir, text: str) -> DataFrame:
    return spark.sql(text.replace(" part", " {part}").replace(" lineitem", " {lineitem}"),
                     part=table(spark, sf_dir, "part"), lineitem=table(spark, sf_dir, "lineitem"))


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows before processing, with list and struct columns built from the scalar ones."""
    df = _sql(spark, sf_dir, CATALOG_SQL)
    n = lambda c, made: F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= F.col(c)), made)
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    none = F.lit(None).cast("string")
    image = lambda i: F.struct(text("/img/", F.col("id"), "-", i, ".jpg").alias("url"), F.col("model").alias("alt"),
                               none.alias("type"), none.alias("localPath"), none.alias("title"))
    doc = lambda i: F.struct(text("/doc/", F.col("id"), "-", i, ".pdf").alias("url"),
                             text("Doc ", i).alias("title"), F.lit("datasheet").alias("type"),
                             text("docs/", F.col("id"), "-", i, ".pdf").alias("localPath"))
    return df.withColumns({
        "classification": split_classes("classification_raw"),
        "voltageOptions": F.when(F.col("voltage_raw").isNotNull(), F.array("voltage_raw")),
        "images": n("n_images", image), "pdfs": n("n_pdfs", doc), "downloadedPDFs": n("n_downloads", doc),
    }).drop("voltage_raw", "n_images", "n_pdfs", "n_downloads")


def raw_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DEVICES_SQL)


def makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, MAKERS_SQL)


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DOCS_SQL)
