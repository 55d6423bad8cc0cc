"""Free-text measurement parsing: load, speed and power, their canonical texts and their buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NUM, WS, c, int_text, js_number, js_round, number, to_fixed, truthy

# fixed values: unit conversion factors
KG_TO_LBS = 2.20462
LBS_TO_KG = 0.453592
TON_TO_KG = 1000.0
TON_TO_LBS = 2000.0
M_TO_FT = 3.28084
FT_TO_M = 0.3048
KW_TO_HP = 1.34102
HP_TO_KW = 0.745699
SHORT_TON_TO_KG = 907.185

CAPACITY_BUCKETS = ["≤250 kg", "251-500 kg", "501-1000 kg", "1001-2000 kg", ">2000 kg"]
SPEED_BUCKETS = ["<2 m/min", "2-4 m/min", "4-8 m/min", "≥8 m/min"]
POWER_BUCKETS = ["<0.5 kW", "0.5-1 kW", "1-2 kW", ">2 kW"]


def capacity_kg(x) -> Column:
    s = F.lower(c(x))
    return F.coalesce(
        number(s, f"{NUM}{WS}*kg"),
        js_round(number(s, f"{NUM}{WS}*(?:lbs?|pounds?)") * LBS_TO_KG),
        number(s, NUM + WS + r"*(?:tons?|tonnes?|t\b)") * TON_TO_KG,
    )


def speed_mpm(x) -> Column:
    s = F.lower(c(x))
    return F.coalesce(
        number(s, f"{NUM}{WS}*m/min"),
        js_round(number(s, f"{NUM}{WS}*(?:ft/min|fpm)") * FT_TO_M * 10) / 10,
        number(s, f"{NUM}{WS}*m/s") * 60,
    )


def measure(x, unit_class: str = "[a-z]") -> Column:
    """Struct(v, u): the first number followed by letters, and those letters in lower case."""
    pat = f"(?i){NUM}{WS}*({unit_class}+)"
    return F.struct(number(x, pat, 1).alias("v"), F.lower(F.regexp_extract(c(x), pat, 2)).alias("u"))


SPEED_UNIT = "[a-z/]"


def normalize_capacity(x, parts=None) -> Column:
    """``500 kg`` -> ``500 kg (1102 lbs)``; units other than kg / lb / (short) ton stay as they are.

    ``parts`` may name a column that already holds ``measure(x)``, so that a wide projection parses the text once.
    """
    x, m = c(x), measure(x) if parts is None else c(parts)
    v, u = m["v"], m["u"]
    pair = lambda kg, lbs: F.concat(kg, F.lit(" kg ("), lbs, F.lit(" lbs)"))
    return (
        F.when(~truthy(x), F.lit(""))
        .when(u.contains("kg"), pair(js_number(v), int_text(js_round(v * KG_TO_LBS))))
        .when(u.contains("lb"), pair(int_text(js_round(v * LBS_TO_KG)), js_number(v)))
        .when(u.contains("ton") & ~u.contains("metric"), pair(js_number(v * TON_TO_KG), js_number(v * TON_TO_LBS)))
        .otherwise(x)
    )


def normalize_speed(x, parts=None) -> Column:
    x, m = c(x), measure(x, SPEED_UNIT) if parts is None else c(parts)
    v, u = m["v"], m["u"]
    return (
        F.when(~truthy(x), F.lit(""))
        .when(u.contains("m/min"),
              F.concat(js_number(v), F.lit(" m/min ("), int_text(js_round(v * M_TO_FT)), F.lit(" ft/min)")))
        .when(u.contains("ft/min") | u.contains("fpm"),
              F.concat(to_fixed(v * FT_TO_M, 1), F.lit(" m/min ("), js_number(v), F.lit(" ft/min)")))
        .otherwise(x)
    )


def normalize_power(x, parts=None) -> Column:
    x, m = c(x), measure(x) if parts is None else c(parts)
    v, u = m["v"], m["u"]
    return (
        F.when(~truthy(x), F.lit(""))
        .when(u.contains("kw"), F.concat(js_number(v), F.lit(" kW ("), to_fixed(v * KW_TO_HP, 1), F.lit(" HP)")))
        .when(u.contains("hp"), F.concat(to_fixed(v * HP_TO_KW, 2), F.lit(" kW ("), js_number(v), F.lit(" HP)")))
        .otherwise(x)
    )


def search_capacity(x) -> Column:
    """Search-time reading: kilograms only, no conversion."""
    return number(x, f"(?i){NUM}{WS}*kg")


def search_speed(x) -> Column:
    """Search-time reading: any unit that starts with m (so ``13 mm/s`` reads 13)."""
    return number(x, f"(?i){NUM}{WS}*m")


def capacity_any_unit(x, mode: str = "fixed") -> Column:
    """Capacity for power estimation.

    ``compat`` decides the unit from the whole text, so ``1000 kg (2205 lbs)`` reads as pounds (454);
    ``fixed`` prefers a kilogram figure when one is written.
    """
    s = F.lower(c(x))
    v = F.replace(F.regexp_extract(s, r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    by_text = js_round(
        F.when(s.rlike("lbs?|pound"), v * LBS_TO_KG)
        .when(s.contains("ton") & s.contains("short"), v * SHORT_TON_TO_KG)
        .when(s.contains("ton"), v * TON_TO_KG)
        .otherwise(v))
    if mode == "compat":
        return by_text
    return F.coalesce(js_round(number(s, f"{NUM}{WS}*kg")), by_text)


def first_integer(x) -> Column:
    return number(x, r"(\d+)")


def leading_integer(x) -> Column:
    """Numeric prefix of a text, as parseInt reads it."""
    return number(x, f"^{WS}*" + r"([+-]?\d+)")


def capacity_bucket(kg, style: str = "spaced") -> Column:
    kg = c(kg)
    names = CAPACITY_BUCKETS if style == "spaced" else [b.replace(" kg", "kg") for b in CAPACITY_BUCKETS]
    return (F.when(kg <= 250, names[0]).when(kg <= 500, names[1]).when(kg <= 1000, names[2])
            .when(kg <= 2000, names[3]).when(kg > 2000, names[4]))


def speed_bucket(mpm, style: str = "index") -> Column:
    v = c(mpm)
    top = SPEED_BUCKETS[3] if style == "index" else ">8 m/min"
    return (F.when(v < 2, SPEED_BUCKETS[0]).when(v < 4, SPEED_BUCKETS[1]).when(v < 8, SPEED_BUCKETS[2])
            .when(v >= 8, top))


def power_bucket(x) -> Column:
    v = number(x, f"(?i){NUM}{WS}*kw")
    return (F.when(v < 0.5, POWER_BUCKETS[0]).when(v < 1, POWER_BUCKETS[1]).when(v < 2, POWER_BUCKETS[2])
            .when(v >= 2, POWER_BUCKETS[3]))


def label_number(x) -> Column:
    """Natural order key of a bucket label: its first integer, 0 without one (or with one beyond 64 bits)."""
    return F.coalesce(F.regexp_extract(c(x), r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
