"""DuckDB side of the checks: the catalogue view and its processed form, written independently of the Spark code."""

from __future__ import annotations

from .inputs import CATALOG_SQL, DEVICES_SQL, DOCS_SQL, MAKERS_SQL

NUM = r"(\d+(?:\.\d+)?)"


def num(x: str, pat: str, group: int = 1) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '{pat}', {group}), '') AS DOUBLE)"


KG = num("lower({0})", NUM + r"\s*kg")
CAP_KG = ("coalesce(" + num("lower({0})", NUM + r"\s*kg") + ", round(" + num("lower({0})", NUM + r"\s*(?:lbs?|pounds?)")
          + " * 0.453592), " + num("lower({0})", NUM + r"\s*(?:tons?|tonnes?|t\b)") + " * 1000)")
SPEED = ("coalesce(" + num("lower({0})", NUM + r"\s*m/min") + ", round(" + num("lower({0})", NUM + r"\s*(?:ft/min|fpm)")
         + " * 0.3048 * 10) / 10, " + num("lower({0})", NUM + r"\s*m/s") + " * 60)")
MPM = num("lower({0})", NUM + r"\s*m")


def f(template: str, col: str) -> str:
    return template.replace("{0}", col)


def jsn(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def vu(x: str, cls: str) -> tuple[str, str]:
    pat = "(?i)" + NUM + r"\s*(" + cls + "+)"
    return num(x, pat, 1), f"lower(regexp_extract({x}, '{pat}', 2))"


def norm_capacity(x: str) -> str:
    v, u = vu(x, "[a-z]")
    return f"""(CASE WHEN coalesce({x}, '') = '' THEN ''
      WHEN {u} LIKE '%kg%' THEN {jsn(v)} || ' kg (' || CAST(CAST(round({v} * 2.20462) AS BIGINT) AS VARCHAR) || ' lbs)'
      WHEN {u} LIKE '%lb%' THEN CAST(CAST(round({v} * 0.453592) AS BIGINT) AS VARCHAR) || ' kg (' || {jsn(v)} || ' lbs)'
      WHEN {u} LIKE '%ton%' AND {u} NOT LIKE '%metric%'
        THEN {jsn(v + ' * 1000')} || ' kg (' || {jsn(v + ' * 2000')} || ' lbs)'
      ELSE {x} END)"""


def norm_speed(x: str) -> str:
    v, u = vu(x, "[a-z/]")
    return f"""(CASE WHEN coalesce({x}, '') = '' THEN ''
      WHEN {u} LIKE '%m/min%' THEN {jsn(v)} || ' m/min (' || CAST(CAST(round({v} * 3.28084) AS BIGINT) AS VARCHAR) || ' ft/min)'
      WHEN {u} LIKE '%ft/min%' OR {u} LIKE '%fpm%' THEN printf('%.1f', {v} * 0.3048) || ' m/min (' || {jsn(v)} || ' ft/min)'
      ELSE {x} END)"""


def norm_power(x: str) -> str:
    v, u = vu(x, "[a-z]")
    return f"""(CASE WHEN coalesce({x}, '') = '' THEN ''
      WHEN {u} LIKE '%kw%' THEN {jsn(v)} || ' kW (' || printf('%.1f', {v} * 1.34102) || ' HP)'
      WHEN {u} LIKE '%hp%' THEN printf('%.2f', {v} * 0.745699) || ' kW (' || {jsn(v)} || ' HP)'
      ELSE {x} END)"""


def vendor(x: str) -> str:
    return f"CASE {x} WHEN 'CM' THEN 'Columbus McKinnon' WHEN 'Chainmaster GmbH' THEN 'Chainmaster' WHEN 'Stagemaker' THEN 'Verlinde' ELSE {x} END"


def model(x: str) -> str:
    for p in ("electric chain hoists?", "chain hoists?", "hoists?", "series"):
        x = f"regexp_replace({x}, '{p}', '', 'gi')"
    return f"trim({x})"


# classes keep their order: the list is walked by position and an alias that already occurred is left out
CLASS_ALIAS = ("CASE WHEN c IN ('d8','bgv-d8','bgvd8','d8standard') THEN 'd8' "
               "WHEN c IN ('d8+','d8plus','bgv-d8+','bgvd8+','bgv-d8plus') THEN 'd8+' "
               "WHEN c IN ('bgv-c1','bgvc1','c1') THEN 'bgv-c1' WHEN c IN ('ansi','asme') THEN 'ansi' ELSE c END")


def classes(x: str) -> str:
    step = f"list_transform(list_filter(string_split_regex(coalesce({x}, ''), '[,;/]'), lambda e: e <> ''), lambda c0: lower(trim(c0)))"
    named = f"list_transform({step}, lambda c: {CLASS_ALIAS})"
    return f"list_filter({named}, lambda e, i: list_position({named}, e) = i)"


def present(x: str) -> str:
    return f"(coalesce(trim({x}), '') <> '' AND coalesce({x}, '') <> '-')"


def bucket(kg: str, style: str = "spaced") -> str:
    names = ["≤250 kg", "251-500 kg", "501-1000 kg", "1001-2000 kg", ">2000 kg"]
    if style == "tight":
        names = [n.replace(" kg", "kg") for n in names]
    return (f"(CASE WHEN {kg} <= 250 THEN '{names[0]}' WHEN {kg} <= 500 THEN '{names[1]}' WHEN {kg} <= 1000 THEN '{names[2]}' "
            f"WHEN {kg} <= 2000 THEN '{names[3]}' WHEN {kg} > 2000 THEN '{names[4]}' END)")


def speed_bucket(v: str, top: str = "≥8 m/min") -> str:
    return f"(CASE WHEN {v} < 2 THEN '<2 m/min' WHEN {v} < 4 THEN '2-4 m/min' WHEN {v} < 8 THEN '4-8 m/min' WHEN {v} >= 8 THEN '{top}' END)"


def power_bucket(x: str) -> str:
    v = num(x, "(?i)" + NUM + r"\s*kw")
    return f"(CASE WHEN {v} < 0.5 THEN '<0.5 kW' WHEN {v} < 1 THEN '0.5-1 kW' WHEN {v} < 2 THEN '1-2 kW' WHEN {v} >= 2 THEN '>2 kW' END)"


RAW = f"raw AS ({CATALOG_SQL})"
DEV = f"devices_raw AS ({DEVICES_SQL}), makers AS ({MAKERS_SQL})"
DOC = f"docs AS ({DOCS_SQL})"

PROCESSED = f"""
cleaned AS (
  SELECT * REPLACE ({vendor('manufacturer')} AS manufacturer, {model('model')} AS model,
                    {norm_capacity('loadCapacity')} AS loadCapacity, {norm_speed('liftingSpeed')} AS liftingSpeed,
                    {norm_power('motorPower')} AS motorPower,
                    coalesce(lower(quietOperation) IN ('yes', 'true', 'y', '1'), false) AS quietOperation),
         {classes('classification_raw')} AS cls0
  FROM raw WHERE coalesce(model, '') <> '' AND coalesce(manufacturer, '') <> ''),
ruled AS (
  SELECT * REPLACE (CASE WHEN manufacturer = 'Columbus McKinnon' AND contains(model, 'Lodestar') THEN 'Lodestar'
                         WHEN manufacturer = 'Verlinde' AND contains(model, 'SR') THEN 'Stagemaker SR'
                         WHEN manufacturer = 'Verlinde' AND contains(model, 'SL') THEN 'Stagemaker SL'
                         ELSE series END AS series,
                    CASE WHEN source IS NOT NULL AND source <> '' THEN source WHEN llmEnriched THEN 'llm_enriched'
                         WHEN coalesce(url, '') <> '' THEN 'scraped' ELSE 'unknown' END AS source),
         CASE WHEN len(cls0) > 0 THEN cls0
              WHEN manufacturer = 'Columbus McKinnon' AND contains(model, 'Lodestar') THEN ['d8']
              WHEN manufacturer = 'Chainmaster' AND contains(model, 'D8+') THEN ['d8+']
              WHEN manufacturer = 'Chainmaster' AND contains(model, 'D8') THEN ['d8'] ELSE cls0 END AS cls
  FROM cleaned),
scored AS (
  SELECT *, {f(CAP_KG, 'loadCapacity')} AS capacityKg, {f(SPEED, 'liftingSpeed')} AS speedMMin,
         {present('loadCapacity')} AS has_cap, {present('liftingSpeed')} AS has_speed, {present('motorPower')} AS has_power,
         len(cls) > 0 AS has_cls, {present('dutyCycle')} AS has_duty, voltage_raw IS NOT NULL AS has_volt,
         {present('weight')} AS has_weight, {present('protectionClass')} AS has_ip, {present('series')} AS has_series,
         {f(KG, 'loadCapacity')} AS kg, {f(MPM, 'liftingSpeed')} AS mpm
  FROM ruled),
catalog AS (
  SELECT *, CAST(floor(0.5 + 70.0 * (has_cap::INT + has_speed::INT + has_power::INT + has_cls::INT + has_duty::INT) / 5
                       + 30.0 * (has_volt::INT + has_weight::INT + has_ip::INT + has_series::INT) / 4) AS INT) AS dataCompleteness,
         has_cap AND has_speed AND has_power AS hasCompleteSpecs,
         nullif(url, '') AS sourceUrl,
         CASE WHEN floor(0.5 + 70.0 * (has_cap::INT + has_speed::INT + has_power::INT + has_cls::INT + has_duty::INT) / 5
                       + 30.0 * (has_volt::INT + has_weight::INT + has_ip::INT + has_series::INT) / 4) >= 80 THEN 'complete'
              WHEN floor(0.5 + 70.0 * (has_cap::INT + has_speed::INT + has_power::INT + has_cls::INT + has_duty::INT) / 5
                       + 30.0 * (has_volt::INT + has_weight::INT + has_ip::INT + has_series::INT) / 4) >= 60 THEN 'partial'
              WHEN floor(0.5 + 70.0 * (has_cap::INT + has_speed::INT + has_power::INT + has_cls::INT + has_duty::INT) / 5
                       + 30.0 * (has_volt::INT + has_weight::INT + has_ip::INT + has_series::INT) / 4) >= 30 THEN 'incomplete'
              ELSE 'minimal' END AS dataQualityTier
  FROM scored)"""


def raw(body: str) -> str:
    return f"WITH {RAW}\n{body}"


def cat(body: str, more: str = "") -> str:
    """Statement over ``catalog``; ``more`` adds further CTEs."""
    return f"WITH {RAW}, {PROCESSED}{', ' + more if more else ''}\n{body}"


def dev(body: str, more: str = "") -> str:
    return f"WITH {DEV}{', ' + more if more else ''}\n{body}"
