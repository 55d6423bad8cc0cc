"""Record filters driven by rule lists: what is a product, what is an empty record, what needs another visit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, c, count_true, first_match, js_trim, matches, not_blank, truthy
from ..session import cut
from .facets import has_list
from .tidy import limited, top_k

# fixed values: paths that are no product page
SKIP_URLS = [
    "/contact", "/about", "/blog", "/news", "/career", "/job", "/privacy", "/terms", "/cookie", "/legal", "/imprint",
    "/impressum", "/sitemap", "/search", "/login", "/register", "/account", "/cart", "/checkout", "/download",
    "/support", "/faq", "/help", "/events", "/training", "/seminars", "/webinar", "/newsletter", "/subscribe",
    "/unsubscribe", "/media", "/press", "/investors", "/sustainability", "/csr", "/history", "/team", "/management",
    "/locations", "/dealers", "/distributors", "/partners", "/industries", "/solutions", "/services", "/case-stud",
    "/testimonial", "/reference", "/catalogue", "/brochure", "/document", "/video", "/gallery", "/404", "/error",
]

# fixed values: model names that are no product
SKIP_MODELS = [
    "^contact", "^about", "^home", "^products$", "^services$", "^solutions$", "^industries$", "^news$", "^blog$",
    "^support$", "^download", "^catalogue", "^brochure", "^page not found", "^error", "^404", "^view all", "^see all",
    "^featured", "^overview", "global leader", "^accessories$", "^options$", "^parts$", "^spare parts$",
]

# fixed values: product types that are kept
KEEP_TYPES = [
    "hoist", "winch", "trolley", r"\bjack\b", "puller", "come.?along", "lever block", "chain block", "lodestar",
    "prostar", "valuestar", "stagemaker", "liftket", "abucompact", "dc-pro", "dc-com",
]

# fixed values: product types that are dropped unless a kept type also occurs
DROP_TYPES = [
    "conveyor", "flexmove", "montrac", "belt system",
    r"\bcrane\b(?!.*hoist)", "gantry", "jib crane", "bridge crane", "overhead crane",
    "pallet truck", "pallet jack", "forklift", "stacker", "platform", "lift table", "lifting table", "scissor lift",
    "dock leveler",
    r"\bsling\b", r"\bshackle\b", "lashing", "webbing", "round sling", "wire rope(?!.*hoist)", "chain sling",
    r"\bdrive\b(?!.*hoist)", r"\binverter\b", r"\bmotor\b(?!.*hoist)", r"\bbrake\b(?!.*hoist)", "frequency drive",
    "variable speed drive",
    "conductor bar", "festoon", "cable system", "collector", "busbar",
    "transmitter", "receiver", "remote control(?!.*hoist)", "pendant", "controller(?!.*hoist)",
    "lifting magnet", "vacuum lifter", "grab", "clamp(?!.*trolley)", "spreader beam", "lifting beam", "c-hook",
    "coil hook",
    "bogie", "turntable", "transfer table", "rail system",
    "compressor", "pump(?!.*hoist)", "cylinder", "valve", "actuator", "gear ?box", "workshop equipment",
    "^aerospace$", "^automotive$", "^construction$", "^entertainment$", "^manufacturing$", "^mining$", "^offshore$",
    "^pharmaceutical$", "^utilities$", "^water management$",
]

# fixed values: model names removed by the aggressive clean-up
AGGRESSIVE = [
    "^contact", "^about", "^we are", "^we improve", "^our challenge", "^our lifting", "leading manufacturer",
    "^products$", "^downloads$", "^certificates", "^sales network", "^online services", "^additional equipment",
    "^what is included", "price enquiry", "^choose country", "^existing users", "^your baskets", "^clearance items",
    "^purpose in motion", "^corporate sustainability", "^community$", "^internship program", "^iso 9001", "^patents$",
    "^professional associations", "newsroom", "^manufacturers and brands",
    "^lever s$", "^hand s$", "^air s$", "^electric wire rope s$", "^pneumatic wire rope s$", "^explosion proof.*s$",
    "^cable pullers", "^a global leader", "compressed air.*s$", "^manual s$", "wire rope.*s$", "^atex s$",
    "^pneumatic s$", "^manual ing$", "^pneumatic ing$",
    "^automotive.*crane", "^general manufacturing", "^metal production", "^mining$", "^oil.*gas", "^power plants",
    "by industry", "maximize throughput",
    "^overhead cranes$", "^double girder", "^portal.*cranes", "^light crane systems", "^specialised.*cranes",
    "^underslung cranes", "^workstation cranes", "^jib cranes", "^gantry cranes", "^bridge crane", "^monorails$",
    "^polipastos", "^elektrokettenzug", "电动环链葫芦", "^die profi", "^la série",
    "seite nicht gefunden", "page not found", "404",
    "^lifting equipment$", "^fall arrest", "^material handling.*equipment$", "^beam.*clamps$", "^trolleys$",
    "^air trolleys$", "^air winches$", "^chain blocks$", "hook type$", "with trolley$", "^no crane without",
    r"^s \+ trolleys$", "industrial services", "lifting technology$", "slings.*straps", "drupal$", "demagcranes$",
]
# fixed values, in their natural order
GENERIC_WORDS = ["s", "hoists", "products", "trolleys", "cranes", "equipment"]

# fixed values: model names removed by the final clean-up
FINAL = [
    "^contact us$", "^our challenge", "^industrial services$", "^lifting technology$", "^slings.*straps$",
    "^PLANETA lifting technology$",
    "^lever s$", "^hand s$", "^air s$", "^electric wire rope s$", "^explosion proof.*s$", "^cable pullers",
    "^a global leader", "compressed air.*s$", "manual.*s$", "wire rope.*s$", "^atex s$",
    "seite nicht gefunden", "page not found", "404", "not found",
]

# fixed values: deep clean-up, names of no product and names of category pages
DEEP_INVALID = [
    "^products$", "^contact", "^about", "^home$", "^news", "^drupal$", "^seite nicht gefunden", "^page not found",
    "professional associations", "corporate sustainability", "newsroom", "custom solutions", "simply reliable",
    "choose country", "online services", "downloads$", "^we are global", "^purpose in motion", "^community$",
    "^patents$", "internship program", "iso.*certifications", "maximize throughput", "leading manufacturer of",
]
DEEP_CATEGORY = [
    r"^(hand|lever|air|electric)\s*(hoists?|chain|wire)", r"hoists?\s*$", r"^chain\s*$", r"^trolleys?\s*$",
    "wire rope hoists$", "pneumatic.*hoists$",
]

# fixed values, in their natural order
HOIST_WORDS = ["hoist", "chain", "wire", "winch", "lift"]


def _opt(df: DataFrame, name: str) -> Column:
    return F.coalesce(c(name), F.lit("")) if name in df.columns else F.lit("")


def _url_parts(url: str = "url") -> tuple[Column, Column]:
    """Path and path-with-query of an absolute address; NULL when it is none."""
    u = c(url)
    ok = u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\s]+")
    rest = F.when(ok, F.regexp_replace(F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+", ""), "#.*$", ""))
    path = F.regexp_replace(rest, r"\?.*$", "")
    return path, F.when(path == "", F.concat(F.lit("/"), rest)).otherwise(rest)


def validate_records(df: DataFrame, strict: bool = False, skip_urls=tuple(SKIP_URLS), skip_models=tuple(SKIP_MODELS),
                     keep_types=tuple(KEEP_TYPES), drop_types=tuple(DROP_TYPES)) -> DataFrame:
    """Add ``valid``, ``reasons`` and ``warnings``.

    The texts under test become columns first, so that no rule repeats their construction. ``valid`` needs one
    alternation per rule list; which rule it was is only looked up for rows that fail.
    """
    path, full = _url_parts()
    text = F.lower(F.concat_ws(" ", *[_opt(df, f) for f in ("model", "productType", "series", "description")]))
    work = df.withColumns({"_path": path, "_full": full, "_name": js_trim(_opt(df, "model")), "_text": text})
    flags = {"_bad_url": truthy("url") & matches("_full", list(skip_urls)), "_bad_name": matches("_name", list(skip_models)),
             "_kept": matches("_text", list(keep_types)), "_dropped": matches("_text", list(drop_types))}
    work = work.withColumns(flags)
    no_name, short = _opt(df, "model") == "", F.length("_name") < 2
    wrong_type = ~c("_kept") & c("_dropped")
    specs = any_of([truthy(f) for f in ("loadCapacity", "liftingSpeed", "motorPower")])
    bare = ~specs & (F.length(_opt(df, "description")) <= 50)
    bad = c("_bad_url") | no_name | short | c("_bad_name") | wrong_type
    if strict:
        bad = bad | ~truthy("manufacturer") | bare
    label = lambda prefix, x, ps: F.concat(F.lit(prefix), first_match(x, list(ps)))
    reasons = [F.when(c("_bad_url"), label("URL matches skip pattern: ", "_full", skip_urls)),
               F.when(no_name, "No model name provided").when(short, "Model name too short")
                .when(c("_bad_name"), label("Model matches skip pattern: ", "_name", skip_models)),
               F.when(wrong_type, label("Matches non-hoist pattern: ", "_text", drop_types))]
    if strict:
        reasons += [F.when(~truthy("manufacturer"), F.lit("Missing manufacturer")), F.when(short, F.lit("Missing or invalid model")),
                    F.when(bare, F.lit("No specifications or meaningful description"))]
    none = F.array().cast("array<string>")
    home = truthy("url") & ~c("_bad_url") & c("_path").isin("", "/")
    warnings = [F.when(F.coalesce(home, F.lit(False)), F.lit("Homepage URL - may not be product-specific")),
                F.when(~c("_kept") & ~c("_dropped"), F.lit("Product type uncertain - may not be a hoist"))]
    work = work.withColumn("valid", ~bad)
    return work.withColumns({
        "reasons": F.when(c("valid"), none).otherwise(F.array_compact(F.array(*reasons))),
        "warnings": F.array_compact(F.array(*warnings))}).drop("_path", "_full", "_name", "_text", *flags)


def split_valid(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid records. The rules run once: the checked records are checkpointed, as both halves read them."""
    checked = cut(validate_records(df, **options))
    return checked.filter("valid"), checked.filter("not valid")


def invalid_by_reason(df: DataFrame, k: int | None = None, **options) -> DataFrame:
    """Invalid rows per first reason with their models (with k the first k). The reasons are found once and checkpointed, as both the
    counts and the samples read them."""
    bad = cut(validate_records(df, **options).filter("not valid").select(
        F.try_element_at("reasons", F.lit(1)).alias("reason"), "manufacturer", "model", "_pos"))
    n = bad.groupBy("reason").agg(F.count("*").alias("n"))  # one row per rule
    return top_k(bad, ["reason"], [F.col("_pos")], k, "sample").join(F.broadcast(n), "reason").drop("_pos")


def is_empty(df: DataFrame, rule: str = "signals") -> Column:
    """signals: none of six data signals; useful: fewer than three of seven useful fields; specs: no specification."""
    known = lambda f: truthy(f) & (c(f) != "Unknown")
    filled = lambda f: F.coalesce(not_blank(f), F.lit(False))
    if rule == "signals":
        signs = [known(f) for f in ("loadCapacity", "liftingSpeed", "motorPower")]
        signs += [F.length(_opt(df, "description")) > 50, has_list("images")]
        if "specifications" in df.columns:
            signs.append(F.coalesce(F.size("specifications") > 0, F.lit(False)))
        return ~any_of(signs)
    if rule == "useful":
        signs = [truthy(f) for f in ("loadCapacity", "liftingSpeed", "motorPower", "weight")]
        signs += [F.length(_opt(df, "description")) > 20, has_list("images"), has_list("pdfs")]
        return count_true(signs) < 3
    if rule == "specs":
        return ~any_of([filled(f) for f in ("loadCapacity", "liftingSpeed", "motorPower", "dutyCycle", "weight")]
                       + [has_list("classification")])
    raise ValueError(f"unknown rule {rule}")


def non_product_reason(df: DataFrame, ruleset: str = "aggressive", out: str = "reason") -> DataFrame:
    """Add why a model name is no product; NULL when it is kept."""
    if ruleset not in ("final", "aggressive"):
        raise ValueError(f"unknown ruleset {ruleset}")
    rules = FINAL if ruleset == "final" else AGGRESSIVE
    d = df.withColumn("_name", js_trim(F.coalesce(c("model"), F.lit(""))))
    hit = F.when(matches("_name", rules), first_match("_name", rules))
    if ruleset == "aggressive":
        hit = F.when(F.length("_name") < 3, "too short").otherwise(
            F.coalesce(hit, F.when(F.lower("_name").isin(*GENERIC_WORDS), "generic word")))
    return d.withColumn(out, hit).drop("_name")


def drop_non_products(df: DataFrame, ruleset: str = "aggressive") -> DataFrame:
    """Keep rows whose model name passes; a boolean alternation, no per-rule work on kept rows."""
    name = js_trim(F.coalesce(c("model"), F.lit("")))
    if ruleset == "final":
        return df.filter(~matches(name, FINAL))
    return df.filter((F.length(name) >= 3) & ~matches(name, AGGRESSIVE) & ~F.lower(name).isin(*GENERIC_WORDS))


def reject_reason(model: str = "model") -> Column:
    """Deep clean-up: first reason in the order invalidModel, categoryPage, noSpecs, tooShortModel."""
    name = js_trim(F.coalesce(c(model), F.lit("")))
    filled = lambda f: F.coalesce(not_blank(f), F.lit(False))
    specs = any_of([filled(f) for f in ("loadCapacity", "liftingSpeed", "motorPower")])
    data = specs | has_list("classification") | filled("dutyCycle") | filled("weight")
    return (F.when(matches(name, DEEP_INVALID), "invalidModel")
            .when(~specs & matches(name, DEEP_CATEGORY), "categoryPage")
            .when(~data, "noSpecs")
            .when(~specs & ((F.length(name) < 3) | name.rlike("(?i)^[a-z]+$")), "tooShortModel"))


def url_fanout(df: DataFrame, out: str = "url_count", url: str = "url") -> DataFrame:
    """Number of rows that share each row's URL.

    Counted by a partially aggregated groupBy and joined back, so a URL used by a third of all rows is one counter,
    not one window partition; AQE splits the skewed join side. Rows without a URL get 0.
    """
    n = df.filter(c(url).isNotNull()).groupBy(url).agg(F.count("*").alias(out))
    return df.join(n, url, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def is_category_model(report: bool = False) -> Column:
    m = F.lower(F.coalesce(c("model"), F.lit("")))
    if report:
        return any_of([m.contains(w) for w in ("category", "view all", "products")]) | m.isin("hoists", "s") | (F.length(m) < 3)
    m = js_trim(m)
    return (F.length(m) < 3) | m.isin("s", "hoists") | m.contains("view all") | m.contains("category")


def category_pages(df: DataFrame, max_uses: int = 5) -> DataFrame:
    """Rows that look like category pages (report rule)."""
    counted = url_fanout(df)
    return counted.filter(is_category_model(True) | (F.col("url_count") > max_uses))


def drop_category_pages(df: DataFrame, max_uses: int = 10) -> DataFrame:
    counted = url_fanout(df)
    over = truthy("url") & (F.col("url_count") > max_uses)
    return counted.filter(~is_category_model() & ~over).drop("url_count")


def is_stale(now, days: int = 90, col: str = "lastUpdated") -> Column:
    now = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    return c(col).isNull() | (c(col) < now - F.make_dt_interval(F.lit(days)))


def stale(df: DataFrame, now, days: int = 90, col: str = "lastUpdated") -> DataFrame:
    return df.filter(is_stale(now, days, col))


def stale_by_vendor(df: DataFrame, now, days: int = 90, k: int | None = None) -> DataFrame:
    n = stale(df, now, days).groupBy("manufacturer").agg(F.count("*").alias("n"))
    return limited(n.orderBy(F.col("n").desc(), "manufacturer"), k)


def candidates(df: DataFrame, kind: str, vendor: str | None = None) -> DataFrame:
    """Rows worth another visit: ``rescrape``, ``images``, ``pdfs``, ``unique_url`` or ``vendor_pdfs``."""
    m = F.lower(F.coalesce(c("model"), F.lit("")))
    if kind == "rescrape":
        return df.filter(~truthy("loadCapacity") & truthy("url") & ~m.contains("category") & ~m.contains("view all")
                         & any_of([m.contains(w) for w in HOIST_WORDS]))
    if kind == "images":
        path, _ = _url_parts()
        shown = F.when(path == "", "/").otherwise(path)
        return df.filter(~has_list("images") & F.coalesce(c("url").startswith("http") & (F.length(shown) > 2), F.lit(False)))
    if kind == "pdfs":
        return df.filter(~truthy("loadCapacity") & has_list("pdfs") & ~has_list("downloadedPDFs"))
    if kind == "unique_url":
        counted = url_fanout(df)
        return counted.filter(~truthy("loadCapacity") & truthy("url") & (F.col("url_count") <= 3)).drop("url_count")
    if kind == "vendor_pdfs":
        done = F.coalesce(c("pdfExtracted"), F.lit(False)) if "pdfExtracted" in df.columns else F.lit(False)
        return df.filter((c("manufacturer") == vendor) & has_list("pdfs") & ~(done & truthy("loadCapacity")))
    raise ValueError(f"unknown kind {kind}")
