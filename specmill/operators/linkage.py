"""Linking products to rules, documents and images by names.

Containment of one name in another is an equi-join on one short gram of the inner name, its rarest among the outer names,
and a test of the pairs found. Names are made distinct before they are compared, and a hot vendor is spread over its grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import match_confidence, match_key, slug
from ..functions.text import c, js_trim, truthy
from ..functions.units import capacity_any_unit
from ..functions.values import estimate_power, is_placeholder
from ..session import cut
from .merge import last_per_key
from .tidy import top_k

# fixed values: vendor part, model part, power; first match wins
POWER_RULES = [
    ("columbus mckinnon", "lodestar 250", "0.55 kW (0.7 HP)"),
    ("columbus mckinnon", "lodestar 500", "1.1 kW (1.5 HP)"),
    ("columbus mckinnon", "lodestar 1000", "1.5 kW (2.0 HP)"),
    ("columbus mckinnon", "lodestar 2000", "2.2 kW (3.0 HP)"),
    ("abus kransysteme", "gm2", "0.25 kW"),
    ("abus kransysteme", "gm4", "0.55 kW"),
    ("abus kransysteme", "gm6", "1.1 kW"),
    ("abus kransysteme", "gm8", "2.2 kW"),
    ("abus kransysteme", "abucompact gm2", "0.25 kW"),
    ("abus kransysteme", "abucompact gm4", "0.55 kW"),
    ("abus kransysteme", "abucompact gm6", "1.1 kW"),
    ("abus kransysteme", "abucompact gmc", "0.18 kW"),
    ("demag", "dc-com", "0.18-1.5 kW"),
    ("demag", "dc-pro", "0.25-15 kW"),
    ("demag", "dc chain hoists", "0.18-15 kW"),
    ("kito", "er2", "0.4-3.7 kW"),
    ("kito", "eq", "0.3-2.2 kW"),
    ("yale hoists", "cpe", "0.25-2.2 kW"),
    ("j.d. neuhaus", "profi", "Pneumatic"),
    ("j.d. neuhaus", "mini", "Pneumatic"),
]

# fixed values: vendor part, brand, website; first match wins
BRANDS = [
    ("Lodestar", "CM Lodestar", "https://www.columbusmckinnon.com"),
    ("Liftket", "Liftket", "https://liftket.com"),
    ("Kinesys", "Kinesys", "https://www.kinesys.com"),
    ("EXE", "EXE Technology", "https://www.exetechnology.com"),
    ("Prolyft", "Prolyft (Prolyte)", "https://www.prolyte.com"),
    ("GIS", "GIS AG", "https://gis-ag.ch"),
    ("Chainmaster", "Chainmaster", "https://www.chainmaster.de"),
    ("WiMotion", "Wicreations", "https://www.wicreations.com"),
    ("Atlanta Rigging Systems", "Atlanta Rigging Systems", "https://www.atlantarigging.com"),
]


def with_maker(df: DataFrame, makers: DataFrame) -> DataFrame:
    """Vendor name by id from the maker dictionary; ``Unknown (id)`` for ids it lacks."""
    order = ["_pos"] if "_pos" in makers.columns else []  # an id that occurs twice keeps its last name
    makers = last_per_key(makers.select("manufacturerId", "fullName", *order), "manufacturerId")
    names = makers.select("manufacturerId", js_trim(F.regexp_replace("fullName", r"^\d+\s*-\s*", "")).alias("_n"),
                          c("fullName").alias("manufacturerFullName"))
    unknown = F.concat(F.lit("Unknown ("), F.col("manufacturerId"), F.lit(")"))
    return (df.join(names, "manufacturerId", "left")
            .withColumn("manufacturer", F.coalesce("_n", unknown)).drop("_n"))


def _first_rule(conds: list[tuple[Column, Column]]) -> Column:
    out = None
    for cond, v in conds:
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def with_brand(df: DataFrame, brands=tuple(BRANDS), vendor: str = "manufacturer") -> DataFrame:
    """Brand and website of the first rule whose part occurs in the vendor name (case-insensitive); rules are literals
    of the plan, so no join is needed."""
    low = F.lower(F.coalesce(c(vendor), F.lit("")))
    hits = [low.contains(p.lower()) for p, _, _ in brands]
    return df.withColumns({
        "manufacturerBrand": _first_rule([(h, F.lit(b)) for h, (_, b, _) in zip(hits, brands)]),
        "manufacturerWebsite": _first_rule([(h, F.lit(w)) for h, (_, _, w) in zip(hits, brands)])})


def fill_power(df: DataFrame, rules=tuple(POWER_RULES), mode: str = "compat") -> DataFrame:
    """Motor power from the first fitting rule, else an estimate by capacity; ``power_status`` says which."""
    low = lambda x: F.lower(F.coalesce(c(x), F.lit("")))
    # texts and the parsed load become columns first: the rule chain below refers to them many times
    d = df.withColumns({"_m": low("manufacturer"), "_n": low("model"),
                        "_kg": F.nullif(capacity_any_unit("loadCapacity", mode), F.lit(0.0)),
                        "_had": truthy("motorPower") & ~is_placeholder("motorPower"),
                        "power_cleaned": truthy("motorPower") & is_placeholder("motorPower")})
    known = _first_rule([(c("_m").contains(a) & c("_n").contains(b), F.lit(p)) for a, b, p in rules])
    d = d.withColumns({"_known": known, "_guess": estimate_power("_kg")})
    had, known, guess = c("_had"), c("_known"), c("_guess")
    return d.withColumns({
        "power_status": F.when(had, "had").when(known.isNotNull(), "known").when(guess.isNotNull(), "estimated")
                         .otherwise("unchanged"),
        "motorPower": F.when(had, c("motorPower")).when(known.isNotNull(), known)
                       .when(guess.isNotNull(), F.concat(guess, F.lit(" (estimated)")))
                       .when(c("power_cleaned"), "").otherwise(c("motorPower"))}).drop("_m", "_n", "_kg", "_had", "_known", "_guess")


GRAM = 4


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of two sides that grow with the input: by shuffle and sort. A side that looks small, as names compress well, would else be
    collected and built up by the driver, several at once."""
    return left.join(right.hint("merge"), on, how)


def _grams(x, size) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substr(c(x), i, size)))


def containment(inner: DataFrame, outer: DataFrame, s: str, t: str, on: list[str]) -> DataFrame:
    """All pairs with equal ``on`` columns where text ``t`` contains the non-empty text ``s``.

    ``t`` gives its grams of four characters, and of fewer where some ``s`` is that short; ``s`` gives the one of its grams that the
    fewest ``t`` have. Pairs that share it are tested. The work grows with the length of the texts, not with its square.
    """
    a, b = inner.filter(F.length(s) > 0), outer.filter(F.length(t) > 0)
    size = F.least(F.length(s), F.lit(GRAM))
    sizes = a.select(size.alias("_q")).distinct()  # at most four rows
    spread = (b.withColumn("_q", F.explode(F.sequence(F.lit(1), F.least(F.length(t), F.lit(GRAM))))).join(F.broadcast(sizes), "_q")
              .withColumn("_g", F.explode(_grams(t, F.col("_q")))).drop("_q"))
    counts = spread.groupBy(*on, "_g").agg(F.count("*").alias("_n"))
    own = _merged(a.withColumn("_g", F.explode(_grams(s, size))), counts, [*on, "_g"], "left")
    # a gram that no outer text has rules the name out
    rare = own.groupBy(*inner.columns).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_m")).filter("_m.n > 0")
    return _merged(rare.withColumn("_g", F.col("_m._g")).drop("_m"), spread, [*on, "_g"]).filter(F.col(t).contains(F.col(s))).drop("_g")


def vendor_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) where either vendor name contains the other."""
    x, y = left.select(a).distinct(), right.select(b).distinct()
    one = containment(x, y, a, b, []).select(a, b)
    two = containment(y, x, b, a, []).select(a, b).filter(F.col(a) != F.col(b))
    return one.unionByName(two)


def link_docs(products: DataFrame, docs: DataFrame, compat: bool = False) -> DataFrame:
    """(filename, id) pairs: vendor names contain one another, and the document's product name and the model or series
    contain one another. ``docs`` has (filename, vendor, product). With ``compat`` an empty model or series counts as
    contained in everything, so it links all documents of the vendor."""
    p = products.select("id", F.lower(F.coalesce("manufacturer", F.lit(""))).alias("pv"),
                        F.lower(F.coalesce("model", F.lit(""))).alias("model"),
                        F.lower(F.coalesce("series", F.lit(""))).alias("series"))
    d = docs.select("filename", *[F.replace(F.lower(x), F.lit("-"), F.lit(" ")).alias(y)
                                  for x, y in (("vendor", "dv"), ("product", "dp"))])
    vp = vendor_pairs(d, p, "dv", "pv")
    if compat:  # an empty vendor name on either side is contained in every other
        vp = vp.unionByName(d.select("dv").distinct().withColumn("pv", F.lit("")).filter("dv != ''"))
        vp = vp.unionByName(p.select("pv").distinct().withColumn("dv", F.lit("")))
    vp = cut(vp)
    names = cut(p.select("pv", F.explode(F.array_distinct(F.array("model", "series"))).alias("name")).distinct())
    terms = cut(d.select("dv", "dp").distinct().join(vp, "dv").select("pv", "dp").distinct())
    hits = containment(terms, names, "dp", "name", ["pv"]).select("pv", "dp", "name")
    back = containment(names, terms, "name", "dp", ["pv"]).filter(F.col("name") != F.col("dp")).select("pv", "dp", "name")
    hits = hits.unionByName(back)
    if compat:
        empty = names.filter("name = ''").select("pv", "name")
        hits = hits.unionByName(terms.join(empty, "pv").select("pv", "dp", "name"))
        hits = hits.unionByName(names.filter("name != ''").join(terms.filter("dp = ''"), "pv").select("pv", "dp", "name"))
    # name hits -> products; a product reached by model and by series counts once
    files = d.join(vp, "dv").select("filename", "pv", "dp")
    by_name = p.select("id", "pv", F.explode(F.array_distinct(F.array("model", "series"))).alias("name"))
    reached = _merged(hits, by_name, ["pv", "name"]).select("pv", "dp", "id").distinct()
    return _merged(reached, files, ["pv", "dp"]).select("filename", "id")


def rank_matches(products: DataFrame, files: DataFrame, k: int = 5) -> DataFrame:
    """The k best products per file with a confidence, best first (earlier product on equal confidence).

    ``files``: filename, _pos, vendor, slug, ext_manufacturer, ext_model, ext_series. Confidence depends only on the names. So products
    are first reduced to the k earliest rows per (vendor, model, series): no more of them can reach the list. Files are reduced to
    their distinct names, ranked once each, and the lists are given to the files at the end.
    """
    low = lambda x: F.lower(F.coalesce(c(x), F.lit("")))
    p = products.select("id", "_pos", F.coalesce("manufacturer", F.lit("")).alias("manufacturer"), low("model").alias("model"),
                        low("series").alias("series"), match_key("manufacturer").alias("pk"))
    # the reduced products and the parsed files are read by several joins below, hence the cuts
    p = cut(top_k(p, ["manufacturer", "model", "series"], [c("_pos")], k, "_r").drop("_r"))
    parts = ["vendor", "slug", "em", "es", "fk", "ek"]
    named = files.select("filename", c("_pos").alias("_fpos"), F.coalesce("vendor", F.lit("")).alias("vendor"), low("slug").alias("slug"), low("ext_model").alias("em"),
                         low("ext_series").alias("es"), match_key("vendor").alias("fk"), match_key("ext_manufacturer").alias("ek"))
    named = cut(named.withColumn("spec", F.to_json(F.struct(*parts))))
    f = cut(named.select("spec", *parts).distinct())
    keys = p.select("pk").distinct()
    roles = lambda rs, out: F.inline(F.array(*[F.struct(F.lit(r).alias("role"), c(r).alias(out)) for r in rs]))
    vendor_terms = f.select("spec", roles(("fk", "ek"), "vt"))
    vt = vendor_terms.select("role", "vt").filter("vt != ''").distinct()
    inside = containment(vt, keys, "vt", "pk", []).select("role", "vt", "pk")
    around = containment(keys, vt.filter("role = 'fk'"), "pk", "vt", []).filter("pk != vt").select("role", "vt", "pk")
    vendors = vendor_terms.join(inside.unionByName(around), ["role", "vt"]).select("spec", "pk").distinct()
    # a file term (slug, extracted model or series) and a product name (model or series) of the same vendor
    terms = f.select("spec", roles(("slug", "em", "es"), "term")).filter("term != ''").join(vendors, "spec")
    distinct_terms = cut(terms.select("pk", "role", "term").distinct())
    listed = F.inline(F.array(*[F.struct(F.lit(x).alias("field"), c(x).alias("name")) for x in ("model", "series")]))
    names = p.select("pk", listed).filter("name != ''").distinct()
    cols = ["pk", "role", "term", "field", "name"]
    pairs = containment(distinct_terms, names, "term", "name", ["pk"]).filter("field = 'model' or role = 'es'").select(*cols)
    back = containment(names.filter("field = 'model'"), distinct_terms.filter("role != 'es'"), "name", "term", ["pk"])
    pairs = pairs.unionByName(back.filter("name != term").select(*cols))
    hits = _merged(pairs, terms, ["pk", "role", "term"]).select("spec", "pk", "field", "name").distinct()
    reached = _merged(hits, p.select("*", listed), ["pk", "field", "name"]).select("spec", "id", "_pos", "manufacturer", "model").distinct()
    scored = _merged(reached, f, ["spec"]).withColumn("confidence", match_confidence("manufacturer", "model", "vendor", "slug", "em"))
    best = top_k(scored, ["spec"], [c("confidence").desc(), c("_pos")], k).select("spec", "rank", "id", "confidence")
    return _merged(named, best, ["spec"]).select("filename", "_fpos", "rank", "id", "confidence")


def best_match(ranked: DataFrame, min_confidence: float = 0.6, failed: DataFrame | None = None) -> DataFrame:
    """Per product the first file (in file order) whose top match it is with enough confidence."""
    top = ranked.filter((c("rank") == 1) & (c("confidence") >= min_confidence))
    if failed is not None:
        top = top.join(failed.select("filename"), "filename", "left_anti")
    return top.groupBy("id").agg(F.min_by("filename", "_fpos").alias("filename"), F.min_by("confidence", "_fpos").alias("confidence"))


def link_by_id(products: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, key) where the key equals the id, is a '-'-bounded prefix of it, or starts with the id's first two tokens.
    Each rule is an equi-join; the third skips pairs of the first two, so no pair comes twice."""
    p = products.select("id").distinct()
    k = keys.select("key").distinct()
    parts = F.split("id", "-")
    bounded = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "-"))
    one = p.select("id", F.explode(bounded).alias("key")).join(k, "key").select("id", "key")
    heads = F.filter(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substr(F.col("key"), F.lit(1), i)),
                     lambda s: F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))) <= 1)
    kp = k.filter("key != ''").select("key", F.explode(heads).alias("head"))
    two = (p.withColumn("head", F.substring_index("id", "-", 2)).filter("head != ''").join(kp, "head")
           .filter(~((c("id") == c("key")) | c("id").startswith(F.concat("key", F.lit("-"))))).select("id", "key"))
    return one.unionByName(two)


def link_images(products: DataFrame, images: DataFrame, fallback: int = 3, compat: bool = False) -> DataFrame:
    """(id, url, page, index, how) links of local images to products of the same vendor.

    A page slug matches when it equals, contains or is contained in the model slug or the id slug, or when at least two
    of its tokens (longer than two letters) contain, or are contained in, tokens of the model slug. Products without any
    match and without images get the first ``fallback`` page slugs of the vendor that have an image 0.
    With ``compat`` a model without any letter or digit counts as contained in every page slug of its vendor.
    ``products``: id, manufacturer, model, n_images or images; ``images``: vendor, page, index, url.
    """
    im = images.select(c("vendor").alias("v"), F.lower("page").alias("ps"), "page", "index", "url")
    own = F.size("images") if "images" in products.columns else c("n_images")
    p = products.select("id", c("manufacturer").alias("v"), slug("model").alias("ms"),
                        F.lower(F.regexp_replace("id", "^[^-]+-", "")).alias("ds"), F.coalesce(own, F.lit(0)).alias("_own"))
    pages = cut(im.select("v", "ps").distinct())
    p = p.join(pages.select("v").distinct(), "v", "left_semi")
    names = cut(p.select("v", F.explode(F.array_distinct(F.array("ms", "ds"))).alias("name")).filter("name != ''").distinct())
    contained = containment(pages, names, "ps", "name", ["v"]).select("v", "ps", "name").unionByName(
        containment(names, pages, "name", "ps", ["v"]).filter("name != ps").select("v", "ps", "name"))
    by_name = p.select("id", "v", F.explode(F.array_distinct(F.array("ms", "ds"))).alias("name"))
    hits = _merged(contained, by_name, ["v", "name"]).select("v", "ps", "id")
    token_hits = _merged(_token_links(pages, p.select("v", "ms").filter("ms != ''").distinct()),
                         p.select("id", "v", "ms"), ["v", "ms"]).select("v", "ps", "id")
    linked = hits.unionByName(token_hits)
    if compat:
        linked = linked.unionByName(p.filter("ms = ''").join(pages, "v").select("v", "ps", "id"))
    linked = linked.distinct()
    found = _merged(linked, im, ["v", "ps"]).select("id", "url", "page", "index", F.lit("match").alias("how"))
    first = im.filter(c("index") == 0).groupBy("v", "page").agg(F.min("url").alias("url"))
    heads = top_k(first, ["v"], [F.collate(c("page"), "UNICODE")], fallback, "_r")
    bare = _merged(p.filter("_own = 0"), linked.select("id").distinct(), ["id"], "left_anti")
    spare = bare.join(heads, "v").select("id", "url", "page", F.lit(0).alias("index"), F.lit("fallback").alias("how"))
    return found.unionByName(spare)


def _token_links(pages: DataFrame, models: DataFrame) -> DataFrame:
    """(v, ps, ms) where at least two tokens of the page meet model tokens.

    Of a page's tokens the one that most models meet is set aside: a pair with two hits has one among the others. So a token that
    everything shares makes no candidates, and the candidates are tested with all tokens in the row.
    """
    toks = lambda x: F.filter(F.split(c(x), "-"), lambda t: F.length(t) > 2)
    listed = pages.withColumn("_ts", toks("ps")).filter(F.size("_ts") > 1)
    pt = listed.select("v", F.explode("_ts").alias("pt")).distinct()
    mt = models.select("v", "ms", F.explode(F.array_distinct(toks("ms"))).alias("mt"))
    vocab = mt.select("v", "mt").distinct()
    meets = containment(pt, vocab, "pt", "mt", ["v"]).select("v", "pt", "mt").unionByName(
        containment(vocab, pt, "mt", "pt", ["v"]).filter("mt != pt").select("v", "pt", "mt"))
    cover = cut(_merged(mt, meets, ["v", "mt"]).select("v", "ms", "pt").distinct())
    often = cover.groupBy("v", "pt").agg(F.count("*").alias("_n"))
    each = listed.select("v", "ps", F.posexplode("_ts").alias("_i", "pt"))
    each = _merged(each, often, ["v", "pt"])
    most = each.groupBy("v", "ps").agg(F.max_by("_i", F.struct("_n", "_i")).alias("_top"))
    rare = _merged(each, most, ["v", "ps"]).filter("_i != _top").select("v", "ps", "pt").distinct()
    cand = _merged(rare, cover, ["v", "pt"]).select("v", "ps", "ms").distinct()
    met = F.filter(toks("ps"), lambda t: F.exists(toks("ms"), lambda u: u.contains(t) | t.contains(u)))
    return cand.filter(F.size(met) > 1)
