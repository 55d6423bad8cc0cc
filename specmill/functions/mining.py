"""Specifications, sizes and weights mined from running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, js_trim

# fixed values: size patterns
DIMENSION_PATTERNS = [
    r'dimensions?\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|inch|inches|")',
    r"(\d+(?:\.\d+)?)\s*(mm|cm|m|in)?\s*[x×]\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in)?\s*[x×]\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in)",
    r"size\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*[x×]?\s*(\d+(?:\.\d+)?)?\s*(mm|cm|m|in)?",
    r"length\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in)",
    r"width\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in)",
    r"height\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in)",
    r'headroom\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|")',
    r"overall\s+dimensions?\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*[x×]?\s*(\d+(?:\.\d+)?)?\s*(mm|cm|m)?",
    r"abmessungen\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*[x×]?\s*(\d+(?:\.\d+)?)?\s*(mm|cm|m)?",
    r"ma[ßs]e\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*[x×]?\s*(\d+(?:\.\d+)?)?\s*(mm|cm|m)?",
]

# fixed values: weight patterns
WEIGHT_PATTERNS = [
    r"weight\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(kg|lbs?|pounds?)",
    r"net\s+weight\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(kg|lbs?)",
    r"mass\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(kg|lbs?)",
    r"gewicht\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(kg|lbs?)",
    r"(\d+(?:\.\d+)?)\s*(kg|lbs?)\s*(?:net|gross)?",
]

# fixed values: labelled specification patterns of a page text
SPEC_PATTERNS = {
    "loadCapacity": r"capacity[:\s]*(\d+(?:\.\d+)?)\s*(kg|lbs?|tons?)",
    "liftingSpeed": r"(?:lifting\s*)?speed[:\s]*(\d+(?:\.\d+)?)\s*(m/min|fpm|mm/s)",
    "motorPower": r"(?:motor\s*)?power[:\s]*(\d+(?:\.\d+)?)\s*(kw|hp|w)",
    "voltage": r"voltage[:\s]*(\d+(?:/\d+)?)\s*v",
    "weight": r"weight[:\s]*(\d+(?:\.\d+)?)\s*(kg|lbs?)",
    "chainFall": r"chain\s*fall[:\s]*(\d+)",
    "dutyCycle": r"duty\s*(?:cycle)?[:\s]*(\w+)",
}

# target field -> words of which one must occur, words that must all occur, words that must not
# fixed values, in their natural order
SPEC_KEYS = {
    "loadCapacity": (["capacity", "load", "swl"], [], []),
    "liftingSpeed": ([], ["speed", "lift"], []),
    "motorPower": (["power", "motor"], [], []),
    "weight": (["weight"], [], ["load"]),
    "voltageOptions": (["voltage"], [], []),
    "dutyCycle": (["duty", "cycle"], [], []),
    "noiseLevel": (["noise", "sound"], [], []),
}


# words of which one must occur for a pattern to match at all
DIMENSION_HINTS = [["dimension"], ["x", "×"], ["size"], ["length"], ["width"], ["height"], ["headroom"], ["overall"], ["abmessungen"],
                   ["maße", "mase"]]
WEIGHT_HINTS = [["weight"], ["net"], ["mass"], ["gewicht"], ["kg", "lb"]]


def _all_matches(text, patterns, hints, low) -> Column:
    """Matches of all patterns in list order. A plain substring test settles most patterns without running them."""
    empty = F.array().cast("array<string>")
    low = F.lower(c(text)) if low is None else c(low)
    found = []
    for p, words in zip(patterns, hints or [[]] * len(patterns)):
        hits = F.regexp_extract_all(c(text), F.lit("(?i)" + p), F.lit(0))
        if words:
            may = low.contains(words[0])
            for w in words[1:]:
                may = may | low.contains(w)
            hits = F.when(may, hits).otherwise(empty)
        found.append(hits)
    return F.transform(F.coalesce(F.flatten(F.array(*found)), empty), js_trim)


def mine_dimensions(text, patterns=tuple(DIMENSION_PATTERNS), hints=None, low=None) -> Column:
    """Every size expression, grouped by pattern, in text order within a pattern. ``low`` may name a column that holds
    the lower-case text; ``hints`` go with the patterns."""
    if hints is None and tuple(patterns) == tuple(DIMENSION_PATTERNS):
        hints = DIMENSION_HINTS
    return _all_matches(text, patterns, hints, low)


def mine_weights(text, patterns=tuple(WEIGHT_PATTERNS), hints=None, low=None) -> Column:
    """Every weight expression; figures that read as a year (19dd, 20dd) are dropped."""
    if hints is None and tuple(patterns) == tuple(WEIGHT_PATTERNS):
        hints = WEIGHT_HINTS
    return F.filter(_all_matches(text, patterns, hints, low), lambda w: ~w.rlike(r"19\d{2}|20\d{2}"))


# a word every match of the pattern contains
SPEC_HINTS = {"loadCapacity": "capacity", "liftingSpeed": "speed", "motorPower": "power", "voltage": "voltage", "weight": "weight",
              "chainFall": "chain", "dutyCycle": "duty"}


def mine_specs(text, patterns: dict[str, str] | None = None, low=None) -> Column:
    """Struct with the first labelled match per field, NULL when absent."""
    hints = SPEC_HINTS if patterns is None else {}
    low = F.lower(c(text)) if low is None else c(low)
    out = []
    for f, p in (patterns or SPEC_PATTERNS).items():
        # through a one-element list the match is evaluated once and an empty one becomes NULL
        hit = F.filter(F.array(F.regexp_extract(c(text), "(?i)" + p, 0)), lambda m: m != "")
        v = js_trim(F.try_element_at(hit, F.lit(1)))
        out.append((F.when(low.contains(hints[f]), v) if f in hints else v).alias(f))
    return F.struct(*out)


def map_specs(specs, keys: dict | None = None) -> Column:
    """Free-form specification map -> struct of known fields; among several fitting keys the last wins."""
    def fits(any_words, all_words, none_words):
        def test(k, v):
            cond = F.lit(True)
            if any_words:
                hit = F.lit(False)
                for w in any_words:
                    hit = hit | k.contains(w)
                cond = cond & hit
            for w in all_words:
                cond = cond & k.contains(w)
            for w in none_words:
                cond = cond & ~k.contains(w)
            return cond

        return test

    return F.struct(*[
        F.try_element_at(F.map_values(F.map_filter(c(specs), fits(*rule))), F.lit(-1)).alias(f)
        for f, rule in (keys or SPEC_KEYS).items()])


def best_dimension(found) -> Column:
    """Longest size expression of more than ten characters; the earlier one on equal length."""
    return longest(F.filter(c(found), lambda d: F.length(d) > 10))


def best_weight(found) -> Column:
    """Longest kilogram expression, else the first one found."""
    kg = F.filter(c(found), lambda w: w.rlike(r"(?i)\d+(?:\.\d+)?\s*kg"))
    return F.coalesce(longest(kg), F.try_element_at(c(found), F.lit(1)))


def longest(arr) -> Column:
    ranked = F.transform(arr, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.array_max(ranked)["s"]
