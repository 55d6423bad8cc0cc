"""Column helpers that pin down JavaScript-style text semantics once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace as the source data means it: Unicode spaces and the byte order mark included
SPACES = " \t\n\u000b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = r"[\s\u00A0\uFEFF]"
NUM = r"(\d+(?:\.\d+)?)"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(x) -> Column:
    return F.btrim(c(x), F.lit(SPACES))


def not_blank(x) -> Column:
    """Some character other than white space; stops at the first one."""
    return c(x).rlike(r"[^\s\u00A0\uFEFF]")


def extract(x, pattern: str, group: int = 1) -> Column:
    """First match, NULL (not '') when nothing matches."""
    return F.nullif(F.regexp_extract(c(x), pattern, group), F.lit(""))


def number(x, pattern: str, group: int = 1) -> Column:
    """Numeric capture of the first match as DOUBLE; no match gives '', which casts to NULL."""
    return F.regexp_extract(c(x), pattern, group).try_cast("double")


def js_number(x) -> Column:
    """Number to text without a trailing ``.0`` or exponent, whole digits for large numbers (beyond 38 digits as written)."""
    x = c(x)
    plain = F.regexp_replace(x.try_cast("decimal(38,9)").cast("string"), r"\.?0+$", "")
    whole = x.try_cast("decimal(38,0)")
    return F.when(whole.isNull(), x.cast("string")).when(whole == x, whole.cast("string")).otherwise(plain)


def int_text(x) -> Column:
    """Text of a number that is known to be whole."""
    return F.coalesce(c(x).try_cast("decimal(38,0)").cast("string"), c(x).cast("string"))


def js_round(x) -> Column:
    """Half toward +infinity; numbers beyond 2^53 are whole as they are."""
    return F.when(F.abs(c(x)) < 2.0 ** 53, F.floor(c(x) + F.lit(0.5)).cast("double")).otherwise(c(x).cast("double"))


def to_fixed(x, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c(x))


def blank_to_null(x) -> Column:
    """The spellings of 'missing' (NULL, blank, '-') become NULL."""
    t = js_trim(x)
    return F.when((t != "") & (t != "-"), c(x))


def truthy(x) -> Column:
    """Non-null and non-empty text."""
    return F.coalesce(c(x) != "", F.lit(False))


def has(x, needle) -> Column:
    """NULL-safe case-insensitive substring test; ``needle`` is a python string."""
    return F.coalesce(F.lower(c(x)).contains(needle.lower()), F.lit(False))


def any_of(cols) -> Column:
    return reduce(lambda a, b: a | b, cols)


def all_of(cols) -> Column:
    return reduce(lambda a, b: a & b, cols)


def count_true(cols) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(False)).cast("int") for x in cols])


def matches(x, patterns: list[str]) -> Column:
    """True when any case-insensitive pattern matches: one alternation, one regex pass."""
    return F.coalesce(c(x).rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def first_match(x: str, patterns: list[str]) -> Column:
    """First matching pattern of the list for a column name, labelled ``/pattern/i``; NULL when none.

    One test per pattern, so callers guard it by ``matches``, which settles the common case in one pass. Written as one
    SQL expression: a chain of this length is slow to put together call by call.
    """
    q = lambda t: "r'" + t.replace("'", "\\'") + "'"
    tests = " ".join(f"WHEN `{x}` RLIKE {q('(?iu)' + p)} THEN {q(match_label(p))}" for p in patterns)
    return F.expr(f"CASE {tests} END")


def match_label(p: str) -> str:
    return "/" + p.replace("/", "\\/") + "/i"


def truncate_text(x, n: int, marker: str = "...") -> Column:
    """Keep whole texts up to n characters; longer ones are a display excerpt with a marker."""
    x = c(x)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(marker))).otherwise(x)


def lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in d.items() for v in kv])


def lookup(x, d: dict) -> Column:
    """Literal dictionary lookup, NULL for unknown keys."""
    return F.try_element_at(lit_map(d), c(x))


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 text in lower-case hex: the key under which results of a text are kept. Null has none."""
    return F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256)
