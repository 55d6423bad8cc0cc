"""Secret scan: all rules in one pass over the bytes of a text, on one minimal automaton."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Dfa, compile_rules


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost and longest; matches with under ``least`` characters are dropped.

    The characters that count are the whole match, or with ``value`` what follows the first ``:`` or ``=`` and its blanks and quote.
    ``screen`` is what the common automaton looks for: anything that each kept match ends with.
    """

    kind: str
    pattern: str
    least: int = 1
    either_case: bool = False
    value: bool = False
    screen: str | None = None


# The three base kinds, as the contract of the query states them.
BASE = (
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, screen=r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("url_login", r"://[A-Za-z0-9._%+-]+:[^\x00-\x20/@:]+@"),
)
RULES = BASE + MORE
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> tuple[Dfa, list[Dfa]]:
    """Common automaton, and one per rule for the few places where the common one has accepted."""
    common = compile_rules([(r.screen or r.pattern, r.either_case) for r in rules])
    return common, [compile_rules([(r.pattern, r.either_case)], anywhere=False) for r in rules]


def _regions(common: Dfa, data: bytes) -> list[tuple[int, int]]:
    """Stretches between two places where no rule is under way, if a rule has accepted within."""
    table, accepting, s, start, hit, out = common.table, common.accepting, 0, 0, False, []
    for i, c in enumerate(data.translate(common.classes)):
        s = table[s + c]
        if not s:
            if hit:
                out.append((start, i))
                hit = False
            start = i + 1
        elif s >= accepting:
            hit = True
    if hit:
        out.append((start, len(data)))
    return out


def _kept(rule: Rule, match: bytes) -> bool:
    if rule.value:
        cut = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
        match = match[cut + 1:].lstrip(b" ")
        match = match[1:] if match[:1] in (b'"', b"'") else match
    return len(match) >= rule.least


def find_spans(text: str | None, rules: tuple[Rule, ...] = RULES, compiled: tuple[Dfa, list[Dfa]] | None = None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then in the order of the rules."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    common, single = compiled or _compiled(rules)
    out, done, chars = [], 0, 0
    for begin, end in _regions(common, data):
        found, part = [], data[begin:end]
        for n, (rule, dfa) in enumerate(zip(rules, single)):
            shown, i, failed = part.translate(dfa.classes), 0, set()
            while i < len(part):  # a match that is too short still takes its characters
                stop = dfa.longest(shown, i, len(part), failed)
                if stop > i and _kept(rule, part[i:stop]):
                    found.append((i, n, stop))
                i = max(stop, i + 1)
        if found:
            chars += _points(data[done:begin])
            done = begin
            out += [(rules[n].kind, chars + _points(part[:i]), chars + _points(part[:stop])) for i, n, stop in sorted(found)]
    return out


def _points(data: bytes) -> int:
    return len(data) if data.isascii() else sum(b & 0xC0 != 0x80 for b in data)


def scan_secrets(catalog: DataFrame, id: str = "id", description: str = "description", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Secrets in the descriptions of catalogue records: one row (id, description, secrets) per record.

    ``secrets`` lists (kind, start, end) in code points, end exclusive, by start and then in the order of ``rules``. Per kind,
    matches are leftmost, longest and do not overlap; a match that is too short is dropped and its characters stay taken. Whole
    texts are read, in one pass of the automaton that holds all rules. No shuffle.

    A null or empty description has no secrets. Repeated records give repeated rows; other columns are ignored.
    """
    compiled = _compiled(rules)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, rules, compiled)] for t in texts], dtype=object)

    return catalog.select(F.col(id).alias("id"), F.col(description).alias("description")).withColumn("secrets", spans("description"))


def mask_secrets(catalog: DataFrame, id: str = "id", description: str = "description", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Catalogue records with each stretch of secrets in ``description`` replaced by ``<kind>``; all columns stay.

    Overlapping spans are one stretch, named by the first. Null stays null; a text without secrets stays as it is.
    """
    compiled = _compiled(rules)

    @F.pandas_udf(T.StringType())
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, find_spans(t, rules, compiled)) for t in texts], dtype=object)

    return catalog.withColumn(description, masked(F.col(description)))


def _masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return text if not spans else "".join(out) + text[at:]
