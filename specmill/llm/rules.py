"""Quality rules of descriptions, as a short-circuit cascade: cheap rules that reject much come first."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS, SIGNS = r"[\x20\x09-\x0D]+", "#*$%&|<>"


def words(text: Column) -> Column:
    """Runs of anything but the six ASCII blanks."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _repeated(w: Column) -> Column:
    """Words that lie in a three-word window found more than once.

    Windows are compared by a 64-bit hash. The windows are sorted by hash once; those equal to a neighbour are repeated, and their
    places, sorted, cover three words each or as many as there are up to the next.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    marked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(w) < 4, 0).when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_covered(_twins(marked)))


def _twins(marked: Column) -> Column:
    """Places of the entries whose hash a neighbour shares, ascending."""
    def one(s):
        twin = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.array_sort(F.transform(twin, lambda x: x["i"]))

    return _let(marked, one)


def _covered(places: Column) -> Column:
    def one(p):
        steps = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return _let(places, one)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass(frozen=True)
class Rule:
    """``passes`` is a condition on description, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""

    name: str
    passes: Column


def base_rules() -> list[Rule]:
    # The limits that the contract of the query states.
    return [Rule("words", F.expr("n_words >= 50")), Rule("repeats", F.expr("100 * n_repeat_words <= 50 * n_words"))]


def more_rules() -> list[Rule]:
    return [
        Rule("word_length", F.expr("word_chars >= 2 * n_words AND word_chars <= 15 * n_words")),
        Rule("symbols", F.expr("10 * n_symbols <= n_words")),
        Rule("duplicate_lines", F.expr("3 * n_dup_lines <= size(split(description, '\n'))")),
        Rule("letters", F.expr("10 * length(regexp_replace(description, '[^\\\\p{L}]+', '')) >= 6 * word_chars")),
        Rule("capitals", F.expr("2 * length(regexp_replace(description, '[^\\\\p{Lu}]+', '')) <= word_chars")),
    ]


def measured(catalog: DataFrame, id: str = "id", description: str = "description") -> DataFrame:
    """One row per record: id, description, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. A projection, no shuffle.

    A null description is empty and has zeros throughout. Repeated records give repeated rows; other columns are ignored.
    """
    rows = catalog.select(F.col(id).alias("id"), F.coalesce(F.col(description), F.lit("")).alias("description"))
    text = F.col("description")

    def counted(w):
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"))

    lines = _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return rows.withColumn("w", _let(words(text), counted)).select(
        "id", "description", F.col("w.n_words").alias("n_words"), F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SIGNS, ""))).cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"))


def cascade_order(catalog: DataFrame, rules: list[Rule], id: str = "id", description: str = "description", sample: int = 1_000) -> list[Rule]:
    """The rules by rejections per second on about ``sample`` records, chosen by a hash of the id; rules that reject none come last.

    The order changes the cost only: a record is kept if all rules pass, in any order.
    """
    n = catalog.count()
    share = min(1.0, sample / max(1, n))
    held = measured(catalog.where(F.pmod(F.xxhash64(F.col(id), F.lit(23)), F.lit(1 << 30)) < int(share * (1 << 30))), id, description)
    rejected = held.agg(*(F.count_if(~r.passes).alias(r.name) for r in rules)).first()
    cost = {}
    for r in rules:
        began = time.perf_counter()
        held.agg(F.count_if(~r.passes)).first()
        cost[r.name] = time.perf_counter() - began
    return sorted(rules, key=lambda r: (-(rejected[r.name] or 0) / cost[r.name], r.name))


def judge(catalog: DataFrame, id: str = "id", description: str = "description", sample: int = 1_000) -> DataFrame:
    """One row per record: the measures of ``measured``, base_failed, kept, and n_rules, the number of further rules that were looked at.

    ``base_failed``: one of the base rules fails. ``kept``: base and further rules pass. The further rules run as nested conditions
    in the order of ``cascade_order``: a record that one rule has rejected is not given to the next, nor is one that a base rule has.
    """
    base, more = base_rules(), cascade_order(catalog, more_rules(), id, description, sample)
    failed = reduce(lambda a, b: a | b, (~r.passes for r in base))
    verdict = F.lit(True)
    for r in reversed(more):
        verdict = F.when(~r.passes, F.lit(False)).otherwise(verdict)
    return measured(catalog, id, description).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict))
