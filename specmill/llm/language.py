"""Language of descriptions by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
#: A thorough search first; a quick one, which weighs matches differently, decides where the first leaves a narrow margin.
THOROUGH = {"strategy": zstandard.STRATEGY_BTLAZY2, "min_match": 4, "window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 3, "target_length": 16}
QUICK = {"strategy": zstandard.STRATEGY_DFAST, "min_match": 4, "window_log": 18, "hash_log": 17, "chain_log": 17}


class Compressors:
    """One compressor with a raw-content dictionary per language."""

    def __init__(self, dictionaries: dict[str, bytes], search: dict = THOROUGH, block: int = BLOCK):
        self.block, self.by = block, {}
        params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **search)
        for name in sorted(dictionaries):
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by[name] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)

    def sizes(self, text: str) -> dict[str, int]:
        """Bytes per language: the whole text, in blocks that are compressed one by one so that the dictionary counts throughout."""
        data = text.lower().encode("utf-8", "surrogatepass")
        blocks = [data[i:i + self.block] for i in range(0, len(data), self.block)]
        return {k: sum(len(c.compress(b)) for b in blocks) for k, c in self.by.items()}


def classify(text: str | None, looks: list[Compressors], narrow: float) -> tuple[str, float, bool]:
    """(language, score, rejected). Each look adds its sizes while the margin is narrow; ties go to the first name."""
    if not text or not any(map(str.isalpha, text)) or not looks[0].by:
        return "und", 0.0, True
    total = dict.fromkeys(looks[0].by, 0)
    for look in looks:
        for k, n in look.sizes(text).items():
            total[k] += n
        ranked = sorted((n, k) for k, n in total.items())
        margin = (ranked[1][0] if len(ranked) > 1 else 2 * ranked[0][0] + 8) - ranked[0][0]
        if margin >= narrow:
            break
    return ranked[0][1], 1 / (1 + 2.0 ** -min(margin, 60)), margin < narrow


def fit_languages(catalog: DataFrame, id: str = "id", description: str = "description", language: str = "language",
                  texts: int = 256, chars: int = 512) -> dict[str, bytes]:
    """Dictionary content per language, from records with a language.

    About ``texts`` records per language, chosen by a hash of the id, give up to ``chars`` characters each, from a place that the hash
    chooses as well: what comes to the driver is bounded by languages x texts x chars. Records without id, language or text are left out.
    """
    rows = catalog.select(F.xxhash64(F.col(id), F.lit(17)).alias("h"), F.col(description).alias("text"), F.col(language).alias("language")).where(
        F.col(id).isNotNull() & F.col(language).isNotNull() & (F.length(description) > 0))
    counts = {r["language"]: r["n"] for r in rows.groupBy("language").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col("language") == k, int(min(1.0, 1.25 * texts / n) * (1 << 30))).otherwise(share)
    begin = F.pmod(F.shiftright("h", 8), F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    got: dict[str, list] = {k: [] for k in counts}
    for r in rows.where(F.pmod("h", F.lit(1 << 30)) < share).select("language", "h", F.substring("text", begin, F.lit(chars)).alias("part")).collect():
        got[r["language"]].append((r["h"], r["part"]))
    return {k: "\n".join(p for _, p in sorted(v)[:texts]).lower().encode("utf-8", "surrogatepass") for k, v in got.items() if v}


def _classifier(dictionaries: dict[str, bytes], narrow: float):
    @F.pandas_udf("language string, score double, rejected boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        looks = [Compressors(dictionaries), Compressors(dictionaries, QUICK)]
        for texts in batches:
            yield pd.DataFrame([classify(t, looks, narrow) for t in texts], columns=["language", "score", "rejected"])

    return found


def identify_language(catalog: DataFrame, dictionaries: dict[str, bytes], id: str = "id", description: str = "description",
                      narrow: float = 1) -> DataFrame:
    """One row (id, language, score, rejected) per record, from whole descriptions. No shuffle.

    ``score`` is 1 / (1 + 2 ** -margin), the margin being the bytes between the smallest and the next size. ``rejected``: the margin
    is under ``narrow`` bytes, also after a second look with another search. A description that is null or has no letter is ``und`` with score 0, and rejected. With one
    language only, that one is chosen. Repeated records give repeated rows; other columns are ignored.
    """
    found = _classifier(dictionaries, narrow)
    return catalog.select(F.col(id).alias("id"), found(F.col(description)).alias("f")).select("id", "f.*")


def keep_identified(catalog: DataFrame, dictionaries: dict[str, bytes], description: str = "description", narrow: float = 1) -> DataFrame:
    """The records whose language is clear, all columns as they are."""
    return catalog.where(~_classifier(dictionaries, narrow)(F.col(description))["rejected"])
