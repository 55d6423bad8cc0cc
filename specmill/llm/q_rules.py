"""op5: quality rules on all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records, rules


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(records.as_catalog(records.documents(spark, sf_dir)))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
split_words AS (SELECT row_id, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT row_id, i, [w[i], w[i + 1], w[i + 2]] AS g
            FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM split_words WHERE len(w) > 3)),
twice AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY row_id),
measured AS (SELECT s.doc_id, s.t, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
             FROM split_words s LEFT JOIN repeated r USING (row_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND 10 * n_symbols <= n_words
       AND 3 * n_dup_lines <= len(string_split(t, chr(10)))
       AND 10 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) >= 6 * word_chars
       AND 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) <= word_chars AS kept
FROM based
"""
