"""Bounded samples of rated records, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import written


def labelled_sample(catalog: DataFrame, ratings: DataFrame, id: str, description: str, most: int) -> tuple[DataFrame, int]:
    """(id, description, rating) of about ``most`` rated records at most, as a written table, and about how many there are.

    The choice is by a hash of the id, so it is the same on every run. The chosen ratings are what is broadcast: their number
    is bounded by ``most`` (plus chance), so the records are read once and not shuffled. Ratings above 0 count as 1; a record
    rated twice counts with the larger one.
    """
    rated = ratings.where("id IS NOT NULL AND rating IS NOT NULL")
    total = rated.count()
    share = min(1.0, most / max(1, total))
    chosen = (rated.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
              .groupBy("id").agg(F.max((F.col("rating") > 0).cast("int")).alias("rating")))
    rows = catalog.select(F.col(id).alias("id"), F.col(description).alias("description"))
    return written(rows.join(F.broadcast(chosen), "id"), "sample"), min(total, most)
