"""Bands and bins from data: edges by exact percentiles, equal-count bins by a distributed rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordered import quantile_list, with_global_rank


def quantile_edges(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Distinct exact percentiles; a few numbers on the driver."""
    return sorted(set(quantile_list(df, column, probabilities)))


def cut(value: Column, edges: Sequence[float], open_ends: bool = False) -> Column:
    """Band from 1, closed on the right with the lowest edge included; null outside (or the end band, with open ends)."""
    last = len(edges) - 1
    found = F.lit(None).cast("int")
    for i in range(last, 0, -1):
        low, high = edges[i - 1], edges[i]
        above = F.lit(True) if open_ends and i == 1 else (value >= low if i == 1 else value > low)
        below = F.lit(True) if open_ends and i == last else value <= high
        found = F.when(above & below, i).otherwise(found)
    return F.when(value.isNotNull(), found)


def quantile_bands(df: DataFrame, column: str, bins: int, name: str = "band") -> DataFrame:
    """Value-quantile bands: equal edges fall together."""
    edges = quantile_edges(df, column, [i / bins for i in range(bins + 1)])
    return df.withColumn(name, cut(F.col(column), edges))


def rank_bins(df: DataFrame, column: str, key: str, bins: int, name: str = "bin") -> DataFrame:
    """Equal-count bins of the ranks, ties in the order of a unique key. Null values have no bin."""
    known = df.where(F.col(column).isNotNull())
    ranked, n = with_global_rank(known, [column, key], "__rank")
    place = F.col("__rank") - 1
    bin_of = F.greatest(F.lit(1), F.ceil(place * bins / F.lit(max(n - 1, 1)))).cast("int")
    return ranked.withColumn(name, bin_of).drop("__rank")
