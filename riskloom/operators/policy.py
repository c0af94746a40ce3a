"""Scores and decision policy: points to double the odds, bands, limits, scenarios. All are expressions over rows and small parameter tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions import bands
from riskloom.operators.aggregates import r
from riskloom.operators.joins import expand_scenarios, small
from riskloom.operators.ordered import quantile_list


def pdo_score(p: Column, base: float = 500.0, pdo: float = 40.0, odds: float = 9.0, eps: float = 1e-6, clamp: tuple[float, float] | None = (0.0, 1000.0)) -> Column:
    """Base + pdo / ln 2 * (ln((1 - p) / p) - ln odds); a probability outside 0 to 1 is an error."""
    if pdo <= 0 or odds <= 0 or not 0 < eps < 0.5:
        raise ValueError("pdo and odds must be above zero, eps between 0 and one half")
    p = F.when(p.isNull() | p.between(0, 1), p).otherwise(F.raise_error(F.lit("probability isn't within 0 to 1")).cast("double"))
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    s = F.lit(base) + F.lit(pdo / math.log(2)) * (F.log((1 - q) / q) - math.log(odds))
    return s if clamp is None else F.when(p.isNotNull(), F.least(F.greatest(s, F.lit(clamp[0])), F.lit(clamp[1])))


def frozen_bands(development: DataFrame, score: str) -> list[float]:
    """Inner edges of five bands, pairs of the development sample's deciles."""
    return bands.quantile_edges(development, score, [0.2, 0.4, 0.6, 0.8])


def band_of(score: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bands closed on the left."""
    found = F.lit(labels[-1])
    for e, label in reversed(list(zip(edges, labels, strict=False))):
        found = F.when(score < e, label).otherwise(found)
    return F.when(score.isNotNull(), found)


def risk_band(df: DataFrame, p: str, name: str = "band", probabilities: Sequence[float] = (0.40, 0.60, 0.75, 0.90), labels: str = "ABCDE") -> DataFrame:
    """D3: A to E by quantiles of the score, upper edges included."""
    edges = quantile_list(df, p, probabilities)
    found = F.lit(labels[-1])
    for e, label in reversed(list(zip(edges, labels, strict=False))):
        found = F.when(F.col(p) <= e, label).otherwise(found)
    return df.withColumn(name, F.when(F.col(p).isNotNull(), found))


def reducer(restrictions: Column, active: Column, years: Column, factors: Mapping[str, float] | None = None) -> Column:
    """Product of the restriction, relationship and tenure factors."""
    f = {"clean": 1.0, "light": 0.8, "heavy": 0.5, "active": 1.0, "inactive": 0.9, "new": 0.7, "young": 0.9, "old": 1.0} | dict(factors or {})
    a = F.when(restrictions.isNull() | (restrictions <= 0), f["clean"]).when(restrictions <= 1000, f["light"]).otherwise(f["heavy"])
    b = F.when(F.coalesce(active, F.lit(0)) == 1, f["active"]).otherwise(f["inactive"])
    c = F.when(years.isNull() | (years < 1), f["new"]).when(years < 3, f["young"]).otherwise(f["old"])
    return a * b * c


def present_value(payment: Column, rate: Column, months: Column, floor: float | None = None) -> Column:
    """Of an annuity; without a rate above zero the plain sum. ``floor`` is the variant with a smallest rate instead."""
    k = F.greatest(rate, F.lit(floor)) if floor is not None else rate
    value = payment * (1 - F.pow(1 + k, -months)) / k
    return value if floor is not None else F.when(rate.isNull() | (rate <= 0), payment * months).otherwise(value)


def decision(band: Column, requested: Column, limit: Column, denied: Sequence[str] = ("E",)) -> Column:
    """Deny the worst bands and missing limits, cut what is above the limit, else approve."""
    return F.when(band.isin(*denied) | limit.isNull() | (limit <= 0), "NEGAR").when(requested > limit, "REDUZIR").otherwise("APROVAR")


def approved_amount(decided: Column, requested: Column, limit: Column) -> Column:
    return F.when(decided == "NEGAR", 0.0).otherwise(F.least(requested, limit))


def parameters(spark: SparkSession) -> DataFrame:
    """Three parameter sets by band: share of the income that may go into payments, and rate (a few rows)."""
    rows = [(s, b, m * share, rate + extra) for s, m, extra in (("conservador", 0.8, 0.005), ("base", 1.0, 0.0), ("agressivo", 1.2, -0.002)) for b, share, rate in (("A", 0.30, 0.02), ("B", 0.25, 0.025), ("C", 0.20, 0.03), ("D", 0.15, 0.035), ("E", 0.0, 0.04))]
    return spark.createDataFrame(rows, "scenario string, band string, share double, rate double")


def simulate(loans: DataFrame, params: DataFrame) -> DataFrame:
    """Every loan under every scenario: limits by band, reducers, annuity, decision and amount, in one plan.

    ``loans``: ``band, requested, income, months, restrictions, active, years``. Scenarios are expanded first, parameters looked up by (scenario, band).
    """
    many = expand_scenarios(loans, params.select("scenario").distinct()).join(small(params), ["scenario", "band"], "left")
    payment = F.greatest(F.col("income"), F.lit(0.0)) * F.col("share") * reducer(F.col("restrictions"), F.col("active"), F.col("years"))
    limit = present_value(payment, F.col("rate"), F.col("months"))
    out = many.withColumn("limit", limit)
    out = out.withColumn("decision", decision(F.col("band"), F.col("requested"), F.col("limit")))
    return out.withColumn("approved", approved_amount(F.col("decision"), F.col("requested"), F.col("limit")))


def indicators(df: DataFrame, by: Sequence[str], bad: str) -> DataFrame:
    """Approval rate, bad rate of all and of the approved, exposure kept."""
    ok = F.col("decision") != "NEGAR"
    y = F.col(bad).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), r(F.avg(ok.cast("double")) * 100).alias("approval"), r(F.avg(y) * 100).alias("bad_rate"), r(F.avg(F.when(ok, y)) * 100).alias("bad_rate_approved"), r(F.sum("approved") * 100.0 / F.sum("requested")).alias("exposure"))


def managerial_score(df: DataFrame, directions: Mapping[str, tuple[float, str]]) -> DataFrame:
    """Weighted sum of min-max scaled indicators (a constant one counts 1), best first. A row per scenario."""
    w = Window.partitionBy(F.lit(1))
    total = F.lit(0.0)
    for c, (weight, direction) in directions.items():
        lo, hi, x = F.min(c).over(w), F.max(c).over(w), F.col(c)
        total = total + weight * F.when(hi == lo, 1.0).otherwise((x - lo) / (hi - lo) if direction == "up" else (hi - x) / (hi - lo))
    return df.withColumn("managerial", r(total, 6)).withColumn("chosen", F.row_number().over(Window.orderBy(F.desc("managerial"), "scenario")) == 1)


def final_policy(simulated: DataFrame, score: str, scenario: str) -> DataFrame:
    """Per band of the chosen scenario: score interval, volume, action, parameters."""
    s = simulated.where(F.col("scenario") == scenario)
    g = s.groupBy("band").agg(r(F.min(score)).alias("score_from"), r(F.max(score)).alias("score_to"), F.count("*").alias("n"), r(F.max("share"), 6).alias("share"), r(F.max("rate"), 6).alias("rate"))
    return g.withColumn("scenario", F.lit(scenario)).withColumn("action", F.when(F.col("band") == "E", "NEGAR").when(F.col("band") == "D", "REDUZIR").otherwise("APROVAR"))
