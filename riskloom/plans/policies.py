"""Queries of scores and decision policy (D)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskloom.operators import policy as P
from riskloom.operators.aggregates import r
from riskloom.plans.base import query

_K = 40 / math.log(2)
_SCORE = f"least(greatest(500 + {_K!r}::DOUBLE * (ln((1 - p) / p) - {math.log(9)!r}::DOUBLE), 0), 1000)"


@query("d1_pdo_score", "WITH {SCORED} SELECT key, round(" + _SCORE + ", 4) AS score FROM scored")
def d1(t):
    return t.scored().select("key", r(P.pdo_score(F.col("p"))).alias("score"))


@query("d2_frozen_bands", "WITH {SCORED}, s AS (SELECT *, round(" + _SCORE + ", 6) AS score FROM scored), e AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS e FROM s WHERE year <= 1998) SELECT CASE WHEN score < e[1] THEN 'E' WHEN score < e[2] THEN 'D' WHEN score < e[3] THEN 'C' WHEN score < e[4] THEN 'B' ELSE 'A' END AS band, count(*) AS n, round(avg(label), 6) AS rate FROM s, e WHERE year > 1998 GROUP BY 1")
def d2(t):
    s = t.scored().withColumn("score", F.round(P.pdo_score(F.col("p")), 6))
    edges = P.frozen_bands(s.where("year <= 1998"), "score")
    return s.where("year > 1998").groupBy(P.band_of(F.col("score"), edges, "EDCBA").alias("band")).agg(F.count("*").alias("n"), r(F.avg(F.col("label").cast("double")), 6).alias("rate"))


_BAND = "e AS (SELECT quantile_cont(p, [0.4, 0.6, 0.75, 0.9]) AS e FROM scored), bd AS (SELECT scored.*, CASE WHEN p <= e[1] THEN 'A' WHEN p <= e[2] THEN 'B' WHEN p <= e[3] THEN 'C' WHEN p <= e[4] THEN 'D' ELSE 'E' END AS band FROM scored, e)"


@query("d3_risk_band", "WITH {SCORED}, " + _BAND + " SELECT band, count(*) AS n, min(p) AS low, max(p) AS high FROM bd GROUP BY 1")
def d3(t):
    return P.risk_band(t.scored(), "p").groupBy("band").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))


_FACTOR = "(CASE WHEN restrictions <= 0 THEN 1.0 WHEN restrictions <= 1000 THEN 0.8 ELSE 0.5 END::DOUBLE * CASE WHEN active = 1 THEN 1.0 ELSE 0.9 END::DOUBLE * CASE WHEN years < 1 THEN 0.7 WHEN years < 3 THEN 0.9 ELSE 1.0 END::DOUBLE)"
_LOANS = "ln AS (SELECT key, label, p, band, price AS requested, qty * 300 AS income, (12 + qty::INTEGER) AS months, discount * 20000 - 400 AS restrictions, (linestatus = 'O')::INTEGER AS active, (2002 - year)::DOUBLE AS years FROM bd)"


def _loans(t):
    return P.risk_band(t.scored(), "p").select("key", "label", "p", "band", F.col("price").alias("requested"), (F.col("qty") * 300).alias("income"), (12 + F.col("qty").cast("int")).alias("months"), (F.col("discount") * 20000 - 400).alias("restrictions"), (F.col("linestatus") == "O").cast("int").alias("active"), (2002 - F.col("year")).cast("double").alias("years"))


@query("d4_reducer", "WITH {SCORED}, " + _BAND + ", " + _LOANS + f" SELECT round({_FACTOR}, 6) AS factor, count(*) AS n FROM ln GROUP BY 1")
def d4(t):
    return _loans(t).groupBy(r(P.reducer(F.col("restrictions"), F.col("active"), F.col("years")), 6).alias("factor")).agg(F.count("*").alias("n"))


@query("d5_present_value", "WITH {SCORED}, " + _BAND + ", " + _LOANS + " SELECT key, round(income * (1 - pow(1.02::DOUBLE, -months)) / 0.02::DOUBLE, 4) AS limit_2, round(income * months, 4) AS limit_0, round(income * (1 - pow(1.0001::DOUBLE, -months)) / 0.0001::DOUBLE, 2) AS floored FROM ln")
def d5(t):
    v = lambda k, floor=None: P.present_value(F.col("income"), F.lit(k), F.col("months"), floor)
    return _loans(t).select("key", r(v(0.02)).alias("limit_2"), r(v(0.0)).alias("limit_0"), r(v(0.0, 0.0001), 2).alias("floored"))


_PARAMS = "sc(scenario, m, x) AS (VALUES ('conservador', 0.8::DOUBLE, 0.005::DOUBLE), ('base', 1.0, 0.0), ('agressivo', 1.2, -0.002)), pb(band, sh, rt) AS (VALUES ('A', 0.30::DOUBLE, 0.02::DOUBLE), ('B', 0.25, 0.025), ('C', 0.20, 0.03), ('D', 0.15, 0.035), ('E', 0.0, 0.04)), pr AS (SELECT scenario, band, m * sh AS share, rt + x AS rate FROM sc, pb)"
_SIM = ", ".join((_BAND, _LOANS, _PARAMS)) + f", li AS (SELECT ln.*, scenario, share, rate, greatest(income, 0) * share * {_FACTOR} * (1 - pow(1 + rate, -months)) / rate AS lim FROM ln JOIN pr USING (band)), sm AS (SELECT *, CASE WHEN band = 'E' OR lim <= 0 THEN 'NEGAR' WHEN requested > lim THEN 'REDUZIR' ELSE 'APROVAR' END AS decision FROM li), sa AS (SELECT *, CASE WHEN decision = 'NEGAR' THEN 0 ELSE least(requested, lim) END AS approved FROM sm)"


@query("d6_decisions", "WITH {SCORED}, " + _SIM + " SELECT key, scenario, decision, round(approved, 2) AS approved FROM sa")
def d6(t):
    return _sim(t).select("key", "scenario", "decision", r(F.col("approved"), 2).alias("approved"))


def _sim(t):
    return P.simulate(_loans(t), P.parameters(t.spark))


def _ind(by):
    return f"SELECT {by}, count(*) AS n, round(avg((decision <> 'NEGAR')::INTEGER) * 100, 4) AS approval, round(avg(label) * 100, 4) AS bad_rate, round(avg(label) FILTER (WHERE decision <> 'NEGAR') * 100, 4) AS bad_rate_approved, round(sum(approved) * 100.0 / sum(requested), 4)::DOUBLE AS exposure FROM sa GROUP BY ALL"


@query("d7_indicators", "WITH {SCORED}, " + _SIM + " " + _ind("decision"))
def d7(t):
    return P.indicators(_sim(t), ["decision"], "label")


@query("d8_simulation", "WITH {SCORED}, " + _SIM + " SELECT scenario, band, decision, count(*) AS n, round(sum(approved), 0) AS approved FROM sa GROUP BY ALL")
def d8(t):
    return _sim(t).groupBy("scenario", "band", "decision").agg(F.count("*").alias("n"), r(F.sum("approved"), 0).alias("approved"))


@query("d9_scenario_summary", "WITH {SCORED}, " + _SIM + " " + _ind("scenario, band"))
def d9(t):
    return P.indicators(_sim(t), ["scenario", "band"], "label")


@query("d10_managerial_score", "WITH {SCORED}, " + _SIM + ", i AS (" + _ind("scenario") + "), z AS (SELECT scenario, round(0.4 * coalesce((approval - min(approval) OVER ()) / nullif(max(approval) OVER () - min(approval) OVER (), 0), 1) + 0.3 * coalesce((max(bad_rate_approved) OVER () - bad_rate_approved) / nullif(max(bad_rate_approved) OVER () - min(bad_rate_approved) OVER (), 0), 1) + 0.3 * coalesce((exposure - min(exposure) OVER ()) / nullif(max(exposure) OVER () - min(exposure) OVER (), 0), 1), 6) AS managerial FROM i) SELECT *, row_number() OVER (ORDER BY managerial DESC, scenario) = 1 AS chosen FROM z")
def d10(t):
    i = P.indicators(_sim(t), ["scenario"], "label")
    return P.managerial_score(i, {"approval": (0.4, "up"), "bad_rate_approved": (0.3, "down"), "exposure": (0.3, "up")}).select("scenario", "managerial", "chosen")


@query("d11_final_policy", "WITH {SCORED}, " + _SIM + " SELECT band, round(min(p), 4) AS score_from, round(max(p), 4) AS score_to, count(*) AS n, round(max(share), 6) AS share, round(max(rate), 6) AS rate, 'base' AS scenario, CASE WHEN band = 'E' THEN 'NEGAR' WHEN band = 'D' THEN 'REDUZIR' ELSE 'APROVAR' END AS action FROM sa WHERE scenario = 'base' GROUP BY 1")
def d11(t):
    return P.final_policy(_sim(t), "p", "base")
