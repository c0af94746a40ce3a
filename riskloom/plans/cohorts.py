"""Queries of cohort flow, balance, propensity, weights, replication and disclosure (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import causal as C
from riskloom.plans.base import query

_NUM, _CAT = ["acct"], ["segment", "region"]
_E = "eb AS (SELECT *, 0.05 + 0.9 * ((key * 37) % 101) / 101.0::DOUBLE AS e FROM base WHERE t IS NOT NULL), ew AS (SELECT *, CASE WHEN t = 1 THEN 1 - e ELSE e END AS w FROM eb)"


def _known(t):
    """The cohort with a given score column and its overlap weights."""
    c = t.cohort().where("t is not null").withColumn("e", 0.05 + 0.9 * ((F.col("key") * 37) % 101) / 101.0)
    return c.withColumn("w", C.overlap_weights("t", "e"))


@query("c1_flow", """WITH {COHORT}, n AS (SELECT count(*) AS s0, count(*) FILTER (WHERE t IS NOT NULL) AS s1, count(*) FILTER (WHERE t IS NOT NULL AND price >= 20000) AS s2, count(*) FILTER (WHERE t IS NOT NULL AND price >= 20000 AND cluster IS NOT NULL) AS s3 FROM base)
 SELECT 1 AS step, 'A1' AS name, s0 AS before, s0 - s1 AS excluded, s1 AS after, round(s1 * 100.0 / s0, 4)::DOUBLE AS percent FROM n UNION ALL SELECT 2, 'A2', s1, s1 - s2, s2, round(s2 * 100.0 / s0, 4)::DOUBLE FROM n UNION ALL SELECT 3, 'A3', s2, s2 - s3, s3, round(s3 * 100.0 / s0, 4)::DOUBLE FROM n""")
def c1(t):
    return C.flow(t.cohort(), [("A1", F.col("t").isNotNull()), ("A2", F.col("price") >= 20000), ("A3", F.col("cluster").isNotNull())])


@query("c2_exclusions", "WITH {COHORT} SELECT CASE WHEN t IS NULL THEN 'no_treatment' WHEN price < 20000 THEN 'low_price' WHEN cluster IS NULL THEN 'no_cluster' ELSE 'eligible' END AS reason, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM base), 4)::DOUBLE AS percent FROM base GROUP BY 1")
def c2(t):
    return C.exclusions(t.cohort(), [("no_treatment", F.col("t").isNull()), ("low_price", F.col("price") < 20000), ("no_cluster", F.col("cluster").isNull())])


def _smd_num(c):
    return f"SELECT '{c}' AS variable, avg({c}) FILTER (WHERE t = 1) AS m1, avg({c}) FILTER (WHERE t = 0) AS m0, var_samp({c}) FILTER (WHERE t = 1) AS v1, var_samp({c}) FILTER (WHERE t = 0) AS v0 FROM base"


@query("c5_smd_numeric", "WITH {COHORT}, m AS (" + _smd_num("acct") + " UNION ALL " + _smd_num("price") + ") SELECT variable, round(m1, 6) AS mean_1, round(m0, 6) AS mean_0, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS smd FROM m")
def c5(t):
    return C.smd_numeric(t.cohort(), "t", ["acct", "price"])


_LEVELS = "k AS (SELECT * FROM base WHERE t IN (0, 1)), g AS (SELECT 'segment' AS variable, segment AS value, count(*) FILTER (WHERE t = 1) AS n1, count(*) FILTER (WHERE t = 0) AS n0 FROM k GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FILTER (WHERE t = 1), count(*) FILTER (WHERE t = 0) FROM k GROUP BY 2), s AS (SELECT count(*) FILTER (WHERE t = 1) AS t1, count(*) FILTER (WHERE t = 0) AS t0 FROM k), p AS (SELECT *, n1 / t1 AS p1, n0 / t0 AS p0 FROM g, s), v AS (SELECT *, p1 * (1 - p1) * t1 / (t1 - 1) AS v1, p0 * (1 - p0) * t0 / (t0 - 1) AS v0 FROM p), o AS (SELECT variable, value, n1, n0, round(p1 * 100, 4) AS percent_1, round(p0 * 100, 4) AS percent_0, round((p1 - p0) * 100, 4) AS difference_pp, round((p1 - p0) / sqrt((v1 + v0) / 2), 6) AS smd, round(v1 / v0, 6) AS variance_ratio FROM v)"


@query("c6_smd_levels", "WITH {COHORT}, " + _LEVELS + " SELECT * FROM o")
def c6(t):
    return C.smd_levels(t.cohort(), "t", ["segment", "region"])


@query("c5_smd_worst_level", "WITH {COHORT}, " + _LEVELS + " SELECT variable, max(abs(smd)) AS smd FROM o GROUP BY 1")
def c5b(t):
    return C.smd_worst_level(t.cohort(), "t", ["segment", "region"])


def _wb(c):
    return f"SELECT '{c}' AS variable, avg({c}) FILTER (WHERE t = 1) AS m1, avg({c}) FILTER (WHERE t = 0) AS m0, var_samp({c}) FILTER (WHERE t = 1) AS v1, var_samp({c}) FILTER (WHERE t = 0) AS v0, sum(w * {c}) FILTER (WHERE t = 1) / sum(w) FILTER (WHERE t = 1) AS w1, sum(w * {c}) FILTER (WHERE t = 0) / sum(w) FILTER (WHERE t = 0) AS w0, avg({c}) AS overall FROM ew"


_WB = "m AS (" + _wb("acct") + " UNION ALL " + _wb("price") + ")"


@query("c7_weighted_balance", "WITH {COHORT}, " + _E + ", " + _WB + " SELECT variable, round(m1, 6) AS mean_1, round(m0, 6) AS mean_0, round(w1, 6) AS weighted_1, round(w0, 6) AS weighted_0, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS smd_before, round((w1 - w0) / sqrt((v1 + v0) / 2), 6) AS smd_after FROM m")
def c7(t):
    return C.weighted_balance(_known(t), "t", "w", ["acct", "price"])


@query("c29_target_profile", "WITH {COHORT}, " + _E + ", " + _WB + " SELECT variable, CASE WHEN variable = 'price' THEN 'descriptive' ELSE 'adjusted' END AS role, round(overall, 6) AS overall, round(m1, 6) AS mean_1, round(m0, 6) AS mean_0, round(w1, 6) AS weighted_1, round(w0, 6) AS weighted_0 FROM m")
def c29(t):
    return C.target_profile(_known(t), "t", "w", ["acct", "price"], {"price": "descriptive"})


@query("c8_propensity")
def c8(t):
    return C.propensity(t.cohort().where("t is not null"), "t", _NUM, _CAT).select("key", "t", F.round("e", 6).alias("e"))


@query("c8_score_total", "WITH {COHORT} SELECT count(*) AS n, count(*) AS scored, round(avg(t), 5) AS mean_score FROM base WHERE t IS NOT NULL")
def c8b(t):
    """The intercept isn't penalised, so scores add up to the treated."""
    return C.propensity(t.cohort().where("t is not null"), "t", _NUM, _CAT).agg(F.count("*").alias("n"), F.count("e").alias("scored"), F.round(F.avg("e"), 5).alias("mean_score"))


#: Two halves and their product without a penalty: the score is the share of treated in each of the four cells, so SQL can work the fits out.
_HALVES = {"north": ("region", ("ASIA", "EUROPE")), "built": ("segment", ("BUILDING", "MACHINERY"))}
_CELLS = ", ".join(f"{column} IN {values}" for column, values in _HALVES.values())


def _halved(t):
    both = t.cohort().withColumns({n: F.col(c).isin(*values).cast("double") for n, (c, values) in _HALVES.items()})
    return both.withColumn("both", F.col("north") * F.col("built"))


def _closed(cells: str) -> str:
    return f"e AS (SELECT *, avg(t) OVER (PARTITION BY {cells}) AS e FROM base WHERE t IS NOT NULL), cw AS (SELECT *, CASE WHEN t = 1 THEN 1 - e ELSE e END AS w FROM e)"


_CLOSED_EFFECTS = ", ".join(f"round(sum(w * y) FILTER (WHERE t = {k}) / sum(w) FILTER (WHERE t = {k}), 6) AS risk_{k}, round(pow(sum(w) FILTER (WHERE t = {k}), 2) / sum(w * w) FILTER (WHERE t = {k}), 4) AS ess_{k}, round(min(e) FILTER (WHERE t = {k}), 6) AS e_min_{k}, round(max(e) FILTER (WHERE t = {k}), 6) AS e_max_{k}" for k in (1, 0))
_CLOSED_COLUMNS = [f"{c}_{k}" for k in (1, 0) for c in ("risk", "ess", "e_min", "e_max")]


@query("c8_closed_form", "WITH {COHORT}, " + _closed(_CELLS) + " SELECT key, t, round(e, 6) AS e FROM e")
def c8c(t):
    return C.propensity(_halved(t).where("t is not null"), "t", [*_HALVES, "both"], [], penalty=0.0).select("key", "t", F.round("e", 6).alias("e"))


@query("c9_out_of_fold")
def c9(t):
    return C.out_of_fold(t.cohort().where("t is not null"), "key", "t", _NUM, _CAT, 5).select("key", "t", "fold", F.round("e", 6).alias("e"))


_FOLDS = "n AS (SELECT t, count(*) AS n FROM base WHERE t IS NOT NULL GROUP BY 1), f AS (SELECT f::INTEGER AS fold, t, n // 5 + (f < n % 5)::INTEGER AS n FROM n, unnest([0, 1, 2, 3, 4]) AS u(f))"


@query("c9_fold_coverage", "WITH {COHORT}, " + _FOLDS + " SELECT fold, (SELECT sum(n) FROM f)::BIGINT - sum(n)::BIGINT AS n_train, sum(n)::BIGINT AS n_test, (sum(n) FILTER (WHERE t = 1))::BIGINT AS n_test_1, true AS converged, true AS has_auc FROM f GROUP BY 1")
def c9b(t):
    folds = C.cross_fitted(t.cohort(), "key", "t", _NUM, _CAT, 5).folds
    return folds.select("fold", "n_train", "n_test", "n_test_1", "converged", F.col("auc").between(0, 1).alias("has_auc"))


_PS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query("c10_overlap_summary", "WITH {COHORT}, " + _E + " SELECT t, count(*) AS n, round(min(e), 6) AS min, round(max(e), 6) AS max, " + ", ".join(f"round(quantile_cont(e, {p}), 6) AS p{int(p * 100):02d}" for p in _PS) + ", round(avg((e < 0.01)::INTEGER), 6) AS below_01, round(avg((e < 0.05)::INTEGER), 6) AS below_05, round(avg((e > 0.95)::INTEGER), 6) AS above_95, round(avg((e > 0.99)::INTEGER), 6) AS above_99 FROM ew GROUP BY 1")
def c10(t):
    return C.overlap_summary(_known(t), "t", "e")


@query("c11_trimming", "WITH {COHORT}, " + _E + ", r(rule, lo, hi) AS (VALUES ('none', 0.0::DOUBLE, 1.0::DOUBLE), ('01_99', 0.01, 0.99), ('05_95', 0.05, 0.95)) SELECT rule, count(*) FILTER (WHERE e BETWEEN lo AND hi) AS kept, count(*) FILTER (WHERE NOT e BETWEEN lo AND hi) AS excluded, count(*) FILTER (WHERE e BETWEEN lo AND hi AND t = 1) AS kept_1, count(*) FILTER (WHERE e BETWEEN lo AND hi AND t = 0) AS kept_0 FROM ew, r GROUP BY 1")
def c11(t):
    return C.trimming(_known(t), "t", "e")


@query("c12_score_bands", "WITH {COHORT}, " + _E + " SELECT least(floor(e / 0.1), 9)::INTEGER AS band, count(*) FILTER (WHERE t = 1) AS n1, count(*) FILTER (WHERE t = 0) AS n0, round(count(*) FILTER (WHERE t = 0) / count(*), 6) AS share_controls, least(count(*) FILTER (WHERE t = 1), count(*) FILTER (WHERE t = 0)) < 20 AS rare FROM ew GROUP BY 1")
def c12(t):
    return C.score_bands(_known(t), "t", "e")


@query("c13_outside_support", "WITH {COHORT}, " + _E + ", b AS (SELECT greatest(min(e) FILTER (WHERE t = 1), min(e) FILTER (WHERE t = 0)) AS lo, least(max(e) FILTER (WHERE t = 1), max(e) FILTER (WHERE t = 0)) AS hi FROM ew) SELECT t, count(*) AS n, count(*) FILTER (WHERE e < lo OR e > hi) AS outside, round(coalesce(sum(w) FILTER (WHERE e < lo OR e > hi), 0) / sum(w), 6) AS outside_weight, round(max(w) / sum(w), 6) AS largest_weight FROM ew, b GROUP BY 1")
def c13(t):
    return C.outside_support(_known(t), "t", "e", "w")


def _risk(w):
    return f"r AS (SELECT sum({w} * y) FILTER (WHERE t = 1) / sum({w}) FILTER (WHERE t = 1) AS r1, sum({w} * y) FILTER (WHERE t = 0) / sum({w}) FILTER (WHERE t = 0) AS r0 FROM ew) SELECT round(r1, 6) AS risk_1, round(r0, 6) AS risk_0, round((r1 - r0) * 100, 6) AS difference_pp, round(r1 / r0, 6) AS ratio FROM r"


@query("c14_overlap_risk", "WITH {COHORT}, " + _E + ", " + _risk("w"))
def c14(t):
    return C.weighted_risk(_known(t), "t", "y", "w")


@query("c15_effective_size", "WITH {COHORT}, " + _E + " SELECT t, count(*) AS n, round(sum(w) * sum(w) / sum(w * w), 4) AS ess, round(min(w), 6) AS min, round(median(w), 6) AS median, round(quantile_cont(w, 0.95), 6) AS p95, round(max(w), 6) AS max FROM ew GROUP BY 1")
def c15(t):
    return C.effective_size(_known(t), "t", "w")


@query("c16_raw_risk", "WITH {COHORT}, " + _E + ", " + _risk("1.0::DOUBLE"))
def c16(t):
    return C.raw_risk(_known(t), "t", "y")


@query("c17_annual_series")
def c17(t):
    return C.annual_series(t.cohort(), "year", "t", "y", _NUM, ["segment"])


_YEARS = ", ".join(f"round(avg(y) FILTER (WHERE t = {k}), 6) AS raw_{k}" for k in (1, 0)) + ", round((avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0)) * 100, 6) AS raw_difference_pp"


@query("c17_annual_raw", "WITH {COHORT} SELECT year, count(*) AS n, count(*) FILTER (WHERE t = 1) AS n_1, count(*) FILTER (WHERE t = 0) AS n_0, " + _YEARS + ", NULL::VARCHAR AS error FROM base WHERE t IS NOT NULL GROUP BY 1")
def c17b(t):
    return C.annual_series(t.cohort(), "year", "t", "y", _NUM, ["segment"]).select("year", "n", "n_1", "n_0", "raw_1", "raw_0", "raw_difference_pp", "error")


@query("c17_closed_form", "WITH {COHORT}, " + _closed("year, " + _CELLS) + " SELECT year, " + _CLOSED_EFFECTS + ", 0.0::DOUBLE AS smd_after FROM cw GROUP BY 1")
def c17c(t):
    """Overlap weights balance the means of what the score is fitted on exactly."""
    return C.annual_series(_halved(t), "year", "t", "y", [*_HALVES, "both"], [], penalty=0.0).select("year", *_CLOSED_COLUMNS, "smd_after")


@query("c18_bootstrap")
def c18(t):
    return C.bootstrap(t.cohort(), "t", "y", _CAT, 1000, numeric=_NUM)


@query("c19_cluster_bootstrap")
def c19(t):
    return C.bootstrap(t.cohort(), "t", "y", ["segment"], 1000, cluster="cluster")


_Z = 1.959963984540054


@query("c20_replicate_interval", f"WITH {{COHORT}}, g AS (SELECT month, avg(y) AS x FROM base GROUP BY 1), s AS (SELECT count(x) AS valid, stddev_samp(x) AS se, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, avg(x) AS m FROM g) SELECT valid, round(se, 6) AS se, round(lo, 6) AS low, round(hi, 6) AS high, round(0.5 - {_Z} * se, 6) AS normal_low, round(0.5 + {_Z} * se, 6) AS normal_high, round(m - 0.5, 6) AS bias FROM s")
def c20(t):
    return C.replicate_interval(t.cohort().groupBy("month").agg(F.avg("y").alias("estimate")), 0.5)


@query("c21_respecification")
def c21(t):
    return C.respecification(t.cohort(), "t", "y", _NUM, ["segment"], ["region"])


@query("c21_raw", "WITH {COHORT}, s AS (SELECT unnest(['base', 'extended']) AS specification) SELECT specification, count(*) AS n, count(*) FILTER (WHERE t = 1) AS n_1, count(*) FILTER (WHERE t = 0) AS n_0, " + _YEARS + " FROM base, s WHERE t IS NOT NULL GROUP BY 1")
def c21b(t):
    return C.respecification(t.cohort(), "t", "y", _NUM, ["segment"], ["region"]).select("specification", "n", "n_1", "n_0", "raw_1", "raw_0", "raw_difference_pp")


@query("c22_aipw")
def c22(t):
    return C.aipw(t.cohort(), "key", "t", "y", _NUM, ["segment"])


@query("c22_populations", "WITH {COHORT} SELECT count(*) AS n, count(*) FILTER (WHERE t = 1) AS n_1, count(*) FILTER (WHERE t = 0) AS n_0, 0::BIGINT AS excluded FROM base WHERE t IS NOT NULL")
def c22d(t):
    return C.aipw(t.cohort(), "key", "t", "y", _NUM, ["segment"]).where("population = 'sem_trimming'").select("n", "n_1", "n_0", "excluded")


@query("c22_weight_diagnostics")
def c22b(t):
    return C.aipw_tables(t.cohort(), "key", "t", "y", _NUM, ["segment"]).weights()


@query("c22_influence_diagnostics")
def c22c(t):
    return C.aipw_tables(t.cohort(), "key", "t", "y", _NUM, ["segment"]).influence()


@query("c23_welch")
def c23(t):
    return C.welch(t.cohort(), "t", "price")


_W = "g AS (SELECT region, count(price) AS n, avg(price) AS m, var_samp(price) AS v FROM base GROUP BY 1), w AS (SELECT *, n / v AS w FROM g), s AS (SELECT count(*)::DOUBLE AS k, sum(w) AS ww, sum(w * m) / sum(w) AS mm FROM w), a AS (SELECT max(k) AS k, sum(w * (m - mm) * (m - mm)) AS b, sum((1 - w / ww) * (1 - w / ww) / (n - 1)) AS l FROM w, s)"


@query("c23_welch_anova", "WITH {COHORT}, " + _W + " SELECT round(b / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * l), 6) AS f, round(k - 1, 4) AS df1, round((k * k - 1) / (3 * l), 4) AS df2 FROM a")
def c23b(t):
    return C.welch_anova(t.cohort(), "region", "price")


@query("c23_welch_moments", "WITH {COHORT}, m AS (SELECT t, count(price) AS n, avg(price) AS m, var_samp(price) AS v FROM base WHERE t IN (0, 1) GROUP BY 1), x AS (SELECT a.m - b.m AS d, a.v / a.n AS p, b.v / b.n AS q, a.n AS n, b.n AS k FROM m a, m b WHERE a.t = 1 AND b.t = 0) SELECT round(d, 4) AS difference, round(sqrt(p + q), 4) AS se, round((p + q) * (p + q) / (p * p / (n - 1) + q * q / (k - 1)), 4) AS df FROM x")
def c23c(t):
    return C.welch(t.cohort(), "t", "price").select("difference", "se", "df")


@query("c24_one_covariate", "WITH {COHORT}, n AS (SELECT (count(*) FILTER (WHERE t = 1 AND y = 1))::DOUBLE AS a, (count(*) FILTER (WHERE t = 1 AND y = 0))::DOUBLE AS b, (count(*) FILTER (WHERE t = 0 AND y = 1))::DOUBLE AS c, (count(*) FILTER (WHERE t = 0 AND y = 0))::DOUBLE AS d FROM base) SELECT '(intercept)' AS term, round(c / d, 6) AS odds_ratio, round(ln(c / d), 6) AS coefficient, round(sqrt(1 / c + 1 / d), 6) AS se FROM n UNION ALL SELECT 't', round(a * d / (b * c), 6), round(ln(a * d / (b * c)), 6), round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) FROM n")
def c24b(t):
    return C.odds_ratios(t.cohort(), "y", ["t"]).select("term", *[F.round(c, 6).alias(c) for c in ("odds_ratio", "coefficient", "se")])


@query("c24_odds_ratios")
def c24(t):
    c = t.cohort().withColumn("acct_k", F.col("acct") / 1000).withColumn("seg", (F.col("segment") == "BUILDING").cast("int"))
    return C.odds_ratios(c, "y", ["t", "acct_k", "seg"])


@query("c25_crude_odds_ratio", "WITH {COHORT}, n AS (SELECT (count(*) FILTER (WHERE t = 1 AND y = 1))::DOUBLE AS a, (count(*) FILTER (WHERE t = 1 AND y = 0))::DOUBLE AS b, (count(*) FILTER (WHERE t = 0 AND y = 1))::DOUBLE AS c, (count(*) FILTER (WHERE t = 0 AND y = 0))::DOUBLE AS d FROM base) SELECT a, b, c, d, round(a * d / (b * c), 6) AS odds_ratio, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS se_log FROM n")
def c25(t):
    return C.crude_odds_ratio(t.cohort(), "t", "y")


_CELLS = "g AS (SELECT nation, code, month, count(*) AS n FROM base GROUP BY ALL)"


@query("c26_masked", "WITH {COHORT}, " + _CELLS + " SELECT nation, code, month, CASE WHEN n BETWEEN 1 AND 9 THEN '<10' ELSE n::VARCHAR END AS shown FROM g")
def c26(t):
    g = t.cohort().groupBy("nation", "code", "month").agg(F.count("*").alias("n"))
    return g.select("nation", "code", "month", C.masked(F.col("n")).alias("shown"))


@query("c26_rounded", "WITH {COHORT}, g AS (SELECT nation, year, status, count(*) AS n FROM base GROUP BY ALL), k AS (SELECT *, sum((n BETWEEN 1 AND 9)::INTEGER) OVER (PARTITION BY nation, year) AS k FROM g) SELECT nation, year, status, CASE WHEN n BETWEEN 1 AND 9 THEN '<10' WHEN k = 1 THEN (round_even(n / 10.0, 0) * 10)::BIGINT::VARCHAR ELSE n::VARCHAR END AS shown FROM k")
def c26b(t):
    g = t.cohort().groupBy("nation", "year", "status").agg(F.count("*").alias("n"))
    return C.rounded_recoverable(g, ["nation", "year"], "n").select("nation", "year", "status", "shown")


_MERGED = """o AS (SELECT *, row_number() OVER (ORDER BY bin) AS i FROM (SELECT floor(price / 5000)::BIGINT AS bin, count(*) FILTER (WHERE t = 1) AS n1, count(*) FILTER (WHERE t = 0) AS n0 FROM base WHERE t IS NOT NULL GROUP BY 1)),
 m AS (SELECT i, 1 AS g, bin, n1, n0, n1 AS a, n0 AS b FROM o WHERE i = 1
  UNION ALL SELECT o.i, m.g + ((m.a = 0 OR m.a >= 10) AND (m.b = 0 OR m.b >= 10))::INTEGER, o.bin, o.n1, o.n0, o.n1 + CASE WHEN (m.a = 0 OR m.a >= 10) AND (m.b = 0 OR m.b >= 10) THEN 0 ELSE m.a END, o.n0 + CASE WHEN (m.a = 0 OR m.a >= 10) AND (m.b = 0 OR m.b >= 10) THEN 0 ELSE m.b END FROM m JOIN o ON o.i = m.i + 1),
 e AS (SELECT g AS last, NOT ((a = 0 OR a >= 10) AND (b = 0 OR b >= 10)) AS open FROM m ORDER BY i DESC LIMIT 1)"""


@query("c27_merge_small_bins", "WITH RECURSIVE {COHORT}, " + _MERGED + " SELECT min(bin) AS first_bin, max(bin) AS last_bin, sum(n1)::BIGINT AS n1, sum(n0)::BIGINT AS n0 FROM m, e GROUP BY CASE WHEN open AND g = last AND last > 1 THEN g - 1 ELSE g END")
def c27(t):
    g = t.cohort().where("t is not null").groupBy(F.floor(F.col("price") / 5000).alias("bin")).agg(F.count_if(F.col("t") == 1).alias("n1"), F.count_if(F.col("t") == 0).alias("n0"))
    return C.merge_small_bins(g, "bin", "n1", "n0")


@query("c28_merged_levels", "WITH {COHORT} SELECT CASE WHEN code IN ('1', '2') THEN 'early' WHEN code = '3' THEN 'mid' ELSE 'late' END AS level, count(*) AS n FROM base GROUP BY 1")
def c28(t):
    return C.merged_levels(t.cohort(), "code", {"1": "early", "2": "early", "3": "mid", "4": "late", "5": "late"})


