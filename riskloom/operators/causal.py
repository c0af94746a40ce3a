"""Cohort flow, balance, propensity, overlap weights, replication, doubly robust estimation, disclosure control."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import features, special
from riskloom.operators import fits
from riskloom.operators.aggregates import r, with_quantiles
from riskloom.operators.audit import guard_predictors, long_rows, unpivoted
from riskloom.operators.evaluate import grouped_auc, ranking_metrics, stratified_folds
from riskloom.operators.joins import small
from riskloom.operators.ordered import quantiles, with_global_rank
from riskloom.sources.staging import staged


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def flow(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Ledger of cumulative filters: rows before, excluded, after, share of the first. One pass."""
    counts, ok = [F.count("*")], F.lit(True)
    for _, c in steps:
        ok = ok & F.coalesce(c, F.lit(False))
        counts.append(F.count_if(ok))
    wide = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(counts)])
    rows = [F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("name"), F.col(f"s{i}").alias("before"), (F.col(f"s{i}") - F.col(f"s{i + 1}")).alias("excluded"), F.col(f"s{i + 1}").alias("after"), r(F.col(f"s{i + 1}") * 100.0 / F.col("s0")).alias("percent")) for i, (n, _) in enumerate(steps)]
    return wide.select(F.inline(F.array(*rows)))


def exclusion_reason(rules: Sequence[tuple[str, Column]], eligible: str = "eligible") -> Column:
    """The first rule that excludes a row, else ``eligible``."""
    reason = F.lit(eligible)
    for name, c in reversed(rules):
        reason = F.when(F.coalesce(c, F.lit(False)), name).otherwise(reason)
    return reason


def exclusions(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    n = df.agg(F.count("*").alias("__n"))
    return df.groupBy(exclusion_reason(rules).alias("reason")).agg(F.count("*").alias("n")).join(F.broadcast(n)).select("reason", "n", r(F.col("n") * 100.0 / F.col("__n")).alias("percent"))


def _smd(m1: Column, m0: Column, v1: Column, v0: Column) -> Column:
    pooled = F.sqrt((v1 + v0) / 2)
    return F.when(pooled > 0, (m1 - m0) / pooled).when(m1 == m0, 0.0).otherwise(F.lit(float("inf")))


def smd_numeric(df: DataFrame, t: str, columns: Sequence[str]) -> DataFrame:
    """Difference of means over the pooled deviation (ddof 1); without variance 0 or infinite."""
    on = lambda f, c, k: f(F.when(F.col(t) == k, F.col(c).cast("double")))
    fields = {c: {"m1": on(F.avg, c, 1), "m0": on(F.avg, c, 0), "v1": on(F.var_samp, c, 1), "v0": on(F.var_samp, c, 0)} for c in columns}
    return long_rows(df, fields, ("m1", "m0", "v1", "v0"), "variable").select("variable", r(F.col("m1"), 6).alias("mean_1"), r(F.col("m0"), 6).alias("mean_0"), r(_smd(F.col("m1"), F.col("m0"), F.col("v1"), F.col("v0")), 6).alias("smd"))


def smd_levels(df: DataFrame, t: str, columns: Sequence[str]) -> DataFrame:
    """Each level's rows and shares by group, difference in points, SMD of its indicator, variance ratio."""
    sizes = df.agg(F.count_if(F.col(t) == 1).alias("t1"), F.count_if(F.col(t) == 0).alias("t0"))
    g = unpivoted(df.where(F.col(t).isin(0, 1)), columns, [t]).groupBy("variable", "value").agg(F.count_if(F.col(t) == 1).alias("n1"), F.count_if(F.col(t) == 0).alias("n0")).join(F.broadcast(sizes))
    p1, p0 = F.col("n1") / F.col("t1"), F.col("n0") / F.col("t0")
    v1, v0 = p1 * (1 - p1) * F.col("t1") / (F.col("t1") - 1), p0 * (1 - p0) * F.col("t0") / (F.col("t0") - 1)
    return g.select("variable", "value", "n1", "n0", r(p1 * 100).alias("percent_1"), r(p0 * 100).alias("percent_0"), r((p1 - p0) * 100).alias("difference_pp"), r(_smd(p1, p0, v1, v0), 6).alias("smd"), r(F.when(v0 > 0, v1 / v0), 6).alias("variance_ratio"))


def smd_worst_level(df: DataFrame, t: str, columns: Sequence[str]) -> DataFrame:
    """A categorical variable's SMD is that of its worst level."""
    return smd_levels(df, t, columns).groupBy("variable").agg(F.max(F.abs("smd")).alias("smd"))


def weighted_balance(df: DataFrame, t: str, weight: str, columns: Sequence[str]) -> DataFrame:
    """SMD before and after weighting; the denominator is that of the unweighted data both times."""
    fields = {}
    for c in columns:
        x, w = F.col(c).cast("double"), F.col(weight)
        on = lambda e, k: F.when(F.col(t) == k, e)
        fields[c] = {f"m{k}": F.avg(on(x, k)) for k in (1, 0)} | {f"v{k}": F.var_samp(on(x, k)) for k in (1, 0)} | {f"w{k}": F.sum(on(w * x, k)) / F.sum(on(F.when(x.isNotNull(), w), k)) for k in (1, 0)}
    rows = long_rows(df, fields, ("m1", "m0", "v1", "v0", "w1", "w0"), "variable")
    d = lambda a, b: r(_smd(F.col(a), F.col(b), F.col("v1"), F.col("v0")), 6)
    return rows.select("variable", r(F.col("m1"), 6).alias("mean_1"), r(F.col("m0"), 6).alias("mean_0"), r(F.col("w1"), 6).alias("weighted_1"), r(F.col("w0"), 6).alias("weighted_0"), d("m1", "m0").alias("smd_before"), d("w1", "w0").alias("smd_after"))


def target_profile(df: DataFrame, t: str, weight: str, columns: Sequence[str], roles: Mapping[str, str] = {}) -> DataFrame:
    """Overall mean beside the raw and weighted ones, with the variable's role in the adjustment."""
    whole = long_rows(df, {c: {"overall": r(F.avg(F.col(c).cast("double")), 6)} for c in columns}, ("overall",), "variable")
    role = F.coalesce(F.create_map(*[F.lit(x) for kv in (roles or {"": ""}).items() for x in kv])[F.col("variable")], F.lit("adjusted"))
    return whole.join(weighted_balance(df, t, weight, columns), "variable").select("variable", role.alias("role"), "overall", "mean_1", "mean_0", "weighted_1", "weighted_0")


def fit_propensity(df: DataFrame, t: str, columns: Sequence[str], inverse_penalty: float = 1.0, weight: str | None = None):
    """Logistic regression with an L2 penalty on prepared columns; the model. Fits nothing on the outcome or what comes after treatment."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    guard_predictors(columns)
    data = VectorAssembler(inputCols=list(columns), outputCol="__x").transform(df.where(F.col(t).isNotNull()).withColumn("__y", F.col(t).cast("double")))
    n = data.count() if weight is None else data.agg(F.sum(weight)).first()[0]
    lr = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / (inverse_penalty * n) if inverse_penalty else 0.0, elasticNetParam=0.0, standardization=False, tol=1e-6, maxIter=200, predictionCol="__p", probabilityCol="__prob", rawPredictionCol="__raw", **({"weightCol": weight} if weight else {}))
    model = lr.fit(data)
    if model.summary.totalIterations >= 200:
        raise RuntimeError("the fit didn't converge")
    return model


def score_propensity(model, df: DataFrame, columns: Sequence[str], name: str = "e") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = model.transform(VectorAssembler(inputCols=list(columns), outputCol="__x").transform(df))
    return out.withColumn(name, vector_to_array("__prob")[1]).drop("__x", "__p", "__prob", "__raw")


def one_group(df: DataFrame, label: str) -> DataFrame:
    return staged(df.withColumn("__g", F.lit(0)), label)


def known_groups(df: DataFrame, t: str) -> DataFrame:
    """Rows of both treatment groups; a frame without one of them, or with other values, is an error."""
    found = {x[0] for x in df.select(t).distinct().limit(4).collect()}
    if found != {0, 1}:
        raise ValueError(f"both treatment groups are needed, found {sorted(found, key=str)}")
    return df


def raise_failures(result: fits.Fits, names: Sequence[str]) -> None:
    if bad := [f"{n}: {f}" for n, f in zip(names, result.failure, strict=True) if f is not None]:
        raise RuntimeError("fits didn't converge: " + "; ".join(bad[:10]))


def propensity(df: DataFrame, t: str, numeric: Sequence[str], categorical: Sequence[str], name: str = "e", penalty: float = 1.0) -> DataFrame:
    """In-sample score of a logistic fit with an L2 penalty (1 / C) on prepared columns; rows without a treatment get one too."""
    guard_predictors([*numeric, *categorical])
    data = fits.encoded(one_group(df, "cohort"), numeric, categorical)
    result, preps = fits.fit_models(data, [fits.Model(frozenset({0}), t)], penalty)
    raise_failures(result, ["the score"])
    return data.rows.select(*map(column, df.columns), fits.score(data, preps[0], result.beta[0]).alias(name))


@dataclass
class CrossFit:
    """Scores of rows by fits that haven't seen their fold, and how each fold's fit went."""

    scores: DataFrame
    folds: DataFrame
    auc: float


def cross_fitted(df: DataFrame, key: str, t: str, numeric: Sequence[str], categorical: Sequence[str], folds: int = 5, name: str = "e", penalty: float = 1.0) -> CrossFit:
    """Each row is scored once, by a fit on the other folds; folds are stratified by ``t``.

    Medians, means, deviations, modes and levels belong to the fit and come from its training rows alone. All fits take their steps in the
    same scans. A fit that doesn't converge, a frame with one group, and a row that isn't scored are errors.
    """
    guard_predictors([*numeric, *categorical])
    known = stratified_folds(known_groups(df.where(F.col(t).isNotNull()), t), key, t, folds)
    data = fits.encoded(staged(known.withColumn("__g", F.col("fold")), "folds"), numeric, categorical)
    sizes = {x["fold"]: x for x in data.rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col(t) == 1).alias("n1")).collect()}
    if len(sizes) != folds:
        raise ValueError(f"{len(sizes)} of {folds} folds have rows")
    models = [fits.Model(frozenset(range(folds)) - {k}, t) for k in range(folds)]
    result, preps = fits.fit_models(data, models, penalty)
    raise_failures(result, [f"fold {k}" for k in range(folds)])
    scored = staged(data.rows.select(*map(column, known.columns), fits.score_by_group(data, result, preps, {k: k for k in range(folds)}).alias(name)), "scored")
    rows = sum(x["n"] for x in sizes.values())
    seen = scored.agg(F.count(name), F.count_if(column(name).between(0, 1))).first()
    if tuple(seen) != (rows, rows):
        raise RuntimeError(f"{seen[1]} of {rows} rows have a score within 0 to 1")
    by_fold = {x["fold"]: x["auc"] for x in grouped_auc(scored, ["fold"], name, t).collect()}
    table = [(k, rows - sizes[k]["n"], sizes[k]["n"], sizes[k]["n1"], by_fold.get(k), int(result.steps[k]), bool(result.converged[k])) for k in range(folds)]
    found = df.sparkSession.createDataFrame(table, "fold int, n_train long, n_test long, n_test_1 long, auc double, steps int, converged boolean")
    return CrossFit(scored, found, ranking_metrics(scored, name, t).first()["auc"])


def out_of_fold(df: DataFrame, key: str, t: str, numeric: Sequence[str], categorical: Sequence[str], folds: int = 5, name: str = "e") -> DataFrame:
    """The scores."""
    return cross_fitted(df, key, t, numeric, categorical, folds, name).scores


def overlap_summary(df: DataFrame, t: str, e: str) -> DataFrame:
    """Percentiles of the score by group, and shares beyond thresholds."""
    p = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    x = F.col(e)
    g = df.groupBy(t).agg(F.count("*").alias("n"), r(F.min(x), 6).alias("min"), r(F.max(x), 6).alias("max"), *[r(F.avg((x < q).cast("double")), 6).alias(f"below_{int(q * 100):02d}") for q in (0.01, 0.05)], *[r(F.avg((x > q).cast("double")), 6).alias(f"above_{int(q * 100):02d}") for q in (0.95, 0.99)])
    g = with_quantiles(g, df, [t], e, p)
    return g.select(t, "n", "min", "max", *[r(F.col(f"q{i}"), 6).alias(f"p{int(q * 100):02d}") for i, q in enumerate(p)], "below_01", "below_05", "above_95", "above_99")


TRIMMING = (("none", 0.0, 1.0), ("01_99", 0.01, 0.99), ("05_95", 0.05, 0.95))


def trimming(df: DataFrame, t: str, e: str, rules: Sequence[tuple[str, float, float]] = TRIMMING) -> DataFrame:
    """C11: rows kept by each rule and group."""
    keep = {n: F.col(e).between(lo, hi) for n, lo, hi in rules}
    fields = {n: {"kept": F.count_if(k), "excluded": F.count_if(~k), "kept_1": F.count_if(k & (F.col(t) == 1)), "kept_0": F.count_if(k & (F.col(t) == 0))} for n, k in keep.items()}
    return long_rows(df, fields, ("kept", "excluded", "kept_1", "kept_0"), "rule")


def score_bands(df: DataFrame, t: str, e: str, width: float = 0.1, least: int = 20) -> DataFrame:
    """Counts by band of the score, and whether a group is rare there."""
    g = df.groupBy(F.least(F.floor(F.col(e) / width), F.lit(round(1 / width) - 1)).cast("int").alias("band")).agg(F.count_if(F.col(t) == 1).alias("n1"), F.count_if(F.col(t) == 0).alias("n0"))
    return g.withColumn("share_controls", r(F.col("n0") / (F.col("n0") + F.col("n1")), 6)).withColumn("rare", F.least("n0", "n1") < least)


def overlap_weights(t: str, e: str) -> Column:
    """C14."""
    return F.when(F.col(t) == 1, 1 - F.col(e)).when(F.col(t) == 0, F.col(e))


def outside_support(df: DataFrame, t: str, e: str, weight: str) -> DataFrame:
    """Rows outside the common support of the scores, their share of the weight, and the largest single weight's."""
    bounds = df.agg(*[f(F.when(F.col(t) == k, F.col(e))).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in (1, 0)]).select(F.greatest("lo1", "lo0").alias("__lo"), F.least("hi1", "hi0").alias("__hi"))
    j = df.join(F.broadcast(bounds))
    out = (F.col(e) < F.col("__lo")) | (F.col(e) > F.col("__hi"))
    return j.groupBy(t).agg(F.count("*").alias("n"), F.count_if(out).alias("outside"), r(F.coalesce(F.sum(F.when(out, F.col(weight))), F.lit(0.0)) / F.sum(weight), 6).alias("outside_weight"), r(F.max(weight) / F.sum(weight), 6).alias("largest_weight"))


def weighted_risk(df: DataFrame, t: str, y: str, weight: str) -> DataFrame:
    """C14: weighted risks, difference in points and ratio."""
    on = lambda k: F.sum(F.when(F.col(t) == k, F.col(weight) * F.col(y))) / F.sum(F.when(F.col(t) == k, F.col(weight)))
    return df.where(F.col(y).isNotNull()).agg(on(1).alias("r1"), on(0).alias("r0")).select(r(F.col("r1"), 6).alias("risk_1"), r(F.col("r0"), 6).alias("risk_0"), r((F.col("r1") - F.col("r0")) * 100, 6).alias("difference_pp"), r(F.when(F.col("r0") > 0, F.col("r1") / F.col("r0")), 6).alias("ratio"))


def effective_size(df: DataFrame, t: str, weight: str) -> DataFrame:
    """Kish's effective sample size and the weights' distribution."""
    w = F.col(weight)
    g = df.groupBy(t).agg(F.count("*").alias("n"), r(F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"), r(F.min(w), 6).alias("min"), r(F.max(w), 6).alias("max"))
    return with_quantiles(g, df, [t], weight, (0.5, 0.95)).select(t, "n", "ess", "min", r(F.col("q0"), 6).alias("median"), r(F.col("q1"), 6).alias("p95"), "max")


def raw_risk(df: DataFrame, t: str, y: str) -> DataFrame:
    """C16."""
    return weighted_risk(df.withColumn("__one", F.lit(1.0)), t, y, "__one")


def estimate(df: DataFrame, t: str, y: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Score, overlap weights and weighted risk in one go."""
    scored = propensity(df.where(F.col(t).isNotNull() & F.col(y).isNotNull()), t, numeric, categorical)
    return weighted_risk(scored.withColumn("__w", overlap_weights(t, "e")), t, y, "__w")


def _effects(scored: DataFrame, by: str, t: str, y: str, e: str, data: fits.Encoded) -> DataFrame:
    """For each value of ``by``: risks raw and weighted, their differences and ratios, effective sizes, range of the score by group, and the largest
    standardised difference of a covariate before and after weighting (denominators are unweighted both times). One aggregation."""
    w = overlap_weights(t, e)
    on = lambda c, k: F.when(F.col(t) == k, c)
    mean = lambda c, k: F.sum(on(w * c, k)) / F.sum(on(F.when(c.isNotNull(), w), k))
    out = [F.count("*").alias("n")]
    for k in (1, 0):
        out += [F.count_if(F.col(t) == k).alias(f"n_{k}"), F.avg(on(F.col(y), k)).alias(f"raw_{k}"), mean(F.col(y), k).alias(f"risk_{k}"), (F.sum(on(w, k)) * F.sum(on(w, k)) / F.sum(on(w * w, k))).alias(f"ess_{k}"), F.min(on(F.col(e), k)).alias(f"e_min_{k}"), F.max(on(F.col(e), k)).alias(f"e_max_{k}")]
    parts = [F.col(f"__x{i}") for i in range(len(data.numeric))]
    parts += [F.when(F.col(f"__c{j}") >= 0, (F.col(f"__c{j}") == k).cast("double")) for j, levels in enumerate(data.levels) for k in range(len(levels))]
    for i, x in enumerate(parts):
        out += [f(on(x, k)).alias(f"__{n}{k}_{i}") for k in (1, 0) for n, f in (("m", F.avg), ("v", F.var_samp))] + [mean(x, k).alias(f"__w{k}_{i}") for k in (1, 0)]
    g = scored.groupBy(by).agg(*out)
    smd = lambda n: F.array(*[F.abs(_smd(F.col(f"__{n}1_{i}"), F.col(f"__{n}0_{i}"), F.col(f"__v1_{i}"), F.col(f"__v0_{i}"))) for i in range(len(parts))])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return g.select(by, "n", "n_1", "n_0", *[r(F.col(c), 6).alias(c) for c in ("raw_1", "raw_0")], r((F.col("raw_1") - F.col("raw_0")) * 100, 6).alias("raw_difference_pp"), r(ratio("raw_1", "raw_0"), 6).alias("raw_ratio"), *[r(F.col(c), 6).alias(c) for c in ("risk_1", "risk_0")], r((F.col("risk_1") - F.col("risk_0")) * 100, 6).alias("difference_pp"), r(ratio("risk_1", "risk_0"), 6).alias("ratio"), *[r(F.col(c), 4).alias(c) for c in ("ess_1", "ess_0")], *[r(F.col(f"e_{m}_{k}"), 6).alias(f"e_{m}_{k}") for k in (1, 0) for m in ("min", "max")], r(F.array_max(smd("m")), 6).alias("smd_before"), r(F.array_max(smd("w")), 6).alias("smd_after"))


def annual_series(df: DataFrame, year: str, t: str, y: str, numeric: Sequence[str], categorical: Sequence[str], baseline: int | None = None, penalty: float = 1.0) -> DataFrame:
    """C17: a fit for each year, all years in the same scans, with the measures, diagnostics and balance of each.

    A year that can't be fitted (one group only, no convergence) has its reason in ``error`` and nulls in what depends on the score; if it is the
    baseline, that is raised. Rows without a year, treatment or outcome are left out.
    """
    guard_predictors([*numeric, *categorical])
    known = df.where(F.col(t).isin(0, 1) & F.col(y).isNotNull() & F.col(year).isNotNull())
    years = sorted(x[0] for x in known.select(year).distinct().collect())
    if baseline is not None and baseline not in years:
        raise ValueError(f"the baseline {baseline} has no rows")
    data = fits.encoded(staged(known.withColumn("__g", (F.array_position(F.array(*map(F.lit, years)), F.col(year)) - 1).cast("int")) if years else known.withColumn("__g", F.lit(0)), "years"), numeric, categorical)
    models = [fits.Model(frozenset({i}), t) for i in range(len(years))]
    result, preps = fits.fit_models(data, models, penalty) if years else (fits.Fits(np.zeros((0, 1)), np.zeros(0, bool), np.zeros(0, int), []), [])
    groups = dict(data.rows.groupBy("__g").agg(F.count_distinct(t)).collect())
    for i in range(len(years)):
        if groups[i] < 2:
            result.failure[i] = "one treatment group"
    if baseline is not None and (why := result.failure[years.index(baseline)]):
        raise RuntimeError(f"the baseline {baseline} can't be fitted: {why}")
    scored = data.rows.withColumn("__e", fits.score_by_group(data, result, preps, {i: i for i in range(len(years))}))
    how = df.sparkSession.createDataFrame([(x, int(result.steps[i]), result.failure[i]) for i, x in enumerate(years)], f"__year {df.schema[year].dataType.simpleString()}, steps int, error string")
    out = _effects(scored, year, t, y, "__e", data)
    return out.join(F.broadcast(how), F.col(year) == F.col("__year")).drop("__year")


def respecification(df: DataFrame, t: str, y: str, numeric: Sequence[str], categorical: Sequence[str], added: Sequence[str], penalty: float = 1.0) -> DataFrame:
    """The estimate with and without further covariates, with effective sizes and the balance of all of them under both scores. Both fits
    take sub-blocks of the same sums."""
    guard_predictors([*numeric, *categorical, *added])
    data = fits.encoded(one_group(df.where(F.col(t).isin(0, 1) & F.col(y).isNotNull()), "cohort"), numeric, [*categorical, *added])
    base = frozenset([*numeric, *categorical])
    result, preps = fits.fit_models(data, [fits.Model(frozenset({0}), t, base), fits.Model(frozenset({0}), t)], penalty)
    raise_failures(result, ["base", "extended"])
    both = F.array(*[F.struct(F.lit(n).alias("specification"), fits.score(data, preps[i], result.beta[i]).alias("__e")) for i, n in enumerate(("base", "extended"))])
    scored = data.rows.select("*", F.inline(both))
    return _effects(scored, "specification", t, y, "__e", data)


# replication: rows that are alike are one cell with a count; cells stay in a distributed table, however many there are


def irls(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 0.0, steps: int = 60) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weighted logistic fit by Newton steps, first column unpenalised; coefficients, covariance, whether it converged."""
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        info = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(info + 1e-12 * np.eye(len(beta)), x.T @ (w * (y - p)) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            return beta, np.linalg.inv(info), True
    return beta, np.linalg.pinv(info), False


RISKS = ("raw_1", "raw_0", "ato_1", "ato_0")
MEASURES = (*RISKS, "raw_difference_pp", "ato_difference_pp", "raw_ratio", "ato_ratio")
#: Means of Poisson draws up to which tables are made.
_TABLED = 64
#: First bits of a uniform number that tell most draws; what stands for a range with several counts.
_GUIDE_BITS, _OPEN = 16, 255
#: Replicates times cells of one slice of a task.
_SLICE_CELLS = 1 << 20


def multiplicities(ids: np.ndarray, n: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each replicate takes the rows of each cell: a Poisson draw with the cell's count as its mean (the law of resampling rows one by one
    where no task sees all of them). Seeded by the cell, so every scan draws the same, whatever task the cell is in."""
    out = np.empty((len(ids), replicates))
    ids = ids.view(np.uint64)
    for m in np.unique(n):
        here = np.flatnonzero(n == m)
        if m > _TABLED:
            for i in here:
                out[i] = np.random.Generator(np.random.Philox(key=[np.uint64(seed), ids[i]])).poisson(m, replicates)
            continue
        # small means: a uniform number for each cell and replicate, looked up in the distribution's table; most are told by their first bits
        table, guide = _poisson_table(int(m))
        x = ids[here][:, None] ^ _mixed(np.arange(replicates, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32))[None, :]
        x = _mixed(x) >> np.uint64(11)
        drawn = guide[(x >> np.uint64(53 - _GUIDE_BITS)).view(np.int64)]
        open_ = np.flatnonzero(drawn == _OPEN)
        drawn.ravel()[open_] = np.searchsorted(table, x.ravel()[open_] * 2.0**-53, side="right")
        out[here] = drawn
    return out


@cache
def _poisson_table(mean: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the counts of a Poisson law end, and the count of each range of uniform numbers with equal first bits (``_OPEN``: it has several)."""
    k = np.arange(mean + 60)
    table = np.cumsum(np.exp(k * math.log(mean) - mean - np.cumsum(np.log(np.maximum(k, 1)))))
    table = table[table < 1 - 1e-13]
    edges = np.arange((1 << _GUIDE_BITS) + 1) / (1 << _GUIDE_BITS)
    low, high = np.searchsorted(table, edges[:-1], side="right"), np.searchsorted(table, edges[1:], side="left")
    return table, np.where(low == high, low, _OPEN).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits well stirred, by two rounds of shift and multiplication."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cluster_draws(clusters: int, replicates: int, seed: int) -> np.ndarray:
    """Clusters drawn with replacement, as many as there are: how often each replicate has each cluster."""
    out = np.empty((clusters, replicates))
    for b in range(replicates):
        out[:, b] = np.bincount(np.random.default_rng([seed, b]).integers(0, clusters, clusters), minlength=clusters)
    return out


def bootstrap(df: DataFrame, t: str, y: str, columns: Sequence[str], replicates: int = 1000, seed: int = 11, cluster: str | None = None, penalty: float = 1.0, numeric: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Replicates of the raw and the overlap-weighted risks of both groups with their differences and ratios, the score fitted anew in each.

    All replicates take their Newton steps in the same scans: with V the weights of the rows of a task (a column for each replicate) and XX the products of
    the covariates, V'XX has the information matrices of all replicates. Rows are resampled by Poisson counts. With ``cluster``, clusters are drawn whole and
    with replacement, and rows without one are resampled by themselves. Each replicate standardises numbers anew (a penalty on the common scale
    that grows with the replicate's variance); missing numbers take the whole sample's median. A replicate without one of the groups, or whose fit doesn't
    converge, has nulls and ``converged`` false, and with ``strict`` it is an error.
    """
    guard_predictors([*numeric, *columns])
    known = df.where(F.col(t).isin(0, 1) & F.col(y).isNotNull()).withColumn("__g", F.lit(0))
    data = fits.encoded(staged(known, "sample"), numeric, columns, drop_first=penalty == 0)
    prep = fits.preparations(data, [frozenset({0})])[0]
    clusters = 0
    rows = data.rows
    if cluster:
        names, clusters = with_global_rank(rows.where(column(cluster).isNotNull()).select(column(cluster).alias("__name")).distinct(), ["__name"], "__rank")
        rows = rows.join(small(names), column(cluster) == F.col("__name"), "left").withColumn("__cluster", F.coalesce(F.col("__rank") - 1, F.lit(-1)).cast("int"))
    else:
        rows = rows.withColumn("__cluster", F.lit(-1))
    by = ["__cluster", *data.columns(), t, y]
    # a cell costs far more than its bytes tell: a number of tasks that isn't cut by size
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = staged(rows.groupBy(*by).agg(F.count("*").alias("__n")).withColumn("__id", F.xxhash64(*by)).repartition(tasks, "__id"), "cells")
    fields = [*data.columns(), "__cluster", "__id", "__n", t, y]
    shape, width = fits.Encoded(None, data.numeric, data.categorical, data.levels, data.drop_first), len(data.names)
    upper = np.triu_indices(width)
    step = max(16, _SLICE_CELLS // replicates)

    def drawn(arrays):
        """Design matrix, treatment, outcome and multiplicities of a slice of cells."""
        ids, n, member = arrays["__id"].astype(np.int64), arrays["__n"], arrays["__cluster"]
        m = np.empty((len(ids), replicates))
        loose = member < 0
        if loose.any():
            m[loose] = multiplicities(ids[loose], n[loose], replicates, seed)
        if not loose.all():
            m[~loose] = cluster_draws(clusters, replicates, seed)[member[~loose]] * n[~loose, None]
        return shape.matrix(arrays, prep), arrays[t].astype(float), arrays[y].astype(float), m

    def slices(arrays):
        for at in range(0, len(arrays["__n"]), step):
            yield drawn({c: x[at : at + step] for c, x in arrays.items()})

    def sums(arrays, beta, active):
        on = np.flatnonzero(active)
        flat, gradient = np.zeros((len(on), len(upper[0]))), np.zeros((len(on), width))
        for x, tt, _, m in slices(arrays):
            m = m[:, on]
            p = fits.logistic(x @ beta[on].T)
            flat += (m * p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]])
            gradient += (m * (tt[:, None] - p)).T @ x
        for i, b in enumerate(on):
            info = np.zeros((width, width))
            info[upper] = flat[i]
            yield int(b), info, gradient[i]

    def totals(what: Callable, length: int) -> np.ndarray:
        """Sums over all cells of ``length`` numbers for each replicate."""

        def run(batches):
            import pyarrow as pa

            out = np.zeros((replicates, length))
            for batch in batches:
                for part in slices(fits.arrays_of(batch, fields)):
                    out += what(*part)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["place", "value"])

        got = cells.select(*fields).mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(replicates * length)
        out[got["place"].to_numpy()] = got["value"].to_numpy()
        return out.reshape(replicates, length)

    places = [1 + 2 * i for i in range(len(data.numeric))]
    weighed = totals(lambda x, tt, yy, m: m.T @ np.column_stack([np.ones(len(x)), tt, *[x[:, j] for j in places], *[x[:, j] ** 2 for j in places]]), 2 + 2 * len(places))
    size = weighed[:, 0]
    both = (size > 0) & (weighed[:, 1] > 0) & (weighed[:, 1] < size)
    ridge = np.full((replicates, width), float(penalty))
    ridge[:, 0] = 0.0
    for i, j in enumerate(places):
        mean = weighed[:, 2 + i] / np.maximum(size, 1)
        spread = np.maximum(weighed[:, 2 + len(places) + i] / np.maximum(size, 1) - mean**2, 0.0)
        ridge[:, j] = penalty * np.where(spread > 0, spread, 1.0)
    # all begin at the whole sample's fit, which is near
    whole, _ = fits.fit_models(data, [fits.Model(frozenset({0}), t)], penalty)
    result = fits.newton(cells, fields, sums, replicates, width, ridge, start=whole.beta[0] if whole.failure[0] is None else None)
    beta = result.beta

    def risks(x, tt, yy, m):
        e = fits.logistic(x @ beta.T)
        out = []
        for k in (1, 0):
            on = (tt == k).astype(float)
            w = (1 - e if k else e) * m * on[:, None]
            out += [(m * on[:, None]).sum(axis=0), (m * (on * yy)[:, None]).sum(axis=0), w.sum(axis=0), (w * yy[:, None]).sum(axis=0)]
        return np.column_stack(out)

    got = totals(risks, 8)
    good = both & result.converged & (got[:, [0, 2, 4, 6]] > 0).all(axis=1)
    if strict and not good.all():
        raise RuntimeError(f"{int((~good).sum())} of {replicates} replicates lack a group or haven't converged; no interval may be reported")
    lines = []
    for b in range(replicates):
        if not good[b]:
            lines.append((b, *[None] * len(MEASURES), False))
            continue
        raw1, ato1, raw0, ato0 = (float(got[b, i + 1] / got[b, i]) for i in (0, 2, 4, 6))
        lines.append((b, raw1, raw0, ato1, ato0, 100 * (raw1 - raw0), 100 * (ato1 - ato0), raw1 / raw0 if raw0 else None, ato1 / ato0 if ato0 else None, True))
    return df.sparkSession.createDataFrame(lines, "replicate long, " + ", ".join(f"{m} double" for m in MEASURES) + ", converged boolean")


def replicate_interval(replicates: DataFrame, point: float, level: float = 0.95, column: str = "estimate") -> DataFrame:
    """C20: percentile interval, standard error, normal interval and bias."""
    a, z = (1 - level) / 2, special.normal_quantile(1 - (1 - level) / 2)
    c = F.col(column)
    g = replicates.agg(F.count(c).alias("valid"), F.stddev_samp(c).alias("se"), F.avg(c).alias("m"))
    g = g.join(F.broadcast(quantiles(replicates, [], [column], (a, 1 - a)).select(F.col("q0").alias("lo"), F.col("q1").alias("hi"))), how="left")  # one row
    return g.select("valid", r(F.col("se"), 6).alias("se"), r(F.col("lo"), 6).alias("low"), r(F.col("hi"), 6).alias("high"), r(F.lit(point) - z * F.col("se"), 6).alias("normal_low"), r(F.lit(point) + z * F.col("se"), 6).alias("normal_high"), r(F.col("m") - point, 6).alias("bias"))


#: Populations of C22: everyone, and those whose score lies within bounds.
POPULATIONS = (("sem_trimming", 0.0, 1.0), ("0.01_0.99", 0.01, 0.99), ("0.05_0.95", 0.05, 0.95))


def aipw_scores(df: DataFrame, key: str, t: str, y: str, numeric: Sequence[str], categorical: Sequence[str], folds: int = 3, penalty: float = 1.0) -> DataFrame:
    """Each row's treatment score ``e`` and outcome probabilities ``m1``, ``m0`` by fits that haven't seen its fold.

    The three fits of every fold are joint: they take their steps in the same scans, each on its own rows (for the outcome those of one arm in the other
    folds) and with the preparation of those rows.
    """
    guard_predictors([*numeric, *categorical])
    known = known_groups(df.where(F.col(t).isNotNull() & F.col(y).isNotNull()), t)
    grouped = stratified_folds(known, key, t, folds).withColumn("__g", (F.col("fold") * 2 + F.col(t)).cast("int"))
    data = fits.encoded(staged(grouped, "arms"), numeric, categorical)
    models = []
    for k in range(folds):
        others = [j for j in range(folds) if j != k]
        models += [fits.Model(frozenset(2 * j + a for j in others for a in (0, 1)), t), *[fits.Model(frozenset(2 * j + a for j in others), y) for a in (1, 0)]]
    result, preps = fits.fit_models(data, models, penalty)
    raise_failures(result, [f"fold {k}, {n}" for k in range(folds) for n in ("e", "m1", "m0")])
    scores = [fits.score_by_group(data, result, preps, {2 * k + a: 3 * k + i for k in range(folds) for a in (0, 1)}).alias(n) for i, n in enumerate(("e", "m1", "m0"))]
    return data.rows.select(*map(column, known.columns), "fold", *scores)


@dataclass
class Aipw:
    """``rows`` (population, arm, psi, weight, and the influence value, which is psi less its population's mean) and what follows from them."""

    rows: DataFrame
    moments: DataFrame
    populations: Sequence[tuple[str, float, float]]
    whole: int

    def estimates(self) -> DataFrame:
        """Estimate, standard error by the influence function, interval, and rows kept and excluded, by population."""
        z, se = special.normal_quantile(0.975), F.col("s") / F.sqrt("n")
        names = self.rows.sparkSession.createDataFrame([(n,) for n, _, _ in self.populations], "population string")
        counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_1", "n_0")]
        return names.join(F.broadcast(self.moments), "population", "left").select("population", *counts, (F.lit(self.whole) - F.coalesce("n", F.lit(0))).alias("excluded"), r(F.col("m") * 100, 6).alias("difference_pp"), r(se * 100, 6).alias("se_pp"), r((F.col("m") - z * se) * 100, 6).alias("low_pp"), r((F.col("m") + z * se) * 100, 6).alias("high_pp"))

    def weights(self) -> DataFrame:
        """Kish's effective size, mean, largest and 99th percentile of the inverse probabilities, by population and arm."""
        w = F.col("weight")
        g = self.rows.groupBy("population", "arm").agg(F.count("*").alias("n"), r(F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"), r(F.avg(w), 6).alias("mean"), r(F.max(w), 6).alias("max"))
        return with_quantiles(g, self.rows, ["population", "arm"], "weight", (0.99,)).withColumn("p99", r(F.col("q0"), 6)).drop("q0")

    def influence(self, points: Sequence[float] = (0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0)) -> DataFrame:
        """Share of the variance that the 1 % largest influence values carry, the largest one and its part in the estimate, and quantiles, by population."""
        squares = self.rows.withColumn("square", F.col("influence") * F.col("influence"))
        q = quantiles(squares, ["population"], ["square", "influence"] if points else ["square"], (*points, 0.99))
        edge = q.where("variable = 'square'").select("population", F.col(f"q{len(points)}").alias("edge"))
        share = squares.join(F.broadcast(edge), "population").groupBy("population").agg(r(F.sum(F.when(F.col("square") >= F.col("edge"), F.col("square"))) / F.sum("square"), 6).alias("top_share"), r(F.max(F.abs("influence")), 6).alias("largest"), r(F.max(F.abs("influence")) / F.count("*") * 100, 6).alias("largest_pp"))
        if not points:
            return share
        at = q.where("variable = 'influence'").select("population", *[r(F.col(f"q{i}"), 6).alias(f"p{round(p * 100):02d}") for i, p in enumerate(points)])
        return share.join(F.broadcast(at), "population")  # a row for each population


def aipw_tables(df: DataFrame, key: str, t: str, y: str, numeric: Sequence[str], categorical: Sequence[str], folds: int = 3, clip: float = 0.01, populations: Sequence[tuple[str, float, float]] = POPULATIONS) -> Aipw:
    """Doubly robust difference under each trimming rule, and its diagnostics."""
    found = aipw_scores(df, key, t, y, numeric, categorical, folds)
    e = F.least(F.greatest(F.col("e"), F.lit(clip)), F.lit(1 - clip))
    psi = F.col("m1") - F.col("m0") + F.when(F.col(t) == 1, (F.col(y) - F.col("m1")) / e).otherwise(-(F.col(y) - F.col("m0")) / (1 - e))
    weight = F.when(F.col(t) == 1, 1 / e).otherwise(1 / (1 - e))
    inside = F.array(*[F.when(F.col("e").between(lo, hi), F.lit(n)) for n, lo, hi in populations])
    rows = found.select(F.col(t).alias("arm"), psi.alias("psi"), weight.alias("weight"), F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("population"))
    moments = staged(rows.groupBy("population").agg(F.count("*").alias("n"), F.count_if(F.col("arm") == 1).alias("n_1"), F.count_if(F.col("arm") == 0).alias("n_0"), F.avg("psi").alias("m"), F.stddev_samp("psi").alias("s")), "means")  # a row for each population
    moved = staged(rows.join(F.broadcast(moments.select("population", "m")), "population").select("population", "arm", "psi", "weight", (F.col("psi") - F.col("m")).alias("influence")), "influence")
    return Aipw(moved, moments, populations, found.count())


def aipw(df: DataFrame, key: str, t: str, y: str, numeric: Sequence[str], categorical: Sequence[str], folds: int = 3) -> DataFrame:
    """A row for each population: estimate, standard error, interval, and how much of the variance the top 1 % carry."""
    tables = aipw_tables(df, key, t, y, numeric, categorical, folds)
    return tables.estimates().join(F.broadcast(tables.influence(()).select("population", "top_share", "largest_pp")), "population", "left")


def welch(df: DataFrame, group: str, value: str) -> DataFrame:
    """Difference of two groups (1 - 0) with its Welch interval and p-value; moments by one aggregation, tails on the driver."""
    m = {x[group]: x for x in df.where(F.col(group).isin(0, 1)).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).collect()}
    a, b = m[1], m[0]
    se2 = a["v"] / a["n"] + b["v"] / b["n"]
    d, se = a["m"] - b["m"], se2**0.5
    dof = se2**2 / ((a["v"] / a["n"]) ** 2 / (a["n"] - 1) + (b["v"] / b["n"]) ** 2 / (b["n"] - 1))
    q = special.t_quantile(0.975, dof)
    return df.sparkSession.createDataFrame([(round(d, 4), round(se, 4), round(dof, 4), round(d - q * se, 4), round(d + q * se, 4), special.t_tail(d / se, dof))], "difference double, se double, df double, low double, high double, p double")


def welch_anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """Welch's F with its degrees of freedom, in closed form over the groups' moments."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).withColumn("w", F.col("n") / F.col("v"))
    s = g.agg(F.count("*").cast("double").alias("k"), F.sum("w").alias("all_w"), (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("all_m"))
    j = g.join(F.broadcast(s))
    rest = 1 - F.col("w") / F.col("all_w")
    a = j.agg(F.max("k").alias("k"), F.sum(F.col("w") * (F.col("m") - F.col("all_m")) * (F.col("m") - F.col("all_m"))).alias("b"), F.sum(rest * rest / (F.col("n") - 1)).alias("l"))
    k = F.col("k")
    return a.select(r(F.col("b") / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("l")), 6).alias("f"), r(k - 1).alias("df1"), r((k * k - 1) / (3 * F.col("l")), 4).alias("df2"))


def odds_ratios(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """Odds ratios with Wald intervals from the observed information, on rows without a null among the columns.

    Columns are centred and scaled for the Newton steps, whose sums Spark adds up by place; the driver gets one small matrix a step. Coefficients,
    information and gradient are those of the columns as they are. A fit that separates its rows, is singular or doesn't come to rest is an error.
    """
    data = df.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)]).dropna()
    data = staged(data, "complete")
    names = [f"__x{i}" for i in range(len(columns))]
    k = len(columns) + 1
    moments = data.agg(F.count("*").alias("n"), *[f(c) for c in names for f in (F.avg, F.stddev_pop)]).first()
    if not moments["n"]:
        raise ValueError("no complete rows")
    mean, spread = np.array(moments[1::2], float), np.array([s or 1.0 for s in moments[2::2]], float)

    def sums(arrays, beta, active):
        z = np.column_stack([np.ones(len(arrays["__y"])), *[(arrays[c] - mean[i]) / spread[i] for i, c in enumerate(names)]])
        p = fits.logistic(z @ beta[0])
        yield 0, (z * (p * (1 - p))[:, None]).T @ z, z.T @ (arrays["__y"] - p)

    result = fits.newton(data, ["__y", *names], sums, 1, k, np.zeros((1, k)))
    if result.converged[0] and np.linalg.cond(result.information[0]) > 1e12:  # columns that others give, or that don't vary
        result.failure[0] = "singular"
    raise_failures(result, ["odds ratios"])
    # scaled row = row @ to_scaled
    to_scaled = np.diag(np.concatenate([[1.0], 1 / spread]))
    to_scaled[0, 1:] = -mean / spread
    back = np.linalg.inv(to_scaled)
    beta, info, gradient = to_scaled @ result.beta[0], back.T @ result.information[0] @ back, back.T @ result.gradient[0]
    se, q = np.sqrt(np.diag(to_scaled @ np.linalg.inv(result.information[0]) @ to_scaled.T)), special.normal_quantile(0.975)
    rows = [(c, float(np.exp(b)), float(np.exp(b - q * s)), float(np.exp(b + q * s)), float(b), float(s), float(np.abs(gradient).max()), float(np.linalg.cond(info))) for c, b, s in zip(("(intercept)", *columns), beta, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, odds_ratio double, low double, high double, coefficient double, se double, gradient double, condition double")


def crude_odds_ratio(df: DataFrame, t: str, y: str) -> DataFrame:
    """From the two-by-two table."""
    n = lambda a, b: F.count_if((F.col(t) == a) & (F.col(y) == b)).cast("double")
    g = df.agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    return g.select("a", "b", "c", "d", r(F.col("a") * F.col("d") / (F.col("b") * F.col("c")), 6).alias("odds_ratio"), r(F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d")), 6).alias("se_log"))


def masked(n: Column, least: int = 10) -> Column:
    """Counts from 1 to 9 as text "<10"."""
    return F.when((n >= 1) & (n < least), f"<{least}").otherwise(n.cast("string"))


def rounded_recoverable(df: DataFrame, group: Sequence[str], n: str, least: int = 10) -> DataFrame:
    """Masks small cells, and rounds the other cells of a group in which exactly one is masked (it could be found by subtraction)."""
    from pyspark.sql import Window

    small = (F.col(n) >= 1) & (F.col(n) < least)
    k = F.sum(small.cast("int")).over(Window.partitionBy(*group))
    return df.withColumn("shown", F.when(small, f"<{least}").when(k == 1, (F.bround(F.col(n) / 10.0) * 10).cast("long").cast("string")).otherwise(F.col(n).cast("string")))


def merge_small_bins(df: DataFrame, bin_: str, n1: str, n0: str, least: int = 10) -> DataFrame:
    """Merges adjacent bins until both groups have 0 or at least ``least`` in each; a rest at the end joins the bin before.

    A fold over the ordered bins of one histogram (a few dozen), as an aggregate over an array.
    """
    item = F.struct(F.col(bin_).cast("long").alias("lo"), F.col(bin_).cast("long").alias("hi"), F.col(n1).cast("long").alias("a"), F.col(n0).cast("long").alias("b"))
    fine = lambda x: ((x == 0) | (x >= least))
    glue = lambda p, q: F.struct(p["lo"].alias("lo"), q["hi"].alias("hi"), (p["a"] + q["a"]).alias("a"), (p["b"] + q["b"]).alias("b"))
    kind = "array<struct<lo:bigint,hi:bigint,a:bigint,b:bigint>>"

    def step(done, x):
        last = F.element_at(done, -1)
        return F.when(F.size(done) == 0, F.array(x)).when(fine(last["a"]) & fine(last["b"]), F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(glue(last, x))))

    def finish(done):
        last, before = F.element_at(done, -1), F.try_element_at(done, F.lit(-2))
        return F.when((F.size(done) > 1) & ~(fine(last["a"]) & fine(last["b"])), F.concat(F.slice(done, 1, F.size(done) - 2), F.array(glue(before, last)))).otherwise(done)

    folded = F.aggregate(F.sort_array(F.collect_list(item)), F.array().cast(kind), step, finish)
    return df.agg(folded.alias("x")).select(F.inline("x")).toDF("first_bin", "last_bin", n1, n0)


def merged_levels(df: DataFrame, level: str, groups: Mapping[str, str], least: int = 10) -> DataFrame:
    """Counts of merged levels; a level that is still small is an error."""
    g = df.groupBy(features.merge_levels(F.col(level), groups).alias("level")).agg(F.count("*").alias("n"))
    return g.withColumn("n", F.when(F.col("n") >= least, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("level is still small: "), F.col("level"))).cast("long")))
