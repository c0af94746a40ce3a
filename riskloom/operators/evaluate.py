"""Splits, models, evaluation and drift."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions import bands, special
from riskloom.operators.aggregates import cumulative_share, r
from riskloom.operators.audit import long_rows, unpivoted
from riskloom.operators.boosting import Trees, coded, fit_boosting
from riskloom.operators.dealing import ArrayScore, cleaned_exchanges, dealt_aucs
from riskloom.operators.forest import fit_forest
from riskloom.operators.joins import small
from riskloom.operators.ordered import prefix_sums, quantile_list, quantiles, score_table, with_global_rank, with_group_rank, with_totals
from riskloom.sources.staging import staged

# splits


def temporal_cut(df: DataFrame, day: str, share: float = 0.75) -> DataFrame:
    """M1: the date of the row at that place of the date order, from counts per date (one row per date). One row ``cut``."""
    per = df.groupBy(F.col(day).alias("d")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    n = df.agg(F.floor(F.count("*") * share).alias("at"))
    return per.withColumn("run", run).join(F.broadcast(n)).where("run > at").agg(F.min("d").alias("cut"))


def temporal_split(df: DataFrame, day: str, share: float = 0.75) -> DataFrame:
    return df.join(F.broadcast(temporal_cut(df, day, share))).withColumn("split", F.when(F.col(day) <= F.col("cut"), "train").otherwise("test")).drop("cut")


def window_splits(df: DataFrame, vintage: str, label: str, plans: Mapping[str, Sequence[int]]) -> DataFrame:
    """M2: volume and rate of train, validation and test windows of so many vintages each, for several plans."""
    ranked = df.groupBy(vintage).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("events")).withColumn("k", F.row_number().over(Window.orderBy(vintage)))
    rows = []
    for plan, sizes in plans.items():
        at = 0
        for part, size in zip(("train", "val", "test"), sizes, strict=True):
            rows.append((plan, part, at + 1, at + size))
            at += size
    w = df.sparkSession.createDataFrame(rows, "plan string, part string, lo int, hi int")
    whole = Window.partitionBy("plan")
    g = ranked.join(F.broadcast(w), (F.col("k") >= F.col("lo")) & (F.col("k") <= F.col("hi"))).groupBy("plan", "part").agg(F.sum("n").alias("n"), F.sum("events").alias("events"), F.min(vintage).alias("first"), F.max(vintage).alias("last"))
    return g.withColumn("percent", r(F.col("n") * 100.0 / F.sum("n").over(whole))).withColumn("rate", r(F.col("events") / F.col("n"), 6))


def _hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.lit(seed))


def group_split(df: DataFrame, group: str, label: str, fractions: tuple[float, float] = (0.70, 0.15), seed: int = 42) -> DataFrame:
    """M3: each group whole into train, val or test, stratified by the group's class: counts by floor, the rest to test."""
    g = df.groupBy(group).agg(F.max(label).alias("__c"))
    g = with_group_rank(g.withColumn("__h", _hash_order(group, seed)), ["__c"], ["__h", group], "__r", "__n")
    a, b = F.floor(F.col("__n") * fractions[0]), F.floor(F.col("__n") * fractions[1])
    g = g.select(group, F.when(F.col("__r") <= a, "train").when(F.col("__r") <= a + b, "val").otherwise("test").alias("split"))
    return df.join(g, group)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """M4: folds of equal size within each class, by hash order. Ranks are counted within 64 salted parts of a class, whose
    sizes are summed up before, so a class isn't one task."""
    s = df.withColumn("__h", _hash_order(key, seed)).withColumn("__s", F.shiftright("__h", 58))
    before = F.sum("c").over(Window.partitionBy(label).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    offsets = s.groupBy(label, "__s").agg(F.count("*").alias("c")).select(F.col(label).alias("__l"), F.col("__s").alias("__t"), F.coalesce(before, F.lit(0)).alias("__o"))
    local = F.row_number().over(Window.partitionBy(label, "__s").orderBy("__h", key)) - 1
    j = s.withColumn("__p", local).join(F.broadcast(offsets), F.col(label).eqNullSafe(F.col("__l")) & (F.col("__s") == F.col("__t")))
    return j.withColumn("fold", F.pmod(F.col("__p") + F.col("__o"), F.lit(folds)).cast("int")).drop("__h", "__s", "__l", "__t", "__o", "__p")


def holdout(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """M4: stratified 80/20."""
    return stratified_folds(df, key, label, 5, seed).withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train")).drop("fold")


def expanding_folds(df: DataFrame, day: str, folds: int = 4) -> DataFrame:
    """M5: rows of (fold, part): training dates before each fold's test dates, which are equal-count blocks of the date order."""
    per = df.groupBy(F.col(day).alias("__d")).agg(F.count("*").alias("n"))
    n = df.agg(F.count("*").alias("t"))
    block = F.least(F.lit(folds), F.floor((F.sum("n").over(Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")) * (folds + 1) / F.col("t"))).cast("int")
    dated = per.join(F.broadcast(n)).select("__d", block.alias("block"))
    return df.join(small(dated), F.col(day) == F.col("__d")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).where("block <= fold").withColumn("part", F.when(F.col("block") < F.col("fold"), "train").otherwise("test")).drop("__d", "block")


def balanced_groups(df: DataFrame, split: str, label: str, group: str, seed: int = 42) -> DataFrame:
    """M6: as many groups of each class in a split as the rarest class has, by hash order."""
    g = df.select(split, label, group).distinct()
    least = g.groupBy(split, label).agg(F.count("*").alias("c")).groupBy(split).agg(F.min("c").alias("__least"))
    ranked = with_group_rank(g.withColumn("__h", _hash_order(group, seed)), [split, label], ["__h", group], "__r", "__n").join(small(least), split)
    return df.join(ranked.where("__r <= __least").select(split, label, group), [split, label, group], "left_semi")


# metrics


def ranking_metrics(df: DataFrame, score: str, label: str, count: str | None = None) -> DataFrame:
    """Area under the curve (ties by mid-rank), Gini, largest distance of the curves, average precision (steps). ``count``: how many rows a
    row stands for."""
    t = score_table(df, score, label, (), count)
    auc = F.sum(F.col("n1") * (F.col("neg") - F.col("fp") + F.col("n0") / 2.0)) / (F.max("pos").cast("double") * F.max("neg"))
    ks = F.max(F.abs(F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg")))
    ap = F.sum(F.col("n1") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return t.agg(auc.alias("a"), ks.alias("k"), ap.alias("p")).select(r(F.col("a"), 6).alias("auc"), r(2 * F.col("a") - 1, 6).alias("gini"), r(F.col("k"), 6).alias("ks"), r(F.col("p"), 6).alias("average_precision"))


def grouped_auc(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """AUC, KS per group: running counts over the distinct scores of each group, which may lie in many tasks."""
    c = score_table(df, score, label, by)
    auc = F.sum(F.col("n1") * (F.col("neg") - F.col("fp") + F.col("n0") / 2.0)) / (F.max("pos").cast("double") * F.max("neg"))
    return c.where("pos > 0 and neg > 0").groupBy(*by).agg(r(auc, 6).alias("auc"), r(2 * auc - 1, 6).alias("gini"), r(F.max(F.abs(F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg"))), 6).alias("ks"))


def probability_metrics(df: DataFrame, probability: str, label: str, clip: float = 1e-15) -> DataFrame:
    """Brier score, log-loss, prevalence, mean prediction and its gap."""
    p, y = F.col(probability).cast("double"), F.col(label).cast("double")
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return df.agg(F.count("*").alias("n"), r(F.avg((p - y) * (p - y)), 6).alias("brier"), r(-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q)), 6).alias("log_loss"), r(F.avg(y), 6).alias("prevalence"), r(F.avg(p), 6).alias("mean_prediction"), r(F.avg(p) - F.avg(y), 6).alias("gap"))


def threshold_metrics(df: DataFrame, by: Sequence[str], probability: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts and what follows from them; division by zero gives 0."""
    p, y = F.col(probability) >= threshold, F.col(label) == 1
    g = df.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rec, spec, prec = over(tp, tp + fn), over(tn, tn + fp), over(tp, tp + fp)
    return g.select(*by, "tp", "tn", "fp", "fn", r(over(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"), r((rec + spec) / 2, 6).alias("balanced_accuracy"), r(prec, 6).alias("precision"), r(rec, 6).alias("recall"), r(spec, 6).alias("specificity"), r(over(2 * prec * rec, prec + rec), 6).alias("f1"))


def decile_table(df: DataFrame, probability: str, label: str, key: str, bins: int = 10) -> DataFrame:
    """Bins of the rank, highest risk first, with lift and cumulative capture."""
    b = bands.rank_bins(df, probability, key, bins).withColumn("bin", bins + 1 - F.col("bin"))
    y = F.col(label).cast("double")
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("events"), F.avg(y).alias("__r"), r(F.avg(probability), 6).alias("mean_p"), r(F.min(probability), 6).alias("min_p"), r(F.max(probability), 6).alias("max_p"))
    whole = df.agg(F.avg(y).alias("__all"))
    g = g.join(F.broadcast(whole)).select("bin", "n", "events", r(F.col("__r"), 6).alias("rate"), "mean_p", "min_p", "max_p", r(F.col("__r") / F.col("__all"), 6).alias("lift"))
    return cumulative_share(g, "bin", "events")


def threshold_sweep(df: DataFrame, probability: str, label: str, quantiles: Sequence[float]) -> DataFrame:
    """Precision, recall, F1, approval rate, bad rate of approved and blocked at the score's quantiles, in one further pass."""
    edges = quantile_list(df, probability, quantiles)
    p, y = F.col(probability), F.col(label) == 1
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(None))
    fields = {}
    for q, e in zip(quantiles, edges, strict=True):
        hit, flagged, bad, ok = F.count_if((p >= e) & y), F.count_if(p >= e), F.count_if(y), F.count_if(p < e)
        prec, rec = over(hit, flagged), over(hit, bad)
        fields[str(q)] = {"threshold": r(F.lit(e), 6), "precision": r(prec, 6), "recall": r(rec, 6), "f1": r(over(2 * prec * rec, prec + rec), 6), "approval": r(ok / F.count("*"), 6), "bad_approved": r(over(bad - hit, ok), 6), "bad_blocked": r(prec, 6)}
    return long_rows(df, fields, ("threshold", "precision", "recall", "f1", "approval", "bad_approved", "bad_blocked"), "quantile")


def reliability(df: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-width bins closed on the left; bins without rows are kept with nulls."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), r(F.avg(probability), 6).alias("mean_p"), r(F.avg(F.col(label).cast("double")), 6).alias("rate"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(g, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def wilson(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    z = special.normal_quantile(1 - (1 - level) / 2)
    p = k / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def quantile_calibration(df: DataFrame, probability: str, label: str, key: str, bins: int = 10) -> DataFrame:
    """Equal-count bins with Wilson's interval of the rate."""
    g = bands.rank_bins(df, probability, key, bins).groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("events"), r(F.avg(probability), 6).alias("mean_p"))
    low, high = wilson(F.col("events"), F.col("n"))
    return g.select("bin", "n", "events", "mean_p", r(F.col("events") / F.col("n"), 6).alias("rate"), r(low, 6).alias("low"), r(high, 6).alias("high"))


def calibration_slope(df: DataFrame, probability: str, label: str, least_range: float = 1e-3, steps: int = 30) -> DataFrame:
    """Slope and intercept of the label's logit on the prediction's; null if predictions hardly differ. Newton steps over sums."""
    p = F.least(F.greatest(F.col(probability).cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))
    data = df.select(F.log(p / (1 - p)).alias("x"), F.col(label).cast("double").alias("y"), p.alias("p")).groupBy("x", "p").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    data = staged(data, "logits")
    lo, hi = data.agg(F.min("p"), F.max("p")).first()
    if lo is None or hi - lo < least_range:
        return df.sparkSession.createDataFrame([(None, None)], "intercept double, slope double")
    a, b = 0.0, 0.0
    for _ in range(steps):
        m = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w, g = F.col("n") * m * (1 - m), F.col("y") - F.col("n") * m
        x = F.col("x")
        s = data.agg(F.sum(w), F.sum(w * x), F.sum(w * x * x), F.sum(g), F.sum(g * x)).first()
        step = np.linalg.solve(np.array([[s[0], s[1]], [s[1], s[2]]]), np.array([s[3], s[4]]))
        a, b = a + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-10:
            break
    return df.sparkSession.createDataFrame([(round(a, 6), round(b, 6))], "intercept double, slope double")


def curves(df: DataFrame, score: str, label: str) -> DataFrame:
    """Points of both curves at each distinct score, for ``thinned``."""
    t = score_table(df, score, label)
    return t.select("score", r(F.col("fp") / F.col("neg"), 6).alias("fpr"), r(F.col("tp") / F.col("pos"), 6).alias("tpr"), r(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"))


# drift


def _psi(a: Column, b: Column, eps: float) -> Column:
    p, q = F.greatest(a, F.lit(eps)), F.greatest(b, F.lit(eps))
    return F.sum((q - p) * F.log(q / p))


def _psi_of(counts: DataFrame, by: Sequence[str], eps: float) -> DataFrame:
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    c = counts.withColumn("a", F.try_divide(F.col("n_ref"), F.sum("n_ref").over(w))).withColumn("b", F.try_divide(F.col("n_new"), F.sum("n_new").over(w)))
    return c.groupBy(*by).agg(r(_psi(F.col("a"), F.col("b"), eps), 6).alias("psi"))


def numeric_bin(value: Column, edges: Sequence[float], special_codes: Sequence[float] = ()) -> Column:
    """Bins of the reference's quantile edges with open ends; missing values and each special code are bins of their own."""
    code = F.lit("MISSING")
    found = F.when(value.isNull(), code)
    for s in special_codes:
        found = found.when(value == s, f"SPECIAL_{int(s)}")
    return found.otherwise(bands.cut(value, edges, open_ends=True).cast("string"))


def reference_edges(ref: DataFrame, column: str, bins: int, special_codes: Sequence[float] = ()) -> list[float]:
    known = ref.where(~F.col(column).isin(*special_codes)) if special_codes else ref
    return bands.quantile_edges(known, column, [i / bins for i in range(bins + 1)])


def psi_numeric(ref: DataFrame, new: DataFrame, column: str, bins: int = 10, special_codes: Sequence[float] = (), eps: float = 1e-4) -> DataFrame:
    """Null if the reference has fewer than two edges; shares are floored, not renormalised."""
    edges = reference_edges(ref, column, bins, special_codes)
    if len(edges) < 2:
        return ref.sparkSession.createDataFrame([(None,)], "psi double")
    b = numeric_bin(F.col(column), edges, special_codes)
    both = ref.select(b.alias("bin"), F.lit(1).alias("r")).unionByName(new.select(b.alias("bin"), F.lit(0).alias("r")))
    return _psi_of(both.groupBy("bin").agg(F.count_if(F.col("r") == 1).alias("n_ref"), F.count_if(F.col("r") == 0).alias("n_new")), [], eps)


def psi_categorical(ref: DataFrame, new: DataFrame, column: str, eps: float = 1e-4) -> DataFrame:
    """Over the union of levels (null is one)."""
    both = ref.select(F.col(column).cast("string").alias("bin"), F.lit(1).alias("r")).unionByName(new.select(F.col(column).cast("string").alias("bin"), F.lit(0).alias("r")))
    return _psi_of(both.groupBy("bin").agg(F.count_if(F.col("r") == 1).alias("n_ref"), F.count_if(F.col("r") == 0).alias("n_new")), [], eps)


def psi_matrix(df: DataFrame, vintage: str, reference: Column, numeric: Sequence[str], categorical: Sequence[str] = (), bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Each feature and later vintage against the frozen reference, in one pass over the unpivoted bins."""
    ref = df.where(reference)
    binned = df.select(vintage, reference.alias("__ref"), *[numeric_bin(F.col(c), reference_edges(ref, c, bins)).alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    long = unpivoted(binned, [*numeric, *categorical], [vintage, "__ref"])
    base = long.where("__ref").groupBy("variable", "value").agg(F.count("*").alias("n_ref"))
    later = long.where("not __ref").groupBy(vintage, "variable", "value").agg(F.count("*").alias("n_new"))
    pairs = later.select(vintage, "variable").distinct()
    bins_of = base.select("variable", "value").unionByName(later.select("variable", "value")).distinct()
    grid = pairs.join(bins_of, "variable")
    full = grid.alias("g").join(base.alias("b"), (F.col("g.variable") == F.col("b.variable")) & F.col("g.value").eqNullSafe(F.col("b.value")), "left").select(f"g.{vintage}", "g.variable", "g.value", F.coalesce("n_ref", F.lit(0)).alias("n_ref"))
    full = full.alias("f").join(later.alias("l"), (F.col(f"f.{vintage}") == F.col(f"l.{vintage}")) & (F.col("f.variable") == F.col("l.variable")) & F.col("f.value").eqNullSafe(F.col("l.value")), "left").select(f"f.{vintage}", "f.variable", "f.n_ref", F.coalesce("n_new", F.lit(0)).alias("n_new"))
    return _psi_of(full, [vintage, "variable"], eps)


def psi_summary(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("variable").agg(F.max("psi").alias("max_psi"), r(F.avg("psi"), 6).alias("mean_psi"))


# comparison of models


#: Distinct probabilities that one task resamples.
BLOCK_ROWS = 10_000


def resamples(n1: np.ndarray, n0: np.ndarray, draws: Sequence[tuple[int, int]], seed: int, block: int):
    """Draws with replacement among the groups of a block, counted by cell: ``replicate, k1, k0`` for each (replicate, number of draws)."""
    counts = np.concatenate([n1, n0])
    total = int(counts.sum())
    slots = np.repeat(np.arange(len(counts)), counts) if total <= 8 * len(counts) else None  # else a cell holds many groups
    for k, n in draws:
        rng = np.random.default_rng([seed, block + 1, int(k)])
        got = rng.multinomial(n, counts / total) if slots is None else np.bincount(slots[rng.integers(0, total, n)], minlength=len(counts))
        yield int(k), got[: len(n1)], got[len(n1) :]


def bootstrap_metrics(df: DataFrame, group: str, probability: str, label: str, replicates: int = 2000, threshold: float = 0.5, seed: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Group-level resamples of the eight metrics; resamples with one class are skipped. Groups without a probability or label don't count.

    Groups of one probability and label are alike, so each replicate draws counts of them, as many in all as there are groups. Blocks of the
    order of probabilities are resampled apart: a multinomial draw over their sizes (the driver has one number per block) says
    how many draws each gets, and only sums per replicate and block leave a task. Average precision needs the counts above a block, so it is a second pass
    over the same seeded draws.
    """
    spark = df.sparkSession
    g = df.groupBy(group).agg(F.avg(probability).alias("p"), F.max(label).cast("long").alias("y")).where("p is not null and y is not null")
    ranked, _ = with_global_rank(g.groupBy((-F.col("p")).alias("s")).agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")), ["s"])
    cells = ranked.select(F.floor((F.col("rank") - 1) / block_rows).cast("long").alias("block"), "s", "n1", "n0")
    cells = staged(cells, "cells")
    found = sorted(cells.groupBy("block").agg(F.sum(F.col("n1") + F.col("n0"))).collect())  # one row per block
    blocks, sizes = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
    shared = spark.sparkContext.broadcast((blocks, sizes))

    def split(batches):
        import pandas as pd

        blocks, sizes = shared.value
        for frame in batches:
            for k in frame["id"] if len(sizes) else ():
                yield pd.DataFrame({"block": blocks, "replicate": int(k), "draws": np.random.default_rng([seed, 0, int(k)]).multinomial(sizes.sum(), sizes / sizes.sum())})

    def drawn(key, cells, draws):
        cells = cells.sort_values("s")
        return cells["s"].to_numpy(), resamples(cells["n1"].to_numpy(), cells["n0"].to_numpy(), list(zip(draws["replicate"], draws["draws"], strict=True)), seed, int(key[0]))

    def sums(key, cells, draws):
        import pandas as pd

        s, made = drawn(key, cells, draws)
        hit = s <= -threshold
        rows = [(key[0], k, n, int(a.sum()), int(b.sum()), int(a[hit].sum()), int(b[hit].sum()), float((a * (b.sum() - np.cumsum(b) + b / 2)).sum())) for (k, a, b), n in zip(made, draws["draws"], strict=True)]
        return pd.DataFrame(rows, columns=["block", "replicate", "draws", "pos", "neg", "tp", "fp", "pairs"])

    def steps(key, cells, draws):
        import pandas as pd

        rows = []
        for (k, a, b), above1, above0 in zip(drawn(key, cells, draws)[1], draws["above1"], draws["above0"], strict=True):
            tp, at = above1 + np.cumsum(a), a > 0
            rows.append((k, float((a[at] * tp[at] / (tp + above0 + np.cumsum(b))[at]).sum())))
        return pd.DataFrame(rows, columns=["replicate", "steps"])

    every = spark.range(replicates, numPartitions=min(32, replicates))
    by_block = cells.groupBy("block").cogroup(every.mapInPandas(split, "block long, replicate long, draws long").groupBy("block"))
    parts = by_block.applyInPandas(sums, "block long, replicate long, draws long, pos long, neg long, tp long, fp long, pairs double")
    parts = staged(parts, "parts")
    w = Window.partitionBy("replicate").orderBy("block")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    placed = parts.select("*", *[F.coalesce(F.sum(c).over(o), F.lit(0)).alias(n) for c, o, n in (("pos", before, "above1"), ("neg", before, "above0"), ("neg", after, "below0"))])
    total = placed.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp")], F.sum(F.col("pairs") + F.col("pos") * F.col("below0")).alias("pairs"))
    precise = cells.groupBy("block").cogroup(placed.select("block", "replicate", "draws", "above1", "above0").groupBy("block")).applyInPandas(steps, "replicate long, steps double").groupBy("replicate").agg(F.sum("steps").alias("steps"))
    known = total.join(precise, "replicate").where("pos > 0 and neg > 0")
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rec, spec, prec = tp / pos, (neg - fp) / neg, over(tp, tp + fp)
    values = ((tp + neg - fp) / (pos + neg), (rec + spec) / 2, prec, rec, spec, over(2 * prec * rec, prec + rec), F.col("pairs") / (pos.cast("double") * neg), F.col("steps") / pos)
    return every.withColumnRenamed("id", "replicate").join(known.select("replicate", *[v.alias(m) for m, v in zip(METRICS, values, strict=True)]), "replicate", "left")


METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "roc_auc", "average_precision")


def metrics_of(p: np.ndarray, y: np.ndarray, threshold: float = 0.5) -> tuple:
    """The eight metrics of one resample; all None if it has one class."""
    if y.min() == y.max():
        return (None,) * 8
    hit = p >= threshold
    tp, tn, fp, fn = (int((a & b).sum()) for a, b in ((hit, y == 1), (~hit, y == 0), (hit, y == 0), (~hit, y == 1)))
    rec, spec, prec = tp / (tp + fn), tn / (tn + fp), tp / (tp + fp) if tp + fp else 0.0
    s, at = np.unique(-p, return_inverse=True)
    n1, n0 = np.bincount(at, y, len(s)), np.bincount(at, 1 - y, len(s))
    a, b = np.cumsum(n1), np.cumsum(n0)
    auc = float((n1 * (b[-1] - b + n0 / 2)).sum() / (a[-1] * b[-1]))
    return (tp + tn) / len(p), (rec + spec) / 2, prec, rec, spec, 2 * prec * rec / (prec + rec) if prec + rec else 0.0, auc, float((n1 / a[-1] * a / (a + b)).sum())


def metric_intervals(replicates: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    valid = long_rows(replicates, {m: {"valid": F.count(m)} for m in metrics}, ("valid",), "metric")
    ends = quantiles(replicates, [], metrics, (0.025, 0.975)).select(F.col("variable").alias("metric"), r(F.col("q0"), 6).alias("low"), r(F.col("q1"), 6).alias("high"))
    return valid.join(F.broadcast(ends), "metric", "left")  # a row for each metric


def group_metrics(df: DataFrame, group: str, probability: str, label: str, threshold: float = 0.5) -> DataFrame:
    """``metric, estimate`` of the groups themselves: a group has its mean probability and its largest label."""
    g = staged(df.groupBy(group).agg(F.avg(probability).alias("p"), F.max(label).cast("long").alias("y")).where("p is not null and y is not null"), "groups")
    counts = threshold_metrics(g, [], "p", "y", threshold)
    both = counts.join(F.broadcast(ranking_metrics(g, "p", "y").select(F.col("auc").alias("roc_auc"), "average_precision")))  # one row
    return both.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate")) for m in METRICS])))


def bootstrap_intervals(df: DataFrame, group: str, probability: str, label: str, replicates: int = 2000, threshold: float = 0.5, seed: int = 5) -> DataFrame:
    """Each metric's estimate with its percentile interval over resamples of groups, and how many resamples had both classes."""
    made = staged(bootstrap_metrics(df, group, probability, label, replicates, threshold, seed), "replicates")
    return group_metrics(df, group, probability, label, threshold).join(F.broadcast(metric_intervals(made)), "metric", "left").withColumn("replicates", F.lit(replicates))


RANK_WEIGHTS = {"auc": (0.35, "desc"), "ks": (0.25, "desc"), "ap": (0.10, "desc"), "brier": (0.15, "asc"), "log_loss": (0.10, "asc"), "gap": (0.05, "asc")}


def choose_model(df: DataFrame, model: str = "model") -> DataFrame:
    """Weighted ranks of a few models."""
    from riskloom.operators.aggregates import metric_ranks

    t = metric_ranks(df, {m: d for m, (_, d) in RANK_WEIGHTS.items()})
    total = sum((F.col(f"rank_{m}") * w for m, (w, _) in RANK_WEIGHTS.items()), F.lit(0.0))
    t = t.withColumn("weighted_rank", r(total, 6))
    return t.withColumn("place", F.row_number().over(Window.orderBy("weighted_rank", model)))


def compare_models(rows: DataFrame, base: str, other: str, metrics: Sequence[str]) -> DataFrame:
    """A row for each model and one of differences, whose interval is deliberately null."""
    wide = rows.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))
    a, b = wide.where(F.col("model") == base), wide.where(F.col("model") == other)
    d = a.alias("a").join(b.alias("b")).select(F.lit(f"{other} - {base}").alias("model"), *[r(F.col(f"b.{m}") - F.col(f"a.{m}"), 6).alias(m) for m in metrics])
    return wide.select("model", *[r(F.col(m), 6).alias(m) for m in metrics]).unionByName(d).withColumn("ci", F.lit(None).cast("double"))


#: Rounds of the keyed permutation.
_ROUNDS = 4


def dealt(place: Column, n: int, salt: Column) -> Column:
    """A permutation of 0 to n - 1, keyed by ``salt``: where a place's value is taken from.

    Places lie on a grid of about the root of n by the root of n, and Feistel rounds move each coordinate by a hash of the other, which can be undone and so
    is one to one. The few places that end outside 0 to n - 1 (less than a row of the grid) go through the rounds again until they are inside, which
    keeps the permutation one to one; one that were outside 40 times is an error.
    """
    wide = max(1, math.isqrt(max(n - 1, 0)) + 1)
    high = max(1, -(-n // wide))

    def turn(x: Column) -> Column:
        row, col = F.floor(x / wide), F.pmod(x, F.lit(wide))
        for k in range(0, 2 * _ROUNDS, 2):
            row = F.pmod(row + F.pmod(F.xxhash64(col, salt, F.lit(k)), F.lit(high)), F.lit(high))
            col = F.pmod(col + F.pmod(F.xxhash64(row, salt, F.lit(k + 1)), F.lit(wide)), F.lit(wide))
        return (row * wide + col).cast("long")

    first = turn(place.cast("long"))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(40)), first, lambda x, _: F.when(x < n, x).otherwise(turn(x)))
    found = F.when(first < n, first).otherwise(again)
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("a place wasn't dealt")).cast("long"))


def permutation_importance(score, df: DataFrame, columns: Sequence[str], label: str, key: str, repeats: int = 10, seed: int = 3) -> DataFrame:
    """Mean and deviation of the fall of the AUC over ``repeats`` dealings of each column's values. ``score``: frame to frame with column ``p``,
    or an ``ArrayScore``.

    Rows get dense places once; a dealing is a keyed permutation of places, so it needs no sort. With a function of frames all columns and repeats are
    rows of one frame, which is scored once, and their AUCs come from one set of running sums. With an ``ArrayScore`` (numeric columns) the
    same dealings go through blocks of numbers (``dealing``).
    """
    known = df.where(F.col(label).isNotNull()).select(key, label, *columns)
    with cleaned_exchanges(df.sparkSession):
        ranked, n = with_global_rank(known, [key], "__r", [label, *columns])
    if not n:
        return df.sparkSession.createDataFrame([], "variable string, auc_drop double, sd double, repeats long")
    ranked = ranked.withColumn("__r", F.col("__r") - 1)
    if isinstance(score, ArrayScore):
        salts = [[c * repeats + k + seed * 1_000_003 for k in range(repeats)] for c in range(len(columns))]
        aucs = dealt_aucs(ranked, n, "__r", columns, label, salts, score)
        place = F.when(F.col("deal") < 0, F.lit(-1)).otherwise(F.floor(F.col("deal") / repeats)).cast("int")
        return _auc_drops(staged(aucs.select(place.alias("__column"), r(F.col("auc"), 6).alias("auc")), "dealings"), columns)
    # for each row, column and repeat the place that the column's value is taken from; -1 is the frame as it is
    jobs = F.array(F.struct(F.lit(-1).alias("__c"), F.lit(0).alias("__k")), *[F.struct(F.lit(c).alias("__c"), F.lit(k).alias("__k")) for c in range(len(columns)) for k in range(repeats)])
    long = ranked.select(label, *columns, "__r", F.inline(jobs))
    salt = F.col("__c") * repeats + F.col("__k") + F.lit(seed) * 1_000_003
    long = long.withColumn("__from", F.when(F.col("__c") < 0, F.col("__r")).otherwise(dealt(F.col("__r"), n, salt)))
    source = ranked.select(F.col("__r").alias("__s"), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    # joined by place: every place is taken once by each job, so no key is hot
    joined = long.join(source, F.col("__from") == F.col("__s"))
    frame = joined.select(F.col("__c").alias("__column"), F.col("__k").alias("__repeat"), label, *[F.when(F.col("__c") == i, F.col(f"__v{i}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)])
    found = staged(grouped_auc(score(frame), ["__column", "__repeat"], "p", label), "dealings")
    return _auc_drops(found, columns)


def _auc_drops(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and deviation by column of how far the AUCs of ``found`` lie below that of column -1."""
    base = found.where("__column = -1").select(F.col("auc").alias("__base"))
    drop = F.col("__base") - F.col("auc")
    names = F.array(*map(F.lit, columns))
    return found.where("__column >= 0").join(F.broadcast(base)).groupBy("__column").agg(F.avg(drop).alias("auc_drop"), F.stddev_pop(drop).alias("sd"), F.count("*").alias("repeats")).select(F.element_at(names, F.col("__column") + 1).alias("variable"), "auc_drop", "sd", "repeats")


def consolidate_importance(a: DataFrame, b: DataFrame, key: str = "variable") -> DataFrame:
    """Both scaled by their largest value, mean of the two, in order. A row per variable."""
    from riskloom.operators.joins import outer_merge

    j = outer_merge(a, b, key)
    x, y = [c for c in j.columns if c != key]
    whole = Window.partitionBy(F.lit(1))
    j = j.withColumn("importance", r((F.col(x) / F.max(x).over(whole) + F.col(y) / F.max(y).over(whole)) / 2, 6))
    return j.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), key)))


def best_run(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best row by several criteria with ties broken in turn."""
    from riskloom.operators.joins import first_of

    return first_of(df, by, order)


def performance_by_vintage(df: DataFrame, vintage: str, probability: str, label: str) -> DataFrame:
    """AUC and KS with Brier score and bias of the predictions by vintage."""
    p, y = F.col(probability), F.col(label).cast("double")
    g = df.groupBy(vintage).agg(F.count("*").alias("n"), r(F.avg((p - y) * (p - y)), 6).alias("brier"), r(F.avg(p) - F.avg(y), 6).alias("bias"), r(F.when(F.avg(y) > 0, F.avg(p) / F.avg(y) - 1), 6).alias("relative_bias"))
    return g.join(grouped_auc(df, [vintage], probability, label), vintage, "left")


def expected_calibration_error(df: DataFrame, probability: str, label: str, key: str, bins: int = 10) -> DataFrame:
    """Over equal-count bins."""
    g = bands.rank_bins(df, probability, key, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg(probability).alias("p"), F.avg(F.col(label).cast("double")).alias("y"))
    return g.agg(r(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"), r(F.max(F.abs(F.col("p") - F.col("y"))), 6).alias("worst"))


def univariate(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """AUC and Gini of each feature alone."""
    long = unpivoted(df.where(F.col(label).isNotNull()), columns, [label], as_text=False).where("value is not null")
    return grouped_auc(long, ["variable"], "value", label)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks. Ranks come from running counts over distinct values (``score_table`` counts both labels)."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.lit(1).alias("__one"))

    def ranks(c: str) -> DataFrame:
        t = score_table(known, c, "__one")
        return t.select(F.col("score").alias(c), (F.col("tp") - (F.col("n1") - 1) / 2.0).alias(f"r{c}"))

    j = known.join(ranks("a"), "a").join(ranks("b"), "b")
    return j.agg(F.count("*").alias("n"), r(F.corr("ra", "rb"), 6).alias("spearman"))


def information_value(df: DataFrame, column: str, label: str, bins: int = 5, eps: float = 1e-4) -> DataFrame:
    """From the shares of events and non-events in quantile bands."""
    b = numeric_bin(F.col(column), reference_edges(df, column, bins))
    g = df.groupBy(b.alias("bin")).agg(F.count_if(F.col(label) == 1).alias("n_ref"), F.count_if(F.col(label) == 0).alias("n_new"))
    return _psi_of(g, [], eps).withColumnRenamed("psi", "information_value")


# models


def dummy(df: DataFrame, label: str, name: str = "p") -> DataFrame:
    """M7: the prior for every row, and the most frequent class."""
    prior = df.agg(F.avg(F.col(label).cast("double")).alias(name))
    return df.join(F.broadcast(prior)).withColumn("most_frequent", (F.col(name) >= 0.5).cast("int"))


def class_weights(df: DataFrame, label: str, name: str = "w") -> DataFrame:
    """M7: weights n / (2 * n of the class) for a balanced fit."""
    c = df.agg(F.count(label).alias("__n"), F.sum(F.col(label).cast("long")).alias("__p"))
    return df.join(F.broadcast(c)).withColumn(name, F.when(F.col(label) == 1, F.col("__n") / (2.0 * F.col("__p"))).otherwise(F.col("__n") / (2.0 * (F.col("__n") - F.col("__p"))))).drop("__n", "__p")


MODELS = ("logistic", "forest", "boosting", "histogram")


def feature_medians(df: DataFrame, columns: Sequence[str], label: str) -> dict[str, float]:
    """Exact medians of the columns over the rows with a label: what models of the same rows put in the place of missing values."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"features are missing: {missing}")
    df = df.where(F.col(label).isNotNull())
    return {x["variable"]: x["q0"] for x in quantiles(df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]), [], columns, (0.5,)).collect()}


def imputer(columns: Sequence[str], middle: Mapping[str, float]):
    """A stage that copies columns to ``__f0, ...`` with medians in the place of missing values; the medians are part of the saved model."""
    from pyspark.ml.feature import SQLTransformer

    filled = ", ".join(f"coalesce(nanvl(cast(`{c}` AS double), cast(NULL AS double)), cast({middle.get(c, 0.0)!r} AS double)) AS `__f{i}`" for i, c in enumerate(columns))
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def fit_model(df: DataFrame, kind: str, columns: Sequence[str], label: str, weight: str | None = None, key: str | None = None, medians: Mapping[str, float] | None = None, **options):
    """M8: a pipeline of median imputation, assembler and logistic regression; or forest or boosting of trees on rows with medians in the place of missing
    values, or boosting of histograms (``histogram``, which needs the unique ``key``), all over codes of 255 bins a column.

    ``medians``: what ``feature_medians`` gives, for several models of the same rows; without it they are found here."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    if kind == "histogram":
        return fit_boosting(df, columns, [], label, key, weight, **options)
    middle = feature_medians(df, columns, label) if medians is None else medians
    fills = {c: middle.get(c, 0.0) for c in columns}
    if kind == "forest":
        return fit_forest(df, columns, label, weight, **({"trees": 300, "depth": 6, "least_rows": 50, "fills": fills} | options))
    if kind == "boosting":
        return fit_boosting(df, columns, [], label, key, weight, **({"iterations": 250, "rate": 0.05, "depth": 3, "most_leaves": 8, "least_rows": 1, "l2": 0.0, "held_out": 0.0, "fills": fills} | options))
    if kind != "logistic":
        raise ValueError(f"unknown kind of model: {kind}")
    common = {"featuresCol": "__x", "labelCol": label} | ({"weightCol": weight} if weight else {})
    known = df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[imputer(columns, middle), VectorAssembler(inputCols=[f"__f{i}" for i in range(len(columns))], outputCol="__x", handleInvalid="error"), LogisticRegression(**common, **({"maxIter": 100} | options))]).fit(known)


def compared_models(df: DataFrame, columns: Sequence[str], label: str, weight: str, key: str) -> DataFrame:
    """M8: ranking metrics of each of ``MODELS`` on the rows that it is fitted on. Forest and boosting share their cells, and the scores of trees are measured
    over cells, so that only the logistic model's are made row by row."""
    medians = feature_medians(df, columns, label)
    start = coded(df, columns, [], label, weight=weight, fills={c: medians.get(c, 0.0) for c in columns})
    out = None
    for kind in MODELS:
        model = fit_model(df, kind, columns, label, weight, key, medians, **({"start": start} if kind in ("forest", "boosting") else {}))
        rows = ranking_metrics(model.scored_cells(), "p", "__y", "__n") if isinstance(model, Trees) else ranking_metrics(score_model(model, df.select(label, *columns), columns), "p", label)
        row = rows.withColumn("model", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


def score_model(model, df: DataFrame, columns: Sequence[str], name: str = "p") -> DataFrame:
    """Batch scores after a check that the features are there. Every row comes back with a score: missing features have the training rows' medians
    (or, in histograms, a way of their own)."""
    from pyspark.ml.functions import vector_to_array

    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"features are missing: {missing}")
    if isinstance(model, Trees):
        return model.score(df, name)
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction", *[f"__f{i}" for i in range(len(columns))])


def array_score(model, columns: Sequence[str]) -> ArrayScore:
    """The probability of a fitted ``logistic`` model as a function of arrays; missing values have the model's medians."""
    from pyspark.ml.classification import LogisticRegressionModel

    imputed, last = model.stages[0], model.stages[-1]
    if not isinstance(last, LogisticRegressionModel):
        raise ValueError("only logistic models score arrays")
    missing = imputed.transform(SparkSession.active().range(1).select(*[F.lit(None).cast("double").alias(c) for c in columns])).first()
    return ArrayScore(tuple(missing[f"__f{i}"] for i in range(len(columns))), tuple(map(float, last.coefficients)), float(last.intercept))


def score_saved(spark: SparkSession, path: str, df: DataFrame, columns: Sequence[str], name: str = "p") -> DataFrame:
    from pyspark.ml import PipelineModel

    return score_model(PipelineModel.load(path), df, columns, name)


def nested_probabilities(df: DataFrame, key: str, label: str, sets: Mapping[str, Sequence[str]], categorical: Sequence[str] = (), folds: int = 5) -> DataFrame:
    """M9: out-of-fold probabilities of unpenalised logistic models on nested sets of columns, with the fold: ``key, label, fold, p_<set>``.

    All sets and folds take their Newton steps in the same scans, each model on its block of the same sums; a set without columns is the training
    rows' prevalence. Preparation comes from the training rows. A model that doesn't converge is an error.
    """
    from riskloom.operators import fits

    known = df.where(F.col(label).isNotNull())
    columns = list(dict.fromkeys(c for x in sets.values() for c in x))
    numeric = [c for c in columns if c not in categorical]
    dealt_rows = stratified_folds(known.select(*dict.fromkeys([key, label, *columns])), key, label, folds)
    data = fits.encoded(staged(dealt_rows.withColumn("__g", F.col("fold")), "folds"), numeric, [c for c in columns if c in categorical], drop_first=True)
    names = [(k, n) for k in range(folds) for n in sets]
    result, preps = fits.fit_models(data, [fits.Model(frozenset(range(folds)) - {k}, label, frozenset(sets[n])) for k, n in names], penalty=0.0)
    if bad := [f"{n}, fold {k}: {f}" for (k, n), f in zip(names, result.failure, strict=True) if f is not None]:
        raise RuntimeError("models didn't converge: " + "; ".join(bad))
    scores = [fits.score_by_group(data, result, preps, {k: names.index((k, n)) for k in range(folds)}).alias(f"p_{n}") for n in sets]
    return data.rows.select(key, label, "fold", *scores)


def nested_models(df: DataFrame, key: str, label: str, sets: Mapping[str, Sequence[str]], categorical: Sequence[str] = (), folds: int = 5) -> DataFrame:
    """M9: ranking metrics of the out-of-fold probabilities of each set, and how many rows were scored."""
    scored = staged(nested_probabilities(df, key, label, sets, categorical, folds), "scored")
    long = scored.select(label, F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("p")) for n in sets])))
    rows = long.groupBy("model").agg(F.count("p").alias("scored"), r(F.avg("p"), 6).alias("mean_p"))
    return rows.join(grouped_auc(long, ["model"], "p", label), "model", "left")  # a row for each set


def time_blocks(df: DataFrame, day: str, folds: int = 4) -> DataFrame:
    """M5: ``block`` 0 to ``folds``: equal-count blocks of the date order, a date never in two of them."""
    per = df.groupBy(F.col(day).alias("__d")).agg(F.count("*").alias("n"))
    run = with_totals(prefix_sums(per, [], ["__d"], ["n"]), [], {"__t": F.sum("n")})
    dated = run.select("__d", F.least(F.lit(folds), F.floor(F.col("n_before") * (folds + 1) / F.col("__t"))).cast("int").alias("block"))
    return df.join(small(dated), F.col(day) == F.col("__d")).drop("__d")


def time_cv(df: DataFrame, day: str, label: str, columns: Sequence[str], kind: str = "logistic", folds: int = 4, key: str | None = None) -> DataFrame:
    """M5: metrics of each expanding-window fold (fold k trains on the blocks before block k and is tested on it), and their mean.

    Logistic models of all folds are fitted in the same scans. A fold whose test block has one class has null metrics, and the mean is over the others.
    """
    from riskloom.operators import fits

    known = df.where(F.col(label).isNotNull() & F.col(day).isNotNull())
    blocks = staged(time_blocks(known, day, folds).withColumn("__g", F.col("block")), "blocks")
    if kind == "logistic":
        data = fits.encoded(blocks, columns, [])
        result, preps = fits.fit_models(data, [fits.Model(frozenset(range(k)), label) for k in range(1, folds + 1)], penalty=1.0)
        if bad := [f"fold {k}: {f}" for k, f in enumerate(result.failure, 1) if f is not None]:
            raise RuntimeError("models didn't converge: " + "; ".join(bad))
        scored = data.rows.where("block > 0").withColumn("p", fits.score_by_group(data, result, preps, {k: k - 1 for k in range(1, folds + 1)}))
    else:
        scored = None
        for k in range(1, folds + 1):
            part = score_model(fit_model(blocks.where(F.col("block") < k), kind, columns, label, key=key), blocks.where(F.col("block") == k), columns)
            scored = part if scored is None else scored.unionByName(part)
    scored = staged(scored.select(F.col("block").alias("fold"), label, "p"), "scored")
    per = scored.groupBy("fold").agg(F.count("*").alias("n"), F.count("p").alias("scored")).join(grouped_auc(scored, ["fold"], "p", label), "fold", "left")
    mean = per.agg(F.lit("mean").alias("fold"), F.sum("n").alias("n"), F.sum("scored").alias("scored"), *[r(F.avg(c), 6).alias(c) for c in ("auc", "gini", "ks")])
    return per.withColumn("fold", F.col("fold").cast("string")).unionByName(mean)
