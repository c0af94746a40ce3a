"""Joint fits against NumPy: folds without leaks, replicates, years, doubly robust estimates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import causal as C, fits


def sample(seed=0, n=600, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    g = rng.choice(list("abc"), n, p=[0.5, 0.3, 0.2])
    t = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x + (g == "b") - 0.3)))).astype(int)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-1 + 0.5 * x - 0.4 * t + shift)))).astype(int)
    rows = [(i, None if i % 17 == 0 else float(a), None if i % 23 == 0 else str(b), int(c), int(d), 2000 + i % 3) for i, (a, b, c, d) in enumerate(zip(x, g, t, y, strict=True))]
    return rows


KIND = "key long, x double, g string, t int, y int, year int"


def design(rows, levels="abc"):
    """Design matrix of the rows' own preparation, and the preparation."""
    x = np.array([np.nan if r[1] is None else r[1] for r in rows])
    fill = np.nanmedian(x)
    filled = np.where(np.isnan(x), fill, x)
    mean, spread = filled.mean(), filled.std()
    known = [r[2] for r in rows if r[2] is not None]
    mode = min(sorted(set(known)), key=lambda v: -known.count(v))

    def matrix(rows):
        x = np.array([np.nan if r[1] is None else r[1] for r in rows])
        g = [r[2] or mode for r in rows]
        return np.column_stack([np.ones(len(rows)), (np.where(np.isnan(x), fill, x) - mean) / spread, np.isnan(x), *[[v == k for v in g] for k in levels]]).astype(float)

    return matrix


def fitted(rows, target=3, weight=None):
    m = design(rows)
    beta, _, ok = C.irls(m(rows), np.array([r[target] for r in rows], float), np.ones(len(rows)) if weight is None else weight, 1.0)
    assert ok
    return lambda other: 1 / (1 + np.exp(-m(other) @ beta))


def test_scores_come_from_the_other_folds(spark):
    rows = sample()
    got = C.cross_fitted(spark.createDataFrame(rows, KIND).repartition(5), "key", "t", ["x"], ["g"], 4)
    scored = {r["key"]: r for r in got.scores.collect()}
    assert sorted(scored) == [r[0] for r in rows]
    for k in range(4):
        p = fitted([r for r in rows if scored[r[0]]["fold"] != k])
        held = [r for r in rows if scored[r[0]]["fold"] == k]
        assert np.allclose(p(held), [scored[r[0]]["e"] for r in held], atol=1e-7)
    folds = got.folds.orderBy("fold").collect()
    assert all(r["converged"] and 0.5 < r["auc"] < 1 and r["n_train"] + r["n_test"] == len(rows) for r in folds) and 0.5 < got.auc < 1


def test_a_held_out_outlier_moves_no_score_of_its_fold(spark):
    rows = sample(3)
    before = {r["key"]: r for r in C.out_of_fold(spark.createDataFrame(rows, KIND), "key", "t", ["x"], ["g"], 3).collect()}
    at = 40
    wild = [(*r[:1], 1e6, "z", *r[3:]) if r[0] == at else r for r in rows]
    after = {r["key"]: r for r in C.out_of_fold(spark.createDataFrame(wild, KIND), "key", "t", ["x"], ["g"], 3).collect()}
    same = [k for k in before if before[k]["fold"] == before[at]["fold"] and k != at]
    assert all(abs(before[k]["e"] - after[k]["e"]) < 1e-9 for k in same)
    others = [abs(before[k]["e"] - after[k]["e"]) for k in before if before[k]["fold"] != before[at]["fold"]]
    assert max(others) > 1e-3


def test_one_group_and_separation_are_errors(spark):
    rows = sample()
    with pytest.raises(ValueError, match="both treatment groups"):
        C.out_of_fold(spark.createDataFrame([r for r in rows if r[3]], KIND), "key", "t", ["x"], [])
    apart = spark.createDataFrame([(i, float(i), "a", int(i >= 50), i % 2, 2000) for i in range(100)], KIND)
    with pytest.raises(RuntimeError, match="didn't converge"):
        C.propensity(apart, "t", ["x"], [], penalty=0.0)
    with pytest.raises(RuntimeError, match="replicates"):
        C.bootstrap(apart, "t", "y", [], 5, numeric=["x"], penalty=0.0)
    loose = C.bootstrap(apart, "t", "y", [], 5, numeric=["x"], penalty=0.0, strict=False).collect()
    assert len(loose) == 5 and not any(r["converged"] for r in loose) and all(r["ato_1"] is None for r in loose)


def test_odds_ratios_in_any_unit(spark):
    """Coefficients, errors and gradient are those of the columns as they are, however small or far from zero; nulls leave the row out."""
    rows = [r for r in sample(3) if r[1] is not None]
    frame = spark.createDataFrame(rows + [(10_000, None, "a", 1, 1, 2000)], KIND).withColumn("tiny", F.col("x") / 1000 + 5)
    got = {r["term"]: r for r in C.odds_ratios(frame, "y", ["tiny", "t"]).collect()}
    z = np.column_stack([np.ones(len(rows)), [r[1] for r in rows], [r[3] for r in rows]])
    y, beta = np.array([r[4] for r in rows], float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        cov = np.linalg.inv((z * (p * (1 - p))[:, None]).T @ z)
        beta = beta + cov @ z.T @ (y - p)
    assert abs(got["tiny"]["coefficient"] / (beta[1] * 1000) - 1) < 1e-6 and abs(got["tiny"]["se"] / (cov[1, 1] ** 0.5 * 1000) - 1) < 1e-6
    assert abs(got["t"]["coefficient"] - beta[2]) < 1e-7 and abs(got["t"]["se"] - cov[2, 2] ** 0.5) < 1e-7
    assert abs(got["(intercept)"]["coefficient"] - (beta[0] - 5000 * beta[1])) < 1e-3 and got["t"]["gradient"] < 1e-4
    assert abs(got["t"]["high"] / got["t"]["odds_ratio"] / np.exp(1.959963984540054 * cov[2, 2] ** 0.5) - 1) < 1e-7


def test_odds_ratios_that_do_not_exist_are_errors(spark):
    apart = spark.createDataFrame([(i, float(i), "a", int(i >= 50), i % 2, 2000) for i in range(100)], KIND)
    for y, columns in (("t", ["x"]), ("y", ["x", "x2"]), ("y", ["one"])):
        with pytest.raises(RuntimeError, match="didn't converge"):
            C.odds_ratios(apart.withColumn("x2", F.col("x") * 2).withColumn("one", F.lit(1.0)), y, columns)
    with pytest.raises(ValueError, match="no complete rows"):
        C.odds_ratios(apart.where("false"), "t", ["x"])


def ato(rows, weight):
    """Overlap-weighted and raw risks of weighted rows; numbers are standardised with the weights, missing ones have the whole sample's median."""
    m = design(rows)(rows)
    x = m[:, 1]
    mean = (weight * x).sum() / weight.sum()
    m[:, 1] = (x - mean) / np.sqrt((weight * (x - mean) ** 2).sum() / weight.sum())
    t, y = (np.array([r[i] for r in rows], float) for i in (3, 4))
    beta, _, ok = C.irls(m, t, weight, 1.0)
    e = 1 / (1 + np.exp(-m @ beta))
    w = np.where(t == 1, 1 - e, e) * weight
    risk = lambda w, k: (w * y)[t == k].sum() / w[t == k].sum()
    return risk(weight, 1), risk(weight, 0), risk(w, 1), risk(w, 0)


def test_replicates_equal_single_fits(spark):
    rows = sample(1, 300)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    got = C.bootstrap(df, "t", "y", ["g"], 6, seed=4, numeric=["x"]).orderBy("replicate").collect()
    data = fits.encoded(df.withColumn("__g", F.lit(0)), ["x"], ["g"])
    # the cells' ids as the operator makes them: rows that are alike share one
    cells = data.rows.groupBy(F.lit(-1).alias("__cluster"), "__x0", "__c0", "t", "y").agg(F.count("*").alias("n"), F.min("key").alias("key")).withColumn("id", F.xxhash64("__cluster", "__x0", "__c0", "t", "y")).collect()
    ids, n = np.array([c["id"] for c in cells], np.int64), np.array([c["n"] for c in cells])
    drawn = C.multiplicities(ids, n, 6, 4)
    by_key = {r[0]: r for r in rows}
    for b in range(6):
        # the preparation is the whole sample's, so weights are over all rows: a cell's draw stands on its first row
        weight = np.zeros(len(rows))
        for c, m in zip(cells, drawn[:, b], strict=True):
            weight[[r[0] for r in rows].index(c["key"])] = m
        want = ato([by_key[r[0]] for r in rows], weight)
        assert np.allclose([got[b][c] for c in C.RISKS], want, atol=1e-7)
        assert got[b]["converged"] and abs(got[b]["ato_difference_pp"] - 100 * (want[2] - want[3])) < 1e-5 and abs(got[b]["raw_ratio"] - want[0] / want[1]) < 1e-7
    assert len({r["ato_1"] for r in got}) == 6


def test_replicates_centre_on_the_estimate_and_are_seeded(spark):
    df = spark.createDataFrame(sample(2, 800), KIND)
    a, b = (C.bootstrap(df, "t", "y", ["g"], 200, numeric=["x"]).orderBy("replicate").toPandas() for _ in range(2))
    assert a.equals(b)
    point = C.estimate(df, "t", "y", ["x"], ["g"]).first()["difference_pp"]
    assert abs(a.ato_difference_pp.mean() - point) < 4 * a.ato_difference_pp.std() / 200**0.5 + 0.2
    # the spread is that of resampling rows one by one
    rows, rng = sample(2, 800), np.random.default_rng(0)
    spread = np.std([(lambda r: 100 * (r[2] - r[3]))(ato(rows, np.bincount(rng.integers(0, 800, 800), minlength=800).astype(float))) for _ in range(200)])
    assert 0.8 < a.ato_difference_pp.std() / spread < 1.25


def test_clusters_are_drawn_whole(spark):
    rows = [(*r, None if r[0] % 4 == 0 else r[0] % 7) for r in sample(5, 400)]
    df = spark.createDataFrame(rows, KIND + ", c int")
    got = C.bootstrap(df, "t", "y", [], 12, seed=9, cluster="c").orderBy("replicate").collect()
    assert all(r["converged"] for r in got) and len({r["ato_1"] for r in got}) == 12
    whole = [r for r in rows if r[6] is not None]
    only = C.bootstrap(spark.createDataFrame(whole, KIND + ", c int"), "t", "y", [], 12, seed=9, cluster="c").orderBy("replicate").collect()
    times = C.cluster_draws(7, 12, 9)
    assert times.sum(axis=0).tolist() == [7.0] * 12
    for b in range(12):
        w = np.array([times[r[6], b] for r in whole])
        t, y = (np.array([r[i] for r in whole]) for i in (3, 4))
        assert abs(only[b]["raw_1"] - (w * y)[t == 1].sum() / w[t == 1].sum()) < 1e-9


def test_years_are_fitted_by_themselves(spark):
    rows = sample(6) + [(9000 + i, float(i), "a", 1, i % 2, 2010) for i in range(20)]
    df = spark.createDataFrame(rows, KIND)
    got = {r["year"]: r for r in C.annual_series(df, "year", "t", "y", ["x"], ["g"], baseline=2001).collect()}
    assert sorted(got) == [2000, 2001, 2002, 2010] and got[2010]["error"] == "one treatment group" and got[2010]["risk_1"] is None and got[2010]["n"] == 20
    for year in (2000, 2001, 2002):
        mine = [r for r in rows if r[5] == year]
        e = fitted(mine)(mine)
        t, y = (np.array([r[i] for r in mine]) for i in (3, 4))
        w = np.where(t == 1, 1 - e, e)
        r1, r0 = ((w * y)[t == k].sum() / w[t == k].sum() for k in (1, 0))
        r = got[year]
        assert abs(r["risk_1"] - r1) < 2e-6 and abs(r["risk_0"] - r0) < 2e-6 and r["error"] is None
        assert abs(r["ess_1"] - w[t == 1].sum() ** 2 / (w[t == 1] ** 2).sum()) < 1e-3 and r["smd_after"] < r["smd_before"]
    with pytest.raises(RuntimeError, match="baseline 2010"):
        C.annual_series(df, "year", "t", "y", ["x"], ["g"], baseline=2010)
    assert C.annual_series(df.where("false"), "year", "t", "y", ["x"], ["g"]).count() == 0


def test_respecification_has_both_fits_and_balance(spark):
    df = spark.createDataFrame(sample(7), KIND)
    got = {r["specification"]: r for r in C.respecification(df, "t", "y", ["x"], [], ["g"]).collect()}
    one = C.estimate(df, "t", "y", ["x"], []).first()
    two = C.estimate(df, "t", "y", ["x"], ["g"]).first()
    assert abs(got["base"]["difference_pp"] - one["difference_pp"]) < 2e-5 and abs(got["extended"]["difference_pp"] - two["difference_pp"]) < 2e-5
    assert got["extended"]["smd_after"] < got["base"]["smd_after"] and got["base"]["ess_0"] > 0


def test_doubly_robust_estimate_equals_numpy(spark):
    rows = sample(8, 900)
    df = spark.createDataFrame(rows, KIND)
    folds = {r["key"]: r for r in C.aipw_scores(df, "key", "t", "y", ["x"], ["g"], 3).collect()}
    psi, arm, e_of = [], [], []
    for r in rows:
        e_of.append(folds[r[0]]["e"])
    for k in range(3):
        train, held = [r for r in rows if folds[r[0]]["fold"] != k], [r for r in rows if folds[r[0]]["fold"] == k]
        e, m1, m0 = fitted(train)(held), fitted([r for r in train if r[3]], 4)(held), fitted([r for r in train if not r[3]], 4)(held)
        assert np.allclose([[folds[r[0]][c] for c in ("e", "m1", "m0")] for r in held], np.column_stack([e, m1, m0]), atol=1e-6)
        t, y = (np.array([r[i] for r in held]) for i in (3, 4))
        q = np.clip(e, 0.01, 0.99)
        psi += list(m1 - m0 + np.where(t == 1, (y - m1) / q, -(y - m0) / (1 - q)))
        arm += list(zip(t, e, strict=True))
    psi, e = np.array(psi), np.array([a[1] for a in arm])
    tables = C.aipw_tables(df, "key", "t", "y", ["x"], ["g"], 3)
    got = {r["population"]: r for r in tables.estimates().collect()}
    influence = {r["population"]: r for r in tables.influence().collect()}
    for name, lo, hi in C.POPULATIONS:
        kept = psi[(e >= lo) & (e <= hi)]
        r = got[name]
        assert r["n"] == len(kept) and r["excluded"] == len(psi) - len(kept) and r["n_1"] + r["n_0"] == r["n"]
        assert abs(r["difference_pp"] - 100 * kept.mean()) < 1e-4 and abs(r["se_pp"] - 100 * kept.std(ddof=1) / len(kept) ** 0.5) < 1e-4
        square = (kept - kept.mean()) ** 2
        assert abs(influence[name]["top_share"] - square[square >= np.quantile(square, 0.99)].sum() / square.sum()) < 1e-4
        assert abs(influence[name]["p05"] - np.quantile(kept - kept.mean(), 0.05)) < 1e-4
    weights = {(r["population"], r["arm"]): r for r in tables.weights().collect()}
    w = np.array([1 / np.clip(a[1], 0.01, 0.99) for a in arm if a[0] == 1])
    assert abs(weights["sem_trimming", 1]["p99"] - np.quantile(w, 0.99)) < 1e-4 and abs(weights["sem_trimming", 1]["ess"] - w.sum() ** 2 / (w**2).sum()) < 1e-2


def test_scores_by_group_equal_scores_of_each_fit(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (0, None, "b"), (2, 3.0, None), (2, -1.0, "a"), (1, 1.0, "a"), (7, 1.0, "b"), (None, 1.0, "b")], "__g int, x double, c string")
    for drop_first in (False, True):
        data = fits.encoded(df, ["x"], ["c"], drop_first)
        width = len(data.names)
        result = fits.Fits(np.linspace(-1, 1, 3 * width).reshape(3, width), np.ones(3, bool), np.ones(3, int), [None, None, "singular"])
        preps = [fits.Preparation([0.5], [0.25], [2.0], [1]), fits.Preparation([-1.0], [0.1], [0.5], [0]), fits.Preparation([0.0], [0.0], [1.0], [0])]
        both = fits.score_by_group(data, result, preps, {0: 0, 2: 1, 1: 2})
        each = [fits.score(data, preps[m], result.beta[m]) for m in (0, 1)]
        rows = data.rows.select("__g", both.alias("p"), each[0].alias("p0"), each[1].alias("p1")).collect()
        assert [r["p"] for r in rows] == [{0: r["p0"], 2: r["p1"]}.get(r["__g"]) for r in rows] and sum(r["p"] is None for r in rows) == 3
        assert len(both._jc.toString()) > 0 and len(fits.score_by_group(data, result, preps, {g: g % 2 for g in range(40)})._jc.toString()) < 40 * len(each[0]._jc.toString())


def test_draws_by_first_bits_are_those_of_the_table():
    rng = np.random.default_rng(0)
    ids, n = rng.integers(-(2**63), 2**63 - 1, 400), rng.integers(1, 65, 400)
    n[:100] = 1
    drawn = C.multiplicities(ids, n, 200, 11)
    for i in range(400):
        k = np.arange(int(n[i]) + 60)
        table = np.cumsum(np.exp(k * math.log(n[i]) - n[i] - np.cumsum(np.log(np.maximum(k, 1)))))
        x = ids[i : i + 1].view(np.uint64) ^ C._mixed(np.arange(200, dtype=np.uint64) + np.uint64(11) * np.uint64(1 << 32))
        want = np.searchsorted(table[table < 1 - 1e-13], (C._mixed(x) >> np.uint64(11)) * 2.0**-53, side="right")
        assert (drawn[i] == want).all()


def test_cells_of_a_bootstrap_lie_in_many_tasks(spark, monkeypatch):
    seen, plain = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df, label: seen.append((label, df.rdd.getNumPartitions())) or plain(df, label))
    df = spark.range(400).selectExpr("int(id % 2) AS t", "int(id % 3 = 0) AS y", "double(id % 50) AS x", "string(id % 4) AS c")
    C.bootstrap(df, "t", "y", ["c"], 20, numeric=["x"])
    assert dict(seen)["cells"] >= spark.sparkContext.defaultParallelism
