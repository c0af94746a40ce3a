"""Histogram boosting, nested and timed models, dealings and batch scores against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting as B, evaluate as E
from riskloom.operators.fits import blocks
from riskloom.plans.base import Tables
from riskloom.sources.staging import new_path


def frame(spark, n=900, seed=0):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.integers(0, 6, n)
    c = rng.choice(list("abcd"), n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * (x > 0.3) - (c == "b") + (z == 5) - 0.5)))).astype(int)
    rows = [(i, None if i % 9 == 0 else float(a), float(b), None if i % 31 == 0 else str(k), int(v), f"2024-{1 + i % 12:02d}") for i, (a, b, k, v) in enumerate(zip(x, z, c, y, strict=True))]
    return spark.createDataFrame(rows, "key long, x double, z double, c string, y int, month string").repartition(4), rows


def brute_first_split(rows, l2=1.0, least=20):
    """Best split of the root over all cuts of numbers with missing values on either side, and over all sets of categories."""
    p = np.mean([r[4] for r in rows])
    g, h = np.array([p - r[4] for r in rows]), p * (1 - p)

    def gain(left):
        out = -(g.sum() ** 2) / (h * len(g) + l2)
        for side in (left, ~left):
            if side.sum() < least:
                return -math.inf
            out += g[side].sum() ** 2 / (h * side.sum() + l2)
        return out

    best = -math.inf
    for i in (1, 2):
        v = np.array([math.nan if r[i] is None else r[i] for r in rows])
        for cut in sorted({a for a in v if a == a}):
            best = max(best, gain(v <= cut), gain((v <= cut) | np.isnan(v)))
    k = np.array([r[3] or "?" for r in rows])
    for size in range(1, 5):
        for some in itertools.combinations("abcd?", size):
            best = max(best, gain(np.isin(k, some)))
    return best


def test_first_split_is_the_best_of_all(spark):
    df, rows = frame(spark, 240)
    model = B.fit_boosting(df, ["x", "z"], ["c"], "y", "key", iterations=1, most_leaves=2, least_rows=20, held_out=0.0)
    assert len(model.trees) == 1 and len(model.trees[0]) == 3
    assert model.trees[0][0].split.gain == pytest.approx(brute_first_split(rows), rel=1e-9)
    only = B.fit_boosting(df, [], ["c"], "y", "key", iterations=1, most_leaves=2, least_rows=20, held_out=0.0)
    sub = [(r[0], None, None, r[3], r[4]) for r in rows]
    assert only.trees[0][0].split.gain == pytest.approx(brute_first_split(sub), rel=1e-9)


def plain_boosting(model, rows, iterations, rate, most_leaves, least, l2):
    """The same growth in one process: best gain first, histograms by brute force, on the model's codes."""
    raw = np.full(len(rows), model.base)
    codes = []
    for i, edges in enumerate(model.edges):
        v = [r[1 + i] for r in rows]
        codes.append(np.array([len(edges) + 1 if a is None else sum(e < a for e in edges) for a in v]))
    codes.append(np.array([model.levels[0].index(r[3]) if r[3] else len(model.levels[0]) for r in rows]))
    y = np.array([r[4] for r in rows], float)
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def leaf(on, g=g, h=h):
            hist = [np.column_stack([np.bincount(c[on], v[on], s) for v in (g, h, np.ones(len(g)))]) for c, s in zip(codes, model.sizes, strict=True)]
            return on, B.best_split(hist, 2, l2, least)

        open_ = [leaf(np.arange(len(rows)))]
        while len(open_) < most_leaves:
            able = [i for i, (_, s) in enumerate(open_) if s is not None]
            if not able:
                break
            on, s = open_.pop(max(able, key=lambda i: open_[i][1].gain))
            left = s.left[codes[s.column][on]]
            open_ += [leaf(on[left]), leaf(on[~left])]
        for on, _ in open_:
            raw[on] -= rate * g[on].sum() / (h[on].sum() + l2)
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize("restage", [10, 2])
def test_trees_equal_growth_in_one_process(spark, monkeypatch, restage):
    monkeypatch.setattr(B, "RESTAGE", restage)
    df, rows = frame(spark)
    model = B.fit_boosting(df, ["x", "z"], ["c"], "y", "key", iterations=6, most_leaves=7, least_rows=15, held_out=0.0, bins=32)
    want = plain_boosting(model, rows, 6, 0.1, 7, 15, 1.0)
    got = {r["key"]: r["p"] for r in model.score(df).collect()}
    assert len(model.trees) == 6 and all(len(t) == 13 for t in model.trees)
    assert np.allclose([got[r[0]] for r in rows], want, atol=1e-9)


def test_boosting_stops_early_and_scores_every_row(spark):
    df, rows = frame(spark, 1500, 3)
    model = B.fit_boosting(df, ["x", "z"], ["c"], "y", "key", least_rows=30, iterations=60, patience=4)
    assert 0 < len(model.trees) < 60 and len(model.losses) <= len(model.trees) + 5 and min(model.losses) == model.losses[len(model.trees)] < model.losses[0]
    odd = spark.createDataFrame([(1, None, None, None), (2, math.nan, 99.0, "new"), (3, 0.5, 2.0, "b")], "key long, x double, z double, c string")
    assert all(0 < r["p"] < 1 for r in model.score(odd).collect())
    scored = model.score(df)
    assert scored.count() == len(rows) and E.ranking_metrics(scored, "p", "y").first()["auc"] > 0.7
    with pytest.raises(ValueError, match="missing"):
        model.score(df.drop("x"))
    with pytest.raises(ValueError, match="both classes"):
        B.fit_boosting(df.withColumn("y", F.lit(1)), ["x"], [], "y", "key")


@pytest.mark.parametrize("kind", E.MODELS)
def test_scores_lose_no_row(spark, kind):
    df, rows = frame(spark, 400)
    model = E.fit_model(df, kind, ["x", "z"], "y", key="key")
    scored = E.score_model(model, df, ["x", "z"])
    assert scored.count() == len(rows) and scored.where("p between 0 and 1").count() == len(rows) and scored.columns == [*df.columns, "p"]


def test_saved_model_keeps_its_medians(spark):
    df, rows = frame(spark, 300)
    path = new_path(spark, "model")
    E.fit_model(df, "logistic", ["x", "z"], "y").write().save(path)
    gap, middle = (E.score_saved(spark, path, spark.createDataFrame([(v, 2.0)], "x double, z double"), ["x", "z"]).first()["p"] for v in (None, float(np.median([r[1] for r in rows if r[1] is not None]))))
    assert gap == middle


def test_nested_models_cover_rows_and_learn_from_other_folds(spark):
    df, rows = frame(spark)
    sets = {"M0": [], "M1": ["x"], "M3": ["x", "z", "c"], "M3_less": ["z", "c"]}
    p = {r["key"]: r for r in E.nested_probabilities(df, "key", "y", sets, ["c"], 5).collect()}
    assert len(p) == len(rows) and {r["fold"] for r in p.values()} == set(range(5))
    for k in range(5):
        train = [r for r in rows if p[r[0]]["fold"] != k]
        held = [r for r in rows if p[r[0]]["fold"] == k]
        assert {round(p[r[0]]["p_M0"], 9) for r in held} == {round(float(np.mean([r[4] for r in train])), 9)}
        x = np.array([math.nan if r[1] is None else r[1] for r in train])
        fill = np.nanmedian(x)
        mat = lambda rs: np.column_stack([np.ones(len(rs)), [fill if r[1] is None else r[1] for r in rs], [r[1] is None for r in rs]]).astype(float)
        beta = np.zeros(3)
        y = np.array([r[4] for r in train])
        for _ in range(30):
            q = 1 / (1 + np.exp(-mat(train) @ beta))
            beta += np.linalg.solve((mat(train) * (q * (1 - q))[:, None]).T @ mat(train), mat(train).T @ (y - q))
        assert np.allclose([p[r[0]]["p_M1"] for r in held], 1 / (1 + np.exp(-mat(held) @ beta)), atol=1e-7)
    auc = {r["model"]: r["auc"] for r in E.nested_models(df, "key", "y", sets, ["c"], 5).collect()}
    assert auc["M3"] > auc["M1"] > 0.6 and auc["M3"] > auc["M3_less"]


def test_time_folds_and_their_mean(spark):
    df, rows = frame(spark)
    got = {r["fold"]: r for r in E.time_cv(df, "month", "y", ["x", "z"]).collect()}
    assert sorted(got) == ["1", "2", "3", "4", "mean"] and all(r["n"] == r["scored"] for r in got.values())
    assert got["mean"]["auc"] == pytest.approx(np.mean([got[k]["auc"] for k in "1234"]), abs=2e-6)
    trees = {r["fold"]: r for r in E.time_cv(df, "month", "y", ["x", "z"], "forest", 2).collect()}
    assert sorted(trees) == ["1", "2", "mean"]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_dealing_is_a_permutation(spark, n):
    df = spark.range(n).select("id", *[E.dealt(F.col("id"), n, F.lit(s).cast("long")).alias(f"d{s}") for s in (1, 2)]).toPandas()
    assert sorted(df.d1) == sorted(df.d2) == list(range(n))
    assert n < 10 or (df.d1 != df.d2).mean() > 0.8 and (df.d1 != df.id).mean() > 0.8


def test_permutation_importance_tells_features_apart(spark):
    df, rows = frame(spark, 600)
    df = df.withColumn("x", F.coalesce("x", F.lit(0.0)))
    seen = []

    def score(d):
        seen.append(d)
        return d.withColumn("p", F.col("x"))

    got = {r["variable"]: r for r in E.permutation_importance(score, df, ["x", "z"], "y", "key").collect()}
    assert got["x"]["repeats"] == got["z"]["repeats"] == 10
    assert got["z"]["auc_drop"] == pytest.approx(0, abs=1e-9) and got["x"]["auc_drop"] > 0.1 and got["x"]["sd"] > 0
    values = sorted(r["x"] for r in df.collect())
    for k in range(3):
        dealt = [r for r in seen[0].where(f"__column = 0 and __repeat = {k}").collect()]
        assert sorted(r["x"] for r in dealt) == values and len(seen) == 1


def test_bootstrap_intervals_hold_the_estimates(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    s = t.scored().limit(3000)
    got = {r["metric"]: r for r in E.bootstrap_intervals(s, "grp", "p", "label", 200).collect()}
    assert sorted(got) == sorted(E.METRICS) and all(r["low"] <= r["estimate"] <= r["high"] and r["valid"] <= r["replicates"] == 200 for r in got.values())


def test_rows_with_equal_codes_are_scanned_as_one(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(B, "blocks", lambda df, label: seen.append(df.agg(F.count("*").alias("rows"), F.sum("__n").alias("n"), F.sum("__w").alias("w")).first()) or blocks(df, label))
    df = spark.createDataFrame([(k, float(k % 4), int(k % 4 > 1) if k % 7 else k % 2, 0.5) for k in range(400)], "key long, x double, y int, w double")
    model = B.fit_boosting(df, ["x"], [], "y", "key", "w", iterations=2, most_leaves=3, least_rows=90, held_out=0.0)
    assert seen[0]["rows"] <= 8 and seen[0]["n"] == 400 and seen[0]["w"] == 200.0
    assert model.trees[0][0].n == 400 and model.trees[0][0].hessian == pytest.approx(200 * model_prior(model.base))


def model_prior(base):
    p = 1 / (1 + math.exp(-base))
    return p * (1 - p)


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_dealing_over_arrays_is_that_of_columns(spark, n):
    from riskloom.operators.dealing import Dealing

    for salt in (7, 3_000_009):
        want = spark.range(n).select("id", E.dealt(F.col("id"), n, F.lit(salt)).alias("d")).orderBy("id").toPandas().d.to_numpy()
        deal = Dealing(n, salt)
        assert deal.source(np.arange(n)).tolist() == want.tolist()
        assert deal.target(want).tolist() == list(range(n))


def test_importance_of_arrays_is_that_of_frames(spark, monkeypatch):
    from riskloom.operators import dealing

    # blocks, sendings and ranges of a few rows
    monkeypatch.setattr(dealing, "BLOCK", 70)
    monkeypatch.setattr(dealing, "RANGE_ROWS", 90)
    monkeypatch.setattr(dealing, "SENT_CELLS", 900)
    df, _ = frame(spark, 600)  # x has missing values
    df = df.withColumn("z", F.round("z", 1))
    model = E.fit_model(df, "logistic", ["x", "z"], "y")
    frames = E.permutation_importance(lambda d: E.score_model(model, d, ["x", "z"]), df, ["x", "z"], "y", "key", 3)
    arrays = E.permutation_importance(E.array_score(model, ["x", "z"]), df, ["x", "z"], "y", "key", 3)
    got, want = ({r["variable"]: r for r in found.collect()} for found in (arrays, frames))
    assert sorted(got) == sorted(want) == ["x", "z"]
    for c in want:
        assert got[c]["auc_drop"] == pytest.approx(want[c]["auc_drop"], abs=1e-12) and got[c]["sd"] == pytest.approx(want[c]["sd"], abs=1e-12) and got[c]["repeats"] == 3


def test_importance_doesnt_multiply_rows(spark, monkeypatch):
    # the queries' model goes through blocks: no frame of all dealings is made
    monkeypatch.setattr(E, "dealt", None)
    from riskloom.plans import queries

    got = {r["variable"]: r["repeats"] for r in queries()["m27_permutation_importance"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {"qty": 10, "price": 10, "discount": 10}


def test_scans_of_boosting_make_no_plans(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    df, _ = frame(spark, 400)
    calls, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda *a, **k: calls.append(1) or plain(*a, **k))
    fit = lambda: B.fit_boosting(df, ["x", "z"], ["c"], "y", "key", iterations=5, most_leaves=7, least_rows=15, held_out=0.0)
    model = fit()
    assert len(model.trees) == 5 and len(calls) <= 8
    monkeypatch.setattr(B, "MOST_PARTS", 0)  # partial sums in a tree
    for a, b in zip(model.trees, fit().trees, strict=True):
        assert [n.value for n in a] == pytest.approx([n.value for n in b])


def test_medians_are_shared_by_models(spark, monkeypatch):
    df, _ = frame(spark, 300)
    medians = E.feature_medians(df, ["x", "z"], "y")
    own = E.array_score(E.fit_model(df, "logistic", ["x", "z"], "y"), ["x", "z"])
    monkeypatch.setattr(E, "quantiles", None)
    assert E.array_score(E.fit_model(df, "logistic", ["x", "z"], "y", medians=medians), ["x", "z"]) == own


def test_forest_and_boosting_have_all_their_trees(spark, monkeypatch):
    df, _ = frame(spark, 100)
    monkeypatch.setattr(E, "fit_forest", lambda *a, **k: k["trees"], raising=False)
    monkeypatch.setattr(E, "fit_boosting", lambda *a, **k: k["iterations"])
    assert E.fit_model(df, "forest", ["x", "z"], "y") == 300 and E.fit_model(df, "boosting", ["x", "z"], "y") == 250


def test_forest_equals_growth_in_one_process(spark):
    from riskloom.operators import forest as O

    df, rows = frame(spark, 600)  # x has missing values
    df = df.withColumn("w", F.when(F.col("y") == 1, 1.5).otherwise(0.75))
    model = O.fit_forest(df, ["x", "z"], "y", "w", trees=5, depth=3, least_rows=20, bins=8, seed=4, fills={"x": 0.25, "z": 0.0})
    values = [[0.25 if r[1] is None else r[1] for r in rows], [0.0 if r[2] is None else r[2] for r in rows]]
    codes = [np.searchsorted(e, v) for e, v in zip(model.edges, values, strict=True)]
    cells = {}
    for a, b, r in zip(*codes, rows, strict=True):
        cells[r[4], a, b] = cells.get((r[4], a, b), 0) + 1
    y, a, b = (np.array(x) for x in zip(*sorted(cells), strict=True))
    n, w = np.array([cells[c] for c in sorted(cells)], float), np.where(y == 1, 1.5, 0.75)
    for t, tree in enumerate(model.trees):
        k = np.random.default_rng([4, t, 0]).poisson(n)
        at = B.leaves(tree, [a, b])
        assert tree[0].n == k.sum() and max(x.depth for x in tree) <= 3 and len(tree) > 3
        for i, x in enumerate(tree):
            if x.children is None:
                on = at == i
                assert x.n == k[on].sum() >= 20 and x.value == pytest.approx((k * w * y)[on].sum() / (k * w)[on].sum())
        hist = [np.column_stack([np.bincount(c, v, s) for v in (k * w * y, k * w, k)]) for c, s in zip((a, b), model.sizes, strict=True)]
        assert tree[0].split.gain == pytest.approx(B.best_split(hist, 2, 0.0, 20).gain)
    want = np.mean([np.array([x.value for x in tree])[B.leaves(tree, codes)] for tree in model.trees], axis=0)
    got = {r["key"]: r["p"] for r in model.score(df).collect()}
    assert np.allclose([got[r[0]] for r in rows], want)


def test_resamples_of_cells_are_those_of_rows(spark):
    from riskloom.operators import forest as O

    df = spark.range(2000).selectExpr("id as key", "double(id % 2) as x", "int(id % 3 = 0) as y")
    n = np.array([tree[0].n for tree in O.fit_forest(df, ["x"], "y", trees=300, depth=1).trees])
    # cells drawn whole would spread the sizes 18 times as far
    assert n.mean() == pytest.approx(2000, abs=15) and 1700 < n.var() < 2400 + 200


def test_scores_of_few_codes_come_from_a_table(spark, monkeypatch):
    df, rows = frame(spark, 300)
    model = B.fit_boosting(df, ["x", "z"], ["c"], "y", "key", iterations=3, least_rows=20, held_out=0.0, bins=16)
    table = {r["key"]: r["p"] for r in model.score(df).collect()}
    assert model.table(spark) is not None
    monkeypatch.setattr(B, "FEW_CELLS", 0)
    assert model.table(spark) is None and table == {r["key"]: r["p"] for r in model.score(df).collect()}


def test_boosting_to_a_depth_scans_no_last_level(spark, monkeypatch):
    df, _ = frame(spark, 400)
    scans, plain = [], B.histograms
    monkeypatch.setattr(B, "histograms", lambda *a, **k: scans.append(len(a[3])) or plain(*a, **k))
    model = B.fit_boosting(df, ["x", "z"], [], "y", None, iterations=4, most_leaves=8, depth=3, least_rows=1, l2=0.0, held_out=0.0)
    assert len(model.trees) == 4 and len(scans) == 12 and all(max(x.depth for x in t) == 3 for t in model.trees)


def test_metrics_of_cells_are_those_of_rows(spark, monkeypatch):
    df, _ = frame(spark, 400)
    df, columns = df.withColumn("w", F.when(F.col("y") == 1, 1.5).otherwise(0.75)).select("key", "y", "w", "x", "z"), ["x", "z"]
    for kind, few in (("forest", {"trees": 4}), ("boosting", {"iterations": 4}), ("histogram", {"iterations": 4, "least_rows": 20})):
        model = E.fit_model(df, kind, columns, "y", "w", "key", **few)
        assert E.ranking_metrics(model.scored_cells(), "p", "__y", "__n").collect() == E.ranking_metrics(E.score_model(model, df, columns), "p", "y").collect()
    start = B.coded(df, columns, [], "y", weight="w", fills={"x": 0.0, "z": 0.0})
    passes = []
    monkeypatch.setattr(B, "coded", lambda *a, **k: passes.append(1))
    few = {"iterations": 2, "held_out": 0.0, "least_rows": 20, "start": start}
    assert len(B.fit_boosting(df, columns, [], "y", None, "w", **few).trees) == 2 and not passes and start.trees == []


@pytest.mark.parametrize("values, kind", [([1.0, 50.0], 0), ([0.07, 0.1, 0.29], 1), ([300.0, 2.0], 2), ([655.35, 1.1], 3), ([901.99, 104949.5], 5), ([0.5, math.nan, -1.0], 6), ([0.1, math.nan], 7), ([math.inf, 1e300], 7), ([1e10 / 3], 7)])
def test_numbers_are_sent_narrow_and_whole(values, kind):
    from riskloom.operators import dealing as D

    found, x = D.narrowed(np.array(values))
    assert found == kind and np.array_equal(D.widened(found, x.tobytes()), np.array(values), equal_nan=True)
    p = np.sort(np.array([-2.0, 0.0, *values]))
    assert np.array_equal(D.of_planes(D.planes(p)), p, equal_nan=True)


def test_dealings_go_in_slices_and_leave_no_exchange(spark, monkeypatch):
    from riskloom.operators import dealing as D

    df, _ = frame(spark, 500)
    score = D.ArrayScore((0.25, 0.0), (1.5, -0.5), 0.1)
    run = lambda: E.permutation_importance(score, df, ["x", "z"], "y", "key", 4).collect()
    want, plain, slices = run(), D._sent, []
    monkeypatch.setattr(D, "_sent", lambda *a: slices.append(len(a[4])) or plain(*a))
    monkeypatch.setattr(D, "DEALS_AT_A_TIME", 3)
    monkeypatch.setattr(D, "FEW_CELLS", 0)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    assert sorted(run()) == sorted(want) and slices == [3, 3, 2]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
    seen = []
    monkeypatch.setattr(E, "dealt_aucs", lambda ranked, *a: seen.append(ranked.columns) or D.dealt_aucs(ranked, *a))
    run()
    assert seen == [["y", "x", "z", "__r"]]  # the key isn't written
