"""Small hand-made frames: the rules that must not drift."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom.functions import bands, features as X, special
from riskloom.operators import aggregates as G, audit as A, causal as C, evaluate as E, joins as J, policy as P
from riskloom.sources import io


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_coded_csv_keeps_zeros_and_never_replaces(spark, tmp_path):
    (tmp_path / "in.csv").write_text("contador;CODMUNRES;MESPRENAT;PESO\n1;001234;03;2499\n2;000007;;3000\n")
    df = io.read_text_csv(spark, str(tmp_path / "in.csv"))
    assert values(df, "CODMUNRES", "MESPRENAT") == [("001234", "03"), ("000007", None)]
    assert {k for _, k in df.dtypes} == {"string"}
    io.csv_to_parquet(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), ["PESO"])
    with pytest.raises(FileExistsError):
        io.csv_to_parquet(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        io.require_columns(df, ["GRAVIDEZ"])


def test_years_align_and_collide(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, x string").write.parquet(str(tmp_path / "2019"))
    spark.createDataFrame([(2, "b")], "ID int, Y string").write.parquet(str(tmp_path / "2020"))
    df = io.read_years(spark, {2018: str(tmp_path / "2018"), 2019: str(tmp_path / "2019"), 2020: str(tmp_path / "2020")})
    assert sorted(values(df, "ID", "X", "Y", "ano")) == [(1, "a", None, 2019), (2, None, "b", 2020)]
    found = {r["ano"]: r for r in io.inventory(spark, {2018: str(tmp_path / "2018"), 2019: str(tmp_path / "2019")}, ["ID", "Y"]).collect()}
    assert not found[2018]["available"] and found[2019]["missing_fields"] == "Y"


def test_treatment_outcome_and_codes(spark):
    df = spark.createDataFrame([("01",), ("03",), ("04",), ("09",), ("99",), (None,)], "m string")
    assert values(df.select(X.treatment(F.col("m")).alias("t")), "t") == [1, 1, 0, 0, None, None]
    w = spark.createDataFrame([(499.0,), (500.0,), (2499.0,), (2500.0,), (6000.0,), (6001.0,), (None,)], "w double")
    assert values(w.select(X.outcome(F.col("w"), "P0").alias("a"), X.outcome(F.col("w"), "P1").alias("b")), "a", "b") == [(1, None), (1, 1), (1, 1), (0, 0), (0, 0), (0, None), (None, None)]
    g = spark.createDataFrame([("1",), ("2",), ("9",), (None,)], "g string")
    assert values(g.select(X.equals_or_false(F.col("g"), "1").alias("x")), "x") == [True, False, False, False]
    c = spark.createDataFrame([("355030",), ("53001",), (None,)], "c string")
    assert values(c.select(X.region_prefix(F.col("c")).alias("r")), "r") == ["35", None, None]
    k = spark.createDataFrame([("03",), ("09",), (None,), ("x",)], "k string")
    assert values(k.select(X.category(F.col("k")).alias("c"), X.count_category(F.col("k")).alias("n")), "c", "n") == [("3", "2_OU_MAIS"), ("IGNORADO", "2_OU_MAIS"), ("IGNORADO", "IGNORADO"), (None, "IGNORADO")]
    with pytest.raises(PySparkException):
        k.select(X.merge_levels(F.col("k"), {"03": "a"})).collect()


def test_special_codes(spark):
    df = spark.createDataFrame([(99997.0,), (1.5,), (None,)], "v double")
    assert values(df.select(X.special_state(F.col("v"), (99997.0,)).alias("s"), X.mask_special(F.col("v"), (99997.0,)).alias("m")), "s", "m") == [("99997", None), ("REGULAR", 1.5), ("MISSING", None)]
    assert values(X.special_indicators(df, "v", (99997.0,)), "v_is_99997", "v_is_missing") == [(1, 0), (0, 0), (0, 1)]


def test_status_precedence(spark):
    df = spark.createDataFrame([(None,), ("99",), ("x",), ("50",), ("7",), ("3",)], "c string")
    s = A.code_status(F.col("c"), ignored=(99,), low=0, high=10, confirmed=F.col("c") != "7")
    assert values(df.select(s.alias("s")), "s") == ["ausente", "ignorado", "invalido", "fora_faixa", "nao_confirmado", "valido"]


def test_flow_reconciles(spark):
    df = spark.createDataFrame([(1, 5), (None, 5), (1, 1), (0, 9), (1, None), (0, 3)], "t int, v int")
    rows = C.flow(df, [("A1", F.col("t").isNotNull()), ("A2", F.col("v") > 2)]).collect()
    assert [(r["before"], r["excluded"], r["after"]) for r in rows] == [(6, 1, 5), (5, 2, 3)]


def test_smd_without_variance_is_infinite(spark):
    df = spark.createDataFrame([(0, 20.0, "A"), (0, 20.0, "A"), (1, 22.0, "B"), (1, 22.0, "B")], "t int, age double, g string")
    assert C.smd_numeric(df, "t", ["age"]).first()["smd"] == math.inf
    assert C.smd_worst_level(df, "t", ["g"]).first()["smd"] > 0


def test_trimming_and_overlap_weights(spark):
    df = spark.createDataFrame([(0, 0.001), (0, 0.02), (1, 0.5), (1, 0.97), (1, 0.999)], "t int, e double")
    assert {r["rule"]: r["kept"] for r in C.trimming(df, "t", "e").collect()} == {"none": 5, "01_99": 3, "05_95": 1}
    d = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.4), (1, 0, 0.6), (1, 1, 0.8)], "t int, y int, e double").withColumn("w", C.overlap_weights("t", "e"))
    r = C.weighted_risk(d, "t", "y", "w").first()
    assert (r["risk_1"], r["risk_0"], r["difference_pp"]) == (0.333333, 0.666667, -33.333333)
    assert [x["ess"] for x in C.effective_size(d, "t", "w").collect()] == [1.8, 1.8]


def test_two_by_two_equals_the_model(spark):
    rows = [(1, 1)] * 130 + [(1, 0)] * 870 + [(0, 1)] * 45 + [(0, 0)] * 205
    df = spark.createDataFrame(rows, "t int, y int")
    crude = C.crude_odds_ratio(df, "t", "y").first()
    model = {r["term"]: r for r in C.odds_ratios(df, "y", ["t"]).collect()}["t"]
    assert model["odds_ratio"] == pytest.approx(130 * 205 / (870 * 45), abs=1e-6) == pytest.approx(crude["odds_ratio"], abs=1e-5)
    assert model["se"] == pytest.approx(math.sqrt(1 / 130 + 1 / 870 + 1 / 45 + 1 / 205), abs=1e-6)


def test_distributed_fit_equals_penalised_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    t = (rng.random(400) < 1 / (1 + np.exp(-x))).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, t, strict=True))], "key long, x double, t int")
    scored = C.propensity(df, "t", ["x"], []).orderBy("key").toPandas()
    z = (x - x.mean()) / x.std()
    beta, _, ok = C.irls(np.column_stack([np.ones(400), z, np.zeros(400)]), t.astype(float), np.ones(400), 1.0)
    assert ok and np.abs(scored.e - 1 / (1 + np.exp(-(beta[0] + beta[1] * z)))).max() < 1e-4


def test_bootstrap_metrics_equal_their_resamples(spark):
    n, size, seed = 500, 64, 9
    p, y = np.arange(n) % 211 / 211, np.arange(n) * 7 % 10 < 3
    df = spark.createDataFrame([(i, float(p[i]), int(y[i])) for i in range(n) for _ in range(1 + i % 2)], "g long, p double, y int").repartition(5)
    got = E.bootstrap_metrics(df, "g", "p", "y", 6, seed=seed, block_rows=size).orderBy("replicate").collect()
    s = np.unique(-p)
    n1, n0 = (np.array([((-p == v) & (y == c)).sum() for v in s]) for c in (True, False))
    at = [slice(i, i + size) for i in range(0, len(s), size)]
    sizes = np.array([(n1 + n0)[a].sum() for a in at])
    for k, row in enumerate(got):
        share = np.random.default_rng([seed, 0, k]).multinomial(n, sizes / n)
        made = [next(E.resamples(n1[a], n0[a], [(k, m)], seed, b)) for b, (a, m) in enumerate(zip(at, share, strict=True))]
        k1, k0 = (np.concatenate([m[c] for m in made]) for c in (1, 2))
        assert k1.sum() + k0.sum() == n
        want = E.metrics_of(np.concatenate([np.repeat(-s, k1), np.repeat(-s, k0)]), np.repeat([1, 0], [k1.sum(), k0.sum()]))
        assert row["replicate"] == k and tuple(row)[1:] == pytest.approx(want, abs=1e-9)
    assert len({r["roc_auc"] for r in got}) == 6
    one = E.bootstrap_metrics(df.withColumn("y", F.lit(1)), "g", "p", "y", 3).collect()
    assert len(one) == 3 and all(tuple(r)[1:] == (None,) * 8 for r in one)


def test_bootstrap_metrics_take_any_number_of_groups(spark):
    df = spark.range(130_000).select(F.col("id").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows = E.bootstrap_metrics(df, "g", "p", "y", 2).collect()
    assert len(rows) == 2 and all(abs(r["roc_auc"] - 0.5) < 0.02 and abs(r["average_precision"] - 1 / 3) < 0.02 for r in rows)
    flat = E.bootstrap_metrics(df.withColumn("p", F.lit(0.25)), "g", "p", "y", 2).collect()
    assert all(r["roc_auc"] == 0.5 and r["recall"] == 0.0 for r in flat)


def test_pdo_anchors(spark):
    df = spark.createDataFrame([(1 / 10,), (1 / 19,), (1e-9,), (1.0,)], "p double")
    assert [round(v, 6) for v in values(df.select(P.pdo_score(F.col("p")).alias("s")), "s")][:2] == [500.0, 540.0]
    assert values(df.select(P.pdo_score(F.col("p")).alias("s")), "s")[3] == 0.0
    with pytest.raises(PySparkException):
        spark.createDataFrame([(1.5,)], "p double").select(P.pdo_score(F.col("p"))).collect()


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double")
    assert tuple(E.ranking_metrics(df, "p", "y").first())[:3] == (1.0, 1.0, 1.0)
    assert E.ranking_metrics(df.withColumn("q", 1 - F.col("p")), "q", "y").first()["gini"] == -1.0
    flat = spark.createDataFrame([(int(i < 20), 0.2) for i in range(100)], "y int, p double")
    r = E.ranking_metrics(flat, "p", "y").first()
    assert (r["auc"], r["average_precision"]) == (0.5, 0.2)
    assert E.probability_metrics(flat, "p", "y").first()["brier"] == 0.16
    assert E.calibration_slope(flat, "p", "y").first()["slope"] is None
    with pytest.raises(ValueError):
        A.guarded(df.where("y = 1"), "p", "y")


def test_rank_bins_differ_from_ntile(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.lit(1.0).alias("v"))
    got = [r["bin"] for r in bands.rank_bins(df, "v", "k", 4).orderBy("k").collect()]
    assert got == [max(1, math.ceil(i * 4 / 9)) for i in range(10)]


def test_psi(spark):
    ref = spark.range(1000).select((F.col("id") / 10).alias("v"))
    assert E.psi_numeric(ref, ref, "v").first()["psi"] == 0.0
    shifts = [E.psi_numeric(ref, ref.select((F.col("v") + k).alias("v")), "v").first()["psi"] for k in (5, 20)]
    assert 0 < shifts[0] < shifts[1]
    assert E.psi_numeric(ref.withColumn("v", F.lit(1.0)), ref, "v").first()["psi"] is None
    a, b = (spark.createDataFrame([(x,) for x in xs], "c string") for xs in ("a" * 8 + "b" * 2, "a" * 8 + "z" * 2))
    assert E.psi_categorical(a, b, "c").first()["psi"] > 0.1


def test_group_splits_are_safe(spark):
    df = spark.createDataFrame([(i, f"g{i % 40}", (i % 40) % 2) for i in range(400)], "id int, g string, y int")
    s = E.group_split(df, "g", "y")
    assert A.split_leaks(s, "g", "split").count() == 0
    assert {r["split"]: r["n"] for r in s.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()} == {"train": 28, "val": 6, "test": 6}
    sizes = [r["count"] for r in E.stratified_folds(df, "id", "y").groupBy("y", "fold").count().collect()]
    assert set(sizes) == {40}


def test_unassigned_group_is_an_error(spark):
    members, groups = spark.createDataFrame([(1,), (2,)], "g int"), spark.createDataFrame([(1, "train")], "g int, split string")
    with pytest.raises(PySparkException):
        J.propagate_group(members, groups, "g", "split").collect()


def test_small_bins_merge(spark):
    df = spark.createDataFrame([(0, 12, 0), (1, 3, 11), (2, 9, 20), (3, 2, 2)], "b int, a int, c int")
    got = values(C.merge_small_bins(df, "b", "a", "c"), "first_bin", "last_bin", "a", "c")
    assert sum(x[2] for x in got) == 26 and all(v == 0 or v >= 10 for x in got for v in x[2:])


def test_special_functions():
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.f_tail(4.10282, 2, 10) == pytest.approx(0.05, abs=1e-5)


def test_evenly_spaced(spark):
    df = spark.range(11).select(F.lit(1).alias("g"), "id")
    assert sorted(values(G.evenly_spaced(df, ["g"], ["id"], 3), "id")) == [0, 5, 10]


def test_labels_are_censored(spark):
    loans = spark.sql("select 1 as key, 1 as cust, date'2020-01-15' as day union all select 2, 1, date'2021-06-01' union all select 3, 2, date'2020-01-15'")
    perf = spark.sql("select 1 as cust, date'2021-01-31' as ref, 1 as flag union all select 1, date'2020-05-31', 0 union all select 2, date'2020-03-31', 1")
    got = {r["key"]: (r["has_window"], r["origin"], r["label"], r["ever"]) for r in J.ever_label(J.label_12m(loans, perf, "cust"), perf, "key", "cust").collect()}
    assert got == {1: (True, "observado", 1, 1), 2: (False, "sem_janela", None, None), 3: (True, "sem_registro", 0, 1)}


def test_ranking_metrics_of_many_rows(spark):
    from riskloom.operators.evaluate import ranking_metrics

    df = spark.range(200_000).selectExpr("id % 1000 / 1000.0d as s", "cast(id % 2 as int) as y")
    got = ranking_metrics(df, "s", "y").first()  # positives times negatives exceed 32 bits
    assert abs(got["auc"] - 0.501) < 1e-6


def test_a_mean_on_the_threshold_counts_in_any_order(spark):
    """The mean of these is 0.5, though a sum of doubles falls short of it in some orders."""
    from functools import reduce
    from itertools import permutations
    from operator import add

    from riskloom.operators import aggregates as G

    rows = [(g, k, p, 1) for g, order in enumerate(permutations([0.601941748, 0.737864078, 0.611650485, 0.048543689])) for k, p in enumerate(order)]
    df = spark.createDataFrame(rows, "g int, k int, p double, y int").coalesce(1)
    assert any(reduce(add, order) / 4 < 0.5 for order in permutations([0.601941748, 0.737864078, 0.611650485, 0.048543689]))
    assert {x["predicted"] for x in G.instances_to_group(df, ["g"], "p", "y", 0.5, "k").collect()} == {1}


def test_tasks_of_propagation_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "TASK_ROWS", 50)
    members = spark.range(1000).select((F.col("id") % 500).alias("g"), "id")
    groups = spark.range(500).select(F.col("id").alias("g"), F.concat(F.lit("s"), "id").alias("split"))
    got = J.propagate_group(members, groups, "g", "split").withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 1000 and all(r["split"] == f"s{r['g']}" for r in got)
    per = [sum(r["task"] == t for r in got) for t in {r["task"] for r in got}]
    assert len(per) > 15 and max(per) < 150
