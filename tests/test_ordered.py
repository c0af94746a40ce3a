"""Ranks, running sums and quantiles over many tasks, with hot groups, nulls and ties, against NumPy."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import aggregates as G, evaluate as E, ordered as O
from riskloom.sources import staging


@pytest.fixture(scope="module")
def frame(spark):
    """A group with nine tenths of the rows, a null group, groups without values, ties."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        g = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None, "é"])
        rows.append((i, g, rng.choice([None, float(rng.randrange(40)), rng.gauss(0, 5)]), rng.randrange(2)))
    rows += [(9000, "none", None, 1), (9001, "one", 2.5, 0)]
    return spark.createDataFrame(rows, "id long, g string, v double, y int").repartition(7).cache()


def groups_of(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r["g"]].append(r)
    return out


def test_quantiles_by_group_equal_numpy(spark, frame):
    ps = (0.0, 0.013, 0.25, 0.5, 0.9, 1.0)
    got = {r["g"]: [r[f"q{i}"] for i in range(len(ps))] for r in O.quantiles(frame, ["g"], ["v"], ps).collect()}
    want = {g: np.quantile([r["v"] for r in rs if r["v"] is not None], ps) for g, rs in groups_of(frame).items() if any(r["v"] is not None for r in rs)}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g]) for g in want)
    assert np.allclose(O.quantile_list(frame, "v", ps), np.quantile([r["v"] for r in frame.collect() if r["v"] is not None], ps))
    assert O.quantile_list(frame.where("g = 'none'"), "v", ps) == [] == O.quantile_list(frame.where("false"), "v", ps)


def test_no_task_has_a_hot_group_whole(spark, frame):
    run = O.prefix_sums(frame.withColumn("one", F.lit(1).cast("long")), ["g"], ["id"], ["one"])
    places = sorted(r["one_before"] for r in run.where("g = 'hot'").collect())
    assert places == list(range(len(places)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more rows
    try:
        ranged = frame.repartitionByRange(F.asc("g"), F.asc("id")).groupBy("g", F.spark_partition_id().alias("p")).count().where("g = 'hot'")
        assert ranged.count() > 1
        again = O.prefix_sums(frame.withColumn("one", F.lit(1).cast("long")), ["g"], ["id"], ["one"])
        assert sorted(r["one_before"] for r in again.where("g = 'hot'").collect()) == places
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_over_nulls_and_batches(spark, frame):
    df = frame.withColumn("w", (F.col("id") % 5).cast("long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r["id"]: (r["w_before"], r["y_before"]) for r in O.prefix_sums(df.withColumn("y", F.col("y").cast("long")), ["g"], [F.desc("id")], ["w", "y"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rs in groups_of(frame).values():
        w = y = 0
        for r in sorted(rs, key=lambda r: -r["id"]):
            assert got[r["id"]] == (w, y)
            w, y = w + r["id"] % 5, y + r["y"]


def test_ranks_in_groups_and_of_all(frame):
    got = {r["id"]: (r["rank"], r["size"]) for r in O.with_group_rank(frame, ["g"], ["id"]).collect()}
    for rs in groups_of(frame).values():
        for k, r in enumerate(sorted(rs, key=lambda r: r["id"]), 1):
            assert got[r["id"]] == (k, len(rs))
    ranked, n = O.with_global_rank(frame, ["id"])
    ids = [r["id"] for r in ranked.orderBy("rank").collect()]
    assert n == len(ids) and ids == sorted(ids) and ranked.agg(F.max("rank")).first()[0] == n


def test_curves_by_group_equal_brute_force(frame):
    got = {r["g"]: r for r in E.grouped_auc(frame, ["g"], "v", "y").collect()}
    for g, rs in groups_of(frame).items():
        pos, neg = ([r["v"] for r in rs if r["v"] is not None and r["y"] == k] for k in (1, 0))
        if not pos or not neg:
            assert g not in got
            continue
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        ks = max(abs(np.mean(np.array(pos) >= s) - np.mean(np.array(neg) >= s)) for s in set(pos + neg))
        assert math.isclose(got[g]["auc"], auc, abs_tol=2e-6) and math.isclose(got[g]["ks"], ks, abs_tol=2e-6)


def test_evenly_spaced_rows_of_groups(frame):
    got = defaultdict(list)
    for r in G.evenly_spaced(frame, ["g"], ["id"], 5).collect():
        got[r["g"]].append(r["id"])
    for g, rs in groups_of(frame).items():
        ids = sorted(r["id"] for r in rs)
        want = ids if len(ids) <= 5 else [ids[int(np.round(i * (len(ids) - 1) / 4))] for i in range(5)]
        assert sorted(got[g]) == want


def test_group_split_and_balance_count_by_class(spark):
    df = spark.createDataFrame([(f"g{i // 2}", int(i // 2 % 4 == 0), "s") for i in range(800)], "g string, y int, s string").repartition(5)
    got = {(r["y"], r["split"]): r["n"] for r in E.group_split(df, "g", "y").groupBy("y", "split").agg(F.countDistinct("g").alias("n")).collect()}
    assert got == {(1, "train"): 70, (1, "val"): 15, (1, "test"): 15, (0, "train"): 210, (0, "val"): 45, (0, "test"): 45}
    assert {r["y"]: r["n"] for r in E.balanced_groups(df, "s", "y", "g").groupBy("y").agg(F.countDistinct("g").alias("n")).collect()} == {0: 100, 1: 100}


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())
