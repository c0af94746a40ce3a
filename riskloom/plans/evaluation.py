"""Queries of splits, models, evaluation and drift (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import evaluate as E
from riskloom.operators.aggregates import with_quantiles
from riskloom.operators.boosting import fit_boosting
from riskloom.plans.base import query
from riskloom.sources.staging import new_path

_FEATURES = ["qty", "price", "discount"]


@query("m1_temporal_split", "WITH r AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) - 1 AS i, count(*) OVER () AS n FROM orders), c AS (SELECT min(o_orderdate) AS cut FROM r WHERE i = floor(n * 0.75)) SELECT CASE WHEN o_orderdate <= cut THEN 'train' ELSE 'test' END AS split, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders, c GROUP BY 1")
def m1(t):
    s = E.temporal_split(t.orders, "o_orderdate")
    return s.groupBy("split").agg(F.count("*").alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))


@query("m2_window_splits", """WITH {SCORED}, v AS (SELECT vintage, count(*) AS n, sum(label)::BIGINT AS events, row_number() OVER (ORDER BY vintage) AS k FROM scored GROUP BY 1), p(plan, part, lo, hi) AS (VALUES ('8/2/3', 'train', 1, 8), ('8/2/3', 'val', 9, 10), ('8/2/3', 'test', 11, 13), ('9/2/2', 'train', 1, 9), ('9/2/2', 'val', 10, 11), ('9/2/2', 'test', 12, 13)),
 g AS (SELECT plan, part, sum(n)::BIGINT AS n, sum(events)::BIGINT AS events, min(vintage) AS first, max(vintage) AS last FROM v JOIN p ON k BETWEEN lo AND hi GROUP BY ALL) SELECT *, round(n * 100.0 / sum(n) OVER (PARTITION BY plan), 4)::DOUBLE AS percent, round(events / n, 6) AS rate FROM g""")
def m2(t):
    return E.window_splits(t.scored(), "vintage", "label", {"8/2/3": (8, 2, 3), "9/2/2": (9, 2, 2)})


def _labelled(t):
    return t.lineitem.withColumn("label", (F.col("l_returnflag") == "R").cast("int"))


@query("m3_group_split")
def m3(t):
    return E.group_split(_labelled(t), "l_orderkey", "label").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("groups"))


@query("m3_split_sizes", """WITH g AS (SELECT l_orderkey, max((l_returnflag = 'R')::INTEGER) AS class FROM lineitem GROUP BY 1), c AS (SELECT class, count(*) AS n, floor(count(*) * 0.70::DOUBLE)::BIGINT AS a, floor(count(*) * 0.15::DOUBLE)::BIGINT AS b FROM g GROUP BY 1)
 SELECT class, 'train' AS split, a AS groups FROM c UNION ALL SELECT class, 'val', b FROM c UNION ALL SELECT class, 'test', n - a - b FROM c""")
def m3b(t):
    s = E.group_split(_labelled(t), "l_orderkey", "label").groupBy("l_orderkey", "split").agg(F.max("label").alias("class"))
    return s.groupBy("class", "split").agg(F.count("*").alias("groups"))


@query("m4_stratified_folds", "WITH {SCORED}, n AS (SELECT label, count(*) AS n FROM scored GROUP BY 1) SELECT label, f::INTEGER AS fold, n // 5 + (f < n % 5)::INTEGER AS n FROM n, unnest([0, 1, 2, 3, 4]) AS u(f)")
def m4(t):
    return E.stratified_folds(t.scored(), "key", "label").groupBy("label", "fold").agg(F.count("*").alias("n"))


@query("m4_holdout", "WITH {SCORED}, n AS (SELECT label, count(*) AS n FROM scored GROUP BY 1) SELECT 'test' AS split, label, n // 5 + (n % 5 > 0)::INTEGER AS n FROM n UNION ALL SELECT 'train', label, n - n // 5 - (n % 5 > 0)::INTEGER FROM n")
def m4b(t):
    return E.holdout(t.scored(), "key", "label").groupBy("split", "label").agg(F.count("*").alias("n"))


@query("m5_time_cv")
def m5(t):
    return E.time_cv(t.scored(), "vintage", "label", _FEATURES)


@query("m5_fold_coverage", """WITH {SCORED}, v AS (SELECT vintage, count(*) AS n FROM scored GROUP BY 1), b AS (SELECT n, least(4, floor((sum(n) OVER (ORDER BY vintage ROWS UNBOUNDED PRECEDING) - n) * 5 / sum(n) OVER ()))::INTEGER AS block FROM v)
 SELECT block::VARCHAR AS fold, sum(n)::BIGINT AS n, sum(n)::BIGINT AS scored FROM b WHERE block > 0 GROUP BY 1 UNION ALL SELECT 'mean', sum(n)::BIGINT, sum(n)::BIGINT FROM b WHERE block > 0""")
def m5b(t):
    return E.time_cv(t.scored(), "vintage", "label", _FEATURES).select("fold", "n", "scored")


@query("m6_balanced_groups", """WITH g AS (SELECT DISTINCT l_linestatus, (l_returnflag = 'R')::INTEGER AS label, l_orderkey FROM lineitem), c AS (SELECT l_linestatus, label, count(*) AS n FROM g GROUP BY ALL)
 SELECT l_linestatus, label, min(n) OVER (PARTITION BY l_linestatus) AS groups FROM c""")
def m6(t):
    return E.balanced_groups(_labelled(t), "l_linestatus", "label", "l_orderkey").groupBy("l_linestatus", "label").agg(F.countDistinct("l_orderkey").alias("groups"))


@query("m7_dummy", "WITH {SCORED}, a AS (SELECT avg(label) AS a FROM scored) SELECT label, round(max(a), 6) AS p, (max(a) >= 0.5)::INTEGER AS most_frequent, count(*) AS n FROM scored, a GROUP BY 1")
def m7(t):
    return E.dummy(t.scored().drop("p"), "label").groupBy("label").agg(F.round(F.max("p"), 6).alias("p"), F.max("most_frequent").alias("most_frequent"), F.count("*").alias("n"))


@query("m7_class_weights", "WITH {SCORED}, c AS (SELECT count(*) AS n, sum(label) AS p FROM scored) SELECT label, count(*) AS n, round(CASE WHEN label = 1 THEN max(c.n) / (2.0 * max(c.p)) ELSE max(c.n) / (2.0 * (max(c.n) - max(c.p))) END, 6)::DOUBLE AS w FROM scored, c GROUP BY 1")
def m7b(t):
    return E.class_weights(t.scored(), "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("w"), 6).alias("w"))


@query("m8_models")
def m8(t):
    return E.compared_models(E.class_weights(t.scored().select("key", "label", *_FEATURES), "label"), _FEATURES, "label", "w", "key")


@query("m8_histogram_boosting")
def m8b(t):
    s = t.scored().drop("p").withColumn("special", F.when(F.col("special") < 99990, F.col("special")))
    return fit_boosting(s, ["qty", "price", "special"], ["linestatus", "vintage"], "label", "key").score(s).select("key", F.round("p", 6).alias("p"))


_SETS = {"M0": [], "M1": ["qty"], "M3": [*_FEATURES, "linestatus"], "M3_sem_X1": ["price", "discount", "linestatus"]}


@query("m9_nested_models")
def m9(t):
    return E.nested_models(t.scored().drop("p"), "key", "label", _SETS, ["linestatus"])


@query("m9_probabilities")
def m9b(t):
    return E.nested_probabilities(t.scored().drop("p"), "key", "label", _SETS, ["linestatus"]).select("key", "fold", *[F.round(f"p_{n}", 6).alias(f"p_{n}") for n in _SETS])


@query("m9_fold_coverage", """WITH {SCORED}, n AS (SELECT label, count(*) AS n FROM scored GROUP BY 1), f AS (SELECT f::INTEGER AS fold, label, n // 5 + (f < n % 5)::INTEGER AS n FROM n, unnest([0, 1, 2, 3, 4]) AS u(f)),
 g AS (SELECT fold, sum(n)::BIGINT AS n, (sum(n) FILTER (WHERE label = 1))::BIGINT AS n1 FROM f GROUP BY 1) SELECT fold, n, n AS n_m1, n AS n_m3, n AS n_m3_sem_x1, round((sum(n1) OVER () - n1)::DOUBLE / (sum(n) OVER () - n)::DOUBLE, 6) AS p_m0 FROM g""")
def m9c(t):
    p = E.nested_probabilities(t.scored().drop("p"), "key", "label", _SETS, ["linestatus"])
    return p.groupBy("fold").agg(F.count("*").alias("n"), *[F.count(f"p_{n}").alias(f"n_{n.lower()}") for n in ("M1", "M3", "M3_sem_X1")], F.round(F.avg("p_M0"), 6).alias("p_m0"))


_RUN = "c AS (SELECT p, sum(label)::BIGINT AS n1, sum(1 - label)::BIGINT AS n0 FROM scored GROUP BY 1), s AS (SELECT *, sum(n1) OVER w AS tp, sum(n0) OVER w AS fp, sum(n1) OVER () AS pos, sum(n0) OVER () AS neg FROM c WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"


@query("m10_ranking_metrics", "WITH {SCORED}, " + _RUN + ", a AS (SELECT sum(n1 * (neg - fp + n0 / 2.0::DOUBLE)) / (max(pos) * max(neg)) AS a, max(abs(tp / pos - fp / neg)) AS k, sum(n1 / pos * tp / (tp + fp)) AS ap FROM s) SELECT round(a, 6) AS auc, round(2 * a - 1, 6) AS gini, round(k, 6) AS ks, round(ap, 6) AS average_precision FROM a")
def m10(t):
    return E.ranking_metrics(t.scored(), "p", "label")


@query("m11_ks_by_group", "WITH {SCORED}, c AS (SELECT linestatus, p, sum(label)::BIGINT AS n1, sum(1 - label)::BIGINT AS n0 FROM scored GROUP BY ALL), s AS (SELECT *, sum(n1) OVER w AS tp, sum(n0) OVER w AS fp, sum(n1) OVER (PARTITION BY linestatus) AS pos, sum(n0) OVER (PARTITION BY linestatus) AS neg FROM c WINDOW w AS (PARTITION BY linestatus ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), a AS (SELECT linestatus, sum(n1 * (neg - fp + n0 / 2.0::DOUBLE)) / (max(pos) * max(neg)) AS a, max(abs(tp / pos - fp / neg)) AS k FROM s WHERE pos > 0 AND neg > 0 GROUP BY 1) SELECT linestatus, round(a, 6) AS auc, round(2 * a - 1, 6) AS gini, round(k, 6) AS ks FROM a")
def m11(t):
    return E.grouped_auc(t.scored(), ["linestatus"], "p", "label")


@query("m12_average_precision", "WITH {SCORED}, " + _RUN + " SELECT round(sum(n1 / pos * tp / (tp + fp)), 6) AS average_precision FROM s")
def m12(t):
    return E.ranking_metrics(t.scored(), "p", "label").select("average_precision")


@query("m13_probability_metrics", "WITH {SCORED} SELECT count(*) AS n, round(avg((p - label) * (p - label)), 6) AS brier, round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 6) AS log_loss, round(avg(label), 6) AS prevalence, round(avg(p), 6) AS mean_prediction, round(avg(p) - avg(label), 6) AS gap FROM scored")
def m13(t):
    return E.probability_metrics(t.scored(), "p", "label")


@query("m14_threshold_metrics", """WITH {SCORED}, n AS (SELECT linestatus, count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn FROM scored GROUP BY 1),
 x AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS rec, coalesce(tn / nullif(tn + fp, 0), 0) AS spec, coalesce(tp / nullif(tp + fp, 0), 0) AS prec FROM n)
 SELECT linestatus, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((rec + spec) / 2, 6) AS balanced_accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall, round(spec, 6) AS specificity, round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 6) AS f1 FROM x""")
def m14(t):
    return E.threshold_metrics(t.scored(), ["linestatus"], "p", "label")


_BINS = "rk AS (SELECT *, row_number() OVER (ORDER BY p, key) AS r, count(*) OVER () AS nn FROM scored), bn AS (SELECT *, greatest(1, ceil((r - 1) * 10 / (nn - 1)::DOUBLE))::INTEGER AS b FROM rk)"


@query("m15_decile_table", "WITH {SCORED}, " + _BINS + ", g AS (SELECT 11 - b AS bin, count(*) AS n, sum(label)::BIGINT AS events, avg(label) AS rr, round(avg(p), 6) AS mean_p, round(min(p), 6) AS min_p, round(max(p), 6) AS max_p FROM bn GROUP BY 1) SELECT bin, n, events, round(rr, 6) AS rate, mean_p, min_p, max_p, round(rr / (SELECT avg(label) FROM scored), 6) AS lift, round(sum(events) OVER (ORDER BY bin) / sum(events) OVER (), 6)::DOUBLE AS capture FROM g")
def m15(t):
    return E.decile_table(t.scored(), "p", "label", "key")


_Q = (0.5, 0.75, 0.9)


@query("m16_threshold_sweep", "WITH {SCORED}, e AS (SELECT unnest([0.5, 0.75, 0.9])::VARCHAR AS quantile, unnest(quantile_cont(p, [0.5, 0.75, 0.9])) AS th FROM scored), x AS (SELECT quantile, max(th) AS th, count(*) AS n, count(*) FILTER (WHERE p >= th AND label = 1) AS hit, count(*) FILTER (WHERE p >= th) AS flagged, count(*) FILTER (WHERE label = 1) AS bad, count(*) FILTER (WHERE p < th) AS ok FROM scored, e GROUP BY 1) SELECT replace(quantile, '0.50', '0.5') AS quantile, round(th, 6) AS threshold, round(hit / flagged, 6) AS precision, round(hit / bad, 6) AS recall, round(2 * (hit / flagged) * (hit / bad) / (hit / flagged + hit / bad), 6) AS f1, round(ok / n, 6) AS approval, round((bad - hit) / ok, 6) AS bad_approved, round(hit / flagged, 6) AS bad_blocked FROM x")
def m16(t):
    return E.threshold_sweep(t.scored(), "p", "label", _Q).withColumn("quantile", F.when(F.col("quantile") == "0.9", "0.90").otherwise(F.col("quantile")))


@query("m17_reliability", "WITH {SCORED}, x AS (SELECT p * 0.79::DOUBLE AS p, label FROM scored), g AS (SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS rate FROM x GROUP BY 1) SELECT i::INTEGER AS bin, coalesce(n, 0) AS n, mean_p, rate FROM unnest(range(10)) AS u(i) LEFT JOIN g ON bin = i")
def m17(t):
    return E.reliability(t.scored().withColumn("p", F.col("p") * 0.79), "p", "label")


_Z = 1.959963984540054


@query("m18_quantile_calibration", "WITH {SCORED}, " + _BINS + f", g AS (SELECT b AS bin, count(*) AS n, sum(label)::BIGINT AS events, round(avg(p), 6) AS mean_p, sum(label) / count(*) AS q FROM bn GROUP BY 1) SELECT bin, n, events, mean_p, round(q, 6) AS rate, round((q + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) - {_Z} * sqrt(q * (1 - q) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n), 6) AS low, round((q + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) + {_Z} * sqrt(q * (1 - q) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n), 6) AS high FROM g")
def m18(t):
    return E.quantile_calibration(t.scored(), "p", "label", "key")


_SLOPE = """d AS (SELECT ln(q / (1 - q)) AS x, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS y FROM (SELECT least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q, label FROM scored) GROUP BY 1),
 it AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT k + 1, a + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1), b + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1)
  FROM (SELECT k, a, b, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(g) AS g0, sum(g * x) AS g1
   FROM (SELECT k, a, b, x, n * m * (1 - m) AS w, y - n * m AS g FROM (SELECT k, a, b, x, n, y, 1 / (1 + exp(-(a + b * x))) AS m FROM it, d WHERE k < 15)) GROUP BY k, a, b))"""


@query("m19_calibration_slope", "WITH RECURSIVE {SCORED}, " + _SLOPE + " SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM it WHERE k = 15")
def m19(t):
    return E.calibration_slope(t.scored(), "p", "label")


@query("m20_curves", "WITH {SCORED}, " + _RUN + " SELECT p AS score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM s")
def m20(t):
    return E.curves(t.scored(), "p", "label")


@query("m20_thinned_curve", "WITH {SCORED}, " + _RUN + ", r AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS k FROM s) SELECT p AS score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM r WHERE k <= 21 OR i IN (SELECT round_even(j * (k - 1) / 20.0::DOUBLE, 0)::BIGINT FROM unnest(range(21)) AS u(j))")
def m20b(t):
    from riskloom.operators.aggregates import thinned

    return thinned(E.curves(t.scored(), "p", "label"), "score", 21)


_PSI = "sum((greatest(b, 0.0001) - greatest(a, 0.0001)) * ln(greatest(b, 0.0001) / greatest(a, 0.0001)))"


def _psi_num(codes):
    special = " ".join(f"WHEN special = {c} THEN 'SPECIAL_{c}'" for c in codes)
    return "rf AS (SELECT * FROM scored WHERE year = 1998), e AS (SELECT list_sort(list_distinct(quantile_cont(special, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM rf WHERE special NOT IN (99997, 99998)), b AS (SELECT year = 1998 AS ref, CASE WHEN special IS NULL THEN 'MISSING' " + special + " ELSE (SELECT coalesce(min(i) - 1, len(e) - 1) FROM unnest(range(2, len(e))) AS u(i) WHERE special <= e[i])::VARCHAR END AS bin FROM scored, e WHERE year IN (1998, 1999)), g AS (SELECT bin, count(*) FILTER (WHERE ref) AS x, count(*) FILTER (WHERE NOT ref) AS y FROM b GROUP BY 1), s AS (SELECT x / sum(x) OVER () AS a, y / sum(y) OVER () AS b FROM g)"


@query("m21_psi_numeric", "WITH {SCORED}, " + _psi_num((99997, 99998)) + f" SELECT round({_PSI}, 6) AS psi FROM s")
def m21(t):
    s = t.scored()
    return E.psi_numeric(s.where("year = 1998"), s.where("year = 1999"), "special", 10, (99997.0, 99998.0))


@query("m22_psi_categorical", f"WITH x AS (SELECT o_orderpriority AS bin, count(*) FILTER (WHERE year(o_orderdate) = 1998) AS x, count(*) FILTER (WHERE year(o_orderdate) = 1999) AS y FROM orders GROUP BY 1), s AS (SELECT x / sum(x) OVER () AS a, y / sum(y) OVER () AS b FROM x) SELECT round({_PSI}, 6) AS psi FROM s")
def m22(t):
    return E.psi_categorical(t.orders.where("year(o_orderdate) = 1998"), t.orders.where("year(o_orderdate) = 1999"), "o_orderpriority")


_MATRIX = "e AS (SELECT list_sort(list_distinct(quantile_cont(qty, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM scored WHERE year = 1998), l AS (SELECT year, 'qty' AS variable, (SELECT coalesce(min(i) - 1, len(e) - 1) FROM unnest(range(2, len(e))) AS u(i) WHERE qty <= e[i])::VARCHAR AS v FROM scored, e UNION ALL SELECT year, 'flag', flag FROM scored), r AS (SELECT variable, v, count(*) AS x FROM l WHERE year = 1998 GROUP BY ALL), n AS (SELECT year, variable, v, count(*) AS y FROM l WHERE year <> 1998 GROUP BY ALL), bb AS (SELECT variable, v FROM r UNION SELECT variable, v FROM n), f AS (SELECT p.year, p.variable, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT DISTINCT year, variable FROM n) p JOIN bb USING (variable) LEFT JOIN r ON r.variable = p.variable AND r.v = bb.v LEFT JOIN n ON n.year = p.year AND n.variable = p.variable AND n.v = bb.v), s AS (SELECT year, variable, x / sum(x) OVER w AS a, y / sum(y) OVER w AS b FROM f WINDOW w AS (PARTITION BY year, variable)), mx AS (SELECT year, variable, round(" + _PSI + ", 6) AS psi FROM s GROUP BY ALL)"


@query("m23_psi_matrix", "WITH {SCORED}, " + _MATRIX + " SELECT * FROM mx")
def m23(t):
    return E.psi_matrix(t.scored(), "year", F.col("year") == 1998, ["qty"], ["flag"])


@query("m23_psi_summary", "WITH {SCORED}, " + _MATRIX + " SELECT variable, max(psi) AS max_psi, round(avg(psi), 6) AS mean_psi FROM mx GROUP BY 1")
def m23b(t):
    return E.psi_summary(m23_frame(t))


def m23_frame(t):
    return E.psi_matrix(t.scored(), "year", F.col("year") == 1998, ["qty"], ["flag"])


@query("m24_bootstrap_metrics")
def m24(t):
    return E.bootstrap_intervals(t.scored(), "grp", "p", "label", 2000)


_GROUPS = "g AS (SELECT grp, avg(p) AS p, max(label)::BIGINT AS y FROM scored GROUP BY 1), k AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 0)::DOUBLE AS tn, count(*) FILTER (WHERE p < 0.5 AND y = 1)::DOUBLE AS fn FROM g)"


@query("m24_point_estimates", "WITH {SCORED}, " + _GROUPS + " SELECT 'accuracy' AS metric, round((tp + tn) / (tp + tn + fp + fn), 6) AS estimate FROM k UNION ALL SELECT 'precision', round(coalesce(tp / nullif(tp + fp, 0), 0), 6) FROM k UNION ALL SELECT 'recall', round(tp / (tp + fn), 6) FROM k UNION ALL SELECT 'specificity', round(tn / (tn + fp), 6) FROM k UNION ALL SELECT 'balanced_accuracy', round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) FROM k UNION ALL SELECT 'f1', round(2 * tp / (2 * tp + fp + fn), 6) FROM k")
def m24b(t):
    return E.group_metrics(t.scored(), "grp", "p", "label").where(~F.col("metric").isin("roc_auc", "average_precision"))


_MODELS = "g AS (SELECT c_mktsegment AS model, round(avg(c_acctbal) / 10000, 6) AS auc, round(median(c_acctbal) / 10000, 6) AS ks, round(avg(c_nationkey) / 25, 6) AS ap, round(stddev_samp(c_acctbal) / 10000, 6) AS brier, round(max(c_acctbal) / 10000, 6) AS log_loss, count(*) / 10000.0::DOUBLE AS gap FROM customer GROUP BY 1)"


def _models(t):
    c = t.customer.withColumnRenamed("c_mktsegment", "model")
    g = c.groupBy("model").agg(F.round(F.avg("c_acctbal") / 10000, 6).alias("auc"), F.round(F.avg("c_nationkey") / 25, 6).alias("ap"), F.round(F.stddev_samp("c_acctbal") / 10000, 6).alias("brier"), F.round(F.max("c_acctbal") / 10000, 6).alias("log_loss"), (F.count("*") / 10000.0).alias("gap"))
    return with_quantiles(g, c, ["model"], "c_acctbal", (0.5,)).select("model", "auc", F.round(F.col("q0") / 10000, 6).alias("ks"), "ap", "brier", "log_loss", "gap")


@query("m25_choose_model", "WITH " + _MODELS + ", r AS (SELECT model, round(rank() OVER (ORDER BY auc DESC) * 0.35 + rank() OVER (ORDER BY ks DESC) * 0.25 + rank() OVER (ORDER BY ap DESC) * 0.10 + rank() OVER (ORDER BY brier) * 0.15 + rank() OVER (ORDER BY log_loss) * 0.10 + rank() OVER (ORDER BY gap) * 0.05, 6)::DOUBLE AS weighted_rank FROM g) SELECT *, row_number() OVER (ORDER BY weighted_rank, model)::INTEGER AS place FROM r")
def m25(t):
    return E.choose_model(_models(t)).select("model", "weighted_rank", "place")


@query("m26_compare_models", "WITH " + _MODELS + ", w AS (SELECT model, auc, brier FROM g) SELECT model, auc, brier, NULL::DOUBLE AS ci FROM w UNION ALL SELECT 'MACHINERY - BUILDING', round(b.auc - a.auc, 6), round(b.brier - a.brier, 6), NULL FROM w a, w b WHERE a.model = 'BUILDING' AND b.model = 'MACHINERY'")
def m26(t):
    return E.compare_models(_models(t).unpivot("model", ["auc", "brier"], "metric", "value"), "BUILDING", "MACHINERY", ["auc", "brier"])


@query("m27_permutation_importance")
def m27(t):
    s = t.scored().drop("p")
    model = E.fit_model(s, "logistic", _FEATURES, "label")
    return E.permutation_importance(E.array_score(model, _FEATURES), s, _FEATURES, "label", "key")


@query("m28_consolidated_importance", "WITH a AS (SELECT CASE WHEN c_nationkey >= 20 THEN 'REST' ELSE c_mktsegment END AS variable, count(*) AS x FROM customer GROUP BY 1), b AS (SELECT CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'POOR' END AS variable, count(*) AS y FROM customer GROUP BY 1), j AS (SELECT coalesce(a.variable, b.variable) AS variable, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b ON a.variable = b.variable), i AS (SELECT *, round((x / max(x) OVER () + y / max(y) OVER ()) / 2, 6) AS importance FROM j) SELECT *, row_number() OVER (ORDER BY importance DESC, variable)::INTEGER AS place FROM i")
def m28(t):
    a = t.customer.groupBy(F.when(F.col("c_nationkey") >= 20, "REST").otherwise(F.col("c_mktsegment")).alias("variable")).agg(F.count("*").alias("x"))
    b = t.customer.groupBy(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("POOR").alias("variable")).agg(F.count("*").alias("y"))
    return E.consolidate_importance(a, b)


@query("m29_best_run", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000) DESC, c_mktsegment, c_custkey) AS r FROM customer) WHERE r = 1")
def m29(t):
    return E.best_run(t.customer, ["c_nationkey"], [-F.floor(F.col("c_acctbal") / 1000), F.col("c_mktsegment"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("m30_performance_by_vintage", "WITH {SCORED}, c AS (SELECT year, p, sum(label)::BIGINT AS n1, sum(1 - label)::BIGINT AS n0 FROM scored GROUP BY ALL), s AS (SELECT *, sum(n1) OVER w AS tp, sum(n0) OVER w AS fp, sum(n1) OVER (PARTITION BY year) AS pos, sum(n0) OVER (PARTITION BY year) AS neg FROM c WINDOW w AS (PARTITION BY year ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), a AS (SELECT year, sum(n1 * (neg - fp + n0 / 2.0::DOUBLE)) / (max(pos) * max(neg)) AS a, max(abs(tp / pos - fp / neg)) AS k FROM s WHERE pos > 0 AND neg > 0 GROUP BY 1), g AS (SELECT year, count(*) AS n, round(avg((p - label) * (p - label)), 6) AS brier, round(avg(p) - avg(label), 6) AS bias, round(avg(p) / nullif(avg(label), 0) - 1, 6) AS relative_bias FROM scored GROUP BY 1) SELECT g.*, round(a, 6) AS auc, round(2 * a - 1, 6) AS gini, round(k, 6) AS ks FROM g LEFT JOIN a USING (year)")
def m30(t):
    return E.performance_by_vintage(t.scored(), "year", "p", "label")


@query("m30_calibration_error", "WITH {SCORED}, " + _BINS + ", g AS (SELECT b, count(*) AS n, avg(p) AS p, avg(label) AS y FROM bn GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece, round(max(abs(p - y)), 6) AS worst FROM g")
def m30b(t):
    return E.expected_calibration_error(t.scored(), "p", "label", "key")


def _with_gaps(t):
    """A feature that is missing in some rows, as the special codes of the column are."""
    return t.scored().drop("p").withColumn("special", F.when(F.col("special") < 99990, F.col("special")))


def _batch(t):
    s, columns = _with_gaps(t), [*_FEATURES, "special"]
    path = new_path(t.spark, "model")
    E.fit_model(s, "logistic", columns, "label").write().save(path)
    return E.score_saved(t.spark, path, s, columns)


@query("m31_batch_scoring")
def m31(t):
    return _batch(t).select("key", F.round("p", 6).alias("p"))


@query("m31_every_row", "WITH {SCORED} SELECT special IS NULL OR special >= 99990 AS gap, count(*) AS n, count(*) AS scored, count(*) AS within FROM scored GROUP BY 1")
def m31b(t):
    return _batch(t).groupBy(F.col("special").isNull().alias("gap")).agg(F.count("*").alias("n"), F.count("p").alias("scored"), F.count_if(F.col("p").between(0, 1)).alias("within"))


def _uni(c):
    return f"SELECT '{c}' AS variable, {c}::DOUBLE AS v, label FROM scored"


@query("m32_univariate", "WITH {SCORED}, u AS (" + " UNION ALL ".join(map(_uni, _FEATURES)) + "), c AS (SELECT variable, v, sum(label)::BIGINT AS n1, sum(1 - label)::BIGINT AS n0 FROM u GROUP BY ALL), s AS (SELECT *, sum(n1) OVER w AS tp, sum(n0) OVER w AS fp, sum(n1) OVER (PARTITION BY variable) AS pos, sum(n0) OVER (PARTITION BY variable) AS neg FROM c WINDOW w AS (PARTITION BY variable ORDER BY v DESC ROWS UNBOUNDED PRECEDING)), a AS (SELECT variable, sum(n1 * (neg - fp + n0 / 2.0::DOUBLE)) / (max(pos) * max(neg)) AS a, max(abs(tp / pos - fp / neg)) AS k FROM s GROUP BY 1) SELECT variable, round(a, 6) AS auc, round(2 * a - 1, 6) AS gini, round(k, 6) AS ks FROM a")
def m32(t):
    return E.univariate(t.scored(), _FEATURES, "label")


@query("m32_spearman", "WITH {SCORED}, r AS (SELECT rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS b FROM scored) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r")
def m32b(t):
    return E.spearman(t.scored(), "qty", "price")


@query("m32_information_value", "WITH {SCORED}, e AS (SELECT list_sort(list_distinct(quantile_cont(price, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM scored), b AS (SELECT label, (SELECT coalesce(min(i) - 1, len(e) - 1) FROM unnest(range(2, len(e))) AS u(i) WHERE price <= e[i]) AS bin FROM scored, e), g AS (SELECT bin, count(*) FILTER (WHERE label = 1) AS x, count(*) FILTER (WHERE label = 0) AS y FROM b GROUP BY 1), s AS (SELECT x / sum(x) OVER () AS a, y / sum(y) OVER () AS b FROM g)" + f" SELECT round({_PSI}, 6) AS information_value FROM s")
def m32c(t):
    return E.information_value(t.scored(), "price", "label")
