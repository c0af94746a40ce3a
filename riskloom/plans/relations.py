"""Queries of joins, set operations and windows (J, U, W) and of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import aggregates as G, joins as J
from riskloom.plans.base import query

_D = "strftime({0}, '%Y-%m-%d')"


def _label(t):
    return J.label_12m(t.loans(), t.performance(), "cust")


@query("j1_month12_join", "WITH {LOANS} SELECT key, flag12 FROM lab")
def j1(t):
    loans = t.loans().withColumn("month12", F.last_day(F.add_months("day", 12)))
    return J.month12_join(loans, t.performance(), "cust").select("key", "flag12")


@query("j2_window_join", "WITH {LOANS} SELECT l.key, count(*) AS n, sum(p.flag)::BIGINT AS bad FROM timed l JOIN perf p ON p.cust = l.cust AND p.ref > l.day AND p.ref <= l.month12 GROUP BY 1")
def j2(t):
    loans = t.loans().withColumn("month12", F.last_day(F.add_months("day", 12)))
    return J.window_join(loans, t.performance(), "cust").groupBy("key").agg(F.count("*").alias("n"), F.sum("flag").alias("bad"))


@query("c3_label_12m", "WITH {LOANS} SELECT key, has_window, origin, label FROM lab")
def c3(t):
    return _label(t).select("key", "has_window", "origin", "label")


@query("j3_c4_ever_label", "WITH {LOANS}, w AS (SELECT l.key, max(p.flag) AS m FROM lab l JOIN perf p ON p.cust = l.cust AND p.ref > l.day AND p.ref <= l.month12 GROUP BY 1) SELECT lab.key, CASE WHEN has_window THEN coalesce(m, 0) END AS ever FROM lab LEFT JOIN w ON w.key = lab.key")
def c4(t):
    return J.ever_label(_label(t), t.performance(), "key", "cust").select("key", "ever")


@query("j4_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j4(t):
    return J.lookup(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation, ["n_nationkey"]).select("c_custkey", "n_name")


@query("j5_propagate", "SELECT l_orderkey AS grp, l_linenumber, ['test','train','val'][(l_orderkey % 3 + 1)::INTEGER] AS split, count(*) AS n FROM lineitem GROUP BY ALL")
def j5(t):
    groups = t.orders.select(F.col("o_orderkey").alias("grp"), F.element_at(F.array(F.lit("test"), F.lit("train"), F.lit("val")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("split"))
    return J.propagate_group(t.lineitem.withColumnRenamed("l_orderkey", "grp"), groups, "grp", "split").groupBy("grp", "l_linenumber", "split").agg(F.count("*").alias("n"))


@query("j6_outer_merge", "WITH a AS (SELECT c_nationkey AS k, count(*) AS x FROM customer GROUP BY 1), b AS (SELECT s_nationkey + 5 AS k, count(*) AS y FROM supplier GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b ON a.k = b.k")
def j6(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("x"))
    return J.outer_merge(a, t.supplier.groupBy((F.col("s_nationkey") + 5).alias("k")).agg(F.count("*").alias("y")), "k")


@query("j7_duplicate_members", "WITH h AS (SELECT doc_id, md5(text) AS digest, source FROM documents) SELECT doc_id, source, (SELECT count(*) FROM h x WHERE x.digest = h.digest) AS copies FROM h WHERE digest IN (SELECT digest FROM h GROUP BY 1 HAVING count(*) > 1)")
def j7(t):
    from riskloom.operators import audit

    return audit.exact_duplicates(t.documents, "doc_id", "text").join(t.documents.select("doc_id", "source"), "doc_id").select("doc_id", "source", "copies")


@query("j8_attach_metadata", "SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l LEFT JOIN documents d USING (doc_id)")
def j8(t):
    return J.attach(t.labels, t.documents.select("doc_id", "lang", "source"), ["doc_id"]).select("doc_id", "quality", "lang", "source")


@query("j9_expand_scenarios", "SELECT s AS scenario, count(*) AS n, round(sum(o_totalprice * f), 0) AS total FROM orders, (VALUES ('a', 0.5::DOUBLE), ('b', 1.0), ('c', 1.5)) v(s, f) GROUP BY 1")
def j9(t):
    s = t.spark.createDataFrame([("a", 0.5), ("b", 1.0), ("c", 1.5)], "scenario string, f double")
    return J.expand_scenarios(t.orders, s).groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice") * F.col("f")), 0).alias("total"))


@query("j10_semi_anti", "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)) AS members, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)) AS others")
def j10(t):
    keys = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    a = J.members(t.customer, keys, "c_custkey").agg(F.count("*").alias("members"))
    return a.join(F.broadcast(J.non_members(t.customer, keys, "c_custkey").agg(F.count("*").alias("others"))))


@query("j11_attach_intervals", "WITH {SCORED}, m AS (SELECT year, linestatus, round(avg(p), 6) AS value FROM scored GROUP BY ALL), c AS (SELECT year + 1 AS year, round(min(p), 6) AS low, round(max(p), 6) AS high FROM scored GROUP BY 1) SELECT year, linestatus, value, low, high FROM m LEFT JOIN c USING (year)")
def j11(t):
    s = t.scored()
    m = s.groupBy("year", "linestatus").agg(F.round(F.avg("p"), 6).alias("value"))
    # the interval of the year before: the first year has none
    return J.attach(m, s.groupBy((F.col("year") + 1).alias("year")).agg(F.round(F.min("p"), 6).alias("low"), F.round(F.max("p"), 6).alias("high")), ["year"]).select("year", "linestatus", "value", "low", "high")


_YEARLY = "yearly AS (SELECT n_name AS unit, year(o_orderdate)::INTEGER AS year, count(*)::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), chg AS (SELECT *, CASE WHEN lag(year) OVER w = year - 1 THEN lag(value) OVER w END AS b FROM yearly WINDOW w AS (PARTITION BY unit ORDER BY year)), y AS (SELECT unit, year, value, round(value - b, 4) AS difference, round((value - b) * 100.0 / b, 4) AS percent FROM chg)"


def _yearly(t):
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return G.year_change(c.groupBy(F.col("n_name").alias("unit"), F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("value")), "unit", "year", "value")


@query("w1_year_change", f"WITH {_YEARLY} SELECT * FROM y")
def w1(t):
    return _yearly(t)


@query("w2_largest_fall", f"WITH {_YEARLY} SELECT unit, arg_min(year, difference * 10000 + year) AS year, min(difference) AS fall FROM y WHERE difference IS NOT NULL GROUP BY 1")
def w2(t):
    return G.largest_fall(_yearly(t), "unit", "year", "difference")


@query("w3_shares", "WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6)::DOUBLE AS share FROM g")
def w3(t):
    return G.shares(t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "l_returnflag", "n")


@query("w4_cumulative", "WITH g AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT *, round(sum(n) OVER (ORDER BY p_size) / sum(n) OVER (), 6)::DOUBLE AS capture FROM g")
def w4(t):
    return G.cumulative_share(t.part.groupBy("p_size").agg(F.count("*").alias("n")), "p_size", "n")


@query("w5_metric_ranks", "WITH g AS (SELECT c_mktsegment AS model, count(*) AS auc, round(avg(c_acctbal), 2) AS loss FROM customer GROUP BY 1) SELECT *, rank() OVER (ORDER BY auc DESC)::INTEGER AS rank_auc, rank() OVER (ORDER BY loss)::INTEGER AS rank_loss FROM g")
def w5(t):
    g = t.customer.groupBy(F.col("c_mktsegment").alias("model")).agg(F.count("*").alias("auc"), F.round(F.avg("c_acctbal"), 2).alias("loss"))
    return G.metric_ranks(g, {"auc": "desc", "loss": "asc"})


@query("w6_first_rows", "SELECT o_custkey, o_orderkey, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS ordinal FROM orders) WHERE ordinal <= 2")
def w6(t):
    return G.first_rows(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "ordinal")


_TAG = "tagged AS (SELECT *, CASE WHEN label = 1 THEN CASE WHEN p >= 0.5 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN p >= 0.5 THEN 'FP' ELSE 'TN' END END AS tag FROM scored)"


@query("w7_error_examples", "WITH {SCORED}, " + _TAG + " SELECT tag, key, p, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY CASE WHEN tag IN ('FP', 'TP') THEN -p ELSE p END, key)::INTEGER AS ordinal FROM tagged) WHERE ordinal <= 5")
def w7(t):
    from riskloom.functions import features as X

    s = t.scored().withColumn("tag", X.outcome_tag(F.col("label"), (F.col("p") >= 0.5).cast("int")))
    return G.error_examples(s, "tag", "p", "key", 5).select("tag", "key", "p", "ordinal")


@query("w8_evenly_spaced", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR p IN (SELECT round_even(i * (n - 1) / 3.0, 0) FROM unnest([0, 1, 2, 3]) AS u(i))")
def w8(t):
    return G.evenly_spaced(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query("w9_dedup_first", "SELECT lower(o_orderpriority) AS p, min(o_orderkey) AS first FROM orders GROUP BY 1")
def w9(t):
    return G.dedup_first(t.orders.select("o_orderkey", "o_orderpriority"), F.col("o_orderpriority"), "o_orderkey").select(F.lower("o_orderpriority").alias("p"), F.col("o_orderkey").alias("first"))


@query("w10_ordinal", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INTEGER AS ordinal FROM customer")
def w10(t):
    from pyspark.sql import Window

    return t.customer.select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("ordinal"))


@query("w11_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def w11(t):
    return G.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20)


@query("w12_thinned", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE p IN (SELECT round_even(i * (n - 1) / 200.0, 0) FROM unnest(range(201)) AS u(i))")
def w12(t):
    return G.thinned(t.orders.select("o_orderkey"), "o_orderkey", 201)


@query("w13_direction", "WITH {SCORED}, g AS (SELECT 'qty' AS variable, floor(qty / 10)::INTEGER AS band, avg(label) AS rate FROM scored GROUP BY 2 UNION ALL SELECT 'discount', floor(discount * 50)::INTEGER, avg(label) FROM scored GROUP BY 2) SELECT variable, round(arg_max(rate, band) - arg_min(rate, band), 6) AS effect, CASE WHEN round(arg_max(rate, band) - arg_min(rate, band), 6) > 0 THEN 'up' WHEN round(arg_max(rate, band) - arg_min(rate, band), 6) < 0 THEN 'down' ELSE 'flat' END AS direction FROM g GROUP BY 1")
def w13(t):
    s = t.scored()
    y = F.avg(F.col("label").cast("double")).alias("rate")
    g = s.groupBy(F.lit("qty").alias("variable"), F.floor(F.col("qty") / 10).cast("int").alias("band")).agg(y).union(s.groupBy(F.lit("discount").alias("variable"), F.floor(F.col("discount") * 50).cast("int").alias("band")).agg(y))
    return G.direction_of_effect(g, "variable", "band", "rate")


@query("u1_concatenate", "SELECT 'customer' AS kind, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def u1(t):
    a = t.customer.groupBy(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return a.unionByName(t.supplier.groupBy(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")))


@query("u2_intersect_except", "SELECT 'both' AS part, k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'left', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u2(t):
    a, b = t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("part"), "k").union(a.subtract(b).select(F.lit("left"), "k"))


@query("u3_distinct_groups", "SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem")
def u3(t):
    return t.lineitem.select("l_orderkey", "l_returnflag").dropDuplicates()
