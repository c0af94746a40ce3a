"""Queries of aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import bands
from riskloom.operators import aggregates as G
from riskloom.plans.base import query

_BAND = "e AS (SELECT list_sort(list_distinct(quantile_cont(qty, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM scored), b AS (SELECT scored.*, (SELECT min(i) - 1 FROM unnest(range(2, len(e) + 1)) AS u(i) WHERE qty <= e[i])::INTEGER AS band FROM scored, e)"


@query("a1_risk_by_band", "WITH {SCORED}, " + _BAND + " SELECT band, count(*) AS n, round(avg(label), 6) AS rate, min(qty) AS low, max(qty) AS high, round(avg(price), 4) AS mean_price, round((avg(label) - (SELECT avg(label) FROM scored)) * 100, 4) AS gap_pp FROM b GROUP BY 1")
def a1(t):
    return G.risk_by_band(bands.quantile_bands(t.scored(), "qty", 4), "band", "qty", "label", ["price"])


@query("a2_risk_by_category", "WITH {COHORT} SELECT cluster, count(*) AS n, round(avg(y), 6) AS rate FROM base GROUP BY 1 HAVING count(*) >= 50")
def a2(t):
    return G.risk_by_category(t.cohort(), "cluster", "y", 50)


@query("a3_vintage_table", "WITH {COHORT} SELECT month AS vintage, count(*) AS n, round(avg(y), 6) AS rate_y, round(avg(t), 6) AS rate_t, round(avg(price), 4) AS mean_price FROM base GROUP BY 1")
def a3(t):
    return G.vintage_table(t.cohort(), F.col("month"), ["y", "t"], ["price"])


@query("a4_grouping_sets", "WITH {COHORT} SELECT CASE WHEN grouping(nation) = 1 THEN 'TOTAL' ELSE nation END AS nation, count(*) AS n, round(avg(price), 4) AS mean FROM base GROUP BY GROUPING SETS ((nation), ())")
def a4(t):
    return G.with_total(t.cohort(), "nation", {"n": F.count("*"), "mean": G.r(F.avg("price"))})


@query("a5_filtered_counts", "WITH {COHORT} SELECT year, count(*) FILTER (WHERE t = 1) AS treated, count(*) FILTER (WHERE t = 0) AS untreated, count(*) FILTER (WHERE t IS NULL) AS unknown, count(*) FILTER (WHERE price > 200000 AND y = 1) AS large_events FROM base GROUP BY 1")
def a5(t):
    return t.cohort().groupBy("year").agg(F.count_if(F.col("t") == 1).alias("treated"), F.count_if(F.col("t") == 0).alias("untreated"), F.count_if(F.col("t").isNull()).alias("unknown"), F.count_if((F.col("price") > 200000) & (F.col("y") == 1)).alias("large_events"))


_LV = ("F", "O", "P")


@query("a6_crosstab", "WITH {COHORT}, g AS (SELECT CASE WHEN grouping(segment) = 1 THEN 'TOTAL' ELSE segment END AS segment, " + ", ".join(f"count(*) FILTER (WHERE status = '{v}') AS \"n_{v}\"" for v in _LV) + ", count(*) AS total FROM base GROUP BY GROUPING SETS ((segment), ())) SELECT segment, " + ", ".join(f"\"n_{v}\"" for v in _LV) + ", total, " + ", ".join(f"round(\"n_{v}\" * 100.0 / total, 4)::DOUBLE AS \"row_{v}\"" for v in _LV) + ", " + ", ".join(f"round(\"n_{v}\" * 100.0 / (SELECT count(*) FROM base WHERE status = '{v}'), 4)::DOUBLE AS \"col_{v}\"" for v in _LV) + " FROM g")
def a6(t):
    return G.crosstab(t.cohort(), "segment", "status", _LV)


@query("a7_continuous_summary", "WITH {COHORT} SELECT region, count(price) AS n, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS sd, " + ", ".join(f"round(quantile_cont(price, {p}), 4) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", round(avg((price < 100000)::INTEGER) * 100, 4) AS below_100000 FROM base GROUP BY 1")
def a7(t):
    return G.continuous_summary(t.cohort(), "region", "price", [100000]).drop("low", "high")


_T = "z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3) + (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / (92160 * v ** 4)"


@query("a7_t_interval", "WITH {COHORT}, g AS (SELECT region, avg(price) AS m, stddev_samp(price) / sqrt(count(price)) AS se, (count(price) - 1)::DOUBLE AS v, 1.959963984540054::DOUBLE AS z FROM base GROUP BY 1), h AS (SELECT region, m, se * (" + _T + ") AS half FROM g) SELECT region, round(m, 4) AS mean, round(m - half, 4) AS low, round(m + half, 4) AS high FROM h")
def a7t(t):
    return G.continuous_summary(t.cohort(), "region", "price", [100000]).select("region", "mean", "low", "high")


@query("a8_value_counts", "SELECT l_shipdate IS NULL AS x, l_returnflag, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6)::DOUBLE AS share FROM lineitem GROUP BY ALL")
def a8(t):
    return G.value_counts(t.lineitem, "l_returnflag").withColumn("x", F.lit(False))


@query("a9_event_summary", "SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last, round(median(event_id), 4) AS median, round(avg((json_extract_string(props, '$.k') IS NOT NULL)::INTEGER), 6) AS filled_k, round(avg((CASE WHEN user_id % 2 = 0 THEN value END IS NOT NULL)::INTEGER), 6) AS filled_value FROM events GROUP BY 1")
def a9(t):
    return G.event_summary(t.events, "event_type", "event_id", {"k": F.get_json_object("props", "$.k"), "value": F.when(F.col("user_id") % 2 == 0, F.col("value"))})


@query("a10_missing_by_vintage", "WITH {SCORED}, x AS (SELECT year, 'special' AS variable, avg((special IS NULL)::INTEGER) AS m FROM scored GROUP BY 1 UNION ALL SELECT year, 'qty', avg((qty IS NULL)::INTEGER) FROM scored GROUP BY 1) SELECT variable, round(min(m), 6) AS low, round(max(m), 6) AS high, round(max(m) - min(m), 6) AS amplitude FROM x GROUP BY 1")
def a10(t):
    return G.missing_by_vintage(t.scored(), "year", ["special", "qty"])


@query("a11_numeric_by_vintage", "WITH {SCORED}, x AS (SELECT year, 'qty' AS variable, qty AS v FROM scored UNION ALL SELECT year, 'price', price FROM scored) SELECT year, variable, count(v) AS n, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS sd, round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max FROM x GROUP BY ALL")
def a11(t):
    return G.numeric_by_vintage(t.scored(), "year", ["qty", "price"])


@query("a12_category_stability", """WITH x AS (SELECT year(o_orderdate)::INTEGER AS year, CASE WHEN year(o_orderdate) % 2 = 0 THEN o_orderpriority ELSE substr(o_orderpriority, 1, 1) END AS c FROM orders), g AS (SELECT year, c, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT c FROM g WHERE year = (SELECT min(year) FROM g))
 SELECT year, count(c) AS levels, round(max(n) / sum(n), 6)::DOUBLE AS dominant_share, count(*) FILTER (WHERE n < 0.01 * t) AS rare_levels, count(*) FILTER (WHERE c NOT IN (SELECT c FROM r)) AS new_levels, (SELECT count(*) FROM r) - count(*) FILTER (WHERE c IN (SELECT c FROM r)) AS gone_levels FROM (SELECT *, sum(n) OVER (PARTITION BY year) AS t FROM g) GROUP BY 1""")
def a12(t):
    x = t.orders.select(F.year("o_orderdate").alias("year"), F.when(F.year("o_orderdate") % 2 == 0, F.col("o_orderpriority")).otherwise(F.substring("o_orderpriority", 1, 1)).alias("c"))
    return G.category_stability(x, "year", "c", x.agg(F.min("year")).first()[0])


_STATE = "CASE WHEN special IS NULL THEN 'MISSING' WHEN special = 99997 THEN '99997' WHEN special = 99998 THEN '99998' ELSE 'REGULAR' END"


@query("a13_special_by_vintage", "WITH {SCORED}, g AS (SELECT " + _STATE + " AS state, year, count(*) AS n, sum(label)::BIGINT AS events FROM scored GROUP BY ALL) SELECT *, round(events / n, 6) AS rate, round(n / sum(n) OVER (PARTITION BY year), 6)::DOUBLE AS share FROM g")
def a13(t):
    from riskloom.functions import features as X

    return G.special_by_vintage(t.scored(), X.special_state(F.col("special"), (99997.0, 99998.0)), "year", "label")


@query("a14_group_index", """WITH c AS (SELECT l_orderkey AS grp, l_returnflag AS v, count(*) AS c FROM lineitem GROUP BY ALL), m AS (SELECT grp, v FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c DESC, v) AS r FROM c) WHERE r = 1)
 SELECT l.grp, l.n, l.first_index, l.last_index, l.total_size, m.v AS mode FROM (SELECT l_orderkey AS grp, count(*)::BIGINT AS n, min(l_linenumber) AS first_index, max(l_linenumber) AS last_index, sum(l_quantity::BIGINT)::BIGINT AS total_size FROM lineitem GROUP BY 1) l JOIN m ON m.grp = l.grp""")
def a14(t):
    return G.group_index(t.lineitem.withColumnRenamed("l_orderkey", "grp"), "grp", "l_linenumber", F.col("l_quantity").cast("long"), "l_returnflag")


@query("a15_instances_to_group", "WITH {SCORED} SELECT grp, round(avg(p), 6) AS prob, round(coalesce(stddev_samp(p), 0), 6) AS prob_sd, count(*) AS n, arg_min(label, key) AS label, round(avg(label), 6) AS positive_rate, (avg(p) >= 0.5)::INTEGER AS predicted FROM scored GROUP BY 1")
def a15(t):
    return G.instances_to_group(t.scored().withColumn("p", F.col("p")), ["grp"], "p", "label", 0.5, "key")


@query("a16_group_sizes", "SELECT l_linestatus, count(*) AS groups, sum(c)::BIGINT AS instances, min(c) AS min_size, round(avg(c), 4) AS mean_size, max(c) AS max_size FROM (SELECT l_linestatus, l_orderkey, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1")
def a16(t):
    return G.group_sizes(t.lineitem, ["l_linestatus"], "l_orderkey")


@query("a17_pivot", "WITH {COHORT} SELECT year, " + ", ".join(f"nullif(count(*) FILTER (WHERE status = '{v}'), 0) AS \"{v}\"" for v in _LV) + " FROM base GROUP BY 1")
def a17(t):
    return G.pivoted(t.cohort(), "year", "status", _LV, F.count(F.lit(1)))


@query("a18_unpivot", "SELECT variable, count(value) AS n, round(sum(value), 0) AS total FROM (SELECT 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_discount', l_discount * 100 FROM lineitem) GROUP BY 1")
def a18(t):
    df = t.lineitem.select("l_quantity", (F.col("l_discount") * 100).alias("l_discount"))
    return G.unpivoted(df, ["l_quantity", "l_discount"], as_text=False).groupBy("variable").agg(F.count("value").alias("n"), F.round(F.sum("value"), 0).alias("total"))


@query("a19_correlations", " UNION ALL ".join(f"SELECT '{a}|{b}' AS pair, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def a19(t):
    return G.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query("a20_ratio_of_sums", "WITH {COHORT} SELECT nation, sum(y)::BIGINT AS num, sum((t IS NOT NULL)::INTEGER)::BIGINT AS den, round(sum(y) / sum((t IS NOT NULL)::INTEGER), 6) AS ratio FROM base GROUP BY 1")
def a20(t):
    return G.ratio_of_sums(t.cohort(), ["nation"], F.col("y"), F.col("t").isNotNull().cast("int"))


@query("a21_compare_two", "WITH {COHORT}, w AS (SELECT year, (count(*) FILTER (WHERE region = 'ASIA'))::DOUBLE AS a, (count(*) FILTER (WHERE region = 'EUROPE'))::DOUBLE AS b FROM base GROUP BY 1) SELECT round(min(a), 4) AS min_a, round(max(a), 4) AS max_a, round(min(b), 4) AS min_b, round(max(b), 4) AS max_b, round(min(abs(a - b)), 4) AS smallest_gap, round(max(abs(a - b)), 4) AS largest_gap, count(*) FILTER (WHERE a > b) AS above, count(*) FILTER (WHERE a < b) AS below FROM w")
def a21(t):
    return G.compare_two(t.cohort(), "year", "region", "ASIA", "EUROPE", F.count(F.lit(1)))


@query("a22_three_keys", "WITH {COHORT} SELECT segment, code, status, count(*) AS n, round(avg(price), 4) AS mean FROM base GROUP BY ALL")
def a22(t):
    return t.cohort().groupBy("segment", "code", "status").agg(F.count("*").alias("n"), G.r(F.avg("price")).alias("mean"))


@query("a23_band_interval", "WITH {SCORED} SELECT least(floor(p * 5), 4)::INTEGER AS band, round(min(p), 6) AS low, round(max(p), 6) AS high, count(*) AS n, round(count(*) / (SELECT count(*) FROM scored), 6)::DOUBLE AS share, round(avg(label), 6) AS rate FROM scored GROUP BY 1")
def a23(t):
    s = t.scored()
    n = s.agg(F.count("*").alias("__n"))
    g = s.groupBy(F.least(F.floor(F.col("p") * 5), F.lit(4)).cast("int").alias("band")).agg(G.r(F.min("p"), 6).alias("low"), G.r(F.max("p"), 6).alias("high"), F.count("*").alias("n"), G.r(F.avg(F.col("label").cast("double")), 6).alias("rate"))
    return g.join(F.broadcast(n)).withColumn("share", G.r(F.col("n") / F.col("__n"), 6)).drop("__n")


@query("a24_missing_by_group", "WITH {COHORT} SELECT variable, y, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS missing, round(count(*) FILTER (WHERE v IS NULL) * 100.0 / count(*), 4)::DOUBLE AS percent FROM (SELECT y, 'cluster' AS variable, cluster::VARCHAR AS v FROM base UNION ALL SELECT y, 't', t::VARCHAR FROM base) GROUP BY ALL")
def a24(t):
    return G.missing_by_group(t.cohort(), ["cluster", "t"], "y")


@query("a25_positivity", "WITH {COHORT}, g AS (SELECT 'segment' AS variable, segment AS value, count(*) AS n, count(*) FILTER (WHERE t = 1) AS n1, count(*) FILTER (WHERE t = 0) AS n0 FROM base GROUP BY 2 UNION ALL SELECT 'region', region, count(*), count(*) FILTER (WHERE t = 1), count(*) FILTER (WHERE t = 0) FROM base GROUP BY 2) SELECT *, round(n1 / (n1 + n0), 6) AS share, n1 / (n1 + n0) <= 0.05 OR n1 / (n1 + n0) >= 0.95 AS near_deterministic, least(n1, n0) < 30 AS small_cell FROM g")
def a25(t):
    return G.positivity(t.cohort(), ["segment", "region"], "t")


@query("a26_risk_decomposition", "WITH {COHORT} SELECT month, count(*) AS n, round(count(*) FILTER (WHERE y = 1) / count(*), 6) AS risk, round(count(*) FILTER (WHERE y = 1 AND price < 100000) / count(*), 6) AS risk_part, round(count(*) FILTER (WHERE y = 1 AND NOT price < 100000) / count(*), 6) AS risk_rest FROM base GROUP BY 1")
def a26(t):
    return G.risk_decomposition(t.cohort(), "month", F.col("y") == 1, F.col("price") < 100000)


@query("a27_selection_table", "WITH {COHORT}, x AS (SELECT CASE WHEN t = 1 THEN 'included' WHEN t = 0 THEN 'late' ELSE 'missing' END AS status, CASE WHEN price < 100000 THEN 'low' WHEN price < 250000 THEN 'mid' END AS band FROM base) SELECT status, coalesce(band, 'DESCONHECIDA') AS band, count(*) AS n FROM x GROUP BY 1, 2 UNION ALL SELECT status, 'SUBTOTAL', count(*) FROM x GROUP BY 1")
def a27(t):
    c = t.cohort().select(F.when(F.col("t") == 1, "included").when(F.col("t") == 0, "late").otherwise("missing").alias("status"), F.when(F.col("price") < 100000, "low").when(F.col("price") < 250000, "mid").alias("band"))
    return G.selection_table(c, "status", "band")


def _pool_sql(f):
    return f"WITH e AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS u(i)), p AS (SELECT label, i, {f}(x) AS x FROM e GROUP BY ALL) SELECT label, array_to_string(list(printf('%.4f', x) ORDER BY i), ',') AS pooled FROM p GROUP BY 1"


def _text(df):
    return df.select("label", F.array_join(F.transform("pooled", lambda x: F.format_string("%.4f", x)), ",").alias("pooled"))


@query("a28_pool_max", _pool_sql("max"))
def a28(t):
    return _text(G.pool_vectors(t.embeddings, "label", "embedding", "max"))


@query("a28_pool_mean", "WITH e AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS u(i)) SELECT label, i - 1 AS pos, round(avg(x), 6) AS x FROM e GROUP BY ALL")
def a28m(t):
    return G.pool_vectors(t.embeddings, "label", "embedding").select("label", F.posexplode("pooled").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("a29_class_weight", "WITH {SCORED} SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 6) AS weight FROM scored")
def a29(t):
    return G.class_weight(t.scored(), "label")


@query("a30_histogram", "WITH {SCORED}, g AS (SELECT label, floor(p / 0.1)::INTEGER AS bin, count(*) AS n, sum(qty) AS w FROM scored GROUP BY ALL) SELECT label, bin, n, round(n * 100.0 / sum(n) OVER (PARTITION BY label), 4)::DOUBLE AS percent_rows, round(w * 100.0 / sum(w) OVER (PARTITION BY label), 4) AS percent_weight FROM g")
def a30(t):
    return G.histogram(t.scored(), "label", "p", 0.1, F.col("qty"))


@query("a31_scalar_summary", "SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey)::DOUBLE FROM orders UNION ALL SELECT 'largest', round(max(o_totalprice), 4) FROM orders UNION ALL SELECT 'median', round(median(o_totalprice), 4) FROM orders")
def a31(t):
    return G.scalar_summary(t.orders, {"rows": F.count("*"), "customers": F.countDistinct("o_custkey"), "largest": F.max("o_totalprice")}, {"median": "o_totalprice"})
