"""Queries of column expressions, bands and bins (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import bands, features as X
from riskloom.plans.base import query

_INF = float("inf")


@query("p1_treatment", "WITH {COHORT} SELECT key, t FROM base")
def p1(t):
    return t.cohort().select("key", X.treatment(F.when(F.col("code") == "4", "99").when(F.col("code") == "5", "05").otherwise(F.col("code"))).alias("t"))


@query("p2_outcome", "WITH {COHORT} SELECT key, CASE WHEN price > 0 THEN (price < 150000)::INTEGER END AS p0, CASE WHEN price BETWEEN 20000 AND 300000 THEN (price < 150000)::INTEGER END AS p1 FROM base")
def p2(t):
    return t.cohort().select("key", X.outcome(F.col("price"), "P0", 150000).alias("p0"), X.outcome(F.col("price"), "P1", 150000, 20000, 300000).alias("p1"))


@query("p3_equals_or_false", "WITH {COHORT} SELECT key, coalesce(cluster = 1, false) AS single FROM base")
def p3(t):
    return t.cohort().select("key", X.equals_or_false(F.col("cluster"), 1).alias("single"))


@query("p4_region_prefix", "SELECT o_orderkey AS key, CASE WHEN regexp_matches(o_orderkey::VARCHAR, '^[0-9]{4}$') THEN substr(o_orderkey::VARCHAR, 1, 2) ELSE 'IGNORADO' END AS region FROM orders")
def p4(t):
    return t.orders.select(F.col("o_orderkey").alias("key"), X.region_prefix(F.col("o_orderkey").cast("string"), 4, 2, X.UNKNOWN).alias("region"))


_CODE = "CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN '09' WHEN o_custkey % 5 = 0 THEN 'x' ELSE '0' || (o_custkey % 6)::VARCHAR END"


def _code():
    c = F.col("o_custkey")
    return F.when(c % 11 == 0, F.lit(None).cast("string")).when(c % 7 == 0, "09").when(c % 5 == 0, "x").otherwise(F.concat(F.lit("0"), (c % 6).cast("string")))


@query("p5_category", f"WITH x AS (SELECT o_orderkey AS key, {_CODE} AS c FROM orders) SELECT key, CASE WHEN c IS NULL OR c = '09' THEN 'IGNORADO' WHEN regexp_matches(c, '^[0-9]+$') THEN (c::INTEGER)::VARCHAR END AS category FROM x")
def p5(t):
    return t.orders.select(F.col("o_orderkey").alias("key"), X.category(_code()).alias("category"))


@query("p6_count_category", f"WITH x AS (SELECT o_orderkey AS key, {_CODE} AS c FROM orders) SELECT key, CASE WHEN c IS NULL OR NOT regexp_matches(c, '^[0-9]+$') THEN 'IGNORADO' WHEN c::INTEGER >= 2 THEN '2_OU_MAIS' ELSE (c::INTEGER)::VARCHAR END AS category FROM x")
def p6(t):
    return t.orders.select(F.col("o_orderkey").alias("key"), X.count_category(_code()).alias("category"))


@query("p7_range_mask", "SELECT p_partkey AS key, CASE WHEN p_size BETWEEN 10 AND 40 THEN p_size END AS size FROM part")
def p7(t):
    return t.part.select(F.col("p_partkey").alias("key"), X.range_mask(F.col("p_size"), 10, 40).alias("size"))


@query("p8_covariates", f"WITH x AS (SELECT o_orderkey AS key, {_CODE} AS c, o_totalprice AS p FROM orders) SELECT key, CASE WHEN c IS NULL OR c = '09' THEN 'IGNORADO' WHEN regexp_matches(c, '^[0-9]+$') THEN (c::INTEGER)::VARCHAR END AS a, CASE WHEN c IS NULL OR NOT regexp_matches(c, '^[0-9]+$') THEN 'IGNORADO' WHEN c::INTEGER >= 2 THEN '2_OU_MAIS' ELSE (c::INTEGER)::VARCHAR END AS b, CASE WHEN p BETWEEN 50000 AND 250000 THEN p END AS v FROM x")
def p8(t):
    return t.orders.select(F.col("o_orderkey").alias("key"), X.category(_code()).alias("a"), X.count_category(_code()).alias("b"), X.range_mask(F.col("o_totalprice"), 50000, 250000).alias("v"))


@query("p9_scenarios", "WITH {COHORT} SELECT 'P0' AS scenario, count(*) AS n FROM base WHERE price > 0 UNION ALL SELECT 'P1', count(*) FROM base WHERE price BETWEEN 20000 AND 300000 UNION ALL SELECT 'not_first', count(*) FROM base WHERE cluster IS DISTINCT FROM 1")
def p9(t):
    c = t.cohort()
    filters = {"P0": F.col("price") > 0, "P1": F.col("price").between(20000, 300000), "not_first": ~F.col("cluster").eqNullSafe(1)}
    parts = [c.where(f).groupBy().agg(F.lit(n).alias("scenario"), F.count("*").alias("n")) for n, f in filters.items()]
    return parts[0].union(parts[1]).union(parts[2]).select("scenario", "n")


@query("p10_merge_levels", "SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'INDUSTRY' ELSE 'OTHER' END AS level, count(*) AS n FROM customer GROUP BY 1")
def p10(t):
    segments = [r[0] for r in t.customer.select("c_mktsegment").distinct().collect()]  # a few levels
    groups = {s: "INDUSTRY" if s in ("BUILDING", "MACHINERY") else "OTHER" for s in segments}
    return t.customer.groupBy(X.merge_levels(F.col("c_mktsegment"), groups).alias("level")).agg(F.count("*").alias("n"))


@query("p11_complete_case", "WITH {COHORT} SELECT key, round((acct / 1000) * (acct / 1000), 4) AS square, cluster IS NOT NULL AND code <> 'IGNORADO' AS complete FROM base")
def p11(t):
    return t.cohort().select("key", F.round((F.col("acct") / 1000) * (F.col("acct") / 1000), 4).alias("square"), X.complete_case(["cluster", "code"]).alias("complete"))


@query("p12_special_state", "WITH {SCORED} SELECT CASE WHEN special IS NULL THEN 'MISSING' WHEN special = 99997 THEN '99997' WHEN special = 99998 THEN '99998' ELSE 'REGULAR' END AS state, count(*) AS n FROM scored GROUP BY 1")
def p12(t):
    return t.scored().groupBy(X.special_state(F.col("special"), (99997.0, 99998.0)).alias("state")).agg(F.count("*").alias("n"))


@query("p13_special_mask", "WITH {SCORED} SELECT coalesce(linestatus, '__MISSING__') AS status, count(CASE WHEN special NOT IN (99997, 99998) THEN 1 END) AS regular, count(*) FILTER (WHERE special = 99997) AS a, count(*) FILTER (WHERE special = 99998) AS b, count(*) FILTER (WHERE special IS NULL) AS missing FROM scored GROUP BY 1")
def p13(t):
    d = X.special_indicators(t.scored(), "special", (99997.0, 99998.0)).withColumn("masked", X.mask_special(F.col("special"), (99997.0, 99998.0)))
    return d.groupBy(X.categorical_text(F.col("linestatus")).alias("status")).agg(F.count("masked").alias("regular"), F.sum("special_is_99997").alias("a"), F.sum("special_is_99998").alias("b"), F.sum("special_is_missing").alias("missing"))


@query("p14_guarded_ratio", "SELECT o_orderkey AS key, round(CASE WHEN c_acctbal > 0 THEN o_totalprice / c_acctbal END, 4) AS ratio, round(date_diff('day', o_orderdate::DATE, DATE '2024-01-01') / 365.25::DOUBLE, 6) AS years FROM orders JOIN customer ON o_custkey = c_custkey")
def p14(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("o_orderkey").alias("key"), F.round(X.guarded_ratio(F.col("o_totalprice"), F.col("c_acctbal")), 4).alias("ratio"), F.round(X.years_between(F.lit("2024-01-01").cast("date"), F.col("o_orderdate").cast("date")), 6).alias("years"))


@query("p15_text_and_id", "SELECT o_custkey::VARCHAR || '_' || strftime(o_orderdate, '%Y%m%d') AS op, coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN trim(o_orderpriority || '  ') END, 'Não informado') AS txt FROM orders")
def p15(t):
    text = F.when(F.col("o_orderkey") % 9 != 0, F.concat("o_orderpriority", F.lit("  ")))
    return t.orders.select(X.operation_id(F.col("o_custkey"), F.col("o_orderdate")).alias("op"), X.clean_text(text).alias("txt"))


@query("p16_month_end_after", "SELECT o_orderkey AS key, strftime(last_day(o_orderdate::DATE + INTERVAL 12 MONTH), '%Y-%m-%d') AS month12 FROM orders")
def p16(t):
    return t.orders.select(F.col("o_orderkey").alias("key"), F.date_format(X.month_end_after(F.col("o_orderdate").cast("date")), "yyyy-MM-dd").alias("month12"))


@query("p17_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first, count(*) AS n FROM orders GROUP BY ALL")
def p17(t):
    parsed = X.parse_month(F.date_format("o_orderdate", "yyyyMM").cast("int"))
    return t.orders.groupBy(X.month_of(F.col("o_orderdate")).alias("month"), F.date_format(parsed, "yyyy-MM-dd").alias("first")).agg(F.count("*").alias("n"))


@query("p18_fixed_bands", "SELECT CASE WHEN p_size <= 10 THEN 'ate 10' WHEN p_size <= 30 THEN '11-30' WHEN p_size <= 45 THEN '31-45' ELSE 'IGNORADO' END AS band, count(*) AS n FROM part GROUP BY 1")
def p18(t):
    return t.part.groupBy(X.bands(F.col("p_size"), [-_INF, 10, 30, 45], ["ate 10", "11-30", "31-45"]).alias("band")).agg(F.count("*").alias("n"))


_EDGES = "q AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM lineitem)"


@query("p19_quantile_bands", f"WITH {_EDGES} SELECT (SELECT min(i) - 1 FROM unnest(range(2, len(e) + 1)) AS u(i) WHERE l_quantity <= e[i])::INTEGER AS band, count(*) AS n FROM lineitem, q GROUP BY 1")
def p19(t):
    return bands.quantile_bands(t.lineitem, "l_quantity", 5).groupBy("band").agg(F.count("*").alias("n"))


@query("p20_rank_bins", "WITH {SCORED}, r AS (SELECT p, row_number() OVER (ORDER BY p, key) AS r, count(*) OVER () AS n FROM scored) SELECT greatest(1, ceil((r - 1) * 7 / (n - 1)::DOUBLE))::INTEGER AS bin, count(*) AS n, min(p) AS low, max(p) AS high FROM r GROUP BY 1")
def p20(t):
    return bands.rank_bins(t.scored(), "p", "key", 7).groupBy("bin").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))


_PAYLOAD = "CASE WHEN event_id % 3 = 0 THEN '{\"offer id\": \"o' || (user_id % 5) || '\"}' WHEN event_id % 3 = 1 THEN '{\"offer_id\": \"o' || (user_id % 5) || '\", \"reward\": 2}' ELSE '{\"amount\": ' || round(value, 2) || '}' END"


def _payload():
    e, o = F.col("event_id"), F.concat(F.lit("o"), (F.col("user_id") % 5).cast("string"))
    return F.when(e % 3 == 0, F.concat(F.lit('{"offer id": "'), o, F.lit('"}'))).when(e % 3 == 1, F.concat(F.lit('{"offer_id": "'), o, F.lit('", "reward": 2}'))).otherwise(F.concat(F.lit('{"amount": '), F.round("value", 2).cast("string"), F.lit("}")))


@query("p21_payload", f"WITH x AS (SELECT event_id, {_PAYLOAD} AS p FROM events) SELECT event_id, coalesce(json_extract_string(p, '$.\"offer id\"'), json_extract_string(p, '$.offer_id')) AS offer_id, round(json_extract_string(p, '$.amount')::DOUBLE, 2) AS amount, json_extract_string(p, '$.reward')::BIGINT AS reward FROM x")
def p21(t):
    e = t.events.select("event_id", _payload().alias("p"))
    return e.select("event_id", X.payload_value(F.col("p"), "offer id", "offer_id").alias("offer_id"), F.round(X.payload_value(F.col("p"), "amount").try_cast("double"), 2).alias("amount"), X.payload_value(F.col("p"), "reward").try_cast("long").alias("reward"))


@query("p22_key_signature", f"WITH x AS (SELECT {_PAYLOAD} AS p FROM events) SELECT array_to_string(list_sort(json_keys(p)), ',') AS signature, count(*) AS n FROM x GROUP BY 1")
def p22(t):
    return t.events.groupBy(X.key_signature(_payload()).alias("signature")).agg(F.count("*").alias("n"))


@query("p23_dashed_id", "WITH x AS (SELECT o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') || '-' || o_custkey AS s FROM orders) SELECT key, array_to_string(string_split(s, '-')[1:3], '-') AS grp, string_split(s, '-')[4]::INTEGER AS idx FROM x")
def p23(t):
    group, index = X.dashed_id(F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_custkey"))
    return t.orders.select(F.col("o_orderkey").alias("key"), group.alias("grp"), index.alias("idx"))


@query("p24_loose_parsing", "SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'true' WHEN o_orderstatus = 'O' THEN 'false' ELSE '?' END AS flag, (o_orderkey % 5000 + 1000)::DOUBLE + 0.5 AS number, (o_orderkey % 5000 + 1000)::BIGINT AS n, 5.5::DOUBLE AS pct FROM orders")
def p24(t):
    k = F.col("o_orderkey") % 5000 + 1000
    dotted = F.concat(F.floor(k / 1000).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"))
    n, pct = X.count_and_percent(F.concat(dotted, F.lit(" (5,5%)")))
    flag = X.yes_no(F.when(F.col("o_orderstatus") == "F", " Sim ").when(F.col("o_orderstatus") == "O", "não").otherwise("?"))
    return t.orders.select(F.col("o_orderkey").alias("key"), F.coalesce(flag.cast("string"), F.lit("?")).alias("flag"), X.local_number(F.concat(dotted, F.lit(",5"))).alias("number"), n.alias("n"), pct.alias("pct"))


@query("p25_find_column", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def p25(t):
    return t.orders.groupBy(F.col(X.find_column(t.orders, "O_ORDERSTATUS")).alias("status")).agg(F.count("*").alias("n"))


@query("p26_outcome_tag", "WITH {SCORED} SELECT CASE WHEN label = 1 THEN CASE WHEN p >= 0.5 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN p >= 0.5 THEN 'FP' ELSE 'TN' END END AS tag, count(*) AS n FROM scored GROUP BY 1")
def p26(t):
    return t.scored().groupBy(X.outcome_tag(F.col("label"), (F.col("p") >= 0.5).cast("int")).alias("tag")).agg(F.count("*").alias("n"))


@query("p27_filter_mixed", "SELECT l_orderkey AS grp, count(*) AS n, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'mixed' ELSE min(l_returnflag) END AS label FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def p27(t):
    g = t.lineitem.where(F.col("l_linestatus") == "O").groupBy(F.col("l_orderkey").alias("grp"))
    return g.agg(F.count("*").alias("n"), F.when(F.countDistinct("l_returnflag") > 1, "mixed").otherwise(F.min("l_returnflag")).alias("label"))


@query("p28_feature_prep", """WITH {COHORT}, x AS (SELECT key, CASE WHEN key % 10 <> 0 THEN acct END AS a, segment FROM base), m AS (SELECT quantile_cont(a, 0.5) AS med FROM x), f AS (SELECT key, coalesce(a, med) AS v, (a IS NULL)::INTEGER::DOUBLE AS missing, segment FROM x, m)
 SELECT key, round((v - (SELECT avg(v) FROM f)) / (SELECT stddev_pop(v) FROM f), 6) AS z, missing, (segment = (SELECT min(segment) FROM f))::INTEGER::DOUBLE AS first_level FROM f""")
def p28(t):
    c = t.cohort().withColumn("a", F.when(F.col("key") % 10 != 0, F.col("acct")))
    d, names = X.standardised(c, ["a"], ["segment"])
    return d.select("key", F.round("a_z", 6).alias("z"), F.col("a_missing").alias("missing"), F.col(f"`{sorted(n for n in names if n.startswith('segment='))[0]}`").alias("first_level"))


@query("p29_complete_rows", f"WITH x AS (SELECT o_orderkey AS key, {_CODE} AS c FROM orders) SELECT key, c::INTEGER AS c FROM x WHERE c IS NOT NULL AND c <> 'x'")
def p29(t):
    return t.orders.select(F.col("o_orderkey").alias("key"), X.integer_code(_code()).alias("c")).dropna(subset=["c"])
