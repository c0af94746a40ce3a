"""Queries of sources, contracts and audits (S, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import audit as A
from riskloom.plans.base import query
from riskloom.sources import io
from riskloom.sources.staging import new_path


def _statuses():
    price = F.floor("price").cast("long").cast("string")
    return {"code": A.code_status(F.col("code"), valid=(1, 2, 3, 5), ignored=(4,)), "price": A.code_status(price, low=1000, high=300000)}


_STATUS_SQL = """CASE WHEN code IS NULL OR trim(code) = '' THEN 'ausente' WHEN code = '4' THEN 'ignorado' WHEN NOT regexp_matches(code, '^[0-9]+$') THEN 'invalido' WHEN code NOT IN ('1','2','3','5') THEN 'invalido' ELSE 'valido' END AS s_code,
 CASE WHEN price IS NULL THEN 'ausente' WHEN floor(price) < 0 THEN 'invalido' WHEN floor(price) < 1000 OR floor(price) > 300000 THEN 'fora_faixa' ELSE 'valido' END AS s_price"""


@query("flagship_territory_quality", "WITH {COHORT}, s AS (SELECT *, " + _STATUS_SQL + """ FROM base), x AS (SELECT region, 'code' AS field, s_code AS st FROM s UNION ALL SELECT region, 'price', s_price FROM s),
 g AS (SELECT CASE WHEN grouping(region) = 1 THEN 'TOTAL' ELSE region END AS territory, field, count(*) AS n, count(*) FILTER (WHERE st <> 'ausente') AS filled, count(*) FILTER (WHERE st = 'ausente') AS a1, count(*) FILTER (WHERE st = 'ignorado') AS a2,
 count(*) FILTER (WHERE st = 'invalido') AS a3, count(*) FILTER (WHERE st = 'fora_faixa') AS a4, count(*) FILTER (WHERE st = 'nao_confirmado') AS a5, count(*) FILTER (WHERE st = 'valido') AS a6 FROM x GROUP BY GROUPING SETS ((region, field), (field))),
 l AS (SELECT territory, n, field, filled, unnest(['ausente','ignorado','invalido','fora_faixa','nao_confirmado','valido']) AS status, unnest([a1,a2,a3,a4,a5,a6]) AS count FROM g)
 SELECT territory, n, field, status, count, filled, round(count * 100.0 / n, 4)::DOUBLE AS percent FROM l""")
def flagship(t):
    return A.status_counts(t.cohort(), _statuses(), "region")




@query("s1_text_csv", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def s1(t):
    path = _scratch(t, "csv")
    t.nation.select(F.col("n_nationkey").cast("string"), "n_name", "n_regionkey").write.csv(path, header=True, sep=";")
    return io.read_text_csv(t.spark, path, ["n_nationkey", "n_name"])


@query("s2_text_rows", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def s2b(t):
    source, target = _scratch(t, "csv"), _scratch(t, "zstd")
    t.customer.write.csv(source, header=True, sep=";")
    return io.csv_to_parquet(t.spark, source, target, ["c_custkey", "c_name"]).select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")


@query("s2_csv_to_parquet", "SELECT COLUMNS(*)::VARCHAR FROM customer")
def s2(t):
    source, target = _scratch(t, "csv"), _scratch(t, "zstd")
    t.customer.write.csv(source, header=True, sep=";")
    return io.csv_to_parquet(t.spark, source, target, ["c_custkey", "c_name"])


@query("s3_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def s3(t):
    return io.read_parquet(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], F.col("l_quantity") > 45)


@query("s4_typed_csv", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def s4(t):
    path = _scratch(t, "csv")
    t.orders.select("o_orderkey", F.date_format("o_orderdate", "ddMMyyyy").alias("day")).write.csv(path, header=True)
    return io.read_typed_csv(t.spark, path, "o_orderkey long, day string", {"day": "ddMMyyyy"}).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("s5_json_lines", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s5(t):
    path = _scratch(t, "json")
    t.events.select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("value"), F.array("event_type").alias("channels")).write.json(path)
    df = io.read_json_lines(t.spark, path, "event_id long, event_type string, value map<string,string>, channels array<string>")
    return df.select("event_id", F.col("channels")[0].alias("event_type"), F.try_element_at("value", F.lit("k")).cast("long").alias("k"))


@query("s6_yearly_union", "SELECT year(o_orderdate)::INTEGER AS ano, count(*) AS n, count(CASE WHEN year(o_orderdate) % 2 = 0 THEN o_orderpriority END) AS with_priority FROM orders GROUP BY 1")
def s6(t):
    o = t.orders
    years = sorted(r[0] for r in o.select(F.year("o_orderdate")).distinct().collect())  # a few years
    parts = {y: (o if y % 2 == 0 else o.drop("o_orderpriority")).where(F.year("o_orderdate") == y) for y in years}
    return io.union_years(parts).groupBy("ano").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("with_priority"))


@query("s7_table_sinks", "SELECT r_regionkey, r_name, n_nationkey, n_name, n_regionkey FROM region JOIN nation ON r_regionkey = n_regionkey")
def s7(t):
    folder = _scratch(t, "tables")
    io.write_tables({"region": t.region}, folder)
    io.write_tables({"nation": t.nation}, folder, "csv")
    return t.spark.read.parquet(f"{folder}/region").join(t.spark.read.csv(f"{folder}/nation", header=True, inferSchema=True), F.col("r_regionkey") == F.col("n_regionkey"))


@query("s8_metrics_json", "SELECT json_object('l_returnflag', l_returnflag, 'mean', round(avg(l_discount), 6), 'top', CASE WHEN l_returnflag <> 'A' THEN round(max(l_tax), 6) END)::VARCHAR AS value FROM lineitem GROUP BY l_returnflag")
def s8(t):
    m = t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.when(F.col("l_returnflag") == "A", float("nan")).otherwise(F.round(F.max("l_tax"), 6)).alias("top"))
    return io.metrics_json(m)


@query("s9_upsert", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS source FROM nation")
def s9(t):
    old = t.nation.select("n_nationkey", F.lit("old").alias("source"))
    return io.upsert(old, t.nation.where("n_regionkey = 1").select("n_nationkey", F.lit("new").alias("source")), ["n_nationkey"])


@query("s10_counted_inventory", """SELECT year(o_orderdate)::INTEGER AS ano, true AS available, CASE WHEN year(o_orderdate) % 2 = 0 THEN 3 ELSE 2 END AS n_columns, CASE WHEN year(o_orderdate) % 2 = 0 THEN '' ELSE 'O_ORDERPRIORITY' END AS missing_fields, true AS case_normalised, count(*) AS n_rows FROM orders GROUP BY year(o_orderdate)
 UNION ALL SELECT max(year(o_orderdate))::INTEGER + 1, false, NULL, NULL, NULL, NULL FROM orders""")
def s10b(t):
    """A folder for each year of the orders, odd ones without a column, and a year that isn't there."""
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("year"))
    folder = _scratch(t, "years")
    o.where("year % 2 = 0").write.partitionBy("year").parquet(folder)
    o.where("year % 2 <> 0").drop("o_orderpriority").write.mode("append").partitionBy("year").parquet(folder)
    years = sorted(x[0] for x in o.select("year").distinct().collect())  # a few years
    return io.inventory(t.spark, {y: f"{folder}/year={y}" for y in (*years, years[-1] + 1)}, ["O_ORDERKEY", "O_ORDERPRIORITY"], count_rows=True)


@query("s10_inventory")
def s10(t):
    return io.inventory(t.spark, {1: f"{t.sf_dir}/orders.parquet", 2: f"{t.sf_dir}/lineitem.parquet", 3: f"{t.sf_dir}/none.parquet"}, ["O_ORDERKEY", "L_TAX"])


@query("s11_split_export", "WITH {LOANS} SELECT CASE WHEN has_window THEN 'with_window' ELSE 'without_window' END AS split, count(*) AS n FROM lab GROUP BY 1")
def s11(t):
    from riskloom.operators import joins

    path = _scratch(t, "split")
    io.write_split(io.split_export(joins.label_12m(t.loans(), t.performance(), "cust"), F.col("has_window")), path)
    return t.spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"))


def _scratch(t, label: str) -> str:
    """A fresh path in the session's shared folder."""
    return new_path(t.spark, label)


@query("v1_required_columns", "SELECT count(*) AS n FROM orders")
def v1(t):
    return A.require_columns(t.orders, ["o_orderkey", "o_custkey"]).agg(F.count("*").alias("n"))


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("v2_field_diff", " UNION ALL ".join(f"SELECT '{c.upper()}' AS field, '{'missing' if c == 'o_orderstatus' else 'case' if c == 'o_custkey' else 'same'}' AS status, {'NULL::BIGINT' if c == 'o_orderstatus' else f'count(CASE WHEN o_orderkey % 3 <> 0 THEN {c} END)' if c == 'o_totalprice' else f'count({c})'} AS filled, count({c}) AS filled_reference FROM orders" for c in _ORDERS) + " UNION ALL SELECT 'YEAR', 'extra', count(year(o_orderdate)), NULL FROM orders")
def v2b(t):
    o = t.orders.select(*_ORDERS)
    a = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))).withColumnRenamed("o_custkey", "O_CUSTKEY").drop("o_orderstatus")
    return A.field_diff(a.withColumn("year", F.year("o_orderdate")), o)


@query("v2_schema_diff")
def v2(t):
    return A.schema_diff(t.orders.withColumnRenamed("o_custkey", "O_CUSTKEY").drop("o_orderstatus"), t.orders)


@query("v3_filled_availability", """WITH {COHORT}, g AS (SELECT year, count(CASE WHEN year <> 1994 THEN t END) > 0 AS early, count(y) > 0 AS y, count(cluster) > 0 AS cluster, count(CASE WHEN year >= 1996 THEN status END) > 0 AS late FROM base GROUP BY 1),
 r AS (SELECT year AS ano, 'treatment' AS role, early::INTEGER AS n_present, 1 AS n_fields, CASE WHEN early THEN '' ELSE 'early' END AS missing FROM g UNION ALL SELECT year, 'outcome', y::INTEGER, 1, CASE WHEN y THEN '' ELSE 'y' END FROM g
  UNION ALL SELECT year, 'covariates', cluster::INTEGER + late::INTEGER, 2, array_to_string(list_filter([CASE WHEN NOT cluster THEN 'cluster' END, CASE WHEN NOT late THEN 'late' END], lambda x: x IS NOT NULL), ',') FROM g)
 SELECT r.*, CASE WHEN NOT (early AND y) THEN 'excluded' WHEN early AND y AND cluster AND late THEN 'full' ELSE 'partial' END AS admission FROM r JOIN g ON r.ano = g.year""")
def v3b(t):
    c = t.cohort().withColumn("early", F.when(F.col("year") != 1994, F.col("t"))).withColumn("late", F.when(F.col("year") >= 1996, F.col("status")))
    table = A.filled_availability(c, "year", {"treatment": ["early"], "outcome": ["y"], "covariates": ["cluster", "late"]})
    return table.join(A.admission(table), "ano")


@query("v3_availability")
def v3(t):
    present = {2020: t.orders.columns, 2021: t.orders.drop("o_orderpriority").columns, 2022: t.orders.drop("o_orderstatus").columns}
    table = A.availability(t.spark, present, {"treatment": ["o_orderkey"], "outcome": ["o_orderstatus"], "covariates": ["o_orderpriority", "o_totalprice"]})
    return table.join(A.admission(table), "ano")


@query("v4_fingerprint")
def v4(t):
    return A.fingerprint(t.orders, ["o_orderkey"])


@query("v4_key_digest", r"SELECT count(*) AS n, sum(('0x' || substr(sha256(o_orderkey || chr(9) || coalesce(o_orderstatus, '\N')), 1, 15))::BIGINT)::VARCHAR AS digest_sum FROM orders")
def v4b(t):
    return A.key_digest(t.orders, ["o_orderkey", "o_orderstatus"])


@query("v5_key_check", "SELECT count(*) AS n, count(*) FILTER (WHERE o_custkey IS NULL) AS null_keys, count(DISTINCT o_custkey) AS distinct_keys, count(*) - count(*) FILTER (WHERE o_custkey IS NULL) - count(DISTINCT o_custkey) AS duplicate_keys FROM orders")
def v5(t):
    return A.key_check(t.orders, "o_custkey")


@query("v6_date_check", "WITH d AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders) SELECT count(*) AS n, count(*) FILTER (WHERE d IS NULL) AS unparseable, count(*) FILTER (WHERE year(d) <> 1998) AS out_of_year, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last FROM d")
def v6(t):
    return A.date_check(t.orders, F.when(F.col("o_orderkey") % 50 == 0, "99999999").otherwise(F.date_format("o_orderdate", "ddMMyyyy")), "ddMMyyyy", 1998)


@query("v7_code_status", "WITH {COHORT}, s AS (SELECT " + _STATUS_SQL + " FROM base) SELECT s_code AS status, count(*) AS n FROM s GROUP BY 1")
def v7(t):
    return t.cohort().groupBy(_statuses()["code"].alias("status")).agg(F.count("*").alias("n"))


@query("v9_reconcile", "WITH {COHORT} SELECT region, count(*)::BIGINT AS parts, count(*) AS whole, true AS ok FROM base GROUP BY region")
def v9(t):
    c = t.cohort()
    whole = c.groupBy("region").agg(F.count("*").alias("whole"))
    return A.reconcile(c.groupBy("region", "code").agg(F.count("*").alias("n")).join(whole, "region"), ["region"], "n", "whole")


def _profile_sql(table, cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS field, '{k}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 4)::DOUBLE AS null_percent, count(DISTINCT {c}) AS \"distinct\" FROM {table}" for c, k in cols)


_ORDER_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
_NO_PROFILE = "".join(f" UNION ALL SELECT '{f}', NULL, NULL, NULL, NULL, '{r}'" for f, r in (("MESPRENAT", "treatment"), ("PESO", "outcome"), ("IDADEMAE", "covariate")))


@query("v10_roles", "WITH p AS (" + _profile_sql("orders", _ORDER_TYPES) + ") SELECT *, 'covariate' AS role FROM p" + _NO_PROFILE)
def v10(t):
    rows = [(c, A.role_of(c)) for c in ("MESPRENAT", "PESO", "IDADEMAE", *A.guard_predictors(t.orders.columns))]
    return A.profile(t.orders).join(t.spark.createDataFrame(rows, "field string, role string"), "field", "right")


@query("v11_profile", _profile_sql("customer", [("c_custkey", "bigint"), ("c_mktsegment", "string"), ("c_acctbal", "double")]))
def v11(t):
    return A.profile(t.customer, ["c_custkey", "c_mktsegment", "c_acctbal"])


@query("v12_duplicate_rows", "WITH c AS (SELECT count(*) AS c FROM events GROUP BY event_type, user_id % 50, props) SELECT coalesce(sum(c - 1), 0)::BIGINT AS duplicates, count(*) FILTER (WHERE c > 1) AS repeated_groups FROM c")
def v12(t):
    e = t.events.select("event_type", (F.col("user_id") % 50).alias("u"), F.from_json("props", "map<string,string>").alias("props"))
    return A.duplicate_rows(e, ["props"])


@query("v13_granularity", "SELECT c AS rows_per_key, count(*) AS keys FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey) GROUP BY 1")
def v13(t):
    return A.granularity(t.orders, ["o_custkey"])


@query("v14_rule_counts", "SELECT 'negative_balance' AS rule, count(*) FILTER (WHERE c_acctbal < 0) AS count, round(count(*) FILTER (WHERE c_acctbal < 0) * 100.0 / count(*), 4)::DOUBLE AS percent FROM customer UNION ALL SELECT 'high_balance', count(*) FILTER (WHERE c_acctbal > 9000), round(count(*) FILTER (WHERE c_acctbal > 9000) * 100.0 / count(*), 4)::DOUBLE FROM customer")
def v14(t):
    return A.rule_counts(t.customer, {"negative_balance": F.col("c_acctbal") < 0, "high_balance": F.col("c_acctbal") > 9000})


def _describe_sql(table, c):
    ps = ", ".join(f"round(quantile_cont({c}, {p}), 4)::DOUBLE AS p{int(p * 100):02d}" for p in A.PERCENTILES)
    return f"SELECT '{c}' AS field, count({c}) AS n, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 4)::DOUBLE AS missing_percent, count(DISTINCT {c}) AS \"distinct\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(min({c}), 4)::DOUBLE AS min, round(max({c}), 4)::DOUBLE AS max, {ps} FROM {table}"


@query("v15_describe", _describe_sql("lineitem", "l_extendedprice") + " UNION ALL " + _describe_sql("lineitem", "l_quantity"))
def v15(t):
    return A.describe(t.lineitem, ["l_extendedprice", "l_quantity"])


@query("v16_date_ranges", "SELECT 'l_shipdate' AS field, count(*) FILTER (WHERE l_shipdate IS NULL) AS nulls, strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last FROM lineitem")
def v16(t):
    return A.date_ranges(t.lineitem, ["l_shipdate"])


@query("v17_key_overlap", "WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k) SELECT count(x) AS in_a, count(y) AS in_b, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS both, count(*) FILTER (WHERE y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b, round(count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) * 100.0 / count(x), 4)::DOUBLE AS coverage_percent FROM j")
def v17(t):
    return A.key_overlap(t.customer, t.orders, "c_custkey", "o_custkey")


@query("v18_event_rules", "SELECT 'value' AS rule, count(*) FILTER (WHERE event_type = (SELECT min(event_type) FROM events)) AS rows, count(*) FILTER (WHERE event_type = (SELECT min(event_type) FROM events) AND NOT coalesce(value > 0, false)) AS failures, count(*) FILTER (WHERE event_type = (SELECT min(event_type) FROM events) AND NOT coalesce(value > 0, false)) = 0 AS ok FROM events UNION ALL SELECT 'payload', count(*), count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL), count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) = 0 FROM events")
def v18(t):
    first = t.events.agg(F.min("event_type")).first()[0]
    return A.all_hold(t.events, {"value": (F.col("event_type") == first, F.col("value") > 0), "payload": (F.lit(True), F.get_json_object("props", "$.k").isNotNull())})


@query("v19_missing_months", "WITH m AS (SELECT DISTINCT date_trunc('quarter', o_orderdate) AS m FROM orders) SELECT strftime(x, '%Y-%m') AS month FROM (SELECT unnest(generate_series((SELECT min(m) FROM m)::TIMESTAMP, (SELECT max(m) FROM m)::TIMESTAMP, INTERVAL 1 MONTH)) AS x) WHERE x NOT IN (SELECT m FROM m)")
def v19(t):
    """Orders booked by quarter: the months between are missing."""
    return A.missing_months(t.orders.withColumn("d", F.trunc("o_orderdate", "quarter")), "d")


@query("v20_out_of_order", "WITH x AS (SELECT o_orderdate < lag(o_orderdate) OVER (ORDER BY o_orderkey) AS inv FROM orders) SELECT count(*) FILTER (WHERE inv) AS inversions, count(*) FILTER (WHERE inv) = 0 AS chronological FROM x")
def v20(t):
    return A.out_of_order(t.orders, "o_orderkey", "o_orderdate", F.floor(F.col("o_orderkey") / 1000))


@query("v21_near_constant", " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) AS levels, round(max(n) / sum(n), 6)::DOUBLE AS top_share, count(*) = 1 AS constant, max(n) / sum(n) >= 0.99 AS near_constant FROM (SELECT {e} AS v, count(*) AS n FROM lineitem GROUP BY 1)" for c, e in (("l_returnflag", "l_returnflag"), ("one", "1"), ("rare", "l_partkey % 500 = 0"))))
def v21(t):
    return A.near_constant(t.lineitem.select("l_returnflag", F.lit(1).alias("one"), (F.col("l_partkey") % 500 == 0).alias("rare")), ["l_returnflag", "one", "rare"])


@query("v22_leakage_alarms", """WITH {SCORED}, x AS (SELECT *, label + qty / 1000.0 AS leak FROM scored)
 SELECT 'leak' AS variable, 'correlation' AS alarm, '' AS level, round(corr(leak, label), 6) AS value FROM x HAVING abs(corr(leak, label)) >= 0.8
 UNION ALL SELECT 'qty', 'correlation', '', round(corr(qty, label), 6) FROM x HAVING abs(corr(qty, label)) >= 0.8
 UNION ALL SELECT 'flag', 'category', flag, round(avg(label), 6) FROM x GROUP BY flag HAVING count(*) >= 100 AND (avg(label) <= 0.005 OR avg(label) >= 0.995)
 UNION ALL SELECT 'linestatus', 'category', linestatus, round(avg(label), 6) FROM x GROUP BY linestatus HAVING count(*) >= 100 AND (avg(label) <= 0.005 OR avg(label) >= 0.995)""")
def v22(t):
    return A.leakage_alarms(t.scored().withColumn("leak", F.col("label") + F.col("qty") / 1000.0), "label", ["leak", "qty"], ["flag", "linestatus"], {"special": (99997.0, 99998.0)})


@query("v23_categorical", """WITH c AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1) SELECT 'c_mktsegment' AS variable, count(v) AS levels, coalesce(sum(n) FILTER (WHERE v IS NULL), 0)::BIGINT AS missing,
 (SELECT v FROM c WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 1) AS dominant, round((SELECT max(n) FROM c WHERE v IS NOT NULL) / sum(n), 6)::DOUBLE AS dominant_share, count(*) FILTER (WHERE n < 0.01 * (SELECT sum(n) FROM c)) AS rare_levels,
 (SELECT string_agg(v || ':' || n, '; ' ORDER BY n DESC, v) FROM (SELECT * FROM c WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 5)) AS top FROM c""")
def v23(t):
    return A.categorical_diagnosis(t.customer, ["c_mktsegment"])


@query("v24_special_codes", "WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) FILTER (WHERE special = {c}) AS n, round(count(*) FILTER (WHERE special = {c}) / count(*), 6)::DOUBLE AS share, count(DISTINCT CASE WHEN special = {c} THEN vintage END) AS vintages, round(avg(label) FILTER (WHERE special = {c}), 6) AS rate_with, round(avg(label) FILTER (WHERE special <> {c} OR special IS NULL), 6) AS rate_without, round(round(avg(label) FILTER (WHERE special = {c}), 6) - round(avg(label) FILTER (WHERE special <> {c} OR special IS NULL), 6), 6) AS difference FROM scored" for c in (99997, 99998)))
def v24(t):
    return A.special_codes(t.scored(), "special", (99997.0, 99998.0), "label", "vintage")


@query("v25_vintage_contract", "WITH {SCORED} SELECT count(*) = count(DISTINCT key) AS one_row_per_id, bool_and(label IN (0, 1)) AS binary_target, count(DISTINCT vintage) AS vintages, min(vintage) AS first, max(vintage) AS last FROM scored")
def v25(t):
    return A.vintage_contract(t.scored(), "key", "label", "vintage")


@query("v26_cross_field", """WITH {COHORT}, x AS (SELECT CASE WHEN status = 'F' THEN 'baixo' WHEN status = 'O' THEN 'alto' END AS a, CASE WHEN price <= 100000 THEN 'baixo' ELSE 'alto' END AS b, CASE WHEN code <> '4' THEN code END AS n FROM base)
 SELECT count(a) AS code_filled, count(b) AS band_filled, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (WHERE a <> b) AS disagree, count(*) FILTER (WHERE n IS NULL) AS not_numeric FROM x""")
def v26(t):
    c = t.cohort()
    return A.cross_field(c, F.when(F.col("status") == "F", "baixo").when(F.col("status") == "O", "alto"), F.when(F.col("price") <= 100000, "baixo").otherwise("alto"), F.when(F.col("code") != "4", F.col("code")))


@query("v27_mixed_groups", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_l_returnflag, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS l_returnflag_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def v27(t):
    return A.mixed_groups(t.lineitem, "l_orderkey", ["l_returnflag"])


@query("v28_split_leaks", "WITH s AS (SELECT DISTINCT l_suppkey, ['test','train','val'][(l_partkey % 3 + 1)::INTEGER] AS sp FROM lineitem) SELECT x.sp AS a, y.sp AS b, count(*) AS shared_groups FROM s x JOIN s y ON x.l_suppkey = y.l_suppkey AND x.sp < y.sp GROUP BY 1, 2")
def v28(t):
    s = F.element_at(F.array(F.lit("test"), F.lit("train"), F.lit("val")), (F.col("l_partkey") % 3 + 1).cast("int"))
    return A.split_leaks(t.lineitem.withColumn("sp", s), "l_suppkey", "sp")


@query("v29_exact_duplicates", "WITH h AS (SELECT doc_id, md5(text) AS digest FROM documents), s AS (SELECT digest, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, digest, copies FROM h JOIN s USING (digest)")
def v29(t):
    return A.exact_duplicates(t.documents, "doc_id", "text")


@query("v30_array_audit", "WITH e AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), m AS (SELECT label, list_avg(x) AS mean, list_min(x) AS lo, list_max(x) AS hi, list_stddev_pop(x) AS sd FROM e) SELECT label, count(*) AS items, count(*) FILTER (WHERE mean IS NULL) AS unreadable, round(avg(mean), 5) AS mean, round(avg(sd), 5) AS sd, round(min(lo), 5) AS min, round(max(hi), 5) AS max FROM m GROUP BY 1")
def v30(t):
    return A.array_audit(t.embeddings, "vec_id", "embedding", "label")


@query("v31_input_guard", "WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (WHERE p IS NULL) AS not_finite, count(*) FILTER (WHERE p < 0 OR p > 1) AS out_of_range, count(*) FILTER (WHERE label NOT IN (0, 1)) AS bad_labels, count(DISTINCT label) AS classes, count(*) - count(DISTINCT key) AS repeated_keys FROM scored")
def v31(t):
    return A.input_guard(t.scored(), "p", "label", "key")
