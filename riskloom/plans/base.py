"""The given tables, the analogues built on them, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads the table; the analogues of the cohort, the loans and the scores are built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def cohort(self) -> DataFrame:
        """Orders as registry rows: code of the priority, status, price, and the customer's place."""
        o = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
        code = F.substring("o_orderpriority", 1, 1)
        base = o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderdate").cast("date").alias("day"), code.alias("code"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.when(F.col("o_custkey") % 13 != 0, F.col("c_nationkey")).alias("cluster"), F.col("c_acctbal").alias("acct"))
        n = features.integer_code(F.col("code"))
        return base.withColumn("t", F.when(n.between(1, 3), 1).when(n == 5, 0)).withColumn("y", (F.col("status") == "F").cast("int"))

    def scored(self) -> DataFrame:
        """Line items with a made score, a label, a unique key and a vintage."""
        p = F.round((F.pmod((F.col("l_quantity") * 7 + F.col("l_linenumber") * 3).cast("long") + F.col("l_partkey"), F.lit(101)) + 1) / 103.0, 9)
        key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
        return self.lineitem.select(key.alias("key"), p.alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.date_format("l_shipdate", "yyyy-MM").alias("vintage"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_linestatus").alias("linestatus"), F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("grp"), F.when(F.col("l_partkey") % 97 == 0, 99997.0).when(F.col("l_partkey") % 89 == 0, 99998.0).when(F.col("l_partkey") % 83 != 0, F.col("l_quantity")).alias("special"))

    def loans(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("amount"))

    def performance(self) -> DataFrame:
        """Month-end rows per customer with a flag."""
        j = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return j.select(F.col("o_custkey").alias("cust"), F.last_day(F.col("l_shipdate").cast("date")).alias("ref"), (F.col("l_returnflag") == "R").cast("int").alias("flag"))


COHORT = """base AS (SELECT o_orderkey AS key, o_custkey AS cust, year(o_orderdate)::INTEGER AS year, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderdate AS DATE) AS day,
 substr(o_orderpriority, 1, 1) AS code, o_orderstatus AS status, o_totalprice AS price, c_mktsegment AS segment, n_name AS nation, r_name AS region,
 CASE WHEN o_custkey % 13 <> 0 THEN c_nationkey END AS cluster, c_acctbal AS acct,
 CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 1 WHEN substr(o_orderpriority, 1, 1) = '5' THEN 0 END AS t, (o_orderstatus = 'F')::INTEGER AS y
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SCORED = """scored AS (SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || strftime(l_shipdate, '%Y%m%d') || '|' || l_extendedprice::DECIMAL(18,2) AS key,
 round(((((l_quantity * 7 + l_linenumber * 3)::BIGINT + l_partkey) % 101) + 1) / 103.0::DOUBLE, 9) AS p, (l_returnflag = 'R')::INTEGER AS label, strftime(l_shipdate, '%Y-%m') AS vintage,
 year(l_shipdate)::INTEGER AS year, l_quantity AS qty, l_extendedprice AS price, l_discount AS discount, l_linestatus AS linestatus, l_returnflag AS flag, l_orderkey AS grp,
 CASE WHEN l_partkey % 97 = 0 THEN 99997.0::DOUBLE WHEN l_partkey % 89 = 0 THEN 99998.0 WHEN l_partkey % 83 <> 0 THEN l_quantity END AS special FROM lineitem)"""

LOANS = """loans AS (SELECT o_orderkey AS key, o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount FROM orders),
 perf AS MATERIALIZED (SELECT o_custkey AS cust, last_day(CAST(l_shipdate AS DATE)) AS ref, (l_returnflag = 'R')::INTEGER AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 timed AS (SELECT *, last_day(day + INTERVAL 12 MONTH) AS month12, (SELECT max(ref) FROM perf) AS followed FROM loans),
 p12 AS (SELECT cust, ref, max(flag) AS flag12 FROM perf GROUP BY ALL),
 lab AS MATERIALIZED (SELECT t.key, t.cust, t.day, t.amount, t.month12, p.flag12, t.month12 <= followed AS has_window,
   CASE WHEN NOT t.month12 <= followed THEN 'sem_janela' WHEN p.flag12 IS NULL THEN 'sem_registro' ELSE 'observado' END AS origin,
   CASE WHEN t.month12 <= followed THEN coalesce(p.flag12, 0) END AS label FROM timed t LEFT JOIN p12 p ON p.cust = t.cust AND p.ref = t.month12)"""


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables`` and its SQL. ``WITH`` parts named in braces are filled in."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql.replace("{COHORT}", COHORT).replace("{SCORED}", SCORED).replace("{LOANS}", LOANS)
        return f

    return register
