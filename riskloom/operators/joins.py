"""Joins: labels over a window of months, look-ups, propagation, expansion, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dimension below this many rows may be broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint for a dimension, after a check of its size; a larger one is joined by key without the hint."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def month12_join(loans: DataFrame, perf: DataFrame, entity: str, ref: str = "ref", month12: str = "month12", flag: str = "flag") -> DataFrame:
    """Performance of the month 12 of each loan; several rows of one month count as their largest flag."""
    one = perf.groupBy(entity, ref).agg(F.max(flag).alias("flag12"))
    return loans.join(one.withColumnRenamed(ref, month12), [entity, month12], "left")


def window_join(loans: DataFrame, perf: DataFrame, entity: str, begin: str = "day", end: str = "month12", ref: str = "ref") -> DataFrame:
    """Performance rows after the loan's begin up to its end: an equi-join with the range inside the join."""
    p = perf.withColumnRenamed(entity, "__e")
    return loans.join(p, (loans[entity] == p["__e"]) & (p[ref] > loans[begin]) & (p[ref] <= loans[end])).drop("__e")


def label_12m(loans: DataFrame, perf: DataFrame, entity: str, day: str = "day") -> DataFrame:
    """12-month label with right-censoring: whether the window is observed, the value, where it comes from, and the label."""
    last = perf.agg(F.max("ref").alias("followed_to"))  # one row
    timed = loans.withColumn("month12", F.last_day(F.add_months(day, 12))).join(F.broadcast(last))
    j = month12_join(timed, perf, entity)
    has = F.col("month12") <= F.col("followed_to")
    return j.withColumn("has_window", has).withColumn("origin", F.when(~has, "sem_janela").when(F.col("flag12").isNull(), "sem_registro").otherwise("observado")).withColumn("label", F.when(has, F.coalesce("flag12", F.lit(0))))


def ever_label(labelled: DataFrame, perf: DataFrame, key: str, entity: str, day: str = "day") -> DataFrame:
    """Whether the flag was ever set inside the window; null becomes 0 only where the window exists."""
    inside = window_join(labelled.select(key, entity, day, "month12"), perf, entity, day).groupBy(key).agg(F.max("flag").alias("any"))
    return labelled.join(inside, key, "left").withColumn("ever", F.when(F.col("has_window"), F.coalesce("any", F.lit(0)))).drop("any")


def lookup(df: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J4."""
    return df.join(small(dimension), list(keys), "left")


#: Rows that a task joins, where a join sets its number of tasks by its input.
TASK_ROWS = 1_000_000


def propagate_group(members: DataFrame, groups: DataFrame, key: str, value: str) -> DataFrame:
    """A group's assignment for each member; a member without one is an error.

    The number of tasks follows the number of rows, so that a task's memory doesn't.
    """
    rows = members.count() + groups.count()
    if rows > TASK_ROWS:
        tasks = max(-(-rows // TASK_ROWS), members.sparkSession.sparkContext.defaultParallelism)
        members, groups = members.repartition(tasks, key), groups.repartition(tasks, key)
    j = members.join(groups, key, "left")
    return j.withColumn(value, F.coalesce(F.col(value), F.raise_error(F.concat(F.lit("group isn't assigned: "), F.col(key).cast("string"))).cast(dict(groups.dtypes)[value])))


def outer_merge(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both tables' values, missing ones 0."""
    j = a.join(b, key, "full_outer")
    return j.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in j.columns if c != key])


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left merge of metadata or intervals, missing ones null."""
    return left.join(right, list(keys), "left")


def expand_scenarios(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every row with every scenario; a scenario table that isn't small is not broadcast."""
    return df.crossJoin(small(scenarios))


def members(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """J10."""
    return df.join(keys, on, "left_semi")


def non_members(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_anti")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key by an order, as an aggregation (no window, so partial results are combined)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"__{i}") for i, o in enumerate(order)], *rest)).alias("__f")).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in rest])
