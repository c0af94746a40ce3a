"""Ranks, running sums and quantiles, over a whole table or inside groups, without one task that sees all of a table or of a group.

All rest on one exchange by range: rows lie in order, each task numbers or adds up its own, and what lies before a task comes from the
totals of the tasks before it, a row for each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.audit import unpivoted
from riskloom.operators.joins import small
from riskloom.sources.staging import staged

#: ``monotonically_increasing_id`` holds the partition above so many bits, and the place in it below.
_BITS = 33


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def with_global_rank(df: DataFrame, order: Sequence[str], name: str = "rank", keep: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """Adds the 1-based rank in the order of the columns (which must be unique together), and returns the number of rows. ``keep``: the columns that are
    written, if not all.

    Rows are numbered where the range exchange has put them, so there is one exchange.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = staged((sorted_rows if keep is None else sorted_rows.select(*map(_name, keep))).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    nth, place = F.shiftright("__at", _BITS), F.col("__at").bitwiseAND(2**_BITS - 1)
    starts, at = [], 0
    for part, n in sorted(parts.groupBy(nth.alias("nth")).agg(F.count("*").alias("n")).collect()):  # one row per partition
        starts.append((part, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    return parts.join(F.broadcast(offsets), nth == F.col("__part")).withColumn(name, place + F.col("__start") + 1).drop("__at", "__part", "__start"), at


def _sums_in_order(by: Sequence[int], sums: Sequence[int]):
    """For rows that come in order: what lies before each inside its group and task. The last group of a batch goes on in the next."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, carried = None, [0] * len(sums)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for i in by:
                codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.r_[starts, n])
            same = last == tuple(batch.column(i)[0] for i in by)
            before = []
            for j, i in enumerate(sums):
                value = batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                all_before = np.cumsum(value) - value
                offset = -all_before[starts]
                if same:
                    offset[0] += carried[j]
                before.append(all_before + np.repeat(offset, sizes))
                carried[j] = int(before[-1][-1] + value[-1])
            last = tuple(batch.column(i)[n - 1] for i in by)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, before)], [*batch.schema.names, *[f"__before{j}" for j in range(len(sums))]])

    return run


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: Sequence[str]) -> DataFrame:
    """Adds ``<column>_before`` for each of ``sums`` (whole numbers, no nulls): the sum over the rows of the same group that come before in the order.

    One exchange by (group, order). A group may lie in many tasks and a task hold many groups: only the first group of a task can have rows in
    tasks before it, so the table of what to add has a row for each task at most and is broadcast.
    """
    keys = [*[_name(c).asc() for c in by], *[_name(c) if isinstance(c, str) else c for c in order]]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())
    names = ranged.columns
    kind = T.StructType([*ranged.schema.fields, *[T.StructField(f"__before{j}", T.LongType()) for j in range(len(sums))]])
    placed = staged(ranged.mapInArrow(_sums_in_order([names.index(c) for c in by], [names.index(c) for c in sums]), kind), "sums")
    totals = placed.groupBy("__part", *map(_name, by)).agg(*[F.sum(_name(c)).alias(f"__t{j}") for j, c in enumerate(sums)])
    w = Window.partitionBy(*map(_name, by)) if by else Window.partitionBy(F.lit(0))
    before = w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("__part").alias("__p"), *[_name(c).alias(f"__k{i}") for i, c in enumerate(by)], *[F.sum(f"__t{j}").over(before).alias(f"__c{j}") for j in range(len(sums))]).where("__c0 is not null")
    at = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        at = at & _name(c).eqNullSafe(F.col(f"__k{i}"))
    joined = placed.join(F.broadcast(carried), at, "left")
    return joined.select(*map(_name, df.columns), *[(F.col(f"__before{j}") + F.coalesce(f"__c{j}", F.lit(0))).alias(f"{c}_before") for j, c in enumerate(sums)])


def with_totals(df: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Adds sums over each group (null is one); the table of groups is broadcast only if it is small."""
    if not by:
        return df.join(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])))
    t = df.groupBy(*map(_name, by)).agg(*[c.alias(n) for n, c in totals.items()]).withColumnsRenamed({c: f"__g{i}" for i, c in enumerate(by)})
    at = F.lit(True)
    for i, c in enumerate(by):
        at = at & _name(c).eqNullSafe(F.col(f"__g{i}"))
    return df.join(small(t), at).drop(*[f"__g{i}" for i in range(len(by))])


def with_group_rank(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "rank", size: str = "size") -> DataFrame:
    """Adds each row's 1-based rank in its group and the group's number of rows. The order must be unique inside a group."""
    run = prefix_sums(df.withColumn("__one", F.lit(1).cast("long")), by, order, ["__one"])
    return with_totals(run, by, {size: F.count("*")}).withColumn(name, F.col("__one_before") + 1).drop("__one", "__one_before")


def value_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``by, variable, value, n``: rows per value of each numeric column; null values are there too."""
    return unpivoted(df, columns, by, as_text=False).groupBy(*map(_name, by), "variable", "value").agg(F.count("*").alias("n"))


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles of ``value`` counted ``n`` times, by group: ``by, q0, q1, ...``, between neighbours by a straight line.

    Each wanted place lies between two rows of the running counts, and only those rows have a say; a group is never in one task.
    """
    run = with_totals(prefix_sums(counts.where("value is not null"), by, ["value"], ["n"]), by, {"__all": F.sum("n")})
    found = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("__all") - 1)
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            found.append(F.max(F.when((F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n")), F.col("value"))).alias(f"__{side}{i}"))
    g = run.groupBy(*map(_name, by)).agg(F.max("__all").alias("__all"), *found)
    out = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("__all") - 1)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (place - F.floor(place)) * (hi - lo)).alias(f"q{i}"))
    return g.select(*map(_name, by), *out)


def quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles of numeric columns by group, nulls left out: ``by, variable, q0, q1, ...``. A group without values has no row."""
    return quantiles_of_counts(value_counts(df, by, columns), [*by, "variable"], probabilities)


def quantile_list(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """The same for one column of the whole table, as a few numbers on the driver; none if it has no value."""
    found = quantiles(df, [], [column], probabilities).first()
    return [found[f"q{i}"] for i in range(len(probabilities))] if found else []


def cut_points(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Values that end a bin when each column's rows are cut into ``bins`` of equal count, ties whole: fewer than ``bins`` numbers a column go to the driver."""
    run = with_totals(prefix_sums(value_counts(df, [], columns).where("value is not null"), ["variable"], ["value"], ["n"]), ["variable"], {"__all": F.sum("n")})
    full = lambda n: F.floor(n * bins / F.col("__all"))
    ends = run.where(F.least(full(F.col("n_before") + F.col("n")), F.lit(bins - 1)) > full(F.col("n_before"))).select("variable", "value")
    out: dict[str, list[float]] = {c: [] for c in columns}
    for variable, value in ends.collect():
        out[variable].append(value)
    return {c: sorted(v) for c, v in out.items()}


def score_table(df: DataFrame, score: str, label: str, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """One row per distinct score (of each group), highest first by running counts: ``by, score, n1, n0, tp, fp, pos, neg``.

    Ties are one row, so everything built on it treats them exactly. The scores of a group may lie in many tasks. ``count``: how many rows a row stands for.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    y, n = F.col(label).cast("long"), F.col(count) if count else F.lit(1)
    counts = known.groupBy(*map(_name, by), F.col(score).cast("double").alias("score")).agg(F.sum(y * n).alias("n1"), F.sum((1 - y) * n).alias("n0"))
    run = with_totals(prefix_sums(counts, by, [F.desc("score")], ["n1", "n0"]), by, {"pos": F.sum("n1"), "neg": F.sum("n0")})
    return run.select(*map(_name, by), "score", "n1", "n0", (F.col("n1_before") + F.col("n1")).alias("tp"), (F.col("n0_before") + F.col("n0")).alias("fp"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), F.coalesce("neg", F.lit(0)).cast("long").alias("neg"))
