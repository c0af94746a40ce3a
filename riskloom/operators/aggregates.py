"""Aggregations: risk tables, vintages, crosstabs, summaries by group, windows over aggregated tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.audit import long_rows, unpivoted  # noqa: F401  A18
from riskloom.operators.ordered import quantiles, quantiles_of_counts, with_group_rank

DIGITS = 4


def r(c: Column, digits: int = DIGITS) -> Column:
    return F.round(c.cast("double"), digits)


def with_quantiles(groups: DataFrame, df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Adds ``q0, q1, ...``, the exact quantiles of a column in each group (null is one), to a table with a row for each group."""
    counts = df.groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    q = quantiles_of_counts(counts, by, probabilities).withColumnsRenamed({c: f"__q{i}" for i, c in enumerate(by)})
    at = F.lit(True)
    for i, c in enumerate(by):
        at = at & F.col(c).eqNullSafe(F.col(f"__q{i}"))
    return groups.join(q, at, "left").drop(*[f"__q{i}" for i in range(len(by))])


def risk_by_band(df: DataFrame, band: str, value: str, label: str, means: Sequence[str] = ()) -> DataFrame:
    """A1: volume, event rate, extremes, means, and the gap to the portfolio's rate in percentage points."""
    y = F.col(label).cast("double")
    whole = df.agg(F.avg(y).alias("__all"))  # one row
    g = df.groupBy(band).agg(F.count("*").alias("n"), F.avg(y).alias("rate"), F.min(value).alias("low"), F.max(value).alias("high"), *[r(F.avg(m)).alias(f"mean_{m}") for m in means])
    return g.join(F.broadcast(whole)).withColumn("gap_pp", r((F.col("rate") - F.col("__all")) * 100)).withColumn("rate", r(F.col("rate"), 6)).drop("__all")


def risk_by_category(df: DataFrame, column: str, label: str, least: int = 50) -> DataFrame:
    """A2: groups (null is one) of a minimum volume."""
    return df.groupBy(column).agg(F.count("*").alias("n"), r(F.avg(F.col(label).cast("double")), 6).alias("rate")).where(F.col("n") >= least)


def vintage_table(df: DataFrame, vintage: Column, labels: Sequence[str], means: Sequence[str] = ()) -> DataFrame:
    """A3."""
    return df.groupBy(vintage.alias("vintage")).agg(F.count("*").alias("n"), *[r(F.avg(F.col(c).cast("double")), 6).alias(f"rate_{c}") for c in labels], *[r(F.avg(m)).alias(f"mean_{m}") for m in means])


def with_total(df: DataFrame, group: str, measures: Mapping[str, Column], total: str = "TOTAL") -> DataFrame:
    """A4, A5: filtered counts and other measures by group and for the total, by grouping sets in one pass."""
    g = df.groupingSets([[F.col(group)], []], group).agg(F.grouping(group).alias("__g"), *[c.alias(n) for n, c in measures.items()])
    return g.select(F.when(F.col("__g") == 1, total).otherwise(F.col(group)).alias(group), *measures)


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence) -> DataFrame:
    """Counts with zero cells, row and column totals, row % and column %."""
    cells = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in levels]
    t = with_total(df, row, {f"n_{v}": c for v, c in zip(levels, cells, strict=True)} | {"total": F.count("*")})
    whole = df.agg(*[c.alias(f"__{v}") for v, c in zip(levels, cells, strict=True)])  # one row
    t = t.join(F.broadcast(whole))
    return t.select(row, *[f"n_{v}" for v in levels], "total", *[r(F.col(f"n_{v}") * 100.0 / F.col("total")).alias(f"row_{v}") for v in levels], *[r(F.when(F.col(f"__{v}") > 0, F.col(f"n_{v}") * 100.0 / F.col(f"__{v}"))).alias(f"col_{v}") for v in levels])


def continuous_summary(df: DataFrame, group: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """Mean with its t interval, deviation, percentiles, shares below thresholds. t quantiles: one per group, on the driver."""
    from riskloom.functions.special import t_quantile

    v = F.col(value)
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), *[r(F.avg((v < t).cast("double")) * 100).alias(f"below_{int(t)}") for t in thresholds])
    sizes = [row["n"] for row in g.select("n").distinct().collect()]  # one per group at most
    q = df.sparkSession.createDataFrame([(n, float(t_quantile(0.975, n - 1)) if n > 1 else None) for n in sizes] or [(0, None)], "n long, t double")
    half = F.col("t") * F.col("sd") / F.sqrt("n")
    g = with_quantiles(g.join(F.broadcast(q), "n", "left"), df, [group], value, (0.1, 0.25, 0.5, 0.75, 0.9))
    return g.select(group, "n", r(F.col("mean")).alias("mean"), r(F.col("mean") - half).alias("low"), r(F.col("mean") + half).alias("high"), r(F.col("sd")).alias("sd"), *[r(F.col(f"q{i}")).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))], *[f"below_{int(t)}" for t in thresholds])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares, null kept."""
    n = df.agg(F.count("*").alias("__n"))  # one row
    return df.groupBy(column).agg(F.count("*").alias("n")).join(F.broadcast(n)).select(column, "n", r(F.col("n") / F.col("__n"), 6).alias("share"))


def event_summary(df: DataFrame, event: str, time: str, fields: Mapping[str, Column]) -> DataFrame:
    """Volume, first, last and median time, and how often each payload field is filled."""
    filled = {f"filled_{n}": r(F.avg(c.isNotNull().cast("double")), 6) for n, c in fields.items()}
    g = df.groupBy(event).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), *[c.alias(n) for n, c in filled.items()])
    return with_quantiles(g, df, [event], time, (0.5,)).select(event, "n", "first", "last", r(F.col("q0")).alias("median"), *filled)


def missing_by_vintage(df: DataFrame, vintage: str, columns: Sequence[str]) -> DataFrame:
    """A10: lowest, highest rate of missing values over vintages, and their difference."""
    per = unpivoted(df, columns, [vintage]).groupBy(vintage, "variable").agg(F.avg(F.col("value").isNull().cast("double")).alias("m"))
    return per.groupBy("variable").agg(r(F.min("m"), 6).alias("low"), r(F.max("m"), 6).alias("high"), r(F.max("m") - F.min("m"), 6).alias("amplitude"))


def numeric_by_vintage(df: DataFrame, vintage: str, columns: Sequence[str]) -> DataFrame:
    """A11."""
    v = F.col("value")
    long = unpivoted(df, columns, [vintage], as_text=False)
    g = long.groupBy(vintage, "variable").agg(F.count(v).alias("n"), r(F.avg(v)).alias("mean"), r(F.stddev_samp(v)).alias("sd"), r(F.min(v)).alias("min"), r(F.max(v)).alias("max"))
    return with_quantiles(g, long, [vintage, "variable"], "value", (0.25, 0.5, 0.75)).select(vintage, "variable", "n", "mean", r(F.col("q1")).alias("median"), "sd", "min", r(F.col("q0")).alias("p25"), r(F.col("q2")).alias("p75"), "max")


def category_stability(df: DataFrame, vintage: str, column: str, reference, rare: float = 0.01) -> DataFrame:
    """By vintage: levels, dominant share, rare levels, levels new or gone against the reference vintage."""
    c = df.groupBy(vintage, column).agg(F.count("*").alias("n"))
    ref = c.where(F.col(vintage) == F.lit(reference)).agg(F.collect_set(column).alias("__ref"))  # one row of few levels
    g = c.groupBy(vintage).agg(F.count(column).alias("levels"), r(F.max("n") / F.sum("n"), 6).alias("dominant_share"), F.collect_list("n").alias("ns"), F.sum("n").alias("t"), F.collect_set(column).alias("l")).join(F.broadcast(ref))
    return g.select(vintage, "levels", "dominant_share", F.size(F.filter("ns", lambda x: x < rare * F.col("t"))).cast("long").alias("rare_levels"), F.size(F.array_except("l", "__ref")).cast("long").alias("new_levels"), F.size(F.array_except("__ref", "l")).cast("long").alias("gone_levels"))


def special_by_vintage(df: DataFrame, state: Column, vintage: str, label: str) -> DataFrame:
    """Each special code's rows, events, rate and share inside its vintage."""
    g = df.groupBy(state.alias("state"), vintage).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("events"))
    return g.select("state", vintage, "n", "events", r(F.col("events") / F.col("n"), 6).alias("rate"), r(F.col("n") / F.sum("n").over(Window.partitionBy(vintage)), 6).alias("share"))


def group_index(df: DataFrame, group: str, index: str, size: Column, mode: str) -> DataFrame:
    """Count, index range, total size, most frequent value (the smallest on ties)."""
    c = df.groupBy(group, mode).agg(F.count("*").alias("c"), F.min(index).alias("lo"), F.max(index).alias("hi"), F.sum(size).alias("s"))
    return c.groupBy(group).agg(F.sum("c").alias("n"), F.min("lo").alias("first_index"), F.max("hi").alias("last_index"), F.sum("s").alias("total_size"), F.min(F.struct((-F.col("c")).alias("m"), F.col(mode).alias("v"))).alias("b")).select(group, "n", "first_index", "last_index", "total_size", F.col("b.v").alias("mode"))


def instances_to_group(df: DataFrame, keys: Sequence[str], probability: str, label: str, threshold: float = 0.5, order: str | None = None) -> DataFrame:
    """Mean and deviation of the probability (none: 0), count, first label, positive rate, label by threshold.

    A mean that is the threshold, or all but, is told by exact decimal sums, so that the order of rows has no say.
    """
    p = F.avg(probability)
    exact = F.sum(F.col(probability).try_cast("decimal(24,18)") - F.lit(str(threshold)).cast("decimal(24,18)"))
    predicted = F.when(F.abs(p - threshold) < 1e-12, exact >= 0).otherwise(p >= threshold)
    return df.groupBy(*keys).agg(r(p, 6).alias("prob"), r(F.coalesce(F.stddev_samp(probability), F.lit(0.0)), 6).alias("prob_sd"), F.count("*").alias("n"), F.min_by(label, order or label).alias("label"), r(F.avg(F.col(label).cast("double")), 6).alias("positive_rate"), predicted.cast("int").alias("predicted"))


def group_sizes(df: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Groups, instances, smallest, mean and largest group."""
    return df.groupBy(*by, group).agg(F.count("*").alias("c")).groupBy(*by).agg(F.count("*").alias("groups"), F.sum("c").alias("instances"), F.min("c").alias("min_size"), r(F.avg("c")).alias("mean_size"), F.max("c").alias("max_size"))


def pivoted(df: DataFrame, row: str, column: str, levels: Sequence, value: Column) -> DataFrame:
    """Long to wide for known levels (so no extra pass to find them)."""
    return df.groupBy(row).pivot(column, list(levels)).agg(value)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return long_rows(df, {f"{a}|{b}": {"corr": r(F.corr(a, b), 6)} for a, b in pairs}, ("corr",), "pair")


def ratio_of_sums(df: DataFrame, by: Sequence[str], numerator: Column, denominator: Column) -> DataFrame:
    """Sums over years, then one division."""
    return df.groupBy(*by).agg(F.sum(numerator).cast("long").alias("num"), F.sum(denominator).cast("long").alias("den")).withColumn("ratio", r(F.when(F.col("den") > 0, F.col("num") / F.col("den")), 6))


def compare_two(df: DataFrame, period: str, unit: str, a, b, value: Column) -> DataFrame:
    """Two units over the periods: extremes, smallest and largest gap, periods above and below."""
    w = pivoted(df, period, unit, [a, b], value).select(period, F.col(f"`{a}`").cast("double").alias("a"), F.col(f"`{b}`").cast("double").alias("b"))
    g = F.col("a") - F.col("b")
    return w.agg(r(F.min("a")).alias("min_a"), r(F.max("a")).alias("max_a"), r(F.min("b")).alias("min_b"), r(F.max("b")).alias("max_b"), r(F.min(F.abs(g))).alias("smallest_gap"), r(F.max(F.abs(g))).alias("largest_gap"), F.count_if(g > 0).alias("above"), F.count_if(g < 0).alias("below"))


def missing_by_group(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Missing values of each covariate by treatment or outcome."""
    return unpivoted(df, columns, [group]).groupBy("variable", group).agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing")).withColumn("percent", r(F.col("missing") * 100.0 / F.col("n")))


def positivity(df: DataFrame, columns: Sequence[str], t: str, near: float = 0.05, small: int = 30) -> DataFrame:
    """Each category's treated and untreated rows, share treated, and flags for shares near 0 or 1 and for small cells."""
    g = unpivoted(df, columns, [t]).groupBy("variable", "value").agg(F.count("*").alias("n"), F.count_if(F.col(t) == 1).alias("n1"), F.count_if(F.col(t) == 0).alias("n0"))
    share = F.col("n1") / (F.col("n1") + F.col("n0"))
    return g.withColumn("share", r(share, 6)).withColumn("near_deterministic", (share <= near) | (share >= 1 - near)).withColumn("small_cell", F.least("n1", "n0") < small)


def risk_decomposition(df: DataFrame, by: str, event: Column, part: Column) -> DataFrame:
    """Risk through a part and through the rest, which add up to the whole."""
    n = F.count("*")
    return df.groupBy(by).agg(n.alias("n"), r(F.count_if(event) / n, 6).alias("risk"), r(F.count_if(event & part) / n, 6).alias("risk_part"), r(F.count_if(event & ~part) / n, 6).alias("risk_rest"))


def selection_table(df: DataFrame, status: str, band: str) -> DataFrame:
    """Status by band, with a subtotal over bands for each status."""
    cells = df.groupBy(status, band).agg(F.count("*").alias("n"))
    return cells.select(status, F.coalesce(F.col(band), F.lit("DESCONHECIDA")).alias(band), "n").unionByName(df.groupBy(status).agg(F.count("*").alias("n")).select(status, F.lit("SUBTOTAL").alias(band), "n"))


def pool_vectors(df: DataFrame, group: str, vector: str, how: str = "mean") -> DataFrame:
    """Element-wise mean or maximum of a bag's vectors, combined before the shuffle."""
    f = {"mean": F.avg, "max": F.max}[how]
    e = df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(f(F.col("x").cast("double")).alias("x"))
    return e.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).select(group, F.col("v.x").alias("pooled"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives over positives."""
    return df.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")).withColumn("weight", r(F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")), 6))


def histogram(df: DataFrame, group: str, value: str, width: float, weight: Column | None = None) -> DataFrame:
    """Share of rows and of weight by fixed-width bin inside each group."""
    w = F.lit(1.0) if weight is None else weight
    g = df.groupBy(group, F.floor(F.col(value) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(w).alias("w"))
    inside = Window.partitionBy(group)
    return g.select(group, "bin", "n", r(F.col("n") * 100.0 / F.sum("n").over(inside)).alias("percent_rows"), r(F.col("w") * 100.0 / F.sum("w").over(inside)).alias("percent_weight"))


def scalar_summary(df: DataFrame, metrics: Mapping[str, Column], medians: Mapping[str, str] = {}) -> DataFrame:
    """(metric, value) rows from one aggregation, and medians of columns by their exact quantiles."""
    out = long_rows(df, {m: {"value": r(c)} for m, c in metrics.items()}, ("value",), "metric")
    if not medians:
        return out
    found = quantiles(df.select(*[F.col(c).alias(m) for m, c in medians.items()]), [], list(medians), (0.5,))
    return out.unionByName(found.select(F.col("variable").alias("metric"), r(F.col("q0")).alias("value")))


# windows


def year_change(df: DataFrame, unit: str, year: str, value: str) -> DataFrame:
    """Difference and change in per cent against the year before; null if that year isn't there."""
    w = Window.partitionBy(unit).orderBy(year)
    before = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(value).over(w))
    return df.select(unit, year, value, before.alias("__b")).select(unit, year, value, r(F.col(value) - F.col("__b")).alias("difference"), r(F.when(F.col("__b") != 0, (F.col(value) - F.col("__b")) * 100.0 / F.col("__b"))).alias("percent"))


def largest_fall(df: DataFrame, group: str, period: str, change: str) -> DataFrame:
    """W2."""
    return df.where(F.col(change).isNotNull()).groupBy(group).agg(F.min(F.struct(change, period)).alias("f")).select(group, F.col(f"f.{period}").alias(period), F.col(f"f.{change}").alias("fall"))


def shares(df: DataFrame, group: str, value: str) -> DataFrame:
    """W3."""
    return df.withColumn("share", r(F.col(value) / F.sum(value).over(Window.partitionBy(group)), 6))


def cumulative_share(df: DataFrame, order: str, value: str) -> DataFrame:
    """Over a table that is already aggregated (a few rows)."""
    w = Window.orderBy(order)
    return df.withColumn("capture", r(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 6))


def metric_ranks(df: DataFrame, directions: Mapping[str, str]) -> DataFrame:
    """Rank of each model by each metric ('desc': large is good), ties share the smallest rank. A row per model."""
    return df.withColumns({f"rank_{m}": F.rank().over(Window.orderBy(F.desc(m) if d == "desc" else F.asc(m))) for m, d in directions.items()})


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group, with their ordinal."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("ordinal") <= k)


def error_examples(df: DataFrame, tag: str, probability: str, key: str, k: int) -> DataFrame:
    """The k most telling rows of each outcome: false and true positives from the top, negatives from the bottom."""
    signed = F.when(F.col(tag).isin("FP", "TP"), -F.col(probability)).otherwise(F.col(probability))
    return first_rows(df, [tag], [signed, F.col(key)], k)


def evenly_spaced(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """K rows at places round(i * (n - 1) / (k - 1)) of each ordered group (halves to even); all if there are no more."""
    ranked = with_group_rank(df, by, order, "__r", "__n").withColumn("__p", F.col("__r") - 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(float(max(k - 1, 1)))).cast("int"))
    return ranked.where((F.col("__n") <= k) | F.array_contains(places, F.col("__p").cast("int"))).drop("__p", "__n", "__r")


def thinned(curve: DataFrame, order: str, points: int, n: int | None = None) -> DataFrame:
    """A curve's rows at evenly spaced places, by a distributed rank."""
    from riskloom.operators.ordered import with_global_rank

    ranked, n = with_global_rank(curve, [order], "__p")
    if n <= points:
        return ranked.drop("__p")
    wanted = curve.sparkSession.range(points).select((F.bround(F.col("id") * (n - 1) / F.lit(float(points - 1))) + 1).cast("long").alias("__p")).distinct()
    return ranked.join(F.broadcast(wanted), "__p", "left_semi").drop("__p")


def dedup_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Keeps the first row of a case-folded key."""
    from riskloom.operators.joins import first_of

    return first_of(df.withColumn("__k", F.lower(key)), ["__k"], [F.col(order)]).drop("__k")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Each task keeps k rows only."""
    return df.orderBy(*order).limit(k)


def direction_of_effect(df: DataFrame, variable: str, band: str, rate: str) -> DataFrame:
    """Rate of the last band minus that of the first."""
    return df.groupBy(variable).agg(r(F.max_by(rate, band) - F.min_by(rate, band), 6).alias("effect")).withColumn("direction", F.when(F.col("effect") > 0, "up").when(F.col("effect") < 0, "down").otherwise("flat"))
