"""Contracts and audits: each returns a table of findings, or raises where a contract is broken."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.sources.io import require_columns  # noqa: F401  V1
from riskloom.sources.staging import staged

VALID, ABSENT, IGNORED, INVALID, OUT_OF_RANGE, UNCONFIRMED = "valido", "ausente", "ignorado", "invalido", "fora_faixa", "nao_confirmado"
STATUSES = (ABSENT, IGNORED, INVALID, OUT_OF_RANGE, UNCONFIRMED, VALID)


def long_rows(df: DataFrame, fields: Mapping[str, Mapping[str, Column]], names: Sequence[str], key: str = "field") -> DataFrame:
    """One aggregation of all fields' measures, then a row for each field. ``fields``: field to measure to aggregate."""
    wide = df.agg(*[measures[n].alias(f"{i}_{n}") for i, measures in enumerate(fields.values()) for n in names])
    rows = F.array(*[F.struct(F.lit(f).alias(key), *[F.col(f"{i}_{n}").alias(n) for n in names]) for i, f in enumerate(fields)])
    return wide.select(F.inline(rows))


def schema_diff(df: DataFrame, reference: DataFrame) -> DataFrame:
    """V2: columns missing, extra, different only in case, and whether the order is the same."""
    a, b = df.columns, reference.columns
    upper_a, upper_b = {c.upper(): c for c in a}, {c.upper(): c for c in b}
    rows = [("missing", ",".join(sorted(upper_b[c] for c in upper_b if c not in upper_a))), ("extra", ",".join(sorted(upper_a[c] for c in upper_a if c not in upper_b))), ("case", ",".join(sorted(upper_a[c] for c in upper_a if c in upper_b and upper_a[c] != upper_b[c]))), ("same_order", str([c.upper() for c in a] == [c.upper() for c in b]).lower())]
    return df.sparkSession.createDataFrame(rows, "check string, found string")


def availability(spark: SparkSession, present: Mapping[int, Sequence[str]], roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """V3: per year and role, how many fields are there and which are missing."""
    rows = [(y, r, sum(f in have for f in fields), len(fields), ",".join(f for f in fields if f not in have)) for y, have in sorted(present.items()) for r, fields in roles.items()]
    return spark.createDataFrame(rows, "ano int, role string, n_present int, n_fields int, missing string")


def filled_availability(df: DataFrame, year: str, roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """V3 from the rows: a field is there in a year if any row of the year has a value. ``ano, role, n_present, n_fields, missing``."""
    fields = sorted({f for x in roles.values() for f in x})
    g = df.where(F.col(year).isNotNull()).groupBy(F.col(year).cast("int").alias("ano")).agg(*[(F.count(f) > 0).alias(f) for f in fields])
    out = []
    for role, names in roles.items():
        lack = F.filter(F.array(*[F.when(~F.col(f), F.lit(f)) for f in names]), lambda x: x.isNotNull())
        out.append(F.struct(F.lit(role).alias("role"), (F.lit(len(names)) - F.size(lack)).alias("n_present"), F.lit(len(names)).alias("n_fields"), F.array_join(lack, ",").alias("missing")))
    return g.select("ano", F.inline(F.array(*out)))


def field_diff(df: DataFrame, reference: DataFrame) -> DataFrame:
    """V2 with the rows: each field of either table (in upper case), whether it is the same, in another case, missing or extra, and how many rows
    have a value in each table (null where the field isn't there)."""

    def filled(x: DataFrame, name: str) -> DataFrame:
        rows = long_rows(x, {c.upper(): {name: F.count(F.col(f"`{c}`"))} for c in x.columns}, (name,))
        names = F.create_map(*[v for c in x.columns for v in (F.lit(c.upper()), F.lit(c))])
        return rows.withColumn(f"name_{name}", names[F.col("field")])

    j = filled(df, "filled").join(filled(reference, "filled_reference"), "field", "full_outer")  # a row for each field
    a, b = F.col("name_filled"), F.col("name_filled_reference")
    status = F.when(a.isNull(), "missing").when(b.isNull(), "extra").when(a == b, "same").otherwise("case")
    return j.select("field", status.alias("status"), "filled", "filled_reference")


def admission(table: DataFrame) -> DataFrame:
    """V3: class of each year by ordered rules over its roles: outcome and treatment are essential, the rest may lack."""
    per = table.groupBy("ano").agg(F.bool_and(F.when(F.col("role").isin("treatment", "outcome"), F.col("n_present") == F.col("n_fields"))).alias("essential"), F.bool_and(F.col("n_present") == F.col("n_fields")).alias("complete"))
    return per.select("ano", F.when(~F.col("essential"), "excluded").when(F.col("complete"), "full").otherwise("partial").alias("admission"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V4: of a set of rows, whatever their order: count, sum and exclusive or of 64-bit hashes."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).cast("string").alias("hash_xor"))


def key_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V4: of a set of rows, whatever their order: count, and the sum of the first 60 bits of each row's SHA-256, which any program can work out.
    Fields are joined by a tab as text; a null field is written as a backslash and N."""
    row = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    bits = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(bits).cast("string").alias("digest_sum"))


def key_check(df: DataFrame, key: str) -> DataFrame:
    """V5."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("null_keys"), F.countDistinct(key).alias("distinct_keys")).withColumn("duplicate_keys", F.col("n") - F.col("null_keys") - F.col("distinct_keys"))


def date_check(df: DataFrame, text: Column, pattern: str, year: int) -> DataFrame:
    """V6: unparseable dates, dates out of the year, first and last."""
    d = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    return df.agg(F.count("*").alias("n"), F.count_if(d.isNull()).alias("unparseable"), F.count_if(F.year(d) != year).alias("out_of_year"), F.date_format(F.min(d), "yyyy-MM-dd").alias("first"), F.date_format(F.max(d), "yyyy-MM-dd").alias("last"))


def code_status(value: Column, valid: Sequence[int] | None = None, ignored: Sequence[int] = (), low: int | None = None, high: int | None = None, confirmed: Column | None = None) -> Column:
    """V7: status of a text code, in this order: absent, ignored, invalid, out of range, not confirmed, valid."""
    t = F.trim(value)
    n = F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))
    chain = F.when(value.isNull() | (t == ""), ABSENT).when(n.isin(*ignored) if ignored else F.lit(False), IGNORED).when(n.isNull(), INVALID)
    if valid is not None:
        chain = chain.when(~n.isin(*valid), INVALID)
    if low is not None or high is not None:
        chain = chain.when((n < low if low is not None else F.lit(False)) | (n > high if high is not None else F.lit(False)), OUT_OF_RANGE)
    if confirmed is not None:
        chain = chain.when(~F.coalesce(confirmed, F.lit(False)), UNCONFIRMED)
    return chain.otherwise(VALID)


def status_counts(df: DataFrame, statuses: Mapping[str, Column], territory: str, total: str = "TOTAL") -> DataFrame:
    """V8: counts and shares of each status for each field by territory and for the total, in one pass over grouping sets."""
    tagged = df.select(F.col(territory).alias("territory"), *[c.alias(f) for f, c in statuses.items()])
    wide = tagged.groupingSets([["territory"], []], "territory").agg(F.grouping("territory").alias("__g"), F.count("*").alias("n"), *[F.count_if(F.col(f) == s).alias(f"{f}__{s}") for f in statuses for s in STATUSES])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s).alias("status"), F.col(f"{f}__{s}").alias("count"), (F.col("n") - F.col(f"{f}__{ABSENT}")).alias("filled")) for f in statuses for s in STATUSES])
    long = wide.select(F.when(F.col("__g") == 1, total).otherwise(F.col("territory")).alias("territory"), "n", F.inline(rows))
    return long.withColumn("percent", F.round(F.col("count") * 100.0 / F.col("n"), 4))


def reconcile(counts: DataFrame, keys: Sequence[str], part: str, whole: str) -> DataFrame:
    """V9: whether the parts of each key add up to its whole."""
    return counts.groupBy(*keys).agg(F.sum(part).alias("parts"), F.max(whole).alias("whole")).withColumn("ok", F.col("parts") == F.col("whole"))


ROLES = {"treatment": ("MESPRENAT", "T"), "outcome": ("PESO", "Y"), "post_treatment": ("SEMAGESTAC", "GESTACAO", "CONSPRENAT")}


def role_of(name: str) -> str:
    """Role of a column by its name."""
    return next((role for role, names in ROLES.items() if name.upper() in names), "covariate")


def guard_predictors(columns: Sequence[str], allowed: Sequence[str] | None = None) -> list[str]:
    """Raises if a predictor is the outcome, the treatment or comes after it, or isn't in the allow-list."""
    if bad := [c for c in columns if role_of(c) != "covariate" or (allowed is not None and c not in allowed)]:
        raise ValueError(f"columns may not be predictors: {bad}")
    return list(columns)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type, nulls and distinct values of each column."""
    kinds = dict(df.dtypes)
    fields = {c: {"nulls": F.count_if(F.col(c).isNull()), "n": F.count("*"), "distinct": F.countDistinct(c)} for c in columns or df.columns}
    types = F.create_map(*[x for c in fields for x in (F.lit(c), F.lit(kinds[c]))])
    return long_rows(df, fields, ("nulls", "n", "distinct")).select("field", types[F.col("field")].alias("type"), "nulls", F.round(F.col("nulls") * 100.0 / F.col("n"), 4).alias("null_percent"), "distinct")


def duplicate_rows(df: DataFrame, maps: Sequence[str] = ()) -> DataFrame:
    """Number of rows that repeat another; nested maps are compared by their sorted entries."""
    plain = df.select(*[F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(c) if c in maps else F.col(c) for c in df.columns])
    return plain.groupBy(*plain.columns).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("c") > 1).alias("repeated_groups"))


def granularity(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(*key).agg(F.count("*").alias("rows_per_key")).groupBy("rows_per_key").agg(F.count("*").alias("keys"))


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule, in one pass."""
    return long_rows(df, {r: {"count": F.count_if(c), "n": F.count("*")} for r, c in rules.items()}, ("count", "n"), "rule").select("rule", "count", F.round(F.col("count") * 100.0 / F.col("n"), 4).alias("percent"))


PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def describe(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Count, missing share, distinct, mean, deviation, extremes and exact percentiles."""
    from riskloom.operators.ordered import quantiles_of_counts, value_counts

    r = lambda c: F.round(c.cast("double"), digits)
    # rows per value, once: counts, distinct values and quantiles all come from them. Moments come from the rows, which add up without loss of digits
    counts = staged(value_counts(df, [], columns), "values")
    seen = F.col("value").isNotNull()
    n = F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0))
    shape = counts.groupBy("variable").agg(n.alias("n"), r((F.sum("n") - n) * 100.0 / F.sum("n")).alias("missing_percent"), F.count_if(seen).alias("distinct"))
    moments = long_rows(df, {c: {"mean": r(F.avg(c)), "sd": r(F.stddev_samp(c)), "min": r(F.min(c)), "max": r(F.max(c))} for c in columns}, ("mean", "sd", "min", "max"), "variable")
    points = quantiles_of_counts(counts, ["variable"], PERCENTILES)
    # a row for each column
    j = moments.join(F.broadcast(shape), "variable", "left").join(F.broadcast(points), "variable", "left")
    return j.select(F.col("variable").alias("field"), F.coalesce("n", F.lit(0)).alias("n"), "missing_percent", F.coalesce("distinct", F.lit(0)).alias("distinct"), "mean", "sd", "min", "max", *[r(F.col(f"q{i}")).alias(f"p{int(p * 100):02d}") for i, p in enumerate(PERCENTILES)])


def date_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, first and last of each date column."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return long_rows(df, {c: {"nulls": F.count_if(F.col(c).isNull()), "first": day(F.min(c)), "last": day(F.max(c))} for c in columns}, ("nulls", "first", "last"))


def key_overlap(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Distinct keys in either table, both, only one; share of A's keys that B has."""
    x = a.select(F.col(key_a).alias("k")).where("k is not null").distinct().withColumn("in_a", F.lit(1))
    y = b.select(F.col(key_b).alias("k")).where("k is not null").distinct().withColumn("in_b", F.lit(1))
    j = x.join(y, "k", "full_outer")
    a_, b_ = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    out = j.agg(F.count_if(a_).alias("in_a"), F.count_if(b_).alias("in_b"), F.count_if(a_ & b_).alias("both"), F.count_if(a_ & ~b_).alias("only_a"), F.count_if(~a_ & b_).alias("only_b"))
    return out.withColumn("coverage_percent", F.round(F.col("both") * 100.0 / F.col("in_a"), 4))


def all_hold(df: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """For each rule (which rows, what must hold): rows, failures, and whether all hold."""
    fields = {r: {"rows": F.count_if(which), "failures": F.count_if(which & ~F.coalesce(holds, F.lit(False)))} for r, (which, holds) in rules.items()}
    return long_rows(df, fields, ("rows", "failures"), "rule").withColumn("ok", F.col("failures") == 0)


def missing_months(df: DataFrame, day: str) -> DataFrame:
    """Months between the first and the last that have no row."""
    m = df.select(F.trunc(day, "month").alias("m")).where("m is not null")
    all_of = m.agg(F.explode(F.sequence(F.min("m"), F.max("m"), F.expr("interval 1 month"))).alias("m"))
    return all_of.join(m.distinct(), "m", "left_anti").select(F.date_format("m", "yyyy-MM").alias("month"))


def out_of_order(df: DataFrame, place: str, value: str, part: Column) -> DataFrame:
    """Rows whose value is below that of the row before, by an explicit row-order column. The comparison runs inside
    parts of that order; the ends of the parts are compared afterwards, so no task sees all rows."""
    rows = df.select(F.col(place).alias("p"), F.col(value).alias("v"), part.alias("g"))
    w = Window.partitionBy("g").orderBy("p")
    inside = rows.withColumn("b", F.lag("v").over(w)).groupBy("g").agg(F.count_if(F.col("v") < F.col("b")).alias("n"), F.min_by("v", "p").alias("first"), F.max_by("v", "p").alias("last"))
    ends = inside.withColumn("before", F.lag("last").over(Window.orderBy("g")))  # one row for each part
    return ends.agg((F.sum("n") + F.count_if(F.col("first") < F.col("before"))).alias("inversions"), (F.sum("n") + F.count_if(F.col("first") < F.col("before")) == 0).alias("chronological"))


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), as_text: bool = True) -> DataFrame:
    """Wide to long: ``variable``, ``value``."""
    cast = "string" if as_text else "double"
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(cast).alias("value")) for c in columns])))


def near_constant(df: DataFrame, columns: Sequence[str], limit: float = 0.99) -> DataFrame:
    """Share of the most frequent value (null counts as one), and flags."""
    counts = unpivoted(df, columns).groupBy("variable", "value").agg(F.count("*").alias("c"))
    top = counts.groupBy("variable").agg((F.max("c") / F.sum("c")).alias("s"), F.count("*").alias("levels"))
    return top.select("variable", "levels", F.round("s", 6).alias("top_share"), (F.col("levels") == 1).alias("constant"), (F.col("s") >= limit).alias("near_constant"))


def leakage_alarms(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], special: Mapping[str, Sequence[float]] = {}, corr_limit: float = 0.80, low: float = 0.005, high: float = 0.995, least: int = 100, gap: float = 0.20) -> DataFrame:
    """Predictors that know the label too well: by correlation, by a category's rate, by a special code's rate."""
    y = F.col(label).cast("double")
    corr = long_rows(df, {c: {"v": F.corr(F.col(c).cast("double"), y)} for c in numeric}, ("v",), "variable").where(F.abs("v") >= corr_limit).select("variable", F.lit("correlation").alias("alarm"), F.lit("").alias("level"), F.round("v", 6).alias("value"))
    levels = unpivoted(df, categorical, [label]).groupBy("variable", "value").agg(F.count("*").alias("n"), F.avg(y).alias("v")).where((F.col("n") >= least) & ((F.col("v") <= low) | (F.col("v") >= high)))
    out = corr.union(levels.select("variable", F.lit("category"), F.coalesce("value", F.lit("")), F.round("v", 6)))
    if special:
        fields = {f"{c}|{int(s)}": {"n": F.count_if(F.col(c) == s), "v": F.avg(F.when(F.col(c) == s, y)) - F.avg(F.when((F.col(c) != s) | F.col(c).isNull(), y))} for c, codes in special.items() for s in codes}
        rows = long_rows(df, fields, ("n", "v"), "variable").where((F.col("n") >= least) & (F.abs("v") >= gap))
        out = out.union(rows.select(F.split("variable", r"\|")[0], F.lit("special_code"), F.split("variable", r"\|")[1], F.round("v", 6)))
    return out


def categorical_diagnosis(df: DataFrame, columns: Sequence[str], rare: float = 0.01, top: int = 5) -> DataFrame:
    """Levels, missing, dominant level and its share, rare levels, the first few as text."""
    counts = unpivoted(df, columns).groupBy("variable", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    order = F.array_sort(F.collect_list(F.when(known, F.struct((-F.col("n")).alias("m"), F.col("value").alias("value")))))  # few levels
    g = counts.groupBy("variable").agg(F.count_if(known).alias("levels"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"), F.sum("n").alias("total"), order.alias("o"), F.collect_list(F.when(known, F.col("n"))).alias("ns"))
    first = F.get("o", F.lit(0))
    return g.select("variable", "levels", "missing", first["value"].alias("dominant"), F.round(-first["m"] / F.col("total"), 6).alias("dominant_share"), F.size(F.filter("ns", lambda x: x < rare * F.col("total"))).cast("long").alias("rare_levels"), F.array_join(F.transform(F.slice("o", 1, top), lambda x: F.concat(x["value"], F.lit(":"), (-x["m"]).cast("string"))), "; ").alias("top"))


def special_codes(df: DataFrame, column: str, codes: Sequence[float], label: str, vintage: str) -> DataFrame:
    """For each code: rows, share, vintages, event rate with and without it, difference."""
    is_ = {int(c): F.coalesce(F.col(column) == c, F.lit(False)) for c in codes}
    y = F.col(label).cast("double")
    fields = {str(c): {"n": F.count_if(m), "share": F.round(F.count_if(m) / F.count("*"), 6), "vintages": F.count_distinct(F.when(m, F.col(vintage))), "rate_with": F.round(F.avg(F.when(m, y)), 6), "rate_without": F.round(F.avg(F.when(~m, y)), 6)} for c, m in is_.items()}
    return long_rows(df, fields, ("n", "share", "vintages", "rate_with", "rate_without"), "code").withColumn("difference", F.round(F.col("rate_with") - F.col("rate_without"), 6))


def vintage_contract(df: DataFrame, key: str, label: str, vintage: str) -> DataFrame:
    """One row per id, a binary target, the vintages."""
    return df.agg((F.count("*") == F.countDistinct(key)).alias("one_row_per_id"), F.bool_and(F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("binary_target"), F.countDistinct(vintage).alias("vintages"), F.min(vintage).alias("first"), F.max(vintage).alias("last"))


def cross_field(df: DataFrame, code: Column, banded: Column, number: Column) -> DataFrame:
    """A coded band against the band of a number: both filled, disagreements, number not a number."""
    both = code.isNotNull() & banded.isNotNull()
    return df.agg(F.count_if(code.isNotNull()).alias("code_filled"), F.count_if(banded.isNotNull()).alias("band_filled"), F.count_if(both).alias("both"), F.count_if(both & (code != banded)).alias("disagree"), F.count_if(number.isNull()).alias("not_numeric"))


def mixed_groups(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Groups with more than one value in a column that should be constant, with the values."""
    g = df.groupBy(group).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns], *[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(f"{c}_values") for c in columns])
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(f"n_{c}") > 1)
    return g.where(bad)


def split_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """How many groups each pair of splits shares."""
    s = df.select(group, split).distinct()
    x, y = s.select(F.col(group), F.col(split).alias("a")), s.select(F.col(group), F.col(split).alias("b"))
    return x.join(y, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared_groups"))


def exact_duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content another row has too, with its digest and the size of the group."""
    hashed = df.select(key, F.md5(content).alias("digest"))
    sizes = hashed.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    return hashed.join(sizes, "digest").select(key, "digest", "copies")


def array_audit(df: DataFrame, key: str, values: str, group: str) -> DataFrame:
    """Readable or not, and mean of the items' mean, deviation and extremes, by group."""
    x = F.transform(values, lambda v: v.cast("double"))
    n = F.size(values)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(x) / n
    per = df.select(group, F.coalesce(n > 0, F.lit(False)).alias("readable"), mean.alias("mean"), F.array_min(x).alias("low"), F.array_max(x).alias("high"), x.alias("x"), n.alias("n"))
    per = per.withColumn("sd", F.sqrt(total(F.transform("x", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / F.col("n")))
    return per.groupBy(group).agg(F.count("*").alias("items"), F.count_if(~F.col("readable")).alias("unreadable"), F.round(F.avg("mean"), 5).alias("mean"), F.round(F.avg("sd"), 5).alias("sd"), F.round(F.min("low"), 5).alias("min"), F.round(F.max("high"), 5).alias("max"))


def input_guard(df: DataFrame, probability: str, label: str, key: str | None = None) -> DataFrame:
    """Findings about probabilities and labels; ``guarded`` raises on them."""
    p, y = F.col(probability).cast("double"), F.col(label)
    checks = [F.count("*").alias("n"), F.count_if(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))).alias("not_finite"), F.count_if((p < 0) | (p > 1)).alias("out_of_range"), F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_labels"), F.countDistinct(y).alias("classes")]
    if key:
        checks.append((F.count("*") - F.countDistinct(key)).alias("repeated_keys"))
    return df.agg(*checks)


def guarded(df: DataFrame, probability: str, label: str, key: str | None = None) -> DataFrame:
    found = input_guard(df, probability, label, key).first().asDict()
    if any(found.get(k) for k in ("not_finite", "out_of_range", "bad_labels", "repeated_keys")) or found["classes"] < 2:
        raise ValueError(f"probabilities or labels can't be used: {found}")
    return df
