"""Column expressions: treatment and outcome codes, categories, masks, parsing. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "IGNORADO"
MISSING = "__MISSING__"


def integer_code(code: Column) -> Column:
    """A code of digits as an integer, anything else null (``try_cast`` alone would also take '3.0' in other engines)."""
    trimmed = F.trim(code)
    return F.when(trimmed.rlike("^[0-9]+$"), trimmed.try_cast("int"))


def treatment(month_code: Column, early: tuple[int, int] = (1, 3), late: tuple[int, int] = (4, 9)) -> Column:
    """1 for a start in the early months, 0 in the late ones, else null."""
    m = integer_code(month_code)
    return F.when(m.between(*early), 1).when(m.between(*late), 0)


def outcome(value: Column, rule: str = "P0", threshold: float = 2500.0, low: float = 500.0, high: float = 6000.0) -> Column:
    """1 below the threshold, 0 from it on; null where the quality rule fails (P0: above zero, P1: within low and high)."""
    if rule not in ("P0", "P1"):
        raise ValueError(f"quality rule {rule} isn't known")
    good = value > 0 if rule == "P0" else value.between(low, high)
    return F.when(good, F.when(value < threshold, 1).otherwise(0))


def equals_or_false(code: Column, value) -> Column:
    """Equality in which null is false."""
    return F.coalesce(code == F.lit(value), F.lit(False))


def region_prefix(code: Column, digits: int = 6, length: int = 2, missing: str | None = None) -> Column:
    """First digits of a code of exactly so many digits, else ``missing``."""
    found = F.when(code.rlike(f"^[0-9]{{{digits}}}$"), F.substring(code, 1, length))
    return found if missing is None else F.coalesce(found, F.lit(missing))


def category(code: Column, unknown: Sequence[int] = (9, 99), normalise: bool = True) -> Column:
    """Codes as text without leading zeros; null and unknown codes become IGNORADO. With ``normalise`` text that is no number stays null."""
    if not normalise:
        t = F.trim(code)
        return F.when(t.isNull() | t.isin(*map(str, unknown)), UNKNOWN).otherwise(t)
    n = integer_code(code)
    return F.when(code.isNull() | n.isin(*unknown), UNKNOWN).otherwise(n.cast("string"))


def count_category(code: Column, unknown: int = 99) -> Column:
    """0, 1 or 2_OU_MAIS; unknown and invalid codes become IGNORADO."""
    n = integer_code(code)
    return F.when(n.isNull() | (n == unknown), UNKNOWN).when(n >= 2, "2_OU_MAIS").otherwise(n.cast("string"))


def range_mask(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def merge_levels(level: Column, groups: Mapping[str, str]) -> Column:
    """Levels by a declared map; a level that the map doesn't have is an error."""
    merged = F.lit(None).cast("string")
    for old, new in reversed(list(groups.items())):
        merged = F.when(level == old, new).otherwise(merged)
    return F.when(level.isNull() | level.isin(*groups), merged).otherwise(F.raise_error(F.concat(F.lit("level isn't declared: "), level)).cast("string"))


def special_state(value: Column, codes: Sequence[float]) -> Column:
    """The special code as text, REGULAR or MISSING."""
    return F.when(value.isNull(), "MISSING").when(value.isin(*codes), value.cast("long").cast("string")).otherwise("REGULAR")


def mask_special(value: Column, codes: Sequence[float]) -> Column:
    return F.when(~value.isin(*codes), value)


def special_indicators(df: DataFrame, column: str, codes: Sequence[float]) -> DataFrame:
    """Adds a 0/1 column for each special code and one for missing values."""
    flags = {f"{column}_is_{int(c)}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in codes}
    return df.withColumns(flags | {f"{column}_is_missing": F.col(column).isNull().cast("int")})


def categorical_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is above zero."""
    return F.when(denominator > 0, numerator / denominator)


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / 365.25


def clean_text(value: Column, default: str = "Não informado") -> Column:
    return F.coalesce(F.trim(value), F.lit(default))


def operation_id(entity: Column, day: Column) -> Column:
    return F.concat_ws("_", entity.cast("string"), F.date_format(day, "yyyyMMdd"))


def month_end_after(day: Column, months: int = 12) -> Column:
    return F.last_day(F.add_months(day, months))


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def parse_month(code: Column) -> Column:
    """YYYYMM as the first day of the month; an invalid code is an error."""
    return F.to_date(code.cast("string"), "yyyyMM")


def bands(value: Column, bounds: Sequence[float], labels: Sequence[str], missing: str = UNKNOWN, right: bool = True) -> Column:
    """Bands between bounds (closed on the right, or on the left); values outside and null become ``missing``. Infinite ends are open."""
    if len(labels) != len(bounds) - 1:
        raise ValueError("one label for each band is needed")
    found = F.lit(missing)
    for low, high, label in reversed(list(zip(bounds[:-1], bounds[1:], labels, strict=True))):
        above = F.lit(True) if low == float("-inf") else (value > low if right else value >= low)
        below = F.lit(True) if high == float("inf") else (value <= high if right else value < high)
        found = F.when(value.isNotNull() & above & below, label).otherwise(found)
    return found


def payload_value(props: Column, *keys: str) -> Column:
    """The first of several spellings of a key in a JSON text."""
    return F.coalesce(*[F.get_json_object(props, f"$['{k}']") for k in keys])


def key_signature(props: Column) -> Column:
    return F.array_join(F.array_sort(F.json_object_keys(props)), ",")


def dashed_id(name: Column, parts: int = 3, sep: str = "-") -> tuple[Column, Column]:
    """First parts of a dashed name, and the number that follows them."""
    pieces = F.split(name, sep)
    return F.array_join(F.slice(pieces, 1, parts), sep), F.try_element_at(pieces, F.lit(parts + 1)).try_cast("int")


def yes_no(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("sim", "s", "yes", "y", "true", "1", "x"), True).when(t.isin("não", "nao", "n", "no", "false", "0", ""), False)


def local_number(text: Column) -> Column:
    """Numbers with dots between thousands and a decimal comma."""
    return F.translate(F.translate(F.trim(text), ".", ""), ",", ".").try_cast("double")


def count_and_percent(text: Column) -> tuple[Column, Column]:
    """Cells such as "1.234 (5,6%)"."""
    pattern = r"^\s*([0-9.]+)\s*\(\s*([0-9.,]+)\s*%\s*\)\s*$"
    return F.translate(F.regexp_extract(text, pattern, 1), ".", "").try_cast("long"), local_number(F.regexp_extract(text, pattern, 2))


def outcome_tag(label: Column, predicted: Column) -> Column:
    return F.when((label == 1) & (predicted == 1), "TP").when((label == 0) & (predicted == 0), "TN").when((label == 0) & (predicted == 1), "FP").when((label == 1) & (predicted == 0), "FN")


def complete_case(columns: Sequence[str]) -> Column:
    """Whether no column is null or IGNORADO."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.col(c).cast("string") != UNKNOWN)
    return ok


def find_column(df: DataFrame, name: str) -> str:
    """A column by its name in any case; two such columns are an error."""
    found = [c for c in df.columns if c.upper() == name.upper()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}")
    return found[0]


def standardised(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Numbers: median for missing values, an indicator, z-score with the population deviation. Categories: mode (smallest
    on ties) for missing values, one 0/1 column per level. Returns the new columns' names too.

    Statistics come from one aggregation, levels from one grouped count for each category; both are small.
    """
    from pyspark.sql import Window

    from riskloom.operators.ordered import quantiles

    names: list[str] = []
    if numeric:
        med = {row["variable"]: row["q0"] for row in quantiles(df, [], numeric, (0.5,)).collect()}  # a row for each column
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(med.get(c)).cast("double")) for c in numeric}
        stats = df.agg(*[f(filled[c]).alias(f"{c}_{n}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        for c in numeric:
            spread = stats[f"{c}_s"] or 1.0
            df = df.withColumns({f"{c}_z": (filled[c] - stats[f"{c}_m"]) / spread, f"{c}_missing": F.col(c).isNull().cast("double")})
            names += [f"{c}_z", f"{c}_missing"]
    for c in categorical:
        order = Window.orderBy(F.desc("n"), F.asc(c))  # over the few levels
        levels = [r[c] for r in df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).orderBy("r").collect()]
        value = F.coalesce(F.col(c), F.lit(levels[0] if levels else None))
        for level in sorted(levels):
            df = df.withColumn(f"{c}={level}", (value == level).cast("double"))
            names.append(f"{c}={level}")
    return df, names
