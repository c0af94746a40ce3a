"""Sources and sinks: text-typed CSV, parquet, JSON lines, yearly collections, result tables."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system (local, HDFS, object store)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Every column stays text, so codes keep leading zeros; empty cells become null."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False)
    return df.select(*columns) if columns else df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V1: raises if a required column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def csv_to_parquet(spark: SparkSession, source: str, target: str, required: Sequence[str] = (), **csv) -> DataFrame:
    """Zstd parquet of a text-typed CSV. Never replaces a target; an input without rows is an error and leaves none."""
    if exists(spark, target):
        raise FileExistsError(target)
    df = require_columns(read_text_csv(spark, source, **csv), required)
    if df.isEmpty():
        raise ValueError(f"{source} has no rows")
    df.write.mode("errorifexists").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where=None) -> DataFrame:
    """S3: scan with pruned columns; the filter is on source columns, so it reaches the files."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType | str, dates: Mapping[str, str] = {}, sep: str = ",") -> DataFrame:
    """Explicit types; ``dates`` (column to pattern) are parsed late, bad ones become null."""
    df = spark.read.csv(path, header=True, sep=sep, schema=schema)
    return coerce_dates(df, dates)


def coerce_dates(df: DataFrame, dates: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(p)).cast("date") for c, p in dates.items()}) if dates else df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lists and nested values by an explicit schema, without a pass to infer one."""
    return spark.read.schema(schema).json(path)


def upper_names(df: DataFrame) -> DataFrame:
    """Columns by upper-case name; two names that differ only by case are an error."""
    names = [c.upper() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("column names collide when compared without case")
    return df.toDF(*names)


def read_years(spark: SparkSession, paths: Mapping[int, str], year_column: str = "ano") -> DataFrame:
    """One table of all years that are there, names in upper case, columns that a year lacks as null."""
    found = None
    for year, path in sorted(paths.items()):
        if exists(spark, path):
            part = upper_names(spark.read.parquet(path)).withColumn(year_column, F.lit(year))
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    if found is None:
        raise FileNotFoundError("no year is there")
    return found


def union_years(parts: Mapping[int, DataFrame], year_column: str = "ano") -> DataFrame:
    """S6 for frames: align columns by name, missing ones null, and add the year."""
    found = None
    for year, df in sorted(parts.items()):
        part = df.withColumn(year_column, F.lit(year))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Bases as parquet, result tables as CSV."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.parquet(f"{folder}/{name}") if fmt == "parquet" else writer.csv(f"{folder}/{name}", header=True)


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.nanvl(c, F.lit(None).cast(kinds[c])).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def metrics_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, with NaN as null (kept as a field)."""
    return nan_to_null(df).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_metrics(df: DataFrame, path: str) -> None:
    metrics_json(df).write.mode("overwrite").text(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new, list(keys), "left_anti").select(*old.columns).unionByName(new)


def inventory(spark: SparkSession, paths: Mapping[int, str], fields: Sequence[str], count_rows: bool = False) -> DataFrame:
    """Per year: available, number of columns, missing fields, whether names had to be put in upper case; with ``count_rows`` also ``n_rows``,
    counted in one pass over all years that are there."""
    if count_rows:
        base, parts = inventory(spark, paths, fields), []
        for row in base.where("available").collect():  # a row for each year
            parts.append(spark.read.parquet(paths[row["ano"]]).select(F.lit(row["ano"]).alias("__ano")))
        if not parts:
            return base.withColumn("n_rows", F.lit(None).cast("long"))
        counted = functools.reduce(DataFrame.unionByName, parts).groupBy("__ano").agg(F.count("*").alias("n"))
        joined = base.join(F.broadcast(counted), F.col("ano") == F.col("__ano"), "left")
        return joined.select(*base.columns, F.when(F.col("available"), F.coalesce("n", F.lit(0))).alias("n_rows"))
    rows = []
    for year, path in sorted(paths.items()):
        try:
            names = spark.read.parquet(path).columns
        except AnalysisException:
            rows.append((year, False, None, None, None))
            continue
        upper = {c.upper() for c in names}
        rows.append((year, True, len(names), ",".join(f for f in fields if f.upper() not in upper), any(c != c.upper() for c in names)))
    return spark.createDataFrame(rows, "ano int, available boolean, n_columns int, missing_fields string, case_normalised boolean")


def split_export(df: DataFrame, condition, names: tuple[str, str] = ("with_window", "without_window")) -> DataFrame:
    """Tags each row with the base it belongs to (for ``write.partitionBy('split')``); null counts as not."""
    return df.withColumn("split", F.when(F.coalesce(condition, F.lit(False)), names[0]).otherwise(names[1]))


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("errorifexists").partitionBy(column).parquet(path)
