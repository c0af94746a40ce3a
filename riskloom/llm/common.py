"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.staging import new_path, shared_dir  # noqa: F401

#: Characters that separate words: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

def write_stage(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    A lost executor then costs only its unfinished tasks, and later plans prune columns of the table.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # the shuffle files of what was written are let go once nothing refers to them
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator, rows: int = 200) -> Iterator:
    """Arrow batches in small parts, so that what a worker makes of one part is small too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_small_batches(df: DataFrame) -> DataFrame:
    """Texts go to Python workers in batches of 500: the default of 10000 holds too much memory with long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return df


def column(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; ``TOKENIZER_DIR`` overrides where they are kept."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space other than spaces and line ends; a text that has it is split by a pattern.
_ODD = ("\t", "\x0b", "\x0c", "\r")


def is_odd(text: Column) -> Column:
    """Whether words of the text are separated by anything but spaces and line ends."""
    found = F.contains(text, F.lit(_ODD[0]))
    for mark in _ODD[1:]:
        found = found | F.contains(text, F.lit(mark))
    return found


def words_of(text: Column) -> Column:
    """The words of a whole text, maximal runs of characters that aren't white space."""
    return F.array_remove(F.when(is_odd(text), F.split(text, SPACE)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")), "")
