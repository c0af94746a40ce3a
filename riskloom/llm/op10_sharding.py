"""Operator 10: contiguous balanced shards from global prefix sums of sizes, in DataFrame functions only.

Documents keep the order of their ids, and those of one id (or of none) that of their sizes and checksums, so that they are no single
task. One pass takes each document's size, so texts aren't shuffled. The partitions of a range exchange by this order each sum up
their sizes; running sums over these totals (a row for each partition, whatever the number of documents) give every range its
place, and a window inside a range gives every document its own. A document goes to the shard in whose equal share of
all bytes its middle lies.

Defined results: a null text has no bytes and counts 8; documents of one id are ordered by size and checksum, null ids come
first; repeated rows are placed one after the other; an empty table gives an empty table; other columns are left out,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import documents, write_stage

SHARDS = 24


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id, size, text_crc32, shard, slot``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # sizes are written before the range exchange looks at its input twice; the ranges are written with their numbers
    ranged = write_stage(write_stage(slim, "sizes").repartitionByRange("doc_id", "size", "text_crc32").select("*", F.spark_partition_id().alias("nth")), "ranges")
    totals = ranged.groupBy("nth").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = totals.select("nth", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("all_bytes"))
    inside = Window.partitionBy("nth").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select("*", (F.sum("size").over(inside) - F.col("size")).alias("bytes_here"), (F.count("*").over(inside) - 1).alias("rows_here")).join(F.broadcast(places), "nth")
    middle = (F.col("bytes_before") + F.col("bytes_here")) * 2 + F.col("size")
    # (middle / 2) / (all / shards), in whole numbers
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / (F.col("all_bytes") * 2)))
    placed = write_stage(placed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rows_before") + F.col("rows_here")).alias("row")), "shards")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE_SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
 h AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g'), ' '), lambda x: x <> '') AS hx FROM documents),
 c AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_concat([4294967295], list_transform(hx, lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)::BIGINT AS text_crc32 FROM h, t),
 o AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
 s AS (SELECT *, least(23, floor(((before * 2 + size) * 24) / (total * 2)))::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""
