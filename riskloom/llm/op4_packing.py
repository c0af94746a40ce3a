"""Operator 4: best-fit packing of documents into sequences by bin completion.

Only a document longer than a sequence is cut. Packing looks at lengths alone, and there are at most as many
lengths as a sequence has places: the table of counts by length (a grouped count, at most ``capacity`` rows) goes to the driver,
``bin_completion`` decides on patterns for it, and the resulting table (at most ``capacity`` steps with under 64 lengths
each, whatever the size of the corpus) is broadcast. Every piece then finds its place from its rank among the pieces of its length.
Ranks are counted in salted parts of a length, with the parts' sizes summed up before, so a length that holds a third of
all pieces is spread over tasks. Ids never leave the task that encodes them.

Defined results: a null or empty text is a piece with the end id only; repeated rows are packed again; an empty table gives an
empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.bin_completion import complete_bins
from riskloom.llm.common import documents, in_small_batches, tokenizer_file, write_stage

#: Places in a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 0
#: Nodes of the search for a packing.
NODES = 3000
#: Pieces of one length that one task ranks, about.
PART_ROWS = 200_000


def cut_pieces(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id, piece, start, length, ids_crc32``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from riskloom.llm.chunks import LibraryEncoder, encoder
        from riskloom.llm.common import slices

        to_ids, end = encoder(LibraryEncoder, vocab_path), struct.pack("<I", end_id)
        for batch in slices(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, data in enumerate(to_ids.encode_all(batch.column(1).to_pylist())):
                data += end
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    at.append(i), piece.append(k), start.append(a // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            cols = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packing_table(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``length, rank_from, rank_to, first_sequence, copies, base``: the pieces of a length with these ranks go to
    sequences from ``first_sequence`` on, ``copies`` to each, from place ``base``. ``nodes`` bounds the search: with more of them it goes on until
    no better packing is left."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, bins in complete_bins(counts, capacity, nodes):
        base = 0
        for length, copies in pattern:
            begin = used.get(length, 0)
            used[length] = begin + bins * copies
            rows.append((length, begin, used[length], sequence, copies, base))
            base += length * copies
        sequence += bins
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (a written table, as it is read twice) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = spark.createDataFrame(packing_table(counts, capacity, nodes), "length long, rank_from long, rank_to long, first_sequence long, copies long, base long")
    salts = 4 + sum(counts.values()) // PART_ROWS
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("rank", local.cast("long") - 1).join(parts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (ranked["rank"] >= table["rank_from"]) & (ranked["rank"] < table["rank_to"])).drop(table["length"])
    nth = F.col("rank") - F.col("rank_from")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("base") + F.pmod(nth, F.col("copies")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = NODES) -> DataFrame:
    return pack(write_stage(cut_pieces(docs, vocab_path, capacity, end_id), "pieces"), capacity, nodes)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file())
