"""Operator 3: token ids as binary files of shuffled planes.

``write_tokens`` encodes documents, orders them by id and writes a dataset with two tables: ``chunks``, whose rows
each hold one block of ids as compressed byte or bit planes with the documents in it, and ``index``, the chunk index with each
block's global first id. ``read_tokens`` reads a dataset back, block by block.

Plan: one range exchange of the texts by id puts them in order; each task encodes its range and cuts fixed-size blocks,
so memory holds one Arrow batch and one block. Only the ids per range (one number each) are summed up to find where a
range starts. Spark's writer commits the files, so a lost executor repeats its tasks and leaves no half files.

Block format (fixed): magic ``PLN1``, kind of plane (``B`` byte, ``b`` bit), number of planes (1 byte), number of ids
(unsigned 32-bit), compressed length of each plane (unsigned 32-bit), then the planes, zstandard each. All little-endian.

Defined results: a null or empty text holds the end id only; null ids come first; documents of one id are ordered by text;
repeated rows are written again; an empty table gives an empty dataset; other columns are left out, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import documents, in_small_batches, new_path, tokenizer_file

MAGIC = b"PLN1"
#: Ids in a block.
BLOCK_IDS = 65_536


def pack_block(ids, planes: str = "byte", level: int = 1) -> bytes:
    """``ids``: numpy array of unsigned 32-bit integers."""
    import numpy as np
    import zstandard

    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    rows = octets if planes == "byte" else np.unpackbits(octets, axis=0, bitorder="little").reshape(4, 8, -1).reshape(32, -1) if len(ids) else octets[:0]
    if planes == "bit":
        rows = np.packbits(rows, axis=1, bitorder="little")
    zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
    packed = [zstd.compress(r.tobytes()) for r in rows]
    head = MAGIC + (b"B" if planes == "byte" else b"b") + struct.pack(f"<BI{len(packed)}I", len(packed), len(ids), *map(len, packed))
    return head + b"".join(packed)


def unpack_block(block: bytes):
    """The ids of a block as a numpy array."""
    import numpy as np
    import zstandard

    if block[:4] != MAGIC or block[4:5] not in (b"B", b"b"):
        raise ValueError("not a block of planes")
    n_planes, n = struct.unpack_from("<BI", block, 5)
    lengths = struct.unpack_from(f"<{n_planes}I", block, 10)
    at, rows, zstd = 10 + 4 * n_planes, [], zstandard.ZstdDecompressor()
    for length in lengths:
        rows.append(np.frombuffer(zstd.decompress(block[at : at + length]), np.uint8))
        at += length
    if not n:
        return np.zeros(0, "<u4")
    if block[4:5] == b"b":
        bits = np.unpackbits(np.stack(rows), axis=1, count=n, bitorder="little")
        rows = np.packbits(bits.reshape(4, 8, n), axis=1, bitorder="little").reshape(4, n)
    return np.ascontiguousarray(np.stack(rows).T).view("<u4").reshape(-1)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """Crc32 of byte strings one after the other, from each one's (length, crc32)."""
    whole = 0
    for length, crc in parts:
        zeros = bytes(length)
        whole = zlib.crc32(zeros, whole) ^ zlib.crc32(zeros) ^ crc
    return whole


_CHUNK = "range int, chunk int, first long, n_ids int, {id}, doc_first array<long>, begin array<int>, block binary"


def write_tokens(docs: DataFrame, path: str, vocab_path: str, end_id: int, planes: str = "byte", block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the dataset at ``path``. A chunk's lists tell which documents lie in it, where in the range each starts
    (``doc_first``) and where in the block its part begins (``begin``)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from riskloom.llm.chunks import LibraryEncoder, encoder
        from riskloom.llm.common import slices

        to_ids, end = encoder(LibraryEncoder, vocab_path), struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        id_type = None
        chunk, first, held, size, lists = 0, 0, [], 0, ([], [], [])

        def cut(data: bytes):
            row = [[part], [chunk], [first], [len(data) // 4]]
            cols = [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)]
            cols += [pa.array([v], pa.list_(t)) for v, t in zip(lists, (id_type, pa.int64(), pa.int32()), strict=True)]
            cols.append(pa.array([pack_block(np.frombuffer(data, "<u4"), planes)], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, ["range", "chunk", "first", "n_ids", "doc_ids", "doc_first", "begin", "block"])

        for batch in slices(batches):
            id_type = batch.schema.field(0).type
            for doc, data in zip(batch.column(0).to_pylist(), to_ids.encode_all(batch.column(1).to_pylist()), strict=True):
                data, doc_first = data + end, first + size
                while data:
                    lists[0].append(doc), lists[1].append(doc_first), lists[2].append(size)
                    fits = 4 * (block_ids - size)
                    held.append(data[:fits])
                    size += len(held[-1]) // 4
                    data = data[fits:]
                    if size == block_ids:
                        yield cut(b"".join(held))
                        chunk, first, held, size, lists = chunk + 1, first + size, [], 0, ([], [], [])
        if size:
            yield cut(b"".join(held))

    ordered = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _CHUNK.format(id=f"doc_ids array<{kind}>")).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = docs.sparkSession.read.parquet(f"{path}/chunks").select("range", "chunk", "first", "n_ids", F.octet_length("block").alias("n_bytes"))
    # one row for each range: as many as the exchange has partitions, whatever the size of the data
    starts = chunks.groupBy("range").agg(F.sum("n_ids").alias("ids")).select("range", (F.sum("ids").over(Window.orderBy("range")) - F.col("ids")).alias("range_first"))
    chunks.join(F.broadcast(starts), "range").withColumn("global_first", F.col("range_first") + F.col("first")).write.parquet(f"{path}/index")


def read_segments(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row for each part of a document in a block: ``range, doc_first, doc_id, at, n, crc`` (``at``: place in the range), and its ``ids``."""
    chunks = spark.read.parquet(f"{path}/chunks")
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from riskloom.llm.common import slices

        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                data, ends = unpack_block(row["block"]).tobytes(), [*row["begin"][1:], row["n_ids"]]
                n = len(ends)
                cols = [pa.array([row["range"]] * n, pa.int32()), pa.array(row["doc_first"], pa.int64()), pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type)]
                cols.append(pa.array([row["first"] + b for b in row["begin"]], pa.int64()))
                parts = [data[4 * a : 4 * b] for a, b in zip(row["begin"], ends, strict=True)]
                cols += [pa.array([len(x) // 4 for x in parts], pa.int64()), pa.array(map(zlib.crc32, parts), pa.int64())]
                if ids:
                    cols.append(pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["range", "doc_first", "doc_id", "at", "n", "crc", "ids"][: len(cols)])

    return chunks.select("range", "first", "n_ids", "doc_ids", "doc_first", "begin", "block").mapInArrow(run, f"range int, doc_first long, doc_id {kind}, at long, n long, crc long" + ", ids binary" * ids)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``; the ids themselves
    are in ``read_segments``. A part's crc is taken beside its ids, and only the crcs of a document's parts are brought together."""

    @F.pandas_udf("long")
    def whole_crc(parts):
        return parts.map(lambda p: None if p is None else joined_crc([(4 * x["n"], x["crc"]) for x in p])).astype("Int64")

    parts = read_segments(spark, path, ids=False).select("range", "doc_first", "doc_id", F.struct("at", "n", "crc").alias("part"))
    whole = parts.groupBy("range", "doc_first", "doc_id").agg(F.sum("part.n").alias("n_tokens"), F.sort_array(F.collect_list("part")).alias("parts"))
    # documents that lie in one block, as most do, have their crc already
    whole = whole.withColumn("cut", F.when(F.size("parts") > 1, F.col("parts"))).withColumn("crc", F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["crc"])).drop("parts")
    starts = spark.read.parquet(f"{path}/index").where("chunk = 0").select("range", "range_first")
    return whole.join(F.broadcast(starts), "range").select("doc_id", (F.col("range_first") + F.col("doc_first")).alias("start"), "n_tokens", F.coalesce("crc", whole_crc("cut")).alias("ids_crc32"))


def op3_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, tokenizer_file(), end_id=1)
    return read_tokens(spark, path)
