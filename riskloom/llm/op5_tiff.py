"""Operator 5: media columns of TIFF files.

``store_texts`` makes a binary column of TIFF files, ``read_pages`` walks the image directories of such a column and emits
one row per page, ``features`` turns the pages of a file into features. All are narrow: no shuffle, and a task
holds one file and one page beside its batch. Files lie in a table of the shared folder, written without further compression.

Defined results: a null or empty text is one row of 576 bytes 255; a null file has no pages; repeated rows give
repeated files; an empty table gives an empty table; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import documents, in_small_batches, write_stage

#: Bytes in a row of a page, rows in a page and in a strip.
ROW_BYTES, PAGE_ROWS, STRIP_ROWS = 576, 256, 64
#: Bytes of media or samples in one Arrow batch, about.
BATCH_BYTES = 8_000_000


def store_texts(docs: DataFrame, compression: int = 8, predictor: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id, n_bytes, media``: the text's bytes, filled up with 255 to whole rows, as pages of a TIFF file."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from riskloom.llm.common import slices
        from riskloom.llm.tiff import write_tiff

        for batch in slices(batches):
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                sizes.append(len(data))
                data += b"\xff" * (-len(data) % ROW_BYTES if data else ROW_BYTES)
                rows = np.frombuffer(data, np.uint8).reshape(-1, ROW_BYTES)
                media.append(write_tiff([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], compression, predictor, STRIP_ROWS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_pages(files: DataFrame) -> DataFrame:
    """One row per page: ``doc_id, n_bytes, media_bytes, media_sha256, page, width, height, channels, samples``.

    The pages of a file follow one another in order, in the task that read it.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from riskloom.llm.common import slices
        from riskloom.llm.tiff import read_tiff

        names = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "width", "height", "channels", "samples"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in slices(batches, 1000):
            rows, size = [], 0
            ids = batch.column(0)

            def made(rows, ids=ids):
                cols = list(zip(*rows, strict=True)) or [[]] * 9
                return pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int32())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], names)

            for i, (n_bytes, media) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if (media := media.as_py()) is None:
                    continue
                digest = hashlib.sha256(media).hexdigest()
                for number, page in enumerate(read_tiff(media)):
                    channels = 1 if page.ndim == 2 else page.shape[2]
                    rows.append((i, n_bytes, len(media), digest, number, page.shape[1], page.shape[0], channels, page.tobytes()))
                    size += page.size
                    if size > BATCH_BYTES:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    kind = files.schema["doc_id"].dataType.simpleString()
    return in_small_batches(files).select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, media_bytes long, media_sha256 string, page int, width int, height int, channels int, samples binary")


class _File:
    """What is gathered over the pages of one file."""

    def __init__(self, row):
        self.row, self.pages, self.size = row, 0, 0
        self.sha, self.tail, self.counts = hashlib.sha256(), b"", None

    def add(self, samples: bytes) -> None:
        import numpy as np

        self.pages += 1
        self.size += len(samples)
        self.sha.update(samples)
        self.tail = (self.tail + samples[-32:])[-32:]
        counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
        self.counts = counts if self.counts is None else self.counts + counts

    def done(self) -> tuple:
        counts = self.counts.tolist()
        total = sum(counts)
        mean = sum(i * c for i, c in enumerate(counts)) / total
        spread = math.sqrt(max(0.0, sum(i * i * c for i, c in enumerate(counts)) / total - mean * mean))
        entropy = -sum(c / total * math.log2(c / total) for c in counts if c)
        bands = ",".join(str(sum(counts[i : i + 32])) for i in range(0, 256, 32))
        feature = f"pages={self.pages};mean={mean:.4f};sd={spread:.4f};entropy={entropy:.4f};bands={bands}"
        return (*self.row, self.size, self.sha.hexdigest(), zlib.crc32(self.tail), feature)


def features(pages: DataFrame) -> DataFrame:
    """One row per file from the pages of ``read_pages``: digests of the samples, and features of their distribution."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
        types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        file, done = None, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for batch in batches:
            types[0] = batch.schema.field(0).type
            heads = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            for (*row, page), samples in zip(heads, batch.column(8), strict=True):
                if page == 0:
                    done += [file.done()] if file else []
                    file = _File(row)
                file.add(samples.as_py())
            if done:
                yield made()
                done = []
        if file:
            done = [file.done()]
            yield made()

    kind = pages.schema["doc_id"].dataType.simpleString()
    return in_small_batches(pages).mapInArrow(run, f"doc_id {kind}, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_stage(store_texts(documents(spark, sf_dir)), "tiff", "none")
    return features(read_pages(files)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
