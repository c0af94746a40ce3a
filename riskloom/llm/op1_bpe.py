"""Operator 1: BPE encoding and decoding by a merge automaton.

``encode`` adds a document's ids (little-endian unsigned 32-bit integers), ``decode`` turns ids back into text. Both are
narrow: no shuffle, and a task holds one Arrow batch. The automaton is compiled once per Python worker from the
vocabulary file, whose path is a parameter.

Defined results: a null or empty text has no ids and decodes to the empty text; a null id column stays null; repeated rows give
repeated rows; an empty table gives an empty table; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import documents, in_small_batches, tokenizer_file


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Columns ``doc_id``, ``n_tokens`` and ``ids``; with ``decoded``, each text's ids are decoded in the same worker too."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from riskloom.llm.chunks import AutomatonEncoder, encoder
        from riskloom.llm.common import slices

        to_ids = encoder(AutomatonEncoder, vocab_path)
        label = to_ids.automaton.decode
        for batch in slices(batches):
            ids = to_ids.encode_all(batch.column(1).to_pylist())
            cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                cols.append(pa.array([label(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and ``decoded``: the labels that the ids stand for, with a space between."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from riskloom.llm.chunks import AutomatonEncoder, encoder
        from riskloom.llm.common import slices

        label = encoder(AutomatonEncoder, vocab_path).automaton.decode
        for batch in slices(batches):
            texts = [None if x is None else label(np.frombuffer(x, "<u4").tolist()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return in_small_batches(encoded).select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode(documents(spark, sf_dir), tokenizer_file(), decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
