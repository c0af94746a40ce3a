"""A corpus from raw documents to packed sequences: language, quality, lines, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.

In every stage: a null text is an empty one; repeated rows are rows of their own (near copies: copies); rows with a null or shared id are told apart by
their text; an empty table gives an empty one; columns beyond those of documents stay until packing, whatever their names (but for names that
begin with two underscores, which are the stages' own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import op2_language, op4_packing, op6_line_dedup, op7_quality, op8_ngram_join
from riskloom.llm.common import column, tokenizer_file, write_stage

#: Language identification and bin packing aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text that a stage has left."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*map(column, columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fused evidence rejects go, and with them empty texts and texts without letters. Of languages with equal posteriors the first
    by name counts; a verdict is the same for all rows with one id, text, language and source."""
    return op2_language.keep(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, as do texts of under 50 words; from the others, the lines that failed. A rule's limits belong to the side that is kept."""
    return _recounted(op7_quality.clean(docs), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines that match an earlier one go, and documents that are left without a word; a text that had none stays. Order is that of ids, then of
    texts, then of lines; of equal rows one comes first."""
    left = op6_line_dedup.dedup_lines(docs, counts=("__n_lines", "__n_removed")).where(F.expr(r"__n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'"))
    return _recounted(left, docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (of those with one id, the one with the smallest
    digest of its text); rows without an id stay. Texts that share an id are documents of their own."""
    named = docs.where("doc_id is not null").withColumn("__digest", F.xxhash64("text"))
    texts = named.select(F.struct("doc_id", "__digest").alias("doc_id"), "text")
    first = op8_ngram_join.jaccard_components(texts).where("doc_id = component_id").select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.__digest").alias("__its")).distinct()
    kept = named.join(first, (F.col("doc_id") == F.col("__id")) & (F.col("__digest") == F.col("__its")), "left_semi").dropDuplicates(["doc_id", "__digest"])
    return kept.select(*map(column, docs.columns)).unionByName(docs.where("doc_id is null"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and their place in it; an empty text is a piece with the end id only, and pieces of one length are placed by
    hash of id and piece, so equal rows are packed again."""
    return op4_packing.pack_documents(docs, tokenizer_file())


STAGES = [("language_id", language), ("quality_rules", quality), ("line_dedup", line_dedup), ("ngram_jaccard", near_copies), ("best_fit_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
