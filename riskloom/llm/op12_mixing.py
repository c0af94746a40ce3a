"""Operator 12: mixing sources to target weights by hash-random order and prefix sums of word counts.

Every document gets a key from a hash of its id. A range exchange by (source, key) puts each source's documents in random order
over many tasks, a hot source as well as a cold one; each range adds up its own words in that order, and sums over the totals of the ranges before
(a row for each range and source) say where a range of a source starts. A source whose budget is e times its words and a rest takes each document e times,
and once more those that lie before the rest; the document on the cut gives only its first words, so a source takes its
budget to the word.

Targets: sources in the order of their code points, null last, have the weights in turn. They divide a share of all words by
weight; none may have more than a multiple of its own words, and what is over goes to the others by weight, until none is above. That
is one level L with target = least(L * weight, multiple * words); each round fixes the sources that L puts at their limit, and sums
over the table of sources give the next L.

Defined results: a null or empty text has no words and takes none; rows with a null id share a key and are ordered by size and
checksum; of repeated rows, which are alike, it isn't said which one the cut falls on; a source without words has the target 0; an empty table gives an empty
table; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import column, documents, words_of, write_stage

WEIGHTS = (5, 2, 1)
#: Words to take in all, and from one source at most, as multiples of what there is.
SHARE, MOST = 1.5, 2.0
SEED = "mix"


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (``source, source_size``, a row each) with ``weight`` and ``target``."""
    # the place of a source in the order of all: ranges by source, numbered where they lie, after the rows of the ranges before
    ranged = write_stage(sources.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source")).select("*", F.monotonically_increasing_id().alias("at")), "sources")
    nth, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(2**33 - 1)
    per = ranged.groupBy(nth.alias("nth")).agg(F.count("*").alias("rows"))  # a row for each range
    before = per.select("nth", F.coalesce(F.sum("rows").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    turn = F.pmod(F.col("before") + inside, F.lit(len(weights))).cast("int")
    placed = ranged.withColumn("nth", nth).join(before, "nth").select("source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"))
    limit, level = F.col("source_size") * most, 0.0
    while True:
        # those at their limit under this level, and what they leave to the weights of the others
        fixed = limit <= F.lit(level) * F.col("weight")
        everything, spent, open_weight = placed.agg(F.sum("source_size"), F.sum(F.when(fixed, limit)), F.sum(F.when(~fixed, F.col("weight")))).first()
        if not open_weight:
            break
        fresh = ((everything or 0) * share - (spent or 0.0)) / open_weight
        if fresh <= level:
            break
        level = fresh
    return placed.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Columns ``doc_id, source, size, source_size, target, taken``; a document is used ``taken / size`` times."""
    if most < share:
        raise ValueError(f"no source may give more than {most} of its words, so {share} of all can't be reached")
    text = column(text_col)
    key = F.md5(F.concat(F.lit(seed), F.coalesce(column(id_col).cast("string"), F.lit(""))).cast("binary"))
    slim = write_stage(docs.select(column(id_col).alias("doc_id"), column(source_col).alias("source"), F.coalesce(F.size(words_of(text)), F.lit(0)).cast("long").alias("size"), F.substring(key, 1, 16).alias("key"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("sum")).withColumn("size", F.greatest("size", F.lit(0))), "sizes")
    order = [F.asc_nulls_last("source"), F.asc("key"), F.asc("doc_id"), F.asc("size"), F.asc("sum")]
    # rows that are alike in all of these are dealt apart by their place in the table
    ranged = slim.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, F.asc("row")).sortWithinPartitions(*order)
    kind = "struct<nth:int,doc_id:{},source:{},size:bigint,before:bigint>".format(slim.schema["doc_id"].dataType.simpleString(), slim.schema["source"].dataType.simpleString())[7:-1]
    sorted_rows = ranged.select(F.spark_partition_id().alias("nth"), "doc_id", "source", "size")

    def sums_inside(batches):
        """Words of the same source that come before a document in its range. Rows come in order; the last source's sum is carried over batches."""
        import numpy as np
        import pyarrow as pa

        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(3).to_numpy()
            codes = batch.column(2).dictionary_encode(null_encoding="encode")
            codes, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            before = np.cumsum(size) - size
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            offset = -before[starts]
            if (names[codes[0]],) == last:
                offset[0] += carried
            before = before + np.repeat(offset, np.diff(np.r_[starts, len(size)]))
            last, carried = (names[codes[-1]],), int(before[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(before)], ["nth", "doc_id", "source", "size", "before"])

    placed = write_stage(sorted_rows.mapInArrow(sums_inside, kind), "ranges")
    totals = placed.groupBy("nth", "source").agg(F.sum("size").alias("words"))  # a row for each range and source
    run = Window.partitionBy("source").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("nth", "source", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("start"))
    wanted = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    plan = starts.alias("a").join(wanted.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.nth", F.col("a.source").alias("__source"), "start", "source_size", "target")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("before")))
    joined = placed.alias("p").join(plan.alias("q"), (F.col("p.nth") == F.col("q.nth")) & F.col("source").eqNullSafe(F.col("__source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS key FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
 w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
 o AS (SELECT *, cap / weight AS ratio, sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS spent, sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) + weight AS open_weight, sum(source_size) OVER () * 1.5::DOUBLE AS whole FROM w),
 l AS (SELECT coalesce((SELECT (whole - spent) / open_weight FROM o WHERE (whole - spent) / open_weight < ratio ORDER BY ratio, source NULLS LAST LIMIT 1), (SELECT max(ratio) FROM o)) AS level),
 t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM o, l),
 p AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""
