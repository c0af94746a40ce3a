"""Operator 13: ranked lexical search over all documents by norm buckets.

A document is a vector of impacts over the terms of the queries, a query one of term weights; a score is their inner product. Documents are
put in the order of their vectors' lengths by a range exchange, longest first, and each task takes its part of that order in buckets. In a bucket

- a query is done, for this bucket and all later ones of the task, once |query| times the bucket's longest vector is below the score that its
  list already needs (Cauchy-Schwarz);
- for the other queries the heaviest coordinates (``FOCUS``) are summed exactly for each document, and what the other coordinates
  can add is bounded: by Cauchy-Schwarz on what is left of both lengths, and by the bucket's largest value of each coordinate;
- documents whose bound reaches the need are scored again, exactly, in whole numbers, and enter the query's list.

Two rounds: the first looks at every 32nd document of the order and gives each query the score and id that its list needs at least; the second takes all
documents and sends on what is better, at most ``k`` rows a query and task. A bound is never below the exact score, so the lists are those of scoring every pair.

Queries come in blocks of bounded size (``BLOCK_ITEMS`` queries, ``BLOCK_TERMS`` terms), so what tasks hold doesn't grow with the tables; each
block is a pass over the documents. Statistics (documents, terms, document frequencies) cover all documents.

Defined results: documents with a null or empty text have no terms; a query without terms that occur has no rows; equal scores are ordered by id, null ids
last; repeated documents each have a rank, and so have the rows of a repeated query; empty tables give an empty table; other columns are left
out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import column, documents, in_small_batches, slices, write_stage

TOP = 20
#: Queries and distinct terms of one block.
BLOCK_ITEMS, BLOCK_TERMS = 512, 1 << 16
#: Coordinates of a query that are summed for every document of a bucket.
FOCUS = 16
#: Of the order of lengths, one row in so many gives the first round's lists.
SEED_STEP = 32
#: Cells of a bucket's table of documents by terms.
CELLS = 1 << 21

#: Bytes of UTF-8 that belong to terms: ASCII digits and letters, and all bytes beyond ASCII; others become spaces, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a whole text, with repeats."""
    return text.translate(_FOLD).split() if text else []


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The queries in blocks: (id, counts of terms) each. One block at a time is on the driver."""
    block, seen = [], set()
    for item, text in items.select(column(id_col), column(text_col)).toLocalIterator():
        counts = Counter(terms_of(text.encode() if text else None))
        if block and (len(block) >= BLOCK_ITEMS or len(seen | counts.keys()) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        block.append((item, counts))
        seen |= counts.keys()
    if block:
        yield block


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n`` (terms with repeats)``, codes, tfs``: a document's terms that are in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import pyarrow as pa

        known = shared.value
        for batch in slices(batches):
            lengths, codes, tfs = [], [], []
            at = [0]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(text)
                lengths.append(len(words))
                for word, tf in Counter(words).items():
                    code = known.get(word)
                    if code is not None:
                        codes.append(code)
                        tfs.append(tf)
                at.append(len(codes))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (codes, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "codes", "tfs"])

    return in_small_batches(docs).select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<int>")


def document_frequencies(counts: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary (of bounded size)."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "df"])

    out = np.zeros(terms, np.int64)
    for code, df in counts.select("codes").mapInArrow(run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():
        out[code] = df
    return out


def term_weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, all_docs: int, all_terms: int) -> np.ndarray:
    """Whole numbers below 10^6, from counts and lengths of documents."""
    m = 100 - 25 + 25 * n * all_docs // all_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def by_length(counts: DataFrame, weights: np.ndarray, all_docs: int, all_terms: int) -> DataFrame:
    """Documents with a term of the vocabulary, in the order of their vectors' lengths, longest first:
    ``doc_id, length, codes, values, seed``. Coordinates are weight times impact, and a query's are its counts of terms."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, n, codes, tfs = batch.columns
            ends = np.cumsum(sizes := codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = codes.flatten().to_numpy()
            values = weights[flat] * impacts(tfs.flatten().to_numpy().astype(np.int64), np.repeat(n.to_numpy(), sizes), all_docs, all_terms)
            length = np.sqrt(np.add.reduceat(values.astype(float) ** 2, ends - sizes)) if len(sizes) else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([ids, pa.array(length), codes, lists], ["doc_id", "length", "codes", "values"])

    vectors = counts.where(F.size("codes") > 0).mapInArrow(run, "doc_id long, length double, codes array<int>, values array<long>")
    # copies have one length: ids, and the place in the table for repeated ids, deal them apart
    vectors = vectors.withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("length"), F.asc("doc_id"), F.asc("row")]
    ranged = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "length", "codes", "values", (F.monotonically_increasing_id() % SEED_STEP == 0).alias("seed"))


class Block:
    """Queries of one block as arrays, the same in every task."""

    def __init__(self, items: list[dict[int, int]], terms: int, k: int):
        self.k, self.terms, self.size = k, terms, len(items)
        self.codes = [np.array(sorted(x), np.int64) for x in items]
        self.counts = [np.array([x[c] for c in codes], np.int64) for x, codes in zip(items, self.codes, strict=True)]
        self.norm = np.array([math.sqrt(float((c**2).sum())) for c in self.counts])


class Lists:
    """The best ``k`` (score, id) of each query so far; what a further document needs is the last of a full list, or what it began with."""

    def __init__(self, size: int, k: int, need: np.ndarray, need_id: np.ndarray):
        self.k, self.need, self.need_id = k, need.copy(), need_id.copy()
        self.scores = [np.zeros(0, np.int64) for _ in range(size)]
        self.ids = [np.zeros(0, np.int64) for _ in range(size)]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores > 0) & ((scores > self.need[i]) | ((scores == self.need[i]) & (ids <= self.need_id[i])))
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores[i], scores[good]]), np.concatenate([self.ids[i], ids[good]])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores[i], self.ids[i] = scores[best], ids[best]
        if len(best) == self.k:
            self.need[i], self.need_id[i] = self.scores[i][-1], self.ids[i][-1]


#: Stands for a null id in the order of ids: after all others.
NULL_ID = 2**63 - 1


def search_bucket(block: Block, weights: np.ndarray, lists: Lists, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, values: np.ndarray, rows: np.ndarray) -> int:
    """One bucket against all queries; the number of pairs that were scored exactly. ``rows`` gives the document of each coordinate."""
    active = np.flatnonzero(block.norm * lengths.max() * (1 + 1e-9) >= lists.need)
    if not len(active):
        return 0
    width = len(ids)
    table = np.zeros((block.terms, width), np.int64)
    table[codes, rows] = values
    highest = np.zeros(block.terms, np.int64)
    np.maximum.at(highest, codes, values)
    # the heaviest coordinates of each query, and what its others can add at most
    focus, rest_most, rest_norm = [], np.zeros(len(active)), np.zeros(len(active))
    for at, i in enumerate(active):
        reach = block.counts[i] * highest[block.codes[i]]
        order = np.argsort(-reach, kind="stable")
        focus.append(order[:FOCUS])
        rest_most[at], rest_norm[at] = reach[order[FOCUS:]].sum(), math.sqrt(float((block.counts[i][order[FOCUS:]] ** 2).sum()))
    used, place = np.unique(np.concatenate([block.codes[i][f] for i, f in zip(active, focus, strict=True)]), return_inverse=True)
    query, mask = np.zeros((len(active), len(used))), np.zeros((len(active), len(used)))
    row = np.repeat(np.arange(len(active)), [len(f) for f in focus])
    query[row, place], mask[row, place] = np.concatenate([block.counts[i][f] for i, f in zip(active, focus, strict=True)]), 1.0
    part = table[used].astype(float)
    exact = query @ part  # whole numbers below 2^53
    left = np.sqrt(np.maximum(0.0, lengths**2 * (1 + 1e-9) - mask @ (part * part) * (1 - 1e-9)))
    bound = exact + np.minimum(rest_norm[:, None] * left, rest_most[:, None]) * (1 + 1e-9)
    hits, scored = bound >= np.maximum(1, lists.need[active])[:, None], 0
    for at in np.flatnonzero(hits.any(axis=1)):
        i = active[at]
        found = np.flatnonzero(hits[at])
        scored += len(found)
        lists.add(i, (table[np.ix_(block.codes[i], found)] * block.counts[i][:, None]).sum(axis=0), ids[found])
    return scored


def searched(vectors: DataFrame, shared, weights: np.ndarray, need: np.ndarray, need_id: np.ndarray) -> DataFrame:
    """``item`` (place in the block)``, doc_id, score``: each task's lists."""

    def run(batches):
        import pyarrow as pa

        block = shared.value
        lists = Lists(block.size, block.k, need, need_id)
        step = max(32, CELLS // max(1, block.terms))
        for batch in slices(batches, step):
            ids, lengths, codes, values = batch.columns
            sizes = codes.value_lengths().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(NULL_ID).to_numpy()
            search_bucket(block, weights, lists, ids, lengths.to_numpy(), codes.flatten().to_numpy(), values.flatten().to_numpy(), np.repeat(np.arange(len(ids)), sizes))
        item = np.repeat(np.arange(block.size), [len(x) for x in lists.scores])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(lists.ids)), pa.array(np.concatenate(lists.scores))], ["item", "doc_id", "score"])

    return vectors.select("doc_id", "length", "codes", "values").mapInArrow(run, "item long, doc_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query with their rank."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Columns ``item_id, rank, doc_id, score``: the ``k`` best documents of each query."""
    spark = docs.sparkSession
    item_kind = items.schema[item_col].dataType.simpleString()
    out = None
    for block in blocks_of(items, item_col, item_text_col):
        names = sorted(set().union(*[x.keys() for _, x in block]))
        counts = write_stage(term_counts(docs, {t: i for i, t in enumerate(names)}, id_col, text_col), "terms")
        all_docs, all_terms = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(counts, len(names)) if names and all_docs else np.zeros(len(names), np.int64)
        if not df.any():
            continue
        weights = term_weights(df, all_docs)
        at = {t: i for i, t in enumerate(names)}
        shared = spark.sparkContext.broadcast(Block([{at[t]: c for t, c in x.items()} for _, x in block], len(names), k))
        vectors = write_stage(by_length(counts, weights, all_docs, all_terms), "vectors")
        need, need_id = np.zeros(len(block), np.int64), np.full(len(block), NULL_ID)
        seeds = vectors.where("seed")
        first = searched(seeds.coalesce(max(1, len(vectors.inputFiles()) // SEED_STEP)), shared, weights, need, need_id)
        for item, doc_id, score in best(first, k).where(F.col("rank") == k).select("item", "doc_id", "score").collect():  # a row a query
            need[item], need_id[item] = score, doc_id
        found = write_stage(best(searched(vectors, shared, weights, need, need_id), k), "found")
        ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item long, item_id {item_kind}")
        rows = found.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id long, score long")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
 b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 q AS (SELECT item_id, term, count(*) AS qtf FROM b GROUP BY ALL),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
 n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
 a AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM n),
 w AS (SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, a GROUP BY term, all_docs),
 m AS (SELECT doc_id, 100 - 25 + ((25 * n * all_docs) // all_terms) AS m FROM n, a),
 s AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
