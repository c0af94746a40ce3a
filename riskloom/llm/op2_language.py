"""Operator 2: language identification by fusing evidence as Bayes' rule has it.

The log-likelihood of a text under each language (hashed byte trigrams of its letters) is added to that of the declared
language given the language, that of the address suffix given the language, and to the prior of the host. The last
three are estimated over all rows by grouped aggregation, with the text's best language as the vote: a host's counts are
smoothed towards its domain's, those towards the counts of all rows. Every label of any row is a language of the model; the text
model of each is fitted on a bounded sample of its rows (``TRAIN_ROWS`` shared out, chosen by hash of the id and text).

Plan: one pass over the texts leaves a slim table (scores, declared language, suffix, host, domain); everything else works
on that table. Counts are combined before they are shuffled and a host is one row with an array of counts, so a host
that has a third of all rows is no hot key in the aggregation; the join on hosts is one that adaptive execution splits.

Defined results: a null or empty text, or one without letters, has no text evidence and is rejected (``kept`` false), though the
other evidence still names a language; null evidence of a kind counts as none; of languages with equal posteriors (or equal likelihoods, for the
vote) the first by name is taken; a value of some evidence is judged by the votes of the rows that have it, never by the labels
that the text model was fitted on; repeated rows give repeated rows; an
empty table gives an empty table; other columns are left out by ``identify`` and kept by ``keep``, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import documents, in_small_batches, write_stage

#: Labelled rows that the text model is fitted on, about: each language has an equal share of them, but not fewer than LEAST_ROWS.
TRAIN_ROWS, LEAST_ROWS = 20_000, 300
#: Languages whose counts a task holds before it passes them on.
HELD_LANGUAGES = 64
#: Buckets of trigrams.
BUCKETS = 1 << 16
#: Weight of one trigram's log-likelihood: neighbouring trigrams share two of three letters.
TRIGRAM_WEIGHT = 0.3
#: A text is in none of the languages if its trigrams, on the (geometric) mean, are less than twice as likely under the best of them as under even odds
#: over all buckets, which is what text that is in no language looks like after hashing.
LEAST_MEAN = math.log(2 / BUCKETS)
#: Pseudo-counts of the smoothing: of a declared language or suffix, of a domain, of a host.
EVIDENCE_COUNT, DOMAIN_COUNT, HOST_COUNT = 1.0, 20.0, 10.0
#: Rejected rows that are broadcast, some 100 bytes each.
MOST_BROADCAST = 200_000
#: Posterior that a row needs to be kept.
LEAST_POSTERIOR = 0.5

_NOT_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: str | None):
    """Buckets of the byte trigrams of a text's letters in lower case; everything else counts as one space."""
    import numpy as np

    if not text:
        return np.zeros(0, np.int64)
    plain = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_NOT_LETTERS).split()) + b" "
    b = np.frombuffer(plain, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return ((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit_text_model(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], object]:
    """Languages and their log-probabilities of the buckets, from columns ``doc_id, text, lang``.

    The languages are all labels of all rows, however rare. The driver gets one array of counts for each language, never texts.
    """
    import numpy as np

    spark = labelled.sparkSession
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    rows = labelled.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("low")).collect()  # one row per language
    if not sizes:
        return [], np.zeros((0, BUCKETS), np.float32)
    quota = max(LEAST_ROWS, train_rows // len(sizes))
    # the row that comes first is always in, so that no language is without a row
    below = spark.createDataFrame([(r["lang"], max(int(min(1.0, quota / r["n"]) * (1 << 40)), r["low"] + 1)) for r in sizes], "lang string, below long")
    sample = rows.join(F.broadcast(below), "lang").where(place < F.col("below"))

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def packed(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in seen.values()], pa.binary())], ["lang", "counts"])

        seen: dict = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(trigrams(text), minlength=BUCKETS)
                if lang in seen:
                    seen[lang] += found
                else:
                    if len(seen) == HELD_LANGUAGES:
                        yield packed(seen)
                        seen = {}
                    seen[lang] = found
        yield packed(seen)

    def add(frame):
        import numpy as np
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in frame["counts"])
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "n": [int(total.sum())], "counts": [zlib.compress(total.tobytes(), 1)]})

    summed = in_small_batches(sample).select("text", "lang").mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInPandas(lambda frame: add(frame), "lang string, n long, counts binary")
    found = sorted(summed.collect(), key=lambda r: r["lang"])
    counts = [np.frombuffer(zlib.decompress(r["counts"]), "<i8") for r in found]
    return [r["lang"] for r in found], np.array([np.log((c + 0.5) / (c.sum() + 0.5 * BUCKETS)) for c in counts], np.float32).reshape(-1, BUCKETS)


def score_texts(rows: DataFrame, model: tuple[list[str], object]) -> DataFrame:
    """Replaces ``text`` by ``scores`` (log-likelihood of its trigrams under each language) and ``n_trigrams``."""
    names = [c for c in rows.columns if c != "text"]
    table = rows.sparkSession.sparkContext.broadcast(model[1])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        logs = table.value
        for batch in batches:
            scores, sizes = [], []
            for text in batch.column(len(names)).to_pylist():
                at = trigrams(text)
                sizes.append(len(at))
                scores.append(logs[:, at].sum(axis=1).tolist() if len(logs) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.list_(pa.float32())), pa.array(sizes, pa.int64())], [*names, "scores", "n_trigrams"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return in_small_batches(rows).select(*names, "text").mapInArrow(run, f"{kept}, scores array<float>, n_trigrams long")


def _argmax(x: Column) -> Column:
    return F.array_position(x, F.array_max(x)).cast("int") - 1


def _votes(rows: DataFrame, keys: list[str], languages: int) -> DataFrame:
    """One row for each key with ``votes``: how many rows voted for each language."""
    return rows.where("vote is not null").groupBy(*keys).agg(F.array(*[F.count_if(F.col("vote") == i).cast("double") for i in range(languages)]).alias("votes"))


def identify(rows: DataFrame, model: tuple[list[str], object]) -> DataFrame:
    """``rows``: ``id, text, declared, suffix, host, domain``. Returns ``id, lang, posterior, text_lang, kept``."""
    languages = model[0]
    k = len(languages)
    if not k:
        return rows.select("id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("kept"))
    names = F.array(*map(F.lit, languages))
    scored = score_texts(rows.select("id", "declared", "suffix", "host", "domain", "text"), model)
    known = (F.col("n_trigrams") > 0) & (F.array_max("scores") / F.col("n_trigrams") >= LEAST_MEAN)
    scored = write_stage(scored.withColumn("known", F.coalesce(known, F.lit(False))).withColumn("vote", F.when(F.col("known"), _argmax(F.col("scores")))), "scores")

    zeros = F.array(*[F.lit(0.0)] * k)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    every = scored.where("vote is not null").agg(*[F.count_if(F.col("vote") == i).alias(str(i)) for i in range(k)]).first()
    # how many values each kind of evidence has: the pseudo-counts of a language add up over all of them, so that its probabilities add up to 1
    kinds = scored.agg(*[F.count_distinct(c).alias(c) for c in ("declared", "suffix")]).first()
    n = sum(every) + k
    prior = F.array(*[F.lit((every[i] + 1) / n) for i in range(k)])

    def smoothed(votes: Column, towards: Column, count: float) -> Column:
        return F.transform(towards, lambda p, i: (F.get(votes, i) + count * p) / (total(votes) + count))

    def evidence(column: str) -> DataFrame:
        # log of P(value | language): votes of the value against all votes of the language
        values = _votes(scored.where(F.col(column).isNotNull()), [column], k)
        return values.select(column, F.array(*[F.log((F.get("votes", F.lit(i)) + EVIDENCE_COUNT) / F.lit(float(every[i] + EVIDENCE_COUNT * kinds[column]))) for i in range(k)]).alias(f"{column}_log"))

    domains = _votes(scored, ["domain"], k).select("domain", smoothed(F.col("votes"), prior, DOMAIN_COUNT).alias("domain_prior"))
    hosts = _votes(scored, ["host", "domain"], k)
    hosts = hosts.join(domains.withColumnRenamed("domain", "of"), F.col("domain").eqNullSafe(F.col("of")), "left")
    hosts = hosts.select(F.col("host").alias("of_host"), F.col("domain").alias("of_domain"), smoothed(F.col("votes"), F.coalesce("domain_prior", prior), HOST_COUNT).alias("host_prior"))
    fused = scored.join(hosts, F.col("host").eqNullSafe(F.col("of_host")) & F.col("domain").eqNullSafe(F.col("of_domain")), "left")
    for column in ("declared", "suffix"):
        fused = fused.join(evidence(column), column, "left")
    text_part = F.when(F.col("known"), F.transform("scores", lambda s: s.cast("double"))).otherwise(zeros)
    fused = fused.select("id", "vote", "known", text_part.alias("t"), F.coalesce("host_prior", prior).alias("p"), F.coalesce("declared_log", zeros).alias("d"), F.coalesce("suffix_log", zeros).alias("s"))
    fused = fused.withColumn("logs", F.transform("t", lambda x, i: x * TRIGRAM_WEIGHT + F.log(F.get("p", i)) + F.get("d", i) + F.get("s", i)))
    fused = fused.withColumn("best", _argmax(F.col("logs"))).withColumn("posterior", F.round(F.lit(1.0) / total(F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))), 6))
    return fused.select("id", F.get(names, F.col("best")).alias("lang"), "posterior", F.get(names, F.col("vote")).alias("text_lang"), (F.col("known") & (F.col("posterior") >= LEAST_POSTERIOR)).alias("kept"))


def document_evidence(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """The source stands for the host, its name without a number for the domain; documents have no address."""
    return docs.select((F.col("doc_id") if key is None else key).alias("id"), F.col("text"), F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.regexp_replace("source", "[0-9]+$", "").alias("domain"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Text without markup, language of the html element, and host, domain and last label of the address."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    named = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    return pages.select(F.col("page_id").alias("id"), bare.alias("text"), named.alias("declared"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"))


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` (with the columns of documents) without the rows that are rejected, whatever other rows of their id say.

    A verdict follows from the text, the language and the source, so it is looked up by them and the id. Rejected rows are
    few as a rule: up to MOST_BROADCAST of them are broadcast, and no text is shuffled; more are joined by a shuffle.
    """
    key = F.struct("doc_id", "lang", "source", F.xxhash64("text").alias("digest"))
    rejected = write_stage(identify(document_evidence(docs, key), fit_text_model(docs)).where("not kept").select(F.col("id").alias("__rejected")).distinct(), "rejected")
    few = rejected.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(rejected) if few else rejected, key.eqNullSafe(F.col("__rejected")), "left_anti")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(document_evidence(docs), fit_text_model(docs)).withColumnRenamed("id", "doc_id")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, with all kinds of evidence."""
    model = fit_text_model(documents(spark, sf_dir))
    return identify(page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")), model).withColumnRenamed("id", "page_id")
