"""Operator 8: exact Jaccard join of documents by word n-grams, as a blocked sparse matrix product.

The rows of the incidence matrix are distinct sets of shingles (equal sets are one row, however many copies there are), its
columns are shingles. Two rows whose Jaccard similarity reaches the threshold share one of the ``n - ceil(t * n) + 1``
first shingles of each in any common order, so only those entries of the matrix are kept, rarest shingles first by a table of
counts of hashed shingles over all documents (of fixed size). Each hash partition of the columns is one block. The product
of block and transpose adds to a pair's overlap count for every column that both rows have; a pair whose
count can't reach the overlap that its two sizes demand is discarded, the others are verified on their whole sets.

A column that many similar rows share isn't multiplied out at first. In a few passes (``PASSES``) each column gives the rows of every
component met so far one head, and each head meets one hub: at first the row with the fewest shingles of its own, which
is nearest to the source of a group of copies, then the head of the column's largest component. The best hub of each component is
verified, and verified links merge components. A column whose rows all lie in one component is done with, as links inside a component
change nothing. Of the other columns, the last product takes every pair of rows in different components, so no link
between components is lost: a pair counts where the first shingle that both have can stand (at most ``n - needed`` in either), then
the overlap of their kept entries is taken, and pairs that can't reach the needed overlap are discarded before verification.
A column with very many rows is split by a salt where rows without a partner are dropped; heads and hubs are grouped minima.

Defined results: null and empty texts have size 0 and are their own component; repeated rows are one set; a null id is never
a component's name; an empty table gives an empty table; other columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import documents, in_small_batches, write_stage
from riskloom.llm.components import connected_components

#: Words in a shingle, and the similarity as a percentage.
SHINGLE, PERCENT = 5, 75
#: The table of counts: 2**22 numbers, in parts of 2**16, which workers get as 4 MB of codes on a logarithmic scale.
BUCKET_BITS, PART_BITS = 22, 16
#: A column with more entries than this is split when rows without a partner are dropped.
HOT_ROWS = 20_000
#: Tables of counts that one group adds up.
FAN_IN = 64
#: Passes that merge components before the last product.
PASSES = 2
#: Bits of the map of documents that verification reads (2 MB at most, in parts of 4 KB).
MAP_BITS = 1 << 24


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One pass: rows with ``doc_id, n, sig, sig2`` per document (two digests of its set), and rows with ``part, task, counts`` per task."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from riskloom.llm.shingles import groups_of, mix, shingle_sets

        counts, held = np.zeros(1 << BUCKET_BITS, np.uint32), []
        names = ["doc_id", "n", "sig", "sig2", "part", "task", "counts"]
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            texts = batch.column(1).to_pylist()
            for a, b in groups_of(texts):
                hashes, at = shingle_sets(texts[a:b], shingle)
                held.append((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
                if sum(map(len, held)) > 2_000_000:
                    counts += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS).astype(np.uint32)
                    held = []
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes)))
                sums2 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))))
                sig, sig2 = (mix(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in (sums, sums2))
                k = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, k), pa.array(np.diff(at)), pa.array(sig), pa.array(sig2), *[pa.nulls(k, pa.int32())] * 2, pa.nulls(k, pa.binary())], names)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS).astype(np.uint32)
        parts = [zlib.compress(p.tobytes(), 1) for p in counts.reshape(-1, 1 << PART_BITS)]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), *[pa.nulls(k, pa.int64())] * 3, pa.array(range(k), pa.int32()), pa.array([TaskContext.get().partitionId()] * k, pa.int32()), pa.array(parts, pa.binary())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, sig long, sig2 long, part int, task int, counts binary")


def shingle_rarity(described: DataFrame):
    """From the counts of all tasks: a code for each of 2**22 buckets on a logarithmic scale, the buckets with columns to split, and
    into how many parts each. Parts are summed in a tree, ``FAN_IN`` tables a group, and coded where the last are summed: no group and no driver gets more as the corpus grows."""
    import numpy as np

    total = described.where("part is null").agg(F.sum("n")).first()[0] or 0
    usual = total >> BUCKET_BITS  # what the many rare shingles of a bucket add up to

    def add(frame):
        import numpy as np

        whole = np.zeros(1 << PART_BITS, np.uint64)
        for x in frame["counts"]:
            x = zlib.decompress(x)
            whole += np.frombuffer(x, np.uint32 if len(x) == 4 << PART_BITS else np.uint64)
        return whole

    def once(frame):
        import pandas as pd

        return pd.DataFrame({"part": frame["part"].iloc[:1], "task": frame["task"].iloc[:1], "counts": [zlib.compress(add(frame).tobytes(), 1)]})

    def coded(frame):
        import numpy as np
        import pandas as pd

        counts = add(frame).astype(np.int64)
        codes = np.minimum(np.log2(counts + 1.0) * 8, 255).astype(np.uint8)
        hot = np.flatnonzero(counts >= usual + HOT_ROWS)  # over all parts fewer than all entries over HOT_ROWS, and at most 2**22
        return pd.DataFrame({"part": frame["part"].iloc[:1], "codes": [codes.tobytes()], "hot": [hot.tolist()], "splits": [((counts[hot] - usual) // HOT_ROWS).tolist()]})

    summed = described.where("part is not null").select("part", "task", "counts")
    tables = 1 + (described.agg(F.max("task")).first()[0] or 0)
    while tables > FAN_IN:
        summed = summed.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("part", "task").applyInPandas(lambda frame: once(frame), "part int, task int, counts binary")
        tables = -(-tables // FAN_IN)
    codes, hot, splits = np.zeros(1 << BUCKET_BITS, np.uint8), [], []
    for r in sorted(summed.groupBy("part").applyInPandas(lambda frame: coded(frame), "part int, codes binary, hot array<int>, splits array<long>").collect(), key=lambda r: r["part"]):
        at = r["part"] << PART_BITS
        codes[at : at + (1 << PART_BITS)] = np.frombuffer(r["codes"], np.uint8)
        hot += [at + x for x in r["hot"]]
        splits += r["splits"]
    return codes, np.array(hot, np.int64), np.array(splits, np.int64)


def prefix_entries(docs: DataFrame, rarity, text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Entries of the matrix that can decide: ``shingle, sig, n, pos, salt`` (0: the column isn't split).

    A set that a task has met already is left out; other tasks' copies of it fall together later.
    """
    table = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from riskloom.llm.shingles import groups_of, mix, shingle_sets

        (codes, hot, splits), met = table.value, set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in groups_of(texts):
                hashes, at = shingle_sets(texts[a:b], shingle)
                n = np.diff(at)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes)))
                sig = mix(sums[at[1:]] - sums[at[:-1]])
                fresh = np.zeros(len(n), bool)
                for i, s in enumerate(sig.tolist()):
                    if n[i] and s not in met:
                        fresh[i] = True
                        met.add(s)
                if len(met) > 300_000:
                    met.clear()
                doc = np.repeat(np.arange(len(n)), n)
                keep = fresh[doc]
                hashes, doc = hashes[keep], doc[keep]
                order = np.lexsort((hashes, codes[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], doc))
                hashes, doc = hashes[order], doc[order]
                begin = np.concatenate(([0], np.cumsum(np.where(fresh, n, 0))[:-1]))
                pos = np.arange(len(doc)) - begin[doc]
                need = n - (percent * n + 99) // 100 + 1
                keep = pos < need[doc]
                hashes, doc, pos = hashes[keep], doc[keep], pos[keep]
                parts = np.zeros(len(hashes), np.int64)
                if len(hot):
                    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                    at_hot = np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)
                    parts = np.where(hot[at_hot] == bucket, splits[at_hot], 0)
                salt = np.where(parts > 0, 1 + (sig[doc] % (parts.astype(np.uint64) + np.uint64(1))).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(sig.view(np.int64)[doc]), pa.array(n[doc].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(salt.astype(np.int32))], ["shingle", "sig", "n", "pos", "salt"])

    return in_small_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(run, "shingle long, sig long, n int, pos int, salt int")


def _needed(n_a, n_b, percent: int):
    """Overlap that reaches the threshold: ``ceil(t / (1 + t) * (n_a + n_b))``."""
    return F.ceil((F.lit(percent) * (n_a + n_b)) / F.lit(100.0 + percent) - 1e-9)


def _can_reach(n_a, n_b, count, percent: int):
    """Whether ``count`` shared shingles among the first ones leave the pair a chance: of the set whose last first shingle
    comes earlier, only what follows it can add to the count."""
    rest = lambda n: F.ceil(F.lit(percent) * n / 100.0 - 1e-9) - 1
    return count + F.greatest(rest(n_a), rest(n_b)) >= _needed(n_a, n_b, percent)


def _sizes_meet(n_a, n_b, percent: int):
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Of the pairs ``a, b`` of document ids, those whose whole sets reach the threshold.

    Only texts that some pair needs are shuffled: a map of bits (of fixed size) lets them through, and few others.
    """
    spark = docs.sparkSession
    need = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    bits = need.select(slot("id").alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull()).withColumn("slot", slot("id"))
    texts = texts.withColumn("bucket", F.expr("bitmap_bucket_number(slot)")).withColumn("bit", F.expr("bitmap_bit_position(slot)"))
    octet = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    # at most MAP_BITS / 32768 rows of 4 KB
    texts = texts.join(F.broadcast(bits), "bucket").withColumn("octet", octet).where("shiftright(octet, cast(bit % 8 as int)) & 1 = 1").select("id", "text")
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from riskloom.llm.common import slices
        from riskloom.llm.shingles import overlap, shingle_sets

        for batch in slices(batches, 100):
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hashes, at = shingle_sets(x + y, shingle)
            k, keep = len(x), []
            for i in range(k):
                a, b = hashes[at[i] : at[i + 1]], hashes[at[k + i] : at[k + i + 1]]
                both = overlap(a, b)
                keep.append(bool(both) and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = docs.schema[id_col].dataType.simpleString()
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return in_small_batches(joined).mapInArrow(run, f"a {kind}, b {kind}")


def _placed(named: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return named.withColumn("component", F.col("rep"))
    return named.join(components, F.col("rep") == F.col("node"), "left").select(*named.columns, F.coalesce("component", "rep").alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that links lead to."""
    described = write_stage(describe(docs, id_col, text_col, shingle), "described")
    sets = described.where("part is null").select("doc_id", "n", "sig", "sig2")
    rows = write_stage(sets.where("n > 0 and doc_id is not null").groupBy("n", "sig", "sig2").agg(F.min("doc_id").alias("rep")), "sets")
    entries = prefix_entries(docs, shingle_rarity(described), text_col, shingle, percent)

    # entries without a partner go
    column = Window.partitionBy("shingle", "salt").orderBy("n", "sig")
    same = (F.lag("sig").over(column) == F.col("sig")) & (F.lag("n").over(column) == F.col("n"))
    shared = entries.select("*", F.coalesce(same, F.lit(False)).alias("again"), F.lag("sig").over(column).alias("before"), F.lead("sig").over(column).alias("after"))
    shared = write_stage(shared.where("(before is not null or after is not null or salt > 0) and not again").select("shingle", "sig", "n", "pos"), "shared")
    # a row's own shingles: first ones that no other row has
    kept = F.count("*").over(Window.partitionBy("n", "sig"))
    own = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100.0 - 1e-9) + 1 - kept
    named = write_stage(shared.withColumn("own", own).join(rows.select(F.col("n").cast("int").alias("n"), "sig", "rep"), ["n", "sig"]).select("shingle", "n", "pos", "rep", "own"), "columns")

    components = None
    links = None
    for k in range(PASSES):
        # one exchange by column serves both groupings and the join
        placed = _placed(named.drop("pos"), components).repartition("shingle")
        order = F.col("own") if k == 0 else F.pmod(F.xxhash64("rep", F.lit(k)), F.lit(1 << 31))
        heads = placed.groupBy("shingle", "component").agg(F.count("*").alias("size"), F.min(F.struct(order.alias("order"), "rep", "n")).alias("head"))
        hubs = heads.groupBy("shingle").agg(F.min(F.struct((-F.col("size")).alias("size"), "head", "component")).alias("hub"), F.count("*").alias("heads")).where("heads > 1").select("shingle", "hub")
        met = heads.join(hubs, "shingle").where("component != hub.component").select("component", F.col("head.rep").alias("a"), F.col("head.n").alias("n_a"), F.col("hub.head.rep").alias("b"), F.col("hub.head.n").alias("n_b"))
        met = met.where(_sizes_meet(F.col("n_a"), F.col("n_b"), percent)).groupBy("component", "a", "n_a", "b", "n_b").agg(F.count("*").alias("count"))
        # a head may meet this hub in some of the columns that both have, so half of what is needed will do
        met = met.where(_can_reach(F.col("n_a"), F.col("n_b"), F.col("count") * 2, percent))
        best = met.groupBy("component").agg(F.max(F.struct("count", "b", "a")).alias("x")).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"))
        found = write_stage(verified(best, docs, id_col, text_col, shingle, percent), "verified")
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        components = connected_components(links, to_the_end=False)

    # the last product: columns with rows of more than one component, rows of different components
    placed = _placed(named.drop("own"), components).repartition("shingle")
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("shingle")
    open_columns = write_stage(placed.join(mixed, "shingle", "left_semi").select("shingle", "n", "pos", "rep", "component"), "open")
    x = open_columns.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("n", "pos", "rep", "component")))
    y = open_columns.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("n", "pos", "rep", "component")))
    needed = _needed(F.col("n_a"), F.col("n_b"), percent)
    in_reach = (F.col("pos_a") <= F.col("n_a") - needed) & (F.col("pos_b") <= F.col("n_b") - needed) & (F.least("pos_a", "pos_b") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= needed)
    product = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("component_a") < F.col("component_b")) & _sizes_meet(F.col("n_a"), F.col("n_b"), percent) & in_reach)
    pairs = product.groupBy("rep_a", "rep_b", "n_a", "n_b").agg(F.count("*").alias("count"))
    kept = named.groupBy("rep").agg(F.collect_set("shingle").alias("entries"))
    pairs = pairs.join(kept.select(F.col("rep").alias("rep_a"), F.col("entries").alias("e_a")), "rep_a").join(kept.select(F.col("rep").alias("rep_b"), F.col("entries").alias("e_b")), "rep_b")
    pairs = pairs.where(_can_reach(F.col("n_a"), F.col("n_b"), F.size(F.array_intersect("e_a", "e_b")), percent)).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    more = write_stage(verified(pairs, docs, id_col, text_col, shingle, percent), "verified")
    components = connected_components(more if links is None else links.union(more))

    of_set = rows.join(components, F.col("rep") == F.col("node"), "left").select("n", "sig", "sig2", F.coalesce("component", "rep").alias("found"))
    return sets.join(of_set, ["n", "sig", "sig2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
