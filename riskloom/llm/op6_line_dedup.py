"""Operator 6: line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its distinct words. A line is removed if a line before it has the same set, or a set with a Jaccard
similarity of at least ``PERCENT``. Lines are in the order of document id, digest of the document's text, line number. Lines
without a word stay.

Plan: one pass counts words in a table of fixed size, which orders the words of every line by rarity. A second pass writes a slim
row per line: a digest of its set, its size, the first ``n - ceil(t * n) + 1`` words in that order (two similar sets share
one of them: prefix filter) and a parity of the set's hashes in 64 bits. Equal sets become one row, combined before the shuffle, so a
line that makes up a third of the corpus is no hot key. Sets meet in lists by such a word, and a pair of a list counts
if its sizes (length filter), its places (positional filter) and its parities allow the overlap: each word that only one
set has changes one bit at most. Pairs that share too few of the first words are dropped, the rest verified on their whole lines.

Long lists (``LONG_LIST``) come from groups of near copies. There each set meets the earliest set of its list first; those that
are similar to it are settled, and only sets that are still open meet all earlier ones. Sets below nine words can't have
another similar set at 90 %. Joins on sets are skew joins that adaptive execution splits.

Defined results: a null or empty text stays as it is, as do rows with a null id; rows with both id and text equal are one document
and are cleaned alike, rows with equal ids and different texts are different documents; an empty table gives an
empty table; other columns of the input are kept, whatever their names, but for two of the names in ``counts``, which the counts replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from riskloom.llm.common import SPACE, column, documents, is_odd, write_stage

#: Similarity of two lines as a percentage.
PERCENT = 90
#: The table of word counts: 2**18 codes of five bits, in half powers of two around the mean. Words are told apart by 58 bits beside their code.
BUCKET_BITS, CODE_BITS = 18, 5
#: Sets of a longer list meet the earliest one of it first.
LONG_LIST = 256
#: Bits of the maps of documents, lines and sets that later passes read.
MAP_BITS = 1 << 24


def _words(line: Column, odd: Column) -> Column:
    return F.array_remove(F.when(odd, F.split(line, SPACE)).otherwise(F.split(line, " ")), "")


def _need(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100.0 + percent) - 1e-9)


def _sizes_meet(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _slot(word: Column) -> Column:
    return F.shiftrightunsigned(F.hash(word), 32 - BUCKET_BITS)


def word_rarity(texts: DataFrame) -> str:
    """A code from 0 to 31 for each hash bucket: how often words of the bucket occur in column ``text``, in half powers of two, 8 at the mean.

    The driver gets 2**18 codes as text, under 1 MB whatever the size of the corpus.
    """
    text = F.col("text")
    plain = F.when(is_odd(text), F.split(text, SPACE)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "))
    words = texts.select(F.explode(plain).alias("word")).where("word != ''")
    seen = words.groupBy(_slot(F.col("word")).alias("slot")).agg(F.count("*").alias("n"))
    every = seen.union(texts.sparkSession.range(1 << BUCKET_BITS).select(F.col("id").cast("int"), F.lit(0).cast("long"))).groupBy("slot").agg(F.sum("n").alias("n"))
    every = write_stage(every, "words")  # 2**18 rows
    mean = max(1.0, (every.agg(F.sum("n")).first()[0] or 0) / (1 << BUCKET_BITS))
    code = F.greatest(F.lit(0), F.least(F.floor(F.log2((F.col("n") + 0.5) / mean) * 2) + 8, F.lit((1 << CODE_BITS) - 1)))
    parts = every.groupBy(F.shiftright("slot", 10).alias("part")).agg(F.sort_array(F.collect_list(F.struct("slot", code.cast("string").alias("code")))).alias("x"))
    rows = parts.select("part", F.array_join(F.col("x.code"), ",").alias("codes")).collect()
    return ",".join(r["codes"] for r in sorted(rows))


def line_sets(docs: DataFrame, rarity: str, percent: int = PERCENT) -> DataFrame:
    """Per line with a word: ``doc_id, text_digest, line_no, sig`` (digest of its set), ``n``, ``prefix``, its rarest words, and ``parity``.

    ``prefix`` is null for sets that are too small for another similar set.
    """
    codes = F.split(F.lit(rarity), ",").cast("array<bigint>")  # folded into one constant
    # each generator keeps what is below it from being made again by what is above
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_digest"), is_odd(F.col("text")).alias("odd"), F.split("text", "\n", -1).alias("lines"))
    keyed = keyed.select("doc_id", "text_digest", "odd", F.posexplode_outer("lines").alias("line_no", "line")).where("line != ''")
    entry = lambda w: F.shiftleft(F.get(codes, _slot(w)), 63 - CODE_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), CODE_BITS + 1))
    sets = keyed.select("doc_id", "text_digest", "line_no", F.explode(F.array(F.array_distinct(F.transform(_words(F.col("line"), F.col("odd")), entry)))).alias("words"))
    sets = sets.where("size(words) > 0").select("doc_id", "text_digest", "line_no", F.sort_array("words").alias("words"))
    n = F.size("words")
    first = n - F.ceil(F.lit(percent) * n / 100.0 - 1e-9).cast("int") + 1
    similar = (F.floor(n * 100 / F.lit(percent)) > n) | (F.ceil(n * F.lit(percent) / 100.0 - 1e-9) < n)
    parity = F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))
    return sets.select("doc_id", "text_digest", "line_no", F.xxhash64("words", n).alias("sig"), n.alias("n"), F.when(similar, F.slice("words", 1, first)).alias("prefix"), F.when(similar, parity).alias("parity"))


def _through_map(df: DataFrame, by: list[str], keys: DataFrame) -> DataFrame:
    """The rows whose columns are among the keys, and few others: a map of MAP_BITS bits is broadcast (2 MB at most, in rows of 4 KB)."""
    slot = F.pmod(F.xxhash64(*by), F.lit(MAP_BITS))
    bits = keys.select(slot.alias("__slot")).groupBy(F.expr("bitmap_bucket_number(__slot)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__slot))").alias("__bits"))
    octet = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = df.withColumn("__slot", slot).withColumns({"__bucket": F.expr("bitmap_bucket_number(__slot)"), "__bit": F.expr("bitmap_bit_position(__slot)")})
    return found.join(F.broadcast(bits), "__bucket").withColumn("__octet", octet).where("shiftright(__octet, cast(__bit % 8 as int)) & 1 = 1").select(*df.columns)


_PLACE = ["doc_id", "text_digest", "line_no"]


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``sig`` of the later set of each of the pairs ``sig, other`` whose whole sets are similar.

    Only documents that some pair needs are split again, and only lines that some pair needs are shuffled.
    """
    pairs = write_stage(pairs.select("sig", "other"), "pairs")  # read several times
    sigs = pairs.select("sig").union(pairs.select("other")).distinct()
    places = write_stage(_through_map(sets.select("sig", *_PLACE), ["sig"], sigs).join(sigs, "sig", "left_semi"), "places")
    lines = docs.withColumn("text_digest", F.xxhash64("text"))
    lines = _through_map(lines, _PLACE[:2], places).select(*_PLACE[:2], is_odd(F.col("text")).alias("odd"), F.split("text", "\n", -1).alias("lines"))
    lines = lines.select(*_PLACE[:2], "odd", F.posexplode_outer("lines").alias("line_no", "line"))
    lines = _through_map(lines, _PLACE, places)
    words = F.array_distinct(F.transform(_words(F.col("line"), F.col("odd")), lambda w: F.xxhash64(w)))
    # equal rows of the input give equal lines: one of them
    found = places.join(lines, _PLACE).groupBy("sig").agg(F.min(F.struct(*_PLACE, words.alias("words"))).alias("x"))
    held = found.select("sig", F.struct(*[F.col(f"x.{c}") for c in _PLACE]).alias("at"), F.col("x.words").alias("words"))
    both = pairs.join(held.select("sig", F.col("at").alias("at_a"), F.col("words").alias("a")), "sig").join(held.select(F.col("sig").alias("other"), F.col("at").alias("at_b"), F.col("words").alias("b")), "other")
    both = both.select(F.when(F.col("at_b") < F.col("at_a"), F.col("sig")).otherwise(F.col("other")).alias("sig"), F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("sizes"))
    return both.where(F.col("common") * 100 >= F.lit(percent) * (F.col("sizes") - F.col("common"))).select("sig").distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_digest, line_no`` of the lines to remove. ``docs``: columns ``doc_id``, ``text``, without nulls."""
    lines = write_stage(line_sets(docs, word_rarity(docs), percent), "lines")
    # equal lines are one set; its parts other than the place are equal in all of them
    first = lines.groupBy("sig").agg(F.min(F.struct(*_PLACE, "n", "prefix", "parity")).alias("x"), F.count("*").alias("n_lines"))
    sets = write_stage(first.select("sig", "x.*", "n_lines"), "sets")
    # the order within a list is a matter of cost only
    rank = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.xxhash64("doc_id")
    entries = sets.where("prefix is not null").select("sig", "n", "parity", rank.alias("rank"), F.posexplode("prefix").alias("i", "word"))
    long_words = write_stage(entries.groupBy("word").agg(F.count("*").alias("size")).where(F.col("size") > LONG_LIST).select("word"), "words")
    rest = lambda n: F.ceil(F.lit(percent) * n / 100.0 - 1e-9) - 1

    def can_meet(n_a: Column, n_b: Column, parity_a: Column, parity_b: Column) -> Column:
        return _sizes_meet(n_a, n_b, percent) & (F.bit_count(parity_a.bitwiseXOR(parity_b)) <= n_a + n_b - 2 * _need(n_a, n_b, percent))

    def candidates(listed: DataFrame, still_open: Column | None = None) -> DataFrame:
        """Pairs ``sig, other`` of sets of one list; ``listed`` is dealt out by word already."""
        x, y = (listed.select("word", *(F.col(c).alias(f"{c}_{k}") for c in listed.columns if c != "word")) for k in "ab")
        in_order = (F.col("rank_a") < F.col("rank_b")) | ((F.col("rank_a") == F.col("rank_b")) & (F.col("sig_a") < F.col("sig_b")))
        here = F.least("i_a", "i_b") + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
        both = (x["word"] == y["word"]) & in_order & (here >= _need(F.col("n_a"), F.col("n_b"), percent)) & can_meet(F.col("n_a"), F.col("n_b"), F.col("parity_a"), F.col("parity_b"))
        return x.join(y, both if still_open is None else both & still_open).select("sig_a", "sig_b", "n_a", "n_b")

    pairs = candidates(entries.repartition("word").join(long_words, "word", "left_anti"))
    matched = None
    if not long_words.isEmpty():
        long = write_stage(entries.join(long_words, "word"), "long")
        heads = long.groupBy("word").agg(F.min(F.struct("rank", "sig", "n", "parity")).alias("head"))
        met = long.join(heads, "word").where((F.col("sig") != F.col("head.sig")) & can_meet(F.col("n"), F.col("head.n"), F.col("parity"), F.col("head.parity")))
        best = met.groupBy("sig", F.col("head.sig").alias("other")).agg(F.count("*").alias("count")).groupBy("sig").agg(F.max(F.struct("count", "other")).alias("best"))
        matched = write_stage(_verified(best.select("sig", F.col("best.other").alias("other")), sets, docs, percent), "matched")
        long = long.join(matched.withColumn("matched", F.lit(True)), "sig", "left").withColumn("open", F.col("matched").isNull()).drop("matched")
        # of two sets of one document either may be the later one
        pairs = pairs.union(candidates(long.repartition("word"), F.col("open_b") | ((F.col("rank_a") == F.col("rank_b")) & F.col("open_a"))))
    # shared first words are counted over all lists
    pairs = pairs.groupBy("sig_a", "sig_b", "n_a", "n_b").agg(F.count("*").alias("count")).where(F.col("count") + F.greatest(rest(F.col("n_a")), rest(F.col("n_b"))) >= _need(F.col("n_a"), F.col("n_b"), percent))
    more = _verified(pairs.select(F.col("sig_b").alias("sig"), F.col("sig_a").alias("other")), sets, docs, percent)
    matched = write_stage(more if matched is None else more.union(matched).distinct(), "matched")

    # only lines whose set has more than one line or a match are looked at again
    named = sets.where("n_lines > 1").select("sig", F.struct(*_PLACE).alias("first_at"), F.lit(False).alias("matched"))
    found = matched.select("sig", F.lit(None).cast(named.schema["first_at"].dataType).alias("first_at"), F.lit(True).alias("matched"))
    named = named.unionByName(found).groupBy("sig").agg(F.max("first_at").alias("first_at"), F.max("matched").alias("matched"))
    named = write_stage(named, "named")
    flagged = _through_map(lines.select("sig", *_PLACE), ["sig"], named).join(named, "sig")
    return flagged.where(F.col("matched") | (F.struct(*_PLACE) > F.col("first_at"))).select(*_PLACE)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the cleaned text, and two columns of ``counts`` (long): lines of the text, and those removed."""
    plain = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).where("doc_id is not null and text is not null")
    # a document's removed lines as bits of 64 lines each, so that a very long text is cleaned in one walk
    gone = removed_lines(plain, percent).distinct().groupBy("doc_id", "text_digest", F.floor(F.col("line_no") / 64).cast("int").alias("k"))
    gone = gone.agg(F.bit_or(F.expr("shiftleft(1L, line_no % 64)")).alias("bits"), F.count("*").alias("n"))
    gone = gone.groupBy("doc_id", "text_digest").agg(F.map_from_entries(F.collect_list(F.struct("k", "bits"))).alias("m"), F.max("k").alias("last"), F.sum("n").alias("n_gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_digest").alias("__digest"), "n_gone", F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long"))).alias("gone"))
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("__row"), column(id_col).alias("__key"), column(text_col).alias("__text"))
    joined = rows.join(gone.hint("shuffle_hash"), (F.col("__key") == F.col("__id")) & (F.xxhash64("__text") == F.col("__digest")), "left")
    lines = F.split("__text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: F.coalesce(F.getbit(F.get("gone", F.shiftright(i, 6)), i.bitwiseAND(63)), F.lit(0)) == 0), "\n")
    cleaned = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(kept)
    columns = [cleaned.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns if c not in counts]
    return joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]), F.coalesce("n_gone", F.lit(0)).cast("long").alias(counts[1]))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = r"""
WITH line AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)),
 sets AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS s FROM line),
 keyed AS (SELECT doc_id, line_no, s, md5(array_to_string(s, chr(1))) AS k, doc_id * 1000000 + line_no AS "at" FROM sets WHERE len(s) > 0),
 one AS (SELECT k, any_value(s) AS s, min("at") AS "at", any_value(len(s)) AS n FROM keyed GROUP BY k),
 word AS (SELECT k, n, "at", unnest(s) AS w FROM one WHERE n >= 9),
 freq AS (SELECT w, count(*) AS f FROM word GROUP BY w),
 ranked AS (SELECT k, n, "at", w, row_number() OVER (PARTITION BY k ORDER BY f, w) AS r FROM word JOIN freq USING (w)),
 prefix AS (SELECT * FROM ranked WHERE r <= n - ceil(0.9 * n - 1e-9) + 1),
 cand AS (SELECT DISTINCT a.k AS k, b.k AS o FROM prefix a JOIN prefix b ON a.w = b.w AND b."at" < a."at" AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90),
 hit AS (SELECT DISTINCT c.k FROM cand c JOIN one a ON a.k = c.k JOIN one b ON b.k = c.o WHERE len(list_intersect(a.s, b.s)) * 100 >= 90 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
 gone AS (SELECT y.doc_id, y.line_no FROM keyed y JOIN one o ON o.k = y.k LEFT JOIN hit h ON h.k = y.k WHERE h.k IS NOT NULL OR y."at" > o."at"),
 per AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed, coalesce(string_agg(CASE WHEN g.line_no IS NULL THEN l.line END, chr(10) ORDER BY l.line_no), '') AS text
   FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.n_removed, 0)::BIGINT AS n_removed, p.text FROM documents d LEFT JOIN per p ON p.doc_id = d.doc_id
"""
