"""Operator 7: line-first cleaning with quality rules, in DataFrame functions only.

Each line is judged by punctuation (too many symbols, no mark in a long line, an ellipsis at the end), navigation (separators, short items that the
text repeats) and boilerplate rules; lines that fail go, and a document that loses too much
of its text with them is rejected, as is one that fails the base rules (too few words, or too many in repeated
windows of three). All of it is one narrow projection per row: no shuffle, no join, no state.

Repeated windows are found by sorting 64-bit integers, 40 bits of a window's hash and its place, and comparing the words of neighbours;
texts where hashes meet by chance, and those of more than 16 million words, are done by sorting the windows themselves.

Defined results: a null or empty text has no words, fails the base and is rejected; repeated rows give repeated rows;
an empty table gives an empty table; other columns are left out by ``judge`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import column, documents, words_of

# Rules of the base.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Characters that are rare in prose; a line with so large a share of them (percent, and so many at least) fails.
SYMBOLS, MOST_SYMBOLS, LEAST_SYMBOLS = "#*$%&|<>!?={}[]^_~@/\\+", 8, 4
#: Separators of menus; a line with so many of them, and one for every so many words or fewer, fails.
SEPARATORS, LEAST_SEPARATORS, WORDS_A_SEPARATOR = "|>»•·", 4, 4
#: A line of so many words without any mark that ends a sentence or part of one fails.
LONG_LINE, MARKS = 40, ".!?:;,…。"
#: A line that ends so is a teaser for a text elsewhere and fails.
TEASERS = ("...", "…")
#: A line with so many spaces at most that doesn't end in one of these marks is like an item of a menu; it fails if the text has it more than once.
ITEM_SPACES, ITEM_ENDS = 3, ".!?:;,…。\"')]"
#: Phrases of page furniture, lower case (fixed list), in English, German, French and Spanish.
BOILERPLATE = (
    "lorem ipsum", "javascript", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "subscribe to our newsletter", "sign up for free", "skip to content",
    "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken", "newsletter abonnieren",
    "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "cliquez ici", "abonnez-vous à notre",
    "política de privacidad", "política de cookies", "condiciones de uso", "todos los derechos reservados", "haga clic aquí", "suscríbete a nuestro",
)
#: A document is kept if lines with at least this share (percent) of its word characters are left.
LEAST_KEPT = 50
_BLANK = " \t\n\x0b\x0c\r"
_PLACE_BITS = 24


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _one_of(characters: str) -> str:
    """Pattern of one of the characters."""
    return "[" + "".join("\\" + c if c in "\\[]^-&" else c for c in characters) + "]"


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(_one_of(characters)))


def _word_chars(text: Column) -> Column:
    return F.char_length(F.array_join(words_of(text), ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three that the text has twice or more."""
    mask = (1 << _PLACE_BITS) - 1
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - 3)
    none = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda q, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - q, F.lit(3))))
        return F.aggregate(step, none, lambda s, x: s + x)

    def by_words(w: Column) -> Column:
        """Windows sorted as text, which has no white space of its own."""
        windows = F.array_sort(F.transform(starts(w), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.cast("long").alias("i"))))

        def repeated(x: Column) -> Column:
            same = lambda v, o: F.coalesce(v["t"] == o["t"], F.lit(False))
            return F.transform(F.filter(x, lambda v, k: same(v, F.get(x, k - 1)) | same(v, F.get(x, k + 1))), lambda v: v["i"])

        return _let(_let(windows, lambda x: F.sort_array(repeated(x))), covered)

    def by_hashes(w: Column) -> Column:
        """As integers: some bits of a window's hash, then its place. Neighbours of equal bits are compared by their words;
        where those differ, places of equal windows may stand apart, and the text is done by its words."""
        packed = F.sort_array(F.transform(starts(w), lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _PLACE_BITS).bitwiseOR(i.cast("long"))))
        bits = lambda v: F.shiftright(v, _PLACE_BITS)
        place = lambda v: v.bitwiseAND(mask).cast("int")

        def differ(v: Column, o: Column) -> Column:
            return (bits(v) == bits(o)) & ~((F.get(w, place(v)) == F.get(w, place(o))) & (F.get(w, place(v) + 1) == F.get(w, place(o) + 1)) & (F.get(w, place(v) + 2) == F.get(w, place(o) + 2)))

        def of_twice(twice: Column) -> Column:
            mixed = F.size(F.filter(twice, lambda v, k: F.coalesce(differ(v, F.get(twice, k - 1)), F.lit(False)))) > 0
            return F.when(F.size(twice) == 0, none).when(mixed, by_words(w)).otherwise(_let(F.sort_array(F.transform(twice, lambda v: v.bitwiseAND(mask))), covered))

        def of_packed(p: Column) -> Column:
            near = lambda v, o: F.coalesce(bits(v) == bits(o), F.lit(False))
            return _let(F.filter(p, lambda v, k: near(v, F.get(p, k - 1)) | near(v, F.get(p, k + 1))), of_twice)

        return _let(packed, of_packed)

    return _let(words, lambda w: F.when(F.size(w) < 3, none).when(F.size(w) >= 1 << _PLACE_BITS, by_words(w)).otherwise(by_hashes(w)))


def like_an_item(line: Column) -> Column:
    """Whether a line is short and doesn't end as a sentence does."""
    last = F.right(F.rtrim(line, F.lit(_BLANK)), F.lit(1))
    return (F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) <= ITEM_SPACES) & ~F.contains(F.lit(ITEM_ENDS), last)


def repeated_items(lines: Column) -> Column:
    """The lines like items that a text has more than once; texts without equal lines are told by their number of different ones."""
    twice = lambda x: F.array_distinct(F.filter(x, lambda v, k: F.coalesce(v == F.get(x, k + 1), F.lit(False))))
    found = _let(F.sort_array(F.filter(lines, like_an_item)), twice)
    return F.when(F.size(lines) == F.size(F.array_distinct(lines)), F.array().cast("array<string>")).otherwise(found)


def line_passes(line: Column, has_phrase: Column, items: Column) -> Column:
    """The rules for one line; ``has_phrase``: whether its text has a phrase of BOILERPLATE at all, ``items``: its repeated items."""
    ending = F.rtrim(line, F.lit(_BLANK))
    teaser = F.lit(False)
    for mark in TEASERS:
        teaser = teaser | F.endswith(ending, F.lit(mark))
    symbols, separators = _count(line, SYMBOLS), _count(line, SEPARATORS)
    punctuation = (symbols >= LEAST_SYMBOLS) & (symbols * 100 > F.char_length(line) * MOST_SYMBOLS)
    spaces = F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit("")))
    navigation = (separators >= LEAST_SEPARATORS) & (separators * WORDS_A_SEPARATOR >= spaces)
    endless = ~F.rlike(line, F.lit(_one_of(MARKS))) & (spaces >= LONG_LINE)
    return ~(punctuation | navigation | endless | teaser | F.array_contains(items, line) | (has_phrase & _has_phrase(F.lower(line))))


def _has_phrase(lower: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(lower, F.lit(phrase))
    return found


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned``."""
    text = F.coalesce(column(text_col), F.lit(""))
    t = docs.select(column(id_col).alias("doc_id"), text.alias("t"), F.lower(text).alias("lower"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    t = t.select("doc_id", "t", words_of(F.col("t")).alias("words"), lines.alias("lines"), _has_phrase(F.col("lower")).alias("has_phrase"))
    t = t.withColumn("items", repeated_items(F.col("lines")))
    t = t.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("t"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array_join(F.filter("lines", lambda x: line_passes(x, F.col("has_phrase"), F.col("items"))), "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    left = _word_chars(F.col("cleaned")) * 100 >= F.col("word_chars") * LEAST_KEPT
    return t.select("*", failed.alias("base_failed"), (~failed & left).alias("kept"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows; of the others, lines that fail are taken out of the text."""
    judged = judge(docs.select(F.struct(*map(column, docs.columns)).alias("__row"), column(text_col).alias("__text")), "__row", "__text")
    # the generator keeps the filter from being pushed below, where all that it needs would be made twice
    judged = judged.select(F.explode(F.array(F.struct("doc_id", "cleaned", "kept"))).alias("x")).where("x.kept")
    return judged.select(*[F.col("x.cleaned").alias(c) if c == text_col else F.col("x.doc_id").getField(c).alias(c) for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("cleaned")


def _sql_line() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda c: f"(length(x) - length(translate(x, {quote(c)}, '')))"
    spaces = "(length(x) - length(replace(x, ' ', '')))"
    rules = [f"({count(SYMBOLS)} >= {LEAST_SYMBOLS} AND {count(SYMBOLS)} * 100 > length(x) * {MOST_SYMBOLS})", f"({count(SEPARATORS)} >= {LEAST_SEPARATORS} AND {count(SEPARATORS)} * {WORDS_A_SEPARATOR} >= {spaces})", f"({spaces} >= {LONG_LINE} AND {count(MARKS)} = 0)"]
    rules += [f"ends_with(rtrim(x, {_SQL_BLANK}), {quote(m)})" for m in TEASERS] + ["list_contains(tw, x)"]
    rules += [f"contains(lower(x), {quote(p)})" for p in BOILERPLATE]
    return " OR ".join(rules)


_SQL_BLANK = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _sql_item() -> str:
    ends = "'" + ITEM_ENDS.replace("'", "''") + "'"
    return f"(length(x) - length(replace(x, ' ', ''))) <= {ITEM_SPACES} AND NOT contains({ends}, right(rtrim(x, {_SQL_BLANK}), 1))"


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 p AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 it AS (SELECT doc_id, unnest(list_filter(l, lambda x: {_sql_item()})) AS x FROM p),
 tw AS (SELECT doc_id, list(x) AS tw FROM (SELECT doc_id, x FROM it GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
 win AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS k FROM p, unnest(range(1, len(w) - 1)) AS u(i)),
 dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
 rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, unnest([0, 1, 2]) AS v(j) GROUP BY doc_id),
 c AS (SELECT doc_id, array_to_string(list_filter(l, lambda x: NOT ({_sql_line()})), chr(10)) AS cleaned FROM (SELECT p.doc_id, l, coalesce(tw, []) AS tw FROM p LEFT JOIN tw ON tw.doc_id = p.doc_id)),
 q AS (SELECT p.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
   length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
   coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(coalesce(cleaned, ''), '[\x20\x09-\x0D]+', '', 'g')) AS left_chars
   FROM p LEFT JOIN rep ON rep.doc_id = p.doc_id JOIN c ON c.doc_id = p.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
 NOT (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND left_chars * 100 >= word_chars * {LEAST_KEPT} AS kept FROM q
"""
