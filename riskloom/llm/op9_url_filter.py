"""Operator 9: URL filters by a temporal list join, in DataFrame functions only.

A list is a table of dated entries: on a day, a key (a host, a domain or a path prefix of a host) is put on the list of a category
or taken off it. Entries become validity intervals, and each capture is joined as of its fetch day with the intervals of the keys
that its address has.

Plan: entries of one key, category and day are combined first (the last one counts), changes that change nothing are
dropped, so a key has at most one interval for every two days, however many entries it has. Intervals are cut at
months, so the as-of join is an equi-join on key and month with a few rows to compare. A host that has a third of all captures is
spread by a salt: its captures by number, its intervals (bounded per month) to every salt.

Defined results: a null or malformed address has no keys and is kept; a null fetch day matches nothing; repeated captures give
repeated rows; entries with a null key, category or day are ignored; empty tables give an empty result, or captures
that are all kept; other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts that the captures of one key are spread over.
SALTS = 16
_FOREVER = "9999-12-31"


def address_keys(url):
    """Column: the keys of an address, from its host to its domain, and the host with each prefix of its path."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, n), ".")))
    segments = F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)", 1), "/")
    ends = F.filter(F.sequence(F.lit(1), F.size(segments)), lambda i: F.element_at(segments, i) != "")
    prefixes = F.transform(ends, lambda i: F.concat(F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, prefixes)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``key, category, valid_from, valid_to`` (exclusive) from ``key, category, day, entry_id, listed`` (boolean).

    On one day the entry with the largest id counts.
    """
    daily = entries.where("key is not null and category is not null and day is not null").groupBy("key", "category", "day").agg(F.max(F.struct("entry_id", F.coalesce("listed", F.lit(False)).alias("listed"))).alias("last"))
    days = Window.partitionBy("key", "category").orderBy("day")
    state = daily.select("key", "category", "day", F.col("last.listed").alias("listed"))
    changes = state.withColumn("was", F.coalesce(F.lag("listed").over(days), F.lit(False))).where("listed != was")
    return changes.select("key", "category", F.col("day").alias("valid_from"), F.coalesce(F.lead("day").over(days), F.lit(_FOREVER).cast("date")).alias("valid_to"), "listed").where("listed").drop("listed")


def filter_captures(captures: DataFrame, intervals: DataFrame, salts: int = SALTS) -> DataFrame:
    """A capture is told by its page, its day and a hash of its address; those of one page and day with one hash but two addresses, if there
    were any, would count as one. ``captures``: ``page_id, url, fetched``. Adds ``n_keys``, ``n_matches``, ``categories`` (sorted, joined by commas) and ``kept``."""
    keyed = captures.select("page_id", "url", "fetched", address_keys(F.col("url")).alias("keys"))
    span = keyed.agg(F.min("fetched").alias("first"), F.max("fetched").alias("last")).first()
    month = lambda d: F.year(d) * 12 + F.month(d)
    asked = keyed.withColumn("row", F.xxhash64("page_id", "url", "fetched")).select("row", "page_id", "fetched", F.explode("keys").alias("key"), month("fetched").alias("month")).distinct()
    asked = asked.withColumn("salt", F.pmod("row", F.lit(salts)))
    if span["first"] is None:
        held = intervals.limit(0).withColumn("month", F.lit(0)).withColumn("salt", F.lit(0).cast("long"))
    else:
        # months in which there are captures; a longer interval has no more parts than these
        first, last = (x.year * 12 + x.month for x in (span["first"], span["last"]))
        begin, end = F.greatest(month("valid_from"), F.lit(first)), F.least(month(F.date_sub("valid_to", 1)), F.lit(last))
        held = intervals.where(begin <= end).withColumn("month", F.explode(F.sequence(begin, end))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    hits = asked.join(held, ["key", "month", "salt"]).where("fetched >= valid_from and fetched < valid_to")
    per_row = hits.groupBy(F.col("row").alias("of_row"), F.col("page_id").alias("of_page"), F.col("fetched").alias("of_day")).agg(F.count("*").alias("n_matches"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    same = (F.col("row") == F.col("of_row")) & F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("fetched") == F.col("of_day"))
    out = keyed.withColumn("row", F.xxhash64("page_id", "url", "fetched")).join(per_row, same, "left")
    n = F.coalesce("n_matches", F.lit(0))
    return out.select("page_id", "url", "fetched", F.size("keys").cast("long").alias("n_keys"), n.alias("n_matches"), F.coalesce("categories", F.lit("")).alias("categories"), (n == 0).alias("kept"))


#: First fetch day of the derived captures, and the days that they and the entries spread over.
FIRST_DAY, DAYS = "2024-01-01", 360


def derived_captures(pages: DataFrame) -> DataFrame:
    """The given pages have no fetch day: it follows from the page's number."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("int")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """List entries from the given pages: each page whose number is divisible by 4 reports one of its keys on some day, and pages
    divisible by 12 take one off again. So entries grow with the pages, and a host with many pages has many entries. Most keys
    are full hosts, every fourth one is the longest prefix of the path, every sixteenth the domain."""
    some = pages.where("page_id % 4 = 0").select("page_id", address_keys(F.col("url")).alias("keys"))
    listed = F.col("page_id") % 12 != 0
    category = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), (F.pmod((F.col("page_id") / 4).cast("long"), F.lit(3)) + 1).cast("int"))
    domain = F.element_at(F.filter("keys", lambda k: k.startswith("host:")), -1)
    chosen = some.where("size(keys) > 0").withColumn("key", F.when(F.col("page_id") % 64 == 0, domain).when(F.col("page_id") % 16 == 8, F.element_at("keys", -1)).otherwise(F.element_at("keys", 1)))
    return chosen.select("key", category.alias("category"), F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 104729, F.lit(DAYS)).cast("int")).alias("day"), F.col("page_id").alias("entry_id"), listed.alias("listed"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = filter_captures(derived_captures(pages), validity_intervals(derived_entries(pages)))
    return found.withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
   string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)', 1), '/') AS seg, DATE '2024-01-01' + ((page_id * 7919) % 360)::INTEGER AS fetched FROM pages),
 l AS (SELECT *, string_split(host, '.') AS lab FROM p),
 k AS (SELECT page_id, url, fetched, CASE WHEN coalesce(host, '') = '' THEN [] ELSE list_concat(list_transform(range(1, greatest(len(lab) - 1, 1) + 1), lambda i: 'host:' || array_to_string(lab[i:], '.')),
   list_transform(list_filter(range(1, len(seg) + 1), lambda i: seg[i] <> ''), lambda i: 'path:' || host || '/' || array_to_string(seg[:i], '/'))) END AS keys FROM l),
 e AS (SELECT CASE WHEN page_id % 64 = 0 THEN list_filter(keys, lambda x: starts_with(x, 'host:'))[-1] WHEN page_id % 16 = 8 THEN keys[-1] ELSE keys[1] END AS key, (['adult', 'malware', 'spam'])[((page_id // 4) % 3 + 1)] AS category,
   DATE '2024-01-01' + ((page_id * 104729) % 360)::INTEGER AS day, page_id AS entry_id, page_id % 12 <> 0 AS listed FROM k WHERE page_id % 4 = 0 AND len(keys) > 0),
 d AS (SELECT key, category, day, arg_max(listed, entry_id) AS listed FROM e GROUP BY ALL),
 s AS (SELECT *, lead(day) OVER (PARTITION BY key, category ORDER BY day) AS next_day FROM d),
 hit AS (SELECT c.page_id, count(*) FILTER (WHERE s.listed) AS n, string_agg(DISTINCT s.category, ',' ORDER BY s.category) FILTER (WHERE s.listed) AS cats
   FROM (SELECT page_id, fetched, unnest(keys) AS key FROM k) c JOIN s ON s.key = c.key AND c.fetched >= s.day AND (s.next_day IS NULL OR c.fetched < s.next_day) GROUP BY c.page_id)
SELECT k.page_id, k.url, strftime(k.fetched, '%Y-%m-%d') AS fetched, len(k.keys)::BIGINT AS n_keys, coalesce(h.n, 0)::BIGINT AS n_matches, coalesce(h.cats, '') AS categories, coalesce(h.n, 0) = 0 AS kept
FROM k LEFT JOIN hit h ON h.page_id = k.page_id
"""
