"""URL filters as a temporal list join.

List entries are dated: an entry adds a key to a list or removes it from then on. A key is a domain, which holds for its
subdomains, or a whole address without scheme, query and fragment. Entries become validity intervals [since, until): an
added key is valid until the next entry of the same list and key. A capture is filtered by what was valid when it was
fetched: its address and each suffix of its host are joined with the intervals that hold its time, so an interval join on
equal keys answers the as-of question and at most one interval of a list and key meets a capture.

Only keys, times and row numbers are shuffled. A host with a large share of the captures meets a handful of intervals,
and Spark splits its partition, as the join is an inner one of two shuffled sides. Matches are folded per capture with
map-side combination.

Null addresses, and addresses without a host, match nothing; a null time matches nothing. Same-day entries of a key:
removal wins; repeated entries count once. Repeated captures are reported each. Empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: The example lists, and the days that entries and fetches span.
LISTS = ("adult", "malware", "spam")
START, DAYS = "2024-01-01", 366


def host(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; null if there is none."""
    h = F.regexp_extract(ascii_lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)
    return F.when(h != "", h)


def address(url: Column) -> Column:
    """Host and path."""
    return F.concat(host(url), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))


def keys(url: Column) -> Column:
    """What a list may name: the address and every suffix of the host at a dot."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.array_append(suffixes, F.concat(F.lit("url:"), address(url)))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, since, until (null: still valid) from dated entries (list, key, day, added)."""
    last = entries.groupBy("list", "key", "day").agg(F.min("added").alias("added"))
    after = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    return last.withColumn("until", after).filter("added").select("list", "key", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", capture_id: str = "page_id") -> DataFrame:
    """capture_id, url, fetched, blocked, lists (sorted, comma-joined), n_entries for each row of captures."""
    rows = captures.select(F.monotonically_increasing_id().alias("rid"), F.col(capture_id).alias(capture_id), F.col(url).alias("url"), F.col(fetched).alias("fetched"))
    rows = materialize(rows, "captures")  # both sides below must see the same numbers
    # The null key meets nothing and keeps captures without a match.
    asked = rows.select("*", F.explode(F.array_append(F.coalesce(keys(F.col("url")), F.array().cast("array<string>")), F.lit(None).cast("string"))).alias("__key"))
    valid = intervals(entries).withColumnRenamed("list", "__list")
    holds = (F.col("__key") == F.col("key")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    matched = asked.filter("__key IS NOT NULL").select("rid", "__key", "fetched").join(valid, holds).groupBy("rid").agg(
        F.array_join(F.sort_array(F.collect_set("__list")), ",").alias("lists"), F.count(F.lit(1)).alias("n_entries")
    )
    return rows.join(matched, "rid", "left").select(
        capture_id, "url", "fetched", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries")
    )


def keep_clean(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", capture_id: str = "page_id") -> DataFrame:
    return filter_urls(captures, entries, url, fetched, capture_id).filter("NOT blocked")


def _digit(c: Column, first: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(c), first, n), 16, 10).cast("int")


def example_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day made from their number."""
    day = F.date_add(F.lit(START).cast("date"), F.pmod(F.coalesce("page_id", F.lit(0)) * 7919, F.lit(DAYS)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def example_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made by rule from the pages' own hosts and addresses: some added, some of those removed, some of
    those added again."""
    named = pages.select(F.explode(F.array(
        F.concat(F.lit("domain:"), host(F.col("url"))),
        F.concat(F.lit("domain:"), F.regexp_extract(host(F.col("url")), r"^[^.]+\.(.+\..+)$", 1)),
        F.concat(F.lit("url:"), address(F.col("url"))),
    )).alias("key")).filter("key IS NOT NULL AND key <> 'domain:'").distinct()
    k = F.col("key")
    first = _digit(k, 3, 4) % 200
    listed = named.filter(_digit(k, 1, 2) < F.when(k.startswith("url:"), 16).otherwise(80))
    what = F.array(
        F.struct(first.alias("at"), F.lit(True).alias("added")),
        F.when(_digit(k, 7, 1) < 8, F.struct((first + 60).alias("at"), F.lit(False).alias("added"))),
        F.when(_digit(k, 7, 1) < 4, F.struct((first + 100).alias("at"), F.lit(True).alias("added"))),
    )
    dated = listed.select(F.get(F.array(*map(F.lit, LISTS)), _digit(k, 8, 2) % 3).alias("list"), "key", F.explode(F.array_compact(what)).alias("e"))
    return dated.select("list", "key", F.date_add(F.lit(START).cast("date"), F.col("e.at")).alias("day"), F.col("e.added").alias("added"))


ORACLE_SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, url, DATE '{START}' + CAST((coalesce(page_id, 0) * 7919) % {DAYS} AS INTEGER) AS fetched,
  nullif(regexp_extract(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1), '') AS host,
  regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
n AS (SELECT DISTINCT key FROM (SELECT unnest(['domain:' || host, 'domain:' || regexp_extract(host, '^[^.]+\.(.+\..+)$', 1), 'url:' || host || path]) AS key FROM p) WHERE key IS NOT NULL AND key <> 'domain:'),
h AS (SELECT key, CAST('0x' || substr(md5(key), 1, 2) AS INTEGER) AS a, CAST('0x' || substr(md5(key), 3, 4) AS INTEGER) % 200 AS b, CAST('0x' || substr(md5(key), 7, 1) AS INTEGER) AS c,
  ['adult', 'malware', 'spam'][1 + CAST('0x' || substr(md5(key), 8, 2) AS INTEGER) % 3] AS list FROM n),
l AS (SELECT * FROM h WHERE a < CASE WHEN starts_with(key, 'url:') THEN 16 ELSE 80 END),
e AS (SELECT list, key, DATE '{START}' + b AS day, true AS added FROM l UNION ALL SELECT list, key, DATE '{START}' + (b + 60), false FROM l WHERE c < 8
  UNION ALL SELECT list, key, DATE '{START}' + (b + 100), true FROM l WHERE c < 4),
v AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM e) WHERE added),
q AS (SELECT rid, fetched, unnest(list_append(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')), 'url:' || host || path)) AS key FROM p WHERE host IS NOT NULL),
m AS (SELECT rid, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM q JOIN v ON q.key = v.key AND v.day <= q.fetched AND (v.until IS NULL OR q.fetched < v.until) GROUP BY rid)
SELECT page_id, url, fetched, n_entries IS NOT NULL AS blocked, coalesce(lists, '') AS lists, coalesce(n_entries, 0) AS n_entries FROM p LEFT JOIN m USING (rid)
"""
