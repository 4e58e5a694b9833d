"""URL filters as they stood when a page was fetched: a temporal list join.

A filter list is a table of dated entries (key, entry_date, action ``add`` or
``remove``, category); a key is a host and covers its subdomains. Entries of a key become
validity intervals, from one entry to the next. Every capture is matched as of its fetch
date against the intervals of its host and of each of the host's parent domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals to broadcast; a longer list is shuffled, each key dealt over ``SALTS`` parts.
BROADCAST_ROWS, SALTS = 500_000, 16
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and final dot; null if it has none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    return F.when(found != "", found)


def domains(name: Column) -> Column:
    """A host and its parent domains of two labels or more; the host alone if it has one label."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """key, valid_from, valid_to (exclusive, null: still valid), category of every ``add``.

    Entries of one key follow each other by date; on one date an ``add`` comes before a
    ``remove``, and of equal ones the larger category is the last. Each entry ends the one
    before it, so an interval may be empty (it then matches nothing). Entries without key
    or date and other actions are left out; repeated entries change nothing.
    """
    known = entries.select(F.lower("key").alias("key"), "entry_date", "action", "category").filter(F.col("key").isNotNull() & F.col("entry_date").isNotNull() & F.col("action").isin("add", "remove")).distinct()
    order = Window.partitionBy("key").orderBy("entry_date", "action", F.col("category").asc_nulls_first())
    return known.withColumn("valid_to", F.lead("entry_date").over(order)).filter((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("entry_date")))).select("key", F.col("entry_date").alias("valid_from"), "valid_to", "category")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with blocked, n_matches and category (the least that matches, else null).

    Columns of these names are replaced, others kept. Captures without a URL, host or
    fetch date match nothing and are not blocked. Every row gives one row, repeats too.
    """
    added = ("blocked", "n_matches", "category")
    kept = [c for c in captures.columns if c not in added]
    rows = captures.select(F.struct(*kept).alias("_row"), F.col(fetched).alias("_at"), host(F.col(url)).alias("_host"))
    active = intervals(entries).withColumnRenamed("key", "_key")
    # A verdict depends on host and date alone, so each pair is asked once and named by these, not by a row number.
    asked = rows.select("_host", "_at").filter("_host is not null and _at is not null").distinct().select("_host", "_at", F.explode(domains(F.col("_host"))).alias("_key"))
    within = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    if active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # The list side is small: each pair is answered where it lies.
        by_key = F.broadcast(active.groupBy("_key").agg(F.collect_list(F.struct("valid_from", "valid_to", "category")).alias("_list")))
        hits = asked.join(by_key, "_key").select("_host", "_at", F.explode("_list").alias("_e")).select("_host", "_at", "_e.*").filter(within)
    else:
        # A domain may hold a third of the hosts: pairs are dealt by key and salt, intervals repeated.
        salted = asked.withColumn("_salt", F.pmod(F.xxhash64("_host", "_at"), F.lit(SALTS)))
        spread = active.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hits = salted.join(spread, ["_key", "_salt"]).filter(within)
    verdict = hits.groupBy("_host", "_at").agg(F.count("*").alias("n_matches"), F.min("category").alias("category"))
    joined = rows.join(verdict, ["_host", "_at"], "left")
    return joined.select("_row.*", F.col("n_matches").isNotNull().alias("blocked"), F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), "category")


CATEGORIES = ("adult", "malware", "spam")


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for the query: a quarter of the hosts and of their parents, by their MD5.

    Each gets one to three entries, adding and removing it in turn.
    """
    number = lambda at: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, 4), 16, 10).cast("int")
    keys = pages.select(F.explode(domains(host(F.col("url")))).alias("key")).distinct().filter(number(1) % 4 == 0)
    step = F.explode(F.sequence(F.lit(0), number(5) % 3)).alias("i")
    timed = keys.select("key", number(9).alias("n"), number(13).alias("c"), step)
    return timed.select(
        "key",
        F.expr("date_add(date'2024-01-01', cast(n % 200 + i * (20 + n % 60) as int))").alias("entry_date"),
        F.when(F.col("i") % 2 == 0, "add").otherwise("remove").alias("action"),
        F.get(F.array(*map(F.lit, CATEGORIES)), F.col("c") % 3).alias("category"),
    )


def op3(pages: DataFrame) -> DataFrame:
    """Every page as a capture of day ``page_id mod 365`` of 2024, against :func:`dated_list`."""
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 365 as int))").alias("fetched"))
    return evaluate(captures, dated_list(pages)).select("page_id", F.col("fetched").cast("string").alias("fetched"), "blocked", "n_matches", "category")


ORACLE = r"""
WITH hosts AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INT) AS fetched,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', '') AS host
  FROM pages),
keys AS (
  SELECT page_id, fetched, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
         lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS key
  FROM hosts WHERE host <> ''),
listed AS (
  SELECT key, CAST(('0x' || substr(md5(key), 5, 4)) AS INT) % 3 AS last_i, CAST(('0x' || substr(md5(key), 9, 4)) AS INT) AS n,
         CAST(('0x' || substr(md5(key), 13, 4)) AS INT) AS c
  FROM (SELECT DISTINCT key FROM keys) WHERE CAST(('0x' || substr(md5(key), 1, 4)) AS INT) % 4 = 0),
entries AS (
  SELECT key, DATE '2024-01-01' + CAST(n % 200 + i * (20 + n % 60) AS INT) AS entry_date, i % 2 = 0 AS adds,
         ['adult', 'malware', 'spam'][1 + c % 3] AS category
  FROM (SELECT *, unnest(range(0, last_i + 1)) AS i FROM listed)),
intervals AS (
  SELECT key, entry_date AS valid_from, lead(entry_date) OVER (PARTITION BY key ORDER BY entry_date) AS valid_to, adds, category FROM entries),
hits AS (
  SELECT k.page_id, count(*) AS n, min(category) AS category
  FROM keys k JOIN intervals v ON k.key = v.key AND v.adds AND k.fetched >= v.valid_from AND (v.valid_to IS NULL OR k.fetched < v.valid_to)
  GROUP BY 1)
SELECT h.page_id, strftime(h.fetched, '%Y-%m-%d') AS fetched, x.n IS NOT NULL AS blocked, coalesce(x.n, 0) AS n_matches, x.category
FROM hosts h LEFT JOIN hits x USING (page_id)
"""
