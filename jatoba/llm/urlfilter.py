"""URL filtering by a temporal list join.

A list is a log of dated entries: (key, action, at), where the action blocks or allows the key from
then on, or lifts what was said about it.  A key is a host suffix ("example.com") or a host with a
path prefix ("blog.example.com/en").  Consecutive entries of a key bound each other, so the log turns
into validity intervals [valid_from, valid_to); a capture is joined to the intervals of its own keys
that hold at its fetch time.  Of the active entries the most specific key decides (longest path, then
longest host); at equal keys blocking wins.

The join is an equi-join on the key with the interval as a residual condition; a key has few
intervals, so captures are never multiplied, and a host with a third of all captures is split by the
skew join (or not shuffled at all where the list is small enough to broadcast, which is checked).

Edge cases: a null or unparsable url, or a null fetch time, has no keys and is not blocked; entries
with a null key, action or date are ignored; of entries of a key at the same instant, the blocking
one wins, then the allowing one; rows that repeat are judged each; empty tables give no rows, or no
blocks; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import pick, table

#: The most intervals that are broadcast; a longer list is joined by a shuffle.
BROADCAST_ROWS = 100_000


def host(url: Column) -> Column:
    """Lower case, without user, port and closing dot; null where there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")
    return F.when(found != "", found)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def keys(url: Column, depth: Column) -> Column:
    """All keys that may name this url: host suffixes of two labels or more, and path prefixes."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    k = F.least(F.size(parts), depth)
    prefixes = F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(suffixes, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, at) to (key, action, valid_from, valid_to); an open end is null; lifted spans are left out."""
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    clean = entries.filter("key is not null and action in ('block', 'allow', 'lift') and at is not null").withColumn("rank", rank)
    one = clean.groupBy("key", "at").agg(F.max_by("action", "rank").alias("action"))
    w = W.partitionBy("key").orderBy("at")
    return one.select("key", "action", F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to")).filter("action <> 'lift'")


def judge(captures: DataFrame, entries: DataFrame, key: str, url: str, fetched: str) -> DataFrame:
    """One row per capture: its key column, host, fetched, blocked, matched_key, valid_from."""
    valid = intervals(entries)
    size, depth = valid.agg(F.count(F.lit(1)), F.max(F.size(F.split("key", "/")) - 1)).first()
    if size <= BROADCAST_ROWS:
        valid = F.broadcast(valid)
    rows = captures.select(F.col(key).alias("__id"), F.col(url).alias("__url"), F.col(fetched).alias("__at"))
    asked = rows.select("*", F.explode_outer(F.when(F.col("__at").isNotNull(), keys(F.col("__url"), F.lit(depth or 0)))).alias("key"))
    hit = asked.join(valid, (asked["key"] == valid["key"]) & (asked["__at"] >= valid["valid_from"]) & (valid["valid_to"].isNull() | (asked["__at"] < valid["valid_to"])), "left").drop(valid["key"])
    specific = F.struct(
        (F.size(F.split("key", "/")) - 1).alias("d"), F.length("key").alias("n"), (F.col("action") == "block").alias("block"), F.col("key").alias("k"), F.col("valid_from").alias("f")
    )
    best = hit.groupBy("__id", "__url", "__at").agg(F.max(F.when(F.col("action").isNotNull(), specific)).alias("best"), F.countDistinct("key").alias("__keys"), F.count(F.lit(1)).alias("__n"))
    # rows that repeat met in one group: give each its verdict again
    copies = F.greatest(F.lit(1), (F.col("__n") / F.greatest(F.lit(1), F.col("__keys"))).cast("int"))
    again = best.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("__copy"))
    return again.select(
        F.col("__id").alias(key), host(F.col("__url")).alias("host"), F.col("__at").alias(fetched),
        F.coalesce(F.col("best.block"), F.lit(False)).alias("blocked"), F.col("best.k").alias("matched_key"), F.col("best.f").alias("valid_from"),
    )


# ---- the registered query: pages have no dates and no list, so both follow a stated rule ----------

#: 2024-01-01 and two years, in seconds.
EPOCH, SPAN, DAY = 1_704_067_200, 63_072_000, 86_400


def _digit(col: Column, at: int) -> Column:
    """A number 0..255 from the MD5 of a name."""
    return F.conv(F.substring(F.md5(col.cast("binary")), at, 2), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(EPOCH) + F.pmod(F.col("page_id") * 7919 * 3600, F.lit(SPAN))).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the sites (last three labels) seen in pages: two in five are blocked, lifted and
    blocked again on days that depend on the name; the path /en of one in five is allowed meanwhile."""
    site = pages.select(F.regexp_extract(host(F.col("url")), r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("site")).filter("site <> ''").distinct()
    a, b, c = (_digit(F.col("site"), i) for i in (1, 3, 5))
    day = lambda x: (F.lit(EPOCH) + x * DAY).cast("bigint")
    rows = [(F.col("site"), "block", day(a), a % 5 < 2), (F.col("site"), "lift", day(a + b + 1), a % 5 < 2), (F.col("site"), "block", day(a + b + c + 2), a % 5 < 2), (F.concat(F.col("site"), F.lit("/en")), "allow", day(b), b % 5 == 0)]
    made = F.array(*[F.struct(k.alias("key"), F.lit(x).alias("action"), at.alias("at"), on.alias("on")) for k, x, at, on in rows])
    return site.select(F.explode(made).alias("e")).select("e.*").filter("on").drop("on")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(table(spark, sf_dir, "pages"), page_id="bigint", url="string")
    return judge(page_captures(pages), page_entries(pages), "page_id", "url", "fetched")


ORACLE = rf"""
WITH p AS (
  SELECT page_id, {EPOCH} + (page_id * 7919 * 3600) % {SPAN} AS fetched,
    rtrim(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
s AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS site FROM p),
d AS (SELECT site, ('0x' || substr(md5(site), 1, 2))::INT AS a, ('0x' || substr(md5(site), 3, 2))::INT AS b, ('0x' || substr(md5(site), 5, 2))::INT AS c FROM s WHERE site <> ''),
e AS (
  SELECT site AS key, 'block' AS action, {EPOCH} + a * {DAY} AS ts FROM d WHERE a % 5 < 2
  UNION ALL SELECT site, 'lift', {EPOCH} + (a + b + 1) * {DAY} FROM d WHERE a % 5 < 2
  UNION ALL SELECT site, 'block', {EPOCH} + (a + b + c + 2) * {DAY} FROM d WHERE a % 5 < 2
  UNION ALL SELECT site || '/en', 'allow', {EPOCH} + b * {DAY} FROM d WHERE b % 5 = 0),
v AS (SELECT key, action, ts AS valid_from, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS valid_to FROM e),
k AS (
  SELECT page_id, fetched, host, array_to_string(string_split(host, '.')[i:], '.') AS key FROM (SELECT *, unnest(range(1, len(string_split(host, '.')))) AS i FROM p)
  UNION ALL SELECT page_id, fetched, host, host || '/' || string_split(path, '/')[2] FROM p WHERE len(string_split(path, '/')) > 1 AND string_split(path, '/')[2] <> ''),
m AS (
  SELECT page_id, k.key, action, valid_from,
    row_number() OVER (PARTITION BY page_id ORDER BY contains(k.key, '/') DESC, length(k.key) DESC, action DESC) AS r
  FROM k JOIN v ON k.key = v.key AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to) AND action <> 'lift')
SELECT p.page_id, host, fetched, coalesce(action = 'block', false) AS blocked, m.key AS matched_key, valid_from
FROM p LEFT JOIN m ON m.page_id = p.page_id AND r = 1
"""
