"""URL filters by a temporal list join. All of it is DataFrame and SQL functions.

A list is a log of dated events: an entry (a host with all below it, or a host and path prefix) is added or removed on a day. A window over
each entry's own events turns the log into validity intervals, from the day it is added to the day it is removed. A capture is
blocked if an entry that matches its URL is active at the time it was fetched: the as-of join of the capture's keys (its host's
suffixes, its path's prefixes, of the lengths that entries have) and the interval that holds its day.

Distinct pairs of a URL and a day are looked up once, so a hot host or URL costs what it has of different pairs. Intervals are
broadcast up to BROADCAST bytes and joined by a shuffle beyond that; a key is one row per interval there, so that the skew
join handling can split captures' hot keys.

Defined cases. Null URLs or fetch times, and URLs without a host: never blocked. Events without a day or value are void. An entry
added twice stays; removed before it is added: no interval. On one day a removal comes after an addition. Repeated captures:
a row each. Extra columns are kept by filter_urls(), whatever their names. An empty table or list: nothing is blocked. Very long
URLs: matched whole, with a key for each shape of an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, table

#: Bytes of intervals (about) up to which they are broadcast.
BROADCAST = 16 << 20
INTERVAL_BYTES = 64
#: Different shapes (labels of a host, parts of a path) that a list's entries may have; more are an error.
MOST_SHAPES = 400
URL = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"

#: The list of the registered query: entry, event, day.
EVENTS = (
    ("cheap-pills.example.com", "add", "2024-01-10"), ("cheap-pills.example.com", "remove", "2024-05-01"), ("cheap-pills.example.com", "add", "2024-08-15"),
    ("casino.example.net", "add", "2024-02-01"), ("tionsh.example.net", "add", "2024-03-01"), ("tionsh.example.net", "remove", "2024-03-15"),
    ("blog.tionsh.example.net", "add", "2024-06-01"), ("example.org/es", "add", "2024-09-01"), ("m.thther.example.org/en", "add", "2024-04-01"), ("m.thther.example.org/en", "remove", "2024-10-01"),
)
#: Captures of pages are dated from this day on, cyclically, in so many days.
FIRST_DAY, DAYS = "2024-01-01", 366


def intervals(events: DataFrame) -> DataFrame:
    """events: list, entry, event (add or remove), day. list, entry, since, until (exclusive; null: still active)."""
    rows = events.where("day is not null and entry is not null and event in ('add', 'remove')").select("list", F.lower("entry").alias("entry"), "event", F.col("day").cast("date").alias("day")).distinct()
    order = Window.partitionBy("list", "entry").orderBy("day", "event")  # add comes before remove
    changes = rows.withColumn("before", F.lag("event").over(order)).where(~F.col("event").eqNullSafe(F.col("before")))
    return changes.withColumn("until", F.lead("day").over(order)).where("event = 'add' and (until is null or until > day)").select("list", "entry", F.col("day").alias("since"), "until")


def keys(url: Column, shapes: list[tuple[int, int]]) -> Column:
    """What entries may match a URL: for each shape (labels of a host, parts of a path) that entries have, the host's last labels and
    the path's first parts. So a URL has as many keys as there are shapes, however long it is."""
    text = F.lower(url.cast("string"))
    host, path = F.rtrim(F.regexp_extract(text, URL, 1), F.lit(".")), F.regexp_extract(text, URL, 2)
    labels, parts = F.split(host, "\\."), F.filter(F.split(path, "/"), lambda x: x != "")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    first = lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")) if n else F.lit("")
    each = [F.when((F.size(labels) >= a) & (F.size(parts) >= b), F.concat(last(a), first(b))) for a, b in shapes]
    return F.when(host != "", F.array_compact(F.array(*each) if each else F.array().cast("array<string>")))


def shapes_of(valid: DataFrame) -> list[tuple[int, int]]:
    """Labels of hosts and parts of paths of a list's entries, MOST_SHAPES of them at most."""
    host, path = F.substring_index("entry", "/", 1), F.regexp_count("entry", F.lit("/"))
    found = valid.select(F.size(F.split(host, "\\.")).alias("a"), path.alias("b")).distinct().limit(MOST_SHAPES + 1).collect()
    if len(found) > MOST_SHAPES:
        raise ValueError(f"entries have more than {MOST_SHAPES} shapes")
    return sorted((r["a"], r["b"]) for r in found)


def verdicts(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """url, day, n_entries, first_list, first_entry of the distinct pairs that are blocked."""
    valid = saved(intervals(events), "url-intervals")
    small = valid.count() * INTERVAL_BYTES + (valid.select(F.sum(F.octet_length("list") + F.octet_length("entry"))).first()[0] or 0) <= BROADCAST
    pairs = captures.select(F.col(url_col).alias("url"), F.to_date(time_col).alias("day")).where("url is not null and day is not null").distinct()
    each = pairs.select("url", "day", F.explode(keys(F.col("url"), shapes_of(valid))).alias("entry"))
    hits = each.join(F.broadcast(valid) if small else valid, "entry").where("day >= since and (until is null or day < until)")
    first = F.min(F.struct("list", "entry"))
    return hits.groupBy("url", "day").agg(F.count("*").alias("n_entries"), first.getField("list").alias("first_list"), first.getField("entry").alias("first_entry"))


def judged(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """captures with blocked, n_entries, first_list and first_entry."""
    names, plain = captures.columns, captures.toDF(*(f"c{i}" for i in range(len(captures.columns))))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    found = verdicts(plain, events, at[url_col], at[time_col])
    rows = plain.withColumn("url", F.col(at[url_col])).withColumn("day", F.to_date(at[time_col])).join(found, ["url", "day"], "left")
    new = [F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), "first_list", "first_entry"]
    return rows.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)), *new)


def filter_urls(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """The captures that no entry blocks."""
    found = judged(captures.toDF(*(f"d{i}" for i in range(len(captures.columns)))), events, f"d{captures.columns.index(url_col)}", f"d{captures.columns.index(time_col)}")
    return found.where("not blocked").drop("blocked", "n_entries", "first_list", "first_entry").toDF(*captures.columns)


def example_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("block", *x) for x in EVENTS], "list string, entry string, event string, day string")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 7, F.lit(DAYS)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    return judged(captures, example_events(spark)).select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "blocked", "n_entries", "first_entry")


_EVENTS = ", ".join(f"('{e}', '{k}', date '{d}')" for e, k, d in EVENTS)
ORACLE = rf"""
with ev(entry, event, day) as (values {_EVENTS}),
ch as (select *, lag(event) over (partition by entry order by day, event) as before from ev),
iv as (
  select entry, day as since, until, event from (
    select *, lead(day) over (partition by entry order by day, event) as until from ch where event is distinct from before)
  where event = 'add' and (until is null or until > day)),
p as (
  select page_id, url, date '{FIRST_DAY}' + cast((page_id * 7) % {DAYS} as integer) as fetched,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) as host,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)', 1) as path
  from pages),
h as (
  select p.page_id, iv.entry from p, iv
  where fetched >= since and (until is null or fetched < until)
    and (host = split_part(entry, '/', 1) or host like '%.' || split_part(entry, '/', 1))
    and (not contains(entry, '/') or path = substr(entry, strpos(entry, '/')) or path like substr(entry, strpos(entry, '/')) || '/%')),
a as (select page_id, count(*) as n, min(entry) as first_entry from h group by page_id)
select p.page_id, url, strftime(fetched, '%Y-%m-%d') as fetched, n is not null as blocked, coalesce(n, 0) as n_entries, first_entry
from p left join a using (page_id)
"""
