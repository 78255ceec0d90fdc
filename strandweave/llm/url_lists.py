"""URL filtering against dated lists, by an as-of join of captures to validity intervals.

A list is a log of dated entries for a pattern: ``block``, ``allow`` or ``remove``.  An entry holds from its
date until the pattern's next entry.  A pattern is a domain, which covers its subdomains, or a host with the
first path segments, which covers all below.  A capture takes its verdict from the most specific pattern
that holds an entry at its fetch time; ``remove`` leaves it to the next wider pattern.

Everything is built-in DataFrame functions.  The intervals are broadcast only while they are few; otherwise
the join is a shuffle join on the pattern, which Spark splits where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Intervals that are broadcast at most (some hundred bytes each).
BROADCAST_ROWS = 50_000

# fixed values: the list that the registered query applies to `pages`
ENTRIES = [
    ("2021-01-01", "cheap-pills.example.com", "block", "pharma"),
    ("2021-03-01", "spam-farm.example.org", "block", "spam"),
    ("2021-09-01", "example.net", "block", "outage"),
    ("2021-10-01", "example.net", "remove", "outage"),
    ("2022-02-15", "tionsh.example.net", "block", "mirror"),
    ("2022-06-01", "spam-farm.example.org", "remove", "spam"),
    ("2022-07-01", "tionsh.example.net/es", "allow", "appeal"),
    ("2022-11-20", "www.cheap-pills.example.com", "allow", "appeal"),
    ("2023-01-15", "spam-farm.example.org", "block", "spam"),
    ("2023-02-01", "tionsh.example.net", "remove", "mirror"),
    ("2023-05-05", "blog.tionble.example.com/en", "block", "scraper"),
    ("2023-06-30", "www.cheap-pills.example.com", "remove", "appeal"),
    ("2024-01-10", "example.org", "block", "takeover"),
    ("2024-01-20", "example.org", "remove", "takeover"),
    ("2024-02-01", "m.thther.example.org", "block", "spam"),
]


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, category, valid_from, valid_to) from entries (dated, pattern, action, category).

    Of a pattern's entries on one date the last by action, then category, counts.  Rows without a date or
    pattern are ignored; patterns are compared in lower case.
    """
    kept = entries.where("dated is not null and pattern is not null").select(F.col("dated").cast("date").alias("valid_from"), F.lower("pattern").alias("pattern"), "action", "category")
    kept = kept.groupBy("pattern", "valid_from").agg(F.max(F.struct("action", "category")).alias("e"))
    after = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from"))
    return kept.select("pattern", "e.action", "e.category", "valid_from", after.alias("valid_to"))


def host(url: Column) -> Column:
    """The URL's host in lower case; empty where there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)


def depth(held: DataFrame) -> int:
    """The path segments of the deepest pattern."""
    return held.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0


def patterns(url: Column, name: Column, segments: int) -> Column:
    """All patterns of at most ``segments`` path segments that could cover a URL: its host, the wider domains,
    and host with path segments."""
    labels = F.split(name, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    paths = F.transform(F.slice(F.sequence(F.lit(1), F.lit(max(segments, 1))), 1, F.least(F.size(parts), F.lit(segments))), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.array_distinct(F.concat(domains, paths))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per capture: (``id_col``, ``url_col``, host, ``time_col``, blocked int, pattern, category, valid_from).

    ``pattern``, ``category`` and ``valid_from`` name the entry that decided, or are null, which leaves the
    capture unblocked.  Null and malformed URLs have an empty host and match nothing; a null fetch time
    matches nothing.  Repeated rows come out as often as they went in.  Entry dates are inclusive from,
    exclusive to.  Other columns are not read; an empty list blocks nothing.
    """
    held = intervals(entries).where("action <> 'remove'")
    few = held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"), host(F.coalesce(F.col(url_col), F.lit(""))).alias("host"))
    keys = rows.select("*", F.posexplode(patterns(F.coalesce("url", F.lit("")), F.col("host"), depth(held))).alias("n", "pattern"))
    met = keys.join(F.broadcast(held) if few else held, "pattern", "left")
    active = F.col("valid_from").isNotNull() & (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    verdict = F.max(F.when(active, F.struct(F.length("pattern").alias("size"), "pattern", "action", "category", "valid_from"))).alias("v")
    # a pattern of several intervals meets a key several times: a row counts by its first key's first interval
    first = F.when((F.col("n") == 0) & (F.col("valid_from").isNull() | (F.col("valid_from") == F.col("earliest"))), 1)
    starts = held.groupBy("pattern").agg(F.min("valid_from").alias("earliest"))
    met = met.join(F.broadcast(starts) if few else starts, "pattern", "left")
    one = met.groupBy("id", "url", "host", "at").agg(verdict, F.count(first).cast("int").alias("times"))
    out = one.select("*", F.explode(F.sequence(F.lit(1), "times")).alias("i"))
    blocked = F.coalesce((F.col("v.action") == "block").cast("int"), F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", F.col("at").alias(time_col), blocked.alias("blocked"), "v.pattern", "v.category", "v.valid_from")
