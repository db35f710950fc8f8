"""URL filters as a temporal list join.

A list is a table of dated events: from ``at`` on, an entry is on the list (``add``) or
off it (``remove``). Each entry's events become disjoint validity intervals [since,
until), and a capture is held against the entries that were active when it was fetched.

An entry is a key: a host (``host``), a domain with all its subdomains (``domain``) or a
URL prefix of host and path segments (``prefix``). A capture has at most one key of the
first kind, one of the second for each label of its host, and one of the third for each
path segment (the whole path counts, however deep), so the join is an equi-join on (kind,
key) and the as-of condition is checked on its matches. Of several active entries the
most specific decides: a prefix before a host before a domain, then the longer key.

The list is broadcast if it has at most ``SMALL_LIST`` entries, which are counted;
otherwise both sides are dealt out by key, and Spark splits a host that is too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_LIST = 100_000
KINDS = ("domain", "host", "prefix")


def intervals(events: DataFrame) -> DataFrame:
    """(kind, key, category, since, until) from events (kind, key, category, action, at).

    Keys are compared in lower case, without a final dot. Of several events of an entry
    at one time the last action by name decides (``remove`` over ``add``). An ``add`` to
    an entry that is on the list goes on with the new category; until is null while it is
    still there. Events with a null kind, key, action or time, or another kind or action,
    are void.
    """
    clean = events.select("kind", F.regexp_replace(F.lower(F.trim("key")), r"\.$", "").alias("key"), "category", "action", "at")
    clean = clean.filter(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & F.col("at").isNotNull() & F.col("key").isNotNull() & (F.col("key") != ""))
    last = clean.groupBy("kind", "key", "at").agg(F.max_by(F.struct("category", "action"), F.struct("action", "category")).alias("e")).select("kind", "key", "at", "e.*")
    order = Window.partitionBy("kind", "key").orderBy("at")
    return last.select("kind", "key", "category", F.col("at").alias("since"), F.lead("at").over(order).alias("until"), "action").filter("action = 'add'").drop("action")


def host_of(url: Column) -> Column:
    """Lower case, without user, port, final dot; empty where there is none."""
    authority = F.regexp_extract(url, r"^\s*(?i:[a-z][a-z0-9+.-]*:)?//([^/?#\s]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:\d*)?$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*(?i:[a-z][a-z0-9+.-]*:)?//[^/?#\s]*(/[^?#\s]*)?", 1)


def _keys(host: Column, path: Column) -> Column:
    labels = F.split(host, r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("key")))
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.when(
        F.size(steps) > 0,
        F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(F.lit("prefix").alias("kind"), F.lower(F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("key"))),
    ).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    return F.when(host != "", F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"))), below, prefixes)).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))


def evaluate(captures: DataFrame, events: DataFrame, small_list: int = SMALL_LIST) -> DataFrame:
    """Rows of captures (page_id, url, fetched_at) with host, blocked, and kind, key, category, since of the entry that decides.

    A capture whose url or fetch time is null, or whose url has no host, meets no entry
    and is not blocked; the entry's columns are null then. Rows that repeat a page_id are
    each returned. Other columns are not read; an empty list blocks nothing.
    """
    listed = intervals(events)
    if listed.limit(small_list + 1).count() <= small_list:
        listed = F.broadcast(listed)
    host, path = F.coalesce(host_of(F.col("url")), F.lit("")), F.coalesce(path_of(F.col("url")), F.lit(""))
    rows = captures.select("page_id", "url", "fetched_at", host.alias("host"), path.alias("path"))
    keyed = rows.select("page_id", "url", "fetched_at", "host", F.posexplode_outer(_keys(F.col("host"), F.col("path"))).alias("nth", "k"))
    c = keyed.select("page_id", "url", "fetched_at", "host", "nth", F.col("k.kind").alias("kind"), F.col("k.key").alias("key")).alias("c")
    active = (F.col("c.kind") == F.col("l.kind")) & (F.col("c.key") == F.col("l.key")) & (F.col("c.fetched_at") >= F.col("l.since")) & (F.col("l.until").isNull() | (F.col("c.fetched_at") < F.col("l.until")))
    met = c.join(listed.alias("l"), active, "left")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("l.kind"))
    entry = F.when(F.col("l.key").isNotNull(), F.struct(rank.alias("rank"), F.char_length("l.key").alias("size"), F.col("l.kind").alias("kind"), F.col("l.key").alias("key"), F.col("l.category").alias("category"), F.col("l.since").alias("since")))
    # a capture has one key of place 0, or none: equal captures are one group, sent back as often as they were there
    best = met.groupBy("page_id", "url", "fetched_at", "host").agg(F.max(entry).alias("e"), F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("copies"))
    found = best.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("page_id", "url", "fetched_at", "host", F.col("e.key").isNotNull().alias("blocked"), "e.kind", "e.key", "e.category", "e.since")
