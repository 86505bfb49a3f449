"""URL filters: dated list entries as validity intervals, joined to captures as of their fetch time.

List events (an entry is added or removed at a time) become intervals in which
the entry is active. Every capture offers its keys (its host, the domains above
it, and the leading parts of its path), and an equi-join on the key with a
range condition on the fetch time finds the entries active then. Built-in
functions only.

Defined cases
-------------
* A null or unreadable URL has no keys, a null fetch time meets no interval:
  both are kept and not blocked.
* Events with null in any of their columns, or with another action than
  ``add`` and ``remove``, are void. Equal events count once; at one time,
  ``remove`` comes before ``add``. Adding an active entry, or removing an
  inactive one, changes nothing.
* An interval holds its start and not its end; one without an end is open.
* Repeated captures keep one row each; other columns of captures pass through,
  and those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = ("host", "n_active", "lists", "blocked")
ALLOW = "allow"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and closing dot; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    bare = F.regexp_replace(found, r"\.+$", "")
    return F.when(bare != "", bare)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domains_above(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host.isNotNull(), tails)


def keys_of(url: Column) -> Column:
    """What entries may name: ``host:``, ``domain:`` and ``prefix:`` keys of a URL."""
    host = host_of(url)
    steps = F.filter(F.split(_path(url), "/"), lambda s: s != "")
    prefixes = F.transform(
        F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")),
    )
    domains = F.transform(domains_above(host), lambda d: F.concat(F.lit("domain:"), d))
    return F.when(host.isNotNull(), F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes))


def intervals(events: DataFrame) -> DataFrame:
    """``list``, ``key``, ``valid_from`` and ``valid_to`` from events ``list``, ``key``, ``action``, ``at``."""
    sound = events.select("list", "key", "action", "at").dropna().filter(F.col("action").isin("add", "remove")).distinct()
    # Of one time, the later state is what holds.
    states = sound.groupBy("list", "key", "at").agg(F.bool_or(F.col("action") == "add").alias("active"))
    order = Window.partitionBy("list", "key").orderBy("at")
    turns = states.withColumn("was", F.lag("active", 1, False).over(order)).filter(F.col("active") != F.col("was"))
    return turns.withColumn("valid_to", F.lead("at").over(order)).filter("active").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host``, ``n_active`` (entries that match as of the fetch), ``lists`` and ``blocked``.

    ``blocked``: some list matches, and the list ``allow`` does not.
    """
    captures = captures.select([c for c in captures.columns if c not in RESULT])
    marked = captures.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in captures.columns]))
    # Captures alike in URL and time share one verdict.
    asked = captures.select(F.col(url).alias("__url"), F.col(fetched).alias("__at")).dropna().distinct()
    keys = asked.select("__url", "__at", F.explode(keys_of(F.col("__url"))).alias("key"))
    active = keys.join(intervals(events), "key").filter((F.col("__at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to"))))
    verdicts = active.groupBy("__url", "__at").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("list")).alias("names"))
    joined = marked.join(verdicts, (F.col(f"__row.`{url}`") == F.col("__url")) & (F.col(f"__row.`{fetched}`") == F.col("__at")), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return joined.select(
        "__row.*",
        host_of(F.col(f"__row.`{url}`")).alias("host"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.array_join(names, ",").alias("lists"),
        ((F.size(names) > 0) & ~F.array_contains(names, ALLOW)).alias("blocked"),
    )
