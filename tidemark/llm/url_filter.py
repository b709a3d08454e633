"""URL filter by dated lists.

A list is a log: an entry (a host or a parent domain) is added on one date and
may be removed and added again on others. Each stretch between an addition and
the next removal is a validity interval. A capture is blocked if, at the time
it was fetched, an interval of its host or of one of the host's parent domains
was open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, carried, given

#: Hosts up to which the joined table is broadcast; beyond, it is shuffled.
SMALL = 50_000


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port or final dot; null if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def validity(log: DataFrame) -> DataFrame:
    """(entry, since, until) of a log (entry, action, at), action being 'add' or 'remove'.

    On one date a removal counts before an addition. Additions to an entry
    already listed and removals of one that isn't change nothing. Rows with
    a null column are void. An entry's own log is short: it is ordered as one
    window.
    """
    events = log.where("entry is not null and at is not null and action in ('add', 'remove')").select(F.lower("entry").alias("entry"), "action", "at").distinct()
    order = W.partitionBy("entry").orderBy("at", F.col("action").desc())
    turns = events.withColumn("was", F.lag("action").over(order)).where("was is null and action = 'add' or action <> was")
    spans = turns.withColumn("until", F.lead("at").over(order)).where("action = 'add'")
    return spans.select("entry", F.col("at").alias("since"), "until").where("until is null or until > since")


def filter_urls(captures: DataFrame, log: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The captures, all columns, with _host, _blocked, _entry and _since.

    _entry is the most specific entry active at fetch time (the longest), and
    _since the start of its interval. A capture without host or fetch time is
    not blocked. An interval holds its start, not its end. Repeated captures
    are judged alike; columns named as those added are replaced.
    """
    scratch = Scratch(captures.sparkSession, "url-filter")
    df = captures.select(carried(captures), host_of(F.col(f"`{url}`")).alias("_host"), F.col(f"`{fetched}`").alias("at"))
    # entries meet hosts once for each distinct host; a host's intervals become one array
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.where("_host is not null").select(F.col("_host").alias("host")).distinct().withColumn("entry", F.explode(parents))
    spans = hosts.join(validity(log), "entry")
    one = F.struct(F.length("entry").alias("n"), "entry", "since", "until")
    spans = scratch.save(spans.groupBy("host").agg(F.array_sort(F.collect_list(one)).alias("_spans")), "spans")
    if spans.limit(SMALL + 1).count() <= SMALL:
        spans = F.broadcast(spans)
    out = df.join(spans.withColumnRenamed("host", "_key"), F.col("_host") == F.col("_key"), "left").drop("_key")
    t = F.col("at")
    active = F.filter("_spans", lambda x: (x["since"] <= t) & (x["until"].isNull() | (t < x["until"])))
    out = out.withColumn("_hit", F.element_at(F.when(F.size(active) > 0, active), -1))
    own = given(captures, "_host", "_blocked", "_entry", "_since")
    return out.select(*own, "_host", F.col("_hit").isNotNull().alias("_blocked"), F.col("_hit.entry").alias("_entry"), F.col("_hit.since").alias("_since"))
