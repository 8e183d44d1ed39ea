"""URL filters as a temporal join: dated list entries against dated captures.

A list's entries come and go.  Their events become validity intervals, and
every capture is judged by the entries that were active when it was fetched,
whatever the list says today.  Intervals are cut into months, so that a
capture meets only those of its own month and pattern, however long a
pattern's history is and however many captures a host has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import cut_lineage

#: Kinds of pattern: a host, a domain with all hosts below it, or a host with the beginning of a path (at a "/").
KINDS = ("host", "domain", "prefix")
KEY = ["list", "verdict", "kind", "pattern"]


def _month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def validity_intervals(events: DataFrame) -> DataFrame:
    """list, verdict, kind, pattern, valid_from, valid_to (null: still valid)
    from events (list, verdict, kind, pattern, day, action).

    An "add" holds until the entry's next event of any kind; on one day a
    "remove" outdoes an "add", and any other action is ignored, as are events
    with a null in a column.  Repeated events count once.  An entry's history
    is ordered month by month, so that a long one is not one task's window.
    """
    events = events.filter(F.col("action").isin("add", "remove")).dropna(subset=[*KEY, "day"])
    events = events.groupBy(*KEY, "day").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on")).withColumn("month", _month(F.col("day")))
    events = cut_lineage(events)
    months = events.groupBy(*KEY, "month").agg(F.min("day").alias("first"))
    months = months.withColumn("later", F.lead("first").over(Window.partitionBy(*KEY).orderBy("month"))).drop("first")
    inside = F.lead("day").over(Window.partitionBy(*KEY, "month").orderBy("day"))
    both = events.withColumn("soon", inside).join(months, [*KEY, "month"])
    return both.filter("on = 1").select(*KEY, F.col("day").alias("valid_from"), F.coalesce("soon", "later").alias("valid_to"))


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user, port and closing dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*+://(?:[^/?#@]*+@)?([^/?#:@]++)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    """The path of a URL, from its first slash and without query and fragment; empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*+://[^/?#]*+(/[^?#]*+)", 1)


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """One row per row of `captures` (page_id, url, fetched, a date): page_id,
    host, fetched, n_active, ruling, listed_from, blocked.

    n_active counts the list entries that match the URL and were active on
    `fetched`.  The ruling is the longest pattern among them (of equally long
    ones the last by kind, verdict and list), listed_from when it was listed,
    and blocked whether its verdict is "block".  Without an active entry, also
    where url or fetched is null or the URL has no host, there is no ruling
    and the capture is not blocked.  Repeated rows are judged each; other
    columns are ignored.
    """
    captures = captures.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "fetched")
    intervals = validity_intervals(events)
    # longer candidates than the longest pattern cannot match; months after the last capture are not needed
    labels = F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))
    depth = F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)
    most = events.agg(F.coalesce(F.max(labels), F.lit(0)), F.coalesce(F.max(depth), F.lit(0))).first()
    last = captures.agg(F.max(_month(F.col("fetched")))).first()[0] or 0

    host, path = host_of(F.coalesce("url", F.lit(""))), path_of(F.coalesce("url", F.lit("")))
    named = captures.withColumn("host", host).withColumn("path", path)
    parts = F.split("host", r"\.")
    n, begin = F.size(parts), F.greatest(F.lit(1), F.size(parts) - most[0] + 1)
    domains = F.when((F.col("host") != "") & F.lit(most[0] > 0), F.transform(
        F.sequence(begin, n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, n - i + 1), ".").alias("pattern"))))
    steps = F.split("path", "/")
    deep = F.least(F.lit(most[1]), F.size(steps) - 1)
    prefixes = F.when((F.col("host") != "") & (F.col("path") != "") & (deep > 0), F.transform(
        F.sequence(F.lit(1), deep), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.array_join(F.slice(steps, F.lit(1), i + 1), "/")).alias("pattern"))))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    every = F.concat(F.array(F.struct(F.lit("host").alias("kind"), F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit("/"), F.col("row"))).alias("pattern"))),
                     F.coalesce(domains, none), F.coalesce(prefixes, none))
    asked = named.select("row", "page_id", "host", "fetched", F.explode(every).alias("c")).select("row", "page_id", "host", "fetched", "c.kind", "c.pattern", _month(F.col("fetched")).alias("month"))
    # a missing date gets a month of its own per row, so that such rows do not meet
    asked = asked.withColumn("month", F.coalesce("month", (-1 - F.pmod("row", F.lit(1 << 20))).cast("int")))

    until = F.least(F.coalesce(_month(F.col("valid_to")), F.lit(last)), F.lit(last))
    cut = intervals.withColumn("from_month", _month(F.col("valid_from"))).withColumn("to_month", until).filter("from_month <= to_month")
    cut = cut_lineage(cut.withColumn("month", F.explode(F.sequence("from_month", "to_month"))).drop("from_month", "to_month"))
    met = asked.join(cut, ["kind", "pattern", "month"], "left")
    active = (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    rule = F.when(active, F.struct(F.length("pattern").alias("n"), F.col("kind"), F.col("verdict"), F.col("list"), F.col("pattern"), F.col("valid_from")))
    done = met.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("fetched").alias("fetched"),
                                  F.count(rule).alias("n_active"), F.max(rule).alias("rule"))
    return done.select("page_id", "host", "fetched", "n_active", F.col("rule.pattern").alias("ruling"), F.col("rule.valid_from").alias("listed_from"),
                       F.coalesce(F.col("rule.verdict") == "block", F.lit(False)).alias("blocked"))
