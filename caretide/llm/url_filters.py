"""URL filters with dated lists: what counts is the list as it was when a page was fetched.

A list is a log of dated entries that add or remove a pattern (a host or a domain). The log becomes validity intervals;
an as-of join holds every capture against the entries of its host and of each domain above it that were active at its
time. Captures are reduced to distinct (host, month, day) first and intervals are cut at month borders, so the join is
an equi-join on pattern and month even for a host with a third of all captures.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from caretide.llm.html_extract import host_of

#: Day that an entry which was never removed ends on (exclusive).
OPEN_END = "9999-12-31"


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, valid_from, valid_to (exclusive) from entries (pattern, category, day, action).

    Of several entries of a pattern and category on one day, a removal wins. An addition of what is active and a removal
    of what is not change nothing. Entries with a null pattern, day or action are ignored.
    """
    kept = entries.filter(F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    daily = kept.groupBy(F.lower("pattern").alias("pattern"), "category", "day").agg(F.max("action").alias("action"))  # add < remove
    log = Window.partitionBy("pattern", "category").orderBy("day")
    changes = daily.withColumn("before", F.lag("action").over(log)).filter(F.coalesce(F.col("before"), F.lit("remove")) != F.col("action"))
    ended = changes.withColumn("valid_to", F.coalesce(F.lead("day").over(log), F.lit(OPEN_END).cast("date")))
    return ended.filter(F.col("action") == "add").select("pattern", "category", F.col("day").alias("valid_from"), "valid_to")


def patterns_of(host: Column) -> Column:
    """The host and all domains above it down to its last label, the longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with blocked, n_entries (active entries that match), pattern and category of the deciding one (the
    longest pattern, then the first category).

    A null url, a url without host or a null time matches nothing and passes. Repeated captures are judged each. Empty
    tables: no rows, or nothing blocked. Columns of ``captures`` with the names of the results are replaced.
    """
    results = ("blocked", "n_entries", "pattern", "category")
    own = captures.select([c for c in captures.columns if c not in results])
    own = own.withColumns({"_host": host_of(F.col(url)), "_day": F.to_date(fetched)})
    asked = own.select("_host", "_day").filter("_host != '' and _day is not null").distinct()
    asked = asked.select("_host", "_day", F.explode(patterns_of(F.col("_host"))).alias("_pattern")).withColumn("_month", _month(F.col("_day")))

    span = intervals(entries)
    # an interval is looked up in the months that captures have
    months = F.sequence(_month(F.col("valid_from")), F.least(_month(F.col("valid_to")), F.col("_latest")))
    latest = asked.agg(F.max("_month")).first()[0]
    cut = span.withColumn("_latest", F.lit(latest).cast("int")).filter(_month(F.col("valid_from")) <= F.col("_latest"))
    cut = cut.withColumn("_month", F.explode(months)).drop("_latest")

    active = asked.join(cut, (asked["_pattern"] == cut["pattern"]) & (asked["_month"] == cut["_month"]))
    active = active.filter((F.col("_day") >= F.col("valid_from")) & (F.col("_day") < F.col("valid_to")))
    verdict = active.groupBy("_host", "_day").agg(
        F.count("*").alias("n_entries"), F.min(F.struct((-F.length("pattern")).alias("l"), "pattern", "category")).alias("_by")
    )
    joined = own.join(verdict, ["_host", "_day"], "left")
    return joined.select(
        *[c for c in own.columns if c not in ("_host", "_day")],
        F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.col("_by.pattern").alias("pattern"),
        F.col("_by.category").alias("category"),
    )
