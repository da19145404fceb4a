"""Documents kept as an append-only change log, read as latest state per key.

Every operator here is a partial aggregation (one row per key leaves each map task), so a key that
owns a third of the log costs no more than any other.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F


def _order(order: list[str]) -> Column:
    return F.struct(*order)


def upsert_replace(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last document per key wins as a whole."""
    rest = [c for c in log.columns if c not in key]
    latest = log.groupBy(*key).agg(F.max_by(F.struct(*rest), _order(order)).alias("__d"))
    return latest.select(*key, "__d.*").select(*log.columns)


def upsert_merge(log: DataFrame, key: list[str], order: list[str], fields: dict[str, Column]) -> DataFrame:
    """Per-field last write wins. ``fields`` maps each field to its "was written" condition, so an explicit
    null overwrites and an absent field does not."""
    return log.groupBy(*key).agg(
        *[F.max_by(F.col(f), F.when(written, _order(order))).alias(f) for f, written in fields.items()]
    )


def update_existing(
    existing: DataFrame, updates: DataFrame, key: list[str], order: list[str], fields: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """(merged rows, rejects): an update of a key that has no document is refused."""
    keys = existing.select(*key)
    missed = updates.join(keys, key, "left_anti").withColumn("reject_reason", F.lit("not_found"))
    patch = updates.groupBy(*key).agg(
        *[F.max_by(F.col(f), F.when(written, _order(order))).alias(f"__v_{f}") for f, written in fields.items()],
        *[F.max(written).alias(f"__w_{f}") for f, written in fields.items()],
    )
    out = existing.join(patch, key, "left").withColumns(
        {f: F.when(F.col(f"__w_{f}"), F.col(f"__v_{f}")).otherwise(F.col(f)) for f in fields}
    )
    return out.select(*existing.columns), missed


def latest_first(df: DataFrame, ts: str, tie: str, limit: int | None = None) -> DataFrame:
    """Newest first; rows without a time are dropped."""
    out = df.filter(F.col(ts).isNotNull()).orderBy(F.desc(ts), F.asc(tie))
    return out if limit is None else out.limit(limit)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows of every group; each map task forwards at most ``limit`` rows per group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def reconcile(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Keys present on one side only."""
    a = left.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("__a", F.lit(True))
    b = right.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("__b", F.lit(True))
    missing = F.when(F.col("__b").isNull(), names[1]).when(F.col("__a").isNull(), names[0])
    return a.join(b, key, "full_outer").select(key, missing.alias("missing_in")).filter("missing_in is not null")


def change_feed(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """New and changed documents between two snapshots; removed ones are not reported."""
    fields = [c for c in current.columns if c != key]
    prev = previous.select(key, F.lit(True).alias("__seen"), F.struct(*fields).alias("__prev"))
    cur = current.select(key, F.struct(*fields).alias("__cur"))
    joined = cur.join(prev, key, "left")
    event = F.when(F.col("__seen").isNull(), "new_triage").when(~F.col("__cur").eqNullSafe(F.col("__prev")), "updated")
    return joined.select(event.alias("event"), key, "__cur.*").filter("event is not null")


def reconcile_stores(stores: dict[str, DataFrame], key: str, day: str, compared: list[str]) -> DataFrame:
    """Where stores disagree: key, day, missing_in (names in the order of ``stores``, comma-joined; empty if none) and
    ``differs`` (a compared column has several values over the stores that have the key).

    One union and one aggregation for any number of stores: a bit mask of presence, and the least and greatest checksum
    of the compared columns. A key that a store holds several times a day counts once there, unless its rows differ. Null
    keys are left out.
    """
    checksum = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in compared])
    rows = None
    for i, df in enumerate(stores.values()):
        part = df.filter(F.col(key).isNotNull()).select(key, F.to_date(day).alias("day"), F.lit(1 << i).alias("bit"), checksum.alias("sum"))
        rows = part if rows is None else rows.unionByName(part)
    seen = rows.groupBy(key, "day").agg(F.bit_or("bit").alias("mask"), (F.min("sum") != F.max("sum")).alias("differs"))
    names = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) == 0, name) for i, name in enumerate(stores)]
    missing = F.concat_ws(",", *names)
    return seen.filter((F.col("mask") != (1 << len(stores)) - 1) | F.col("differs")).select(key, "day", missing.alias("missing_in"), "differs")
