"""Periods: sealing, opening balances, write guards; age tiers, clearances, retention of attachments, presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import PeriodClosed
from .versions import entry_hash

PERIOD = "name string, endDate string, closedAt string, dateField string, priorHash string, hash string"


def close_period(periods: DataFrame, name: str, end_date: str, closed_at: str, date_field: str | None = None) -> DataFrame:
    """The table of periods with one more; names are unique and each period's hash covers the one before."""
    if periods.where(F.col("name") == name).limit(1).count():
        raise PeriodClosed(f"{name!r} is closed already")
    prior = periods.orderBy(F.desc("closedAt")).limit(1).select("hash").collect()  # one row
    row = periods.sparkSession.createDataFrame([(name, end_date, closed_at, date_field, prior[0][0] if prior else "")], "name string, endDate string, closedAt string, dateField string, priorHash string")
    return periods.unionByName(row.withColumn("hash", entry_hash(["name", "endDate", "closedAt", "dateField", "priorHash"])))


def chain_breaks(periods: DataFrame) -> DataFrame:
    """Periods whose link or own hash does not hold."""
    before = F.coalesce(F.lag("hash").over(Window.orderBy("closedAt")), F.lit(""))  # a row a period
    checked = periods.withColumn("_before", before)
    return checked.where((F.col("priorHash") != F.col("_before")) | (F.col("hash") != entry_hash(["name", "endDate", "closedAt", "dateField", "priorHash"]))).drop("_before")


def violations(writes: DataFrame, end: Column | str, existing: Column, incoming: Column | None = None) -> DataFrame:
    """Writes that touch a closed period: the existing or the incoming date is not after its end."""
    end = F.lit(end) if isinstance(end, str) else end
    hit = F.coalesce(existing <= end, F.lit(False))
    if incoming is not None:
        hit = hit | F.coalesce(incoming <= end, F.lit(False))
    return writes.where(hit)


def carry_forward(rows: DataFrame, key: str, value: str, date: str, end) -> DataFrame:
    """Opening balances: the sum of each key over rows not after the end."""
    return rows.where(F.col(date) <= F.lit(end)).groupBy(key).agg(F.sum(value).alias("opening"), F.count(F.lit(1)).alias("entries"))


def age_tier(ts: Column, cutoff) -> Column:
    return F.when(ts < F.lit(cutoff), "cold").otherwise("hot")


def visible(df: DataFrame, clearance: int, mode: str = "invisible", id_col: str = "id") -> DataFrame:
    """Rows up to a clearance; mode ghost keeps the others with id and _tier alone."""
    if mode == "invisible":
        return df.where(F.col("_tier") <= clearance)
    return df.select(*[c if c in (id_col, "_tier") else F.when(F.col("_tier") <= clearance, F.col(c)).alias(c) for c in df.columns])


def dedupe_blobs(df: DataFrame, content: str) -> DataFrame:
    """One row an object: hash, size, how many refer to it; partial counts come before the shuffle."""
    hashed = df.select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.octet_length(content).cast("long").alias("size"))
    return hashed.groupBy("hash").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("ref_count"))


def evictions(slots: DataFrame, age_days: Column, retain_days: int | None, predicate: Column | None = None, order: str | None = None, most: int | None = None) -> DataFrame:
    """Slots to evict with the reason: ttl (older than retain_days, strictly), predicate, or both."""
    old = F.coalesce(age_days > retain_days, F.lit(False)) if retain_days is not None else F.lit(False)
    named = F.coalesce(predicate, F.lit(False)) if predicate is not None else F.lit(False)
    out = slots.withColumn("reason", F.when(old & named, "both").when(old, "ttl").when(named, "predicate")).where("reason is not null")
    out = out.orderBy(order) if order else out
    return out if most is None else out.limit(most)


def presence(events: DataFrame, user: str, ts: str, now: Column, stale, self_id=None) -> DataFrame:
    """Users last seen within `stale` of now, without oneself."""
    seen = events.groupBy(user).agg(F.max(ts).alias("last_seen"))
    if self_id is not None:
        seen = seen.where(F.col(user) != F.lit(self_id))
    return seen.where(F.col("last_seen") >= now - stale)
