"""Reconciliation: last-writer-wins maps, replicated lists, conflict policies, pull and push of two replicas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def merge_lww(left: Column, right: Column) -> Column:
    """Merge of two maps name -> struct(v, ts): per field the later ts, a tie goes left."""
    names = F.array_union(F.map_keys(left), F.map_keys(right))

    def pick(k):
        a, b = F.try_element_at(left, k), F.try_element_at(right, k)
        return F.struct(k.alias("key"), F.when(a.isNull() | (b["ts"] > a["ts"]), F.coalesce(b, a)).otherwise(a).alias("value"))

    return F.map_from_entries(F.transform(names, pick))


def lww_build(record: Column, existing: Column, ts: Column) -> Column:
    """A map of registers after a write: the fields of the record (map name -> v) at ts, the others as they were."""
    fresh = F.transform_values(record, lambda _, v: F.struct(v.alias("v"), ts.alias("ts")))
    kept = F.map_filter(existing, lambda k, _: ~F.map_contains_key(record, k))
    return F.when(existing.isNull(), fresh).otherwise(F.map_concat(fresh, kept))


def lww_registers(writes: DataFrame, keys: list[str], value: str, ts: str, side: str) -> DataFrame:
    """The winning write of each register (keys): the latest ts, a tie to the smallest side; pre-aggregated by max_by."""
    rank = F.struct(F.col(ts), (-F.col(side)).alias("s"))
    return writes.groupBy(*keys).agg(F.max_by(value, rank).alias(value), F.max_by(ts, rank).alias(ts), F.max_by(side, rank).alias(side))


def lww_snapshot(state: Column) -> Column:
    """The plain map of a map of registers."""
    return F.transform_values(state, lambda _, r: r["v"])


def merge_rga(left_items: Column, left_gone: Column, right_items: Column, right_gone: Column) -> tuple[Column, Column]:
    """Items (array of struct nid, v) of the left, then what only the right has; tombstones are united."""
    known = F.transform(left_items, lambda x: x["nid"])
    fresh = F.filter(right_items, lambda x: ~F.array_contains(known, x["nid"]))
    return F.concat(left_items, fresh), F.array_union(left_gone, right_gone)


def rga_build(values: Column, items: Column, gone: Column, prefix: Column) -> tuple[Column, Column]:
    """Items and tombstones after a list was written whole: values that were there keep their nid, new ones get prefix-place.

    Of equal values the first keeps the old nid. Items that are not in the list any more are kept behind it, as tombstones.
    """
    first_of = lambda v: F.get(F.filter(items, lambda x: x["v"].eqNullSafe(v)), F.lit(0))

    def place(v, i):
        again = F.exists(F.slice(values, 1, i), lambda w: w.eqNullSafe(v))
        old = F.when(~again, first_of(v)["nid"])
        return F.struct(F.coalesce(old, F.concat(prefix, F.lit("-"), i.cast("string"))).alias("nid"), v.alias("v"))

    new = F.transform(values, place)
    used = F.transform(new, lambda x: x["nid"])
    left = F.filter(items, lambda x: ~F.array_contains(used, x["nid"]))
    return F.concat(new, left), F.array_union(gone, F.transform(left, lambda x: x["nid"]))


def rga_values(items: Column, gone: Column) -> Column:
    return F.transform(F.filter(items, lambda x: ~F.array_contains(gone, x["nid"])), lambda x: x["v"])


def resolve(policy: str, local: str = "local", remote: str = "remote") -> Column:
    """True where the local side of a conflict wins; sides are structs with _v and _ts. Manual gives null: undecided."""
    lv, rv, lt, rt = F.col(f"{local}._v"), F.col(f"{remote}._v"), F.col(f"{local}._ts"), F.col(f"{remote}._ts")
    rules = {"local-wins": F.lit(True), "remote-wins": F.lit(False), "version": lv >= rv, "last-writer-wins": lt >= rt, "first-writer-wins": lv <= rv, "manual": F.lit(None).cast("boolean")}
    return rules[policy]


def pull(local: DataFrame, remote: DataFrame, policy: str = "version", id_col: str = "id", since=None) -> DataFrame:
    """What a pull does to each id: insert, overwrite, ignore, keep, or conflict-local / -remote / -open; winning _v and _ts.

    local has a boolean column dirty (written since the last sync). Remote deletions are not seen. since is exclusive.
    """
    if since is not None:
        remote = remote.where(F.col("_ts") > F.lit(since))
    side = lambda df, name: df.select(F.col(id_col).alias(f"_{name}_id"), F.struct(*[c for c in df.columns if c != id_col]).alias(name))
    both = side(local, "local").join(side(remote, "remote"), F.col("_local_id") == F.col("_remote_id"), "full_outer")
    wins = resolve(policy)
    newer = F.col("remote._v") > F.col("local._v")
    action = (
        F.when(F.col("_remote_id").isNull(), "keep").when(F.col("_local_id").isNull(), "insert").when(~newer, "ignore").when(~F.col("local.dirty"), "overwrite")
        .when(wins, "conflict-local").when(~wins, "conflict-remote").otherwise("conflict-open")
    )
    taken = F.col("action").isin("insert", "overwrite", "conflict-remote")
    out = both.withColumn("action", action)
    return out.select(F.coalesce("_local_id", "_remote_id").alias(id_col), "action", F.when(taken, F.col("remote._v")).otherwise(F.col("local._v")).alias("_v"), F.when(taken, F.col("remote._ts")).otherwise(F.col("local._ts")).alias("_ts"))


def push(local: DataFrame, remote: DataFrame, id_col: str = "id") -> DataFrame:
    """Dirty local rows and what their write meets: created, written (the remote has the version before), or conflict.

    A write of version v expects version v - 1 on the other side; any other version there is a conflict.
    """
    there = remote.select(F.col(id_col).alias("_id"), F.col("_v").alias("_there"))
    joined = local.where("dirty").join(there, F.col(id_col) == F.col("_id"), "left")
    outcome = F.when(F.col("_there").isNull(), "created").when(F.col("_there") == F.col("_v") - 1, "written").otherwise("conflict")
    return joined.select(id_col, "_v", outcome.alias("outcome"))


def sync(local: DataFrame, remote: DataFrame, policy: str = "version", id_col: str = "id", only: Column | None = None, merged: Column | None = None) -> DataFrame:
    """Both replicas after a push and a pull: id, outcome, and the row (struct) that either side then holds.

    local has dirty; only limits what is pushed (a filtered push). In a conflict the policy names the winner; merged, a
    Column over the structs local and remote, is the row that both get instead. An undecided conflict stays open.
    """
    payload = [c for c in local.columns if c not in (id_col, "dirty")]
    mine = local.select(F.col(id_col).alias("_local_id"), F.struct(*payload).alias("local"), F.col("dirty") & (F.lit(True) if only is None else F.coalesce(only, F.lit(False))))
    mine = mine.toDF("_local_id", "local", "dirty")
    theirs = remote.select(F.col(id_col).alias("_remote_id"), F.struct(*payload).alias("remote"))
    both = mine.join(theirs, F.col("_local_id") == F.col("_remote_id"), "full_outer")
    lv, rv, dirty = F.col("local._v"), F.col("remote._v"), F.coalesce("dirty", F.lit(False))
    wins = resolve(policy)
    clash = F.lit("merged") if merged is not None else F.when(wins, "conflict-local").when(~wins, "conflict-remote").otherwise("conflict-open")
    outcome = (
        F.when(F.col("_local_id").isNull(), "pulled").when(F.col("_remote_id").isNull() & dirty, "created").when(F.col("_remote_id").isNull(), "kept")
        .when(dirty & (rv == lv - 1), "pushed").when(dirty, clash).when(rv > lv, "pulled").otherwise("kept")
    )
    out = both.withColumn("outcome", outcome)
    row = F.when(F.col("outcome").isin("pulled", "conflict-remote"), F.col("remote"))
    if merged is not None:
        row = row.when(F.col("outcome") == "merged", merged)
    return out.select(F.coalesce("_local_id", "_remote_id").alias(id_col), "outcome", row.otherwise(F.coalesce("local", "remote")).alias("row"))


def across(vaults: dict[str, DataFrame], run, eager: bool = False) -> DataFrame:
    """run(df) over each vault, as one DataFrame with the vault's name, in the order given; failures become rows of error.

    Failures of building a plan are always kept apart. eager also computes each vault's result on its own, into the shared
    folder, so that a vault that fails while it runs leaves the others whole.
    """
    parts, errors = [], []
    for name, df in vaults.items():
        try:
            part = run(df).withColumn("vault", F.lit(name))
            parts.append(checkpointed(part) if eager else part)
        except Exception as e:
            errors.append((name, f"{type(e).__name__}: {e}"[:2000]))
    if not parts:
        raise ValueError(f"no vault gave a result: {errors}")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name, text in errors:
        out = out.unionByName(out.sparkSession.createDataFrame([(name, text)], "vault string, error string"), allowMissingColumns=True)
    return out


def across_by(df: DataFrame, vault: str, spec: dict) -> DataFrame:
    """Reducers over each vault of one table with a vault column: one grouped scan instead of one a vault."""
    return df.groupBy(F.col(vault).alias("vault")).agg(*[r.column(df).alias(name) for name, r in spec.items()])
