"""Versioned collections over a change log: current state, as-of reads, history, pruning, and the ledger.

A change log has a row a write: id, version, ts, op ('put' or 'delete') and payload columns. Keys with many versions are
pre-aggregated (max_by) before the shuffle where the result is one row an id; prior versions are what a join with
the newest version of each id leaves. Only numbering by place (with_versions, prune by count, the ledger) needs the
writes of one id or chain in order.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import DanglingReference, VersionConflict
from .predicates import fresh


@dataclass(frozen=True)
class Log:
    """Names of a change log's columns; order decides between writes (default: version)."""

    df: DataFrame
    id: str = "id"
    version: str = "_v"
    ts: str = "_ts"
    op: str = "op"
    order: str | None = None

    @property
    def by(self) -> str:
        return self.order or self.version


def latest(log: Log, until=None, inclusive: bool = True) -> DataFrame:
    """The last write of each id, tombstones included; partial aggregates keep one row an id and task."""
    df = log.df
    if until is not None:
        df = df.where(F.col(log.ts) <= F.lit(until) if inclusive else F.col(log.ts) < F.lit(until))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(log.id).alias("_id")).agg(F.max_by(row, log.by).alias("_row")).select("_row.*")


def current(log: Log) -> DataFrame:
    """Live rows."""
    return latest(log).where(F.col(log.op) != "delete")


def as_of(log: Log, ts) -> DataFrame:
    """Rows alive at ts: the last write not after ts, unless it deletes."""
    return latest(log, ts).where(F.col(log.op) != "delete")


def alive_ids(log: Log, ts) -> DataFrame:
    return as_of(log, ts).select(log.id).orderBy(log.id)


def _newest(log: Log) -> DataFrame:
    return log.df.groupBy(F.col(log.id).alias("_id")).agg(F.max(log.by).alias("_newest"))


def prior(log: Log) -> DataFrame:
    """All writes but the last of each id: a join with one narrow row an id, whose hot ids AQE may split."""
    same = log.df[log.id].eqNullSafe(F.col("_id"))
    return log.df.join(_newest(log), same).where(F.col(log.by) < F.col("_newest")).select(*log.df.columns)


def history(log: Log, id_value=None, since=None, until=None, limit: int | None = None) -> DataFrame:
    """Prior versions (the last write of each id left out); since and until are inclusive. Of one id newest first."""
    if id_value is not None:
        log = Log(log.df.where(F.col(log.id) == F.lit(id_value)), log.id, log.version, log.ts, log.op, log.order)
    df = prior(log)
    if since is not None:
        df = df.where(F.col(log.ts) >= F.lit(since))
    if until is not None:
        df = df.where(F.col(log.ts) <= F.lit(until))
    if id_value is not None or limit is not None:
        df = df.orderBy(F.col(log.by).desc())
    return df if limit is None else df.limit(limit)


def clear_history(log: Log, id_value=None) -> DataFrame:
    """The log without prior versions, of one id or of all."""
    if id_value is None:
        return latest(log)
    mine = F.col(log.id).eqNullSafe(F.lit(id_value))
    kept = latest(Log(log.df.where(mine), log.id, log.version, log.ts, log.op, log.order))
    return log.df.where(~mine).unionByName(kept)


def fields_changed(log: Log, columns: list[str]) -> DataFrame:
    """For each write that follows another: id, version, and <column>_changed against the version before."""
    before = log.df.select(F.col(log.id).alias("_id"), (F.col(log.version) + 1).alias("_next"), *[F.col(c).alias(f"_old_{c}") for c in columns])
    joined = log.df.join(before, (F.col(log.id) == F.col("_id")) & (F.col(log.version) == F.col("_next")))
    return joined.select(log.id, log.version, *[(~F.col(c).eqNullSafe(F.col(f"_old_{c}"))).alias(f"{c}_changed") for c in columns])


def get_version(log: Log, id_value, version) -> DataFrame:
    return log.df.where((F.col(log.id) == F.lit(id_value)) & (F.col(log.version) == F.lit(version)))


def revert(log: Log, id_value, version, ts) -> DataFrame:
    """The log with an old version put again as the newest."""
    old = get_version(log, id_value, version)
    top = log.df.where(F.col(log.id) == F.lit(id_value)).agg((F.max(log.version) + 1).alias("_next"), (F.max(log.by) + 1).alias("_order"))
    again = old.crossJoin(top)  # one row and one row
    for name, value in ((log.version, F.col("_next")), (log.ts, F.lit(ts)), (log.op, F.lit("put")), *(((log.order, F.col("_order")),) if log.order else ())):
        again = again.withColumn(name, value.cast(log.df.schema[name].dataType))
    return log.df.unionByName(again.drop("_next", "_order"))


def prune(log: Log, keep: int | None = None, before=None) -> DataFrame:
    """The log without prior versions beyond the newest `keep` of an id or older than `before` (the union of both)."""
    df = log.df
    if before is not None:
        old = F.col(log.ts) < F.lit(before)
        same = df[log.id].eqNullSafe(F.col("_id"))
        df = df.join(_newest(log), same).where(~(old & (F.col(log.by) < F.col("_newest")))).select(*log.df.columns)
    if keep is not None:
        age = fresh(df, "_age")
        ranked = df.withColumn(age, F.row_number().over(Window.partitionBy(log.id).orderBy(F.col(log.by).desc())))
        df = ranked.where(F.col(age) <= keep + 1).drop(age)  # a rank limit, which Spark also applies before the shuffle
    return df


def with_versions(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """Numbers the writes of each id from 1 in the order given, as _v."""
    return df.withColumn("_v", F.row_number().over(Window.partitionBy(id_col).orderBy(order)))


def canonical(columns: list[str], **constants: Column) -> Column:
    """JSON with sorted keys of the columns, nulls written; keys inside structs are sorted too."""
    fields = {c: F.col(f"`{c}`") for c in columns} | constants
    return F.to_json(F.struct(*[fields[c].alias(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})


def entry_hash(columns: list[str]) -> Column:
    return F.sha2(canonical(columns), 256)


_OPEN = "<prevHash>"


def ledger_append(entries: DataFrame, columns: list[str], order: str, chain: str, heads: DataFrame | None = None) -> DataFrame:
    """Adds index, prevHash and entryHash to entries of each chain (a collection, a vault).

    The hash of an entry covers its columns, its index and the hash of the entry before, so that the head commits to all
    of the past. heads (chain, index, hash): where each chain ended so far; new chains begin at index 0 with prevHash ''.
    A chain is sequential by nature: it is sorted inside one task, and its entries stream through with one hash in memory.
    """
    w = Window.partitionBy(chain).orderBy(order)
    at, open_hash = F.row_number().over(w) - 1, F.lit("").alias("_head")
    if heads is None:
        indexed = entries.withColumn("index", at.cast("long")).withColumn("_head", open_hash)
    else:
        ends = heads.select(F.col(chain).alias("_chain"), (F.col("index") + 1).alias("_from"), F.col("hash").alias("_end"))
        joined = entries.join(ends, entries[chain].eqNullSafe(F.col("_chain")), "left").drop("_chain")
        indexed = joined.withColumn("index", (at + F.coalesce("_from", F.lit(0))).cast("long")).withColumn("_head", F.coalesce("_end", F.lit("")))
        indexed = indexed.drop("_from", "_end")
    indexed = indexed.withColumn("_json", canonical([*columns, "index"], prevHash=F.lit(_OPEN)))
    indexed = indexed.withColumn("_first", F.row_number().over(w) == 1)
    indexed = indexed.repartition(chain).sortWithinPartitions(chain, "index")

    def run(source):
        last = ""
        for batch in source:
            before, own = [], []
            for text, first, head in zip(batch.column("_json").to_pylist(), batch.column("_first").to_pylist(), batch.column("_head").to_pylist(), strict=True):
                last = head if first else last
                before.append(last)
                last = hashlib.sha256(text.replace(f'"prevHash":"{_OPEN}"', f'"prevHash":"{last}"', 1).encode()).hexdigest()
                own.append(last)
            batch = batch.drop_columns(["_json", "_first", "_head"])
            yield batch.append_column("prevHash", pa.array(before, pa.string())).append_column("entryHash", pa.array(own, pa.string()))

    kept = ", ".join(f"`{n}` {t}" for n, t in indexed.dtypes if n not in ("_json", "_first", "_head"))
    return indexed.mapInArrow(run, f"{kept}, prevHash string, entryHash string")


def ledger_verify(ledger: DataFrame, columns: list[str], chain: str) -> DataFrame:
    """Per chain: entries, ok, and the first index that diverges (in its number, its own hash or its link).

    Each entry is checked against the one with the number before: a join by chain and number, so that long chains
    spread over tasks.
    """
    before = ledger.select(F.col(chain).alias("_chain"), (F.col("index") + 1).alias("_next"), F.col("entryHash").alias("_before"))
    joined = ledger.join(before, ledger[chain].eqNullSafe(F.col("_chain")) & (F.col("index") == F.col("_next")), "left")
    linked = F.when(F.col("index") == 0, F.col("prevHash") == "").otherwise(F.coalesce(F.col("prevHash") == F.col("_before"), F.lit(False)))
    good = linked & (F.col("entryHash") == entry_hash([*columns, "index", "prevHash"]))
    checked = joined.select(chain, "index", (~F.coalesce(good, F.lit(False))).alias("_bad"))
    found = checked.groupBy(chain).agg(F.count(F.lit(1)).alias("entries"), (~F.max("_bad")).alias("ok"), F.min(F.when(F.col("_bad"), F.col("index"))).alias("first_bad"))
    return found


def ledger_gaps(df: DataFrame, index: str, chain: str) -> DataFrame:
    """Places where the numbers of a chain do not go up by one: index, the one before, the gap."""
    before = F.lag(index).over(Window.partitionBy(chain).orderBy(index))
    return df.select(chain, F.col(index), before.alias("before")).withColumn("gap", F.col(index) - F.col("before") - 1).where("gap <> 0")


def ledger_head(ledger: DataFrame, chain: str) -> DataFrame:
    return ledger.groupBy(chain).agg(F.max("index").alias("index"), F.max_by("entryHash", "index").alias("hash"))


def ledger_slice(ledger: DataFrame, start: int, stop: int) -> DataFrame:
    """Entries start to stop - 1."""
    return ledger.where((F.col("index") >= start) & (F.col("index") < stop))


def _rows_like(log: Log, rows: DataFrame) -> DataFrame:
    """Rows with the log's columns, missing ones as null."""
    types = {f.name: f.dataType for f in log.df.schema.fields}
    return rows.select(*[(F.col(f"`{c}`") if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def put_many(
    log: Log, incoming: DataFrame, ts, expected: str | None = None, arrival: str | None = None, atomic: bool = False, guard=None
) -> tuple[DataFrame, DataFrame]:
    """The log with the incoming payloads as next versions, and the rejected ones.

    expected names a column with the version a write relies on; a write that expects another one is rejected, or fails
    the whole batch if atomic. Several writes of one id take versions in the order of the column arrival. guard(joined)
    may raise before anything is written; `joined` has the incoming columns and _now, the version that stands.
    """
    now = latest(log).select(F.col(log.id).alias("_id"), F.col(log.version).alias("_now"))
    placed = incoming.withColumn("_turn", F.col(arrival) if arrival else F.monotonically_increasing_id())
    joined = placed.join(now, F.col(log.id) == F.col("_id"), "left").drop("_id").withColumn("_now", F.coalesce("_now", F.lit(0)))
    turn = Window.partitionBy(log.id).orderBy("_turn")
    wrong = (F.col(expected) != F.col("_now") + F.col("_nth")) if expected else F.lit(False)
    joined = joined.withColumn("_nth", F.row_number().over(turn) - 1)
    joined = joined.withColumn("_wrong", F.max(wrong).over(turn.rowsBetween(Window.unboundedPreceding, 0)) if expected else wrong)
    if guard is not None:
        guard(joined)
    rejected = joined.where("_wrong").select(*incoming.columns, F.col("_now").alias("actual_version"))
    if atomic and not rejected.isEmpty():
        raise VersionConflict("a write of the batch expected another version; nothing was written")
    rows = joined.where("NOT _wrong").withColumns({log.version: F.col("_now") + F.col("_nth") + 1, log.ts: F.lit(ts), log.op: F.lit("put")})
    return log.df.unionByName(_rows_like(log, rows)), rejected


def delete_many(log: Log, ids: DataFrame, ts, referrers: list[tuple[DataFrame, str]] = ()) -> DataFrame:
    """The log with a tombstone for each of the ids (column id) that is alive; ids that are not there are left out.

    referrers: (collection, field) pairs that hold strict references; one that still refers to an id fails the deletion.
    """
    alive = current(log)
    hit = alive.join(ids.select(F.col("id").alias("_gone")).distinct(), F.col(log.id) == F.col("_gone"), "left_semi")
    for df, field in referrers:
        held = df.select(F.col(field).cast("string").alias("_ref")).join(hit.select(F.col(log.id).cast("string").alias("_ref")), "_ref", "left_semi")
        if found := held.limit(1).collect():
            raise DanglingReference(f"{field} still refers to {found[0]['_ref']!r}")
    stones = hit.select(log.id, (F.col(log.version) + 1).alias(log.version), F.lit(ts).alias(log.ts), F.lit("delete").alias(log.op))
    return log.df.unionByName(_rows_like(log, stones))


def transaction(logs: dict[str, Log], puts: dict[str, DataFrame], deletes: dict[str, DataFrame], ts, expected: str | None = None) -> dict[str, DataFrame]:
    """New logs of several collections, or none: every put (with its expected version) and every deletion, or VersionConflict.

    Versions are checked against what stood before the transaction, for all collections first; then puts, then deletions.
    """
    out = {}
    for name, incoming in puts.items():
        try:
            out[name], _ = put_many(logs[name], incoming, ts, expected if expected in incoming.columns else None, atomic=True)
        except VersionConflict as e:
            raise VersionConflict(f"{name}: {e}") from e
    for name, ids in deletes.items():
        log = logs[name]
        df = out.get(name, log.df)
        out[name] = delete_many(Log(df, log.id, log.version, log.ts, log.op, log.order), ids, ts)
    return out
