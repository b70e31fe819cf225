"""Live queries: a stream of changes keeps the latest row of each id, and queries run over that state.

The state lies in shared storage: a base, and a delta for each micro-batch since, which holds the newest row an id of that
batch alone. A batch costs what it changes; after COMPACT deltas the next batch folds them into a new base. A batch that
runs again writes its own delta again, and a restarted state begins from what is in the folder. A live query is the
batch query over the state after each batch; an error keeps the last value.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def change_stream(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """Change rows from Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def newest(df: DataFrame, id_col: str, order: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(id_col).alias("_id")).agg(F.max_by(row, order).alias("_row")).select("_row.*")


COMPACT = 16


class LiveState:
    """The latest row of each id of a change stream, and what queries over it gave last."""

    def __init__(self, spark: SparkSession, path: str, id_col: str, order: str, op: str | None = None):
        self.spark, self.path, self.id_col, self.order, self.op = spark, path, id_col, order, op
        self.queries: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.values: dict[str, list] = {}
        self.errors: dict[str, Exception | None] = {}
        self.listeners: list[Callable[[str, list], None]] = []
        self.hooks: list[Callable[[], None]] = []

    def _files(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _parts(self, below: int | None = None) -> tuple[int | None, list[int]]:
        """The newest whole base, and the whole deltas since, in order; of batches below one, if given."""
        path, at, fs = self._files()
        if not fs.exists(at):
            return None, []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        whole = [n for n in names if re.fullmatch(r"[bd]\d+", n) and fs.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        held = sorted((int(n[1:]), n[0]) for n in whole if below is None or int(n[1:]) < below)
        base = max((k for k, kind in held if kind == "b"), default=None)
        return base, [k for k, kind in held if kind == "d" and (base is None or k > base)]

    def _all(self, base: int | None, deltas: list[int]) -> DataFrame | None:
        folders = [f"{self.path}/b{base}"] * (base is not None) + [f"{self.path}/d{k}" for k in deltas]
        return newest(self.spark.read.parquet(*folders), self.id_col, self.order) if folders else None

    def rows(self) -> DataFrame | None:
        """Rows alive in the newest state."""
        df = self._all(*self._parts())
        return df if df is None or self.op is None else df.where(F.col(self.op) != "delete")

    def live(self, name: str, query: Callable[[DataFrame], DataFrame]) -> None:
        """Registers a query whose value follows the stream; its results must be small."""
        self.queries[name] = query
        if self._parts() != (None, []):
            self._run(name)

    def stop(self, name: str) -> None:
        self.queries.pop(name, None)

    def subscribe(self, listener: Callable[[str, list], None]) -> None:
        self.listeners.append(listener)

    def _run(self, name: str) -> None:
        try:
            self.values[name], self.errors[name] = self.queries[name](self.rows()).collect(), None
        except Exception as e:  # the last value stays
            self.errors[name] = e
            return
        for listener in self.listeners:
            listener(name, self.values[name])

    def _compact(self, batch_id: int) -> None:
        """Folds the deltas of earlier batches, which are committed, into a new base, and removes what it holds."""
        base, deltas = self._parts(below=batch_id)
        if len(deltas) < COMPACT:
            return
        self._all(base, deltas).write.mode("overwrite").parquet(f"{self.path}/b{deltas[-1]}")
        path, _, fs = self._files()
        for name in [f"b{base}"] * (base is not None) + [f"d{k}" for k in deltas]:
            fs.delete(path(f"{self.path}/{name}"), True)

    def merge(self, changes: DataFrame, batch_id: int) -> None:
        self._compact(batch_id)
        newest(changes, self.id_col, self.order).write.mode("overwrite").parquet(f"{self.path}/d{batch_id}")
        for name in list(self.queries):
            self._run(name)
        for hook in self.hooks:
            hook()

    def start(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = changes.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


class LiveJoin:
    """A live query over several states: it runs again whenever one of them changes, so that either side of a join counts."""

    def __init__(self, states: dict[str, LiveState], query: Callable[[dict[str, DataFrame]], DataFrame]):
        self.states, self.query, self.value, self.error = states, query, None, None
        self.listeners: list[Callable[[list], None]] = []
        for state in states.values():
            state.hooks.append(self.run)

    def run(self) -> None:
        held = {name: state.rows() for name, state in self.states.items()}
        if any(df is None for df in held.values()):
            return  # a side has not begun
        try:
            self.value, self.error = self.query(held).collect(), None
        except Exception as e:  # the last value stays
            self.error = e
            return
        for listener in self.listeners:
            listener(self.value)

    def stop(self) -> None:
        for state in self.states.values():
            state.hooks.remove(self.run)


def running_counts(changes: DataFrame, key: str, value: str, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """A streaming aggregate of appended rows, kept complete under a table name (for change logs use LiveState)."""
    out = changes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    writer = out.writeStream.outputMode("complete").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()


def presence_stream(events: DataFrame, user: str, ts: str, stale: str) -> DataFrame:
    """Last sight of each user by event-time session: a session ends when the user was silent for `stale`."""
    return events.withWatermark(ts, stale).groupBy(F.session_window(ts, stale).alias("session"), F.col(user)).agg(F.max(ts).alias("last_seen"))
