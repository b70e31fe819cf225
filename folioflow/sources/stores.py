"""Stores: where collections live, as Spark readers and writers; routing and tiering between them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions
from ..operators.shared import checkpointed


@dataclass(frozen=True)
class FolderStore:
    """Collections as folders of a format under a path that any Spark file system may hold. Names with _ are hidden."""

    path: str
    format: str = "parquet"
    options: dict = field(default_factory=dict)

    def read(self, spark: SparkSession, collection: str) -> DataFrame:
        return spark.read.format(self.format).options(**self.options).load(f"{self.path}/{collection}")

    def write(self, df: DataFrame, collection: str, mode: str = "overwrite") -> None:
        df.write.format(self.format).options(**self.options).mode(mode).save(f"{self.path}/{collection}")

    def collections(self, spark: SparkSession) -> list[str]:
        """Names in order, by the file system that Spark itself uses."""
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        return sorted(n for n in names if not n.startswith("_"))


@dataclass(frozen=True)
class JdbcStore:
    """Collections as tables of a database; Spark pushes filters, columns and limits down."""

    url: str
    properties: dict = field(default_factory=dict)
    partition: tuple | None = None  # (column, lower, upper, parts)

    def read(self, spark: SparkSession, collection: str) -> DataFrame:
        if self.partition is None:
            return spark.read.jdbc(self.url, collection, properties=self.properties)
        column, low, high, n = self.partition
        return spark.read.jdbc(self.url, collection, column, low, high, n, properties=self.properties)

    def write(self, df: DataFrame, collection: str, mode: str = "overwrite") -> None:
        df.write.jdbc(self.url, collection, mode, self.properties)


@dataclass(frozen=True)
class MemoryStore:
    """Collections as DataFrames held by name, for tests and small tables."""

    held: dict = field(default_factory=dict)

    def read(self, spark: SparkSession, collection: str) -> DataFrame:
        return self.held[collection]

    def write(self, df: DataFrame, collection: str, mode: str = "overwrite") -> None:
        self.held[collection] = self.held[collection].unionByName(df) if mode == "append" and collection in self.held else df

    def collections(self, spark: SparkSession) -> list[str]:
        return sorted(n for n in self.held if not n.startswith("_"))


@dataclass(frozen=True)
class RoutedStore:
    """Reads and writes by the first route whose prefix or name fits; reads of a tiered collection are unions."""

    default: object
    routes: dict = field(default_factory=dict)  # collection, or a prefix that ends in *, -> store
    cold: object | None = None

    def store(self, collection: str):
        if collection in self.routes:
            return self.routes[collection]
        fits = [r for r in self.routes if r.endswith("*") and collection.startswith(r[:-1])]
        return self.routes[max(fits, key=len)] if fits else self.default  # the longest prefix that fits

    def read(self, spark: SparkSession, collection: str) -> DataFrame:
        hot = self.store(collection).read(spark, collection)
        if self.cold is None:
            return hot
        try:
            cold = self.cold.read(spark, collection)
        except Exception as e:  # nothing has cooled yet
            if "PATH_NOT_FOUND" not in str(e) and not isinstance(e, KeyError):
                raise
            return hot
        return hot.unionByName(cold, allowMissingColumns=True)

    def write(self, df: DataFrame, collection: str, mode: str = "overwrite") -> None:
        self.store(collection).write(df, collection, mode)

    def compact(self, spark: SparkSession, collection: str, ts: str, cutoff) -> tuple[DataFrame, DataFrame]:
        """Hot and cold rows of a collection by age; the caller writes them to the two tiers."""
        df = self.store(collection).read(spark, collection)
        return df.where(~(F.col(ts) < F.lit(cutoff))), df.where(F.col(ts) < F.lit(cutoff))


@dataclass(frozen=True)
class LogStore:
    """A versioned collection in a store: its change log is appended to, and read as the latest row of each id."""

    store: object
    collection: str
    id: str = "id"

    def log(self, spark: SparkSession) -> versions.Log:
        return versions.Log(self.store.read(spark, self.collection), self.id)

    def list(self, spark: SparkSession) -> DataFrame:
        return versions.current(self.log(spark))

    def get(self, spark: SparkSession, id_value) -> DataFrame:
        """One row, or none: the id reaches the scan as a filter."""
        log = self.log(spark)
        return versions.current(versions.Log(log.df.where(F.col(self.id) == F.lit(id_value)), self.id))

    def list_since(self, spark: SparkSession, ts) -> DataFrame:
        """The last write of each id that was written after ts, tombstones included."""
        return versions.latest(self.log(spark)).where(F.col("_ts") > F.lit(ts))

    def _append(self, log: versions.Log, after: DataFrame) -> None:
        """Writes the rows that `after` has beyond the log: those with a version above the newest of their id."""
        top = log.df.groupBy(F.col(self.id).alias("_id")).agg(F.max(log.version).alias("_top"))
        fresh = after.join(top, F.col(self.id) == F.col("_id"), "left").where((F.col(log.version) > F.col("_top")) | F.col("_top").isNull())
        self.store.write(checkpointed(fresh.select(*log.df.columns)), self.collection, "append")

    def put(self, spark: SparkSession, incoming: DataFrame, ts, expected: str | None = None, atomic: bool = False) -> DataFrame:
        """Appends the next versions; gives the rejected writes back."""
        log = self.log(spark)
        after, rejected = versions.put_many(log, incoming, ts, expected, atomic=atomic)
        rejected = checkpointed(rejected)
        self._append(log, after)
        return rejected

    def delete(self, spark: SparkSession, ids: DataFrame, ts, referrers: list = ()) -> None:
        log = self.log(spark)
        self._append(log, versions.delete_many(log, ids, ts, referrers))


def op_metrics(log: DataFrame, method: str = "method", ms: str = "ms", error: str = "error") -> DataFrame:
    """Per method: calls, errors, percentiles, greatest and mean of the milliseconds, from a log of store calls."""
    p = lambda q: F.percentile(ms, q)
    return log.groupBy(method).agg(
        F.count(F.lit(1)).alias("count"), F.count(F.when(F.col(error), 1)).alias("errors"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max(ms).alias("max"), F.avg(ms).alias("avg")
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def slice_of(df: DataFrame, since=None, tier_at_most: int | None = None, where: Column | None = None) -> DataFrame:
    """The part of a collection that goes into a bundle: written at or after since, up to a tier, by a predicate."""
    if since is not None:
        df = df.where(F.col("_ts") >= F.lit(since))
    if tier_at_most is not None:
        df = df.where(F.coalesce("_tier", F.lit(0)) <= tier_at_most)
    return df if where is None else df.where(where)
