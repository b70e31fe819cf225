"""Small helpers shared by the operators: tables, materialising, Arrow plumbing."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in the contracts: \x20 and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"
#: A-Z to a-z and nothing else, for bytes.translate.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves in local mode, where driver and executors are one process; on a cluster
    that is an error, since executors would not see the driver's folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Settings by their default in Spark, and rows a batch instead.
_BATCHES = {("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"): "1000", ("spark.sql.parquet.columnarReaderBatchSize", "4096"): "1024"}


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches and those of the Parquet reader have fewer rows where the session leaves Spark's: rows hold whole texts here."""
    for (name, usual), rows in _BATCHES.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, rows)


def materialise(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder and cuts its lineage there."""
    shared_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A side of at most so many narrow rows (keys and numbers) is broadcast, after a count.
BROADCAST_ROWS = 100_000
#: A key with more rows than this, and than this part of all rows, is dealt over many tasks.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has one narrow row a key, without a hot key meeting in one task; both materialised.

    A right side of BROADCAST_ROWS rows is broadcast. Beyond that, keys with more than HOT_ROWS rows and more than a
    HOT_KEYS-th of all rows on the left are HOT_KEYS at most: their rows of right are broadcast, so that the rows of left
    stay where they are. All other keys are joined as usual. sizes: the rows a key on the left (count), where known.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    sizes = left.groupBy(on).count() if sizes is None else sizes
    total = left.count()
    per = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = materialise(sizes.where(F.col("count") > per).select(on))
    if hot.isEmpty():
        return left.join(right, on, how)
    few = right.join(F.broadcast(hot), on, "left_semi")
    busy = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how)
    return busy.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on, how))


def ids_and_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, id and UTF-8 bytes: whatever else the input carries is pruned at the scan."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


_KEPT: dict = {}


def kept(key, make: Callable):
    """What make gives, kept in this Python worker for its next tasks; only the last key asked for is kept."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go(but=None) -> None:
    """Lets go of what is kept under other keys, and gives freed memory back to the system.

    Spark's workers serve one stage after another: without this, a stage would also hold what the stages before it used.
    """
    for key in [k for k in _KEPT if k != but]:
        del _KEPT[key]
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only; elsewhere freed memory stays with the process


def slices(source, rows: int = 1_000, keeps=None):
    """Arrow batches in slices of few rows, so that what is made of them stays small; a batch is let go before the next.

    keeps: the key of what the task uses by kept(); all else that the worker keeps goes before the first batch.
    """
    let_go(keeps)
    for batch in source:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        pa.default_memory_pool().release_unused()


def gathered(source, size: int):
    """Arrow batches put together to at most so many bytes; a larger batch stays as it is."""
    held, n = [], 0
    for batch in source:
        if held and n + batch.nbytes > size:
            yield pa.concat_batches(held)
            held, n = [], 0
        held.append(batch)
        n += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def batches(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
