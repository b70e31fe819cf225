"""Token-id output: encodes a corpus, writes token files in ascending document order, and reads them back.

Documents are put in order by ranges of their id (equal ids by their text's hash, so that a much repeated id does not
meet in one task); every task writes frames of about FRAME ids (see token_file), numbered by task and frame. Starts come
from the frames' own counts: sums over frames of a file, and over files, which are one row a frame.

Defined cases: a null text is empty and still has its end id; very long texts are encoded whole and may fill a frame
alone; null ids come first; repeated rows are written one by one, equal ids in the order of their texts' hashes; an empty
table writes no frame; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, shared_dir, slices, table
from .token_file import read_frame, write_frame
from .tokenizing import encode_all

END = b"\0\0\0\0"
FRAME = 8_000_000
TOGETHER = 12_000_000  # bytes of batches that are encoded together


def encode_corpus(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> None:
    """Writes the token files of docs to the folder out, by the tokenizer file at path."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType

    def run(source):
        file, number = TaskContext.get().partitionId(), 0
        ids, held, counts, size, id_type = [], bytearray(), [], 0, None

        def full():
            frame_bytes = write_frame(np.array(counts, np.int64), np.frombuffer(held, "<u4"))
            doc_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, id_type))
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), doc_ids, pa.array([frame_bytes], pa.binary())], names=["file", "number", "n_ids", "doc_ids", "frame"]
            )

        for batch in gathered(slices(source, keeps=path), TOGETHER):
            id_type = batch.column("doc_id").type
            for doc_id, whole in zip(batch.column("doc_id").to_pylist(), encode_all(path, batch.column("text")), strict=True):
                ids.append(doc_id)
                held += whole
                held += END
                counts.append(len(whole) // 4 + 1)
                size += counts[-1]
                if size >= frame:
                    yield full()
                    ids, held, counts, size, number = [], bytearray(), [], 0, number + 1
        if ids:
            yield full()

    rows.mapInArrow(run, f"file int, number int, n_ids long, doc_ids array<{kind.simpleString()}>, frame binary").write.parquet(out)


def read_corpus(spark: SparkSession, out: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a folder of token files, and its ids if asked for."""
    frames = spark.read.parquet(out)
    kind = frames.schema["doc_ids"].dataType.elementType.simpleString()
    inside = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = frames.groupBy("file").agg(F.sum("n_ids").alias("_n")).select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    places = frames.select("file", "number", "n_ids").withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    places = places.join(files, "file").select("file", "number", (F.col("_before") + F.col("_inside")).alias("_start"))

    def rows_of(file: int, number: int, doc_ids: pa.Array, frame: bytes):
        """A frame's rows; its ids are let go before the next frame is read, and copied only if asked for."""
        counts, ids = read_frame(frame)
        ends = np.cumsum(counts)
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        same = [pa.array(np.full(len(counts), k, np.int32)) for k in (file, number)]
        columns = [*same, doc_ids, pa.array(ends - counts), pa.array(counts), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
        names = ["file", "number", "doc_id", "_at", "n_tokens", "ids_crc32"]
        held = [pa.array([p.tobytes() for p in parts], pa.binary())] if keep_ids else []
        return pa.RecordBatch.from_arrays(columns + held, names=names + ["ids"] * keep_ids)

    def run(source):
        for batch in source:
            for i in range(batch.num_rows):
                file, number, doc_ids, frame = (batch.column(k)[i] for k in ("file", "number", "doc_ids", "frame"))
                yield rows_of(file.as_py(), number.as_py(), doc_ids.values, frame.as_py())

    schema = f"file int, number int, doc_id {kind}, _at long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    docs = frames.select("file", "number", "doc_ids", "frame").mapInArrow(run, schema)
    return docs.join(places, ["file", "number"]).select("doc_id", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_dir(spark)}/token_files/{uuid.uuid4()}"
    encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_corpus(spark, out)
