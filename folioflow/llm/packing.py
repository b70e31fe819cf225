"""Best-fit packing by sums of squares.

Sequences of `capacity` tokens are bins. N(g) is the number of open bins with g free tokens; a piece of s tokens goes
into the gap g that makes the sum of N(g) squared smallest (N(g) falls by one, N(g - s) rises by one). A bin is opened
only for a piece that fits into none: with long pieces first this needs about as few sequences as best-fit decreasing,
where the rule that may open a bin at any time needs 0.6 to 4 % more. Documents longer than a sequence are cut into
full pieces, which are sequences of their own, and a rest. The rests are packed in groups of at most about GROUP pieces,
each by one task that keeps N and the open bins alone: the state is bounded by the capacity and the group. Groups are
dealt by the hash of a row's place among the pieces, so that no group grows with the input, nor with repeated rows.
Inside a group long pieces come first; each group leaves about one bin part-filled, which GROUP keeps rare.

Defined cases: a null text is empty and still has its end id; very long texts are encoded whole and cut into pieces;
repeated rows are packed one by one; ties go to the smallest gap; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table
from .tokenizing import encoder

CAPACITY = 2048
END = b"\0\0\0\0"
GROUP = 1 << 16


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(source):
        encode = encoder(path, keeps_space=False)
        for batch in slices(source, keeps=path):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                whole = encode(text.as_py()) + END
                for k, a in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[a : a + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            made = [batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *longs]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(made + [pa.array(ids, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def place(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given, by the smallest sum of squares."""
    count = np.zeros(capacity + 1, np.int64)  # N(g) for 0 < g < capacity; full and unopened bins do not count
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        rest = capacity - s
        if rest == 0:
            bins[i], opened = opened, opened + 1
            continue
        # half the change of the sum: moving g to g - s is N(g - s) - N(g) + 1, filling a bin up is 1/2 - N(s)
        gain = (count[:rest] - count[s:capacity] + 1).astype(np.float64)
        gain[0] = 0.5 - count[s]
        gain[count[s:capacity] == 0] = np.inf
        best = int(np.argmin(gain))
        if gain[best] < np.inf:
            gap = best + s
            b = waiting[gap].pop()
            count[gap] -= 1
            left = gap - s
            offsets[i] = capacity - gap
        else:
            b, opened, left = opened, opened + 1, rest
        bins[i] = b
        if left:
            waiting[left].append(b)
            count[left] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece, start, length, ids_crc32."""
    pieces = materialise(pieces)
    full, rest = pieces.where(F.col("length") >= capacity), pieces.where(F.col("length") < capacity)
    n_groups = max(1, -(-rest.count() // group))
    # full pieces are sequences of their own: odd numbers, unique without a shuffle
    alone = full.select("*", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # pieces are written already, so that a row's place stays the same; repeated rows fall into different groups
    rest = rest.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))

    def run(key, found):
        sizes = found.column("length").to_numpy()
        order = np.lexsort((found.column("ids_crc32").to_numpy(), -sizes))
        found = found.take(pa.array(order))
        bins, offsets = place(sizes[order], capacity)
        number = 2 * (bins * n_groups + key[0].as_py())
        return found.drop_columns(["_group"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return alone.unionByName(rest.groupBy("_group").applyInArrow(run, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(cut(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
