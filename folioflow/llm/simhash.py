"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Distinct fingerprints only are compared. A tile holds fingerprints of one population count; two fingerprints within the
radius have counts at most the radius apart, so that all other tile pairs are skipped. Inside a pair the same rule
holds for the four 16-bit quarters: their differences in counts must sum up to the radius at most. Tiles beyond BLOCK
fingerprints are cut into blocks by hash; the pairs of blocks are spread over the cluster, and each gives back a spanning
forest of the links it found, never the links of a group.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words than a shingle make
one shingle of them all; very long texts are hashed whole, in parts of 65,536 shingles; a bit that exactly half of the
shingles have is 0; repeated rows and ids are fine, null ids belong to their fingerprint's component but give no
component_id of their own; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER_AZ, fresh, ids_and_bytes, materialise, slices, spread_join, table

SHINGLE = 4
RADIUS = 4
BLOCK = 32_768
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if over half of the shingles' XXH64 values have it."""
    words = text.translate(LOWER_AZ).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    rows = ids_and_bytes(docs, id_col, text_col)

    def run(source):
        for batch in slices(source):
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _quarters(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bit counts of the four 16-bit quarters (n x 4), and which of them each fingerprint has."""
    counts = np.bitwise_count(v.view(np.uint16).reshape(-1, 4))
    keys, which = np.unique(np.ascontiguousarray(counts).view(np.uint32).ravel(), return_inverse=True)
    return keys.view(np.uint8).reshape(-1, 4).astype(np.int16), which


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """Arrays (x, y) of fingerprints of a and b that differ in 1 to radius bits, quarter counts by quarter counts."""
    (keys_a, of_a), (keys_b, of_b) = _quarters(a), _quarters(b)
    order = np.argsort(of_a, kind="stable")
    ends = np.cumsum(np.bincount(of_a, minlength=len(keys_a)))
    for k, end in enumerate(ends.tolist()):
        near_keys = np.abs(keys_b - keys_a[k]).sum(axis=1) <= radius
        if not near_keys.any():
            continue
        mine, other = a[order[(ends[k - 1] if k else 0) : end]], b[near_keys[of_b]]
        step = max(1, 131_072 // len(other))
        for i in range(0, len(mine), step):
            rows = mine[i : i + step]
            near = np.bitwise_count(rows[:, None] ^ other[None, :]) <= radius
            if not near.any():
                continue
            x, y = np.nonzero(near)
            x, y = rows[x], other[y]
            keep = (x < y) if same else (x != y)
            if keep.any():
                yield x[keep], y[keep]


class Forest:
    """Union-find over the numbers 0 to n - 1; the root of a tree is its smallest number."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        found = self.up[x]
        while not np.array_equal(above := self.up[found], found):
            found = above
        self.up[x] = found
        return found

    def root(self, x: int) -> int:
        up = self.up
        while (p := int(up[x])) != x:
            up[x] = p = up[p]
            x = int(p)
        return x

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins x[i] with y[i]; pairs that are connected already fall out all at once."""
        x, y = self.roots(x), self.roots(y)
        apart = x != y
        if not apart.any():
            return
        for a, b in np.unique(np.stack([x[apart], y[apart]], axis=1), axis=0).tolist():
            a, b = self.root(a), self.root(b)
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(len(self.up))
        top = self.roots(x)
        return x[top != x], top[top != x]


def forest_of(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (x, y) of the links between a and b, or inside a."""
    nodes = np.unique(a if same else np.concatenate([a, b]))
    forest = Forest(len(nodes))
    for x, y in near_pairs(a, b, radius, same):
        forest.join(np.searchsorted(nodes, x), np.searchsorted(nodes, y))
    x, y = forest.edges()
    return nodes[x], nodes[y]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Spanning links (u, v) between the distinct fingerprints in column fp: u and v are connected within the radius."""
    counted = fps.select("fp", F.bit_count("fp").cast("int").alias("tile"))
    sizes = {r["tile"]: r["count"] for r in counted.groupBy("tile").count().collect()}  # at most 65 rows
    cuts = F.create_map(*[F.lit(x) for t, n in sizes.items() for x in (t, -(-n // block))]) if sizes else F.lit(None).cast("map<int,int>")
    blocks = (
        counted.withColumn("block", F.pmod(F.hash(F.xxhash64("fp")), F.element_at(cuts, F.col("tile")).cast("int")))
        .groupBy("tile", "block").agg(F.collect_list("fp").alias("members"))
    )  # a block is about BLOCK longs
    targets = F.flatten(
        F.transform(
            F.filter(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda d: F.col("tile") + d), lambda t: F.coalesce(F.element_at(cuts, t), F.lit(0)) > 0),
            lambda t: F.transform(F.sequence(F.lit(0), F.element_at(cuts, t).cast("int") - 1), lambda k: F.struct(t.alias("tile"), k.alias("block"))),
        )
    )
    left = blocks.withColumn("to", F.explode(targets)).where((F.col("to.tile") > F.col("tile")) | (F.col("to.block") >= F.col("block")))
    same = (F.col("to.tile") == F.col("tile")) & (F.col("to.block") == F.col("block"))
    left = left.select(F.col("to.tile").alias("tile"), F.col("to.block").alias("block"), F.col("members").alias("a"), same.alias("same"))
    pairs = left.join(blocks.withColumnRenamed("members", "b"), ["tile", "block"]).select("a", "b", "same")

    def run(source):
        for batch in slices(source):
            for i in range(batch.num_rows):
                a = batch.column("a")[i].values.to_numpy().view(np.uint64)
                b = batch.column("b")[i].values.to_numpy().view(np.uint64)
                x, y = forest_of(a, b, radius, batch.column("same")[i].as_py())
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long").distinct()


#: So many links are joined by one task, in at most about 100 MB; more of them in rounds of joins.
ONE_TASK = 1_000_000
_CHUNK = 50_000


def _joined(source):
    """node and root of all links (u, v) of a task."""
    u, v = [], []
    for batch in source:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
    if u:
        u, v = np.concatenate(u), np.concatenate(v)
        nodes = np.unique(np.concatenate([u, v]))
        forest = Forest(len(nodes))
        for i in range(0, len(u), _CHUNK):
            forest.join(np.searchsorted(nodes, u[i : i + _CHUNK]), np.searchsorted(nodes, v[i : i + _CHUNK]))
        for i in range(0, len(nodes), _CHUNK):
            roots = nodes[forest.roots(np.arange(i, min(i + _CHUNK, len(nodes))))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + _CHUNK]), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node of the edges (u, v).

    At most ONE_TASK edges are joined by one task, without further plans on the driver; beyond that, labels go to the
    neighbours' smallest label and then to that label's own label, until nothing changes, which takes about the
    logarithm of the longest path; each round is cut off in the shared checkpoint folder. The driver sees one number a
    round. Labels that many nodes share are not gathered in one task.
    """
    edges = materialise(edges.select("u", "v").distinct())
    if edges.count() <= ONE_TASK:
        return edges.repartition(1).mapInArrow(_joined, "node long, root long")
    both = materialise(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        seen = spread_join(both, labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        moved = materialise(labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("next")))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = materialise(spread_join(moved, jump, "next").select("node", "old", F.least("next", "far").alias("root")))
        labels = moved.select("node", "root")
        if moved.where("root <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = materialise(components(links(distinct, radius)).withColumnRenamed("node", "fp").join(distinct, "fp"))
    least = materialise(linked.groupBy("root").agg(F.min("least_id").alias("component_id")))
    inside = spread_join(linked, least, "root").select("fp", "component_id")
    named = distinct.join(inside, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    named = materialise(named)
    return spread_join(fps, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_bytes(text_col: str):
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def copies_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (id, copy, fp): each (copy, id) with its number of rows, and each copy with its least key and fp."""
    each = materialise(rows.groupBy("copy", "id").agg(F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp")))
    key = F.struct(F.col("id").isNull().alias("none"), "id", "copy")
    return each, materialise(each.groupBy("copy").agg(F.min(key).alias("key"), F.first("fp").alias("fp")))


def same_fingerprint(copies: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between copies (copy, fp) by SimHash: each copy to the least of its fingerprint, and near fingerprints."""
    least = materialise(copies.groupBy("fp").agg(F.min("copy").alias("first")))
    alike = spread_join(copies, least, "fp").where("copy <> first").select(F.col("first").alias("u"), F.col("copy").alias("v"))
    near_fps = materialise(links(least, radius))
    end = lambda name, to: least.select(F.col("fp").alias(name), F.col("first").alias(to))
    near_fps = near_fps.join(end("u", "x"), "u").join(end("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return alike.unionByName(near_fps)


def keep_first(docs: DataFrame, each: DataFrame, copies: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are first in their component of the links (u, v) between copies."""
    roots = components(pairs).withColumnRenamed("node", "copy")
    grouped = copies.join(roots, "copy", "left").groupBy(F.coalesce("root", "copy").alias("root")).agg(F.min("key").alias("key"))
    first = materialise(grouped.select(F.col("key.id").alias("id"), F.col("key.copy").alias("copy")))
    x, y = each.alias("x"), first.alias("y")
    same = (F.col("x.copy") == F.col("y.copy")) & F.col("x.id").eqNullSafe(F.col("y.id"))
    gone = materialise(x.join(y, same, "left_anti").select("id", "copy"))
    many = materialise(x.where("n > 1").join(y, same, "left_semi").select("id", "copy"))
    return without_rows(docs, gone, many, F.col(id_col), F.xxhash64(text_bytes(text_col)))


def without_rows(docs: DataFrame, gone: DataFrame, many: DataFrame, id_of, copy_of) -> DataFrame:
    """docs without the rows gone (id, copy), and with one of each of the rows many, which repeat."""
    columns, at, copy = docs.columns, fresh(docs, "_id"), fresh(docs, "_copy")
    keyed = docs.withColumns({at: id_of, copy: copy_of})

    def joined(df, keys, how):
        size = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(1))).alias("bytes")).first()
        keys = keys.select(F.col("id").alias("_gone_id"), F.col("copy").alias("_gone_copy"))
        keys = F.broadcast(keys) if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= 100 * BROADCAST_ROWS else keys
        return df.join(keys, (df[copy] == keys["_gone_copy"]) & df[at].eqNullSafe(keys["_gone_id"]), how)

    if many.isEmpty():
        return joined(keyed, gone, "left_anti").select(*[f"`{c}`" for c in columns])
    one = joined(keyed, many, "left_semi").dropDuplicates([at, copy])
    rest = joined(joined(keyed, gone, "left_anti"), many, "left_anti")
    return rest.unionByName(one).select(*[f"`{c}`" for c in columns])


def one_of_each(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest id stays (nulls last)."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_bytes(text_col)).alias("copy"))
    fps = fingerprints(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", shingle)
    each, copies = copies_of(fps.select("doc_id.id", "doc_id.copy", "fp"))
    return keep_first(docs, each, copies, same_fingerprint(copies, radius), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
