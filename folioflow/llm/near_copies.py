"""Near copies: one document of each group stays; groups are joined by SimHash and by the Jaccard index of shingles.

SimHash of 5-word shingles at 4 bits is the tiled comparison of simhash.py. Alone it leaves most pairs of texts with an
index of 0.8 or more, whose fingerprints differ in up to 13 bits here; a radius that wide would also join strangers. So
pairs of index 0.8 or more are found beside it, without loss, and both kinds of links make the groups.

Shingles are put in one order for all texts, rare ones first (by counts in BUCKETS buckets, then by hash). Two sets of
index 0.8 or more share a shingle among the first n - ceil(0.8 n) + 1 of either, so that texts which share none of these
need no comparison; this holds for any order, rare-first only keeps the groups small. Candidates are compared exactly,
shingle by shingle. First each text meets the least of those it shares a shingle with, then STARS others, drawn anew, if
it is not connected with them; only texts which are then, with the links of SimHash, in different components meet each
other, once a pair, so that a large group of copies is not paired out. They meet at the first shingle in the order that
both have, and only if what either has from there on is enough for an index of 0.8: a text with many shingles of its own,
which are rare and come first, has too few left to be near the others of its group, and meets none of them.

Defined cases: words are kept apart by ASCII white space, A-Z are lower-cased; fewer words than a shingle make one shingle
of them all; very long texts are taken whole; equal texts (by a 64-bit hash) are copies of each other, null is the empty
text; all wordless texts have fingerprint zero and are one group; of a group the row with the smallest id stays (null ids
last, then the smallest hash of the text), of repeated rows any; an empty table gives no rows; all columns stay as they
are, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER_AZ, materialise, remove, shared_dir, slices, spread_join
from .simhash import RADIUS, components, copies_of, keep_first, majority, same_fingerprint, text_bytes

SHINGLE = 5
BUCKETS = 1 << 20
_PART = 4096
_FAN = 256
MARKS = 256
FIRST = 64
STARS = 2
_REMEMBERED = 120_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER_AZ).split() if text else []


def shingles(text: bytes | None, size: int = SHINGLE) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both > 0 and 5 * both >= 4 * (len(a) + len(b) - both)


class _Hashes(dict):
    """Word to a 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < _REMEMBERED:
            self[word] = h
        return h


def hashes(text: bytes | None, known: _Hashes, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles, in order, repeats included."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * _ODD
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def marks_of(one: np.ndarray) -> bytes:
    """How many of the distinct hashes fall into each of MARKS classes: two texts share no more than the lesser counts."""
    counts = np.bincount((one >> np.uint64(40)).astype(np.int64) % MARKS, minlength=MARKS)
    return zlib.compress(np.minimum(counts, 65_535).astype("<u2").tobytes(), 1)


def plausible(a: bytes, b: bytes) -> bool:
    """False where the counts rule out an index of 0.8 or more; never for near copies."""
    x, y = (np.frombuffer(zlib.decompress(m), "<u2").astype(np.int64) for m in (a, b))
    n = int(x.sum() + y.sum())
    both = int(np.minimum(x, y).sum())
    return max(x.max(), y.max()) == 65_535 or 5 * both >= 4 * (n - both)


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One scan of all texts: id, copy (hash of the text), fp (SimHash), marks (see marks_of) a row; and rows of counts."""
    text = text_bytes(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    kind = dict(rows.dtypes)["id"]
    names = ["id", "copy", "fp", "marks", "part", "task", "counts"]

    def run(source):
        total, known, last = np.zeros(BUCKETS, np.int64), _Hashes(), None
        for batch in slices(source):
            fps, marks = np.zeros(batch.num_rows, np.uint64), []
            for i, text in enumerate(batch.column("text")):
                h = hashes(text.as_py(), known)
                one = np.unique(h)
                marks.append(marks_of(one))
                if len(h):
                    fps[i] = majority(h)
                    np.add.at(total, (one & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
            last = batch.column("id").type
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            found = [batch.column("id"), batch.column("copy"), pa.array(fps.view(np.int64)), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([*found, *none], names=names)
        if last is not None:
            task = TaskContext.get().partitionId()
            at = [a for a in range(0, BUCKETS, _PART) if total[a : a + _PART].any()]
            counts = [zlib.compress(total[a : a + _PART].tobytes(), 1) for a in at]
            none = [pa.nulls(len(at), t) for t in (last, pa.int64(), pa.int64(), pa.binary())]
            ints = pa.array([a // _PART for a in at], pa.int32()), pa.array([task] * len(at), pa.int32())
            yield pa.RecordBatch.from_arrays([*none, *ints, pa.array(counts, pa.binary())], names=names)

    return materialise(rows.mapInArrow(run, f"id {kind}, copy long, fp long, marks binary, part int, task int, counts binary"))


def _commonness(sketched: DataFrame) -> np.ndarray:
    """For each bucket of hashes the rounded logarithm of how many texts have shingles in it; sums of _FAN tasks at a time."""

    def add(found: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in found.column("counts").to_pylist())
        one = found.slice(0, 1)
        return pa.table({"part": one.column("part"), "task": one.column("group"), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = sketched.where("part is not null").select("part", "task", "counts")
    most = parts.agg(F.max("task")).first()[0] or 0
    while most > 0:
        grouped = parts.withColumn("group", F.floor(F.col("task") / _FAN).cast("int")).groupBy("part", "group")
        parts, most = grouped.applyInArrow(add, "part int, task int, counts binary"), most // _FAN
    counts = np.zeros(BUCKETS, np.int64)
    for r in parts.collect():  # BUCKETS / _PART rows
        counts[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.round(4 * np.log2(counts + 1.0)).astype(np.uint8)


def _firsts(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """copy, n, token, at: of each text its number of shingles, and the shingles it has to share one of, with their places."""
    held = rows.sparkSession.sparkContext.broadcast(common)

    def run(source):
        level, known, seen = held.value, _Hashes(), set()
        for batch in slices(source):
            copies, sizes, tokens, places = [], [], [], []
            for copy, text in zip(batch.column("copy").to_pylist(), batch.column("text"), strict=True):
                if copy in seen:
                    continue
                if len(seen) < _REMEMBERED // 2:  # a copy more does no harm
                    seen.add(copy)
                h = np.unique(hashes(text.as_py(), known))
                n = len(h)
                if n:
                    order = np.argsort(level[(h & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")
                    chosen = h[order[: n + 1 + (-4 * n // 5)]]
                    copies.append(np.full(len(chosen), copy, np.int64))
                    sizes.append(np.full(len(chosen), n, np.int32))
                    tokens.append(chosen.view(np.int64))
                    places.append(np.arange(len(chosen), dtype=np.int32))
            if copies:
                columns = [pa.array(np.concatenate(x)) for x in (copies, sizes, tokens, places)]
                yield pa.RecordBatch.from_arrays(columns, names=["copy", "n", "token", "at"])

    return rows.mapInArrow(run, "copy long, n int, token long, at int")


def _with_ends(pairs: DataFrame, rows: DataFrame, what: str) -> DataFrame:
    """Pairs (u, v) with a column of rows (copy, what) for either end, as a and b; rows may repeat a copy."""
    wanted = materialise(pairs.select(F.col("u").alias("copy")).unionByName(pairs.select(F.col("v").alias("copy"))).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    held = rows.select("copy", what).join(wanted, "copy", "left_semi").dropDuplicates(["copy"])
    a, b = held.select(F.col("copy").alias("u"), F.col(what).alias("a")), held.select(F.col("copy").alias("v"), F.col(what).alias("b"))
    return pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are near copies: first by their marks, then, for what these leave, by the texts."""

    def likely(source):
        for batch in slices(source):
            keep = [plausible(a.as_py(), b.as_py()) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def sure(source):
        last, left = None, set()
        for batch in slices(source):
            keep = []
            for x, a, b in zip(batch.column("u").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if x != last:
                    last, left = x, shingles(a.as_py())
                keep.append(near(left, shingles(b.as_py())))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialise(pairs.distinct())
    marked = _with_ends(pairs, sketched.where("part is null"), "marks")
    pairs = materialise(marked.mapInArrow(likely, "u long, v long"))
    return materialise(_with_ends(pairs, rows, "text").mapInArrow(sure, "u long, v long"))


def links(rows: DataFrame, sketched: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (u, v) of near copies in rows (copy, text) which, with the links known, join what all pairs of near copies join."""
    folder = f"{shared_dir(rows.sparkSession)}/near_copies/{uuid.uuid4()}"
    _firsts(rows, _commonness(sketched)).write.parquet(folder)
    tokens = rows.sparkSession.read.parquet(folder)
    ends = F.min("copy").alias("first"), F.max("copy").alias("last"), F.count(F.lit(1)).alias("count")
    shared = materialise(tokens.groupBy("token").agg(*ends).where("first <> last"))
    members = materialise(spread_join(tokens, shared.select("token", "first"), "token", sizes=shared).distinct())
    remove(rows.sparkSession, folder)
    heads = materialise(members.where("copy = first").select("token", F.col("n").alias("n_first")))
    fits = lambda x, y: 5 * F.least(x, y) >= 4 * F.greatest(x, y)
    others = members.where("copy <> first")
    star = spread_join(others, heads, "token").where(fits(F.col("n"), F.col("n_first")))
    found = _verified(star.select(F.col("first").alias("u"), F.col("copy").alias("v")), rows, sketched)
    rest = _apart(others, found.unionByName(known))
    for k in range(STARS):  # a head drawn anew for each shingle meets what is not connected with it yet
        head = F.min_by(F.struct("copy", "n", "root"), F.xxhash64("copy", F.lit(k))).alias("head")
        heads = rest.groupBy("token").agg(head)
        heads = materialise(heads.select("token", F.col("head.copy").alias("first"), F.col("head.n").alias("n_first"), F.col("head.root").alias("its")))
        against = materialise(spread_join(rest, heads, "token"))
        star = against.where((F.col("root") != F.col("its")) & fits(F.col("n"), F.col("n_first")))
        more = _verified(star.select(F.col("first").alias("u"), F.col("copy").alias("v")), rows, sketched)
        found = materialise(found.unionByName(more))
        rest = _apart(against.where("copy <> first"), found.unionByName(known))
    return found.unionByName(_verified(_meetings(rest), rows, sketched))


def _meetings(rest: DataFrame) -> DataFrame:
    """Pairs (u, v) of rest (token, copy, n, at, root) in different components that may be near copies.

    Texts of n and m shingles with an index of 0.8 or more share at least 4 / 9 of n + m; at the first shingle that they
    share each has so many left, this one included. So n - at >= 4 / 9 (n + m), or m <= most, holds for both. A pair that
    shares several shingles meets at the first of them, as far as FIRST shingles of either tell.
    """
    most = F.floor((5 * F.col("n") - 9 * F.col("at")) / 4).cast("int").alias("most")
    firsts = F.slice(F.array_sort(F.collect_set(F.struct("at", "token"))), 1, FIRST).getField("token").alias("firsts")
    place = F.array_position("firsts", F.col("token")).cast("int")
    before = F.when(place > 0, place - 1).otherwise(F.size("firsts")).alias("before")
    rest = rest.select("token", "copy", "n", "root", most).join(rest.groupBy("copy").agg(firsts), "copy")
    rest = materialise(rest.select("*", before))
    x, y = rest.alias("x"), rest.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.copy") < F.col("y.copy")) & (F.col("x.root") != F.col("y.root"))
    enough = (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    met = F.arrays_overlap(F.slice("x.firsts", 1, F.col("x.before")), F.slice("y.firsts", 1, F.col("y.before")))
    return x.join(y, apart & enough & ~met).select(F.col("x.copy").alias("u"), F.col("y.copy").alias("v"))


def _apart(rest: DataFrame, found: DataFrame) -> DataFrame:
    """token, copy, n, at, root of rest, for tokens whose copies are not all in one component of the links found."""
    roots = materialise(components(found).withColumnRenamed("node", "copy"))
    held = rest.select("token", "copy", "n", "at")
    rooted = materialise(spread_join(held, roots, "copy", "left").select("token", "copy", "n", "at", F.coalesce("root", "copy").alias("root")))
    split = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return materialise(spread_join(rooted, materialise(split), "token").select("token", "copy", "n", "at", "root"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest id stays (nulls last).

    Who stays is decided on ids and hashes alone; texts are not shuffled for it as long as what goes can be broadcast.
    """
    sketched = _sketches(docs, id_col, text_col)
    each, copies = copies_of(sketched.where("part is null"))
    text = text_bytes(text_col)
    rows = docs.select(F.xxhash64(text).alias("copy"), text.alias("text"))
    alike = materialise(same_fingerprint(copies, radius))
    pairs = links(rows, sketched, alike).unionByName(alike)
    return keep_first(docs, each, copies, pairs, id_col, text_col)
