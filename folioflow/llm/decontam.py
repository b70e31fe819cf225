"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, scanned once per text.

Normal form: A-Z lower-cased, words are runs of digits, a-z and characters from U+0080 on, joined by one space with a
space at either end. A pattern is a window of 10 consecutive words of an item (the whole item if it has fewer),
with the same spaces around it, so that a match always covers whole words. A match is mapped to word numbers by
counting spaces and to offsets in the original by the words' own offsets.

Spark normalises the items, drops repeated ones and cuts long ones into overlapping segments of at most SEGMENT words,
so that no row is long. The segments go to the executors by broadcast, in chunks whose windows have about CHUNK_CHARS
characters: sizes are measured first, by Spark. The corpus is read once; where there are several chunks, a task
takes them one after another for each Arrow batch of texts and holds one automaton at a time.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no window; very long texts
and items are taken whole; repeated items count by item_id; hits of a text are in order of its words, overlapping ones
are one; a null item_id counts as an empty string; an empty table gives no rows or no hits; columns that are not read
keep whatever names they have.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, ids_and_bytes, materialise, slices, table

WINDOW = 10
CHUNK_CHARS = 4_000_000

#: Bytes of words stay (A-Z lower-cased), all others become spaces.
NORMAL = bytes(LOWER_AZ[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def windows_of(text: bytes | None, size: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    if not words:
        return []
    return [b" %s " % b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


_BUILT: dict = {}


def automaton(key, items: list[tuple[str, bytes]], size: int):
    """The automaton of one chunk, built once per Python worker; its values are (length, item numbers)."""
    if key not in _BUILT:
        _BUILT.clear()
        holders: dict[bytes, set[int]] = {}
        for n, (_, text) in enumerate(items):
            for w in windows_of(text, size):
                holders.setdefault(w, set()).add(n)
        built = ahocorasick.Automaton()
        for w, who in holders.items():
            built.add_word(w.decode("latin-1"), (len(w), tuple(who)))
        if holders:
            built.make_automaton()
        _BUILT[key] = built if holders else None
    return _BUILT[key]


def scan(text: bytes | None, built) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words of the text, disjoint runs of hit words (end exclusive), and the numbers of the items found."""
    words = words_of(text)
    if not words or built is None:
        return len(words), [], set()
    normal = b" %s " % b" ".join(words)
    spaces, runs, items = None, [], set()
    for end, (length, who) in built.iter(normal.decode("latin-1")):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
        first, last = np.searchsorted(spaces, (end - length + 1, end))
        items.update(who)
        if runs and first <= runs[-1][1]:
            while runs and first <= runs[-1][1]:
                first = min(first, runs[-1][0])
                last = max(last, runs.pop()[1])
        runs.append((int(first), int(last)))
    return len(words), runs, items


def spans_in(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as byte offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


SEGMENT = 2_000


def segments(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (item_id, text): normalised items, long ones cut into segments that share size - 1 words, so that every window is whole."""
    normal = F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.btrim(normal).alias("text")).where("text <> ''").distinct()
    words = F.split("text", " ")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - size), F.lit(SEGMENT))
    cut = items.select("item_id", words.alias("words")).select("item_id", "words", F.explode(starts).alias("at"))
    return cut.select("item_id", F.array_join(F.slice("words", F.col("at") + 1, SEGMENT + size - 1), " ").alias("text")).distinct()


def chunks(benchmark: DataFrame, size: int = WINDOW, chunk_chars: int = CHUNK_CHARS) -> list:
    """(key, broadcast segments) of each bounded part of the benchmark."""
    spark = benchmark.sparkSession
    held = materialise(segments(benchmark, size))
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total * size // chunk_chars))
    parts = [held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [held]
    return [(f"{uuid.uuid4()}", spark.sparkContext.broadcast([(r[0], r[1].encode()) for r in p.collect()])) for p in parts]  # about chunk_chars / size bytes each


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_FOUND = "doc_id {id}, n_words long, runs array<struct<a:long,b:long>>, items array<string>, spans array<struct<a:long,b:long>>"


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scan_all(texts: list[bytes | None], found: list, size: int) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text its words, runs of hit words and the item_ids found, over all chunks, one automaton at a time."""
    out: list = [(0, [], set()) for _ in texts]
    for key, held in found:
        built = automaton(key, held.value, size)
        for i, text in enumerate(texts):
            n, hit, who = scan(text, built)
            out[i] = n, out[i][1] + hit, out[i][2] | {held.value[k][0] for k in who}
    return [(n, united(hit) if len(found) > 1 else hit, who) for n, hit, who in out]


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row of docs: words, runs of hit words, items found, byte spans of the hits."""
    found = chunks(benchmark, size, chunk_chars)
    rows = ids_and_bytes(docs, id_col, text_col)

    def run(source):
        for batch in slices(source) if len(found) == 1 else source:  # several automata are built anew for each
            texts = batch.column("text").to_pylist()
            hits = scan_all(texts, found, size)
            runs = [[{"a": a, "b": b} for a, b in hit] for _, hit, _ in hits]
            spans = [[{"a": a, "b": b} for a, b in spans_in(t, hit)] if hit else [] for t, (_, hit, _) in zip(texts, hits, strict=True)]
            columns = [
                batch.column("doc_id"), pa.array([n for n, _, _ in hits], pa.int64()), pa.array(runs, _RUNS),
                pa.array([sorted(w) for _, _, w in hits], pa.list_(pa.string())), pa.array(spans, _RUNS),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "items", "spans"])

    return rows.mapInArrow(run, _FOUND.format(id=dict(rows.dtypes)["doc_id"]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = WINDOW, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows of docs in which no window occurs."""
    found = chunks(benchmark, size, chunk_chars)

    def run(source):
        for batch in slices(source) if len(found) == 1 else source:  # several automata are built anew for each
            texts = [t.encode("utf-8") if t else None for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([not hit for _, hit, _ in scan_all(texts, found, size)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digest(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from find_hits."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, p: n + p["b"] - p["a"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, [x FOR x IN regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""
