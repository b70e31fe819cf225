"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

Channel. A character of a disguised word may stand for itself or, at a cost, for the letters it looks like (LOOKS); a
run of two or more equal characters stands for one or two of them; single letters in a row, kept apart by one or more
blanks or signs, stand for words: the same search also sets the blanks between them. Viterbi decoding over the lattice
of readings maximises channel and character trigrams, which are counted over all texts. Only words that carry such signs
are decoded, of any length: a place has few readings and the search keeps one path for each two last symbols, so that
its work is linear. The others are their own restoration.

Score. Restored words give features (the word, its beginnings, its inner character sequences). Counts of documents
by label choose the SELECTED features with the greatest likelihood ratio; a logistic regression over their presence
gives the score. Learning uses at most SAMPLE labelled documents, of rows with crc32(doc_id as text) mod 5 other than 0;
lang, source and doc_id are never inputs of a score.

Defined cases: null, empty and wordless texts get the score of no features; very long texts and words are read whole;
of readings with equal sums the one found first stays (as written before as meant); repeated rows are scored one by one,
for learning a doc_id counts once, with its least text; without labels of both kinds every score is the share of toxic
labels (0 if none); an empty table gives no rows; other columns are not read, and drop_toxic gives all columns back.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table

#: What characters are written for; fixed values.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "h",
}
FOLDS = 5
SAMPLE = 20_000
SELECTED = 2_000
LEAST_GAIN = 12.0
FEATURE_BITS = 22
REMEMBERED, REMEMBERED_WHOLE = 200_000, 60_000  # tokens: with their chosen features, with all features
_LOOK_COST = 1.0
_SIZE = 32  # symbols of the language model: 0 outside words, 1-26 letters, 27 letters from U+0080 on, 28 digits, 29 others
_SYMBOL = np.array([27 if c >= 128 else 28 if 48 <= c <= 57 else (c | 32) - 96 if chr(c).isalpha() else 0 if c <= 32 else 29 for c in range(256)], np.int64)

_BETWEEN = r"[\s.\-_*/\\,;:~=·•]"
_APART = re.compile(rf"(?<![^\W_])(?:[^\W_]{_BETWEEN}++){{2,}}[^\W_](?![^\W_])")
_GAP = re.compile(f"{_BETWEEN}+")
_TOKEN = re.compile(r"[^\s,;:?\"“”()\[\]{}<>/\\]+")
_RUN = re.compile(r"(.)\1+")
_SIGN = re.compile(r"[0-9@$!|+€(*#]")


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


class _Symbols(dict):
    """Character to its symbol; the letters from U+0080 on are not kept."""

    def __missing__(self, c: str) -> int:
        return 27


_SYMBOLS = _Symbols({chr(c): int(_SYMBOL[c]) for c in range(128)})


def symbol(c: str) -> int:
    return _SYMBOLS[c]


def trigrams(docs: DataFrame) -> np.ndarray:
    """Natural logs of the character trigram probabilities of the corpus, as (32, 32, 32); all texts are counted."""

    def run(source):
        total = np.zeros(_SIZE**3, np.int64)
        for batch in slices(source):
            for cell in batch.column("text"):
                raw = cell.as_buffer()
                if raw is not None and raw.size:
                    s = np.concatenate(([0, 0], _SYMBOL[np.frombuffer(raw, np.uint8)], [0]))
                    total += np.bincount((s[:-2] * _SIZE + s[1:-1]) * _SIZE + s[2:], minlength=_SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "at long, n long")
    counts = np.zeros(_SIZE**3)
    for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 32^3 rows
        counts[r["at"]] = r["n"]
    counts = counts.reshape(_SIZE, _SIZE, _SIZE)
    lower = counts.sum(0) + 0.01
    lower = lower / lower.sum(1, keepdims=True)
    return np.log((counts + 5 * lower) / (counts.sum(2, keepdims=True) + 5))


def readings(word: str, blanks: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice: for each place of the word (runs made one place) the strings it may stand for, with costs.

    With blanks, any place but the first may also begin a new word.
    """
    places, at = [], 0
    for m in _RUN.finditer(word):
        places += [(c, 1) for c in word[at : m.start()]] + [(m[1], m.end() - m.start())]
        at = m.end()
    places += [(c, 1) for c in word[at:]]
    out = []
    for c, n in places:
        looks = [(x, _LOOK_COST) for x in LOOKS.get(c, "")]
        if n == 2:
            one = [(c, 0.0), *looks]
            ways = [(c, 0.5), *looks, *((x + y, i + j) for x, i in one for y, j in one)]
        else:
            ways = [(c, 0.0), *([(c + c, 0.5)] if n > 2 else []), *looks]
        if blanks and out:
            ways += [(" " + x, k) for x, k in ways]
            if n == 2:
                ways.append((c + " " + c, 0.0))
        out.append(ways)
    return out


def flat(model: np.ndarray) -> list[float]:
    """The model as restore reads it fastest."""
    return model.ravel().tolist()


def restore(word: str, model, blanks: bool = False) -> str:
    """Viterbi decoding of a word under a model or its flat list; states are the last two symbols, texts are chains."""
    logs = flat(model) if isinstance(model, np.ndarray) else model
    states: dict = {0: (0.0, None)}  # the last two symbols as one number
    for ways in readings(word, blanks):
        steps = [([symbol(c) for c in way], cost, way) for way, cost in ways]
        following: dict = {}
        for state, (score, chain) in states.items():
            for symbols, cost, way in steps:
                at, total = state, score - cost
                for k in symbols:
                    at = at * _SIZE + k
                    total += logs[at]
                    at %= _SIZE * _SIZE
                if at not in following or total > following[at][0]:
                    following[at] = (total, (chain, way))
        states = following
    _, chain = max(((score + logs[at * _SIZE], chain) for at, (score, chain) in states.items()), key=lambda x: x[0])
    found = []
    while chain is not None:
        chain, way = chain
        found.append(way)
    return "".join(reversed(found))


def undouble(word: str, logs: list[float]) -> str:
    """As restore, for a word without signs: each run stands for one or two letters, and the few words are scored whole."""
    ways, at = [("", 0.0)], 0
    for m in _RUN.finditer(word):
        one, two = (0.5, 0.0) if m.end() - m.start() == 2 else (0.0, 0.5)
        plain, c = word[at : m.start()], m[1]
        ways = [way for text, cost in ways for way in ((text + plain + c, cost + one), (text + plain + c + c, cost + two))]
        at = m.end()
    best, found = -math.inf, word
    for text, cost in ways:
        text, state, total = text + word[at:], 0, -cost
        for k in map(_SYMBOLS.__getitem__, text):
            state = (state & 1023) << 5 | k
            total += logs[state]
        total += logs[(state & 1023) << 5]
        if total > best:
            best, found = total, text
    return found


def features(word: str) -> list[int]:
    """Hashes of a word, its beginnings of 2 to 6 characters and its inner sequences of 4."""
    w, mask, crc = f"^{word}$", (1 << FEATURE_BITS) - 1, zlib.crc32
    n = len(w)
    if w.isascii():  # a character is a byte
        w = w.encode()
        return [crc(p) & mask for p in {w, *(w[:k] for k in range(3, min(8, n))), *(w[i : i + 4] for i in range(1, n - 4))}]
    parts = {w, *(w[:k] for k in range(3, min(8, n))), *(w[i : i + 4] for i in range(1, n - 4))}
    return [crc(p.encode("utf-8", "surrogatepass")) & mask for p in parts]


class Reader(dict):
    """Token to the chosen features of its restoration (all features if none are chosen yet)."""

    def __init__(self, model: np.ndarray, chosen: dict[int, int] | None):
        super().__init__()
        self.model, self.chosen = flat(model), chosen
        self.most = REMEMBERED_WHOLE if chosen is None else REMEMBERED

    def word(self, token: str) -> str:
        word = token.strip(".,!?-_*'’")
        if _SIGN.search(word):
            return restore(word, self.model) if any(c.isalpha() for c in word) or _RUN.search(word) else word
        runs = len(_RUN.findall(word))
        return word if not runs else undouble(word, self.model) if runs <= 4 else restore(word, self.model)

    def __missing__(self, token: str) -> tuple[int, ...] | array:
        word = self.word(token)
        found = features(word) if word else []
        if self.chosen is not None:
            found = [self.chosen[f] for f in found if f in self.chosen]
        found = array("i", found) if self.chosen is None else tuple(found)
        if len(self) < self.most and len(token) <= 64:
            self[token] = found
        return found

    @staticmethod
    def spaced(run: str) -> list[str]:
        """The letters of a spaced-out run, in parts if some gaps are wider than others."""
        least = min(map(len, _GAP.findall(run)))
        parts = [_GAP.sub("", p) for p in re.split(f"{_BETWEEN}{{{least + 1},}}", run)]
        return [p for p in dict.fromkeys([*parts, "".join(parts)]) if len(set(p)) > 1]

    def read(self, text: str | None) -> set[int]:
        if not text:
            return set()
        text = text.lower()
        found: set[int] = set()
        for f in map(self.__getitem__, set(_TOKEN.findall(text))):
            if f:
                found.update(f)
        for m in _APART.finditer(text):
            for letters in self.spaced(m[0]):
                found.update(self[restore(letters, self.model)])
                for word in restore(letters, self.model, blanks=True).split():
                    found.update(self[word])
        return found


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most `sample` labelled documents (toxic, text), one row a doc_id (its least text), none of the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    chosen = labels.where((fold != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` small rows
    return materialise(texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")))


def _select(rows: DataFrame, model: np.ndarray, selected: int) -> dict[int, int]:
    """The features that tell the labels apart best, by the likelihood ratio of their document counts."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(source):
        reader, counts = Reader(held.value, None), np.zeros((2, 1 << FEATURE_BITS), np.int32)
        for batch in slices(source):
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                counts[int(toxic > 0), list(reader.read(text.as_py()))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at].astype(np.int64)), pa.array(counts[1, at].astype(np.int64))], names=["feature", "clean", "toxic"])

    sizes = {bool(r["t"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = float(sizes.get(False, 0)), float(sizes.get(True, 0))
    if not n0 or not n1:
        return {}
    found = rows.mapInArrow(run, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    part = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    a, b, all_ = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    n = n0 + n1
    gain = part(a, n0) + part(b, n1) + part(n0 - a, n0) + part(n1 - b, n1) - part(all_, n) - part(n - all_, n)
    best = found.withColumn("gain", gain).where(f"gain >= {LEAST_GAIN}").orderBy(F.desc("gain"), "feature").limit(selected)
    return {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}


def _fit(rows: DataFrame, model: np.ndarray, chosen: dict[int, int], rounds: int = 400, decay: float = 2e-4) -> np.ndarray:
    """Weights of the chosen features and a constant; plain gradient steps with momentum on the bounded sample."""
    held = rows.sparkSession.sparkContext.broadcast((model, chosen))

    def run(source):
        reader = Reader(*held.value)
        for batch in slices(source):
            found = [sorted(reader.read(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    got = rows.select("toxic", "text").mapInArrow(run, "toxic int, found array<int>").collect()  # at most SAMPLE rows of chosen features
    y = np.array([r["toxic"] > 0 for r in got], np.float64)
    row = np.repeat(np.arange(len(got)), [len(r["found"]) for r in got])
    col = np.array([f for r in got for f in r["found"]], np.int64)
    share = float(y.mean()) if len(y) else 0.0
    w, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    if not chosen:
        w[-1] = math.log(share / (1 - share)) if 0 < share < 1 else 40.0 if share else -40.0
        return w
    w[-1] = math.log(share / (1 - share))
    df = np.bincount(col, minlength=len(chosen)) / len(y)
    rate = np.append(0.5 / np.maximum(df, 1e-3) ** 0.5, 1.0)
    for _ in range(rounds):
        z = w[-1] + np.bincount(row, w[col], minlength=len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.append(np.bincount(col, error[row], minlength=len(chosen)) / len(y), error.mean())
        grad[:-1] += decay * w[:-1]
        v = 0.9 * v - rate * grad
        w += v
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, selected: int = SELECTED) -> tuple[np.ndarray, dict[int, int], np.ndarray]:
    """Character model, chosen features and weights: what score needs, bounded whatever the corpus."""
    model = trigrams(docs)
    rows = _training(docs, labels, sample)
    chosen = _select(rows, model, selected)
    return model, chosen, _fit(rows, model, chosen)


def _scores(texts: pa.Array, reader: Reader, weights: np.ndarray) -> np.ndarray:
    z = np.array([weights[-1] + weights[list(f)].sum() if (f := reader.read(t.as_py())) else weights[-1] for t in texts], np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, trained) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    held = docs.sparkSession.sparkContext.broadcast(trained)
    rows = docs.select("doc_id", "text")

    def run(source):
        model, chosen, weights = held.value
        reader = Reader(model, chosen)
        for batch in slices(source):
            p = _scores(batch.column("text"), reader, weights)
            out = pa.array([held_out(d) for d in batch.column("doc_id").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), out, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(source):
        model, chosen, weights = held.value
        reader = Reader(model, chosen)
        for batch in slices(source):
            yield batch.filter(pa.array(_scores(batch.column("text"), reader, weights) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
