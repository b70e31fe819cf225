"""Secret scans: fixed patterns, and a battery of randomness tests under length-aware false-discovery control.

Base patterns give their spans as they are. Beside them every run of 20 or more key characters that is not all digits
is a candidate. Its encoding is the smallest of hexadecimal, base 32, base 36, base 62 and base 64 that holds it.
Three tests over the positions of its characters in that encoding's alphabet, in the order common to rare, ask whether
it could be ordinary text: chi-squared uniformity; the runs above and below the alphabet's median; and the serial
correlation of neighbours about its middle. What is plainly not uniform is no key, whatever text looks like. What
ordinary text gives for each encoding (shares of characters, rate of changes across the median, mean and spread of
neighbours' products) is counted over the character pairs of the whole corpus, candidates left out, in the same scan.
The three p-values become one by Fisher's rule, and the Benjamini-Hochberg threshold is set for each encoding and
length class (half an octave, without end) on its own, from a histogram of all candidates of the corpus.

The scan runs once; its rows (spans and candidates, no text) are kept in the shared checkpoint folder.

Defined cases: a null or empty text has no span; very long texts are scanned whole; repeated rows are scanned one by
one; of matches that start together the kind listed first comes first; a candidate inside a base span is left to it,
one that reaches beyond it counts whole; p-values below 1e-30 count as 1e-30; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table

ASSIGN = re.compile(r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Lower-case parts of which one is in every assignment.
_HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Encodings from the smallest alphabet on; fixed values.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_="),
)
_ALPHABETS = [frozenset(a) for _, a in ENCODINGS]
FALSE_DISCOVERIES = 1e-3
_BINS = 50  # of -log10 p to each unit
_TOP = 30  # greatest -log10 p
_SLICE = 1 << 20


#: Letters from common to rare, of European text; fixed values.
COMMON = "enairtsoldhucmgpbfvwkzyxjq"
#: Each encoding's alphabet in the order in which text uses it: small letters, capitals, digits, others.
ORDERS = ["".join(c for c in COMMON + COMMON.upper() + "0123456789+/-_=" if c in a) for _, a in ENCODINGS]


def _positions() -> np.ndarray:
    """Position of each byte in each encoding's order, -1 where it is not in it."""
    out = np.full((len(ENCODINGS), 256), -1, np.int64)
    for i, order in enumerate(ORDERS):
        out[i, [ord(c) for c in order]] = np.arange(len(order))
    return out


_POSITION = _positions()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def battery(word: str) -> tuple[int, float, int, float]:
    """Encoding, chi-squared of uniformity, changes across the median, mean product of neighbours about the middle."""
    kinds = set(word)
    encoding = next(i for i, a in enumerate(_ALPHABETS) if kinds <= a)
    n, k = len(word), len(ENCODINGS[encoding][1])
    at = _POSITION[encoding][np.frombuffer(word.encode(), np.uint8)]
    chi = float((np.bincount(at) ** 2.0).sum() * k / n - n)
    above = 2 * at >= k
    middle = at - (k - 1) / 2
    return encoding, chi, int(np.count_nonzero(above[1:] != above[:-1])), float((middle[1:] * middle[:-1]).mean())


def count_pairs(text: str, total: np.ndarray) -> None:
    """Adds the pairs of neighbouring bytes of a text to the 256 x 256 counts, without those inside candidates."""
    raw = np.frombuffer(_CANDIDATE.sub("", text).encode("utf-8", "surrogatepass"), np.uint8)
    for i in range(0, len(raw) - 1, _SLICE):
        part = raw[i : i + _SLICE + 1].astype(np.int32)
        np.add.at(total, (part[:-1] << 8) | part[1:], 1)


def ordinary(pairs: np.ndarray) -> list[tuple[float, float, float, float, float]]:
    """For each encoding what text within its alphabet looks like, from the 256 x 256 counts of neighbours.

    Sums of squares and of cubes of the characters' shares, rate of changes across the median, mean and variance of
    neighbours' products about the middle. Where the corpus has too few such pairs, pairs of equal letters stand for text.
    """
    pairs = pairs.reshape(256, 256)
    out = []
    for i, (_, alphabet) in enumerate(ENCODINGS):
        codes = np.array([ord(c) for c in alphabet])
        k, at = len(codes), _POSITION[i][codes]
        held = pairs[np.ix_(codes, codes)].astype(np.float64)
        held += np.eye(k) / k
        share = held.sum(axis=1) / held.sum()
        above, middle = 2 * at >= k, at - (k - 1) / 2
        product = np.outer(middle, middle)
        weight = held / held.sum()
        mean = float((weight * product).sum())
        change = float((held * (above[:, None] != above[None, :])).sum() + 0.5) / float(held.sum() + 1)
        out.append((float((share**2).sum()), float((share**3).sum()), change, mean, float((weight * (product - mean) ** 2).sum())))
    return out


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


#: Neighbouring pairs share a character: the variance of their mean is at most three times that of separate pairs.
_SHARED = 3.0


def p_values(n: int, encoding: int, chi: float, changes: int, product: float, text: list) -> tuple[float, float, float]:
    """How likely ordinary text of this length looks at least as random, by each test; normal approximations.

    Random keys are nearer to uniform (lower tail of chi-squared), cross the median more often where text does not
    (upper tail of the changes), and their neighbours' products are nearer to their mean of zero than those of text.
    """
    squares, cubes, change, mean, var = text[encoding]
    k, m = len(ENCODINGS[encoding][1]), n - 1
    # mean and variance of the sum of squared counts of a multinomial with these shares
    expected, spread = k * (1 + m * squares) - n, k * k * (4 * n * (cubes - squares**2) + 2 * squares**2)
    p1 = _below((chi - expected) / math.sqrt(spread + 1e-9))
    p2 = _below(-(changes - 0.5 - m * change) / math.sqrt(_SHARED * m * change * (1 - change) + 1e-9))
    z = (product - mean) / math.sqrt(_SHARED * var / m + 1e-9)
    p3 = _below(z if mean > 0 else -z)
    return p1, p2, p3


def plainly_uneven(encoding: int, chi: float) -> bool:
    """Chi-squared so far above that of a uniform draw (Wilson and Hilferty's cube root, over six deviations): no key."""
    df = len(ENCODINGS[encoding][1]) - 1
    return ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) > 6


def p_value(n: int, encoding: int, chi: float, changes: int, product: float, text: list) -> float:
    """The three p-values joined by Fisher's rule; 1 for what is as far from a key as from text."""
    if plainly_uneven(encoding, chi):
        return 1.0
    x = -sum(math.log(max(p, 1e-60)) for p in p_values(n, encoding, chi, changes, product, text))
    return math.exp(-x) * (1 + x + x * x / 2)


_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_FOUND = [("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.int32()), ("chi", pa.float64()), ("changes", pa.int32()), ("product", pa.float64())]
_RANDOM = pa.list_(pa.struct(_FOUND))
_PAIRS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int64())]))
_SCAN = (
    "doc_id {id}, pairs array<struct<at:int,n:long>>, base array<struct<start:int,kind:int,end:int>>, "
    "random array<struct<start:int,end:int,encoding:int,chi:double,changes:int,product:double>>"
)


def spans_and_candidates(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    spans, found = base_spans(text), []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        word = m[0].rstrip("=")
        if not word.isdigit() and not any(s <= a and b <= e for s, _, e in spans):
            encoding, chi, changes, product = battery(word)
            found.append({"start": a, "end": b, "encoding": encoding, "chi": chi, "changes": changes, "product": product})
    return spans, found


def _scan(source):
    total, last = np.zeros(65_536, np.int64), None
    names = ["doc_id", "pairs", "base", "random"]
    for batch in slices(source):
        base, random = [], []
        for cell in batch.column("text"):
            text = cell.as_py() or ""
            spans, found = spans_and_candidates(text)
            count_pairs(text, total)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            random.append(found)
        last = batch.column("doc_id").type
        columns = [batch.column("doc_id"), pa.nulls(len(base), _PAIRS), pa.array(base, _BASE), pa.array(random, _RANDOM)]
        yield pa.RecordBatch.from_arrays(columns, names=names)
    if last is not None:  # one more row a task: what its texts look like
        at = np.flatnonzero(total)
        pairs = pa.array([[{"at": i, "n": n} for i, n in zip(at.tolist(), total[at].tolist(), strict=True)]], _PAIRS)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, last), pairs, pa.nulls(1, _BASE), pa.nulls(1, _RANDOM)], names=names)


def learn(scanned: DataFrame, q: float = FALSE_DISCOVERIES) -> tuple[list, dict[int, float]]:
    """What ordinary text looks like, and the least depth (-log10 p) that passes in each stratum."""
    sums = scanned.where("pairs is not null").select(F.explode("pairs").alias("p")).groupBy("p.at").agg(F.sum("p.n").alias("n"))
    pairs = np.zeros(65_536, np.int64)
    for r in sums.collect():  # at most 65,536 rows
        pairs[r["at"]] = r["n"]
    text = ordinary(pairs)

    def bins(source):
        for batch in slices(source):
            found = [judge(c, text) for cell in batch.column("random").to_pylist() for c in cell]
            columns = [pa.array([s for s, _ in found], pa.int32()), pa.array([int(d * _BINS) for _, d in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["stratum", "bin"])

    each = scanned.where("pairs is null and size(random) > 0").select("random").mapInArrow(bins, "stratum int, bin int")
    histogram = each.groupBy("stratum", "bin").count().collect()  # strata x bins rows at most
    return text, thresholds([(r["stratum"], r["bin"], r["count"]) for r in histogram], q)


def length_class(n: int) -> int:
    """Half octaves: 16-23, 24-31, 32-47, 48-63 and so on."""
    k = n.bit_length()
    return 2 * k + ((n >> (k - 2)) & 1)


def judge(c: dict, text: list) -> tuple[int, float]:
    """Stratum and depth of a candidate."""
    n = c["end"] - c["start"]
    p = p_value(n, c["encoding"], c["chi"], c["changes"], c["product"], text)
    return c["encoding"] * 64 + length_class(n), min(float(_TOP), -math.log10(max(1e-300, p)))


def accepted(random: list[dict], learned: tuple) -> list[dict]:
    """The candidates of a text that pass, as spans."""
    text, limits = learned
    out = []
    for c in random:
        stratum, depth = judge(c, text)
        if depth >= limits.get(stratum, math.inf):
            out.append({"start": c["start"], "kind": 3, "end": c["end"]})
    return out


def scan_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The one scan of all texts, kept in the shared folder: base spans, candidates, counts of pairs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(_scan, _SCAN.format(id=dict(rows.dtypes)["doc_id"])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, base and spans, arrays of (start, kind, end) in order; kind counts KINDS."""
    scanned = scan_corpus(docs, id_col, text_col)
    learned = learn(scanned, q)

    def run(source):
        for batch in slices(source):
            base = batch.column("base").to_pylist()
            both = zip(base, batch.column("random").to_pylist(), strict=True)
            spans = [sorted(b + accepted(r, learned), key=lambda s: (s["start"], s["kind"])) for b, r in both]
            columns = [batch.column("doc_id"), pa.array(base, _BASE), pa.array(spans, _BASE)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "spans"])

    kind = "array<struct<start:int,kind:int,end:int>>"
    rows = scanned.where("pairs is null").select("doc_id", "base", "random")
    return rows.mapInArrow(run, f"doc_id {dict(scanned.dtypes)['doc_id']}, base {kind}, spans {kind}")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = FALSE_DISCOVERIES, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with every span replaced by the mark; n_chars follows where the input has it."""
    learned = learn(scan_corpus(docs, id_col, text_col), q)

    def run(source):
        for batch in slices(source):
            out = []
            for text in batch.column(text_col).to_pylist():
                if text:
                    base, random = spans_and_candidates(text)
                    spans = [(s, e) for s, _, e in base] + [(c["start"], c["end"]) for c in accepted(random, learned)]
                    text = redact(text, sorted(spans), mark) if spans else text
                out.append(text)
            at = batch.schema.get_field_index(text_col)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            if (at := batch.schema.get_field_index("n_chars")) >= 0:
                lengths = [None if t is None else len(t) for t in out]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(lengths, pa.int64()).cast(batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def thresholds(histogram: list[tuple[int, int, int]], q: float) -> dict[int, float]:
    """Least depth (-log10 p) that passes in each stratum by Benjamini and Hochberg, from counts by bin of depth."""
    limits = {}
    for stratum in {s for s, _, _ in histogram}:
        bins = sorted(((b, n) for s, b, n in histogram if s == stratum), reverse=True)
        m, rank = sum(n for _, n in bins), 0
        for b, n in bins:
            rank += n
            if 10 ** (-b / _BINS) <= q * rank / m:  # the greatest p of the bin
                limits[stratum] = b / _BINS
    return limits


def joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from find_secrets."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(3)]  # a second parameter of the inner function would be the place in the array
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with the spans, which are in order, replaced; overlapping spans get one mark."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


ORACLE_SQL = None  # the method's spans rest on corpus-wide thresholds; tests compare with brute force
