"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The base measures and verdict are fixed; RULES is the method's own table, each row a ratio and the bounds it must
keep. All measures are DataFrame functions over the words and lines of one row, so that a document never leaves its
task and nothing is shuffled.

Defined cases: a null or wordless text has zero for every measure and fails the base rule; ratios with a zero
denominator are zero; very long texts are measured whole, inside their row; a ratio that equals its bound passes;
repeated rows and ids are measured one by one; an empty table gives no rows; other columns of the input are not read.
Repeated 3-word windows are found by the 64-bit hashes of their words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the ratio, and the least and greatest value that pass (None: no bound)."""

    ratio: str
    least: float | None = None
    most: float | None = None


#: Common function words of the corpus languages (en, de, fr, es); fixed values.
STOP_WORDS = tuple(
    "the of and to in is a that it for on with as are was be by this from at an or "
    "der die und den von mit das des im auf ist ein eine nicht zu dem als für sich auch "
    "le la les de des et un une du en que qui est dans par pour sur au pas il elle "
    "el los las del y que se con por para su al es no lo una como más".split()
)

RULES = (
    Rule("symbols_per_char", most=0.05),
    Rule("emphasis_per_word", most=0.30),
    Rule("bars_per_word", most=0.25),
    Rule("stop_words_per_word", least=0.02),
    Rule("chars_per_word", least=2.0, most=14.0),
    Rule("dup_lines_per_line", most=0.50),
    Rule("repeats_per_word", most=0.30),
)


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def without(text: Column, parts) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), parts, text)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: bound to a lambda variable, which no optimizer rule takes apart again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more."""

    def covered(starts):
        # each start covers three words, or as many as there are before the next start
        each = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1), s + 3) - s))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(ordered):
        # windows in order of their hash: equal ones are neighbours, and keep the place where they start
        same = lambda x, j: (x["h"] == F.get(ordered, j - 1)["h"]) | (x["h"] == F.get(ordered, j + 1)["h"])
        return F.sort_array(F.transform(F.filter(ordered, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

    def of(windows):
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(ordered, lambda o: let(starts(o), covered))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(hashes, of)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base measures and the ratios that RULES names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    stop = lambda w: F.lower(F.rtrim(w, F.lit(".,;:?!"))).isin(*STOP_WORDS)
    text = F.col("_text")
    of_words = let(
        F.filter(F.split("_text", SPACE), lambda w: w != ""),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w == "|")).alias("_bars"), F.size(F.filter(words, stop)).alias("_stops"),
        ),
    )
    of_lines = let(lines, lambda held: F.struct(F.size(held).cast("long").alias("n_lines"), (F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("n_dup_lines")))
    held = held.withColumn("_w", of_words).withColumn("_l", of_lines)
    held = held.select(
        "doc_id", "_w.n_words", "_w.word_chars", (F.length(text) - F.length(without(text, "#*$%&|<>"))).cast("long").alias("n_symbols"),
        "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", (F.length(text) - F.length(without(text, ["!!"]))).alias("_emphasis"), "_w._bars", "_w._stops",
    )
    n = F.col("n_words")
    return held.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbols_per_char"),
        ratio(F.col("_emphasis") / 2, n).alias("emphasis_per_word"),
        ratio(F.col("_bars"), n).alias("bars_per_word"),
        ratio(F.col("_stops"), n).alias("stop_words_per_word"),
        ratio(F.col("word_chars"), n).alias("chars_per_word"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_lines_per_line"),
        ratio(F.col("n_repeat_words"), n).alias("repeats_per_word"),
    )


def verdict(rules=RULES) -> Column:
    """True where every rule of the table holds."""
    bounds = [F.col(r.ratio) >= r.least for r in rules if r.least is not None] + [F.col(r.ratio) <= r.most for r in rules if r.most is not None]
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def quality_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, id_col, text_col).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _stops_sql() -> str:
    return ", ".join(f"'{w}'" for w in STOP_WORDS)


def oracle_sql() -> str:
    bounds = " AND ".join([f"{r.ratio} >= {r.least}" for r in RULES if r.least is not None] + [f"{r.ratio} <= {r.most}" for r in RULES if r.most is not None])
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, [y FOR y IN regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') IF y <> ''] AS w,
                  [y FOR y IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(y, '[^\x20\x09-\x0D]')] AS l FROM documents),
s AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
             (length(x) - length(replace(x, '!!', ''))) / 2 AS e, len([y FOR y IN w IF y = '|']) AS b,
             len([y FOR y IN w IF lower(rtrim(y, '.,;:?!')) IN ({_stops_sql()})]) AS st FROM t LEFT JOIN c USING (doc_id)),
q AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
             CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbols_per_char,
             CASE WHEN n_words > 0 THEN e / n_words ELSE 0.0 END AS emphasis_per_word, CASE WHEN n_words > 0 THEN b / n_words ELSE 0.0 END AS bars_per_word,
             CASE WHEN n_words > 0 THEN st / n_words ELSE 0.0 END AS stop_words_per_word, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS chars_per_word,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_lines_per_line,
             CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeats_per_word FROM m)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {bounds} AS kept FROM q
"""
