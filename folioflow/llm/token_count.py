"""Token counts under a unigram vocabulary, without building the tokens.

The tokenizer: white space separates words, each word gets the mark U+2581 in front, and a word becomes the sequence of
vocabulary pieces with the greatest sum of scores. One Aho-Corasick automaton enumerates all pieces in a word; for
each end the dynamic programme keeps the best sum and its number of pieces, nothing else. Ties follow the tokenizer:
of equal sums the one whose last piece starts first stays; a character that no piece of its own length covers may be
unknown, at the least score minus 10, and unknowns in a row are one piece. Scores and additions are the tokenizer's own,
so that the counts equal those of the tokenizers library's Unigram model over the same table.

No public unigram vocabulary is at hand: pieces and scores are those of a public sentencepiece file, taken as they are.

Defined cases: null, empty and blank texts have no words and no tokens; very long texts and words are counted whole;
repeated rows are counted one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000
#: White space of Unicode; Python's own split also takes \x1c-\x1f.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece file."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: held.is_control(i) or held.is_unknown(i) or held.is_byte(i) or held.is_unused(i)
    return [(held.id_to_piece(i), held.get_score(i)) for i in range(held.get_piece_size()) if not special(i)]


class Counter(dict):
    """Word to (pieces, unknown pieces); counts what it does not hold."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def count(self, word: str) -> tuple[int, int]:
        word = MARK + word
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)  # longest first
        best, pieces, unknowns, last_unknown = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            start, top, is_unknown = -1, 0.0, False
            single = False
            for length, score in ends[end]:
                s = end + 1 - length
                sum_ = score + best[s]
                if start < 0 or sum_ > top:
                    start, top = s, sum_
                single = single or length == 1
            if not single:
                sum_ = self.unknown + best[end]
                if start < 0 or sum_ > top:
                    start, top, is_unknown = end, sum_, True
            best[end + 1] = top
            fused = is_unknown and last_unknown[start]
            pieces[end + 1] = pieces[start] + (not fused)
            unknowns[end + 1] = unknowns[start] + (is_unknown and not fused)
            last_unknown[end + 1] = is_unknown
        return pieces[n], unknowns[n]

    def __missing__(self, word: str) -> tuple[int, int]:
        found = self.count(word)
        if len(self) < REMEMBERED and len(word) <= 64:
            self[word] = found
        return found


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(source):
        counter = kept(path, lambda: Counter(vocabulary(path)))
        for batch in source:
            words, tokens, unknown = [], [], []
            for text in batch.column("text"):
                found = words_of(text.as_py())
                counts = list(map(counter.__getitem__, found))
                words.append(len(found))
                tokens.append(sum(c for c, _ in counts))
                unknown.append(sum(u for _, u in counts))
            columns = [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_tokens long, n_unknown long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
