"""Exact encoding of whole texts with a public tokenizer, remembering what pieces of text encode to.

A text is cut only where the tokenizer itself always cuts: before white space that follows another character, and
between a letter and closing punctuation. The byte-level tokenizer keeps a blank in front of a word, the word tokenizer
drops it and ignores case. Texts with white space other than single blanks and line ends take the slower ways below.
The memory is bounded; when it is full, further pieces are encoded anew, which changes no result. Byte-level tokenizers
take many texts at once: Arrow cuts them and finds their distinct pieces, so that a piece is looked up once for all of
them, and new pieces are encoded many in a call.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import kept

#: White space, or what some Unicode version takes for it, other than blank and \n.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Texts that are not cut at each blank and line end, as a regular expression of Arrow: white space in a row is cut before
#: its last character where it ends in a line end or a blank and a word follows.
_NOT_CUT = rf"  | \n|\n\n[ \n]|\n[ \n]$|[{_ODD.pattern[1:-1]}]"
_WITH_SPACE = re.compile("[ \n]*[^ \n]+|[ \n]+")
_CLOSING = ".,!?;:"
REMEMBERED, REMEMBERED_AFTER = 600_000, 1_300_000
TOGETHER = 1_000  # new pieces encoded in one call
AT_ONCE = 16_000_000  # bytes of the texts that are cut at once, a text at least


def _alphabet() -> dict[int, str]:
    """Bytes as the byte-level tokenizers write them: printable ones as they are, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_ALPHABET = _alphabet()
_BLANK = _ALPHABET[32]


class Memory(dict):
    """Piece of text to its ids as little-endian unsigned 32-bit bytes; encodes what it does not hold."""

    def __init__(self, path: str, blanks: bool):
        super().__init__()
        self.blanks = blanks  # blanks and case are encoded
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text

    def whole(self, text: str) -> bytes:
        word = text[1:] if text[0] == " " else text
        if word.isalpha() and (word is text or self.blanks) and (self.blanks or word.islower()):
            # one run of letters is one unit to the merges, and below U+0100 needs no normalising
            if word.isascii():
                written = text if word is text else _BLANK + word
            else:
                written = text.encode().decode("latin-1").translate(_ALPHABET) if max(word) <= "\xff" else None
            if written is not None:
                return array("I", [t.id for t in self.merges.tokenize(written)]).tobytes()
        return self.encode(text)

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(_CLOSING)
        if word and word is not piece and len(word) < len(piece) and word[-1].isalpha():
            found = self[word] + self[piece[len(word) :]]
        elif "\n" in piece and len(parts := _WITH_SPACE.findall(piece)) > 1:
            return b"".join([self[p] for p in parts])
        else:
            found = self.whole(piece)
        if len(self) < REMEMBERED and len(piece) <= 64:
            self[piece] = found
        return found


class Pieces(dict):
    """As Memory, for pieces of texts that are cut at each blank and before each line end.

    A piece that begins with a line end stands for itself, any other for itself with a blank before it.
    """

    def __init__(self, path: str):
        super().__init__()
        self.memory = Memory(path, True)
        self["\n"], self[""] = self.memory.encode("\n"), self.memory.encode(" ")
        vocabulary = self.memory.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for written, number in vocabulary.items():
            self.sizes[number] = len(written)  # a character a byte

    def find(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; new ones are encoded many in one call."""
        found = list(map(self.get, pieces))
        new = [piece for piece, ids in zip(pieces, found, strict=True) if ids is None]
        if not new:
            return found
        learned = [ids for i in range(0, len(new), TOGETHER) for ids in self.together(new[i : i + TOGETHER])]
        if (room := REMEMBERED_AFTER - len(self)) > 0:
            self.update(pair for pair in zip(new[:room], learned, strict=False) if len(pair[0]) <= 64)
        after = iter(learned)
        return [next(after) if ids is None else ids for ids in found]

    def together(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, encoded as one text and told apart by the bytes that each id stands for."""
        text = (" " + " ".join(pieces)).replace(" \n", "\n")
        whole = self.memory.encode(text)
        written = np.frombuffer(text.encode(), np.uint8)
        ends = np.append(np.flatnonzero((written == 32) | (written == 10))[1:], len(written))  # white space begins each piece
        at = np.cumsum(self.sizes.take(np.frombuffer(whole, np.uint32), mode="clip"))
        last = np.searchsorted(at, ends)
        if last[-1] >= len(at) or not np.array_equal(at.take(last), ends):  # a tokenizer that leaves bytes out
            return [self.memory.encode(p if p[0] == "\n" else " " + p) for p in pieces]
        stops = (4 * last + 4).tolist()
        return [whole[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts that are cut at each blank and line end, not empty ones."""
        start, nothing = pa.scalar("\n", texts.type), pa.scalar("", texts.type)
        cut = pc.split_pattern(pc.binary_join_element_wise(start, pc.replace_substring(texts, "\n", " \n"), nothing), " ")
        words = cut.flatten().dictionary_encode()
        found = self.find(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        # the ids of distinct pieces lie in `held`; each piece of a text takes its part of them
        held = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        starts, which = np.cumsum(sizes) - sizes, words.indices.to_numpy()
        n = sizes.take(which)
        ends = np.cumsum(n)
        at = np.repeat((starts.take(which) - ends + n).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        ids = memoryview(held.take(at)).cast("B")
        stops = (4 * ends.take(cut.offsets.to_numpy()[1:] - 1)).tolist()  # a text has a piece at least
        first = len(self["\n"])  # a line end was put before each text
        return [ids[a + first : b].tobytes() for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def encode_all(path: str, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text as bytes, by a tokenizer that encodes white space and case."""
    if len(texts) > 1 and texts.nbytes > AT_ONCE:
        yield from encode_all(path, texts[: len(texts) // 2])
        yield from encode_all(path, texts[len(texts) // 2 :])
        return
    pieces = kept(path, lambda: Pieces(path))
    cut = pc.and_(pc.invert(pc.match_substring_regex(texts, _NOT_CUT)), pc.greater(pc.binary_length(texts), 0)).fill_null(False)
    quick = iter(pieces.encode(texts.filter(cut)) if pc.any(cut).as_py() else [])

    def slow(text: str | None) -> bytes:
        if not text:
            return b""
        return pieces.memory.whole(text) if _ODD.search(text) else b"".join(map(pieces.memory.__getitem__, _WITH_SPACE.findall(text)))

    for c, text in zip(cut.to_pylist(), texts, strict=True):
        yield next(quick) if c else slow(text.as_py())


def encoder(path: str, keeps_space: bool):
    """A function from text to its ids as bytes; keeps_space: the tokenizer encodes white space and case."""
    if keeps_space:
        return lambda text: next(encode_all(path, pa.array([text], pa.string())))
    memory = kept(path, lambda: Memory(path, False))

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return memory.whole(text)
        if text.isascii() or max(text) <= "\xff":
            text = text.lower()  # as the tokenizer does, for these characters
        return b"".join(map(memory.__getitem__, text.split()))

    return encode
