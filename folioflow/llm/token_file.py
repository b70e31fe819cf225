"""Token-id files: a context-mixing range coder in independently reset, checksummed blocks.

Format. A dataset is a folder of Parquet files that Spark's committer writes, so that it can live in any store and a
lost executor leaves no half file. A row is a frame: the documents of one run in ascending id order, cut into blocks of
BLOCK ids that know nothing of each other but how often the frame has each id. Frame bytes, little-endian:

    "FTK2", documents u32, blocks u32, bytes of the shares u32, crc32 of the three tables below u32
    documents: ids of each u64           blocks: ids u32, bytes u32, crc32 of the bytes u32
    order 0's share of each id below 2^16, u32 each, compressed by zlib
    the blocks' bytes

Coding of an id. Order 2 and order 1 each predict the id that last followed the last two ids or the last id in this
block, with a confidence of 0 to 7 that hits raise and misses lower, and with it the prediction's share. Order 0 knows how
often the frame has each id (the frame's own table, in shares of 2^18, one at least for each id it has). The three shares
are mixed into one interval of 2^30, of which order 0 keeps an eighth at least, and a 48-bit range coder with carries
narrows its range to the id's part. Many blocks are coded side by side, an element of a numpy array each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"FTK2"
BLOCK = 1024
VOCABULARY = 1 << 16

_TOTAL = 1 << 30
_ORDER0 = 1 << 27  # order 0's least share
_BITS0 = 18  # order 0's shares of ids are parts of 2^18
_LEAST_RANGE = np.int64(1 << 32)
_SLOTS1, _SLOTS2 = 512, 1024
_LANES = 8192  # blocks coded at once: a frame of the usual size
_TOP = 7  # greatest confidence

_SURE = [65535 * c // (2 * c + 3) * 2 for c in range(_TOP + 1)]  # 65536 * c / (c + 1.5): 0 of no prediction
_SHARE2 = np.array([q * ((_TOTAL - _ORDER0) >> 16) for q in _SURE], np.int64)
#: By the confidences of order 2 (times 8) and order 1: the share of both, and what order 0 has for each of its parts.
_SHARE12 = np.array([s + ((_TOTAL - _ORDER0 - s) >> 16) * q for s in _SHARE2.tolist() for q in _SURE], np.int64)
_UNIT0 = (_TOTAL - _SHARE12) >> _BITS0


class _Model:
    """Predictors of `lanes` blocks at once. Arrays of two rows hold order 1 and order 2; entries: id * 8 + confidence."""

    def __init__(self, lanes: int):
        at = np.arange(lanes, dtype=np.int32)
        self.lanes = lanes
        self.held = np.zeros(lanes * (_SLOTS1 + _SLOTS2), np.int32)
        self.at = np.stack([at * _SLOTS1, lanes * _SLOTS1 + at * _SLOTS2])
        self.last, self.mixed = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.slot = np.zeros((2, lanes), np.intp)

    def predict(self) -> None:
        """Sets the slots, the predicted ids and their shares of 2^30; the rest is order 0's."""
        now = self.last * np.int32(40503)
        np.add(self.at[0], (now >> 4) & (_SLOTS1 - 1), out=self.slot[0])
        np.add(self.at[1], (now + self.mixed >> 5) & (_SLOTS2 - 1), out=self.slot[1])
        self.mixed = self.last * np.int32(60493)
        self.entry = self.held.take(self.slot)
        self.ids, self.conf = self.entry >> 3, self.entry & 7
        self.both = (self.conf[1] << 3) + self.conf[0]
        self.share2, self.share12 = _SHARE2.take(self.conf[1]), _SHARE12.take(self.both)

    def update(self, ids: np.ndarray) -> None:
        """Learns the ids coded in this step."""
        missed = np.where(self.conf > 2, self.entry - 2, (ids << 3) + 1)
        self.held[self.slot] = np.where(self.ids == ids, self.entry + (self.conf < _TOP), missed)
        self.last = ids

    def keep(self, n: int) -> None:
        """Goes on with the first n lanes."""
        for name in ("at", "last", "mixed", "slot"):
            setattr(self, name, getattr(self, name)[..., :n])
        self.slot = self.slot.copy()
        self.lanes = n


def _shares(ids: np.ndarray) -> np.ndarray:
    """Order 0's share of each id of the vocabulary, 2^18 in all; 0 for ids that do not occur."""
    counts = np.zeros(VOCABULARY, np.int64)
    for i in range(0, len(ids), 1 << 20):
        counts += np.bincount(ids[i : i + (1 << 20)], minlength=VOCABULARY)
    used = int((counts > 0).sum())
    if used:
        counts = (counts > 0) + counts * ((1 << _BITS0) - used) // len(ids)
        counts[np.argmax(counts)] += (1 << _BITS0) - counts.sum()
    return counts.astype(np.int32)


def _lengths(n_ids: int) -> np.ndarray:
    """Ids of each block, the last one shorter; block k is lane k."""
    full, rest = divmod(n_ids, BLOCK)
    return np.array([BLOCK] * full + [rest] * (rest > 0), np.int64)


def _sets(lanes: int) -> list[tuple[int, int]]:
    """Sets of at most _LANES lanes, of equal sizes, as the steps cost much where a set is small."""
    n = -(-lanes // _LANES)
    return [(lanes * k // n, lanes * (k + 1) // n) for k in range(n)]


def _turned(rows: np.ndarray) -> np.ndarray:
    """A transposed copy, in strips that stay in the processor's cache."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for i in range(0, len(rows), 64):
        out[:, i : i + 64] = rows[i : i + 64].T
    return out


def encode_blocks(ids: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Ids of each block, and each block's bytes; shares: order 0's."""
    lengths, blocks, first = _lengths(len(ids)), [], (np.cumsum(shares) - shares).astype(np.int32)
    for i, j in _sets(len(lengths)):
        blocks += _encode(lengths[i:j], ids[i * BLOCK : j * BLOCK], first, shares)
    return lengths, blocks


def _encode(lengths: np.ndarray, ids: np.ndarray, first: np.ndarray, shares: np.ndarray) -> list[bytes]:
    lanes = len(lengths)
    grid = np.zeros((BLOCK, lanes), np.uint16)
    full, rest = divmod(len(ids), BLOCK)
    grid[:, :full] = _turned(ids[: full * BLOCK].astype(np.uint16).reshape(full, BLOCK))
    grid[:rest, full:] = ids[full * BLOCK :, None]
    model = _Model(lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
    digits = np.zeros((2 * BLOCK + 4, lanes), np.uint32)
    flat, put = digits.reshape(-1), np.arange(lanes, dtype=np.int64)  # the next digit's place, lanes apart
    last_low, last_put = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for step in range(int(lengths[0])):
        if step == lengths[-1] and lanes > 1 and model.lanes == lanes:  # the last block has ended
            last_low[-1], last_put[-1] = low[-1], put[-1]
            model.keep(lanes - 1)
            low, rng, put = low[:-1], rng[:-1], put[:-1]
        now = grid[step, : model.lanes].astype(np.int32)
        model.predict()
        right = (model.ids == now) & (model.conf > 0)
        is2 = right[1]
        start = np.where(is2, 0, model.share2)
        width = np.where(is2, model.share2, model.share12 - model.share2)
        by0 = np.flatnonzero(~(right[0] | is2))
        want, unit = now.take(by0), _UNIT0.take(model.both.take(by0))
        start[by0] = model.share12.take(by0) + first.take(want) * unit
        width[by0] = shares.take(want) * unit
        part = rng >> 30
        low = low + start * part
        rng = width * part
        small = np.flatnonzero(rng < _LEAST_RANGE)
        while len(small):  # twice at most
            at, lows, ranges = put.take(small), low.take(small), rng.take(small) << 16
            flat[at] = lows >> 32
            put[small] = at + lanes
            low[small] = (lows & 0xFFFFFFFF) << 16
            rng[small] = ranges
            small = small[ranges < _LEAST_RANGE]
        model.update(now)
    last_low[: len(low)], last_put[: len(put)] = low, put
    # one more digit names a point inside the last range; then carries go up
    flat[last_put] = (last_low + 0xFFFFFFFF) >> 32
    used = (last_put // lanes) + 1
    for k in range(int(used.max()) - 1, 0, -1):
        digits[k - 1] += digits[k] >> 16
        digits[k] &= 0xFFFF
    rows = _turned(digits[: int(used.max())].astype("<u2"))
    return [rows[k, :n].tobytes() for k, n in enumerate(used.tolist())]


def decode_blocks(lengths: np.ndarray, blocks: list[bytes], shares: np.ndarray) -> np.ndarray:
    """The ids of blocks in order; lengths must not rise, as encode_blocks gives them."""
    ids, done, first = np.zeros(int(lengths.sum()), np.int32), 0, (np.cumsum(shares) - shares).astype(np.int32)
    id_at = np.repeat(np.arange(VOCABULARY, dtype=np.uint16), shares)  # the id of each part of order 0
    for i, j in _sets(len(lengths)):
        n = int(lengths[i:j].sum())
        ids[done : done + n] = _decode(lengths[i:j], blocks[i:j], first, shares, id_at)
        done += n
    return ids


def _decode(lengths: np.ndarray, blocks: list[bytes], first: np.ndarray, shares: np.ndarray, id_at: np.ndarray) -> np.ndarray:
    lanes = len(lengths)
    deep = max(len(b) // 2 for b in blocks) + 5
    digits = np.zeros((lanes, deep), np.uint16)
    for k, b in enumerate(blocks):
        digits[k, : len(b) // 2] = np.frombuffer(b, "<u2")
    flat = _turned(digits).reshape(-1)
    del digits
    head = flat[: 3 * lanes].astype(np.int64).reshape(3, lanes)
    value = (head[0] << 32) + (head[1] << 16) + head[2]
    get = np.arange(lanes, dtype=np.int64) + 3 * lanes
    rng = np.full(lanes, (1 << 48) - 1, np.int64)
    grid = np.zeros((BLOCK, lanes), np.uint16)
    model = _Model(lanes)
    for step in range(int(lengths[0])):
        if step == lengths[-1] and lanes > 1 and model.lanes == lanes:
            model.keep(lanes - 1)
            value, rng, get = value[:-1], rng[:-1], get[:-1]
        model.predict()
        part = rng >> 30
        to2, to12 = model.share2 * part, model.share12 * part
        is2 = value < to2
        start, width = np.where(is2, 0, to2), np.where(is2, to2, to12 - to2)
        now = np.where(is2, model.ids[1], model.ids[0])
        by0 = np.flatnonzero(value >= to12)
        unit, base = _UNIT0.take(model.both.take(by0)) * part.take(by0), to12.take(by0)
        found = id_at.take(np.minimum((value.take(by0) - base) // unit, (1 << _BITS0) - 1))
        now[by0] = found
        start[by0] = base + first.take(found) * unit
        width[by0] = shares.take(found) * unit
        value = value - start
        rng = width
        small = np.flatnonzero(rng < _LEAST_RANGE)
        while len(small):
            at, ranges = get.take(small), rng.take(small) << 16
            value[small] = (value.take(small) << 16) + flat.take(at)
            get[small] = at + lanes
            rng[small] = ranges
            small = small[ranges < _LEAST_RANGE]
        model.update(now)
        grid[step, : model.lanes] = now
    del model, flat
    return _turned(grid).reshape(-1)[: int(lengths.sum())]


def write_frame(counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A frame of documents with so many ids each."""
    if len(ids) and int(ids.max()) >= VOCABULARY:
        raise ValueError(f"ids must be below {VOCABULARY}")
    shares = _shares(ids)
    lengths, blocks = encode_blocks(ids, shares)
    heads = np.array([[n, len(b), zlib.crc32(b)] for n, b in zip(lengths.tolist(), blocks, strict=True)], "<u4")
    packed = zlib.compress(shares.astype("<u4").tobytes(), 1)
    tables = counts.astype("<u8").tobytes() + heads.tobytes() + packed
    return b"".join([MAGIC, struct.pack("<IIII", len(counts), len(blocks), len(packed), zlib.crc32(tables)), tables, *blocks])


def read_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each document, and all ids; raises ValueError where a checksum does not hold."""
    n_docs, n_blocks, n_packed, crc = struct.unpack_from("<IIII", frame, 4)
    plain = 8 * n_docs + 12 * n_blocks
    tables = frame[20 : 20 + plain + n_packed]
    if frame[:4] != MAGIC or zlib.crc32(tables) != crc:
        raise ValueError("not a frame, or its tables are damaged")
    counts = np.frombuffer(tables, "<u8", n_docs).astype(np.int64)
    heads = np.frombuffer(tables, "<u4", 3 * n_blocks, offset=8 * n_docs).reshape(-1, 3).astype(np.int64)
    shares = np.frombuffer(zlib.decompress(tables[plain:]), "<u4").astype(np.int32)
    at, blocks = 20 + len(tables), []
    for k, (_, size, check) in enumerate(heads.tolist()):
        blocks.append(frame[at : at + size])
        at += size
        if zlib.crc32(blocks[-1]) != check:
            raise ValueError(f"block {k} is damaged")
    return counts, decode_blocks(heads[:, 0], blocks, shares)
