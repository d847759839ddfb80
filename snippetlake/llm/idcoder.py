"""Adaptive context-mixing range coder for token ids.

A stream of ids is cut into blocks of ``BLOCK`` ids. Each block starts from a reset model, carries a
CRC-32 of its ids and can be decoded alone. Inside a block three models predict the next id: the last
successor of the two ids before (order 2), the last successor of the one before (order 1), and the
counts of the block's ids (order 0). How much of the coding interval each gets is learned per pair of
confidences of the two predictions; an order-0 id is coded by its share of the counts, which are taken
over at fixed steps. Blocks are coded side by side, one numpy lane each.

Block: ``HEAD`` (magic, ids, distinct ids, large gaps, 16-bit words, CRC-32), the distinct ids as
gaps (one byte, 255 for a gap in the list of large ones), then the words of the coder.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
#: Blocks coded side by side; bounds the memory of a worker.
LANES = 2560
HEAD = struct.Struct("<4sIIIII")
MAGIC = b"CMR1"
#: Weight of one occurrence in the order-0 counts, and the steps at which the counts are taken over.
GAIN = 24
STEPS = frozenset([16, 32, 64, 128, 256, *range(512, BLOCK, 512)])
ONE, LOW32, TOP = np.uint64(1), np.uint64(0xFFFFFFFF), np.uint64(1 << 48)
SHIFT, HIGH, FLOOR = np.uint64(16), np.uint64(48), np.uint64(1 << 32)


class Model:
    """State of all lanes. Tables are flat, with one stretch per lane."""

    def __init__(self, sizes: np.ndarray):
        n, self.sizes, self.width = len(sizes), sizes.astype(np.int64), int(sizes.max())
        lanes = np.arange(n, dtype=np.int64)
        self.at1, self.at2, self.at0, self.atc = lanes * (self.width + 1), lanes * BLOCK, lanes * (self.width + 1), lanes * 48
        self.order1, self.order2 = np.zeros(n * (self.width + 1), np.int32), np.zeros(n * BLOCK, np.int32)
        start = np.zeros((4, 4, 3), np.int32)  # by confidence of order 2 and 1: shares of order 2, 1, 0
        for c2 in range(4):
            for c1 in range(4):
                start[c2, c1] = (0, 1, 3, 8)[c2], (0, 1, 2, 6)[c1], 6
        self.shares = np.tile(start.ravel().astype(np.int32), n)
        self.counts = (np.arange(self.width) < self.sizes[:, None]).astype(np.int64)
        self.prev1 = self.prev2 = np.full(n, -1, np.int64)  # no id yet; the same in any company
        self.take_over()

    def take_over(self) -> None:
        cum = np.zeros((len(self.sizes), self.width + 1), np.int64)
        np.cumsum(self.counts, axis=1, out=cum[:, 1:])
        self.total0, self.cum = cum[:, -1].astype(np.uint64), cum.ravel()

    def learn0(self, seen: np.ndarray) -> None:
        """``seen``: ids of all lanes since the last time."""
        at = (np.arange(len(self.sizes))[:, None] * self.width + seen).ravel()
        self.counts += GAIN * np.bincount(at, minlength=self.counts.size).reshape(self.counts.shape)
        self.take_over()

    def predict(self) -> tuple[np.ndarray, ...]:
        self.slot2 = self.at2 + (((self.prev2 + 1) * 2654435 + (self.prev1 + 1) * 40503) & (BLOCK - 1))
        self.slot1 = self.at1 + self.prev1 + 1
        self.e2, self.e1 = self.order2[self.slot2], self.order1[self.slot1]
        self.c2, self.c1 = self.e2 & 3, self.e1 & 3
        self.slotc = self.atc + (self.c2 * 4 + self.c1) * 3
        n2, n1, n0 = self.shares[self.slotc], self.shares[self.slotc + 1], self.shares[self.slotc + 2]
        return n2, n1, n0

    def learn(self, ids: np.ndarray, by: np.ndarray) -> None:
        self.shares[self.slotc + by] += 2
        for slot, e, c, table in ((self.slot2, self.e2, self.c2, self.order2), (self.slot1, self.e1, self.c1, self.order1)):
            kept = np.where(e >> 2 == ids, e + (c < 3), np.where(c > 1, e - 1, (ids << 2) | 1))
            table[slot] = kept
        self.prev2, self.prev1 = self.prev1, ids


def _squeeze(low: np.ndarray, span: np.ndarray):
    """Yield the lanes that move on by one word, as an index, until none has to."""
    while True:
        same = (low ^ (low + span)) < TOP
        need = np.flatnonzero(same | (span < FLOOR))
        if not len(need):
            return
        cut = need[~same[need]]
        span[cut] = (~low[cut] + ONE) & LOW32
        yield need
        low[need] <<= SHIFT
        span[need] <<= SHIFT


def _distinct(ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct ids of each row, and the rows in ranks of them."""
    order = np.sort(ids, axis=1, kind="stable")
    first = np.ones(ids.shape, bool)
    first[:, 1:] = order[:, 1:] != order[:, :-1]
    names, ranks, rank = [], np.empty(ids.shape, np.int32), np.zeros(1 << 16, np.int32)
    for i, row in enumerate(ids):
        name = order[i][first[i]]
        rank[name] = np.arange(len(name))
        names.append(name)
        ranks[i] = rank[row]
    return names, ranks


def encode(ids: np.ndarray) -> list[bytes]:
    """Blocks of a flat uint16 array, the last one possibly shorter."""
    out = []
    for a in range(0, len(ids), BLOCK * LANES):
        out += _encode_lanes(ids[a : a + BLOCK * LANES])
    return out


def _encode_lanes(ids: np.ndarray) -> list[bytes]:
    n = -(-len(ids) // BLOCK)
    rows = np.pad(ids, (0, n * BLOCK - len(ids)), mode="edge").reshape(n, BLOCK)
    names, ranks = _distinct(rows)
    columns = np.ascontiguousarray(ranks.T)
    model = Model(np.array([len(x) for x in names]))
    low, span = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
    words, used = np.zeros((n, BLOCK * 2 + 8), np.uint16), np.zeros(n, np.int64)
    last = 0
    for t in range(BLOCK):
        if t in STEPS:
            model.learn0(ranks[:, last:t])
            last = t
        x = columns[t]
        n2, n1, n0 = model.predict()
        hit2 = (model.e2 >> 2 == x) & (model.c2 > 0)
        hit1 = (model.e1 >> 2 == x) & (model.c1 > 0) & ~hit2
        by = 2 - hit1 - 2 * hit2
        unit = span // (n2 + n1 + n0).astype(np.uint64)
        below = np.where(hit2, 0, np.where(hit1, n2, n2 + n1))
        low += unit * below.astype(np.uint64)
        span = unit * np.where(hit2, n2, np.where(hit1, n1, n0)).astype(np.uint64)
        miss = np.flatnonzero(by == 2)
        at = model.at0[miss] + x[miss]
        cum = model.cum[at]
        unit = span[miss] // model.total0[miss]
        low[miss] += unit * cum.astype(np.uint64)
        span[miss] = unit * (model.cum[at + 1] - cum).astype(np.uint64)
        for need in _squeeze(low, span):
            words[need, used[need]] = low[need] >> HIGH
            used[need] += 1
        model.learn(x, by)
    for _ in range(4):
        words[np.arange(n), used] = low >> HIGH
        low <<= SHIFT
        used += 1
    blocks = []
    for i in range(n):
        own = ids[i * BLOCK : (i + 1) * BLOCK]
        gaps = np.diff(names[i], prepend=np.uint16(0))
        large = gaps[gaps >= 255]
        head = HEAD.pack(MAGIC, len(own), len(gaps), len(large), used[i], zlib.crc32(own.astype("<u4").tobytes()))
        blocks.append(head + np.minimum(gaps, 255).astype(np.uint8).tobytes() + large.astype("<u2").tobytes() + words[i, : used[i]].astype("<u2").tobytes())
    return blocks


class _Finder:
    """Which id's share of the counts holds a value: three steps over at most ``FAN`` (or, at the
    top, ``width / FAN**2``) bounds, all lanes at once."""

    FAN = 12

    def __init__(self, model: Model):
        n, f = len(model.sizes), self.FAN
        q = -(-(model.width + 1) // (f * f))
        bounds = np.full((n, q * f * f), np.iinfo(np.int32).max, np.int32)
        bounds[:, : model.width] = model.cum.reshape(n, -1)[:, :-1]
        for i in np.flatnonzero(model.sizes < model.width):
            bounds[i, model.sizes[i] : model.width] = np.iinfo(np.int32).max
        self.low = bounds.reshape(n, q, f, f)
        self.middle, self.top = np.ascontiguousarray(self.low[..., 0]), np.ascontiguousarray(self.low[..., 0, 0])

    def __call__(self, lanes: np.ndarray, v: np.ndarray) -> np.ndarray:
        v = v[:, None]
        a = (self.top[lanes] <= v).sum(1) - 1
        b = (self.middle[lanes, a] <= v).sum(1) - 1
        return (a * self.FAN + b) * self.FAN + (self.low[lanes, a, b] <= v).sum(1) - 1


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """Ids (uint16) of each block; a damaged block raises ValueError."""
    out = []
    for a in range(0, len(blocks), LANES):
        out += _decode_lanes(blocks[a : a + LANES])
    return out


def _decode_lanes(blocks: list[bytes]) -> list[np.ndarray]:
    heads, names, streams = [], [], []
    for b in blocks:
        if len(b) < HEAD.size or b[:4] != MAGIC:
            raise ValueError("not a block")
        _, n_ids, k, n_large, n_words, crc = HEAD.unpack_from(b)
        if len(b) != HEAD.size + k + 2 * n_large + 2 * n_words or n_ids > BLOCK or n_words < 4:
            raise ValueError("damaged block")
        gaps = np.frombuffer(b, np.uint8, k, HEAD.size).astype(np.uint16)
        if (gaps == 255).sum() != n_large or not k:
            raise ValueError("damaged block")
        gaps[gaps == 255] = np.frombuffer(b, "<u2", n_large, HEAD.size + k)
        heads.append((n_ids, crc))
        names.append(np.cumsum(gaps, dtype=np.uint16))
        streams.append(np.frombuffer(b, "<u2", n_words, HEAD.size + k + 2 * n_large))
    n, longest = len(blocks), max(map(len, streams))
    words = np.zeros((n, longest + 8), np.uint64)
    for i, s in enumerate(streams):
        words[i, : len(s)] = s
    model = Model(np.array([len(x) for x in names]))
    code = (words[:, 0] << HIGH) | (words[:, 1] << np.uint64(32)) | (words[:, 2] << SHIFT) | words[:, 3]
    low, span, used = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0)), np.full(n, 4, np.int64)
    ranks = np.zeros((n, BLOCK), np.int32)
    find, last = _Finder(model), 0
    for t in range(BLOCK):
        if t in STEPS:
            model.learn0(ranks[:, last:t])
            find, last = _Finder(model), t
        n2, n1, n0 = model.predict()
        unit = span // (n2 + n1 + n0).astype(np.uint64)
        v = ((code - low) // unit).astype(np.int64)
        hit2 = v < n2
        hit1 = ~hit2 & (v < n2 + n1)
        by = 2 - hit1 - 2 * hit2
        x = np.where(hit2, model.e2 >> 2, model.e1 >> 2)
        below = np.where(hit2, 0, np.where(hit1, n2, n2 + n1))
        low += unit * below.astype(np.uint64)
        span = unit * np.where(hit2, n2, np.where(hit1, n1, n0)).astype(np.uint64)
        miss = np.flatnonzero(by == 2)
        unit = span[miss] // model.total0[miss]
        v = np.minimum((code[miss] - low[miss]) // unit, model.total0[miss] - ONE).astype(np.int64)
        x[miss] = found = find(miss, v)
        at = model.at0[miss] + found
        cum = model.cum[at]
        low[miss] += unit * cum.astype(np.uint64)
        span[miss] = unit * (model.cum[at + 1] - cum).astype(np.uint64)
        for need in _squeeze(low, span):
            code[need] = (code[need] << SHIFT) | words[need, np.minimum(used[need], longest + 7)]
            used[need] += 1
        model.learn(x, by)
        ranks[:, t] = x
    out = []
    for i, (n_ids, crc) in enumerate(heads):
        ids = names[i][np.clip(ranks[i, :n_ids], 0, len(names[i]) - 1)]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block does not fit")
        out.append(ids)
    return out


def _times(a: int, b: int) -> int:
    """Product in GF(2)[x] modulo the CRC-32 polynomial, bits reflected."""
    p = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            p ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return p


_POWERS = [0x00800000]  # x**8, then its squares: one byte, two, four …
while len(_POWERS) < 40:
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))


def crc_before(crc: int, after: int) -> int:
    """What the CRC-32 of a piece adds (by exclusive or) to that of a text that goes on for
    ``after`` bytes."""
    k = 0
    while after:
        if after & 1:
            crc = _times(_POWERS[k], crc)
        after >>= 1
        k += 1
    return crc
