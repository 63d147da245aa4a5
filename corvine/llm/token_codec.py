"""Blocks of token ids under an adaptive context-mixing range coder.

A block is coded on its own: all statistics start afresh, and its header carries a checksum of its bytes and one of the
ids, so a damaged block is told and costs no other. Inside a block the ids are cut into ``lanes`` equal runs.
Each lane has a range coder of its own and all lanes learn in one shared model, so a step codes one id of every lane in
vectorised operations; the decoder takes the same steps and learns the same.

The model mixes three predictions of the next id: order 0, the counts of the ids so far; order 1 and order 2, the id
that last followed the last one or two ids, with a confidence. ``P(x) = w0 * count share of x + w1 [x = p1] + w2 [x = p2]``,
where the weights, in parts of ``WEIGHT``, are how often each prediction was right so far under the two confidences.

Layout, little-endian: magic, number of ids, lanes, distinct ids, bytes of the vocabulary, crc32 of the ids as unsigned
32-bit integers, crc32 of all the rest; then the distinct ids in ascending order as differences in base 128, and 32-bit words
in the order in which a decoder asks for them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"cvT1"
HEADER, SEAL = struct.Struct("<4s5I"), struct.Struct("<I")
#: Ids for each lane, as a rule, and the most lanes: more lanes are faster, and each costs 8 bytes.
LANE_IDS, MOST_LANES = 512, 4096
WEIGHT_BITS, CONTEXT_BITS, CONFIDENCE = 8, 18, 3
WEIGHT = 1 << WEIGHT_BITS
#: What an id adds to its count, against 1 to begin with.
STEP_COUNT = 24
#: Counts and weights are set anew after each of the first steps, then after every so many.
EVERY = 8
_U = np.uint64
_WORD = _U(32)
_LEAST = _U(1 << 32)


class BlockError(ValueError):
    """A block does not hold what its header says."""


def lanes_of(n: int) -> int:
    return max(1, min(MOST_LANES, n // LANE_IDS))


def _grid(ids: np.ndarray, lanes: int) -> tuple[np.ndarray, int]:
    """(steps x lanes, lanes of the last step): each lane is a run of the ids; the first lanes are one longer."""
    steps = -(-len(ids) // lanes)
    full = len(ids) - (steps - 1) * lanes
    out = np.zeros((steps, lanes), np.int64)
    cut = full * steps
    out[:, :full] = ids[:cut].reshape(full, steps).T
    out[: steps - 1, full:] = ids[cut:].reshape(lanes - full, steps - 1).T
    return out, full


def _flat(grid: np.ndarray, full: int) -> np.ndarray:
    return np.concatenate((grid[:, :full].T.ravel(), grid[:-1, full:].T.ravel()))


def _base128(values: np.ndarray) -> bytes:
    """Whole numbers in groups of seven bits, least first; all groups but the last have the high bit."""
    out = np.zeros((len(values), 5), np.uint8)
    rest, size = values.astype(np.uint64), np.ones(len(values), np.int64)
    for k in range(5):
        out[:, k] = rest & _U(127)
        rest = rest >> _U(7)
        more = rest > 0
        out[more, k] |= 128
        size[more] += 1
    return out[np.arange(5) < size[:, None]].tobytes()


def _from_base128(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    parts = (b & 127).astype(np.uint64) << (place * 7).astype(np.uint64)
    return np.add.reduceat(parts, first) if len(b) else np.zeros(0, np.uint64)


def _local(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and every id's place among them."""
    if not len(raw) or raw.max() >= 1 << 20:
        return np.unique(raw, return_inverse=True)
    there = np.zeros(int(raw.max()) + 1, bool)
    there[raw] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1).take(raw)


class _Model:
    """What the ids of a block so far predict; coder and decoder hold equal ones."""

    def __init__(self, size: int, lanes: int):
        self.size = size
        self.bits = max(16, size.bit_length() + 4)
        self.total = 1 << self.bits
        self.counts = np.ones(size, np.int64)
        # an entry is an id and, in its low bits, a confidence; context ``size`` is the start of a lane
        self.one = np.zeros(size + 1, np.int64)
        self.two = np.zeros(1 << CONTEXT_BITS, np.int64)
        kinds = (CONFIDENCE + 1) ** 2 * 2
        self.right = np.full((kinds, 3), (8, 1, 1), np.int64)
        self.before = np.full(lanes, size, np.int64)
        self.last = np.full(lanes, size, np.int64)
        self.seen: list[np.ndarray] = []
        self.told: list[np.ndarray] = []
        self.at = 0
        self.refresh()

    def refresh(self) -> None:
        """Counts and weights as tables; shares are whole numbers that add up to ``total``, none below 1."""
        if self.seen:
            self.counts += STEP_COUNT * np.bincount(np.concatenate(self.seen), minlength=self.size)
            self.right += np.bincount(np.concatenate(self.told), minlength=self.right.size).reshape(self.right.shape)
            self.seen, self.told = [], []
        share = 1 + self.counts * (self.total - self.size) // self.counts.sum()
        share[self.counts.argmax()] += self.total - share.sum()
        self.share = share.astype(np.uint64)
        self.start = (np.cumsum(share) - share).astype(np.uint64)
        whole = self.right.sum(1)
        self.w1 = ((WEIGHT - 2) * self.right[:, 1] // whole).astype(np.uint64)
        self.w2 = ((WEIGHT - 2) * self.right[:, 2] // whole).astype(np.uint64)
        self.w0 = _U(WEIGHT) - self.w1 - self.w2
        self.places: np.ndarray | None = None

    def id_at(self, place: np.ndarray) -> np.ndarray:
        if self.places is None:
            self.places = np.repeat(np.arange(self.size), self.share.astype(np.int64))
        return self.places.take(place)

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """For the first n lanes: both predicted ids, and the weights w0, w1, w2 (w1 and w2 times ``total``)."""
        self.key2 = (self.before[:n] * 40503 + self.last[:n] * 2654435) & ((1 << CONTEXT_BITS) - 1)
        self.e1, self.e2 = self.one.take(self.last[:n]), self.two.take(self.key2)
        self.p1, self.p2 = self.e1 >> 2, self.e2 >> 2
        self.kind = ((self.e2 & 3) << 3) | ((self.e1 & 3) << 1) | (self.p1 == self.p2)
        shift = _U(self.bits)
        return self.p1, self.p2, self.w0.take(self.kind), self.w1.take(self.kind) << shift, self.w2.take(self.kind) << shift

    def learn(self, x: np.ndarray) -> None:
        n = len(x)
        hit1, hit2 = self.p1 == x, self.p2 == x
        # where both predict it, order 2 is credited
        self.told.append(self.kind * 3 + np.where(hit2, 2, hit1))
        self.seen.append(x)
        new = x << 2
        self.one[self.last[:n]] = np.where(hit1, self.e1 + ((self.e1 & 3) < CONFIDENCE), np.where((self.e1 & 3) > 0, self.e1 - 1, new))
        self.two[self.key2] = np.where(hit2, self.e2 + ((self.e2 & 3) < CONFIDENCE), new)
        self.before, self.last = self.last, x
        self.at += 1
        if self.at <= EVERY or self.at % EVERY == 0:
            self.refresh()


def encode_block(ids: np.ndarray) -> bytes:
    """Ids below 2^32, in one block of bytes."""
    raw = ids.astype("<u4")
    vocabulary, local = _local(raw)
    head = _base128(np.diff(vocabulary.astype(np.int64), prepend=0))
    lanes = lanes_of(len(ids)) if len(ids) else 0
    if not lanes:
        return _sealed(HEADER.pack(MAGIC, 0, 0, 0, 0, zlib.crc32(b"")), b"")
    grid, full = _grid(local, lanes)
    model = _Model(len(vocabulary), lanes)
    shift = _U(model.bits + WEIGHT_BITS)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    owners, words, carries = [], [], []  # of each step: lanes that give a word, these words, lanes whose words so far get 1 more
    for t, x in enumerate(grid):
        n = lanes if t < len(grid) - 1 else full
        x = x[:n]
        p1, p2, w0, w1, w2 = model.predict(n)
        start = w0 * model.start.take(x) + (p1 < x) * w1 + (p2 < x) * w2
        share = w0 * model.share.take(x) + (p1 == x) * w1 + (p2 == x) * w2
        unit = rng[:n] >> shift
        start *= unit
        start += low[:n]
        carries.append(np.flatnonzero(start < low[:n]))
        unit *= share
        out = np.flatnonzero(unit < _LEAST)
        gone = start[out]
        words.append(gone >> _WORD)
        owners.append(out)
        start[out] = gone << _WORD
        unit[out] <<= _WORD
        low[:n], rng[:n] = start, unit
        model.learn(x)
    # one more word ends a lane: the least multiple of 2^32 that is not below low
    last = (low + (_LEAST - _U(1))) >> _WORD << _WORD
    carries.append(np.flatnonzero(last < low))
    words.append(last >> _WORD)
    owners.append(np.arange(lanes))
    body = head + _interleaved(owners, words, carries, lanes).astype("<u4").tobytes()
    return _sealed(HEADER.pack(MAGIC, len(ids), lanes, len(vocabulary), len(head), zlib.crc32(raw)), body)


def _sealed(header: bytes, body: bytes) -> bytes:
    return header + SEAL.pack(zlib.crc32(body, zlib.crc32(header))) + body


def _interleaved(owners: list[np.ndarray], words: list[np.ndarray], carries: list[np.ndarray], lanes: int) -> np.ndarray:
    """The words in the order in which a decoder asks for them: the first two of every lane, then, wherever a lane
    has given a word, the one that comes two after it."""
    owner, word = np.concatenate(owners), np.concatenate(words)
    by_lane = np.argsort(owner.astype(np.int16), kind="stable")
    first = np.searchsorted(owner[by_lane], np.arange(lanes + 1))
    lane_words = word[by_lane]
    # a carry at some step adds 1 to the number that the lane's words before that step are
    steps = np.repeat(np.arange(len(owners)), [len(x) for x in owners])
    rank, over = np.empty(len(owner), np.int64), np.concatenate(carries)
    rank[by_lane] = np.arange(len(owner))
    when = np.repeat(np.arange(len(carries)), [len(x) for x in carries])
    width = np.int64(len(owners) + 1)
    at = np.searchsorted(owner[by_lane] * width + steps[by_lane], over * width + when) - 1
    while len(at):
        np.add.at(lane_words, at, _U(1))
        at = np.flatnonzero(lane_words > _U(0xFFFFFFFF))
        lane_words[at] &= _U(0xFFFFFFFF)
        at -= 1
    padded = np.concatenate((lane_words, np.zeros(2, np.uint64)))
    ends = first[1:]
    start = np.concatenate((padded[first[:-1]], np.where(first[:-1] + 1 < ends, padded[first[:-1] + 1], _U(0))))
    given = rank[: len(owner) - lanes]  # all but the last words
    return np.concatenate((start, np.where(given + 2 < ends[owner[: len(given)]], padded[given + 2], _U(0))))


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; :class:`BlockError` if a checksum or a size does not fit."""
    if len(data) < HEADER.size + SEAL.size:
        raise BlockError("a block is shorter than its header")
    magic, n_ids, lanes, size, head, crc_ids = HEADER.unpack_from(data)
    body = memoryview(data)[HEADER.size + SEAL.size :]
    if magic != MAGIC or SEAL.unpack_from(data, HEADER.size)[0] != zlib.crc32(body, zlib.crc32(data[: HEADER.size])):
        raise BlockError("a block is damaged")
    if not n_ids:
        return np.zeros(0, "<u4")
    vocabulary = np.cumsum(_from_base128(bytes(body[:head])).astype(np.int64)).astype("<u4")
    stream = np.frombuffer(body, "<u4", -1, head).astype(np.uint64)
    if len(vocabulary) != size or len(stream) < 2 * lanes:
        raise BlockError("a block's parts do not have the sizes of its header")
    code, at = (stream[:lanes] << _WORD) | stream[lanes : 2 * lanes], 2 * lanes
    model, steps = _Model(size, lanes), -(-n_ids // lanes)
    full = n_ids - (steps - 1) * lanes
    grid = np.zeros((steps, lanes), np.int64)
    shift, rng = _U(model.bits + WEIGHT_BITS), np.full(lanes, 2**64 - 1, np.uint64)
    top = _U((1 << (model.bits + WEIGHT_BITS)) - 1)
    for t in range(steps):
        n = lanes if t < steps - 1 else full
        p1, p2, w0, w1, w2 = model.predict(n)
        unit = rng[:n] >> shift
        value = np.minimum(code[:n] // unit, top)
        # what the two predicted ids' own masses lie at; where both are one id, its mass is the sum
        s1 = w0 * model.start.take(p1) + (p2 < p1) * w2
        s2 = w0 * model.start.take(p2) + (p1 < p2) * w1
        same = p1 == p2
        f1 = w0 * model.share.take(p1) + w1 + same * w2
        f2 = w0 * model.share.take(p2) + w2 + same * w1
        hit1, hit2 = value - s1 < f1, value - s2 < f2
        rest = value - (value >= s1 + f1) * w1 - (value >= s2 + f2) * w2
        x = np.where(hit2, p2, np.where(hit1, p1, model.id_at(np.minimum(rest // w0, _U(model.total - 1)).astype(np.int64))))
        start = w0 * model.start.take(x) + (p1 < x) * w1 + (p2 < x) * w2
        share = w0 * model.share.take(x) + (p1 == x) * w1 + (p2 == x) * w2
        left = code[:n] - unit * start
        unit *= share
        more = np.flatnonzero(unit < _LEAST)
        left[more] = (left[more] << _WORD) | stream[at : at + len(more)]
        at += len(more)
        unit[more] <<= _WORD
        code[:n], rng[:n] = left, unit
        grid[t, :n] = x
        model.learn(x)
    ids = vocabulary.take(_flat(grid, full))
    if zlib.crc32(ids) != crc_ids:
        raise BlockError("a block does not decode to the ids it was made of")
    return ids
