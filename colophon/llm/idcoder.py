"""Binary token files: an adaptive context-mixing range coder over ids, in independent blocks.

An id is predicted at three orders: order 2 and order 1 remember the id that last followed the last
two ids and the last id, with a count of how often they were right; order 0 counts all ids.  The
three are mixed by weights that adapt with the hits of each count: the part of an id is the sum of
what the orders give it, and these parts drive a range coder.

A block is cut into ``lanes`` runs of consecutive ids, one id longer or shorter, that move together
and share one model; the model starts anew with each block.  All of it is whole-number arithmetic:
what needs more than 32 bits is held in doubles, which are exact below 2^53.  A block is
``magic, version, alphabet, ids, lanes, crc32 of the ids, words of each lane, lanes``; a word has 24 bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMRC"
VERSION = 3
HEAD = struct.Struct("<4sBxHIII")
TOTAL_BITS = 24
TOTAL = 1 << TOTAL_BITS
#: the least share left to order 0, in parts of the whole
ORDER0 = TOTAL >> 3
#: order 0 counts are scaled to this sum
SUM_BITS = 21
#: bits of a part of order 0 that the decoder's table of first ids leaves out
FINE_BITS = 4
STEP = 24
LEVELS = 8
HASH_BITS = 18
#: steps between two refreshes of counts and weights; the first come after 1, 2, 4, 8 and 16 steps
REFRESH = 32
#: a guess and its count share a number, the count in its last bits
LEVEL_BITS = LEVELS.bit_length() - 1
#: the change of a count after a miss or a hit, at 2 * count + hit
CHANGE = np.array([n - level for level in range(LEVELS) for n in (max(level - 1, 0), min(level + 1, LEVELS - 1))], np.int32)
#: odd factors of the last id but one and of the last id in the place of order 2, as signed 32-bit numbers
FACTORS = np.array([0x9E3779B1, 0x85EBCA77], np.uint32).view(np.int32)
MOST_LANES = 8192
WORD_BITS = 24
WORD = (1 << WORD_BITS) - 1
#: a lane's range begins with two words; one below this takes in the next word
LEAST = 1 << 28


def _at(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Entries at places that are known to lie in the table: no second pass checks them."""
    return table.take(places, mode="clip")


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All bits set where ``a`` is less, else none; a choice by ``&`` costs the same for any mix of both."""
    return (a - b) >> 31


class _Model:
    """What encoder and decoder know alike before each step."""

    def __init__(self, alphabet: int, lanes: int, decodes: bool = True):
        self.alphabet = alphabet
        self.decodes = decodes
        self.counts = np.ones(alphabet, np.int64)
        self.after1 = np.zeros(alphabet, np.int32)
        self.after2 = np.zeros(1 << HASH_BITS, np.int32)
        self.tried = np.full((2, LEVELS), 16, np.int64)
        self.right = np.full((2, LEVELS), 2, np.int64)
        self.last = np.zeros(lanes, np.int32)
        self.before = np.zeros(lanes, np.int32)
        self.steps = 0
        self.pending: list[np.ndarray] = []
        self.states: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self._sum()

    def _sum(self) -> None:
        total = int(self.counts.sum())
        if total > 1 << 24:
            self.counts = (self.counts >> 1) | 1
            total = int(self.counts.sum())
        # each id keeps one part at least, the rest goes by count
        spare = (1 << SUM_BITS) - self.alphabet
        upto = np.arange(self.alphabet + 1) + np.r_[0, np.cumsum(self.counts)] * spare // total
        self.upto = upto.astype(np.int32)
        # as a share of all ids
        self.share = upto / (1 << SUM_BITS)
        if self.decodes:
            self.first = np.cumsum(np.bincount((self.upto + ((1 << FINE_BITS) - 1)) >> FINE_BITS), dtype=np.int32) - 1
        share2 = (TOTAL - ORDER0) * self.right[0] // self.tried[0]
        share1 = (TOTAL - ORDER0 - share2)[:, None] * self.right[1] // self.tried[1]
        # at count of order 2 * LEVELS + count of order 1
        self.share2, self.share1 = np.repeat(share2, LEVELS).astype(np.int32), share1.ravel().astype(np.int32)

    def predict(self) -> None:
        """Candidates of orders 2 and 1 and the parts of the whole that they get."""
        self.place = (self.before * FACTORS[0] + self.last * FACTORS[1]) >> (32 - HASH_BITS) & ((1 << HASH_BITS) - 1)
        self.held2, self.held1 = _at(self.after2, self.place), _at(self.after1, self.last)
        self.guess2, self.guess1 = self.held2 >> LEVEL_BITS, self.held1 >> LEVEL_BITS
        levels = (self.held2 & (LEVELS - 1)) << LEVEL_BITS | self.held1 & (LEVELS - 1)
        self.part2, self.part1 = _at(self.share2, levels), _at(self.share1, levels)
        self.room = (TOTAL - self.part2 - self.part1).astype(np.float64)

    def _order0(self, ids: np.ndarray) -> np.ndarray:
        """Where ids begin in the part of order 0."""
        return (_at(self.share, ids) * self.room).astype(np.int32)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the part of the whole that codes each id: the sum of its parts in all orders."""
        ids = ids.astype(np.int32)
        begin = self._order0(ids)
        width = self._order0(ids + 1) - begin
        width += self.part2 * (self.guess2 == ids)
        width += self.part1 * (self.guess1 == ids)
        begin += _less(self.guess2, ids) & self.part2
        begin += _less(self.guess1, ids) & self.part1
        return begin, width

    def id_at(self, target: np.ndarray) -> np.ndarray:
        """The id whose part holds each target: without the guesses' parts, targets are places in order 0."""
        low, high = np.minimum(self.guess1, self.guess2), np.maximum(self.guess1, self.guess2)
        change = (self.part1 - self.part2) & _less(self.guess1, self.guess2)
        place = target.astype(np.int32)
        # the lower guess first: its part moves the higher one
        for guess, part in ((low, self.part2 + change), (high, self.part1 - change)):
            place = place - np.minimum(np.maximum(place - self._order0(guess), 0), part)
        value = (((place + 1.0) * (1 << SUM_BITS) - 1) / self.room).astype(np.int32)
        found = _at(self.first, value >> FINE_BITS)
        # some are not the id at the beginning of their table entry, most of them the next one
        later = np.flatnonzero(_at(self.upto, found + 1) <= value)
        found[later] += 1
        later = later[_at(self.upto, found.take(later) + 1) <= value.take(later)]
        found[later] = np.searchsorted(self.upto, value.take(later), "right") - 1
        return found

    def learn(self, ids: np.ndarray) -> None:
        ids = ids.astype(np.int32)
        for k, (held, guess, after, at) in enumerate(((self.held2, self.guess2, self.after2, self.place), (self.held1, self.guess1, self.after1, self.last))):
            state = (held & (LEVELS - 1)) * 2 + (guess == ids)
            new = held + _at(CHANGE, state)
            # a guess that was never right gives way
            after[at] = new + (_less(state, 1) & ((ids << LEVEL_BITS) - new))
            self.states[k].append(state)
        self.before, self.last = self.last, ids
        self.pending.append(ids)
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps in (1, 2, 4, 8, 16):
            self.counts += STEP * np.bincount(np.concatenate(self.pending), minlength=self.alphabet)
            for k, states in enumerate(self.states):
                seen = np.bincount(np.concatenate(states), minlength=2 * LEVELS).reshape(LEVELS, 2)
                self.tried[k] += seen.sum(1)
                self.right[k] += seen[:, 1]
                if self.tried[k].max() > 1 << 16:
                    self.tried[k] = (self.tried[k] >> 1) + 2
                    self.right[k] = (self.right[k] >> 1) + 1
                states.clear()
            self.pending = []
            self._sum()

    def narrow(self, n: int) -> None:
        """The last lane has ended: only the first ``n`` go on."""
        self.last, self.before = self.last[:n], self.before[:n]


def lanes_for(n: int) -> int:
    return max(1, min(MOST_LANES, n // 256))


def _moved(runs: np.ndarray, steps: np.ndarray, lanes: int, back: bool = False) -> None:
    """Fills ``steps``, the first id of each lane, the second of each, and so on, from ``runs``, one lane after the other, or back."""
    n, longer = divmod(len(runs), lanes)
    cut = longer * (n + 1)
    long, short, rows = runs[:cut].reshape(longer, n + 1), runs[cut:].reshape(lanes - longer, n), steps[: n * lanes].reshape(n, lanes)
    for own, other in ((long[:, :n].T, rows[:, :longer]), (short.T, rows[:, longer:]), (long[:, n], steps[n * lanes :])):
        if back:
            own[:] = other
        else:
            other[:] = own


def _carried(digits: np.ndarray) -> np.ndarray:
    """Digits of whole numbers as words: what is above a word belongs to the digit before."""
    over = np.flatnonzero(digits > WORD)
    while len(over):
        more = digits[over] >> WORD_BITS
        digits[over] &= WORD
        digits[over - 1] += more
        over = (over - 1)[digits[over - 1] > WORD]
    return digits


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """The coded block of ids below ``alphabet``."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    lanes = lanes_for(n)
    placed = np.empty(n, np.int32)
    _moved(ids, placed, lanes)
    model = _Model(alphabet, lanes, decodes=False)
    # a lane's code is one long number; a sum beyond its digit is carried at the end
    low, size = np.zeros(lanes, np.int64), np.full(lanes, 2.0 ** (2 * WORD_BITS))
    digits, owners = [], []
    for t in range(-(-n // lanes)):
        now = placed[t * lanes : (t + 1) * lanes]
        m = len(now)
        if m < len(model.last):
            model.narrow(m)
        model.predict()
        begin, width = model.interval(now)
        part = np.floor(size[:m] * (1 / TOTAL))
        low[:m] += (part * begin).astype(np.int64)
        size[:m] = part * width
        model.learn(now)
        ready = np.flatnonzero(size[:m] < LEAST)
        lows = low.take(ready)
        digits.append((lows >> WORD_BITS).astype(np.uint32))
        owners.append(ready.astype(np.uint16))
        low[ready] = (lows & WORD) << WORD_BITS
        size[ready] *= WORD + 1
    # one more word lies in the range, whatever comes after it
    digits.append(((low + WORD) >> WORD_BITS).astype(np.uint32))
    owners.append(np.arange(lanes, dtype=np.uint16))
    owner = np.concatenate(owners)
    words = _carried(np.concatenate(digits)[np.argsort(owner, kind="stable")])
    sizes = np.bincount(owner, minlength=lanes).astype("<u4")
    body = words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return HEAD.pack(MAGIC, VERSION, 0, n, lanes, zlib.crc32(ids)) + struct.pack("<I", alphabet) + sizes.tobytes() + body


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is damaged."""
    if len(data) < HEAD.size + 4:
        raise ValueError("block is too short")
    magic, version, _, n, lanes, crc = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or lanes != lanes_for(n):
        raise ValueError("not a block of this format")
    (alphabet,) = struct.unpack_from("<I", data, HEAD.size)
    body = HEAD.size + 4 + 4 * lanes
    if len(data) < body:
        raise ValueError("block is cut or too long")
    sizes = np.frombuffer(data, "<u4", lanes, HEAD.size + 4).astype(np.int64)
    if len(data) != body + 3 * int(sizes.sum()):
        raise ValueError("block is cut or too long")
    # zeros follow the words of each lane
    ends = np.cumsum(sizes + 2)
    at = ends - sizes - 2
    words = np.zeros(int(ends[-1]), "<u4")
    padded = np.zeros((int(sizes.sum()), 4), np.uint8)
    padded[:, :3] = np.frombuffer(data, np.uint8, offset=body).reshape(-1, 3)
    words[np.arange(len(padded)) + np.repeat(2 * np.arange(lanes), sizes)] = padded.view("<u4").ravel()
    size = np.full(lanes, 2.0 ** (2 * WORD_BITS))
    # the code's distance from the beginning of the range
    rest = words.take(at) * float(WORD + 1) + words.take(at + 1)
    at += 2
    model = _Model(alphabet, lanes)
    out = np.zeros(n, np.int32)
    for t in range(-(-n // lanes)):
        m = min(lanes, n - t * lanes)
        if m < len(model.last):
            model.narrow(m)
        model.predict()
        part = np.floor(size[:m] * (1 / TOTAL))
        now = model.id_at(np.minimum(rest[:m] / part, TOTAL - 1))
        out[t * lanes : t * lanes + m] = now
        begin, width = model.interval(now)
        rest[:m] -= part * begin
        size[:m] = part * width
        model.learn(now)
        ready = np.flatnonzero(size[:m] < LEAST)
        where = at.take(ready)
        rest[ready] = np.minimum(rest.take(ready), LEAST - 1) * float(WORD + 1) + _at(words, where)
        at[ready] = where + 1
        size[ready] *= WORD + 1
    placed = np.empty(n, "<u4")
    _moved(placed, out, lanes, back=True)
    if zlib.crc32(placed) != crc:
        raise ValueError("block fails its checksum")
    return placed
