"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks of BLOCK. Every block starts from the same state, so any block decodes alone, and
carries a checksum of its ids. Three models predict the next id. Order 2 and order 1 each remember, under
the last two ids or the last one, which id came next, with a check of the context and a confidence that
grows with each right guess. Order 0 is the distribution of the ids seen in the block so far, brought up
to date at fixed places, beside a fixed prior for ids it has not seen. The models are mixed: an id's
probability is the weighted sum of what the models give it, and the weights, one set for each pair of
confidences, move towards the models that were right.

Blocks are independent, so numpy codes many at once, one lane each, in step. Order 2 and order 1 are two
rows of the same arrays, and an id leaves or takes in all its 16-bit words at once, without a loop.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
LANES = 4096
LARGEST = 65_534  # largest id

SLOTS1, SLOTS2 = 9, 11  # bits of a place in the order-1 and order-2 memories
TAG = 19  # an entry: guess (an id plus 1) in 16 bits, confidence in 3 (0 is free), and from here up a check of the context
CHECK = np.int64(((1 << 12) - 1) << TAG)
SURE = 4  # highest confidence of a guess
RATE, SEEN_RATE = 4, 5  # speed of the weights
UPDATES = (32, 64, 128, *range(256, 1024, 256), *range(1024, BLOCK, 512))  # where order 0 takes in the ids so far
TOP = 60  # bits of the range; it is kept from 2**(TOP - 16) up
ONE = 1 << 16
MOST = ONE - 512  # the two guesses together get at most so much, and LEAST more each
HALF = MOST // 2
LEAST = 64
SORTED_LANES = 128  # lanes that order 0 sorts at a time

#: Cumulative prior over ids in parts of 2**24: vocabularies number their tokens by falling frequency.
_PRIOR_BITS = 24
_weight = 1 / (np.arange(LARGEST + 1) + 200.0)
_parts = np.floor(_weight / _weight.sum() * ((1 << _PRIOR_BITS) - LARGEST - 1)).astype(np.int64) + 1
_parts[0] += (1 << _PRIOR_BITS) - _parts.sum()
PRIOR = np.concatenate([[0], np.cumsum(_parts)])
# The id at every 32nd part: no id has fewer parts, so the one sought is that or the next.
_STEP_BITS = 5
_near = (np.searchsorted(PRIOR, np.arange(0, 1 << _PRIOR_BITS, 1 << _STEP_BITS), side="right") - 1).astype(np.uint16)

# First weights of the order-2 and the order-1 guess for each pair of confidences (order 2, order 1), in the halves of a number.
_state = np.arange((SURE + 1) ** 2)
_right = np.array([0.0, 0.15, 0.45, 0.65, 0.8])
_first2 = _right[_state // (SURE + 1)]
_first1 = _right[_state % (SURE + 1)] * (1 - _first2) * 0.8
WEIGHTS = ((_first2 * MOST).astype(np.int64) + LEAST << 32) + (_first1 * MOST).astype(np.int64) + LEAST

# What stays of the low end when no or some words leave it: a carry goes with the first word.
_KEPT = np.array([(1 << TOP + 1) - 1] + [(1 << TOP) - 1] * 3)
_LANE_BITS = (LANES - 1).bit_length()
# Numbers as arrays, which numpy need not convert at every step.
_N1, _N2, _N3, _N4, _N16, _N32, _N48 = (np.array(x) for x in (1, 2, 3, 4, 16, 32, 48))
_LOW16, _LOW32, _STATES = (np.array(x) for x in (0xFFFF, 0xFFFFFFFF, SURE + 1))
_ENTRY_1, _ENTRY_16, _ENTRY_LOW, _ENTRIES, _GROWN = (np.array(x, np.int32) for x in (1, 16, 0xFFFF, 1 << TAG, SURE - 1))
_ONE, _MOST, _HALF, _LEAST, _FEW, _RATE, _SEEN_RATE = (np.array(x) for x in (ONE, MOST, HALF, LEAST, 512, RATE, SEEN_RATE))
_SLOT_SHIFT, _CHECK_SHIFT, _PRIOR_SHIFT = (np.array(x) for x in (50 - _LANE_BITS, 12, _PRIOR_BITS))
_NARROW = [np.array(1 << TOP - k) for k in (16, 32, 48)]
_SLOT_MASK = np.array([[(1 << SLOTS2) - 1], [(1 << SLOTS1) - 1]]) << _LANE_BITS
_LAST, _BEFORE = np.int64(0x1E3779B97F4A7C15), np.int64(0x42B2AE3D27D4EB4F)  # odd numbers that hash the last id and the one before


class _Model:
    """Predictions of the first ``m`` of ``n`` lanes in step. Rows 0 and 1 of an array are order 2 and order 1."""

    def __init__(self, n: int):
        # One place of all lanes after another: the busy places of neighbours share a cache line.
        self.memory = np.zeros((1 << SLOTS2) + (1 << SLOTS1) << _LANE_BITS, np.int32)
        self.weights = np.tile(WEIGHTS, n)
        self.all_seen = np.full(n, HALF, np.int64)
        self.all_context, self.all_before = np.zeros((2, n), np.int64), np.zeros(n, np.int64)
        self.total = 0  # ids that order 0 knows
        self.use(n)

    def use(self, m: int) -> None:
        """Go on with the first ``m`` lanes only."""
        self.m, self.lane = m, np.arange(m, dtype=np.int64)
        self.base = np.stack([self.lane, self.lane + (1 << SLOTS2 + _LANE_BITS)])
        self.at_weight = self.lane * len(WEIGHTS)
        self.seen, self.before = self.all_seen[:m], self.all_before[:m]
        self.context = np.ascontiguousarray(self.all_context[:, :m])
        self.all_context = self.context
        self.edges = np.zeros((5, m), np.int64)
        self.edges[4] = ONE
        self.p = np.empty((2, m), np.int64)

    def predict(self) -> np.ndarray:
        """The bounds of four branches: order-2 guess, order-1 guess, ids that order 0 knows, all others."""
        self.i = self.context >> _SLOT_SHIFT
        self.i &= _SLOT_MASK
        self.i += self.base
        tag = self.context >> _CHECK_SHIFT
        tag &= CHECK
        self.tag = tag.astype(np.int32)
        entry = self.memory.take(self.i)
        entry ^= self.tag
        entry *= entry < _ENTRIES  # another context's entry is none
        self.sure = entry >> _ENTRY_16
        self.guess = entry & _ENTRY_LOW
        self.k = self.sure[0] * _STATES
        self.k += self.sure[1]
        self.k += self.at_weight
        weight, p, edges = self.weights.take(self.k), self.p, self.edges
        np.right_shift(weight, _N32, out=p[0])
        np.bitwise_and(weight, _LOW32, out=p[1])
        np.add(p[0], p[1], out=edges[2])
        np.multiply(self.guess[0] == self.guess[1], p[1], out=edges[1])  # agreeing guesses add up
        edges[1] += p[0]
        if self.total:
            np.subtract(_ONE, edges[2], out=edges[3])
            edges[3] *= self.seen
            edges[3] >>= _N16
            edges[3] += edges[2]
        else:
            edges[3] = edges[2]
        return edges

    def learn(self, x: np.ndarray, hit: np.ndarray, known: np.ndarray, unknown: np.ndarray) -> None:
        """Move memories and weights towards ids (plus 1) ``x``: ``hit`` says which guesses were right, the others which lanes order 0 or the prior coded."""
        p = self.p
        change = hit * _MOST
        change -= (hit[0] & hit[1]) * _HALF
        change += _LEAST
        change -= p
        change >>= _RATE
        p += change
        self.weights[self.k] = (p[0] << _N32) + p[1]
        if self.total:
            now = self.seen.take(known)
            self.seen[known] = now + (_MOST - now >> _SEEN_RATE)
            now = self.seen.take(unknown)
            self.seen[unknown] = now + (_FEW - now >> _SEEN_RATE)
        entry = np.minimum(self.sure, _GROWN)
        entry *= hit
        entry += _ENTRY_1
        entry <<= _ENTRY_16
        entry += self.tag
        entry += x.astype(np.int32)
        self.memory[self.i] = entry
        last = x * _LAST
        np.add(last, self.before, out=self.context[0])
        self.context[1] = last
        np.multiply(x, _BEFORE, out=self.before)


def _words_due(span: np.ndarray) -> np.ndarray:
    """How many 16-bit words each lane is to move, so that its range is wide again."""
    due = (span < _NARROW[0]).view(np.int8) + (span < _NARROW[1]).view(np.int8)
    due += (span < _NARROW[2]).view(np.int8)
    return due


def _pieces(sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of steps without an update or the end of a lane: first step, step behind, and lanes that still have ids."""
    last = int(sizes.max())
    marks = sorted({0, last, *(u for u in UPDATES if u < last), *sizes.tolist()})
    return [(a, b, int((sizes > a).sum())) for a, b in zip(marks, marks[1:], strict=False)]


def _places(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order 0 for encoding: first slot and number of slots (0: not seen) of every id, a row for each lane."""
    n, length = table.shape
    first, size = np.zeros((length, n), np.uint16), np.zeros((length, n), np.uint16)
    marks = [u for u in UPDATES if u < length] + [length]
    for begin in range(0, n, SORTED_LANES):
        some = table[begin : begin + SORTED_LANES]
        order = np.argsort(some, axis=1, kind="stable")
        ranked = np.take_along_axis(some, order, axis=1)
        edge = np.zeros(some.shape, np.int64)
        edge[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        np.cumsum(edge, axis=1, out=edge)
        distinct = int(edge[:, -1].max()) + 1
        place = np.empty(some.shape, np.int64)
        np.put_along_axis(place, order, edge + np.arange(len(some))[:, None] * distinct, axis=1)
        counts, before = np.zeros(len(some) * distinct, np.int64), 0
        for u, v in zip(marks, marks[1:], strict=False):
            counts += np.bincount(place[:, before:u].ravel(), minlength=len(counts))
            through = np.cumsum(counts.reshape(len(some), distinct), axis=1).ravel()
            at = np.ascontiguousarray(place[:, u:v].T)
            found = counts.take(at)
            size[u:v, begin : begin + len(some)] = found
            first[u:v, begin : begin + len(some)] = through.take(at) - found
            before = u
    return first, size


def _slots(ids: np.ndarray, total: int, table: np.ndarray) -> np.ndarray:
    """Order 0 for decoding: for each slot of each lane, from its first ``total`` ids, the id (plus 1), and from bits 16 and 32 up that id's first slot and number of slots."""
    n = len(ids)
    out = table[: n * total].reshape(n, total)
    for begin in range(0, n, SORTED_LANES):
        known = np.sort(ids[begin : begin + SORTED_LANES, :total], axis=1, kind="stable")
        edge = np.ones(known.shape, bool)
        np.not_equal(known[:, 1:], known[:, :-1], out=edge[:, 1:])
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, known.size))
        run = np.cumsum(edge.ravel(), dtype=np.int64)
        run -= 1
        packed = known.ravel().take(first) + np.int64(1) + (first % total << 16) + (size << 32)
        np.take(packed, run, out=out[begin : begin + SORTED_LANES].reshape(-1), mode="clip")
    return out.reshape(-1)


def _encode_lanes(rows: list[np.ndarray]) -> list[bytes]:
    n = len(rows)
    sizes = np.array([len(r) for r in rows])
    table = np.zeros((n, sizes.max()), np.uint16)
    for i, r in enumerate(rows):
        table[i, : len(r)] = r
    first, size = _places(table)
    ids = np.ascontiguousarray(table.T)
    del table
    model = _Model(n)
    low, span = np.zeros(n, np.int64), np.full(n, 1 << TOP, np.int64)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    ending = np.zeros(n, np.int64)
    for begin, end, m in _pieces(sizes):
        if m < model.m:
            model.use(m)
            low, span = low[:m], span[:m]
        if begin in UPDATES:
            model.total = begin
        lows, dues = np.empty((end - begin, m), np.int64), np.empty((end - begin, m), np.int8)
        for step in range(begin, end):
            x = ids[step, :m] + _N1
            edges = model.predict()
            hit = model.guess == x
            kind = _N3 - (size[step, :m] > 0)
            kind[hit[1]] = 1
            kind[hit[0]] = 0
            known, unknown = (kind == _N2).nonzero()[0], (kind == _N3).nonzero()[0]
            kind *= m
            kind += model.lane
            start = edges.take(kind)
            kind += m
            width = edges.take(kind)
            width -= start
            span >>= _N16
            start *= span
            low += start
            span *= width
            if len(known):
                unit = span.take(known) // model.total
                low[known] += unit * first[step].take(known)
                span[known] = unit * size[step].take(known)
            if len(unknown):
                value = ids[step].take(unknown)
                unit = span.take(unknown) >> _PRIOR_SHIFT
                low[unknown] += unit * PRIOR.take(value)
                span[unknown] = unit * _parts.take(value)
            due = _words_due(span)
            lows[step - begin], dues[step - begin] = low, due
            due = due.astype(np.int64)
            shift = due << _N4
            low <<= shift
            low &= _KEPT.take(due)
            span <<= shift
            model.learn(x, hit, known, unknown)
        lows, dues = np.ascontiguousarray(lows.T), np.ascontiguousarray(dues.T)
        lows, dues = lows.reshape(-1), dues.reshape(-1)
        stop = np.cumsum(dues, dtype=np.int32)
        words = np.empty(int(stop[-1]), np.int32)
        for k in range(3):  # word k of all that move so many
            have = np.flatnonzero(dues > k)
            words[stop.take(have) - dues.take(have) + k] = lows.take(have) >> TOP - 16 * (k + 1) & (0xFFFF if k else 0x1FFFF)
        moved.append((words, np.diff(stop[end - begin - 1 :: end - begin], prepend=0).astype(np.int64)))
        ending[:m] = low + (1 << TOP - 16) - 1 >> TOP - 16  # one word within the range ends a lane
    count = np.ones(n, np.int64)
    for _, c in moved:
        count[: len(c)] += c
    stop = np.cumsum(count)
    at, out = stop - count, np.empty(int(stop[-1]), np.int32)
    for words, c in moved:
        ends = np.cumsum(c)
        out[np.repeat(at[: len(c)] - (ends - c), c) + np.arange(len(words))] = words
        at[: len(c)] += c
    out[at] = ending
    # A word may hold a carry of one beyond its 16 bits: add it to the word before.
    while len(over := np.flatnonzero(out > 0xFFFF)):
        out[over] &= 0xFFFF
        out[over - 1] += 1
    packed, stop = out.astype("<u2").tobytes(), (stop * 2).tolist()
    return [packed[a:b] for a, b in zip([0, *stop], stop, strict=False)]


def _decode_lanes(blocks: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Ids as a row per lane."""
    n = len(blocks)
    width = max(len(b) for b in blocks) // 2 + 6
    words = np.zeros((n, width), np.uint16)
    for i, b in enumerate(blocks):
        words[i, : len(b) // 2] = np.frombuffer(b, "<u2")
    code = np.zeros(n, np.int64)
    for k in range(3):
        code += words[:, k].astype(np.int64) << TOP - 16 * (k + 1)
    code += words[:, 3] >> 64 - TOP
    # The 48 bits that follow when the words up to here have been taken in.
    ahead = np.zeros((n, width), np.int64)
    for begin in range(0, n, SORTED_LANES):
        some, into = words[begin : begin + SORTED_LANES].astype(np.int64), ahead[begin : begin + SORTED_LANES, :-3]
        np.left_shift(some[:, :-3] & (1 << 64 - TOP) - 1, TOP - 16, out=into)
        for k in (1, 2):
            into |= some[:, k : k - 3] << TOP - 16 * (k + 1)
        into |= some[:, 3:] >> 64 - TOP
    del words
    ahead = ahead.reshape(-1)
    used = np.arange(n, dtype=np.int64) * width + 3
    span = np.full(n, 1 << TOP, np.int64)
    model = _Model(n)
    out = np.zeros((n, int(sizes.max())), np.uint16)
    slots = room = np.empty(n * max([u for u in UPDATES if u < out.shape[1]], default=0), np.int64)
    for begin, end, m in _pieces(sizes):
        if m < model.m:
            model.use(m)
            code, span, used = code[:m], span[:m], used[:m]
        if begin in UPDATES:
            model.total = begin
            slots = _slots(out, begin, room)
        found_ids = np.empty((end - begin, m), np.int64)
        for step in range(end - begin):
            edges = model.predict()
            span >>= _N16
            bounds = edges * span
            above = code >= bounds[1:4]
            kind = (above[0].view(np.int8) + above[1].view(np.int8) + above[2].view(np.int8)).astype(np.int64)
            known, unknown = (kind == _N2).nonzero()[0], (kind == _N3).nonzero()[0]
            x = np.where(above[0], model.guess[1], model.guess[0])
            kind *= m
            kind += model.lane
            start = bounds.take(kind)
            kind += m
            code -= start
            np.subtract(bounds.take(kind), start, out=span)
            if len(known):
                rest = code.take(known)
                unit = span.take(known) // model.total
                slot = np.minimum(rest // unit, model.total - 1)
                slot += known * model.total
                found = slots.take(slot, mode="clip")
                x[known] = found & _LOW16
                code[known] = rest - unit * (found >> _N16 & _LOW16)
                span[known] = unit * (found >> _N32)
            if len(unknown):
                rest = code.take(unknown)
                unit = span.take(unknown) >> _PRIOR_SHIFT
                part = np.minimum(rest // unit, (1 << _PRIOR_BITS) - 1)
                value = _near.take(part >> _STEP_BITS, mode="clip").astype(np.int64)
                value += part >= PRIOR.take(value + 1)
                x[unknown] = value + 1
                code[unknown] = rest - unit * PRIOR.take(value)
                span[unknown] = unit * _parts.take(value, mode="clip")
            due = _words_due(span).astype(np.int64)
            shift = due << _N4
            code <<= shift
            code |= ahead.take(used, mode="clip") >> _N48 - shift
            used += due
            span <<= shift
            found_ids[step] = x
            model.learn(x, model.guess == x, known, unknown)
        out[:m, begin:end] = (found_ids - 1).astype(np.uint16).T
    return out


def encode(ids: np.ndarray) -> tuple[list[bytes], list[int], list[int]]:
    """Blocks of coded ids, the number of ids in each, and the crc32 of each block's ids as 32-bit integers."""
    if len(ids) and not (0 <= ids.min() and ids.max() <= LARGEST):
        raise ValueError(f"ids must be from 0 to {LARGEST}")
    rows = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    blocks = [b for i in range(0, len(rows), LANES) for b in _encode_lanes(rows[i : i + LANES])]
    return blocks, [len(r) for r in rows], [zlib.crc32(r.astype("<u4").tobytes()) for r in rows]


def decode(blocks: list[bytes], sizes: list[int], checks: list[int]) -> np.ndarray:
    """The ids of ``encode``'s blocks; any run of blocks decodes alone. A wrong checksum is an error."""
    out, at = np.empty(sum(sizes), "<u4"), 0
    for i in range(0, len(blocks), LANES):
        table = _decode_lanes(blocks[i : i + LANES], np.array(sizes[i : i + LANES]))
        for lane, (n, check) in enumerate(zip(sizes[i : i + LANES], checks[i : i + LANES], strict=True)):
            out[at : at + n] = table[lane, :n]
            if zlib.crc32(out[at : at + n]) != check:
                raise ValueError(f"block {i + lane}: the checksum of the ids is wrong")
            at += n
    return out
