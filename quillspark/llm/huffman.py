"""Canonical length-limited Huffman codes over integer ids, in numpy.

A code is its array of lengths (0: the id never occurs); codes follow from lengths and ids, so
lengths are all that a file has to carry. Units (a document, a block) are coded one by one and
start on a byte. Every `STEP` ids of a unit have a checkpoint, the bit at which they start, so a
reader may begin there; the decoder uses them to step through many runs at once, with one table
look-up an id.
"""

from __future__ import annotations

import heapq

import numpy as np

STEP = 256
#: Longest code: a table of 2 ** LIMIT entries decodes it, and LIMIT bits and 7 more fit 24.
LIMIT = 17
#: Ids packed at a time, so that what is at work stays in the CPU's cache.
SLICE = 1 << 14


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge.

    Ids with count 0 get length 0; a single id gets length 1; ties go by id. ValueError if
    more than 2 ** limit ids occur.
    """
    counts = np.asarray(counts, np.int64)
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.lexsort((used, counts[used]))]
    weights = counts[used]
    row, leaves = weights, [np.ones(len(used), bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        order = np.argsort(both := np.concatenate([weights, pairs]), kind="stable")
        row = both[order]
        leaves.append(order < len(used))
    take, found = 2 * len(used) - 2, np.zeros(len(used), np.uint8)
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())
        found[:n] += 1
        take = 2 * (take - n)
    lengths[used] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id; each is one more than the one before, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    own = lengths[order].astype(np.int64)
    if len(order):
        top = int(own.max())
        spans = np.left_shift(np.int64(1), top - own)
        codes[order] = ((np.cumsum(spans) - spans) >> (top - own)).astype(np.uint64)
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.bits = self.lengths.astype(np.int64)
        self.codes = canonical_codes(self.lengths)
        #: Codes with their first bit at the top of 64.
        self.left = self.codes << np.where(self.bits > 0, 64 - self.bits, 0).astype(np.uint64)
        self.top = max(1, int(self.lengths.max(initial=1)))
        order = np.flatnonzero(self.lengths)
        order = order[np.lexsort((order, self.lengths[order]))]
        spans = np.left_shift(1, self.top - self.bits[order])
        filled = np.repeat((order << 5) | self.bits[order], spans).astype(np.int64)
        #: By the next `top` bits: id << 5 | length. Bits that start no code step on by one.
        self.table = np.concatenate([filled, np.ones((1 << self.top) - len(filled), np.int64)])

    def encode(self, ids: np.ndarray, units: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """ids of all units in a row -> (bytes, first byte of each unit and the end, checkpoints).

        Checkpoints are bits counted from the unit's first byte, ceil(n / STEP) for a unit of n ids.
        """
        units = np.asarray(units, np.int64)
        size = self.bits[ids]
        if len(ids) and not size.all():
            raise ValueError("an id has no code")
        ends = np.concatenate([[0], np.cumsum(units)])
        run = np.concatenate([[0], np.cumsum(size)])
        per_unit = (run[ends[1:]] - run[ends[:-1]] + 7) >> 3
        first = np.concatenate([[0], np.cumsum(per_unit)])
        at = run[:-1] + np.repeat(first[:-1] * 8 - run[ends[:-1]], units)
        out = np.zeros((int(first[-1]) >> 3) + 2, np.uint64)
        for k in range(0, len(ids), SLICE):
            part = at[k : k + SLICE]
            word, shift, code = part >> 6, part & 63, self.left[ids[k : k + SLICE]]
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[starts]] |= np.bitwise_or.reduceat(code >> shift.astype(np.uint64), starts)
            over = np.flatnonzero(shift + size[k : k + SLICE] > 64)
            out[word[over] + 1] |= code[over] << (64 - shift[over]).astype(np.uint64)
        n_marks = (units + STEP - 1) // STEP
        mark_of = np.concatenate([[0], np.cumsum(n_marks)])
        which = np.arange(mark_of[-1]) - np.repeat(mark_of[:-1], n_marks)
        marks = at[np.repeat(ends[:-1], n_marks) + which * STEP] - np.repeat(first[:-1] * 8, n_marks) if mark_of[-1] else np.zeros(0, np.int64)
        return out.astype(">u8").tobytes()[: int(first[-1])], first, marks.astype("<u4")

    def decode(self, data: bytes, first: np.ndarray, units: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The ids of all units in a row. `first`: the byte each unit starts at."""
        units = np.asarray(units, np.int64)
        if not units.sum():
            return np.zeros(0, np.int64)
        raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
        three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        n_marks = (units + STEP - 1) // STEP
        bit = np.repeat(np.asarray(first, np.int64)[: len(units)] * 8, n_marks) + marks
        lanes = np.empty((STEP, len(bit)), np.int32)
        last, cut, mask = len(three) - 1, 24 - self.top, (1 << self.top) - 1
        for k in range(STEP):
            got = self.table[(three[np.minimum(bit >> 3, last)] >> (cut - (bit & 7))) & mask]
            lanes[k] = got >> 5
            bit += got & 31
        mark_of = np.cumsum(n_marks) - n_marks
        left = np.repeat(units, n_marks) - (np.arange(len(bit)) - np.repeat(mark_of, n_marks)) * STEP
        flat = lanes.T
        return flat[np.arange(STEP)[None, :] < np.minimum(left, STEP)[:, None]].astype(np.int64)


def mean_bits(counts: np.ndarray, lengths: np.ndarray) -> float:
    return float((counts * lengths.astype(np.int64)).sum() / max(1, counts.sum()))


def unlimited_mean_bits(counts: np.ndarray) -> float:
    """Mean bits of a plain Huffman code, for comparison."""
    heap = [int(x) for x in counts if x]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    return total / max(1, int(counts.sum()))
