"""Jaro-Winkler similarity over UTF-8 bytes, evaluated on Arrow batches.

Spark has no built-in Jaro-Winkler.  The helpers here score many pairs at once with numpy:
each distinct string is encoded once, and a pair is a couple of row numbers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the Winkler variant: prefix weight, longest prefix, boost only above this Jaro value.
PREFIX_WEIGHT = 0.1
MAX_PREFIX = 4
BOOST_ABOVE = 0.7

# Python workers get these functions with the job, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_BITS = 64
BAG_WORDS = 4
PAIR_CHUNK = 1 << 14
# Matched bytes of a pair after which it is dropped if it cannot reach the cut-off any more.
TURNS = 4
# Strings up to so many bytes are bit sets of a few machine words, and how many of their pairs are scored at once.
WIDE, WIDE_CHUNK = 256, 1 << 11
# Bytes of pairs with a longer string that are scored at once.
LONG_BYTES = 1 << 20
PAIRS_AT_ONCE = 1 << 18
# Pairs of short strings that a grid scores at once, and the fewest for which a grid pays.
GRID_CELLS, LEAST_GRID = 1 << 15, 1 << 12
# A grid pays where the filter lets more than this share of the pairs through, as a few pairs tell; pieces of a tile with itself.
GRID_SHARE, PROBED, PIECES = 0.25, 1 << 10, 8
ROUNDING_SLACK = 1e-9

_ONE = np.uint64(1)


class EncodedStrings:
    """Distinct strings of one batch as byte codes, position masks and, once asked for, byte-bag bitmaps."""

    def __init__(self, values: list[str]):
        self.raw = [v.encode("utf-8") for v in values]
        self.length = np.array([len(b) for b in self.raw], dtype=np.int64)
        self.short = self.length <= WORD_BITS
        width = max(int(self.length[self.short].max(initial=1)), 1)
        filled = np.arange(width)[None, :] < np.where(self.short, self.length, 0)[:, None]
        matrix = np.zeros((len(self.raw), width), dtype=np.uint8)
        matrix[filled] = np.frombuffer(b"".join([b for b in self.raw if len(b) <= WORD_BITS]), dtype=np.uint8)
        present = np.bincount(matrix.ravel(), minlength=256) > 0
        # The last code is padding: it has an empty position mask, so it never matches.
        self.padding = int(present.sum())
        self.alphabet_size = self.padding + 1
        self.codes = np.where(filled, (np.cumsum(present) - 1)[matrix], self.padding).astype(np.int64)
        masks = np.zeros((len(self.raw), self.alphabet_size), dtype=np.uint64)
        rows = np.arange(len(self.raw))
        for position in range(width):
            masks[rows, self.codes[:, position]] |= _ONE << np.uint64(position)
        masks[:, self.padding] = 0
        self.masks = masks.ravel()
        self.prefix = np.array(
            [int.from_bytes(b[:MAX_PREFIX].ljust(MAX_PREFIX, b"\0"), "big") for b in self.raw], dtype=np.uint32
        )

    @cached_property
    def bag(self) -> np.ndarray:
        """Unary byte counts hashed into a bitmap: the n-th copy of a byte sets one bit."""
        bits, size = np.zeros((len(self.raw), BAG_WORDS), dtype=np.uint64), BAG_WORDS * WORD_BITS
        ends = np.cumsum(self.length)
        first = 0
        while first < len(self.raw):  # about `LONG_BYTES` at once
            last = max(int(np.searchsorted(ends, ends[first] + LONG_BYTES, side="right")), first + 1)
            data = np.frombuffer(b"".join(self.raw[first:last]), dtype=np.uint8)
            symbol = np.sort(np.repeat(np.arange(last - first), self.length[first:last]) * 256 + data)
            begin = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]]) if len(symbol) else np.zeros(0, np.int64)
            copy = np.arange(len(symbol)) - np.repeat(begin, np.diff(np.r_[begin, len(symbol)]))
            slots = np.zeros((last - first, size), dtype=bool)
            slots[symbol // 256, (symbol % 256 * 37 + copy * 101) % size] = True
            bits[first:last] = np.packbits(slots, axis=1, bitorder="little").view("<u8")
            first = last
        return bits

    def _where(self, chosen: np.ndarray) -> np.ndarray:
        """Positions of the chosen codes, as bits of strings of one word."""
        bits = np.zeros(len(self.raw), dtype=np.uint64)
        for position in range(self.codes.shape[1]):
            bits |= chosen[self.codes[:, position]].astype(np.uint64) << np.uint64(position)
        return bits

    @cached_property
    def classes(self) -> list[np.ndarray]:
        """Bytes in four classes, about equally frequent: positions of those whose class has the first and the second bit."""
        counts = np.bincount(self.codes.ravel(), minlength=self.alphabet_size)[: self.padding]
        of, held = np.zeros(self.alphabet_size, dtype=np.int64), np.zeros(4, dtype=np.int64)
        for code in np.argsort(-counts, kind="stable").tolist():
            of[code] = held.argmin()
            held[of[code]] += counts[code]
        return [self._where(of >> bit & 1 == 1) for bit in (0, 1)]

    @cached_property
    def code_bits(self) -> list[np.ndarray]:
        """For each bit of a code, the positions of the bytes whose codes have it."""
        return [self._where(np.arange(self.alphabet_size) >> bit & 1 == 1) for bit in range(self.padding.bit_length())]

    @cached_property
    def collapsed(self) -> np.ndarray:
        """Bytes that share a bit of the bitmap with another one."""
        return self.length - np.bitwise_count(self.bag).sum(axis=1).astype(np.int64)


def _boost(jaro: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro), jaro)


def _common_prefix(enc: EncodedStrings, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    differing = enc.prefix[left] ^ enc.prefix[right]
    shared = (
        (differing < (1 << 24)).astype(np.int64)
        + (differing < (1 << 16))
        + (differing < (1 << 8))
        + (differing == 0)
    )
    return np.minimum(shared, np.minimum(enc.length[left], enc.length[right]))


def may_reach(enc: EncodedStrings, left: np.ndarray, right: np.ndarray, cutoff: float) -> np.ndarray:
    """Lossless pre-filter: False only where Jaro-Winkler cannot reach the cut-off.

    Matching bytes never exceed the overlap of the two byte bags, and the transposition term is at most 1.
    """
    overlap = np.bitwise_count(enc.bag[left] & enc.bag[right]).sum(axis=1, dtype=np.int64)
    overlap += np.minimum(enc.collapsed[left], enc.collapsed[right])
    la, lb = enc.length[left], enc.length[right]
    overlap = np.minimum(overlap, np.minimum(la, lb))
    upper = (overlap / np.maximum(la, 1) + overlap / np.maximum(lb, 1) + 1.0) / 3.0
    return _boost(upper, _common_prefix(enc, left, right)) >= cutoff - ROUNDING_SLACK


def _short_chunk(enc: EncodedStrings, left: np.ndarray, right: np.ndarray, cutoff: float | None) -> np.ndarray:
    """Jaro-Winkler of pairs that fit one machine word; below the cut-off the value may be any lower number."""
    la, lb = enc.length[left], enc.length[right]
    prefix = _common_prefix(enc, left, right)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    window = np.where(reach + 1 >= WORD_BITS, ~np.uint64(0), (_ONE << (reach + 1).astype(np.uint64)) - _ONE)
    base = right * enc.alphabet_size
    taken = np.zeros(len(left), dtype=np.uint64)
    flagged = np.zeros(len(left), dtype=np.uint64)
    codes = enc.codes
    for position in range(int(la.max(initial=0))):
        hits = enc.masks[base + codes[left, position]] & window & ~taken
        lowest = hits & (~hits + _ONE)
        taken |= lowest
        flagged |= (lowest != 0).astype(np.uint64) << np.uint64(position)
        window = (window << _ONE) | (position < reach).astype(np.uint64)
    matches = np.bitwise_count(taken).astype(np.int64)
    safe_a, safe_b = np.maximum(la, 1), np.maximum(lb, 1)
    score = np.zeros(len(left))
    live = matches > 0
    if cutoff is not None:
        best = (matches / safe_a + matches / safe_b + 1.0) / 3.0
        live &= _boost(best, prefix) >= cutoff - ROUNDING_SLACK
    keep = np.flatnonzero(live)
    if len(keep) == 0:
        return score
    l, r, base = left[keep], right[keep], base[keep]
    rest_a, rest_b = flagged[keep], taken[keep]
    moved = np.zeros(len(keep), dtype=np.int64)
    for turn in range(1, int(matches[keep].max()) + 1):
        low_a, low_b = rest_a & (~rest_a + _ONE), rest_b & (~rest_b + _ONE)
        where_a = np.bitwise_count(low_a - _ONE).astype(np.int64) % WORD_BITS
        open_ = low_a != 0
        moved += open_ & ((enc.masks[base + codes[l, np.minimum(where_a, codes.shape[1] - 1)]] & low_b) == 0)
        rest_a ^= low_a
        rest_b ^= low_b
        if cutoff is not None and turn % TURNS == 0:
            # more transpositions never raise a score, so pairs that are below the cut-off by now go
            hopeful = np.flatnonzero(_matched(matches[keep], moved, la[keep], lb[keep], prefix[keep]) >= cutoff - ROUNDING_SLACK)
            if len(hopeful) < len(keep):
                keep, moved, rest_a, rest_b = keep[hopeful], moved[hopeful], rest_a[hopeful], rest_b[hopeful]
                l, r, base = l[hopeful], r[hopeful], base[hopeful]
    score[keep] = _matched(matches[keep], moved, la[keep], lb[keep], prefix[keep])
    return score


def _matched(m: np.ndarray, moved: np.ndarray, la: np.ndarray, lb: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Jaro-Winkler from the number of matching bytes (above 0) and how many of them stand elsewhere in the other string."""
    return _boost((m / la + m / lb + (m - moved // 2) / m) / 3.0, prefix)


def _squeezed(mask: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    """The bits of each word that the mask selects, moved together to the low end (parallel suffix of the gaps)."""
    words, gaps = [w & mask for w in words], ~mask << _ONE
    for turn in range(6):
        odd = gaps ^ (gaps << _ONE)
        for shift in (2, 4, 8, 16, 32):
            odd ^= odd << np.uint64(shift)
        moving, step = odd & mask, np.uint64(1 << turn)
        mask = (mask ^ moving) | (moving >> step)
        for i, word in enumerate(words):
            part = word & moving
            words[i] = (word ^ part) | (part >> step)
        gaps &= ~odd
    return words


def _differing(flagged: np.ndarray, taken: np.ndarray, bits: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many matched bytes of the strings `a` differ, by some of `bits`, from those at the same place among the matches in `b`."""
    of_a, of_b = _squeezed(flagged, [np.take(x, a) for x in bits]), _squeezed(taken, [np.take(x, b) for x in bits])
    different = np.zeros(len(a), dtype=np.uint64)
    for x, y in zip(of_a, of_b):
        different |= x ^ y
    return np.bitwise_count(different)


def _least_jaro(cutoff: float) -> np.ndarray:
    """For each length of the common prefix, a Jaro value that every pair that reaches the cut-off has."""
    extra = np.arange(MAX_PREFIX + 1) * PREFIX_WEIGHT
    return np.minimum(cutoff, np.maximum((cutoff - extra) / (1.0 - extra), BOOST_ABOVE)) - ROUNDING_SLACK


def similar_in_grid(enc: EncodedStrings, left: np.ndarray, right: np.ndarray, cutoff: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Places in `left` and `right` of pairs that reach a cut-off above 0, and their scores; all strings fit a machine word.

    All of `left` meet all of `right`, so the positions of a byte in the right strings are rows that are read as they lie, and
    the loop over bytes needs no look-up per pair.
    """
    masks = np.ascontiguousarray(enc.masks.reshape(-1, enc.alphabet_size)[right].T)
    order = np.argsort(enc.length[left], kind="stable")
    step = max(GRID_CELLS // len(right), 1)
    for start in range(0, len(order), step):
        part = order[start : start + step]
        at_left, at_right, score = _grid_chunk(enc, left[part], right, masks, cutoff)
        yield part[at_left], at_right, score


def _grid_chunk(
    enc: EncodedStrings, left: np.ndarray, right: np.ndarray, masks: np.ndarray, cutoff: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape = (len(left), len(right))
    lengths, kind = np.unique(enc.length[left], return_inverse=True)
    lb = enc.length[right]
    reach = np.maximum(np.maximum(lengths[:, None], lb) // 2 - 1, 0)
    window = (_ONE << (reach + 1).astype(np.uint64)) - _ONE
    free, hits, lowest, opened = np.full(shape, ~np.uint64(0)), *(np.empty(shape, dtype=np.uint64) for _ in range(3))
    matched, bit = np.empty(shape, dtype=bool), np.empty(shape, dtype=np.uint8)
    seen, flagged = np.zeros(shape, dtype=np.uint8), np.zeros((*shape, WORD_BITS // 8), dtype=np.uint8)
    for position in range(int(lengths[-1])):
        np.take(masks, enc.codes[left, position], axis=0, out=hits, mode="clip")
        hits &= free
        if len(lengths) == 1:
            hits &= window
        else:
            hits &= np.take(window, kind, axis=0, out=opened, mode="clip")
        np.negative(hits, out=lowest)
        lowest &= hits
        free ^= lowest
        np.not_equal(lowest, 0, out=matched)
        np.multiply(matched.view(np.uint8), np.uint8(1 << position % 8), out=bit)
        seen |= bit
        if position % 8 == 7 or position == lengths[-1] - 1:
            flagged[..., position // 8] = seen
            seen[:] = 0
        window = (window << _ONE) | (position < reach).astype(np.uint64)
    taken = ~free
    matches = np.bitwise_count(taken)
    # without a common prefix, so many matches are needed even if all stand in order
    needed = (3.0 * _least_jaro(cutoff)[0] - 1.0) / (1.0 / np.maximum(lengths[:, None], 1) + 1.0 / np.maximum(lb, 1))
    needed = np.clip(np.ceil(needed - ROUNDING_SLACK), 1, WORD_BITS + 1).astype(np.uint8)
    first = enc.prefix >> np.uint32(24)
    possible = matches >= needed[kind]
    possible |= (first[left][:, None] == first[right]) & (matches > 0)
    at = np.flatnonzero(possible)
    l = at // shape[1]
    r = at - l * shape[1]
    flagged, taken, matches = (np.take(x, at) for x in (flagged.view("<u8"), taken, matches))
    a, b = np.take(left, l), np.take(right, r)
    # bytes of two classes are different, so most pairs are decided by two bits a byte and few need all of them
    apart = _differing(flagged, taken, enc.classes, a, b)
    part = 1.0 / np.maximum(enc.length, 1)
    best = matches * (np.take(part, a) + np.take(part, b)) + 1.0 - (apart >> 1) / matches
    keep = np.flatnonzero(best >= 3.0 * _least_jaro(cutoff)[_common_prefix(enc, a, b)])
    l, r, a, b, flagged, taken, m = (x[keep] for x in (l, r, a, b, flagged, taken, matches.astype(np.int64)))
    moved = _differing(flagged, taken, enc.code_bits, a, b).astype(np.int64)
    score = _matched(m, moved, enc.length[a], enc.length[b], _common_prefix(enc, a, b))
    hit = np.flatnonzero(score >= cutoff)
    return l[hit], r[hit], score[hit]


def _grid_pays(enc: EncodedStrings, left: np.ndarray, right: np.ndarray, cutoff: float) -> bool:
    """Whether all pairs are scored sooner than filtered: many short strings, whose bytes are much alike."""
    left, right = left[enc.short[left]], right[enc.short[right]]
    if cutoff <= 0 or len(left) * len(right) < LEAST_GRID:
        return False
    probed = np.linspace(0, len(left) * len(right) - 1, PROBED).astype(np.int64)
    return may_reach(enc, left[probed // len(right)], right[probed % len(right)], cutoff).mean() > GRID_SHARE


def _wide_chunk(enc: EncodedStrings, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of pairs whose strings fit `WIDE` bytes: as many machine words a string as the longest needs."""
    rows, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    longest, pairs = int(enc.length[rows].max()), np.arange(len(left))
    words = -(-longest // WORD_BITS)
    padding = 256  # matches nothing
    codes = np.full((len(rows), words * WORD_BITS), padding, dtype=np.int64)
    for i, row in enumerate(rows):
        codes[i, : enc.length[row]] = np.frombuffer(enc.raw[row], dtype=np.uint8)
    masks = np.zeros((len(rows), padding + 1, words), dtype=np.uint64)
    for position in range(longest):
        masks[np.arange(len(rows)), codes[:, position], position // WORD_BITS] |= _ONE << np.uint64(position % WORD_BITS)
    masks[:, padding] = 0
    l, r = at[: len(left)], at[len(left) :]
    la, lb = enc.length[left], enc.length[right]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    open_bits = np.clip(reach[:, None] + 1 - WORD_BITS * np.arange(words), 0, WORD_BITS)
    window = np.where(open_bits == WORD_BITS, ~np.uint64(0), (_ONE << (open_bits % WORD_BITS).astype(np.uint64)) - _ONE)
    taken, flagged = np.zeros_like(window), np.zeros_like(window)
    for position in range(int(la.max(initial=0))):
        hits = masks[r, codes[l, position]] & window & ~taken
        word = (hits != 0).argmax(axis=1)
        chosen = hits[pairs, word]
        taken[pairs, word] |= chosen & (~chosen + _ONE)
        flagged[:, position // WORD_BITS] |= (chosen != 0).astype(np.uint64) << np.uint64(position % WORD_BITS)
        carry = window[:, :-1] >> np.uint64(WORD_BITS - 1)
        window = window << _ONE
        window[:, 1:] |= carry
        window[:, 0] |= (position < reach).astype(np.uint64)

    def matched(strings: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, byte) of the matched bytes, pair by pair in their order."""
        at_pair, place = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little"))
        return at_pair, codes[strings[at_pair], place]

    owner, from_left = matched(l, flagged)
    moved = np.bincount(owner, weights=from_left != matched(r, taken)[1], minlength=len(left)).astype(np.int64)
    m = np.bincount(owner, minlength=len(left))
    safe = np.maximum(m, 1)
    jaro = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved // 2) / safe) / 3.0
    return np.where(m > 0, _boost(jaro, _common_prefix(enc, left, right)), 0.0)


class LongStrings:
    """Positions of every byte value in some strings: one flat array, string by string and byte by byte."""

    def __init__(self, enc: EncodedStrings, rows: np.ndarray):
        self.length = enc.length[rows]
        data = np.frombuffer(b"".join([enc.raw[row] for row in rows.tolist()]), dtype=np.uint8)
        self.start = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(rows)), self.length)
        order = np.argsort(owner * 256 + data, kind="stable")
        self.position = order - np.repeat(self.start, self.length)
        self.counts = np.bincount(owner * 256 + data, minlength=256 * len(rows)).reshape(-1, 256)
        self.first = (np.cumsum(self.counts.ravel()) - self.counts.ravel()).reshape(-1, 256)

    def listed(self, strings: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a byte in a string, for many of both, one after another, and how many each."""
        sizes = self.counts[strings, byte]
        shift = self.first[strings, byte] - (np.cumsum(sizes) - sizes)
        return self.position[np.repeat(shift, sizes) + np.arange(sizes.sum())], sizes


def _long_chunk(enc: EncodedStrings, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of pairs of strings of any length, in time proportional to their lengths.

    A byte takes the first free equal byte in its window, and windows move forwards, so for each byte value the free places
    are a queue: an occurrence gets the place behind the last one taken, or the first in its window if that is later.  The
    n-th occurrences of all byte values of all pairs are matched at once.
    """
    rows, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    strings, l, r = LongStrings(enc, rows), at[: len(left)], at[len(left) :]
    la, lb = strings.length[l], strings.length[r]
    pair, byte = np.nonzero((strings.counts[l] > 0) & (strings.counts[r] > 0))
    # values with many occurrences first, so those that have an n-th one are the first ones
    order = np.argsort(-strings.counts[l[pair], byte], kind="stable")
    pair, byte = pair[order], byte[order]
    a, a_sizes = strings.listed(l[pair], byte)
    b, b_sizes = strings.listed(r[pair], byte)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[pair]
    span = int(max(la.max(initial=0), lb.max(initial=0))) * 2 + 2
    value_of_a = np.repeat(np.arange(len(pair)), a_sizes)
    places = np.repeat(np.arange(len(pair)), b_sizes) * span + b
    around = np.repeat(reach, a_sizes)
    low = np.searchsorted(places, value_of_a * span + np.maximum(a - around, 0))
    high = np.searchsorted(places, value_of_a * span + a + around, side="right")
    taken_by = np.full(len(a), -1)
    begin = np.cumsum(a_sizes) - a_sizes
    free = np.zeros(len(pair), dtype=np.int64)
    with_nth = np.searchsorted(-a_sizes, -np.arange(int(a_sizes.max(initial=0))), side="left")
    for nth, active in enumerate(with_nth.tolist()):
        index = begin[:active] + nth
        place = np.maximum(free[:active], low[index])
        hit = place < high[index]
        taken_by[index] = np.where(hit, place, -1)
        free[:active] = place + hit
    matched = np.flatnonzero(taken_by >= 0)
    owner, letter = pair[value_of_a[matched]], byte[value_of_a[matched]]
    from_left = np.argsort(owner * span + a[matched], kind="stable")
    from_right = np.argsort(owner * span + b[taken_by[matched]], kind="stable")
    m = np.bincount(owner, minlength=len(left))
    moved = np.bincount(owner[from_left], weights=letter[from_left] != letter[from_right], minlength=len(left)).astype(np.int64)
    jaro = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved // 2) / np.maximum(m, 1)) / 3.0
    return np.where(m > 0, _boost(jaro, _common_prefix(enc, left, right)), 0.0)


def score_pairs(enc: EncodedStrings, left: np.ndarray, right: np.ndarray, cutoff: float | None = None) -> np.ndarray:
    """Jaro-Winkler of many pairs of rows of `enc`; with a cut-off, hopeless pairs may score lower than their value."""
    result = np.empty(len(left))
    short = enc.short[left] & enc.short[right]
    index = np.flatnonzero(short)
    index = index[np.argsort(enc.length[left[index]], kind="stable")]
    for start in range(0, len(index), PAIR_CHUNK):
        part = index[start : start + PAIR_CHUNK]
        result[part] = _short_chunk(enc, left[part], right[part], cutoff)
    wide = ~short & (np.maximum(enc.length[left], enc.length[right]) <= WIDE)
    index = np.flatnonzero(wide)
    index = index[np.argsort(np.maximum(enc.length[left[index]], enc.length[right[index]]), kind="stable")]
    for start in range(0, len(index), WIDE_CHUNK):
        part = index[start : start + WIDE_CHUNK]
        result[part] = _wide_chunk(enc, left[part], right[part])
    index = np.flatnonzero(~short & ~wide)
    size = enc.length[left[index]] + enc.length[right[index]]
    index, size = index[np.argsort(size, kind="stable")], np.sort(size)
    part = np.cumsum(size) // LONG_BYTES
    for begin, end in zip(*_runs(part)):
        chosen = index[begin:end]
        result[chosen] = _long_chunk(enc, left[chosen], right[chosen])
    return result


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of runs of equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return starts.tolist(), np.append(starts[1:], len(values)).tolist() if len(values) else []


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    result = np.full(len(left), np.nan)
    present = (left.notna() & right.notna()).to_numpy()
    half = int(present.sum())
    if half:
        code, values = pd.factorize(pd.concat([left[present], right[present]], ignore_index=True))
        # A batch repeats the same pairs of values; each is scored once.
        pairs, where = np.unique(code[:half].astype(np.int64) * len(values) + code[half:], return_inverse=True)
        scores = score_pairs(EncodedStrings(list(values)), pairs // len(values), pairs % len(values))
        result[present] = scores[where]
    return pd.Series(result)


def jaro_winkler(left: Column, right: Column) -> Column:
    """Jaro-Winkler similarity over bytes; NULL when a side is NULL.

    Equal and missing values are decided in the JVM; only differing values travel to Python.
    """
    differs = left != right
    scored = _jaro_winkler(F.when(differs, left), F.when(differs, right))
    return F.when(left.isNull() | right.isNull(), F.lit(None).cast("double")).when(
        left == right, F.when(left == "", F.lit(0.0)).otherwise(F.lit(1.0))
    ).otherwise(scored)


TILE_PAIR_SCHEMA = "l_value long, r_value long, l_tiles int, r_tiles int, similarity double"

#: Rows of two tiles of names that are to be compared, and whether both are one tile.
Meeting = tuple[np.ndarray, np.ndarray, bool]


def similar_rows(
    enc: EncodedStrings, code: np.ndarray, ids: np.ndarray, fresh: np.ndarray, meetings: Iterable[Meeting], cutoff: float
) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of the ends of similar pairs, and their scores; `code` is the string of each row in `enc`.

    In a tile with itself a new row meets those of lower ids and stored ones; other tiles meet row by row.
    """

    def scored(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        l, r = (np.concatenate([f[end] for f in found]) for end in (0, 1))
        possible = may_reach(enc, code[l], code[r], cutoff)
        l, r = l[possible], r[possible]
        score = score_pairs(enc, code[l], code[r], cutoff)
        hit = score >= cutoff
        return l[hit], r[hit], score[hit]

    waiting, size = [], 0
    for lefts, rights, alone in meetings:

        def wanted(l: np.ndarray, r: np.ndarray) -> np.ndarray:
            return (ids[l] > ids[r]) | (~fresh[r] & (ids[l] != ids[r])) if alone else np.ones(len(l), dtype=bool)

        pairs = [(lefts, rights)]
        if _grid_pays(enc, code[lefts], code[rights], cutoff):
            short = enc.short[code]
            pairs = [(lefts[~short[lefts]], rights), (lefts[short[lefts]], rights[~short[rights]])]
            lefts, rights = lefts[short[lefts]], rights[short[rights]]
            pieces = np.array_split(lefts[np.argsort(ids[lefts])], PIECES) if alone else [lefts]
            for piece in (p for p in pieces if len(p)):
                # in a tile with itself, new values meet earlier ones
                others = rights[~fresh[rights] | (ids[rights] < ids[piece[-1]])] if alone else rights
                for l, r, score in similar_in_grid(enc, code[piece], code[others], cutoff) if len(others) else ():
                    l, r = piece[l], others[r]
                    kept = wanted(l, r)
                    yield l[kept], r[kept], score[kept]
        for lefts, rights in pairs:
            at_once = max(PAIRS_AT_ONCE // max(len(rights), 1), 1)
            for first in range(0, len(lefts) if len(rights) else 0, at_once):
                part = lefts[first : first + at_once]
                l, r = np.repeat(part, len(rights)), np.tile(rights, len(part))
                kept = wanted(l, r)
                waiting.append((l[kept], r[kept]))
                size += len(waiting[-1][0])
                if size >= PAIRS_AT_ONCE:
                    yield scored(waiting)
                    waiting, size = [], 0
    if waiting:
        yield scored(waiting)


def similar_within_tiles(cutoff: float):
    """Batch function for `mapInPandas`: pairs of similar names in each (block, left tile, right tile) group.

    Input rows are sorted by group, side 0 (left tile, new values only) before side 1.  The right side of a group of two
    tiles holds what the left one is to be compared with, as the group that has them the other way round leaves it out; a
    tile with itself gives each pair once.  Of two new values the later one is the left end.
    """

    def finish(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, tiles = rows["value_id"].to_numpy(), rows["value_tiles"].to_numpy()
        fresh = rows["fresh_value"].to_numpy(dtype=bool)
        found, size = [], 0
        for l, r, score in similar(rows, ids, fresh):
            found.append((l, r, score))
            size += len(l)
            if size >= PAIRS_AT_ONCE:
                yield listed(ids, tiles, fresh, found)
                found, size = [], 0
        if size:
            yield listed(ids, tiles, fresh, found)

    def similar(rows: pd.DataFrame, ids: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        code, values = pd.factorize(rows["name"])
        side = rows["side"].to_numpy()
        alone = rows["l_tile"].to_numpy() == rows["r_tile"].to_numpy()
        starts = np.flatnonzero(_changes(rows))

        def meetings() -> Iterator[Meeting]:
            for begin, end in zip(starts, np.append(starts[1:], len(rows))):
                split = begin + int((side[begin:end] == 0).sum())
                yield np.arange(begin, split), np.arange(split, end), bool(alone[begin])

        return similar_rows(EncodedStrings(list(values)), code, ids, fresh, meetings(), cutoff)

    def listed(ids: np.ndarray, tiles: np.ndarray, fresh: np.ndarray, found: list) -> pd.DataFrame:
        l, r, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        swap = fresh[r] & (ids[r] > ids[l])
        l, r = np.where(swap, r, l), np.where(swap, l, r)
        return pd.DataFrame({"l_value": ids[l], "r_value": ids[r], "l_tiles": tiles[l], "r_tiles": tiles[r], "similarity": score})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            joined = pd.concat([*waiting, batch], ignore_index=True) if waiting else batch.reset_index(drop=True)
            last = int(np.flatnonzero(_changes(joined))[-1])
            if last:
                yield from finish(joined.iloc[:last])
            waiting = [joined.iloc[last:]]
        if waiting:
            yield from finish(waiting[0])

    return run


def _changes(rows: pd.DataFrame) -> np.ndarray:
    """True where a new (block, left tile, right tile) group starts."""
    changed = np.ones(len(rows), dtype=bool)
    if len(rows) > 1:
        same = np.ones(len(rows) - 1, dtype=bool)
        for column in ("block", "l_tile", "r_tile"):
            data = rows[column].to_numpy()
            same &= data[1:] == data[:-1]
        changed[1:] = ~same
    return changed
