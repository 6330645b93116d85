"""Pairs of profiles of two tiles found and graded together, evaluated on Arrow batches.

Two tiles that meet form millions of pairs with few levels.  The helpers here find the pairs of similar names, grade them with
numpy, each pair of different values once, and return all links, how many have which levels, the earliest stored profile of
each, or those that can be among the best of a mention.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from kinweave.functions.similarity import EncodedStrings, score_pairs, similar_in_grid, similar_rows

# Python workers get these functions with the job, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs of profiles that are graded at once.
PAIRS_AT_ONCE = 1 << 18
#: Entries of a table of all pairs of values; with more values, each batch of pairs finds its different ones by sorting.
TABLE = 1 << 22
#: Links that are held until those that cannot count any more are dropped, and least values that are held at once.
HELD, LEASTS = 1 << 20, 1 << 22
#: Shares of pairs of values among all of their sides' beyond which these are scored at once.
DENSE = 0.5
#: Levels of a field are numbered from the NULL level on.
NULL_LEVEL = -1
NO_ARRIVAL, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
UNKNOWN = -2

#: Field, its thresholds (None: it is compared for equality only), and its number of levels with the NULL level.
Grade = tuple[str, tuple[float, ...] | None, int]


class GradedField:
    """Values of one field of all profiles of a batch as numbers, and the levels of their pairs."""

    def __init__(self, values: pa.Array, thresholds: tuple[float, ...] | None):
        held = values.dictionary_encode()
        self.values, self.thresholds = held.dictionary.to_pylist(), thresholds
        self.size = len(self.values) + 1
        # NULL has the last number
        self.code = held.indices.fill_null(len(self.values)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.missing = self.code == len(self.values) if held.null_count else None
        self.table = None
        if thresholds is not None:
            self.encoded = EncodedStrings(self.values)
            if self.size**2 <= TABLE:
                self.table = np.full(self.size**2, UNKNOWN, dtype=np.int8)

    def levels(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Levels of pairs of profiles; those of a missing value have no meaning."""
        a, b = self.code[first], self.code[second]
        if self.thresholds is None:
            return (a == b).astype(np.int8)
        if self.table is None and len(a):
            sides = [self._present(a), self._present(b)]
            if self._grid_pays(sides, len(a)):
                return self._in_grid(a, b, *sides)
        pairs = a * self.size + b
        if self.table is None:
            pairs, where = np.unique(pairs, return_inverse=True)
            return self._graded(pairs)[where]
        found = self.table[pairs]
        unknown = found == UNKNOWN
        if unknown.any():
            new = np.unique(pairs[unknown])
            self.table[new] = self._graded(new)
            found = self.table[pairs]
        return found

    def _present(self, code: np.ndarray) -> np.ndarray:
        seen = np.zeros(self.size, dtype=bool)
        seen[code] = True
        return np.flatnonzero(seen[:-1])

    def _grid_pays(self, sides: list[np.ndarray], pairs: int) -> bool:
        short = all(len(side) and self.encoded.short[side].all() for side in sides)
        return short and min(self.thresholds, default=0) > 0 and pairs > DENSE * len(sides[0]) * len(sides[1])

    def _in_grid(self, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Levels of pairs that are most of all pairs of `left` and `right`."""
        level, places = np.zeros((len(left), len(right)), dtype=np.int8), []
        for l, r, score in similar_in_grid(self.encoded, left, right, min(self.thresholds)):
            level[l, r] = sum((score >= t).astype(np.int8) for t in self.thresholds)
        equal = np.intersect1d(left, right, return_indices=True)
        level[equal[1], equal[2]] = len(self.thresholds) + 1
        for side in (left, right):
            place = np.zeros(self.size, dtype=np.int64)
            place[side] = np.arange(len(side))
            places.append(place)
        return level[places[0][a], places[1][b]]

    def _graded(self, pairs: np.ndarray) -> np.ndarray:
        a, b = pairs // self.size, pairs % self.size
        level = np.where(a == b, len(self.thresholds) + 1, 0).astype(np.int8)
        differing = np.flatnonzero((a != b) & (a < len(self.values)) & (b < len(self.values)))
        if len(differing):
            score = score_pairs(self.encoded, a[differing], b[differing], min(self.thresholds, default=None))
            for position in reversed(range(len(self.thresholds))):
                level[differing[score >= self.thresholds[position]]] = len(self.thresholds) - position
        return level


def _slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Begins and ends of slices that weigh at most `most`, or are one entry."""
    upto, begin = np.cumsum(weights), 0
    while begin < len(weights):
        end = max(int(np.searchsorted(upto, upto[begin] - weights[begin] + most, side="right")), begin + 1)
        yield begin, end
        begin = end


class Tiles:
    """Profiles of some whole groups of tiles that meet."""

    def __init__(self, rows: pa.Table, grades: list[Grade], penalise: bool):
        def numbers(name: str, null: int = 0) -> np.ndarray:
            return rows[name].combine_chunks().fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)

        self.rows, self.grades, self.penalise = rows, grades, penalise
        self.ids, self.last = numbers("profile_id"), numbers("last_new", NO_ARRIVAL)
        self.fields = [GradedField(rows[f"f{i}"].combine_chunks(), thresholds) for i, (_, thresholds, _) in enumerate(grades)]
        names = rows["name"].combine_chunks().dictionary_encode()
        self.names, self.code = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.side, self.alone = numbers("side"), numbers("l_tile") == numbers("r_tile")
        self.group = _group_starts(rows)

    def links(self, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Directed links, some at a time: the rows of the new and of the stored profile, and the pattern of levels.

        A link leads to a stored profile that arrived before the last new mention, which may be the same profile.
        """
        for l, r, square in self._pairs(cutoff):
            levels = [field.levels(l, r) for field in self.fields]
            for new, stored in ((l, r),) if square else ((l, r), (r, l)):
                kept = np.flatnonzero(self.ids[stored] < self.last[new])
                if len(kept):
                    yield new[kept], stored[kept], self._pattern(levels, new, stored, kept)

    def _pattern(self, levels: list[np.ndarray], new: np.ndarray, stored: np.ndarray, kept: np.ndarray) -> np.ndarray:
        pattern = np.zeros(len(kept), dtype=np.int64)
        for field, level, (_, _, size) in zip(self.fields, levels, self.grades):
            level = level[kept]
            if field.missing is not None:
                level = np.where(field.missing[new[kept]], 0 if self.penalise else NULL_LEVEL, level)
                level = np.where(field.missing[stored[kept]], NULL_LEVEL, level)
            pattern = pattern * size + (level - NULL_LEVEL)
        return pattern

    def _pairs(self, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Rows of both profiles of each pair, and whether the pairs come both ways round (those of one name in one tile)."""
        # a run holds the profiles of one name on one side of a group
        changes = self.group | np.r_[True, (self.code[1:] != self.code[:-1]) | (self.side[1:] != self.side[:-1])]
        begin = np.flatnonzero(changes)
        size, code = np.diff(np.r_[begin, len(changes)]), self.code[begin]
        first = np.flatnonzero(self.group[begin])
        groups = []
        for start, end in zip(first, np.r_[first[1:], len(begin)]):
            runs = np.arange(start, end)
            if self.alone[begin[start]]:
                groups.append((runs, runs, True))
            else:
                split = start + int((self.side[begin[start:end]] == 0).sum())
                groups.append((runs[: split - start], runs[split - start :], False))
        inside = [lefts for lefts, _, alone in groups if alone]
        if inside:
            runs = np.concatenate(inside)
            for l, r in self._spread(begin, size, runs, runs):
                yield l, r, True
        equal = [np.intersect1d(code[l], code[r], assume_unique=True, return_indices=True)[1:] for l, r, _ in groups]
        equal = [(l[i], r[j]) for (l, r, alone), (i, j) in zip(groups, equal) if not alone]
        run, fresh = np.arange(len(begin)), np.ones(len(begin), dtype=bool)
        found = similar_rows(EncodedStrings(self.names), code, run, fresh, groups, cutoff)
        similar = ((l[code[l] != code[r]], r[code[l] != code[r]]) for l, r, _ in found)
        waiting, held = [], 0
        for pair in itertools.chain(equal, similar, [None]):
            if pair is not None:
                waiting.append(pair)
                held += len(pair[0])
            if held >= PAIRS_AT_ONCE or (pair is None and held):
                l, r = (np.concatenate([w[end] for w in waiting]) for end in (0, 1))
                waiting, held = [], 0
                for a, b in self._spread(begin, size, l, r):
                    yield a, b, False

    @staticmethod
    def _spread(begin: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of all profiles of a left run with all of its right run."""
        for some, more in _slices(size[left], PAIRS_AT_ONCE):
            runs, others = left[some:more], right[some:more]
            n = size[runs]
            rows = np.repeat(begin[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            partners, start = np.repeat(size[others], n), np.repeat(begin[others], n)
            for first, last in _slices(partners, PAIRS_AT_ONCE):
                p = partners[first:last]
                l = np.repeat(rows[first:last], p)
                yield l, np.repeat(start[first:last] - (np.cumsum(p) - p), p) + np.arange(len(l))


def _group_starts(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """True where another group of tiles starts."""
    changed = np.ones(rows.num_rows, dtype=bool)
    block = rows["block"].combine_chunks() if isinstance(rows, pa.Table) else rows["block"]
    same = np.ones(max(rows.num_rows - 1, 0), dtype=bool)
    for data in (block.dictionary_encode().indices.to_numpy(zero_copy_only=False), rows["l_tile"].to_numpy(), rows["r_tile"].to_numpy()):
        same &= data[1:] == data[:-1]
    changed[1:] = ~same
    return changed


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, about a batch each."""
    key = ("block", "l_tile", "r_tile")
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(np.flatnonzero(_group_starts(batch))[-1])
        ends = bool(open_) and any(open_[-1][c][-1].as_py() != batch[c][0].as_py() for c in key)
        if last or ends:
            yield pa.Table.from_batches([*open_, batch.slice(0, last)])
            open_ = []
        open_.append(batch.slice(last))
    if open_:
        yield pa.Table.from_batches(open_)


def _patterns(grades: list[Grade]) -> int:
    return math.prod(size for _, _, size in grades)


def _numbered(pattern: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different patterns, the place of each given one among them, and how often they occur."""
    if size > PAIRS_AT_ONCE:
        return np.unique(pattern, return_inverse=True, return_counts=True)
    counts = np.bincount(pattern, minlength=size)
    present = counts > 0
    return np.flatnonzero(present), (np.cumsum(present) - 1)[pattern], counts[present]


def _spelled(pattern: np.ndarray, grades: list[Grade]) -> list[pa.Array]:
    """The level of each field of patterns."""
    levels = []
    for _, _, size in reversed(grades):
        levels.append(pa.array((pattern % size + NULL_LEVEL).astype(np.int32)))
        pattern = pattern // size
    return levels[::-1]


def listed(grades: list[Grade], penalise: bool, cutoff: float) -> Callable:
    """Every link: new_profile, stored_profile, levels."""
    names = ["new_profile", "stored_profile", *[name for name, _, _ in grades]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            tiles = Tiles(rows, grades, penalise)
            for new, stored, pattern in tiles.links(cutoff):
                columns = [pa.array(tiles.ids[new]), pa.array(tiles.ids[stored]), *_spelled(pattern, grades)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def first_stored(grades: list[Grade], penalise: bool, cutoff: float) -> Callable:
    """Of each new profile and pattern of levels, the earliest stored profile: new_profile, stored_profile, levels."""
    names = ["new_profile", "stored_profile", *[name for name, _, _ in grades]]
    size = _patterns(grades)

    def told(own: np.ndarray, number: dict[int, int], least: np.ndarray) -> pa.RecordBatch:
        patterns = np.fromiter(number, dtype=np.int64, count=len(number))
        pattern, new = np.nonzero(least < NO_ID)
        columns = [pa.array(own[new]), pa.array(least[pattern, new]), *_spelled(patterns[pattern], grades)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            tiles = Tiles(rows, grades, penalise)
            own, new_of = np.unique(tiles.ids, return_inverse=True)
            number: dict[int, int] = {}
            least = np.full((0, len(own)), NO_ID)
            for new, stored, pattern in tiles.links(cutoff):
                patterns, place, _ = _numbered(pattern, size)
                fresh = [p for p in patterns.tolist() if p not in number]
                if number and (len(number) + len(fresh)) * len(own) > LEASTS:
                    yield told(own, number, least)
                    number, fresh, least = {}, patterns.tolist(), least[:0]
                number |= {p: len(number) + i for i, p in enumerate(fresh)}
                least = np.concatenate([least, np.full((len(fresh), len(own)), NO_ID)]) if fresh else least
                row = np.array([number[p] for p in patterns.tolist()])[place]
                np.minimum.at(least.reshape(-1), row * len(own) + new_of[new], tiles.ids[stored])
            if number:
                yield told(own, number, least)

    return run


def counted(grades: list[Grade], penalise: bool, cutoff: float) -> Callable:
    """How many links have which levels: levels, links."""
    names, size = [*[name for name, _, _ in grades], "links"], _patterns(grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            found: dict[int, int] = {}
            for _, _, pattern in Tiles(rows, grades, penalise).links(cutoff):
                patterns, _, counts = _numbered(pattern, size)
                for p, n in zip(patterns.tolist(), counts.tolist()):
                    found[p] = found.get(p, 0) + n
            if found:
                pattern = np.fromiter(found, dtype=np.int64, count=len(found))
                links = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                yield pa.RecordBatch.from_arrays([*_spelled(pattern, grades), pa.array(links)], names)

    return run


def _places(*keys: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of some sorted rows in the run of its first `group` keys, and the place where those equal in all keys begin."""
    start = np.zeros(len(keys[0]), dtype=bool)
    start[:1] = True
    for key in keys[:group]:
        start[1:] |= key[1:] != key[:-1]
    tie = start.copy()
    for key in keys[group:]:
        tie[1:] |= key[1:] != key[:-1]
    number = np.arange(len(start))
    begin = np.maximum.accumulate(np.where(start, number, 0))
    return number - begin, np.maximum.accumulate(np.where(tie, number, 0)) - begin


class Front:
    """Of the offers of each new profile those that can be among the best `n` of one of its mentions.

    An offer is a pattern of levels and the arrival of a mention of a cluster; where clusters are not asked for, every stored
    profile is one of its own.  Arrivals before the first mention of the new profile are known to all of its mentions, so of
    these the best one of each cluster counts and of the clusters the best `n`; later ones only above them.  Of one rank the
    first `n` clusters count.  Equal ones are kept, so whoever orders them by more than this loses none.
    """

    def __init__(self, n: int, rank: np.ndarray, own: np.ndarray, first: np.ndarray, cluster: np.ndarray | None):
        """`rank` of each pattern (-1: no link), `own` first arrival of each new profile, `first` arrivals, and `cluster`s of
        offers that are numbered by arrival."""
        self.n, self.rank, self.own, self.first, self.cluster = max(n, 1), rank, own, first, cluster
        # rank and arrival of the last of the best early ones
        self.floor, self.until = np.full(len(own), -1, dtype=np.int64), np.full(len(own), NO_ID)
        self.held = [np.zeros(0, dtype=np.int32)] * 3
        self.waiting, self.size = [], 0

    def add(self, new: np.ndarray, pattern: np.ndarray, offer: np.ndarray) -> None:
        rank, floor = self.rank[pattern], self.floor[new]
        kept = rank > floor
        level = np.flatnonzero((rank == floor) & (rank >= 0))
        if len(level):
            first = self.first[offer[level]]
            kept[level] = (first <= self.until[new[level]]) & (first < self.own[new[level]])
        kept = np.flatnonzero(kept)
        if len(kept):
            self.waiting.append(tuple(x[kept].astype(np.int32) for x in (new, pattern, offer)))
            self.size += len(kept)
            if self.size > max(HELD, len(self.held[0])):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New profiles, patterns and offers that count among all that were added."""
        new, pattern, offer = (np.concatenate([self.held[i], *[w[i] for w in self.waiting]]) for i in range(3))
        self.waiting, self.size = [], 0
        if self.cluster is not None:
            new, pattern, offer = self._best_of_clusters(new, pattern, offer)
        rank, first = self.rank[pattern], self.first[offer]
        early = first < self.own[new]
        order = np.flatnonzero(early)
        order = order[np.lexsort((first[order], -rank[order], new[order]))]
        place, tie = _places(new[order], rank[order], first[order], group=1)
        last = order[place == self.n - 1]
        self.floor[new[last]], self.until[new[last]] = rank[last], first[last]
        kept = [order[tie < self.n]]
        order = np.flatnonzero(~early & (rank > self.floor[new]))
        order = order[np.lexsort((first[order], rank[order], new[order]))]
        kept.append(order[_places(new[order], rank[order], first[order], group=2)[1] < self.n])
        kept = np.concatenate(kept)
        self.held = [new[kept], pattern[kept], offer[kept]]
        return tuple(self.held)

    def _best_of_clusters(self, new: np.ndarray, pattern: np.ndarray, offer: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each cluster and rank the first offer, and none behind a better early one."""
        cluster, rank = self.cluster[offer], self.rank[pattern]
        order = np.lexsort((offer, -rank, cluster, new))
        new, pattern, offer, cluster, rank = (x[order] for x in (new, pattern, offer, cluster, rank))
        firsts = _places(new, cluster, rank, group=3)[0] == 0
        new, pattern, offer, cluster = (x[firsts] for x in (new, pattern, offer, cluster))
        early = self.first[offer] < self.own[new]
        before, place = np.cumsum(early) - early, _places(new, cluster, group=2)[0]
        hidden = before - before[np.arange(len(new)) - place] > 0
        return new[~hidden], pattern[~hidden], offer[~hidden]


def kept(grades: list[Grade], penalise: bool, cutoff: float, top_n: int, rank: np.ndarray, weight: np.ndarray, offered: bool) -> Callable:
    """Links that can be among the best `top_n` of some mention: new_profile, stored_profile, match_weight.

    `rank` orders the patterns of levels (-1: no link) and `weight` is their match weight.  With `offered`, what is ranked are
    the clusters of stored profiles, which `seen` lists with the first arrival of each; without it the profiles.
    """
    names = ["new_profile", "stored_profile", "match_weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            tiles = Tiles(rows, grades, penalise)
            own, new_of = np.unique(tiles.ids, return_inverse=True)
            if offered:
                seen = rows["seen"].combine_chunks()
                many = pc.fill_null(pc.list_value_length(seen), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = seen.flatten()
                begin, profile = np.cumsum(many) - many, np.repeat(tiles.ids, many)
                arrival = flat.field("first_seq").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                cluster = flat.field("cluster_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            else:
                many, begin, profile, arrival, cluster = np.ones(len(tiles.ids), dtype=np.int64), np.arange(len(tiles.ids)), tiles.ids, tiles.ids, None
            order = np.argsort(arrival, kind="stable")
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order))
            front = Front(top_n, rank, own, arrival[order], None if cluster is None else cluster[order])
            single = bool((many == 1).all())
            for new, stored, pattern in tiles.links(cutoff):
                if single:
                    front.add(new_of[new], pattern, number[begin[stored]])
                    continue
                for first, last in _slices(many[stored], PAIRS_AT_ONCE):
                    n, some = many[stored[first:last]], slice(first, last)
                    entry = np.repeat(begin[stored[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    front.add(np.repeat(new_of[new[some]], n), np.repeat(pattern[some], n), number[entry])
            new, pattern, offer = front.settle()
            if len(new):
                columns = [pa.array(own[new]), pa.array(profile[order[offer]]), pa.array(weight[pattern])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run
