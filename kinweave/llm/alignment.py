"""Alignment of two tokenizers' tokens over whole texts, and how often each pair of token ids meets in the corpus.

Both tokenizers cut the bytes of a text (after one space) into tokens.  Where tokens of both end, a group ends; a link is a
pair of tokens whose byte ranges overlap.

* Identity map: for each id of A the id of B with the same bytes, if there is one.  A group of one token each with such ids
  is one link, counted in a vector as long as A's vocabulary, one for each task.  Only the links of all other groups are
  pairs that Spark shuffles.
* A text is cut into units at single spaces between two other characters, which no token of either tokenizer crosses.  A
  task remembers the tokens, groups and links of the units it has met, so each is encoded and aligned once; the alignment
  runs over the flat byte offsets of many units at once.
* Documents are put together into blocks of about `BLOCK` irregular links.  A block lists its distinct pairs once, with how
  often they occur in it, and each document holds only their numbers within the block.  So the shuffle that counts pairs
  over the corpus carries a pair once for each block, and brings its count back to the block the same way.
* The highest count of each B id, and the counts of identity pairs, are as long as the vocabularies and travel with tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.bpe import Numbered, Pool, byte_letters
from kinweave.llm.common import SLICE_ROWS, narrow, to_batch, type_of
from kinweave.llm.tokencounts import MARK, SPACE, file_of, plain_tokenizer, sentencepiece_model
from kinweave.session import cut

#: Irregular links of a block, and units that a task remembers at most; results do not depend on either.
BLOCK, UNITS = 1 << 20, 300_000
NONE = np.int64(-1)


def byte_level_tokens(spec: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    content = json.loads(spec)
    of = {letter: byte for byte, letter in enumerate(byte_letters())}
    ids = content["model"]["vocab"]
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, number in ids.items():
        tokens[number] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    for token, number in special.items():
        tokens[number] = token.encode()
    return tokens


def piece_tokens(model) -> tuple[list[bytes], list[bool]]:
    """The bytes of each id of a sentencepiece model, and which ids stand for single bytes."""
    single = [model.is_byte(i) for i in range(model.get_piece_size())]
    pieces = [model.id_to_piece(i) for i in range(len(single))]
    return [bytes([int(p[1:-1], 16)]) if s else p.replace(MARK, " ").encode() for p, s in zip(pieces, single)], single


def identity_map(a: list[bytes], b: list[bytes], single: list[bool]) -> np.ndarray:
    """For each id of A the id of B of the same bytes, a piece before a single byte; -1 without one."""
    of: dict[bytes, int] = {}
    for number in sorted(range(len(b)), key=lambda i: (single[i], i)):
        of.setdefault(b[number], number)
    return np.array([of.get(t, NONE) if t else NONE for t in a], np.int64)


class Aligner:
    """Both tokenizers, and what a task has learnt of units."""

    def __init__(self, spec: bytes, model: bytes):
        self.tokenizer = plain_tokenizer(spec)
        self.tokenizer.encode_special_tokens = True
        self.model = sentencepiece_model(model)
        self.bytes_a = byte_level_tokens(spec)
        self.bytes_b, single = piece_tokens(self.model)
        self.whole = not any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(len(self.bytes_b)))
        self.same = identity_map(self.bytes_a, self.bytes_b, single)
        self.size_a, self.size_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.forget()

    def forget(self) -> None:
        self.units = Numbered()
        #: Of each unit: do the bytes agree, number of A tokens, B tokens, groups.
        self.facts = np.zeros((4, 0), np.int64)
        self.groups: list[str] = []
        self.regular, self.pairs = Pool(), Pool(np.int64)

    def cut_up(self, text: str) -> list[str]:
        return SPACE.split(text) if self.whole else [text]

    def learn(self) -> None:
        """Encode and align the new units."""
        fresh, self.units.fresh = self.units.fresh, []
        a = [e.ids for e in self.tokenizer.encode_batch_fast([f" {u}" for u in fresh], add_special_tokens=False)]
        b = self.model.encode(fresh, num_threads=1)
        whole = [f" {u}".encode() for u in fresh]
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        good = np.array([b"".join(map(of_a, x)) == w == b"".join(map(of_b, y)) for x, y, w in zip(a, b, whole)], bool)
        at = np.flatnonzero(good)
        lists_a, lists_b = [a[i] for i in at.tolist()], [b[i] for i in at.tolist()]
        unit, first_a, first_b, ends = self._align(lists_a, lists_b)
        flat_a, flat_b = flat(lists_a), flat(lists_b)
        facts = np.zeros((4, len(fresh)), np.int64)
        facts[0] = good
        facts[1, at] = [len(x) for x in lists_a]
        facts[2, at] = [len(x) for x in lists_b]
        facts[3, at] = np.bincount(unit[ends], minlength=len(at))
        self.facts = np.concatenate([self.facts, facts], axis=1)
        # a group of one link whose ids have the same bytes is regular
        ids_a, ids_b = flat_a[first_a], flat_b[first_b]
        alone = ends & np.r_[True, ends[:-1]] & (self.same[ids_a] == ids_b)
        for pool, chosen, values in ((self.regular, alone, ids_a), (self.pairs, ~alone, ids_a << 32 | ids_b)):
            sizes = np.zeros(len(fresh), np.int64)
            sizes[at] = np.bincount(unit[chosen], minlength=len(at))
            pool.add(values[chosen], sizes)
        self.groups += self._names(flat_a.tolist(), flat_b.tolist(), first_a[ends], first_b[ends], at, facts, len(fresh))

    def _align(self, a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each link, in order: unit, place of the A token and of the B token, and whether a group ends with it."""
        ends_a, ends_b = np.cumsum(self.size_a[flat(a)]), np.cumsum(self.size_b[flat(b)])
        bounds = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, bounds), np.searchsorted(ends_b, bounds)
        unit = np.repeat(np.arange(len(a)), [len(x) for x in a])[at_a]
        return unit, at_a, at_b, (ends_a[at_a] == bounds) & (ends_b[at_b] == bounds)

    def _names(self, a, b, last_a, last_b, at, facts, n: int) -> list[str]:
        """The groups of each unit, as in `a1,a2|b1;a3|b2,b3`."""
        names = self.names
        groups, x, y = [], 0, 0
        for i, j in zip((last_a + 1).tolist(), (last_b + 1).tolist()):
            left = names[a[x]] if i == x + 1 else ",".join([names[t] for t in a[x:i]])
            right = names[b[y]] if j == y + 1 else ",".join([names[t] for t in b[y:j]])
            groups.append(f"{left}|{right}")
            x, y = i, j
        out, start = [""] * n, 0
        for i, count in zip(at.tolist(), facts[3, at].tolist()):
            out[i] = ";".join(groups[start : start + count])
            start += count
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[str], tuple, tuple]:
        """Facts of texts (n_a, n_b, n_groups), their groups, and (values, sizes) of regular A ids and of irregular pairs."""
        if len(self.units) > UNITS:
            self.forget()
        cut_up = [self.cut_up(t) if t else [] for t in texts]
        places = [np.fromiter(map(self.units.__getitem__, units), np.int64, len(units)) for units in cut_up]
        if self.units.fresh:
            self.learn()
        kept = [p if self.facts[0, p].all() else p[:0] for p in places]
        flat_, ends = np.concatenate([np.zeros(0, np.int64), *kept]), np.cumsum([0, *map(len, kept)])

        def by_text(sizes: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends])

        facts = np.stack([by_text(self.facts[i, flat_]) for i in (1, 2, 3)])
        groups = [";".join([self.groups[i] for i in p.tolist()]) for p in kept]
        parts = [(values, by_text(sizes)) for values, sizes in (self.regular.gather(flat_), self.pairs.gather(flat_))]
        return facts, groups, *parts


def flat(lists: list[list[int]]) -> np.ndarray:
    return np.array([i for ids in lists for i in ids], np.int64)


@lru_cache(maxsize=1)
def aligner(spec: bytes, model: bytes) -> Aligner:
    """One for each Python worker: tasks that follow each other go on with what is known."""
    return Aligner(spec, model)


def packed(numbers: np.ndarray, most: int) -> bytes:
    """Numbers below `most` in as few bytes as that allows."""
    return numbers.astype(np.uint16 if most <= 1 << 16 else np.uint32).tobytes()


def unpacked(content: bytes, most: int) -> np.ndarray:
    return np.frombuffer(content, np.uint16 if most <= 1 << 16 else np.uint32)


@dataclass
class Aligned:
    """Documents with their links by block, and the distinct pairs of each block and each task's vector (`listed`)."""

    known: DataFrame
    same: np.ndarray
    sizes: tuple[int, int]

    def _listed(self) -> DataFrame:
        """list (block), place, pair, n: pairs of each block; identity pairs of the vectors have no block."""
        rows = self.known.where("pairs IS NOT NULL").select(
            F.col("block").alias("list"), F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "e")
        )
        return rows.select("list", "place", F.col("e.pairs").alias("pair"), F.col("e.times").alias("n"))

    def pair_counts(self) -> DataFrame:
        """a, b, n, best: every pair of ids that is linked, how often, and whether that is the highest count of its b."""
        counts = cut(self._listed().groupBy("pair").agg(F.sum("n").alias("n")))
        b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b")
        found = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), b, "n")
        # one row for each id of B that occurs: no more than its vocabulary has
        highest = F.broadcast(found.groupBy("b").agg(F.max("n").alias("highest")))
        return found.join(highest, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, where they are kept)."""
        counts = cut(self.pair_counts())
        size_a, size_b = self.sizes
        shown = [c for c in self.known.columns if c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups")]
        # identity pairs: at most one for each id of A
        identity = self.known.sparkSession.createDataFrame([(i << 32 | s,) for i, s in enumerate(self.same.tolist()) if s >= 0], "pair bigint")
        vector, best = np.zeros(size_a, np.int64), np.zeros(size_a, np.int64)
        for r in counts.join(F.broadcast(identity), "pair").collect():
            vector[r["a"]], best[r["a"]] = r["n"], r["best"]
        shared = self.known.sparkSession.sparkContext.broadcast((vector, best))
        wanted = self._listed().where("list IS NOT NULL").select("list", "place", "pair")
        back = wanted.join(counts.select("pair", "n", "best"), "pair").select("list", "place", "n", F.col("best").cast("bigint").alias("best"))
        docs = self.known.where("pairs IS NULL").select(*shown, "block", "regular", "irregular")
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*shown).schema)
        schema = f"{fields}, n_best bigint, count_sum bigint"
        arrow = to_arrow_schema(StructType.fromDDL(schema))

        def sums(docs_: pa.Table, found: pa.Table) -> pa.Table:
            """Documents of one block with the counts of the block's pairs, which are placed by number."""
            n, most = np.zeros((2, found.num_rows), np.int64), found.num_rows
            place = found.column("place").to_numpy()
            n[0, place], n[1, place] = found.column("n").to_numpy(), found.column("best").to_numpy()
            identity_n, identity_best = shared.value
            count_sum, n_best = [], []
            for regular, irregular in zip(docs_.column("regular"), docs_.column("irregular")):
                ids, links = unpacked(regular.as_py(), size_a), unpacked(irregular.as_py(), most)
                count_sum.append(int(identity_n[ids].sum()) + int(n[0, links].sum()))
                n_best.append(int(identity_best[ids].sum()) + int(n[1, links].sum()))
            columns = [docs_.column(c) for c in shown]
            return pa.table([*columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], schema=arrow)

        done = docs.groupBy("block").cogroup(back.groupBy("list")).applyInArrow(sums, schema)
        links = F.col("n_a") + F.col("n_b") - F.col("n_groups")
        rest = [c for c in shown if c not in ("doc_id", "n_a", "n_b", "n_groups")]
        return done.select("doc_id", "n_a", "n_b", "n_groups", links.alias("n_links"), "n_best", "count_sum", *rest)


def align(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text", groups: bool = False, block: int = BLOCK) -> Aligned:
    """Aligns a byte-level tokenizer (A, a .json file, over a space and the text) with a sentencepiece model (B, a .model
    file that adds the space itself), over whole texts and without special tokens; strings like these are plain text.

    The result's `documents()` has one row per document, `pair_counts()` one per pair of ids that occurs.  With `groups` the
    groups themselves are a column, too.  A block ends with the slice of documents that brings it to `block` irregular links.
    Null and empty texts, and texts whose tokens of A or B do not give the bytes of
    the space and the text (those with U+2581, say), have no tokens: zeros and an empty groups_sha256.  Repeated rows and
    repeated or null doc_ids are rows of their own, other columns are not looked at, and empty tables give empty results.
    """
    rows = narrow(docs, doc_id=doc_id, text=text)
    files = file_of(byte_level), file_of(pieces)  # of fixed size
    shared = rows.sparkSession.sparkContext.broadcast(files)
    fields = f"doc_id {type_of(rows, 'doc_id')}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string"
    fields += ", groups string" * groups
    schema = f"{fields}, block string, regular binary, irregular binary, pairs array<bigint>, times array<bigint>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        work, task, nth = aligner(*shared.value), TaskContext.get().partitionId(), 0
        vector = np.zeros(len(work.bytes_a), np.int64)
        held: list[tuple] = []
        links = 0

        def listed(pairs: np.ndarray, times: np.ndarray, name: str | None) -> pa.RecordBatch:
            lists = [[x.tolist()] for x in (pairs, times)]
            nothing = [[None]] * (len(arrow) - 5)
            return to_batch([*nothing, [name], [None], [None], *lists], arrow)

        def blocked(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            name = f"{task}-{nth}"
            distinct, number, times = np.unique(np.concatenate([p[-2] for p in parts]), return_inverse=True, return_counts=True)
            # often used pairs first
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            number, start = place[number], 0
            for ids, facts, hashes, names, (a, a_sizes), _, sizes in parts:
                a_ends, ends = np.cumsum([0, *a_sizes]).tolist(), (start + np.cumsum([0, *sizes])).tolist()
                regular = [packed(a[s:e], len(work.bytes_a)) for s, e in zip(a_ends, a_ends[1:])]
                irregular = [packed(number[s:e], len(distinct)) for s, e in zip(ends, ends[1:])]
                start, n = ends[-1], len(ids)
                shown = [ids, *facts, hashes, *([names] if groups else [])]
                yield to_batch([*shown, [name] * n, regular, irregular, [None] * n, [None] * n], arrow)
            if len(distinct):
                yield listed(distinct[order], times[order], name)

        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                texts = [t.decode("utf-8", "replace") for t in part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
                facts, names, regular, (pairs, sizes) = work(texts)
                vector += np.bincount(regular[0], minlength=len(vector))
                hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in names]
                held.append((part.column("doc_id"), facts, hashes, names if groups else None, regular, pairs, sizes))
                links += len(pairs)
                if links >= block:
                    yield from blocked(held)
                    held, links, nth = [], 0, nth + 1
        if held:
            yield from blocked(held)
        if vector.any():
            ids = np.flatnonzero(vector)
            yield listed(ids << 32 | work.same[ids], vector[ids], None)

    known = cut(rows.mapInArrow(run, schema))
    made = Aligner(*files)
    return Aligned(known, made.same, (len(made.bytes_a), len(made.bytes_b)))
