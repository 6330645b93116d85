"""Byte-pair encoding with word ends, and decoding, by batched merge rounds.

The words of a slice of documents that a task has not met yet are encoded together; their symbols lie in one flat array.
A round looks up the rank of every adjacent pair by binary search over the sorted pair keys, takes the lowest rank of each
word with a segmented minimum, and merges all its places at once; words without a mergeable pair are done.  Encoded words
are remembered as positions in one flat pool of ids, so a document's ids are gathered without a loop over its tokens.
The vocabulary file is a parameter; it is read once on the driver and travels with the tasks.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.common import map_texts, narrow, to_batch, type_of

#: How the vocabulary's tokenizer cuts lower-cased text into words; fixed by the vocabulary.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ids a task remembers for words it has met; it starts afresh beyond, with equal results.
POOL = 1_000_000
#: Characters that Python, but not the vocabulary's tokenizer, takes for white space; and chunks as the latter sees them.
SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
NOT_SPACE = regex.compile(r"\S+")
DONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    shown = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else "" for b in range(256)]
    spare = iter(range(256, 512))
    return [c or chr(next(spare)) for c in shown]


@dataclass
class Vocabulary:
    """tokens by id; ids of single bytes inside and at the end of a word; sorted pair keys with ranks and results."""

    tokens: list[str]
    inside: np.ndarray
    ending: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, number in [*ids.items(), *special.items()]:
            tokens[number] = token
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        letters = byte_letters()
        return cls(
            tokens,
            np.array([ids[c] for c in letters], np.int64),
            np.array([ids[c + end] for c in letters], np.int64),
            keys[order],
            np.arange(len(pairs))[order],
            np.array([ids[a + b] for a, b in pairs], np.int64)[order],
            special,
        )

    def _rank_of_pairs(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol the rank of the pair it begins (DONE if none) and the place of the pair in the keys."""
        rank, place = np.full(len(symbols), DONE), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1 and len(self.keys):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[at] == pair) & (word[:-1] == word[1:])
            place[:-1] = at
            rank[:-1][hit] = self.ranks[at[hit]]
        return rank, place

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after another, and the number of ids of each word.  Words are not empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inside[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.ending[flat[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank, place = self._rank_of_pairs(symbols, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(word)])
            low = np.repeat(lowest, sizes)
            over = low == DONE
            if over.any():
                finished.append((word[over], symbols[over]))
                symbols, word, rank, place, low = (x[~over] for x in (symbols, word, rank, place, low))
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == low)
            # in a run of overlapping places, as in "aaa", the left one of each two merges
            fresh = np.r_[True, (np.diff(chosen) != 1) | (word[chosen[1:]] != word[chosen[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            symbols[chosen] = self.results[place[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        owner = np.concatenate([w for w, _ in finished]) if finished else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in finished]) if finished else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number


class Pool:
    """Id lists one after another."""

    def __init__(self, kind: type = np.int32):
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at some places, one after another, and their sizes."""
        sizes = self.sizes[at]
        shift = self.starts[at] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(shift, sizes) + np.arange(sizes.sum())], sizes


class Encoder:
    """Encodes texts with one vocabulary; remembers words, and chunks: what stands between white space.

    No word crosses white space, and neither normal forms nor lower case look across it, so a chunk has the same ids in
    every text.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.piece = regex.compile(PIECE)
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._forget()

    def _forget(self) -> None:
        self.words, self.word_ids = Numbered(), Pool()
        self.chunks, self.chunk_ids = Numbered(), Pool()

    def _learn(self) -> None:
        """Ids of the new chunks, and of the new words in them."""
        fresh, self.chunks.fresh = self.chunks.fresh, []
        special = self.vocabulary.special
        cut_up = [[c] if c[0] == " " else self._words(c) for c in fresh]
        at = np.array([self.words[w] for words in cut_up for w in words], np.int64)
        new, self.words.fresh = self.words.fresh, []
        # a special token is kept as a word behind a blank, which no word holds
        marks = np.array([special.get(w[1:], -1) if w[0] == " " else -1 for w in new], np.int64)
        plain = [w.encode() for w, mark in zip(new, marks) if mark < 0]
        ids, sizes = self.vocabulary.encode_words(plain)
        whole = np.ones(len(new), np.int64)
        whole[marks < 0] = sizes
        out = np.zeros(whole.sum(), np.int64)
        is_mark = np.repeat(marks >= 0, whole)
        out[~is_mark], out[is_mark] = ids, marks[marks >= 0]
        self.word_ids.add(out, whole)
        ids, sizes = self.word_ids.gather(at)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, cut_up)])]
        self.chunk_ids.add(ids, np.diff(ends))

    def _words(self, chunk: str) -> list[str]:
        """NFC, then lower case letter by letter (a final sigma is no exception), then the pattern."""
        return self.piece.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def _chunks(self, text: str) -> list[str]:
        """Chunks of a text; special tokens are cut out of the text as it is, and marked by a leading blank."""
        if self.special is not None and any(name in text for name in self.vocabulary.special):
            parts = self.special.split(text)
            return [c for i, part in enumerate(parts) for c in ([f" {part}"] if i % 2 else self._chunks(part))]
        if SEPARATORS.isdisjoint(text):
            return text.split()
        return NOT_SPACE.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        if len(self.chunk_ids.ids) > POOL:
            self._forget()
        number = self.chunks.__getitem__
        places = [np.fromiter(map(number, chunks), np.int64, len(chunks)) for chunks in map(self._chunks, texts)]
        if self.chunks.fresh:
            self._learn()
        ids, sizes = self.chunk_ids.gather(np.concatenate([np.zeros(0, np.int64), *places]))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, places)])]
        return ids, np.diff(ends)


def _encoded(encoder: Encoder, texts: list[bytes]) -> pa.ListArray:
    ids, counts = encoder.encode([t.decode("utf-8", "replace") for t in texts])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def _decoded(tokens: pa.StringArray, lists: pa.ListArray) -> pa.StringArray:
    """Tokens of each list joined by single spaces; a null list decodes to empty text."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens.take(lists.flatten())), " ")


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row per document: doc_id, token_ids (array of int), and with `decoded` what these decode to, in the same pass.

    Texts are encoded whole; null and empty texts and those of blanks have no ids.  Strings that read like special tokens
    become these, as in the tokenizer that the vocabulary belongs to.  Repeated rows encode alike; an empty table gives an
    empty result.
    """
    rows = narrow(docs, doc_id=doc_id, text=text)
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.read(path))  # the file's 49,000 tokens, fixed

    def prepare():
        encoder, tokens = Encoder(shared.value), pa.array(shared.value.tokens, pa.string())

        def work(part: pa.RecordBatch, texts: list[bytes]):
            lists = _encoded(encoder, texts)
            return part.column("doc_id"), lists, *([_decoded(tokens, lists)] if decoded else [])

        return work

    schema = f"doc_id {type_of(rows, 'doc_id')}, token_ids array<int>" + ", decoded string" * decoded
    return map_texts(rows, prepare, schema)


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, token_ids) -> doc_id, token_ids, decoded: the tokens joined by single spaces, specials kept.

    The vocabulary names no decoder, and this is how its tokenizer decodes then.  Null arrays decode to empty text.
    """
    rows = narrow(encoded, doc_id=doc_id, token_ids="token_ids")
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.read(path).tokens)
    schema = f"doc_id {type_of(rows, 'doc_id')}, token_ids array<int>, decoded string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                lists = part.column("token_ids").cast(pa.list_(pa.int32()))
                yield to_batch([part.column("doc_id"), part.column("token_ids"), _decoded(tokens, lists)], arrow)

    return rows.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256."""
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
