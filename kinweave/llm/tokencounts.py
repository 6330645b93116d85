"""Token counts of whole texts by a tokenizer library, in batches of equal bytes.

Only lengths leave the Arrow function.  A slice of a batch ends where its texts reach `BATCH` bytes, and long texts are cut
into parts at places that no token crosses, so the ids of one library call stay few however long a text is.

Where a part may end:

* A sentencepiece model none of whose pieces holds a space mark behind another character, and that puts a mark before
  each text: at a single space between two other characters.  The space goes, as the mark of the next part stands for it.
* Such a model without a piece that holds a line break: before a line break.  The mark of the next part is no part of the
  text then, and its tokens are taken off.
* A byte-level tokenizer that adds no space: before a single space between two other characters.

A text without such a place, or of a tokenizer of another kind, is encoded in one piece.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.common import narrow, to_batch, type_of

#: Bytes that are encoded in one call, and characters from which a text is cut; the counts do not depend on them.
BATCH, PART = 1 << 20, 1 << 15
#: Tokens from which on a text is over the limit.
LIMIT = 4_096
#: The mark that sentencepiece writes for a space.
MARK = "▁"
#: No white space by any library's rules, and no mark.
SOLID = r"[^\s\x1c-\x1f᠎​⁠﻿▁]"
SPACE = regex.compile(rf"(?<={SOLID}) (?={SOLID})")
SPACE_OR_LINE = regex.compile(rf"{SPACE.pattern}|(?=\n)")


def file_of(path: str) -> bytes:
    """A vocabulary file, read on the driver; it travels with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def sentencepiece_model(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def plain_tokenizer(spec: bytes):
    """The tokenizer of a .json file, without truncation and padding."""
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_str(spec.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Lengths:
    """Numbers of tokens by one vocabulary.  `cuts` finds the ends of parts; none where texts must stay whole."""

    def __init__(self, kind: str, content: bytes):
        self.cuts, self.keeps_space, self.extra = None, False, 0
        if kind == "model":
            self._sentencepiece(sentencepiece_model(content))
        elif kind == "json":
            self._tokenizer(plain_tokenizer(content), content)
        else:
            raise ValueError(f"no library reads vocabularies of kind {kind!r}")

    def _sentencepiece(self, model) -> None:
        self.encode: Callable[[list[str]], list] = lambda parts: model.encode(parts, num_threads=1)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        joined = any(MARK in p.lstrip(MARK) for p in pieces)
        if joined or not model.encode("x", out_type=str)[0].startswith(MARK):
            return
        one, two = len(model.encode("\n")), len(model.encode("\n\n"))
        lines = two > one and not any("\n" in p for p in pieces)
        self.cuts, self.extra = (SPACE_OR_LINE, 2 * one - two) if lines else (SPACE, 0)

    def _tokenizer(self, tokenizer, content: bytes) -> None:
        self.encode = lambda parts: tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        before = json.loads(content)["pre_tokenizer"] or {}
        steps = [before, *before.get("pretokenizers", [])]
        if any(s.get("type") == "ByteLevel" for s in steps) and not any(s.get("add_prefix_space") for s in steps):
            self.cuts, self.keeps_space = SPACE, True

    def parts(self, text: str, most: int = PART) -> tuple[list[str], int]:
        """Parts of a text of little more than `most` characters each, and the tokens that the cuts add."""
        found, start, added = [], 0, 0
        while self.cuts is not None and len(text) - start > most:
            cut = self.cuts.search(text, start + most)
            if cut is None:
                break
            found.append(text[start : cut.start()])
            start = cut.start() if self.keeps_space else cut.end()
            added += self.extra * (cut.start() == cut.end())
        return [*found, text[start:]], added

    def __call__(self, texts: list[str], batch: int = BATCH, most: int = PART) -> np.ndarray:
        """The number of tokens of each text."""
        cut_up = [self.parts(t, most) for t in texts]
        flat = [p for parts, _ in cut_up for p in parts]
        ends = np.cumsum([len(p) for p in flat], dtype=np.int64)
        counts = np.zeros(len(flat) + 1, np.int64)
        for low, high in slices(ends, batch):
            counts[low + 1 : high + 1] = [len(ids) for ids in self.encode(flat[low:high])]
        last = np.cumsum([0, *(len(parts) for parts, _ in cut_up)])
        return np.diff(np.cumsum(counts)[last]) - np.array([added for _, added in cut_up], np.int64)


def slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items, given where each ends, of at most `most` in size; an item beyond that is alone."""
    low, before = 0, 0
    while low < len(ends):
        high = max(int(np.searchsorted(ends, before + most, "right")), low + 1)
        yield low, high
        low, before = high, int(ends[high - 1])


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    The file's ending tells the library: .json for tokenizers, .model for sentencepiece.  Texts are encoded whole, without
    special tokens around them; strings that read like special tokens are what the library takes them for.  Null counts as
    empty, which has no tokens.  Bytes that are no UTF-8 are read as U+FFFD but counted as they are.  Repeated rows count
    alike, other columns are not looked at, and an empty table gives an empty result.
    """
    rows = narrow(docs, doc_id=doc_id, text=text)
    shared = rows.sparkSession.sparkContext.broadcast((path.rsplit(".", 1)[-1], file_of(path)))  # one file of fixed size
    schema = f"doc_id {type_of(rows, 'doc_id')}, n_bytes bigint, n_tokens bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.binary()).fill_null(b"")
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
            for low, high in slices(np.cumsum(sizes, dtype=np.int64), BATCH):
                held = [t.decode("utf-8", "replace") for t in texts.slice(low, high - low).to_pylist()]
                yield to_batch([batch.column("doc_id").slice(low, high - low), sizes[low:high], lengths(held)], arrow)

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
