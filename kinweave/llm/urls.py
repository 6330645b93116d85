"""URL filters by a bit-parallel wildcard automaton.

Each rule, a host and a path, becomes two globs over the canonical URL host + path: `host path*` and `+.host path*`, where
`+` stands for any characters but `/`.  All globs lie one after another in the bits of a few 64-bit words.  One Shift-And
step per character moves all states of all globs of a whole batch of URLs: states advance where the next place accepts the
character, and wildcard places keep theirs.  The rules are the caller's parameter; the masks grow with the rules only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import map_texts, narrow, type_of

#: (verdict, rule): the longest rule that fits a URL decides.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DEFAULT = "allow"
#: URLs that take a step together.
TOGETHER = 2048


@dataclass
class Automaton:
    """Bit masks by byte: places that accept it, places that keep their state over it; where globs begin; where they may
    start at the first byte; the two last places of every rule."""

    accept: np.ndarray
    stay: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    last: list[list[int]]

    @classmethod
    def of(cls, rules: Sequence[str]) -> Automaton:
        """Two globs per rule; a place holds (bytes that lead into it, bytes over which it stays)."""
        all_bytes, no_slash, none = np.ones(256, bool), np.ones(256, bool), np.zeros(256, bool)
        no_slash[ord("/")] = False
        into, over, begins, starts, last = [], [], [], [], []
        for rule in rules:
            letters = [(np.arange(256) == b, none) for b in rule.encode()]
            letters[-1] = (letters[-1][0], all_bytes)  # the trailing wildcard: once reached, kept to the end
            ends = []
            for lead in ([], [(no_slash, no_slash), (np.arange(256) == ord("."), none)]):
                begins.append(len(into))
                starts += [len(into), len(into) + 1] if lead else [len(into)]  # `+` may be nothing
                into += [x for x, _ in lead + letters]
                over += [x for _, x in lead + letters]
                ends.append(len(into) - 1)
            last.append(ends)
        width = -(-max(len(into), 1) // 64)
        bits = np.zeros((2, 256, width * 64), bool)
        for place, (x, y) in enumerate(zip(into, over)):
            bits[0, :, place], bits[1, :, place] = x, y
        marks = np.zeros((2, width * 64), bool)
        marks[0, begins], marks[1, starts] = True, True
        packed = np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)
        edges = np.packbits(marks, axis=-1, bitorder="little").view(np.uint64)
        return cls(packed[0], packed[1], edges[0], edges[1], last)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """urls x rules: whether the rule fits."""
        found = np.zeros((len(urls), len(self.last)), bool)
        lengths = np.array([len(u) for u in urls])
        order = np.argsort(-lengths, kind="stable")
        for start in range(0, len(urls), TOGETHER):
            rows = order[start : start + TOGETHER]
            found[rows] = self._run([urls[i] for i in rows], lengths[rows])
        return found

    def _run(self, urls: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """URLs by falling length, so those that still have characters are a prefix of the batch."""
        flat = np.frombuffer(b"".join(urls), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        state = np.zeros((len(urls), len(self.begin)), np.uint64)
        alive = len(urls)
        for at in range(int(lengths[0]) if len(urls) else 0):
            while lengths[alive - 1] <= at:
                alive -= 1
            byte = flat[offsets[:alive] + at]
            old = state[:alive]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)  # the carry from word to word
            moved &= ~self.begin  # a glob's last place does not lead into the next glob
            if at == 0:
                moved |= self.start  # globs are anchored at the beginning of the URL
            state[:alive] = (moved & self.accept[byte]) | (old & self.stay[byte])
        hit = [[(state[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1) for p in pair] for pair in self.last]
        return np.stack([(a | b).astype(bool) for a, b in hit], axis=1) if hit else np.zeros((len(urls), 0), bool)


def filter_urls(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    default: str = DEFAULT,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The host follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; the path goes on up to `?`, `#` or the
    end.  A null URL, or one without `://`, has an empty host and path, fits no rule and gets `default`, as does any URL
    that no rule fits.  Of several rules that fit the longest wins, then the first listed.  Repeated rows give repeated
    results, an empty table an empty one.
    """
    after = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    whole = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(whole, r"(?s)^[^/?#]*([^?#]*)", 1)
    rows = narrow(pages, page_id=page_id, url=url).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("text", F.concat("host", "path"))
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    names, verdicts = [rules[i][1] for i in ranked], [rules[i][0] for i in ranked]
    automaton = Automaton.of(names)

    def prepare():
        def work(part: pa.RecordBatch, texts: list[bytes]):
            fits = automaton.match(texts)
            best = np.where(fits.any(1), fits.argmax(1), -1) if names else np.full(len(texts), -1)
            rule = [names[b] if b >= 0 else None for b in best]
            verdict = [verdicts[b] if b >= 0 else default for b in best]
            return part.column("page_id"), part.column("host"), part.column("path"), rule, verdict

        return work

    return map_texts(rows, prepare, f"page_id {type_of(rows, 'page_id')}, host string, path string, rule string, verdict string")
