"""RDF payloads as tables: Turtle to triples, prefixes, typed subjects, property paths."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.session import task_slots

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
IRI, LITERAL, BLANK = "iri", "literal", "blank"
PREFIX = re.compile(r"^([^:]*):")
# Bytes of payloads that are Python strings at once.
BYTES_AT_ONCE = 1 << 22
TRIPLE_SCHEMA = "request_key long, s string, p string, o string, o_kind string, error string"

# Namespaces and the shipped mapping of entity types to property paths.
NAMESPACES = {
    "epo": "http://data.europa.eu/a4g/ontology#",
    "org": "http://www.w3.org/ns/org#",
    "locn": "http://www.w3.org/ns/locn#",
    "cccev": "http://data.europa.eu/m8g/",
}
ENTITY_TYPES = {
    "ORGANISATION": {
        "rdf_type": "org:Organization",
        "fields": {
            "legal_name": "epo:hasLegalName",
            "country_code": "cccev:registeredAddress/epo:hasCountryCode",
            "nuts_code": "cccev:registeredAddress/epo:hasNutsCode",
            "post_code": "cccev:registeredAddress/locn:postCode",
            "post_name": "cccev:registeredAddress/locn:postName",
            "thoroughfare": "cccev:registeredAddress/locn:thoroughfare",
        },
    }
}


@dataclass(frozen=True)
class Hop:
    """One step of a field's property path; the step of no field names the class of the entity type."""

    entity_type: str
    field: str | None
    hop: int
    iri: str | None


def hop_table(namespaces: dict[str, str], entity_types: dict[str, dict]) -> list[Hop]:
    """All steps of a mapping configuration, prefixes expanded; a field without a path has one step without an IRI.

    Prefixes that are not declared are reported together.
    """
    undeclared: set[str] = set()

    def expanded(found: re.Match) -> str:
        undeclared.update({found[1]} - namespaces.keys())
        return namespaces.get(found[1], "")

    written = [
        (name, field, path)
        for name, entry in entity_types.items()
        for field, path in [(None, entry["rdf_type"]), *entry["fields"].items()]
    ]
    hops = [
        Hop(name, field, number, step and PREFIX.sub(expanded, step))
        for name, field, path in written
        for number, step in enumerate([None] if path is None else [path] if field is None else path.split("/"))
    ]
    if undeclared:
        raise ValueError(f"No namespace is declared for {', '.join(sorted(undeclared))}")
    return hops


def shipped_hops() -> list[Hop]:
    return hop_table(NAMESPACES, ENTITY_TYPES)


def resolved(name: Column, namespaces: dict[str, str]) -> Column:
    """Full IRI of a prefixed name; a name without a prefix stays as it is, an undeclared prefix gives NULL."""
    table = F.create_map(*[F.lit(part) for pair in namespaces.items() for part in pair])
    prefix = F.substring_index(name, ":", 1)
    local = F.substring(name, F.length(prefix) + 2, F.length(name))
    return F.when(~F.contains(name, F.lit(":")), name).otherwise(F.concat(F.try_element_at(table, prefix), local))


# --- Turtle ----------------------------------------------------------------------------------------------------

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
    |(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<node>_:[\w-]+(?:\.+[\w-]+)*)
    |(?P<name>(?:[^\W\d_][\w-]*(?:\.[\w-]+)*)?:(?:(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[^\w\s])(?:(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[^\w\s]|\.(?=[\w:.%\\-]))*))?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\d*\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+))
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
ESCAPED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    def one(found: re.Match) -> str:
        short, long, char = found.groups()
        if short or long:
            code = int(short or long, 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                raise ValueError(f"{found.group()} is not a character")
            return chr(code)
        if char not in ESCAPED:
            raise ValueError(f"unknown escape \\{char}")
        return ESCAPED[char]

    return ESCAPE.sub(one, text) if "\\" in text else text


class TurtleReader:
    """Triples of one Turtle document: prefixes, predicate and object lists, literals, nested blank nodes."""

    def __init__(self, content: str):
        self.tokens = self._tokens(content)
        self.at = 0
        self.prefixes: dict[str, str] = {}
        self.blanks = 0
        self.triples: list[tuple[str, str, str, str]] = []

    @staticmethod
    def _tokens(content: str) -> list[tuple[str, str]]:
        found, at = [], 0
        while at < len(content):
            match = TOKEN.match(content, at)
            if match is None:
                raise ValueError(f"unexpected character at offset {at}")
            if match.lastgroup != "skip":
                found.append((match.lastgroup, match.group()))
            at = match.end()
        return found

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _next(self, expected: str | None = None) -> tuple[str, str]:
        token = self._peek()
        if token[0] == "end" or (expected and token[1] != expected):
            raise ValueError(f"expected {expected or 'a term'} before token {self.at}")
        self.at += 1
        return token

    def read(self) -> list[tuple[str, str, str, str]]:
        while self.at < len(self.tokens):
            kind, word = self._peek()
            if word == "@prefix" or (kind == "word" and word.upper() == "PREFIX"):
                self.at += 1
                name = self._next()[1]
                iri = self._next()
                if not name.endswith(":") or iri[0] != "iri":
                    raise ValueError("malformed prefix declaration")
                self.prefixes[name[:-1]] = iri[1][1:-1]
                if word == "@prefix":
                    self._next(".")
                continue
            if word == "[":
                subject = self._blank()
                if self._peek()[1] != "]":
                    self._predicates(subject, "]")
                self._next("]")
                if self._peek()[1] != ".":
                    self._predicates(subject, ".")
            else:
                subject, subject_kind = self._term()
                if subject_kind == LITERAL:
                    raise ValueError("a literal cannot be a subject")
                self._predicates(subject, ".")
            self._next(".")
        return self.triples

    def _blank(self) -> str:
        """A new node at an opening bracket."""
        self._next("[")
        self.blanks += 1
        return f"_:anon{self.blanks}"

    def _verb(self) -> str:
        if self._peek() == ("word", "a"):
            self.at += 1
            return RDF_TYPE
        predicate, kind = self._term()
        if kind != IRI:
            raise ValueError("a predicate has to be an IRI")
        return predicate

    def _predicates(self, subject: str, end: str) -> None:
        """Predicates and objects of a subject up to its end mark, which stays.

        Nodes in brackets may nest to any depth; the subjects that wait for them are kept in a list.
        """
        waiting: list[tuple[str, str, str]] = []
        predicate = self._verb()
        while True:
            if self._peek()[1] == "[":
                node = self._blank()
                self.triples.append((subject, predicate, node, BLANK))
                if self._peek()[1] != "]":
                    waiting.append((subject, predicate, end))
                    subject, end, predicate = node, "]", self._verb()
                    continue
                self._next("]")
            else:
                self.triples.append((subject, predicate, *self._term()))
            while True:  # what follows an object
                mark = self._peek()[1]
                if mark == ",":
                    self.at += 1
                    break
                while self._peek()[1] == ";":
                    self.at += 1
                if mark == ";" and self._peek()[1] != end:
                    predicate = self._verb()
                    break
                if not waiting:
                    return
                self._next(end)
                subject, predicate, end = waiting.pop()

    def _term(self) -> tuple[str, str]:
        kind, word = self._next()
        if kind == "iri":
            return word[1:-1], IRI
        if kind == "name":
            prefix, _, local = word.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"prefix {prefix!r} is not declared")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), IRI
        if kind == "node":
            return word, BLANK
        if kind in ("text", "long"):
            quote = 3 if kind == "long" else 1
            value = _unescape(word[quote:-quote])
            if self._peek()[0] == "at":
                self.at += 1
            elif self._peek()[0] == "type":
                self.at += 1
                self._term()
            return value, LITERAL
        if kind == "number" or (kind == "word" and word in ("true", "false")):
            return word, LITERAL
        raise ValueError(f"unexpected {word!r}")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of the batches, about `BYTES_AT_ONCE` at a time."""
    for batch in batches:
        rows = max(batch.num_rows * BYTES_AT_ONCE // max(batch.nbytes, 1), 1)
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows).to_pandas(integer_object_nulls=True)


def _read_batches(batches: Iterator[pd.DataFrame], wanted: frozenset[str] | None = None) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, content in zip(batch["request_key"], batch["content"]):
            if content is None or not content.strip():
                rows.append((key, None, None, None, None, "The RDF content is empty"))
                continue
            try:
                found = TurtleReader(content).read()
                rows += [(key, *triple, None) for triple in found if wanted is None or triple[1] in wanted]
            except Exception as problem:  # noqa: BLE001  one unreadable payload must not stop the others
                rows.append((key, None, None, None, None, f"The RDF content is not valid Turtle: {problem}"))
        yield pd.DataFrame(rows, columns=["request_key", "s", "p", "o", "o_kind", "error"])


def triples(payloads: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """One row per triple of each (request_key, content), or one row with an error; only `wanted` predicates, if given.

    Payloads are dealt out by key first: long ones often lie together, and would be read by one task in batches of long ones.
    """
    kept = None if wanted is None else frozenset(wanted)
    layout = pa.schema([("request_key", pa.int64()), *((c, pa.string()) for c in ("s", "p", "o", "o_kind", "error"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _read_batches(_pieces(batches), kept):
            yield pa.RecordBatch.from_pandas(found, layout, preserve_index=False)

    dealt = payloads.select("request_key", "content").repartition(task_slots(payloads.sparkSession), "request_key")
    return dealt.mapInArrow(read, TRIPLE_SCHEMA)


def _has_type(rdf_type: str) -> Callable[[Column], Column]:
    return lambda subject: F.array_contains(subject["types"], rdf_type)


def attributes(requests: DataFrame, graph: DataFrame, hops: list[Hop]) -> DataFrame:
    """Fields of each request's entity, or an error.

    `requests` has request_key and entity_type.  The subject is the smallest one of the mapped class, and a step
    with several objects takes the smallest, so results do not depend on row order.  A missing step gives NULL.
    """
    fields = sorted({h.field for h in hops if h.field is not None})
    types = {h.entity_type: h.iri for h in hops if h.field is None}
    # one pass, as the reader would run once for each; an unreadable payload has one row, with neither subject nor predicate
    facts = (
        graph.repartition("request_key")
        .groupBy("request_key", "s", "p")
        .agg(
            F.min("o").alias("o"),
            F.collect_set(F.when(F.col("p") == RDF_TYPE, F.col("o"))).alias("types"),
            F.collect_list("error").alias("errors"),
        )
        .groupBy("request_key")
        .agg(
            F.map_from_entries(
                F.collect_list(F.when(F.col("s").isNotNull(), F.struct(F.struct("s", "p").alias("key"), F.col("o").alias("value"))))
            ).alias("facts"),
            F.sort_array(
                F.collect_list(F.when(F.size("types") > 0, F.struct("s", "types")))
            ).alias("typed"),
            F.flatten(F.collect_list("errors")).alias("errors"),
        )
    )
    known = requests.join(facts, "request_key", "left").withColumn("error", F.explode_outer("errors"))
    subject, values = F.lit(None).cast("string"), {field: F.lit(None).cast("string") for field in fields}
    for entity_type, rdf_type in types.items():
        applies = F.col("entity_type") == entity_type
        found = F.try_element_at(F.filter("typed", _has_type(rdf_type)), F.lit(1))["s"]
        subject = F.when(applies, found).otherwise(subject)
        for field in {h.field for h in hops if h.entity_type == entity_type and h.field is not None}:
            node = found
            for step in sorted((h for h in hops if (h.entity_type, h.field) == (entity_type, field)), key=lambda h: h.hop):
                at = F.struct(node.alias("s"), F.lit(step.iri).alias("p"))
                node = F.lit(None).cast("string") if step.iri is None else F.try_element_at("facts", at)
            values[field] = F.when(applies, node).otherwise(values[field])
    error = (
        F.when(~F.coalesce(F.col("entity_type").isin(*types), F.lit(False)),
               F.concat(F.lit("No mapping is configured for entity type "), F.coalesce("entity_type", F.lit("NULL"))))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(subject.isNull(), F.lit("The RDF content holds no entity of the mapped type"))
    )
    return known.select(*requests.columns, *[values[f].alias(f) for f in fields], error.alias("mapping_error"))


def turtle_mapper(hops: list[Hop]) -> Callable[[DataFrame], DataFrame]:
    """Mapper of Turtle payloads: (request_key, entity_type, content) to request_key, fields and mapping_error.

    Any function of this form can take its place for other payloads.  Only triples that some path needs leave the reader.
    """
    wanted = {RDF_TYPE} | {h.iri for h in hops if h.field is not None and h.iri is not None}

    def run(payloads: DataFrame) -> DataFrame:
        graph = triples(payloads, wanted)
        return attributes(payloads.select("request_key", "entity_type"), graph, hops).drop("entity_type")

    return run
