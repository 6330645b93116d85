"""N-Triples payloads as tables, by Spark's own functions only: no Python worker reads a line.

Lines are independent, so a bad one is an error row and the others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.sources.rdf import BLANK, IRI, LITERAL

# Fixed values of the format: escapes of one letter, and code points in hexadecimal (no surrogates, none beyond U+10FFFF).
LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
CODE_POINT = r"u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|U(?!0000[dD][89a-fA-F])00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
ESCAPE = rf"""\\(?:[tbnrf"'\\]|{CODE_POINT})"""
IRI_PATTERN = r'<([^\x00-\x20<>"{}|^`]*)>'
BLANK_PATTERN = r"_:([\p{L}\p{N}_](?:[\p{L}\p{N}_.-]*[\p{L}\p{N}_-])?)"
SUFFIX = r"(?:\^\^<[^\x00-\x20<>]+>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?"
START = rf"^[ \t]*(?:{IRI_PATTERN}|{BLANK_PATTERN})[ \t]*{IRI_PATTERN}[ \t]*"
END = r"[ \t]*\.[ \t]*(?:#.*)?$"
NODE = rf"{START}(?:{IRI_PATTERN}|{BLANK_PATTERN}){END}"


def unescaped(text: Column) -> Column:
    """Text with its escapes replaced; only for text whose escapes are `sound`."""
    pieces = F.regexp_extract_all(text, F.lit(r"\\u.{4}|\\U.{8}|\\.|[^\\]+"), F.lit(0))
    letters = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])

    def decoded(piece: Column) -> Column:
        kind, rest = F.substring(piece, 2, 1), F.unhex(F.substr(piece, F.lit(3)))
        return (
            F.when(~F.startswith(piece, F.lit("\\")), piece)
            .when(kind == "u", F.decode(rest, "UTF-16BE"))
            .when(kind == "U", F.decode(rest, "UTF-32"))
            .otherwise(F.try_element_at(letters, kind))
        )

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def sound(text: Column) -> Column:
    """Whether every backslash begins an escape and no quotation mark is left."""
    return ~F.regexp_replace(text, ESCAPE, "").rlike(r'["\\]')


def escaped(text: Column) -> Column:
    """A literal's content with the escapes it needs."""
    for letter in ("\\", '"', "\n", "\r"):
        name = next(n for n, value in LETTERS.items() if value == letter)
        text = F.replace(text, F.lit(letter), F.lit("\\" + name))
    return text


def triples(payloads: DataFrame) -> DataFrame:
    """One row per line of each (request_key, content): request_key, line (from 1), s, p, o, o_kind, or an error.

    Empty lines and comments have no row, and neither have null contents.  Language tags and types of literals are checked
    for their form only.
    """
    lines = payloads.select("request_key", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("line", "text"))
    lines = lines.where(~F.col("text").rlike(r"^[ \t]*(?:#.*)?$")).withColumn("line", F.col("line") + 1)
    # a literal ends at the first mark behind which the line can end, unless that leaves an open escape
    literals = [rf'{START}"({body})"{SUFFIX}{END}' for body in (".*?", ".*")]
    bodies = [F.regexp_extract("text", pattern, 4) for pattern in literals]
    shown = F.when(sound(bodies[0]), bodies[0]).when(sound(bodies[1]), bodies[1])
    literal, node = F.col("text").rlike(literals[0]), F.col("text").rlike(NODE)
    parts = [F.regexp_extract("text", NODE, i) for i in range(1, 6)]
    subject = [F.when(node, parts[i]).otherwise(F.regexp_extract("text", literals[0], i + 1)) for i in range(3)]
    read = lines.select(
        "request_key",
        "line",
        subject[0].alias("s_iri"),
        subject[1].alias("s_blank"),
        subject[2].alias("p"),
        F.when(node, F.when(parts[4] != "", parts[4]).otherwise(parts[3])).when(literal, shown).alias("o"),
        F.when(node & (parts[4] != ""), BLANK).when(node, IRI).when(literal, LITERAL).alias("o_kind"),
    )
    iris = sound(F.col("s_iri")) & sound(F.col("p")) & ((F.col("o_kind") != IRI) | sound(F.col("o")))
    good = F.coalesce(F.col("o").isNotNull() & iris, F.lit(False))
    named = F.when(F.col("s_blank") != "", F.concat(F.lit("_:"), "s_blank")).otherwise(unescaped(F.col("s_iri")))
    value = F.when(F.col("o_kind") == BLANK, F.concat(F.lit("_:"), "o")).otherwise(unescaped(F.col("o")))
    problem = F.concat(F.lit("Line "), F.col("line").cast("string"), F.lit(" is not valid N-Triples"))
    return read.select(
        "request_key",
        "line",
        F.when(good, named).alias("s"),
        F.when(good, unescaped(F.col("p"))).alias("p"),
        F.when(good, value).alias("o"),
        F.when(good, F.col("o_kind")).alias("o_kind"),
        F.when(~good, problem).alias("error"),
    )
