"""Column expressions over names, identifiers and Turtle literals."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALISED_SUFFIX = "_norm"
KEEP_LETTERS_AND_DIGITS = r"[^\p{L}\p{N}]"
CAPITAL_SIGMA, SIGMA = "Σ", "σ"
# Code points searched for accents, and the Hangul syllables, which keep their form.
ACCENT_RANGE = range(0x80, 0x30000)
HANGUL_SYLLABLES = range(0xAC00, 0xD7A4)


@cache
def accent_tables() -> tuple[str, str]:
    """Accented characters and their base letters, from the canonical decompositions of Unicode."""
    accented, plain = [], []
    for code in ACCENT_RANGE:
        if code in HANGUL_SYLLABLES or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        bases = [part for part in parts if not unicodedata.category(part).startswith("M")]
        if len(bases) == 1:
            accented.append(char)
            plain.append(bases[0])
    return "".join(accented), "".join(plain)


def normalise_name(name: Column) -> Column:
    """Lower case, accents stripped, Unicode letters and digits only; an empty result is NULL."""
    accented, plain = accent_tables()
    # The JVM lowers a word-final capital sigma to its final form; mapping it first keeps one form.
    lowered = F.lower(F.replace(name, F.lit(CAPITAL_SIGMA), F.lit(SIGMA)))
    stripped = F.when(name.rlike(r"[^\x00-\x7F]"), F.translate(lowered, accented, plain)).otherwise(F.lower(name))
    return F.nullif(F.regexp_replace(stripped, KEEP_LETTERS_AND_DIGITS, ""), F.lit(""))


def mention_id(source_id: Column, request_id: Column, entity_type: Column) -> Column:
    """Stable mention id: SHA-256 of the three identifiers, joined without a separator."""
    return F.sha2(F.concat(source_id, request_id, entity_type), 256)


def escape_turtle(value: Column) -> Column:
    """Escape a string for a Turtle literal; the backslash goes first."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def queue_wait_ms(created_at: Column, now: Column) -> Column:
    """Milliseconds between two timestamps, never negative; NULL when the creation time is unknown."""
    waited = (F.unix_micros(now) - F.unix_micros(created_at)) / F.lit(1000.0)
    return F.when(waited.isNotNull(), F.round(F.greatest(waited, F.lit(0.0)), 3))
