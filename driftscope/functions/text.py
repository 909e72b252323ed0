"""Statement texts: normalised form, samples, hashes, statement type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The statement keywords looked for in a text.
STATEMENT_KEYWORDS = ("SELECT", "INSERT", "UPDATE", "DELETE")


def spaced(text: Column) -> Column:
    """Carriage return, line feed and tab each become one space."""
    return F.translate(text, "\r\n\t", "   ")


def head(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters, or the whole text for None."""
    return text if chars is None else F.substring(text, 1, chars)


def normalize(text: Column, chars: int | None = None, compact: bool = False) -> Column:
    """Lower case, control white space as spaces, outer spaces removed.

    Runs of spaces stay as they are unless ``compact`` is set.
    """
    cleaned = F.lower(F.trim(spaced(text)))
    if compact:
        cleaned = F.regexp_replace(cleaned, " {2,}", " ")
    return head(cleaned, chars)


def text_digest(text: Column, charset: str = "UTF-16LE") -> Column:
    """SHA-256 of the text's bytes in ``charset``, as binary."""
    return F.unhex(F.sha2(F.encode(text, charset), 256))


def hex_text(value: Column) -> Column:
    """Binary as ``0x`` and upper-case hex digits."""
    return F.concat(F.lit("0x"), F.hex(value))


def without_parameter_block(text: Column, chars: int | None = None) -> Column:
    """Drop a leading ``( … )`` up to its first closing parenthesis."""
    raw = F.ltrim(spaced(head(text, chars)))
    close = F.instr(raw, ")")
    return F.when(
        raw.startswith("(") & (close > 0),
        F.ltrim(F.substr(raw, close + F.lit(1))),
    ).otherwise(raw)


def statement_type(text: Column, chars: int | None = None) -> Column:
    """The keyword that occurs first in the text, wherever it is; else NULL."""
    upper = F.upper(without_parameter_block(text, chars))
    found = F.array(*[
        F.struct(F.nullif(F.instr(upper, word), F.lit(0)).alias("pos"), F.lit(word).alias("word"))
        for word in STATEMENT_KEYWORDS
    ])
    first = F.array_min(F.filter(found, lambda candidate: candidate["pos"].isNotNull()))
    return first["word"]
