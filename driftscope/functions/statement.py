"""Captured statements: what they are and how they are run again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event names, kinds and the statement of a connection reset.
RPC_EVENT = "rpc_completed"
BATCH_EVENT = "sql_batch_completed"
SP = "SP"
ADHOC = "ADHOC"
RESET_STATEMENT = "exec sp_reset_connection"
RESET_NAME = "sp_reset_connection"
DYNAMIC_SQL_NAME = "sp_executesql"
LEADING_WORD_THEN_EXEC = r"(?i)\S+\s+exec"
QUOTED_VALUE = r"(?i)^N?'"
ALL_DIGITS = r"^\d+$"

_BLANKS = " \t\r\n"


def _is(column: Column, word: str) -> Column:
    """Equal without regard to case; never NULL."""
    return F.lower(column).eqNullSafe(F.lit(word))


def is_rpc() -> Column:
    return _is(F.col("event_name"), RPC_EVENT)


def is_batch() -> Column:
    return _is(F.col("event_name"), BATCH_EVENT)


def event_text() -> Column:
    """A batch event has its text in another column than a call."""
    return F.when(is_batch(), F.col("batch_text")).otherwise(F.col("statement"))


def is_reset() -> Column:
    """Exactly the reset statement and nothing more."""
    return _is(event_text(), RESET_STATEMENT)


def mentions_reset() -> Column:
    """The name of the reset procedure occurs somewhere; never NULL. Few events pass, so what costs more comes after it."""
    return F.coalesce(F.contains(F.lower(event_text()), F.lit(RESET_NAME)), F.lit(False))


def kind() -> Column:
    """SP for a plain procedure call, ADHOC for any other text."""
    return (
        F.when(is_batch(), F.lit(ADHOC))
        .when(_is(F.col("object_name"), DYNAMIC_SQL_NAME), F.lit(ADHOC))
        .when(F.coalesce(F.col("statement").rlike(LEADING_WORD_THEN_EXEC), F.lit(False)), F.lit(ADHOC))
        .otherwise(F.lit(SP))
    )


def procedure_name(statement: Column) -> Column:
    """The second of the words between single spaces, without closing semicolons."""
    return F.rtrim(F.get(F.split(statement, " ", 3), 1), F.lit(";"))


def procedure_arguments(statement: Column) -> Column:
    """``name = value`` parts of a call, as structs in their order.

    The text after the procedure name is cut at every comma and then at every
    equals sign, also inside quoted values; only parts with exactly one equals
    sign count.
    """
    name = procedure_name(statement)
    rest = F.btrim(F.substr(statement, F.position(name, statement) + F.length(name)), F.lit(_BLANKS))
    halves = F.transform(F.split(rest, ","), lambda part: F.split(part, "="))
    pairs = F.filter(halves, lambda half: F.size(half) == 2)
    return F.transform(pairs, lambda half: F.struct(
        F.btrim(half[0], F.lit(_BLANKS)).alias("name"), F.btrim(half[1], F.lit(_BLANKS)).alias("value"),
    ))


def quoted(value: Column) -> Column:
    """Quoted text and whole numbers stay, everything else becomes N'…'."""
    plain = value.rlike(QUOTED_VALUE) | value.rlike(ALL_DIGITS)
    return F.when(plain, value).otherwise(F.concat(F.lit("N'"), value, F.lit("'")))


def rewritten_call(statement: Column) -> Column:
    arguments = F.transform(
        procedure_arguments(statement),
        lambda a: F.concat(a["name"], F.lit("="), quoted(a["value"])),
    )
    return F.concat(F.lit("exec "), procedure_name(statement), F.lit(" "), F.array_join(arguments, ", "))


def rewritten_batch(text: Column) -> Column:
    return F.rtrim(text, F.lit(";"))
