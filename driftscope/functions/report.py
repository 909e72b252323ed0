"""Expressions shared by the reports: guarded division, rounding, pair texts.

They are SQL texts, for use with ``selectExpr`` and ``F.expr``: a report has
hundreds of them, and one text is one call into the JVM.
"""

from __future__ import annotations

TOTAL = "decimal(38,6)"
RATIO = "decimal(19,6)"
SHOWN = "decimal(38,2)"
SHOWN_RATIO = "decimal(19,2)"


def weighted_average(total: str, executions: str) -> str:
    """total / executions, 0 where nothing was executed."""
    return f"coalesce(cast({total} / nullif({executions}, 0) AS {TOTAL}), cast(0 AS {TOTAL}))"


def shown(value: str, as_type: str = SHOWN) -> str:
    """Two places, halves away from zero."""
    return f"cast(round({value}, 2) AS {as_type})"


def pair_text(low: str, high: str) -> str:
    """``low - high`` with ``?`` for a missing side."""
    return f"concat(coalesce(cast({low} AS string), '?'), ' - ', coalesce(cast({high} AS string), '?'))"


def hex_digits(value: str) -> str:
    """Binary as ``0x`` and upper-case hex digits."""
    return f"concat('0x', hex({value}))"


def flag_text(flags: list[tuple[str, str]]) -> str:
    """Concatenate ``NAME;`` for every condition that holds, in list order."""
    return "concat(" + ", ".join(f"if({condition}, '{name};', '')" for condition, name in flags) + ")"


def flag_list(text: str) -> str:
    """The names in a flag text as an array."""
    return f"filter(split({text}, ';'), name -> name != '')"
