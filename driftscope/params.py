"""Parameters of one comparison, checked before any Spark job starts."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

# The accepted spellings of each choice parameter.
METRICS = ("LogicalReads", "CPU", "Duration")
GROUPINGS = ("QueryHash", "QueryText", "NormalizedText")
STATEMENT_TYPES = ("ALL", "SELECT", "INSERT", "UPDATE", "DELETE")
CHARSETS = ("UTF-16LE", "UTF-8")


class ParameterError(ValueError):
    """A rejected parameter; ``name`` says which one."""

    def __init__(self, name: str, message: str):
        super().__init__(f"{name}: {message}")
        self.name = name


@dataclass(frozen=True)
class CompareParams:
    """What to compare and what counts as a regression.

    ``charset`` is the encoding texts are hashed in; UTF-16LE gives the digests
    of a database that stores texts so.  ``key_chars`` cuts texts before
    they become a grouping key or are searched for a statement type; None (the
    default) uses whole texts, 4000 gives the keys
    of a database that cuts them there.  ``sample_chars`` is
    the length of the text shown in reports; None (the default) shows whole
    texts.  ``top_n`` limits the overview to so many rows; None keeps all.
    ``split_by_hash`` keeps the queries of a group apart by query hash, which
    then also has to agree between the sides; otherwise a side has one row per
    key, type and object name.
    """

    metric: str = "LogicalReads"
    group_by: str = "QueryHash"
    statement_type: str = "ALL"
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    min_exec: int | None = 100
    min_ratio: Decimal | float | str | None = Decimal("1.25")
    top_n: int | None = None
    include_adhoc: bool = True
    include_sp: bool = True
    only_multi_plan: bool = False
    split_by_hash: bool = False
    primary_replica_only: bool = False
    charset: str = "UTF-16LE"
    key_chars: int | None = None
    sample_chars: int | None = None
    compact: bool = False

    def __post_init__(self):
        _one_of("metric", self.metric, METRICS)
        _one_of("group_by", self.group_by, GROUPINGS)
        _one_of("charset", self.charset, CHARSETS)
        if self.statement_type is None:
            raise ParameterError("statement_type", "must not be None; use ALL for no filter")
        object.__setattr__(self, "statement_type", self.statement_type.strip().upper())
        _one_of("statement_type", self.statement_type, STATEMENT_TYPES)
        if self.start is not None and self.end is not None and self.end <= self.start:
            raise ParameterError("end", "must be later than start")
        for flag in ("include_adhoc", "include_sp", "only_multi_plan", "split_by_hash",
                     "primary_replica_only", "compact"):
            if getattr(self, flag) not in (True, False):
                raise ParameterError(flag, "must be true or false")
        for count in ("min_exec", "top_n"):
            value = getattr(self, count)
            if value is not None and (isinstance(value, bool) or int(value) != value or value < 0):
                raise ParameterError(count, "must be None or a whole number of at least 0")
        for length in ("key_chars", "sample_chars"):
            value = getattr(self, length)
            if value is None:
                continue
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ParameterError(length, "must be None or a positive whole number")
        if self.min_ratio is not None:
            # decimal(9,4), as the ratio threshold is declared
            ratio = Decimal(str(self.min_ratio)).quantize(Decimal("0.0001"))
            object.__setattr__(self, "min_ratio", ratio)


def check_table_name(name: str) -> str:
    """A results table needs a schema and a name: ``schema.table``."""
    parts = (name or "").split(".")
    if len(parts) != 2 or not all(part.strip() for part in parts):
        raise ParameterError("results_table", "must be a two-part name like analysis.regressions")
    return name


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ParameterError(name, f"{value!r} is not one of {', '.join(allowed)}")
