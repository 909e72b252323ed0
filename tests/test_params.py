import datetime as dt
from decimal import Decimal

import pytest

from driftscope.params import CompareParams, ParameterError, check_table_name


def test_defaults():
    p = CompareParams()
    assert (p.metric, p.group_by, p.statement_type) == ("LogicalReads", "QueryHash", "ALL")
    assert (p.min_exec, p.min_ratio, p.top_n, p.sample_chars) == (100, Decimal("1.25"), None, None)


@pytest.mark.parametrize("name, value", [
    ("metric", "Reads"), ("group_by", "Hash"), ("statement_type", "MERGE"), ("statement_type", None),
    ("charset", "latin1"), ("only_multi_plan", 2), ("min_exec", -1), ("top_n", 1.5), ("key_chars", 0),
    ("sample_chars", 0), ("split_by_hash", 2),
])
def test_rejected(name, value):
    with pytest.raises(ParameterError) as error:
        CompareParams(**{name: value})
    assert error.value.name == name


def test_end_must_follow_start():
    moment = dt.datetime(2025, 1, 1)
    with pytest.raises(ParameterError, match="later than start"):
        CompareParams(start=moment, end=moment)


def test_statement_type_is_trimmed_and_upper_cased():
    assert CompareParams(statement_type=" select ").statement_type == "SELECT"


def test_ratio_has_four_places():
    assert CompareParams(min_ratio=1.23456).min_ratio == Decimal("1.2346")
    assert CompareParams(min_ratio=None).min_ratio is None


@pytest.mark.parametrize("name", ["", "one", "a.b.c", ".b", "a. "])
def test_table_name_needs_two_parts(name):
    with pytest.raises(ParameterError):
        check_table_name(name)
    assert check_table_name("a.b") == "a.b"
