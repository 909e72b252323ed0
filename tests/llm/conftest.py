from __future__ import annotations

import pytest

CLASHING = ("size", "shard", "slot", "fingerprint", "component_id", "copies", "target", "source_size", "position", "ids",
            "part", "host", "path", "rule", "verdict", "key", "digest", "words", "shingles", "text_hash", "node", "root",
            "h", "n", "id", "bucket", "score", "rank", "file", "start", "crc", "same")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
ROWS = [
    (1, "Of the and thing heron. Then onthe is in", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n ", "fr", "b"),
    (5, LONG, "en", "a"),
    (6, "Of the and thing heron. Then onthe is in", "en", "b"),
    (6, "Of the and thing heron. Then onthe is in", "en", "b"),
    (7, "12 345 ### --", "de", "\u00e9"),
    (None, "éle que la ou de les un été", "fr", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    return docs.selectExpr("*", *[f"cast(7 AS int) AS {c}" for c in CLASHING]).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
