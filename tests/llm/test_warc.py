import gzip
import hashlib

from pyspark.sql import functions as F

from driftscope.llm import warc
from driftscope.llm.files import open_file
from driftscope.llm.scratch import Scratch

LONG = "<p>" + "many words " * 200_000
PAGES = [
    (5, "http://www.example.com/a", "x" * 100), (3, "http://b.example.org/?q=1", "x" * 100), (9, None, "x" * 100),
    (1, "https://www.example.com/a#t", "y" * 99), (2, "https://www.example.com/a", "y" * 99),
    (4, "no scheme\nat all", None), (6, "http://ü.example/", ""), (7, "http://example.com", LONG),
    (7, "http://example.com", LONG), (None, "http://example.com", LONG), (8, "http://example.com", "é" * 60),
]


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same) if len(data) >= 100 and same else page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if first == page else "revisit",
                    None if first == page else first))
    return sorted(out, key=str)


def archive(spark, rows, parts=3):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr(
        "*", "1 AS key", "2 AS digest", "3 AS refers_to").repartition(parts)
    scratch = Scratch(spark, "t")
    ranges = warc.write_archives(scratch, pages)
    wanted = pages.select(warc.url_key(F.col("url")).alias("key"), "page_id")
    return scratch, ranges, wanted


def test_round_trip(spark):
    scratch, ranges, wanted = archive(spark, PAGES)
    rows = warc.lookup(scratch, ranges, wanted, with_payload=True).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == expected(PAGES)
    payload = {r.page_id: bytes(r.payload) for r in rows}
    assert payload[3] == b"x" * 100 and payload[5] == b"" and payload[7] == LONG.encode() and payload[4] == b""
    absent = spark.createDataFrame([("com,example)/", 7), ("zz", 1), ("", 99)], "key string, page_id bigint")
    assert warc.lookup(scratch, ranges, absent).count() == 0


def test_index_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "INDEX_BLOCK", 4)
    folder = Scratch(spark, "t").path
    writer = warc._Writer(folder, "part-0")
    keys = [("a", i) for i in range(9)] + [("b", None), ("b", 1), ("b", 1), ("b", 1), ("b", 1), ("b", 1), ("c", 2)]
    for n, (key, page) in enumerate(keys):
        writer.add(key, page, warc.record(page, key, b"%d" % n, hashlib.sha256(b"%d" % n).hexdigest(), None), "response")
    writer.finish()
    index = warc.CaptureIndex(folder, [("a", "0", "part-0")])
    for n, (key, page) in enumerate(keys):
        skip = sum(k == (key, page) for k in keys[:n])
        assert warc.parse_record(index.find(key, "" if page is None else str(page), skip))["payload"] == b"%d" % n
    assert index.find("b", "1", 5) is None and index.find("b", "2") is None and index.find("", "") is None
    with open_file(f"{folder}/part-0.dir") as source:
        assert source.read_at(source.size(), 0).count(b"\n") == 4
    with open_file(f"{folder}/part-0.warc.gz") as source:
        assert gzip.decompress(source.read_at(source.size(), 0)).count(b"WARC/1.1\r\n") == len(keys)


def test_keys(spark):
    urls = [("http://WWW.Example.com/a?b#c",), ("x",), (None,), ("http://h",), ("a://b://c d",)]
    got = [r.k for r in spark.createDataFrame(urls, "u string").select(warc.url_key(F.col("u")).alias("k")).collect()]
    assert got == ["com,example,www)/a?b#c", "x", "", "h)", "b:)//c+d"]


def test_no_pages(spark):
    scratch, ranges, wanted = archive(spark, [])
    assert ranges.count() == 0 and warc.lookup(scratch, ranges, wanted).count() == 0


def test_place_in_several_ranges(spark):
    """Rows without id and URL, and of one id and URL, with different html: more than a range holds."""
    rows = [(page, url, f"<p>{n % 150}" + "x" * 100) for page, url in ((None, None), (7, "http://example.com"))
            for n in range(200)]
    scratch, ranges, wanted = archive(spark, rows)
    assert ranges.groupBy("first_key", "first_id").count().where("count > 1").count() > 0
    exact = spark.createDataFrame(rows, "page_id bigint, url string, html string").select(
        warc.url_key(F.col("url")).alias("key"), "page_id", warc.payload_digest(F.col("html")).alias("digest"))
    for places in (wanted, exact):
        assert sorted((tuple(r) for r in warc.lookup(scratch, ranges, places).collect()), key=str) == expected(rows)
