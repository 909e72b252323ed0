import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftscope.llm import langid
from tests.llm.conftest import ROWS


def phrases(sample, text, letters):
    """Greedy cuts into longest pieces of the sample, by searching it."""
    n = at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        at += max(1, size)
        n += 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(3)
    sample = "".join(rng.choice("abcd ") for _ in range(400)).replace("  ", " ")
    model = langid.fit({"x": [sample]})
    for _ in range(30):
        text = "a" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 150)))
        got = langid.entropies(model, [text])[0][0, 0] * len(text) / model.bits[0]
        assert round(got) == phrases(sample, text, model.letters)


def test_long_texts_are_read_in_stretches():
    model = langid.fit({"x": ["abcabc"], "y": ["xyzxyz"]})
    text = "abc" * 400_000 + "xyz" * 100_000
    entropy, letters = langid.entropies(model, [text, "xyz", None])
    assert letters.tolist() == [True, True, False]
    assert langid.predict(model, [text, "xyz", None]).lang.tolist() == ["x", "y", "und"]


@pytest.mark.parametrize("text, lang", [(None, "und"), ("", "und"), ("12 345 ###", "und"), ("\U0001d518\U0001d52b", "a"),
                                        ("日本", "a"), ("THE OF", "b")])
def test_odd_texts(text, lang):
    found = langid.predict(langid.fit({"a": ["le la les un une"], "b": ["the of and to is"]}), [text])
    assert found.lang[0] == lang and 0 <= found.score[0] <= 1


def test_nothing_learned():
    assert langid.predict(langid.fit({}), ["abc", None]).lang.tolist() == ["und", "und"]


def test_learns_from_usable_rows_only(spark):
    rows = [(i, "der die das und" if i % 2 else "the of and to", "de" if i % 2 else "en") for i in range(40)]
    rows += [(100 + i, "the of and to", "wrong") for i in range(40)] + [(200, "x", None), (None, "the of", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(docs, usable=F.coalesce(F.col("doc_id") < 100, F.lit(True)))
    assert model.languages == ["de", "en"]
    assert langid.learn(docs, max_languages=1).languages == ["wrong"]


def test_held_out(spark):
    ids = spark.range(50).unionByName(spark.createDataFrame([(None,)], "id bigint"))
    for r in ids.select("id", langid.is_held_out(F.col("id")).alias("held")).collect():
        text = "" if r.id is None else str(r.id)
        assert r.held == (zlib.crc32(text.encode()) % 4 == 2)


def test_held_out_accuracy(spark):
    from driftscope.llm.queries import op10_language_id
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op10_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_odd_rows(spark, odd, none):
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(
        d or 0 for d, t, *_ in ROWS if t and any(c.isalpha() for c in t))
    assert langid.keep_identified(none).count() == 0


def test_all_labels_are_learned(spark):
    draw = random.Random(2)
    words = [["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for _ in range(70)]
    rows = [(i, " ".join(draw.choice(words[i % 70]) for _ in range(40)), f"l{i % 70:02d}") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(docs)
    assert len(model.languages) == 70
    assert langid.predict(model, [r[1] for r in rows]).lang.tolist() == [r[2] for r in rows]


def test_clean_documents_stay_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "日本", None), (3, "12 3", None), (4, None, None)],
                                 "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in langid.keep_identified(docs).collect()) == [1, 2]


def test_ties_go_to_the_first_label():
    model = langid.fit({"b": ["one two three"], "a": ["one two three"]})
    assert langid.predict(model, ["two one", "three"]).lang.tolist() == ["a", "a"]
