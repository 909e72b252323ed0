import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from driftscope.llm import alignment, queries
from driftscope.llm.scratch import Scratch
from tests.llm.conftest import ROWS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def spans(text):
    """Tokens of both tokenizers with their bytes, from whole texts; none if they don't give the text back."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not spans.__dict__:
        spans.a, spans.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        spans.a.encode_special_tokens = True
    if not text:
        return [], []
    byte = alignment._byte_level()
    a = spans.a.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(byte[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
    two = []
    for i in spans.b.encode(text):
        p = spans.b.id_to_piece(i)
        two.append((i, bytes([int(p[3:5], 16)]) if spans.b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (one, two) if b"".join(x for _, x in one) == want == b"".join(x for _, x in two) else ([], [])


def brute(texts):
    found, corpus = [], Counter()
    for text in texts:
        sides, ranges = spans(text), []
        for side in sides:
            at, out = 0, []
            for i, data in side:
                out.append((i, at, at + len(data)))
                at += len(data)
            ranges.append(out)
        links = [(x, y) for x, s, e in ranges[0] for y, t, f in ranges[1] if s < f and t < e]
        corpus.update(links)
        ends = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        parts, start = [], 0
        for end in ends:
            parts.append("|".join(",".join(str(i) for i, s, e in side if start < e <= end) for side in ranges))
            start = end
        found.append((len(ranges[0]), len(ranges[1]), len(ends), links,
                      hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""))
    top = Counter()
    for (_, b), n in corpus.items():
        top[b] = max(top[b], n)
    return [(a, b, g, len(links), sum(corpus[x] == top[x[1]] for x in links), sum(corpus[x] for x in links), digest)
            for a, b, g, links, digest in found], corpus


TEXTS = [None, "", " ", "a", "foo  bar", "foo bar ", " lead", "x\n y\n\nz", "tab\there \t end", "<|endoftext|> and <s> <0x41>",
         "under▁score is not given back", "été naïve 中文字 \U0001f600\U0001f600", "nbsp  x 　y",
         "the the the the the the the", "the the the the the the the", "1234567 89,012.5%", "no\x00zero\x1c x", "ﬁ ﬁle",
         "word " * 300, "q" * 5000]


def test_equal_to_links_of_whole_texts(spark):
    pick = random.Random(5)
    letters = "ab  \n\téé.,'1  中the"
    texts = TEXTS + ["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    want, corpus = brute(texts)
    documents, pairs = alignment.align(docs, A, B)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in documents.collect()}
    assert got == dict(enumerate(want))
    assert {(r.a, r.b): r.links for r in pairs.collect()} == corpus


def test_small_chunks_give_the_same(spark):
    texts = ["the cat of the house", "of the cat", None, "house house house"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    want, _ = brute(texts)
    index = alignment.pair_index(docs, A, B)
    assert index.where("place IS NULL").select("chunk").distinct().count() == 1
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.scored_documents(Scratch(spark, "t"), index).collect()}
    assert got == dict(enumerate(want))
    # the same slices, in chunks of 16
    chunks, rows = [alignment._Chunk(0)], []
    for at in range(0, 120, 8):
        if chunks[-1].documents == 16:
            chunks.append(alignment._Chunk(len(chunks)))
        _, places = alignment._of_slice(alignment._aligner(A, B), pa.array(texts[at:at + 8]))
        chunks[-1].add(*places, 8)
    for chunk in chunks:
        for batch in chunk.postings():
            rows += batch.to_pylist()
    links = Counter()
    for r in rows:
        links[r["a"], r["b"]] += r["links"]
        planes = list(alignment.read_planes(r["planes"], r["universe"]))
        assert sum(len(p) << j for j, p in enumerate(planes)) == r["links"]
        assert len(set(np.concatenate(planes).tolist())) == r["documents"]
    assert links == brute(texts)[1]


@pytest.mark.parametrize("universe", [1, 9, 5000])
def test_planes_return_what_was_packed(universe):
    draw = np.random.default_rng(universe)
    for share in (0.01, 0.3, 1):
        places = np.flatnonzero(draw.random(universe) <= share)
        if len(places):
            times = draw.integers(1, 70, len(places))
            back = np.zeros(universe, np.int64)
            for j, some in enumerate(alignment.read_planes(alignment.pack_planes(places, times, universe), universe)):
                back[some] += 1 << j
            assert (back[places] == times).all() and back.sum() == times.sum()


def test_odd_rows(spark, odd, none):
    documents, _ = alignment.align(odd, A, B)
    assert documents.count() == len(ROWS)
    short = [r[1] for r in ROWS if r[0] != 5]
    documents, _ = alignment.align(odd.where("doc_id IS NULL OR doc_id <> 5"), A, B)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in documents.collect()) == sorted(brute(short)[0])
    documents, pairs = alignment.align(none, A, B)
    assert documents.count() == 0 == pairs.count()


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    some = queries.op12_tokenizer_alignment(spark, sf).collect()
    assert sorted(r.doc_id for r in some) == sorted(texts)
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    assert all(r.n_a == len(a.encode(" " + texts[r.doc_id]).ids) for r in some if texts[r.doc_id])
