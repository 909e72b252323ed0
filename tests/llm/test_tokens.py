import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftscope.llm import tokens
from driftscope.llm.scratch import Scratch
from tests.llm.conftest import ROWS

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return tokens.PieceEncoder(PATH)


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@given(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(0, 300), max_size=60))
def test_code_round_trip(numbers):
    values = np.array(numbers, np.uint32)
    control, data = tokens.pack(values)
    assert (tokens.unpack(control, data, len(values)) == values).all()
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (n.bit_length() + 7) // 8) for n in numbers)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z9.,'’\n\t\r  \x1c\x85éß日🎉<|>") | st.characters(codec="utf-8"), max_size=40),
                max_size=6))
def test_pieces_give_the_ids_of_whole_texts(encoder, texts):
    got = encoder.encode(pa.array(texts, pa.string()), 2)
    assert [x.tolist() for x in got] == [plain(encoder, t) for t in texts]


def test_known_texts(encoder):
    texts = [None, "", " ", "a  b", "  lead", "trail  ", "x\n y", "don't  stop", "a<|endoftext|>b <|endoftext|> c", "one two",
             "word " * 5000]
    assert [x.tolist() for x in encoder.encode(pa.array(texts), 2)] == [plain(encoder, t) for t in texts]


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 50)
    small = tokens.PieceEncoder(PATH)
    for n in range(6):
        texts = [f"w{i} x{i} common words" for i in range(40 * n, 40 * n + 40)]
        assert [x.tolist() for x in small.encode(pa.array(texts), 2)] == [plain(small, t) for t in texts]
    assert len(small.number) <= 50 + 2 * 84


def test_files_round_trip(spark, encoder, odd, none):
    scratch = Scratch(spark, "t")
    written = tokens.write_tokens(odd, PATH, scratch)
    rows = tokens.read_tokens(spark, f"{scratch.path}/files", written, lambda ids: {"ids": ids.tolist()}, "ids array<bigint>").collect()
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted((d or 0, plain(encoder, t)) for d, t, *_ in ROWS)
    ordered, at = sorted(rows, key=lambda r: r.start), 0
    for r in ordered:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    ids = [r.doc_id for r in ordered]
    assert ids == [None, *sorted(i for i in ids if i is not None)]
    assert tokens.token_files(none, PATH).count() == 0


def test_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 7)
    docs = [(None, np.array([5], np.uint32)), (3, np.array([], np.uint32)), (3, np.arange(20, dtype=np.uint32)), (9, np.array([1, 2], np.uint32))]
    rank = np.arange(20, dtype=np.uint32)[::-1].copy()
    path = f"{tmp_path}/f"
    tokens.write_file(path, rank, iter(docs))
    assert tokens.file_totals(path) == (4, 23)
    got = [(i, flat.tolist()) for ids, lengths, flats in tokens.read_file(path, rank)
           for i, flat in zip(ids, np.split(flats, np.cumsum(lengths)[:-1]))]
    assert got == [(i, x.tolist()) for i, x in docs]
    assert tokens.ids_crc32(np.array([1, 2])) == {"ids_crc32": zlib.crc32(b"\1\0\0\0\2\0\0\0")}
