"""Alignment of two tokenizers by inverted bitmaps of linked token ids.

Both tokenizers cut the same bytes, a space and then the text.  Where tokens of
both end, a group ends.  A token of A and a token of B are linked if their bytes
overlap; every stretch between two neighbouring token ends is one link.

For each pair of ids there is a posting per chunk of documents: a compressed
bitmap of the documents in which the pair is linked, and multiplicity planes,
plane ``j`` holding the documents whose number of links has bit ``j`` set.  Bitmaps
of the slices of a chunk are OR-merged as the chunk is filled.  Documents and
links of a pair are popcounts, added up over its postings, so a pair found in all
documents is many postings of bounded size and never one row or group.  The
postings then return each pair's score to the documents they hold.

Texts are tokenized by their different pieces: neither tokenizer joins a
character that isn't white space with a space behind it, so texts are cut before
such spaces, and both tokenizers end a token there.  Texts with other white space
before a space are one piece.

Null and empty texts, and texts whose tokens don't give the same bytes back, have
no tokens.  Rows with equal or no ids are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftscope.llm.scratch import Scratch, give_back_memory
from driftscope.llm.tokens import _SPACED

SLICE_BYTES, SLICE_ROWS = 3 << 20, 4096
CHUNK_DOCUMENTS, CHUNK_PLACES = 1 << 14, 2_000_000
_TOGETHER = 8192


# ---- bitmaps --------------------------------------------------------------------------------------------------------

def pack_planes(places: np.ndarray, times: np.ndarray, universe: int) -> bytes:
    """Compressed planes of one pair: ascending document numbers and how often each is linked.

    Planes in turn, from bit 0: how many documents (uint16, less one), then their
    numbers (uint16), or all bits of the universe where that is shorter; the
    highest bit of a leading byte says which.  Empty planes are a zero byte.
    """
    out, plane, dense = [], 0, -(-universe // 8)
    while True:
        some = places[times >> plane & 1 == 1] if plane or times.max() > 1 else places
        if not len(some):
            out.append(b"\0")
        elif 2 * len(some) + 2 > dense:
            bits = np.zeros(universe, bool)
            bits[some] = True
            out.append(b"\2" + np.packbits(bits, bitorder="little").tobytes())
        else:
            out.append(b"\1" + (len(some) - 1).to_bytes(2, "little") + some.astype("<u2").tobytes())
        plane += 1
        if not (times >> plane).any():
            return b"".join(out)


def read_planes(data: bytes, universe: int) -> Iterator[np.ndarray]:
    """The documents of each plane."""
    at, dense = 0, -(-universe // 8)
    while at < len(data):
        kind, at = data[at], at + 1
        if kind == 0:
            yield np.zeros(0, np.int64)
        elif kind == 1:
            n = int.from_bytes(data[at:at + 2], "little") + 1
            yield np.frombuffer(data, "<u2", n, at + 2).astype(np.int64)
            at += 2 + 2 * n
        else:
            yield np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, dense, at), bitorder="little"))
            at += dense


# ---- tokens of pieces -----------------------------------------------------------------------------------------------

@dataclass
class Pieces:
    """What both tokenizers make of pieces: counts by piece, texts of groups, links in the order of pieces."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    link: np.ndarray  # a << 32 | b
    whole: np.ndarray  # False where tokens don't give the piece back


class Aligner:
    """Two tokenizers and their pieces' alignment."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_a = _byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes_a[number] = bytes(bytes_a[c] for c in token) if all(c in bytes_a for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        # an id as it is written: inside its side of a group, and at the end of it
        self.text_a = np.array([[f"{i},", f"{i}|"] for i in range(len(self.bytes_a))], object)
        self.text_b = np.array([[f"{i},", f"{i};"] for i in range(len(self.bytes_b))], object)

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        """Texts start with a space, which the tokenizer adds itself."""
        found = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [ids if text != " " else [self.space] for ids, text in zip(found, texts)]

    def _encode(self, some: list[str], encode, size_of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces encoded as one text, and how many each has; None if the cuts don't fall on token ends."""
        ids = np.array(encode(["".join(some)])[0], np.int64)
        done = np.cumsum(size_of[ids])
        cut = np.searchsorted(done, ends)
        if not len(done) or cut[-1] >= len(done) or (done[cut] != ends).any():
            return None
        return ids, np.diff(cut + 1, prepend=0)

    def align(self, pieces: list[str]) -> Pieces:
        """Pieces start with a space; those that end in white space are encoded one by one."""
        parts, order = [], []
        plain = [i for i, p in enumerate(pieces) if not p[-1].isspace() and len(p) < 4096]
        for at in range(0, len(plain), _TOGETHER):
            rows = plain[at:at + _TOGETHER]
            some = [pieces[i] for i in rows]
            ends = np.cumsum([len(p.encode()) for p in some])
            a = self._encode(some, self._ids_a, self.size_a, ends)
            b = self._encode(some, self._ids_b, self.size_b, ends)
            parts.append(self._aligned(some, *a, *b) if a and b else self._one_by_one(some))
            order += rows
        rest = sorted(set(range(len(pieces))).difference(plain))
        for at in range(0, len(rest), _TOGETHER):
            parts.append(self._one_by_one([pieces[i] for i in rest[at:at + _TOGETHER]]))
            order += rest[at:at + _TOGETHER]
        back = np.argsort(order)
        counts = [np.concatenate([getattr(p, k) for p in parts])[back] for k in ("n_a", "n_b", "n_groups", "n_links", "whole")]
        groups = [g for p in parts for g in p.groups]
        n_links = np.concatenate([p.n_links for p in parts])
        first = np.cumsum(n_links) - n_links
        link = np.concatenate([p.link for p in parts])
        total = np.cumsum(n_links[back])
        place = np.arange(len(link)) - np.repeat(total - n_links[back], n_links[back])
        link = link[np.repeat(first[back], n_links[back]) + place]
        return Pieces(*counts[:4], [groups[i] for i in back.tolist()], link, counts[4])

    def _one_by_one(self, some: list[str]) -> Pieces:
        a, b = self._ids_a(some), self._ids_b(some)
        return self._aligned(some, *(np.array([i for x in a for i in x], np.int64), np.array([len(x) for x in a])),
                             *(np.array([i for x in b for i in x], np.int64), np.array([len(x) for x in b])))

    def _aligned(self, some: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> Pieces:
        data = [p.encode() for p in some]
        whole = self._whole(data, a, n_a, self.bytes_a) & self._whole(data, b, n_b, self.bytes_b)
        if not whole.all():
            a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
            n_a, n_b = n_a * whole, n_b * whole
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(end_a, end_b)
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = (end_a[of_a] == ends) & (end_b[of_b] == ends) if len(ends) else np.zeros(0, bool)
        shared = ends[both]
        last = np.cumsum(np.array([len(d) for d in data]) * whole)
        owner = np.searchsorted(last, ends)
        n_links = np.bincount(owner, minlength=len(some))
        n_groups = np.bincount(owner[both], minlength=len(some))
        # in the written groups each side's tokens stand before those of the other side's of later groups
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        of_group_a, of_group_b = (np.cumsum(np.bincount(g, minlength=len(shared))) for g in (group_a, group_b))
        text = np.empty(len(a) + len(b), object)
        before = np.concatenate([[0], of_group_b])
        text[np.arange(len(a)) + before[group_a]] = self.text_a[a, np.isin(end_a, shared).astype(int)]
        text[np.arange(len(b)) + of_group_a[group_b]] = self.text_b[b, np.isin(end_b, shared).astype(int)]
        text = text.tolist()
        edge = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        groups = ["".join(text[s:e]) for s, e in zip(edge, edge[1:])]
        return Pieces(n_a, n_b, n_groups, n_links, groups, a[of_a] << 32 | b[of_b], whole)

    @staticmethod
    def _whole(data: list[bytes], ids: np.ndarray, n: np.ndarray, token: list[bytes]) -> np.ndarray:
        found = [token[i] for i in ids.tolist()]
        if b"".join(found) == b"".join(data) and (np.cumsum([len(d) for d in data])
                                                  == np.cumsum([len(f) for f in found] or [0])[np.cumsum(n) - 1]).all():
            return np.ones(len(data), bool)
        edge = np.concatenate([[0], np.cumsum(n)]).tolist()
        return np.array([b"".join(found[s:e]) == d for s, e, d in zip(edge, edge[1:], data)], bool)


def _byte_level() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write bytes with.

    Printing characters of Latin-1 stand for themselves, other bytes for the characters from 256 on, in order.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# ---- chunks of documents --------------------------------------------------------------------------------------------

class _Chunk:
    """Bitmaps of up to ``CHUNK_DOCUMENTS`` documents, as ascending (pair, document) places with their links."""

    def __init__(self, number: int):
        self.number, self.documents, self.places, self.parts = number, 0, 0, []

    def add(self, pair: np.ndarray, document: np.ndarray, times: np.ndarray, documents: int) -> None:
        self.parts.append((pair, document + self.documents, times))
        self.documents += documents
        self.places += len(pair)

    def postings(self) -> Iterator[pa.RecordBatch]:
        pair, document, times = (np.concatenate(x) for x in zip(*self.parts))
        # slices hold different documents: the OR of their bitmaps is the union of the places
        order = np.lexsort((document, pair))
        pair, document, times = pair[order], document[order], times[order]
        start = np.flatnonzero(np.diff(pair, prepend=-1))
        if not len(start):
            return
        edge, links = [*start.tolist(), len(pair)], np.add.reduceat(times, start)
        for at in range(0, len(start), 20_000):
            some = range(at, min(at + 20_000, len(start)))
            planes = [pack_planes(document[edge[i]:edge[i + 1]], times[edge[i]:edge[i + 1]], self.documents) for i in some]
            key = pair[start[at:at + 20_000]]
            yield pa.record_batch({
                "chunk": pa.array(np.full(len(key), self.number)), "universe": pa.array(np.full(len(key), self.documents, np.int32)),
                "a": pa.array((key >> 32).astype(np.int32)), "b": pa.array((key & 0xFFFFFFFF).astype(np.int32)),
                "documents": pa.array(np.diff(edge[at:at + len(key) + 1])),
                "links": pa.array(links[at:at + len(key)]), "planes": pa.array(planes, pa.binary())})


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right"))
        stop = min(max(at + 1, stop), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def _of_slice(aligner: Aligner, texts: pa.Array) -> tuple[dict[str, np.ndarray | list], tuple]:
    """Per document counts and digests, and its (pair, document, links) places in ascending order."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(pc.binary_join_element_wise("", texts, " "), _SPACED)
    whole_texts = pc.and_(odd, pc.not_equal(texts, ""))
    words = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    edge = words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    pieces = [" " + w for w in coded.dictionary.to_numpy(zero_copy_only=False)]
    code = coded.indices.to_numpy().astype(np.int64)
    apart = np.flatnonzero(whole_texts.to_numpy(zero_copy_only=False))
    code[edge[apart]] = len(pieces) + np.arange(len(apart))
    pieces += [" " + t for t in texts.take(pa.array(apart)).to_pylist()]
    found = aligner.align(pieces)

    n = len(texts)
    document = np.repeat(np.arange(n), np.diff(edge))
    fine = np.bincount(document, ~found.whole[code], minlength=n) == 0
    fine &= pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    used = fine[document]
    code, document = code[used], document[used]
    counts = {k: np.bincount(document, getattr(found, k)[code], minlength=n).astype(np.int64)
              for k in ("n_a", "n_b", "n_groups", "n_links")}
    at = np.concatenate([[0], np.cumsum(np.bincount(document, minlength=n))]).tolist()
    group_of, digests, code_list = found.groups, [], code.tolist()
    for s, e in zip(at, at[1:]):
        text = "".join([group_of[i] for i in code_list[s:e]])
        digests.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
    # links of all documents: (pair, document) places, counted
    pair, pair_of = np.unique(found.link, return_inverse=True)
    n_links = found.n_links[code]
    total = np.cumsum(n_links)
    first = (np.cumsum(found.n_links) - found.n_links)[code]
    which = pair_of[np.repeat(first - (total - n_links), n_links) + np.arange(total[-1] if len(total) else 0)]
    place, times = np.unique(which * n + np.repeat(document, n_links), return_counts=True)
    return counts | {"groups_sha256": digests}, (pair[place // n], place % n, times)


_POSTING = [("chunk", T.LongType()), ("universe", T.IntegerType()), ("a", T.IntegerType()), ("b", T.IntegerType()),
            ("documents", T.LongType()), ("links", T.LongType()), ("planes", T.BinaryType())]
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def pair_index(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_column: str = "doc_id", text_column: str = "text",
               scratch: Scratch | None = None) -> DataFrame:
    """Written rows of two kinds: documents (``place`` in their chunk, id, counts, digest) and postings of pairs.

    Both kinds of a chunk come from one task's output, so places always fit.
    """
    scratch = scratch or Scratch(docs.sparkSession, "alignment")
    fields = [T.StructField(k, t) for k, t in _POSTING]
    fields += [T.StructField("place", T.IntegerType()), T.StructField("doc_id", docs.schema[id_column].dataType)]
    fields += [T.StructField(k, T.LongType()) for k in _COUNTS] + [T.StructField("groups_sha256", T.StringType())]
    schema = T.StructType(fields)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, turn, target = _aligner(tokenizer_a, tokenizer_b), TaskContext.get().partitionId(), 0, None
        chunk = _Chunk(part << 32)

        def full(columns: dict, rows: int) -> pa.RecordBatch:
            kinds = target.types
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, k)) for f, k in zip(fields, kinds)],
                                              schema=target)

        for batch in batches:
            if target is None:
                kind = batch.schema.field("doc_id").type
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), kind,
                         *[pa.int64()] * 4, pa.string()]
                target = pa.schema([(f.name, t) for f, t in zip(fields, types)])
            for some in _slices(batch):
                if chunk.documents and (chunk.documents + len(some) > CHUNK_DOCUMENTS or chunk.places > CHUNK_PLACES):
                    for posted in chunk.postings():
                        yield full({k: posted[k] for k in posted.schema.names}, len(posted))
                    turn += 1
                    chunk = _Chunk(part << 32 | turn)
                counts, places = _of_slice(aligner, some["text"])
                at = chunk.documents + np.arange(len(some), dtype=np.int32)
                yield full({"chunk": pa.array(np.full(len(some), chunk.number)), "place": pa.array(at.astype(np.int32)),
                            "doc_id": some["doc_id"]} | {k: pa.array(v) for k, v in counts.items()}, len(some))
                chunk.add(*places, len(some))
        if chunk.documents:
            for posted in chunk.postings():
                yield full({k: posted[k] for k in posted.schema.names}, len(posted))
        give_back_memory()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return scratch.keep(rows.mapInArrow(index, schema), "index")


def pair_counts(index: DataFrame) -> DataFrame:
    """``a, b, documents, links`` of every linked pair of ids."""
    return index.where("place IS NULL").groupBy("a", "b").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))


def scored_documents(scratch: Scratch, index: DataFrame) -> DataFrame:
    """Every document with ``n_best`` and ``count_sum``, which the postings return to it.

    ``n_best`` is how many links have a pair with the most links of its B id,
    ``count_sum`` adds up the pair's links over the document's.
    """
    counts = scratch.keep(pair_counts(index), "pairs")
    top = counts.groupBy("b").agg(F.max("links").alias("most"))
    scores = counts.join(top, "b").select("a", "b", F.col("links").alias("score"), (F.col("links") == F.col("most")).alias("best"))
    postings = index.where("place IS NULL").select("chunk", "universe", "a", "b", "planes")
    # the same plan at every size: the number of pairs has no bound, so it is never sent to all tasks
    postings = postings.join(scores.hint("merge"), ["a", "b"])

    def give_back(chunk: pa.Table) -> pa.Table:
        universe = chunk["universe"][0].as_py()
        best, total = np.zeros(universe, np.int64), np.zeros(universe, np.int64)
        for data, score, is_best in zip(chunk["planes"].to_pylist(), chunk["score"].to_pylist(), chunk["best"].to_pylist()):
            for plane, documents in enumerate(read_planes(data, universe)):
                total[documents] += score << plane
                if is_best:
                    best[documents] += 1 << plane
        seen = np.flatnonzero(total)
        return pa.table({"chunk": pa.array(np.full(len(seen), chunk["chunk"][0].as_py())),
                         "place": pa.array(seen.astype(np.int32)), "n_best": best[seen], "count_sum": total[seen]})

    given = postings.drop("a", "b").groupBy("chunk").applyInArrow(give_back, "chunk bigint, place int, n_best bigint, count_sum bigint")
    documents = index.where("place IS NOT NULL").select("chunk", "place", "doc_id", *_COUNTS, "groups_sha256")
    return documents.join(given, ["chunk", "place"], "left").select(
        "doc_id", *_COUNTS, F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_column: str = "doc_id", text_column: str = "text",
          scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with their counts and scores, and pairs of ids with documents and links."""
    scratch = scratch or Scratch(docs.sparkSession, "alignment")
    index = pair_index(docs, tokenizer_a, tokenizer_b, id_column, text_column, scratch)
    return scored_documents(scratch, index), pair_counts(index)
