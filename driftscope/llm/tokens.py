"""Token ids in files: frequency-ranked, in a byte-aligned code with separate control bytes.

A token's number in the files is its rank by frequency over the whole corpus,
so that frequent tokens take one byte.  Four numbers share a control byte, two
bits each for a length of one to four bytes; control bytes and data bytes lie in
separate stretches, and a block is decoded by looking control bytes up in a
table of lengths, all with numpy.

A file holds a range of documents in ascending order of their ids:

    4 bytes  b"FRT1"
    blocks   control bytes, then data bytes, of a few whole documents each
    table    per block: offset, documents, tokens, control bytes, data bytes  (5 x uint64)
    lengths  tokens of each document (uint64)
    ids      ids of the documents (int64), then one byte each: 1 if it has an id
    16 bytes number of blocks, number of documents (uint64)

and the folder has one file ``ranks`` (uint32, token of each rank).

Null texts are empty and have the end id alone.  Documents without an id come
first, repeated ids stay, next to each other, in the order of their tokens'
digests.  An empty table gives no file.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftscope.llm.files import NewFile, exists, open_file, remove
from driftscope.llm.scratch import Scratch, give_back_memory

MAGIC = b"FRT1"
BLOCK_TOKENS = 1 << 18
CACHED_PIECES = 600_000
_SLICE = 1 << 22
# white space of Unicode, then a space
_SPACED = (r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] ")


# ---- tokenizing -----------------------------------------------------------------------------------------------------

class PieceEncoder:
    """Ids of whole texts, asking the tokenizer once per different piece.

    A byte-level vocabulary of this kind never joins a character that isn't
    white space with a space that follows, so texts may be cut there.  The same
    pieces come again and again; the first ``CACHED_PIECES`` are remembered,
    which the frequent ones are among.  Texts with other white space before a
    space go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size_of_vocabulary = max(vocabulary.values()) + 1
        self.token_bytes = np.zeros(self.size_of_vocabulary, np.int64)  # a character stands for a byte
        for token, number in vocabulary.items():
            self.token_bytes[number] = len(token)
        self.forget()

    def forget(self, keep: int = 0) -> None:
        """Forget all pieces but the first ``keep``."""
        if keep:
            for piece in list(self.number)[keep:]:
                del self.number[piece]
            self.ids, self.size = self.ids[:int(self.size[:keep].sum())].copy(), self.size[:keep].copy()
        else:
            self.number: dict[str, int] = {}
            self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """A number for each piece, which ``expand`` turns into its ids."""
        number = self.number
        new = [p for p in dict.fromkeys(pieces) if p not in number]
        if new:
            ids, size = [self.ids], [self.size]
            joined = [p for p in new if p[:1] == " " and not p[-1].isspace()]
            for at in range(0, len(joined), 8192):
                self._together(joined[at:at + 8192], ids, size)
            self._apart([p for p in new if p[:1] != " " or p[-1].isspace()], ids, size)
            self.ids, self.size = np.concatenate(ids), np.concatenate(size)
        return np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))

    def _together(self, some: list[str], ids: list, size: list) -> None:
        """Encode pieces as one text and cut the ids where each piece's bytes end."""
        found = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
        end = np.cumsum([len(p.encode()) for p in some])
        done = np.cumsum(self.token_bytes[found])
        cut = np.minimum(np.searchsorted(done, end), len(done) - 1)
        if (done[cut] == end).all():
            self._remember(some, found, np.diff(cut + 1, prepend=0), ids, size)
        else:
            self._apart(some, ids, size)

    def _apart(self, some: list[str], ids: list, size: list) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)] if some else []
        self._remember(some, np.array([i for x in found for i in x], np.uint32),
                       np.array([len(x) for x in found], np.int64), ids, size)

    def _remember(self, some: list[str], found: np.ndarray, count: np.ndarray, ids: list, size: list) -> None:
        self.number.update(zip(some, range(len(self.number), len(self.number) + len(some))))
        ids.append(found)
        size.append(count)

    def expand(self, chosen: np.ndarray, edge: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose pieces are ``chosen[edge[i]:edge[i + 1]]``, each with the end id, and their number."""
        last = np.array([] if end is None else [end], np.uint32)
        table, size = np.concatenate([self.ids, last]), np.append(self.size, len(last))
        chosen = np.insert(chosen, edge[1:], len(size) - 1)
        n = size[chosen]
        total = np.concatenate([[0], np.cumsum(n)])
        first = (np.cumsum(size) - size)[chosen]
        flat = table[np.repeat(first - total[:-1], n) + np.arange(total[-1])]
        return flat, np.diff(total[edge + np.arange(len(edge))])

    def encode(self, texts: pa.Array, end: int | None = None) -> list[np.ndarray]:
        """The ids of each text; null texts are empty."""
        if len(self.number) > CACHED_PIECES:
            self.forget(CACHED_PIECES)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _SPACED).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)

        def put(rows: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
            for row, ids in zip(rows.tolist(), np.split(flat, np.cumsum(count)[:-1])):
                out[row] = ids

        rows = np.flatnonzero(odd)
        if len(rows):
            tail = [] if end is None else [end]
            for row, text in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist()):
                found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
                out[row] = np.array([*found, *tail], np.uint32)
        rows = np.flatnonzero(~odd)
        if len(rows):
            words = pc.split_pattern(texts.take(pa.array(rows)), " ")
            edge = words.offsets.to_numpy()
            coded = words.flatten().dictionary_encode()
            # all words but the first of a text follow a space
            first = words.flatten().take(pa.array(edge[:-1])).to_pylist()
            known = self.numbers([" " + w for w in coded.dictionary.to_numpy(zero_copy_only=False)])
            chosen = known[coded.indices.to_numpy()]
            chosen[edge[:-1]] = self.numbers(first)
            put(rows, *self.expand(chosen, edge, end))
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    """One per Python worker, so that what it remembers serves all its tasks."""
    return PieceEncoder(path)


def encoded(batch: pa.RecordBatch, tokenizer: str, end: int | None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch of at most about ``_SLICE`` bytes of text, and the ids of their texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _SLICE, "right")))
        some = batch.slice(at, stop - at)
        yield some, _encoder(tokenizer).encode(some["text"], end)
        at = stop


# ---- the code -------------------------------------------------------------------------------------------------------

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of whole numbers below 2**32."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    length = (1 + (numbers > 0xFF) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)).astype(np.uint8)
    code = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    code[:len(numbers)] = length - 1
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] < length[:, None]
    return control.tobytes(), numbers.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    end = np.cumsum(length, dtype=np.int64)
    start = end - length
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    value = padded[start]
    for k in range(1, int(length.max(initial=1))):
        value |= padded[start + k] << np.uint32(8 * k)
    return value & _MASK[length]


def write_file(path: str, rank: np.ndarray, documents: Iterator[tuple[int | None, np.ndarray]]) -> None:
    """Write documents (id, token ids)."""
    blocks, lengths, ids = [], [], []
    with NewFile(path) as out:
        out.write(MAGIC)
        held: list[np.ndarray] = []

        def flush() -> None:
            if held:
                flat = rank[np.concatenate(held)]
                control, data = pack(flat)
                blocks.append((out.size, len(held), len(flat), len(control), len(data)))
                out.write(control)
                out.write(data)
                held.clear()

        size = 0
        for doc_id, tokens in documents:
            held.append(tokens)
            lengths.append(len(tokens))
            ids.append(doc_id)
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                flush()
                size = 0
        flush()
        out.write(np.array(blocks, "<u8").tobytes())
        out.write(np.array(lengths, "<u8").tobytes())
        out.write(np.array([0 if i is None else i for i in ids], "<i8").tobytes())
        out.write(bytes(int(i is not None) for i in ids))
        out.write(np.array([len(blocks), len(ids)], "<u8").tobytes())


def file_totals(path: str) -> tuple[int, int]:
    """How many documents and tokens a file has."""
    with open_file(path) as source:
        end = source.size()
        blocks, documents = np.frombuffer(source.read_at(16, end - 16), "<u8").tolist()
        table = np.frombuffer(source.read_at(40 * blocks, end - 16 - 40 * blocks - 17 * documents), "<u8")
    return documents, int(table.reshape(-1, 5)[:, 2].sum())


def read_file(path: str, tokens: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Per block: document ids, tokens of each document, and all its token ids."""
    with open_file(path) as source:
        end = source.size()
        blocks, documents = np.frombuffer(source.read_at(16, end - 16), "<u8").tolist()
        head = end - 16 - 40 * blocks - 17 * documents
        if source.read_at(4, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        raw = source.read_at(end - 16 - head, head)
        table = np.frombuffer(raw, "<u8", 5 * blocks).reshape(-1, 5).tolist()
        lengths = np.frombuffer(raw, "<u8", documents, 40 * blocks).astype(np.int64)
        ids = np.frombuffer(raw, "<i8", documents, 40 * blocks + 8 * documents)
        has_id = np.frombuffer(raw, np.uint8, documents, 40 * blocks + 16 * documents)
        at = 0
        for offset, n, count, control, data in table:
            body = source.read_at(control + data, offset)
            own = [int(i) if h else None for i, h in zip(ids[at:at + n], has_id[at:at + n])]
            yield own, lengths[at:at + n], tokens[unpack(body[:control], body[control:], count)]
            at += n


# ---- on Spark -------------------------------------------------------------------------------------------------------

def _spool(docs: DataFrame, tokenizer: str, end: int | None, folder: str) -> DataFrame:
    """Tokenize ranges of documents into raw files: ``file, token, n``, how often each file has each token."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("doc_id").asc_nulls_first(), F.crc32("text").asc_nulls_first()]
    dealt = docs.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())

    def spool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, name, out, writer = None, "", None, None
        for batch in batches:
            for some, ids in encoded(batch, tokenizer, end):
                if writer is None:
                    vocabulary = max(_encoder(tokenizer).size_of_vocabulary, (end or 0) + 1)
                    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
                    count = np.zeros(vocabulary, np.int64)
                    name = f"part-{some['part'][0].as_py():06d}"
                    out = NewFile(f"{folder}/raw/{name}")
                    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_list(pa.from_numpy_dtype(kind)))])
                    writer = pa.ipc.new_stream(pa.PythonFile(out, "w"), schema,
                                               options=pa.ipc.IpcWriteOptions(compression="zstd"))
                flat = np.concatenate(ids).astype(kind)
                count += np.bincount(flat, minlength=len(count))
                edge = pa.array(np.cumsum([0, *map(len, ids)]), pa.int64())
                writer.write_batch(pa.record_batch([some["doc_id"], pa.LargeListArray.from_arrays(edge, flat)], schema=schema))
        if writer is not None:
            writer.close()
            out.finish()
            token = np.flatnonzero(count)
            yield pa.record_batch({"file": pa.array([name] * len(token)), "token": pa.array(token, pa.int64()),
                                   "n": pa.array(count[token], pa.int64())})
        give_back_memory()

    return dealt.mapInArrow(spool, "file string, token bigint, n bigint")


def write_tokens(docs: DataFrame, tokenizer: str, scratch: Scratch, end: int | None = 2, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """Write token files below the scratch folder; ``file, documents, tokens`` of each, in the order of their names.

    Texts are tokenized once, into raw files in the order of the documents.
    When all are there, tokens are ranked and each raw file is turned into a
    coded one and removed.  A task that is run again finds the finished file.
    """
    folder = f"{scratch.path}/files"
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    counts = scratch.keep(_spool(rows, tokenizer, end, folder), "counts")
    # one row per token of the vocabulary, whatever the corpus
    order = counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").select("token").collect()
    ranks = np.array([r[0] for r in order], np.uint32)
    with NewFile(f"{folder}/ranks") as out:
        out.write(ranks.astype("<u4").tobytes())
    rank = np.zeros(int(ranks.max(initial=0)) + 1, np.uint32)
    rank[ranks] = np.arange(len(ranks), dtype=np.uint32)
    rank_of = docs.sparkSession.sparkContext.broadcast(rank)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def documents(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
        with open_file(path) as source:
            for batch in pa.ipc.open_stream(source):
                edge, flat = batch["ids"].offsets.to_numpy(), batch["ids"].values.to_numpy()
                for doc_id, a, b in zip(batch["doc_id"].to_pylist(), edge[:-1].tolist(), edge[1:].tolist()):
                    yield doc_id, flat[a:b]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name in frame["file"]:
                final, raw = f"{folder}/{name}", f"{folder}/raw/{name}"
                if not exists(final):
                    write_file(final, rank_of.value, documents(raw))
                remove(raw)
                n, total = file_totals(final)
                yield pd.DataFrame({"file": [name], "documents": [n], "tokens": [total]})

    files = counts.select("file").distinct().repartition(parts)
    return scratch.keep(files.mapInPandas(code, "file string, documents bigint, tokens bigint"), "written")


def read_tokens(spark: SparkSession, folder: str, written: DataFrame,
                of_document: Callable[[np.ndarray], dict[str, object]], schema: str) -> DataFrame:
    """One row per document, read from the files: ``doc_id, start, n_tokens`` and what ``of_document`` makes of its ids.

    ``start`` counts the ids of all documents before it.  One row per file is
    summed up in one task.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = None
        for frame in batches:
            for name, start in zip(frame["file"], frame["start"].tolist()):
                if tokens is None:
                    with open_file(f"{folder}/ranks") as source:
                        tokens = np.frombuffer(source.read_at(source.size(), 0), "<u4")
                for ids, lengths, flat in read_file(f"{folder}/{name}", tokens):
                    at = np.cumsum(lengths) - lengths
                    more = [of_document(flat[a:a + n]) for a, n in zip(at.tolist(), lengths.tolist())]
                    yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start": at + start, "n_tokens": lengths}
                                       | {k: [m[k] for m in more] for k in (more[0] if more else {})})
                    start += int(lengths.sum())

    return files.repartition(parts).mapInPandas(read, f"doc_id bigint, start bigint, n_tokens bigint, {schema}")


def ids_crc32(ids: np.ndarray) -> dict[str, object]:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def token_files(docs: DataFrame, tokenizer: str, end: int | None = 2, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """Write token files and read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    scratch = Scratch(docs.sparkSession, "token-files")
    written = write_tokens(docs, tokenizer, scratch, end, id_column, text_column)
    return read_tokens(docs.sparkSession, f"{scratch.path}/files", written, ids_crc32, "ids_crc32 bigint")
