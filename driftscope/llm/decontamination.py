"""Benchmark items in documents, by SimHash windows as long as the items.

A window of a document, as many words long as a benchmark item, gets a SimHash
of its five-word shingles.  Windows meet the items of the length they were
taken for in an equi-join on blocks of the fingerprint: with one block more than the radius has
bits, two fingerprints within the radius agree in at least one block.  Pairs
within the radius are verified by the exact similarity of their shingles,
weighted by how often each occurs: sum of the smaller counts over sum of the
larger.

Most windows need no fingerprint: two windows of n shingles that are alike to
the degree s share at least 2ns / (1 + s) of them, so only windows with that
many shingles of items of their length are taken, and each meets only the items
with which it shares that many.  This drops no pair that would pass, and keeps
the blocks, of two or three bits each at this radius, from pairing a window
with every item of its length.  A document shorter than an item is one window, tried for every length of
items that have at most 1 / s of its shingles.  The shingles of the items are sent to the tasks, at most ``MAX_SHINGLES``
at a time (or those of one item, if it has more); a larger benchmark is worked through in slices, with one pass over
the documents for each.

Words are runs of letters and digits, lower-cased.  Items of fewer words than a
shingle are one shingle and are found wherever their words follow one another;
``least_words`` keeps items of fewer words to documents that are nothing else.
Null or wordless texts and items match
nothing; null ids are carried along.  Repeated rows and items give repeated or,
where ids are equal, joined results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftscope.llm.scratch import Scratch, give_back_memory

WORDS = 5
SIMILARITY = 0.8
RADIUS = 22
MAX_SHINGLES = 4_000_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=150_000)
def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 0)


def _runs(single: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = max(0, len(single) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ single[k:k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _word_hashes(text: str | None) -> np.ndarray:
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(_word_hash, found), np.uint64, len(found))


def shingle_hashes(text: str | None, words: int = WORDS) -> tuple[int, np.ndarray]:
    """The number of words, and a 64-bit hash of each run of ``words`` words."""
    single = _word_hashes(text)
    return len(single), _runs(single, min(words, len(single))) if len(single) else single


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fingerprints(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * ones > n, axis=-1, bitorder="little").view(np.uint64).reshape(-1)


def needed(n: int, similarity: float, item: int | None = None) -> int:
    """How many of its n shingles a window must share with an item of as many, or of ``item`` ones."""
    return max(1, math.ceil((n + (n if item is None else item)) * similarity / (1 + similarity) - 1e-9))


class ItemIndex:
    """Which shingles occur in which items, which have so many words each."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, items: np.ndarray, words: int, similarity: float,
                 least_words: int = 1):
        self.words, self.similarity, self.least_words = words, similarity, least_words
        short = lengths < words
        self.short = {n: (hashes[lengths == n], items[lengths == n]) for n in np.unique(lengths[short]).tolist()}
        # by shingle and length, then item: one entry of the first index leads to a stretch of items
        hashes, lengths, items = hashes[~short], lengths[~short], items[~short]
        order = np.lexsort((items, lengths, hashes))
        hashes, lengths, self.items = hashes[order], lengths[order], items[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (lengths[1:] != lengths[:-1])
        self.first = np.append(np.flatnonzero(first), len(hashes))
        self.hashes, self.lengths = hashes[first], lengths[first]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def windows(self, text: str | None) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
        """(first word, words of the item, item, fingerprint, shingles) of the windows that may be like an item."""
        single = _word_hashes(text)
        if not len(single):
            return
        for words, (hashes, items) in self.short.items():
            if words == len(single) or self.least_words <= words < len(single):
                runs, start = np.unique(_runs(single, words), return_index=True)
                place = np.searchsorted(runs, hashes)
                place[place == len(runs)] = 0
                for k in np.flatnonzero(runs[place] == hashes).tolist():
                    own = hashes[k:k + 1]
                    yield int(start[place[k]]), words, int(items[k]), int(own[0]), own
        if len(self.hashes):
            yield from self._long(len(single), _runs(single, min(self.words, len(single))))

    def _long(self, count: int, own: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
        at = np.flatnonzero(self.maybe[(own >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(self.hashes, own[at], "left")
        high = np.searchsorted(self.hashes, own[at], "right")
        if not (high > low).any():
            return
        number = np.repeat(np.arange(len(at)), high - low)
        entry = np.arange(len(number)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[number]
        place, length = at[number], self.lengths[entry]
        for words in np.unique(length).tolist():
            n = words - self.words + 1
            mine = length == words
            places, entries = place[mine], entry[mine]
            if words > count:
                # the item is longer than the document, which is then the one window
                least = needed(len(own), self.similarity, n)
                if len(own) >= self.similarity * n - 1e-9 and len(places) >= least:
                    one = int(_fingerprints(_bits(own).sum(axis=0, dtype=np.int64)[None, :], len(own))[0])
                    for item, _ in self._shared(places, entries, least):
                        yield 0, words, item, one, own
                continue
            least = needed(n, self.similarity)
            hit = np.zeros(len(own) + 1, np.int64)
            hit[places + 1] = 1
            so_far = np.cumsum(hit)
            start = np.flatnonzero(so_far[n:] - so_far[:-n] >= least)
            # neighbouring windows share their bits
            for run in np.split(start, np.flatnonzero(np.diff(start) > n) + 1):
                if len(run):
                    first, end = int(run[0]), int(run[-1]) + n
                    ones = np.zeros((end - first + 1, 64), np.int64)
                    np.cumsum(_bits(own[first:end]), axis=0, out=ones[1:])
                    prints = _fingerprints(ones[run - first + n] - ones[run - first], n)
                    a, b = np.searchsorted(places, [first, end])
                    for item, met in self._shared(places[a:b], entries[a:b], least):
                        with_item = np.searchsorted(met, run + n) - np.searchsorted(met, run)
                        for k in np.flatnonzero(with_item >= least).tolist():
                            s = int(run[k])
                            yield s, words, item, int(prints[k]), own[s:s + n]

    def _shared(self, places: np.ndarray, entries: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """Items that hold the shingles of at least so many of the places, each with these places in order."""
        size = self.first[entries + 1] - self.first[entries]
        place = np.repeat(places, size)
        at = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[entries], size)
        items = self.items[at]
        order = np.argsort(items, kind="stable")  # places stay in order within an item
        items, place = items[order], place[order]
        edge = np.append(np.flatnonzero(np.diff(items, prepend=items[:1] - 1)), len(items))
        for k in np.flatnonzero(np.diff(edge) >= least).tolist():
            yield int(items[edge[k]]), place[edge[k]:edge[k + 1]]


def _similarity(a: list[int], b: list[int]) -> float:
    one, two = Counter(a), Counter(b)
    return sum((one & two).values()) / max(1, sum((one | two).values()))


def benchmark_items(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text",
                    words: int = WORDS) -> DataFrame:
    """``item_id, words, shingles, fingerprint`` of the items that have words."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for item, text in zip(frame["item_id"], frame["text"]):
                count, own = shingle_hashes(text, words)
                if count:
                    own_print = _fingerprints(_bits(own).sum(axis=0, dtype=np.int64)[None, :], len(own))
                    rows.append((item, count, own.view(np.int64), own_print.view(np.int64)[0]))
            yield pd.DataFrame(rows, columns=["item_id", "words", "shingles", "fingerprint"])

    rows = benchmark.select(F.col(id_column).cast("string").alias("item_id"), F.col(text_column).alias("text"))
    kind = benchmark.schema[id_column].dataType.simpleString()
    return rows.mapInPandas(measure, "item_id string, words int, shingles array<bigint>, fingerprint bigint").withColumn(
        "item_id", F.col("item_id").cast(kind))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """Cut 64 bits into one block more than the radius has bits: (first bit, mask)."""
    edge = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, (1 << b - a) - 1) for a, b in zip(edge, edge[1:])]


def _slices(items: DataFrame, max_shingles: int) -> tuple[int, list[int]]:
    """Into how many slices the items go for each to have so many shingles at most, or one item; which are not empty."""
    known = items.select("item", F.size("shingles").alias("n")).distinct()
    slices = -(-(known.agg(F.sum("n")).first()[0] or 0) // max_shingles) or 1
    while True:
        of = known.groupBy(F.pmod("item", F.lit(slices)).alias("slice")).agg(
            F.sum("n").alias("n"), F.count_distinct("item").alias("items"))
        numbers = of.select("slice", ((F.col("n") > max_shingles) & (F.col("items") > 1)).alias("full")).collect()
        if not any(row.full for row in numbers):
            return slices, sorted(row.slice for row in numbers)
        slices *= 2


def contaminations(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS,
                   max_shingles: int = MAX_SHINGLES, least_words: int = 1) -> DataFrame:
    """``doc_id, text_hash, item_id, similarity, first_word`` of every item found in a document.

    A document has one row for each item that a window of it is like, with the
    best window (of equally good ones the first).  ``text_hash`` is Spark's
    xxhash64 of the text.  ``benchmark`` has ``item_id`` and ``text``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "contaminations")
    # items with equal shingles share a key
    items = scratch.keep(benchmark_items(benchmark, words=words).withColumn("item", F.xxhash64("shingles")), "items")
    slices, filled = _slices(items, max_shingles)
    layout = _blocks(radius)

    def cut(value: Column) -> Column:
        return F.posexplode(F.array(*[F.shiftrightunsigned(value, a).bitwiseAND(F.lit(m)) for a, m in layout]))

    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"),
                       F.col(text_column).alias("text"))
    schema = ("doc_id string, text_hash bigint, first_word bigint, words int, item bigint, fingerprint bigint, "
              "shingles array<bigint>")
    found = None
    for number in filled or [0]:
        some = items.where(F.pmod("item", F.lit(slices)) == number)
        known = some.select(F.explode("shingles").alias("h"), "words", "item").distinct().toPandas()
        index = spark.sparkContext.broadcast(ItemIndex(
            known["h"].to_numpy(np.int64).view(np.uint64), known["words"].to_numpy(np.int32),
            known["item"].to_numpy(np.int64), words, similarity, least_words))

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for frame in batches:
                out = [(d, h, s, n, i, p - (1 << 64) if p >> 63 else p, own.view(np.int64))
                       for d, h, text in zip(frame["doc_id"], frame["text_hash"], frame["text"])
                       for s, n, i, p, own in index.value.windows(text)]
                yield pd.DataFrame(out, columns=["doc_id", "text_hash", "first_word", "words", "item", "fingerprint",
                                                 "shingles"])
            _word_hash.cache_clear()
            give_back_memory()

        windows = scratch.keep(rows.mapInPandas(scan, schema), f"windows-{number}")
        index.unpersist()
        left = windows.select("*", cut(F.col("fingerprint")).alias("block", "value"))
        right = some.select("item_id", F.col("item").alias("own_item"), F.col("words").alias("item_words"), F.col("shingles").alias("item_shingles"),
                            F.col("fingerprint").alias("item_print"),
                            cut(F.col("fingerprint")).alias("item_block", "item_value"))
        differ = F.col("fingerprint").bitwiseXOR(F.col("item_print"))
        agreeing = F.array(*[F.shiftrightunsigned(differ, a).bitwiseAND(F.lit(m)) == 0 for a, m in layout])
        pairs = left.join(right, (F.col("item") == F.col("own_item")) & (F.col("words") == F.col("item_words"))
                          & (F.col("block") == F.col("item_block")) & (F.col("value") == F.col("item_value")))
        # a pair that agrees in several blocks counts in the first
        pairs = pairs.where((F.bit_count(differ) <= radius) & (F.array_position(agreeing, True) - 1 == F.col("block")))
        found = pairs if found is None else found.unionByName(pairs)

    @F.pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([_similarity(x.tolist(), y.tolist()) for x, y in zip(a, b)], dtype=float)

    verified = found.select("doc_id", "text_hash", "item_id", "first_word",
                            alike("shingles", "item_shingles").alias("similarity")).where(F.col("similarity") >= similarity)
    best = verified.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("first_word")).alias("at"))).alias("best"))
    return best.select(F.col("doc_id").cast(docs.schema[id_column].dataType).alias("doc_id"), "text_hash", "item_id",
                       F.col("best.similarity").alias("similarity"), (-F.col("best.at")).alias("first_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  **options) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item was found, with all their columns."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = contaminations(docs, benchmark, id_column, text_column, **options)
    texts = scratch.keep(found.select(F.col("text_hash").alias("__hit")).distinct(), "texts")
    marked = docs.withColumn("__text", F.xxhash64(text_column))
    return marked.join(texts, F.col("__text") == F.col("__hit"), "left_anti").drop("__text")
