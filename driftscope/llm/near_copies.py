"""Near copies by the similarity of five-word shingles: SimHash, ball hashing, exact verification, components.

Two texts are near copies if the sets of their shingles have a Jaccard
similarity of 0.8 or more; near copies of near copies are one component.  Every
text has the SimHash of its shingle set.  Fingerprints at most three bits apart
meet by ball hashing, and texts whose fingerprints are so connected are
candidates, in one bucket.

Pairs at 0.8 lie about ten bits apart, so three bits find the closer copies only.
For the others a text also has ``BANDS`` bands, hashes of ``ROWS`` minima each over
its shingles, and texts that share a band are candidates too: of pairs at 0.8 all
but about seven in a million share one, of more similar ones fewer are missed.

Candidates are verified by their exact shingle sets.  Buckets with the same
members count once.  First each member is compared with its bucket's centre, the
smallest key: with the smallest of all its centres, and then with those it isn't
connected with yet.  Near copies of one text link to it and are done, however
many they are.  Only members that aren't connected with the centre meet the
others, in cells of bounded size, and pairs of connected members aren't compared
again.  Within a cell, texts outside
its largest component are compared with all others until every pair is either
compared or linked.

Words are what lies between white space, lower-cased (ASCII).  Texts of fewer
words than a shingle are one shingle.  Null and wordless texts are one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftscope.llm.components import components
from driftscope.llm.scratch import Scratch, give_back_memory
from driftscope.llm.simhash import keep_first, linked_fingerprints, majority

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
CELL_SHINGLES = 250_000
_CHUNK = 512
_BATCH = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tokens(data: bytes | None) -> list[bytes]:
    return (data or b"").lower().split()


def _key(tokens: list[bytes]) -> int:
    import xxhash

    value = xxhash.xxh64_intdigest(b" ".join(tokens), 7)
    return value - (1 << 64) if value >> 63 else value


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), _BATCH):
            yield batch.slice(at, _BATCH)


def shingle_set(tokens: list[bytes], words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different runs of ``words`` words."""
    import xxhash

    if not tokens:
        return np.zeros(0, np.uint64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(single))
    n = len(single) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ single[k:k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.default_rng(42)
    draw = [numbers.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2)]
    return draw[0], draw[1] | np.uint64(1)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One hash per band; none of a text without words."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    flip, factor = _functions()
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), _CHUNK):
        mixed = (shingles[None, at:at + _CHUNK] ^ flip) * factor
        np.minimum(least, mixed.min(axis=1), out=least)
    out = np.arange(1, BANDS + 1).astype(np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def like_centre(centre: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which sets have at least the similarity to the centre."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(centre, flat), max(len(centre) - 1, 0))
    hits = np.bincount(np.repeat(np.arange(len(sets)), size), centre[at] == flat if len(centre) else None, len(sets))
    return hits >= similarity * (size + len(centre) - hits)


def verified_links(sets: list[np.ndarray], similarity: float = SIMILARITY, joined: np.ndarray | None = None) -> np.ndarray:
    """For each set an index it is connected with by pairs of at least the similarity, the same for all connected.

    ``joined`` marks sets known to be connected with each other.
    """
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    start = np.cumsum(size) - size
    order = np.argsort(code, kind="stable")
    posted = owner[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(code))])
    root, waiting = np.arange(len(sets)), np.ones(len(sets), bool)
    if joined is not None and joined.any():
        root[joined] = np.argmax(joined)
    while True:
        largest = np.argmax(np.bincount(root))
        left = np.flatnonzero(waiting & (root != largest))
        if not len(left):
            return root
        one = largest if waiting[largest] else left[0]
        waiting[one] = False
        own = code[start[one]:start[one] + size[one]]
        length = first[own + 1] - first[own]
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[own], length)
        shared = np.bincount(posted[at], minlength=len(sets))
        near = np.flatnonzero(shared / (size + size[one] - shared) >= similarity)
        merged = np.unique(root[near])
        if len(merged) > 1:
            root[np.isin(root, merged)] = merged[0]


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                similarity: float = SIMILARITY, cell_shingles: int = CELL_SHINGLES,
                scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, component_id`` for every row: the smallest id of the texts it is connected with."""
    scratch = scratch or Scratch(docs.sparkSession, "near-copies")
    data = F.coalesce(F.col(text_column), F.lit("")).cast("binary")

    rows = docs.select(F.col(id_column).alias("doc_id"), data.alias("data"))
    kind = docs.schema[id_column].dataType

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            key, n, prints, band = [], [], [], []
            for x in part["data"]:
                tokens = _tokens(x.as_py())
                own = shingle_set(tokens, words)
                key.append(_key(tokens))
                n.append(len(own))
                prints.append(majority(own) if len(own) else None)
                band.append(bands(own))
            yield pa.record_batch({"doc_id": part["doc_id"], "key": pa.array(key, pa.int64()),
                                   "n": pa.array(n, pa.int32()),
                                   "fingerprint": pa.array(prints, pa.int64()), "bands": pa.array(band, pa.list_(pa.int64()))})
        give_back_memory()

    def shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            texts = [_tokens(x.as_py()) for x in part["data"]]
            own = [shingle_set(x, words).view(np.int64) for x in texts]
            yield pa.record_batch({"key": pa.array(map(_key, texts), pa.int64()),
                                   "shingles": pa.array(own, pa.list_(pa.int64()))})
        give_back_memory()

    sketches = T.StructType([T.StructField("doc_id", kind), T.StructField("key", T.LongType()),
                             T.StructField("n", T.IntegerType()), T.StructField("fingerprint", T.LongType()),
                             T.StructField("bands", T.ArrayType(T.LongType()))])
    marked = scratch.keep(rows.mapInArrow(sketch, sketches), "sketches")
    heads = scratch.keep(marked.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"),
                                                   F.first("fingerprint").alias("fingerprint"),
                                                   F.first("bands").alias("bands")), "heads")
    # texts without words have no fingerprint
    printed = heads.where("fingerprint IS NOT NULL").select("key", "n", "fingerprint")
    links = scratch.keep(linked_fingerprints(printed.select("fingerprint").distinct()), "fingerprint-links")
    balls = components(Scratch(scratch.spark, "fingerprints"), links).withColumnRenamed("node", "fingerprint")
    in_ball = printed.join(balls, "fingerprint", "left").select(
        "key", "n", F.xxhash64(F.lit("ball"), F.coalesce("root", "fingerprint")).alias("band"))
    dealt = heads.select("key", "n", F.explode("bands").alias("band")).unionByName(scratch.keep(in_ball, "balls"))
    buckets = dealt.groupBy("band").agg(
        F.count("*").alias("members"), F.min("key").alias("centre"), F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("members > 1")
    # buckets of the same members are one
    chosen = scratch.keep(buckets.groupBy("members", "x", "y", "centre").agg(F.min("band").alias("band")).select(
        "band", "centre"), "buckets")
    members = scratch.keep(dealt.join(chosen, "band").select("band", "centre", "key", "n"), "members")
    # rows with the first ids of candidates; other texts of such an id meet no cell
    wanted = scratch.keep(heads.join(members.select("key").distinct(), "key", "left_semi").select(
        "first_id").distinct(), "wanted")
    # the number of candidates has no bound, so they are never sent to all tasks
    texts = rows.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("data")
    # in buckets of the key, so that joins on it leave them where they are
    sets = scratch.keep_in_buckets(texts.mapInArrow(shingles_of, "key bigint, shingles array<bigint>").groupBy("key").agg(
        F.first("shingles").alias("shingles")), "sets", "key")

    def cut(n: str) -> Column:
        return F.ceil(F.sum(n) / F.lit(cell_shingles)).cast("int")

    def placed(key: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(2)), F.col(blocks)).cast("int")

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        lists = table["shingles"].combine_chunks()
        flat, edge = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(edge, edge[1:])]

    def to_centre(star: pa.Table) -> pa.Table:
        key, sets, centre = star["key"].to_numpy(), sets_of(star), star["centre"][0].as_py()
        alike = like_centre(sets[int(np.flatnonzero(key == centre)[0])], sets, similarity) & (key != centre)
        return pa.table({"a": key[alike], "b": np.full(int(alike.sum()), centre)})

    def starred(pairs: DataFrame, name: str) -> DataFrame:
        """Links of ``centre, key, n`` pairs; the members of a centre are dealt into parts of bounded size."""
        parts = pairs.groupBy("centre").agg(F.greatest(cut("n"), F.lit(1)).alias("parts"))
        spokes = pairs.join(parts, "centre").select("centre", "key", placed("key", "parts").alias("part"))
        hubs = parts.select("centre", F.col("centre").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return scratch.keep(spokes.unionByName(hubs).join(sets, "key").groupBy("centre", "part").applyInArrow(
            to_centre, "a bigint, b bigint"), name)

    def apart(links: DataFrame, name: str) -> DataFrame:
        """The members, and whether each is not connected with its bucket's centre by the links so far."""
        root = components(Scratch(scratch.spark, name), links)
        own, of_centre = (root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("key", "centre"))
        return members.join(own, "key", "left").join(of_centre, "centre", "left").select(
            "band", "centre", "key", "n", (F.coalesce("key_root", "key") != F.coalesce("centre_root", "centre")).alias("free"))

    nearest = members.groupBy("key").agg(F.min("centre").alias("centre"), F.first("n").alias("n")).where("centre <> key")
    stars = starred(nearest, "stars-1")
    others = apart(stars, "near-copies-1").where("free").groupBy("centre", "key").agg(F.first("n").alias("n"))
    stars = stars.unionByName(starred(scratch.keep(others, "others"), "stars-2"))
    # members that didn't link, with all others of their bucket
    state = scratch.keep(apart(stars, "near-copies-2"), "state")
    open_bands = state.withColumns({"u": F.when(F.col("free"), F.col("n")), "s": F.when(~F.col("free"), F.col("n"))}).groupBy(
        "band").agg(cut("u").alias("bu"), F.greatest(cut("s"), F.lit(1)).alias("bs")).where("bu > 0")
    both = state.join(open_bands, "band").withColumns({"hu": placed("key", "bu"), "hs": placed("key", "bs")})
    # cells of a block of free members and one of linked ones, and of two blocks of free ones
    cells = both.select("band", "key", "free", F.explode(F.expr("""
        IF(free, concat(transform(sequence(0, bs - 1), j -> struct(hu AS i, j AS j)),
                        transform(filter(sequence(0, bu - 1), k -> k <> hu),
                                  k -> struct(least(k, hu) AS i, -1 - greatest(k, hu) AS j))),
                 transform(sequence(0, bu - 1), i -> struct(i AS i, hs AS j)))""")).alias("cell")).select(
        "band", "key", "free", "cell.i", "cell.j")

    def verify(cell: pa.Table) -> pa.Table:
        key = cell["key"].to_numpy()
        root = verified_links(sets_of(cell), similarity, ~cell["free"].to_numpy(zero_copy_only=False))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": key[linked], "b": key[root[linked]]})

    found = cells.join(sets, "key").groupBy("band", "i", "j").applyInArrow(verify, "a bigint, b bigint").unionByName(stars)
    roots = components(scratch, scratch.keep(found, "links")).withColumnRenamed("node", "key")
    linked = heads.select("key", "first_id").join(roots, "key")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = scratch.keep(linked.join(smallest, "root").select("key", "component_id"), "linked")
    of_key = heads.join(linked, "key", "left").select("key", F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(of_key, "key").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, with all their columns."""
    return keep_first(docs, near_copies, id_column, text_column, **options)
