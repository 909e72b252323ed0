"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart meet in a third one that lies between
them.  Every fingerprint therefore emits all variants within its half of the
radius, and fingerprints that emit the same variant are linked.  The halves of
three are one and two, and parity says who takes which: fingerprints an odd
number of bits apart differ in parity, so those with an even number of ones
emit the ball of radius one (65 variants), the others also flip pairs of bits.
Of three differing bits two always lie in the same 32-bit half, so pairs within
a half are enough (1,057 variants instead of 2,081).

No pairs are listed: of the fingerprints that share a variant, all lie within
the radius of any even one among them, so each is linked to one such centre.
At most 1,058 different fingerprints can share a variant, whatever the data.

Variants travel packed.  Buckets are a linear code of the variant's bits, so a
fingerprint is sent once to each bucket that holds some of its variants, and the
bucket makes only those of its own.  The number of buckets follows the number of
fingerprints, so that one bucket has at most about ``BUCKET_VARIANTS`` variants.

Nulls and texts without words have fingerprint zero.  Equal texts are one
fingerprint and cost one row after the first aggregate, however many they are.
Repeated rows stay repeated in ``near_duplicates``; ``deduplicate`` keeps one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftscope.llm.components import components
from driftscope.llm.scratch import Scratch

BUCKET_VARIANTS = 2_000_000
_CHUNK = 1 << 16


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at:at + _CHUNK], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(data: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of one text as a signed 64-bit number."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (data or b"").lower().split()  # of bytes, both look at ASCII only
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [digest(b" ".join(tokens), seed)]
    else:
        text = b" ".join(tokens)
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        end = np.cumsum(length + 1) - 1
        start = end - length
        hashes = [digest(text[i:j], seed) for i, j in zip(start[:len(tokens) - words + 1].tolist(),
                                                          end[words - 1:].tolist())]
    return majority(hashes)


def fingerprint_column(text: Column, words: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text column as a bigint."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(x, words, seed) for x in batch], dtype="int64")

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def fingerprint_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# ---- the ball -------------------------------------------------------------------------------------------------------

def ball_masks(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits that fingerprints with an even and an odd number of ones flip."""
    if radius not in (2, 3):
        raise ValueError("ball hashing is laid out for a radius of 2 or 3")
    bits = [1 << i for i in range(64)]
    near = [0, *bits]
    pairs = [bits[i] | bits[j] for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    return np.array(near, np.uint64), np.array(near + (pairs if radius == 3 else []), np.uint64)


def code_rows(width: int) -> list[int]:
    """Fixed parity checks: bucket bit i of a variant is the parity of its bits in row i."""
    state, rows = 0x9E3779B97F4A7C15, []
    for _ in range(width):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        rows.append(state ^ (state >> 29))
    return rows


def _code(values: np.ndarray, rows: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for i, row in enumerate(rows):
        out |= (np.bitwise_count(values & np.uint64(row)).astype(np.int64) & 1) << i
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n, over the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(bucket: int, prints: np.ndarray, rows: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest one it is connected with) found among the variants of one bucket."""
    prints = np.sort(np.unique(prints))
    codes, odd = _code(prints, rows), np.bitwise_count(prints) & 1
    variants, owners = [], []
    for parity, masks in enumerate(ball_masks(radius)):
        mask_codes = _code(masks, rows)
        of_code = {c: masks[mask_codes == c] for c in np.unique(mask_codes).tolist()}
        own = np.flatnonzero(odd == parity)
        own = own[np.argsort(codes[own], kind="stable")]
        distinct, first = np.unique(codes[own], return_index=True)
        for code, members in zip(distinct.tolist(), np.split(own, first[1:])):
            flips = of_code.get(code ^ bucket)
            if flips is not None:
                variants.append((prints[members][:, None] ^ flips[None, :]).ravel())
                owners.append(np.repeat(members.astype(np.int32), len(flips)))
    if not variants:
        return prints[:0], prints[:0]
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    del variants, owners
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    del order
    same = variant[1:] == variant[:-1]
    shared = np.zeros(len(variant), bool)
    shared[1:] |= same
    shared[:-1] |= same
    variant, owner = variant[shared], owner[shared]
    if not len(variant):
        return prints[:0], prints[:0]
    group = np.concatenate([[0], np.cumsum(variant[1:] != variant[:-1])])
    # the centre is an even fingerprint if there is one; where there is none, distances are checked below
    rank = owner + np.where(odd[owner] == 1, len(prints), 0)
    centre = np.full(group[-1] + 1, 2 * len(prints))
    np.minimum.at(centre, group, rank)
    centre = (centre % len(prints))[group]
    close = (centre != owner) & (np.bitwise_count(prints[centre] ^ prints[owner]) <= radius)
    root = _roots(centre[close], owner[close].astype(np.int64), len(prints))
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return prints[linked], prints[root[linked]]


def linked_fingerprints(prints: DataFrame, radius: int = 3, count: int | None = None) -> DataFrame:
    """``a, b``: enough links to connect every two fingerprints within the radius.

    ``prints`` has one bigint column of distinct fingerprints.
    """
    (name,) = prints.columns
    count = prints.count() if count is None else count
    even, odd = ball_masks(radius)
    width = max(4, int(np.ceil(np.log2(max(1, count * (len(even) + len(odd)) / 2 / BUCKET_VARIANTS)))))
    rows = code_rows(width)
    value = F.col(name)
    code = F.lit(0)
    for i, row in enumerate(rows):
        code = code.bitwiseOR(F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(_signed(row)))).bitwiseAND(F.lit(1)), i))
    reached = [sorted(set(_code(m, rows).tolist())) for m in (even, odd)]
    offsets = F.when(F.bit_count(value).bitwiseAND(F.lit(1)) == 0, F.lit(reached[0])).otherwise(F.lit(reached[1]))
    dealt = prints.select(value.alias("f"), code.alias("c"), F.explode(offsets).alias("o")).select(
        F.col("c").bitwiseXOR(F.col("o")).cast("int").alias("bucket"), "f")

    def links(key, batch: pd.DataFrame) -> pd.DataFrame:
        a, b = bucket_links(int(key[0]), batch["f"].to_numpy(np.int64).view(np.uint64), rows, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("bucket").applyInPandas(links, "a bigint, b bigint")


# ---- documents ------------------------------------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3,
                    radius: int = 3, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, fingerprint`` (bigint) ``, component_id`` for every row.

    The component's id is the smallest document id reachable over links between
    fingerprints; it is null only if no document of the component has an id.
    Other columns are left out, so their names don't matter.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-duplicates")
    marked = scratch.keep(docs.select(F.col(id_column).alias("doc_id"), fingerprint_column(
        F.col(text_column), words, seed).alias("fingerprint")), "fingerprints")
    heads = scratch.keep(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "heads")
    links = scratch.keep(linked_fingerprints(heads.select("fingerprint"), radius), "links")
    roots = components(scratch, links).withColumnRenamed("node", "fingerprint")
    linked = heads.join(roots, "fingerprint")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = scratch.keep(linked.join(smallest, "root").select("fingerprint", "component_id"), "linked")
    of_print = heads.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(of_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, with all their columns."""
    return keep_first(docs, near_duplicates, id_column, text_column, **options)


def keep_first(docs: DataFrame, find: Callable[..., DataFrame], id_column: str, text_column: str, **options) -> DataFrame:
    """Of each component that ``find`` gives the row with the smallest id.

    Rows without an id come last.  Rows with equal ids in a component are told
    apart by a hash of the whole row; of fully equal rows one stays.
    """
    scratch = Scratch(docs.sparkSession, "deduplicate")
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    found = find(docs.select(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"),
                                      row_hash.alias("h")).alias("doc_id"),
                             F.col(text_column).alias("text")), scratch=scratch, **options)
    # a component's id is the least (id, hash) pair, so it names the row that stays; __n rows are equal to it
    stays = scratch.keep(found.groupBy("component_id").agg(
        F.count_if(F.col("doc_id") == F.col("component_id")).alias("__n")).select("component_id.*", "__n"), "stays")
    named = docs.withColumns({"__id": F.col(id_column), "__h": row_hash})
    kept = named.alias("d").join(stays.alias("s"), F.col("d.__id").eqNullSafe(F.col("s.id"))
                                 & (F.col("d.__h") == F.col("s.h"))).select("d.*", "s.__n")
    # only repeated rows are moved again
    once = Window.partitionBy("__id", "__h").orderBy(F.lit(0))
    first = kept.where("__n > 1").withColumn("__r", F.row_number().over(once)).where("__r = 1").drop("__r")
    return kept.where("__n = 1").unionByName(first).drop("__id", "__h", "__n")
