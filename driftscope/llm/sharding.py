"""Sharding by a k-d tree over metadata, with distributed weighted medians.

A node that is to become several shards is split along the dimension that is
widest in it, measured against the whole table, where the bytes left of the cut
are in proportion to the shards left of it.  All nodes of a level are split
together.  A cut is found by narrowing its interval with histograms: each round
adds up bytes per node and bucket, and only those sums (at most ``BUCKETS`` per
node) reach the driver.  No node is ever sorted or gathered.

Dimensions are those of a text: its bytes, and the smallest source, language and
id among the rows that share it.  Equal values are ordered by the text's
checksum, so that equal texts stay together wherever the balance of bytes allows
it; a group of copies too large for that is cut by a hash of the ids.

Null texts count as empty, null metadata as the smallest value.  Rows that are
equal in everything stay together.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftscope.llm.scratch import Scratch, positions

BUCKETS = 4096
TOLERANCE = 0.001
ROW_BYTES = 8
_VALUE_BITS = 31


@dataclass
class Node:
    """A part of the table: its first shard and their number; once split, the cut and both sides."""

    first: int
    shards: int
    dimension: int = 0
    key: int = 0
    sub: int | None = None
    left: Node | None = None
    right: Node | None = None

    def assign(self, pick) -> Column:
        if self.left is None:
            return F.lit(pick(self))
        key = F.col(f"k{self.dimension}")
        goes_left = key < self.key
        if self.sub is not None:
            goes_left = goes_left | ((key == self.key) & (F.col("sub") < self.sub))
        return F.when(goes_left, self.left.assign(pick)).otherwise(self.right.assign(pick))

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else [*self.left.leaves(), *self.right.leaves()]


def _text_order(text: Column) -> Column:
    """The first seven bytes as a number; null is the smallest."""
    digits = F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("bigint") + 1, F.lit(0).cast("bigint"))


def _measured(scratch: Scratch, docs: DataFrame, id_column: str, text_column: str,
              metadata: tuple[str, ...]) -> tuple[DataFrame, int]:
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = scratch.keep(docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("same"),
        *[_text_order(F.col(c).cast("string")).alias(f"m{i}") for i, c in enumerate(metadata)]), "rows")
    names = [f"m{i}" for i in range(len(metadata))]
    groups = rows.groupBy("same", "crc", "size").agg(
        *[F.min(m).alias(f"g_{m}") for m in names], F.shiftright(F.min("doc_id"), 1).alias("g_id"))
    grouped = scratch.keep(rows.drop(*names).join(groups, ["same", "crc", "size"]), "grouped")
    values = ["size", *[f"g_{m}" for m in names], "g_id"]
    ends = grouped.agg(*[f(v) for v in values for f in (F.min, F.max)]).first()
    keys = []
    for i, value in enumerate(values):
        low, high = ends[2 * i] or 0, ends[2 * i + 1] or 0
        scaled = F.shiftright(F.coalesce(F.col(value), F.lit(low)) - F.lit(low).cast("bigint"),
                              max(0, (high - low).bit_length() - _VALUE_BITS))
        keys.append((scaled * F.lit(1 << 32) + F.col("crc")).alias(f"k{i}"))
    sub = F.shiftrightunsigned(F.xxhash64("doc_id", "crc"), 1).alias("sub")
    return scratch.keep(grouped.select("doc_id", "size", "crc", *keys, sub), "keyed"), len(values)


@dataclass
class _Search:
    """The interval in which a node's cut lies, of the key or, inside one key, of the hash of ids."""

    node: Node
    goal: float
    low: int
    high: int
    column: str
    before: int = 0
    inside: int | None = None

    @property
    def step(self) -> int:
        return -(-(self.high - self.low + 1) // BUCKETS)

    def narrow(self, sums: dict[int, int], slack: float) -> bool:
        """Take in the histogram; true when the cut is set."""
        before, step = self.before, self.step
        for bucket in sorted(sums):
            after = before + sums[bucket]
            if after >= self.goal:
                break
            before = after
        else:
            bucket, after = (max(sums) if sums else 0), before
            before = after - sums.get(bucket, 0)
        start, stop = self.low + bucket * step, self.low + (bucket + 1) * step
        nearest = start if self.goal - before <= after - self.goal else stop
        if min(self.goal - before, after - self.goal) <= slack or (step == 1 and self.inside is not None):
            if self.inside is None:
                self.node.key, self.node.sub = nearest, None
            else:
                self.node.key, self.node.sub = self.inside, nearest
            return True
        self.before = before
        if step == 1:
            self.inside, self.low, self.high, self.column = start, 0, (1 << 63) - 1, "sub"
        else:
            self.low, self.high = start, min(stop - 1, self.high)
        return False


def _split_level(items: DataFrame, root: Node, active: list[Node], dimensions: int, slack: float,
                 width: list[int]) -> None:
    """Find the cuts of all active nodes."""
    at = root.assign(lambda n: active.index(n) if n in active else -1).alias("node")
    values = [F.shiftright(f"k{i}", 32) for i in range(dimensions)]
    stats = items.select(at, "size", *[v.alias(f"v{i}") for i, v in enumerate(values)]).where("node >= 0").groupBy(
        "node").agg(F.sum("size").alias("bytes"), *[f(f"v{i}") for i in range(dimensions) for f in (F.min, F.max)])
    found = {row[0]: row[1:] for row in stats.collect()}
    searches = []
    for i, node in enumerate(active):
        total, *ends = found.get(i, (0, *[0] * 2 * dimensions))
        spread = [(ends[2 * d + 1] - ends[2 * d]) / max(1, width[d]) for d in range(dimensions)]
        node.dimension = max(range(dimensions), key=lambda d: spread[d])
        low, high = ends[2 * node.dimension], ends[2 * node.dimension + 1]
        searches.append(_Search(node, total * (node.shards // 2) / node.shards, low << 32, ((high + 1) << 32) - 1,
                                f"k{node.dimension}"))
    open_searches = dict(enumerate(searches))
    while open_searches:
        bucket = F.lit(None).cast("bigint")
        for i, s in open_searches.items():
            held = F.col(s.column).between(s.low, s.high)
            if s.inside is not None:
                held = held & (F.col(f"k{s.node.dimension}") == s.inside)
            place = F.expr(f"({s.column} - {s.low}L) div {s.step}L")
            bucket = F.when((F.col("node") == i) & held, place).otherwise(bucket)
        sums: dict[int, dict[int, int]] = {i: {} for i in open_searches}
        counted = items.select("*", at).select("node", "size", bucket.alias("bucket")).where("bucket IS NOT NULL")
        for node, b, n in counted.groupBy("node", "bucket").agg(F.sum("size")).collect():
            sums[node][b] = n
        open_searches = {i: s for i, s in open_searches.items() if not s.narrow(sums[i], slack)}
    for node in active:
        half = node.shards // 2
        node.left, node.right = Node(node.first, half), Node(node.first + half, node.shards - half)


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_column: str = "doc_id",
              text_column: str = "text", metadata: tuple[str, ...] = ("source", "lang"),
              scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard`` for every row.

    Either the number of shards or the bytes a shard should have is given.
    """
    scratch = scratch or Scratch(docs.sparkSession, "kd-shards")
    items, dimensions = _measured(scratch, docs, id_column, text_column, metadata)
    ends = items.agg(F.sum("size"), *[F.max(F.shiftright(f"k{i}", 32)) for i in range(dimensions)]).first()
    total, width = ends[0] or 0, [w or 0 for w in ends[1:]]
    if shards is None:
        shards = max(1, -(-total // target_bytes)) if target_bytes else 1
    root = Node(0, shards)
    while total and (active := [n for n in root.leaves() if n.shards > 1]):
        _split_level(items, root, active, dimensions, TOLERANCE * total / shards, width)
    return items.select("doc_id", "size", F.col("crc").alias("text_crc32"),
                        root.assign(lambda n: n.first).cast("int").alias("shard"))


def with_slots(scratch: Scratch, sharded: DataFrame) -> DataFrame:
    """Add ``slot``, the row's place in its shard in the order of the ids, counted from 0."""
    placed = positions(scratch, sharded, ["shard", "doc_id", "text_crc32", "size"], table="sharded")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(first, "shard").withColumn("slot", F.col("position") - F.col("first")).drop("position", "first")
