"""Ranked lexical search: exact inner products of sparse vectors, found with ball trees.

A document is a vector of whole numbers over terms, saturated frequencies that
its length tempers; an item is a vector of term weights times repeats.  Both are
taken over the terms of the items only, as no other adds to a product.

Each task holds documents in ball trees: a node has its documents' centroid
and, for each of ``GROUPS`` groups of terms, the radius around it.  By
Cauchy and Schwarz no document of a node scores more than

    q . c  +  sum over groups of |q_g| r_g

and this bound is rounded up by more than its arithmetic can be off.  An item
goes to the open node with the highest bound first, and is done with a tree when
no open bound reaches its k-th score so far, which is carried from tree to tree.
Documents of a leaf are scored in exact 64-bit arithmetic.  Scores equal to the
k-th are looked at as well, because ties go to the smaller id.

Items are read in blocks of bounded size, and each block goes over all documents.

* Null texts and texts without a term have no score; items without a term, or
  none of whose terms occur, get no rows.
* Every row is a document and every item row an item of its own, repeated and
  null ids too; documents without an id come last among equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftscope.llm.scratch import Scratch, positions

GROUPS = 4096
LEAF, TREE_DOCUMENTS, TREE_CELLS = 8, 1024, 8_000_000
BLOCK_BYTES = 1 << 20
_SLICE = 2000
# A-Z in lower case; digits, letters and all bytes beyond ASCII stay; the rest parts terms
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


# ---- ball trees -----------------------------------------------------------------------------------------------------

class Rows:
    """Sparse rows: columns and values of row i lie at edge[i]:edge[i + 1]."""

    def __init__(self, edge: np.ndarray, column: np.ndarray, value: np.ndarray, width: int):
        self.edge, self.column, self.value, self.width = edge, column, value, width
        self.n = len(edge) - 1
        self.row = np.repeat(np.arange(self.n), np.diff(edge))

    def take(self, rows: np.ndarray) -> "Rows":
        size = np.diff(self.edge)[rows]
        edge = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.edge[rows] - edge[:-1], size) + np.arange(edge[-1])
        return Rows(edge, self.column[at], self.value[at], self.width)

    def dot(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * vector[self.column], minlength=self.n)


class BallTree:
    """A balanced ball tree over sparse rows of non-negative values."""

    def __init__(self, rows: Rows, groups: int = GROUPS, leaf: int = LEAF):
        self.groups = min(groups, max(rows.width, 1))
        self.group = np.arange(rows.width) % self.groups
        self.centre, self.radius, self.child, self.leaf_of = [], [], [], []
        self.order: list[np.ndarray] = []
        square = np.bincount(rows.row, rows.value.astype(float) ** 2, minlength=rows.n)
        self._grow(rows, np.arange(rows.n), square, leaf)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        # documents of each leaf, padded by row 0, whose place is then masked
        self.member = np.zeros((len(self.order), leaf), np.int64)
        self.filled = np.zeros((len(self.order), leaf), bool)
        for i, some in enumerate(self.order):
            self.member[i, :len(some)], self.filled[i, :len(some)] = some, True
        self.cell = np.zeros((len(self.order), rows.width, leaf), np.int32)
        where, at = np.empty(rows.n, np.int64), np.empty(rows.n, np.int64)
        for i, some in enumerate(self.order):
            where[some], at[some] = i, np.arange(len(some))
        self.cell[where[rows.row], rows.column, at[rows.row]] = rows.value

    def _grow(self, rows: Rows, ids: np.ndarray, square: np.ndarray, leaf: int) -> int:
        node, n = len(self.child), len(ids)
        centre = np.bincount(rows.column, rows.value, minlength=rows.width) / n
        own = centre[rows.column]
        spread = np.bincount(rows.row * self.groups + self.group[rows.column], (rows.value - own) ** 2 - own ** 2,
                             minlength=n * self.groups).reshape(n, self.groups)
        base = np.bincount(self.group, centre ** 2, minlength=self.groups)
        # rounding of sums of so many terms stays far below this share of their size
        slack = 1e-9 * (base + square.max(initial=0) + 1)
        self.centre.append(centre)
        self.radius.append(np.sqrt(np.maximum(base + spread.max(axis=0), 0) + slack))
        self.child.append((-1, -1))
        self.leaf_of.append(-1)
        if n <= leaf:
            self.leaf_of[node] = len(self.order)
            self.order.append(ids)
            return node
        far = int(np.argmax(square - 2 * rows.dot(centre)))
        one = self._dense(rows, far)
        far = int(np.argmax(square - 2 * rows.dot(one)))
        # nearer to one pole or the other; cut at the middle, so that the tree is balanced
        order = np.argsort(rows.dot(one - self._dense(rows, far)), kind="stable")
        halves = [np.sort(order[:n // 2]), np.sort(order[n // 2:])]
        self.child[node] = tuple(self._grow(rows.take(h), ids[h], square[h], leaf) for h in halves)
        return node

    @staticmethod
    def _dense(rows: Rows, i: int) -> np.ndarray:
        out = np.zeros(rows.width)
        out[rows.column[rows.edge[i]:rows.edge[i + 1]]] = rows.value[rows.edge[i]:rows.edge[i + 1]]
        return out


class Best:
    """The k best (score, id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((items, k), np.int64), np.zeros((items, k), np.int64)
        self.none = np.zeros((items, k), bool)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, items: np.ndarray, score: np.ndarray, id: np.ndarray, none: np.ndarray) -> None:
        """More rows for some items, each named once; scores of 0 are no results."""
        some = (score.max(axis=1) >= self.score[items, -1]) & (score.max(axis=1) > 0)
        items = items[some]
        score, id, none = (np.concatenate([a[items], b[some]], axis=1)
                           for a, b in ((self.score, score), (self.id, id), (self.none, none)))
        best = np.lexsort((id, none, -score), axis=1)[:, :self.k]
        for kept, new in ((self.score, score), (self.id, id), (self.none, none)):
            kept[items] = np.take_along_axis(new, best, axis=1)


def search(tree: BallTree, items: Rows, ids: np.ndarray, none: np.ndarray, best: Best, count: Counter) -> None:
    """Offer ``best`` the documents of a tree, node by node from the highest bound, until no bound reaches the k-th score."""
    weight = np.zeros((items.n, items.width))
    weight[items.row, items.column] = items.value
    norm = np.sqrt(np.bincount(items.row * tree.groups + tree.group[items.column], items.value.astype(float) ** 2,
                               minlength=items.n * tree.groups)).reshape(items.n, tree.groups)
    bound = weight @ tree.centre.T + norm @ tree.radius.T
    bound = bound * (1 + 1e-9) + 1
    waiting = np.full(bound.shape, -1.0)
    waiting[:, 0] = bound[:, 0]
    child, leaf_of = np.array(tree.child), np.array(tree.leaf_of)
    active = np.flatnonzero(np.diff(items.edge) > 0)
    while len(active):
        node = np.argmax(waiting[active], axis=1)
        top = waiting[active, node]
        go = (top >= 0) & (top >= best.least()[active])
        active, node = active[go], node[go]
        waiting[active, node] = -1
        inner = leaf_of[node] < 0
        for side in (0, 1):
            below = child[node[inner], side]
            waiting[active[inner], below] = bound[active[inner], below]
        who, leaf = active[~inner], leaf_of[node[~inner]]
        if len(who):
            some = items.take(who)
            part = tree.cell[leaf[some.row], some.column].astype(np.int64) * some.value[:, None]
            score = np.add.reduceat(part, some.edge[:-1], axis=0)
            score[~tree.filled[leaf]] = 0
            count["scored"] += int(tree.filled[leaf].sum())
            rows = tree.member[leaf]
            best.offer(who, score, ids[rows], none[rows])


# ---- documents ------------------------------------------------------------------------------------------------------

def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n`` and the vocabulary's terms in each document, ascending, with their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.slice(at, _SLICE)
                n, term, times = [], [], []
                for text in part["text"]:
                    own = terms(text.as_py())
                    n.append(len(own))
                    found = np.fromiter((t for t in map(number, own) if t is not None), np.int32)
                    found, often = np.unique(found, return_counts=True)
                    term.append(found)
                    times.append(often.astype(np.int32))
                yield pa.record_batch({"doc_id": part["doc_id"], "n": pa.array(n, pa.int64()),
                                       "term": pa.array(term, pa.list_(pa.int32())), "times": pa.array(times, pa.list_(pa.int32()))})

    return docs.mapInArrow(vectors, T.StructType([
        T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("term", T.ArrayType(T.IntegerType())),
        T.StructField("times", T.ArrayType(T.IntegerType()))]))


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _batches(batch: pa.RecordBatch, width: int, factor: int, total: int) -> Iterator[tuple[Rows, np.ndarray, np.ndarray]]:
    """Rows of document values, of so many documents that a tree's cells stay bounded, with their ids."""
    at_most = max(LEAF, min(TREE_DOCUMENTS, TREE_CELLS // max(width, 1)))
    for at in range(0, len(batch), at_most):
        part = batch.slice(at, at_most)
        term, times = part["term"], part["times"]
        edge = term.offsets.to_numpy().astype(np.int64)
        column, often = term.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
        n = part["n"].to_numpy()
        length = np.array([75 + 25 * int(x) * factor // total for x in n], np.int64)
        value = 1_000_000_000 * often // (1000 * often + 12 * np.repeat(length, np.diff(edge)))
        null = part["doc_id"].is_null().to_numpy(zero_copy_only=False)
        yield Rows(edge - edge[0], column, value, width), part["doc_id"].fill_null(0).to_numpy().astype(np.int64), null


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text",
           item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
           scratch: Scratch | None = None, counted: list | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest scores above 0.

    ``counted`` gets one table per block of items: documents scored and documents there were for items.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ranked-search")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    asked = items.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("text")).withColumn(
        "size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1)
    placed = scratch.keep(positions(scratch, asked, ["item_id", "text"], "before", weight="size", table="items"), "placed")
    last = placed.agg(F.max(F.floor(F.col("before") / block_bytes))).first()[0]
    found = [_block(scratch, rows, placed.where(F.floor(F.col("before") / block_bytes) == block), k, block, counted)
             for block in range(0 if last is None else last + 1)]
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", items.schema[item_column].dataType),
                                                       T.StructField("rank", T.IntegerType()),
                                                       T.StructField("doc_id", docs.schema[id_column].dataType),
                                                       T.StructField("score", T.LongType())]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block(scratch: Scratch, rows: DataFrame, items: DataFrame, k: int, block: int, counted: list | None) -> DataFrame:
    spark = rows.sparkSession
    # one block of items: at most block_bytes and one item more
    texts = items.orderBy("before").select("item_id", "text").collect()
    own = [Counter(terms(r.text.encode() if r.text is not None else None)) for r in texts]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*own)))}
    vectors = scratch.keep(_vectors(rows, vocabulary), f"vectors-{block}")
    documents, total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row per term of the block
    holding = np.zeros(len(vocabulary), np.int64)
    for term, count in vectors.select(F.explode("term").alias("t")).groupBy("t").count().collect():
        holding[term] = count
    weight = [term_weight(documents, int(d)) for d in holding]
    known = [[(vocabulary[t], weight[vocabulary[t]] * n) for t, n in c.items()] for c in own]
    known = [sorted((t, q) for t, q in x if q > 0 and holding[t]) for x in known]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in known])]).astype(np.int64)
    flat = np.array([p for x in known for p in x], np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((edge, flat[:, 0].copy(), flat[:, 1].copy()))
    kind = rows.schema["doc_id"].dataType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, column, value = shared.value
        best, count = Best(len(edge) - 1, k), Counter()
        for batch in batches:
            part = batch.filter(pc.greater(batch["n"], 0))
            if not len(part) or not len(column):
                continue
            # a tree has the terms that its documents and items share
            used = np.intersect1d(np.unique(part["term"].flatten().to_numpy()), column)
            if not len(used):
                continue
            place = np.full(int(max(column.max(), used.max(), part["term"].flatten().to_numpy().max())) + 1, -1)
            place[used] = np.arange(len(used))
            near = place[column] >= 0
            mine = Rows(np.concatenate([[0], np.cumsum(np.bincount(
                np.repeat(np.arange(len(edge) - 1), np.diff(edge))[near], minlength=len(edge) - 1))]),
                place[column[near]], value[near], len(used))
            for vectors, ids, none in _batches(part, len(used), documents, total):
                keep = place[vectors.column] >= 0
                vectors = Rows(np.concatenate([[0], np.cumsum(np.bincount(vectors.row[keep], minlength=vectors.n))]),
                               place[vectors.column[keep]], vectors.value[keep], len(used))
                count["documents"] += vectors.n * int((np.diff(mine.edge) > 0).sum())
                search(BallTree(vectors), mine, ids, none, best, count)
        item, rank = np.nonzero(best.score > 0)
        out = {"item": item.astype(np.int32), "score": best.score[item, rank],
               "doc_id": pa.array(best.id[item, rank], mask=best.none[item, rank])}
        yield pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})
        # what was scored, and what there was to score
        yield pa.record_batch({"item": pa.array([-1, -2], pa.int32()), "score": pa.array([count["scored"], count["documents"]], pa.int64()),
                               "doc_id": pa.nulls(2, pa.int64())})

    part = scratch.keep(vectors.mapInArrow(find, "item int, score bigint, doc_id bigint"), f"best-{block}")
    if counted is not None:
        counted.append(part.where("item < 0").groupBy("item").agg(F.sum("score").alias("n")))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = part.where("item >= 0").withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(texts)], T.StructType(
        [T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema["item_id"].dataType)]))
    return best.join(names, "item").select("item_id", "rank", F.col("doc_id").cast(kind), "score")
