"""Exact top-k by inner product with the threshold algorithm.

Vectors are dealt into blocks, and so are queries; each pair of a candidate
block and a query block is one group of an equi-join on block numbers, so no
group depends on the size of the table.  In a group every dimension has a list
of its candidates sorted by value.  A query reads all lists from the end its own
component favours, looks up the whole vector of whatever it meets, and stops
when the best score an unseen candidate could have, the inner product with the
values it has come to, is below its k-th score, or when none is unseen.  Scores and ties are exact, also
where vectors are so alike that a query has to read its lists to the end.

Vectors that are null or hold a null or non-finite component take no part.
Rows are told apart by a key of their own: rows with equal ids, or without an
id, are candidates each by itself, a query leaves out only its own row, and of
several queries with one id each gets its own ranks.  Rows without an id come
after all others of equal score.  Shorter vectors are filled up with zeros.
Scores beyond a 64-bit whole number stop at its ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftscope.llm.scratch import Scratch

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
FIRST_DEPTH, DEEPER = 64, 4


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (
        F.abs(x.cast("double")) <= F.lit(float(np.finfo(np.float64).max))))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def threshold_top(vectors: np.ndarray, queries: np.ndarray, own_places: np.ndarray,
                  k: int) -> list[tuple[int, int, int]]:
    """(place of the query, place of the candidate, score) of the k best of these candidates for each query.

    Candidates come in the order that decides ties.  ``own_places`` says which
    candidate is the query itself, -1 if none of these.
    """
    n, width = vectors.shape
    # Python numbers keep scores whole where doubles would not
    bound = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0))
    kind = np.float64 if bound * max(width, 1) < 2.0 ** 53 else object
    values, wanted = vectors.astype(kind), queries.astype(kind)
    lists = np.argsort(vectors, axis=0, kind="stable")  # ascending
    ordered = np.take_along_axis(values, lists, axis=0)
    out = []
    for number, (own, query) in enumerate(zip(own_places.tolist(), wanted)):
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        done, score = np.zeros(n, bool), np.zeros(n, kind)
        depth = min(FIRST_DEPTH, n)
        while True:
            seen = np.zeros(n, bool)
            seen[lists[n - depth:, up]] = True
            seen[lists[:depth, down]] = True
            if depth == n:
                seen[:] = True  # lists of components that are zero hold every candidate as well
            new = np.flatnonzero(seen & ~done)
            score[new] = values[new] @ query
            done |= seen
            met = np.flatnonzero(done)
            met = met[met != own]
            if depth == n or done.all():
                break
            if len(met) >= k:
                last = np.partition(score[met], len(met) - k)[len(met) - k] if kind is np.float64 else \
                    sorted(score[met])[-k]
                if ordered[n - depth, up] @ query[up] + ordered[depth - 1, down] @ query[down] < last:
                    break
            depth = min(depth * DEEPER, n)
        if len(met) > k and kind is np.float64:
            last = np.partition(score[met], len(met) - k)[len(met) - k]
            met = met[score[met] >= last]
        best = sorted(zip([-int(s) for s in score[met]], met.tolist()))[:k]
        out += [(number, i, max(-2 ** 63, min(2 ** 63 - 1, -s))) for s, i in best]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id",
          vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds its k best other rows.

    Equal scores are ranked by the smaller id.
    """
    scratch = Scratch(vectors.sparkSession, "top-k")
    rows = vectors.where(usable(F.col(vector_column))).select(
        F.col(id_column).cast("bigint").alias("id"), quantized(F.col(vector_column), scale).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    # arrays of ids keep whole numbers whole beside nulls; the keys hold once they are written
    rows = scratch.keep(rows.select(F.monotonically_increasing_id().alias("key"), F.col("id").isNull().alias("nameless"),
                                    F.coalesce("id", F.lit(0)).alias("id"), "v", "asks"), "vectors")
    candidates, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = -(-candidates // CANDIDATE_BLOCK) or 1, -(-asking // QUERY_BLOCK) or 1

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        block = F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")
        return df.select("key", "nameless", "id", "v", block.alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    base = dealt(rows, "b", blocks, "q", query_blocks).groupBy("b", "q")
    asked = dealt(rows.where("asks"), "q", query_blocks, "b", blocks).groupBy("b", "q")

    def search(key, some: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(some) and len(queries):
            some = some.sort_values(["nameless", "id", "key"], ignore_index=True)
            width = max(max(map(len, some["v"])), max(map(len, queries["v"])))
            own = pd.Index(some["key"]).get_indexer(queries["key"])
            found = threshold_top(_matrix(some["v"], width), _matrix(queries["v"], width), own, k)
        asker, place, score = (np.array([f[i] for f in found], np.int64) for i in range(3))
        out = {f"query_{c}": queries[c].to_numpy()[asker] for c in ("key", "nameless", "id")}
        return pd.DataFrame(out | {c: some[c].to_numpy()[place] for c in ("nameless", "id", "key")} | {"score": score})

    found = base.cogroup(asked).applyInPandas(
        search, "query_key bigint, query_nameless boolean, query_id bigint, nameless boolean, id bigint, key bigint, "
                "score bigint")
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "nameless", "id", "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.expr("if(query_nameless, NULL, query_id)").alias("query_id"), "rank",
        F.expr("if(nameless, NULL, id)").alias("vec_id"), "score")
