"""Exact top-k inner-product search: a ball tree for each shard, best-first branch and bound.

Vectors are whole numbers floor(scale * x).  Queries are a stated set: they are searched in blocks, each broadcast to
the tasks that read the candidates.  A task makes a tree of every SHARD_ROWS candidates that it reads, once a block,
and searches all queries of the block in it; each query's k-th score goes on from tree to tree as the bound to beat.
A first round searches one shard, chosen by a hash, and its k-th scores are shared with all tasks.  So candidates are
never moved or copied, and what a task holds is fixed.  Scores are whole numbers throughout; doubles serve as bounds of
nodes, widened by their rounding, and as scores only where they are exact.

Defined results: rows with a null id, and vectors that are null or hold null or non-finite components, take no
part; a query meets only candidates of its own dimension; of the candidates with its id and its vector one is its own
row and left out; repeated query rows are queries of their own, with results under the same id; ties go to the smaller
id; too few candidates give fewer rows; empty tables give no row; other columns are not read.  A score beyond a long
is an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pallium.llm.common import saved, slices

SCALE = 1024
K = 10
LEAF = 64
SHARD_ROWS = 16_384
#: Queries of a block, and components of them.
BLOCK_QUERIES, BLOCK_SIZE = 16_384, 1 << 21
#: Doubles hold products of whole numbers exactly up to here.
_EXACT = float(1 << 52)
#: Below every score.
LEAST = -(1 << 63)


class BallTree:
    """Nodes as arrays: centre, radius, smallest id, children or rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.float64)
        self.whole = rows[order]
        centres, radii, self.low_id, self.kids, self.span = [], [], [], [], []
        index = np.arange(len(ids))

        def add(start: int, end: int) -> int:
            mine = index[start:end]
            centre = self.rows[mine].mean(0)
            away = np.sqrt(((self.rows[mine] - centre) ** 2).sum(1))
            me = len(centres)
            centres.append(centre)
            radii.append(away.max())
            self.low_id.append(self.ids[mine].min())
            self.kids.append(None)
            self.span.append((start, end))
            if end - start > leaf and radii[me] > 0:
                far = self.rows[mine[away.argmax()]]
                other = self.rows[mine[((self.rows[mine] - far) ** 2).sum(1).argmax()]]
                index[start:end] = mine[np.argsort(self.rows[mine] @ (other - far), kind="stable")]
                middle = (start + end) // 2
                self.kids[me] = (add(start, middle), add(middle, end))
            return me

        add(0, len(ids))
        self.index = index
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.norm = float(np.sqrt((self.rows**2).sum(1)).max())

    def search(self, queries: np.ndarray, bounds, k: int = K):
        """(query row, rows of the tree, scores) of at most k best candidates that reach the query's bound, a whole number."""
        real = queries.astype(np.float64)
        length = np.sqrt((real**2).sum(1))
        exact = length.max(initial=0.0) * self.norm < _EXACT
        for at in range(0, len(queries), 512):
            upper = real[at : at + 512] @ self.centres.T + length[at : at + 512, None] * self.radii[None]
            upper += 0.5 + 1e-9 * (length[at : at + 512, None] * (self.norm + 1))  # rounding of the bound itself
            for q in range(at, min(at + 512, len(queries))):
                if upper[q - at, 0] >= bounds[q]:
                    yield q, *self._one(real[q], queries[q], upper[q - at], int(bounds[q]), k, exact)

    def _one(self, real, whole, upper, bound, k, exact):
        best_rows, best = np.zeros(0, np.int64), np.zeros(0, object if not exact else np.float64)
        heap = [(-upper[0], 0)]
        while heap:
            up, node = heapq.heappop(heap)
            if -up < bound:
                break
            if self.kids[node]:
                for child in self.kids[node]:
                    if upper[child] >= bound:
                        heapq.heappush(heap, (-upper[child], child))
                continue
            start, end = self.span[node]
            mine = self.index[start:end]
            score = self.rows[mine] @ real if exact else self.whole[mine].astype(object) @ whole.astype(object)
            keep = score >= bound
            if not keep.any():
                continue
            rows, score = np.concatenate((best_rows, mine[keep])), np.concatenate((best, score[keep]))
            # rows are in the order of their ids
            order = np.lexsort((rows, -score))[:k] if exact else np.array(sorted(range(len(rows)), key=lambda i: (-score[i], rows[i]))[:k])
            best_rows, best = rows[order], score[order]
            if len(best) == k:
                bound = max(bound, int(best[-1]))
        return best_rows, best


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine).select(F.col(id_col).alias("vec_id"), whole.alias("v"))


class Best:
    """The best `keep` candidates of each query of a block so far, and its bound."""

    def __init__(self, queries: "Block", keep: int):
        self.queries, self.keep = queries, keep
        self.found: list[list[tuple]] = [[] for _ in queries.ids]
        self.bounds = list(queries.bounds)

    def search(self, ids: np.ndarray, rows: np.ndarray) -> None:
        mine = self.queries.of_size.get(rows.shape[1])
        if mine is None:
            return
        tree = BallTree(ids, rows)
        vectors = self.queries.vectors[rows.shape[1]]
        for q, at, scores in tree.search(vectors, [self.bounds[k] for k in mine], self.keep):
            k = mine[q]
            same = (tree.ids[at] == self.queries.ids[k]) & (tree.whole[at] == vectors[q]).all(1)
            # best first: higher scores, then smaller ids
            new = list(zip((-int(s) for s in scores), tree.ids[at].tolist(), same.tolist()))
            self.found[k] = list(heapq.merge(self.found[k], new))[: self.keep] if self.found[k] else new
            if len(self.found[k]) == self.keep:
                self.bounds[k] = max(self.bounds[k], -self.found[k][-1][0])


class Block:
    """Queries: ids, vectors by dimension, and the score each has to reach."""

    def __init__(self, ids: list, vectors: list[list[int]]):
        self.ids, self.bounds = ids, [LEAST] * len(ids)
        self.of_size: dict[int, list[int]] = {}
        for k, v in enumerate(vectors):
            self.of_size.setdefault(len(v), []).append(k)
        self.vectors = {n: np.array([vectors[k] for k in rows], np.int64).reshape(len(rows), n) for n, rows in self.of_size.items()}


def _searched(candidates: DataFrame, block: Block, keep: int, id_kind: str) -> DataFrame:
    """(q, vec_id, score, same) of each task's best candidates of each query of the block."""
    spread = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        best = Best(spread.value, keep)
        held: dict[int, list] = {}
        for batch in batches:
            for part in slices(batch, SHARD_ROWS):
                ids, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                for n in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == n)
                    values = lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), n)
                    mine = held.setdefault(n, [[], [], 0])
                    mine[0].append(ids[rows])
                    mine[1].append(values)
                    mine[2] += len(rows)
                    if mine[2] >= SHARD_ROWS:
                        best.search(np.concatenate(mine[0]), np.concatenate(mine[1]))
                        del held[n]
        for ids, values, _ in held.values():
            best.search(np.concatenate(ids), np.concatenate(values))
        rows = [(q, i, -score, same) for q, found in enumerate(best.found) for score, i, same in found]
        for at in range(0, len(rows), 1 << 16):
            q, i, score, same = zip(*rows[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i), pa.array(score, pa.int64()), pa.array(same)], ["q", "vec_id", "score", "same"])

    return candidates.select("vec_id", "v").mapInArrow(run, f"q int, vec_id {id_kind}, score long, same boolean")


def _ranked(found: DataFrame, keep: int, k: int) -> DataFrame:
    """The k best of each query, ranked, after the first row marked as its own is passed over."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", F.col("same").desc())
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    before = F.max(F.col("same").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = F.col("same") & (F.coalesce(before, F.lit(0)) == 0)
    passed = F.max(F.col("same").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumns({"own": own, "rank": F.col("place") - passed}).filter(~F.col("own") & (F.col("rank") <= k))


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `vectors` for each row of `queries`, its own row left out."""
    spark = vectors.sparkSession
    id_kind = vectors.schema[id_col].dataType.simpleString()
    rows = quantised(vectors, id_col, vector_col, scale)
    wanted = quantised(queries, id_col, vector_col, scale)
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-size["n"] // BLOCK_QUERIES), -(-size["size"] // BLOCK_SIZE))
    if blocks > 1:
        wanted = saved(wanted, "queries")
    shards, first = -(-rows.count() // SHARD_ROWS), None
    if shards > 1:  # about one shard, which all queries search first
        first = saved(rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("first")), F.lit(shards)) == 0).repartition(1), "first-shard")
    keep, out = k + 1, None  # one more, since a query's own row may be among them
    for number in range(blocks):
        asked = wanted.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == number).collect() if blocks > 1 else wanted.collect()
        block = Block([r["vec_id"] for r in asked], [r["v"] for r in asked])
        if not asked:
            continue
        if first is not None:
            kth = _searched(first, block, keep, id_kind).groupBy("q").agg(F.when(F.count("*") >= keep, F.min("score")).alias("kth"))
            for r in kth.filter("kth is not null").collect():
                block.bounds[r["q"]] = r["kth"]
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"q int, query_id {id_kind}")
        found = _searched(rows, block, keep, id_kind)
        best = _ranked(found, keep, k).join(F.broadcast(ids), "q").select("query_id", "rank", "vec_id", "score")
        out = best if out is None else out.union(best)
    empty = spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score long")
    return empty if out is None else out
