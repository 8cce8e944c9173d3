"""Exact top-k search by inner product: columnar branch and bound.

Vectors are dealt into blocks and stored vertically (dimension by dimension). A block of queries meets a block of candidates: the
scores grow a block of dimensions at a time, and after each the candidates are compacted to those whose partial score plus the
bound of what is left (norm of the rest of the query times norm of the rest of the candidate, Cauchy-Schwarz) still reaches the
query's k-th best score so far. What is left at the end is exact; nothing is approximated.

Groups of query blocks meet groups of candidate blocks. Such a cell is one task's work: it holds its queries, takes its candidate blocks one
after another and carries the k best so far, and with them the bound, from one to the next. A block is sent once for each group of the
other side, in the narrowest integers that hold it, so no copy of a block is made for every pair; the k best of
all cells meet in a top-k per query, and no task sees all rows.

Null and edge cases
* vectors that are null or empty, or hold null or non-finite components, and null ids take no part.
* vectors of different length are not compared. Repeated ids are rows of their own: a query skips its own row only.
* ties go to the smaller id; fewer candidates than k give all of them; an empty table gives an empty result.
* scores beyond 64 bits saturate, before ranking; blocks whose sums could leave 53 bits are multiplied in integers, beyond 63 bits in Python's.
* other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a candidate block, and queries in a query block.
BLOCK, QUERIES = 4096, 512
#: Dimensions added between two compactions.
STEP = 16
#: Components of the queries, and of the candidates, that a cell holds at most (but for one block); cells for each core where these allow fewer.
HELD, CELLS = 1 << 21, 4
_LONG = (1 << 63) - 1


def _quantised(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors, a row each: float64 where sums of products are exact in it, else Python integers."""
    values = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    out = np.floor(values * scale)
    if out.size and np.abs(out).max() > 1e15:
        out = np.array([[int(v) for v in row] for row in out.tolist()], dtype=object)
    return out


def blocks(vectors: DataFrame, id_col: str, vec: str, scale: int) -> DataFrame:
    """One row per block: block, dim, ids, wide, data (dimension-major integers as bytes or text)."""
    good = vectors.where(F.col(id_col).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    n = good.count()
    dealt = good.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).repartition(max(1, -(-n // BLOCK)))
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("data", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column(1)))
            for dim in np.unique(lengths):
                at = np.nonzero(lengths == dim)[0]
                for k in range(0, len(at), BLOCK):
                    part = batch.take(pa.array(at[k : k + BLOCK]))
                    # vertical layout: all first components, all second components, ...
                    kind, body = _packed(_quantised(part.column(1), scale).T)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()), pa.array([int(dim)], pa.int32()), pa.array([part.column(0).to_pylist()], schema.field("ids").type), pa.array([kind]), pa.array([body], pa.binary())],
                        schema=schema,
                    )
                    number += 1

    return written(dealt.mapInArrow(pack, "block long, dim int, ids array<long>, kind string, data binary"), "vector-blocks")


def _packed(matrix: np.ndarray) -> tuple[str, bytes]:
    """Kind and bytes of a matrix of integers, in the narrowest kind that holds all of them."""
    if matrix.dtype == object:
        return "text", "\n".join(map(str, matrix.ravel().tolist())).encode()
    most = np.abs(matrix).max(initial=0)
    kind = next((k for k, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if most <= top), "<f8")
    return kind, np.ascontiguousarray(matrix).astype(kind).tobytes()


def _columns(dim: int, kind: str, data: bytes) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in data.split(b"\n")], dtype=object).reshape(dim, -1)
    return np.frombuffer(data, dtype=kind).reshape(dim, -1).astype(np.float64)


def best_in_block(q: np.ndarray, c: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (a column of ``q``) the k best candidates (columns of ``c``): (query, candidate indices, scores).

    own: the query's own column among the candidates, -1 if it isn't there. floors: scores below which a query needs no candidate.
    """
    dims, n = c.shape
    exact = q.dtype != object and c.dtype != object
    if exact and dims * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) >= 2**53:
        exact = False
    if not exact:
        whole = np.array([[int(x) for x in r] for r in q.T.tolist()], dtype=object).dot(np.array([[int(x) for x in r] for r in c.tolist()], dtype=object))
        for i in range(q.shape[1]):
            scores = np.array([max(-_LONG - 1, min(_LONG, x)) for x in whole[i].tolist()], dtype=np.int64)
            order = sorted((j for j in range(n) if j != own[i]), key=lambda j: (-int(scores[j]), ids[j]))[:k]
            yield i, np.array(order, dtype=np.int64), scores[order]
        return
    edges = [*range(0, dims, STEP), dims]
    # what the dimensions from each edge on can still add: squared norms, summed from the back
    rest_c = [np.sqrt((c[a:] ** 2).sum(0)) for a in edges[1:]]
    rest_q = [np.sqrt((q[a:] ** 2).sum(0)) for a in edges[1:]]
    first = c[edges[0] : edges[1]]
    start = q[edges[0] : edges[1]].T @ first  # the first dimension block of all queries at once
    for i in range(q.shape[1]):
        left = np.arange(n)
        score = start[i]
        if own[i] >= 0:
            left = np.delete(left, own[i])
            score = score[left]
        floor = -np.inf if floors is None else floors[i]
        for step in range(1, len(edges)):
            if step > 1:
                a, b = edges[step - 1], edges[step]
                score = score + q[a:b, i] @ c[a:b, left]
            slack = rest_q[step - 1][i] * rest_c[step - 1][left] * (1 + 1e-9)
            if len(left) > k:
                # the k-th best of what every candidate reaches for sure bounds the k-th best score from below
                floor = max(floor, np.partition(score - slack, len(left) - k)[len(left) - k])
            if floor > -np.inf:
                keep = score + slack >= floor - 1e-6 * (1 + abs(floor))
                if not keep.all():
                    left, score = left[keep], score[keep]
            if not len(left):
                break
        order = np.lexsort((ids[left], -score))[:k]
        yield i, left[order], score[order].astype(np.int64)


class _Asked:
    """A query block in a cell, with the k best candidates of each query so far."""

    def __init__(self, block: int, at: list, ids: list, columns: np.ndarray, k: int):
        self.block, self.at, self.ids, self.columns, self.k = block, np.array(at, dtype=np.int64), ids, columns, k
        none = np.empty(0, dtype=np.int64)
        self.best = [(none, none) for _ in ids]
        self.floors = np.full(len(ids), -np.inf)

    def meet(self, block: int, ids: np.ndarray, columns: np.ndarray) -> None:
        own = self.at if block == self.block else np.full(len(self.at), -1)
        for i, found, scores in best_in_block(self.columns, columns, ids, own, self.k, self.floors):
            if len(found):
                all_ids, all_scores = (np.concatenate(x) for x in zip(self.best[i], (ids[found], scores)))
                # the complement orders as the negative does, and has no overflow
                order = np.lexsort((all_ids, ~all_scores))[: self.k]
                self.best[i] = all_ids[order], all_scores[order]
                if len(order) == self.k:
                    self.floors[i] = float(all_scores[order[-1]])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(ids) for ids, _ in self.best]
        query, row = (np.repeat(np.array(x, dtype=np.int64), sizes) for x in (self.ids, (self.block << 13) + self.at))
        ids, scores = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in ([b[j] for b in self.best] for j in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (query, row, ids, scores)], names=["query_id", "q_row", "vec_id", "score"])


def _cells(stored: DataFrame, asked: DataFrame) -> tuple[int, int]:
    """Groups of query blocks and of candidate blocks."""
    size = F.sum(F.size("ids").cast("long") * F.col("dim"))
    (n_stored, stored_size), (n_asked, asked_size) = ((r[0], r[1] or 0) for r in (x.agg(F.count(F.lit(1)), size).first() for x in (stored, asked)))
    wanted = CELLS * stored.sparkSession.sparkContext.defaultParallelism
    queries = max(1, min(n_asked, max(-(-asked_size // HELD), -(-wanted // max(1, n_stored)))))
    return queries, max(1, min(n_stored, max(-(-stored_size // (4 * HELD)), -(-wanted // queries))))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", query_every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score: every row whose id is divisible by ``query_every`` against all rows.

    The score is the inner product of floor(scale * x). Query blocks visit every candidate block of their dimension.
    """
    stored = blocks(vectors, id_col, vec, scale)
    kinds = "block long, dim int, at array<long>, ids array<long>, kind string, data binary"
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("at", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("data", pa.binary())])

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array(row["ids"], dtype=np.int64)
                at = np.nonzero(ids % query_every == 0)[0]
                columns = _columns(row["dim"], row["kind"], row["data"])
                for j in range(0, len(at), QUERIES):
                    own = at[j : j + QUERIES]
                    kind, body = _packed(columns[:, own])
                    yield pa.RecordBatch.from_pydict({"block": [row["block"]], "dim": [row["dim"]], "at": [own.tolist()], "ids": [ids[own].tolist()], "kind": [kind], "data": [body]}, schema=schema)

    asked = written(stored.mapInArrow(queries, kinds), "query-blocks")
    # every query block against every candidate block of its dimension: a stated query set against all rows, in cells of groups of blocks
    of_asked, of_stored = _cells(stored, asked)

    def group(n: int):
        # blocks are numbered by the task that made them, nearly always one, so their groups are even
        return F.pmod(F.shiftright("block", 20) + F.col("block").bitwiseAND(F.lit((1 << 20) - 1)), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumn("q", group(of_asked)).withColumn("c", every(of_stored)).withColumn("side", F.lit(0))
    right = stored.withColumn("c", group(of_stored)).withColumn("q", every(of_asked)).withColumns({"side": F.lit(1), "at": F.lit(None).cast("array<long>")})
    cells = left.unionByName(right).repartition(3 * of_asked * of_stored, "dim", "q", "c").sortWithinPartitions("dim", "q", "c", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(j)[r] for j, name in enumerate(batch.schema.names)}
                now = tuple(row[x].as_py() for x in ("dim", "q", "c"))
                if now != cell:
                    yield from (x.rows() for x in held)
                    cell, held = now, []
                if row["side"].as_py() == 1 and not held:
                    continue
                columns = _columns(now[0], row["kind"].as_py(), row["data"].as_py())
                if row["side"].as_py() == 0:
                    held.append(_Asked(row["block"].as_py(), row["at"].as_py(), row["ids"].as_py(), columns, k))
                    continue
                ids = np.array(row["ids"].as_py(), dtype=np.int64)
                for x in held:
                    x.meet(row["block"].as_py(), ids, columns)
        yield from (x.rows() for x in held)

    found = cells.mapInArrow(search, "query_id long, q_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
