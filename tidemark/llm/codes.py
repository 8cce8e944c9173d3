"""Vector codes: vectors are cut into parts, and each part is named by the nearest entry of its position's codebook.

Integer k-means with the pivots of LAESA: distances from every part to a few fixed pivots are computed once and stored beside the
vectors. Each round computes the distances from the pivots to the entries only; the largest difference of the two over all
pivots is a lower bound of the distance from part to entry. The entries of the lowest bounds are evaluated first, in whole numbers; others
only if their bound stays within the best distance found, and ties go to the lower index.

Null and edge cases
* vectors that are null, empty or hold null or non-finite components take no part, nor do vectors whose length is not that of
  the vector with the smallest id, or not a multiple of ``parts`` (where it is the smallest one's, no vector takes part).
* equal ids are separate rows, ordered by their components; null ids come after all others.
* fewer vectors than entries give smaller codebooks; entries that no part uses stay as they are.
* components so large that squared distances leave 64 bits (131,072 at 64 components) end the job with a clear error.
* an empty table gives an empty result; null labels are one label; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, map_batches, written

#: Pivots of each part position, entries evaluated before the others, and the share (one in MANY) of open pairs above which a block is
#: evaluated as a whole; parts in a block.
PIVOTS, WAVE, MANY, BLOCK = 8, 8, 10, 256


def whole_vectors(vectors: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    """id, label and the vector as whole numbers floor(scale * x), for vectors of finite components."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * float(scale)))
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite).select(
        F.col(id_col).alias("id"), F.col(label).alias("label"), x.cast("array<long>").alias("x")
    )


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two arrays of whole numbers."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def spread_pivots(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` entries far from each other: each the farthest from those before."""
    if not len(entries):
        return entries
    chosen = [0]
    near = _distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(n, len(entries)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance, pairs left open by the bounds) for each part; ties to the lower index.

    The entries of the lowest bounds go first; of the others only those are evaluated whose bound stays within the best distance
    found. Open pairs are evaluated one by one where they are few, and by a product of the whole block where they are many.
    """
    n, k = len(x), len(entries)
    far, near = to_pivots.astype(np.float32), entry_to_pivots.T.astype(np.float32)
    bound, one = np.zeros((n, k), dtype=np.float32), np.empty((n, k), dtype=np.float32)
    for p in range(far.shape[1]):
        np.subtract(far[:, p : p + 1], near[p][None, :], out=one)
        np.abs(one, out=one)
        np.maximum(bound, one, out=bound)
    # distances are rounded square roots: a margin keeps the bound below the true distance
    bound -= np.float32(1e-6) * (far.max(initial=0) + near.max(initial=0))
    np.maximum(bound, 0, out=bound)
    bound *= bound
    best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, k, dtype=np.int64)

    def visit(r: np.ndarray, e: np.ndarray) -> None:
        if len(r):
            d = ((x[r] - entries[e]) ** 2).sum(axis=1)
            order = np.lexsort((e, d, r))
            lead = order[np.concatenate([[True], r[order][1:] != r[order][:-1]])]
            who = r[lead]
            better = (d[lead] < best[who]) | ((d[lead] == best[who]) & (e[lead] < at[who]))
            best[who[better]], at[who[better]] = d[lead][better], e[lead][better]

    def within() -> np.ndarray:
        return best.astype(np.float32)[:, None] * np.float32(1.000001)

    if not n:
        return at, best, 0
    every = np.arange(n)
    ahead = np.argpartition(bound, WAVE, axis=1)[:, :WAVE] if k > WAVE else np.broadcast_to(np.arange(k), (n, k))
    lowest = bound[every[:, None], ahead].argmin(axis=1)
    visit(every, ahead[every, lowest])
    rest = bound[every[:, None], ahead] <= within()
    r, c = np.nonzero(rest)
    visit(r, ahead[r, c])
    open_ = bound <= within()
    done = int(open_.sum())
    if done > n * k // MANY and x.shape[1] * float(max(np.abs(x).max(), np.abs(entries).max())) ** 2 < 2**50:
        a, b = x.astype(float), entries.astype(float)  # whole numbers below 2^53: exact
        d = (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        at = d.argmin(axis=1)  # the first of equal distances
        best = (d[every, at] + (a * a).sum(axis=1)).astype(np.int64)
    else:
        visit(*np.nonzero(open_))
    return at, best, done


def _laid_out(rows: DataFrame, parts: int, width: int, pivots: list[np.ndarray]) -> DataFrame:
    """id, label, the parts and their distances to the pivots of their position, as bytes."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    largest = math.isqrt(((1 << 63) - 1) // max(parts * width, 1)) // 2

    def lay(cols: dict) -> dict:
        n = len(cols["id"])
        x = np.asarray(cols["x"].flatten()).astype(np.int64).reshape(n, parts, width)
        if n and max(x.max(), -x.min()) > largest:
            raise ValueError("a component is too large for exact distances in 64 bits")
        far = [np.sqrt(_distances(x[:, p], pivots[p]).astype(float)) for p in range(parts)]
        return {"id": cols["id"], "label": cols["label"], "x": [v.tobytes() for v in x.astype("<i4")],
                "far": [b"".join(f[i].astype("<f8").tobytes() for f in far) for i in range(n)]}

    return map_batches(rows, lay, f"{kinds}, x binary, far binary")


def _unpacked(cols: dict, parts: int, width: int, pivots: list[np.ndarray]):
    """For each part position (parts, distances to its pivots)."""
    n = len(cols["x"])
    x = np.frombuffer(b"".join(cols["x"].to_pylist()), dtype="<i4").reshape(n, parts, width).astype(np.int64)
    far = np.frombuffer(b"".join(cols["far"].to_pylist()), dtype="<f8").reshape(n, sum(map(len, pivots)))
    at = 0
    for p in range(parts):
        yield x[:, p], far[:, at : at + len(pivots[p])]
        at += len(pivots[p])


def _assigned(cols: dict, books: list[np.ndarray], pivots: list[np.ndarray], to_entries: list[np.ndarray], parts: int, width: int):
    """Per part position (parts, entry of each, squared distance)."""
    for p, (x, far) in enumerate(_unpacked(cols, parts, width, pivots)):
        at, best = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(0, len(x), BLOCK):
            a, b, _ = nearest(x[i : i + BLOCK], far[i : i + BLOCK], books[p], to_entries[p])
            at.append(a)
            best.append(b)
        yield x, np.concatenate(at), np.concatenate(best)


def _new_books(laid: DataFrame, books: list[np.ndarray], pivots: list[np.ndarray], parts: int, width: int) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of its parts; sums are combined in tasks before they are shuffled."""
    k = len(books[0])
    to_entries = [np.sqrt(_distances(b, p).astype(float)) for b, p in zip(books, pivots, strict=True)]
    cells = parts * k * (width + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), dtype=np.int64)
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for p, (x, at, _) in enumerate(_assigned(cols, books, pivots, to_entries, parts, width)):
                np.add.at(total[p, :, :width], at, x)
                total[p, :, width] += np.bincount(at, minlength=k)
        used = np.nonzero(np.repeat(total[:, :, width].ravel() > 0, width + 1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total.ravel()[used], pa.int64())], names=["cell", "n"])

    total = np.zeros(cells, dtype=np.int64)
    # one row for each component of each entry
    for cell, n in laid.select("x", "far").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        total[cell] = n
    total = total.reshape(parts, k, width + 1)
    count = total[:, :, width:]
    mean = total[:, :, :width] // np.maximum(count, 1)
    return [np.where(count[p] > 0, mean[p], books[p]) for p in range(parts)]


def codebooks_digest(books: list[np.ndarray]) -> str:
    """Hash of all components by part, entry and place, in decimal."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256,
             rounds: int = 4, scale: int = 1024) -> DataFrame:
    """id, code (hex digits of the entries in part order), error (squared distances summed), label_error (error summed over equal
    labels) and codebooks_sha256, for every vector that takes part.

    Codebooks are ``parts * entries`` short vectors and are the only thing that passes the driver. Labels that many rows share get their
    sums by a bounded broadcast, others by a join.
    """
    numbers = whole_vectors(vectors, id_col, vector, label, scale)
    first = numbers.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).select(F.size("x")).first()
    size = first[0] if first else 0
    width = size // parts if size % parts == 0 else 0
    kept = numbers.where((F.size("x") == size) & F.lit(width > 0))
    seed = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r[0] for r in seed], dtype=np.int64).reshape(len(seed), parts, max(width, 1))
    books = [start[:, p] for p in range(parts)]
    pivots = [spread_pivots(b) for b in books]
    laid = written(_laid_out(kept, parts, width, pivots), "vector-parts")
    for _ in range(rounds if len(seed) else 0):
        books = _new_books(laid, books, pivots, parts, width)
    to_entries = [np.sqrt(_distances(b, p).astype(float)) for b, p in zip(books, pivots, strict=True)]
    digits = f"{{:0{max(2, len(f'{entries - 1:x}'))}x}}"

    def code(cols: dict) -> dict:
        found = list(_assigned(cols, books, pivots, to_entries, parts, width))
        names = zip(*(at.tolist() for _, at, _ in found), strict=True)
        return {"id": cols["id"], "label": cols["label"], "code": ["".join(map(digits.format, n)) for n in names], "error": sum(best for _, _, best in found)}

    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    coded = written(map_batches(laid, code, f"{kinds}, code string, error long"), "vector-codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    return lookup(coded, written(totals, "label-errors"), "label", "__n", "inner").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )
