"""Helpers shared by the operators: shared folder, written tables, Arrow batches, bytes and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder as shared_dir

#: Words of the contracts that split at ASCII white space only.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of measured size up to this many bytes may be broadcast.
BROADCAST_BYTES = 64 << 20


def sized(table: DataFrame, size: int) -> DataFrame:
    """The table with the hint that its measured size allows: broadcast, or a join by shuffle."""
    return F.broadcast(table) if size <= BROADCAST_BYTES else table.hint("shuffle_merge")


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """The rows with the columns of a table of one row a key, nulls being equal; ``count`` says how many rows a key has.

    Keys with more than a thousandth of all rows are at most a thousand: they are broadcast, so that no key meets in one task. All
    others are joined by shuffle. ``table`` is read twice and should be written.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(200, total // 1000)
    own = table.withColumnRenamed(key, "__key").drop(*[c for c in rows.columns if c != key])
    same = F.col(key).eqNullSafe(F.col("__key"))
    often = F.broadcast(own.where(hot))
    rest = rows.join(F.broadcast(own.where(hot).select("__key")), same, "left_anti").join(own.where(~hot).hint("shuffle_merge"), same, how)
    return rows.join(often, same, "inner").unionByName(rest).drop("__key", count)


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from columns (name to Arrow array) to columns (name to list or array).

    Spark's own limit on the bytes of an Arrow batch bounds what one call sees.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type) for c, f in ((out[f.name], f) for f in target)],
                    schema=target,
                )

    return df.mapInArrow(run, schema)


def raw(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    for x in column:
        yield x.as_py() or b""


def texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


#: ASCII letters and digits stay (lower case), other ASCII becomes a space; bytes of non-ASCII characters stay.
_PLAIN = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case (A-Z only) words of ASCII letters and digits and of non-ASCII characters."""
    return text.translate(_PLAIN).split()


_MASK = (1 << 64) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.ones(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.uint64(base & _MASK)
        np.multiply.accumulate(out, out=out)
    return out


class WordHashes:
    """64-bit hashes of words, remembered up to a bounded number of distinct words."""

    def __init__(self, limit: int = 200_000):
        import xxhash

        self._hash, self._known, self._limit = xxhash.xxh3_64_intdigest, {}, limit

    def of(self, words: list[bytes]) -> np.ndarray:
        known, h = self._known, self._hash
        if len(known) > self._limit:
            known.clear()
        out = np.empty(len(words), dtype=np.uint64)
        try:
            out[:] = [known[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = h(w)
            out[:] = [known[w] for w in words]
        return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, from word hashes; empty where there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        base = 0x5851F42D4C957F2D
        if n <= 8:
            h = np.zeros(m, dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(base) + words[j : j + m]
            return mix(h)
        # doubling: hash of 2k words from two hashes of k words
        parts, span, h, at = [], 1, words, 0
        bits = n
        while bits:
            if bits & 1:
                parts.append((at, h))
                at += span
            bits >>= 1
            if bits:
                h = mix(h[: len(h) - span] * np.uint64(base) + h[span:])
                span *= 2
        out = np.full(m, n, dtype=np.uint64)
        for off, h in parts:
            out = mix(out * ODD + h[off : off + m])
        return out


def unit(*columns: Column) -> Column:
    """A number inside (0, 1) that depends on the columns alone."""
    return ((F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") + 0.5) / float(1 << 52)
