"""Document fingerprints: Lempel-Ziv phrases, hashed, and the smallest hashes kept as a signature.

Each text is parsed into LZ78 phrases (the longest phrase known so far and one more byte). The fingerprint holds the ``size``
smallest 32-bit hashes of the phrase set; two fingerprints estimate the Jaccard likeness of their phrase sets, as compression
distances do. Sets of fewer phrases are kept whole, so short texts compare exactly.

``next_text_fingerprints`` also compares each text with an edited one (its last half replaced by the start of the next text)
and with the next. Rows are range-partitioned and sorted by id; a task compares neighbours as they stream by, and the rows at
the ends of the tasks, two a task, are joined in a second small step. The part of the parse that a text and its edited text
share is done once.

Null and edge cases
* null text: empty. Empty texts have an empty fingerprint and likeness 1 to each other, 0 to others.
* equal ids: ordered by text hash; rows equal in both are interchangeable. A single row is its own next row.
* a null id sorts first. An empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, written

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _parse(text: bytes, at: int, seen: set[bytes], ends: list[int], stop: int) -> int:
    """Appends phrase ends from ``at`` on while phrases end at or before ``stop``; returns where the open phrase starts.

    Every prefix of a known phrase is known, so the longest known phrase can be sought from a guess, up or down.
    """
    k = 3
    while at < stop:
        if text[at : at + k] in seen:
            k += 1
            while at + k <= stop and text[at : at + k] in seen:
                k += 1
        else:
            while k > 1 and text[at : at + k - 1] not in seen:
                k -= 1
        if at + k > stop:
            # the phrase may be cut short by ``stop``: find it again without the guess
            k = 1
            while at + k <= stop and text[at : at + k] in seen:
                k += 1
            if at + k > stop:
                return at
        seen.add(text[at : at + k])
        at += k
        ends.append(at)
    return at


_BLOCK = 1 << 16
#: An LZ78 phrase of a text of n bytes has fewer than sqrt(2 n) + 1 bytes, so a block and a phrase more stay inside.
_UP, _DOWN = powers(_BASE, 2 * _BLOCK), powers(_INVERSE, 2 * _BLOCK)


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` smallest distinct values, rising."""
    if len(values) > 4 * size:
        few = np.unique(np.partition(values, 2 * size)[: 2 * size])
        if len(few) >= size:
            return few[:size]
    return np.unique(values)[:size]


def _signature(text: bytes, ends: list[int], size: int) -> np.ndarray:
    """The smallest ``size`` 32-bit hashes of the phrases, rising; a block of the text at a time."""
    best = np.empty(0, dtype=np.uint32)
    stop = np.array(ends, dtype=np.int64)
    start = np.concatenate([[0], stop[:-1]]) if ends else stop
    i = 0
    while i < len(stop):
        j = max(int(np.searchsorted(stop, start[i] + _BLOCK, side="right")), i + 1)
        data = np.frombuffer(text, dtype=np.uint8, count=int(stop[j - 1] - start[i]), offset=int(start[i]))
        a, b = start[i:j] - start[i], stop[i:j] - start[i]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
            hashes = mix((sums[b] - sums[a]) * _DOWN[a] + (b - a).astype(np.uint64))
        best = _smallest(np.concatenate([best, (hashes >> np.uint64(32)).astype(np.uint32)]), size)
        i = j
    return best


def fingerprint(text: bytes, size: int = 64) -> np.ndarray:
    ends: list[int] = []
    at = _parse(text, 0, set(), ends, len(text))
    if at < len(text):
        ends.append(len(text))  # the last phrase is a known one
    return _signature(text, ends, size)


def edited_fingerprints(text: bytes, keep: int, tail: bytes, size: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the text and of its first ``keep`` bytes followed by ``tail``."""
    seen: set[bytes] = set()
    ends: list[int] = []
    at = _parse(text, 0, seen, ends, keep)
    out = []
    for whole, own_seen, own_ends in ((text, seen.copy(), ends.copy()), (text[:keep] + tail, seen, ends)):
        left = _parse(whole, at, own_seen, own_ends, len(whole))
        if left < len(whole):
            own_ends.append(len(whole))
        out.append(_signature(whole, own_ends, size))
    return out[0], out[1]


def likeness(a: np.ndarray, b: np.ndarray, size: int = 64) -> float:
    """Jaccard estimate from two signatures: the share of the smallest hashes of both that both hold."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, a[np.isin(a, b)]).sum() / len(both))


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _compare(text: str, following: str, size: int) -> dict:
    n = len(text)
    half = n // 2
    data, keep, tail = text.encode(), text[: n - half].encode(), following[:half].encode()
    own, edited = edited_fingerprints(data, len(keep), tail, size)
    return {
        "n_chars": n, "edited_sha256": hashlib.sha256(keep + tail).hexdigest(), "fingerprint": as_text(own), "edited_fingerprint": as_text(edited),
        "near_edited": likeness(own, edited, size), "own": own,
    }


def next_text_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 64) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    values = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    fields = f"`{id_col}` {kind}, {values}"
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    names = [id_col, *[v.split()[0] for v in values.split(", ")]]
    target = to_arrow_schema(spark.createDataFrame([], f"{fields}, part int, head string, tail string").schema)
    rows = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    tie = F.xxhash64("__text")
    ordered = rows.repartitionByRange(F.col(id_col), tie).sortWithinPartitions(F.col(id_col), tie)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None  # (id, text) that waits for the next row
        waiting = None  # result that waits for the next row's fingerprint
        first = None
        out: dict[str, list] = {n: [] for n in target.names}

        def put(row: dict) -> None:
            for n in target.names:
                out[n].append(row.get(n))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)
            for v in out.values():
                v.clear()
            return batch

        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words.as_py()
                if held is None:
                    first = words
                else:
                    done = _compare(held[1], words, size) | {id_col: held[0], "part": part}
                    if waiting is not None:
                        put(waiting | {"near_next": likeness(waiting["own"], done["own"], size)})
                    waiting = done
                held = (doc, words)
            yield flush()
        if held is not None:
            # the last row has no next row here; the one before it has
            if waiting is not None:
                put(waiting | {"near_next": likeness(waiting["own"], fingerprint(held[1].encode(), size), size)})
            put({id_col: held[0], "part": part, "head": first, "tail": held[1]})
            yield flush()

    seen = written(ordered.mapInArrow(stream, f"{fields}, part int, head string, tail string"), "fingerprints")
    ends = seen.where(F.col("tail").isNotNull())
    parts = [r[0] for r in ends.select("part").orderBy("part").collect()]  # one number a task
    if not parts:
        return seen.select(*names)
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, `next` int")
    heads = ends.select(F.col("part").alias("next"), F.col("head").alias("next_text"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([target.field(n) for n in names])
        for batch in batches:
            made = []
            for doc, words, then in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                row = _compare(words, then, size) | {id_col: doc}
                made.append(row | {"near_next": likeness(row["own"], fingerprint(then.encode(), size), size)})
            yield pa.RecordBatch.from_arrays([pa.array([m[f.name] for m in made], type=f.type) for f in schema], schema=schema)

    stitched = ends.join(following, "part").join(heads, "next").select(id_col, "tail", "next_text").mapInArrow(last, fields)
    return seen.where(F.col("tail").isNull()).select(*names).unionByName(stitched)
