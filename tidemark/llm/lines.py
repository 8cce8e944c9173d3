"""Line dedup: lines that many documents share stay in one of them.

Two Bloom filters hold the hashes of lines seen once and seen twice. Every task lists the bits of the lines it saw and of those it
saw again; slices of the filters are folded from these lists, where a bit that was set before moves on to the second filter. The
second filter then tells which lines may repeat at all: only they are shuffled, under 128-bit keys, to be counted exactly
and to have the document chosen that keeps them. A line that the filter names without cause is counted once and forgotten.

The filter's size follows the bytes of the texts up to ``most_bytes``. Beyond that it fills up, and more lines than need be are
counted exactly; the result is the same.

Null and edge cases
* null or empty text: one empty line; it has no key.
* a document is an id: rows that share an id count once, and all of them keep their lines if their id is the largest. A null id is a
  document of its own, smaller than all others.
* a line repeated inside one document counts once; the document that keeps a line keeps all its places.
* an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, map_batches, raw, sized, written

#: Bits of a slice of the filters; the share of a filter that one task folds at a time.
SLICE = 1 << 20
#: Places of a line in the filters.
PLACES = 3
#: Lines that a task holds before it lists their bits.
HELD = 2_000_000
_CONTINUED = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    """Whether the key has ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.translate(None, _CONTINUED)) >= least)


def keys_of(text: bytes, least: int) -> set[bytes]:
    """Distinct keys of at least ``least`` code points."""
    return {k for k in map(bytes.strip, text.lower().split(b"\n")) if _long_enough(k, least)}


def _digests(keys) -> np.ndarray:
    """Two 64-bit numbers a key."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").reshape(-1, 2).astype(np.uint64)


def places(digests: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each key, one row a key; ``bits`` is a power of two."""
    with np.errstate(over="ignore"):
        step = digests[:, 1:] | np.uint64(1)
        return (digests[:, :1] + np.arange(PLACES, dtype=np.uint64)[None, :] * step) & np.uint64(bits - 1)


def _sightings(docs: DataFrame, text: str, least: int, bits: int) -> DataFrame:
    """Per task and slice the bits of lines seen, and of lines seen again in the same task."""
    schema = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def listed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, times = np.unique(np.concatenate(held), axis=0, return_counts=True)
        one, two = (np.unique(places(d, bits)) for d in (found, found[times > 1]))
        cuts = np.arange(0, bits + 1, min(SLICE, bits), dtype=np.uint64)
        a, b = np.searchsorted(one, cuts), np.searchsorted(two, cuts)
        for i in range(len(cuts) - 1):
            if a[i] < a[i + 1]:
                parts = [(x[lo:hi] - cuts[i]).astype("<u4").tobytes() for x, lo, hi in ((one, a[i], a[i + 1]), (two, b[i], b[i + 1]))]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array(parts[:1], pa.binary()), pa.array(parts[1:], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for data in raw(batch.column(0)):
                if keys := keys_of(data, least):
                    held.append(_digests(keys))
                    n += len(keys)
                    if n >= HELD:
                        yield from listed(held)
                        held, n = [], 0
        if held:
            yield from listed(held)

    return docs.select(text).mapInArrow(run, "slice int, once binary, twice binary")


def _folded(seen: DataFrame, bits: int) -> DataFrame:
    """slice and bytes of the filter of lines seen twice."""
    width = min(SLICE, bits)
    schema = pa.schema([("slice", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for k, a, b in zip(*(batch.column(i) for i in range(3)), strict=True):
                if k.as_py() != now:
                    if now is not None:
                        yield done()
                    now = k.as_py()
                    once[:], twice[:] = False, False
                new = np.frombuffer(a.as_py(), dtype="<u4")
                twice[new[once[new]]] = True
                twice[np.frombuffer(b.as_py(), dtype="<u4")] = True
                once[new] = True
        if now is not None:
            yield done()

    return seen.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, bytes binary")


def repeat_filter(docs: DataFrame, text: str, least: int, per_line: int = 8, most_bytes: int = 1 << 26) -> tuple[np.ndarray, int]:
    """The filter of lines seen twice as packed bits, and its number of bits; at most ``most_bytes`` reach the driver."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = 1 << 13
    while bits < per_line * size / (least + 1) and bits < 8 * most_bytes:
        bits *= 2
    out = np.zeros(bits // 8, dtype=np.uint8)
    width = min(SLICE, bits) // 8
    for row in _folded(_sightings(docs, text, least, bits), bits).collect():
        out[row[0] * width : (row[0] + 1) * width] = np.frombuffer(row[1], dtype=np.uint8)
    return out, bits


def suspects(docs: DataFrame, id_col: str, text: str, least: int, seen: np.ndarray, bits: int) -> DataFrame:
    """id and key of the distinct lines of each row that the filter takes for repeated."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(seen)

    def pick(cols: dict) -> dict:
        rows, found = [], []
        table = held.value
        for at, data in enumerate(raw(cols[text])):
            if keys := keys_of(data, least):
                d = _digests(keys)
                p = places(d, bits)
                d = d[((table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)]
                if len(d):
                    rows.append(np.full(len(d), at))
                    found.append(d)
        if not rows:
            return {id_col: cols[id_col].slice(0, 0), "key": []}
        data = np.concatenate(found).astype(">u8").tobytes()
        return {id_col: cols[id_col].take(pa.array(np.concatenate(rows))), "key": [data[i : i + 16] for i in range(0, len(data), 16)]}

    return map_batches(docs.select(id_col, text), pick, f"`{id_col}` {kind}, key binary")


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """id, n_lines, n_dropped and kept text of every row: lines of at least ``least`` code points that ``documents`` ids share
    stay in the largest of these ids only.

    Counting is spread by (key, id) first, so a line that a third of all documents hold is combined before it meets in one task;
    such lines reach the documents by a bounded broadcast, all others by a join on the key (``common.lookup``).
    """
    seen, bits = repeat_filter(docs, text, least)
    found = written(suspects(docs, id_col, text, least, seen, bits), "line-suspects")
    counted = found.select("key", id_col).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("held_by"), F.max(id_col).alias("keeper"))
    common = written(counted.where(F.col("held_by") >= documents), "line-repeats")
    spread = lookup(found, common, "key", "held_by", "inner").where(~F.col(id_col).eqNullSafe(F.col("keeper")))
    drops = written(spread.groupBy(F.col(id_col).alias("__of")).agg(F.collect_set("key").alias("__drop")), "line-drops")
    # texts are shuffled only if the lists of their lines are too large to be sent to them
    drops = sized(drops, drops.agg(F.sum(F.size("__drop") * 24 + 40)).first()[0] or 0)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(cols: dict) -> dict:
        import xxhash

        out: dict[str, list] = {"n_lines": [], "n_dropped": [], "kept": []}
        for data, drop in zip(raw(cols["__text"]), cols["__drop"], strict=True):
            lines = data.split(b"\n")
            kept = lines
            if drop.is_valid:
                gone = set(drop.as_py())
                kept = [x for x in lines if not (len(k := line_key(x)) >= least and xxhash.xxh3_128_digest(k) in gone)]
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(kept))
            out["kept"].append((data if len(kept) == len(lines) else b"\n".join(kept)).decode("utf-8", "replace"))
        return {id_col: cols["__id"]} | out

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(drops, F.col("__id").eqNullSafe(F.col("__of")), "left")
    return map_batches(rows.select("__id", "__text", "__drop"), cut, f"`{id_col}` {kind}, n_lines long, n_dropped long, kept string")
