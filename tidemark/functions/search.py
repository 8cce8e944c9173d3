"""Many byte strings looked for in many texts at once.

A needle of n bytes is known by the hash of its first and of its last ``w`` bytes, where w is 4, 8 or 16 and at most n. The hashes of all runs
of w bytes of a batch of texts are made together by doubling. A bitmap of the first hashes leaves few places, a bitmap of both hashes
and the length leaves hardly any but true ones, and these are compared byte by byte: nothing rests on a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = (4, 8, 16)
#: Bytes of texts hashed together.
CHUNK = 1 << 19
#: Places of a bitmap at least and at most.
LEAST_BITS, MOST_BITS = 16, 26
_ODD, _FAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_HALF = np.uint64(32)
_OF_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _width(n: int) -> int:
    return max(w for w in WIDTHS if w <= n)


def _runs(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 4, 8 and 16 bytes up to a width, by the run's first byte."""
    out, h, span = {}, _OF_BYTE[data], 1
    with np.errstate(over="ignore"):
        while span < upto and len(h) > span:
            h = h[:-span] * _ODD + h[span:]
            h ^= h >> _HALF
            span *= 2
            out[span] = h
    return out


def _both(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = first * _FAR + last * _ODD + np.uint64(n)
        h ^= h >> _HALF
        return h * _FAR


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(n).bit_length() + 4))


def hashes(needles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first bytes, and of both ends with the length, of needles of one length (a row each)."""
    n = needles.shape[1]
    w = _width(n)
    ends = [_runs(np.ascontiguousarray(x).ravel(), w)[w][:: w] for x in (needles[:, :w], needles[:, n - w :])]
    return ends[0], _both(*ends, n)


def by_length(values: pa.Array) -> dict[int, np.ndarray]:
    """The distinct byte strings of at least four bytes, as a matrix for each length."""
    found: dict[int, set] = {}
    for x in values.cast(pa.large_binary()).to_pylist():
        if x is not None and len(x) >= WIDTHS[0]:
            found.setdefault(len(x), set()).add(x)
    return {n: np.frombuffer(b"".join(sorted(some)), dtype=np.uint8).reshape(-1, n) for n, some in found.items()}


class Needles:
    """What a task has to know of the needles: bitmaps, lengths and, if they are few enough, the needles themselves."""

    def __init__(self, lengths, first: dict[int, np.ndarray], both: np.ndarray, rows: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        self.lengths = {w: sorted(n for n in lengths if _width(n) == w) for w in WIDTHS}
        self.first, self.both, self.rows = first, both, rows

    @staticmethod
    def of(values: pa.Array) -> "Needles":
        groups = by_length(values)
        bits = bits_for(sum(map(len, groups.values())))
        first, both, rows = {w: np.zeros(1 << bits, dtype=bool) for w in WIDTHS}, np.zeros(1 << bits, dtype=bool), {}
        for n, matrix in groups.items():
            a, k = hashes(matrix)
            first[_width(n)][_place(a, bits)] = True
            both[_place(k, bits)] = True
            order = np.argsort(k, kind="stable")
            rows[n] = (k[order], matrix[order])
        return Needles(groups, first, both, rows)

    def _true(self, n: int, keys: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
        known, matrix = self.rows[n]
        good = np.zeros(len(at), dtype=bool)
        place = np.searchsorted(known, keys)
        left = np.nonzero(place < len(known))[0]
        while len(left := left[known[place[left]] == keys[left]]):
            good[left] |= (data[at[left][:, None] + np.arange(n)] == matrix[place[left]]).all(axis=1)
            place[left] += 1
            left = left[~good[left] & (place[left] < len(known))]
        return good

    def found(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """Texts (by number) and first bytes (in the returned data) of what may be needles of n bytes; with ``rows``, of what are."""
        if not any(self.lengths.values()):
            return
        column = texts.cast(pa.large_binary())
        starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(column) or starts[0] == starts[-1]:
            return
        whole = np.frombuffer(column.buffers()[2], dtype=np.uint8)
        null = column.is_null().to_numpy(zero_copy_only=False)
        longest = max(n for some in self.lengths.values() for n in some)
        bits = len(self.both).bit_length() - 1
        for a in range(int(starts[0]), int(starts[-1]), CHUNK):
            data = whole[a : min(a + CHUNK + longest - 1, int(starts[-1]))]
            runs = _runs(data, max(w for w in WIDTHS if self.lengths[w]))
            for w, lengths in self.lengths.items():
                if not lengths or w not in runs:
                    continue
                h = runs[w]
                some = np.nonzero(self.first[w][_place(h[:CHUNK], bits)])[0]
                for n in lengths:
                    at = some[some <= len(data) - n]
                    keys = _both(h[at], h[at + (n - w)], n)
                    hit = self.both[_place(keys, bits)]
                    at, keys = at[hit], keys[hit]
                    if self.rows is not None and len(at):
                        at = at[self._true(n, keys, at, data)]
                    if not len(at):
                        continue
                    text = np.searchsorted(starts, at + a, side="right") - 1
                    inside = (at + a + n <= starts[text + 1]) & ~null[text]
                    if inside.any():
                        yield text[inside], at[inside], n, data


def needles_of(forms: DataFrame, form: str, total: int) -> Needles:
    """Bitmaps of any number of needles, which stay where they are; at most four times 2^26 bits reach the driver."""
    bits = bits_for(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, matrix in by_length(batch.column(0)).items():
                a, k = hashes(matrix)
                for kind, h in ((_width(n), a), (0, k)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, dtype=np.int32)), pa.array(np.full(len(h), kind, dtype=np.int32)), pa.array(_place(h, bits))], names=["n", "kind", "place"])

    places = forms.select(F.col(form).cast("binary")).mapInArrow(run, "n int, kind int, place long")
    words = places.groupBy("kind", F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toArrow()
    lengths = [r[0] for r in forms.select(F.octet_length(form)).distinct().collect() if r[0] is not None and r[0] >= WIDTHS[0]]
    kind, word, some = (words.column(i).to_numpy() for i in range(3))
    maps = {}
    for k in (0, *WIDTHS):
        packed = np.zeros(1 << (bits - 6), dtype="<u8")
        packed[word[kind == k]] = some[kind == k].view(np.uint64)
        maps[k] = np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)
    return Needles(lengths, {w: maps[w] for w in WIDTHS}, maps[0])
