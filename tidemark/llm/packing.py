"""Best-fit packing: documents become token pieces of at most ``capacity`` tokens, packed into few sequences.

Best-two-fit: a sequence is filled greedily with the largest piece that still fits; then its smallest piece gives way
to two unpacked pieces, if some two fill the gap it leaves more tightly than it did.

Only lengths decide how full a sequence gets, and there are at most ``capacity`` of them. So the plan is made from the counts
by length (a table of at most ``capacity`` rows, whatever the number of documents): a pattern of lengths is filled as above and
used as often as the counts allow. Spark then ranks the pieces within their length and each rank reads its sequence and
offset off the plan.

Null and edge cases
* null or empty text: one piece that holds only the end token.
* texts over ``capacity`` tokens are cut into full pieces and a shorter last one; others are never cut.
* repeated rows, equal ids included, are documents of their own; equal pieces are interchangeable.
* an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, raw, written

#: Pieces of one length that one task ranks, about.
RANK_ROWS = 50_000
#: Bytes of texts that are encoded together, about, and chunks whose ids a worker remembers.
TEXT_BYTES, REMEMBER = 8 << 20, 500_000


class Memory:
    """A dict of bounded size that keeps what was used of late: two generations, of which the older one is dropped when the younger is full."""

    def __init__(self, limit: int):
        self.young, self._old, self._half = {}, {}, limit // 2

    def recall(self, key):
        """The value of a key that is not in ``young``, which it is put into again; None if it is unknown."""
        found = self._old.get(key)
        if found is not None:
            self.young[key] = found
        return found

    def full(self) -> None:
        """To be called now and then, while no key of ``young`` is relied on."""
        if len(self.young) > self._half:
            self.young, self._old = {}, self.young


class SpacedTokenizer:
    """Ids of a tokenizer whose words never span white space, chunk by chunk, with a bounded memory of chunks and of their pieces.

    It gives what ``encode`` gives for the whole text if the tokenizer drops ASCII white space and every rule stops there.
    ``folds``: the tokenizer also lower-cases, takes a run of small ASCII letters as one word, and parts an ASCII letter or digit from the ASCII
    marks behind it at the end of a chunk, so fewer pieces need to be known. Texts that may hold special tokens are not folded, nor are capitals in front of a non-ASCII character: the
    tokenizer composes letters and marks before it lower-cases, and some letters compose in one case only. The tests hold it against ``encode``.
    """

    #: A capital that a mark may follow.
    _BASE = re.compile(rb"[A-Z](?=[\x80-\xff])")
    _MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
    _PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")

    def __init__(self, path: str, limit: int = 500_000, longest: int = 64, folds: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._folds, self._longest = folds, longest
        self._tokenizer = Tokenizer.from_file(path)
        self._known, self._pieces, self._model = Memory(limit), Memory(limit), self._tokenizer.model

    def _folded(self, text: bytes) -> bytes:
        low = text.lower()  # bytes: A-Z only
        if not text.isascii() and (kept := [m.start() for m in self._BASE.finditer(text)]):
            low = bytearray(low)
            for i in kept:
                low[i] = text[i]
            low = bytes(low)
        return low

    def ids(self, text: bytes) -> np.ndarray:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. Chunks are numbered over all texts first, so only different ones are looked up."""
        texts = [self._folded(t) if self._folds and b"<|" not in t else t for t in texts]
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        chunks = parts.flatten().dictionary_encode()
        names = chunks.dictionary.cast(pa.large_binary()).to_pylist()
        found = list(map(self._known.young.get, names))
        if None in found:
            at = [i for i, f in enumerate(found) if f is None]
            new = self._learned([names[i] for i in at])
            for i in at:
                found[i] = new[names[i]]
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.array(list(map(len, found)), dtype=np.int64) // 4
        start = np.cumsum(size) - size
        code = np.asarray(chunks.indices)
        sizes = size[code] if len(code) else np.empty(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ids = pool[np.repeat(start[code] - ends[:-1], sizes) + np.arange(ends[-1])] if len(code) else pool
        cuts = ends[np.asarray(parts.offsets)].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _parted(self, chunk: bytes) -> tuple[bytes, ...]:
        """The chunk, or its part up to the last plain character and the marks behind it."""
        head = chunk.rstrip(self._MARKS) if self._folds else chunk
        if len(head) == len(chunk) or not head or head[-1] not in self._PLAIN or b"<|" in chunk:
            return (chunk,)
        return head, chunk[len(head) :]

    def _learned(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        known, pieces = self._known, self._pieces
        known.full()
        pieces.full()
        out, parts = {b"": b""}, {}
        for c in filter(None, chunks):
            if (e := known.recall(c)) is None:
                parts[c] = self._parted(c)
            else:
                out[c] = e
        young = pieces.young
        need = {p for pair in parts.values() for p in pair if p not in young and pieces.recall(p) is None}
        own = {}
        rest = []
        for p in need:
            if self._folds and p.isalpha() and p.islower():  # bytes: ASCII letters only
                own[p] = np.array([t.id for t in self._model.tokenize(p.decode())], dtype="<u4").tobytes()
            else:
                rest.append(p)
        if rest:
            own.update(zip(rest, self._encoded([p.decode() for p in rest]), strict=True))
        for c, pair in parts.items():
            e = out[c] = b"".join([own[p] if p in own else young[p] for p in pair])
            if len(c) <= self._longest:
                known.young[c] = e
        young.update((p, e) for p, e in own.items() if len(p) <= self._longest)
        return out

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, from one call over all with a space between; a token belongs to the chunk it starts in."""
        done = self._tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        starts = np.cumsum([0] + [len(c) + 1 for c in chunks])
        tokens = np.array([a for a, _ in done.offsets], dtype=np.int64)
        ids = np.array(done.ids, dtype="<u4").tobytes()
        cuts = (4 * np.searchsorted(tokens, starts)).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.lru_cache(maxsize=1)
def _loaded(path: str, remember: int) -> SpacedTokenizer:
    return SpacedTokenizer(path, remember)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text",
                 with_ids: bool = False, remember: int = REMEMBER, at_once: int = TEXT_BYTES) -> DataFrame:
    """One row per piece: id, piece (from 0), start, length, ids_crc32 and, if asked for, ids.

    ``remember``: chunks, and pieces of chunks, that a worker keeps the ids of; ``at_once``: bytes of texts that it encodes together. Both trade
    memory for time only.
    """
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def encoded(texts: Iterator[bytes]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= at_once:
                yield from _loaded(tokenizer, remember).ids_of(held)
                held, size = [], 0
        yield from _loaded(tokenizer, remember).ids_of(held)

    def cut(cols: dict) -> dict:
        out = {k: [] for k in names}
        for doc, found in zip(cols[id_col].to_pylist(), encoded(raw(cols[text])), strict=True):
            ids = np.append(found, np.array([end_id], dtype="<u4"))
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                for name, value in zip(names, (doc, k, at, len(part), zlib.crc32(part.astype("<u4").tobytes()), part.astype("int64")), strict=False):
                    out[name].append(value)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text), cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns for the counts by length: (times used, [(length, copies), ...]), lengths falling.

    Greedy fill: the longest piece left that still fits, again and again. Then best-two-fit: the smallest piece of the
    pattern, of length s, gives way to two unpacked pieces a + b <= gap + s with a + b > s, the largest such sum.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan = []

    def free(n: int, used: dict[int, int]) -> int:
        return left[n] - used.get(n, 0)

    def longest(at_most: int, used: dict[int, int]) -> int:
        i = bisect.bisect_right(lengths, at_most) - 1
        while i >= 0 and free(lengths[i], used) <= 0:
            i -= 1
        return lengths[i] if i >= 0 else 0

    def best_two(room: int, beat: int, used: dict[int, int]) -> tuple[int, int] | None:
        best, i, j = None, 0, bisect.bisect_right(lengths, room) - 1
        while i <= j:
            a, b = lengths[i], lengths[j]
            if a + b > room or free(b, used) <= 0:
                j -= 1
            elif free(a, used) <= 0 or (i == j and free(a, used) < 2):
                i += 1
            else:
                if a + b > beat:
                    best, beat = (b, a), a + b
                    if beat == room:
                        break
                i += 1
        return best

    while lengths:
        used: dict[int, int] = {}
        gap = capacity
        while gap > 0 and (n := longest(gap, used)):
            copies = min(gap // n, free(n, used))
            used[n] = used.get(n, 0) + copies
            gap -= n * copies
        if gap > 0 and sum(used.values()) > 1:
            small = min(used)
            used[small] -= 1
            if two := best_two(gap + small, small, used):
                for n in two:
                    used[n] = used.get(n, 0) + 1
            else:
                used[small] += 1
            used = {n: c for n, c in used.items() if c}
        times = min(left[n] // c for n, c in used.items())
        plan.append((times, sorted(used.items(), reverse=True)))
        for n, c in used.items():
            left[n] -= times * c
        lengths = [n for n in lengths if left[n] > 0]
    return plan


def plan_runs(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length the runs of ranks: first rank, first sequence, offset in it, copies in a sequence."""
    runs: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, pattern in plan:
        at = 0
        for n, copies in pattern:
            runs.setdefault(n, []).append((ranks.get(n, 0), sequence, at, copies))
            ranks[n] = ranks.get(n, 0) + times * copies
            at += n * copies
        sequence += times
    return {n: np.array(r, dtype=np.int64) for n, r in runs.items()}


def pack(pieces: DataFrame, capacity: int = 4096, length: str = "length", order=("doc_id", "piece")) -> DataFrame:
    """The pieces with sequence_id and offset (gapless from 0).

    The plan depends on at most ``capacity`` counts. Ranks within a length come from salts: rows per (length, salt) are
    counted, the counts prefix-summed, and each (length, salt) ranked by itself, so that one very common length is dealt over
    many tasks.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most ``capacity`` rows
    runs = plan_runs(plan_packing(counts, capacity))
    salts = max(1, -(-max(counts.values(), default=1) // RANK_ROWS))
    key = [F.col(c) for c in order]
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    before = Window.partitionBy(length).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(length, "__salt").agg(F.count(F.lit(1)).alias("__n")).withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(length, "__salt").orderBy(*key)
    ranked = salted.withColumn("__rank", F.row_number().over(inside) - 1).join(starts, [length, "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__from")).drop("__from", "__salt")
    names = pieces.columns

    def place(cols: dict) -> dict:
        rank, size = np.asarray(cols["__rank"]), np.asarray(cols[length])
        sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
        for n in np.unique(size):
            at = np.nonzero(size == n)[0]
            of = runs[int(n)][np.searchsorted(runs[int(n)][:, 0], rank[at], side="right") - 1]
            step = rank[at] - of[:, 0]
            sequence[at], offset[at] = of[:, 1] + step // of[:, 3], of[:, 2] + step % of[:, 3] * n
        return {**{c: cols[c] for c in names}, "sequence_id": sequence, "offset": offset}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(ranked, place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text",
                   remember: int = REMEMBER, at_once: int = TEXT_BYTES) -> DataFrame:
    """Token pieces of all documents with their places; texts are encoded once, into a written table."""
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text, remember=remember, at_once=at_once), "pieces")
    return pack(pieces, capacity, order=(id_col, "piece", "ids_crc32"))
