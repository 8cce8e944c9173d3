"""Substring dedup: repeated passages confirmed by counting, located by sharded Aho-Corasick automata, and cut out.

A window is ``window`` consecutive words. A word goes if some window that covers it also starts anywhere else, in the same or in another
text; windows are judged on the input. Equal texts are worked on once, as one text with a number of copies.

1. Anchors: of the ``ANCHOR``-word phrases in every window the one with the smallest hash. Equal windows have equal anchors, so only
   windows whose anchor occurs twice can recur.
2. Confirming: those windows are counted by a 64-bit hash; the ones that start twice are recurring passages.
3. Automata: the texts that hold candidates are dealt into shards. A shard gets one place of every recurring window that starts in its
   texts; consecutive places form a passage, and each passage is cut into tiles so short that every window contains one.
   An automaton over word numbers finds every tile in every text of the shard, and a hit counts where the words around it agree
   with the passage over a whole window. A shard's patterns come from its own texts, so its size bounds the automaton.

Texts without candidates are never moved but for the one join that picks the others out.

Null and edge cases
* null text: no words. Texts of fewer words than a window keep everything, copies too.
* a text that occurs twice or more, repeated rows included, is removed whole if it has a window.
* equal or null ids do not matter: each row gets the result of its text; an empty table gives an empty result.
* columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, gram_hashes, map_batches, raw, signed, written

ANCHOR = 12
#: Bytes of text in a shard, about.
SHARD_BYTES = 2_000_000


@functools.lru_cache(maxsize=1)
def _hashes() -> WordHashes:
    return WordHashes()


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For each window the position of its anchor; empty if the text has no window."""
    span = window - min(ANCHOR, window) + 1
    grams = gram_hashes(words, min(ANCHOR, window))
    if len(grams) < span:
        return np.empty(0, dtype=np.int64)
    out = np.empty(len(grams) - span + 1, dtype=np.int64)
    for a in range(0, len(out), 1 << 16):  # bounded memory for long texts
        part = grams[a : a + (1 << 16) + span - 1]
        out[a : a + (1 << 16)] = np.lib.stride_tricks.sliding_window_view(part, span).argmin(1) + np.arange(a, a + len(part) - span + 1)
    return out


def _text_key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _anchored(docs: DataFrame, text: str, window: int) -> DataFrame:
    def scan(cols: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("n_words", "whole", "anchors", "places")}
        for data in raw(cols[text]):
            words = data.split()
            h = _hashes().of(words)
            at = np.unique(anchors(h, window))
            out["n_words"].append(len(words))
            out["whole"].append(hashlib.sha256(b" ".join(words)).digest())
            out["anchors"].append(signed(gram_hashes(h, min(ANCHOR, window))[at]) if len(at) else [])
            out["places"].append(at)
        return {"key": cols["key"]} | out

    return map_batches(docs.select(_text_key(text).alias("key"), text), scan, "key binary, n_words long, whole binary, anchors array<long>, places array<int>")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """tid, copies, starts and their hashes: windows whose anchor is one of ``places``."""

    def scan(cols: dict) -> dict:
        starts, hashes = [], []
        for data, places in zip(raw(cols["text"]), cols["places"].to_pylist(), strict=True):
            h = _hashes().of(data.split())
            at = np.nonzero(np.isin(anchors(h, window), np.array(places)))[0]
            starts.append(at)
            hashes.append(signed(gram_hashes(h, window)[at]))
        return {"tid": cols["tid"], "copies": cols["copies"], "starts": starts, "hashes": hashes}

    return map_batches(rows, scan, "tid long, copies long, starts array<int>, hashes array<long>")


def _covered(texts: list[np.ndarray], places: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each text which words a recurring window covers.

    texts: word numbers; places: starts of recurring windows, each window once in the shard at least.
    """
    import ahocorasick

    tile = (window + 1) // 2
    spare = window - tile
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number: dict[tuple[int, ...], int] = {}
    where: list[list[tuple[int, int, int, int]]] = []
    for t, starts in enumerate(places):
        if not len(starts):
            continue
        cuts = np.nonzero(np.diff(starts) > 1)[0] + 1
        for run in np.split(starts, cuts):
            first, end = int(run[0]), int(run[-1]) + window
            for o in range(first, end - tile + 1, tile):
                word = tuple(texts[t][o : o + tile].tolist())
                if word not in number:
                    number[word] = len(where)
                    where.append([])
                    automaton.add_word(word, number[word])
                where[number[word]].append((t, o, first, end))
    out = [np.zeros(len(x), dtype=bool) for x in texts]
    if not number:
        return out
    automaton.make_automaton()
    for x, hit in zip(texts, out, strict=True):
        for last, found in automaton.iter(tuple(x.tolist())):
            q = last - tile + 1
            for t, o, first, end in where[found]:
                y = texts[t]
                back = min(spare, q, o - first)
                ahead = min(spare, len(x) - q - tile, end - o - tile)
                left = 0
                if back:
                    same = x[q - back : q] == y[o - back : o]
                    left = back if same.all() else int(np.argmin(same[::-1]))
                right = 0
                if ahead:
                    same = x[q + tile : q + tile + ahead] == y[o + tile : o + tile + ahead]
                    right = ahead if same.all() else int(np.argmin(same))
                if left + tile + right >= window:
                    hit[q - left : q + tile + right] = True
    return out


def _shard_results(rows: list[dict], window: int) -> list[dict]:
    number: dict[bytes, int] = {}
    split = [(r["text"] or b"").split() for r in rows]
    texts = [np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) for words in split]
    given = [np.unique(np.array(r["starts"] or [], dtype=np.int64)) for r in rows]
    grams = [gram_hashes(_hashes().of(words), window)[at] if len(at) else np.empty(0, dtype=np.uint64) for words, at in zip(split, given, strict=True)]
    # one place of every recurring window of the shard: the first
    first = np.zeros(sum(map(len, given)), dtype=bool)
    first[np.unique(np.concatenate(grams), return_index=True)[1]] = True
    places = [at[f] for at, f in zip(given, np.split(first, np.cumsum([len(x) for x in given])[:-1]), strict=True)]
    out = []
    for r, words, hit in zip(rows, split, _covered(texts, places, window), strict=True):
        kept = b" ".join(w for w, h in zip(words, hit.tolist(), strict=True) if not h)
        out.append({"tid": r["tid"], "removed": int(hit.sum()), "kept": hashlib.sha256(kept).digest(), "text": kept.decode(errors="replace")})
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 35, with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (of the kept words, one space between) and, if asked for, kept_text of changed texts."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    # every text once, under a short number; equal texts have equal words, so any of their rows will do
    body = [F.first(c).alias(c) for c in ("n_words", "whole", "anchors", "places")]
    once = _anchored(docs, text, window).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), *body)
    once = written(once.withColumn("tid", F.monotonically_increasing_id()), "texts")
    flat = once.select("tid", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("tid", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("place"))
    again = flat.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select("anchor")
    candidates = flat.join(again, "anchor").groupBy("tid").agg(F.collect_list("place").alias("places"))
    candidates = candidates.join(once.select("tid", "key", "copies"), "tid")
    said = docs.select(_text_key(text).alias("key"), F.col(text).cast("binary").alias("text"))
    # candidates grow with the input, so they are never broadcast to the texts; a text that has copies is carried on by one of them
    picked = candidates.hint("shuffle_merge").join(said, "key").dropDuplicates(["key"])
    held = written(picked.select("tid", "copies", "places", "text", F.length("text").cast("long").alias("bytes")), "passage-texts")
    total = held.agg(F.sum("bytes")).first()[0] or 0
    shard = F.pmod(F.xxhash64("tid"), F.lit(max(1, -(-total // SHARD_BYTES)))).cast("int").alias("shard")
    windows = written(_windows(held, window), "windows").select("tid", "copies", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select(
        "tid", "copies", F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash")
    )
    recurring = windows.groupBy("hash").agg(F.sum("copies").alias("n")).where(F.col("n") >= 2).select("hash")
    places = windows.select("tid", "start", "hash").join(recurring, "hash").groupBy("tid").agg(F.collect_list("start").alias("starts"))
    # texts and places meet in their shard: one shuffle of either
    dealt = held.select(shard, "tid", F.lit(None).cast("array<int>").alias("starts"), "text").unionByName(
        places.select(shard, "tid", "starts", F.lit(None).cast("binary").alias("text"))
    )
    target = to_arrow_schema(docs.sparkSession.createDataFrame([], "tid long, removed long, kept binary, text string").schema)

    def locate(batches):
        rows: list[dict] = []
        number = None
        for batch in batches:
            for row in batch.to_pylist():
                if rows and number != row["shard"]:
                    yield pa.RecordBatch.from_pylist(_shard_results(rows, window), schema=target)
                    rows = []
                number = row["shard"]
                if rows and rows[-1]["tid"] == row["tid"]:
                    rows[-1] = {k: rows[-1][k] if row[k] is None else row[k] for k in row}
                else:
                    rows.append(row)
        if rows:
            yield pa.RecordBatch.from_pylist(_shard_results(rows, window), schema=target)

    cut = dealt.repartition("shard").sortWithinPartitions("shard", "tid").mapInArrow(locate, "tid long, removed long, kept binary, text string")
    if not with_text:
        cut = cut.drop("text")
    cut = written(cut, "cut")
    whole = (F.col("copies") >= 2) & (F.col("n_words") >= window)
    result = once.select("key", "tid", "copies", "n_words", "whole").join(cut, "tid", "left").select(
        "key", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "whole")))).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("text")).alias("kept_text")] if with_text else []),
    )
    return docs.select(id_col, _text_key(text).alias("key")).join(result, "key").drop("key")
