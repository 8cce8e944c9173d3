"""Importance resampling toward a target: documents are scored by hashed n-gram frequencies of a target corpus, the best are drawn.

A feature is a run of words; features fall into buckets, and a bucket's gain is the log of its share in the target over its
share in all documents. A document's weight is the mean gain of its features, found by array look-ups; Gumbel noise from its id makes the
draw of the highest scores a weighted draw without replacement.

Ranks come from parallel sorting by regular sampling: every partition sorts its rows into a run, rows at regular steps along the runs laid
end to end are samples, evenly spaced samples are the splitters, the segments between them are exchanged and merged where
they meet, and prefix sums of the segments' counts turn places into ranks. Segments are about equal whatever the scores:
run and place in it end the order, so rows equal in score and id are cut as well.

Null and edge cases
* null text: no features, weight 0. Null ids come before all others among equal scores, their noise is that of the empty id.
* a document needs ``least`` words to be drawn; others keep weight and score and have no rank.
* rows equal in score and id are interchangeable; each has its own rank.
* an empty table gives an empty result, an empty target gives gains from smoothing alone; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, plain_words, raw, written

#: Rows of a segment, about, as long as no more than ``SEGMENTS`` are needed; samples taken for one segment.
SEGMENT_ROWS, SEGMENTS, SAMPLES = 512, 8192, 16


class Buckets:
    """Bucket numbers of the features of texts; a bounded number of features is remembered."""

    def __init__(self, n: int, buckets: int, limit: int = 500_000):
        self._n, self._buckets, self._known, self._limit = n, buckets, {}, limit

    def of(self, text: bytes) -> np.ndarray:
        words = plain_words(text)
        known = self._known
        if len(known) > self._limit:
            known.clear()
        out = []
        for k in range(1, self._n + 1):
            runs = words if k == 1 else [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
            try:
                out += [known[w] for w in runs]
            except KeyError:
                for w in set(runs):
                    if w not in known:
                        known[w] = zlib.crc32(w) % self._buckets
                out += [known[w] for w in runs]
        return np.array(out, dtype=np.int64)


@functools.lru_cache(maxsize=2)
def _remembered(n: int, buckets: int) -> Buckets:
    return Buckets(n, buckets)


def bucket_counts(texts: DataFrame, text: str, n: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all texts; a table of ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(buckets, dtype=np.int64), _remembered(n, buckets)
        for batch in batches:
            for data in raw(batch.column(0)):
                total += np.bincount(of.of(data), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for b, count in texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = count
    return out


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of a bucket's smoothed share in the target over that in all documents."""
    buckets = len(all_counts)
    s, t = all_counts.astype(float), target_counts.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def score_documents(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text: str = "text", n: int = 1, seed: str = "2024") -> DataFrame:
    """id, n_words, n_features, weight and score of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = len(table)

    def score(cols: dict) -> dict:
        of = _remembered(n, buckets)
        out: dict[str, list] = {"n_words": [], "n_features": [], "weight": []}
        for data in raw(cols[text]):
            found = of.of(data)
            # n words give n + (n - 1) + ... features, so the words are counted by runs of one
            out["n_words"].append(len(found) if n == 1 else len(plain_words(data)))
            out["n_features"].append(len(found))
            out["weight"].append(int(table[found].sum()) // len(found) if len(found) else 0)
        return {id_col: cols[id_col]} | out

    rows = map_batches(docs.select(id_col, text), score, f"`{id_col}` {kind}, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, order: list[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The rows with their rank (from 1) in the ascending order of integer columns, nulls first; parallel sorting by regular sampling."""
    place = [F.col(c).asc_nulls_first() for c in order]
    local = rows.sortWithinPartitions(*place).select("*", F.monotonically_increasing_id().alias("__at"))
    runs = written(local.withColumn("__run", F.shiftright("__at", 33)), "sorted-runs")
    # one row a run, one run a partition
    sizes = [(r[0], r[1], r[2]) for r in runs.groupBy("__run").agg(F.min("__at"), F.count(F.lit(1))).orderBy("__run").collect()]
    total = sum(n for _, _, n in sizes)
    segments = min(SEGMENTS, max(1, total // segment_rows))
    step = max(1, total // (segments * SAMPLES))
    keys = [*order, "__run", "__at"]
    ahead, from_start = 0, []
    for run, first, n in sizes:
        from_start.append((run, ahead - first))
        ahead += n
    shift = rows.sparkSession.createDataFrame(from_start, "__run long, __shift long")
    regular = runs.join(F.broadcast(shift), "__run").where((F.col("__at") + F.col("__shift")) % step == step - 1)
    samples = np.array([_plain(r) for r in regular.select(*keys).collect()] if segments > 1 else [], dtype=np.int64).reshape(-1, 2 * len(keys))
    samples = samples[np.lexsort(samples.T[::-1])]
    splitters = samples[SAMPLES - 1 :: SAMPLES]
    names = rows.columns

    def deal(cols: dict) -> dict:
        own = _columns(cols, keys)
        both = np.concatenate([splitters, own])
        at = np.lexsort(both.T[::-1])
        segment = np.empty(len(at), dtype=np.int64)
        segment[at] = np.cumsum(at < len(splitters))
        return {**{c: cols[c] for c in [*names, "__run", "__at"]}, "__segment": segment[len(splitters) :]}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = written(map_batches(runs, deal, f"{fields}, __run long, __at long, __segment long"), "segments")
    ahead = Window.orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    # one row a segment
    before = dealt.groupBy("__segment").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__segment").orderBy(*place, "__run", "__at")
    merged = dealt.withColumn("__in", F.row_number().over(inside)).join(F.broadcast(before), "__segment")
    return merged.select(*names, (F.col("__in") + F.col("__before")).cast("long").alias("rank"))


def _plain(row) -> list[int]:
    """Each value as (is not null, value), so that nulls come first."""
    return [y for x in row for y in ((0, 0) if x is None else (1, x))]


def _columns(cols: dict, keys: list[str]) -> np.ndarray:
    out = []
    for k in keys:
        c = cols[k]
        out += [np.asarray(c.is_valid()).astype(np.int64), np.asarray(c.fill_null(0)).astype(np.int64)]
    return np.stack(out, axis=1)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000,
             least: int = 20, share: tuple[int, int] = (10, 100), seed: str = "2024") -> DataFrame:
    """id, n_features, weight, score and rank of every row; rank is null but for the drawn floor(share * eligible) rows.

    The texts are read twice: for the counts of the buckets and for the weights. Ids are integers.
    """
    table = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    scored = written(score_documents(docs, table, id_col, text, n, seed).withColumn("__down", -F.col("score")), "resampling-scores")
    able = F.col("n_words") >= least
    eligible = scored.where(able)
    draws = eligible.count() * share[0] // share[1]
    order = ranked(eligible, ["__down", id_col]).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    out = [id_col, "n_features", "weight", "score", "rank"]
    return order.select(*out).unionByName(scored.where(~able).select(*out[:-1], F.lit(None).cast("long").alias("rank")))
