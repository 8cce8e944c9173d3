"""Stateful streams: pool features, alert lifecycle, exactly-once publication, feed coverage.

State is keyed and bounded: per pool the last ``window`` swaps, one anchor and peak, one mark per
horizon, and the wallets and event ids seen, in shelves (both with an optional time to live). The batch
operators give the same rows; the tests compare them.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ops import ALERT_CODES
from ..operators.pit import publish_unique

FEATURE_SCHEMA = (
    "pool bigint, seq bigint, entry string, late boolean, new_wallet boolean, swaps_observed bigint, volume_quote_raw bigint, "
    "half_window_volume_change_raw bigint, buy_count bigint, sell_count bigint, wallets_unique bigint, price_change_bps bigint, drawdown_bps bigint, "
    "horizon_seconds bigint, due_ns bigint, observed_ns bigint, return_bps bigint"
)
_COLUMNS = [c.split()[0] for c in FEATURE_SCHEMA.split(", ")]


def _bps(q, b, q0, b0):
    top, bottom = (q * b0 - q0 * b) * 10000, q0 * b
    return top // bottom if top >= 0 else -(-top // bottom)


#: Ids of a key that share a state entry, about.
SHELF = 256


class Shelves:
    """Contents by id of one key, ``SHELF`` ids to a state entry: a batch reads and writes the entries of its ids once, and none of a new key is read.

    ``size``: ids held and entries, a power of two that grows with them; it is kept by the caller. With a time to live an id is an
    entry of its own, as it is forgotten by itself.
    """

    def __init__(self, state, size: list[int], ttl: bool):
        self.state, self.size, self.ttl = state, size, ttl
        self.new, self.held, self.changed = not size[0], {}, set()

    def _shelf(self, id_: str) -> str:
        return f"={id_}" if self.ttl else str(crc32(id_.encode("utf-8", "surrogatepass")) & (self.size[1] - 1))

    def _load(self, shelf: str) -> dict:
        if shelf not in self.held:
            found = None if self.new else self.state.getValue((shelf,))
            self.held[shelf] = {} if found is None else dict(zip(*found))
        return self.held[shelf]

    def get(self, id_: str) -> str | None:
        return self._load(self._shelf(id_)).get(id_)

    def put(self, id_: str, content: str) -> None:
        shelf = self._shelf(id_)
        self._load(shelf)[id_] = content
        self.changed.add(shelf)
        self.size[0] += 1

    def write(self) -> None:
        if not self.ttl and self.size[0] > SHELF * self.size[1]:
            every = [x for k in range(self.size[1]) for x in self._load(str(k)).items()]
            while self.size[0] > SHELF * self.size[1]:
                self.size[1] *= 2
            self.held = {}
            for id_, content in every:
                self.held.setdefault(self._shelf(id_), {})[id_] = content
            self.changed = set(self.held)
        for shelf in self.changed:
            self.state.updateValue((shelf,), (list(self.held[shelf]), list(self.held[shelf].values())))


class PoolFeatures(StatefulProcessor):
    """Swap features in arrival order for one pool; repeats are dropped, arrival regressions are reported.

    A call reads the pool once and its ids by shelves; sums over the last swaps are differences of running sums.
    """

    def __init__(self, window: int = 64, horizons=(60, 300, 1800, 3600, 86400), ttl_ms: int | None = None):
        self.window, self.horizons, self.ttl_ms = window, sorted(horizons), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pool = handle.getValueState("pool", "doc string")
        self.wallets = handle.getMapState("wallets", "shelf string", "ids array<string>, contents array<string>", self.ttl_ms)
        self.events = handle.getMapState("events", "shelf string", "ids array<string>, contents array<string>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["availability_ns", "seq"], kind="stable")
        held = self.pool.get()
        s = json.loads(held[0]) if held is not None else {
            "slot": None, "ns": None, "anchor": None, "peak": None, "fall": 0, "due": [], "recent": [], "events": [0, 1], "wallets": [0, 1]}
        events, wallets = (Shelves(state, s[name], self.ttl_ms is not None) for state, name in ((self.events, "events"), (self.wallets, "wallets")))
        quotes, bases, who, bought = (list(x) for x in zip(*s["recent"])) if s["recent"] else ([], [], [], [])
        volume, buys = [0, *accumulate(quotes)], [0, *accumulate(bought)]
        inside = Counter(who)
        pool, window, last_slot, last_ns = key[0], self.window, s["slot"], s["ns"]
        out = []

        def reject(seq, why):
            out.append((pool, seq, why, *[None] * 14))

        for seq, ns, slot, id_, kind, instruction, wallet, quote, base in zip(
                *(batch[c].tolist() for c in ("seq", "availability_ns", "slot", "id", "kind", "instruction", "wallet", "quote_raw", "base_raw"))):
            seq, ns, slot, id_ = int(seq), int(ns), int(slot), str(id_)
            content = f"{kind}|{instruction}|{wallet}|{slot}|{quote}|{base}"
            known = events.get(id_)
            if known is not None:
                if known != content:
                    reject(seq, "identity_conflict")
                continue
            if last_ns is not None and ns < last_ns:
                reject(seq, "availability_clock_regression")
                continue
            events.put(id_, content)
            late = last_slot is not None and slot < last_slot
            last_slot, last_ns = slot if last_slot is None else max(slot, last_slot), ns
            if kind != "swap":
                continue
            q, b, wallet, buy = int(quote), int(base), str(wallet), instruction != "sell"
            if q <= 0 or b <= 0:
                reject(seq, "zero_swap_amount")
                continue
            fresh = wallets.get(wallet) is None
            if fresh:
                wallets.put(wallet, "")
            if s["anchor"] is None:
                s["anchor"], s["peak"] = [q, b, ns], [q, b]
                s["due"] = [[h, ns + h * 1_000_000_000] for h in self.horizons]
            if q * s["peak"][1] > s["peak"][0] * b:
                s["peak"] = [q, b]
            s["fall"] = min(s["fall"], _bps(q, b, *s["peak"]))
            quotes.append(q), bases.append(b), who.append(wallet), bought.append(buy)
            volume.append(volume[-1] + q), buys.append(buys[-1] + buy)
            inside[wallet] += 1
            n = len(quotes)
            if n > window:
                gone = who[n - window - 1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
            first = max(0, n - window)
            mid = first + (n - first) // 2
            early, rest, bought_now = volume[mid] - volume[first], volume[n] - volume[mid], buys[n] - buys[first]
            out.append((pool, seq, "feature", late, fresh, n - first, early + rest, rest - early, bought_now, n - first - bought_now, len(inside),
                        _bps(q, b, quotes[first], bases[first]), s["fall"], None, None, None, None))
            if s["due"] and min(d[1] for d in s["due"]) <= ns:
                for h, due in [d for d in s["due"] if d[1] <= ns]:
                    out.append((pool, seq, "outcome", *[None] * 9, s["fall"], h, due, ns, _bps(q, b, *s["anchor"][:2])))
                s["due"] = [d for d in s["due"] if d[1] > ns]
        events.write()
        wallets.write()
        s |= {"slot": last_slot, "ns": last_ns, "recent": list(zip(quotes, bases, who, bought))[-window:]}
        self.pool.update((json.dumps(s),))
        columns = zip(*out) if out else [[]] * len(_COLUMNS)
        yield pd.DataFrame({c: list(x) if c in ("entry", "late", "new_wallet") else pd.array(list(x), dtype="Int64") for c, x in zip(_COLUMNS, columns)})

    def close(self) -> None:
        pass


def stream_pool_features(events: DataFrame, window: int = 64, horizons=(60, 300, 1800, 3600, 86400), ttl_ms: int | None = None) -> DataFrame:
    """Feature, outcome and reject rows of a swap stream (columns as in the batch operators plus ``id``)."""
    if not 2 <= window <= 1024 or not 0 < len(horizons) <= 6:
        raise ValueError("window must be 2..1024 rows and at most six horizons")
    return events.groupBy("pool").transformWithStateInPandas(
        statefulProcessor=PoolFeatures(window, horizons, ttl_ms), outputStructType=FEATURE_SCHEMA, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class AlertState(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "codes string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active = set(json.loads(self.active.get()[0])) if self.active.exists() else set()
        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values("id").itertuples(index=False):
            codes = {c for c in r.codes if c in ALERT_CODES}
            now = codes if r.complete else active | codes
            out += [(key[0], c, int(r.id), "OPEN") for c in sorted(now - active)] + [(key[0], c, int(r.id), "RESOLVED") for c in sorted(active - now)]
            active = now
        self.active.update((json.dumps(sorted(active)),))
        yield pd.DataFrame(out, columns=["source", "code", "id", "state"])

    def close(self) -> None:
        pass


def stream_alerts(observations: DataFrame) -> DataFrame:
    """Alert transitions of a stream of observations (source, id, codes, complete)."""
    return observations.groupBy("source").transformWithStateInPandas(
        statefulProcessor=AlertState(), outputStructType="source string, code string, id bigint, state string", outputMode="Append", timeMode="None")


def stream_dedup(events: DataFrame, event_time: str, bound: str, identity: str = "id") -> DataFrame:
    """Drop repeats of an id that arrive within ``bound`` of each other; state older than that is forgotten."""
    return events.withWatermark(event_time, bound).dropDuplicatesWithinWatermark([identity])


def stream_publish(stream: DataFrame, path: str, checkpoint: str, identity: str = "id", content: str = "hash", order=("ord",)):
    """Writer that appends unseen ids to the table at ``path`` exactly once and sets conflicts aside.

    Each batch owns the folder batch=<n>, so a batch that is run again replaces its own output
    and reads only what earlier batches published.
    """

    def land(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        schema = f"{identity} {batch.schema[identity].dataType.simpleString()}, {content} {batch.schema[content].dataType.simpleString()}, batch bigint"
        # the folder of the table is made by the first batch
        spark.createDataFrame([], schema.rsplit(",", 1)[0]).write.mode("append").parquet(f"{path}/published/batch=-1")
        before = spark.read.schema(schema).parquet(f"{path}/published").where(F.col("batch") < n).select(identity, content)
        verdict = publish_unique(batch, before, identity, content, order)
        verdict.where("action = 'insert'").select(identity, content).write.mode("overwrite").parquet(f"{path}/published/batch={n}")
        verdict.where("action = 'conflict'").select(identity, content).write.mode("overwrite").parquet(f"{path}/conflicts/batch={n}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


#: Shelves of ids in a bucket: what one state entry holds is one of these. Parts of a bucket: what one call of the processor sees is one of these.
SHELVES, PARTS = 4096, 64


class KnownIds(StatefulProcessor):
    """Content of every id of a part of a bucket: the first content is new, the same again is dropped, another one is a conflict.

    Ids lie on shelves, a map from id to content each, so a batch reads and writes its shelves once instead of every id by itself. With
    a time to live an id is a shelf of its own, as it is forgotten by itself.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "shelf string", "ids array<string>, contents array<string>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ord", "content"], kind="stable")
        batch = batch.drop_duplicates(["id", "content"])
        batch = batch[batch["id"].notna()]
        out = []
        for shelf, some in batch.groupby("shelf" if self.ttl_ms is None else "id", sort=False):
            shelf = (str(shelf),)
            known = dict(zip(*self.known.getValue(shelf))) if self.known.containsKey(shelf) else {}
            before = len(known)
            for id_, content in zip(some["id"], some["content"]):
                if id_ not in known:
                    known[id_] = content
                    out.append((id_, content, "new"))
                elif known[id_] != content:
                    out.append((id_, content, "conflict"))
            if len(known) > before:
                self.known.updateValue(shelf, (list(known), list(known.values())))
        yield pd.DataFrame(out, columns=["id", "content", "action"])

    def close(self) -> None:
        pass


def stream_known_ids(stream: DataFrame, identity: str = "id", content: str = "hash", order: str = "ord", buckets: int = 200, ttl_ms: int | None = None) -> DataFrame:
    """id, content and action (new or conflict) of a stream; repeats of a known content are dropped.

    State is keyed by shelves of ids inside parts of buckets, so a task holds the rows of one part at a time and a batch touches the shelves of its own ids, a small part of a long history if it is small itself. Written by a file sink, each
    batch is listed in one atomic step, so a batch that runs again adds nothing. ``ttl_ms`` forgets ids after that time; without it
    ids are kept for ever, as exactly-once publication needs. In one batch the smallest (order, content) of an id comes first.
    """
    rows = stream.select(
        F.pmod(F.xxhash64(identity), F.lit(buckets)).cast("int").alias("bucket"),
        F.pmod(F.xxhash64(identity, F.lit("shelf")), F.lit(SHELVES)).alias("shelf"), F.col(identity).cast("string").alias("id"),
        F.col(content).cast("string").alias("content"), F.col(order).cast("bigint").alias("ord"))
    return rows.withColumn("part", F.col("shelf") % PARTS).groupBy("bucket", "part").transformWithStateInPandas(
        statefulProcessor=KnownIds(ttl_ms), outputStructType="id string, content string, action string", outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def stream_closed_windows(messages: DataFrame, event_time: str, length: str, delay: str) -> DataFrame:
    """Feed windows of fixed length, written once when the watermark has passed them; state of closed windows is dropped.

    messages: window_id (the feed), observed_ns, marker and a timestamp.
    """
    return (
        messages.withWatermark(event_time, delay)
        .groupBy("window_id", F.window(event_time, length).alias("w"))
        .agg(F.min("observed_ns").alias("first_ns"), F.max("observed_ns").alias("last_ns"), F.count(F.lit(1)).alias("messages"),
             F.max(F.col("marker").eqNullSafe("open")).alias("opened"), F.max(F.col("marker").eqNullSafe("close")).alias("closed"))
        .select("window_id", F.col("w.start").alias("starts"), "first_ns", "last_ns", "messages", "opened", "closed", F.lit("PARTIAL").alias("coverage"))
    )


def stream_coverage(messages: DataFrame) -> DataFrame:
    """Per feed window: bounds, messages, open and close markers; coverage stays PARTIAL by nature.

    messages: window_id, seq, observed_ns, marker ('open' / 'close' / null).
    """
    return messages.groupBy("window_id").agg(
        F.min("observed_ns").alias("first_ns"), F.max("observed_ns").alias("last_ns"), F.count(F.lit(1)).alias("messages"),
        F.max(F.col("marker").eqNullSafe("open")).alias("opened"), F.max(F.col("marker").eqNullSafe("close")).alias("closed")
    ).withColumn("coverage", F.lit("PARTIAL"))


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there now and return what it wrote."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    else:
        # the newest full result replaces the one before it
        q = stream.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")).option(
            "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
