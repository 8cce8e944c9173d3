"""Lowest, highest and last mark inside many intervals of one ordered stream, overlapping or not.

Marks are ranked per key by one ordered scan that also gives every interval its first and last
rank. Ranks are cut into blocks of ``BLOCK`` marks. An interval is at most two partial blocks,
each answered from the block's own row, and a run of whole blocks, answered by two entries of a
sparse table (extrema of 1, 2, 4, ... blocks). So a mark serves every interval open over it, no
mark-interval pair is formed, and an interval costs four look-ups however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import price_key
from ..session import cut_lineage
from .ordered import Ordered, Split

BLOCK = 128
FOREVER = 2**63 - 1


def _point(df: DataFrame, key: str, t: Column, rank: int, tie: Column, side: int | None, value: Column) -> DataFrame:
    return df.select(
        F.col(key).alias("key"), t.cast("bigint").alias("t"), F.lit(rank).alias("rank"), tie.cast("bigint").alias("tie"),
        F.lit(side).cast("int").alias("side"), value.alias("v"))


def _sparse(blocks: DataFrame, widest: int) -> DataFrame:
    """key, level, block, lo, hi: extrema of 2^level blocks from ``block`` on, as far as ``widest`` blocks need."""
    level = blocks.select("key", F.lit(0).alias("level"), "block", "lo", "hi")
    out, size, k = level, 1, 0
    while 2 * size <= widest:
        after = level.select("key", (F.col("block") - size).alias("block"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        k += 1
        level = cut_lineage(level.join(after, ["key", "block"]).select(
            "key", F.lit(k).alias("level"), "block", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi")))
        out, size = out.unionByName(level), 2 * size
    return out


def interval_extrema(marks: DataFrame, intervals: DataFrame, key: str = "pool", split: Split = Split(), block: int = BLOCK) -> DataFrame:
    """key, interval_id, samples, lo, hi, last: structs of quote_raw and base_raw, null without a mark inside.

    marks: key, availability_ns, seq, quote_raw, base_raw (positive). intervals: key, interval_id (unique in the
    key), from_ns (exclusive), until_ns (inclusive, null: no end). Prices are compared exactly.
    """
    amount = F.struct(F.col("quote_raw"), F.col("base_raw"))
    none = F.lit(None).cast(marks.select(amount.alias("v")).schema["v"].dataType)
    stream = _point(marks, key, F.col("availability_ns"), 0, F.col("seq"), None, amount)
    stream = stream.unionByName(_point(intervals, key, F.col("from_ns"), 1, F.col("interval_id"), 0, none))
    stream = stream.unionByName(_point(intervals, key, F.coalesce("until_ns", F.lit(FOREVER)), 1, F.col("interval_id"), 1, none))
    is_mark = F.col("rank") == 0
    o = Ordered(stream, ["key"], ["t", "rank", "tie"], split).running(at=("sum", F.when(is_mark, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))))
    placed = cut_lineage(o.result().select("key", "tie", "side", "at", "v"))

    def block_of(rank: Column) -> Column:
        return F.floor(rank / block).cast("bigint")

    item = F.struct(F.col("at"), F.struct(price_key("v.quote_raw", "v.base_raw").alias("price"), F.col("v")).alias("m"))
    blocks = placed.where(F.col("side").isNull()).groupBy("key", block_of(F.col("at") - 1).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    blocks = cut_lineage(blocks.select(
        "key", "block", F.transform("items", lambda i: i["m"]).alias("items")).withColumns({"lo": F.array_min("items"), "hi": F.array_max("items")}))
    ends = placed.where(F.col("side").isNotNull()).groupBy("key", F.col("tie").alias("interval_id")).agg(
        F.max(F.when(F.col("side") == 0, F.col("at"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("b"))
    ends = ends.withColumns({"samples": F.greatest(F.col("b") - F.col("a"), F.lit(0)), "first": block_of(F.col("a")), "final": block_of(F.col("b") - 1)})
    ends = cut_lineage(ends.withColumn("between", F.col("final") - F.col("first") - 1))
    inside = ends.where(F.col("samples") > 0)

    def piece(at: Column, lo: Column, hi: Column) -> Column:
        return F.struct(at.alias("block"), lo.cast("int").alias("from"), hi.cast("int").alias("to"))

    low, high = F.col("a") % block, (F.col("b") - 1) % block
    pieces = F.when(F.col("first") == F.col("final"), F.array(piece(F.col("first"), low, high))).otherwise(
        F.array(piece(F.col("first"), low, F.lit(block - 1)), piece(F.col("final"), F.lit(0), high)))
    part = inside.select("key", "interval_id", "final", F.explode(pieces).alias("p")).select("key", "interval_id", "final", "p.*").join(blocks.select("key", "block", "items"), ["key", "block"])
    cut = F.slice("items", F.col("from") + 1, F.col("to") - F.col("from") + 1)
    found = part.select("key", "interval_id", F.array_min(cut).alias("lo"), F.array_max(cut).alias("hi"), F.when(F.col("block") == F.col("final"), F.element_at(cut, -1)["v"]).alias("last"))
    widest = inside.agg(F.max("between")).first()[0] or 0
    if widest > 0:
        level = F.length(F.bin("between")) - 1
        second = F.col("final") - F.expr("shiftleft(1L, level)")
        runs = inside.where(F.col("between") > 0).withColumn("level", level)
        runs = runs.select("key", "interval_id", "level", F.explode(F.array_distinct(F.array(F.col("first") + 1, second))).alias("block"))
        whole = runs.join(_sparse(blocks, widest), ["key", "level", "block"])
        found = found.unionByName(whole.select("key", "interval_id", "lo", "hi", F.lit(None).cast(found.schema["last"].dataType).alias("last")))
    best = found.groupBy("key", "interval_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("last", ignorenulls=True).alias("last"))
    return ends.select("key", "interval_id", "samples").join(best, ["key", "interval_id"], "left").select(
        F.col("key").alias(key), "interval_id", "samples", F.col("lo.v").alias("lo"), F.col("hi.v").alias("hi"), "last")
