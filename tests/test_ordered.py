"""A split key must give the rows an unsplit key gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import HOME, SEG, Ordered, Split, measured


@pytest.fixture(scope="module")
def skewed(spark):
    # key 0 holds a third of the rows and several rows share a time
    df = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 17 + 1).alias("k"),
        F.floor(F.col("id") / 2).alias("t"),
        F.col("id").alias("seq"),
        F.pmod(F.hash("id"), F.lit(1000)).alias("v"),
    )
    return df


@pytest.mark.parametrize("rows", [7, 40, 10_000])
def test_running_equals_plain_window(skewed, rows):
    w = Window.partitionBy("k").orderBy("t", "seq")
    back = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("seq"))
    want = skewed.select(
        "seq",
        F.max("v").over(w).alias("hi"),
        F.sum("v").over(w).alias("total"),
        F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("lo_before"),
        F.lag("v").over(w).alias("prev"),
        F.min("v").over(back).alias("lo_after"),
    )
    got = (
        Ordered(skewed, ["k"], ["t", "seq"], Split(rows))
        .running(hi=("max", F.col("v")), total=("sum", F.col("v")))
        .running(inclusive=False, lo_before=("min", F.col("v")))
        .running(descending=True, lo_after=("min", F.col("v")))
        .last_seen("prev", F.col("v"))
        .result()
        .select("seq", "hi", "total", "lo_before", "prev", "lo_after")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rows", [5, 40, 10_000])
def test_row_frames_see_across_segments(skewed, rows):
    w = Window.partitionBy("k").orderBy("t", "seq").rowsBetween(-15, 0)
    want = skewed.select("seq", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"))
    o = Ordered(skewed, ["k"], ["t", "seq"], Split(rows), lookback=15)
    got = o.add(s=F.sum("v").over(o.frame(16)), n=F.count("v").over(o.frame(16))).result().select("seq", "s", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bursty_axis_is_cut_evenly(spark):
    # nearly all rows in one second, ten late ones: equal widths would leave one segment with almost everything
    df = spark.range(5000).select(F.lit(1).alias("k"), F.when(F.col("id") < 4990, F.col("id")).otherwise(F.col("id") * 10**9).alias("t"), F.col("id").alias("seq"))
    o = Ordered(df, ["k"], ["t", "seq"], Split(250))
    assert o.df.where(HOME).groupBy(SEG).count().agg(F.max("count")).first()[0] <= 500
    o.running(total=("sum", F.lit(1)))
    assert o.result().where(F.col("total") != F.col("seq") + 1).isEmpty()


def test_one_instant(spark):
    df = spark.range(300).select(F.lit(1).alias("k"), F.lit(7).alias("t"), F.col("id").alias("seq"))
    out = Ordered(df, ["k"], ["t", "seq"], Split(50)).running(total=("sum", F.lit(1))).result()
    assert out.where(F.col("total") == F.col("seq") + 1).count() == 300


def test_range_frames_on_a_bursty_axis(spark):
    df = spark.range(900).select((F.col("id") % 2).alias("k"), F.floor(F.pow(F.col("id") / 30, F.lit(3))).cast("bigint").alias("t"), F.col("id").alias("seq"))
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-40, 0)
    want = df.select("seq", F.count("seq").over(w).alias("n"))
    o = Ordered(df, ["k"], ["t"], Split(30), lookback_range=40)
    got = o.add(n=F.count("seq").over(o.window().rangeBetween(-40, 0))).result().select("seq", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_key_longer_than_the_measured_key(spark):
    df = spark.range(800).select(F.lit(1).alias("k"), (F.col("id") % 37).alias("sub"), F.col("id").alias("t"))
    split = measured(df, ["k"], "t", Split(60))
    out = Ordered(df, ["k", "sub"], ["t"], split).running(total=("sum", F.col("t"))).result()
    w = Window.partitionBy("k", "sub").orderBy("t")
    want = df.select("t", F.sum("t").over(w).alias("total"))
    assert sorted(map(tuple, out.select("t", "total").collect())) == sorted(map(tuple, want.collect()))


def test_one_instant_is_cut_evenly(spark):
    # all rows at one time: only the second column of the order tells them apart
    df = spark.range(6000).select(F.lit(1).alias("k"), F.lit(7).alias("t"), F.col("id").alias("seq"), (F.col("id") % 11).alias("v"))
    o = Ordered(df, ["k"], ["t", "seq"], Split(300))
    sizes = o.df.where(HOME).groupBy(SEG).count().agg(F.max("count"), F.count("count")).first()
    assert sizes[0] <= 600 and sizes[1] >= 10
    out = o.running(total=("sum", F.lit(1)), hi=("max", F.col("v"))).last_seen("prev", F.col("seq")).result()
    assert out.where((F.col("total") != F.col("seq") + 1) | ~F.col("prev").eqNullSafe(F.when(F.col("seq") > 0, F.col("seq") - 1))).isEmpty()


def test_segments_beyond_the_sample(spark):
    # segments longer than the sample taken for each: the cuts are random, the result is not
    df = spark.range(40_000).select((F.col("id") % 10 == 0).cast("int").alias("k"), F.floor(F.sqrt("id")).alias("t"), F.col("id").alias("seq"))
    o = Ordered(df, ["k"], ["t", "seq"], Split(3000))
    assert o.df.where(HOME).groupBy("k", SEG).count().agg(F.max("count")).first()[0] <= 6000
    w = Window.partitionBy("k").orderBy("t", "seq")
    want = df.select("seq", F.count("seq").over(w).alias("n")).where("seq % 97 = 0")
    got = o.running(n=("sum", F.lit(1))).result().select("seq", "n").where("seq % 97 = 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stacked_scans_read_the_source_once(spark, tmp_path):
    spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("v")).write.parquet(f"{tmp_path}/source")
    df = spark.read.parquet(f"{tmp_path}/source")
    for rows in (100, 10_000):
        o = Ordered(df, ["k"], ["t"], Split(rows)).running(a=("sum", F.col("v")))
        o.add(b=F.col("a") % 5)
        out = o.running(c=("max", F.col("b"))).running(descending=True, d=("min", F.col("c"))).result()
        # the cut plan has written the rows with their segments and goes on from there
        assert sum("/source/" in f for f in out.inputFiles()) == (0 if rows == 100 else len(df.inputFiles()))
        assert out.count() == 2000
