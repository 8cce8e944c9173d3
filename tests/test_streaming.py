from conftest import rows_of
from pyspark.sql import functions as F

from tidemark.operators import ops as O
from tidemark.operators.features import opportunity_features
from tidemark.plans.stream_q import with_rocksdb
from tidemark.sources import files as S
from tidemark.streaming import pools as X

COLUMNS = "pool bigint, seq bigint, id string, slot bigint, availability_ns bigint, wallet string, kind string, instruction string, base_raw bigint, quote_raw bigint"


def land(spark, path, batches, schema):
    """One file per batch, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/part={n:03d}")
    return S.stream_frames(spark, f"{path}/in", schema + ", part string", files_per_trigger=1).drop("part")


def swap(seq, ns, quote, pool=1, sid=None, slot=None):
    return (pool, seq, sid or f"e{seq}", seq if slot is None else slot, ns, f"w{seq % 2}", "swap", "sell" if seq % 3 == 0 else "buy", 10, quote)


def test_pool_stream_over_several_batches(spark, tmp_path):
    with_rocksdb(spark)
    good = [swap(n, n * 10, 100 + (n * 37) % 50) for n in range(1, 13)]
    batches = [good[:5], [good[2], swap(99, 15, 7, sid="e3")] + good[5:8], good[8:] + [swap(50, 20, 5), swap(51, 500, 0)]]
    out = rows_of(X.run_available(X.stream_pool_features(land(spark, str(tmp_path), batches, COLUMNS), 4, (1,)), str(tmp_path)))
    feats = {r["seq"]: r for r in out if r["entry"] == "feature"}
    batch = spark.createDataFrame(good, COLUMNS)
    for r in rows_of(opportunity_features(batch, 4)):
        mine = feats[r["seq"]]
        assert all(mine[c] == r[c] for c in ("swaps_observed", "volume_quote_raw", "half_window_volume_change_raw", "buy_count", "wallets_unique", "price_change_bps"))
    assert set(feats) == set(range(1, 13))
    assert sorted((r["seq"], r["entry"]) for r in out if r["entry"] not in ("feature", "outcome")) == [(50, "availability_clock_regression"), (51, "zero_swap_amount"), (99, "identity_conflict")]


def test_alert_stream_equals_batch(spark, tmp_path):
    with_rocksdb(spark)
    schema = "source string, id bigint, codes array<string>, complete boolean"
    rows = [("s" if n % 3 else "t", n, [["decoder_errors"], [], ["quota_exhausted", "slots_unresolved"]][n % 3 - (n % 2)], n % 4 == 0) for n in range(40)]
    stream = land(spark, str(tmp_path), [rows[:15], rows[15:30], rows[30:]], schema)
    got = sorted(tuple(r.values()) for r in rows_of(X.run_available(X.stream_alerts(stream), str(tmp_path))))
    assert got == sorted(tuple(r.values()) for r in rows_of(O.alert_lifecycle(spark.createDataFrame(rows, schema))))


def test_publish_once_across_batches_and_restart(spark, tmp_path):
    schema = "id string, hash string, ord bigint"
    batches = [[("a", "1", 1), ("b", "1", 2), ("b", "2", 3)], [("a", "1", 4), ("a", "9", 5), ("c", "1", 6)]]
    stream = land(spark, str(tmp_path), batches, schema)
    table, check = f"{tmp_path}/table", f"{tmp_path}/check"
    for _ in range(2):
        X.stream_publish(stream, table, check).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{table}/published").select("id", "hash").collect())) == [("a", "1"), ("b", "1"), ("c", "1")]
    assert sorted(map(tuple, spark.read.parquet(f"{table}/conflicts").select("id", "hash").collect())) == [("a", "9"), ("b", "2")]


def test_content_addressed_and_jsonl(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") * 3).cast("decimal(20,0)").alias("amount"))
    root = str(tmp_path / "data")
    first = S.write_content_addressed(df, root)
    assert S.write_content_addressed(df.repartition(7), root) == first and S.read_dataset(spark, root, first).count() == 50
    import pytest
    df.limit(3).write.mode("overwrite").parquet(f"{root}/{first}")
    with pytest.raises(Exception, match="hash mismatch"):
        S.read_dataset(spark, root, first).collect()
    with pytest.raises(ValueError):
        S.write_content_addressed(df, root)
    S.export_jsonl(df.where("id = 2"), str(tmp_path / "lines"))
    assert rows_of(S.read_records(spark, str(tmp_path / "lines")).select("raw"))[0]["raw"] == '{"id":2,"amount":"6"}'
