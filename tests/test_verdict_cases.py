"""Cases in which unknown, unreserved or unlisted inputs once gave a healthy result."""

import os

import pytest
from pyspark.sql import functions as F
from tidemark.operators import features, ops, pit, validate
from tidemark.operators.ordered import Ordered, Split
from tidemark.sources import files


def test_large_flows_do_not_overflow(spark):
    rows = [("p", i, i, i, i, "w", "swap", "buy" if i % 3 else "sell", 10**15, 10**15) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "pool string, seq long, availability_ns long, slot long, event_time long, wallet string, kind string, instruction string, base_raw long, quote_raw long")
    got = {r["seq"]: r["imbalance_bps"] for r in features.market_features(df).collect()}
    assert got[1] == 10000 and got[5] == 6000


def test_settlements_without_or_with_two_records(spark):
    policy = spark.createDataFrame([("q", 5, 100)], "quota string, requests long, units long")
    reserved = spark.createDataFrame([("q", "a", 50)], "quota string, key string, units long")
    twice = spark.createDataFrame([("a", 40), ("a", 40)], "key string, actual long")
    row = ops.quota_usage(policy, reserved, twice).first()
    assert (row["requests_used"], row["charged_units"], row["errors"], row["healthy"]) == (1, 40, 0, True)
    row = ops.quota_usage(policy, reserved, spark.createDataFrame([("z", 50)], "key string, actual long")).first()
    assert row["errors"] == 1 and row["healthy"] is False


def test_codes_outside_the_list_are_ignored(spark):
    df = spark.createDataFrame([("s", 1, ["weird", ops.ALERT_CODES[0]], False), ("s", 2, [], True)], "source string, id long, codes array<string>, complete boolean")
    got = [(r["code"], r["state"]) for r in ops.alert_lifecycle(df).orderBy("id").collect()]
    assert got == [(ops.ALERT_CODES[0], "OPEN"), (ops.ALERT_CODES[0], "RESOLVED")]


def test_many_secrets(spark):
    secrets = [f"secret-{i}/x" for i in range(3000)]
    df = spark.createDataFrame([("has secret-2999%2Fx in it",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(validate.secret_echo(F.col("t"), secrets)).collect()] == [True, False, False]


def test_fingerprint_tells_fields_apart(spark):
    def of(*row):
        return pit.fingerprint(spark.createDataFrame([row], "a string, b string")).first()["dataset_sha256"]

    assert len({of("a|b", "c"), of("a", "b|c"), of(None, "c"), of("~", "c"), of("", "c"), of("1:a", ""), of("", "1:a")}) == 7
    with pytest.raises(TypeError):
        pit.fingerprint(spark.sql("select map('a', 1) as m"))


def test_content_address_of_what_was_written(spark, tmp_path):
    root = str(tmp_path / "sets")
    other = F.udf(lambda: os.urandom(8).hex()).asNondeterministic()
    df = spark.range(200).withColumn("u", other())  # other values each time it runs
    first = files.write_content_addressed(df, root)
    assert files.read_dataset(spark, root, first).count() == 200
    assert files.write_content_addressed(df, root) != first
    assert not [p for p in (tmp_path / "sets").iterdir() if p.name.startswith("_staging")]


def test_amounts_as_text(spark, tmp_path):
    files.export_jsonl(spark.sql("select 7L as id, 9007199254740993L as raw"), str(tmp_path / "l"), amounts=("raw",))
    assert [r[0] for r in spark.read.text(str(tmp_path / "l")).collect()] == ['{"id":7,"raw":"9007199254740993"}']


def test_lookback_over_uneven_segments(spark):
    df = spark.range(400).selectExpr("'k' as k", "if(id < 380, id div 8, id * 50) as t", "id as s")
    want = {s: list(range(max(0, s - 6), s + 1)) for s in range(400)}
    o = Ordered(df, ["k"], ["t", "s"], Split(20), lookback=6)
    got = o.add(last=F.collect_list("s").over(o.frame(7))).result()
    assert {r["s"]: r["last"] for r in got.collect()} == want


def test_quota_without_policy_is_reported(spark):
    res = spark.createDataFrame([("a", 1, "x", 5), ("a", 2, "y", 5), ("b", 7, "z", 1)], "quota string, ord int, key string, units long")
    policy = spark.createDataFrame([("a", 9, 8)], "quota string, requests long, units long")
    got = {r.quota: (r.key, r.reason) for r in ops.quota_breaches(res, policy).collect()}
    assert got == {"a": ("y", "over_limit"), "b": ("z", "no_policy")}


def test_listed_pool_without_cursor_keeps_its_rows(spark):
    listing = spark.createDataFrame([("p", "s1", 9, False), ("q", "s2", 9, False)], "pool string, signature string, slot long, failed boolean")
    tries = spark.createDataFrame([], "signature string, complete boolean")
    cursors = spark.createDataFrame([("p", 1, 1)], "pool string, cursor_slot long, after_slot long")
    got = {r.pool: r.drop_reason for r in ops.candidate_states(listing, tries, cursors).collect()}
    assert got == {"p": None, "q": "no_cursor"}
