"""Blocks are built from narrow rows with one shuffle, and base58 texts are measured without decoding them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs
from tidemark.plans import decode_q, nested


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    at = datetime.datetime(2024, 1, 1)
    rows = [(o, 10 + n, 20 + o % 3, n, float(o % 60 + n), 1000.25 + o * n, (o % 11) / 100, (n % 9) / 100, "NRA"[(o + n) % 3], "F", at) for o in range(40) for n in (2, 1, 2, 3)]
    rows.append((None, 1, 2, 1, 3.0, 5.0, 0.01, 0.01, "N", "F", at))
    rows.append((77, None, None, None, None, None, None, None, None, None, None))
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{path}/lineitem.parquet")
    return path


def test_transactions_shuffle_narrow_rows_once(spark, lines):
    plan = decode_q.transactions_q(spark, lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    shuffled = plan[plan.index("Exchange hashpartitioning"):]
    # encoding comes after the shuffle
    assert "ArrowEvalPython" not in shuffled and "ArrowEvalPython" in plan


def test_blocks_hold_what_the_rows_say(spark, lines):
    out = {(r["slot"], i): t for r in nested.blocks(spark, lines).collect() for i, t in enumerate(r["transactions"])}
    assert len(out) == 162 and out[(None, 0)]["meta"]["fee"] == "500"
    assert out[(77, 0)]["accountKeys"][:4] == [None] * 4
    slots = [out[(5, i)] for i in range(4)]
    amounts = [1000.25 + 5 * n for n in (1, 2, 2, 3)]
    assert [t["meta"]["fee"] for t in slots] == [str(round(a * 100)) for a in amounts]
    for t, n, a in zip(slots, (1, 2, 2, 3), amounts):
        raw = codecs.from_base58(t["signatures"][0])
        assert len(raw) == 64 and len(codecs.from_base58(t["accountKeys"][0])) == 32
        if "NRA"[(5 + n) % 3] != "A":
            data = codecs.from_base58(t["instructions"][0]["data"])
            assert round(a * 100).to_bytes(8, "little") in data


def test_length_of_base58_without_decoding(spark):
    rng = random.Random(3)
    texts = ["", None, "0", "l", "1", "1" * 32, "z" * 43, "z" * 44, "z" * 256, "z" * 257, "1" * 257, "\n", "ab\n", "é"]
    for n in list(range(1, 70)) + [120, 187]:
        texts += [codecs.to_base58(bytes([255]) * n), codecs.to_base58(bytes([1]) + bytes(n - 1)), codecs.to_base58(bytes(2) + rng.randbytes(n))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codecs.base58_length("t").alias("n"), codecs.keys_valid(F.array("t", "t")).alias("k"))
    for r in df.collect():
        raw = codecs.from_base58(r["t"], 256)
        assert r["n"] == (None if raw is None else len(raw)), r
        assert r["k"] == (raw is not None and len(raw) == 32)
    assert spark.range(1).select(codecs.keys_valid(F.lit(None).cast("array<string>")).alias("k")).first()["k"] is False


def test_codecs_in_groups():
    rng = random.Random(4)
    raws = [bytes(rng.randrange(3)) + rng.randbytes(rng.randrange(70)) for _ in range(9000)] + [b"", None, b"\xff" * 64, bytes(64)]
    texts = codecs.encode_batch(raws)
    assert texts == [None if r is None else codecs.to_base58(r) for r in raws]
    assert codecs.decode_batch(texts + ["0", "é" * 5, "z" * 95]) == [codecs.from_base58(t) for t in texts + ["0", "é" * 5, "z" * 95]]
