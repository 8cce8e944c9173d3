import hashlib
import json

from conftest import rows_of
from pyspark.sql import functions as F

from tidemark.operators import pit as I
from tidemark.operators import validate as P
from tidemark.operators.ordered import Split

BASE = {"schema_version": 1, "source": "fixture", "source_id": "s0", "logical_id": "token:a", "kind": "token_creation", "event_time": 10, "slot": 1, "blockhash": "b",
        "commitment": "finalized", "revision": 0, "supersedes": None, "retracted": False, "payload": {"symbol": "SYNTHETIC"}}


def test_record_contract(spark):
    text = json.dumps(BASE)
    cases = {
        text: "ok", json.dumps({**BASE, "event_time": True}): "invalid time/slot", json.dumps({**BASE, "extra": 1}): "unknown or missing fields",
        text.replace('"source"', '"kind": "swap", "source"', 1): "invalid JSON", text.replace('"SYNTHETIC"', "NaN"): "invalid JSON",
        json.dumps({**BASE, "commitment": "offchain"}): "offchain with chain identity", json.dumps({**BASE, "blockhash": ""}): "missing chain identity",
        json.dumps({**BASE, "schema_version": 2}): "unsupported schema", json.dumps({**BASE, "source_id": "x" * 257}): "invalid identity", json.dumps({**BASE, "slot": 2**63}): "invalid time/slot",
        json.dumps({**BASE, "retracted": 0}): "invalid payload/retraction", json.dumps({**BASE, "payload": []}): "invalid payload/retraction", "[1]": "unknown or missing fields",
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r["raw"]: r["reason"] for r in rows_of(P.validate_record(df))} == cases


def test_canonical_json_sorts_and_keeps_nulls(spark):
    from tidemark.functions.jsonio import canonical_json
    r = spark.createDataFrame([('{"b": null, "a": [1, {"z": "ü", "y": 2}]}',), ('{"a":1,"a":2}',)], "t string").select(canonical_json("t").alias("c"))
    assert [x["c"] for x in r.collect()] == ['{"a":[1,{"y":2,"z":"ü"}],"b":null}', None]


REC = "capture_id bigint, source string, source_id string, logical_id string, kind string, revision bigint, supersedes string, retracted boolean, document string"


def fold(rows):
    """Row-by-row acceptance: the meaning the distributed operator must reproduce."""
    ids, chains, out = {}, {}, {}
    for c, source, sid, logical, kind, rev, sup, ret, doc in sorted(rows):
        parent = chains.get((source, logical))
        if (source, sid) in ids:
            out[c] = ("duplicate", "identical source event") if ids[(source, sid)] == doc else ("quarantined", "source ID conflict")
        elif parent is None and (rev != 0 or sup is not None or ret):
            out[c] = ("quarantined", "missing revision parent")
        elif parent is not None and (rev != parent[0] + 1 or sup != parent[1]):
            out[c] = ("quarantined", "invalid revision chain")
        elif parent is not None and kind != parent[2]:
            out[c] = ("quarantined", "revision changes kind")
        else:
            ids[(source, sid)], chains[(source, logical)] = doc, (rev, sid, kind)
            out[c] = ("accepted", "ok")
    return out


def test_revisions_equal_the_row_by_row_fold(spark):
    from random import Random
    rnd = Random(3)
    rows = []
    for c in range(220):
        logical, rev = rnd.choice("abc"), rnd.randint(0, 6)
        sid = f"{logical}{rev}" if rnd.random() < 0.9 else "shared"
        sup = None if rev == 0 else f"{logical}{rev - 1}" if rnd.random() < 0.9 else "shared"
        rows.append((c, "s", sid, logical, "risk" if rnd.random() < 0.05 else "swap", rev, sup, rnd.random() < 0.05, f"d{rnd.randint(0, 1)}"))
    # a correction that came too early is accepted when it is delivered again
    rows += [(300, "t", "x1", "k", "swap", 1, "x0", False, "d"), (301, "t", "x0", "k", "swap", 0, None, False, "d"), (302, "t", "x1", "k", "swap", 1, "x0", False, "d")]
    df = spark.createDataFrame(rows, REC).repartition(6)
    for split in (Split(), Split(20)):
        got = {r["capture_id"]: (r["status"], r["reason"]) for r in rows_of(I.validate_revisions(df, split))}
        assert got == fold(rows)
    assert got[300][0] == "quarantined" and got[302][0] == "accepted"


def test_latest_state_drops_retracted(spark):
    df = spark.createDataFrame([("s", "a", 0, False, 10), ("s", "a", 1, True, 20), ("s", "b", 0, False, 15)], "source string, logical_id string, revision bigint, retracted boolean, available_at bigint")
    assert sorted(r["logical_id"] for r in rows_of(I.latest_state(df, 12))) == ["a"]
    assert sorted(r["logical_id"] for r in rows_of(I.latest_state(df, 30))) == ["b"]


def test_hash_chain_detects_tampering(spark):
    def link(seq, doc, prev):
        return hashlib.sha256(f"[{seq},{json.dumps([doc])},{json.dumps([prev])}]".encode()).hexdigest()

    rows, prev = [], I.ZERO_HASH
    for n in range(1, 41):
        h = link(n, f"doc{n}", prev)
        rows.append(["log", n, f"doc{n}", prev, h, n * 10])
        prev = h
    bad = [["bad", *r[1:]] for r in rows]
    bad[16][2] = "changed"
    late = [["late", *r[1:]] for r in rows]
    late[9][5] = late[8][5]
    df = spark.createDataFrame(rows + bad + late, "log_id string, seq bigint, document string, prev string, hash string, at bigint").repartition(4)
    for split in (Split(), Split(6)):
        got = {r["log_id"]: (r["first_break"], r["fault"]) for r in rows_of(I.hash_chain_verify(df, I.chain_hash("seq", "document", "prev"), split=split))}
        assert got == {"log": (None, None), "bad": (17, "hash"), "late": (10, "clock")}


def test_fingerprint_ignores_partitioning_and_sees_changes(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    a, b = I.fingerprint(df.repartition(3)).first(), I.fingerprint(df.orderBy(F.desc("id"))).first()
    assert a == b and I.fingerprint(df.where("id <> 3")).first() != a


def test_publish_clock(spark):
    import pytest
    df = spark.createDataFrame([(1, 50)], "capture_id bigint, processed_at bigint")
    assert I.publish(df, 60).first()["available_at"] == 60
    with pytest.raises(Exception, match="clock regression"):
        I.publish(df, 40).collect()
    with pytest.raises(Exception, match="clock regression"):
        I.publish(df, 60, spark.createDataFrame([(70,)], "available_at bigint")).collect()


def test_publish_unique_first_arrival_wins(spark):
    new = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 3), ("b", "x", 4), ("c", "n", 5)], "id string, hash string, ord bigint")
    old = spark.createDataFrame([("c", "o")], "id string, hash string")
    got = {(r["id"], r["hash"]): r["action"] for r in rows_of(I.publish_unique(new, old))}
    assert got == {("a", "y"): "insert", ("a", "x"): "conflict", ("b", "x"): "insert", ("c", "n"): "conflict"}
