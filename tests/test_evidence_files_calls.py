"""Inner call parents, secrets by the thousand, changed files, run reports and one-pass accounting."""

import glob
import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from tidemark.operators import decode, ops, pit, rules, validate
from tidemark.sources import files

CALLS = ("slot bigint, blockhash string, transaction_index int, signature string, keys array<string>, status string, "
         f"instructions array<{decode.INSTRUCTION}>, inner array<struct<index:int,instructions:array<{decode.INSTRUCTION}>>>")


def ix(depth, program=0):
    return (program, [0], "abc", depth)


def parents(depths):
    """Row-by-row stack of open calls."""
    out, open_ = [], []
    for i, d in enumerate(depths):
        if d is None or d < 2 or d > len(open_) + 2:
            open_ = []
            out.append((None, "depth_missing" if d is None or d < 2 else "parent_missing"))
        else:
            out.append((open_[d - 3] if d > 2 else None, "ok"))
            open_ = [*open_[: d - 2], i]
    return out


def test_parents_of_inner_calls(spark):
    from random import Random
    r = Random(5)
    groups = [[2, 3, 4, 4, 3, 2, 3], [3, 2], [2, None, 3, 2, 3], [], [2, 4], *[[r.choice([2, 2, 3, 3, 4, 5, None]) for _ in range(r.randint(1, 12))] for _ in range(60)]]
    rows = [(i, "b", 0, f"s{i}", ["k"], "processed", [ix(None)], [(0, [ix(d) for d in g])]) for i, g in enumerate(groups)]
    got = {}
    for x in rows_of(decode.inner_calls(spark.createDataFrame(rows, CALLS))):
        got.setdefault(x["slot"], []).append((x["inner_instruction_index"], x["parent_inner_index"], x["state"]))
    for i, g in enumerate(groups):
        assert sorted(got.get(i, [])) == [(k, p, s) for k, (p, s) in enumerate(parents(g))]


def test_a_hundred_thousand_secrets(spark):
    secrets = spark.range(100_000).select(F.concat(F.lit("key/"), F.sha2(F.col("id").cast("string"), 256)).alias("secret"))
    secrets = secrets.unionByName(spark.createDataFrame([("p w+d",), ("abc",), (None,), ("four",), ("twelve chars",)], "secret string"))
    import hashlib
    one = "key/" + hashlib.sha256(b"77777").hexdigest()
    bodies = [(1, f"x {one} y"), (2, one[:-1]), (3, "has p%20w%2Bd in it"), (4, "abc"), (5, None), (6, ""), (7, '{"a": "\\u0066our"}'), (8, "fou r"), (9, "k" * 5000 + "twelve chars"), (10, one.replace("/", "%2F"))]
    for limit in (1 << 30, 0):
        got = {r["id"]: r["secret_echo"] for r in rows_of(validate.secret_echo_join(spark.createDataFrame(bodies, "id int, text string"), secrets, most_bytes=limit))}
        assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False, 9: True, 10: True}


def test_checked_dataset_names_changed_files(spark, tmp_path):
    root = str(tmp_path / "sets")
    df = spark.range(300).select("id", (F.col("id") % 7).alias("k")).repartition(3)
    digest = files.write_content_addressed(df, root)
    assert files.write_content_addressed(df.repartition(5), root) == digest == pit.fingerprint(df).first()["dataset_sha256"]
    good = files.CheckedDataset(spark, root, digest)
    assert good.rows.count() == 300 and good.verify() == 300
    assert files.changed_files(spark, root, digest).count() == 0
    changed = sorted(glob.glob(f"{root}/{digest}/*.parquet"))[0]
    spark.range(100).select("id", F.lit(0).cast("bigint").alias("k")).coalesce(1).write.parquet(str(tmp_path / "other"))
    os.replace(glob.glob(str(tmp_path / "other" / "*.parquet"))[0], changed)
    for crc in glob.glob(f"{root}/{digest}/.*.crc"):
        os.remove(crc)
    bad = files.CheckedDataset(spark, root, digest)
    bad.rows.write.format("noop").mode("overwrite").save()
    with pytest.raises(ValueError, match=f"{os.path.basename(changed)} changed"):
        bad.verify()
    empty = files.write_content_addressed(df.limit(0), root)
    assert empty == pit.fingerprint(df.limit(0)).first()["dataset_sha256"]


def test_file_hashes_and_manifest(spark, tmp_path):
    for name, text in (("a/x.txt", "one"), ("b/x.txt", "two"), ("y.txt", "three")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    before = rows_of(pit.file_hashes(spark, str(tmp_path)))
    assert {r["name"] for r in before} == {"a/x.txt", "b/x.txt", "y.txt"}
    manifest = spark.createDataFrame([(r["name"], r["sha256"]) for r in before], "name string, sha256 string")
    (tmp_path / "b/x.txt").write_text("changed")
    (tmp_path / "y.txt").unlink()
    (tmp_path / "z.txt").write_text("new")
    got = {r["name"]: r["state"] for r in rows_of(pit.verify_manifest(manifest, pit.file_hashes(spark, str(tmp_path))))}
    assert got == {"b/x.txt": "changed", "y.txt": "missing", "z.txt": "unlisted"}


def test_reports_open_and_resolve_alerts(spark):
    ddl = "source string, id bigint, status string, code string, alerts array<string>, has_metrics boolean, requests bigint, request_limit bigint, charged_units bigint, unit_limit bigint"
    rows = [("s", 1, "PASS", None, ["decoder_errors", "odd"], True, None, None, None, None), ("s", 2, "WAIT", None, None, None, 5, 5, 0, 9),
            ("s", 3, "FAIL", "odd", None, None, None, None, None, None), ("s", 4, "PASS", None, [], False, None, None, None, None), ("s", 5, "PASS", None, [], True, 1, 5, 1, 9)]
    seen = ops.report_observation(spark.createDataFrame(rows, ddl))
    assert [(r["codes"], r["complete"]) for r in seen.orderBy("id").collect()] == [
        (["decoder_errors"], True), (["quota_exhausted"], False), (["unclassified_failure"], False), ([], False), ([], True)]
    got = sorted((r["id"], r["code"], r["state"]) for r in rows_of(ops.alert_lifecycle(seen)))
    assert got == [(1, "decoder_errors", "OPEN"), (2, "quota_exhausted", "OPEN"), (3, "unclassified_failure", "OPEN"),
                   (5, "decoder_errors", "RESOLVED"), (5, "quota_exhausted", "RESOLVED"), (5, "unclassified_failure", "RESOLVED")]


def test_events_without_publication_keep_their_place(spark):
    e = spark.createDataFrame([(1,), (2,)], "slot bigint")
    p = spark.createDataFrame([(1, 7)], "slot bigint, attempt_id bigint")
    assert [(r["slot"], r["provenance_reason"]) for r in decode.attach_event_provenance(e, p).orderBy("slot").collect()] == [(1, "ok"), (2, "publication_missing")]


def test_qualification_and_decomposition(spark):
    q = spark.createDataFrame([(1, ["quota_exhausted"]), (0, None), (2, ["b", "a", "b"])], "position_observations bigint, errors array<string>")
    assert [(r["status"], r["code"], r["source_error_codes"]) for r in validate.watch_qualification(q).collect()] == [
        ("PASS", "position_bounded_observation", []), ("NOT_EXECUTED", "no_new_position_observation", []), ("FAIL", "position_source_error", ["a", "b"])]
    s = spark.sql("select 50L momentum_bps, 1000L imbalance_bps, 7L quote_reserve, 1L base_reserve, 1000000L quote_age_ns, 10L quote_impact_bps, array() as required_missing")
    d = rules.context_score(rules.opportunity_scores(s)).first()
    parts = d["decomposition"]
    assert parts["final"] == d["opportunity_score"] == sum(parts[p]["contribution_x100"] for p in ("market", "execution", "quality")) // 100
    assert parts["liquidity"]["weight"] == parts["risk_weight"] == 0 and parts["liquidity"]["value"] == 7
