"""Hot keys that are too many for the driver give the same rows as few do, and ledgers of odd intents the same states."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered, pit
from tidemark.operators import ledger as L
from tidemark.operators.ordered import Ordered, Split, measured


def texts(df):
    return sorted(str(sorted(r.asDict(recursive=True).items(), key=lambda x: x[0])) for r in df.collect())


@pytest.fixture
def many(monkeypatch):
    monkeypatch.setattr(ordered, "HOT_KEYS", 3)


def test_hot_keys_stay_in_a_table(spark, many, monkeypatch):
    rows = spark.range(3000).selectExpr("if(id % 11 = 0, null, id % 37) as k", "if(id < 1500, 7, id % 41) as o", "if(id between 1 and 10, null, id) as i", "id % 101 as v")
    assert measured(rows, ["k"], ["o", "i"], Split(20)).many.count() == 38
    sent = []
    kind = type(rows)
    collect = kind.collect

    def counted(df):
        sent.append(collect(df))
        return sent[-1]

    for split in (Split(20), Split(2)):
        monkeypatch.setattr(kind, "collect", counted)
        o = Ordered(rows, ["k"], ["o", "i"], split).running(s=("sum", F.col("v")), m=("max", F.col("v"))).last_seen("before", F.col("v"))
        back = Ordered(rows, ["k"], ["o", "i"], split, lookback=5)
        last = back.add(five=F.sum("v").over(back.frame(5))).result()
        assert max(map(len, sent)) <= 4 and o.cut and back.cut
        monkeypatch.setattr(kind, "collect", collect)
        plain = Ordered(rows, ["k"], ["o", "i"]).running(s=("sum", F.col("v")), m=("max", F.col("v"))).last_seen("before", F.col("v"))
        whole = Ordered(rows, ["k"], ["o", "i"], lookback=5)
        assert texts(o.result()) == texts(plain.result())
        assert texts(last) == texts(whole.add(five=F.sum("v").over(whole.frame(5))).result())


def test_duplicates_and_ranges_with_many_hot_keys(spark, many):
    rows = spark.range(900).selectExpr("id % 50 as source", "id as available_at", "concat('d', id % 3) as document")
    assert texts(pit.classify_duplicates(rows, ["source"], ["available_at"], split=Split(2))) == texts(pit.classify_duplicates(rows, ["source"], ["available_at"]))
    r = Ordered(rows, ["source"], ["available_at"], Split(3), lookback_range=120)
    w = Ordered(rows, ["source"], ["available_at"], lookback_range=120)
    count = [F.count("document").over(x.window().rangeBetween(-120, 0)) for x in (r, w)]
    assert texts(r.add(n=count[0]).result()) == texts(w.add(n=count[1]).result())


def test_sums_are_read_again_instead_of_written(spark, tmp_path, monkeypatch):
    spark.range(500).selectExpr("0 as k", "id * 7 % 500 as o", "id % 9 as v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    want = texts(Ordered(df, ["k"], ["o"]).running(s=("sum", F.col("v"))).result())
    monkeypatch.setattr(ordered, "cut_lineage", lambda rows: pytest.fail("written"))
    o = Ordered(df, ["k"], ["o"], Split(30), again=df).running(s=("sum", F.col("v")))
    assert o.cut and texts(o.result()) == want


def odd_ledger(seed, odd):
    r, rows, seq = random.Random(seed), [], 0
    for i in range(150):
        account, mint = r.choice([0, 1, None] if odd else [0, 1]), f"m{r.randint(0, 5)}"
        side = r.choice(["BUY", "SELL"])
        ident = r.choice([f"i{i}", f"i{i}", "i3", None if odd else "i4"])
        for kind in ("intent", r.choice(["settlement", "cancel", "none", "reject", "settlement"])):
            if kind == "none" or r.random() < 0.1:
                continue
            seq += 1
            other = kind != "intent"
            pointed = r.choice([ident, ident, ident, None]) if other else ("i9" if odd and r.random() < 0.1 else None)
            q = r.randint(1, 400)
            rows.append((account, seq, f"x{seq}" if other else ident, kind, pointed, r.choice([side, None]) if other else side, mint if r.random() < 0.9 else "m9", r.randint(1, 3),
                         q if kind == "settlement" and side == "BUY" else None, q if kind == "settlement" and side == "SELL" else None, seq if not other else None, seq if other else None))
    return rows


SCHEMA = "account int, seq long, id string, kind string, intent_id string, side string, mint string, base_units long, quote_spent long, quote_received long, decision_slot long, quote_slot long"


def brute(rows):
    """Accounts: pending intents, cash and the target to follow, from the rows one by one."""
    out = {}
    for account in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == account), key=lambda r: r[1])
        keys = {(r[2] if r[3] == "intent" else r[4]) for r in own}
        done = {r[4] for r in own if r[3] in ("settlement", "cancel")}
        pending = sum(any(r[3] == "intent" and r[2] == k for r in own) and k not in done for k in keys)
        last, held, cash = {}, {}, 1000
        for r in own:
            k = r[4] if r[4] is not None else r[2]
            if r[3] == "settlement":
                before = last.get(k)
                side, mint = (before[5] if before and before[5] is not None else r[5]), (before[6] if before and before[6] is not None else r[6])
                held[mint] = (side, r)
                cash += (r[9] or 0) - (r[8] or 0)
            if r[3] in ("intent", "settlement", "cancel") and k is not None:
                last[k] = r
        wait = [r for r in own if r[3] == "intent" and (r[2] is None or account is None or r[2] not in done)]
        opened = [(r[1], m, r[11]) for m, (side, r) in held.items() if side == "BUY"]
        target = ("PENDING_" + wait[0][5], wait[0][6], wait[0][10]) if wait else ("OPEN_POSITION", min(opened)[1], min(opened)[2]) if opened else None
        out[account] = (pending, cash if account is not None else 1000, len(opened) if account is not None else 0, target)
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_states_and_targets_of_odd_ledgers(spark, odd):
    for seed in range(2):
        rows = odd_ledger(seed, odd)
        df, want = spark.createDataFrame(rows, SCHEMA), brute(rows)
        for split in (Split(), Split(20)):
            states = {r["account"]: (r["pending"], r["cash"], r["positions"]) for r in L.ledger_state(df, 1000, split=split).collect()}
            assert states == {a: w[:3] for a, w in want.items()}
            targets = {r["account"]: (r["phase"], r["mint"], r["after_slot"]) for r in L.follow_targets(df, split=split).collect()}
            assert targets == {a: w[3] for a, w in want.items() if w[3]}


def test_intents_are_dealt_out_once(spark):
    df = spark.createDataFrame(odd_ledger(5, False), SCHEMA)
    for out, most in ((L.ledger_state(df, 1000), 5), (L.follow_targets(df), 3), (L.ledger_rows(df, 1000).select("seq", "violation"), 3)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert len(dealt) <= most and sum("__i#" in line for line in dealt) == 1


def test_segments_are_found_by_halving(spark):
    for n in (0, 1, 2, 3, 7, 8, 100, 1000):
        starts = list(range(5, 5 + 3 * n, 3))
        df = spark.range(0, 3 * n + 12).select("id", F.array(*[F.struct(F.lit(x).cast("bigint").alias("id")) for x in starts]).cast("array<struct<id:bigint>>").alias("__starts"),
                                               F.array(*[F.lit(x) for x in ordered._steps(n)]).cast("array<int>").alias("__steps"))
        got = {r[0]: r[1] for r in df.select("id", ordered._segment(F.struct("id"))).collect()}
        assert got == {i: sum(x <= i for x in starts) for i in range(3 * n + 12)} and len(ordered._steps(n)) <= 10
