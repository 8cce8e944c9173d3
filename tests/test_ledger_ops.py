from conftest import rows_of
from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators import ops as O
from tidemark.operators import rules as R
from tidemark.operators import validate as P
from tidemark.operators.ordered import Split

LEDGER = "seq bigint, id string, kind string, intent_id string, side string, mint string, base_units bigint, quote_spent bigint, quote_received bigint"
TRIP = [
    (1, "b", "intent", None, "BUY", "m", None, None, None), (2, "settle:b", "settlement", "b", "BUY", "m", 406739, 12100000, None),
    (3, "s", "intent", None, "SELL", "m", None, None, None), (4, "settle:s", "settlement", "s", "SELL", "m", 406739, None, 7741241),
]


def test_golden_round_trip(spark):
    state = rows_of(L.ledger_state(spark.createDataFrame(TRIP, LEDGER), 1_000_000_000))[0]
    assert (state["cash"], state["realized_pnl"], state["loss"], state["positions"], state["pending"], state["violation"]) == (995641241, -4358759, 4358759, 0, 0, None)
    fills = spark.createDataFrame([("m", 2, "BUY", 12100000, 406739, 100), ("m", 4, "SELL", 7741241, 406739, 8210169300)], "mint string, seq bigint, side string, quote_raw bigint, base_units bigint, at bigint")
    c = rows_of(L.pair_cycles(fills, ["mint"], ["seq"]))[0]
    assert c["pnl"] == -4358759 and c["at"] - c["entry"]["at"] == 8210169200
    report = spark.createDataFrame([(10_000_000, 406739, 10_000_000, 406739, 406739, 9_841_241, 406739, 9_841_241, 0, 5, 4, 8210169200, 8210169205, 8210169204, 2_100_000, 2_100_000, 12_100_000, 7_741_241, 1_000_000_000)],
                                   "buy_decision_in long, buy_decision_out long, buy_settled_in long, buy_settled_out long, sell_decision_in long, sell_decision_out long, sell_settled_in long, sell_settled_out long, "
                                   "buy_decision_ns long, buy_settlement_ns long, buy_quote_ns long, sell_decision_ns long, sell_settlement_ns long, sell_quote_ns long, buy_fee long, sell_fee long, buy_spent long, sell_received long, cash_before long")
    r = rows_of(L.cycle_report(report))[0]
    assert (r["net"], r["fixed_fees"], r["gross_before_fixed_fees"], r["cash_after_sell"], r["holding_duration_ns"]) == (-4358759, 4200000, -158759, 995641241, 8210169200)


def test_impossible_ledger_rows_are_named(spark):
    rows = TRIP + [(5, "x", "settlement", "ghost", "SELL", "n", 1, None, 5), (6, "b2", "intent", None, "BUY", "m", None, None, None), (7, "y", "settlement", "b2", "BUY", "m", 1, 2_000_000_000, None), (8, "b3", "intent", None, "BUY", "q", None, None, None),
                   (9, "c", "cancel", "b3", None, None, None, None, None), (10, "z", "settlement", "b3", "BUY", "q", 1, 1, None), (11, "open", "intent", None, "BUY", "w", None, None, None)]
    df = spark.createDataFrame(rows, LEDGER)
    for split in (Split(), Split(3)):
        got = {r["id"]: r["violation"] for r in rows_of(L.ledger_rows(df, 1_000_000_000, split=split)) if r["violation"]}
        assert got == {"x": "settlement_without_intent", "y": "paper_cash_or_position", "z": "settlement_without_intent"}
    assert rows_of(L.ledger_state(df, 1_000_000_000))[0]["pending"] == 1
    assert rows_of(L.session_metrics(df))[0]["state"] == "PENDING_BUY"


def test_unknown_cost_blocks_the_total(spark):
    fills = spark.createDataFrame([("f", "BUY", 9, 2_100_000, 410_000, 406_739, None, "m", "0.001", 8)],
                                  "fill_id string, side string, available_at bigint, fee bigint, output_raw bigint, base_units bigint, quote_received bigint, output_mint string, impact string, quote_ns bigint")
    costs = L.cost_rows(fills)
    assert costs.count() == 11 and costs.where("mode = 'UNKNOWN' and amount is null").count() == 8
    assert rows_of(L.separate_total(costs))[0]["total"] == 2_100_000
    assert rows_of(L.separate_total(costs, as_of=5))[0]["violation"] == "cost_not_yet_available"
    open_ = costs.withColumn("amount", F.when(F.col("category") != "other", F.col("amount")))
    assert rows_of(L.separate_total(open_))[0] == {"fill_id": "f", "total": None, "violation": None}


def test_alert_incomplete_report_cannot_resolve(spark):
    obs = spark.createDataFrame([("s", 1, ["decoder_errors"], True), ("s", 2, [], False), ("s", 3, ["quota_exhausted"], False), ("s", 4, ["quota_exhausted"], True), ("t", 5, ["decoder_errors"], False)],
                                "source string, id bigint, codes array<string>, complete boolean")
    got = sorted((r["source"], r["id"], r["code"], r["state"]) for r in rows_of(O.alert_lifecycle(obs)))
    assert got == [("s", 1, "decoder_errors", "OPEN"), ("s", 3, "quota_exhausted", "OPEN"), ("s", 4, "decoder_errors", "RESOLVED"), ("t", 5, "decoder_errors", "OPEN")]
    assert sorted(tuple(r.values()) for r in rows_of(O.active_alerts(obs))) == [("s", "quota_exhausted"), ("t", "decoder_errors")]


def test_quota_breach_and_unreserved_usage(spark):
    policy = spark.createDataFrame([("q", 10, 100)], "quota string, requests bigint, units bigint")
    res = spark.createDataFrame([("q", n, f"k{n}", 30) for n in range(5)], "quota string, ord bigint, key string, units bigint")
    b = rows_of(O.quota_breaches(res, policy))[0]
    assert (b["ord"], b["used"]) == (3, 120)
    s = spark.createDataFrame([("k0", 10), ("k1", 40), ("zz", 1)], "key string, actual bigint")
    u = rows_of(O.quota_usage(policy, res, s))[0]
    assert (u["charged_units"], u["unsettled"], u["errors"], u["healthy"]) == (10 + 40 + 90, 3, 2, False)  # k1 above its reservation, zz without one
    assert {r["key"] for r in rows_of(O.settlement_check(res, s))} == {"k1", "zz"}


BASE_RISK = dict(requested=1000, kill=False, data_health="OBSERVED", availability_ns=10, heartbeat_ns=10, coverage="OBSERVED", authority_state="OBSERVED_SAFE", quote_status="OBSERVED", exit_possible=True, quote_provenance="f",
                 expires_ns=20, observed_ns=9, size_raw=1000, liquidity_quote_raw=10**9, slippage_bps=25, exposure=0, positions=0, loss=0, now=12)


def test_every_veto_alone(spark):
    one = {
        "invalid_size": {"requested": 0, "size_raw": 0}, "position_limit": {"requested": 1_000_001, "size_raw": 1_000_001}, "kill_switch": {"kill": True}, "data_health_unproven": {"data_health": "PARTIAL"}, "stale_or_future_data": {"availability_ns": 13},
        "heartbeat_missing_or_stale": {"heartbeat_ns": None}, "coverage_incomplete": {"coverage": None}, "authority_unproven": {"authority_state": "NOT_COLLECTED"}, "execution_quote_unproven": {"quote_status": None}, "quote_expired": {"expires_ns": 11},
        "quote_from_future": {"observed_ns": 13}, "quote_size_mismatch": {"size_raw": 999}, "liquidity_quote_raw_limit_or_missing": {"liquidity_quote_raw": None}, "slippage_bps_limit_or_missing": {"slippage_bps": 101}, "account_incoherent": {"loss": None},
        "exposure_limit": {"exposure": 1_999_500}, "positions_limit": {"positions": 2}, "session_loss_limit": {"loss": 100_000},
    }
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in BASE_RISK.items()) + ", name string"
    df = spark.createDataFrame([tuple({**BASE_RISK, **change}.values()) + (name,) for name, change in [("none", {}), *one.items()]], schema)
    got = {r["name"]: r["risk_reasons"] for r in rows_of(R.risk_veto(df))}
    assert got == {"none": [], **{k: [k] for k in one}}


def test_secret_is_found_plain_and_quoted(spark):
    df = spark.createDataFrame([("x" * 5000 + "a b+c!",), ("token=a%20b%2Bc%21&x",), ("nothing",), (None,)], "t string")
    assert [r["hit"] for r in rows_of(df.select(P.secret_echo("t", ["a b+c!", "no", ""]).alias("hit")))] == [True, True, False, False]


def test_overlapping_windows(spark):
    w = spark.createDataFrame([("p", 1, 0, 100), ("p", 2, 10, 20)], "pool string, window_id bigint, started_ns bigint, expires_ns bigint")
    d = spark.createDataFrame([("p", 7, 15), ("p", 8, 50), ("p", 9, 100), ("q", 6, 15)], "pool string, decision_id bigint, decision_ns bigint")
    assert {r["decision_id"]: r["window_id"] for r in rows_of(O.window_membership(d, w))} == {7: 1, 8: 1, 9: None, 6: None}
