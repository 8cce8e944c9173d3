from fractions import Fraction
from random import Random

from conftest import rows_of
from pyspark.sql import functions as F

from tidemark.functions import exact as X
from tidemark.operators import features as W
from tidemark.operators import rules as R
from tidemark.operators.ordered import Split

SEC = 1_000_000_000
SCHEMA = "pool string, seq bigint, slot bigint, availability_ns bigint, event_time bigint, wallet string, kind string, instruction string, base_raw bigint, quote_raw bigint"


def stream(spark, prices, pool="p", step=SEC, start=100):
    rows = [(pool, n, start + n, (n + 1) * step, 1000 + n, f"w{n % 3}", "swap", "sell" if n % 2 else "buy", 100, p) for n, p in enumerate(prices)]
    return spark.createDataFrame(rows, SCHEMA)


def trunc(x):
    return int(x)


def test_market_features_equal_fractions(spark):
    rnd = Random(7)
    rows = []
    for pool in "abc":
        t = 0
        for n in range(60 if pool == "a" else 9):
            t += rnd.randint(0, 3) * SEC
            kind = rnd.choice(["swap", "swap", "swap", "pool_created", "failed"])
            rows.append((pool, len(rows), len(rows), t, 1000 + n, "w", kind, rnd.choice(["buy", "sell"]), rnd.randint(1, 50), rnd.randint(1, 900)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for split in (Split(), Split(8)):
        got = {r["seq"]: r for r in rows_of(W.market_features(df, 16, split))}
        for pool in "abc":
            mine = sorted([r for r in rows if r[0] == pool], key=lambda r: (r[3], r[1]))
            for i, r in enumerate(mine):
                if r[6] != "swap":
                    continue
                win = [x for x in mine[max(0, i - 15):i + 1] if x[6] == "swap"]
                prices = [Fraction(x[9], x[8]) for x in win]
                g = got[r[1]]
                buy = sum(x[9] for x in win if x[7] == "buy")
                total = sum(x[9] for x in win)
                assert (g["swaps"], g["buy_flow"], g["volume"]) == (len(win), buy, total)
                assert g["imbalance_bps"] == trunc(Fraction(2 * buy - total, total) * 10000)
                changes = [trunc((b / a - 1) * 10000) for a, b in zip(prices, prices[1:])]
                assert g["momentum_bps"] == (trunc((prices[-1] / prices[0] - 1) * 10000) if changes else None)
                assert g["volatility_mean_abs_return_bps"] == (sum(map(abs, changes)) // len(changes) if changes else None)
                assert g["momentum_acceleration_bps"] == (changes[-1] - changes[-2] if len(changes) > 1 else None)
                span = win[-1][3] - win[0][3]
                if len(win) >= 3 and span > 0:
                    older = sum(x[9] for x in win if x[3] <= win[0][3] + span // 2)
                    want = (total - 2 * older) * 4e18 / span**2
                    assert abs(g["volume_acceleration"] - want) <= 1e-9 * abs(want)
                else:
                    assert g["volume_acceleration"] is None


def test_unknown_is_null_never_zero(spark):
    one = rows_of(W.market_features(stream(spark, [5])))[0]
    assert one["swaps"] == 1 and one["momentum_bps"] is None and one["volume_velocity"] is None and one["pool_age_seconds"] is None
    s = rows_of(R.opportunity_scores(spark.sql("select 1L id, cast(null as bigint) momentum_bps, 5L imbalance_bps, 1L quote_reserve, 1L base_reserve, 1L quote_age_ns, 1L quote_impact_bps")))[0]
    assert s["market_score"] is None and s["opportunity_score"] is None and s["missing_required"] == ["momentum_bps"] and s["quality_score"] == 8333


def test_reversal_context(spark):
    f = W.context_features(W.context_window(stream(spark, [100, 120, 115, 110]), 60 * SEC))
    last = rows_of(R.context_regime(W.context_completeness(f.withColumn("momentum_acceleration_bps", F.lit(0)), required=())).where("seq = 3"))[0]
    assert last["momentum_short_bps"] == -833 and last["momentum_medium_bps"] == 1000 and last["required_missing"] == []
    assert last["anomalies"] == ["short_medium_momentum_conflict"] and last["labels"] == ["REVERSAL_RISK", "HIGH_VOLATILITY", "STABLE"]
    assert last["recent_drawdown_bps"] == -833 and last["maximum_gap_ns"] == SEC


def test_context_window_is_bounded_in_time_and_exact_volatility_agrees(spark):
    w = W.context_window(stream(spark, [100, 101, 99, 104], step=30 * SEC), 60 * SEC)
    assert [r["n"] for r in rows_of(w.orderBy("seq").select(F.size("samples").alias("n")))] == [1, 2, 3, 3]
    fast = rows_of(W.context_features(w).select("seq", "realized_volatility_bps").orderBy("seq"))
    assert fast == rows_of(W.context_features(w, exact=True).select("seq", "realized_volatility_bps").orderBy("seq"))


def test_zero_amount_is_refused(spark):
    got = rows_of(W.normalize_swap(stream(spark, [7, 0])).orderBy("seq").select("side", "price", "reject"))
    assert got[0]["reject"] is None and got[1] == {"side": "sell", "price": None, "reject": "zero_swap_amount"}
    assert W.market_features(stream(spark, [7, 0])).count() == 1


def test_horizon_without_later_mark_stays_unknown(spark):
    got = rows_of(W.horizon_outcomes(stream(spark, [100, 110, 90]), (1, 2, 3)).orderBy("horizon_seconds"))
    assert [r["return_bps"] for r in got] == [1000, -1000, None] and got[2]["status"] == "NOT_COLLECTED" and got[2]["observed_ns"] is None
    assert [r["delay_ns"] for r in got] == [0, 0, None]


def test_candidate_extrema_only_after_entry(spark):
    marks = stream(spark, [100, 300, 50, 80])
    entries = spark.createDataFrame([("p", 9, 2 * SEC, None), ("q", 8, SEC, None)], "pool string, entry_id bigint, entry_ns bigint, until_ns bigint")
    got = {r["entry_id"]: r for r in rows_of(W.candidate_extrema(marks, entries))}
    assert (float(got[9]["minimum"]), float(got[9]["maximum"]), got[9]["samples"]) == (0.5, 0.8, 2)
    assert got[8]["classification"] == "UNKNOWN" and got[8]["minimum"] is None


def test_percentile_tails_need_samples(spark):
    s = spark.range(1, 100).select(F.lit("a").alias("stage"), F.col("id").alias("ns")).unionByName(spark.range(1, 4).select(F.lit("b").alias("stage"), F.col("id").alias("ns")))
    got = {r["stage"]: r for r in rows_of(W.latency_percentiles(s))}
    assert (got["a"]["p50_ns"], got["a"]["p95_ns"], got["a"]["p99_ns"]) == (50, 95, None) and (got["b"]["p50_ns"], got["b"]["p95_ns"]) == (2, None)


def test_wide_amounts_become_unknown_and_exact_mode_has_no_limit(spark):
    big = 2**64 - 1
    df = spark.createDataFrame([(str(big), "1", str(big - 1), "1")], "q string, b string, q0 string, b0 string")
    wide = [F.col(c).cast("decimal(20,0)") for c in ("q", "b", "q0", "b0")]
    r = df.select(X.return_bps(*wide).alias("fast"), X.bps_exact("q", "b", "q0", "b0").alias("exact"), X.ratio_exact("q", F.lit("3")).alias("ratio")).first()
    assert r["fast"] == 0 and r["exact"] == 0 and r["ratio"]["denominator"] == "1"
    huge = spark.createDataFrame([(str(big), str(big), "1", str(big))], "q string, b string, q0 string, b0 string")
    wide = [F.col(c).cast("decimal(20,0)") for c in ("q", "b", "q0", "b0")]
    assert huge.select(X.return_bps(*wide).alias("fast")).first()["fast"] is None


def test_floor_and_truncation(spark):
    r = spark.range(1).select(X.div_floor(F.lit(-7), F.lit(2)).alias("f"), X.div_trunc(F.lit(-7), F.lit(2)).alias("t"), X.clip(F.lit(None).cast("bigint"), 0, 10).alias("c"), X.div_trunc(F.lit(1), F.lit(0)).alias("z")).first()
    assert (r["f"], r["t"], r["c"], r["z"]) == (-4, -3, None, None)
