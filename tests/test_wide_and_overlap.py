"""Amounts near 2^64, positions that overlap, clashes of ids that depend on each other."""

from collections import Counter
from fractions import Fraction
from random import Random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_pit import REC, fold

from tidemark.functions import exact as X
from tidemark.operators import evidence, features, pit
from tidemark.operators.intervals import interval_extrema
from tidemark.operators.ordered import Split

U64 = 2**64 - 1
WIDE = "pool string, seq bigint, slot bigint, availability_ns bigint, event_time bigint, wallet string, kind string, instruction string, base_raw decimal(20,0), quote_raw decimal(20,0)"


def bps(q, b, q0, b0):
    return int((Fraction(q, b) / Fraction(q0, b0) - 1) * 10000)


def amount(r):
    return r.choice([r.randint(1, U64), U64 - r.randint(0, 9), r.randint(1, 1000), 10 ** r.randint(0, 19), 2 ** r.randint(0, 63)])


def test_returns_and_prices_of_any_64_bit_amounts(spark):
    r = Random(1)
    rows = [tuple(amount(r) for _ in range(4)) for _ in range(4000)] + [(U64, U64 - 1, U64 - 1, U64 - 2), (0, 5, 3, 4), (U64, 1, 1, U64)]
    df = spark.createDataFrame([tuple(map(str, x)) for x in rows], "q string, b string, q0 string, b0 string")
    q, b, q0, b0 = (F.col(c).cast("decimal(20,0)") for c in df.columns)
    got = df.select("*", X.return_bps(q, b, q0, b0).alias("r"), X.price_key(q, b).alias("k"), X.price_key(q0, b0).alias("k0")).collect()
    for g in got:
        x = list(map(int, g[:4]))
        want = bps(*x)
        assert g["r"] == (want if abs(want) < 2**63 else None)
        one, two = Fraction(x[0], x[1]), Fraction(x[2], x[3])
        assert (tuple(g["k"]) < tuple(g["k0"])) == (one < two) and (g["k"] == g["k0"]) == (one == two)
    empty = spark.createDataFrame([(None, "1", "1", "1"), ("1", "0", "1", "1"), ("1", "1", "0", "1"), ("1", "1", "1", None)], "q string, b string, q0 string, b0 string")
    assert [x[0] for x in empty.select(X.return_bps(q, b, q0, b0)).collect()] == [None] * 4


def test_falls_of_wide_prices_are_known(spark):
    rows = [("p", i, i, i, i, "w", "swap", "buy", 4 * 10**18, q) for i, q in enumerate([8 * 10**18, 4 * 10**18, 6 * 10**18], 1)]
    df = spark.createDataFrame([(*x[:8], *map(_decimal, x[8:])) for x in rows], WIDE)
    got = [(r["fall_bps"], r["drawdown_bps"]) for r in features.drawdown(df).orderBy("seq").collect()]
    assert got == [(0, 0), (-5000, -5000), (-2500, -5000)]


def _decimal(x):
    from decimal import Decimal

    return Decimal(x)


def wide_stream(r, pools="ab", n=60):
    rows, t = [], 0
    for i in range(n):
        t += r.randint(0, 3) * 1_000_000_007
        rows.append((r.choice(pools), i, i, t, 1000 + i, "w", r.choice(["swap", "swap", "swap", "failed"]), r.choice(["buy", "sell"]), r.randint(U64 // 3, U64), r.randint(U64 // 2, U64)))
    return rows


@pytest.mark.parametrize("split", [Split(), Split(9)])
def test_exact_market_features(spark, split):
    rows = wide_stream(Random(4))
    df = spark.createDataFrame([(*x[:8], *map(_decimal, x[8:])) for x in rows], WIDE).repartition(4)
    got = {r["seq"]: r for r in rows_of(features.market_features(df, 16, split, exact=True))}

    def text(f):
        return None if f is None else {"numerator": str(f.numerator), "denominator": str(f.denominator)}

    for pool in "ab":
        mine = [r for r in rows if r[0] == pool]
        for i, r in enumerate(mine):
            if r[6] != "swap":
                continue
            win = [x for x in mine[max(0, i - 15): i + 1] if x[6] == "swap"]
            g, p = got[r[1]], [Fraction(x[9], x[8]) for x in win]
            buy, total, n = sum(x[9] for x in win if x[7] == "buy"), sum(x[9] for x in win), len(win)
            assert (int(g["buy_flow"]), int(g["volume"])) == (buy, total) and g["price"] == text(p[-1])
            assert g["imbalance_bps"] == int(Fraction(2 * buy - total, total) * 10000)
            changes = [int((b / a - 1) * 10000) for a, b in zip(p, p[1:])]
            assert g["volatility_mean_abs_return_bps"] == (sum(map(abs, changes)) // len(changes) if changes else None)
            assert g["momentum_bps"] == (int((p[-1] / p[0] - 1) * 10000) if changes else None)
            span = win[-1][3] - win[0][3]
            moving = n >= 2 and span > 0
            older = sum(x[9] for x in win if x[3] <= win[0][3] + span // 2)
            assert g["volume_velocity"] == text(Fraction(total, span) * 10**9 if moving else None)
            assert g["transaction_velocity"] == text(Fraction(n, span) * 10**9 if moving else None)
            assert g["volume_acceleration"] == text(Fraction((total - 2 * older) * 4 * 10**18, span**2) if moving and n >= 3 else None)


def test_exact_context_and_wide_windows(spark):
    rows = wide_stream(Random(6), "a", 30)
    df = spark.createDataFrame([(*x[:8], *map(_decimal, x[8:])) for x in rows], WIDE)
    w = features.context_window(df, 10**18, 8)
    got = {r["seq"]: r for r in rows_of(features.context_features(w, exact=True))}
    for i, r in enumerate(rows):
        if r[6] != "swap":
            continue
        win = [x for x in rows[max(0, i - 7): i + 1] if x[6] == "swap"]
        p = [Fraction(x[9], x[8]) for x in win]
        g = got[r[1]]
        returns = [b / a - 1 for a, b in zip(p, p[1:])]
        assert (g["returns"] or []) == [{"numerator": str(x.numerator), "denominator": str(x.denominator)} for x in returns]
        worst, peak = 0, p[0]
        for x in p:
            peak = max(peak, x)
            worst = min(worst, int((x / peak - 1) * 10000))
        assert g["recent_drawdown_bps"] == (worst if len(win) > 1 else None)


def test_flows_of_two_wide_swaps(spark):
    rows = [("p", i, i, i, i, "w", "swap", "buy", 5, 5 * 10**18) for i in (1, 2)]
    df = spark.createDataFrame(rows, WIDE.replace("decimal(20,0)", "bigint"))
    assert [int(r["volume"]) for r in features.market_features(df).orderBy("seq").collect()] == [5 * 10**18, 10**19]
    assert [int(r["half_window_volume_change_raw"]) for r in features.opportunity_features(df).orderBy("seq").collect()] == [5 * 10**18, 0]


@pytest.mark.parametrize("split, block", [(Split(), 4), (Split(25), 4), (Split(), 128)])
def test_interval_extrema(spark, split, block):
    r = Random(8)
    marks = [(r.choice("ab") if i % 3 else "a", r.randint(0, 60), i, r.randint(1, 50), r.randint(1, 50)) for i in range(300)]
    spans = [(r.choice("abc"), i, (a := r.randint(-5, 65)), r.choice([None, a + r.randint(-3, 70)])) for i in range(120)]
    m = spark.createDataFrame(marks, "pool string, availability_ns bigint, seq bigint, quote_raw bigint, base_raw bigint").repartition(3)
    s = spark.createDataFrame(spans, "pool string, interval_id bigint, from_ns bigint, until_ns bigint").repartition(3)
    got = {x["interval_id"]: x for x in rows_of(interval_extrema(m, s, "pool", split, block))}
    assert len(got) == len(spans)
    for pool, i, a, b in spans:
        inside = sorted((t, n, Fraction(q, p)) for k, t, n, q, p in marks if k == pool and a < t and (b is None or t <= b))
        g = got[i]
        assert g["samples"] == len(inside)
        for name, want in (("lo", min), ("hi", max)):
            assert (None if g[name] is None else Fraction(g[name]["quote_raw"], g[name]["base_raw"])) == (want(x[2] for x in inside) if inside else None)
        assert (None if g["last"] is None else Fraction(g["last"]["quote_raw"], g["last"]["base_raw"])) == (inside[-1][2] if inside else None)


def test_marks_serve_every_open_position(spark):
    marks = spark.createDataFrame([("p", n, n, n * 10, n, "w", "swap", "buy", 100, q) for n, q in enumerate([90, 100, 300, 50, 80, 70, 200, 60, 65, 75], 1)], WIDE.replace("decimal(20,0)", "bigint"))
    entries = spark.createDataFrame([("p", 1, 0, None), ("p", 2, 55, 85), ("p", 3, 200, None)], "pool string, entry_id bigint, entry_ns bigint, until_ns bigint")
    got = {r["entry_id"]: (r["samples"], r["minimum"] and float(r["minimum"]), r["maximum"] and float(r["maximum"])) for r in features.candidate_extrema(marks, entries).collect()}
    assert got == {1: (10, 0.5, 3.0), 2: (3, 0.6, 2.0), 3: (0, None, None)}


def test_health_of_overlapping_positions(spark):
    marks = spark.createDataFrame([("p", n, n, n * 10, n, "w", "swap", "buy", 100, q) for n, q in enumerate([90, 100, 300, 50], 1)], WIDE.replace("decimal(20,0)", "bigint"))
    entries = spark.createDataFrame([("p", 1, 5, 100, 100, 1000, 90, "T", "N", "first"), ("p", 2, 25, 200, 100, 1000, 180, "T", "N", "second")],
                                    "pool string, entry_id bigint, entry_ns bigint, entry_quote_raw bigint, units bigint, entry_reserve bigint, cost bigint, token string, quote_mint string, thesis string")
    a = [(11, 1, "p", 40, -300, -5, 1, 700, 100, True, True, [], [], 7), (12, 1, "p", 40, 5, 5, 1, 900, 90, False, True, [], ["stale"], 8),
         (13, 1, "p", 50, -300, -5, 1, 700, 130, True, True, [], [], 9), (14, 2, "p", 40, 5, 5, 1, None, 10, True, True, ["history.continuity", "quote_age_ns"], [], 7), (15, 2, "p", 20, 5, 5, 1, 900, 10, True, False, None, None, None)]
    analyses = spark.createDataFrame(a, "analysis_id bigint, entry_id bigint, pool string, as_of bigint, momentum_bps bigint, imbalance_bps bigint, acceleration_bps bigint, quote_reserve bigint, quote_impact_bps bigint,"
                                        " risk_allowed boolean, evidence_proven boolean, required_missing array<string>, risk_reasons array<string>, exit_frame bigint")
    quotes = spark.createDataFrame([(7, "T", "N", 100, 210, 205, 38), (8, "T", "N", 99, 210, 205, 38), (9, "T", "N", 100, 300, 280, 10)],
                                   "frame bigint, input_mint string, output_mint string, input_raw bigint, output_raw bigint, minimum_raw bigint, observed_ns bigint")
    h = {r["analysis_id"]: r for r in rows_of(evidence.position_health(analyses, marks, entries, quotes=quotes, ttl_ns=20, fee=5))}
    assert (h[11]["observed_samples"], h[11]["return_since_entry_bps"], h[11]["mae_observed_bps"], h[11]["mfe_observed_bps"], h[11]["drawdown_from_peak_bps"]) == (4, -5000, -5000, 20000, -8333)
    assert (h[14]["observed_samples"], h[14]["mae_observed_bps"], h[14]["mfe_observed_bps"]) == (2, -7500, 5000)
    assert (h[11]["position_age_ns"], h[13]["exit_impact_change_bps"], h[11]["exit_impact_change_bps"], h[15]["position_age_ns"], h[15]["observed_samples"]) == (35, 40, None, None, None)
    assert h[11]["signals"] == ["momentum_and_flow_deterioration", "liquidity_deterioration", "execution_deterioration"]
    # the analysis before 13 is the last one of an earlier time, 12, whose signals are few
    assert (h[11]["persistent"], h[13]["persistent"], h[11]["reasons"]) == (False, False, ["joint_deterioration_not_persistent"])
    assert (h[12]["action"], h[12]["reasons"]) == ("VETO", ["stale"])
    assert h[14]["missing"] == ["context:history.continuity", "quote_reserve"] and h[14]["reasons"] == ["missing:context:history.continuity", "missing:quote_reserve"]
    assert h[15]["reasons"] == ["evidence_not_proven"] and (h[11]["entry_thesis"], h[14]["entry_thesis"]) == ("first", "second")
    assert (h[11]["exit_quote_status"], int(h[11]["indicative_exit_result_raw"])) == ("PROVEN", 205 - 5 - 90)
    assert [h[i]["exit_quote_status"] for i in (12, 13, 15)] == ["UNKNOWN"] * 3 and h[12]["indicative_exit_result_raw"] is None
    again = rows_of(evidence.position_health(analyses.where("analysis_id in (11, 13)"), marks, entries))
    assert {r["analysis_id"]: (r["persistent"], r["action"], r["reasons"] == r["signals"]) for r in again} == {11: (False, "HOLD", False), 13: (True, "EXIT_CANDIDATE", True)}


def test_many_clashes_in_a_few_waves(spark):
    """Ten thousand ids are claimed twice in one source: once by their own chain and once by a long one."""
    rows = [(i, "s", f"id{i}", f"l{i}", "swap", 0, None, False, "d") for i in range(10_000)]
    rows += [(20_000 + i, "s", f"id{i}", "long" if i % 2 else f"m{i}", "swap", 0 if i % 2 == 0 or i == 1 else 1, None if i % 2 == 0 or i == 1 else "id1", False, f"e{i % 3}") for i in range(10_000)]
    df = spark.createDataFrame(rows, REC)
    accepted, waves = pit.settle_revisions(df)
    assert waves <= 3 and {r[0] for r in accepted.collect()} == set(range(10_000))
    got = {r["capture_id"]: (r["status"], r["reason"]) for r in rows_of(pit.validate_revisions(df))}
    assert got == fold(rows)


def test_clashes_that_depend_on_each_other(spark):
    """A refused row frees the id that refused the next one, along a staircase of chains."""
    rows, c = [], 0
    for k in range(5):
        for own, rev, sup in ((f"a{k}", 0, None), (f"a{k + 1}", 1, f"a{k}")):
            rows.append((c, "s", own, f"l{k}", "swap", rev, sup, False, f"d{k}"))
            c += 1
    r = Random(2)
    for c in range(100, 260):
        rev = r.randint(0, 3)
        rows.append((c, r.choice("tu"), f"x{r.randint(0, 25)}", r.choice("abcdef"), "swap", rev, f"x{r.randint(0, 25)}" if rev else None, False, f"d{r.randint(0, 1)}"))
    df = spark.createDataFrame(rows, REC).repartition(5)
    got = {r["capture_id"]: (r["status"], r["reason"]) for r in rows_of(pit.validate_revisions(df))}
    assert got == fold(rows)
    assert Counter(s for s, _ in got.values())["quarantined"] > 10
