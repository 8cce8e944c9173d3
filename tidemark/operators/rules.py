"""Regimes, weighted scores, decision rules and risk vetoes over feature columns.

A feature that is not fresh is null here; null never counts as zero and blocks a score.
Thresholds are parameters, so no rule table is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import change_bps, clip, div_floor
from .features import REQUIRED, flags


@dataclass(frozen=True)
class Thresholds:
    minimum_swaps: int = 3
    entry_score: int = 6000
    momentum_scale_bps: int = 200
    high_volatility_bps: int = 500
    low_liquidity_quote_raw: int = 1_000_000_000
    max_hold_ns: int = 60_000_000_000
    thesis_momentum_bps: int = -200


@dataclass(frozen=True)
class RiskPolicy:
    max_position: int = 1_000_000
    max_exposure: int = 2_000_000
    max_positions: int = 2
    min_liquidity: int = 10_000_000
    max_slippage_bps: int = 100
    max_session_loss: int = 100_000
    max_age_ns: int = 5_000_000_000
    max_heartbeat_age_ns: int = 5_000_000_000

    def __post_init__(self):
        if any(type(v) is not int or v <= 0 for v in vars(self).values()) or self.max_slippage_bps > 10000:
            raise ValueError("invalid risk policy")


def _known_false(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _trend(acc: Column) -> Column:
    return F.when(acc > 0, "ACCELERATING").when(acc < 0, "DECELERATING").when(acc == 0, "STABLE")


def compact(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def regime_labels(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    n, vol, liq = F.col("swaps"), F.col("volatility_mean_abs_return_bps"), F.col("quote_reserve")
    labels = compact(
        F.lit("ROTATION_UNKNOWN"),
        F.when(n.isNull() | (n < t.minimum_swaps), "LOW_ACTIVITY").when(n >= 16, "HIGH_ACTIVITY").otherwise("NORMAL"),
        F.when(vol >= t.high_volatility_bps, "HIGH_VOLATILITY"),
        F.when(liq < t.low_liquidity_quote_raw, "LIQUIDITY_STRESS"),
        _trend(F.col("momentum_acceleration_bps")),
    )
    reasons = flags([
        (vol >= t.high_volatility_bps, "observed_mean_abs_return_above_threshold"),
        (liq < t.low_liquidity_quote_raw, "observed_reserve_below_descriptive_threshold"),
    ])
    return df.withColumns({"labels": labels, "reasons": reasons})


def context_regime(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Trend labels of context rows (``required_missing``, ``anomalies`` from the completeness check)."""
    short, medium = F.col("momentum_short_bps"), F.col("momentum_medium_bps")
    trend = F.when(short.isNotNull() & medium.isNotNull(),
                   F.when((short > 0) & (medium > 0), "TRENDING_UP").when((short < 0) & (medium < 0), "TRENDING_DOWN")
                   .when(short * medium < 0, "REVERSAL_RISK").otherwise("QUIET"))
    lacking = F.size("required_missing") > 0
    labels = compact(
        F.when(lacking, "INSUFFICIENT_DATA").otherwise(trend),
        F.when(F.col("realized_volatility_bps") >= t.high_volatility_bps, "HIGH_VOLATILITY"),
        _trend(F.col("momentum_acceleration_bps")),
        F.when(F.array_contains("anomalies", "observed_liquidity_deterioration"), "LIQUIDITY_STRESS"),
    )
    empty = F.array().cast("array<string>")
    return df.withColumns({"labels": labels, "reasons": F.concat(F.when(lacking, F.col("required_missing")).otherwise(empty), F.col("anomalies"))})


def weighted_score(components) -> Column:
    """struct(value, missing): floor of the weighted mean of (name, normalized, weight) parts, null when any part is."""
    if sum(w for _, _, w in components) != 100:
        raise ValueError("weights must sum to 100")
    total = None
    for _, c, w in components:
        part = c.cast("bigint") * w
        total = part if total is None else total + part
    return F.struct(div_floor(total, F.lit(100)).alias("value"), flags([(c.isNull(), n) for n, c, _ in components]).alias("missing"))


def opportunity_scores(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """market 60/40, execution 60/40, quality, and their 50/30/20 combination."""
    m, imb, impact, age = (F.col(c) for c in ("momentum_bps", "imbalance_bps", "quote_impact_bps", "quote_age_ns"))
    momentum = clip(F.lit(5000) + div_floor(m.cast("bigint") * 5000, F.lit(t.momentum_scale_bps)), 0, 10000)
    flow = div_floor(imb.cast("bigint") + 10000, F.lit(2))
    cheap = F.when(impact.isNotNull(), F.greatest(F.lit(0), F.lit(10000) - impact.cast("bigint") * 100))
    young = F.when(age.isNotNull(), F.greatest(F.lit(0), F.lit(10000) - div_floor(age, F.lit(500000))))
    market = weighted_score([("momentum", momentum, 60), ("flow", flow, 40)])
    execution = weighted_score([("impact", cheap, 60), ("age", young, 40)])
    missing = flags([(F.col(k).isNull(), k) for k in REQUIRED])
    df = df.withColumns({"__m": market, "__e": execution, "missing_required": missing})
    quality = div_floor((F.lit(len(REQUIRED)) - F.size("missing_required")).cast("bigint") * 10000, F.lit(len(REQUIRED)))
    df = df.withColumns({"market_score": F.col("__m.value"), "execution_score": F.col("__e.value"), "quality_score": quality}).drop("__m", "__e")
    o = weighted_score([("market", F.col("market_score"), 50), ("execution", F.col("execution_score"), 30), ("quality", F.col("quality_score"), 20)])
    return df.withColumn("__o", o).withColumns({"opportunity_score": F.col("__o.value"), "score_missing": F.col("__o.missing")}).drop("__o")


def context_score(df: DataFrame) -> DataFrame:
    """Opportunity score with missing context blocking it, and its decomposition.

    ``decomposition`` has the parts with their weights (market 50, execution 30, quality 20), the inputs that carry no weight of their own
    (momentum, flow; liquidity is required evidence, risk an independent veto, so both weigh 0), and the final score.
    """
    lacking = F.size("required_missing") > 0
    df = df.withColumns({
        "opportunity_score": F.when(~lacking, F.col("opportunity_score")),
        "score_missing": F.when(lacking, F.array_sort(F.array_distinct(F.concat("score_missing", "required_missing")))).otherwise(F.col("score_missing")),
    })

    def part(value, weight: int | None = None) -> Column:
        value = F.col(value).cast("bigint")
        if weight is None:
            return value
        return F.struct(value.alias("value"), F.lit(weight).alias("weight"), (value * weight).alias("contribution_x100"))

    return df.withColumn("decomposition", F.struct(
        part("market_score", 50).alias("market"), part("execution_score", 30).alias("execution"), part("quality_score", 20).alias("quality"),
        part("momentum_bps").alias("momentum_bps"), part("imbalance_bps").alias("flow_bps"), part("quote_reserve", 0).alias("liquidity"),
        F.lit(0).alias("risk_weight"), part("opportunity_score").alias("final")))


ENTRY = ("enough_samples", "positive_momentum", "nonnegative_flow", "quality_complete", "score_threshold", "regime_not_high_volatility")


def _entry_conditions(t: Thresholds):
    return {
        "enough_samples": F.col("swaps") >= t.minimum_swaps,
        "positive_momentum": F.col("momentum_bps") > 0,
        "nonnegative_flow": F.col("imbalance_bps") >= 0,
        "quality_complete": F.size("missing_required") == 0,
        "score_threshold": F.col("opportunity_score") >= t.entry_score,
        "regime_not_high_volatility": ~F.array_contains("labels", "HIGH_VOLATILITY"),
    }


def _decide(df: DataFrame, conditions) -> DataFrame:
    df = df.withColumn("failed", flags([(~_known_false(c), name) for name, c in conditions.items()]))
    return df.withColumn("action", F.when(F.size("failed") == 0, "CANDIDATE_BUY").otherwise("NO_TRADE"))


def entry_rule(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Six named conditions; adds the failed ones and the action."""
    return _decide(df, _entry_conditions(t))


def context_entry_rule(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The entry rule plus a complete context and no contradictory momentum."""
    return _decide(df, {
        **_entry_conditions(t),
        "context_complete": F.size("required_missing") == 0,
        "momentum_not_contradictory": ~F.array_contains("anomalies", "short_medium_momentum_conflict"),
    })


def invalidation(t: Thresholds, momentum="momentum_bps", flow="imbalance_bps", liquidity_change="liquidity_change_bps", impact="quote_impact_bps"):
    """Thesis invalidation signals in reporting order."""
    return [
        ((F.col(momentum) <= t.thesis_momentum_bps) & (F.col(flow) < 0), "momentum_and_flow_deterioration"),
        (F.col(liquidity_change) <= -2000, "liquidity_deterioration"),
        (F.col(impact) >= 100, "execution_deterioration"),
    ]


def exit_rule(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Open positions -> invalidated reasons, HOLD / REDUCE_CANDIDATE / EXIT_CANDIDATE, category and health score.

    Columns: momentum_bps, imbalance_bps, quote_reserve, entry_quote_reserve, quote_impact_bps, market_score,
    duration_ns, risk_allowed, risk_reasons.
    """
    df = df.withColumn("liquidity_change_bps", change_bps("quote_reserve", "entry_quote_reserve"))
    df = df.withColumn("invalidated", flags(invalidation(t)))
    n = F.size("invalidated")
    hard = ~_known_false(F.col("risk_allowed"))
    case = (
        F.when(hard, F.lit("EXIT_CANDIDATE|HARD_RISK_EXIT_REQUEST_REQUIRES_NEW_EVIDENCE_AND_RISK"))
        .when(n >= 2, "EXIT_CANDIDATE|THESIS_INVALIDATION")
        .when(F.array_contains("invalidated", "liquidity_deterioration"), "REDUCE_CANDIDATE|LIQUIDITY_DETERIORATION")
        .when(F.col("duration_ns") >= t.max_hold_ns, "EXIT_CANDIDATE|TIME_BASED_EXIT")
        .otherwise("HOLD|THESIS_NOT_INVALIDATED")
    )
    df = df.withColumn("__c", F.split(case, "\\|"))
    category = F.col("__c")[1]
    health = weighted_score([("market", F.col("market_score"), 60),
                             ("liquidity_change", clip(F.lit(10000) + F.col("liquidity_change_bps") * 2, 0, 10000), 40)])
    return df.withColumns({
        "action": F.col("__c")[0],
        "category": category,
        "reasons": F.when(hard, F.col("risk_reasons")).when(category == "TIME_BASED_EXIT", F.array(F.lit("maximum_thesis_horizon_reached")))
        .when(category == "THESIS_NOT_INVALIDATED", F.array(F.lit("insufficient_joint_invalidation"))).otherwise(F.col("invalidated")),
        "health_score": health["value"],
    }).drop("__c")


def risk_veto(df: DataFrame, p: RiskPolicy = RiskPolicy()) -> DataFrame:
    """All veto reasons (sorted) and whether the request is allowed; no strategy can override them.

    Columns: requested, kill, data_health, availability_ns, heartbeat_ns, coverage, authority_state, quote_status,
    exit_possible, quote_provenance, expires_ns, observed_ns, size_raw, liquidity_quote_raw, slippage_bps,
    exposure, positions, loss, now.
    """
    now, req = F.col("now"), F.col("requested")

    def stale(c, limit):
        c = F.col(c)
        return c.isNull() | (c > now) | (now - c > limit)

    size_bad = req.isNull() | (req <= 0)
    unproven = ~_known_false((F.col("quote_status") == "OBSERVED") & F.col("exit_possible")) | F.col("quote_provenance").isNull()
    liq, slip = F.col("liquidity_quote_raw"), F.col("slippage_bps")
    incoherent = F.lit(False)
    for c in ("exposure", "positions", "loss"):
        incoherent = incoherent | F.col(c).isNull() | (F.col(c) < 0)
    checks = [
        (size_bad, "invalid_size"),
        (~size_bad & (req > p.max_position), "position_limit"),
        (F.col("kill"), "kill_switch"),
        (~F.col("data_health").eqNullSafe("OBSERVED"), "data_health_unproven"),
        (stale("availability_ns", p.max_age_ns), "stale_or_future_data"),
        (stale("heartbeat_ns", p.max_heartbeat_age_ns), "heartbeat_missing_or_stale"),
        (~F.col("coverage").eqNullSafe("OBSERVED"), "coverage_incomplete"),
        (~F.col("authority_state").eqNullSafe("OBSERVED_SAFE"), "authority_unproven"),
        (unproven, "execution_quote_unproven"),
        (~unproven & (F.col("expires_ns").isNull() | (F.col("expires_ns") < now)), "quote_expired"),
        (~unproven & (F.col("observed_ns").isNull() | (F.col("observed_ns") > now)), "quote_from_future"),
        (~unproven & ~F.col("size_raw").eqNullSafe(req), "quote_size_mismatch"),
        (~unproven & (liq.isNull() | (liq < p.min_liquidity) | (liq < 0)), "liquidity_quote_raw_limit_or_missing"),
        (~unproven & (slip.isNull() | (slip < 0) | (slip > p.max_slippage_bps)), "slippage_bps_limit_or_missing"),
        (incoherent, "account_incoherent"),
        (~incoherent & (F.col("exposure") + F.coalesce(req, F.lit(0)) > p.max_exposure), "exposure_limit"),
        (~incoherent & (F.col("positions") >= p.max_positions), "positions_limit"),
        (~incoherent & (F.col("loss") >= p.max_session_loss), "session_loss_limit"),
    ]
    df = df.withColumn("risk_reasons", F.array_sort(F.array_distinct(flags(checks))))
    return df.withColumn("risk_allowed", F.size("risk_reasons") == 0)
