"""Per-pool event features: row and range frames, prefix scans, forward-horizon outcomes.

Input rows carry pool, seq, availability_ns, slot, event_time, wallet, kind, instruction,
base_raw and quote_raw. Order is always (availability_ns, seq); event time never decides
visibility. Every operator cuts hot pools into segments (see ``ordered``).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import (WIDE, change_bps, div_floor, div_trunc, fraction, nearest_rank, price, price_key, return_bps, returns_exact,
                               rms_return_bps, wide)
from .intervals import interval_extrema
from .ordered import Ordered, Split, measured

ORDER = ("availability_ns", "seq")


def change_bps_of_flow(buy, sell, volume) -> Column:
    """trunc((buy - sell) * 10000 / volume) in 38 digits, which any sums of 64-bit amounts fit."""
    net = (wide(buy) - wide(sell)).cast(WIDE)
    return div_trunc(F.try_multiply(net, F.lit(10000).cast(WIDE)).cast(WIDE), wide(volume))


def is_swap() -> Column:
    return F.col("kind") == "swap"


def is_sample() -> Column:
    """A swap whose amounts give a price; ``normalize_swap`` reports the others."""
    return is_swap() & (F.col("base_raw") > 0) & (F.col("quote_raw") > 0)

SECOND = 1_000_000_000


def normalize_swap(events: DataFrame, base: str = "base_raw", quote: str = "quote_raw") -> DataFrame:
    """Side, price and a reject reason per swap; zero amounts are refused, other kinds pass through."""
    bad = is_swap() & ~F.coalesce((F.col(base) > 0) & (F.col(quote) > 0), F.lit(False))
    return events.withColumns(
        {
            "side": F.when(is_swap(), F.when(F.col("instruction") == "sell", "sell").otherwise("buy")),
            "price": F.when(is_swap() & ~bad, price(quote, base)),
            "reject": F.when(bad, "zero_swap_amount"),
        }
    )


def rolling_last_n(events: DataFrame, n: int = 64, split: Split = Split(), **aggregates: Column) -> DataFrame:
    """Aggregates over the last ``n`` events of the pool, the current one included."""
    if not 2 <= n <= 1024:
        raise ValueError("window must be between 2 and 1024 rows")
    o = Ordered(events, ["pool"], ORDER, split, lookback=n - 1)
    return o.add(**{name: agg.over(o.frame(n)) for name, agg in aggregates.items()}).result()


def late_flag(events: DataFrame, split: Split = Split()) -> DataFrame:
    """Flag events whose slot is lower than one seen before in the pool; nothing is dropped."""
    o = Ordered(events, ["pool"], ORDER, split).running(inclusive=False, top_slot=("max", F.col("slot")))
    return o.add(late=F.coalesce(F.col("slot") < F.col("top_slot"), F.lit(False))).result().drop("top_slot")


def first_seen_wallet(events: DataFrame) -> DataFrame:
    """Mark the first event of each (pool, wallet).

    The first rows are found by a combinable minimum and joined back on their own unique
    (pool, seq), so a wallet with very many events is never gathered anywhere.
    """
    first = (
        events.groupBy("pool", "wallet")
        .agg(F.min(F.struct(*ORDER)).alias("f"))
        .select("pool", F.col("f.seq").alias("seq"), F.lit(True).alias("__first"))
    )
    return (
        events.join(first, ["pool", "seq"], "left")
        .withColumn("new_wallet", F.coalesce("__first", F.lit(False)))
        .drop("__first")
    )


def pool_state(events: DataFrame, identity=("base_mint", "quote_mint")) -> DataFrame:
    """One row per pool: first/last observation, event count, top slot, creation time, identity conflict."""
    ident = [c for c in identity if c in events.columns]
    conflict = F.lit(False)
    for c in ident:
        conflict = conflict | (F.min(c) != F.max(c))
    created = F.when(F.col("kind") == "pool_created", F.struct(*ORDER, F.col("event_time")))
    return events.groupBy("pool").agg(
        F.min("availability_ns").alias("first_observed_ns"),
        F.max("availability_ns").alias("last_observed_ns"),
        F.count(F.lit(1)).alias("events"),
        F.max("slot").alias("last_slot"),
        F.max(created)["event_time"].alias("created_time"),
        conflict.alias("identity_conflict"),
    )


def _swaps(events: DataFrame) -> DataFrame:
    return events.where(is_sample())


def anchor_price(events: DataFrame, split: Split = Split()) -> DataFrame:
    """Swaps with the amounts of the pool's first swap beside them."""
    entry = F.struct(*ORDER, "quote_raw", "base_raw")
    o = Ordered(_swaps(events), ["pool"], ORDER, split).running(anchor=("min", entry))
    return (
        o.add(
            anchor_seq=F.col("anchor.seq"),
            anchor_ns=F.col("anchor.availability_ns"),
            anchor_quote=F.col("anchor.quote_raw"),
            anchor_base=F.col("anchor.base_raw"),
        )
        .result()
        .drop("anchor")
    )


def drawdown(events: DataFrame, split: Split = Split()) -> DataFrame:
    """Running worst price fall from the running peak, in basis points toward zero; exact for all 64-bit amounts."""
    entry = F.struct(price_key("quote_raw", "base_raw").alias("p"), "quote_raw", "base_raw")
    o = Ordered(_swaps(events), ["pool"], ORDER, split).running(peak=("max", entry))
    o.add(fall_bps=return_bps("quote_raw", "base_raw", "peak.quote_raw", "peak.base_raw"))
    return o.running(drawdown_bps=("min", F.col("fall_bps"))).result().drop("peak")


def horizon_outcomes(events: DataFrame, horizons=(60, 300, 1800, 3600, 86400), split: Split = Split()) -> DataFrame:
    """Per pool and horizon the first swap at or after first swap + horizon; null when none was seen."""
    split = measured(events, ["pool"], ORDER, split)
    swaps = drawdown(anchor_price(events, split), split)
    # one conditional minimum a horizon: a swap is one row, however many horizons there are
    value = F.struct(*ORDER, "quote_raw", "base_raw", "drawdown_bps")
    hs = sorted({int(h) for h in horizons})
    due = {h: F.col("anchor_ns") + F.lit(h * SECOND) for h in hs}
    first = [F.min(c).alias(c) for c in ("anchor_ns", "anchor_seq", "anchor_quote", "anchor_base")]
    pools = swaps.groupBy("pool").agg(*first, *[F.min(F.when(F.col("availability_ns") >= due[h], value)).alias(f"__m{h}") for h in hs])
    each = F.array(*[F.struct(F.lit(h).cast("bigint").alias("horizon_seconds"), due[h].alias("due_ns"), F.col(f"__m{h}").alias("m")) for h in hs])
    out = pools.select("pool", "anchor_seq", F.col("anchor_quote").alias("aq"), F.col("anchor_base").alias("ab"), F.inline(each))
    return out.select(
        "pool",
        "horizon_seconds",
        "due_ns",
        "anchor_seq",
        F.col("m.seq").alias("mark_seq"),
        F.col("m.availability_ns").alias("observed_ns"),
        (F.col("m.availability_ns") - F.col("due_ns")).alias("delay_ns"),
        return_bps("m.quote_raw", "m.base_raw", "aq", "ab").alias("return_bps"),
        F.col("m.drawdown_bps").alias("drawdown_bps"),
        F.when(F.col("m").isNull(), "NOT_COLLECTED").otherwise("OBSERVED").alias("status"),
    )


def decision_outcomes(decisions: DataFrame, marks: DataFrame, horizons=(5, 15, 30, 60, 300),
                      split: Split = Split()) -> DataFrame:
    """For every decision and horizon the first mark of its pool available at or after the due time.

    decisions: pool, decision_id, decision_ns, quote_raw, base_raw (null price = unknown).
    marks: pool, mark_id, availability_ns, quote_raw, base_raw.
    Due points and marks are merged into one ordered stream per pool and scanned backward,
    so the work is linear in (decisions x horizons + marks) and no pairs are formed.
    """
    hs = F.array(*[F.lit(int(h)).cast("bigint") for h in horizons])
    due = decisions.select(
        "pool", "decision_id", F.explode(hs).alias("horizon_seconds"), F.col("decision_ns"),
        F.col("quote_raw").cast("decimal(20,0)").alias("aq"), F.col("base_raw").cast("decimal(20,0)").alias("ab"),
    ).select(
        "pool",
        (F.col("decision_ns") + F.col("horizon_seconds") * F.lit(SECOND)).alias("t"),
        F.lit(0).alias("rank"),
        F.col("decision_id").alias("tie"),
        "horizon_seconds", "decision_id", "aq", "ab",
        F.lit(None).cast("struct<mark_id:bigint,availability_ns:bigint,q:decimal(20,0),b:decimal(20,0)>").alias("mark"),
    )
    seen = marks.where(F.col("quote_raw").isNotNull()).select(
        "pool",
        F.col("availability_ns").alias("t"),
        F.lit(1).alias("rank"),
        F.col("mark_id").alias("tie"),
        F.lit(None).cast("bigint").alias("horizon_seconds"),
        F.lit(None).cast("bigint").alias("decision_id"),
        F.lit(None).cast("decimal(20,0)").alias("aq"),
        F.lit(None).cast("decimal(20,0)").alias("ab"),
        F.struct(
            F.col("mark_id").cast("bigint").alias("mark_id"), F.col("availability_ns").cast("bigint").alias("availability_ns"),
            F.col("quote_raw").cast("decimal(20,0)").alias("q"), F.col("base_raw").cast("decimal(20,0)").alias("b"),
        ).alias("mark"),
    )
    # sizes are measured before a decision becomes a row for every horizon
    base = decisions.select("pool", F.col("decision_ns").alias("t")).unionByName(marks.select("pool", F.col("availability_ns").alias("t")))
    found = measured(base, ["pool"], "t", replace(split, rows=max(1, split.rows // (len(horizons) + 1))))
    o = Ordered(due.unionByName(seen), ["pool"], ["t", "rank", "tie"], found)
    o.last_seen("next", F.col("mark"), F.col("rank") == 1, descending=True)
    out = o.result().where(F.col("rank") == 0)
    ret = return_bps("next.q", "next.b", "aq", "ab")
    return out.select(
        "pool",
        "decision_id",
        "horizon_seconds",
        F.col("t").alias("due_ns"),
        F.col("next.mark_id").alias("mark_id"),
        F.col("next.availability_ns").alias("observed_ns"),
        ret.alias("return_bps"),
        F.when(ret.isNull(), "UNKNOWN").otherwise("DERIVED").alias("status"),
    )


def opportunity_features(events: DataFrame, n: int = 64, split: Split = Split()) -> DataFrame:
    """Window features of each swap over the last ``n`` swaps of its pool."""
    o = Ordered(_swaps(events), ["pool"], ORDER, split, lookback=n - 1)
    w = o.frame(n)
    amount = F.collect_list("quote_raw").over(w)
    o.add(
        swaps_observed=F.count(F.lit(1)).over(w),
        volume_quote_raw=F.sum(wide("quote_raw")).over(w).cast(WIDE),
        buy_count=F.count_if(F.col("instruction") != "sell").over(w),
        sell_count=F.count_if(F.col("instruction") == "sell").over(w),
        wallets_unique=F.size(F.collect_set("wallet").over(w)),
        fq=F.first("quote_raw").over(w),
        fb=F.first("base_raw").over(w),
        __amounts=amount,
    )
    half = F.expr("aggregate(slice(__amounts, 1, cast(swaps_observed div 2 as int)), cast(0 as decimal(38,0)), (a, x) -> cast(a + x as decimal(38,0)))")
    return (
        o.add(
            price_change_bps=return_bps("quote_raw", "base_raw", "fq", "fb"),
            half_window_volume_change_raw=(F.col("volume_quote_raw") - 2 * half).cast(WIDE),
        )
        .result()
        .drop("fq", "fb", "__amounts")
    )


def market_features(events: DataFrame, n: int = 64, split: Split = Split(), exact: bool = False) -> DataFrame:
    """Momentum, volatility, flow, rates and acceleration over the last ``n`` events before each swap.

    One shuffle on (pool, segment) serves every frame below. Rates describe the observed
    samples only. Missing inputs give null, never zero; a return beyond 64 bits is unknown, and so is
    the volatility of a window that holds one. Flows are decimal(38,0), which 64-bit amounts cannot fill. ``exact``: price, velocities and volume acceleration are
    reduced fractions (texts numerator and denominator) instead of doubles.
    """
    o = Ordered(events, ["pool"], ORDER, split, lookback=n - 1)
    o.last_seen("prev", F.struct("quote_raw", "base_raw"), is_sample())
    o.add(chg=F.when(is_sample(), return_bps("quote_raw", "base_raw", "prev.quote_raw", "prev.base_raw")))
    o.last_seen("prev_chg", F.col("chg"), is_sample())
    w = o.frame(n)
    sample = F.when(is_sample(), F.struct("availability_ns", "quote_raw", "base_raw", "chg", "prev_chg"))
    buy, sell = is_sample() & (F.col("instruction") != "sell"), is_sample() & (F.col("instruction") == "sell")
    zero = F.lit(0).cast(WIDE)
    o.add(
        swaps=F.count_if(is_sample()).over(w),
        buy_flow=F.sum(F.when(buy, wide("quote_raw")).otherwise(zero)).over(w).cast(WIDE),
        sell_flow=F.sum(F.when(sell, wide("quote_raw")).otherwise(zero)).over(w).cast(WIDE),
        abs_changes=F.sum(F.abs(wide("chg"))).over(w).cast(WIDE),
        known_changes=F.count("chg").over(w),
        head=F.first(sample, ignorenulls=True).over(w),
        tail=F.last(sample, ignorenulls=True).over(w),
        __samples=F.collect_list(F.when(is_sample(), F.struct(F.col("availability_ns").alias("t"), F.col("quote_raw").alias("q")))).over(w),
        __created=F.collect_list(F.when(F.col("kind") == "pool_created", F.col("event_time"))).over(w),
    )
    df = o.result().where(is_sample())
    df = df.withColumn("volume", (F.col("buy_flow") + F.col("sell_flow")).cast(WIDE)).withColumn(
        "span_ns", F.when(F.col("swaps") >= 2, F.col("tail.availability_ns") - F.col("head.availability_ns"))
    )
    two, three = F.col("swaps") >= 2, F.col("swaps") >= 3
    moving = two & (F.col("span_ns") > 0)
    # volume up to the middle of the observed span
    older = F.expr(
        "aggregate(filter(__samples, x -> x.t <= head.availability_ns + span_ns div 2), cast(0 as decimal(38,0)), (a, x) -> cast(a + x.q as decimal(38,0)))"
    )
    span = F.col("span_ns").cast("double")
    age = F.expr("element_at(filter(__created, x -> x <= event_time), -1)")
    moved = (F.col("volume") - 2 * older).cast(WIDE)
    inside = F.col("known_changes") - F.when(F.col("head.chg").isNotNull(), 1).otherwise(0) == F.col("swaps") - 1
    if exact:
        # the factor 4 * 10^18 of the acceleration would leave 38 digits: its zeros are appended as text
        rates = [
            fraction("quote_raw", "base_raw").alias("price"),
            F.when(moving, fraction("volume", "span_ns", 9)).alias("volume_velocity"),
            F.when(moving, fraction("swaps", "span_ns", 9)).alias("transaction_velocity"),
            F.when(moving & three, fraction(4 * moved, (wide("span_ns") * wide("span_ns")).cast(WIDE), 18)).alias("volume_acceleration"),
        ]
    else:
        rates = [
            F.when(moving, F.col("volume").cast("double") * 1e9 / span).alias("volume_velocity"),
            F.when(moving, F.col("swaps") * 1e9 / span).alias("transaction_velocity"),
            F.when(moving & three, moved.cast("double") * 4e18 / (span * span)).alias("volume_acceleration"),
        ]
    return df.select(
        *[c for c in events.columns],
        "swaps",
        "buy_flow",
        "sell_flow",
        "volume",
        change_bps_of_flow(F.col("buy_flow"), F.col("sell_flow"), F.col("volume")).alias("imbalance_bps"),
        F.when(two, return_bps("tail.quote_raw", "tail.base_raw", "head.quote_raw", "head.base_raw")).alias("momentum_bps"),
        F.when(
            two & inside,
            div_floor(F.col("abs_changes") - F.coalesce(F.abs(wide("head.chg")), zero), wide(F.col("swaps") - 1)),
        ).alias("volatility_mean_abs_return_bps"),
        *rates,
        F.when(three, F.col("tail.chg") - F.col("tail.prev_chg")).alias("momentum_acceleration_bps"),
        F.when(F.size(F.expr("filter(__created, x -> x <= event_time)")) > 0, F.col("event_time") - age).alias("pool_age_seconds"),
    )


def context_window(events: DataFrame, window_ns: int = 60 * SECOND, max_samples: int = 64,
                   split: Split = Split()) -> DataFrame:
    """Swaps with the array of swaps among the last ``max_samples`` events inside ``window_ns``.

    Each sample holds its gap, bps change and return against the sample before it.
    """
    o = Ordered(events, ["pool"], ORDER, split, lookback=max_samples - 1)
    o.last_seen("prev", F.struct("quote_raw", "base_raw", "availability_ns"), is_sample())
    o.last_seen("prev_slot", F.col("slot"))
    o.add(
        __item=F.struct(
            F.col("availability_ns").alias("t"),
            F.col("seq"),
            is_sample().alias("swap"),
            F.col("quote_raw").alias("q"),
            F.col("base_raw").alias("b"),
            (F.col("availability_ns") - F.col("prev.availability_ns")).alias("gap"),
            (F.col("slot") < F.col("prev_slot")).alias("slot_drop"),
            (
                F.col("quote_raw").cast("double") * F.col("prev.base_raw")
                / (F.col("base_raw").cast("double") * F.col("prev.quote_raw")) - 1
            ).alias("ret"),
        )
    )
    o.add(__list=F.collect_list("__item").over(o.frame(max_samples)))
    df = o.result().where(is_sample())
    inside = F.expr(f"filter(__list, x -> x.t >= availability_ns - {int(window_ns)}L)")
    return (
        df.withColumn("__in", inside)
        .withColumn("samples", F.expr("filter(__in, x -> x.swap)"))
        .withColumn("slot_disorder", F.expr("exists(slice(__in, 2, greatest(size(__in) - 1, 0)), x -> x.slot_drop)"))
        .drop("prev", "prev_slot", "__item", "__list", "__in")
    )


def context_features(windows: DataFrame, exact: bool = False) -> DataFrame:
    """Span, gaps, momenta, volatility, drawdown and activity acceleration of ``context_window`` rows.

    ``exact``: the volatility comes from fractions, ``returns`` holds the successive returns and ``activity_acceleration`` the
    rate, all as reduced fractions of any size (texts numerator and denominator).
    """
    df = windows.withColumns(
        {
            "observations": F.size("samples"),
            "__first": F.element_at("samples", 1),
            "__last": F.element_at("samples", -1),
            "__third": F.expr("try_element_at(samples, -3)"),
            "__later": F.expr("slice(samples, 2, greatest(size(samples) - 1, 0))"),
        }
    )
    n = F.col("observations")
    df = df.withColumn("span_ns", F.when(n >= 2, F.col("__last.t") - F.col("__first.t")))
    if exact:
        vol = rms_return_bps(F.expr("transform(samples, x -> cast(x.q as string))"), F.expr("transform(samples, x -> cast(x.b as string))"))
    else:
        vol = F.floor(F.sqrt(F.expr("aggregate(__later, 0D, (a, x) -> a + x.ret * x.ret)") / (n - 1) * 1e8)).cast("bigint")
    # falls are compared with the highest price before them; a window is bounded, so it is folded in its own row
    start = F.struct(F.get("samples", F.lit(0))["q"].cast(WIDE).alias("q"), F.get("samples", F.lit(0))["b"].cast(WIDE).alias("b"), F.lit(0).cast("bigint").alias("d"))

    def step(a: Column, x: Column) -> Column:
        q, b = x["q"].cast(WIDE), x["b"].cast(WIDE)
        change = return_bps(q, b, a["q"], a["b"])
        higher = price_key(q, b) >= price_key(a["q"], a["b"])
        worse = F.when(a["d"].isNotNull() & change.isNotNull(), F.least(a["d"], change))
        return F.when(higher, F.struct(q.alias("q"), b.alias("b"), a["d"].alias("d"))).otherwise(F.struct(a["q"].alias("q"), a["b"].alias("b"), worse.alias("d")))

    fall = F.aggregate("samples", start, step, lambda a: a["d"])
    older = F.expr("size(filter(samples, x -> x.t <= __first.t + span_ns div 2))")
    span = F.col("span_ns").cast("double")
    if exact:
        pace = fraction(4 * (n - 2 * older), (wide("span_ns") * wide("span_ns")).cast(WIDE), 18)
        quotes, bases = F.transform("samples", lambda x: x["q"].cast("string")), F.transform("samples", lambda x: x["b"].cast("string"))
        df = df.withColumn("returns", returns_exact(quotes, bases))
    else:
        pace = (n - 2 * older) * 4e18 / (span * span)
    return df.withColumns(
        {
            "maximum_gap_ns": F.expr("array_max(transform(__later, x -> x.gap))"),
            "momentum_short_bps": F.when(n >= 3, return_bps("__last.q", "__last.b", "__third.q", "__third.b")),
            "momentum_medium_bps": F.when(n >= 3, return_bps("__last.q", "__last.b", "__first.q", "__first.b")),
            "realized_volatility_bps": F.when(n >= 2, vol),
            "recent_drawdown_bps": F.when(n >= 2, fall),
            "last_return": F.when(n >= 2, F.col("__last.ret")),
            "activity_acceleration": F.when((F.col("span_ns") > 0) & (n >= 3), pace),
        }
    ).drop("__first", "__last", "__third", "__later")


REQUIRED = ("momentum_bps", "imbalance_bps", "quote_reserve", "base_reserve", "quote_age_ns", "quote_impact_bps")


def context_completeness(features: DataFrame, now: str = "availability_ns", minimum_samples: int = 3,
                         minimum_span_ns: int = 2 * SECOND, maximum_gap_ns: int = 15 * SECOND,
                         fresh_ns: int = 5 * SECOND, required=REQUIRED) -> DataFrame:
    """Sorted list of missing requirements and list of anomalies; an absent column counts as unknown."""
    have = set(features.columns)
    last_ns = F.col("availability_ns")
    checks = [
        (F.col("observations") < minimum_samples, "history.minimum_samples"),
        (F.col("span_ns").isNull() | (F.col("span_ns") < minimum_span_ns), "history.minimum_span"),
        (F.col("maximum_gap_ns").isNull() | (F.col("maximum_gap_ns") > maximum_gap_ns), "history.continuity"),
        (F.col(now) - last_ns > fresh_ns, "history.freshness"),
        (F.coalesce("slot_disorder", F.lit(False)), "history.slot_order"),
    ] + [(F.col(k).isNull() if k in have else F.lit(True), k) for k in required]
    liquidity = F.col("liquidity_change_bps") if "liquidity_change_bps" in have else F.lit(None).cast("bigint")
    odd = [
        (F.abs("last_return") >= 0.05, "isolated_large_last_return"),
        (F.col("momentum_short_bps") * F.col("momentum_medium_bps") < 0, "short_medium_momentum_conflict"),
        (liquidity <= -2000, "observed_liquidity_deterioration"),
    ]
    return features.withColumns({"required_missing": F.array_sort(flags(checks)), "anomalies": flags(odd)})


def flags(pairs) -> Column:
    """Names whose condition holds, in the given order; an unknown condition does not hold."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]), lambda x: x.isNotNull())


def account_history(decisions: DataFrame, observations: DataFrame, window_ns: int = 60 * SECOND,
                    split: Split = Split()) -> DataFrame:
    """Per decision the count, first and last reserve of the pool's account observations in the window before it.

    observations: pool, frame, observed_ns, quote_reserve; the last one of each frame counts.
    Only observations strictly before the decision and not older than ``window_ns`` are seen.
    """
    obs = observations.where(F.col("quote_reserve").isNotNull()).groupBy("pool", "frame").agg(
        F.max(F.struct("observed_ns", "quote_reserve")).alias("o")
    )
    stream = decisions.select(
        "pool", F.col("decision_ns").alias("t"), F.lit(None).cast("bigint").alias("frame"), "decision_id",
        F.lit(None).cast("bigint").alias("reserve"),
    ).unionByName(
        obs.select("pool", F.col("o.observed_ns").alias("t"), "frame", F.lit(None).cast("bigint").alias("decision_id"),
                   F.col("o.quote_reserve").cast("bigint").alias("reserve"))
    )
    o = Ordered(stream, ["pool"], ["t"], split, lookback_range=window_ns)
    w = o.window().rangeBetween(-window_ns, -1)
    entry = F.when(F.col("frame").isNotNull(), F.struct("t", "frame", "reserve"))
    o.add(n=F.count("frame").over(w), lo=F.min(entry).over(w), hi=F.max(entry).over(w))
    return o.result().where(F.col("decision_id").isNotNull()).select(
        "pool",
        "decision_id",
        F.col("n").alias("account_observations"),
        F.col("lo.reserve").alias("first_reserve"),
        F.col("hi.reserve").alias("last_reserve"),
        F.when(F.col("n") >= 2, change_bps("hi.reserve", "lo.reserve")).alias("liquidity_change_bps"),
    )


def candidate_extrema(marks: DataFrame, entries: DataFrame, split: Split = Split()) -> DataFrame:
    """Lowest and highest price seen after the entry of each position (up to its close, when it has one).

    entries: pool, entry_id, entry_ns, until_ns; any number of a pool's positions may be open at once.
    Extrema come from ``interval_extrema``, so the work grows with marks plus positions.
    """
    spans = entries.select("pool", F.col("entry_id").alias("interval_id"), F.col("entry_ns").alias("from_ns"), "until_ns")
    got = interval_extrema(marks.where(is_sample()), spans, "pool", split)
    return got.select(
        "pool", F.col("interval_id").alias("entry_id"), "samples",
        price("lo.quote_raw", "lo.base_raw").alias("minimum"), price("hi.quote_raw", "hi.base_raw").alias("maximum"),
        F.when(F.col("samples") == 0, "UNKNOWN").otherwise("DERIVED").alias("classification"),
    )


def latency_percentiles(samples: DataFrame, split: Split = Split(), tails: bool = True) -> DataFrame:
    """Nearest-rank p50 / p95 / p99 of ``ns`` per ``stage``.

    Values are counted per (stage, ns) before anything is ordered, so a stage with most of
    the rows costs one combined count; with ``tails`` p95 needs 20 and p99 100 samples.
    """
    counts = samples.groupBy("stage", "ns").agg(F.count(F.lit(1)).alias("n"))
    o = Ordered(counts, ["stage"], ["ns"], split).running(upto=("sum", F.col("n")))
    total = samples.groupBy("stage").agg(F.count(F.lit(1)).alias("samples"))
    ranked = o.result().join(total, "stage")

    def at(p: int, least: int) -> Column:
        value = F.min(F.when(F.col("upto") >= nearest_rank("samples", p), F.col("ns")))
        return F.when(F.first("samples") >= least, value) if tails else value

    return ranked.groupBy("stage").agg(
        F.first("samples").alias("samples"),
        at(50, 1).alias("p50_ns"),
        at(95, 20).alias("p95_ns"),
        at(99, 100).alias("p99_ns"),
    )


def newest(samples: DataFrame, n: int = 10_000, by: str = "seq") -> DataFrame:
    """The ``n`` newest rows (distributed top-k)."""
    return samples.orderBy(F.desc(by)).limit(n)
