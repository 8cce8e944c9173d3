"""Feature queries over the event stream."""

from pyspark.sql import functions as F

from ..operators import features as W
from ..operators.ordered import Split
from .registry import query
from .views import SWAP, EV, events

WIN = "PARTITION BY pool ORDER BY availability_ns, seq"
BPS = "CAST(({q} * {b0} - {q0} * {b}) * 10000 // ({q0} * {b}) AS BIGINT)"


def bps(q, b, q0, b0):
    big = {k: f"CAST({v} AS HUGEINT)" for k, v in dict(q=q, b=b, q0=q0, b0=b0).items()}
    return BPS.format(**big)


@query("swap_normalization", f"""WITH {EV}
SELECT pool, seq, kind, CASE WHEN kind = 'swap' THEN CASE WHEN instruction = 'sell' THEN 'sell' ELSE 'buy' END END AS side,
 CASE WHEN kind = 'swap' AND base_raw > 0 AND quote_raw > 0 THEN quote_raw * 1000000 // base_raw END AS price_micro,
 CASE WHEN kind = 'swap' AND NOT (base_raw > 0 AND quote_raw > 0) THEN 'zero_swap_amount' END AS reject FROM ev""")
def swap_normalization(spark, sf):
    df = W.normalize_swap(events(spark, sf))
    return df.select("pool", "seq", "kind", "side", F.floor(F.col("price") * 1000000).cast("bigint").alias("price_micro"), "reject")


def rolling(spark, sf, split=Split()):
    df = W.rolling_last_n(
        events(spark, sf), 64, split,
        window_rows=F.count(F.lit(1)), window_quote=F.sum("quote_raw"), oldest_seq=F.min("seq"), top_base=F.max("base_raw"),
    )
    return df.select("pool", "seq", "window_rows", "window_quote", "oldest_seq", "top_base")


ROLLING = f"""WITH {EV}
SELECT pool, seq, count(*) OVER w AS window_rows, CAST(sum(quote_raw) OVER w AS BIGINT) AS window_quote,
 min(seq) OVER w AS oldest_seq, max(base_raw) OVER w AS top_base
FROM ev WINDOW w AS ({WIN} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)"""


@query("rolling_last_events", ROLLING)
def rolling_last_events(spark, sf):
    return rolling(spark, sf)


@query("rolling_last_events_hot_pools", ROLLING)
def rolling_last_events_hot_pools(spark, sf):
    """Same answer with every pool cut into short segments."""
    return rolling(spark, sf, Split(40))


@query("late_slots", f"""WITH {EV}, r AS (SELECT pool, seq, seq % 97 AS slot, availability_ns FROM ev)
SELECT pool, seq, coalesce(slot < max(slot) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM r""")
def late_slots(spark, sf):
    df = events(spark, sf).withColumn("slot", F.pmod("seq", F.lit(97)))
    return W.late_flag(df).select("pool", "seq", "late")


@query("first_seen_wallets", f"""WITH {EV}
SELECT pool, seq, wallet, row_number() OVER (PARTITION BY pool, wallet ORDER BY availability_ns, seq) = 1 AS new_wallet FROM ev""")
def first_seen_wallets(spark, sf):
    return W.first_seen_wallet(events(spark, sf)).select("pool", "seq", "wallet", "new_wallet")


@query("pool_states", f"""WITH {EV}
SELECT pool, min(availability_ns) AS first_observed_ns, max(availability_ns) AS last_observed_ns, count(*) AS events, max(slot) AS last_slot,
 arg_max(event_time, seq) FILTER (WHERE kind = 'pool_created') AS created_time, min(wallet) <> max(wallet) AS identity_conflict
FROM ev GROUP BY pool""")
def pool_states(spark, sf):
    return W.pool_state(events(spark, sf), identity=("wallet",))


@query("anchor_prices", f"""WITH {EV}
SELECT pool, seq, first_value(seq) OVER w AS anchor_seq, first_value(quote_raw) OVER w AS anchor_quote, first_value(base_raw) OVER w AS anchor_base
FROM sw WINDOW w AS ({WIN})""")
def anchor_prices(spark, sf):
    return W.anchor_price(events(spark, sf)).select("pool", "seq", "anchor_seq", "anchor_quote", "anchor_base")


DRAWDOWN = f"""WITH {EV},
p AS (SELECT *, quote_raw / base_raw AS price FROM sw),
k AS (SELECT *, arg_max({{q: quote_raw, b: base_raw}}, price) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS peak FROM p),
f AS (SELECT *, {bps("quote_raw", "base_raw", "peak.q", "peak.b")} AS fall FROM k)
"""


@query("pool_drawdown", DRAWDOWN + f"SELECT pool, seq, min(fall) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS drawdown_bps FROM f")
def pool_drawdown(spark, sf):
    return W.drawdown(events(spark, sf)).select("pool", "seq", "drawdown_bps")


@query("pool_drawdown_hot_pools", DRAWDOWN + f"SELECT pool, seq, min(fall) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS drawdown_bps FROM f")
def pool_drawdown_hot_pools(spark, sf):
    return W.drawdown(events(spark, sf), Split(12)).select("pool", "seq", "drawdown_bps")


@query("horizon_outcomes", DRAWDOWN + f""", a AS (SELECT pool, min(availability_ns) AS t0, arg_min(seq, availability_ns) AS anchor_seq,
  arg_min(quote_raw, availability_ns) AS aq, arg_min(base_raw, availability_ns) AS ab FROM sw GROUP BY pool),
d AS (SELECT pool, seq, availability_ns, quote_raw, base_raw, min(fall) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS dd FROM f),
h AS (SELECT a.*, hz AS horizon_seconds, t0 + hz * 1000000000 AS due_ns FROM a, (SELECT CAST(unnest([3600, 86400, 864000, 4000000]) AS BIGINT) AS hz)),
m AS (SELECT h.pool, h.horizon_seconds, min(d.availability_ns) AS ns FROM h JOIN d ON d.pool = h.pool AND d.availability_ns >= h.due_ns GROUP BY ALL)
SELECT h.pool, h.horizon_seconds, h.due_ns, h.anchor_seq, d.seq AS mark_seq, d.availability_ns AS observed_ns, d.availability_ns - h.due_ns AS delay_ns,
 {bps("d.quote_raw", "d.base_raw", "h.aq", "h.ab")} AS return_bps, d.dd AS drawdown_bps,
 CASE WHEN d.seq IS NULL THEN 'NOT_COLLECTED' ELSE 'OBSERVED' END AS status
FROM h LEFT JOIN m USING (pool, horizon_seconds) LEFT JOIN d ON d.pool = h.pool AND d.availability_ns = m.ns""")
def horizon_outcomes(spark, sf):
    df = W.horizon_outcomes(events(spark, sf), (3600, 86400, 864000, 4000000))
    return df


@query("decision_outcomes", f"""WITH {EV},
h AS (SELECT pool, seq AS decision_id, availability_ns + hz * 1000000000 AS due_ns, hz AS horizon_seconds, quote_raw AS aq, base_raw AS ab
  FROM sw, (SELECT CAST(unnest([3600, 86400, 864000]) AS BIGINT) AS hz)),
m AS (SELECT h.*, e.seq AS mark_id, e.availability_ns AS observed_ns, e.quote_raw AS q, e.base_raw AS b
  FROM h ASOF LEFT JOIN sw e ON h.pool = e.pool AND h.due_ns <= e.availability_ns)
SELECT pool, decision_id, horizon_seconds, due_ns, mark_id, observed_ns, {bps("q", "b", "aq", "ab")} AS return_bps,
 CASE WHEN mark_id IS NULL THEN 'UNKNOWN' ELSE 'DERIVED' END AS status FROM m""")
def decision_outcomes(spark, sf):
    sw = events(spark, sf).where(SWAP)
    d = sw.select("pool", F.col("seq").alias("decision_id"), F.col("availability_ns").alias("decision_ns"), "quote_raw", "base_raw")
    m = sw.select("pool", F.col("seq").alias("mark_id"), "availability_ns", "quote_raw", "base_raw")
    out = W.decision_outcomes(d, m, (3600, 86400, 864000))
    return out


@query("opportunity_features", f"""WITH {EV},
x AS (SELECT *, count(*) OVER w AS n, sum(quote_raw) OVER w AS vol, list(quote_raw) OVER w AS qs, first_value(quote_raw) OVER w AS fq, first_value(base_raw) OVER w AS fb,
 count(*) FILTER (WHERE instruction <> 'sell') OVER w AS buys, count(*) FILTER (WHERE instruction = 'sell') OVER w AS sells, len(list_distinct(list(wallet) OVER w)) AS wl
 FROM sw WINDOW w AS ({WIN} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
SELECT pool, seq, n AS swaps_observed, CAST(vol AS BIGINT) AS volume_quote_raw, buys AS buy_count, sells AS sell_count, CAST(wl AS BIGINT) AS wallets_unique,
 {bps("quote_raw", "base_raw", "fq", "fb")} AS price_change_bps,
 CAST(vol - 2 * coalesce(list_sum(qs[1:n // 2]), 0) AS BIGINT) AS half_window_volume_change_raw FROM x""")
def opportunity_features(spark, sf):
    df = W.opportunity_features(events(spark, sf), 16)
    return df.select("pool", "seq", "swaps_observed", F.col("volume_quote_raw").cast("bigint").alias("volume_quote_raw"), "buy_count", "sell_count",
                     F.col("wallets_unique").cast("bigint").alias("wallets_unique"), "price_change_bps",
                     F.col("half_window_volume_change_raw").cast("bigint").alias("half_window_volume_change_raw"))


MARKET_COLS = ["pool", "seq", "swaps", "buy_flow", "sell_flow", "volume", "imbalance_bps", "momentum_bps",
               "volatility_mean_abs_return_bps", "momentum_acceleration_bps", "pool_age_seconds"]
MARKET_SQL = f"""WITH {EV},
c AS (SELECT pool, seq, {bps("quote_raw", "base_raw", "lag(quote_raw) OVER w", "lag(base_raw) OVER w")} AS chg FROM sw WINDOW w AS ({WIN})),
e AS (SELECT ev.*, c.chg FROM ev LEFT JOIN c USING (pool, seq)),
x AS (SELECT *, list({{t: availability_ns, q: quote_raw, b: base_raw, c: chg, buy: instruction <> 'sell', k: kind, et: event_time}}) OVER
 ({WIN} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS l FROM e),
y AS (SELECT *, list_filter(l, lambda s: s.k = 'swap' AND s.q > 0) AS s, list_filter(l, lambda s: s.k = 'pool_created' AND s.et <= event_time) AS cr FROM x WHERE kind = 'swap' AND quote_raw > 0),
z AS (SELECT *, len(s) AS n, CAST(coalesce(list_sum([i.q FOR i IN s IF i.buy]), 0) AS BIGINT) AS bf, CAST(coalesce(list_sum([i.q FOR i IN s IF NOT i.buy]), 0) AS BIGINT) AS sf,
 s[len(s)].t - s[1].t AS span FROM y),
v AS (SELECT *, bf + sf AS vol, coalesce(list_sum([i.q FOR i IN s IF i.t <= s[1].t + span // 2]), 0) AS older FROM z)
"""


@query("market_features", MARKET_SQL + f"""SELECT pool, seq, n AS swaps, bf AS buy_flow, sf AS sell_flow, vol AS volume, (bf - sf) * 10000 // vol AS imbalance_bps,
 CASE WHEN n >= 2 THEN {bps("s[n].q", "s[n].b", "s[1].q", "s[1].b")} END AS momentum_bps,
 CASE WHEN n >= 2 THEN CAST(list_sum([abs(i.c) FOR i IN s[2:n]]) // (n - 1) AS BIGINT) END AS volatility_mean_abs_return_bps,
 CASE WHEN n >= 3 THEN s[n].c - s[n - 1].c END AS momentum_acceleration_bps,
 CASE WHEN len(cr) > 0 THEN event_time - cr[len(cr)].et END AS pool_age_seconds FROM v""")
def market_features(spark, sf):
    flows = ("buy_flow", "sell_flow", "volume")
    return W.market_features(events(spark, sf)).select(*[F.col(c).cast("bigint").alias(c) if c in flows else c for c in MARKET_COLS])


@query("market_features_hot_pools", MARKET_SQL + """SELECT pool, seq, n AS swaps,
 CASE WHEN n >= 2 AND span > 0 THEN round(vol * 1e9 / span, 9) END AS volume_velocity,
 CASE WHEN n >= 2 AND span > 0 THEN round(n * 1e9 / span, 9) END AS transaction_velocity,
 CASE WHEN n >= 3 AND span > 0 THEN round((vol - 2 * older) * 4e18 / (CAST(span AS DOUBLE) * CAST(span AS DOUBLE)), 9) END AS volume_acceleration FROM v""")
def market_features_hot_pools(spark, sf):
    df = W.market_features(events(spark, sf), split=Split(25))
    return df.select("pool", "seq", "swaps", *[F.round(c, 9).alias(c) for c in ("volume_velocity", "transaction_velocity", "volume_acceleration")])


FIVE_DAYS = 5 * 86400 * 1_000_000_000
CONTEXT_SQL = f"""WITH {EV},
c AS (SELECT pool, seq, {bps("quote_raw", "base_raw", "lag(quote_raw) OVER w", "lag(base_raw) OVER w")} AS chg,
 CAST(quote_raw AS DOUBLE) * lag(base_raw) OVER w / (CAST(base_raw AS DOUBLE) * lag(quote_raw) OVER w) - 1 AS ret,
 availability_ns - lag(availability_ns) OVER w AS gap FROM sw WINDOW w AS ({WIN})),
e AS (SELECT ev.*, ev.seq % 97 AS sl, c.chg, c.ret, c.gap FROM ev LEFT JOIN c USING (pool, seq)),
g AS (SELECT *, coalesce(sl < lag(sl) OVER ({WIN}), false) AS dr FROM e),
x AS (SELECT *, list({{t: availability_ns, q: quote_raw, b: base_raw, c: chg, r: ret, g: gap, k: kind, d: dr}}) OVER
 ({WIN} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS l FROM g),
y AS (SELECT *, list_filter(l, lambda s: s.t >= availability_ns - {FIVE_DAYS}) AS li FROM x WHERE kind = 'swap' AND quote_raw > 0),
z AS (SELECT *, list_filter(li, lambda s: s.k = 'swap' AND s.q > 0) AS s FROM y),
v AS (SELECT *, len(s) AS n, s[len(s)].t - s[1].t AS span FROM z),
q AS (SELECT pool, seq, n, CASE WHEN n >= 2 THEN span END AS span_ns, list_max([i.g FOR i IN s[2:n]]) AS maximum_gap_ns,
 len([i FOR i IN li[2:len(li)] IF i.d]) > 0 AS slot_disorder,
 CASE WHEN n >= 3 THEN {bps("s[n].q", "s[n].b", "s[n - 2].q", "s[n - 2].b")} END AS momentum_short_bps,
 CASE WHEN n >= 3 THEN {bps("s[n].q", "s[n].b", "s[1].q", "s[1].b")} END AS momentum_medium_bps,
 CASE WHEN n >= 2 THEN CAST(floor(sqrt(list_sum([i.r * i.r FOR i IN s[2:n]]) / (n - 1) * 1e8)) AS BIGINT) END AS realized_volatility_bps,
 CASE WHEN n >= 2 THEN s[n].r END AS last_return,
 CASE WHEN n >= 3 AND span > 0 THEN round((n - 2 * len([i FOR i IN s IF i.t <= s[1].t + span // 2])) * 4e18 / (CAST(span AS DOUBLE) * CAST(span AS DOUBLE)), 12) END AS activity_acceleration,
 s FROM v)
"""


def context(spark, sf, split=Split()):
    ev = events(spark, sf).withColumn("slot", F.pmod("seq", F.lit(97)))
    return W.context_features(W.context_window(ev, FIVE_DAYS, 64, split))


@query("context_features", CONTEXT_SQL + """SELECT pool, seq, n AS observations, span_ns, maximum_gap_ns, slot_disorder, momentum_short_bps,
 momentum_medium_bps, realized_volatility_bps, activity_acceleration FROM q""")
def context_features(spark, sf):
    df = context(spark, sf)
    return df.select("pool", "seq", F.col("observations").cast("bigint").alias("observations"), "span_ns", "maximum_gap_ns", "slot_disorder",
                     "momentum_short_bps", "momentum_medium_bps", "realized_volatility_bps",
                     F.round("activity_acceleration", 12).alias("activity_acceleration"))


@query("context_recent_drawdown", CONTEXT_SQL + f""", u AS (SELECT pool, seq, n, i, s[i].q AS cq, s[i].b AS cb, s[i].q / s[i].b AS p FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM q)),
k AS (SELECT *, arg_max({{q: cq, b: cb}}, p) OVER (PARTITION BY pool, seq ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak FROM u)
SELECT pool, seq, CASE WHEN max(n) >= 2 THEN least(0, min({bps("cq", "cb", "peak.q", "peak.b")})) END AS recent_drawdown_bps FROM k GROUP BY pool, seq""")
def context_recent_drawdown(spark, sf):
    return context(spark, sf, Split(30)).select("pool", "seq", F.col("recent_drawdown_bps").cast("bigint").alias("recent_drawdown_bps"))


@query("context_completeness", CONTEXT_SQL + """SELECT pool, seq,
 array_to_string(list_sort(list_filter([CASE WHEN n < 3 THEN 'history.minimum_samples' END, CASE WHEN span_ns IS NULL OR span_ns < 86400000000000 THEN 'history.minimum_span' END,
  CASE WHEN maximum_gap_ns IS NULL OR maximum_gap_ns > 172800000000000 THEN 'history.continuity' END, CASE WHEN slot_disorder THEN 'history.slot_order' END,
  CASE WHEN momentum_medium_bps IS NULL THEN 'momentum_medium_bps' END, 'quote_reserve'], lambda x: x IS NOT NULL)), ',') AS required_missing,
 array_to_string(list_filter([CASE WHEN abs(last_return) >= 0.05 THEN 'isolated_large_last_return' END,
  CASE WHEN momentum_short_bps * momentum_medium_bps < 0 THEN 'short_medium_momentum_conflict' END], lambda x: x IS NOT NULL), ',') AS anomalies FROM q""")
def context_completeness(spark, sf):
    day = 86400 * 1_000_000_000
    df = W.context_completeness(context(spark, sf), minimum_span_ns=day, maximum_gap_ns=2 * day,
                                required=("momentum_medium_bps", "quote_reserve"))
    return df.select("pool", "seq", F.array_join("required_missing", ",").alias("required_missing"),
                     F.array_join("anomalies", ",").alias("anomalies"))


@query("account_history", f"""WITH {EV},
o AS (SELECT pool, seq // 3 AS frame, max({{t: availability_ns, q: quote_raw}}) AS o FROM ev WHERE kind <> 'failed' GROUP BY ALL),
d AS (SELECT pool, seq AS decision_id, availability_ns AS t FROM sw),
j AS (SELECT d.pool, d.decision_id, count(o.frame) AS n, arg_min(o.o.q, {{t: o.o.t, f: o.frame}}) AS a, arg_max(o.o.q, {{t: o.o.t, f: o.frame}}) AS b
 FROM d LEFT JOIN o ON o.pool = d.pool AND o.o.t < d.t AND o.o.t >= d.t - {FIVE_DAYS} GROUP BY ALL)
SELECT pool, decision_id, n AS account_observations, a AS first_reserve, b AS last_reserve, CASE WHEN n >= 2 THEN (b - a) * 10000 // a END AS liquidity_change_bps FROM j""")
def account_history(spark, sf):
    ev = events(spark, sf)
    obs = ev.where("kind <> 'failed'").select("pool", F.expr("seq div 3").alias("frame"), F.col("availability_ns").alias("observed_ns"),
                                              F.col("quote_raw").alias("quote_reserve"))
    dec = ev.where(SWAP).select("pool", F.col("seq").alias("decision_id"), F.col("availability_ns").alias("decision_ns"))
    return W.account_history(dec, obs, FIVE_DAYS, Split(60))


@query("candidate_extrema", f"""WITH {EV},
e AS (SELECT pool, seq AS entry_id, availability_ns AS entry_ns, lead(availability_ns) OVER ({WIN}) - 1 AS until_ns FROM ev WHERE kind = 'pool_created'),
j AS (SELECT e.pool, e.entry_id, count(s.seq) AS samples, min(s.quote_raw / s.base_raw) AS lo, max(s.quote_raw / s.base_raw) AS hi
 FROM e LEFT JOIN sw s ON s.pool = e.pool AND s.availability_ns > e.entry_ns AND (e.until_ns IS NULL OR s.availability_ns <= e.until_ns) GROUP BY ALL)
SELECT pool, entry_id, samples, round(lo, 6) AS minimum, round(hi, 6) AS maximum, CASE WHEN samples = 0 THEN 'UNKNOWN' ELSE 'DERIVED' END AS classification FROM j""")
def candidate_extrema(spark, sf):
    ev = events(spark, sf)
    made = ev.where("kind = 'pool_created'").select("pool", "availability_ns", F.col("seq"))
    from ..operators.ordered import Ordered
    o = Ordered(made, ["pool"], ["availability_ns", "seq"]).last_seen("after", F.col("availability_ns"), descending=True)
    entries = o.result().select("pool", F.col("seq").alias("entry_id"), F.col("availability_ns").alias("entry_ns"), (F.col("after") - 1).alias("until_ns"))
    out = W.candidate_extrema(ev, entries)
    return out.select("pool", "entry_id", "samples", F.round(F.col("minimum").cast("double"), 6).alias("minimum"),
                      F.round(F.col("maximum").cast("double"), 6).alias("maximum"), "classification")


@query("latency_percentiles", f"""WITH {EV}, r AS (SELECT kind || '/' || instruction AS stage, quote_raw AS ns FROM ev),
n AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ns) AS rn, count(*) OVER (PARTITION BY stage) AS c FROM r)
SELECT stage, max(c) AS samples, max(ns) FILTER (WHERE rn = (50 * c + 99) // 100) AS p50_ns,
 CASE WHEN max(c) >= 20 THEN max(ns) FILTER (WHERE rn = (95 * c + 99) // 100) END AS p95_ns,
 CASE WHEN max(c) >= 100 THEN max(ns) FILTER (WHERE rn = (99 * c + 99) // 100) END AS p99_ns FROM n GROUP BY stage""")
def latency_percentiles(spark, sf):
    s = events(spark, sf).select(F.concat_ws("/", "kind", "instruction").alias("stage"), F.col("quote_raw").alias("ns"))
    return W.latency_percentiles(s, Split(500))


# Amounts near 2^64: both sides of every price grow by a constant, so returns are those of the small amounts.
Q_TIMES, B_TIMES = 300_000_000_000_000, 150_000_000_000_000_000


def wide_events(spark, sf):
    return events(spark, sf).withColumns({
        "quote_raw": (F.col("quote_raw").cast("decimal(20,0)") * F.lit(Q_TIMES).cast("decimal(18,0)")).cast("decimal(20,0)"),
        "base_raw": (F.col("base_raw").cast("decimal(20,0)") * F.lit(B_TIMES).cast("decimal(18,0)")).cast("decimal(20,0)")})


def ratio_sql(num, den):
    """numerator/denominator in lowest terms, as one text."""
    return f"CAST(({num}) // gcd(abs({num}), {den}) AS VARCHAR) || '/' || CAST(({den}) // gcd(abs({num}), {den}) AS VARCHAR)"


def ratio_text(c):
    return F.concat_ws("/", F.col(f"{c}.numerator"), F.col(f"{c}.denominator"))


HUGE = "CAST({} AS HUGEINT)".format
EXACT_MARKET = MARKET_SQL + f""", h AS (SELECT *, {HUGE('vol')} * {Q_TIMES} AS wv, {HUGE('span // 1000')} AS us, (vol - 2 * older) * {HUGE(4)} * {Q_TIMES} * 1000000000000 AS mv FROM v)
SELECT pool, seq, n AS swaps, CAST({HUGE('bf')} * {Q_TIMES} AS VARCHAR) AS buy_flow, CAST({HUGE('sf')} * {Q_TIMES} AS VARCHAR) AS sell_flow, CAST(wv AS VARCHAR) AS volume,
 (bf - sf) * 10000 // vol AS imbalance_bps,
 CASE WHEN n >= 2 THEN {bps("s[n].q", "s[n].b", "s[1].q", "s[1].b")} END AS momentum_bps,
 CASE WHEN n >= 2 THEN CAST(list_sum([abs(i.c) FOR i IN s[2:n]]) // (n - 1) AS BIGINT) END AS volatility_mean_abs_return_bps,
 CASE WHEN n >= 3 THEN s[n].c - s[n - 1].c END AS momentum_acceleration_bps,
 {ratio_sql(f"{HUGE('s[n].q')} * {Q_TIMES}", f"{HUGE('s[n].b')} * {B_TIMES}")} AS price,
 CASE WHEN n >= 2 AND span > 0 THEN {ratio_sql("wv * 1000000", "us")} END AS volume_velocity,
 CASE WHEN n >= 2 AND span > 0 THEN {ratio_sql(HUGE('n') + " * 1000000", "us")} END AS transaction_velocity,
 CASE WHEN n >= 3 AND span > 0 THEN {ratio_sql("mv", "us * us")} END AS volume_acceleration FROM h"""


@query("exact_market_features", EXACT_MARKET)
def exact_market_features(spark, sf):
    """Amounts near 2^64: flows of decimals, price and rates as fractions in lowest terms."""
    df = W.market_features(wide_events(spark, sf), exact=True)
    rates = ("price", "volume_velocity", "transaction_velocity", "volume_acceleration")
    return df.select("pool", "seq", "swaps", *[F.col(c).cast("string").alias(c) for c in ("buy_flow", "sell_flow", "volume")],
                     F.col("imbalance_bps").cast("bigint").alias("imbalance_bps"), "momentum_bps",
                     F.col("volatility_mean_abs_return_bps").cast("bigint").alias("volatility_mean_abs_return_bps"), "momentum_acceleration_bps",
                     *[F.when(F.col(f"{c}.numerator").isNotNull(), ratio_text(c)).alias(c) for c in rates])


@query("exact_drawdowns", DRAWDOWN + f"""SELECT pool, seq, fall AS fall_bps, min(fall) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS drawdown_bps FROM f""")
def exact_drawdowns(spark, sf):
    """Running falls of prices whose products leave 38 digits."""
    return W.drawdown(wide_events(spark, sf)).select("pool", "seq", "fall_bps", "drawdown_bps")


@query("exact_context_features", CONTEXT_SQL + f"""SELECT pool, seq, n AS observations, momentum_short_bps, momentum_medium_bps,
 CASE WHEN n >= 2 THEN array_to_string([{ratio_sql(HUGE('s[i].q') + " * s[i - 1].b - " + HUGE('s[i - 1].q') + " * s[i].b", HUGE('s[i].b') + " * s[i - 1].q")} FOR i IN range(2, n + 1)], ',') END AS returns,
 CASE WHEN n >= 3 AND span_ns > 0 THEN {ratio_sql(f"(n - 2 * len([i FOR i IN s IF i.t <= s[1].t + span_ns // 2])) * {HUGE(4)} * 1000000000000", f"{HUGE('span_ns // 1000')} * (span_ns // 1000)")} END AS activity_acceleration FROM q""")
def exact_context_features(spark, sf):
    ev = wide_events(spark, sf).withColumn("slot", F.pmod("seq", F.lit(97)))
    df = W.context_features(W.context_window(ev, FIVE_DAYS, 64), exact=True)
    returns = F.array_join(F.transform("returns", lambda r: F.concat_ws("/", r["numerator"], r["denominator"])), ",")
    return df.select("pool", "seq", F.col("observations").cast("bigint").alias("observations"), "momentum_short_bps", "momentum_medium_bps",
                     returns.alias("returns"), F.when(F.col("activity_acceleration.numerator").isNotNull(), ratio_text("activity_acceleration")).alias("activity_acceleration"))


SPANS = "e AS (SELECT pool, seq AS entry_id, availability_ns AS entry_ns, CASE WHEN seq % 2 = 0 THEN availability_ns + (seq % 31) * 86400000000000 END AS until_ns FROM ev WHERE kind <> 'swap')"


def open_positions(ev):
    """A position at every creation and failure, half of them never closed: many are open at once."""
    until = F.when(F.col("seq") % 2 == 0, F.col("availability_ns") + (F.col("seq") % 31) * F.lit(86400 * 1_000_000_000))
    return ev.where("kind <> 'swap'").select("pool", F.col("seq").alias("entry_id"), F.col("availability_ns").alias("entry_ns"), until.alias("until_ns"))


OVERLAPPING = f"""WITH {EV}, {SPANS},
j AS (SELECT e.pool, e.entry_id, count(s.seq) AS samples, min(s.quote_raw / s.base_raw) AS lo, max(s.quote_raw / s.base_raw) AS hi
 FROM e LEFT JOIN sw s ON s.pool = e.pool AND s.availability_ns > e.entry_ns AND (e.until_ns IS NULL OR s.availability_ns <= e.until_ns) GROUP BY ALL)
SELECT pool, entry_id, samples, round(lo, 6) AS minimum, round(hi, 6) AS maximum, CASE WHEN samples = 0 THEN 'UNKNOWN' ELSE 'DERIVED' END AS classification FROM j"""


def overlapping(spark, sf, split=Split()):
    ev = events(spark, sf)
    out = W.candidate_extrema(ev, open_positions(ev), split)
    return out.select("pool", "entry_id", "samples", F.round(F.col("minimum").cast("double"), 6).alias("minimum"),
                      F.round(F.col("maximum").cast("double"), 6).alias("maximum"), "classification")


@query("overlapping_extrema", OVERLAPPING)
def overlapping_extrema(spark, sf):
    return overlapping(spark, sf)


@query("overlapping_extrema_hot_pools", OVERLAPPING)
def overlapping_extrema_hot_pools(spark, sf):
    return overlapping(spark, sf, Split(30))
