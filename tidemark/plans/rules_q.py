"""Rule and evidence queries: every event gets a feature row derived from its columns."""

from pyspark.sql import functions as F

from ..functions.exact import haircut_output
from ..operators import evidence as E
from ..operators import rules as R
from ..operators.ordered import Ordered
from ..operators.validate import TOKEN, TOKEN_2022
from .registry import query
from .views import SWAP, EV, events, fills, FILLS

FEATURES = {
    "swaps": ("seq % 20", 23), "momentum_bps": ("quote_raw % 1500 - 700", 17), "imbalance_bps": ("(base_raw * 211) % 20001 - 9000", 19),
    "volatility_mean_abs_return_bps": ("quote_raw % 900", 29), "momentum_acceleration_bps": ("seq % 5 - 2", 31), "quote_reserve": ("quote_raw * 200000", 13),
    "base_reserve": ("base_raw * 10", 41), "quote_age_ns": ("quote_raw * 900000", 11), "quote_impact_bps": ("base_raw + seq % 30", 37),
    "momentum_short_bps": ("quote_raw % 300 - 150", 43), "momentum_medium_bps": ("base_raw * 7 % 300 - 150", 47), "realized_volatility_bps": ("quote_raw % 700", 53),
}


def features(spark, sf):
    ev = events(spark, sf)
    cols = {k: F.expr(f"case when seq % {n} <> 1 then {e} end") for k, (e, n) in FEATURES.items()}
    ev = ev.withColumns(cols)
    return ev.withColumns({
        "required_missing": F.expr("if(seq % 4 = 0, array('history.continuity', 'quote_reserve'), cast(array() as array<string>))"),
        "anomalies": F.expr("case seq % 7 when 0 then array('observed_liquidity_deterioration') when 1 then array('short_medium_momentum_conflict') else cast(array() as array<string>) end"),
    })


FT = f"""WITH {EV}, ft AS (SELECT *, {", ".join(f"CASE WHEN seq % {n} <> 1 THEN {e} END AS {k}" for k, (e, n) in FEATURES.items())},
 CASE WHEN seq % 4 = 0 THEN ['history.continuity', 'quote_reserve'] ELSE [] END AS required_missing,
 CASE seq % 7 WHEN 0 THEN ['observed_liquidity_deterioration'] WHEN 1 THEN ['short_medium_momentum_conflict'] ELSE [] END AS anomalies FROM ev)"""
ACC = "CASE WHEN momentum_acceleration_bps > 0 THEN 'ACCELERATING' WHEN momentum_acceleration_bps < 0 THEN 'DECELERATING' WHEN momentum_acceleration_bps = 0 THEN 'STABLE' END"


def lst(*items):
    return "array_to_string(list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL), ',')"


def join(c):
    return F.array_join(c, ",").alias(c)


@query("regime_labels", f"""{FT} SELECT seq, {lst("'ROTATION_UNKNOWN'", "CASE WHEN swaps IS NULL OR swaps < 3 THEN 'LOW_ACTIVITY' WHEN swaps >= 16 THEN 'HIGH_ACTIVITY' ELSE 'NORMAL' END",
 "CASE WHEN volatility_mean_abs_return_bps >= 500 THEN 'HIGH_VOLATILITY' END", "CASE WHEN quote_reserve < 1000000000 THEN 'LIQUIDITY_STRESS' END", ACC)} AS labels,
 {lst("CASE WHEN volatility_mean_abs_return_bps >= 500 THEN 'observed_mean_abs_return_above_threshold' END", "CASE WHEN quote_reserve < 1000000000 THEN 'observed_reserve_below_descriptive_threshold' END")} AS reasons FROM ft""")
def regime_labels(spark, sf):
    return R.regime_labels(features(spark, sf)).select("seq", join("labels"), join("reasons"))


@query("context_regimes", f"""{FT} SELECT seq, {lst("CASE WHEN len(required_missing) > 0 THEN 'INSUFFICIENT_DATA' WHEN momentum_short_bps > 0 AND momentum_medium_bps > 0 THEN 'TRENDING_UP' WHEN momentum_short_bps < 0 AND momentum_medium_bps < 0 THEN 'TRENDING_DOWN' WHEN momentum_short_bps * momentum_medium_bps < 0 THEN 'REVERSAL_RISK' WHEN momentum_short_bps IS NOT NULL AND momentum_medium_bps IS NOT NULL THEN 'QUIET' END",
 "CASE WHEN realized_volatility_bps >= 500 THEN 'HIGH_VOLATILITY' END", ACC, "CASE WHEN seq % 7 = 0 THEN 'LIQUIDITY_STRESS' END")} AS labels, array_to_string(required_missing || anomalies, ',') AS reasons FROM ft""")
def context_regimes(spark, sf):
    return R.context_regime(features(spark, sf)).select("seq", join("labels"), join("reasons"))


MS = "CAST(floor((greatest(0, least(10000, 5000 + CAST(floor(momentum_bps * 5000 / 200.0) AS BIGINT))) * 60 + CAST(floor((imbalance_bps + 10000) / 2.0) AS BIGINT) * 40) / 100.0) AS BIGINT)"
SCORES = f"""{FT}, s1 AS (SELECT *, CASE WHEN momentum_bps IS NOT NULL AND imbalance_bps IS NOT NULL THEN {MS} END AS market_score,
 CASE WHEN quote_impact_bps IS NOT NULL AND quote_age_ns IS NOT NULL THEN (greatest(0, 10000 - quote_impact_bps * 100) * 60 + greatest(0, 10000 - quote_age_ns // 500000) * 40) // 100 END AS execution_score,
 (momentum_bps IS NULL)::INT + (imbalance_bps IS NULL)::INT + (quote_reserve IS NULL)::INT + (base_reserve IS NULL)::INT + (quote_age_ns IS NULL)::INT + (quote_impact_bps IS NULL)::INT AS nm FROM ft),
s2 AS (SELECT *, (6 - nm) * 10000 // 6 AS quality_score FROM s1),
s3 AS (SELECT *, CASE WHEN market_score IS NOT NULL AND execution_score IS NOT NULL THEN (market_score * 50 + execution_score * 30 + quality_score * 20) // 100 END AS opportunity_score FROM s2)"""


@query("opportunity_scores", SCORES + " SELECT seq, market_score, execution_score, quality_score, opportunity_score, nm AS n_missing FROM s3")
def opportunity_scores(spark, sf):
    return R.opportunity_scores(features(spark, sf)).select("seq", "market_score", "execution_score", "quality_score", "opportunity_score", F.size("missing_required").alias("n_missing"))


@query("weighted_scores", f"""{FT} SELECT seq, CASE WHEN swaps IS NOT NULL AND quote_reserve IS NOT NULL THEN (swaps * 30 + quote_reserve * 70) // 100 END AS value,
 {lst("CASE WHEN swaps IS NULL THEN 'swaps' END", "CASE WHEN quote_reserve IS NULL THEN 'reserve' END")} AS missing FROM ft""")
def weighted_scores(spark, sf):
    f = features(spark, sf)
    s = R.weighted_score([("swaps", F.col("swaps"), 30), ("reserve", F.col("quote_reserve"), 70)])
    return f.select("seq", s["value"].alias("value"), F.array_join(s["missing"], ",").alias("missing"))


@query("context_scores", SCORES + """ SELECT seq, CASE WHEN seq % 4 <> 0 THEN opportunity_score END AS opportunity_score,
 array_to_string(CASE WHEN seq % 4 = 0 THEN list_sort(list_distinct(list_filter([CASE WHEN market_score IS NULL THEN 'market' END, CASE WHEN execution_score IS NULL THEN 'execution' END], lambda x: x IS NOT NULL) || required_missing))
 ELSE list_filter([CASE WHEN market_score IS NULL THEN 'market' END, CASE WHEN execution_score IS NULL THEN 'execution' END], lambda x: x IS NOT NULL) END, ',') AS score_missing FROM s3""")
def context_scores(spark, sf):
    return R.context_score(R.opportunity_scores(features(spark, sf))).select("seq", "opportunity_score", join("score_missing"))


@query("score_decompositions", SCORES + """ SELECT seq, market_score, market_score * 50 AS market_part, execution_score * 30 AS execution_part, quality_score * 20 AS quality_part, quote_reserve AS liquidity,
 momentum_bps, imbalance_bps AS flow_bps, CASE WHEN seq % 4 <> 0 THEN opportunity_score END AS final FROM s3""")
def score_decompositions(spark, sf):
    d = R.context_score(R.opportunity_scores(features(spark, sf)))
    parts = [F.col(f"decomposition.{p}.contribution_x100").alias(f"{p}_part") for p in ("market", "execution", "quality")]
    return d.select("seq", F.col("decomposition.market.value").alias("market_score"), *parts, "decomposition.liquidity.value", "decomposition.momentum_bps", "decomposition.flow_bps", "decomposition.final").withColumnRenamed("value", "liquidity")


ENTRY = ["CASE WHEN NOT coalesce(swaps >= 3, false) THEN 'enough_samples' END", "CASE WHEN NOT coalesce(momentum_bps > 0, false) THEN 'positive_momentum' END", "CASE WHEN NOT coalesce(imbalance_bps >= 0, false) THEN 'nonnegative_flow' END",
         "CASE WHEN nm > 0 THEN 'quality_complete' END", "CASE WHEN NOT coalesce({s} >= 6000, false) THEN 'score_threshold' END", "CASE WHEN volatility_mean_abs_return_bps >= 500 THEN 'regime_not_high_volatility' END"]


@query("entry_rules", SCORES + f", e AS (SELECT seq, {lst(*[x.format(s='opportunity_score') for x in ENTRY])} AS failed FROM s3) SELECT seq, failed, CASE WHEN failed = '' THEN 'CANDIDATE_BUY' ELSE 'NO_TRADE' END AS action FROM e")
def entry_rules(spark, sf):
    f = R.regime_labels(R.opportunity_scores(features(spark, sf)))
    return R.entry_rule(f).select("seq", join("failed"), "action")


@query("context_entry_rules", SCORES + f""", c AS (SELECT *, CASE WHEN seq % 4 <> 0 THEN opportunity_score END AS cs FROM s3), e AS (SELECT seq, {lst(*[x.format(s='cs') for x in ENTRY], "CASE WHEN seq % 4 = 0 THEN 'context_complete' END", "CASE WHEN seq % 7 = 1 THEN 'momentum_not_contradictory' END")} AS failed FROM c)
SELECT seq, failed, CASE WHEN failed = '' THEN 'CANDIDATE_BUY' ELSE 'NO_TRADE' END AS action FROM e""")
def context_entry_rules(spark, sf):
    f = R.context_score(R.regime_labels(R.opportunity_scores(features(spark, sf))))
    return R.context_entry_rule(f).select("seq", join("failed"), "action")


EXIT = SCORES + f""", p AS (SELECT *, base_raw * 10000000 AS entry_quote_reserve, seq % 9 <> 2 AS risk_allowed, seq % 100 * 1000000000 AS duration_ns FROM s3),
q AS (SELECT *, (quote_reserve - entry_quote_reserve) * 10000 // entry_quote_reserve AS lc FROM p),
r AS (SELECT *, list_filter([CASE WHEN momentum_bps <= -200 AND imbalance_bps < 0 THEN 'momentum_and_flow_deterioration' END, CASE WHEN lc <= -2000 THEN 'liquidity_deterioration' END, CASE WHEN quote_impact_bps >= 100 THEN 'execution_deterioration' END], lambda x: x IS NOT NULL) AS inv FROM q),
t AS (SELECT *, CASE WHEN NOT risk_allowed THEN 'HARD_RISK_EXIT_REQUEST_REQUIRES_NEW_EVIDENCE_AND_RISK' WHEN len(inv) >= 2 THEN 'THESIS_INVALIDATION' WHEN list_contains(inv, 'liquidity_deterioration') THEN 'LIQUIDITY_DETERIORATION' WHEN duration_ns >= 60000000000 THEN 'TIME_BASED_EXIT' ELSE 'THESIS_NOT_INVALIDATED' END AS category FROM r)
"""


@query("exit_rules", EXIT + """SELECT seq, lc AS liquidity_change_bps, category, CASE WHEN category = 'LIQUIDITY_DETERIORATION' THEN 'REDUCE_CANDIDATE' WHEN category = 'THESIS_NOT_INVALIDATED' THEN 'HOLD' ELSE 'EXIT_CANDIDATE' END AS action,
 array_to_string(CASE WHEN NOT risk_allowed THEN ['kill_switch'] WHEN category = 'TIME_BASED_EXIT' THEN ['maximum_thesis_horizon_reached'] WHEN category = 'THESIS_NOT_INVALIDATED' THEN ['insufficient_joint_invalidation'] ELSE inv END, ',') AS reasons,
 CASE WHEN market_score IS NOT NULL AND lc IS NOT NULL THEN (market_score * 60 + greatest(0, least(10000, 10000 + lc * 2)) * 40) // 100 END AS health_score FROM t""")
def exit_rules(spark, sf):
    f = R.opportunity_scores(features(spark, sf)).withColumns({
        "entry_quote_reserve": F.col("base_raw") * 10000000, "risk_allowed": F.col("seq") % 9 != 2, "duration_ns": F.col("seq") % 100 * 1_000_000_000, "risk_reasons": F.array(F.lit("kill_switch"))})
    return R.exit_rule(f).select("seq", "liquidity_change_bps", "category", "action", join("reasons"), "health_score")


def veto_state(spark, sf):
    ev = events(spark, sf)
    return ev.select(
        "seq", F.expr("case when seq % 53 <> 1 then quote_raw * 100 - 5000 end").alias("requested"), F.expr("seq % 47 = 3").alias("kill"), F.expr("case when seq % 43 = 2 then 'PARTIAL' else 'OBSERVED' end").alias("data_health"),
        (F.col("availability_ns") - F.col("base_raw") * 60_000_000).alias("availability_ns"), F.expr("case when seq % 41 <> 5 then availability_ns + (seq % 3 - 1) * 10 end").alias("heartbeat_ns"),
        F.expr("case when seq % 37 = 1 then 'PARTIAL' else 'OBSERVED' end").alias("coverage"), F.expr("case when seq % 31 = 1 then 'NONE' else 'OBSERVED_SAFE' end").alias("authority_state"),
        F.expr("case when seq % 29 = 1 then 'MISSING' else 'OBSERVED' end").alias("quote_status"), F.lit(True).alias("exit_possible"), F.col("seq").alias("quote_provenance"),
        (F.col("availability_ns") + F.col("base_raw") - 10).alias("expires_ns"), F.expr("availability_ns + if(seq % 23 = 1, 1, 0)").alias("observed_ns"), F.expr("quote_raw * 100 - 5000 + if(seq % 19 = 1, 1, 0)").alias("size_raw"),
        (F.col("quote_raw") * 4000).alias("liquidity_quote_raw"), (F.col("base_raw") + 10).alias("slippage_bps"), F.expr("case when seq % 17 <> 1 then quote_raw * 300 end").alias("exposure"), F.expr("seq % 4").alias("positions"),
        (F.col("base_raw") * 1100).alias("loss"), F.col("availability_ns").alias("now"))


@query("risk_vetoes", f"""WITH {EV}, r AS (SELECT seq, CASE WHEN seq % 53 <> 1 THEN quote_raw * 100 - 5000 END AS rq, base_raw AS b, quote_raw AS q, CASE WHEN seq % 17 <> 1 THEN quote_raw * 300 END AS ex FROM ev),
v AS (SELECT *, seq % 29 = 1 AS un, ex IS NULL AS inc, rq IS NULL OR rq <= 0 AS sb FROM r)
SELECT seq, array_to_string(list_sort(list_filter([CASE WHEN sb THEN 'invalid_size' END, CASE WHEN NOT sb AND rq > 1000000 THEN 'position_limit' END, CASE WHEN seq % 47 = 3 THEN 'kill_switch' END, CASE WHEN seq % 43 = 2 THEN 'data_health_unproven' END,
 CASE WHEN b * 60000000 > 5000000000 THEN 'stale_or_future_data' END, CASE WHEN seq % 41 = 5 OR seq % 3 = 2 THEN 'heartbeat_missing_or_stale' END, CASE WHEN seq % 37 = 1 THEN 'coverage_incomplete' END, CASE WHEN seq % 31 = 1 THEN 'authority_unproven' END,
 CASE WHEN un THEN 'execution_quote_unproven' END, CASE WHEN NOT un AND b < 10 THEN 'quote_expired' END, CASE WHEN NOT un AND seq % 23 = 1 THEN 'quote_from_future' END, CASE WHEN NOT un AND (rq IS NULL OR seq % 19 = 1) THEN 'quote_size_mismatch' END,
 CASE WHEN NOT un AND q * 4000 < 10000000 THEN 'liquidity_quote_raw_limit_or_missing' END, CASE WHEN NOT un AND b + 10 > 100 THEN 'slippage_bps_limit_or_missing' END, CASE WHEN inc THEN 'account_incoherent' END,
 CASE WHEN NOT inc AND ex + coalesce(rq, 0) > 2000000 THEN 'exposure_limit' END, CASE WHEN NOT inc AND seq % 4 >= 2 THEN 'positions_limit' END, CASE WHEN NOT inc AND b * 1100 >= 100000 THEN 'session_loss_limit' END], lambda x: x IS NOT NULL)), ',') AS risk_reasons FROM v""")
def risk_vetoes(spark, sf):
    return R.risk_veto(veto_state(spark, sf)).select("seq", join("risk_reasons"))


@query("haircut_outputs", f"WITH {FILLS} SELECT mint, o, n, least(quote_raw - d * 1000, quote_raw * 9975 // 10000) AS output FROM fl")
def haircut_outputs(spark, sf):
    return fills(spark, sf).select("mint", "o", "n", haircut_output(F.col("quote_raw") - F.col("d") * 1000, "quote_raw", 25).cast("bigint").alias("output"))


NATIVE, PROGRAM = "native", "pool-program"


def text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def mint_json(owner, authority):
    return text('{"executable":false,"owner":"', owner, '","data":{"program":"spl-token","parsed":{"type":"mint","info":{"isInitialized":true,"mintAuthority":', authority,
                ',"freezeAuthority":null,"decimals":6,"supply":"1000"}}}}')


def vault_json(owner, mint, holder, amount):
    return text('{"executable":false,"owner":"', owner, '","data":{"program":"spl-token","parsed":{"type":"account","info":{"mint":"', mint, '","owner":"', holder,
                '","state":"initialized","tokenAmount":{"amount":"', amount.cast("string"), '"}}}}}')


def evidence_tables(spark, sf):
    """A plan per swap with its own three evidence frames; ``seq % 23`` picks the fault."""
    ev = events(spark, sf).where(SWAP).withColumns({"fault": F.col("seq") % 23, "token": F.concat(F.lit("t"), F.col("pool")), "name": F.concat(F.lit("p"), F.col("pool"))})
    amount = F.col("quote_raw") * 100
    out = F.col("base_raw") * 1000
    cut = F.floor(out * 9975 / 10000).cast("bigint")
    plans = ev.select(
        F.col("seq").alias("plan_id"), F.col("name").alias("pool"), F.col("token").alias("base_mint"), F.when(F.col("fault") == 1, "usd").otherwise(NATIVE).alias("quote_mint"), "slot",
        F.concat("name", F.lit("/b")).alias("base_vault"), F.concat("name", F.lit("/q")).alias("quote_vault"),
        (F.col("availability_ns") - F.when(F.col("fault") == 2, 6_000_000_000).otherwise(0)).alias("availability_ns"), F.lit("BUY").alias("side"), amount.alias("amount"), F.col("availability_ns").alias("now"),
        (F.col("seq") * 3).alias("forward_frame"), (F.col("seq") * 3 + 1).alias("reverse_frame"), F.when(F.col("fault") != 3, F.col("seq") * 3 + 2).alias("accounts_frame"))

    def leg(i, o):
        route = F.struct(F.lit(100).alias("percent"), F.when(F.col("fault") == 4, "x").otherwise(F.col("name")).alias("amm_key"), i.alias("input_mint"), o.alias("output_mint"))
        return F.when(F.col("fault") == 5, F.array(route, route)).otherwise(F.array(route))

    def quotes(offset, i, o, a, b, slot):
        low = F.least(b, F.floor(b * 9950 / 10000).cast("bigint") + F.col("seq") % 2)
        return ev.select(
            (F.col("seq") * 3 + offset).alias("frame"), i.alias("input_mint"), o.alias("output_mint"), F.when(F.col("fault") == 6, "Other").otherwise("ExactIn").alias("mode"), a.cast("string").alias("in_amount"),
            b.cast("string").alias("out_amount"), (b if offset == 0 else low).cast("string").alias("threshold"), F.lit(50).alias("slippage_bps"), slot.alias("slot"),
            F.when(F.col("fault") == 7, "0.02").otherwise("0.001").alias("impact"), leg(i, o).alias("routes"), i.alias("request_input"), o.alias("request_output"), a.alias("request_amount"), F.lit(50).alias("request_slippage_bps"),
            (F.col("availability_ns") - F.when(F.col("fault") == 8, 9_000_000_000).otherwise(5)).alias("observed_ns"))

    native = F.lit(NATIVE)
    fwd = quotes(0, native, F.col("token"), amount, out, F.col("slot") + F.when(F.col("fault") == 9, 200).otherwise(1))
    rev = quotes(1, F.col("token"), native, cut + F.when(F.col("fault") == 10, 1).otherwise(0), amount - 5, F.col("slot") + F.when(F.col("fault") == 11, 40).otherwise(2))

    tok = F.lit(TOKEN)
    keys = F.array("token", F.when(F.col("fault") == 1, "usd").otherwise(NATIVE), F.concat("name", F.lit("/b")), F.concat("name", F.lit("/q")), "name")
    value = F.array(
        mint_json(tok, F.when(F.col("fault") == 12, '"k"').otherwise("null")), mint_json(tok, F.lit("null")),
        vault_json(tok, F.col("token"), F.when(F.col("fault") == 13, "x").otherwise(F.col("name")), F.when(F.col("fault") == 14, 5).otherwise(out * 100)),
        vault_json(tok, native, F.col("name"), F.when(F.col("fault") == 15, amount - 6).otherwise(amount * 100)),
        text('{"executable":false,"owner":"', F.when(F.col("fault") == 16, "x").otherwise(PROGRAM), '"}'))
    accounts = ev.select(
        (F.col("seq") * 3 + 2).alias("frame"), F.lit("getMultipleAccounts").alias("request_method"), keys.alias("request_keys"), F.lit("confirmed").alias("commitment"), F.col("slot").alias("min_context_slot"),
        (F.col("slot") - F.when(F.col("fault") == 17, 1).otherwise(0)).alias("slot"), (F.col("availability_ns") - 7).alias("observed_ns"), value.alias("value"))
    return plans, fwd.unionByName(rev), accounts


POLICY = R.RiskPolicy(max_position=900_000, max_exposure=2_000_000, min_liquidity=20_000_000)
FAULTS = {1: "unsupported_quote_currency", 2: "event_stale_or_future", 3: "accounts_stale_or_future", 4: "route_pool_mismatch", 5: "split_route_unsupported", 6: "quote_mode", 7: "price_impact_limit", 8: "quote_stale_or_future",
          9: "quote_event_slot_divergence", 10: "reverse_quote_size_mismatch", 11: "evidence_slot_divergence", 12: "mint_or_freeze_authority_present", 13: "vault_identity_or_frozen", 14: "output_exceeds_observed_vault",
          15: "exit_output_exceeds_observed_vault", 16: "pool_program_mismatch", 17: "accounts_before_event"}
CODE = "CASE seq % 23 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items()) + " ELSE 'ok' END"


@query("evidence_join", f"""WITH {EV}, r AS (SELECT *, {CODE} AS reason FROM sw) SELECT seq AS plan_id, reason, CASE WHEN reason = 'ok' THEN availability_ns - 7 END AS evidence_ns, CASE WHEN reason = 'ok' THEN quote_raw * 10000 END AS liquidity,
 CASE WHEN reason = 'ok' THEN quote_raw * 100 END AS size_raw FROM r""")
def evidence_join(spark, sf):
    p, q, a = evidence_tables(spark, sf)
    e = E.evidence_join(p, q, a, NATIVE, PROGRAM, POLICY)
    return e.select("plan_id", "reason", F.col("evidence_availability_ns").alias("evidence_ns"), F.col("liquidity_quote_raw").cast("bigint").alias("liquidity"), "size_raw")


@query("accounts_proof", f"""WITH {EV} SELECT seq AS plan_id, CASE seq % 23 WHEN 12 THEN 'mint_or_freeze_authority_present' WHEN 13 THEN 'vault_identity_or_frozen' WHEN 16 THEN 'pool_program_mismatch' WHEN 17 THEN 'accounts_before_event'
 WHEN 1 THEN 'vault_identity_or_frozen' ELSE 'ok' END AS accounts_reason, CASE WHEN seq % 23 = 14 THEN 5 ELSE base_raw * 100000 END AS base_reserve_raw FROM sw""")
def accounts_proof(spark, sf):
    p, _, a = evidence_tables(spark, sf)
    j = p.withColumn("frame", F.col("plan_id") * 3 + 2).join(E.judged_accounts(a, PROGRAM), "frame")
    return E.accounts_proof(j).select("plan_id", "accounts_reason", F.col("base_reserve_raw").cast("bigint").alias("base_reserve_raw"))


# every reason that accounts and sell quotes can give, picked by seq % 41
SELL_FAULTS = {
    1: "invalid_side", 2: "accounts_binding_mismatch", 3: "accounts_binding_mismatch", 4: "account_commitment_or_slot", 5: "account_commitment_or_slot", 6: "account_missing", 7: "executable_token_account",
    8: "unsupported_token_program", 9: "not_mint", 10: "mint_or_freeze_authority_present", 11: "unsupported_mint_extensions", 12: "token2022_parser_mismatch", 13: "mutable_or_external_metadata_pointer",
    14: "mutable_or_unbound_token_metadata", 15: "unsupported_metadata_layout", 16: "invalid_mint_decimals", 17: "invalid_mint_supply", 18: "vault_mint_program_mismatch", 19: "not_token_account",
    20: "unsupported_vault_extensions", 21: "vault_identity_or_frozen", 22: "vault_authority_or_extensions", 23: "vault_authority_or_extensions", 24: "invalid_reserve", 25: "invalid_reserve", 26: "pool_program_mismatch",
    27: "output_exceeds_observed_vault", 28: "exit_output_exceeds_observed_vault", 29: "quote_missing", 30: "forward_quote_mismatch", 31: "unsupported_vault_extensions", 32: "accounts_stale_or_future", 33: "accounts_before_event",
    34: "executable_token_account", 35: "unsupported_mint_extensions", 36: "evidence_slot_divergence"}
SELL_CODE = "CASE seq % 41 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SELL_FAULTS.items()) + " ELSE 'ok' END"


def sell_tables(spark, sf):
    """A plan per swap that sells a Token-2022 token."""
    ev = events(spark, sf).where(SWAP).withColumns({"fault": F.col("seq") % 41, "token": F.concat(F.lit("t"), F.col("pool")), "name": F.concat(F.lit("p"), F.col("pool"))})

    def pick(default, **cases):
        out = F.lit(default) if isinstance(default, str) else default
        for k, v in cases.items():
            out = F.when(F.col("fault") == int(k[1:]), F.lit(v) if isinstance(v, (str, int)) else v).otherwise(out)
        return out

    amount, o = F.col("base_raw") * 1000, F.col("quote_raw") * 10000
    cut = F.floor(o * 9975 / 10000).cast("bigint")
    native = F.lit(NATIVE)
    vaults = F.concat("name", F.lit("/b")), F.concat("name", F.lit("/q"))
    plans = ev.select(
        F.col("seq").alias("plan_id"), F.col("name").alias("pool"), F.col("token").alias("base_mint"), native.alias("quote_mint"), vaults[0].alias("base_vault"), vaults[1].alias("quote_vault"), "slot", "availability_ns",
        pick("SELL", _1="HOLD").alias("side"), amount.alias("amount"), F.col("availability_ns").alias("now"),
        F.when(F.col("fault") != 29, F.col("seq") * 3).alias("forward_frame"), (F.col("seq") * 3 + 1).alias("reverse_frame"), (F.col("seq") * 3 + 2).alias("accounts_frame"))

    def quote(offset, i, out_mint, a, b):
        route = F.struct(F.lit(100).alias("percent"), F.col("name").alias("amm_key"), i.alias("input_mint"), out_mint.alias("output_mint"))
        return ev.select(
            (F.col("seq") * 3 + offset).alias("frame"), i.alias("input_mint"), out_mint.alias("output_mint"), F.lit("ExactIn").alias("mode"), a.cast("string").alias("in_amount"), b.cast("string").alias("out_amount"),
            b.cast("string").alias("threshold"), F.lit(50).alias("slippage_bps"), (F.col("slot") + offset).alias("slot"), F.lit("0.001").alias("impact"), F.array(route).alias("routes"), i.alias("request_input"),
            out_mint.alias("request_output"), a.alias("request_amount"), F.lit(50).alias("request_slippage_bps"), (F.col("availability_ns") - 5).alias("observed_ns"))

    fwd = quote(0, F.col("token"), native, amount + pick(F.lit(0), _30=1), o)
    rev = quote(1, native, F.col("token"), cut, amount - 5)
    base = text(
        '{"executable":', pick("false", _7="true"), ',"owner":"', pick(TOKEN_2022, _8="other"), '","data":{"program":"', pick("spl-token-2022", _12="spl-token"), '","parsed":{"type":"', pick("mint", _9="account"),
        '","info":{"isInitialized":true,"mintAuthority":null,"freezeAuthority":', pick("null", _10='"k"'), ',"decimals":', pick("6", _16="256"), ',"supply":"', pick("1000", _17="1e3"),
        '","extensions":[{"extension":"metadataPointer","state":{"authority":null,"metadataAddress":"', pick(F.col("token"), _13="elsewhere"), '"}},{"extension":"', pick("tokenMetadata", _35="transferHook"),
        '","state":{"updateAuthority":', pick("null", _14='"k"'), ',"mint":"', F.col("token"), '","name":"n","symbol":"s","uri":"u","additionalMetadata":', pick("[]", _15='[["a"]]'), "}}", pick("", _11=',{"extension":"memo","state":{}}'), "]}}}}")
    vault = text(
        '{"executable":', pick("false", _34="true"), ',"owner":"', pick(TOKEN_2022, _18=TOKEN), '","data":{"program":"spl-token-2022","parsed":{"type":"', pick("account", _19="mint"), '","info":{"mint":"', F.col("token"), '","owner":"', F.col("name"),
        '","state":"', pick("initialized", _21="frozen"), '","tokenAmount":{"amount":', pick(F.concat(F.lit('"'), (amount * pick(F.lit(100), _28=0) + pick(F.lit(0), _28=amount - 5)).cast("string"), F.lit('"')), _24='"0"', _25="5"), "}",
        pick("", _22=',"delegate":"k"', _23=',"closeAuthority":"k"'), ',"extensions":[', pick('{"extension":"immutableOwner"}', _20='{"extension":"cpiGuard"}', _31=""), "]}}}}")
    other = text(
        '{"executable":false,"owner":"', F.lit(TOKEN), '","data":{"program":"spl-token","parsed":{"type":"account","info":{"mint":"', native, '","owner":"', F.col("name"),
        '","state":"initialized","delegate":null,"tokenAmount":{"amount":"', pick((o * 100).cast("string"), _27=cut.cast("string")), '"}}}}}')
    value = F.array(base, pick(mint_json(F.lit(TOKEN), F.lit("null")), _6="null"), vault, other, text('{"executable":', pick("false", _26="true"), ',"owner":"', F.lit(PROGRAM), '"}'))
    keys = F.array(F.col("token"), native, pick(vaults[0], _3=vaults[1]), vaults[1], F.col("name"))
    accounts = ev.select(
        (F.col("seq") * 3 + 2).alias("frame"), pick("getMultipleAccounts", _2="getAccountInfo").alias("request_method"), keys.alias("request_keys"), pick("confirmed", _4="processed").alias("commitment"),
        (F.col("slot") - pick(F.lit(0), _5=1)).alias("min_context_slot"), (F.col("slot") + pick(F.lit(1), _33=-1, _36=40)).alias("slot"), (F.col("availability_ns") - pick(F.lit(7), _32=6_000_000_000)).alias("observed_ns"), value.alias("value"))
    return plans, fwd.unionByName(rev), accounts


@query("sell_evidence", f"""WITH {EV}, r AS (SELECT *, {SELL_CODE} AS reason FROM sw) SELECT seq AS plan_id, reason, CASE WHEN reason = 'ok' THEN quote_raw * 1000000 END AS liquidity, CASE WHEN reason = 'ok' THEN base_raw * 1000 END AS size_raw FROM r""")
def sell_evidence(spark, sf):
    """Sales of Token-2022 tokens; every reason of the account and quote checks occurs."""
    p, q, a = sell_tables(spark, sf)
    e = E.evidence_join(p, q, a, NATIVE, PROGRAM, POLICY)
    return e.select("plan_id", "reason", F.col("liquidity_quote_raw").cast("bigint").alias("liquidity"), "size_raw")


@query("reassessed_decisions", f"""WITH {EV}, r AS (SELECT *, {CODE} AS reason FROM sw),
v AS (SELECT seq, reason, quote_raw * 100 > 900000 OR quote_raw * 10000 < 20000000 OR seq % 5 = 0 AS veto, CASE WHEN seq % 23 BETWEEN 1 AND 17 THEN seq % 2 ELSE 2 END AS st FROM r),
w AS (SELECT seq AS plan_id, CASE WHEN reason <> 'ok' THEN reason WHEN veto THEN 'risk_veto' ELSE 'intent' END AS result, st FROM v)
SELECT plan_id, result, CASE st WHEN 0 THEN 'intent' WHEN 1 THEN result ELSE 'risk_veto' END AS stored, CASE st WHEN 0 THEN result = 'intent' WHEN 1 THEN true ELSE result = 'risk_veto' END AS agrees FROM w""")
def reassessed_decisions(spark, sf):
    p, q, a = evidence_tables(spark, sf)
    p = p.withColumns({"kill": F.col("plan_id") % 5 == 0, "exposure": F.lit(0), "positions": F.lit(0), "loss": F.lit(0)})
    code = F.expr(CODE.replace("seq", "plan_id"))
    stored = p.select("plan_id", F.expr("case when plan_id % 23 between 1 and 17 then plan_id % 2 else 2 end").alias("st"), code.alias("c"))
    stored = stored.select("plan_id", F.when(F.col("st") == 0, "intent").when(F.col("st") == 1, F.col("c")).otherwise("risk_veto").alias("result"))
    return E.reassess(p, q, a, stored, NATIVE, PROGRAM, POLICY).select("plan_id", "result", "stored", "agrees")


def positions(spark, sf):
    """Entries at pool creations, analyses at failed events of the same pool after an entry."""
    ev = events(spark, sf)
    made = ev.where("kind = 'pool_created'")
    entries = made.select("pool", F.col("seq").alias("entry_id"), F.col("availability_ns").alias("entry_ns"), F.col("quote_raw").alias("entry_quote_raw"), F.col("base_raw").alias("units"), (F.col("quote_raw") * 200000).alias("entry_reserve"))
    o = Ordered(ev, ["pool"], ["availability_ns", "seq"]).last_seen("entry_id", F.col("seq"), F.col("kind") == "pool_created")
    a = o.result().where("kind = 'failed' and entry_id is not null")
    a = a.select(
        F.col("seq").alias("analysis_id"), "entry_id", "pool", F.col("availability_ns").alias("as_of"), F.expr("case when seq % 19 <> 1 then quote_raw % 900 - 800 end").alias("momentum_bps"), F.expr("base_raw * 100 - 8000").alias("imbalance_bps"),
        F.expr("seq % 5 - 2").alias("acceleration_bps"), (F.col("quote_raw") * 100000).alias("quote_reserve"), (F.col("base_raw") + 40).alias("quote_impact_bps"), F.expr("seq % 11 <> 1").alias("risk_allowed"), F.expr("seq % 13 <> 1").alias("evidence_proven"),
        F.expr("if(seq % 17 = 1, 1, 0)").alias("history_missing"))
    return entries, a


BPSX = "CAST((CAST({q} AS HUGEINT) * {b0} - CAST({q0} AS HUGEINT) * {b}) * 10000 // (CAST({q0} AS HUGEINT) * {b}) AS BIGINT)"
HEALTH = f"""WITH {EV}, en AS (SELECT pool, seq AS entry_id, availability_ns AS t0, quote_raw AS eq, base_raw AS eb FROM ev WHERE kind = 'pool_created'),
x AS (SELECT e.*, n.entry_id, n.t0, n.eq, n.eb FROM ev e ASOF JOIN en n ON e.pool = n.pool AND e.availability_ns > n.t0),
an AS (SELECT seq AS analysis_id, *, CASE WHEN seq % 19 <> 1 THEN quote_raw % 900 - 800 END AS m, base_raw * 100 - 8000 AS fl, seq % 5 - 2 AS acc, (quote_raw * 100000 - eq * 200000) * 10000 // (eq * 200000) AS lc, base_raw + 40 AS imp FROM x WHERE kind = 'failed'),
mk AS (SELECT a.analysis_id, count(s.seq) AS n, min({BPSX.format(q='s.quote_raw', b='s.base_raw', q0='a.eq', b0='a.eb')}) AS lo, max({BPSX.format(q='s.quote_raw', b='s.base_raw', q0='a.eq', b0='a.eb')}) AS hi,
  arg_max({BPSX.format(q='s.quote_raw', b='s.base_raw', q0='a.eq', b0='a.eb')}, s.availability_ns) AS last, arg_max({{q: s.quote_raw, b: s.base_raw}}, s.availability_ns) AS lp, arg_max({{q: s.quote_raw, b: s.base_raw}}, s.quote_raw / s.base_raw) AS pk, max(s.quote_raw / s.base_raw) AS pp
  FROM an a JOIN x s ON s.kind = 'swap' AND s.entry_id = a.entry_id AND s.availability_ns <= a.availability_ns GROUP BY a.analysis_id),
sg AS (SELECT a.*, mk.* EXCLUDE (analysis_id), list_filter([CASE WHEN m <= -200 AND fl < 0 THEN 'momentum_and_flow_deterioration' END, CASE WHEN lc <= -2000 THEN 'liquidity_deterioration' END, CASE WHEN imp >= 100 THEN 'execution_deterioration' END], lambda z: z IS NOT NULL) AS sig,
  m IS NULL OR seq % 17 = 1 AS lack FROM an a LEFT JOIN mk ON mk.analysis_id = a.analysis_id),
pr AS (SELECT *, lag(len(sig)) OVER w AS pn, lag(lack) OVER w AS pl, lag(availability_ns) OVER w AS pa FROM sg WINDOW w AS (PARTITION BY entry_id ORDER BY availability_ns)),
fs AS (SELECT *, coalesce(NOT pl AND availability_ns - pa <= 86400000000000 AND pn >= 2 AND len(sig) >= 2, false) AS persistent FROM pr)
"""


@query("position_health", HEALTH + f"""SELECT analysis_id, entry_id, coalesce(n, 0) AS observed_samples, last AS return_since_entry_bps, CASE WHEN n > 0 THEN least(0, lo) END AS mae, CASE WHEN n > 0 THEN greatest(0, hi) END AS mfe,
 CASE WHEN n > 0 THEN CASE WHEN pp > eq / eb THEN {BPSX.format(q='lp.q', b='lp.b', q0='pk.q', b0='pk.b')} ELSE last END END AS drawdown, lc AS liquidity_change_bps, array_to_string(sig, ',') AS signals, persistent,
 CASE WHEN lack THEN 'UNKNOWN' WHEN persistent THEN 'INVALIDATED' WHEN len(sig) > 0 OR m < 0 OR fl < 0 THEN 'WEAKENING' WHEN m > 0 AND fl >= 0 AND acc > 0 THEN 'STRENGTHENING' ELSE 'INTACT' END AS thesis_state,
 CASE WHEN seq % 11 = 1 THEN 'VETO' WHEN seq % 13 = 1 OR lack THEN 'HOLD' WHEN persistent THEN 'EXIT_CANDIDATE' ELSE 'HOLD' END AS action FROM fs""")
def position_health(spark, sf):
    entries, a = positions(spark, sf)
    h = E.position_health(a, events(spark, sf), entries, persist_ns=86400 * 1_000_000_000)
    return h.select("analysis_id", "entry_id", F.coalesce("observed_samples", F.lit(0)).alias("observed_samples"), "return_since_entry_bps", F.col("mae_observed_bps").alias("mae"), F.col("mfe_observed_bps").alias("mfe"),
                    F.col("drawdown_from_peak_bps").alias("drawdown"), "liquidity_change_bps", join("signals"), "persistent", "thesis_state", "action")


# two positions of a pool at every analysis: the newest and the oldest one, both open
OPEN_HEALTH = f"""WITH {EV}, en AS (SELECT pool, seq AS entry_id, availability_ns AS t0, quote_raw AS eq, base_raw AS eb, seq % 5 AS thesis FROM ev WHERE kind = 'pool_created'),
fe AS (SELECT pool, arg_min(entry_id, t0) AS entry_id FROM en GROUP BY pool),
x AS (SELECT e.*, n.entry_id, 0 AS side FROM ev e ASOF JOIN en n ON e.pool = n.pool AND e.availability_ns > n.t0 WHERE e.kind = 'failed'
 UNION ALL SELECT e.*, n.entry_id, 1 AS side FROM ev e JOIN fe ON fe.pool = e.pool JOIN en n ON n.entry_id = fe.entry_id AND e.availability_ns > n.t0 WHERE e.kind = 'failed'),
an AS (SELECT x.seq * 2 + side AS analysis_id, x.*, t0, eq, eb, thesis, CASE WHEN seq % 19 <> 1 THEN quote_raw % 900 - 800 END AS m, base_raw * 100 - 8000 AS fl, seq % 5 - 2 AS acc,
 (quote_raw * 100000 - eq * 200000) * 10000 // (eq * 200000) AS lc, base_raw + 40 AS imp FROM x JOIN en USING (pool, entry_id)),
mk AS (SELECT a.analysis_id, count(s.seq) AS n, min({BPSX.format(q='s.quote_raw', b='s.base_raw', q0='a.eq', b0='a.eb')}) AS lo, max({BPSX.format(q='s.quote_raw', b='s.base_raw', q0='a.eq', b0='a.eb')}) AS hi,
  arg_max({BPSX.format(q='s.quote_raw', b='s.base_raw', q0='a.eq', b0='a.eb')}, s.availability_ns) AS last, arg_max({{q: s.quote_raw, b: s.base_raw}}, s.availability_ns) AS lp,
  arg_max({{q: s.quote_raw, b: s.base_raw}}, s.quote_raw / s.base_raw) AS pk, max(s.quote_raw / s.base_raw) AS pp
  FROM an a JOIN sw s ON s.pool = a.pool AND s.availability_ns > a.t0 AND s.availability_ns <= a.availability_ns GROUP BY a.analysis_id),
sg AS (SELECT a.*, mk.* EXCLUDE (analysis_id), list_filter([CASE WHEN m <= -200 AND fl < 0 THEN 'momentum_and_flow_deterioration' END, CASE WHEN lc <= -2000 THEN 'liquidity_deterioration' END, CASE WHEN imp >= 100 THEN 'execution_deterioration' END], lambda z: z IS NOT NULL) AS sig,
  list_sort(list_filter([CASE WHEN m IS NULL THEN 'momentum_bps' END, CASE WHEN seq % 17 = 1 THEN 'context:history.continuity' END], lambda z: z IS NOT NULL)) AS miss FROM an a LEFT JOIN mk USING (analysis_id)),
pr AS (SELECT *, lag(len(sig)) OVER w AS pn, lag(len(miss)) OVER w AS pl, lag(availability_ns) OVER w AS pa, lag(imp) OVER w AS pi FROM
 (SELECT *, row_number() OVER (PARTITION BY entry_id, availability_ns ORDER BY analysis_id DESC) AS newest FROM sg) WHERE newest = 1 WINDOW w AS (PARTITION BY entry_id ORDER BY availability_ns)),
fs AS (SELECT s.*, coalesce(p.pl = 0 AND s.availability_ns - p.pa <= 86400000000000 AND p.pn >= 2 AND len(s.sig) >= 2, false) AS persistent, s.imp - p.pi AS impact_change,
  s.seq % 7 = 3 AND s.seq % 13 <> 1 AS quoted, (s.seq % 3) * 60 * 1000000000 AS quote_age
  FROM sg s JOIN pr p ON s.entry_id = p.entry_id AND s.availability_ns = p.availability_ns)
SELECT analysis_id, entry_id, coalesce(n, 0) AS observed_samples, last AS return_since_entry_bps, CASE WHEN n > 0 THEN least(0, lo) END AS mae, CASE WHEN n > 0 THEN greatest(0, hi) END AS mfe,
 CASE WHEN n > 0 THEN CASE WHEN pp > eq / eb THEN {BPSX.format(q='lp.q', b='lp.b', q0='pk.q', b0='pk.b')} ELSE last END END AS drawdown, lc AS liquidity_change_bps, availability_ns - t0 AS position_age_ns, impact_change AS exit_impact_change_bps,
 thesis AS entry_thesis, array_to_string(sig, ',') AS signals, array_to_string(miss, ',') AS missing, persistent,
 CASE WHEN len(miss) > 0 THEN 'UNKNOWN' WHEN persistent THEN 'INVALIDATED' WHEN len(sig) > 0 OR m < 0 OR fl < 0 THEN 'WEAKENING' WHEN m > 0 AND fl >= 0 AND acc > 0 THEN 'STRENGTHENING' ELSE 'INTACT' END AS thesis_state,
 CASE WHEN seq % 11 = 1 THEN 'VETO' WHEN seq % 13 = 1 OR len(miss) > 0 THEN 'HOLD' WHEN persistent THEN 'EXIT_CANDIDATE' ELSE 'HOLD' END AS action,
 CASE WHEN seq % 11 = 1 THEN 'stale' WHEN seq % 13 = 1 THEN 'evidence_not_proven' WHEN len(miss) > 0 THEN array_to_string([('missing:' || k) FOR k IN miss], ',')
  WHEN persistent THEN array_to_string(sig, ',') ELSE 'joint_deterioration_not_persistent' END AS reasons,
 CASE WHEN quoted AND quote_age <= 60000000000 AND availability_ns - quote_age >= t0 AND seq % 2 = 0 THEN 'PROVEN' ELSE 'UNKNOWN' END AS exit_quote_status,
 CASE WHEN quoted AND quote_age <= 60000000000 AND availability_ns - quote_age >= t0 AND seq % 2 = 0 THEN least(quote_raw, (quote_raw + 50) * 9975 // 10000) - 3 - eq END AS exit_result FROM fs"""


@query("open_position_health", OPEN_HEALTH)
def open_position_health(spark, sf):
    """Overlapping positions, with reasons, age, change of the exit impact, the thesis carried along and the exit result at full size."""
    ev = events(spark, sf)
    entries, newest = positions(spark, sf)
    entries = entries.withColumns({"cost": F.col("entry_quote_raw"), "token": F.lit("T"), "quote_mint": F.lit("N"), "thesis": F.pmod("entry_id", F.lit(5))})
    oldest = entries.groupBy("pool").agg(F.min_by("entry_id", "entry_ns").alias("entry_id"))
    first = ev.where("kind = 'failed'").withColumnRenamed("seq", "analysis_id").join(oldest, "pool").join(entries.select("entry_id", "entry_ns"), "entry_id").where(F.col("availability_ns") > F.col("entry_ns"))
    rows = newest.select((F.col("analysis_id") * 2).alias("analysis_id"), "entry_id", F.col("analysis_id").alias("seq")).unionByName(
        first.select((F.col("analysis_id") * 2 + 1).alias("analysis_id"), "entry_id", F.col("analysis_id").alias("seq")))
    a = rows.join(newest.drop("entry_id").withColumnRenamed("analysis_id", "seq"), "seq")
    a = a.withColumns({"required_missing": F.when(F.col("seq") % 17 == 1, F.array(F.lit("history.continuity"), F.lit("quote_reserve"))), "risk_reasons": F.array(F.lit("stale")), "exit_frame": F.col("analysis_id")}).drop("history_missing")
    e = ev.select("seq", "quote_raw", "availability_ns")
    q = rows.where("seq % 7 = 3").join(e, "seq").join(entries.select("entry_id", "units"), "entry_id").select(
        F.col("analysis_id").alias("frame"), F.lit("T").alias("input_mint"), F.lit("N").alias("output_mint"), (F.col("units") + F.col("seq") % 2).alias("input_raw"),
        (F.col("quote_raw") + 50).alias("output_raw"), F.col("quote_raw").alias("minimum_raw"), (F.col("availability_ns") - (F.col("seq") % 3) * F.lit(60_000_000_000)).alias("observed_ns"))
    h = E.position_health(a, ev, entries, persist_ns=86400 * 1_000_000_000, quotes=q, ttl_ns=60_000_000_000, fee=3)
    return h.select("analysis_id", "entry_id", F.coalesce("observed_samples", F.lit(0)).alias("observed_samples"), "return_since_entry_bps", F.col("mae_observed_bps").alias("mae"), F.col("mfe_observed_bps").alias("mfe"),
                    F.col("drawdown_from_peak_bps").alias("drawdown"), "liquidity_change_bps", "position_age_ns", "exit_impact_change_bps", "entry_thesis", join("signals"), join("missing"), "persistent", "thesis_state", "action",
                    join("reasons"), "exit_quote_status", F.col("indicative_exit_result_raw").cast("bigint").alias("exit_result"))
