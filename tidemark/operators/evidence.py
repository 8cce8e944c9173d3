"""Evidence joins: event x forward quote x reverse quote x accounts, with freshness and slot bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import WIDE, change_bps, haircut_output, price_key, return_bps, u64, wide
from ..functions.jsonio import variant, variant_type
from .features import flags, is_sample
from .intervals import interval_extrema
from .ordered import Ordered, Split
from .rules import RiskPolicy, Thresholds, invalidation, risk_veto
from .validate import first_reason, mint_reason, quote_valid, unset, vault_reason

def judged_accounts(accounts: DataFrame, program: str) -> DataFrame:
    """Account frames -> what the frame alone says: ``verdict``, both reserves and token programs; the account documents stay behind.

    Columns: frame, request_method, request_keys (array), commitment, min_context_slot, slot, observed_ns, value (array of JSON
    documents: base mint, quote mint, base vault, quote vault, pool). The accounts are judged under the keys they were asked for;
    ``accounts_proof`` then binds these to the event.
    """
    df = accounts.withColumns({f"__v{i}": F.try_parse_json(F.get("value", F.lit(i))) for i in range(5)})
    key = [F.get("request_keys", F.lit(i)) for i in range(5)]
    missing = F.coalesce(F.size("value") != 5, F.lit(True)) | F.exists("value", lambda x: x.isNull() | F.trim(x).isin("null", "{}", ""))
    steps = [F.when(missing, "account_missing")]
    for i in (0, 1):
        steps.append(F.nullif(mint_reason(f"__v{i}", key[i]), F.lit("ok")))
    reserves = {}
    for i, name in ((2, "base"), (3, "quote")):
        v, info = f"__v{i}", "$.data.parsed.info"
        own = (variant(v, f"{info}.mint") == key[i - 2]) & (variant(v, f"{info}.owner") == key[4]) & (variant(v, f"{info}.state") == "initialized")
        amount = f"{info}.tokenAmount.amount"
        held = F.when(variant_type(v, amount) == "STRING", u64(variant(v, amount)))
        reserves[f"{name}_reserve_raw"] = held
        steps += [
            F.nullif(vault_reason(v, variant(f"__v{i - 2}", "$.owner")), F.lit("ok")),
            F.when(~F.coalesce(own, F.lit(False)), "vault_identity_or_frozen"),
            F.when(~(unset(v, f"{info}.delegate") & unset(v, f"{info}.closeAuthority")), "vault_authority_or_extensions"),
            F.when(~F.coalesce(held > 0, F.lit(False)), "invalid_reserve"),
        ]
    steps.append(F.when(~F.coalesce((variant("__v4", "$.owner") == program) & (variant_type("__v4", "$.executable") == "BOOLEAN") & ~variant("__v4", "$.executable", "boolean"), F.lit(False)), "pool_program_mismatch"))
    out = df.withColumns({"verdict": F.coalesce(*steps, F.lit("ok")), **reserves, "token_programs": F.array(*[variant(f"__v{i}", "$.owner") for i in (0, 1)])})
    return out.select("frame", "request_method", "request_keys", "commitment", "min_context_slot", F.col("slot").alias("account_slot"), F.col("observed_ns").alias("account_ns"),
                      "verdict", *reserves, "token_programs")


def accounts_proof(df: DataFrame, ttl_ns: int = 5_000_000_000) -> DataFrame:
    """Events beside their ``judged_accounts`` -> ``accounts_reason``: binding, commitment, freshness, slot, then the frame's own verdict.

    Columns besides those of ``judged_accounts``: slot, pool, base_mint, quote_mint, base_vault, quote_vault, now.
    """
    late = ~((F.col("account_ns") <= F.col("now")) & (F.col("now") <= F.col("account_ns") + ttl_ns))
    bound = (F.col("request_method") == "getMultipleAccounts") & (F.col("request_keys") == F.array("base_mint", "quote_mint", "base_vault", "quote_vault", "pool"))
    steps = [
        F.when(F.col("account_ns").isNull(), "accounts_stale_or_future"),  # no such frame
        F.when(~F.coalesce(bound, F.lit(False)), "accounts_binding_mismatch"),
        F.when(~F.coalesce((F.col("commitment") == "confirmed") & (F.col("min_context_slot") >= F.col("slot")), F.lit(False)), "account_commitment_or_slot"),
        F.when(F.coalesce(late, F.lit(True)), "accounts_stale_or_future"),
        F.when(~F.coalesce(F.col("account_slot") >= F.col("slot"), F.lit(False)), "accounts_before_event"),
        F.nullif(F.col("verdict"), F.lit("ok")),
    ]
    return df.withColumn("accounts_reason", F.coalesce(*steps, F.lit("ok")))


def evidence_join(events: DataFrame, quotes: DataFrame, accounts: DataFrame, native: str, program: str, policy: RiskPolicy = RiskPolicy(),
                  ttl_ns: int = 5_000_000_000, adverse_bps: int = 25) -> DataFrame:
    """Plans with their evidence -> opportunity columns, or the first failing reason.

    events: plan_id, pool, base_mint, quote_mint, base_vault, quote_vault, slot, availability_ns, side, amount, now, forward_frame,
    reverse_frame, accounts_frame. quotes: frame and the ``quote_valid`` columns plus observed_ns. accounts: as in ``judged_accounts``.
    Quotes and accounts are judged before they are joined, so routes and account documents are never shuffled: joins on frame ids move
    verdicts, slots, times and amounts.
    """
    leg = F.get("routes", F.lit(0))
    fits = (leg["percent"] == 100) & (leg["input_mint"] == F.col("input_mint")) & (leg["output_mint"] == F.col("output_mint"))
    q = quote_valid(quotes).select(
        "frame", F.struct("input_mint", "output_mint", u64("in_amount").alias("input_raw"), u64("out_amount").alias("output_raw"), u64("threshold").alias("minimum_raw"),
                          "slippage_bps", "slot", "observed_ns", F.expr("try_cast(impact as decimal(38,18))").alias("impact"), F.size("routes").alias("legs"),
                          F.when(fits, leg["amm_key"]).alias("route_pool"), "reason").alias("q"))
    judged = judged_accounts(accounts, program).withColumnRenamed("frame", "accounts_frame")
    df = (
        events.join(q.select(F.col("frame").alias("forward_frame"), F.col("q").alias("f")), "forward_frame", "left")
        .join(q.select(F.col("frame").alias("reverse_frame"), F.col("q").alias("r")), "reverse_frame", "left")
        .join(judged, "accounts_frame", "left")
    )
    df = accounts_proof(df, ttl_ns)
    now = F.col("now")
    buy = F.col("side") == "BUY"
    give, take = F.when(buy, F.lit(native)).otherwise(F.col("base_mint")), F.when(buy, F.col("base_mint")).otherwise(F.lit(native))
    out = haircut_output("f.minimum_raw", "f.output_raw", adverse_bps)
    df = df.withColumn("forward_output_raw", out)
    pairs = [
        (~F.col("side").isin("BUY", "SELL"), "invalid_side"),
        (~((F.col("availability_ns") <= now) & (now <= F.col("availability_ns") + policy.max_age_ns)), "event_stale_or_future"),
        (F.col("quote_mint") != native, "unsupported_quote_currency"),
    ]
    reason = first_reason(pairs)
    for s in ("f", "r"):
        reason = reason.when(F.col(s).isNull(), "quote_missing").when(F.col(f"{s}.reason") != "ok", F.col(f"{s}.reason"))
    reason = reason.when(F.col("accounts_reason") != "ok", F.col("accounts_reason"))
    for s in ("f", "r"):
        seen, slot = F.col(f"{s}.observed_ns"), F.col(f"{s}.slot")
        reason = (
            reason.when(F.coalesce(F.col(f"{s}.legs") != 1, F.lit(True)), "split_route_unsupported")
            .when(~F.col(f"{s}.route_pool").eqNullSafe(F.col("pool")), "route_pool_mismatch")
            .when(~F.coalesce((seen <= now) & (now <= seen + ttl_ns), F.lit(False)), "quote_stale_or_future")
            .when(~F.coalesce((F.col("slot") <= slot) & (slot <= F.col("slot") + 150), F.lit(False)), "quote_event_slot_divergence")
            .when(~F.coalesce(F.col(f"{s}.impact") * 10000 <= policy.max_slippage_bps, F.lit(False)), "price_impact_limit")
        )
    spread = F.greatest("f.slot", "r.slot", "account_slot") - F.least("f.slot", "r.slot", "account_slot")
    base, quote = F.col("base_reserve_raw"), F.col("quote_reserve_raw")
    reason = (
        reason.when(~F.coalesce(spread <= 16, F.lit(False)), "evidence_slot_divergence")
        .when(~F.coalesce((F.col("f.input_mint") == give) & (F.col("f.output_mint") == take) & (F.col("f.input_raw") == F.col("amount")), F.lit(False)), "forward_quote_mismatch")
        .when(~F.coalesce((F.col("r.input_mint") == take) & (F.col("r.output_mint") == give) & (F.col("r.input_raw").cast(WIDE) == F.col("forward_output_raw")), F.lit(False)),
              "reverse_quote_size_mismatch")
        .when(~F.coalesce((F.col("f.slippage_bps") <= policy.max_slippage_bps) & (F.col("r.slippage_bps") <= policy.max_slippage_bps), F.lit(False)), "quote_slippage_limit")
        .when(~F.coalesce(F.col("forward_output_raw") < F.when(buy, base).otherwise(quote).cast(WIDE), F.lit(False)), "output_exceeds_observed_vault")
        .when(~F.coalesce(F.col("r.output_raw") < F.when(buy, quote).otherwise(base), F.lit(False)), "exit_output_exceeds_observed_vault")
        .otherwise("ok")
    )
    df = df.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    times = ("f.observed_ns", "r.observed_ns", "account_ns")

    def known(c):
        return F.when(ok, c)

    return df.withColumns({
        "evidence_availability_ns": known(F.least(*times)), "heartbeat_ns": known(F.greatest(*times)),
        "data_health": known(F.lit("OBSERVED")), "coverage": known(F.lit("OBSERVED")), "authority_state": known(F.lit("OBSERVED_SAFE")),
        "quote_status": known(F.lit("OBSERVED")), "exit_possible": known(F.lit(True)), "quote_provenance": known(F.col("forward_frame")),
        "observed_ns": known(F.col("f.observed_ns")), "expires_ns": known(F.col("f.observed_ns") + ttl_ns), "size_raw": known(F.col("amount")),
        "slippage_bps": known(F.greatest(F.col("f.slippage_bps"), F.lit(adverse_bps))), "liquidity_quote_raw": known(quote)}).drop(
            "request_method", "request_keys", "commitment", "min_context_slot", "verdict")


def reassess(decisions: DataFrame, quotes: DataFrame, accounts: DataFrame, stored: DataFrame, native: str, program: str, policy: RiskPolicy,
             ttl_ns: int = 5_000_000_000, adverse_bps: int = 25) -> DataFrame:
    """Archived decisions evaluated again under a policy and compared with the stored result (plan_id, result)."""
    ev = evidence_join(decisions, quotes, accounts, native, program, policy, ttl_ns, adverse_bps)
    ev = ev.withColumns({"availability_ns": F.col("evidence_availability_ns"), "requested": F.col("amount")})
    ev = risk_veto(ev, policy)
    code = F.when(F.col("reason") != "ok", F.col("reason")).when(~F.col("risk_allowed"), "risk_veto").otherwise("intent")
    return ev.select("plan_id", code.alias("result"), "risk_reasons").join(stored.select("plan_id", F.col("result").alias("stored")), "plan_id", "left").withColumn(
        "agrees", F.col("result").eqNullSafe(F.col("stored")))


def position_health(analyses: DataFrame, marks: DataFrame, entries: DataFrame, t: Thresholds = Thresholds(), persist_ns: int = 15_000_000_000,
                    split: Split = Split(), quotes: DataFrame | None = None, ttl_ns: int = 5_000_000_000, adverse_bps: int = 25, fee: int = 0) -> DataFrame:
    """State of open positions at each analysis; any number of positions may be open in a pool.

    entries: pool, entry_id, entry_ns, entry_quote_raw, units, entry_reserve; where present also cost, token, quote_mint and ``thesis`` (carried along).
    analyses: analysis_id, entry_id, pool, as_of, momentum_bps, imbalance_bps, acceleration_bps, quote_reserve, quote_impact_bps,
    risk_allowed, evidence_proven, required_missing (names; or history_missing, a count), where present risk_reasons and exit_frame.
    marks: swap events of the pools. quotes (frame, input_mint, output_mint, input_raw, output_raw, minimum_raw, observed_ns): an analysis' exit
    quote counts if it sells the whole position and is fresh, and gives the indicative result after costs.
    Extrema of every analysis come from ``interval_extrema``. The analysis before is the last one with a smaller as_of.
    """
    carried = [c for c in ("cost", "token", "quote_mint", "thesis") if c in entries.columns]
    opened = entries.select("pool", "entry_id", "entry_ns", F.col("entry_quote_raw").alias("__eq"), "units", "entry_reserve", *[F.col(c).alias(f"entry_{c}") for c in carried])
    df = analyses.join(opened, ["pool", "entry_id"], "left")
    spans = df.where(F.col("entry_ns").isNotNull() & (F.col("as_of") >= F.col("entry_ns"))).select(
        "pool", F.col("analysis_id").alias("interval_id"), F.col("entry_ns").alias("from_ns"), F.col("as_of").alias("until_ns"))
    path = interval_extrema(marks.where(is_sample()), spans, "pool", split).withColumnRenamed("interval_id", "analysis_id")
    df = df.join(path, ["pool", "analysis_id"], "left")

    def vs_entry(c):
        return return_bps(f"{c}.quote_raw", f"{c}.base_raw", "__eq", "units")

    above = price_key("hi.quote_raw", "hi.base_raw") > price_key("__eq", "units")
    peak_q, peak_b = (F.when(above, F.col(f"hi.{c}")).otherwise(F.col(e)) for c, e in (("quote_raw", "__eq"), ("base_raw", "units")))
    seen = F.col("samples") > 0
    if "required_missing" in analyses.columns:
        history = F.transform(F.filter(F.coalesce("required_missing", F.array().cast("array<string>")), lambda k: k.startswith("history.")), lambda k: F.concat(F.lit("context:"), k))
    else:
        history = F.when(F.coalesce(F.col("history_missing") > 0, F.lit(False)), F.array(F.lit("context:history"))).otherwise(F.array().cast("array<string>"))
    lacking_fields = flags([(F.col(k).isNull(), k) for k in ("momentum_bps", "imbalance_bps", "quote_reserve", "quote_impact_bps")])
    df = df.withColumns({
        "observed_samples": F.col("samples"), "return_since_entry_bps": F.when(seen, vs_entry("last")),
        "mae_observed_bps": F.when(seen & vs_entry("lo").isNotNull(), F.least(F.lit(0).cast("bigint"), vs_entry("lo"))),
        "mfe_observed_bps": F.when(seen & vs_entry("hi").isNotNull(), F.greatest(F.lit(0).cast("bigint"), vs_entry("hi"))),
        "drawdown_from_peak_bps": F.when(seen, return_bps("last.quote_raw", "last.base_raw", peak_q, peak_b)),
        "liquidity_change_bps": change_bps("quote_reserve", "entry_reserve"),
        "position_age_ns": F.when(F.col("as_of") >= F.col("entry_ns"), F.col("as_of") - F.col("entry_ns")),
        "missing": F.array_sort(F.array_distinct(F.concat(lacking_fields, history))),
    })
    df = df.withColumn("signals", flags(invalidation(t))).drop("samples", "lo", "hi", "last")
    # one row for each time of a position, so analyses of one instant are not before each other
    key = ["pool", "entry_id"]
    state_of = F.struct(F.size("signals").alias("n"), F.size("missing").alias("miss"), F.col("as_of").alias("at"), F.col("quote_impact_bps").alias("impact"))
    times = df.groupBy(*key, "as_of").agg(F.max_by(state_of, "analysis_id").alias("state"))
    before = Ordered(times, key, ["as_of"], split).last_seen("prior", F.col("state")).result().select(*key, "as_of", "prior")
    df = df.join(before, [*key, "as_of"], "left")
    persistent = F.coalesce((F.col("prior.miss") == 0) & (F.col("as_of") - F.col("prior.at") <= persist_ns) & (F.col("prior.n") >= 2) & (F.size("signals") >= 2), F.lit(False))
    df = df.withColumns({"persistent": persistent, "exit_impact_change_bps": F.col("quote_impact_bps") - F.col("prior.impact")})
    m, flow, lacking = F.col("momentum_bps"), F.col("imbalance_bps"), F.size("missing") > 0
    state = (
        F.when(lacking, "UNKNOWN").when(F.col("persistent"), "INVALIDATED")
        .when((F.size("signals") > 0) | (m < 0) | (flow < 0), "WEAKENING")
        .when((m > 0) & (flow >= 0) & (F.col("acceleration_bps") > 0), "STRENGTHENING").otherwise("INTACT"))
    hard, proven = ~F.coalesce("risk_allowed", F.lit(False)), F.coalesce("evidence_proven", F.lit(False))
    action = F.when(hard, "VETO").when(~proven | lacking, "HOLD").when(F.col("persistent"), "EXIT_CANDIDATE").otherwise("HOLD")
    risk = F.coalesce(F.col("risk_reasons"), F.array().cast("array<string>")) if "risk_reasons" in analyses.columns else F.array().cast("array<string>")
    reasons = F.when(hard, risk).when(~proven, F.array(F.lit("evidence_not_proven"))).when(
        lacking, F.transform("missing", lambda k: F.concat(F.lit("missing:"), k))).when(
        F.col("persistent"), F.col("signals")).otherwise(F.array(F.lit("joint_deterioration_not_persistent")))
    df = df.withColumns({"thesis_state": state, "action": action, "reasons": reasons}).drop("prior", "__eq")
    if quotes is None:
        return df
    q = quotes.select(F.col("frame").alias("exit_frame"), F.struct("input_mint", "output_mint", "input_raw", "output_raw", "minimum_raw", "observed_ns").alias("__q"))
    df = df.join(q, "exit_frame", "left")
    whole = (
        proven & (wide("__q.input_raw") == wide("units")) & (F.col("__q.input_mint") == F.col("entry_token")) & (F.col("__q.output_mint") == F.col("entry_quote_mint"))
        & (F.col("entry_ns") <= F.col("__q.observed_ns")) & (F.col("__q.observed_ns") <= F.col("as_of")) & (F.col("as_of") <= F.col("__q.observed_ns") + ttl_ns))
    result = (haircut_output("__q.minimum_raw", "__q.output_raw", adverse_bps) - fee - wide("entry_cost")).cast(WIDE)
    known = F.coalesce(whole, F.lit(False))
    return df.withColumns({
        "exit_quote_status": F.when(known, "PROVEN").otherwise("UNKNOWN"), "indicative_exit_result_raw": F.when(known, result)}).drop("__q")
