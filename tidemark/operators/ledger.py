"""Ledger replay, cycle pairing, costs and censuses.

State that looks sequential is read off the previous row of the right key: the previous row of
an intent says whether a settlement is due, the previous fill of an asset whether it is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import price
from .features import flags
from .ordered import Ordered, Split, measured

# Cost categories in reporting order.
COST_CATEGORIES = ("network", "priority", "DEX", "LP", "creator", "ATA-create", "ATA-close-or-refund", "other", "price-impact", "adverse-movement", "paper-slippage")


def _one_key(df: DataFrame, account):
    return (df, account) if account in df.columns else (df.withColumn(account, F.lit(0)), account)


def _replay(ledger: DataFrame, initial: int, account: str, split: Split, waiting: Split | None = None, cash: bool = True, assets_last: bool = False) -> DataFrame:
    """Settlements in their account, asset and intent; what is not asked for is not carried.

    ``waiting``: the split of the intents, if none of them is cut; then intents stay in, with ``__done`` (something settled or cancelled them)
    and ``__nth`` (how many rows of this intent there were), if they are not done or have no account. ``assets_last``: rows come grouped by asset.
    """
    by_account = measured(ledger, [account], "seq", split) if cash else None
    is_fill = F.col("kind") == "settlement"
    flow = F.coalesce("quote_received", F.lit(0)) - F.coalesce("quote_spent", F.lit(0))
    rows = ledger.where(F.col("kind").isin("intent", "settlement", "cancel")).withColumn("__i", F.coalesce("intent_id", "id"))
    if waiting is None:
        waiting = _finer(rows, account, "__i", split, by_account)
        keep = is_fill
    else:
        rows = rows.withColumns({"__closes": is_closing() & F.col("intent_id").isNotNull(), "__one": (F.col("kind") == "intent").cast("int")})
        keep = is_fill | ((F.col("kind") == "intent") & (~F.col("__done") | F.col(account).isNull()))
    o = Ordered(rows, [account, "__i"], ["seq"], waiting)
    o.previous(["kind", "side", "mint"], __kind="kind", __side="side", __mint="mint")
    if "__one" in rows.columns:
        w = o.window(ties=["kind", "side", "mint"])
        o.add(__done=F.max("__closes").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
              __nth=F.sum("__one").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fills = o.result().where(keep).withColumns({
        "side": F.when(is_fill, F.coalesce("__side", "side")).otherwise(F.col("side")), "mint": F.when(is_fill, F.coalesce("__mint", "mint")).otherwise(F.col("mint")),
        "__due": F.coalesce(F.col("__kind") == "intent", F.lit(False)), "__fill": is_fill}).drop("__kind", "__side", "__mint", "__closes", "__one")

    def with_open(df):
        if not cash:
            return df
        o = Ordered(df, [account, "mint", "__fill"], ["seq"], _finer(ledger, account, "mint", split, by_account)) if assets_last else Ordered(
            df, [account, "mint"], ["seq"], _finer(ledger, account, "mint", split, by_account))
        return o.previous(["side", "base_units", "quote_spent"], __o_side="side", __o_units="base_units", __o_cost="quote_spent", __o_id="id", __o_seq="seq").result()

    def with_cash(df):
        if not cash:
            return df
        # the sums of segments need nothing of what was found above, so the rows are not written for them
        sums = ledger.where(is_fill).withColumn("__fill", F.lit(True))
        o = Ordered(df, [account], ["seq"], by_account, again=sums).running(__flow=("sum", F.when(F.col("__fill"), flow)))
        return o.result().withColumn("cash_after", F.lit(initial) + F.col("__flow")).drop("__flow")

    return with_open(with_cash(fills)) if assets_last else with_cash(with_open(fills))


def is_closing() -> Column:
    return F.col("kind").isin("settlement", "cancel")


def _finer(df: DataFrame, account: str, key: str, split: Split, by_account: Split | None) -> Split:
    """The split by account and ``key``: an intent or asset of a hot account is rarely hot itself; then its rows meet without being cut."""
    if by_account is not None and not by_account.cuts:
        return by_account
    return measured(df, [account, key], "seq", split, many=True)


def _judged(df: DataFrame) -> DataFrame:
    flow = F.coalesce("quote_received", F.lit(0)) - F.coalesce("quote_spent", F.lit(0))
    is_open = F.coalesce(F.col("__o_side") == "BUY", F.lit(False))
    buy = F.col("side") == "BUY"
    position = F.struct(F.col("__o_side").alias("side"), F.col("__o_units").alias("units"), F.col("__o_cost").alias("cost"), F.col("__o_id").alias("entry_id"), F.col("__o_seq").alias("seq"))
    return df.withColumns({
        "cash_before": F.col("cash_after") - flow,
        "realized": F.when(~buy & is_open, F.col("quote_received") - F.col("__o_cost")),
        "violation": F.when(~F.col("__due"), "settlement_without_intent").when(buy & ((F.col("cash_after") < 0) | is_open), "paper_cash_or_position")
        .when(~buy & ~is_open, "sell_without_position").when(~buy & (F.col("base_units") != F.col("__o_units")), "paper_sell_units"),
        "open": F.when(is_open & ~buy, position),
    }).drop("__i", "__due", "__fill", "__o_side", "__o_units", "__o_cost", "__o_id", "__o_seq")


def ledger_rows(ledger: DataFrame, initial: int, account: str = "account", split: Split = Split()) -> DataFrame:
    """Settlements with cash after them, the position they close, and a violation where the sequence is impossible.

    ledger: account, seq, id, kind (intent / reject / settlement / cancel), intent_id, side, mint, base_units, quote_spent, quote_received.
    """
    ledger, account = _one_key(ledger, account)
    return _judged(_replay(ledger, initial, account, split))


def _whole_intents(ledger: DataFrame, account: str, split: Split) -> Split | None:
    """The split of intents if each is known by its id alone and none is cut: then what waits is seen where settlements meet their intents."""
    odd = (F.col("kind") == "intent") & (F.col("id").isNull() | (F.col("intent_id") != F.col("id")))
    if not ledger.where(odd).isEmpty():
        return None
    by_account = measured(ledger, [account], "seq", split)
    found = _finer(ledger.withColumn("__i", F.coalesce("intent_id", "id")), account, "__i", split, by_account)
    return None if found.cuts else found


def ledger_state(ledger: DataFrame, initial: int, account: str = "account", split: Split = Split()) -> DataFrame:
    """Per account: cash, open positions, realised result, losses, pending intents and the first impossible row (null = clean)."""
    ledger, account = _one_key(ledger, account)
    flow = F.coalesce("quote_received", F.lit(0)) - F.coalesce("quote_spent", F.lit(0))
    whole = _whole_intents(ledger, account, split)
    is_intent = F.col("kind") == "intent"
    if whole is None:
        # an intent is pending when nothing settled or cancelled it
        one = ledger.groupBy(account, F.when(is_intent, F.col("id")).otherwise(F.col("intent_id")).alias("i")).agg(
            F.max("seq").alias("seq"), F.max(is_intent).alias("intent"), F.max(is_closing()).alias("done"))
        base = one.groupBy(account).agg(F.max("seq").alias("sequence"), F.count_if(F.col("intent") & ~F.col("done")).alias("__pending"))
        fills = ledger_rows(ledger, initial, account, split).withColumns({"__wait": F.lit(0), "__fill": F.lit(True)})
    else:
        base = ledger.groupBy(account).agg(F.max("seq").alias("sequence"), F.lit(0).cast("bigint").alias("__pending"))
        rows = _replay(ledger, initial, account, split, whole, assets_last=True).withColumn("__is", F.col("__fill"))
        fills = _judged(rows).withColumnRenamed("__is", "__fill").withColumn("__wait", F.when(~F.col("__fill") & ~F.col("__done") & (F.col("__nth") == 1), 1).otherwise(0))
    own = F.col("__fill")
    assets = fills.groupBy(account, "mint", "__fill").agg(
        F.sum(F.when(own, flow)).alias("flow"), F.sum(F.when(own, F.col("realized"))).alias("pnl"), F.sum(F.when(own, F.greatest(F.lit(0), -F.col("realized")))).alias("loss"),
        F.min(F.when(own & F.col("violation").isNotNull(), F.struct("seq", "violation"))).alias("bad"), F.max_by(F.struct("side", "quote_spent"), "seq").alias("l"), F.sum("__wait").alias("wait"))
    held = own & (F.col("l.side") == "BUY")
    sums = assets.groupBy(F.col(account).alias("__account")).agg(
        F.sum("flow").alias("flow"), F.sum("pnl").alias("pnl"), F.sum("loss").alias("loss"), F.min("bad").alias("bad"),
        F.count_if(held).alias("positions"), F.sum(F.when(held, F.col("l.quote_spent"))).alias("exposure"), F.sum("wait").alias("__wait"))
    out = base.join(sums, F.col(account).eqNullSafe(F.col("__account")), "left")
    # rows without an account have no cash or positions, only pending intents
    out = out.withColumns({c: F.when(F.col(account).isNotNull(), F.col(c)) for c in ("flow", "pnl", "loss", "bad", "positions", "exposure")})
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("pnl", "loss", "positions", "exposure")}
    return out.withColumns({**zero, "pending": F.col("__pending") + F.coalesce("__wait", F.lit(0)), "cash": F.lit(initial) + F.coalesce("flow", F.lit(0)), "first_violation": F.col("bad.seq"), "violation": F.col("bad.violation")}).select(
        account, "sequence", "cash", "positions", "exposure", F.col("pnl").alias("realized_pnl"), "loss", "pending", "first_violation", "violation")


def pair_cycles(fills: DataFrame, keys, order, split: Split = Split()) -> DataFrame:
    """Each sell with the buy directly before it in its asset; other columns come back as ``entry``.

    fills: keys, order columns, side (BUY / SELL), quote_raw, base_units and whatever identifies the fill.
    """
    fills = fills.where(F.col("side").isin("BUY", "SELL"))
    rest = [c for c in fills.columns if c not in keys]
    o = Ordered(fills, keys, order, split).last_seen("entry", F.struct(*rest))
    return o.result().where((F.col("side") == "SELL") & (F.col("entry.side") == "BUY")).withColumn("pnl", F.col("quote_raw") - F.col("entry.quote_raw"))


def cycle_report(cycles: DataFrame) -> DataFrame:
    """Prices, latencies, cash and results of closed cycles.

    Columns with buy_ and sell_ prefixes: decision_in, decision_out, settled_in, settled_out, decision_ns, settlement_ns,
    quote_ns, fee, spent / received; cash_before.
    """
    net = F.col("sell_received") - F.col("buy_spent")
    fees = F.col("buy_fee") + F.col("sell_fee")
    out = {
        "decision_buy_price": price("buy_decision_in", "buy_decision_out"), "settlement_buy_price": price("buy_settled_in", "buy_settled_out"),
        "decision_sell_price": price("sell_decision_out", "sell_decision_in"), "settlement_sell_price": price("sell_settled_out", "sell_settled_in"),
        "buy_latency_ns": F.col("buy_settlement_ns") - F.col("buy_decision_ns"), "sell_latency_ns": F.col("sell_settlement_ns") - F.col("sell_decision_ns"),
        "buy_quote_age_ns": F.col("buy_settlement_ns") - F.col("buy_quote_ns"), "sell_quote_age_ns": F.col("sell_settlement_ns") - F.col("sell_quote_ns"),
        "holding_duration_ns": F.col("sell_settlement_ns") - F.col("buy_settlement_ns"),
        "cash_after_buy": F.col("cash_before") - F.col("buy_spent"), "cash_after_sell": F.col("cash_before") + net,
        "gross_before_fixed_fees": net + fees, "fixed_fees": fees, "net": net,
        "fee_share_of_loss": F.when(net < 0, price(fees, -net)),
    }
    return cycles.withColumns(out)


def decision_lookahead(intents: DataFrame, fills: DataFrame, quotes: DataFrame, delay_slots: int = 1) -> DataFrame:
    """Violations: decision evidence later than the decision, or settlement evidence not later than it.

    intents: id, decision_ns, decision_slot, quote_frame; fills: intent_id, quote_frame; quotes: frame, observed_ns, slot.
    """
    q = quotes.select(F.col("frame").alias("quote_frame"), F.col("observed_ns").alias("q_ns"), F.col("slot").alias("q_slot"))
    d = intents.join(q, "quote_frame").where(F.col("q_ns") > F.col("decision_ns")).select("id", F.lit("measurement_lookahead").alias("violation"))
    s = fills.join(q, "quote_frame").join(intents.select(F.col("id").alias("intent_id"), "decision_ns", "decision_slot"), "intent_id")
    s = s.where((F.col("q_ns") <= F.col("decision_ns")) | (F.col("q_slot") < F.col("decision_slot") + delay_slots))
    return d.unionByName(s.select(F.col("intent_id").alias("id"), F.lit("measurement_future_or_slot_violation").alias("violation")))


def cost_rows(fills: DataFrame) -> DataFrame:
    """Eleven cost rows per fill: known ones with amount and keys, the rest UNKNOWN with a null amount.

    A row whose amount turns out null is UNKNOWN too; it keeps its treatment and keys, so a total over it stays unknown.

    fills: fill_id, side, available_at, fee, output_raw (quoted), base_units, quote_received, output_mint, impact, quote_ns.
    """
    got = F.when(F.col("side") == "BUY", F.col("base_units")).otherwise(F.col("quote_received") + F.col("fee"))
    split_keys = F.array(*[F.concat_ws(":", F.col("fill_id").cast("string"), F.lit(c)) for c in COST_CATEGORIES[:8]])
    empty = F.array().cast("array<string>")

    def row(category, amount=None, unit=None, mode="UNKNOWN", treatment="unknown", key=None, parts=None, at=None):
        null = F.lit(None)
        return F.struct(
            F.lit(category).alias("category"), (null if amount is None else amount).cast("string").alias("amount"), (F.lit("lamports") if unit is None else unit).alias("unit"),
            (F.lit(mode) if amount is None else F.when(amount.isNull(), "UNKNOWN").otherwise(mode)).alias("mode"), F.lit(treatment).alias("treatment"), (null if at is None else at).cast("bigint").alias("available_at"),
            (null if key is None else F.concat_ws(":", F.col("fill_id").cast("string"), F.lit(key))).cast("string").alias("accounting_key"), (empty if parts is None else parts).alias("component_keys"))

    known = {
        "other": row("other", F.col("fee"), mode="SIMULATED", treatment="separate", key="legacy_fixed_fee", parts=split_keys, at=F.col("available_at")),
        "paper-slippage": row("paper-slippage", F.col("output_raw") - got, F.concat("output_mint", F.lit(":raw")), "SIMULATED", "descriptive_only", "haircut", at=F.col("available_at")),
        "price-impact": row("price-impact", F.col("impact"), F.lit("provider_fraction"), "PROVEN", "descriptive_only", at=F.col("quote_ns")),
    }
    return fills.select("fill_id", F.inline(F.array(*[known.get(c, row(c)) for c in COST_CATEGORIES])))


def separate_total(costs: DataFrame, as_of: int | None = None, unit: str = "lamports", by: str = "fill_id") -> DataFrame:
    """Sum of separate rows per group: null when any is unknown, with the first rule that is broken."""
    sep = costs.where(F.col("treatment") == "separate")
    keys = sep.select(by, F.explode(F.array_union(F.array("accounting_key"), "component_keys")).alias("k"))
    repeated = keys.groupBy(by, "k").agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(
        F.max((F.col("n") > 1) | F.col("k").isNull()).alias("clash"))
    future = F.lit(False) if as_of is None else F.coalesce(F.max(F.col("available_at") > as_of), F.lit(False))
    all_ = costs.groupBy(by).agg(future.alias("future"))
    s = sep.groupBy(by).agg(
        F.max(F.col("amount").isNull()).alias("unknown"), F.sum(F.expr("try_cast(amount as bigint)")).alias("sum"),
        F.max(F.col("amount").isNotNull() & ((F.col("unit") != unit) | F.expr("try_cast(amount as bigint)").isNull())).alias("mixed"))
    out = all_.join(s, by, "left").join(repeated, by, "left")
    violation = F.when(F.col("future"), "cost_not_yet_available").when(F.col("clash"), "duplicate_or_missing_accounting_key").when(F.col("mixed"), "incompatible_cost_units")
    return out.select(by, F.when(violation.isNull() & ~F.coalesce("unknown", F.lit(False)), F.coalesce("sum", F.lit(0))).alias("total"), violation.alias("violation"))


def rejection_counts(results: DataFrame) -> DataFrame:
    """Rejections by reason; a reject without reasons counts under its code."""
    r = results.where(F.col("kind") == "reject")
    reasons = F.when(F.coalesce(F.size("reasons"), F.lit(0)) > 0, F.col("reasons")).otherwise(F.array(F.coalesce("code", F.lit("risk_veto"))))
    return r.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def session_metrics(ledger: DataFrame) -> DataFrame:
    """One row: intents, buys, sells, pending and the session state."""
    done = ledger.where(F.col("kind").isin("settlement", "cancel")).select(F.col("intent_id").alias("id")).distinct()
    pend = ledger.where(F.col("kind") == "intent").join(done, "id", "left_anti").agg(F.count(F.lit(1)).alias("pending"), F.min(F.struct("seq", "side"))["side"].alias("pending_side"))
    c = ledger.agg(
        F.count_if(F.col("kind") == "intent").alias("intents"), F.count_if((F.col("kind") == "settlement") & F.col("quote_spent").isNotNull()).alias("buys"),
        F.count_if((F.col("kind") == "settlement") & F.col("quote_received").isNotNull()).alias("sells"))
    out = c.join(F.broadcast(pend), how="cross")  # two one-row tables
    state = F.when(F.col("pending") > 0, F.concat(F.lit("PENDING_"), F.col("pending_side"))).when(F.col("buys") > F.col("sells"), "OPEN_POSITION").when(
        F.col("sells") > 0, "ROUNDTRIP_OBSERVED").otherwise("NO_TRADE")
    return out.withColumn("state", state).drop("pending_side")


def decision_census(plans: DataFrame, results: DataFrame, key: str = "plan_id") -> DataFrame:
    """Every plan with its outcome kind; one without a result is pending."""
    return plans.join(results.select(key, F.col("kind").alias("result_kind")), key, "left").withColumn("result_kind", F.coalesce("result_kind", F.lit("pending")))


def missing_census(plans: DataFrame, census: DataFrame, key: str = "plan_id") -> DataFrame:
    return plans.join(census.select(key).distinct(), key, "left_anti")


def pair_class(native: str) -> Column:
    return F.when(F.col("quote") == native, "SUPPORTED").when(F.col("token") == native, "POTENTIALLY_SUPPORTABLE").otherwise("REJECT")


def pair_sources(decisions: DataFrame, native: str) -> DataFrame:
    """The decisions behind each pair of ``pair_audit`` as rows, since a common pair may have any number of them."""
    have = [c for c in ("pool", "provenance") if c in decisions.columns]
    return decisions.select("token", "quote", pair_class(native).alias("classification"), F.col("id").alias("snapshot"), *have,
                            F.coalesce(F.col("result_code") == "unsupported_quote_currency", F.lit(False)).alias("unsupported_quote_rejection"))


def pair_audit(decisions: DataFrame, native: str) -> DataFrame:
    """Decisions by (token, quote): frequency, unsupported-quote rejections, classification; ``pair_sources`` has the decisions."""
    kind = pair_class(native)
    g = decisions.groupBy("token", "quote").agg(
        F.count(F.lit(1)).alias("frequency"), F.count_if(F.col("result_code") == "unsupported_quote_currency").alias("unsupported_quote_rejections"))
    return g.withColumn("classification", kind)


def evidence_proven_audit(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("evidence_status") == "PROVEN").select("id", "token", "quote", "score", "missing", "action")


def result_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(F.coalesce("result_code", "result_kind").alias("result")).agg(F.count(F.lit(1)).alias("n"))


def position_review(cycles: DataFrame, health: DataFrame) -> DataFrame:
    """Per cycle the analyses up to its settlement: how many, the first exit candidate and the last state.

    cycles: cycle_id, settlement_ns. health: entry_id, analysis_id, as_of, action, thesis_state. Only a combinable
    summary of each path is kept; ``position_paths`` gives the path itself as rows.
    """
    p = position_paths(cycles, health)
    exit_ = F.min(F.when(F.col("action") == "EXIT_CANDIDATE", F.struct("as_of", "analysis_id")))
    last = F.max(F.struct("as_of", "analysis_id", "thesis_state"))
    g = p.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("analyses"), exit_.alias("x"), last.alias("l"))
    return cycles.select("cycle_id").join(g, "cycle_id", "left").select(
        "cycle_id", F.coalesce("analyses", F.lit(0)).alias("analyses"), F.col("x.analysis_id").alias("first_exit_candidate"), F.col("l.thesis_state").alias("last_state"))


def position_paths(cycles: DataFrame, health: DataFrame) -> DataFrame:
    h = health.withColumnRenamed("entry_id", "cycle_id")
    return h.join(cycles.select("cycle_id", "settlement_ns"), "cycle_id").where(F.col("as_of") <= F.col("settlement_ns"))


def follow_targets(ledger: DataFrame, account: str = "account", split: Split = Split()) -> DataFrame:
    """Per account the first pending intent, else the first open position, with the slot to look after.

    ledger: as in ``ledger_rows`` plus decision_slot (intents), quote_slot (settlements).
    """
    ledger, account = _one_key(ledger, account)
    whole = _whole_intents(ledger, account, split)
    if whole is None:
        done = ledger.where(is_closing()).select(account, F.col("intent_id").alias("id")).distinct()
        pend = ledger.where(F.col("kind") == "intent").join(done, [account, "id"], "left_anti").withColumn("__fill", F.lit(False))
        rows = pend.unionByName(_replay(ledger, 0, account, split, cash=False), allowMissingColumns=True)
    else:
        rows = _replay(ledger, 0, account, split, whole, cash=False)
    own = F.col("__fill")
    assets = rows.groupBy(account, "mint").agg(
        F.max(F.when(own, F.struct("seq", "side", "quote_slot"))).alias("l"),
        F.min(F.when(~own, F.struct(F.lit(0).alias("rank"), "seq", F.concat(F.lit("PENDING_"), F.col("side")).alias("phase"), "mint", F.col("decision_slot").alias("after_slot")))).alias("p"))
    held = F.when(F.col("l.side") == "BUY", F.struct(F.lit(1).alias("rank"), F.col("l.seq").alias("seq"), F.lit("OPEN_POSITION").alias("phase"), "mint", F.col("l.quote_slot").alias("after_slot")))
    pick = assets.withColumn("t", F.least("p", held)).where(F.col("t").isNotNull()).groupBy(account).agg(F.min("t").alias("t"))
    return pick.select(account, "t.phase", "t.mint", "t.after_slot")
