"""Ledger queries: one asset per part, one account per supplier group, order over all columns."""

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators.ordered import Ordered, Split
from .registry import query
from .rules_q import HEALTH, positions
from .views import SWAP, EV, FILL_ORDER, landed, FILL_ORDER_SQL, FILLS, events, fills

INITIAL = 1_000_000_000


def numbered(spark, sf):
    """Fills with their global position in ledger order."""
    f = fills(spark, sf).withColumn("log", F.lit(0))
    return Ordered(f, ["log"], FILL_ORDER, again=f).running(seq=("sum", F.lit(1))).result().drop("log")


def ledger(spark, sf):
    return landed(spark, sf, "ledger", lambda: _ledger(spark, sf))


def _ledger(spark, sf):
    """An intent and a settlement (or cancel) per fill; some settlements have lost their intent, some intents stay open."""
    f = numbered(spark, sf).withColumns({"account": F.col("s") % 7, "iid": F.concat(F.lit("i"), F.col("seq"))})
    nothing, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def row(keep, seq, id_, kind, intent, units, spent, received, decided, quoted):
        return F.when(keep, F.struct(seq.alias("seq"), id_.alias("id"), kind.alias("kind"), intent.alias("intent_id"), units.alias("base_units"), spent.alias("quote_spent"),
                                     received.alias("quote_received"), decided.alias("decision_slot"), quoted.alias("quote_slot")))

    q = F.col("quote_raw")
    first = row(F.col("seq") % 53 != 0, F.col("seq") * 2, F.col("iid"), F.lit("intent"), no_text, nothing, nothing, nothing, F.col("o"), nothing)
    second = row(F.col("seq") % 211 != 5, F.col("seq") * 2 + 1, F.concat(F.lit("x"), F.col("seq")), F.when(F.col("side") == "CANCEL", "cancel").otherwise("settlement"), F.col("iid"), F.col("base_units"),
                 F.when(F.col("side") == "BUY", q), F.when(F.col("side") == "SELL", q), nothing, F.col("o"))
    return f.select("account", "side", "mint", F.inline(F.array_compact(F.array(first, second))))


LEDGER = f"""WITH {FILLS}, fs AS (SELECT *, row_number() OVER (ORDER BY {FILL_ORDER_SQL}) AS seq, s % 7 AS account FROM fl),
se AS (SELECT *, seq * 2 + 1 AS ls, CASE WHEN side = 'BUY' THEN -quote_raw ELSE quote_raw END AS flow FROM fs WHERE side <> 'CANCEL' AND seq % 211 <> 5),
w1 AS (SELECT *, lag(side) OVER w AS ps, lag(base_units) OVER w AS pu, lag(quote_raw) OVER w AS pc, lag('x' || seq) OVER w AS pid FROM se WINDOW w AS (PARTITION BY account, mint ORDER BY seq)),
lr AS (SELECT *, {INITIAL} + CAST(sum(flow) OVER (PARTITION BY account ORDER BY seq) AS BIGINT) AS cash_after FROM w1),
lv AS (SELECT *, CASE WHEN side = 'SELL' AND ps = 'BUY' THEN quote_raw - pc END AS realized, CASE WHEN seq % 53 = 0 THEN 'settlement_without_intent' WHEN side = 'BUY' AND (cash_after < 0 OR ps = 'BUY') THEN 'paper_cash_or_position'
 WHEN side = 'SELL' AND coalesce(ps, '') <> 'BUY' THEN 'sell_without_position' WHEN side = 'SELL' AND base_units <> pu THEN 'paper_sell_units' END AS violation FROM lr),
lp AS (SELECT account, mint, arg_max(side, seq) AS side, arg_max(quote_raw, seq) AS cost, arg_max(o, seq) AS o, max(ls) AS ls FROM se GROUP BY ALL)"""


@query("ledger_rows", LEDGER + " SELECT ls AS seq, account, mint, side, cash_after, realized, violation FROM lv")
def ledger_rows(spark, sf):
    return L.ledger_rows(ledger(spark, sf), INITIAL).select("seq", "account", "mint", "side", "cash_after", "realized", "violation")


@query("ledger_states", LEDGER + f""", a AS (SELECT account, {INITIAL} + CAST(sum(flow) AS BIGINT) AS cash, CAST(coalesce(sum(realized), 0) AS BIGINT) AS realized_pnl, CAST(coalesce(sum(greatest(0, -realized)), 0) AS BIGINT) AS loss, min(ls) FILTER (WHERE violation IS NOT NULL) AS first_violation,
 arg_min(violation, ls) FILTER (WHERE violation IS NOT NULL) AS violation FROM lv GROUP BY account), o AS (SELECT account, count(*) AS positions, CAST(sum(cost) AS BIGINT) AS exposure FROM lp WHERE side = 'BUY' GROUP BY account),
p AS (SELECT account, count(*) AS pending FROM fs WHERE seq % 211 = 5 AND seq % 53 <> 0 GROUP BY account)
SELECT account, cash, positions, exposure, realized_pnl, loss, coalesce(pending, 0) AS pending, first_violation, violation FROM a LEFT JOIN o USING (account) LEFT JOIN p USING (account)""")
def ledger_states(spark, sf):
    return L.ledger_state(ledger(spark, sf), INITIAL).drop("sequence")


@query("ledger_states_hot_accounts", LEDGER + " SELECT ls AS seq, account, mint, side, cash_after, realized, violation FROM lv")
def ledger_states_hot_accounts(spark, sf):
    """Ledger rows with every account cut into segments."""
    return L.ledger_rows(ledger(spark, sf), INITIAL, split=Split(3000)).select("seq", "account", "mint", "side", "cash_after", "realized", "violation")


PAIRS = f"""WITH {FILLS}, f2 AS (SELECT * FROM fl WHERE side <> 'CANCEL'), p AS (SELECT *, lag(side) OVER w AS ps, lag(quote_raw) OVER w AS pq, lag(base_units) OVER w AS pb, lag(t) OVER w AS pt, lag(o) OVER w AS po, lag(d) OVER w AS pd, lag(a) OVER w AS pa FROM f2 WINDOW w AS (PARTITION BY mint ORDER BY {FILL_ORDER_SQL})),
cy AS (SELECT * FROM p WHERE side = 'SELL' AND ps = 'BUY')"""


@query("paired_cycles", PAIRS + " SELECT mint, po AS buy_order, o AS sell_order, quote_raw - pq AS pnl FROM cy")
def paired_cycles(spark, sf):
    c = L.pair_cycles(fills(spark, sf), ["mint"], FILL_ORDER)
    return c.select("mint", F.col("entry.o").alias("buy_order"), F.col("o").alias("sell_order"), "pnl")


@query("cycle_reports", PAIRS + """ SELECT mint, po AS buy_order, o AS sell_order, CAST(pq * 1000 // pb AS BIGINT) AS settlement_buy_milli, t - pt AS holding_duration_ns, (quote_raw - pq) AS net, quote_raw - pq + 2000 AS gross_before_fixed_fees, 100000 - pq AS cash_after_buy,
 CASE WHEN quote_raw < pq THEN 2000 * 1000000 // (pq - quote_raw) END AS fee_share_micro FROM cy""")
def cycle_reports(spark, sf):
    c = L.pair_cycles(fills(spark, sf), ["mint"], FILL_ORDER)
    c = c.select(
        "mint", F.col("entry.o").alias("buy_order"), F.col("o").alias("sell_order"), F.lit(100000).alias("cash_before"),
        F.col("entry.quote_raw").alias("buy_decision_in"), F.col("entry.base_units").alias("buy_decision_out"), F.col("entry.quote_raw").alias("buy_settled_in"), F.col("entry.base_units").alias("buy_settled_out"),
        F.col("base_units").alias("sell_decision_in"), F.col("quote_raw").alias("sell_decision_out"), F.col("base_units").alias("sell_settled_in"), F.col("quote_raw").alias("sell_settled_out"),
        F.col("entry.t").alias("buy_settlement_ns"), F.col("entry.t").alias("buy_decision_ns"), F.col("entry.t").alias("buy_quote_ns"), F.col("t").alias("sell_settlement_ns"), F.col("t").alias("sell_decision_ns"), F.col("t").alias("sell_quote_ns"),
        F.lit(1000).alias("buy_fee"), F.lit(1000).alias("sell_fee"), F.col("entry.quote_raw").alias("buy_spent"), F.col("quote_raw").alias("sell_received"))
    r = L.cycle_report(c)
    return r.select("mint", "buy_order", "sell_order", F.floor(F.col("settlement_buy_price") * 1000).cast("bigint").alias("settlement_buy_milli"), "holding_duration_ns", "net", "gross_before_fixed_fees", "cash_after_buy",
                    F.floor(F.col("fee_share_of_loss") * 1000000).cast("bigint").alias("fee_share_micro"))


@query("decision_lookahead", f"""WITH {EV} SELECT 'i' || seq AS id, 'measurement_lookahead' AS violation FROM sw WHERE seq % 31 = 2 UNION ALL
SELECT 'i' || seq, 'measurement_future_or_slot_violation' FROM sw WHERE seq % 37 = 3 OR seq % 41 = 4""")
def decision_lookahead(spark, sf):
    ev = events(spark, sf).where(SWAP)
    intents = ev.select(F.concat(F.lit("i"), F.col("seq")).alias("id"), F.col("availability_ns").alias("decision_ns"), F.col("slot").alias("decision_slot"), (F.col("seq") * 2).alias("quote_frame"))
    settled = ev.select(F.concat(F.lit("i"), F.col("seq")).alias("intent_id"), (F.col("seq") * 2 + 1).alias("quote_frame"))
    quotes = ev.select((F.col("seq") * 2).alias("frame"), (F.col("availability_ns") + F.when(F.col("seq") % 31 == 2, 1).otherwise(-1)).alias("observed_ns"), F.col("slot").alias("slot")).unionByName(
        ev.select((F.col("seq") * 2 + 1).alias("frame"), (F.col("availability_ns") + F.when(F.col("seq") % 37 == 3, 0).otherwise(9)).alias("observed_ns"), (F.col("slot") + F.when(F.col("seq") % 41 == 4, 0).otherwise(1)).alias("slot")))
    return L.decision_lookahead(intents, settled, quotes)


def cost_fills(spark, sf):
    return numbered(spark, sf).where("side <> 'CANCEL'").select(
        F.col("seq").alias("fill_id"), "side", F.col("t").alias("available_at"), F.when(F.col("seq") % 97 != 5, F.col("a") * 100).alias("fee"), F.when(F.col("side") == "BUY", F.col("base_units") + 3).otherwise(F.col("quote_raw") + 50).alias("output_raw"),
        "base_units", (F.col("quote_raw") - F.col("a") * 100).alias("quote_received"), F.lit("m").alias("output_mint"), F.lit("0.001").alias("impact"), F.col("t").alias("quote_ns"))


COSTS = f"""WITH {FILLS}, fs AS (SELECT *, row_number() OVER (ORDER BY {FILL_ORDER_SQL}) AS seq FROM fl), cf AS (SELECT seq AS fill_id, side, a * 100 AS fee FROM fs WHERE side <> 'CANCEL' AND seq % 97 <> 5)
"""


@query("cost_rows", COSTS + """, af AS (SELECT seq AS fill_id, side, CASE WHEN seq % 97 <> 5 THEN a * 100 END AS fee FROM fs WHERE side <> 'CANCEL')
SELECT fill_id, c AS category, CASE c WHEN 'other' THEN CAST(fee AS VARCHAR) WHEN 'paper-slippage' THEN CASE WHEN side = 'BUY' THEN '3' WHEN fee IS NOT NULL THEN '50' END WHEN 'price-impact' THEN '0.001' END AS amount,
 CASE WHEN c = 'price-impact' THEN 'PROVEN' WHEN fee IS NOT NULL AND c IN ('other', 'paper-slippage') OR side = 'BUY' AND c = 'paper-slippage' THEN 'SIMULATED' ELSE 'UNKNOWN' END AS mode, CASE c WHEN 'other' THEN 'separate' WHEN 'paper-slippage' THEN 'descriptive_only' WHEN 'price-impact' THEN 'descriptive_only' ELSE 'unknown' END AS treatment,
 CASE c WHEN 'other' THEN fill_id || ':legacy_fixed_fee' WHEN 'paper-slippage' THEN fill_id || ':haircut' END AS accounting_key, CASE c WHEN 'other' THEN 8 ELSE 0 END AS parts
FROM af, (SELECT unnest(['network', 'priority', 'DEX', 'LP', 'creator', 'ATA-create', 'ATA-close-or-refund', 'other', 'price-impact', 'adverse-movement', 'paper-slippage']) AS c)""")
def cost_rows(spark, sf):
    c = L.cost_rows(cost_fills(spark, sf))
    return c.select("fill_id", "category", "amount", "mode", "treatment", "accounting_key", F.size("component_keys").alias("parts"))


@query("separate_totals", COSTS + """SELECT fill_id, CASE WHEN fill_id % 101 = 3 OR fill_id % 103 = 4 THEN NULL ELSE fee END AS total, CASE WHEN fill_id % 103 = 4 THEN 'duplicate_or_missing_accounting_key' WHEN fill_id % 101 = 3 THEN 'incompatible_cost_units' END AS violation FROM cf
UNION ALL SELECT seq, NULL, NULL FROM fs WHERE side <> 'CANCEL' AND seq % 97 = 5 AND seq % 103 <> 4 AND seq % 101 <> 3
UNION ALL SELECT seq, NULL, 'duplicate_or_missing_accounting_key' FROM fs WHERE side <> 'CANCEL' AND seq % 97 = 5 AND seq % 103 = 4 UNION ALL SELECT seq, NULL, NULL FROM fs WHERE side <> 'CANCEL' AND seq % 97 = 5 AND seq % 101 = 3 AND seq % 103 <> 4""")
def separate_totals(spark, sf):
    c = L.cost_rows(cost_fills(spark, sf))
    c = c.withColumn("unit", F.when((F.col("fill_id") % 101 == 3) & (F.col("category") == "other"), "usd").otherwise(F.col("unit")))
    twice = c.where("category = 'other' and fill_id % 103 = 4").withColumns({"accounting_key": F.concat(F.lit("again"), F.col("fill_id"))})
    return L.separate_total(c.unionByName(twice)).select("fill_id", "total", "violation")


@query("session_metrics", LEDGER + """ SELECT (SELECT count(*) FROM fs WHERE seq % 53 <> 0) AS intents, count(*) FILTER (WHERE side = 'BUY') AS buys, count(*) FILTER (WHERE side = 'SELL') AS sells, (SELECT count(*) FROM fs WHERE seq % 211 = 5 AND seq % 53 <> 0) AS pending,
 (SELECT 'PENDING_' || arg_min(side, seq) FROM fs WHERE seq % 211 = 5 AND seq % 53 <> 0) AS state FROM se""")
def session_metrics(spark, sf):
    return L.session_metrics(ledger(spark, sf))


@query("rejection_counts", f"""WITH {EV}, r AS (SELECT CASE WHEN seq % 3 = 0 THEN ['kill_switch', 'position_limit'] ELSE [] END AS reasons, CASE WHEN seq % 3 = 1 THEN 'quote_expired' END AS code FROM ev WHERE kind = 'failed'),
u AS (SELECT unnest(CASE WHEN len(reasons) > 0 THEN reasons ELSE [coalesce(code, 'risk_veto')] END) AS reason FROM r) SELECT reason, count(*) AS n FROM u GROUP BY 1""")
def rejection_counts(spark, sf):
    r = events(spark, sf).select(F.when(F.col("kind") == "failed", "reject").otherwise("hold").alias("kind"), F.expr("if(seq % 3 = 0, array('kill_switch', 'position_limit'), cast(array() as array<string>))").alias("reasons"),
                                 F.expr("if(seq % 3 = 1, 'quote_expired', null)").alias("code"))
    return L.rejection_counts(r)


@query("decision_census", f"WITH {EV} SELECT seq AS plan_id, pool, CASE WHEN seq % 9 = 4 THEN 'pending' ELSE instruction END AS result_kind FROM sw")
def decision_census(spark, sf):
    ev = events(spark, sf).where(SWAP)
    return L.decision_census(ev.select(F.col("seq").alias("plan_id"), "pool"), ev.where("seq % 9 <> 4").select(F.col("seq").alias("plan_id"), F.col("instruction").alias("kind")))


@query("missing_census", f"WITH {EV} SELECT seq AS plan_id FROM sw WHERE seq % 9 = 4")
def missing_census(spark, sf):
    ev = events(spark, sf).where(SWAP).select(F.col("seq").alias("plan_id"))
    return L.missing_census(ev, ev.where("plan_id % 9 <> 4"))


def decisions(spark, sf):
    return events(spark, sf).where(SWAP).select(
        F.col("seq").alias("id"), F.expr("if(seq % 5 = 0, 'native', concat('t', pool))").alias("token"), F.expr("if(seq % 5 in (1, 2), 'native', concat('q', wallet))").alias("quote"), F.expr("if(seq % 3 = 0, 'unsupported_quote_currency', null)").alias("result_code"),
        F.col("instruction").alias("result_kind"), F.expr("if(seq % 4 = 0, 'PROVEN', 'MISSING')").alias("evidence_status"), F.expr("if(seq % 8 <> 0, quote_raw, null)").alias("score"),
        F.expr("if(seq % 8 = 0, array('momentum_bps'), cast(array() as array<string>))").alias("missing"), F.lit("NO_TRADE").alias("action"))


DEC = f"""WITH {EV}, d AS (SELECT seq AS id, CASE WHEN seq % 5 = 0 THEN 'native' ELSE 't' || pool END AS token, CASE WHEN seq % 5 IN (1, 2) THEN 'native' ELSE 'q' || wallet END AS quote, CASE WHEN seq % 3 = 0 THEN 'unsupported_quote_currency' END AS result_code, instruction AS result_kind,
 CASE WHEN seq % 8 <> 0 THEN quote_raw END AS score FROM sw)"""


@query("pair_audit", DEC + " SELECT token, quote, count(*) AS frequency, count(result_code) AS unsupported_quote_rejections, CASE WHEN quote = 'native' THEN 'SUPPORTED' WHEN token = 'native' THEN 'POTENTIALLY_SUPPORTABLE' ELSE 'REJECT' END AS classification FROM d GROUP BY token, quote")
def pair_audit(spark, sf):
    return L.pair_audit(decisions(spark, sf), "native")


@query("pair_sources", DEC + " SELECT id AS snapshot, token, quote, CASE WHEN quote = 'native' THEN 'SUPPORTED' WHEN token = 'native' THEN 'POTENTIALLY_SUPPORTABLE' ELSE 'REJECT' END AS classification, result_code IS NOT NULL AS unsupported_quote_rejection FROM d")
def pair_sources(spark, sf):
    return L.pair_sources(decisions(spark, sf), "native")


@query("evidence_proven", DEC + " SELECT id, token, quote, score, CASE WHEN id % 8 = 0 THEN 'momentum_bps' ELSE '' END AS missing, 'NO_TRADE' AS action FROM d WHERE id % 4 = 0")
def evidence_proven(spark, sf):
    return L.evidence_proven_audit(decisions(spark, sf)).withColumn("missing", F.array_join("missing", ","))


@query("result_counts", DEC + " SELECT coalesce(result_code, result_kind) AS result, count(*) AS n FROM d GROUP BY 1")
def result_counts(spark, sf):
    return L.result_counts(decisions(spark, sf))


@query("position_reviews", HEALTH + """, c AS (SELECT entry_id AS cycle_id, t0 + 200000000000000 AS until FROM en),
h AS (SELECT c.cycle_id, f.analysis_id, f.availability_ns AS t, f.seq % 7 = 1 AS x FROM c LEFT JOIN fs f ON f.entry_id = c.cycle_id AND f.availability_ns <= c.until)
SELECT cycle_id, count(analysis_id) AS analyses, arg_min(analysis_id, t) FILTER (WHERE x) AS first_exit_candidate, 's' || max(analysis_id) AS last_state FROM h GROUP BY cycle_id""")
def position_reviews(spark, sf):
    entries, a = positions(spark, sf)
    health = a.withColumns({"action": F.expr("if(analysis_id % 7 = 1, 'EXIT_CANDIDATE', 'HOLD')"), "thesis_state": F.concat(F.lit("s"), F.col("analysis_id"))})
    return L.position_review(entries.select(F.col("entry_id").alias("cycle_id"), (F.col("entry_ns") + 200_000_000_000_000).alias("settlement_ns")), health)


@query("follow_targets", LEDGER + """, k AS (SELECT account, 0 AS rank, seq * 2 AS seq, 'PENDING_' || side AS phase, mint, o AS after_slot FROM fs WHERE seq % 211 = 5 AND seq % 53 <> 0
 UNION ALL SELECT account, 1, ls, 'OPEN_POSITION', mint, o FROM lp WHERE side = 'BUY')
SELECT account, arg_min(phase, rank * 1000000000 + seq) AS phase, arg_min(mint, rank * 1000000000 + seq) AS mint, arg_min(after_slot, rank * 1000000000 + seq) AS after_slot FROM k GROUP BY account""")
def follow_targets(spark, sf):
    return L.follow_targets(ledger(spark, sf))
