"""Operations queries: customers are quotas, orders reservations, lineitem totals settlements."""

from pyspark.sql import functions as F

from ..operators import ops as O
from ..operators.ordered import Ordered, Split
from .registry import query
from .views import SWAP, EV, events, table


def quotas(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("quota"), (F.col("c_custkey") % 12 + 4).alias("requests"), F.greatest(F.lit(0), F.round(F.col("c_acctbal") * 20000).cast("bigint")).alias("units"))
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("quota"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("units"))
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("actual"))
    return c, r, s.where("key % 4 <> 1")


Q = """WITH c AS (SELECT c_custkey AS quota, c_custkey % 12 + 4 AS requests, greatest(0, CAST(round(c_acctbal * 20000) AS BIGINT)) AS units FROM customer),
r AS (SELECT o_custkey AS quota, o_orderkey AS ord, o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS units FROM orders),
s AS (SELECT l_orderkey AS key, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS actual FROM lineitem WHERE l_orderkey % 4 <> 1 GROUP BY 1)"""


@query("quota_usage", Q + """, g AS (SELECT quota, count(*) AS requests_used, CAST(sum(coalesce(actual, units)) AS BIGINT) AS charged_units, count(*) FILTER (WHERE actual IS NULL) AS unsettled, count(*) FILTER (WHERE actual > units) AS errors FROM r LEFT JOIN s USING (key) GROUP BY quota)
SELECT c.quota, requests, units, coalesce(requests_used, 0) AS requests_used, coalesce(charged_units, 0) AS charged_units, coalesce(unsettled, 0) AS unsettled, coalesce(errors, 0) AS errors,
 coalesce(errors, 0) = 0 AND coalesce(requests_used, 0) <= requests AND coalesce(charged_units, 0) <= units AS healthy FROM c LEFT JOIN g USING (quota)""")
def quota_usage(spark, sf):
    return O.quota_usage(*quotas(spark, sf))


BREACH = Q + """, u AS (SELECT r.*, CAST(sum(units) OVER w AS BIGINT) AS used, count(*) OVER w AS count FROM r WINDOW w AS (PARTITION BY quota ORDER BY ord)), v AS (SELECT u.*, c.requests, c.units AS lim FROM u JOIN c USING (quota) WHERE count > requests OR used > c.units)
SELECT quota, min(ord) AS ord, arg_min(key, ord) AS key, arg_min(used, ord) AS used, arg_min(count, ord) AS count, 'over_limit' AS reason FROM v GROUP BY quota"""


@query("quota_breaches", BREACH)
def quota_breaches(spark, sf):
    c, r, _ = quotas(spark, sf)
    return O.quota_breaches(r, c)


@query("quota_breaches_hot_quotas", BREACH)
def quota_breaches_hot_quotas(spark, sf):
    c, r, _ = quotas(spark, sf)
    return O.quota_breaches(r, c, Split(5))


@query("reservation_conflicts", "SELECT l_orderkey * 10 + l_linenumber AS key, count(*) AS reservations FROM lineitem GROUP BY 1 HAVING min(l_quantity) <> max(l_quantity)")
def reservation_conflicts(spark, sf):
    return O.reservation_conflicts(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_quantity").alias("units")))


@query("settlement_checks", Q + """, t AS (SELECT l_orderkey AS key, CAST(round(l_extendedprice * 100) AS BIGINT) AS actual FROM lineitem), g AS (SELECT key, min(actual) AS lo, max(actual) AS hi FROM t GROUP BY key)
SELECT g.key, CASE WHEN r.units IS NULL OR hi > r.units THEN 'unreserved_usage' ELSE 'settlement_conflict' END AS fault FROM g LEFT JOIN (SELECT * FROM r WHERE key % 10 <> 7) r USING (key) WHERE r.units IS NULL OR hi > r.units OR lo <> hi""")
def settlement_checks(spark, sf):
    _, r, _ = quotas(spark, sf)
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("actual"))
    return O.settlement_check(r.where("key % 10 <> 7"), t)


def observations(spark, sf):
    codes = F.expr("case when kind = 'failed' then array('decoder_errors', if(seq % 2 = 0, 'quota_exhausted', 'slots_unresolved')) when seq % 5 = 0 then array('waiting_for_finality') else cast(array() as array<string>) end")
    return events(spark, sf).select(F.col("pool").cast("string").alias("source"), F.col("seq").alias("id"), codes.alias("codes"), (F.col("kind") == "pool_created").alias("complete"))


ALERTS = f"""WITH {EV}, ob AS (SELECT CAST(pool AS VARCHAR) AS source, seq AS id, CASE WHEN kind = 'failed' THEN ['decoder_errors', CASE WHEN seq % 2 = 0 THEN 'quota_exhausted' ELSE 'slots_unresolved' END] WHEN seq % 5 = 0 THEN ['waiting_for_finality'] ELSE [] END AS codes, kind = 'pool_created' AS complete FROM ev),
cd AS (SELECT unnest(['quota_exhausted', 'slots_unresolved', 'decoder_errors', 'waiting_for_finality']) AS code),
mk AS (SELECT source, id, code, list_contains(codes, code) AS st FROM ob, cd WHERE complete OR list_contains(codes, code)),
tr AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY source, code ORDER BY id), false) AS pv FROM mk)"""


@query("alert_transitions", ALERTS + " SELECT source, code, id, CASE WHEN st THEN 'OPEN' ELSE 'RESOLVED' END AS state FROM tr WHERE st <> pv")
def alert_transitions(spark, sf):
    return O.alert_lifecycle(observations(spark, sf))


@query("alert_transitions_hot_sources", ALERTS + " SELECT source, code, id, CASE WHEN st THEN 'OPEN' ELSE 'RESOLVED' END AS state FROM tr WHERE st <> pv")
def alert_transitions_hot_sources(spark, sf):
    return O.alert_lifecycle(observations(spark, sf), split=Split(25))


@query("active_alerts", ALERTS + " SELECT source, code FROM mk GROUP BY source, code HAVING arg_max(st, id)")
def active_alerts(spark, sf):
    return O.active_alerts(observations(spark, sf))


@query("event_cursors", f"""WITH {EV}, p AS (SELECT DISTINCT pool, pool * 50 AS after_slot FROM ev), n AS (SELECT pool, max(seq % 4000) AS sl, arg_max(seq, {{a: seq % 4000, b: availability_ns}}) AS sq, arg_max(availability_ns, {{a: seq % 4000, b: availability_ns}}) AS av FROM ev GROUP BY pool)
SELECT pool, greatest(after_slot, sl) AS cursor_slot, sq AS cursor_seq, av AS cursor_availability_ns FROM p LEFT JOIN n USING (pool)""")
def event_cursors(spark, sf):
    ev = events(spark, sf).withColumn("slot", F.col("seq") % 4000)
    p = ev.select("pool").distinct().select("pool", (F.col("pool") * 50).alias("after_slot"), F.lit(0).cast("bigint").alias("decision_ns"))
    return O.cursor(ev, p)


def candidates(spark, sf):
    ev = events(spark, sf)
    listing = ev.select("pool", F.concat(F.lit("g"), F.col("seq") % 6007).alias("signature"), F.col("seq").alias("slot"), (F.col("kind") == "failed").alias("failed"))
    tries = ev.where("base_raw > 40").select(F.concat(F.lit("g"), F.col("seq") * 7 % 6007).alias("signature"), (F.col("quote_raw") % 9 == 0).alias("complete"))
    cursors = ev.select("pool").distinct().select("pool", (F.col("pool") * 20).alias("cursor_slot"), (F.col("pool") * 21).alias("after_slot"))
    return O.candidate_states(listing, tries, cursors)


CAND = f"""WITH {EV}, l AS (SELECT pool, 'g' || (seq % 6007) AS signature, seq AS slot, kind = 'failed' AS failed FROM ev), t AS (SELECT 'g' || (seq * 7 % 6007) AS signature, count(*) AS tries, bool_or(quote_raw % 9 = 0) AS complete FROM ev WHERE base_raw > 40 GROUP BY 1),
c AS (SELECT l.*, CASE WHEN failed THEN 'failed' WHEN coalesce(complete, false) THEN 'already_processed' WHEN slot < pool * 20 OR slot <= pool * 21 THEN 'below_cursor' WHEN tries >= 2 THEN 'retry_exhausted' END AS drop_reason FROM l LEFT JOIN t USING (signature))"""


@query("candidate_queue", CAND + " , k AS (SELECT pool, slot, signature, row_number() OVER (PARTITION BY pool ORDER BY slot DESC, signature DESC) AS rank FROM c WHERE drop_reason IS NULL) SELECT * FROM k WHERE rank <= 3")
def candidate_queue(spark, sf):
    return O.candidate_queue(candidates(spark, sf), 3)


@query("freshest_candidates", CAND + " SELECT pool, max(slot) AS slot, arg_max(signature, slot) AS signature FROM c WHERE drop_reason IS NULL GROUP BY pool")
def freshest_candidates(spark, sf):
    return O.candidate_queue(candidates(spark, sf)).drop("rank")


@query("candidate_drop_counts", CAND + " SELECT pool, coalesce(drop_reason, 'candidate') AS state, count(*) AS n FROM c GROUP BY ALL")
def candidate_drop_counts(spark, sf):
    return O.drop_counts(candidates(spark, sf))


@query("hydration_eligible", f"""WITH {EV} SELECT pool, max(seq) AS seq, max(seq) AS id FROM sw WHERE quote_raw % 3 <> 0 AND seq % 5 <> 0 AND base_raw > 10 AND seq % 4 <> 0 AND pool % 6 <> 1 AND availability_ns >= (SELECT max(availability_ns) FROM ev) - 1000000000000000 GROUP BY pool""")
def hydration_eligible(spark, sf):
    ev = events(spark, sf)
    now = ev.agg(F.max("availability_ns")).first()[0]
    d = ev.where(SWAP).select(
        "pool", "seq", F.col("seq").alias("id"), F.col("availability_ns").alias("decision_ns"), F.lit("NO_TRADE").alias("action"), F.expr("if(quote_raw % 3 <> 0, 'PROVEN', 'MISSING')").alias("evidence_status"), F.expr("seq % 5 <> 0").alias("risk_allowed"),
        F.expr("base_raw > 10").alias("flow_ok"), F.expr("if(seq % 4 = 0, array('quote_reserve'), array('history.minimum_span', 'momentum_bps'))").alias("missing"))
    return O.hydration_eligible(d, ev.where("pool % 6 = 1").select("pool"), now, 1_000_000_000_000_000).drop("decision_ns")


WINDOWS = f"""WITH {EV}, w AS (SELECT pool, seq AS window_id, availability_ns AS started_ns, availability_ns + base_raw * 3600000000000 AS expires_ns FROM ev WHERE kind = 'pool_created')"""


def windows(spark, sf):
    return events(spark, sf).where("kind = 'pool_created'").select("pool", F.col("seq").alias("window_id"), F.col("availability_ns").alias("started_ns"), (F.col("availability_ns") + F.col("base_raw") * 3_600_000_000_000).alias("expires_ns"))


@query("active_windows", WINDOWS + " SELECT pool, window_id FROM w WHERE window_id NOT IN (SELECT seq - 1 FROM ev WHERE kind = 'failed')")
def active_windows(spark, sf):
    ends = events(spark, sf).where("kind = 'failed'").select((F.col("seq") - 1).alias("window_id"))
    return O.active_windows(windows(spark, sf), ends).select("pool", "window_id")


@query("window_membership", WINDOWS + """, d AS (SELECT pool, seq AS decision_id, availability_ns AS t FROM sw), j AS (SELECT d.pool, d.decision_id, max({e: w.expires_ns, i: w.window_id}) AS b FROM d LEFT JOIN w ON w.pool = d.pool AND w.started_ns <= d.t AND w.expires_ns > d.t GROUP BY ALL)
SELECT pool, decision_id, b.i AS window_id, b IS NOT NULL AND b.i IS NOT NULL AS within FROM j""")
def window_membership(spark, sf):
    d = events(spark, sf).where(SWAP).select("pool", F.col("seq").alias("decision_id"), F.col("availability_ns").alias("decision_ns"))
    return O.window_membership(d, windows(spark, sf), Split(45))


@query("poll_budgets", f"""WITH {EV}, p AS (SELECT pool AS window_id, count(*) FILTER (WHERE kind = 'swap') AS polls, count(*) FILTER (WHERE kind = 'failed') AS receipts FROM ev GROUP BY pool) SELECT window_id, polls, receipts, polls >= 40 OR receipts >= 15 AS exhausted FROM p""")
def poll_budgets(spark, sf):
    ev = events(spark, sf).withColumn("window_id", F.col("pool"))
    return O.poll_budget(ev.select("window_id").distinct(), ev.where(SWAP), ev.where("kind = 'failed'"), 40, 15)


@query("report_observations", f"""WITH {EV}, r AS (SELECT seq, CASE seq % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WAIT' WHEN 2 THEN 'FAIL' END AS status, CASE WHEN seq % 7 = 1 THEN 'waiting_for_finality' WHEN seq % 7 = 2 THEN 'odd' END AS code,
 CASE WHEN seq % 5 = 1 THEN ['decoder_errors', 'not_listed', 'slots_unresolved'] WHEN seq % 5 < 4 THEN []::VARCHAR[] END AS alerts, seq % 6 <> 1 AS has_metrics, CASE WHEN seq % 3 = 0 THEN base_raw END AS used FROM ev)
SELECT seq, array_to_string(list_sort(list_distinct(list_filter(coalesce(alerts, []::VARCHAR[]), lambda a: a <> 'not_listed') || CASE WHEN code = 'waiting_for_finality' THEN [code] WHEN status IS NULL OR status = 'FAIL' THEN ['unclassified_failure'] ELSE [] END
 || CASE WHEN used >= 50 THEN ['quota_exhausted'] ELSE [] END)), ',') AS codes, coalesce(status = 'PASS' AND alerts IS NOT NULL AND has_metrics, false) AS complete FROM r""")
def report_observations(spark, sf):
    r = events(spark, sf).selectExpr(
        "seq", "case seq % 4 when 0 then 'PASS' when 1 then 'WAIT' when 2 then 'FAIL' end as status", "case when seq % 7 = 1 then 'waiting_for_finality' when seq % 7 = 2 then 'odd' end as code",
        "case when seq % 5 = 1 then array('decoder_errors', 'not_listed', 'slots_unresolved') when seq % 5 < 4 then cast(array() as array<string>) end as alerts", "seq % 6 <> 1 as has_metrics",
        "if(seq % 3 = 0, base_raw, null) as requests", "if(seq % 3 = 0, 50, null) as request_limit", "if(seq % 3 = 0, 0, null) as charged_units", "if(seq % 3 = 0, 10, null) as unit_limit")
    return O.report_observation(r).select("seq", F.array_join("codes", ",").alias("codes"), "complete")
