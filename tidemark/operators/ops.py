"""Quotas, alerts, cursors, candidate queues and watch windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, Split, measured

# Alert codes.
ALERT_CODES = ("quota_exhausted", "slots_unresolved", "decoder_errors", "token_deltas_unknown", "token_balances_not_recorded",
               "unsupported_instructions", "waiting_for_finality", "unclassified_failure")


def quota_usage(policy: DataFrame, reservations: DataFrame, settlements: DataFrame) -> DataFrame:
    """Per quota: requests, charged units (settled, else reserved), unsettled, faults and health.

    policy: quota, requests, units. reservations: quota, key, units. settlements: key, actual; repeated settlements of a key
    count once, with the largest amount. A settlement without a reservation belongs to no quota, so it is a fault of all.
    """
    s = settlements.groupBy("key").agg(F.max("actual").alias("actual"))
    unreserved = s.join(reservations.select("key"), "key", "left_anti").agg(F.count(F.lit(1)).alias("__unreserved"))
    r = reservations.join(s, "key", "left")
    g = r.groupBy("quota").agg(
        F.count(F.lit(1)).alias("requests_used"), F.sum(F.coalesce("actual", "units")).alias("charged_units"),
        F.count_if(F.col("actual").isNull()).alias("unsettled"), F.count_if(F.col("actual") > F.col("units")).alias("errors"))
    out = policy.join(g, "quota", "left")
    for c in ("requests_used", "charged_units", "unsettled", "errors"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    out = out.crossJoin(unreserved).withColumn("errors", F.col("errors") + F.col("__unreserved")).drop("__unreserved")  # one row
    return out.withColumn("healthy", F.expr("errors = 0 and requests_used <= requests and charged_units <= units"))


def quota_breaches(reservations: DataFrame, policy: DataFrame, split: Split = Split()) -> DataFrame:
    """Per quota the first reservation (by order) that goes over the request or unit limit, or ``no_policy`` with the very first.

    reservations: quota, ord, key, units. Only the crossing row matters, so limits are joined after the scan.
    """
    o = Ordered(reservations, ["quota"], ["ord"], split).running(used=("sum", F.col("units")), count=("sum", F.lit(1)))
    j = o.result().join(policy.select("quota", "requests", F.col("units").alias("unit_limit"), F.lit(True).alias("known")), "quota", "left")
    over = j.where(F.col("known").isNull() | (F.col("count") > F.col("requests")) | (F.col("used") > F.col("unit_limit")))
    return over.groupBy("quota").agg(F.min(F.struct("ord", "key", "used", "count", "known")).alias("b")).select(
        "quota", "b.ord", "b.key", "b.used", "b.count", F.when(F.col("b.known"), "over_limit").otherwise("no_policy").alias("reason"))


def reservation_conflicts(reservations: DataFrame) -> DataFrame:
    """Keys reserved with different units."""
    g = reservations.groupBy("key").agg(F.min("units").alias("lo"), F.max("units").alias("hi"), F.count(F.lit(1)).alias("reservations"))
    return g.where("lo <> hi").select("key", "reservations")


def settlement_check(reservations: DataFrame, settlements: DataFrame) -> DataFrame:
    """Settlements without or above a reservation, and keys settled with different amounts."""
    s = settlements.groupBy("key").agg(F.min("actual").alias("lo"), F.max("actual").alias("hi"))
    r = reservations.groupBy("key").agg(F.max("units").alias("units"))
    j = s.join(r, "key", "left")
    fault = F.when(F.col("units").isNull() | (F.col("hi") > F.col("units")), "unreserved_usage").when(F.col("lo") != F.col("hi"), "settlement_conflict")
    return j.withColumn("fault", fault).where(F.col("fault").isNotNull()).select("key", "fault")


def report_observation(reports: DataFrame, codes=ALERT_CODES) -> DataFrame:
    """Run reports -> ``codes`` (sorted) and ``complete``: what a report says about alerts.

    Columns: status, code, alerts (array, null: none stated), has_metrics, and requests, request_limit, charged_units, unit_limit
    (all null: no quota figures). The report's own code counts if it is listed, otherwise any status but PASS and WAIT is an
    unclassified failure; used-up quotas count; only a PASS that states its alerts and metrics is complete.
    """
    listed = F.array(*[F.lit(c) for c in codes])
    none = F.array().cast("array<string>")
    own = F.when(F.col("code").isin(*codes), F.array("code")).when(~F.coalesce(F.col("status").isin("PASS", "WAIT"), F.lit(False)), F.array(F.lit("unclassified_failure"))).otherwise(none)
    figures = F.coalesce("requests", "request_limit", "charged_units", "unit_limit").isNotNull()

    def spent(used: str, limit: str) -> Column:
        return F.coalesce(used, F.lit(0)) >= F.coalesce(limit, F.lit(1))

    quota = F.when(figures & (spent("requests", "request_limit") | spent("charged_units", "unit_limit")), F.array(F.lit("quota_exhausted"))).otherwise(none)
    said = F.array_intersect(F.coalesce("alerts", none), listed)
    complete = F.coalesce((F.col("status") == "PASS") & F.col("alerts").isNotNull() & F.col("has_metrics"), F.lit(False))
    return reports.withColumns({"codes": F.array_sort(F.array_distinct(F.concat(said, own, quota))), "complete": complete})


def alert_marks(observations: DataFrame, codes=ALERT_CODES) -> DataFrame:
    """One row per (observation, code) it says something about: set when it lists the code, cleared when a
    complete snapshot does not. An incomplete report says nothing about codes it does not list; codes outside the fixed
    list are ignored, as in the stream."""
    all_codes = F.array(*[F.lit(c) for c in codes])
    said = F.when(F.col("complete"), all_codes).otherwise(F.array_intersect("codes", all_codes))
    return observations.select("source", "id", F.explode(said).alias("code"), "codes").select(
        "source", "id", "code", F.array_contains("codes", F.col("code")).alias("set"))


def alert_lifecycle(observations: DataFrame, codes=ALERT_CODES, split: Split = Split()) -> DataFrame:
    """OPEN and RESOLVED transitions per source and code.

    observations: source, id (order), codes, complete. Whether a code is active depends only on the newest
    row that says something about it, so a transition is a change against the previous such row.
    """
    split = measured(observations, ["source"], "id", split)
    o = Ordered(alert_marks(observations, codes), ["source", "code"], ["id"], split).last_seen("before", F.col("set"))
    t = o.result().where(F.col("set") != F.coalesce("before", F.lit(False)))
    return t.select("source", "code", "id", F.when(F.col("set"), "OPEN").otherwise("RESOLVED").alias("state"))


def active_alerts(observations: DataFrame, codes=ALERT_CODES) -> DataFrame:
    """Codes still open per source (combinable, no ordering needed)."""
    last = alert_marks(observations, codes).groupBy("source", "code").agg(F.max_by("set", "id").alias("set"))
    return last.where("set").select("source", "code")


def cursor(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Newest event per followed pool by (slot, availability), floored at the position's slot.

    positions: pool, after_slot, decision_ns.
    """
    newest = events.groupBy("pool").agg(F.max(F.struct("slot", "availability_ns", "seq")).alias("e"))
    return positions.join(newest, "pool", "left").select(
        "pool", F.greatest("after_slot", F.coalesce("e.slot", F.lit(0))).alias("cursor_slot"), F.col("e.seq").alias("cursor_seq"),
        F.coalesce("e.availability_ns", "decision_ns").alias("cursor_availability_ns"))


def candidate_states(listing: DataFrame, attempts: DataFrame, cursors: DataFrame, max_tries: int = 2) -> DataFrame:
    """Listed signatures with the first reason to drop them (null = candidate).

    listing: pool, signature, slot, failed. attempts: signature, complete (one row per try). cursors: pool, cursor_slot, after_slot.
    """
    tries = attempts.groupBy("signature").agg(F.count(F.lit(1)).alias("tries"), F.max("complete").alias("complete"))
    j = listing.join(tries, "signature", "left").join(cursors.withColumn("__known", F.lit(True)), "pool", "left")
    drop = (
        F.when(F.col("failed"), "failed").when(F.coalesce("complete", F.lit(False)), "already_processed")
        .when(F.col("__known").isNull(), "no_cursor")
        .when((F.col("slot") < F.col("cursor_slot")) | (F.col("slot") <= F.col("after_slot")), "below_cursor")
        .when(F.col("tries") >= max_tries, "retry_exhausted"))
    return j.withColumn("drop_reason", drop).drop("__known")


def candidate_queue(states: DataFrame, k: int = 1) -> DataFrame:
    """Freshest ``k`` candidates per pool. Each map task keeps its own best ``k``, so a hot pool sends k rows per task."""
    from pyspark.sql import Window

    live = states.where(F.col("drop_reason").isNull())
    if k == 1:
        top = live.groupBy("pool").agg(F.max(F.struct("slot", "signature")).alias("t"))
        return top.select("pool", "t.slot", "t.signature", F.lit(1).alias("rank"))
    # spread a pool over salts, keep k of each, then k of what is left
    salted = live.select("pool", "slot", "signature").withColumn("__s", F.pmod(F.xxhash64("signature"), F.lit(64)))
    newest = [F.desc("slot"), F.desc("signature")]
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("pool", "__s").orderBy(*newest))).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("pool").orderBy(*newest))).where(F.col("rank") <= k).drop("__s")


def drop_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("pool", F.coalesce("drop_reason", F.lit("candidate")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


HYDRATABLE = ("history.minimum_samples", "history.minimum_span", "history.continuity", "momentum_bps")


def hydration_eligible(decisions: DataFrame, watches: DataFrame, now: int, fresh_ns: int = 5_000_000_000) -> DataFrame:
    """Newest qualifying decision per pool without a watch.

    decisions: pool, id, seq, decision_ns, action, evidence_status, risk_allowed, missing (array), flow_ok.
    """
    fits = F.forall("missing", lambda m: m.isin(*HYDRATABLE)) & (F.size("missing") > 0)
    ok = (
        (F.col("action") == "NO_TRADE") & (F.col("evidence_status") == "PROVEN") & F.col("risk_allowed") & F.col("flow_ok") & fits
        & (F.lit(now) - F.col("decision_ns")).between(0, fresh_ns))
    d = decisions.where(ok).join(watches.select("pool").distinct(), "pool", "left_anti")
    return d.groupBy("pool").agg(F.max(F.struct("seq", "id", "decision_ns")).alias("d")).select("pool", "d.seq", "d.id", "d.decision_ns")


def active_windows(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Windows without an end record."""
    return starts.join(ends.select("window_id").distinct(), "window_id", "left_anti")


def window_membership(decisions: DataFrame, windows: DataFrame, split: Split = Split()) -> DataFrame:
    """For every decision the started window of its pool that lasts longest, and whether it is still open.

    decisions: pool, decision_id, decision_ns. windows: pool, window_id, started_ns, expires_ns. Windows may overlap:
    some window covers t exactly when the latest expiry among those started by t is after t.
    """
    span = "struct<expires_ns:bigint,window_id:bigint>"
    s = windows.select("pool", F.col("started_ns").alias("t"), F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias("decision_id"),
                       F.struct(F.col("expires_ns").cast("bigint").alias("expires_ns"), F.col("window_id").cast("bigint").alias("window_id")).alias("w"))
    d = decisions.select("pool", F.col("decision_ns").alias("t"), F.lit(1).alias("rank"), F.col("decision_id").cast("bigint").alias("decision_id"), F.lit(None).cast(span).alias("w"))
    o = Ordered(s.unionByName(d), ["pool"], ["t", "rank", "decision_id"], split).running(best=("max", F.col("w")))
    out = o.result().where(F.col("rank") == 1)
    inside = F.coalesce(F.col("t") < F.col("best.expires_ns"), F.lit(False))
    return out.select("pool", "decision_id", F.when(inside, F.col("best.window_id")).alias("window_id"), inside.alias("within"))


def poll_budget(windows: DataFrame, polls: DataFrame, receipts: DataFrame, max_polls: int, max_receipts: int) -> DataFrame:
    """Per window the polls and receipts used and whether a bound is reached."""
    p = polls.groupBy("window_id").agg(F.count(F.lit(1)).alias("polls"))
    r = receipts.groupBy("window_id").agg(F.count(F.lit(1)).alias("receipts"))
    out = windows.select("window_id").join(p, "window_id", "left").join(r, "window_id", "left")
    out = out.withColumns({"polls": F.coalesce("polls", F.lit(0)), "receipts": F.coalesce("receipts", F.lit(0))})
    return out.withColumn("exhausted", (F.col("polls") >= max_polls) | (F.col("receipts") >= max_receipts))
