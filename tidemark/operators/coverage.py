"""Coverage of an integer range: which positions are archived, proven skipped, unavailable or failed.

attempts: id, slot, session_id, raw, raw_hash, transport_error, observed_at.
outcomes: attempt_id, status, reason, document_hash.
publications: slot, attempt_id, blockhash, previous_blockhash, parent_slot, document_hash.
Interval questions are answered by ordered scans over the published slots, not by range joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonio import sha256_hex
from .ordered import Ordered, Split
from .validate import error_diagnostic, retry_policy

CHUNK = 100_000


def slot_spine(spark: SparkSession, start: int, end: int, states: DataFrame | None = None) -> DataFrame:
    """One row per position of [start, end]; without a state it is unavailable / not_attempted."""
    spine = spark.range(start, end + 1).withColumnRenamed("id", "slot")
    if states is None:
        return spine
    return spine.join(states, "slot", "left").withColumns(
        {"status": F.coalesce("status", F.lit("unavailable")), "reason": F.coalesce("reason", F.lit("not_attempted"))})


def completed(attempts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Attempts that have an outcome, with it."""
    return attempts.join(outcomes.withColumnRenamed("attempt_id", "id"), "id")


def slot_state(attempts: DataFrame, outcomes: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    """First archived attempt wins, then a skip proof, else the latest attempt's outcome."""
    done = completed(attempts.select("id", "slot"), outcomes)
    archived = F.col("status") == "archived"
    rank = F.struct(archived.alias("a"), F.when(archived, -F.col("id")).otherwise(F.col("id")).alias("i"))
    state = done.groupBy("slot").agg(
        F.max_by(F.struct("status", "reason", F.col("id").alias("attempt_id")), rank).alias("s")
    ).select("slot", "s.*", F.lit(None).cast("bigint").alias("proof_slot"))
    if proofs is None:
        return state
    return state.join(proofs.select("slot", F.col("proof_slot").alias("__proof")), "slot", "full").select(
        "slot",
        F.when((F.col("status") == "archived") | F.col("__proof").isNull(), F.col("status")).otherwise("skipped").alias("status"),
        F.when((F.col("status") == "archived") | F.col("__proof").isNull(), F.col("reason")).otherwise("verified_parent_gap").alias("reason"),
        "attempt_id",
        F.when(F.col("status").eqNullSafe("archived"), F.lit(None)).otherwise(F.col("__proof")).alias("proof_slot"),
    )


def _linked(publications: DataFrame) -> DataFrame:
    """Children whose parent is published too, with the parent's hash."""
    parent = publications.select(F.col("slot").alias("parent_slot"), F.col("blockhash").alias("parent_hash"))
    return publications.join(parent, "parent_slot")


def skip_proofs(publications: DataFrame) -> DataFrame:
    """Slots strictly between a published child and its published parent with the same hash."""
    gaps = _linked(publications).where(
        (F.col("previous_blockhash") == F.col("parent_hash")) & (F.col("slot") - F.col("parent_slot") > 1))
    last = F.col("child") - 1
    pieces = gaps.select(F.col("slot").alias("child"), "parent_slot").withColumn(
        "lo", F.explode(F.sequence(F.col("parent_slot") + 1, last, F.lit(CHUNK).cast("bigint"))))
    slots = pieces.withColumn("slot", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + CHUNK - 1, last))))
    proofs = slots.groupBy("slot").agg(F.min(F.struct(F.col("child"), F.col("parent_slot"))).alias("p"))
    proofs = proofs.select("slot", F.col("p.child").alias("proof_slot"), F.col("p.parent_slot").alias("parent_slot"))
    return proofs.join(publications.select("slot"), "slot", "left_anti")


def chain_conflicts(publications: DataFrame, archived: DataFrame | None = None, split: Split = Split()) -> DataFrame:
    """Parent hash mismatches, published slots inside a claimed gap, slots with two documents.

    A published slot s is inside a gap when some later child's parent is before s, that is when
    the smallest parent among later children is below s: one backward scan, no pairs.
    """
    linked = _linked(publications)
    mismatch = linked.where(F.col("previous_blockhash") != F.col("parent_hash")).select("slot", F.lit("finalized_parent_hash_conflict").alias("conflict"))
    claims = publications.select("slot").join(linked.select("slot", F.col("parent_slot").alias("claim")), "slot", "left")
    o = Ordered(claims.withColumn("__log", F.lit(0)), ["__log"], ["slot"], split)
    o.running(descending=True, inclusive=False, lowest=("min", F.col("claim")))
    inside = o.result().where(F.col("lowest") < F.col("slot")).select("slot", F.lit("finalized_chain_conflict").alias("conflict"))
    out = mismatch.unionByName(inside)
    if archived is not None:
        two = archived.groupBy("slot").agg((F.min("document_hash") != F.max("document_hash")).alias("two")).where("two")
        out = out.unionByName(two.select("slot", F.lit("finalized_block_conflict").alias("conflict")))
    return out


def checkpoint(spark: SparkSession, start: int, end: int, attempts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """First position of the range without a completed attempt, else end + 1."""
    done = completed(attempts.select("id", "slot"), outcomes.select("attempt_id")).select("slot").distinct()
    open_ = slot_spine(spark, start, end).join(done, "slot", "left_anti")
    return open_.agg(F.coalesce(F.min("slot"), F.lit(end + 1)).alias("next_slot"))


def retry_queue(states: DataFrame, attempts: DataFrame, cursor: int, request_version: int) -> DataFrame:
    """Unresolved attempted slots below the cursor that their retry rule lets through.

    attempts: id, request_version (version asked for by the attempt's session).
    """
    open_ = states.where(F.col("status").isin("unavailable", "error") & (F.col("reason") != "not_attempted") & (F.col("slot") < cursor))
    rows = open_.join(attempts.select(F.col("id").alias("attempt_id"), F.col("request_version").alias("__v")), "attempt_id", "left")
    policy = retry_policy("reason")
    rows = rows.withColumns({"category": policy["category"], "retry": policy["retry"]})
    newer = (F.col("retry") != "only_after_request_version_increase") | (F.col("__v") < request_version)
    return rows.where((F.col("retry") != "requires_correction") & F.coalesce(newer, F.lit(False))).drop("__v")


def coverage_report(states: DataFrame, attempts: DataFrame, outcomes: DataFrame, start: int, end: int) -> DataFrame:
    """One row: counts by status, accounted and resolved fractions, attempts, distinct attempted slots, raw bytes."""
    expected = end - start + 1
    s = states.where(F.col("slot").between(start, end)).agg(
        *[F.count_if(F.col("status") == k).alias(k) for k in ("archived", "skipped", "unavailable", "error")],
        F.count(F.lit(1)).alias("accounted"))
    a = attempts.join(outcomes.select(F.col("attempt_id").alias("id"), F.lit(True).alias("__done")), "id", "left").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_distinct(F.when(F.col("__done"), F.col("slot"))).alias("attempted_slots"),
        F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("raw_bytes"))
    return s.join(F.broadcast(a), how="cross").withColumns({  # two one-row tables
        "expected_slots": F.lit(expected),
        "unresolved": F.col("unavailable") + F.col("error"),
        "accounted_fraction": F.col("accounted") / expected,
        "resolved_fraction": (F.col("archived") + F.col("skipped")) / expected,
        "accounting_ok": (F.col("accounted") == expected) & (F.col("archived") + F.col("skipped") + F.col("unavailable") + F.col("error") == expected),
    })


def projection_audit(states: DataFrame, attempts: DataFrame, outcomes: DataFrame, publications: DataFrame) -> DataFrame:
    """Slots whose stored state disagrees with the evidence, one row per fault."""
    done = completed(attempts.select("id", F.col("slot").alias("__aslot")), outcomes.select("attempt_id", F.col("status").alias("__st"), F.col("reason").alias("__re")))
    s = states.join(done.withColumnRenamed("id", "attempt_id"), "attempt_id", "left")
    plain = F.col("status") != "skipped"
    untouched = F.col("attempt_id").isNull()
    wrong = F.when(plain & untouched & ((F.col("status") != "unavailable") | (F.col("reason") != "not_attempted")), "state_without_attempt").when(
        plain & ~untouched & ~F.coalesce((F.col("__aslot") == F.col("slot")) & (F.col("__st") == F.col("status")) & (F.col("__re") == F.col("reason")), F.lit(False)),
        "state_disagrees_with_outcome")
    faults = s.select("slot", wrong.alias("fault")).where(F.col("fault").isNotNull())
    latest = completed(attempts.select("id", "slot"), outcomes.select("attempt_id")).groupBy("slot").agg(F.max("id").alias("latest"))
    stale = states.where(F.col("status").isin("unavailable", "error")).join(latest, "slot").where(
        ~F.col("attempt_id").eqNullSafe(F.col("latest"))).select("slot", F.lit("stale_slot_projection").alias("fault"))
    child = _linked(publications).select(F.col("slot").alias("proof_slot"), F.col("parent_slot"), F.col("previous_blockhash"), F.col("parent_hash"))
    proof = states.where(F.col("status") == "skipped").join(child, "proof_slot", "left")
    good = (F.col("parent_slot") < F.col("slot")) & (F.col("slot") < F.col("proof_slot")) & (F.col("previous_blockhash") == F.col("parent_hash"))
    bad_proof = proof.where(~F.coalesce(good, F.lit(False))).select("slot", F.lit("bad_skip_proof").alias("fault"))
    lost = publications.select("slot").join(states.where(F.col("status") == "archived").select("slot"), "slot", "left_anti").select(
        "slot", F.lit("publication_without_state").alias("fault"))
    return faults.unionByName(stale).unionByName(bad_proof).unionByName(lost)


def attempt_diagnostics(attempts: DataFrame, sessions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Attempts with the request that was made, outcome, retry class and error detail."""
    rows = attempts.join(sessions.select(F.col("id").alias("session_id"), "request_version"), "session_id").join(
        outcomes.select(F.col("attempt_id").alias("id"), "status", "reason"), "id", "left")
    open_ = F.col("status").isin("unavailable", "error")
    policy, detail = retry_policy("reason"), error_diagnostic("raw")
    return rows.select(
        F.col("id").alias("attempt_id"), "slot", "status", "reason", "raw_hash", F.lit("getBlock").alias("method"), "request_version",
        F.when(open_, policy["category"]).alias("category"), F.when(open_, policy["retry"]).alias("retry"),
        F.when(open_, detail["rpc_code"]).alias("rpc_code"),
        F.when(open_, detail["reported_transaction_version"]).alias("reported_transaction_version"))


def select_range(states: DataFrame, start: int, end: int, excluded: DataFrame) -> DataFrame:
    """States of a sub-range: unavailable becomes unresolved, archived slots may be excluded; a wrong exclusion is a reject."""
    rows = states.where(F.col("slot").between(start, end))
    rows = rows.join(excluded.select("slot").distinct().withColumn("__x", F.lit(True)), "slot", "left")
    x = F.coalesce("__x", F.lit(False))
    status = F.when(F.col("status") == "unavailable", "unresolved").otherwise(F.col("status"))
    return rows.select(
        "slot",
        F.when(x & (F.col("status") == "archived"), "excluded").otherwise(status).alias("status"),
        F.col("status").alias("source_status"),
        F.when(x & (F.col("status") == "archived"), "explicit_slot_exclusion").otherwise(F.col("reason")).alias("reason"),
        F.when(x & (F.col("status") != "archived"), "cannot_exclude_unresolved_or_skipped_slot").alias("reject"))


def range_flags(selected: DataFrame, start: int, end: int) -> DataFrame:
    """Counts and completeness flags of ``select_range`` rows."""
    kinds = ("archived", "skipped", "unresolved", "error", "excluded")
    c = selected.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("accounted_slots"))
    return c.withColumns({
        "expected_slots": F.lit(end - start + 1),
        "resolved_slots": F.col("archived") + F.col("excluded") + F.col("skipped"),
        "source_complete": (F.col("unresolved") == 0) & (F.col("error") == 0),
        "included_range_complete": (F.col("unresolved") == 0) & (F.col("error") == 0) & (F.col("excluded") == 0),
        "accounting_ok": F.col("accounted_slots") == end - start + 1,
    })


def slot_history(attempts: DataFrame, outcomes: DataFrame, split: Split = Split()) -> DataFrame:
    """Completed attempts of each slot with their ordinal, one row each, so a slot tried very often stays distributed."""
    o = Ordered(completed(attempts.select("id", "slot", "raw_hash"), outcomes.select("attempt_id", "status", "reason")), ["slot"], ["id"], split)
    return o.running(ordinal=("sum", F.lit(1))).result()


def range_buckets(df: DataFrame, start: int, size: int, slot: str = "slot") -> DataFrame:
    """Consecutive fixed ranges of ``size`` positions from ``start``."""
    first = F.lit(start) + F.floor((F.col(slot) - start) / size).cast("bigint") * size
    return df.withColumns({"range_start": first, "range_end": first + (size - 1)})


def receipt_contiguity(receipts: DataFrame, start: int, split: Split = Split()) -> DataFrame:
    """One row: receipts, the first one that does not adjoin its predecessor, and the next cursor."""
    o = Ordered(receipts.withColumn("__log", F.lit(0)), ["__log"], ["range_start"], split)
    o.last_seen("__end", F.col("range_end"))
    rows = o.add(expected=F.coalesce(F.col("__end") + 1, F.lit(start))).result()
    broken = F.min(F.when(F.col("range_start") != F.col("expected"), F.struct("range_start", "expected")))
    out = rows.agg(F.count(F.lit(1)).alias("receipts"), broken.alias("b"), F.max("range_end").alias("top"))
    return out.select("receipts", F.col("b.range_start").alias("first_break"),
                      F.coalesce(F.col("b.expected"), F.col("top") + 1, F.lit(start)).alias("next_cursor"))


def find_witness(blocks: DataFrame, bound: int) -> DataFrame:
    """Nearest block before ``bound`` with a decoded event and no decode error."""
    ok = (F.col("slot") < bound) & (F.col("events") > 0) & (F.col("decode_errors") == 0)
    value = F.struct(*blocks.columns)
    return blocks.where(ok).agg(F.max_by(value, "slot").alias("w")).where(F.col("w").isNotNull()).select("w.*")


def capture_raw(df: DataFrame, size_limit: int = 4 * 1024 * 1024, raw: str = "raw", observed_at: int | None = None) -> DataFrame:
    """Add the content hash and observation time; rows over the limit are refused, with a reason."""
    now = F.lit(observed_at).cast("bigint") if observed_at is not None else F.unix_micros(F.current_timestamp())
    size = F.octet_length(raw)
    return df.withColumns({
        "raw_sha256": F.when(size <= size_limit, sha256_hex(raw)),
        "observed_at": now,
        "reason": F.when(F.col(raw).isNull(), "missing").when(size > size_limit, "response_too_large").otherwise("ok"),
    })
