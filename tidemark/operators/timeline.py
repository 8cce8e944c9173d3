"""Comparison of two captures and the bitemporal view: valid axis = slot, knowledge axis = sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coverage import slot_spine
from .ordered import Ordered, Split


def compare_captures(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per slot of either side: match, both_proven_skipped, block_conflict, payload_disagreement or insufficient_evidence.

    Both sides: slot (unique), status, blockhash, document_hash. No side is taken as the truth.
    """
    cols = ("status", "blockhash", "document_hash")
    a = left.select("slot", *[F.col(c).alias(f"l_{c}") for c in cols])
    b = right.select("slot", *[F.col(c).alias(f"r_{c}") for c in cols])
    l_, r_ = F.col("l_status"), F.col("r_status")
    both = (l_ == "archived") & (r_ == "archived")
    status = (
        F.when(both & (F.col("l_blockhash") != F.col("r_blockhash")), "block_conflict")
        .when(both & (F.col("l_document_hash") == F.col("r_document_hash")), "match")
        .when(both, "payload_disagreement")
        .when((l_ == "skipped") & (r_ == "skipped"), "both_proven_skipped")
        .when(((l_ == "archived") & (r_ == "skipped")) | ((l_ == "skipped") & (r_ == "archived")), "block_conflict")
        .otherwise("insufficient_evidence")
    )
    return a.join(b, "slot", "full").select("slot", status.alias("status"))


def comparison_counts(compared: DataFrame) -> DataFrame:
    """One row of counts and whether the union of both captures is consistent."""
    kinds = ("match", "both_proven_skipped", "block_conflict", "payload_disagreement", "insufficient_evidence")
    c = compared.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    return c.withColumn("consistent_over_union", F.expr("block_conflict + payload_disagreement + insufficient_evidence = 0"))


def slot_facts(events: DataFrame, transactions: DataFrame, states: DataFrame) -> DataFrame:
    """Per slot: events by kind as an array of (kind, n), transactions by status, known token changes.

    Counting per (slot, kind) comes first, so the array holds at most one entry per kind.
    """
    kinds = events.groupBy("slot", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "token_balance_change").alias("changes"))
    by_slot = kinds.groupBy("slot").agg(
        F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("event_counts"), F.sum("changes").alias("token_changes"))
    tx = transactions.groupBy("slot").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "failed", "error")])
    out = states.select("slot", F.col("status").alias("coverage")).join(by_slot, "slot", "left").join(tx, "slot", "left")
    empty = F.array().cast("array<struct<kind:string,n:bigint>>")
    return out.withColumns({
        "event_counts": F.coalesce("event_counts", empty),
        **{c: F.coalesce(c, F.lit(0)) for c in ("token_changes", "processed", "failed", "error")}})


def timeline_as_of(knowledge: DataFrame, start: int, end: int, sequence: int | None = None, as_of_ns: int | None = None) -> DataFrame:
    """Per slot of the range the knowledge at both cutoffs.

    knowledge: seq, recorded_ns, slot, status, document_hash. A resolved slot is not replaced by a
    less complete one; two different resolved contents are a conflict; gaps are not_observed.
    """
    rows = knowledge.where(F.col("slot").between(start, end))
    if sequence is not None:
        rows = rows.where(F.col("seq") <= sequence)
    if as_of_ns is not None:
        rows = rows.where(F.col("recorded_ns") <= as_of_ns)
    resolved = F.col("status").isin("archived", "skipped")
    content = F.when(resolved, F.struct(F.col("status").alias("s"), F.when(F.col("status") == "archived", F.col("document_hash")).alias("h")))
    known = rows.groupBy("slot").agg(
        F.max_by(F.struct("seq", "recorded_ns", "status", "document_hash"), F.struct(resolved.alias("r"), F.col("seq"))).alias("k"),
        (F.min(content) != F.max(content)).alias("conflict"))
    return slot_spine(knowledge.sparkSession, start, end).join(known, "slot", "left").select(
        "slot", F.coalesce("k.status", F.lit("not_observed")).alias("status"), F.col("k.seq").alias("knowledge_sequence"),
        F.col("k.recorded_ns").alias("recorded_ns"), F.col("k.document_hash").alias("document_hash"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def knowledge_receipt(datasets: DataFrame, existing: DataFrame | None = None, order: str = "arrival", split: Split = Split()) -> DataFrame:
    """Sequence number per dataset id, continuing the existing ones; a repeated id keeps its first receipt."""
    first = datasets.groupBy("dataset_id").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("arrivals"))
    old_top = F.lit(0)
    if existing is not None:
        old = existing.select("dataset_id", F.col("sequence").alias("__old"))
        known = first.join(old, "dataset_id").select("dataset_id", order, "arrivals", F.col("__old").alias("sequence"), F.lit(True).alias("duplicate"))
        first = first.join(old.select("dataset_id"), "dataset_id", "left_anti")
        top = existing.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("__top"))  # one row
        first = first.join(F.broadcast(top), how="cross")
        old_top = F.col("__top")
    o = Ordered(first.withColumn("__log", F.lit(0)), ["__log"], [order, "dataset_id"], split).running(__n=("sum", F.lit(1)))
    new = o.result().select("dataset_id", order, "arrivals", (old_top + F.col("__n")).cast("bigint").alias("sequence"), F.lit(False).alias("duplicate"))
    return new if existing is None else new.unionByName(known)
