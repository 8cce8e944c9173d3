"""Range coverage and timeline queries over order keys."""

from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import timeline as T
from ..operators.ordered import Split
from .registry import query
from .views import BLOCKS, EV, blocks, events, table


def states(spark, sf):
    """Slot states over the whole key range (order keys run from 0 without holes)."""
    b = blocks(spark, sf)
    st = C.slot_state(b["attempts"], b["outcomes"], C.skip_proofs(b["publications"]))
    spine = table(spark, sf, "orders").select(F.col("o_orderkey").alias("slot"))
    full = spine.join(st, "slot", "left").withColumns(
        {"status": F.coalesce("status", F.lit("unavailable")), "reason": F.coalesce("reason", F.lit("not_attempted"))})
    return full, b


def top(spark, sf):
    """Upper end of the range, a range bound as an operator would pass it."""
    return table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]


@query("slot_spine_states", f"WITH {BLOCKS} SELECT slot, status, reason FROM st")
def slot_spine_states(spark, sf):
    b = blocks(spark, sf)
    st = C.slot_state(b["attempts"], b["outcomes"], C.skip_proofs(b["publications"]))
    return C.slot_spine(spark, 0, top(spark, sf), st).select("slot", "status", "reason")


@query("slot_states", f"WITH {BLOCKS} SELECT slot, status, reason, attempt_id, proof_slot FROM st")
def slot_states(spark, sf):
    return states(spark, sf)[0].select("slot", "status", "reason", "attempt_id", "proof_slot")


@query("skip_proofs", f"WITH {BLOCKS} SELECT slot, proof_slot FROM pr")
def skip_proofs(spark, sf):
    return C.skip_proofs(blocks(spark, sf)["publications"]).select("slot", "proof_slot")


@query("chain_conflicts", f"""WITH {BLOCKS}, k AS (SELECT c.* FROM pb c JOIN pb p ON p.slot = c.parent_slot)
SELECT c.slot, 'finalized_parent_hash_conflict' AS conflict FROM k c WHERE previous_blockhash <> 'b' || parent_slot
UNION ALL SELECT DISTINCT p.slot, 'finalized_chain_conflict' FROM pb p JOIN k c ON c.parent_slot < p.slot AND p.slot < c.slot
UNION ALL SELECT slot, 'finalized_block_conflict' FROM oc WHERE status = 'archived' GROUP BY slot HAVING count(DISTINCT document_hash) > 1""")
def chain_conflicts(spark, sf):
    b = blocks(spark, sf)
    done = C.completed(b["attempts"], b["outcomes"]).where("status = 'archived'")
    return C.chain_conflicts(b["publications"], done, Split(300))


@query("range_checkpoint", f"WITH {BLOCKS} SELECT coalesce(min(o_orderkey) FILTER (WHERE NOT EXISTS (SELECT 1 FROM oc WHERE oc.slot = o_orderkey)), (SELECT hi + 1 FROM sp)) AS next_slot FROM orders")
def range_checkpoint(spark, sf):
    b = blocks(spark, sf)
    return C.checkpoint(spark, 0, top(spark, sf), b["attempts"], b["outcomes"])


@query("retry_queue", f"""WITH {BLOCKS} SELECT slot, reason, attempt_id, CASE reason WHEN 'rpc_-32015' THEN 'only_after_request_version_increase' ELSE 'bounded_backoff' END AS retry
FROM st WHERE status IN ('unavailable', 'error') AND reason <> 'not_attempted' AND (reason <> 'rpc_-32015' OR slot % 2 < 1)""")
def retry_queue(spark, sf):
    st, b = states(spark, sf)
    return C.retry_queue(st, b["attempts"], top(spark, sf) + 1, 1).select("slot", "reason", "attempt_id", "retry")


@query("coverage_report", f"""WITH {BLOCKS} SELECT count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'unavailable') AS unavailable,
 count(*) FILTER (WHERE status = 'error') AS error, (SELECT count(*) FROM al) AS attempts, (SELECT count(DISTINCT slot) FROM oc) AS attempted_slots, (SELECT CAST(sum(length('raw' || id)) AS BIGINT) FROM al) AS raw_bytes,
 round(count(*) FILTER (WHERE status IN ('archived', 'skipped')) / count(*), 9) AS resolved_fraction, true AS accounting_ok FROM st""")
def coverage_report(spark, sf):
    st, b = states(spark, sf)
    r = C.coverage_report(st, b["attempts"], b["outcomes"], 0, top(spark, sf))
    return r.select("archived", "skipped", "unavailable", "error", "attempts", "attempted_slots", "raw_bytes",
                    F.round("resolved_fraction", 9).alias("resolved_fraction"), "accounting_ok")


@query("projection_audit", f"""WITH {BLOCKS}, s AS (SELECT slot, CASE WHEN slot % 37 = 3 THEN 'error' ELSE status END AS status, reason, attempt_id, CASE WHEN slot % 41 = 2 THEN proof_slot + 1 ELSE proof_slot END AS proof_slot FROM st),
j AS (SELECT s.*, oc.status AS os, oc.reason AS orr FROM s LEFT JOIN oc ON oc.id = s.attempt_id)
SELECT slot, CASE WHEN attempt_id IS NULL THEN 'state_without_attempt' ELSE 'state_disagrees_with_outcome' END AS fault FROM j
 WHERE status <> 'skipped' AND CASE WHEN attempt_id IS NULL THEN status <> 'unavailable' OR reason <> 'not_attempted' ELSE NOT coalesce(os = status AND orr = reason, false) END
UNION ALL SELECT s.slot, 'stale_slot_projection' FROM s JOIN ls USING (slot) WHERE s.status IN ('unavailable', 'error') AND s.attempt_id IS DISTINCT FROM ls.attempt_id
UNION ALL SELECT s.slot, 'bad_skip_proof' FROM s LEFT JOIN pb c ON c.slot = s.proof_slot LEFT JOIN pb p ON p.slot = c.parent_slot
 WHERE s.status = 'skipped' AND NOT coalesce(p.slot < s.slot AND s.slot < c.slot AND c.previous_blockhash = p.blockhash, false)
UNION ALL SELECT slot, 'publication_without_state' FROM pb WHERE slot NOT IN (SELECT slot FROM s WHERE status = 'archived')""")
def projection_audit(spark, sf):
    st, b = states(spark, sf)
    st = st.withColumn("status", F.when(F.col("slot") % 37 == 3, "error").otherwise(F.col("status"))).withColumn(
        "proof_slot", F.when(F.col("slot") % 41 == 2, F.col("proof_slot") + 1).otherwise(F.col("proof_slot")))
    return C.projection_audit(st, b["attempts"], b["outcomes"], b["publications"])


@query("attempt_diagnostics", f"""WITH {BLOCKS} SELECT al.id AS attempt_id, al.slot, oc.status, oc.reason, al.slot % 3 % 2 AS request_version,
 CASE WHEN oc.status IN ('unavailable', 'error') THEN CASE oc.reason WHEN 'rpc_-32603' THEN 'internal_rpc_error' WHEN 'rpc_-32015' THEN 'unsupported_transaction_version' ELSE 'other_unresolved' END END AS category,
 CASE WHEN oc.status IN ('unavailable', 'error') THEN -32015 END AS rpc_code, CASE WHEN oc.status IN ('unavailable', 'error') THEN al.n + 1 END AS version FROM al LEFT JOIN oc USING (id)""")
def attempt_diagnostics(spark, sf):
    b = blocks(spark, sf)
    raw = F.concat(F.lit('{"error":{"code":-32015,"message":"Transaction version ('), F.col("id") % 10 + 1, F.lit(') is not supported"}}'))
    sessions = spark.range(3).withColumn("request_version", (F.col("id") % 2).cast("int"))
    d = C.attempt_diagnostics(b["attempts"].drop("request_version").withColumn("raw", raw), sessions, b["outcomes"])
    return d.select("attempt_id", "slot", "status", "reason", "request_version", "category", "rpc_code", F.col("reported_transaction_version").alias("version"))


SELECTED = f"""WITH {BLOCKS}, x AS (SELECT *, slot % 19 = 3 AS x FROM st WHERE slot BETWEEN 100 AND (SELECT max(slot) * 9 // 10 FROM st)),
se AS (SELECT slot, CASE WHEN x AND status = 'archived' THEN 'excluded' WHEN status = 'unavailable' THEN 'unresolved' ELSE status END AS status,
 CASE WHEN x AND status = 'archived' THEN 'explicit_slot_exclusion' ELSE reason END AS reason, CASE WHEN x AND status <> 'archived' THEN 'cannot_exclude_unresolved_or_skipped_slot' END AS reject FROM x)
"""


def last_selected(spark, sf):
    """The end of the selected range: nine tenths of the slots."""
    return states(spark, sf)[0].agg(F.max("slot")).first()[0] * 9 // 10


def selected(spark, sf):
    st, _ = states(spark, sf)
    return C.select_range(st, 100, last_selected(spark, sf), table(spark, sf, "orders").where("o_orderkey % 19 = 3").select(F.col("o_orderkey").alias("slot")))


@query("selected_range", SELECTED + "SELECT slot, status, reason, reject FROM se")
def selected_range(spark, sf):
    return selected(spark, sf).select("slot", "status", "reason", "reject")


@query("selected_range_flags", SELECTED + """SELECT count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'unresolved') AS unresolved,
 count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'excluded') AS excluded, count(*) = (SELECT max(slot) * 9 // 10 FROM st) - 99 AS accounting_ok, count(*) FILTER (WHERE status IN ('unresolved', 'error')) = 0 AS source_complete FROM se""")
def selected_range_flags(spark, sf):
    return C.range_flags(selected(spark, sf), 100, last_selected(spark, sf)).select("archived", "skipped", "unresolved", "error", "excluded", "accounting_ok", "source_complete")


@query("slot_histories", f"WITH {BLOCKS} SELECT slot, id, status, reason, row_number() OVER (PARTITION BY slot ORDER BY id) AS ordinal FROM oc")
def slot_histories(spark, sf):
    b = blocks(spark, sf)
    return C.slot_history(b["attempts"], b["outcomes"]).select("slot", "id", "status", "reason", "ordinal")


@query("range_buckets", "SELECT 7 + CAST(floor((o_orderkey - 7) / 64.0) AS BIGINT) * 64 AS range_start, count(*) AS n FROM orders GROUP BY 1")
def range_buckets(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("slot"))
    return C.range_buckets(o, 7, 64).groupBy("range_start").agg(F.count(F.lit(1)).alias("n"))


@query("receipt_contiguity", """WITH r AS (SELECT DISTINCT o_orderkey // 50 * 50 AS s, o_orderkey // 50 * 50 + CASE WHEN o_orderkey // 50 = 70 THEN 48 ELSE 49 END AS e FROM orders WHERE o_orderkey // 50 <> 90),
x AS (SELECT *, coalesce(lag(e) OVER (ORDER BY s) + 1, 0) AS ex FROM r)
SELECT count(*) AS receipts, min(s) FILTER (WHERE s <> ex) AS first_break, coalesce(arg_min(ex, s) FILTER (WHERE s <> ex), max(e) + 1) AS next_cursor FROM x""")
def receipt_contiguity(spark, sf):
    k = F.expr("o_orderkey div 50")
    r = table(spark, sf, "orders").where(k != 90).groupBy((k * 50).alias("range_start")).agg(F.first(k).alias("k"))
    r = r.select("range_start", (F.col("range_start") + F.when(F.col("k") == 70, 48).otherwise(49)).alias("range_end"))
    return C.receipt_contiguity(r, 0, Split(100))


@query("nearest_witness", """SELECT l_orderkey AS slot, count(*) AS events, count(*) FILTER (WHERE l_returnflag = 'R') AS decode_errors FROM lineitem WHERE l_orderkey < (SELECT max(l_orderkey) * 9 // 10 FROM lineitem) GROUP BY 1 HAVING decode_errors = 0 ORDER BY slot DESC LIMIT 1""")
def nearest_witness(spark, sf):
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("slot")).agg(F.count(F.lit(1)).alias("events"), F.expr("count_if(l_returnflag = 'R')").alias("decode_errors"))
    return C.find_witness(b, table(spark, sf, "lineitem").agg(F.max("l_orderkey")).first()[0] * 9 // 10)


@query("captured_documents", """SELECT doc_id, CASE WHEN strlen(text) <= 20000 THEN sha256(text) END AS raw_sha256, CASE WHEN strlen(text) > 20000 THEN 'response_too_large' ELSE 'ok' END AS reason FROM documents""")
def captured_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw"))
    return C.capture_raw(d, 20000, observed_at=0).select("doc_id", "raw_sha256", "reason")


COMPARED = f"""WITH {BLOCKS}, l AS (SELECT st.slot, st.status, blockhash, document_hash FROM st LEFT JOIN pb USING (slot) WHERE st.slot % 11 <> 4),
r AS (SELECT st.slot, CASE WHEN st.slot % 29 = 1 THEN 'skipped' ELSE st.status END AS status, CASE WHEN st.slot % 13 = 2 THEN 'other' ELSE blockhash END AS blockhash, CASE WHEN st.slot % 17 = 3 THEN 'other' ELSE document_hash END AS document_hash FROM st LEFT JOIN pb USING (slot) WHERE st.slot % 7 <> 3),
c AS (SELECT coalesce(l.slot, r.slot) AS slot, CASE WHEN l.status = 'archived' AND r.status = 'archived' THEN CASE WHEN l.blockhash <> r.blockhash THEN 'block_conflict' WHEN l.document_hash = r.document_hash THEN 'match' ELSE 'payload_disagreement' END
 WHEN l.status = 'skipped' AND r.status = 'skipped' THEN 'both_proven_skipped' WHEN (l.status = 'archived' AND r.status = 'skipped') OR (l.status = 'skipped' AND r.status = 'archived') THEN 'block_conflict' ELSE 'insufficient_evidence' END AS status FROM l FULL JOIN r ON l.slot = r.slot)
"""


def compared(spark, sf):
    st, b = states(spark, sf)
    base = st.select("slot", "status").join(b["publications"].select("slot", "blockhash", "document_hash"), "slot", "left")
    right = base.where("slot % 7 <> 3").select(
        "slot", F.expr("case when slot % 29 = 1 then 'skipped' else status end").alias("status"),
        F.expr("case when slot % 13 = 2 then 'other' else blockhash end").alias("blockhash"), F.expr("case when slot % 17 = 3 then 'other' else document_hash end").alias("document_hash"))
    return T.compare_captures(base.where("slot % 11 <> 4"), right)


@query("compare_captures", COMPARED + "SELECT slot, status FROM c")
def compare_captures(spark, sf):
    return compared(spark, sf)


@query("comparison_counts", COMPARED + ", k AS (SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("match", "both_proven_skipped", "block_conflict", "payload_disagreement", "insufficient_evidence")) + " FROM c) SELECT *, false AS consistent_over_union FROM k")
def comparison_counts(spark, sf):
    return T.comparison_counts(compared(spark, sf))


@query("slot_facts", """WITH e AS (SELECT o_orderkey AS slot, l_shipdate, CASE l_returnflag WHEN 'R' THEN 'token_balance_change' WHEN 'N' THEN 'sol_transfer' ELSE 'spl_transfer_checked' END AS kind, CASE WHEN l_quantity < 5 THEN 'error' WHEN l_quantity < 10 THEN 'failed' ELSE 'processed' END AS ts FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
k AS (SELECT slot, kind, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT slot, string_agg(kind || '=' || n, ',' ORDER BY kind) AS event_counts, sum(n) FILTER (WHERE kind = 'token_balance_change') AS ch FROM k GROUP BY slot),
t AS (SELECT slot, count(*) FILTER (WHERE ts = 'processed') AS p, count(*) FILTER (WHERE ts = 'failed') AS f, count(*) FILTER (WHERE ts = 'error') AS er FROM e GROUP BY slot)
SELECT o_orderkey AS slot, o_orderstatus AS coverage, coalesce(event_counts, '') AS event_counts, CAST(coalesce(ch, 0) AS BIGINT) AS token_changes, coalesce(p, 0) AS processed, coalesce(f, 0) AS failed, coalesce(er, 0) AS error FROM orders LEFT JOIN g ON g.slot = o_orderkey LEFT JOIN t ON t.slot = o_orderkey""")
def slot_facts(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("slot", F.col("l_orderkey"))
    ev = li.select("slot", F.expr("case l_returnflag when 'R' then 'token_balance_change' when 'N' then 'sol_transfer' else 'spl_transfer_checked' end").alias("kind"))
    tx = li.select("slot", F.expr("case when l_quantity < 5 then 'error' when l_quantity < 10 then 'failed' else 'processed' end").alias("status"))
    st = table(spark, sf, "orders").select(F.col("o_orderkey").alias("slot"), F.col("o_orderstatus").alias("status"))
    f = T.slot_facts(ev, tx, st)
    return f.withColumn("event_counts", F.expr("array_join(transform(event_counts, x -> concat(x.kind, '=', x.n)), ',')"))


KNOWLEDGE = """k AS (SELECT l_linenumber AS seq, l_linenumber * 1000 + l_orderkey % 7 AS recorded_ns, l_orderkey AS slot, l_shipdate, l_partkey,
 CASE l_returnflag WHEN 'N' THEN 'archived' WHEN 'R' THEN 'unresolved' ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'skipped' ELSE 'error' END END AS status, 'd' || (l_partkey % 3) AS h FROM lineitem),
u AS (SELECT seq, recorded_ns, slot, min(status) AS status, min(h) AS h FROM k GROUP BY ALL)"""


def knowledge(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_linenumber").cast("bigint").alias("seq"), (F.col("l_linenumber") * 1000 + F.col("l_orderkey") % 7).alias("recorded_ns"), F.col("l_orderkey").alias("slot")).agg(
        F.min(F.expr("case l_returnflag when 'N' then 'archived' when 'R' then 'unresolved' else case when l_orderkey % 2 = 0 then 'skipped' else 'error' end end")).alias("status"),
        F.min(F.concat(F.lit("d"), F.col("l_partkey") % 3)).alias("document_hash"))


@query("timeline_as_of", f"""WITH {KNOWLEDGE}, c AS (SELECT *, status IN ('archived', 'skipped') AS r, status || CASE WHEN status = 'archived' THEN h ELSE '' END AS ct FROM u WHERE seq <= 5 AND recorded_ns <= 5003 AND slot <= 12000),
g AS (SELECT slot, arg_max(status, r::INT * 100 + seq) AS status, arg_max(seq, r::INT * 100 + seq) AS knowledge_sequence, arg_max(recorded_ns, r::INT * 100 + seq) AS recorded_ns, count(DISTINCT ct) FILTER (WHERE r) > 1 AS conflict FROM c GROUP BY slot)
SELECT r.slot, coalesce(status, 'not_observed') AS status, knowledge_sequence, recorded_ns, coalesce(conflict, false) AS conflict FROM (SELECT unnest(range(0, 12001)) AS slot) r LEFT JOIN g USING (slot)""")
def timeline_as_of(spark, sf):
    return T.timeline_as_of(knowledge(spark, sf), 0, 12000, 5, 5003).select("slot", "status", "knowledge_sequence", "recorded_ns", "conflict")


@query("knowledge_receipts", f"""WITH {EV}, d AS (SELECT 'd' || (seq * 7919 % 3001) AS dataset_id, seq AS arrival FROM ev), f AS (SELECT dataset_id, min(arrival) AS arrival, count(*) AS arrivals FROM d GROUP BY 1),
o AS (SELECT 'd' || pool AS dataset_id, pool + 1 AS sequence FROM (SELECT DISTINCT pool FROM ev)), t AS (SELECT max(sequence) AS top FROM o)
SELECT dataset_id, arrival, arrivals, top + row_number() OVER (ORDER BY arrival) AS sequence, false AS duplicate FROM f, t WHERE dataset_id NOT IN (SELECT dataset_id FROM o)
UNION ALL SELECT dataset_id, arrival, arrivals, sequence, true FROM f JOIN o USING (dataset_id)""")
def knowledge_receipts(spark, sf):
    ev = events(spark, sf)
    d = ev.select(F.concat(F.lit("d"), F.col("seq") * 7919 % 3001).alias("dataset_id"), F.col("seq").alias("arrival"))
    old = ev.select("pool").distinct().select(F.concat(F.lit("d"), F.col("pool")).alias("dataset_id"), (F.col("pool") + 1).alias("sequence"))
    return T.knowledge_receipt(d, old, split=Split(500))
