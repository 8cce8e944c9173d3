"""Decode queries over the nested stand-ins."""

from pyspark.sql import functions as F

from ..functions.codecs import base58_decode
from ..operators import decode as D
from .nested import NESTED, blocks, exchange_transactions
from .registry import query
from .views import BLOCKS, EV, table
from .views import blocks as range_tables


def transactions(spark, sf):
    return D.explode_transactions(blocks(spark, sf))


@query("transactions", f"WITH {NESTED} SELECT slot, ti AS transaction_index, status, reason, CASE WHEN status = 'processed' THEN CASE WHEN q % 2 = 1 THEN 'unavailable' ELSE 'recorded' END END AS inner_coverage FROM tx")
def transactions_q(spark, sf):
    return transactions(spark, sf).select("slot", "transaction_index", "status", "reason", "inner_coverage")


@query("resolved_keys", f"WITH {NESTED} SELECT slot, ti AS transaction_index, sha256('p' || p) AS first_key, 5 AS n_keys FROM tx")
def resolved_keys(spark, sf):
    return transactions(spark, sf).select("slot", "transaction_index", F.lower(F.hex(base58_decode(F.get("keys", F.lit(0))))).alias("first_key"), F.size("keys").alias("n_keys"))


@query("instructions", f"WITH {NESTED} SELECT slot, ti AS transaction_index, 0 AS instruction_index, CASE WHEN deep THEN 0 END AS inner_instruction_index FROM ix")
def instructions(spark, sf):
    return D.explode_instructions(transactions(spark, sf)).select("slot", "transaction_index", "instruction_index", "inner_instruction_index")


@query("native_transfers", f"""WITH {NESTED} SELECT slot, ti AS transaction_index, deep, ist AS status, ire AS reason, CASE WHEN ist = 'decoded' THEN x END AS lamports,
 CASE WHEN ist = 'decoded' THEN sha256('p' || p) END AS source, CASE WHEN ist = 'decoded' THEN sha256('s' || s) END AS destination FROM ds""")
def native_transfers(spark, sf):
    d = D.decode_native_transfer(D.explode_instructions(transactions(spark, sf)))
    return d.select("slot", "transaction_index", F.col("inner_instruction_index").isNotNull().alias("deep"), "status", "reason", F.col("lamports").cast("bigint").alias("lamports"),
                    F.lower(F.hex(base58_decode("source"))).alias("source"), F.lower(F.hex(base58_decode("destination"))).alias("destination"))


@query("token_transfers", f"""WITH {NESTED} SELECT slot, ti AS transaction_index, CASE WHEN f = 'R' THEN 'decoded' ELSE 'unsupported' END AS status, CASE WHEN f = 'R' THEN x END AS amount_raw,
 CASE WHEN f = 'R' THEN n END AS decimals, CASE WHEN f = 'R' THEN sha256('s' || s) END AS mint FROM ix WHERE NOT deep""")
def token_transfers(spark, sf):
    d = D.decode_token_transfer(D.explode_instructions(transactions(spark, sf)))
    return d.select("slot", "transaction_index", "status", F.col("amount_raw").cast("bigint").alias("amount_raw"), F.col("decimals").cast("bigint").alias("decimals"),
                    F.lower(F.hex(base58_decode("mint"))).alias("mint"))


@query("combined_events", f"""WITH {NESTED} SELECT slot, ti AS transaction_index, CASE WHEN f = 'N' AND q <> 7 THEN 'decoded_native' WHEN f = 'R' THEN 'decoded' ELSE 'unsupported' END AS status,
 CASE WHEN f = 'N' AND q <> 7 THEN 'sol_transfer' WHEN f = 'R' THEN 'spl_transfer_checked' END AS kind, CASE WHEN (f = 'N' AND q <> 7) OR f = 'R' THEN x END AS amount FROM ix WHERE NOT deep""")
def combined_events(spark, sf):
    d = D.combine_events(D.explode_instructions(transactions(spark, sf)))
    return d.select("slot", "transaction_index", "status", "kind", F.col("amount").cast("bigint").alias("amount"))


@query("nested_balance_changes", f"""WITH {NESTED}, b AS (SELECT slot, ti AS transaction_index, q * 100 AS pre, q * 100 + x % 7 - 3 AS post, q % 3 = 0 AS np, q % 3 = 1 AND s % 5 = 0 AS one FROM tx WHERE status = 'processed')
SELECT slot, transaction_index, CASE WHEN np THEN 'not_recorded' WHEN one THEN 'partial' ELSE 'recorded' END AS token_balance_status,
 CASE WHEN np THEN 0 WHEN one THEN 1 WHEN post = pre THEN 0 ELSE 1 END AS changes, CASE WHEN NOT np AND NOT one AND post <> pre THEN post - pre END AS delta FROM b""")
def nested_balance_changes(spark, sf):
    c = D.balance_changes(transactions(spark, sf))
    return c.select("slot", "transaction_index", "token_balance_status", F.coalesce(F.size("changes"), F.lit(0)).alias("changes"),
                    F.get("changes", F.lit(0))["delta_raw"].cast("bigint").alias("delta"))


@query("token_balance_delta", """WITH b AS (SELECT user_id AS tx, event_type AS k, ts < TIMESTAMP '2024-01-16' AS early, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount, min(user_id % 5) AS m FROM events GROUP BY ALL),
p AS (SELECT * FROM b WHERE early), q AS (SELECT tx, k, amount, CASE WHEN k = 'view' THEN m + 1 ELSE m END AS m FROM b WHERE NOT early),
j AS (SELECT coalesce(p.tx, q.tx) AS tx, coalesce(p.k, q.k) AS account_index, p.amount AS before, q.amount AS after, coalesce(p.m = q.m, false) AS delta_known FROM p FULL JOIN q ON p.tx = q.tx AND p.k = q.k)
SELECT *, CASE WHEN delta_known THEN after - before END AS delta_raw FROM j WHERE NOT delta_known OR after <> before""")
def token_balance_delta(spark, sf):
    e = table(spark, sf, "events")
    b = e.groupBy(F.col("user_id").alias("tx"), F.col("event_type").alias("account_index"), (F.col("ts") < F.lit("2024-01-16 00:00:00").cast(e.schema["ts"].dataType)).alias("early")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("amount"), F.min(F.col("user_id") % 5).alias("mint"))
    b = b.withColumns({"decimals": F.lit(6), "program": F.lit(None).cast("string")})
    post = b.where("not early").withColumn("mint", F.when(F.col("account_index") == "view", F.col("mint") + 1).otherwise(F.col("mint")))
    return D.token_balance_delta(b.where("early"), post).select("tx", "account_index", "before", "after", F.col("delta_raw").cast("bigint").alias("delta_raw"), "delta_known")


STATE = """CASE seq % 11 WHEN 1 THEN 'unresolved' WHEN 2 THEN 'error' WHEN 3 THEN 'unresolved' WHEN 4 THEN 'error' WHEN 5 THEN 'error' ELSE 'decoded' END"""
WHY = """CASE seq % 11 WHEN 1 THEN 'matching_event_missing' WHEN 2 THEN 'invalid_protocol_evidence' WHEN 3 THEN '{deep}' WHEN 4 THEN 'invalid_protocol_evidence' WHEN 5 THEN 'invalid_protocol_evidence' ELSE 'ok' END"""
AMOUNTS = f"""CASE WHEN {STATE} = 'decoded' THEN CASE WHEN instruction = 'sell' THEN base_raw ELSE quote_raw END END AS input_amount_raw,
 CASE WHEN {STATE} = 'decoded' THEN CASE WHEN instruction = 'sell' THEN quote_raw ELSE base_raw END END AS output_amount_raw"""


def exchange_columns(df, *more):
    return df.select(F.col("slot").alias("seq"), *more, "status", "reason", F.col("inner_instruction_index").cast("bigint").alias("inner_index"),
                     F.col("input_amount_raw").cast("bigint").alias("input_amount_raw"), F.col("output_amount_raw").cast("bigint").alias("output_amount_raw"),
                     F.lower(F.hex(base58_decode("pool"))).alias("pool"), F.try_element_at("fields", F.lit("virtual_quote_reserves")).alias("virtual"))


@query("protocol_events", f"""WITH {EV} SELECT seq, {STATE} AS status, {WHY.format(deep='event_stack_unproven')} AS reason, CASE WHEN {STATE} = 'decoded' THEN CASE WHEN seq % 11 = 6 THEN 1 ELSE 0 END END AS inner_index,
 {AMOUNTS}, CASE WHEN {STATE} = 'decoded' THEN sha256('pool' || pool) END AS pool, CASE WHEN {STATE} = 'decoded' THEN '-12' END AS virtual FROM sw""")
def protocol_events(spark, sf):
    return exchange_columns(D.dex_events(exchange_transactions(spark, sf)))


@query("protocol_event_calls", f"WITH {EV} SELECT seq, {STATE} AS status, CASE WHEN {STATE} = 'decoded' THEN 'swap' END AS kind, instruction FROM sw")
def protocol_event_calls(spark, sf):
    calls = D.top_level_calls(exchange_transactions(spark, sf))
    return D.decode_protocol_event(calls).select(F.col("slot").alias("seq"), "status", "kind", "instruction")


# a bare record that the program sends to itself without the event tag is a call of its own, below the routed one
ROUTED = f"""SELECT seq, 1 AS parent_inner_index, {STATE} AS status, {WHY.format(deep='subtree_depth_missing')} AS reason, CASE WHEN {STATE} = 'decoded' THEN CASE WHEN seq % 11 = 6 THEN 3 ELSE 2 END END AS inner_index,
 {AMOUNTS}, CASE WHEN {STATE} = 'decoded' THEN sha256('pool' || pool) END AS pool, CASE WHEN {STATE} = 'decoded' THEN '-12' END AS virtual FROM sw"""


@query("routed_events", f"""WITH {EV} {ROUTED}
UNION ALL SELECT seq, 2, 'unsupported', 'instruction_not_supported', NULL, NULL, NULL, NULL, NULL FROM sw WHERE seq % 11 IN (1, 6)""")
def routed_events(spark, sf):
    r = D.routed_calls(exchange_transactions(spark, sf, routed=True))
    return exchange_columns(r, "parent_inner_index")


@query("inner_call_parents", f"""WITH {EV}, g AS (SELECT seq, CASE WHEN seq % 11 IN (2, 6) THEN 2 ELSE 1 END AS n FROM sw),
i AS (SELECT seq, n, unnest(range(n + 3)) AS k FROM g)
SELECT seq, k AS inner_index, CASE WHEN k >= 2 AND k < n + 2 THEN CASE WHEN seq % 11 = 3 THEN NULL ELSE 3 END ELSE 2 END AS depth,
 CASE WHEN k >= 2 AND k < n + 2 AND seq % 11 <> 3 THEN 1 END AS parent, CASE WHEN seq % 11 = 3 AND k = 2 THEN 'depth_missing' ELSE 'ok' END AS state FROM i""")
def inner_call_parents(spark, sf):
    c = D.inner_calls(exchange_transactions(spark, sf, routed=True))
    return c.select(F.col("slot").alias("seq"), F.col("inner_instruction_index").cast("bigint").alias("inner_index"), "depth", F.col("parent_inner_index").alias("parent"), "state")


@query("routed_by_router", f"WITH {EV} SELECT seq, 'unsupported' AS status, 'routed_protocol_not_supported' AS reason FROM sw")
def routed_by_router(spark, sf):
    return D.dex_events(exchange_transactions(spark, sf, routed=True)).select(F.col("slot").alias("seq"), "status", "reason")


@query("named_accounts", f"WITH {EV} SELECT seq, sha256('pool' || pool) AS pool, sha256('user' || wallet) AS usr, CASE WHEN instruction = 'sell' THEN 21 ELSE 23 END AS n FROM sw")
def named_accounts(spark, sf):
    calls = D.top_level_calls(exchange_transactions(spark, sf))
    n = F.size("ix.accounts")
    named = D.named_accounts(F.when(n == 21, "sell").otherwise("buy"), F.col("ix.accounts"), F.col("keys"))
    calls = calls.withColumn("named", named)
    return calls.select(F.col("slot").alias("seq"), F.lower(F.hex(base58_decode(F.col("named")["pool"]))).alias("pool"), F.lower(F.hex(base58_decode(F.col("named")["user"]))).alias("usr"),
                        F.size("named").alias("n"))


@query("decode_coverage", f"""WITH {NESTED}, t AS (SELECT slot, count(*) FILTER (WHERE status = 'processed') AS transactions_processed, count(*) FILTER (WHERE status = 'failed') AS transactions_failed, count(*) FILTER (WHERE status = 'unsupported') AS transactions_unsupported,
 count(*) FILTER (WHERE status = 'error') AS transactions_error, count(*) AS transactions_expected, count(*) FILTER (WHERE status = 'processed' AND q % 2 = 1) AS inner_coverage_unavailable FROM tx GROUP BY slot),
i AS (SELECT slot, count(*) FILTER (WHERE ist = 'decoded') AS de, count(*) FILTER (WHERE ist = 'unsupported') AS un, count(*) AS ob FROM ds GROUP BY slot)
SELECT t.*, coalesce(de, 0) AS instructions_decoded, coalesce(un, 0) AS instructions_unsupported, 0 AS instructions_error, coalesce(ob, 0) AS instructions_observed, true AS accounting_ok,
 transactions_error + transactions_unsupported + coalesce(un, 0) + inner_coverage_unavailable = 0 AS fully_decoded FROM t LEFT JOIN i USING (slot)""")
def decode_coverage(spark, sf):
    return D.decode_coverage(D.decode_native_transfer(D.explode_instructions(transactions(spark, sf), every=True)))


@query("event_provenance", f"""WITH {BLOCKS}, e AS (SELECT l_orderkey AS slot, count(*) AS n FROM lineitem GROUP BY 1) SELECT e.slot, n, attempt_id, document_hash AS block_document_sha256,
 CASE WHEN attempt_id IS NULL THEN 'publication_missing' ELSE 'ok' END AS provenance_reason FROM e LEFT JOIN pb USING (slot)""")
def event_provenance(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    p = range_tables(spark, sf)["publications"].withColumnRenamed("document_hash", "block_document_sha256")
    return D.attach_event_provenance(e, p).select("slot", "n", "provenance.attempt_id", "provenance.block_document_sha256", "provenance_reason")


@query("transaction_views", f"""WITH {NESTED} SELECT slot, ti AS transaction_index, CASE WHEN q <> 50 THEN x END AS fee_lamports, status,
 CASE WHEN status = 'failed' THEN 'transaction_failed' WHEN status <> 'processed' THEN 'unknown' WHEN q % 3 = 0 THEN 'not_recorded' WHEN q % 3 = 1 AND s % 5 = 0 THEN 'partial' ELSE 'recorded' END AS token_balance_status,
 CASE WHEN status = 'processed' THEN CASE WHEN f = 'N' AND q <> 7 THEN '0:decoded_native' WHEN f = 'R' THEN '0:decoded' ELSE '0:unsupported' END ELSE '' END AS results FROM tx""")
def transaction_views(spark, sf):
    t = D.with_balance_status(transactions(spark, sf))
    v = D.transaction_view(D.combine_events(D.explode_instructions(t, every=True, carry=("fee", "token_balance_status"))))
    return v.select("slot", "transaction_index", F.col("fee_lamports").cast("bigint").alias("fee_lamports"), "status", "token_balance_status",
                    F.expr("coalesce(array_join(transform(instruction_results, r -> concat(r.instruction_index, ':', r.status)), ','), '')").alias("results"))


@query("duplicate_signatures", f"WITH {NESTED} SELECT slot, ti AS transaction_index FROM tx WHERE reason = 'duplicate_transaction_signature'")
def duplicate_signatures(spark, sf):
    return D.duplicate_signatures(transactions(spark, sf)).select("slot", "transaction_index")


@query("imported_blocks", f"WITH {BLOCKS} SELECT 'testnet:' || slot || ':' || blockhash AS block_key, slot, 'raw' || attempt_id AS raw, 'c' || (slot % 3) AS context FROM pb ORDER BY slot LIMIT 500")
def imported_blocks(spark, sf):
    b = range_tables(spark, sf)
    sessions = spark.range(3).withColumn("context", F.concat(F.lit("c"), F.col("id")))
    return D.import_blocks(b["publications"], b["attempts"], sessions, "testnet", 500).select("block_key", "slot", "raw", "context")


@query("imported_blocks_all", f"WITH {BLOCKS} SELECT 'testnet:' || slot || ':' || blockhash AS block_key, slot, 'raw' || attempt_id AS raw, 'c' || (slot % 3) AS context FROM pb")
def imported_blocks_all(spark, sf):
    b = range_tables(spark, sf)
    sessions = spark.range(3).withColumn("context", F.concat(F.lit("c"), F.col("id")))
    return D.import_blocks(b["publications"], b["attempts"], sessions, "testnet").select("block_key", "slot", "raw", "context")
