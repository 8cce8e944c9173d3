"""Validation queries: JSON evidence is written from table rows with known faults and checked again."""

from pyspark.sql import functions as F

from ..functions.jsonio import canonical_json, strict_json
from ..operators import validate as P
from .registry import query
from .views import CAP, EV, captures, events, table


def when_each(n, cases, otherwise):
    """CASE on seq % n: {remainder: text}."""
    out = None
    for k, v in cases.items():
        cond = F.col("seq") % n == k
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(otherwise)


def record_lines(spark, sf):
    ev = events(spark, sf)
    chain = F.col("seq") % 2 == 0
    raw = F.concat(
        F.lit('{"schema_version":'), when_each(29, {1: "2"}, F.lit("1")),
        F.lit(',"source":"feed","source_id":'), when_each(29, {2: '"  "', 3: "7"}, F.concat(F.lit('"s'), F.col("seq"), F.lit('"'))),
        F.lit(',"logical_id":"p'), F.col("pool"), F.lit('","kind":'), when_each(29, {4: '"rumor"'}, F.lit('"swap"')),
        F.lit(',"event_time":'), when_each(29, {5: "true", 6: "-1", 7: "1.5"}, F.col("event_time").cast("string")),
        F.lit(',"slot":'), F.when(chain, F.col("slot").cast("string")).otherwise("null"),
        F.lit(',"blockhash":'), F.when(chain & (F.col("seq") % 29 != 8), '"b"').otherwise("null"),
        F.lit(',"commitment":'), F.when(F.col("seq") % 29 == 9, '"maybe"').when(chain, '"finalized"').otherwise('"offchain"'),
        F.lit(',"revision":'), when_each(29, {10: "-2"}, F.lit("0")), F.lit(',"supersedes":'), when_each(29, {11: "5"}, F.lit("null")),
        F.lit(',"retracted":'), when_each(29, {12: "0"}, F.lit("false")), F.lit(',"payload":'), when_each(29, {13: "[]"}, F.lit('{"a":1}')),
        when_each(29, {14: ',"extra":1', 15: ',"kind":"swap"', 16: ',"x":NaN'}, F.lit("")), when_each(29, {17: ""}, F.lit("}")))
    return ev.select("seq", raw.alias("raw"))


@query("validate_records", """SELECT event_id AS seq, CASE event_id % 29 WHEN 1 THEN 'unsupported schema' WHEN 2 THEN 'invalid identity' WHEN 3 THEN 'invalid identity'
 WHEN 4 THEN 'unsupported kind' WHEN 5 THEN 'invalid time/slot' WHEN 6 THEN 'invalid time/slot' WHEN 7 THEN 'invalid time/slot'
 WHEN 8 THEN CASE WHEN event_id % 2 = 0 THEN 'missing chain identity' ELSE 'ok' END WHEN 9 THEN 'invalid commitment' WHEN 10 THEN 'invalid revision'
 WHEN 11 THEN 'invalid supersedes' WHEN 12 THEN 'invalid payload/retraction' WHEN 13 THEN 'invalid payload/retraction' WHEN 14 THEN 'unknown or missing fields'
 WHEN 15 THEN 'invalid JSON' WHEN 16 THEN 'invalid JSON' WHEN 17 THEN 'invalid JSON' ELSE 'ok' END AS reason FROM events""")
def validate_records(spark, sf):
    return P.validate_record(record_lines(spark, sf)).select("seq", "reason")


@query("strict_json_records", """SELECT event_id AS seq, event_id % 29 NOT IN (15, 16, 17) AS valid FROM events""")
def strict_json_records(spark, sf):
    return record_lines(spark, sf).select("seq", strict_json("raw").isNotNull().alias("valid"))


@query("canonical_json_props", """SELECT event_id AS seq, '{"a":[1,null,"ü"],"k":' || regexp_extract(props, '([0-9]+)', 1) || ',"t":"' || event_type || '"}' AS doc FROM events""")
def canonical_json_props(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit('{ "t" : "'), F.col("event_type"), F.lit('", "k": '), F.regexp_extract("props", "([0-9]+)", 1), F.lit(', "a": [1, null, "\\u00fc"] }'))
    return e.select(F.col("event_id").alias("seq"), canonical_json(text).alias("doc"))


@query("future_clocks", f"""WITH {CAP} SELECT source, source_id, available_at, CASE WHEN available_at + (q - 25) * 1000000 > available_at + 5000000 THEN 'source clock in future' END AS reason FROM cap""")
def future_clocks(spark, sf):
    c = captures(spark, sf).withColumn("event_time", F.col("available_at") + (F.col("q") - 25) * 1000000).withColumn("observed_at", F.col("available_at"))
    return P.future_clock(c).select("source", "source_id", "available_at", "reason")


def responses(spark, sf):
    ok = F.concat(F.lit('{"jsonrpc":"2.0","id":1,"result":{"parentSlot":'), F.col("seq"), F.lit(',"previousBlockhash":"h'), F.col("seq"),
                  F.lit('","blockhash":"h'), F.col("seq") + 1, F.lit('","transactions":[]}}'))
    raw = when_each(13, {
        1: '{"jsonrpc":"2.0","id":1,"error":{"code":-32603,"message":"internal"}}',
        2: '{"jsonrpc":"2.0","id":1,"error":{"code":-32015,"message":"Transaction version (3) is not supported"}}',
        3: '{"jsonrpc":"2.0","id":1,"result":null}', 4: '{"jsonrpc":"2.0","id":2,"result":null}', 5: "not json",
        6: '{"jsonrpc":"2.0","id":1,"result":{"parentSlot":99999999,"previousBlockhash":"a","blockhash":"b","transactions":[]}}',
        7: '{"jsonrpc":"2.0","id":1,"result":{"parentSlot":0,"previousBlockhash":"a","blockhash":"b","transactions":{}}}',
        8: '{"jsonrpc":"2.0","id":1,"error":{"code":-32009}}', 9: '{"jsonrpc":"2.0","id":1,"error":{"code":"x"}}'}, ok)
    return events(spark, sf).select(
        (F.col("seq") + 1).alias("slot"), raw.alias("raw"),
        F.expr("case seq % 13 when 10 then 'timeout' when 11 then 'http_500' end").alias("transport_error"),
        F.lit(1 << 40).alias("tip"), "seq")


RESP = """CASE event_id % 13 WHEN 1 THEN 'rpc_-32603' WHEN 2 THEN 'rpc_-32015' WHEN 3 THEN 'null_result' WHEN 4 THEN 'invalid_rpc_response' WHEN 5 THEN 'invalid_rpc_response'
 WHEN 6 THEN 'invalid_rpc_response' WHEN 7 THEN 'invalid_rpc_response' WHEN 8 THEN 'rpc_-32009' WHEN 9 THEN 'invalid_rpc_response' WHEN 10 THEN 'timeout' WHEN 11 THEN 'http_500' ELSE 'ok' END"""


@query("rpc_responses", f"""SELECT event_id + 1 AS slot, {RESP} AS reason,
 CASE event_id % 13 WHEN 0 THEN 'archived' WHEN 12 THEN 'archived' WHEN 3 THEN 'unavailable' WHEN 8 THEN 'unavailable' WHEN 10 THEN 'unavailable' ELSE 'error' END AS status,
 CASE WHEN event_id % 13 IN (0, 12) THEN '{{"block":{{"blockhash":"h' || (event_id + 1) || '","parentSlot":' || event_id || ',"previousBlockhash":"h' || event_id ||
 '","transactions":[]}},"commitment":"finalized","network":"testnet","schema_version":1,"slot":' || (event_id + 1) || '}}' END AS document FROM events""")
def rpc_responses(spark, sf):
    return P.classify_rpc_response(responses(spark, sf)).select("slot", "status", "reason", "document")


@query("retry_policies", f"""WITH r AS (SELECT event_id + 1 AS slot, {RESP} AS reason FROM events)
SELECT slot, reason, CASE reason WHEN 'rpc_-32015' THEN 'unsupported_transaction_version' WHEN 'rpc_-32603' THEN 'internal_rpc_error' ELSE 'other_unresolved' END AS category,
 CASE reason WHEN 'rpc_-32015' THEN 'only_after_request_version_increase' ELSE 'bounded_backoff' END AS retry,
 CASE reason WHEN 'rpc_-32603' THEN -32603 WHEN 'rpc_-32015' THEN -32015 WHEN 'rpc_-32009' THEN -32009 END AS rpc_code, CASE reason WHEN 'rpc_-32015' THEN 3 END AS version FROM r""")
def retry_policies(spark, sf):
    r = P.classify_rpc_response(responses(spark, sf))
    d, p = P.error_diagnostic("raw"), P.retry_policy("reason")
    return r.select("slot", "reason", p["category"].alias("category"), p["retry"].alias("retry"),
                    F.when(F.col("transport_error").isNull(), d["rpc_code"]).alias("rpc_code"),
                    F.when(F.col("transport_error").isNull(), d["reported_transaction_version"]).alias("version"))


@query("latest_blockhash_records", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN NULL ELSE o_orderkey || ':h' || o_custkey END AS source_id, CASE WHEN o_orderkey % 7 = 1 THEN 'RPC error in capture' ELSE 'ok' END AS reason,
 CASE WHEN o_orderkey % 7 <> 1 THEN '{"blockhash":"h' || o_custkey || '","commitment":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'finalized' END || '","event_time":null,"kind":"observation","logical_id":"solana:slot:' || o_orderkey ||
 '","payload":{"last_valid_block_height":' || (o_custkey + 5) || ',"rpc_method":"getLatestBlockhash"},"retracted":false,"revision":0,"schema_version":1,"slot":' || o_orderkey || ',"source":"solana-rpc","source_id":"' || o_orderkey || ':h' || o_custkey || '","supersedes":null}' END AS document FROM orders""")
def latest_blockhash_records(spark, sf):
    o = table(spark, sf, "orders")
    ok = F.concat(F.lit('{"result":{"context":{"slot":'), F.col("o_orderkey"), F.lit('},"value":{"blockhash":"h'), F.col("o_custkey"),
                  F.lit('","lastValidBlockHeight":'), F.col("o_custkey") + 5, F.lit("}}}"))
    raw = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 1, '{"error":{"code":-1}}').otherwise(ok).alias("raw"),
                   F.lit(None).cast("string").alias("rpc_method"),
                   F.when(F.col("o_orderkey") % 2 == 0, '[{"commitment":"confirmed"}]').otherwise("[]").alias("request_params"))
    out = P.normalize_latest_blockhash(raw)
    return out.select("o_orderkey", F.when(F.col("reason") == "ok", F.col("source_id")).alias("source_id"), "reason", "document")


@query("diagnostic_categories", """SELECT event_id AS seq, CASE event_id % 6 WHEN 0 THEN 'EVIDENCE_REJECT' WHEN 1 THEN 'SOURCE_FAILURE' WHEN 2 THEN 'SOURCE_FAILURE' WHEN 3 THEN 'OPERATIONAL_FAILURE' WHEN 4 THEN 'INTEGRITY_FAILURE' ELSE 'SOFTWARE_EXCEPTION' END AS category FROM events""")
def diagnostic_categories(spark, sf):
    code = F.expr("case seq % 6 when 0 then 'price_impact_limit' when 1 then 'rpc_error' when 2 then 'http_' || (400 + seq % 100) when 3 then 'quota_exhausted' when 4 then 'event_hash_mismatch' else 'http_999' end")
    return events(spark, sf).select("seq", P.diagnostic_category(code).alias("category"))


SECRETS = ["password", "api_key", "a b+c", "ssn", "license"]


@query("secret_echo_documents", """SELECT doc_id, contains(text, 'password') OR contains(text, 'api_key') OR contains(text, 'a b+c') OR contains(text, 'a%20b%2Bc') OR contains(text, 'license') AS secret FROM documents""")
def secret_echo_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.secret_echo("text", SECRETS).alias("secret"))


@query("quote_validity", """WITH q AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS x, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t, l_returnflag AS f, l_linestatus AS s FROM lineitem)
SELECT o, n, p, q, x, CASE WHEN p % 50 = 1 THEN 'quote_mode' WHEN q % 17 = 0 THEN 'invalid_quote_units' WHEN q = 20 THEN 'quote_amount_mismatch' WHEN t = 8 THEN 'quote_slippage_mismatch' WHEN x - d * 300 < x * (10000 - 50) // 10000 THEN 'quote_threshold_invalid'
 WHEN f = 'R' AND s = 'F' THEN 'quote_route_missing' WHEN d = 10 THEN 'quote_impact' ELSE 'ok' END AS reason FROM q""")
def quote_validity(spark, sf):
    c = captures(spark, sf).withColumn("rows", F.lit(1))
    route = F.struct(F.lit(100).alias("percent"), F.col("p").cast("string").alias("amm_key"), F.lit("A").alias("input_mint"), F.lit("B").alias("output_mint"))
    df = c.select(
        F.col("source").alias("o"), F.col("source_id").alias("n"), "p", "q", "x",
        F.lit("A").alias("input_mint"), F.when(F.col("p") % 50 == 1, "A").otherwise("B").alias("output_mint"), F.lit("ExactIn").alias("mode"),
        F.when(F.col("q") % 17 == 0, "-5").otherwise(F.col("q").cast("string")).alias("in_amount"), F.col("x").cast("string").alias("out_amount"),
        (F.col("x") - F.col("d") * 300).cast("string").alias("threshold"), F.lit(50).alias("slippage_bps"), F.lit(5).alias("slot"),
        F.when(F.col("d") == 10, "1.5").otherwise("0.001").alias("impact"),
        F.when(F.col("document") == "R|F", F.array().cast("array<struct<percent:int,amm_key:string,input_mint:string,output_mint:string>>")).otherwise(F.array(route)).alias("routes"),
        F.lit("A").alias("request_input"), F.when(F.col("p") % 50 == 1, "A").otherwise("B").alias("request_output"),
        F.when(F.col("q") == 20, 1).otherwise(F.col("q")).alias("request_amount"), F.when(F.col("a") == 8, 60).otherwise(50).alias("request_slippage_bps"))
    return P.quote_valid(df).select("o", "n", "p", "q", "x", "reason")


@query("direct_routes", """SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, CASE WHEN l_quantity > 40 THEN 'split_route_unsupported' WHEN l_partkey % 9 = 2 THEN 'route_pool_mismatch' END AS reason FROM lineitem""")
def direct_routes(spark, sf):
    li = table(spark, sf, "lineitem")
    pool = F.when(F.col("l_partkey") % 9 == 2, "other").otherwise("pool")
    leg = F.struct(F.lit(100).alias("percent"), pool.alias("amm_key"), F.lit("A").alias("input_mint"), F.lit("B").alias("output_mint"))
    df = li.withColumn("routes", F.when(F.col("l_quantity") > 40, F.array(leg, leg)).otherwise(F.array(leg)))
    return df.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
                     P.direct_route("routes", F.lit("pool"), F.lit("A"), F.lit("B")).alias("reason"))


def mint_accounts(spark, sf):
    """A mint account document per part, with one fault kind per remainder."""
    p = table(spark, sf, "part").withColumn("seq", F.col("p_partkey"))
    new = F.col("seq") % 3 == 0
    ext = F.concat(
        F.lit('[{"extension":"metadataPointer","state":{"authority":'), when_each(17, {1: '"x"'}, F.lit("null")), F.lit(',"metadataAddress":"m'), F.col("seq"),
        F.lit('"}},{"extension":"'), when_each(17, {2: "transferHook"}, F.lit("tokenMetadata")), F.lit('","state":{"updateAuthority":null,"mint":"m'),
        F.when(F.col("seq") % 17 == 3, F.lit("other")).otherwise(F.col("seq").cast("string")), F.lit('","name":"n","symbol":'), when_each(17, {4: "5"}, F.lit('"s"')),
        F.lit(',"uri":"u","additionalMetadata":'), when_each(17, {5: '[["a"]]', 6: '[["a","b"]]'}, F.lit("[]")), F.lit("}}]"))
    doc = F.concat(
        F.lit('{"executable":'), when_each(17, {7: "true"}, F.lit("false")), F.lit(',"owner":"'),
        F.when(F.col("seq") % 17 == 8, "Else").when(new, P.TOKEN_2022).otherwise(P.TOKEN), F.lit('","data":{"program":"'), when_each(17, {9: "spl-token"}, F.lit("spl-token-2022")),
        F.lit('","parsed":{"type":"'), when_each(17, {10: "account"}, F.lit("mint")), F.lit('","info":{"isInitialized":true,"mintAuthority":'), when_each(17, {11: '"k"'}, F.lit("null")),
        F.lit(',"freezeAuthority":null,"decimals":'), when_each(17, {12: "300"}, F.lit("6")), F.lit(',"supply":"'), when_each(17, {13: "12x"}, F.lit("1000")), F.lit('"'),
        F.when(new, F.concat(F.lit(',"extensions":'), ext)).otherwise(""), F.lit("}}}}"))
    return p.select("seq", doc.alias("account"), F.concat(F.lit("m"), F.col("seq")).alias("mint"))


@query("mint_profiles", """WITH r AS (SELECT p_partkey AS seq, p_partkey % 3 = 0 AS nw, p_partkey % 17 AS k FROM part),
s AS (SELECT *, CASE WHEN k = 7 THEN 'executable_token_account' WHEN k = 8 THEN 'unsupported_token_program' WHEN k = 10 THEN 'not_mint' WHEN k = 11 THEN 'mint_or_freeze_authority_present'
 WHEN nw AND k = 9 THEN 'token2022_parser_mismatch' WHEN nw AND k = 2 THEN 'unsupported_mint_extensions' WHEN nw AND k = 1 THEN 'mutable_or_external_metadata_pointer'
 WHEN nw AND k = 3 THEN 'mutable_or_unbound_token_metadata' WHEN nw AND k IN (4, 5) THEN 'unsupported_metadata_layout' WHEN nw AND k = 12 THEN 'invalid_mint_decimals' WHEN nw AND k = 13 THEN 'invalid_mint_supply' ELSE 'ok' END AS reason FROM r)
SELECT seq, reason, CASE WHEN reason = 'ok' THEN CASE WHEN nw THEN 'token2022-immutable-self-metadata-v1' ELSE 'classic-spl-v1' END END AS profile FROM s""")
def mint_profiles(spark, sf):
    return P.mint_profile(mint_accounts(spark, sf)).select("seq", "reason", "profile")


@query("vault_profiles", """SELECT p_partkey AS seq, CASE p_partkey % 11 WHEN 1 THEN 'executable_token_account' WHEN 2 THEN 'vault_mint_program_mismatch' WHEN 3 THEN 'not_token_account'
 WHEN 4 THEN 'unsupported_vault_extensions' WHEN 5 THEN CASE WHEN p_partkey % 2 = 0 THEN 'token2022_parser_mismatch' ELSE 'ok' END ELSE 'ok' END AS reason FROM part""")
def vault_profiles(spark, sf):
    p = table(spark, sf, "part").withColumn("seq", F.col("p_partkey"))
    program = F.when(F.col("seq") % 2 == 0, P.TOKEN_2022).otherwise(P.TOKEN)
    ext = F.when(F.col("seq") % 11 == 4, ',"extensions":[{"extension":"memo"}]').when(F.col("seq") % 2 == 0, ',"extensions":[{"extension":"immutableOwner"}]').otherwise("")
    doc = F.concat(F.lit('{"executable":'), when_each(11, {1: "true"}, F.lit("false")), F.lit(',"owner":"'), F.when(F.col("seq") % 11 == 2, "x").otherwise(program),
                   F.lit('","data":{"program":"'), when_each(11, {5: "old"}, F.lit("spl-token-2022")), F.lit('","parsed":{"type":"'), when_each(11, {3: "mint"}, F.lit("account")),
                   F.lit('","info":{"mint":"m"'), ext, F.lit("}}}}"))
    return P.vault_profile(p.select("seq", doc.alias("account"), program.alias("mint_program"))).select("seq", "reason")


@query("datum_states", f"""WITH {EV} SELECT seq, CASE WHEN kind = 'failed' THEN 'UNKNOWN' WHEN kind = 'pool_created' OR quote_raw > 5000 THEN 'STALE' ELSE 'FRESH' END AS status,
 CASE WHEN kind <> 'pool_created' THEN quote_raw * 1000000 END AS age_ns FROM ev""")
def datum_states(spark, sf):
    ev = events(spark, sf)
    value = F.when(F.col("kind") != "failed", F.col("base_raw"))
    at = F.when(F.col("kind") != "pool_created", F.col("availability_ns") - F.col("quote_raw") * 1_000_000)
    s = P.datum_status(value, at, "availability_ns")
    return ev.select("seq", s["status"].alias("status"), s["age_ns"].alias("age_ns"))


@query("balance_rows", """WITH r AS (SELECT l_orderkey AS tx, l_linenumber AS account_index, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, l_suppkey AS s, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem)
SELECT tx, account_index, p, q, s, CASE WHEN account_index >= 6 THEN 'token_account_index' WHEN s % 20 = 1 THEN 'invalid_account_key' WHEN q % 10 = 3 THEN 'invalid_token_amount' WHEN p % 300 > 255 THEN 'invalid_token_decimals' WHEN c > 1 THEN 'duplicate_token_balance' ELSE 'ok' END AS reason FROM r""")
def balance_rows(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("account_index"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("bigint").alias("q"),
        F.col("l_suppkey").alias("s"), (F.col("l_suppkey") % 20 != 1).alias("mint_ok"), F.lit(6).alias("n_keys"), (F.col("l_partkey") % 300).alias("decimals"))
    amount = F.when(F.col("q") % 10 == 3, F.concat(F.col("q").cast("string"), F.lit("e1"))).otherwise(F.col("q").cast("string"))
    return P.balance_row_valid(li.withColumn("amount", amount)).select("tx", "account_index", "p", "q", "s", "reason")


@query("report_alerts", """WITH m AS (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity < 3) AS de, count(*) FILTER (WHERE l_tax > 0.075) AS nr, count(*) FILTER (WHERE l_discount > 0.095) AS pa, count(*) FILTER (WHERE l_returnflag = 'R') AS un, count(*) > 3 AS sc FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter([CASE WHEN NOT sc THEN 'slots_unresolved' END, CASE WHEN de > 0 THEN 'decoder_errors' END, CASE WHEN nr > 0 THEN 'token_balances_not_recorded' END, CASE WHEN pa > 0 THEN 'token_deltas_unknown' END,
 CASE WHEN un > 0 THEN 'unsupported_instructions' END], lambda x: x IS NOT NULL), ',') AS alerts, CASE WHEN de > 0 THEN 'FAIL' ELSE 'PASS' END AS status, sc AND de = 0 AS ready FROM m""")
def report_alerts(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_quantity") < 3).alias("decoder_errors"), F.count_if(F.col("l_tax") > 0.075).alias("token_balance_not_recorded"),
        F.count_if(F.col("l_discount") > 0.095).alias("token_balance_partial"), F.count_if(F.col("l_returnflag") == "R").alias("unsupported_instructions"),
        (F.count(F.lit(1)) > 3).alias("source_complete"))
    m = m.withColumns({"transaction_errors": F.lit(0), "instruction_errors": F.lit(0), "included_range_complete": F.col("source_complete")})
    return P.report_alerts(m).select("l_orderkey", F.array_join("alerts", ",").alias("alerts"), "status", "ready")


@query("watch_stages", f"""WITH {EV}, c AS (SELECT pool, seq // 100 AS win, count(*) FILTER (WHERE kind = 'pool_created') AS po, count(*) FILTER (WHERE kind = 'pool_created' AND base_raw > 50) AS oa, count(*) FILTER (WHERE instruction = 'buy') AS th,
 count(*) FILTER (WHERE base_raw > 20) AS ns, max(base_raw) > 10 AS na FROM ev GROUP BY ALL)
SELECT pool, win, CASE WHEN NOT na THEN 'NO_NETWORK_CALL' WHEN po > 0 AND oa = 0 THEN 'NEW_OBSERVATION_REJECTED' WHEN po > 0 THEN 'NEW_POSITION_OBSERVATION' WHEN th > 0 THEN 'NEW_TRANSACTION_UNSUPPORTED' WHEN ns > 0 THEN 'NEW_SIGNATURE_NOT_HYDRATED' ELSE 'NO_NEW_SIGNATURE' END AS stage FROM c""")
def watch_stages(spark, sf):
    c = events(spark, sf).groupBy("pool", F.expr("seq div 100").alias("win")).agg(
        F.expr("count_if(kind = 'pool_created')").alias("position_observations"), F.expr("count_if(kind = 'pool_created' and base_raw > 50)").alias("observations_accepted"),
        F.expr("count_if(instruction = 'buy')").alias("transactions_hydrated"), F.expr("count_if(base_raw > 20)").alias("new_signatures_found"), F.expr("max(base_raw) > 10").alias("network_attempted"))
    return P.watch_stage(c).select("pool", "win", "stage")


@query("watch_qualifications", f"""WITH {EV}, c AS (SELECT pool, seq // 100 AS win, count(*) FILTER (WHERE kind = 'pool_created') AS po, list_sort(list_distinct(list(CASE WHEN base_raw = 17 THEN 'http_' || (400 + wallet) END) FILTER (WHERE base_raw = 17))) AS er FROM ev GROUP BY ALL)
SELECT pool, win, CASE WHEN len(coalesce(er, [])) > 0 THEN 'FAIL' WHEN po = 0 THEN 'NOT_EXECUTED' ELSE 'PASS' END AS status,
 CASE WHEN len(coalesce(er, [])) > 0 THEN 'position_source_error' WHEN po = 0 THEN 'no_new_position_observation' ELSE 'position_bounded_observation' END AS code, coalesce(array_to_string(er, ','), '') AS errors FROM c""")
def watch_qualifications(spark, sf):
    c = events(spark, sf).groupBy("pool", F.expr("seq div 100").alias("win")).agg(
        F.expr("count_if(kind = 'pool_created')").alias("position_observations"),
        F.expr("collect_set(case when base_raw = 17 then concat('http_', 400 + wallet) when base_raw = 18 then 'quota_exhausted' end)").alias("errors"))
    return P.watch_qualification(c).select("pool", "win", "status", "code", F.array_join("source_error_codes", ",").alias("errors"))


@query("secret_echo_joined", """WITH s AS (SELECT DISTINCT substr(text, 40, 6 + CAST(doc_id % 23 AS INTEGER)) AS secret FROM documents WHERE doc_id % 10 = 3 AND length(text) >= 70)
SELECT d.doc_id, coalesce(bool_or(contains(d.text, s.secret)), false) AS secret FROM documents d LEFT JOIN s ON contains(d.text, s.secret) GROUP BY d.doc_id""")
def secret_echo_joined(spark, sf):
    """Documents that hold any of the secrets of a table; here pieces of some of the documents themselves."""
    d = table(spark, sf, "documents")
    piece = F.substring("text", F.lit(40), (6 + F.col("doc_id") % 23).cast("int"))
    s = d.where((F.col("doc_id") % 10 == 3) & (F.char_length("text") >= 70)).select(piece.alias("secret"))
    return P.secret_echo_join(d, s, "doc_id", "text").select("doc_id", F.col("secret_echo").alias("secret"))
