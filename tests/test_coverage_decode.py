import json
from random import Random

from conftest import rows_of

from tidemark.functions import codecs as K
from tidemark.functions import protocol
from tidemark.operators import coverage as C
from tidemark.operators import decode as D
from tidemark.operators import timeline as T
from tidemark.operators.ordered import Split


def test_range_with_one_proven_skip(spark):
    attempts = spark.createDataFrame([(1, 100), (2, 102), (3, 103), (4, 104), (5, 105)], "id bigint, slot bigint")
    attempts = attempts.selectExpr("id", "slot", "1L session_id", "cast('raw' as binary) raw", "'h' raw_hash")
    outcomes = spark.createDataFrame([(1, "archived", "ok"), (2, "archived", "ok"), (3, "unavailable", "null_result"), (4, "error", "rpc_-32603"), (5, "archived", "ok")],
                                     "attempt_id bigint, status string, reason string").selectExpr("*", "'d' document_hash")
    pubs = spark.createDataFrame([(100, 1, "h100", "h99", 99), (102, 2, "h102", "h100", 100), (105, 5, "h105", "h104", 104)],
                                 "slot bigint, attempt_id bigint, blockhash string, previous_blockhash string, parent_slot bigint").selectExpr("*", "'d' document_hash")
    states = C.slot_spine(spark, 100, 105, C.slot_state(attempts, outcomes, C.skip_proofs(pubs)))
    r = rows_of(C.coverage_report(states, attempts, outcomes, 100, 105))[0]
    assert (r["archived"], r["skipped"], r["unavailable"], r["error"], r["accounting_ok"]) == (3, 1, 1, 1, True)
    assert {x["slot"]: x["status"] for x in rows_of(states)}[101] == "skipped"
    assert C.checkpoint(spark, 100, 105, attempts, outcomes).first()[0] == 101
    assert C.projection_audit(states, attempts, outcomes, pubs).count() == 0 and C.chain_conflicts(pubs).count() == 0
    queue = C.retry_queue(states, attempts.selectExpr("id", "1 request_version"), 106, 1)
    assert sorted(x["slot"] for x in rows_of(queue)) == [103, 104]


def test_long_gap_is_proven_in_chunks(spark):
    pubs = spark.createDataFrame([(1, 1, "a", "z", 0), (250_002, 2, "b", "a", 1)], "slot bigint, attempt_id bigint, blockhash string, previous_blockhash string, parent_slot bigint")
    p = C.skip_proofs(pubs)
    assert p.count() == 250_000 and p.selectExpr("min(slot)", "max(slot)").first()[:] == (2, 250_001)


def test_chain_conflict_inside_a_gap(spark):
    rows = [(n, n, f"h{n}", f"h{n - 1}", n - 1) for n in range(1, 30)] + [(40, 40, "h40", "h20", 20)]
    pubs = spark.createDataFrame(rows, "slot bigint, attempt_id bigint, blockhash string, previous_blockhash string, parent_slot bigint")
    for split in (Split(), Split(5)):
        assert sorted(r["slot"] for r in rows_of(C.chain_conflicts(pubs, split=split))) == list(range(21, 30))


def test_resolved_knowledge_is_not_replaced_by_less_complete(spark):
    k = spark.createDataFrame([(1, 10, 5, "archived", "a"), (2, 20, 5, "error", None), (1, 10, 6, "error", None), (3, 30, 6, "skipped", None), (2, 20, 7, "archived", "x"), (3, 30, 7, "archived", "y")],
                              "seq bigint, recorded_ns bigint, slot bigint, status string, document_hash string")
    now = {r["slot"]: (r["status"], r["knowledge_sequence"], r["conflict"]) for r in rows_of(T.timeline_as_of(k, 5, 8))}
    assert now == {5: ("archived", 1, False), 6: ("skipped", 3, False), 7: ("archived", 3, True), 8: ("not_observed", None, False)}
    then = {r["slot"]: r["status"] for r in rows_of(T.timeline_as_of(k, 5, 8, sequence=2))}
    assert then[6] == "error" and then[8] == "not_observed"


def test_base58_batch_equals_plain_integers():
    rnd = Random(1)
    raws = [bytes(rnd.randrange(256) for _ in range(rnd.choice([1, 8, 31, 32, 33, 63, 64, 70]))) for _ in range(300)] + [bytes(32), b"\0\0\1", b""]
    texts = K.encode_batch(raws)
    assert texts == [K.to_base58(r) for r in raws]
    assert K.decode_batch(texts) == [r if r else None for r in raws]
    assert K.decode_batch(["0", "", None, "l1", "1" * 300]) == [None, None, None, None, bytes(300)]


def key(n):
    return K.to_base58(bytes([n]) * 32)


def document(slot, txs):
    return json.dumps({"slot": slot, "block": {"blockhash": "b", "previousBlockhash": "a", "parentSlot": slot - 1, "transactions": txs}})


def native(amount, sig=7, err=None, data=None, inner=None, pre=None, post=None, version="legacy", keys=None, drop=()):
    payload = (2).to_bytes(4, "little") + amount.to_bytes(8, "little")
    meta = {"err": err, "fee": 5000, "innerInstructions": inner, "preTokenBalances": pre, "postTokenBalances": post}
    return {"version": version, "meta": {k: v for k, v in meta.items() if k not in drop}, "transaction": {"signatures": [K.to_base58(bytes([sig]) * 64)], "message": {
        "accountKeys": keys or [key(1), key(2), D.SYSTEM], "instructions": [{"programIdIndex": 2, "accounts": [0, 1], "data": data or K.to_base58(payload)}]}}}


def balance(mint, amount):
    return {"accountIndex": 0, "mint": mint, "owner": key(3), "programId": key(4), "uiTokenAmount": {"amount": str(amount), "decimals": 6}}


def test_documents_to_transfers(spark):
    m, other = key(9), key(8)
    txs = [
        native(123, 1, inner=[]), native(2**64 - 1, 2, inner=[]), native(5, 3, err={"InstructionError": [0]}), native(5, 1), native(5, 4, version=9), native(5, 5, drop=("err",)),
        native(5, 6, keys=["bad", key(2), D.SYSTEM]), native(5, 8, data=K.to_base58(b"\3\0\0\0")), native(5, 9, keys=[key(1), key(2), key(5)]), native(5, 10, pre=[balance(m, 100)], post=[balance(m, 88)]),
        native(5, 11, pre=[], post=[balance(m, 12)]), native(5, 12, pre=[balance(m, 1)], post=[balance(other, 1)]), native(5, 13, pre=[balance(m, 1)], post=[balance(m, 1)]),
        native(5, 14, inner=[{"index": 3, "instructions": []}]),
    ]
    blocks = D.parse_blocks(spark.createDataFrame([(document(50, txs),)], "document string"))
    t = D.explode_transactions(blocks)
    why = {r["transaction_index"]: (r["status"], r["reason"]) for r in rows_of(t.select("transaction_index", "status", "reason"))}
    assert why[0] == ("processed", "ok") and why[2] == ("failed", "transaction_failed") and why[3] == ("error", "duplicate_transaction_signature")
    assert why[4] == ("unsupported", "transaction_version_not_supported") and why[5] == ("error", "execution_status_missing") and why[6] == ("error", "invalid_account_key")
    assert why[13] == ("error", "invalid_inner_parent")
    n = {r["transaction_index"]: r for r in rows_of(D.decode_native_transfer(D.explode_instructions(t)))}
    assert int(n[0]["lamports"]) == 123 and int(n[1]["lamports"]) == 2**64 - 1 and n[0]["source"] == key(1) and n[0]["destination"] == key(2)
    assert n[7]["reason"] == "system_opcode_not_supported" and n[8]["reason"] == "program_not_supported" and n[8]["lamports"] is None
    b = {r["transaction_index"]: (r["token_balance_status"], [None if c["delta_raw"] is None else int(c["delta_raw"]) for c in r["changes"] or []]) for r in rows_of(D.balance_changes(t))}
    assert b[9] == ("recorded", [-12]) and b[10] == ("partial", [None]) and b[11] == ("partial", [None]) and b[12] == ("recorded", []) and b[0] == ("not_recorded", [])


def test_event_layouts_round_trip():
    from tidemark.plans.nested import _pack
    raw = _pack("sell", 7, 9, key(1), key(2), 55)[8:]
    fields = protocol.unpack_event(raw)
    assert (fields["base_amount_in"], fields["user_quote_amount_out"], fields["virtual_quote_reserves"], fields["pool"], fields["can_boost"]) == ("7", "9", "-12", key(1), "false")
    assert protocol.unpack_event(raw[:-1]) is None and protocol.unpack_event(raw + b"\0") is None and protocol.unpack_event(b"x" * 40) is None
    assert protocol.EVENT_TAGS["BuyEvent"] == bytes([103, 244, 82, 31, 44, 245, 119, 119]).hex() and protocol.INSTRUCTION_TAGS["sell"] == bytes([51, 230, 133, 164, 1, 127, 131, 173]).hex()
