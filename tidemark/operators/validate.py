"""Row predicates over JSON evidence: each gives a status or the first failing reason.

A row that fails a check keeps its place and gets a reason; nothing raises.
JSON fields are read from a variant, whose stored type tells a boolean from an integer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exact import WIDE, _col, div_floor, u64
from ..functions.jsonio import variant, variant_type
from ..functions.search import Needles, needles_of
from ..session import cut_lineage
from .features import flags

# Fixed values of the record contract.
RECORD_FIELDS = ("blockhash", "commitment", "event_time", "kind", "logical_id", "payload", "retracted", "revision",
                 "schema_version", "slot", "source", "source_id", "supersedes")
RECORD_KINDS = ("token_creation", "pool", "swap", "transfer", "liquidity", "social_post", "risk", "observation")
COMMITMENTS = ("processed", "confirmed", "finalized", "offchain")
TRANSPORT_UNAVAILABLE = ("timeout", "transport_error", "http_429", "http_502", "http_503", "http_504")
RPC_UNAVAILABLE = (-32001, -32004, -32007, -32009, -32014, -32016)


def first_reason(pairs, otherwise=None) -> Column:
    """Name of the first condition that is not known to be false; unknown counts as a failure."""
    out = None
    for bad, name in pairs:
        cond = F.coalesce(bad, F.lit(True))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def _is(v, path: str, *types: str) -> Column:
    t = variant_type(v, path)
    cond = F.lit(False)
    for name in types:
        cond = cond | t.startswith(name)
    return F.coalesce(cond, F.lit(False))


def _natural(v, path: str) -> Column:
    return _is(v, path, "BIGINT") & F.coalesce(variant(v, path, "bigint") >= 0, F.lit(False))


def _text(v, path: str) -> Column:
    return _is(v, path, "STRING") & (F.coalesce(F.length(variant(v, path)), F.lit(0)) > 0)


def keys_of(json_text) -> Column:
    return F.array_sort(F.json_object_keys(json_text))


def validate_record(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Check source-record lines against the fixed field set; adds ``reason`` ("ok" when valid)."""
    df = df.withColumn("__v", F.try_parse_json(F.col(raw).cast("string")))
    v = "__v"
    identity = F.lit(False)
    for key in ("source", "source_id", "logical_id"):
        text = variant(v, f"$.{key}")
        identity = identity | ~_is(v, f"$.{key}", "STRING") | ~text.rlike("\\S") | (F.length(text) > 256)
    position = F.lit(False)
    for key in ("event_time", "slot"):
        position = position | ~(_is(v, f"$.{key}", "VOID") | _natural(v, f"$.{key}"))
    off = variant(v, "$.commitment") == "offchain"
    reason = first_reason(
        [
            (F.col(v).isNull(), "invalid JSON"),
            (~keys_of(F.to_json(v)).eqNullSafe(F.array(*[F.lit(f) for f in RECORD_FIELDS])), "unknown or missing fields"),
            (~_is(v, "$.schema_version", "BIGINT") | (variant(v, "$.schema_version", "bigint") != 1), "unsupported schema"),
            (identity, "invalid identity"),
            (~_is(v, "$.kind", "STRING") | ~variant(v, "$.kind").isin(*RECORD_KINDS), "unsupported kind"),
            (~_is(v, "$.commitment", "STRING") | ~variant(v, "$.commitment").isin(*COMMITMENTS), "invalid commitment"),
            (position, "invalid time/slot"),
            (~off & (_is(v, "$.slot", "VOID") | ~_text(v, "$.blockhash")), "missing chain identity"),
            (off & ~(_is(v, "$.slot", "VOID") & _is(v, "$.blockhash", "VOID")), "offchain with chain identity"),
            (~_natural(v, "$.revision"), "invalid revision"),
            (~_is(v, "$.supersedes", "VOID", "STRING"), "invalid supersedes"),
            (~_is(v, "$.retracted", "BOOLEAN") | ~_is(v, "$.payload", "OBJECT"), "invalid payload/retraction"),
        ],
        "ok",
    )
    return df.withColumn("reason", reason).drop(v)


def parse_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Typed columns of valid record lines; the payload stays a variant."""
    v = F.try_parse_json(F.col(raw).cast("string"))
    df = df.withColumn("__v", v)
    typed = {k: variant("__v", f"$.{k}", t) for k, t in (
        ("schema_version", "bigint"), ("source", "string"), ("source_id", "string"), ("logical_id", "string"), ("kind", "string"),
        ("event_time", "bigint"), ("slot", "bigint"), ("blockhash", "string"), ("commitment", "string"), ("revision", "bigint"),
        ("supersedes", "string"), ("retracted", "boolean"), ("payload", "variant"))}
    return df.withColumns({**typed, "document": F.to_json("__v")}).drop("__v")


def future_clock(df: DataFrame, tolerance_us: int = 5_000_000) -> DataFrame:
    """Flag records whose event time is later than the observation time plus the tolerance."""
    ahead = F.coalesce(F.col("event_time") > F.col("observed_at") + tolerance_us, F.lit(False))
    return df.withColumn("reason", F.when(ahead, "source clock in future"))


def classify_rpc_response(df: DataFrame, network: str = "testnet") -> DataFrame:
    """(slot, raw, transport_error, tip) -> status archived / unavailable / error, reason, canonical document."""
    df = df.withColumn("__v", F.try_parse_json(F.col("raw").cast("string")))
    v, code = "__v", variant("__v", "$.error.code", "bigint")
    has_error = variant_type(v, "$.error").isNotNull()
    envelope = _is(v, "$.jsonrpc", "STRING") & (variant(v, "$.jsonrpc") == "2.0") & _is(v, "$.id", "BIGINT") & (variant(v, "$.id", "bigint") == 1)
    parent = variant(v, "$.result.parentSlot", "bigint")
    block = (
        _is(v, "$.result", "OBJECT") & _natural(v, "$.result.parentSlot") & (parent < F.col("slot"))
        & _text(v, "$.result.blockhash") & _text(v, "$.result.previousBlockhash") & _is(v, "$.result.transactions", "ARRAY")
    )
    known = F.col("transport_error").isin(*TRANSPORT_UNAVAILABLE)
    verdict = (
        F.when(F.col("slot") > F.col("tip"), F.struct(F.lit("unavailable").alias("status"), F.lit("beyond_finalized_tip").alias("reason")))
        .when(F.col("transport_error").isNotNull(),
              F.struct(F.when(known, "unavailable").otherwise("error").alias("status"), F.col("transport_error").alias("reason")))
        .when(~F.coalesce(envelope, F.lit(False)), F.struct(F.lit("error").alias("status"), F.lit("invalid_rpc_response").alias("reason")))
        .when(has_error & _is(v, "$.error.code", "BIGINT"),
              F.struct(F.when(code.isin(*RPC_UNAVAILABLE), "unavailable").otherwise("error").alias("status"),
                       F.concat(F.lit("rpc_"), code.cast("string")).alias("reason")))
        .when(~has_error & _is(v, "$.result", "VOID"), F.struct(F.lit("unavailable").alias("status"), F.lit("null_result").alias("reason")))
        .when(~has_error & F.coalesce(block, F.lit(False)), F.struct(F.lit("archived").alias("status"), F.lit("ok").alias("reason")))
        .otherwise(F.struct(F.lit("error").alias("status"), F.lit("invalid_rpc_response").alias("reason")))
    )
    document = F.concat(
        F.lit('{"block":'), F.to_json(F.variant_get(v, "$.result", "variant")),
        F.lit(f',"commitment":"finalized","network":"{network}","schema_version":1,"slot":'), F.col("slot").cast("string"), F.lit("}"))
    df = df.withColumn("__o", verdict)
    return df.withColumns({
        "status": F.col("__o.status"),
        "reason": F.col("__o.reason"),
        "document": F.when(F.col("__o.status") == "archived", document),
    }).drop("__v", "__o")


def normalize_latest_blockhash(df: DataFrame) -> DataFrame:
    """(raw, rpc_method, request_params) -> observation record columns and canonical document, or a reason."""
    df = df.withColumns({"__v": F.try_parse_json(F.col("raw").cast("string")), "__p": F.try_parse_json("request_params")})
    slot, block = variant("__v", "$.result.context.slot", "bigint"), variant("__v", "$.result.value.blockhash")
    height = variant("__v", "$.result.value.lastValidBlockHeight", "bigint")
    method = F.coalesce("rpc_method", F.lit("getLatestBlockhash"))
    out = df.withColumns({
        "slot": slot,
        "blockhash": block,
        "commitment": F.coalesce(variant("__p", "$[0].commitment"), F.lit("finalized")),
        "source_id": F.concat_ws(":", slot.cast("string"), block),
        "logical_id": F.concat(F.lit("solana:slot:"), slot.cast("string")),
        "last_valid_block_height": height,
        "reason": F.when(F.col("__v").isNull(), "invalid JSON").when(variant_type("__v", "$.error").isNotNull(), "RPC error in capture").when(
            slot.isNull() | block.isNull() | height.isNull(), "invalid response").otherwise("ok"),
    })
    record = F.struct(
        F.col("blockhash"), F.col("commitment"), F.lit(None).cast("bigint").alias("event_time"), F.lit("observation").alias("kind"),
        F.col("logical_id"), F.struct(F.col("last_valid_block_height"), method.alias("rpc_method")).alias("payload"),
        F.lit(False).alias("retracted"), F.lit(0).alias("revision"), F.lit(1).alias("schema_version"), F.col("slot"),
        F.lit("solana-rpc").alias("source"), F.col("source_id"), F.lit(None).cast("string").alias("supersedes"))
    return out.withColumn("document", F.when(F.col("reason") == "ok", F.to_json(record, {"ignoreNullFields": "false"}))).drop("__v", "__p")


def retry_policy(reason) -> Column:
    """Category and retry rule of an unresolved reason."""
    r = _col(reason)

    def rule(category, retry):
        return F.struct(F.lit(category).alias("category"), F.lit(retry).alias("retry"))

    return (
        F.when(r == "rpc_-32015", rule("unsupported_transaction_version", "only_after_request_version_increase"))
        .when(r.isin("rpc_-32600", "rpc_-32601", "rpc_-32602", "rpc_-32700"), rule("request_error", "requires_correction"))
        .when(r == "rpc_-32603", rule("internal_rpc_error", "bounded_backoff"))
        .otherwise(rule("other_unresolved", "bounded_backoff"))
    )


def error_diagnostic(raw) -> Column:
    """Error code of a response and, for a version refusal, the version its message quotes (at most 127)."""
    v = F.try_parse_json(_col(raw).cast("string"))
    code = F.when(F.schema_of_variant(F.variant_get(v, "$.error.code", "variant")) == "BIGINT", F.try_variant_get(v, "$.error.code", "bigint"))
    quoted = F.regexp_extract(F.try_variant_get(v, "$.error.message", "string"), r"(?i)Transaction version \(?([0-9]{1,3})\)?", 1)
    version = F.when((code == -32015) & (quoted != ""), quoted.cast("int"))
    return F.struct(code.alias("rpc_code"), F.when(version <= 127, version).alias("reported_transaction_version"))


# Diagnostic codes by category.
EVIDENCE_CODES = (
    "executable_token_account token2022_parser_mismatch mutable_or_external_metadata_pointer unsupported_metadata_layout "
    "mutable_or_unbound_token_metadata invalid_mint_decimals invalid_mint_supply vault_mint_program_mismatch unsupported_vault_extensions "
    "unsupported_quote_currency unsupported_token_program unsupported_vault_program unsupported_mint_extensions "
    "mint_or_freeze_authority_present account_missing vault_identity_or_frozen vault_authority_or_extensions pool_program_mismatch "
    "accounts_stale_or_future accounts_before_event quote_stale_or_future quote_event_slot_divergence evidence_slot_divergence "
    "event_stale_or_future split_route_unsupported route_pool_mismatch reverse_quote_size_mismatch quote_slippage_limit price_impact_limit "
    "output_exceeds_observed_vault exit_output_exceeds_observed_vault settlement_risk_rejected quote_not_after_decision "
    "quote_expired_or_future fees_exceed_output zero_scenario_output collector_unavailable pending_other_token "
    "interrupted_before_evidence_plan"
).split()
SOURCE_CODES = (
    "rpc_error rpc_transport_failure account_transport_error quote_transport_error invalid_quote_response quote_response_too_large "
    "credential_echo_rejected"
).split()
OPERATIONAL_CODES = "quota_exhausted session_writer_already_running websocket_client_not_installed".split()
INTEGRITY_CODES = (
    "materialization_replay_mismatch bridge_decision_replay_mismatch bridge_portfolio_replay_mismatch event_hash_mismatch "
    "decision_hash_mismatch paper_chain_mismatch archive_hash_mismatch frame_hash_mismatch event_evidence_mismatch"
).split()


def diagnostic_category(code) -> Column:
    c = _col(code)
    return (
        F.when(c.isin(*EVIDENCE_CODES), "EVIDENCE_REJECT")
        .when(c.isin(*SOURCE_CODES) | c.rlike("^http_[1-5][0-9]{2}$"), "SOURCE_FAILURE")
        .when(c.isin(*OPERATIONAL_CODES), "OPERATIONAL_FAILURE")
        .when(c.isin(*INTEGRITY_CODES), "INTEGRITY_FAILURE")
        .otherwise("SOFTWARE_EXCEPTION")
    )


def secret_echo(text, secrets: Sequence[str]) -> Column:
    """True when the whole text, or its canonical JSON, holds a secret of four or more characters, plain or URL-quoted."""
    from urllib.parse import quote

    forms = sorted({form for s in secrets if s and len(s) >= 4 for form in (s, quote(s, safe=""))})
    if not forms:
        return F.lit(False)
    t = _col(text)
    canon = F.coalesce(F.to_json(F.try_parse_json(t)), F.lit(""))
    # one array literal, however many secrets there are
    return F.coalesce(F.exists(F.lit(forms), lambda s: t.contains(s) | canon.contains(s)), F.lit(False))


def secret_forms(secrets: DataFrame, column: str = "secret") -> DataFrame:
    """form: secrets of four or more characters, plain and URL-quoted, each once."""
    s = F.col(column)
    quoted = F.url_encode(s)
    for found, put in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(found), F.lit(put))
    return secrets.where(F.char_length(s) >= 4).select(F.explode(F.array_distinct(F.array(s, quoted))).alias("form")).distinct()


def secret_echo_join(bodies: DataFrame, secrets: DataFrame, key: str = "id", text: str = "text", column: str = "secret", most_bytes: int = 32 << 20) -> DataFrame:
    """``secret_echo`` for any number of secrets, which come as rows: key and secret_echo of every body; keys are unique.

    Every body is searched for all forms in one pass (``functions.search``), so no pieces of bodies are shuffled. Forms of a measured
    size of at most ``most_bytes`` are known to every task, which compares them there. Of more forms the tasks know bitmaps of bounded size; what
    these let pass is joined with the forms.
    """
    forms = cut_lineage(secret_forms(secrets, column))
    size, total = forms.agg(F.coalesce(F.sum(F.octet_length("form") + 16), F.lit(0)), F.count(F.lit(1))).first()
    few = size <= most_bytes
    needles = Needles.of(forms.select(F.col("form").cast("binary")).toArrow().column(0).combine_chunks()) if few else needles_of(forms, "form", total)
    known = bodies.sparkSession.sparkContext.broadcast(needles)
    whole = F.col(text)
    canon = F.coalesce(F.to_json(F.try_parse_json(whole)), F.lit(""))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side in (1, 2):
                for rows, at, n, data in known.value.found(batch.column(side)):
                    if few:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.unique(rows)))], names=["__key"])
                    else:
                        pieces = sorted({(r, data[p : p + n].tobytes()) for r, p in zip(rows.tolist(), at.tolist())})
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in pieces])), pa.array([x for _, x in pieces], pa.binary())], names=["__key", "__form"])

    fields = [T.StructField("__key", bodies.schema[key].dataType)] + ([] if few else [T.StructField("__form", T.BinaryType())])
    hits = bodies.select(F.col(key).alias("__key"), whole, canon).mapInArrow(search, T.StructType(fields)).distinct()
    if not few:
        hits = hits.join(forms.select(F.col("form").cast("binary").alias("__form")), "__form", "left_semi").select("__key").distinct()
    return bodies.select(key).join(hits.withColumn("__hit", F.lit(True)), F.col(key) == F.col("__key"), "left").select(key, F.coalesce("__hit", F.lit(False)).alias("secret_echo"))


def quote_valid(df: DataFrame) -> DataFrame:
    """Quote rows with their request -> first failing reason ("ok" when valid).

    Columns: input_mint, output_mint, mode, in_amount, out_amount, threshold (texts), slippage_bps, slot,
    impact (text), routes (array), request_input, request_output, request_amount, request_slippage_bps.
    """
    a, o, m = u64("in_amount"), u64("out_amount"), u64("threshold")
    slip = F.col("slippage_bps").cast("bigint")
    least = div_floor(F.try_multiply(o.cast(WIDE), (F.lit(10000) - slip).cast(WIDE)).cast(WIDE), F.lit(10000).cast(WIDE))
    impact = F.expr("try_cast(impact as decimal(38,18))")
    reason = first_reason(
        [
            ((F.col("input_mint") != F.col("request_input")) | (F.col("output_mint") != F.col("request_output")), "quote_mint_mismatch"),
            ((F.col("input_mint") == F.col("output_mint")) | (F.col("mode") != "ExactIn"), "quote_mode"),
            (~((a > 0) & (o > 0) & (m > 0)), "invalid_quote_units"),
            ((a != F.col("request_amount")) | (m > o), "quote_amount_mismatch"),
            ((slip != F.col("request_slippage_bps")) | ~slip.between(0, 10000), "quote_slippage_mismatch"),
            (m.cast(WIDE) < least.cast(WIDE), "quote_threshold_invalid"),
            (F.col("slot") < 0, "quote_slot"),
            (F.size("routes") < 1, "quote_route_missing"),
            (~impact.between(0, 1), "quote_impact"),
        ],
        "ok",
    )
    return df.withColumn("reason", reason)


def direct_route(routes, pool, input_mint, output_mint) -> Column:
    """Null when the quote has one leg of 100 % through the pool with the same mints, else the reason."""
    r, leg = _col(routes), F.get(_col(routes), F.lit(0))
    fits = (leg["percent"] == 100) & (leg["amm_key"] == _col(pool)) & (leg["input_mint"] == _col(input_mint)) & (leg["output_mint"] == _col(output_mint))
    return F.when(F.coalesce(F.size(r) != 1, F.lit(True)), "split_route_unsupported").when(~F.coalesce(fits, F.lit(False)), "route_pool_mismatch")


# Token programs.
TOKEN = "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA"
TOKEN_2022 = "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb"


def _state_of(v, name: str) -> Column:
    """The state object of the named extension as JSON text, from a two-entry extension list."""
    out = None
    for i in (0, 1):
        hit = variant(v, f"$.data.parsed.info.extensions[{i}].extension") == name
        state = F.to_json(F.variant_get(_col(v), f"$.data.parsed.info.extensions[{i}].state", "variant"))
        out = F.when(hit, state) if out is None else out.when(hit, state)
    return out


def _no_extensions(v) -> Column:
    t = variant_type(v, "$.data.parsed.info.extensions")
    return t.isNull() | (t == "VOID") | (F.to_json(F.variant_get(_col(v), "$.data.parsed.info.extensions", "variant")) == "[]")


def mint_reason(v: str, mint) -> Column:
    """"ok" or the first failing reason of a parsed mint account; only authority-free mints with the known metadata extensions pass."""
    info = "$.data.parsed.info"
    owner = variant(v, "$.owner")
    pointer, meta = _state_of(v, "metadataPointer"), _state_of(v, "tokenMetadata")
    pv, mv = F.try_parse_json(pointer), F.try_parse_json(meta)
    ext_keys = F.lit(True)
    for i in (0, 1):
        ext_keys = ext_keys & keys_of(F.to_json(F.variant_get(F.col(v), f"{info}.extensions[{i}]", "variant"))).eqNullSafe(F.array(F.lit("extension"), F.lit("state")))
    n_ext = F.coalesce(F.json_array_length(F.to_json(F.variant_get(F.col(v), f"{info}.extensions", "variant"))), F.lit(-1))
    string_meta = F.lit(True)
    for key in ("name", "symbol", "uri"):
        string_meta = string_meta & (F.schema_of_variant(F.variant_get(mv, f"$.{key}", "variant")) == "STRING")
    # pairs of strings, or an empty list
    extra_json = F.to_json(F.variant_get(mv, "$.additionalMetadata", "variant"))
    pairs = F.schema_of_variant(F.variant_get(mv, "$.additionalMetadata", "variant")).isin("ARRAY<ARRAY<STRING>>", "ARRAY<VOID>")
    two = F.coalesce(F.forall(F.from_json(extra_json, "array<array<string>>"), lambda p: F.size(p) == 2), F.lit(False))
    decimals, supply = variant(v, f"{info}.decimals", "bigint"), variant(v, f"{info}.supply")
    classic = owner == TOKEN

    def only_2022(cond):
        return ~classic & F.coalesce(cond, F.lit(True))

    return first_reason(
        [
            (~_is(v, "$.executable", "BOOLEAN") | variant(v, "$.executable", "boolean"), "executable_token_account"),
            (~owner.isin(TOKEN, TOKEN_2022), "unsupported_token_program"),
            (variant(v, "$.data.parsed.type") != "mint", "not_mint"),
            (~(_is(v, f"{info}.isInitialized", "BOOLEAN") & variant(v, f"{info}.isInitialized", "boolean")
               & _is(v, f"{info}.mintAuthority", "VOID") & _is(v, f"{info}.freezeAuthority", "VOID")), "mint_or_freeze_authority_present"),
            (classic & ~_no_extensions(v), "unsupported_mint_extensions"),
            (only_2022(variant(v, "$.data.program") != "spl-token-2022"), "token2022_parser_mismatch"),
            (only_2022((n_ext != 2) | ~ext_keys | pointer.isNull() | meta.isNull()), "unsupported_mint_extensions"),
            (only_2022(~(keys_of(pointer).eqNullSafe(F.array(F.lit("authority"), F.lit("metadataAddress")))
                         & (F.schema_of_variant(F.variant_get(pv, "$.authority", "variant")) == "VOID")
                         & F.try_variant_get(pv, "$.metadataAddress", "string").eqNullSafe(_col(mint)))), "mutable_or_external_metadata_pointer"),
            (only_2022(~keys_of(meta).eqNullSafe(F.array(*[F.lit(k) for k in ("additionalMetadata", "mint", "name", "symbol", "updateAuthority", "uri")]))), "unsupported_metadata_layout"),
            (only_2022(~((F.schema_of_variant(F.variant_get(mv, "$.updateAuthority", "variant")) == "VOID")
                         & F.try_variant_get(mv, "$.mint", "string").eqNullSafe(_col(mint)))), "mutable_or_unbound_token_metadata"),
            (only_2022(~(string_meta & pairs & two)), "unsupported_metadata_layout"),
            (only_2022(~(_is(v, f"{info}.decimals", "BIGINT") & decimals.between(0, 255))), "invalid_mint_decimals"),
            (only_2022(~_is(v, f"{info}.supply", "STRING") | u64(supply).isNull()), "invalid_mint_supply"),
        ],
        "ok",
    )


def mint_profile(df: DataFrame, account: str = "account", mint: str = "mint") -> DataFrame:
    """Mint account JSON -> ``profile`` or ``reason`` (see ``mint_reason``)."""
    df = df.withColumn("__v", F.try_parse_json(account))
    df = df.withColumn("reason", mint_reason("__v", mint))
    profile = F.when(F.col("reason") == "ok", F.when(variant("__v", "$.owner") == TOKEN, "classic-spl-v1").otherwise("token2022-immutable-self-metadata-v1"))
    return df.withColumn("profile", profile).drop("__v")


def vault_reason(v: str, program: Column) -> Column:
    """"ok" or the first failing reason of a parsed vault account: same program as the mint and no extension but the immutable owner."""
    ext = F.to_json(F.variant_get(F.col(v), "$.data.parsed.info.extensions", "variant"))
    new = program != TOKEN
    return first_reason(
        [
            (~_is(v, "$.executable", "BOOLEAN") | variant(v, "$.executable", "boolean"), "executable_token_account"),
            (variant(v, "$.owner") != program, "vault_mint_program_mismatch"),
            (variant(v, "$.data.parsed.type") != "account", "not_token_account"),
            (~new & ~_no_extensions(v), "unsupported_vault_extensions"),
            (new & (program != TOKEN_2022), "unsupported_vault_program"),
            (new & F.coalesce(variant(v, "$.data.program") != "spl-token-2022", F.lit(True)), "token2022_parser_mismatch"),
            (new & ~ext.eqNullSafe(F.lit('[{"extension":"immutableOwner"}]')), "unsupported_vault_extensions"),
        ],
        "ok",
    )


def vault_profile(df: DataFrame, account: str = "account", mint_program: str = "mint_program") -> DataFrame:
    """Vault account JSON -> ``reason`` (see ``vault_reason``)."""
    df = df.withColumn("__v", F.try_parse_json(account))
    return df.withColumn("reason", vault_reason("__v", F.col(mint_program))).drop("__v")


def unset(v: str, path: str) -> Column:
    """The field is missing, null, false, zero or empty."""
    t = variant_type(v, path)
    return t.isNull() | (t == "VOID") | F.coalesce(F.to_json(F.variant_get(F.col(v), path, "variant")).isin('""', "false", "0", "[]", "{}"), F.lit(False))


def datum_status(value, at, now, ttl_ns: int = 5_000_000_000) -> Column:
    """UNKNOWN without a value, STALE past the limit, else FRESH, and the age; input from the future fails the job."""
    value, at, now = _col(value), _col(at), _col(now)
    guard = F.assert_true(F.coalesce(at <= now, F.lit(True)), F.lit("future information"))
    status = F.when(value.isNull(), "UNKNOWN").when(at.isNull() | (now - at > ttl_ns), "STALE").otherwise("FRESH")
    return F.struct(F.when(guard.isNull(), status).alias("status"), (now - at).alias("age_ns"))


def fresh(value, at, now, ttl_ns: int = 5_000_000_000) -> Column:
    """The value while it is FRESH, else null."""
    return F.when(datum_status(value, at, now, ttl_ns)["status"] == "FRESH", _col(value))


def balance_row_valid(df: DataFrame, n_keys: str = "n_keys") -> DataFrame:
    """Token balance rows -> first failing reason. A transaction is one bounded document, so repeats
    are counted inside it. Columns: tx (id), account_index, mint_ok, amount (text), decimals."""
    idx = F.col("account_index")
    repeats = df.groupBy("tx", "account_index").agg(F.count(F.lit(1)).alias("__c"))
    df = df.join(repeats, ["tx", "account_index"], "left")
    reason = first_reason(
        [
            (~((idx >= 0) & (idx < F.col(n_keys))), "token_account_index"),
            (~F.col("mint_ok"), "invalid_account_key"),
            (u64("amount").isNull(), "invalid_token_amount"),
            (~F.col("decimals").between(0, 255), "invalid_token_decimals"),
            (F.col("__c") > 1, "duplicate_token_balance"),
        ],
        "ok",
    )
    return df.withColumn("reason", reason).drop("__c")


def report_alerts(df: DataFrame) -> DataFrame:
    """Dataset metric rows -> alert codes, PASS/FAIL and whether the complete range may be analysed."""
    broken = (F.col("decoder_errors") > 0) | (F.col("transaction_errors") > 0) | (F.col("instruction_errors") > 0)
    codes = flags([
        (~F.col("source_complete"), "slots_unresolved"),
        (broken, "decoder_errors"),
        (F.col("token_balance_not_recorded") > 0, "token_balances_not_recorded"),
        (F.col("token_balance_partial") > 0, "token_deltas_unknown"),
        (F.col("unsupported_instructions") > 0, "unsupported_instructions"),
    ])
    df = df.withColumn("alerts", codes)
    failed = F.array_contains("alerts", "decoder_errors")
    return df.withColumns({"status": F.when(failed, "FAIL").otherwise("PASS"), "ready": F.col("included_range_complete") & ~failed})


def watch_stage(df: DataFrame) -> DataFrame:
    """Counters of a watch window -> how far it got."""
    return df.withColumn(
        "stage",
        F.when(~F.col("network_attempted"), "NO_NETWORK_CALL")
        .when((F.col("position_observations") > 0) & (F.col("observations_accepted") == 0), "NEW_OBSERVATION_REJECTED")
        .when(F.col("position_observations") > 0, "NEW_POSITION_OBSERVATION")
        .when(F.col("transactions_hydrated") > 0, "NEW_TRANSACTION_UNSUPPORTED")
        .when(F.col("new_signatures_found") > 0, "NEW_SIGNATURE_NOT_HYDRATED")
        .otherwise("NO_NEW_SIGNATURE"),
    )


def watch_qualification(df: DataFrame) -> DataFrame:
    """Finished watch sessions -> status and code: FAIL with the distinct source errors (a used-up quota is none), NOT_EXECUTED without a new
    position observation, else PASS. Columns: position_observations, errors (array of codes)."""
    errors = F.array_sort(F.array_distinct(F.filter(F.coalesce("errors", F.array().cast("array<string>")), lambda e: e != "quota_exhausted")))
    seen = F.coalesce(F.col("position_observations"), F.lit(0)) > 0
    case = F.when(F.size("source_error_codes") > 0, F.lit("FAIL|position_source_error")).when(~seen, F.lit("NOT_EXECUTED|no_new_position_observation")).otherwise(F.lit("PASS|position_bounded_observation"))
    df = df.withColumn("source_error_codes", errors).withColumn("__q", F.split(case, "[|]"))
    return df.withColumns({"status": F.col("__q")[0], "code": F.col("__q")[1]}).drop("__q")
