"""Nested blocks to transactions, instructions and typed events, with coverage counts.

A block document is bounded (16 MiB of raw bytes), so everything inside one block is done
in its own row with array functions: decoding needs no shuffle, only coverage counts do.
Byte work is Arrow-batched and fed only the rows of the program it is for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import protocol
from ..functions.codecs import base58_decode, base58_decode_all, base58_length, keys_valid, le_u64
from ..functions.exact import WIDE, u64
from ..functions.jsonio import event_id
from .validate import TOKEN, first_reason

# Fixed value: the native transfer program.
SYSTEM = "11111111111111111111111111111111"

INSTRUCTION = "struct<programIdIndex:int,accounts:array<int>,data:string,stackHeight:int>"
BALANCE = "struct<accountIndex:int,mint:string,owner:string,programId:string,amount:string,decimals:int>"
TRANSACTION = (
    f"struct<version:string,signatures:array<string>,accountKeys:array<string>,lookups:int,instructions:array<{INSTRUCTION}>,"
    f"meta:struct<errPresent:boolean,err:string,fee:string,loadedAddresses:struct<writable:array<string>,readonly:array<string>>,"
    f"innerInstructions:array<struct<index:int,instructions:array<{INSTRUCTION}>>>,"
    f"preTokenBalances:array<{BALANCE}>,postTokenBalances:array<{BALANCE}>>>"
)
_RAW_BALANCE = "struct<accountIndex:int,mint:string,owner:string,programId:string,uiTokenAmount:struct<amount:string,decimals:int>>"
_RAW_META = (
    f"struct<err:string,fee:string,loadedAddresses:struct<writable:array<string>,readonly:array<string>>,"
    f"innerInstructions:array<struct<index:int,instructions:array<{INSTRUCTION}>>>,"
    f"preTokenBalances:array<{_RAW_BALANCE}>,postTokenBalances:array<{_RAW_BALANCE}>>"
)
_RAW_BLOCK = (
    "struct<slot:bigint,block:struct<blockhash:string,previousBlockhash:string,parentSlot:bigint,transactions:array<struct<version:string,meta:string,"
    f"transaction:struct<signatures:array<string>,message:struct<accountKeys:array<string>,addressTableLookups:array<string>,instructions:array<{INSTRUCTION}>>>>>>>"
)


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator, so that later references read the value.

    The optimizer merges adjacent projections and would otherwise copy these large expressions
    into every column that uses them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse_blocks(documents: DataFrame, document: str = "document") -> DataFrame:
    """Published block documents (JSON) -> slot, blockhash, previous_blockhash, parent_slot, transactions."""
    d = documents.withColumn("__d", F.from_json(document, _RAW_BLOCK)).withColumns({
        "slot": F.col("__d.slot"), "blockhash": F.col("__d.block.blockhash"),
        "previous_blockhash": F.col("__d.block.previousBlockhash"), "parent_slot": F.col("__d.block.parentSlot")})
    balance = ("transform({}, b -> named_struct('accountIndex', b.accountIndex, 'mint', b.mint, 'owner', b.owner, 'programId', b.programId,"
               " 'amount', b.uiTokenAmount.amount, 'decimals', b.uiTokenAmount.decimals))")
    meta = (
        "if(t.meta is null or t.meta = 'null', null, named_struct('errPresent', array_contains(json_object_keys(t.meta), 'err'), 'err', {m}.err, 'fee', {m}.fee,"
        " 'loadedAddresses', {m}.loadedAddresses, 'innerInstructions', {m}.innerInstructions, 'preTokenBalances', " + balance.format("{m}.preTokenBalances")
        + ", 'postTokenBalances', " + balance.format("{m}.postTokenBalances") + "))"
    ).replace("{m}", f"from_json(t.meta, '{_RAW_META}')")
    tx = F.expr(
        "transform(__d.block.transactions, t -> if(t is null, null, named_struct('version', coalesce(t.version, 'legacy'), 'signatures', t.transaction.signatures,"
        " 'accountKeys', t.transaction.message.accountKeys, 'lookups', coalesce(size(t.transaction.message.addressTableLookups), 0),"
        f" 'instructions', t.transaction.message.instructions, 'meta', {meta})))")
    return d.withColumn("transactions", tx.cast(f"array<{TRANSACTION}>")).drop("__d")


def resolve_keys(tx: str = "tx") -> Column:
    """Static keys, then loaded writable, then loaded readonly."""
    none = F.array().cast("array<string>")
    return F.concat(F.col(f"{tx}.accountKeys"), F.coalesce(f"{tx}.meta.loadedAddresses.writable", none),
                    F.coalesce(f"{tx}.meta.loadedAddresses.readonly", none))


def explode_transactions(blocks: DataFrame) -> DataFrame:
    """One row per transaction with status processed / failed / unsupported / error, reason and resolved keys."""
    live = ("t is not null and coalesce(t.version, 'legacy') in ('legacy', '0', '1') and t.meta is not null and coalesce(t.meta.errPresent, true)"
            " and t.meta.err is null")
    b = blocks.withColumn("__sigs", F.expr(f"transform(transactions, t -> if({live}, get(t.signatures, 0), null))"))
    # only a block that really repeats a signature carries the list on
    b = b.withColumn("__sigs", F.expr("if(size(array_distinct(array_compact(__sigs))) < size(array_compact(__sigs)), __sigs, null)"))
    t = b.select("slot", "blockhash", "__sigs", F.posexplode("transactions").alias("transaction_index", "tx"))
    t = t.withColumns({
        "signature": F.get("tx.signatures", F.lit(0)),
        "version": F.coalesce("tx.version", F.lit("legacy")),
        "keys": resolve_keys(),
        "instructions": F.col("tx.instructions"),
        "inner": F.col("tx.meta.innerInstructions"),
        "fee": F.col("tx.meta.fee"),
        "pre": F.col("tx.meta.preTokenBalances"),
        "post": F.col("tx.meta.postTokenBalances"),
    })
    loaded = F.col("tx.meta.loadedAddresses")
    some_loaded = F.coalesce(F.size(loaded["writable"]) + F.size(loaded["readonly"]), F.lit(0)) > 0
    parents = F.expr("forall(inner, g -> g.index between 0 and size(instructions) - 1 and g.instructions is not null)"
                     " and size(array_distinct(inner.index)) = size(inner)")
    repeated = duplicate_signature()
    dead = first_reason([
        (F.col("tx").isNull(), "error:invalid_transaction"),
        (~F.col("version").isin("legacy", "0", "1"), "unsupported:transaction_version_not_supported"),
        (F.col("tx.meta").isNull() | ~F.coalesce("tx.meta.errPresent", F.lit(True)), "error:execution_status_missing"),
        (F.col("tx.meta.err").isNotNull(), "failed:transaction_failed"),
        (base58_length("signature") != 64, "error:invalid_signature"),
        (repeated, "error:duplicate_transaction_signature"),
        (~keys_valid("keys"), "error:invalid_account_key"),
        (loaded.isNotNull() & (loaded["writable"].isNull() | loaded["readonly"].isNull()), "error:invalid_loaded_addresses"),
        ((F.col("version") != "0") & some_loaded, "error:loaded_addresses_wrong_version"),
        ((F.col("version") == "0") & (F.coalesce("tx.lookups", F.lit(0)) > 0) & loaded.isNull(), "error:loaded_addresses_missing"),
        (F.col("instructions").isNull(), "error:invalid_instructions"),
        (F.col("inner").isNotNull() & ~parents, "error:invalid_inner_parent"),
    ], "processed:ok")
    t = t.withColumn("__s", F.split(dead, ":"))
    return t.withColumns({
        "status": F.col("__s")[0],
        "reason": F.col("__s")[1],
        "inner_coverage": F.when(F.col("__s")[0] == "processed", F.when(F.col("inner").isNull(), "unavailable").otherwise("recorded")),
    }).drop("__s", "__sigs", "tx")


def duplicate_signature() -> Column:
    """True for every later holder of a signature inside its block."""
    return F.coalesce(F.expr("array_position(__sigs, signature) <= transaction_index"), F.lit(False))


def explode_instructions(transactions: DataFrame, every: bool = False, carry=()) -> DataFrame:
    """Outer and inner instructions of processed transactions with their positions (inner index null = outer).

    ``every``: one pass over all transactions for accounting. Those without an instruction to show keep one row (its
    instruction_index is null), ``first`` marks one row of each transaction, and ``transaction_status``, ``inner_coverage`` and the
    columns of ``carry`` go along.
    """
    rows = F.expr(
        "concat(transform(instructions, (x, i) -> named_struct('instruction_index', i, 'inner_instruction_index', cast(null as int), 'ix', x)),"
        " coalesce(flatten(transform(inner, g -> transform(g.instructions, (x, j) -> named_struct('instruction_index', g.index, 'inner_instruction_index', j, 'ix', x)))),"
        f" cast(array() as array<struct<instruction_index:int,inner_instruction_index:int,ix:{INSTRUCTION}>>)))")
    if every:
        shown = F.when(F.col("status") == "processed", rows)
        out = transactions.select("slot", "blockhash", "transaction_index", "signature", "keys", F.col("status").alias("transaction_status"), "inner_coverage", *carry, F.inline_outer(shown))
        out = out.withColumn("first", F.col("instruction_index").isNull() | ((F.col("instruction_index") == 0) & F.col("inner_instruction_index").isNull()))
    else:
        out = transactions.where(F.col("status") == "processed").select("slot", "blockhash", "transaction_index", "signature", "keys", F.inline(rows))
    return out.withColumn("program", F.get("keys", F.col("ix.programIdIndex")))


def _account(i: int) -> Column:
    return F.get("keys", F.get("ix.accounts", F.lit(i)))


def _accounts_fit() -> Column:
    return F.coalesce(F.expr("forall(ix.accounts, i -> i between 0 and size(keys) - 1)"), F.lit(False))


NATIVE_VERSION = "system-transfer-v1"


def decode_native_transfer(instructions: DataFrame) -> DataFrame:
    """Native transfers: opcode 2 and a 12-byte payload; everything else gets a status and reason."""
    own = (F.col("program") == SYSTEM) & F.col("inner_instruction_index").isNull()
    df = instructions.withColumn("__b", base58_decode(F.when(own & (F.length("ix.data") <= 256), F.col("ix.data"))))
    size = F.octet_length("__b")
    dead = first_reason([
        (F.col("program").isNull(), "error:invalid_program_index"),
        (F.col("inner_instruction_index").isNotNull(), "unsupported:inner_execution_not_proven"),
        (F.col("program") != SYSTEM, "unsupported:program_not_supported"),
        (F.col("__b").isNull(), "error:invalid_base58"),
        (size < 4, "error:invalid_system_data"),
        (F.hex(F.substring("__b", 1, 4)) != "02000000", "unsupported:system_opcode_not_supported"),
        (size != 12, "error:invalid_transfer_size"),
        ((F.size("ix.accounts") != 2) | ~_accounts_fit(), "error:invalid_transfer_accounts"),
    ], "decoded:system_transfer")
    df = settle(df, __s=F.split(dead, ":"))
    done = F.col("__s")[0] == "decoded"
    return df.withColumns({
        "status": F.col("__s")[0],
        "reason": F.col("__s")[1],
        "source": F.when(done, _account(0)),
        "destination": F.when(done, _account(1)),
        "lamports": F.when(done, le_u64("__b", 5)),
        "event_id": F.when(done, event_id("slot", "blockhash", "signature", "instruction_index", F.lit(NATIVE_VERSION))),
    }).drop("__s", "__b")


def decode_token_transfer(instructions: DataFrame) -> DataFrame:
    """Checked token transfers of outer instructions: tag 12 and a 10-byte payload."""
    df = instructions.where(F.col("inner_instruction_index").isNull())
    own = F.col("program") == TOKEN
    df = df.withColumn("__b", base58_decode(F.when(own & (F.length("ix.data") <= 256), F.col("ix.data"))))
    state = (
        F.when(F.col("program").isNull(), "error")
        .when(~own, "unsupported")
        .when(F.col("__b").isNull() | (F.octet_length("__b") < 1), "error")
        .when(F.hex(F.substring("__b", 1, 1)) != "0C", "unsupported")
        .when((F.octet_length("__b") != 10) | (F.size("ix.accounts") < 4) | ~_accounts_fit(), "error")
        .otherwise("decoded")
    )
    df = settle(df, status=state)
    done = F.col("status") == "decoded"
    return df.withColumns({
        "source_account": F.when(done, _account(0)), "mint": F.when(done, _account(1)),
        "destination_account": F.when(done, _account(2)), "authority": F.when(done, _account(3)),
        "amount_raw": F.when(done, le_u64("__b", 2)),
        "decimals": F.when(done, F.conv(F.hex(F.substring("__b", 10, 1)), 16, 10).cast("int")),
    }).drop("__b")


def combine_events(instructions: DataFrame) -> DataFrame:
    """Outer instructions with both decoders' verdicts; a native transfer is not reported as unsupported again."""
    native = decode_native_transfer(instructions).where(F.col("inner_instruction_index").isNull()).withColumnRenamed("status", "__native")
    both = decode_token_transfer(native.drop("reason"))
    is_native = F.col("__native") == "decoded"
    return both.withColumns({
        "status": F.when(is_native, "decoded_native").otherwise(F.col("status")),
        "kind": F.when(is_native, "sol_transfer").when(F.col("status") == "decoded", "spl_transfer_checked"),
        "amount": F.coalesce("lamports", "amount_raw"),
    }).drop("__native")


def token_balance_delta(pre: DataFrame, post: DataFrame, keys=("tx", "account_index")) -> DataFrame:
    """Before / after / delta per transaction and account; unknown unless both sides agree, zero deltas dropped.

    Both sides: keys, mint, decimals, program, amount.
    """
    keys = list(keys)

    def side(df, p):
        return df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("mint", "decimals", "program", "amount")])

    j = side(pre, "b").join(side(post, "a"), keys, "full")
    same = F.col("b_amount").isNotNull() & F.col("a_amount").isNotNull()
    for c in ("mint", "decimals", "program"):
        same = same & F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    delta = F.when(same, F.col("a_amount").cast("decimal(21,0)") - F.col("b_amount").cast("decimal(21,0)"))
    out = j.select(*keys, F.col("b_amount").alias("before"), F.col("a_amount").alias("after"), delta.alias("delta_raw"), same.alias("delta_known"))
    return out.where(~F.col("delta_known") | (F.col("delta_raw") != 0))


def balance_changes(transactions: DataFrame) -> DataFrame:
    """The same for nested transactions, inside the row: one struct per changed account and the balance status."""
    return with_balance_status(transactions.where(F.col("status") == "processed"))


def with_balance_status(transactions: DataFrame) -> DataFrame:
    """All transactions with ``changes`` and ``token_balance_status``, both null but for processed ones."""
    bad = ("exists({0}, b -> not coalesce(b.accountIndex between 0 and size(keys) - 1, false) or b.mint is null or not coalesce(b.amount rlike '^[0-9]{{1,20}}$', false)"
           " or not coalesce(b.decimals between 0 and 255, false)) or size(array_distinct({0}.accountIndex)) < size({0})")
    invalid = F.coalesce(F.expr(bad.format("pre")), F.lit(False)) | F.coalesce(F.expr(bad.format("post")), F.lit(False))
    pairs = F.expr(
        "transform(array_sort(array_union(pre.accountIndex, post.accountIndex)), i -> named_struct('account_index', i, 'account', get(keys, i),"
        " 'b', get(filter(pre, b -> b.accountIndex = i), 0), 'a', get(filter(post, b -> b.accountIndex = i), 0)))")
    delta = F.expr(
        "transform(__pairs, p -> named_struct('account_index', p.account_index, 'account', p.account, 'before', cast(p.b.amount as decimal(20,0)), 'after', cast(p.a.amount as decimal(20,0)),"
        " 'delta_raw', if(p.b.mint = p.a.mint and p.b.decimals = p.a.decimals and p.b.programId <=> p.a.programId,"
        " cast(p.a.amount as decimal(21,0)) - cast(p.b.amount as decimal(21,0)), null)))")
    processed = F.col("status") == "processed"
    t = transactions.withColumn("__bad", F.when(processed, invalid))
    t = t.withColumn("__pairs", F.when(~F.col("__bad") & F.col("pre").isNotNull() & F.col("post").isNotNull(), pairs)).withColumn("__all", delta)
    return t.withColumns({
        "token_balance_status": F.when(processed, F.when(F.col("__bad"), "error").when(F.col("__all").isNull(), "not_recorded").when(
            F.expr("exists(__all, c -> c.delta_raw is null)"), "partial").otherwise("recorded")),
        "changes": F.expr("filter(__all, c -> c.delta_raw is null or c.delta_raw <> 0)"),
    }).drop("__bad", "__pairs", "__all")


def named_accounts(instruction: Column, accounts: Column, keys: Column) -> Column:
    """Map of account name to key for a known instruction with enough valid accounts, else null."""
    names = F.create_map(*[x for k, v in protocol.ACCOUNTS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    wanted = F.try_element_at(names, instruction)
    resolved = F.transform(accounts, lambda i: F.get(keys, i))
    fits = (F.size(accounts) >= F.size(wanted)) & F.forall(resolved, lambda k: k.isNotNull())
    return F.when(fits, F.map_from_arrays(wanted, F.slice(resolved, F.lit(1), F.size(wanted))))


AGREE = ("pool", "user", "creator", "base_mint", "quote_mint", "user_base_token_account", "user_quote_token_account", "lp_mint")


def decode_protocol_event(calls: DataFrame, only: Column | None = None, decoded: bool = False) -> DataFrame:
    """Instruction calls of the exchange program -> the one authenticated event each of them emitted.

    calls: keys, ix (the call), inners (array of the instructions it may have emitted, in order).
    Adds status decoded / unsupported / unresolved / error, reason, instruction, accounts (name -> key),
    fields (name -> text), inner_instruction_index and the typed swap columns. Rows where ``only``
    does not hold pass by with nulls instead of their bytes. ``decoded``: the bytes of the call and of the inners are there, as __call and __inner.
    """
    here = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    call = F.when(here, F.col("__call")) if decoded else base58_decode(F.when(here, F.col("ix.data")))
    df = calls.withColumn("__tag", F.lower(F.hex(F.substring(call, 1, 8))))
    name = None
    for k, tag in protocol.INSTRUCTION_TAGS.items():
        name = F.when(F.col("__tag") == tag, k) if name is None else name.when(F.col("__tag") == tag, k)
    df = settle(df, instruction=name)
    df = settle(df, accounts=named_accounts(F.col("instruction"), F.col("ix.accounts"), F.col("keys")))
    event_name = None
    for k, e in protocol.EVENT_OF.items():
        hit = F.when(F.col("instruction") == k, protocol.EVENT_TAGS[e]) if event_name is None else event_name.when(F.col("instruction") == k, protocol.EVENT_TAGS[e])
        event_name = hit
    # what the program emitted below the call, with its position
    df = settle(df, __want=event_name, __own=F.when(here, F.expr(
        f"filter(transform(inners, (x, i) -> struct(i as pos, x as x{', get(__inner, i) as raw' if decoded else ''})), y -> get(keys, y.x.programIdIndex) = '{protocol.PROGRAM}')")))
    df = df.withColumn("__raw", F.expr("transform(__own, y -> y.raw)") if decoded else base58_decode_all(F.expr("transform(__own, y -> y.x.data)")))
    df = df.withColumn("__fields", protocol.unpack_events(F.expr("transform(__raw, r -> substring(r, 9))")))
    df = settle(df, __maps=F.expr("transform(__fields, t -> from_json(t, 'map<string,string>'))"))
    agree = " and ".join(f"(not map_contains_key(f, '{k}') or not map_contains_key(accounts, '{k}') or f['{k}'] = accounts['{k}'])" for k in AGREE)
    verdict = (
        "transform(arrays_zip(__own, __raw, __maps), z -> named_struct('pos', z.__own.pos, 'f', z.__maps, 'sha', sha2(z.__raw, 256), 'v', case"
        " when z.__raw is null then 'error'"
        f" when lower(hex(substring(z.__raw, 1, 8))) <> '{protocol.EVENT_TAG}' then 'unsupported'"
        " when not (z.__own.x.stackHeight <=> 2) then 'unresolved'"
        " when lower(hex(substring(z.__raw, 9, 8))) <> __want then 'unsupported'"
        " when not coalesce(size(z.__own.x.accounts) > 0 and forall(z.__own.x.accounts, i -> get(keys, i) is not null), false) then 'error'"
        " when not (get(keys, z.__own.x.accounts[0]) <=> accounts['event_authority']) then 'error'"
        " when z.__maps is null then 'error'"
        f" when not exists(array(z.__maps), f -> {agree} and (not map_contains_key(f, 'ix_name') or f['ix_name'] = instruction)) then 'error'"
        " else 'found' end))"
    )
    bad_program = F.expr("exists(inners, x -> get(keys, x.programIdIndex) is null)")
    usable = F.col("instruction").isNotNull() & F.col("accounts").isNotNull()
    df = settle(df, __v=F.when(usable, F.expr(verdict)))
    df = settle(
        df,
        __stop=F.expr("get(filter(__v, x -> x.v in ('error', 'unresolved')), 0).v"),
        __found=F.expr("filter(__v, x -> x.v = 'found')"),
        unsupported_inner=F.expr("size(filter(__v, x -> x.v = 'unsupported'))"),
    )
    dead = first_reason([
        (F.col("__tag").isNull(), "error:invalid_protocol_evidence"),
        (F.col("instruction").isNull(), "unsupported:instruction_not_supported"),
        (F.col("accounts").isNull(), "error:invalid_protocol_evidence"),
        (F.try_element_at("accounts", F.lit("program")) != protocol.PROGRAM, "error:invalid_protocol_evidence"),
        (F.coalesce(bad_program, F.lit(False)), "error:invalid_protocol_evidence"),
        (F.col("__stop").eqNullSafe("error"), "error:invalid_protocol_evidence"),
        (F.col("__stop").eqNullSafe("unresolved"), "unresolved:event_stack_unproven"),
        (F.coalesce(F.size("__found"), F.lit(0)) < 1, "unresolved:matching_event_missing"),
        (F.size("__found") > 1, "error:invalid_protocol_evidence"),
    ], "decoded:ok")
    df = settle(df, __s=F.split(dead, ":"))
    done = F.col("__s")[0] == "decoded"
    one = F.get("__found", F.lit(0))
    df = settle(df, status=F.col("__s")[0], reason=F.col("__s")[1], fields=F.when(done, one["f"]),
                inner_instruction_index=F.when(done, one["pos"]), event_data_sha256=F.when(done, one["sha"]))
    done = F.col("status") == "decoded"
    f, a = F.col("fields"), F.col("accounts")
    swap = F.col("instruction").isin("buy", "buy_exact_quote_in", "sell")
    buy = F.col("instruction") != "sell"
    return df.withColumns({
        "kind": F.when(done, F.when(swap, "swap").when(F.col("instruction") == "create_pool", "pool_created").otherwise(F.concat(F.lit("liquidity_"), F.col("instruction")))),
        "pool": f["pool"],
        "wallet": F.coalesce(F.try_element_at("fields", F.lit("user")), F.try_element_at("fields", F.lit("creator"))),
        "base_mint": F.when(done, a["base_mint"]), "quote_mint": F.when(done, a["quote_mint"]),
        "input_mint": F.when(done & swap, F.when(buy, a["quote_mint"]).otherwise(a["base_mint"])),
        "output_mint": F.when(done & swap, F.when(buy, a["base_mint"]).otherwise(a["quote_mint"])),
        "input_amount_raw": F.when(done & swap, u64(F.when(buy, F.try_element_at(f, F.lit("user_quote_amount_in"))).otherwise(F.try_element_at(f, F.lit("base_amount_in"))))),
        "output_amount_raw": F.when(done & swap, u64(F.when(buy, F.try_element_at(f, F.lit("base_amount_out"))).otherwise(F.try_element_at(f, F.lit("user_quote_amount_out"))))),
    }).drop("__tag", "__call", "__inner", "__want", "__own", "__raw", "__fields", "__maps", "__v", "__stop", "__found", "__s")


def top_level_calls(transactions: DataFrame) -> DataFrame:
    """Outer instructions of processed transactions with the inner group below each of them."""
    rows = F.expr("transform(instructions, (x, i) -> named_struct('instruction_index', i, 'ix', x,"
                  f" 'inners', coalesce(get(filter(inner, g -> g.index = i), 0).instructions, cast(array() as array<{INSTRUCTION}>))))")
    return transactions.where(F.col("status") == "processed").select(
        "slot", "blockhash", "transaction_index", "signature", "keys", F.inline(rows)
    ).withColumn("program", F.get("keys", F.col("ix.programIdIndex")))


DEX_VERSION = "targeted-dex-v1"


def dex_events(transactions: DataFrame) -> DataFrame:
    """State of every outer instruction; decoded ones carry the event. Other programs never reach the byte codecs."""
    calls = top_level_calls(transactions)
    routed = F.coalesce(F.expr(f"exists(inners, x -> get(keys, x.programIdIndex) = '{protocol.PROGRAM}')"), F.lit(False))
    own = F.col("program") == protocol.PROGRAM
    out = decode_protocol_event(calls, own)
    out = out.withColumns({
        "status": F.when(F.col("program").isNull(), "error").when(own, F.col("status")).otherwise("unsupported"),
        "reason": F.when(F.col("program").isNull(), "invalid_program_index").when(own, F.col("reason"))
        .when(routed, "routed_protocol_not_supported").otherwise("protocol_not_supported")})
    return out.withColumn("event_id", F.when(F.col("status") == "decoded", event_id(
        F.lit(DEX_VERSION), "slot", "blockhash", "signature", "instruction_index", "inner_instruction_index")))


#: Fold over the inner calls of one instruction: ``open`` holds the index of the call open at each depth from 2 on.
_PARENTS = (
    "aggregate(inners, named_struct('open', cast(array() as array<int>), 'out', cast(array() as array<struct<parent:int,state:string>>)), (a, x) -> "
    "if(x.stackHeight is null or x.stackHeight < 2 or x.stackHeight > size(a.open) + 2,"
    " named_struct('open', cast(array() as array<int>), 'out', a.out || array(named_struct('parent', cast(null as int), 'state',"
    " if(x.stackHeight is null or x.stackHeight < 2, 'depth_missing', 'parent_missing')))),"
    " named_struct('open', slice(a.open, 1, x.stackHeight - 2) || array(size(a.out)),"
    " 'out', a.out || array(named_struct('parent', if(x.stackHeight = 2, cast(null as int), a.open[x.stackHeight - 3]), 'state', 'ok')))), a -> a.out)")


def inner_calls(transactions: DataFrame) -> DataFrame:
    """Every inner call of processed transactions with the index of the call that made it, in one pass over its group.

    parent_inner_index is null for calls made by the outer instruction (depth 2). A call without a depth, or deeper than any
    open call allows, has state ``depth_missing`` or ``parent_missing``, and no call is known to be open after it.
    """
    calls = top_level_calls(transactions).withColumn("__p", F.expr(_PARENTS))
    rows = F.expr("transform(inners, (x, i) -> named_struct('inner_instruction_index', i, 'inner_ix', x, 'parent_inner_index', __p[i].parent, 'state', __p[i].state))")
    return calls.select("slot", "blockhash", "transaction_index", "signature", "instruction_index", "keys", F.inline(rows)).withColumn(
        "program", F.get("keys", F.col("inner_ix.programIdIndex"))).withColumn("depth", F.col("inner_ix.stackHeight"))


def routed_calls(transactions: DataFrame) -> DataFrame:
    """Calls of the program made inside other programs, each with the events one level below it.

    The subtree of a call ends at the next instruction that is not deeper; its own events are at
    depth + 1. A missing depth anywhere in the subtree leaves the call unresolved.
    """
    calls = top_level_calls(transactions).where(F.col("program") != protocol.PROGRAM)
    own = f"exists(inners, x -> get(keys, x.programIdIndex) = '{protocol.PROGRAM}')"
    # the bytes of all inner calls of the program, decoded once, before the calls are told from their events
    calls = calls.where(own).withColumn("__data", base58_decode_all(F.expr(f"transform(inners, x -> if(get(keys, x.programIdIndex) = '{protocol.PROGRAM}', x.data, null))")))
    # events the program emits to itself are not calls
    parents = F.expr("filter(transform(inners, (x, i) -> named_struct('parent_inner_index', i, 'ix2', x, '__tag', lower(hex(substring(get(__data, i), 1, 8))))),"
                     f" y -> get(keys, y.ix2.programIdIndex) = '{protocol.PROGRAM}' and not (y.__tag <=> '{protocol.EVENT_TAG}'))")
    p = calls.select("*", F.inline(parents))
    p = p.withColumn("call_depth", F.col("ix2.stackHeight"))
    p = p.withColumn("__rest", F.expr("slice(inners, parent_inner_index + 2, greatest(size(inners) - parent_inner_index - 1, 0))"))
    p = p.withColumn("__stop", F.expr("cast(array_position(transform(__rest, x -> coalesce(x.stackHeight < 2 or x.stackHeight <= call_depth, true)), true) as int)"))
    p = p.withColumn("__sub", F.expr("if(__stop = 0, __rest, slice(__rest, 1, __stop - 1))"))
    broken = F.expr("__stop > 0 and coalesce(__rest[__stop - 1].stackHeight < 2, true)")
    p = p.withColumn("__state", F.when(F.col("__tag").isNull(), "error:invalid_inner_data")
                     .when(F.coalesce(F.col("call_depth") < 2, F.lit(True)), "unresolved:parent_depth_missing")
                     .when(broken, "unresolved:subtree_depth_missing"))
    positions = F.expr("transform(filter(transform(__sub, (x, i) -> struct(x as x, i as i)), y -> y.x.stackHeight = call_depth + 1), y -> parent_inner_index + 1 + y.i)")
    children = F.expr("transform(filter(__sub, x -> x.stackHeight = call_depth + 1),"
                      " x -> named_struct('programIdIndex', x.programIdIndex, 'accounts', x.accounts, 'data', x.data, 'stackHeight', 2))")
    # calls that are not ready pass by the byte codecs in the same scan
    ready = F.col("__state").isNull()
    p = settle(p, __ready=ready, __call=F.expr("get(__data, parent_inner_index)"), __pos=F.when(ready, positions), __why=F.split("__state", ":"), __below=F.when(ready, children).otherwise(F.col("inners")))
    p = p.withColumns({"__inner": F.expr("transform(__pos, k -> get(__data, k))"), "inners": F.col("__below"), "ix": F.when(F.col("__ready"), F.col("ix2")).otherwise(F.col("ix"))})
    p = p.drop("ix2", "__tag", "__rest", "__stop", "__sub", "__state", "__below", "__data")
    out = decode_protocol_event(p, F.col("__ready"), decoded=True)
    ready = F.col("__ready")
    out = out.withColumns({
        **{c: F.when(ready, F.col(c)) for c in out.columns if c not in p.columns},
        "status": F.when(ready, F.col("status")).otherwise(F.col("__why")[0]), "reason": F.when(ready, F.col("reason")).otherwise(F.col("__why")[1]),
        "inner_instruction_index": F.when(ready, F.get("__pos", F.col("inner_instruction_index")))})
    return out.drop("__ready", "__pos", "__why")


def decode_coverage(instructions: DataFrame, by=("slot",)) -> DataFrame:
    """Per slot: transactions and instructions by status, accounting check, fully-decoded flag.

    instructions: decoded rows of ``explode_instructions(..., every=True)``, so blocks are decoded once and nothing is joined back.
    """
    by = list(by)
    tx, real = F.col("first"), F.col("instruction_index").isNotNull()
    out = instructions.groupBy(*by).agg(
        *[F.count_if(tx & (F.col("transaction_status") == s)).alias(f"transactions_{s}") for s in ("processed", "failed", "unsupported", "error")],
        F.count_if(tx).alias("transactions_expected"),
        F.count_if(tx & (F.col("inner_coverage") == "unavailable")).alias("inner_coverage_unavailable"),
        *[F.count_if(real & (F.col("status") == s)).alias(f"instructions_{s}") for s in ("decoded", "unsupported", "error")],
        F.count_if(real).alias("instructions_observed"))
    return out.withColumns({
        "accounting_ok": F.expr("transactions_expected = transactions_processed + transactions_failed + transactions_unsupported + transactions_error"
                                " and instructions_observed = instructions_decoded + instructions_unsupported + instructions_error"),
        "fully_decoded": F.expr("transactions_error + transactions_unsupported + instructions_error + instructions_unsupported + inner_coverage_unavailable = 0"),
    })


PROVENANCE = ("attempt_id", "raw_sha256", "block_document_sha256", "source_observed_at", "source_published_at")


def attach_event_provenance(events: DataFrame, publications: DataFrame) -> DataFrame:
    """Put the evidence of the published block onto each event; an event without one keeps its place with a reason."""
    have = [c for c in PROVENANCE if c in publications.columns]
    ref = publications.select("slot", F.struct("slot", *have).alias("provenance"))
    return events.join(ref, "slot", "left").withColumn("provenance_reason", F.when(F.col("provenance").isNull(), "publication_missing").otherwise("ok"))


def transaction_view(instructions: DataFrame) -> DataFrame:
    """Signature, fee, status, balance status and the per-instruction results (at most one transaction's worth).

    instructions: decoded rows of ``explode_instructions(with_balance_status(transactions), every=True, carry=("fee", "token_balance_status"))``.
    A transaction's rows are made in its own task, so they are combined before they are shuffled.
    """
    fee = u64("fee")
    status = F.when(F.col("fee").isNotNull() & fee.isNull(), "error").otherwise(F.col("transaction_status"))
    balance = F.when(F.col("transaction_status") == "failed", "transaction_failed").otherwise(F.coalesce("token_balance_status", F.lit("unknown")))
    result = F.when(F.col("instruction_index").isNotNull(), F.struct("instruction_index", "program", "status"))
    first = F.col("first")
    out = instructions.groupBy("slot", "transaction_index").agg(
        *[F.max(F.when(first, c)).alias(n) for n, c in (("signature", F.col("signature")), ("fee_lamports", fee), ("status", status), ("token_balance_status", balance))],
        F.array_sort(F.collect_list(result)).alias("instruction_results"))
    return out.withColumn("instruction_results", F.when(F.size("instruction_results") > 0, F.col("instruction_results")))


def duplicate_signatures(transactions: DataFrame) -> DataFrame:
    return transactions.where(F.col("reason") == "duplicate_transaction_signature")


def import_blocks(publications: DataFrame, attempts: DataFrame, sessions: DataFrame, network: str, limit: int | None = None) -> DataFrame:
    """Accepted blocks with their raw bytes and session context, keyed network:slot:hash, in slot order."""
    p = publications.join(attempts.select(F.col("id").alias("attempt_id"), "session_id", "raw"), "attempt_id")
    p = p.join(sessions.select(F.col("id").alias("session_id"), "context"), "session_id")
    out = p.select(F.concat_ws(":", F.lit(network), F.col("slot").cast("string"), "blockhash").alias("block_key"), "slot", "attempt_id", "raw", "context")
    return out if limit is None else out.orderBy("slot").limit(limit)
