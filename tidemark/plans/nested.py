"""Nested stand-ins: blocks of transactions written from lineitem, exchange calls written from events.

Keys, signatures and payloads are real encodings of row values, so decoding them again must
give back the row.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import protocol
from ..functions.codecs import as_lists, base58_encode, decode_batch, each_distinct, encode_batch, from_base58, to_base58
from ..operators import decode as D
from ..operators.validate import TOKEN
from .views import SWAP, events, landed, micros, table


def wide(spark: SparkSession) -> int:
    """Partitions for work that is heavy per byte; a number, as AQE would merge them by size."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_of(text):
    return base58_encode(F.unhex(F.sha2(text, 256)))


def fixed_key(text: str) -> str:
    return to_base58(hashlib.sha256(text.encode()).digest())


@F.arrow_udf(T.ArrayType(T.StringType()))
def hashed_keys(prefix: pa.Array, numbers: pa.Array) -> pa.Array:
    """The keys of the prefix with each number of a list."""
    p = prefix[0].as_py() if len(prefix) else ""
    return each_distinct(numbers, lambda found: encode_batch([hashlib.sha256(f"{p}{x}".encode()).digest() for x in found]), pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def signatures(texts: pa.Array) -> pa.Array:
    """Signatures made of two hashes of each text of a list."""
    def work(found):
        return encode_batch([hashlib.sha256(f"x{t}".encode()).digest() + hashlib.sha256(f"y{t}".encode()).digest() for t in found])
    return each_distinct(texts, work, pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def payloads(amounts: pa.Array, decimals: pa.Array) -> pa.Array:
    """Transfer data of the lists: opcode 2 (u32) and amount (u64), or tag 12, amount and decimals (u8) where these are given; little-endian."""
    raw = [None if a is None else (b"\2\0\0\0" if d is None else b"\x0c") + a.to_bytes(8, "little") + (b"" if d is None else bytes([d]))
           for a, d in zip(amounts.flatten().to_pylist(), decimals.flatten().to_pylist())]
    return as_lists(amounts, pa.array(encode_batch(raw), pa.string()))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A block per order, a transaction per lineitem row (sorted by all its columns).

    Rows meet while they are narrow: the one shuffle and the grouping carry numbers, and keys, signatures and payloads are encoded from the
    lists of a block afterwards. A query reads its blocks once, so they are not written down first.
    """
    li = table(spark, sf, "lineitem")
    r = li.select(
        F.col("l_orderkey").alias("slot"), F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("x"), F.col("l_quantity").cast("bigint").alias("q"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("d"), F.round(F.col("l_tax") * 100).cast("bigint").alias("a"),
        micros(li, "l_shipdate").alias("t"), F.col("l_returnflag").alias("f")).repartition(wide(spark), "slot")
    g = r.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("n", "p", "s", "x", "q", "d", "a", "t", "f"))).alias("l"))

    deep = F.expr("transform(l, e -> if(e.q % 2 = 0 and e.a = 1, e.x, null))")
    paid = F.expr("transform(l, e -> if(e.f <=> 'A', null, e.x))")
    checked = F.expr("transform(l, e -> if(e.f = 'R' or e.q = 7, e.n, null))")
    g = g.select(
        "slot", "l", hashed_keys(F.lit("p"), "l.p").alias("ka"), hashed_keys(F.lit("s"), "l.s").alias("ks"), hashed_keys(F.lit("m"), "l.n").alias("km"),
        signatures(F.expr("transform(l, e -> concat_ws('|', '', slot, e.n))")).alias("sig"), payloads(paid, checked).alias("data"),
        payloads(deep, F.expr("transform(l, e -> cast(null as bigint))")).alias("dn"))

    def instruction(accounts: str, data: str, depth: str) -> str:
        return f"named_struct('programIdIndex', 4, 'accounts', {accounts}, 'data', {data}, 'stackHeight', {depth})"

    def balance(units: str) -> str:
        return f"array(named_struct('accountIndex', 0, 'mint', km[i], 'owner', cast(null as string), 'programId', '{TOKEN}', 'amount', cast({units} as string), 'decimals', 6))"

    ix = instruction("if(e.f = 'N', array(0, 1), array(0, 1, 2, 3))", "if(e.f = 'A', 'abc', data[i])", "cast(null as int)")
    group = f"array<struct<index:int,instructions:array<{D.INSTRUCTION}>>>"
    inner = (f"case when e.q % 2 = 1 then cast(null as {group}) when e.a = 1 then array(named_struct('index', 0, 'instructions', array({instruction('array(0, 1)', 'dn[i]', '2')})))"
             f" else cast(array() as {group}) end")
    bal = f"array<{D.BALANCE}>"
    meta = (
        "named_struct('errPresent', true, 'err', if(e.d = 10, 'boom', null), 'fee', cast(e.x as string), 'loadedAddresses', cast(null as struct<writable:array<string>,readonly:array<string>>),"
        f" 'innerInstructions', {inner}, 'preTokenBalances', if(e.q % 3 <> 0, {balance('e.q * 100')}, cast(null as {bal})),"
        f" 'postTokenBalances', if(e.q % 3 = 1 and e.s % 5 = 0, cast(array() as {bal}), {balance('e.q * 100 + e.x % 7 - 3')}))")
    prog = f"case e.f when 'N' then '{D.SYSTEM}' when 'R' then '{TOKEN}' else '{fixed_key('other')}' end"
    tx = (
        "named_struct('version', case when e.a = 8 then '5' when e.s % 2 = 0 then '0' else 'legacy' end, 'signatures', array(sig[i]), 'accountKeys', array(ka[i], ks[i], km[i], ka[i], "
        f"{prog}), 'lookups', 0, 'instructions', array({ix}), 'meta', if(e.q <> 50, {meta}, null))")
    made = F.expr(f"transform(l, (e, i) -> {tx})").cast(f"array<{D.TRANSACTION}>")
    return D.settle(g, blockhash=F.concat(F.lit("b"), F.col("slot").cast("string")), transactions=made).select("slot", "blockhash", "transactions")


NESTED = """nt AS (SELECT l_orderkey AS slot, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p, l_suppkey AS s, CAST(round(l_extendedprice * 100) AS BIGINT) AS x, CAST(l_quantity AS BIGINT) AS q,
 CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS a, epoch_us(l_shipdate) AS t, l_returnflag AS f FROM lineitem),
nv AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY n, p, s, x, q, d, a, t) - 1 AS ti, a <> 8 AND q <> 50 AND d <> 10 AS live FROM nt),
nd AS (SELECT *, live AND count(*) FILTER (WHERE live) OVER (PARTITION BY slot, n ORDER BY ti) > 1 AS dup FROM nv),
tx AS (SELECT *, CASE WHEN a = 8 THEN 'unsupported' WHEN q = 50 THEN 'error' WHEN d = 10 THEN 'failed' WHEN dup THEN 'error' ELSE 'processed' END AS status,
 CASE WHEN a = 8 THEN 'transaction_version_not_supported' WHEN q = 50 THEN 'execution_status_missing' WHEN d = 10 THEN 'transaction_failed' WHEN dup THEN 'duplicate_transaction_signature' ELSE 'ok' END AS reason FROM nd),
ix AS (SELECT *, false AS deep FROM tx WHERE status = 'processed' UNION ALL SELECT *, true FROM tx WHERE status = 'processed' AND q % 2 = 0 AND a = 1),
ds AS (SELECT *, CASE WHEN deep OR f <> 'N' OR q = 7 THEN 'unsupported' ELSE 'decoded' END AS ist,
 CASE WHEN deep THEN 'inner_execution_not_proven' WHEN f <> 'N' THEN 'program_not_supported' WHEN q = 7 THEN 'system_opcode_not_supported' ELSE 'system_transfer' END AS ire FROM ix)"""


def _pack(instruction: str, base: int, quote: int, pool: str, user: str, at: int) -> bytes:
    event = protocol.EVENT_OF[instruction]
    known = {"pool": pool, "user": user, "ix_name": instruction, "timestamp": at, "base_amount_out": base, "base_amount_in": base,
             "user_quote_amount_in": quote, "user_quote_amount_out": quote, "virtual_quote_reserves": -12}
    out = bytes.fromhex(protocol.EVENT_TAG) + protocol.discriminator("event", event)
    for name, kind in protocol.FIELDS[event]:
        if kind == "pubkey":
            out += from_base58(known.get(name) or fixed_key(name))
        elif kind == "bool":
            out += b"\0"
        elif kind == "string":
            text = known[name].encode()
            out += len(text).to_bytes(4, "little") + text
        else:
            out += int(known.get(name, 100)).to_bytes(int(kind[1:]) // 8, "little", signed=kind[0] == "i")
    return out


@lru_cache
def _event_layout(instruction: str) -> tuple[np.ndarray, dict[str, int]]:
    """An event with zeros for amounts, keys and time, and where each of its fields begins."""
    raw = np.frombuffer(_pack(instruction, 0, 0, "", "", 0), dtype=np.uint8)
    at, places = 16, {}
    for name, kind in protocol.FIELDS[protocol.EVENT_OF[instruction]]:
        places[name] = at
        at += 32 if kind == "pubkey" else 1 if kind == "bool" else 4 + len(instruction) if kind == "string" else int(kind[1:]) // 8
    return raw, places


def _pack_all(instruction: str, base: np.ndarray, quote: np.ndarray, pool: list, user: list, at: np.ndarray) -> list[bytes]:
    """``_pack`` for many rows of an instruction at once."""
    raw, places = _event_layout(instruction)
    out = np.tile(raw, (len(base), 1))

    def put(name: str, values: np.ndarray, width: int) -> None:
        if name in places:
            out[:, places[name]:places[name] + width] = np.ascontiguousarray(values).view(np.uint8).reshape(len(base), width)

    for name in ("base_amount_out", "base_amount_in"):
        put(name, base.astype("<u8"), 8)
    for name in ("user_quote_amount_in", "user_quote_amount_out"):
        put(name, quote.astype("<u8"), 8)
    put("timestamp", at.astype("<i8"), 8)
    for name, keys in (("pool", pool), ("user", user)):
        known = decode_batch([k or fixed_key(name) for k in keys])
        put(name, np.frombuffer(b"".join(known), dtype=np.uint8), 32)
    whole, size = out.tobytes(), out.shape[1]
    return [whole[k:k + size] for k in range(0, len(whole), size)]


@F.pandas_udf(T.BinaryType())
def packed_event(instruction: pd.Series, base: pd.Series, quote: pd.Series, pool: pd.Series, user: pd.Series, at: pd.Series) -> pd.Series:
    numbers = [x.to_numpy() for x in (base, quote, at)]
    if any(x.dtype != np.int64 for x in numbers) or min(x.min(initial=0) for x in numbers[:2]) < 0:
        return pd.Series([_pack(*row) for row in zip(instruction, base, quote, pool, user, at)])
    out = pd.Series([None] * len(base), dtype=object)
    for name in instruction.unique():
        here = np.nonzero((instruction == name).to_numpy())[0]
        made = _pack_all(name, *(x[here] for x in numbers[:2]), *(x.iloc[here].tolist() for x in (pool, user)), numbers[2][here])
        out.iloc[here] = np.fromiter(made, dtype=object, count=len(made))
    return out


def exchange_transactions(spark: SparkSession, sf: str, routed: bool = False) -> DataFrame:
    return landed(spark, sf, "routed" if routed else "exchange", lambda: _exchange_transactions(spark, sf, routed))


def _exchange_transactions(spark: SparkSession, sf: str, routed: bool = False) -> DataFrame:
    """A processed transaction per swap with the call and the event it emitted; ``seq % 11`` picks a fault."""
    ev = events(spark, sf).where(SWAP).repartition(wide(spark), "seq")
    ev = ev.withColumns({"pk": key_of(F.concat(F.lit("pool"), F.col("pool").cast("string"))), "uk": key_of(F.concat(F.lit("user"), F.col("wallet").cast("string")))})
    ev = ev.withColumn("ek", F.when(F.col("seq") % 11 == 4, fixed_key("elsewhere")).otherwise(F.col("pk")))
    ev = ev.withColumn("payload", packed_event("instruction", "base_raw", "quote_raw", "ek", "uk", "event_time"))
    ev = ev.withColumn("payload", F.when(F.col("seq") % 11 == 5, F.substring("payload", 1, 60)).otherwise(F.col("payload")))
    ev = ev.withColumn("ed", base58_encode("payload"))

    def keys(name):
        out = []
        for a in protocol.ACCOUNTS[name]:
            out.append(F.col("pk") if a == "pool" else F.col("uk") if a == "user" else F.lit(protocol.PROGRAM if a == "program" else fixed_key(a)))
        return F.array(*out, F.lit(fixed_key("router")))

    def ix(pi, accounts, data, depth):
        return F.struct(F.lit(pi).cast("int").alias("programIdIndex"), accounts.cast("array<int>").alias("accounts"), data.alias("data"), depth.cast("int").alias("stackHeight"))

    rows = None
    for name in ("buy", "sell"):
        acc = protocol.ACCOUNTS[name]
        prog, auth, n = acc.index("program"), acc.index("event_authority"), len(acc)
        call_data = F.lit(to_base58(bytes.fromhex(protocol.INSTRUCTION_TAGS[name]) + bytes(range(16))))
        base = 3 if routed else 2
        depth = F.when(F.col("seq") % 11 == 3, F.lit(None)).otherwise(F.lit(base))
        emitted = ix(prog, F.array(F.lit(auth)), F.col("ed"), depth)
        noise = ix(prog, F.array(F.lit(auth)), F.lit("3xyz"), F.lit(base))
        group = F.when(F.col("seq") % 11 == 1, F.array(noise)).when(F.col("seq") % 11 == 2, F.array(emitted, emitted)).when(
            F.col("seq") % 11 == 6, F.array(noise, emitted)).otherwise(F.array(emitted))
        everyone = F.array(*[F.lit(i) for i in range(n)])
        if routed:
            call = ix(prog, everyone, call_data, F.lit(2))
            other = ix(n, F.array(F.lit(0)), F.lit("3xyz"), F.lit(2))
            group = F.concat(F.array(other, call), group, F.array(other))
            outer = ix(n, F.array(F.lit(0)), F.lit("3xyz"), F.lit(None))
        else:
            outer = ix(prog, everyone, call_data, F.lit(None))
        part = ev.where(F.col("instruction") == name).select(
            F.col("seq").alias("slot"), F.lit("b").alias("blockhash"), F.lit(0).alias("transaction_index"), F.col("seq").cast("string").alias("signature"), keys(name).alias("keys"),
            F.array(outer).alias("instructions"), F.array(F.struct(F.lit(0).alias("index"), group.alias("instructions"))).alias("inner"), F.lit("processed").alias("status"))
        rows = part if rows is None else rows.unionByName(part)
    return rows
