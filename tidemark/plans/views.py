"""Stand-in views of the operators' inputs over the test tables, in Spark and in SQL.

Both forms say the same thing; the SQL one is the prefix of the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import scratch

_LANDED: dict = {}


def landed(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A derived input written once per session and tables folder, as the operators would find it.

    Block, exchange and ledger tables are files in real use; without this every reference to
    one of them would repeat the joins and encodings that make the stand-in.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _LANDED:
        path = f"{scratch(spark)}/{name}"
        df = build()
        df.write.option("compression", "zstd").parquet(path)
        _LANDED[key] = (path, df.schema)
    path, schema = _LANDED[key]
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(df: DataFrame, c: str) -> Column:
    """UTC microseconds of a timestamp column with or without zone."""
    if isinstance(df.schema[c].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(c))
    return F.unix_micros(F.col(c))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Swap stream: a pool per user, event id as sequence and slot."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("pool"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("slot"),
        (micros(e, "ts") * 1000).alias("availability_ns"),
        F.floor(micros(e, "ts") / 1_000_000).cast("bigint").alias("event_time"),
        F.pmod("event_id", F.lit(7)).alias("wallet"),
        F.expr("case event_type when 'signup' then 'pool_created' when 'error' then 'failed' else 'swap' end").alias("kind"),
        F.expr("case when event_type in ('purchase', 'view') then 'buy' else 'sell' end").alias("instruction"),
        F.round(F.col("value") * 100).cast("bigint").alias("quote_raw"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") + 1).alias("base_raw"),
    )


EV = """ev AS (
  SELECT user_id AS pool, event_id AS seq, event_id AS slot, epoch_us(ts) * 1000 AS availability_ns,
         epoch_us(ts) // 1000000 AS event_time, event_id % 7 AS wallet,
         CASE event_type WHEN 'signup' THEN 'pool_created' WHEN 'error' THEN 'failed' ELSE 'swap' END AS kind,
         CASE WHEN event_type IN ('purchase', 'view') THEN 'buy' ELSE 'sell' END AS instruction,
         CAST(round(value * 100) AS BIGINT) AS quote_raw,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 AS base_raw
  FROM events),
sw AS (SELECT * FROM ev WHERE kind = 'swap' AND quote_raw > 0 AND base_raw > 0)"""
SWAP = "kind = 'swap' and quote_raw > 0 and base_raw > 0"


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Journal captures: identity (order, line); document = the two flags; order = every column."""
    li = table(spark, sf, "lineitem")
    us = micros(li, "l_shipdate")
    return li.select(
        F.col("l_orderkey").alias("source"),
        F.col("l_linenumber").cast("bigint").alias("source_id"),
        F.concat_ws("|", "l_returnflag", "l_linestatus").alias("document"),
        us.alias("available_at"),
        F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("x"), F.col("l_quantity").cast("bigint").alias("q"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("d"), F.round(F.col("l_tax") * 100).cast("bigint").alias("a"),
    )


CAP = """cap AS (
  SELECT l_orderkey AS source, CAST(l_linenumber AS BIGINT) AS source_id, l_returnflag || '|' || l_linestatus AS document,
         epoch_us(l_shipdate) AS available_at, l_partkey AS p, l_suppkey AS s, CAST(round(l_extendedprice * 100) AS BIGINT) AS x,
         CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS a
  FROM lineitem)"""
CAP_COLUMNS = ["available_at", "p", "s", "x", "q", "d", "a"]
CAP_ORDER = ", ".join(CAP_COLUMNS)


def fills(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows: asset per part; N buys, R sells, A cancels; total order over every column."""
    li = table(spark, sf, "lineitem")
    us = micros(li, "l_shipdate")
    return li.select(
        F.col("l_partkey").alias("mint"),
        F.expr("case l_returnflag when 'N' then 'BUY' when 'R' then 'SELL' else 'CANCEL' end").alias("side"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("quote_raw"),
        F.col("l_quantity").cast("bigint").alias("base_units"),
        us.alias("t"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("n"),
        F.col("l_suppkey").alias("s"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("d"), F.round(F.col("l_tax") * 100).cast("bigint").alias("a"),
        F.col("l_linestatus").alias("f"),
    )


FILL_ORDER = ["t", "o", "n", "s", "quote_raw", "base_units", "d", "a", "f"]
FILLS = """fl AS (
  SELECT l_partkey AS mint, CASE l_returnflag WHEN 'N' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE 'CANCEL' END AS side,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS quote_raw, CAST(l_quantity AS BIGINT) AS base_units,
         epoch_us(l_shipdate) AS t, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, l_suppkey AS s,
         CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS a, l_linestatus AS f
  FROM lineitem)"""
FILL_ORDER_SQL = ", ".join(FILL_ORDER)


def blocks(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Range tables over order keys: an attempt per distinct (order, line), archived on even lines of F orders."""
    if (spark.sparkContext.applicationId, sf, "publications") in _LANDED:
        return {name: landed(spark, sf, name, None) for name in ("attempts", "outcomes", "publications")}
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slot"), F.col("l_linenumber").cast("bigint").alias("n")).distinct()
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("slot"), F.col("o_orderstatus").alias("st"), F.col("o_custkey").alias("c"))
    a = li.join(orders, "slot").withColumn("id", F.col("slot") * 10 + F.col("n"))
    status = F.expr("case when st = 'F' and n % 2 = 0 then 'archived' when st = 'F' then 'error' when st = 'P' then 'unavailable' when n % 2 = 1 then 'error' else 'unavailable' end")
    reason = F.expr("case when st = 'F' and n % 2 = 0 then 'ok' when st = 'F' then 'rpc_-32603' when st = 'P' then 'null_result' when n % 2 = 1 then 'rpc_-32015' else 'timeout' end")
    attempts = a.select("id", "slot", (F.col("slot") % 3).alias("session_id"), F.concat(F.lit("raw"), F.col("id")).alias("raw"),
                        F.concat(F.lit("h"), F.col("id")).alias("raw_hash"), (F.col("slot") % 2).cast("int").alias("request_version"))
    outcomes = a.where("id % 23 <> 4").select(F.col("id").alias("attempt_id"), status.alias("status"), reason.alias("reason"),
                                              F.concat(F.lit("d"), F.col("slot"), F.when(F.col("id") % 31 == 2, "x").otherwise("")).alias("document_hash"))
    made = (attempts, outcomes)
    attempts = landed(spark, sf, "attempts", lambda: made[0])
    outcomes = landed(spark, sf, "outcomes", lambda: made[1])
    done = attempts.select("id", "slot").join(outcomes.withColumnRenamed("attempt_id", "id"), "id")
    first = done.where("status = 'archived'").groupBy("slot").agg(F.min_by(F.struct("id", "document_hash"), "id").alias("f"))
    from ..operators.ordered import Ordered

    o = Ordered(first.withColumn("k", F.lit(0)), ["k"], ["slot"]).last_seen("prev", F.col("slot"))
    parent = F.when(F.col("slot") % 101 == 7, F.greatest(F.col("slot") - 40, F.lit(0))).otherwise(F.coalesce("prev", F.lit(-1)))
    pubs = o.result().select(
        "slot", F.col("f.id").alias("attempt_id"), F.concat(F.lit("b"), F.col("slot")).alias("blockhash"),
        F.when(F.col("slot") % 97 == 5, "wrong").otherwise(F.concat(F.lit("b"), parent)).alias("previous_blockhash"),
        parent.alias("parent_slot"), F.col("f.document_hash").alias("document_hash"))
    return {"attempts": attempts, "outcomes": outcomes, "publications": landed(spark, sf, "publications", lambda: pubs)}


BLOCKS = """li AS (SELECT DISTINCT l_orderkey AS slot, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
al AS (SELECT slot, n, slot * 10 + n AS id, o_orderstatus AS st FROM li JOIN orders ON o_orderkey = slot),
oc AS (SELECT id, slot, CASE WHEN st = 'F' AND n % 2 = 0 THEN 'archived' WHEN st = 'F' THEN 'error' WHEN st = 'P' THEN 'unavailable' WHEN n % 2 = 1 THEN 'error' ELSE 'unavailable' END AS status,
 CASE WHEN st = 'F' AND n % 2 = 0 THEN 'ok' WHEN st = 'F' THEN 'rpc_-32603' WHEN st = 'P' THEN 'null_result' WHEN n % 2 = 1 THEN 'rpc_-32015' ELSE 'timeout' END AS reason,
 'd' || slot || CASE WHEN id % 31 = 2 THEN 'x' ELSE '' END AS document_hash FROM al WHERE id % 23 <> 4),
fp AS (SELECT slot, min(id) AS attempt_id, arg_min(document_hash, id) AS document_hash FROM oc WHERE status = 'archived' GROUP BY slot),
fq AS (SELECT *, CASE WHEN slot % 101 = 7 THEN greatest(slot - 40, 0) ELSE coalesce(lag(slot) OVER (ORDER BY slot), -1) END AS parent_slot FROM fp),
pb AS (SELECT slot, attempt_id, document_hash, 'b' || slot AS blockhash, parent_slot, CASE WHEN slot % 97 = 5 THEN 'wrong' ELSE 'b' || parent_slot END AS previous_blockhash FROM fq),
sp AS (SELECT max(o_orderkey) AS hi FROM orders),
pf AS (SELECT s AS slot, min(c.slot) AS proof_slot FROM pb c JOIN pb p ON p.slot = c.parent_slot AND c.previous_blockhash = p.blockhash, LATERAL (SELECT unnest(range(c.parent_slot + 1, c.slot)) AS s) GROUP BY s),
pr AS (SELECT * FROM pf WHERE slot NOT IN (SELECT slot FROM pb)),
ls AS (SELECT slot, arg_max(status, id) AS status, arg_max(reason, id) AS reason, max(id) AS attempt_id FROM oc GROUP BY slot),
st AS (SELECT o_orderkey AS slot, CASE WHEN pb.slot IS NOT NULL THEN 'archived' WHEN pr.slot IS NOT NULL THEN 'skipped' ELSE coalesce(ls.status, 'unavailable') END AS status,
 CASE WHEN pb.slot IS NOT NULL THEN 'ok' WHEN pr.slot IS NOT NULL THEN 'verified_parent_gap' ELSE coalesce(ls.reason, 'not_attempted') END AS reason,
 coalesce(pb.attempt_id, ls.attempt_id) AS attempt_id, pr.proof_slot FROM orders LEFT JOIN pb ON pb.slot = o_orderkey LEFT JOIN pr ON pr.slot = o_orderkey LEFT JOIN ls ON ls.slot = o_orderkey)"""
