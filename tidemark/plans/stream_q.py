"""Source and streaming queries: tables are landed as files and read back, streams run until the input is used up."""

from pyspark.sql import functions as F

from ..operators import pit as I
from ..operators import validate as P
from ..sources import files as S
from ..streaming import pools as X
from .features_q import DRAWDOWN, WIN, bps
from .ops_q import ALERTS, observations
from .registry import query
from .views import BLOCKS, EV, events, micros, table
from .views import blocks as range_tables


@query("record_lines", f"""WITH {EV} SELECT seq, true AS valid_utf8, 'ok' AS reason FROM ev""")
def record_lines(spark, sf):
    ev = events(spark, sf)
    path = f"{S.scratch(spark)}/records"
    rec = ev.select(F.lit(1).alias("schema_version"), F.lit("feed").alias("source"), F.col("seq").cast("string").alias("source_id"), F.col("pool").cast("string").alias("logical_id"), F.lit("swap").alias("kind"), "event_time",
                    F.lit(None).cast("bigint").alias("slot"), F.lit(None).cast("string").alias("blockhash"), F.lit("offchain").alias("commitment"), F.lit(0).alias("revision"), F.lit(None).cast("string").alias("supersedes"),
                    F.lit(False).alias("retracted"), F.struct("quote_raw").alias("payload"))
    S.export_jsonl(rec, path)
    lines = S.read_records(spark, path)
    out = P.parse_records(P.validate_record(lines))
    return out.select(F.col("source_id").cast("bigint").alias("seq"), "valid_utf8", "reason")


@query("request_provenance", """SELECT o_orderkey AS capture_id, CASE WHEN o_custkey % 5 <> 0 THEN 'https://h' || (o_custkey % 3) || '.example:8899' END AS origin, CASE WHEN o_custkey % 5 <> 0 THEN '[{"a":1,"b":2}]' END AS request_params FROM orders""")
def request_provenance(spark, sf):
    o = table(spark, sf, "orders")
    req = o.where("o_custkey % 5 <> 0").select(F.col("o_orderkey").alias("capture_id"), F.concat(F.lit("https://user:key@h"), F.col("o_custkey") % 3, F.lit(".example:8899/path?token=abcd")).alias("endpoint"),
                                               F.lit('[{"b":2, "a":1}]').alias("request_params"))
    return S.attach_provenance(o.select(F.col("o_orderkey").alias("capture_id")), req).select("capture_id", F.col("endpoint").alias("origin"), "request_params")


def archive(spark, sf):
    b = range_tables(spark, sf)
    none = F.lit(None).cast("string")
    return {
        "block_meta": spark.range(1).select("id", F.lit(1).alias("version"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("next_slot")),
        "sessions": table(spark, sf, "events").select(F.pmod("user_id", F.lit(3)).alias("id")).distinct().select("id", F.lit("c").alias("context"), F.lit("h").alias("hash")),
        "attempts": b["attempts"].withColumns({"raw": F.col("raw").cast("binary"), "transport_error": none, "observed_at": F.lit(0), "evidence_hash": none}),
        "outcomes": b["outcomes"].withColumn("document", none),
        "slots": b["outcomes"].select(F.col("attempt_id").alias("slot"), "status", "reason", "attempt_id", F.col("attempt_id").alias("proof_slot")),
        "publications": b["publications"].withColumns({"document": none, "published_at": F.lit(0)}),
    }


@query("archive_tables", f"WITH {BLOCKS} SELECT 'attempts' AS name, count(*) AS rows, CAST(sum(length('raw' || id)) AS BIGINT) AS bytes FROM al UNION ALL SELECT 'outcomes', count(*), NULL FROM oc UNION ALL SELECT 'publications', count(*), NULL FROM pb UNION ALL SELECT 'slots', count(*), NULL FROM oc")
def archive_tables(spark, sf):
    path = f"{S.scratch(spark)}/archive"
    back = S.read_archive_tables(spark, path, S.write_archive_tables(archive(spark, sf), path))
    out = back["attempts"].agg(F.lit("attempts").alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("raw")).alias("bytes"))
    for name in ("outcomes", "publications", "slots"):
        out = out.unionByName(back[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(None).cast("bigint").alias("bytes")))
    return out


@query("frames_by_kind", f"WITH {EV} SELECT seq, quote_raw AS amount FROM ev WHERE kind = 'swap' AND seq < (SELECT count(*) * 9 // 10 FROM ev)")
def frames_by_kind(spark, sf):
    ev = events(spark, sf)
    path = f"{S.scratch(spark)}/frames"
    S.write_frames(ev.select("seq", "kind", F.to_json(F.struct(F.col("quote_raw").alias("amount"))).alias("metadata"), F.lit(None).cast("binary").alias("raw"), F.col("availability_ns").alias("observed_ns"),
                             F.lit("").alias("prev"), F.lit("").alias("hash")), path)
    return S.read_frames(spark, path, "swap", ev.count() * 9 // 10, "amount bigint").select("seq", "metadata.amount")


@query("content_addressed_dataset", "SELECT o_orderkey, o_orderstatus FROM orders")
def content_addressed_dataset(spark, sf):
    root = f"{S.scratch(spark)}/datasets"
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    first = S.write_content_addressed(df, root)
    if S.write_content_addressed(df.repartition(3), root) != first:
        raise AssertionError("the same rows must get the same name")
    return S.read_dataset(spark, root, first)


@query("checked_dataset", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def checked_dataset(spark, sf):
    """A dataset copied while its content is summed: one scan, verified after it."""
    root = f"{S.scratch(spark)}/datasets"
    digest = S.write_content_addressed(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), root)
    checked = S.CheckedDataset(spark, root, digest)
    checked.rows.write.parquet(f"{root}/copy")
    checked.verify()
    return spark.read.parquet(f"{root}/copy")


@query("file_hashes", "SELECT l_returnflag AS flag, count(*) AS rows, true AS same FROM lineitem GROUP BY 1")
def file_hashes(spark, sf):
    """A file a flag: the hashes of the bytes agree between two reads, and the rows with those of the table."""
    path = f"{S.scratch(spark)}/hashed"
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey")
    li.repartition(3, "l_returnflag").write.partitionBy("l_returnflag").parquet(path)
    hashes, again = (I.file_hashes(spark, path).where("name like '%.parquet'") for _ in range(2))
    bad = I.verify_manifest(hashes, again)
    rows = spark.read.parquet(path).withColumn("name", F.url_decode(I.relative_name(F.input_file_name(), path))).groupBy("l_returnflag", "name").agg(F.count(F.lit(1)).alias("rows"))
    found = hashes.withColumn("name", F.url_decode("name")).join(rows, "name").join(bad.select("name", "state"), "name", "left")
    return found.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum("rows").alias("rows"), (F.count("state") == 0).alias("same"))


@query("archive_snapshot", f"WITH {BLOCKS} SELECT name, rows FROM (SELECT 'attempts' AS name, count(*) AS rows FROM al UNION ALL SELECT 'outcomes', count(*) FROM oc UNION ALL SELECT 'publications', count(*) FROM pb UNION ALL SELECT 'slots', count(*) FROM oc UNION ALL SELECT 'sessions', count(DISTINCT user_id % 3) FROM events UNION ALL SELECT 'block_meta', 1)")
def archive_snapshot(spark, sf):
    """All six tables written as one snapshot and read back by their fixed columns."""
    path = f"{S.scratch(spark)}/archive"
    back = S.read_archive_tables(spark, path, S.write_archive_tables(archive(spark, sf), path), as_base64=True)
    out = None
    for name in S.ARCHIVE_TABLES:
        rows = back[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


def stream_events(spark, sf):
    """The events table as a stream of swaps."""
    schema = table(spark, sf, "events").schema
    e = S.stream_frames(spark, sf, schema, glob="events.parquet")
    return e.select(
        F.col("user_id").alias("pool"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("slot"), (micros(e, "ts") * 1000).alias("availability_ns"),
        F.pmod("event_id", F.lit(7)).cast("string").alias("wallet"), F.expr("case event_type when 'signup' then 'pool_created' when 'error' then 'failed' else 'swap' end").alias("kind"),
        F.expr("case when event_type in ('purchase', 'view') then 'buy' else 'sell' end").alias("instruction"), F.round(F.col("value") * 100).cast("bigint").alias("quote_raw"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") + 1).alias("base_raw"))


STREAM = DRAWDOWN + f""", x AS (SELECT *, count(*) OVER w AS n, CAST(sum(quote_raw) OVER w AS BIGINT) AS vol, first_value(quote_raw) OVER w AS fq, first_value(base_raw) OVER w AS fb FROM sw WINDOW w AS ({WIN} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
d AS (SELECT pool, seq, min(fall) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS dd FROM f), nw AS (SELECT seq, row_number() OVER (PARTITION BY pool, wallet ORDER BY seq) = 1 AS new_wallet FROM sw)
SELECT x.pool, x.seq, n AS swaps_observed, vol AS volume_quote_raw, {bps("quote_raw", "base_raw", "fq", "fb")} AS price_change_bps, dd AS drawdown_bps, new_wallet FROM x JOIN d USING (pool, seq) JOIN nw ON nw.seq = x.seq"""


@query("stream_pool_features", STREAM)
def stream_pool_features(spark, sf):
    with_rocksdb(spark)
    out = X.run_available(X.stream_pool_features(stream_events(spark, sf), 16, (3600, 86400)), S.scratch(spark))
    return out.where("entry = 'feature'").select("pool", "seq", "swaps_observed", "volume_quote_raw", "price_change_bps", "drawdown_bps", "new_wallet")


@query("stream_alert_transitions", ALERTS + " SELECT source, code, id, CASE WHEN st THEN 'OPEN' ELSE 'RESOLVED' END AS state FROM tr WHERE st <> pv")
def stream_alert_transitions(spark, sf):
    with_rocksdb(spark)
    path = S.scratch(spark)
    obs = observations(spark, sf)
    obs.write.parquet(f"{path}/landing")
    return X.run_available(X.stream_alerts(S.stream_frames(spark, f"{path}/landing", obs.schema)), path)


@query("stream_published", "WITH r AS (SELECT l_orderkey AS id, l_returnflag || l_linestatus AS hash, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS ord FROM lineitem) SELECT id, arg_min(hash, {o: ord, h: hash}) AS hash FROM r GROUP BY id")
def stream_published(spark, sf):
    path = S.scratch(spark)
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("hash"),
                                             (F.col("l_linenumber").cast("bigint") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("bigint")).alias("ord"))
    # arrivals that share an order are settled by content before they land
    li = li.groupBy("id", "ord").agg(F.min("hash").alias("hash"))
    li.write.parquet(f"{path}/landing")
    q = X.stream_publish(S.stream_frames(spark, f"{path}/landing", li.schema), f"{path}/table", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/table/published").select("id", "hash")


ARRIVALS = """r AS (SELECT l_orderkey AS id, l_returnflag || l_linestatus AS hash, l_linenumber AS n, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS ord FROM lineitem),
f AS (SELECT id, arg_min(hash, {b: CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 ELSE 3 END, o: ord, h: hash}) AS first FROM r GROUP BY id)"""


@query("stream_published_batches", f"""WITH {ARRIVALS} SELECT CAST(id AS VARCHAR) AS id, first AS content, 'new' AS action FROM f
UNION ALL SELECT CAST(id AS VARCHAR), hash, 'conflict' FROM (SELECT DISTINCT r.id, hash, CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 ELSE 3 END AS b FROM r JOIN f ON r.id = f.id WHERE hash <> first)
 JOIN (VALUES (1), (2), (2), (3)) v(d) ON b = d""")
def stream_published_batches(spark, sf):
    """Three batches, and the second one delivered again: known ids are looked up in keyed state, not in what was published."""
    with_rocksdb(spark)
    path = S.scratch(spark)
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("hash"), F.col("l_linenumber").alias("n"),
                                             (F.col("l_linenumber").cast("bigint") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("bigint")).alias("ord"))
    out = None
    for part in ("n <= 2", "n between 3 and 4", "n > 4", "n between 3 and 4"):
        li.where(part).drop("n").write.mode("append").parquet(f"{path}/landing")
        out = X.run_available(X.stream_known_ids(S.stream_frames(spark, f"{path}/landing", li.drop("n").schema), buckets=16), path)
    return out


@query("stream_closed_feed_windows", """WITH t AS (SELECT user_id, ts, epoch_us(ts) * 1000 AS ns, event_type, time_bucket(INTERVAL '1 day', ts) AS d FROM events), m AS (SELECT max(ts) - INTERVAL '2 days' AS w FROM t)
SELECT user_id AS window_id, epoch_us(d) AS starts_us, min(ns) AS first_ns, max(ns) AS last_ns, count(*) AS messages, bool_or(event_type = 'signup') AS opened, bool_or(event_type = 'error') AS closed, 'PARTIAL' AS coverage
FROM t, m WHERE d + INTERVAL '1 day' <= w GROUP BY user_id, d""")
def stream_closed_feed_windows(spark, sf):
    """Days of each feed that are over, two days after the newest message."""
    schema = table(spark, sf, "events").schema
    e = S.stream_frames(spark, sf, schema, glob="events.parquet")
    m = e.select(F.col("user_id").alias("window_id"), (micros(e, "ts") * 1000).alias("observed_ns"), F.expr("case event_type when 'signup' then 'open' when 'error' then 'close' end").alias("marker"),
                 F.timestamp_micros(micros(e, "ts")).alias("at"))
    out = X.run_available(X.stream_closed_windows(m, "at", "1 day", "2 days"), S.scratch(spark))
    return out.select("window_id", F.unix_micros("starts").alias("starts_us"), "first_ns", "last_ns", "messages", "opened", "closed", "coverage")


@query("stream_feed_coverage", f"""WITH {EV} SELECT pool AS window_id, min(availability_ns) AS first_ns, max(availability_ns) AS last_ns, count(*) AS messages, bool_or(kind = 'pool_created') AS opened, bool_or(kind = 'failed') AS closed, 'PARTIAL' AS coverage FROM ev GROUP BY pool""")
def stream_feed_coverage(spark, sf):
    m = stream_events(spark, sf).select(F.col("pool").alias("window_id"), "seq", F.col("availability_ns").alias("observed_ns"), F.expr("case kind when 'pool_created' then 'open' when 'failed' then 'close' end").alias("marker"))
    return X.run_available(X.stream_coverage(m), S.scratch(spark), "complete")


def with_rocksdb(spark):
    """Keyed state with lists and maps needs the RocksDB store; its stores share one bounded memory an executor, however many they are."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
