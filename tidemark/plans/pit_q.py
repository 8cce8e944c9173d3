"""Point-in-time queries: captures from lineitem, frames and logs from events."""

from pyspark.sql import functions as F

from ..functions.jsonio import event_id, sha256_hex
from ..operators import pit as I
from ..operators.ordered import Ordered, Split
from .features_q import WIN
from .registry import query
from .views import SWAP, CAP, CAP_COLUMNS, CAP_ORDER, EV, captures, events, table

FIRST = f"PARTITION BY source, source_id ORDER BY {CAP_ORDER}"
CUT = 876614400000000  # 1997-10-12 in microseconds


@query("event_ids", """SELECT l_orderkey, l_linenumber, sha256('[{"v":' || l_orderkey || '},{"v":' || l_linenumber || '},{"v":"' || l_returnflag || '"}]') AS event_id FROM lineitem""")
def event_ids(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", event_id("l_orderkey", "l_linenumber", "l_returnflag").alias("event_id"))


DUPLICATES = f"""WITH {CAP}, r AS (SELECT *, row_number() OVER w AS rn, first_value(document) OVER w AS fd FROM cap WINDOW w AS ({FIRST}))
SELECT source, source_id, {CAP_ORDER}, document, CASE WHEN rn = 1 THEN 'accepted' WHEN fd = document THEN 'duplicate' ELSE 'quarantined' END AS status,
 CASE WHEN rn = 1 THEN 'ok' WHEN fd = document THEN 'identical source event' ELSE 'source ID conflict' END AS reason FROM r"""


@query("classify_duplicates", DUPLICATES)
def classify_duplicates(spark, sf):
    return I.classify_duplicates(captures(spark, sf), ["source", "source_id"], CAP_COLUMNS)


@query("classify_duplicates_hot_ids", DUPLICATES)
def classify_duplicates_hot_ids(spark, sf):
    return I.classify_duplicates(captures(spark, sf), ["source", "source_id"], CAP_COLUMNS, split=Split(2))


@query("semantic_redelivery", f"""WITH {EV}, r AS (SELECT pool % 40 AS id, seq, availability_ns, kind, instruction FROM ev),
x AS (SELECT *, row_number() OVER w AS rn, first_value(kind || instruction) OVER w AS f FROM r WINDOW w AS (PARTITION BY id ORDER BY seq))
SELECT id, seq, CASE WHEN rn = 1 THEN 'new' WHEN f = kind || instruction THEN 'redelivery' ELSE 'identity_conflict' END AS delivery FROM x""")
def semantic_redelivery(spark, sf):
    r = events(spark, sf).select(F.pmod("pool", F.lit(40)).alias("id"), "seq", "availability_ns", "kind", "instruction")
    return I.semantic_dedup(r, ["seq"]).select("id", "seq", "delivery")


def revision_records(spark, sf):
    """Journal records per user: revision counts earlier events of the user, with faults on some ids."""
    ev = Ordered(events(spark, sf), ["pool"], ["seq"]).running(inclusive=False, n=("sum", F.lit(1))).result()
    return ev.withColumn("n", F.coalesce("n", F.lit(0))).select(
        F.col("seq").alias("capture_id"),
        F.lit("s").alias("source"),
        F.concat_ws(":", "pool", "n").alias("source_id"),
        F.col("pool").alias("logical_id"),
        F.when(F.col("seq") % 211 == 5, "risk").otherwise("swap").alias("kind"),
        F.col("n").cast("bigint").alias("revision"),
        F.when(F.col("seq") % 173 == 3, F.lit("nobody")).when(F.col("n") > 0, F.concat_ws(":", "pool", F.col("n") - 1)).alias("supersedes"),
        F.lit(False).alias("retracted"),
        F.col("quote_raw").cast("string").alias("document"),
    )


@query("validate_revisions", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY seq) - 1 AS n FROM ev),
b AS (SELECT *, seq % 173 = 3 AS f1, (seq % 211 = 5) <> (first_value(seq) OVER (PARTITION BY pool ORDER BY seq) % 211 = 5) AS f2 FROM r),
c AS (SELECT *, sum(CASE WHEN f1 OR f2 THEN 1 ELSE 0 END) OVER (PARTITION BY pool ORDER BY seq) AS bad FROM b),
d AS (SELECT *, min(n) FILTER (WHERE bad > 0) OVER (PARTITION BY pool) AS fb FROM c)
SELECT seq AS capture_id, CASE WHEN bad = 0 THEN 'accepted' ELSE 'quarantined' END AS status,
 CASE WHEN bad = 0 THEN 'ok' WHEN fb = 0 THEN 'missing revision parent' WHEN n = fb AND NOT f1 THEN 'revision changes kind' ELSE 'invalid revision chain' END AS reason FROM d""")
def validate_revisions(spark, sf):
    return I.validate_revisions(revision_records(spark, sf)).select("capture_id", "status", "reason")


@query("publication_regressions", f"""WITH {EV}, p AS (SELECT seq AS capture_id, availability_ns - (seq % 40 = 7)::INT * 900000000000 AS available_at, availability_ns AS processed_at FROM ev),
q AS (SELECT *, max(available_at) OVER (ORDER BY capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p)
SELECT capture_id, available_at, processed_at FROM q WHERE available_at < top OR available_at < processed_at""")
def publication_regressions(spark, sf):
    p = events(spark, sf).select(
        F.col("seq").alias("capture_id"),
        (F.col("availability_ns") - F.when(F.col("seq") % 40 == 7, F.lit(900_000_000_000)).otherwise(F.lit(0))).alias("available_at"),
        F.col("availability_ns").alias("processed_at"))
    return I.publication_regressions(p, Split(700))


@query("publish_batch", f"""WITH {CAP} SELECT source, source_id, {CAP_ORDER.replace('available_at, ', '')}, 1700000000000000 AS available_at FROM cap""")
def publish_batch(spark, sf):
    a = captures(spark, sf).withColumnRenamed("available_at", "processed_at")
    out = I.publish(a, 1_700_000_000_000_000, captures(spark, sf))
    return out.select("source", "source_id", "p", "s", "x", "q", "d", "a", "available_at")


@query("as_of_read", f"""WITH {CAP} SELECT source, source_id, document, available_at, q % 10 = 3 AS corrupt FROM cap WHERE available_at <= {CUT}""")
def as_of_read(spark, sf):
    c = captures(spark, sf).withColumn("document_hash", sha256_hex(F.when(F.col("q") % 10 == 3, F.lit("other")).otherwise(F.col("document"))))
    return I.as_of(c, CUT).select("source", "source_id", "document", "available_at", "corrupt")


@query("latest_state_as_of", f"""WITH {CAP}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY source_id DESC, {CAP_ORDER}) AS rn FROM cap WHERE available_at <= {CUT})
SELECT source, source_id AS revision, document FROM r WHERE rn = 1 AND document NOT LIKE 'R%'""")
def latest_state_as_of(spark, sf):
    c = captures(spark, sf).withColumn("revision", F.col("source_id")).withColumn("retracted", F.col("document").startswith("R"))
    tie = F.struct(*[(-F.col(k)).alias(k) for k in CAP_COLUMNS])
    return I.latest_state(c, CUT, ["source"], tie).select("source", "revision", "document")


def fields(*columns):
    """Every column with its length in front, as one text."""
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '~')" for c in columns)


FINGER = """h AS (SELECT sha256(t) AS h FROM t),
g AS (SELECT count(*) AS n, {sums} FROM h)
SELECT n AS rows, sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS dataset_sha256""".format(
    sums=", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS s{i}" for i in range(4)))


@query("dataset_fingerprint", f"WITH t AS (SELECT {fields('o_custkey', 'o_orderkey', 'o_orderstatus')} AS t FROM orders), {FINGER} FROM g")
def dataset_fingerprint(spark, sf):
    return I.fingerprint(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("snapshot_hash", f"WITH {CAP}, t AS (SELECT {fields('document', 'source', 'source_id', 'x')} AS t FROM cap WHERE available_at <= {CUT}), {FINGER}, {CUT} AS cutoff FROM g")
def snapshot_hash(spark, sf):
    return I.snapshot(captures(spark, sf), CUT, ["source", "source_id", "document", "x"])


@query("journal_health", f"""WITH {CAP}, r AS (SELECT *, row_number() OVER w AS rn, first_value(document) OVER w AS fd FROM cap WINDOW w AS ({FIRST})),
s AS (SELECT *, CASE WHEN rn = 1 THEN 'accepted' WHEN fd = document THEN 'duplicate' ELSE 'quarantined' END AS status FROM r)
SELECT 0 AS raw_hash_errors, count(*) FILTER (WHERE status = 'accepted' AND x % 11 <> 0) AS accepted, count(*) FILTER (WHERE status = 'duplicate' AND x % 11 <> 0) AS duplicate,
 count(*) FILTER (WHERE status = 'quarantined' AND x % 11 <> 0) AS quarantined, count(*) FILTER (WHERE q % 10 = 3 AND x % 11 <> 0) AS document_hash_errors,
 count(*) FILTER (WHERE x % 11 = 0) AS pending, count(*) FILTER (WHERE status = 'accepted' AND x % 11 <> 0 AND d = 0) AS unpublished, false AS healthy FROM s""")
def journal_health(spark, sf):
    key = F.concat_ws(",", "source", "source_id", *CAP_COLUMNS)
    c = I.classify_duplicates(captures(spark, sf), ["source", "source_id"], CAP_COLUMNS).withColumn("capture_id", key)
    raw = c.select("capture_id", F.col("document").cast("binary").alias("raw"), sha256_hex("document").alias("raw_sha256"))
    norm = c.where("x % 11 <> 0").select("capture_id", "status", "document", "d",
                                         sha256_hex(F.when(F.col("q") % 10 == 3, F.lit("other")).otherwise(F.col("document"))).alias("document_hash"))
    return I.journal_health(raw, norm, norm.where("status = 'accepted' and d <> 0"))


@query("hash_chain_breaks", f"""WITH {EV}, l AS (SELECT pool AS log_id, row_number() OVER w AS rn, quote_raw AS doc, availability_ns AS tm, seq FROM ev WINDOW w AS ({WIN})),
g AS (SELECT *, rn + (seq % 401 = 9)::INT * 1000 AS s2 FROM l),
h AS (SELECT *, sha256(s2 || '|' || doc) AS hash FROM g),
p AS (SELECT *, CASE WHEN seq % 307 = 11 THEN 'tampered' ELSE coalesce(lag(hash) OVER w, repeat('0', 64)) END AS prev, lag(s2) OVER w AS bs, lag(hash) OVER w AS bh, lag(tm) OVER w AS ba FROM h WINDOW w AS (PARTITION BY log_id ORDER BY s2)),
f AS (SELECT *, CASE WHEN s2 <> coalesce(bs + 1, 1) THEN 'sequence' WHEN prev <> coalesce(bh, repeat('0', 64)) THEN 'previous_hash' WHEN seq % 509 = 4 THEN 'hash' WHEN tm <= ba THEN 'clock' END AS fault FROM p)
SELECT log_id, count(*) AS rows, min(s2) FILTER (WHERE fault IS NOT NULL) AS first_break, arg_min(fault, s2) FILTER (WHERE fault IS NOT NULL) AS fault, count(fault) = 0 AS intact FROM f GROUP BY log_id""")
def hash_chain_breaks(spark, sf):
    good = Ordered(events(spark, sf), ["pool"], ["availability_ns", "seq"]).running(rn=("sum", F.lit(1))).result().select(
        F.col("pool").alias("log_id"), (F.col("rn") + F.when(F.col("seq") % 401 == 9, 1000).otherwise(0)).alias("s2"),
        F.col("quote_raw").alias("doc"), F.col("availability_ns").alias("at"), F.col("seq").alias("ev"))
    good = good.withColumn("good", F.sha2(F.concat_ws("|", "s2", "doc"), 256))
    good = Ordered(good, ["log_id"], ["s2"]).last_seen("before", F.col("good")).result()
    link = F.coalesce("before", F.lit(I.ZERO_HASH))
    log = good.withColumn("prev", F.when(F.col("ev") % 307 == 11, "tampered").otherwise(link))
    # a changed document shows as a hash that does not recompute
    return I.hash_chain_verify(log.withColumnRenamed("good", "hash"),
                               F.when(F.col("ev") % 509 == 4, F.lit("changed")).otherwise(F.sha2(F.concat_ws("|", "s2", "doc"), 256)),
                               seq="s2", split=Split(30))


@query("replay_parity", """SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS copies, 'stored_only' AS side FROM lineitem WHERE l_discount > 0.08 GROUP BY ALL
UNION ALL SELECT l_orderkey, 99, l_returnflag, count(*), 'recomputed_only' FROM lineitem WHERE l_tax > 0.07 GROUP BY ALL""")
def replay_parity(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_returnflag"]
    rebuilt = li.where("not l_discount > 0.08").select(*cols).unionByName(
        li.where("l_tax > 0.07").select("l_orderkey", F.lit(99).alias("l_linenumber"), "l_returnflag"))
    return I.replay_parity(li.select(*cols), rebuilt)


@query("pending_orders", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def pending_orders(spark, sf):
    return I.pending_work(table(spark, sf, "orders"), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("publish_unique", f"""WITH {CAP}, k AS (SELECT source * 10 + source_id AS id, document AS hash, * FROM cap),
old AS (SELECT id, min(hash) AS old FROM k WHERE q < 4 GROUP BY id),
n AS (SELECT id, hash, count(*) AS copies, min({{t: available_at, p: p, s: s, x: x, q: q, d: d, a: a}}) AS o FROM k WHERE q >= 4 GROUP BY ALL),
f AS (SELECT n.*, old.old, first_value(hash) OVER (PARTITION BY n.id ORDER BY o) AS fh FROM n LEFT JOIN old USING (id))
SELECT id, hash, copies, CASE WHEN hash <> coalesce(old, fh) THEN 'conflict' WHEN old IS NULL THEN 'insert' ELSE 'ignore' END AS action FROM f""")
def publish_unique(spark, sf):
    k = captures(spark, sf).withColumn("id", F.col("source") * 10 + F.col("source_id")).withColumnRenamed("document", "hash")
    old = k.where("q < 4").groupBy("id").agg(F.min("hash").alias("hash"))
    return I.publish_unique(k.where("q >= 4"), old, order=CAP_COLUMNS).select("id", "hash", "copies", "action")


@query("identity_as_of", f"""WITH {EV} SELECT pool, seq, max(CASE WHEN kind = 'pool_created' THEN seq END) OVER (PARTITION BY pool ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS identity_seq FROM ev""")
def identity_as_of(spark, sf):
    return I.identity_as_of(events(spark, sf), ["pool"], F.col("kind") == "pool_created").select("pool", "seq", "identity_seq")


@query("control_as_of", f"""WITH {EV}, c AS (SELECT pool, seq, quote_raw % 2 = 0 AS flag FROM ev WHERE kind = 'failed')
SELECT s.pool, s.seq, s.wallet, coalesce(c.flag, false) AS flag FROM sw s ASOF LEFT JOIN c ON s.pool = c.pool AND s.seq > c.seq""")
def control_as_of(spark, sf):
    ev = events(spark, sf)
    controls = ev.where("kind = 'failed'").select("pool", "seq", (F.col("quote_raw") % 2 == 0).alias("flag"))
    return I.control_as_of(ev.where(SWAP).select("pool", "seq", "wallet"), controls, ["pool"], split=Split(20))
