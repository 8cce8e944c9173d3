"""Identity, deduplication, revisions and point-in-time reads.

Visibility is decided by availability time. The same id with the same content is a no-op,
the same id with other content a conflict that is reported and never merged.
"""

from __future__ import annotations

import functools
import hashlib
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exact import WIDE
from ..functions.jsonio import sha256_hex
from ..session import cut_lineage
from .ordered import Ordered, Split, measured


def classify_duplicates(captures: DataFrame, keys, order, document: str = "document",
                        split: Split = Split()) -> DataFrame:
    """First arrival of an id is accepted; a repeat is a duplicate or a source ID conflict."""
    first = F.struct(*order, F.col(document).alias("doc"))
    o = Ordered(captures, keys, order, split).running(__first=("min", first))
    is_first = F.lit(True)
    for c in order:
        is_first = is_first & (F.col(c) == F.col(f"__first.{c}"))
    same = F.col(document).eqNullSafe(F.col("__first.doc"))
    return (
        o.add(
            status=F.when(is_first, "accepted").when(same, "duplicate").otherwise("quarantined"),
            reason=F.when(is_first, "ok").when(same, "identical source event").otherwise("source ID conflict"),
        )
        .result()
        .drop("__first")
    )


def semantic_dedup(events: DataFrame, order, identity: str = "id",
                   ignore=("availability_ns", "provenance", "commitment"), split: Split = Split()) -> DataFrame:
    """Arrivals equal apart from ``ignore`` are redeliveries, other contents under one id are conflicts."""
    kept = sorted(c for c in events.columns if c not in ignore and c not in order)
    content = sha256_hex(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}))
    out = classify_duplicates(events.withColumn("__semantic", content), [identity], order, "__semantic", split)
    return out.withColumn(
        "delivery",
        F.expr("case status when 'accepted' then 'new' when 'duplicate' then 'redelivery' else 'identity_conflict' end"),
    ).drop("status", "reason", "__semantic")


def _follow(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reached from ``roots`` along ``edges`` (node -> next), by doubling the step length.

    The number of rounds is the logarithm of the longest chain. Nodes are unique, so no join
    here meets a hot key; each round is written out, which also keeps the plan flat.
    """
    reached = roots
    jump = cut_lineage(edges)
    while not jump.isEmpty():
        step = reached.join(jump, "node").select(F.col("next").alias("node"))
        reached = cut_lineage(reached.unionByName(step))
        after = jump.select(F.col("node").alias("next"), F.col("next").alias("to"))
        jump = cut_lineage(jump.join(after, "next").select("node", F.col("to").alias("next")))
    return reached.distinct()


def _reached(pool: DataFrame, chain: list[str], split: Split) -> DataFrame:
    """capture_id of the rows that the first revision of their chain reaches, each revision going on to the first later one that continues it."""
    as_parent = pool.select(*chain, (F.col("revision") + 1).alias("rev"), F.col("source_id").alias("sup"), "kind",
                            "capture_id", F.lit(0).alias("child"))
    as_child = pool.where(F.col("supersedes").isNotNull()).select(
        *chain, F.col("revision").alias("rev"), F.col("supersedes").alias("sup"), "kind", "capture_id", F.lit(1).alias("child"))
    o = Ordered(as_parent.unionByName(as_child), [*chain, "rev", "sup", "kind"], ["capture_id", "child"], split)
    o.last_seen("next", F.col("capture_id"), F.col("child") == 1, descending=True)
    edges = o.result().where("child = 0 and next is not null").select(F.col("capture_id").alias("node"), "next")
    roots = (
        pool.where("revision = 0 and supersedes is null and not retracted")
        .groupBy(*chain).agg(F.min("capture_id").alias("node")).select("node")
    )
    return _follow(edges, roots).select(F.col("node").alias("capture_id"))


def _among(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``; nulls are equal."""
    named = keys.select(*[F.col(c).alias(f"__{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    return rows.join(named, functools.reduce(operator.and_, same), "left_semi")


def settle_revisions(rows: DataFrame, split: Split = Split()) -> tuple[DataFrame, int]:
    """capture_id of the accepted rows, and the waves it took.

    Two rules meet: a chain goes from its first revision to the first later row that continues it, and an id accepted
    once in a source refuses its later holders. Each wave follows all chains with the refusals known so far, then finds
    all refusals that follow. Whether a row is accepted depends on earlier rows only, so every wave settles one more step of
    each dependency at least, and there is one end to come to. Waves grow with the longest run of refusals that
    depend on each other, not with their number, and from the second on they follow only chains whose refusals changed.
    """
    chain = ["source", "logical_id"]
    by_chain, by_id = measured(rows, chain, "capture_id", split), measured(rows, ["source", "source_id"], "capture_id", split)
    ids = rows.groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    contested = cut_lineage(_among(rows, ids, ["source", "source_id"]).select(*chain, "source_id", "capture_id"))
    accepted = cut_lineage(_reached(rows, chain, by_chain))
    refused = cut_lineage(accepted.limit(0))
    waves = 1
    while True:
        held = Ordered(contested.join(accepted.withColumn("__ok", F.lit(True)), "capture_id", "left"), ["source", "source_id"], ["capture_id"], by_id)
        held = held.last_seen("held", F.col("capture_id"), F.col("__ok")).result()
        now = cut_lineage(held.where(F.col("held").isNotNull()).select("capture_id"))
        moved = now.join(refused, "capture_id", "left_anti").unionByName(refused.join(now, "capture_id", "left_anti"))
        chains = cut_lineage(contested.join(moved, "capture_id", "left_semi").select(*chain).distinct())
        if chains.isEmpty():
            return accepted, waves
        again = _among(rows, chains, chain)
        fresh = _reached(again.join(now, "capture_id", "left_anti"), chain, by_chain)
        accepted = cut_lineage(accepted.join(again.select("capture_id"), "capture_id", "left_anti").unionByName(fresh))
        refused = now
        waves += 1


def validate_revisions(records: DataFrame, split: Split = Split()) -> DataFrame:
    """Accept, per (source, logical_id), revision 0 and then each next revision of its parent.

    records: capture_id (unique arrival order), source, source_id, logical_id, kind, revision,
    supersedes, retracted, document. A rejected row never becomes a parent and never reserves
    its id, so acceptance depends on earlier verdicts. Instead of folding a whole key in one
    task, ``settle_revisions`` follows pointers and settles clashes of ids in waves; a key of any size is spread over the cluster.
    """
    chain = ["source", "logical_id"]
    rows = records.withColumns({"capture_id": F.col("capture_id").cast("bigint"), "revision": F.col("revision").cast("bigint")})
    by_chain, by_id = measured(rows, chain, "capture_id", split), measured(rows, ["source", "source_id"], "capture_id", split)
    accepted, _ = settle_revisions(rows, split)
    reached = accepted.withColumn("__ok", F.lit(True))
    marked = rows.join(reached, "capture_id", "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
    o = Ordered(marked, ["source", "source_id"], ["capture_id"], by_id)
    o.last_seen("same_id", F.struct("document"), F.col("__ok"))
    o = Ordered(o.result(), chain, ["capture_id"], by_chain)
    o.last_seen("parent", F.struct("revision", "source_id", "kind"), F.col("__ok"))
    is_copy = F.col("same_id").isNotNull() & (F.col("same_id.document") == F.col("document"))
    reason = (
        F.when(F.col("__ok"), "ok")
        .when(is_copy, "identical source event")
        .when(F.col("same_id").isNotNull(), "source ID conflict")
        .when(F.col("parent").isNull(), "missing revision parent")
        .when((F.col("revision") != F.col("parent.revision") + 1)
              | ~F.col("supersedes").eqNullSafe(F.col("parent.source_id")), "invalid revision chain")
        .otherwise("revision changes kind")
    )
    return (
        o.add(
            status=F.when(F.col("__ok"), "accepted").when(is_copy, "duplicate").otherwise("quarantined"),
            reason=reason,
        )
        .result()
        .drop("__ok", "same_id", "parent")
    )


def publish(accepted: DataFrame, now: int, published: DataFrame | None = None) -> DataFrame:
    """Stamp one availability time on accepted rows; a clock behind the journal fails the job."""
    ok = F.col("processed_at") <= F.lit(now)
    out = accepted.withColumn("available_at", F.lit(now).cast("bigint"))
    if published is not None:
        last = published.agg(F.max("available_at").alias("__last"))  # one row
        out = out.join(F.broadcast(last), how="cross")
        ok = ok & F.coalesce(F.col("__last") <= F.lit(now), F.lit(True))
    message = F.lit("clock regression: publication halted")
    return out.where(F.assert_true(ok, message).isNull()).drop("__last")


def publication_regressions(published: DataFrame, split: Split = Split()) -> DataFrame:
    """Published rows whose availability time is before an earlier capture's or before processing."""
    o = Ordered(published.withColumn("__log", F.lit(0)), ["__log"], ["capture_id"], split)
    o.running(inclusive=False, __top=("max", F.col("available_at")))
    return o.result().where((F.col("available_at") < F.col("__top")) | (F.col("available_at") < F.col("processed_at"))).drop("__log", "__top")


def as_of(published: DataFrame, at: int, ordered: bool = False) -> DataFrame:
    """Rows available at the cutoff, with a flag for documents that no longer match their hash."""
    rows = published.where(F.col("available_at") <= F.lit(at))
    if "document_hash" in rows.columns:
        rows = rows.withColumn("corrupt", ~sha256_hex("document").eqNullSafe(F.col("document_hash")))
    return rows.orderBy("available_at", "capture_id") if ordered else rows


def latest_state(published: DataFrame, at: int, keys=("source", "logical_id"), tie: Column | None = None) -> DataFrame:
    """Highest revision per key at the cutoff, without retracted ones (combinable, no sort)."""
    rows = published.where(F.col("available_at") <= F.lit(at))
    value = F.struct(*[c for c in rows.columns if c not in keys])
    rank = F.struct("revision", *([tie] if tie is not None else []))
    top = rows.groupBy(*keys).agg(F.max_by(value, rank).alias("v"))
    return top.select(*keys, "v.*").where(~F.col("retracted"))


def _canonical_text(field: T.StructField) -> Column:
    """The one text of a value; types whose equal values may differ in text are refused."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return plain(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind)
        return isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))

    if not plain(field.dataType):
        raise TypeError(f"{field.name}: no canonical text for {field.dataType.simpleString()}")
    if isinstance(field.dataType, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct(F.col(field.name).alias("v")), {"ignoreNullFields": "false"})
    return F.hex(field.name) if isinstance(field.dataType, T.BinaryType) else F.col(field.name).cast("string")


def content_sums(df: DataFrame, columns=None) -> list[Column]:
    """Aggregates ``rows`` and s0..s3 that add up over any parts of the rows: each row is hashed with the length of every field in front of
    it (null: ``~``, which no length is), columns in the order of their names, and four 60-bit slices of the hashes are summed."""
    fields = [_canonical_text(df.schema[c]) for c in sorted(columns or df.columns)]
    h = sha256_hex(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in fields]))
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast(WIDE)).cast(WIDE).alias(f"s{i}") for i in range(4)]
    return [F.count(F.lit(1)).alias("rows"), *parts]


def sums_digest(sums: dict) -> str:
    """The hash of ``fingerprint`` from collected ``content_sums``."""
    text = ":".join([str(sums["rows"]), *[str(int(sums[f"s{i}"] or 0)) for i in range(4)]])
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(df: DataFrame, columns=None) -> DataFrame:
    """One row: count and a hash that does not depend on row order or partitioning.

    The ``content_sums`` are hashed. It shows a change of content; it is not a proof against a chosen collision.
    """
    sums = df.agg(*content_sums(df, columns))
    joined = F.concat_ws(":", "rows", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)])
    return sums.select("rows", sha256_hex(joined).alias("dataset_sha256"))


def snapshot(published: DataFrame, at: int, columns=None) -> DataFrame:
    """Cutoff, row count and content hash of an as-of read."""
    return fingerprint(published.where(F.col("available_at") <= F.lit(at)), columns).withColumn("cutoff", F.lit(at))


def relative_name(path: Column, root: str) -> Column:
    """The part of a file's path behind the folder ``root``."""
    folder = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring(path, F.locate(folder, path) + len(folder), F.lit(1 << 20))


@F.pandas_udf(T.StringType())
def _streamed_sha256(path: pd.Series) -> pd.Series:
    """SHA-256 of files that are mounted on the executors, read piece by piece."""
    def one(name):
        with open(name.removeprefix("file:"), "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    return path.map(one)


def file_hashes(spark, path: str) -> DataFrame:
    """Per-file SHA-256 under a directory, read by the executors; ``name`` is relative to it.

    Files of a mounted file system are read piece by piece, whatever their size; those of other file systems come as whole values.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mounted = files.select(F.col("path").startswith("file:/").alias("m")).first()
    sha256 = _streamed_sha256("path") if mounted and mounted["m"] else sha256_hex("content")
    return files.select(relative_name(F.col("path"), path).alias("name"), "length", sha256.alias("sha256"))


def verify_manifest(manifest: DataFrame, actual: DataFrame, key: str = "name", value: str = "sha256") -> DataFrame:
    """Entries that are missing, unlisted or changed; empty means verified."""
    m = manifest.select(key, F.col(value).alias("expected"))
    a = actual.select(key, F.col(value).alias("found"))
    out = m.join(a, key, "full")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(
        F.col("expected") != F.col("found"), "changed")
    return out.withColumn("state", state).where(F.col("state").isNotNull())


def journal_health(raw: DataFrame, norm: DataFrame, pub: DataFrame) -> DataFrame:
    """One row: counts by status, hash mismatches, pending and unpublished rows, healthy flag.

    raw: capture_id, raw, raw_sha256; norm: capture_id, status, document, document_hash; pub: capture_id.
    """
    bad_doc = F.col("document").isNotNull() & ~sha256_hex("document").eqNullSafe(F.col("document_hash"))
    r = raw.agg(F.count_if(~sha256_hex("raw").eqNullSafe(F.col("raw_sha256"))).alias("raw_hash_errors"))
    n = norm.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "duplicate", "quarantined")],
        F.count_if(bad_doc).alias("document_hash_errors"),
    )
    pending = raw.join(norm.select("capture_id"), "capture_id", "left_anti").agg(F.count(F.lit(1)).alias("pending"))
    unpub = norm.where("status = 'accepted'").join(pub.select("capture_id"), "capture_id", "left_anti").agg(
        F.count(F.lit(1)).alias("unpublished"))
    # four one-row tables
    out = r.join(F.broadcast(n), how="cross").join(F.broadcast(pending), how="cross").join(F.broadcast(unpub), how="cross")
    return out.withColumn(
        "healthy", F.expr("raw_hash_errors = 0 and document_hash_errors = 0 and pending = 0 and unpublished = 0 and quarantined = 0"))


ZERO_HASH = "0" * 64


def chain_hash(seq, document, prev) -> Column:
    """Link hash of a log row: SHA-256 of its canonical [seq, document, previous] array."""
    parts = [F.col(seq).cast("string"), F.to_json(F.array(F.col(document))), F.to_json(F.array(F.col(prev)))]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def hash_chain_verify(log: DataFrame, computed: Column, log_id: str = "log_id", seq: str = "seq", prev: str = "prev",
                      link: str = "hash", at: str | None = "at", first_seq: int = 1, split: Split = Split()) -> DataFrame:
    """Per log the number of rows and the first break of sequence, link, hash or clock (null = intact)."""
    before = F.struct(F.col(seq).alias("seq"), F.col(link).alias("hash"), (F.col(at) if at else F.lit(None)).alias("at"))
    o = Ordered(log, [log_id], [seq], split).last_seen("__before", before)
    expected_seq = F.coalesce(F.col("__before.seq") + 1, F.lit(first_seq))
    expected_prev = F.coalesce(F.col("__before.hash"), F.lit(ZERO_HASH))
    fault = (
        F.when(F.col(seq) != expected_seq, "sequence")
        .when(~F.col(prev).eqNullSafe(expected_prev), "previous_hash")
        .when(~F.col(link).eqNullSafe(computed), "hash")
    )
    if at:
        fault = fault.when(F.col(at) <= F.col("__before.at"), "clock")
    rows = o.add(__fault=fault).result()
    broken = F.min(F.when(F.col("__fault").isNotNull(), F.struct(F.col(seq).alias("s"), F.col("__fault").alias("f"))))
    return rows.groupBy(log_id).agg(F.count(F.lit(1)).alias("rows"), broken.alias("b")).select(
        log_id, "rows", F.col("b.s").alias("first_break"), F.col("b.f").alias("fault"), F.col("b").isNull().alias("intact"))


def replay_parity(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between the two sides; empty means PASS.

    Copies are counted before the shuffle, so a row repeated very often costs one group.
    """
    cols = stored.columns
    both = stored.select(*cols, F.lit(1).alias("__n")).unionByName(recomputed.select(*cols, F.lit(-1).alias("__n")))
    diff = both.groupBy(*cols).agg(F.sum("__n").alias("copies")).where(F.col("copies") != 0)
    return diff.withColumn("side", F.when(F.col("copies") > 0, "stored_only").otherwise("recomputed_only")).withColumn(
        "copies", F.abs("copies"))


def pending_work(inputs: DataFrame, outputs: DataFrame, key) -> DataFrame:
    """Inputs without an output (the idempotent recovery set)."""
    key = [key] if isinstance(key, str) else list(key)
    return inputs.join(outputs.select(*key).distinct(), key, "left_anti")


def publish_unique(new: DataFrame, existing: DataFrame, identity: str = "id", content: str = "hash",
                   order=("ord",), split: Split = Split()) -> DataFrame:
    """Per distinct (id, content) of the new rows: insert, ignore or conflict.

    Copies are combined first; among different contents the earliest arrival is the one that
    may be inserted. The first unseen content wins, exactly as if rows came one by one.
    """
    distinct = new.groupBy(identity, content).agg(F.min(F.struct(*order)).alias("o"), F.count(F.lit(1)).alias("copies"))
    flat = distinct.select(identity, content, "copies", *[F.col(f"o.{c}").alias(c) for c in order])
    o = Ordered(flat, [identity], list(order), split).running(__first=("min", F.struct(*order, F.col(content).alias("c"))))
    old = existing.select(F.col(identity), F.col(content).alias("__old"))
    held = F.coalesce(F.col("__old"), F.col("__first.c"))
    out = o.result().join(old, identity, "left")
    return out.withColumn(
        "action",
        F.when(F.col(content) != held, "conflict").when(F.col("__old").isNull(), "insert").otherwise("ignore"),
    ).drop("__first", "__old")


def identity_as_of(frames: DataFrame, keys, is_identity: Column, seq: str = "seq", split: Split = Split()) -> DataFrame:
    """Sequence of the last verified identity frame before each frame; null when there is none."""
    o = Ordered(frames, keys, [seq], split).last_seen("identity_seq", F.col(seq), is_identity)
    return o.result()


def control_as_of(plans: DataFrame, controls: DataFrame, keys, seq: str = "seq", flag: str = "flag", default=False,
                  split: Split = Split()) -> DataFrame:
    """Operator flag in force at each plan: the last control with a smaller sequence, else the default."""
    keys = list(keys)
    extra = [c for c in plans.columns if c not in (*keys, seq)]
    payload = F.struct(*extra) if extra else F.struct(F.lit(1).alias("__one"))
    p = plans.select(*keys, seq, payload.alias("__plan"), F.lit(None).cast(controls.schema[flag].dataType).alias("__flag"))
    c = controls.select(*keys, seq, F.lit(None).cast(p.schema["__plan"].dataType).alias("__plan"), F.col(flag).alias("__flag"))
    o = Ordered(p.unionByName(c), keys, [seq], split).last_seen("__in_force", F.col("__flag"), F.col("__plan").isNull())
    out = o.result().where(F.col("__plan").isNotNull())
    return out.select(*keys, seq, *[F.col(f"__plan.{c}").alias(c) for c in extra],
                      F.coalesce("__in_force", F.lit(default)).alias(flag))
