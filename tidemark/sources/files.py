"""Readers and writers: record lines, archive tables, frames, datasets, content-addressed output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonio import canonical_json
from ..operators.pit import content_sums, fingerprint, sums_digest, verify_manifest
from ..session import shared_folder

# Fixed column lists of the six archive tables.
ARCHIVE_TABLES = {
    "block_meta": "id bigint, version bigint, start bigint, end bigint, next_slot bigint",
    "sessions": "id bigint, context string, hash string",
    "attempts": "id bigint, slot bigint, session_id bigint, raw binary, raw_hash string, transport_error string, observed_at bigint, evidence_hash string",
    "outcomes": "attempt_id bigint, status string, reason string, document string, document_hash string",
    "slots": "slot bigint, status string, reason string, attempt_id bigint, proof_slot bigint",
    "publications": "slot bigint, attempt_id bigint, document string, document_hash string, published_at bigint",
}


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint location."""
    return f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One record per line with its bytes untouched; checking is left to the validators."""
    lines = spark.read.text(path)
    return lines.select(F.col("value").alias("raw"), F.is_valid_utf8("value").alias("valid_utf8"), F.col("_metadata.file_path").alias("file"))


def attach_provenance(raw: DataFrame, requests: DataFrame, key: str = "capture_id") -> DataFrame:
    """Captures with their request, the endpoint cut to scheme, host and port."""
    host = F.try_parse_url("endpoint", F.lit("AUTHORITY"))
    bare = F.regexp_replace(host, "^.*@", "")
    origin = F.concat(F.try_parse_url("endpoint", F.lit("PROTOCOL")), F.lit("://"), F.coalesce(bare, F.lit("unknown")))
    req = requests.withColumns({"endpoint": origin, "request_params": F.coalesce(canonical_json("request_params"), F.lit("[]"))})
    return raw.join(req, key, "left")


def write_archive_tables(tables: dict[str, DataFrame], path: str) -> str:
    """Write the six tables as one snapshot; the manifest comes last, so a reader never sees half of it."""
    snapshot = uuid.uuid4().hex
    rows = []
    for name, ddl in ARCHIVE_TABLES.items():
        df = tables[name].select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(ddl)])
        df.write.parquet(f"{path}/{snapshot}/{name}")
        # hash what was written, not the plan behind it
        rows.append((snapshot, name, *fingerprint(df.sparkSession.read.schema(ddl).parquet(f"{path}/{snapshot}/{name}")).first()))
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame(rows, "snapshot string, name string, rows bigint, sha256 string")
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return snapshot


def read_archive_tables(spark: SparkSession, path: str, snapshot: str, as_base64: bool = False) -> dict[str, DataFrame]:
    """The six tables of one snapshot with their fixed columns; raw bytes as base64 text on request."""
    out = {}
    for name, ddl in ARCHIVE_TABLES.items():
        df = spark.read.schema(ddl).parquet(f"{path}/{snapshot}/{name}")
        out[name] = df.withColumn("raw", F.base64("raw")) if as_base64 and name == "attempts" else df
    return out


FRAME = "seq bigint, kind string, metadata string, raw binary, observed_ns bigint, prev string, hash string"


def write_frames(frames: DataFrame, path: str) -> None:
    """Archive frames partitioned by kind, so that reading one kind touches only its files."""
    frames.write.partitionBy("kind").mode("append").parquet(path)


def read_frames(spark: SparkSession, path: str, kind: str, below: int | None = None, metadata: str | None = None) -> DataFrame:
    """Frames of one kind, optionally below a sequence, metadata parsed with the given schema."""
    df = spark.read.schema(FRAME).parquet(path).where(F.col("kind") == kind)
    if below is not None:
        df = df.where(F.col("seq") < below)
    return df if metadata is None else df.withColumn("metadata", F.from_json("metadata", metadata))


def export_jsonl(df: DataFrame, path: str, amounts=()) -> None:
    """One JSON object per line; decimals and the columns named in ``amounts`` go out as text."""
    cols = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) or f.name in amounts else F.col(f.name) for f in df.schema]
    df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def _folders(spark: SparkSession, *paths: str):
    """The file system of the paths, and the paths in its own type."""
    p = [spark._jvm.org.apache.hadoop.fs.Path(x) for x in paths]
    return p[0].getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), *p


def write_content_addressed(df: DataFrame, root: str) -> str:
    """Write under the content hash of the rows. The same content again is a no-op; other content there is an error.

    The rows are written once, to a folder of their own; what was written is summed by file in one scan, which gives the name and the manifest,
    and both are then moved to their names, so a reader never sees half of it and two writers of the same content do not disturb each other.
    """
    spark = df.sparkSession
    staged, listed = f"{root}/_staging-{uuid.uuid4().hex}", f"{root}/_manifests/_staging-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    file_sums(spark.read.schema(df.schema).parquet(staged)).write.parquet(listed)
    total = spark.read.parquet(listed).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)]).first()
    digest = sums_digest(total.asDict())
    path = f"{root}/{digest}"
    fs, src, dst, done, manifest, named = _folders(spark, staged, path, f"{path}/_SUCCESS", listed, f"{root}/_manifests/{digest}")
    try:
        if not fs.exists(done):
            if fs.exists(dst):  # what a lost move left behind
                fs.delete(dst, True)
            if fs.rename(src, dst) and not fs.exists(_folders(spark, f"{path}/{src.getName()}")[1]):
                fs.delete(named, True)
                fs.rename(manifest, named)
                return digest
            # another writer was first, and the move may have gone into its folder
            fs.delete(_folders(spark, f"{path}/{src.getName()}")[1], True)
        if fingerprint(spark.read.schema(df.schema).parquet(path)).first()["dataset_sha256"] != digest:
            raise ValueError("existing dataset does not match its name")
        return digest
    finally:
        fs.delete(src, True)
        fs.delete(manifest, True)


def read_dataset(spark: SparkSession, root: str, digest: str, schema=None) -> DataFrame:
    """A content-addressed dataset; every row carries the check that the whole content still has its hash (a scan before the scan)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(f"{root}/{digest}")
    check = fingerprint(df).select((F.col("dataset_sha256") == digest).alias("__ok"))  # one row
    return df.join(F.broadcast(check), how="cross").where(F.assert_true("__ok", F.lit("dataset hash mismatch")).isNull()).drop("__ok")


class CheckedDataset:
    """Rows of a content-addressed dataset whose content is summed while they are read.

    ``rows`` is read by one action that takes all of it (a write, a count); ``verify`` then compares what that scan summed with the name and
    raises if they differ, naming the files that changed. Nothing is scanned a second time unless something is wrong.
    """

    def __init__(self, spark: SparkSession, root: str, digest: str, schema=None):
        self._spark, self._root, self._digest, self._schema = spark, root, digest, schema
        df = (spark.read if schema is None else spark.read.schema(schema)).parquet(f"{root}/{digest}")
        self._seen = Observation()
        self.rows = df.observe(self._seen, *content_sums(df))

    def verify(self) -> int:
        """Number of rows, or an error with the changed files."""
        found = self._seen.get
        if sums_digest(found) != self._digest:
            changed = changed_files(self._spark, self._root, self._digest, self._schema).limit(20).collect()
            raise ValueError("dataset hash mismatch: " + ", ".join(f"{r['name']} {r['state']}" for r in changed))
        return found["rows"]


def file_sums(df: DataFrame) -> DataFrame:
    """name, rows and the content sums of every file that a reader's rows come from, in one scan; they add up to those of the dataset."""
    name = F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.withColumn("__file", name).groupBy(F.col("__file").alias("name")).agg(*content_sums(df))


def _with_hash(sums: DataFrame) -> DataFrame:
    text = F.concat_ws(":", "rows", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)])
    return sums.select("name", "rows", F.sha2(text, 256).alias("sha256"))


def changed_files(spark: SparkSession, root: str, digest: str, schema=None) -> DataFrame:
    """Files of a dataset that its manifest does not know as they are: name and missing, unlisted or changed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return verify_manifest(_with_hash(spark.read.parquet(f"{root}/_manifests/{digest}")), _with_hash(file_sums(reader.parquet(f"{root}/{digest}"))))


def stream_frames(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Landing folder of archived messages as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)
