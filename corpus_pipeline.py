"""Documents to packed training sequences: five stages, each written as Parquet and read again by the next.

A stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept. All but the last return the columns of
``documents``; other columns of the input are not read, whatever their names. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tidemark.llm.common import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality model scores below 0.3; null and empty texts are scored like any other, repeated rows stay."""
    from tidemark.llm.quality import score_documents, train

    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model, carry=COLUMNS).where(F.col("score") >= 0.3).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked texts the row with the smallest (id, text hash), once; null ids come first, null and empty texts are copies of each other."""
    from tidemark.llm.jaccard import one_of_each

    docs = docs.select(*COLUMNS)
    keep = one_of_each(docs)
    tied = docs.withColumn("__tie", F.xxhash64("text"))
    kept = tied.join(keep.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("__tie") == F.col("rep_tie")))
    return kept.dropDuplicates(["doc_id", "__tie"]).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the kind in brackets; null texts stay null, no row is dropped."""
    from tidemark.llm.pii import mask_spans, train_field

    return mask_spans(docs.select(*COLUMNS), train_field(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or drops whole documents toward the source targets; a row for every time a document is taken.

    A null source is a source; documents without words (null, empty) stay once; equal rows are taken one by one.
    """
    from tidemark.llm.mixing import mix_sources

    taken = mix_sources(docs, cut=False, carry=("text", "lang", "n_chars"))
    # a document without words costs nothing and stays once
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise((F.col("taken") / F.col("size")).cast("int"))
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; a null or empty text is one end token, repeated rows are documents of their own."""
    import public_tokenizers
    from tidemark.llm.packing import pack_documents

    # the workers still hold what the stages before remember, so this one remembers less
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remember=150_000, at_once=1 << 20)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: The model, the sampled paths and the tokenizer cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
