"""The queries ``opN_*`` over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document: places of the base phrases, labels with those of fuzzy matches."""
    from .licenses import BASE, find_notices

    found = find_notices(_table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: (h["edits"] == 0) & h["phrase"].isin([n.phrase for n in BASE]))
    starts = F.transform("base", lambda h: h["first_word"])
    spans = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["label"], h["first_word"].cast("string"), h["words"].cast("string"), h["edits"].cast("string"))), ",")
    closeness = F.transform("hits", lambda h: 1.0 - h["edits"] / F.char_length(h["phrase"]))
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda h: h["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(closeness), F.lit(0.0)).alias("score"), F.size("hits").cast("long").alias("n_hits"), spans.alias("spans"),
    )


def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labelled rows outside the held-out fold."""
    from .quality import held_out, score_documents, train

    docs = _table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    from .chat import format_trees, read_back, turns_as_tree, unescaped

    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string"))
    done = format_trees(turns_as_tree(turns)).withColumn("turns", read_back(F.col("formatted")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("loss_mask", lambda s: unescaped(F.substring("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    return done.withColumn("loss", loss).select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest each query by integer inner product."""
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 35 words that start anywhere else too."""
    from .passages import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and all spans with those of the field."""
    from .pii import KINDS, find_personal_data, train_field

    docs = _table(spark, sf_dir, "documents")
    found = find_personal_data(docs, train_field(docs))

    def joined(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and to the next text."""
    from .fingerprints import next_text_fingerprints

    return next_text_fingerprints(_table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, toward capped source targets."""
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document: shingles of five words, similarity 0.8."""
    from .jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that five documents share, but for the last of them."""
    from .lines import drop_common_lines

    return drop_common_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: four parts, 256 entries, four rounds."""
    from .codes import compress

    return compress(_table(spark, sf_dir, "embeddings"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents toward the benchmark texts, and the ranks of the drawn tenth."""
    from .resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_scores, op3_chat_formatting, op4_exact_top_k, op5_substring_dedup, op6_personal_data, op7_phrase_fingerprints, op8_mix_sources, op9_jaccard_join, op10_best_fit_packing, op11_line_dedup, op12_vector_codes, op13_target_resampling)}

#: A text with the control strings of the chat template escaped, as in ``chat.escaped``.
_ESCAPED = r"regexp_replace(text, '([<\[])(\\*)(/?(?:INST|SYS|TURN)|/?s>)', '\1\\\2\3', 'g')"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds of op12 one after another: every part against every entry of its position."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (
            SELECT r, p.part, min(CAST(p.n - 2 * list_dot_product(p.x, b.c) + list_dot_product(b.c, b.c) AS BIGINT) * {entries} + b.e) AS m
            FROM p JOIN b{k} b ON p.part = b.part GROUP BY r, p.part
        )""")
        if k < rounds:
            steps.append(f"""
        u{k} AS (
            SELECT part, e, list(v ORDER BY j) AS c FROM (
                SELECT part, e, j, floor(sum(v) / count(*)) AS v
                FROM (SELECT p.part, a.m % {entries} AS e, unnest(p.x) AS v, unnest(range(len(p.x))) AS j FROM p JOIN a{k} a ON p.r = a.r AND p.part = a.part)
                GROUP BY part, e, j
            ) GROUP BY part, e
        ), b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(u.c, b.c) AS c FROM b{k} b LEFT JOIN u{k} u ON b.part = u.part AND b.e = u.e)""")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), p AS MATERIALIZED (
            SELECT r, part, x, list_dot_product(x, x) AS n
            FROM (SELECT r, t.part, x[t.part * (len(x) // {parts}) + 1 : (t.part + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) t(part))
        ), b0 AS MATERIALIZED (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= {entries}), {", ".join(steps)},
        books AS (
            SELECT sha256(string_agg(t, ',' ORDER BY part, e)) AS codebooks_sha256
            FROM (SELECT part, e, array_to_string([CAST(CAST(y AS BIGINT) AS VARCHAR) FOR y IN c], ',') AS t FROM b{rounds})
        ), done AS (
            SELECT v.vec_id, v.label, string_agg(printf('%02x', CAST(m % {entries} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error
            FROM v JOIN a{rounds} a ON v.r = a.r GROUP BY v.r, v.vec_id, v.label
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM done, books"""


_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op3_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            CAST(3 + sum(length({_ESCAPED}) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
                ELSE 17 + length(role) END) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS r, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
        ), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20""",
    "op11_line_dedup": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, r, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
        k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM x),
        c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        f AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
        FROM f GROUP BY r, doc_id""",
    "op12_vector_codes": _codes_sql(),
    "op13_target_resampling": f"""
        WITH crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, j: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i)) AS t
        ), d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
        dw AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d),
        bw AS MATERIALIZED (SELECT unnest({_WORDS}) AS word FROM benchmark),
        words AS MATERIALIZED (
            SELECT word, xor(list_reduce(list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                lambda a, y: xor(t[(xor(a, y) & 255) + 1], a // 256), 4294967295), 4294967295) % 10000 AS bucket
            FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc
        ), s AS (SELECT bucket, count(*) AS s FROM dw JOIN words USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM bw JOIN words USING (word) GROUP BY bucket),
        gain AS MATERIALIZED (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000)
                / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS g
            FROM (SELECT DISTINCT bucket FROM words) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
        ), f AS (SELECT r, floor(sum(g) / count(*)) AS weight FROM dw JOIN words USING (word) JOIN gain USING (bucket) GROUP BY r),
        h AS (SELECT doc_id, r, len(w) AS n_features, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d),
        g AS (
            SELECT doc_id, r, n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM h LEFT JOIN f USING (r)
        ), k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM g WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM g LEFT JOIN k USING (r)""",
}
