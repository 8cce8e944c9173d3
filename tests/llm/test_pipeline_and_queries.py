"""The pipeline's stages against brute force, and every document query through its function on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, quality, queries

COLUMNS = corpus_pipeline.COLUMNS
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join(r.choice(["river", "stone", "walk", "under", "light", "morning", "quiet", "paper", "seven", "bridge"]) + str(r.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for i in range(120):
        good = i % 3 > 0
        text = (prose(r, r.randint(60, 200)) + ".").capitalize() if good else "$$$ " * r.randint(20, 60) + "!!! buy buy " * 10
        out.append([i, text, "en", ["a", "b", None][i % 3] if good else "a", 0])
    out[10][1] = out[4][1]
    near = out[5][1].split()
    near[50] = "changed"
    out[11][1] = " ".join(near)
    out[13][1] += " Write to some.one@example.org or 10.1.2.3, card 4111 1111 1111 1111"
    out += [[200, None, None, None, None], [201, "", "en", "b", 0], [202, "   \n", "en", "zz", 0], [203, None, "en", "a", 1], [None, prose(r, 80), "en", "a", 1], out[7], out[7], [204, prose(r, 6000), "en", "b", 1]]
    return [tuple([x[0], x[1], x[2], x[3], len(x[1] or "")]) for x in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 120, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def docs_of(spark, rows):
    """Documents with columns whose names the stages use inside."""
    df = spark.createDataFrame(rows, DDL)
    return df.withColumns({c: F.lit("x") for c in ("__tie", "__copy", "rep_id", "size", "score", "set", "label", "path")})


def taken(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_quality_stage(spark, rows, folder):
    out = corpus_pipeline.quality(spark, docs_of(spark, rows), folder)
    assert out.columns == list(COLUMNS)
    docs = spark.createDataFrame(rows, DDL)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = quality.score_documents(docs, model, carry=COLUMNS).collect()
    assert taken(out) == Counter(tuple(r[c] for c in COLUMNS) for r in scored if r["score"] >= 0.3)
    kept = {r["doc_id"] for r in out.collect()}
    assert all((i in kept) == (i % 3 > 0) for i in range(120))


def test_near_duplicates_stage(spark, rows, folder):
    out = corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), folder)
    assert out.columns == list(COLUMNS)
    sets = [frozenset(jaccard.shingle_set((r[1] or "").encode(), 5).tolist()) for r in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[top(i)].append(r)
    kept = [tuple(r[c] for c in COLUMNS) for r in out.collect()]
    assert len(kept) == len(groups)
    assert Counter(r[0] for r in kept) == Counter(min((r[0] is not None, r[0] or 0) for r in g)[1] if not any(r[0] is None for r in g) else None for g in groups.values())
    assert set(kept) <= set(rows)


def test_personal_data_stage(spark, rows, folder):
    out = corpus_pipeline.personal_data(spark, docs_of(spark, rows), folder)
    assert out.columns == list(COLUMNS) and out.count() == len(rows)
    got = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}
    assert "some.one@example.org" not in got[13] and "4111 1111" not in got[13] and "10.1.2.3" not in got[13]
    assert got[200] is None and got[201] == "" and got[14] == rows[14][1]


def test_mixing_stage(spark, rows, folder):
    out = corpus_pipeline.mixing(spark, docs_of(spark, rows), folder)
    assert out.columns == list(COLUMNS)
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in set(rows)}
    got = taken(out)
    have = Counter(rows)
    assert set(got) <= set(rows) and all(n <= 2 * have[r] for r, n in got.items() if size[r])
    assert all(got[r] == have[r] for r in set(rows) if not size[r])
    targets = {r["source"]: r["target"] for r in mixing.mix_sources(spark.createDataFrame(rows, DDL), cut=False).collect()}
    words = defaultdict(int)
    for r, n in got.items():
        words[r[3]] += n * size[r]
    longest = max(size.values())
    assert all(abs(words[s] - t) <= longest for s, t in targets.items())
    assert taken(corpus_pipeline.mixing(spark, docs_of(spark, rows[::-1]), folder)) == got  # reruns agree


def test_packing_stage(spark, rows, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = corpus_pipeline.packing(spark, docs_of(spark, rows), folder).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r[0], k // 4096, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    at = defaultdict(list)
    for r in out:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(at) <= -(-sum(r["length"] for r in out) // 4096) + 1


def test_whole_pipeline(spark, rows, folder):
    out = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in out.collect()}
    assert ids and not ids & {0, 3, 6, 10, 11}  # junk, a copy and a near copy


def test_empty_tables(spark, folder):
    none = docs_of(spark, []) if False else spark.createDataFrame([], DDL)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.collect() == [] and (name == "packing" or out.columns == list(COLUMNS))


def test_document_queries(spark, rows, folder):
    """op1, op5 to op10 through their functions: what the contracts fix, by brute force."""
    by_id = Counter()
    for r in rows:
        by_id[r[0]] += 1
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1] or "")
    one = queries.op1_license_scan(spark, folder).collect()
    assert all(r["n_base"] == 0 and r["first_word"] is None and r["base_labels"] == "" and 0 <= r["score"] <= 1 for r in one) and len(one) == len(rows)
    five = {(r["doc_id"], r["n_words"]): (r["n_removed"], r["kept_sha256"]) for r in queries.op5_substring_dedup(spark, folder).collect()}
    split = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    starts = Counter(tuple(w[i : i + 35]) for _, w in split for i in range(len(w) - 34))
    for i, w in split:
        gone = set()
        for k in range(len(w) - 34):
            if starts[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        assert five[i, len(w)] == (len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    six = {r["doc_id"]: r for r in queries.op6_personal_data(spark, folder).collect()}
    assert (six[13]["n_email"], six[13]["n_ip"], six[13]["n_card"], six[13]["n_phone"]) == (1, 1, 1, 0) and six[14]["n_email"] == 0
    base = [(m.start(), m.end(), k) for k, p in (("email", r"[\w.]+@[\w.]+"), ("ip", r"10\.1\.2\.3"), ("card", r"4111[ 1]+")) for m in re.finditer(p, rows[13][1])]
    assert six[13]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base)).encode()).hexdigest()
    seven = queries.op7_phrase_fingerprints(spark, folder).collect()
    same = defaultdict(set)
    for r in seven:
        if r["doc_id"] in texts and len(set(texts[r["doc_id"]])) == 1:
            same[texts[r["doc_id"]][0]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values()) and all(0 <= r["near_next"] <= 1 for r in seven)
    eight = queries.op8_mix_sources(spark, folder).collect()
    took, target = defaultdict(int), {}
    for r in eight:
        took[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(took[s] - target[s]) <= 1 for s in target)
    nine = {r["doc_id"]: r["class_id"] for r in queries.op9_jaccard_join(spark, folder).collect()}
    assert nine[10] == nine[4] == 4 and nine[11] == nine[5] == 5 and nine[1] == 1
    ten = queries.op10_best_fit_packing(spark, folder).collect()
    assert sum(r["length"] for r in ten) == sum(max(s["start"] + s["length"] for s in g) for g in _by_document(ten))


def _by_document(pieces):
    """Pieces of one document each; rows with equal ids are told apart by their count of first pieces."""
    out = defaultdict(list)
    for r in pieces:
        out[r["doc_id"]].append(r)
    for i, g in out.items():
        first = [r for r in g if r["piece"] == 0]
        if len(first) == 1:
            yield g
        else:
            for r in first:
                yield [r]


def test_cells_of_unlike_weights(spark):
    """Two groups of documents with unlike weights: the cell in which the budget ends is cut until it is small."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 1e-5).otherwise(1.0).alias("w"))
    out = mixing.mix_sources(df, weight=F.col("w"), weights=(1,), share=0.7, most=2.0).select("doc_id", "size", "taken", "target").collect()
    assert sum(r["taken"] for r in out) == round(out[0]["target"]) == 42_000
    heavy = sum(r["taken"] > 0 for r in out if r["doc_id"] % 2)
    assert heavy == 10_000


def test_cells_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 3)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 5).cast("int"))).alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(df).collect()}
    monkeypatch.setattr(mixing, "CELL_ROWS", 10**9)
    assert got == {r["doc_id"]: r["taken"] for r in mixing.mix_sources(df).collect()}


def test_memory_keeps_what_was_used():
    m = packing.Memory(4)
    m.young.update(a=1, b=2, c=3)
    m.full()
    assert not m.young and m.recall("a") == 1 and m.young == {"a": 1} and m.recall("z") is None
    m.young.update(d=4, e=5)
    m.full()
    assert m.recall("a") == 1 and m.recall("b") is None
