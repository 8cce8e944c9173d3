"""Line dedup, vector codes and target resampling against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import codes, lines, queries, resampling

SCHEMA = "doc_id long, text string, key string, n_lines string, label string, rank string, __at int, slice int"
COMMON = "This line stands in many documents, word for word"
NARROW = "Zeile mit Umlauten äöü, die in genau fünf Dokumenten steht"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def padded(rows):
    return [(*r, "k", "n", "l", "r", 1, 2) for r in rows]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = []
    for i in range(40):
        own = [f"own line {i} {j} " + "x" * r.randint(0, 60) for j in range(4)]
        if i % 2:
            own.insert(2, ["  ", "\t", "", "\x0b"][i % 4] + (COMMON if i % 3 else COMMON.upper()) + "\r")
        if i in (3, 8, 13, 18, 23):
            own += [NARROW, NARROW]
        if i in (4, 9, 14, 19):
            own.append("only four documents hold this line of over forty letters")
        if i < 30:
            own.append("short line everywhere")
        out.append((i, "\n".join(own)))
    long = "\n".join([COMMON, *[f"line {j} of a very long document that goes on and on" for j in range(30_000)], COMMON])
    more = [(100, None), (101, ""), (102, "\n\n"), (103, long), (None, COMMON + "\nwithout id"), (7, "other row of id 7\n" + COMMON), (104, "ı" * 39), (105, "é" * 40)]
    same = [(200 + i, "é" * 40 + "\n" + "ü" * 39) for i in range(6)]
    return [*out, *more, *same, out[5], out[5]]


def brute_lines(rows, least=40, documents=5):
    keys = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = lower(x.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= least:
                keys.setdefault(k, set()).add(i)
    keeper = {k: max(i for i in v if i is not None) for k, v in keys.items() if len(v) >= documents}
    out = Counter()
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if keeper.get(lower(x.strip(" \t\n\x0b\x0c\r")), i) == i]
        out[i, len(all_), len(all_) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines(spark, texts):
    docs = spark.createDataFrame(padded(texts), SCHEMA).repartition(5)
    got = Counter(tuple(r) for r in lines.drop_common_lines(docs).collect())
    want = brute_lines(texts)
    assert got == want
    assert sum(n for (_, _, dropped, _), n in want.items() if dropped) > 20


def test_lines_small_filter(spark, texts):
    """A filter of 8,192 bits takes many lines for repeated; the exact count leaves the same result."""
    docs = spark.createDataFrame(padded(texts), SCHEMA).repartition(3)
    seen, bits = lines.repeat_filter(docs, "text", 40, most_bytes=1 << 10)
    assert bits == 1 << 13
    full, many = lines.repeat_filter(docs, "text", 40)
    assert many > bits
    named = [{tuple(r) for r in lines.suspects(docs, "doc_id", "text", 40, s, b).collect()} for s, b in ((seen, bits), (full, many))]
    assert named[1] < named[0]
    repeated = Counter(k for t in texts for k in lines.keys_of((t[1] or "").encode(), 40))
    sure = {lines._digests([k]).astype(">u8").tobytes() for k, n in repeated.items() if n > 1}
    assert sure <= {bytes(k) for _, k in named[1]}


def test_lines_empty(spark):
    got = lines.drop_common_lines(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"] and got.collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, x string, error string, code string"


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = []
    for i, v, label in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(scale * float(np.float32(c))) for c in v], label))
    first = min(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    kept = sorted((k for k in kept if len(k[1]) == len(first[1])), key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    w = len(first[1]) // parts
    cut = [[k[1][p * w : (p + 1) * w] for k in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def assign(p):
        out = []
        for x in cut[p]:
            d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        for p in range(parts):
            at = [a for _, a in assign(p)]
            books[p] = [
                [sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [x for x, a in zip(cut[p], at, strict=True) if a == e]) else old
                for e, old in enumerate(books[p])
            ]
    final = [assign(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    errors = [sum(f[i][0] for f in final) for i in range(len(kept))]
    by_label = Counter()
    for k, e in zip(kept, errors, strict=True):
        by_label[k[2]] += e
    return Counter((k[0], "".join(f"{f[i][1]:02x}" for f in final), errors[i], by_label[k[2]], digest) for i, k in enumerate(kept))


@pytest.mark.parametrize("n", [0, 3, 600])
def test_codes(spark, n):
    r = random.Random(n)
    rows = [(i * 3 % 1001, [r.choice([r.gauss(0, 1), 0.25, -0.25, 1 / 1024]) for _ in range(8)], [None, 1, 1, 2][i % 4]) for i in range(n)]
    if n:
        rows += [(5000, None, 1), (5001, [None] * 8, 1), (5002, [float("nan")] * 8, 1), (5003, [float("inf")] * 8, 2), (5004, [], 1), (5005, [1.0] * 4, 1)]
        rows += [rows[0], rows[0], (None, [0.5] * 8, None), (rows[1][0], [0.125] * 8, 7)]
    df = spark.createDataFrame([(*x, "x", "e", "c") for x in rows], VECTORS).repartition(4)
    got = Counter(tuple(x) for x in codes.compress(df).collect())
    assert got == (brute_codes(rows) if n else Counter())


def test_codes_no_parts(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "", "", "")], VECTORS)
    assert codes.compress(df).collect() == []


def test_bounds_prune_without_loss():
    r = np.random.default_rng(1)
    centres = r.integers(-2000, 2000, (256, 16))
    x = centres[r.integers(0, 256, 3000)] + r.integers(-40, 40, (3000, 16))
    pivots = codes.spread_pivots(centres)
    far = [np.sqrt(codes._distances(a, pivots).astype(float)) for a in (x, centres)]
    at, best, done = codes.nearest(x, far[0], centres, far[1])
    d = codes._distances(x, centres)
    assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert done < 0.25 * d.size


def test_far_vectors_stop(spark):
    df = spark.createDataFrame([(1, [3e38] * 8, 1, "", "", "")], VECTORS)
    with pytest.raises(Exception, match="too large for exact distances"):
        codes.compress(df).collect()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, n=1, buckets=10_000, least=20):
    s, t = Counter(), Counter()
    for into, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            into.update(zlib.crc32(f.encode()) % buckets for f in features(x, n))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        f = features(x, n)
        weight = sum(gain[zlib.crc32(y.encode()) % buckets] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    order = sorted((k for k in range(len(rows)) if rows[k][4]), key=lambda k: (-rows[k][3], rows[k][0] is not None, rows[k][0] or 0))
    rank = {k: j + 1 for j, k in enumerate(order[: 10 * len(order) // 100])}
    return Counter((*r[:4], rank.get(k)) for k, r in enumerate(rows))


@pytest.mark.parametrize("n", [1, 2])
def test_resampling(spark, n):
    r = random.Random(n)
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "日本", "Ünï"]
    docs = [(i * 7, " ".join(r.choices(vocabulary, k=r.randint(5, 80)))) for i in range(300)]
    docs += [(9000, None), (9001, ""), (9002, "..."), (9003, " ".join(r.choices(vocabulary, k=40_000))), (None, docs[1][1]), (None, docs[3][1])]
    docs += [docs[0]] * 60  # rows equal in score and id
    target = [" ".join(r.choices(vocabulary[:40], k=50)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(padded(docs), SCHEMA).repartition(6)
    found = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n)
    assert Counter(tuple(x) for x in found.collect()) == brute_resample(docs, target, n)


def test_ranks_of_regular_samples(spark):
    """Many segments, very unequal runs and one value for half of the rows."""
    r = random.Random(3)
    rows = [(5 if i % 2 else r.randint(-1000, 1000), r.randint(0, 50)) for i in range(4000)] + [(None, 1), (None, None)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7, "a")
    got = resampling.ranked(df, ["a", "b"], segment_rows=20).collect()
    first = [(x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0) for x in sorted(got, key=lambda x: x["rank"])]
    assert [x["rank"] for x in sorted(got, key=lambda x: x["rank"])] == list(range(1, len(rows) + 1))
    assert first == sorted(first)


def test_resampling_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([("some words",)], "text string")
    assert resampling.resample(none, target).collect() == []
    one = spark.createDataFrame(padded([(1, "word " * 30)]), SCHEMA)
    assert [tuple(x)[:3] for x in resampling.resample(one, target.limit(0)).collect()] == [(1, 30, math.floor(1000 * math.log(10030 / 31 / 10000)))]


def test_queries_read_the_given_tables(spark, tmp_path, texts):
    docs = [(i, t) for i, t in texts if i is not None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "own line of very many documents")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    vectors = [(i, [float(i % 13), float(i % 7), 1.0, 0.5], i % 3) for i in range(300)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(tuple(x) for x in queries.op11_line_dedup(spark, str(tmp_path)).collect())
    want = Counter()
    for (i, n, d, kept), c in brute_lines(docs).items():
        want[i, n, d, hashlib.sha256(kept.encode()).hexdigest()] += c
    assert got == want
    assert Counter(tuple(x) for x in queries.op12_vector_codes(spark, str(tmp_path)).collect()) == brute_codes(vectors)
    assert Counter(tuple(x) for x in queries.op13_target_resampling(spark, str(tmp_path)).collect()) == brute_resample(docs, ["own line of very many documents"])
