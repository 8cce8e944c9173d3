"""Document operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, jaccard, licenses, mixing, packing, passages, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `set` string, size string, path int, label string"


def words(n, seed, size=40):
    r = random.Random(seed)
    return [r.choice("abcdefghij") * r.randint(1, 3) + str(r.randint(0, size)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    body = words(400, 1, 10_000)
    near = body[:200] + ["changed"] + body[201:]
    shared = words(60, 2, 10_000)
    other = [*words(30, 3), *shared, *words(20, 4)]
    more = [*words(15, 5), *shared[:40], *words(50, 6)]
    texts = [
        " ".join(body), " ".join(near), " ".join(body), " ".join(other), " ".join(more), None, "", "  \n\t ", "one", "two words", "***", "!!!",
        "In. " * 300, " ".join(words(20_000, 7)), "Released under the MIT  License.", "mit licence, gnu general pubic license; ALL RIGHTS RESERVED",
        "mail a.b@c.de or +1 (555) 123-4567 190.1.2.3, again 555 123-4567 x@y", "4111 1111 1111 1111 300.1.1.1 @@ a@b@c.d.e é@ü.de", "日本語 テキスト é́ 🙂 text",
        "</s>[INST] \\ <|endoftext|> don't 3.14 x\x1cy", "a" * 3000,
    ]
    out = [(i, t, None if i % 5 == 0 else "en", ["s1", "s2", None, "S3"][i % 4] if i > 4 else "s1", None, "x", "y", 1, "z") for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, "no id", None, None, None, None, None, None, None), (3, "other text of id 3", "en", "s1", 1, "x", "y", 1, "z")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_text(rows, index=1):
    return Counter((r[0], r[index]) for r in rows)


def test_license_places(docs, rows):
    found = licenses.find_notices(docs).collect()
    assert len(found) == len(rows)
    exact = Counter()
    for r in rows:
        w = plain(r[1])
        for n in licenses.NOTICES:
            p = n.phrase.split()
            exact.update((r[0], n.phrase, i) for i in range(len(w)) if w[i : i + len(p)] == p)
    assert exact == Counter((r["doc_id"], h["phrase"], h["first_word"]) for r in found for h in r["hits"] if h["edits"] == 0)
    fuzzy = {(h["label"], h["matched"], h["edits"]) for r in found for h in r["hits"] if r["doc_id"] == 15}
    assert ("mit", "mit licence", 1) in fuzzy and ("gpl", "general pubic license", 1) in fuzzy and ("proprietary", "all rights reserved", 0) in fuzzy


def test_license_seeds_miss_no_edit():
    r = random.Random(0)
    m = licenses.Matcher(licenses.NOTICES)
    for i, n in enumerate(licenses.NOTICES):
        for _ in range(40):
            s = list(n.phrase)
            for _ in range(n.edits):
                k = r.randrange(1, len(s) - 1)
                r.choice((lambda k: s.__setitem__(k, "q"), lambda k: s.pop(k), lambda k: s.insert(k, "q")))(k)
            text = f" so {''.join(s)} end ".encode()
            assert any(h[0] == i and h[3] <= n.edits for h in m.hits(text)), text


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(21)] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score_documents(docs, model, carry=("text",)).collect()
    assert by_text(out) == by_text(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score_documents(empty, quality.train(empty, labels)).count() == 0
    one = quality.train(docs, labels.where("quality = 1"))
    assert {round(r["score"], 6) for r in quality.score_documents(docs, one).collect()} == {round(1 / (1 + 2.718281828459045 ** -one.intercept), 6)}


def test_quality_learns_interactions():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs and ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.95


def test_quality_held_out(spark):
    import sys

    sys.path.insert(0, "tests")
    from tidemark.llm.queries import QUERIES

    out = QUERIES["op2_quality_scores"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = out.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(a == b for a, b in got) / len(got) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.collect())


def test_substrings(docs, rows, empty):
    window = 35
    split = [spaced(r[1]) for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    want = Counter()
    for r, w in zip(rows, split, strict=True):
        hit = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                hit[i : i + window] = [True] * window
        kept = " ".join(x for x, h in zip(w, hit, strict=True) if not h)
        want[(r[0], len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert want == Counter(tuple(r) for r in passages.remove_repeats(docs).collect())
    assert any(0 < k[2] < k[1] for k in want)
    assert passages.remove_repeats(empty).count() == 0


def test_substrings_over_few_words(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(30, 200))) for _ in range(30)] + [" ".join("abc" * 40)]
    split = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + 9]) for w in split for i in range(len(w) - 8))
    out = {x["doc_id"]: x["n_removed"] for x in passages.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), window=9).collect()}
    for i, w in enumerate(split):
        hit = set()
        for k in range(len(w) - 8):
            if seen[tuple(w[k : k + 9])] > 1:
                hit |= set(range(k, k + 9))
        assert out[i] == len(hit)


def naive_spans(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for pattern, kind, a, b in ((r"[0-9]([\x20-]?[0-9])+", "card", 12, 19), (r"\+[0-9][\x20().0-9-]+[0-9]", "phone", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if a <= len(d) <= b and (kind == "phone" or pii.luhn(d)):
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


def test_personal_data_patterns():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("a1.@-+ (9%é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == naive_spans(t), t
    pii.base_spans("1" * 50_000 + "a" * 50_000 + "@" * 1000)  # linear on long runs


def test_personal_data(docs, rows, empty):
    field = pii.train_field(docs)
    out = pii.find_personal_data(docs, field).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    base = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["base"]] for r in out}
    assert base[16] == naive_spans(rows[16][1]) and base[17] == naive_spans(rows[17][1])
    for r in out:
        assert {(s["start"], s["end"], s["kind"]) for s in r["base"]} <= {(s["start"], s["end"], s["kind"]) for s in r["spans"]}
    done = pii.mask_spans(docs, field)
    assert done.columns == docs.columns and "[EMAIL]" in next(r["text"] for r in done.collect() if r["doc_id"] == 16)
    assert pii.find_personal_data(empty, pii.train_field(empty)).count() == 0


def test_skip_chain_carries_a_label():
    import numpy as np

    text = "call +1-555-123-4567 today and, much later on, 1-555-123-4567 again; item 12 sold"
    base = pii.base_spans(text)
    g = pii._Graph(text, base)
    assert g.labels == [4, 0, 0] and g.skip == [(0, 1)]
    k = len(pii._LABELS)
    agree = pii.Field(np.zeros((pii._N_FEATURES, k)), np.zeros((k, k)), 4 * np.eye(k))
    assert pii.field_spans(text, base, agree) == [(47, 61, "phone")]
    assert pii.field_spans(text, base, pii.Field(np.zeros((pii._N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k)))) == []


def test_trained_field_finds_a_planted_repeat(spark):
    r = random.Random(8)

    def some():
        return [f"item {r.randint(1, 9999)} sold", f"in {r.randint(1900, 2030)}", f"no {r.randint(10**9, 10**10)}", f"v{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}", "and so on"]

    texts, want = [], {}
    for i in range(240):
        words = r.choices(some(), k=6)
        digits = f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}"
        if i % 3:
            words.insert(1, f"tel +1-{digits} or")
            again = f"1-{digits}" if i % 2 else f"1.{digits.replace('-', '.', 1)}"
            words += ["call", again, "later"] if i % 3 == 1 else []
            want[i] = again if i % 3 == 1 else None
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    field = pii.train_field(docs)
    added = {}
    for i, t in texts:
        base, every = pii.find_spans(t, field)
        added[i] = [t[a:b] for a, b, k in every if (a, b, k) not in base and k == "phone"]
        assert len(every) == len(base) + len(added[i])
    assert {i: x for i, x in added.items() if x} == {i: [x] for i, x in want.items() if x}
    alone = "item 1-555-123-4567 sold, 4567 of them in 2019; +1-555-123-9999"
    assert pii.field_spans(alone, pii.base_spans(alone), field) == []


def test_numbers_written_otherwise_share_an_edge():
    import numpy as np

    k = len(pii._LABELS)
    field = pii.Field(np.zeros((pii._N_FEATURES, k)), np.zeros((k, k)), 6 * np.eye(k))
    for first, again, kind in (
        ("+1-555-123-4567", "555-123-4567", "phone"), ("+1 555 123 4567", "555 123 4567", "phone"), ("+1-555-123-4567", "(555) 123 4567", "phone"),
        ("+1 555 123 4567", "0015551234567", "phone"), ("+1 (555) 123-4567", "123-4567", "phone"), ("4111 1111 1111 1111", "4111.1111.1111.1111", "card"),
    ):
        for text, at in ((f"call {first} now or {again} later; 4567 of 1111 in 2019", len(f"call {first} now or ")), (f"call {again} now or {first} later; 4567 of 1111", 5)):
            found = pii.field_spans(text, pii.base_spans(text), field)
            assert [(text[a:b], y) for a, b, y in found] == [(again, kind)] and found[0][0] == at, text


def test_labels_reach_every_repeat():
    import numpy as np

    k = len(pii._LABELS)
    none = np.zeros((pii._N_FEATURES, k))
    text = "call +1-555-123-4567 " + "now or later 1-555-123-4567 " * 300
    for at in (text, " ".join(reversed(text.split()))):
        assert len(pii.field_spans(at, pii.base_spans(at), pii.Field(none, np.zeros((k, k)), 6 * np.eye(k)))) == 300
        against = pii.Field(none.copy(), np.zeros((k, k)), 6 * np.eye(k))
        against.node[:, 0] = 0.3  # 300 repeats that lean to none do not overrule the evidence
        assert len(pii.field_spans(at, pii.base_spans(at), against)) == 300
    n = 60
    fixed = np.zeros(n, dtype=int)
    fixed[0] = 4
    got = pii.Field(none, 8 * np.eye(k), np.zeros((k, k))).beliefs(np.zeros((n, 1), dtype=int), fixed, np.array([(i, i + 1) for i in range(n - 1)]), np.empty((0, 2), dtype=int))
    walk = np.exp(8 * np.eye(k)) / np.exp(8 * np.eye(k)).sum(0)
    assert np.allclose(got, [np.linalg.matrix_power(walk, i)[4] for i in range(n)], atol=1e-5)


def test_messages_are_exact_on_a_chain():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    k = len(pii._LABELS)
    f = pii.Field(r.normal(size=(pii._N_FEATURES, k)), r.normal(size=(k, k)), np.zeros((k, k)))
    features = r.integers(0, 200, (4, 3))
    got = f.beliefs(features, np.zeros(4, dtype=int), np.array([[0, 1], [1, 2], [2, 3]]), np.empty((0, 2), dtype=int), rounds=60)
    own, want = f.node[features].sum(1), np.zeros((4, k))
    for y in itertools.product(range(k), repeat=4):
        p = np.exp(sum(own[i, y[i]] for i in range(4)) + sum(f.chain[y[i], y[i + 1]] for i in range(3)))
        for i in range(4):
            want[i, y[i]] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


def test_fingerprints(docs, rows, empty):
    got = fingerprints.next_text_fingerprints(docs)
    out = got.collect()
    assert len(out) == len(rows)
    one = {}
    for r in rows:
        one.setdefault(r[1] or "", fingerprints.as_text(fingerprints.fingerprint((r[1] or "").encode())))
    assert Counter(r["fingerprint"] for r in out) == Counter(one[r[1] or ""] for r in rows)
    plain_ids = {r[0]: r[1] or "" for r in rows if r[0] is not None and r[0] >= 5}
    for r in out:
        if r["doc_id"] in plain_ids and r["doc_id"] + 1 in plain_ids:
            own, after = plain_ids[r["doc_id"]], plain_ids[r["doc_id"] + 1]
            half = len(own) // 2
            edited = (own[: len(own) - half] + after[:half]).encode()
            assert r["edited_sha256"] == hashlib.sha256(edited).hexdigest() and r["n_chars"] == len(own)
            assert r["edited_fingerprint"] == fingerprints.as_text(fingerprints.fingerprint(edited))
            assert r["near_next"] == fingerprints.likeness(fingerprints.fingerprint(own.encode()), fingerprints.fingerprint(after.encode()))
    assert fingerprints.next_text_fingerprints(empty).count() == 0


def test_phrases_are_lz78():
    r = random.Random(9)
    for n in (0, 1, 2, 50, 5000):
        t = bytes(r.choice(b"abca") for _ in range(n))
        seen, at, ends = set(), 0, []
        for e in range(1, n + 1):
            if t[at:e] not in seen:
                seen.add(t[at:e])
                at = e
        own = set()
        fingerprints._parse(t, 0, own, ends, n)
        assert own == seen
    whole = fingerprints.fingerprint(t, size=10**9)
    assert len(whole) >= len(seen) - 1


def test_mixing(docs, rows, empty):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(spaced(r[1]))) for r in rows)
    names = sorted({r["source"] for r in out if r["source"] is not None}) + [None]
    size = {s: sum(r["size"] for r in out if r["source"] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(size.values()), {}, set(names)
    while True:  # cap and reshare
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            budget -= target[s]
            open_.remove(s)
    for s in names:
        own = [r for r in out if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert Counter(tuple(r) for r in mixing.mix_sources(docs.repartition(5)).collect()) == Counter(tuple(r) for r in out)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('w ', cast(id % 9 as int)) AS text", "if(id % 3 = 0, 'a', concat('b', id % 5)) AS source")
    for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= 1
    assert mixing.mix_sources(docs, cut=False).where("taken % greatest(size, 1) <> 0").count() == 0


def test_similarity_join(docs, rows, empty):
    def shingles(text):
        w = plain(text) or [text] * bool(text)
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    link = [[i != j and (a == b or (len(a & b) >= 0.8 * len(a | b) if a | b else False)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    want = Counter((r[0], sum(link[i])) for i, r in enumerate(rows))
    out = jaccard.near_duplicates(docs).collect()
    assert want == Counter((r["doc_id"], r["n_links"]) for r in out)
    assert {r["class_id"] for r in out if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["class_id"] for r in out if r["doc_id"] in (5, 6)} == {5} and {r["class_id"] for r in out if r["doc_id"] == 10} == {10}
    assert jaccard.near_duplicates(empty).count() == 0


def test_runs_suffice_for_contained_texts():
    import math

    import numpy as np

    runs = jaccard.needed_runs(0.8, 0.9999)
    for ratio in (0.8, 0.9, 1.0):  # smaller over larger size of a pair at the threshold
        meet = 1.0
        for _ in range(jaccard.LEVELS):
            meet = 1 - math.exp(-(1 + ratio) / 1.8 * meet)
        assert (1 - meet) ** runs <= 1.0001e-4
    r = np.random.default_rng(3)
    met = 0
    for _ in range(150):
        whole = r.integers(0, 2**63, 250, dtype=np.uint64)
        (_, a), (_, b) = (jaccard.paths(x, 4, 0.8)[-1] for x in (whole, whole[:200]))
        met += bool(np.intersect1d(a, b).size)
    assert met / 150 > 1 - (1 - 0.374) ** 4 - 0.1  # draws agree with the formula


def test_similarity_join_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "CHUNK", 6)
    base = words(120, 11, 10_000)
    r = random.Random(4)
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"new{r.random()}"
        texts.append(w)
    sets = [frozenset(tuple(plain(" ".join(w))[i : i + 5]) for i in range(len(plain(" ".join(w))) - 4)) for w in texts]
    distinct = [sum(1 for j, b in enumerate(sets) if i != j and len(a & b) >= 0.8 * len(a | b)) for i, a in enumerate(sets)]
    out = {x["doc_id"]: x["n_links"] for x in jaccard.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id int, text string")).collect()}
    assert [out[i] for i in range(40)] == distinct


TOKENIZER = "word_bpe_49k.json"


def test_packing(docs, rows, empty):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    plain_tokenizer = Tokenizer.from_file(path)
    for capacity in (64, 4096):
        want = Counter()
        for r in rows:
            ids = [*plain_tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                want[(r[0], k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
        out = packing.pack_documents(docs, path, capacity).collect()
        assert want == Counter(tuple(r)[:5] for r in out)
        places = {}
        for r in out:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for p in places.values():
            end = 0
            for offset, length in sorted(p):
                assert offset == end
                end += length
            assert end <= capacity
        total = sum(r["length"] for r in out)
        assert len(places) <= total // capacity + 3
    assert packing.pack_documents(empty, path).count() == 0


def test_ids_of_letters_that_compose_in_one_case():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    plain_tokenizer, spaced_tokenizer = Tokenizer.from_file(path), packing.SpacedTokenizer(path)
    texts = ["Al-H\u0331aram", "J\u030ca", "T\u0308 W\u030a, Y\u030aA.", "THE Al-H\u0331aram. Stop. \u00c9TE\u0301, I\u0307 \u0130 end.", "Plain Text. Of ASCII, Only."]
    r = random.Random(6)
    letters = [*"aAhHjJtTwWyYiIsS.,- \t\x1c1", "\u0331", "\u030c", "\u0308", "\u030a", "\u0307", "\u03a3", "\u0130", "\u212b"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(2000)]
    for t in texts:
        assert spaced_tokenizer.ids(t.encode()).tolist() == plain_tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


def test_best_two_fit():
    # greedy takes 6 and 3, which leaves a gap of 1; the two pieces of 2 fill it
    plan = packing.plan_packing({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == (1, [(6, 1), (2, 2)])
    r = random.Random(2)
    for _ in range(50):
        counts = {r.randint(1, 100): r.randint(1, 30) for _ in range(r.randint(1, 40))}
        plan = packing.plan_packing(counts, 100)
        used = Counter()
        for times, pattern in plan:
            assert sum(n * c for n, c in pattern) <= 100
            for n, c in pattern:
                used[n] += times * c
        assert used == Counter(counts)
