"""Reply trees and exact search against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import chat, topk

MESSAGES = "tree_id long, message_id long, parent_id long, role string, text string, score double, `up` string, turns string"


def walk(messages):
    by = {}
    for t, m, p, role, text, score, *_ in messages:
        if m is not None:
            key = (p is not None, p or 0, role or "", text or "")
            if (t, m) not in by or key < by[t, m][0]:
                by[t, m] = (key, p, role, text, score or 0.0)
    parents = {(t, v[1]) for (t, _), v in by.items() if (t, v[1]) in by}
    out = {}
    for t, m in by:
        if (t, m) in parents:
            continue
        path, at, seen = [], m, set()
        while at not in seen:
            seen.add(at)
            path.append(at)
            p = by[t, at][1]
            if (t, p) not in by:
                out[t, m] = [by[t, x][2:] for x in reversed(path)]
                break
            at = p
    return out


def test_paths_and_round_trip(spark):
    r = random.Random(1)
    bits = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[\\INST]", "<\\/s>", "[TURN x] ", "] ", "é", "\n", "", " ", "[", "<", "[SYS", "/SYS]"]
    messages = []
    for t in (1, 2, None):
        for m in range(1, 40):
            text = None if m % 13 == 0 else "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
            messages.append((t, m, r.randint(1, m - 1) if m > 2 else (99 if m == 2 else None), r.choice(["user", "assistant", "system", "to]ol\\ [INST]", None]), text, r.random(), "", ""))
    messages += [(7, 1, 2, "user", "cycle", 1.0, "", ""), (7, 2, 1, "user", "cycle", 1.0, "", ""), (7, 3, 2, "user", "below", 1.0, "", ""), (7, None, 1, "user", "x", 1.0, "", "")]
    df = spark.createDataFrame(messages, MESSAGES)
    done = chat.format_trees(df, branches=None).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    want = walk(messages)
    assert {(x["tree_id"], x["leaf_id"]) for x in done} == set(want) and len(done) == len(want)
    for x in done:
        path = want[x["tree_id"], x["leaf_id"]]
        assert [(b["role"], b["text"]) for b in x["back"]] == [(a or "", b or "") for a, b, _ in path]
        assert abs(x["branch_score"] - sum(s for *_, s in path) / len(path)) < 1e-9
        said = ["".join(x["formatted"][s["start"] : s["end"]]) for s in x["loss_mask"]]
        assert len(said) == sum(a == "assistant" for a, *_ in path)
    best = {x["tree_id"]: x["leaf_id"] for x in chat.format_trees(df, branches=1).collect()}
    for t in (1, 2, None):
        own = [x for x in done if x["tree_id"] == t]
        assert best[t] == min(own, key=lambda x: (-x["branch_score"], x["leaf_id"]))["leaf_id"]
    assert chat.format_trees(df.limit(0)).count() == 0


def test_long_conversation_keeps_repeated_turns(spark):
    turns = spark.createDataFrame([(5, i // 2, "user", "same") for i in range(300)] + [(6, None, None, None)], "conv_id long, turn long, role string, text string")
    out = {x["tree_id"]: x for x in chat.format_trees(chat.turns_as_tree(turns)).withColumn("n", F.size(chat.read_back(F.col("formatted")))).collect()}
    assert out[5]["n"] == 300 and out[6]["n"] == 1


def brute(rows, k, every, scale=64):
    import math

    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, v, strict=True)))), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
            out.update((i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k]))
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "STEP", 2)
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) * (10 if i % 7 == 0 else 1) for _ in range(6)]) for i in range(120)]
    rows += [(40, [0.0] * 6), (40, [0.0] * 6), (41, None), (42, []), (43, [1.0, None] * 3), (44, [float("nan")] * 6), (46, [float("inf")] * 6), (None, [1.0] * 6), (500, [1.0, 2.0]), (501, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("dim", F.lit(1))
    got = Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(df, query_every=5, k=7).collect())
    assert got == brute(rows, 7, 5)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, -3.0]), (1, [2e30, 1.0]), (2, [-1e30, 1.0]), (5, [1e7, 1e7]), (7, [3e7, 1e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(df, query_every=5, k=9).collect())
    assert got == brute(rows, 9, 5)


def test_blocks_are_not_copied_for_every_pair(spark, monkeypatch):
    """The rows that meet in cells are a few copies of each block, narrow, and results do not depend on the cells."""
    monkeypatch.setattr(topk, "BLOCK", 8)
    r = random.Random(6)
    rows = [(i, [r.uniform(-0.9, 0.9) for _ in range(20)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 6, 4)
    for held, cells in ((1 << 21, 1), (200, 1), (1 << 21, 50)):
        monkeypatch.setattr(topk, "HELD", held)
        monkeypatch.setattr(topk, "CELLS", cells)
        out = topk.top_k(df, query_every=4, k=6)
        assert Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in out.collect()) == want
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    kind, body = topk._packed(np.array([[1.0, -64.0], [3.0, 63.0]]))
    assert kind == "<i1" and len(body) == 4 and topk._columns(2, kind, body).tolist() == [[1.0, -64.0], [3.0, 63.0]]
    assert [topk._packed(np.array([[x]]))[0] for x in (200.0, 1e5, 1e12)] == ["<i2", "<i4", "<f8"]


def test_bound_is_carried_to_the_next_block():
    asked = topk._Asked(0, [0], [0], np.array([[1.0], [0.0]] * 16), 2)
    asked.meet(1, np.array([5, 6, 7]), np.tile([[9.0, 8.0, 1.0], [0.0, 0.0, 0.0]], (16, 1)))
    assert asked.floors[0] == 128.0 and asked.best[0][0].tolist() == [5, 6]
    asked.meet(2, np.array([3, 4]), np.tile([[8.0, 2.0], [0.0, 0.0]], (16, 1)))
    assert asked.best[0][0].tolist() == [5, 3] and not list(topk.best_in_block(asked.columns, np.tile([[2.0], [0.0]], (16, 1)), np.array([9]), np.array([-1]), 2, asked.floors))[0][1].size
