"""Needles of all lengths in random texts, beside ``in``."""

from random import Random

import pyarrow as pa
import pytest

from tidemark.functions import search
from tidemark.functions.search import Needles
from tidemark.operators import validate


@pytest.mark.parametrize("chunk", [7, 64, 1 << 19])
def test_needles_of_all_lengths(monkeypatch, chunk):
    monkeypatch.setattr(search, "CHUNK", chunk)
    r = Random(3)
    texts = [None if i % 17 == 5 else "".join(r.choice("abé") for _ in range(r.randint(0, 90))) for i in range(200)]
    needles = {"".join(r.choice("abé") for _ in range(r.randint(4, 40))) for _ in range(60)} | {t[k : k + n] for t in texts if t for k in range(0, len(t), 31) for n in (4, 9, 33) if len(t) >= k + n and k % 3 == 0}
    known = Needles.of(pa.array(sorted(needles)))
    assert len({n for some in known.lengths.values() for n in some}) > 20
    column = pa.array([None, "left out"] + texts)[2:]
    for some in (needles, {"abab", "é" * 40}):
        got = set()
        for rows, at, n, data in Needles.of(pa.array(sorted(some))).found(column):
            for row, p in zip(rows, at):
                piece = data[p : p + n].tobytes().decode()
                assert piece in some and piece in texts[row]
                got.add((int(row), piece))
        assert got == {(i, x) for i, t in enumerate(texts) if t for x in some if x in t}


def test_pieces_of_bodies_are_not_shuffled(spark):
    """The rows that are dealt out are hits, not pieces of all bodies, whether the secrets are few or many."""
    r = Random(4)
    bodies = [(i, "".join(r.choice("abcdefgh ") for _ in range(400))) for i in range(60)]
    secrets = [(b[40 : 40 + 5 + i % 30],) for i, b in bodies[::7]] + [(f"never {i}",) for i in range(40)]
    df, s = spark.createDataFrame(bodies, "id int, text string"), spark.createDataFrame(secrets, "secret string")
    want = {i: any(x in b for x, in secrets) for i, b in bodies}
    assert 0 < sum(want.values()) < 60
    for limit in (1 << 30, 0):
        out = validate.secret_echo_join(df, s, most_bytes=limit)
        assert {x["id"]: x["secret_echo"] for x in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan
