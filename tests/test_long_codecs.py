"""Long base58 texts and whole batches of events beside the plain forms."""

import random
import time

import numpy as np
import pandas as pd

from tidemark.functions import codecs
from tidemark.plans import nested


def test_long_texts_are_coded_as_one_by_one():
    r = random.Random(2)
    raws = [bytes(r.choice([0, 0, 1, 255]) if k < 3 else r.randrange(256) for k in range(n)) for n in (*range(60, 140), 453, 453, 700, 1024, 4096, 4100)] + [bytes(70), bytes(69) + b"\1", b"", None]
    texts = codecs.encode_batch(raws)
    assert texts == [None if x is None else codecs.to_base58(x) for x in raws]
    texts += ["1" * 120, "z" * 100, "0" * 100, "é" * 100, "2" * 16384, "2" * 16385, 5, None, "1" * 99 + "2"]
    assert codecs.decode_batch(texts) == [codecs.from_base58(t) for t in texts]


def test_events_are_packed_as_one_by_one():
    r = random.Random(3)
    rows = [(r.choice(["buy", "sell"]), r.randrange(1, 1 << 62), r.randrange(1, 1 << 62), nested.fixed_key(f"p{k % 7}") if k % 9 else None, nested.fixed_key(f"u{k}"), r.randrange(-5, 1 << 40)) for k in range(200)]
    got = nested.packed_event.func(*(pd.Series(list(x)) for x in zip(*rows)))
    assert got.tolist() == [nested._pack(*row) for row in rows]


def test_a_long_text_costs_little():
    r = np.random.default_rng(4)
    raws = [r.bytes(453) for _ in range(3000)]
    start = time.process_time()
    texts = codecs.encode_batch(raws)
    assert codecs.decode_batch(texts) == raws
    together = time.process_time() - start
    start = time.process_time()
    for x in raws[:300]:
        codecs.from_base58(codecs.to_base58.__wrapped__(x))
    assert together < 10 * (time.process_time() - start) / 2


def test_routed_calls_are_scanned_once(spark):
    from tidemark.operators import decode as D

    call = "struct(cast(0 as int) as programIdIndex, array(cast(0 as int)) as accounts, 'a' as data, cast(2 as int) as stackHeight)"
    tx = spark.range(1).selectExpr("id as slot", "'b' as blockhash", "0 as transaction_index", "'s' as signature", f"array('{nested.protocol.PROGRAM}', 'other') as keys",
                                   "array(struct(cast(1 as int) as programIdIndex, array(cast(0 as int)) as accounts, 'a' as data, cast(null as int) as stackHeight)) as instructions",
                                   f"array(struct(0 as index, array({call}) as instructions)) as inner", "'processed' as status")
    plan = D.routed_calls(tx)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
