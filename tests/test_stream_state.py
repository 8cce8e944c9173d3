"""State in shelves: few state calls, and small parts of buckets."""

import json
import random

import pandas as pd

from tidemark.streaming import pools as X


class Map:
    def __init__(self):
        self.rows, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value


class Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


COLUMNS = ["pool", "seq", "id", "slot", "availability_ns", "wallet", "kind", "instruction", "base_raw", "quote_raw"]


def processor(window=4, ttl=None):
    p = X.PoolFeatures(window, (1, 3), ttl)
    p.pool, p.wallets, p.events = Value(), Map(), Map()
    return p


def run(p, rows):
    return [r for f in p.handleInputRows((1,), iter([pd.DataFrame(rows, columns=COLUMNS)]), None) for r in f.astype(object).where(f.notna(), None).to_dict("records")]


def swaps(n, start=0):
    r = random.Random(start)
    return [(1, i, f"e{i}", i, i * 400_000_000, f"w{r.randint(0, 5)}", "swap", r.choice(["buy", "sell"]), r.randint(1, 9), r.randint(1, 99)) for i in range(start, start + n)]


def test_a_pool_asks_for_shelves_not_for_ids():
    p = processor()
    assert len([x for x in run(p, swaps(500)) if x["entry"] == "feature"]) == 500
    assert p.events.calls + p.wallets.calls <= 4
    assert run(p, swaps(500)) == []
    p = processor()
    whole = run(p, swaps(3000))
    parts = processor()
    pieces = [x for k in range(0, 3000, 137) for x in run(parts, swaps(3000)[k : k + 137])]
    assert pieces == whole
    for state in (p, parts):
        shelves = [len(ids) for ids, _ in state.events.rows.values()]
        assert sum(shelves) == 3000 and len(shelves) > 8 and json.loads(state.pool.value[0])["events"] == [3000, 16]
    assert run(parts, [(*swaps(3000)[7][:9], 5000)])[0]["entry"] == "identity_conflict"


def test_features_are_sums_over_the_last_swaps():
    rows = swaps(60)
    for n, x in enumerate(x for x in run(processor(), rows) if x["entry"] == "feature"):
        last = rows[max(0, n - 3) : n + 1]
        mid = len(last) // 2
        assert x["volume_quote_raw"] == sum(r[9] for r in last) and x["half_window_volume_change_raw"] == sum(r[9] for r in last[mid:]) - sum(r[9] for r in last[:mid])
        assert x["swaps_observed"] == len(last) and x["buy_count"] == sum(r[7] == "buy" for r in last) and x["wallets_unique"] == len({r[5] for r in last})
        assert x["new_wallet"] == (rows[n][5] not in {r[5] for r in rows[:n]})


def test_with_a_time_to_live_ids_are_entries_of_their_own():
    p = processor(ttl=1000)
    run(p, swaps(20))
    assert len(p.events.rows) == 20 and all(ids == [key[0][1:]] for key, (ids, _) in p.events.rows.items())
    assert run(p, swaps(20)) == []
    del p.events.rows[("=e19",)]
    assert len(run(p, swaps(20))) == 1


def test_a_call_sees_a_part_of_a_bucket(spark):
    rows = spark.range(2000).selectExpr("concat('i', id) as id", "'h' as hash", "id as ord")
    plan = X.stream_known_ids(rows, buckets=2)._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan and "part" in plan
