"""Intents of a hot account are not cut, and known ids are looked up by shelves."""

from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators import ordered
from tidemark.operators.ordered import Split, measured
from tidemark.streaming import pools as X


def ledger(spark):
    s = spark.range(400)
    intents = s.selectExpr("id % 2 as account", "id * 2 as seq", "concat('i', id) as id", "'intent' as kind", "cast(null as string) as intent_id",
                           "if(id % 4 < 2, 'BUY', 'SELL') as side", "concat('m', id % 2) as mint", "cast(null as bigint) as base_units", "cast(null as bigint) as quote_spent", "cast(null as bigint) as quote_received")
    settled = s.where("id % 7 <> 3").selectExpr(
        "id % 2 as account", "id * 2 + 1 as seq", "concat('x', id) as id", "'settlement' as kind", "concat('i', id) as intent_id", "if(id % 4 < 2, 'BUY', 'SELL') as side",
        "concat('m', id % 2) as mint", "10 as base_units", "if(id % 4 < 2, id + 5, null) as quote_spent", "if(id % 4 < 2, null, id + 9) as quote_received")
    return intents.unionByName(settled)


def test_rows_of_an_intent_are_not_cut(spark, monkeypatch):
    rows = ledger(spark)
    want = sorted(map(str, L.ledger_rows(rows, 1000).collect()))
    cuts = []
    init = ordered.Ordered.__init__

    def seen(self, *args, **kwargs):
        init(self, *args, **kwargs)
        cuts.append((tuple(self.keys), self.cut))

    monkeypatch.setattr(ordered.Ordered, "__init__", seen)
    assert sorted(map(str, L.ledger_rows(rows, 1000, split=Split(20)).collect())) == want
    # the assets hold half of the rows each and are cut, the intents are not
    assert cuts == [(("account", "__i"), False), (("account", "mint"), True), (("account",), True)]
    monkeypatch.setattr(ordered, "BUCKETS", 4)
    assert sorted(map(str, L.ledger_rows(rows, 1000, split=Split(20)).collect())) == want


def test_counting_in_buckets_finds_the_hot_keys(spark, monkeypatch):
    df = spark.range(1000).selectExpr("if(id < 600, -1, id) as k", "id as o")
    hot = {h[0] for h in measured(df, ["k"], "o", Split(50)).hot}
    assert hot == {-1} == {h[0] for h in measured(df, ["k"], "o", Split(50), many=True).hot}
    monkeypatch.setattr(ordered, "BUCKETS", 2)
    assert hot == {h[0] for h in measured(df, ["k"], "o", Split(50), many=True).hot}
    assert measured(df.where("k >= 0"), ["k"], "o", Split(50), many=True).hot == ()


class Shelf:
    def __init__(self):
        self.rows, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value


def test_a_batch_asks_once_for_a_shelf():
    import pandas as pd

    known = X.KnownIds()
    known.known = Shelf()

    def batch(rows):
        return [tuple(r) for f in known.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["bucket", "shelf", "id", "content", "ord"])]), None) for r in f.itertuples(index=False)]

    first = batch([(0, i % 3, f"i{i}", "a", i) for i in range(300)] + [(0, 0, None, "a", 1), (0, 0, "i0", "b", 900), (0, 0, "i0", "a", 901)])
    assert first.count(("i0", "b", "conflict")) == 1 and sum(a == "new" for *_, a in first) == 300
    assert known.known.calls == 6
    assert batch([(0, 1, "i1", "a", 5), (0, 1, "i4", "c", 6), (0, 1, "n", "z", 7)]) == [("i4", "c", "conflict"), ("n", "z", "new")]
    assert batch([(0, 1, "n", "z", 8)]) == []
