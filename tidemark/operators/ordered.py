"""Ordered per-key computation that survives a hot key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. So the row counts
per key are measured first (a map-side combined count over the key columns). Where no key has
more than ``Split.rows`` rows, that plain window is the plan. Otherwise each hot key is cut
into segments of about that many rows. The cuts are quantiles of the whole order tuple, taken from a
random sample of ``SAMPLES`` rows a segment, so neither a bursty axis nor a crowd of rows at one instant
makes a large segment; only rows equal in the whole order stay together. Windows run per (key, segment) and what
earlier segments know is carried over:

* ``running`` keeps prefix max / min / sum of any number of columns. Each segment is aggregated once
  for all of them (map-side combined), the per-segment results are scanned per key, and the prefixes are
  joined back at once.
* ``lookback`` copies the last rows of earlier segments in front of the next one, so
  row frames of bounded length see the same rows as without the cut; ``lookback_range``
  does the same for frames bounded on the order axis (its cuts are quantiles of the axis alone).

The rows of a cut plan are written once with their segments, and once more between two scans of which the later one needs
the earlier one's result, so the source is read by the plan once, as in the plain plan, however many scans are stacked. Where rows
that give the same sums can be read again as cheaply as files (``again``), they are read instead of writing.

Two tables are broadcast while there are at most ``HOT_KEYS`` hot keys with ``SEGMENTS`` segments: hot keys with
their cuts, and segment prefixes under the measured key; under a longer key the join is left to Spark. More
hot keys never reach the driver: they are a table, joined by shuffle, as are their cuts and prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

SEG, HOME, HOT = "__seg", "__home", "__hot"
#: Rows sampled for each segment, where segments are longer.
SAMPLES = 64
#: Hot keys, and segments of them, that the driver holds; beyond that they stay in tables.
HOT_KEYS, SEGMENTS = 10_000, 1_000_000
#: Buckets in which keys are counted first where they are too many to be combined.
BUCKETS = 1 << 18


@dataclass(frozen=True)
class Split:
    """Rows a key may have before it is cut; ``measured`` fills in which keys those are and where their later segments start.

    ``order`` has the columns of a start; each entry of ``hot`` ends with the starts of its key. Too many hot keys for that are a table, ``many``.
    """

    rows: int = 4_000_000
    keys: tuple[str, ...] | None = None
    order: tuple[str, ...] | None = None
    hot: tuple[tuple, ...] | None = None
    many: DataFrame | None = field(default=None, compare=False)

    @property
    def cuts(self) -> bool:
        return bool(self.hot) or self.many is not None


def measured(df: DataFrame, keys, order, split: Split = Split(), many: bool = False) -> Split:
    """The split with its hot keys found, to be shared by several scans over the same keys.

    ``order``: the columns that start a segment, the axis first. It may be used for any rows whose key includes ``keys``
    and whose order begins with such columns in about the same range; counting a superset of the rows is fine.
    ``many``: the keys are about as many as the rows, so they are counted in hash buckets, which combine, and one by one only in buckets
    that hold more rows than a key may have.
    """
    if split.hot is not None:
        return split
    order = (order,) if isinstance(order, str) else tuple(order)
    split = replace(split, keys=tuple(keys), order=order, hot=())
    counted = df
    if many:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
        full = [r[0] for r in df.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > split.rows).limit(1000).collect()]
        if not full:
            return split
        if len(full) < 1000:
            counted = df.where(bucket.isin(full))
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > split.rows)
    found = [tuple(r) for r in sizes.limit(HOT_KEYS + 1).collect()]
    if len(found) > HOT_KEYS or sum(r[-1] for r in found) // split.rows > SEGMENTS:
        return replace(split, many=cut_lineage(sizes.select(*keys)))
    hot = [r[:-1] for r in found]
    if not hot:
        return split
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    table = df.sparkSession.createDataFrame([(*k, True) for k in hot], T.StructType([*fields, T.StructField(HOT, T.BooleanType())]))
    starts = _starts(_attach(df.select(*keys, *[c for c in order if c not in keys]), table, keys).where(HOT), keys, order, split.rows)
    found: dict[tuple, list] = {k: [] for k in hot}
    for row in starts.collect():
        found[tuple(row)[: len(keys)]].append(tuple(row)[len(keys) :])
    return replace(split, hot=tuple((*k, tuple(_sorted(v))) for k, v in found.items()))


def _starts(hot: DataFrame, keys, order, rows: int) -> DataFrame:
    """Where segments of hot keys may start: quantiles of the order in a sample, under ``__o0``, ``__o1`` and so on."""
    rate = max(1, rows // SAMPLES)
    some = hot.where(F.rand(1) * rate < 1) if rate > 1 else hot
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return some.withColumn("__r", at).where(F.col("__r") % max(1, rows // rate) == 0).select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])


def _sorted(starts) -> list[tuple]:
    """Distinct starts in order, nulls first."""
    return sorted(set(starts), key=lambda s: [(x is not None, x) for x in s] if None in s else [(True, x) for x in s])


def _apart(starts, least: float) -> list[tuple]:
    """The starts without those closer than ``least`` to the one kept before."""
    kept: list[tuple] = []
    for x in starts:
        if not kept or x[0] - kept[-1][0] >= least:
            kept.append(x)
    return kept


def _steps(n: int) -> list[int]:
    """The powers of two up to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1)]


def _segment(x: Column) -> Column:
    """Number of starts in ``__starts`` that are not above the struct x, by halving: ``__steps`` has the powers of two up to their number."""
    return F.aggregate("__steps", F.lit(0), lambda n, step: F.when(F.get("__starts", n + step - 1) <= x, n + step).otherwise(n)).cast("bigint")


def _attach(left: DataFrame, right: DataFrame, cols, small: bool = True) -> DataFrame:
    """Left join on null-safe keys; ``small``: against a broadcast table of proven size."""
    renamed = right.select(*[F.col(c).alias(f"__k_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(renamed[f"__k_{c}"])
    return left.join(F.broadcast(renamed) if small else renamed, cond, "left").drop(*[f"__k_{c}" for c in cols])


class Ordered:
    """Rows of ``df`` grouped by ``keys`` and ordered by ``order`` (first entry numeric, non-null)."""

    def __init__(self, df: DataFrame, keys, order, split: Split = Split(), lookback: int = 0, lookback_range: int = 0, again: DataFrame | None = None):
        """``again``: for the first ``running``, rows with the same keys, order and sums that are as cheap to read as files; then ``df`` is not written."""
        self.keys, self.order = list(keys), list(order)
        split = measured(df, self.keys, self.order[:1] if lookback_range else self.order, split)
        self.cut = split.cuts
        if not self.cut:
            self.df = df
            return
        # prefixes are broadcast where the driver has counted the segments
        self.measured = set(split.keys) if split.many is None else None
        by = self.order[: 1 if lookback_range else len(split.order)]
        self._sums = None
        if split.many is not None:
            rows = self._placed_by_table(df, split, by, lookback_range)
        else:
            # with a range in view segments are wider than it, so a row is needed by at most one later segment
            table = []
            for *key, starts in split.hot:
                own = _sorted(s[: len(by)] for s in starts)
                own = _apart(own, 1 + lookback_range) if lookback_range else own
                table.append((*key, own, _steps(len(own))))
            one = T.StructType([T.StructField(c, df.schema[c].dataType) for c in by])
            fields = [T.StructField(k, df.schema[k].dataType) for k in split.keys]
            table = df.sparkSession.createDataFrame(table, T.StructType([*fields, T.StructField("__starts", T.ArrayType(one)), T.StructField("__steps", T.ArrayType(T.IntegerType()))]))

            def placed(some: DataFrame) -> DataFrame:
                some = _attach(some, table, list(split.keys))
                return self._placed(some.withColumn(HOT, F.col("__starts").isNotNull()), by, lookback_range)

            if again is not None and not lookback and not lookback_range:
                rows, self._sums = placed(df), placed(again)
            else:
                rows = cut_lineage(placed(df))
        if lookback:
            rows = rows.unionByName(cut_lineage(self._tails(rows, lookback)))
        self.df, self._ahead = rows, False

    @staticmethod
    def _placed(rows: DataFrame, by, lookback_range: int) -> DataFrame:
        """Rows with ``__starts`` (null: none) in their segments, and in the later segments that look back to them."""
        rows = rows.withColumn(SEG, F.when(F.col(HOT), F.coalesce(_segment(F.struct(*by)), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))).withColumn(HOME, F.lit(True))
        if lookback_range:
            kind = rows.schema[by[0]].dataType
            reach = F.coalesce(_segment(F.struct((F.col(by[0]) + lookback_range).cast(kind).alias(by[0]))), F.lit(0).cast("bigint"))
            rows = (
                rows.withColumn("__own", F.col(SEG))
                .withColumn(SEG, F.explode(F.sequence(F.col(SEG), F.when(F.col(HOT), reach).otherwise(F.col(SEG)))))
                .withColumn(HOME, F.col(SEG) == F.col("__own"))
                .drop("__own")
            )
        return rows.drop("__starts", "__steps")

    def _placed_by_table(self, df: DataFrame, split: Split, by, lookback_range: int) -> DataFrame:
        """Rows in their segments where hot keys are too many for the driver: keys and starts are joined, and only rows of hot keys are written again."""
        keys = list(split.keys)
        kept = _attach(df, split.many.withColumn(HOT, F.lit(True)), keys, small=False)
        kept = cut_lineage(kept.withColumn(HOT, F.coalesce(HOT, F.lit(False))))
        hot = kept.where(HOT)
        own = _starts(hot, keys, split.order, split.rows).select(*keys, F.struct(*[F.col(f"__o{i}").alias(c) for i, c in enumerate(by)]).alias("__s"))
        table = own.groupBy(*keys).agg(F.array_sort(F.collect_set("__s")).alias("__l"))
        if lookback_range:
            at, least = by[0], 1 + lookback_range
            table = table.withColumn("__l", F.aggregate("__l", F.filter("__l", lambda s: F.lit(False)), lambda done, s: F.when(
                (F.size(done) == 0) | (s[at] - F.element_at(done, -1)[at] >= least), F.concat(done, F.array(s))).otherwise(done)))
        steps = F.expr("transform(sequence(int(log2(size(__l))), 0), k -> shiftleft(1, k))")
        table = table.select(*keys, F.col("__l").alias("__starts"), steps.alias("__steps"))
        rows = cut_lineage(self._placed(_attach(hot, table, keys, small=False), by, lookback_range))
        rest = kept.where(~F.col(HOT)).withColumns({SEG: F.lit(0).cast("bigint"), HOME: F.lit(True)})
        return rows.unionByName(rest)

    def refine(self, *keys: str) -> "Ordered":
        """The same rows under a longer key: same segments, and no new shuffle."""
        out = object.__new__(Ordered)
        out.__dict__.update(self.__dict__)
        out.keys = [*self.keys, *keys]
        out.measured = self.measured if self.cut else set()
        return out

    def _tails(self, rows: DataFrame, n: int) -> DataFrame:
        """The last ``n`` rows before each later segment of a hot key, marked as copies."""
        data = [c for c in rows.columns if c not in (SEG, HOME, HOT)]
        desc = Window.partitionBy(*self.keys, SEG).orderBy(*[F.col(c).desc() for c in self.order])
        last = rows.where(HOT).withColumn("__r", F.row_number().over(desc)).where(F.col("__r") <= n)
        per_seg = last.groupBy(*self.keys, SEG).agg(
            F.array_sort(F.collect_list(F.struct(*self.order, *[c for c in data if c not in self.order]))).alias("__tail")
        )
        # only the segments whose tails reach into the last n rows in front, so at most 3 n rows meet
        ahead = F.sum(F.size("__tail").cast("bigint")).over(Window.partitionBy(*self.keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1))
        per_seg = per_seg.withColumn("__ahead", F.coalesce(ahead, F.lit(0).cast("bigint")))
        before = Window.partitionBy(*self.keys).orderBy("__ahead").rangeBetween(-2 * n, -1)
        prior = per_seg.withColumn("__prior", F.flatten(F.collect_list("__tail").over(before)))
        prior = prior.select(
            *[F.col(k).alias(f"__k_{k}") for k in self.keys],
            SEG,
            F.explode(F.slice("__prior", F.greatest(F.lit(1), F.size("__prior") - n + 1), F.lit(n))).alias("__row"),
        )
        return prior.select(
            *[F.col(f"__row.{c}").alias(c) for c in data],
            SEG,
            F.lit(False).alias(HOME),
            F.lit(True).alias(HOT),
        ).select(*rows.columns)

    def window(self, descending: bool = False, ties=()):
        by = [F.col(c).desc() if descending else F.col(c).asc() for c in [*self.order, *ties]]
        return Window.partitionBy(*self.keys, *([SEG] if self.cut else [])).orderBy(*by)

    def frame(self, n: int):
        """The current row and up to ``n - 1`` before it."""
        return self.window().rowsBetween(-(n - 1), 0)

    def running(self, descending: bool = False, inclusive: bool = True, **specs) -> "Ordered":
        """Add prefix aggregates; ``specs`` maps a name to ("max" | "min" | "sum", column)."""
        funcs = {"max": F.max, "min": F.min, "sum": F.sum}
        w = self.window(descending).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if not self.cut:
            self.df = self.df.select("*", *[funcs[fn](c).over(w).alias(name) for name, (fn, c) in specs.items()])
            return self
        if self._ahead:  # the rows are read twice below
            self.df = cut_lineage(self.df)
        self._ahead = True

        def valued(rows: DataFrame) -> DataFrame:
            # copies in front of a segment are already part of the carried sum
            return rows.select("*", *[(F.when(F.col(HOME), c) if fn == "sum" else c).alias(f"__v_{name}") for name, (fn, c) in specs.items()])

        df = valued(self.df)
        home = (df if self._sums is None else valued(self._sums)).where(F.col(HOT) & F.col(HOME))
        self._sums = None
        summary = home.groupBy(*self.keys, SEG).agg(
            *[funcs[fn](f"__v_{name}").alias(f"__s_{name}") for name, (fn, _) in specs.items()]
        )
        seg_order = F.col(SEG).desc() if descending else F.col(SEG).asc()
        earlier = Window.partitionBy(*self.keys).orderBy(seg_order).rowsBetween(Window.unboundedPreceding, -1)
        prior = summary.select(
            *self.keys,
            SEG,
            *[funcs[fn](f"__s_{name}").over(earlier).alias(f"__p_{name}") for name, (fn, _) in specs.items()],
        )
        for name, (fn, _) in specs.items():
            df = df.withColumn(f"__l_{name}", funcs[fn](f"__v_{name}").over(w))
        df = _attach(df, prior, [*self.keys, SEG], small=set(self.keys) == self.measured)
        for name, (fn, _) in specs.items():
            local, carried = F.col(f"__l_{name}"), F.when(F.col(HOME), F.col(f"__p_{name}"))
            if fn == "sum":
                value = F.when(carried.isNull(), local).otherwise(carried + F.coalesce(local, F.lit(0)))
            else:
                value = (F.greatest if fn == "max" else F.least)(local, carried)
            df = df.withColumn(name, value)
        self.df = df.drop(*[f"__{t}_{name}" for name in specs for t in "vlp"])
        return self

    def last_seen(self, name: str, value: Column, when: Column | None = None, inclusive: bool = False,
                  descending: bool = False) -> "Ordered":
        """Newest ``value`` before (or at) each row, taken from rows where ``when`` holds."""
        entry = F.struct(*[F.col(c) for c in self.order], value.alias("value"))
        entry = entry if when is None else F.when(when, entry)
        self.running(descending=descending, inclusive=inclusive, **{name: ("min" if descending else "max", entry)})
        self.df = self.df.withColumn(name, F.col(f"{name}.value"))
        return self

    def previous(self, ties=(), **cols: str) -> "Ordered":
        """Add columns of the row before, by new name; rows equal in the order stand by ``ties``, the first of ``cols``.

        On a plain window each column is looked up by itself, so one that is not used later is not carried.
        """
        if not self.cut:
            w = self.window(ties=ties)
            self.df = self.df.select("*", *[F.lag(c).over(w).alias(name) for name, c in cols.items()])
            return self
        self.last_seen("__before", F.struct(*[F.col(c).alias(name) for name, c in cols.items()]))
        self.df = self.df.withColumns({name: F.col("__before")[name] for name in cols}).drop("__before")
        return self

    def add(self, **cols: Column) -> "Ordered":
        self.df, self._ahead = self.df.withColumns(cols), True
        return self

    def result(self) -> DataFrame:
        return self.df.where(HOME).drop(SEG, HOME, HOT) if self.cut else self.df
