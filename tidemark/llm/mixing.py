"""Mixing sources to target weights: weighted sampling without replacement by exponential keys, to word budgets.

Every document gets the key ``-ln(u) / weight`` (Efraimidis and Spirakis); a source is read in key order until its
budget of words is used. Budgets above the source's size first take complete epochs; the rest is selected by key.

Null and edge cases
* null text: size 0, taken 0; an empty table gives an empty result.
* null source: a source of its own, after all others in code-point order.
* a null or non-positive weight counts as the smallest weight (1e-6).
* repeated rows are rows like any other; equal keys are ordered by id and text hash, and rows equal in these
  are interchangeable.
* other columns of the input are not read; those named in ``carry`` are returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, unit, written

#: Rows of a source that one task may put in order: those of the cell of keys in which its budget ends.
CELL_ROWS = 4096
#: The same limit under its earlier name; the smaller of the two holds.
BUCKET_ROWS = 4096
#: A cell is cut into 2^CELL_BITS at a time, up to MOST_BITS in all; what is then still together has all but equal keys.
CELL_BITS, MOST_BITS = 10, 50


def word_count(text: str | Column) -> Column:
    """Number of words between ASCII white space, whole text."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def length_weight(text: str, size: Column) -> Column:
    """A quality weight from the mean word length: 1 at six characters, less the further away."""
    mean = F.char_length(F.coalesce(F.col(text), F.lit(""))) / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (1.0 + F.abs(mean - 6.0) / 6.0)


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Word targets for sources: ``share`` of all words by weight, none above ``most`` times its source's size.

    sizes: one row a source with source, source_size and docs. The excess of a capped source goes to the others by
    weight until none is above, which is the level L with sum(min(most * size, L * weight)) = share * total: sources are
    filled in the order of cap / weight, and the level is read off prefix sums. The table has one row a source, so its
    windows without a partition see as many rows as there are sources.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__k") % n + 1).cast("int"))
    every = Window.partitionBy()
    ranked = (
        sizes.withColumn("__k", F.row_number().over(order) - 1)
        .withColumn("weight", cycle)
        .withColumn("__cap", F.col("source_size") * float(most))
        .withColumn("__budget", F.sum("source_size").over(every) * float(share))
        .withColumn("__w", F.sum("weight").over(every))
    )
    fill = Window.orderBy(F.col("__cap") / F.col("weight"), "__k").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("__budget") - F.coalesce(F.sum("__cap").over(fill), F.lit(0.0))) / (F.col("__w") - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    found = ranked.withColumn("__level", level).withColumn("__fits", F.col("__level") * F.col("weight") <= F.col("__cap"))
    # the first source that stays below its cap gives the level of all after it
    final = F.min(F.when(F.col("__fits"), F.struct(F.col("__cap") / F.col("weight"), F.col("__k"), F.col("__level").alias("level")))).over(every)["level"]
    return found.withColumn("target", F.least("__cap", F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))).select(
        "source", "source_size", "docs", "weight", "target"
    )


def _cell(bits: int) -> Column:
    """Number of the cell of ``__x``; scaling by a power of two is exact, so cells of more bits lie inside those of fewer."""
    return F.floor(F.col("__x") * float(1 << bits)).cast("long")


def _edges(row: DataFrame, edge: DataFrame | None, bits: int) -> DataFrame:
    """One row a source: the cell in which its budget ends, words before it and rows in it; only the rows of the coarser cell are looked at."""
    if edge is None:
        inside = row.withColumn("__from", F.lit(0).cast("long"))
    else:
        last = edge.select(F.col("__edge_of").alias("__s"), F.col("__edge").alias("__last"), F.col("__before").alias("__from"))
        inside = row.join(last, F.col("__source").eqNullSafe(F.col("__s"))).where(_cell(bits) == F.col("__last"))
    sums = inside.groupBy("__source", _cell(bits + CELL_BITS).alias("__cell")).agg(
        F.sum("__size").alias("__words"), F.count(F.lit(1)).alias("__n"), F.first("__rest").alias("__r"), F.first("__from").alias("__f"))
    ahead = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__f") + F.coalesce(F.sum("__words").over(ahead), F.lit(0))
    found = sums.withColumn("__before", before).where((F.col("__before") < F.col("__r")) & (F.col("__before") + F.col("__words") >= F.col("__r")))
    return written(found.select(F.col("__source").alias("__edge_of"), F.col("__cell").alias("__edge"), "__before", "__n"), "mix-edges")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
                weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, cut: bool = True, carry=()) -> DataFrame:
    """One row per document: id, source, the columns of ``carry``, size, source_size, target and taken (words the mix takes).

    ``cut``: the document in which a budget ends gives the words that are left; otherwise it is taken whole or not at
    all, whichever comes nearer to the budget. No document exceeds ``most`` times its size.

    Texts are read once, into a written table of sizes and keys. Nothing is sorted by source as a whole: the range of keys is cut into
    cells, their word sums are prefix-summed, and the cell in which a budget ends is cut again until it holds at most ``CELL_ROWS`` rows,
    whatever the distribution of the weights. Only the rows of that cell are put in order. A hot source costs combinable sums and one small sort.
    """
    size = word_count(text)
    w = F.greatest(F.coalesce(weight if weight is not None else length_weight(text, F.col("__size")), F.lit(0.0)), F.lit(1e-6))
    slim = docs.withColumn("__size", size).select(
        F.col(id_col).alias("__id"), F.col(source).alias("__source"), "__size", w.alias("__weight"),
        unit(F.lit(seed), F.col(id_col), F.col(text)).alias("__u"), F.xxhash64(text).alias("__tie"),
        *[F.col(c).alias(f"__c_{i}") for i, c in enumerate(carry)],
    )
    keyed = written(slim.withColumn("__key", -F.log("__u") / F.col("__weight")), "mix-keys")
    totals = keyed.groupBy(F.col("__source").alias("source")).agg(
        F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("docs"), F.avg("__weight").alias("__mean")
    )
    means = totals.select(F.col("source").alias("__s"), "__mean")
    targets = source_targets(totals, weights, share, most).join(means, F.col("source").eqNullSafe(F.col("__s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    # written once: both uses below must see the very same figures
    targets = written(
        targets.select(F.col("source").alias("__of"), "source_size", "target", "__mean", epochs.alias("__epochs"),
                       (F.col("target") - epochs * F.col("source_size")).alias("__rest")),
        "mix-targets",
    )
    row = keyed.join(targets, F.col("__source").eqNullSafe(F.col("__of")))
    # mean weight times key is about exponential, so its distribution function spreads a source about evenly over (0, 1)
    row = row.withColumn("__x", 1.0 - F.exp(-F.col("__key") * F.col("__mean")))
    edge, bits = None, 0
    while bits < MOST_BITS and (edge is None or not edge.where(F.col("__n") > min(CELL_ROWS, BUCKET_ROWS)).isEmpty()):
        edge, bits = _edges(row, edge, bits), bits + CELL_BITS
    row = row.join(edge.drop("__n"), F.col("__source").eqNullSafe(F.col("__edge_of")), "left").withColumn("__cell", _cell(bits))
    at_edge = F.coalesce(F.col("__cell") == F.col("__edge"), F.lit(False))
    whole = F.when((F.col("__rest") > 0) & (F.col("__edge").isNull() | (F.col("__cell") < F.col("__edge"))), F.col("__size")).otherwise(F.lit(0))
    inside = Window.partitionBy("__source").orderBy("__key", "__id", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("__size").over(inside), F.lit(0))
    some = F.least(F.greatest(F.round(left), F.lit(0)), F.col("__size")) if cut else F.when(left >= F.col("__size") / 2, F.col("__size")).otherwise(F.lit(0))
    both = row.where(~at_edge).withColumn("__extra", whole.cast("double")).unionByName(row.where(at_edge).withColumn("__extra", some.cast("double")))
    return both.select(
        F.col("__id").alias(id_col), F.col("__source").alias(source), *[F.col(f"__c_{i}").alias(c) for i, c in enumerate(carry)],
        F.col("__size").alias("size"), "source_size", "target",
        (F.col("__epochs") * F.col("__size") + F.col("__extra")).cast("long").alias("taken"),
    )
