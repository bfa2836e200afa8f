"""Running totals and exact quantiles that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.runtime import materialize

#: Pieces into which a group is cut for running totals and cuts looked up at a time, values of a quantile's surroundings that are sorted in one task.
PIECES, STEP, SORTED = 64, 8, 100_000


def running_before(df: DataFrame, by: Sequence[str], order: str, amount: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows of the group that stand before a row in ``order``.

    Values of ``order`` are distinct in a group and not null; rows with a null key go.
    Numbers are cut (below), other orders are not.
    Groups are cut at approximate quantiles into pieces, so a group of any size spreads
    over tasks: totals of pieces, few a group, are added to the totals inside a piece.
    """
    keys = list(by)
    if not isinstance(df.schema[order].dataType, T.NumericType):  # no approximate quantiles of strings: groups stay whole
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)))
    shares = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, shares, 1000).alias("__cuts"))
    # Written, as sketches depend on the order in which they are merged: totals of pieces and totals inside them must see the same cuts.
    cuts = materialize(cuts, "cuts").withColumn("__coarse", F.filter("__cuts", lambda c, i: i % STEP == STEP - 1))
    # Looked up in two steps: every STEP-th cut first, then the STEP after those that lie below.
    below = lambda found: F.size(F.filter(found, lambda c: c < F.col(order)))
    placed = df.join(cuts, keys).withColumn("__passed", below("__coarse") * STEP)
    placed = placed.withColumn("__piece", F.col("__passed") + below(F.slice("__cuts", F.col("__passed") + 1, F.lit(STEP)))).drop("__cuts", "__coarse", "__passed")
    sums = placed.groupBy(*keys, "__piece").agg(F.sum(amount).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__piece", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("__offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return placed.join(offsets, [*keys, "__piece"]).withColumn(out, total).drop("__piece", "__offset")


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of each column with linear interpolation, nulls left out; null for a column without values.

    One sketch a column bounds the order statistics of all its shares; one pass counts what lies
    between the bounds. Where that is more than SORTED different values the pair of passes is
    repeated inside the bounds; the rest is brought together and sorted in one job.
    """
    found: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    numbers = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    value = lambda c: F.col(c).cast("double")
    within = lambda c, low, high: value(c).isNotNull() & ((value(c) >= low) & (value(c) <= high) if low is not None else F.lit(True))
    # Column and share, with the bounds of its values, how many are below them and how many between.
    open_ = {(c, i): (None, None, 0, numbers[c]) for c in columns for i in range(len(shares)) if numbers[c]}
    small = {}
    while open_:
        small |= {k: open_.pop(k) for k in list(open_) if open_[k][3] <= SORTED}
        ranges = list(dict.fromkeys((c, low, high) for (c, _), (low, high, *_) in open_.items()))
        if not ranges:
            break
        # A thousand cuts: the next bounds hold a few thousandths of the values at most.
        cut = F.array(*[F.lit(k / 1000) for k in range(1001)])
        row = df.agg(*[F.percentile_approx(F.when(within(*r), value(r[0])), cut, 10_000).alias(f"r{k}") for k, r in enumerate(ranges)]).first()
        cuts_of = {r: row[f"r{k}"] for k, r in enumerate(ranges)}
        for (c, i), (low, high, below, count) in list(open_.items()):
            cuts, place = cuts_of[c, low, high], shares[i] * (numbers[c] - 1)
            if cuts[0] == cuts[-1]:
                found[c][i] = cuts[0]
                del open_[c, i]
                continue
            # Ranks of approximate cuts err by a ten-thousandth: three cuts either side hold both order statistics.
            lo = max(0, int((int(place) - below) / count * 1000) - 3)
            hi = min(1000, int((min(numbers[c] - 1, int(place) + 1) - below) / count * 1000) + 4)
            open_[c, i] = (cuts[lo], cuts[hi], below, count)
        if open_:
            keys = list(open_)
            counts = [e for k, (c, i) in enumerate(keys) for e in (F.count(F.when(value(c) < open_[c, i][0], 1)).alias(f"b{k}"), F.count(F.when(within(c, *open_[c, i][:2]), 1)).alias(f"n{k}"))]
            row = df.agg(*counts).first()
            open_ = {key: (*open_[key][:2], row[f"b{k}"], row[f"n{k}"]) for k, key in enumerate(keys)}
    if small:
        ranges = list(dict.fromkeys((c, low, high) for (c, _), (low, high, *_) in small.items()))
        held = F.array(*[F.when(within(*r), F.struct(F.lit(k).alias("k"), value(r[0]).alias("v"))) for k, r in enumerate(ranges)])
        rows = df.select(F.explode(F.filter(held, lambda x: x.isNotNull())).alias("x")).select("x.k", "x.v").toArrow()
        which, values = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        sorted_ = {r: np.sort(values[which == k]) for k, r in enumerate(ranges)}
        for (c, i), (low, high, below, _) in small.items():
            place = shares[i] * (numbers[c] - 1)
            a, b = (float(sorted_[c, low, high][r - below]) for r in (int(place), min(numbers[c] - 1, int(place) + 1)))
            found[c][i] = a + (b - a) * (place - int(place))
    return found
