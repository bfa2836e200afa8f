"""Filtering, normalisation and noise removal of marker tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalars import clip, phi, ratio
from cellweave.operators.ranking import exact_quantiles


def filter_cells(df: DataFrame, nuclear: str, size: str, nuclear_over: float = 1, size_over: float = 1) -> DataFrame:
    """Cells with a nuclear signal and a size over the limits.

    For a negative size limit a cell without nuclear signal counts as size 0, and so
    stays; nulls never stay.
    """
    if size_over >= 0:
        return df.where((F.col(nuclear) > nuclear_over) & (F.col(size) > size_over))
    return df.where((F.col(nuclear) > nuclear_over).cast("int") * F.col(size) > size_over)


def _stats(df: DataFrame, by: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates beside each row: a one-row (or small keyed) table is joined, rows are not sorted."""
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in aggs.items()])))
    stats = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, list(by))


def _project(df: DataFrame, made: dict[str, Column], columns: Sequence[str]) -> DataFrame:
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


def zscore(df: DataFrame, markers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population deviation of each marker; null for a constant marker."""
    aggs = {f"__m_{m}": F.avg(m) for m in markers} | {f"__s_{m}": F.stddev_pop(m) for m in markers}
    wide = _stats(df, by, aggs)
    return _project(wide, {m: ratio(F.col(m) - F.col(f"__m_{m}"), F.col(f"__s_{m}")) for m in markers}, df.columns)


def row_zscore(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Each row's markers less their mean, over their population deviation."""
    n = len(markers)
    mean = sum((F.col(m) for m in markers[1:]), F.col(markers[0])) / n
    var = sum(((F.col(m) - F.col("__mean")) * (F.col(m) - F.col("__mean")) for m in markers), F.lit(0.0)) / n
    wide = df.withColumn("__mean", mean).withColumn("__std", F.sqrt(var))
    return _project(wide, {m: ratio(F.col(m) - F.col("__mean"), F.col("__std")) for m in markers}, df.columns)


def double_zscore(df: DataFrame, markers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Column z-score, row z-score, then -ln(1 - normal probability); null where that probability is 1."""
    z = row_zscore(zscore(df, markers, by), markers)
    return _project(z, {m: -F.ln(1 - phi(F.col(m))) for m in markers}, df.columns)


def minmax(df: DataFrame, markers: Sequence[str], by: Sequence[str] = (), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to the exact low and high quantiles (linear interpolation) and scale to [0, 1].

    Quantiles of the whole table are found by narrowing, so no task holds a marker's
    values; those of groups are aggregated, so a group's different values meet in a task.
    """
    if by:
        wide = _stats(df, by, {f"__q_{m}": F.percentile(m, F.array(F.lit(low), F.lit(high))) for m in markers})
        bounds = {m: (F.col(f"__q_{m}")[0], F.col(f"__q_{m}")[1]) for m in markers}
    else:
        found = exact_quantiles(df, markers, (low, high))
        wide, bounds = df, {m: tuple(F.lit(q).cast("double") for q in found[m]) for m in markers}
    scaled = {m: ratio(clip(F.col(m), a, b) - a, b - a) for m, (a, b) in bounds.items()}
    return _project(wide, scaled, df.columns)


def arcsinh(df: DataFrame, markers: Sequence[str], cofactor: float = 150) -> DataFrame:
    """asinh(x / cofactor)."""
    return _project(df, {m: F.asinh(F.col(m) / cofactor) for m in markers}, df.columns)


METHODS = {"zscore": zscore, "double_zscore": double_zscore, "MinMax": minmax, "ArcSin": lambda df, markers, by=(): arcsinh(df, markers)}


def normalise(df: DataFrame, dropped: Sequence[str], kept: Sequence[str], method: str = "zscore", by: Sequence[str] = ()) -> DataFrame:
    """Drop columns (and any named "blank"), transform the markers and put the kept columns behind them."""
    names = [c for c in df.columns if c not in dropped and "blank" not in c]
    markers = [c for c in names if c not in kept]
    return METHODS[method](df.select(*names), markers, by=by).select(*markers, *[c for c in names if c in kept])


def log2_share(df: DataFrame, markers: Sequence[str], pseudo: float = 1e-3) -> DataFrame:
    """log2(pseudo + share of the row's sum); a zero row counts as share 0."""
    total = sum((F.col(m) for m in markers[1:]), F.col(markers[0]))
    return _project(df, {m: F.log2(F.lit(pseudo) + F.coalesce(ratio(F.col(m), total), F.lit(0.0))) for m in markers}, df.columns)


def group_zscore(df: DataFrame, by: str, markers: Sequence[str], low: float = -7, high: float = 7) -> DataFrame:
    """Z-score with the sample deviation inside each group, clipped; rows with null or infinite markers go."""
    finite = df.where(" and ".join(f"`{m}` is not null and abs(`{m}`) < double('infinity')" for m in markers))
    aggs = {f"__m_{m}": F.avg(m) for m in markers} | {f"__s_{m}": F.stddev_samp(m) for m in markers}
    wide = _stats(finite, [by], aggs)
    return _project(wide, {m: clip(ratio(F.col(m) - F.col(f"__m_{m}"), F.col(f"__s_{m}")), low, high) for m in markers}, df.columns)


def noise_scores(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Add ``marker_count`` (markers >= 0) and ``z_sum``; nulls are skipped."""
    count = sum((F.when(F.col(m) >= 0, 1).otherwise(0) for m in markers), F.lit(0))
    total = sum((F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in markers), F.lit(0.0))
    return df.withColumn("marker_count", count).withColumn("z_sum", total)


def remove_noise(df: DataFrame, markers: Sequence[str], z_sum_over: float, count_over: int) -> tuple[DataFrame, DataFrame]:
    """Clean cells with the input's columns, and noisy cells with their scores."""
    scored = noise_scores(df, markers)
    noisy = (F.col("z_sum") > z_sum_over) | (F.col("marker_count") > count_over)
    return scored.where(~noisy).select(*df.columns), scored.where(noisy)


def noise_thresholds(df: DataFrame, markers: Sequence[str], cut_off: float = 0.01) -> DataFrame:
    """Exact 1 - cut_off quantiles of both scores: suggested limits for remove_noise."""
    found = exact_quantiles(noise_scores(df, markers), ["marker_count", "z_sum"], (1 - cut_off,))
    return df.sparkSession.createDataFrame([(found["marker_count"][0], found["z_sum"][0])], "count_limit double, z_sum_limit double")


def score_histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n`` of equal-width bins; values outside fall to bins 0 and bins + 1."""
    return df.groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def tile_offsets(df: DataFrame, region: str, order: str, rows: int, columns: int, x: str, y: str, x_size: float, y_size: float) -> DataFrame:
    """Add ``x_corr, y_corr``: regions laid out row by row, in order of first appearance."""
    firsts = df.groupBy(region).agg(F.min(order).alias("__first"))
    if firsts.count() > rows * columns:
        raise ValueError("more regions than tiles")
    place = firsts.select(region, (F.row_number().over(Window.orderBy("__first", region)) - 1).alias("__n"))
    wide = df.join(F.broadcast(place), region)  # rows * columns rows at most, checked above
    return wide.select(
        *df.columns,
        (F.col(x) + (F.col("__n") % columns) * x_size).alias("x_corr"),
        (F.col(y) + F.floor(F.col("__n") / columns) * y_size).alias("y_corr"),
    )


def numbered_tile_offsets(df: DataFrame, number: str, columns: int, x: str, y: str, x_size: float, y_size: float) -> DataFrame:
    """Like tile_offsets, for regions that carry their 1-based number."""
    n = F.col(number) - 1
    return df.withColumn("x_corr", F.col(x) + (n % columns) * x_size).withColumn("y_corr", F.col(y) + F.floor(n / columns) * y_size)


def bounding_boxes(df: DataFrame, by: str, x: str, y: str, factor: int = 1, padding: int = 0, width: int | None = None, height: int | None = None) -> DataFrame:
    """Box of each group, scaled and padded, within the image where its size is given."""
    box = df.groupBy(by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    top = lambda c, limit: F.least(c, F.lit(limit)) if limit is not None else c
    return box.select(
        by,
        F.greatest(F.col("x0") * factor - padding, F.lit(0)).alias("x_min"),
        top(F.col("x1") * factor + padding, width).alias("x_max"),
        F.greatest(F.col("y0") * factor - padding, F.lit(0)).alias("y_min"),
        top(F.col("y1") * factor + padding, height).alias("y_max"),
    )


def origin_shift(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Coordinates moved so that each group begins at 0."""
    wide = _stats(df, [by], {"__x": F.min(x), "__y": F.min(y)})
    return _project(wide, {x: F.col(x) - F.col("__x"), y: F.col(y) - F.col("__y")}, df.columns)


def row_ranks(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Replace each marker by its 0-based rank inside the row; ties by column order."""
    pairs = F.array(*[F.struct(F.col(m).cast("double").alias("v"), F.lit(i).alias("i")) for i, m in enumerate(markers)])
    wide = df.withColumn("__order", F.transform(F.array_sort(pairs), lambda p: p["i"]))
    return _project(wide, {m: (F.array_position("__order", i) - 1) for i, m in enumerate(markers)}, df.columns)
