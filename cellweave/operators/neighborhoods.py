"""Minimal neighbourhood combinations, their frequencies and graph, projection and clustering."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.spatial import nearest_windows
from cellweave.runtime import materialize


def minimal_combination(counts: Column, limit: Column | float) -> Column:
    """Ascending indices of the shortest prefix of descending counts whose sum exceeds ``limit``.

    Equal counts go by index. If even all counts do not exceed it, the single
    greatest one.
    """
    order = F.array_sort(F.transform(counts, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    flags = F.transform(F.sequence(F.lit(1), F.size(order)), lambda n: F.aggregate(F.slice(order, 1, n), F.lit(0).cast("long"), lambda s, e: s - e["v"]) > limit)
    length = F.greatest(F.lit(1), F.array_position(flags, True).cast("int"))
    return F.array_sort(F.transform(F.slice(order, 1, length), lambda e: e["i"]))


def combinations(windows: DataFrame, labels: Sequence[str], k: int, threshold: float) -> DataFrame:
    """Add ``combination``: label numbers that make up more than ``threshold`` of a window of k."""
    counts = F.array(*[F.col(c).cast("long") for c in labels])
    return windows.withColumn("combination", minimal_combination(counts, threshold * k))


def combination_names(column: str, labels: Sequence[str]) -> Column:
    """Label names of a combination."""
    names = F.array(*[F.lit(c) for c in labels])
    return F.transform(F.col(column), lambda i: F.element_at(names, i.cast("int") + 1))


def combination_frequencies(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``combination, n, freq, cum_freq, marginal`` by descending frequency; ties by combination.

    The running total goes over distinct combinations, already aggregated.
    """
    key = F.array_join(F.col("combination"), ",")
    counts = df.groupBy(*by, key.alias("combination")).agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = part.orderBy(F.desc("n"), "combination")
    freq = counts.withColumn("freq", F.col("n") / F.sum("n").over(part))
    cum = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(part)
    out = freq.withColumn("cum_freq", cum)
    return out.withColumn("marginal", F.col("cum_freq") - F.coalesce(F.lag("cum_freq").over(order), F.lit(0.0)))


def share_at(frequencies: DataFrame, kept: float) -> DataFrame:
    """First combination at which the running share passes ``kept``, and its marginal share."""
    return frequencies.where(F.col("cum_freq") > kept).orderBy("cum_freq").limit(1).select("combination", "cum_freq", "marginal")


def combination_graph(frequencies: DataFrame, least: float = 0.001) -> DataFrame:
    """``src, dst``: frequent combinations and their frequent supersets with one label more.

    An equi-join: each combination is matched with itself less each of its labels.
    """
    nodes = frequencies.where(F.col("freq") >= least).select("combination", F.split("combination", ",").alias("items"))
    smaller = nodes.where(F.size("items") > 1).select(F.col("combination").alias("dst"), F.posexplode("items").alias("p", "item"), "items")
    smaller = smaller.select("dst", F.array_join(F.array_remove(F.col("items"), F.col("item")), ",").alias("src"))
    return smaller.join(nodes.select(F.col("combination").alias("src")), "src").select("src", "dst")


def top_combinations(frequencies: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent combinations."""
    return frequencies.orderBy(F.desc("n"), "combination").limit(n)


def in_degrees(edges: DataFrame) -> DataFrame:
    """Number of edges into each node that has any."""
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))


def combinations_by_donor(df: DataFrame, donor: str, donors: Sequence[str], least_donors: int = 3) -> DataFrame:
    """Combination by donor table of frequencies (0 where absent), combinations of enough donors only."""
    freq = combination_frequencies(df, [donor])
    wide = freq.groupBy("combination").agg(*[F.max(F.when(F.col(donor) == d, F.col("freq")).otherwise(0.0)).alias(d) for d in donors])
    present = sum((F.when(F.col(d) > 0, 1).otherwise(0) for d in donors), F.lit(0))
    return wide.where(present >= least_donors)


def combination_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by.., size, n, share``: how many labels combinations have."""
    sizes = df.groupBy(*by, F.size("combination").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def barycentric(windows: DataFrame, labels: Sequence[str], min_count: float) -> DataFrame:
    """Rows whose counts of three labels sum to over ``min_count``, with ``px, py`` inside the unit triangle."""
    a, b, c = (F.col(v).cast("double") for v in labels)
    total = a + b + c
    kept = windows.where(total > min_count)
    px = (b * math.cos(math.pi / 3) + c) / total
    return kept.withColumn("px", px).withColumn("py", b * math.sin(math.pi / 3) / total)


def cluster_windows(windows: DataFrame, labels: Sequence[str], n: int, seed: int = 0, out: str = "cn"):
    """Neighbourhood clusters by k-means. Returns the labelled windows and the centres ``(cluster, label, value)``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    spark = windows.sparkSession
    data = VectorAssembler(inputCols=list(labels), outputCol="__features").transform(windows)
    model = KMeans(k=n, seed=seed, featuresCol="__features", predictionCol=out).fit(data)
    rows = [(i, lab, float(v)) for i, c in enumerate(model.clusterCenters()) for lab, v in zip(labels, c, strict=True)]
    return model.transform(data).drop("__features"), spark.createDataFrame(rows, f"{out} int, label string, value double")


def elbow(windows: DataFrame, labels: Sequence[str], ks: Sequence[int], seed: int = 0) -> DataFrame:
    """``k, cost`` of k-means for each number of clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(labels), outputCol="__features").transform(windows).select("__features").persist()
    try:
        rows = [(k, float(KMeans(k=k, seed=seed, featuresCol="__features").fit(data).summary.trainingCost)) for k in ks]
    finally:
        data.unpersist()
    return windows.sparkSession.createDataFrame(rows, "k int, cost double")


def combination_map(
    cells: DataFrame, label: str, labels: Sequence[str], k: int = 75, threshold: float = 0.85, kept: float = 0.85, least: float = 0.001,
    region: str = "region", cell_id: str = "cell_id", x: str = "x", y: str = "y",
) -> dict[str, DataFrame]:
    """The whole way from labelled cells to the map of their neighbourhoods.

    ``windows`` of the k nearest other cells, ``combinations`` that make up more than
    ``threshold`` of each, their ``frequencies``, the ``edges`` between frequent ones, the
    ``top`` ones up to the first whose running share passes ``kept``, and that
    ``share``. Cells of a region with fewer than k others use all of them.
    """
    windows = nearest_windows(cells, k, label, list(labels), region, cell_id, x, y, include_self=False)
    found = combinations(windows, labels, k, threshold)
    frequencies = materialize(combination_frequencies(found), "frequencies")
    share = share_at(frequencies, kept)
    top = frequencies.where(F.col("cum_freq") - F.col("marginal") <= kept)
    return {"windows": windows, "combinations": found, "frequencies": frequencies, "edges": combination_graph(frequencies, least), "top": top, "share": share}
