"""Shares, tables, enrichment and correlation of categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.scalars import ratio


def share(df: DataFrame, by: Sequence[str], category: str, scale: float = 100.0) -> DataFrame:
    """``by.., category, n, share`` of each category present in each group."""
    counts = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", scale * F.col("n") / total)


def densified_share(df: DataFrame, by: Sequence[str], category: str, within: Sequence | None = None, norm: bool = True) -> DataFrame:
    """Percent of each category in each group, 0 where a category is absent.

    With ``within`` only these categories count: ``norm`` takes them as the whole,
    otherwise all rows are the whole. Only categories that occur are listed.
    """
    base = df.where(F.col(category).isin(list(within))) if within is not None and norm else df
    counts = base.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    categories = counts.select(category).distinct()
    if within is not None:
        categories = categories.where(F.col(category).isin(list(within)))
    grid = totals.crossJoin(categories)  # groups x categories, both already aggregated
    full = grid.join(counts, [*by, category], "left")
    return full.select(*by, category, (100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("percent"))


def wide_table(df: DataFrame, by: str, category: str, values: Sequence[str], percent: bool = False) -> DataFrame:
    """One row a group, one column a category (given in order): counts, or percents of the row."""
    counts = [F.sum(F.when(F.col(category) == v, 1).otherwise(0)).alias(str(v)) for v in values]
    out = df.groupBy(by).agg(*counts)
    if not percent:
        return out
    total = reduce(lambda a, b: a + b, [F.col(str(v)) for v in values])
    return out.select(by, *[ratio(100.0 * F.col(str(v)), total).alias(str(v)) for v in values])


def distinct_per_group(df: DataFrame, by: str, what: str) -> DataFrame:
    """Exact number of distinct values in each group."""
    return df.groupBy(by).agg(F.countDistinct(what).alias("n_distinct"))


def shannon(df: DataFrame, by: Sequence[str], category: str) -> DataFrame:
    """Shannon diversity (natural log) of each group."""
    p = share(df, by, category, 1.0)
    return p.groupBy(*by).agg((-F.sum(F.col("share") * F.ln("share"))).alias("shannon"))


def enrichment(df: DataFrame, group: str, category: str, scale: float = 10.0) -> DataFrame:
    """log2(((c + avg) / sum(c + avg)) / avg) of each category in each group.

    c is the group's share times ``scale`` (0 where absent), avg the category's share
    in all rows.
    """
    dense = densified_share(df, [group], category).select(group, category, (F.col("percent") / 100.0 * scale).alias("c"))
    overall = share(df, [], category, 1.0).select(category, F.col("share").alias("avg"))
    both = dense.join(overall, category).withColumn("v", F.col("c") + F.col("avg"))
    total = F.sum("v").over(Window.partitionBy(group))
    return both.select(group, category, F.log2(F.col("v") / total / F.col("avg")).alias("enrichment"))


def centroid_enrichment(centroids: DataFrame, group: str, category: str, value: str, average: DataFrame) -> DataFrame:
    """The same for given centroid values (no scale) and a table ``category, avg``."""
    both = centroids.join(average, category).withColumn("v", F.col(value) + F.col("avg"))
    total = F.sum("v").over(Window.partitionBy(group))
    return both.select(group, category, F.log2(ratio(F.col("v") / total, F.col("avg"))).alias("enrichment"))


def dict_filter(df: DataFrame, wanted: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose columns all lie in the given lists."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]).isin(list(kv[1]))), wanted.items(), df)


def wide_correlations(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, corr`` of every pair of columns (a before b), in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = wide.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.a", "r.b", "r.corr")


def long_correlations(df: DataFrame, key: Sequence[str], item: str, value: str) -> DataFrame:
    """``a, b, corr`` between items over shared keys, for any number of items.

    Sums of a self-join on the key: items of a key meet, keys are never compared.
    """
    left = df.select(*key, F.col(item).alias("a"), F.col(value).cast("double").alias("va"))
    right = df.select(*key, F.col(item).alias("b"), F.col(value).cast("double").alias("vb"))
    return left.join(right, list(key)).where("a < b").groupBy("a", "b").agg(F.corr("va", "vb").alias("corr"))


def top_correlations(corr: DataFrame, over: float = 0.5) -> DataFrame:
    """Pairs whose absolute correlation exceeds ``over``, highest first."""
    return corr.where(F.abs("corr") > over).orderBy(F.desc("corr"), "a", "b")


def correlations_touching(corr: DataFrame, over: float, item: str) -> DataFrame:
    """Pairs over the limit that hold ``item``."""
    return corr.where((F.abs("corr") > over) & ((F.col("a") == item) | (F.col("b") == item)))


def region_metadata(df: DataFrame, metadata: DataFrame, region: str, columns: Sequence[str]) -> DataFrame:
    """Add metadata columns that ``df`` lacks by region; ``Unknown`` where the region is unknown.

    Several rows of one region must agree; otherwise the greatest value counts.
    """
    missing = [c for c in columns if c not in df.columns]
    if not missing:
        return df
    one = metadata.groupBy(region).agg(*[F.max(c).alias(c) for c in missing])
    return df.join(one, region, "left").select(*df.columns, *[F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in missing])


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and correlation of y on x in each group."""
    aggs = [F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("corr")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def by_absolute_sum(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """``df`` with ``row_rank`` and ``column_rank`` (from 1): rows and columns of a long table by their sums of absolute values, greatest first, ties by name."""

    def ranks(of: str, name: str) -> DataFrame:
        sums = df.groupBy(of).agg(F.sum(F.abs(F.col(value))).alias("__s"))
        return sums.select(of, F.row_number().over(Window.orderBy(F.desc("__s"), of)).alias(name))  # one row a name, already aggregated

    return df.join(ranks(row, "row_rank"), row).join(ranks(column, "column_rank"), column)


def custom_order(df: DataFrame, column: str, order: Sequence) -> DataFrame:
    """Rows whose value is listed, in the order of the list, with its position (from 0) as ``place``."""
    listed = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], T.StructType([T.StructField(column, df.schema[column].dataType), T.StructField("place", T.IntegerType())]))
    return df.join(listed, column).orderBy("place")


def side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two tables by a shared key, rows of either kept; a column of both is taken from the left where it has a value.

    Tables are never zipped by position: rows of a distributed table have none.
    """
    clash = [c for c in right.columns if c in left.columns and c != key]
    both = left.join(right.withColumnsRenamed({c: f"__{c}" for c in clash}), key, "full_outer")
    return both.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in clash}).drop(*[f"__{c}" for c in clash])
