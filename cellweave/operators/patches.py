"""Patches of a label and what lies around them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.geometry import density_clusters, outline
from cellweave.operators.spatial import knn, range_pairs


def density_patches(cells: DataFrame, label: str, group, least: int = 80, region: str = "region", cell_id: str = "cell_id", x: str = "x", y: str = "y", longest: float = 50) -> DataFrame:
    """``region, cell_id, x, y, patch, on_outline`` of the group's cells; patch -1 is noise.

    Regions with fewer than ``least`` such cells have no rows. Clusters are found for
    each region in one task, with memory that grows with the region's cells of the group alone.
    """
    own = cells.where(F.col(label) == group).select(F.col(region).alias("region"), F.col(cell_id).alias("cell_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    schema = f"region {own.schema['region'].dataType.simpleString()}, cell_id {own.schema['cell_id'].dataType.simpleString()}, x double, y double, patch int, on_outline boolean"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("cell_id").reset_index(drop=True)
        if len(p) < least:
            return p.assign(patch=np.int32(-1), on_outline=False).iloc[:0]
        xs, ys = p["x"].tolist(), p["y"].tolist()
        labels = density_clusters(p[["x", "y"]].to_numpy(), least)
        border = np.zeros(len(p), bool)
        for c in range(labels.max() + 1):
            members = np.flatnonzero(labels == c)
            points: dict[tuple, int] = {}
            for i in members.tolist():
                points.setdefault((xs[i], ys[i]), i)
            border[np.array(list(points.values()))[outline(list(points), longest)]] = True
        return p.assign(patch=labels.astype(np.int32), on_outline=border)

    return own.groupBy("region").applyInPandas(run, schema)


def border_cells(patches: DataFrame, edge_neighbours: int = 3) -> DataFrame:
    """``region, patch, cell_id, x, y``: the nearest group cells (noise included) of each outline cell, itself among them."""
    asked = patches.where("on_outline and patch >= 0")
    near = knn(asked, edge_neighbours, others=patches, include_self=True)
    ends = patches.select("region", F.col("cell_id").alias("neighbor"), "x", "y")
    own = asked.select("region", F.col("cell_id").alias("id"), "patch")
    found = near.join(own, ["region", "id"]).select("region", "patch", "neighbor").distinct()
    return found.join(ends, ["region", "neighbor"]).select("region", "patch", F.col("neighbor").alias("cell_id"), "x", "y")


def proximity(cells: DataFrame, borders: DataFrame, radius: float, label: str, group, region: str = "region", cell_id: str = "cell_id", x: str = "x", y: str = "y") -> DataFrame:
    """``region, cell_id, patch, neighbor_label, distance2, unique_patch``: cells of another label
    within ``radius`` of a border cell, with the least distance to the patch.

    One join at the largest radius of interest serves all smaller ones by a filter on
    ``distance2``.
    """
    left = borders.select(F.col("region").alias(region), F.col("cell_id").alias(cell_id), F.col("x").alias(x), F.col("y").alias(y), "patch")
    right = cells.where(F.col(label) != group).select(region, cell_id, x, y, F.col(label).alias("neighbor_label"))
    # The patch goes with the pairs, so they are reduced where they are formed and never shuffled.
    nearest = range_pairs(left, right, radius, region, cell_id, x, y, carried=("patch",)).groupBy(region, F.col("id2").alias(cell_id), "patch").agg(F.min("d2").alias("distance2"))
    named = nearest.join(right.select(region, cell_id, "neighbor_label"), [region, cell_id])
    unique = F.concat(F.col(region).cast("string"), F.lit(f"_{group}_patch_no_"), F.col("patch").cast("string"))
    return named.select(F.col(region), F.col(cell_id), "patch", "neighbor_label", "distance2", unique.alias("unique_patch"))


def patch_proximity(cells: DataFrame, label: str, group, least: int = 80, radius: float = 128, edge_neighbours: int = 3, longest: float = 50, region: str = "region", cell_id: str = "cell_id", x: str = "x", y: str = "y") -> DataFrame:
    """Density patches, their border cells and the cells around them. No patch gives no rows."""
    from cellweave.runtime import materialize

    patches = materialize(density_patches(cells, label, group, least, region, cell_id, x, y, longest), "patches")
    return proximity(cells, materialize(border_cells(patches, edge_neighbours), "borders"), radius, label, group, region, cell_id, x, y)


def ring_shares(near: DataFrame, radii: Sequence[float], category: str = "neighbor_label") -> DataFrame:
    """``radius, category, n, percent`` of distinct rows within each radius, from one result at the largest."""
    rings = F.explode(F.filter(F.array(*[F.lit(float(r)) for r in radii]), lambda r: F.col("distance2") <= r * r))
    counts = near.withColumn("radius", rings).groupBy("radius", category).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("radius")))


def proximity_counts(near: DataFrame, by: str, hue: str) -> DataFrame:
    """``by, hue, n`` with the total of ``by`` for ordering."""
    counts = near.groupBy(by, hue).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(by)))
