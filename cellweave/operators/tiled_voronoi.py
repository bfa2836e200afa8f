"""Voronoi cells of regions of any size: tiles with margins, cells that are certain there, the rest met again.

1. Regions are cut into tiles as for the triangulation. A task cuts the box of each of its points by the bisectors to the points
   around, nearest first, for many points at once. A cell is final when the circles around its corners, through its point, lie in
   what was seen: a point outside them cuts nothing off.
2. Cells that are not final (beside gaps wider than a margin) are cut once more, in one task a region, by the points of each other and by those
   points of final cells whose circles leave their tile; all their other neighbours were seen before.

Corners are computed relative to the point; corners nearer to each other than EXACT of the box count as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.cell_cutting import EXACT, box_polygons, circles_inside, cut_cells
from cellweave.operators.tiled_delaunay import TILE, deal_tiles
from cellweave.runtime import materialize

#: Margin in sides of a tile.
MARGIN = 0.2


def _lists(px, py, cx, cy, count, box, exact) -> pa.Array:
    """The polygons as lists of corners, in the units of the data; what lies on the box lies there exactly."""
    kept = np.arange(cx.shape[1]) < count[:, None]
    flat = np.stack([(cx + px[:, None])[kept], (cy + py[:, None])[kept]], axis=1)
    for i, bound in ((0, box[0]), (1, box[1]), (0, box[2]), (1, box[3])):
        flat[np.abs(flat[:, i] - bound) <= exact, i] = bound
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(flat) + 1, 2, dtype=np.int32)), pa.array(flat.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pairs)


def _unlisted(px, py, corners: pa.ChunkedArray):
    lists = corners.to_pylist()
    width = max(map(len, lists))
    full = np.array([c + [c[-1]] * (width - len(c)) for c in lists], float)
    return full[:, :, 0] - px[:, None], full[:, :, 1] - py[:, None], np.full(full.shape[:2], -1), np.array([len(c) for c in lists])


def voronoi_tiled(points: DataFrame, box: tuple[float, float, float, float], tile: int = TILE) -> DataFrame:
    """``region, cell_id, corners`` of the Voronoi cells, inside ``box``, of different places ``region, cell_id, x, y`` (doubles)."""
    region, kind = points.schema["region"].dataType.simpleString(), points.schema["cell_id"].dataType.simpleString()
    exact = EXACT * max(max(map(abs, box)), 1e-300)
    named, dealt = deal_tiles(points, tile, MARGIN)
    schema = f"key string, cell_id {kind}, x double, y double, final boolean, border boolean, corners array<array<double>>"

    def one(t: pa.Table) -> pa.Table:
        x, y, own = t["x"].to_numpy(), t["y"].to_numpy(), np.flatnonzero(t["own"].to_numpy())
        px, py = x[own], y[own]
        cx, cy, _, count = cut_cells(x, y, own, box_polygons(px, py, box), exact) if len(own) else box_polygons(px, py, box)
        seen, tile_ = ([t[f"{c}{i}"][0].as_py() for i in ends for c in ("gx", "gy")] for ends in ((0, 1), ("_low", "_high")))
        out = t.take(pa.array(own))
        final = circles_inside(px, py, cx, cy, seen)
        border = ~circles_inside(px, py, cx, cy, tile_)
        return pa.table([out["key"], out["cell_id"], out["x"], out["y"], pa.array(final), pa.array(border), _lists(px, py, cx, cy, count, box, exact)], names=["key", "cell_id", "x", "y", "final", "border", "corners"])

    found = materialize(dealt.groupBy("key", "gx", "gy").applyInArrow(one, schema), "cells")
    cells = found.where("final").select("key", "cell_id", "corners")
    rest = found.where("not final")
    if not rest.isEmpty():
        beside = found.where("final and border").join(rest.select("key").distinct(), "key", "left_semi").withColumn("corners", F.lit(None).cast("array<array<double>>"))

        def last(t: pa.Table) -> pa.Table:
            x, y, asked = t["x"].to_numpy(), t["y"].to_numpy(), np.flatnonzero(~t["final"].to_numpy(zero_copy_only=False))
            out = t.take(pa.array(asked))
            px, py = x[asked], y[asked]
            cx, cy, _, count = cut_cells(x, y, asked, _unlisted(px, py, out["corners"]), exact)
            return pa.table([out["key"], out["cell_id"], _lists(px, py, cx, cy, count, box, exact)], names=["key", "cell_id", "corners"])

        met = rest.select(*beside.columns).unionByName(beside)
        cells = cells.unionByName(met.groupBy("key").applyInArrow(last, f"key string, cell_id {kind}, corners array<array<double>>"))
    return cells.select(F.when(F.col("key") != "0", F.substring("key", F.lit(2), F.length("key"))).cast(region).alias("region"), "cell_id", "corners")
