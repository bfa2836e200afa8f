"""Voronoi cells cut in tiles against those of the whole triangulation."""

import random

import numpy as np
import pytest

from cellweave.operators import interactions, tiled_voronoi
from cellweave.operators.geometry import voronoi_polygons
from cellweave.operators.tiled_voronoi import voronoi_tiled
from tests.test_tiled_delaunay import places


def corners(cell):
    """Different corners; rounding may list one twice."""
    p = np.array(cell).reshape(-1, 2)
    return p[np.hypot(*(p - np.roll(p, 1, axis=0)).T) > 1e-7] if len(p) else p


@pytest.mark.parametrize("kind", ["even", "grid", "clusters", "ring", "line"])
def test_tiles_give_the_cells_of_the_whole_region(spark, kind):
    box = (-1100.0, -1100.0, 1200.0, 1150.0) if kind == "ring" else (-5.0, 3.0, 390.5, 420.25)  # some points lie outside
    rows, want = [], {}
    for region in ("a", None):
        points = places(kind, len(region or ""))
        rows += [(region, i, float(x), float(y)) for i, (x, y) in enumerate(points)]
        want |= {(region, i): cell for i, cell in enumerate(voronoi_polygons(points, box))}
    df = spark.createDataFrame(rows, "region string, cell_id long, x double, y double").repartition(4)
    got = {(r["region"], r["cell_id"]): r["corners"] for r in voronoi_tiled(df, box, tile=60).collect()}
    assert got.keys() == want.keys()
    for key, cell in want.items():
        a, b = corners(got[key]), corners(cell)
        assert len(a) == len(b) == len(got[key])
        if len(a):
            far = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
            assert max(far.min(axis=0).max(), far.min(axis=1).max()) < 1e-6


def test_no_task_of_voronoi_cells_holds_a_region(spark, monkeypatch):
    """A region of 3000 points in tiles of 400: tasks that see it whole would fail."""
    seen = tiled_voronoi.cut_cells

    def bounded(x, *rest):
        assert len(x) < 1500
        return seen(x, *rest)

    monkeypatch.setattr(tiled_voronoi, "cut_cells", bounded)
    monkeypatch.setattr(interactions, "voronoi_tiled", lambda p, box: voronoi_tiled(p, box, tile=400))
    r = random.Random(5)
    rows = [("a", i, r.random() * 50, r.random() * 50) for i in range(3000)] + [("a", 3000, None, 1.0), ("a", 3001, float("nan"), 1.0), ("one", 1, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "region string, cell_id long, x double, y double")
    got = interactions.voronoi_cells(df, (0.0, 0.0, 50.0, 50.0)).collect()
    area = lambda p: abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2
    assert len(got) == 3001 and abs(sum(area(r["corners"]) for r in got) - 5000) < 1e-6
