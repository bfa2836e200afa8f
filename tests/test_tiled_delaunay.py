"""Tiled triangulation against the whole one."""

import random

import numpy as np
import pytest

from cellweave.operators import interactions
from cellweave.operators.geometry import triangulate
from cellweave.operators.tiled_delaunay import canonical_edges, delaunay_tiled, diagonals, merged_rest, polygons, whole_points


def places(kind, seed):
    r = random.Random(seed)
    if kind == "even":
        found = {(r.randrange(400), r.randrange(400)) for _ in range(900)}
    elif kind == "grid":  # every square has four corners on a circle
        found = {(i, j) for i in range(30) for j in range(30)}
    elif kind == "clusters":  # nine in ten points in a hundredth of the area, and a wide gap
        found = {(50 + r.randrange(40), 60 + r.randrange(40)) for _ in range(900)} | {(r.randrange(100), r.randrange(400)) for _ in range(60)} | {(300 + r.randrange(100), r.randrange(400)) for _ in range(60)}
    elif kind == "ring":
        found = {(round(1000 * np.cos(a)), round(1000 * np.sin(a))) for a in np.linspace(0, 6.28, 300)} | {(r.randrange(-50, 50), r.randrange(-50, 50)) for _ in range(200)}
    else:
        found = {(i, 2 * i) for i in range(200)}
    return sorted(found)


@pytest.mark.parametrize("kind", ["even", "grid", "clusters", "ring", "line"])
def test_tiles_give_the_whole_triangulation(spark, kind):
    rows, want = [], set()
    for region in ("a", None):
        points = places(kind, len(region or ""))
        ids = list(range(1000, 1000 + len(points)))
        random.Random(3).shuffle(ids)
        rows += [(region, i, float(x), float(y)) for i, (x, y) in zip(ids, points, strict=True)]
        want |= {(region, *sorted((ids[a], ids[b]))) for a, b in canonical_edges(points)}
    df = spark.createDataFrame(rows, "region string, id long, x double, y double").repartition(4)
    got = delaunay_tiled(df, tile=60).collect()
    assert len(got) == len(want) and {(r["region"], r["id1"], r["id2"]) for r in got} == want
    at = {(r, i): (x, y) for r, i, x, y in rows}
    assert all(abs(e["distance"] - np.hypot(*(np.array(at[e["region"], e["id1"]]) - at[e["region"], e["id2"]]))) < 1e-9 for e in got)


def test_fractions_and_small_regions(spark):
    r = random.Random(7)
    rows = [("f", i, r.random() * 1e-3 + 1, r.random() * 7e5) for i in range(300)] + [("one", 1, 2.0, 3.0), ("two", 1, 0.0, 0.0), ("two", 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "region string, cell_id long, x double, y double")
    got = {(e["region"], e["id1"], e["id2"]) for e in interactions.delaunay_edges(df, truncate=False).collect()}
    assert got == {("f", *sorted(e)) for e in canonical_edges(whole_points([x for _, _, x, _ in rows[:300]], [y for *_, y in rows[:300]]))} | {("two", 1, 2)}
    assert delaunay_tiled(df.limit(0).withColumnRenamed("cell_id", "id")).count() == 0


def test_polygons_hold_points_of_one_circle():
    p = [(0, 0), (2, 0), (2, 2), (0, 2), (5, 1)]
    rings = polygons(p, triangulate(p))
    assert sorted(len(r) for r in rings) == [3, 4]
    square = next(r for r in rings if len(r) == 4)
    assert diagonals(p, square) == [(0, 2)] and len(canonical_edges(p)) == 7
    assert merged_rest(p, set()) and {tuple(sorted(e)) for e in merged_rest(p, set())} == canonical_edges(p)
