"""The triangulation made from Voronoi cells against the exact one."""

import random

import numpy as np
import pytest

from cellweave.operators.cell_cutting import triangulation_parts
from cellweave.operators.tiled_delaunay import canonical_edges, merged_rest
from tests.test_tiled_delaunay import places


@pytest.mark.parametrize("kind", ["even", "grid", "clusters", "ring", "line", "dense"])
@pytest.mark.parametrize("seed", [1, 2])
def test_parts_and_rest_are_the_whole_triangulation(kind, seed):
    r = random.Random(seed)
    points = sorted({(r.randrange(40), r.randrange(40)) for _ in range(1500)}) if kind == "dense" else places(kind, seed)
    x, y = (np.array([float(p[i]) for p in points]) for i in (0, 1))
    sort, a, b, rest = (c.tolist() for c in triangulation_parts(x, y, np.ones(len(x), bool), (-np.inf, -np.inf, np.inf, np.inf)))
    number = {v: i for i, v in enumerate(rest)}
    certified = {(number[u], number[v]) for k, u, v in zip(sort, a, b, strict=True) if k == 0 and u in number and v in number}
    last = {(rest[u], rest[v]) for u, v in merged_rest([points[v] for v in rest], certified)}
    assert {(min(e), max(e)) for e in [*zip(a, b, strict=True), *last]} == canonical_edges(points)
    if kind in ("even", "dense"):
        side = x.max()
        assert all(min(x[v], y[v], side - x[v], side - y[v]) < side / 6 for v in rest)  # beside the outline only


def test_whole_numbers_decide_what_rounding_cannot():
    """A point a hair inside a circle through three others, far apart: no wrong edge, at worst points are left unfinished."""
    points = [(0, 0), (16000, 1), (7999, 16000), (16000, 2), (8001, 15999), (1, 16000), (8000, 8000), (7999, 8001), (8001, 8001)]
    x, y = (np.array([float(p[i]) for p in points]) for i in (0, 1))
    _, a, b, _ = (c.tolist() for c in triangulation_parts(x, y, np.ones(len(x), bool), (-np.inf, -np.inf, np.inf, np.inf)))
    assert {(min(e), max(e)) for e in zip(a, b, strict=True)} <= canonical_edges(points)
