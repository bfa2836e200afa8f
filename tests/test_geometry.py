import itertools
import random
import tracemalloc

import numpy as np
import pytest

from cellweave.operators.geometry import density_clusters, outline, reach_tree, triangulate, triangulation_edges, voronoi_polygons


def circle_is_empty(points, t):
    (ax, ay), (bx, by), (cx, cy) = (points[i] for i in t)
    for k, (dx, dy) in enumerate(points):
        if k in t:
            continue
        m = [[px - dx, py - dy, (px - dx) ** 2 + (py - dy) ** 2] for px, py in ((ax, ay), (bx, by), (cx, cy))]
        det = sum(m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3))
        if det > 0:
            return False
    return True


def hull_area2(points):
    pts = sorted(points)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    hull = half(pts)[:-1] + half(pts[::-1])[:-1]
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1], strict=True)))


@pytest.mark.parametrize("seed", range(8))
def test_triangles_are_delaunay_and_fill_the_hull(seed):
    r = random.Random(seed)
    side = r.choice([6, 15, 1000])
    points = list({(r.randrange(side), r.randrange(side)) for _ in range(60)})
    triangles = triangulate(points)
    assert all(circle_is_empty(points, t) for t in triangles)
    area = sum((points[b][0] - points[a][0]) * (points[c][1] - points[a][1]) - (points[b][1] - points[a][1]) * (points[c][0] - points[a][0]) for a, b, c in triangles)
    assert area == hull_area2(points)


def test_line_and_few_points():
    assert triangulate([(0, 0), (1, 1)]) == []
    assert triangulation_edges([(2, 2), (0, 0), (1, 1)]) == [(0, 2), (1, 2)]
    assert triangulation_edges([(0, 0)]) == []


def test_four_cocircular_points():
    edges = triangulation_edges([(0, 0), (1, 0), (0, 1), (1, 1)])
    assert len(edges) == 5


def test_clusters_and_noise():
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal((0, 0), 1, (60, 2)), rng.normal((50, 50), 1, (60, 2)), [[500, 500]]])
    labels = density_clusters(xy, 10)
    assert len(set(labels[:60]) - {-1}) == 1 and len(set(labels[60:120]) - {-1}) == 1
    assert labels[0] != labels[70] or labels[0] == -1
    assert labels[120] == -1
    assert (density_clusters(xy[:5], 10) == -1).all()


def test_outline_of_a_grid():
    points = list(itertools.product(range(5), range(5)))
    assert sorted(points[i] for i in outline(points, 2)) == sorted(p for p in points if 0 in p or 4 in p)


def area(poly):
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(poly, poly[1:] + poly[:1], strict=True))) / 2


def test_voronoi_cells_fill_the_box_and_hold_their_points():
    r = random.Random(2)
    points = list({(r.randrange(100), r.randrange(100)) for _ in range(80)})
    cells = voronoi_polygons(points, (0, 0, 100, 100))
    assert sum(map(area, cells)) == pytest.approx(10_000)
    for (px, py), cell in zip(points, cells, strict=True):
        for x, y in cell:
            own = (x - px) ** 2 + (y - py) ** 2
            assert own <= min((x - a) ** 2 + (y - b) ** 2 for a, b in points) + 1e-6


def dense_tree(xy, least):
    """Prim's algorithm over all distances."""
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    core = np.partition(d, least - 1, axis=1)[:, least - 1]
    d = np.maximum(np.maximum(d, core), core[:, None])
    best, link, open_, now, tree = np.full(len(xy), np.inf), np.zeros(len(xy), int), np.ones(len(xy), bool), 0, []
    for _ in range(len(xy) - 1):
        open_[now] = False
        closer = open_ & (d[now] < best)
        best[closer], link[closer] = d[now][closer], now
        now = int(np.argmin(np.where(open_, best, np.inf)))
        tree.append((best[now], link[now], now))
    return tree


@pytest.mark.parametrize("seed", range(6))
def test_spanning_tree_of_leaves_is_that_of_all_distances(seed):
    """Ties, repeated places, gaps, and single points far away; in the order in which points are reached."""
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, 30, (300, 2)), rng.integers(400, 900, (400, 2)), rng.integers(0, 3000, (20, 2)), np.full((50, 2), 7)]
    xy = rng.permutation(np.concatenate(parts)).astype(float)
    least = (2, 10, 40)[seed % 3]
    assert list(zip(*(c.tolist() for c in reach_tree(xy, least)), strict=True)) == dense_tree(xy, least)


def test_density_clusters_hold_no_rows_of_distances():
    xy = np.random.default_rng(3).random((6000, 2)) * 1000
    tracemalloc.start()
    density_clusters(xy, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # 512 rows of all distances alone take 25 MB for each array


def test_density_clusters_of_a_long_chain_of_splits():
    """Clusters that split once more at each gap, deeper than Python's stack."""
    n = 1300
    at = np.repeat(np.cumsum(10 + np.arange(n) * 0.01), 2)
    labels = density_clusters(np.stack([at, np.zeros(2 * n)], axis=1), 2)
    assert len(labels) == 2 * n and (labels[::2] == labels[1::2]).all()
