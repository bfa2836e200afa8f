"""Planar geometry inside one region: triangulation, density clusters, outlines. Numpy only."""

from __future__ import annotations

import heapq

import numpy as np


def _left(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _inside(ax, ay, bx, by, cx, cy, dx, dy) -> bool:
    """Whether d lies strictly inside the circle through a, b, c (counter-clockwise); exact for integers."""
    ax, ay, bx, by, cx, cy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx) > 0


def triangulate(points: list[tuple]) -> list[tuple[int, int, int]]:
    """Delaunay triangles of distinct points, counter-clockwise.

    Points go in row by row of a coarse grid and each is found by walking from the
    last triangle. Edges outside the hull are tied to one point at infinity (-1), so
    no helper triangle distorts the hull. Python integers keep the tests exact.
    Fewer than three points, or points on one line, give no triangles.
    """
    n = len(points)
    if n < 3:
        return []
    side = max(1, int(np.sqrt(n / 4)))
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    low, span = min(ys), (max(ys) - min(ys)) or 1
    rows = [min(side - 1, int((p[1] - low) * side / span)) for p in points]
    order = sorted(range(n), key=lambda i: (rows[i], xs[i] if rows[i] % 2 == 0 else -xs[i], ys[i]))
    a, b = order[0], order[1]
    third = next((i for i in order[2:] if _left(xs[a], ys[a], xs[b], ys[b], xs[i], ys[i]) != 0), None)
    if third is None:
        return []
    if _left(xs[a], ys[a], xs[b], ys[b], xs[third], ys[third]) < 0:
        a, b = b, a
    # across[(u, v)]: the corner left of edge u -> v; -1 is the point at infinity.
    across: dict[tuple[int, int], int] = {}

    def add(u, v, w):
        across[u, v], across[v, w], across[w, u] = w, u, v

    add(a, b, third)
    add(b, a, -1)
    add(third, b, -1)
    add(a, third, -1)

    def conflict(u, v, w, p) -> bool:
        x, y = xs[p], ys[p]
        for i, (q, r) in ((u, (v, w)), (v, (w, u)), (w, (u, v))):
            if i == -1:  # outer side of the hull edge q -> r
                turn = _left(xs[q], ys[q], xs[r], ys[r], x, y)
                if turn != 0:
                    return turn > 0
                return (x - xs[q]) * (x - xs[r]) + (y - ys[q]) * (y - ys[r]) < 0
        return _inside(xs[u], ys[u], xs[v], ys[v], xs[w], ys[w], x, y)

    edge = (a, b)
    for p in order:
        if p in (order[0], order[1], third):
            continue
        x, y = xs[p], ys[p]
        u, v = edge
        w = across[u, v]
        if -1 in (u, v, w):  # start from the inner side
            for e in ((u, v), (v, w), (w, u)):
                if -1 not in e:
                    u, v = e[1], e[0]
                    w = across[u, v]
                    break
        moved = True
        while moved and w != -1:
            moved = False
            for q, r in ((u, v), (v, w), (w, u)):
                if _left(xs[q], ys[q], xs[r], ys[r], x, y) < 0:
                    u, v = r, q
                    w = across[u, v]
                    moved = True
                    break
        # Carve out the triangles whose circles hold p and join p to their rim.
        stack, gone, rim = [(u, v, w)], set(), []
        seen = {frozenset((u, v, w))}
        if not conflict(u, v, w, p):
            raise ValueError("points repeat")
        while stack:
            t = stack.pop()
            gone.add(t)
            for q, r in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                s = across[r, q]
                key = frozenset((r, q, s))
                if key in seen:
                    continue
                if conflict(r, q, s, p):
                    seen.add(key)
                    stack.append((r, q, s))
        dead = {e for t in gone for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        rim = [e for e in dead if (e[1], e[0]) not in dead]
        for e in dead:
            across.pop(e, None)
        for q, r in rim:
            add(q, r, p)
            if -1 not in (q, r):
                edge = (q, r)
    out = []
    for (u, v), w in across.items():
        if -1 not in (u, v, w) and u < v and u < w:
            out.append((u, v, w))
    return out


def triangulation_edges(points: list[tuple]) -> list[tuple[int, int]]:
    """Undirected Delaunay edges; points on a line are joined in order."""
    triangles = triangulate(points)
    if not triangles:
        order = sorted(range(len(points)), key=lambda i: points[i])
        return sorted((min(i, j), max(i, j)) for i, j in zip(order, order[1:], strict=False))
    return sorted({(min(e), max(e)) for t in triangles for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))})


def voronoi_polygons(points: list[tuple], box: tuple[float, float, float, float]) -> list[list[tuple[float, float]]]:
    """Voronoi cell of each distinct point inside a box (x0, y0, x1, y1), corners counter-clockwise.

    The box is cut by the bisector to each Delaunay neighbour: a cell has no other
    sides, so open cells end at the box.
    """
    near: dict[int, set[int]] = {i: set() for i in range(len(points))}
    for i, j in triangulation_edges(points):
        near[i].add(j)
        near[j].add(i)
    x0, y0, x1, y1 = box
    out = []
    for i, (px, py) in enumerate(points):
        cell = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        for j in sorted(near[i]):
            qx, qy = points[j]
            mx, my, dx, dy = (px + qx) / 2, (py + qy) / 2, qx - px, qy - py
            side = [(x - mx) * dx + (y - my) * dy for x, y in cell]
            cut = []
            for k in range(len(cell)):
                a, b, sa, sb = cell[k - 1], cell[k], side[k - 1], side[k]
                if (sa < 0) != (sb < 0):
                    t = sa / (sa - sb)
                    cut.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
                if sb < 0:
                    cut.append(b)
            cell = cut
        out.append(cell)
    return out


def outline(points: list[tuple], longest: float) -> list[int]:
    """Points on the border of the triangulation after dropping triangles with an edge over ``longest``.

    A concave outline. Points that no kept triangle holds are border points too.
    """
    def short(i, j):
        return (points[i][0] - points[j][0]) ** 2 + (points[i][1] - points[j][1]) ** 2 <= longest * longest

    kept = [t for t in triangulate(points) if short(t[0], t[1]) and short(t[1], t[2]) and short(t[2], t[0])]
    count: dict[tuple[int, int], int] = {}
    for t in kept:
        for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            count[min(e), max(e)] = count.get((min(e), max(e)), 0) + 1
    border = {i for e, k in count.items() if k == 1 for i in e}
    inner = {i for t in kept for i in t}
    return sorted(border | (set(range(len(points))) - inner))


#: Places of a leaf, leaves of a group, neighbours kept for each place (about), and distances held at once.
LEAF, GROUP, KEPT, HELD = 64, 16, 48, 1 << 21


def _leaves(places: np.ndarray, size: int) -> list[np.ndarray]:
    """Places cut at medians of the wider side until no piece holds more than ``size``; pieces near each other stand together."""
    todo, out = [np.arange(len(places))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        axis = int(np.argmax(np.ptp(places[own], axis=0)))
        order = own[np.argpartition(places[own, axis], len(own) // 2)]
        todo += [order[len(own) // 2 :], order[: len(own) // 2]]
    return out


def _boxes(places: np.ndarray, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([places[k].min(axis=0) for k in pieces]), np.array([places[k].max(axis=0) for k in pieces])


def _apart(low: np.ndarray, high: np.ndarray, low1: np.ndarray, high1: np.ndarray) -> np.ndarray:
    """Lower bound of the distance between points of boxes (last axis: x, y)."""
    gap = np.maximum(0, np.maximum(low - high1, low1 - high))
    return np.hypot(gap[..., 0], gap[..., 1]) * (1 - 1e-12)


def reach_tree(xy: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances and ends of the minimum spanning tree of mutual reachability, as Prim's algorithm finds it from point 0.

    The next point is the nearest (of equals the first), hung on the first visited point that is as near. Memory grows with
    the points alone: distances are formed between leaves of a median tree, at most HELD at a time, and only pairs within
    one radius are kept as neighbours. Where that graph ends, the next point is looked for in all groups of leaves that
    can hold it. Points at one place share their distances and are handled as one place.
    """
    n = len(xy)
    places, which, many = np.unique(xy, axis=0, return_inverse=True, return_counts=True)
    which, m = which.ravel(), len(places)
    members = np.argsort(which, kind="stable")
    start = np.concatenate([[0], np.cumsum(many)])
    x, y = places[:, 0].copy(), places[:, 1].copy()
    leaves = _leaves(places, max(LEAF, 2 * least))
    low, high = _boxes(places, leaves)
    core = np.empty(m)

    def rows(leaf: np.ndarray, others: np.ndarray):
        """Slices of ``leaf`` and their distances to ``others``."""
        step = max(1, HELD // max(1, len(others)))
        for at in range(0, len(leaf), step):
            part = leaf[at : at + step]
            yield part, np.hypot(x[part][:, None] - x[others], y[part][:, None] - y[others])

    times = np.minimum(many, least)
    for i, leaf in enumerate(leaves):
        own = np.repeat(leaf, times[leaf])
        most = np.inf
        if len(own) >= least:
            most = max(np.partition(d, least - 1, axis=1)[:, least - 1].max() for _, d in rows(leaf, own))
        near = np.concatenate([leaves[k] for k in np.flatnonzero(_apart(low, high, low[i], high[i]) <= most)])
        for part, d in rows(leaf, np.repeat(near, times[near])):
            core[part] = np.partition(d, least - 1, axis=1)[:, least - 1]

    def neighbours(i: int, radius: float):
        """Numbers of neighbours of a leaf's places, and these, place by place."""
        near = np.concatenate([leaves[k] for k in np.flatnonzero(_apart(low, high, low[i], high[i]) <= radius)])
        for part, d in rows(leaves[i], near):
            hit = (d <= radius) & (core[near] <= radius) & (core[part] <= radius)[:, None] & (near != part[:, None])
            yield hit.sum(axis=1), near[np.nonzero(hit)[1]].astype(np.int32)

    radius = float(max(core.max(), np.sqrt(8 * np.prod(np.ptp(places, axis=0)) / m)))
    some = range(0, len(leaves), 16)
    while sum(int(c.sum()) for i in some for c, _ in neighbours(i, radius)) > KEPT * sum(len(leaves[i]) for i in some):
        radius *= 0.8
    found = [f for i in range(len(leaves)) for f in neighbours(i, radius)]
    to = np.concatenate([f[1] for f in found])
    order = np.concatenate(leaves)
    ends = np.concatenate([[0], np.cumsum(np.concatenate([f[0] for f in found]))])
    first, last = np.empty(m, np.int64), np.empty(m, np.int64)
    first[order], last[order] = ends[:-1], ends[1:]
    del found
    groups = [np.concatenate(leaves[k : k + GROUP]) for k in range(0, len(leaves), GROUP)]
    glow, ghigh = _boxes(places, groups)
    leaf_of = np.repeat(np.arange(len(leaves)), [len(k) for k in leaves])[np.argsort(order)]
    seen, turn, head = np.zeros(m, bool), np.zeros(m, np.int64), members[start[:-1]].copy()
    seen_in, size_of = np.zeros(len(leaves), np.int64), np.array([len(k) for k in leaves])
    best, link, used = np.full(m, np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64)
    heap: list[tuple[float, int, int]] = []
    visits = 0

    def visit(at: int, point: int) -> None:
        nonlocal visits
        used[at] += 1
        if not seen[at]:
            seen[at], turn[at], visits = True, visits, visits + 1
            seen_in[leaf_of[at]] += 1
            near = to[first[at] : last[at]]
            near = near[~seen[near]]
            d = np.maximum(np.maximum(np.hypot(x[near] - x[at], y[near] - y[at]), core[near]), core[at])
            closer = d < best[near]
            near, d = near[closer], d[closer]
            best[near], link[near] = d, point
            for e in zip(d.tolist(), head[near].tolist(), near.tolist(), strict=True):
                heapq.heappush(heap, e)
            if core[at] < best[at]:
                best[at], link[at] = core[at], point
        if used[at] < many[at]:
            head[at] = members[start[at] + used[at]]
            heapq.heappush(heap, (float(best[at]), int(head[at]), at))

    def beyond() -> tuple[float, int, int, int]:
        """The nearest unvisited place: distance, first point, place, first visited place that is as near."""
        came, left = (np.unique(np.flatnonzero(k) // GROUP) for k in (seen_in, seen_in < size_of))
        apart = _apart(glow[left][:, None], ghigh[left][:, None], glow[came], ghigh[came]).ravel()
        nearest = (np.inf, n, -1, -1)
        for k in np.argsort(apart, kind="stable").tolist():
            if apart[k] > nearest[0]:
                break
            new, old = (np.arange(g * GROUP, min((g + 1) * GROUP, len(leaves))) for g in (left[k // len(came)], came[k % len(came)]))
            new, old = new[seen_in[new] < size_of[new]], old[seen_in[old] > 0]
            inner = _apart(low[new][:, None], high[new][:, None], low[old], high[old]).ravel()
            for j in np.argsort(inner, kind="stable").tolist():
                if inner[j] > nearest[0]:
                    break
                u, v = leaves[new[j // len(old)]], leaves[old[j % len(old)]]
                u, v = u[~seen[u]], v[seen[v]]
                d = np.maximum(np.maximum(np.hypot(x[u][:, None] - x[v], y[u][:, None] - y[v]), core[u][:, None]), core[v])
                if d.min() > nearest[0]:
                    continue
                row, col = np.nonzero(d == d.min())
                row, col = u[row], v[col]
                i = np.lexsort((turn[col], head[row]))[0]
                more = (float(d.min()), int(head[row[i]]), int(row[i]), int(col[i]))
                if nearest[3] < 0 or (more[:2], turn[more[3]]) < (nearest[:2], turn[nearest[3]]):
                    nearest = more
        return nearest

    out_d, out_a, out_b = np.empty(n - 1), np.empty(n - 1, np.int64), np.empty(n - 1, np.int64)
    visit(int(which[0]), 0)
    known, far = -1, (np.inf, n, -1, -1)
    for i in range(n - 1):
        while heap and (used[heap[0][2]] == many[heap[0][2]] or heap[0][0] != best[heap[0][2]] or heap[0][1] != head[heap[0][2]]):
            heapq.heappop(heap)
        if (not heap or heap[0][0] > radius) and visits < m:
            if known != visits:
                known, far = visits, beyond()
            if not heap or far[:2] < heap[0][:2]:
                best[far[2]], link[far[2]] = far[0], members[start[far[3]]]
                heapq.heappush(heap, far[:3])
        d, point, at = heapq.heappop(heap)
        out_d[i], out_a[i], out_b[i] = d, link[at], point
        visit(at, point)
    return out_d, out_a, out_b


def density_clusters(xy: np.ndarray, least: int) -> np.ndarray:
    """Hierarchical density clusters (excess of mass, one cluster allowed); -1 is noise.

    Core distance is that of the ``least``-th point, itself included; the minimum
    spanning tree of mutual reachability is condensed to clusters of ``least`` points.
    Memory grows with the points alone.
    """
    n, least = len(xy), max(1, least)
    if n < max(2, least):
        return np.full(n, -1)
    far, one, two = reach_tree(np.asarray(xy, float), least)
    order = np.lexsort((two, one, far))
    # Single linkage: node n + i joins two nodes at tree[i]'s distance.
    parent, size, children = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (d, a, b) in enumerate(zip(far[order].tolist(), one[order].tolist(), two[order].tolist(), strict=True)):
        ra, rb, node = find(a), find(b), n + i
        parent[ra] = parent[rb] = node
        size[node] = size[ra] + size[rb]
        children[node] = (ra, rb, 1 / max(d, 1e-12))
    # Condense: follow splits from the root; a side under ``least`` falls out as points.
    clusters: dict[int, dict] = {0: {"birth": 0.0, "stability": 0.0, "kids": [], "points": []}}
    stack = [(2 * n - 2, 0)]

    def leaves(node):
        todo, out = [node], []
        while todo:
            t = todo.pop()
            if t < n:
                out.append(t)
            else:
                todo += children[t][:2]
        return out

    while stack:
        node, c = stack.pop()
        own = clusters[c]
        while True:
            if node < n:
                own["points"].append(node)
                break
            a, b, lam = children[node]
            big = [s for s in (a, b) if size[s] >= least]
            for s in (a, b):
                if s not in big or len(big) == 2:
                    own["stability"] += size[s] * (lam - own["birth"])
            if len(big) == 2:
                for s in big:
                    k = len(clusters)
                    clusters[k] = {"birth": lam, "stability": 0.0, "kids": [], "points": []}
                    own["kids"].append(k)
                    stack.append((s, k))
                break
            for s in (a, b):
                if s not in big:
                    own["points"] += leaves(s)
            if not big:
                break
            node = big[0]
    for c in sorted(clusters, reverse=True):
        kids = clusters[c]["kids"]
        below = sum(clusters[k]["best"] for k in kids)
        clusters[c]["cut"] = bool(kids) and below > clusters[c]["stability"]
        clusters[c]["best"] = below if clusters[c]["cut"] else clusters[c]["stability"]

    def below_points(c):
        todo, out = [c], []
        while todo:
            t = todo.pop()
            out += clusters[t]["points"]
            todo += clusters[t]["kids"]
        return out

    chosen, todo = [], [0]
    while todo:
        c = todo.pop()
        if clusters[c]["cut"]:
            todo += clusters[c]["kids"]
        else:
            chosen.append(c)
    labels = np.full(n, -1)
    groups = [sorted(below_points(c)) for c in chosen]
    for i, g in enumerate(sorted(groups)):
        labels[g] = i
    return labels
