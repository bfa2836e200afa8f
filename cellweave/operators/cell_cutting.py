"""Voronoi cells of many points at once, with numpy: polygons are cut by the bisectors to the points around, nearest first."""

from __future__ import annotations

import numpy as np

#: Points of a bucket, candidates held at once, and candidates between two looks at what can still cut.
BUCKET, HELD, LOOK = 2, 1 << 17, 64
#: Share of the box's size under which lengths are rounding.
EXACT = 1e-12


def _wider(parts: tuple, width: int) -> tuple:
    """The arrays of polygons with room for ``width`` corners; the last is repeated."""
    return tuple(np.concatenate([c, np.repeat(c[:, -1:], width - c.shape[1], axis=1)], axis=1) if c.shape[1] < width else c for c in parts)


def _cut(cx: np.ndarray, cy: np.ndarray, edge: np.ndarray, count: np.ndarray, dx: np.ndarray, dy: np.ndarray, by: np.ndarray, exact: float) -> tuple[np.ndarray, ...]:
    """Polygons (a row each, the last corner repeated) cut by the bisectors to (dx, dy), and the rows that changed. ``edge``: whose bisector follows a corner."""
    far = np.hypot(dx, dy)
    with np.errstate(invalid="ignore"):
        side = (cx * (dx / far)[:, None] + cy * (dy / far)[:, None]) - (far / 2)[:, None]
    out = side > exact
    rows = np.flatnonzero(out.any(axis=1))
    if not len(rows):
        return cx, cy, edge, count, rows
    x, y, e, s, o, n, q = cx[rows], cy[rows], edge[rows], side[rows], out[rows], count[rows], by[rows, None]
    width = x.shape[1]
    ax, ay, ea, sa, oa = (np.roll(c, 1, axis=1) for c in (x, y, e, s, o))
    next_out = np.where(np.arange(width) == n[:, None] - 1, o[:, :1], np.roll(o, -1, axis=1))
    crossed = (o != oa) & (np.where(o, sa, s) < -exact)  # a corner on the line is its own crossing
    with np.errstate(invalid="ignore", divide="ignore"):
        t = sa / (sa - s)
        both_x, both_y = np.stack([ax + t * (x - ax), x], axis=2), np.stack([ay + t * (y - ay), y], axis=2)
    both_e = np.stack([np.where(o, q, ea), np.where(next_out & (s >= -exact), q, e)], axis=2)
    kept = np.stack([crossed, ~o & (np.arange(width) < n[:, None])], axis=2).reshape(len(rows), -1)
    chosen, many = np.flatnonzero(kept), kept.sum(axis=1)
    if (most := int(many.max())) > width:
        cx, cy, edge = _wider((cx, cy, edge), most + 2)
        width = cx.shape[1]
    at = (np.cumsum(many) - many)[:, None] + np.clip(np.arange(width), 0, np.maximum(many - 1, 0)[:, None])
    some = many > 0  # a point outside the box may have no cell in it
    chosen = chosen[at[some]]
    cx[rows[some]], cy[rows[some]], edge[rows[some]] = both_x.ravel()[chosen], both_y.ravel()[chosen], both_e.ravel()[chosen]
    cx[rows[~some]] = cy[rows[~some]] = 0.0
    count[rows] = many
    return cx, cy, edge, count, rows


def _nearest_first(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, near: np.ndarray, polygons: tuple, exact: float) -> tuple:
    """Polygons of the points (px, py) cut by their candidates ``near`` (numbers in x, y; -1: none)."""
    cx, cy, edge, count = polygons
    dx, dy = x[near] - px[:, None], y[near] - py[:, None]
    d2 = np.where(near < 0, np.inf, dx * dx + dy * dy)
    d2[d2 == 0] = np.inf
    order = np.argsort(d2, axis=1)
    d2, dx, dy, near = (np.take_along_axis(c, order, axis=1) for c in (d2, dx, dy, near))
    done = (cx.copy(), cy.copy(), edge.copy(), count.copy())
    left = np.arange(len(px))
    r2 = (cx * cx + cy * cy).max(axis=1)

    def put() -> tuple:
        out = (*_wider(done[:3], cx.shape[1]), done[3])
        for to, part in zip(out, (cx, cy, edge, count), strict=True):
            to[left] = part
        return out

    k = 0
    while k < d2.shape[1]:
        go = d2[:, k] < 4 * r2
        if not go.any():
            break
        if 4 * go.sum() < 3 * len(go):
            done = put()
            left, cx, cy, edge, count, r2, d2, dx, dy, near = (c[go] for c in (left, cx, cy, edge, count, r2, d2, dx, dy, near))
            go = np.ones(len(left), bool)
        if k == LOOK and d2.shape[1] > 4 * LOOK:  # many are left: only those that cut the polygon as it is
            far = np.sqrt(d2[:, k:])
            with np.errstate(invalid="ignore"):
                reach = np.max([cx[:, [c]] * dx[:, k:] + cy[:, [c]] * dy[:, k:] for c in range(cx.shape[1])], axis=0) / far - far / 2
            cuts = np.isfinite(far) & (reach > exact)
            order = np.argsort(~cuts, axis=1, kind="stable")[:, : int(cuts.sum(axis=1).max())]
            d2, dx, dy, near = (np.take_along_axis(c, order, axis=1) for c in (np.where(cuts, d2[:, k:], np.inf), dx[:, k:], dy[:, k:], near[:, k:]))
            k = 0
            continue
        found = np.flatnonzero(np.isfinite(d2[:, k]) & go)
        if len(found) == len(left):
            cx, cy, edge, count, rows = _cut(cx, cy, edge, count, dx[:, k], dy[:, k], near[:, k], exact)
        else:
            *some, changed = _cut(cx[found], cy[found], edge[found], count[found], dx[found, k], dy[found, k], near[found, k], exact)
            cx, cy, edge = _wider((cx, cy, edge), some[0].shape[1])
            some = (*_wider(tuple(some[:3]), cx.shape[1]), some[3])
            rows = found[changed]
            for to, part in zip((cx, cy, edge, count), some, strict=True):
                to[rows] = part[changed]
        r2[rows] = (cx[rows] ** 2 + cy[rows] ** 2).max(axis=1)
        k += 1
    return put()


def _on_circles(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, near: np.ndarray, polygons: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, corner and candidate wherever a third candidate lies on or in the circle around a corner, or almost."""
    cx, cy, edge, count = polygons
    dx, dy = x[near] - px[:, None], y[near] - py[:, None]
    d2 = np.where(near < 0, np.inf, dx * dx + dy * dy)
    d2[d2 == 0] = np.inf
    found = []
    for k in range(int(count.max(initial=0))):
        before = edge[np.arange(len(edge)), np.where(k > 0, k - 1, count - 1)]
        r2 = cx[:, k] ** 2 + cy[:, k] ** 2
        row, at = np.nonzero((d2 - 2 * (dx * cx[:, [k]] + dy * cy[:, [k]]) <= (1e-6 * r2 + 1e-6)[:, None]) & (k < count)[:, None])
        other = near[row, at]
        third = (other != edge[row, k]) & (other != before[row])
        found.append((row[third], np.full(third.sum(), k), other[third]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def circles_inside(px, py, cx, cy, box) -> np.ndarray:
    """Whether the circles around the corners, through the point, lie in ``box`` (arrays or numbers; infinite where nothing lies beyond)."""
    r = np.hypot(cx, cy) * (1 + 1e-9)
    column = lambda c: np.asarray(c, float).reshape(-1, 1)
    x, y = cx + px[:, None], cy + py[:, None]
    return ((x - r >= column(box[0])) & (y - r >= column(box[1])) & (x + r <= column(box[2])) & (y + r <= column(box[3]))).all(axis=1)


def cut_cells(x: np.ndarray, y: np.ndarray, asked: np.ndarray, polygons: tuple, exact: float, circles: list | None = None) -> tuple:
    """Polygons (relative to their points: x, y, whose bisector follows, number of corners) of the points ``asked``, cut by all points (x, y); other places only.

    ``circles`` collects ``_on_circles`` of all polygons, by place in ``asked``.
    """
    cx, cy, edge, count = polygons
    low_x, low_y, high_x, high_y = x.min(), y.min(), x.max(), y.max()
    wide, high = max(high_x - low_x, exact), max(high_y - low_y, exact)
    side = max(np.sqrt(wide * high * BUCKET / len(x)), max(wide, high) / len(x), exact)
    nx, ny = int(wide / side) + 1, int(high / side) + 1
    bx, by = np.minimum(((x - low_x) / side).astype(np.int64), nx - 1), np.minimum(((y - low_y) / side).astype(np.int64), ny - 1)
    order = np.argsort(by * nx + bx, kind="stable")
    first = np.searchsorted((by * nx + bx)[order], np.arange(nx * ny + 1))
    todo, ring = np.arange(len(asked)), 2
    while len(todo):
        ix, iy = bx[asked[todo]], by[asked[todo]]
        rows = iy[:, None] + np.arange(-min(ring, ny), min(ring, ny) + 1)
        known = (rows >= 0) & (rows < ny)
        line = np.where(known, rows, 0) * nx
        begin, end = first[line + np.maximum(ix - ring, 0)[:, None]], first[line + np.minimum(ix + ring, nx - 1)[:, None] + 1]
        size = np.where(known, end - begin, 0)
        total = size.sum(axis=1)
        by_size = np.argsort(total, kind="stable")
        limit = lambda i, step, low, most: np.where(i + step < 0 if step < 0 else i + step > most, np.sign(step) * np.inf, low + (i + step + (step > 0)) * side)
        bounds = (limit(ix, -ring, low_x, 0), limit(iy, -ring, low_y, 0), limit(ix, ring, low_x, nx - 1), limit(iy, ring, low_y, ny - 1))
        final, last = np.zeros(len(todo), bool), ring >= max(nx, ny)
        at = 0
        while at < len(by_size):
            many = max(1, HELD // int(total[by_size[at]]))
            many = max(1, min(many, HELD // int(total[by_size[min(at + many, len(by_size)) - 1]])))
            part = by_size[at : at + many]
            at += many
            flat, width = size[part].ravel(), int(total[part].max())
            jump = np.repeat(begin[part].ravel() - (np.cumsum(flat) - flat), flat)
            near = np.full((len(part), width), -1, np.int64)
            near[np.arange(width) < total[part][:, None]] = order[jump + np.arange(len(jump))]
            which = todo[part]
            found = _nearest_first(x[asked[which]], y[asked[which]], x, y, near, (cx[which], cy[which], edge[which], count[which]), exact)
            cx, cy, edge = _wider((cx, cy, edge), found[0].shape[1])
            found = (*_wider(found[:3], cx.shape[1]), found[3])
            for to, some in zip((cx, cy, edge, count), found, strict=True):
                to[which] = some
            final[part] = last | circles_inside(x[asked[which]], y[asked[which]], cx[which], cy[which], tuple(c[part] for c in bounds))
            if circles is not None and len(sure := np.flatnonzero(final[part])):
                row, corner, other = _on_circles(x[asked[which[sure]]], y[asked[which[sure]]], x, y, near[sure], tuple(c[sure] for c in found))
                circles.append((which[sure][row], corner, other))
        if last:
            break
        todo, ring = todo[~final], ring * 2
    return cx, cy, edge, count


def box_polygons(px: np.ndarray, py: np.ndarray, box: tuple[float, float, float, float]):
    x0, y0, x1, y1 = box
    return np.stack([x0 - px, x1 - px, x1 - px, x0 - px], axis=1), np.stack([y0 - py, y0 - py, y1 - py, y1 - py], axis=1), np.full((len(px), 4), -1), np.full(len(px), 4)


def triangulation_parts(x: np.ndarray, y: np.ndarray, own: np.ndarray, seen: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``kind, a, b`` of the edges of all Delaunay polygons around the finished points of a tile, and its unfinished points.

    Coordinates are whole numbers of a small range. The polygons come from the cells; that no point lies in
    a polygon's circle, and which lie on it, is found in whole numbers, and points of which that does not hold are left unfinished.
    Kind 0: side of a polygon, counter-clockwise; 1: edge that cuts one, from its first point (by x, then y).
    """
    asked = np.flatnonzero(own)
    low_x, low_y = x.min(), y.min()
    x, y, seen = x - low_x, y - low_y, (seen[0] - low_x, seen[1] - low_y, seen[2] - low_x, seen[3] - low_y)
    size = max(x.max(), y.max(), 1.0)
    circles: list = []
    cx, cy, edge, count = cut_cells(x, y, asked, box_polygons(x[asked], y[asked], (-size, -size, 2 * size, 2 * size)), EXACT * 4 * size, circles)
    real = np.arange(cx.shape[1]) < count[:, None]
    final = ((edge >= 0) | ~real).all(axis=1) & (count > 2) & circles_inside(x[asked], y[asked], cx, cy, seen)
    wx, wy = x.astype(np.int64), y.astype(np.int64)
    before = np.roll(edge, 1, axis=1)
    before[:, 0] = edge[np.arange(len(edge)), count - 1]

    def relative(i: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return wx[v] - wx[asked[i]], wy[v] - wy[asked[i]]

    i, k = np.nonzero(real & final[:, None])
    (ax, ay), (bx, by) = relative(i, before[i, k]), relative(i, edge[i, k])
    final[i[ax * by - ay * bx <= 0]] = False
    ti, tk, tv = (np.concatenate(c) for c in zip(*circles, strict=True)) if circles else (np.zeros(0, np.int64),) * 3
    sure = final[ti]
    ti, tk, tv = ti[sure], tk[sure], tv[sure]
    (ax, ay), (bx, by), (vx, vy) = relative(ti, before[ti, tk]), relative(ti, edge[ti, tk]), relative(ti, tv)
    within = (ax * by - ay * bx) * (vx * vx + vy * vy) - (ax * vy - ay * vx) * (bx * bx + by * by) + (bx * vy - by * vx) * (ax * ax + ay * ay)  # negative inside
    final[ti[within < 0]] = False
    third = (within == 0) & final[ti]
    ti, tk, tv = ti[third], tk[third], tv[third]
    finished = np.zeros(len(x), bool)
    finished[asked[final]] = True

    # Corners of all polygons, each written by the first of its finished points.
    i, k = np.nonzero(real & final[:, None])
    width = cx.shape[1]
    circle = np.concatenate([i * width + k] * 3 + [ti * width + tk])
    corner = np.concatenate([asked[i], before[i, k], edge[i, k], tv])
    least = np.full(len(asked) * width, len(x))
    np.minimum.at(least, circle, np.where(finished[corner], corner, len(x)))
    mine = least[circle] == asked[circle // width]
    circle, corner = circle[mine], corner[mine]
    ci, ck = circle // width, circle % width
    angle = np.arctan2(y[corner] - y[asked[ci]] - cy[ci, ck], x[corner] - x[asked[ci]] - cx[ci, ck])
    order = np.lexsort((angle, circle))
    circle, corner = circle[order], corner[order]
    start = np.flatnonzero(np.diff(circle, prepend=-1))
    many = np.diff(start, append=len(circle))
    at = np.arange(len(circle)) - np.repeat(start, many)
    follows = corner[np.repeat(start, many) + (at + 1) % np.repeat(many, many)]
    code = wx[corner] * (int(size) + 2) + wy[corner]
    first = np.minimum.reduceat(code, start) if len(start) else code
    root = at[np.flatnonzero(code == np.repeat(first, many))]
    step = (at - np.repeat(root, many)) % np.repeat(many, many)
    inner = (step > 1) & (step < np.repeat(many, many) - 1)
    roots = np.repeat(corner[start + root], many)[inner]
    kind = np.concatenate([np.zeros(len(corner), np.int64), np.ones(len(roots), np.int64)])
    return kind, np.concatenate([corner, roots]), np.concatenate([follows, corner[inner]]), asked[~final]
