"""Delaunay edges of regions of any size: tiles with halos, certified cells, the rest merged.

1. A region is cut into strips of about equal numbers of cells and these into tiles. A tile's
   task gets the points of the tile and of a margin around it and triangulates them.
2. A triangle whose circumcircle lies in what the task has seen is a triangle of the whole
   region. Points on one circle form one polygon, which is cut by edges from its first
   point (by x, then y), so every task cuts it alike.
3. A point is finished if all polygons around it are certified by the task that owns it. Polygons that no
   owner certifies have unfinished corners only, so they are polygons of the
   triangulation of the unfinished points too: those of the region's outline and around wide gaps, few
   beside the whole. One task a region triangulates them and fills in from the
   borders of the certified polygons.

Coordinates are taken as whole numbers (fractions scaled by a power of two), so all tests are exact.
"""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.cell_cutting import triangulation_parts
from cellweave.operators.geometry import triangulate
from cellweave.runtime import materialize

#: Points of a tile, strips of a region at most, and the margin in sides of a tile.
TILE, MOST_STRIPS, MARGIN = 4000, 64, 0.3
#: Extent of a tile up to which circles of whole coordinates are tested with numbers of 64 bits.
WHOLE = 1 << 14


def whole_points(xs: list[float], ys: list[float]) -> list[tuple[int, int]]:
    """The same places on a grid of whole numbers, exactly."""
    ratios = [(float(x).as_integer_ratio(), float(y).as_integer_ratio()) for x, y in zip(xs, ys, strict=True)]
    scale = max((d for pair in ratios for _, d in pair), default=1)
    return [(a * (scale // b), c * (scale // d)) for (a, b), (c, d) in ratios]


def _on_circle(p: list[tuple[int, int]], a: int, b: int, c: int, d: int) -> bool:
    ax, ay, bx, by, cx, cy = p[a][0] - p[d][0], p[a][1] - p[d][1], p[b][0] - p[d][0], p[b][1] - p[d][1], p[c][0] - p[d][0], p[c][1] - p[d][1]
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx) == 0


def polygons(p: list[tuple[int, int]], triangles: list[tuple[int, int, int]]) -> list[list[int]]:
    """Corners, counter-clockwise, of the triangles united where their corners lie on one circle."""
    side = {}
    for k, (a, b, c) in enumerate(triangles):
        side[a, b], side[b, c], side[c, a] = k, k, k
    group = list(range(len(triangles)))

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for (a, b), k in side.items():
        other = side.get((b, a))
        if a < b and other is not None:
            far = next(v for v in triangles[other] if v not in (a, b))
            if _on_circle(p, *triangles[k], far):
                group[root(k)] = root(other)
    ahead: dict[int, dict[int, int]] = {}
    for (a, b), k in side.items():
        other = side.get((b, a))
        if other is None or root(other) != root(k):
            ahead.setdefault(root(k), {})[a] = b
    out = []
    for steps in ahead.values():
        start = min(steps)
        ring = [start]
        while (v := steps[ring[-1]]) != start:
            ring.append(v)
        out.append(ring)
    return out


def diagonals(p: list[tuple[int, int]], ring: list[int]) -> list[tuple[int, int]]:
    """Edges that cut a polygon, from its first corner."""
    at = min(range(len(ring)), key=lambda i: p[ring[i]])
    return [(ring[at], ring[(at + k) % len(ring)]) for k in range(2, len(ring) - 1)]


def _chain(p: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges of points on one line."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    return list(zip(order, order[1:], strict=False))


def canonical_edges(p: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Edges (smaller number first) of the triangulation in which points on one circle are cut from their first point."""
    rings = polygons(p, triangulate(p))
    found = [e for ring in rings for e in [*zip(ring, ring[1:] + ring[:1], strict=True), *diagonals(p, ring)]] if rings else _chain(p)
    return {(min(e), max(e)) for e in found}


def _reach(p: list[tuple[int, int]], ring: list[int], back: float) -> tuple[float, float, float, float]:
    """A box that holds a polygon's circle, in the units of the data (``back`` for one of the grid)."""
    (ax, ay), (bx, by), (cx, cy) = (p[v] for v in ring[:3])
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    twice = 2 * (bx * cy - by * cx)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b2 - by * c2) / twice, (bx * c2 - cx * b2) / twice
    r = (ux * ux + uy * uy) ** 0.5 * (1 + 1e-9) + abs(ux) * 1e-9 + abs(uy) * 1e-9
    return (ax + ux - r) * back, (ay + uy - r) * back, (ax + ux + r) * back, (ay + uy + r) * back


def tile_rows(xs: list[float], ys: list[float], owned: list[bool], box: tuple[float, float, float, float]) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Edges ``(kind, a, b)`` that a tile certifies, and its unfinished points. Kind 0: side of a polygon, counter-clockwise; 1: edge that cuts one.

    ``box``: what the tile has seen; infinite where nothing lies beyond.
    """
    p = whole_points(xs, ys)
    back = next((x / q for x, (q, _) in zip(xs, p, strict=True) if q), next((y / q for y, (_, q) in zip(ys, p, strict=True) if q), 1.0))
    alone = all(np.isinf(box))
    rings = polygons(p, triangulate(p))
    if not rings:
        if alone:
            return [(1, a, b) for a, b in _chain(p)], []
        return [], [i for i, own in enumerate(owned) if own]
    edges: list[tuple[int, int, int]] = []
    finished = list(owned)
    border: dict[int, int] = {}
    for ring in rings:
        mine = any(owned[v] for v in ring)
        if not mine:
            continue
        for v in ring:
            border[v] = border.get(v, 0) + 1
        x0, y0, x1, y1 = _reach(p, ring, back)
        if alone or (x0 > box[0] and y0 > box[1] and x1 < box[2] and y1 < box[3]):
            edges += [(0, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)] + [(1, a, b) for a, b in diagonals(p, ring)]
        else:
            for v in ring:
                finished[v] = False
    if not alone:  # a point on the outline of what was seen is open to the outside
        sides = {(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)}
        for a, b in sides:
            if (b, a) not in sides:
                finished[a] = finished[b] = False
        for i in range(len(p)):
            if owned[i] and i not in border:
                finished[i] = False
    return edges, [] if alone else [i for i, own in enumerate(owned) if own and not finished[i]]


def merged_rest(p: list[tuple[int, int]], certified: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges of the polygons between certified ones, from all unfinished points and the certified sides between them."""
    triangles = triangulate(p)
    if not triangles:
        return [] if certified else _chain(p)
    side = {}
    for k, (a, b, c) in enumerate(triangles):
        side[a, b], side[b, c], side[c, a] = k, k, k
    todo = [side[b, a] for a, b in certified if (b, a) not in certified and (b, a) in side] if certified else list(range(len(triangles)))
    kept = set(todo)
    while todo:
        a, b, c = triangles[todo.pop()]
        for e in ((b, a), (c, b), (a, c)):
            k = side.get(e)
            if k is not None and e not in certified and k not in kept:
                kept.add(k)
                todo.append(k)
    rings = polygons(p, [triangles[k] for k in kept])
    return [e for ring in rings for e in [*zip(ring, ring[1:] + ring[:1], strict=True), *diagonals(p, ring)]]


def _far(xs: list[float], ys: list[float], a: int, b: int) -> float:
    return ((xs[a] - xs[b]) ** 2 + (ys[a] - ys[b]) ** 2) ** 0.5


def _strips(points: DataFrame, by: list[str], column: str, count, margin: float) -> DataFrame:
    """``by.., low, high, from, to``: arrays of the bounds of strips of a column, and of what their margins hold; written, as sketches come out otherwise when they are merged again."""
    shares = [i / MOST_STRIPS for i in range(1, MOST_STRIPS)]
    found = points.groupBy(*by).agg(F.percentile_approx(column, shares, 10_000).alias("q"), F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    found = found.withColumn("s", F.least(F.greatest(count, F.lit(1)), F.lit(MOST_STRIPS)).cast("int"))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("s") - 1, F.lit(1))), lambda i: F.element_at("q", F.greatest(F.floor(i * MOST_STRIPS / F.col("s")), F.lit(1)).cast("int"))))
    cuts = F.when(F.col("s") > 1, F.filter(cuts, lambda c: c < F.col("hi"))).otherwise(F.array().cast("array<double>"))
    found = found.withColumn("cuts", cuts)
    endless = F.lit(float("inf"))
    edges = found.select(*by, F.concat(F.array("lo"), "cuts").alias("a"), F.concat("cuts", F.array("hi")).alias("b"), F.size("cuts").alias("last"))
    width = lambda a, b: (b - a) * margin
    tiles = F.transform(
        F.arrays_zip("a", "b"),
        lambda t, i: F.struct(
            i.alias("k"),
            F.when(i == 0, -endless).otherwise(t.a).alias("low"), F.when(i == F.col("last"), endless).otherwise(t.b).alias("high"),
            F.when(i == 0, -endless).otherwise(t.a - width(t.a, t.b)).alias("from"), F.when(i == F.col("last"), endless).otherwise(t.b + width(t.a, t.b)).alias("to"),
        ),
    )
    return materialize(edges.select(*by, tiles.alias("tiles")), "strips")


def _dealt(points: DataFrame, strips: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Each point once for each strip that it lies in or beside; ``own`` stays true in its own."""
    met = points.join(strips, by).withColumn("t", F.explode(F.filter("tiles", lambda t: (F.col(column) >= t["from"]) & (F.col(column) <= t["to"]))))
    own = F.col("own") & (F.col(column) > F.col("t.low")) & (F.col(column) <= F.col("t.high"))
    return met.select(*points.columns, own.alias("__own"), F.col("t.k").alias(name), F.col("t.from").alias(f"{name}0"), F.col("t.to").alias(f"{name}1"), F.col("t.low").alias(f"{name}_low"), F.col("t.high").alias(f"{name}_high")).drop("own").withColumnRenamed("__own", "own")


def deal_tiles(points: DataFrame, tile: int, margin: float) -> tuple[DataFrame, DataFrame]:
    """Points with ``key`` (their region as text), and points dealt to the tiles ``key, gx, gy`` that hold or see them; ``own`` stays true in one."""
    points = materialize(points.withColumn("own", F.lit(True)), "points")
    named = points.withColumn("key", F.when(F.col("region").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("region").cast("string"))))
    columns = _strips(named, ["key"], "x", F.ceil(F.sqrt(F.col("n") / F.lit(float(tile)))), margin)
    in_columns = _dealt(named, columns, ["key"], "x", "gx")
    rows = _strips(in_columns.where("own"), ["key", "gx"], "y", F.ceil(F.col("n") / F.lit(float(tile))), margin)
    return named, _dealt(in_columns, rows, ["key", "gx"], "y", "gy")


def delaunay_tiled(points: DataFrame, tile: int = TILE) -> DataFrame:
    """``region, id1, id2, distance`` (id1 < id2) of the Delaunay edges of different places ``region, id, x, y`` (doubles)."""
    region, kind = points.schema["region"].dataType.simpleString(), points.schema["id"].dataType.simpleString()
    named, dealt = deal_tiles(points, tile, MARGIN)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        head = p.iloc[0]
        x, y, box = p["x"].to_numpy(), p["y"].to_numpy(), tuple(head[c] for c in ("gx0", "gy0", "gx1", "gy1"))
        if not np.isinf(box).all() and (x % 1 == 0).all() and (y % 1 == 0).all() and max(np.ptp(x), np.ptp(y)) < WHOLE:
            kind, a, b, rest = triangulation_parts(x, y, p["own"].to_numpy(), box)
            ids = p["id"].to_numpy()
            parts = (np.concatenate([kind, np.full(len(rest), 2)]), np.concatenate([a, rest]), np.concatenate([b, rest]))
            return pd.DataFrame({"key": head["key"], "kind": parts[0], "a": ids[parts[1]], "b": ids[parts[2]], "distance": np.hypot(x[parts[1]] - x[parts[2]], y[parts[1]] - y[parts[2]])})
        found, rest = tile_rows(p["x"].tolist(), p["y"].tolist(), p["own"].tolist(), box)
        ids, xs, ys = p["id"].tolist(), p["x"].tolist(), p["y"].tolist()
        out = [(head["key"], k, ids[a], ids[b], _far(xs, ys, a, b)) for k, a, b in found] + [(head["key"], 2, ids[i], ids[i], 0.0) for i in rest]
        return pd.DataFrame(out, columns=["key", "kind", "a", "b", "distance"])

    found = materialize(dealt.select("key", "gx", "gy", "gx0", "gx1", "gy0", "gy1", "id", "x", "y", "own").groupBy("key", "gx", "gy").applyInPandas(one, f"key string, kind int, a {kind}, b {kind}, distance double"), "tiles")
    edges = found.where("kind < 2").select("key", F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "distance")
    rest = materialize(found.where("kind = 2").select("key", F.col("a").alias("id")), "rest")
    if not rest.isEmpty():
        sides = found.where("kind = 0").select("key", "a", "b").distinct()
        for end in ("a", "b"):
            sides = sides.join(rest.withColumnRenamed("id", end), ["key", end], "left_semi")
        open_points = named.join(rest, ["key", "id"], "left_semi").select("key", F.col("id").alias("a"), F.col("id").alias("b"), "x", "y")
        none = F.lit(None).cast("double")

        def last(p: pd.DataFrame) -> pd.DataFrame:
            at = p[p["x"].notna()].sort_values("a")
            ids, xs, ys = at["a"].tolist(), at["x"].tolist(), at["y"].tolist()
            number = {i: k for k, i in enumerate(ids)}
            sure = p[p["x"].isna()]
            certified = {(number[a], number[b]) for a, b in zip(sure["a"].tolist(), sure["b"].tolist(), strict=True)}
            more = merged_rest(whole_points(xs, ys), certified)
            return pd.DataFrame([(p["key"].iloc[0], min(ids[a], ids[b]), max(ids[a], ids[b]), _far(xs, ys, a, b)) for a, b in more], columns=["key", "id1", "id2", "distance"])

        met = open_points.unionByName(sides.select("key", "a", "b", none.alias("x"), none.alias("y")))
        edges = edges.unionByName(met.groupBy("key").applyInPandas(last, f"key string, id1 {kind}, id2 {kind}, distance double"))
    return edges.distinct().select(F.when(F.col("key") != "0", F.substring("key", F.lit(2), F.length("key"))).cast(region).alias("region"), "id1", "id2", "distance")
