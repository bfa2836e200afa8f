"""Tissue pieces of pixel tables against a flood fill."""

import random

import pytest

from cellweave.operators import raster


def flood(pixels, kind):
    """Least place of the pixels of one kind that hang together."""
    out = {}
    for start in sorted(p for p, v in pixels.items() if v == kind):
        if start in out:
            continue
        out[start], todo = start, [start]
        while todo:
            y, x = todo.pop()
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if pixels.get(q) == kind and q not in out:
                    out[q] = start
                    todo.append(q)
    return out


def tissue(values, lower, upper):
    over = {p: v is not None and v == v and v > lower for p, v in values.items()}
    seen = flood(over, True)
    sure = {seen[p] for p in seen if values[p] >= upper}
    mask = {p: p in seen and seen[p] in sure for p in values}
    ys, xs = [p[0] for p in mask], [p[1] for p in mask]
    outside = flood(mask, False)
    open_ = {r for p, r in outside.items() if p[0] in (min(ys), max(ys)) or p[1] in (min(xs), max(xs))}
    return flood({p: v or outside[p] not in open_ for p, v in mask.items()}, True)


def images():
    r = random.Random(5)
    noise = {(y, x): r.random() for y in range(37) for x in range(41)}
    spiral = {(y, x): 0.0 for y in range(21) for x in range(21)}
    y = x = 10
    dy, dx, length = 0, 1, 2
    for _ in range(9):
        for _ in range(2):
            for _ in range(length):
                spiral[y, x] = 0.6
                y, x = y + dy, x + dx
                if not (0 <= y < 21 and 0 <= x < 21):
                    break
            dy, dx = dx, -dy
        length += 2
        if length > 18:
            break
    spiral[10, 10] = 1.0
    ring = {(y, x): 0.9 if max(abs(y - 12), abs(x - 12)) == 9 or (y, x) == (12, 12) else 0.1 for y in range(25) for x in range(25)}
    gaps = {p: v for p, v in noise.items() if r.random() < 0.8} | {(0, 0): None, (5, 5): float("nan")}
    return {"noise": noise, "spiral": spiral, "ring": ring, None: gaps, "one": {(3, 4): 1.0}}


@pytest.mark.parametrize("tile", [7, 256])
def test_tissue_pieces(spark, tile):
    given = images()
    rows = [(k, y, x, v) for k, image in given.items() for (y, x), v in image.items()]
    rows += rows[:50] + [("noise", None, 3, 1.0)]
    df = spark.createDataFrame(rows, "image string, y int, x int, c double").withColumnRenamed("image", "slide").repartition(3)
    got = {(r["slide"], r["y"], r["x"]): divmod(r["piece"], raster.ROW) for r in raster.label_tissue(df, "c", 0.45, 0.8, ["slide"], tile).collect()}
    want = {(k, *p): root for k, image in given.items() for p, root in tissue(image, 0.45, 0.8).items()}
    assert got == want
    assert ("ring", 12, 12) in got and got["ring", 5, 5] == got["ring", 3, 3]
    assert raster.label_tissue(df.limit(0), "c", 0.45, 0.8, ["slide"], tile).count() == 0


def test_downscaled(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, 3.0), ("a", 2, 0, 5.0), ("a", None, 0, 9.0)], "image string, y int, x int, c double")
    assert sorted(tuple(r) for r in raster.downscaled(df, 2, ["c"]).collect()) == [("a", 0, 0, 2, 2.0), ("a", 1, 0, 1, 5.0)]
