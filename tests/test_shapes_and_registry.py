"""Perimeters and hulls of labels, and kept results."""

import itertools
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from cellweave.operators import pixels
from cellweave.sources.registry import ResultRegistry


def masks(seed):
    """Pixels of a few ragged labels, one of them in pieces, one a single pixel."""
    r = random.Random(seed)
    out = {}
    for label, (cy, cx, k) in enumerate([(10, 10, 6), (10, 30, 4), (30, 12, 8), (30, 33, 1)], 1):
        for y, x in itertools.product(range(cy - k, cy + k + 1), range(cx - k, cx + k + 1)):
            if (y - cy) ** 2 + (x - cx) ** 2 + r.randrange(12) <= k * k:
                out[y, x] = label
    out[30, 33] = 4
    return out


def brute_perimeter(mask, label):
    own = {p for p, v in mask.items() if v == label}
    border = {(y, x) for y, x in own if not {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} <= own}
    total = 0.0
    for y, x in border:
        code = 1
        for a, b in itertools.product((-1, 0, 1), repeat=2):
            if (a or b) and (y + a, x + b) in border:
                code += 10 if a and b else 2
        total += 1.0 if code in (5, 7, 15, 17, 25, 27) else 2**0.5 if code in (21, 33) else (1 + 2**0.5) / 2 if code in (13, 23) else 0.0
    return total


def brute_hull(mask, label):
    own = [p for p, v in mask.items() if v == label]
    points = [p for y, x in own for p in ((2 * x - 1, 2 * y), (2 * x + 1, 2 * y), (2 * x, 2 * y - 1), (2 * x, 2 * y + 1))]
    sides = [(a, b) for a in points for b in points if a != b and all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) >= 0 for c in points)]
    ys, xs = [y for y, _ in own], [x for _, x in own]
    return sum(
        all((b[0] - a[0]) * (2 * y - a[1]) - (b[1] - a[1]) * (2 * x - a[0]) >= 0 for a, b in sides) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1)
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_shapes_equal_brute_force(spark, seed):
    mask = masks(seed)
    rows = [("i", y, x, v, 1) for (y, x), v in mask.items()] + [("i", 99, 99, 0, 1), ("i", *next(iter(mask)), next(iter(mask.values())), 1)]
    df = spark.createDataFrame(rows, "image string, y int, x int, label int, area int").repartition(3)
    got = {r["label"]: r["perimeter"] for r in pixels.label_perimeters(df).collect()}
    assert got.keys() == {1, 2, 3, 4} and all(abs(got[k] - brute_perimeter(mask, k)) < 1e-9 for k in got)
    hulls = {r["label"]: (r["area"], r["convex_area"]) for r in pixels.label_hulls(df).collect()}
    assert hulls == {k: (sum(v == k for v in mask.values()), brute_hull(mask, k)) for k in got}
    assert pixels.label_hulls(df.limit(0)).count() == 0 and pixels.label_perimeters(df.limit(0)).count() == 0


def test_hull_of_known_shapes():
    assert pixels.hull_area([(0, 0, 0)]) == 1
    assert pixels.hull_area([(y, 0, 4) for y in range(3)]) == 15
    assert pixels.hull_area([(0, 0, 0), (4, 0, 8)]) == brute_hull({(0, 0): 1, (4, 0): 1, (4, 8): 1}, 1)


def test_results_are_versioned(spark, tmp_path):
    kept = ResultRegistry(spark, f"file://{tmp_path}/r")
    assert kept.names() == [] and kept.versions("a") == []
    assert kept.save(spark.range(3), "a", "first") == 1
    assert kept.save(spark.range(5).selectExpr("id", "null as odd", "array(id) as `a b`"), "a") == 2
    other = ResultRegistry(spark.newSession(), kept.path)
    assert other.names() == ["a"] and other.versions("a") == [1, 2]
    assert (other.read("a").count(), other.read("a", 1).count(), other.manifest("a", 1)["note"]) == (5, 3, "first")
    assert other.read("a").columns == ["id", "odd", "a b"]
    with pytest.raises(KeyError):
        other.read("a", 3)
    with pytest.raises(ValueError, match="no name"):
        kept.save(spark.range(1), "../b")


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda i: (ResultRegistry(spark, path).save(spark.range(i), "x"), i), range(1, 13)))
    assert sorted(v for v, _ in got) == list(range(1, 13))
    kept = ResultRegistry(spark, path)
    assert all(kept.read("x", v).count() == i for v, i in got)


def test_nothing_is_seen_before_the_commit(spark, tmp_path, monkeypatch):
    kept = ResultRegistry(spark, f"file://{tmp_path}/r")
    monkeypatch.setattr(kept, "_claim", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.save(spark.range(3), "a")
    assert kept.names() == [] and kept.versions("a") == []
