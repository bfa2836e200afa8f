"""Pixel tables ``image, y, x, label`` with channel columns: features and spill-over between cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_channels(df: DataFrame, channels: Sequence[str], out: str) -> DataFrame:
    """Pixel-wise maximum of channels."""
    return df.withColumn(out, F.greatest(*[F.col(c) for c in channels]))


def split_compartments(df: DataFrame, whole: str, nucleus: str) -> DataFrame:
    """Add ``cytoplasm``: the whole-cell label where there is no nucleus, else 0."""
    return df.withColumn("cytoplasm", F.when((F.col(whole) != 0) & (F.col(nucleus) == 0), F.col(whole)).otherwise(0))


def label_features(df: DataFrame, channels: Sequence[str], size_over: int = 0, by: Sequence[str] = ("image",)) -> DataFrame:
    """For each label: channel means, centroid, area, axis lengths, eccentricity and box; background is left out."""
    stats = df.where("label <> 0").groupBy(*by, "label").agg(
        *[F.avg(c).alias(c) for c in channels], F.avg("y").alias("y"), F.avg("x").alias("x"), F.count(F.lit(1)).alias("area"),
        F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("vxy"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
    ).where(F.col("area") > size_over)
    vy, vx = F.col("vy") + 1 / 12, F.col("vx") + 1 / 12
    root = F.sqrt((vy - vx) * (vy - vx) + 4 * F.col("vxy") * F.col("vxy"))
    major, minor = 4 * F.sqrt((vy + vx + root) / 2), 4 * F.sqrt(F.greatest(F.lit(0.0), (vy + vx - root) / 2))
    out = stats.withColumn("axis_major_length", major).withColumn("axis_minor_length", minor)
    return out.withColumn("eccentricity", F.sqrt(1 - F.try_divide(F.col("axis_minor_length") * F.col("axis_minor_length"), F.col("axis_major_length") * F.col("axis_major_length")))).drop("vy", "vx", "vxy")


def _shifted(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each pixel's label beside the labels of its four neighbours, by an equi-join on shifted places."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    asked = df.select(*by, "y", "x", F.col("label").alias("own"), steps.alias("s")).select(*by, F.col("y").alias("py"), F.col("x").alias("px"), "own", (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x"))
    return asked.join(df.select(*by, "y", "x", F.col("label").alias("other")), [*by, "y", "x"])


def outlines(df: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """Pixels of a label that touch another label or background inside the image."""
    return _shifted(df, by).where("own <> 0 and own <> other").select(*by, F.col("py").alias("y"), F.col("px").alias("x"), F.col("own").alias("label")).distinct()


def label_perimeters(df: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """``by.., label, perimeter``: length of the line through the centres of a label's border pixels.

    A border pixel has one of four neighbours outside its label. What it adds depends on how many border
    pixels of the label lie straight and aslant beside it. Two shuffles of pixels, no joins.
    """
    at = [*by, "label", "y", "x"]

    def around(pixels: DataFrame, steps: list[tuple[int, int, str]]) -> DataFrame:
        """Each place with whether a pixel is there (``own``) and how many of each kind of step lead to it."""
        kinds = dict.fromkeys(k for _, _, k in steps)
        moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k")) for a, b, k in [(0, 0, "own"), *steps]])
        sent = pixels.select(*at, F.explode(moves).alias("s")).select(*by, "label", (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x"), F.col("s.k").alias("k"))
        return sent.groupBy(*at).agg(*[F.sum((F.col("k") == k).cast("int")).alias(k) for k in ("own", *kinds)]).where("own > 0")

    straight = [(0, 1, "straight"), (0, -1, "straight"), (1, 0, "straight"), (-1, 0, "straight")]
    aslant = [(a, b, "aslant") for a in (-1, 1) for b in (-1, 1)]
    border = around(df.where("label <> 0").select(*at).distinct(), straight).where("straight < 4").select(*at)
    code = F.lit(1) + 2 * F.col("straight") + 10 * F.col("aslant")
    root = 2**0.5
    # What each configuration of neighbours on the border adds.
    length = F.when(code.isin(5, 7, 15, 17, 25, 27), 1.0).when(code.isin(21, 33), root).when(code.isin(13, 23), (1 + root) / 2).otherwise(0.0)
    return around(border, straight + aslant).groupBy(*by, "label").agg(F.sum(length).alias("perimeter"))


def hull_area(rows: list[tuple[int, int, int]]) -> int:
    """Pixels whose centre lies in the convex hull of a label, given as rows ``(y, least x, greatest x)``; pixels are diamonds of half a side."""
    points = sorted({p for y, a, b in rows for p in ((2 * a - 1, 2 * y), (2 * b + 1, 2 * y), (2 * a, 2 * y - 1), (2 * a, 2 * y + 1), (2 * b, 2 * y - 1), (2 * b, 2 * y + 1))})

    def half(order):
        out = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(points) + half(points[::-1])
    ends: dict[int, list[int]] = {}
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ay == by:
            if ay % 2 == 0:
                ends.setdefault(ay, []).append(("lo", -(-min(ax, bx) // 2)))
                ends[ay].append(("hi", max(ax, bx) // 2))
            continue
        if ay > by:
            ax, ay, bx, by = bx, by, ax, ay
        for y in range(ay + ay % 2, by + 1, 2):
            top, low = ax * (by - ay) + (bx - ax) * (y - ay), 2 * (by - ay)
            ends.setdefault(y, []).append(("lo", -(-top // low)))
            ends[y].append(("hi", top // low))
    # On each row the hull reaches from the least crossing to the greatest one.
    return sum(max(0, max(v for k, v in e if k == "hi") - min(v for k, v in e if k == "lo") + 1) for e in ends.values())


def label_hulls(df: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """``by.., label, area, convex_area, solidity``. Only the two ends of each pixel row leave a task; a label's rows meet in a list."""
    rows = df.where("label <> 0").select(*by, "label", "y", "x").distinct().groupBy(*by, "label", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n"))
    shapes = rows.groupBy(*by, "label").agg(F.sum("n").alias("area"), F.collect_list(F.struct(F.col("y").cast("long"), F.col("a").cast("long"), F.col("b").cast("long"))).alias("rows"))

    def hulls(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([hull_area([tuple(r.values()) for r in rows]) for rows in batch.to_pylist()], pa.int64())

    hulls.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = shapes.withColumn("convex_area", F.arrow_udf(hulls, "long")("rows"))
    return out.select(*by, "label", "area", "convex_area", F.try_divide(F.col("area").cast("double"), F.col("convex_area").cast("double")).alias("solidity"))


def adjacency(df: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """``by.., a, b, n``: border contacts between labels, and border pixels of each label as a = b."""
    touch = _shifted(df, by).where("own <> 0 and own <> other")
    contacts = touch.where("other <> 0").groupBy(*by, F.col("own").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    border = touch.select(*by, "py", "px", "own").distinct().groupBy(*by, F.col("own").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return contacts.unionByName(border.select(*by, "a", F.col("a").alias("b"), "n"))


def least_squares(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, b: np.ndarray, steps: int = 0) -> np.ndarray:
    """x of least |A x - b| for a sparse square A, each column of b for itself, by conjugate gradients on A'A.

    Memory and time of a step go with the entries; from x = 0 the solution of least norm is found.
    """
    n = len(b)
    apply = lambda i, j, v: np.stack([np.bincount(i, values * v[j, c], n) for c in range(v.shape[1])], axis=1)
    x, r = np.zeros_like(b), b.copy()
    s = apply(columns, rows, r)
    p, size = s.copy(), (s * s).sum(axis=0)
    limit = size * 1e-26
    for _ in range(steps or 4 * n + 20):
        if (size <= limit).all():
            break
        q = apply(rows, columns, p)
        bottom = (q * q).sum(axis=0)
        step = np.where((bottom > 0) & (size > limit), size / np.where(bottom > 0, bottom, 1), 0)
        x += step * p
        r -= step * q
        s = apply(columns, rows, r)
        new = (s * s).sum(axis=0)
        p = s + np.where(size > 0, new / np.where(size > 0, size, 1), 0) * p
        size = new
    return x


def compensate(df: DataFrame, channels: Sequence[str], by: str = "image") -> DataFrame:
    """Channel means of each label with spill-over from touching labels solved out, never below 0.

    Means and contacts are formed in Spark. The system of an image has one entry for each
    pair of labels that touch, and is solved with those entries only.
    """
    means = df.where("label <> 0").groupBy(by, "label").agg(*[F.avg(c).cast("double").alias(c) for c in channels])
    kind = df.schema["label"].dataType.simpleString()

    def solve(m: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("label").reset_index(drop=True)
        labels = pd.Index(m["label"])
        p, q, n = labels.get_indexer(a["a"]), labels.get_indexer(a["b"]), a["n"].to_numpy(float)
        own = p == q
        border = np.zeros(len(m))
        border[p[own]] = n[own]
        each = np.arange(len(m))
        rows, columns = np.concatenate([p[~own], each]), np.concatenate([q[~own], each])
        values = np.concatenate([n[~own] / (2 * np.maximum(border, 1)[p[~own]]), np.ones(len(m))])
        m[list(channels)] = np.maximum(least_squares(rows, columns, values, m[list(channels)].to_numpy(float)), 0)
        return m

    schema = f"{by} {df.schema[by].dataType.simpleString()}, label {kind}, " + ", ".join(f"`{c}` double" for c in channels)
    contacts = adjacency(df, (by,)).select(F.col(by).alias("__image"), "a", "b", "n")
    return means.groupBy(by).cogroup(contacts.groupBy("__image")).applyInPandas(solve, schema)


def compensate_cells(cells: DataFrame, compensated: DataFrame, channels: Sequence[str], label: str = "label", by: str = "image", overwrite: bool = True) -> DataFrame:
    """Compensated means joined to cells by label: over the markers, or beside them as ``<marker>_compensated``."""
    side = compensated.select(by, F.col("label").alias(label), *[F.col(c).alias(f"{c}_compensated") for c in channels])
    wide = cells.join(side, [by, label], "left")
    if not overwrite:
        return wide
    return wide.select(*[F.coalesce(F.col(f"{c}_compensated"), F.col(c)).alias(c) if c in channels else F.col(c) for c in cells.columns])
