"""Pieces of a mask on pixel tables: components labelled in tiles, united over tile borders, holes filled.

An image is a set of rows ``y, x`` with whole places from 0 to 2^31 - 1. Pixels without a row belong to nothing and
hold nothing together. Rows of one place are one pixel, inside the mask if any of them is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.components import connected_components
from cellweave.runtime import discard, materialize

#: Side of a tile in pixels, and the weight of a row in the number of a pixel.
TILE, ROW = 256, 1 << 31


def tile_pieces(value: np.ndarray) -> np.ndarray:
    """For each place of a tile the flat place of the first pixel of its piece; equal values that share a side hang together."""
    runs = np.ones(value.shape, bool)
    runs[:, 1:] = value[:, 1:] != value[:, :-1]
    number = (np.cumsum(runs.ravel()) - 1).reshape(value.shape)
    first = np.flatnonzero(runs.ravel())
    root = list(range(len(first)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    same = value[1:] == value[:-1]
    for a, b in np.unique(np.stack([number[:-1][same], number[1:][same]], axis=1), axis=0).tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    least = np.array([find(i) for i in range(len(root))])
    return first[least[number]]


def pieces(df: DataFrame, mask: str, by: Sequence[str] = ("image",), tile: int = TILE) -> DataFrame:
    """``by.., y, x, mask, piece``: pixels of equal ``mask`` (true or not; null is not) that hang together by their sides.

    ``piece`` is the least ``y * 2^31 + x`` of its pixels. A task labels a tile; only pixels on the borders
    between tiles are joined, and the components of pieces that touch there unite them.
    """
    by = list(by)
    keys = [f"__k{i}" for i in range(len(by))]
    named = df.where("y is not null and x is not null").select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(F.col(mask).cast("boolean"), F.lit(False)).alias("inside"))
    tiled = named.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})

    def label(p: pd.DataFrame) -> pd.DataFrame:
        # A pixel may stand in several rows: inside wins.
        p = p.sort_values("inside", kind="stable").drop_duplicates(["y", "x"], keep="last")
        y, x = p["y"].to_numpy(), p["x"].to_numpy()
        y0, x0 = int(p["ty"].iloc[0]) * tile, int(p["tx"].iloc[0]) * tile
        value = np.full((tile, tile), -1, np.int8)
        value[y - y0, x - x0] = p["inside"].to_numpy().astype(np.int8)
        at = tile_pieces(value)[y - y0, x - x0]
        return p.assign(piece=(y0 + at // tile) * ROW + x0 + at % tile)

    kinds = ", ".join(f"{k} {named.schema[k].dataType.simpleString()}" for k in keys)
    local = materialize(tiled.groupBy(*keys, "ty", "tx").applyInPandas(label, f"{kinds}, y long, x long, inside boolean, ty long, tx long, piece long"), "tiles")
    edges = None
    for a, b in ((0, 1), (1, 0)):  # the last pixels of a tile beside the first of the next
        last = local.where((F.col("x") if b else F.col("y")) % tile == tile - 1)
        first = local.where((F.col("x") if b else F.col("y")) % tile == 0)
        ahead = last.select(*keys, (F.col("y") + a).alias("y"), (F.col("x") + b).alias("x"), "inside", F.col("piece").alias("p"))
        on = ahead.alias("l").join(first.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "y", "x", "inside")])
        ends = lambda piece: F.struct(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(piece).alias("piece"))
        found = on.select(ends("l.p").alias("a"), ends("r.piece").alias("b")).distinct()
        edges = found if edges is None else edges.unionByName(found)
    united = connected_components(edges).select(F.col("v").alias("__v"), F.col("root.piece").alias("__root")).where("v.piece <> root.piece")
    unites = [F.col(k).eqNullSafe(F.col(f"__v.{k}")) for k in keys] + [F.col("piece") == F.col("__v.piece")]
    whole = local.join(united, unites, "left").withColumn("piece", F.coalesce("__root", "piece"))
    return whole.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "y", "x", F.col("inside").alias(mask), "piece")


def _same(left: str, right: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]


def filled(df: DataFrame, mask: str, by: Sequence[str] = ("image",), tile: int = TILE) -> DataFrame:
    """``by.., y, x, mask`` with holes inside: pixels outside the mask that do not hang together with the image's frame.

    The frame is the box of the image's pixels. Only pieces, not pixels, are compared with it.
    """
    by = list(by)
    found = materialize(pieces(df, mask, by, tile), "pieces")
    frame = found.groupBy(*by).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    boxes = found.where(~F.col(mask)).groupBy(*by, "piece").agg(F.min("y").alias("a0"), F.max("y").alias("a1"), F.min("x").alias("b0"), F.max("x").alias("b1"))
    closed = boxes.alias("b").join(frame.alias("f"), _same("b", "f", by)).where("a0 > y0 and a1 < y1 and b0 > x0 and b1 < x1").select(*[F.col(f"b.{c}").alias(c) for c in by], "piece")
    at = found.alias("p").join(closed.alias("h"), _same("p", "h", [*by, "piece"]), "left")
    return at.select(*[F.col(f"p.{c}").alias(c) for c in by], "p.y", "p.x", (F.col(f"p.{mask}") | F.col("h.piece").isNotNull()).alias(mask))


def label_tissue(df: DataFrame, value: str, lower: float, upper: float, by: Sequence[str] = ("image",), tile: int = TILE) -> DataFrame:
    """``by.., y, x, piece`` of the pixels of tissue pieces.

    Tissue are pixels over ``lower`` that hang together with one of at least ``upper``, and the holes within;
    null and not-a-number values are background. Pieces that touch once their holes are filled are one.
    A piece is named by the least ``y * 2^31 + x`` of its pixels.
    """
    by = list(by)
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    places = df.where("y is not null and x is not null").groupBy(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(F.max(F.when(known, F.col(value))).alias("__value"))
    places = materialize(places.withColumn("__over", F.coalesce(F.col("__value") > lower, F.lit(False))), "tissue")
    seen = pieces(places, "__over", by, tile)
    sure = places.where(F.col("__over") & (F.col("__value") >= upper)).select(*by, "y", "x")
    seen = materialize(seen, "pieces")
    seeds = seen.alias("p").join(sure.alias("s"), _same("p", "s", [*by, "y", "x"]), "left_semi").where("__over").select(*by, "piece").distinct()
    kept = seen.alias("p").join(seeds.withColumn("__kept", F.lit(True)).alias("s"), _same("p", "s", [*by, "piece"]), "left")
    mask = kept.select(*[F.col(f"p.{c}").alias(c) for c in by], "p.y", "p.x", (F.col("p.__over") & F.col("__kept").isNotNull()).alias("__tissue"))
    whole = materialize(filled(mask, "__tissue", by, tile), "filled")
    discard(places)
    discard(seen)
    return pieces(whole, "__tissue", by, tile).where("__tissue").select(*by, "y", "x", "piece")


def downscaled(df: DataFrame, side: float, columns: Sequence[str], by: Sequence[str] = ("image",), y: str = "y", x: str = "x") -> DataFrame:
    """``by.., gy, gx, n`` and the means of ``columns`` in squares of ``side``; rows without a place are left out."""
    at = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    return at.groupBy(*by, F.floor(F.col(y) / side).alias("gy"), F.floor(F.col(x) / side).alias("gx")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
