"""Connected components of a graph by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.runtime import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, root`` of every vertex that has an edge: root is the least vertex of its component.

    Every vertex points at a smaller one; each round hangs the vertices above a vertex on the
    least of its neighbours, then the vertices below it, so trees grow flat in about log n rounds. A
    round is one written table; minima are aggregated before they are joined back, so a hub is
    a skewed join that adaptive execution splits. Loops only name their vertex; nulls are left out.
    """
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    source = materialize(known.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    now, state = source.where("hi <> lo"), None
    while True:
        ends = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = ends.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("v"), F.least("hi", "m").alias("m"))
        above = ends.where("lo > hi").select(F.col("hi").alias("v"), F.col("lo").alias("hi")).join(least, "v").select("hi", F.col("m").alias("lo")).distinct()
        top = above.groupBy("hi").agg(F.min("lo").alias("m"))
        below = above.join(top, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        step = materialize(below.unionByName(top.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct(), "edges")
        if state is not None:
            discard(before)
        before = now = step
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if new == state:
            break
        state = new
    found = now.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("v"), "root")
    vertices = source.select(F.col("hi").alias("v")).unionByName(source.select(F.col("lo").alias("v"))).distinct()
    return vertices.join(found, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
