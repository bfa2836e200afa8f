"""Neighbour graph of cells in marker space: many dimensions, approximate, then refined.

1. Random-projection buckets: for each of several trees a point gets a code of
   hyperplane sides and, inside it, a place along a further direction. Points are
   sorted by these and cut into blocks of a fixed size that overlap by half, so no bucket is ever large, however
   dense a part of the space is; all distances inside a block are formed at once.
2. Neighbour-descent rounds: the neighbours of a point, and a bounded sample of the
   points that it is a neighbour of, meet at the point and compare with each other. Only
   pairs that improve a list leave a task. Each round is one join of vectors and one aggregate,
   written to the shared folder.
3. Distances become fuzzy weights: each point's nearest neighbour has weight 1, the
   scale is such that a point's weights add up to log2(k), and the two directions of
   an edge unite as probabilities do.

Distances are sums of squared differences in double precision, the same whichever task
forms them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.runtime import discard, materialize

#: Points of a block, trees, and hyperplanes of a code at most.
BLOCK, TREES, MOST_BITS = 256, 4, 24
#: Rounds of descent at most; they end when fewer than this share of all links still change.
ROUNDS, SETTLED = 6, 0.002
#: Lists that are refined are so many times as long as those asked for; of the points that one is a neighbour of,
#: as many as its list is long take part in a round, expected: a hub has no more.
WIDER = 2
#: Queries and points that are compared at a time by ``exact_neighbours``.
EXACT_BLOCK = 2048

_LIST = "id long, near array<struct<d: double, id: long>>"
_LIST_TYPE = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))


def packed_vectors(df: DataFrame, cell_id: str, vector: str) -> DataFrame:
    """``id, v``: vectors as packed doubles. Rows with a null id, a null vector or one with nulls, NaN or infinity are left out."""
    src = df.select(F.col(f"`{cell_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    # NaN and infinity are no less than the largest double.
    src = src.where("id is not null and v is not null and forall(v, x -> x is not null and abs(x) < double('infinity') and not isnan(x))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["id", "v"])

    return src.mapInArrow(run, "id long, v binary")


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _centre(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and standard deviation of the vectors; the driver gets two vectors a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0.0, 0.0
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary())], names=["n", "s", "q"])

    rows = vectors.select("v").mapInArrow(run, "n long, s binary, q binary").collect()
    n = sum(r["n"] for r in rows)
    if not n:
        return 0, np.zeros(0), np.zeros(0)
    mean = sum(np.frombuffer(r["s"]) for r in rows) / n
    return n, mean, np.sqrt(np.maximum(sum(np.frombuffer(r["q"]) for r in rows) / n - mean * mean, 0))


def _placed(vectors: DataFrame, n: int, mean: np.ndarray, spread: np.ndarray, trees: int, block: int, seed: int) -> DataFrame:
    """``tree, place, id, v``: each point once for each tree, near points at near places mostly."""
    bits = int(np.clip(np.log2(max(n / block, 1)), 0, MOST_BITS))
    random = np.random.default_rng(seed)
    planes = random.standard_normal((trees, bits + 1, len(mean)))
    scale = float(np.sqrt((spread * spread).sum() / max(len(mean), 1))) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (_matrix(batch.column(1)) - mean) / scale if batch.num_rows else np.zeros((0, len(mean)))
            for tree in range(trees):
                p = x @ planes[tree].T
                code = np.zeros(len(x), np.int64)
                for b in range(bits):
                    code = code * 2 + (p[:, b] > 0)
                # A place between 0 and 2**32 along the last direction.
                along = ((np.arctan(p[:, bits]) / np.pi + 0.5) * (2**32 - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array((code << 32) + along), batch.column(0), batch.column(1)], names=["tree", "place", "id", "v"])

    return vectors.select("id", "v").mapInArrow(run, "tree int, place long, id long, v binary")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of squared differences of rows, by the same steps whatever stands beside them."""
    d = a - b
    return (d * d).sum(axis=-1)


def nearest_rows(x: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """The k nearest other rows of each row (distance, id), ties by id."""
    norm = (x * x).sum(axis=1)
    rough = norm[:, None] + norm[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(rough, np.inf)
    n = min(k + 4, len(x) - 1)
    if n <= 0:
        return [[] for _ in ids]
    pick = np.argpartition(rough, n - 1, axis=1)[:, :n]
    d = squared(x[:, None, :], x[pick])
    return [sorted((float(a), int(b)) for a, b in zip(row, ids[p], strict=True) if b != i)[:k] for row, p, i in zip(d, pick, ids, strict=True)]


def _in_blocks(batches: Iterator[pa.RecordBatch], k: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree and place; lists of neighbours inside overlapping blocks."""
    tree, ids, vectors, fresh = None, [], [], 0

    def out() -> pa.RecordBatch:
        found = nearest_rows(np.frombuffer(b"".join(vectors), np.float64).reshape(len(ids), -1), np.array(ids, np.int64), k)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([[{"d": d, "id": i} for d, i in near] for near in found], _LIST_TYPE)], names=["id", "near"])

    for batch in batches:
        for t, i, v in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
            if t != tree:
                if fresh and len(ids) > 1:
                    yield out()
                tree, ids, vectors, fresh = t, [], [], 0
            elif len(ids) == block:
                yield out()
                ids, vectors, fresh = ids[block // 2 :], vectors[block // 2 :], 0
            ids.append(i)
            vectors.append(v)
            fresh += 1
    if fresh and len(ids) > 1:
        yield out()


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The k best different neighbours of each point over all its lists."""
    links = lists.select("id", F.explode("near").alias("x")).where("x.id <> id")
    return links.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("x")), 1, k).alias("near"))


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (centre, member, v, ids, last) sorted by centre; pairs of members that are nearer than the last that one of them has."""
    centre, held = None, {}
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet() -> None:
        ids = np.fromiter(held, np.int64, len(held))
        x = np.frombuffer(b"".join(v for v, _, _ in held.values()), np.float64).reshape(len(ids), -1)
        last = np.fromiter((far for _, _, far in held.values()), float, len(held))
        norm = (x * x).sum(axis=1)
        # Rough distances rule most pairs out; those that may be nearer are formed exactly.
        rough = norm[:, None] + norm[None, :] - 2 * (x @ x.T)
        a, b = np.nonzero(rough < (last * (1 + 1e-9) + 1e-9)[:, None])
        if not len(a):
            return
        width = max(len(own) for _, own, _ in held.values())
        near = np.zeros((len(ids), width), np.int64)
        has = np.zeros((len(ids), width), bool)
        for row, (_, own, _) in enumerate(held.values()):
            near[row, : len(own)] = own
            has[row, : len(own)] = True
        known = ((near[a] == ids[b][:, None]) & has[a]).any(axis=1) | (ids[a] == ids[b])
        a, b = a[~known], b[~known]
        d = squared(x[a], x[b])
        better = d < last[a]
        if better.any():
            found.append((ids[a][better], d[better], ids[b][better]))

    def out() -> pa.RecordBatch:
        a, d, b = (np.concatenate([f[i] for f in found]) for i in range(3))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(d), pa.array(b)], names=["d", "id"]))
        return pa.RecordBatch.from_arrays([pa.array(a), lists], names=["id", "near"])

    for batch in batches:
        lists = batch.column(3)
        flat, edge = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int).tolist()
        for row, (c, m, v, far) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True)):
            if c != centre:
                if len(held) > 1:
                    meet()
                centre, held = c, {}
            held[m] = (v, flat[edge[row] : edge[row + 1]], far)
        if found:
            yield out()
            found.clear()
    if len(held) > 1:
        meet()
    if found:
        yield out()


def marker_neighbours(df: DataFrame, cell_id: str, vector: str, k: int = 10, trees: int = TREES, rounds: int = ROUNDS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """``id, near``: up to ``k`` near other points of each point, an array of (d, id) by squared distance ``d``, ties by id.

    Approximate: tests hold the recall at 0.9 or more. ``vector`` is an array column
    of one length. Rows with a null id or a vector that is null or not finite have no place
    in the graph; ids are unique. A point alone has no row. Other columns are ignored.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = materialize(packed_vectors(df, cell_id, vector), "vectors")
    n, mean, spread = _centre(vectors)
    if not n:
        return df.sparkSession.createDataFrame([], _LIST)
    asked, k = k, k * WIDER
    dealt = _placed(vectors, n, mean, spread, trees, block, seed).withColumn("tie", F.xxhash64("id"))
    # Repeated vectors share a place; the tie parts them between tasks.
    ranged = dealt.repartitionByRange(parts, "tree", "place", "tie").sortWithinPartitions("tree", "place", "tie").drop("tie")
    graph = materialize(_best(ranged.mapInArrow(lambda b: _in_blocks(b, k, block), _LIST), k), "graph")

    for step in range(rounds):
        forward = graph.select(F.col("id").alias("centre"), F.explode("near.id").alias("member"))
        met = forward.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
        chance = F.pmod(F.xxhash64("centre", "member", F.lit(step)), F.lit(1 << 20)) * F.col("n") < k << 20
        reverse = forward.join(met, "member").where(chance).select(F.col("member").alias("centre"), F.col("centre").alias("member"))
        own = graph.select(F.col("id").alias("centre"), F.col("id").alias("member"))
        members = forward.unionByName(reverse).unionByName(own)
        far = F.when(F.size("near") == k, F.element_at("near.d", -1)).otherwise(F.lit(float("inf")))
        points = vectors.join(graph, "id").select(F.col("id").alias("member"), "v", F.col("near.id").alias("ids"), far.alias("last"))
        groups = members.join(points, "member").select("centre", "member", "v", "ids", "last").repartition(parts, "centre").sortWithinPartitions("centre")
        better = materialize(groups.mapInArrow(lambda b: _compare(b, k), _LIST), "better")
        changed = better.count()
        if changed:
            before, graph = graph, materialize(_best(graph.unionByName(better), k), "graph")
            discard(before)
        discard(better)
        if changed <= SETTLED * n * k:
            break
    discard(vectors)
    return graph.select("id", F.slice("near", 1, asked).alias("near"))


def exact_neighbours(df: DataFrame, queries: DataFrame, cell_id: str, vector: str, k: int = 10) -> DataFrame:
    """``id, near`` of a stated set of query points against all points, in blocks: what recall is measured by.

    Rows are left out as by ``marker_neighbours``; a point is no neighbour of itself.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, EXACT_BLOCK):
                part = batch.slice(lo, EXACT_BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b"".join(part.column(1).to_pylist())], pa.binary())], names=["ids", "v"]
                )

    blocks = lambda x: packed_vectors(x, cell_id, vector).mapInArrow(pack, "ids binary, v binary")
    asked = materialize(blocks(queries).withColumn("q", F.monotonically_increasing_id()), "asked")
    # Each block of points meets each block of queries: the product of two short lists of blocks, by an equal key.
    names = asked.agg(F.collect_list("q").alias("qs"))
    met = blocks(df).crossJoin(F.broadcast(names)).select("ids", "v", F.explode("qs").alias("q"))
    both = met.join(asked.select("q", F.col("ids").alias("asked_ids"), F.col("v").alias("asked_v")), "q").repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, own, w in zip(*(batch.column(c).to_pylist() for c in ("ids", "v", "asked_ids", "asked_v")), strict=True):
                ids, own = np.frombuffer(ids, np.int64), np.frombuffer(own, np.int64)
                x, y = np.frombuffer(v).reshape(len(ids), -1), np.frombuffer(w).reshape(len(own), -1)
                near = []
                for i, row in zip(own.tolist(), y, strict=True):
                    d = squared(x, row)
                    d[ids == i] = np.inf
                    n = min(k, len(d))
                    pick = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
                    near.append([{"d": a, "id": b} for a, b in sorted(zip(d[pick].tolist(), ids[pick].tolist(), strict=True))[:n] if a < np.inf])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(near, _LIST_TYPE)], names=["id", "near"])

    return _best(both.mapInArrow(run, _LIST), k)


def fuzzy_weights(graph: DataFrame, k: int) -> DataFrame:
    """``src, dst, weight`` (src below dst) of lists ``id, near``: fuzzy union of both directions.

    A point's weights are exp(-(d - nearest) / scale) of its distances, with the scale that
    makes them add up to log2(k); points whose neighbours are all as near have weight 1 for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            count = np.array([len(x) for x in lists])
            rows = np.full((len(lists), max(count.max(initial=0), 1)), np.inf)
            for row, own in enumerate(lists):
                rows[row, : len(own)] = [o["d"] for o in own]
            weight = scaled_weights(np.sqrt(rows), np.log2(k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, count)), pa.array([o["id"] for own in lists for o in own], pa.int64()), pa.array(weight[np.arange(rows.shape[1])[None, :] < count[:, None]])], names=["a", "b", "w"]
            )

    ways = graph.select("id", "near").mapInArrow(run, "a long, b long, w double")
    united = ways.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("s"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.count(F.lit(1)).alias("n"))
    return united.select("src", "dst", (F.col("s") - F.when(F.col("n") > 1, F.col("lo") * F.col("hi")).otherwise(0.0)).alias("weight"))


def scaled_weights(distances: np.ndarray, target: float) -> np.ndarray:
    """Weights of rows of ascending distances (infinite where there is none)."""
    over = np.maximum(distances - distances[:, :1], 0)
    lo, hi = np.zeros(len(over)), np.full(len(over), np.inf)
    scale = np.ones(len(over))
    for _ in range(64):
        with np.errstate(over="ignore"):
            total = np.exp(-over / scale[:, None]).sum(axis=1)
        high = total > target
        hi, lo = np.where(high, scale, hi), np.where(high, lo, scale)
        scale = np.where(np.isinf(hi), scale * 2, (lo + hi) / 2)
        scale = np.maximum(scale, 1e-12)
    return np.exp(-over / scale[:, None])
