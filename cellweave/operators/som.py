"""Self-organising map of markers: batch training, assignment of cells to nodes, joining of nodes.

An epoch is one pass: a task finds the nearest node of each of its cells and sends on one
sum and one count a node; the driver gets nodes x dimensions numbers, whatever the number of cells, and moves
each node to the mean of the cells around it, weighted by distance on the grid. The neighbourhood
shrinks until only a node's own cells count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.marker_graph import _matrix, packed_vectors, squared
from cellweave.runtime import discard, materialize

#: Cells whose distances to all nodes are held at a time.
_AT_ONCE = 1024


@dataclass
class SelfOrganisingMap:
    """Nodes (row by row of the grid) and the mean squared distance of cells to their nodes after each epoch."""

    width: int
    height: int
    nodes: np.ndarray
    errors: list[float]


def nearest_node(x: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest node of each row, ties by number, and the squared distance."""
    found, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for lo in range(0, len(x), _AT_ONCE):
        d = np.stack([squared(x[lo : lo + _AT_ONCE], node) for node in nodes], axis=1)
        found[lo : lo + _AT_ONCE], far[lo : lo + _AT_ONCE] = d.argmin(axis=1), d.min(axis=1)
    return found, far


def node_sums(vectors: DataFrame, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum and number of the vectors nearest to each node, and the sum of their squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, error = np.zeros_like(nodes), np.zeros(len(nodes)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            own, far = nearest_node(x, nodes)
            np.add.at(sums, own, x)
            count += np.bincount(own, minlength=len(nodes))
            error += far.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(nodes)), pa.int32()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64())), pa.array(count), pa.array([error] + [0.0] * (len(nodes) - 1))], names=["node", "s", "n", "e"])

    size = nodes.shape[1]
    per_task = vectors.select("v").mapInArrow(run, "node int, s array<double>, n double, e double")
    added = [F.sum(F.col("s")[i]) for i in range(size)]
    rows = per_task.groupBy("node").agg(F.array(*added).alias("s"), F.sum("n").alias("n"), F.sum("e").alias("e")).collect()
    sums, count = np.zeros_like(nodes), np.zeros(len(nodes))
    for r in rows:
        sums[r["node"]], count[r["node"]] = r["s"], r["n"]
    return sums, count, float(sum(r["e"] for r in rows))


def grid_weights(width: int, height: int, radius: float) -> np.ndarray:
    """How much cells of one node count for another: exp(-d2 / (2 radius^2)) of squared grid distances; radius 0 parts all nodes."""
    y, x = np.divmod(np.arange(width * height), width)
    d2 = (x[:, None] - x[None, :]) ** 2 + (y[:, None] - y[None, :]) ** 2
    return np.exp(-d2 / (2 * radius * radius)) if radius > 0 else (d2 == 0).astype(float)


def moved_nodes(nodes: np.ndarray, sums: np.ndarray, count: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Nodes after an epoch; one that no cell counts for stays."""
    n = weights @ count
    return np.where(n[:, None] > 0, (weights @ sums) / np.where(n > 0, n, 1)[:, None], nodes)


def first_nodes(vectors: DataFrame, count: int) -> np.ndarray:
    """Different vectors to begin with: those of the least hashes of their ids; fewer cells than nodes stand several times."""
    rows = vectors.dropDuplicates(["v"]).orderBy(F.xxhash64("id"), "id").limit(count).select("v").collect()
    if not rows:
        raise ValueError("a map needs at least one cell with a whole vector")
    return np.stack([np.frombuffer(rows[i % len(rows)]["v"]) for i in range(count)])


def train_som(df: DataFrame, cell_id: str, vector: str, width: int = 10, height: int = 10, epochs: int = 10, radius: float | None = None, nodes: np.ndarray | None = None) -> SelfOrganisingMap:
    """Batch training over all cells. The radius falls from ``radius`` (half the longer side) to 0 in equal steps.

    Rows with a null id or a vector that is null or not finite are left out. ``nodes``: the
    codebook to begin with (vectors of the cells with the least hashes of ids where none is given).
    """
    vectors = materialize(packed_vectors(df, cell_id, vector), "vectors")
    now = first_nodes(vectors, width * height) if nodes is None else np.array(nodes, float)
    radius = max(width, height) / 2 if radius is None else radius
    errors = []
    for epoch in range(epochs):
        sums, count, error = node_sums(vectors, now)
        if epoch:
            errors.append(error / max(count.sum(), 1))
        now = moved_nodes(now, sums, count, grid_weights(width, height, radius * (1 - epoch / max(epochs - 1, 1))))
    _, count, error = node_sums(vectors, now)
    errors.append(error / max(count.sum(), 1))
    discard(vectors)
    return SelfOrganisingMap(width, height, now, errors)


def assign_nodes(df: DataFrame, cell_id: str, vector: str, nodes: np.ndarray, labels: Sequence[int] | None = None) -> DataFrame:
    """``id, node, distance`` (squared) of the nearest node, ties by number; with ``labels`` the node's ``label`` too."""
    named = None if labels is None else np.array(labels, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = nearest_node(_matrix(batch.column(1)), nodes) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            more = [] if named is None else [pa.array(named[own])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(far), *more], names=["id", "node", "distance"] + ["label"] * len(more))

    return packed_vectors(df, cell_id, vector).mapInArrow(run, "id long, node int, distance double" + (", label long" if named is not None else ""))


def join_nodes(nodes: np.ndarray, weights: np.ndarray, groups: int) -> list[int]:
    """Labels 0 .. groups - 1 of nodes by average linkage, numbered by first node; works on the codebook alone.

    ``weights`` counts the cells of each node. Empty nodes join last, to the group of their nearest node.
    """
    label = np.arange(len(nodes))
    d = np.sqrt(squared(nodes[:, None, :], nodes[None, :, :]))
    alive = [int(i) for i in np.flatnonzero(weights > 0)] or [0]
    size = {i: 1.0 for i in alive}
    link = {(i, j): d[i, j] for i in alive for j in alive if i < j}
    while len(alive) > groups:
        a, b = min(link, key=lambda p: (link[p], p))
        for c in alive:
            if c in (a, b):
                continue
            one, two = (min(a, c), max(a, c)), (min(b, c), max(b, c))
            link[one] = (size[a] * link[one] + size[b] * link[two]) / (size[a] + size[b])
        link = {p: v for p, v in link.items() if b not in p}
        size[a] += size.pop(b)
        alive.remove(b)
        label[label == b] = a
    full = np.flatnonzero(weights > 0)
    for i in np.flatnonzero(weights == 0):
        label[i] = label[full[d[i, full].argmin()]] if len(full) else 0
    order = {c: k for k, c in enumerate(dict.fromkeys(label.tolist()))}
    return [order[c] for c in label.tolist()]


def som_clusters(df: DataFrame, cell_id: str, vector: str, groups: int, width: int = 10, height: int = 10, epochs: int = 10) -> DataFrame:
    """``id, node, distance, label``: cells by a trained map whose nodes are joined to ``groups`` groups."""
    trained = train_som(df, cell_id, vector, width, height, epochs)
    vectors = packed_vectors(df, cell_id, vector)
    _, count, _ = node_sums(vectors, trained.nodes)
    return assign_nodes(df, cell_id, vector, trained.nodes, join_nodes(trained.nodes, count, groups))
