"""Communities of a weighted graph by modularity: moves inside vertex blocks, refinement, merging.

1. Vertices are cut into blocks of bounded size along a ``place`` (any number that is alike for
   vertices near each other; a hash where none is given). A task moves the vertices of its
   blocks one by one to the community that adds most to the modularity, until
   none wants to move; communities stay inside the block. No labels travel meanwhile.
2. Two exchanges: tasks get the labels across their borders and the weights of all
   communities, and move their vertices again, across borders to lower labels first, then to higher ones.
3. Refinement: inside each community of a block vertices join parts that hang together well;
   every part is connected. Parts become the vertices of the next level, which starts from the
   communities found.
4. A level that fits in one block is the last: there the same steps go on until nothing changes, and
   communities that do not hang together are cut apart, which never lowers the modularity. As parts are
   connected, so are the communities.

Each level is a fixed number of jobs, whatever the number of moves. A block's graph is packed into a few rows of arrays once; steps send these
and the labels of borders to tasks, no edges. A level's merged edges are made where its parts are.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.components import connected_components
from cellweave.runtime import discard, materialize

#: Vertices and edges (both directions) of a block.
BLOCK_VERTICES, BLOCK_EDGES = 25_000, 400_000
#: Blocks that a task takes, one after the other.
TASK_BLOCKS = 8
_GAIN = 1e-10
#: Rows of a block: its graph (ids, where each vertex's neighbours begin, neighbours, weights), its border to another block (own
#: vertices, number of foreign ones), labels (own, foreign), what another block told it, strengths of communities, what came of a step.
GRAPH, BORDER, LABELS, TOLD, TOTALS, MOVED = range(6)
ROWS = "block int, kind int, other int, p binary, q binary, r binary, s binary, label long, k double"
#: Rows of a level that is merged.
EDGE, MEMBER, VERTEX = range(3)


class Part:
    """Vertices of one task as arrays: neighbours by number, the foreign ones fixed.

    ``strength`` is a vertex's weight of ends over the whole graph, ``outside`` maps a
    community to the strength that it has outside these vertices.
    """

    def __init__(self, n: int, first: np.ndarray, to: np.ndarray, w: np.ndarray, strength: list[float], total: float, resolution: float):
        self.n, self.strength, self.rate = n, strength, resolution / total if total else 0.0
        self.first, self.to, self.weight = first.tolist(), to.tolist(), w.tolist()

    def move(self, label: list, tot: dict, way: int, begin: list[int] | None = None) -> int:
        """Let vertices take the best label around them until none moves.

        ``label`` holds the labels of own vertices and, behind them, of foreign neighbours. ``tot``
        is the strength of each community. With ``way`` 0 only labels of own vertices count. Else a foreign label is
        taken only if it is below (-1) or above (1) the vertex's own, so that two blocks which move at
        once do not change places. ``begin`` names the vertices that may want to move at first, all by default. Returns the
        number of moves, -1 if the guard ended them.
        """
        first, to, weight, strength, n = self.first, self.to, self.weight, self.strength, self.n
        queue, waiting, moves = deque(range(n) if begin is None else begin), bytearray(n), 0
        for v in queue:
            waiting[v] = 1
        mine = set(label[:n])
        most = 50 * n + 1000  # moves of single vertices raise the modularity, so this is only a guard
        while queue and moves < most:
            v = queue.popleft()
            waiting[v] = 0
            c, k = label[v], strength[v]
            near: dict = {}
            for e in range(first[v], first[v + 1]):
                u = to[e]
                if u != v and (u < n or way):
                    near[label[u]] = near.get(label[u], 0.0) + weight[e]
            tot[c] -= k
            k *= self.rate
            best, gain = c, near.get(c, 0.0) - k * tot[c] + _GAIN
            for d, w in near.items():
                g = w - k * tot[d]
                if (g > gain or (g == gain and d < best)) and (not way or (d - c) * way > 0 or d in mine):
                    best, gain = d, g
            tot[best] += strength[v]
            if best != c:
                label[v] = best
                mine.add(best)
                moves += 1
                for e in range(first[v], first[v + 1]):
                    u = to[e]
                    if u < n and not waiting[u] and label[u] != best:
                        waiting[u] = 1
                        queue.append(u)
        return -1 if queue else moves

    def refine(self, label: list, tot: dict) -> list[int]:
        """Connected parts of communities among own vertices, each named by a vertex of it.

        A vertex that still stands alone joins the part of its community that gains most, if both hang
        together with the rest of the community as well as chance would have it.
        """
        first, to, weight, strength, n, rate = self.first, self.to, self.weight, self.strength, self.n, self.rate
        part, size, held = list(range(n)), [1] * n, list(strength)
        out = [0.0] * n  # weight from a part to the rest of its community
        for v in range(n):
            out[v] = sum(weight[e] for e in range(first[v], first[v + 1]) if to[e] != v and label[to[e]] == label[v])
        for v in range(n):
            k, whole = strength[v], tot[label[v]]
            if size[part[v]] != 1 or part[v] != v or out[v] < rate * k * (whole - k) - _GAIN:
                continue
            near: dict[int, float] = {}
            for e in range(first[v], first[v + 1]):
                u = to[e]
                if u < n and u != v and label[u] == label[v]:
                    near[part[u]] = near.get(part[u], 0.0) + weight[e]
            best, gain = -1, _GAIN
            for p, w in near.items():
                g = w - rate * k * held[p]
                if (g > gain or (g == gain and p < best)) and p != v and out[p] >= rate * held[p] * (whole - held[p]) - _GAIN:
                    best, gain = p, g
            if best >= 0:
                part[v] = best
                size[v], size[best] = 0, size[best] + 1
                out[best] += out[v] - 2 * near[best]
                held[best] += k
        return part


def _rowwise(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each vertex's neighbours begin, the neighbours and weights."""
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)), b[order], w[order]


def _merge(a: np.ndarray, b: np.ndarray, w: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (both directions) between the vertices that ``names`` maps to."""
    wide = int(names.max()) + 1 if len(names) else 1
    key, back = np.unique(names[a] * wide + names[b], return_inverse=True)
    return key // wide, key % wide, np.bincount(back, w, len(key))


def whole_communities(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, start: np.ndarray, total: float, resolution: float) -> np.ndarray:
    """Communities (numbers) of a graph held in one task; edges stand in both directions, loops with twice their weight.

    Moves, refinement and merging go on until a level changes nothing; then communities
    are cut into their connected pieces.
    """
    n = len(ids)
    top = np.arange(n)  # the vertex of the present level that holds each vertex
    label = np.unique(start, return_inverse=True)[1].tolist()
    x, y, z, size = a, b, w, n
    while True:
        strength = np.bincount(x, z, size).tolist()
        part = Part(size, *_rowwise(size, x, y, z), strength, total, resolution)
        tot: dict = {}
        for c, k in zip(label, strength, strict=True):
            tot[c] = tot.get(c, 0.0) + k
        part.move(label, tot, 0)
        names, small = np.unique(part.refine(label, tot), return_inverse=True)
        if len(names) == size:
            break
        top = small[top]
        label = [label[i] for i in names.tolist()]
        label = np.unique(label, return_inverse=True)[1].tolist()
        x, y, z = _merge(x, y, z, small)
        size = len(names)
    found = np.array(label)[top]
    return _pieces(n, a, b, found)


def _pieces(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least vertex of each vertex's connected piece inside its community."""
    inside = label[a] == label[b]
    a, b = a[inside], b[inside]
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def _last(batches: Iterator[pa.RecordBatch], total: float, resolution: float) -> Iterator[pa.RecordBatch]:
    """Step 4: rows (src, dst, weight, c1, c2), the whole level."""
    cols = [np.concatenate(x) if x else np.zeros(0) for x in zip(*([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)] for batch in batches), strict=True)]
    if not cols or not len(cols[0]):
        return
    ids, number = np.unique(np.concatenate(cols[:2]), return_inverse=True)
    m = len(cols[0])
    start = np.zeros(len(ids), np.int64)
    start[number[:m]], start[number[m:]] = cols[3], cols[4]
    loop = number[:m] == number[m:]
    a, b = np.concatenate([number[:m], number[m:][~loop]]), np.concatenate([number[m:], number[:m][~loop]])
    w = np.concatenate([np.where(loop, 2, 1) * cols[2], cols[2][~loop]])
    found = whole_communities(ids, a, b, w, start, total, resolution)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[found])], names=["id", "community"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, a, b, other, w, la, lb) sorted by block, an edge for each block that an end lies in, to the rows of each block.

    Neighbours in other blocks are numbered behind the own vertices, by block and id. Both blocks see the same
    edges, so the labels that one tells of its border (by id) fill the places that the other keeps for them.
    """

    def out(cols: list[np.ndarray], block: int) -> pa.RecordBatch:
        a, b, other, w, la, lb = cols
        inner = other == block
        ids, at = np.unique(np.concatenate([a, b[inner]]), return_index=True)
        label, n = np.concatenate([la, lb[inner]])[at], len(ids)
        x, y = np.searchsorted(ids, a), np.empty(len(a), np.int64)
        y[inner] = np.searchsorted(ids, b[inner])
        far = np.flatnonzero(~inner)
        far = far[np.lexsort((b[far], other[far]))]
        new = np.ones(len(far), bool)
        new[1:] = (b[far][1:] != b[far][:-1]) | (other[far][1:] != other[far][:-1])
        y[far] = n + np.cumsum(new) - 1
        seen = far[new]
        back = inner & (x != y)
        first, to, weight = _rowwise(n, np.concatenate([x, y[back]]), np.concatenate([y, x[back]]), np.concatenate([np.where(inner & (x == y), 2.0, 1.0) * w, w[back]]))
        rows = [(GRAPH, 0, ids, first.astype(np.int32), to.astype(np.int32), weight), (LABELS, 0, label, lb[seen], None, None)]
        for o in np.unique(other[seen]):
            rows.append((BORDER, int(o), np.unique(x[far][other[far] == o]).astype(np.int32), np.array([(other[seen] == o).sum()], np.int32), None, None))
        return _batch([(block, *r) for r in rows])

    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        for lo, hi in _cuts(cols[0]):
            if cols[0][lo] != at:
                if held:
                    yield out([np.concatenate(c) for c in zip(*held, strict=True)], at)
                at, held = int(cols[0][lo]), []
            held.append([c[lo:hi] for c in cols[1:]])
    if held:
        yield out([np.concatenate(c) for c in zip(*held, strict=True)], at)


def _cuts(blocks: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
    return list(zip(edges, edges[1:], strict=False))


def _batch(rows: list[tuple], sums: tuple = ((), (), ())) -> pa.RecordBatch:
    """Rows (block, kind, other, p, q, r, s) of arrays, and rows of totals: blocks, labels, weights."""
    m = len(sums[0])
    ints = lambda i, rest: pa.array([x[i] for x in rows] + list(rest), pa.int32())
    data = [pa.array([None if x[i] is None else x[i].tobytes() for x in rows] + [None] * m, pa.binary()) for i in (3, 4, 5, 6)]
    none = [None] * len(rows)
    return pa.RecordBatch.from_arrays(
        [ints(0, sums[0]), ints(1, [TOTALS] * m), ints(2, [0] * m), *data, pa.array(none + list(sums[1]), pa.int64()), pa.array(none + list(sums[2]), pa.float64())],
        names=["block", "kind", "other", "p", "q", "r", "s", "label", "k"],
    )


class Block:
    """A block as its rows tell: graph, border of each block around, labels of own vertices and of those across the borders."""

    def __init__(self, number: int, rows: list[tuple], totals: list[tuple]):
        rows.sort(key=lambda r: r[:2])
        self.number, self.border, size = number, {}, {}
        told = {}
        for kind, other, p, q, r, s in rows:
            if kind == GRAPH:
                self.ids, self.first, self.to, self.weight = np.frombuffer(p, np.int64), np.frombuffer(q, np.int32), np.frombuffer(r, np.int32), np.frombuffer(s, np.float64)
            elif kind == BORDER:
                self.border[other], size[other] = np.frombuffer(p, np.int32), int(np.frombuffer(q, np.int32)[0])
            elif kind == LABELS:
                self.label, self.foreign = np.frombuffer(p, np.int64), np.frombuffer(q, np.int64).copy()
            elif kind == TOLD and (other not in told or told[other][1] < int.from_bytes(q, "little")):
                told[other] = np.frombuffer(p, np.int64), int.from_bytes(q, "little")  # the last that it told
            elif kind == MOVED:
                self.moved = np.frombuffer(p, np.int64)
        at, self.owner = 0, np.repeat(list(size), list(size.values())).astype(np.int64)
        for other, many in size.items():
            if other in told:
                self.foreign[at : at + many] = told[other][0]
            at += many
        self.n = len(self.ids)
        self.row = np.repeat(np.arange(self.n), np.diff(self.first))
        self.k = np.bincount(self.row, self.weight, self.n)
        self.tot = {}
        for names, weights in totals:
            self.tot.update(zip(names.tolist(), weights.tolist(), strict=True))

    def part(self, total: float, resolution: float) -> Part:
        return Part(self.n, self.first, self.to, self.weight, self.k.tolist(), total, resolution)

    def said(self, label: np.ndarray, step: int, news: bool = False) -> list[tuple]:
        """Rows of the block's labels, and of what it tells the blocks around (with ``news`` only those for which something changed)."""
        rows = [(self.number, LABELS, 0, label, self.foreign, None, None)]
        for other, own in self.border.items():
            if not news or (label[own] != self.label[own]).any():
                rows.append((other, TOLD, self.number, label[own], np.array([step], np.int64), None, None))
        return rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of rows sorted by block."""
    at, rows, totals = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds, names, weights = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 7, 8))
        for lo, hi in _cuts(batch.column(0).to_numpy()):
            if batch.column(0)[lo].as_py() != at:
                if rows:
                    yield Block(at, rows, totals)
                at, rows, totals = batch.column(0)[lo].as_py(), [], []
            sums = kinds[lo:hi] == TOTALS
            for i in (np.flatnonzero(~sums) + lo).tolist():
                rows.append((int(kinds[i]), *(batch.column(c)[i].as_py() for c in range(2, 7))))
            if sums.any():
                totals.append((names[lo:hi][sums].astype(np.int64), weights[lo:hi][sums]))
    if rows:
        yield Block(at, rows, totals)


def _moved(batches: Iterator[pa.RecordBatch], total: float, resolution: float, way: int) -> Iterator[pa.RecordBatch]:
    """Steps 1 (``way`` 0) and 2 (-1, then 1), with 3 after the last, when parts are told instead of labels."""
    for block in _blocks(batches):
        part, label = block.part(total, resolution), block.label.tolist() + block.foreign.tolist()
        tot = block.tot
        if not way:
            tot = dict.fromkeys(label, 0.0)
            for c, k in zip(label, block.k.tolist(), strict=False):
                tot[c] += k
        part.move(label, tot, way)
        found = np.array(label[: block.n], np.int64)
        if way == 1:
            # Parts are named by their least vertex, so the name of a part is a vertex of it.
            parts, least = np.array(part.refine(label, tot)), np.full(block.n, np.iinfo(np.int64).max)
            np.minimum.at(least, parts, block.ids)
            yield _batch([*block.said(least[parts], 1), (block.number, MOVED, 0, found, None, None, None)])
            continue
        names, at = np.unique(found, return_inverse=True)
        yield _batch(block.said(found, way), ([block.number] * len(names), names.tolist(), np.bincount(at, block.k).tolist()))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``label, block, k``: strengths of communities in blocks, and communities that blocks are told of."""
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        own = batch.filter(pa.array(kinds == TOTALS))
        yield pa.RecordBatch.from_arrays([own.column(7), own.column(0), own.column(8)], names=["label", "block", "k"])
        for i in np.flatnonzero(kinds == TOLD).tolist():
            names = np.unique(np.frombuffer(batch.column(3)[i].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), batch.column(0)[i].as_py(), np.int32)), pa.array(np.zeros(len(names)))], names=["label", "block", "k"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, a, b, w) of the next level: edges between parts (each once), the part of each vertex, the label and block of each part."""
    for block in _blocks(batches):
        part, all_parts = block.label, np.concatenate([block.label, block.foreign])
        # The block of the lower number lists the edges to another.
        up = np.concatenate([np.ones(block.n, bool), block.owner > block.number])[block.to]
        a, b = part[block.row], all_parts[block.to]
        keep = up & ((a <= b) | (block.to >= block.n))
        a, b, w = np.minimum(a, b)[keep], np.maximum(a, b)[keep], np.where(a == b, 0.5, 1.0)[keep] * block.weight[keep]
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        a, b, w = a[new], b[new], np.add.reduceat(w, new) if len(a) else w
        names, at = np.unique(part, return_index=True)
        cols = [
            np.concatenate([np.full(len(a), EDGE), np.full(block.n, MEMBER), np.full(len(names), VERTEX)]).astype(np.int32),
            np.concatenate([a, block.ids, names]), np.concatenate([b, part, block.moved[at]]), np.concatenate([w, np.zeros(block.n), np.full(len(names), float(block.number))]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "a", "b", "w"])


def _packed(graph: DataFrame, vertices: DataFrame, count: int, ends: int) -> tuple[DataFrame, int]:
    """A level's graph in rows of blocks, and the number of tasks that take a few blocks each. ``vertices``: id, place and, beyond the first level, label."""
    blocks, number = _block_number(vertices, count, ends)
    tasks = max(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // TASK_BLOCKS))
    known = vertices.select("id", number.cast("int").alias("block"), *(["label"] if "label" in vertices.columns else []))
    side = lambda id, block, label: known.withColumnsRenamed({"id": id, "block": block, "label": label})
    both = graph.join(side("src", "sb", "sl"), "src").join(side("dst", "db", "dl"), "dst")
    sl, dl = ("sl", "dl") if "label" in known.columns else ("src", "dst")
    turn = lambda *c: F.struct(*[F.col(x).alias(y) for x, y in zip(c, ("block", "a", "b", "other", "la", "lb"), strict=True)])
    one, two = turn("sb", "src", "dst", "db", sl, dl), turn("db", "dst", "src", "sb", dl, sl)
    rows = both.select(F.explode(F.when(F.col("sb") == F.col("db"), F.array(one)).otherwise(F.array(one, two))).alias("e"), "weight")
    rows = rows.select("e.block", "e.a", "e.b", "e.other", "weight", "e.la", "e.lb").repartition(tasks, "block").sortWithinPartitions("block")
    return materialize(rows.mapInArrow(_pack, ROWS), "blocks"), tasks


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, "block").sortWithinPartitions("block")


def _level(packed: DataFrame, tasks: int, total: float, resolution: float) -> DataFrame:
    """One level in blocks: rows of ``_merged``."""
    graph = packed.where(F.col("kind").isin(GRAPH, BORDER))
    now = packed.where(F.col("kind") == LABELS)
    for way in (0, -1, 1):
        step = materialize(_dealt(graph.unionByName(now), tasks).mapInArrow(lambda b, way=way: _moved(b, total, resolution, way), ROWS), "moved")
        if way:
            discard(before)
        before, now = step, step.where(F.col("kind") != TOTALS)
        if way < 1:
            wanted = step.where(F.col("kind").isin(TOTALS, TOLD)).mapInArrow(_wanted, "label long, block int, k double")
            sums = wanted.groupBy("label").agg(F.sum("k").alias("k"), F.collect_set("block").alias("block")).withColumn("block", F.explode("block"))
            now = now.unionByName(sums.withColumn("kind", F.lit(TOTALS)).withColumn("other", F.lit(0)), allowMissingColumns=True)
    out = materialize(_dealt(graph.unionByName(now), tasks).mapInArrow(_merged, "kind int, a long, b long, w double"), "level")
    discard(before)
    return out


def _prepared(edges: DataFrame, places: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Edges ``src, dst, weight`` (src up to dst, once) and vertices ``id, place``."""
    known = edges.where("src is not null and dst is not null and weight is not null")
    graph = materialize(known.groupBy(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).agg(F.sum(F.col("weight").cast("double")).alias("weight")), "graph")
    vertices = graph.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    hashed = (F.xxhash64("id") / F.lit(2.0**63)).alias("place")
    if places is None:
        vertices = vertices.select("id", hashed)
    else:
        vertices = vertices.join(places.select(F.col("id").cast("long").alias("id"), F.col("place").cast("double").alias("__place")), "id", "left").select("id", F.coalesce("__place", hashed).alias("place"))
    return graph, materialize(vertices, "vertices")


def _block_number(vertices: DataFrame, count: int, ends: int):
    """Number of blocks, and the column of the block that a vertex's place lies in."""
    blocks = int(max(-(-count // BLOCK_VERTICES), -(-ends // BLOCK_EDGES), 1))
    cuts = vertices.agg(F.percentile_approx("place", [i / blocks for i in range(1, blocks)], 10_000).alias("c")).first()["c"] if blocks > 1 else []
    return blocks, F.size(F.filter(F.lit(np.array(sorted(set(cuts)), float)), lambda c: c < F.col("place"))) if cuts else F.lit(0)


def _spread(batches: Iterator[pa.RecordBatch], way: int, step: int) -> Iterator[pa.RecordBatch]:
    """Each block's vertices take the heaviest label around them until none moves; it tells only what changed, and how often its vertices moved."""
    for block in _blocks(batches):
        part, label = block.part(0.0, 0.0), block.label.tolist() + block.foreign.tolist()
        # After the first step only vertices at a border may want to move; the others followed when their neighbours did.
        begin = np.unique(block.row[block.to >= block.n]).tolist() if step else None
        moves = part.move(label, dict.fromkeys(label, 0.0), way, begin)
        yield _batch([*block.said(np.array(label[: block.n], np.int64), step, True), (block.number, MOVED, moves if abs(moves) < 1 << 31 else 1, None, None, None, None)])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(block.label)], names=["id", "community"])


def heaviest_labels(edges: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """``id, community``: every vertex has the heaviest label around it (its own on ties), from a label of its own at first.

    Vertices move inside blocks until none wants to; then blocks exchange the labels of their borders, and in turn take only lower and only
    higher ones across them, until every vertex is content. A block is asked again only if its last moves were the other way
    or labels around it changed; the driver keeps that list of blocks, nothing of their vertices. From the eighth round on fewer
    blocks move at a time. Edges and ``places`` as in ``leiden_communities``.
    """
    graph, vertices = _prepared(edges, places)
    packed, tasks = _packed(graph, vertices, vertices.count(), 2 * graph.count())
    discard(graph)
    discard(vertices)
    whole, now, step = packed.where(F.col("kind").isin(GRAPH, BORDER)), packed.where(F.col("kind") == LABELS), 0
    restless = {r[0]: {-1, 1} for r in now.select("block").collect()}
    while any(restless.values()):
        turn, way = 1 + step // 8, -1 if step % 2 == 0 else 1
        asked = sorted(b for b, ways in restless.items() if way in ways and int(_mixed(b, step // 2)) % turn == 0)
        step += 1
        if not asked:
            continue
        of = F.col("block").isin(asked) if len(asked) < len(restless) else F.lit(True)
        moved = materialize(_dealt(whole.where(of).unionByName(now.where(of)), min(tasks, len(asked))).mapInArrow(lambda b, way=way, step=step - 1: _spread(b, way, step), ROWS), "moved")
        for block, moves in moved.where(F.col("kind") == MOVED).select("block", "other").collect():
            restless[block] = (restless[block] - {way}) | ({-way} if moves else set()) | ({way} if moves < 0 else set())
        for (block,) in moved.where(F.col("kind") == TOLD).select("block").distinct().collect():
            restless[block] = {-1, 1}
        before, now = now, materialize(now.where(~of).unionByName(moved.where(F.col("kind") != MOVED)), "labels")
        discard(before)
        discard(moved)
    found = materialize(_dealt(whole.unionByName(now), tasks).mapInArrow(_listed, "id long, community long"), "found")
    discard(packed)
    discard(now)
    return found


def _mixed(block: int, step: int) -> int:
    """Hash that deals blocks to turns."""
    x = (block * 2_654_435_761 + step * 73_244_475) & (2**32 - 1)
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73_244_475) & (2**32 - 1)
    return x ^ (x >> 16)


class Prepared:
    """A graph made ready for ``leiden_communities``: edges, vertices and their first blocks, which all resolutions share."""

    def __init__(self, edges: DataFrame, places: DataFrame | None = None):
        self.graph, self.vertices = _prepared(edges, places)
        size = self.graph.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
        self.ends, self.total, self.count = size["n"], 2 * (size["w"] or 0.0), self.vertices.count()
        self.packed = _packed(self.graph, self.vertices, self.count, 2 * self.ends) if self.count > BLOCK_VERTICES or 2 * self.ends > BLOCK_EDGES else None


def leiden_communities(edges: DataFrame | Prepared, resolution: float = 1.0, places: DataFrame | None = None) -> DataFrame:
    """``id, community`` of a weighted undirected graph ``src, dst, weight`` (whole numbers as vertices, weights above 0).

    Every community is connected; it is named by its least vertex. Repeated edges and both
    directions add up; loops count once. Rows with a null end or weight are left out. ``places`` (id, place) tells
    which vertices are near each other and only serves speed; vertices without a place go by a hash.
    """
    ready = edges if isinstance(edges, Prepared) else Prepared(edges, places)
    graph, vertices, count, ends, total, packed = ready.graph, ready.vertices.withColumn("label", F.col("id")), ready.count, ready.ends, ready.total, ready.packed
    members, levels, stalled = [], [], 0
    while count > BLOCK_VERTICES or 2 * ends > BLOCK_EDGES:
        if levels:
            packed = _packed(graph, vertices, count, 2 * ends)
        level = _level(*packed, total, resolution)
        if levels or not isinstance(edges, Prepared):
            discard(packed[0])
        levels.append(level)
        rows = lambda kind, *names, level=level: level.where(F.col("kind") == kind).select(*[F.col(c).alias(n) for c, n in zip("abw", names, strict=False)])
        graph, up = rows(EDGE, "src", "dst", "weight"), rows(VERTEX, "id", "label", "block")
        members.append(rows(MEMBER, "id", "part"))
        # Parts of one community stand at one place, so that they meet in a block of the next level.
        met = up.groupBy("label").agg(F.min("block").alias("place"))
        old, vertices = vertices, materialize(up.drop("block").join(met, "label"), "vertices")
        discard(old)  # those of the first level stay, which have no label of their own
        before, count, ends = count, vertices.count(), graph.count()
        stalled = stalled + 1 if count > 0.98 * before else 0
        if stalled == 2:
            break
    label = vertices.select("id", "label")
    ended = graph.join(label.withColumnsRenamed({"id": "src", "label": "c1"}), "src").join(label.withColumnsRenamed({"id": "dst", "label": "c2"}), "dst").select("src", "dst", "weight", "c1", "c2")
    if count > BLOCK_VERTICES or 2 * ends > BLOCK_EDGES:
        # Merging has come to its end with many communities left: only their connected pieces are to be told.
        inside = ended.where("c1 = c2")
        found = vertices.select("id").join(connected_components(inside.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("community"))
    else:
        found = ended.coalesce(1).mapInArrow(lambda b: _last(b, total, resolution), "id long, community long")
    # A part is named by its least vertex and a community by its least part, so by its least vertex too.
    found = materialize(found, "found")
    for member in reversed(members):
        before, found = found, materialize(member.join(found.withColumnRenamed("id", "part"), "part").select("id", "community"), "found")
        discard(before)
    for left in (*levels, vertices, *(() if isinstance(edges, Prepared) else (ready.graph, ready.vertices))):
        discard(left)
    return found
