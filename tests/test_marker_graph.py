"""Marker-space graph, communities and self-organising map against brute force and planted groups."""

import random
from collections import Counter

import numpy as np
import pytest

from cellweave.operators import annotate, communities, components, marker_graph, som
from cellweave.runtime import materialize


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(range(len(x)) if ids is None else ids, x, strict=True)], "id long, v array<float>")


@pytest.fixture(scope="module")
def groups(spark):
    """Six groups of 150 points in 20 dimensions, and which is whose."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((6, 20)) * 4
    own = np.repeat(np.arange(6), 150)
    x = (centres[own] + r.standard_normal((900, 20))).astype(np.float32)
    return vectors(spark, x).repartition(5), x, own


def brute_near(x, k):
    x = x.astype(float)
    out = {}
    for i, row in enumerate(x):
        d = ((x - row) ** 2).sum(axis=1)
        out[i] = [j for j in np.lexsort((np.arange(len(x)), d)).tolist() if j != i][:k]
    return out


def test_recall_of_the_graph(spark, groups):
    df, x, _ = groups
    want = brute_near(x, 10)
    got = {r["id"]: [n["id"] for n in r["near"]] for r in marker_graph.marker_neighbours(df, "id", "v", 10, block=64).collect()}
    assert got.keys() == want.keys()
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (10 * len(want)) > 0.95
    exact = {r["id"]: [n["id"] for n in r["near"]] for r in marker_graph.exact_neighbours(df, df.where("id % 50 = 0"), "id", "v", 10).collect()}
    assert exact == {i: want[i] for i in range(0, 900, 50)}


def test_recall_on_embeddings(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r["id"]: {n["id"] for n in r["near"]} for r in marker_graph.marker_neighbours(e, "vec_id", "embedding", 10).where("id % 50 = 0").collect()}
    want = {r["id"]: {n["id"] for n in r["near"]} for r in marker_graph.exact_neighbours(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).collect()}
    assert len(want) == 40 and sum(len(got[i] & want[i]) for i in want) >= 0.9 * 400


def test_odd_vectors(spark):
    same = [[1.0, 2.0]] * 700  # repeated points fill several blocks
    rows = list(enumerate(same)) + [(None, [0.0, 0.0]), (900, None), (901, [1.0, None]), (902, [float("nan"), 1.0]), (903, [float("inf"), 1.0]), (904, [5.0, 5.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "id long, v array<double>, near int, d string")
    got = {r["id"]: r["near"] for r in marker_graph.marker_neighbours(df, "id", "v", 5, block=32).collect()}
    assert set(got) == {*range(700), 904}
    assert all(len(n) == 5 and i not in [x["id"] for x in n] for i, n in got.items()) and all(x["d"] == 0 for i, n in got.items() if i < 700 for x in n)
    assert marker_graph.marker_neighbours(df.where("id = 904"), "id", "v", 5).count() == 0
    assert marker_graph.marker_neighbours(df.limit(0), "id", "v", 5).count() == 0


def test_fuzzy_weights(spark):
    r = np.random.default_rng(1)
    d = np.sort(r.random((50, 10)), axis=1)
    w = marker_graph.scaled_weights(d, np.log2(10))
    assert np.allclose(w[:, 0], 1) and np.allclose(w.sum(axis=1), np.log2(10), atol=1e-6)
    assert np.allclose(marker_graph.scaled_weights(np.ones((1, 4)), 2.0), 1)
    near = [(1, [(1.0, 2), (4.0, 3)]), (2, [(1.0, 1), (9.0, 3)]), (3, [(4.0, 1)])]
    got = {(x["src"], x["dst"]): x["weight"] for x in marker_graph.fuzzy_weights(spark.createDataFrame(near, "id long, near array<struct<d: double, id: long>>"), 2).collect()}
    one = marker_graph.scaled_weights(np.array([[1.0, 2.0]]), 1.0)[0]
    assert set(got) == {(1, 2), (1, 3), (2, 3)} and got[1, 2] == 1 and abs(got[1, 3] - 1) < 1e-9 and abs(got[2, 3] - marker_graph.scaled_weights(np.array([[1.0, 3.0]]), 1.0)[0][1]) < 1e-9 and one[0] == 1


def connected(edges, label):
    near = {}
    for a, b, _ in edges:
        if label[a] == label[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for c in set(label.values()):
        members = {v for v in label if label[v] == c}
        seen, todo = set(), [min(members)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += near.get(v, set()) & members
        if seen != members:
            return False
    return True


def planted(seed=3, groups=12, size=30):
    r = random.Random(seed)
    n = groups * size
    edges = Counter()
    for v in range(n):
        for _ in range(6):
            u = r.randrange(n) if r.random() < 0.12 else v // size * size + r.randrange(size)
            if u != v:
                edges[min(u, v), max(u, v)] += 1.0
    return [(a, b, w) for (a, b), w in edges.items()]


@pytest.mark.parametrize("blocks", [(25_000, 400_000), (90, 400_000), (40, 500)])
def test_communities_of_planted_groups(spark, monkeypatch, blocks):
    monkeypatch.setattr(communities, "BLOCK_VERTICES", blocks[0])
    monkeypatch.setattr(communities, "BLOCK_EDGES", blocks[1])
    rows = planted()
    df = materialize(spark.createDataFrame(rows, "src long, dst long, weight double"))
    places = spark.createDataFrame([(v, v / 7) for v in range(0, 360)], "id long, place double")
    for where in (None, places):
        found = materialize(communities.leiden_communities(df, places=where))
        label = {x["id"]: x["community"] for x in found.collect()}
        assert set(label) == set(range(360)) and connected(rows, label)
        assert all(label[c] == c and c == min(v for v in label if label[v] == c) for c in set(label.values()))
        truth = spark.createDataFrame([(v, v // 30) for v in range(360)], "id long, community long")
        assert annotate.modularity(df, found) >= annotate.modularity(df, truth) - (0.005 if blocks[0] > 360 else 0.03)


@pytest.mark.parametrize("block", [25_000, 50])
def test_labels_are_the_heaviest_around(spark, monkeypatch, block):
    monkeypatch.setattr(communities, "BLOCK_VERTICES", block)
    rows = planted(5)
    got = {x["id"]: x["community"] for x in communities.heaviest_labels(spark.createDataFrame([*rows, (999, 999, 1.0)], "src long, dst long, weight double")).collect()}
    assert set(got) == {*range(360), 999} and got[999] == 999
    votes = {v: Counter() for v in got}
    for a, b, w in rows:
        votes[a][got[b]] += w
        votes[b][got[a]] += w
    assert all(votes[v][got[v]] == max(votes[v].values()) for v in range(360))


def test_communities_of_odd_graphs(spark):
    edges = [(1, 2, 1.0), (2, 1, 1.0), (3, 3, 2.0), (None, 4, 1.0), (5, 6, None), (7, 8, 0.5)]
    df = spark.createDataFrame([(*e, "x") for e in edges], "src long, dst long, weight double, community string")
    assert {x["id"]: x["community"] for x in communities.leiden_communities(df).collect()} == {1: 1, 2: 1, 3: 3, 7: 7, 8: 7}
    assert communities.leiden_communities(df.limit(0)).count() == 0


def test_many_components_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(communities, "BLOCK_VERTICES", 20)
    df = spark.createDataFrame([(2 * i, 2 * i + 1, 1.0) for i in range(100)], "src long, dst long, weight double")
    assert {x["id"]: x["community"] for x in communities.leiden_communities(df).collect()} == {v: v // 2 * 2 for v in range(200)}


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(200 + r.randrange(50), 200 + r.randrange(50)) for _ in range(40)] + [(500, 500), (None, 3), (900, 901)]
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {x["v"]: x["root"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_som_finds_groups(spark, groups):
    df, x, own = groups
    trained = som.train_som(df, "id", "v", 5, 4, epochs=6)
    assert len(trained.errors) == 6 and all(b < a for a, b in zip(trained.errors, trained.errors[1:], strict=False))
    got = {r["id"]: r for r in som.som_clusters(df, "id", "v", groups=6, width=5, height=4, epochs=6).collect()}
    pairs = Counter((got[i]["label"], own[i]) for i in range(900))
    assert sum(max(n for (c, _), n in pairs.items() if c == k) for k in {c for c, _ in pairs}) > 0.95 * 900
    d = ((x.astype(float)[:, None, :] - trained.nodes[None]) ** 2).sum(axis=2)
    assert all(got[i]["node"] == d[i].argmin() and abs(got[i]["distance"] - d[i].min()) < 1e-9 for i in range(900))


def test_som_epoch_by_hand(spark):
    x = np.array([[0.0, 0], [1, 0], [10, 0], [11, 1], [0, 1]])
    nodes = np.array([[0.0, 0], [10, 0], [50, 50]])
    trained = som.train_som(vectors(spark, x), "id", "v", 3, 1, epochs=1, radius=1.0, nodes=nodes)
    w = som.grid_weights(3, 1, 1.0)
    sums, count = np.array([x[[0, 1, 4]].sum(axis=0), x[[2, 3]].sum(axis=0), [0, 0]]), np.array([3, 2, 0])
    assert np.allclose(trained.nodes, (w @ sums) / (w @ count)[:, None])
    assert som.moved_nodes(nodes, sums, count, np.eye(3))[2].tolist() == [50, 50]
    with pytest.raises(ValueError, match="at least one"):
        som.train_som(vectors(spark, x).limit(0), "id", "v", 2, 2)


def test_joined_nodes():
    nodes = np.array([[0.0], [0.1], [5], [5.2], [9], [4.9]])
    assert som.join_nodes(nodes, np.array([3, 1, 2, 2, 4, 0]), 3) == [0, 0, 1, 1, 2, 1]
    assert som.join_nodes(nodes, np.zeros(6), 2) == [0] * 6
    assert len(set(som.join_nodes(nodes, np.ones(6), 1))) == 1


def test_subclusters_are_put_back(spark, groups):
    df, _, own = groups
    cells = df.join(spark.createDataFrame([(i, int(g > 2)) for i, g in enumerate(own.tolist())], "id long, label int"), "id")
    got = {r["id"]: r["merged"] for r in annotate.subclustered(cells, "id", "v", "label", [1], "merged").collect()}
    assert all(got[i] == "0" for i in range(900) if own[i] <= 2)
    assert len({(got[i], own[i]) for i in range(900) if own[i] > 2}) == len({got[i] for i in range(900) if own[i] > 2}) >= 3


def written(monkeypatch):
    """Names and numbers of rows of the tables that the communities write."""
    tables, write = [], communities.materialize

    def spy(df, name="table"):
        out = write(df, name)
        tables.append((name, out.count()))
        return out

    monkeypatch.setattr(communities, "materialize", spy)
    return tables


def test_label_steps_move_blocks_not_vertices(spark, monkeypatch):
    monkeypatch.setattr(communities, "BLOCK_VERTICES", 100)
    tables = written(monkeypatch)
    rows = [(v, v + d, 1.0) for v in range(2000) for d in (1, 2)]
    places = spark.createDataFrame([(v, float(v)) for v in range(2002)], "id long, place double")
    assert communities.heaviest_labels(spark.createDataFrame(rows, "src long, dst long, weight double"), places).count() == 2002
    # Some 21 blocks, each with its graph, its labels and two borders: no step writes a row for each vertex or edge.
    assert all(n < 200 for name, n in tables if name not in ("graph", "vertices", "found"))


def test_resolutions_share_the_prepared_graph(spark, monkeypatch):
    monkeypatch.setattr(communities, "BLOCK_VERTICES", 90)
    tables = written(monkeypatch)
    df = spark.createDataFrame(planted(), "src long, dst long, weight double")
    assert [r["resolution"] for r in annotate.resolution_sweep(df, [0.5, 2.0]).collect()] == [0.5, 2.0]
    assert sum(n == len(planted()) for name, n in tables if name == "graph") == 1
    assert all(n < 200 for name, n in tables if name in ("blocks", "labels"))
