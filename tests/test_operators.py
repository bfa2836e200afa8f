import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions.scalars import normal_cdf, phi
from cellweave.operators import annotate, composition, interactions, neighborhoods, patches, pixels, preprocess, ranking, spatial, stats
from cellweave.plans import catalog
from cellweave.schema import CellSchema, first_appearance, marker_slice, without_nan
from cellweave.sources.cells import cells_view


def test_constant_marker_gives_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in preprocess.zscore(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, None), (1.0, None)]
    assert [r["b"] for r in preprocess.minmax(df, ["a", "b"]).collect()] == [None, None]


def test_nan_becomes_null_and_is_skipped(spark):
    df = without_nan(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "a double"))
    assert df.where("a is null").count() == 1
    assert preprocess.filter_cells(df, "a", "a", 0, 0).count() == 2


def test_negative_size_limit_keeps_cells_without_nucleus(spark):
    df = spark.createDataFrame([(0.0, 4.0), (2.0, 4.0)], "n double, s double")
    assert preprocess.filter_cells(df, "n", "s", 1, -1).count() == 2
    assert preprocess.filter_cells(df, "n", "s", 1, 1).count() == 1


def test_noise_count_includes_zero_and_limits_are_strict(spark):
    df = spark.createDataFrame([(0.0, -1.0), (1.0, 1.0)], "a double, b double")
    assert [r["marker_count"] for r in preprocess.noise_scores(df, ["a", "b"]).orderBy("a").collect()] == [1, 2]
    clean, noisy = preprocess.remove_noise(df, ["a", "b"], 2.0, 2)
    assert (clean.count(), noisy.count(), clean.columns) == (2, 0, ["a", "b"])


def test_more_regions_than_tiles(spark):
    df = spark.createDataFrame([(i, f"r{i}", 0, 0) for i in range(3)], "id long, r string, x long, y long")
    with pytest.raises(ValueError):
        preprocess.tile_offsets(df, "r", "id", 1, 2, "x", "y", 10, 10)


@pytest.mark.parametrize("include_self", [True, False])
def test_knn_equals_brute_force(spark, include_self):
    r = random.Random(5)
    cells = [(i, f"r{i % 3}", r.randrange(60) ** (2 if i % 2 else 1), r.randrange(60)) for i in range(250)] + [(900, "lone", 1, 1), (901, "two", 1, 1), (902, "two", 1, 1)]
    df = spark.createDataFrame(cells, "cell_id long, region string, x long, y long")
    got = {}
    for row in spatial.knn(df, 7, include_self=include_self).collect():
        got.setdefault(row["id"], []).append((row["rank"], row["neighbor"]))
    for i, reg, x, y in cells:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, g, u, v in cells if g == reg and (include_self or j != i))[:7]
        assert [n for _, n in sorted(got.get(i, []))] == [j for _, j in near]


def test_range_pairs_on_the_border(spark):
    df = spark.createDataFrame([(1, "r", 0, 0), (2, "r", 3, 4), (3, "q", 0, 0)], "cell_id long, region string, x long, y long")
    assert spatial.range_pairs(df, df, 5).count() == 2
    assert spatial.range_pairs(df, df, 5, inclusive=False).count() == 0


def minimal(counts, limit):
    order = sorted(range(len(counts)), key=lambda i: (-counts[i], i))
    total = 0
    for n, i in enumerate(order, 1):
        total += counts[i]
        if total > limit:
            return sorted(order[:n])
    return [order[0]]


def test_minimal_combination_equals_brute_force(spark):
    r = random.Random(2)
    rows = [tuple(r.choice([0, 0, 2, 4, 5, 9]) for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    for limit in (5, 12, 1000):
        out = df.select("*", neighborhoods.minimal_combination(F.array("a", "b", "c", "d"), limit).alias("m")).collect()
        assert all(list(x["m"]) == minimal(list(x)[:4], limit) for x in out)


def test_permutation_keeps_labels_of_a_region(spark):
    df = spark.createDataFrame([(i, f"r{i % 2}", f"t{i % 5}") for i in range(50)], "cell_id long, region string, cell_type string")
    new = interactions.permute_labels(df, 3)
    count = lambda d: sorted((r["region"], r["cell_type"], r["count"]) for r in d.groupBy("region", "cell_type").count().collect())
    assert count(new) == count(df) and new.count() == 50


def test_delaunay_drops_repeated_places(spark):
    df = spark.createDataFrame([(1, "r", 0.0, 0.0), (2, "r", 4.0, 0.0), (3, "r", 0.0, 3.0), (4, "r", 0.2, 0.3)], "cell_id long, region string, x double, y double")
    assert sorted((r["id1"], r["id2"], r["distance"]) for r in interactions.delaunay_edges(df).collect()) == [(1, 2, 4.0), (1, 3, 3.0), (2, 3, 5.0)]


def mann_whitney(a, b):
    """Brute force over pairs."""
    n, m = len(a), len(b)
    if not n or not m:
        return None
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    u = max(u, n * m - u)
    both = [*a, *b]
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    var = n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))
    return 1.0 if var <= 0 else min(1.0, 2 * (1 - normal_cdf((u - n * m / 2 - 0.5) / var**0.5)))


def test_rank_test_equals_brute_force(spark):
    r = random.Random(5)
    groups = {"plain": ([r.random() for _ in range(300)], [r.random() + 0.1 for _ in range(200)]), "ties": ([r.randrange(4) for _ in range(90)], [r.randrange(5) for _ in range(70)]), "one": ([1.0], []), "same": ([2.0] * 4, [2.0] * 3)}
    groups["small"] = (list(range(1, 13)), list(range(7, 19)))
    rows = [(g, float(v), flag) for g, (a, b) in groups.items() for flag, vs in ((True, a), (False, b)) for v in vs] + [("plain", None, True)]
    got = {x["g"]: x["pvalue"] for x in interactions.rank_test(spark.createDataFrame(rows, "g string, v double, f boolean"), ["g"], "v", "f").collect()}
    assert got.keys() == groups.keys()
    for g, (a, b) in groups.items():
        want = mann_whitney(a, b)
        assert got[g] is None if want is None else got[g] == pytest.approx(want, abs=1e-9)


def test_normal_distribution_function(spark):
    z = [-38.0, -9.0, -5.0, -4.999, -1.3, 0.0, 0.2, 3.0, 4.9999, 5.0, 6.5, 30.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(phi(F.col("z"))).collect()]
    assert got == pytest.approx([normal_cdf(v) for v in z], rel=1e-9, abs=1e-300)
    assert spark.createDataFrame([(None,)], "z double").select(phi(F.col("z"))).first()[0] is None


def test_running_totals_and_quantiles(spark, monkeypatch):
    r = random.Random(7)
    rows = [(g, v, r.randrange(5)) for g in "ab" for v in r.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "g string, v long, k long")
    want = {(g, v): sum(k for h, w, k in rows if h == g and w < v) for g, v, _ in rows}
    assert {(x["g"], x["v"]): x["s"] for x in ranking.running_before(df, ["g"], "v", "k", "s").collect()} == want
    named = df.withColumn("v", F.lpad(F.col("v").cast("string"), 6, "0"))
    assert {(x["g"], int(x["v"])): x["s"] for x in ranking.running_before(named, ["g"], "v", "k", "s").collect()} == want
    values = spark.createDataFrame([(float(v), float(v % 3), None) for _, v, _ in rows] + [(None, None, None)], "a double, b double, c double")
    for sorted_ in (100_000, 50):
        monkeypatch.setattr(ranking, "SORTED", sorted_)
        got = ranking.exact_quantiles(values, ["a", "b", "c"], (0.0, 0.01, 0.5, 0.777, 1.0))
        exact = values.agg(*[F.percentile(c, F.array(*map(F.lit, (0.0, 0.01, 0.5, 0.777, 1.0)))).alias(c) for c in "ab"]).first()
        assert got["a"] == pytest.approx(exact["a"]) and got["b"] == pytest.approx(exact["b"]) and got["c"] == [None] * 5


def test_swaps_are_permutations_and_engines_agree(spark):
    for n in (1, 2, 7, 1000):
        places = interactions.swapped_places(np.arange(n), n, np.arange(5))
        assert all(sorted(places[:, s]) == list(range(n)) for s in range(5))
        got = spark.range(n).select(*[interactions.swapped(F.col("id"), F.lit(n).cast("long"), s).alias(f"s{s}") for s in range(5)], "id").orderBy("id").collect()
        assert [[x[f"s{s}"] for s in range(5)] for x in got] == places.tolist()
    many = interactions.swapped_places(np.arange(500), 500, np.arange(200))
    # Each place goes anywhere: no place keeps to itself or to its neighbourhood.
    assert abs((many == np.arange(500)[:, None]).mean() - 1 / 500) < 1e-3 and abs((np.abs(np.diff(many, axis=0)) == 1).mean() - 2 / 500) < 3e-3


@pytest.mark.parametrize(("n", "steps"), [(1_000, 3000), (12_875, 2000), (100_000, 500), (1_000_000, 300)])
def test_permutations_spread_as_chance_does(n, steps):
    """Places of the first half that stay in it: the variance over permutations is the hypergeometric one."""
    got = np.array([(interactions.swapped_places(np.arange(n // 2), n, np.array([s])) < n // 2).sum() for s in range(steps)])
    half = n // 2
    expected = half * half * half * half / (n * n * (n - 1))
    error = (2 / steps) ** 0.5
    assert abs(got.var() / expected - 1) < max(0.05, 3 * error)
    assert abs(got.mean() - half * half / n) < 4 * (expected / steps) ** 0.5


def test_small_permutations_are_all_dealt():
    seen = Counter(tuple(interactions.swapped_places(np.arange(4), 4, np.array([s]))[:, 0].tolist()) for s in range(4800))
    assert len(seen) == 24 and all(120 < k < 290 for k in seen.values())


def test_interaction_filter_needs_both_conditions(spark):
    rows = [("a", "b", "x", 0.01, 0.5, 1.0), ("a", "b", "y", 0.9, -0.5, 1.0), ("a", "c", "x", 0.01, 0.5, 1.0), ("a", "a", "x", 0.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "type1 string, type2 string, condition string, pvalue double, logfold_group double, observed_mean double")
    kept = interactions.filter_interactions(df)
    assert sorted({r["pair"] for r in kept.collect()}) == ["a_b", "a_c"]
    assert [r["pair"] for r in interactions.fold_table(kept, ["x", "y"]).collect()] == ["a_b"]


def test_patches_around_a_cluster(spark):
    cells = [(i, "r", i % 6, i // 6, "P") for i in range(36)] + [(100, "r", 8, 2, "Q"), (101, "r", 40, 2, "Q"), (102, "s", 1, 1, "P")]
    df = spark.createDataFrame(cells, "cell_id long, region string, x long, y long, cn string")
    near = patches.patch_proximity(df, "cn", "P", least=5, radius=4, edge_neighbours=3)
    assert [(r["cell_id"], r["neighbor_label"], r["distance2"]) for r in near.collect()] == [(100, "Q", 9)]
    assert patches.patch_proximity(df, "cn", "P", least=500).count() == 0


def test_pairs_around_patches_are_reduced_where_they_are_formed(spark):
    cells = spark.createDataFrame([(1, "r", 0, 0, "Q"), (2, "r", 3, 0, "Q")], "cell_id long, region string, x long, y long, cn string")
    borders = spark.createDataFrame([("r", 9, 1, 0, 0), ("r", 9, 1, 0, 1), ("r", 8, 2, 0, 0)], "region string, cell_id long, x long, y long, patch int")
    near = patches.proximity(cells, borders, 5, "cn", "P")
    assert sorted((r["cell_id"], r["patch"], r["distance2"]) for r in near.collect()) == [(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 1, 4)]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # pairs, and the labels of what was found


def test_compensation_never_negative(spark):
    px = [("i", y, x, 1 if x < 3 else 2, 100.0 if x < 3 else 1.0) for y in range(4) for x in range(6)]
    df = spark.createDataFrame(px, "image string, y long, x long, label long, c double")
    out = {r["label"]: r["c"] for r in pixels.compensate(df, ["c"]).collect()}
    assert out[2] == 0.0 and out[1] > 90


def test_ols_recovers_a_plane(spark):
    r = random.Random(0)
    rows = [("g", x, z, 2.0 + 3.0 * x - 0.5 * z + r.gauss(0, 0.01)) for x, z in ((r.random(), r.random()) for _ in range(100))] + [("h", 1.0, 1.0, 1.0)]
    out = {x["g"]: x for x in stats.grouped_ols(spark.createDataFrame(rows, "g string, x double, z double, y double"), ["g"], "y", ["x", "z"], "z").collect()}
    assert out["g"]["coefficient"] == pytest.approx(-0.5, abs=0.02) and out["g"]["pvalue"] < 1e-20
    assert out["h"]["coefficient"] is None


def test_student_and_canonical():
    import numpy as np

    assert stats.student_p(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-6)
    a = np.random.default_rng(0).normal(size=(40, 2))
    assert stats.canonical_correlation(a, a @ np.array([[1.0, 2.0], [0.5, -1.0]])) == pytest.approx(1.0)
    x = np.einsum("ax,by,cz,xyz->abc", *(np.random.default_rng(1).random(s) for s in ((4, 2), (5, 2), (6, 2), (2, 2, 2))))
    assert stats.nonnegative_tucker(x, (2, 2, 2), steps=4000)[2] < 0.01 * x.var()


def test_studentised_range():
    assert stats.studentized_range_p(3.877676, 3, 10) == pytest.approx(0.05, abs=2e-4)
    assert stats.studentized_range_p(3.633, 4, 1e5) == pytest.approx(0.05, abs=1e-3)


def test_tukey_and_canonical_pairs(spark):
    r = random.Random(1)
    rows = [(g, f"u{i}", t, m + r.gauss(0, 1)) for g, m in (("a", 0.0), ("b", 0.0), ("c", 5.0)) for i in range(12) for t in "xy"]
    df = spark.createDataFrame(rows, "g string, u string, t string, v double")
    p = {(x["a"], x["b"]): x["pvalue"] for x in stats.tukey_hsd(df, "g", "v").collect()}
    assert p["a", "c"] < 1e-4 and p["a", "b"] > 0.05
    out = stats.canonical_pairs(df.withColumn("v", F.abs("v")), "g", "u", "t", "v", 10).collect()
    assert len(out) == 3 and all(0 <= x["corr"] <= 1 and 0 <= x["share"] <= 1 for x in out)


def test_labels_and_metadata(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "cell_id long, t string")
    assert [r["n"] for r in annotate.map_labels(df, "t", {"a": "x"}, "n").orderBy("t").collect()] == ["x", None]
    meta = spark.createDataFrame([("a", "m")], "t string, site string")
    assert [r["site"] for r in composition.region_metadata(df, meta, "t", ["site"]).orderBy("t").collect()] == ["m", "Unknown"]
    assert [r["o"] for r in first_appearance(spark.createDataFrame([(3, "z"), (1, "y"), (2, "z")], "i long, k string"), "k", "i", "o").orderBy("i").collect()] == [0, 1, 1]


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "r", "t", "c")], "cell_id long, x double, y double, region string, cell_type string, cond string")
    assert CellSchema().check(df) is df and marker_slice(df, 1) == ["cell_id", "x"]
    with pytest.raises(ValueError):
        CellSchema(markers=("m",)).check(df)
    with pytest.raises(TypeError):
        CellSchema(x="region").check(df)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "cell_id long, region string, x long, y long, cell_type string, cn string, cond string")
    assert composition.share(df, ["region"], "cell_type").count() == 0
    assert composition.enrichment(df, "cn", "cell_type").count() == 0
    assert spatial.knn(df, 3).count() == 0
    assert interactions.delaunay_edges(df).count() == 0


def test_spill_compensation_covers_every_event(spark):
    sf = "/root/testdata/sf0.01"
    want = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id div 1600 as i").distinct().count()
    assert want > 3 and catalog.QUERIES["spill_compensation"](spark, sf).select("image").distinct().count() == want


def test_label_groups_cover_all_regions_and_settle(spark, small):
    got = {r["id"]: r["community"] for r in catalog.QUERIES["label_groups"](spark, small).collect()}
    cells = cells_view(spark, small)
    ids = {r["cell_id"] for r in cells.select("cell_id").collect()}
    assert set(got) == ids
    around = {}
    for r in spatial.knn(cells, 6, include_self=False).select("id", "neighbor").collect():
        around.setdefault(r["id"], set()).add(r["neighbor"])
        around.setdefault(r["neighbor"], set()).add(r["id"])
    for v, near in around.items():
        votes = [got[u] for u in near]
        assert votes.count(got[v]) == max(map(votes.count, votes))
    assert {r["id"] for r in catalog.QUERIES["graph_communities"](spark, small).collect()} == ids


def test_label_propagation_settles_on_paths_and_rings(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(50)] + [(100 + i, 100 + (i + 1) % 9, 1.0) for i in range(9)], "src long, dst long, weight double")
    got = {r["id"]: r["community"] for r in annotate.label_propagation(path).collect()}
    assert len(got) == 60


def test_communities_of_planted_groups(spark):
    r = random.Random(3)
    edges = [(10 * g + i, 10 * g + j, 1.0) for g in range(4) for i in range(8) for j in range(i) if r.random() < 0.8] + [(10 * g, 10 * ((g + 1) % 4) + 1, 1.0) for g in range(4)] + [(0, 0, 2.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double").coalesce(1)
    found = annotate.modularity_communities(df)
    got = {x["id"]: x["community"] for x in found.collect()}
    assert got == {10 * g + i: 10 * g for g in range(4) for i in range(8)}
    total = sum(w for *_, w in edges)
    inside = sum(w for a, b, w in edges if got[a] == got[b])
    degree = {}
    for a, b, w in edges:
        for v in (a, b):
            degree[got[v]] = degree.get(got[v], 0) + w
    assert annotate.modularity(df, found) == pytest.approx(inside / total - sum(d * d for d in degree.values()) / (4 * total * total))
    assert [x["communities"] < 4 for x in annotate.resolution_sweep(df, [0.05]).collect()] == [True]
    assert annotate.modularity_communities(df.where("false")).count() == 0


def test_nearest_neighbours_equal_brute_force(spark):
    r = random.Random(9)
    rows = [(i, f"r{i % 2}", r.choice([r.randrange(40), r.randrange(2000)]), r.randrange(60)) for i in range(400)] + [(1000, "alone", 5, 5), (1001, None, 1, 1), (1002, "r0", None, 1)]
    df = spark.createDataFrame(rows, "cell_id long, region string, x long, y long")
    asked = [(5000 + i, "r0", r.randrange(-9000, 9000), r.randrange(50)) for i in range(20)] + [(6000, "r9", 1, 1)]
    others = spark.createDataFrame(asked, "cell_id long, region string, x long, y long")
    good = [p for p in rows if p[1] and p[2] is not None]
    for k, mine, own in ((7, good, True), (7, good, False), (300, good, False), (3, asked, True)):
        got = {}
        found = spatial.knn(others if mine is asked else df, k, include_self=own, others=df if mine is asked else None, extra=("x",))
        for x in found.collect():
            got.setdefault(x["id"], []).append((x["rank"], x["d2"], x["neighbor"]))
        for i, g, a, b in mine:
            near = sorted(((a - c) ** 2 + (b - d) ** 2, j) for j, h, c, d in good if h == g and (own or i != j))[:k]
            assert sorted(got.get(i, [])) == [(n, d, j) for n, (d, j) in enumerate(near, 1)], (k, i)


def test_sparse_least_squares():
    r = np.random.default_rng(4)
    a = np.eye(30) + (r.random((30, 30)) < 0.1) * r.random((30, 30))
    rows, columns = np.nonzero(a)
    b = r.random((30, 2))
    assert pixels.least_squares(rows, columns, a[rows, columns], b) == pytest.approx(np.linalg.lstsq(a, b, rcond=None)[0], abs=1e-8)


def test_tables_orders_and_maps(spark, small):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", -5.0), ("b", "x", 3.0), ("b", "y", 0.5)], "r string, c string, v double")
    assert sorted({(x["r"], x["row_rank"]) for x in composition.by_absolute_sum(df, "r", "c", "v").collect()}) == [("a", 1), ("b", 2)]
    assert [x["r"] for x in composition.custom_order(df.where("c = 'x'"), "r", ["b", "z", "a"]).collect()] == ["b", "a"]
    both = composition.side_by_side(df.where("c = 'x'").select("r", "v"), spark.createDataFrame([("b", 9.0, 1), ("q", 8.0, 2)], "r string, v double, w int"), "r")
    assert sorted(map(tuple, both.select("r", "v", "w").collect())) == [("a", 1.0, None), ("b", 3.0, 1), ("q", 8.0, 2)]
    parts = neighborhoods.combination_map(cells_view(spark, small), "cn", ["CN0", "CN1", "CN2", "CN3"], 10, 0.6, 0.5)
    assert parts["top"].agg(F.sum("freq")).first()[0] > 0.5 and parts["share"].count() == 1 and parts["edges"].columns == ["src", "dst"]
    with pytest.raises(ValueError):
        stats.nearest_seed(spark.createDataFrame([(1, [1.0])], "i long, f array<double>"), "i", "f", spark.range(3).select(F.col("id").alias("seed"), F.array(F.lit(1.0)).alias("features")), 2)
    loadings = stats.tissue_modules(cells_view(spark, small), "region", "cn", "cell_type", (1, 2, 2), 50)
    assert {x["axis"] for x in loadings.collect()} == {"donor", "neighbourhood", "type", "core"} and loadings.where("loading < 0").count() == 0


def test_ml_predict_labels_every_embedding_from_all_dimensions(spark, small, monkeypatch):
    used = []
    train = annotate.train_classifier
    monkeypatch.setattr(annotate, "train_classifier", lambda df, label, markers, **kw: used.append(len(markers)) or train(df, label, markers, **kw))
    got = [r["vec_id"] for r in catalog.QUERIES["ml_predict"](spark, small).where("predicted is not null").collect()]
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    assert sorted(got) == sorted(r["vec_id"] for r in e.select("vec_id").collect()) and used == [len(e.first()["embedding"])]


def test_expected_distances_equal_the_dealt_labels(spark, small, monkeypatch):
    cells = cells_view(spark, small)
    edges = interactions.delaunay_edges(cells).cache()
    for block in (2000, 15):  # regions in one block and in many
        monkeypatch.setattr(interactions, "BLOCK_CELLS", block)
        got = {(r["iteration"], r["region"], r["type1"], r["type2"]): r["mean_dist"] for r in interactions.expected_distances(edges, cells, 22).where("iteration in (0, 21)").collect()}
        want = {}
        for i in (0, 21):
            both = interactions.labelled_edges(edges, interactions.permute_labels(cells, i))
            want |= {(i, r["region"], r["type1"], r["type2"]): r["mean_dist"] for r in interactions.mean_distances(both.select("region", "id1", "type1", "type2", "distance")).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_interaction_test_runs_a_thousand_permutations(spark, small, monkeypatch):
    asked = []
    run = interactions.expected_distances
    monkeypatch.setattr(interactions, "expected_distances", lambda edges, cells, n, *a: asked.append(n) or run(edges, cells, n, *a))
    assert catalog.QUERIES["interaction_test"](spark, small).count() >= 0 and asked == [1000]


@pytest.mark.parametrize("name", ["combo_dag", "combo_frequency_cumulative", "combo_in_degree", "combo_names", "combo_share_at", "combo_size_distribution"])
def test_combinations_are_not_joined_to_their_cells(spark, small, name):
    """Windows know all that the combinations need: a join sorts the whole table once more, and the cells' ids with it."""
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" not in plan and "cell_id" not in plan
