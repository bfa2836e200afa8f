"""Regression, canonical correlation, tensor factors and classification figures."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalars import ratio


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f / a


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson correlation."""
    return 1.0 if n < 3 else 0.0 if abs(r) >= 1 else student_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def correlation_test(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """``by.., corr, pvalue, n``: Pearson correlation of each group and its two-sided p-value; rows that lack either value are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = rows.groupBy(*by).agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("corr"), F.count(F.lit(1)).alias("n"))

    def test(r: pd.Series, n: pd.Series) -> pd.Series:  # one row a group
        return pd.Series([None if math.isnan(a) else pearson_p(a, int(b)) for a, b in zip(r.astype(float), n, strict=True)], dtype="float64")

    return sums.withColumn("pvalue", F.pandas_udf(test, "double")("corr", "n")).select(*by, "corr", "pvalue", "n")


def grouped_ols(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], of: str) -> DataFrame:
    """``by.., coefficient, pvalue, n`` of ``of`` in a least-squares fit of y on xs and a constant.

    Spark forms the sums of products of each group; only these are solved in Python.
    Null where the fit is not determined.
    """
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    p = len(terms)
    rows = df.where(F.col(y).isNotNull() & ~F.array_contains(F.array(*[F.col(x).isNull() for x in xs]), True))
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(terms[i] * F.col(y)).alias(f"b{i}") for i in range(p)] + [F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n")]
    grouped = rows.groupBy(*by).agg(*sums)
    flat = F.array(*[F.col(f"a{i}_{j}") for i in range(p) for j in range(i, p)], *[F.col(f"b{i}") for i in range(p)], F.col("yy"), F.col("n").cast("double"))
    k = 1 + list(xs).index(of)

    def solve(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            a, at = np.zeros((p, p)), 0
            for i in range(p):
                for j in range(i, p):
                    a[i, j] = a[j, i] = v[at]
                    at += 1
            b, yy, n = np.array(v[at : at + p]), v[-2], int(v[-1])
            if n <= p or np.linalg.matrix_rank(a) < p:
                out.append((None, None))
                continue
            beta = np.linalg.solve(a, b)
            rest = max(0.0, yy - beta @ b)
            se = math.sqrt(rest / (n - p) * np.linalg.inv(a)[k, k])
            out.append((float(beta[k]), student_p(beta[k] / se, n - p) if se else 0.0))
        return pd.DataFrame(out, columns=["coefficient", "pvalue"]).astype("float64")

    return grouped.withColumn("__r", F.pandas_udf(solve, "coefficient double, pvalue double")(flat)).select(*by, "__r.coefficient", "__r.pvalue", "n")


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``label, precision, recall, f1, support`` of each label that is either true or predicted."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    labels = pairs.select(F.col("t").alias("label")).union(pairs.select("p")).distinct()
    hit = pairs.where("t = p").select(F.col("t").alias("label"), F.col("n").alias("hit"))
    true = pairs.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"))
    guess = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("guessed"))
    wide = labels.join(hit, "label", "left").join(true, "label", "left").join(guess, "label", "left").na.fill(0)
    precision = F.coalesce(ratio(F.col("hit"), F.col("guessed")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("hit"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0))
    return wide.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def canonical_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """First canonical correlation of two small matrices with shared rows."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return float(min(1.0, np.linalg.svd(qa.T @ qb, compute_uv=False)[0]))


def canonical_pairs(df: DataFrame, group: str, unit: str, item: str, value: str, permutations: int, pseudo: float = 1e-3, seed: int = 0) -> DataFrame:
    """``a, b, corr, share``: first canonical correlation of the items' log values between two groups over
    shared units, and the share of unit permutations that it exceeds. Null where too few units are shared.

    Pairs of groups are formed after aggregation; a task holds the table of one pair.
    """
    logs = df.groupBy(group, unit, item).agg(F.ln(F.lit(pseudo) + F.avg(value)).alias("v"))
    rows = logs.groupBy(group, unit).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), "v"))).alias("x"))
    rows = rows.select(F.col(group).alias("g"), F.col(unit).alias("u"), F.transform("x", lambda s: s["v"]).alias("x"))
    both = rows.select(F.col("g").alias("a"), "u", F.col("x").alias("xa")).join(rows.select(F.col("g").alias("b"), "u", F.col("x").alias("xb")), "u").where("a < b")
    kind = df.schema[group].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("u")
        a, b = np.array(p["xa"].tolist()), np.array(p["xb"].tolist())
        out = {"a": p["a"].iloc[0], "b": p["b"].iloc[0], "corr": None, "share": None}
        if len(p) > 2:
            rng = np.random.default_rng(seed)
            out["corr"] = canonical_correlation(a, b)
            out["share"] = float(np.mean([out["corr"] > canonical_correlation(a[rng.permutation(len(a))], b) for _ in range(permutations)]))
        return pd.DataFrame([out])

    return both.groupBy("a", "b").applyInPandas(run, f"a {kind}, b {kind}, corr double, share double")


def studentized_range_p(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range of k means with df degrees of freedom, by Gauss-Legendre quadrature."""
    if q <= 0:
        return 1.0
    nodes, weights = np.polynomial.legendre.leggauss(96)
    z, wz = 8 * nodes, 8 * weights
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    phi, dens = cdf(z), np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    # s is the pooled deviation over its true value: its density is that of a scaled chi.
    low, top = max(0.0, 1 - 10 / math.sqrt(df)), 1 + 10 / math.sqrt(max(1.0, df))
    s, ws = low + (nodes + 1) * (top - low) / 2, weights * (top - low) / 2
    log_c = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
    chi = np.exp(log_c + (df - 1) * np.log(s) - df * s * s / 2)
    inner = np.array([k * np.sum(wz * dens * (phi - cdf(z - q * v)) ** (k - 1)) for v in s])
    return float(min(1.0, max(0.0, 1 - np.sum(ws * chi * inner))))


def tukey_hsd(df: DataFrame, group: str, value: str) -> DataFrame:
    """``a, b, difference, pvalue`` of all pairs of group means; groups are few, their sums are formed in Spark."""
    v = F.col(value).cast("double")
    kind = df.schema[group].dataType.simpleString()
    sums = df.where(v.isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    one = sums.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "n", "m", "v"))).alias("r"))

    def run(batches):
        for p in batches:
            for rows in p["r"]:
                k, free = len(rows), sum(r["n"] for r in rows) - len(rows)
                mse = sum(r["n"] * r["v"] for r in rows) / free if free > 0 else 0.0
                out = []
                for i, a in enumerate(rows):
                    for b in rows[i + 1 :]:
                        d = b["m"] - a["m"]
                        se = math.sqrt(mse / 2 * (1 / a["n"] + 1 / b["n"]))
                        out.append((a["g"], b["g"], d, studentized_range_p(abs(d) / se, k, free) if se else None))
                yield pd.DataFrame(out, columns=["a", "b", "difference", "pvalue"])

    return one.mapInPandas(run, f"a {kind}, b {kind}, difference double, pvalue double")


def log_means(df: DataFrame, by: Sequence[str], columns: Sequence[str], pseudo: float = 1e-3) -> DataFrame:
    """ln(pseudo + mean) of columns in each group: the input of canonical correlation."""
    return df.groupBy(*by).agg(*[F.ln(F.lit(pseudo) + F.avg(c)).alias(c) for c in columns])


def permutation_share(observed: DataFrame, permuted: DataFrame, key: Sequence[str], by: Sequence[str], value: str, permuted_value: str) -> DataFrame:
    """``by.., share``: share of permuted values that the observed value of their ``key`` exceeds; both tables are long."""
    both = permuted.select(*key, F.col(permuted_value).alias("__p")).join(observed.select(*key, F.col(value).alias("__o")), list(key))
    return both.groupBy(*by).agg(F.avg((F.col("__o") > F.col("__p")).cast("double")).alias("share"))


def nonnegative_tucker(x: np.ndarray, ranks: Sequence[int], steps: int = 300, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Core, factors and mean squared error of a non-negative Tucker model by multiplicative updates.

    For small tensors (donors x neighbourhoods x types) that aggregates have made.
    """
    rng = np.random.default_rng(seed)
    factors = [rng.random((n, r)) + 0.1 for n, r in zip(x.shape, ranks, strict=True)]
    core = rng.random(tuple(ranks)) + 0.1
    letters, inner = "abc"[: x.ndim], "xyz"[: x.ndim]
    whole = f"{inner},{','.join(a + i for a, i in zip(letters, inner, strict=True))}->{letters}"
    for _ in range(steps):
        for m in range(x.ndim):
            others = [factors[k] for k in range(x.ndim) if k != m]
            names = [letters[k] + inner[k] for k in range(x.ndim) if k != m]
            part = np.einsum(f"{inner},{','.join(names)}->{inner[m]}{''.join(letters[k] for k in range(x.ndim) if k != m)}", core, *others).reshape(ranks[m], -1)
            flat = np.moveaxis(x, m, 0).reshape(x.shape[m], -1)
            factors[m] *= (flat @ part.T) / (factors[m] @ part @ part.T + 1e-12)
        back = f"{letters},{','.join(a + i for a, i in zip(letters, inner, strict=True))}->{inner}"
        core *= np.einsum(back, x, *factors) / (np.einsum(back, np.einsum(whole, core, *factors), *factors) + 1e-12)
    return core, factors, float(((np.einsum(whole, core, *factors) - x) ** 2).mean())


def tissue_tensor(cells: DataFrame, donor: str, neighbourhood: str, cell_type: str) -> tuple[np.ndarray, list[list]]:
    """Cells of each donor, neighbourhood and type as shares of the donor, and the names along the axes.

    Spark counts; the driver holds one number for each combination of three small domains.
    """
    counts = cells.groupBy(F.col(donor).alias("d"), F.col(neighbourhood).alias("n"), F.col(cell_type).alias("t")).agg(F.count(F.lit(1)).alias("k")).where("d is not null and n is not null and t is not null").collect()
    names = [sorted({r[c] for r in counts}) for c in "dnt"]
    x = np.zeros(tuple(map(len, names)))
    for r in counts:
        x[names[0].index(r["d"]), names[1].index(r["n"]), names[2].index(r["t"])] = r["k"]
    return x / np.maximum(x.sum(axis=(1, 2), keepdims=True), 1), names


def tissue_modules(cells: DataFrame, donor: str, neighbourhood: str, cell_type: str, ranks: Sequence[int], steps: int = 300, seed: int = 0) -> DataFrame:
    """``axis, name, module, loading`` of a non-negative Tucker model, and the core as axis ``core`` with its three numbers as name."""
    x, names = tissue_tensor(cells, donor, neighbourhood, cell_type)
    core, factors, _ = nonnegative_tucker(x, ranks, steps, seed)
    rows = [(axis, str(name), m, float(f[i, m])) for axis, own, f in zip(("donor", "neighbourhood", "type"), names, factors, strict=True) for i, name in enumerate(own) for m in range(f.shape[1])]
    rows += [("core", f"{i},{j}", k, float(core[i, j, k])) for i in range(core.shape[0]) for j in range(core.shape[1]) for k in range(core.shape[2])]
    return cells.sparkSession.createDataFrame(rows, "axis string, name string, module int, loading double")


def evaluate_ranks(cells: DataFrame, donor: str, neighbourhood: str, cell_type: str, modules: int = 2, most: int = 14, steps: int = 200, seed: int = 0) -> DataFrame:
    """``modules, rank, error``: mean squared error of Tucker models of ranks (modules, rank, rank), rank from 2 to ``most``."""
    x, _ = tissue_tensor(cells, donor, neighbourhood, cell_type)
    rows = [(j, i, nonnegative_tucker(x, (j, i, i), steps, seed)[2]) for j in range(1, modules + 1) for i in range(2, most + 1)]
    return cells.sparkSession.createDataFrame(rows, "modules int, rank int, error double")


def farthest_point_seeds(df: DataFrame, cell_id: str, features: str, n: int) -> DataFrame:
    """Deterministic divisive seeding by cosine distance: ``seed, cell_id, features``.

    The first seed is furthest from the mean, each next one furthest from its nearest
    seed; ties by id. Each round is one aggregate over all rows; n vectors are kept.
    """
    from cellweave.functions.scalars import cosine_distance

    spark = df.sparkSession
    kind = df.schema[cell_id].dataType.simpleString()
    size = df.select(F.max(F.size(features)).alias("n")).first()["n"]
    mean = df.agg(F.array(*[F.avg(F.col(features)[i].cast("double")) for i in range(size)]).alias("m")).first()["m"]
    seeds: list[tuple] = []
    for k in range(n):
        centres = [mean] if not seeds else [s[2] for s in seeds]
        near = [cosine_distance(F.col(features), F.array(*[F.lit(float(v)) for v in c])) for c in centres]
        far = F.least(*near) if len(near) > 1 else near[0]
        best = df.select(cell_id, features, far.alias("d")).orderBy(F.desc("d"), cell_id).limit(1).first()
        seeds.append((k, best[cell_id], [float(v) for v in best[features]]))
    return spark.createDataFrame(seeds, f"seed int, {cell_id} {kind}, features array<double>")


def nearest_seed(df: DataFrame, cell_id: str, features: str, seeds: DataFrame, most: int = 10_000) -> DataFrame:
    """``cell_id, seed, distance`` of the nearest seed by cosine distance; ties by seed.

    Seeds are cluster centres: the driver holds at most ``most`` of them (more are an
    error) and each row finds the least of its distances without a join or a sort.
    """
    from cellweave.functions.scalars import cosine_distance

    rows = seeds.select("seed", "features").orderBy("seed").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} seeds")
    scored = df.select(cell_id, F.col(features).alias("__f"))
    kind = seeds.schema["seed"].dataType
    if not rows:
        return scored.select(cell_id, F.lit(None).cast(kind).alias("seed"), F.lit(None).cast("double").alias("distance"))
    struct = lambda r: F.struct(cosine_distance(F.col("__f"), F.array(*[F.lit(float(v)) for v in r["features"]])).alias("distance"), F.lit(r["seed"]).cast(kind).alias("seed"))
    # Distances that are null (a zero vector) come last.
    best = F.array_min(F.filter(F.array(*map(struct, rows)), lambda s: s["distance"].isNotNull()))
    return scored.withColumn("__b", best).select(cell_id, F.col("__b.seed").alias("seed"), F.col("__b.distance").alias("distance"))
