"""Quality classifier: cumulative-link ordinal regression on hashed text.

Ratings are grades 0 < 1 < ... < K - 1. One weight vector over hashed text features
is shared by all grades; K - 1 ordered thresholds cut its score:

    P(grade <= k | x) = 1 / (1 + exp(score(x) - threshold_k))

so the tail probability P(grade >= k) selects documents and the expected grade ranks
them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import RUN_BYTES, TwoAgeCache, map_texts, table
from cellweave.llm.token_files import word_pieces
from cellweave.llm.vector_text import LETTER, LOWER, MARK, name_pieces, sums_between, text_bytes

#: Most labelled rows that the model is fitted on, taken in the order of a hash of
#: their ids. The driver holds their features; scoring covers every row.
FIT_ROWS = 8_000
#: A feature needs this many occurrences in the fitted documents to get a weight.
LEAST_SEEN = 6
#: Tail probability of the best grade from which a document is kept.
KEEP_FROM = 0.65
#: Times that a shape feature counts.
SHAPE_WEIGHT = 4
CACHE_WORDS = 100_000

_LETTER = LETTER.copy()
_LETTER[0x80:] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_NOISE = MARK & ~_DIGIT
_NOISE[list(b".,'\"()-:;?")] = False


def feature_hash(name: bytes) -> int:
    """32 bits that stand for a feature."""
    return xxhash.xxh32_intdigest(name)


def beginnings(piece: bytes) -> list[bytes]:
    """Beginnings of four to seven bytes of a longer piece: they stand for inflected and compound forms."""
    return [b"\x02" + piece[:n] for n in (4, 5, 6, 7) if len(piece) > n]


@dataclass(frozen=True)
class Batch:
    """Features of a run of texts: distinct pieces, which text holds which (each pair once), and shapes."""

    names: list[bytes]
    text: np.ndarray
    code: np.ndarray
    shapes: list[list[bytes]]


def features_of(texts: pa.Array) -> Batch:
    """Pieces (words and runs of marks, A-Z lower-cased) and graded properties of whole texts."""
    data, edges = text_bytes(texts)
    folded = LOWER[data]
    starts, ends = word_pieces(folded, edges)
    codes, names = name_pieces(folded, starts, ends)
    first = np.searchsorted(starts, edges)
    count = np.diff(first)
    pairs = np.unique(np.repeat(np.arange(len(count)), count) * max(1, len(names)) + codes)
    text, code = np.divmod(pairs, max(1, len(names)))
    distinct = np.bincount(text, minlength=len(count))
    length = sums_between(ends - starts, first)
    sums = {k: sums_between(kind[data], edges) for k, kind in (("letters", _LETTER), ("upper", _UPPER), ("digits", _DIGIT), ("marks", _NOISE))}
    shapes = []
    for k, (t, n) in enumerate(zip(texts.to_pylist(), np.diff(edges).tolist(), strict=True)):
        lines = (t or "").split("\n")
        shapes.append(_shape(n, int(count[k]), int(distinct[k]), int(length[k]), {c: int(v[k]) for c, v in sums.items()}, len(set(lines)) / len(lines)))
    return Batch(names, text, code, shapes)


def _shape(n: int, count: int, distinct: int, length: int, sums: dict[str, int], lines: float) -> list[bytes]:
    """Graded properties of a text, named as words that no text holds."""
    size = min(9, max(1, count).bit_length() - 1)
    out = [f"size={size}", f"distinct={size // 2}:{10 * distinct // max(1, count)}", f"lines={int(10 * lines)}"]
    out += [f"mean={min(15, length // max(1, count))}", f"digits={min(10, 50 * sums['digits'] // max(1, n))}"]
    # Cumulative levels: a text over a level has the features of all lower ones.
    out += [f"upper>{t}" for t in (5, 10, 20, 40, 60, 80) if 100 * sums["upper"] > t * sums["letters"]]
    out += [f"marks>{t}" for t in (0.2, 0.5, 1, 2, 4, 8, 16) if 100 * sums["marks"] > t * n]
    # A few properties stand against hundreds of words, so each counts several times.
    return [b"\x01" + f.encode() for f in out] * SHAPE_WEIGHT


def hashed(batch: Batch) -> list[np.ndarray]:
    """Feature hashes of each text of a batch."""
    own = np.array([feature_hash(n) for n in batch.names], np.uint32)
    begun = [[feature_hash(b) for b in beginnings(n)] for n in batch.names]
    edge = np.searchsorted(batch.text, np.arange(len(batch.shapes) + 1))
    out = []
    for k, shape in enumerate(batch.shapes):
        codes = batch.code[edge[k] : edge[k + 1]]
        starts = {h for c in codes.tolist() for h in begun[c]}
        out.append(np.concatenate([own[codes], np.fromiter(starts, np.uint32, len(starts)), np.array([feature_hash(f) for f in shape], np.uint32)]))
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """Sparse weights by feature hash and ascending thresholds."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def tails(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1 .. K - 1."""
        return [1.0 / (1.0 + float(np.exp(min(60.0, max(-60.0, t - score))))) for t in self.thresholds]

    def scorer(self) -> Callable[[pa.Array], np.ndarray]:
        """Function from texts to their scores; the weights of each piece are looked up once in a worker."""
        weights = self.weights
        # Beginnings with a weight get numbers, so that each counts once in a text.
        number: dict[bytes, int] = {}
        begun_weights: list[float] = []

        def look(piece: bytes) -> tuple[float, tuple[int, ...]]:
            found = []
            for b in beginnings(piece):
                if b not in number:
                    w = weights.get(feature_hash(b), 0.0)
                    if not w:
                        continue
                    number[b] = len(begun_weights)
                    begun_weights.append(w)
                found.append(number[b])
            return weights.get(feature_hash(piece), 0.0), tuple(found)

        cache = TwoAgeCache(look, CACHE_WORDS)

        def score(texts: pa.Array) -> np.ndarray:
            batch = features_of(texts)
            found = list(map(cache.__getitem__, batch.names))
            n = len(batch.shapes)
            own = np.array([f[0] for f in found])
            total = np.bincount(batch.text, own[batch.code], n) if len(found) else np.zeros(n)
            size = np.array([len(f[1]) for f in found], np.int64)
            flat = np.array([b for f in found for b in f[1]], np.int64)
            if len(flat):
                first = np.cumsum(size) - size
                many = size[batch.code]
                where = np.repeat(first[batch.code] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                pairs = np.unique(np.repeat(batch.text, many) * len(begun_weights) + flat[where])
                text, begun = np.divmod(pairs, len(begun_weights))
                total = total + np.bincount(text, np.array(begun_weights)[begun], n)
            return total + np.array([sum(weights.get(feature_hash(f), 0.0) for f in s) for s in batch.shapes])

        return score


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def thresholds_of(p: np.ndarray, d: int) -> np.ndarray:
    """Ascending thresholds from parameters: the first one and the logarithms of the gaps."""
    return p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def loss_and_gradient(p: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, d: int, k: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of grades ``y`` with its ridge term, and the gradient.

    ``p``: ``d`` weights, the first threshold and the logarithms of the gaps. Row
    ``rows[i]`` holds feature ``cols[i]``.
    """
    n, w = len(y), p[:d]
    s = np.bincount(rows, w[cols], n) if d else np.zeros(n)
    edges = np.concatenate([[-np.inf], thresholds_of(p, d), [np.inf]])
    hi, lo = _sigmoid(edges[y + 1] - s), _sigmoid(edges[y] - s)
    hi[y == k - 1], lo[y == 0] = 1.0, 0.0
    inside = np.maximum(hi - lo, 1e-9)
    dens_hi, dens_lo = hi * (1 - hi), lo * (1 - lo)
    by_score = (dens_hi - dens_lo) / inside / n
    by_theta = np.bincount(y, -dens_hi / inside, k)[: k - 1] / n + np.bincount(y, dens_lo / inside, k)[1:] / n
    by_gap = np.exp(p[d + 1 :]) * by_theta[::-1].cumsum()[::-1][1:]
    grad = np.concatenate([np.bincount(cols, by_score[rows], d) + l2 * w, [by_theta.sum()], by_gap])
    return float(-np.log(inside).mean() + l2 * (w @ w) / 2), grad


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = 160, l2: float = 1e-3, rate: float = 0.05) -> OrdinalModel:
    """Maximum likelihood of the cumulative link by Adam over all rows.

    Row order does not matter; a feature that repeats within a row counts as often.
    """
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    keys, code, seen = np.unique(np.concatenate(features) if features else np.zeros(0, np.uint32), return_inverse=True, return_counts=True)
    good = seen >= LEAST_SEEN
    place = np.cumsum(good) - 1
    mask = good[code]
    rows, cols = rows[mask], place[code[mask]]
    keys = keys[good]
    y = np.asarray(grades, np.int64)
    d, k = len(keys), n_grades
    share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y), 1e-4, 1 - 1e-4)
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(d), [first[0]], np.log(np.maximum(1e-2, np.diff(first)))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        _, grad = loss_and_gradient(p, rows, cols, y, d, k, l2)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        p = p - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return OrdinalModel({int(h): float(x) for h, x in zip(keys, p[:d], strict=True) if abs(x) > 1e-4}, tuple(map(float, thresholds_of(p, d))))


def fit_model(documents: DataFrame, ratings: DataFrame, n_grades: int = 3, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on at most ``fit_rows`` rated documents.

    Null ids or grades are left out; of several grades of one document the lowest
    counts, of several texts of one id the first by hash. Without rated documents
    the model has no thresholds and keeps everything.
    """
    chosen = (
        ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
        .where("id is not null and grade is not null")
        .groupBy("id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    )
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most fit_rows rows of two numbers, so the documents need not be shuffled.
    rated = docs.join(F.broadcast(chosen), "id")

    def make():
        return lambda texts: [[f.view(np.int32) for f in hashed(features_of(texts))]]

    rows = map_texts(rated, "text", [T.StructField("features", T.ArrayType(T.IntegerType()))], make, keep=["id", "grade"], batch_chars=RUN_BYTES, arrow=True).toArrow()
    seen: dict[int, tuple[int, np.ndarray]] = {}
    for i, g, f in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
        own = np.sort(f.values.to_numpy(zero_copy_only=False).view(np.uint32))
        if i not in seen or own.tobytes() < seen[i][1].tobytes():
            seen[i] = (g, own)
    if not seen:
        return OrdinalModel()
    order = sorted(seen)
    return fit([seen[i][1] for i in order], np.array([seen[i][0] for i in order]), n_grades)


def rate(df: DataFrame, model: OrdinalModel, text_col: str = "text", keep: list[str] | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Add ``expected_grade, tail_probabilities, p_best, kept`` to every row.

    Null and empty texts are rated by their shape alone. Columns of these names are
    replaced. A model without thresholds gives null figures and keeps every row.
    """

    def make():
        score = model.scorer()

        def run(texts: pa.Array):
            if not model.thresholds:
                return [[None] * len(texts)] * 3 + [[True] * len(texts)]
            tails = [model.tails(s) for s in score(texts).tolist()]
            return [[sum(t) for t in tails], tails, [t[-1] for t in tails], [t[-1] >= keep_from for t in tails]]

        return run

    fields = [
        T.StructField("expected_grade", T.DoubleType()),
        T.StructField("tail_probabilities", T.ArrayType(T.DoubleType())),
        T.StructField("p_best", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
    return map_texts(df, text_col, fields, make, keep, RUN_BYTES, arrow=True)


def grades(labels: DataFrame) -> DataFrame:
    """Grade 0 for toxic, 1 for poor, 2 for good documents, from the two flags of ``labels``."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def quality_query(spark, sf_dir: str) -> DataFrame:
    """op1: every document rated by a model fitted on the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_model(docs, grades(table(spark, sf_dir, "labels")))
    return rate(docs, model, keep=["doc_id"]).select("doc_id", "expected_grade", F.element_at("tail_probabilities", 1).alias("p_not_worst"), "p_best", "kept")
