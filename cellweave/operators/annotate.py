"""Label transfer, label maps and clustering of cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.communities import Prepared, heaviest_labels, leiden_communities
from cellweave.operators.marker_graph import fuzzy_weights, marker_neighbours
from cellweave.runtime import discard, materialize


def map_labels(df: DataFrame, column: str, names: Mapping, out: str) -> DataFrame:
    """Values replaced by a small map; null where it has none."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(column)))


def merge_labels(df: DataFrame, new: DataFrame, cell_id: str, old_label: str, new_label: str, out: str) -> DataFrame:
    """New labels by id, the old label where a cell has none (subclusters put back into the whole)."""
    side = new.select(cell_id, F.col(new_label).alias("__new"))
    return df.join(side, cell_id, "left").withColumn(out, F.coalesce("__new", F.col(old_label).cast("string"))).drop("__new")


def train_classifier(df: DataFrame, label: str, markers: Sequence[str], seed: int = 0, test_share: float = 0.33):
    """Multinomial logistic model of a label. Returns the model and predictions on the held-out rows; null labels are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler

    rows = df.where(F.col(label).isNotNull())
    train, test = rows.randomSplit([1 - test_share, test_share], seed)
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(rows)
    steps = [
        index,
        VectorAssembler(inputCols=list(markers), outputCol="__raw", handleInvalid="skip"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
        LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__p", probabilityCol="probability", maxIter=50, regParam=1e-3),
        IndexToString(inputCol="__p", outputCol="predicted", labels=index.labels),
    ]
    model = Pipeline(stages=steps).fit(train)
    return model, predict(model, test, keep_truth=True)


def predict(model, df: DataFrame, probabilities: bool = False, keep_truth: bool = False) -> DataFrame:
    """Add ``predicted`` and, if asked for, the array of class probabilities."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    stages = model.stages if keep_truth else model.stages[1:]
    out = PipelineModel(stages).transform(df)
    columns = [F.col(c) for c in df.columns] + [F.col("predicted")]
    return out.select(*columns, *([vector_to_array("probability").alias("probabilities")] if probabilities else []))


def label_propagation(edges: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """``id, community`` of a weighted graph ``src, dst, weight``: each vertex has the heaviest label around it, its own on ties."""
    return heaviest_labels(edges, places)


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of ``labels`` (id, community) on a weighted graph ``src, dst, weight``; loops count once."""
    sides = edges.join(labels.withColumnsRenamed({"id": "src", "community": "a"}), "src").join(labels.withColumnsRenamed({"id": "dst", "community": "b"}), "dst")
    ends = F.array(F.struct(F.col("a").alias("c"), (F.col("a") == F.col("b")).alias("inside")), F.struct(F.col("b").alias("c"), F.lit(False).alias("inside")))
    degrees = sides.select(F.explode(ends).alias("e"), "weight").groupBy("e.c").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("e.inside"), F.col("weight")).otherwise(0.0)).alias("inside"))
    twice, inside, squares = degrees.agg(F.sum("k"), F.sum("inside"), F.sum(F.col("k") * F.col("k"))).first()
    return 2 * inside / twice - resolution * squares / (twice * twice) if twice else 0.0


def modularity_communities(edges: DataFrame, resolution: float = 1.0, places: DataFrame | None = None) -> DataFrame:
    """``id, community`` of a weighted undirected graph ``src, dst, weight``: connected communities by moves, refinement and merging."""
    return leiden_communities(edges, resolution, places)


def resolution_sweep(edges: DataFrame, resolutions: Sequence[float], places: DataFrame | None = None) -> DataFrame:
    """``resolution, communities, modularity`` of the communities at each resolution."""
    rows, ready = [], Prepared(edges, places)
    for r in resolutions:
        found = leiden_communities(ready, r)
        rows.append((float(r), found.select("community").distinct().count(), modularity(ready.graph, found, r)))
        discard(found)
    return edges.sparkSession.createDataFrame(rows, "resolution double, communities long, modularity double")


def marker_communities(df: DataFrame, cell_id: str, vector: str, k: int = 10, resolution: float = 1.0) -> DataFrame:
    """``id, community``: cells by the communities of their neighbour graph in marker space, fuzzy weights on its edges.

    Cells without a whole vector, or alone, have no row. Communities are named by their least cell.
    """
    graph = materialize(fuzzy_weights(marker_neighbours(df, cell_id, vector, k), k), "weights")
    return leiden_communities(graph, resolution)


def subclustered(df: DataFrame, cell_id: str, vector: str, label: str, subset: Sequence, out: str, k: int = 10, resolution: float = 1.0) -> DataFrame:
    """Cells of some labels clustered again in marker space and put back: ``out`` is the new community as text, elsewhere the old label."""
    found = marker_communities(df.where(F.col(label).isin(list(subset))), cell_id, vector, k, resolution)
    named = found.select(F.col("id").alias(cell_id), F.col("community").cast("string").alias("__community"))
    return merge_labels(df, named, cell_id, label, "__community", out)


def cluster_markers(df: DataFrame, markers: Sequence[str], n: int, seed: int = 42, out: str = "cluster") -> DataFrame:
    """K-means clusters of standardised markers as strings."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=list(markers), outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), KMeans(k=n, seed=seed, featuresCol="__x", predictionCol="__c")]
    return Pipeline(stages=steps).fit(df).transform(df).select(*df.columns, F.col("__c").cast("string").alias(out))
