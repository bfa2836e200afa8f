"""Reading and writing of cell tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_cells(
    spark: SparkSession,
    paths: Sequence[str],
    method: str = "cellseg",
    regions: Sequence[str] | None = None,
    conditions: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Union of segmentation CSV files; the first column is an index and is dropped.

    Adds ``region_num`` (position of the file), and ``unique_region`` and
    ``condition`` where lists are given. ``cellseg`` files have names like
    ``prefix:marker``, of which the last part stays, and ``size`` becomes ``area``.
    Files without a column get nulls in it.
    """
    for given in (regions, conditions):
        if given is not None and len(given) != len(paths):
            raise ValueError("one value is needed for each file")
    parts = []
    for i, path in enumerate(paths):
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
        df = df.drop(df.columns[0]).drop(*[c for c in df.columns[1:] if "Unnamed: 0" in c])
        if method == "cellseg":
            names = [c.split(":")[-1] for c in df.columns]
            df = df.toDF(*["area" if n == "size" else n for n in names])
        df = df.withColumn("region_num", F.lit(str(i)))
        if regions is not None:
            df = df.withColumn("unique_region", F.lit(regions[i]))
        if conditions is not None:
            df = df.withColumn("condition", F.lit(conditions[i]))
        parts.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Channel or marker names, one a line, quotes and blanks trimmed, empty lines left out."""
    name = F.trim(F.regexp_replace("value", "[\"',]", ""))
    return spark.read.text(path).select(name.alias("name")).where("name <> ''")


def list_files(spark: SparkSession, path: str, suffix: str, recursive: bool = False) -> DataFrame:
    """``path, name, length`` of files with a suffix, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", recursive).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def bare_name(path: str, suffix: str = "_plot.png_cut.png"):
    """Column: file name of a path column without ``suffix``."""
    return F.replace(F.element_at(F.split(F.col(path), "/"), -1), F.lit(suffix), F.lit(""))


def write_by_region(df: DataFrame, path: str, region: str, columns: Sequence[str] | None = None) -> None:
    """CSV sink with one folder a region, for viewers."""
    out = df.select(region, *[c for c in columns if c != region]) if columns else df
    out.write.option("header", True).partitionBy(region).mode("overwrite").csv(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """Name a result for SQL; the way in which results are kept beside a table."""
    df.createOrReplaceTempView(name)
    return df


def split_markers(df: DataFrame, markers: Sequence[str], dropped: Sequence[str] = ()) -> DataFrame:
    """Markers gathered in ``features`` (without ``dropped``), all other columns beside them."""
    kept = [m for m in markers if m not in dropped]
    rest = [c for c in df.columns if c not in markers]
    return df.select(*rest, F.array(*[F.col(m).cast("double") for m in kept]).alias("features"))


def format_spatial(df: DataFrame, x: str, y: str, markers: Sequence[str] = ()) -> DataFrame:
    """Coordinates gathered in ``spatial`` (and markers in ``features``), all other columns beside them; x and y must be numeric."""
    for c in (x, y):
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise TypeError(f"{c} is not numeric")
    out = df.withColumn("spatial", F.array(F.col(x).cast("double"), F.col(y).cast("double")))
    return split_markers(out, markers) if markers else out


def cells_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells made from the events table: unique integer coordinates, eight regions, two conditions, a label grid."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    x, y = (F.col("event_id") * 7919) % 2003, (F.col("event_id") * 104729) % 1999
    cells = events.select(
        F.col("event_id").alias("cell_id"),
        F.concat(F.lit("reg"), (F.col("user_id") % 8).cast("string")).alias("region"),
        x.alias("x"),
        y.alias("y"),
        F.col("event_type").alias("cell_type"),
        F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("cond"),
        "value",
        "user_id",
    )
    label = (F.floor(F.col("x") / 500) + F.floor(F.col("y") / 500)) % 4
    return cells.withColumn("cn", F.concat(F.lit("CN"), label.cast("string")))


MARKERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def marker_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker matrix made from lineitem, its year of shipping as region."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", *MARKERS, F.year("l_shipdate").cast("long").alias("region"))


def image_info(df: DataFrame, tissue: str, region: str, folder: str, ending: str = ".png") -> DataFrame:
    """``tissue, region, path``: one row for each tissue and region that occurs, with the place of its image; nulls give a null path."""
    pairs = df.select(F.col(tissue).cast("string").alias("tissue"), F.col(region).cast("string").alias("region")).distinct()
    return pairs.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "tissue", F.lit("/"), "region", F.lit(ending)))
