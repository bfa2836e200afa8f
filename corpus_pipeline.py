"""Corpus pipeline: quality, near-duplicates, decontamination, personal data, encoding.

``STAGES`` lists the steps in order. Each takes ``(spark, docs, sf_dir)``, works on
all rows that the step before it kept and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.chunk_codec import round_trip
from cellweave.llm.common import KeyFilter, discard, free_name, materialize, may_hold, table, vocabulary_path
from cellweave.llm.decontaminate import contamination
from cellweave.llm.near_dedup import near_duplicates
from cellweave.llm.ordinal_quality import fit_model, grades, rate
from cellweave.llm.privacy import sanitise

#: No SQL here expresses the fitted classifier, MinHash candidates or BPE; tests hold the pipeline against brute force.
ORACLE_SQL = None


def _carried(docs: DataFrame) -> DataFrame:
    """All other columns as one value beside the text, so that no name of theirs meets one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("carried_row"), "text")


def _put_back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order."""
    return found.select(*[F.col("text") if c == "text" else F.col(f"carried_row.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade reaches the classifier's limit.

    Null and empty texts are rated by their shape; rows of one id are rated each for
    itself, whatever their number. Without labels every document is kept.
    """
    model = fit_model(docs.select("doc_id", "text"), grades(table(spark, sf_dir, "labels")))
    return _put_back(rate(_carried(docs), model, keep=["carried_row", "text"]).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Rows with a null id are all kept; of several rows with one kept id the first by
    text stays.
    """
    found = materialize(near_duplicates(docs.select("doc_id", "text")).select("doc_id", "kept"), "near")
    known = found.where("doc_id is not null")
    dropped = known.where("not kept").select("doc_id").distinct()
    repeated = known.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    # A bounded filter lets through all dropped ids and few others: only their rows are joined, the rest stay where they are.
    box = free_name("__may", docs)
    marked = may_hold(docs, "doc_id", KeyFilter.of(dropped, "doc_id"), box)
    looked = marked.where(F.col(box)).join(dropped, "doc_id", "left_anti")
    kept = marked.where(~F.col(box)).unionByName(looked).drop(box)
    if not repeated.isEmpty():
        carried = kept.join(repeated, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried_row"))
        first = carried.withColumn("place", F.row_number().over(Window.partitionBy("carried_row.doc_id").orderBy("carried_row.text", F.xxhash64("carried_row"))))
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(first.where("place = 1").select("carried_row.*"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none, repeated rows go or stay together."""
    found = contamination(_carried(docs), table(spark, sf_dir, "benchmark"), keep=["carried_row", "text"])
    return _put_back(found.where("not contaminated"), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms put in general terms; n_chars follows the text. Null texts stay null."""
    return sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and the digest of what those decode to; null texts have no ids, repeated rows stay."""
    path = vocabulary_path("byte_bpe_50k.json")
    base = docs.select("doc_id", "lang", "source", "text")
    return round_trip(base, path, keep=["doc_id", "lang", "source"], ids_col="ids")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
