"""The corpus pipeline stage by stage against brute force, and its queries' contract."""

import hashlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from cellweave.llm.common import tokenizer, vocabulary_path
from cellweave.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import brute_components, brute_hits, brute_spans


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_in_order(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "personal_data", "encode"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    graded = corpus_pipeline.quality(spark, docs, small).persist()
    assert graded.columns == columns and 0 < graded.count() < docs.count()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in graded.collect()}
    good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean([i in kept for i in good]) > 0.9

    near = corpus_pipeline.near_dedup(spark, graded, small).persist()
    want = {i for i, _, _, k in brute_components([(r["doc_id"], r["text"]) for r in graded.collect()]) if k}
    assert near.columns == columns and {r["doc_id"] for r in near.collect()} == want

    clean = corpus_pipeline.decontaminate(spark, near, small).persist()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = sorted((tuple(r) for r in near.collect() if not brute_hits(r["text"], items)[4]), key=repr)
    assert rows_of(clean) == want

    private = corpus_pipeline.personal_data(spark, clean, small).persist()
    assert private.columns == columns and private.count() == clean.count()
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in private.collect():
        assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not brute_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]] or "[TERM]" in r["text"]

    lib = tokenizer(vocabulary_path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    for r in corpus_pipeline.encode(spark, private, small).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_stages_take_odd_rows(spark, small):
    rows = [(1, None, None, None, None, "x"), (None, "some text of no id", "en", "s", 3, "y"), (2, "", "en", None, 0, "z"), (2, "", "en", None, 0, "z"), (3, "same words here again and again", "en", "s", 1, None), (4, "Same words here again and again", "en", "s", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns, name
        assert stage(spark, docs.where("false"), small).count() == 0
    assert corpus_pipeline.near_dedup(spark, docs, small).count() == 4  # one of the two equal rows and one of the pair go
    assert corpus_pipeline.encode(spark, docs, small).count() == len(rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.select(*columns)) == sorted(cursor.fetchall(), key=repr)


def test_queries_are_registered_once_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
