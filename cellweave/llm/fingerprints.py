"""Canonical exact digests.

A text is brought to canonical form (NFKC, case folding, white space folded to
single spaces, ends trimmed) and named by the 128-bit xxh3 hash of its UTF-8 form.
Inside a bucket of equal hashes the canonical bytes are compared; should two
different texts ever share a hash, all names in that bucket are widened by their
SHA-256, so equal names always mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import TEXT, map_arrow, map_texts, materialize, row_runs, table
from cellweave.llm.token_files import bucket_of, range_bounds

#: Bits of the filter that picks texts whose bytes are compared: 16 for each repeated
#: hash, never more than 8 MiB in all. A full filter compares more texts, never fewer.
FILTER_MOST = 1 << 26
#: Shared hashes of different texts that are listed one by one; more widen all names.
LISTED = 10_000


def canonical(text: str) -> bytes:
    """Canonical form of a text, as UTF-8."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> bytes:
    """16 bytes that name a canonical text."""
    return xxhash.xxh3_128_digest(data)


def _places(key: bytes, bits: int) -> list[int]:
    return [int.from_bytes(key[i : i + 4], "little") % bits for i in (0, 4, 8, 12)]


def shared_hashes(df: DataFrame, text_col: str) -> frozenset[bytes] | None:
    """Hashes that different canonical texts of ``df`` share; None: more than LISTED.

    Rows are first grouped by hash alone. Texts of repeated hashes, picked by a
    bounded filter, are compared in full: each task compares its own and passes on
    one text for each hash, so a group of copies of any size moves one text a task.
    """
    hashes = map_texts(df, text_col, [T.StructField("h", T.BinaryType())], lambda: lambda ts: [[digest(canonical(t)) for t in ts]], keep=[])
    repeated = materialize(hashes.groupBy("h").count().where("count > 1").select("h"), "hashes")
    n = repeated.count()
    if not n:
        return frozenset()
    bits = min(FILTER_MOST, max(1 << 16, 16 * n))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits, bool)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                marks[_places(key, bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], names=["m"])

    found = repeated.coalesce(4).mapInArrow(mark, "m binary").collect()
    marks = np.bitwise_or.reduce([np.frombuffer(r["m"], np.uint8) for r in found]).tobytes()

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        for part in (p for batch in batches for p in row_runs(batch, 0)):
            out = []
            for text in part.column(0).to_pylist():
                data = canonical(text)
                key = digest(data)
                if all(marks[p >> 3] >> (p & 7) & 1 for p in _places(key, bits)) and seen.get(key) != data:
                    seen.setdefault(key, data)
                    out.append((key, data))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.binary())], names=["h", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (b"", b"")
        for part in (p for batch in batches for p in row_runs(batch, 1)):
            out = []
            for pair in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if pair[0] == last[0] and pair[1] != last[1]:
                    out.append(pair[0])
                last = pair
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["h"])

    texts = map_arrow(df.select(F.coalesce(F.col(text_col), F.lit("")).alias(TEXT)), differ, "h binary, data binary")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clashes = texts.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(compare, "h binary").distinct().limit(LISTED + 1).collect()
    return None if len(clashes) > LISTED else frozenset(bytes(r["h"]) for r in clashes)


def namer(clashes: frozenset[bytes] | None):
    """Function from canonical bytes to the fingerprint string."""

    def name(data: bytes) -> str:
        key = digest(data)
        if clashes is None or key in clashes:
            return f"{key.hex()}-{hashlib.sha256(data).hexdigest()}"
        return key.hex()

    return name


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` to every row. Null texts count as empty; a column of that name is replaced."""
    name = namer(shared_hashes(df, text_col))
    return map_texts(df, text_col, [T.StructField("fingerprint", T.StringType())], lambda: lambda ts: [[name(canonical(t)) for t in ts]], keep)


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each fingerprint: ``fingerprint, first_id, n``; null ids count but are never first."""
    named = fingerprints(df.select(id_col, text_col), text_col, keep=[id_col])
    return named.groupBy("fingerprint").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n"))


def with_next_text(df: DataFrame, id_col: str, text_col: str, each, schema: str) -> DataFrame:
    """Apply ``each(ids, texts, next texts)`` (lists in, list of lists out) where next means the
    next lower id, and after the lowest the highest.

    Rows are dealt by ranges of ids. The row at the upper end of a range goes to the
    range above it too, and the highest row to the lowest range, so no task sees more
    than its range. Null ids count as lowest; rows of equal ids follow one another by
    the hash of their texts.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = range_bounds(src, "id", parts)
    top = src.agg(F.max("id").alias("m")).first()["m"]
    own = bucket_of("id", bounds)
    targets = F.array(F.struct(own.alias("bucket"), F.lit(0).alias("ghost")))
    if bounds:
        above = F.struct((own + 1).alias("bucket"), F.lit(1).alias("ghost"))
        targets = F.when(F.col("id").isin(bounds), F.concat(targets, F.array(above))).otherwise(targets)
    wrap = F.array(F.struct(F.lit(0).alias("bucket"), F.lit(2).alias("ghost")))
    targets = F.when(F.col("id").eqNullSafe(F.lit(top)), F.concat(targets, wrap)).otherwise(targets)
    out = T.StructType.fromDDL(schema)
    names = out.names
    dealt = (
        src.withColumn("to", F.explode(targets))
        .select("to.bucket", "to.ghost", "id", "text")
        .repartitionById(parts, F.col("bucket"))  # one range for each task
        .sortWithinPartitions("bucket", "ghost", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wait = None
        for part in (p for batch in batches for p in row_runs(batch, 3)):
            ids, texts, nexts = [], [], []
            for bucket, ghost, key, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if wait is not None and wait[0] == bucket:
                    ids.append(wait[1])
                    texts.append(wait[2])
                    nexts.append(text)
                wait = None if ghost else (bucket, key, text)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(each(ids, texts, nexts), to_arrow_schema(out), strict=True)], names=names)

    return map_arrow(dealt, run, out)


def edited_text(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_query(spark, sf_dir: str) -> DataFrame:
    """op9: fingerprints of whole documents and of their edited texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    name = namer(shared_hashes(docs, "text"))

    def each(ids, texts, nexts):
        forms = [canonical(t) for t in texts]
        edits = [edited_text(t, n) for t, n in zip(texts, nexts, strict=True)]
        edited = [canonical(e) for e in edits]
        return [
            ids,
            [len(t) for t in texts],
            [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edits],
            list(map(name, forms)),
            list(map(name, edited)),
            [float(a == b) for a, b in zip(forms, edited, strict=True)],
            [float(a == canonical(n)) for a, n in zip(forms, nexts, strict=True)],
        ]

    return with_next_text(
        docs, "doc_id", "text", each,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
