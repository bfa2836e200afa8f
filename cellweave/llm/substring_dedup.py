"""Substring dedup: repeated token windows merged into maximal removal intervals.

Every window of WINDOW words gets a Rabin-Karp hash: a polynomial over the hashes of
its words (xxh3 of their bytes), rolled over all words of a batch at once. A window is removed from a
document if it also starts in a document with a smaller id, so what has to be known
of each hash is the least id that holds it.

1. Each task takes its documents in blocks. Inside a block the least id of each hash
   is found; windows of higher ids are settled there. Only the windows of the least
   id travel on, so a passage shared by any number of documents moves one entry a
   block, however many hold it.
2. Entries are dealt by hash into buckets of bounded size, packed as arrays. For each
   hash the least id of all blocks settles the rest.
3. Decisions meet their documents again by groups of ids; windows become word intervals, which
   are merged and cut out.

A second polynomial stands on an independent hash of the words. Inside a block both have
to agree. Buckets are dealt by the second, so in step 2 two windows count as equal if 64
bits of the first agree and log2(buckets) of the second. As buckets grow with the windows,
n windows have n * BUCKET_ENTRIES / 2**65 false equalities to be expected: one in 2e13
windows (some 100 TB of text), one in a million runs over 100 MB. In step 3 the windows of
one document are looked up among those it has to lose, by the first hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import map_arrow, row_runs, table
from cellweave.llm.vector_text import SPACE, name_pieces, text_bytes

WINDOW = 13
#: Words that a task compares before it passes entries on.
BLOCK_WORDS = 1_500_000
#: Mean entries of a bucket in the second step.
BUCKET_ENTRIES = 2_000_000

#: Groups of documents to which decisions are sent: for each shuffle partition, and bytes of text of one at most.
GROUPS = 4
GROUP_BYTES = 32_000_000

_ROLL = np.uint64(0xD6E8FEB86659FD93)
#: Of the hash that deals windows into buckets.
_DEAL = np.uint64(0xA0761D6478BD642F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts in one byte array; edges part the texts."""
    solid = ~SPACE[data]
    begin = solid.copy()
    begin[1:] &= SPACE[data[:-1]]
    first = edges[:-1][np.diff(edges) > 0]
    begin[first] = solid[first]
    stop = SPACE[data]
    stop = np.append(stop, True)
    stop[1:-1] |= begin[1:]
    stops = np.flatnonzero(stop)
    starts = np.flatnonzero(begin)
    return starts, stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word's bytes: the halves of its 128-bit xxh3."""
    codes, words = name_pieces(data, starts, ends)
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)[codes]
    return both[:, 0], both[:, 1]


def rolled(words: np.ndarray, window: int, base: np.uint64) -> np.ndarray:
    """Polynomial of each ``window`` word hashes."""
    n = max(0, len(words) - window + 1)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h *= base
        h += words[k : k + n]
    return h


def window_hashes(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and word position of every window inside one text; counts: words of each text."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = rolled(words, window, _ROLL)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(text[:n] == text[window - 1 :])
    first = np.cumsum(counts) - counts
    return _mixed(h[inside]), text[inside], inside - first[text[inside]]


def intervals(positions: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal word intervals (end exclusive) that windows at ascending positions cover."""
    if not len(positions):
        return []
    cut = np.flatnonzero(np.diff(positions) > window)
    return list(zip(positions[np.concatenate([[0], cut + 1])].tolist(), (positions[np.concatenate([cut, [len(positions) - 1]])] + window).tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _settle(h: np.ndarray, ids: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """For entries (hash, id): whether a smaller id has the same hash, and the same ``other`` one where given."""
    order = np.argsort(h, kind="stable") if other is None else np.lexsort((other, h))
    s = h[order]
    new = s[1:] != s[:-1]
    if other is not None:
        new |= other[order][1:] != other[order][:-1]
    first = np.flatnonzero(np.concatenate([[True], new])) if len(s) else np.zeros(0, np.int64)
    own = ids[order]
    least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(s)))) if len(s) else own
    out = np.empty(len(h), bool)
    out[order] = own > least
    return out


_ROWS = "bucket int, doc long, text_hash long, spans binary, hashes binary, docs binary, counts binary"


def _local(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1: settled intervals (bucket -1) and packed entries of each block."""
    held: list[tuple] = []
    size = 0

    def out():
        ids = np.concatenate([b[0] for b in held])
        keys = np.concatenate([b[1] for b in held])
        counts = np.concatenate([b[2] for b in held])
        h, text, at = window_hashes(np.concatenate([b[3] for b in held]), counts, window)
        first = np.cumsum(counts) - counts
        deal = _mixed(rolled(np.concatenate([b[4] for b in held]), window, _DEAL)[first[text] + at])
        gone = _settle(h, ids[text], deal)
        deal = deal[~gone]
        rows: list[tuple] = []
        t, p = text[gone], at[gone]
        if len(t):
            part = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1, [len(t)]]).tolist()
            for a, b in zip(part, part[1:], strict=False):
                spans = np.array(intervals(p[a:b], window), "<i4").tobytes()
                rows.append((-1, int(ids[t[a]]), int(keys[t[a]]), spans, None, None, None))
        h, text = h[~gone], text[~gone]
        bucket = ((deal >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        h, text, bucket = h[order], text[order], bucket[order]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[k], edge[k + 1]
            rows.append((k, None, None, None, h[a:b].tobytes(), *_runs(ids[text[a:b]])))
        return _batch(rows)

    for part in (p for batch in batches for p in row_runs(batch, 2)):
        data, edges = text_bytes(part.column(2))
        starts, ends = word_bounds(data, edges)
        per = np.diff(np.searchsorted(starts, edges))
        held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), per, *word_hashes(data, starts, ends)))
        size += len(starts)
        if size >= BLOCK_WORDS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "doc", "text_hash", "spans", "hashes", "docs", "counts"])


def _runs(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Ids without repeats of neighbours, and how often each stands."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
    return ids[first].tobytes(), np.diff(np.append(first, len(ids))).astype("<u4").tobytes()


def _global(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Step 2: one row for each bucket and group of documents with all hashes to be removed there; settled intervals pass."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        h = np.concatenate([np.frombuffer(x[0], "<u8") for x in held])
        ids = np.concatenate([np.repeat(np.frombuffer(x[1], "<i8"), np.frombuffer(x[2], "<u4")) for x in held])
        gone = _settle(h, ids)
        h, ids = h[gone], ids[gone]
        group = ids % groups
        order = np.lexsort((ids, group))
        h, ids, group = h[order], ids[order], group[order]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).tolist() if len(group) else [0]
        return _batch([(int(group[a]), None, None, None, h[a:b].tobytes(), *_runs(ids[a:b])) for a, b in zip(edge, edge[1:], strict=False)])

    at, held = None, []
    for part in (p for batch in batches for p in row_runs(batch, 3, 4, 5, 6, most=8_000_000)):
        rows = list(zip(*(part.column(i).to_pylist() for i in range(7)), strict=True))
        settled = [(r[1] % groups, *r[1:]) for r in rows if r[0] < 0]
        if settled:
            yield _batch(settled)
        for r in rows:
            if r[0] < 0:
                continue
            if held and r[0] != at:
                yield out(held)
                held = []
            at = r[0]
            held.append(r[4:7])
    if held:
        yield out(held)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Step 3: rows sorted by group, decisions before texts; one row for each text."""
    at, spans, found = None, {}, {}
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    for part in (p for batch in batches for p in row_runs(batch, 4, 5, 6, 7, 8, most=4_000_000)):
        out: list[tuple] = []
        for group, kind, doc, text_hash, span, hashes, docs, counts, text in zip(*(part.column(i).to_pylist() for i in range(9)), strict=True):
            if group != at:
                at, spans, found = group, {}, {}
            if kind == 0:
                if span is not None:
                    spans.setdefault((doc, text_hash), set()).add(span)
                else:
                    h, stop = np.frombuffer(hashes, "<u8"), 0
                    for d, n in zip(np.frombuffer(docs, "<i8").tolist(), np.frombuffer(counts, "<u4").tolist(), strict=True):
                        found.setdefault(d, []).append(h[stop : stop + n])
                        stop += n
                continue
            data = text.encode("utf-8")
            words = data.split()
            cut = [tuple(x) for s in spans.get((doc, text_hash), ()) for x in np.frombuffer(s, "<i4").reshape(-1, 2).tolist()]
            if doc in found and len(words) >= window:
                raw = np.frombuffer(data, np.uint8)
                starts, ends = word_bounds(raw, np.array([0, len(raw)]))
                h, _, place = window_hashes(word_hashes(raw, starts, ends)[0], np.array([len(starts)]), window)
                cut += intervals(place[np.isin(h, np.concatenate(found[doc]))], window)
            cut = merged(cut)
            kept, done = [], 0
            for a, b in cut:
                kept += words[done:a]
                done = b
            kept += words[done:]
            out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in cut]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])


def repeated_windows(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, n_words, n_removed, kept_sha256, removed`` (word intervals, end exclusive).

    Null texts have no words; texts shorter than a window lose none. Rows with a null
    id neither lose words nor make others lose any. Rows with equal ids count as one
    document; repeated rows are all kept. Other columns are ignored.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    known = src.where("doc is not null").select("doc", "text_hash", "text")
    size = known.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(parts, int(size / 7 / BUCKET_ENTRIES) + 1)
    entries = map_arrow(known, lambda batches: _local(batches, window, buckets), _ROWS)
    dealt = entries.repartition(parts, F.when(F.col("bucket") < 0, F.col("doc")).otherwise(F.col("bucket").cast("long"))).sortWithinPartitions("bucket")
    groups = max(parts * GROUPS, int(size / GROUP_BYTES) + 1)
    decided = map_arrow(dealt, lambda batches: _global(batches, groups), _ROWS).withColumnRenamed("bucket", "group")
    none = lambda kind: F.lit(None).cast(kind)
    # Null ids are dealt by text: nothing has to meet there.
    texts = src.select(
        F.pmod(F.coalesce("doc", "text_hash"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"), "doc", "text_hash",
        *[none("binary").alias(c) for c in ("spans", "hashes", "docs", "counts")], "text",
    )
    both = decided.select("group", F.lit(0).alias("kind"), "doc", "text_hash", "spans", "hashes", "docs", "counts", none("string").alias("text")).unionByName(texts)
    met = both.repartition(parts, "group").sortWithinPartitions("group", "kind")
    return map_arrow(met, lambda batches: _cut(batches, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: int, end: int>>")


def substring_query(spark, sf_dir: str) -> DataFrame:
    """op3 over every whole text of documents."""
    return repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
