"""Token-id output: fixed-width bit packing with block offsets.

Each id takes ``bits = ceil(log2(vocabulary size))`` bits. A shard is one
self-describing byte string:

    magic "TPK1" | bits u8 | block ids u32 | first id u64 | ids u64 | documents u32
    | block offsets u32[blocks + 1] | document lengths u32[documents] | payload

All numbers are little-endian. Every block of ``block ids`` ids starts on a byte
boundary and the offsets say where, so any run of ids is unpacked with numpy from
the blocks that hold it. Shards are written through Spark's own writer (one binary
value a row), so that they reach any store Spark writes to and a lost task is
written anew.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import TwoAgeCache, map_arrow, map_texts, row_runs, shared_dir, special_tokens, table, tokenizer, vocabulary_path, worker_state
from cellweave.llm.vector_text import LETTER, LOWER, MARK, SPACE, gather, letter_ends, name_pieces, sums_between, text_bytes, texts_holding

MAGIC = b"TPK1"
HEAD = struct.Struct("<4sBIQQI")
BLOCK_IDS = 4096
#: Ids in a shard, beyond which the next document starts another one.
SHARD_IDS = 1 << 18
#: Shards in a file: a reader holds a file's values at once, so both numbers bound its memory.
FILE_SHARDS = 32
#: Distinct words that a worker remembers in each half of its cache.
CACHE_WORDS = 220_000
#: Bytes of text that are cut into pieces at a time.
RUN_BYTES = 4_000_000


def bits_for(vocabulary: int) -> int:
    """Least width that holds the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit packing, low bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def build_shard(documents: list[np.ndarray], first_id: int, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """Bytes of one shard. ``first_id``: ids before this shard in its file group."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u4").tobytes()
    lengths = np.array([len(d) for d in documents], dtype="<u4").tobytes()
    return HEAD.pack(MAGIC, bits, block_ids, first_id, len(ids), len(documents)) + offsets + lengths + b"".join(blocks)


class Shard:
    """Random access to the ids of a shard."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block_ids, self.first_id, self.n_ids, self.n_docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        blocks = -(-self.n_ids // self.block_ids)
        at = HEAD.size
        self.offsets = np.frombuffer(data, "<u4", blocks + 1, at).astype(np.int64)
        at += 4 * (blocks + 1)
        self.lengths = np.frombuffer(data, "<u4", self.n_docs, at).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.payload = memoryview(data)[at + 4 * self.n_docs :]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` (exclusive) of the shard, reading only their blocks."""
        if hi <= lo:
            return np.zeros(0, "<u4")
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        parts = [
            unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], min(self.block_ids, self.n_ids - b * self.block_ids), self.bits)
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[lo - first * self.block_ids : hi - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def word_pieces(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces of UTF-8 texts that a lower-casing word tokenizer treats apart.

    Cuts stand at ASCII white space, after a letter before an ASCII mark, and after
    an ASCII mark (but the apostrophe, which may join a contraction) before a letter.
    """
    n = len(data)
    space = SPACE[data]
    letter, mark = letter_ends(data), MARK[data]
    begin = np.zeros(n, bool)
    begin[1:] = space[:-1] | letter[:-1] & mark[1:] | mark[:-1] & (data[:-1] != 0x27) & LETTER[data[1:]]
    begin[edges[:-1][edges[:-1] < n]] = True
    begin &= ~space
    starts = np.flatnonzero(begin)
    # A piece ends where the next begins or at the first white space after it.
    stop = begin | space
    stop[0:1] = False
    stops = np.append(np.flatnonzero(stop), n)
    return starts, stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts


_ALPHABET = b"abcdefghijklmnopqrstuvwxyz"


class WordEncoder:
    """Ids of texts for a lower-casing tokenizer that drops white space, each distinct piece encoded once.

    Texts that hold a special string of the vocabulary go to the library whole.
    """

    def __init__(self, path: str, end_id: int | None):
        lib = tokenizer(path)
        self._special = [t.encode("utf-8") for t in special_tokens(path)]
        self._whole = lambda text: np.array(lib.encode(text, add_special_tokens=False).ids, np.uint32)
        self._width = width = np.dtype("<u2" if lib.get_vocab_size() <= 1 << 16 else "<u4")
        model = lib.model
        whole = lambda piece: lib.encode(piece.decode("utf-8"), add_special_tokens=False).ids
        # A run of a-z is one word to the vocabulary's own model, which saves the way there; tried on the alphabet first.
        word = lambda piece: [t.id for t in model.tokenize(piece.decode("ascii"))]
        plain = all(whole(w) == word(w) for w in (_ALPHABET[i:j] for i in range(26) for j in range(i + 1, 27)))
        ids = lambda piece: word(piece) if plain and piece.isalpha() and piece.isascii() and piece.islower() else whole(piece)
        self._cache = TwoAgeCache(lambda piece: np.array(ids(piece), width).tobytes(), CACHE_WORDS)
        self._end = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        data, edges = text_bytes(texts)
        odd = {k: self._whole(texts[k].as_py()) for k in texts_holding(data, edges, self._special)}
        folded = LOWER[data]
        starts, ends = word_pieces(folded, edges)
        codes, names = name_pieces(folded, starts, ends)
        ids, added = gather(list(map(self._cache.__getitem__, names)), codes, self._width)
        per_text = sums_between(added, np.searchsorted(starts, edges))
        stops = np.cumsum(per_text)
        return [np.concatenate([odd[k] if k in odd else ids[b - n : b], self._end]) for k, (b, n) in enumerate(zip(stops.tolist(), per_text.tolist(), strict=True))]


def range_bounds(df: DataFrame, id_col: str, parts: int) -> list[int]:
    """Ids that exist in ``df`` and cut it into about ``parts`` equal ranges, ascending.

    Reads the id column only; the driver gets ``parts`` numbers.
    """
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(F.col(id_col), shares, 10_000).alias("b")).first()["b"]
    return sorted(set(found or []))


def bucket_of(id_col: str, bounds: list[int]):
    """Number of bounds below the id; null ids come first, in bucket 0.

    Looked up in two steps of about the square root of their number.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda found: F.size(F.filter(found, lambda b: b < F.col(id_col)))
    whole = F.array(*[F.lit(int(b)) for b in bounds])
    passed = F.greatest(below(F.array(*[F.lit(int(b)) for b in bounds[::step]])) - 1, F.lit(0)) * step
    return F.coalesce(passed + below(F.slice(whole, passed + 1, F.lit(step))), F.lit(0))


def write_token_files(
    documents: DataFrame,
    path: str,
    vocabulary_file: str,
    vocabulary_size: int,
    end_id: int | None = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
) -> str:
    """Encode whole texts and write shards in ascending ``id_col`` order under ``path``.

    Rows with a null text hold the end id only; null ids come first; rows with
    equal ids are kept and ordered by their packed ids. An empty input writes no
    shards. Other columns are ignored.
    """
    spark = documents.sparkSession
    bits = bits_for(vocabulary_size)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(documents, id_col, parts)
    encoded = map_texts(
        documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")),
        "text",
        [T.StructField("ids", T.BinaryType())],
        lambda: _packed(vocabulary_file, end_id, bits),
        keep=["doc"],
        batch_chars=RUN_BYTES,
        arrow=True,
    )
    # One range of ids for each task: bucket numbers are partition numbers.
    dealt = encoded.withColumn("bucket", bucket_of("doc", bounds)).repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "doc", "ids")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, first, names, docs, held = None, 0, 0, [], [], 0

        def out():
            blob = build_shard(docs, first, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["bucket", "seq", "n_ids", "docs", "shard"],
            )

        for part in (p for batch in batches for p in row_runs(batch, 1)):
            for doc, data, bucket in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                n = int.from_bytes(data[:4], "little")
                if docs and (bucket != at or held + n > SHARD_IDS):
                    yield out()
                    seq, first = (seq + 1, first + held) if bucket == at else (0, 0)
                    names, docs, held = [], [], 0
                at = bucket
                names.append(doc)
                docs.append(unpack(memoryview(data)[4:], n, bits))
                held += n
        if docs:
            yield out()

    made = map_arrow(dealt, shards, "bucket int, seq int, n_ids long, docs array<long>, shard binary")
    made.write.option("maxRecordsPerFile", FILE_SHARDS).parquet(path)
    return path


def _packed(vocabulary_file: str, end_id: int | None, bits: int):
    encode = worker_state(("words", vocabulary_file, end_id), lambda: WordEncoder(vocabulary_file, end_id))
    return lambda texts: [[struct.pack("<I", len(d)) + pack(d, bits) for d in encode(texts)]]


def read_token_files(spark, path: str) -> DataFrame:
    """One row for each stored document: ``doc_id, start, n_tokens, ids`` (ids: little-endian u32 bytes).

    ``start`` counts the ids of all documents before it. The driver reads one sum
    for each range of ids that was written, not one for each document or shard.
    """
    files = spark.read.schema("bucket int, seq int, n_ids long, docs array<long>, shard binary").parquet(path)
    base, bases = 0, {}
    for row in sorted(files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()):
        bases[row["bucket"]] = base
        base += row["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in row_runs(batch, 2)):
            for bucket, docs, data in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(data)
                everything = shard.ids(0, shard.n_ids)
                zero = bases[bucket] + shard.first_id
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(shard.starts[:-1] + zero, pa.int64()),
                        pa.array(shard.lengths, pa.int64()),
                        pa.array([everything[a:b].tobytes() for a, b in zip(shard.starts, shard.starts[1:], strict=False)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return map_arrow(files.select("bucket", "docs", "shard"), read, "doc_id long, start long, n_tokens long, ids binary")


def token_file_query(spark, sf_dir: str) -> DataFrame:
    """op2: documents written as packed token files and described from what is read back."""
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"), 49_408)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian u32, as the query reports it."""
    return zlib.crc32(ids.astype("<u4").tobytes()) & 0xFFFFFFFF
