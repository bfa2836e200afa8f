"""Shared pieces of the text operators: table access, batch mapping and text cutting."""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.runtime import discard, materialize, shared_dir, ship_package  # noqa: F401

TEXT = "__text"

#: Unicode White_Space, the class that ``\s`` names in the tokenizers' patterns.
WHITE = r"\t-\r \x85\xa0  -     　"

#: A white-space run with the non-space run after it. A cut between a non-space and
#: a white-space character never changes what the tokenizers' patterns match.
PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WORDS = re.compile(f"[^{WHITE}]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a function gets at a time: its working arrays take tens of bytes for each byte.
RUN_BYTES = 1_000_000


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str]], list[list]]],
    keep: Iterable[str] | None = None,
    batch_chars: int = RUN_BYTES,
    arrow: bool = False,
) -> DataFrame:
    """Add columns computed from whole texts, one row out for each row in.

    ``make()`` runs once in a task and returns a function from a list of texts (with
    ``arrow`` a string array) to one list for each field. Null texts arrive as
    ``""``. ``keep`` names the input columns that stay (all by default); an input
    column whose name equals a new field's is replaced by it. Texts reach the
    function in runs of at most ``batch_chars`` bytes or one document, whichever is
    more. Where the text stays, only texts go to the workers and only new columns come
    back; else the text goes and does not return.
    """
    new = [f.name for f in fields]
    names = [c for c in (df.columns if keep is None else keep) if c not in new]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    if text_col in names:
        box = free_name("__made", df)
        got = with_struct(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text_col])]), box, [text], T.StructType(fields), lambda: _of_lists(make(), arrow), batch_chars)
        return got.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"{box}.`{c}`") for c in new])

    src = df.select(*[F.col(f"`{c}`") for c in names], text.alias(TEXT))
    schema = T.StructType([src.schema[c] for c in names] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        work = _of_lists(make(), arrow)
        for part in (p for batch in batches for p in row_runs(batch, len(names), most=batch_chars)):
            made = [pa.array(v, type=t) for v, t in zip(work(part.column(len(names))), list(target.types)[len(names) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *made], names=target.names)

    return map_arrow(src, run, schema)


def _of_lists(work: Callable, arrow: bool) -> Callable:
    return work if arrow else lambda texts: work(texts.to_pylist())


def free_name(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def with_struct(df: DataFrame, box: str, columns: list, result: T.StructType, make: Callable[[], Callable[..., list]], most: int = RUN_BYTES) -> DataFrame:
    """Add ``box``, a struct of ``result`` computed in Python from ``columns``, the first of them text without nulls.

    ``make()`` runs once in a task and returns a function from slices of the columns
    (Arrow arrays) to one list or array for each field. Other columns do not leave the
    JVM, so no name of theirs meets one of an operator.
    """

    def of_run(work, types, arrays):
        for lo, hi in text_runs(pc.binary_length(arrays[0]).to_pylist(), most):
            made = work(*(a.slice(lo, hi - lo) for a in arrays))
            yield pa.StructArray.from_arrays([pa.array(v, type=t) for v, t in zip(made, types, strict=True)], names=result.names)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = list(to_arrow_schema(result).types)
        work = make()
        for arrays in batches:
            parts = list(of_run(work, types, arrays if isinstance(arrays, tuple) else (arrays,)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(result.names, types, strict=True))))
        release_memory()

    run.__annotations__ = {"batches": Iterator[pa.Array] if len(columns) == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    # Not deterministic for the planner, so that no filter on the struct makes it run twice.
    return df.withColumn(box, F.arrow_udf(run, result).asNondeterministic()(*columns))


_LIBC: list = []


def release_memory() -> None:
    """Give what a finished task has freed back to the system, as workers live on."""
    if not _LIBC:
        try:
            _LIBC.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library: nothing to ask for
            _LIBC.append(lambda _: 0)
    pa.default_memory_pool().release_unused()
    _LIBC[0](0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose tasks leave no freed memory behind in their workers."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return df.mapInArrow(wrapped, schema)


def row_runs(batch: pa.RecordBatch, *columns: int, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which the values of some text or binary columns stay within ``most`` bytes, one row at least."""
    sizes = [sum(row) for row in zip(*(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_pylist() for c in columns), strict=True)]
    for lo, hi in text_runs(sizes, most):
        yield batch.slice(lo, hi - lo)


#: Bits of a filter of keys: 16 for each, never more than 8 MiB in all.
FILTER_MOST = 1 << 26


class KeyFilter:
    """Bounded filter of 64-bit keys: never misses one, and lets some others through."""

    def __init__(self, bits: int, marks: bytes):
        self.bits, self.marks = bits, marks

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        h = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return np.stack([(h >> np.uint64(8)) % np.uint64(bits), (h >> np.uint64(29)) % np.uint64(bits)])

    @classmethod
    def of(cls, df: DataFrame, key: str) -> KeyFilter:
        """Filter of a column's values; the driver gets a few bitmaps, whatever their number."""
        keys = df.select(F.col(key).cast("long").alias("k"))
        bits = min(FILTER_MOST, max(1 << 16, 16 * keys.count()))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = np.zeros(bits, bool)
            for batch in batches:
                marks[cls.places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits).ravel()] = True
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["m"])

        found = keys.coalesce(4).mapInArrow(mark, "m binary").collect()
        return cls(bits, np.bitwise_or.reduce([np.frombuffer(r["m"], np.uint8) for r in found] + [np.zeros(bits // 8, np.uint8)]).tobytes())

    def has(self, key: int) -> bool:
        """Whether the filter lets one key through."""
        h = (key & 0xFFFFFFFFFFFFFFFF) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return all(self.marks[at >> 3] >> (7 - (at & 7)) & 1 for at in ((h >> 8) % self.bits, (h >> 29) % self.bits))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Which keys the filter lets through."""
        at = self.places(keys, self.bits)
        marks = np.frombuffer(self.marks, np.uint8)
        return ((marks[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=0)


def may_hold(df: DataFrame, column: str, keys: KeyFilter, box: str) -> DataFrame:
    """Add ``box``: whether the filter lets the value of a whole-number column through; nulls never. Only that column leaves the JVM."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pc.and_(pa.array(keys(values.fill_null(0).to_numpy(zero_copy_only=False)).astype(bool)), values.is_valid())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(box, F.arrow_udf(run, T.BooleanType()).asNondeterministic()(F.col(f"`{column}`").cast("long")))


def text_runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to at most ``most``, or of one text."""
    lo, size = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)


class TwoAgeCache(dict):
    """Bounded map. When the young half is full it becomes the old half; a hit in the
    old half moves the entry back. Recent keys survive without any book-keeping on hits."""

    def __init__(self, fill: Callable[[object], object], most: int):
        super().__init__()
        self.fill, self.most, self.old = fill, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fill(key)
        if len(self) >= self.most:
            self.old = None  # freed before the copy
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_KEPT: dict[object, object] = {}


def worker_state(key, build: Callable[[], object]):
    """What ``build()`` makes, kept in this worker until another operator asks for its own.

    One at a time, so that workers which serve one stage after another do not gather
    the tables of all of them.
    """
    if key not in _KEPT:
        _KEPT.clear()
        release_memory()
        _KEPT[key] = build()
    return _KEPT[key]


def tokenizer(path: str):
    """A new reader of ``path`` by the tokenizers library, without threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def special_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file that the library takes out of a text as they stand.

    Files whose added tokens eat neighbouring space, stand at word borders only or are
    matched after normalisation are refused: the operators cut texts around plain strings.
    """
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", [])
    for t in found:
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
            raise ValueError(f"added token {t['content']!r} is not a plain string")
        if any(c.isspace() for c in t["content"]):
            raise ValueError(f"added token {t['content']!r} holds white space")
    return {t["content"]: t["id"] for t in found}


def vocabulary_path(name: str) -> str:
    """Where the installed public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)
