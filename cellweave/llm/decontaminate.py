"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised alike: A-Z lower-cased, words of digits, lower-case
letters and non-ASCII characters joined by single spaces. The automaton holds every
window of item words, so a text is scanned once whatever the number of items. A
match is mapped from normalised characters to word numbers, and from word numbers
to spans of the original text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import free_name, materialize, table, with_struct, worker_state

WINDOW = 10
#: Bytes of item text that one automaton holds. A larger benchmark is cut into parts
#: of about this size; each is read to the driver and scanned for in a pass of its own.
AUTOMATON_BYTES = 1_000_000

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Normalised words, as UTF-8."""
    return (text or "").encode("utf-8").translate(_FOLD).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code point spans of the words of the original text."""
    data = text.encode("utf-8")
    marks = np.frombuffer(data, np.uint8)
    at = np.concatenate([[0], np.cumsum((marks & 0xC0) != 0x80)])
    return [(int(at[m.start()]), int(at[m.end()])) for m in _WORD.finditer(data.translate(_LOWER))]


def item_windows(items: list[tuple], window: int) -> dict[bytes, list[int]]:
    """Window (words joined by a space) to the numbers of the items that hold it."""
    found: dict[bytes, set[int]] = {}
    for k, (_, text) in enumerate(items):
        words = normal_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" ".join(words[i : i + window]), set()).add(k)
    return {w: sorted(ks) for w, ks in found.items()}


class Scanner:
    """Finds item windows at word borders of normalised texts."""

    def __init__(self, windows: dict[bytes, list[int]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for w, ks in windows.items():
            # One character for each byte: a single UTF-8 scan, spaces mark word borders.
            self.auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, ks))
        if windows:
            self.auto.make_automaton()
        self.empty = not windows

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit word intervals (merged, end exclusive) and hit items."""
        words = normal_words(text)
        if self.empty or not words:
            return len(words), [], set()
        line = " " + b" ".join(words).decode("latin-1") + " "
        items: set[int] = set()
        spans: list[tuple[int, int]] = []
        seen, number = 0, 0
        for end, (n, ks) in self.auto.iter(line):
            # Ends never fall; the word number of an end is counted on from the last.
            number += line.count(" ", seen, end)
            seen = end
            items.update(ks)
            spans.append((number - n, number))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return len(words), merged, items


_PART = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("words", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def _described(text: str, n: int, words: list[tuple[int, int]], names: set[str | None]) -> tuple:
    """A row of _RESULT from hit word intervals and hit items."""
    hit = np.zeros(n + 1, bool)
    for a, b in words:
        hit[a:b] = True
    n_hit = int(hit.sum())
    out = []
    if n_hit:
        where = word_spans(text)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit])))
        out = [{"start": where[a][0], "end": where[b - 1][1]} for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return n, n_hit, len(names), sorted("null" if i is None else i for i in names), out, n_hit > 0


def _scanned(df: DataFrame, box: str, text_col: str, items: list[tuple], window: int, before: str | None, last: bool) -> DataFrame:
    """Add ``box``: what ``before`` knows and what one automaton of ``items`` finds, in its last form after the last pass."""
    ids = [i for i, _ in items]
    key = ("windows", window, hashlib.sha256(repr(items).encode()).hexdigest())

    def make():
        scanner = worker_state(key, lambda: Scanner(item_windows(items, window)))

        def one(text: str, known: dict | None) -> tuple:
            n, words, found = scanner.scan(text)
            names = {ids[k] for k in found}
            if known is not None:
                words = [*words, *((w["start"], w["end"]) for w in known["words"])]
                names.update(known["items"])
            return _described(text, n, words, names) if last else (n, [{"start": a, "end": b} for a, b in words], sorted(names, key=lambda i: (i is None, i)))

        return lambda texts, known: [list(c) for c in zip(*map(one, texts.to_pylist(), known.to_pylist()), strict=True)]

    earlier = F.col(f"`{before}`") if before else F.lit(None).cast(_PART)
    return with_struct(df, box, [F.coalesce(F.col(f"`{text_col}`"), F.lit("")), earlier], _RESULT if last else _PART, make)


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``n_words, n_hit, n_items, item_ids, hit_spans, contaminated`` to every row.

    ``hit_spans`` are code point spans of the original text. Null texts have no
    words; null or empty items have no windows; items with equal ids count once; those
    without an id count as one, named ``null``. An empty benchmark hits nothing.
    Columns of these names are replaced. The driver holds AUTOMATON_BYTES of the
    benchmark, or one item, at a time: of a larger one each part takes a pass over
    the texts, written to the shared folder before the next.
    """
    known = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).dropDuplicates()
    size = known.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    passes = max(1, -(-size // AUTOMATON_BYTES))
    kept = [c for c in (df.columns if keep is None else keep) if c not in _RESULT.names]
    out = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text_col])])
    before = None
    for k in range(passes):
        rows = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()
        items = sorted(((r["i"], r["t"]) for r in rows), key=lambda x: (x[0] is None, x[0] or "", x[1]))
        box, last = free_name("__found", out), k == passes - 1
        out = _scanned(out, box, text_col, items, window, before, last)
        if before:
            out = out.drop(before)
        if not last:
            out, before = materialize(out, "scanned"), box
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{box}.{c}").alias(c) for c in _RESULT.names])


def items_digest(ids: list[str]) -> str:
    """Digest that the query reports for a list of item ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    """op5: whole documents against the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
