"""Spelling variants: words that differ by one code point, found by a rare-first q-gram prefix filter.

1. Runs of letters are counted in blocks of a task; a block sends one row a distinct
   word. The run to be altered is told by the crc32 of its document's id and itself, which for all
   runs of a batch is put together from one crc of each document and one of each
   distinct run (crc32 is linear), so no string is made for a run that stays.
2. The bigrams of the kept words are put in one global order, rare ones first: the
   alphabet has 90 letters, so there are 8,100 bigrams at most, whatever the text.
3. A word is posted under the three rarest of its bigrams. One edit touches two bigrams
   of a word at most, so two words one edit apart share a bigram among those three,
   at places that are equal (replaced) or differ by one at most (inserted, deleted). The
   edit also leaves one half of the shorter word as it is; the half is part of the join key,
   which keeps the groups small even for bigrams that many words share. Pairs are
   verified inside the join, so only true neighbours come out.
4. Each word's form is its neighbour with the largest count, if that is large enough; roots
   are found by doubling along forms, whose counts grow fivefold a step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import discard, map_arrow, materialize, row_runs, table
from cellweave.llm.vector_text import LETTER, LOWER, name_pieces, text_bytes

#: Code points of a word at least, and its occurrences.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form stands at least so many times as often.
FORM_RATIO = 5
#: A run loses a code point if its hash is divisible by this.
ALTERED = 199
#: Distinct words that a block holds.
BLOCK_ENTRIES = 500_000
#: Bigrams under which a word is posted: one more than one edit can touch.
PREFIX = 3
#: Letters: a-z and the 64 code points from U+00C0.
LETTERS = 26 + 64


def run_bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of A-Z, a-z and U+00C0 to U+00FF (UTF-8: C3 and one byte) of texts in one byte array."""
    lead = data == 0xC3
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTER[data] | lead
    inside[2:-1] |= lead[:-1]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    some = np.diff(edges) > 0
    begin[edges[:-1][some]] = inside[1:-1][edges[:-1][some]]
    end[edges[1:][some] - 1] = inside[1:-1][edges[1:][some] - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def moved(crc: int, zeros: bytes) -> int:
    """What a crc32 contributes to that of a string which goes on for as many bytes as ``zeros`` has."""
    return zlib.crc32(zeros, crc) ^ zlib.crc32(zeros)


def altered_runs(ids: list[int | None], text: np.ndarray, length: np.ndarray, codes: np.ndarray, crcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs that lose a code point, and their hashes.

    For each run: its text's number, its bytes and its code; ``crcs``: crc32 of each distinct run.
    """
    if not len(text):
        return text, np.zeros(0, np.uint32)
    widths, width = np.unique(length, return_inverse=True)
    pair, back = np.unique(text * len(widths) + width, return_inverse=True)
    zeros = [bytes(n) for n in widths.tolist()]
    prefix = [None if i is None else zlib.crc32(b"%d:" % i) for i in ids]
    part = np.array([0 if prefix[t] is None else moved(prefix[t], zeros[w]) for t, w in zip((pair // len(widths)).tolist(), (pair % len(widths)).tolist(), strict=True)], np.uint32)
    h = part[back] ^ crcs[codes]
    named = np.array([i is not None for i in ids])
    hit = np.flatnonzero((h % np.uint32(ALTERED) == 0) & named[text])
    return hit, h[hit]


def _count(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """Step 1: rows (id, text); one row for each word of a block."""
    counts: dict[bytes, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for lo in range(0, len(words), 50_000):
            some = words[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in some], pa.string()), pa.array([counts[w] for w in some], pa.int64())], names=["word", "n"])

    for part in (p for batch in batches for p in row_runs(batch, 1)):
        data, edges = text_bytes(part.column(1))
        data = LOWER[data]
        starts, ends = run_bounds(data, edges)
        pairs = np.concatenate([[0], np.cumsum(data == 0xC3)])  # letters of two bytes
        long_enough = (ends - starts) - (pairs[ends] - pairs[starts]) >= shortest
        starts, ends = starts[long_enough], ends[long_enough]
        codes, names = name_pieces(data, starts, ends)
        n = np.bincount(codes, minlength=len(names))
        text = np.searchsorted(edges, starts, side="right") - 1
        crcs = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
        hit, h = altered_runs(part.column(0).to_pylist(), text, ends - starts, codes, crcs)
        for code, hashed in zip(codes[hit].tolist(), h.tolist(), strict=True):
            letters = names[code].decode()
            at = hashed % len(letters)
            n[code] -= 1
            if len(letters) > shortest:
                word = (letters[:at] + letters[at + 1 :]).encode()
                counts[word] = counts.get(word, 0) + 1
        for word, many in zip(names, n.tolist(), strict=True):
            if many:
                counts[word] = counts.get(word, 0) + many
        if len(counts) > BLOCK_ENTRIES:
            yield from out()
            counts.clear()
    yield from out()


def _letters(word: Column, length: Column) -> Column:
    """Numbers of a word's letters, from 0."""
    code = lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 192 + 26)
    return F.transform(F.slice(F.split(word, ""), F.lit(1), length), code)


def _bigrams(letters: Column, length: Column) -> Column:
    """Numbers of the bigrams, in the order of their places."""
    return F.zip_with(F.slice(letters, F.lit(1), length - 1), F.slice(letters, F.lit(2), length - 1), lambda a, b: a * LETTERS + b)


def _posted(words: DataFrame) -> DataFrame:
    """``word, n, size, rank, at``: one row for each of a word's rarest bigrams, whose global rank comes first."""
    grams = words.select("word", "n", F.char_length("word").alias("size")).withColumn("grams", _bigrams(_letters(F.col("word"), F.col("size")), F.col("size")))
    seen = grams.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    ranks = np.zeros(LETTERS * LETTERS, np.int32)
    for i, (g, _) in enumerate(sorted(((r["g"], r["n"]) for r in seen), key=lambda x: (x[1], x[0]))):
        ranks[g] = i
    rank = F.lit(ranks)
    placed = F.transform("grams", lambda g, i: F.struct(F.element_at(rank, g + 1).alias("rank"), i.alias("at")))
    return grams.select("word", "n", "size", F.explode(F.slice(F.array_sort(placed), 1, PREFIX)).alias("x")).select("word", "n", "size", "x.rank", "x.at")


def _keyed(posted: DataFrame, role: int, shorter: Column, *place: str) -> DataFrame:
    """Rows with the join key: role, bigram, place where told, length of the shorter word, and either half of that length."""
    front = F.floor(shorter / 2).cast("int")
    halves = F.array(
        F.xxhash64(F.lit(role), "rank", *place, shorter, F.lit(0), F.substring("word", F.lit(1), front)),
        F.xxhash64(F.lit(role), "rank", *place, shorter, F.lit(1), F.substring("word", F.col("size") - (shorter - front) + 1, shorter - front)),
    )
    return posted.select(F.explode(halves).alias("key"), "word", "n", "at")


def neighbours(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words (with counts) that one insertion, deletion or replacement parts, once."""
    posted = materialize(_posted(words), "posted")
    side = lambda df, x: df.select("key", F.col("word").alias(x), F.col("n").alias(f"{x}_n"), F.col("at").alias(f"{x}_at"))
    near = F.levenshtein("a", "b", 1) == 1
    same = _keyed(posted, 0, F.col("size"), "at")
    replaced = side(same, "a").join(side(same, "b"), "key").where("a < b").where(near)
    shorter, longer = _keyed(posted, 1, F.col("size")), _keyed(posted, 1, F.col("size") - 1)
    inserted = side(shorter, "a").join(side(longer, "b"), "key").where("b_at - a_at between 0 and 1").where(near)
    return replaced.unionByName(inserted).select("a", "a_n", "b", "b_n").distinct()


def word_counts(df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words with enough code points and occurrences, altered runs counted as what is left of them."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return map_arrow(docs, lambda b: _count(b, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: the last of the forms. Doubles its steps each round; every round is a written table."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = step
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row a word.

    Runs are of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; null texts have none, and
    the runs of rows with a null id all stay as they are. Rows of equal ids count each
    for itself. A word's form is its neighbour with the largest count (ties: the first
    in code-point order) if it stands ``ratio`` times as often; form and form_n are null
    without one, root is then the word. Other columns are ignored. ``least_length`` is 4 or more.
    """
    if least_length < PREFIX + 1:
        raise ValueError(f"words need {PREFIX} bigrams: least_length is {PREFIX + 1} or more")
    words = materialize(word_counts(df, least_length, least_count, id_col, text_col), "words")
    pairs = neighbours(words)
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")).alias("x"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("form")).alias("x")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("x").alias("x"))
    enough = -F.col("x.less") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", F.when(enough, F.col("x.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("x.less")).alias("form_n")
    )
    found = materialize(found, "found")
    roots = roots_of(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over every whole text of documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))
