"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pretoken stand in a doubly linked list; a heap holds its adjacent
pairs by merge rank, then position. The lowest pair is popped and merged again and
again; a popped pair whose symbols have changed since is skipped. The count is the
number of initial symbols less the number of merges, so no id is ever looked up.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.byte_level import Pretokenizer
from cellweave.llm.common import PIECES, TwoAgeCache, map_texts, table, vocabulary_path, worker_state
from cellweave.llm.vector_text import MARK, SPACE, letter_ends, name_pieces, sums_between, text_bytes, texts_holding

CACHE_PIECES = 200_000
#: Bytes of text that are cut into pieces at a time.
RUN_BYTES = 2_000_000


class MergeCounter:
    """Counts tokens of single pretokens under a merge list."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}

    def count(self, pretoken: str) -> int:
        """Initial symbols (characters of the byte alphabet) less merges."""
        ranks = self.ranks
        symbols: list = list(pretoken)
        n = len(symbols)
        if n < 2:
            return n
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heappop(heap)
            if symbols[i] != a:
                continue
            j = right[i]
            if j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, None
            merges += 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                r = ranks.get((symbols[i], symbols[k]))
                if r is not None:
                    heappush(heap, (r, i, symbols[i], symbols[k]))
            h = left[i]
            if h >= 0:
                r = ranks.get((symbols[h], symbols[i]))
                if r is not None:
                    heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges


def merge_list(spec: dict) -> list[tuple[str, str]]:
    """Merges of a parsed tokenizer file, lowest rank first."""
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]


def count_pieces(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of pieces of UTF-8 texts whose tokens do not depend on each other; a piece ends where the next begins.

    Cuts stand before ASCII white space that follows a visible ASCII character or a
    letter, and before an ASCII mark that follows a letter.
    """
    begin = np.zeros(len(data), bool)
    if len(data):
        letter, space, mark = letter_ends(data), SPACE[data], MARK[data]
        begin[1:] = (letter[:-1] | mark[:-1]) & space[1:] | letter[:-1] & mark[1:]
        begin[edges[:-1][edges[:-1] < len(data)]] = True
    return np.flatnonzero(begin)


class PieceCounter:
    """Map from a piece of text, as UTF-8, to its number of tokens."""

    def __init__(self, path: str):
        cut = Pretokenizer(path)
        self.special = [t.encode("utf-8") for t in cut.special]
        words = TwoAgeCache(MergeCounter(merge_list(cut.spec)).count, CACHE_PIECES)
        cut.spec = None
        count = words.__getitem__
        self.cache = TwoAgeCache(lambda piece: sum(1 if p in cut.special else count(p) for p in cut(piece.decode("utf-8"))), CACHE_PIECES)


def count_batch(counter: PieceCounter, texts: pa.Array) -> np.ndarray:
    """Number of tokens of each text."""
    cache = counter.cache
    data, edges = text_bytes(texts)
    starts = count_pieces(data, edges)
    codes, names = name_pieces(data, starts, np.append(starts[1:], len(data)))
    each = np.array([cache[p] for p in names], np.int64)
    counts = sums_between(each[codes], np.searchsorted(starts, edges))
    for k in texts_holding(data, edges, counter.special):  # a special string holds cut points
        counts[k] = sum(cache[p.encode()] for p in PIECES.findall(texts[k].as_py()))
    return counts


def token_counts(df: DataFrame, vocabulary_file: str, limit: int, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes, n_tokens, over_limit`` to every row.

    Null and empty texts have no bytes and no tokens. Rows are never merged or
    dropped, whatever repeats; columns of these names are replaced.
    """

    def make():
        counter = worker_state(("counts", vocabulary_file), lambda: PieceCounter(vocabulary_file))

        def run(texts: pa.Array):
            counts = count_batch(counter, texts)
            return [pc.binary_length(texts), counts, counts > limit]

        return run

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_texts(df, text_col, fields, make, keep, RUN_BYTES, arrow=True)


def token_count_query(spark, sf_dir: str) -> DataFrame:
    """op4 over every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    return token_counts(docs, vocabulary_path("byte_bpe_50k.json"), 512, keep=["doc_id"])
