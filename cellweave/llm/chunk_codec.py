"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its bytes hits a mask, so copies of a passage
are cut alike wherever they stand. Of each chunk the stretch between its first and
last sync point (white space after a visible ASCII character) is encoded once in a
worker, for whatever documents hold it. At a join of two chunks the stretch from the
last sync point of one to the first of the next is encoded anew together with a piece
of either chunk. The new ids must agree with those pieces' own ids; where they do not,
the stretch is widened into both chunks, at last to the whole text. So the result
equals the library's ids for the whole text, whatever the sync points are worth.

Chunks that no document shares a worker with are encoded by each worker that meets them:
a table of shared chunks for the whole corpus would have to bring the ids of each text
(about as many bytes as the text) together through a shuffle, which costs more than
encoding the chunk again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.byte_level import Pretokenizer, byte_alphabet
from cellweave.llm.common import TwoAgeCache, map_texts, table, tokenizer, vocabulary_path, worker_state
from cellweave.llm.token_counts import count_pieces
from cellweave.llm.vector_text import gather, name_pieces, sums_between, text_bytes, texts_holding

#: Bytes under the rolling hash; mean bytes between cuts is 2 ** CUT_BITS.
ROLL = 32
CUT_BITS = 10
#: Chunks, joins and pieces that a worker remembers in each half of its caches.
CACHE_CHUNKS = 8_000
CACHE_JOINS = 8_000
CACHE_PIECES = 100_000

_GEAR = np.random.default_rng(20_240_501).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A, 0x09, 0x0D]] = True
#: ASCII characters that are surely no white space and end no multi-byte one.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions where the hash of the ROLL bytes before them hits the mask.

    The hash is the sum of the bytes' gear values, each doubled once for each byte
    after it, so bytes further back than 32 have left a 32-bit hash.
    """
    if len(data) <= ROLL:
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    step = 1
    while step < ROLL:
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunked(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of UTF-8 texts: borders, whether a stretch is a join, and all sync points.

    ``edges`` part the texts and are among the borders. A join is the stretch around a
    cut between the sync points, or ends of the text, on its two sides.
    """
    sync = np.flatnonzero(_SPACE[data[1:]] & _SOLID[data[:-1]]) + 1
    cuts = cut_points(data)
    text = np.searchsorted(edges, cuts, side="right") - 1
    # What lies before a text must not move its cuts.
    inside = (cuts - edges[text] >= ROLL) & (cuts < edges[np.minimum(text + 1, len(edges) - 1)]) if len(cuts) else np.zeros(0, bool)
    cuts, text = cuts[inside], text[inside]
    after = np.searchsorted(sync, cuts)
    ends = np.concatenate([[-1], sync, [len(data) + 1]])
    low, high = np.maximum(edges[text], ends[after]), np.minimum(edges[text + 1], ends[after + 1])
    borders = np.unique(np.concatenate([edges, low, high]))
    joins = np.zeros(max(0, len(borders) - 1), bool)
    joins[np.searchsorted(borders, cuts, side="left") - 1] = True
    return borders, joins, sync


class ChunkCodec:
    """Encoder and decoder for a byte-level vocabulary file."""

    def __init__(self, path: str):
        model = tokenizer(path).model
        cut_words = Pretokenizer(path)
        self._special = [t.encode("utf-8") for t in cut_words.special]
        special = {t: np.array([i], "<u4").tobytes() for t, i in cut_words.special.items()}
        word = TwoAgeCache(lambda w: np.array([t.id for t in model.tokenize(w)], "<u4").tobytes(), CACHE_PIECES).__getitem__
        #: Ids of a string as the library gives them, from its pretokens.
        self._plain = lambda data: b"".join([special[w] if w in special else word(w) for w in cut_words(data.decode("utf-8"))])
        self._pieces = TwoAgeCache(self._plain, CACHE_PIECES)
        self._chunks: TwoAgeCache = TwoAgeCache(lambda _: None, CACHE_CHUNKS)
        self._joins: TwoAgeCache = TwoAgeCache(lambda _: None, CACHE_JOINS)
        #: Bytes that came from remembered chunks, of all bytes; joins, and joins that had to be widened.
        self.reused, self.seen, self.joined, self.widened = 0, 0, 0, 0
        spec = cut_words.spec
        back = {c: b for b, c in byte_alphabet().items()}
        vocabulary = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        table_ = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            table_[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode("utf-8")
        self._bytes = table_
        cut_words.spec = None

    def _stretches(self, data: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """Ids of stretches of text between edges, each distinct piece encoded once."""
        starts = count_pieces(data, edges)
        codes, names = name_pieces(data, starts, np.append(starts[1:], len(data)))
        ids, added = gather(list(map(self._pieces.__getitem__, names)), codes, np.dtype("<u4"))
        stops = np.concatenate([[0], np.cumsum(sums_between(added, np.searchsorted(starts, edges)))])
        return [ids[a:b].tobytes() for a, b in zip(stops.tolist(), stops[1:].tolist(), strict=False)]

    def _around(self, left: bytes, middle: bytes, right: bytes) -> tuple[bytes, bytes, bytes] | None:
        """Ids of ``middle`` between two stretches, with those of the stretches; None if encoding all as one disagrees with them."""
        key = (left, middle, right)
        found = self._joins[key]
        if found is None:
            whole, head, tail = self._plain(left + middle + right), self._pieces[left], self._pieces[right]
            agrees = len(whole) >= len(head) + len(tail) and whole.startswith(head) and whole.endswith(tail)
            found = (head, whole[len(head) : len(whole) - len(tail)], tail) if agrees else ()
            dict.__setitem__(self._joins, key, found)
        return found or None

    def _repaired(self, whole: bytes, low: int, high: int, text: tuple[int, int], sync: np.ndarray, left: bytes | None, right: bytes | None) -> bytes | None:
        """Ids of the join ``low`` to ``high`` of a text; None if only the whole text gives them.

        Encoded together with one, two, four ... pieces on either side, until the ids of
        these agree with their own and with the ends of the chunks ``left`` and ``right``
        (None: no chunk there, but another join).
        """
        before, after = int(np.searchsorted(sync, low)), int(np.searchsorted(sync, high, side="right"))
        reach = 1
        while True:
            a = max(text[0], int(sync[before - reach])) if before >= reach else text[0]
            b = min(text[1], int(sync[after + reach - 1])) if after + reach <= len(sync) else text[1]
            found = self._around(whole[a:low], whole[low:high], whole[high:b])
            if found and all(c is None or len(c) < len(own) or test(own) for c, own, test in ((left, found[0], left and left.endswith), (right, found[2], right and right.startswith))):
                return found[1]
            if (a, b) == text:
                return None
            self.widened += 1
            reach *= 2

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Little-endian u32 ids of each whole text."""
        data, edges = text_bytes(texts)
        whole = data.tobytes()
        borders, joins, sync = chunked(data, edges)
        spans = list(zip(borders.tolist(), borders[1:].tolist(), strict=False))
        parts: list[bytes | None] = [None] * len(spans)
        chunks = self._chunks
        missing: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(~joins).tolist():
            a, b = spans[k]
            found = chunks[whole[a:b]]
            if found is None:
                missing.setdefault(whole[a:b], []).append(k)
            else:
                parts[k] = found
                self.reused += b - a
        self.seen += len(whole)
        if missing:
            new = np.concatenate([[0], np.cumsum([len(m) for m in missing])])
            for (body, where), ids in zip(missing.items(), self._stretches(np.frombuffer(b"".join(missing), np.uint8), new), strict=True):
                dict.__setitem__(chunks, body, ids)
                self.reused += len(body) * (len(where) - 1)
                for k in where:
                    parts[k] = ids
        places = np.searchsorted(edges, borders[:-1], side="right") - 1
        broken = set(texts_holding(data, edges, self._special))
        for k in np.flatnonzero(joins).tolist():
            t = int(places[k])
            if t in broken:
                continue
            ends = (int(edges[t]), int(edges[t + 1]))
            left = parts[k - 1] if spans[k][0] > ends[0] and not joins[k - 1] else None
            right = parts[k + 1] if spans[k][1] < ends[1] and not joins[k + 1] else None
            self.joined += 1
            parts[k] = self._repaired(whole, *spans[k], ends, sync, left, right)
            if parts[k] is None:
                broken.add(t)
        first = np.searchsorted(borders, edges).tolist()
        return [
            self._plain(whole[a:b]) if t in broken else b"".join(parts[i:j])
            for t, (a, b, i, j) in enumerate(zip(edges.tolist(), edges[1:].tolist(), first, first[1:], strict=False))
        ]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian u32 ids; broken UTF-8 becomes U+FFFD, special strings stay."""
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> ChunkCodec:
    """The codec of a vocabulary file, once in a worker."""
    return worker_state(("codec", path), lambda: ChunkCodec(path))


def encode_texts(df: DataFrame, vocabulary_file: str, text_col: str = "text", keep: list[str] | None = None, ids_col: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int) to every row. Null and empty texts have no ids; repeated rows stay; columns of that name are replaced."""

    def make():
        own = codec(vocabulary_file)
        return lambda texts: [[np.frombuffer(i, "<i4") for i in own.encode_all(texts)]]

    return map_texts(df, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make, keep, arrow=True)


def round_trip(df: DataFrame, vocabulary_file: str, text_col: str = "text", keep: list[str] | None = None, ids_col: str | None = None, decoded_col: str | None = None) -> DataFrame:
    """Encode, then decode the ids. Adds ``n_tokens, ids_sha256, decoded_sha256`` to every row,
    and the ids and the decoded text under ``ids_col`` and ``decoded_col`` if named.

    Null texts count as empty, repeated rows stay, columns of these names are replaced.
    """

    def make():
        own = codec(vocabulary_file)

        def run(texts: pa.Array):
            ids = own.encode_all(texts)
            decoded = [own.decode(i) for i in ids]
            out = [
                [len(i) // 4 for i in ids],
                [hashlib.sha256(i).hexdigest() for i in ids],
                [hashlib.sha256(d.encode("utf-8")).hexdigest() for d in decoded],
            ]
            if ids_col:
                out.append([np.frombuffer(i, "<i4") for i in ids])
            return out + ([decoded] if decoded_col else [])

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids_col:
        fields.append(T.StructField(ids_col, T.ArrayType(T.IntegerType())))
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.StringType()))
    return map_texts(df, text_col, fields, make, keep, arrow=True)


def codec_query(spark, sf_dir: str) -> DataFrame:
    """op6 over every whole text of documents; rows of null texts and repeated ids stay."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    return round_trip(docs, vocabulary_path("byte_bpe_50k.json"), keep=["doc_id"])
