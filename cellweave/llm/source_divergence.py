"""How far the words of sources of one language differ, by integer dictionaries of kept terms.

1. Tasks count terms by (language, source) in blocks: one row for each term and block,
   with the counts of its sources and the number of documents that hold it. A frequent
   term moves one row a block, however often it stands.
2. Rows are dealt by ranges of (language, term) in UTF-8 order. A task cuts each
   language's terms into chunks of kept terms (those of enough documents), sorted;
   the position of a term in its chunk, found by binary search, is its id, so ids
   keep the order of terms. Counts of a chunk by group and id are written as they are
   (sparse), with the sums of groups.
3. Sums of all chunks give each group's total and each language's number of kept terms.
4. Each chunk becomes dense: one vector of counts a group, by a weighted bincount over
   (group, id), and from that integer shares. Distances of pairs are summed over the chunks of a
   task before they leave it, and of each group's terms only a chunk's best leave, ties
   by id. Sources of a language are taken TILE at a time against all, so memory stays
   bounded by TILE x sources.

All arithmetic is on whole numbers; a share is found by long division in three steps
of a thousand, exact for totals up to 9e15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import discard, map_arrow, materialize, row_runs, table
from cellweave.llm.vector_text import LETTER, LOWER, name_pieces, text_bytes

#: Documents of a language that must hold a term; how many terms of each group are told.
LEAST_DOCUMENTS, TOP_TERMS = 30, 50
#: Shares are in parts of UNIT; PRIOR is added to every count.
UNIT, PRIOR = 1_000_000_000, 5
#: Entries (group, term) that a block holds before it is sent on.
BLOCK_ENTRIES = 1_000_000
#: Kept terms of a chunk, rows of step 2 that are taken at a time, and sources that meet all others at a time.
CHUNK, CHUNK_ROWS, TILE = 4096, 100_000, 256
#: Bytes of text that are cut into terms at a time.
TEXT_BYTES = 2_000_000

_TERM = LETTER.copy()
_TERM[0x80:] = True

_BLOCK = "lang string, term string, n_docs long, sources array<string>, counts array<long>"
_CHUNK = "lang string, terms array<string>, sources array<string>, sums array<long>, at binary, id binary, n binary"
_FOUND = "lang string, source string, part string, item string, value long"


def term_bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and non-ASCII characters of texts in one byte array."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _TERM[data]
    begin = solid[1:-1] & ~solid[:-2]
    end = solid[1:-1] & ~solid[2:]
    first = edges[:-1][np.diff(edges) > 0]
    begin[first] = solid[1:-1][first]
    last = edges[1:][np.diff(edges) > 0] - 1
    end[last] = solid[1:-1][last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class _Block:
    """Counts of terms by group of the texts seen since the last ``rows``."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.entries = 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        data, edges = text_bytes(texts)
        data = LOWER[data]
        starts, ends = term_bounds(data, edges)
        codes, names = name_pieces(data, starts, ends)
        own = np.fromiter((self.terms.setdefault(x, len(self.terms)) for x in names), np.int64, len(names))
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)), np.int64, len(langs))
        text = np.repeat(np.arange(len(langs)), np.diff(np.searchsorted(starts, edges)))
        # Pairs (text, term) with their counts, then (group, term).
        wide = max(1, len(names))
        pair, n = np.unique(text * wide + codes, return_counts=True)
        key, back = np.unique(group[pair // wide] * wide + pair % wide, return_inverse=True)
        self.held.append((key // wide, own[key % wide] if len(key) else key, np.bincount(back, n, len(key)).astype(np.int64), np.bincount(back, minlength=len(key))))
        self.entries += len(key)
        if self.entries > 2 * BLOCK_ENTRIES:
            self._fold()

    def _fold(self) -> None:
        group, term, n, docs = (np.concatenate([h[i] for h in self.held]) for i in range(4))
        order = np.lexsort((group, term))
        group, term = group[order], term[order]
        first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (term[1:] != term[:-1])])) if len(group) else order
        add = lambda x: np.add.reduceat(x[order], first) if len(first) else x
        self.held = [(group[first], term[first], add(n), add(docs))]
        self.entries = len(first)

    def full(self) -> bool:
        return self.entries > BLOCK_ENTRIES

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row for each language and term; the block is empty afterwards."""
        if self.held:
            self._fold()
            group, term, n, docs = self.held[0]
            names = list(self.groups)
            langs = {x: i for i, x in enumerate(dict.fromkeys(lang for lang, _ in names))}
            lang = np.array([langs[x] for x, _ in names], np.int64)[group] if len(group) else group
            order = np.lexsort((group, term, lang))
            group, term, n, docs, lang = (x[order] for x in (group, term, n, docs, lang))
            first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])])) if len(group) else group
            stops = np.append(first, len(group)).astype(np.int32)
            words, tongues = [x.decode() for x in self.terms], list(langs)
            named = pa.array([s for _, s in names], pa.string())
            for lo in range(0, len(first), 20_000):
                hi = min(lo + 20_000, len(first))
                a, b = stops[lo], stops[hi]
                at = pa.array(stops[lo : hi + 1] - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tongues[x] for x in lang[first[lo:hi]].tolist()], pa.string()),
                        pa.array([words[x] for x in term[first[lo:hi]].tolist()], pa.string()),
                        pa.array(np.add.reduceat(docs[a:b], first[lo:hi] - a), pa.int64()),
                        pa.ListArray.from_arrays(at, named.take(pa.array(group[a:b]))),
                        pa.ListArray.from_arrays(at, pa.array(n[a:b], pa.int64())),
                    ],
                    names=["lang", "term", "n_docs", "sources", "counts"],
                )
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: rows (lang, source, text)."""
    block = _Block()
    for part in (p for batch in batches for p in row_runs(batch, 2, most=TEXT_BYTES)):
        block.add(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2))
        if block.full():
            yield from block.rows()
    yield from block.rows()


def _same(column: pa.Array) -> np.ndarray:
    """For each row but the first, whether its value is that of the row before."""
    return pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _united(rows: pa.Table) -> pa.Table:
    """Rows of one term as one row."""
    names = rows.column("sources").combine_chunks().flatten().dictionary_encode()
    n = np.bincount(names.indices.to_numpy(), rows.column("counts").combine_chunks().flatten().to_numpy()).astype(np.int64)
    one = {"lang": rows.column("lang")[0], "term": rows.column("term")[0], "n_docs": pc.sum(rows.column("n_docs")), "sources": names.dictionary, "counts": pa.array(n)}
    return pa.table({k: pa.array([one[k].as_py() if k in ("lang", "term", "n_docs") else one[k].to_pylist()], rows.schema.field(k).type) for k in rows.schema.names})


def _chunks(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Step 2 for the sorted rows of whole terms."""
    lang, term = rows.column("lang").combine_chunks(), rows.column("term").combine_chunks()
    first = np.flatnonzero(np.concatenate([[True], ~(_same(lang) & _same(term))]))
    docs = np.add.reduceat(rows.column("n_docs").to_numpy(), first)
    enough = docs >= least
    # Most terms are rare: their lists are never looked at.
    held = rows.filter(pa.array(np.repeat(enough, np.diff(np.append(first, len(lang))))))
    if not held.num_rows:
        return
    tongue = held.column("lang").combine_chunks()
    turns = np.concatenate([[0], np.flatnonzero(~_same(tongue)) + 1, [len(tongue)]]).tolist()
    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    for lo, hi in zip(turns, turns[1:], strict=False):
        part = held.slice(lo, hi - lo)
        words = np.array(part.column("term").combine_chunks().cast(pa.binary()).to_pylist(), object)
        kept = np.unique(words)
        lists = part.column("sources").combine_chunks()
        names = lists.flatten().dictionary_encode()
        order = np.argsort(np.array([x.encode() for x in names.dictionary.to_pylist()], object))
        sources = names.dictionary.take(pa.array(order)).to_pylist()
        at = np.argsort(order)[names.indices.to_numpy()]
        ids = np.searchsorted(kept, words).repeat(lists.value_lengths().to_numpy())
        n = part.column("counts").combine_chunks().flatten().to_numpy()
        # Blocks are united: one entry for each id and group.
        key, back = np.unique(ids * len(sources) + at, return_inverse=True)
        n = np.bincount(back, n, len(key)).astype(np.int64)  # whole up to 2**53
        ids, at = key // len(sources), key % len(sources)
        for a in range(0, len(kept), CHUNK):
            b = min(a + CHUNK, len(kept))
            x, y = np.searchsorted(ids, [a, b])
            sums = np.bincount(at[x:y], n[x:y], len(sources)).astype(np.int64)
            row = [tongue[lo].as_py(), [w.decode() for w in kept[a:b]], sources, sums.tolist(), at[x:y].astype("<i4").tobytes(), (ids[x:y] - a).astype("<i4").tobytes(), n[x:y].astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["lang", "terms", "sources", "sums", "at", "id", "n"])


def _encode(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Step 2: rows sorted by language and term, taken so many at a time; the last term waits for its other rows."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < CHUNK_ROWS:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        lang, term = rows.column("lang").chunk(0), rows.column("term").chunk(0)
        breaks = np.flatnonzero(~(_same(lang) & _same(term)))
        cut = int(breaks[-1]) + 1 if len(breaks) else 0
        if cut:
            yield from _chunks(rows.slice(0, cut), least)
        rest = rows.slice(cut)
        held = [_united(rest) if rest.num_rows > 1 else rest]
        size = 1
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        if rows.num_rows:
            yield from _chunks(rows, least)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / total), exactly."""
    rest, found = counts + PRIOR, np.zeros_like(counts)
    scale = UNIT
    while scale > 1:
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest %= total
        scale //= 1000
    return found + 1


def _compare(batches: Iterator[pa.RecordBatch], top: int, many: int) -> Iterator[pa.RecordBatch]:
    """Step 4: rows (lang, terms, sources, at, id, n, all sources with totals, kept terms of the language, tile)."""
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    sums: dict[tuple[str, int], tuple[list[str], np.ndarray]] = {}
    for part in (p for batch in batches for p in row_runs(batch, 3, 4, 5, most=8_000_000)):
        for lang, terms, sources, at, ids, n, groups, volume, tile in zip(*(part.column(i).to_pylist() for i in range(9)), strict=True):
            width, named = len(terms), [g["source"] for g in groups]
            place = {s: i for i, s in enumerate(named)}
            where = np.array([place[s] for s in sources], np.int64)[np.frombuffer(at, "<i4")]
            counts = np.bincount(where * width + np.frombuffer(ids, "<i4"), np.frombuffer(n, "<i8"), len(named) * width)
            counts = counts.astype(np.int64).reshape(len(named), width)
            totals = np.array([g["n"] for g in groups], np.int64)
            p = shares(counts, (totals + PRIOR * volume)[:, None])
            q = shares(counts.sum(axis=0), totals.sum() + PRIOR * volume)
            lo, hi = tile * many, min((tile + 1) * many, len(named))
            held = sums.setdefault((lang, tile), (named, np.zeros((hi - lo, len(named)), np.int64)))[1]
            rows = []
            for i in range(lo, hi):
                held[i - lo] += np.abs(p - p[i]).sum(axis=1)
                more = np.where((counts[i] > 0) & (p[i] > q), p[i] - q, 0)
                # Largest first; equal ones in the order of ids, which is that of terms.
                best = np.argsort(-more, kind="stable")[:top]
                rows += [(lang, named[i], "term", terms[k], int(more[k])) for k in best.tolist() if more[k] > 0]
            if rows:
                yield pack(rows)
        if len(sums) * many > 4096:
            yield from _sums(sums, pack, many)
            sums = {}
    yield from _sums(sums, pack, many)


def _sums(sums: dict, pack, many: int) -> Iterator[pa.RecordBatch]:
    for (lang, tile), (named, held) in sums.items():
        for i, row in enumerate(held.tolist(), tile * many):
            yield pack([(lang, named[i], "pair", named[j], v) for j, v in enumerate(row)])


def source_divergence(df: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: distances of sources (part ``pair``) and telling terms (part ``term``).

    Null languages, sources and texts are read as empty strings; each row is a
    document. Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A
    language without kept terms has pairs of value 0, a source alone in its
    language has none. Ranks run from 1 by value, descending, ties by item in UTF-8 order.
    Other columns are ignored.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    blocks = materialize(map_arrow(docs, _count, _BLOCK), "blocks")
    ranged = blocks.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    chunks = materialize(map_arrow(ranged, lambda b: _encode(b, least), _CHUNK), "chunks")
    discard(blocks)

    totals = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    groups = materialize(docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    volumes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("volume"))
    # One row a language, which lists its sources: their pairs are the result, so they are no more than that.
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups")).join(volumes, "lang")
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.size("groups") - 1) / F.lit(TILE)).cast("int")))
    met = chunks.join(listed, "lang").select("lang", "terms", "sources", "at", "id", "n", "groups", "volume", tiles.alias("tile"))
    tile = TILE
    found = materialize(map_arrow(met, lambda b: _compare(b, top, tile), _FOUND), "found")

    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = lambda x: x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = ranked(found.where("part = 'term'").select("lang", "source", "item", "value")).where(F.col("rank") <= top)
    out = ranked(pairs).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over every whole text of documents."""
    return source_divergence(table(spark, sf_dir, "documents"))
