"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

1. Each document gets a key of its full shingle set, a MinHash signature kept to the
   low BITS bits of each minimum and packed into bit planes, and one hash for each
   band of full minima. Documents of equal sets become one representative.
2. Band buckets yield candidates. Each task first clusters its own members of a bucket
   around leaders, with similarities estimated from packed signatures by bit counts
   and corrected for chance agreement of low bits; only leaders travel, with the
   radius of their cluster. Leaders of a bucket are then linked unless their distance
   exceeds the threshold distance by more than both radii and a margin, so no pair
   over the threshold is parted by an estimate.
3. Members of a candidate component meet with their texts in chunks of bounded size,
   a few probes of the component in each chunk, and links are confirmed on full sets: a
   breadth-first search that drops what it has reached and looks only at sets that share
   one of their rarest shingles (which any pair over the threshold must), so a group of
   thousands costs few comparisons and no pairs are listed. What does not hang together
   with the largest part of a component of several chunks then meets all its members.
4. Confirmed links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import KeyFilter, discard, map_arrow, materialize, may_hold, row_runs, table
from cellweave.llm.substring_dedup import window_hashes, word_bounds, word_hashes
from cellweave.llm.vector_text import LOWER, text_bytes

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS, BITS = 32, 4, 2
MINIMA = BANDS * ROWS
#: Estimated similarity from which a member joins a leader's cluster.
JOIN = 0.5
#: Estimates err by 0.046 (one standard error at the threshold); three add up when leaders
#: are compared (their distance and two radii), by 0.08. The margin is five of those.
MARGIN = 0.4
#: Leaders of one bucket that are compared one by one; more are all linked (and confirmed or parted later).
COMPARED = 256
#: Representatives that a task clusters at a time.
BLOCK = 20_000
#: Members that are confirmed together and their shingles; probes of a component of several chunks.
CHUNK, CHUNK_SHINGLES = 256, 1_000_000
PROBES = 16
#: The same for the members outside a component's largest part, and for those they meet.
RESIDUE, RESIDUE_SHINGLES = 4096, 2_000_000

_RANDOM = np.random.default_rng(90_210)
_A = _RANDOM.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**64, MINIMA, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of each text's shingles.

    A-Z are lower-cased. Texts of fewer than SHINGLE words have their whole sequence
    as one shingle; texts without words have none.
    """
    data, edges = text_bytes(texts)
    data = LOWER[data]
    starts, ends = word_bounds(data, edges)
    per = np.diff(np.searchsorted(starts, edges))
    words, _ = word_hashes(data, starts, ends)
    h, text, _ = window_hashes(words, per, SHINGLE)
    cut = np.searchsorted(text, np.arange(len(per) + 1))
    first = np.cumsum(per) - per
    out = []
    for k, n in enumerate(per.tolist()):
        if 0 < n < SHINGLE:
            own = words[first[k] : first[k] + n]
            out.append(np.array([xxhash.xxh3_64_intdigest(own.tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.unique(h[cut[k] : cut[k + 1]]))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the MINIMA hash functions over a set."""
    least = np.full(MINIMA, 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[i : i + 2048, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32)


def packed(least: np.ndarray) -> bytes:
    """Low BITS bits of each minimum as bit planes."""
    return b"".join(np.packbits(((least >> np.uint32(b)) & np.uint32(1)).astype(np.uint8)).tobytes() for b in range(BITS))


def band_hashes(least: np.ndarray) -> bytes:
    """One 64-bit hash for each band, the band's number included."""
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(rows[b].tobytes(), seed=b) for b in range(BANDS)], "<u8").tobytes()


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures, corrected for chance agreement (uint64 rows)."""
    x = one ^ many
    planes = x.reshape(*x.shape[:-1], BITS, -1)
    differ = np.bitwise_or.reduce(planes, axis=-2)
    agree = 1 - np.bitwise_count(differ).sum(axis=-1) / MINIMA
    chance = 0.5**BITS
    return (agree - chance) / (1 - chance)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "n", "set_key", "signature", "bands"]
    for part in (p for batch in batches for p in row_runs(batch, 1)):
        sets = shingle_sets(part.column(1))
        least = [minima(s) if len(s) else None for s in sets]
        cols = [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([None if m is None else packed(m) for m in least], pa.binary()),
            pa.array([None if m is None else band_hashes(m) for m in least], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Binary array whose values are the rows of a 2-d array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


class Forest:
    """Union-find that tells which edges span; forgets all after ``most`` vertices, which only lets more edges through."""

    def __init__(self, most: int = 1_000_000):
        self._up: dict[int, int] = {}
        self._most = most

    def _root(self, v: int) -> int:
        up = self._up
        path = []
        while (w := up.get(v, v)) != v:
            path.append(v)
            v = w
        for p in path:
            up[p] = v
        return v

    def joins(self, a: int, b: int) -> bool:
        """Whether the edge joins two trees, which it then does."""
        if len(self._up) > self._most:
            self._up.clear()
        a, b = self._root(a), self._root(b)
        if a == b:
            return False
        self._up[max(a, b)] = min(a, b)
        return True


_LINK = "key long, a long, b long, signature binary, radius float"
_LINK_NAMES = ["key", "a", "b", "signature", "radius"]


def _edges_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    n = len(edges)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int64()), pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float32())],
        names=_LINK_NAMES,
    )


def _cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 inside a task: edges (key null) and leaders of each bucket."""

    def block(ids: np.ndarray, signs: np.ndarray, bands: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        forest = Forest()
        for b in range(BANDS):
            order = np.argsort(bands[:, b], kind="stable")
            value = bands[order, b]
            edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
            radius = np.zeros(len(ids), np.float32)
            leads = np.ones(len(ids), bool)
            for k in np.flatnonzero(np.diff(edge) > 1).tolist():
                rest = order[edge[k] : edge[k + 1]]
                while len(rest) > 1:
                    lead, others = rest[0], rest[1:]
                    near = similarity(signs[lead], signs[others])
                    joins = near >= JOIN
                    got = others[joins]
                    if len(got):
                        leads[got] = False
                        radius[lead] = 1 - near[joins].min()
                        top = int(ids[lead])
                        edges += [(v, top) for v in ids[got].tolist() if forest.joins(v, top)]
                    rest = others[~joins]
            pick = np.flatnonzero(leads)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bands[pick, b].view(np.int64)), pa.array(ids[pick]), pa.nulls(len(pick), pa.int64()), _fixed(signs[pick]), pa.array(radius[pick])], names=_LINK_NAMES
            )
        if edges:
            yield _edges_batch(edges)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        n = batch.num_rows
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(n, -1)
        bands = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(n, BANDS)
        held.append((batch.column(0).to_numpy(zero_copy_only=False), signs, bands))
        size += n
        if size >= BLOCK:
            yield from block(*(np.concatenate([h[i] for h in held]) for i in range(3)))
            held, size = [], 0
    if held:
        yield from block(*(np.concatenate([h[i] for h in held]) for i in range(3)))


def _join_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 between tasks: rows sorted by key; edges between leaders that may have members over the threshold.

    Of all edges that a task sees only those that span come out.
    """
    slack = 1 - PERCENT / 100 + MARGIN
    key, ids, signs, radii = None, [], [], []
    forest = Forest()

    def links() -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        if len(ids) > COMPARED:
            out += [(i, ids[0]) for i in ids[1:]]
        elif len(ids) > 1:
            rows = np.stack([np.frombuffer(s, "<u8") for s in signs])
            r = np.array(radii)
            for i in range(len(ids) - 1):
                near = 1 - similarity(rows[i], rows[i + 1 :]) <= slack + r[i] + r[i + 1 :]
                out += [(ids[i + 1 + j], ids[i]) for j in np.flatnonzero(near).tolist()]
        return [(a, b) for a, b in out if forest.joins(a, b)]

    names = ["a", "b"]
    for batch in batches:
        edges: list[tuple[int, int]] = []
        for k, a, b, s, r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if k is None:
                if forest.joins(a, b):
                    edges.append((a, b))
                continue
            if k != key:
                if len(ids) > 1:
                    edges += links()
                key, ids, signs, radii = k, [], [], []
            ids.append(a)
            signs.append(s)
            radii.append(r)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in edges], pa.int64()) for i in range(2)], names=names)
    if len(ids) > 1:
        edges = links()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in edges], pa.int64()) for i in range(2)], names=names)


def connected_components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``edges`` (a, b): root is the least vertex of its component.

    Large-star and small-star steps in turn, until nothing changes; their number grows
    with the logarithm of the vertices. Each round is written to the shared folder,
    which cuts lineage, and the round before it is deleted; sums of hashes tell when
    nothing changes any more. Minima are aggregated before they are joined back, so a
    hub with many edges is a skewed join that adaptive execution splits, never a group
    in one task.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        discard(before)
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == new:
            break
        state = new
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)


def linked(sets: list[np.ndarray], probes: int = 0) -> list[tuple[int, int]]:
    """Edges that span the components of links between ``sets``.

    With ``probes`` the first so many sets are compared with all, but the others not
    with each other.

    A link means that at least PERCENT % of either set are shared, so the two share one
    of the first n - ceil(n * PERCENT / 100) + 1 shingles in any common order; the order
    is from rare to common. Only sets that meet so are counted.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    codes, seen = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)[1:]
    first = np.concatenate([[0], np.cumsum(sizes)])
    by_rarity = np.empty(len(seen), np.int64)
    by_rarity[np.argsort(seen, kind="stable")] = np.arange(len(seen))
    codes = by_rarity[codes]
    codes = codes[np.lexsort((codes, owner))]  # each set from rare to common
    need = -(-PERCENT * sizes // 100)
    heads = sizes - need + 1
    in_head = np.arange(len(codes)) - first[owner] < heads[owner]
    edges: list[tuple[int, int]] = []

    def index(members: np.ndarray):
        """Postings of the members' first shingles."""
        pick = np.flatnonzero(in_head & members[owner])
        order = pick[np.argsort(codes[pick], kind="stable")]
        return owner[order], codes[order]

    def links_of(i: int, posting: np.ndarray, keys: np.ndarray) -> np.ndarray:
        own = codes[first[i] : first[i + 1]]
        head = own[: heads[i]]
        lo = np.searchsorted(keys, head)
        count = np.searchsorted(keys, head, side="right") - lo
        total = int(count.sum())
        if not total:
            return np.zeros(0, np.int64)
        met = np.unique(posting[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(total)])
        met = met[(sizes[met] >= need[i]) & (sizes[i] >= need[met])]
        if not len(met):
            return met
        many = sizes[met]
        where = np.repeat(first[met] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        theirs = codes[where]
        at = np.searchsorted(own, theirs)
        hit = own[np.minimum(at, len(own) - 1)] == theirs
        both = np.add.reduceat(hit, np.cumsum(many) - many)
        return met[100 * both >= PERCENT * (sizes[i] + sizes[met] - both)]

    everything = np.ones(n, bool)
    posting, keys = index(everything)
    if probes:
        for i in range(probes):
            edges += [(i, j) for j in links_of(i, posting, keys).tolist() if j != i]
        return edges
    left, indexed = everything, n
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            alive = int(left.sum()) if len(queue) % 16 == 0 else indexed
            if alive * 2 < indexed:  # search only among what is not reached yet
                posting, keys = index(left)
                indexed = alive
            if not indexed:
                break
            for j in links_of(i, posting, keys).tolist():
                if left[j]:
                    left[j] = False
                    edges.append((i, j))
                    queue.append(j)
    return edges


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: rows (group key, chunk, part, probe flag, vertex, text) sorted by group, probes first; confirmed edges.

    Texts become sets as they come; a group's sets are held until it ends.
    """
    key, ids, sets, probes = None, [], [], 0

    def out():
        found = linked(sets, probes)
        pairs = {(max(ids[a], ids[b]), min(ids[a], ids[b])) for a, b in found if ids[a] != ids[b]}
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], names=["a", "b"])

    for part in (p for batch in batches for p in row_runs(batch, 5)):
        for c, k, r, flag, v, s in zip(*(part.column(i).to_pylist() for i in range(5)), shingle_sets(part.column(5)), strict=True):
            if (c, k, r) != key:
                if len(ids) > 1:
                    yield out()
                key, ids, sets, probes = (c, k, r), [], [], 0
            ids.append(v)
            sets.append(s)
            probes += flag
    if len(ids) > 1:
        yield out()


#: Columns of members to be confirmed: (comp, chunk, part) is a group.
_ROWS = ["comp", "chunk", "part", "probe", "v", "text"]


def _confirmed(rows: DataFrame, parts: int) -> DataFrame:
    """Confirmed edges of rows of _ROWS."""
    dealt = rows.select(*_ROWS).repartition(parts, "comp", "chunk", "part")
    return map_arrow(dealt.sortWithinPartitions("comp", "chunk", "part", F.col("probe").desc(), "v"), _confirm, "a long, b long")


def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Join texts to ``members`` (v, ...). A bounded filter drops most other texts before they are shuffled."""
    near = may_hold(docs.where("doc is not null").select("doc", "text"), "doc", KeyFilter.of(members, "v"), "may").where("may")
    return members.join(near.select(F.col("doc").alias("v"), "text"), "v")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, n_shingles, component_id, kept``.

    Rows of equal ids are one document with several texts. Null texts are empty;
    empty texts are linked with nothing. Rows with a null id are linked with nothing,
    have a null component and are kept. Other columns are ignored.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = materialize(map_arrow(docs, _sign, "doc long, n long, set_key binary, signature binary, bands binary"), "signed")
    usable = signed.where("doc is not null and set_key is not null")
    classes = materialize(usable.groupBy("set_key").agg(F.min(F.struct("doc", "n", "signature", "bands")).alias("x")).select("set_key", F.col("x.doc").alias("rep"), "x.n", "x.signature", "x.bands"), "classes")

    leaders = map_arrow(classes.select("rep", "signature", "bands"), _cluster, _LINK)
    dealt = leaders.repartition(parts, F.coalesce("key", "a")).sortWithinPartitions("key")
    candidates = connected_components(map_arrow(dealt, _join_leaders, "a long, b long"))

    # Of several classes with one representative (a repeated id) the larger set counts.
    load = classes.groupBy(F.col("rep").alias("v")).agg(F.max("n").alias("n"))
    placed = candidates.join(load, "v")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    members = placed.join(sizes, "root").select("v", "n", F.col("root").alias("comp"), "members", _pieces("members", "shingles", CHUNK, CHUNK_SHINGLES).alias("chunks"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    texts = materialize(_texts_of(docs, members).withColumn("part", F.lit(0)).withColumn("probe", F.lit(0)), "members")
    # A few members of a component of several chunks stand in all of them and join what hangs together.
    picked = texts.where("chunks > 1").where(F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1_000_000)) * F.col("members") < PROBES * 1_000_000)
    probes = picked.withColumn("own", F.col("chunk")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunk <> own")
    links = materialize(_confirmed(texts.select(*_ROWS).unionByName(probes.select(*_ROWS)), parts), "links")

    wide = texts.where("chunks > 1")
    if not wide.isEmpty():
        links = _join_chunks(wide, links, parts)

    # A document with several texts joins the classes of all of them.
    own = usable.select("doc", "set_key").join(classes.select("set_key", "rep"), "set_key")
    spread = own.groupBy("doc").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("n"))
    several = own.join(spread.where("lo <> hi").select("doc"), "doc").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    roots = connected_components(links.unionByName(several))

    named = classes.select("set_key", "rep").join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    out = signed.select("doc", "n", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def _pieces(members: str, shingles: str, most: int, most_shingles: int):
    """Number of pieces in which so many members with so many shingles stay within both bounds."""
    return F.greatest(F.ceil(F.col(members) / F.lit(most)), F.ceil(F.col(shingles) / F.lit(most_shingles)), F.lit(1)).cast("int")


def _join_chunks(wide: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """Links across the chunks of large components.

    Whatever has not joined its component's largest part meets all members of the
    component, in pieces of RESIDUE: exact. Each member is sent once for each RESIDUE of
    such outsiders, and each outsider once for each RESIDUE of members.
    """
    inside = wide.select("comp", "v", "n").distinct()
    roots = connected_components(links)
    placed = inside.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    by_part = placed.groupBy("comp", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    shape = by_part.groupBy("comp").agg(F.max_by("root", F.struct("k", "root")).alias("top"), F.sum("k").alias("members"), F.sum("s").alias("shingles"), F.max("k").alias("most"), F.max_by("s", F.struct("k", "root")).alias("top_s"))
    shape = shape.where("members > most").withColumn("out", F.col("members") - F.col("most")).withColumn("out_s", F.col("shingles") - F.col("top_s"))
    shape = shape.select("comp", "top", _pieces("members", "shingles", RESIDUE, RESIDUE_SHINGLES).alias("pieces"), _pieces("out", "out_s", RESIDUE, RESIDUE_SHINGLES).alias("ways"))
    met = wide.drop("chunk", "part", "probe").join(placed.join(shape, "comp").select("v", "root", "top", "pieces", "ways").distinct(), "v")
    every = lambda many: F.explode(F.sequence(F.lit(0), many - 1))
    crowd = met.withColumn("chunk", F.pmod(F.xxhash64("v", F.lit(3)), F.col("pieces")).cast("int")).withColumn("part", every(F.col("ways"))).withColumn("probe", F.lit(0))
    others = met.where("root <> top").withColumn("chunk", every(F.col("pieces"))).withColumn("part", F.pmod(F.xxhash64("v", F.lit(2)), F.col("ways")).cast("int")).withColumn("probe", F.lit(1))
    out = materialize(links.unionByName(_confirmed(crowd.select(*_ROWS).unionByName(others.select(*_ROWS)), parts)), "links")
    discard(links)
    return out


def near_dedup_query(spark, sf_dir: str) -> DataFrame:
    """op10 over every whole text of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
