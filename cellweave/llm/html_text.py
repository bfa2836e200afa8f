"""Main text of web pages, by the suffix arrays of hosts.

What the markup says is plain for most blocks: text of an article stays, menus and the
like go. Of the rest (text beside an article, text that a class name only hints at,
pages without an article) the repeats decide, place by place:

1. Each block outside an article's prose is a stream of tokens. Equal ones of a host are
   put together, with the pages that hold them.
2. Streams of a host are concatenated in blocks of BLOCK_TOKENS, a stop token between
   them, and each block's suffix array and LCP array are built. Suffixes that share RUN
   tokens or more stand together; if they lie on distinct pages the substring repeats.
   What does not repeat inside its block travels as one window hash with its pages, so
   blocks, and hosts, are compared whole wherever a stream was put.
3. The share of tokens under repeated substrings is evidence on the place (slot) of a block, once for
   each page (a page and its copies count as one). Evidence of a host counts beside that of all hosts, and both beside the prior
   of the markup. From LEAST_RATE on a slot is boilerplate on that host.
4. In such a slot covered tokens go, with what stands between them; a run of KEPT_RUN tokens or more that
   stands on no other page stays. In any other slot a block goes that substrings standing on
   SPREAD pages or more cover whole, such as a notice among paragraphs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import KeyFilter, map_arrow, materialize, may_hold, row_runs, table
from cellweave.llm.html_blocks import BESIDE, CHROME, HINTED, OPEN, PROSE, Block, blocks

#: Tokens of the shortest substring that counts as repeated; a shorter segment counts as a whole.
RUN = 5
#: Tokens of segments whose suffixes are sorted together.
BLOCK_TOKENS = 200_000
#: Tokens to which suffixes are sorted (a power of two).
DEPTH = 64
#: Rate of repeated tokens from which a slot is boilerplate.
LEAST_RATE = 0.5
#: Tokens of a run that stays in a slot of boilerplate as it stands on one page only.
KEPT_RUN = 20
#: Pages that hold a substring which goes wherever it fills a block.
SPREAD = 5
#: What the markup alone makes likely, as (rate, number of pages that it weighs).
PRIOR = {BESIDE: (0.6, 5.0), HINTED: (0.6, 5.0), OPEN: (0.2, 5.0)}
#: The same for text that a hint marks inside an article.
PRIOR_INSIDE = (0.4, 5.0)
#: Pages that the evidence of all hosts weighs beside a host's own.
OTHER_HOSTS = 10.0


def prior_of(kind: int, slot: str) -> tuple[float, float]:
    """Rate and weight of the markup for a slot."""
    return PRIOR_INSIDE if kind == HINTED and slot.startswith("1") else PRIOR[kind]


def segments(found: list[Block]) -> list[tuple[int, str, list[str]]]:
    """``(number, slot, tokens)`` of the blocks outside the prose of an article.

    Furniture that the markup names is among them: what it holds may stand unnamed elsewhere.
    """
    return [(i, f"{b.kind}:{b.slot}", b.text.split()) for i, b in enumerate(found) if b.kind != PROSE]


def main_text(found: list[Block], removed: frozenset[str], others: dict[int, bytes] | None = None) -> tuple[str, int, int]:
    """Text of a page, blocks removed or cut as repeated and blocks removed by their markup.

    ``removed`` holds slots of boilerplate. ``others`` tells by number the blocks that fare otherwise than their
    slot: the runs of tokens that stay of them (pairs of 32-bit numbers).
    """
    kept, by_repeat, by_markup = [], 0, 0
    others = others or {}
    for i, b in enumerate(found):
        if b.kind == CHROME:
            by_markup += 1
        elif b.kind != PROSE and (i in others or f"{b.kind}:{b.slot}" in removed):
            by_repeat += 1
            words = b.text.split()
            runs = np.frombuffer(others.get(i, b""), "<i4").reshape(-1, 2).tolist()
            if runs:
                kept.append(" ".join(w for a, z in runs for w in words[a:z]))
        else:
            kept.append(b.text)
    return "\n".join(kept), by_repeat, by_markup


def suffix_array(tokens: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` tokens, and the LCP (up to ``depth``) of each with the one before it.

    Ranks are doubled: those of 1, 2, 4, ... tokens are kept and tell the LCP of
    neighbours from the longest power down.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while step < depth:
        rank = ranks[-1]
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        ranks.append(np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    same = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            for _ in range(2 if k == len(ranks) - 1 else 1):
                inside = (a + (1 << k) <= n) & (b + (1 << k) <= n) & (same[1:] + (1 << k) <= depth)
                hit = np.flatnonzero(inside)
                hit = hit[ranks[k][a[hit]] == ranks[k][b[hit]]]
                a[hit] += 1 << k
                b[hit] += 1 << k
                same[1:][hit] += 1 << k
    return order, same


def window_keys(tokens: np.ndarray, run: int) -> np.ndarray:
    """64-bit hash of each window of ``run`` token hashes."""
    n = max(0, len(tokens) - run + 1)
    h = np.full(n, run * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(run):
        h = (h ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def block_repeats(streams: list[np.ndarray], low: np.ndarray, high: np.ndarray, pages: np.ndarray, run: int = RUN) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Repeats inside a block of segments with the least and the greatest page of each and the number of its pages.

    For each segment the starts of substrings of ``run`` tokens that stand on SPREAD pages or more, of those that
    repeat on fewer, and of the others; and one row ``(hash, least page, greatest page, pages)`` for each different
    substring. Segments of fewer tokens have one substring, themselves.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    part = [s.view(np.uint64) for s in streams]
    flat = np.unique(np.concatenate([*part, np.zeros(0, np.uint64)]), return_inverse=True)[1].astype(np.int64)
    ends = np.cumsum(sizes)
    first = ends - sizes
    # A stop token of its own after each segment, so that no substring crosses two.
    text = np.insert(flat, ends, -1 - np.arange(len(sizes)))
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(text)) - np.repeat(first + np.arange(len(sizes)), sizes + 1)
    order, same = suffix_array(text)
    group = np.cumsum(same < run) if len(order) else order  # suffixes that share ``run`` tokens with a neighbour
    long = place[order] + run <= sizes[owner[order]]
    order, group = order[long], group[long]
    keys = [window_keys(p, run) for p in part]
    rows = []
    none = np.zeros(0, np.int64)
    starts: list[list[np.ndarray]] = [[none, none, none] for _ in sizes]
    if len(order):
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        own = owner[order]
        lo, hi = np.minimum.reduceat(low[own], edge), np.maximum.reduceat(high[own], edge)
        which = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(order))))
        once = np.unique(which * len(sizes) + own)  # a segment counts once, however often it holds a substring
        many = np.bincount(once // len(sizes), pages[once % len(sizes)], len(edge)).astype(np.int64)
        rows.append(np.stack([np.array([keys[own[e]][place[order[e]]] for e in edge], np.int64), lo, hi, many], axis=1))
        kind = np.where(lo == hi, 2, np.where(many >= SPREAD, 0, 1))[which]
        for flag in range(3):
            pick = kind == flag
            o, p = own[pick], place[order][pick]
            by = np.lexsort((p, o))
            cut = np.searchsorted(o[by], np.arange(len(sizes) + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                starts[k][flag] = p[by][cut[k] : cut[k + 1]]
    short = np.flatnonzero((sizes < run) & (sizes > 0))
    if len(short):
        key = np.array([window_keys(part[k], int(sizes[k]))[0] for k in short], np.int64)
        rows.append(np.stack([key, low[short], high[short], pages[short]], axis=1))
        for k in short.tolist():
            starts[k][2 if low[k] == high[k] else 0 if pages[k] >= SPREAD else 1] = np.zeros(1, np.int64)
    return [tuple(x) for x in starts], np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)


_SEGMENT = "host string, slot string, kind int, inside int, seg binary, tokens binary, size int, page long, key long, at int"


_MINIMA = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _SEGMENT from host, html and the page's key.

    A page is known by three minima over the windows of its whole text, so that a page
    and its copies, whose text is no boilerplate, mostly count as one.
    """
    hashes: dict[str, int] = {}

    def hashed(words: list[str]) -> np.ndarray:
        if len(hashes) > 200_000:
            hashes.clear()
        return np.array([hashes.get(w) or hashes.setdefault(w, xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in words], np.uint64)

    def known_by(tokens: np.ndarray) -> int:
        keys = window_keys(tokens, min(RUN, len(tokens))).view(np.uint64)
        return xxhash.xxh3_64_intdigest(np.array([(keys * m).min() for m in _MINIMA], np.uint64).tobytes()) - (1 << 63)

    for part in (p for batch in batches for p in row_runs(batch, 1)):
        rows = []
        for host, source, key in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            found = blocks(source)
            own = segments(found)
            if own:
                page = known_by(hashed([w for b in found for w in b.text.split()]))
            for at, slot, words in own:
                data = hashed(words).tobytes()
                rows.append((host, slot, int(slot[0]), int(slot[2]), xxhash.xxh3_128_digest(data), data, len(words), page, key, at))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _SEGMENT.split(", ")])


#: Rows of a block: the hash of a window with its pages (seg is null), repeated starts of a segment (starts, and whether on
#: SPREAD pages), or a start that other blocks may repeat (hash and seg).
_FOUND = "seg binary, hash long, low long, high long, pages long, starts binary, wide boolean, start int"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _FOUND from segments ``(seg, tokens, low, high, pages)`` in the order of their hosts."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        low, high, pages = (np.array([h[i] for h in held], np.int64) for i in (2, 3, 4))
        starts, windows = block_repeats([h[1] for h in held], low, high, pages)
        rows: list[tuple] = [(None, h, lo, hi, n, None, None, None) for h, lo, hi, n in windows.tolist()]
        for h, (wide, known, open_) in zip(held, starts, strict=True):
            for flag, some in ((True, wide), (False, known)):
                if len(some):
                    rows.append((h[0], None, None, None, None, some.astype("<i4").tobytes(), flag, None))
            if len(known) or len(open_):
                own = window_keys(h[1], min(RUN, len(h[1])))
                rows += [(h[0], int(own[p]), None, None, None, None, None, p) for p in [*known.tolist(), *open_.tolist()]]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    for part in (p for batch in batches for p in row_runs(batch, 1)):
        for seg, tokens, lo, hi, pages in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
            own = np.frombuffer(tokens, "<u8")
            if held and size + len(own) > BLOCK_TOKENS:
                yield out()
                held, size = [], 0
            held.append((seg, own, lo, hi, pages))
            size += len(own)
    if held:
        yield out()


def covered(n: int, starts: np.ndarray, run: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a window of ``run`` tokens at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    at = np.unique(starts)
    step[at] += 1
    np.subtract.at(step, at + run, 1)
    return np.cumsum(step[:-1]) > 0


def unique_runs(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs (end exclusive) of at least ``least`` tokens that are not covered."""
    edge = np.flatnonzero(np.diff(np.concatenate([[1], hit.astype(np.int8), [1]])))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= least]


_SHARE = "seg binary, share double, kept binary, spread boolean"


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _SHARE from ``seg, size, packed starts, single starts, those on SPREAD pages likewise``."""
    for batch in batches:
        shares, kept, spread = [], [], []
        for n, packed, single, wide, wide_single in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
            run = min(RUN, n)
            of = lambda many, one: np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p, "<i4") for p in many or ()), np.array(one or (), np.int64)]).astype(np.int64)
            hit = covered(n, of(packed, single), run)
            shares.append(float(hit.mean()) if n else 0.0)
            kept.append(np.array(unique_runs(hit, KEPT_RUN), "<i4").tobytes())
            spread.append(bool(n >= RUN and covered(n, of(wide, wide_single), run).all()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64()), pa.array(kept, pa.binary()), pa.array(spread, pa.bool_())], names=["seg", "share", "kept", "spread"])


def repeated_shares(found: DataFrame) -> DataFrame:
    """Rows of _SHARE of different segments ``(host, seg, tokens, low, high, pages)``: the share of their tokens in repeated
    substrings, their unique runs, and whether substrings on SPREAD pages cover them whole.

    A host's segments meet in its own blocks; a host with more tokens than a block has
    several, dealt by content. The result does not depend on who meets whom. Pages of different segments that hold a
    substring add up.
    """
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.octet_length("tokens") / 8
    hosts = found.groupBy("host").agg(F.ceil(F.sum(size) / BLOCK_TOKENS).cast("int").alias("blocks"))
    dealt = found.join(hosts, "host").withColumn("block", F.pmod(F.xxhash64("seg"), F.col("blocks")))
    sorted_ = dealt.repartition(parts, "host", "block").sortWithinPartitions("host", "block").select("seg", "tokens", "low", "high", "pages")
    rows = materialize(map_arrow(sorted_, _suffixes, _FOUND), "suffixes")
    repeated = rows.where("seg is null").groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pages").alias("n")).where("low <> high").select("hash", (F.col("n") >= SPREAD).alias("wide"))
    met = rows.where("start is not null").select("seg", "hash", "start").join(repeated, "hash").select("seg", F.lit(None).cast("binary").alias("starts"), "start", "wide")
    starts = rows.where("starts is not null").select("seg", "starts", F.lit(None).cast("int").alias("start"), "wide").unionByName(met)
    far = lambda c: F.collect_list(F.when(F.col("wide"), F.col(c)))
    by_segment = starts.groupBy("seg").agg(F.collect_list("starts").alias("packed"), F.collect_list("start").alias("single"), far("starts").alias("wide"), far("start").alias("wide_single"))
    sizes = found.groupBy("seg").agg(F.max(size).cast("int").alias("n"))
    return map_arrow(sizes.join(by_segment, "seg", "left").select("seg", "n", "packed", "single", "wide", "wide_single"), _covered, _SHARE)


def boilerplate(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host, removed`` (slots) of hosts with boilerplate, and ``key, others`` (number of a block, runs that stay of it) of
    pages with blocks that fare otherwise than their slot, from ``host, html, key``."""
    raw = materialize(map_arrow(pages.select("host", "html", "key"), _parse, _SEGMENT), "segments")
    places = raw.groupBy("host", "slot", "kind", "inside", "page", "seg").agg(F.first("size").alias("size"))
    texts = raw.groupBy("host", "seg", "page").agg(F.first("tokens").alias("tokens")).groupBy("host", "seg").agg(F.first("tokens").alias("tokens"), F.min("page").alias("low"), F.max("page").alias("high"), F.count(F.lit(1)).alias("pages"))
    shares = materialize(repeated_shares(texts), "shares")
    evidence = places.join(shares.select("seg", "share"), "seg").groupBy("host", "slot", "kind", "inside", "page").agg((F.sum(F.col("share") * F.col("size")) / F.sum("size")).alias("share"))
    by_host = materialize(evidence.groupBy("host", "slot", "kind", "inside").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("c")), "slots")
    rate, weight = F.lit(None).cast("double"), F.lit(None).cast("double")
    for kind in (BESIDE, HINTED, OPEN):
        for inside in (0, 1):
            r, w = prior_of(kind, str(inside))
            here = (F.col("kind") == kind) & (F.col("inside") == inside)
            rate, weight = F.when(here, F.lit(r)).otherwise(rate), F.when(here, F.lit(w)).otherwise(weight)
    all_hosts = by_host.groupBy("slot", "kind", "inside").agg(F.sum("n").alias("n_all"), F.sum("c").alias("c_all"))
    all_hosts = all_hosts.select("slot", ((F.col("c_all") + rate * weight) / (F.col("n_all") + weight)).alias("r"))
    decided = by_host.where(F.col("kind") != CHROME).join(all_hosts, "slot").where((F.col("c") + F.col("r") * OTHER_HOSTS) / (F.col("n") + OTHER_HOSTS) >= LEAST_RATE)
    decided = materialize(decided.select("host", "slot"), "decided")

    told = raw.where(F.col("kind") != CHROME).select("host", "slot", "seg", "size", "key", "at").join(decided.withColumn("gone", F.lit(True)), ["host", "slot"], "left")
    stay = told.where(F.col("gone") & (F.col("size") >= KEPT_RUN)).join(shares.where(F.length("kept") > 0).select("seg", "kept"), "seg")
    leave = told.where("gone is null").join(shares.where("spread").select("seg", F.lit(b"").alias("kept")), "seg")
    others = stay.select("key", "at", "kept").unionByName(leave.select("key", "at", "kept")).groupBy("key").agg(F.collect_set(F.struct("at", "kept")).alias("others"))
    return decided.groupBy("host").agg(F.collect_list("slot").alias("removed")), materialize(others, "others")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, ``text``, ``n_chars``, ``n_repeated``, ``n_chrome`` (blocks removed by repeats, by markup).

    Null html counts as empty, null or odd urls share the host ``""``; equal pages
    and rows are all kept, but count as one in the search for repeats. Other columns are
    ignored. The slots of a host travel to its pages by a join that
    Spark broadcasts only while their table is small.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    src = src.withColumn("key", F.xxhash64("host", "html"))
    slots, others = boilerplate(src)
    slots = materialize(slots, "boilerplate")
    result = T.StructType(
        [T.StructField(id_col, src.schema["id"].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
         T.StructField("n_repeated", T.LongType()), T.StructField("n_chrome", T.LongType())]
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(result)
        for part in (p for batch in batches for p in row_runs(batch, 2)):
            made = [
                main_text(blocks(h), frozenset(r or ()), {x["at"]: x["kept"] for x in o or ()})
                for h, r, o in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)
            ]
            cols = [part.column(0), part.column(1), [m[0] for m in made], [len(m[0]) for m in made], [m[1] for m in made], [m[2] for m in made]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], names=target.names)

    # Few pages have blocks that fare otherwise than their slot: only those meet them, the rest stay where they are.
    marked = may_hold(src, "key", KeyFilter.of(others, "key"), "may")
    met = marked.where("may").join(others, "key", "left").select(*src.columns, "others")
    plain = marked.where("not may").select(*src.columns, F.lit(None).cast(others.schema["others"].dataType).alias("others"))
    return map_arrow(plain.unionByName(met).join(slots, "host", "left").select("id", "url", "html", "removed", "others"), extract, result)


def html_query(spark, sf_dir: str) -> DataFrame:
    """op7 over every page."""
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_repeated", "n_chrome")
