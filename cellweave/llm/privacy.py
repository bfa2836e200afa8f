"""Personal data: fixed patterns, and terms that the corpus shows to disclose an entity.

Protected are the strings that the fixed patterns find, and the fact that a text holds
one (of a kind, or of any). Each is an event e with information content -log2 p(e),
p being a share of the corpus' different texts. How much a term t tells about it is
their pointwise mutual information

    log2( p(e | t) / p(e) ),

with p(e | t) taken at the lower end of its confidence interval, so that a few chance
meetings tell little. A term that tells LEAST_SHARE or more of the information would
give the entity away after it is removed: it becomes a span of its own and is
generalised with the rest. Terms are words, and tokens with digits by their form (a
key of forty hexadecimal digits, a number of sixteen), as such tokens never recur.

Events of kinds meet every term of a text; single entities meet the terms around them.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import TEXT, KeyFilter, TwoAgeCache, free_name, map_arrow, materialize, row_runs, table, with_struct
from cellweave.llm.vector_text import LETTER, name_pieces, text_bytes

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of an entity that count as its context.
REACH = 5
#: Different texts (for a single entity: different contexts too) in which a term must meet an event.
LEAST_TEXTS = 2
#: Share of an event's information from which a term discloses it.
LEAST_SHARE = 0.6
#: Standard errors below the observed share at which p(e | t) is taken (Wilson's interval).
ERRORS = 3.0
#: Disclosing terms that one pass over the texts carries, 8 bytes each; further passes take the rest.
TERMS_A_PASS = 1_000_000
#: Distinct terms that a task counts before it passes its sums on.
COUNTED = 200_000
#: Repeated texts whose hashes and numbers of copies are broadcast; more of them are joined by a shuffle.
COPIES_SENT = 1_000_000
CACHE_TERMS = 150_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]{3,}")
_TOKEN_BYTE = LETTER.copy()
_TOKEN_BYTE[0x30:0x3A] = _TOKEN_BYTE[0x80:] = True
_HEX = re.compile(r"[0-9a-f]{8,}")


def luhn(digits: str) -> bool:
    """Check digit rule of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; time grows with the text whatever it holds."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
            at = text.find("@", done)
        else:
            # No address can begin before this sign and hold it.
            done = max(done, at)
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(start, kind number, end)`` of the fixed patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def term_hash(term: str) -> int:
    """Signed 64 bits that stand for a lower-case term."""
    h = xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def term_of(token: str) -> str:
    """The term that a token stands for: the lower-case word, or the form of a token with digits; empty for short numbers."""
    if token.isalpha():
        return token.lower()
    low = token.lower()
    if low.isdigit():
        return f"#9x{len(low)}" if len(low) > 4 else ""
    return f"#{'hex' if _HEX.fullmatch(low) else 'mix'}x{len(low)}"


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Tokens ``(start, end, term)`` outside base spans."""
    out = []
    ends, starts = sorted(b for _, _, b in spans), [a for a, _, _ in spans]
    for m in _TERM.finditer(text):
        # Outside if as many spans have ended at its start as have begun before its end.
        if spans and bisect_left(starts, m.end()) != sum_ended(ends, m.start()):
            continue
        term = term_of(m[0])
        if term:
            out.append((m.start(), m.end(), term))
    return out


def sum_ended(ends: list[int], at: int) -> int:
    """Number of sorted ends at or before a position."""
    return bisect_left(ends, at + 1)


def named_tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different runs of token bytes of a batch of texts, the number of the run at each place, and the text of each place.

    ASCII marks, space and the underscore never belong to a token, so tokens lie inside such runs.
    """
    data, edges = text_bytes(texts)
    solid = _TOKEN_BYTE[data]
    begin, stop = solid.copy(), np.append(~solid, True)
    begin[1:] &= ~solid[:-1]
    first = edges[:-1][np.diff(edges) > 0]
    begin[first] = solid[first]
    stop[1:-1] |= begin[1:]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    long = ends - starts > 2
    starts, ends = starts[long], ends[long]
    codes, names = name_pieces(data, starts, ends)
    return names, codes, np.searchsorted(edges, starts, side="right") - 1


class RunKeys:
    """Hashes of the terms in runs of token bytes that pass a test of many at once; remembered for each run."""

    def __init__(self, test):
        self._test = test
        self._cache = TwoAgeCache(lambda _: None, CACHE_TERMS)

    def __call__(self, runs: list[bytes]) -> list[tuple[int, ...]]:
        found = list(map(self._cache.__getitem__, runs))
        new = [i for i, v in enumerate(found) if v is None]
        if new:
            hashes, owner = [], []
            for i in new:
                text = runs[i].decode("utf-8")
                if text.isascii():
                    hashes.append(_token_hash(text))
                    owner.append(i)
                else:
                    for token in set(_TERM.findall(text)):
                        hashes.append(_token_hash(token))
                        owner.append(i)
                found[i] = ()
            all_hashes = np.array(hashes, np.uint64).view(np.int64)
            for k in np.flatnonzero(self._test(all_hashes)).tolist():
                found[owner[k]] = (*found[owner[k]], int(all_hashes[k]))
            for i in new:
                dict.__setitem__(self._cache, runs[i], found[i])
        return found


def _token_hash(token: str) -> int:
    """``term_hash`` of a token's term, unsigned."""
    return xxhash.xxh3_64_intdigest((token.lower() if token.isalpha() else term_of(token)).encode("utf-8", "surrogatepass"))


def events(text: str) -> Iterator[tuple[str, set[str], str | None]]:
    """Events of a text with the terms that meet them and, for single entities, their context."""
    spans = base_spans(text)
    if not spans:
        return
    free = free_terms(text, spans)
    everything = {t for _, _, t in free}
    for name in sorted({"any", *(KINDS[k] for _, k, _ in spans)}):
        yield name, everything, None
    starts = [f[0] for f in free]
    for a, kind, b in spans:
        i, j = bisect_left(starts, a), bisect_left(starts, b)
        near = [t for _, _, t in [*free[max(0, i - REACH) : i], *free[j : j + REACH]]]
        yield f"{KINDS[kind]}:{text[a:b].lower()}", set(near), " ".join(near)


def wilson(hits, n):
    """Lower end of the interval of a share of ``hits`` in ``n``, as a column."""
    p, z2 = hits / n, ERRORS * ERRORS
    return (p + z2 / (2 * n) - ERRORS * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosing_terms(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Terms over the threshold: ``term`` (hash), ``bits``, ``share`` (of the event's information), ``texts``, one row a term (its most telling event).

    Counts are of different texts: each of a text's n copies weighs 1 / n, so only
    hashes of repeated texts are set apart and no text is shuffled for it. They cover
    all rows; sums are formed in each task before they are shuffled, so a frequent term
    or event moves one row a task. Only terms that meet an event often enough, picked
    by a bounded filter, are counted in the whole corpus.
    """
    hashed = df.select(F.coalesce(F.col(text_col), F.lit("")).alias(TEXT)).withColumn("hash", F.xxhash64(TEXT))
    copies = materialize(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    groups, extra = copies.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()
    weighed = hashed.join(F.broadcast(copies) if groups <= COPIES_SENT else copies, "hash", "left")
    texts = weighed.select(TEXT, (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight"))
    rows = max(1, df.count() - extra)

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, float] = {}

        def out():
            cols = [pa.array([k[i] for k in sums], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(list(sums.values()), pa.float64())], names=["event", "term", "context", "n"])

        for part in (p for batch in batches for p in row_runs(batch, 0)):
            for text, weight in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen = set()  # a text counts once for a pair, whatever contexts it holds
                for event, terms, context in events(text):
                    e, c = term_hash(event), None if context is None else term_hash(context)
                    for t in (None, *map(term_hash, terms)):
                        new = (e, t) not in seen
                        seen.add((e, t))
                        sums[e, t, c] = sums.get((e, t, c), 0.0) + weight * new
                if len(sums) >= COUNTED:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    whole = lambda c: F.round(F.sum(c)).cast("long")
    found = map_arrow(texts, meetings, "event long, term long, context long, n double").groupBy("event", "term", "context").agg(F.sum("n").alias("n"))
    pairs = materialize(found.groupBy("event", "term").agg(whole("n").alias("n"), F.count("context").alias("contexts")), "pairs")
    enough = (F.col("n") >= LEAST_TEXTS) & ((F.col("contexts") == 0) | (F.col("contexts") >= LEAST_TEXTS))
    joint = pairs.where(F.col("term").isNotNull() & enough).select("event", "term", F.col("n").alias("n_te"))
    wanted = KeyFilter.of(joint.select("term").distinct(), "term")

    def text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = RunKeys(wanted)

        def key(token: str) -> int | bool:
            h = term_hash(term_of(token))
            return h if wanted.has(h) else False

        sums: dict[int, float] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(sums.keys()), pa.int64()), pa.array(list(sums.values()), pa.float64())], names=["term", "n"])

        for part in (p for batch in batches for p in row_runs(batch, 0)):
            weights = part.column(1).to_numpy(zero_copy_only=False)
            marked = {}
            for i, text in enumerate(part.column(0).to_pylist()):
                if spans := base_spans(text):
                    marked[i] = {k for a, b, _ in free_terms(text, spans) if (k := key(text[a:b])) is not False}
            names, codes, owner = named_tokens(part.column(0))
            keys = runs(names)
            # Numbers for the hashes met here; a text counts once for each, whatever tokens stand for it.
            number = {k: n for n, k in enumerate(dict.fromkeys([*(k for ks in keys for k in ks), *(k for ks in marked.values() for k in ks)]))}
            first = np.array([number[ks[0]] if ks else -1 for ks in keys], np.int64)
            free = np.ones(part.num_rows, bool)
            free[list(marked)] = False  # tokens inside an entity do not count
            hit = np.flatnonzero((first[codes] >= 0) & free[owner]) if len(codes) else np.zeros(0, np.int64)
            pairs_ = [owner[hit] * len(number) + first[codes[hit]]]
            several = {c: [number[k] for k in ks[1:]] for c, ks in enumerate(keys) if len(ks) > 1}
            if several:
                more = hit[np.isin(codes[hit], list(several))]
                pairs_.append(np.array([t * len(number) + n for t, c in zip(owner[more].tolist(), codes[more].tolist(), strict=True) for n in several[c]], np.int64))
            pairs_.append(np.array([t * len(number) + number[k] for t, ks in marked.items() for k in ks], np.int64))
            text, which = np.divmod(np.unique(np.concatenate(pairs_)), max(1, len(number)))
            total = np.bincount(which, weights[text], len(number)) if len(which) else np.zeros(len(number))
            for k, w in zip(number, total.tolist(), strict=True):
                if w:
                    sums[k] = sums.get(k, 0.0) + w
            if len(sums) >= COUNTED:
                yield out()
                sums.clear()
        if sums:
            yield out()

    chance = pairs.where("term is null").select("event", (F.col("n") / F.lit(float(rows))).alias("p"))
    terms = map_arrow(texts, text_counts, "term long, n double").groupBy("term").agg(whole("n").alias("n_t"))
    bits = F.log2(wilson(F.col("n_te"), F.greatest("n_t", "n_te")) / F.col("p"))
    scored = joint.join(chance, "event").where("p > 0 and p < 1").join(terms, "term").select("term", bits.alias("bits"), (bits / -F.log2("p")).alias("share"), F.col("n_te").alias("texts"))
    return scored.where(F.col("share") >= LEAST_SHARE).groupBy("term").agg(F.max("bits").alias("bits"), F.max("share").alias("share"), F.max("texts").alias("texts"))


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))


def _mark(df: DataFrame, text_col: str, before: str | None, terms: np.ndarray, box: str, rewritten: bool) -> DataFrame:
    """Add ``box`` (spans, text): spans of ``before``, or else of the fixed patterns, with those of ``terms`` (sorted hashes).

    ``text`` is the text in general terms, null where nothing changes or where ``rewritten`` is not asked for.
    """
    result = T.StructType([T.StructField("spans", SPAN_TYPE), T.StructField("text", T.StringType())])

    def spans_of(text: str, known: list[dict] | None, strong, look: bool) -> list[tuple[int, int, int]]:
        base = base_spans(text)
        out = base if known is None else [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in known]
        if look:
            out = sorted([*out, *((a, 4, b) for a, b, _ in free_terms(text, base) if strong(text[a:b]))])
        return out

    def make():
        order = array("q", terms.tobytes())

        def look(token: str) -> bool:
            h = term_hash(term_of(token))
            i = bisect_left(order, h)
            return i < len(order) and order[i] == h

        strong = TwoAgeCache(look, CACHE_TERMS).__getitem__
        runs = RunKeys(lambda h: np.isin(h, terms))

        def run(texts: pa.Array, known: pa.Array):
            own = texts.to_pylist()
            may = np.zeros(len(own), bool)
            if len(terms):
                names, codes, owner = named_tokens(texts)
                hit = np.array([bool(k) for k in runs(names)], bool)
                may[owner[hit[codes]] if len(names) else []] = True
            found = [spans_of(t, k, strong, m) for t, k, m in zip(own, known.to_pylist(), may.tolist(), strict=True)]
            new = [replaced(t, [(a, KINDS[k], b) for a, k, b in s]) if rewritten and s else None for t, s in zip(own, found, strict=True)]
            return [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in s] for s in found], new

        return run

    earlier = F.col(f"`{before}`") if before else F.lit(None).cast(SPAN_TYPE)
    return with_struct(df, box, [F.coalesce(F.col(f"`{text_col}`"), F.lit("")), earlier], result, make)


def _marked(df: DataFrame, text_col: str, rewritten: bool) -> tuple[DataFrame, str]:
    """``df`` with a column of spans and changed texts, and that column's name.

    Terms beyond TERMS_A_PASS take further passes, each written to the shared folder
    before the next, so the driver and the plan hold the terms of one at a time.
    """
    strong = materialize(disclosing_terms(df, text_col).select("term"), "terms")
    passes = max(1, -(-strong.count() // TERMS_A_PASS))
    box, before = free_name("__pii", df), None
    for k in range(passes):
        terms = np.sort(np.asarray(strong.where(F.pmod("term", F.lit(passes)) == k).toArrow().column(0).to_numpy(), np.int64))
        last = k == passes - 1
        df = _mark(df, text_col, before, terms, box, rewritten and last)
        if not last:
            before = free_name("__pii_before", df)
            df = materialize(df.withColumn(before, F.col(f"{box}.spans")).drop(box), "spans")
    return (df.drop(before) if before else df), box


def personal_spans(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, spans_col: str = "pii_spans") -> DataFrame:
    """Add ``pii_spans`` (start, kind, end in code points) to every row: fixed patterns and disclosing terms.

    Spans stand by start, then kind as listed in KINDS. Null and empty texts have none.
    A column of that name is replaced. The fixed patterns' spans are always there,
    whatever the corpus counts say; terms inside them are no spans of their own.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != spans_col]
    found, box = _marked(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text_col])]), text_col, False)
    return found.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{box}.spans").alias(spans_col))


def sanitise(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Texts with every span put in general terms (``[EMAIL]`` and the like); all rows and columns stay, whatever their names.

    Overlapping spans become one, named by the first. ``length_col``, where present,
    is set anew for changed texts. Null texts stay null, texts without spans are not
    touched, repeated rows and ids stay.
    """
    found, box = _marked(df, text_col, True)
    new = {text_col: F.coalesce(F.col(f"{box}.text"), F.col(f"`{text_col}`"))}
    if length_col in df.columns:
        own = F.col(f"`{length_col}`")
        new[length_col] = F.coalesce(F.char_length(F.col(f"{box}.text")).cast(df.schema[length_col].dataType), own)
    return found.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in df.columns])


def replaced(text: str, spans: list[tuple[int, str, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the name of its first."""
    out, done, open_end = [], 0, -1
    for a, kind, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))):
        if a < open_end:
            open_end = max(open_end, b)
            done = open_end
            continue
        out += [text[done:a], f"[{kind.upper()}]"]
        done = open_end = b
    return "".join([*out, text[done:]])


def privacy_query(spark, sf_dir: str) -> DataFrame:
    """op8 over every whole text of documents; ``n_spans`` counts all spans, terms included. Rows of null texts and ids stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_spans(docs, keep=["doc_id"])
    base = F.filter("pii_spans", lambda s: s["kind"] != "term")
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    counts = [F.expr(f"cast(size(filter(pii_spans, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in KINDS[:4]]
    total = F.size("pii_spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), total)
