"""Differences of sources against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import source_divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOW))


def brute(rows, least, top):
    docs, counts, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", terms_of(text)
        groups.add((lang, source))
        docs.update((lang, t) for t in set(found))
        counts.update((lang, source, t) for t in found)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for g, t in docs if g == lang and docs[g, t] >= least]
        own = sorted(s for g, s in groups if g == lang)
        count = {s: {t: counts[lang, s, t] for t in kept} for s in own}
        share = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        p = {s: share(count[s]) for s in own}
        q = share({t: sum(count[s][t] for s in own) for t in kept})
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            telling = sorted((-(p[s][t] - q[t]), t.encode(), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(telling[:top], 1)]
    return out


def rows_of_sources():
    r = random.Random(9)
    words = [a + b for a in "abcdeé日" for b in "xyzÄß😀"] + ["İ", "E", "e", "ab"]
    rows = []
    for i in range(400):
        lang = r.choice(["en", "en", "en", "de", None, ""])
        source = r.choice(["hot"] * 3 + [f"s{k}" for k in range(8)] + [None, "", "é"])
        rows.append((lang, source, " ".join(r.choices(words, range(1, len(words) + 1), k=r.randint(0, 40))) + r.choice(["", "1a-b_c", "\x00q[z]\n"])))
    rows += [("en", "long", "ax " * 200_000), ("xx", "alone", "rare words"), ("yy", "a", None), ("yy", "b", ""), ("yy", "b", "one")]
    return rows + rows[:20]


@pytest.mark.parametrize(("least", "top", "small"), [(30, 50, False), (5, 3, True), (1, 50, True)])
def test_differences_equal_brute_force(spark, monkeypatch, least, top, small):
    if small:
        monkeypatch.setattr(op, "BLOCK_ENTRIES", 50)
        monkeypatch.setattr(op, "CHUNK", 4)
        monkeypatch.setattr(op, "CHUNK_ROWS", 7)
        monkeypatch.setattr(op, "TEXT_BYTES", 500)
        monkeypatch.setattr(op, "TILE", 3)
    rows = rows_of_sources()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term int, part string").repartition(5)
    got = [tuple(r) for r in op.source_divergence(df, least, top).collect()]
    assert sorted(got) == sorted(brute(rows, least, top))


def test_no_documents(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert op.source_divergence(df).count() == 0


def test_shares_are_exact():
    r = random.Random(2)
    cases = [(c, c + r.randrange(1, 10**15)) for c in [0, 1, 10**3, 10**9, 10**12, 10**15] for _ in range(50)]
    counts, totals = np.array([c for c, _ in cases]), np.array([t + 5 for _, t in cases])
    assert op.shares(counts, totals).tolist() == [1 + 10**9 * (c + 5) // (t + 5) for c, t in cases]


def test_terms_match_the_pattern():
    texts = ["aB1c é日-x", "", "é", "x", "[]^_`{|}~@", "A\x00b\x7fc", "\x80a"]
    data, edges = op.text_bytes(pa.array(texts))
    starts, ends = op.term_bounds(op.LOWER[data], edges)
    assert [op.LOWER[data][a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == [t for x in texts for t in terms_of(x)]
