"""Spelling variants against brute force: alterations by crc32, neighbours one edit apart, forms and roots."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import spelling_variants as op

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, least_length=6, least_count=5):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= least_length
    return {w: k for w, k in n.items() if k >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words]


def rows_of_text():
    r = random.Random(4)
    stems = ["".join(r.choice("abé÷ÿn") for _ in range(r.randint(5, 8))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "ababababab", "abababababa", "àaaaaa", "z" * 3000]
    words = list(stems)
    for w in stems:
        for _ in range(4):
            at, c = r.randrange(len(w)), r.choice("abéÿx")
            words.append(r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + c + w[at:]]))
    weights = [r.choice([1, 1, 2, 10, 60, 300]) for _ in words]
    rows = [(r.randrange(10**6), " ".join(r.choices(words, weights, k=r.randint(0, 60))).replace("a", r.choice("aA"))) for _ in range(400)]
    rows += [(11, "qwertz " * 6 + "qwertzu " * 40 + "qwertzui " * 300)]
    rows += [(None, "abcdefg " * 7), (-5, "été-naïveté_x1 " * 6), (7, None), (8, ""), (9, "×÷" * 4 + " İstanbul ＡＢＣ"), (10, "tailing " * 30_000)]
    return rows + rows[:30]


def test_variants_equal_brute_force(spark, monkeypatch):
    rows = rows_of_text()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    want = brute(rows)
    got = [tuple(r) for r in op.spelling_variants(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(f and r != f for _, f, r, *_ in want) and sum(x[4] for x in want) > 40
    monkeypatch.setattr(op, "BLOCK_ENTRIES", 10)
    assert {r["word"]: r["n"] for r in op.word_counts(df).collect()} == brute_words(rows)


def test_neighbours_equal_all_pairs(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(6, 9))) for _ in range(700)})
    df = spark.createDataFrame([(w, r.randrange(5, 9)) for w in words], "word string, n long")
    got = {frozenset((x["a"], x["b"])) for x in op.neighbours(df).collect()}
    assert got == {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(20)] + [("x", "y")]
    got = {x["word"]: x["root"] for x in op.roots_of(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{i:02}": "w20" for i in range(20)}, "x": "y"}


def test_no_words(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.spelling_variants(df).count() == 0
    with pytest.raises(ValueError, match="bigrams"):
        op.spelling_variants(df, least_length=3)


def test_runs_match_the_pattern():
    texts = ["aB1cé", "", "éa", "¿xÀ", "×÷", "日é本", "œé", "x"]
    data, edges = op.text_bytes(pa.array(texts))
    starts, ends = op.run_bounds(data, edges)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == [x for t in texts for x in RUN.findall(t)]


def test_hashes_are_crc32():
    runs = [b"abcdef", "ééé".encode(), b"x" * 500]
    ids = [3, None, -12, 10**12]
    text, code = np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)
    length = np.array([len(runs[c]) for c in code])
    hit, h = op.altered_runs(ids, text, length, code, np.array([zlib.crc32(x) for x in runs], np.uint32))
    want = {k: zlib.crc32(b"%d:" % ids[t] + runs[c]) for k, (t, c) in enumerate(zip(text, code, strict=True)) if ids[t] is not None}
    assert dict(zip(hit.tolist(), h.tolist(), strict=True)) == {k: v for k, v in want.items() if v % 199 == 0}
    for prefix, run in [(b"3:", b"abcdef"), (b"-12:", "éé".encode())]:
        assert op.moved(zlib.crc32(prefix), bytes(len(run))) ^ zlib.crc32(run) == zlib.crc32(prefix + run)
