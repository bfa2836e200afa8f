"""Covered runs go and unique runs stay: pages of ordinary sites, against a brute-force reader of the repeats."""

import random
import time

import numpy as np

from cellweave.llm import html_blocks, html_text


def texts_of(spark, pages, host=lambda k: "h.org"):
    df = spark.createDataFrame([(k, f"http://{host(k)}/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}


def test_a_notice_among_paragraphs_goes(spark):
    own = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(30)]
    line = "subscribe to our weekly newsletter for more stories like this one"
    assert texts_of(spark, [f"<div><p>{t}</p><p>{line}</p></div>" for t in own]) == dict(enumerate(own))
    # On few pages it may be a quotation.
    assert texts_of(spark, [f"<div><p>{t}</p><p>{line}</p></div>" for t in own[:3]]) == {k: f"{t}\n{line}" for k, t in enumerate(own[:3])}


def test_unique_text_in_a_slot_of_boilerplate_stays(spark):
    own = " ".join(f"u{i}" for i in range(31))
    line = "read more of our related stories from around the web today"
    pages = [f"<article><p>a{k} b{k} c{k}</p></article><div class='related'>{own if k == 7 else line}</div>" for k in range(30)]
    got = texts_of(spark, pages)
    assert got == {k: f"a{k} b{k} c{k}" + (f"\n{own}" if k == 7 else "") for k in range(30)}
    mixed = [p.replace(own, f"{line} {own} {line}") for p in pages]
    assert texts_of(spark, mixed) == got


def brute(pages, slot_gone):
    """Texts of pages of one host that are lists of blocks in one slot, by windows looked up in a dictionary."""
    seen = {}
    for k, page in enumerate(pages):
        for words in page:
            for i in range(len(words) - 4):
                seen.setdefault(tuple(words[i : i + 5]), set()).add(k)
    out = []
    for page in pages:
        kept = []
        for words in page:
            cover = lambda least, words=words: {j for i in range(len(words) - 4) if len(seen[tuple(words[i : i + 5])]) >= least for j in range(i, i + 5)}
            hit = cover(2)
            if slot_gone:
                runs, run = [], []
                for j in range(len(words) + 1):
                    if j < len(words) and j not in hit:
                        run.append(words[j])
                    else:
                        runs += run if len(run) >= html_text.KEPT_RUN else []
                        run = []
                if runs:
                    kept.append(" ".join(runs))
            elif len(words) < 5 or len(cover(html_text.SPREAD)) < len(words):
                kept.append(" ".join(words))
        out.append("\n".join(kept))
    return out


def test_runs_equal_brute_force(spark, monkeypatch):
    r = random.Random(12)
    lines = [[f"l{i}n{j}" for j in range(r.randint(5, 30))] for i in range(4)]
    for shared in (0.9, 0.15):
        pages = []
        for k in range(24):
            blocks = []
            for b in range(5):
                words = [f"p{k}b{b}w{j}" for j in range(r.randint(1, 50))]
                if r.random() < shared:
                    words = r.choice(lines) if r.random() < 0.7 else r.choice(lines) + words + r.choice(lines)
                blocks.append(words)
            pages.append(blocks)
        monkeypatch.setattr(html_text, "BLOCK_TOKENS", 300)  # the host has many blocks
        got = texts_of(spark, ["<body>" + "".join(f"<div>{' '.join(w)}</div>" for w in p) + "</body>" for p in pages])
        assert [got[k] for k in range(24)] == brute(pages, shared > 0.5)


def test_runs_and_covers():
    hit = html_text.covered(12, np.array([0, 1, 9]), 3)
    assert hit.tolist() == [True] * 4 + [False] * 5 + [True] * 3
    assert html_text.unique_runs(hit, 5) == [(4, 9)] and html_text.unique_runs(hit, 6) == [] and html_text.unique_runs(np.zeros(3, bool), 1) == [(0, 3)]


def test_long_lists_take_linear_time():
    began = time.process_time()
    for n in (4000, 60_000):
        page = "<ul><li><ul>" + "<b>" * n + "<li>x</li>" * n
        assert sum(b.text == "x" for b in html_blocks.blocks(page)) == n
    for page in ("<table><tr>" + "<td><i>" * 60_000, "<p>" + "<b>" * 60_000 + "<div>x</div>" * 60_000, "<dl>" + "<dt><i>" * 40_000 + "<dd>" * 40_000):
        html_blocks.blocks(page)
    assert time.process_time() - began < 10
