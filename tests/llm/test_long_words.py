"""Words of 1 to 4 kB, such as those whose polynomials modulo a power of two agree, against brute force."""

import pytest

from cellweave.llm import near_dedup, substring_dedup

from .test_operators import brute_components, brute_windows, pairs, same


def thue_morse(n, first):
    return "".join("ab"[(bin(i).count("1") + first) % 2] for i in range(n))


@pytest.fixture(scope="module")
def long_words(spark):
    rest = " ".join(f"w{i}" for i in range(12))
    texts = []
    for n in (1024, 2048, 4096):
        for first in (0, 1):
            word = thue_morse(n, first)
            texts += [f"{word} {rest}", word, f"{rest} {word} {rest}", f"{word} {word}", "x" * n, "x" * (n - 1) + "y"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_words_of_equal_polynomials_are_told_apart(spark):
    rest = " ".join(f"w{i}" for i in range(12))
    for n in (1024, 2048, 4096):
        one, two = thue_morse(n, 0), thue_morse(n, 1)
        df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string").coalesce(1)
        assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_windows(df).collect()} == {1: 0, 2: 0}
        df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string").coalesce(1)
        assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()} == {1: (1, True), 2: (2, True)}


def test_long_words_equal_brute_force(long_words):
    rows = pairs(long_words)
    same([tuple(r)[:4] for r in substring_dedup.repeated_windows(long_words).collect()], brute_windows(rows))
    same([tuple(r) for r in near_dedup.near_duplicates(long_words).collect()], brute_components(rows))
