"""Running totals whose cuts come from sketches, which depend on the order of rows."""

import numpy as np
import pandas as pd
import pytest

from cellweave.operators import interactions
from cellweave.operators.ranking import running_before


def test_running_totals_of_rows_in_another_order_at_each_reading(spark):
    """As on several machines, where pieces of a sketch arrive in any order and each reading may merge them in another."""

    def mixed(parts):
        p = pd.concat(list(parts))
        yield p.iloc[np.random.default_rng().permutation(len(p))]

    rows = spark.range(0, 400_000, 1, 2).selectExpr("'a' AS g", "id AS v", "1 AS one").mapInPandas(mixed, "g string, v long, one int")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = running_before(rows, ["g"], "v", "one", "before")
        assert found.count() == 400_000 and found.where("before <> v").count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize("n", [1, 2, 7, 75_000, 74_983])
def test_looked_up_shifts_deal_as_hashed_ones(n, monkeypatch):
    """Blocks look the shifts of all their permutations up; they are those of permute_labels, with and without a table."""
    x, steps = np.arange(0, n, max(1, n // 700)), np.arange(5, 25)
    looked_up = np.column_stack(list(interactions._dealt_places(x, n, steps, (0, 30))))
    monkeypatch.setattr(interactions, "SHIFTS", 0)
    assert (looked_up == np.column_stack(list(interactions._dealt_places(x, n, steps, (0, 30))))).all()
    assert (looked_up == interactions.swapped_places(x, n, steps)).all()
