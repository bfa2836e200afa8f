"""P-values at sizes where the finite series of the SQL twins end too early."""

import math

import pytest
from pyspark.sql import functions as F

from cellweave.functions.scalars import phi
from cellweave.operators.stats import student_p


@pytest.mark.parametrize("free", [250_000, 3_000_000])
@pytest.mark.parametrize("t", [0.593, 2.447, 4.4])
def test_student_p_of_many_degrees_meets_the_normal_limit(t, free):
    assert abs(student_p(t, free) - math.erfc(t / math.sqrt(2))) < 1e-5


def test_normal_distribution_far_out(spark):
    rows = spark.createDataFrame([(z,) for z in (-30.0, -12.0, -6.5, 6.5, 12.0, 30.0)], "z double").select("z", phi(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-12 for r in rows)
