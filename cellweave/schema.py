"""Column roles of cell tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class CellSchema:
    """Names of the columns that operators read; resolved once for a call, never hard-coded below it."""

    cell_id: str = "cell_id"
    x: str = "x"
    y: str = "y"
    region: str = "region"
    cell_type: str = "cell_type"
    condition: str = "cond"
    markers: tuple[str, ...] = ()

    def check(self, df: DataFrame) -> DataFrame:
        """``df``, if it has every column; x and y must be numeric."""
        wanted = [self.cell_id, self.x, self.y, self.region, self.cell_type, self.condition, *self.markers]
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        for c in (self.x, self.y, *self.markers):
            if not isinstance(df.schema[c].dataType, T.NumericType):
                raise TypeError(f"{c} is not numeric")
        return df


def marker_slice(df: DataFrame, col_num: int) -> list[str]:
    """Columns 0 .. col_num, the last included: the positional rule of older tables."""
    return df.columns[: col_num + 1]


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns, so that comparisons and aggregates skip it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def first_appearance(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Add ``name``: 0-based ordinal of each key by its least ``order`` value.

    The distinct keys are numbered and joined back; rows are not sorted.
    """
    from pyspark.sql import Window

    firsts = df.groupBy(key).agg(F.min(order).alias("__first"))
    numbered = firsts.select(key, (F.row_number().over(Window.orderBy("__first", key)) - 1).alias(name))
    return df.join(numbered, key)
