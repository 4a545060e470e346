"""Scalar functions: pandas, Arrow and plain Python, and SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def line_revenue(price: pd.Series, discount: pd.Series) -> pd.Series:
    """Series to series: the price of a line after its discount."""
    return price.where(discount.isna(), price * (1 - discount))


@F.pandas_udf(T.StructType().add("half", T.DoubleType()).add("label", T.StringType()))
def describe(value: pd.Series, name: pd.Series) -> pd.DataFrame:
    """Series to struct."""
    return pd.DataFrame({"half": value / 2, "label": name.str.upper()})


@F.pandas_udf(T.LongType())
def check_digit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Iterator of series: the Luhn digit of a number, from a table made once per task."""
    import numpy as np

    # digit sums of all three-digit groups, by whether their last digit is doubled
    double = [sum(divmod(2 * d, 10)) for d in range(10)]
    sums = np.array(
        [[sum((double[int(c)] if (i + first) % 2 == 0 else int(c)) for i, c in enumerate(reversed(f"{g:03d}"))) for g in range(1000)] for first in (0, 1)]
    )
    for batch in batches:
        rest, total, turn = batch.to_numpy("int64"), 0, 0
        while rest.any():
            total = total + sums[turn][rest % 1000]
            rest, turn = rest // 1000, 1 - turn
        yield pd.Series((10 - total % 10) % 10 + np.zeros(len(batch), "int64"))


@F.pandas_udf(T.LongType())
def add_columns(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Iterator of several series."""
    for left, right in batches:
        yield left + right


@F.pandas_udf(T.DoubleType())
def series_total(values: pd.Series) -> float:
    """Series to scalar; `grouped.blocked_mean` shows how its groups are bounded."""
    return float(values.sum())


@F.pandas_udf(T.LongType())
def series_count(values: pd.Series) -> int:
    return int(values.count())


@F.udf(T.IntegerType(), useArrow=True)
def text_length(value: str) -> int:
    """Arrow-transferred row function; null stays null."""
    return None if value is None else len(value)


@F.udf(T.StringType(), useArrow=False)
def shout(value: str) -> str:
    """Pickled row function, for comparison with the Arrow one."""
    return None if value is None else value.upper() + "!"


def register_scalars(spark: SparkSession) -> None:
    """Make the functions callable from SQL."""
    spark.udf.register("check_digit", check_digit)
    spark.udf.register("text_length", text_length)
    spark.udf.register("series_total", series_total)
    spark.udf.register("series_count", series_count)
    spark.udf.register(
        "coin", F.udf(lambda: __import__("random").random() < 0.5, T.BooleanType()).asNondeterministic()
    )
    spark.sql(
        """create or replace temporary function age_at(born date, day date) returns int
           return int(floor(months_between(day, born) / 12))"""
    )
