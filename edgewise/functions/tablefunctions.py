"""User-defined table functions over the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The Arrow form sends a batch for every call, which takes longer than the few rows in it.
@F.udtf(returnType="instalment int, share long", useArrow=False)
class Instalments:
    """Cents in equal parts; the last part takes the rest."""

    def eval(self, cents: int, parts: int):
        if cents is None or parts is None or parts < 1:
            return
        each = cents // parts
        for i in range(1, parts + 1):
            yield i, each if i < parts else cents - each * (parts - 1)


@F.udtf(returnType="position int, sentence string", useArrow=False)
class Sentences:
    """Parts of a text between full stops, trimmed, with their place; empty ones are left out."""

    def eval(self, text: str):
        place = 0
        for part in (text or "").split("."):
            if part := part.strip(" \n"):
                place += 1
                yield place, part


@F.udtf(returnType=T.StructType().add("n", T.LongType()).add("low", T.DoubleType()).add("high", T.DoubleType()))
class Extent:
    """One row per partition of a table argument: rows, least and greatest `amount`. Holds three numbers."""

    def __init__(self):
        self.n, self.low, self.high = 0, None, None

    def eval(self, row: Row):
        amount = row["amount"]
        self.n += 1
        if amount is not None:
            self.low = amount if self.low is None else min(self.low, amount)
            self.high = amount if self.high is None else max(self.high, amount)

    def terminate(self):
        yield self.n, self.low, self.high


@F.udtf(returnType=T.StructType().add("id", T.LongType()).add("amount", T.DoubleType()))
class AtLeast:
    """Rows of a table argument whose `amount` reaches 5."""

    def eval(self, row: Row):
        if row["amount"] >= 5:
            yield row["id"], row["amount"]


def register_table_functions(spark: SparkSession) -> None:
    for name, function in {
        "instalments": Instalments,
        "sentences": Sentences,
        "extent": Extent,
        "at_least": AtLeast,
    }.items():
        spark.udtf.register(name, function)


def instalments(rows: DataFrame, cents: str, parts: str) -> DataFrame:
    """Built-in form of `instalments`, without Python."""
    each = f"({cents} div {parts})"
    return rows.withColumn("instalment", F.explode(F.expr(f"sequence(1, {parts})"))).withColumn(
        "share", F.expr(f"if(instalment < {parts}, {each}, {cents} - {each} * ({parts} - 1))")
    )


def expand_dates(rows: DataFrame, first: str, last: str) -> DataFrame:
    """One row per day of the closed date range."""
    return rows.withColumn(
        "day", F.explode(F.sequence(F.col(first).cast("date"), F.col(last).cast("date")))
    )
