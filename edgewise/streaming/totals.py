"""Running totals with a given initial state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningTotal(StatefulProcessor):
    """Adds the counts of each batch to the stored total of the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "total bigint")

    def _stored(self) -> int:
        return self.total.get()[0] if self.total.exists() else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        total = self._stored() + sum(int(pdf["n"].sum()) for pdf in rows)
        self.total.update((total,))
        yield pd.DataFrame({"word": [key[0]], "total": [total]})

    def handleInitialState(self, key, state: pd.DataFrame, timer) -> None:
        self.total.update((self._stored() + int(state["n"].sum()),))

    def close(self) -> None:
        pass


def running_totals(words: DataFrame, initial: DataFrame) -> DataFrame:
    """Total per `word` over all batches, starting from `initial(word, n)`; update mode.

    The rows of a batch are counted per Arrow batch before they are shuffled, so
    a frequent word sends a few rows only.
    """

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.groupby("word", as_index=False).agg(n=("word", "size"))

    words.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    counted = words.select("word").mapInPandas(combine, "word string, n bigint")
    return counted.groupBy("word").transformWithStateInPandas(
        RunningTotal(),
        outputStructType="word string, total bigint",
        outputMode="Update",
        timeMode="None",
        initialState=initial.select("word", F.col("n").cast("bigint").alias("n")).groupBy("word"),
    )
