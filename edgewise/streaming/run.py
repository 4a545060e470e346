"""Starting streams, and sinks that a rerun of a batch cannot corrupt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgewise.plans.scratch import Scratch


def table_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table, or the files that arrive in its folder, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if _is_file(spark, path):
        # a stream reads folders: name the one file in its folder
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()


class Sink:
    """Scratch folder of one stream: its checkpoint and its output."""

    def __init__(self, spark: SparkSession, name: str, once: bool = False):
        """`once` runs a single batch; with processing-time timers there is always
        a next batch, so such a stream never comes to the end of its input."""
        self.spark, self.once = spark, once
        self.scratch = Scratch(spark, f"stream-{name}")
        self.out = self.scratch.path("out")
        self.checkpoint = self.scratch.path("checkpoint")

    def _finish(self, writer) -> None:
        trigger = {"once": True} if self.once else {"availableNow": True}
        query = writer.option("checkpointLocation", self.checkpoint).trigger(**trigger).start()
        query.awaitTermination()

    def append(self, df: DataFrame) -> DataFrame:
        """Run to the end of the input; rows are final when they are written."""
        self._finish(
            df.writeStream.outputMode("append").format("parquet").option("path", self.out)
        )
        return self.spark.read.schema(df.schema).parquet(self.out)

    def batches(
        self, df: DataFrame, each: Callable[[DataFrame, int], DataFrame], mode: str = "append"
    ) -> DataFrame:
        """Apply `each` to every micro-batch; all results, with their `batch`.

        A batch replaces its own folder, so one that is run twice counts once.
        """

        def write(rows: DataFrame, batch: int) -> None:
            each(rows, batch).write.mode("overwrite").parquet(f"{self.out}/batch={batch}")

        self._finish(df.writeStream.outputMode(mode).foreachBatch(write))
        return self.spark.read.parquet(self.out)

    def until_idle(
        self, df: DataFrame, each: Callable[[DataFrame, int], DataFrame], every: str = "500 milliseconds", state: bool = True
    ) -> DataFrame:
        """As `batches` in append mode, for streams with processing-time timers.

        Runs on after the input is read, as timers still have to fire, and stops when two
        batches have read nothing (the first may be one that a stopped stream left
        unfinished) and, with `state`, no operator holds a row.
        """

        def write(rows: DataFrame, batch: int) -> None:
            each(rows, batch).write.mode("overwrite").parquet(f"{self.out}/batch={batch}")

        writer = df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", self.checkpoint)
        query, seen, empty = writer.trigger(processingTime=every).start(), -1, 0
        while query.isActive:
            last = query.lastProgress
            if last is not None and last["batchId"] > seen:
                seen = last["batchId"]
                empty = 0 if last["numInputRows"] else empty + 1
                if empty > 1 and not (state and sum(x["numRowsTotal"] for x in last["stateOperators"])):
                    query.stop()
            query.awaitTermination(0.2)
        if query.exception() is not None:
            raise query.exception()
        return self.spark.read.parquet(self.out)

    def latest(self, df: DataFrame, mode: str = "complete") -> DataFrame:
        """The whole result table as of the last batch (complete mode).

        Which batch that is is read from the folder, so a restart without new input
        finds it too.
        """

        def write(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{self.out}/batch={batch}")
            for old in self.written():
                if old < batch:
                    self.scratch.delete(f"{self.out}/batch={old}")

        self._finish(df.writeStream.outputMode(mode).foreachBatch(write))
        done = self.written()
        if not done:
            return self.spark.createDataFrame([], df.schema)
        return self.spark.read.schema(df.schema).parquet(f"{self.out}/batch={done[-1]}")

    def written(self) -> list[int]:
        """Numbers of the batches that have a complete folder, in order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.out)
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return []
        names = [s.getPath() for s in files.listStatus(hadoop)]
        complete = [p.getName() for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in complete if n.startswith("batch="))

    def before(self, batch: int) -> DataFrame | None:
        """What the batch before `batch` has written, if there is one."""
        earlier = [b for b in self.written() if b < batch]
        return self.spark.read.parquet(f"{self.out}/batch={earlier[-1]}") if earlier else None

    def final(self) -> DataFrame | None:
        """What the last batch has written."""
        done = self.written()
        return self.spark.read.parquet(f"{self.out}/batch={done[-1]}") if done else None
