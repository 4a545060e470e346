"""Scratch tables in the shared checkpoint folder.

Loops cut their lineage by writing the state of each round as Parquet and
reading it back: the files live on shared storage, so a lost executor costs a
re-read and not a re-run of earlier rounds, and the file sizes give the planner
true statistics. A finished round is deleted as soon as its successor is there.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    # local-cluster has workers with folders of their own
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = sc.applicationId
    if app not in _local_roots:
        root = tempfile.mkdtemp(prefix="edgewise-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots[app] = root
    return _local_roots[app]


class Scratch:
    """A private sub-folder of the shared root holding numbered tables."""

    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._next = 0

    def path(self, name: str | None = None) -> str:
        if name is None:
            name = f"t{self._next:05d}"
            self._next += 1
        return f"{self.root}/{name}"

    def write(self, df: DataFrame) -> "Table":
        """Materialise `df` once; later reads start from the files."""
        path = self.path()
        df.write.parquet(path)
        return Table(self, path, self.spark.read.schema(df.schema).parquet(path))

    def delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsc.hadoopConfiguration()
        hadoop.getFileSystem(conf).delete(hadoop, True)

    def drop_all(self) -> None:
        self.delete(self.root)


class Table:
    """A materialised scratch table."""

    def __init__(self, scratch: Scratch, path: str | None, df: DataFrame):
        self.scratch, self.path, self.df = scratch, path, df

    def view(self, df: DataFrame) -> "Table":
        """A reading of this table that leaves the files alone when dropped."""
        return Table(self.scratch, None, df)

    def drop(self) -> None:
        if self.path is not None:
            self.scratch.delete(self.path)
