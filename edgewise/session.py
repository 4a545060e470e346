"""Session defaults. Everything here can be overridden by spark-submit."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import edgewise

# functions travel to the workers with their code, so those need no copy of the package
cloudpickle.register_pickle_by_value(edgewise)

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(app: str = "edgewise", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; `master` only for local runs and tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local(cores: int = 8, **conf: str) -> SparkSession:
    """Single-JVM session for tests and the benchmark."""
    base = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
    }
    return build(master=f"local[{cores}]", **{**base, **conf})


TUNING = {
    # hash join instead of sort-merge where the measured build partitions are this small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # session windows are merged per task before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Run-time settings the operators rely on, for sessions built elsewhere."""
    for key, value in TUNING.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
