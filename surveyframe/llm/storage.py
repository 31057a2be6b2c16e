"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from surveyframe.session import ensure_checkpoint_dir


#: Rows per Arrow batch where the session has Spark's default of 10,000: texts are long rows.
BATCH_ROWS = 1000


def small_batches(spark) -> None:
    """Bound what the JVM and a Python worker hold of a table of texts at a time.

    Changes the session's setting only where it is Spark's default.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def shared_path(spark, kind: str) -> str:
    """A new path below spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read back: computed once, lineage cut."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

