"""Session helpers: checkpoint location and intermediate tables computed once."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
_shipped: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taken from ``spark.checkpoint.dir`` where it is set.

    Only a local master falls back to a new temporary folder; on a cluster a missing
    setting is an error because a machine-local folder does not survive a lost executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="surveyframe-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A row-level table computed once, lineage cut, in the checkpoint folder, so it survives executor loss.

    Written as columns (``stored``): repeated labels take little space and later steps read only what they use."""
    return stored(df)


def compiled_steps(spark: SparkSession) -> None:
    """Let Spark generate long steps in parts that the JVM compiles.

    The JVM runs a method of over 8,000 bytes interpreted, and parsing a dozen text columns in one step makes such a
    method. Changes the session's setting only where it is Spark's default.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, "8000")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, for the functions that run in Python there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="surveyframe-")) / "surveyframe.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    sc.addPyFile(str(archive))


def stored(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read back: computed once, lineage cut, and a
    size Spark knows, so that its own check decides between broadcast and shuffle."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with_max(df: DataFrame, column: str) -> tuple[DataFrame, float]:
    """``stored`` and the largest value of one column."""
    table = stored(df)
    return table, table.agg({column: "max"}).first()[0]


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows given in code as a local relation with known size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    arrow_schema = to_arrow_schema(parsed)
    columns = list(zip(*rows)) if rows else [[] for _ in parsed.fields]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema=parsed)
