"""Reading wide field tables and writing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.operators.keys import assert_unique
from surveyframe.session import literal_frame


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_wide_csv(spark: SparkSession, path: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Every column as trimmed text under its own header; ``rename`` maps header names
    (only those present) so that names with dots or signs never reach an expression."""
    df = spark.read.csv(
        path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )
    return rename_aliases(df, rename or {})


def rename_aliases(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the listed columns that exist; two aliases of one name must not both exist."""
    present = {old: new for old, new in mapping.items() if old in df.columns}
    names = [present.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns map to one name")
    return df.toDF(*names)


def drop_empty(df: DataFrame) -> DataFrame:
    """Blank text becomes null, then wholly empty rows and columns go.

    One aggregation finds the empty columns; "every row empty" follows from it.
    """
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    clean = df.select(
        *[(F.nullif(F.col(quoted(c)), F.lit("")) if c in text else F.col(quoted(c))).alias(c) for c in df.columns]
    )
    filled = clean.agg(*[F.max(F.col(quoted(c)).isNotNull()).alias(c) for c in clean.columns]).first()
    kept = [c for c in clean.columns if filled[c]]
    return clean.select(*[quoted(c) for c in kept]).dropna("all")


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str, keys: Sequence[str]) -> DataFrame:
    """A lookup table given as rows; its key is checked."""
    return assert_unique(literal_frame(spark, list(rows), schema), keys)


def write_table(df: DataFrame, root: str, name: str, run_date: str, partition_by: Sequence[str] = ()) -> str:
    """Store a cleaned table as parquet under its run date."""
    path = f"{root}/{name}/run_date={run_date}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], root: str, run_date: str, fmt: str = "csv") -> dict[str, str]:
    """Store every table of a named set; files are written by the tasks that hold the rows."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root}/{name}_{run_date}"
        writer = df.write.mode("overwrite")
        writer.csv(paths[name], header=True) if fmt == "csv" else writer.format(fmt).save(paths[name])
    return paths


def write_model(coef: DataFrame, vcov: DataFrame, root: str, name: str, run_date: str) -> str:
    """Store a fitted model as its coefficient and covariance frames."""
    path = f"{root}/{name}_{run_date}"
    coef.write.mode("overwrite").parquet(f"{path}/coef")
    vcov.write.mode("overwrite").parquet(f"{path}/vcov")
    return path
