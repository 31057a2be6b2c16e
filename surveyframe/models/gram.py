"""Design columns of factor and numeric terms, cross-product sums and their support."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.session import literal_frame

#: Up to this many columns the products are plain sums of one aggregation; beyond it a wide
#: aggregation compiles slowly and Arrow batches are multiplied instead.
AGGREGATE_COLUMNS = 12
#: A dense solve on the driver holds at most this many columns squared.
MAX_COLUMNS = 1000


@dataclass(frozen=True)
class ModelSpec:
    """Terms as tuples of variable names; a variable with levels is a factor (first level
    is the reference), any other is numeric."""

    terms: Sequence[tuple[str, ...]]
    levels: Mapping[str, Sequence[str]]

    def columns(self) -> list[tuple[str, tuple[tuple[str, str | None], ...]]]:
        """(name, ((variable, level or None), ...)) of every design column."""
        out = [("intercept", ())]
        for term in self.terms:
            choices = [[(v, lv) for lv in self.levels[v][1:]] if v in self.levels else [(v, None)] for v in term]
            for combo in product(*choices):
                out.append((":".join(v if lv is None else f"{v}={lv}" for v, lv in combo), combo))
        return out

    def names(self) -> list[str]:
        return [name for name, _ in self.columns()]

    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for t in self.terms for v in t))

    def row(self, values: Mapping[str, str | float]) -> list[float]:
        """Design row of given values."""
        one = lambda v, lv: float(values[v]) if lv is None else float(values[v] == lv)
        return [float(np.prod([one(v, lv) for v, lv in combo])) for _, combo in self.columns()]


def design_columns(spec: ModelSpec) -> list[Column]:
    out = []
    for _, combo in spec.columns():
        c = F.lit(1.0)
        for v, lv in combo:
            c = c * (F.col(v).cast("double") if lv is None else F.when(F.col(v) == lv, 1.0).otherwise(0.0))
        out.append(c)
    return out


def gram(df: DataFrame, columns: Mapping[str, Column], weight: Column | None = None) -> DataFrame:
    """(i, j, value): weighted sums of products of all column pairs, i <= j."""
    names = list(columns)
    wide = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())],
                     (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    wide = wide.dropna(subset=[f"c{i}" for i in range(len(names))])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    if len(names) <= AGGREGATE_COLUMNS:
        sums = wide.agg(*[F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs])
        entries = F.array(
            *[F.struct(F.lit(names[i]).alias("i"), F.lit(names[j]).alias("j"), F.col(f"s{i}_{j}").alias("value")) for i, j in pairs]
        )
        return sums.select(F.inline(entries))
    partial = wide.mapInArrow(_batch_products(len(names)), "i int, j int, value double")
    total = partial.groupBy("i", "j").agg(F.sum("value").alias("value"))
    label = F.array(*[F.lit(n) for n in names])
    return total.select(
        F.element_at(label, F.col("i") + 1).alias("i"), F.element_at(label, F.col("j") + 1).alias("j"), "value"
    )


def _batch_products(p: int):
    rows, cols = np.triu_indices(p)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            x = np.column_stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(p)])
            w = batch.column("w").to_numpy(zero_copy_only=False)
            total += x.T @ (x * w[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols])], names=["i", "j", "value"]
        )

    return multiply


def counted_design(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Distinct design rows with their number ``n``: an exact reduction before products."""
    return df.groupBy(*spec.variables()).agg(F.count(F.lit(1)).alias("n"))


def spec_gram(df: DataFrame, spec: ModelSpec) -> DataFrame:
    counted = counted_design(df, spec)
    return gram(counted, dict(zip(spec.names(), design_columns(spec))), F.col("n"))


def matrix(entries: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Symmetric matrix of a long product frame; its side is the number of model columns."""
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"{len(names)} model columns; a dense solve is limited to {MAX_COLUMNS}")
    place = {n: k for k, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in entries.collect():
        out[place[r["i"]], place[r["j"]]] = out[place[r["j"]], place[r["i"]]] = r["value"]
    return out


def design_support(df: DataFrame, specs: Mapping[str, ModelSpec]) -> DataFrame:
    """Rows, columns, rank and condition number of each candidate design."""
    rows = []
    for name, spec in specs.items():
        m = matrix(spec_gram(df, spec), spec.names())
        scale = np.sqrt(np.diag(m))
        safe = np.where(scale > 0, scale, 1.0)
        values = np.linalg.eigvalsh(m / np.outer(safe, safe))
        rank = int((values > 1e-9 * values.max()).sum())
        eig = np.linalg.eigvalsh(m)
        condition = float(np.sqrt(eig.max() / eig.min())) if rank == len(scale) else float("inf")
        rows.append((name, int(round(m[0, 0])), len(scale), rank, rank < len(scale), condition, rank == len(scale) and condition < 30.0))
    schema = "formula string, n_rows bigint, n_columns bigint, rank bigint, rank_deficient boolean, condition_number double, acceptable boolean"
    return literal_frame(df.sparkSession, rows, schema)


@dataclass
class LinearFit:
    """Gaussian fit with its dense p×p parts; rows stay in Spark.

    Terms that the design cannot tell apart (``stats["aliased"]``) have null estimates and covariances.
    """

    spec: ModelSpec
    beta: np.ndarray
    cov: np.ndarray
    variance: dict[str, float]
    stats: dict

    def coefficients(self, spark: SparkSession, model: str = "model") -> DataFrame:
        se = np.sqrt(np.diag(self.cov))
        known = lambda n, v: None if n in self.stats["aliased"] else float(v)
        rows = [(model, n, known(n, b), known(n, s), float(self.stats["df"])) for n, b, s in zip(self.spec.names(), self.beta, se)]
        return literal_frame(spark, rows, "model string, term string, estimate double, se double, df double")

    def covariance(self, spark: SparkSession, model: str = "model") -> DataFrame:
        names = self.spec.names()
        gone = set(self.stats["aliased"])
        rows = [
            (model, a, b, None if a in gone or b in gone else float(self.cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)
        ]
        return literal_frame(spark, rows, "model string, term_i string, term_j string, value double")

    def predict(self, grid: DataFrame) -> DataFrame:
        """Mean and standard error on new rows as column expressions."""
        x = [F.col(f"__x{i}") for i in range(len(self.beta))]
        wide = grid.withColumns({f"__x{i}": c for i, c in enumerate(design_columns(self.spec))})
        mean = sum((float(b) * c for b, c in zip(self.beta, x)), F.lit(0.0))
        var = F.lit(0.0)
        for i in range(len(x)):
            for j in range(i, len(x)):
                var = var + (1.0 if i == j else 2.0) * float(self.cov[i, j]) * x[i] * x[j]
        return wide.select(*grid.columns, mean.alias("predicted"), F.sqrt(var).alias("se"))


def inestimable(cross: np.ndarray, names: Sequence[str]) -> list[str]:
    """Terms whose coefficient the design leaves open: those in the null space of its cross products."""
    scale = np.sqrt(np.diag(cross))
    safe = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(cross / np.outer(safe, safe))
    null = vectors[:, values <= 1e-9 * max(values.max(), 1e-300)]
    return [n for n, v in zip(names, np.abs(null).max(axis=1, initial=0.0)) if v > 1e-6]


def fit_gaussian(df: DataFrame, spec: ModelSpec, y: str, var_by: str | None = None, rounds: int = 200) -> LinearFit:
    """Linear model with a variance per ``var_by`` group by maximum likelihood.

    One pass sums the products of design and response per group. The alternation between
    weighted least squares and group variances then works on those p×p sums alone.
    """
    group = F.col(var_by).cast("string") if var_by else F.lit("all")
    p = len(spec.names())
    wide = df.select(group.alias("g"), *[c.alias(f"c{i}") for i, c in enumerate([*design_columns(spec), F.col(y).cast("double")])])
    wide = wide.dropna()
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = wide.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs]
    ).collect()
    xx, xy, yy, n = {}, {}, {}, {}
    for row in sums:
        full = np.zeros((p + 1, p + 1))
        for i, j in pairs:
            full[i, j] = full[j, i] = row[f"s{i}_{j}"]
        xx[row["g"]], xy[row["g"]], yy[row["g"]], n[row["g"]] = full[:p, :p], full[:p, p], full[p, p], row["n"]
    aliased = inestimable(sum(xx.values()), spec.names())
    var, done = {g: 1.0 for g in xx}, False
    for _ in range(rounds):
        a = sum(xx[g] / var[g] for g in xx)
        beta = np.linalg.pinv(a) @ sum(xy[g] / var[g] for g in xx)
        new = {g: max((yy[g] - 2 * beta @ xy[g] + beta @ xx[g] @ beta) / n[g], 1e-12) for g in xx}
        done = all(abs(new[g] - var[g]) <= 1e-12 * var[g] for g in xx)
        var = new
        if done:
            break
    if not done:
        raise RuntimeError(f"group variances still move after {rounds} rounds")
    cov = np.linalg.pinv(sum(xx[g] / var[g] for g in xx))
    loglik = sum(-0.5 * n[g] * (np.log(2 * np.pi * var[g]) + 1) for g in xx)
    total, n_par = sum(n.values()), p - len(aliased) + len(var)
    stats = {"loglik": float(loglik), "n_obs": total, "n_par": n_par, "df": total - n_par, "aic": float(-2 * loglik + 2 * n_par), "aliased": aliased, "converged": True}
    return LinearFit(spec, beta, cov, var, stats)


def grid_weights(spark: SparkSession, spec: ModelSpec, points: Sequence[tuple[dict, dict, float]]) -> DataFrame:
    """Contrast weights of reference-grid points: (labels, values, weight) per point.

    Points with equal labels add up, so weights ±1/k give averages and differences.
    """
    names = spec.names()
    rows: dict[tuple, float] = {}
    label_names = list(points[0][0])
    for labels, values, w in points:
        for term, v in zip(names, spec.row(values)):
            key = (*[labels[k] for k in label_names], term)
            rows[key] = rows.get(key, 0.0) + w * v
    schema = ", ".join(f"`{k}` string" for k in label_names) + ", term string, weight double"
    return literal_frame(spark, [(*k, v) for k, v in rows.items()], schema)


def reference_grid(at: DataFrame, spec: ModelSpec, fixed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows of ``at`` (labels and numeric variables) under every combination of the factors' levels.

    ``fixed`` restricts a factor to some of its levels. The grid has as many rows as ``at`` times the
    combinations, none of them data rows.
    """
    fixed = fixed or {}
    for name in (v for v in spec.variables() if v in spec.levels):
        at = at.withColumn(name, F.explode(F.array(*[F.lit(v) for v in fixed.get(name, spec.levels[name])])))
    return at


def mean_weights(grid: DataFrame, spec: ModelSpec, by: Sequence[str], change: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """(by, term, weight): equally weighted means of a model over grid rows, or with ``change`` (factor to (from, to)) the
    differences of such means; two factors give a difference of differences."""
    change = change or {}
    sign, corners = F.lit(1.0), grid
    for factor, (start, end) in change.items():
        corners = corners.where(F.col(factor).isin(start, end))
        sign = sign * F.when(F.col(factor) == end, 1.0).otherwise(-1.0)
    terms = F.array(*[F.struct(F.lit(n).alias("term"), c.alias("value")) for n, c in zip(spec.names(), design_columns(spec))])
    size = len(change)
    rows = corners.select(*by, sign.alias("__sign"), F.inline(terms))
    # A mean per corner has its rows over one corner: all rows of the group over 2 ** factors.
    weight = F.sum(F.col("__sign") * F.col("value")) / (F.count(F.lit(1)) / F.lit(float(2**size)))
    return rows.groupBy(*by, "term").agg(weight.alias("weight")).where(F.col("weight") != 0)
