"""Random intercepts and cluster-robust covariances.

Row sums and cluster sums are Spark aggregations and joins; each cluster contributes its few
quadrature nodes inside a task. Clusters are a frame with the list of their rows and their effect,
stored every round, never collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from surveyframe.functions.scalars import interaction_key
from surveyframe.functions.special import digamma, lgamma, trigamma
from surveyframe.models import families, glm
from surveyframe.models.gram import MAX_COLUMNS, gram, matrix
from surveyframe.models.nodes import count_terms, members, repacked, unpacked, weighted_terms
from surveyframe.operators.keys import attach_scalars, join_on
from surveyframe.session import stored, stored_with_max, literal_frame


@dataclass
class MixedFit(glm.CellFit):
    """A cell fit with effects: everything that reads a cell fit reads this one.

    ``clusters`` has the posterior mean and deviation of each effect, ``vcov`` the long covariance of all
    parameters (cells, log phi, logit zero shares, log sigma), ``models`` one row per model with sigma,
    log-likelihood, counts and health. ``stats`` holds that row where there is one model.
    """

    clusters: DataFrame | None = None
    vcov: DataFrame | None = None
    models: DataFrame | None = None
    model_by: list[str] = field(default_factory=list)
    levels: DataFrame | None = None


def cluster_rows(df: DataFrame, cluster: str, keys: Sequence[str], y: str, x: str | None, extra: Sequence[str] = ()) -> DataFrame:
    renamed = df.withColumnRenamed(cluster, "cluster") if cluster != "cluster" else df
    return glm.model_rows(renamed, ["cluster", *extra, *keys], y, x)


# --- cluster scores ---------------------------------------------------------------------


def _cells(coef: DataFrame, keys: Sequence[str]) -> list[tuple]:
    rows = coef.select(*keys).limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} cells; a dense covariance is not available")
    return sorted((tuple(r) for r in rows), key=str)


def score_products(
    scored: DataFrame, cluster: str, keys: list[str], cells: list[tuple], has_slope: bool, shared: dict[str, Column] | None = None
) -> tuple[np.ndarray, list[str]]:
    """Sum over clusters of score times score', and the parameter names.

    Each cluster is one row with a column per parameter, so the products are a plain
    cross-product aggregation and no pair of rows is formed.
    """
    columns, names = [], []
    for cell in cells:
        here = F.lit(True)
        for k, v in zip(keys, cell):
            here = here & F.col(k).eqNullSafe(F.lit(v))
        label = ".".join(str(v) for v in cell)
        for part, factor in (("intercept", F.lit(1.0)), ("slope", F.col("x")))[: 2 if has_slope else 1]:
            names.append(f"{label}:{part}")
            columns.append(F.sum(F.when(here, F.col("weight") * F.col("d1") * factor).otherwise(0.0)).alias(f"p{len(columns)}"))
    for name, c in (shared or {}).items():
        names.append(name)
        columns.append(F.sum(c).alias(f"p{len(columns)}"))
    wide = scored.groupBy(cluster).agg(*columns)
    products = gram(wide, {n: F.col(f"p{i}") for i, n in enumerate(names)})
    return matrix(products, names), names


def long_covariance(spark, cov: np.ndarray, names: Sequence[str], model: str = "model") -> DataFrame:
    rows = [(model, a, b, float(cov[i, j]) if np.isfinite(cov[i, j]) else None) for i, a in enumerate(names) for j, b in enumerate(names)]
    return literal_frame(spark, rows, "model string, term_i string, term_j string, value double")


def sandwich(df: DataFrame, fit: glm.CellFit, cluster: str, y: str, x: str | None = None) -> DataFrame:
    """Cluster-robust covariance of a cell fit: bread from its information blocks, filling
    from the products of per-cluster scores. Cells without information have null entries."""
    rows = cluster_rows(df, cluster, fit.keys, y, x)
    scored = families.with_derivatives(glm.with_linear_predictor(rows, fit.coef, fit.keys), fit.family, with_phi=False)
    scored = glm.with_zero_share(scored, fit.family).withColumn("weight", F.col("n") * (1 - F.col("z")))
    cells = _cells(fit.coef, fit.keys)
    filling, names = score_products(scored, "cluster", fit.keys, cells, fit.has_slope)
    at = {tuple(r[k] for k in fit.keys): r for r in fit.coef.collect()}
    bread = np.zeros_like(filling)
    width = 2 if fit.has_slope else 1
    unknown = np.zeros(len(filling), dtype=bool)
    for i, cell in enumerate(cells):
        r = at[cell]
        block = np.array([[r["v00"], r["v01"]], [r["v01"], r["v11"]]], dtype=float)[:width, :width]
        unknown[i * width : (i + 1) * width] = not np.isfinite(block).all()
        bread[i * width : (i + 1) * width, i * width : (i + 1) * width] = np.nan_to_num(block)
    cov = bread @ filling @ bread
    cov[unknown, :] = np.nan
    cov[:, unknown] = np.nan
    return long_covariance(df.sparkSession, cov, names)


# --- one random intercept ---------------------------------------------------------------

#: Smallest standard deviation of the effects; a fit that reaches it has none.
SIGMA_FLOOR = 0.01
_PHI, _ZI, _SIGMA = 10**9, 2 * 10**9, 3 * 10**9  # codes of parameters; cell k has 2k (intercept) and 2k + 1 (slope)
_TOTAL = -1
#: Bounds of log phi and of the logit of a zero share.
_LOG_PHI, _LOGIT_ZI = 13.8, 12.0


@lru_cache
def _node_array(count: int) -> Column:
    t, w = np.polynomial.hermite.hermgauss(count)
    return F.array(*[F.struct(F.lit(float(a)).alias("t"), F.lit(float(math.log(b) + a * a)).alias("lw")) for a, b in zip(t, w)])


@lru_cache
def _node_free(family: str) -> dict[str, Column]:
    """Parts of a row's likelihood and derivatives that do not depend on the effect."""
    y, phi = F.col("y"), F.col("phi")
    if family == "nb2":
        return {
            "k_ll": lgamma(y + phi) - lgamma(phi) + phi * F.ln(phi) - lgamma(y + 1),
            "k_up": digamma(y + phi) - digamma(phi) + F.ln(phi) + 1,
            "k_tri": trigamma(y + phi) - trigamma(phi) + 1 / phi,
        }
    return {"k_ll": -lgamma(y + 1)} if family == "poisson" else {}


@lru_cache
def _effect_steps(family: str) -> list[dict[str, Column]]:
    """``ll`` and the derivatives of ``_node_free`` rows with their full ``eta``, all observed:
    d1, obs (d/d eta, minus its derivative), up, hp (first, second d/d log phi), cp (cross)."""
    y, phi, mu, t = F.col("y"), F.col("phi"), F.col("mu"), F.col("t")
    eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("eta")))
    start = [{"eta": eta, "mu": F.exp(eta)}]
    if family == "nb1":
        # One lgamma and digamma of the size per node serve all parts.
        size, k = F.col("size"), 1 + phi
        a, b = F.col("psi"), F.col("psi1")
        first = -size / phi * a - size / k + y * (1 / phi - 1 / k)
        second = (
            2 * size / (phi * phi) * a + size / phi * (b * size / phi + 1 / k) + size / phi / k + size / (k * k) - y / (phi * phi) + y / (k * k)
        )
        return [
            *start, {"size": mu / phi},
            {"psi": digamma(y + size) - digamma(size) - F.log1p(phi), "psi1": trigamma(y + size) - trigamma(size)},
            {
                "ll": families.loglik("nb1", y, mu, phi), "d1": size * a, "obs": -(size * a + size * size * b), "w": mu / k, "up": phi * first,
                "hp": phi * first + phi * phi * second, "cp": phi * (-size / phi * a - size * (b * size / phi + 1 / k)),
            },
        ]
    zero = F.lit(0.0)
    if family == "poisson":
        return [*start, {"ll": F.col("k_ll") + y * F.col("eta") - mu, "d1": y - mu, "obs": mu, "up": zero, "hp": zero, "cp": zero}]
    up = phi * (F.col("k_up") - F.ln(t) - (y + phi) / t)
    return [
        *start, {"t": mu + phi},
        {
            "ll": F.col("k_ll") + y * F.col("eta") - (y + phi) * F.ln(t),
            "d1": phi * (y - mu) / t,
            "obs": (y + phi) * mu * phi / (t * t),
            "up": up,
            "hp": up + phi * phi * (F.col("k_tri") - 2 / t + (y + phi) / (t * t)),
            "cp": phi * mu * (y - mu) / (t * t),
        },
    ]


def _at_effect(rows: DataFrame, family: str) -> DataFrame:
    for step in _effect_steps(family):
        rows = rows.withColumns(step)
    return rows


@lru_cache
def _row_terms(zero_part: bool) -> dict[str, Column]:
    """Weighted likelihood, scores and informations of a row in (eta, log phi, logit zero share), and with x."""
    c = F.col
    none = F.lit(0.0)
    if not zero_part:
        terms = {"ll": c("ll"), "s_e": c("d1"), "s_p": c("up"), "s_z": none, "i_ee": c("obs"), "i_ep": -c("cp"), "i_pp": -c("hp"),
                 "i_ez": none, "i_pz": none, "i_zz": none}
    else:
        zi, z, one = c("zi"), c("z"), 1 - c("z")
        terms = {
            "ll": F.when(c("y") == 0, F.ln(zi + (1 - zi) * F.exp("ll"))).otherwise(F.log1p(-zi) + c("ll")),
            "s_e": one * c("d1"), "s_p": one * c("up"), "s_z": z - zi,
            "i_ee": one * c("obs") - z * one * c("d1") * c("d1"),
            "i_ep": -one * c("cp") - z * one * c("d1") * c("up"),
            "i_pp": -one * c("hp") - z * one * c("up") * c("up"),
            "i_ez": z * one * c("d1"), "i_pz": z * one * c("up"), "i_zz": zi * (1 - zi) - z * one,
        }
    terms = {name: c("n") * value for name, value in terms.items()}
    x = c("x")
    return terms | {"s_x": x * terms["s_e"], "i_ex": x * terms["i_ee"], "i_xx": x * x * terms["i_ee"], "i_xp": x * terms["i_ep"], "i_xz": x * terms["i_ez"]}


@lru_cache
def _cluster_columns(zero_part: bool) -> list[Column]:
    sums = [F.sum(v).alias(n) for n, v in _row_terms(zero_part).items()]
    return [*[F.max(n).alias(n) for n in ("u", "reach", "sigma")], F.max(F.col("node").getField("lw")).alias("lw"), *sums]


@lru_cache
def _placing_columns() -> list[Column]:
    c = F.col
    at = lambda name, k: F.element_at(name, c(k) + 1)
    hold = c("curve") + F.exp(-2 * c("ls"))  # a normal posterior: nodes follow when sigma moves
    return [
        (c("pull") / hold).alias("m"), (1 / F.sqrt(hold)).alias("reach"), (at("a", "cell_id") + at("b", "cell_id") * c("x")).alias("eta0"), F.exp(at("lp", "phi_id")).alias("phi"),
        (1 / (1 + F.exp(-at("lz", "zi_id")))).alias("zi"), F.exp("ls").alias("sigma"),
    ]


def _cluster_sums(rows: DataFrame, models: DataFrame, effects: DataFrame, family: str, nodes: int, zero_part: bool) -> DataFrame:
    """One row per (model, cluster) with a list of sums per node and cell."""
    c = F.col
    placed = join_on(rows.join(models.select("model", "a", "b", "lp", "lz", "ls"), "model"), effects.select("model", "cluster", "pull", "curve"), ["model", "cluster"])
    placed = placed.select(*rows.columns, *_placing_columns())
    spread = placed.withColumns(_node_free(family)).select("*", F.posexplode(_node_array(nodes)).alias("k", "node"))
    spread = spread.withColumn("u", c("m") + math.sqrt(2.0) * c("reach") * c("node").getField("t")).withColumn("eta", c("eta0") + c("u"))
    spread = _at_effect(spread, family)
    if zero_part:
        share = F.coalesce(F.try_divide("zi", c("zi") + (1 - c("zi")) * F.exp("ll")), F.lit(0.0))
        spread = spread.withColumn("z", F.when(c("y") == 0, share).otherwise(0.0))
    sums = spread.groupBy("model", "cluster", "k", "cell_id", "phi_id", "zi_id").agg(*_cluster_columns(zero_part))
    packed = F.struct(*[n for n in sums.columns if n not in ("model", "cluster")])
    return sums.groupBy("model", "cluster").agg(F.collect_list(packed).alias("e"))


class _Sums:
    """Scores and informations of one model, over the parameters met so far."""

    def __init__(self) -> None:
        self.codes, self.score, self.info, self.loglik = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0

    def add(self, codes: np.ndarray, score: np.ndarray, info: np.ndarray, loglik: float) -> None:
        every = np.union1d(self.codes, codes)
        if len(every) > len(self.codes):
            old, at = (self.score, self.info), np.searchsorted(every, self.codes)
            self.codes, self.score, self.info = every, np.zeros(len(every)), np.zeros((len(every), len(every)))
            self.score[at], self.info[np.ix_(at, at)] = old
        at = np.searchsorted(self.codes, codes)
        self.score[at] += score
        self.info[np.ix_(at, at)] += info
        self.loglik += loglik

    def rows(self):
        i, j = np.nonzero(self.info)
        first = np.concatenate([[_TOTAL], self.codes, self.codes[i]])
        second = np.concatenate([[_TOTAL], np.full(len(self.codes), _TOTAL), self.codes[j]])
        return first, second, np.concatenate([[self.loglik], self.score, self.info[i, j]])


def _posterior(e: dict, ci: np.ndarray, u: np.ndarray, lw: np.ndarray, s: np.ndarray, sigma: np.ndarray, times: np.ndarray, total: _Sums, has_slope: bool, with_phi: bool, with_zi: bool):
    """Clusters of one model out of sums per node and cell (``e``, entry by entry with its cluster ``ci`` and node ``k``):
    nodes weighed by likelihood and prior, the next centre of the nodes, and by Louis' identity their part of the
    observed information: expected information of the complete data less the posterior covariance of its score.
    A cluster that stands for several equal ones counts ``times``."""
    n, nodes = u.shape
    k = e["k"]
    node = ci * nodes + k
    grid = lambda value: np.bincount(node, weights=value, minlength=n * nodes).reshape(n, nodes)
    ll, slope, curve = grid(e["ll"]), grid(e["s_e"]), grid(e["i_ee"])
    sg = sigma[:, None]
    joint = ll + lw + np.log(s * math.sqrt(2.0))[:, None] - 0.5 * (u / sg) ** 2 - np.log(sg) - 0.5 * math.log(2 * math.pi)
    top = joint.max(axis=1, keepdims=True)
    w = np.exp(joint - top)
    mass = w.sum(axis=1, keepdims=True)
    w /= mass
    loglik = (np.log(mass) + top)[:, 0]
    mean = (w * u).sum(axis=1)
    curvature = np.maximum((w * curve).sum(axis=1), 0.0) + 1 / sigma**2
    # At the posterior the mean slope of the joint density is zero; where nodes miss it this leads back.
    mean = mean + np.clip((w * (slope - u / sg**2)).sum(axis=1) / curvature, -1.0, 1.0)
    pull, spread = mean * curvature, curvature - 1 / sigma**2
    wt = (w * times[:, None]).ravel()[node]
    lines = [(2 * e["cell_id"].astype(np.int64), "s_e")] + ([(2 * e["cell_id"].astype(np.int64) + 1, "s_x")] if has_slope else [])
    lines += ([(_PHI + e["phi_id"].astype(np.int64), "s_p")] if with_phi else []) + ([(_ZI + e["zi_id"].astype(np.int64), "s_z")] if with_zi else [])
    crosses = {("s_e", "s_e"): "i_ee", ("s_e", "s_x"): "i_ex", ("s_x", "s_x"): "i_xx", ("s_e", "s_p"): "i_ep", ("s_x", "s_p"): "i_xp",
               ("s_p", "s_p"): "i_pp", ("s_e", "s_z"): "i_ez", ("s_x", "s_z"): "i_xz", ("s_p", "s_z"): "i_pz", ("s_z", "s_z"): "i_zz"}
    codes = np.unique(np.concatenate([np.unique(c) for c, _ in lines] + [[_SIGMA]]))
    size = len(codes)
    at = [(np.searchsorted(codes, c), name) for c, name in lines]
    info = np.zeros(size * size)
    for a, (i, p) in enumerate(at):
        for j, q in at[a:]:
            value = wt * e[crosses[p, q]]
            info += np.bincount(i * size + j, weights=value, minlength=size * size)
            if p != q:
                info += np.bincount(j * size + i, weights=value, minlength=size * size)
    info = info.reshape(size, size)
    score = sum(np.bincount(i * (n * nodes) + node, weights=e[p], minlength=size * n * nodes) for i, p in at).reshape(size, n, nodes)
    score[-1] = (u / sg) ** 2 - 1
    info[-1, -1] += (2 * w * times[:, None] * (u / sg) ** 2).sum()
    expected = np.einsum("ck,pck->pc", w, score)
    apart = (np.sqrt(w * times[:, None])[None] * (score - expected[:, :, None])).reshape(size, -1)
    total.add(codes, expected @ times, info - apart @ apart.T, float(loglik @ times))
    return pull, spread


def _total_rows(totals: dict[str, _Sums], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each model's sums as rows (i, j, value) of a round's table."""
    for name, total in totals.items():
        i, j, value = total.rows()
        given = {"model": pa.array([name] * len(i), pa.string()), "i": pa.array(i), "j": pa.array(j), "value": pa.array(value)}
        yield pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(len(i), f.type)) for f in kind], names=kind.names)


def _round_batch(kind: pa.Schema, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(columns["model"])
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in kind], names=kind.names)


def _round_schema(cluster: pa.DataType) -> pa.Schema:
    """Columns of a round's table: clusters (i is null), then each task's sums per model."""
    entry = pa.struct([*[(k, pa.int32()) for k in _IDS], *[(k, pa.float64()) for k in ("x", "y", "n")]])
    floats = lambda *names: [(k, pa.float64()) for k in names]
    return pa.schema([("model", pa.string()), ("cluster", cluster), ("e", pa.list_(entry)), *floats("times", "pull", "curve"), ("i", pa.int64()), ("j", pa.int64()), *floats("value")])


def _wide_round(nodes: int, has_slope: bool, with_phi: bool, with_zi: bool, block: int = 256):
    """A round of clusters given as sums per node and cell (``_cluster_sums``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, _Sums] = {}
        kind = None
        for whole in batches:
            kind = _round_schema(whole.schema.field("cluster").type)
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                e, lengths = unpacked(batch.column("e"))
                label = np.array(batch.column("model").to_pylist(), dtype=object)
                mean, spread = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for name in set(label):
                    mine = np.flatnonzero(label == name)
                    take, ci = members(lengths, mine), np.repeat(np.arange(len(mine)), lengths[mine])
                    own = {f: v[take] for f, v in e.items()}
                    u, lw, s, sigma = np.zeros((len(mine), nodes)), np.zeros((len(mine), nodes)), np.zeros(len(mine)), np.ones(len(mine))
                    u[ci, own["k"]], lw[ci, own["k"]], s[ci], sigma[ci] = own["u"], own["lw"], own["reach"], own["sigma"]
                    mean[mine], spread[mine] = _posterior(own, ci, u, lw, s, sigma, np.ones(len(mine)), totals.setdefault(name, _Sums()), has_slope, with_phi, with_zi)
                yield _round_batch(kind, {"model": batch.column("model"), "cluster": batch.column("cluster"), "pull": pa.array(mean), "curve": pa.array(spread)})
        if kind is not None:
            yield from _total_rows(totals, kind)

    return run


def _list_round(family: str, nodes: int, has_slope: bool, with_phi: bool, with_zi: bool, cluster: pa.DataType, block: int = 1024, most_rows: int = 10_000, most_scores: int = 400_000):
    """A round of clusters given as lists of their rows; the nodes exist inside the task only."""
    t, weight = np.polynomial.hermite.hermgauss(nodes)
    log_weight = np.log(weight) + t * t
    kind = _round_schema(cluster)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, _Sums] = {}
        for batch in batches:
            e, lengths = unpacked(batch.column("e"))
            label = np.array(batch.column("model").to_pylist(), dtype=object)
            times, pull, curve, ls = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("times", "pull", "curve", "ls"))
            hold = curve + np.exp(-2 * ls)  # a normal posterior: nodes follow when sigma moves
            mean, reach, sigma = pull / hold, 1 / np.sqrt(hold), np.exp(ls)
            first = e["cell_id"][np.cumsum(lengths) - lengths]
            pull, curve = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for name in set(label):
                mine = np.flatnonzero(label == name)
                mine = mine[np.argsort(first[mine], kind="stable")]  # neighbours touch the same cells, so blocks have few parameters
                widest = 2 * len(np.unique(e["cell_id"][members(lengths, mine)])) + 4
                step = max(16, min(block, most_scores // widest))
                part = np.cumsum(lengths[mine]) // most_rows + np.arange(len(mine)) // step
                for some in np.split(mine, np.flatnonzero(np.diff(part)) + 1):
                    take, row = members(lengths, some), np.repeat(np.arange(len(some)), lengths[some])
                    own = {f: v[take] for f, v in e.items()}
                    u = mean[some, None] + math.sqrt(2.0) * reach[some, None] * t[None]
                    terms = weighted_terms(family, own, own["eta0"][:, None] + u[row], with_zi)
                    entries = {f: v.ravel() for f, v in terms.items()} | {f: np.repeat(own[f], nodes) for f in _IDS}
                    entries["k"] = np.tile(np.arange(nodes), len(row))
                    pull[some], curve[some] = _posterior(
                        entries, np.repeat(row, nodes), u, np.broadcast_to(log_weight, u.shape), reach[some], sigma[some], times[some], totals.setdefault(name, _Sums()),
                        has_slope, with_phi, with_zi,
                    )
            yield _round_batch(kind, {
                "model": batch.column("model"), "e": repacked(lengths, {f: e[f] for f in (*_IDS, "x", "y", "n")}), "times": batch.column("times"),
                "pull": pa.array(pull), "curve": pa.array(curve),
            })
        yield from _total_rows(totals, kind)

    return run


_IDS = ("cell_id", "phi_id", "zi_id")
#: Clusters with more distinct rows than this are summed per node and cell by Spark, the others are lists.
LIST_ROWS = 256


def row_lists(rows: DataFrame, by: Sequence[str], fields: Sequence[str], wide: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(one row per cluster with the sorted list of its rows, the rows of clusters in ``wide``)."""
    gathered = lambda some: some.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
    if wide is None:
        return gathered(rows), None
    return gathered(join_on(rows, wide, ["cluster"], "left_anti")), join_on(rows, wide, ["cluster"], "left_semi")


def wide_clusters(counted: DataFrame, most: int) -> DataFrame | None:
    """Clusters with more than ``most`` rows, if there are any."""
    wide = stored(counted.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("cluster"))
    return None if wide.isEmpty() else wide


def _list_start(lists: DataFrame, models: DataFrame, sigma: float) -> DataFrame:
    """Equal clusters counted once, with the first place of their nodes (``_first_effects``)."""
    def part(r: Column) -> Column:
        eta = F.element_at("a", r["cell_id"] + 1) + F.element_at("b", r["cell_id"] + 1) * r["x"]
        return F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta)))

    add = lambda values: F.aggregate(values, F.lit(0.0), lambda total, v: total + v)
    state = lists.groupBy("model", "e").agg(F.count(F.lit(1)).cast("double").alias("times")).join(models.select("model", "a", "b"), "model")
    state = state.withColumn("mus", F.transform("e", part))
    pairs = F.arrays_zip("e", "mus")
    state = state.withColumns({
        "u": add(F.transform(pairs, lambda p: p["e"]["n"] * (p["e"]["y"] - p["mus"]) / (1 + p["mus"]))),
        "w": add(F.transform(pairs, lambda p: p["e"]["n"] * p["mus"] / (1 + p["mus"]))),
    })
    hold = F.col("w") + 1 / sigma**2
    return state.select("model", "e", "times", (hold * F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("u") / hold))).alias("pull"), F.col("w").alias("curve"))


def _placed_lists(state: DataFrame, models: DataFrame) -> DataFrame:
    """Each listed row with its line, dispersion and zero share under the models' parameters."""
    at = lambda name, k: F.element_at(name, k + 1)
    entry = lambda r: F.struct(
        *[r[k].alias(k) for k in (*_IDS, "x", "y", "n")], (at("a", r["cell_id"]) + at("b", r["cell_id"]) * r["x"]).alias("eta0"),
        F.exp(at("lp", r["phi_id"])).alias("phi"), (1 / (1 + F.exp(-at("lz", r["zi_id"])))).alias("zi"),
    )
    joined = state.join(models.select("model", "a", "b", "lp", "lz", "ls"), "model")
    return joined.select("model", F.transform("e", entry).alias("e"), "times", "pull", "curve", "ls")


_VECTORS = "a array<double>, b array<double>, lp array<double>, lz array<double>, ls double"
_MODEL = (
    f"model string, {_VECTORS}, fa array<boolean>, fb array<boolean>, a_last array<double>, b_last array<double>, lp_last array<double>, "
    "lz_last array<double>, ls_last double, ll double, step double, halved int"
)


def _pack(row: dict, has_slope: bool, with_phi: bool, with_zi: bool, suffix: str = "") -> dict[int, float]:
    """Free parameters of a model by code."""
    out = {2 * k: v for k, (v, free) in enumerate(zip(row[f"a{suffix}"], row["fa"])) if free}
    if has_slope:
        out |= {2 * k + 1: v for k, (v, free) in enumerate(zip(row[f"b{suffix}"], row["fb"])) if free}
    out |= {_PHI + k: v for k, v in enumerate(row[f"lp{suffix}"])} if with_phi else {}
    out |= {_ZI + k: v for k, v in enumerate(row[f"lz{suffix}"])} if with_zi else {}
    return out | {_SIGMA: row[f"ls{suffix}"]}


def _bounds(code: int) -> tuple[float, float]:
    if code < _PHI:
        return -40.0, 40.0
    if code < _ZI:
        return -_LOG_PHI, _LOG_PHI
    return (-_LOGIT_ZI, _LOGIT_ZI) if code < _SIGMA else (math.log(SIGMA_FLOOR), 5.0)


def _system(pdf: pd.DataFrame, codes: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Score, information and log-likelihood out of summed rows (i, j, value)."""
    place = {c: k for k, c in enumerate(codes)}
    score, info, loglik = np.zeros(len(codes)), np.zeros((len(codes), len(codes))), 0.0
    for i, j, value in zip(pdf["i"], pdf["j"], pdf["value"]):
        if i == _TOTAL:
            loglik = value
        elif j == _TOTAL:
            if i in place:
                score[place[i]] = value
        elif i in place and j in place:
            info[place[i], place[j]] = value
    return score, info, loglik


def _held(theta: dict[int, float], score: np.ndarray) -> np.ndarray:
    """Parameters that rest at a bound which their score pushes against."""
    low, high = np.array([_bounds(c) for c in theta]).T
    value = np.array(list(theta.values()))
    return ((value <= low) & (score <= 0)) | ((value >= high) & (score >= 0))


def _newton(has_slope: bool, with_phi: bool, with_zi: bool):
    """A guarded Newton step of one model from its summed score and information."""

    def step(key, sums: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        row = model.iloc[0].to_dict()
        theta = _pack(row, has_slope, with_phi, with_zi)
        codes = list(theta)
        score, info, loglik = _system(sums, codes)
        value = np.array([theta[c] for c in codes])
        if np.isfinite(row["ll"]) and loglik < row["ll"] - 1e-4 - 1e-7 * abs(loglik) and row["halved"] < 12:
            last = _pack(row, has_slope, with_phi, with_zi, "_last")
            fresh = (value + np.array([last[c] for c in codes])) / 2
            row |= {"halved": row["halved"] + 1, "step": float("inf")}
        else:
            free = ~_held(theta, score)
            inner = info[np.ix_(free, free)]
            scale = np.sqrt(np.maximum(np.abs(np.diag(inner)), 1e-8))
            values, vectors = np.linalg.eigh(inner / np.outer(scale, scale))
            move = np.zeros(len(codes))
            move[free] = vectors @ ((vectors.T @ (score[free] / scale)) / np.maximum(np.abs(values), 1e-3)) / scale
            largest = float(np.abs(move).max(initial=0.0))
            # Lines share one limit; a flat dispersion, share or deviation must not hold them back.
            lines = np.array(codes) < _PHI
            move[lines] *= min(1.0, 1.0 / max(np.abs(move[lines]).max(initial=0.0), 1e-12))
            fresh = value + np.clip(move, -1.0, 1.0)
            low, high = np.array([_bounds(c) for c in codes]).T
            fresh = np.clip(fresh, low, high)
            row |= {f"{n}_last": row[n] for n in ("a", "b", "lp", "lz", "ls")}
            row |= {"ll": loglik, "halved": 0, "step": largest}
        new = {n: np.array(row[n], dtype=float) for n in ("a", "b", "lp", "lz")}
        for c, v in zip(codes, fresh):
            if c >= _SIGMA:
                row["ls"] = float(v)
            elif c >= _ZI:
                new["lz"][c - _ZI] = v
            elif c >= _PHI:
                new["lp"][c - _PHI] = v
            else:
                new["b" if c % 2 else "a"][c // 2] = v
        return pd.DataFrame([row | new])[list(model.columns)]

    return step


def _inverse(has_slope: bool, with_phi: bool, with_zi: bool):
    """Covariances of one model's free parameters, and its summary in rows with i = -1."""

    def run(key, sums: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        row = model.iloc[0].to_dict()
        theta = _pack(row, has_slope, with_phi, with_zi)
        codes = list(theta)
        score, info, loglik = _system(sums, codes)
        held = _held(theta, score)
        free = np.flatnonzero(~held)
        inner = info[np.ix_(free, free)]
        scale = np.sqrt(np.maximum(np.diag(inner), 1e-300))
        definite = bool(len(free)) and bool(np.linalg.eigvalsh(inner / np.outer(scale, scale)).min() > 1e-10)
        rows = [(row["model"], -1, k, float(v)) for k, v in enumerate([loglik, len(free), np.abs(score[free]).max(initial=0.0), float(definite), float(held.any())])]
        if definite:
            cov = np.linalg.inv(inner / np.outer(scale, scale)) / np.outer(scale, scale)
            rows += [(row["model"], codes[p], codes[q], float(cov[a, b])) for a, p in enumerate(free) for b, q in enumerate(free)]
        rows += [(row["model"], codes[p], -1, float(score[p])) for p in range(len(codes))]
        return pd.DataFrame(rows, columns=["model", "i", "j", "value"])

    return run


def _identified(rows: DataFrame, coef: DataFrame, keys: list[str], model: Column, phi_by, zi_by) -> DataFrame:
    """Cells of ``coef`` with their numbers inside the model and what the data let us estimate."""
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    seen = rows.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(n * y).alias("total"), F.sum(n * x).alias("sx"), F.sum(n * x * x).alias("sxx"), F.sum(n * y * x).alias("sxy"),
    )
    varies = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n") > 1e-9 * F.col("sxx")
    cells = join_on(coef.select(*keys, "a", "b", "phi"), seen, keys).withColumn("model", model)
    rank = lambda by: F.dense_rank().over(Window.partitionBy("model").orderBy(*by)) - 1 if by else F.lit(0)
    return cells.select(
        *keys, "model", "a", "b", "phi", "n", "total", (F.col("total") > 0).alias("fa"), ((F.col("total") > 0) & varies).alias("fb"),
        rank(keys).alias("cell_id"), rank(phi_by).alias("phi_id"), rank(zi_by).alias("zi_id"),
    )


def _start(cells: DataFrame, sigma: float, zi: float) -> DataFrame:
    ordered = lambda value, by: F.transform(F.array_sort(F.collect_set(F.struct(by, value.alias("v")))), lambda e: e["v"])
    flags = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("cell_id", c))), lambda e: e[c])
    last = lambda c: F.col(c).alias(f"{c}_last")
    a = F.when(F.col("fa"), F.col("a")).otherwise(glm.FLOOR)
    out = cells.groupBy("model").agg(
        ordered(a, "cell_id").alias("a"), ordered(F.when(F.col("fb"), F.col("b")).otherwise(0.0), "cell_id").alias("b"),
        F.transform(F.array_sort(F.collect_set("phi_id")), lambda k: F.lit(0.0)).alias("lp0"),
        F.transform(F.array_sort(F.collect_set("zi_id")), lambda k: F.lit(math.log(zi / (1 - zi)))).alias("lz"),
        F.array_sort(F.collect_set(F.struct("phi_id", F.ln("phi").alias("v")))).alias("lps"),
        flags("fa").alias("fa"), flags("fb").alias("fb"), F.count(F.lit(1)).alias("cells"),
    )
    out = out.withColumns({"lp": F.transform("lps", lambda e: e["v"]), "ls": F.lit(math.log(sigma))})
    ends = [F.lit(None).cast("double").alias("ll"), F.lit(None).cast("double").alias("step"), F.lit(0).alias("halved")]
    return out.select("model", "a", "b", "lp", "lz", "ls", "fa", "fb", *[last(c) for c in ("a", "b", "lp", "lz", "ls")], *ends)


def fit_mixed(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    cluster: str,
    x: str | None = None,
    family: str = "nb2",
    phi_by: Sequence[str] | None = (),
    zi_by: Sequence[str] | None = None,
    nodes: int = 7,
    max_iterations: int = 40,
    tolerance: float = 1e-5,
    model_by: Sequence[str] = (),
) -> MixedFit:
    """Cell lines with one normal random intercept per cluster, by maximum likelihood.

    The likelihood of a cluster is its Gauss-Hermite sum over nodes around its posterior. A round is
    one pass over the rows: sums per cluster, node and cell, from which each cluster adds its score and its
    observed information (Louis' identity) in all parameters of its model: lines, log phi, the logit of a zero share and
    log sigma. A Newton step per model follows; a step that loses likelihood is halved. The covariance of all parameters
    is the inverse of that information at the end.

    ``model_by`` (some of ``keys``) fits one model per key in the same passes; ``phi_by`` and ``zi_by``
    are then groups inside a model. All-zero cells and slopes over a constant x take no part. Raises if a
    model still moves after ``max_iterations`` rounds.
    """
    keys, model_by = list(keys), list(model_by)
    phi_by = None if family == "poisson" else list(phi_by or [])
    zi_by = None if zi_by is None else list(zi_by)
    with_phi, with_zi, has_slope = phi_by is not None, zi_by is not None, x is not None
    name = interaction_key(model_by) if model_by else F.lit("model")
    counted = stored(cluster_rows(df, cluster, keys, y, x))
    cell_rows = stored(counted.groupBy(*keys, "x", "y").agg(F.sum("n").alias("n")))
    start = glm.starting_values(cell_rows, keys, family, None if phi_by is None else [*model_by, *[k for k in phi_by if k not in model_by]], 0.0)
    cells = stored(_identified(cell_rows, start, keys, name, phi_by or [], zi_by or []))
    largest = cells.groupBy("model").count().agg(F.max("count")).first()[0] or 0
    if largest > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} cells in a model; a dense covariance is not available")
    ids = cells.select(*keys, "model", *_IDS)
    rows = join_on(counted, ids, keys).select("model", "cluster", *_IDS, "x", "y", "n")
    sigma = 0.5
    models = stored(_start(cells, sigma, 0.05 if with_zi else 1e-12))
    lists, wide = row_lists(rows, ["model", "cluster"], [*_IDS, "x", "y", "n"], wide_clusters(counted, LIST_ROWS))
    state, effects = stored(_list_start(lists, models, sigma)), None
    if wide is not None:
        wide = stored(wide)
        effects = stored(_first_effects(wide, models, sigma))
    cluster_type = dict(rows.dtypes)["cluster"]
    entry = "struct<" + ",".join([f"{k}:int" for k in _IDS] + ["x:double", "y:double", "n:double"]) + ">"
    schema = f"model string, cluster {cluster_type}, e array<{entry}>, times double, pull double, curve double, i long, j long, value double"
    arrow_cluster = to_arrow_type(rows.schema["cluster"].dataType)

    def one_pass() -> DataFrame:
        done = _placed_lists(state, models).mapInArrow(_list_round(family, nodes, has_slope, with_phi, with_zi, arrow_cluster), schema)
        if wide is not None:
            sums = _cluster_sums(wide, models, effects, family, nodes, with_zi)
            done = done.unionByName(sums.mapInArrow(_wide_round(nodes, has_slope, with_phi, with_zi), schema))
        return stored(done)

    def clusters(done: DataFrame) -> tuple[DataFrame, DataFrame]:
        mine = done.where(F.col("i").isNull())
        return mine.where(F.col("e").isNotNull()).select("model", "e", "times", "pull", "curve"), mine.where(F.col("e").isNull()).select("model", "cluster", "pull", "curve")

    def per_model(done: DataFrame, how, schema: str) -> DataFrame:
        sums = done.where(F.col("i").isNotNull()).groupBy("model", "i", "j").agg(F.sum("value").alias("value"))
        return sums.groupBy("model").cogroup(models.groupBy("model")).applyInPandas(how(has_slope, with_phi, with_zi), schema)

    iteration, moved = 0, float("inf")
    while moved >= tolerance:
        if iteration == max_iterations:
            raise RuntimeError(f"mixed fit still moves by {moved} after {max_iterations} rounds")
        done = one_pass()
        state, effects = clusters(done)
        if iteration:  # the first pass only places the nodes
            models, moved = stored_with_max(per_model(done, _newton, _MODEL), "step")
            moved = 0.0 if moved is None else moved
        iteration += 1
        if largest == 0:
            break
    done = one_pass()
    state, effects = clusters(done)
    count = stored(state.select("model", "times").unionByName(effects.select("model", F.lit(1.0).alias("times"))).groupBy("model").agg(F.sum("times").cast("bigint").alias("n_clusters")))
    # Each cluster's effect is read back from the equal ones it was counted with, when asked for.
    effects = lists.join(state.select("model", "e", "pull", "curve"), ["model", "e"]).select("model", "cluster", "pull", "curve").unionByName(effects)
    hold = F.col("curve") + F.exp(-2 * F.col("ls"))
    effects = effects.join(models.select("model", "ls"), "model")
    effects = effects.select("model", "cluster", (F.col("pull") / hold).alias("m"), (1 / F.sqrt(hold)).alias("s"))
    return _mixed_result(family, keys, has_slope, phi_by, zi_by, model_by, cells, models, effects, count, stored(per_model(done, _inverse, "model string, i long, j long, value double")), iteration)


def _first_effects(rows: DataFrame, models: DataFrame, sigma: float) -> DataFrame:
    """Where each cluster's nodes start: a shrunken step from its counts against the starting lines."""
    eta = F.element_at("a", F.col("cell_id") + 1) + F.element_at("b", F.col("cell_id") + 1) * F.col("x")
    mu = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta)))
    placed = rows.join(models.select("model", "a", "b"), "model").withColumn("mu", mu)
    q = 1 + F.col("mu")  # as of a dispersion of one: the first nodes need not be sharp
    sums = placed.groupBy("model", "cluster").agg(F.sum(F.col("n") * (F.col("y") - F.col("mu")) / q).alias("u"), F.sum(F.col("n") * F.col("mu") / q).alias("w"))
    hold = F.col("w") + 1 / sigma**2
    return sums.select("model", "cluster", (hold * F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("u") / hold))).alias("pull"), F.col("w").alias("curve"))


def _mixed_result(family, keys, has_slope, phi_by, zi_by, model_by, cells, models, effects, count, inverse, iterations) -> MixedFit:
    c = F.col
    pick = lambda i, j: inverse.where((c("i") >= 0) & (c("i") < _PHI) & (F.floor(c("i") / 2) == F.floor(c("j") / 2)) & (c("i") % 2 == i) & (c("j") % 2 == j))
    blocks = pick(0, 0).select("model", F.floor(c("i") / 2).alias("cell_id"), c("value").alias("v00"))
    for k, (i, j) in {"v01": (0, 1), "v11": (1, 1)}.items():
        blocks = blocks.join(pick(i, j).select("model", F.floor(c("i") / 2).alias("cell_id"), c("value").alias(k)), ["model", "cell_id"], "left")
    score = inverse.where((c("i") >= 0) & (c("i") < _PHI) & (c("j") < 0)).groupBy("model", F.floor(c("i") / 2).alias("cell_id")).agg(F.max(F.abs("value")).alias("score"))
    at = lambda name, k: F.element_at(name, c(k) + 1)
    none = F.lit(0.0)
    solved = cells.drop("a", "b", "phi").join(models.select("model", "a", "b", "lp", "lz"), "model")
    solved = solved.join(blocks, ["model", "cell_id"], "left").join(score, ["model", "cell_id"], "left")
    flat = F.when(c("fa") & c("v00").isNotNull(), 0.0)
    coef = stored(
        solved.select(
            *keys, at("a", "cell_id").alias("a"), at("b", "cell_id").alias("b"), F.exp(at("lp", "phi_id")).alias("phi"),
            ((1 / (1 + F.exp(-at("lz", "zi_id")))) if zi_by is not None else none).alias("zi"),
            "v00", (c("v01") if has_slope else flat).alias("v01"), (c("v11") if has_slope else flat).alias("v11"), none.alias("load0"), none.alias("load1"),
            "n", "total", F.coalesce("score", none).alias("score"), c("v00").isNotNull().alias("definite"),
        )
    )
    inside = [k for k in keys if k not in model_by]
    label = lambda by, kind: F.concat_ws(":", F.lit(kind), *([interaction_key([k for k in by if k not in model_by])] if [k for k in by if k not in model_by] else []))
    of_cell = interaction_key(inside) if inside else F.lit("all")
    entries = [F.struct((2 * c("cell_id")).cast("long").alias("code"), F.concat_ws(":", of_cell, F.lit("intercept")).alias("term"))]
    entries += [F.struct((2 * c("cell_id") + 1).cast("long").alias("code"), F.concat_ws(":", of_cell, F.lit("slope")).alias("term"))] if has_slope else []
    entries += [F.struct((c("phi_id") + _PHI).cast("long").alias("code"), label(phi_by, "log_phi").alias("term"))] if phi_by is not None else []
    entries += [F.struct((c("zi_id") + _ZI).cast("long").alias("code"), label(zi_by, "logit_zi").alias("term"))] if zi_by is not None else []
    entries += [F.struct(F.lit(_SIGMA).cast("long").alias("code"), F.lit("log_sigma").alias("term"))]
    terms = stored(cells.select("model", F.inline(F.array(*entries))).distinct())
    side = lambda k: terms.select("model", c("code").alias(k), c("term").alias(f"term_{k}"))
    vcov = stored(
        inverse.where((c("i") >= 0) & (c("j") >= 0)).join(side("i"), ["model", "i"]).join(side("j"), ["model", "j"]).select("model", "term_i", "term_j", "value")
    )
    part = lambda k: F.max(F.when((c("i") < 0) & (c("j") == k), c("value")))
    sums = inverse.groupBy("model").agg(
        part(0).alias("loglik"), part(1).cast("bigint").alias("n_par"), part(2).alias("max_score"), (part(3) > 0).alias("positive_definite"), (part(4) > 0).alias("at_bound")
    )
    table = models.select("model", F.exp("ls").alias("sigma"), (c("ls") <= math.log(SIGMA_FLOOR)).alias("at_boundary")).join(sums, "model").join(count, "model")
    table = stored(table.withColumns({"aic": 2 * c("n_par") - 2 * c("loglik"), "iterations": F.lit(iterations), "converged": F.lit(True)}))
    first = table.orderBy("model").limit(2).collect()
    stats = {**first[0].asDict(), "n_obs": coef.agg(F.sum("n")).first()[0]} if len(first) == 1 else {"iterations": iterations, "converged": True}
    return MixedFit(family, keys, has_slope, coef, phi_by, zi_by, stats, effects, vcov, table, list(model_by))


# --- two crossed intercepts ---------------------------------------------------------------


@dataclass
class _Crossed:
    """Parameters of a crossed fit on their way: p cells, q levels, log phi, and the clusters' precision."""

    family: str
    a: np.ndarray
    e: np.ndarray
    lp: np.ndarray
    hold: float

    def scored(self, batch: pa.RecordBatch) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of a batch's entries, their clusters, and each cluster's effect, information and score. Entries are
        rows with y and n, or sums that Spark took (d1, w, ll, up, hp)."""
        e, lengths = unpacked(batch.column("e"))
        ci, effect = np.repeat(np.arange(batch.num_rows), lengths), batch.column("effect").to_numpy()
        if "y" in e:
            eta = self.a[e["cell_id"]] + self.e[e["level_id"]] + effect[ci]
            terms = count_terms(self.family, e["y"], np.exp(self.lp)[e["phi_id"]], eta[:, None])
            terms["w"] = terms["w"] if self.family == "nb1" else terms["obs"]
            e |= {k: e["n"] * terms[k][:, 0] for k in ("d1", "w", "ll", "up", "hp")}
        d = self.hold + np.bincount(ci, weights=e["w"], minlength=batch.num_rows)
        u = -effect * self.hold + np.bincount(ci, weights=e["d1"], minlength=batch.num_rows)
        return e, ci, effect, d, u


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, size):
            yield whole.slice(start, size)


def _arrow_sums(now: _Crossed):
    """Sums of one pass of the crossed fit. Parameters are p cells, then q levels; each cluster's own effect
    is eliminated from them by its row of the information (Schur complement)."""
    p, q = len(now.a), len(now.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = p + q
        score, info, other = np.zeros(size), np.zeros((size, size)), np.zeros(4)
        phi = np.zeros((2, len(now.lp)))
        for batch in _blocks(batches):
            e, ci, effect, d, u = now.scored(batch)
            n, cell, level = batch.num_rows, e["cell_id"].astype(np.int64), p + e["level_id"].astype(np.int64)
            g = np.zeros(n * size)
            for at in (cell, level):
                score += np.bincount(at, weights=e["d1"] - e["w"] * (u / d)[ci], minlength=size)
                info[np.arange(size), np.arange(size)] += np.bincount(at, weights=e["w"], minlength=size)
                g += np.bincount(ci * size + at, weights=e["w"], minlength=n * size)
            both = np.bincount(cell * size + level, weights=e["w"], minlength=size * size).reshape(size, size)
            g = g.reshape(n, size)
            info += both + both.T - (g / d[:, None]).T @ g
            other += [e["ll"].sum(), np.log(d).sum(), (effect**2).sum(), n]
            phi += [np.bincount(e["phi_id"], weights=e[k], minlength=len(now.lp)) for k in ("up", "hp")]
        i, j = np.nonzero(info)
        many = np.arange(len(now.lp))
        rows = [(i, j, info[i, j]), (np.arange(size), np.full(size, -1), score), (np.arange(4), np.full(4, -2), other)]
        rows += [(many, np.full(len(many), -3 - k), phi[k]) for k in range(2)]
        first, second, value = (np.concatenate([r[k] for r in rows]) for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int64)), pa.array(second.astype(np.int64)), pa.array(value)], names=["i", "j", "value"])

    return run


class _Settling:
    """A deviation on its way to a fixed point: two plain steps in its logarithm, then one to where their ratio leads."""

    def __init__(self) -> None:
        self.steps: list[float] = []

    def next(self, now: float, new: float) -> tuple[float, float]:
        """The next value, not below SIGMA_FLOOR, and by how much the plain step moves it."""
        step = math.log(max(new, SIGMA_FLOOR) / now)
        self.steps.append(step)
        reach = step
        if len(self.steps) == 2:
            first, ratio = self.steps[0], step / self.steps[0] if self.steps[0] else 0.0
            if 0.0 < ratio < 1.0 and first:
                reach = max(-1.5, min(1.5, step / (1.0 - min(ratio, 0.95))))
            self.steps = []
        after = max(now * math.exp(reach), SIGMA_FLOOR)
        return after, 0.0 if now <= SIGMA_FLOOR and step <= 0 else abs(after - now) if abs(reach) > abs(step) else abs(step) * now


def _back_substituted(now: _Crossed, move: np.ndarray, spread: np.ndarray, factor: float):
    """New effect of each cluster once cells and levels have moved, and its posterior variance."""
    p, q = len(now.a), len(now.e)
    entry = pa.struct([(k, pa.int32()) for k in _CROSSED_IDS] + [("y", pa.float64()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            e, ci, effect, d, u = now.scored(batch)
            n, cell, level, w = batch.num_rows, e["cell_id"], e["level_id"], e["w"]
            pull = np.bincount(ci, weights=w * (move[cell] + move[p + level]), minlength=n)
            step = (u - pull) / d
            g = np.bincount(ci * q + level, weights=w, minlength=n * q).reshape(n, q)
            variance = 1 / d + ((g @ spread) * g).sum(axis=1) / d**2
            lists = repacked(np.bincount(ci, minlength=n), {f.name: e[f.name] for f in entry}) if "y" in e else pa.nulls(n, pa.list_(entry))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cluster"), lists, pa.array(effect + factor * step), pa.array(variance), pa.array(np.abs(step))], names=["cluster", "e", "effect", "v", "step"])

    return run


_CROSSED_IDS = ("cell_id", "level_id", "phi_id")


def fit_crossed(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    cluster: str,
    small: str,
    family: str = "nb2",
    phi_by: Sequence[str] | None = (),
    max_iterations: int = 60,
    tolerance: float = 1e-4,
) -> MixedFit:
    """Cells with intercepts for every cluster and for every level of a second, smaller factor.

    Each round solves for cells, levels and clusters together: a cluster touches few cells and levels, so its own
    effect is eliminated inside its group, one pass sums what is left over cells and levels (a dense system of at
    most ``MAX_COLUMNS`` unknowns), and the clusters follow by back-substitution. The same blocks give the standard errors
    (the inverse of the reduced system) and the determinant of the Laplace approximation of the log-likelihood. The
    variances move to the effects' squares over their effective number (the count less the posterior
    variances' share of the prior's) in extrapolated steps, not below ``SIGMA_FLOOR``; log phi by a Newton step at the effects: they approximate the maximum.
    Raises if anything still moves after ``max_iterations`` rounds.
    """
    keys = list(keys)
    phi_by = None if family == "poisson" else list(phi_by or [])
    renamed = df.withColumnRenamed(small, "level") if small != "level" else df
    counted = stored(cluster_rows(renamed, cluster, keys, y, None, ["level"]))
    cell_rows = stored(counted.groupBy(*keys, "x", "y").agg(F.sum("n").alias("n")))
    start = glm.starting_values(cell_rows, keys, family, phi_by, 0.0)
    name = F.lit("model")
    cells = stored(_identified(cell_rows, start, keys, name, phi_by or [], []))
    levels = _cells(counted.select("level").distinct(), ["level"])
    table = sorted(cells.collect(), key=lambda r: r["cell_id"])
    p, q = len(table), len(levels)
    if p + q > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} cells and levels; the reduced system is not available")
    spark = df.sparkSession
    numbered_levels = literal_frame(spark, [(k, v[0]) for k, v in enumerate(levels)], f"level_id int, level {dict(counted.dtypes)['level']}")
    ids = join_on(counted, cells.select(*keys, "cell_id", "phi_id"), keys)
    rows = join_on(ids, numbered_levels, ["level"]).select("cluster", *_CROSSED_IDS, "y", "n")
    kind = dict(rows.dtypes)["cluster"]
    lists, wide = row_lists(rows, ["cluster"], [*_CROSSED_IDS, "y", "n"], wide_clusters(counted, LIST_ROWS))
    state, effects = stored(lists.withColumn("effect", F.lit(0.0))), None
    m = state.count()
    if wide is not None:
        wide = stored(wide)
        effects = stored(wide.select("cluster").distinct().withColumn("effect", F.lit(0.0)))
        m += effects.count()
    a = np.array([r["a"] if r["fa"] else glm.FLOOR for r in table])
    known = np.array([r["fa"] for r in table], dtype=bool)
    lp = np.zeros(max((r["phi_id"] for r in table), default=-1) + 1)
    for r in table:
        lp[r["phi_id"]] = math.log(r["phi"])
    e, sigma, sigma_level = np.zeros(q), 0.5, 0.5
    settle, settle_level = _Settling(), _Settling()
    entry = "struct<" + ",".join(f"{k}:int" for k in _CROSSED_IDS) + ",y:double,n:double>"

    def wide_sums() -> DataFrame:
        """Clusters with many rows: their terms summed per cell and level by Spark."""
        at = literal_frame(spark, [([float(v) for v in a], [float(v) for v in e], [float(v) for v in lp])], "a array<double>, e array<double>, lp array<double>")
        placed = attach_scalars(join_on(wide, effects.select("cluster", "effect"), ["cluster"]), at)
        pick = lambda arr, k: F.element_at(arr, F.col(k) + 1)
        placed = placed.withColumns({"eta": pick("a", "cell_id") + pick("e", "level_id") + F.col("effect"), "phi": F.exp(pick("lp", "phi_id"))})
        scored = _at_effect(placed.drop("a", "e", "lp").withColumns(_node_free(family)), family)
        info = F.col("w") if family == "nb1" else F.col("obs")
        terms = {"d1": F.col("d1"), "w": info, "ll": F.col("ll"), "up": F.col("up"), "hp": F.col("hp")}
        sums = scored.groupBy("cluster", *_CROSSED_IDS).agg(F.max("effect").alias("effect"), *[F.sum(F.col("n") * v).alias(k) for k, v in terms.items()])
        return sums.groupBy("cluster").agg(F.max("effect").alias("effect"), F.collect_list(F.struct(*_CROSSED_IDS, *terms)).alias("e"))

    def over_clusters(run, schema: str) -> DataFrame:
        done = state.select("cluster", "e", "effect").mapInArrow(run, schema)
        return done if wide is None else done.unionByName(wide_sums().mapInArrow(run, schema))

    def one_pass() -> tuple[_Crossed, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        now = _Crossed(family, a, e, lp, 1.0 / sigma**2)
        score, inner, other, phis = np.zeros(p + q), np.zeros((p + q, p + q)), np.zeros(4), np.zeros((2, len(lp)))
        for r in over_clusters(_arrow_sums(now), "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
            i, j, v = r["i"], r["j"], r["value"]
            if j >= 0:
                inner[i, j] = v
            elif j == -1:
                score[i] = v
            elif j == -2:
                other[i] = v
            else:
                phis[-3 - j, i] = v
        at_levels = np.arange(p, p + q)
        inner[at_levels, at_levels] += 1.0 / sigma_level**2
        score[p:] -= e / sigma_level**2
        return now, score, inner, other, phis

    iteration, moved = 0, float("inf")
    used = np.concatenate([known, np.ones(q, dtype=bool)])
    while True:
        now, score, inner, other, phis = one_pass()
        if moved < tolerance:
            break
        if iteration == max_iterations:
            raise RuntimeError(f"crossed intercepts still move by {moved} after {max_iterations} rounds")
        move = np.zeros(p + q)
        move[used] = np.linalg.solve(inner[np.ix_(used, used)], score[used])
        factor = min(1.0, 1.0 / max(np.abs(move).max(initial=0.0), 1e-12))
        spread = np.linalg.inv(inner[p:, p:])
        done = stored(over_clusters(_back_substituted(now, move, spread, factor), f"cluster {kind}, e array<{entry}>, effect double, v double, step double"))
        state, effects = (done, None) if wide is None else (done.where(F.col("e").isNotNull()), done.where(F.col("e").isNull()))
        a, e = a + factor * move[:p], e + factor * move[p:]
        after = done.agg(F.sum(F.col("effect") * F.col("effect")), F.sum("v"), F.max("step")).first()
        new = math.sqrt(max(after[0] / max(m - after[1] / sigma**2, 1e-12), 1e-8))
        new_level = math.sqrt(max(float(e @ e) / max(q - float(np.trace(spread)) / sigma_level**2, 1e-12), 1e-8))
        d_phi = np.zeros(len(lp))
        if phi_by is not None:
            d_phi = np.where(phis[1] < 0, -phis[0] / np.where(phis[1] < 0, phis[1], 1.0), 0.7 * np.sign(phis[0]))
            fresh = np.clip(lp + np.clip(d_phi, -1.0, 1.0), -_LOG_PHI, _LOG_PHI)
            d_phi, lp = fresh - lp, fresh
        sigma, left = settle.next(sigma, new)
        sigma_level, left_level = settle_level.next(sigma_level, new_level)
        moved = max(np.abs(move).max(initial=0.0), after[2], left, left_level, np.abs(d_phi).max(initial=0.0))
        iteration += 1
    cov = np.full((p + q, p + q), np.nan)
    cov[np.ix_(used, used)] = np.linalg.inv(inner[np.ix_(used, used)])
    loglik = other[0] - other[2] / (2 * sigma**2) - m * math.log(sigma) - float(e @ e) / (2 * sigma_level**2) - q * math.log(sigma_level)
    loglik -= 0.5 * (other[1] + np.linalg.slogdet(inner[p:, p:])[1])
    n_par = int(known.sum()) + (0 if phi_by is None else len(lp)) + 2
    value = lambda v: float(v) if np.isfinite(v) else None
    solved = [(r["cell_id"], float(a[k]), float(math.exp(lp[r["phi_id"]])), value(cov[k, k]), float(abs(score[k]))) for k, r in enumerate(table)]
    found = literal_frame(spark, solved, "cell_id int, a double, phi double, v00 double, score double")
    flat = F.when(F.col("v00").isNotNull(), 0.0)
    none = F.lit(0.0)
    coef = stored(cells.drop("a", "b", "phi").join(found, "cell_id").select(
        *keys, "a", none.alias("b"), "phi", none.alias("zi"), "v00", flat.alias("v01"), flat.alias("v11"), none.alias("load0"), none.alias("load1"),
        "n", "total", "score", F.col("v00").isNotNull().alias("definite")))
    label = {r["cell_id"]: r["t"] for r in cells.select("cell_id", interaction_key(keys).alias("t")).collect()}
    vcov = long_covariance(spark, cov[:p, :p], [f"{label[k]}:intercept" for k in range(p)])
    stats = {
        "loglik": float(loglik), "n_par": n_par, "aic": float(-2 * loglik + 2 * n_par), "sigma": sigma, "sigma_level": sigma_level, "iterations": iteration, "converged": True,
        "n_clusters": m, "n_obs": sum(r["n"] for r in table), "max_score": float(np.abs(score[used]).max(initial=0.0)), "positive_definite": True,
        "at_boundary": bool(min(sigma, sigma_level) <= SIGMA_FLOOR), "last_step": float(moved),
    }
    fit = MixedFit(family, keys, False, coef, phi_by, None, stats, done.select("cluster", F.col("effect").alias("m"), F.sqrt("v").alias("s")), vcov, None, [])
    fit.levels = literal_frame(spark, [(v[0], float(e[k]), value(math.sqrt(cov[p + k, p + k]))) for k, v in enumerate(levels)], f"level {dict(counted.dtypes)['level']}, m double, s double")
    return fit


def effect_table(fit: MixedFit) -> DataFrame:
    """Cells with their standard errors and the model-wide variance parts beside them."""
    s = fit.stats
    row = literal_frame(
        fit.coef.sparkSession, [(float(s["sigma"]), float(s["loglik"]), bool(s["converged"]), int(s["iterations"]))],
        "sigma double, model_loglik double, converged boolean, iterations bigint",
    )
    return attach_scalars(fit.coef.select(*fit.keys, "a", "b", "phi", "zi", F.sqrt("v00").alias("se_a"), F.sqrt("v11").alias("se_b")), row)
