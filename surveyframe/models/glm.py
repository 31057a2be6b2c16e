"""Count models with one intercept (and slope) per cell, fitted by Spark aggregations.

A model that is saturated in its factors is the same as one line per cell, so every Newton
step is one ``groupBy(cell)`` of weighted sums and the 2×2 systems are solved as column
expressions. Identical (cell, x, y) rows are counted first. Row-level data never leaves
the executors; the per-cell table stays a local relation while it is small and is
checkpointed beyond that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.functions.scalars import BAND_Z, interaction_key
from surveyframe.functions.special import lgamma
from surveyframe.models import families
from surveyframe.operators.keys import join_on
from surveyframe.session import checkpointed, stored, stored_with_max, literal_frame

MAX_ITERATIONS = 40
TOLERANCE = 1e-7
# A cell without any count has no finite intercept; its search stops here.
FLOOR = -15.0


@dataclass
class CellFit:
    """Fitted cells: ``coef`` has keys, a, b, phi, zi, v00, v01, v11, load0, load1, n, total."""

    family: str
    keys: list[str]
    has_slope: bool
    coef: DataFrame
    phi_by: list[str] | None
    zi_by: list[str] | None
    stats: dict = field(default_factory=dict)


def model_rows(df: DataFrame, keys: Sequence[str], y: str, x: str | None = None, weight: str | None = None) -> DataFrame:
    """(keys, x, y, n): identical rows counted, an exact reduction."""
    x_col = F.col(x).cast("double") if x else F.lit(0.0)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    kept = df.where(F.col(y).isNotNull() & x_col.isNotNull())
    return kept.groupBy(*keys, x_col.alias("x"), F.col(y).cast("double").alias("y")).agg(n.cast("double").alias("n"))


def poisson_cells(df: DataFrame, keys: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """Closed form: log mean, its standard error and the log-likelihood of every cell."""
    rows = model_rows(df, keys, y, weight=weight)
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("y"))
    constant = F.sum(F.col("n") * lgamma(F.col("y") + 1))
    sums = rows.groupBy(*keys).agg(n.alias("n"), total.alias("total"), constant.alias("constant"))
    mean = F.col("total") / F.col("n")
    return sums.select(
        *keys,
        F.col("n").cast("bigint").alias("n"),
        F.when(F.col("total") > 0, F.ln(mean)).alias("estimate"),
        F.when(F.col("total") > 0, 1 / F.sqrt("total")).alias("se"),
        (F.when(F.col("total") > 0, F.col("total") * F.ln(mean)).otherwise(0.0) - F.col("total") - F.col("constant")).alias("loglik"),
    )


def closed_form(df: DataFrame, keys: Sequence[str], y: str) -> CellFit:
    """Poisson cell means as a cell fit, without any iteration."""
    cells = poisson_cells(df, keys, y)
    zero = F.lit(0.0)
    coef = cells.select(
        *keys, F.coalesce("estimate", F.lit(FLOOR)).alias("a"), zero.alias("b"), F.lit(1.0).alias("phi"), zero.alias("zi"),
        (F.col("se") * F.col("se")).alias("v00"), zero.alias("v01"), zero.alias("v11"), zero.alias("load0"), zero.alias("load1"),
        F.col("n").cast("double").alias("n"), F.coalesce(F.col("n") * F.exp("estimate"), F.lit(0.0)).alias("total"), "loglik",
        zero.alias("score"), F.col("se").isNotNull().alias("definite"),
    )
    return CellFit("poisson", list(keys), False, stored(coef), None, None, {"iterations": 0, "converged": True})


def poisson_aic(df: DataFrame, y: str, models: dict[str, Sequence[str]]) -> DataFrame:
    """AIC of nested groupings in closed form, each against the smallest."""
    parts = []
    for name, keys in models.items():
        cells = poisson_cells(df, keys, y)
        parts.append(cells.agg(F.lit(name).alias("model"), F.sum("loglik").alias("loglik"), F.count(F.lit(1)).alias("n_par")))
    table = reduce(lambda a, b: a.unionByName(b), parts)
    table = stored(table.withColumn("aic", -2 * F.col("loglik") + 2 * F.col("n_par")))
    best = table.agg(F.min("aic").alias("m")).select("m").scalar()
    return table.withColumn("delta_aic", F.col("aic") - best)


def _start_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    n, x, z = F.col("n"), F.col("x"), F.log1p("y")
    sums = rows.groupBy(*keys).agg(
        F.sum(n).alias("sw"), F.sum(n * x).alias("sx"), F.sum(n * z).alias("sz"),
        F.sum(n * x * x).alias("sxx"), F.sum(n * x * z).alias("sxz"), F.sum(n * F.col("y")).alias("sy"),
    )
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    flat = det <= 1e-9 * F.col("sw") * F.col("sxx")
    slope = F.when(flat, 0.0).otherwise(F.try_divide(F.col("sw") * F.col("sxz") - F.col("sx") * F.col("sz"), det))
    return sums.withColumn("b", slope)


def trend_start(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least squares of log1p(y) on x per cell, slope zero where x does not vary."""
    level = (F.col("sz") - F.col("b") * F.col("sx")) / F.col("sw")
    return _start_sums(rows, keys).select(*keys, level.alias("a"), "b")


def starting_values(rows: DataFrame, keys: list[str], family: str, phi_by: list[str] | None, zi: float) -> DataFrame:
    """Least-squares slopes, intercepts moved to the observed cell means, and a dispersion
    from squared distances to those lines."""
    n, y, x = F.col("n"), F.col("y"), F.col("x")
    level = F.ln(F.greatest(F.col("sy") / F.col("sw"), F.lit(1e-3))) - F.col("b") * F.col("sx") / F.col("sw")
    lines = _start_sums(rows, keys).select(*keys, level.alias("a"), "b")
    if phi_by is None:
        return stored(lines.withColumns({"phi": F.lit(1.0), "zi": F.lit(zi)}))
    lines = stored(lines)
    mu = F.exp(F.col("a") + F.col("b") * x)
    scored = join_on(rows, lines, keys).withColumn("mu", mu)
    square = F.pow(y - F.col("mu"), 2)
    sums = scored.groupBy(*keys).agg(
        F.max("a").alias("a"), F.max("b").alias("b"), F.sum(n * square).alias("ss"),
        F.sum(n * F.col("mu")).alias("s1"), F.sum(n * F.col("mu") * F.col("mu")).alias("s2"),
    )
    total = lambda c: F.sum(c).over(over(phi_by))
    excess = total("ss") - total("s1")
    guess = F.try_divide(excess, total("s1")) if family == "nb1" else F.try_divide(total("s2"), excess)
    start = F.when(excess > 0, F.greatest(F.lit(1e-3), F.least(F.lit(1e3), guess))).otherwise(1.0 if family == "nb1" else 100.0)
    return stored(sums.select(*keys, "a", "b", F.coalesce(start, F.lit(1.0)).alias("phi"), F.lit(zi).alias("zi")))


def over(keys: Sequence[str] | None):
    """A window over cells (one row each) that share ``keys``; without keys over all cells."""
    return Window.partitionBy(*(keys or []))


def with_linear_predictor(rows: DataFrame, coef: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = join_on(rows, coef.select(*keys, "a", "b", "phi", "zi"), list(keys))
    return joined.withColumn("eta", F.col("a") + F.col("b") * F.col("x"))


@lru_cache
def _zero_share(family: str) -> Column:
    p0 = families.zero_probability(family, F.col("mu"), F.col("phi"))
    share = F.coalesce(F.try_divide("zi", F.col("zi") + (1 - F.col("zi")) * p0), F.lit(0.0))
    return F.when(F.col("y") == 0, share).otherwise(0.0)


def with_zero_share(df: DataFrame, family: str) -> DataFrame:
    """``z``: probability that a zero row comes from the structural-zero part."""
    return df.withColumn("z", _zero_share(family))


@lru_cache
def _sum_columns() -> list[Column]:
    x, weight = F.col("x"), F.col("weight")
    term = {
        "u0": F.col("d1"), "u1": F.col("d1") * x,
        "o00": F.col("obs"), "o01": F.col("obs") * x, "o11": F.col("obs") * x * x,
        "e00": F.col("w"), "e01": F.col("w") * x, "e11": F.col("w") * x * x,
        "up": F.col("up"), "hp": F.col("hp"), "c0": -F.col("cp"), "c1": -F.col("cp") * x,
    }
    return [
        *[F.sum(weight * c).alias(f"s_{k}") for k, c in term.items()],
        *[F.max(c).alias(c) for c in ("a", "b", "phi", "zi")],
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("y")).alias("total"),
        F.sum(F.col("n") * F.col("z")).alias("s_z"),
    ]


def cell_sums(scored: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Score and information sums per cell beside its current parameters."""
    return scored.groupBy(*keys).agg(*_sum_columns(), *extra)


@lru_cache
def _step_columns(has_slope: bool, phi_by: tuple | None, zi_by: tuple | None) -> list[dict[str, Column]]:
    """One joint Newton step: 2×2 blocks per cell, log phi by their Schur complement."""
    col = F.col
    steps: list[dict[str, Column]] = []
    o_det = col("s_o00") * col("s_o11") - col("s_o01") * col("s_o01")
    # Observed information where it is well above the quasi information, else the latter.
    good = col("s_o00") > 0.3 * col("s_e00")
    if has_slope:
        good = good & (col("s_o11") > 0.3 * col("s_e11")) & (o_det > 1e-9 * col("s_o00") * col("s_o11"))
    steps.append({f"j{i}": F.when(good, col(f"s_o{i}")).otherwise(col(f"s_e{i}")) for i in ("00", "01", "11")})
    j00, j01, j11 = col("j00"), col("j01"), col("j11")
    det = j00 * j11 - j01 * j01
    full = (det > 1e-9 * j00 * j11) if has_slope else F.lit(False)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    first = lambda p, q: F.when(full, F.try_divide(j11 * p - j01 * q, det)).otherwise(zero(F.try_divide(p, j00)))
    second = lambda p, q: F.when(full, F.try_divide(j00 * q - j01 * p, det)).otherwise(0.0)
    u, c = (col("s_u0"), col("s_u1")), (col("s_c0"), col("s_c1"))
    steps.append({"da": first(*u), "db": second(*u), "ga": first(*c), "gb": second(*c)})
    if phi_by is not None:
        group = over(phi_by)
        up = F.sum(col("s_up") - c[0] * col("da") - c[1] * col("db")).over(group)
        info = F.sum(-col("s_hp") - c[0] * col("ga") - c[1] * col("gb")).over(group)
        steps.append({"move": F.when(info > 0, F.try_divide(up, info)), "lean": F.signum(F.sum("s_up").over(group))})
        # Far from the solution phi moves by itself and the lines take their own step.
        steps.append({"joint": F.coalesce(F.abs("move") <= 1, F.lit(False))})
        steps.append({"dphi": F.when(col("joint"), col("move")).otherwise(col("lean") * 0.7)})
        tied = F.when(col("joint"), col("dphi")).otherwise(0.0)
        steps.append({"da": col("da") - col("ga") * tied, "db": col("db") - col("gb") * tied})
    largest = F.greatest(F.abs("da"), F.abs("db"))
    empty = col("total") <= 0
    factor = F.when(empty & (col("a") <= FLOOR), 0.0).when(largest > 1, 1 / largest).otherwise(1.0)
    steps.append({"factor": factor, "step": F.when(empty, 0.0).otherwise(largest)})
    steps.append({"a": col("a") + col("factor") * col("da"), "b": col("b") + col("factor") * col("db")})
    if phi_by is not None:
        moved = F.greatest(F.lit(1e-6), F.least(F.lit(1e6), col("phi") * F.exp("dphi")))
        held = (col("phi") <= 1e-6) | (col("phi") >= 1e6)
        steps.append({"step": F.greatest("step", F.when(held, 0.0).otherwise(F.abs("dphi"))), "phi": moved})
    if zi_by is not None:
        share = F.sum("s_z").over(over(zi_by)) / F.sum("n").over(over(zi_by))
        steps.append({"zi_new": share})
        steps.append({"step": F.greatest("step", F.abs(col("zi_new") - col("zi"))), "zi": col("zi_new")})
    return steps


def advance(sums: DataFrame, keys: list[str], phi_by, zi_by, has_slope: bool) -> DataFrame:
    """One Newton step of the cell lines, of log phi per group and of the zero share."""
    as_key = lambda by: None if by is None else tuple(by)
    for step in _step_columns(has_slope, as_key(phi_by), as_key(zi_by)):
        sums = sums.withColumns(step)
    return sums.select(*keys, "a", "b", "phi", "zi", "step")


def fit_cells(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    x: str | None = None,
    family: str = "poisson",
    phi_by: Sequence[str] | None = (),
    zi_by: Sequence[str] | None = None,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    weight: str | None = None,
) -> CellFit:
    """Maximum likelihood for intercept (and slope) per cell, a dispersion per ``phi_by``
    group and, with ``zi_by``, a structural-zero share per group (by EM).

    ``weight`` counts equal rows, so zeros may stay implicit (``sparse.weighted_counts``). ``phi_by`` and
    ``zi_by`` are subsets of ``keys``. Many models are fitted in one pass by
    putting their key into all three.
    """
    keys = list(keys)
    phi_by = None if family == "poisson" else list(phi_by or [])
    zi_by = None if zi_by is None else list(zi_by)
    rows = checkpointed(model_rows(df, keys, y, x, weight))
    coef = starting_values(rows, keys, family, phi_by, 0.0 if zi_by is None else 0.1)
    done, iteration = False, 0
    while iteration < max_iterations and not done:
        scored = families.with_derivatives(with_linear_predictor(rows, coef, keys), family)
        scored = with_zero_share(scored, family).withColumn("weight", F.col("n") * (1 - F.col("z")))
        coef, step = stored_with_max(advance(cell_sums(scored, keys), keys, phi_by, zi_by, x is not None), "step")
        iteration += 1
        done = step < tolerance
    fit = CellFit(family, keys, x is not None, coef, phi_by, zi_by)
    _with_information(fit, rows)
    fit.stats.update(iterations=iteration, converged=bool(done))
    return fit


def _with_information(fit: CellFit, rows: DataFrame) -> None:
    """Standard errors, log-likelihood and parameter counts at the solution.

    Blocks are the inverse observed information per cell. Where phi is not orthogonal to
    the means (nb1) its estimation adds the rank-one part ``load load'``. With a zero part
    the blocks ignore its uncertainty; see ``sandwich`` for standard errors that do not.
    """
    keys, family = fit.keys, fit.family
    scored = families.with_derivatives(with_linear_predictor(rows, fit.coef, keys), family)
    scored = with_zero_share(scored, family)
    ll = families.loglik(family, F.col("y"), F.col("mu"), F.col("phi"))
    mixed = F.ln((1 - F.col("zi")) * F.exp(ll) + F.when(F.col("y") == 0, F.col("zi")).otherwise(0.0))
    scored = scored.withColumn("ll", F.when(F.col("zi") > 0, mixed).otherwise(ll) if fit.zi_by is not None else ll)
    scored = scored.withColumn("weight", F.col("n") * (1 - F.col("z")))
    both = cell_sums(scored, keys, F.sum(F.col("n") * F.col("ll")).alias("loglik"))
    o00, o01, o11 = (F.col(f"s_o{i}") for i in ("00", "01", "11"))
    det = o00 * o11 - o01 * o01
    usable = F.col("total") > 0
    if fit.has_slope:
        usable = usable & (det > 1e-9 * o00 * o11)
        blocks = {"v00": o11 / det, "v01": -o01 / det, "v11": o00 / det}
    else:
        blocks = {"v00": 1 / o00, "v01": F.lit(0.0), "v11": F.lit(0.0)}
    both = both.withColumns({k: F.when(usable, v) for k, v in blocks.items()})
    if family == "nb1":
        c0, c1 = F.col("s_c0"), F.col("s_c1")
        both = both.withColumns(
            {"g0": F.col("v00") * c0 + F.col("v01") * c1, "g1": F.col("v01") * c0 + F.col("v11") * c1}
        )
        lost = F.sum(F.coalesce(c0 * F.col("g0") + c1 * F.col("g1"), F.lit(0.0))).over(over(fit.phi_by))
        left = -F.sum("s_hp").over(over(fit.phi_by)) - lost
        both = both.withColumn("schur", left)
        scale = F.when(F.col("schur") > 0, 1 / F.sqrt("schur"))
        both = both.withColumns({"load0": F.col("g0") * scale, "load1": F.col("g1") * scale})
    else:
        both = both.withColumns({"load0": F.lit(0.0), "load1": F.lit(0.0)})
    fit.coef = stored(
        both.select(*keys, "a", "b", "phi", "zi", "v00", "v01", "v11", "load0", "load1", "n", "total", "loglik",
                    F.greatest(F.abs("s_u0"), F.abs("s_u1")).alias("score"), usable.alias("definite"))
    )
    slopes = 2 if fit.has_slope else 1
    groups = lambda by: 0 if by is None else (1 if not by else fit.coef.select(*by).distinct().count())
    row = fit.coef.agg(F.sum("loglik"), F.sum("n"), F.count(F.lit(1)), F.max("score")).first()
    n_par = slopes * row[2] + groups(fit.phi_by) + groups(fit.zi_by)
    fit.stats = {"loglik": row[0], "n_obs": row[1], "n_par": n_par, "max_score": row[3], "aic": -2 * row[0] + 2 * n_par}


def fitted_rows(df: DataFrame, fit: CellFit, y: str | None = None, x: str | None = None) -> DataFrame:
    """Rows with mu (count part), the mean including the zero part, and phi."""
    x_col = F.col(x).cast("double") if x else F.lit(0.0)
    coef = fit.coef.select(*fit.keys, "a", "b", "phi", "zi")
    joined = join_on(df, coef, fit.keys)
    mu = F.exp(F.col("a") + F.col("b") * x_col)
    return joined.withColumn("mu", mu).withColumn("mean", (1 - F.col("zi")) * F.col("mu")).drop("a", "b")


def predict(fit: CellFit, grid: DataFrame, x: str | None = None) -> DataFrame:
    """Link, standard error, conditional mean with its band, and mean including zeros."""
    x_col = F.col(x).cast("double") if x else F.lit(0.0)
    joined = join_on(grid, fit.coef.drop("n", "total", "loglik", "score", "definite"), fit.keys)
    link = F.col("a") + F.col("b") * x_col
    load = F.col("load0") + F.col("load1") * x_col
    var = F.col("v00") + 2 * x_col * F.col("v01") + x_col * x_col * F.col("v11") + load * load
    known = F.col("v00").isNotNull()  # an all-zero cell has no finite link
    joined = joined.withColumns({"link": F.when(known, link), "link_se": F.sqrt(var)})
    band = BAND_Z * F.col("link_se")
    return joined.select(
        *grid.columns, "link", "link_se",
        F.exp("link").alias("conditional_mean"),
        F.exp(F.col("link") - band).alias("lower"),
        F.exp(F.col("link") + band).alias("upper"),
        ((1 - F.col("zi")) * F.exp("link")).alias("mean"),
    )


def coefficients(fit: CellFit, model_by: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Long coefficients (model, term, cell keys, estimate, se, df); df is infinite, so z."""
    name = interaction_key(list(model_by)) if model_by else F.lit(model)
    cell = interaction_key([k for k in fit.keys if k not in model_by])
    se = lambda i: F.sqrt(F.col(f"v{i}{i}") + F.col(f"load{i}") * F.col(f"load{i}"))
    known = F.col("total") > 0  # the intercept of an all-zero cell is a bound of the search, not an estimate
    entry = lambda part, est, s: F.struct(F.lit(part).alias("part"), F.when(known, est).alias("estimate"), s.alias("se"))
    parts = [entry("intercept", F.col("a"), se(0))] + ([entry("slope", F.col("b"), se(1))] if fit.has_slope else [])
    out = fit.coef.select(*fit.keys, name.alias("model"), cell.alias("cell"), F.inline(F.array(*parts)))
    return out.withColumns({"term": F.concat_ws(":", "cell", "part"), "df": F.lit(float("inf"))})


def covariance(fit: CellFit, model_by: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Long covariance (model, term_i, term_j, value): blocks, plus products of loadings
    inside a dispersion group where the family needs them. A fit that holds the covariance of all its
    parameters gives that one."""
    if getattr(fit, "vcov", None) is not None:
        if list(model_by) != fit.model_by:
            raise ValueError(f"the fit has one model per {fit.model_by}")
        return fit.vcov.select("model", "term_i", "term_j", "value")
    name = interaction_key(list(model_by)) if model_by else F.lit(model)
    cell = interaction_key([k for k in fit.keys if k not in model_by])
    base = fit.coef.withColumns({"model": name, "cell": cell})
    t = lambda part: F.concat_ws(":", "cell", F.lit(part))
    entry = lambda i, j, v: F.struct(t(i).alias("term_i"), t(j).alias("term_j"), v.alias("value"))
    cells = [entry("intercept", "intercept", F.col("v00"))]
    if fit.has_slope:
        cells += [
            entry("intercept", "slope", F.col("v01")), entry("slope", "intercept", F.col("v01")), entry("slope", "slope", F.col("v11")),
        ]
    blocks = base.select("model", F.inline(F.array(*cells)))
    if fit.family != "nb1":
        return blocks
    loads = [F.struct(t("intercept").alias("term"), F.col("load0").alias("load"))]
    if fit.has_slope:
        loads.append(F.struct(t("slope").alias("term"), F.col("load1").alias("load")))
    group = interaction_key(list(fit.phi_by)) if fit.phi_by else F.lit("all")
    long = base.select("model", group.alias("grp"), F.inline(F.array(*loads)))
    left = long.select("model", "grp", F.col("term").alias("term_i"), F.col("load").alias("li"))
    right = long.select("model", "grp", F.col("term").alias("term_j"), F.col("load").alias("lj"))
    products = left.join(right, ["model", "grp"]).select("model", "term_i", "term_j", (F.col("li") * F.col("lj")).alias("value"))
    return blocks.unionByName(products).groupBy("model", "term_i", "term_j").agg(F.sum("value").alias("value"))


# --- dispersion at given means ----------------------------------------------------------


def fit_dispersion(
    rows: DataFrame, family: str, by: Sequence[str] = (), candidates: int = 24, tolerance: float = 1e-8, max_rounds: int = 100
) -> DataFrame:
    """Dispersion per group for rows (by, mu, y, n) by profile likelihood.

    One pass evaluates a grid of candidates over the rows, Newton steps in log phi follow until
    no group moves by ``tolerance``; groups whose likelihood keeps rising to a bound of phi
    (1e-8, 1e8) rest there. Raises if ``max_rounds`` are not enough.
    """
    by = list(by)
    keyed = checkpointed(rows.select(*by, "mu", "y", "n"))
    grid = F.array(*[F.lit(10.0 ** (-3 + 6 * i / (candidates - 1))) for i in range(candidates)])
    ll = families.loglik(family, F.col("y"), F.col("mu"), F.col("phi"))
    profile = keyed.withColumn("phi", F.explode(grid)).groupBy(*by, "phi").agg(F.sum(F.col("n") * ll).alias("ll"))
    current = stored(profile.groupBy(*by).agg(F.max_by("phi", "ll").alias("phi")))
    for _ in range(max_rounds):
        joined = join_on(keyed, current.select(*by, "phi"), by) if by else keyed.withColumn("phi", current.select("phi").scalar())
        scored = families.with_derivatives(joined.withColumn("eta", F.ln("mu")).drop("mu"), family)
        ll = families.loglik(family, F.col("y"), F.col("mu"), F.col("phi"))
        sums = scored.groupBy(*by).agg(
            F.max("phi").alias("phi"), F.sum(F.col("n") * F.col("up")).alias("u"), F.sum(F.col("n") * F.col("hp")).alias("h"),
            F.sum(F.col("n") * ll).alias("loglik"), F.sum("n").alias("n"),
        )
        move = F.when(F.col("h") < 0, -F.col("u") / F.col("h")).otherwise(F.signum("u") * 0.5)
        move = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), move))
        new = F.greatest(F.lit(1e-8), F.least(F.lit(1e8), F.col("phi") * F.exp(move)))
        moved = F.abs(F.ln(new / F.col("phi")))
        current, largest = stored_with_max(sums.select(*by, new.alias("phi"), moved.alias("step"), "loglik", "n"), "step")
        if largest is None or largest < tolerance:
            return current
    raise RuntimeError(f"dispersion still moves by {largest} after {max_rounds} rounds")


# --- comparison --------------------------------------------------------------------------


def compare(spark, fits: dict[str, CellFit]) -> DataFrame:
    """AIC table with the smallest value marked."""
    rows = [(name, f.family, f.stats["loglik"], int(f.stats["n_par"]), f.stats["aic"]) for name, f in fits.items()]
    best = min(r[4] for r in rows)
    rows = [(*r, r[4] - best, r[4] == best) for r in rows]
    schema = "model string, family string, loglik double, n_par bigint, aic double, delta_aic double, best boolean"
    return literal_frame(spark, rows, schema)


def fit_summary(spark, fits: dict[str, CellFit]) -> DataFrame:
    """Health of every fit: convergence, definite information, boundary, dispersion."""
    parts = []
    for name, f in fits.items():
        row = f.coef.agg(
            F.lit(name).alias("model"),
            F.lit(f.stats["converged"]).alias("converged"),
            F.lit(f.stats["iterations"]).alias("iterations"),
            F.max("score").alias("max_score"),
            F.min("definite").alias("positive_definite"),
            F.min("phi").alias("dispersion_min"),
            F.max("phi").alias("dispersion_max"),
            F.max((F.col("phi") <= 1e-6) | (F.col("phi") >= 1e6)).alias("at_boundary"),
            F.lit(float(f.stats.get("sigma", 0.0))).alias("cluster_sd"),
            F.lit(float(f.stats["loglik"])).alias("loglik"),
        )
        parts.append(row)
    return reduce(lambda a, b: a.unionByName(b), parts)


def log_rmse(df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    error = F.pow(F.log1p(observed) - F.log1p(predicted), 2)
    return df.groupBy(*by).agg(F.sqrt(F.avg(error)).alias("log_rmse"))


def compare_errors(errors: DataFrame, model: str, baseline: str) -> DataFrame:
    """Percent difference of each model's error from the named baseline model."""
    base = errors.where(F.col(model) == baseline).select("log_rmse").scalar()
    return errors.withColumn("difference_pct", 100 * (F.col("log_rmse") - base) / base)
