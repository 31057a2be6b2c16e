"""Likelihood terms of rows at several values of their cluster's effect, as numpy arrays.

The formulas are those of ``families`` and ``mixed._effect_steps``; a task computes them for the rows of its own
clusters, so that no row is written once per node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SHIFT = 10


def _shifted(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x + k for k in range(_SHIFT))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma of positive values: Stirling's series ten steps further up."""
    z = x + _SHIFT
    w = 1 / (z * z)
    series = (1 / 12 + w * (-1 / 360 + w * (1 / 1260 + w * (-1 / 1680 + w / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + series - sum(np.log(s) for s in _shifted(x))


def digamma(x: np.ndarray) -> np.ndarray:
    z = x + _SHIFT
    w = 1 / (z * z)
    series = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return np.log(z) - 0.5 / z - series - sum(1 / s for s in _shifted(x))


def trigamma(x: np.ndarray) -> np.ndarray:
    z = x + _SHIFT
    w = 1 / (z * z)
    series = w * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w * (1 / 30 - w * 5 / 66))))
    return 1 / z + 0.5 * w + series / z + sum(1 / (s * s) for s in _shifted(x))


def count_terms(family: str, y: np.ndarray, phi: np.ndarray, eta: np.ndarray) -> dict[str, np.ndarray]:
    """``ll`` and its derivatives of counts ``y`` (rows) at ``eta`` (rows x nodes): d1, obs (d/d eta, minus its
    derivative), w (expected information), up, hp (first, second d/d log phi), cp (cross)."""
    y, phi = y[:, None], phi[:, None]
    eta = np.clip(eta, -30.0, 30.0)
    mu = np.exp(eta)
    if family == "poisson":
        none = np.zeros_like(mu)
        return {"ll": y * eta - mu - lgamma(y + 1), "d1": y - mu, "obs": mu, "w": mu, "up": none, "hp": none, "cp": none}
    if family == "nb2":
        t = mu + phi
        log_t, r = np.log(t), (y + phi) / t
        ll = lgamma(y + phi) - lgamma(phi) + phi * np.log(phi) - lgamma(y + 1) + y * eta - (y + phi) * log_t
        up = phi * (digamma(y + phi) - digamma(phi) + np.log(phi) + 1 - log_t - r)
        obs = r * mu * phi / t
        tri = trigamma(y + phi) - trigamma(phi) + 1 / phi
        return {"ll": ll, "d1": phi * (y - mu) / t, "obs": obs, "w": mu * phi / t, "up": up, "hp": up + phi * phi * (tri - (2 - r) / t), "cp": phi * mu * (y - mu) / (t * t)}
    size, k = mu / phi, 1 + phi
    a, b = digamma(y + size) - digamma(size) - np.log1p(phi), trigamma(y + size) - trigamma(size)
    first = -size / phi * a - size / k + y * (1 / phi - 1 / k)
    second = 2 * size / (phi * phi) * a + size / phi * (b * size / phi + 1 / k) + size / phi / k + size / (k * k) - y / (phi * phi) + y / (k * k)
    return {
        "ll": lgamma(y + size) - lgamma(size) - lgamma(y + 1) - size * np.log1p(phi) + y * (np.log(phi) - np.log1p(phi)),
        "d1": size * a, "obs": -(size * a + size * size * b), "w": mu / k, "up": phi * first, "hp": phi * first + phi * phi * second,
        "cp": phi * (-size / phi * a - size * (b * size / phi + 1 / k)),
    }


def weighted_terms(family: str, rows: dict[str, np.ndarray], eta: np.ndarray, zero_part: bool) -> dict[str, np.ndarray]:
    """The sums' terms of ``mixed._row_terms`` for rows with y, n, x, phi, zi at ``eta`` (rows x nodes)."""
    g = count_terms(family, rows["y"], rows["phi"], eta)
    n, x = rows["n"][:, None], rows["x"][:, None]
    out = {"ll": g["ll"], "s_e": g["d1"], "s_p": g["up"], "i_ee": g["obs"], "i_ep": -g["cp"], "i_pp": -g["hp"]}
    if zero_part:
        zi, zero = rows["zi"][:, None], rows["y"][:, None] == 0
        p0 = np.exp(np.where(zero, g["ll"], -np.inf))
        seen = zi + (1 - zi) * p0
        z = np.where(zero & (seen > 0), zi / np.where(seen > 0, seen, 1.0), 0.0)
        one = 1 - z
        with np.errstate(divide="ignore"):
            out["ll"] = np.where(zero, np.log(seen), np.log1p(-zi) + g["ll"])
        out |= {
            "s_e": one * g["d1"], "s_p": one * g["up"], "s_z": z - zi,
            "i_ee": one * g["obs"] - z * one * g["d1"] * g["d1"], "i_ep": -one * g["cp"] - z * one * g["d1"] * g["up"],
            "i_pp": -one * g["hp"] - z * one * g["up"] * g["up"], "i_ez": z * one * g["d1"], "i_pz": z * one * g["up"], "i_zz": zi * (1 - zi) - z * one,
        }
    out = {name: n * value for name, value in out.items()}
    out |= {"s_x": x * out["s_e"], "i_ex": x * out["i_ee"], "i_xx": x * x * out["i_ee"], "i_xp": x * out["i_ep"]}
    return out | ({"i_xz": x * out["i_ez"]} if zero_part else {})


def unpacked(lists: pa.ListArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fields of a column of lists of structs, one after another, and the length of each list."""
    flat = lists.flatten()
    return {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}, np.diff(lists.offsets.to_numpy())


def repacked(lengths: np.ndarray, fields: dict[str, np.ndarray]) -> pa.ListArray:
    """The reverse of ``unpacked``."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields)))


def members(lengths: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Positions of all entries of the numbered lists, list after list."""
    starts, wanted = np.cumsum(lengths) - lengths, lengths[lists]
    before = np.cumsum(wanted) - wanted
    return np.repeat(starts[lists] - before, wanted) + np.arange(wanted.sum())
