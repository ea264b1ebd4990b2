"""Batched derivative-free minimisation for likelihood fits on Spark.

An objective over a DataFrame costs one Spark job per *batch* of parameter
vectors (all candidates are evaluated in one pass), so the
optimiser is built to need few rounds: damped Newton steps from a
finite-difference gradient and Hessian (one batch of 1 + 2d + d(d-1)/2
points), then a line search whose step sizes are all evaluated in a second
batch.  Only scalars reach the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class OptimResult:
    x: np.ndarray
    fun: float
    rounds: int
    converged: bool
    history: list = field(default_factory=list)
    #: Names of the coordinates that ended near a bound of the search box.
    at_bound: list = field(default_factory=list)


def _stencil(x: np.ndarray, h: float):
    d = len(x)
    pts = [x.copy()]
    for i in range(d):
        for s in (1, -1):
            p = x.copy()
            p[i] += s * h
            pts.append(p)
    for i in range(d):
        for j in range(i + 1, d):
            p = x.copy()
            p[i] += h
            p[j] += h
            pts.append(p)
    return pts


def _derivs(vals, x, h):
    d = len(x)
    f0 = vals[0]
    fp = np.array([vals[1 + 2 * i] for i in range(d)])
    fm = np.array([vals[2 + 2 * i] for i in range(d)])
    g = (fp - fm) / (2 * h)
    H = np.zeros((d, d))
    for i in range(d):
        H[i, i] = (fp[i] - 2 * f0 + fm[i]) / (h * h)
    k = 1 + 2 * d
    for i in range(d):
        for j in range(i + 1, d):
            fij = vals[k]
            k += 1
            H[i, j] = H[j, i] = (fij - fp[i] - fp[j] + f0) / (h * h)
    return f0, g, H


def batch_minimize(f_batch: Callable[[list[np.ndarray]], list[float]], x0, max_rounds: int = 40,
                   h: float = 1e-4, tol: float = 1e-8, bounds=(-20.0, 20.0), names=None,
                   near: float = 2.0) -> OptimResult:
    """Damped Newton with finite-difference derivatives, one Spark job per
    round in the common case: each batch holds the line-search points *and*
    the derivative stencil around the full Newton step, so when the full step
    is taken (the usual case near the optimum) the next round's derivatives
    are already known.  Coordinates pinned at a bound with the gradient
    pointing outwards are frozen; those that end within ``near`` of a bound are
    listed in ``at_bound`` (by ``names``, else by number)."""
    lo_b, hi_b = bounds
    x = np.clip(np.asarray(x0, dtype=float), lo_b, hi_b)
    d = len(x)

    def clean(vals):
        return [float(v) if v is not None and np.isfinite(v) else np.inf for v in vals]

    history = []
    stencil_vals = clean(f_batch(_stencil(x, h)))
    lam = 1e-6
    converged = False
    steps = [1.0, 0.5, 0.25, 0.1, 0.03]
    fx = stencil_vals[0]
    small = 0
    rounds = 0
    for rounds in range(1, max_rounds + 1):
        f0, g, H = _derivs(stencil_vals, x, h)
        fx = f0
        if not np.all(np.isfinite(g)) or not np.all(np.isfinite(H)):
            g, H = np.nan_to_num(g, posinf=0.0, neginf=0.0), np.eye(d)
        free = ~(((x <= lo_b + 1e-9) & (g > 0)) | ((x >= hi_b - 1e-9) & (g < 0)))
        gp = np.where(free, g, 0.0)
        Hp = H.copy()
        Hp[~free, :] = 0.0
        Hp[:, ~free] = 0.0
        Hp[~free, ~free] = 1.0
        gnorm = float(np.linalg.norm(gp))
        history.append((rounds, f0, gnorm))
        if gnorm < 1e-6:
            converged = True
            break
        for _ in range(30):
            try:
                Hd = Hp + lam * np.eye(d)
                np.linalg.cholesky(Hd)
                p = -np.linalg.solve(Hd, gp)
                break
            except np.linalg.LinAlgError:
                lam = max(lam * 10, 1e-6)
        else:
            p = -gp
        cands = [np.clip(x + s * p, lo_b, hi_b) for s in steps]
        cands.append(np.clip(x - 0.1 * gp / (gnorm + 1e-12), lo_b, hi_b))
        spec = _stencil(cands[0], h)
        vals = clean(f_batch(cands + spec))
        cvals, svals = vals[:len(cands)], vals[len(cands):]
        i = int(np.argmin(cvals))
        if cvals[i] < f0:
            improvement = f0 - cvals[i]
            x = cands[i]
            fx = cvals[i]
            if i == 0:
                stencil_vals = svals
                lam = max(lam / 10, 1e-9)
            else:
                stencil_vals = clean(f_batch(_stencil(x, h)))
                lam *= 2
            small = small + 1 if improvement < tol * max(1.0, abs(f0)) else 0
            if small >= 2:
                converged = True
                break
        else:
            if gnorm < 1e-5 or np.linalg.norm(p) < 1e-10:
                converged = True
                break
            lam *= 100
    edge = [str(names[i] if names else i) for i in range(d) if x[i] <= lo_b + near or x[i] >= hi_b - near]
    return OptimResult(x, float(fx), rounds, converged, history, edge)
