"""Curves through nodes: natural cubic splines, monotone Hermite curves and Catmull-Rom curves.

A curve is a polynomial of the third degree between every two nodes. It becomes one SQL expression,
so that it runs inside generated code, or a numpy function.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from ..plans.layers import num

Nodes = Sequence[tuple[float, float]]
CUBIC, CATMULL_ROM, MONOTONE = "cubic", "catmull-rom", "monotone"


def _checked(nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    x, y = (np.array(v, float) for v in zip(*nodes, strict=True))
    if len(x) < 2 or (np.diff(x) <= 0).any():
        raise ValueError("a curve needs two nodes or more, from left to right")
    return x, y


def slopes(nodes: Nodes, kind: str) -> np.ndarray:
    """The tangents of a Hermite curve at its nodes."""
    x, y = _checked(nodes)
    secant = np.diff(y) / np.diff(x)
    if kind == CATMULL_ROM:
        inner = (y[2:] - y[:-2]) / (x[2:] - x[:-2])
        return np.concatenate([secant[:1], inner, secant[-1:]])
    m = np.concatenate([secant[:1], (secant[1:] + secant[:-1]) / 2, secant[-1:]])
    for i, d in enumerate(secant):  # keep every piece inside the circle in which it stays monotone
        if abs(d) < 1e-9:
            m[i] = m[i + 1] = 0.0
            continue
        reach = math.hypot(m[i] / d, m[i + 1] / d)
        if reach > 3:
            m[i], m[i + 1] = m[i] * 3 / reach, m[i + 1] * 3 / reach
    return m


def pieces(nodes: Nodes, kind: str = MONOTONE) -> list[tuple[float, tuple[float, float, float, float]]]:
    """(start, coefficients by rising power of the distance from it) of each polynomial."""
    x, y = _checked(nodes)
    h = np.diff(x)
    if kind == CUBIC:
        n = len(x)
        system, right = np.eye(n), np.zeros(n)  # the second derivatives; none at the ends
        for i in range(1, n - 1):
            system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            right[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        c = np.linalg.solve(system, right)
        return [(x[i], (y[i], (y[i + 1] - y[i]) / h[i] - h[i] * (2 * c[i] + c[i + 1]) / 6, c[i] / 2, (c[i + 1] - c[i]) / (6 * h[i]))) for i in range(n - 1)]
    m = slopes(nodes, kind)
    return [(x[i], (y[i], m[i], (3 * (y[i + 1] - y[i]) / h[i] - 2 * m[i] - m[i + 1]) / h[i], (m[i] + m[i + 1] - 2 * (y[i + 1] - y[i]) / h[i]) / h[i] ** 2)) for i in range(len(h))]


def evaluate(nodes: Nodes, at, kind: str = MONOTONE) -> np.ndarray:
    """Values, bounded to [0, 1]; beyond the outer nodes those of the outer nodes."""
    x, _ = _checked(nodes)
    v = np.clip(np.asarray(at, float), x[0], x[-1])
    parts = pieces(nodes, kind)
    i = np.clip(np.searchsorted(x, v, side="right") - 1, 0, len(parts) - 1)
    start, k = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    t = v - start[i]
    return np.clip(k[i, 0] + t * (k[i, 1] + t * (k[i, 2] + t * k[i, 3])), 0, 1)


def expression(nodes: Nodes, column: str, kind: str = MONOTONE) -> str:
    """SQL of ``evaluate`` on a column."""
    x, y = _checked(nodes)
    parts = pieces(nodes, kind)
    cases = [f"WHEN {column} <= {num(float(x[0]))} THEN {num(float(y[0]))}"]
    for i, (start, k) in enumerate(parts):
        t = f"({column} - {num(float(start))})"
        poly = f"{num(float(k[0]))} + {t} * ({num(float(k[1]))} + {t} * ({num(float(k[2]))} + {t} * {num(float(k[3]))}))"
        cases.append(f"WHEN {column} <= {num(float(x[i + 1]))} THEN {poly}")
    return f"least(greatest(CASE {' '.join(cases)} ELSE {num(float(y[-1]))} END, {num(0.0)}), {num(1.0)})"


def beyond(value, last: float) -> tuple[float, float, float]:
    """(x, y, g) of the power law y * (v / x) ** g that goes on past ``last``: it meets ``value`` there, with the mean exponent of three places before."""
    y = float(value(last))
    found = [math.log(v / y) / math.log(s) for s in (0.7, 0.8, 0.9) if (v := float(value(s * last))) > 0 and y > 0]
    return last, y, sum(found) / len(found) if found else 1.0


def unbounded(nodes: Nodes, column: str, kind: str = MONOTONE) -> str:
    """SQL of a curve on a column, going on past its last node by a power law."""
    last, y, g = beyond(lambda v: evaluate(nodes, v, kind), float(nodes[-1][0]))
    return f"CASE WHEN {column} < {num(last)} THEN {expression(nodes, column, kind)} ELSE {num(y)} * power({column} / {num(last)}, {num(g)}) END"
