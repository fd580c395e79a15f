"""Expression plans over pixel rows: layers of named SQL expressions.

Every layer reads the columns of the one below. A plan runs as nested selections of one frame,
which Catalyst fuses into a single generated loop, and renders as SQL for any engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


def num(x: float) -> str:
    """A double literal that all dialects read as a double."""
    return f"CAST({x!r} AS DOUBLE)"


def clamp(x: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"least(greatest({x}, {num(low)}), {num(high)})"


@dataclass(frozen=True)
class Plan:
    layers: tuple[tuple[tuple[str, str], ...], ...] = ()

    def let(self, **columns: str) -> Plan:
        return Plan((*self.layers, tuple(columns.items())))

    def then(self, other: Plan) -> Plan:
        return Plan(self.layers + other.layers)

    def apply(self, df: DataFrame) -> DataFrame:
        for layer in self.layers:
            new = dict(layer)
            kept = [f"`{c}`" for c in df.columns if c not in new]
            df = df.selectExpr(*kept, *(f"{e} AS `{n}`" for n, e in layer))
        return df

    def sql(self, source: str, columns: list[str]) -> str:
        for layer in self.layers:
            new = dict(layer)
            source = f"(SELECT {', '.join([c for c in columns if c not in new] + [f'{e} AS {n}' for n, e in layer])} FROM {source})"
            columns = [c for c in columns if c not in new] + list(new)
        return source


def matrix(plan: Plan, m, names=("c0", "c1", "c2"), out=None) -> Plan:
    """Three columns times a 3x3 matrix."""
    return plan.let(**{o: " + ".join(f"{num(w)} * {n}" for w, n in zip(row, names, strict=True)) for o, row in zip(out or names, m, strict=True)})
