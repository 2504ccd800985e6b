"""Normal equations in SQL, for the oracles: a symmetric matrix as rows (i, j, v), swept on its pivots one after another.

After sweeping the feature rows of a Gram matrix, (i, j) of two features is minus the inverse, (i, y) the coefficient of feature i
and (y, y) the residual sum of squares."""

from __future__ import annotations

from collections.abc import Sequence


def gram_sql(columns: Sequence[str], source: str, centred: bool = False) -> str:
    """Rows (i, j, v): sums of products, or of products about the means."""
    cell = "covar_pop({a}, {b}) * count(*)" if centred else "sum({a} * {b})"
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {cell.format(a=a, b=b)} AS v FROM {source}"
                              for i, a in enumerate(columns) for j, b in enumerate(columns))


def swept(first: str, pivots: int, name: str = "w") -> str:
    """CTEs ``{name}1 .. {name}{pivots}`` after ``first``: the matrix swept on its first ``pivots`` rows."""
    out, before = [], first
    for k in range(pivots):
        out.append(f"""{name}{k + 1} AS (
SELECT a.i, a.j, CASE WHEN a.i = {k} AND a.j = {k} THEN -1 / p.v WHEN a.i = {k} OR a.j = {k} THEN a.v / p.v ELSE a.v - r.v * c.v / p.v END AS v
FROM {before} a JOIN {before} p ON p.i = {k} AND p.j = {k} JOIN {before} r ON r.i = a.i AND r.j = {k} JOIN {before} c ON c.i = {k} AND c.j = a.j)""")
        before = f"{name}{k + 1}"
    return ",\n".join(out)
