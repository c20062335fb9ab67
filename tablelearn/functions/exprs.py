"""Expression helpers that keep generated plans shallow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tree_sum(terms: Sequence[Column]) -> Column:
    """Sum as a balanced tree: depth log2(n) instead of n (fast to analyse)."""
    terms = list(terms)
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        nxt = [terms[i] + terms[i + 1] for i in range(0, len(terms) - 1, 2)]
        if len(terms) % 2:
            nxt.append(terms[-1])
        terms = nxt
    return terms[0]


def dot(cols: Sequence[Column], weights: Sequence[float], bias: float = 0.0) -> Column:
    """bias + sum_j w_j * col_j with literal weights (zero weights skipped)."""
    terms = [F.lit(float(bias))]
    terms += [c * F.lit(float(w)) for c, w in zip(cols, weights) if w != 0.0]
    return tree_sum(terms)


def num(x: float) -> str:
    """A double literal in Spark SQL text."""
    x = float(x)
    if x != x:
        return "CAST('NaN' AS DOUBLE)"
    if x in (float("inf"), float("-inf")):
        return f"CAST('{'-' if x < 0 else ''}Infinity' AS DOUBLE)"
    return f"({x!r}D)"


def sql_sum(terms: Sequence[str]) -> str:
    """Balanced parenthesised sum of SQL terms."""
    terms = list(terms)
    if not terms:
        return "(0.0D)"
    while len(terms) > 1:
        nxt = [f"({terms[i]} + {terms[i + 1]})" for i in range(0, len(terms) - 1, 2)]
        if len(terms) % 2:
            nxt.append(terms[-1])
        terms = nxt
    return terms[0]


def qcol(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
