"""Evaluate-once staging of per-row array expressions.

Higher-order functions evaluate their lambda body once per element. If an array computed in an
earlier projection is referenced inside a lambda, the optimizer may inline its whole defining
expression into the lambda body (a single syntactic reference looks cheap), so a per-row value
would be recomputed per element: quadratic work. ``stage`` puts a one-row generator between
the two projections; it is pipelined in the same codegen stage and costs one struct per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, keep, **exprs: Column) -> DataFrame:
    """``df`` projected to ``keep`` plus the named expressions, each evaluated once per row."""
    keep = [keep] if isinstance(keep, str) else list(keep)
    packed = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select(*keep, F.inline(F.array(packed)))
