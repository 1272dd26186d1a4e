"""Compare two systems' rankings of the same queries by Spearman's rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evaluate


def cross_check(ours: DataFrame, theirs: DataFrame | None, least: int = 3) -> dict:
    """Status, and mean, median, min, max, std and n of rho; `skipped` where there is nothing to compare with."""
    if theirs is None:
        return {"status": "skipped"}
    row = evaluate.spearman_summary(evaluate.spearman(ours, theirs, least)).first()
    return {"status": "ok" if row["n"] else "empty", **row.asDict()}
