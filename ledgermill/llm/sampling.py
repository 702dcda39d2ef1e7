"""Bounded samples that do not depend on how the rows are dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashes(rows: DataFrame, column: str, n: int) -> list[int]:
    """The ``n`` smallest distinct values of a 64-bit hash column, or all if there are fewer.

    Only values below a bound that about ``4 * n`` rows meet are sorted, so
    what one task merges does not grow with the number of tasks. Where copies
    leave too few, the bound widens.
    """
    total = rows.count()
    share = 4 * n / max(total, 1)
    while True:
        near = rows if share >= 1 else rows.filter(F.col(column) <= int(share * 2.0**64) - 2**63)
        found = [r[0] for r in near.select(column).distinct().orderBy(column).limit(n).collect()]
        if len(found) == n or share >= 1:
            return found
        share *= 4
