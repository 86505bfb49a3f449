"""Joins against one-row-per-group tables when one group may own much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = 16
_SALT = "__salt"


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    key: str,
    how: str = "left",
    spread_on: Sequence[str] = ("path",),
    spread: int = SPREAD,
) -> DataFrame:
    """Join rows with their group's single row, a group's rows spread over ``spread`` tasks.

    Rows get a salt from their own columns, and the narrow group table is
    repeated once per salt. Runtime skew handling does not cover these joins:
    it stands back when a later aggregate relies on the join's partitioning.
    """
    salted = rows.withColumn(_SALT, F.pmod(F.xxhash64(*spread_on), F.lit(spread)))
    repeated = groups.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))))
    return salted.join(repeated, [key, _SALT], how).drop(_SALT)
