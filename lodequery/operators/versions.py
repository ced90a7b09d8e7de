"""Current versions of redelivered and updated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_version(df: DataFrame, key: str, order: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    """One row per ``key``: the greatest by ``order`` (later columns break ties, nulls rank lowest).

    Rows whose key is null belong to no record and are left out. The filter on the row number becomes a
    ``WindowGroupLimit``, so each map task already drops all but one version of a key before the shuffle.
    """
    rank = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.where(F.col(key).isNotNull()).withColumn("_lq_rank", F.row_number().over(rank)).where("_lq_rank = 1").drop("_lq_rank")
