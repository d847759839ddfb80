"""Join helpers for keys that are not evenly filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_present(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a string key of which many may be null.

    Null keys match nothing, but a shuffle would send them all to one task; here each
    gets a key of its own, which cannot occur on the right.
    """
    spread = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    keyed = left.withColumn("_key", F.coalesce(key, spread))
    return keyed.join(right.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")
