"""Equi-join that keeps one hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Only the heaviest keys are broadcast, so the broadcast table has a fixed
# size; every other key holds at most 1/MAX_HOT_KEYS of the rows.
MAX_HOT_KEYS = 1000
ROWS_PER_SALT = 100_000
MAX_SALTS = 512


def hot_keys(df: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The heaviest keys and the number of slices each is cut into."""
    return (
        df.groupBy(F.col(key).alias("hot_key"))
        .count()
        .filter(F.col("count") > rows_per_salt)
        .orderBy(F.desc("count"), "hot_key")
        .limit(MAX_HOT_KEYS)
        .select(
            "hot_key",
            F.least(F.ceil(F.col("count") / rows_per_salt), F.lit(MAX_SALTS)).cast("int").alias("salts"),
        )
    )


def salted_join(
    big: DataFrame,
    other: DataFrame,
    key: str,
    *,
    how: str = "inner",
    spread_by: list[str],
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join on `key`, cutting the hot keys of `big` into slices.

    `spread_by` names columns of `big` whose hash picks the slice, so a lost
    task recomputes the same slices. Rows of `other` at a hot key are copied
    once per slice; nothing is dropped on either side.
    """
    hot = F.broadcast(hot_keys(big, key, rows_per_salt))
    slice_no = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.coalesce("salts", F.lit(1)))
    left = (
        big.join(hot, F.col(key) == F.col("hot_key"), "left")
        .withColumn("__slice", slice_no.cast("int"))
        .drop("hot_key", "salts")
    )
    right = (
        other.join(hot, F.col(key) == F.col("hot_key"), "left")
        .withColumn("__slice", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .drop("hot_key", "salts")
    )
    return left.join(right, [key, "__slice"], how).drop("__slice")
