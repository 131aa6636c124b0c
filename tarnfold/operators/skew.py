"""Joins whose many side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if more rows hold it than this, and than a thousandth of all; so at most a thousand keys are.
HOT = 10_000
SALT = "__salt"


def salted_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", hot: int = HOT) -> DataFrame:
    """``many`` joined to ``few`` on ``on``; the rows of hot keys are spread over salts, their partners copied.

    ``many`` is read three times, so it should be materialised. The keys' counts are made
    before the shuffle, row by row a salt is its hash, and the list of hot keys is
    bounded by its definition, so it may be broadcast. ``how`` is inner or left.

    Defined results: as the plain join; null keys match nothing and stay unsalted.
    """
    limit = max(hot, many.count() // 1000)
    hot_keys = many.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    hot_keys = F.broadcast(hot_keys.select(*on, F.ceil(F.col("n") / limit).alias("salts")))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    spread = many.join(hot_keys, on, "left").withColumn(SALT, F.pmod(F.xxhash64(*many.columns), salts)).drop("salts")
    copied = few.join(hot_keys, on, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("salts")
    return spread.join(copied, [*on, SALT], how).drop(SALT)
