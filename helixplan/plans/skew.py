"""Joins whose one side has hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Most keys that can be hot at once: each has more than ``total / MOST`` rows.
MOST = 50_000


def hot_keys(rows: DataFrame, key: str, total: int, least: int = 256, most: int | None = None) -> DataFrame | None:
    """``(key, salts)`` of the keys with over ``max(least, total / MOST)`` rows; None if there is none (at once if ``most``, the largest number, is known).

    Fewer than ``MOST`` keys can have so many rows, so the table may be broadcast at any size of the input.
    A hot key gets a salt for every so many of its rows, so salts grow with the data.
    """
    bound = max(least, -(-total // MOST))
    if most is not None and most <= bound:
        return None
    found = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > bound).select(key, F.ceil(F.col("n") / bound).cast("int").alias("salts")).collect()
    return rows.sparkSession.createDataFrame(found, f"`{key}` {rows.schema[key].dataType.simpleString()}, salts int") if found else None


def dealt_join(rows: DataFrame, single: DataFrame, key: str, hot: DataFrame | None, spread: Column) -> DataFrame:
    """Inner join of ``rows`` with ``single`` (one row a key); the rows of ``hot`` keys are dealt by ``spread``, a column of ``rows``, and meet a copy of their single row for each salt."""
    if hot is None:
        return rows.join(single, key)
    few, salts = F.broadcast(hot), F.coalesce("salts", F.lit(1))
    dealt = rows.join(few, key, "left").withColumn("salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("salts")
    copies = single.join(few, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copies, [key, "salt"]).drop("salt")
