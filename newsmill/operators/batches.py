"""First-seen de-duplication of one batch on two keys.

A row dropped for one key doesn't register its other key, so the rule is a fold in order.  Rows that are first on all
their keys are kept, rows sharing a key with a kept one go, and the rest is decided in further rounds; only chains of
mixed keys need more than one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, hot_join, hot_keys


def first_seen(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """(order, kept boolean) of (order, keys...): whether a row is kept.  ``order`` is unique; a null key identifies
    nothing; rows without keys are kept; an empty table gives an empty result."""
    long = cut(rows.select(order, F.explode(F.array(*[F.struct(F.lit(i).alias("__f"), F.col(k).cast("string").alias("__k")) for i, k in enumerate(keys)])).alias("e")).select(order, "e.*").where("__k is not null"))
    sizes = cut(long.groupBy("__f", "__k").agg(F.min(order).alias("__first"), F.count("*").alias("__n")))
    hot = hot_keys(sizes, ["__f", "__k"], "__n")
    open_ = cut(hot_join(long, sizes.where("__n > 1"), ["__f", "__k"], order, hot).where("__n is not null").select(order, "__f", "__k", "__first"))
    gone = None
    while True:
        won = open_.groupBy(order).agg(F.max(F.col("__first") < F.col(order)).alias("behind")).where("not behind").select(order)
        held = cut(open_.join(won, order, "left_semi").select("__f", "__k", F.lit(True).alias("held")))
        if held.isEmpty():
            break
        left = open_.join(won, order, "left_anti")
        out = cut(hot_join(left.select(order, "__f", "__k"), held, ["__f", "__k"], order, hot).where("held").select(order).distinct())
        gone = out if gone is None else gone.unionByName(out)
        left = left.join(out, order, "left_anti").select(order, "__f", "__k")
        firsts = left.groupBy("__f", "__k").agg(F.min(order).alias("__first"))
        open_ = cut(hot_join(left, firsts, ["__f", "__k"], order, hot))
    if gone is None:
        return rows.select(order, F.lit(True).alias("kept"))
    return rows.select(order).join(gone.withColumn("gone", F.lit(True)), order, "left").select(order, F.col("gone").isNull().alias("kept"))
