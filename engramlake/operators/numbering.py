"""Places in an order, without any task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, group: str, stretch: Column, order: list[str], target: str, start: DataFrame | None = None) -> DataFrame:
    """``rows`` with their place (from 1) among the rows of their group, in ``order``.

    ``stretch`` cuts a group into numbered pieces that follow its order: rows are placed within
    theirs, behind the counts of the pieces before.  ``start(group, n)`` has counts to begin behind."""
    cut = rows.withColumn("__stretch", stretch)
    per = cut.groupBy(group, "__stretch").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    base = F.coalesce(F.sum("__n").over(before), F.lit(0))
    if start is not None:
        per, base = per.join(start.select(group, F.col("n").alias("__start")), group, "left"), base + F.coalesce("__start", F.lit(0))
    per = per.select(F.col(group).alias("__g"), F.col("__stretch").alias("__s"), base.alias("__before"))
    place = F.row_number().over(Window.partitionBy(group, "__stretch").orderBy(*order))
    out = cut.withColumn("__place", place).join(per, F.col(group).eqNullSafe(F.col("__g")) & F.col("__stretch").eqNullSafe(F.col("__s")))
    return out.select(*rows.columns, (F.col("__before") + F.col("__place")).alias(target))
