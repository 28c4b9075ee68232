"""Row numbers in a total order that no single task has to hold all rows for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.lineage import cut

#: Places within a partition take the lower bits of a row's number, partitions the bits above.
BITS = 33


def placed(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """The rows with their place (from 1, a long) in an order.

    Rows are sorted over ranges and stored; a range's first place is the number of rows of the ranges
    before it, of which there is one row each. Equal rows of the order get any of their places.
    """
    rows = cut(df.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()))
    part, own = F.shiftright("at_", BITS), F.col("at_").bitwiseAND((1 << BITS) - 1)
    sizes = rows.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    bases = sizes.selectExpr("part_", "coalesce(sum(n_) over (order by part_ rows between unbounded preceding and 1 preceding), 0L) as base_")
    return rows.join(F.broadcast(bases), part == F.col("part_")).withColumn(name, F.col("base_") + own + 1).drop("at_", "part_", "base_")


def placed_within(df: DataFrame, keys: Sequence[str], *order: Column | str, name: str = "number") -> DataFrame:
    """The rows with their place (from 1, a long) among those of their keys; a key may hold any share of the rows."""
    rows = placed(df, *keys, *order, name="whole_")
    firsts = rows.groupBy(*keys).agg(F.min("whole_").alias("first_"))
    return rows.join(firsts, list(keys)).withColumn(name, F.col("whole_") - F.col("first_") + 1).drop("whole_", "first_")
