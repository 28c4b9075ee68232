"""Order of things that depend on each other: nodes (name, ord) and dependencies (name, needs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions.numbering import placed
from basalt.functions.lineage import cut


def missing(nodes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Dependencies on names that are not there."""
    return dependencies.join(nodes.select(F.col("name").alias("needs")), "needs", "left_anti")


def repeated(nodes: DataFrame) -> DataFrame:
    """Names that occur more than once."""
    return nodes.groupBy("name").count().filter("count > 1").select("name")


def levels(nodes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """name, level and place: each after all that it needs; equal levels in the order in which their last need was released.

    Names without an open need are peeled off in turn, however many turns it takes: each looks only at
    the names that the last one released. ``ValueError`` if a circle is left. Joins are merged, since
    at any number of levels a side that is broadcast at each would go through the driver at each.
    """
    needs, waiting = cut(dependencies.select("name", "needs").distinct()), nodes.count()
    free = nodes.select("name", "ord", F.lit(None).cast("long").alias("by")).join(needs.select("name").hint("merge"), "name", "left_anti")
    done, base, level = [], 0, 0
    while waiting:
        ready = placed(free, F.asc_nulls_first("by"), "ord").select("name", F.lit(level).alias("level"), (F.col("place") + base).alias("place"))
        ready = cut(ready)
        n = ready.count()
        if not n:
            raise ValueError("circular dependency")
        done.append(ready)
        base, waiting, level = base + n, waiting - n, level + 1
        if not waiting:
            break
        met = needs.join(ready.select(F.col("name").alias("needs"), "place").hint("merge"), "needs").groupBy("name").agg(F.max("place").alias("by"))
        needs = cut(needs.join(ready.select(F.col("name").alias("needs")).hint("merge"), "needs", "left_anti"))
        free = met.join(needs.select("name").hint("merge"), "name", "left_anti").join(nodes.select("name", "ord").hint("merge"), "name")
    none = nodes.select("name", F.lit(0).alias("level"), F.lit(0).cast("long").alias("place")).limit(0)
    return reduce(DataFrame.unionByName, done, none)
