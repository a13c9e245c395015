"""Connected components of pairs, and joins whose one side is small or whose keys are uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fansieve.session import durable

#: Rows of numbers that are sent to every task instead of shuffling the other side.
FEW_ROWS = 1_000_000
#: Values that count as frequent: each has more rows than this share of a table, so there are never more of them; and more than so many rows.
FREQUENT_KEYS, FREQUENT_ROWS = 100_000, 200


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df``, a table of narrow rows that is stored already, to be broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def frequent(df: DataFrame, column: str) -> DataFrame:
    """``(frequent)``: the values that many rows of ``df``, stored, have in ``column``; at most ``FREQUENT_KEYS``."""
    least = max(FREQUENT_ROWS, df.count() // FREQUENT_KEYS)
    counts = df.groupBy(F.col(column).alias("frequent")).agg(F.count("*").alias("n"))
    return durable(counts.where(F.col("frequent").isNotNull() & (F.col("n") > least)).select("frequent"))


def uneven_join(left: DataFrame, right: DataFrame, on: str, key: str, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """``left``, stored, joined with ``right``, narrow rows that have each value of ``key`` once, where ``on`` equals it.

    Values that many rows of ``left`` have would meet in one task each: their rows of ``right``, not more than there are such values, are broadcast
    instead. ``heavy`` are these values if they are known already.
    """
    heavy = frequent(left, on) if heavy is None else heavy
    if not heavy.head(1):
        return left.join(right, F.col(on) == F.col(key), how)
    heavy = F.broadcast(heavy)
    theirs = F.broadcast(right.join(heavy, F.col(key) == F.col("frequent"), "left_semi"))
    many = left.join(heavy, F.col(on) == F.col("frequent"), "left_semi").join(theirs, F.col(on) == F.col(key), how)
    return left.join(heavy, F.col(on) == F.col("frequent"), "left_anti").join(right, F.col(on) == F.col(key), how).unionByName(many)


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``edges(a, b)``, longs: the smallest node that it is connected to.

    Each node points to a smaller one. In each round it looks at where its neighbours' pointers lead in two steps; the smallest of these becomes its own pointer
    and is also offered to the node that it pointed to, so whole groups join at once, and chains of any order take few rounds. Ends when
    no pointer changes. Nodes with very many edges, and pointers that very many nodes share, are broadcast instead of meeting in one task.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    centers = frequent(both, "b")
    pointers = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
    while True:
        second = pointers.select(F.col("node").alias("via"), F.col("to").alias("far"))
        reached = durable(uneven_join(pointers, second, "to", "via").select("node", "to", "far"))
        around = uneven_join(both, reached.select(F.col("node").alias("beside"), F.col("far").alias("its")), "b", "beside", heavy=centers)
        near = around.groupBy(F.col("a").alias("near_node")).agg(F.min("its").alias("near"))
        seen = durable(reached.join(near, F.col("node") == F.col("near_node")).select("node", "to", "far", F.least("far", "near").alias("low")))
        offers = seen.groupBy(F.col("to").alias("offered_to")).agg(F.min("low").alias("offer"))
        new = seen.join(offers, F.col("node") == F.col("offered_to"), "left").select("node", F.least("to", "low", "offer").alias("new"), "to")
        new = durable(new)
        changed = new.where(F.col("new") < F.col("to")).limit(1).count()
        pointers = new.select("node", F.col("new").alias("to"))
        if not changed:
            return pointers.withColumnRenamed("to", "label")
