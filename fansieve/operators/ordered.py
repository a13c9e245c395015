"""Ordered scans that stay balanced when one key holds a large share of the rows.

A plain window puts every row of a key into one task. Here the rows are range-partitioned by
(key, order), so a heavy key is cut into several pieces. Each piece is scanned by its own window
group, and what a piece needs from the pieces before or after it is carried over in a table that
has fewer rows than there are pieces. A table of at most ``ROWS_PER_PIECE`` rows is one piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fansieve.session import BROADCAST_BYTES, durable, table_bytes

PIECE = "_piece"
ROWS_PER_PIECE = 500_000
MAX_PIECES = 10_000

_EARLIER = (Window.unboundedPreceding, -1)
_THROUGH = (Window.unboundedPreceding, 0)


def pieces_for(df: DataFrame) -> int:
    return min(MAX_PIECES, max(1, -(-df.count() // ROWS_PER_PIECE)))


@dataclass
class Laid:
    """Rows cut into pieces, each a contiguous range of (keys, order). ``order`` must be unique per key."""

    df: DataFrame
    keys: Sequence[str]
    order: Sequence[str]
    pieces: int

    def rows(self) -> DataFrame:
        return self.df.drop(PIECE)

    def with_column(self, name: str, value: Column) -> Laid:
        return replace(self, df=self.df.withColumn(name, value))

    def _carried(self, scanned: DataFrame, summary: Column, over_pieces) -> DataFrame:
        """Add ``_carry``: a value from the key's other pieces, NULL if there is none."""
        if self.pieces == 1:
            return scanned.withColumn("_carry", F.lit(None).cast(scanned.schema["_in"].dataType))
        across = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))
        carry = (
            scanned.groupBy(PIECE, *self.keys)
            .agg(summary.alias("_summary"))
            .withColumn("_carry", over_pieces(F.col("_summary"), across.orderBy(PIECE)))
            .where("_carry IS NOT NULL")
            .drop("_summary")
        )
        # At most one key crosses each piece border, so `carry` has fewer rows than there are pieces.
        same = F.col(f"l.{PIECE}") == F.col(f"r.{PIECE}")
        for k in self.keys:
            same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        joined = scanned.alias("l").join(F.broadcast(carry.alias("r")), same, "left")
        return joined.select("l.*", "r._carry")

    def _scan(self, name: str, value: Column, inside, summary, over_pieces, combine: Column) -> Laid:
        w = Window.partitionBy(PIECE, *self.keys).orderBy(*self.order)
        scanned = self.df.withColumn("_v", value).withColumn("_in", inside(F.col("_v"), w))
        out = self._carried(scanned, summary, over_pieces).withColumn(name, combine)
        return replace(self, df=out.drop("_v", "_in", "_carry"))

    def max_before(self, name: str, value: Column) -> Laid:
        """Largest ``value`` over the earlier rows of the key, NULL if there are none."""
        return self._scan(
            name,
            value,
            lambda v, w: F.max(v).over(w.rowsBetween(*_EARLIER)),
            F.max("_v"),
            lambda v, w: F.max(v).over(w.rowsBetween(*_EARLIER)),
            F.greatest("_in", "_carry"),
        )

    def sum_through(self, name: str, value: Column) -> Laid:
        """Running sum of ``value`` over the key, this row included."""
        return self._scan(
            name,
            value,
            lambda v, w: F.sum(v).over(w.rowsBetween(*_THROUGH)),
            F.sum("_v"),
            lambda v, w: F.sum(v).over(w.rowsBetween(*_EARLIER)),
            F.col("_in") + F.coalesce("_carry", F.lit(0)),
        )

    def next_row(self, name: str, value: Column) -> Laid:
        """``value`` of the key's next row, NULL at the last one. ``value`` itself must not be NULL."""
        return self._scan(
            name,
            value,
            lambda v, w: F.lead(v).over(w),
            F.min_by("_v", F.struct(*self.order)),
            lambda v, w: F.lead(v).over(w),
            F.coalesce("_in", "_carry"),
        )


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> Laid:
    """Cut the rows into balanced pieces.

    All readers of a piece must see the same piece number, so several pieces are a written table.
    """
    if pieces is None:
        df = durable(df)  # counted and then read again
        pieces = pieces_for(df)
    if pieces == 1:
        return Laid(df.withColumn(PIECE, F.lit(0)), keys, order, 1)
    cut = df.repartitionByRange(pieces, *keys, *order).withColumn(PIECE, F.spark_partition_id())
    return Laid(durable(cut), keys, order, pieces)


def numbered(df: DataFrame, order: Sequence[str], name: str, first: int = 1, pieces: int | None = None) -> DataFrame:
    """Number all rows from ``first`` in the given total order; only a small table is one task's work."""
    one = F.lit(1).cast("bigint")
    return lay_out(df, [], order, pieces).sum_through(name, one).with_column(name, F.col(name) + F.lit(first - 1)).rows()


def lookup(
    rows: DataFrame,
    reference: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    broadcast_limit: int = BROADCAST_BYTES,
    salts: int | None = None,
) -> DataFrame:
    """Join many rows to a reference table when a few keys may own most of the rows.

    A reference table of a checked size is broadcast. A larger one is repeated once per salt, and
    the rows of each key are spread over the salts by ``spread_by``, columns that tell rows apart.
    """
    if table_bytes(reference) <= broadcast_limit:
        return rows.join(F.broadcast(reference), list(on), how)
    salts = salts or max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = reference.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")
