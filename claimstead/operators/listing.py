"""Ordered listings: pages after a cursor, and the page and place of every row of an order."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from claimstead.operators.identity import settle


def after(order: list[str], cursor: dict | Row) -> Column:
    """Rows that come after a cursor (a value for each column of the order, nulls first): later in the first column that differs."""
    same, parts = F.lit(True), []
    for c in order:
        held, value = F.col(c), F.lit(cursor[c])
        later = held.isNotNull() if cursor[c] is None else held > value
        parts.append(same & F.coalesce(later, F.lit(False)))
        same = same & held.eqNullSafe(value)
    return reduce(or_, parts)


def page(rows: DataFrame, order: list[str], size: int, cursor: dict | Row | None = None) -> tuple[DataFrame, dict | None]:
    """The next `size` rows of an order after a cursor, and the cursor of the page after it, None at the end. The order's last column must tell rows apart.

    A keyset page: what lies before the cursor is filtered away, not counted, and each task keeps its first `size` rows. Repeated rows of one key count as one place: take
    keys that are unique.
    """
    left = rows if cursor is None else rows.where(after(order, cursor))
    found = settle(left.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(size))
    last = found.orderBy(*[F.col(c).desc_nulls_last() for c in order]).select(*order).first() if found.count() == size else None
    return found, last and last.asDict()


def pages(rows: DataFrame, order: list[str], size: int, per_range: int = 20_000) -> DataFrame:
    """rows with `place` (from 0) in the whole order and `page`: keys are sorted in ranges over all tasks, and a range counts on from those before it, one number a range."""
    held = settle(rows)
    n = max(1, -(-held.count() // per_range))
    keys = [F.col(c).asc_nulls_first() for c in order]
    sorted_ = held.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    numbered = settle(sorted_.withColumn("_line", F.monotonically_increasing_id()))
    part, line = F.shiftright("_line", 33).alias("_part"), F.col("_line").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    placed = numbered.withColumn("_part", F.shiftright("_line", 33)).join(starts, "_part").withColumn("place", line + F.col("_before"))
    return placed.withColumn("page", F.floor(F.col("place") / size)).drop("_line", "_part", "_before")
