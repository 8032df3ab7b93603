"""Ranks and running sums of groups of any size: rows are dealt by ranges of the order, so no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolith.session import cut


def running_sums(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """rows with, for each name of `sums`, the sum of its column over all rows of the group up to and with this one.

    totals: name -> column, summed over the whole group. `by` may be empty. Rows that `order` does not tell apart take any
    order among themselves. Ranges are summed once each; only those sums (one row for each range and group) are put in order.
    A null counts as 0.
    """
    ranged = cut(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*by, "_range").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"_sum_{c}") for c in sorted({*sums.values(), *(totals or {}).values()})])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *by, "_range", *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name, c in sums.items()], *[F.sum(f"_sum_{c}").over(group).alias(name) for name, c in (totals or {}).items()]
    )
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ranged.withColumns({f"_in_{name}": F.sum(F.coalesce(c, F.lit(0))).over(within) for name, c in sums.items()})
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_range"]]
    met = inner.alias("a").join(offsets.alias("b"), same)
    kept = [F.col(f"a.{c}") for c in rows.columns]
    return met.select(*kept, *[(F.col(f"_before_{name}") + F.col(f"_in_{name}")).alias(name) for name in sums], *(totals or {}))
