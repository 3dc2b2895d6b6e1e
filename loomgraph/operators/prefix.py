"""Running sums in two levels: inside segments of a group, and over the segments.

No task holds more of a group than one segment, or its list of segments, so a group that
holds a third of all rows is spread.

Defined results: null keys form a group of their own; a null segment comes first; rows that
tie in ``order`` come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def by_segment(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``totals``, one row a group and segment (nulls meet nulls)."""
    renamed = totals.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in totals.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, same, "left").drop(*[f"_j{i}" for i in range(len(keys))])


def sums_before(df: DataFrame, keys: list[str], segment: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its value over the rows of the group before this one; ``segment`` must not fall along ``order``."""
    inside = W.partitionBy(*keys, segment).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    totals = rows.groupBy(*keys, segment).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    over = W.partitionBy(*keys).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*keys, segment, *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in values])
    out = by_segment(rows.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values}), base, [*keys, segment])
    out = out.withColumns({n: F.col(f"_i_{n}") + F.coalesce(f"_b_{n}", F.lit(0)) for n in values})
    return out.drop(*[f"_{p}_{n}" for n in values for p in "vib"])
