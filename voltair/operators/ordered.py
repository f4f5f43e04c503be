"""Numbers and neighbours of rows in an order, without a task that holds a whole partition: rows are ordered within buckets, and buckets meet by a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, part: str, at: Column, order: list[str], width: int, name: str = "t") -> DataFrame:
    """df with its 0-based number within `part`, in the order of `at` and then `order`.

    Rows are ranked within buckets of `width` of `at`, and a bucket's first number is the
    count of the buckets before it, so no task holds a whole part; only the counts, a row a
    bucket, are summed up in order.
    """
    bucketed = df.withColumn("_bucket", F.floor(at / width))
    counts = bucketed.groupBy(part, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(part, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(part, "_bucket").orderBy(at, *order)) - 1
    return bucketed.withColumn("_rank", rank).join(first, [part, "_bucket"]).withColumn(name, (F.col("_first") + F.col("_rank")).cast("long")).select(*df.columns, name)


def beside(df: DataFrame, part: str, order: list[str], width: int, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """df with columns of the row before and of the row after it within `part`, as {new name: column}; null where there is none.

    The first of `order` is a number, by which rows are dealt into buckets of `width`; the
    last and the first row of each bucket go to its neighbours.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    inside = Window.partitionBy(part, "_bucket").orderBy(*order)
    across = Window.partitionBy(part).orderBy("_bucket")  # a row a bucket
    place = F.struct(*order)
    edges, found = [], []
    for side, names, near, edge in (("_before", before, F.lag, F.max_by), ("_after", after, F.lead, F.min_by)):
        if names:
            value = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
            rows = rows.withColumn(side, near(value).over(inside))
            edges.append((side, edge(value, place).alias(side), near))
            found += [F.when(F.col(side).isNotNull(), F.col(f"{side}.{n}")).otherwise(F.col(f"_edge{side}.{n}")).alias(n) for n in names]
    ends = rows.groupBy(part, "_bucket").agg(*[e for _, e, _ in edges])
    ends = ends.select(part, "_bucket", *[near(F.col(side)).over(across).alias(f"_edge{side}") for side, _, near in edges])
    return rows.join(ends, [part, "_bucket"]).select(*df.columns, *found)
