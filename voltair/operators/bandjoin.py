"""Joins of points closer than a width, as equi-joins on buckets of that width.

A point's partners lie in its own bucket or a neighbouring one, so the left side is
sent to three buckets and joined by equality: a hash or sort-merge join whose skew
adaptive execution can split, and no nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _near(left: DataFrame, right: DataFrame, at: str, width: int) -> tuple[DataFrame, DataFrame, Column]:
    bucket = F.floor(F.col(at) / width)
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], bucket.alias("bucket"))
    return a, b, F.abs(F.col(f"l_{at}") - F.col(f"r_{at}")) < width


def band_join(left: DataFrame, right: DataFrame, at: str, width: int, also: Column | None = None) -> DataFrame:
    """All pairs with |left.at - right.at| < width; columns prefixed l_ and r_. also: a further condition on those."""
    a, b, near = _near(left, right, at, width)
    joined = a.join(b, "bucket").where(near)
    return (joined if also is None else joined.where(also)).drop("bucket")


def band_anti_join(left: DataFrame, right: DataFrame, at: str, width: int, key: str, also: Column | None = None) -> DataFrame:
    """Rows of left without a partner in right; key: a unique column of left."""
    met = band_join(left, right, at, width, also).select(F.col(f"l_{key}").alias(key)).distinct()
    return left.join(met, key, "left_anti")


def near_other(points: DataFrame, at: str, width: int, group: str, name: str = "near") -> DataFrame:
    """points with a boolean column: whether a point of another group lies closer than width. Null places: false.

    No pairs are made: each bucket of each group is one interval that its points reach,
    and a point is held against the intervals of its own bucket, one for each group
    and neighbour.
    """
    bucket = F.floor(F.col(at) / width)
    ends = points.where(F.col(at).isNotNull()).groupBy(F.col(group).alias("group"), bucket.alias("b")).agg((F.min(at) - width).alias("low"), (F.max(at) + width).alias("high"))
    reach = ends.select(F.struct("group", "low", "high").alias("r"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("_bucket"))
    reach = reach.groupBy("_bucket").agg(F.collect_list("r").alias("_reach"))  # at most three a group
    met = F.exists("_reach", lambda r: (r["group"] != F.col(group)) & (F.col(at) > r["low"]) & (F.col(at) < r["high"]))
    return points.withColumn("_bucket", bucket).join(reach, "_bucket", "left").select(*points.columns, F.coalesce(met, F.lit(False)).alias(name))
