"""Running aggregates along sequences of which one may hold most of the rows.

A window partitioned by queue sorts a hot queue in one task. Here each sequence is cut into
buckets of its order (tags by their upper digits): every bucket is summed up with partial
aggregation, the few bucket rows of a sequence are accumulated in a small window, and only
rows of one bucket are sorted together. A queue that holds the whole log is spread over as
many tasks as it has buckets.

Keys must not be null. Rows that are equal in every order column have no order among
themselves, as in any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a sequence in one bucket.
WIDTH = 1 << 16


def bucket(place: str | Column, width: int = WIDTH) -> Column:
    return F.floor((F.col(place) if isinstance(place, str) else place) / width)


def _fold(kind: str, before: Column, inside: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
    return {"min": F.least, "max": F.greatest, "last": F.coalesce}[kind](inside, before)


def running(df: DataFrame, by: list[str], place: Column, order: list[Column], down: bool = False, upto: str = "row", **values: tuple) -> DataFrame:
    """df with running aggregates, named as given: (kind, column) with kind sum, min, max or last
    (the last that is not null), or ("count",).

    place: the bucket, which must not fall along `order`; all of `order` goes up, or down. upto:
    "row" (the row included) or "before".
    """
    col = lambda v: F.lit(1) if len(v) == 1 else F.col(v[1]) if isinstance(v[1], str) else v[1]
    x = df.withColumn("_b", place)
    for i, c in enumerate(order):
        x = x.withColumn(f"_o{i}", c)
    for i, v in enumerate(values.values()):
        x = x.withColumn(f"_v{i}", col(v))
    keys = [f"_o{i}" for i in range(len(order))]
    picked = F.min_by if down else F.max_by

    def whole(i: int, kind: str) -> Column:
        v = F.col(f"_v{i}")
        if kind == "last":  # of no value at all the key is null, and so is what it picks
            return picked(v, F.when(v.isNotNull(), F.struct(*keys)))
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](v)

    kinds = [v[0] for v in values.values()]
    sums = x.groupBy(*by, "_b").agg(*[whole(i, k).alias(f"_t{i}") for i, k in enumerate(kinds)])
    along = lambda c: F.desc(c) if down else F.asc(c)
    over = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    earlier = Window.partitionBy(*by).orderBy(along("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_b", *[over[k](f"_t{i}").over(earlier).alias(f"_p{i}") for i, k in enumerate(kinds)])
    inner = Window.partitionBy(*by, "_b").orderBy(*map(along, keys)).rowsBetween(Window.unboundedPreceding, 0 if upto == "row" else -1)
    for i, k in enumerate(kinds):
        x = x.withColumn(f"_v{i}", (F.count if k == "count" else over[k])(f"_v{i}").over(inner))
    x = x.join(sums, [*by, "_b"], "left")
    out = [_fold(k, F.col(f"_p{i}"), F.col(f"_v{i}")).alias(n) for i, (n, k) in enumerate(zip(values, kinds))]
    return x.select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *out)


def ranked(df: DataFrame, by: list[str], place: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with the rank of each row, from 1 up."""
    return running(df, by, bucket(place, width), [F.col(place)], **{name: ("count",)})
