"""Operators that several families share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.tables import written


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__r = 1").drop("__r")


#: values of a group that one task may put in order
SORTED = 200_000
#: ranks that the borders of a round stand for, and the accuracy that they are found with
GRID, ACCURACY = 256, 20_000


def at_ranks(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: list[str], sorted_most: int = SORTED) -> DataFrame:
    """For each group the value at given places of its order: name -> place (from 0) as a function of the count.

    Exact.  Groups of at most ``sorted_most`` rows are sorted.  If any is larger,
    borders of equal counts (approximate percentiles) enclose each place, however
    the values lie; what is below the lower border is counted, and what lies between is enclosed anew, until few
    enough different values are left to be sorted.  Nulls do not count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.lit(0).alias("__all"), F.col(value).alias("__v"))
    keys = [*by, "__all"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    most = sizes.agg(F.coalesce(F.max("__n"), F.lit(0))).first()[0]
    if most <= sorted_most:
        held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__s"))
        return held.select(*by, *[F.get("__s", f(F.size("__s").cast("long")).cast("int")).alias(k) for k, f in ranks.items()])
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), f(F.col("__n")).cast("long").alias("at")) for k, f in ranks.items()])).alias("__p")
    wanted = written(sizes.select(*keys, places).select(*keys, F.col("__p.k").alias("__k"), F.col("__p.at").alias("__at")))
    inside = rows.join(wanted, keys)
    group = [*keys, "__k", "__at"]
    found = None
    while True:
        inside = written(inside)
        left = inside.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        left = written(left)
        few = (F.col("__n") <= sorted_most) | (F.col("__lo") == F.col("__hi"))
        counted = inside.join(left.where(few).select(*group), group).groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__m"))
        upto = F.coalesce(F.sum("__m").over(Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        picked = counted.withColumn("__before", upto).where((F.col("__at") >= F.col("__before")) & (F.col("__at") < F.col("__before") + F.col("__m"))).select(*keys, "__k", "__v")
        found = picked if found is None else found.unionByName(picked)
        many = left.where(~few)
        if many.isEmpty():
            return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == k, F.col("__v"))).alias(k) for k in ranks]).drop("__all")
        borders = inside.join(many.select(*group), group).groupBy(*group).agg(F.percentile_approx("__v", [k / GRID for k in range(GRID + 1)], ACCURACY).alias("__b"))
        spot = F.floor(F.col("__at") / F.col("__n") * GRID).cast("int")
        ends = borders.join(many.select(*group, "__n"), group).select(
            *group, F.get("__b", F.greatest(spot - 1, F.lit(0))).alias("__from"), F.get("__b", F.least(spot + 2, F.lit(GRID))).alias("__to")
        )
        near = inside.join(ends, group)
        below = near.groupBy(*group).agg(F.count_if(F.col("__v") < F.col("__from")).alias("__below"))
        inside = near.where(F.col("__v").between(F.col("__from"), F.col("__to"))).select(*group, "__v").join(below, group).select(*keys, "__k", (F.col("__at") - F.col("__below")).alias("__at"), "__v")


def floor_quantiles(df: DataFrame, value: str, ps: list[float], by: list[str]) -> DataFrame:
    """For each group the sorted value at index min(floor(n * p), n - 1), as p05, p50, ...; no interpolation."""
    ranks = {f"p{round(100 * p):02d}": (lambda n, p=p: F.least(F.floor(n * p), n - 1)) for p in ps}
    return at_ranks(df, value, ranks, by)


def common_share(n: Column, total: Column, places: int = 3) -> Column:
    """n / total, 0 for an empty total."""
    return F.round(F.when(total > 0, n / total).otherwise(0.0), places)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def unit(v: Column) -> Column:
    """The array scaled to length one; a zero array stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def rrf(channels: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: channels have the keys and ``rank`` (from 1); scores sum 1 / (k + rank)."""
    parts = [c.select(*keys, (1.0 / (k + F.col("rank"))).alias("part")) for c in channels]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*keys).agg(F.sum("part").alias("score"))


#: rows that a part of a common order should have
PART_ROWS = 1_000_000


def in_order(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows``, written, with ``part``: parts follow on each other in the order of ``columns``, and rows equal in these share one."""
    rows = written(rows)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    return written(rows.repartitionByRange(parts, *columns).withColumn("part", F.spark_partition_id()))


def running_sums(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` of all rows of the group up to this one in ``order`` (which tells rows apart).

    A group is not summed in one task: parts of the common order add up their own
    rows, and what came before in the group is added from one sum a part.
    """
    dealt = in_order(rows, [*by, *order])
    sums = dealt.groupBy(*by, "part").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("part").alias("__part"), before.alias("__before"))
    own = F.sum(value).over(Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("part") == F.col("__part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = dealt.withColumn("__own", own).join(offsets, same)
    return out.select(*rows.columns, (F.col("__before") + F.coalesce("__own", F.lit(0))).alias(name))
