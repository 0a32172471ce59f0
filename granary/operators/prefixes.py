"""The longest prefix of a table that each key begins with: paths, policies and networks by one mechanism.

The keys that begin with a prefix are a range of the byte order, and two such
ranges lie in each other or apart.  So a table of prefixes flattens into sorted
ranges, each with the longest prefix that covers it (``flattened``), and a key
looks up the last range that starts at it or before (``last_before``): keys and
starts are dealt out by ranges of their common order, each part fills forward,
and the last start of every part carries into those behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.common import in_order
from granary.operators.tables import written

def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def flattened(prefixes: DataFrame) -> DataFrame:
    """(start, prefix) of the ranges that the different values of ``prefix`` make; a null prefix marks a gap."""
    own = written(prefixes.select("prefix").where("prefix IS NOT NULL").distinct())
    # the longest other prefix that a prefix begins with: what holds again behind its range
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix") - 1), lambda k: F.substring("prefix", F.lit(1), k)))
    inner = own.where("prefix <> ''").select("prefix", cut.alias("parent"))
    parents = inner.join(own.select(F.col("prefix").alias("parent")), "parent").groupBy("prefix").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    begins = own.select(_bytes(F.col("prefix")).alias("start"), F.lit(True).alias("begins"), "prefix")
    # no text has the byte FF, so it lies behind all that begin with the prefix
    ends = own.join(parents, "prefix", "left").select(F.concat(_bytes(F.col("prefix")), F.unhex(F.lit("FF"))).alias("start"), F.lit(False).alias("begins"), F.col("parent").alias("prefix"))
    # of ranges that end at one place the outer one counts; nothing begins where another ends
    return begins.unionByName(ends).select("start", "prefix")


def last_before(keys: DataFrame, starts: DataFrame) -> DataFrame:
    """(key, label) of the different values of ``key``: the label of the last start at it or before, null before all starts.

    ``starts`` (start, label) has each start once.  Both are binary or of one other ordered type.
    """
    points = keys.select("key").where("key IS NOT NULL").distinct().select("key", F.lit(1).alias("kind"), F.lit(None).cast("struct<label:string>").alias("held"))
    marks = starts.select(F.col("start").alias("key"), F.lit(0).alias("kind"), F.struct("label").cast("struct<label:string>").alias("held"))
    both = in_order(points.unionByName(marks), ["key", "kind"])
    # a row a part: what the parts before it end with
    last = both.where("kind = 0").groupBy("part").agg(F.max_by("held", "key").alias("held"))
    last = last.unionByName(both.select("part").distinct().withColumn("held", F.lit(None).cast("struct<label:string>"))).groupBy("part").agg(F.max("held").alias("held"))
    before = F.last("held", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select("part", before.alias("carried"))
    within = F.last("held", ignorenulls=True).over(Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    filled = both.withColumn("own", within).where("kind = 1").join(F.broadcast(carried), "part", "left")
    return filled.select("key", F.coalesce("own", "carried")["label"].alias("label"))


def longest(rows: DataFrame, text: str, prefixes: DataFrame, name: str = "prefix") -> DataFrame:
    """``rows`` with ``name``: the longest ``prefix`` of ``prefixes`` that ``text`` begins with, null if none.

    Only the different texts are looked up, so a text that very many rows have costs no more than another.
    """
    starts = flattened(prefixes).select("start", F.col("prefix").alias("label"))
    found = last_before(rows.select(_bytes(F.col(text)).alias("key")), starts)
    found = found.select(F.decode("key", "UTF-8").alias("__key"), F.col("label").alias(name))
    return rows.join(found, F.col(text) == F.col("__key"), "left").drop("__key")


def _bits(digits: Column) -> Column:
    """Sixteen bits of each group of four hexadecimal digits."""
    return F.array_join(F.transform(digits, lambda x: F.lpad(F.conv(x, 16, 2), 16, "0")), "")


def address_bits(address: Column) -> Column:
    """An IP address as its version (4 or 6) and its bits; null for anything else."""
    four = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
    v4 = F.concat(F.lit("4"), F.array_join(F.transform(F.split(address, r"\."), lambda x: F.lpad(F.bin(x.try_cast("long")), 8, "0")), ""))
    sides = F.split(address, "::")
    groups = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    gap = 8 - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    shape = address.rlike("^[0-9A-Fa-f:]+$") & ~address.rlike(":::|::.*::|[0-9A-Fa-f]{5}|^:[^:]|[^:]:$")
    fits = shape & F.when(F.size(sides) == 2, gap >= 1).otherwise((F.size(sides) == 1) & (gap == 0))
    return F.when(address.rlike(four), v4).when(fits, F.concat(F.lit("6"), _bits(whole)))


def network_bits(network: Column) -> Column:
    """The prefix of ``address_bits`` that all addresses of a network (address/length) share; null if it is none."""
    parts = F.split(network, "/")
    bits, size = address_bits(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)).try_cast("int")
    return F.when((size >= 0) & (size < F.length(bits)), F.substring(bits, F.lit(1), size + 1))
