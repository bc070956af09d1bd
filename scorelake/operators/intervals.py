"""Joins of intervals by dyadic levels.

An interval's level is the least whose nodes, unit * 2^level long, are no shorter than it, so it touches two nodes of its level at most. On each higher level it touches two at most as well, those above.
Two intervals that overlap share a node on the level of the longer one: an equi-join by keys, level and node finds them, however long the intervals are and however far apart. A copy is made for
each level that any interval of either side has, so for a logarithm of the range at most; where all are about as long, for one. On a level, an interval meets those whose own it is, and never others that are only
below it too, so short intervals don't all meet where a long one is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(x: Column) -> Column:
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def level(span: Column, unit: float) -> Column:
    """0 for an interval of up to unit, 1 for one of up to twice that, and so on; null if an end is null, infinite or undefined. Ends may stand in either order."""

    def told(s: Column) -> Column:
        # halves, since the length of a finite interval may be none
        length = F.least(F.abs(s["end"] / 2 - s["start"] / 2) / (unit / 2), F.lit(1e308))
        about = F.ceil(F.log2(F.greatest(length, F.lit(1.0))))
        return F.when(_finite(s["start"]) & _finite(s["end"]), F.when(F.pow(F.lit(2.0), about) < length, about + 1).otherwise(about).cast("int"))

    # as a lambda, which reads the interval once, whatever expression it comes from
    return F.get(F.transform(F.array(span), told), 0)


def node(x: Column, at: Column, unit: float) -> Column:
    """The node of a level in which a point lies; those beyond a long's range are one."""
    return F.floor(x / F.pow(F.lit(2.0), at) / unit)


def levels(left: DataFrame, right: DataFrame, unit: float) -> list[int]:
    """All levels of both sides' intervals: one row, of 1100 numbers at most, comes to the driver."""
    of = lambda t: t.select(level(F.col("span"), unit).alias("level"))
    return sorted(of(left).union(of(right)).agg(F.collect_set("level")).first()[0])


def meeting(left: DataFrame, right: DataFrame, keys: list[str], unit: float = 64.0) -> DataFrame:
    """(keys, l, r): structs of the rows of left and right (keys, span struct of start and end, and others) with equal keys whose intervals share more than a point, start < end of the other in both directions.

    An interval with a null, infinite or undefined end meets none. Repeated rows meet as often. Which levels there are is read first.
    """
    present = F.array(*[F.lit(x) for x in levels(left, right, unit)]).cast("array<int>")

    def placed(side: DataFrame, name: str, roles: Callable[[Column], Column]) -> DataFrame:
        span, own = F.col(f"{name}.span"), F.col(f"{name}_own")
        rows = side.select(*keys, F.struct(*[c for c in side.columns if c not in keys]).alias(name), level(F.col("span"), unit).alias(f"{name}_own"))
        rows = rows.select("*", F.explode(present).alias("level")).filter(F.col("level") >= own)
        first, last = (node(span[c], F.col("level"), unit) for c in ("start", "end"))
        rows = rows.select("*", first.alias(f"{name}_at"), F.explode(F.sequence(F.least(first, last), F.greatest(first, last))).alias("node"))
        return rows.select("*", F.explode(roles(F.col("level") == own)).alias("role"))

    # two intervals that both are shorter than a level's nodes don't meet there: role 0 is for the left one's own level, role 1 for levels above it, where only the right one's own counts
    l = placed(left, "l", lambda own: F.array(F.when(own, 0).otherwise(1)))  # noqa: E741
    r = placed(right, "r", lambda own: F.when(own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    # of the nodes that both have, the later start's
    shared = (F.col("l.span.start") < F.col("r.span.end")) & (F.col("r.span.start") < F.col("l.span.end"))
    return l.join(r, [*keys, "level", "node", "role"]).filter((F.col("node") == F.greatest("l_at", "r_at")) & shared).select(*keys, "l", "r")
