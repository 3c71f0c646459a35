"""Interval joins that split hot keys by time.

A half-open range of a length under 2**k microseconds is of level k and covers at
most two buckets of that width.  Two rows that overlap meet in a bucket of the
level of the longer one: each row is dealt to the buckets of its own level and of
those longer levels that the other side has.  So every join is on key, level and bucket, a
row is copied at most twice for each level there is, whatever the lengths, and a hot key is as many tasks
as it has buckets.  A pair that shares two buckets is reported in the one in which the
later of the two begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times without a beginning or an end, in microseconds, and the level of such ranges.
_FIRST, _LAST, _MOST_LEVEL = -(1 << 61), 1 << 61, 62


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _side(rows: DataFrame, by: list[str], start: Column, end: Column, name: str) -> DataFrame:
    """``(by..., _s, _e, _level, _<name>)`` of the rows whose range is not empty and whose key has no null."""
    keys = [F.col(k).alias(f"_key{i}") for i, k in enumerate(by)]
    out = rows.select(*keys, start.alias("_s"), end.alias("_e"), F.struct(*[F.col(c) for c in rows.columns]).alias(f"_{name}"))
    for i in range(len(by)):
        out = out.filter(F.col(f"_key{i}").isNotNull())
    return out.filter("_s < _e").withColumn("_level", F.least(F.length(F.bin(F.col("_e") - F.col("_s"))), F.lit(_MOST_LEVEL)))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], how: str = "inner") -> DataFrame:
    """Pairs of rows with equal ``by`` whose half-open ranges (start, end) overlap: the columns of ``left`` and those of ``right`` but ``by``.

    A null start has no beginning and a null end no end; a range that ends where it begins, or before, overlaps nothing; null keys match
    nothing.  Of ranges of ``right`` that overlap each other a left row gets all, a row for each.
    With ``how`` "left" rows of ``left`` without a partner stay, with nulls.  Names of ``right`` must differ from those of ``left``.
    """
    bounds = lambda r: (F.coalesce(_micros(r[0]), F.lit(_FIRST)), F.coalesce(_micros(r[1]), F.lit(_LAST)))
    return _joined(left, right, by, bounds(left_range), bounds(right_range), how)


def within(points: DataFrame, ranges: DataFrame, by: list[str], time: str, start: str, end: str, how: str = "left") -> DataFrame:
    """``points`` with the columns of the ``ranges`` of their key that hold their time (start included, end not); a null time is in none."""
    at = _micros(F.col(time))
    right = (F.coalesce(_micros(F.col(start)), F.lit(_FIRST)), F.coalesce(_micros(F.col(end)), F.lit(_LAST)))
    return _joined(points, ranges, by, (at, at + 1), right, how)


def _joined(left: DataFrame, right: DataFrame, by: list[str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], how: str) -> DataFrame:
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    a, b = _side(left, by, *left_range, "left"), _side(right, by, *right_range, "right")
    # levels are at most 62 numbers on either side
    found = a.select(F.lit(0).alias("side"), "_level").union(b.select(F.lit(1), "_level")).groupBy("side").agg(F.collect_set("_level").alias("levels")).collect()
    levels = {r.side: sorted(r.levels) for r in found}
    keys = [f"_key{i}" for i in range(len(by))]
    a, b = _buckets(a, levels.get(1, []), "left"), _buckets(b, levels.get(0, []), "right")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*keys, "_at", "_bucket")]
    meets = (F.col("l._s") < F.col("r._e")) & (F.col("r._s") < F.col("l._e"))
    level = F.greatest("_left_level", "_right_level") == F.col("l._at")
    once = F.expr("shiftright(greatest(l._s, r._s), l._at)") == F.col("l._bucket")
    pairs = a.alias("l").join(b.alias("r"), [*on, meets, level, once]).select("_left", "_right")
    others = [c for c in right.columns if c not in by]
    result = pairs.select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in others])
    if how == "inner":
        return result
    kinds = {f.name: f.dataType for f in right.schema.fields}
    whole = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    # equal rows of the left side have equal partners, so the rows themselves tell which have none
    alone = whole.join(pairs.select(F.col("_left").alias("_met")).distinct(), F.col("_left").eqNullSafe(F.col("_met")), "left_anti")
    return result.unionByName(alone.select("_left.*", *[F.lit(None).cast(kinds[c]).alias(c) for c in others]))


def _buckets(side: DataFrame, other: list[int], name: str) -> DataFrame:
    """A row for each level and bucket in which a row of the other side may be met."""
    longer = F.filter(F.array(*[F.lit(k) for k in other]).cast("array<int>"), lambda k: k > F.col("_level"))
    dealt = side.withColumn("_at", F.explode(F.concat(F.array(F.col("_level").cast("int")), longer)))
    dealt = dealt.withColumn("_bucket", F.explode(F.expr("sequence(shiftright(_s, _at), shiftright(_e - 1, _at))")))
    return dealt.withColumnRenamed("_level", f"_{name}_level")
