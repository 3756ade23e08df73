"""Joins over time: the latest row before, and intervals that overlap.

One key may have a third of all rows: both joins cut time into spans, and a key
meets itself only inside a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ticks(time: Column, kind: str) -> Column:
    """Times as whole numbers: days of a date, microseconds of a timestamp."""
    if kind == "date":
        return F.unix_date(time)
    if kind.startswith("timestamp"):
        return F.unix_micros(time.cast("timestamp"))
    return time.cast("long")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], span: int, tolerance: int | None = None, strict: bool = False) -> DataFrame:
    """The rows of ``left`` with the values of the latest row of ``right`` at or before their time.

    Adds ``matched_<time>`` and the values, null where nothing came before, or
    nothing within ``tolerance``. ``strict``: a row at the very time does not
    count. ``span`` and ``tolerance`` are in days for dates, microseconds for
    timestamps, else units. Both sides are united and sorted within (keys, span);
    what spans before have to offer is one row each. Of several rows at the
    latest time the one with the greatest values counts; null keys or times match nothing.
    """
    kind = dict(left.dtypes)[time]
    known = [F.col(k).isNotNull() for k in (*keys, time)]
    usable = known[0]
    for c in known[1:]:
        usable = usable & c
    offer = F.struct(F.col(time).alias("t"), *values)
    rows = right.filter(usable).select(*keys, time, offer.alias("_offer"), F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    mine = left.filter(usable).select(*keys, time, F.lit(None).cast(rows.schema["_offer"].dataType).alias("_offer"), F.struct("*").alias("_row"))
    both = rows.unionByName(mine).withColumn("_span", F.floor(_ticks(F.col(time), kind) / span))
    ticks = _ticks(F.col(time), kind)
    near = F.max("_offer").over(Window.partitionBy(*keys, "_span").orderBy(ticks).rangeBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow))
    last = both.groupBy(*keys, "_span").agg(F.max("_offer").alias("_last"))
    carried = F.max("_last").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    last = last.select(*keys, "_span", carried.alias("_carried"))
    found = both.withColumn("_near", near).filter(F.col("_row").isNotNull()).join(last, [*keys, "_span"], "left")
    best = F.coalesce("_near", "_carried")
    if tolerance is not None:
        best = F.when(ticks - _ticks(best["t"], kind) <= tolerance, best)
    done = found.select("_row.*", best["t"].alias(f"matched_{time}"), *[best[v].alias(v) for v in values])
    none = [F.lit(None).cast(t).alias(c) for c, t in done.dtypes if c not in left.columns]
    return done.unionByName(left.filter(~F.coalesce(usable, F.lit(False))).select("*", *none))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], span: int, left_ends: tuple[str, str] = ("start", "end"), right_ends: tuple[str, str] = ("from", "until")) -> DataFrame:
    """All pairs of rows with equal keys whose half-open intervals share a moment.

    Each interval goes to every span that it reaches; a pair meets in several,
    and counts in the first that both have. Empty or null intervals overlap nothing.
    """

    def cut(df: DataFrame, ends: tuple[str, str], name: str) -> DataFrame:
        kind = dict(df.dtypes)[ends[0]]
        a, b = (_ticks(F.col(c), kind) for c in ends)
        rows = df.filter(F.col(ends[0]) < F.col(ends[1])).withColumn(f"_first{name}", F.floor(a / span).cast("long"))
        return rows.withColumn("_span", F.explode(F.sequence(F.col(f"_first{name}"), F.floor((b - 1) / span).cast("long"))))

    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    both = cut(left, left_ends, "1").join(cut(right, right_ends, "2"), [*keys, "_span"])
    both = both.filter(F.col("_span") == F.greatest("_first1", "_first2"))
    both = both.filter((F.col(left_ends[0]) < F.col(right_ends[1])) & (F.col(right_ends[0]) < F.col(left_ends[1])))
    return both.drop("_span", "_first1", "_first2")
