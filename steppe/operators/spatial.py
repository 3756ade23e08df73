"""Spatial joins by equality of cells: points in polygons, and pairs within a distance.

Both index space by square or banded cells, join on them, and test exactly only
where a cell does not decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steppe.functions.geo import EARTH_KM, haversine_km
from steppe.storage import materialize


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """polygon_id, x1, y1, x2, y2: every side of every ring; open rings are closed.

    ``polygons``: polygon_id, rings (array of rings, each an array of (lon, lat)
    arrays). Rings count by the even-odd rule, so a ring inside another is a hole.
    """
    ring = polygons.select("polygon_id", F.explode("rings").alias("ring")).filter(F.size("ring") > 2)
    sides = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    edges = ring.select("polygon_id", F.inline(sides))
    return edges.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _cell(value: Column, step: float) -> Column:
    return F.floor(value / step).cast("long")


def edge_rows(edges: DataFrame, step: float) -> DataFrame:
    """The sides by the rows of cells that they reach: adds j."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    return edges.withColumn("j", F.explode(F.sequence(_cell(low, step), _cell(high, step))))


def border_cells(rows: DataFrame, step: float) -> DataFrame:
    """polygon_id, i, j of all cells that a side reaches, and of those beside them: rounding can't make one an inner cell."""
    bottom, top = F.col("j") * step, (F.col("j") + 1) * step
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    at = [F.col("x1") + slope * (F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2")) - F.col("y1")) for y in (bottom, top)]
    flat = F.col("y1") == F.col("y2")
    ends = [F.when(flat, F.col(c)).otherwise(x) for c, x in zip(("x1", "x2"), at, strict=True)]
    cells = F.sequence(_cell(F.least(*ends), step) - 1, _cell(F.greatest(*ends), step) + 1)
    return rows.select("polygon_id", "j", F.explode(cells).alias("i")).distinct()


def inner_cells(rows: DataFrame, border: DataFrame, step: float) -> DataFrame:
    """polygon_id, i, j of the cells that lie wholly inside: between the crossings of their row's middle, but for border cells."""
    middle = (F.col("j") + 0.5) * step
    crossed = rows.filter((F.col("y1") > middle) != (F.col("y2") > middle))
    x = (F.col("x2") - F.col("x1")) * (middle - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    runs = crossed.groupBy("polygon_id", "j").agg(F.array_sort(F.collect_list(x)).alias("x"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("x") / 2).cast("int") - 1), lambda k: F.struct(F.get("x", 2 * k).alias("a"), F.get("x", 2 * k + 1).alias("b")))
    runs = runs.select("polygon_id", "j", F.explode(pairs).alias("p"))
    cells = runs.select("polygon_id", "j", F.explode(F.sequence(_cell(F.col("p.a"), step), _cell(F.col("p.b"), step))).alias("i"))
    return cells.join(border, ["polygon_id", "i", "j"], "left_anti").distinct()


def points_in_polygons(points: DataFrame, polygons: DataFrame, step: float, key: str = "cell_id") -> DataFrame:
    """``key`` and polygon_id of every point inside a polygon (even-odd, as ``geo.in_polygon``).

    ``points``: the key, lon, lat. ``step``: degrees of an index cell, about the
    distance of neighbouring points. Points in inner cells join by equality;
    only those in border cells cast a ray, against the sides in their row.
    Null coordinates are inside nothing; points repeat as they are given.
    """
    edges = materialize(edge_rows(polygon_edges(polygons), step), "polygon-edges")
    border = materialize(border_cells(edges, step), "polygon-border")
    inner = inner_cells(edges, border, step)
    where = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(key, "lon", "lat", _cell(F.col("lon"), step).alias("i"), _cell(F.col("lat"), step).alias("j"))
    sure = where.join(inner, ["i", "j"]).select(key, "polygon_id")
    near = where.select("lon", "lat", "i", "j").distinct().join(border, ["i", "j"])
    lon, lat = F.col("lon"), F.col("lat")
    at = (F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crosses = ((F.col("y1") > lat) != (F.col("y2") > lat)) & (lon < at)
    odd = near.join(edges, ["polygon_id", "j"]).filter(crosses).groupBy("polygon_id", "lon", "lat").agg((F.count("*") % 2).alias("odd")).filter("odd = 1")
    return sure.unionByName(where.join(odd, ["lon", "lat"]).select(key, "polygon_id"))


def _bands(km: float) -> tuple[float, Column]:
    """Degrees of a band of latitude, and the number of cells around it, by ``band``.

    A cell is at least ``km`` wide where the band is narrowest, and the poles have one.
    """
    step = math.degrees(km / EARTH_KM)
    farthest = F.least(F.greatest(F.abs(F.col("band") * step), F.abs((F.col("band") + 1) * step)), F.lit(90.0))
    return step, F.greatest(F.floor(360 * F.cos(F.radians(farthest)) / step), F.lit(1)).cast("long")


def within_km(points: DataFrame, cells: DataFrame, km: float, point: str = "point_id", cell: str = "cell_id") -> DataFrame:
    """The point's key, the cell's key and ``km`` of all pairs at most that far apart.

    ``points`` and ``cells``: their key, lon, lat. Cells stand in bands of
    latitude, cut into cells of longitude whose number follows the latitude; a
    point looks into those that its circle can reach, also over the date line
    and the poles. Pairs come once; null coordinates are near nothing.
    """
    step, around = _bands(km)
    turn = lambda lon: F.pmod(lon + 180, F.lit(360.0))
    known = cells.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        F.col(cell).alias("_cell"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), _cell(F.col("lat"), step).alias("band")
    )
    known = known.withColumn("slot", F.least(F.floor(turn(F.col("_lon")) / 360 * around), around - 1).cast("long"))
    reach = F.sin(F.lit(km / EARTH_KM)) / F.cos(F.radians("lat"))
    pole = (F.abs("lat") + step >= 90) | (reach >= 1)
    mine = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        F.col(point).alias("_point"), "lon", "lat", F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * (1 + 1e-9)).alias("wide"),
        F.explode(F.sequence(_cell(F.col("lat") - step, step), _cell(F.col("lat") + step, step))).alias("band"),
    )
    first = F.floor((turn(F.col("lon")) - F.col("wide")) / 360 * around).cast("long")
    last = F.floor((turn(F.col("lon")) + F.col("wide")) / 360 * around).cast("long")
    slots = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + around)), lambda k: F.pmod(k, around)))
    mine = mine.withColumn("slot", F.explode(slots))
    far = haversine_km(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    pairs = mine.join(known, ["band", "slot"]).withColumn("km", far).filter(F.col("km") <= km)
    return pairs.select(F.col("_point").alias(point), F.col("_cell").alias(cell), "km")


def buffer_mean(points: DataFrame, cells: DataFrame, value: str, km: float, point: str = "point_id", cell: str = "cell_id") -> DataFrame:
    """The point's key, n_cells and the mean of the cells' value in its circle; points without any have zero and null."""
    pairs = within_km(points, cells, km, point, cell).join(cells.select(cell, value), cell)
    means = pairs.groupBy(point).agg(F.count(value).alias("n_cells"), F.avg(value).alias("mean"))
    return points.select(point).join(means, point, "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
