"""The analysis lattice: ids, indices, neighbours, distances, geometry."""

from __future__ import annotations

import json
import math
import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the lattice in one row: the second index of a cell stays below it.
ID_FACTOR = 100_000
EARTH_KM = 6371.0


def lattice_params(transform: list[float]) -> tuple[float, float, float]:
    """Step, west and north edge of an affine transform with square cells, north up."""
    step, shear_x, west, shear_y, down, north = transform
    if shear_x or shear_y or step <= 0 or not math.isclose(down, -step):
        raise ValueError("the lattice must be north up with square cells")
    return step, west, north


def cell_index(coordinate: Column, origin: float, step: float) -> Column:
    """Index of a cell's centre; a fractional rest shows misalignment."""
    return (coordinate - origin) / step - 0.5


def cell_id(i: Column, j: Column) -> Column:
    """Numbers are rounded half to even."""
    return F.rint(i).cast("long") * ID_FACTOR + F.rint(j).cast("long")


def cell_i(cell: Column) -> Column:
    return F.floor(cell / ID_FACTOR).cast("long")


def cell_j(cell: Column) -> Column:
    return F.pmod(cell, F.lit(ID_FACTOR))


def native_cell_id(lon: Column, lat: Column) -> Column:
    return F.rint(lon * 1000).cast("long") * 1_000_000 + F.rint(lat * 1000).cast("long")


def neighbour_offsets() -> Column:
    """The eight cells around a cell, as an array of (di, dj)."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    return F.array(*[F.struct(F.lit(a).cast("long").alias("di"), F.lit(b).cast("long").alias("dj")) for a, b in steps])


def neighbours(cells: DataFrame, keys: list[str] | None = None, i: str = "i", j: str = "j") -> DataFrame:
    """Pairs of adjacent rows: eight offsets are exploded, then joined on equality."""
    keys = keys or []
    near = cells.select(*keys, "cell_id", (F.col(i)).alias("_i"), F.col(j).alias("_j"), F.explode(neighbour_offsets()).alias("o"))
    near = near.select(*keys, "cell_id", (F.col("_i") + F.col("o.di")).alias(i), (F.col("_j") + F.col("o.dj")).alias(j))
    other = cells.select(*keys, F.col("cell_id").alias("neighbour_id"), i, j)
    return near.join(other, [*keys, i, j]).select(*keys, "cell_id", "neighbour_id")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def point_to_cell(points: DataFrame, step: float, west: float, north: float) -> DataFrame:
    """The cell whose square holds each point, with the distance to its centre."""
    i = F.floor((F.col("lon") - west) / step)
    j = F.floor((north - F.col("lat")) / step)
    lon, lat = west + (i + 0.5) * step, north - (j + 0.5) * step
    rows = points.withColumn("cell_id", cell_id(i, j))
    return rows.withColumn("km_to_centre", haversine_km(F.col("lon"), F.col("lat"), lon, lat))


def ring(lon: Column, lat: Column, half: float) -> Column:
    """The closed ring of a square cell: five corners, counter-clockwise."""
    corners = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]
    return F.array(*[F.array(lon + a, lat + b) for a, b in corners])


def features(cells: DataFrame, half: float, properties: list[str], keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """One GeoJSON feature, as text, for each cell, beside its keys."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring(F.col("lon"), F.col("lat"), half)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    return cells.select(*keys, F.to_json(feature).alias("feature"))


def write_geojson(cells: DataFrame, path: str, half: float, properties: list[str]) -> None:
    """A feature collection in one local file, for a grid of cells that fits the driver.

    The file gets its name when it is complete.
    """
    hidden = os.path.join(os.path.dirname(path) or ".", f".{os.path.basename(path)}-{uuid.uuid4().hex}")
    try:
        with open(hidden, "w") as f:
            f.write('{"type": "FeatureCollection", "features": [\n')
            for n, row in enumerate(features(cells, half, properties).orderBy("cell_id").toLocalIterator()):
                f.write((",\n" if n else "") + row["feature"])
            f.write("\n]}\n")
        with open(hidden) as f:
            json.load(f)
        os.replace(hidden, path)
    finally:
        if os.path.exists(hidden):
            os.remove(hidden)


def in_polygon(lon: Column, lat: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule for one ring of corners."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 == y2:
            continue
        crosses = (F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)
        at = (x2 - x1) * (lat - y1) / (y2 - y1) + x1
        inside = inside != (crosses & (lon < at))
    return inside
