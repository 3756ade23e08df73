"""The monthly panel: spine, validated joins, membership, unit conversions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["cell_id", "date"]


def months(spark, start: date, end: date) -> DataFrame:
    """One row for each month start from ``start`` to ``end``."""
    days = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(days).alias("date"))


def spine(cells: DataFrame, start: date, end: date) -> DataFrame:
    """Every cell in every month: the months are exploded within each cell's row."""
    days = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 month"))
    return cells.select("cell_id").distinct().select("cell_id", F.explode(days).alias("date"))


def densify(rows: DataFrame, start: date, end: date, fill: dict[str, float] | None = None) -> DataFrame:
    """``rows`` on the full spine of its cells; what is missing is null or filled."""
    full = spine(rows, start, end).join(rows, KEYS, "left")
    return full.fillna(fill) if fill else full


def missing_months(panel: DataFrame, value: str) -> int:
    return panel.filter(F.col(value).isNull()).count()


def accumulate_monthly(daily: DataFrame, key: str, day: str, sums: list[str], means: list[str] = ()) -> DataFrame:
    """Sums and means of each key and month, with the number of contributors."""
    month = F.trunc(F.col(day).cast("date"), "month").alias("date")
    return daily.groupBy(F.col(key).alias("cell_id"), month).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.avg(c).alias(f"{c}_mean") for c in means],
        F.count("*").alias("n_obs"),
    )


def duplicate_rows(rows: DataFrame, keys: list[str]) -> int:
    """Rows beyond the first of each key."""
    found = rows.groupBy(*keys).count().filter("count > 1").agg(F.sum(F.col("count") - 1).alias("n"))
    return found.first()["n"] or 0


def require_unique(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    n = duplicate_rows(rows, keys)
    if n:
        raise ValueError(f"{what}: {n} rows repeat a key of {keys}")
    return rows


def outer_one_to_one(left: DataFrame, right: DataFrame, keys: list[str] | None = None, check: bool = True) -> DataFrame:
    """Full outer join of two sources; an inner one would hide missing cells."""
    keys = keys or KEYS
    if check:
        require_unique(left, keys, "left source")
        require_unique(right, keys, "right source")
    return left.join(right, keys, "full")


def with_dimension(rows: DataFrame, cells: DataFrame, check: bool = True) -> DataFrame:
    """Left join of a dimension with one row for each cell."""
    if check:
        require_unique(cells, ["cell_id"], "dimension")
    return rows.join(cells, "cell_id", "left")


def with_membership(cells: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """A boolean column: whether a cell is among ``members``."""
    marks = members.select("cell_id").distinct().withColumn(name, F.lit(True))
    return cells.join(marks, "cell_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one source has: side and number."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only_left = a.join(b, keys, "left_anti").select(F.lit("left").alias("side"))
    only_right = b.join(a, keys, "left_anti").select(F.lit("right").alias("side"))
    return only_left.unionByName(only_right).groupBy("side").agg(F.count("*").alias("n"))


def analysis_population(cells: DataFrame, crop_share: float = 0.5) -> DataFrame:
    """Cells that are scored: in the basin, outside the lobe, mostly cropland."""
    good = F.col("in_basin") & ~F.col("in_lobe") & (F.col("crop_frac") >= crop_share)
    return cells.filter(good).select("cell_id").dropDuplicates(["cell_id"])


def within(rows: DataFrame, population: DataFrame) -> DataFrame:
    return rows.join(population, "cell_id", "left_semi")


def split_label(day: Column, splits: dict) -> Column:
    """Name of the split whose closed range holds the day, else null."""
    found = F.lit(None).cast("string")
    for name, period in splits.items():
        found = F.when((day >= F.lit(period.start)) & (day <= F.lit(period.end)), name).otherwise(found)
    return found


def class_share(values: Column, classes: list[int]) -> Column:
    """Mean over rows of a categorical value being in ``classes``; null counts as not."""
    return F.avg(F.when(values.isin(classes), 1.0).otherwise(0.0))


def block_mean(pixels: DataFrame, value: str, step: float, west: float, north: float, keys: list[str] = ()) -> DataFrame:
    """Fine pixels averaged on a coarser lattice: mean, deviation, count by cell."""
    i = F.floor((F.col("lon") - west) / step).cast("long").alias("i")
    j = F.floor((north - F.col("lat")) / step).cast("long").alias("j")
    return pixels.groupBy(*keys, i, j).agg(
        F.avg(value).alias(f"{value}_mean"),
        F.stddev_pop(value).alias(f"{value}_std"),
        F.count(value).alias("n"),
        F.count_if(F.col(value).isNull()).alias("n_masked"),
    )


def bilinear(points: DataFrame, pixels: DataFrame, value: str, step: float, west: float, north: float) -> DataFrame:
    """Each point's value from the four pixels around it, by one equi-join.

    Masked and missing pixels count nothing and give up their weight; a point
    without any has a null. Points keep all their columns and rows.
    """
    x, y = (F.col("lon") - west) / step - 0.5, (north - F.col("lat")) / step - 0.5
    corners = [(a, b) for a in (0, 1) for b in (0, 1)]
    fx, fy = x - F.floor(x), y - F.floor(y)
    near = [F.struct((F.floor(x) + a).cast("long").alias("i"), (F.floor(y) + b).cast("long").alias("j"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("w")) for a, b in corners]
    rows = points.withColumn("_point", F.monotonically_increasing_id()).select(F.struct(*points.columns).alias("_row"), "_point", F.explode(F.array(*near)).alias("_near"))
    rows = rows.select("_row", "_point", F.col("_near.i").alias("_i"), F.col("_near.j").alias("_j"), F.col("_near.w").alias("_w"))
    corners_of = pixels.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col(value).alias("_v"))
    joined = rows.join(corners_of, ["_i", "_j"], "left")
    weight = F.when(F.col("_v").isNotNull(), F.col("_w"))
    total = F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum(weight))
    return joined.groupBy("_point", "_row").agg(total.alias(value)).select("_row.*", value)


def two_stage_mean(pixels: DataFrame, value: str, fine: float, coarse: float, west: float, north: float) -> DataFrame:
    """Block means of block means: pixels to a pinned intermediate lattice, then to cells.

    Every intermediate block weighs the same, however many pixels it holds.
    """
    first = block_mean(pixels, value, fine, west, north).select("i", "j", F.col(f"{value}_mean").alias(value))
    i, j = (F.floor((F.col(c) + 0.5) * (fine / coarse)).cast("long").alias(c) for c in ("i", "j"))
    return first.groupBy(i, j).agg(F.avg(value).alias(value), F.count(value).alias("n_blocks"))


def region_mean(panel: DataFrame, members: DataFrame, value: str) -> DataFrame:
    """Mean over the member cells for each date, with their number."""
    return within(panel, members).groupBy("date").agg(F.avg(value).alias(value), F.count(value).alias("n_cells"))


def incomplete_contributors(daily: DataFrame, key: str, day: str, least: int) -> DataFrame:
    """Keys and months with fewer contributing rows than ``least``."""
    return accumulate_monthly(daily, key, day, []).filter(F.col("n_obs") < least)


# unit conversions


def kelvin_to_celsius(x: Column) -> Column:
    return x - 273.15


def metres_to_mm(x: Column) -> Column:
    return x * 1000


def joules_to_megajoules(x: Column) -> Column:
    return x / 1e6


def pascal_to_kpa(x: Column) -> Column:
    return x / 1000


def wind_at_two_metres(wind10: Column) -> Column:
    return wind10 * 0.748


def wind_speed(u: Column, v: Column) -> Column:
    """Magnitude of one observation; average these, not the components."""
    return F.hypot(u, v)


def root_zone(layer1: Column, layer2: Column, layer3: Column) -> Column:
    """Soil moisture of the root zone, weighted by the depth of the layers."""
    return 0.07 * layer1 + 0.21 * layer2 + 0.72 * layer3


def annual_means(panel: DataFrame, value: str) -> DataFrame:
    """Sum of each year and cell, then the mean over cells."""
    yearly = panel.groupBy("cell_id", F.year("date").alias("year")).agg(F.sum(value).alias("total"))
    return yearly.groupBy("year").agg(F.avg("total").alias("annual_mean"), F.count("*").alias("n_cells"))


def era_means(annual: DataFrame, eras: dict[str, tuple[int, int]], base: str) -> DataFrame:
    """Mean of the years of each era, its spread, and its bias against the base era in percent."""
    own = [F.struct(F.lit(k).alias("era"), F.lit(a).alias("first"), F.lit(b).alias("last")) for k, (a, b) in eras.items()]
    rows = annual.select("year", "annual_mean", F.explode(F.array(*own)).alias("e")).filter(F.col("year").between(F.col("e.first"), F.col("e.last")))
    means = rows.groupBy(F.col("e.era").alias("era")).agg(
        F.count("*").alias("n_years"), F.avg("annual_mean").alias("mean"), (F.max("annual_mean") - F.min("annual_mean")).alias("spread")
    )
    of_base = F.max(F.when(F.col("era") == base, F.col("mean"))).over(Window.partitionBy(F.lit(1)))  # one row for each era
    return means.withColumn("bias_percent", 100 * (F.try_divide(F.col("mean"), of_base) - 1))


def area_ratio(cells: DataFrame, parts: DataFrame, cell_area_km2: float, tolerance: float = 0.02) -> DataFrame:
    """Area of the cells over that of the polygons they fill, and whether they agree."""
    ours = cells.agg((F.count("*") * cell_area_km2).alias("cells_km2"))
    theirs = parts.agg(F.sum("area_km2").cast("double").alias("polygons_km2"))  # one row each
    ratio = F.try_divide(F.col("cells_km2"), F.col("polygons_km2"))
    return ours.join(F.broadcast(theirs)).select("*", ratio.alias("ratio"), (F.abs(ratio - 1) <= tolerance).alias("ok"))


def published_ratios(areas: DataFrame, published: dict[str, float]) -> DataFrame:
    """The summed area against each published figure."""
    figures = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), F.lit(v).alias("published_km2")) for k, v in published.items()])).alias("p")
    return areas.agg(F.sum("area_km2").cast("double").alias("area_km2")).select("area_km2", figures).select("p.*", "area_km2", F.try_divide("area_km2", "p.published_km2").alias("ratio"))


def driest_years(annual: DataFrame, n: int) -> DataFrame:
    return annual.orderBy("annual_mean", "year").limit(n).withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))


def level_shift_ok(annual: DataFrame, after: int, n_driest: int = 8, least_decades: int = 3) -> bool:
    """Some year after the change is above the mean, and dry years are spread over decades."""
    mean = annual.agg(F.avg("annual_mean")).first()[0]
    above = annual.filter((F.col("year") > after) & (F.col("annual_mean") > mean)).limit(1).count()
    decades = driest_years(annual, n_driest).select("decade").distinct().count()
    return bool(above) and decades >= least_decades


def population_spread(panel: DataFrame, value: str, populations: dict[str, Column]) -> DataFrame:
    """Mean annual total of each population, and the spread between them."""
    yearly = panel.groupBy("cell_id", F.year("date").alias("year"), *[c.alias(k) for k, c in populations.items()])
    yearly = yearly.agg(F.sum(value).alias("total"))
    names = [F.struct(F.lit(k).alias("population"), F.col(k).alias("member")) for k in populations]
    rows = yearly.select("year", "total", F.explode(F.array(*names)).alias("p")).filter("p.member")
    means = rows.groupBy("p.population", "year").agg(F.avg("total").alias("mean")).groupBy("population").agg(F.avg("mean").alias("mean"))
    everything = Window.partitionBy(F.lit(1))
    return means.withColumn("spread", F.max("mean").over(everything) - F.min("mean").over(everything))


def area_by_basin(parts: DataFrame) -> DataFrame:
    """Number and area of sub-basins in each main basin, largest first."""
    found = parts.groupBy("main_basin").agg(F.count("*").alias("n_parts"), F.sum("area_km2").alias("area_km2"))
    return found.orderBy(F.desc("area_km2"))
