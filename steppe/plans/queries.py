"""One query for each operator of the panel library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steppe.config import Target
from steppe.functions import geo
from steppe.functions.calendar import month_cos, month_sin, year_month
from steppe.functions.distributions import gamma_p, norm_ppf
from steppe.operators import baselines as B
from steppe.operators import evaluation as E
from steppe.operators import indices as X
from steppe.operators import integrity as Q
from steppe.operators import metrics as M
from steppe.operators import model as L
from steppe.operators import panel as P
from steppe.operators import products as R
from steppe.operators import reference as V
from steppe.operators import sketches as K
from steppe.operators import spatial as G
from steppe.operators import temporal as T
from steppe.operators import windows as W
from steppe.operators import zeros as Z
from steppe.plans import inputs as I
from steppe.sources import readers as N

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_rows(df: DataFrame) -> DataFrame:
    p = I.SPLITS["test"]
    return df.filter((F.col("date") >= F.lit(p.start)) & (F.col("date") <= F.lit(p.end)))


def forecasts(spark, sf_dir, lead: int = 1) -> DataFrame:
    """cell_id, date, actual, climatology, persistence and both probabilities."""
    return B.build(I.panel(spark, sf_dir), Target("precip", lead, "classification", I.DRY), I.FIT)


def long_forecasts(spark, sf_dir, lead: int = 1) -> DataFrame:
    rows = test_rows(forecasts(spark, sf_dir, lead))
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("forecast"), F.col(f"{m}_prob").alias("prob")) for m in ("climatology", "persistence")])
    return rows.select("cell_id", "date", "actual", "actual_prob", F.explode(methods).alias("m")).select("cell_id", "date", "actual", "actual_prob", "m.*")


# sources, joins, audits


@query
def monthly_panel(spark, sf_dir):
    return I.panel(spark, sf_dir).select("cell_id", "date", "precip", "sparse", "n_obs")


@query
def month_spine(spark, sf_dir):
    rows = P.densify(I.source(spark, sf_dir, "R", "amount"), I.START, I.END)
    return rows.groupBy("date").agg(F.count("*").alias("n_cells"), F.count_if(F.col("amount").isNull()).alias("n_missing"))


@query
def daily_accumulation(spark, sf_dir):
    rows = P.accumulate_monthly(I.daily(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,4)")), "user_id", "ts", ["value"])
    return rows.select("cell_id", "date", F.round(F.col("value").cast("double"), 4).alias("total"), "n_obs")


@query
def daily_means(spark, sf_dir):
    """Monthly means with the number of contributing days."""
    rows = P.accumulate_monthly(I.daily(spark, sf_dir), "user_id", "ts", [], ["value"])
    return rounded(rows.select("cell_id", "date", F.col("value_mean").alias("mean"), "n_obs"))


@query
def incomplete_months(spark, sf_dir):
    return P.incomplete_contributors(I.daily(spark, sf_dir), "user_id", "ts", 2)


@query
def population(spark, sf_dir):
    return P.analysis_population(I.cells(spark, sf_dir))


@query
def full_outer_join(spark, sf_dir):
    return P.outer_one_to_one(I.source(spark, sf_dir, "R", "returned"), I.source(spark, sf_dir, "N", "kept"), check=False)


@query
def dimension_join(spark, sf_dir):
    rows = P.with_dimension(I.panel(spark, sf_dir).select("cell_id", "date", "precip"), I.cells(spark, sf_dir), check=False)
    return rounded(rows.select("cell_id", "date", "precip", "nation", "crop_frac", "in_basin"))


@query
def membership(spark, sf_dir):
    members = P.analysis_population(I.cells(spark, sf_dir))
    return P.with_membership(I.cells(spark, sf_dir).select("cell_id"), members, "is_member")


@query
def population_panel(spark, sf_dir):
    return P.within(I.panel(spark, sf_dir).select("cell_id", "date", "precip"), P.analysis_population(I.cells(spark, sf_dir)))


@query
def key_audit(spark, sf_dir):
    one, two = I.source(spark, sf_dir, "R", "returned"), I.source(spark, sf_dir, "N", "kept")
    rows = I.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count()
    repeated = rows.filter("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("repeated").alias("side"), "n")
    return P.key_differences(one, two, P.KEYS).unionByName(repeated)


@query
def null_audit(spark, sf_dir):
    rows = P.outer_one_to_one(I.source(spark, sf_dir, "R", "returned"), I.source(spark, sf_dir, "N", "kept"), check=False)
    return rounded(Q.null_audit(rows, ["returned", "kept"]))


@query
def value_digest(spark, sf_dir):
    """An arithmetic digest before and after a join; the two must agree."""
    mixed = F.sum(F.col("precip").cast("long") * (F.col("cell_id") * 1000 + F.year("date") * 12 + F.month("date")))
    rows = I.panel(spark, sf_dir)
    joined = P.with_dimension(rows, I.cells(spark, sf_dir), check=False)
    before = rows.agg(mixed.alias("digest"), F.count("precip").alias("n")).select(F.lit("source").alias("side"), "*")
    after = joined.agg(mixed.alias("digest"), F.count("precip").alias("n")).select(F.lit("joined").alias("side"), "*")
    return before.unionByName(after)


@query
def hash_digest_check(spark, sf_dir):
    """Columns whose hash digest changes through the joins: none."""
    rows = I.panel(spark, sf_dir)
    joined = P.with_dimension(rows, I.cells(spark, sf_dir), check=False)
    bad = Q.digest_differences(Q.digest(rows, ["precip", "sparse", "price"]), Q.digest(joined, ["precip", "sparse", "price"]))
    return bad.agg(F.count("*").alias("n_mismatched"))


@query
def physical_invariants(spark, sf_dir):
    rules = {
        "discount": F.col("l_discount").between(0, 0.08),
        "tax": F.col("l_tax").between(0, 0.08),
        "quantity": (F.col("l_quantity") >= 1) & (F.col("l_quantity") <= 50),
        "price": F.col("l_extendedprice") > 0,
        "unit_price": F.col("l_extendedprice") <= 2000 * F.col("l_quantity"),
    }
    return Q.violations(I.table(spark, sf_dir, "lineitem"), rules)


@query
def sign_proportion(spark, sf_dir):
    return rounded(Q.sign_share(I.table(spark, sf_dir, "supplier"), "s_acctbal", 0.5, -1000.0))


@query
def distinct_ratio(spark, sf_dir):
    rows = Q.distinct_ratio(I.lines(spark, sf_dir), "l_extendedprice", F.col("date"))
    return rounded(rows.select(F.col("group").alias("date"), "ratio", "n"))


@query
def static_mask(spark, sf_dir):
    rows = P.densify(I.source(spark, sf_dir, "R", "amount"), I.START, I.END)
    return Q.null_set_digests(rows, "amount").select("n", "total", "mixed").distinct().agg(F.count("*").alias("n_masks"))


@query
def source_drift(spark, sf_dir):
    """The annual means of amounts against those of scaled prices."""
    rows = I.panel(spark, sf_dir)
    second = rows.withColumn("price", F.coalesce("price", F.lit(0.0)) / 1500)
    return rounded(Q.drift(P.annual_means(rows, "precip"), P.annual_means(second, "price"), 0.02, 5000.0), 4)


@query
def lattice_subset(spark, sf_dir):
    cells = I.cells(spark, sf_dir)
    return Q.subset_check(cells.select("cell_id"), cells.filter("cell_id % 50 <> 0").select("cell_id"))


@query
def value_counts(spark, sf_dir):
    return I.monthly(spark, sf_dir).groupBy("n_obs").agg(F.count("*").alias("n")).orderBy("n_obs")


@query
def lattice_check(spark, sf_dir):
    cells = I.cells(spark, sf_dir)
    rows = cells.select(
        geo.cell_id(geo.cell_index(F.col("lon") + 0.025, 30.0, 0.05), geo.cell_index(F.col("lat") + 0.025, 37.0, 0.05)).alias("cell_id"),
        geo.cell_index(F.col("lon") + 0.025, 30.0, 0.05).alias("i"),
        geo.cell_index(F.col("lat") + 0.025, 37.0, 0.05).alias("j"),
    )
    return rounded(Q.lattice_alignment(rows))


@query
def lattice_steps(spark, sf_dir):
    return rounded(W.distinct_steps(I.cells(spark, sf_dir).withColumn("lon", F.round("lon", 6)), "lon"))


@query
def native_pixels(spark, sf_dir):
    rows = I.cells(spark, sf_dir).withColumn("native", geo.native_cell_id(F.floor(F.col("lon") * 10) / 10, F.floor(F.col("lat") * 10) / 10))
    return rows.groupBy("native").agg(F.count("*").alias("n_cells"))


@query
def block_mean(spark, sf_dir):
    return rounded(P.block_mean(I.cells(spark, sf_dir), "crop_frac", 0.1, 29.975, 37.475).select("i", "j", "crop_frac_mean", "crop_frac_std", "n", "n_masked"))


@query
def bilinear_resample(spark, sf_dir):
    cells = I.cells(spark, sf_dir)
    points = cells.select("cell_id", (F.col("lon") + 0.0125).alias("lon"), (F.col("lat") - 0.0125).alias("lat"))
    masked = F.when(F.col("cell_id") % 3 != 0, F.col("crop_frac"))
    pixels = cells.select("i", (9 - F.col("j")).alias("j"), masked.alias("crop_frac"))
    return rounded(P.bilinear(points, pixels, "crop_frac", 0.05, 29.975, 37.475).select("cell_id", "crop_frac"), 4)


@query
def two_stage_mean(spark, sf_dir):
    return rounded(P.two_stage_mean(I.cells(spark, sf_dir), "crop_frac", 0.05, 0.15, 29.975, 37.475))


@query
def region_mean(spark, sf_dir):
    return rounded(P.region_mean(I.panel(spark, sf_dir), P.analysis_population(I.cells(spark, sf_dir)), "precip"))


@query
def class_share(spark, sf_dir):
    return rounded(I.table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 10).alias("block")).agg(P.class_share(F.col("s_nationkey"), [3, 4, 5]).alias("share")))


@query
def unit_conversions(spark, sf_dir):
    c = F.col("s_acctbal")
    rows = I.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("cell_id"),
        P.kelvin_to_celsius(c).alias("celsius"),
        P.metres_to_mm(c).alias("mm"),
        P.joules_to_megajoules(c * 1e6).alias("mj"),
        P.pascal_to_kpa(c).alias("kpa"),
        P.wind_at_two_metres(c).alias("wind2"),
        P.wind_speed(c, c + 1).alias("speed"),
        P.root_zone(c, c + 1, c + 2).alias("root_zone"),
    )
    return rounded(rows)


@query
def evapotranspiration(spark, sf_dir):
    k = F.col("s_suppkey") % 20
    et = X.reference_evapotranspiration(F.lit(20.0) + k, F.lit(5.0) + k, F.lit(2.0) + k, F.lit(2.0), F.lit(12.0) - k, F.lit(90.0))
    rows = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), et.alias("et"))
    return rounded(rows.select("cell_id", "et.mm", "et.clamped"))


@query
def haversine(spark, sf_dir):
    cells = I.cells(spark, sf_dir)
    pairs = geo.neighbours(cells.select("cell_id", "i", "j"))
    a = cells.select("cell_id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = cells.select(F.col("cell_id").alias("neighbour_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    rows = pairs.join(a, "cell_id").join(b, "neighbour_id")
    km = geo.haversine_km(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    return rounded(rows.select("cell_id", "neighbour_id", km.alias("km")))


@query
def neighbour_edges(spark, sf_dir):
    return geo.neighbours(I.cells(spark, sf_dir).select("cell_id", "i", "j"))


@query
def point_cells(spark, sf_dir):
    points = I.cells(spark, sf_dir).select(F.col("cell_id").alias("station"), (F.col("lon") + 0.01).alias("lon"), (F.col("lat") + 0.01).alias("lat"))
    return rounded(geo.point_to_cell(points, 0.05, 29.975, 37.475).select("station", "cell_id", "km_to_centre"))


@query
def polygon_cells(spark, sf_dir):
    corners = [(30.01, 37.01), (30.41, 37.06), (30.36, 37.41), (30.06, 37.31)]
    return I.cells(spark, sf_dir).filter(geo.in_polygon(F.col("lon"), F.col("lat"), corners)).select("cell_id")


@query
def geojson_features(spark, sf_dir):
    cells = I.cells(spark, sf_dir).select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("crop_frac", 6).alias("crop_frac"))
    made = geo.features(cells, 0.025, ["cell_id", "crop_frac"])
    ring = F.from_json(F.get_json_object("feature", "$.geometry.coordinates[0]"), "array<array<double>>")
    read = made.select(
        F.get_json_object("feature", "$.properties.cell_id").cast("long").alias("cell_id"),
        F.get_json_object("feature", "$.geometry.type").alias("kind"),
        F.get_json_object("feature", "$.properties.crop_frac").cast("double").alias("crop_frac"),
        ring.alias("ring"),
    )
    closed = F.col("ring")[0] == F.col("ring")[4]
    return rounded(read.select("cell_id", "kind", "crop_frac", F.size("ring").alias("n_corners"), closed.alias("closed"), F.col("ring")[0][0].alias("west"), F.col("ring")[2][1].alias("north")))


@query
def stratified_sample(spark, sf_dir):
    rows = P.with_dimension(I.panel(spark, sf_dir), I.cells(spark, sf_dir).select("cell_id", "in_basin"), check=False)
    wanted = rows.filter(F.year("date").isin(1995, 1998, 2001) & F.month("date").isin(1, 7))
    return W.middle_row(wanted, ["date", "in_basin"], ["cell_id"]).select("date", "in_basin", "cell_id", "precip")


@query
def split_counts(spark, sf_dir):
    rows = I.panel(spark, sf_dir).withColumn("split", P.split_label(F.col("date"), I.SPLITS)).filter("split is not null")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query
def epoch_months(spark, sf_dir):
    millis = (F.col("s_suppkey") - 5) * 2_629_800_000
    return I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), year_month(millis).alias("month"))


# windows and features


@query
def rolling_sum_3(spark, sf_dir):
    return I.panel(spark, sf_dir).select("cell_id", "date", W.rolling_sum("precip", 3).alias("sum3"))


@query
def centred_mean_12(spark, sf_dir):
    return rounded(I.panel(spark, sf_dir).select("cell_id", "date", W.centred_mean("precip", 12).alias("mean12")))


@query
def lag_features(spark, sf_dir):
    return rounded(W.lag_features(I.panel(spark, sf_dir), ["precip", "sparse"]))


@query
def lead_label(spark, sf_dir):
    later = W.lead_value("precip", 3)
    return I.panel(spark, sf_dir).select("cell_id", "date", later.alias("future"), W.below(later, I.DRY).cast("double").alias("label"))


@query
def calendar_lag(spark, sf_dir):
    """Dates on which a row lag and a calendar lag differ: none on a full spine."""
    rows = W.calendar_shift(I.panel(spark, sf_dir).select("cell_id", "date", "precip"), "precip", 3, "by_date")
    rows = rows.withColumn("by_row", F.lag("precip", 3).over(W.by_cell()))
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.col("by_row").eqNullSafe(F.col("by_date"))).alias("n_different"))


@query
def cyclic_month(spark, sf_dir):
    return rounded(I.panel(spark, sf_dir).select("date", month_sin(F.col("date")).alias("month_sin"), month_cos(F.col("date")).alias("month_cos")).distinct())


@query
def anomaly(spark, sf_dir):
    inside = (F.col("date") >= F.lit(I.FIT.start)) & (F.col("date") <= F.lit(I.FIT.end))
    return rounded(W.anomaly(I.panel(spark, sf_dir).select("cell_id", "date", "precip"), "precip", inside))


@query
def autocorrelation(spark, sf_dir):
    return rounded(W.autocorrelation(I.panel(spark, sf_dir), ["cell_id"], "precip"))


# annual


@query
def annual_means(spark, sf_dir):
    return rounded(P.annual_means(I.panel(spark, sf_dir), "precip"))


@query
def driest_years(spark, sf_dir):
    return rounded(P.driest_years(P.annual_means(I.panel(spark, sf_dir), "precip"), 4))


@query
def era_means(spark, sf_dir):
    eras = {"first": (1995, 1997), "second": (1998, 2000)}
    return rounded(P.era_means(P.annual_means(I.panel(spark, sf_dir), "precip"), eras, "first"))


@query
def area_checks(spark, sf_dir):
    parts = I.table(spark, sf_dir, "supplier").select((F.col("s_acctbal") + 1000).cast("decimal(18,2)").alias("area_km2"))
    return rounded(P.area_ratio(I.cells(spark, sf_dir), parts, 5500.0))


@query
def published_areas(spark, sf_dir):
    parts = I.table(spark, sf_dir, "supplier").select((F.col("s_acctbal") + 1000).cast("decimal(18,2)").alias("area_km2"))
    return rounded(P.published_ratios(parts, {"atlas": 500000.0, "survey": 560000.0}))


@query
def cross_source_corr(spark, sf_dir):
    rows = I.panel(spark, sf_dir).filter(F.year("date") < 2001)
    second = rows.withColumn("price", F.coalesce("price", F.lit(0.0)) / 1500)
    return rounded(Q.cross_source(P.annual_means(rows, "precip"), P.annual_means(second, "price")), 4)


@query
def population_spread(spark, sf_dir):
    rows = P.with_dimension(I.panel(spark, sf_dir), I.cells(spark, sf_dir), check=False)
    members = {"basin": F.col("in_basin"), "without_lobe": F.col("in_basin") & ~F.col("in_lobe"), "everything": F.lit(True)}
    return rounded(P.population_spread(rows, "precip", members))


@query
def basin_areas(spark, sf_dir):
    parts = I.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("main_basin"), (F.col("s_acctbal") + 1000).cast("decimal(18,2)").alias("area_km2"))
    return rounded(P.area_by_basin(parts).withColumn("area_km2", F.col("area_km2").cast("double")))


# indices


@query
def gamma_params(spark, sf_dir):
    return rounded(X.gamma_fit(X.accumulate(I.panel(spark, sf_dir), "sparse", 1), I.FIT))


@query
def gamma_params_mle(spark, sf_dir):
    return rounded(X.gamma_fit(X.accumulate(I.panel(spark, sf_dir), "precip", 1), I.FIT, estimator="mle").select("cell_id", "month", "q", "shape", "scale"), 4)


def index_of(spark, sf_dir, value: str, months: int) -> DataFrame:
    amounts = X.accumulate(I.panel(spark, sf_dir), value, months)
    return X.spi(amounts, X.gamma_fit(amounts, I.FIT), f"spi_{months}")


@query
def spi_1(spark, sf_dir):
    return rounded(index_of(spark, sf_dir, "precip", 1))


@query
def spi_3(spark, sf_dir):
    return rounded(index_of(spark, sf_dir, "precip", 3))


@query
def spi_6(spark, sf_dir):
    return rounded(index_of(spark, sf_dir, "precip", 6))


@query
def spi_12(spark, sf_dir):
    return rounded(index_of(spark, sf_dir, "precip", 12))


def _sensitivity(spark, sf_dir) -> DataFrame:
    return X.sensitivity(X.gamma_fit(X.accumulate(I.panel(spark, sf_dir), "precip", 1), I.FIT))


@query
def panel_index(spark, sf_dir):
    """The panel with its index and the sensitivity, one to one."""
    rows = I.panel(spark, sf_dir).select("cell_id", "date", "precip")
    joined = X.join_index(rows, index_of(spark, sf_dir, "precip", 1), _sensitivity(spark, sf_dir))
    return rounded(joined.withColumn("mm_per_unit", F.round("mm_per_unit", 4)))


@query
def evaporation_ratio(spark, sf_dir):
    rows = I.panel(spark, sf_dir)
    return rounded(rows.select("cell_id", "date", X.evaporation_ratio(F.col("precip"), 10.0 * (F.month("date") - 1)).alias("ratio")))


@query
def spi_1_sparse(spark, sf_dir):
    return rounded(index_of(spark, sf_dir, "sparse", 1))


@query
def spi_sensitivity(spark, sf_dir):
    return rounded(_sensitivity(spark, sf_dir), 4)


@query
def spei_3(spark, sf_dir):
    rows = I.panel(spark, sf_dir).withColumn("evaporation", F.lit(150.0) + 10 * F.month("date"))
    return rounded(X.spei(rows, "precip", "evaporation", 3, I.FIT, 4), 4)


@query
def normal_quantile(spark, sf_dir):
    p = F.col("s_suppkey") / 2000.0
    return rounded(I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), norm_ppf(p).alias("z")))


@query
def incomplete_gamma(spark, sf_dir):
    a, x = F.lit(0.5) + F.col("s_suppkey") % 50, (F.col("s_suppkey") % 97).cast("double")
    return rounded(I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), gamma_p(a, x).alias("p")))


@query
def unreliable_share(spark, sf_dir):
    flagged = _sensitivity(spark, sf_dir).withColumn("unreliable", X.unreliable(F.col("mm_per_unit"), 50.0))
    return flagged.groupBy("month").agg(F.count_if("unreliable").alias("n_unreliable"), F.count("mm_per_unit").alias("n"))


# baselines


@query
def climatology(spark, sf_dir):
    return rounded(B.climatology(I.panel(spark, sf_dir), "precip", I.FIT))


@query
def climatology_prob(spark, sf_dir):
    return rounded(B.climatology_probability(I.panel(spark, sf_dir), "precip", I.DRY, I.FIT))


@query
def climatology_prob_null_false(spark, sf_dir):
    rows = P.densify(I.source(spark, sf_dir, "R", "amount"), I.START, I.END)
    return rounded(B.climatology_probability(rows, "amount", 60.0, I.FIT, null_as_false=True))


@query
def persistence(spark, sf_dir):
    return B.persistence(I.panel(spark, sf_dir), "precip", 3)


@query
def transition_rates(spark, sf_dir):
    return rounded(B.transition_table(I.panel(spark, sf_dir), "precip", 3, I.DRY, I.FIT, P.analysis_population(I.cells(spark, sf_dir))))


@query
def persistence_prob(spark, sf_dir):
    rows = I.panel(spark, sf_dir)
    return rounded(B.persistence_probability(rows, "precip", 3, I.DRY, B.transition_table(rows, "precip", 3, I.DRY, I.FIT)))


@query
def known_accumulation(spark, sf_dir):
    return rounded(B.known_accumulation(I.panel(spark, sf_dir), "precip", 3, 1, I.FIT))


def _gaps(spark, sf_dir) -> DataFrame:
    """The panel without amounts of some cells' Marches, and so without their climatology."""
    lost = (F.col("cell_id") % 5 == 0) & (F.month("date") == 3)
    return I.panel(spark, sf_dir).withColumn("precip", F.when(~lost, F.col("precip")))


@query
def known_accumulation_gaps(spark, sf_dir):
    return rounded(B.known_accumulation(_gaps(spark, sf_dir), "precip", 3, 2, I.FIT))


@query
def known_accumulation_prob(spark, sf_dir):
    return rounded(B.known_accumulation_probability(_gaps(spark, sf_dir), "precip", 3, 1, 450.0, I.FIT))


@query
def known_accumulation_index(spark, sf_dir):
    """Baselines of a three-month index one month ahead: two months are known."""
    rows = I.panel(spark, sf_dir).join(index_of(spark, sf_dir, "precip", 3), ["cell_id", "date"])
    found = B.build(rows, Target("spi_3", 1), I.FIT, monthly="precip")
    return rounded(found.select("cell_id", "date", "known_accumulation"))


@query
def known_accumulation_full_lead(spark, sf_dir):
    return rounded(B.known_accumulation(I.panel(spark, sf_dir), "precip", 3, 3, I.FIT))


@query
def baseline_table(spark, sf_dir):
    return rounded(forecasts(spark, sf_dir, 3))


# scores


@query
def per_date_regression(spark, sf_dir):
    return rounded(M.regression_by_date(long_forecasts(spark, sf_dir), "actual", "forecast", ["method", "date"]))


@query
def brier_per_date(spark, sf_dir):
    return rounded(M.brier_by_date(long_forecasts(spark, sf_dir), "actual_prob", "prob", ["method", "date"]))


@query
def auc_per_date(spark, sf_dir):
    return rounded(M.auc_by_date(long_forecasts(spark, sf_dir), "actual_prob", "prob", ["method", "date"]))


@query
def undefined_dates(spark, sf_dir):
    """Dates on which the cells of one nation are all dry or all wet, so that AUC is undefined."""
    own = I.cells(spark, sf_dir).filter("nation = 3").select("cell_id")
    rows = P.within(long_forecasts(spark, sf_dir).filter(F.col("method") == "climatology"), own)
    found = M.undefined_dates(M.auc_by_date(rows, "actual_prob", "prob", ["date"], 1), "auc")
    return found.select(F.explode("dates").alias("date"))


@query
def summary_by_method(spark, sf_dir):
    by_date = M.regression_by_date(long_forecasts(spark, sf_dir), "actual", "forecast", ["method", "date"])
    return rounded(M.summarise(by_date, ["mae", "rmse", "r2"], ["method"]))


def _scores(spark, sf_dir, keys: list[str]) -> DataFrame:
    rows = long_forecasts(spark, sf_dir).withColumn("month", F.month("date"))
    by_date = M.regression_by_date(rows, "actual", "forecast", [*keys, "method", "date"])
    means = M.summarise(by_date, ["mae", "rmse"], [*keys, "method"])
    wide = means.groupBy(*keys).agg(*[F.max(F.when(F.col("method") == m, F.col(v))).alias(f"{m}_{v}") for m in ("climatology", "persistence") for v in ("mae", "rmse")])
    skill = [M.skill_score(F.col(f"persistence_{v}"), F.col(f"climatology_{v}")).alias(f"skill_{v}") for v in ("mae", "rmse")]
    return rounded(wide.select("*", *skill))


@query
def skill_scores(spark, sf_dir):
    return _scores(spark, sf_dir, [])


@query
def calendar_month_skill(spark, sf_dir):
    return _scores(spark, sf_dir, ["month"])


@query
def sensitivity_bins(spark, sf_dir):
    rows = long_forecasts(spark, sf_dir)
    table = _sensitivity(spark, sf_dir).filter("mm_per_unit is not null")
    binned = rows.withColumn("month", F.month("date")).join(table, ["cell_id", "month"]).withColumn("bin", M.sensitivity_bin(F.col("mm_per_unit"), (40.0, 60.0, 80.0)))
    by_date = M.regression_by_date(binned, "actual", "forecast", ["bin", "method", "date"], 1)
    return rounded(M.summarise(by_date, ["mae", "rmse"], ["bin", "method"]))


@query
def grouped_scores(spark, sf_dir):
    """MAE by method, by method and month, and in all, by grouping sets."""
    rows = long_forecasts(spark, sf_dir).withColumn("month", F.month("date")).na.drop(subset=["actual", "forecast"])
    out = rows.rollup("method", "month").agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae"), F.count("*").alias("n"))
    return rounded(out)


@query
def scores_by_group(spark, sf_dir):
    """Scores by cell, by land-cover class and by calendar month, in one pass."""
    rows = long_forecasts(spark, sf_dir).withColumn("month", F.month("date"))
    rows = rows.join(I.cells(spark, sf_dir).select("cell_id", F.col("nation").alias("cover")), "cell_id")
    return rounded(E.scores_by_group(rows, ["cell_id", "cover", "month"]))


def _issued(spark, sf_dir, target: Target) -> DataFrame:
    """Predictions by issue date: the mean of the last months, or the share of them that was dry."""
    label, recent = W.lead_value("precip", target.lead_months), W.by_cell().rowsBetween(-2, 0)
    dry = (F.col("precip") < I.DRY).cast("double")
    binary = target.kind == "classification"
    return I.panel(spark, sf_dir).select(
        "cell_id",
        F.col("date").alias("issue_date"),
        F.lit(target.lead_months).alias("lead_months"),
        F.lit(target.name).alias("target"),
        ((label < I.DRY).cast("double") if binary else label).alias("actual"),
        F.avg(dry if binary else F.col("precip")).over(recent).alias("prediction"),
        P.split_label(F.col("date"), I.SPLITS).alias("split"),
    ).filter("actual is not null")


def _target_table(spark, sf_dir, target: Target) -> DataFrame:
    base = B.build(I.panel(spark, sf_dir), target, I.FIT)
    members = P.analysis_population(I.cells(spark, sf_dir))
    return rounded(E.target_table(_issued(spark, sf_dir, target), base, members, target, I.SPLITS["test"], check=False))


@query
def target_table_regression(spark, sf_dir):
    return _target_table(spark, sf_dir, Target("precip", 1))


@query
def target_table_classification(spark, sf_dir):
    return _target_table(spark, sf_dir, Target("precip", 3, "classification", I.DRY))


@query
def signed_rank_ties(spark, sf_dir):
    """Signed ranks of each cell's amounts, in steps of 40, against the year before and the month before: tied, and with zeros."""
    rows = I.panel(spark, sf_dir).withColumn("v", 40 * F.floor(F.col("precip") / 40))
    late = F.col("date") >= F.lit("2000-11-01")
    rows = rows.withColumns({"year": F.when(late, F.col("v") - F.lag("v", 12).over(W.by_cell())), "month": F.col("v") - F.lag("v", 1).over(W.by_cell())})
    kinds = F.array(*[F.struct(F.lit(k).alias("against"), F.col(k).cast("double").alias("d")) for k in ("year", "month")])
    return rounded(E.signed_ranks(rows.select("cell_id", F.explode(kinds).alias("x")).select("cell_id", "x.*").filter("d IS NOT NULL"), ["cell_id", "against"]))


@query
def target_alignment(spark, sf_dir):
    """Dates on which predictions and baselines have different actuals: none."""
    target = Target("precip", 3, "classification", I.DRY)
    rows = E.by_method(_issued(spark, sf_dir, target), B.build(I.panel(spark, sf_dir), target, I.FIT), P.analysis_population(I.cells(spark, sf_dir)), target, I.SPLITS["test"])
    return E.misaligned_dates(rows).agg(F.count("*").alias("n_mismatched"))


@query
def prediction_checks(spark, sf_dir):
    return Q.prediction_checks(_issued(spark, sf_dir, Target("precip", 3, "classification", I.DRY)), "actual", "prediction")


@query
def base_rate(spark, sf_dir):
    return rounded(Q.base_rate(test_rows(forecasts(spark, sf_dir, 3)), "climatology_prob", X.expected_below(-1.0)))


@query
def persistence_order(spark, sf_dir):
    return rounded(Q.persistence_order(forecasts(spark, sf_dir, 3), F.col("persistence") < I.DRY, "persistence_prob"))


@query
def reliability(spark, sf_dir):
    return rounded(M.reliability(long_forecasts(spark, sf_dir).filter(F.col("method") == "climatology"), "actual_prob", "prob", 5))


@query
def verification_alignment(spark, sf_dir):
    rows = test_rows(forecasts(spark, sf_dir, 3))
    issued = I.panel(spark, sf_dir).select(
        "cell_id", F.col("date").alias("issue_date"), F.lit(3).alias("lead_months"), W.lead_value("precip", 3).alias("actual")
    )
    predictions = test_rows(M.issue_to_verification(issued).filter("actual is not null").withColumn("date", F.col("issue_date")))
    kept = M.on_forecast_dates(rows, predictions)
    bad = M.alignment_mismatches(predictions, kept).agg(F.count("*").alias("n_mismatched"))
    return kept.agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).join(F.broadcast(bad))


@query
def paired_series(spark, sf_dir):
    by_date = M.regression_by_date(long_forecasts(spark, sf_dir), "actual", "forecast", ["method", "date"])
    one, two = by_date.filter("method = 'climatology'"), by_date.filter("method = 'persistence'")
    return rounded(M.paired_statistics(M.paired(one, two, "mae")))


# zeros


@query
def zero_clusters(spark, sf_dir):
    return rounded(Z.clusters(I.located(spark, sf_dir), "sparse", 30.0))


@query
def zero_diagnostics(spark, sf_dir):
    return Z.diagnostics(I.located(spark, sf_dir), "sparse", 30.0)


@query
def zero_isolated(spark, sf_dir):
    flagged = Z.flag_isolated(I.located(spark, sf_dir), "sparse", 30.0)
    return flagged.groupBy("date").agg(F.count_if("zero_isolated").alias("n_isolated"), F.count("*").alias("n"))


# model


def _table(spark, sf_dir) -> tuple[DataFrame, Target]:
    target = Target("precip", 1)
    return L.training_table(I.panel(spark, sf_dir), ["precip", "sparse"], target, I.SPLITS), target


@query
def training_rows(spark, sf_dir):
    rows, _ = _table(spark, sf_dir)
    return rounded(rows.groupBy("split").agg(F.count("*").alias("n"), F.avg("actual").alias("mean_actual"), F.min("date").alias("first")))


@query
def static_features(spark, sf_dir):
    """The training table with features of the cells that do not change in time."""
    target = Target("precip", 1)
    fixed = I.cells(spark, sf_dir).select("cell_id", "crop_frac", "lat")
    return rounded(L.training_table(I.panel(spark, sf_dir), ["precip"], target, I.SPLITS, lags=(0, 3), static=fixed).drop("month_sin", "month_cos", "actual_raw"))


@query
def planted_faults(spark, sf_dir):
    """What the checks find where faults were put into their input: check and number."""
    rows, cells = I.panel(spark, sf_dir), I.cells(spark, sf_dir)
    third, february, may = F.col("cell_id") % 3 == 0, F.month("date") == 2, F.month("date") == 5
    found = {}
    other = rows.withColumns({"sparse": F.when(third & february, F.col("sparse") + 1).otherwise(F.col("sparse")), "price": F.when(~may, F.col("price"))})
    columns = ["precip", "sparse", "price", "n_obs"]
    found["digests"] = Q.digest_differences(Q.digest(rows, columns), Q.digest(other, columns)).agg(F.count("*").alias("n"))
    model = rows.select("date", F.lit("model").alias("method"), F.when(third & february, F.col("precip") + 1).otherwise(F.col("precip")).alias("actual"))
    base = rows.filter(~may).select("date", F.lit("climatology").alias("method"), F.col("precip").alias("actual"))
    found["dates"] = E.misaligned_dates(model.unionByName(base)).agg(F.count("*").alias("n"))
    paired = M.alignment_mismatches(
        rows.select("cell_id", F.col("date").alias("verification_date"), F.when(third & february, F.col("precip") + 1).otherwise(F.col("precip")).alias("actual")),
        rows.select("cell_id", "date", F.col("precip").alias("actual")),
    )
    found["pairs"] = paired.agg(F.count("*").alias("n"))
    scored = rows.select(F.when(third, 0.5).otherwise((F.col("precip") < I.DRY).cast("double")).alias("actual"), (F.col("sparse") / 100).alias("prediction"), "price")
    checks = Q.prediction_checks(scored.withColumn("prediction", F.when(F.col("price").isNotNull(), F.col("prediction"))), "actual", "prediction")
    for name in ("n_not_binary", "n_outside", "n_missing"):
        found[name] = checks.select(F.col(name).alias("n"))
    moved = cells.select(F.when(F.col("nation") == 3, F.col("cell_id") + 1).otherwise(F.col("i") * 100_000 + F.col("j")).alias("cell_id"), "i", "j")
    found["wrong_ids"] = Q.lattice_alignment(moved).select(F.col("wrong_ids").alias("n"))
    table = rows.select(P.split_label(F.col("date"), I.SPLITS).alias("split"), "price", F.when(~third, F.col("precip")).alias("x")).filter("split IS NOT NULL")
    found["null_rows"] = Q.row_counts(table, 1, I.SPLITS).agg(F.sum("n_with_null").alias("n"))
    every = [df.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n")) for name, df in found.items()]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out


@query
def short_months(spark, sf_dir):
    """Months of users with fewer than 70 contributing events."""
    return P.incomplete_contributors(I.daily(spark, sf_dir), "user_id", "ts", 70)


# space and time


#: Corners of one region; each nation has it at a place of its own, the even ones with the hole.
OUTER, HOLE, ISLAND = [(0.0, 0.0), (0.4, 0.03), (0.33, 0.4), (0.2, 0.2), (0.05, 0.3)], [(0.1, 0.05), (0.2, 0.06), (0.15, 0.15)], [(0.5, 0.1), (0.6, 0.1), (0.55, 0.2)]


def regions(spark, sf_dir) -> DataFrame:
    """polygon_id and rings: a region of several rings for each nation."""
    n = F.col("n_nationkey")

    def ring(corners):
        return F.array(*[F.array(30.003 + n * 0.017 + x, 37.002 + (n % 7) * 0.02 + y) for x, y in corners])

    rings = F.when(n % 2 == 0, F.array(ring(OUTER), ring(HOLE), ring(ISLAND))).otherwise(F.array(ring(OUTER), ring(ISLAND)))
    return I.table(spark, sf_dir, "nation").select(n.cast("long").alias("polygon_id"), rings.alias("rings"))


@query
def polygon_membership(spark, sf_dir):
    return G.points_in_polygons(I.cells(spark, sf_dir), regions(spark, sf_dir), 0.05)


@query
def station_buffer_means(spark, sf_dir):
    cells = I.cells(spark, sf_dir)
    stations = cells.select(F.col("cell_id").alias("point_id"), (F.col("lon") + 0.013).alias("lon"), (F.col("lat") - 0.007).alias("lat"))
    return rounded(G.buffer_mean(stations, cells, "crop_frac", 8.0))


@query
def reference_periods(spark, sf_dir):
    """Three columns with reference periods and lags of their own."""
    long, short = I.Period(I.START, I.date(1999, 12, 1)), I.Period(I.date(1996, 1, 1), I.date(1999, 12, 1))
    periods = {"long": (long, ["precip", "sparse"]), "short": (short, ["price"])}
    return rounded(V.standardized(I.panel(spark, sf_dir), periods, {"precip": [1, 2, 3, 4, 5, 6], "sparse": [1, 2], "price": [1, 2, 3]}))


@query
def latest_return(spark, sf_dir):
    """Every line with the latest day on which its supplier had a returned line, at most 60 days before."""
    rows = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", F.col("l_shipdate").cast("date").alias("day"))
    back = rows.filter("l_returnflag = 'R'").groupBy("l_suppkey", "day").agg(F.sum("l_quantity").alias("returned"))
    return T.asof_join(rows.drop("l_quantity", "l_returnflag"), back, ["l_suppkey"], "day", ["returned"], span=120, tolerance=60)


@query
def dry_spells_in_transit(spark, sf_dir):
    """Lines whose 45 days after shipping overlap a dry month of their supplier."""
    day = F.col("l_shipdate").cast("date")
    lines = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("cell_id"), day.alias("start"), F.date_add(day, 45).alias("end"))
    dry = I.panel(spark, sf_dir).filter(F.col("precip") < I.DRY).select("cell_id", F.col("date").alias("from"), F.add_months("date", 1).alias("until"))
    return T.overlapping(lines, dry, ["cell_id"], span=45).groupBy("cell_id", "from").agg(F.count("*").alias("n_lines"), F.max("end").alias("last_end"))


@query
def merged_sketches(spark, sf_dir):
    """Distinct orders and median quantity of each nation in the fit period, from monthly states, beside the exact figures."""
    nations = I.cells(spark, sf_dir).select("cell_id", "nation")
    rows = I.lines(spark, sf_dir).join(nations, "cell_id")
    found = K.merged(K.monthly(rows, ["nation"], "l_orderkey", "l_extendedprice"), ["nation"], I.FIT)
    inside = rows.filter((F.col("date") >= F.lit(I.FIT.start)) & (F.col("date") <= F.lit(I.FIT.end)))
    sure = inside.groupBy("nation").agg(
        F.count_distinct("l_orderkey").alias("exact_distinct"),
        *[F.percentile("l_extendedprice", F.lit(q)).alias(name) for q, name in ((0.5 - 2 * K.RANK_ERROR, "low"), (0.5 + 2 * K.RANK_ERROR, "high"))],
    )
    wrong = F.abs(F.col("n_distinct") - F.col("exact_distinct")) > K.DISTINCT_ERROR * F.col("exact_distinct") + 1
    kept = (F.col("q50") >= F.col("low") - 100) & (F.col("q50") <= F.col("high") + 100)
    return found.join(sure, "nation").select("nation", "n", "exact_distinct", (~wrong).alias("distinct_within"), kept.alias("median_within"))


#: Trees and depth in the queries; the README has the time of the full size.
SMALL = {"trees": 10, "depth": 3}


@query
def gbt_scores(spark, sf_dir):
    rows, target = _table(spark, sf_dir)
    rows = L.prepared(rows)
    found = L.predict(L.fit_trees(rows, target, **SMALL), rows, target)
    return found.select("cell_id", "issue_date", "verification_date", "actual", F.round("prediction", 6).alias("prediction"), "split")


@query
def gbt_checks(spark, sf_dir):
    """Rows and actuals of each split of the scores, whether training rows fit better than their mean, and dates that do not fit the lead."""
    found = gbt_scores(spark, sf_dir)
    error, spread = F.col("actual") - F.col("prediction"), F.var_pop("actual")
    late = F.count_if(F.months_between("verification_date", "issue_date") != 1)
    better = F.when(F.col("split") == "train", F.avg(error * error) < spread).alias("fits")
    return rounded(found.groupBy("split").agg(F.count("prediction").alias("n"), F.avg("actual").alias("mean_actual"), late.alias("n_off_lead"), better))


@query
def forecaster_folds(spark, sf_dir):
    """The trees on each fold of spatial blocks, fitted on the other blocks and earlier months; none loses to the mean by three standard errors."""
    rows, target = _table(spark, sf_dir)
    folds = I.cells(spark, sf_dir).select("cell_id", L.spatial_fold(F.col("i"), F.col("j"), 2, 5).alias("fold"))
    found = L.cross_validated_trees(rows.join(folds, "cell_id"), "fold", 5, target, **SMALL)
    return rounded(found.select("fold", "n_train", "n", "mse_mean", (F.col("t") >= -3).alias("bounded")), 4)


@query
def forecaster_permutation(spark, sf_dir):
    """The trees on the labels and on labels shuffled within dates, which they must not forecast.

    A leak shows as skill above 0.05; below zero small tables go by overfitting.
    """
    rows, target = _table(spark, sf_dir)
    found = L.permutation_trees(rows, target, **SMALL)
    without = F.when(F.col("trial") != "real", F.col("skill") < 0.05)
    return rounded(found.select("trial", "n_train", "n", "mse_mean", without.alias("without_skill")), 4)


@query
def split_row_counts(spark, sf_dir):
    """Rows of each split against cells x months: what lags and leads at the ends cost."""
    rows, _ = _table(spark, sf_dir)
    n = I.cells(spark, sf_dir).count()
    return Q.row_counts(rows.select("split", "precip_lag6", "actual"), n, I.SPLITS)


@query
def permutation_control(spark, sf_dir):
    """Skill of a line on the labels, and on labels shuffled within dates, where it must vanish."""
    rows, _ = _table(spark, sf_dir)
    names = ["cell_id", "date", "split", "actual", "precip_lag0"]
    real = L.linear_skill(rows.select(names), "precip_lag0").select(F.lit("real").alias("labels"), "*")
    shuffled = L.linear_skill(L.permuted(rows.select(names)), "precip_lag0").select(F.lit("shuffled").alias("labels"), "*")
    both = real.unionByName(shuffled).select("labels", "n", "mse", "skill", (F.abs("skill") < 0.05).alias("vanishes"))
    return rounded(both, 4)


@query
def spatial_folds(spark, sf_dir):
    """Each fold of spatial blocks, scored by the line of the others."""
    rows, _ = _table(spark, sf_dir)
    folds = I.cells(spark, sf_dir).select("cell_id", L.spatial_fold(F.col("i"), F.col("j"), 2, 5).alias("fold"))
    rows = rows.select("cell_id", "date", "actual", "precip_lag0").join(folds, "cell_id")
    return rounded(L.cross_validated_line(rows, "fold", "precip_lag0"), 4)


# products


@query
def availability_flags(spark, sf_dir):
    rows = R.availability(P.densify(I.source(spark, sf_dir, "R", "amount"), I.START, I.END), ["amount"])
    return rows.groupBy("date").agg(F.count_if("amount_available").alias("n_available"), F.count("*").alias("n"))


@query
def ensemble_statistics(spark, sf_dir):
    """The cells of a nation as members of an ensemble for each month."""
    rows = P.with_dimension(I.panel(spark, sf_dir).select("cell_id", "date", "precip"), I.cells(spark, sf_dir).select("cell_id", "nation"), check=False)
    return rounded(R.ensemble(rows, ["nation", "date"], "precip"))


@query
def forecast_bias(spark, sf_dir):
    """Bias of persistence by calendar month, and what is left of it after the correction."""
    rows = forecasts(spark, sf_dir, 3)
    own, truth = rows.select("cell_id", "date", F.col("persistence").alias("v")), rows.select("cell_id", "date", F.col("actual").alias("v"))
    month = F.month("date").alias("month")
    bias = R.bias_table(own, truth, ["cell_id", "date"], "v", [month])
    left = R.bias_table(R.unbiased(own.withColumn("month", F.month("date")), bias, ["month"], "v"), truth, ["cell_id", "date"], "v", [month])
    return rounded(bias.join(left.select("month", F.col("bias").alias("left")), "month"))


@query
def cross_calibration(spark, sf_dir):
    one, two = I.source(spark, sf_dir, "R", "v"), I.source(spark, sf_dir, "A", "v")
    return rounded(R.cross_calibration(one, two, ["cell_id", "date"], "v"))


@query
def effective_cells(spark, sf_dir):
    native = geo.native_cell_id(F.floor(F.col("lon") * 10) / 10, F.floor(F.col("lat") * 10) / 10)
    cells = I.cells(spark, sf_dir).select("cell_id", native.alias("native"))
    return R.effective_cells(I.panel(spark, sf_dir).select("cell_id", "date").join(cells, "cell_id"), "native")


@query
def product_views(spark, sf_dir):
    """A map of an observation, one of a forecast, and a source too coarse for any map."""
    layers = [R.Layer("precip", "observation", 0.05), R.Layer("sparse", "forecast", 0.1), R.Layer("price", "observation", 3.0)]
    return rounded(R.product_views(I.panel(spark, sf_dir), layers, 0.05, 5.0))


@query
def skill_geojson(spark, sf_dir):
    """The skill map of persistence against climatology, read back from its features."""
    cells = I.cells(spark, sf_dir)
    made = R.skill_features(cells, R.skill_map(long_forecasts(spark, sf_dir), "climatology"), 0.05, 0.1)
    kinds = {"method": "string", "n_dates": "long", "skill": "double", "has_skill": "boolean", "layer": "string", "resolution_degrees": "double", "source_degrees": "double"}
    return rounded(made.select("cell_id", *[F.get_json_object("feature", f"$.properties.{c}").cast(t).alias(c) for c, t in kinds.items()]))


@query
def source_coverage(spark, sf_dir):
    """Range and columns of three sources, one of them under its second name, one without a column it should have, one not there."""
    sources = [
        N.Source("lines", ("no_such_table", "lineitem"), "l_shipdate", ("l_quantity",)),
        N.Source("orders", ("orders",), "o_orderdate", ("o_totalprice", "o_band"), core=False),
        N.Source("events", ("events",), "ts", ("value",)),
        N.Source("gauges", ("no_such_table",), "day"),
    ]
    found = N.probe_sources(sources, lambda name: I.table(spark, sf_dir, name), I.START, I.END)
    return found.withColumn("missing", F.array_join("missing", ","))


def flagship(spark, sf_dir) -> DataFrame:
    """Skill of persistence against climatology over the test dates, all cells."""
    return skill_scores(spark, sf_dir)
