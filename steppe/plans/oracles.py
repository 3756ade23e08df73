"""DuckDB SQL of the queries, on the same tables."""

from __future__ import annotations

from steppe.functions.distributions import CENTRE, MIDDLE, TAIL

BASE = """
base AS (
  SELECT l_suppkey AS cell_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
    SUM(l_quantity) AS precip, SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS sparse,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, COUNT(*) AS n_obs
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2001-11-01' GROUP BY 1, 2),
months AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-10-01', INTERVAL 1 MONTH)) AS DATE) AS date),
panel AS (
  SELECT c.cell_id, m.date, COALESCE(b.precip, 0.0) AS precip, COALESCE(b.sparse, 0.0) AS sparse, b.price AS price, COALESCE(b.n_obs, 0) AS n_obs
  FROM (SELECT DISTINCT cell_id FROM base) c CROSS JOIN months m LEFT JOIN base b ON b.cell_id = c.cell_id AND b.date = m.date)
"""
CELLS = """
cells AS (
  SELECT s_suppkey AS cell_id, CAST(FLOOR(s_suppkey / 10.0) AS BIGINT) AS i, s_suppkey % 10 AS j,
    30 + FLOOR(s_suppkey / 10.0) * 0.05 AS lon, 37 + (s_suppkey % 10) * 0.05 AS lat,
    (s_acctbal + 1000) / 11000 AS crop_frac, s_nationkey < 20 AS in_basin, s_nationkey % 7 = 0 AS in_lobe, s_nationkey AS nation
  FROM supplier),
population AS (SELECT cell_id FROM cells WHERE in_basin AND NOT in_lobe AND crop_frac >= 0.5)
"""


def source(flag: str, name: str) -> str:
    return f"""
  SELECT l_suppkey AS cell_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, SUM(l_quantity) AS {name}
  FROM lineitem WHERE l_returnflag = '{flag}' AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2001-11-01' GROUP BY 1, 2"""


OUTER = f"""
returned_source AS ({source("R", "returned")}),
kept_source AS ({source("N", "kept")}),
joined AS (
  SELECT COALESCE(a.cell_id, b.cell_id) AS cell_id, COALESCE(a.date, b.date) AS date, a.returned, b.kept
  FROM returned_source a FULL OUTER JOIN kept_source b ON a.cell_id = b.cell_id AND a.date = b.date)
"""
GAPPY = f"""
gappy AS (
  SELECT c.cell_id, m.date, r.amount
  FROM (SELECT DISTINCT cell_id FROM ({source("R", "amount")})) c
  CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-10-01', INTERVAL 1 MONTH)) AS DATE) AS date) m
  LEFT JOIN ({source("R", "amount")}) r ON r.cell_id = c.cell_id AND r.date = m.date)
"""
FIT = "date BETWEEN DATE '1995-01-01' AND DATE '1999-12-01'"
TEST = "date BETWEEN DATE '2001-01-01' AND DATE '2001-10-01'"
#: Two-sided p of signed ranks by counting all 2^n sign patterns; ks are the doubled ranks.
MASKS = "least(1.0, 2 * list_sum(list_transform(range(CAST(2 ** len(ks) AS BIGINT)), lambda mask: CASE WHEN list_sum(list_transform(ks, lambda k, j: CASE WHEN (mask >> (j - 1)) & 1 = 1 THEN k ELSE 0 END)) <= low THEN 1 ELSE 0 END)) / 2 ** len(ks))"
W = "OVER (PARTITION BY cell_id ORDER BY date)"


def shifted(months: int) -> str:
    return f"CAST(date + INTERVAL {months} MONTH AS DATE)"


def poly(x: str, coefficients) -> str:
    total = repr(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        total = f"({total} * {x} + {float(c)!r}::DOUBLE)"
    return total


def norm_ppf(p: str) -> str:
    """The quantile of a column or literal that is cheap to repeat."""
    q = f"({p} - 0.5)"
    r = f"(0.180625 - {q} * {q})"
    t = f"sqrt(-ln(least({p}, 1 - {p})))"
    near, far = f"({t} - 1.6)", f"({t} - 5.0)"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {poly(r, CENTRE[0])} / {poly(r, CENTRE[1])} "
        f"WHEN {t} <= 5 THEN sign({q}) * {poly(near, MIDDLE[0])} / {poly(near, MIDDLE[1])} "
        f"ELSE sign({q}) * {poly(far, TAIL[0])} / {poly(far, TAIL[1])} END"
    )


def gamma_p(a: str, x: str, terms: int = 1500) -> str:
    return (
        f"CASE WHEN {x} <= 0 THEN 0.0 ELSE least(1.0, list_sum(list_transform(range({terms}), "
        f"lambda k: exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1))))) END"
    )


def fit(value: str, months: int) -> str:
    amount = value if months == 1 else (
        f"CASE WHEN COUNT({value}) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN {months - 1} PRECEDING AND CURRENT ROW) = {months} "
        f"THEN SUM({value}) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN {months - 1} PRECEDING AND CURRENT ROW) END"
    )
    return f"""
amounts AS (SELECT cell_id, date, CAST(month(date) AS INTEGER) AS month, {amount} AS amount FROM panel),
stats AS (
  SELECT cell_id, month, COUNT(amount) AS n, COUNT(CASE WHEN amount > 0 THEN 1 END) AS n_positive,
    COUNT(CASE WHEN amount = 0 THEN 1 END) / COUNT(amount) AS share_zero,
    AVG(CASE WHEN amount > 0 THEN amount END) AS mean, AVG(ln(CASE WHEN amount > 0 THEN amount END)) AS mean_log
  FROM amounts WHERE {FIT} AND amount IS NOT NULL GROUP BY 1, 2),
fits AS (
  SELECT cell_id, month, n, n_positive, mean, share_zero,
    CASE WHEN n >= 5 AND n_positive >= 5 AND ln(mean) - mean_log > 1e-12 THEN ln(mean) - mean_log END AS s FROM stats),
params AS (
  SELECT cell_id, month, n, n_positive, CASE WHEN s IS NOT NULL THEN share_zero END AS q,
    (1 + sqrt(1 + 4 * s / 3)) / (4 * s) AS shape, mean / ((1 + sqrt(1 + 4 * s / 3)) / (4 * s)) AS scale, mean, s FROM fits)
"""


def spi(value: str, months: int) -> str:
    return f"""WITH {BASE}, {fit(value, months)},
h AS (
  SELECT a.cell_id, a.date, p.q + (1 - p.q) * ({gamma_p("p.shape", "(a.amount / p.scale)")}) AS h
  FROM amounts a LEFT JOIN params p ON a.cell_id = p.cell_id AND a.month = p.month),
inside AS (SELECT cell_id, date, CASE WHEN h IS NOT NULL THEN greatest(1e-9::DOUBLE, least(1 - 1e-9::DOUBLE, h)) END AS p FROM h),
z AS (SELECT cell_id, date, CASE WHEN p IS NOT NULL THEN {norm_ppf("p")} END AS z FROM inside)
SELECT cell_id, date, CASE WHEN z IS NOT NULL THEN round(greatest(-4.0::DOUBLE, least(4.0::DOUBLE, z)), 6) END AS spi_{months} FROM z"""


def baselines(lead: int) -> str:
    """CTE `baselines` with all methods of the dense series."""
    return f"""
clim AS (SELECT cell_id, month(date) AS m, AVG(precip) AS climatology, AVG(CASE WHEN precip < 150 THEN 1.0 ELSE 0.0 END) AS climatology_prob
  FROM panel WHERE {FIT} GROUP BY 1, 2),
pairs AS (SELECT date, precip < 150 AS now, CASE WHEN LEAD(precip, {lead}) {W} < 150 THEN 1.0 WHEN LEAD(precip, {lead}) {W} IS NOT NULL THEN 0.0 END AS future FROM panel),
rates AS (SELECT now, AVG(future) AS rate, COUNT(*) AS n FROM pairs
  WHERE date >= DATE '1995-01-01' AND {shifted(lead)} <= DATE '1999-12-01' AND future IS NOT NULL GROUP BY 1),
lagged AS (SELECT cell_id, date, precip AS actual, LAG(precip, {lead}) {W} AS persistence FROM panel),
baselines AS (
  SELECT l.cell_id, l.date, l.actual, l.persistence, c.climatology, c.climatology_prob, r.rate AS persistence_prob,
    CASE WHEN l.actual < 150 THEN 1.0 ELSE 0.0 END AS actual_prob
  FROM lagged l LEFT JOIN clim c ON c.cell_id = l.cell_id AND c.m = month(l.date) LEFT JOIN rates r ON r.now = (l.persistence < 150))
"""


LONG = f"""
long AS (
  SELECT cell_id, date, CAST(month(date) AS INTEGER) AS month, actual, actual_prob, 'climatology' AS method, climatology AS forecast, climatology_prob AS prob FROM baselines WHERE {TEST}
  UNION ALL
  SELECT cell_id, date, CAST(month(date) AS INTEGER), actual, actual_prob, 'persistence', persistence, persistence_prob FROM baselines WHERE {TEST})
"""
SCORED = f"WITH {BASE}, {baselines(1)}, {LONG}"
REGRESSION = """COUNT(*) AS n, AVG(abs(actual - forecast)) AS mae, sqrt(AVG((actual - forecast) ** 2)) AS rmse,
    CASE WHEN MIN(actual) < MAX(actual) THEN 1 - SUM((actual - forecast) ** 2) / (VAR_POP(actual) * COUNT(*)) END AS r2"""


def by_date(keys: str, rows: str = "long", least: int = 10) -> str:
    return f"""
by_date AS (SELECT {keys}, {REGRESSION} FROM {rows} WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY {keys} HAVING COUNT(*) >= {least})
"""


def skill(keys: str) -> str:
    own, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    columns = ", ".join(
        f"MAX(CASE WHEN method = '{m}' THEN {v} END) AS {m}_{v}" for m in ("climatology", "persistence") for v in ("mae", "rmse")
    )
    shown = ", ".join(f"round({m}_{v}, 6) AS {m}_{v}" for m in ("climatology", "persistence") for v in ("mae", "rmse"))
    scores = ", ".join(f"round(1 - persistence_{v} / NULLIF(climatology_{v}, 0), 6) AS skill_{v}" for v in ("mae", "rmse"))
    return f"""{SCORED}, {by_date(own + "method, date")},
means AS (SELECT {own}method, AVG(mae) AS mae, AVG(rmse) AS rmse FROM by_date GROUP BY {own}method),
wide AS (SELECT {own}{columns} FROM means{group})
SELECT {own}{shown}, {scores} FROM wide"""


ZEROS = f"""WITH RECURSIVE {BASE},
located AS (SELECT cell_id, date, CAST(FLOOR(cell_id / 10.0) AS BIGINT) AS i, cell_id % 10 AS j, sparse AS v FROM panel),
zeros AS (SELECT * FROM located WHERE v = 0),
edges AS (SELECT a.date, a.cell_id, b.cell_id AS other FROM zeros a JOIN zeros b ON a.date = b.date AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND a.cell_id <> b.cell_id),
reach AS (SELECT date, cell_id, cell_id AS other FROM zeros UNION SELECT r.date, r.cell_id, e.other FROM reach r JOIN edges e ON e.date = r.date AND e.cell_id = r.other),
comps AS (SELECT date, cell_id, MIN(other) AS component FROM reach GROUP BY 1, 2),
ring AS (
  SELECT c.date, c.component, MIN(p.v) AS boundary_min FROM comps c JOIN zeros z ON z.date = c.date AND z.cell_id = c.cell_id
  JOIN located p ON p.date = c.date AND p.v > 0 AND abs(p.i - z.i) <= 1 AND abs(p.j - z.j) <= 1 GROUP BY 1, 2),
clusters AS (
  SELECT s.date, s.component, s.size, r.boundary_min, COALESCE(r.boundary_min > 30, FALSE) AS artefact
  FROM (SELECT date, component, COUNT(*) AS size FROM comps GROUP BY 1, 2) s LEFT JOIN ring r ON r.date = s.date AND r.component = s.component)
"""
NEIGHBOURS = f"""WITH {CELLS},
pairs AS (SELECT a.cell_id, b.cell_id AS neighbour_id, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2
  FROM cells a JOIN cells b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND a.cell_id <> b.cell_id)
"""


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"2 * 6371.0 * asin(sqrt(sin((radians({lat2}) - radians({lat1})) / 2) ** 2 + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * sin((radians({lon2}) - radians({lon1})) / 2) ** 2))"
    )


def crossing(corners: list[tuple[float, float]]) -> str:
    parts = [
        f"CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END"
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True)
    ]
    return f"({' + '.join(parts)}) % 2 = 1"


def digest_row(side: str, rows: str) -> str:
    return f"""SELECT '{side}' AS side, CAST(SUM(CAST(precip AS BIGINT) * (cell_id * 1000 + year(date) * 12 + month(date))) AS BIGINT) AS digest, COUNT(precip) AS n FROM {rows}"""


LAGS = ", ".join(f"LAG({c}, {k}) {W} AS {c}_lag{k}" for c in ("precip", "sparse") for k in (0, 1, 2, 3, 6))
ANNUAL = "annual AS (SELECT year, AVG(total) AS annual_mean, COUNT(*) AS n_cells FROM (SELECT cell_id, CAST(year(date) AS INTEGER) AS year, SUM(precip) AS total FROM panel GROUP BY 1, 2) GROUP BY 1)"
def _region_edges() -> str:
    from steppe.plans.queries import HOLE, ISLAND, OUTER

    def sides(corners: list[tuple[float, float]], which: str) -> str:
        return ", ".join(f"({a}, {b}, {c}, {d}, {which})" for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True))

    x, y = "30.003::DOUBLE + n_nationkey * 0.017::DOUBLE + {}::DOUBLE", "37.002::DOUBLE + (n_nationkey % 7) * 0.02::DOUBLE + {}::DOUBLE"
    ends = ", ".join(f"{f.format(c)} AS {c}" for f, c in ((x, "x1"), (y, "y1"), (x, "x2"), (y, "y2")))
    return f"""sides AS (SELECT * FROM (VALUES {sides(OUTER, "FALSE")}, {sides(HOLE, "TRUE")}, {sides(ISLAND, "FALSE")}) v(x1, y1, x2, y2, hole)),
edges AS (SELECT CAST(n_nationkey AS BIGINT) AS polygon_id, {ends} FROM nation, sides WHERE NOT hole OR n_nationkey % 2 = 0)"""


REGION_EDGES = _region_edges()

TRAINING = f"""WITH {BASE},
features AS (SELECT cell_id, date, LAG(precip, 6) {W} AS oldest, LEAD(precip, 1) {W} AS actual,
  CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1999-12-01' THEN 'train' WHEN date BETWEEN DATE '2000-04-01' AND DATE '2000-09-01' THEN 'validation'
    WHEN date BETWEEN DATE '2001-01-01' AND DATE '2001-10-01' THEN 'test' END AS split FROM panel),
kept AS (SELECT * FROM features WHERE split IS NOT NULL AND oldest IS NOT NULL AND actual IS NOT NULL)
"""

SPEI = f"""WITH {BASE},
balance AS (SELECT cell_id, date, precip - (150.0 + 10 * month(date)) AS b FROM panel),
amounts AS (SELECT cell_id, date, month(date) AS m, CASE WHEN COUNT(b) OVER w = 3 THEN SUM(b) OVER w END AS amount FROM balance
  WINDOW w AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id, m ORDER BY amount, date) AS k, COUNT(*) OVER (PARTITION BY cell_id, m) AS n FROM amounts WHERE {FIT} AND amount IS NOT NULL),
moments AS (SELECT cell_id, m, AVG(amount) AS w0, AVG(amount * (n - k) / (n - 1)) AS w1, AVG(amount * (n - k) * (n - k - 1) / ((n - 1) * (n - 2))) AS w2 FROM ranked WHERE n >= 4 GROUP BY 1, 2),
shapes AS (SELECT *, (2 * w1 - w0) / NULLIF(6 * w1 - w0 - 6 * w2, 0) AS beta FROM moments),
gammas AS (SELECT *, exp(lgamma(1 + 1 / beta) + lgamma(1 - 1 / beta)) AS g FROM shapes WHERE beta > 1 AND beta < 1000),
fitted AS (SELECT cell_id, m, beta, (w0 - 2 * w1) * beta / g AS alpha, w0 - (w0 - 2 * w1) * beta AS xi FROM gammas),
h AS (SELECT a.cell_id, a.date, CASE WHEN f.alpha > 0 AND a.amount > f.xi THEN 1 / (1 + pow(f.alpha / (a.amount - f.xi), f.beta)) WHEN f.alpha > 0 AND a.amount <= f.xi THEN 0.0 END AS h
  FROM amounts a LEFT JOIN fitted f ON f.cell_id = a.cell_id AND f.m = a.m),
inside AS (SELECT cell_id, date, CASE WHEN h IS NOT NULL THEN greatest(1e-9::DOUBLE, least(1 - 1e-9::DOUBLE, h)) END AS p FROM h)
SELECT cell_id, date, CASE WHEN p IS NOT NULL THEN round({norm_ppf("p")}, 4) END AS spei_3 FROM inside"""


def known(months: int, lead: int, value: str = "precip") -> str:
    """CTE `known`: what is observed plus the climatology of the months to come."""
    overlap = months - lead
    observed = f"OVER (PARTITION BY g.cell_id ORDER BY g.date ROWS BETWEEN {months - 1} PRECEDING AND {lead} PRECEDING)"
    ahead = f"OVER (PARTITION BY g.cell_id ORDER BY g.date ROWS BETWEEN {lead - 1} PRECEDING AND CURRENT ROW)"
    return f"""
mu AS (SELECT cell_id, month(date) AS m, AVG({value}) AS mu FROM gaps WHERE {FIT} GROUP BY 1, 2),
known AS (SELECT g.cell_id, g.date, CASE WHEN COUNT({value}) {observed} = {overlap} THEN SUM({value}) {observed} END
    + CASE WHEN COUNT(mu.mu) {ahead} = {lead} THEN SUM(mu.mu) {ahead} END AS amount
  FROM gaps g LEFT JOIN mu ON mu.cell_id = g.cell_id AND mu.m = month(g.date))"""


GAPS = "gaps AS (SELECT cell_id, date, CASE WHEN NOT (cell_id % 5 = 0 AND month(date) = 3) THEN precip END AS precip FROM panel)"

#: Quantiles by halving an interval, so unlike the Newton steps of the library.
SENSITIVITY = f"""WITH RECURSIVE {BASE}, {fit("precip", 1)},
wanted AS (SELECT cell_id, month, shape, scale, q, p, CASE WHEN q < p THEN (p - q) / (1 - q) END AS u
  FROM params, (VALUES (0.5::DOUBLE), (0.15865525393145707::DOUBLE)) v(p) WHERE shape IS NOT NULL),
halves AS (
  SELECT cell_id, month, p, shape, scale, u, 0.0::DOUBLE AS lo, (shape + 20 * sqrt(shape) + 20)::DOUBLE AS hi, 0 AS k FROM wanted WHERE u IS NOT NULL
  UNION ALL
  SELECT cell_id, month, p, shape, scale, u, CASE WHEN f < u THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < u THEN hi ELSE (lo + hi) / 2 END, k + 1
  FROM (SELECT *, {gamma_p("shape", "((lo + hi) / 2)", 1200)} AS f FROM halves WHERE k < 40)),
sens AS (SELECT s.cell_id, s.month, CASE WHEN s.shape IS NOT NULL THEN
    COALESCE(MAX(CASE WHEN h.p = 0.5 THEN h.lo * h.scale END), 0) - COALESCE(MAX(CASE WHEN h.p < 0.5 THEN h.lo * h.scale END), 0) END AS mm_per_unit
  FROM params s LEFT JOIN halves h ON h.cell_id = s.cell_id AND h.month = s.month AND h.k = 40 GROUP BY s.cell_id, s.month, s.shape)"""

MLE = f"""WITH RECURSIVE {BASE}, {fit("precip", 1)},
halves AS (
  SELECT cell_id, month, s, ln(shape) - 2 AS lo, ln(shape) + 2 AS hi, 0 AS k FROM params WHERE s IS NOT NULL
  UNION ALL
  SELECT cell_id, month, s, CASE WHEN f > s THEN mid ELSE lo END, CASE WHEN f > s THEN hi ELSE mid END, k + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, exp((lo + hi) / 2) AS a, exp((lo + hi) / 2) + 12 AS b,
      (lo + hi) / 2 - (ln(b) - 1 / (2 * b) - 1 / (12 * b ** 2) + 1 / (120 * b ** 4) - 1 / (252 * b ** 6) - list_sum(list_transform(range(12), lambda i: 1 / (a + i)))) AS f
    FROM halves WHERE k < 60))
SELECT p.cell_id, CAST(p.month AS INTEGER) AS month, round(p.q, 4) AS q, round(exp(h.lo), 4) AS shape, round(p.mean / exp(h.lo), 4) AS scale
FROM params p LEFT JOIN halves h ON h.cell_id = p.cell_id AND h.month = p.month AND h.k = 60"""


def target_sql(lead: int, binary: bool) -> str:
    """The table of a target; tests by integration, gamma functions and all patterns of signs."""
    actual = f"CASE WHEN LEAD(precip, {lead}) {W} < 150 THEN 1.0 WHEN LEAD(precip, {lead}) {W} IS NOT NULL THEN 0.0 END" if binary else f"LEAD(precip, {lead}) {W}"
    recent = "CASE WHEN precip < 150 THEN 1.0 ELSE 0.0 END" if binary else "precip"
    end = "_prob" if binary else ""
    base = ", ".join(f"('{m}', b.{c}{end})" for m, c in (("climatology", "climatology"), ("persistence", "persistence"), ("known_accumulation", "climatology")))
    if binary:
        by = f"""brier AS (SELECT method, date, COUNT(*) AS n, AVG((forecast - actual) ** 2) AS brier FROM long WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 10),
ranked AS (SELECT *, RANK() OVER (PARTITION BY method, date ORDER BY forecast) + (COUNT(*) OVER (PARTITION BY method, date, forecast) - 1) / 2 AS r FROM long WHERE actual IS NOT NULL AND forecast IS NOT NULL),
areas AS (SELECT method, date, CASE WHEN SUM(actual) > 0 AND SUM(actual) < COUNT(*) THEN (SUM(CASE WHEN actual = 1 THEN r ELSE 0 END) - SUM(actual) * (SUM(actual) + 1) / 2) / (SUM(actual) * (COUNT(*) - SUM(actual))) END AS auc FROM ranked GROUP BY 1, 2),
by_date AS (SELECT b.*, a.auc FROM brier b LEFT JOIN areas a ON a.method = b.method AND a.date = b.date)"""
        metrics, main, other = ["brier", "auc"], "brier", "auc"
    else:
        by, metrics, main, other = by_date("method, date").strip(), ["mae", "rmse", "r2"], "mae", "r2"
    means = ", ".join(f"AVG({m}) AS {m}, COUNT(*) - COUNT({m}) AS {m}_undefined" for m in metrics)
    shown = ", ".join(f"round(t.{m}, 6) AS {m}, t.{m}_undefined" for m in metrics)
    skill_of = ", ".join(f"CASE WHEN x.method <> 'model' THEN round(1 - o.{m} / NULLIF(t.{m}, 0), 6) END AS model_skill_{m}" for m in metrics if m != other)
    return f"""WITH {BASE}, {CELLS}, {baselines(lead)},
issued AS (SELECT cell_id, date AS issue_date, {shifted(lead)} AS date, {actual} AS actual, AVG({recent}) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS forecast FROM panel),
model AS (SELECT * FROM issued WHERE actual IS NOT NULL AND issue_{TEST} AND {TEST} AND cell_id IN (SELECT cell_id FROM population)),
long AS (SELECT 'model' AS method, date, actual, forecast FROM model UNION ALL
  SELECT v.method, b.date, b.actual{end}, v.forecast FROM baselines b, LATERAL (VALUES {base}) v(method, forecast)
  WHERE b.date IN (SELECT DISTINCT date FROM model) AND b.cell_id IN (SELECT cell_id FROM population)),
{by},
sums AS (SELECT method, COUNT(*) AS n_dates, {means} FROM by_date GROUP BY 1),
d AS (SELECT b.method, b.date, b.{main} - m.{main} AS d FROM by_date b JOIN by_date m ON m.date = b.date AND m.method = 'model' WHERE b.method <> 'model' AND b.{main} IS NOT NULL AND m.{main} IS NOT NULL),
r AS (SELECT *, lag(d) OVER (PARTITION BY method ORDER BY date) AS before, CASE WHEN d <> 0 THEN 2 * RANK() OVER (PARTITION BY method, d <> 0 ORDER BY round(abs(d), 12)) + COUNT(*) OVER (PARTITION BY method, d <> 0, round(abs(d), 12)) - 1 END AS k FROM d),
s AS (SELECT method, COUNT(*) AS n, AVG(d) AS m, STDDEV_SAMP(d) AS sd, COUNT(*) FILTER (WHERE d > 0) AS wins, COUNT(*) FILTER (WHERE d < 0) AS losses, MAX(abs(d)) < 1e-12 AS identical,
  CASE WHEN COUNT(*) > 3 AND STDDEV_SAMP(d) > 0 THEN CORR(d, before) END AS lag1_r, list(k) FILTER (WHERE k IS NOT NULL) AS ks, COALESCE(SUM(CASE WHEN d > 0 THEN k END), 0) AS w FROM r GROUP BY 1),
u AS (SELECT *, n >= 5 AND NOT identical AS ok, CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) END AS t, CAST(least(w, list_sum(ks) - w) AS BIGINT) AS low FROM s),
p AS (SELECT method, n, m, wins, losses, identical, CASE WHEN ok THEN lag1_r END AS lag1_r, CASE WHEN ok THEN t END AS t,
  CASE WHEN ok THEN list_sum(list_transform(range(4000), lambda k: cos(atan(abs(t) / sqrt(n - 1)) + (k + 0.5) * (pi() / 2 - atan(abs(t) / sqrt(n - 1))) / 4000) ** (n - 2))) * (pi() / 2 - atan(abs(t) / sqrt(n - 1)))
    / (list_sum(list_transform(range(4000), lambda k: cos((k + 0.5) * pi() / 8000) ** (n - 2))) * pi() / 2) END AS p_t,
  CASE WHEN ok AND wins + losses > 0 THEN least(1.0, 2 * list_sum(list_transform(range(least(wins, losses) + 1), lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))))) END AS p_sign,
  CASE WHEN ok AND len(ks) > 0 THEN {MASKS} END AS p_wilcoxon
  FROM u)
SELECT x.method, 'precip' AS target, {lead} AS lead_months, COALESCE(t.n_dates, 0) AS n_dates, {shown}, {skill_of},
  CASE WHEN x.method <> 'model' THEN round(o.{other} - t.{other}, 6) END AS {other}_difference, p.n AS n_pairs, round(p.m, 6) AS mean_difference, p.wins, p.losses, p.identical,
  round(p.t, 6) AS t, round(p.p_t, 6) AS p_t, round(CAST(p.p_sign AS DOUBLE), 6) AS p_sign, round(CAST(p.p_wilcoxon AS DOUBLE), 6) AS p_wilcoxon, round(p.lag1_r, 6) AS lag1_r
FROM (VALUES ('model'), ('climatology'), ('persistence'), ('known_accumulation'), ('ensemble_raw')) x(method)
LEFT JOIN sums t ON t.method = x.method LEFT JOIN sums o ON o.method = 'model' LEFT JOIN p ON p.method = x.method"""


TABLE = f"""WITH {BASE}, {CELLS},
features AS (SELECT cell_id, date, precip AS lag0, LAG(precip, 6) {W} AS oldest, LEAD(precip, 1) {W} AS actual,
  CASE WHEN {FIT} THEN 'train' WHEN date BETWEEN DATE '2000-04-01' AND DATE '2000-09-01' THEN 'validation' WHEN {TEST} THEN 'test' END AS split FROM panel),
kept AS (SELECT * FROM features WHERE split IS NOT NULL AND oldest IS NOT NULL AND actual IS NOT NULL)"""


def line_skill(rows: str, name: str) -> str:
    return f"""SELECT '{name}' AS labels, COUNT(*) AS n, AVG((t.actual - (l.b + l.a * t.lag0)) ** 2) AS mse, AVG((t.actual - l.mean) ** 2) AS naive
      FROM {rows} t, (SELECT regr_slope(actual, lag0) AS a, regr_intercept(actual, lag0) AS b, AVG(actual) AS mean FROM {rows} WHERE split = 'train') l WHERE t.split = 'test'"""


ORACLES = {
    "monthly_panel": f"WITH {BASE} SELECT cell_id, date, precip, sparse, n_obs FROM panel",
    "month_spine": f"WITH {GAPPY} SELECT date, COUNT(*) AS n_cells, COUNT(*) - COUNT(amount) AS n_missing FROM gappy GROUP BY 1",
    "daily_accumulation": """SELECT user_id AS cell_id, CAST(date_trunc('month', ts) AS DATE) AS date, round(CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS total, COUNT(*) AS n_obs
      FROM events GROUP BY 1, 2""",
    "population": f"WITH {CELLS} SELECT cell_id FROM population",
    "full_outer_join": f"WITH {OUTER} SELECT * FROM joined",
    "dimension_join": f"WITH {BASE}, {CELLS} SELECT p.cell_id, p.date, round(p.precip, 6) AS precip, c.nation, round(c.crop_frac, 6) AS crop_frac, c.in_basin FROM panel p LEFT JOIN cells c ON c.cell_id = p.cell_id",
    "membership": f"WITH {CELLS} SELECT cell_id, cell_id IN (SELECT cell_id FROM population) AS is_member FROM cells",
    "population_panel": f"WITH {BASE}, {CELLS} SELECT cell_id, date, precip FROM panel WHERE cell_id IN (SELECT cell_id FROM population)",
    "key_audit": f"""WITH {OUTER},
      one_side AS (SELECT 'left' AS side, COUNT(*) AS n FROM joined WHERE kept IS NULL UNION ALL SELECT 'right', COUNT(*) FROM joined WHERE returned IS NULL)
      SELECT side, n FROM one_side WHERE n > 0
      UNION ALL SELECT 'repeated', CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1""",
    "null_audit": f"""WITH {OUTER}
      SELECT 'returned' AS "column", COUNT(*) - COUNT(returned) AS n_null, MIN(returned) AS minimum, MAX(returned) AS maximum FROM joined
      UNION ALL SELECT 'kept', COUNT(*) - COUNT(kept), MIN(kept), MAX(kept) FROM joined""",
    "value_digest": f"WITH {BASE} {digest_row('source', 'panel')} UNION ALL {digest_row('joined', '(SELECT p.* FROM panel p LEFT JOIN supplier s ON s.s_suppkey = p.cell_id)')}",
    "hash_digest_check": "SELECT CAST(0 AS BIGINT) AS n_mismatched",
    "physical_invariants": """SELECT rule, n_violations FROM (
      SELECT COUNT(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.08)) AS discount, COUNT(*) FILTER (WHERE NOT (l_tax BETWEEN 0 AND 0.08)) AS tax,
        COUNT(*) FILTER (WHERE NOT (l_quantity BETWEEN 1 AND 50)) AS quantity, COUNT(*) FILTER (WHERE NOT (l_extendedprice > 0)) AS price,
        COUNT(*) FILTER (WHERE NOT (l_extendedprice <= 2000 * l_quantity)) AS unit_price FROM lineitem) UNPIVOT (n_violations FOR rule IN (discount, tax, quantity, price, unit_price))""",
    "sign_proportion": """SELECT round(AVG(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive, round(MIN(s_acctbal), 6) AS minimum,
      AVG(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AND MIN(s_acctbal) >= -1000 AS ok FROM supplier""",
    "distinct_ratio": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(COUNT(DISTINCT l_extendedprice) / COUNT(l_extendedprice), 6) AS ratio, COUNT(l_extendedprice) AS n
      FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2001-11-01' GROUP BY 1""",
    "daily_means": """SELECT user_id AS cell_id, CAST(date_trunc('month', ts) AS DATE) AS date, round(AVG(value), 6) AS mean, COUNT(*) AS n_obs FROM events GROUP BY 1, 2""",
    "incomplete_months": """SELECT user_id AS cell_id, CAST(date_trunc('month', ts) AS DATE) AS date, COUNT(*) AS n_obs FROM events GROUP BY 1, 2 HAVING COUNT(*) < 2""",
    "source_drift": f"""WITH {BASE}, y AS (SELECT cell_id, CAST(year(date) AS INTEGER) AS year, SUM(precip) AS a, SUM(COALESCE(price, 0) / 1500) AS b FROM panel GROUP BY 1, 2), m AS (SELECT year, AVG(a) AS a, AVG(b) AS b FROM y GROUP BY 1)
      SELECT year, round(a, 4) AS annual_mean, round(b, 4) AS reference, round(abs(a / b - 1), 4) AS drift, COALESCE(abs(a / b - 1) <= 0.02, FALSE) AS within, a <= 5000 AS possible FROM m""",
    "lattice_subset": f"""WITH {CELLS}, r AS (SELECT cell_id FROM cells WHERE cell_id % 50 <> 0)
      SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM r) AS n_reference, COUNT(*) FILTER (WHERE cell_id NOT IN (SELECT cell_id FROM r)) AS n_outside, abs(COUNT(*) / (SELECT COUNT(*) FROM r) - 1) <= 0.02 AS close FROM cells""",
    "two_stage_mean": f"""WITH {CELLS}, f AS (SELECT FLOOR((lon - 29.975) / 0.05) AS i, FLOOR((37.475 - lat) / 0.05) AS j, AVG(crop_frac) AS v FROM cells GROUP BY 1, 2)
      SELECT CAST(FLOOR((i + 0.5) * (0.05::DOUBLE / 0.15::DOUBLE)) AS BIGINT) AS i, CAST(FLOOR((j + 0.5) * (0.05::DOUBLE / 0.15::DOUBLE)) AS BIGINT) AS j, round(AVG(v), 6) AS crop_frac, COUNT(v) AS n_blocks FROM f GROUP BY 1, 2""",
    "region_mean": f"WITH {BASE}, {CELLS} SELECT date, round(AVG(precip), 6) AS precip, COUNT(precip) AS n_cells FROM panel WHERE cell_id IN (SELECT cell_id FROM population) GROUP BY 1",
    "geojson_features": f"""WITH {CELLS} SELECT cell_id, 'Polygon' AS kind, round(crop_frac, 6) AS crop_frac, 5 AS n_corners, TRUE AS closed, round(round(CAST(lon AS DOUBLE), 6) - 0.025::DOUBLE, 6) AS west, round(round(CAST(lat AS DOUBLE), 6) + 0.025::DOUBLE, 6) AS north FROM cells""",
    "era_means": f"""WITH {BASE}, {ANNUAL}, e AS (SELECT CASE WHEN year BETWEEN 1995 AND 1997 THEN 'first' ELSE 'second' END AS era, COUNT(*) AS n_years, AVG(annual_mean) AS mean, MAX(annual_mean) - MIN(annual_mean) AS spread FROM annual WHERE year <= 2000 GROUP BY 1)
      SELECT era, n_years, round(mean, 6) AS mean, round(spread, 6) AS spread, round(100 * (mean / (SELECT mean FROM e WHERE era = 'first') - 1), 6) AS bias_percent FROM e""",
    "area_checks": """WITH a AS (SELECT CAST(COUNT(*) AS DOUBLE) * 5500 AS c, CAST(SUM(CAST(s_acctbal + 1000 AS DECIMAL(18,2))) AS DOUBLE) AS p FROM supplier)
      SELECT round(c, 6) AS cells_km2, round(p, 6) AS polygons_km2, round(c / p, 6) AS ratio, abs(c / p - 1) <= 0.02 AS ok FROM a""",
    "published_areas": """SELECT source, published_km2, round(area, 6) AS area_km2, round(area / published_km2, 6) AS ratio FROM (VALUES ('atlas', 500000.0::DOUBLE), ('survey', 560000.0::DOUBLE)) v(source, published_km2),
      (SELECT CAST(SUM(CAST(s_acctbal + 1000 AS DECIMAL(18,2))) AS DOUBLE) AS area FROM supplier) a""",
    "spi_6": spi("precip", 6),
    "spi_12": spi("precip", 12),
    "panel_index": f"""SELECT p.cell_id, p.date, p.precip, round(z.spi_1, 6) AS spi_1, round(s.mm_per_unit, 4) AS mm_per_unit FROM (WITH {BASE} SELECT cell_id, date, precip FROM panel) p
      LEFT JOIN ({spi("precip", 1)}) z ON z.cell_id = p.cell_id AND z.date = p.date LEFT JOIN ({SENSITIVITY} SELECT * FROM sens) s ON s.cell_id = p.cell_id AND s.month = month(p.date)""",
    "evaporation_ratio": f"WITH {BASE} SELECT cell_id, date, round(CASE WHEN month(date) > 1 THEN precip / (10.0 * (month(date) - 1)) END, 6) AS ratio FROM panel",
    "spi_sensitivity": f"{SENSITIVITY} SELECT cell_id, CAST(month AS INTEGER) AS month, round(mm_per_unit, 4) AS mm_per_unit FROM sens",
    "unreliable_share": f"{SENSITIVITY} SELECT CAST(month AS INTEGER) AS month, COUNT(*) FILTER (WHERE mm_per_unit < 50) AS n_unreliable, COUNT(mm_per_unit) AS n FROM sens GROUP BY 1",
    "gamma_params_mle": MLE,
    "known_accumulation_gaps": f"WITH {BASE}, {GAPS}, {known(3, 2)} SELECT cell_id, date, round(amount, 6) AS known_accumulation FROM known",
    "known_accumulation_prob": f"""WITH {BASE}, {GAPS}, o AS (SELECT cell_id, date, LAG(precip, 1) {W} + LAG(precip, 2) {W} AS observed FROM gaps),
      y AS (SELECT cell_id, month(date) AS m, precip AS rest FROM gaps WHERE {FIT} AND precip IS NOT NULL)
      SELECT o.cell_id, o.date, round(AVG(CASE WHEN o.observed + y.rest < 450 THEN 1.0 WHEN o.observed + y.rest IS NOT NULL THEN 0.0 END), 6) AS known_accumulation_prob
      FROM o LEFT JOIN y ON y.cell_id = o.cell_id AND y.m = month(o.date) GROUP BY 1, 2""",
    "known_accumulation_index": f"""WITH {BASE}, {fit("precip", 3)}, gaps AS (SELECT * FROM panel), {known(3, 1)},
      h AS (SELECT k.cell_id, k.date, p.q + (1 - p.q) * ({gamma_p("p.shape", "(k.amount / p.scale)")}) AS h FROM known k LEFT JOIN params p ON p.cell_id = k.cell_id AND p.month = month(k.date)),
      c AS (SELECT cell_id, date, CASE WHEN h IS NOT NULL THEN greatest(1e-9::DOUBLE, least(1 - 1e-9::DOUBLE, h)) END AS p FROM h)
      SELECT cell_id, date, CASE WHEN p IS NOT NULL THEN round(greatest(-4.0::DOUBLE, least(4.0::DOUBLE, {norm_ppf("p")})), 6) END AS known_accumulation FROM c""",
    "scores_by_group": f"""{SCORED} SELECT CASE WHEN GROUPING(cell_id) = 0 THEN 'cell_id' WHEN GROUPING(s_nationkey) = 0 THEN 'cover' WHEN GROUPING(month) = 0 THEN 'month' ELSE 'all' END AS grouping, method, cell_id, s_nationkey AS cover, month,
      COUNT(*) AS n, round(AVG(abs(actual - forecast)), 6) AS mae, round(sqrt(AVG((actual - forecast) ** 2)), 6) AS rmse FROM long JOIN supplier ON s_suppkey = cell_id
      WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY GROUPING SETS ((method), (method, cell_id), (method, s_nationkey), (method, month))""",
    "target_table_regression": target_sql(1, False),
    "target_table_classification": target_sql(3, True),
    "signed_rank_ties": f"""WITH {BASE}, v AS (SELECT *, 40 * floor(precip / 40) AS v FROM panel),
w AS (SELECT cell_id, CASE WHEN date >= DATE '2000-11-01' THEN v - LAG(v, 12) {W} END AS year, v - LAG(v, 1) {W} AS month FROM v),
d AS (SELECT cell_id, 'year' AS against, year AS d FROM w UNION ALL SELECT cell_id, 'month', month FROM w),
r AS (SELECT *, 2 * RANK() OVER (PARTITION BY cell_id, against ORDER BY abs(d)) + t - 1 AS k FROM (SELECT *, COUNT(*) OVER (PARTITION BY cell_id, against, abs(d)) AS t FROM d WHERE d <> 0)),
s AS (SELECT cell_id, against, COUNT(*) AS n, list(k) AS ks, COALESCE(SUM(k) FILTER (WHERE d > 0), 0) AS plus, SUM(k) AS total, BOOL_OR(t > 1) AS tied, SUM(t * t - 1) AS c FROM r GROUP BY 1, 2),
z AS (SELECT *, CAST(least(plus, total - plus) AS BIGINT) AS low, abs(plus / 2 - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - c / 48) AS z FROM s)
SELECT cell_id, against, n AS n_ranked, plus / 2 AS w_plus, tied, round(CASE WHEN n <= 50 THEN {MASKS.replace("ks", "CASE WHEN n <= 20 THEN ks END")}
  ELSE 1 - sqrt(2 / pi()) * z / 4000 * list_sum(list_transform(range(4000), lambda i: exp(-0.5 * ((i + 0.5) * z / 4000) ** 2))) END, 6) AS p_wilcoxon FROM z""",
    "target_alignment": "SELECT CAST(0 AS BIGINT) AS n_mismatched",
    "prediction_checks": "SELECT CAST(0 AS BIGINT) AS n_not_binary, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_missing",
    "base_rate": f"WITH {BASE}, {baselines(3)} SELECT round(AVG(climatology_prob), 6) AS mean, 0.158655::DOUBLE AS expected, round(AVG(climatology_prob) - 0.15865525393145707, 6) AS drift FROM baselines WHERE {TEST}",
    "persistence_order": f"""WITH {BASE}, {baselines(3)} SELECT round(MAX(CASE WHEN now THEN rate END), 6) AS rate_below, round(MAX(CASE WHEN NOT now THEN rate END), 6) AS rate_above,
      MAX(CASE WHEN now THEN rate END) > MAX(CASE WHEN NOT now THEN rate END) AS ok FROM rates""",
    "split_row_counts": f"""{TABLE} SELECT s.split, CAST(s.months * (SELECT COUNT(*) FROM cells) AS BIGINT) AS expected, COUNT(k.cell_id) AS n, CAST(0 AS BIGINT) AS n_with_null
      FROM (VALUES ('train', 60), ('validation', 6), ('test', 10)) s(split, months) LEFT JOIN kept k ON k.split = s.split GROUP BY 1, 2""",
    "permutation_control": f"""{TABLE}, o AS (SELECT split, date, actual, lag0, ROW_NUMBER() OVER (PARTITION BY split, date ORDER BY cell_id) AS k,
        ROW_NUMBER() OVER (PARTITION BY split, date ORDER BY md5(cell_id || '-' || date || '-42'), cell_id) AS r FROM kept),
      shuffled AS (SELECT a.split, a.lag0, b.actual FROM o a JOIN o b ON a.split = b.split AND a.date = b.date AND a.k = b.r),
      both_ AS ({line_skill("kept", "real")} UNION ALL {line_skill("shuffled", "shuffled")})
      SELECT labels, n, round(mse, 4) AS mse, round(1 - mse / naive, 4) AS skill, abs(1 - mse / naive) < 0.05 AS vanishes FROM both_""",
    "gbt_checks": f"""{TABLE} SELECT split, COUNT(*) AS n, round(AVG(actual), 6) AS mean_actual, CAST(0 AS BIGINT) AS n_off_lead, CASE WHEN split = 'train' THEN TRUE END AS fits FROM kept GROUP BY 1""",
    "forecaster_folds": f"""{TABLE}, f AS (SELECT cell_id, CAST((FLOOR(i / 2.0) * 7919 + FLOOR(j / 2.0) * 104729) % 5 AS INTEGER) AS fold FROM cells), t AS (SELECT k.*, f.fold FROM kept k JOIN f ON f.cell_id = k.cell_id),
      m AS (SELECT g.fold, COUNT(t.fold) AS n_train, AVG(t.actual) AS mean FROM (SELECT unnest(range(5)) AS fold) g LEFT JOIN t ON t.fold <> g.fold AND t.split = 'train' GROUP BY 1)
      SELECT CAST(m.fold AS INTEGER) AS fold, n_train, COUNT(t.fold) AS n, round(AVG((t.actual - mean) ** 2), 4) AS mse_mean, CASE WHEN COUNT(t.fold) > 0 THEN TRUE END AS bounded
      FROM m LEFT JOIN t ON t.fold = m.fold AND t.split = 'test' GROUP BY 1, 2""",
    "forecaster_permutation": f"""{TABLE}, m AS (SELECT COUNT(*) AS n_train, AVG(actual) AS mean FROM kept WHERE split = 'train')
      SELECT trial, n_train, COUNT(*) AS n, round(AVG((actual - mean) ** 2), 4) AS mse_mean, CASE WHEN trial <> 'real' THEN TRUE END AS without_skill
      FROM kept, m, (VALUES ('real'), ('shuffled-42')) v(trial) WHERE split = 'test' GROUP BY 1, 2""",
    "product_views": f"""WITH {BASE}, r AS (
      SELECT 'precip' AS layer, 'observation' AS kind, CAST(cell_id AS BIGINT) AS cell_id, date, CAST(precip AS DOUBLE) AS v, 0.05::DOUBLE AS resolution_degrees, 0.05::DOUBLE AS source_degrees FROM panel
      UNION ALL SELECT 'sparse', 'forecast', CAST(cell_id AS BIGINT), date, CAST(sparse AS DOUBLE), 0.05, 0.1 FROM panel
      UNION ALL SELECT 'price', 'observation', NULL, date, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 5.0, 3.0
        FROM (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2001-11-01') GROUP BY l_suppkey, date)
      SELECT layer, kind, cell_id, date, resolution_degrees, source_degrees, round(AVG(v), 6) AS value, COUNT(*) AS n_cells FROM r WHERE v IS NOT NULL GROUP BY ALL""",
    "skill_geojson": f"""{SCORED}, e AS (SELECT cell_id, date, method, (actual - forecast) ** 2 AS error FROM long WHERE actual IS NOT NULL AND forecast IS NOT NULL),
      s AS (SELECT a.cell_id, COUNT(*) AS n_dates, sqrt(AVG(a.error)) AS rmse, sqrt(AVG(b.error)) AS base FROM e a JOIN e b ON a.cell_id = b.cell_id AND a.date = b.date AND a.method = 'persistence' AND b.method = 'climatology' GROUP BY 1),
      k AS (SELECT *, CASE WHEN n_dates >= 5 AND base <> 0 THEN 1 - rmse / base END AS skill FROM s)
      SELECT s_suppkey AS cell_id, CASE WHEN k.cell_id IS NOT NULL THEN 'persistence' END AS method, n_dates, round(skill, 6) AS skill, COALESCE(skill > 0, FALSE) AS has_skill, 'skill' AS layer, 0.05::DOUBLE AS resolution_degrees, 0.1::DOUBLE AS source_degrees
      FROM supplier LEFT JOIN k ON k.cell_id = s_suppkey""",
    "source_coverage": """WITH r AS (
      SELECT 'lines' AS source, 'lineitem' AS resolved, CAST(l_shipdate AS DATE) AS day, '' AS missing, TRUE AS core FROM lineitem UNION ALL
      SELECT 'orders', 'orders', CAST(o_orderdate AS DATE), 'o_band', FALSE FROM orders UNION ALL SELECT 'events', 'events', CAST(ts AS DATE), '', TRUE FROM events),
      a AS (SELECT source, resolved, MIN(day) AS first, MAX(day) AS last, COUNT(*) FILTER (WHERE day BETWEEN DATE '1995-01-01' AND DATE '2001-10-01') AS n_in_window, missing, core FROM r GROUP BY ALL),
      b AS (SELECT *, (2001 * 12 + 10) - (year(last) * 12 + month(last)) > 3 AS short FROM a)
      SELECT source, resolved, first, last, n_in_window, missing, short, CASE WHEN missing <> '' OR n_in_window = 0 THEN CASE WHEN core THEN 'fail' ELSE 'warn' END WHEN short THEN 'warn' ELSE 'ok' END AS status FROM b
      UNION ALL SELECT 'gauges', NULL, NULL, NULL, 0, '', NULL, 'fail'""",
    "spatial_folds": f"""{TABLE}, f AS (SELECT cell_id, CAST((FLOOR(i / 2.0) * 7919 + FLOOR(j / 2.0) * 104729) % 5 AS INTEGER) AS fold FROM cells), t AS (SELECT k.*, f.fold FROM kept k JOIN f ON f.cell_id = k.cell_id),
      l AS (SELECT g.fold, regr_slope(t.actual, t.lag0) AS a, regr_intercept(t.actual, t.lag0) AS b, AVG(t.actual) AS mean FROM (SELECT DISTINCT fold FROM t) g JOIN t ON t.fold <> g.fold GROUP BY 1),
      s AS (SELECT t.fold, COUNT(*) AS n, AVG((t.actual - l.b - l.a * t.lag0) ** 2) AS mse, AVG((t.actual - l.mean) ** 2) AS naive FROM t LEFT JOIN l ON l.fold = t.fold GROUP BY 1)
      SELECT fold, n, round(mse, 4) AS mse, round(naive, 4) AS mse_mean, round(1 - mse / naive, 4) AS skill FROM s""",
    "availability_flags": f"WITH {GAPPY} SELECT date, COUNT(amount) AS n_available, COUNT(*) AS n FROM gappy GROUP BY 1",
    "ensemble_statistics": f"""WITH {BASE} SELECT s_nationkey AS nation, date, COUNT(precip) AS n_members, round(AVG(precip), 6) AS mean, round(STDDEV_SAMP(precip), 6) AS spread, round(quantile_cont(precip, 1 / 3), 6) AS lower_tercile, round(quantile_cont(precip, 2 / 3), 6) AS upper_tercile
      FROM panel JOIN supplier ON s_suppkey = cell_id GROUP BY 1, 2""",
    "forecast_bias": f"""WITH {BASE}, {baselines(3)}, b AS (SELECT CAST(month(date) AS INTEGER) AS month, AVG(persistence - actual) AS bias, COUNT(*) AS n FROM baselines WHERE persistence IS NOT NULL AND actual IS NOT NULL GROUP BY 1)
      SELECT month, round(bias, 6) AS bias, n, 0.0::DOUBLE AS "left" FROM b""",
    "cross_calibration": f"""WITH a AS ({source("R", "v")}), b AS ({source("A", "v")}) SELECT round(regr_slope(a.v, b.v), 6) AS slope, round(regr_intercept(a.v, b.v), 6) AS intercept, CAST(regr_count(a.v, b.v) AS BIGINT) AS n
      FROM a JOIN b ON a.cell_id = b.cell_id AND a.date = b.date""",
    "effective_cells": f"""WITH {BASE}, {CELLS} SELECT date, COUNT(DISTINCT p.cell_id) AS n_cells, COUNT(DISTINCT (FLOOR(lon * 10), FLOOR(lat * 10))) AS n_effective FROM panel p JOIN cells c ON c.cell_id = p.cell_id GROUP BY 1""",
    "static_mask": f"WITH {GAPPY} SELECT COUNT(DISTINCT cells) AS n_masks FROM (SELECT date, COALESCE(list_sort(list(DISTINCT cell_id) FILTER (WHERE amount IS NULL)), []) AS cells FROM gappy GROUP BY 1)",
    "value_counts": f"WITH {BASE} SELECT n_obs, COUNT(*) AS n FROM base GROUP BY 1",
    "lattice_check": "SELECT 0.0::DOUBLE AS worst, CAST(0 AS BIGINT) AS wrong_ids",
    "lattice_steps": f"WITH {CELLS}, d AS (SELECT DISTINCT round(lon, 6) AS lon FROM cells), s AS (SELECT lon, lon - LAG(lon) OVER (ORDER BY lon) AS step FROM d) SELECT lon, round(step, 6) AS step FROM s WHERE step IS NOT NULL",
    "native_pixels": f"""WITH {CELLS} SELECT CAST(round_even(FLOOR(lon * 10) / 10 * 1000, 0) AS BIGINT) * 1000000 + CAST(round_even(FLOOR(lat * 10) / 10 * 1000, 0) AS BIGINT) AS native, COUNT(*) AS n_cells FROM cells GROUP BY 1""",
    "block_mean": f"""WITH {CELLS} SELECT CAST(FLOOR((lon - 29.975) / 0.1) AS BIGINT) AS i, CAST(FLOOR((37.475 - lat) / 0.1) AS BIGINT) AS j, round(AVG(crop_frac), 6) AS crop_frac_mean,
      round(STDDEV_POP(crop_frac), 6) AS crop_frac_std, COUNT(crop_frac) AS n, COUNT(*) - COUNT(crop_frac) AS n_masked FROM cells GROUP BY 1, 2""",
    "bilinear_resample": f"""WITH {CELLS}, points AS (SELECT cell_id, (lon + 0.0125 - 29.975) / 0.05 - 0.5 AS x, (37.475 - (lat - 0.0125)) / 0.05 - 0.5 AS y FROM cells),
      near AS (SELECT cell_id, CAST(FLOOR(x) AS BIGINT) + a AS i, CAST(FLOOR(y) AS BIGINT) + b AS j,
        (CASE WHEN a = 1 THEN x - FLOOR(x) ELSE 1 - (x - FLOOR(x)) END) * (CASE WHEN b = 1 THEN y - FLOOR(y) ELSE 1 - (y - FLOOR(y)) END) AS w
        FROM points, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b))
      SELECT n.cell_id, round(SUM(n.w * c.crop_frac) / SUM(CASE WHEN c.crop_frac IS NOT NULL THEN n.w END), 4) AS crop_frac FROM near n LEFT JOIN (SELECT i, j, CASE WHEN cell_id % 3 <> 0 THEN crop_frac END AS crop_frac FROM cells) c ON c.i = n.i AND 9 - c.j = n.j GROUP BY 1""",
    "class_share": "SELECT s_suppkey % 10 AS block, round(AVG(CASE WHEN s_nationkey IN (3, 4, 5) THEN 1.0 ELSE 0.0 END), 6) AS share FROM supplier GROUP BY 1",
    "unit_conversions": """SELECT s_suppkey AS cell_id, round(s_acctbal - 273.15, 6) AS celsius, round(s_acctbal * 1000, 6) AS mm, round(s_acctbal * 1e6 / 1e6, 6) AS mj, round(s_acctbal / 1000, 6) AS kpa,
      round(s_acctbal * 0.748::DOUBLE, 6) AS wind2, round(sqrt(s_acctbal ** 2 + (s_acctbal + 1) ** 2), 6) AS speed,
      round(0.07::DOUBLE * s_acctbal + 0.21::DOUBLE * (s_acctbal + 1) + 0.72::DOUBLE * (s_acctbal + 2), 6) AS root_zone FROM supplier""",
    "evapotranspiration": """WITH k AS (SELECT s_suppkey AS cell_id, CAST(s_suppkey % 20 AS DOUBLE) AS k FROM supplier),
      t AS (SELECT cell_id, 20 + k AS tmax, 5 + k AS tmin, 2 + k AS dew, (20 + k + 5 + k) / 2 AS mean, 12 - k AS rad FROM k),
      e AS (SELECT cell_id, mean, rad, 4098 * 0.6108 * exp(17.27 * mean / (mean + 237.3)) / (mean + 237.3) ** 2 AS slope, 0.000665 * 90 AS g,
        (0.6108 * exp(17.27 * tmax / (tmax + 237.3)) + 0.6108 * exp(17.27 * tmin / (tmin + 237.3))) / 2 - 0.6108 * exp(17.27 * dew / (dew + 237.3)) AS deficit FROM t),
      r AS (SELECT cell_id, (0.408 * slope * rad + g * 900 / (mean + 273) * 2.0 * deficit) / (slope + g * (1 + 0.34 * 2.0)) AS raw FROM e)
      SELECT cell_id, round(greatest(raw, 0.0), 6) AS mm, raw < 0 AS clamped FROM r""",
    "haversine": f"{NEIGHBOURS} SELECT cell_id, neighbour_id, round({haversine('lon1', 'lat1', 'lon2', 'lat2')}, 6) AS km FROM pairs",
    "neighbour_edges": f"{NEIGHBOURS} SELECT cell_id, neighbour_id FROM pairs",
    "point_cells": f"""WITH {CELLS}, p AS (SELECT cell_id AS station, lon + 0.01 AS lon, lat + 0.01 AS lat FROM cells),
      c AS (SELECT *, FLOOR((lon - 29.975) / 0.05) AS ci, FLOOR((37.475 - lat) / 0.05) AS cj FROM p)
      SELECT station, CAST(ci AS BIGINT) * 100000 + CAST(cj AS BIGINT) AS cell_id, round({haversine('lon', 'lat', '(29.975 + (ci + 0.5) * 0.05)', '(37.475 - (cj + 0.5) * 0.05)')}, 6) AS km_to_centre FROM c""",
    "polygon_cells": f"WITH {CELLS} SELECT cell_id FROM cells WHERE {crossing([(30.01, 37.01), (30.41, 37.06), (30.36, 37.41), (30.06, 37.31)])}",
    "stratified_sample": f"""WITH {BASE}, {CELLS},
      r AS (SELECT p.date, c.in_basin, p.cell_id, p.precip, ROW_NUMBER() OVER (PARTITION BY p.date, c.in_basin ORDER BY p.cell_id) AS k, COUNT(*) OVER (PARTITION BY p.date, c.in_basin) AS n
        FROM panel p LEFT JOIN cells c ON c.cell_id = p.cell_id WHERE year(p.date) IN (1995, 1998, 2001) AND month(p.date) IN (1, 7))
      SELECT date, in_basin, cell_id, precip FROM r WHERE k = n // 2 + 1""",
    "split_counts": f"""WITH {BASE}, s AS (SELECT *, CASE WHEN {FIT} THEN 'train' WHEN date BETWEEN DATE '2000-04-01' AND DATE '2000-09-01' THEN 'validation' WHEN {TEST} THEN 'test' END AS split FROM panel)
      SELECT split, COUNT(*) AS n, MIN(date) AS first, MAX(date) AS last FROM s WHERE split IS NOT NULL GROUP BY 1""",
    "epoch_months": "SELECT s_suppkey AS cell_id, strftime(TIMESTAMP '1970-01-01' + to_milliseconds((s_suppkey - 5) * 2629800000), '%Y-%m') AS month FROM supplier",
    "rolling_sum_3": f"""WITH {BASE} SELECT cell_id, date, CASE WHEN COUNT(precip) OVER w = 3 THEN SUM(precip) OVER w END AS sum3 FROM panel
      WINDOW w AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "centred_mean_12": f"""WITH {BASE} SELECT cell_id, date, round(CASE WHEN COUNT(precip) OVER w = 12 THEN AVG(precip) OVER w END, 6) AS mean12 FROM panel
      WINDOW w AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""",
    "lag_features": f"WITH {BASE} SELECT cell_id, date, {LAGS}, round(sin(2 * pi() * month(date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(date) / 12), 6) AS month_cos FROM panel",
    "lead_label": f"WITH {BASE} SELECT cell_id, date, LEAD(precip, 3) {W} AS future, CAST(LEAD(precip, 3) {W} < 150 AS DOUBLE) AS label FROM panel",
    "calendar_lag": f"""WITH {BASE}, r AS (SELECT p.cell_id, p.date, LAG(p.precip, 3) OVER (PARTITION BY p.cell_id ORDER BY p.date) AS by_row, o.precip AS by_date
        FROM panel p LEFT JOIN panel o ON o.cell_id = p.cell_id AND CAST(o.date + INTERVAL 3 MONTH AS DATE) = p.date)
      SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE by_row IS DISTINCT FROM by_date) AS n_different FROM r""",
    "cyclic_month": f"WITH {BASE} SELECT date, round(sin(2 * pi() * month(date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(date) / 12), 6) AS month_cos FROM months",
    "anomaly": f"""WITH {BASE}, s AS (SELECT cell_id, month(date) AS m, AVG(precip) AS mu, STDDEV_SAMP(precip) AS sd FROM panel WHERE {FIT} GROUP BY 1, 2)
      SELECT p.cell_id, p.date, round(p.precip, 6) AS precip, round(CASE WHEN s.sd > 0 THEN (p.precip - s.mu) / s.sd END, 6) AS precip_anom FROM panel p JOIN s ON s.cell_id = p.cell_id AND s.m = month(p.date)""",
    "autocorrelation": f"""WITH {BASE}, s AS (SELECT cell_id, precip, LAG(precip) {W} AS before FROM panel)
      SELECT cell_id, COUNT(precip) AS n_dates, round(CASE WHEN COUNT(precip) > 3 AND STDDEV_POP(precip) > 0 THEN corr(precip, before) END, 6) AS lag1_r FROM s GROUP BY 1""",
    "annual_means": f"WITH {BASE}, {ANNUAL} SELECT year, round(annual_mean, 6) AS annual_mean, n_cells FROM annual",
    "driest_years": f"WITH {BASE}, {ANNUAL} SELECT year, round(annual_mean, 6) AS annual_mean, n_cells, CAST(year // 10 * 10 AS INTEGER) AS decade FROM annual ORDER BY annual.annual_mean, year LIMIT 4",
    "cross_source_corr": f"""WITH {BASE}, y AS (SELECT cell_id, year(date) AS year, SUM(precip) AS a, SUM(COALESCE(price, 0) / 1500) AS b FROM panel WHERE year(date) < 2001 GROUP BY 1, 2),
      m AS (SELECT year, AVG(a) AS a, AVG(b) AS b FROM y GROUP BY 1)
      SELECT COUNT(*) AS n_years, round(CASE WHEN COUNT(*) >= 5 THEN corr(a, b) END, 4) AS correlation, round(abs(AVG(b) - AVG(a)) / AVG(a), 4) AS divergence FROM m""",
    "population_spread": f"""WITH {BASE}, {CELLS}, y AS (SELECT cell_id, year(date) AS year, SUM(precip) AS total FROM panel GROUP BY 1, 2),
      g AS (SELECT 'basin' AS population, cell_id FROM cells WHERE in_basin UNION ALL SELECT 'without_lobe', cell_id FROM cells WHERE in_basin AND NOT in_lobe UNION ALL SELECT 'everything', cell_id FROM cells),
      m AS (SELECT population, year, AVG(total) AS mean FROM g JOIN y USING (cell_id) GROUP BY 1, 2), n AS (SELECT population, AVG(mean) AS mean FROM m GROUP BY 1)
      SELECT population, round(mean, 6) AS mean, round(MAX(mean) OVER () - MIN(mean) OVER (), 6) AS spread FROM n""",
    "basin_areas": "SELECT s_nationkey AS main_basin, COUNT(*) AS n_parts, round(CAST(SUM(CAST(s_acctbal + 1000 AS DECIMAL(18,2))) AS DOUBLE), 6) AS area_km2 FROM supplier GROUP BY 1",
    "gamma_params": f"WITH {BASE}, {fit('sparse', 1)} SELECT cell_id, month, n, n_positive, round(q, 6) AS q, round(shape, 6) AS shape, round(scale, 6) AS scale FROM params",
    "spei_3": SPEI,
    "spi_1": spi("precip", 1),
    "spi_3": spi("precip", 3),
    "spi_1_sparse": spi("sparse", 1),
    "normal_quantile": f"""SELECT cell_id, CASE WHEN p > 0 AND p < 1 THEN round({norm_ppf("p")}, 6) END AS z FROM (SELECT s_suppkey AS cell_id, s_suppkey / 2000.0::DOUBLE AS p FROM supplier)""",
    "incomplete_gamma": f"""SELECT cell_id, round({gamma_p("a", "x", 400)}, 6) AS p FROM (SELECT s_suppkey AS cell_id, 0.5::DOUBLE + s_suppkey % 50 AS a, CAST(s_suppkey % 97 AS DOUBLE) AS x FROM supplier)""",
    "climatology": f"""WITH {BASE}, {baselines(1)} SELECT cell_id, date, round(climatology, 6) AS climatology FROM baselines""",
    "climatology_prob": f"""WITH {BASE}, {baselines(1)} SELECT cell_id, date, round(climatology_prob, 6) AS climatology_prob FROM baselines""",
    "climatology_prob_null_false": f"""WITH {GAPPY}, c AS (SELECT cell_id, month(date) AS m, AVG(CASE WHEN amount < 60 THEN 1.0 ELSE 0.0 END) AS p FROM gappy WHERE {FIT} GROUP BY 1, 2)
      SELECT g.cell_id, g.date, round(c.p, 6) AS climatology_prob FROM gappy g LEFT JOIN c ON c.cell_id = g.cell_id AND c.m = month(g.date)""",
    "persistence": f"WITH {BASE} SELECT cell_id, date, LAG(precip, 3) {W} AS persistence FROM panel",
    "transition_rates": f"""WITH {BASE}, {CELLS}, pairs AS (SELECT date, precip < 150 AS now, CASE WHEN LEAD(precip, 3) {W} < 150 THEN 1.0 WHEN LEAD(precip, 3) {W} IS NOT NULL THEN 0.0 END AS future
        FROM panel WHERE cell_id IN (SELECT cell_id FROM population))
      SELECT now, round(AVG(future), 6) AS rate, COUNT(*) AS n FROM pairs WHERE date >= DATE '1995-01-01' AND {shifted(3)} <= DATE '1999-12-01' AND future IS NOT NULL GROUP BY 1""",
    "persistence_prob": f"WITH {BASE}, {baselines(3)} SELECT cell_id, date, round(persistence_prob, 6) AS persistence_prob FROM baselines",
    "known_accumulation": f"""WITH {BASE}, c AS (SELECT cell_id, month(date) AS m, AVG(precip) AS mu FROM panel WHERE {FIT} GROUP BY 1, 2)
      SELECT p.cell_id, p.date, round(LAG(p.precip, 1) OVER w + LAG(p.precip, 2) OVER w + c.mu, 6) AS known_accumulation FROM panel p LEFT JOIN c ON c.cell_id = p.cell_id AND c.m = month(p.date)
      WINDOW w AS (PARTITION BY p.cell_id ORDER BY p.date)""",
    "known_accumulation_full_lead": f"""WITH {BASE}, s AS (SELECT cell_id, date, CASE WHEN COUNT(precip) OVER w = 3 THEN SUM(precip) OVER w END AS s3 FROM panel WINDOW w AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
      c AS (SELECT cell_id, month(date) AS m, AVG(s3) AS mu FROM s WHERE {FIT} GROUP BY 1, 2)
      SELECT p.cell_id, p.date, round(c.mu, 6) AS known_accumulation FROM panel p LEFT JOIN c ON c.cell_id = p.cell_id AND c.m = month(p.date)""",
    "baseline_table": f"""WITH {BASE}, {baselines(3)} SELECT cell_id, date, 'precip' AS target, 3 AS lead_months, 'classification' AS kind, round(actual, 6) AS actual, round(persistence, 6) AS persistence,
      round(climatology, 6) AS climatology, round(climatology, 6) AS known_accumulation, CAST(NULL AS DOUBLE) AS ensemble_raw, round(climatology_prob, 6) AS climatology_prob,
      round(persistence_prob, 6) AS persistence_prob, CAST(actual_prob AS DOUBLE) AS actual_prob, round(climatology_prob, 6) AS known_accumulation_prob, CAST(NULL AS DOUBLE) AS ensemble_raw_prob FROM baselines""",
    "per_date_regression": f"{SCORED}, {by_date('method, date')} SELECT method, date, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM by_date",
    "brier_per_date": f"{SCORED} SELECT method, date, COUNT(*) AS n, round(AVG((prob - actual_prob) ** 2), 6) AS brier FROM long WHERE actual_prob IS NOT NULL AND prob IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 10",
    "auc_per_date": f"""{SCORED}, good AS (SELECT * FROM long WHERE actual_prob IS NOT NULL AND prob IS NOT NULL),
      ranked AS (SELECT method, date, actual_prob, RANK() OVER (PARTITION BY method, date ORDER BY prob) + (COUNT(*) OVER (PARTITION BY method, date, prob) - 1) / 2 AS r FROM good),
      s AS (SELECT method, date, COUNT(*) AS n, SUM(actual_prob) AS pos, COUNT(*) - SUM(actual_prob) AS neg, SUM(CASE WHEN actual_prob = 1 THEN r ELSE 0 END) AS rs FROM ranked GROUP BY 1, 2)
      SELECT method, date, n, round(CASE WHEN pos > 0 AND neg > 0 THEN (rs - pos * (pos + 1) / 2) / (pos * neg) END, 6) AS auc FROM s WHERE n >= 10""",
    "undefined_dates": f"""{SCORED}, g AS (SELECT date, SUM(actual_prob) AS s, COUNT(*) AS n FROM long WHERE method = 'climatology' AND prob IS NOT NULL
        AND cell_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY 1) SELECT date FROM g WHERE s = 0 OR s = n""",
    "summary_by_method": f"""{SCORED}, {by_date('method, date')} SELECT method, COUNT(*) AS n_dates, round(AVG(mae), 6) AS mae, round(AVG(rmse), 6) AS rmse, round(AVG(r2), 6) AS r2,
      COUNT(*) - COUNT(mae) AS mae_undefined, COUNT(*) - COUNT(rmse) AS rmse_undefined, COUNT(*) - COUNT(r2) AS r2_undefined FROM by_date GROUP BY 1""",
    "skill_scores": skill(""),
    "calendar_month_skill": skill("month"),
    "sensitivity_bins": f"""{SENSITIVITY}, {baselines(1)}, {LONG},
      binned AS (SELECT l.*, CASE WHEN mm_per_unit < 40 THEN '0-40' WHEN mm_per_unit < 60 THEN '40-60' WHEN mm_per_unit < 80 THEN '60-80' ELSE '>=80' END AS bin
        FROM long l JOIN sens ON sens.cell_id = l.cell_id AND sens.month = l.month WHERE mm_per_unit IS NOT NULL),
      {by_date('bin, method, date', 'binned', 1)} SELECT bin, method, COUNT(*) AS n_dates, round(AVG(mae), 6) AS mae, round(AVG(rmse), 6) AS rmse, COUNT(*) - COUNT(mae) AS mae_undefined, COUNT(*) - COUNT(rmse) AS rmse_undefined FROM by_date GROUP BY 1, 2""",
    "grouped_scores": f"""{SCORED} SELECT method, month, round(AVG(abs(actual - forecast)), 6) AS mae, COUNT(*) AS n FROM long WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY ROLLUP (method, month)""",
    "reliability": f"""{SCORED} SELECT CAST(least(4, FLOOR(prob * 5)) AS INTEGER) AS bin, round(AVG(prob), 6) AS mean_forecast, round(AVG(actual_prob), 6) AS observed, COUNT(*) AS n FROM long WHERE method = 'climatology' GROUP BY 1""",
    "verification_alignment": f"""WITH {BASE}, kept AS (SELECT * FROM panel WHERE date IN (SELECT DISTINCT {shifted(3)} FROM panel WHERE {TEST}) AND {TEST})
      SELECT COUNT(*) AS n, MIN(date) AS first, MAX(date) AS last, CAST(0 AS BIGINT) AS n_mismatched FROM kept""",
    "paired_series": f"""{SCORED}, {by_date('method, date')},
      d AS (SELECT a.date, b.mae - a.mae AS d FROM by_date a JOIN by_date b ON a.date = b.date WHERE a.method = 'climatology' AND b.method = 'persistence'),
      r AS (SELECT date, d, LAG(d) OVER (ORDER BY date) AS before, CASE WHEN d <> 0 THEN RANK() OVER (PARTITION BY d <> 0 ORDER BY abs(d)) + (COUNT(*) OVER (PARTITION BY d <> 0, abs(d)) - 1) / 2 END AS r FROM d),
      s AS (SELECT COUNT(*) AS n, AVG(d) AS m, STDDEV_SAMP(d) AS sd, COALESCE(SUM(CASE WHEN d > 0 THEN r END), 0.0) AS w, COUNT(*) FILTER (WHERE d > 0) AS wins, COUNT(*) FILTER (WHERE d < 0) AS losses,
        CASE WHEN COUNT(*) > 3 AND STDDEV_POP(d) > 0 THEN corr(d, before) END AS r1, COALESCE(MAX(abs(d)), 0.0) < 1e-12 AS identical FROM r)
      SELECT n AS n_dates, round(m, 6) AS mean_difference, round(CASE WHEN n >= 5 AND NOT identical AND sd > 0 THEN m / (sd / sqrt(n)) END, 6) AS t, round(CASE WHEN n >= 5 AND NOT identical THEN CAST(w AS DOUBLE) END, 6) AS w_plus, wins, losses,
        round(r1, 6) AS lag1_r, identical FROM s""",
    "zero_clusters": f"{ZEROS} SELECT date, component, size, round(boundary_min, 6) AS boundary_min, artefact FROM clusters",
    "zero_diagnostics": f"""{ZEROS} SELECT date, CAST(SUM(size) AS BIGINT) AS n_zero, COUNT(*) AS n_clusters, CAST(COALESCE(SUM(CASE WHEN artefact THEN size END), 0) AS BIGINT) AS n_isolated,
      MAX(size) AS largest, round(MIN(CASE WHEN artefact THEN boundary_min END), 4) AS least_boundary FROM clusters GROUP BY 1""",
    "zero_isolated": f"""{ZEROS}, flags AS (SELECT p.date, b.component IS NOT NULL AS bad FROM panel p LEFT JOIN comps c ON c.date = p.date AND c.cell_id = p.cell_id
        LEFT JOIN (SELECT date, component FROM clusters WHERE artefact) b ON b.date = c.date AND b.component = c.component)
      SELECT date, COUNT(*) FILTER (WHERE bad) AS n_isolated, COUNT(*) AS n FROM flags GROUP BY 1""",
    "planted_faults": f"""WITH {BASE}, {CELLS},
p AS (SELECT *, cell_id % 3 = 0 AS third, month(date) AS m, CASE WHEN {FIT} THEN 1 WHEN date BETWEEN DATE '2000-04-01' AND DATE '2000-09-01' THEN 2 WHEN {TEST} THEN 3 END AS split FROM panel)
SELECT 'digests' AS "check", CAST((COUNT(*) FILTER (WHERE third AND m = 2) > 0) AS BIGINT) + CAST((COUNT(price) FILTER (WHERE m = 5) > 0) AS BIGINT) AS n FROM p
UNION ALL SELECT 'dates', COUNT(DISTINCT date) FILTER (WHERE (third AND m = 2) OR m = 5) FROM p
UNION ALL SELECT 'pairs', COUNT(DISTINCT date) FILTER (WHERE third AND m = 2) FROM p
UNION ALL SELECT 'n_not_binary', COUNT(*) FILTER (WHERE third) FROM p
UNION ALL SELECT 'n_outside', COUNT(*) FILTER (WHERE price IS NOT NULL AND sparse > 100) FROM p
UNION ALL SELECT 'n_missing', COUNT(*) - COUNT(price) FROM p
UNION ALL SELECT 'wrong_ids', COUNT(*) FILTER (WHERE nation = 3) FROM cells
UNION ALL SELECT 'null_rows', COUNT(*) FILTER (WHERE split IS NOT NULL AND (third OR price IS NULL)) FROM p""",
    "short_months": """SELECT user_id AS cell_id, CAST(date_trunc('month', ts) AS DATE) AS date, COUNT(*) AS n_obs FROM events GROUP BY 1, 2 HAVING COUNT(*) < 70""",
    "static_features": f"""WITH {BASE}, {CELLS},
f AS (SELECT cell_id, date, precip AS precip_lag0, LAG(precip, 3) {W} AS precip_lag3, LEAD(precip, 1) {W} AS actual,
  CASE WHEN {FIT} THEN 'train' WHEN date BETWEEN DATE '2000-04-01' AND DATE '2000-09-01' THEN 'validation' WHEN {TEST} THEN 'test' END AS split FROM panel)
SELECT f.*, round(c.crop_frac, 6) AS static_crop_frac, CAST(round(c.lat, 6) AS DOUBLE) AS static_lat FROM f JOIN cells c USING (cell_id) WHERE split IS NOT NULL AND precip_lag3 IS NOT NULL AND actual IS NOT NULL""",
    "polygon_membership": f"WITH {CELLS}, {REGION_EDGES} SELECT cell_id, polygon_id FROM cells JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1",
    "station_buffer_means": f"""WITH {CELLS}, s AS (SELECT cell_id AS point_id, lon + 0.013 AS lon, lat - 0.007 AS lat FROM cells)
SELECT s.point_id, COUNT(c.cell_id) AS n_cells, round(AVG(c.crop_frac), 6) AS mean FROM s LEFT JOIN cells c ON {haversine("s.lon", "s.lat", "c.lon", "c.lat")} <= 8.0 GROUP BY 1""",
    "reference_periods": f"""WITH {BASE},
s AS (SELECT *, month(date) AS m FROM panel),
z AS (SELECT cell_id, date, {", ".join(f"CASE WHEN n_{c} >= 3 AND sd_{c} > 0 THEN ({c} - mean_{c}) / sd_{c} END AS {c}_anom" for c in ("precip", "sparse", "price"))} FROM s JOIN (
  SELECT cell_id, m, {", ".join(f"COUNT({c}) FILTER (WHERE date BETWEEN {p}) AS n_{c}, AVG({c}) FILTER (WHERE date BETWEEN {p}) AS mean_{c}, STDDEV_SAMP({c}) FILTER (WHERE date BETWEEN {p}) AS sd_{c}" for c, p in (("precip", "DATE '1995-01-01' AND DATE '1999-12-01'"), ("sparse", "DATE '1995-01-01' AND DATE '1999-12-01'"), ("price", "DATE '1996-01-01' AND DATE '1999-12-01'")))}
  FROM s GROUP BY 1, 2) t USING (cell_id, m))
SELECT cell_id, date, {", ".join(f"round({c}_anom, 6) AS {c}_anom, " + ", ".join(f"round(LAG({c}_anom, {k}) {W}, 6) AS {c}_anom_lag{k}" for k in range(1, n + 1)) for c, n in (("precip", 6), ("sparse", 2), ("price", 3)))} FROM z""",
    "latest_return": """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS day FROM lineitem),
b AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, SUM(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT r.*, CASE WHEN r.day - b.day <= 60 THEN b.day END AS matched_day, CASE WHEN r.day - b.day <= 60 THEN b.returned END AS returned FROM r ASOF LEFT JOIN b ON b.l_suppkey = r.l_suppkey AND b.day <= r.day""",
    "dry_spells_in_transit": f"""WITH {BASE}, d AS (SELECT cell_id, date AS "from", CAST(date + INTERVAL 1 MONTH AS DATE) AS until FROM panel WHERE precip < 150.0),
l AS (SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT cell_id, "from", COUNT(*) AS n_lines, CAST(MAX(day + 45) AS DATE) AS last_end FROM l JOIN d USING (cell_id) WHERE day < until AND "from" < day + 45 GROUP BY 1, 2""",
    "merged_sketches": f"""WITH {CELLS} SELECT nation, COUNT(*) AS n, COUNT(DISTINCT l_orderkey) AS exact_distinct, TRUE AS distinct_within, TRUE AS median_within
FROM lineitem JOIN cells ON cell_id = l_suppkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1""",
    "training_rows": f"{TRAINING} SELECT split, COUNT(*) AS n, round(AVG(actual), 6) AS mean_actual, MIN(date) AS first FROM kept GROUP BY 1",
}
