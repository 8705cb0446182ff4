"""Composites, gap filling and the statistics of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.series import DEFAULT_FEATURES, feature_name
from fieldloom.operators import series as S
from fieldloom.operators.tables import wide_to_long
from fieldloom.plans import views as V
from fieldloom.plans.registry import Tables, cte, half_up_sql, query

cte(
    "v_s",
    """SELECT cell, band, pos AS t, dayofyear(slot) AS doy, value AS x, lag(value) OVER w AS prev,
         lead(value, 1) OVER w AS a1, lead(value, 2) OVER w AS a2, lead(value, 3) OVER w AS a3,
         least(greatest(avg(value) OVER p, min(value) OVER p), max(value) OVER p) AS mu,
         stddev_pop(value) OVER p AS sigma, row_number() OVER w AS nth
       FROM v_full WHERE value IS NOT NULL
       WINDOW w AS (PARTITION BY cell, band ORDER BY pos), p AS (PARTITION BY cell, band)""",
)
cte(
    "v_sr",
    """SELECT *,
         nth - coalesce(max(CASE WHEN x <= mu THEN nth END) OVER g, 0) AS run_above,
         nth - coalesce(max(CASE WHEN x >= mu THEN nth END) OVER g, 0) AS run_below
       FROM v_s WINDOW g AS (PARTITION BY cell, band ORDER BY t ROWS UNBOUNDED PRECEDING)""",
)


def _autocorr(lag: int) -> str:
    return (
        f"CASE WHEN var_pop(x) > 0 AND count(x) > {lag} THEN "
        f"sum((x - mu) * (a{lag} - mu)) / ((count(x) - {lag}) * var_pop(x)) END"
    )


# SQL twin of every statistic
SQL_FEATURE = {
    "abs_energy": "sum(x * x)",
    "absolute_sum_of_changes": "coalesce(sum(abs(x - prev)), 0.0)",
    "autocorr_lag_1": _autocorr(1),
    "autocorr_lag_2": _autocorr(2),
    "autocorr_lag_3": _autocorr(3),
    "count_above_mean": "count(*) FILTER (WHERE x > mu)",
    "count_below_mean": "count(*) FILTER (WHERE x < mu)",
    "doy_of_maximum": "CAST(first(doy ORDER BY x DESC, t) AS INTEGER)",
    "doy_of_minimum": "CAST(first(doy ORDER BY x, t) AS INTEGER)",
    "kurtosis": "CASE WHEN var_pop(x) > 0 THEN kurtosis_pop(x) END",
    "large_standard_deviation_r_0_25": "stddev_pop(x) > 0.25 * (max(x) - min(x))",
    "longest_strike_above_mean": "CAST(max(run_above) AS INTEGER)",
    "longest_strike_below_mean": "CAST(max(run_below) AS INTEGER)",
    "maximum": "max(x)",
    "mean": "avg(x)",
    "mean_abs_change": "avg(abs(x - prev))",
    "mean_change": "avg(x - prev)",
    "mean_second_derivative_central": "avg((a2 - 2 * a1 + x) / 2)",
    "median": "median(x)",
    "minimum": "min(x)",
    "ols_slope_intercept_returns_slope": "CASE WHEN count(x) > 1 THEN regr_slope(x, t) END",
    "ols_slope_intercept_returns_intercept": "CASE WHEN count(x) > 1 THEN regr_intercept(x, t) END",
    "ols_slope_intercept_returns_rsquared": "CASE WHEN var_pop(x) > 0 THEN regr_r2(x, t) END",
    "quantile_q_0_05": "quantile_cont(x, 0.05)",
    "quantile_q_0_95": "quantile_cont(x, 0.95)",
    "ratio_beyond_r_sigma_r_1": "avg(CASE WHEN abs(x - mu) > 1 * sigma THEN 1.0 ELSE 0.0 END)",
    "ratio_beyond_r_sigma_r_2": "avg(CASE WHEN abs(x - mu) > 2 * sigma THEN 1.0 ELSE 0.0 END)",
    "skewness": "CASE WHEN count(x) > 2 AND var_pop(x) > 0 THEN skewness(x) END",
    "standard_deviation": "stddev_pop(x)",
    "sum": "sum(x)",
    "symmetry_looking_r_0_05": "abs(avg(x) - median(x)) < 0.05 * (max(x) - min(x))",
    "ts_complexity_cid_ce": "sqrt(coalesce(sum((x - prev) * (x - prev)), 0.0))",
    "variance": "var_pop(x)",
    "variance_larger_than_standard_deviation": "var_pop(x) > stddev_pop(x)",
}
PLAIN = {"doy_of_maximum", "doy_of_minimum", "count_above_mean", "count_below_mean"}


def _sql_value(name: str) -> str:
    text = SQL_FEATURE[name]
    whole = name in PLAIN or name.startswith(("longest", "large", "symmetry", "variance_larger"))
    return text if whole else half_up_sql(text)


# query key -> statistics; one key per operator of the inventory
KEYS = {
    "ts_abs_energy": [("abs_energy", {})],
    "ts_abs_sum_changes": [("absolute_sum_of_changes", {})],
    "ts_autocorr": [("autocorr", {"lag": lag}) for lag in (1, 2, 3)],
    "ts_count_above_mean": [("count_above_mean", {})],
    "ts_count_below_mean": [("count_below_mean", {})],
    "ts_doy_of_maximum": [("doy_of_maximum", {})],
    "ts_doy_of_minimum": [("doy_of_minimum", {})],
    "ts_kurtosis": [("kurtosis", {})],
    "ts_large_standard_deviation": [("large_standard_deviation", {"r": 0.25})],
    "ts_longest_strike_above_mean": [("longest_strike_above_mean", {})],
    "ts_longest_strike_below_mean": [("longest_strike_below_mean", {})],
    "ts_maximum": [("maximum", {})],
    "ts_minimum": [("minimum", {})],
    "ts_mean": [("mean", {})],
    "ts_mean_abs_change": [("mean_abs_change", {})],
    "ts_mean_change": [("mean_change", {})],
    "ts_mean_second_derivative_central": [("mean_second_derivative_central", {})],
    "ts_median": [("median", {})],
    "ts_linear_trend": [("ols_slope_intercept", {"returns": r}) for r in ("slope", "intercept", "rsquared")],
    "ts_quantile": [("quantile", {"q": q}) for q in (0.05, 0.95)],
    "ts_ratio_beyond_r_sigma": [("ratio_beyond_r_sigma", {"r": r}) for r in (1, 2)],
    "ts_skewness": [("skewness", {})],
    "ts_standard_deviation": [("standard_deviation", {})],
    "ts_variance": [("variance", {})],
    "ts_sum": [("sum", {})],
    "ts_symmetry_looking": [("symmetry_looking", {"r": 0.05})],
    "ts_complexity_cid_ce": [("ts_complexity_cid_ce", {})],
    "ts_variance_larger_than_sd": [("variance_larger_than_standard_deviation", {})],
}


def _register(key: str, wanted: list[tuple[str, dict]]) -> None:
    names = [feature_name(f, p) for f, p in wanted]
    columns = ", ".join(f"{_sql_value(n)} AS {n}" for n in names)

    @query(key, f"SELECT cell, band, {columns} FROM v_sr GROUP BY cell, band", slack=True)
    def _(t: Tables) -> DataFrame:
        return S.series_features(V.full(t), V.SERIES, "slot", "value", features=wanted)


for _key, _wanted in KEYS.items():
    _register(_key, _wanted)

_ALL = [feature_name(f, p) for f, p in DEFAULT_FEATURES]
_WIDE = ",\n".join(
    f"max({n}) FILTER (WHERE band = '{b}') AS {b}_{n}"
    if not n.startswith(("large", "symmetry", "variance_larger"))
    else f"bool_or({n}) FILTER (WHERE band = '{b}') AS {b}_{n}"
    for b in V.BANDS
    for n in _ALL
)


@query(
    "ts_feature_table",
    f"""WITH f AS (SELECT cell, band, {", ".join(f"{_sql_value(n)} AS {n}" for n in _ALL)}
                   FROM v_sr GROUP BY cell, band),
             w AS (SELECT cell, {_WIDE} FROM f GROUP BY cell)
        SELECT p.lc_name, w.* FROM w LEFT JOIN v_points p ON p.id = w.cell""",
    slack=True,
)
def ts_feature_table(t: Tables) -> DataFrame:
    features = S.series_features(V.full(t), V.SERIES, "slot", "value")
    wide = S.band_pivot(features, V.CELL, "band", V.BANDS, _ALL)
    labels = V.points(t).select(F.col("id").alias("cell"), "lc_name")
    return wide.join(labels, "cell", "left")


@query(
    "monthly_composite",
    "SELECT cell, band, slot, round(value, 6) AS value FROM v_comp",
)
def monthly_composite(t: Tables) -> DataFrame:
    return V.composite(t)


@query(
    "nodata_null",
    """SELECT event_id, nullif(CAST(floor(value) AS BIGINT), 0) AS value FROM events""",
)
def nodata_null(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.nodata_to_null(F.floor("value")).alias("value"))


@query(
    "composite_encode",
    """SELECT cell, band, slot,
         CAST(trunc(least(greatest(coalesce(value * 1000, 0), -32768), 32767)) AS SMALLINT) AS coded,
         CAST(trunc(least(greatest(coalesce(value * 1000, 0), 0), 65535)) AS INTEGER) AS coded_hue
       FROM v_comp""",
)
def composite_encode(t: Tables) -> DataFrame:
    scaled = F.col("value") * 1000
    return V.composite(t).select(
        "cell", "band", "slot", S.encode_band(scaled).alias("coded"), S.encode_band(scaled, "uint16").alias("coded_hue")
    )


@query("interpolate_series", "SELECT cell, band, slot, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM v_full")
def interpolate_series(t: Tables) -> DataFrame:
    return V.full(t)


@query(
    "stack_split",
    "SELECT cell, band, CAST(pos AS INTEGER) AS pos, slot, round(value, 6) AS value FROM v_full",
)
def stack_split(t: Tables) -> DataFrame:
    slots = S.slot_calendar(V.raw(t), "slot")
    stacks = V.full(t).groupBy("cell", "band").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]
        ).alias("stack")
    )
    return S.split_stack(stacks, V.SERIES, "stack", slots)


@query(
    "wide_to_long",
    """SELECT cell, 'v' AS stub, band AS suffix, round(value, 6) AS value FROM (
         SELECT c.cell, b.band, s.value
         FROM (SELECT DISTINCT cell FROM v_raw) c CROSS JOIN (SELECT DISTINCT band FROM v_raw) b
         LEFT JOIN (SELECT cell, band, sum(value) AS value FROM v_raw GROUP BY ALL) s
           ON s.cell = c.cell AND s.band = b.band)""",
)
def to_long(t: Tables) -> DataFrame:
    sums = V.raw(t).groupBy("cell", "band").agg(F.sum("value").alias("value"))
    wide = S.band_pivot(sums, V.CELL, "band", V.BANDS, ["value"])
    named = wide.select("cell", *[F.col(f"{b}_value").alias(f"v-{b}") for b in V.BANDS])
    return wide_to_long(named, ["cell"], [f"v-{b}" for b in V.BANDS])


@query(
    "band_pivot",
    "SELECT cell, slot, "
    + ", ".join(f"round(max(value) FILTER (WHERE band = '{b}'), 6) AS {b}_value" for b in V.BANDS)
    + " FROM v_comp GROUP BY cell, slot",
)
def band_pivot(t: Tables) -> DataFrame:
    return S.band_pivot(V.composite(t), ["cell", "slot"], "band", V.BANDS, ["value"])


@query(
    "class_profile",
    """SELECT p.lc_name, f.slot, round(avg(f.value), 6) AS mean_value, round(median(f.value), 6) AS median_value
       FROM v_full f JOIN v_points p ON p.id = f.cell WHERE f.band = 'view' GROUP BY ALL""",
)
def class_profile(t: Tables) -> DataFrame:
    one = V.full(t).where(F.col("band") == "view")
    labels = V.points(t).select(F.col("id").alias("cell"), "lc_name")
    return S.class_profile(one.join(labels, "cell"), "lc_name", "slot", "value")


@query(
    "monthly_series",
    """WITH m AS (SELECT cell, band, slot, median(nullif(value, 0)) AS value FROM v_monthly GROUP BY ALL),
       cal AS (SELECT CAST(g AS DATE) AS slot, CAST(row_number() OVER (ORDER BY g) - 1 AS INTEGER) AS pos FROM (
         SELECT unnest(generate_series((SELECT min(slot) FROM v_monthly), (SELECT max(slot) FROM v_monthly), INTERVAL 1 MONTH)) AS g)),
       grid AS (SELECT k.cell, k.band, cal.slot, cal.pos, m.value FROM (SELECT DISTINCT cell, band FROM m) k CROSS JOIN cal
         LEFT JOIN m ON m.cell = k.cell AND m.band = k.band AND m.slot = cal.slot),
       near AS (SELECT *, last_value(value IGNORE NULLS) OVER pre AS w0, first_value(value IGNORE NULLS) OVER post AS w1,
           last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER pre AS p0,
           first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER post AS p1 FROM grid
         WINDOW pre AS (PARTITION BY cell, band ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                post AS (PARTITION BY cell, band ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
       SELECT cell, band, slot, pos, round(coalesce(value, w0 + (w1 - w0) * (CAST(pos - p0 AS DOUBLE) / (p1 - p0)), w0, w1), 6) AS value FROM near""",
)
def monthly_series(t: Tables) -> DataFrame:
    """The workflow's own step: one slot a month."""
    return S.filled_series(V.monthly(t), V.CELL, "band", "slot", "value", step="month")
