"""Registry of statistics over one cell's ordered series of one band.

A builder gets its parameters and returns an aggregate, as SQL text over the
series columns or as a column.  All statistics of a table are computed in one
aggregation, which stays in generated code: moments are sums of deviations from a
window mean, order statistics and positions are read by ``max`` and ``min``.

Series columns, one row per slot with a value: ``x`` value, ``t`` slot position,
``doy`` day of year, ``mu`` mean, ``n`` number and ``rank`` ascending order (from 0)
of the values, ``low``, ``top`` and ``sigma`` extremes and deviation, ``prev`` value
before, ``ahead_<k>`` value k places on, ``run_above`` and ``run_below`` length of
the run above or below the mean that ends here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., "str | Column"]
REGISTRY: dict[str, Builder] = {}
# series columns a function needs beyond x, t, doy and mu
READS: dict[str, set[str]] = {}


def register(name: str, *reads: str) -> Callable[[Builder], Builder]:
    """Add a statistic; ``reads`` names the extra series columns it needs."""

    def keep(builder: Builder) -> Builder:
        REGISTRY[name] = builder
        READS[name] = set(reads)
        return builder

    return keep


def _text(name: str, text: str, *reads: str) -> None:
    register(name, *reads)(lambda: text)


def _moment(k: int) -> str:
    """Sum of the k-th powers of the deviations."""
    return f"sum({' * '.join(['(x - mu)'] * k)})"


COUNT = "count(x)"
SPREAD = "(max(x) - min(x))"
VARIANCE = f"({_moment(2)} / {COUNT})"
DEVIATION = f"sqrt({VARIANCE})"


def _at_rank(q: float) -> str:
    """Linear-interpolated quantile from the ranked values."""
    place, at = f"({q!r}D * (n - 1))", f"({q!r}D * ({COUNT} - 1))"
    low = f"max(if(rank = floor{place}, x, null))"
    high = f"max(if(rank = ceil{place}, x, null))"
    return f"({low} + ({high} - {low}) * ({at} - floor{at}))"


def _doy_of(extreme: str) -> str:
    """Day of year of the first slot holding the extreme; slot and day packed in one number."""
    return f"cast(min(if(x = {extreme}, cast(t AS bigint) * 1000 + doy, null)) % 1000 AS int)"


_text("abs_energy", "sum(x * x)")
# a series of one value has no change at all
_text("absolute_sum_of_changes", "coalesce(sum(abs(x - prev)), 0D)", "prev")
_text("count_above_mean", "count_if(x > mu)")
_text("count_below_mean", "count_if(x < mu)")
_text("doy_of_maximum", _doy_of("top"), "top")
_text("doy_of_minimum", _doy_of("low"), "low")
_text("kurtosis", f"if({_moment(2)} > 0, {_moment(4)} * {COUNT} / ({_moment(2)} * {_moment(2)}) - 3, null)")
_text("longest_strike_above_mean", "max(run_above)", "run_above")
_text("longest_strike_below_mean", "max(run_below)", "run_below")
_text("maximum", "max(x)")
_text("mean", "avg(x)")
_text("mean_abs_change", "avg(abs(x - prev))", "prev")
_text("mean_change", "avg(x - prev)", "prev")
_text("median", _at_rank(0.5), "rank")
_text("minimum", "min(x)")
_text("standard_deviation", DEVIATION)
_text("sum", "sum(x)")
_text("ts_complexity_cid_ce", "sqrt(coalesce(sum((x - prev) * (x - prev)), 0D))", "prev")
_text("variance", VARIANCE)
_text("variance_larger_than_standard_deviation", f"{VARIANCE} > {DEVIATION}")


@register("autocorr", "lag")
def _autocorr(lag: int) -> str:
    products = f"sum((x - mu) * (ahead_{lag} - mu))"
    known = f"{_moment(2)} > 0 AND {COUNT} > {lag}"
    return f"if({known}, try_divide({products}, ({COUNT} - {lag}) * {VARIANCE}), null)"


@register("large_standard_deviation")
def _large_sd(r: float) -> str:
    return f"{DEVIATION} > {float(r)!r}D * {SPREAD}"


@register("symmetry_looking", "rank")
def _symmetry(r: float) -> str:
    return f"abs(avg(x) - {_at_rank(0.5)}) < {float(r)!r}D * {SPREAD}"


@register("mean_second_derivative_central", "bend")
def _second_derivative(as_printed: bool = False) -> str:
    bend = "avg((ahead_2 - 2 * ahead_1 + x) / 2)"
    return f"{bend} / 2" if as_printed else bend


@register("ols_slope_intercept")
def _trend(returns: str) -> str:
    middle = f"(sum(t) / {COUNT})"
    time = f"(sum(t * t) - sum(t) * {middle})"
    both = "sum((x - mu) * t)"
    slope = f"try_divide({both}, {time})"
    forms = {
        "slope": slope,
        "intercept": f"avg(x) - {slope} * {middle}",
        "rsquared": f"try_divide({both} * {both}, {time} * {_moment(2)})",
    }
    if returns not in forms:
        raise ValueError(f"returns must be one of {sorted(forms)}, not {returns}")
    return forms[returns]


@register("quantile", "rank")
def _quantile(q: float) -> str:
    return _at_rank(float(q))


@register("ratio_beyond_r_sigma", "sigma")
def _beyond(r: float) -> str:
    return f"avg(if(abs(x - mu) > {float(r)!r}D * sigma, 1D, 0D))"


@register("skewness")
def _skewness() -> str:
    n = f"cast({COUNT} AS double)"
    sample = f"sqrt({_moment(2)} / ({n} - 1))"
    adjusted = f"{n} * {_moment(3)} / (({n} - 1) * ({n} - 2) * {sample} * {sample} * {sample})"
    return f"if({COUNT} > 2 AND {_moment(2)} > 0, {adjusted}, null)"


# The statistics the workflow computes for each band, in its order; fixed values.
DEFAULT_FEATURES: list[tuple[str, dict]] = [
    ("abs_energy", {}),
    ("absolute_sum_of_changes", {}),
    ("autocorr", {"lag": 1}),
    ("autocorr", {"lag": 2}),
    ("autocorr", {"lag": 3}),
    ("count_above_mean", {}),
    ("count_below_mean", {}),
    ("doy_of_maximum", {}),
    ("doy_of_minimum", {}),
    ("kurtosis", {}),
    ("large_standard_deviation", {"r": 0.25}),
    ("longest_strike_above_mean", {}),
    ("longest_strike_below_mean", {}),
    ("maximum", {}),
    ("mean", {}),
    ("mean_abs_change", {}),
    ("mean_change", {}),
    ("mean_second_derivative_central", {}),
    ("median", {}),
    ("minimum", {}),
    ("ols_slope_intercept", {"returns": "slope"}),
    ("ols_slope_intercept", {"returns": "intercept"}),
    ("ols_slope_intercept", {"returns": "rsquared"}),
    ("quantile", {"q": 0.05}),
    ("quantile", {"q": 0.95}),
    ("ratio_beyond_r_sigma", {"r": 1}),
    ("ratio_beyond_r_sigma", {"r": 2}),
    ("skewness", {}),
    ("standard_deviation", {}),
    ("sum", {}),
    ("symmetry_looking", {"r": 0.05}),
    ("ts_complexity_cid_ce", {}),
    ("variance", {}),
    ("variance_larger_than_standard_deviation", {}),
]


def feature_name(function: str, params: dict) -> str:
    """``<function>[_<param>_<value>]``, dots written as underscores."""
    tail = "".join(f"_{k}_{v}" for k, v in params.items())
    return (function + tail).replace(".", "_")


def build(function: str, params: dict) -> Column:
    if function not in REGISTRY:
        raise KeyError(f"unknown series function {function}")
    made = REGISTRY[function](**params)
    return (F.expr(made) if isinstance(made, str) else made).alias(feature_name(function, params))
