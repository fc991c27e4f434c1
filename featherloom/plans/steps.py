"""Named steps: ``{"name": ..., "parameters": {...}}`` to a function over DataFrames.

A step either needs no state, or is fitted on one table and applied to others. New steps are
added with :func:`register`.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from featherloom.functions import scalars as X
from featherloom.operators import encoders as E
from featherloom.operators import relational as R
from featherloom.operators import timeseries as S
from featherloom.operators import windows as W
from featherloom.params import ParameterError


@dataclass(frozen=True)
class Step:
    """``apply(frames..., [state,] **parameters)``; ``fit`` returns the JSON-able state."""

    name: str
    apply: Callable
    fit: Callable | None = None
    inputs: tuple[str, ...] = ("df",)
    any_inputs: bool = False

    def check(self, parameters: dict) -> None:
        """Unknown or missing parameters are errors when the plan is built."""
        allowed, required = set(), set()
        for fn in (self.apply, self.fit) if self.fit else (self.apply,):
            for p in inspect.signature(fn).parameters.values():
                if p.name in (*self.inputs, "state") or p.kind is p.VAR_POSITIONAL:
                    continue
                allowed.add(p.name)
                if p.default is p.empty:
                    required.add(p.name)
        unknown, missing = set(parameters) - allowed, required - set(parameters)
        if unknown or missing:
            raise ParameterError(f"{self.name}: unknown parameters {sorted(unknown)}, missing parameters {sorted(missing)}")

    def fit_state(self, frames: list[DataFrame], parameters: dict):
        return self.fit(*frames, **_known(self.fit, parameters)) if self.fit else None

    def run(self, frames: list[DataFrame], parameters: dict, state=None) -> DataFrame:
        extra = _known(self.apply, parameters)
        return self.apply(*frames, state, **extra) if self.fit else self.apply(*frames, **extra)


def _known(fn: Callable, parameters: dict) -> dict:
    names = inspect.signature(fn).parameters
    return {k: v for k, v in parameters.items() if k in names}


STEPS: dict[str, Step] = {}


def register(name: str, apply: Callable, fit: Callable | None = None, inputs: tuple[str, ...] = ("df",), any_inputs: bool = False) -> Step:
    STEPS[name] = Step(name, apply, fit, inputs, any_inputs)
    return STEPS[name]


def step_named(name: str) -> Step:
    if name not in STEPS:
        raise ParameterError(f"unknown step {name!r}; known: {sorted(STEPS)}")
    return STEPS[name]


def _aggregation(df, dimensions, aggregations, order_by=None):
    return R.aggregate(df, dimensions, [tuple(a) for a in aggregations], order_by)


def _out_of_bounds(df, column, lower_bound, upper_bound):
    return R.drop_rows_out_of_bounds(df, column, lower_bound, upper_bound)


def _duplicates(df, columns, keep="first", order_by=None):
    return R.drop_rows_duplicates(df, columns, keep, order_by)


def _maths(df, columns, transform):
    return X.maths_transform(df, columns, transform)


def _trunc(df, column, unit):
    return X.trunc_date(df, column, unit)


def _flatten_dict(df, state, column, drop_raw_col=False):
    return X.flatten_json(df, column, state, drop_raw_col)


def _fill(df, how_to_fill, group_by=(), order_by=()):
    return E.fill_values(df, how_to_fill, group_by, order_by)


def _basic_calendar(df, datetime_column, holidays=()):
    return X.basic_calendar(df, datetime_column, holidays)


def _merge(left, right, left_on, right_on=None, how="left"):
    return R.merge(left, right, left_on, right_on, how)


def _age(df, datetime_column, dimension_columns, output_column="time_series_age"):
    return W.series_age(df, datetime_column, dimension_columns, output_column)


def _recency(df, datetime_column, dimension_columns, target_column, output_column="time_series_recency"):
    return W.recency(df, datetime_column, dimension_columns, target_column, output_column)


def _frequency(df, datetime_column, dimension_columns, target_column, output_column="time_series_frequency"):
    return W.frequency(df, datetime_column, dimension_columns, target_column, output_column)


def _advanced_calendar(df, all_columns, datetime_column="date"):
    return W.flag_distances(df, all_columns, datetime_column)


def _add_missing_dates(df, date_column, dimensions, periodicity="monthly"):
    return S.add_missing_dates(df, date_column, dimensions, periodicity)


def _dim_calendar(df, calendar, date_column="date"):
    return S.join_calendar(df, calendar, date_column)


def _segments(df, segments, segments_to_keep, dim_value_name="dim_value", date_column_name="date", segment_col="eom_pattern_primary"):
    return S.segment_filter(df, segments, segments_to_keep, dim_value_column=dim_value_name, segment_date_column=date_column_name, segment_column=segment_col)


def _scaling_apply(df, state, overwrite_columns=True):
    return E.apply_scaling(df, state, overwrite_columns)


def _one_hot_apply(df, state, drop_original_column=False):
    return E.apply_one_hot(df, state, drop_original_column)


def _one_hot_fit(df, column, threshold=None):
    return E.fit_one_hot(df, column, threshold)


def _list_apply(df, state, drop_raw_col=False):
    return E.apply_list_vocabulary(df, state, drop_raw_col)


def _pca_apply(df, state):
    return E.apply_pca(df, state)


for _name, _fn in {
    "Lag": W.lag,
    "Aggregation": _aggregation,
    "SelectCols": R.select_cols,
    "DropCols": R.drop_cols,
    "RenameColumns": R.rename_columns,
    "FillColsValues": _fill,
    "DropRowsNA": R.drop_rows_na,
    "DropRowsDuplicates": _duplicates,
    "FilterRows": R.filter_rows,
    "CyclicalTimeTransform": X.cyclical_time,
    "MathsTransform": _maths,
    "PolynomialFeatures": E.polynomial_features,
    "Sort": R.sort,
    "CastTypes": R.cast_types,
    "DropRareLabels": R.drop_rare_labels,
    "DropRowsOutOfBounds": _out_of_bounds,
    "TruncDate": _trunc,
    "BasicCalendar": _basic_calendar,
    "AddMissingDates": _add_missing_dates,
    "RollingFeatures": W.rolling_features,
    "CumulativeMonthlySum": W.cumulative_monthly_sum,
    "PreviousMonthAggregation": W.previous_month_aggregation,
    "TimeSeriesAge": _age,
    "TimeSeriesRecency": _recency,
    "TimeSeriesFrequency": _frequency,
    "TimeSeriesRemoveEarlyZeros": W.remove_early_zeros,
    "AdvancedCalendar": _advanced_calendar,
    "CustomFilter": S.custom_filter,
}.items():
    register(_name, _fn)

register("Concat", R.concat, inputs=("frames",), any_inputs=True)
register("Merge", _merge, inputs=("left", "right"))
register("TimeSeriesDimCalendar", _dim_calendar, inputs=("df", "calendar"))
register("TimeSeriesSegmemtationFiltering", _segments, inputs=("df", "segments"))
register("DropColsZeroVar", lambda df, state: df.drop(*state), lambda df: R.constant_columns(df))
register("DropOutliersIQR", lambda df, state: R.drop_outliers_iqr(df, list(state), {c: tuple(b) for c, b in state.items()}), lambda df, columns: {c: list(b) for c, b in R.iqr_bounds(df, columns).items()})
register("ScalingNumerical", _scaling_apply, E.fit_scaling)
register("EncodeOneHot", _one_hot_apply, _one_hot_fit)
register("OrdinalEncoder", E.apply_ordinal, E.fit_ordinal)
register("FlattenDict", _flatten_dict, X.json_schema)
register("FlattenList", _list_apply, E.fit_list_vocabulary)
register("ReductionPCA", _pca_apply, E.fit_pca)
register("FeatureAgglomeration", E.apply_agglomeration, E.fit_agglomeration)
