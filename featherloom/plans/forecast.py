"""Backtests, search, model selection, forecast inference and the workflow over stored tables.

Tables are append-only; the latest row of a key wins.
"""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.operators.ordered import literal_for, lookup_join, q
from featherloom.operators.relational import inference_window, qualify, select_dates, training_cutoff
from featherloom.operators.timeseries import add_inference_dates, prepare_timeseries
from featherloom.operators.windows import latest_fold
from featherloom.params import ParameterError, one_of
from featherloom.plans import gram
from featherloom.plans.chain import FeatureChain
from featherloom.plans.metrics import regression_metrics
from featherloom.plans.models import METRICS, PREDICTION, FittedModel, _in_threads, fit_model, regressor
from featherloom.plans.splitters import FoldDates, fold_dates
from featherloom.session import materialise, new_path
from featherloom.sources.files import append_rows

# ---- backtest --------------------------------------------------------------------------


def backtest(
    df: DataFrame, model_type: str, target: str, features: Sequence[str], date_column: str, keys: Sequence[str],
    folds: dict, parameters: dict | None = None, parallelism: int = 4, refit: bool = True,
) -> tuple[FittedModel | None, DataFrame, DataFrame]:
    """Fit per fold, predict its train and validation rows, score; then refit on everything.

    Returns (model, scores by fold and split, predictions). ``folds`` are the fold settings. Rows are never copied per
    fold: see :func:`fold_predictions`.
    """
    regressor(model_type, parameters)  # refuses unknown names before any work
    columns = list(dict.fromkeys([*keys, date_column, target, *features]))
    rows = df.select(*[q(c) for c in columns])
    predictions = fold_predictions(rows, [gram.Trial.of(model_type, features, parameters)], target, features, date_column, fold_dates(rows, date_column, **folds), parallelism).drop("trial")
    scores = regression_metrics(predictions, target, PREDICTION, ["fold", "split"])
    model = fit_model(df, model_type, target, features, parameters) if refit else None
    return model, scores, predictions


def fold_predictions(
    rows: DataFrame, trials: Sequence[gram.Trial], target: str, features: Sequence[str], date_column: str, dates: FoldDates, parallelism: int = 4,
) -> DataFrame:
    """``rows`` with ``trial``, ``fold``, ``split`` and the prediction of that trial's model of the fold, one row for each.

    Linear, lasso and elastic-net models of all folds and trials are solved from sums per date: one pass fits, and
    the predictions are made while the rows stream by. Other models read, for each fold, the range of dates
    it trains on from a table written once in the order of its dates.
    """
    linear = [(i, t) for i, t in enumerate(trials) if t.model_type in gram.LINEAR]
    parts = []
    if linear:
        filled = rows.withColumns({f: F.coalesce(q(f).cast("double"), F.lit(0.0)) for f in features})
        known = filled.where(q(target).isNotNull() & q(date_column).isNotNull())
        models = gram.fold_models(known, target, features, date_column, dates.numbered, dates.bounds(), [t for _, t in linear])
        number = F.element_at(F.array(*[F.lit(i) for i, _ in linear]), F.col("trial") + 1)
        models = models.withColumn("trial", number).groupBy("fold").agg(F.collect_list(F.struct("trial", "intercept", "weights")).alias("__models"))
        placed = lookup_join(dates.with_folds(rows), models, ["fold"], "inner").withColumn("__model", F.explode("__models")).drop("__models")
        inputs = F.array(*[F.coalesce(q(f).cast("double"), F.lit(0.0)) for f in features])
        dot = F.aggregate(F.zip_with("__model.weights", inputs, lambda w, x: w * x), F.col("__model.intercept"), lambda total, x: total + x)
        parts.append(placed.withColumns({"trial": F.col("__model.trial"), PREDICTION: dot}).drop("__model"))
    others = [(i, t) for i, t in enumerate(trials) if t.model_type not in gram.LINEAR]
    if others:
        ordered = materialise(rows.where(q(date_column).isNotNull()).repartitionByRange(q(date_column)).sortWithinPartitions(q(date_column)), "by-date")
        ranges = dates.ranges()

        def one(job: tuple[int, gram.Trial, dict]) -> DataFrame:
            i, trial, r = job
            date, (first, validates, last) = q(date_column), (literal_for(rows, date_column, r[k]) for k in ("first", "validates", "last"))
            own = ordered.where((date >= first) & (date <= last)).withColumns({"trial": F.lit(i), "fold": F.lit(r["fold"]), "split": F.when(date < validates, "train").otherwise("validation")})
            return fit_model(own.where(date < validates), trial.model_type, target, trial.features, json.loads(trial.parameters)).predict(own)

        parts += _in_threads(one, [(i, t, r) for i, t in others for r in ranges], parallelism)
    return reduce(DataFrame.unionByName, parts)


def long_scores(scores: DataFrame, run_id: str, **ids) -> DataFrame:
    """Score rows as stored: run, split, fold, score_name, score_value."""
    long = scores.unpivot(["fold", "split"], [m for m in METRICS if m in scores.columns], "score_name", "score_value")
    return long.withColumns({"run_id": F.lit(run_id), **{k: F.lit(v) for k, v in ids.items()}})


def final_predictions(predictions: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test rows plus, for every key, the validation row of its last fold."""
    validation = latest_fold(predictions.where("split = 'validation'"), keys)
    return test.unionByName(validation, allowMissingColumns=True)


def forecast_test_period(
    model: FittedModel, chain: FeatureChain | None, train_rows: DataFrame, test_rows: DataFrame, date_column: str, target: str, clip: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Predict the test dates with features built over train and test together; returns rows and scores."""
    lo, hi = test_rows.agg(F.min(q(date_column)), F.max(q(date_column))).first()
    together = train_rows.unionByName(test_rows)
    features = chain.transform(together) if chain else together
    rows = model.predict(select_dates(features, date_column, lo, hi), clip).withColumns({"split": F.lit("test"), "fold": F.lit(None).cast("int")})
    return rows, regression_metrics(rows, target, PREDICTION)


# ---- search ----------------------------------------------------------------------------


def draw(space: dict, rng: random.Random) -> dict:
    """One point of a space: {"name": {"type": "int" | "float" | "categorical", "low", "high", "step", "log", "choices"}}."""
    point = {}
    for name, s in space.items():
        kind = one_of(s["type"], ("int", "float", "categorical"), "type")
        if kind == "categorical":
            point[name] = rng.choice(list(s["choices"]))
        elif s.get("log"):
            value = s["low"] * (s["high"] / s["low"]) ** rng.random()
            point[name] = int(round(value)) if kind == "int" else value
        elif s.get("step"):
            point[name] = s["low"] + s["step"] * rng.randint(0, int((s["high"] - s["low"]) / s["step"] + 1e-9))
        else:
            point[name] = rng.randint(s["low"], s["high"]) if kind == "int" else rng.uniform(s["low"], s["high"])
    return point


def drawn_trials(features: Sequence[str], optional_features: Sequence[str], space: dict, n_trials: int = 20, seed: int = 42) -> list[dict]:
    rng = random.Random(seed)
    fixed = [f for f in features if f not in optional_features]
    trials: list[dict] = []
    while len(trials) < n_trials:
        chosen = fixed + [f for f in optional_features if rng.random() < 0.5]
        if chosen:
            trials.append({"parameters": draw(space, rng), "features": chosen})
    return trials


def search(
    df: DataFrame, model_type: str, target: str, features: Sequence[str], date_column: str, keys: Sequence[str], folds: dict,
    space: dict | None = None, n_trials: int = 20, metric: str = "rmse", direction: str = "minimize", last_folds: int | None = None,
    optional_features: Sequence[str] = (), seed: int = 42, trials: Sequence[dict] | None = None, parallelism: int = 4,
) -> DataFrame:
    """Random search; a trial's value is the mean validation metric over its last folds.

    Rows with a null are dropped first. ``optional_features`` are switched on or off per trial;
    explicit ``trials`` ({"parameters", "features"}) replace the draws. One row per trial, best first.
    """
    one_of(direction, ("minimize", "maximize"), "direction")
    one_of(metric, METRICS, "metric")
    if trials is None:
        trials = drawn_trials(features, optional_features, space or {}, n_trials, seed)
    used = list(dict.fromkeys([*keys, date_column, target, *features, *(f for t in trials for f in t["features"])]))
    rows = df.select(*[q(c) for c in used]).dropna()
    for t in trials:
        regressor(model_type, t.get("parameters"))
    rows = materialise(rows, "search")  # every trial reads this table
    dates = fold_dates(rows, date_column, **folds)
    every = list(dict.fromkeys(f for t in trials for f in t["features"]))
    predictions = fold_predictions(rows, [gram.Trial.of(model_type, t["features"], t.get("parameters")) for t in trials], target, every, date_column, dates, parallelism)
    scores = regression_metrics(predictions.where("split = 'validation'"), target, PREDICTION, ["trial", "fold"])
    values = scores.where(F.col("fold") >= dates.folds - (last_folds or dates.folds)).groupBy("trial").agg(F.avg(metric).alias("value"))
    about = [(i, json.dumps(t.get("parameters") or {}, sort_keys=True), ",".join(t["features"])) for i, t in enumerate(trials)]
    out = df.sparkSession.createDataFrame(about, "trial int, parameters string, features string").join(values, "trial")
    return out.orderBy(F.asc("value") if direction == "minimize" else F.desc("value"), "trial")


# ---- selection -------------------------------------------------------------------------


def best_run(scores: DataFrame, metric: str, direction: str = "minimize", split: str = "validation") -> DataFrame:
    """The run whose best score of the metric on the split wins; ties go to the smallest run id."""
    rows = scores.where((F.col("score_name") == metric) & (F.col("split") == split) & F.col("score_value").isNotNull())
    value = F.col("score_value") if direction == "minimize" else -F.col("score_value")
    best = rows.agg(F.min_by(F.struct("run_id", "score_value"), F.struct(value.alias("v"), F.col("run_id").alias("r"))).alias("b"))
    return best.where("b IS NOT NULL").select("b.*")


def selection_changes(scores: DataFrame, status_log: DataFrame, metric: str, direction: str = "minimize") -> DataFrame:
    """Rows to append to the status log: the old run disabled and the new one enabled, or nothing.

    ``status_log`` = (experiment_id, run_id, status, created_at); its newest row per experiment counts.
    """
    value = F.col("score_value") if direction == "minimize" else -F.col("score_value")
    rows = scores.where((F.col("score_name") == metric) & (F.col("split") == "validation") & F.col("score_value").isNotNull())
    best = rows.groupBy("experiment_id").agg(F.min_by("run_id", F.struct(value.alias("v"), F.col("run_id").alias("r"))).alias("best"))
    current = qualify(status_log.where("status = 'enabled'"), ["experiment_id"], ["created_at", "run_id"]).select("experiment_id", F.col("run_id").alias("old"))
    both = lookup_join(best, current, ["experiment_id"]).where(~F.col("best").eqNullSafe(F.col("old")))
    enabled = both.select("experiment_id", F.col("best").alias("run_id"), F.lit("enabled").alias("status"))
    disabled = both.where("old IS NOT NULL").select("experiment_id", F.col("old").alias("run_id"), F.lit("disabled").alias("status"))
    return disabled.unionByName(enabled)


# ---- inference -------------------------------------------------------------------------


def infer(
    history: DataFrame, model: FittedModel, chain: FeatureChain | None, date_column: str, dimensions: Sequence[str], metric_column: str,
    last_date: str, first_date: str | None = None, periodicity: str = "daily", ids: dict | None = None,
) -> DataFrame:
    """Prediction rows for the dates up to ``last_date`` (only that date without ``first_date``).

    ``history`` is a prepared series. Negative predictions become 0, missing ones too.
    """
    extended = add_inference_dates(history, last_date, date_column, dimensions, metric_column, periodicity)
    features = chain.transform(extended) if chain else extended
    window = [first_date or last_date, last_date]
    predicted = model.predict(inference_window(features, date_column, window), clip=True)
    series = inference_window(extended, date_column, window).select(*[q(d) for d in dimensions], q(date_column))
    slim = predicted.select(*[q(d) for d in dimensions], q(date_column), F.to_json(F.struct(*[q(c) for c in model.features])).alias("features"), F.col(PREDICTION))
    rows = series.join(slim, [*dimensions, date_column], "left")  # (series, date) is unique on both sides
    return rows.select(
        *[F.lit(v).alias(k) for k, v in (ids or {}).items()], F.to_json(F.struct(*[q(d) for d in dimensions])).alias("dimensions"),
        q(date_column).alias("date"), "features", F.lit("predictions").alias("prediction_name"), F.coalesce(PREDICTION, F.lit(0.0)).alias("prediction_value"),
    )


# ---- workflow over tables --------------------------------------------------------------


class Workspace:
    """Use case, experiment, feature store, tuning, selection and inference as appends to tables."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or new_path(spark, "workspace")

    def append(self, table: str, df: DataFrame) -> None:
        append_rows(df, table, f"{self.root}/{table}")

    def table(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{table}")
        except AnalysisException:
            return None

    def latest(self, table: str, keys: Sequence[str]) -> DataFrame:
        rows = self.table(table)
        if rows is None:
            raise ParameterError(f"table {table} has no rows yet")
        return qualify(rows, keys, ["created_at", "id"])

    def _row(self, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))

    def create_use_case(self, use_case_id: str, name: str) -> None:
        self.append("dim_use_cases", self._row(use_case_id=use_case_id, name=name))

    def create_experiment(self, experiment_id: str, use_case_id: str, settings: dict) -> None:
        known = self.latest("dim_use_cases", ["use_case_id"]).where(F.col("use_case_id") == use_case_id)
        if not known.limit(1).count():
            raise ParameterError(f"unknown use case {use_case_id!r}")
        self.append("dim_experiments", self._row(experiment_id=experiment_id, use_case_id=use_case_id, settings=json.dumps(settings)))

    def settings(self, experiment_id: str) -> dict:
        row = self.latest("dim_experiments", ["experiment_id"]).where(F.col("experiment_id") == experiment_id).first()
        if row is None:
            raise ParameterError(f"unknown experiment {experiment_id!r}")
        return json.loads(row["settings"])

    def build_features(self, experiment_id: str, source: DataFrame, feature_store_id: str) -> DataFrame:
        """Prepare the series up to the cut-off, fit the chain on the training dates, store wide features."""
        s = self.settings(experiment_id)
        rows = training_cutoff(source, s["date_column"], s["last_test_date"])
        series = prepare_timeseries(rows, s["date_column"], s["dimensions"], s["metric"], s.get("aggregation", "sum"), s["metric"], s.get("periodicity", "daily"))
        chain = FeatureChain(s["steps"]).fit(training_cutoff(series, s["date_column"], s["last_train_date"]))
        path = f"{self.root}/chains/{feature_store_id}"
        chain.save(self.spark, path)
        features = chain.transform(series)
        features.write.mode("overwrite").parquet(f"{self.root}/features/{feature_store_id}")
        self.append("dim_features", self._row(experiment_id=experiment_id, feature_store_id=feature_store_id, chain_path=path))
        return self.features(feature_store_id)

    def features(self, feature_store_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/features/{feature_store_id}")

    def tune(self, experiment_id: str, feature_store_id: str, candidates: dict[str, tuple[str, dict]]) -> None:
        """Backtest every candidate run {run_id: (model type, parameters)}; store scores, forecasts and models."""
        s = self.settings(experiment_id)
        rows = training_cutoff(self.features(feature_store_id), s["date_column"], s["last_train_date"])
        ids = {"experiment_id": experiment_id, "feature_store_id": feature_store_id}
        for run_id, (model_type, parameters) in candidates.items():
            model, scores, predictions = backtest(rows, model_type, s["metric"], s["features"], s["date_column"], s["dimensions"], s["folds"], parameters)
            self.append("hpt_scores", long_scores(scores, run_id, **ids))
            forecasts = predictions.select(
                q(s["date_column"]).alias("date"), F.to_json(F.struct(*[q(d) for d in s["dimensions"]])).alias("dim_uid"),
                F.to_json(F.struct(*[q(f) for f in s["features"]])).alias("features"), q(s["metric"]).cast("double").alias("target_value"),
                F.col(PREDICTION).alias("prediction_value"), "split", "fold", F.lit(run_id).alias("run_id"), *[F.lit(v).alias(k) for k, v in ids.items()],
            )
            self.append("hpt_forecasts", forecasts)
            model.save(self.spark, f"{self.root}/models/{run_id}")
            self.append("dim_runs", self._row(run_id=run_id, **ids, model_path=f"{self.root}/models/{run_id}"))

    def select(self, experiment_id: str, metric: str = "rmse", direction: str = "minimize") -> None:
        """Enable the best run, disable the previous one; nothing happens when it stays the best."""
        scores = self.table("hpt_scores").where(F.col("experiment_id") == experiment_id)
        log = self.table("model_selection")
        if log is None:
            log = self.spark.createDataFrame([], "experiment_id string, run_id string, status string, created_at timestamp_ntz, id string")
        log = log.where(F.col("experiment_id") == experiment_id)
        mean = scores.groupBy("experiment_id", "run_id", "split", "score_name").agg(F.avg("score_value").alias("score_value"))
        changes = materialise(selection_changes(mean, log, metric, direction), "selection")
        if changes.limit(1).count():
            self.append("model_selection", changes)

    def selected_run(self, experiment_id: str) -> str:
        row = qualify(self.table("model_selection").where("status = 'enabled'"), ["experiment_id"], ["created_at", "run_id"])
        return row.where(F.col("experiment_id") == experiment_id).first()["run_id"]

    def infer(self, experiment_id: str, source: DataFrame, last_date: str, first_date: str | None = None, inference_id: str = "1") -> DataFrame:
        s = self.settings(experiment_id)
        run = self.latest("dim_runs", ["run_id"]).where(F.col("run_id") == self.selected_run(experiment_id)).first()
        store = self.latest("dim_features", ["feature_store_id"]).where(F.col("feature_store_id") == run["feature_store_id"]).first()
        chain = FeatureChain.load(self.spark, store["chain_path"])
        series = prepare_timeseries(source, s["date_column"], s["dimensions"], s["metric"], s.get("aggregation", "sum"), s["metric"], s.get("periodicity", "daily"))
        rows = infer(series, FittedModel.load(self.spark, run["model_path"]), chain, s["date_column"], s["dimensions"], s["metric"], last_date, first_date,
                     s.get("periodicity", "daily"), {"inference_id": inference_id, "experiment_id": experiment_id})
        rows = materialise(rows, "inference")
        self.append("inference", rows)
        return rows
