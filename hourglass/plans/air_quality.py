"""The dashboard's workflow on its own hourly air-quality CSV layout.

``load`` reads and cleans the file; ``analyses`` builds the data behind every
analysis tab; ``models`` trains and compares the regressors and classifiers
and scores what-if scenarios.  Every value is a lazy DataFrame (or a small
result built from one-row aggregates), computed with the library operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import hypothesis as hyp
from ..operators import ml
from ..operators import profile as prof
from ..operators import relate
from ..operators import timeseries as tsop
from ..operators.clean import (CleanSpec, MedianImputer, add_threshold_target, clean, drop_prefixed,
                               nullify_sentinel)
from ..operators.quantiles import medians
from ..operators.score import scenario_grid, score_scenarios
from ..sources.readers import AIR_QUALITY_SCHEMA, read_csv_known
from ..spec import AIR_QUALITY
from .report import findings

# --- fixed values: the dashboard's column groups, pairs and model inputs ---
TARGET = "CO(GT)"
DROPPED = ("NMHC(GT)",)
BIVARIATE_PAIRS = (("PT08.S1(CO)", "CO(GT)"), ("PT08.S3(NOx)", "NOx(GT)"), ("PT08.S4(NO2)", "NO2(GT)"),
                   ("T", "CO(GT)"), ("RH", "CO(GT)"), ("hour", "CO(GT)"))
REDUNDANCY_PAIRS = (("PT08.S1(CO)", "CO(GT)"), ("PT08.S3(NOx)", "NOx(GT)"), ("PT08.S4(NO2)", "NO2(GT)"))
TIME_FEATURES = ("hour", "month", "weekday", "weekend", "is_rush_hour")
OTHER_TARGETS = ("C6H6(GT)", "NOx(GT)", "NO2(GT)")
# ---------------------------------------------------------------------------

TARGETS = list(AIR_QUALITY.targets)
SENSORS = list(AIR_QUALITY.sensors)
WEATHER = list(AIR_QUALITY.covariates)
NUMERIC = TARGETS + SENSORS + WEATHER
FEATURES = SENSORS + WEATHER + list(TIME_FEATURES) + list(OTHER_TARGETS)


def raw(spark: SparkSession, path: str) -> DataFrame:
    """S1-S3 + P1: the file with junk columns dropped and sentinels as NULL."""
    df = drop_prefixed(read_csv_known(spark, path, AIR_QUALITY_SCHEMA))
    return nullify_sentinel(df, [c for c in df.columns if c not in ("Date", "Time")])


def load(spark: SparkSession, path: str, impute: bool = True) -> DataFrame:
    """The cleaned table (P1-P8, M1, A15) with ``Datetime`` as the time column.

    ``impute=False`` stops before imputation and the target (the input that
    ``models`` expects, so both are fitted on training rows only)."""
    spec = CleanSpec(ts="Datetime", date_col="Date", time_col="Time", drop=DROPPED,
                     sentinel_cols=[c.name for c in AIR_QUALITY_SCHEMA.fields if c.name not in ("Date", "Time")],
                     impute_cols=NUMERIC if impute else [], target=TARGET if impute else None)
    return clean(read_csv_known(spark, path, AIR_QUALITY_SCHEMA), spec)


def analyses(df: DataFrame, raw_df: DataFrame) -> dict[str, DataFrame]:
    """The data behind every analysis tab, keyed '<tab>.<item>'."""
    out: dict[str, DataFrame] = {}
    ts = "Datetime"
    # landing page: the raw file's shape, sensor count and overall missing share
    out["home.kpis"] = prof.shape_kpis(raw_df)
    out["home.missing_pct"] = prof.overall_missing_pct(prof.missing_profile(raw_df))
    # overview
    out["overview.kpis"] = prof.shape_kpis(df, ts=ts)
    out["overview.head"] = df.orderBy(ts).limit(10)
    out["overview.types"] = prof.type_profile(df)
    out["overview.describe"] = prof.describe(df, TARGETS + WEATHER)
    out["overview.dictionary"] = prof.data_dictionary(df, AIR_QUALITY.roles())
    # univariate
    out["univariate.skew"] = prof.skewness(df, NUMERIC)
    for c in NUMERIC:
        out[f"univariate.hist.{c}"] = prof.histogram(df, c, 40)
        out[f"univariate.box.{c}"] = prof.boxplot_stats(df, c)
    # bivariate
    out["bivariate.pairs"] = relate.pair_stats(df, BIVARIATE_PAIRS)
    for x, y in BIVARIATE_PAIRS:
        out[f"bivariate.line.{x}.{y}"] = relate.trend_line(df, x, y)
        out[f"bivariate.scatter.{x}.{y}"] = prof.scatter_bins(df, x, y, 50)
    # correlation
    out["correlation.lower"] = relate.corr_long(df, NUMERIC)
    out["correlation.with_target"] = relate.corr_with_target(df, NUMERIC, TARGET).orderBy(F.desc("abs_r"))
    # feature engineering
    out["features.rush_counts"] = prof.value_counts(df, "is_rush_hour")
    out["features.season_mean"] = prof.group_means(df, "season", [TARGET])
    out["features.target_balance"] = prof.value_counts(df, "high_pollution")
    # missing values (before imputation)
    miss = prof.missing_profile(raw_df)
    out["missing.profile"] = miss
    out["missing.over_zero"] = miss.filter(F.col("missing") > 0)
    out["missing.overall"] = prof.overall_missing_pct(miss)
    # pollutant trends
    out["trends.hourly"] = prof.group_means(df, "hour", TARGETS)
    out["trends.weekday"] = prof.group_means(df, "weekday", [TARGET])
    out["trends.month"] = prof.group_means(df, "month", TARGETS)
    hourly = tsop.resample(df, ts, TARGETS, "1 hour")
    filled = tsop.forward_fill_chunked(hourly, TARGETS, ts)
    for c in TARGETS:
        out[f"trends.rolling.{c}"] = tsop.rolling_mean(filled.select(ts, c), c, ts, 168, freq="1 hour")
    # weather vs pollution
    out["weather.t_by_season"] = relate.pair_stats(df, [("T", TARGET)], keys=["season"])
    out["weather.humidity"] = relate.pair_stats(df, [("RH", TARGET), ("AH", TARGET)])
    out["weather.corr"] = relate.corr_rect(df, WEATHER, TARGETS)
    # A/B test: rush vs off-peak
    test = hyp.welch_test(df, TARGET, "is_rush_hour")
    out["ab.test"] = test
    out["ab.decision"] = hyp.decision_table(test)
    out["ab.density"] = prof.histogram(df, TARGET, 40, keys=["is_rush_hour"], density=True)
    out["ab.box"] = prof.boxplot_stats(df, TARGET, keys=["is_rush_hour"])
    # decomposition
    daily = tsop.resample(df, ts, [TARGET], "1 day", fill_gaps=False, drop_empty=True)
    dec = tsop.seasonal_decompose(daily, TARGET, ts, 7)
    out["decomposition.series"] = dec
    out["decomposition.stats"] = tsop.decomposition_stats(dec)
    # stationarity and normality
    hourly_long = hourly.select(ts, F.inline(F.array(*[
        F.struct(F.lit(c).alias("pollutant"), F.col(f"`{c}`").alias("value")) for c in TARGETS])))
    out["tests.adf"] = tsop.adf_test(hourly_long, "value", ts, keys=["pollutant"])
    out["tests.shapiro"] = hyp.shapiro_test(df, TARGETS + WEATHER)
    out["tests.qq"] = hyp.qq_points(df, TARGET)
    # multicollinearity
    out["collinearity.vif"] = relate.vif(df, NUMERIC).orderBy(F.desc("vif"))
    out["collinearity.redundancy"] = relate.redundancy(df, REDUNDANCY_PAIRS)
    # insights
    out["insights.findings"] = findings(df, TARGET)
    return out


def models(df: DataFrame, key: str = "Datetime", parallel: bool = True) -> dict[str, object]:
    """Train all regressors / classifiers on an 80/20 hash split and score a
    what-if grid.

    ``df`` is ``load(..., impute=False)``: rows without a measured target are
    left out (never trained or scored on imputed targets), feature medians,
    the class threshold and the scalers are all fitted on the training rows.
    """
    spark = df.sparkSession
    data = df.filter(F.col(f"`{TARGET}`").isNotNull())
    train, test = ml.hash_split(data, [key])
    imputer = MedianImputer([c for c in FEATURES if c in NUMERIC]).fit(train)
    threshold = medians(train, [TARGET])[TARGET]
    train, test = (add_threshold_target(imputer.transform(d), TARGET, threshold=threshold) for d in (train, test))
    df = imputer.transform(data)
    out: dict[str, object] = {"threshold": threshold}
    fitted = {}
    for kind, label in (("regression", TARGET), ("classification", "high_pollution")):
        tr = train.withColumn("label", F.col(f"`{label}`").cast("double"))
        te = test.withColumn("label", F.col(f"`{label}`").cast("double"))
        n = tr.count()
        base = ml.feature_stages(tr, FEATURES)
        if kind == "regression":
            est = ml.regressors(n, tr.agg(F.stddev_pop("label")).first()[0], FEATURES)
        else:
            est = ml.classifiers(n, FEATURES)
        res = ml.fit_all(est, base, tr, te, kind, parallel=parallel)
        out[f"{kind}.leaderboard"] = ml.leaderboard(spark, res, kind)
        best = ml.best(res, kind)
        fitted[kind] = best.model
        trees = [r for r in res if r.name in ("Decision Tree", "Random Forest", "Gradient Boosting")]
        out[f"{kind}.importance"] = ml.feature_importance(spark, ml.best(trees, kind).model, FEATURES)
        pred = best.model.transform(te)
        if kind == "regression":
            out["regression.residuals"] = ev.residual_summary(pred)
        else:
            out["classification.confusion"] = ev.confusion_matrix(pred)
            out["classification.report"] = ev.classification_report(pred)
            out["classification.roc"] = ev.roc_curve(ml.with_score(pred))
    grid = scenario_grid(df, {"T": 3, "RH": 3, "PT08.S1(CO)": 3},
                         fixed={c: "median" for c in FEATURES if c not in ("T", "RH", "PT08.S1(CO)", "hour",
                                                                         "weekday", "weekend", "is_rush_hour")},
                         calendar={"hour": [8, 14], "weekday": [1, 6]})
    grid = grid.withColumns({"weekend": (F.col("weekday") >= 5).cast("int"),
                             "is_rush_hour": F.col("hour").isin(7, 8, 9, 17, 18, 19).cast("int")})
    out["whatif.scores"] = score_scenarios(grid, fitted["regression"], fitted["classification"])
    return out


# --- fixed values: the claims of the dashboard's final report ---
REPORT_CLAIMS = {
    "rush_uplift_pct": "between 30 and 40",
    "weekday_uplift_pct": "between 20 and 30",
    "highest_season": "Winter",
    "min_abs_sensor_r": "above 0.85",
    "rush_test_p": "below 0.05",
    "max_adf_p": "below 0.05 (all stationary)",
    "r_temperature_co": "below 0",
}
# -----------------------------------------------------------------


def report(tabs: dict[str, DataFrame]) -> DataFrame:
    """The final report's claims recomputed from the tab results (each a
    handful of rows) and marked held / not held."""
    spark = next(iter(tabs.values())).sparkSession
    f = {r.metric: r.value for r in tabs["insights.findings"].collect()}
    season = tabs["features.season_mean"].orderBy(F.desc(f"`mean_{TARGET}`")).first()
    red = [abs(r.r) for r in tabs["collinearity.redundancy"].collect() if r.r is not None]
    ab = tabs["ab.test"].first()
    adf = [r.p_value for r in tabs["tests.adf"].collect() if r.p_value is not None]
    rt = [r.r for r in tabs["weather.corr"].collect() if r.row == "T" and r.col == TARGET]
    rows = [
        ("rush_uplift_pct", f.get("rush_uplift_pct"), lambda v: 30 <= v <= 40),
        ("weekday_uplift_pct", f.get("weekday_uplift_pct"), lambda v: 20 <= v <= 30),
        ("highest_season", season["season"] if season else None, lambda v: v == "Winter"),
        ("min_abs_sensor_r", min(red) if red else None, lambda v: v > 0.85),
        ("rush_test_p", ab.p_value if ab else None, lambda v: v < 0.05),
        ("max_adf_p", max(adf) if adf else None, lambda v: v < 0.05),
        ("r_temperature_co", rt[0] if rt else None, lambda v: v < 0),
    ]
    out = [(name, None if v is None else str(v if not isinstance(v, float) else round(v, 6)),
            REPORT_CLAIMS[name], "n/a" if v is None else ("held" if test(v) else "not held"))
           for name, v, test in rows]
    return spark.createDataFrame(out, "metric string, value string, claim string, held string")
