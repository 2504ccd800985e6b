"""The dashboard workflow end to end on a file in its own CSV layout
(synthetic hourly data with sentinels, junk columns and blank rows)."""
import numpy as np
import pandas as pd
import pytest

from hourglass.plans import air_quality as AQ


def _write_csv(path, days=40, seed=0):
    rng = np.random.default_rng(seed)
    t = pd.date_range("2004-03-10 18:00:00", periods=days * 24, freq="h")
    hour = t.hour.to_numpy()
    rush = np.isin(hour, [7, 8, 9, 17, 18, 19]).astype(float)
    temp = 15 + 8 * np.sin(2 * np.pi * (hour - 9) / 24) + rng.normal(0, 2, len(t))
    co = np.clip(1.2 + 1.1 * rush - 0.04 * (temp - 15) + rng.gamma(2.0, 0.3, len(t)), 0.1, None)
    nox = 120 * co + rng.normal(0, 20, len(t))
    no2 = 50 + 25 * co + rng.normal(0, 8, len(t))
    c6h6 = 4 * co + rng.normal(0, 0.8, len(t))
    frame = pd.DataFrame({
        "Date": [f"{d.month}/{d.day}/{d.year}" for d in t], "Time": t.strftime("%H:%M:%S"),
        "CO(GT)": co.round(1), "PT08.S1(CO)": (900 + 220 * co + rng.normal(0, 40, len(t))).round(0),
        "NMHC(GT)": np.where(rng.random(len(t)) < 0.9, -200, rng.integers(50, 300, len(t))),
        "C6H6(GT)": c6h6.round(1), "PT08.S2(NMHC)": (800 + 60 * c6h6 + rng.normal(0, 30, len(t))).round(0),
        "NOx(GT)": nox.round(0), "PT08.S3(NOx)": (1200 - 2.5 * nox + rng.normal(0, 40, len(t))).round(0),
        "NO2(GT)": no2.round(0), "PT08.S4(NO2)": (1000 + 8 * no2 + rng.normal(0, 40, len(t))).round(0),
        "PT08.S5(O3)": (900 + 250 * co + rng.normal(0, 80, len(t))).round(0),
        "T": temp.round(1), "RH": (60 - 1.2 * (temp - 15) + rng.normal(0, 5, len(t))).round(1),
        "AH": (0.8 + 0.02 * temp + rng.normal(0, 0.05, len(t))).round(4),
    })
    for c in ("CO(GT)", "NOx(GT)", "NO2(GT)", "T"):
        frame.loc[rng.random(len(t)) < 0.1, c] = -200
    frame["Unnamed: 15"] = ""
    frame["Unnamed: 16"] = ""
    blank = pd.DataFrame([[""] * frame.shape[1]] * 3, columns=frame.columns)
    pd.concat([frame, blank]).to_csv(path, index=False)
    return frame


@pytest.fixture(scope="module")
def aq(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("aq") / "air_quality.csv")
    frame = _write_csv(path)
    return frame, AQ.load(spark, path).cache(), AQ.raw(spark, path)


def test_load_and_clean(aq):
    frame, df, raw = aq
    assert df.count() == len(frame)
    assert "NMHC(GT)" not in df.columns and not any(c.startswith("Unnamed") for c in df.columns)
    assert df.filter("`CO(GT)` IS NULL").count() == 0
    co = frame["CO(GT)"].replace(-200, np.nan)
    assert df.agg({"high_pollution": "sum"}).first()[0] == int((co.fillna(co.median()) > co.median()).sum())


def test_every_tab_runs_and_tells_the_expected_story(aq):
    frame, df, raw = aq
    res = AQ.analyses(df, raw)
    for name, out in res.items():
        assert out.count() >= 1, name
    miss = {r.column: r for r in res["missing.profile"].collect()}
    assert miss["NMHC(GT)"].action == "drop" and miss["CO(GT)"].action == "impute_median"
    ab = res["ab.test"].first()
    assert ab.p_value < 0.001 and ab.cohens_d > 0.5 and ab.uplift_pct > 20
    red = {r.x: r for r in res["collinearity.redundancy"].collect()}
    assert red["PT08.S1(CO)"].redundant == 1
    assert res["tests.adf"].count() == 4 and res["tests.shapiro"].count() == 7
    top = res["correlation.with_target"].first()
    assert top.abs_r > 0.8
    hourly = {r.hour: r["mean_CO(GT)"] for r in res["trends.hourly"].collect()}
    assert hourly[8] > hourly[3]


def test_models_learn_the_signal(spark, aq, tmp_path_factory):
    frame, df, raw = aq
    path = str(tmp_path_factory.mktemp("aq2") / "air_quality.csv")
    _write_csv(path)
    parsed = AQ.load(spark, path, impute=False)
    assert parsed.filter("`CO(GT)` IS NULL").count() > 0           # targets are not imputed
    out = AQ.models(parsed)
    co = frame["CO(GT)"].replace(-200, np.nan)
    assert abs(out["threshold"] - co.median()) < 0.3               # fitted on the training rows
    reg = out["regression.leaderboard"].orderBy("rank").first()
    cls = out["classification.leaderboard"].orderBy("rank").first()
    assert reg.r2 > 0.7 and cls.f1 > 0.7
    assert out["regression.importance"].count() >= 1
    scores = out["whatif.scores"].collect()
    assert len(scores) == 3 * 3 * 3 * 2 * 2 and all(0 <= r.p_high <= 1 for r in scores)


def test_report_claims(aq):
    frame, df, raw = aq
    rep = {r.metric: r for r in AQ.report(AQ.analyses(df, raw)).collect()}
    assert len(rep) == 7
    assert rep["rush_test_p"].held == "held" and rep["min_abs_sensor_r"].held == "held"
    assert rep["r_temperature_co"].held == "held"          # built in: CO falls as T rises
    assert rep["rush_uplift_pct"].held in ("held", "not held")


def test_home_kpis_match_pandas(aq):
    frame, df, raw = aq
    tabs = AQ.analyses(df, raw)
    k = tabs["home.kpis"].first()
    pdf = frame.replace(-200, np.nan).drop(columns=["Unnamed: 15", "Unnamed: 16"])
    assert k.rows == len(pdf) + 3                      # the blank trailing rows are still rows here
    assert k.sensor_columns == 5
    padded = pd.concat([pdf, pd.DataFrame([[np.nan] * pdf.shape[1]] * 3, columns=pdf.columns)])
    want = round(padded.isnull().mean().mean() * 100, 1)
    assert tabs["home.missing_pct"].first().overall_missing_pct == pytest.approx(want)
