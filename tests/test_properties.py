"""Property tests: exact selection and histograms against numpy on random data."""
import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hourglass.operators import profile as prof
from hourglass.operators import quantiles as Q

values = st.lists(st.one_of(st.integers(-50, 50).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=300)
probs = st.lists(st.floats(0.0, 1.0), min_size=1, max_size=4)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=values, ps=probs)
def test_select_equals_numpy(spark, xs, ps):
    df = spark.createDataFrame(pd.DataFrame({"x": xs})).repartition(3)
    got = Q.quantiles(df, ["x"], ps, "select", accuracy=50)["x"]
    want = np.percentile(np.array(xs), [p * 100 for p in ps])
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=values)
def test_histogram_equals_numpy(spark, xs):
    arr = np.array(xs)
    out = prof.histogram(spark.createDataFrame(pd.DataFrame({"x": arr})), "x", bins=40).orderBy("bin").collect()
    counts, _ = np.histogram(arr, bins=40)
    assert [r["count"] for r in out] == counts.tolist()
