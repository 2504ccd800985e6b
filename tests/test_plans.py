"""Physical-plan properties the scale design relies on (read from explain())."""
import io
from contextlib import redirect_stdout

from conftest import SF_SMALL
from hourglass.plans import catalog
import __spark_entry__ as E  # noqa: F401  (registers the catalogue)


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _raw(name):
    E.queries()
    return catalog.RAW[name]


def test_hourly_profile_prunes_columns_and_pushes_filters(spark):
    plan = _plan(_raw("hourly_profile")(spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan
    assert "PushedFilters: [IsNotNull(ts)]" in plan
    assert "HashAggregate" in plan and "CartesianProduct" not in plan


def test_describe_reads_only_measures(spark):
    from hourglass.operators.profile import describe
    from hourglass.sources.readers import read_table
    li = read_table(spark, SF_SMALL, "lineitem")
    # the single-pass form; the exact form runs its passes eagerly over the same pruned scan
    plan = _plan(describe(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], method="approx"))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double>" in plan


def test_no_cartesian_products_anywhere(spark):
    light = ["clean_events", "histogram_by_segment", "boxplot_by_segment", "corr_rect", "hourly_resample",
             "rolling_7d", "decompose_by_type", "qq_points", "roc_rule", "rush_effect", "scatter_bins"]
    for name in light:
        plan = _plan(_raw(name)(spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_rolling_windows_partitioned_by_key_and_chunk(spark):
    plan = _plan(_raw("rolling_7d")(spark, SF_SMALL))
    assert "_chunk" in plan and "Window" in plan
