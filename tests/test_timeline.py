from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidex.operators import timeline as L


def test_blank_frames_do_not_break_runs(spark):
    rows = [(1, 0.0, "Hi there"), (1, 1.0, " "), (1, 2.0, "hithere"), (1, 3.0, "x"), (1, 4.0, "Hi there"), (2, 0.0, "")]
    got = L.collapse_runs(spark.createDataFrame(rows, "g int, at double, text string"), "g", ["at"], "at", "text").orderBy("start").collect()
    assert [(r.start, r.end, r.text, r.n) for r in got] == [(0.0, 2.0, "Hi there", 2), (3.0, 3.0, "x", 1), (4.0, 4.0, "Hi there", 1)]


def test_gaps_of_overlapping_intervals(spark):
    rows = [(1, 0.0, 5.0), (1, 1.0, 2.0), (1, 7.0, 8.0), (1, 8.0, 9.0)]
    assert [tuple(r) for r in L.gaps(spark.createDataFrame(rows, "g int, start double, end double"), "g").collect()] == [(1, 5.0, 7.0)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 30), st.integers(1, 9))
def test_evenly_spaced(spark, n, k):
    want = list(range(n)) if n <= k else [0] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})
    df = spark.createDataFrame([(1, i) for i in range(n)], "g int, i int")
    assert sorted(r.i for r in L.evenly_spaced(df, ["g"], ["i"], k).collect()) == want


def test_segments_points_and_statuses(spark):
    d = spark.createDataFrame([("a", 12.0), ("b", 0.0)], "k string, s double")
    assert [(r["index"], r.start, r.end) for r in L.fixed_segments(d, "k", "s", 5.0).where("k = 'a'").orderBy("index").collect()] == [(1, 0.0, 5.0), (2, 5.0, 10.0), (3, 10.0, 12.0)]
    assert L.fixed_segments(d, "k", "s", 5.0).where("k = 'b'").count() == 1
    assert [r.at for r in L.interval_points(d, "k", "s", 5.0, 10).orderBy("point").collect()] == [2.5, 7.5, 11.999]
    r = L.status_counts(spark.createDataFrame([("complete",), ("partial",), ("odd",)], "s string").withColumn("g", F.lit(1)), ["g"], "s").first()
    assert r.failed_count == 1 and r.complete_count == 1 and r.overall == "partial"


def test_merged_ids(spark):
    rows = [("x", 1, 0), ("x", 2, 0), ("x", 2, 1), ("y", 2, 2)]
    got = {(r.source, r.o): (r.merged_id, r.analysis_id) for r in L.unique_ids(spark.createDataFrame(rows, "id string, source int, o int"), "id", "source", ["o"]).collect()}
    assert got == {(1, 0): ("x", None), (2, 0): ("source-2-x", "x"), (2, 1): ("source-2-x-2", "x"), (2, 2): ("y", None)}


def test_movement_and_clock(spark):
    r = spark.range(1).select(L.movement(F.lit(0.03), F.lit(0.0), F.lit(0.0), F.lit(0.0)), L.movement(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), L.movement(F.lit(0.0), F.lit(0.0), F.lit(-0.02), F.lit(0.0)), L.clock(F.lit(3661.5)))
    assert tuple(r.first()) == ("pan_left_likely", "static_or_stabilized", "pull_or_zoom_out", "01:01:01.500")
