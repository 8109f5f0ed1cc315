"""Hand-computed cases: boundaries, ties, empty and constant groups."""

import math

import pytest
from pyspark.sql import functions as F

from ripplework.functions import statistics as st
from ripplework.operators import segments as seg
from ripplework.operators import selection as sel
from ripplework.operators import sequence
from ripplework.operators.segments import SegmentConfig


def spans(spark, duration, length=3.0, hop=1.5, tail="drop"):
    rows = seg.make_segments(spark.createDataFrame([(1, duration)], "rec_id long, duration double"), length, hop, tail)
    return [(r.start, r.end) for r in rows.orderBy("segment_index").collect()]


def test_make_segments(spark):
    assert spans(spark, 10.0) == [(0, 3), (1.5, 4.5), (3, 6), (4.5, 7.5), (6, 9)]
    assert spans(spark, 10.0, tail="keep") == [(0, 3), (1.5, 4.5), (3, 6), (4.5, 7.5), (6, 9), (7.5, 10.0)]
    assert spans(spark, 2.0) == [(0, 2)]
    assert spans(spark, 3.0) == [(0, 3)] and spans(spark, 3.0, tail="keep") == [(0, 3)]
    assert spans(spark, 0.0) == [] and spans(spark, -1.0) == []
    for bad in ((0, 1.5), (3, 0), (-1, 1)):
        with pytest.raises(ValueError, match="positive"):
            spans(spark, 10.0, *bad)


def test_samples_on_boundaries(spark):
    signal = spark.createDataFrame([(1, i, t, 1.0, True) for i, t in enumerate([0.0, 1.5, 3.0, 4.5, 6.0])], "rec_id long, frame long, t double, x double, voiced boolean")
    held = {(r.t, r.segment_index) for r in seg.assign(signal, seg.durations(signal)).collect()}
    # half-open segments [0,3) [1.5,4.5) [3,6); the sample at the end of the recording is in none
    assert held == {(0.0, 0), (1.5, 0), (1.5, 1), (3.0, 1), (3.0, 2), (4.5, 2)}


def test_validate(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (2, -1.0, 1.0), (3, 1.0, 1.0), (4, 0.0, 11.0)], "rec_id long, start double, end double")
    durations = spark.createDataFrame([(i, 10.0) for i in range(1, 5)], "rec_id long, duration double")
    got = {r.rec_id: (r.valid, r.overlaps) for r in seg.validate(rows, durations).collect()}
    assert got == {1: (True, 1), 2: (False, 0), 3: (False, 0), 4: (False, 0)}


def test_slices_and_coverage(spark):
    arrays = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])], "rec_id long, x array<double>")
    rows = spark.createDataFrame([(1, 0, 0.5, 2.5), (1, 1, 9.0, 10.0)], "rec_id long, segment_index long, start double, end double")
    got = {r.segment_index: r.x for r in seg.slice_arrays(rows, arrays, hop=1, sr=2).collect()}
    assert got == {0: [2.0, 3.0, 4.0, 5.0], 1: None}
    one = seg.coverage(spark.createDataFrame([(1, 3.0)] * 3, "rec_id long, duration double"), spark.createDataFrame([(1, 10.0)], "rec_id long, duration double")).first()
    assert (one.segments, one.covered, round(one.ratio, 9)) == (3, 9.0, 0.9)
    assert seg.frame_times(spark.createDataFrame([(1, 2.0)], "rec_id long, duration double")).count() == 86


def rows_of(spark, n, rms=None, voiced=None):
    rms = None if rms is None else [None if r is None else float(r) for r in rms]
    return spark.createDataFrame([(1, i, (rms or [1.0] * n)[i], (voiced or [0.5] * n)[i]) for i in range(n)], "rec_id long, segment_index long, rms double, voiced_fraction double")


def indices(df):
    return [r.segment_index for r in df.orderBy("segment_index").collect()]


def test_selection(spark):
    few = rows_of(spark, 6)
    assert indices(sel.boundary_importance(few, 6, 2, 2)) == list(range(6))
    assert indices(sel.boundary_importance(rows_of(spark, 8), 6, 2, 2)) == [0, 1, 2, 3, 6, 7]  # all equal: the earliest of the middle
    assert indices(sel.boundary_importance(rows_of(spark, 8, rms=[9, 9, 1, 2, 3, 4, 9, 9.0]), 6, 2, 2)) == [0, 1, 4, 5, 6, 7]
    assert indices(sel.boundary_importance(rows_of(spark, 8, rms=[1, 1, None, 5, None, 2, 1, 1.0]), 5, 2, 2)) == [0, 1, 3, 6, 7]
    assert indices(sel.boundary_importance(rows_of(spark, 9), 6, 4, 4)) == [0, 1, 2, 3, 7, 8]  # ends fill it
    assert indices(sel.boundary_importance(rows_of(spark, 9), 4, 6, 0)) == [0, 1, 2, 3]
    assert indices(sel.boundary_importance(rows_of(spark, 8), 5, 2, 0)) == [0, 1, 2, 3, 4]  # no last ones wanted: none
    assert indices(sel.uniform(rows_of(spark, 10), 4)) == [0, 2, 5, 7]
    assert len(indices(sel.random(rows_of(spark, 10), 4))) == 4 and indices(sel.random(rows_of(spark, 10), 4)) == indices(sel.random(rows_of(spark, 10), 4))
    assert indices(sel.select(few, "all", 2)) == list(range(6))
    with pytest.raises(ValueError, match="strategy"):
        sel.select(few, "none", 2)


def test_padding_and_flattening(spark):
    padded = sel.padded(rows_of(spark, 3), 5, ("rms",)).orderBy("pos").collect()
    assert [(r.mask, r.rms) for r in padded] == [(1, 1.0)] * 3 + [(0, 0.0)] * 2
    assert [r.mask for r in sel.padded(rows_of(spark, 3), 2, ()).collect()] == [1, 1]
    df = spark.createDataFrame([(1.0, None, [5.0, 6.0], None)], "a double, b double, e array<double>, f array<double>")
    flat = lambda **k: df.select(sel.flatten([F.col("a"), F.col("b")], [F.col("f"), F.col("e")], [], 6, **k).alias("x")).first().x
    assert flat() == [1, 0, 5, 6, 0, 0] and flat(layout="fixed", dims=[2, 2]) == [1, 0, 0, 0, 5, 6]
    assert sel.feature_width({"clap": 128, "wav2vec": 64, "yamnet": 128}) == 416


def test_eviction(spark):
    df = spark.createDataFrame([(1, 9, 400.0), (1, 7, 400.0), (1, 7, 400.0), (1, 7, None), (1, 5, 1.0), (2, 9, 1000.0), (2, 8, 0.5), (3, 1, None), (3, None, 1001.0)], "user long, used long, size double")
    got = [(r.user, r.used, r.evicted) for r in sel.evicted(df, "size", "used", 1000.0, "user").collect()]
    # the three rows of time 7 go together, whatever order they are read in
    assert sorted(got, key=str) == sorted([(1, 9, False), (1, 7, True), (1, 7, True), (1, 7, True), (1, 5, True), (2, 9, False), (2, 8, True), (3, 1, None), (3, None, True)], key=str)


def frame(spark, values, kind="double"):
    values = [float(v) if kind == "double" and v is not None else v for v in values]
    return spark.createDataFrame([(1, i, v, float(i)) for i, v in enumerate(values)], f"rec_id long, frame long, v {kind}, t double")


@pytest.mark.parametrize(("flags", "runs"), [([True] * 3, [(0, 3)]), ([False] * 3, []), ([True], [(0, 1)]), ([False, True, True], [(1, 3)]), ([True, False, True], [(0, 1), (2, 3)]), ([None, True], [(1, 2)])])
def test_runs(spark, flags, runs):
    got = sequence.runs(frame(spark, flags, "boolean"), "v").orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == runs


def test_gaps_exactly_at_the_limit(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.0, 0.5, 1.0, 1.75, 2.25])], "rec_id long, frame long, t double")
    assert sorted(r["size"] for r in sequence.gap_clusters(df, 0.5).collect()) == [2, 3]
    rows = spark.createDataFrame([(1, 0.0, 1.0, "a", 0.2), (1, 2.0, 3.0, "a", 0.9), (1, 4.0, 5.0, "b", 0.1), (1, 7.5, 8.0, "b", 0.3)], "rec_id long, start double, end double, kind string, energy double")
    got = sequence.merge_intervals(rows, 1.0, "kind").orderBy("start").collect()
    assert [(r.start, r.end, r.energy, r.merged) for r in got] == [(0.0, 3.0, 0.9, 2), (4.0, 5.0, 0.1, 1), (7.5, 8.0, 0.3, 1)]
    one = spark.createDataFrame([([0.5, 0.7, 0.1],)], "c array<double>").select(sequence.running_confidence(F.col("c")).alias("c")).first().c
    assert abs(one - 0.35) < 1e-12


def test_statistics_of_small_groups(spark):
    agg = lambda values, c: frame(spark, values).agg(c.alias("r")).first().r
    v = F.col("v")
    assert agg([1.0, 2, 3, 4, 5], F.stddev_pop("v")) == pytest.approx(math.sqrt(2))
    assert agg([1.0, 2, 3, 4], st.median_low("v")) == 2 and agg([1.0, 2, 3, 4], F.median("v")) == 2.5
    assert agg([3.0], st.skewness_pop(v)) == 0 and agg([2.0] * 5, st.kurtosis_pop(v)) == 0 and agg([2.0] * 5, st.skewness_samp(v)) == 0
    assert agg([float("nan"), 4.0], F.avg(st.finite(v))) == 4 and agg([float("nan")], F.avg(st.finite(v))) is None
    assert agg([1.0, 2], st.by_name(v, "no such")) is None
    assert st.correlation_matrix(frame(spark, [1.0, 1.0]), ["v", "t"]).where("a = 'v' AND b = 't'").first().r == 0


def test_rolling_and_interpolation(spark):
    got = [r.roll_mean for r in sequence.rolling(frame(spark, [3.0, 3, 3, 3]), "v", 3, ("mean", "no such")).orderBy("frame").collect()]
    assert got == [2.0, 3.0, 3.0, 2.0]
    fill = lambda values: [r.v_filled for r in sequence.interpolate(frame(spark, values), "v").orderBy("frame").collect()]
    assert fill([None, 1.0, None, 3.0, float("nan")]) == [0, 1, 2, 3, 4]
    assert fill([None, 5.0, None]) == [0, 0, 0]


def test_config_merges_known_keys():
    c = SegmentConfig().merged(hop=1.0, no_such=3)
    assert c.hop == 1.0 and c.segment_len == 3.0 and not hasattr(c, "no_such")
