"""Constructed cases with known answers."""

import pytest
from pyspark.sql import functions as F

from reviewlane.functions import materialize, records
from reviewlane.operators import metrics, queue


def test_exact_bounds():
    for k, n, bound in ((224, 289, 0.730934), (32, 68, 0.366238), (3, 3, 0.368403), (22, 24, 0.760199)):
        assert metrics.rate_lower_bound(k, n) == pytest.approx(bound, abs=1e-6)
    assert metrics.sign_test(20, 20) == pytest.approx(9.54e-07, rel=1e-3)
    assert (records.ceil_share(10, 50), records.ceil_share(20, 50), records.ceil_share(10, 3)) == (5, 10, 1)


@pytest.mark.parametrize("version, family", [
    ("2.1.2+1.gcded8f6.dirty", "2.1.2"), ("2.1.2+1.gcded8f6", "2.1.2"), ("1.8.1.12.g0123abcdef", "1.8.1"), ("1.8.dirty", "1.8"), ("1.8", "1.8"),
    ("1.8+5.gXYZ123", "1.8+5.gXYZ123"), ("1.8+5.g12345", "1.8+5.g12345"), ("g123456", "g123456"), ("5.g123456", "5.g123456"), ("", None), ("  ", None), (" 1.8+5.gabcdef0 ", "1.8"), (".dirty", None), ("1.8.dirty.dirty", "1.8.dirty"), ("a+.g123456", "a+.g123456"), (None, None),
])
def test_release_family(spark, version, family):
    df = spark.createDataFrame([(version,)], "v string")
    assert df.select(records.release_family(F.col("v"))).first()[0] == family


@pytest.mark.parametrize("url, time", [
    ("https://x.org/media/data_12/2026-07-01T10-20-30/waterfall_12_2026-07-01T10-20-30.png", "2026-07-01T10:20:30"),
    ("2026-07-01T10-20-30", "2026-07-01T10:20:30"), ("a-b-c/2026-07-01T10-20-3x", None), ("2026-07-01", None), ("", None), (None, None),
])
def test_url_time(spark, url, time):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(records.url_time(F.col("u"))).first()[0] == time


def test_families_and_arcs(spark):
    df = spark.createDataFrame([("2.1.2+1.gcded8f6.dirty",), (None,)], "v string")
    got = df.select(records.release_family(F.col("v")), records.family_or_unknown(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("2.1.2", "2.1.2"), (None, "unknown")]
    arc = spark.range(1).select(records.azimuth_sweep(F.lit(350.0), F.lit(10.0)), records.azimuth_sweep(F.lit(None).cast("double"), F.lit(1.0))).first()
    assert tuple(arc) == (20.0, None)


@pytest.mark.parametrize(
    "stations, transmitters, budget, percent, admitted, by_station, by_transmitter",
    [
        ("AABABCD", "xyxxyzx", 4, (25, 50), [1, 3, 6], [2, 4, 5], [4, 7]),
        ("AAB", "xxx", 3, (1, 50), [1, 3], [2], []),
    ],
)
def test_caps(spark, stations, transmitters, budget, percent, admitted, by_station, by_transmitter):
    rows = [(i, i, s, t) for i, (s, t) in enumerate(zip(stations, transmitters), 1)]
    ranked = spark.createDataFrame(rows, "rank long, obs_id long, station string, transmitter string")
    out = queue.apply_caps(ranked, budget, *percent).orderBy("rank").collect()
    assert [r.obs_id for r in out if r.admitted] == admitted
    assert [r.obs_id for r in out if r.by_station] == by_station
    assert [r.obs_id for r in out if r.by_transmitter] == by_transmitter


def test_no_machine_local_checkpoints_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Frame:
        class sparkSession:
            sparkContext = Context

            class conf:
                get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        materialize.shared_folder(Frame.sparkSession)
