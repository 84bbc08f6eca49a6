"""Values of doubles that SQL rounds otherwise than Spark's ``round``."""

import numpy as np
from conftest import comparable

from orrery.functions import rules as R
from orrery.queries import ORACLE_SQL, QUERIES


def test_audio_noise_of_long_ids(spark, duck, tmp_path):
    ids = [170000000583, 170000001348, 1000000000931, 10**15 + 39, -170000000583, 7, 0, None]
    values = [0.25, 583.75, 29.27, 0.9, 122.79, 0.0000005, 7.0000002, 7.0000001, None]
    rows = [(1 + 35 * i + j % 2, u, v) for i, u in enumerate(ids) for j, v in enumerate(values)]
    rows += [(7, 3, 1.0), (5, 3, 1.0), (35, 3, 1.0), (0, 3, None), (11, 3, float("inf")), (12, 3, float("-inf")), (13, 3, float("nan")), (14, None, None), (16, 1, 1e305), (17, 1, -1e305)]
    rows = [(1_000_000 * k + r[0] if r[0] not in (0, 5, 7, 14, 35) else r[0], *r[1:]) for k, r in enumerate(rows, 1)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["audio_noise"](spark, str(tmp_path)).toPandas().sort_values("event_id")
    want = duck.cursor().execute(ORACLE_SQL["audio_noise"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).df().sort_values("event_id")
    assert got.event_id.tolist() == want.event_id.tolist()
    a, b = got.snr.to_numpy(float), want.snr.to_numpy(float)
    there = ~np.isnan(b)
    assert (np.isnan(a) == ~there).all()
    assert (a[there].view(np.int64) == b[there].view(np.int64)).all()  # to the last bit, signs of zeros too
    assert comparable(got[["event_id", "passed"]]) == comparable(want[["event_id", "passed"]])


def test_rounded_ties_go_away_from_zero(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,), (0.49999999999999994,), (2.0**53 + 2,)], "x double")
    assert [r[0] for r in df.select(R.rounded(df.x, 0)).collect()] == [1.0, 2.0, 3.0, -3.0, 0.0, 2.0**53 + 2]
