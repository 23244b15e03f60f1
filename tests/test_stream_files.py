"""Stream queries on an events table of many files: the same rows as on one file, and late packets end no stream."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from netsieve.plans.catalog import queries
from netsieve.session import scratch_dir
from netsieve import schemas
from netsieve.streaming import streams as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("many-files")
    spark.read.parquet(f"{SF}/events.parquet").repartition(8).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["win_stream", "flow_rollup_stream", "flow_rollup_state", "alert_stream", "packet_stream"])
def test_same_rows_from_eight_files(spark, many_files, name):
    assert len([f for f in os.listdir(f"{many_files}/events.parquet") if f.startswith("part-")]) == 8
    one, many = (queries()[name](spark, sf) for sf in (SF, many_files))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))


@pytest.mark.parametrize("operator", [lambda p: ST.buffer_state(p, window_seconds=60, cap=3),
                                      lambda p: ST.flow_state(p, gap_seconds=60)])
def test_a_late_packet_does_not_end_the_stream(spark, operator):
    src, out, ck = (scratch_dir(spark, f"late-{x}") for x in ("in", "out", "ck"))
    names = [f.name for f in schemas.PACKET.fields]
    for i, second in enumerate((5000, 100, 9000)):
        row = {"packet_id": i, "flow_key": 1, "ts": dt.datetime(2020, 1, 1) + dt.timedelta(seconds=second), "protocol": 6}
        spark.createDataFrame([tuple(row.get(n) for n in names)], schemas.PACKET).write.mode("append").parquet(src)
        ST.run_to_files(operator(ST.packet_stream(spark, src, max_files=None)), out, ck)
    assert spark.read.parquet(out).count() >= 1
