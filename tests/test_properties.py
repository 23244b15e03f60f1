"""Property tests: random inputs against brute-force definitions (few examples each: every one runs Spark jobs)."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from netsieve.operators import metrics as M
from netsieve.operators import sampling as SM
from netsieve.operators import windows as W

from test_operators import T0, _brute_flows, deque_stats, packets_df

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _hash(i, seed=42):
    return ((i % 2147483648) * 2654435761 + seed) % 4294967296


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.2, 0.35, 0.5, 0.9])), min_size=2, max_size=120),
       st.integers(1, 9))
def test_auc_is_the_pair_count(spark, data, ranges):
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    df = spark.createDataFrame(data, "y int, s double")
    got = M.roc_auc(df, "y", "s", num_ranges=ranges).first()
    if not pos or not neg:
        assert got["auc"] is None
        return
    pairs = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    assert got["auc"] == pytest.approx(round(pairs / (len(pos) * len(neg)), 6), abs=1e-6)


@FEW
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=300), st.integers(1, 7))
def test_stratified_split_is_exact_and_partition_free(spark, labels, parts):
    rows = [(i * 7 + 3, lab) for i, lab in enumerate(labels)]
    df = spark.createDataFrame(rows, "row_id long, label string")
    a = {r.row_id: r.split for r in SM.split_stratified(df, "label", "row_id").collect()}
    b = {r.row_id: r.split for r in SM.split_stratified(df.repartition(parts), "label", "row_id").collect()}
    assert a == b
    for lab in set(labels):
        ids = sorted((i for i, l2 in rows if l2 == lab), key=lambda i: (_hash(i), i))
        k = int(0.2 * len(ids) + 0.5)  # round half up, as Spark's round
        assert {i for i in ids if a[i] == "test"} == set(ids[:k])


@FEW
@given(st.sets(st.integers(0, 10 ** 9), min_size=1, max_size=400), st.integers(1, 450))
def test_sample_n_is_the_hash_prefix(spark, ids, n):
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    got = sorted(r.row_id for r in SM.sample_n(df, n, "row_id").collect())
    assert got == sorted(sorted(ids, key=lambda i: (_hash(i), i))[:n])


@FEW
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from([0, 0.5, 1, 3, 20, 59, 60, 61, 300]),
                          st.integers(40, 1500)), min_size=1, max_size=80),
       st.integers(1, 6), st.sampled_from([1, 2, 5, 30]))
def test_buffer_is_a_deque(spark, steps, cap, partitions):
    rows, t = [], {}
    for i, (key, dt, ln) in enumerate(steps):
        t[key] = t.get(key, 0.0) + dt
        rows.append((i, key, t[key], ln))
    out = W.buffer_stats(packets_df(spark, rows), "pkt_len", window_seconds=60, cap=cap, partitions=partitions)
    got = {r.packet_id: (r.n_buffer, r.pkt_len_std) for r in out.collect()}
    want = deque_stats(rows, 60, cap)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


@FEW
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from([0.5, 30, 99, 100, 101, 1000])), min_size=1, max_size=80),
       st.sampled_from([1, 2, 7, 40]))
def test_flows_are_gap_splits(spark, steps, partitions):
    rows, t = [], {}
    rnd = random.Random(len(steps))
    for i, (key, dt) in enumerate(steps):
        t[key] = t.get(key, 0.0) + dt
        rows.append((i, key, t[key], rnd.randint(40, 1500)))
    flows = W.flow_rollup(packets_df(spark, rows), gap_seconds=100, partitions=partitions).collect()
    got = {}
    for r in flows:
        start = (r.flow_start - T0).total_seconds()
        pid = min(p for p, k, tt, _ in rows if k == r.flow_key and abs(tt - start) < 1e-6)
        got[(r.flow_key, pid)] = (r.n_packets, r.tot_fwd_pkts,
                                  None if r.flow_iat_max is None else round(r.flow_iat_max, 3),
                                  None if r.flow_iat_mean is None else round(r.flow_iat_mean, 3))
    assert got == _brute_flows(rows, 100)
