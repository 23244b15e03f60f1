"""Hand-made edge cases: windows vs a plain deque, sessions, AUC vs pair counts, splits, texts, CSV folders."""

import datetime as dt
import os
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.functions import alerts as A
from netsieve.functions import textops as TX
from netsieve.operators import metrics as M
from netsieve.operators import sampling as SM
from netsieve.operators import windows as W
from netsieve.sources import csv_folder as CF
from netsieve.sources import sinks as SK

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def packets_df(spark, rows):
    """rows: (packet_id, flow_key, seconds_after_T0, pkt_len)"""
    data = [(pid, key, T0 + dt.timedelta(seconds=s), ln, "10.0.0.1" if pid % 2 else "10.0.0.2", 6, 1000, 80, 2)
            for pid, key, s, ln in rows]
    return spark.createDataFrame(
        data, "packet_id long, flow_key long, ts timestamp_ntz, pkt_len int, src_ip string, protocol int, "
              "src_port int, dst_port int, tcp_flags int")


def deque_stats(rows, window, cap):
    """Brute force: per packet, the buffer of its key (last `window` s inclusive, at most `cap`)."""
    out = {}
    by_key = {}
    for pid, key, s, ln in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        buf = by_key.setdefault(key, deque())
        buf.append((s, ln, pid))
        while buf and buf[0][0] < s - window:
            buf.popleft()
        while len(buf) > cap:
            buf.popleft()
        lens = np.array([b[1] for b in buf], dtype=float)
        out[pid] = (len(buf), float(lens.std()), float(lens.var()))
    return out


def test_buffer_age_and_cap(spark):
    rows = [(1, 1, 0.0, 100), (2, 1, 60.0, 200), (3, 1, 121.0, 300), (4, 2, 5.0, 50)]
    rows += [(10 + i, 3, 1000 + i * 0.01, 40 + i % 7) for i in range(1001)]  # 1001 packets within 60 s
    got = {r.packet_id: (r.n_buffer, r.pkt_len_std, r.pkt_len_var) for r in W.buffer_stats(
        packets_df(spark, rows), "pkt_len", window_seconds=60, cap=1000, with_iat=False).collect()}
    want = deque_stats(rows, 60, 1000)
    assert got[2][0] == 2          # a packet exactly 60 s old stays
    assert got[3][0] == 1          # 61 s old is gone
    assert got[4] == (1, 0.0, 0.0)  # one packet: std 0
    assert got[10 + 1000][0] == 1000  # cap
    for pid, (n, sd, var) in want.items():
        assert got[pid][0] == n
        assert got[pid][1] == pytest.approx(sd, abs=1e-9)
        assert got[pid][2] == pytest.approx(var, abs=1e-7)


def test_buffer_hot_key_split_matches_unsplit(spark):
    rnd = random.Random(7)
    rows = [(i, 1 if i % 3 else rnd.randint(2, 5), i * 7.3 + rnd.random(), rnd.randint(40, 1500)) for i in range(600)]
    df = packets_df(spark, rows)
    small = W.buffer_stats(df, "pkt_len", window_seconds=60, cap=5, partitions=23)
    large = W.buffer_stats(df, "pkt_len", window_seconds=60, cap=5, partitions=1)
    cols = ["packet_id", "n_buffer", "pkt_len_std", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min"]
    a = sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in small.select(cols).collect())
    b = sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in large.select(cols).collect())
    assert a == b
    want = deque_stats(rows, 60, 5)
    assert {r[0]: r[1] for r in a} == {k: v[0] for k, v in want.items()}


def test_sessions_cross_buckets(spark):
    rnd = random.Random(3)
    rows, t = [], 0.0
    for i in range(400):
        t += rnd.choice([1, 5, 30, 200, 1000])
        rows.append((i, 1 + i % 2, t, 100))
    df = packets_df(spark, rows)
    flows = W.flow_rollup(df, gap_seconds=100, partitions=7)
    # brute force session count per key
    want = 0
    for key in (1, 2):
        ts = sorted(r[2] for r in rows if r[1] == key)
        want += 1 + sum(1 for a, b in zip(ts, ts[1:]) if b - a >= 100)
    assert flows.count() == want
    assert flows.agg(F.sum("n_packets")).first()[0] == len(rows)


@pytest.mark.parametrize("partitions", [1, 4, 150])
def test_buffer_across_partitions_matches_deque(spark, partitions):
    """Runs cut at any place, also into stretches shorter than the cap: same buffers as a plain deque."""
    rnd = random.Random(17)
    rows, t = [], 0.0
    for i in range(700):
        t += rnd.choice([0.2, 1.5, 7, 30, 61, 400])
        rows.append((i, 1 if i % 4 else rnd.randint(2, 3), t, rnd.randint(40, 1500)))
    df = packets_df(spark, rows)
    out = W.buffer_stats(df, "pkt_len", window_seconds=60, cap=7, partitions=partitions)
    got = {r.packet_id: (r.n_buffer, round(r.pkt_len_std, 6), round(r.flow_iat_max, 3))
           for r in out.collect()}
    want = deque_stats(rows, 60, 7)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)
    assert len(got) == len(rows)
    # inter-arrival max over the buffer: each buffered packet's gap to the key's previous packet
    by_key = {}
    for pid, key, tt, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_key.setdefault(key, []).append((pid, tt))
    for pk in by_key.values():
        gaps = [None] + [(b[1] - a[1]) * 1000.0 for a, b in zip(pk, pk[1:])]
        for j, (pid, _) in enumerate(pk):
            buf = range(j - want[pid][0] + 1, j + 1)
            g = [gaps[i] for i in buf if gaps[i] is not None]
            assert got[pid][2] == pytest.approx(round(max(g), 3) if g else 0.0, abs=1e-6)


def _brute_flows(rows, gap):
    """Brute force flows: per key, sorted by (time, id), a new flow at a gap >= ``gap``."""
    out = {}
    by_key = {}
    for pid, key, t, ln in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_key.setdefault(key, []).append((t, pid, ln))
    for key, pk in by_key.items():
        flows = []
        for i, (t, pid, ln) in enumerate(pk):
            if i == 0 or t - pk[i - 1][0] >= gap:
                flows.append([])
            flows[-1].append((t, pid, ln, None if len(flows[-1]) == 0 else (t - pk[i - 1][0]) * 1000.0))
        for f in flows:
            iats = [x[3] for x in f if x[3] is not None]
            src = "10.0.0.1" if f[0][1] % 2 else "10.0.0.2"
            fwd = sum(1 for x in f if ("10.0.0.1" if x[1] % 2 else "10.0.0.2") == src)
            out[(key, f[0][1])] = (len(f), fwd, round(max(iats), 3) if iats else None,
                                   round(float(np.mean(iats)), 3) if iats else None)
    return out


@pytest.mark.parametrize("partitions", [1, 3, 20, 120])
def test_sessions_match_brute_force(spark, partitions):
    rnd = random.Random(5)
    rows, t = [], 0.0
    for i in range(500):
        t += rnd.choice([0.5, 3, 20, 99.9, 100, 150, 700])
        rows.append((i, 1 if i % 3 else rnd.randint(2, 4), t, rnd.randint(40, 1500)))  # key 1: the hot key
    df = packets_df(spark, rows)
    flows = W.flow_rollup(df, gap_seconds=100, partitions=partitions)
    got = {}
    for r in flows.collect():
        start = (r.flow_start - T0).total_seconds()
        pid = min(p for p, k, tt, _ in rows if k == r.flow_key and abs(tt - start) < 1e-6)
        got[(r.flow_key, pid)] = (r.n_packets, r.tot_fwd_pkts,
                                  None if r.flow_iat_max is None else round(r.flow_iat_max, 3),
                                  None if r.flow_iat_mean is None else round(r.flow_iat_mean, 3))
    assert got == _brute_flows(rows, 100)


def test_dense_key_is_linear_and_exact(spark):
    """40,000 packets of one key inside 50 s: every buffer is cut by the cap, none by the window."""
    import time

    n = 40_000
    df = spark.range(n).select(F.col("id").alias("packet_id"), F.lit(1).cast("long").alias("flow_key"),
                               (F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id * 0.00125)")).alias("ts"),
                               (F.col("id") % 1461 + 40).cast("int").alias("pkt_len"))
    t0 = time.monotonic()
    got = {r.packet_id: r for r in W.buffer_stats(df, "pkt_len", partitions=16).collect()}
    took = time.monotonic() - t0
    x = np.arange(n) % 1461 + 40
    for j in (0, 1, 998, 999, 1000, 2500, 20_000, n - 1):
        v = x[max(0, j - 999): j + 1].astype(float)
        assert got[j].n_buffer == len(v) and got[j].pkt_len_var == pytest.approx(v.var(), rel=1e-12)
        assert (got[j].flow_iat_max, got[j].flow_iat_min) == ((1.25, 1.25) if j else (0.0, 0.0))
    assert len(got) == n and took < 60


def test_buffer_odd_rows(spark):
    """Null keys, times and lengths, equal times, huge values, an empty table."""
    rows = [(1, None, 0, 10), (2, None, 1, 20), (3, 7, None, 30), (4, 7, None, 40), (5, 7, 2, None), (6, 7, 2, 50), (7, 7, 2, 70),
            (8, 8, 0, 1 << 60), (9, 8, 1, 5)]
    data = [(p, k, None if s is None else T0 + dt.timedelta(seconds=s), v) for p, k, s, v in rows]
    df = spark.createDataFrame(data, "packet_id long, flow_key long, ts timestamp_ntz, pkt_len long")
    for partitions in (1, 9):
        got = {r.packet_id: (r.n_buffer, r.pkt_len_var, r.flow_iat_max)
               for r in W.buffer_stats(df, "pkt_len", partitions=partitions).collect()}
        assert got == {1: (1, 0.0, 0.0), 2: (2, 25.0, 1000.0), 3: (1, 0.0, 0.0), 4: (1, 0.0, 0.0), 5: (1, None, 0.0), 6: (2, 0.0, 0.0),
                       7: (3, 100.0, 0.0), 8: (1, None, 0.0), 9: (2, 0.0, 1000.0)}
    assert W.buffer_stats(df.where("false"), "pkt_len").count() == 0
    flows = packets_df(spark, [(1, 1, 0.0, 5)]).where("false")
    assert W.flow_rollup(flows).count() == 0


def test_auc_matches_pair_count(spark):
    rnd = random.Random(11)
    data = [(rnd.choice([0, 1]), rnd.choice([0.1, 0.2, 0.2, 0.5, 0.7, 0.9])) for _ in range(500)]
    df = spark.createDataFrame(data, "y int, s double")
    auc = M.roc_auc(df, "y", "s", num_ranges=4).first()["auc"]
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    pairs = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    assert auc == pytest.approx(pairs / (len(pos) * len(neg)), abs=1e-6)


def test_class_report_union_of_labels(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")  # 2 never predicted
    rep = {r["name"]: r for r in M.class_report(df, "y", "p").collect()}
    assert rep["2"]["recall"] == 0.0 and rep["2"]["precision"] == 0.0
    assert rep["accuracy"]["f1"] == pytest.approx(0.5)
    assert rep["macro avg"]["support"] == 4


def test_single_class_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 5, "y int, p int")
    r = M.binary_metrics(df, "y", "p").first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0, 1.0)


def test_stratified_split_sizes(spark):
    rows = [(i, "a" if i % 10 else "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, label string")
    out = SM.split_stratified(df, "label", "row_id").where("split = 'test'").groupBy("label").count().collect()
    got = {r["label"]: r["count"] for r in out}
    assert got == {"a": round(0.2 * 1800), "b": round(0.2 * 200)}


@pytest.mark.parametrize("n", [1, 137, 4999, 6000])
def test_sample_n_is_first_in_hash_order(spark, n):
    ids = list(range(0, 50000, 10))
    df = spark.createDataFrame([(i, i % 7) for i in ids], "row_id long, k int")
    got = sorted(r.row_id for r in SM.sample_n(df, n, "row_id").collect())
    want = sorted(sorted(ids, key=lambda i: ((i % 2147483648) * 2654435761 + 42) % 4294967296)[:n])
    assert got == want


def _record(spark, **kw):
    base = dict(row_id=1, protocol=6, src_port=443, dst_port=80, flow_byts_s=1500.0, flow_pkts_s=12.5,
                flow_iat_mean=40.0, fwd_header_len=20.0, bwd_header_len=0.0, rst_flag_cnt=1, syn_flag_cnt=3,
                tot_fwd_pkts=4, tot_bwd_pkts=2, fwd_pkt_len_mean=60.0, bwd_pkt_len_mean=0.0, slm_label="Malicious",
                slm_score=0.95, binary_pred=True, attack_label="DDoS")
    base.update(kw)
    schema = ("row_id long, protocol int, src_port int, dst_port int, flow_byts_s double, flow_pkts_s double, "
              "flow_iat_mean double, fwd_header_len double, bwd_header_len double, rst_flag_cnt long, "
              "syn_flag_cnt long, tot_fwd_pkts long, tot_bwd_pkts long, fwd_pkt_len_mean double, "
              "bwd_pkt_len_mean double, slm_label string, slm_score double, binary_pred boolean, attack_label string")
    return spark.createDataFrame([tuple(base[k] for k in [s.split()[0] for s in schema.split(", ")])], schema)


def test_alert_text_ddos(spark):
    text = A.add_alert_text(_record(spark)).first()["alert_text"]
    assert text.startswith("THREAT: Suspicious DDoS activity detected on port 80\n\nAttack Details:\n")
    assert "        - Flow Rate: 1500.00 bytes/sec\n" in text
    assert "        - Connection: Port 443.0 (HTTPS) → Port 80.0 (HTTP) over TCP\n" in text
    assert "        - Impact Level: High\n" in text
    assert "        - Attack Vector: Volume-based DDoS" in text
    assert text.endswith("IMPACT: Potential security risk requiring investigation and monitoring")


@pytest.mark.parametrize("dst,expected", [
    (21, "WARNING: HTTP DoS Attack targeting FTP port (21.0) over TCP"),
    (0, "WARNING: HTTP DoS Attack targeting unknown port over TCP"),
    (9999, "WARNING: HTTP DoS Attack on non-HTTP port 9999.0 over TCP"),
    (443, "Target: Port 443.0 (HTTPS) over TCP"),
])
def test_slowhttptest_port_analysis(spark, dst, expected):
    r = _record(spark, dst_port=dst, attack_label="DoS Slowhttptest")
    assert r.select(A.port_analysis().alias("p")).first()["p"] == expected


def test_protocol_spellings(spark):
    from netsieve.operators.labels import protocol_name

    df = spark.createDataFrame([("6.0",), ("abc",), ("17",), ("47",), (None,)], "p string")
    got = [r[0] for r in df.select(protocol_name(F.col("p"))).collect()]
    assert got == ["TCP", "Unknown Protocol", "UDP", "Protocol 47", "Unknown Protocol"]


def test_fallback_null_class_and_score(spark):
    t = _record(spark, attack_label=None, slm_score=None, dst_port=8080).select(A.alert_fallback().alias("t")).first()["t"]
    assert t.startswith("THREAT: Suspicious Unknown activity detected on ports 443 → 8080 with anomalous")
    d = _record(spark, slm_score=None).select(A.alert_fallback().alias("t")).first()["t"]
    assert "targeting port 80 with a high confidence score of 0.00." in d


def test_alert_text_falls_back_when_metric_missing(spark):
    t = A.add_alert_text(_record(spark, flow_pkts_s=None)).first()["alert_text"]
    assert t.startswith("THREAT: A DDoS attack has been detected")


def test_validate_text(spark):
    good = ("THREAT: x\n\nnoise\n\nMITIGATION:\n1. a\n\n2. b\n3. c\n4. d\n5. e\n\nIMPACT: y")
    missing = "THREAT: x\n\nIMPACT: y"
    df = spark.createDataFrame([(good,), (missing,)], "t string")
    out = [r[0] for r in df.select(TX.validate_text("t", F.lit("FALLBACK"))).collect()]
    assert out[0] == "THREAT: x\n\nMITIGATION:\n1. a\n\nIMPACT: y" or out[0].startswith("THREAT: x")
    assert out[1] == "FALLBACK"
    many = "THREAT: x\n\nMITIGATION:\n1. a\n2. b\n3. c\n4. d\n5. e\n\nIMPACT: y"
    v = spark.createDataFrame([(many,)], "t string").select(TX.validate_text("t", F.lit("F"))).first()[0]
    assert v == "THREAT: x\n\nMITIGATION:\n1. a\n2. b\n3. c\n\nIMPACT: y"


def test_clean_text_keywords_and_length(spark):
    text = "An attack here\nnothing\n  security  note  \n" + "attack " * 25
    v = spark.createDataFrame([(text,)], "t string").select(TX.clean_text("t")).first()[0]
    assert v == "An attack here\nsecurity  note"


def test_csv_folder_edge_cases(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "flows")
    os.makedirs(folder)
    head = "Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Flow Byts/s,Label\n"
    with open(os.path.join(folder, "a.csv"), "w") as f:
        f.write(head)
        f.write("80,6,01/02/2024 10:00:00,5,1,1,10,10,Infinity,Benign\n")
        f.write(head)  # repeated header row
        f.write("443,6,31/02/2024 10:00:00,5,1,1,10,10,-inf,DDoS attacks-LOIC-HTTP\n")
        f.write("21,6,01/02/2024 10:00:00,5,1,1,10,10,NaN,\n")
        f.write("22,6,01/02/2024 10:00:00,5,1,1,10,10,,Mystery\n")
    with open(os.path.join(folder, "b.csv"), "w") as f:
        f.write("Flow ID,Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,"
                "TotLen Bwd Pkts,Label,Src IP\n")
        f.write("x,80,17,02/02/2024 11:00:00,5,1,1,10,10,Bot,1.2.3.4\n")
    with open(os.path.join(folder, "c.csv"), "w") as f:
        f.write("Dst Port,Timestamp,Label\n80,01/02/2024 10:00:00,Benign\n")
    open(os.path.join(folder, "empty.csv"), "w").close()
    with open(os.path.join(folder, "long.csv"), "w") as f:
        f.write(head + "80,6,01/02/2024 10:00:00,5,1,1,10,10,1,Bot\n80,6,01/02/2024 10:00:00,5,1,1,10,10,1,Bot,more,fields\n")
    with open(os.path.join(folder, "garbage.csv"), "wb") as f:
        f.write(bytes(range(128, 256)) * 3)
    with open(os.path.join(folder, "bom.csv"), "w", encoding="utf-8-sig") as f:
        f.write(head.replace("Label", '"Label","odd, name"') + '80,6,01/02/2024 10:00:00,5,1,1,10,10,1,"Bot",1\n')
    with open(os.path.join(folder, "readme.txt"), "w") as f:
        f.write("not data\n")
    rows = CF.scan_flows(spark, folder, required=None)
    assert rows.where("source_file not in ('long.csv', 'bom.csv', 'garbage.csv')").count() == 7  # the repeated header is a row until cleaned
    b = rows.where("source_file = 'b.csv'").first()
    assert b["flow_id"] == "x" and b["label"] == "Bot"
    byts = {r["dst_port"]: r["flow_byts_s"] for r in rows.where("source_file = 'a.csv'").collect()}
    assert byts[80.0] == float("inf") and byts[443.0] == float("-inf") and np.isnan(byts[21.0]) and byts[22.0] is None
    rep = {r["file_name"]: r["status"] for r in CF.ingest_report(spark, folder).collect()}
    assert rep["a.csv"] == "processed" and rep["b.csv"] == "processed"
    assert rep["c.csv"].startswith("skipped: missing columns Protocol")
    assert rep["long.csv"] == "skipped: 1 rows with more fields than the header" and rep["bom.csv"] == "processed"
    assert rep["garbage.csv"].startswith("skipped: missing columns")
    good, report = CF.ingest(spark, folder)
    assert {r["source_file"] for r in good.select("source_file").distinct().collect()} == {n for n, s in rep.items() if s == "processed"}
    assert report.count() == len(rep) and good.where("source_file = 'bom.csv'").first()["label"] == "Bot"
    assert CF._first_line(spark, os.path.join(folder, "absent.csv"))[1].startswith("FileNotFoundException")
    assert rep["empty.csv"] == "skipped: empty file" and rep["readme.txt"] == "skipped: not a CSV file"
    from netsieve.operators import clean as C
    from netsieve.operators import labels as L
    clean = L.clean_labels(rows.where("source_file = 'a.csv'"), "label")
    assert clean.count() == 3  # header row and empty label gone
    finite = C.finite_rows(rows.where("source_file = 'a.csv'").select("dst_port", "flow_byts_s"))
    assert finite.count() == 0  # inf -> missing, NaN and empty dropped


def test_examples_json_array(spark, tmp_dir):
    path = os.path.join(tmp_dir, "ex.json")
    with open(path, "w") as f:
        f.write('[{"input": {"Protocol": 6, "Src Port": 1, "Dst Port": 80, "Flow Rate": 1.0, "Packet Rate": 2.0, '
                '"IAT Mean": 3.0, "Attack Type": "DDoS"}, "output": {"threat": "t", "mitigation": ["a", "b"], '
                '"impact": "i"}}]')
    r = SK.read_examples(spark, path, multiline=True).first()
    assert r["input"]["Attack Type"] == "DDoS" and r["output"]["mitigation"] == ["a", "b"]


def test_numbers_are_spelled_as_the_original_prints_them(spark):
    rnd = random.Random(4)
    values = [12345678.9, 0.0005, 0.0001, 1e-05, 1.5e16, 1e16, 9999999999999998.0, 100.0, 0.0, -0.0, -2.5, 1 / 3, 0.1 + 0.2, 5e-7,
              float("inf"), float("-inf"), float("nan"), 1e23, 123456789.123]
    values += [rnd.random() * 10 ** rnd.randint(-8, 16) for _ in range(2000)] + [round(rnd.random() * 1e6, rnd.randint(0, 6)) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, x double")
    got = {r.i: r.s for r in df.select("i", TX.spelled(F.col("x")).alias("s")).collect()}
    assert [got[i] for i in range(len(values))] == [repr(x) for x in values]
    assert spark.range(1).select(TX.spelled(F.lit(None).cast("double")).alias("n"), TX.spelled(F.lit(7)).alias("i")).first() == (None, "7")


def test_values_that_look_like_placeholders_stay(spark):
    """Expected text written by hand; the attack type is a placeholder's name, a metric is a large double."""
    row = dict(protocol=6, src_port=1000, dst_port=80, flow_byts_s=12345678.9, flow_pkts_s=2.0, flow_iat_mean=1.0, fwd_header_len=1.0,
               bwd_header_len=1.0, rst_flag_cnt=3, syn_flag_cnt=4, tot_fwd_pkts=5, tot_bwd_pkts=6, fwd_pkt_len_mean=1.0,
               bwd_pkt_len_mean=1.0, slm_label=None, slm_score=0.5, binary_pred=True, attack_label="{severity} {impact}")
    df = spark.createDataFrame([row], "protocol int, src_port int, dst_port int, flow_byts_s double, flow_pkts_s double, "
                                      "flow_iat_mean double, fwd_header_len double, bwd_header_len double, rst_flag_cnt long, syn_flag_cnt long, "
                                      "tot_fwd_pkts long, tot_bwd_pkts long, fwd_pkt_len_mean double, bwd_pkt_len_mean double, slm_label string, "
                                      "slm_score double, binary_pred boolean, attack_label string")
    want = """THREAT: Suspicious {severity} {impact} activity detected on port 80

Attack Details:
        - Flow Rate: 12345678.90 bytes/sec
        - Packet Rate: 2.00 packets/sec
        - Protocol: TCP
        - Connection: Port 1000.0 (Unknown) → Port 80.0 (HTTP) over TCP
        - Connection Pattern: Burst
        - Forward Packets: 5
        - Backward Packets: 6
        - Alert Confidence: 0.50

MITIGATION:
• Enable enhanced monitoring
• Update security signatures
• Review system logs
• Implement additional filtering

IMPACT: Potential security risk requiring investigation and monitoring"""
    assert A.add_alert_text(df).first().alert_text == want == df.select(A.alert_text().alias("t")).first().t
    missing = A.add_alert_text(df.withColumn("tot_fwd_pkts", F.lit(None).cast("long"))).first().alert_text
    assert missing.startswith("THREAT: Suspicious {severity} {impact} activity detected on port 80 with anomalous")
    assert "Forward Packets: {NULL}" in A.add_alert_detail(df.withColumn("tot_fwd_pkts", F.lit(None).cast("long"))).first().alert_detail


def test_log_runs_are_committed_whole_and_once(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    df = spark.createDataFrame([(1, 0.5, "two\nlines, \"quoted\""), (2, None, None)], "id long, x double, text string")
    schema = df.schema
    assert SK.read_log(spark, path, schema).collect() == []
    SK.append_log(df, path, "a")
    SK.append_log(df.where("id = 1"), path, "b")
    SK.append_log(df.where("id = 2"), path, "b")  # a replay
    df.write.option("header", True).csv(f"{path}/run_id=c/attempt=dead")  # parts without a manifest entry
    got = sorted(tuple(r) for r in SK.read_log(spark, path, schema).collect())
    assert got == [(1, 0.5, 'two\nlines, "quoted"', "a"), (2, None, None, "a"), (2, None, None, "b")]
