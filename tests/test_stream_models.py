"""Streaming = batch on the same rows; model invariants (above-chance AUC, probabilities sum to 1, save/load)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from netsieve.operators import metrics as M
from netsieve.operators import models as MD
from netsieve.session import scratch_dir

from conftest import SF_SMALL


def test_stream_buffer_equals_batch(spark):
    q = E.queries()
    rows = q["win_stream"](spark, SF_SMALL).collect()
    stream = {r.packet_id: (r.n_buffer, round(r.pkt_len_std, 6)) for r in rows}
    batch = {r.packet_id: (r.n_buffer, round(r.pkt_len_std, 6)) for r in q["win_pkt_len"](spark, SF_SMALL).collect()}
    assert stream == batch
    cols = ("flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min")
    iat = {r.packet_id: tuple(r[c] for c in cols) for r in q["win_iat"](spark, SF_SMALL).collect()}
    assert {r.packet_id: tuple(r[c] for c in cols) for r in rows} == iat


def test_stream_buffer_late_packets(spark):
    """Packets of a later drop older than the buffered ones are applied in arrival order (deque rule)."""
    import datetime as dt
    import time

    from netsieve import schemas
    from netsieve.streaming import streams as ST

    t0 = dt.datetime(2024, 1, 1)
    drops = [[(1, 0), (2, 10), (3, 20), (4, 30)], [(5, 25), (6, 40), (7, 95)]]
    src = scratch_dir(spark, "late-in")
    for d in drops:
        rows = [(pid, t0 + dt.timedelta(seconds=sec), 1, "a", "b", 6, 1, 2, 0, 0, 100 + pid, "") for pid, sec in d]
        spark.createDataFrame(rows, schemas.PACKET).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # arrival order = file modification order
    out, ck = scratch_dir(spark, "late-out"), scratch_dir(spark, "late-ck")
    ST.run_to_files(ST.buffer_state(ST.packet_stream(spark, src, max_files=1), window_seconds=60, cap=3, watermark="60 seconds"),
                    out, ck)
    got = {r.packet_id: (r.n_buffer, r.flow_iat_max) for r in spark.read.parquet(out).collect()}
    # deque per drop (sorted inside a drop): expire older than 60 s from the front, then keep at most 3
    buf, prev, want = [], None, {}
    for d in drops:
        for pid, sec in sorted(d, key=lambda x: (x[1], x[0])):
            gap = None if prev is None else (sec - prev) * 1000.0
            prev = sec
            buf.append((sec, gap))
            while buf[0][0] < sec - 60:
                buf.pop(0)
            buf = buf[-3:]
            gaps = [g for _, g in buf if g is not None]
            want[pid] = (len(buf), max(gaps) if gaps else 0.0)
    assert got == want


def test_stream_alerts_equal_batch_rows(spark):
    q = E.queries()
    s = {r.row_id for r in q["alert_stream"](spark, SF_SMALL).select("row_id").collect()}
    b = {r.row_index for r in q["alert_log"](spark, SF_SMALL).select("row_index").collect()}
    assert s == b


def test_streams_return_every_flow(spark):
    """Closed flows and those open at the end: the flows of the batch rollup."""
    q = E.queries()
    cols = ["flow_key", "flow_start", "n_packets", "flow_duration"]
    batch = sorted(q["flow_rollup"](spark, SF_SMALL).select(cols).collect())
    for name in ("flow_rollup_stream", "flow_rollup_state"):
        assert sorted(q[name](spark, SF_SMALL).select(cols).collect()) == batch


@pytest.mark.parametrize("operator, left", [("session_rollup", "open_sessions"), ("flow_state", "open_flows")])
def test_a_stream_goes_on_after_its_state_was_read(spark, operator, left):
    """Restart from the checkpoint: what was open is closed by the next drop, and read as open before."""
    import datetime as dt

    from netsieve import schemas
    from netsieve.streaming import streams as ST

    t0 = dt.datetime(2024, 1, 1)
    src, out, ck = (scratch_dir(spark, f"again-{x}") for x in ("in", "out", "ck"))
    gap = {"gap": "60 seconds"} if operator == "session_rollup" else {"gap_seconds": 60}

    def drop(rows):
        data = [(i, t0 + dt.timedelta(seconds=s), k, "a", "b", 6, 1, 2, 0, 0, n, "") for i, k, s, n in rows]
        spark.createDataFrame(data, schemas.PACKET).coalesce(1).write.mode("append").parquet(src)
        stream = getattr(ST, operator)(ST.packet_stream(spark, src, max_files=None), watermark="60 seconds", **gap)
        ST.run_to_files(stream, out, ck)
        rows = lambda d: sorted((r.flow_key, r.n_packets, r.flow_duration) for r in d.collect())
        return rows(spark.read.parquet(out)), rows(getattr(ST, left)(spark, ck))

    assert drop([]) == ([], [])
    assert drop([(1, 1, 0, 100), (2, 1, 10, None), (3, 2, 5, 70)]) == ([], [(1, 2, 10_000_000), (2, 1, 0)])
    closed, held = drop([(4, 1, 30, 50), (5, 3, 500, 10)])
    assert (closed, held) == ([(1, 3, 30_000_000), (2, 1, 0)], [(3, 1, 0)])


def test_rejects_are_the_bad_rows(spark):
    rej = E.queries()["reject_stream"](spark, SF_SMALL).collect()
    assert rej and all(r.packet_id is None or r.packet_id % 97 == 0 for r in rej)


def _separable(spark, n=400):
    rows = [(i, float(i % 2), float(i % 2) * 10 + (i % 7) * 0.1, float(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y double, a double, b double")


def test_binary_model_auc_and_roundtrip(spark):
    df = _separable(spark)
    model = MD.train_binary(df, "y", features=["a", "b"], max_iter=5)
    scored = MD.positive_probability(model, df)
    assert M.roc_auc(scored, "y", "score").first()["auc"] > 0.9
    path = scratch_dir(spark, "test-model")
    model.write().overwrite().save(path)
    from pyspark.ml import PipelineModel
    again = MD.positive_probability(PipelineModel.load(path), df)
    a = sorted((r.row_id, r.score) for r in scored.collect())
    b = sorted((r.row_id, r.score) for r in again.collect())
    assert a == b


def test_multi_probabilities_sum_to_one(spark):
    rows = [(i, ["x", "y", "z"][i % 3], float(i % 3), float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, label string, a double, b double")
    model = MD.train_multi(df, "label", features=["a", "b"], max_iter=3)
    out = MD.multi_predict(model, df)
    sums = out.select(F.aggregate("probs", F.lit(0.0), lambda acc, x: acc + x).alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)
    acc = out.where("pred_label = label").count() / out.count()
    assert acc > 0.9


def test_flow_state_matches_brute_force(spark):
    """Flows as streaming state: a flow spanning two drops, a null address and length, a gap equal to the
    session gap (a new flow), and the watermark closing the open flows at the end."""
    import datetime as dt
    import time

    from netsieve import schemas
    from netsieve.streaming import streams as ST

    t0 = dt.datetime(2024, 1, 1)
    # (packet_id, key, seconds, src_ip, pkt_len)
    drops = [[(1, 1, 0, "a", 100), (2, 1, 30, "b", 200), (3, 2, 5, None, 50), (4, 1, 50, "a", None)],
             [(5, 1, 149, "a", 300), (6, 1, 249, "b", 400), (7, 2, 500, "c", 60), (8, 1, 2000, "a", 10)]]
    src = scratch_dir(spark, "fs-in")
    for d in drops:
        rows = [(pid, t0 + dt.timedelta(seconds=s), k, ip, "x", 6, 1, 2, 0, 0, ln, "") for pid, k, s, ip, ln in d]
        spark.createDataFrame(rows, schemas.PACKET).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    out, ck = scratch_dir(spark, "fs-out"), scratch_dir(spark, "fs-ck")
    ST.run_to_files(ST.flow_state(ST.packet_stream(spark, src, max_files=1), gap_seconds=100, watermark="100 seconds"), out, ck)
    got = {(r.flow_key, (r.flow_start - t0).total_seconds()): r for r in spark.read.parquet(out).collect()}

    pk = sorted([p for d in drops for p in d], key=lambda p: (p[1], p[2], p[0]))
    flows, last = {}, {}
    for pid, k, s, ip, ln in pk:
        if k not in last or s - last[k][0] >= 100:
            flows[(k, s)] = []
            last[k] = (s, (k, s))
        else:
            last[k] = (s, last[k][1])
        flows[last[k][1]].append((s, ip, ln))
    # closed by a later packet of the key, or by the final watermark (max time - 100 s) passing end + 100 s
    latest = max(p[2] for p in pk)
    emitted = {f for f in flows if f != last[f[0]][1] or latest - 100 > flows[f][-1][0] + 100}
    assert set(got) == emitted
    for f in emitted:
        ps, r = flows[f], got[f]
        src0 = ps[0][1]
        fwd = [p for p in ps if p[1] == src0]
        gaps = [(b[0] - a[0]) * 1000.0 for a, b in zip(ps, ps[1:])]
        lens = [p[2] for p in ps if p[2] is not None]
        assert (r.n_packets, r.tot_fwd_pkts, r.tot_bwd_pkts) == (len(ps), len(fwd), len(ps) - len(fwd))
        assert r.flow_duration == (ps[-1][0] - ps[0][0]) * 1_000_000
        assert r.totlen_fwd_pkts == (sum(p[2] for p in fwd if p[2] is not None) or None)
        assert r.pkt_len_max == (max(lens) if lens else None)
        assert r.flow_iat_max == (max(gaps) if gaps else None)
        assert r.flow_iat_mean == (pytest.approx(sum(gaps) / len(gaps)) if gaps else None)


def test_text_model_learns_its_prompts(spark):
    """The prompt names the attack type, so the hashed TF-IDF + logistic regression model recovers it."""
    out = E.queries()["train_text"](spark, SF_SMALL)
    n = out.count()
    hit = out.where("pred_id = label_id").count()
    assert n > 0 and hit / n > 0.95
    scored = E.queries()["score_text"](spark, SF_SMALL)
    assert scored.where("score IS NOT NULL AND (score < 0 OR score > 1)").count() == 0


def test_streams_do_not_depend_on_the_session_zone(spark):
    q = E.queries()

    def rows(name):
        return sorted(tuple(r) for r in q[name](spark, SF_SMALL).collect())

    base = {n: rows(n) for n in ("win_stream", "flow_rollup_state")}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert {n: rows(n) for n in base} == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def _plain_booster(x, y, w, val, keys, edges, classes, rounds, features):
    """The booster written out with loops over nodes and bins: curves of both splits."""
    import numpy as np

    from netsieve.operators import boosting as B

    bins = np.array([[sum(e < v for e in es) for v, es in zip(row, edges)] for row in x])
    margin, curve = np.zeros((len(x), classes)), []
    for r in range(rounds):
        p = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
        used = ~val & B._sampled(keys, r, 42)
        step = np.zeros_like(margin)
        for k in range(classes):
            g, h = (p[:, k] - (y == k)) * w, 2 * p[:, k] * (1 - p[:, k]) * w
            allowed = B._features_of(r, k, features, 42)

            def grow(rows, every, depth):
                def value():
                    return B.RATE * np.clip(-g[rows].sum() / (h[rows].sum() + 1), -1, 1)

                found = []
                for f in np.flatnonzero(allowed) if depth < B.DEPTH else []:
                    for c in range(B.BINS - 1):
                        left, right = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                        hl, hr = h[left].sum(), h[right].sum()
                        if hl < 1 or hr < 1:
                            continue
                        gain = g[left].sum() ** 2 / (hl + 1) + g[right].sum() ** 2 / (hr + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                        found.append((gain, f, c))
                top = max((gain for gain, _, _ in found), default=0.0)
                if top <= 1e-9:
                    step[every, k] = value()
                    return
                f, c = next((f, c) for gain, f, c in found if gain >= top * (1 - 1e-9))
                grow(rows[bins[rows, f] <= c], every[bins[every, f] <= c], depth + 1)
                grow(rows[bins[rows, f] > c], every[bins[every, f] > c], depth + 1)

            grow(np.flatnonzero(used), np.arange(len(x)), 0)
        margin += step
        p = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
        for name, rows in (("train", ~val), ("test", val)):
            weight = w[rows] if name == "train" else np.ones(rows.sum())
            loss, err = -np.log(p[rows, y[rows]]), p[rows].argmax(1) != y[rows]
            curve.append((r, name, (weight * loss).sum() / weight.sum(), (weight * err).sum() / weight.sum()))
    return curve


def test_softmax_booster_equals_a_plain_one(spark):
    import numpy as np

    from netsieve.operators import boosting as B

    rng = np.random.default_rng(6)
    n, names = 240, ["benign", "dos", "scan"]
    x = rng.integers(0, 9, (n, 5)).astype(float)
    y = ((x[:, 0] > 4).astype(int) + (x[:, 1] + x[:, 2] > 9) + (rng.random(n) < 0.1)) % 3
    w, val, keys = rng.integers(1, 4, n).astype(float), rng.random(n) < 0.25, np.arange(n) * 7 + 1
    rows = [(int(keys[i]), names[y[i]], bool(val[i]), float(w[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, label string, held boolean, w double, a double, b double, c double, d double, e double")
    features = list("abcde")
    model = B.train(df.repartition(3), "label", features, "row_id", "held", "w", max_iter=4, patience=10)
    curve = _plain_booster(x, y, w, val, keys, model.edges, 3, 4, 5)
    assert [c[:2] for c in model.curve] == [c[:2] for c in curve]
    for got, want in zip(model.curve, curve):
        assert got[2:] == pytest.approx(want[2:], abs=1e-9)
    best = min(range(4), key=lambda r: (curve[2 * r + 1][3], r))
    assert len(model.rounds) == best + 1  # rounds after the best are dropped
    path = scratch_dir(spark, "softmax-model")
    model.save(spark, path)
    a, b = (sorted((r.row_id, tuple(r.probs), r.pred_label) for r in B.predict(m, df).collect()) for m in (model, B.SoftmaxModel.load(spark, path)))
    assert a == b and all(sum(p) == pytest.approx(1.0) for _, p, _ in a)
    assert model.curve_table(spark).count() == 8
    # early stop, missing values, one class, no rows
    stopped = B.train(df.withColumn("label", F.when(F.col("held"), "dos").otherwise("benign")), "label", features, "row_id", "held")
    assert stopped.rounds == [] and B.predict(stopped, df).where("pred_label = 'benign'").count() == n
    holes = df.withColumn("a", F.when(F.col("row_id") % 3 == 0, None).otherwise(F.col("a")))
    assert len(B.train(holes, "label", features, "row_id", max_iter=2).rounds) == 2
    assert B.train(df.where("false"), "label", features, "row_id").labels == []


def test_a_boosting_round_is_one_job_per_level_and_one_for_the_margins(spark):
    """No query plan per level: its planning took most of a round on tables that fit one machine."""
    from netsieve.operators import boosting as B

    rows = [(i, ("a", "b", "c")[i * 7 % 3], float(i % 11), float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, label string, a double, b double").persist()

    def jobs(rounds):
        group = f"boost-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert len(B.train(df, "label", ["a", "b"], "row_id", max_iter=rounds).rounds) == rounds
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(5) - jobs(1) <= 4 * (B.DEPTH + 1)


def test_a_tree_sends_rows_to_the_leaf_that_its_splits_name(spark):
    import numpy as np

    from netsieve.operators import boosting as B

    rng = np.random.default_rng(3)
    tree = B.Tree.empty(3)
    for node, feature, cut in ((0, 1, 4), (1, 0, 2), (2, 2, 7), (4, 1, 1), (6, 0, 60)):
        tree.feature[node], tree.cut[node] = feature, cut
    bins = rng.integers(0, 64, (200, 3)).astype(np.uint8)

    def walk(row):
        at = 0
        while tree.feature[at] >= 0:
            at = 2 * at + 1 + int(row[tree.feature[at]] > tree.cut[at])
        return at

    assert tree.nodes(bins).tolist() == [walk(row) for row in bins]
    assert B.Tree.empty(3).nodes(bins).tolist() == [0] * 200 and tree.nodes(bins[:0]).tolist() == []


def test_the_forest_keeps_node_ids_and_uses_the_cores(spark):
    df = _separable(spark)
    model = MD.train_baseline(df, "y", features=["a", "b"], num_trees=3)
    assert model.stages[-1].getCacheNodeIds()
    assert model.transform(df).where("prediction <> y").count() == 0
    one = spark.range(0, 3 * MD.TASK_ROWS + 1, 1, 1)
    assert MD.spread(one).rdd.getNumPartitions() == 3 and MD.spread(one).count() == 3 * MD.TASK_ROWS + 1
    assert MD.spread(one.limit(MD.TASK_ROWS)).rdd.getNumPartitions() == 1  # a small table stays as it is
    assert MD.spread(spark.range(0, 100, 1, 9)).rdd.getNumPartitions() == 9


@pytest.mark.parametrize("operator", ["flow_state", "buffer_state"])
def test_state_functions_get_few_columns(spark, operator):
    """A key's frame costs by its columns: payload, addresses of the other end and single flags stay out."""
    from netsieve.streaming import streams as ST

    src = scratch_dir(spark, "narrow-in")
    spark.createDataFrame([], ST.schemas.PACKET).write.parquet(src)
    plan = getattr(ST, operator)(ST.packet_stream(spark, src))._jdf.queryExecution().analyzed()
    while "WithState" not in plan.nodeName():
        plan = plan.children().head()
    assert plan.children().head().output().size() <= 6


def test_state_functions_with_nulls_over_two_batches(spark):
    """Missing lengths, ports, protocols of a flow and addresses, before and after the state was kept."""
    import datetime as dt

    from netsieve import schemas
    from netsieve.streaming import streams as ST

    t0 = dt.datetime(2024, 1, 1)
    src, out, ck, out2, ck2 = (scratch_dir(spark, f"nulls-{x}") for x in ("in", "out", "ck", "out2", "ck2"))
    drops = [[(1, 0, None, None, None), (2, 10, "a", 70, 5)], [(3, 40, None, 30, None), (4, 200, "b", None, 9)]]
    for d in drops:
        rows = [(i, t0 + dt.timedelta(seconds=s), 1, a, "x", 6, port, None, None, 0, n, "") for i, s, a, n, port in d]
        spark.createDataFrame(rows, schemas.PACKET).coalesce(1).write.mode("append").parquet(src)
        packets = ST.packet_stream(spark, src, max_files=None)
        ST.run_to_files(ST.flow_state(packets, gap_seconds=60, watermark="600 seconds"), out, ck)
        ST.run_to_files(ST.buffer_state(packets, window_seconds=60, cap=3, watermark="600 seconds"), out2, ck2)
    flows = spark.read.parquet(out).unionByName(ST.open_flows(spark, ck)).orderBy("flow_start").collect()
    got = [(r.n_packets, r.src_port, r.dst_port, r.tot_fwd_pkts, r.tot_bwd_pkts, r.totlen_fwd_pkts, r.totlen_bwd_pkts, r.pkt_len_std,
            r.flow_iat_max) for r in flows]
    assert got == [(3, None, None, 2, 1, 30.0, 70.0, 20.0, 30000.0), (1, 9, None, 1, 0, None, None, None, None)]
    rows = {r.packet_id: (r.n_buffer, r.pkt_len_std, r.flow_iat_max) for r in spark.read.parquet(out2).collect()}
    assert {k: v[::2] for k, v in rows.items()} == {1: (1, 0.0), 2: (2, 10000.0), 3: (3, 30000.0), 4: (1, 160000.0)}
    assert rows[2][1] == 0.0 and rows[3][1] == 20.0


def test_a_level_sums_the_lighter_children_over_few_tasks(spark):
    """Tables cut into many small partitions: a pass has the tasks that its rows are worth, one stage and one job per level."""
    from netsieve.operators import boosting as B

    rows = [(i, ("a", "b", "c")[i * 7 % 3], float(i % 11), float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, label string, a double, b double").repartition(40)
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()

    def stages(rounds):
        context.setJobGroup(f"levels-{rounds}", "levels")
        try:
            model = B.train(df, "label", ["a", "b"], "row_id", max_iter=rounds)
        finally:
            context._jsc.clearJobGroup()
        infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"levels-{rounds}") for s in tracker.getJobInfo(j).stageIds]
        return model, [i.numTasks for i in infos if i is not None and i.numCompletedTasks]

    (short, before), (long, after) = stages(1), stages(5)
    assert len(long.rounds) == 5 and len(after) - len(before) <= 4 * B.DEPTH
    assert sum(after) - sum(before) <= 4 * B.DEPTH + 4  # one partition's rows; a checkpoint may add tasks
    wide = B.train(df, "label", ["a", "b"], "row_id", max_iter=1)
    assert [t.cut.tolist() for t in wide.rounds[0]] == [t.cut.tolist() for t in short.rounds[0]]


def test_sums_of_many_partitions_are_brought_together_first(spark, monkeypatch):
    """With and without a shuffle of the sums: the same trees and curve."""
    import numpy as np

    from netsieve.operators import boosting as B

    rng = np.random.default_rng(8)
    rows = [(i, "abcd"[int(rng.integers(4)) if i % 5 == 0 else int(x > 4) + 2 * int(y > 6)], x, y, i % 4 == 0)
            for i, (x, y) in enumerate(rng.integers(0, 10, (2000, 2)).astype(float).tolist())]
    df = spark.createDataFrame(rows, "row_id long, label string, a double, b double, held boolean")
    few = B.train(df, "label", ["a", "b"], "row_id", "held", max_iter=4)
    monkeypatch.setattr(B, "DIRECT", 0)
    monkeypatch.setattr(B, "TASK_ROWS", 500)
    many = B.train(df, "label", ["a", "b"], "row_id", "held", max_iter=4)
    assert len(few.curve) == len(many.curve) == 8
    for a, b in zip(few.curve, many.curve):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)
    for one, two in zip(few.rounds, many.rounds):
        for a, b in zip(one, two):
            assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist() and a.value == pytest.approx(b.value)
