"""The whole workflow on a flow CSV folder: preprocess -> train -> evaluate -> monitor."""

from pyspark.sql import functions as F

from netsieve.plans import jobs as J
from netsieve.plans import q_io, q_streaming
from netsieve.session import scratch_dir

from conftest import SF_SMALL


def test_workflow_on_csv_folder(spark):
    src = q_io.flow_csv_folder(spark, SF_SMALL)
    clean, models, out = scratch_dir(spark, "job-clean"), scratch_dir(spark, "job-models"), scratch_dir(spark, "job-out")

    report, audit = J.preprocess(spark, src, clean)
    rep = {r.file_name: r for r in report.collect()}
    assert rep["day3.csv"].status.startswith("skipped: missing columns")  # no Protocol column
    assert rep["notes.txt"].status == "skipped: not a CSV file" and rep["empty.csv"].status == "skipped: empty file"
    cleaned = spark.read.parquet(clean)
    kept = sum(r.n_rows for r in rep.values() if r.status == "processed")
    audit_final = sum(r.n_final for r in audit.collect())
    assert 0 < cleaned.count() <= audit_final <= kept
    assert cleaned.where("label = 'Label' OR label IS NULL").count() == 0
    assert cleaned.where(F.col("hour").isNull()).count() == 0  # impossible dates dropped

    metrics = J.train(spark, clean, models, max_iter=2)
    b = metrics["binary"].first()
    assert b.n > 0 and 0.0 <= b.accuracy <= 1.0
    assert 0.0 <= metrics["multi"].first().accuracy <= 1.0
    maps = spark.read.text(f"{models}/label_maps").collect()
    assert len(maps) == 1 and maps[0].value.startswith("encoder\t")

    alerts, summary = J.evaluate(spark, clean, models, out)
    s = summary.first()
    complete = J.complete_rows(cleaned, J.feature_columns(cleaned)).count()  # rows with a missing metric are no records
    assert s.total_records == complete < cleaned.count()
    assert alerts.count() == s.malicious_records
    assert set(alerts.columns) >= {"row_index", "notification", "multiclass_prediction", "slm_score"}
    assert {"test_duration_minutes", "test_start_time", "test_end_time"} <= set(summary.columns)
    assert len(summary.columns) == 8

    packets = q_streaming.packet_drops(spark, SF_SMALL, "job")
    n_ip = spark.read.parquet(packets).where("coalesce(protocol, 0) <> 0").count()
    for scorer in (None, _keyword_scorer()):
        mon = scratch_dir(spark, "mon-out")
        q = J.monitor(spark, packets, models, mon, scratch_dir(spark, "mon-ck"), text_scorer=scorer)
        q.awaitTermination()
        assert q.exception() is None
        traffic = spark.read.parquet(f"{mon}/traffic")
        assert traffic.select("packet_id").distinct().count() == n_ip  # every IP packet logged once
        fired = traffic.where("is_malicious").count()
        assert fired >= traffic.where("binary_prediction").count()  # binary OR text
        assert spark.read.parquet(f"{mon}/alerts").count() == fired
        if scorer is None:
            assert fired == traffic.where("binary_prediction").count()


def _keyword_scorer():
    """A stand-in text model as an Arrow pandas UDF: payloads with 'click' look like an attack."""
    import pandas as pd

    from netsieve.operators import models as MD

    def score(text: pd.Series) -> pd.DataFrame:
        hit = text.fillna("").str.contains("click")
        return pd.DataFrame({"label": hit.map({True: "DoS Hulk", False: "Normal"}), "score": hit.map({True: 0.9, False: 0.2})})

    return MD.pandas_text_scorer(score)
