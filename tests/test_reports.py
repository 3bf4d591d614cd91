"""Reports, and the whole diarization step."""

import numpy as np
from pyspark.sql import functions as F

from tidescribe.operators import reports
from tidescribe.streaming import diarize


def test_reports(spark):
    df = spark.createDataFrame([(i, float(i), i / 10) for i in range(1, 12)], "hop_index int, runtime_seconds double, latency_seconds double")
    r = reports.hop_summary(df).first()
    assert (r.hops, r.runtime_p50, r.runtime_p95) == (11, 6.0, 10.5)
    q = spark.createDataFrame([("keep", True), ("drop", False), ("review", False)], "d string, r boolean")
    got = reports.queue_counts(q, "d", F.col("r")).first()
    assert (got["all"], got.keep, got.reviewed, got.unreviewed) == (3, 1, 1, 2)
    w = spark.createDataFrame([("a+b",), ("silero_vad_gap",), ("source_end",)], "method string")
    e = reports.evidence_coverage(w).first()
    assert (e.multi, e.single, e.none) == (1, 1, 1)
    assert [r.hop_index for r in reports.sample_cap(df, 2, "hop_index").collect()] == [1, 2]
    assert reports.ordered(df, "runtime_seconds", by=["latency_seconds"]).filter("index = 0").count() == 11
    a = spark.createDataFrame([("s", 0.0, 100.0), ("s", 200.0, 201.0), (None, 0.0, 9.0)], "k string, start double, end double")
    b = spark.createDataFrame([("s", 99.0, 120.0), ("s", 5.0, 6.0), ("s", 201.0, 205.0)], "k string, start double, end double")
    assert [(r.start, r.end) for r in reports.with_overlap(a, b, ["k"]).collect()] == [(0.0, 100.0)]
    assert len(reports.HOP_COLUMNS) == 20


def test_diarization_session_on_a_table(spark):
    rng = np.random.default_rng(1)
    people = [rng.normal(size=8) for _ in range(2)]
    rows = []
    for i in range(12):
        end = 10.0 + i
        local = [(f"L{j}", (people[j if i % 2 else 1 - j] + rng.normal(size=8) * 0.02).tolist(), 4.0, 0.0, [(end - 3.0 + k, end - 2.0 + k)]) for j, k in ((0, 0.0), (1, 0.5))]
        rows.append(("s", i, "window", end - 10, end, local))
    df = spark.createDataFrame(rows, f"session string, seq long, kind string, start double, end double, locals {diarize.LOCALS}")
    out = diarize.diarize(df).collect()
    kinds = {r.type for r in out}
    assert {"turn.created", "turn.committed"} <= kinds
    last = {r.id: r for r in sorted(out, key=lambda r: r.version)}
    assert {r.speaker for r in last.values() if r.type in ("turn.committed", "turn.corrected")} & {"SPEAKER_00", "SPEAKER_01"}
