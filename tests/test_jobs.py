"""Plug-in models, jobs and review sessions."""

import time

import pytest

from tidescribe.functions import models
from tidescribe.plans import jobs


def test_backends_and_models(spark):
    df = spark.createDataFrame([("a", 10, [0.0, 0.0, 1.0, 1.0, 0.0]), ("b", 10, [])], "key string, rate int, samples array<float>")
    got = models.apply_model(df, models.backend("vad", "missing", "energy"), "key string, start double, end double").collect()
    assert [(r.key, r.start, r.end) for r in got] == [("a", 0.2, 0.4)]
    assert models.apply_model(df, models.backend("asr", "missing"), "key string, text string, language string, confidence double").count() == 2
    with pytest.raises(LookupError):
        models.backend("diarizer", "x")
    with pytest.raises(LookupError):
        models.backend("asr", "x", allow_null=False)
    raw = spark.createDataFrame([("p",)], "path string")
    bad = models.apply_model(raw, models.transcoder(["/no/such", "{source}"], "/tmp"), "path string, audio_id string, target string, seconds double, error string").first()
    assert bad.audio_id.startswith("p_") and bad.target is None and bad.error


def test_jobs(spark):
    runner = jobs.JobRunner(spark)
    done = runner.submit("count", [lambda: spark.range(5).count()] * 2)
    bad = runner.submit("bad", [lambda: 1 / 0])
    late = runner.submit("late", [lambda: time.sleep(0.2), lambda: None])
    runner.cancel(late.id)
    for _ in range(200):
        if done.state == "done" and bad.state == "failed":
            break
        time.sleep(0.1)
    assert (done.state, done.progress) == ("done", 1.0) and "division" in bad.error and late.state == "cancelled"


def test_review_session(spark):
    meta = spark.createDataFrame([("k1", "u1"), ("k2", "u2")], "key string, uri string")
    s = jobs.open_session(meta, meta, None, None)
    assert s.current().count() == 0
    assert jobs.open_session(meta, meta, None, {"metadata": s.metadata_key, "manifest": s.manifest_key})
    with pytest.raises(ValueError):
        jobs.open_session(meta.limit(1), meta, None, {"metadata": s.metadata_key, "manifest": s.manifest_key})
    old = spark.createDataFrame([("u1", None), ("u9", None), ("u2", "own")], "source_uri string, key string")
    assert {r.source_uri: r.key for r in jobs.migrate_keys(old, meta).collect()} == {"u1": "k1", "u9": None, "u2": "own"}
