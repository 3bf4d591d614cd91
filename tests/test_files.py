"""Readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from tidescribe.sources import files, sinks


def test_jsonl_is_strict(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"a": 1, "b": null}\n\n  \n{"a": 2}\n', encoding="utf-8")
    got = files.read_jsonl(spark, str(good), "a int, b string").orderBy("line").collect()
    assert [(r.line, r.a) for r in got] == [(1, 1), (4, 2)]
    assert files.read_jsonl(spark, str(good), "a int", limit=1).count() == 1
    long = tmp_path / "long.jsonl"
    long.write_text("".join(f'{{"a": {i}}}\n' for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits of one file
    try:
        rows = files.read_jsonl(spark, str(long), "a int")
        assert rows.rdd.getNumPartitions() > 3 and rows.filter("line <> a + 1").count() == 0 and rows.count() == 4000
        assert [r.a for r in files.read_jsonl(spark, str(long), "a int", limit=3).collect()] == [0, 1, 2]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    bad = tmp_path / "b.jsonl"
    for text in ('{"a": 1}\n[1]\n', '{"a": 1}\n{oops\n'):
        bad.write_text(text)
        with pytest.raises(Exception, match="b.jsonl:2"):
            files.read_jsonl(spark, str(bad), "a int").collect()
    df = spark.createDataFrame([('{"a":null}',), ('{"b":1}',), ("x",)], "v string").select(files.has_key(F.col("v"), "a"))
    assert [r[0] for r in df.collect()] == [True, False, False]


def test_gold_text(spark, tmp_path):
    p = tmp_path / "gold.txt"
    p.write_text("# comment\n#000 | 48.0-55.3s\nhello there\nmore\n\n#001 | 55.6-56s\n# note\nworld\n#002 | no span\n", encoding="utf-8")
    got = {r.number: (r.start, r.end, r.label) for r in files.gold_labels(spark, str(p)).collect()}
    assert got == {0: (48.0, 55.3, "hello there"), 1: (55.6, 56.0, "world"), 2: (None, None, None)}
    assert files.reference_spans(spark, str(p)).count() == 2
    p.write_text("nothing\n")
    with pytest.raises(ValueError):
        files.reference_spans(spark, str(p))


def test_rttm_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f", 0.5, 2.25, "a")], "file string, start double, end double, speaker string")
    files.write_rttm(df, str(tmp_path / "r"))
    assert [tuple(r) for r in files.read_rttm(spark, str(tmp_path / "r")).collect()] == [("f", 0.5, 2.25, "a")]


def test_reviews_keep_the_newest(spark, tmp_path):
    sha = "b" * 64
    row = lambda at, action, version="human-review-3": json.dumps({"schema_version": version, "saved_at": at, "reviewer": "r", "chunk": {"audio_sha256": sha, "start": 0, "end": 1, "source_uri": "u"}, "human": {"action": action, "label": "x"}})
    p = tmp_path / "r.jsonl"
    p.write_text("\n".join([row("2024-01-01", "a"), row("2024-01-03", "b"), row("2024-01-02", "c"), row("2024-01-01", "d", "human-review-2")]))
    assert sorted(r.action for r in files.read_reviews(spark, str(p)).collect()) == ["b", "d"]
    p.write_text(row("2024", "a", "human-review-9"))
    with pytest.raises(Exception, match="review version"):
        files.read_reviews(spark, str(p)).collect()


def test_cache_config_and_chunks(spark):
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class C:
        a: int = 1
        b: bool = False
        c: str = "x"

    assert files.load_config(C, {"a": "2", "b": "yes"}, {"a": 3, "c": ""}) == C(3, True, "x")
    with pytest.raises(ValueError):
        files.load_config(C, {"b": "maybe"})
    want = spark.createDataFrame([("s", "h", "1"), ("t", "h", "1")], "source_id string, audio_sha256 string, settings_sha string")
    hit, miss = files.cached_evidence(want, want.filter("source_id = 's'").withColumn("words", F.lit(3)))
    assert hit.count() == 1 and miss.first().source_id == "t"
    df = spark.createDataFrame([("s", 4, [0.0, 1.0, 2.0, 3.0, 4.0])], "k string, rate int, samples array<float>")
    got = files.replay_chunks(df, "k", 0.5, 4).orderBy("index").collect()
    assert [(r.start, r.end, r.samples) for r in got] == [(0.0, 0.5, [0.0, 1.0]), (0.5, 1.0, [2.0, 3.0]), (1.0, 1.25, [4.0])]
    with pytest.raises(NotImplementedError):
        files.server_capture()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", [1, 2], 0.5, None)], "a string, b array<int>, c double, d string")
    out = sinks.write_jsonl(df, str(tmp_path / "m"))
    assert json.loads(spark.read.text(out).first()[0]) == {"a": "=1+1", "b": [1, 2], "c": 0.5, "d": None}
    with pytest.raises(FileExistsError):
        sinks.write_jsonl(df, out)
    with pytest.raises(Exception, match="not finite"):
        sinks.write_jsonl(df.withColumn("c", F.lit(float("nan"))), str(tmp_path / "n"))
    csv = spark.read.csv(sinks.write_csv(df, str(tmp_path / "c")), header=True, escape='"').first()
    assert csv.a == "'=1+1" and csv.b == "[1,2]"
    assert sinks.check_output(str(tmp_path / "new"), [str(tmp_path / "m")])
    with pytest.raises(ValueError):
        sinks.check_output(str(tmp_path / "m" / "x"), [str(tmp_path / "m")])
    report = sinks.write_report({"b": 1, "a": 2}, str(tmp_path / "r.json"))
    with pytest.raises(FileExistsError):
        sinks.write_report({}, report)


def test_export_and_subtitles(spark, tmp_path):
    row = ("s 1", "a.wav", 0, 1.23456789, 3.0, 0.5, "continuous_speech_fallback", 0.0, False, "pre_roll_alignment_required", "hi", "en", [(1.5, 2.0)])
    df = spark.createDataFrame([row], "source_id string, source_file string, index int, start double, end double, labeling_start double, method string, confidence double, eligible boolean, reason string, text string, language string, speech array<struct<start:double,end:double>>")
    got = json.loads(spark.read.text(sinks.export_dataset(df, str(tmp_path / "d"))).first()[0])
    assert got["file_name"] == "train/s_1_00000.wav" and got["source_start"] == 1.234568 and got["speech_duration"] == 0.5
    assert got["review_signals"] == ["continuous_speech_fallback", "labeling_preroll_context", "owned_target_alignment_required"] and len(got) == 25
    assert got["segmentation"]["boundary"] == {"method": "continuous_speech_fallback", "confidence": 0.0, "evidence": None} and got["target_offset_seconds"] == 0.734568
    (tmp_path / "x.wav").write_bytes(b"audio")
    (tmp_path / "d2.lock").write_text("")
    with pytest.raises(FileExistsError, match="publishes"):
        sinks.export_dataset(df, str(tmp_path / "d2"))
    sinks.export_dataset(df.withColumn("chunk_path", F.lit(str(tmp_path / "x.wav"))), str(tmp_path / "d3"))
    assert (tmp_path / "d3.audio" / "train" / "s_1_00000.wav").read_bytes() == b"audio" and not (tmp_path / "d3.lock").exists()
    with pytest.raises(ValueError, match="two rows"):
        sinks.export_dataset(df.union(df), str(tmp_path / "e"))
    subs = spark.createDataFrame([("s", 3661.5, 3662.0, "b", "x"), ("s", 0.0, 1.0, " ", "x"), ("s", 0.0, 1.0, "a", None)], "k string, start double, end double, text string, speaker string")
    assert [r.block for r in sinks.srt(subs, "k").orderBy("number").collect()] == ["1\n00:00:00,000 --> 00:00:01,000\na\n", "2\n01:01:01,500 --> 01:01:02,000\nx: b\n"]


def test_samples(spark):
    df = spark.createDataFrame([("s", 1, 4, [3.0]), ("s", 0, 4, [1.0, 2.0])], "k string, o int, rate int, samples array<float>")
    r = sinks.concatenated(df, "k", "o").first()
    assert r.samples == [1.0, 2.0, 3.0] and r.seconds == [0.5, 0.25]
    assert df.filter("o = 0").select(sinks.crop(F.col("samples"), F.col("rate"), F.lit(0.25), F.lit(9.0))).first()[0] == [2.0]
    log = sinks.BoundedLog(2)
    for x in "abc":
        log.emit(x)
    assert log.drain() == ["b", "c"] and log.drain() == []
    log = sinks.BoundedLog(9, queue=2)
    key = log.subscribe()
    for x in "abc":
        log.emit(x)
    assert log.read(key) == ["a", "b"] and log.read(key) == []
    log.unsubscribe(key)


def test_frames_features_and_hashes(spark, tmp_path):
    import hashlib

    from tidescribe.functions import models, numeric

    frames = spark.createDataFrame([("s", i, numeric.to_pcm16([0.5] * 8)) for i in range(3)] + [("s", 3, b"xyz"), ("s", 4, numeric.to_pcm16([0.1] * 8))], "session string, seq long, data binary")
    got = files.pcm_frames(frames, rate=16).orderBy("seq").collect()
    assert [(r["index"], r.start) for r in got] == [(0, 0.0), (1, 0.5), (2, 1.0), (None, None), (3, 1.5)] and got[3].error and len(got[0].samples) == 8
    (tmp_path / "a b.bin").write_bytes(b"x" * 3_000_000)
    (tmp_path / "one.bin").write_bytes(b"1")
    got = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in numeric.file_hashes(spark, str(tmp_path)).collect()}
    assert sorted(got.values()) == sorted([hashlib.sha256(b"x" * 3_000_000).hexdigest(), hashlib.sha256(b"1").hexdigest()])
    sound = spark.createDataFrame([("k", 1000, [0.1, -0.1] * 500), ("e", 1000, None)], "key string, rate int, samples array<float>")
    out = models.apply_model(sound, models.backend("features", "mel"), "key string, frames long, features array<double>").collect()
    assert {r.key: (r.frames, len(r.features)) for r in out} == {"k": (98, 98 * 40), "e": (0, 0)}
    asks = spark.createDataFrame([("k", b"1", "before", None), ("bad", None, None, None)], "key string, audio binary, context_before string, context_after string")

    def ask(prompt, audio):
        if audio is None:
            raise ValueError("no audio")
        return prompt.splitlines()[-1]

    out = models.apply_model(asks, models.labeller(ask), "key string, answer string, error string").collect()
    assert {(r.key, r.answer, r.error) for r in out} == {("k", "Before: before", None), ("bad", None, "no audio")}
    copy = models.transcoder(["cp", "{source}", "{target}"], str(tmp_path / "out"))
    (tmp_path / "out").mkdir()
    import wave

    with wave.open(str(tmp_path / "t.wav"), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(100), f.writeframes(b"\0\0" * 50)
    rows = spark.createDataFrame([(str(tmp_path / "t.wav"),), (str(tmp_path / "none.wav"),)], "path string")
    out = {r.path.rsplit("/", 1)[-1]: r for r in models.apply_model(rows, copy, "path string, audio_id string, target string, seconds double, error string").collect()}
    assert out["t.wav"].seconds == 0.5 and out["t.wav"].audio_id.startswith("t_") and out["none.wav"].error and out["none.wav"].target is None


def test_settings():
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class C:
        mode: str = "a"
        n: int = 1

    layers = files.env_layer("APP", {"APP_N": "4", "OTHER": "x"}), files.query_layer("?mode=b&n=5")
    assert files.load_config(C, *layers, choices={"mode": ("a", "b")}) == C("b", 5)
    with pytest.raises(ValueError, match="none of"):
        files.load_config(C, {"mode": "z"}, choices={"mode": ("a", "b")})
