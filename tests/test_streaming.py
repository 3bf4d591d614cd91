"""Streaming cores, and the same on a stream and in batch."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidescribe.streaming import cores, processors


def seg(start, end, speaker="a", label="L0", confidence=0.9, evidence=None):
    return {"start": start, "end": end, "speaker": speaker, "label": label, "confidence": confidence, "evidence": evidence}


def test_utterances():
    c = cores.UtteranceCutter()
    out = []
    for i, v in enumerate([0, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0, 0]):
        out += c.accept(i, i * 0.2, i * 0.2 + 0.2, 0.1 if v else 0.0)
    assert [(round(u["start"], 1), round(u["end"], 1)) for u in out] == [(0.2, 0.8)]  # the second is too short
    for i in range(50):
        out += c.accept(i, 10 + i * 0.2, 10.2 + i * 0.2, 0.1)
    assert out[1]["end"] - out[1]["start"] >= 8.0 and c.flush() and c.flush() == []


def test_tiny_hold():
    h, u = cores.TinyHold(), lambda a, b: {"start": a, "end": b, "first_chunk": 0, "last_chunk": 1}
    assert h.accept(u(0, 0.3)) == [] and [(x["start"], x["end"]) for x in h.accept(u(0.5, 2.0))] == [(0, 2.0)]
    assert h.accept(u(5, 5.3)) == [] and h.tick(5.5) == [] and h.tick(6.1)[0]["start"] == 5
    assert h.accept(u(7, 7.2)) == [] and [x["start"] for x in h.accept(u(9, 12))] == [7, 9] and h.flush() == []


def test_timeline_life_cycle():
    t = cores.Timeline()
    kinds = lambda ev: [e["type"] for e in ev]
    assert kinds(t.update(0, 5, [seg(0, 2), seg(2.02, 4), seg(4.5, 9, "b", "L1")])) == ["turn.created", "turn.created"]
    assert [(x["start"], x["end"]) for x in t.ordered()] == [(0, 4), (4.5, 5)]
    assert kinds(t.update(3, 6, [seg(4, 6, "c", "L1")])) == ["turn.corrected", "turn.deleted"]
    assert kinds(t.commit(6.0)) == ["turn.committed"] and t.commit(6.0) == []
    late = t.update(5, 8, [seg(5, 8, "z")])
    assert kinds(late) == ["turn.created"]  # the committed turn stays
    final = next(x for x in t.ordered() if x["final"])
    assert kinds(t.correct(final["id"], "q")) == ["turn.corrected"] and t.correct(final["id"], "q") == [] and t.correct("none", "q") == []


def test_mux_revisions():
    m = cores.TranscriptMux()
    turn = lambda i, s, e, sp, final: m.turn({"id": i, "start": s, "end": e, "speaker": sp, "confidence": 0.5, "final": final})
    turn("t1", 0, 2, "a", False)
    first = m.asr(0.0, 1.5, "hello")
    assert [e["type"] for e in first] == ["transcript.partial"] and first[0]["segment"]["speaker"] == "a"
    done = turn("t1", 0, 2, "b", True)
    assert [(e["type"], e["segment"]["speaker"], e["segment"]["revision"]) for e in done] == [("transcript.final", "b", 2)]
    again = turn("t1", 0, 2, "c", True)
    assert [(e["type"], e["source"], e["segment"]["revision"]) for e in again] == [("transcript.update", "diarization", 3)]
    assert turn("t1", 0, 2, "c", True) == []
    assert m.correct("seg_000000", text="bye")[0]["segment"]["revision"] == 4 and m.correct("seg_000000", text="bye") == [] and m.correct("no") == []
    m.asr(5, 6, "later")
    m.evict(4.0)
    assert [e["segment"]["speaker"] for e in m.flush()] == [cores.UNKNOWN] and m.flush() == []


def test_mux_relabels_when_a_committed_turn_moves():
    m = cores.TranscriptMux()
    turn = lambda i, s, e, sp, **more: m.turn({"id": i, "start": s, "end": e, "speaker": sp, "confidence": more.pop("c", 0.5), "final": True, **more})
    kinds = lambda events: [(e["type"], e["segment"]["speaker"]) for e in events]
    turn("t1", 0, 6, "a")
    turn("t2", 6, 10, "b", version=1)
    m.asr(4.0, 8.0, "both")
    assert kinds(turn("t2", 5, 10, "b", version=1)) == [("transcript.update", "b")]
    assert kinds(turn("t1", 0, 7.5, "a")) == [("transcript.update", "a")]
    assert turn("t2", 5, 10, "b", version=1) == []
    m.asr(20.0, 22.0, "same")
    turn("t3", 20, 22, "c", version=1)
    turn("t4", 20, 22, "d", c=0.4, version=1)
    assert kinds(turn("t4", 20, 22, "d", c=0.9, version=2)) == [("transcript.update", "d")]


def test_small_cores():
    d = cores.NullDiarizer(1.0)
    out = [x for i in range(4) for x in d.accept(i, i + 1)] + d.flush()
    assert sum(x["final"] for x in out) == 4 and sum(not x["final"] for x in out) == 4
    p = cores.PromptMemory("Spark notes", 2, 10)
    p.add("some  text with API here")
    p.add("more api, gpu api")
    assert p.terms() == ["API", "here"] and p.transcript == "gpu api"
    assert p.prompt() == "Spark notes\nTerms: API, here\nRecent transcript: gpu api"
    assert cores.PromptMemory().prompt() is None
    assert not cores.replaces("a b", "A  a a a") and not cores.replaces("Big  World", "big world") and cores.replaces("a", "b")
    heard = [{"start": 0.0, "end": 9.0, "text": "x", "words": [{"start": 1.0, "end": 2.0, "text": "before"}, {"start": 6.0, "end": 7.0, "text": "new"}, {"start": 7.0, "end": 8.0, "text": "words"}]}]
    assert cores.window_correction(6.0, 9.0, "old", lambda a, b: heard) == "new words" and cores.window_correction(0.0, 9.0, "old", lambda a, b: heard) is None
    assert cores.needs_retry(1, 2, []) and not cores.needs_retry(0, 1, []) and cores.needs_retry(1, 9, [-1.5, None]) and not cores.needs_retry(1, 9, [-0.5])
    assert cores.emit_region(10.0) == (7.0, 8.0) and cores.kept_seconds() == 12.0
    live = cores.LiveSession(lambda u: [{"start": u["start"], "end": u["end"], "text": "hi"}], cores.NullDiarizer(0.5))
    kinds = lambda events: [e["type"] for e in events]
    assert kinds(live.message({"type": "ping"})) == ["pong"] and kinds(live.message({"type": "config"})) == ["log"] and kinds(live.message({"type": "?"}, 200)) == ["log", "error"]
    got = [e for loud in (1, 1, 1, 1, 0, 0, 0, 0) for e in live.message({"type": "audio", "seconds": 0.3, "rms": 0.1 * loud})]
    assert kinds(got) == ["transcript.partial", "transcript.final"] or kinds(got) == ["transcript.partial"]
    assert kinds(live.message({"type": "flush"}))[-1:] in ([], ["transcript.final"]) and live.clock == pytest.approx(2.4)
    assert cores.rms_of([]) == 0.0 and cores.rms_of([3.0, float("nan")]) == pytest.approx(4.5**0.5)


def mux_rows(spark):
    rows = [("s1", 1, "turn", "t1", 0.0, 2.0, "a", 0.9, None), ("s1", 2, "asr", None, 0.0, 1.5, None, 0.0, "hello"), ("s1", 3, "final", "t1", 0.0, 2.0, "b", 0.9, None), ("s1", 4, "asr", None, 3.0, 4.0, None, 0.0, "tail"), ("s2", 1, "asr", None, 0.0, 1.0, None, 0.0, "alone"), ("s1", 9, "flush", None, None, None, None, None, None), ("s2", 9, "flush", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "session string, seq long, kind string, id string, start double, end double, speaker string, confidence double, text string")


def test_multiplexer_on_a_stream_equals_batch(spark, tmp_path):
    df = mux_rows(spark)
    for name, cond in (("1", "seq <= 2"), ("2", "seq > 2")):  # two files: two micro-batches
        df.filter(cond).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = processors.multiplex(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    key = lambda d: sorted((r.session, r.type, r.id, r.speaker, r.version) for r in d.collect())
    got = key(spark.read.parquet(f"{tmp_path}/out"))
    assert got == key(processors.multiplex(df))
    assert ("s1", "transcript.final", "seg_000000", "b", 2) in got and ("s2", "transcript.final", "seg_000000", "UNKNOWN", 2) in got
    now = processors.current_state(spark.read.parquet(f"{tmp_path}/out"))
    assert {(r.session, r.id, r.type) for r in now.collect()} == {("s1", "seg_000000", "transcript.final"), ("s1", "seg_000001", "transcript.final"), ("s2", "seg_000000", "transcript.final")}
    profile = processors.event_profile(spark.read.parquet(f"{tmp_path}/out"))
    assert profile.first().ids == 3 and processors.compare_profiles(profile, profile).first().verdict == "comparable"


def test_live_transcript_meets_late_rows(spark, tmp_path):
    """A segment that arrives after hours still meets its turns, and a late turn its segment."""
    from tidescribe.plans import queries

    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    turns = [("s", at(0), "t1", 0.0, 5.0, "a", True, 0.9), ("s", at(1), "t2", 9000.0, 9005.0, "b", True, 0.9), ("s", at(4), "t1", 0.0, 5.0, "c", True, 0.9)]
    spark.createDataFrame(turns, "source_id string, arrived_at timestamp_ntz, turn_id string, start_sec double, end_sec double, speaker_id string, is_final boolean, confidence double").write.parquet(f"{tmp_path}/diarization_turns.parquet")
    asr = [("s", at(2), 1, 1.0, 4.0, "late"), ("s", at(3), 2, 9001.0, 9004.0, "now")]
    spark.createDataFrame(asr, "source_id string, arrived_at timestamp_ntz, asr_id long, start_sec double, end_sec double, text string").write.parquet(f"{tmp_path}/asr_segments.parquet")
    got = [(r.type, r.text, r.speaker) for r in queries.live_transcript(spark, str(tmp_path)).orderBy("seq", "version").collect() if r.type != "transcript.partial"]
    assert got == [("transcript.final", "late", "a"), ("transcript.final", "now", "b"), ("transcript.update", "late", "c")]


def test_utterances_and_timeline_on_tables(spark):
    chunks = spark.createDataFrame([("s", i, "chunk", i, i * 0.2, i * 0.2 + 0.2, 0.1 if 2 <= i < 9 else 0.0) for i in range(15)] + [("s", 99, "flush", 0, 0.0, 0.0, 0.0)], "session string, seq long, kind string, index long, start double, end double, rms double")
    assert [(round(r.start, 1), round(r.end, 1)) for r in processors.utterances(chunks).collect()] == [(0.4, 1.8)]
    kind = "array<struct<start:double,end:double,speaker:string,label:string,confidence:double,evidence:string>>"
    windows = spark.createDataFrame([("s", 1, "window", 0.0, 5.0, [(0.0, 5.0, "a", "L", 0.9, "e1")]), ("s", 2, "window", 5.0, 12.0, [(6.0, 12.0, "b", "L", 0.9, None)]), ("s", 3, "flush", 0.0, 0.0, None)], f"session string, seq long, kind string, start double, end double, segments {kind}")
    got = [(r.type, r.speaker) for r in processors.timeline(windows).orderBy("seq").collect()]
    assert got == [("turn.created", "a"), ("turn.created", "b"), ("turn.committed", "a"), ("turn.committed", "b")]
    nulls = processors.null_turns(spark.createDataFrame([("s", i, "chunk", float(i), i + 1.0) for i in range(5)] + [("s", 9, "flush", 0.0, 0.0)], "session string, seq long, kind string, start double, end double"))
    assert nulls.groupBy("type").count().orderBy("type").collect()[0]["count"] == 5


def test_sliding_windows(spark):
    rows = spark.createDataFrame([("s", float(i), i + 1.0) for i in range(7)], "session string, start double, end double")
    got = [(r.window_start, r.n) for r in processors.sliding_windows(rows, 4, 2).orderBy("window_start").collect()]
    assert got == [(0.0, 4), (2.0, 4)]
    assert rows.select(F.col("start")).count() == 7
