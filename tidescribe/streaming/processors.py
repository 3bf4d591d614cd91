"""Structured Streaming wrappers of the cores: one keyed state per session (ST02, ST05-ST18, ST22-ST27).

State is the pickled core; inputs of a micro-batch are put in the order of their sequence
number, a `flush` row or the event-time timeout ends a session and frees its state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidescribe.streaming import cores

EVENTS = "session string, seq long, type string, id string, start double, end double, speaker string, text string, version long, previous_speaker string"
UTTERANCES = "session string, start double, end double, first_chunk long, last_chunk long"


def keyed(stream: DataFrame, key: str, make: Callable, step: Callable, end: Callable, schema: str, idle_ms: int = 1_800_000, time: str | None = None) -> DataFrame:
    """A stateful operator from a core: ``make()``, ``step(core, row) -> rows``, ``end(core) -> rows``.

    With ``time`` a session whose events stop is ended once the watermark passes it (event time);
    otherwise only its `flush` row ends it. A finite table is `replayed` with the same result.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        core = pickle.loads(state.get[0]) if state.exists else make()
        rows: list[dict] = []
        if state.hasTimedOut:
            rows = end(core)
            state.remove()
        else:
            frame = pd.concat(list(batches)).sort_values("seq", kind="stable")
            over = False
            for r in frame.to_dict("records"):
                over = over or r.get("kind") == "flush"
                rows += end(core) if r.get("kind") == "flush" else step(core, r)
            if over:
                if state.exists:
                    state.remove()
            else:
                state.update((pickle.dumps(core),))
                if time:
                    state.setTimeoutTimestamp(max(int(frame[time].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1 + idle_ms)
        if rows:
            yield pd.DataFrame([{key: k[0], **r} for r in rows], columns=columns)

    if not stream.isStreaming:
        return replayed(stream, key, make, step, end, schema)
    wait = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, schema, "core binary", "append", wait)


def replayed(df: DataFrame, key: str, make: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """ST26: the batch twin: every session replayed in order by the same core, then ended."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        core, rows = make(), []
        for r in pdf.sort_values("seq", kind="stable").to_dict("records"):
            rows += end(core) if r.get("kind") == "flush" else step(core, r)
        rows += end(core)
        return pd.DataFrame([{key: k[0], **r} for r in rows], columns=columns)

    return df.groupBy(key).applyInPandas(run, schema)


def utterances(stream: DataFrame, hold: bool = True, time: str | None = None) -> DataFrame:
    """ST02, ST18: utterances of chunk rows ``session, seq, kind, index, start, end, rms``; tiny ones held and merged."""

    def step(core: tuple, r: dict) -> list[dict]:
        cutter, tiny = core
        out = []
        for u in cutter.accept(int(r["index"]), r["start"], r["end"], r["rms"]):
            out += tiny.accept(u) if hold else [u]
        return out + (tiny.tick(r["end"]) if hold else [])

    def end(core: tuple) -> list[dict]:
        cutter, tiny = core
        return [x for u in cutter.flush() for x in (tiny.accept(u) if hold else [u])] + tiny.flush()

    return keyed(stream, "session", lambda: (cores.UtteranceCutter(), cores.TinyHold()), step, end, UTTERANCES, time=time)


def _turn_event(e: dict, seq: int) -> dict:
    t, p = e["turn"], e["previous"]
    return {"seq": seq, "type": e["type"], "id": t["id"], "start": t["start"], "end": t["end"], "speaker": t["speaker"], "text": None, "version": t["version"], "previous_speaker": p and p["speaker"]}


def timeline(stream: DataFrame, delay: float = 5.0, time: str | None = None) -> DataFrame:
    """ST05-ST07, ST25: turn events of window rows ``session, seq, kind, start, end, segments``.

    Each row brings the segments of a region; turns that end ``delay`` before the region's end are
    committed and never changed by later windows.
    """

    def step(core: cores.Timeline, r: dict) -> list[dict]:
        segments = [dict(s.asDict() if hasattr(s, "asDict") else s) for s in (r["segments"] if r["segments"] is not None else [])]
        events = core.update(r["start"], r["end"], segments) + core.commit(r["end"] - delay)
        return [_turn_event(e, int(r["seq"])) for e in events]

    return keyed(stream, "session", cores.Timeline, step, lambda core: [_turn_event(e, 2**40) for e in core.commit(float("inf"))], EVENTS, time=time)


def _segment_event(e: dict, seq: int) -> dict:
    s, p = e["segment"], e["previous"]
    return {"seq": seq, "type": e["type"], "id": s["id"], "start": s["start"], "end": s["end"], "speaker": s["speaker"], "text": s["text"], "version": s["revision"], "previous_speaker": p and p["speaker"]}


def multiplex(stream: DataFrame, keep_seconds: float | None = 3600.0, time: str | None = None) -> DataFrame:
    """ST12-ST14, ST17, ST22: transcript events of tagged rows ``session, seq, kind, id, start, end, speaker, confidence, text``.

    Kinds: asr, turn (provisional), final (committed turn), delete, correct, flush. State older than
    ``keep_seconds`` behind the row is evicted; None keeps a session's whole state, for tables that are replayed.
    """

    def step(core: cores.TranscriptMux, r: dict) -> list[dict]:
        kind = r["kind"]
        if kind == "asr":
            events = core.asr(r["start"], r["end"], r["text"])
        elif kind in ("turn", "final"):
            events = core.turn({"id": r["id"], "start": r["start"], "end": r["end"], "speaker": r["speaker"], "confidence": r["confidence"], "final": kind == "final", "version": r.get("version")})
        elif kind == "correct":
            events = core.correct(r["id"], r["text"], r["speaker"])
        else:
            core.drop_turn(r["id"])
            events = []
        if keep_seconds is not None:
            core.evict(r["end"] - keep_seconds if r["end"] == r["end"] and r["end"] is not None else 0.0)
        return [_segment_event(e, int(r["seq"])) for e in events]

    return keyed(stream, "session", cores.TranscriptMux, step, lambda core: [_segment_event(e, 2**40) for e in core.flush()], EVENTS, time=time)


def null_turns(stream: DataFrame, delay: float = 3.0) -> DataFrame:
    """ST15: unknown turns of chunk rows, committed after a delay."""
    shape = lambda t: {"seq": 0, "type": "turn.committed" if t["final"] else "turn.created", "id": t["id"], "start": t["start"], "end": t["end"], "speaker": t["speaker"], "text": None, "version": t["version"], "previous_speaker": None}
    step = lambda core, r: [shape(t) for t in core.accept(r["start"], r["end"])]
    return keyed(stream, "session", lambda: cores.NullDiarizer(delay), step, lambda core: [shape(t) for t in core.flush()], EVENTS)


def current_state(events: DataFrame) -> DataFrame:
    """ST16, ST23: newest version of every id; deleted ones leave. On a stream: complete mode."""
    newest = F.max_by(F.struct("type", "start", "end", "speaker", "text"), "version").alias("e")
    return events.groupBy("session", "id").agg(newest, F.max("version").alias("version")).select("session", "id", "version", "e.*").filter("type <> 'turn.deleted'")


def sliding_windows(chunks: DataFrame, window: float, hop: float) -> DataFrame:
    """ST03: full windows only: ``window_start, window_end, n`` of chunk rows ``session, start, end``.

    A row is copied to the windows that hold it, so the count per window is a plain aggregation.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("end") - window) / hop - 1e-9)).cast("int")
    last = F.floor(F.col("start") / hop + 1e-9).cast("int")
    rows = chunks.withColumn("w", F.explode(F.when(last >= first, F.sequence(first, last))))
    out = rows.groupBy("session", "w").agg(F.count("*").alias("n"), F.min("start").alias("lo"), F.max("end").alias("hi"))
    full = (F.col("lo") <= F.col("w") * hop + 1e-6) & (F.col("hi") >= F.col("w") * hop + window - 1e-6)
    return out.filter(full).select("session", (F.col("w") * hop).alias("window_start"), (F.col("w") * hop + window).alias("window_end"), "n")


def event_profile(events: DataFrame) -> DataFrame:
    """AG11: one row: events by kind, ids, speakers, first start and last end (D1: corrections are counted)."""
    kind = lambda s: F.count_if(F.col("type").endswith(s))
    return events.agg(
        F.count("*").alias("events"), kind(".created").alias("created"), F.count_if(F.col("type").rlike(r"\.(updated|corrected|update)$")).alias("updated"), kind(".deleted").alias("deleted"),
        F.count_if(F.col("type").rlike(r"\.(committed|final)$")).alias("final"), F.count_distinct("session", "id").alias("ids"), F.count_distinct("speaker").alias("speakers"), F.min("start").alias("first_start"), F.max("end").alias("last_end"),
    )


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """AG20: two profiles beside each other, with a verdict."""
    x, y = (d.select(*[F.col(c).alias(f"{n}_{c}") for c in d.columns]) for d, n in ((a, "a"), (b, "b")))
    verdict = F.when(F.col("a_events") + F.col("b_events") == 0, "no events").when(F.col("a_speakers") <= 1, "a knows one speaker").when(F.col("b_speakers") <= 1, "b knows one speaker").when(F.col("a_final") == 0, "a commits nothing").when(F.col("b_final") == 0, "b commits nothing").otherwise("comparable")
    return x.join(y).withColumn("verdict", verdict)
