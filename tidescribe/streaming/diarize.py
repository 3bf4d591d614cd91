"""The whole diarization step of a window (ST05): match, timeline, commit, evidence, metrics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from tidescribe.operators.speakers import SpeakerBook
from tidescribe.streaming import cores
from tidescribe.streaming.processors import EVENTS, _turn_event, keyed

#: Local speakers of a window: their vector, clean and overlapped seconds, and segments.
LOCALS = "array<struct<label:string,vector:array<double>,seconds:double,overlap:double,segments:array<struct<start:double,end:double>>>>"


class DiarizationSession:
    """Windows of local speakers become global turns; evidence of committed turns feeds the speaker book."""

    def __init__(self, profile: str = "balanced", book: SpeakerBook | None = None):
        self.profile, self.book, self.timeline = profile, book or SpeakerBook(), cores.Timeline()
        self.proof: dict[str, dict] = {}
        self.metrics: list[dict] = []

    def step(self, index: int, start: float, end: float, locals_: list[dict]) -> list[dict]:
        began = time.perf_counter()
        got = self.book.match([x["label"] for x in locals_], [x["vector"] for x in locals_], {x["label"]: x["seconds"] for x in locals_})
        low, high = cores.emit_region(end, self.profile)
        segments = []
        for x in locals_:
            m, key = got[x["label"]], f"{index}:{x['label']}"
            if m["decision"] == "invalid":
                continue
            self.proof[key] = {**x, "confidence": m["confidence"], "end": end}
            segments += [{"start": s["start"], "end": s["end"], "speaker": m["speaker"], "confidence": m["confidence"], "label": x["label"], "evidence": key} for s in x["segments"]]
        events = self.timeline.update(low, high, segments)
        events += self._commit(end - cores.PROFILES[self.profile][3])
        kinds = [e["type"] for e in events]
        self.metrics.append({"hop_index": index, "window_start": start, "window_end": end, "runtime_seconds": time.perf_counter() - began, "latency_seconds": end - high, "committed": kinds.count("turn.committed"), "profiles": len(self.book.profiles)})
        return events

    def _commit(self, horizon: float) -> list[dict]:
        events = self.timeline.commit(horizon)
        for e in list(events):
            for key in e["turn"]["evidence"]:
                x = self.proof.pop(key, None)
                if x is None or x["seconds"] <= 0:
                    continue
                name = self.book.commit(key, e["turn"]["speaker"], x["label"], x["vector"], x["seconds"], x["overlap"], max(x["confidence"], 0.5), x["end"])
                events += self.timeline.correct(e["turn"]["id"], name)
        return events

    def flush(self) -> list[dict]:
        return self._commit(float("inf"))


def diarize(stream: DataFrame, profile: str = "balanced", time: str | None = None) -> DataFrame:
    """ST05: turn events of window rows ``session, seq, kind, start, end, locals`` (LOCALS); tables are replayed."""

    def step(core: DiarizationSession, r: dict) -> list[dict]:
        rows = [dict(x.asDict(recursive=True) if hasattr(x, "asDict") else x) for x in (r["locals"] if r["locals"] is not None else [])]
        return [_turn_event(e, int(r["seq"])) for e in core.step(int(r["seq"]), r["start"], r["end"], rows)]

    return keyed(stream, "session", lambda: DiarizationSession(profile), step, lambda core: [_turn_event(e, 2**40) for e in core.flush()], EVENTS, time=time)
