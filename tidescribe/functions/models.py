"""Plug-in slots for external models (inventory SRC04, UD03-UD07, UD09, UD14).

A model is a factory ``make() -> fn(records) -> records``; it is set up once per worker and fed
whole batches by `mapInPandas`. No model is shipped: the null and energy back ends and replay of
stored outputs need none.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[pd.DataFrame], pd.DataFrame]
_REGISTRY: dict[tuple[str, str], Callable[[], Model]] = {}


def register(kind: str, name: str, make: Callable[[], Model]) -> None:
    """Offer a back end of a kind: vad, diarizer, asr, labeller, features."""
    _REGISTRY[kind, name] = make


def backend(kind: str, *names: str, allow_null: bool = True) -> Callable[[], Model]:
    """UD14: the first of the named back ends that is registered, else the null one, else an error."""
    for n in names:
        if (kind, n) in _REGISTRY:
            return _REGISTRY[kind, n]
    if allow_null and (kind, "null") in _REGISTRY:
        return _REGISTRY[kind, "null"]
    raise LookupError(f"no back end of kind {kind} among {names}")


def apply_model(df: DataFrame, make: Callable[[], Model], schema: str) -> DataFrame:
    """UD03-UD07: rows through a model that is set up once per partition; the order within one is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def null_asr() -> Model:
    """UD06: no text, no words."""
    return lambda pdf: pd.DataFrame({"key": pdf["key"], "text": "", "language": None, "confidence": 0.0})


def null_vad() -> Model:
    """UD04: no speech found."""
    return lambda pdf: pd.DataFrame({"key": pdf["key"].iloc[:0], "start": pd.Series(dtype=float), "end": pd.Series(dtype=float)})


def energy_vad(threshold: float = 0.012, block: float = 0.1) -> Callable[[], Model]:
    """UD04: stretches of samples (``key, rate, samples``) whose blocks are loud enough."""
    import numpy as np

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, rate, samples in zip(pdf["key"], pdf["rate"], pdf["samples"]):
            x = np.nan_to_num(np.asarray(samples if samples is not None else [], dtype=np.float64))
            n = max(1, round(block * rate))
            loud = np.array([np.sqrt(np.mean(x[i : i + n] ** 2)) >= threshold for i in range(0, len(x), n)], dtype=int)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], loud, [0]])))
            out += [(key, a * n / rate, min(b * n, len(x)) / rate) for a, b in zip(edge[::2], edge[1::2])]
        return pd.DataFrame(out, columns=["key", "start", "end"])

    return lambda: model


def transcoder(command: list[str], folder: str, timeout: float = 600.0, rate: int = 16000) -> Callable[[], Model]:
    """SRC04: an external program that turns a file (``{source}`` in its command) into 16 kHz mono PCM WAV (``{target}``).

    Gives ``path, audio_id, target, seconds, error``. It writes to a temporary name in ``folder`` (shared by the
    workers) that is renamed when it is whole; a target that is there is taken as it is. Seconds are read from the
    WAV's header; a failure has its message and no target.
    """
    import hashlib
    import os
    import uuid
    import wave
    from pathlib import Path

    def convert(source: str) -> tuple:
        key = f"{Path(source).stem}_{hashlib.sha1(source.encode()).hexdigest()[:12]}"
        target = Path(folder) / f"{key}.wav"
        part = target.with_name(f".{key}.{uuid.uuid4().hex[:8]}.tmp")
        try:
            if not target.exists():
                subprocess.run([x.format(source=source, target=part, rate=rate) for x in command], capture_output=True, timeout=timeout, check=True)
                os.replace(part, target)
            with wave.open(str(target)) as f:
                return key, str(target), f.getnframes() / f.getframerate(), None
        except subprocess.CalledProcessError as e:
            return key, None, None, e.stderr.decode(errors="replace")[-500:]
        except (OSError, EOFError, wave.Error, subprocess.TimeoutExpired) as e:
            return key, None, None, str(e)
        finally:
            part.unlink(missing_ok=True)

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        plain = pdf["path"].str.removeprefix("file://").str.removeprefix("file:")
        return pd.DataFrame([(p, *convert(q)) for p, q in zip(pdf["path"], plain)], columns=["path", "audio_id", "target", "seconds", "error"])

    return lambda: model


def overlap_regions_of(turns: DataFrame, key: str, pad: float = 0.0) -> DataFrame:
    """UD05: what a diarizer's turns (``speaker, start, end``) make of overlap: stretches of two or more at once."""
    from tidescribe.operators.intervals import concurrency

    return concurrency(turns, [key], pad, 2)


#: Instruction of the audio labeller; its answer is read by `numeric.response_fields`.
LABEL_TASK = "Transcribe the audio word by word in its own languages. Answer with JSON: transcript_text, language, notes."


def labeller(ask: Callable[[str, bytes | None], str], tries: int = 2) -> Callable[[], Model]:
    """UD07: rows ``key, audio, context_before, context_after`` through ``ask(prompt, audio) -> answer``.

    The prompt names the texts around the stretch; a failing call is tried again, then the row has the error and no answer.
    """

    def one(before: str | None, after: str | None, audio: bytes | None) -> tuple[str | None, str | None]:
        told = [LABEL_TASK, *(f"{n}: {t}" for n, t in (("Before", before), ("After", after)) if t)]
        error = None
        for _ in range(tries):
            try:
                return ask("\n".join(told), audio), None
            except Exception as e:  # a model's failure belongs to its row
                error = str(e)[:500]
        return None, error

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [one(b, a, x) for b, a, x in zip(pdf["context_before"], pdf["context_after"], pdf["audio"])]
        return pd.DataFrame({"key": pdf["key"], "answer": [g[0] for g in got], "error": [g[1] for g in got]})

    return lambda: model


def frame_features(window: float = 0.025, hop: float = 0.010, bands: int = 40) -> Callable[[], Model]:
    """UD09: log energies of triangular mel bands per frame of samples (``key, rate, samples``): ``key, frames, features``.

    ``features`` are the frames' bands one after another; a row without samples has no frames.
    """
    import numpy as np

    mel = lambda f: 2595 * np.log10(1 + f / 700)

    def filters(size: int, rate: float) -> np.ndarray:
        edge = np.linspace(0, mel(rate / 2), bands + 2)
        at = mel(np.arange(size // 2 + 1) * rate / size)
        up = (at[None] - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
        down = (edge[2:, None] - at[None]) / (edge[2:] - edge[1:-1])[:, None]
        return np.clip(np.minimum(up, down), 0, None)

    def one(samples, rate: float) -> np.ndarray:
        x = np.nan_to_num(np.asarray(samples if samples is not None else [], dtype=np.float64))
        n, step = max(2, round(window * rate)), max(1, round(hop * rate))
        if len(x) < n:
            return np.zeros((0, bands))
        frames = np.lib.stride_tricks.sliding_window_view(x, n)[::step] * np.hanning(n)
        return np.log(np.maximum(np.abs(np.fft.rfft(frames)) ** 2 @ filters(n, rate).T, 1e-10))

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [one(s, r) for s, r in zip(pdf["samples"], pdf["rate"])]
        return pd.DataFrame({"key": pdf["key"], "frames": [len(g) for g in got], "features": [g.ravel().tolist() for g in got]})

    return lambda: model


register("asr", "null", null_asr)
register("vad", "null", null_vad)
register("vad", "energy", energy_vad())
register("features", "mel", frame_features())
