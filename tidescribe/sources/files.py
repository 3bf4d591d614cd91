"""Readers (inventory SRC01-SRC18)."""

from __future__ import annotations

import io
import os
import wave
from dataclasses import fields
from pathlib import Path
from typing import Any
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidescribe.functions import numeric
from tidescribe.functions import text as tx
from tidescribe.operators.mapping import current_reviews, last_per_key


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, value`` with physical line numbers from 1, for files of any size.

    Files are read by splits, line by line. A row's place is its split (file and block start) and its number
    within the split; lines of earlier splits of the file are counted once and added (one row per split is
    summed by a window), so no file is held or numbered by one task.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("id"))
    sizes = raw.groupBy("path", "at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("path", "at", "first", before.alias("before"))
    rows = raw.join(sizes, ["path", "at"])
    return rows.select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None) -> DataFrame:
    """SRC01, SRC02: records with ``line``; blank lines are skipped, a bad line raises 'path:line'.

    ``limit`` keeps the first records by path and line (a top-k, not a sort of all).
    """
    rows = numbered_lines(spark, path).filter(F.trim("value") != "")
    if limit is not None:
        rows = rows.orderBy("path", "line").limit(limit)
    v = F.try_parse_json("value")
    bad = v.isNull() | (F.schema_of_variant(v).startswith("OBJECT") == F.lit(False))
    where = F.concat(F.lit("no JSON object at "), "path", F.lit(":"), F.col("line").cast("string"))
    text = F.when(bad, F.raise_error(where)).otherwise(F.col("value"))
    return rows.select("line", F.from_json(text, schema).alias("r")).select("line", "r.*")


def has_key(value: Column, key: str) -> Column:
    """Whether a JSON object has a key at all, be it null (trap T3)."""
    return F.coalesce(F.array_contains(F.json_object_keys(value), key), F.lit(False))


def media_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("wav", "mp3", "m4a", "flac", "ogg", "opus", "aac", "mp4")) -> DataFrame:
    """SRC03: files of known suffixes in any folder, sorted; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.filter(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$")).orderBy("path")


def read_wav(content: bytes) -> tuple[list[float], int] | None:
    """SRC05: mono floats and rate of a PCM file; null if it is none."""
    try:
        with wave.open(io.BytesIO(content)) as f:
            return numeric.mono_floats(f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels()), f.getframerate()
    except (wave.Error, EOFError, KeyError):
        return None


def wav_samples(spark: SparkSession, path: str) -> DataFrame:
    """SRC05: ``path, rate, samples`` of every WAV file below a folder; files that are no PCM have nulls."""
    kind = "struct<rate:int,samples:array<float>>"

    def fn(c: bytes) -> dict | None:
        got = read_wav(c)
        return {"rate": got[1], "samples": got[0]} if got else None

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", tx.over_batches(fn, kind)("content").alias("a")).select("path", "a.rate", "a.samples")


def audio_id(path: Column) -> Column:
    """SRC04: stem and the first 12 hex digits of the path's SHA-1."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.left(F.sha1(path), F.lit(12)))


def replay_chunks(df: DataFrame, key: str, seconds: float, rate: int = 16000) -> DataFrame:
    """SRC06, ST01: samples (``rate, samples``) resampled and cut to fixed chunks with index, start and end."""
    out = df.withColumn("samples", numeric.resample(F.col("samples"), F.col("rate"), F.lit(rate)))
    n = int(round(seconds * rate))
    at = F.explode(F.when(F.size("samples") > 0, F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / n).cast("int")))).alias("index")
    out = out.select(key, "samples", at).select(key, "index", F.slice("samples", F.col("index") * n + 1, F.lit(n)).alias("samples"))
    start = F.col("index") * n / rate
    return out.select(key, "index", start.alias("start"), (start + F.size("samples") / rate).alias("end"), "samples")


def pcm_frames(stream: DataFrame, rate: int = 16000, width: int = 2) -> DataFrame:
    """SRC07: chunks of frames ``session, seq, data`` (int16-LE bytes as they come): ``session, seq, index, start, end, samples, error``.

    Index and start run on per session, over the frames that are whole samples; others are told as an error
    and take no time. Works on streams and, replayed, on tables.
    """
    from tidescribe.streaming.processors import keyed

    schema = "session string, seq long, index long, start double, end double, samples array<float>, error string"

    def step(core: dict, r: dict) -> list[dict]:
        data = r["data"]
        if data is None or len(data) == 0 or len(data) % width:
            return [{"seq": int(r["seq"]), "index": None, "start": None, "end": None, "samples": None, "error": "a frame is no whole number of samples"}]
        x = numeric.mono_floats(bytes(data), width)
        start, core["clock"] = core["clock"], core["clock"] + len(x)
        core["index"] += 1
        return [{"seq": int(r["seq"]), "index": core["index"] - 1, "start": start / rate, "end": core["clock"] / rate, "samples": x, "error": None}]

    return keyed(stream, "session", lambda: {"clock": 0, "index": 0}, step, lambda core: [], schema)


def pcm_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """SRC07: a live source: Parquet frames ``session, index, start, end, samples`` as they arrive in a folder."""
    schema = "session string, index long, start double, end double, samples array<float>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def server_capture() -> None:
    """SRC08: capture on the server is not offered."""
    raise NotImplementedError("server capture is not offered")


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """SRC09, SRC10: blocks ``#N | s-es`` with the label line after them: ``number, start, end, label``.

    The first line after a header that is neither blank nor a comment is its label.
    """
    rows = numbered_lines(spark, path)
    head = F.regexp_extract("value", r"^#(\d+)\s*\|", 1)
    rows = rows.withColumn("n", F.when(head != "", head.cast("int")))
    rows = rows.withColumn("number", F.last("n", ignorenulls=True).over(Window.partitionBy("path").orderBy("line")))
    spans = rows.filter("n is not null").select("path", "number", *[F.try_to_number(F.nullif(F.regexp_extract("value", r"\|\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*s", i), F.lit("")), F.lit("999999.999999")).cast("double").alias(c) for i, c in ((1, "start"), (2, "end"))])
    said = rows.filter("n is null and number is not null and trim(value) <> '' and not ltrim(value) like '#%'")
    said = said.groupBy("path", "number").agg(F.min_by(F.trim("value"), "line").alias("label"))
    return spans.join(said, ["path", "number"], "left").select("number", "start", "end", "label")


def reference_spans(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: spans of the headers; raises when read if there are none."""
    spans = gold_labels(spark, path).filter("end > start").select("start", "end")
    if spans.isEmpty():
        raise ValueError(f"no reference spans in {path}")
    return spans


def spelling_evidence(df: DataFrame) -> DataFrame:
    """SRC12: last record of every file_name."""
    return last_per_key(df, "file_name", "line")


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: distinct stripped lines."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''").distinct()


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: ``file, start, end, speaker`` of SPEAKER lines."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).filter("p[0] = 'SPEAKER' and size(p) >= 8")
    start, length = F.col("p")[3].cast("double"), F.col("p")[4].cast("double")
    return rows.select(F.col("p")[1].alias("file"), start.alias("start"), F.round(start + length, 6).alias("end"), F.col("p")[7].alias("speaker"))


def write_rttm(df: DataFrame, path: str) -> None:
    """SRC14: the same back, one line a turn."""
    num = lambda c: F.format_string("%.6f", c)
    line = F.concat_ws(" ", F.lit("SPEAKER"), "file", F.lit("1"), num(F.col("start")), num(F.col("end") - F.col("start")), F.lit("<NA>"), F.lit("<NA>"), "speaker", F.lit("<NA>"), F.lit("<NA>"))
    df.select(line.alias("value")).write.text(path)


REVIEW = "schema_version string, saved_at string, reviewer string, chunk struct<audio_sha256:string,start:double,end:double,source_uri:string>, human struct<action:string,label:string>"


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: newest review of every chunk; versions 2 and 3 only, others raise."""
    rows = read_jsonl(spark, path, REVIEW)
    ok = F.col("schema_version").isin("human-review-2", "human-review-3")
    rows = rows.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("review version at line "), F.col("line").cast("string"))).cast("boolean")))
    uri = F.when(F.col("schema_version") == "human-review-3", F.col("chunk.source_uri"))
    key = F.coalesce(tx.chunk_key(F.col("chunk.audio_sha256"), F.col("chunk.start"), F.col("chunk.end"), uri), F.concat_ws(":", "chunk.audio_sha256", "chunk.source_uri"))
    rows = rows.select("line", key.alias("key"), "saved_at", "reviewer", F.col("human.action").alias("action"), F.col("human.label").alias("label"))
    return current_reviews(rows)


def cached_evidence(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC17: wanted sources (``source_id, audio_sha256, settings_sha``) that the cache has, and the rest to compute."""
    on = ["source_id", "audio_sha256", "settings_sha"]
    return wanted.join(cache, on), wanted.join(cache.select(*on).distinct(), on, "left_anti")


TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def load_config(kind: type, *layers: dict[str, Any], choices: dict[str, tuple] | None = None):
    """SRC18: a frozen dataclass filled from layers of settings, later ones first; text is coerced by field type.

    ``choices`` names the values a field may have; an empty text counts as not given.
    """
    out = {}
    for f in fields(kind):
        given = [v for layer in reversed(layers) if (v := layer.get(f.name)) not in (None, "")]
        if not given:
            continue
        raw, t = given[0], str(getattr(f.type, "__name__", f.type)).split(" ")[0]
        if t == "bool" and isinstance(raw, str):
            if raw.lower() not in TRUE + FALSE:
                raise ValueError(f"{f.name} is no boolean: {raw}")
            raw = raw.lower() in TRUE
        elif t in ("int", "float", "str"):
            raw = {"int": int, "float": float, "str": str}[t](raw)
        if choices and f.name in choices and raw not in choices[f.name]:
            raise ValueError(f"{f.name} is none of {choices[f.name]}: {raw}")
        out[f.name] = raw
    return kind(**out)


def env_layer(prefix: str, environ: dict[str, str] | None = None, dotenv: str | None = None) -> dict[str, str]:
    """SRC18: settings of variables ``PREFIX_NAME`` as ``name``; those of the environment before those of a ``.env`` file."""
    out: dict[str, str] = {}
    if dotenv and os.path.exists(dotenv):
        for row in Path(dotenv).read_text(encoding="utf-8").splitlines():
            name, sep, value = row.strip().removeprefix("export ").partition("=")
            if sep and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("'\"")
    out |= dict(os.environ if environ is None else environ)
    return {k.removeprefix(f"{prefix}_").lower(): v for k, v in out.items() if k.startswith(f"{prefix}_")}


def query_layer(query: str) -> dict[str, str]:
    """SRC18: settings of a URL's query; the last of a repeated name counts."""
    return dict(parse_qsl(query.lstrip("?"), keep_blank_values=False))
