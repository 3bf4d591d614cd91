"""Writers (inventory SNK01-SNK16)."""

from __future__ import annotations

import json
import os
import uuid
from collections import deque
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidescribe.functions import text as tx


def check_output(output: str, inputs: list[str]) -> str:
    """SNK16: the output path; raises if it is an input or lies in one, links resolved."""
    out = Path(os.path.realpath(output.removeprefix("file://")))
    for i in inputs:
        p = Path(os.path.realpath(i.removeprefix("file://")))
        if out == p or p in out.parents:
            raise ValueError(f"the output {output} lies in the input {i}")
    return str(out)


def publish(df: DataFrame, path: str, fmt: str = "text", overwrite: bool = False, **options) -> str:
    """Write to a staging folder beside ``path`` and rename it: readers see all or nothing.

    An existing target raises unless ``overwrite``.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, staging = hadoop.Path(path), hadoop.Path(f"{path}.staging-{uuid.uuid4().hex[:8]}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    df.write.format(fmt).options(**options).save(staging.toString())
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(staging, target):
        fs.delete(staging, True)
        raise OSError(f"cannot publish {path}")
    return path


def json_lines(df: DataFrame) -> DataFrame:
    """One column ``value`` of JSON with nulls; NaN and infinite numbers raise (trap T8)."""
    bad = F.lit(False)
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = bad | F.isnan(name) | (F.abs(F.col(name)) == float("inf"))
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.when(F.coalesce(bad, F.lit(False)), F.raise_error("a number is not finite")).otherwise(row).alias("value"))


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """SNK01, SNK06, SNK09: JSON lines, published at once."""
    return publish(json_lines(df), path, "text", overwrite)


def guarded(col: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets a quote before it."""
    return F.when(col.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)


def manifest_csv(df: DataFrame) -> DataFrame:
    """SNK02: all values as text, nested ones as JSON, formulas guarded."""
    nested = lambda t: t.startswith(("array", "struct", "map"))
    return df.select(*[(F.to_json(c, {"ignoreNullFields": "false"}) if nested(t) else guarded(F.col(c).cast("string"))).alias(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """SNK02, SNK08."""
    return publish(manifest_csv(df), path, "csv", overwrite, header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


SPANS = "array<struct<start:double,end:double>>"
#: Columns of a labelled chunk that `export_rows` reads, with their types; those that are missing count as null.
CHUNK = {
    "source_id": "string", "source_file": "string", "index": "long", "start": "double", "end": "double", "labeling_start": "double", "method": "string", "confidence": "double", "eligible": "boolean",
    "reason": "string", "evidence": "string", "text": "string", "language": "string", "speech": SPANS, "overlap": SPANS, "audio_sha256": "string", "context_before": "string", "context_after": "string",
    "context_overlap_after": "double", "alignment": "string", "alignment_eligible": "boolean", "alignment_reason": "string", "notes": "string", "timestamp_evidence": "string", "version": "string", "config_id": "string",
}


def export_rows(df: DataFrame, split: str = "train", language: str | None = None) -> DataFrame:
    """SNK04: the provenance row of every chunk (columns of CHUNK): 30 fields, times to six decimals, nested segmentation, review signals.

    A verdict of the ownership alignment replaces the chunk's eligibility and reason. Repairs of the text:
    word-wise spaced Thai, repeated connectors. Null spans count as none, a null language as ``language``.
    """
    c = {n: (F.col(n) if n in df.columns else F.lit(None)).cast(t) for n, t in CHUNK.items()}
    six = lambda x: F.round(x, 6)
    spans = lambda x: F.coalesce(x, F.array().cast(SPANS))
    rounded = lambda x: F.transform(x, lambda y: F.struct(six(y["start"]).alias("start"), six(y["end"]).alias("end")))
    length = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y["end"] - y["start"])
    speech, over = spans(c["speech"]), spans(c["overlap"])
    heard = F.coalesce(c["labeling_start"], c["start"])
    offset = F.greatest(F.lit(0.0), c["start"] - heard)
    pre_roll = offset > 1e-6
    able = F.coalesce(c["alignment_eligible"], c["eligible"], F.lit(False))
    reason = F.coalesce(F.nullif(c["alignment_reason"], F.lit("")), c["reason"])
    after = F.coalesce(c["context_overlap_after"], F.lit(0.0))
    owned = [six(c["start"]).alias("owned_source_start"), six(c["end"]).alias("owned_source_end"), six(heard).alias("labeling_audio_source_start"), six(c["end"]).alias("labeling_audio_source_end"), six(offset).alias("target_offset_seconds")]
    signals = F.array_compact(F.array(
        F.when(F.size(over) > 0, "overlapped_speech_detected"), F.when(pre_roll, "continuous_speech_fallback"), F.when(pre_roll, "labeling_preroll_context"),
        F.when(pre_roll & ~able, "owned_target_alignment_required"), F.when(after > 0, "legacy_adjacent_context_overlap"),
    ))
    text = lambda n, other: F.coalesce(F.nullif(c[n], F.lit("")), F.lit(other))
    file = F.concat(F.lit(f"{split}/"), tx.safe_name(c["source_id"]), F.lit("_"), F.lpad(c["index"].cast("string"), 5, "0"), F.lit(".wav"))
    segmentation = F.struct(
        text("version", "legacy-unknown").alias("version"), text("config_id", "legacy-unknown").alias("config_id"), F.lit(True).alias("window_is_contiguous"), rounded(speech).alias("vad_speech_intervals"),
        rounded(over).alias("overlap_intervals"), six(length(over)).alias("overlap_seconds"), six(offset).alias("context_overlap_before_seconds"), six(after).alias("context_overlap_after_seconds"),
        F.struct(*owned, F.lit("owned_audio_crop").alias("training_artifact")).alias("ownership"), F.struct(c["method"].alias("method"), six(c["confidence"]).alias("confidence"), c["evidence"].alias("evidence")).alias("boundary"),
        c["timestamp_evidence"].alias("timestamp_evidence"), c["alignment"].alias("label_alignment"), able.alias("training_eligible"), reason.alias("training_eligibility_reason"),
    )
    return df.select(
        file.alias("file_name"), tx.collapse_hesitation(tx.thai_spacing(c["text"])).alias("text"), F.coalesce(c["language"], F.lit(language)).alias("language"), F.coalesce(c["context_before"], F.lit("")).alias("context_before"),
        F.coalesce(c["context_after"], F.lit("")).alias("context_after"), c["source_file"].alias("source_file"), c["source_id"].alias("source_id"), six(c["start"]).alias("source_start"), six(c["end"]).alias("source_end"), *owned,
        six(c["end"] - c["start"]).alias("window_duration"), six(c["end"] - heard).alias("labeling_audio_duration"), six(length(speech)).alias("speech_duration"), c["audio_sha256"].alias("audio_sha256"), segmentation.alias("segmentation"),
        (F.size(over) > 0).alias("overlap_detected"), signals.alias("review_signals"), able.alias("training_eligible"), reason.alias("training_eligibility_reason"), c["alignment"].alias("ownership_alignment"), c["notes"].alias("notes"),
    )


def locked(spark, path: str):
    """SNK03: a context that holds the folder ``path + '.lock'``; a lock that is there raises, and stays."""
    from contextlib import contextmanager

    @contextmanager
    def held():
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        lock = hadoop.Path(f"{path}.lock")
        fs = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # Creating a file without overwrite is one step on every file system; creating a folder is not.
        try:
            fs.create(lock, False).close()
        except Exception as e:
            raise FileExistsError(f"another export publishes {path}") from e
        try:
            yield
        finally:
            fs.delete(lock, False)

    return held()


def copy_audio(files: DataFrame, folder: str) -> DataFrame:
    """SNK03: files (``source, target``) copied by the executors into ``folder`` on any shared file system; gives ``target, length``.

    Each goes to a temporary name first and is then renamed, so a retried task leaves whole files only; local
    paths of the workers must be on a folder they share.
    """
    import shutil
    from collections.abc import Iterator

    import pandas as pd

    root = folder.removeprefix("file://")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, target in zip(pdf["source"], pdf["target"]):
                to = Path(root) / target
                to.parent.mkdir(parents=True, exist_ok=True)
                part = to.with_name(f".{to.name}.{uuid.uuid4().hex[:8]}.tmp")
                shutil.copy2(source.removeprefix("file://").removeprefix("file:"), part)
                os.replace(part, to)
                out.append((target, to.stat().st_size))
            yield pd.DataFrame(out, columns=["target", "length"])

    return files.select("source", "target").mapInPandas(run, "target string, length long")


def export_dataset(df: DataFrame, path: str, split: str = "train") -> str:
    """SNK03: metadata lines sorted by source file and index, under a lock, published at once; a target name twice raises; no clobber.

    Where the rows have ``chunk_path`` the audio is copied beside the metadata, which is published only after it.
    """
    rows = export_rows(df, split)
    twice = rows.groupBy("file_name").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two rows have the target {twice[0].file_name}")
    spark = df.sparkSession
    with locked(spark, path):
        if "chunk_path" in df.columns:
            name = F.concat(F.lit(f"{split}/"), tx.safe_name(F.col("source_id")), F.lit("_"), F.lpad(F.col("index").cast("string"), 5, "0"), F.lit(".wav"))
            copy_audio(df.select(F.col("chunk_path").alias("source"), name.alias("target")), f"{path}.audio").write.format("noop").mode("overwrite").save()
        order = df.select(F.col("source_file").alias("_f"), F.col("index").alias("_i"), F.struct("*").alias("_r"))
        order = order.repartitionByRange("_f", "_i").sortWithinPartitions("_f", "_i").select("_r.*")
        return publish(json_lines(export_rows(order, split)), path)


def write_reviews(df: DataFrame, path: str) -> str:
    """SNK05: one JSON line per key in order of key, in one file (reviews are made by hand: few)."""
    return publish(json_lines(df.orderBy("key").coalesce(1)), path, "text", overwrite=True)


def write_report(report: dict, path: str) -> str:
    """SNK07, SNK09, SNK12: a small report as sorted JSON; an existing file is not overwritten."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
        f.write("\n")
    return path


def mapping_report(mapped: DataFrame, reviews: DataFrame | None = None) -> dict:
    """SNK07: counts by status of clips and reviews (a handful of rows)."""
    count = lambda d: {r.status: r.n for r in d.groupBy("status").agg(F.count("*").alias("n")).orderBy("status").collect()}
    return {"clips": count(mapped), "reviews": count(reviews) if reviews is not None else {}}


def stream_to(df: DataFrame, path: str, checkpoint: str, fmt: str = "json"):
    """SNK08, SNK10: events of a stream appended to a folder, exactly once."""
    return df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).start(path)


def events_over_http(df: DataFrame, post, checkpoint: str, most: int = 1000):
    """SNK10: events of a stream as newline-delimited JSON, ``post(body)`` per at most ``most`` rows, from the executors.

    At least once: a retried batch is posted again, so bodies carry their batch number.
    """
    from collections.abc import Iterator

    def write(batch: DataFrame, n: int) -> None:
        def run(rows: Iterator) -> None:
            held: list[str] = []
            for r in rows:
                held.append(r.value)
                if len(held) == most:
                    post(json.dumps({"batch": n}) + "\n" + "\n".join(held))
                    held = []
            if held:
                post(json.dumps({"batch": n}) + "\n" + "\n".join(held))

        json_lines(batch).foreachPartition(run)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def stream_upserts(df: DataFrame, key: str, version: str, path: str, checkpoint: str):
    """SNK10, ST23: the newest version of every key, as one Parquet table per micro-batch folder."""

    def write(batch: DataFrame, n: int) -> None:
        newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
        batch.withColumn("_r", newest).filter("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm."""
    ms = F.round(seconds * 1000).cast("long")
    part = lambda div, mod, n: F.lpad((F.floor(ms / div) % mod).cast("string"), n, "0")
    return F.concat(F.lpad(F.floor(ms / 3_600_000).cast("string"), 2, "0"), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit(","), part(1, 1000, 3))


def srt(df: DataFrame, key: str, speakers: bool = True) -> DataFrame:
    """SNK11: subtitle blocks per source (``start, end, text, speaker``): blank texts dropped, numbered from 1."""
    rows = df.filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    n = F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "text"))
    name = F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "))).otherwise("") if speakers else F.lit("")
    block = F.concat(n.cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), name, F.trim("text"), F.lit("\n"))
    return rows.select(key, n.alias("number"), block.alias("block"))


def crop(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """SNK13: the samples of [start, end)."""
    a = F.greatest(F.lit(0), F.round(start * rate).cast("int"))
    return F.slice(samples, a + 1, F.greatest(F.lit(0), F.round(end * rate).cast("int") - a))


def concatenated(df: DataFrame, key: str, order: str) -> DataFrame:
    """SNK14: samples of every key in order and their seconds; different rates in one key raise."""
    rows = df.groupBy(key).agg(F.min("rate").alias("rate"), F.max("rate").alias("_top"), F.array_sort(F.collect_list(F.struct(order, "samples"))).alias("p"))
    rows = rows.filter(F.when(F.col("rate") == F.col("_top"), F.lit(True)).otherwise(F.raise_error("rates differ").cast("boolean")))
    return rows.select(key, "rate", F.flatten(F.col("p.samples")).alias("samples"), F.transform("p", lambda x: F.size(x["samples"]) / F.col("rate")).alias("seconds"))


class BoundedLog:
    """SNK15: the last records of a log (a job keeps 250), fanned out to readers with bounded queues of their own.

    A reader that is slow loses the records that come while its queue is full; the writer is never blocked.
    """

    def __init__(self, most: int = 250, queue: int = 256):
        self.records, self.size, self.readers = deque(maxlen=most), queue, {}

    def subscribe(self) -> int:
        key = max(self.readers, default=0) + 1
        self.readers[key] = deque()
        return key

    def unsubscribe(self, key: int) -> None:
        self.readers.pop(key, None)

    def emit(self, record: str) -> None:
        self.records.append(record)
        for q in list(self.readers.values()):
            if len(q) < self.size:
                q.append(record)

    def read(self, key: int) -> list[str]:
        q = self.readers[key]
        return [q.popleft() for _ in range(len(q))]

    def drain(self) -> list[str]:
        out = list(self.records)
        self.records.clear()
        return out
