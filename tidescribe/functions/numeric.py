"""Numbers, hashes, JSON and vectors as Columns (inventory NUM01-NUM13, HSH01-HSH05, JSN01-JSN03)."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescribe.functions.text import over_batches


def token_distance(a: list[str] | None, b: list[str] | None) -> int | None:
    """NUM01 over tokens: least insertions, deletions and replacements; null if either is null."""
    if a is None or b is None:
        return None
    code = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([code[t] for t in a], dtype=np.int64), np.array([code[t] for t in b], dtype=np.int64)
    row, step = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, t in enumerate(x, 1):
        cost = np.minimum(row[1:] + 1, row[:-1] + (y != t))
        row = np.minimum.accumulate(np.concatenate([[i], cost]) - step) + step
    return int(row[-1])


def token_edits(a: Column, b: Column) -> Column:
    """NUM01 over two arrays of tokens."""
    return over_batches(token_distance, "int")(a, b)


def error_rate(edits: Column, length: Column, strict: bool = True) -> Column:
    """NUM02: edits by length; an empty reference gives null, or counts as length 1 where not strict."""
    return F.try_divide(edits, length) if strict else edits / F.greatest(F.lit(1), length)


def to_number(col: Column) -> Column:
    """NUM03: finite double or null."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """NUM04: common seconds of two intervals, at least 0; an interval without a bound has none."""
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))).otherwise(0.0)


def duration(start: Column, end: Column) -> Column:
    """NUM04: end less start, at least 0."""
    return F.greatest(F.lit(0.0), end - start)


def six(col: Column) -> Column:
    """NUM05: rounded to six decimals, halves up."""
    return F.round(col, 6)


def rms(samples: Column) -> Column:
    """NUM06: root mean square of an array; 0 if empty."""
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(square / F.size(samples))).otherwise(0.0)


def percentile(col: Column, p: float) -> Column:
    """NUM07: interpolated percentile."""
    return F.percentile(col, p)


def nearest_rank(col: str, p: float) -> Column:
    """NUM08: the ceil(p n)-th value."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})")


def unit_vector(col: Column) -> Column:
    """NUM09: scaled to length 1; NaN and infinite parts count 0, a zero vector stays."""
    clean = F.transform(col, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), 0.0).otherwise(x.cast("double")))
    norm = F.sqrt(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.arrays_zip(clean.alias("v"), F.array_repeat(norm, F.size(clean)).alias("n")), lambda z: F.when(z["n"] > 1e-12, z["v"] / z["n"]).otherwise(z["v"]))


def cosine_distance(a: Column, b: Column) -> Column:
    """NUM10 of unit vectors: 1 less the inner product, which is kept within -1 and 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def match_confidence(distance: Column, threshold: float) -> Column:
    """NUM11: 1 - d / threshold within 0 and 1; null for a null distance."""
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / threshold)))


def resample_values(samples: list[float] | None, rate: int | None, to: int | None) -> list[float] | None:
    """NUM12: linear resampling; the same rate gives the samples as they are."""
    if samples is None or not rate or not to:
        return None
    if rate == to or not samples:
        return samples
    n = max(1, round(len(samples) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(samples)), samples).astype(np.float32).tolist()


def resample(samples: Column, rate: Column, to: Column) -> Column:
    """NUM12."""
    return over_batches(resample_values, "array<float>")(samples, rate, to)


def mono_floats(raw: bytes | None, width: int = 2, channels: int = 1) -> list[float] | None:
    """NUM13: PCM bytes to mono floats in -1..1; channels averaged, a torn last frame dropped."""
    if raw is None:
        return None
    kind, zero, scale = {1: (np.uint8, 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}[width]
    x = (np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], dtype=kind).astype(np.float64) - zero) / scale
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32).tolist()


def to_pcm16(samples: list[float] | None) -> bytes | None:
    """NUM13: floats to 16-bit PCM; NaN counts 0, values beyond 1 are clipped."""
    if samples is None:
        return None
    return (np.clip(np.nan_to_num(np.array(samples, dtype=np.float64)), -1, 1) * 32767).astype("<i2").tobytes()


def fingerprint(config: dict) -> str:
    """HSH03: first 16 hex digits of the SHA-256 of the settings as sorted compact JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()[:16]


def table_fingerprint(df: DataFrame, order: list[str], settings: dict | None = None) -> str:
    """HSH04: key of a table's rows and of settings.

    ``order`` names the columns that give the rows' order (their values are part of the hash).
    The rows' hashes are added up in the cluster as four 32-bit lanes, so no list of rows
    reaches the driver.
    """
    ordered = [*order, *[c for c in df.columns if c not in order]]
    row = F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"l{i}") for i in range(4)]
    sums = df.agg(F.count("*").alias("n"), *lanes).first()
    return hashlib.sha256(json.dumps([str(x) for x in sums] + [fingerprint(settings or {})]).encode()).hexdigest()[:20]


def file_hashes(spark, path: str, pattern: str = "*", block: int = 1 << 20) -> DataFrame:
    """HSH01, HSH02: ``path, length, sha256`` of files, in order of path; each is streamed in blocks, however long.

    Only paths are listed by Spark, which leaves out files of no length (contents are not read by it); an executor
    opens a file through Arrow's file system.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                local = name.startswith("file:")
                store, inner = (fs.LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with store.open_input_stream(inner) as f:
                    while data := f.read(block):
                        digest.update(data)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["path", "length", "sha256"])

    return files.mapInArrow(run, "path string, length long, sha256 string").orderBy("path")


def artifact_fingerprint(spark, path: str) -> str:
    """HSH05: hash over the relative paths and contents of a folder's files."""
    rows = file_hashes(spark, path).select(F.regexp_replace("path", r"^.*?//?", "/").alias("p"), "sha256").collect()
    digest = hashlib.sha256()
    root = path.rstrip("/").removeprefix("file://")
    for p, h in sorted((r.p.split(root, 1)[-1], r.sha256) for r in rows):
        digest.update(f"{p}\0{h}\n".encode())
    return digest.hexdigest()


def lenient_list(col: Column) -> Column:
    """JSN01: array of strings from a JSON list, a JSON scalar or plain text; null gives an empty one."""
    v = F.try_parse_json(col)
    as_list = F.try_variant_get(v, "$", "array<string>")
    return F.when(F.coalesce(F.trim(col), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(as_list, F.array(F.coalesce(F.try_variant_get(v, "$", "string"), col))))


def json_record(*cols: str | Column) -> Column:
    """JSN02: a row as JSON with its nulls; NaN and infinities raise."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def response_fields(col: Column) -> Column:
    """JSN03: struct of text, language and notes of a model's answer; what is no JSON is the text."""
    bare = F.regexp_replace(F.trim(col), r"^```(?:json)?\s*|\s*```$", "")
    v = F.try_parse_json(bare)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    return F.struct(F.coalesce(get("transcript_text"), get("text"), F.when(v.isNull(), F.trim(col)), F.lit("")).alias("text"), get("language").alias("language"), get("notes").alias("notes"))
