"""Small reports and ordered views (FLT14, JN18, AG12, AG14, AG15, WN01, SNK08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of the metrics of one processing hop — fixed values.
HOP_COLUMNS = [
    "hop_index", "window_start", "window_end", "runtime_seconds", "latency_seconds", "realtime_factor", "local_speakers", "matched", "ambiguous", "candidates", "new_speakers", "created", "updated", "deleted",
    "committed", "speaker_flips", "profiles", "candidate_profiles", "overlap_seconds", "speech_seconds",
]


def ordered(df: DataFrame, *columns: str, index: str = "index", by: list[str] | None = None) -> DataFrame:
    """WN01: rows numbered from 0 in a fixed order within ``by`` (or by range-partitioned sort without a number)."""
    if by:
        return df.withColumn(index, F.row_number().over(Window.partitionBy(*by).orderBy(*columns)) - 1)
    return df.orderBy(*columns)


def sample_cap(df: DataFrame, n: int, *order: str) -> DataFrame:
    """FLT14: the first n rows in a fixed order; the cap is the feature."""
    return df.orderBy(*order).limit(n)


def with_overlap(df: DataFrame, other: DataFrame, keys: list[str], cell: float = 30.0) -> DataFrame:
    """JN18: rows that have a common stretch with any row of ``other`` of their key."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)))
    a = df.filter(F.col("end") > F.col("start")).withColumn("_id", F.struct(*df.columns)).withColumn("_c", cells)
    b = other.filter(F.col("end") > F.col("start")).select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("start").alias("_s"), F.col("end").alias("_e"), cells.alias("_d"))
    on = (F.col("_c") == F.col("_d")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_o_{k}"))
    return a.join(b, on, "left_semi").select("_id").distinct().select("_id.*")


def hop_summary(df: DataFrame, *by: str) -> DataFrame:
    """AG12: hops, p50 and p95 (interpolated) of runtime and latency, in one exact pass."""
    pair = lambda c: F.percentile(c, F.array(F.lit(0.5), F.lit(0.95)))
    out = df.groupBy(*by).agg(F.count("*").alias("hops"), pair("runtime_seconds").alias("r"), pair("latency_seconds").alias("l"))
    return out.select(*by, "hops", F.col("r")[0].alias("runtime_p50"), F.col("r")[1].alias("runtime_p95"), F.col("l")[0].alias("latency_p50"), F.col("l")[1].alias("latency_p95"))


def queue_counts(df: DataFrame, disposition: str, reviewed: Column) -> DataFrame:
    """AG14: one row with the size of every filter of the review queue."""
    d = F.col(disposition)
    return df.agg(
        F.count("*").alias("all"), F.count_if(d == "review").alias("review"), F.count_if(d == "drop").alias("drop"), F.count_if(d == "correct").alias("correct"),
        F.count_if(d == "keep").alias("keep"), F.count_if(reviewed).alias("reviewed"), F.count_if(~reviewed).alias("unreviewed"),
    )


def evidence_coverage(windows: DataFrame) -> DataFrame:
    """AG15: of owned windows (``method``): share with grounded boundaries, and how many signals agree."""
    n = F.when(F.col("method").isin("continuous_speech_fallback", "source_end", "pre_roll_target_pending_alignment"), 0).otherwise(F.size(F.split("method", r"\+")))
    return windows.agg(F.count("*").alias("windows"), F.avg((n > 0).cast("double")).alias("grounded"), F.count_if(n > 1).alias("multi"), F.count_if(n == 1).alias("single"), F.count_if(n == 0).alias("none"))
