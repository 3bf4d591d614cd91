"""Continuous periods and gaps of overlapping intervals, at any scale.

A mergeable aggregate: its state is a sorted list of disjoint closed intervals, `merge_lists`
combines several states by one linear pass. States are built per (entity, time block, salt),
merged over salts, then stitched over blocks with a carried end (an associative maximum), so no
task ever holds all intervals of an entity: a block's list has at most `block / 2` entries
whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "array<struct<s:bigint,e:bigint>>"


def _merge(col: pa.Array) -> pa.Array:
    """Each row's list of intervals becomes sorted, disjoint and non-touching."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    n = len(col)
    counts = np.diff(col.offsets.to_numpy())
    flat = col.flatten()
    if len(flat) == 0:
        return pa.array([[]] * n, type=kind)
    s = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    e = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), counts)
    order = np.lexsort((s, row))
    s, e, row = s[order], e[order], row[order]
    low = int(s.min())
    width = int(e.max()) - low + 2
    if width * n < 2**62:  # one running maximum over all rows, each lifted above those before
        top = np.maximum.accumulate(e - low + row * width) - row * width + low
    else:
        top = e.copy()
        for i in range(1, len(top)):
            if row[i] == row[i - 1]:
                top[i] = max(top[i], top[i - 1])
    first = np.ones(len(s), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (s[1:] > top[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(s)) - 1
    sizes = np.bincount(row[at], minlength=n)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(s[at]), pa.array(top[last])], ["s", "e"])
    return pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind)


def merge_lists(col: Column) -> Column:
    """The linear merge of the aggregate's states, over a whole Arrow batch at once."""
    return F.arrow_udf(_merge, SPAN)(col)


def merge_periods(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    block: int = 600_000,
    salts: int = 16,
) -> DataFrame:
    """Rows ``keys, kind, start, end``: every longest covered stretch and every gap between two.

    ``start`` and ``end`` are whole numbers (milliseconds); touching intervals join. Rows with a
    null start or end, or ``end <= start``, are left out; a null key is an entity of its own. An
    empty table gives an empty result. Column names of ``df`` other than those named don't matter.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    rows = (
        df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
        .filter(F.col("e") > F.col("s"))
        .withColumn("b", F.floor(F.col("s") / block))
    )
    span = F.collect_list(F.struct("s", "e"))
    leaf = rows.groupBy(*k, "b", F.pmod(F.xxhash64("s", "e"), F.lit(salts)).alias("z")).agg(merge_lists_input(span))
    leaf = leaf.select(*k, "b", merge_lists(F.col("l")).alias("l"))
    node = leaf.groupBy(*k, "b").agg(F.flatten(F.collect_list("l")).alias("l"))
    node = node.select(*k, "b", merge_lists(F.col("l")).alias("l"))
    # Over blocks only (key, block) summaries are compared: the end carried in from earlier blocks.
    by = Window.partitionBy(*k).orderBy("b")
    node = node.withColumn("top", F.col("l")[F.size("l") - 1]["e"]).withColumn("carry", F.max("top").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    node = node.withColumn("fresh", F.filter("l", lambda x: F.col("carry").isNull() | (x["s"] > F.col("carry"))))
    node = node.withColumn("head", F.array_max(F.transform(F.filter("l", lambda x: x["s"] <= F.col("carry")), lambda x: x["e"])))
    node = node.withColumn("closed", F.greatest("carry", "head")).withColumn("all_end", F.max("top").over(Window.partitionBy(*k)))
    node = node.filter(F.size("fresh") > 0).withColumn("tail", F.coalesce(F.lead("closed").over(by), F.col("all_end")))
    n = F.size("fresh")
    ends = F.transform("fresh", lambda x, i: F.when(i == n - 1, F.col("tail")).otherwise(x["e"]))
    periods = F.zip_with("fresh", ends, lambda x, y: F.struct(F.lit("period").alias("kind"), x["s"].alias("s"), y.alias("e")))
    gaps = F.transform(
        "fresh",
        lambda x, i: F.struct(F.lit("gap").alias("kind"), F.when(i == 0, F.col("closed")).otherwise(F.try_element_at("fresh", i)["e"]).alias("s"), x["s"].alias("e")),
    )
    out = node.select(*k, F.explode(F.concat(periods, F.filter(gaps, lambda g: g["s"].isNotNull()))).alias("x"))
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], F.col("x.kind").alias("kind"), F.col("x.s").alias(start), F.col("x.e").alias(end))


def merge_lists_input(span: Column) -> Column:
    """The leaf's list of single intervals, as the state's type."""
    return span.cast(SPAN).alias("l")


def current_turns(df: DataFrame) -> DataFrame:
    """The current turn of each ``turn_id``: its usable row with the highest version.

    Usable: start, end and speaker not null and end ms > start ms. Exactly repeated rows count
    once; of equal versions the later arrival, then the greater values win. Null versions lose.
    """
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    rows = df.select("turn_id", "source_id", "speaker_id", ms("start_sec").alias("start_ms"), ms("end_sec").alias("end_ms"), "version", "arrived_at")
    rows = rows.filter(F.col("speaker_id").isNotNull() & (F.col("end_ms") > F.col("start_ms")))
    best = F.max(F.struct("version", "arrived_at", "source_id", "speaker_id", "start_ms", "end_ms")).alias("t")
    return rows.groupBy("turn_id").agg(best).select("turn_id", "t.source_id", "t.speaker_id", "t.start_ms", "t.end_ms")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Speaking periods and silent gaps of each source and speaker, over all current turns."""
    turns = current_turns(spark.read.parquet(f"{sf_dir}/diarization_turns.parquet"))
    return merge_periods(turns, ["source_id", "speaker_id"], "start_ms", "end_ms")


P1_SQL = """
WITH cur AS (
  SELECT turn_id, source_id, speaker_id, CAST(round(start_sec * 1000) AS BIGINT) s, CAST(round(end_sec * 1000) AS BIGINT) e,
         row_number() OVER (PARTITION BY turn_id ORDER BY version DESC NULLS LAST, arrived_at DESC NULLS LAST) r
  FROM (SELECT DISTINCT * FROM diarization_turns)
  WHERE speaker_id IS NOT NULL AND round(end_sec * 1000) > round(start_sec * 1000)),
marked AS (
  SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY source_id, speaker_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END g
  FROM cur WHERE r = 1),
isl AS (
  SELECT *, sum(g) OVER (PARTITION BY source_id, speaker_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) i FROM marked),
per AS (SELECT source_id, speaker_id, i, min(s) s, max(e) e FROM isl GROUP BY ALL)
SELECT source_id, speaker_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM per
UNION ALL
SELECT source_id, speaker_id, 'gap', e, n FROM (SELECT *, lead(s) OVER (PARTITION BY source_id, speaker_id ORDER BY s) n FROM per) WHERE n IS NOT NULL
"""
