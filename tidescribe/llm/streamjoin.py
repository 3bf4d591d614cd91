"""Nearest-in-time join of two tables per entity, as a stateful streaming join.

Both sides become one event-time stream keyed by (entity, time block). The state of a key holds
the rows of both sides that may still meet; a left row is emitted once the watermark has passed
its horizon (its time plus the tolerance), then right rows that no later left row can reach are
evicted. A busy entity is split into blocks, right rows near an edge go to both blocks, so no key
grows with the recording. Bounded tables are replayed in time slices, each a run of the same
query on the same checkpoint, so the state holds about one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidescribe.operators.coverage import current_turns
from tidescribe.runtime import drop_path, scratch_path, written

#: Event time of millisecond 0 (any fixed instant that leaves room below it), in ms since 1970.
ORIGIN = 946_684_800_000
#: Milliseconds by which rows of a live stream may come out of order before the watermark drops them.
DELAY = 1000
STATE = "lt array<bigint>, lid array<bigint>, rt array<bigint>, rid array<string>"
OUT = "left_id bigint, right_id string, distance bigint"


def match_nearest(left: np.ndarray, right: np.ndarray, names: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each left time the index of the nearest right row (or -1) and the distance.

    Equally near: the earlier time, then the smaller name.
    """
    if not len(right) or not len(left):
        return np.full(len(left), -1), np.zeros(len(left), dtype=np.int64)
    order = np.lexsort((names, right))
    t = right[order]
    first = np.append(True, t[1:] != t[:-1])
    order, t = order[first], t[first]
    after = np.searchsorted(t, left)
    a, b = np.maximum(after - 1, 0), np.minimum(after, len(t) - 1)
    da, db = np.abs(left - t[a]), np.abs(left - t[b])
    best = np.where(da <= db, a, b)
    distance = np.minimum(da, db)
    return np.where(distance <= tolerance, order[best], -1), distance


def _step(tolerance: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [])
        lt, lid, rt = (np.array(x, dtype=np.int64) for x in held[:3])
        rid = np.array(held[3], dtype=object)
        if not state.hasTimedOut:
            for pdf in batches:
                side = pdf["is_left"].to_numpy(dtype=bool)
                t = pdf["t"].to_numpy()
                lt, lid = np.append(lt, t[side]), np.append(lid, pdf["left_id"].to_numpy()[side].astype(np.int64))
                rt, rid = np.append(rt, t[~side]), np.append(rid, pdf["right_id"].to_numpy()[~side])
        now = state.getCurrentWatermarkMs() - ORIGIN
        ripe = lt + tolerance < now
        out = pd.DataFrame()
        if ripe.any():
            at, distance = match_nearest(lt[ripe], rt, rid, tolerance)
            name = np.where(at >= 0, rid[at] if len(rid) else None, None)
            out = pd.DataFrame({"left_id": lid[ripe], "right_id": name, "distance": pd.array(np.where(at >= 0, distance, -1), dtype="int64")})
            out["distance"] = out["distance"].where(out["right_id"].notna(), None).astype("Int64")
            lt, lid = lt[~ripe], lid[~ripe]
        reach = min(int(lt.min()), now) if len(lt) else now
        keep = rt + tolerance >= reach
        rt, rid = rt[keep], rid[keep]
        if len(lt) or len(rt):
            state.update((lt.tolist(), lid.tolist(), rt.tolist(), rid.tolist()))
            horizon = int(lt.min() if len(lt) else rt.max()) + tolerance + 1
            state.setTimeoutTimestamp(max(horizon, now + 1) + ORIGIN)
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    return step


def nearest_stream(stream: DataFrame, tolerance: int, block: int) -> DataFrame:
    """The streaming join of rows ``entity, is_left, t, left_id, right_id`` (t in whole ms).

    Gives ``left_id, right_id, distance``, nulls where no right row is near enough. Works on live
    streams as on replayed ones.
    """
    cell = F.when(F.col("is_left"), F.array(F.floor(F.col("t") / block))).otherwise(
        F.array_distinct(F.array(F.floor((F.col("t") - tolerance) / block), F.floor((F.col("t") + tolerance) / block)))
    )
    rows = stream.withColumn("ts", F.timestamp_millis(F.col("t") + ORIGIN)).withColumn("cell", F.explode(cell)).withWatermark("ts", f"{DELAY} milliseconds")
    return rows.groupBy("entity", "cell").applyInPandasWithState(_step(tolerance), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def nearest_join(left: DataFrame, right: DataFrame, tolerance: int, block: int = 3_600_000, slice_rows: int = 200_000_000, file_rows: int = 1_000_000) -> DataFrame:
    """Pair each ``left`` row (entity, t, left_id) with the nearest ``right`` row (entity, t, right_id).

    Times are whole milliseconds. Left rows with a null entity or time, and such right rows, take
    no part; left ids are unique (equal rows count once); either table may be empty. The result
    has one row per left row that takes part. ``block`` must exceed twice the tolerance.

    The tables are replayed in slices of event time of about ``slice_rows`` rows, which bounds the state that all
    executors hold together; a slice is written in files of about ``file_rows`` rows, so the writers grow with the data.
    """
    spark = left.sparkSession
    one = left.select("entity", F.lit(True).alias("is_left"), "t", F.col("left_id").cast("long").alias("left_id"), F.lit(None).cast("string").alias("right_id")).distinct()
    two = right.select("entity", F.lit(False).alias("is_left"), "t", F.lit(None).cast("long").alias("left_id"), F.col("right_id").cast("string").alias("right_id"))
    rows = written(one.unionByName(two).filter("entity is not null and t is not null"), "sides")
    base = scratch_path(spark, "nearest")
    n = rows.count()
    slices, parts = -(-n // slice_rows), max(1, -(-n // file_rows))
    cuts = sorted(set(rows.agg(F.percentile_approx("t", [i / slices for i in range(1, slices)], 10 * slices).alias("q")).first().q)) if slices > 1 else []
    number = F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("t") > c)) if cuts else F.lit(0)
    schema = rows.schema
    rows.withColumn("slice", number.cast("int")).repartition(parts, "slice", "entity", F.floor(F.col("t") / block)).write.partitionBy("slice").parquet(f"{base}/all")
    end = spark.createDataFrame([("", False, 2**42, None, "")], schema)  # its event time closes every horizon
    end.coalesce(1).write.parquet(f"{base}/all/slice={len(cuts) + 1}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(f"{base}/in"))
    for i in range(len(cuts) + 2):  # the next slice in time order joins the watched folder, the query goes on
        if not fs.rename(hadoop.Path(f"{base}/all/slice={i}"), hadoop.Path(f"{base}/in/slice={i}")):
            continue  # no rows in this slice
        stream = spark.readStream.schema(schema).parquet(f"{base}/in/slice=*")
        query = (
            nearest_stream(stream, tolerance, block)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True)
            .start(f"{base}/out")
        )
        query.awaitTermination()
    drop_path(spark, f"{base}/in")
    drop_path(spark, f"{base}/state")
    return spark.read.schema(OUT).parquet(f"{base}/out")


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asr = spark.read.parquet(f"{sf_dir}/asr_segments.parquet")
    asr = asr.select(F.col("source_id").alias("entity"), F.round(F.col("start_sec") * 1000).cast("long").alias("t"), F.col("asr_id").alias("left_id"))
    turns = current_turns(spark.read.parquet(f"{sf_dir}/diarization_turns.parquet"))
    return asr, turns.select(F.col("source_id").alias("entity"), F.col("start_ms").alias("t"), F.col("turn_id").alias("right_id"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Each ASR segment with the current turn that starts nearest to it, within 500 ms."""
    found = nearest_join(*_tables(spark, sf_dir), tolerance=500)
    return found.filter("right_id is not null").select(F.col("left_id").alias("asr_id"), F.col("right_id").alias("turn_id"))


P5_SQL = """
WITH cur AS (
  SELECT source_id, turn_id, s FROM (
    SELECT turn_id, source_id, CAST(round(start_sec * 1000) AS BIGINT) s,
           row_number() OVER (PARTITION BY turn_id ORDER BY version DESC NULLS LAST, arrived_at DESC NULLS LAST) r
    FROM (SELECT DISTINCT * FROM diarization_turns)
    WHERE speaker_id IS NOT NULL AND round(end_sec * 1000) > round(start_sec * 1000)) WHERE r = 1),
seg AS (SELECT DISTINCT asr_id, source_id, CAST(round(start_sec * 1000) AS BIGINT) s FROM asr_segments WHERE start_sec IS NOT NULL)
SELECT asr_id, turn_id FROM (
  SELECT seg.asr_id, cur.turn_id, row_number() OVER (PARTITION BY seg.asr_id ORDER BY abs(cur.s - seg.s), cur.s, cur.turn_id) r
  FROM seg JOIN cur ON cur.source_id = seg.source_id AND cur.s BETWEEN seg.s - 500 AND seg.s + 500) WHERE r = 1
"""
