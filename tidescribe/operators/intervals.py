"""Interval algebra on tables keyed by source (inventory IV01-IV11, IV16, IV19-IV25).

Everything is built-in. Ordered passes run over time blocks of a key: a window inside the block,
and what earlier blocks hand on (a greatest end, a sum, a last row) from a window over one
summary row per block, so a busy source is never one task. Range joins are equi-joins on time
cells (a row goes to every cell it touches, a pair is kept in the cell of its common start).
Arrays inside a row use higher-order functions. Rows with a null end or start, or without
positive length, take no part. Null keys are an entity of their own, but never range-join.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidescribe.operators.coverage import SPAN, merge_periods

#: Fixed quality of boundary signals by method (IV11).
QUALITY = {"silero_vad_gap": 1.00, "whisper_timestamp_gap": 0.80, "low_energy_gap": 0.30}


def usable(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.filter(F.col(end) > F.col(start))


def block_of(df: DataFrame, column: str) -> Column:
    """Ten-minute block of a time column: whole numbers are milliseconds, others seconds."""
    size = 600_000 if dict(df.dtypes)[column] in ("int", "bigint") else 600.0
    return F.floor(F.col(column) / size)


def with_summary(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its block's summary columns; keys match null-safely."""
    right = summary.withColumnsRenamed({k: f"_r_{k}" for k in keys} | {"_b": "_r_b"})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_b") == F.col("_r_b")])
    return df.join(right, on).drop(*[f"_r_{k}" for k in keys], "_r_b")


def earlier(keys: list[str]):
    """Window over the summaries of a key's earlier blocks."""
    return Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def numbered_groups(df: DataFrame, keys: list[str], flag: str, order: list[str]) -> DataFrame:
    """Adds ``_g``: how many rows up to this one of the key have ``flag`` 1; blocks ``_b`` follow the order."""
    # Rows that tie in the order: the flagged one comes first, as it did where it was flagged.
    inside = Window.partitionBy(*keys, "_b").orderBy(*order, F.desc(flag))
    sums = df.groupBy(*keys, "_b").agg(F.sum(flag).alias("_n"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(earlier(keys)), F.lit(0))).drop("_n")
    rows = with_summary(df, sums, keys)
    return rows.withColumn("_g", F.col("_base") + F.sum(flag).over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_base")


def reached(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Adds ``_reach``: the greatest end of all earlier rows of the key (null at the first)."""
    tops = df.groupBy(*keys, "_b").agg(F.max(end).alias("_top"))
    tops = tops.withColumn("_carry", F.max("_top").over(earlier(keys))).drop("_top")
    before = F.max(end).over(Window.partitionBy(*keys, "_b").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return with_summary(df, tops, keys).withColumn("_reach", F.greatest("_carry", before)).drop("_carry")


def scale_of(df: DataFrame, column: str) -> int:
    """Units per second-like value: whole numbers stay, others count in millionths (times have six decimals)."""
    return 1 if dict(df.dtypes)[column] in ("int", "bigint") else 1_000_000


def whole(c: Column, scale: int) -> Column:
    return c.cast("long") if scale == 1 else F.round(c * scale).cast("long")


def merge(df: DataFrame, keys: list[str], max_gap: float = 0.0, start: str = "start", end: str = "end") -> DataFrame:
    """IV01: intervals that overlap, touch or lie at most ``max_gap`` apart become one.

    By the mergeable lists of `coverage`, in one shuffle by time block.
    """
    n = scale_of(df, start)
    gap = round(max_gap * n)
    rows = usable(df, start, end).select(*keys, whole(F.col(start), n).alias("_s"), (whole(F.col(end), n) + gap).alias("_e"))
    out = merge_periods(rows, keys, "_s", "_e", block=600_000 if n == 1 else 600 * n).filter("kind = 'period'")
    back = lambda c: c if n == 1 else c / n
    return out.select(*keys, back(F.col("_s")).alias(start), back(F.col("_e") - gap).alias(end))


def merge_array(spans: Column, max_gap: float = 0.0) -> Column:
    """IV01 inside a row: array<struct<start,end>>."""
    kind = "array<struct<start:double,end:double>>"
    rows = F.array_sort(F.filter(spans.cast(kind), lambda x: x["end"] > x["start"]))

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = (F.size(acc) > 0) & (x["start"] <= last["end"] + max_gap)
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(rows, F.array().cast(kind), add)


def bridged_groups(df: DataFrame, keys: list[str], gap: float, start: str = "start", end: str = "end") -> DataFrame:
    """IV05: ``group_no`` grows where the start lies more than ``gap`` after the previous row's end."""
    rows = usable(df, start, end)
    rows = rows.withColumn("_b", block_of(rows, start))
    last = rows.groupBy(*keys, "_b").agg(F.max_by(end, F.struct(start, end)).alias("_end"))
    last = last.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_end")
    before = F.coalesce(F.lag(end).over(Window.partitionBy(*keys, "_b").orderBy(start, end)), F.col("_before"))
    rows = with_summary(rows, last, keys).withColumn("_new", F.coalesce((F.col(start) - before > gap).cast("int"), F.lit(0)))
    return numbered_groups(rows, keys, "_new", [start, end]).withColumnRenamed("_g", "group_no").drop("_new", "_before", "_b")


def with_next(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Adds ``_next``: the start of the next row of the key by start and end (null at the last), block by block."""
    rows = df.withColumn("_b", block_of(df, start))
    first = rows.groupBy(*keys, "_b").agg(F.min(start).alias("_first"))
    first = first.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_first")
    nxt = F.lead(start).over(Window.partitionBy(*keys, "_b").orderBy(start, end))
    return with_summary(rows, first, keys).withColumn("_next", F.coalesce(nxt, F.col("_after"))).drop("_after", "_b")


def gaps(df: DataFrame, keys: list[str], minimum: float, low: float | None = None, high: float | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """IV06: gaps of at least ``minimum`` between successive rows, clamped to a window if given."""
    rows = with_next(usable(df.select(*keys, start, end), start, end), keys, start, end).select(*keys, F.col(end).alias("_s"), F.col("_next").alias("_e"))
    s = F.greatest("_s", F.lit(low)) if low is not None else F.col("_s")
    e = F.least("_e", F.lit(high)) if high is not None else F.col("_e")
    return rows.filter("_e is not null").select(*keys, s.alias(start), e.alias(end)).filter(F.col(end) - F.col(start) >= minimum)


def clip(df: DataFrame, low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """IV03: clipped to bounds, empty ones dropped; a null bound does not clip."""
    return df.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)}).filter(F.col(end) > F.col(start))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float = 30.0) -> DataFrame:
    """Range join: pairs of rows of one key whose intervals have a common stretch.

    Both sides have ``keys, start, end``; columns come out prefixed l_ and r_, with ``start`` and
    ``end`` of the common stretch. Cells split busy keys; long intervals cost one row per cell.
    """
    cells = F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)))
    a = usable(left).select(*keys, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys], cells.alias("_c"))
    b = usable(right).select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys], cells.alias("_c"))
    both = a.join(b, [*keys, "_c"]).withColumns({"start": F.greatest("l_start", "r_start"), "end": F.least("l_end", "r_end")})
    return both.filter((F.col("end") > F.col("start")) & (F.floor(F.col("start") / cell) == F.col("_c"))).drop("_c")


def subtract(speech: DataFrame, dirty: DataFrame, keys: list[str], cell: float = 30.0) -> DataFrame:
    """IV02: the parts of merged ``speech`` that no interval of ``dirty`` covers; the cell is in the times' unit."""
    a = merge(speech, keys).withColumnsRenamed({"start": "a", "end": "z"})
    cuts = overlap_join(a.withColumns({"start": F.col("a"), "end": F.col("z")}), merge(dirty, keys), keys, cell).select(*keys, F.col("l_a").alias("a"), F.col("l_z").alias("z"), "start", "end")
    by = Window.partitionBy(*keys, "a", "z").orderBy("start")
    before = cuts.select(*keys, "a", "z", F.coalesce(F.lag("end").over(by), F.col("a")).alias("s"), F.col("start").alias("e"))
    after = cuts.groupBy(*keys, "a", "z").agg(F.max("end").alias("s")).select(*keys, "a", "z", "s", F.col("z").alias("e"))
    whole = a.join(cuts.select(*keys, "a", "z").distinct(), [*keys, "a", "z"], "left_anti").select(*keys, "a", "z", F.col("a").alias("s"), F.col("z").alias("e"))
    out = reduce(DataFrame.unionByName, [before, after, whole])
    return out.filter("e > s").select(*keys, F.col("s").alias("start"), F.col("e").alias("end"))


def union_length(df: DataFrame, keys: list[str]) -> DataFrame:
    """IV07: seconds covered per key."""
    return merge(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


def intersection_length(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """IV08: seconds covered by both sides per key, each side counted once.

    Both sides are merged first, so their common stretches cannot overlap each other.
    """
    cell = 30.0 if scale_of(left, "start") > 1 else 30_000
    both = overlap_join(merge(left, keys), merge(right, keys), keys, cell)
    return both.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


def _busy(least: int):
    """Arrow function: sorted steps of a block, the count before it and the next block's first time to busy spans."""

    def run(times: pa.Array, steps: pa.Array, base: pa.Array, after: pa.Array) -> pa.Array:
        times, steps, base, after = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (times, steps, base, after))
        size = np.diff(times.offsets.to_numpy())
        t, d = times.flatten().to_numpy(), steps.flatten().to_numpy()
        row = np.repeat(np.arange(len(times)), size)
        end = np.cumsum(size)
        total = np.cumsum(d)
        begin = np.concatenate([[0], total])[end - size]
        active = total - begin[row] + base.to_numpy()[row]
        nxt = np.append(t[1:], 0)
        last = after.fill_null(-(2**62)).to_numpy(zero_copy_only=False)
        nxt[end[size > 0] - 1] = last[size > 0]
        hot = (active >= least) & (nxt > t)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[hot], minlength=len(times)))]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(t[hot]), pa.array(nxt[hot])], ["s", "e"])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return F.arrow_udf(run, SPAN)


def concurrency(df: DataFrame, keys: list[str], pad: float = 0.0, least: int = 2) -> DataFrame:
    """IV09: regions where ``least`` or more intervals run at once, padded and merged (sweep line).

    Starts and ends are summed per instant; a block holds at most one step per instant, and what
    runs at its start comes from the sums of earlier blocks.
    """
    n = scale_of(df, "start")
    rows = usable(df).select(*keys, whole(F.col("start"), n).alias("s"), whole(F.col("end"), n).alias("e"))
    events = rows.select(*keys, F.inline(F.array(F.struct(F.col("s").alias("t"), F.lit(1).cast("long").alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).cast("long").alias("d")))))
    events = events.groupBy(*keys, "t").agg(F.sum("d").alias("d")).withColumn("_b", F.floor(F.col("t") / (600_000 if n == 1 else 600 * n)))
    block = events.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("t", "d"))).alias("x"), F.sum("d").alias("_d"), F.min("t").alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_b")
    block = block.withColumns({"_base": F.coalesce(F.sum("_d").over(earlier(keys)), F.lit(0)), "_next": F.lead("_first").over(over)})
    hot = block.select(*keys, F.inline(_busy(least)(F.col("x.t"), F.col("x.d"), F.col("_base"), F.col("_next"))))
    back = (lambda c, by: c + round(by)) if n == 1 else (lambda c, by: c / n + by)
    return merge(hot.select(*keys, back(F.col("s"), -pad).alias("start"), back(F.col("e"), pad).alias("end")), keys)


def low_energy_islands(blocks: DataFrame, keys: list[str], share: float = 0.2, flat: float = 1.2, shortest: float = 0.12) -> DataFrame:
    """IV10: runs of blocks (``start, end, rms``) at or under the ``share`` percentile of their key.

    A key whose median is below ``flat`` times that floor is flat: no islands.
    """
    floor = blocks.groupBy(*keys).agg(F.percentile("rms", share).alias("floor"), F.percentile("rms", 0.5).alias("mid"))
    # A run ends where a loud block follows, so it is found by the number of loud blocks before: a running count by time block.
    quiet = (F.col("rms") <= F.col("floor")) & (F.col("mid") > F.col("floor") * flat)
    rows = blocks.join(floor, keys).withColumns({"_b": block_of(blocks, "start"), "_loud": F.coalesce((~quiet).cast("int"), F.lit(1))})
    rows = numbered_groups(rows, keys, "_loud", ["start"]).filter("_loud = 0")
    return rows.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g").filter(F.col("end") - F.col("start") >= shortest)


def boundary_signals(vad: DataFrame, words: DataFrame, energy: DataFrame, keys: list[str], min_silence: float = 0.5, min_word_gap: float = 0.12) -> DataFrame:
    """IV11, SET01: gaps of speech, gaps between words and quiet islands with their fixed quality."""
    parts = [(gaps(vad, keys, min_silence), "silero_vad_gap"), (gaps(words, keys, min_word_gap), "whisper_timestamp_gap"), (energy.select(*keys, "start", "end"), "low_energy_gap")]
    tagged = [d.withColumns({"method": F.lit(m), "quality": F.lit(QUALITY[m])}) for d, m in parts]
    return reduce(DataFrame.unionByName, tagged)


def words_inside(words: Column, start: Column, end: Column) -> Column:
    """IV16: words wholly inside an interval; those across an edge are left out."""
    return F.filter(words, lambda w: (w["start"] >= start) & (w["end"] <= end))


def straddling(words: Column, *edges: Column) -> Column:
    """Words that cross one of the edges."""
    crosses = lambda w: reduce(lambda a, b: a | b, [(w["start"] < e) & (w["end"] > e) for e in edges])
    return F.filter(words, crosses)


def clip_segment(words: Column, text: Column, start: Column, end: Column) -> Column:
    """IV22: words clipped to a window and the text rebuilt from the words kept (the text if there are none)."""
    kept = F.filter(words, lambda w: (w["end"] > start) & (w["start"] < end))
    clipped = F.transform(kept, lambda w: F.struct(F.greatest(w["start"], start).alias("start"), F.least(w["end"], end).alias("end"), w["text"].alias("text")))
    rebuilt = F.trim(F.array_join(F.transform(kept, lambda w: w["text"]), ""))
    return F.struct(clipped.alias("words"), F.when(F.size(words) > 0, rebuilt).otherwise(text).alias("text"))


def risky_boundaries(segments: DataFrame, refs: DataFrame, keys: list[str], collar: float = 0.25) -> DataFrame:
    """IV19: inner ends of segments that fall strictly inside a reference less its collar."""
    points = with_next(usable(segments), keys).filter("_next is not null").select(*keys, F.col("end").alias("point")).withColumn("_c", F.floor(F.col("point") / 30))
    inner = usable(refs).select(*keys, (F.col("start") + collar).alias("s"), (F.col("end") - collar).alias("e")).filter("e > s")
    inner = inner.withColumn("_c", F.explode(F.sequence(F.floor(F.col("s") / 30), F.floor(F.col("e") / 30))))
    hit = inner.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumnRenamed("_c", "_d")
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_c") == F.col("_d"), F.col("point") > F.col("s"), F.col("point") < F.col("e")])
    return points.join(hit, on, "left_semi").drop("_c")


def speaker_runs(df: DataFrame, source: str, speaker: str, within: float = 1.0) -> DataFrame:
    """IV20: runs of one speaker at most ``within`` apart, and rows of silence (speaker null) between."""
    rows = usable(df).select(source, speaker, "start", "end")
    rows = reached(rows.withColumn("_b", block_of(rows, "start")), [source], "start", "end")
    last = rows.groupBy(source, "_b").agg(F.max_by(speaker, F.struct("start", "end", speaker)).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(source).orderBy("_b"))).drop("_last")
    order = ["start", "end", speaker]
    said = F.coalesce(F.lag(speaker).over(Window.partitionBy(source, "_b").orderBy(*order)), F.col("_before"))
    new = (said != F.col(speaker)) | (F.col("start") > F.col("_reach") + within)
    rows = with_summary(rows, last, [source]).withColumn("_n", F.coalesce(new.cast("int"), F.lit(0)))
    rows = numbered_groups(rows, [source], "_n", order)
    runs = rows.groupBy(source, "_g").agg(F.first(speaker).alias(speaker), F.min("start").alias("start"), F.max("end").alias("end"))
    # Runs per source are few against its turns; the silences lie where the reach of all before ends.
    over = Window.partitionBy(source).orderBy("_g")
    reach = F.max("end").over(over.rowsBetween(Window.unboundedPreceding, 0))
    quiet = runs.select(source, F.lit(None).cast("string").alias(speaker), reach.alias("start"), F.lead("start").over(over).alias("end")).filter("end > start")
    return runs.select(source, speaker, "start", "end").unionByName(quiet)


def filled_slice(chunks: DataFrame, keys: list[str], start: float, end: float, rate: int) -> DataFrame:
    """IV21: samples of [start, end) from chunks (``start, samples``), silence where there are none."""
    n = round((end - start) * rate)
    at = F.round((F.col("start") - start) * rate).cast("int")
    rows = chunks.select(*keys, F.posexplode("samples").alias("i", "x"), at.alias("at")).withColumn("i", F.col("at") + F.col("i")).filter(f"i >= 0 and i < {n}")
    rows = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    return rows.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0).cast("float"))).alias("samples"))


def seconds_by_label(df: DataFrame, keys: list[str]) -> DataFrame:
    """IV23: seconds per label."""
    return df.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("seconds"))


def shift(df: DataFrame, offset: Column, keys: list[str]) -> DataFrame:
    """IV24: moved by an offset, empty ones dropped, with a track number within the key."""
    out = df.withColumns({"start": F.col("start") + offset, "end": F.col("end") + offset})
    return usable(out).withColumn("track", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")))


def truncate(df: DataFrame, seconds: float) -> DataFrame:
    """IV25: only the first seconds of every source; 0 keeps all."""
    return clip(df, F.lit(0.0), F.lit(seconds)) if seconds > 0 else df
