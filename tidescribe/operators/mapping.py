"""Generations of clips, reviews and lookups (JN07-JN13, JN15-JN18, WN03-WN08, SET02-SET03, UD12)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidescribe.functions import text as tx

SAME = 1e-6
CELL = 30.0


def generation_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN07: status of every old clip in the new generation.

    Both sides: ``clip, source_key, start, end, sha``. One new clip of the same span (1e-6) with
    the same hash: unchanged; otherwise one: ambiguous; several: ambiguous; else by the number of
    overlapping clips. Rows without a usable span or source match nothing. An equi-join on
    (source, cell) with a range condition; old clips appear once, whatever the matches.
    """
    cells = lambda s, e: F.explode_outer(F.when(F.col(e) > F.col(s), F.sequence(F.floor((F.col(s) - SAME) / CELL), F.floor((F.col(e) + SAME) / CELL))))
    a = old.withColumn("_c", cells("start", "end"))
    b = new.filter("end > start").select(F.col("clip").alias("n_clip"), F.col("source_key").alias("n_source"), F.col("start").alias("n_start"), F.col("end").alias("n_end"), F.col("sha").alias("n_sha"), cells("start", "end").alias("n_c"))
    near = (F.col("n_source") == F.col("source_key")) & (F.col("n_c") == F.col("_c")) & (F.col("n_start") < F.col("end") + SAME) & (F.col("n_end") > F.col("start") - SAME)
    pairs = a.join(b, near).dropDuplicates(["clip", "n_clip"])
    exact = (F.abs(F.col("n_start") - F.col("start")) <= SAME) & (F.abs(F.col("n_end") - F.col("end")) <= SAME)
    over = (F.least("end", "n_end") - F.greatest("start", "n_start")) > 0
    found = pairs.groupBy("clip").agg(
        F.count_if(exact).alias("n_exact"), F.count_if(over).alias("n_over"), F.count_if(exact & (F.lower("sha") == F.lower("n_sha"))).alias("n_same"),
        F.min(F.when(exact, F.col("n_clip"))).alias("exact_clip"), F.min(F.when(over, F.col("n_clip"))).alias("over_clip"),
    )
    out = old.join(found, "clip", "left").fillna(0, ["n_exact", "n_over", "n_same"])
    one = (F.col("n_exact") == 1) & (F.col("n_same") == 1)
    status = F.when(one, "unchanged").when(F.col("n_exact") >= 1, "ambiguous").when(F.col("n_over") > 1, "ambiguous").otherwise("changed_boundary_needs_relabel")
    target = F.when(F.col("n_exact") == 1, F.col("exact_clip")).when((F.col("n_exact") == 0) & (F.col("n_over") == 1), F.col("over_clip"))
    return out.withColumns({"status": status, "new_clip": target}).drop("n_exact", "n_over", "n_same", "exact_clip", "over_clip")


def review_map(reviews: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """JN08: status of every review: reusable if one new clip of its source has its hash, else by `generation_map`.

    ``reviews``: ``line, file_key, sha``; ``old`` also has ``file_key``; a file key twice in old: the later clip.
    """
    mapped = generation_map(old, new)
    last = mapped.groupBy("file_key").agg(F.max_by(F.struct("source_key", "status", "new_clip"), "clip").alias("o"))
    rows = reviews.join(last, "file_key", "left")
    fresh = new.groupBy(F.col("source_key").alias("_s"), F.lower("sha").alias("_h")).agg(F.count("*").alias("k"), F.min("clip").alias("same_clip"))
    rows = rows.join(fresh, (F.col("o.source_key") == F.col("_s")) & (F.lower("sha") == F.col("_h")), "left")
    reuse = F.col("k") == 1
    status = F.when(F.col("o").isNull(), "ambiguous").when(reuse, "safely_reusable_review").when(F.col("o.status") == "ambiguous", "ambiguous").otherwise("changed_boundary_needs_relabel")
    return rows.select("line", "file_key", status.alias("status"), F.when(reuse, F.col("same_clip")).otherwise(F.col("o.new_clip")).alias("new_clip"))


def best_overlap(left: DataFrame, turns: DataFrame, key: str, row_id: str, cell: float = CELL, unknown: str = "UNKNOWN") -> DataFrame:
    """JN09: speaker of most common time, then confidence, then the earlier turn; none: ``unknown``.

    ``left``: key, row_id, start, end; ``turns``: key, turn_id, speaker, confidence, start, end.
    """
    cells = lambda: F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)))
    a = left.filter("end > start").select(key, row_id, F.col("start").alias("s"), F.col("end").alias("e"), cells().alias("_c"))
    b = turns.filter("end > start").select(key, "turn_id", "speaker", "confidence", F.col("start").alias("ts"), F.col("end").alias("te"), cells().alias("_c"))
    common = F.least("e", "te") - F.greatest("s", "ts")
    pairs = a.join(b, [key, "_c"]).withColumn("o", common).filter("o > 0")
    # The least of negated measures, so that ties go to the earlier turn; partial aggregation before the shuffle.
    rank = F.struct((-F.col("o")).alias("o"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), "ts", "turn_id")
    best = pairs.groupBy(row_id).agg(F.min_by("speaker", rank).alias("speaker"), F.max("o").alias("overlap"))
    return left.join(best, row_id, "left").withColumns({"speaker": F.coalesce("speaker", F.lit(unknown)), "overlap": F.coalesce("overlap", F.lit(0.0))})


def checked_manifest(meta: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """JN10: manifest rows with their metadata; a key twice on either side raises."""

    def single(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"twice in {side}: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_n")

    return single(manifest, "manifest").join(single(meta, "metadata"), key, "left")


def current_reviews(reviews: DataFrame, key: str = "key") -> DataFrame:
    """WN04, SRC16: the newest review of every key by the text of saved_at (trap T15); ties keep the first line."""
    order = Window.partitionBy(key).orderBy(F.desc("saved_at"), "line")
    return reviews.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """WN05, SRC12: the last row of every key; partial aggregation, no sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def with_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """JN11: rows (``key_v3, key_v2``) with their review by the newer key, else the older."""
    cur = current_reviews(reviews)
    a = cur.select(F.col("key").alias("key_v3"), F.struct("saved_at", "action", "label").alias("_a"))
    b = cur.select(F.col("key").alias("key_v2"), F.struct("saved_at", "action", "label").alias("_b"))
    return rows.join(a, "key_v3", "left").join(b, "key_v2", "left").withColumn("review", F.coalesce("_a", "_b")).drop("_a", "_b")


def import_diff(ours: DataFrame, theirs: DataFrame, known: DataFrame) -> DataFrame:
    """JN12: per key of ``theirs``: new, unchanged, conflict or unmatched (no such record)."""
    a = ours.select("key", F.struct("action", "label").alias("o"))
    b = theirs.select("key", F.struct("action", "label").alias("t"))
    k = known.select("key").distinct().withColumn("known", F.lit(True))
    rows = b.join(a, "key", "left").join(k, "key", "left")
    state = F.when(F.col("known").isNull(), "unmatched").when(F.col("o").isNull(), "new").when(F.col("o").eqNullSafe(F.col("t")), "unchanged").otherwise("conflict")
    return rows.select("key", state.alias("state"))


def import_apply(ours: DataFrame, theirs: DataFrame, known: DataFrame, policy: str = "ours") -> DataFrame:
    """JN13: upsert of ``key, action, label``; on conflict the policy's side wins; unknown keys are left out."""
    if policy not in ("ours", "theirs"):
        raise ValueError("policy is 'ours' or 'theirs'")
    t = theirs.join(known.select("key").distinct(), "key", "left_semi").select("key", F.struct("action", "label").alias("t"))
    both = ours.select("key", F.struct("action", "label").alias("o")).join(t, "key", "full_outer")
    first, second = ("o", "t") if policy == "ours" else ("t", "o")
    return both.select("key", F.coalesce(first, second).alias("r")).select("key", "r.action", "r.label")


def save_review(review: Column, original: Column) -> Column:
    """UD12: action of a saved label: accept if unchanged, reject if empty, else correct."""
    text = F.trim(F.coalesce(review, F.lit("")))
    return F.when(text == "", "reject").when(text == F.trim(F.coalesce(original, F.lit(""))), "accept").otherwise("correct")


def neighbour_context(df: DataFrame, key: str, text: str, max_gap: float = 1.5, seconds: float = 4.0) -> DataFrame:
    """JN16: ``context``: texts of the rows just before, while each gap and the seconds in sum allow.

    The first row within the gap is taken however long it is. Seconds are summed (in microseconds)
    over stretches without a longer gap, so the rows that fit are a range of that sum, of any number.
    """
    by = Window.partitionBy(key).orderBy("start", "end")
    rows = df.withColumns({"_n": F.row_number().over(by), "_gap": F.col("start") - F.lag("end").over(by)})
    rows = rows.withColumn("_d", F.coalesce(F.greatest(F.round((F.col("end") - F.col("start")) * 1_000_000).cast("long"), F.lit(0)), F.lit(0)))
    in_order = Window.partitionBy(key).orderBy("_n")
    rows = rows.withColumn("_run", F.count_if(F.col("_gap") > max_gap).over(in_order))
    run = Window.partitionBy(key, "_run")
    sums = run.orderBy("_n")
    rows = rows.withColumns({"_s": F.coalesce(F.sum("_d").over(sums.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_before": F.lag(F.struct("_n", F.coalesce(text, F.lit("")).alias("text"))).over(sums)})
    most = round(seconds * 1_000_000)
    item = F.struct("_n", "_s", "_d", F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("_p", F.collect_list(item).over(run.orderBy("_s").rangeBetween(-most, 0)))
    # Once the seconds are used up the walk ends, so a row of no length is not taken at the very edge.
    fits = lambda x: (x["_n"] < F.col("_before._n")) & ((x["_d"] > 0) | (F.col("_s") - x["_s"] < most))
    texts = F.transform(F.array_sort(F.filter("_p", fits)), lambda x: x["text"])
    context = F.when(F.col("_before").isNull(), "").otherwise(F.array_join(F.array_append(texts, F.col("_before.text")), " "))
    return rows.withColumn("context", context).drop("_n", "_gap", "_d", "_run", "_s", "_before", "_p")


def in_both(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """SET02: the values both sides have."""
    return a.select(column).intersect(b.select(column))


def assert_disjoint(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """JN17: no rows; raises if the sides have a value in common."""
    return in_both(a, b, column).filter(F.raise_error(F.concat(F.lit(f"{column} in both: "), F.col(column).cast("string"))).cast("boolean"))


def unmatched(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """SET03: rows of a without a partner in b."""
    return a.join(b.select(*on).distinct(), on, "left_anti")


def rolling_prompt(df: DataFrame, key: str, order: str, text: str, turns: int = 3, chars: int = 600) -> DataFrame:
    """WN06: the last characters of the texts of the ``turns`` rows before."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(-turns, -1)
    return df.withColumn("prompt", F.right(F.array_join(F.collect_list(F.col(text)).over(by), " "), F.lit(chars)))


def merge_short(df: DataFrame, key: str, short: float = 3.0, max_gap: float = 1.5, seconds: float = 12.0, most: int = 3) -> DataFrame:
    """WN07: ``group_no`` of greedy merges: a short row takes following rows within gap, count and seconds.

    The cursor is sequential, so a source is one group of `applyInPandas` (time-bounded recordings).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end"], kind="stable").reset_index(drop=True)
        s, e = pdf["start"].to_numpy(), pdf["end"].to_numpy()
        number, i, g = [0] * len(pdf), 0, 0
        while i < len(pdf):
            j, total = i, e[i] - s[i]
            if total <= short:
                while j + 1 < len(pdf) and j - i + 1 < most and s[j + 1] - e[j] <= max_gap and total + e[j + 1] - s[j + 1] <= seconds:
                    j += 1
                    total += e[j] - s[j]
            number[i : j + 1] = [g] * (j - i + 1)
            i, g = j + 1, g + 1
        return pdf.assign(group_no=number)

    return df.groupBy(key).applyInPandas(run, df.schema.simpleString()[7:-1] + ",group_no:long")


def carried_context(df: DataFrame, key: str, order: str, text: str, tail: int = 600, most: int = 3000) -> DataFrame:
    """WN08: ``previous_tail`` (end of the row before) and ``context`` (end of all rows before, at most ``most``).

    The frame is a range of the running sum of characters: every row in it brings the text of the
    one before, so the row that is cut at the start of the context is there too.
    """
    by = Window.partitionBy(key).orderBy(order)
    rows = df.filter(F.length(F.col(text)) > 0).withColumns({"_t": F.lag(text).over(by), "_n": F.row_number().over(by)})
    rows = rows.withColumn("_c", F.sum(F.coalesce(F.length("_t") + 1, F.lit(0)).cast("long")).over(Window.partitionBy(key).orderBy("_n")))
    near = F.collect_list(F.right("_t", F.lit(most))).over(Window.partitionBy(key).orderBy("_c").rangeBetween(-most, 0))
    return rows.withColumns({"previous_tail": F.right(F.coalesce("_t", F.lit("")), F.lit(tail)), "context": F.right(F.array_join(near, " "), F.lit(most))}).drop("_t", "_n", "_c")


def first_wins(col: Column) -> Column:
    """WN03: distinct values in order of first appearance."""
    return F.array_distinct(col)


def numbered_ids(df: DataFrame, prefix: str, key: list[str], order: list[str]) -> DataFrame:
    """WN10: ids ``prefix000000`` within a key, in order."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumn("id", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 6, "0")))


def metadata_key(row_file: Column) -> Column:
    """Key of metadata and predictions (STR22)."""
    return tx.path_key(row_file)
