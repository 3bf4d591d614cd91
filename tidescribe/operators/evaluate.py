"""Scores of transcripts, segmentations and diarizations (NUM02, AG02, AG03, AG07, AG08, AG16-AG18, IV18, WN02, WN11)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescribe.functions import text as tx
from tidescribe.functions.numeric import error_rate, nearest_rank, token_edits
from tidescribe.operators import intervals as iv
from tidescribe.operators.assignment import optimal_assignment


def char_scores(df: DataFrame, ref: str, hyp: str, strict: bool = True) -> DataFrame:
    """NUM02 over characters: adds ``char_edits, ref_chars, cer``. Null texts count as empty."""
    a, b = F.coalesce(F.col(ref), F.lit("")), F.coalesce(F.col(hyp), F.lit(""))
    out = df.withColumns({"char_edits": F.levenshtein(a, b).cast("long"), "ref_chars": F.length(a).cast("long")})
    return out.withColumn("cer", error_rate(F.col("char_edits"), F.col("ref_chars"), strict))


def scores(df: DataFrame, ref: str, hyp: str, strict: bool = True) -> DataFrame:
    """NUM02 of evaluated texts: characters, characters without spaces and word-like tokens."""
    norm = df.withColumns({"_r": tx.evaluation_text(F.coalesce(F.col(ref), F.lit(""))), "_h": tx.evaluation_text(F.coalesce(F.col(hyp), F.lit("")))})
    out = char_scores(norm, "_r", "_h", strict)
    bare = lambda c: F.regexp_replace(c, tx.SPACE_CLASS, "")
    out = out.withColumns({"bare_edits": F.levenshtein(bare("_r"), bare("_h")).cast("long"), "bare_chars": F.length(bare("_r")).cast("long"), "_rt": tx.tokens(F.col("_r")), "_ht": tx.tokens(F.col("_h"))})
    out = out.withColumns({"token_edits": token_edits(F.col("_rt"), F.col("_ht")).cast("long"), "ref_tokens": F.size("_rt").cast("long")})
    out = out.withColumns({"cer_no_space": error_rate(F.col("bare_edits"), F.col("bare_chars"), strict), "wer": error_rate(F.col("token_edits"), F.col("ref_tokens"), strict)})
    return out.drop("_r", "_h", "_rt", "_ht")


def summary(df: DataFrame, *by: str) -> DataFrame:
    """AG02, AG03: rows, mean and micro rates per group; means skip nulls, an empty sum gives null."""
    micro = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("cer").alias("mean_cer"), micro("char_edits", "ref_chars").alias("micro_cer"),
        F.avg("wer").alias("mean_wer"), micro("token_edits", "ref_tokens").alias("micro_wer"), micro("bare_edits", "bare_chars").alias("micro_cer_no_space"),
    )


def strategy_summary(df: DataFrame, short: Column, technical: Column) -> DataFrame:
    """AG03: per strategy and subset (overall, short, technical) the summary, in one pass."""
    sets = F.array_compact(F.array(F.lit("overall"), F.when(short, "short"), F.when(technical, "technical")))
    return summary(df.withColumn("subset", F.explode(sets)), "strategy", "subset")


def has_term(text: Column) -> Column:
    """AG03: whether a text has a technical term."""
    return F.size(tx.evaluated_terms(F.coalesce(text, F.lit("")))) > 0


def failures(df: DataFrame, status: str = "status", n: int = 10) -> DataFrame:
    """AG03: the first n rows that did not go well, by line (a preview; the cap is the feature)."""
    return df.filter(F.col(status) != "ok").orderBy("line").limit(n)


def script_totals(df: DataFrame, text: str, by: str) -> DataFrame:
    """AG03: foreign script characters per group and script."""
    return df.select(by, F.explode(tx.foreign_scripts(F.coalesce(F.col(text), F.lit(""))))).groupBy(by, F.col("key").alias("script")).agg(F.sum("value").alias("n"))


def worst(df: DataFrame, score: str, index: str, n: int = 10) -> DataFrame:
    """WN02: the n worst rows; a null score ranks as -1; ties by the index as text, descending."""
    return df.orderBy(F.coalesce(F.col(score), F.lit(-1.0)).desc(), F.col(index).cast("string").desc()).limit(n)


def durations(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """AG07: count, total, mean, p50 (interpolated), p95 (nearest rank), greatest."""
    rows = df.withColumn("_d", F.greatest(F.lit(0.0), F.col(end) - F.col(start)))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("_d").alias("total"), F.avg("_d").alias("mean"), F.percentile("_d", 0.5).alias("p50"), nearest_rank("_d", 0.95).alias("p95"), F.max("_d").alias("longest")
    )


def nearest_hits(got: np.ndarray, want: np.ndarray, collar: float) -> int:
    """Matches of sorted points, each with the nearest free one (ties: the earlier) if within the collar.

    The free points left and right of a place are found by links that skip taken ones (union of runs), so a pass is near linear.
    """
    left, right = np.arange(-1, len(want) + 1), np.arange(1, len(want) + 3)  # links by index + 1

    def free(links: np.ndarray, i: int) -> int:
        root = i
        while taken[root]:
            root = links[root]
        while taken[i] and links[i] != root:
            links[i], i = root, links[i]
        return root

    taken = np.zeros(len(want) + 2, dtype=bool)  # the two ends are never taken
    hits = 0
    for p, at in zip(got, np.searchsorted(want, got)):
        a, b = free(left, int(at)), free(right, int(at) + 1)
        da = p - want[a - 1] if a >= 1 else np.inf
        db = want[b - 1] - p if b <= len(want) else np.inf
        if min(da, db) > collar:
            continue
        i = a if da <= db else b
        if da <= db:  # of equal points the first
            first = int(np.searchsorted(want, want[a - 1])) + 1
            i = free(right, first)
            i = i if i <= a and want[i - 1] == want[a - 1] else a
        taken[i] = True
        hits += 1
    return hits


def boundary_f1(segments: DataFrame, refs: DataFrame, key: str, collar: float = 0.25) -> DataFrame:
    """IV18: precision, recall and F1 of inner boundaries: greedy nearest one-to-one matches within a collar."""

    def score(k: tuple, seg: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        got, want = (np.sort(x["end"].to_numpy())[:-1] for x in (seg, ref))
        hits = nearest_hits(got, want, collar)
        p, r = (hits / len(got) if len(got) else 0.0), (hits / len(want) if len(want) else 0.0)
        return pd.DataFrame({key: [k[0]], "hits": [hits], "precision": [p], "recall": [r], "f1": [2 * p * r / (p + r) if p + r else 0.0]})

    kind = segments.schema[key].dataType.simpleString()
    a, b = iv.usable(segments).select(key, "start", "end"), iv.usable(refs).select(key, "start", "end")
    return a.groupBy(key).cogroup(b.groupBy(key)).applyInPandas(score, f"{key} {kind}, hits long, precision double, recall double, f1 double")


def scorecard(segments: DataFrame, refs: DataFrame, key: str, long: float = 25.0) -> DataFrame:
    """AG08: reference, retained, missed and duplicated seconds, chunks and long chunks per source."""
    ref = iv.union_length(refs, [key]).withColumnRenamed("seconds", "reference")
    kept = iv.intersection_length(refs, segments, [key]).withColumnRenamed("seconds", "retained")
    whole = iv.union_length(segments, [key]).withColumnRenamed("seconds", "covered")
    seg = iv.usable(segments).withColumn("_d", F.col("end") - F.col("start")).groupBy(key).agg(F.sum("_d").alias("raw"), F.count("*").alias("chunks"), F.count_if(F.col("_d") > long).alias("long_chunks"))
    out = ref.join(kept, key, "left").join(seg, key, "left").join(whole, key, "left").fillna(0)
    return out.withColumns({"missed": F.col("reference") - F.col("retained"), "duplicated": F.col("raw") - F.col("covered"), "coverage": F.try_divide("retained", "reference")}).drop("raw", "covered")


def diarization_error(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """AG16: missed, false and confused seconds and the error rate, under the best one-to-one label mapping.

    Time is cut at every boundary of either side; per stretch the error is counted by label sets.
    """
    both = ref.select(key, "start", "end", F.col("speaker").alias("label"), F.lit(0).alias("side")).unionByName(hyp.select(key, "start", "end", F.col("speaker").alias("label"), F.lit(1).alias("side")))

    def score(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.end > pdf.start]
        cuts = np.unique(np.concatenate([pdf.start, pdf.end]))
        length = np.diff(cuts)
        names = [sorted(pdf.label[pdf.side == s].unique()) for s in (0, 1)]
        on = [np.zeros((len(n), len(length)), dtype=bool) for n in names]
        for s, e, label, side in zip(pdf.start, pdf.end, pdf.label, pdf.side):
            on[side][names[side].index(label), np.searchsorted(cuts, s) : np.searchsorted(cuts, e)] = True
        pairs = optimal_assignment(-((on[0] * length) @ on[1].T.astype(float))) if names[0] and names[1] else []
        right = sum((on[0][i] & on[1][j]).astype(int) for i, j in pairs) if pairs else np.zeros(len(length), dtype=int)
        n0, n1 = on[0].sum(axis=0), on[1].sum(axis=0)
        total = float((n0 * length).sum())
        miss, extra = float((np.maximum(n0 - n1, 0) * length).sum()), float((np.maximum(n1 - n0, 0) * length).sum())
        mixed = float(((np.minimum(n0, n1) - right) * length).sum())
        return pd.DataFrame({key: [k[0]], "total": [total], "missed": [miss], "false_alarm": [extra], "confused": [mixed], "der": [(miss + extra + mixed) / total if total else None]})

    kind = ref.schema[key].dataType.simpleString()
    return both.groupBy(key).applyInPandas(score, f"{key} {kind}, total double, missed double, false_alarm double, confused double, der double")


def drift_gate(micro: DataFrame, column: str, baseline: float, most: float = 1.0) -> DataFrame:
    """AG17: the one-row summary; raises if the rate (in percent) is more than ``most`` away from the baseline."""
    off = F.abs(F.col(column) * 100 - baseline) > most
    return micro.filter(F.when(off, F.raise_error(F.lit("the rate drifted beyond the gate")).cast("boolean")).otherwise(F.lit(True)))


def gold_scores(df: DataFrame) -> DataFrame:
    """NUM02 of ``reference, hypothesis`` as the gold report counts them: normalised, characters, without spaces, words by blanks."""
    a, b = tx.normalise(F.col("reference")), tx.normalise(F.col("hypothesis"))
    rows = df.withColumns({"_r": a, "_h": b})
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    rows = char_scores(rows, "_r", "_h", strict=False).withColumnsRenamed({"char_edits": "edits", "ref_chars": "chars"})
    rows = rows.withColumns({"bare_edits": F.levenshtein(bare("_r"), bare("_h")).cast("long"), "bare_chars": F.length(bare("_r")).cast("long"), "word_edits": token_edits(words("_r"), words("_h")).cast("long"), "words": F.size(words("_r")).cast("long")})
    rate = lambda x, n: error_rate(F.col(x), F.col(n), strict=False)
    return rows.withColumns({"cer_no_space": rate("bare_edits", "bare_chars"), "wer_like": rate("word_edits", "words")}).drop("_r", "_h")


def gold_matches(gold: DataFrame, labels: DataFrame, clips: DataFrame, metadata: DataFrame) -> DataFrame:
    """JN05: every gold file (``file_name, content_sha``) with ``state``: matched, unmatched or malformed.

    The number at the end of its name (``_12.wav``) finds the label (``number, label``), its hash the training
    file (``file_name, content_sha``; of several the greatest name), that file its metadata (``file_name, text, source_file``).
    Malformed: no number, no such label, or no metadata. A matched row has ``number, train_key, reference, text, source_file``.
    """
    n = F.regexp_extract("file_name", r"_(\d+)\.wav$", 1)
    rows = gold.select("file_name", "content_sha", F.when(n != "", n.try_cast("long")).alias("number"))
    rows = rows.join(labels.select(F.col("number").cast("long").alias("number"), F.col("label").alias("reference")), "number", "left")
    held = clips.groupBy("content_sha").agg(F.max(tx.path_key_as_is(F.col("file_name"))).alias("train_key"))
    meta = metadata.filter(F.coalesce("file_name", F.lit("")) != "").groupBy(tx.path_key_as_is(F.col("file_name")).alias("train_key")).agg(F.max_by(F.struct("text", "source_file"), F.struct("line")).alias("m"))
    rows = rows.join(held, "content_sha", "left").join(meta, "train_key", "left")
    state = F.when(F.col("reference").isNull(), "malformed").when(F.col("train_key").isNull(), "unmatched").when(F.col("m").isNull(), "malformed").otherwise("matched")
    return rows.select("file_name", "number", "train_key", "reference", F.col("m.text").alias("text"), F.col("m.source_file").alias("source_file"), state.alias("state"))


def candidate_predictions(predictions: DataFrame) -> DataFrame:
    """JN06: per file the first prediction of every candidate: ``train_key, candidate, hypothesis``.

    ``file_name, model, strategy, text, line``; a candidate is the last part of the model's path and the strategy.
    """
    model = F.element_at(F.split(F.rtrim(F.translate(F.coalesce(F.nullif("model", F.lit("")), F.lit("candidate")), "\\", "/"), F.lit("/")), "/"), -1)
    name = F.concat(model, F.lit("|"), F.coalesce(F.nullif("strategy", F.lit("")), F.lit("default")))
    rows = predictions.filter("text is not null and file_name <> ''").select(tx.path_key_as_is(F.col("file_name")).alias("train_key"), name.alias("candidate"), "text", "line")
    return rows.groupBy("train_key", "candidate").agg(F.min_by("text", "line").alias("hypothesis"))


def gold_metrics(matches: DataFrame, predictions: DataFrame, n_labels: DataFrame) -> DataFrame:
    """AG18: per candidate (``original_label`` too) count, coverage of all labels, mean and micro rates.

    ``n_labels`` is the one-row table of the number of gold labels (``n``).
    """
    hit = matches.filter("state = 'matched'")
    own = hit.select(F.lit("original_label").alias("candidate"), "reference", F.coalesce("text", F.lit("")).alias("hypothesis"))
    other = hit.join(candidate_predictions(predictions), "train_key").select("candidate", "reference", "hypothesis")
    micro = lambda x, n: F.sum(x) / F.greatest(F.lit(1), F.sum(n))
    out = gold_scores(own.unionByName(other)).groupBy("candidate").agg(
        F.count("*").alias("count"), F.avg("cer").alias("mean_cer"), micro("edits", "chars").alias("micro_cer"), F.avg("cer_no_space").alias("mean_cer_no_space"),
        micro("bare_edits", "bare_chars").alias("micro_cer_no_space"), F.avg("wer_like").alias("mean_wer_like"),
    )
    return out.join(F.broadcast(n_labels.select(F.col("n").alias("_n")))).withColumn("coverage", F.col("count") / F.col("_n")).drop("_n")  # one row


def gold_report(matches: DataFrame, metadata: DataFrame, n_labels: DataFrame) -> DataFrame:
    """AG18: one row: gold labels, overlaps, unmatched and malformed files, malformed metadata, contamination, source groups."""
    count = lambda s: F.count_if(F.col("state") == s)
    hit = F.col("state") == "matched"
    groups = F.count_distinct(F.when(hit, F.coalesce("source_file", F.lit("unknown"))))
    out = matches.agg(count("matched").alias("overlaps"), count("unmatched").alias("unmatched"), count("malformed").alias("malformed"), groups.alias("source_groups"))
    bad = metadata.agg(F.count_if(F.coalesce("file_name", F.lit("")) == "").alias("malformed_metadata"))
    out = n_labels.select(F.col("n").alias("gold")).join(F.broadcast(out)).join(F.broadcast(bad))  # one row each
    return out.withColumns({"contaminated": F.col("overlaps") > 0, "split_status": F.when(F.col("source_groups") < 2, "blocked_single_group").otherwise("groups_available")})


def changed_rows(a: DataFrame, b: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """WN11: number of positions whose values differ; ``position`` is the row number within its table."""
    x, y = a.alias("x"), b.alias("y")
    same = F.col(f"x.{position}").isNotNull() & F.col(f"y.{position}").isNotNull()
    for c in columns:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return x.join(y, F.col(f"x.{position}") == F.col(f"y.{position}"), "full_outer").filter(~same).agg(F.count("*").alias("changed"))
