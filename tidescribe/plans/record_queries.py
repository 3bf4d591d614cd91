"""Queries over records: predicates, lookups, reviews, intervals, order, events and files, with their SQL.

Those of readers and writers put a whole table through a file format and back (an exact round trip).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescribe.functions import numeric as nu
from tidescribe.functions import text as tx
from tidescribe.operators import evaluate, mapping, planner, quality, reports, selection, speakers
from tidescribe.operators import intervals as iv
from tidescribe.plans.oracles import ASR, CUR, islands
from tidescribe.plans.queries import asr, ms, turns
from tidescribe.plans.text_queries import chunks, clips, proposals
from tidescribe.runtime import scratch_path, table
from tidescribe.sources import files, sinks
from tidescribe.streaming import processors

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None):
    """Registers a query with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


C, P, K = "c AS (SELECT DISTINCT * FROM clips_metadata)", "p AS (SELECT DISTINCT * FROM proposed_labels)", "q AS (SELECT DISTINCT * FROM labeled_chunks)"
PLAIN = "trim(regexp_replace(coalesce({}, ''), '[ \\t\\n\\r]+', ' ', 'g'))"


def seconds(df: DataFrame) -> DataFrame:
    return df.withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})


def named_asr(spark, d):
    """One row per asr_id: the segments as they stand in the table."""
    rows = table(spark, d, "asr_segments").filter("end_sec > start_sec").dropDuplicates(["asr_id"])
    word = lambda w: F.struct(w["start_sec"].alias("start"), w["end_sec"].alias("end"), w["word"].alias("text"), w["probability"].alias("p"))
    return rows.select("asr_id", "source_id", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "text", "confidence", F.coalesce(F.transform("words", word), F.array().cast("array<struct<start:double,end:double,text:string,p:double>>")).alias("words"))


NA = "n AS (SELECT asr_id, any_value(source_id) source_id, any_value(start_sec) s, any_value(end_sec) e, any_value(text) t, any_value(confidence) cf, coalesce(any_value(words), []) w FROM asr_segments WHERE end_sec > start_sec GROUP BY 1)"


# --- predicates


@query(f"WITH {C} SELECT CASE WHEN contains(replace(file_name, chr(92), '/'), '/') THEN split_part(replace(file_name, chr(92), '/'), '/', 1) ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (WHERE training_eligible) AS eligible FROM c WHERE coalesce(training_eligible, TRUE) AND coalesce(file_name, '') <> '' AND trim(coalesce(text, '')) <> '' GROUP BY 1")
def training_rows(spark, d):
    """FLT04, SRC15: rows that may train, legacy ones included, per split."""
    rows = selection.training_rows(clips(spark, d), "include")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if("training_eligible").alias("eligible"))


@query(f"WITH {NA} SELECT asr_id, len(w) BETWEEN 1 AND 12 AS counted, coalesce(cf < -0.5, FALSE) OR coalesce(list_min(list_transform(w, lambda x: x.probability)) < 0.1, FALSE) AS unsure, coalesce(e - s <= 3, FALSE) AS short FROM n")
def segment_flags(spark, d):
    """FLT05, FLT06, FLT07: token counts within bounds, low confidence, short segments."""
    rows = named_asr(spark, d)
    return rows.select("asr_id", quality.token_count_ok(F.col("words"), 12).alias("counted"), quality.low_confidence(F.col("confidence"), F.transform("words", lambda w: w["p"]), -0.5, 0.1).alias("unsure"), quality.is_short(F.lit(None).cast("boolean"), F.col("end") - F.col("start")).alias("short"))


@query(f"WITH {P} SELECT proposal_id, method FROM p WHERE contains(lower(concat_ws(chr(10), text, method)), 'spelling') AND confidence IS NULL")
def queue_hits(spark, d):
    """FLT08: unreviewed proposals whose text or method holds a word."""
    rows = proposals(spark, d).withColumns({"disposition": F.lit("keep"), "reviewed": F.col("confidence").isNotNull()})
    return quality.queue_filter(rows, "unreviewed", "Spelling", ["text", "method"]).select("proposal_id", "method")


@query(f"WITH {C} SELECT clip_id, replace(file_name, chr(92), '/') AS path, list_last(string_split(replace(source_file, chr(92), '/'), '/')) AS base FROM c WHERE list_last(string_split(replace(source_file, chr(92), '/'), '/')) LIKE '%.wav' AND source_start < 600 AND source_end > 60")
def early_clips(spark, d):
    """FLT09, FLT11: clips of a file name within a window of their recording; no path leaves its root."""
    rows = clips(spark, d).withColumn("base", F.element_at(F.split(F.translate("source_file", "\\", "/"), "/"), -1)).filter(F.col("base").endswith(".wav"))
    rows = quality.in_window(rows, "source_file", F.col("base"), 60, 600)
    return rows.select("clip_id", F.translate(quality.safe_relative(F.col("file_name")), "\\", "/").alias("path"), "base")


@query(f"WITH {CUR}, tf AS (SELECT turn_id, arg_max(confidence, (coalesce(version, -1), arrived_at)) cf FROM diarization_turns WHERE speaker_id IS NOT NULL AND confidence IS NOT NULL GROUP BY 1) SELECT speaker, count(*) AS observations, count(*) FILTER (WHERE e - s >= 1000 AND cf >= 0.6) AS high_quality, CAST(sum(e - s) AS BIGINT) AS ms, max(e) AS last_ms FROM cur LEFT JOIN tf USING (turn_id) GROUP BY 1")
def speaker_memory(spark, d):
    """FLT10, AG21: observations, good ones, milliseconds and last end per speaker of all sources."""
    conf = table(spark, d, "diarization_turns").filter("speaker_id is not null and confidence is not null").groupBy("turn_id").agg(F.max_by("confidence", F.struct(F.coalesce("version", F.lit(-1)), "arrived_at")).alias("confidence"))
    rows = turns(spark, d).join(conf, "turn_id", "left").withColumn("clean_seconds", F.col("end") - F.col("start"))
    good = quality.high_quality(F.col("clean_seconds") / 1000, F.lit(0.0), F.col("confidence"))
    out = speakers.memory_table(rows.withColumn("good", F.coalesce(good, F.lit(False))), "speaker")
    return out.select("speaker", "observations", "high_quality", F.col("seconds").alias("ms"), F.col("last_seen").alias("last_ms"))


@query(f"""WITH {P}, x AS (SELECT proposal_id, coalesce(length(text), 0) n, coalesce(len(evidence_refs), 0) k, confidence r FROM p)
SELECT proposal_id, CASE WHEN r IS NULL THEN 'missing' WHEN proposal_id % 7 = 0 THEN 'stale' WHEN k > n OR n < 0 OR abs(r - coalesce(k / nullif(n, 0), 0)) > 1e-9 THEN CASE WHEN proposal_id % 2 = 0 THEN 'malformed' WHEN k > n THEN 'malformed' WHEN coalesce(k / nullif(n, 0), 0) >= 0.02 AND k >= 1 THEN 'suspect' ELSE 'ok' END WHEN r >= 0.02 AND k >= 1 THEN 'suspect' ELSE 'ok' END AS spelling FROM x""")
def spelling_states(spark, d):
    """FLT12: states of spelling evidence: odd proposals have the ratio that belongs to their counts, even ones another, sevenths another text's hash."""
    rows = proposals(spark, d).select("proposal_id", F.coalesce("text", F.lit("")).alias("label"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.greatest(F.size("evidence_refs"), F.lit(0)).cast("long").alias("k"), "confidence")
    odd = F.col("proposal_id") % 2 == 1
    rows = rows.withColumns({
        "total": F.when(F.col("confidence").isNotNull(), F.col("n")), "suspicious": F.col("k"), "ratio": F.when(odd, F.coalesce(F.try_divide("k", "n"), F.lit(0.0))).otherwise(F.col("confidence")),
        "label_sha256": tx.content_identity(F.when(F.col("proposal_id") % 7 == 0, F.concat("label", F.lit("x"))).otherwise(F.col("label"))), "by_language": F.lit(None).cast("map<string,struct<checked:bigint,suspicious:bigint,ratio:double>>"),
    })
    return quality.spelling_state(rows, "label", 0.02).select("proposal_id", "spelling")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE config_id IS NOT NULL) AS named FROM training_configs")
def checked_configs(spark, d):
    """FLT13: configurations with an id and a known policy; one that breaks a rule would raise."""
    rows = quality.checked(table(spark, d, "training_configs"), {"id": F.col("config_id").isNotNull(), "seed": F.col("seed").isNotNull() | F.col("base_model").isNotNull()})
    return rows.agg(F.count("*").alias("n"), F.count("config_id").alias("named"))


@query("SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 50")
def first_events(spark, d):
    """FLT14: the first fifty events (the cap is the feature)."""
    return reports.sample_cap(table(spark, d, "events"), 50, "ts", "event_id").select("event_id", "event_type")


@query("SELECT CAST(sum(len(embedding)) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, round(min(list_min(embedding)), 5) AS low, round(max(list_max(embedding)), 5) AS high FROM embeddings")
def vector_report(spark, d):
    """FLT15: values, NaN, infinite ones and bounds of all vectors."""
    out = quality.array_report(table(spark, d, "embeddings"), "embedding")
    return out.select("n", "n_nan", "n_inf", F.round(F.col("low").cast("double"), 5).alias("low"), F.round(F.col("high").cast("double"), 5).alias("high"))


@query(f"""WITH {C}, f AS (SELECT DISTINCT '/data/' || file_name AS path FROM c WHERE clip_id % 3 = 0), x AS (SELECT clip_id, CASE WHEN starts_with(coalesce(nullif(file_name, ''), source_file), '/') THEN coalesce(nullif(file_name, ''), source_file) ELSE '/data/' || coalesce(nullif(file_name, ''), source_file) END m FROM c)
SELECT clip_id, m AS media_path, CASE WHEN m IS NULL THEN 'missing_path' WHEN path IS NULL THEN 'missing_file' ELSE 'ok' END AS status FROM x LEFT JOIN f ON m = path""")
def media_states(spark, d):
    """FLT16: media path of every clip and whether it is among the files (every third one is)."""
    rows = clips(spark, d)
    held = rows.filter("clip_id % 3 = 0").select(F.concat(F.lit("/data/"), "file_name").alias("path"))
    out = rows.select("clip_id", "file_name", F.col("source_file").alias("path"), F.lit(None).cast("string").alias("audio_path"))
    return quality.media_status(out, held, "/data").select("clip_id", "media_path", "status")


# --- lookups and reviews


@query(f"""WITH {P}, {C}, g AS (SELECT lower(replace(file_name, chr(92), '/')) k, list(p.text ORDER BY proposal_id, method) v FROM p JOIN c ON p.item_id = c.clip_id WHERE p.text IS NOT NULL AND coalesce(file_name, '') <> '' GROUP BY 1)
SELECT clip_id, coalesce(len(v), 0) AS n, v[1] AS first FROM c LEFT JOIN g ON lower(replace(file_name, chr(92), '/')) = k""")
def clip_predictions(spark, d):
    """JN01, SRC11: predictions per file in order of line, joined to the clips by path key."""
    said = proposals(spark, d).join(clips(spark, d).select(F.col("clip_id").alias("item_id"), "file_name"), "item_id")
    said = said.select("file_name", F.lit(None).cast("string").alias("sample_id"), F.lit(None).cast("string").alias("audio_path"), F.col("proposal_id").alias("line"), F.col("method").alias("view"), F.lit(None).cast("string").alias("prediction"), F.col("text").alias("hypothesis"))
    grouped = quality.grouped_predictions(said)
    rows = clips(spark, d).withColumn("key", tx.path_key(F.col("file_name"))).join(grouped, "key", "left")
    return rows.select("clip_id", F.greatest(F.size("predictions"), F.lit(0)).cast("long").alias("n"), F.try_element_at("predictions.text", F.lit(1)).alias("first"))


@query(f"""WITH {P}, {C}, sp AS (SELECT item_id k, bool_or(len(evidence_refs) > 1) s FROM p GROUP BY 1), pr AS (SELECT item_id k, arg_max(text, proposal_id) v FROM p WHERE text <> '' GROUP BY 1), ng AS (SELECT audio_sha256, count(*) n FROM c WHERE audio_sha256 IS NOT NULL GROUP BY 1),
x AS (SELECT clip_id, {PLAIN.format('text')} t, CASE WHEN speech_duration > 0 AND isfinite(speech_duration) THEN speech_duration END d, v, coalesce(s, FALSE) s, coalesce(ng.n > 1, FALSE) dup, c.audio_sha256 IS NULL bad FROM c LEFT JOIN pr ON clip_id = pr.k LEFT JOIN sp ON clip_id = sp.k LEFT JOIN ng ON ng.audio_sha256 = c.audio_sha256),
y AS (SELECT *, v IS NOT NULL AND lower(v) <> lower(t) df, length(replace(t, ' ', '')) / d r FROM x), z AS (SELECT *, df AND NOT dup AND NOT s AND NOT bad ok FROM y),
w AS (SELECT *, concat_ws(',', CASE WHEN t = '' THEN 'empty_label' END, CASE WHEN d IS NULL THEN 'invalid_duration' END, CASE WHEN d < 0.15 THEN 'too_short' END, CASE WHEN d > 30 THEN 'too_long' END, CASE WHEN t <> '' AND r < 0.5 THEN 'char_rate_low' END, CASE WHEN r > 35 THEN 'char_rate_high' END,
CASE WHEN dup THEN 'duplicate_content' END, CASE WHEN bad THEN 'malformed_input' END, CASE WHEN df THEN 'prediction_disagreement' END, CASE WHEN s THEN 'spelling_suspect' END, CASE WHEN ok THEN 'grounded_correction' END) g FROM z)
SELECT CASE WHEN ok THEN 'correct' WHEN t = '' THEN 'drop' WHEN g <> '' THEN 'review' ELSE 'keep' END AS disposition, g AS reasons, count(*) AS n FROM w GROUP BY 1, 2""")
def corrected_manifest(spark, d):
    """JN02, FLT02, FLT03, AG01: the manifest with proposals and spelling suspicion: the last proposal per item, suspect where one cites several references."""
    rows = clips(spark, d)
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\n\r]+", " "))
    rows = rows.select(F.col("clip_id").alias("key"), text.alias("label"), F.col("speech_duration").alias("seconds"), F.col("audio_sha256").alias("content_sha"))
    p = proposals(spark, d).withColumnRenamed("item_id", "key")
    last = p.filter("text <> ''").groupBy("key").agg(F.max_by("text", "proposal_id").alias("proposal"))
    spelled = p.groupBy("key").agg(F.max(F.size("evidence_refs") > 1).alias("suspect"))
    out = quality.candidate_manifest(rows, rows.filter("false").select("content_sha"), last, spelled, normalised=True)
    return out.groupBy("disposition", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


REVIEWS = "rv AS (SELECT item_id, proposal_id line, CAST(item_id AS VARCHAR) k, strftime(submitted_at, '%Y-%m-%d %H:%M:%S') sv, method, CASE WHEN trim(coalesce(text, '')) = '' THEN 'reject' ELSE 'correct' END act, text FROM p)"


def review_rows(spark, d):
    action = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "reject").otherwise("correct")
    return proposals(spark, d).select("item_id", F.col("proposal_id").alias("line"), F.col("item_id").cast("string").alias("key"), F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"), "method", action.alias("action"), F.col("text").alias("label"))


@query(f"WITH {P}, {REVIEWS}, z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sv DESC, line) r FROM rv) SELECT k AS key, line, act AS action, text AS label FROM z WHERE r = 1")
def newest_reviews(spark, d):
    """WN04, SRC16: the newest review of every item by its saved time; ties keep the first line."""
    return mapping.current_reviews(review_rows(spark, d)).select("key", "line", "action", "label")


@query(f"""WITH {P}, {REVIEWS}, z AS (SELECT *, row_number() OVER (PARTITION BY k, method ORDER BY sv DESC, line) r FROM rv), o AS (SELECT * FROM z WHERE r = 1 AND method = 'manual'), t AS (SELECT * FROM z WHERE r = 1 AND method = 'audio_replay'), w AS (SELECT DISTINCT k FROM rv WHERE method IN ('manual', 'spelling_fix')), tk AS (SELECT t.* FROM t JOIN w USING (k))
SELECT coalesce(o.k, tk.k) AS key, CASE WHEN tk.k IS NOT NULL THEN tk.act ELSE o.act END AS action, CASE WHEN tk.k IS NOT NULL THEN tk.text ELSE o.text END AS label FROM o FULL JOIN tk ON o.k = tk.k""")
def applied_reviews(spark, d):
    """JN13: another team's reviews taken over ours where they differ; unknown items are left out."""
    rows = review_rows(spark, d)
    ours, theirs = (mapping.current_reviews(rows.filter(F.col("method") == m)) for m in ("manual", "audio_replay"))
    return mapping.import_apply(ours, theirs, rows.filter("method in ('manual', 'spelling_fix')"), "theirs")


@query(f"""WITH {P}, {REVIEWS}, {K}, z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sv DESC, line) r FROM rv), b AS (SELECT * FROM z WHERE r = 1)
SELECT chunk_id, coalesce(a.act, b2.act) AS action, coalesce(a.sv, b2.sv) AS saved_at FROM (SELECT DISTINCT chunk_id FROM q) LEFT JOIN b a ON a.k = CAST(chunk_id * 2 AS VARCHAR) LEFT JOIN b b2 ON b2.k = CAST(chunk_id AS VARCHAR)""")
def chunk_reviews(spark, d):
    """JN11: chunks with the review of their newer key (twice the id), else of the older one."""
    rows = chunks(spark, d).select("chunk_id", (F.col("chunk_id") * 2).cast("string").alias("key_v3"), F.col("chunk_id").cast("string").alias("key_v2")).distinct()
    return mapping.with_reviews(rows, review_rows(spark, d)).select("chunk_id", "review.action", "review.saved_at")


@query(f"WITH n AS (SELECT source_id, count(*) c FROM (SELECT DISTINCT * FROM clips_metadata) GROUP BY 1) SELECT source_id, primary_language, coalesce(c, 0) AS n_clips FROM sources LEFT JOIN n USING (source_id)")
def source_manifest(spark, d):
    """JN10: every source with its number of clips; a source twice on either side would raise."""
    n = clips(spark, d).filter("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n"))
    out = mapping.checked_manifest(n, table(spark, d, "sources").select("source_id", "primary_language"), "source_id")
    return out.select("source_id", "primary_language", F.coalesce("n", F.lit(0)).alias("n_clips"))


@query(f"""WITH {C}, b AS (SELECT clip_id, file_name, source_id, source_start s, source_end e, audio_sha256 h, exported_at < TIMESTAMP '2026-04-01' old FROM c WHERE source_id IS NOT NULL),
o AS (SELECT * FROM b WHERE old), w AS (SELECT * FROM b WHERE NOT old), u AS (SELECT * FROM w WHERE e > s),
pr AS (SELECT o.clip_id, abs(o.s - u.s) <= 1e-6 AND abs(o.e - u.e) <= 1e-6 ex, least(o.e, u.e) - greatest(o.s, u.s) > 0 ov, lower(o.h) = lower(u.h) sa, u.clip_id nc FROM o JOIN u ON o.source_id = u.source_id AND o.e > o.s AND u.s < o.e + 1e-6 AND u.e > o.s - 1e-6),
m AS (SELECT clip_id, count(*) FILTER (WHERE ex) ne, count(*) FILTER (WHERE ov) no, count(*) FILTER (WHERE ex AND sa) ns, min(nc) FILTER (WHERE ex) ec, min(nc) FILTER (WHERE ov) oc FROM pr GROUP BY 1),
st AS (SELECT o.*, ne >= 1 AND NOT (ne = 1 AND ns = 1) OR (coalesce(ne, 0) = 0 AND coalesce(no, 0) > 1) amb, CASE WHEN ne = 1 THEN ec WHEN ne = 0 AND no = 1 THEN oc END nc FROM o LEFT JOIN m USING (clip_id)),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY clip_id DESC) z FROM st) WHERE z = 1), fr AS (SELECT source_id, lower(h) h, count(*) k, min(clip_id) sc FROM w GROUP BY 1, 2),
rv AS (SELECT clip_id line, file_name, audio_sha256 h FROM c)
SELECT line, CASE WHEN la.clip_id IS NULL THEN 'ambiguous' WHEN k = 1 THEN 'safely_reusable_review' WHEN coalesce(amb, FALSE) THEN 'ambiguous' ELSE 'changed_boundary_needs_relabel' END AS status, CASE WHEN k = 1 THEN sc ELSE nc END AS new_clip FROM rv LEFT JOIN la USING (file_name) LEFT JOIN fr ON fr.source_id = la.source_id AND fr.h = lower(rv.h)""")
def mapped_reviews(spark, d):
    """JN07, JN08: reviews of all clips carried over to the generation after March 2026."""
    rows = clips(spark, d)
    base = rows.filter("source_id is not null").select(F.col("clip_id").alias("clip"), F.col("file_name").alias("file_key"), F.col("source_id").alias("source_key"), F.col("source_start").alias("start"), F.col("source_end").alias("end"), F.col("audio_sha256").alias("sha"), "exported_at")
    old, new = (base.filter(f"exported_at {op} timestamp_ntz '2026-04-01 00:00:00'").drop("exported_at") for op in ("<", ">="))
    out = mapping.review_map(rows.select(F.col("clip_id").alias("line"), F.col("file_name").alias("file_key"), F.col("audio_sha256").alias("sha")), old, new)
    return out.select("line", "status", "new_clip")


GOLD = f"""{C}, lb AS (SELECT item_id nr, text lbl FROM eval_items WHERE text IS NOT NULL), gf AS (SELECT clip_id, audio_sha256 h, clip_id % 300 nr FROM c WHERE file_name LIKE 'test/%' OR clip_id % 10 = 1),
tr AS (SELECT audio_sha256 h, max(replace(file_name, chr(92), '/')) tk FROM c WHERE file_name LIKE 'train/%' GROUP BY 1), me AS (SELECT replace(file_name, chr(92), '/') tk, arg_max(coalesce(text, ''), clip_id) t, arg_max_null(source_file, clip_id) sf FROM c WHERE coalesce(file_name, '') <> '' AND clip_id % 5 <> 0 GROUP BY 1),
ma AS (SELECT gf.clip_id, lbl, tr.tk, t, sf, CASE WHEN lbl IS NULL THEN 'malformed' WHEN tr.tk IS NULL THEN 'unmatched' WHEN me.tk IS NULL THEN 'malformed' ELSE 'matched' END st FROM gf LEFT JOIN lb USING (nr) LEFT JOIN tr USING (h) LEFT JOIN me USING (tk))"""


def gold_parts(spark, d):
    """Test clips and every tenth as gold files with the evaluation items as labels, training clips, and metadata that lacks every fifth."""
    rows = clips(spark, d)
    gold = rows.filter("file_name like 'test/%' or clip_id % 10 = 1").select(F.concat(F.lit("g"), "clip_id", F.lit("_"), F.col("clip_id") % 300, F.lit(".wav")).alias("file_name"), F.col("audio_sha256").alias("content_sha"))
    labels = table(spark, d, "eval_items").filter("text is not null").select(F.col("item_id").alias("number"), F.col("text").alias("label"))
    train = rows.filter("file_name like 'train/%'").select("file_name", F.col("audio_sha256").alias("content_sha"))
    meta = rows.filter("clip_id % 5 <> 0").select("file_name", "text", "source_file", F.col("clip_id").alias("line"))
    return evaluate.gold_matches(gold, labels, train, meta), meta, labels.agg(F.count("*").alias("n"))


@query(f"""WITH {GOLD}, a AS (SELECT count(*) FILTER (WHERE st = 'matched') AS "overlaps", count(*) FILTER (WHERE st = 'unmatched') unmatched, count(*) FILTER (WHERE st = 'malformed') malformed, count(DISTINCT CASE WHEN st = 'matched' THEN coalesce(sf, 'unknown') END) source_groups FROM ma)
SELECT (SELECT count(*) FROM lb) AS gold, "overlaps", unmatched, malformed, source_groups, (SELECT count(*) FROM c WHERE clip_id % 5 <> 0 AND coalesce(file_name, '') = '') AS malformed_metadata, "overlaps" > 0 AS contaminated, CASE WHEN source_groups < 2 THEN 'blocked_single_group' ELSE 'groups_available' END AS split_status FROM a""")
def gold_report(spark, d):
    """JN05, AG18: gold files found among the training audio, and what could not be matched."""
    return evaluate.gold_report(*gold_parts(spark, d))


@query(f"""WITH {GOLD}, {P}, pr AS (SELECT replace(file_name, chr(92), '/') tk, list_last(string_split(method, '/')) || '|default' cand, arg_min(p.text, proposal_id) v FROM p JOIN c ON item_id = clip_id WHERE p.text IS NOT NULL GROUP BY 1, 2),
x AS (SELECT 'original_label' cand FROM ma WHERE st = 'matched' UNION ALL SELECT cand FROM ma JOIN pr USING (tk) WHERE st = 'matched') SELECT cand AS candidate, count(*) AS count, round(count(*) / (SELECT count(*) FROM lb), 9) AS coverage FROM x GROUP BY 1""")
def gold_candidates(spark, d):
    """JN06, AG18: candidates of the matched gold files and their coverage of all labels."""
    matches, _, n = gold_parts(spark, d)
    said = proposals(spark, d).select(F.col("item_id").alias("clip_id"), F.col("method").alias("model"), F.lit(None).cast("string").alias("strategy"), F.col("text").alias("said"), F.col("proposal_id").alias("line")).join(clips(spark, d).select("clip_id", "file_name"), "clip_id")
    out = evaluate.gold_metrics(matches, said.withColumnRenamed("said", "text"), n)
    return out.select("candidate", "count", F.round("coverage", 9).alias("coverage"))


# --- intervals


@query(f"WITH {CUR} SELECT turn_id, greatest(s, 60000) AS start_ms, least(e, 300000) AS end_ms FROM cur WHERE least(e, 300000) > greatest(s, 60000)")
def clipped_turns(spark, d):
    """IV03: turns clipped to the minutes one to five."""
    return iv.clip(turns(spark, d), F.lit(60_000), F.lit(300_000)).select("turn_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


@query(f"""WITH {NA}, w AS (SELECT DISTINCT source_id, x.start_sec s, x.end_sec e, x.probability r FROM (SELECT source_id, unnest(w) x FROM n)), b AS (SELECT source_id, s, max(e) e, min(r) r FROM w WHERE s IS NOT NULL GROUP BY 1, 2),
f AS (SELECT source_id, quantile_cont(r, 0.2) fl, quantile_cont(r, 0.5) mi FROM b GROUP BY 1), y AS (SELECT b.*, CASE WHEN r <= fl AND mi > fl * 1.2 THEN 0 ELSE 1 END loud FROM b JOIN f USING (source_id)),
g AS (SELECT *, sum(loud) OVER (PARTITION BY source_id ORDER BY s ROWS UNBOUNDED PRECEDING) k FROM y) SELECT source_id, round(min(s), 3) AS start, round(max(e), 3) AS "end" FROM g WHERE loud = 0 GROUP BY source_id, k HAVING max(e) - min(s) >= 0.12""")
def quiet_islands(spark, d):
    """IV10: runs of the least sure words of a source, their probability taken for the energy of blocks."""
    w = named_asr(spark, d).select("source_id", F.explode("words").alias("w")).select("source_id", "w.start", "w.end", F.col("w.p").alias("rms")).filter("start is not null")
    w = w.groupBy("source_id", "start").agg(F.max("end").alias("end"), F.min("rms").alias("rms"))
    out = iv.low_energy_islands(w, ["source_id"])
    return out.select("source_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(f"""WITH {CUR}, {NA}, {islands('m', 'cur')}, g1 AS (SELECT source_id, e s, lead(s) OVER (PARTITION BY source_id ORDER BY s) e FROM m), w AS (SELECT source_id, CAST(round(x.start_sec * 1000) AS BIGINT) s, CAST(round(x.end_sec * 1000) AS BIGINT) e FROM (SELECT source_id, unnest(w) x FROM n)),
g2 AS (SELECT source_id, e s, lead(s) OVER (PARTITION BY source_id ORDER BY s, e) e FROM w WHERE e > s), u AS (SELECT source_id, 'silero_vad_gap' m, CAST(1.0 AS DOUBLE) q FROM g1 WHERE e - s >= 500 UNION ALL SELECT source_id, 'whisper_timestamp_gap', 0.8 FROM g2 WHERE e - s >= 120 UNION ALL SELECT source_id, 'low_energy_gap', 0.3 FROM cur WHERE e - s < 1000)
SELECT source_id, m AS method, count(*) AS n, round(sum(q), 6) AS quality FROM u GROUP BY 1, 2""")
def boundary_signals(spark, d):
    """IV11, SET01, IV06: signals of boundaries per source and method: silences, gaps between words, short turns as quiet islands."""
    w = named_asr(spark, d).select("source_id", F.explode("words").alias("w")).select("source_id", F.round(F.col("w.start") * 1000).cast("long").alias("start"), F.round(F.col("w.end") * 1000).cast("long").alias("end"))
    t = turns(spark, d)
    out = iv.boundary_signals(iv.merge(t, ["source_id"]), w, t.filter("end - start < 1000"), ["source_id"], 500, 120)
    return out.groupBy("source_id", "method").agg(F.count("*").alias("n"), F.round(F.sum("quality"), 6).alias("quality"))


@query(f"""WITH {NA}, x AS (SELECT asr_id, s + 0.5 a, s + 2 b, w, t FROM n)
SELECT asr_id, len(list_filter(w, lambda y: y.start_sec >= a AND y.end_sec <= b)) AS inside, len(list_filter(w, lambda y: (y.start_sec < a AND y.end_sec > a) OR (y.start_sec < b AND y.end_sec > b))) AS across,
CASE WHEN len(w) > 0 THEN trim(array_to_string(list_transform(list_filter(w, lambda y: y.end_sec > a AND y.start_sec < b), lambda y: y.word), '')) ELSE t END AS text, coalesce(round(list_sum(list_transform(list_filter(w, lambda y: y.end_sec > a AND y.start_sec < b), lambda y: least(y.end_sec, b) - greatest(y.start_sec, a))), 6), 0) AS heard FROM x""")
def words_of_windows(spark, d):
    """IV16, IV22: words inside, across and clipped to half a second to two seconds after a segment's start."""
    rows = named_asr(spark, d).withColumns({"a": F.col("start") + 0.5, "b": F.col("start") + 2.0})
    c = iv.clip_segment(F.col("words"), F.col("text"), F.col("a"), F.col("b"))
    rows = rows.select("asr_id", F.size(iv.words_inside(F.col("words"), F.col("a"), F.col("b"))).cast("long").alias("inside"), F.size(iv.straddling(F.col("words"), F.col("a"), F.col("b"))).cast("long").alias("across"), c.alias("c"))
    return rows.select("asr_id", "inside", "across", "c.text", F.round(F.aggregate("c.words", F.lit(0.0), lambda t, w: t + w["end"] - w["start"]), 6).alias("heard"))


@query(f"""WITH {CUR}, x AS (SELECT source_id, s + 5000 s, least(e + 5000, 400000) e FROM cur WHERE e > s), y AS (SELECT * FROM x WHERE e > s AND e > 0) SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY s, e) AS track, s AS start_ms, e AS end_ms FROM y""")
def shifted_turns(spark, d):
    """IV24, IV25: turns moved by five seconds, of the first 400 seconds, with a track number."""
    t = iv.truncate(turns(spark, d).select("source_id", "start", "end"), 395_000)
    out = iv.shift(t, F.lit(5000), ["source_id"])
    return out.select("source_id", "track", F.col("start").cast("long").alias("start_ms"), F.col("end").cast("long").alias("end_ms"))


@query("""WITH s AS (SELECT source_id, duration_seconds d FROM sources WHERE duration_seconds > 0) SELECT source_id, i AS index, round(i * 12.0, 6) AS start, round(least(i * 12.0 + 20, d), 6) AS "end" FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((d - 20) / 12)) AS BIGINT) + 1)) i FROM s)""")
def stride_windows(spark, d):
    """ST27, IV17: windows of twenty seconds, twelve apart, over every source, the last one partial."""
    out = planner.fixed_windows(table(spark, d, "sources").select("source_id", F.col("duration_seconds").alias("duration")), "source_id", 20.0, 12.0)
    return out.select("source_id", F.col("index").cast("long").alias("index"), F.round(F.col("start").cast("double"), 6).alias("start"), F.round("end", 6).alias("end"))


@query(f"""WITH {CUR}, {islands('m', 'cur')}, f AS (SELECT source_id, s, e, CASE WHEN s - lag(e) OVER (PARTITION BY source_id ORDER BY s) > 800 THEN 1 ELSE 0 END g FROM m), h AS (SELECT *, sum(g) OVER (PARTITION BY source_id ORDER BY s ROWS UNBOUNDED PRECEDING) k FROM f), gr AS (SELECT source_id, k, min(s) s, max(e) e FROM h GROUP BY 1, 2),
lo AS (SELECT source_id, count(*) n, sum(e - s) t FROM gr GROUP BY 1) SELECT source_id, CAST(t AS BIGINT) AS owned_ms, n AS n_groups FROM lo""")
def owned_time(spark, d):
    """IV05, IV14, IV15: windows of a source own its bridged speech whole and without overlap: owned milliseconds, and starts that no window ends at."""
    t = seconds(turns(spark, d)).select("source_id", F.lit("speech").alias("kind"), "start", "end")
    w = planner.owned_windows(t, "source_id", arrays=False)
    w = w.select("source_id", F.round(F.col("start") * 1000).cast("long").alias("s"), F.round(F.col("end") * 1000).cast("long").alias("e"))
    w = w.join(w.select("source_id", F.col("e").alias("s"), F.lit(1).alias("goes_on")), ["source_id", "s"], "left")
    return w.groupBy("source_id").agg(F.sum(F.col("e") - F.col("s")).alias("owned_ms"), F.count_if(F.col("goes_on").isNull()).alias("n_groups"))


# --- order and groups


@query(f"WITH {C} SELECT clip_id, row_number() OVER (PARTITION BY source_id ORDER BY source_start NULLS FIRST, clip_id, file_name) - 1 AS place FROM c WHERE source_id IS NOT NULL")
def ordered_clips(spark, d):
    """WN01: place of every clip within its source."""
    rows = reports.ordered(clips(spark, d).filter("source_id is not null"), "source_start", "clip_id", "file_name", index="place", by=["source_id"])
    return rows.select("clip_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {NA}, x AS (SELECT asr_id, unnest(w).word v, generate_subscripts(w, 1) i FROM n), y AS (SELECT asr_id, v, min(i) i FROM x WHERE v IS NOT NULL GROUP BY 1, 2) SELECT n.asr_id, coalesce(string_agg(v, ' ' ORDER BY i), '') AS words FROM n LEFT JOIN y ON y.asr_id = n.asr_id GROUP BY 1""")
def first_words(spark, d):
    """WN03: the distinct words of a segment in order of first appearance."""
    return named_asr(spark, d).select("asr_id", F.array_join(mapping.first_wins(F.transform("words", lambda w: w["text"])), " ").alias("words"))


@query(f"""WITH {ASR}, x AS (SELECT DISTINCT asr_id, source_id, s, text FROM asr WHERE length(text) > 0), y AS (SELECT *, lag(text) OVER (PARTITION BY source_id ORDER BY s, asr_id) p, coalesce(array_to_string(list(text) OVER (PARTITION BY source_id ORDER BY s, asr_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ' '), '') a FROM x)
SELECT asr_id, right(coalesce(p, ''), 80) AS previous_tail, right(a, 300) AS context FROM y""")
def carried_contexts(spark, d):
    """WN08: the tail of the text before and the last 300 characters of all texts before."""
    rows = asr(spark, d).select("asr_id", "source_id", "start", "text").distinct().withColumn("at", F.struct("start", "asr_id"))
    return mapping.carried_context(rows, "source_id", "at", "text", 80, 300).select("asr_id", "previous_tail", "context")


@query(f"""WITH {CUR}, z AS (SELECT *, row_number() OVER (PARTITION BY source_id, speaker ORDER BY (e - s >= 1000) DESC, e DESC, turn_id DESC) r FROM cur) SELECT turn_id FROM z WHERE r <= 8""")
def speaker_reservoir(spark, d):
    """WN09: the last eight turns of every speaker of a source, long ones before short ones."""
    t = turns(spark, d).withColumns({"good": F.col("end") - F.col("start") >= 1000, "key": F.struct("source_id", "speaker"), "at": F.struct("end", "turn_id")})
    return speakers.reservoir(t, "key", "at", "good", 8).select("turn_id")


@query(f"WITH {CUR} SELECT turn_id, 'turn_' || lpad(CAST(row_number() OVER (PARTITION BY source_id ORDER BY s, turn_id) - 1 AS VARCHAR), 6, '0') AS id FROM cur")
def turn_ids(spark, d):
    """WN10: numbered ids of turns within their source."""
    return mapping.numbered_ids(turns(spark, d), "turn_", ["source_id"], ["start", "turn_id"]).select("turn_id", "id")


@query(f"""WITH {C}, o AS (SELECT row_number() OVER (ORDER BY clip_id) n, text, language FROM (SELECT clip_id, any_value(text) text, any_value(language) language FROM c WHERE file_name LIKE 'train/%' GROUP BY 1)), w AS (SELECT row_number() OVER (ORDER BY clip_id) n, text, language FROM (SELECT clip_id, any_value(text) text, any_value(language) language FROM c GROUP BY 1))
SELECT count(*) FILTER (WHERE o.n IS NULL OR w.n IS NULL OR o.text IS DISTINCT FROM w.text OR o.language IS DISTINCT FROM w.language) AS changed FROM o FULL JOIN w USING (n)""")
def changed_positions(spark, d):
    """WN11: positions at which two lists of clips differ."""
    one = clips(spark, d).groupBy("clip_id").agg(F.any_value("text").alias("text"), F.any_value("language").alias("language"), F.any_value("file_name").alias("f"))
    a, b = (reports.ordered(x.withColumn("all", F.lit(0)), "clip_id", index="n", by=["all"]).drop("f", "all") for x in (one.filter("f like 'train/%'"), one))
    return evaluate.changed_rows(a, b, "n", ["text", "language"])


@query("""WITH t AS (SELECT source_id, segment_id, revision, bool_or(coalesce(is_final, FALSE)) f FROM transcript_segments GROUP BY 1, 2, 3), l AS (SELECT segment_id, max(revision) v FROM t GROUP BY 1)
SELECT t.source_id, t.segment_id AS id, t.revision AS version, CASE WHEN f THEN 'transcript.final' ELSE 'transcript.partial' END AS type FROM t JOIN l ON t.segment_id = l.segment_id AND t.revision = l.v""")
def client_state(spark, d):
    """ST16, ST23: the newest event of every segment, as a client that upserts them holds it."""
    return processors.current_state(transcript_events(spark, d)).select(F.col("session").alias("source_id"), "id", F.col("version").cast("int").alias("version"), "type")


def transcript_events(spark, d):
    rows = table(spark, d, "transcript_segments")
    rows = rows.groupBy("source_id", "segment_id", "revision").agg(F.bool_or(F.coalesce("is_final", F.lit(False))).alias("f"), F.max("text").alias("text"), F.max("speaker_id").alias("speaker"), F.min("start_sec").alias("start"), F.max("end_sec").alias("end"))
    kind = F.when(F.col("f"), "transcript.final").otherwise("transcript.partial")
    return rows.select(F.col("source_id").alias("session"), F.col("segment_id").alias("id"), F.col("revision").cast("long").alias("version"), kind.alias("type"), "start", "end", "speaker", "text")


EVENTS = "ev AS (SELECT source_id, segment_id, revision, bool_or(coalesce(is_final, FALSE)) f, max(speaker_id) sp, min(start_sec) s, max(end_sec) e FROM transcript_segments GROUP BY 1, 2, 3)"


@query(f"WITH {EVENTS}, p AS (SELECT count(*) n, count(*) FILTER (WHERE f) fin, count(DISTINCT (source_id, segment_id)) ids, count(DISTINCT sp) sp, count(*) FILTER (WHERE revision > 1) n2, count(*) FILTER (WHERE revision > 1 AND f) fin2, count(DISTINCT CASE WHEN revision > 1 THEN sp END) sp2, round(min(s), 6) a, round(max(e), 6) z FROM ev) SELECT n AS a_events, fin AS a_final, ids AS a_ids, a AS a_first_start, z AS a_last_end, n2 AS b_events, fin2 AS b_final, CASE WHEN n + n2 = 0 THEN 'no events' WHEN sp <= 1 THEN 'a knows one speaker' WHEN sp2 <= 1 THEN 'b knows one speaker' WHEN fin = 0 THEN 'a commits nothing' WHEN fin2 = 0 THEN 'b commits nothing' ELSE 'comparable' END AS verdict FROM p")
def event_profiles(spark, d):
    """AG11, AG20: profile of all transcript events against that of later revisions only."""
    e = transcript_events(spark, d)
    out = processors.compare_profiles(processors.event_profile(e), processors.event_profile(e.filter("version > 1")))
    return out.select("a_events", "a_final", "a_ids", F.round("a_first_start", 6).alias("a_first_start"), F.round("a_last_end", 6).alias("a_last_end"), "b_events", "b_final", "verdict")


# --- files


def fresh(spark, name: str) -> str:
    """A path in the shared scratch folder that is made on demand."""
    return f"{scratch_path(spark, name)}/{uuid.uuid4().hex[:6]}"


@query("SELECT DISTINCT proposal_id, item_id, annotator_id, text, method, confidence FROM proposed_labels")
def json_round_trip(spark, d):
    """SRC01, SNK01: all proposals as JSON lines and read back."""
    rows = proposals(spark, d).select("proposal_id", "item_id", "annotator_id", "text", "method", "confidence").distinct()
    path = sinks.write_jsonl(rows, fresh(spark, "jsonl"))
    return files.read_jsonl(spark, path, rows.schema).drop("line")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def first_records(spark, d):
    """SRC02: the first 25 records of a file of JSON lines (the limit is the feature)."""
    path = sinks.write_jsonl(table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").coalesce(1), fresh(spark, "head"))
    return files.read_jsonl(spark, path, "doc_id long, lang string", limit=25).drop("line")


@query("WITH c AS (SELECT DISTINCT * FROM clips_metadata) SELECT clip_id, CASE WHEN regexp_matches(text, '^[=+\\-@]') THEN '''' || text ELSE text END AS text, lower(CAST(training_eligible AS VARCHAR)) AS training_eligible FROM c WHERE text <> ''")
def csv_round_trip(spark, d):
    """SNK02: clips as CSV with guarded formulas, read back."""
    rows = clips(spark, d).filter("text <> ''").select("clip_id", "text", "training_eligible")
    path = sinks.write_csv(rows, fresh(spark, "csv"))
    return spark.read.csv(path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, schema="clip_id long, text string, training_eligible string")


@query("SELECT item_id AS number, round(item_id * 2.5, 6) AS start, round(item_id * 2.5 + 1.5, 6) AS \"end\", trim(text) AS label FROM eval_items")
def gold_text_round_trip(spark, d):
    """SRC09, SRC10: evaluation items as a gold label text and read back with their spans."""
    n = F.col("item_id")
    head = F.concat(F.lit("#"), F.lpad(n.cast("string"), 3, "0"), F.lit(" | "), (n * 2.5).cast("string"), F.lit("-"), (n * 2.5 + 1.5).cast("string"), F.lit("s"))
    rows = table(spark, d, "eval_items").select("item_id", F.concat(head, F.lit("\n"), F.trim("text"), F.lit("\n")).alias("value")).orderBy("item_id").coalesce(1).select("value")
    path = fresh(spark, "gold")
    rows.write.text(path)
    return files.gold_labels(spark, path).select(F.col("number").cast("long").alias("number"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "label")


@query(f"WITH {CUR} SELECT source_id AS file, speaker, round(s / 1000, 3) AS start, round(e / 1000, 3) AS \"end\" FROM cur WHERE source_id IS NOT NULL")
def rttm_round_trip(spark, d):
    """SRC14: current turns as RTTM and read back."""
    rows = seconds(turns(spark, d)).filter("source_id is not null").select(F.col("source_id").alias("file"), "start", "end", "speaker")
    path = fresh(spark, "rttm")
    files.write_rttm(rows, path)
    return files.read_rttm(spark, path).select("file", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("SELECT DISTINCT trim(word) AS word FROM (SELECT unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) word FROM eval_items) WHERE trim(word) <> ''")
def allow_words(spark, d):
    """SRC13: words of the evaluation items as an allow-list file, read back."""
    path = fresh(spark, "words")
    table(spark, d, "eval_items").select(F.explode(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("value")).write.text(path)
    return files.allow_list(spark, path)


@query(f"""WITH {P}, {REVIEWS}, z AS (SELECT *, row_number() OVER (PARTITION BY sha256(k) ORDER BY sv DESC, line) r FROM rv) SELECT sha256(k) || ':0.000000:1.000000:u' AS key, sv AS saved_at, act AS action, text AS label FROM z WHERE r = 1""")
def stored_reviews(spark, d):
    """SRC16, SNK05: reviews as version 3 records in one file by key, and the newest of each read back."""
    rows = review_rows(spark, d).select(
        F.lit("human-review-3").alias("schema_version"), "saved_at", F.lit("r").alias("reviewer"), F.struct(F.sha2("key", 256).alias("audio_sha256"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("u").alias("source_uri")).alias("chunk"),
        F.struct("action", "label").alias("human"), F.lpad(F.col("line").cast("string"), 12, "0").alias("key"),
    )
    path = sinks.write_reviews(rows, fresh(spark, "reviews"))
    return files.read_reviews(spark, path).select("key", "saved_at", "action", "label")


@query(f"""WITH {P}, x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY proposal_id DESC) r FROM (SELECT DISTINCT proposal_id, item_id, method FROM p)) SELECT CAST(item_id AS VARCHAR) AS file_name, method FROM x WHERE r = 1""")
def spelling_records(spark, d):
    """SRC12, SNK06: spelling evidence as JSON lines; the last record of a file name counts."""
    rows = proposals(spark, d).select("proposal_id", F.col("item_id").cast("string").alias("file_name"), "method").distinct().orderBy("proposal_id").coalesce(1)
    got = files.read_jsonl(spark, sinks.write_jsonl(rows, fresh(spark, "spelling")), rows.schema)
    return files.spelling_evidence(got).select("file_name", "method")


@query("SELECT user_id, count(*) AS hops, round(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY 1")
def hop_records(spark, d):
    """SNK08, AG12: events as hop metrics in CSV of the fixed columns, read back and summed up."""
    rows = table(spark, d, "events").select(*[F.col("value").alias(c) if c in ("runtime_seconds", "latency_seconds") else F.col("event_id").alias(c) if c == "hop_index" else F.col("user_id").alias(c) for c in reports.HOP_COLUMNS])
    got = spark.read.csv(sinks.write_csv(rows, fresh(spark, "hops")), header=True, inferSchema=False)
    got = got.select(F.col("window_start").cast("long").alias("user_id"), F.col("runtime_seconds").cast("double").alias("runtime_seconds"), F.col("latency_seconds").cast("double").alias("latency_seconds"))
    return reports.hop_summary(got, "user_id").select("user_id", "hops", F.round("runtime_p50", 6).alias("p50"))


@query("""SELECT source_id, CAST(n AS BIGINT) AS index, 'train/' || regexp_replace(source_id, '[^A-Za-z0-9_.-]+', '_', 'g') || '_' || lpad(CAST(n AS VARCHAR), 5, '0') || '.wav' AS file_name, round(source_start, 6) AS source_start, round(source_end - source_start, 6) AS window_duration, round(greatest(0, source_start - (source_start - 0.5)), 6) AS target_offset_seconds,
CASE WHEN chunk_id % 3 = 0 THEN '["overlapped_speech_detected","continuous_speech_fallback","labeling_preroll_context","owned_target_alignment_required"]' ELSE '["continuous_speech_fallback","labeling_preroll_context","owned_target_alignment_required"]' END AS signals, coalesce(notes, '') AS notes
FROM (SELECT chunk_id, source_id, source_start, source_end, notes, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) - 1 n FROM (SELECT DISTINCT * FROM labeled_chunks) WHERE source_id IS NOT NULL AND source_end > source_start)""")
def exported_rows(spark, d):
    """SNK03, SNK04: chunks exported as a dataset under a lock and read back: provenance fields and review signals."""
    rows = chunks(spark, d).filter("source_id is not null and source_end > source_start")
    rows = reports.ordered(rows, "chunk_id", by=["source_id"])
    over = F.when(F.col("chunk_id") % 3 == 0, F.array(F.struct(F.col("source_start").alias("start"), F.col("source_end").alias("end"))))
    rows = rows.select("source_id", F.col("source_id").alias("source_file"), "index", F.col("source_start").alias("start"), F.col("source_end").alias("end"), (F.col("source_start") - 0.5).alias("labeling_start"), F.col("boundary_method").alias("method"), F.lit(0.5).alias("confidence"), F.lit(False).alias("eligible"), F.lit("x").alias("reason"), F.col("transcript_text").alias("text"), F.lit(None).cast("string").alias("language"), over.alias("overlap"), "notes")
    path = sinks.export_dataset(rows, fresh(spark, "export"))
    got = files.read_jsonl(spark, path, "file_name string, source_id string, source_start double, window_duration double, target_offset_seconds double, review_signals array<string>, notes string")
    index = F.regexp_extract("file_name", r"_(\d+)\.wav$", 1).cast("long")
    return got.select("source_id", index.alias("index"), "file_name", "source_start", "window_duration", "target_offset_seconds", F.to_json("review_signals").alias("signals"), F.coalesce("notes", F.lit("")).alias("notes"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings) SELECT vec_id, i AS index, round(i * 0.25, 6) AS start, round(list_sum(e[i * 16 + 1:i * 16 + 16]), 4) AS total FROM v, range(0, 4) r(i)""")
def sample_chunks(spark, d):
    """SRC06, ST01: the vectors as sound of 64 samples a second, cut to chunks of a quarter."""
    rows = table(spark, d, "embeddings").select("vec_id", F.lit(64).alias("rate"), F.col("embedding").alias("samples"))
    out = files.replay_chunks(rows, "vec_id", 0.25, 64)
    return out.select("vec_id", F.col("index").cast("long").alias("index"), F.round("start", 6).alias("start"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 n FROM embeddings) SELECT label, n AS index, round(n * 1.0, 6) AS start, round(n + 1.0, 6) AS "end", round(list_sum(list_transform(e, lambda x: trunc(greatest(-1, least(1, x)) * 32767) / 32768)), 4) AS total FROM v""")
def pcm_chunks(spark, d):
    """SRC07, NUM13: the vectors as int16 frames of one live session per label, with running index and start."""
    pcm = F.arrow_udf(_pcm, "binary")
    rows = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("session"), F.col("vec_id").alias("seq"), pcm(F.col("embedding")).alias("data"))
    out = files.pcm_frames(rows, 64)
    return out.select(F.col("session").cast("int").alias("label"), "index", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def _pcm(col):
    import pyarrow as pa

    return pa.array([nu.to_pcm16(v) for v in col.to_pylist()], pa.binary())


@query("""WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings) SELECT label, count(*) AS parts, CAST(sum(len(e)) AS BIGINT) AS n, round(sum(list_sum(e)), 3) AS total, round(sum(list_sum(e[9:24])), 3) AS cropped FROM v GROUP BY 1""")
def joined_samples(spark, d):
    """SNK13, SNK14: the vectors of a label as sound, cropped, and concatenated in order."""
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.lit(64).alias("rate"), F.col("embedding").alias("samples"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    crops = rows.groupBy("label").agg(F.round(F.sum(total(sinks.crop(F.col("samples"), F.col("rate"), F.lit(0.125), F.lit(0.375)))), 3).alias("cropped"))
    out = sinks.concatenated(rows, "label", "vec_id").select("label", F.size("seconds").cast("long").alias("parts"), F.size("samples").cast("long").alias("n"), F.round(total(F.col("samples")), 3).alias("total"))
    return out.join(crops, "label")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings), x AS (SELECT vec_id, e, unnest(range(0, 96)) i FROM v) SELECT vec_id, count(*) AS n, round(sum(CASE WHEN i >= 32 THEN e[i - 31] ELSE 0 END), 4) AS total FROM x GROUP BY 1""")
def padded_slices(spark, d):
    """IV21: from half a second before to one after the start of every vector as sound: silence where there is none."""
    rows = table(spark, d, "embeddings").select("vec_id", F.lit(0.0).alias("start"), F.col("embedding").alias("samples"))
    out = iv.filled_slice(rows, ["vec_id"], -0.5, 1.0, 64)
    return out.select("vec_id", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT source_id, CASE WHEN source_id IN (SELECT source_id FROM clips_metadata WHERE source_id IS NOT NULL) THEN 'held' ELSE 'to_compute' END AS state FROM sources")
def evidence_cache(spark, d):
    """SRC17: sources whose evidence is held (those with clips) and those to compute."""
    want = table(spark, d, "sources").select("source_id", F.lit("h").alias("audio_sha256"), F.lit("1").alias("settings_sha"))
    cache = clips(spark, d).select("source_id").filter("source_id is not null").distinct().select("source_id", F.lit("h").alias("audio_sha256"), F.lit("1").alias("settings_sha"))
    hit, miss = files.cached_evidence(want, cache)
    return hit.select("source_id", F.lit("held").alias("state")).unionByName(miss.select("source_id", F.lit("to_compute").alias("state")))


@query("SELECT config_id, sha256(coalesce(base_model, '') || '|' || coalesce(language_policy, '') || chr(10)) AS sha256 FROM training_configs")
def config_file_hashes(spark, d):
    """HSH01, HSH02: every configuration as a text file of its own, hashed as a stream."""
    path = fresh(spark, "configs")
    rows = table(spark, d, "training_configs").select("config_id", F.concat(F.coalesce("base_model", F.lit("")), F.lit("|"), F.coalesce("language_policy", F.lit(""))).alias("value"))
    rows.repartition("config_id").write.partitionBy("config_id").text(path)
    out = nu.file_hashes(spark, path, "part-*")
    return out.select(F.regexp_extract("path", "config_id=([^/]+)/", 1).alias("config_id"), "sha256")


def queries() -> dict:
    return dict(QUERIES)
