"""The reference workload's queries on the given tables, each over its whole table.

Times are whole milliseconds where rows are compared, so that every engine gives the same values.
Exactly repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescribe.functions import text as tx
from tidescribe.operators import evaluate, mapping, planner, quality, reports, selection, speakers
from tidescribe.operators import intervals as iv
from tidescribe.operators.coverage import current_turns
from tidescribe.runtime import table
from tidescribe.sources import sinks
from tidescribe.streaming import processors


def ms(c: str) -> Column:
    return F.round(F.col(c) * 1000).cast("long")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Current turns: ``source_id, turn_id, speaker, start, end`` in ms."""
    return current_turns(table(spark, d, "diarization_turns")).select("source_id", "turn_id", F.col("speaker_id").alias("speaker"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))


def asr(spark: SparkSession, d: str) -> DataFrame:
    """Usable ASR segments in ms."""
    rows = table(spark, d, "asr_segments").select("asr_id", "source_id", ms("start_sec").alias("start"), ms("end_sec").alias("end"), "text", "language").distinct()
    return iv.usable(rows)


def turns_merged(spark, d):
    """IV01: stretches of speech per source, gaps up to 0.5 s bridged."""
    return iv.merge(turns(spark, d), ["source_id"], 500).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


def turns_bridged(spark, d):
    """IV05: groups per source and speaker."""
    rows = iv.bridged_groups(turns(spark, d), ["source_id", "speaker"], 800)
    return rows.groupBy("source_id", "speaker").agg((F.max("group_no") + 1).alias("n_groups"), F.count("*").alias("n_turns"))


def speech_gaps(spark, d):
    """IV06: silences of a second or more in the merged speech of a source."""
    return iv.gaps(iv.merge(turns(spark, d), ["source_id"]), ["source_id"], 1000).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


def speech_union(spark, d):
    """IV07: covered milliseconds per source."""
    return iv.union_length(turns(spark, d), ["source_id"]).withColumnRenamed("seconds", "covered_ms")


def speaker_time(spark, d):
    """IV23: seconds per speaker of a source."""
    return iv.seconds_by_label(turns(spark, d), ["source_id", "speaker"]).select("source_id", "speaker", F.col("seconds").cast("long").alias("spoken_ms"))


def overlap_regions(spark, d):
    """IV09: regions where two or more turns run at once."""
    return iv.concurrency(turns(spark, d), ["source_id"], 0, 2).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


def asr_speech_overlap(spark, d):
    """IV04, IV08: milliseconds that recognised segments and turns have in common, per source."""
    a, b = (iv.merge(x, ["source_id"]) for x in (asr(spark, d), turns(spark, d)))
    both = iv.overlap_join(a, b, ["source_id"], 30_000)
    return both.groupBy("source_id").agg(F.sum(F.col("end") - F.col("start")).alias("common_ms"))


def speech_without_asr(spark, d):
    """IV02: the parts of speech that no recognised segment covers."""
    return iv.subtract(turns(spark, d), asr(spark, d), ["source_id"], 30_000).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


def asr_speakers(spark, d):
    """JN09: speaker of every recognised segment by most common time, then confidence, then the earlier turn."""
    rows = table(spark, d, "diarization_turns").filter("speaker_id is not null and confidence is not null").groupBy("turn_id").agg(F.max_by("confidence", F.struct("version", "arrived_at")).alias("confidence"))
    t = turns(spark, d).join(rows, "turn_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return mapping.best_overlap(asr(spark, d), t, "source_id", "asr_id", 30_000).select("asr_id", "speaker", F.col("overlap").cast("long").alias("overlap_ms"))


def asr_risky_boundaries(spark, d):
    """IV19: ends of recognised segments strictly inside a turn less 0.25 s, per source."""
    a, b = asr(spark, d), turns(spark, d)
    sec = lambda df: df.withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    return iv.risky_boundaries(sec(a), sec(b), ["source_id"]).groupBy("source_id").agg(F.count("*").alias("risky"))


def asr_durations(spark, d):
    """AG07, NUM07, NUM08: durations per language."""
    out = evaluate.durations(asr(spark, d), ["language"])
    return out.select("language", "n", F.col("total").cast("long").alias("total_ms"), F.round("mean", 6).alias("mean_ms"), "p50", F.col("p95").cast("double").alias("p95"), F.col("longest").cast("double").alias("longest"))


def scorecard(spark, d):
    """AG08: reference, retained and missed milliseconds and chunks per source."""
    out = evaluate.scorecard(asr(spark, d), turns(spark, d), "source_id", 25_000)
    whole = lambda c: F.col(c).cast("long")
    return out.select("source_id", *[whole(c).alias(c) for c in ("reference", "retained", "missed", "duplicated", "chunks", "long_chunks")])


def segments_latest(spark, d):
    """WN05: newest revision of every segment."""
    rows = table(spark, d, "transcript_segments").select("segment_id", "revision", "source_id", "is_final", "text", F.struct("revision", "emitted_at").alias("at"))
    return mapping.last_per_key(rows, "segment_id", "at").drop("at")


def _clips(spark, d):
    cols = ["clip_id", "file_name", "text", "source_file", "source_id", "source_start", "source_end", "speech_duration", "language", "audio_sha256", "training_eligible", "exported_at"]
    return table(spark, d, "clips_metadata").select(*cols).distinct()


def duplicate_audio(spark, d):
    """JN04: content hashes of several clips, with the number of texts that disagree."""
    rows = _clips(spark, d).groupBy("audio_sha256").agg(F.count("*").alias("copies"), F.count_distinct(F.lower(F.trim("text"))).alias("texts"))
    return rows.filter("copies > 1")


def manifest(spark, d):
    """FLT01, FLT02, JN03, JN04: disposition and reasons of every clip that is not of the test split; content of test clips is protected."""
    clips = _clips(spark, d)
    rows = clips.select(F.col("clip_id").alias("key"), F.col("text").alias("label"), F.col("speech_duration").alias("seconds"), F.col("audio_sha256").alias("content_sha"))
    guarded = clips.filter(F.lower(selection.split_name(F.regexp_replace("file_name", r"^\./", ""))) == "test").select(F.col("audio_sha256").alias("content_sha"))
    train = rows.join(clips.filter(F.lower(selection.split_name(F.regexp_replace("file_name", r"^\./", ""))) != "test").select(F.col("clip_id").alias("key")), "key", "left_semi")
    out = quality.candidate_manifest(train, guarded, scripts=["thai", "latin"])
    return out.select(F.col("key").alias("clip_id"), "disposition", F.array_join("reasons", ",").alias("reasons"), F.round("char_rate", 6).alias("char_rate"), F.size(quality.evidence()).alias("n_evidence"))


def manifest_counts(spark, d):
    """AG01 over the manifest of labels taken as they are, white space collapsed (no NFKC, so SQL can say the same)."""
    clips = _clips(spark, d)
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\n\r]+", " "))
    rows = clips.select(F.col("clip_id").alias("key"), text.alias("label"), F.col("speech_duration").alias("seconds"), F.col("audio_sha256").alias("content_sha"))
    guarded = clips.filter(F.col("file_name").startswith("test/")).select(F.col("audio_sha256").alias("content_sha"))
    out = quality.candidate_manifest(rows, guarded, normalised=True)
    return out.groupBy("disposition", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


def generation_map(spark, d):
    """JN07: clips exported before April 2026 mapped to the later ones of their source id."""
    rows = _clips(spark, d).filter("source_id is not null").select(F.col("clip_id").alias("clip"), F.col("source_id").alias("source_key"), F.col("source_start").alias("start"), F.col("source_end").alias("end"), F.col("audio_sha256").alias("sha"), "exported_at")
    old, new = (rows.filter(f"exported_at {op} timestamp_ntz '2026-04-01 00:00:00'").drop("exported_at") for op in ("<", ">="))
    return mapping.generation_map(old, new).select(F.col("clip").alias("clip_id"), "status", F.col("new_clip").alias("new_clip_id"))


def label_consensus(spark, d):
    """AG04: text of most proposals per item, if two proposals of two methods have it."""
    rows = table(spark, d, "proposed_labels").select("proposal_id", "item_id", "method", "text").distinct()
    out = quality.consensus(rows.withColumn("text", F.regexp_replace("text", "[ \t\n\r]+", " ")), "item_id", "method", "text")
    return out.select("item_id", "n", "views", "total", F.round("fraction", 9).alias("fraction"))


def sources_in_both(spark, d):
    """SET02, JN17: sources with clips of both train and test."""
    rows = _clips(spark, d).filter("trim(source_id) <> ''")
    return mapping.in_both(*(rows.filter(F.col("file_name").startswith(f"{s}/")) for s in ("train", "test")), "source_id")


def sources_without_turns(spark, d):
    """SET03: sources that have no usable turn."""
    return mapping.unmatched(table(spark, d, "sources").select("source_id"), turns(spark, d), ["source_id"])


def source_split(spark, d):
    """SET04: a tenth of the sources held out, by seeded hash order."""
    rows = selection.source_split(_clips(spark, d).select("clip_id", "source_id"), "source_id", 0.1, 17)
    return rows.select("clip_id", "held_out")


def selection_report(spark, d):
    """FLT04, SRC15, SNK12: clips and sources per split and state."""
    return selection.selection_report(_clips(spark, d))


def fastest_clips(spark, d):
    """WN02: the ten clips of most characters a second."""
    rows = _clips(spark, d).withColumn("rate", F.round(F.length("text") / F.col("speech_duration"), 6))
    return evaluate.worst(rows.select("clip_id", "rate"), "rate", "clip_id")


def rolling_prompts(spark, d):
    """WN06: prompt of every recognised segment from the three before it in its source."""
    rows = asr(spark, d).filter("text is not null")
    rows = rows.withColumn("at", F.struct("start", "asr_id"))
    return mapping.rolling_prompt(rows, "source_id", "at", "text", 3, 600).select("asr_id", "prompt")


def top_languages(spark, d):
    """AG10: the twelve most frequent labels of chunks; ties by name."""
    rows = table(spark, d, "labeled_chunks").select("chunk_id", "language").distinct().filter("language is not null")
    return rows.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(12)


def chunk_status(spark, d):
    """AG09, FLT06: chunks per boundary method, with those of three seconds or less."""
    rows = table(spark, d, "labeled_chunks").select("chunk_id", "boundary_method", "source_start", "source_end").distinct()
    short = quality.is_short(F.lit(None).cast("boolean"), ms("source_end") - ms("source_start"), 3000)
    return rows.groupBy("boundary_method").agg(F.count("*").alias("n"), F.count_if(short).alias("n_short"))


def script_counts(spark, d):
    """STR06: characters of some scripts per kind of document."""
    c = tx.script_counts(F.coalesce("text", F.lit("")), ("Thai", "Latin", "Hiragana", "Katakana", "CJK", "Hangul", "Cyrillic", "Digit"))
    one = lambda k: F.sum(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))).cast("long").alias(k.lower())
    return table(spark, d, "documents").select("kind", c.alias("m")).groupBy("kind").agg(*[one(k) for k in ("Thai", "Latin", "Hiragana", "Katakana", "CJK", "Hangul", "Cyrillic", "Digit")])


def import_preview(spark, d):
    """JN12: reviews of one team against another's, per item."""
    rows = table(spark, d, "proposed_labels").select("proposal_id", F.col("item_id").cast("string").alias("key"), F.col("submitted_at").cast("string").alias("saved_at"), "method", "text", F.col("proposal_id").alias("line")).distinct()
    rows = rows.withColumns({"action": F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "reject").otherwise("correct"), "label": F.lower(F.trim("text"))})
    ours, theirs = (mapping.current_reviews(rows.filter(c)) for c in ("method = 'manual'", "method = 'audio_replay'"))
    known = rows.filter("method = 'spelling_fix' or method = 'manual'")
    return mapping.import_diff(ours, theirs, known).groupBy("state").agg(F.count("*").alias("n"))


def review_actions(spark, d):
    """UD12, WN04: action of the newest proposal of every annotator on an item against the first one's text."""
    rows = table(spark, d, "proposed_labels").select("proposal_id", "item_id", "annotator_id", "text", "submitted_at").distinct()
    first = rows.groupBy("item_id").agg(F.min_by("text", "proposal_id").alias("original"))
    return rows.join(first, "item_id").groupBy(mapping.save_review(F.col("text"), F.col("original")).alias("action")).agg(F.count("*").alias("n"))


def embedding_centroids(spark, d):
    """AG13, NUM09: direction of the mean vector per label, one coordinate a row."""
    rows = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("speaker"), "embedding", F.lit(1.0).alias("w"))
    c = speakers.centroids(rows, "speaker", "embedding", "w")
    return c.select("speaker", F.posexplode("centroid").alias("i", "x")).select("speaker", "i", F.round("x", 5).alias("x"))


def embedding_nearest(spark, d):
    """JN15, NUM10, NUM11: nearest label centroid of every vector, if it is near enough, and the confidence."""
    rows = table(spark, d, "embeddings")
    c = speakers.centroids(rows.select(F.col("label").cast("string").alias("speaker"), "embedding", F.lit(1.0).alias("w")), "speaker", "embedding", "w")
    out = speakers.nearest_profile(rows, c, "vec_id", "embedding", 0.75)
    return out.select("vec_id", "speaker", F.round("distance", 5).alias("distance"), F.round("confidence", 5).alias("confidence"))


def speech_windows(spark, d):
    """IV11-IV15: owned windows of every source from turns as speech and the gaps between recognised words."""
    sec = lambda k: (F.col(k) / 1000).alias(k)
    speech = turns(spark, d).select("source_id", F.lit("speech").alias("kind"), sec("start"), sec("end"))
    words = table(spark, d, "asr_segments").select("asr_id", "source_id", "words").dropDuplicates(["asr_id"]).select("source_id", F.explode("words").alias("w"))
    words = words.select("source_id", F.lit("word").alias("kind"), F.col("w.start_sec").alias("start"), F.col("w.end_sec").alias("end"))
    return planner.owned_windows(speech.unionByName(words), "source_id")


def boundary_scores(spark, d):
    """IV18: boundaries of recognised segments against those of turns."""
    return evaluate.boundary_f1(asr(spark, d), turns(spark, d), "source_id", 250)


def speaker_runs(spark, d):
    """IV20: runs of one speaker and the silences between, in ms."""
    return iv.speaker_runs(turns(spark, d), "source_id", "speaker", 1000).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


def live_transcript(spark, d):
    """ST12-ST14, ST17, ST26: recognised segments and turns replayed in order of arrival through the multiplexer."""
    a = table(spark, d, "asr_segments").filter("end_sec > start_sec").select(F.col("source_id").alias("session"), "arrived_at", F.lit("asr").alias("kind"), F.col("asr_id").cast("string").alias("id"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), F.lit(None).cast("string").alias("speaker"), F.lit(0.0).alias("confidence"), "text")
    t = table(spark, d, "diarization_turns").filter("end_sec > start_sec and speaker_id is not null")
    t = t.select(F.col("source_id").alias("session"), "arrived_at", F.when(F.coalesce("is_final", F.lit(False)), "final").otherwise("turn").alias("kind"), F.col("turn_id").alias("id"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), F.col("speaker_id").alias("speaker"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit(None).cast("string").alias("text"))
    rows = a.unionByName(t).distinct().withColumn("seq", F.unix_micros(F.col("arrived_at").cast("timestamp"))).drop("arrived_at")
    return processors.multiplex(rows, keep_seconds=None)


def subtitles(spark, d):
    """SNK11: subtitle blocks of the final segments of every source."""
    rows = table(spark, d, "transcript_segments").filter("is_final").select("source_id", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "text", F.col("speaker_id").alias("speaker"), "segment_id", "revision", "emitted_at")
    rest = [c for c in rows.columns if c != "segment_id"]
    rows = rows.groupBy("segment_id").agg(F.max_by(F.struct(*rest), F.struct("revision", "emitted_at")).alias("r")).select("r.*")
    return sinks.srt(rows, "source_id")


def term_counts(spark, d):
    """STR13, STR14, ST21: technical terms of the chunks and how many chunks have them."""
    rows = table(spark, d, "labeled_chunks").select("chunk_id", "transcript_text").distinct()
    return rows.select(F.explode(tx.terms(F.coalesce("transcript_text", F.lit("")))).alias("term")).groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("n"))


def language_spans(spark, d):
    """STR07, STR08: characters per routed language of the chunks."""
    rows = table(spark, d, "labeled_chunks").select("chunk_id", "transcript_text").distinct()
    spans = rows.select(F.explode(tx.script_spans(F.col("transcript_text"))).alias("s"))
    return spans.groupBy(F.col("s.language").alias("language")).agg(F.count("*").alias("spans"), F.sum(F.col("s.end") - F.col("s.start")).cast("long").alias("chars"))


def neighbour_context(spark, d):
    """JN16: texts just before every recognised segment."""
    rows = asr(spark, d).withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    return mapping.neighbour_context(rows, "source_id", "text").select("asr_id", "context")


def merged_short(spark, d):
    """WN07: groups of short recognised segments."""
    rows = asr(spark, d).select("source_id", "asr_id", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    return mapping.merge_short(rows, "source_id").select("source_id", "asr_id", "group_no")


def event_windows(spark, d):
    """ST03: every source as chunks of ten seconds: full windows of a minute, twenty seconds apart."""
    rows = planner.fixed_windows(table(spark, d, "sources").select("source_id", F.col("duration_seconds").alias("duration")), "source_id", 10.0, 10.0)
    rows = rows.select(F.col("source_id").alias("session"), F.col("start").cast("double").alias("start"), "end")
    return processors.sliding_windows(rows, 60, 20).select(F.col("session").alias("source_id"), F.col("window_start").cast("long").alias("start_s"), "n")


def speaker_identities(spark, d):
    """ST09-ST11: vectors of a label as the chunks of a session, matched and committed in order."""
    rows = table(spark, d, "embeddings").select((F.col("label") % 4).cast("string").alias("session"), F.col("vec_id").alias("chunk"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), F.col("embedding").alias("vector"), F.lit(7.0).alias("seconds"), F.col("vec_id").cast("double").alias("end"))
    return speakers.assign_in_order(rows, "session")


def text_identities(spark, d):
    """STR02: texts that several documents share, by identity (NFKC, white space and case aside)."""
    rows = table(spark, d, "documents").filter("text is not null").select(tx.content_identity(F.col("text")).alias("sha"))
    return rows.groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1")


def event_percentiles(spark, d):
    """AG12, NUM07: interpolated percentiles of two measures per kind of event."""
    rows = table(spark, d, "events").select("event_type", F.col("value").alias("runtime_seconds"), F.second(F.col("ts").cast("timestamp")).cast("double").alias("latency_seconds"))
    out = reports.hop_summary(rows, "event_type")
    return out.select("event_type", "hops", *[F.round(c, 6).alias(c) for c in ("runtime_p50", "runtime_p95", "latency_p50", "latency_p95")])


def turns_with_words(spark, d):
    """JN18: current turns during which something was recognised, per source."""
    return reports.with_overlap(turns(spark, d), asr(spark, d).select("source_id", "start", "end"), ["source_id"], 30_000).groupBy("source_id").agg(F.count("*").alias("n"))


def window_evidence(spark, d):
    """AG15 over the owned windows of all sources."""
    return reports.evidence_coverage(speech_windows(spark, d))


def queue_sizes(spark, d):
    """AG14: review queue of the clips: those of long or repeated audio, reviewed where a later export exists."""
    rows = _clips(spark, d)
    n = rows.groupBy("audio_sha256").agg(F.count("*").alias("n"))
    rows = rows.join(n, "audio_sha256").withColumn("disposition", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "drop").when((F.col("n") > 1) | (F.col("speech_duration") > 20), "review").otherwise("keep"))
    return reports.queue_counts(rows, "disposition", F.col("n") > 1)
