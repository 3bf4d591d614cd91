"""Queries over spelling, plug-in models, diarization scores, live events, order and media files, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescribe.functions import models, numeric as nu
from tidescribe.functions import text as tx
from tidescribe.operators import evaluate, planner, quality
from tidescribe.operators import intervals as iv
from tidescribe.plans import queries as base
from tidescribe.plans.oracles import ASR, CUR, SQL, islands
from tidescribe.plans.record_queries import C, NA, P, fresh, named_asr, seconds
from tidescribe.plans.text_queries import clips, collapsed, nfkc, proposals, unicode_tables
from tidescribe.runtime import table
from tidescribe.sources import files, sinks
from tidescribe.streaming import processors

#: Words of a dictionary that is made from recognised words: at most so many, each seen at least so often.
VOCABULARY, LEAST = 50_000, 3


def vocabulary(spark, d) -> dict[str, int]:
    """The most frequent recognised words with their counts (bounded by VOCABULARY), as a checker's dictionary."""
    words = named_asr(spark, d).select(F.explode("words.text").alias("w")).filter("w is not null").select(tx.casefold(F.regexp_replace("w", r"^[^\p{L}]+|[^\p{L}\p{M}]+$", "")).alias("w"))
    rows = words.filter("w <> ''").groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "w").limit(VOCABULARY)
    return {r.w: r.n for r in rows.collect()}


def _spelled(spark, d, checkers: dict) -> DataFrame:
    rows = clips(spark, d).select(F.col("clip_id").alias("key"), F.col("text").alias("label"))
    return quality.spelling(rows, "key", "label", checkers)


def spelling_audit(spark, d):
    """UD01-UD03, AG05, AG06: checked and suspicious English words of every clip, against the recognised words, and whether it needs review."""
    units = _spelled(spark, d, {"english": quality.english_checker(quality.WordList(vocabulary(spark, d)), suggest=False)})
    out = quality.spelling_rows(units.withColumnRenamed("key", "clip_id"), "clip_id")
    return out.select("clip_id", "total", "suspicious", F.round("ratio", 9).alias("ratio"), "review")


def spelling_languages(spark, d):
    """UD02, AG05: English, Thai and Japanese words of all clips: checked and suspicious per language, and clips with an issue."""
    words = vocabulary(spark, d)
    mine = lambda script: quality.WordList({w: n for w, n in words.items() if w and tx.script_of(w[0]) == script})
    checkers = {"english": quality.english_checker(mine("latin"), suggest=False), "thai": quality.dictionary_checker(mine("thai"), "thai", suggest=False), "japanese": quality.dictionary_checker(quality.WordList({w: n for w, n in words.items() if w and tx.script_of(w[0]) in ("han", "hiragana", "katakana")}), "", suggest=False)}
    units = _spelled(spark, d, checkers)
    return units.groupBy("language").agg(F.sum("checked").alias("checked"), F.sum("suspicious").alias("suspicious"), F.count_if(F.col("suspicious") > 0).alias("clips"))


def decided_labels(spark, d):
    """FLT03: dispositions of all proposals by their text, their length as seconds and their confidence."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\n\r]+", " "))
    rows = proposals(spark, d).select("proposal_id", text.alias("label"), (F.length("method") / 4).alias("seconds"), "confidence", F.when(F.col("proposal_id") % 11 == 0, F.lit("x")).alias("proposal"))
    out = quality.decide(quality.signals(rows, "label", "seconds", normalised=True), "confidence", "proposal")
    return out.select("proposal_id", "disposition", F.array_join("reasons", ",").alias("reasons"))


def diarization_scores(spark, d):
    """AG16: turns of a second or more, speakers renamed, against all turns: missed, false and confused seconds."""
    t = seconds(base.turns(spark, d)).filter("source_id is not null")
    long = t.filter("end - start >= 1").withColumn("speaker", F.concat(F.lit("x_"), "speaker"))
    out = evaluate.diarization_error(t, long, "source_id")
    return out.select("source_id", *[F.round(c, 3).alias(c) for c in ("total", "missed", "false_alarm", "confused")])


def drift(spark, d):
    """AG17: the micro rate of all proposals against their item's first one, if within the gate (here a wide one)."""
    rows = proposals(spark, d).filter("text is not null").select("item_id", "proposal_id", F.regexp_replace("text", "[^ -~]", "?").alias("hyp"))
    first = rows.groupBy("item_id").agg(F.min_by("hyp", "proposal_id").alias("ref"))
    micro = evaluate.char_scores(rows.join(first, "item_id"), "ref", "hyp").agg((F.sum("char_edits") / F.sum("ref_chars")).alias("cer"))
    return evaluate.drift_gate(micro, "cer", 50.0, 50.0).select(F.round("cer", 9).alias("cer"))


def baseline_time(spark, d):
    """IV17: speech of the first baseline's windows per source, and how many windows are longer than 25 s (none)."""
    merged = seconds(iv.merge(base.turns(spark, d), ["source_id"])).filter("source_id is not null")
    w = planner.baseline_windows(merged, "source_id")
    return w.groupBy("source_id").agg(F.round(F.sum("speech"), 3).alias("speech"), F.count_if(F.col("end") - F.col("start") > 25.001).alias("too_long"))


def live_counts(spark, d):
    """ST12, ST13, ST17, ST26: partials, finals and segments of the replayed sessions: every segment becomes final once."""
    return base.live_transcript(spark, d).groupBy("session").agg(F.count_if(F.col("type") == "transcript.partial").alias("partials"), F.count_if(F.col("type") == "transcript.final").alias("finals"), F.count_distinct("id").alias("segments"))


def fallback_turns(spark, d):
    """ST15, UD14: every recognised segment as a chunk of the null diarizer: an unknown turn, committed as version 2."""
    rows = base.asr(spark, d).select("asr_id", "source_id", "start", "end").distinct().filter("source_id is not null")
    rows = rows.select(F.col("source_id").alias("session"), F.col("asr_id").alias("seq"), F.lit("chunk").alias("kind"), (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    out = processors.null_turns(rows)
    return out.select("session", "type", "version", "speaker", F.round(F.col("start") * 1000).cast("long").alias("start_ms"))


def energy_speech(spark, d):
    """UD04, UD14, NUM06: stretches of the vectors, as sound of 64 samples a second, whose blocks of an eighth are loud."""
    models.register("vad", "coarse", models.energy_vad(0.125, 0.125))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.lit(64).alias("rate"), F.col("embedding").alias("samples"))
    out = models.apply_model(rows, models.backend("vad", "missing", "coarse"), "key long, start double, end double")
    return out.select(F.col("key").alias("vec_id"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def silent_recogniser(spark, d):
    """UD06: the null recogniser over all chunks: one row each, without text."""
    rows = table(spark, d, "labeled_chunks").select(F.col("chunk_id").alias("key")).distinct()
    return models.apply_model(rows, models.backend("asr", "missing"), "key long, text string, language string, confidence double").select("key", "text", "confidence")


def mapping_counts(spark, d):
    """SNK07: the report of the generation map: clips by status."""
    report = sinks.mapping_report(base.generation_map(spark, d))
    return spark.createDataFrame(sorted(report["clips"].items()), "status string, n long")


def config_files(spark, d):
    """SRC03: configurations as text files, found below their folder by suffix, whatever its case, with their lengths."""
    path = fresh(spark, "media")
    rows = table(spark, d, "training_configs").select("config_id", F.coalesce("base_model", F.lit("")).alias("value"))
    rows.repartition("config_id").write.partitionBy("config_id").text(path)
    out = files.media_files(spark, path, ("txt", "wav"))
    return out.select(F.regexp_extract("path", "config_id=([^/]+)/", 1).alias("config_id"), "length")


def wav_round_trip(spark, d):
    """SRC05, SNK14, NUM13: the vectors of a label concatenated to a WAV file of 16 bits and read back."""
    path = fresh(spark, "wav").removeprefix("file://")
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.lit(64).alias("rate"), F.col("embedding").alias("samples"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import wave

        for pdf in batches:
            os.makedirs(path, exist_ok=True)
            for label, rate, samples in zip(pdf["label"], pdf["rate"], pdf["samples"]):
                with wave.open(f"{path}/label_{label}.wav", "wb") as f:
                    f.setnchannels(1), f.setsampwidth(2), f.setframerate(int(rate)), f.writeframes(nu.to_pcm16(samples))
            yield pdf[["label"]]

    sinks.concatenated(rows, "label", "vec_id").select("label", "rate", "samples").mapInPandas(write, "label int").write.format("noop").mode("overwrite").save()
    out = files.wav_samples(spark, path)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select(F.regexp_extract("path", r"label_(\d+)\.wav", 1).cast("int").alias("label"), "rate", F.size("samples").cast("long").alias("n"), F.round(total, 3).alias("total"))


def term_index(spark, d):
    """STR13, STR14: terms of the live prompt's rule in the chunks' ASCII words, and how many chunks have each."""
    rows = table(spark, d, "labeled_chunks").select("chunk_id", F.regexp_replace(F.coalesce("transcript_text", F.lit("")), "[^ -~]", " ").alias("t")).distinct()
    terms = rows.select("chunk_id", F.explode(tx.terms(F.col("t"))).alias("term")).select("chunk_id", F.lower("term").alias("term")).distinct()
    return terms.groupBy("term").agg(F.count("*").alias("n"))


QUERIES = [
    spelling_audit, spelling_languages, decided_labels, diarization_scores, drift, baseline_time, live_counts, fallback_turns, energy_speech, silent_recogniser, mapping_counts, config_files, wav_round_trip, term_index,
]


def sql() -> dict[str, str]:
    u = unicode_tables()
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    letters = f"""WITH {u['nk']}, {u['rt']}, {u['cf']}, {C}, {NA}"""
    spans = f"""{nfkc('tn', 'c', 'clip_id', 'text')}, tm AS (SELECT k, {collapsed('t')} t FROM tn),
ch AS (SELECT k, unnest(string_split(t, '')) x, generate_subscripts(string_split(t, ''), 1) i FROM tm WHERE t <> ''), ro AS (SELECT k, x, i, coalesce(v, '') v FROM ch LEFT JOIN rt ON unicode(x) BETWEEN lo AND hi),
ac AS (SELECT *, coalesce(last_value(CASE WHEN v <> 'go' THEN v END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING), '') l FROM ro),
ed AS (SELECT *, CASE WHEN l = lag(l) OVER (PARTITION BY k ORDER BY i) THEN 0 ELSE 1 END e FROM ac), sp AS (SELECT *, sum(e) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) g FROM ed),
st AS (SELECT k, string_agg(x, '' ORDER BY i) s FROM sp WHERE l = 'english' GROUP BY k, g)"""
    voc = """wd AS (SELECT lower(regexp_replace(x.word, '^[^\\p{L}]+|[^\\p{L}\\p{M}]+$', '', 'g')) w FROM (SELECT unnest(w) x FROM n) WHERE x.word IS NOT NULL), vo AS (SELECT w FROM wd WHERE w <> '' GROUP BY 1 HAVING count(*) >= 3)"""
    return {
        "spelling_audit": f"""{letters}, {spans}, {voc}, un AS (SELECT k, unnest(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9''’_-]*')) u FROM st), ok AS (SELECT k, u, lower(u) IN (SELECT w FROM vo) known FROM un WHERE length(u) > 1 AND NOT (upper(u) = u AND length(u) <= 8))
SELECT k AS clip_id, count(*) AS total, count(*) FILTER (WHERE NOT known) AS suspicious, round(count(*) FILTER (WHERE NOT known) / count(*), 9) AS ratio, count(*) FILTER (WHERE NOT known) / count(*) >= 0.2 AND count(*) FILTER (WHERE NOT known) >= 1 AS review FROM ok GROUP BY 1""",
        "decided_labels": f"""WITH {P}, x AS (SELECT proposal_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')) t, length(method) / 4 d, confidence c, proposal_id % 11 = 0 fix FROM p), y AS (SELECT *, length(replace(t, ' ', '')) / d r FROM x),
z AS (SELECT *, concat_ws(',', CASE WHEN t = '' THEN 'empty_label' END, CASE WHEN d < 0.15 THEN 'too_short' END, CASE WHEN d > 30 THEN 'too_long' END, CASE WHEN t <> '' AND r < 0.5 THEN 'char_rate_low' END, CASE WHEN r > 35 THEN 'char_rate_high' END, CASE WHEN c < 0.5 THEN 'low_confidence' END, CASE WHEN fix THEN 'grounded_correction' END) g FROM y)
SELECT proposal_id, CASE WHEN fix THEN 'correct' WHEN t = '' THEN 'drop' WHEN g <> '' THEN 'review' ELSE 'keep' END AS disposition, g AS reasons FROM z""",
        "diarization_scores": f"""WITH {CUR}, r AS (SELECT source_id || chr(1) || speaker source_id, s, e FROM cur WHERE source_id IS NOT NULL), h AS (SELECT * FROM r WHERE e - s >= 1000), {islands('a', 'r')}, {islands('b', 'h')},
ra AS (SELECT split_part(source_id, chr(1), 1) k, sum(e - s) / 1000 t FROM a GROUP BY 1), hb AS (SELECT split_part(source_id, chr(1), 1) k, sum(e - s) / 1000 t FROM b GROUP BY 1)
SELECT k AS source_id, round(ra.t, 3) AS total, round(ra.t - coalesce(hb.t, 0), 3) AS missed, CAST(0 AS DOUBLE) AS false_alarm, CAST(0 AS DOUBLE) AS confused FROM ra LEFT JOIN hb USING (k)""",
        "drift": f"WITH {P}, x AS (SELECT item_id, proposal_id, regexp_replace(text, '[^ -~]', '?', 'g') h FROM p WHERE text IS NOT NULL), f AS (SELECT item_id, arg_min(h, proposal_id) r FROM x GROUP BY 1) SELECT round(sum(CASE WHEN r = '' THEN length(h) WHEN h = '' THEN length(r) ELSE levenshtein(r, h) END) / sum(length(r)), 9) AS cer FROM x JOIN f USING (item_id)",
        "baseline_time": f"WITH {CUR}, {islands('m', 'cur')} SELECT source_id, round(sum(e - s) / 1000, 3) AS speech, CAST(0 AS BIGINT) AS too_long FROM m WHERE source_id IS NOT NULL GROUP BY 1",
        "live_counts": "WITH a AS (SELECT DISTINCT source_id, arrived_at, asr_id, start_sec, end_sec, text FROM asr_segments WHERE end_sec > start_sec) SELECT source_id AS session, count(*) AS partials, count(*) AS finals, count(*) AS segments FROM a GROUP BY 1 UNION ALL SELECT DISTINCT source_id, 0, 0, 0 FROM diarization_turns WHERE FALSE",
        "fallback_turns": f"WITH {ASR}, x AS (SELECT DISTINCT asr_id, source_id, s, e FROM asr WHERE source_id IS NOT NULL) SELECT source_id AS session, v.t AS type, v.n AS version, 'UNKNOWN' AS speaker, s AS start_ms FROM x, (VALUES ('turn.created', CAST(1 AS BIGINT)), ('turn.committed', CAST(2 AS BIGINT))) v(t, n)",
        "energy_speech": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings), b AS (SELECT vec_id, i, sqrt(list_sum(list_transform(e[i * 8 + 1:i * 8 + 8], lambda x: x * x)) / 8) >= 0.125 loud FROM v, range(0, 8) r(i)),
g AS (SELECT *, sum(CASE WHEN loud THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) k FROM b) SELECT vec_id, round(min(i) * 0.125, 6) AS start, round((max(i) + 1) * 0.125, 6) AS "end" FROM g WHERE loud GROUP BY vec_id, k""",
        "silent_recogniser": "SELECT DISTINCT chunk_id AS key, '' AS text, CAST(0 AS DOUBLE) AS confidence FROM labeled_chunks",
        "mapping_counts": f"WITH gm AS ({SQL['generation_map']}) SELECT status, count(*) AS n FROM gm GROUP BY 1",
        "config_files": "SELECT config_id, CAST(strlen(coalesce(base_model, '')) + 1 AS BIGINT) AS length FROM training_configs",
        "wav_round_trip": "WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) e FROM embeddings) SELECT label, 64 AS rate, CAST(sum(len(e)) AS BIGINT) AS n, round(sum(list_sum(list_transform(e, lambda x: trunc(greatest(-1, least(1, x)) * 32767) / 32768))), 3) AS total FROM v GROUP BY 1",
        "term_index": f"""WITH x AS (SELECT DISTINCT chunk_id, regexp_replace(coalesce(transcript_text, ''), '[^ -~]', ' ', 'g') t FROM labeled_chunks), m AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all(t, '\\b[A-Za-z][A-Za-z0-9_+#.\\-]*\\b'), lambda w: regexp_replace(w, '^[._-]+|[._-]+$', '', 'g'))) w FROM x),
k AS (SELECT DISTINCT chunk_id, lower(w) term FROM m WHERE length(w) >= 2 AND lower(w) NOT IN ({stop}) AND (length(w) <> 2 OR w = upper(w)) AND (regexp_matches(w, '[._+#]') OR w = upper(w) OR length(w) >= 4)) SELECT term, count(*) AS n FROM k GROUP BY 1""",
        "subtitles": """WITH r AS (SELECT segment_id, source_id, start_sec s, end_sec e, text, speaker_id sp, row_number() OVER (PARTITION BY segment_id ORDER BY revision DESC NULLS LAST, emitted_at DESC NULLS LAST) z FROM transcript_segments WHERE is_final),
x AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s NULLS FIRST, e NULLS FIRST, text) n, CAST(round(s * 1000) AS BIGINT) a, CAST(round(e * 1000) AS BIGINT) b FROM r WHERE z = 1 AND trim(text, ' ') <> '')
SELECT source_id, n AS number, CAST(n AS VARCHAR) || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || coalesce(sp || ': ', '') || trim(text, ' ') || chr(10) AS block FROM x""",
        "neighbour_context": f"""WITH {ASR}, x AS (SELECT asr_id, source_id, s, e, coalesce(text, '') t, row_number() OVER w n, s - lag(e) OVER w gap FROM asr WINDOW w AS (PARTITION BY source_id ORDER BY s, e)), y AS (SELECT *, sum(CASE WHEN gap > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY n) run, e - s d FROM x),
c AS (SELECT *, sum(d) OVER (PARTITION BY source_id ORDER BY n) - d before FROM y), j AS (SELECT c.asr_id, c.n, b.n bn, b.t, c.before - b.before used, b.d FROM c JOIN c b ON b.source_id = c.source_id AND b.run = c.run AND b.n < c.n AND (b.n = c.n - 1 OR c.before - b.before <= 4000)),
k AS (SELECT asr_id, n, string_agg(t, ' ' ORDER BY bn) ctx FROM j WHERE bn = n - 1 OR d > 0 OR used < 4000 GROUP BY 1, 2) SELECT c.asr_id, coalesce(ctx, '') AS context FROM c LEFT JOIN k ON k.asr_id = c.asr_id AND k.n = c.n""",
        "merged_short": f"""WITH RECURSIVE {ASR}, x AS (SELECT source_id, asr_id, s, e, row_number() OVER (PARTITION BY source_id ORDER BY s, e) n FROM asr),
w AS (SELECT source_id, n, s, e, CAST(0 AS BIGINT) g, 1 m, e - s tot, e - s <= 3000 open FROM x WHERE n = 1
UNION ALL SELECT x.source_id, x.n, x.s, x.e, CASE WHEN w.open AND w.m < 3 AND x.s - w.e <= 1500 AND w.tot + x.e - x.s <= 12000 THEN w.g ELSE w.g + 1 END, CASE WHEN w.open AND w.m < 3 AND x.s - w.e <= 1500 AND w.tot + x.e - x.s <= 12000 THEN w.m + 1 ELSE 1 END,
CASE WHEN w.open AND w.m < 3 AND x.s - w.e <= 1500 AND w.tot + x.e - x.s <= 12000 THEN w.tot + x.e - x.s ELSE x.e - x.s END, CASE WHEN w.open AND w.m < 3 AND x.s - w.e <= 1500 AND w.tot + x.e - x.s <= 12000 THEN TRUE ELSE x.e - x.s <= 3000 END FROM w JOIN x ON x.source_id = w.source_id AND x.n = w.n + 1)
SELECT x.source_id, x.asr_id, w.g AS group_no FROM w JOIN x USING (source_id, n)""",
    }


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
