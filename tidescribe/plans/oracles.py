"""The same queries in ANSI SQL, written on their own."""

import sys

CUR = """cur AS (SELECT source_id, turn_id, speaker_id AS speaker, s, e FROM (
  SELECT *, CAST(round(start_sec * 1000) AS BIGINT) s, CAST(round(end_sec * 1000) AS BIGINT) e,
    row_number() OVER (PARTITION BY turn_id ORDER BY version DESC NULLS LAST, arrived_at DESC NULLS LAST) rn
  FROM (SELECT DISTINCT * FROM diarization_turns)
  WHERE speaker_id IS NOT NULL AND round(end_sec * 1000) > round(start_sec * 1000)) WHERE rn = 1)"""
ASR = """asr AS (SELECT DISTINCT asr_id, source_id, CAST(round(start_sec * 1000) AS BIGINT) s, CAST(round(end_sec * 1000) AS BIGINT) e, text, language
  FROM asr_segments WHERE round(end_sec * 1000) > round(start_sec * 1000))"""


def islands(name: str, src: str, gap: int = 0) -> str:
    return f"""{name}_m AS (SELECT source_id, s, e, CASE WHEN s > max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END g FROM {src}),
{name}_i AS (SELECT *, sum(g) OVER (PARTITION BY source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) i FROM {name}_m),
{name} AS (SELECT source_id, min(s) s, max(e) e FROM {name}_i GROUP BY source_id, i)"""


CLIPS = "clips AS (SELECT DISTINCT * FROM clips_metadata)"
COMMON = f"""WITH {CUR}, {ASR}, {islands('a', 'asr')}, {islands('b', 'cur')},
both_ AS (SELECT a.source_id, sum(least(a.e, b.e) - greatest(a.s, b.s)) c FROM a JOIN b ON a.source_id = b.source_id AND a.s < b.e AND a.e > b.s GROUP BY 1)"""
CENTROID = """parts AS (SELECT CAST(label AS VARCHAR) speaker, i - 1 AS i, avg(CAST(embedding[i] AS DOUBLE)) m FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding) GROUP BY ALL),
norms AS (SELECT speaker, sqrt(sum(m * m)) n FROM parts GROUP BY 1),
cents AS (SELECT parts.speaker, i, m / n AS x FROM parts JOIN norms USING (speaker))"""


def count_chars(ranges: str) -> str:
    return f"CAST(sum(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[{ranges}]', '', 'g'))) AS BIGINT)"


def other_digits() -> str:
    """Class of the digits (of any kind) outside the blocks of the scripts that are counted."""
    blocks = [(0x0E00, 0x0E7F), (0x0400, 0x04FF), (0x0370, 0x03FF), (0x0600, 0x06FF), (0x0900, 0x097F)]
    return "".join(f"\\x{{{p:X}}}" for p in range(sys.maxunicode + 1) if chr(p).isdigit() and not any(a <= p <= b for a, b in blocks))


SQL = {
    "turns_merged": f"WITH {CUR}, {islands('m', 'cur', 500)} SELECT source_id, s AS start_ms, e AS end_ms FROM m",
    "turns_bridged": f"""WITH {CUR}, f AS (SELECT source_id, speaker, CASE WHEN s - lag(e) OVER (PARTITION BY source_id, speaker ORDER BY s, e) > 800 THEN 1 ELSE 0 END g FROM cur)
SELECT source_id, speaker, CAST(sum(g) + 1 AS BIGINT) AS n_groups, count(*) AS n_turns FROM f GROUP BY 1, 2""",
    "speech_gaps": f"""WITH {CUR}, {islands('m', 'cur')} SELECT source_id, e AS start_ms, n AS end_ms FROM (SELECT *, lead(s) OVER (PARTITION BY source_id ORDER BY s) n FROM m) WHERE n - e >= 1000""",
    "speech_union": f"WITH {CUR}, {islands('m', 'cur')} SELECT source_id, CAST(sum(e - s) AS BIGINT) AS covered_ms FROM m GROUP BY 1",
    "speaker_time": f"WITH {CUR} SELECT source_id, speaker, CAST(sum(e - s) AS BIGINT) AS spoken_ms FROM cur GROUP BY 1, 2",
    "overlap_regions": f"""WITH {CUR}, ev AS (SELECT source_id, s t, 1 d FROM cur UNION ALL SELECT source_id, e, -1 FROM cur),
pt AS (SELECT source_id, t, sum(d) d FROM ev GROUP BY 1, 2),
st AS (SELECT source_id, t, sum(d) OVER (PARTITION BY source_id ORDER BY t ROWS UNBOUNDED PRECEDING) act, lead(t) OVER (PARTITION BY source_id ORDER BY t) n FROM pt),
hot AS (SELECT source_id, t s, n e FROM st WHERE act >= 2 AND n IS NOT NULL), {islands('m', 'hot')}
SELECT source_id, s AS start_ms, e AS end_ms FROM m""",
    "asr_speech_overlap": f"{COMMON} SELECT source_id, CAST(c AS BIGINT) AS common_ms FROM both_",
    "speech_without_asr": f"""WITH {CUR}, {ASR}, {islands('a', 'asr')}, {islands('b', 'cur')},
ed AS (SELECT source_id, s t, 1 sp, 0 di FROM b UNION ALL SELECT source_id, e, -1, 0 FROM b UNION ALL SELECT source_id, s, 0, 1 FROM a UNION ALL SELECT source_id, e, 0, -1 FROM a),
pt AS (SELECT source_id, t, sum(sp) sp, sum(di) di FROM ed GROUP BY 1, 2),
st AS (SELECT source_id, t, lead(t) OVER w n, sum(sp) OVER w sp, sum(di) OVER w di FROM pt WINDOW w AS (PARTITION BY source_id ORDER BY t)),
fr AS (SELECT source_id, t s, n e FROM st WHERE sp > 0 AND di = 0), {islands('m', 'fr')} SELECT source_id, s AS start_ms, e AS end_ms FROM m""",
    "asr_speakers": f"""WITH {CUR}, {ASR}, cf AS (SELECT turn_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY version DESC NULLS LAST, arrived_at DESC NULLS LAST) z FROM diarization_turns WHERE speaker_id IS NOT NULL AND confidence IS NOT NULL) WHERE z = 1),
p AS (SELECT asr.asr_id, cur.speaker, least(asr.e, cur.e) - greatest(asr.s, cur.s) o,
  row_number() OVER (PARTITION BY asr.asr_id ORDER BY least(asr.e, cur.e) - greatest(asr.s, cur.s) DESC, coalesce(cf.confidence, 0) DESC, cur.s, cur.turn_id) r
  FROM asr JOIN cur ON asr.source_id = cur.source_id LEFT JOIN cf ON cf.turn_id = cur.turn_id WHERE asr.s < cur.e AND asr.e > cur.s)
SELECT asr.asr_id, coalesce(p.speaker, 'UNKNOWN') AS speaker, coalesce(p.o, 0) AS overlap_ms FROM asr LEFT JOIN p ON asr.asr_id = p.asr_id AND p.r = 1""",
    "asr_risky_boundaries": f"""WITH {CUR}, {ASR}, q AS (SELECT source_id, e, lead(s) OVER (PARTITION BY source_id ORDER BY s, e) n FROM asr)
SELECT source_id, count(*) AS risky FROM q WHERE n IS NOT NULL AND EXISTS (SELECT 1 FROM cur WHERE cur.source_id = q.source_id AND q.e > cur.s + 250 AND q.e < cur.e - 250) GROUP BY 1""",
    "asr_durations": f"""WITH {ASR} SELECT language, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS total_ms, round(avg(e - s), 6) AS mean_ms, CAST(quantile_cont(e - s, 0.5) AS DOUBLE) AS p50,
CAST(quantile_disc(e - s, 0.95) AS DOUBLE) AS p95, CAST(max(e - s) AS DOUBLE) AS longest FROM asr GROUP BY 1""",
    "scorecard": f"""{COMMON}, seg AS (SELECT source_id, sum(e - s) raw, count(*) n, count(*) FILTER (WHERE e - s > 25000) l FROM asr GROUP BY 1),
cov AS (SELECT source_id, sum(e - s) w FROM a GROUP BY 1), ref AS (SELECT source_id, sum(e - s) f FROM b GROUP BY 1)
SELECT source_id, CAST(f AS BIGINT) AS reference, CAST(coalesce(c, 0) AS BIGINT) AS retained, CAST(f - coalesce(c, 0) AS BIGINT) AS missed,
CAST(coalesce(raw, 0) - coalesce(w, 0) AS BIGINT) AS duplicated, CAST(coalesce(n, 0) AS BIGINT) AS chunks, CAST(coalesce(l, 0) AS BIGINT) AS long_chunks
FROM ref LEFT JOIN both_ USING (source_id) LEFT JOIN seg USING (source_id) LEFT JOIN cov USING (source_id)""",
    "segments_latest": """SELECT segment_id, revision, source_id, is_final, text FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY revision DESC NULLS LAST, emitted_at DESC NULLS LAST) r FROM (SELECT DISTINCT * FROM transcript_segments)) WHERE r = 1""",
    "duplicate_audio": f"WITH {CLIPS} SELECT audio_sha256, count(*) AS copies, count(DISTINCT lower(trim(text))) AS texts FROM clips GROUP BY 1 HAVING count(*) > 1",
    "manifest_counts": f"""WITH {CLIPS}, g AS (SELECT DISTINCT audio_sha256 FROM clips WHERE file_name LIKE 'test/%' AND audio_sha256 IS NOT NULL),
n AS (SELECT audio_sha256, count(*) k FROM clips WHERE audio_sha256 IS NOT NULL GROUP BY 1),
x AS (SELECT clip_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')) t, CASE WHEN speech_duration > 0 AND isfinite(speech_duration) THEN speech_duration END d, audio_sha256 FROM clips),
y AS (SELECT t, d, length(replace(t, ' ', '')) / d r, coalesce(n.k > 1, FALSE) dup, x.audio_sha256 IS NULL bad, g.audio_sha256 IS NOT NULL pro FROM x LEFT JOIN n ON n.audio_sha256 = x.audio_sha256 LEFT JOIN g ON g.audio_sha256 = x.audio_sha256),
z AS (SELECT concat_ws(',', CASE WHEN t = '' THEN 'empty_label' END, CASE WHEN d IS NULL THEN 'invalid_duration' END, CASE WHEN d < 0.15 THEN 'too_short' END, CASE WHEN d > 30 THEN 'too_long' END,
  CASE WHEN t <> '' AND r < 0.5 THEN 'char_rate_low' END, CASE WHEN r > 35 THEN 'char_rate_high' END, CASE WHEN dup THEN 'duplicate_content' END, CASE WHEN bad THEN 'malformed_input' END, CASE WHEN pro THEN 'protected_gold_overlap' END) reasons, pro, t FROM y)
SELECT CASE WHEN pro OR t = '' THEN 'drop' WHEN reasons <> '' THEN 'review' ELSE 'keep' END AS disposition, reasons, count(*) AS n FROM z GROUP BY 1, 2""",
    "generation_map": f"""WITH {CLIPS}, o AS (SELECT * FROM clips WHERE source_id IS NOT NULL AND exported_at < TIMESTAMP '2026-04-01'), w AS (SELECT * FROM clips WHERE source_id IS NOT NULL AND exported_at >= TIMESTAMP '2026-04-01' AND source_end > source_start),
p AS (SELECT o.clip_id, w.clip_id nc, abs(o.source_start - w.source_start) <= 1e-6 AND abs(o.source_end - w.source_end) <= 1e-6 ex, least(o.source_end, w.source_end) - greatest(o.source_start, w.source_start) > 0 ov, lower(o.audio_sha256) = lower(w.audio_sha256) sa
  FROM o JOIN w ON o.source_id = w.source_id AND o.source_end > o.source_start AND w.source_start < o.source_end + 1e-6 AND w.source_end > o.source_start - 1e-6),
c AS (SELECT clip_id, count(*) FILTER (WHERE ex) ne, count(*) FILTER (WHERE ov) no, count(*) FILTER (WHERE ex AND sa) ns, min(nc) FILTER (WHERE ex) ec, min(nc) FILTER (WHERE ov) oc FROM p GROUP BY 1)
SELECT o.clip_id, CASE WHEN ne = 1 AND ns = 1 THEN 'unchanged' WHEN ne >= 1 OR no > 1 THEN 'ambiguous' ELSE 'changed_boundary_needs_relabel' END AS status,
CASE WHEN ne = 1 THEN ec WHEN ne = 0 AND no = 1 THEN oc END AS new_clip_id FROM o LEFT JOIN c USING (clip_id)""",
    "label_consensus": """WITH r AS (SELECT DISTINCT proposal_id, item_id, method, lower(trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) t FROM proposed_labels),
g AS (SELECT item_id, t, count(*) n, count(DISTINCT method) v FROM r WHERE t <> '' GROUP BY 1, 2),
h AS (SELECT *, sum(n) OVER (PARTITION BY item_id) tot, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, t) k FROM g)
SELECT item_id, n, v AS views, CAST(tot AS BIGINT) AS total, round(n / tot, 9) AS fraction FROM h WHERE k = 1 AND n >= 2 AND v >= 2""",
    "sources_in_both": f"WITH {CLIPS} SELECT source_id FROM clips WHERE trim(source_id) <> '' AND file_name LIKE 'train/%' INTERSECT SELECT source_id FROM clips WHERE trim(source_id) <> '' AND file_name LIKE 'test/%'",
    "sources_without_turns": f"WITH {CUR} SELECT source_id FROM sources WHERE source_id NOT IN (SELECT source_id FROM cur WHERE source_id IS NOT NULL)",
    "source_split": f"""WITH {CLIPS}, s AS (SELECT DISTINCT source_id FROM clips WHERE trim(source_id) <> ''), k AS (SELECT source_id, row_number() OVER (ORDER BY sha256('17' || chr(31) || source_id), source_id) r, count(*) OVER () n FROM s)
SELECT clip_id, r <= greatest(1, least(n - 1, round(n * 0.1))) AS held_out FROM (SELECT DISTINCT clip_id, source_id, file_name, text, source_file, source_start, source_end, speech_duration, language, audio_sha256, training_eligible, exported_at FROM clips) c LEFT JOIN k ON k.source_id = c.source_id""",
    "selection_report": f"""WITH {CLIPS} SELECT CASE WHEN strpos(replace(file_name, '\\', '/'), '/') > 0 THEN split_part(replace(file_name, '\\', '/'), '/', 1) ELSE 'train' END AS split,
CASE WHEN training_eligible IS NULL THEN 'legacy' WHEN training_eligible THEN 'included' ELSE 'excluded' END AS state, count(*) AS "rows", count(DISTINCT source_id) AS sources FROM clips GROUP BY 1, 2""",
    "fastest_clips": f"WITH {CLIPS} SELECT clip_id, round(length(text) / speech_duration, 6) AS rate FROM clips ORDER BY coalesce(round(length(text) / speech_duration, 6), -1) DESC, CAST(clip_id AS VARCHAR) DESC LIMIT 10",
    "rolling_prompts": f"""WITH {ASR} SELECT asr_id, right(coalesce(array_to_string(list(text) OVER (PARTITION BY source_id ORDER BY s, asr_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' '), ''), 600) AS prompt FROM asr WHERE text IS NOT NULL""",
    "top_languages": "SELECT language, count(*) AS n FROM (SELECT DISTINCT chunk_id, language FROM labeled_chunks) WHERE language IS NOT NULL GROUP BY 1 ORDER BY n DESC, language LIMIT 12",
    "chunk_status": "SELECT boundary_method, count(*) AS n, count(*) FILTER (WHERE round(source_end * 1000) - round(source_start * 1000) <= 3000) AS n_short FROM (SELECT DISTINCT chunk_id, boundary_method, source_start, source_end FROM labeled_chunks) GROUP BY 1",
    "script_counts": f"""SELECT kind, {count_chars('฀-๿')} AS thai, {count_chars('A-Za-z')} AS latin, {count_chars('぀-ゟ')} AS hiragana, {count_chars('゠-ヿㇰ-ㇿ')} AS katakana, {count_chars('㐀-䶿一-鿿')} AS cjk,
{count_chars('가-힯')} AS hangul, {count_chars('Ѐ-ӿ')} AS cyrillic, {count_chars(other_digits())} AS digit FROM documents GROUP BY 1""",
    "import_preview": """WITH r AS (SELECT DISTINCT proposal_id, CAST(item_id AS VARCHAR) AS key, method, CASE WHEN trim(coalesce(text, '')) = '' THEN 'reject' ELSE 'correct' END AS act, lower(trim(text)) lab, submitted_at FROM proposed_labels),
c AS (SELECT *, row_number() OVER (PARTITION BY key, method ORDER BY CAST(submitted_at AS VARCHAR) DESC, proposal_id) k FROM r),
o AS (SELECT * FROM c WHERE k = 1 AND method = 'manual'), t AS (SELECT * FROM c WHERE k = 1 AND method = 'audio_replay'), w AS (SELECT DISTINCT key FROM r WHERE method IN ('manual', 'spelling_fix'))
SELECT CASE WHEN w.key IS NULL THEN 'unmatched' WHEN o.key IS NULL THEN 'new' WHEN o.act = t.act AND o.lab IS NOT DISTINCT FROM t.lab THEN 'unchanged' ELSE 'conflict' END AS state, count(*) AS n FROM t LEFT JOIN o USING (key) LEFT JOIN w USING (key) GROUP BY 1""",
    "review_actions": """WITH r AS (SELECT DISTINCT proposal_id, item_id, annotator_id, text, submitted_at FROM proposed_labels), f AS (SELECT item_id, arg_min_null(text, proposal_id) AS orig FROM r GROUP BY 1)
SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'reject' WHEN trim(text) = trim(coalesce(orig, '')) THEN 'accept' ELSE 'correct' END AS action, count(*) AS n FROM r JOIN f USING (item_id) GROUP BY 1""",
    "embedding_centroids": f"WITH {CENTROID} SELECT speaker, i, round(x, 5) AS x FROM cents",
    "embedding_nearest": f"""WITH {CENTROID}, c AS (SELECT speaker, list(x ORDER BY i) v FROM cents GROUP BY 1), q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings),
d AS (SELECT vec_id, speaker, 1 - list_inner_product(e, v) / sqrt(list_inner_product(e, e)) dist FROM q, c)
SELECT vec_id, CASE WHEN min(dist) <= 0.75 THEN arg_min(speaker, dist) END AS speaker, round(min(dist), 5) AS distance, CASE WHEN min(dist) <= 0.75 THEN round(greatest(0, least(1, 1 - min(dist) / 0.75)), 5) ELSE 0 END AS confidence FROM d GROUP BY 1""",
    "speaker_runs": f"""WITH {CUR}, f AS (SELECT source_id, speaker, s, e, CASE WHEN lag(speaker) OVER w <> speaker OR s > max(e) OVER (PARTITION BY source_id ORDER BY s, e, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1000 THEN 1 ELSE 0 END g FROM cur WINDOW w AS (PARTITION BY source_id ORDER BY s, e, speaker)),
h AS (SELECT *, sum(g) OVER (PARTITION BY source_id ORDER BY s, e, speaker ROWS UNBOUNDED PRECEDING) i FROM f), r AS (SELECT source_id, i, any_value(speaker) speaker, min(s) s, max(e) e FROM h GROUP BY 1, 2),
q AS (SELECT source_id, max(e) OVER (PARTITION BY source_id ORDER BY i ROWS UNBOUNDED PRECEDING) s, lead(s) OVER (PARTITION BY source_id ORDER BY i) e FROM r)
SELECT source_id, speaker, s AS start_ms, e AS end_ms FROM r UNION ALL SELECT source_id, NULL, s, e FROM q WHERE e > s""",
    "event_windows": """WITH c AS (SELECT source_id, i * 10.0 s, least(i * 10.0 + 10, duration_seconds) e FROM (SELECT source_id, duration_seconds, unnest(range(0, CAST(greatest(0, ceil((duration_seconds - 10) / 10)) AS BIGINT) + 1)) i FROM sources WHERE duration_seconds > 0)),
x AS (SELECT source_id, s, e, unnest(range(CAST(greatest(0, ceil((e - 60) / 20)) AS BIGINT), CAST(floor(s / 20) AS BIGINT) + 1)) w FROM c)
SELECT source_id, w * 20 AS start_s, count(*) AS n FROM x GROUP BY source_id, w HAVING min(s) <= w * 20 AND max(e) >= w * 20 + 60""",
    "event_percentiles": """SELECT event_type, count(*) AS hops, round(quantile_cont(value, 0.5), 6) AS runtime_p50, round(quantile_cont(value, 0.95), 6) AS runtime_p95,
round(quantile_cont(CAST(floor(second(ts)) AS DOUBLE), 0.5), 6) AS latency_p50, round(quantile_cont(CAST(floor(second(ts)) AS DOUBLE), 0.95), 6) AS latency_p95 FROM events GROUP BY 1""",
    "turns_with_words": f"""WITH {CUR}, {ASR} SELECT source_id, count(*) AS n FROM cur WHERE EXISTS (SELECT 1 FROM asr WHERE asr.source_id = cur.source_id AND asr.s < cur.e AND asr.e > cur.s) GROUP BY 1""",
    "queue_sizes": f"""WITH {CLIPS}, n AS (SELECT audio_sha256, count(*) n FROM clips GROUP BY 1),
x AS (SELECT n, CASE WHEN trim(coalesce(text, '')) = '' THEN 'drop' WHEN n > 1 OR speech_duration > 20 THEN 'review' ELSE 'keep' END d FROM clips JOIN n USING (audio_sha256))
SELECT count(*) AS "all", count(*) FILTER (WHERE d = 'review') AS review, count(*) FILTER (WHERE d = 'drop') AS "drop", count(*) FILTER (WHERE d = 'correct') AS correct, count(*) FILTER (WHERE d = 'keep') AS keep,
count(*) FILTER (WHERE n > 1) AS reviewed, count(*) FILTER (WHERE n <= 1) AS unreviewed FROM x""",
}
