"""The core's queries and their SQL."""

from __future__ import annotations

from tidescribe.operators import coverage
from tidescribe.plans import oracles
from tidescribe.plans import queries as q
from tidescribe.plans import more_queries, record_queries, text_queries

FLAGSHIP = "manifest_counts"
NAMES = [
    "turns_merged", "turns_bridged", "speech_gaps", "speech_union", "speaker_time", "overlap_regions", "asr_speech_overlap", "speech_without_asr", "asr_speakers", "asr_risky_boundaries",
    "asr_durations", "scorecard", "segments_latest", "duplicate_audio", "manifest", "manifest_counts", "generation_map", "label_consensus", "sources_in_both", "sources_without_turns",
    "source_split", "selection_report", "fastest_clips", "rolling_prompts", "top_languages", "chunk_status", "script_counts", "import_preview", "review_actions", "embedding_centroids",
    "embedding_nearest", "speech_windows", "boundary_scores", "speaker_runs", "live_transcript", "subtitles", "term_counts", "language_spans", "neighbour_context",
    "merged_short", "event_windows", "speaker_identities", "text_identities", "event_percentiles", "turns_with_words", "window_evidence", "queue_sizes",
]


def queries() -> dict:
    return {"p1_found": coverage.p1_found} | {n: getattr(q, n) for n in NAMES} | text_queries.queries() | record_queries.queries() | more_queries.queries()


def oracle_sql() -> dict:
    return {"p1_found": coverage.P1_SQL} | oracles.SQL | text_queries.sql() | record_queries.SQL | more_queries.sql()
