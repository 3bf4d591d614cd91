"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tidescribe.llm import bpe, consensus, groups, language, leaks, overlap, spans, streamjoin, turns


def queries() -> dict:
    return {
        "p2_found": groups.p2_found,
        "p2_splits": groups.p2_splits,
        "p3_found": language.p3_found,
        "p3_segments": language.p3_segments,
        "p4_found": overlap.p4_found,
        "p4_report": overlap.p4_report,
        "p5_found": streamjoin.p5_found,
        "p6_found": turns.p6_found,
        "p6_turns": turns.p6_turns,
        "p7_found": consensus.p7_found,
        "p7_items": consensus.p7_items,
        "p7_annotators": consensus.p7_annotators,
        "p8_ids": bpe.p8_ids,
        "p9_found": leaks.p9_found,
        "p9_clean": leaks.p9_clean,
        "p10_found": spans.p10_found,
        "p10_shared": spans.p10_shared,
    }


def oracle_sql() -> dict:
    found, clean = leaks.p9_sql()
    return {"p5_found": streamjoin.P5_SQL, "p2_found": groups.p2_sql(), "p4_found": overlap.p4_sql(), "p9_found": found, "p9_clean": clean, "p10_found": spans.P10_SQL, "p10_shared": spans.P10_SHARED_SQL}
