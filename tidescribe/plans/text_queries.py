"""Queries over the text, number and JSON functions on whole tables, and their SQL.

The SQL is written on its own: NFKC, case folding, scripts and language routes are relations of
code points derived from the Unicode database by rule (`unicode_tables`), joined character by
character; edits of texts and tokens are counted after each pair's symbols are renumbered, as the
SQL engine's distance counts bytes.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescribe.functions import numeric as nu
from tidescribe.functions import text as tx
from tidescribe.operators import evaluate, quality
from tidescribe.runtime import table


def clips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clips_metadata").distinct()


def proposals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "proposed_labels").distinct()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labeled_chunks").distinct()


def label_identities(spark, d):
    """STR01, STR02: identity of every proposal's label; a null label counts as ''."""
    return proposals(spark, d).select("proposal_id", tx.content_identity(F.col("text")).alias("identity"))


def evaluation_texts(spark, d):
    """STR11: every clip's text as it is evaluated, with and without spaces."""
    rows = clips(spark, d).select("clip_id", F.coalesce("text", F.lit("")).alias("t"))
    return rows.select("clip_id", tx.evaluation_text(F.col("t")).alias("evaluated"), tx.no_space(F.col("t")).alias("no_space"))


def source_identities(spark, d):
    """STR03, STR22: identity of every clip's source path and clip, its path key and a safe name of it."""
    rows = clips(spark, d).select("clip_id", F.coalesce("source_file", F.lit("")).alias("f"), F.col("clip_id").cast("string").alias("r"))
    return rows.select("clip_id", tx.source_identity(F.col("f"), F.col("r")).alias("identity"), tx.path_key(F.col("f"), "missing").alias("path_key"), tx.safe_name(F.col("f")).alias("safe_name"))


def clip_keys(spark, d):
    """STR24, STR26: chunk keys of both forms and the identity of every clip's row."""
    rows = clips(spark, d)
    end, start = F.col("source_end"), F.col("source_start")
    return rows.select(
        "clip_id", tx.chunk_key(F.col("audio_sha256"), start, end, F.col("source_file")).alias("key_v3"), tx.chunk_key(F.col("audio_sha256"), start, end).alias("key_v2"),
        tx.row_identity(F.lit(None).cast("string"), F.col("source_id"), F.round(start * 1000).cast("long"), F.round(end * 1000).cast("long"), F.col("clip_id")).alias("identity"),
    )


def script_shares(spark, d):
    """STR04, STR05: share of every script among the letters of a chunk."""
    rows = chunks(spark, d).select("chunk_id", F.explode(tx.script_profile(F.col("transcript_text"))).alias("script", "share"))
    return rows.select("chunk_id", "script", F.round("share", 9).alias("share"))


def foreign_scripts(spark, d):
    """STR06, AG03: characters of other scripts than Thai and Latin per kind of document."""
    return evaluate.script_totals(table(spark, d, "documents"), "text", "kind")


def language_stretches(spark, d):
    """STR07, STR08: every span of one language of every chunk, with its offsets."""
    rows = chunks(spark, d).select("chunk_id", F.explode(tx.script_spans(F.col("transcript_text"))).alias("s"))
    return rows.select("chunk_id", F.col("s.language").alias("language"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"))


def repaired_texts(spark, d):
    """STR09, STR10: documents that word-wise spacing or repeated connectors change, and their repaired text."""
    rows = table(spark, d, "documents").select("doc_id", "text").withColumn("repaired", tx.collapse_hesitation(tx.thai_spacing(F.col("text"))))
    spaced = F.concat_ws(" ", F.split(F.col("text"), ""))
    rows = rows.withColumns({"spaced": tx.thai_spacing(spaced), "thrice": tx.collapse_hesitation(F.concat(F.lit("ก็ ก็ก็"), F.left("text", F.lit(40))))})
    return rows.filter("text <> ''").select("doc_id", F.sha2("repaired", 256).alias("repaired"), F.sha2("spaced", 256).alias("despaced"), F.sha2("thrice", 256).alias("thrice"))


def token_lists(spark, d):
    """STR12: tokens of every proposal's label."""
    rows = proposals(spark, d).select("proposal_id", tx.tokens(tx.evaluation_text(F.coalesce("text", F.lit("")))).alias("t"))
    return rows.select("proposal_id", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("tokens"))


def evaluated_terms(spark, d):
    """STR13, STR14: technical terms of the chunks as an evaluation counts them, and how many chunks have each."""
    rows = chunks(spark, d).select("chunk_id", F.explode(tx.evaluated_terms(F.coalesce("transcript_text", F.lit("")))).alias("term")).select("chunk_id", F.lower("term").alias("term")).distinct()
    return rows.groupBy("term").agg(F.count("*").alias("n"))


def compact_texts(spark, d):
    """STR15: letters, marks and numbers of every chunk."""
    return chunks(spark, d).select("chunk_id", tx.compact(F.col("transcript_text")).alias("compact"))


def copied_contexts(spark, d):
    """STR17, STR18: characters that a chunk's text copies from the end of the same source's longest chunk, and that one's tail."""
    rows = chunks(spark, d).filter("transcript_text is not null and source_id is not null")
    longest = rows.groupBy("source_id").agg(F.max_by("transcript_text", F.struct(F.length("transcript_text"), "chunk_id")).alias("context"))
    rows = rows.join(longest, "source_id")
    return rows.select("chunk_id", tx.copied_context(F.col("transcript_text"), F.col("context")).cast("long").alias("copied"), tx.tail(F.col("context"), 40).alias("tail"), tx.tail(F.col("context"), 40, False).alias("plain_tail"))


def live_prompts(spark, d):
    """STR19, STR20, STR25: a prompt for every recognised segment from its words as terms and its text as transcript."""
    rows = table(spark, d, "asr_segments").select("asr_id", "text", F.coalesce("words.word", F.array().cast("array<string>")).alias("w")).dropDuplicates(["asr_id"])
    line = tx.terms_line(F.col("w"), 60)
    return rows.select("asr_id", F.coalesce(line, F.lit("")).alias("line"), tx.prompt(F.lit("Keep  technical terms as they are spoken in the meeting"), F.col("w"), F.col("text"), 120, 60).alias("prompt"))


def replacements(spark, d):
    """STR21, ST20: revisions of transcript segments and whether the later text may take the earlier one's place."""
    rows = table(spark, d, "transcript_segments").select("segment_id", "revision", "text").distinct()
    one = rows.groupBy("segment_id", "revision").agg(F.max("text").alias("text"))
    pairs = one.join(one.select("segment_id", (F.col("revision") - 1).alias("revision"), F.col("text").alias("later")), ["segment_id", "revision"])
    return pairs.select("segment_id", "revision", tx.rejects_replacement(F.col("text"), F.col("later")).alias("rejected"))


def label_languages(spark, d):
    """STR23: chunks per language that their label's spelling names."""
    rows = chunks(spark, d).select("chunk_id", "language").distinct()
    return rows.groupBy(tx.language_name(F.col("language")).alias("name")).agg(F.count("*").alias("n"))


def label_errors(spark, d):
    """NUM01, NUM02, STR11, STR12: edits of every proposal against the first proposal of its item: characters, without spaces, tokens."""
    rows = proposals(spark, d)
    first = rows.groupBy("item_id").agg(F.min_by(F.coalesce("text", F.lit("")), "proposal_id").alias("reference"))
    out = evaluate.scores(rows.select("proposal_id", "item_id", "text").join(first, "item_id"), "reference", "text")
    rounded = [F.round(c, 9).alias(c) for c in ("cer", "cer_no_space", "wer")]
    return out.select("proposal_id", "char_edits", "ref_chars", "bare_edits", "bare_chars", "token_edits", "ref_tokens", *rounded)


def error_summary(spark, d):
    """AG02, AG03: mean and micro rates per method and subset (overall, short texts, those with technical terms)."""
    rows = proposals(spark, d)
    first = rows.groupBy("item_id").agg(F.min_by(F.coalesce("text", F.lit("")), "proposal_id").alias("reference"))
    rows = evaluate.scores(rows.select("proposal_id", "item_id", "text", F.col("method").alias("strategy")).join(first, "item_id"), "reference", "text")
    out = evaluate.strategy_summary(rows, F.length("reference") <= 40, evaluate.has_term(F.col("reference")))
    return out.select("strategy", "subset", "n", *[F.round(c, 9).alias(c) for c in ("mean_cer", "micro_cer", "mean_wer", "micro_wer", "micro_cer_no_space")])


def annotator_scores(spark, d):
    """NUM01, NUM02, AG02, AG04: every proposal against its item's consensus text, summed per method."""
    rows = proposals(spark, d).select("proposal_id", "item_id", "method", "text")
    best = quality.consensus(rows, "item_id", "method", "text").select("item_id", F.col("text_key").alias("reference"))
    out = evaluate.summary(evaluate.scores(rows.join(best, "item_id"), "reference", "text"), "method")
    return out.select("method", "n", *[F.round(c, 9).alias(c) for c in ("mean_cer", "micro_cer", "mean_wer", "micro_wer", "micro_cer_no_space")])


def consensus_texts(spark, d):
    """AG04: the consensus text itself, by case folding."""
    out = quality.consensus(proposals(spark, d).select("proposal_id", "item_id", "method", "text"), "item_id", "method", "text")
    return out.select("item_id", "text_key", "n", "views")


def segment_arithmetic(spark, d):
    """NUM03, NUM04, NUM05, NUM11: durations, distance to the sources' middle, overlap with its first minute, all to six decimals."""
    rows = table(spark, d, "asr_segments").join(table(spark, d, "sources").select("source_id", "duration_seconds"), "source_id").dropDuplicates(["asr_id"])
    s, e, middle = F.col("start_sec"), F.col("end_sec"), nu.to_number(F.col("duration_seconds").cast("string")) / 2
    return rows.select(
        "asr_id", nu.six(nu.duration(s, e)).alias("seconds"), nu.six(nu.overlap(s, e, F.lit(0.0), F.lit(60.0))).alias("early"), nu.six(F.abs(s - middle)).alias("off"),
        nu.six(nu.match_confidence(F.abs(s - middle) / 1000, 0.38)).alias("near"),
    )


def vector_numbers(spark, d):
    """NUM06, NUM09, NUM12, NUM13: the vectors as sound: root mean square, resampled to a quarter, as 16-bit PCM and back, unit length."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    pcm = F.arrow_udf(_through_pcm, "array<double>")
    rows = rows.select("vec_id", "e", nu.resample(F.col("e"), F.lit(64), F.lit(16)).alias("q"), pcm(F.col("e")).alias("p"), nu.unit_vector(F.col("e")).alias("u"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", F.round(nu.rms(F.col("e")), 6).alias("rms"), F.size("q").cast("long").alias("n"), F.round(total("q"), 4).alias("quarter"), F.round(total("p"), 6).alias("pcm"), F.round(F.element_at("u", 1), 6).alias("first"))


def _through_pcm(col):
    import pyarrow as pa

    return pa.array([nu.mono_floats(nu.to_pcm16(v)) for v in col.to_pylist()], pa.list_(pa.float64()))


def json_fields(spark, d):
    """JSN01, JSN02, JSN03: proposals as JSON records and as a model's answer, read back."""
    rows = proposals(spark, d)
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("transcript_text"), F.col("method").alias("language"))), F.lit("\n```"))
    v = F.parse_json(nu.json_record("proposal_id", "confidence", "text"))
    rows = rows.select("proposal_id", nu.response_fields(answer).alias("r"), nu.lenient_list(F.to_json("evidence_refs")).alias("refs"), F.variant_get(v, "$.confidence", "double").alias("confidence"), nu.lenient_list(F.col("method")).alias("one"))
    return rows.select("proposal_id", "confidence", F.col("r.text").alias("text"), F.col("r.language").alias("method"), F.array_join("refs", "|").alias("refs"), F.array_join("one", "|").alias("one"))


QUERIES = [
    label_identities, evaluation_texts, source_identities, clip_keys, script_shares, foreign_scripts, language_stretches, repaired_texts, token_lists, evaluated_terms, compact_texts, copied_contexts, live_prompts, replacements,
    label_languages, label_errors, error_summary, annotator_scores, consensus_texts, segment_arithmetic, vector_numbers, json_fields,
]


# --- the same in SQL


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def runs(points: list[int]) -> list[tuple[int, int]]:
    """Whole numbers as ranges."""
    held = set(points)
    return list(zip([p for p in points if p - 1 not in held], [p for p in points if p + 1 not in held]))


def char_class(points: list[int]) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs(points))


@functools.cache
def unicode_tables() -> dict[str, str]:
    """CTEs nk (compatibility decompositions), cf (case folds) and sc (script ranges), and classes of characters, from the Unicode database."""
    every = [chr(p) for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p)) not in ("Cs", "Cn", "Co")]
    nk = [(c, unicodedata.normalize("NFKD", c)) for c in every if unicodedata.decomposition(c).startswith("<")]
    cf = [(c, c.casefold()) for c in every if c.casefold() != c]

    def script(c: str) -> str:
        p, name = ord(c), unicodedata.name(c, "")
        if 0x3400 <= p <= 0x4DBF or 0x4E00 <= p <= 0x9FFF or 0x20000 <= p <= 0x323AF:
            return "han"
        return next((w for w in ("thai", "hiragana", "katakana", "hangul", "arabic", "hebrew", "cyrillic", "latin") if w.upper() in name), "other")

    def route(c: str) -> str:
        if c.isspace():
            return ""
        s = script(c)
        if s == "thai":
            return "thai"
        if s in ("han", "hiragana", "katakana") or c == "々":
            return "japanese"
        return "english" if s == "latin" else "go" if unicodedata.category(c)[0] == "M" or c.isdigit() or c in "'’-_" else ""

    def ranged(name: str, value, chars: list[str]) -> str:
        by: dict[str, list[int]] = {}
        for c in chars:
            by.setdefault(value(c), []).append(ord(c))
        rows = [f"({a},{b},'{v}')" for v, points in by.items() if v for a, b in runs(points)]
        return f"{name}(lo, hi, v) AS (VALUES {','.join(rows)})"

    pairs = lambda name, rows: f"{name}(c, r) AS (VALUES {','.join(f'({quoted(a)},{quoted(b)})' for a, b in rows)})"
    digits = [ord(c) for c in every if c.isdigit()]
    marks = [ord(c) for c in every if unicodedata.category(c)[0] == "M"]
    thai_marks = [p for p in marks if 0xE00 <= p <= 0xE7F]
    thai = [p for p in range(0xE00, 0xE80) if unicodedata.category(chr(p))[0] not in "PS"]
    return {
        "nk": pairs("nk", nk), "cf": pairs("cf", cf), "sc": ranged("sc", script, [c for c in every if c.isalpha()]), "rt": ranged("rt", route, every),
        "digits": char_class(digits), "other_marks": char_class([p for p in marks if p not in thai_marks]), "thai_marks": char_class(thai_marks), "thai": char_class(thai),
    }


SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'), ' ')"


def mapped(name: str, src: str, key: str, col: str, table_: str, form: str = "{}") -> str:
    """CTE ``name(k, t)``: each character of a text replaced by a relation's value."""
    return f"""{name}_c AS (SELECT {key} k, unnest(string_split({col}, '')) ch, generate_subscripts(string_split({col}, ''), 1) i FROM {src}),
{name} AS (SELECT k, {form.format("string_agg(coalesce(r, ch), '' ORDER BY i)")} t FROM {name}_c LEFT JOIN {table_} ON ch = c GROUP BY k)"""


def nfkc(name: str, src: str, key: str, col: str) -> str:
    return mapped(name, src, key, f"coalesce({col}, '')", "nk", "nfc_normalize({})")


#: One-byte symbols that stand for the characters or tokens of a pair.
SYMBOLS = quoted("".join(chr(i) for i in [*range(33, 127), *range(1, 33)]))


def coded(a: str, b: str) -> str:
    """Edits between two texts: the pair's characters renumbered to one byte each."""
    own = f"array_to_string(list_distinct(string_split({a} || {b}, '')), '')"
    return f"CASE WHEN {a} = '' THEN length({b}) WHEN {b} = '' THEN length({a}) ELSE levenshtein(translate({a}, {own}, {SYMBOLS}), translate({b}, {own}, {SYMBOLS})) END"


def coded_lists(a: str, b: str, own: str) -> str:
    """Edits between two lists, ``own`` being a column with the distinct values of both."""
    one = lambda z: f"array_to_string(list_transform({z}, lambda c: substr({SYMBOLS}, CAST(list_position({own}, c) AS BIGINT), 1)), '')"
    return f"CASE WHEN len({a}) = 0 THEN len({b}) WHEN len({b}) = 0 THEN len({a}) ELSE levenshtein({one(a)}, {one(b)}) END"


P = "p AS (SELECT DISTINCT * FROM proposed_labels)"
C = "c AS (SELECT DISTINCT * FROM clips_metadata)"
K = "q AS (SELECT DISTINCT * FROM labeled_chunks)"


def _scores_sql(reference: str, u: dict[str, str]) -> str:
    """CTEs down to ``s``: edits and lengths of rows ``k, g, ref, hyp`` named x."""
    tokens = f"(?:[A-Za-z{u['digits']}]+|[{u['thai']}][{u['thai_marks']}]*|[^\\s\\p{{P}}\\p{{S}}])(?:[\\s\\p{{P}}\\p{{S}}]*[{u['other_marks']}])*"
    toks = lambda t: f"list_transform(regexp_extract_all({t}, '{tokens}'), lambda w: regexp_replace(w, '[\\s\\p{{P}}\\p{{S}}]+', '', 'g'))"
    return f"""{u['nk']}, {P}, {reference}, {nfkc('nr', 'x', 'k', 'ref')}, {nfkc('nh', 'x', 'k', 'hyp')},
e AS (SELECT x.k, x.g, {collapsed('lower(nr.t)')} r, {collapsed('lower(nh.t)')} h FROM x JOIN nr USING (k) JOIN nh USING (k)),
e2 AS (SELECT *, replace(r, ' ', '') rb, replace(h, ' ', '') hb, {toks('r')} rt, {toks('h')} ht FROM e), e3 AS (SELECT *, list_distinct(list_concat(rt, ht)) own FROM e2),
s AS (SELECT k, g, r, CAST({coded('r', 'h')} AS BIGINT) char_edits, length(r) ref_chars, CAST({coded('rb', 'hb')} AS BIGINT) bare_edits, length(rb) bare_chars, CAST({coded_lists('rt', 'ht', 'own')} AS BIGINT) token_edits, CAST(len(rt) AS BIGINT) ref_tokens FROM e3)"""


RATES = "round(avg(char_edits / nullif(ref_chars, 0)), 9) AS mean_cer, round(sum(char_edits) / nullif(sum(ref_chars), 0), 9) AS micro_cer, round(avg(token_edits / nullif(ref_tokens, 0)), 9) AS mean_wer, round(sum(token_edits) / nullif(sum(ref_tokens), 0), 9) AS micro_wer, round(sum(bare_edits) / nullif(sum(bare_chars), 0), 9) AS micro_cer_no_space"
FIRST = "f AS (SELECT item_id, arg_min(coalesce(text, ''), proposal_id) ref FROM p GROUP BY 1)"


def sql() -> dict[str, str]:
    u = unicode_tables()
    tokens = f"(?:[A-Za-z{u['digits']}]+|[{u['thai']}][{u['thai_marks']}]*|[^\\s\\p{{P}}\\p{{S}}])(?:[\\s\\p{{P}}\\p{{S}}]*[{u['other_marks']}])*"
    T = "[\\x{E00}-\\x{E7F}]"
    hes = lambda x: functools.reduce(lambda t, w: f"regexp_replace({t}, '{w}(?:{SPACE}*{w}){{2,}}', '{w}', 'g')", tx.HESITATIONS, x)
    stop = ", ".join(quoted(w) for w in tx.COMMON_WORDS)
    term = f"length(w) >= 2 AND lower(w) NOT IN ({stop}) AND (length(w) <> 2 OR w = upper(w)) AND (regexp_matches(w, '[._+#]') OR w = upper(w) OR length(w) >= 4)"
    terms = lambda t: f"list_filter(list_transform(regexp_extract_all({t}, '[A-Za-z][A-Za-z0-9_+#.\\-]*'), lambda w: regexp_replace(w, '^[._-]+|[._-]+$', '', 'g')), lambda w: {term})"
    tail = lambda t, n: f"CASE WHEN {n} <= 0 THEN '' WHEN length({t}) > {n} AND strpos(right({t}, {n}), ' ') > 1 THEN substr(right({t}, {n}), strpos(right({t}, {n}), ' ') + 1) ELSE right({t}, {n}) END"
    spaced = lambda name, src, col: f"""{name}_c AS (SELECT doc_id k, unnest(string_split({col}, '')) ch, generate_subscripts(string_split({col}, ''), 1) i FROM {src}),
{name}_n AS (SELECT *, ch = ' ' sp, last_value(CASE WHEN ch <> ' ' THEN ch END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) b, first_value(CASE WHEN ch <> ' ' THEN ch END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) a, lag(ch) OVER (PARTITION BY k ORDER BY i) pr FROM {name}_c),
{name}_m AS (SELECT *, sp AND coalesce(regexp_matches(b, '{T}'), FALSE) AND coalesce(regexp_matches(a, '{T}'), FALSE) gone FROM {name}_n),
{name} AS (SELECT k, CASE WHEN count(*) FILTER (WHERE regexp_matches(ch, '{T}')) >= 10 AND count(*) FILTER (WHERE gone AND coalesce(pr, '') <> ' ') / count(*) FILTER (WHERE regexp_matches(ch, '{T}')) > 0.12
  THEN coalesce(string_agg(ch, '' ORDER BY i) FILTER (WHERE NOT gone), '') ELSE string_agg(ch, '' ORDER BY i) END t FROM {name}_m GROUP BY k)"""  # noqa: E731
    d = "d AS (SELECT doc_id, text FROM documents WHERE text <> '')"
    first_x = f"{FIRST}, x AS (SELECT proposal_id k, method g, ref, text hyp FROM p JOIN f USING (item_id))"
    best = f"""{u['cf']}, lk AS (SELECT proposal_id, {collapsed('text')} t FROM p WHERE text IS NOT NULL), {mapped('fk', 'lk', 'proposal_id', 't', 'cf')},
g AS (SELECT item_id, t, count(*) n, count(DISTINCT method) v FROM p JOIN fk ON proposal_id = k WHERE t <> '' GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, encode(t)) z FROM g), b AS (SELECT item_id, t, n, v FROM h WHERE z = 1 AND n >= 2 AND v >= 2)"""
    label = "'Recent transcript: '"
    words = "(SELECT any_value(asr_id) a, any_value(text) t, coalesce(list_transform(any_value(words), lambda x: x.word), []) w FROM (SELECT DISTINCT asr_id, text, words FROM asr_segments) GROUP BY asr_id)"
    cum = lambda n: f"list_filter(range(1, CAST(len(w) AS BIGINT) + 1), lambda i: 7 + list_sum(list_transform(w[:i], lambda y: length(y))) + 2 * (i - 1) <= {n})"
    line = lambda n: f"CASE WHEN len({cum(n)}) = 0 THEN '' ELSE 'Terms: ' || array_to_string(w[:list_max({cum(n)})], ', ') END"
    out = {
        "label_identities": f"WITH {u['nk']}, {u['cf']}, {P}, {nfkc('n', 'p', 'proposal_id', 'text')}, m AS (SELECT k, {collapsed('t')} t FROM n), {mapped('o', 'm', 'k', 't', 'cf')} SELECT k AS proposal_id, sha256(t) AS identity FROM o",
        "evaluation_texts": f"WITH {u['nk']}, {C}, {nfkc('n', 'c', 'clip_id', 'text')} SELECT k AS clip_id, {collapsed('lower(t)')} AS evaluated, replace({collapsed('lower(t)')}, ' ', '') AS no_space FROM n",
        "source_identities": f"""WITH {u['cf']}, {C}, s AS (SELECT clip_id, replace(coalesce(source_file, ''), chr(92), '/') f, coalesce(source_file, '') o FROM c), {mapped('n', 's', 'clip_id', 'f', 'cf')}
SELECT clip_id, sha256(nfc_normalize(f) || chr(0) || CAST(clip_id AS VARCHAR)) AS identity, coalesce(nullif(t, ''), 'missing') AS path_key,
coalesce(nullif(regexp_replace(regexp_replace(o, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'model') AS safe_name FROM s JOIN n ON k = clip_id""",
        "clip_keys": f"""WITH {C}, s AS (SELECT *, CASE WHEN regexp_matches(audio_sha256, '^[0-9a-f]{{64}}$') THEN audio_sha256 || ':' || coalesce(printf('%.6f', source_start), '') || ':' || coalesce(printf('%.6f', source_end), '') END b FROM c)
SELECT clip_id, b || ':' || replace(coalesce(source_file, ''), chr(92), '/') AS key_v3, b AS key_v2, coalesce(nullif(source_id, '') || '@' || CAST(CAST(round(source_start * 1000) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(round(source_end * 1000) AS BIGINT) AS VARCHAR), nullif(source_id, ''), 'line:' || CAST(clip_id AS VARCHAR)) AS identity FROM s""",
        "script_shares": f"""WITH {u['sc']}, {K}, ch AS (SELECT chunk_id, unnest(string_split(transcript_text, '')) x FROM q), n AS (SELECT chunk_id, v, count(*) n FROM ch JOIN sc ON unicode(x) BETWEEN lo AND hi GROUP BY 1, 2)
SELECT chunk_id, v AS script, round(n / sum(n) OVER (PARTITION BY chunk_id), 9) AS share FROM n""",
        "foreign_scripts": f"""WITH {u['nk']}, {nfkc('n', 'documents', 'doc_id', 'text')}, r(lo, hi, v) AS (VALUES (12352, 12447, 'Hiragana'), (12448, 12543, 'Katakana'), (12784, 12799, 'Katakana'), (19968, 40959, 'CJK'), (13312, 19903, 'CJK'), (44032, 55215, 'Hangul'), (1024, 1279, 'Cyrillic'), (880, 1023, 'Greek'), (1536, 1791, 'Arabic'), (2304, 2431, 'Devanagari')),
ch AS (SELECT k, unnest(string_split(t, '')) x FROM n)
SELECT kind, v AS script, count(*) AS n FROM ch JOIN documents ON k = doc_id JOIN r ON unicode(x) BETWEEN lo AND hi WHERE NOT regexp_matches(x, '[\\s\\p{{M}}\\p{{P}}\\p{{S}}]') GROUP BY 1, 2""",
        "language_stretches": f"""WITH {u['nk']}, {u['rt']}, {K}, {nfkc('n', 'q', 'chunk_id', 'transcript_text')}, m AS (SELECT k, {collapsed('t')} t FROM n),
ch AS (SELECT k, unnest(string_split(t, '')) x, generate_subscripts(string_split(t, ''), 1) i FROM m WHERE t <> ''), ro AS (SELECT k, x, i, coalesce(v, '') v FROM ch LEFT JOIN rt ON unicode(x) BETWEEN lo AND hi),
ac AS (SELECT *, coalesce(last_value(CASE WHEN v <> 'go' THEN v END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING), '') l FROM ro),
ed AS (SELECT *, CASE WHEN l = lag(l) OVER (PARTITION BY k ORDER BY i) THEN 0 ELSE 1 END e FROM ac), sp AS (SELECT *, sum(e) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) g FROM ed)
SELECT k AS chunk_id, any_value(l) AS language, CAST(min(i) - 1 AS INTEGER) AS start, CAST(max(i) AS INTEGER) AS "end", string_agg(x, '' ORDER BY i) AS text FROM sp WHERE l <> '' GROUP BY k, g""",
        "repaired_texts": f"""WITH {d}, {spaced('a', 'd', 'text')}, dd AS (SELECT doc_id, array_to_string(string_split(text, ''), ' ') s FROM d), {spaced('b', 'dd', 's')}
SELECT doc_id, sha256({hes('a.t')}) AS repaired, sha256(b.t) AS despaced, sha256({hes("'ก็ ก็ก็' || left(d.text, 40)")}) AS thrice FROM d JOIN a ON a.k = doc_id JOIN b ON b.k = doc_id""",
        "token_lists": f"""WITH {u['nk']}, {P}, {nfkc('n', 'p', 'proposal_id', 'text')}, m AS (SELECT k, list_transform(regexp_extract_all({collapsed('lower(t)')}, '{tokens}'), lambda w: regexp_replace(w, '[\\s\\p{{P}}\\p{{S}}]+', '', 'g')) t FROM n)
SELECT k AS proposal_id, len(t) AS n, array_to_string(t, '|') AS tokens FROM m""",
        "evaluated_terms": f"WITH {u['nk']}, {K}, {nfkc('n', 'q', 'chunk_id', 'transcript_text')}, m AS (SELECT DISTINCT k, lower(unnest({terms('t')})) term FROM n) SELECT term, count(*) AS n FROM m GROUP BY 1",
        "compact_texts": f"WITH {u['nk']}, {u['cf']}, {K}, {nfkc('n', 'q', 'chunk_id', 'transcript_text')}, m AS (SELECT k, regexp_replace(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g') t FROM n), {mapped('o', 'm', 'k', 't', 'cf')} SELECT k AS chunk_id, t AS compact FROM o",
        "copied_contexts": f"""WITH {K}, r AS (SELECT * FROM q WHERE transcript_text IS NOT NULL AND source_id IS NOT NULL), l AS (SELECT source_id, transcript_text c FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY length(transcript_text) DESC, chunk_id DESC) z FROM r) WHERE z = 1)
SELECT chunk_id, CAST(coalesce(list_max(list_filter(range(2, least(length(transcript_text), length(c)) + 1), lambda n: starts_with(transcript_text, right(c, n)))), 0) AS BIGINT) AS copied, {tail('c', '40')} AS tail, right(c, 40) AS plain_tail FROM r JOIN l USING (source_id)""",
        "live_prompts": f"""WITH s AS (SELECT a, t, w, {line(60)} l60, {line(120)} l, 'Keep technical terms as they are spoken in the meeting' st FROM {words}),
h AS (SELECT *, least(30, 120 - length(l) - CASE WHEN l <> '' THEN 1 ELSE 0 END) room FROM s), b AS (SELECT *, array_to_string(list_filter([{tail('st', 'room')}, l], lambda y: y <> ''), chr(10)) pre, {tail("trim(regexp_replace(coalesce(t, ''), '" + SPACE + "+', ' ', 'g'), ' ')", '60')} ta FROM h),
z AS (SELECT *, 120 - length(pre) - CASE WHEN pre <> '' THEN 1 ELSE 0 END - 19 rest FROM b), y AS (SELECT *, {tail('ta', 'greatest(rest, 0)')} said FROM z)
SELECT a AS asr_id, l60 AS line, nullif(trim(array_to_string(list_filter([pre, CASE WHEN said <> '' THEN {label} || said ELSE '' END], lambda v: v <> ''), chr(10)), ' '), '') AS prompt FROM y""",
        "replacements": f"""WITH o AS (SELECT segment_id, revision, max(text) text FROM transcript_segments GROUP BY 1, 2), x AS (SELECT a.segment_id, a.revision, lower({collapsed("coalesce(a.text, '')")}) o, lower({collapsed("coalesce(b.text, '')")}) n FROM o a JOIN o b ON a.segment_id = b.segment_id AND b.revision = a.revision + 1)
SELECT segment_id, revision, n = '' OR n = o OR contains(o, n) OR (len(string_split(n, ' ')) >= 4 AND len(list_distinct(string_split(n, ' '))) <= greatest(1, floor(len(string_split(n, ' ')) / 3))) AS rejected FROM x""",
        "label_languages": """WITH q AS (SELECT DISTINCT chunk_id, replace(replace(lower(trim(language)), ' / ', '-'), '/', '-') l FROM (SELECT DISTINCT chunk_id, language FROM labeled_chunks))
SELECT CASE WHEN l IN ('en', 'eng', 'english') THEN 'English' WHEN l IN ('th', 'tha', 'thai', 'thai-english', 'th-en', 'th_en') THEN 'Thai' WHEN l IN ('ja', 'jpn', 'japanese', 'japanese-english', 'ja-en', 'ja_en') THEN 'Japanese' END AS name, count(*) AS n FROM q GROUP BY 1""",
        "label_errors": f"WITH {_scores_sql(first_x, u)} SELECT k AS proposal_id, char_edits, ref_chars, bare_edits, bare_chars, token_edits, ref_tokens, round(char_edits / nullif(ref_chars, 0), 9) AS cer, round(bare_edits / nullif(bare_chars, 0), 9) AS cer_no_space, round(token_edits / nullif(ref_tokens, 0), 9) AS wer FROM s",
        "error_summary": f"""WITH {_scores_sql(first_x, u)}, tm AS (SELECT k, len({terms('t')}) > 0 h FROM nr), y AS (SELECT s.*, unnest(list_filter(['overall', CASE WHEN length(x.ref) <= 40 THEN 'short' END, CASE WHEN h THEN 'technical' END], lambda v: v IS NOT NULL)) subset FROM s JOIN x USING (k) JOIN tm USING (k))
SELECT g AS strategy, subset, count(*) AS n, {RATES} FROM y GROUP BY 1, 2""",
        "annotator_scores": f"WITH {_scores_sql(best + ', x AS (SELECT proposal_id k, method g, b.t ref, text hyp FROM p JOIN b USING (item_id))', u)} SELECT g AS method, count(*) AS n, {RATES} FROM s GROUP BY 1",
        "consensus_texts": f"WITH {P}, {best} SELECT item_id, t AS text_key, n, v AS views FROM b",
        "segment_arithmetic": """WITH a AS (SELECT asr_id, any_value(source_id) source_id, any_value(start_sec) s, any_value(end_sec) e FROM (SELECT DISTINCT asr_id, source_id, start_sec, end_sec FROM asr_segments) GROUP BY 1)
SELECT asr_id, round(CASE WHEN e - s > 0 THEN e - s ELSE 0 END, 6) AS seconds, round(CASE WHEN s IS NULL OR e IS NULL THEN 0 ELSE greatest(0, least(e, 60) - greatest(s, 0)) END, 6) AS early, round(abs(s - duration_seconds / 2), 6) AS off, round(CASE WHEN s IS NOT NULL AND duration_seconds IS NOT NULL THEN greatest(0, least(1, 1 - abs(s - duration_seconds / 2) / 1000 / 0.38)) END, 6) AS near FROM a JOIN sources USING (source_id)""",
        "vector_numbers": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings), w AS (SELECT *, list_transform(range(0, 16), lambda i: e[4 * i + 1]) q FROM v)
SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 6) AS rms, len(q) AS n, round(list_sum(q), 4) AS quarter, round(list_sum(list_transform(e, lambda x: trunc(greatest(-1, least(1, x)) * 32767) / 32768)), 6) AS pcm, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first FROM w""",
        "text_identities": f"WITH {u['nk']}, {u['cf']}, t0 AS (SELECT * FROM documents WHERE text IS NOT NULL), {nfkc('n', 't0', 'doc_id', 'text')}, m AS (SELECT k, {collapsed('t')} t FROM n), {mapped('o', 'm', 'k', 't', 'cf')} SELECT sha256(t) AS sha, count(*) AS n FROM o GROUP BY 1 HAVING count(*) > 1",
        "language_spans": f"WITH st AS ({{stretches}}) SELECT language, count(*) AS spans, CAST(sum(\"end\" - start) AS BIGINT) AS chars FROM st GROUP BY 1",
        "manifest": f"""WITH {u['nk']}, {u['sc']}, {C}, cs AS (SELECT *, lower(CASE WHEN contains(f, '/') THEN split_part(f, '/', 1) ELSE 'train' END) sp FROM (SELECT *, replace(regexp_replace(file_name, '^[.]/', ''), chr(92), '/') f FROM c)),
gd AS (SELECT DISTINCT audio_sha256 FROM cs WHERE sp = 'test' AND audio_sha256 IS NOT NULL), tr AS (SELECT * FROM cs WHERE sp <> 'test'), cn AS (SELECT audio_sha256, count(*) k FROM tr WHERE audio_sha256 IS NOT NULL GROUP BY 1),
{nfkc('n', 'tr', 'clip_id', 'text')}, x AS (SELECT clip_id, {collapsed('t')} t, CASE WHEN speech_duration > 0 AND isfinite(speech_duration) THEN speech_duration END d, audio_sha256 FROM tr JOIN n ON k = clip_id),
ch AS (SELECT clip_id, unnest(string_split(t, '')) y FROM x), pr AS (SELECT clip_id, list_distinct(list(v)) l FROM ch JOIN sc ON unicode(y) BETWEEN lo AND hi GROUP BY 1),
y AS (SELECT x.*, length(replace(t, ' ', '')) / d r, coalesce(cn.k > 1, FALSE) dup, x.audio_sha256 IS NULL bad, gd.audio_sha256 IS NOT NULL pro, l FROM x LEFT JOIN cn ON cn.audio_sha256 = x.audio_sha256 LEFT JOIN gd ON gd.audio_sha256 = x.audio_sha256 LEFT JOIN pr USING (clip_id)),
z AS (SELECT *, concat_ws(',', CASE WHEN t = '' THEN 'empty_label' END, CASE WHEN d IS NULL THEN 'invalid_duration' END, CASE WHEN d < 0.15 THEN 'too_short' END, CASE WHEN d > 30 THEN 'too_long' END, CASE WHEN t <> '' AND r < 0.5 THEN 'char_rate_low' END, CASE WHEN r > 35 THEN 'char_rate_high' END,
  CASE WHEN len(l) > 0 AND NOT list_has_any(l, ['thai', 'latin']) THEN 'script_mismatch' END, CASE WHEN dup THEN 'duplicate_content' END, CASE WHEN bad THEN 'malformed_input' END, CASE WHEN pro THEN 'protected_gold_overlap' END) reasons FROM y)
SELECT clip_id, CASE WHEN pro OR t = '' THEN 'drop' WHEN reasons <> '' THEN 'review' ELSE 'keep' END AS disposition, reasons, round(r, 6) AS char_rate, CAST(2 + CASE WHEN d IS NULL THEN 0 ELSE 1 END + coalesce(len(l), 0) AS INTEGER) AS n_evidence FROM z""",
        "json_fields": f"WITH {P} SELECT proposal_id, confidence, coalesce(text, '') AS text, method, coalesce(array_to_string(evidence_refs, '|'), '') AS refs, method AS one FROM p",
    }
    return out | {"language_spans": out["language_spans"].replace("{stretches}", out["language_stretches"])}


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
