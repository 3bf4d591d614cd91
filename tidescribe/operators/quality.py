"""Quality signals, dispositions, spelling, consensus and the candidate manifest (FLT*, JN01-JN04, AG01, AG04-AG06, UD01-UD03)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidescribe.functions import text as tx
from tidescribe.functions.numeric import to_number

#: Reasons that drop a record, and those that send it to review — fixed values.
DROP = ["empty_label"]
REVIEW = [
    "invalid_duration", "too_short", "too_long", "char_rate_low", "char_rate_high", "script_mismatch", "duplicate_content", "low_confidence",
    "signal_conflict", "protected_gold_overlap", "prediction_disagreement", "spelling_suspect", "malformed_input",
]


def reasons_of(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs])))


def signals(df: DataFrame, label: str, seconds: str, scripts: list[str] | None = None, shortest: float = 0.15, longest: float = 30.0, slow: float = 0.5, fast: float = 35.0, normalised: bool = False) -> DataFrame:
    """FLT01: adds ``norm_text, norm_length, valid_seconds, char_rate, script_share, reasons``.

    A null label counts as empty; a duration that is null, no number, not finite or not positive
    is invalid and has no rate. ``normalised`` says that the label is normalised already.
    """
    text = F.coalesce(F.col(label), F.lit("")) if normalised else tx.normalise(F.col(label))
    d = to_number(F.col(seconds))
    out = df.withColumn("norm_text", text).withColumn("_d", F.when(d > 0, d))
    rate = F.length(F.replace("norm_text", F.lit(" "), F.lit(""))) / F.col("_d")
    out = out.withColumns({"norm_length": F.length("norm_text"), "char_rate": rate, "valid_seconds": F.col("_d"), "script_share": tx.script_profile(F.col("norm_text"))})
    full = F.col("norm_length") > 0
    wrong = F.lit(False)
    if scripts:
        wrong = (F.size("script_share") > 0) & ~F.arrays_overlap(F.map_keys("script_share"), F.array(*[F.lit(s.lower()) for s in scripts]))
    found = reasons_of(
        (~full, "empty_label"),
        (F.col("_d").isNull(), "invalid_duration"),
        (F.col("_d") < shortest, "too_short"),
        (F.col("_d") > longest, "too_long"),
        (full & (F.col("char_rate") < slow), "char_rate_low"),
        (F.col("char_rate") > fast, "char_rate_high"),
        (wrong, "script_mismatch"),
    )
    return out.withColumn("reasons", found).drop("_d")


def evidence(extra: Column | None = None) -> Column:
    """Evidence rows of `signals` as array<struct<name,num,str,source>>, in fixed order: length, duration, rate, scripts.

    An invalid duration has a null number and says so; then there is no rate row.
    """
    kind = "array<struct<name:string,num:double,str:string,source:string>>"
    one = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit("baseline").alias("source"))
    shares = F.transform(F.map_entries("script_share"), lambda e: F.struct(F.concat(F.lit("script_fraction."), e["key"]).alias("name"), e["value"].alias("num"), F.lit(None).cast("string").alias("str"), F.lit("baseline").alias("source")))
    bad = F.struct(F.lit("duration_seconds").alias("name"), F.lit(None).cast("double").alias("num"), F.lit("missing or invalid").alias("str"), F.lit("baseline").alias("source"))
    timed = F.when(F.col("valid_seconds").isNull(), F.array(bad).cast(kind)).otherwise(F.array(one("duration_seconds", F.col("valid_seconds")), one("characters_per_second", F.col("char_rate"))).cast(kind))
    rows = F.concat(F.array(one("normalized_length", F.col("norm_length"))).cast(kind), timed, shares.cast(kind))
    return F.concat(rows, extra.cast(kind)) if extra is not None else rows


def disposition(reasons: Column, proposal: Column, drop: list[str] = DROP, review: list[str] = REVIEW) -> Column:
    """FLT02: a proposal corrects; else drop, review or keep by the reasons."""
    has = lambda names: F.arrays_overlap(reasons, F.array(*[F.lit(n) for n in names]))
    return F.when(proposal.isNotNull(), "correct").when(has(drop), "drop").when(has(review), "review").otherwise("keep")


def decide(df: DataFrame, confidence: str, proposal: str, least: float = 0.5) -> DataFrame:
    """FLT03: `signals` plus low adapter confidence and a grounded correction, with the disposition."""
    more = reasons_of((F.col(confidence) < least, "low_confidence"), (F.col(proposal).isNotNull(), "grounded_correction"))
    out = df.withColumn("reasons", F.array_distinct(F.concat("reasons", more)))
    return out.withColumn("disposition", disposition(F.col("reasons"), F.col(proposal)))


def eligible(flag: Column, legacy: str = "error", research: bool = False) -> Column:
    """FLT04: whether a row may train; a null flag is a legacy row: 'error', 'include' or 'exclude'.

    The research override turns explicit false only, never legacy rows.
    """
    null = {"include": F.lit(True), "exclude": F.lit(False), "error": F.raise_error("a legacy row has no training_eligible").cast("boolean")}[legacy]
    return F.when(flag.isNull(), null).otherwise(flag | F.lit(research))


def token_count_ok(labels: Column, most: int = 448) -> Column:
    """FLT05: 1 to ``most`` tokens."""
    return F.size(labels).between(1, most)


def is_short(flag: Column, seconds: Column, threshold: float = 3.0) -> Column:
    """FLT06: marked short, or no longer than the threshold."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(seconds <= threshold, F.lit(False))


def low_confidence(avg_logprob: Column, probabilities: Column, least_log: float = -1.0, least_word: float = 0.5) -> Column:
    """FLT07: mean log probability under the bound or any word under its bound; nulls say nothing."""
    return F.coalesce(avg_logprob < least_log, F.lit(False)) | F.coalesce(F.array_min(probabilities) < least_word, F.lit(False))


def queue_filter(df: DataFrame, state: str, query: str, fields: list[str]) -> DataFrame:
    """FLT08: rows of a disposition, 'reviewed' or 'unreviewed', whose fields hold the query in any case."""
    keep = {"all": F.lit(True), "reviewed": F.col("reviewed"), "unreviewed": ~F.col("reviewed")}.get(state, F.col("disposition") == state)
    hay = F.lower(F.concat_ws("\n", *fields))
    return df.filter(keep & (F.contains(hay, F.lit(query.lower())) if query else F.lit(True)))


def safe_relative(path: Column) -> Column:
    """FLT09: the path; raises if it is absolute or climbs out of its folder."""
    p = F.translate(path, "\\", "/")
    bad = p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.rlike(r"(^|/)\.\.(/|$)")
    return F.when(bad, F.raise_error(F.concat(F.lit("path leaves its root: "), path))).otherwise(path)


def high_quality(seconds: Column, overlap_ratio: Column, confidence: Column) -> Column:
    """FLT10: at least 1 s clean, at most 0.3 overlapped, confidence 0.6 or more."""
    return (seconds >= 1.0) & (overlap_ratio <= 0.3) & (confidence >= 0.6)


def in_window(df: DataFrame, path: str, name: str, start: float, end: float) -> DataFrame:
    """FLT11: rows of one file name, in any folder, that overlap a window."""
    base = F.element_at(F.split(F.translate(F.col(path), "\\", "/"), "/"), -1)
    return df.filter((base == name) & (F.col("source_start") < end) & (F.col("source_end") > start))


def spelling_state(df: DataFrame, label: str, threshold: float = 0.2, least: int = 1) -> DataFrame:
    """FLT12 on ``label_sha256, total, suspicious, ratio, by_language``: adds ``spelling`` of ok, stale, malformed or suspect.

    Stale: the label's identity differs. Malformed: a ratio is not suspicious / total (1e-9) or
    counts are impossible. Suspect: any language at the threshold, or the total where languages are missing.
    """
    off = lambda n, k, r: (k < 0) | (n < 0) | (k > n) | (F.abs(r - F.coalesce(F.try_divide(k, n), F.lit(0.0))) > 1e-9)
    entries = F.map_values("by_language")
    bad = off(F.col("total"), F.col("suspicious"), F.col("ratio")) | F.coalesce(F.exists(entries, lambda x: off(x["checked"], x["suspicious"], x["ratio"])), F.lit(False))
    by = F.exists(entries, lambda x: (x["ratio"] >= threshold) & (x["suspicious"] >= least))
    total = (F.col("ratio") >= threshold) & (F.col("suspicious") >= least)
    hot = F.when(F.coalesce(F.size("by_language"), F.lit(0)) > 0, by).otherwise(total)
    state = F.when(F.col("total").isNull(), "missing").when(F.col("label_sha256") != tx.content_identity(F.col(label)), "stale").when(bad, "malformed").when(hot, "suspect").otherwise("ok")
    return df.withColumn("spelling", state)


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """FLT13: the rows; reading one that breaks a rule raises an error with the rule's name."""
    for name, rule in rules.items():
        df = df.filter(F.when(rule, F.lit(True)).otherwise(F.raise_error(F.lit(f"record breaks: {name}")).cast("boolean")))
    return df


def array_report(df: DataFrame, col: str) -> DataFrame:
    """FLT15: values, NaN, infinite, least and greatest finite value of all arrays."""
    x = F.col("x")
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.select(F.explode(col).alias("x")).agg(
        F.count("*").alias("n"), F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"), F.min(F.when(finite, x)).alias("low"), F.max(F.when(finite, x)).alias("high")
    )


def media_status(df: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """FLT16: ``media_path`` from file_name, path or audio_path, and ``status`` ok, missing_path or missing_file."""
    raw = tx.filled(F.col("file_name"), F.col("path"), F.col("audio_path"))
    full = F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), raw))
    known = files.select(F.col("path").alias("_p")).distinct()
    out = df.withColumn("media_path", full).join(known, F.col("media_path") == F.col("_p"), "left")
    return out.withColumn("status", F.when(F.col("media_path").isNull(), "missing_path").when(F.col("_p").isNull(), "missing_file").otherwise("ok")).drop("_p")


def grouped_predictions(df: DataFrame) -> DataFrame:
    """SRC11, JN01's right side: per key (file_name, sample_id or audio_path) its texts in order of line."""
    key = tx.path_key(tx.filled(F.col("file_name"), F.col("sample_id"), F.col("audio_path")))
    said = F.coalesce("prediction", "hypothesis")
    rows = df.select(key.alias("key"), F.struct("line", "view", said.alias("text")).alias("p")).filter("key is not null and p.text is not null")
    return rows.groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("predictions"))


def consensus(df: DataFrame, key: str, view: str, text: str, least: int = 2) -> DataFrame:
    """AG04: per key the text of most rows (then the smallest), if ``least`` rows and two views have it.

    Blank texts do not count; case does not matter. Gives ``key, text_key, n, views, total, fraction``.
    """
    rows = df.withColumn("text_key", tx.casefold(tx.collapse_space(F.col(text)))).filter("text_key <> ''")
    by = rows.groupBy(key, "text_key", view).agg(F.count("*").alias("n")).groupBy(key, "text_key").agg(F.sum("n").alias("n"), F.count(view).alias("views"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "text_key")
    best = by.withColumns({"r": F.row_number().over(order), "total": F.sum("n").over(Window.partitionBy(key))}).filter("r = 1")
    return best.filter((F.col("n") >= least) & (F.col("views") >= 2)).select(key, "text_key", "n", "views", "total", (F.col("n") / F.col("total")).alias("fraction"))


#: The units of a span; with each null where it is right, else close words (perhaps none).
Checker = Callable[[str], list[tuple[str, list[str] | None]]]


def distance_within(a: str, b: str, most: int) -> int | None:
    """Edits (insert, delete, replace, swap neighbours) between two words, or null beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
        if min(row) > most:
            return None
    return rows[-1][-1] if rows[-1][-1] <= most else None


class WordList:
    """Words by frequency, with close words found by deletions (a word within ``most`` edits shares a deletion form)."""

    def __init__(self, words: dict[str, int] | frozenset[str], most: int = 2, prefix: int = 7):
        self.count = dict(words) if isinstance(words, dict) else dict.fromkeys(words, 1)
        self.most, self.prefix, self.longest = most, prefix, max(map(len, self.count), default=0)
        self.forms: dict[str, list[str]] = {}
        for w in sorted(self.count):
            for f in self._forms(w[:prefix]):
                self.forms.setdefault(f, []).append(w)

    def _forms(self, word: str) -> set[str]:
        out = edge = {word}
        for _ in range(self.most):
            edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
            out = out | edge
        return out

    def close(self, word: str, top: int = 5) -> list[str]:
        """The nearest words within the bound, most frequent first, at most ``top``."""
        seen = {w for f in self._forms(word[: self.prefix]) for w in self.forms.get(f, [])}
        found = [(d, -self.count[w], w) for w in seen if (d := distance_within(word, w, self.most)) is not None]
        least = min((d for d, *_ in found), default=0)
        return [w for d, _, w in sorted(found) if d == least][:top]

    def cut(self, text: str) -> list[str]:
        """A text without blanks into words: fewest characters outside the list, then fewest words; unknown stretches are one piece."""
        best: list[tuple[int, int, int]] = [(0, 0, 0)]
        for end in range(1, len(text) + 1):
            options = [(best[end - 1][0] + 1, best[end - 1][1] + 1, end - 1)]
            options += [(best[i][0], best[i][1] + 1, i) for i in range(max(0, end - self.longest), end) if text[i:end] in self.count]
            best.append(min(options))
        out, end = [], len(text)
        while end:
            start = best[end][2]
            out.append((text[start:end], text[start:end] in self.count))
            end = start
        pieces: list[list] = []
        for piece, known in reversed(out):
            if pieces and not known and not pieces[-1][1]:
                pieces[-1][0] += piece
            else:
                pieces.append([piece, known])
        return [p for p, _ in pieces]


ENGLISH_WORD = re.compile(r"[A-Za-z][A-Za-z0-9'’_-]*")


def english_checker(words: WordList, acronym: int = 8, suggest: bool = True) -> Checker:
    """UD02: words of two or more letters that are no acronym; right if the nearest word of the list is the word itself. Close words only where they are to be told."""

    def check(text: str) -> list[tuple[str, list[str] | None]]:
        units = [u for u in ENGLISH_WORD.findall(text) if len(u) > 1 and not (u.isupper() and len(u) <= acronym)]
        return [(u, None if u.casefold() in words.count else words.close(u.casefold()) if suggest else []) for u in units]

    return check


def dictionary_checker(words: WordList, script: str, shortest: int = 2, suggest: bool = True) -> Checker:
    """UD02 for a script without blanks (Thai, Japanese): the text is cut by the list; pieces it lacks are suspicious."""

    def check(text: str) -> list[tuple[str, list[str] | None]]:
        units = [u for part in text.split() for u in words.cut(part) if len(u) >= shortest and any(tx.script_of(c) == script or script == "" for c in u)]
        return [(u, None if u in words.count else words.close(u) if suggest else []) for u in units]

    return check


def spelling(df: DataFrame, key: str, label: str, checkers: dict[str, Checker], allow: frozenset[str] = frozenset()) -> DataFrame:
    """UD01-UD03, AG05: ``key, language, checked, suspicious, ratio, issues`` per language of the label's spans.

    Checkers are set up once a worker; every text is routed by script spans; words of the allow-list pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[tuple[str, str], list] = {}
        for batch in batches:
            out = []
            keys, texts = batch.column(0).to_pylist(), [tx.normalise_value(t) for t in batch.column(1).to_pylist()]
            for row, number, start, end in zip(*tx.batch_spans(texts)):
                lang, span = tx.LANGUAGES[number], texts[row][start:end]
                if lang in checkers:
                    if (lang, span) not in cache:
                        if len(cache) > 200_000:
                            cache.clear()
                        cache[lang, span] = checkers[lang](span)
                    for unit, close in cache[lang, span]:
                        out.append((keys[row], lang, unit, close is not None and unit.casefold() not in allow))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], names=["key", "language", "unit", "bad"])

    units = df.select(key, label).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, language string, unit string, bad boolean")
    out = units.groupBy("key", "language").agg(F.count("*").alias("checked"), F.count_if("bad").alias("suspicious"), F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("unit")))).alias("issues"))
    return out.withColumn("ratio", F.col("suspicious") / F.col("checked")).withColumnRenamed("key", key)


def spelling_rows(units: DataFrame, key: str, threshold: float = 0.2, least: int = 1) -> DataFrame:
    """AG06: one row per key: totals, the map by language and whether it needs review."""
    one = F.struct("language", F.struct("checked", "suspicious", "ratio"))
    out = units.groupBy(key).agg(F.sum("checked").alias("total"), F.sum("suspicious").alias("suspicious"), F.map_from_entries(F.array_sort(F.collect_list(one))).alias("by_language"))
    hot = F.exists(F.map_values("by_language"), lambda x: (x["ratio"] >= threshold) & (x["suspicious"] >= least))
    return out.withColumns({"ratio": F.coalesce(F.try_divide("suspicious", "total"), F.lit(0.0)), "review": hot})


def candidate_manifest(clips: DataFrame, protected: DataFrame, proposals: DataFrame | None = None, spelled: DataFrame | None = None, scripts: list[str] | None = None, normalised: bool = False) -> DataFrame:
    """JN01-JN04 and the policy in order: signals, proposal, duplicates, spelling, protected overlap.

    ``clips``: key, label, seconds, content_sha; ``protected``: content_sha; ``proposals``: key,
    proposal; ``spelled``: key, suspect. Trap T12: a proposal corrects even an empty label; a
    duplicate, missing content or spelling suspicion takes the proposal away; protected content is dropped.
    """
    rows = signals(clips, "label", "seconds", scripts, normalised=normalised)
    rows = rows.join(proposals.select("key", "proposal"), "key", "left") if proposals is not None else rows.withColumn("proposal", F.lit(None).cast("string"))
    rows = rows.join(spelled.select("key", "suspect"), "key", "left") if spelled is not None else rows.withColumn("suspect", F.lit(False))
    counts = clips.filter("content_sha is not null").groupBy("content_sha").agg(F.count("*").alias("copies"))
    shas = protected.select("content_sha").filter("content_sha is not null").distinct().withColumn("guarded", F.lit(True))
    rows = rows.join(counts, "content_sha", "left").join(shas, "content_sha", "left")
    differs = F.col("proposal").isNotNull() & (tx.casefold(F.col("proposal")) != tx.casefold(F.col("norm_text")))
    twice, suspect = F.coalesce(F.col("copies") > 1, F.lit(False)), F.coalesce("suspect", F.lit(False))
    malformed, guarded = F.col("content_sha").isNull(), F.coalesce("guarded", F.lit(False))
    kept = F.when(differs & ~twice & ~suspect & ~malformed & ~guarded, F.col("proposal"))
    more = reasons_of((twice, "duplicate_content"), (malformed, "malformed_input"), (differs, "prediction_disagreement"), (suspect, "spelling_suspect"), (guarded, "protected_gold_overlap"), (kept.isNotNull(), "grounded_correction"))
    rows = rows.withColumns({"reasons": F.array_distinct(F.concat("reasons", more)), "proposal": kept, "guarded": guarded})
    return rows.withColumn("disposition", F.when(F.col("guarded"), "drop").otherwise(disposition(F.col("reasons"), F.col("proposal")))).drop("copies", "suspect")


def counts(df: DataFrame, by: str) -> DataFrame:
    """AG01, AG09: rows per value, sorted."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(by)


def label_hash(text: str) -> str:
    """Driver-side twin of `content_identity`."""
    return hashlib.sha256(tx.normalise_value(text, casefold=True).encode()).hexdigest()
