"""Raw transcript segments into clean speaker turns.

Labels of all transcripts form one roster: the words that stand before numbers in several transcripts
(beside the known words for "speaker"), and the numbers. A label is read as a word and a mark. Words are
blocked by their sound, in any script (read off the Unicode names of the letters); a word is a speaker
word if it is the roster's, or a misspelling of one of its block. A mark that is a number or a letter
names its speaker; marks in words ("speaker two", misspelt too) are matched within each transcript to
the roster's speakers by an assignment of least total distance, so that two such labels of one transcript
do not fall on one speaker. Clock times, annotations, opening labels and fillers are cut from the texts,
and the segments that keep a word are folded to turns in time order. Sources are cut into time blocks:
turn changes inside a block come from a window over the block, those between blocks from the
blocks' first and last speakers, so a long recording is never one task.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidescribe.operators.assignment import optimal_assignment
from tidescribe.operators.quality import distance_within
from tidescribe.runtime import written

#: Words for "speaker" that the roster has from the start — fixed values.
SPEAKER_WORDS = ["", "s", "spk", "spkr", "speaker", "話者", "话者", "発言者", "发言人", "ผู้พูด", "ผู้พูดที่", "ผู้พูดคนที่"]
#: Numbers in words by language — fixed values.
NUMBER_WORDS = [
    ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"],
    ["หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า", "สิบ"],
    ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十"],
]
#: Letters of the classes of like consonants — fixed values (those of Soundex).
SOUNDS = ["bfpv", "cgjkqsxz", "dt", "l", "mn", "r"]
#: Share of a number word's letters that a misspelt mark may differ in, and edits of a misspelt speaker word.
MARK_SHARE, WORD_EDITS = 0.5, 2
#: Fillers, as regular expressions of whole words — fixed values.
FILLERS = [
    "u+h+-?hu+h+", "u+h*m+", "u+h+", "e+r+m*", "e+h+m*", "m+-?hm+", "m{2,}", "h+m{2,}", "a+h+", "o+h+",
    "เอ่+อ+", "เออ+", "อืม+", "อื้ม+", "อ่+า+", "อ่ะ+", "แบบว่า",
    "え+ー*っと[ー〜]*", "え+ー+と?[ー〜]*", "え+と[ー〜]*", "う+[ー〜]*ん+", "あの[ー〜]*", "あ+ー+", "まあ?[ー〜]*", "その[ー〜]+", "嗯+", "呃+",
]
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　" + "".join(chr(0xE50 + i) for i in range(10))
PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " " + "0123456789"
CLOCK = r"(?:\d{1,3}:)?\d{1,3}:\d{2}(?:[.,]\d{1,3})?(?:\s*(?:-->|\||→|–))?"
BRACKETED = r"\(+[^()]*\)+|\[+[^\[\]]*\]+|\{[^{}]*\}|<+[^<>]*>+|【[^】]*】|〔[^〕]*〕|「?♪[^♪]*♪」?|♪+|\*[^*\s][^*]*\*"
LABEL = r"(?i)^\s*((?:speaker|spkr?\.?|s|話者|话者|発言者|发言人|ผู้พูด(?:คน)?(?:ที่)?)[\s_#.\-]*(?:\d{1,3}|[a-z])|[a-z])\s*[:>]"
EDGE, EDGE_END = r"(?i)(?<![\p{L}\p{M}\p{N}])", r"(?![\p{L}\p{M}\p{N}])"


def plain(col: Column) -> Column:
    """Full-width ASCII and Thai digits become ASCII."""
    return F.translate(col, WIDE, PLAIN)


def strip_noise(text: Column) -> tuple[Column, Column]:
    """The opening label of a text (or '') and the text without times, annotations, label and fillers."""
    bare = F.regexp_replace(F.regexp_replace(plain(text), BRACKETED, " "), rf"(?<![\p{{L}}\d:]){CLOCK}(?![\d:])", " ")
    label = F.regexp_extract(bare, LABEL, 1)
    rest = F.regexp_replace(bare, LABEL, " ")
    rest = F.regexp_replace(rest, EDGE + "(?:" + "|".join(FILLERS) + ")" + EDGE_END + r"(?:\s*(?:\.{2,}|…|,|、))?", " ")
    return label, F.trim(F.regexp_replace(rest, r"\s+", " "))


@functools.lru_cache(4096)
def sound(word: str) -> str:
    """Consonant classes of a word in any script: letters by the sound their Unicode name begins with; vowels, h, w, y and doubles drop.

    Letters whose names tell no sound (Han) stand for themselves.
    """
    out = ""
    for c in word:
        name = unicodedata.name(c, "").split(" ")
        if name[0] == "CJK":
            out += c
            continue
        letter = name[2] if len(name) > 2 and name[1] in ("CHARACTER", "LETTER") else name[3] if len(name) > 3 and name[2] in ("LETTER", "SIGN") else ""
        first = letter[:1].lower() if letter not in ("SARA", "MAI", "SMALL") else ""
        code = next((str(i) for i, g in enumerate(SOUNDS, 1) if first and first in g), "")
        out += code if not out.endswith(code) else ""
    return out


def read_label(label: str | None) -> tuple[str, int | None, str | None] | None:
    """Word, ordinal and mark of a label: a number or a letter (A = 1) gives the ordinal, other last words are a mark to be matched."""
    text = " ".join(unicodedata.normalize("NFKC", label or "").casefold().split())
    strip = lambda t: re.sub(r"^[\W_]+|[\W_]+$", "", t)
    m = re.match(r"^(.*?)(\d{1,4})$", text) or re.match(r"^(|.*[\W_])([a-z])$", text)
    if m:
        return strip(m[1]), int(m[2]) if m[2].isdigit() else ord(m[2]) - 96, None
    m = re.match(r"^(.*\w)[\W_]+(\w+)$", text)
    for word in (w for words in NUMBER_WORDS[1:] for w in words):  # scripts without blanks
        if text.endswith(word) and len(text) > len(word):
            return strip(text[: -len(word)]), None, word
    return (strip(m[1]), None, m[2]) if m else None


LABEL_PARTS = "struct<word:string,ordinal:int,mark:string,sound:string>"


def label_parts(col: Column) -> Column:
    """`read_label` and `sound` of distinct labels."""

    def run(labels: pa.Array) -> pa.Array:
        read = [read_label(x) for x in labels.to_pylist()]
        fields = ["word", "ordinal", "mark"]
        rows = [None if r is None else dict(zip(fields, r)) | {"sound": sound(r[0])} for r in read]
        return pa.array(rows, pa.struct([("word", pa.string()), ("ordinal", pa.int32()), ("mark", pa.string()), ("sound", pa.string())]))

    return F.arrow_udf(run, LABEL_PARTS)(col)


def speaker_words(read: DataFrame) -> DataFrame:
    """``word`` of the labels' words that name speakers: known ones, those of several numbers in several transcripts, and misspellings of their block.

    ``read``: ``source_id, word, ordinal, sound`` of the labels of speaker columns. Within a sound block (two
    consonants or more) a word is a misspelling if it lies within WORD_EDITS of a roster word of that block.
    """
    spark = read.sparkSession
    known = spark.createDataFrame([(w, sound(w)) for w in SPEAKER_WORDS], "word string, sound string")
    seen = read.filter("ordinal is not null").groupBy("word", "sound").agg(F.count_distinct("ordinal").alias("n"), F.count_distinct("source_id").alias("k"))
    roster = known.unionByName(seen.filter("n > 1 and k > 1").select("word", "sound")).distinct().withColumn("roster", F.lit(True))
    words = read.select("word", "sound").distinct().withColumn("roster", F.lit(False)).unionByName(roster).filter("roster or length(sound) > 1")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        right = sorted(pdf.loc[pdf.roster, "word"])
        close = lambda w: any(distance_within(w, r, min(WORD_EDITS, len(r) // 3)) is not None for r in right if r)
        return pd.DataFrame({"word": right + [w for w in sorted(set(pdf["word"]) - set(right)) if close(w)]}, dtype=object)

    return words.groupBy("sound").applyInPandas(block, "word string").distinct()


def match_marks(marks: list[str], speakers: list[int]) -> dict[str, int]:
    """Marks in words to roster speakers, each to another one, at least total distance; a mark too far from every number word gets none."""
    cost = np.full((len(marks), len(speakers)), np.inf)
    for i, m in enumerate(marks):
        for j, n in enumerate(speakers):
            names = [words[n - 1] for words in NUMBER_WORDS if n <= len(words)]
            near = [d / len(w) for w in names if (d := distance_within(m, w, int(len(w) * MARK_SHARE))) is not None]
            cost[i, j] = min(near, default=np.inf)
    return {marks[i]: speakers[j] for i, j in optimal_assignment(cost)}


def normalise_labels(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of labels (``source_id, label, own``: whether it is of a speaker column): ``label, speaker`` and ``source_id, label, speaker``.

    The first are labels with a number or letter, the same in every transcript. The second are those whose
    mark is a word: the marks of one word within a transcript are assigned to the numbers that the roster has.
    """
    labels = labels.distinct()
    parts = written(labels.select("label").distinct().withColumn("p", label_parts(F.col("label"))).filter("p is not null").select("label", "p.*"), "parts")
    own = labels.filter("own").join(parts, "label").select("source_id", "word", "ordinal", "sound")
    words = written(speaker_words(own), "words")
    named = parts.join(words, "word", "left_semi")
    name = lambda n: F.format_string("spk_%02d", n)
    plain = named.filter("ordinal is not null").select("label", name(F.col("ordinal")).alias("speaker"))
    # Numbers above ten have no word, so the roster's speakers are ten at most here.
    slots = named.filter("ordinal between 1 and 10").agg(F.sort_array(F.collect_set("ordinal")).alias("slots"))
    told = labels.join(named.filter("mark is not null"), "label").select(F.coalesce("source_id", F.lit("")).alias("source_id"), "label", "word", "mark").join(F.broadcast(slots))  # one row

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        to = match_marks(sorted(pdf["mark"].unique()), [int(n) for n in pdf["slots"].iloc[0]])
        kept = pdf[pdf["mark"].isin(to)].drop_duplicates("label")
        return pd.DataFrame({"source_id": kept["source_id"], "label": kept["label"], "speaker": [f"spk_{to[m]:02d}" for m in kept["mark"]]})

    return plain, told.groupBy("source_id", "word").applyInPandas(assign, "source_id string, label string, speaker string")


def clean_segments(df: DataFrame) -> DataFrame:
    """``source_id, segment_id, start_sec, end_sec, speaker, clean``: the final revisions that keep words.

    Of each segment the highest revision counts (null lowest; of equal ones the later emitted);
    null texts and those of fillers and annotations only are dropped. A null source is a source.
    """
    rows = df.select("segment_id", "source_id", "start_sec", "end_sec", "text", "speaker_id", "revision", "emitted_at")
    best = F.max(F.struct("revision", "emitted_at", "source_id", "start_sec", "end_sec", "speaker_id", "text")).alias("x")
    rows = rows.groupBy("segment_id").agg(best).select("segment_id", "x.source_id", "x.start_sec", "x.end_sec", "x.speaker_id", "x.text")
    label, clean = strip_noise(F.col("text"))
    rows = rows.withColumns({"said": label, "clean": clean}).drop("text").filter(F.col("clean").rlike(r"[\p{L}\p{N}]"))
    rows = written(rows, "segments")  # the patterns run once, though labels, turns and block ends read the rows
    both = F.array(F.struct(F.col("speaker_id").alias("label"), F.lit(True).alias("own")), F.struct(F.col("said").alias("label"), F.lit(False).alias("own")))
    labels = rows.select("source_id", F.inline(both)).filter("label <> ''")
    plain, told = (written(x, "names") for x in normalise_labels(labels))
    # Joined by Spark's own choice: names are broadcast only below its size threshold.
    rows = rows.withColumn("_s", F.coalesce("source_id", F.lit("")))
    for label, name in (("speaker_id", "by_id"), ("said", "by_text")):
        rows = rows.join(plain.toDF(label, f"{name}_1"), label, "left").join(told.toDF("_s", label, f"{name}_2"), ["_s", label], "left")
    speaker = F.coalesce("by_id_1", "by_id_2", "by_text_1", "by_text_2", F.lit("unknown"))
    return rows.select("source_id", "segment_id", "start_sec", "end_sec", speaker.alias("speaker"), "clean")


def speaker_turns(segments: DataFrame, block_sec: float = 600.0) -> DataFrame:
    """``segments`` with ``turn_no``: the number of each longest run of one speaker within its source.

    Order: start, end (nulls first), segment id. Blocks follow the start; null starts are a block.
    """
    rows = segments.withColumn("_blk", F.coalesce(F.floor(F.col("start_sec") / block_sec), F.lit(-(2**40))))
    order = ["start_sec", "end_sec", "segment_id"]
    inside = Window.partitionBy("source_id", "_blk").orderBy(*order)
    rows = rows.withColumn("_new", F.coalesce((F.lag("speaker").over(inside) != F.col("speaker")).cast("int"), F.lit(0)))
    rows = rows.withColumn("_k", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct(*order)
    ends = rows.groupBy(F.col("source_id").alias("_s"), F.col("_blk").alias("_b")).agg(F.min_by("speaker", key).alias("head"), F.max_by("speaker", key).alias("tail"), F.max("_k").alias("changes"))
    over = Window.partitionBy("_s").orderBy("_b")
    ends = ends.withColumn("new", F.coalesce((F.lag("tail").over(over) != F.col("head")).cast("int"), F.lit(0)))
    total = F.sum(F.col("new") + F.col("changes")).over(over.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.select("_s", "_b", (total - F.col("changes")).alias("_base"))
    joined = rows.join(ends, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("_blk") == F.col("_b")))
    return joined.withColumn("turn_no", F.col("_base") + F.col("_k")).drop("_s", "_b", "_blk", "_k", "_new", "_base")


def _segments(spark, sf_dir: str) -> DataFrame:
    return clean_segments(spark.read.parquet(f"{sf_dir}/transcript_segments.parquet"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Speaker turns of each source with their first and last segment."""
    key = F.struct("start_sec", "end_sec", "segment_id")
    turns = speaker_turns(_segments(spark, sf_dir)).groupBy("source_id", "turn_no")
    turns = turns.agg(F.first("speaker").alias("speaker"), F.min_by("segment_id", key).alias("first_segment_id"), F.max_by("segment_id", key).alias("last_segment_id"))
    return turns.select("source_id", "speaker", "first_segment_id", "last_segment_id")


def p6_turns(spark, sf_dir: str) -> DataFrame:
    """The turns with their clean text, in order within each source."""
    part = F.struct("start_sec", "end_sec", "segment_id", "clean")
    turns = speaker_turns(_segments(spark, sf_dir)).groupBy("source_id", "turn_no")
    turns = turns.agg(F.first("speaker").alias("speaker"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sort_array(F.collect_list(part)).alias("p"))
    return turns.select("source_id", "turn_no", "speaker", "start_sec", "end_sec", F.concat_ws(" ", F.col("p.clean")).alias("text"))
