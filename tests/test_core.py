"""Golden and property tests of the core operators."""

import math
import random
import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidescribe.functions import numeric as nu
from tidescribe.functions import text as tx
from tidescribe.operators import coverage, evaluate, mapping, planner, quality, selection, speakers
from tidescribe.operators import intervals as iv
from tidescribe.operators.assignment import optimal_assignment


def values(spark, texts, *cols):
    """Results of columns over ``t``, in order."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] if len(cols) > 1 else r[1] for r in df.select("i", *cols).orderBy("i").collect()]


def spans_of(df, *keys):
    return sorted((*(r[k] for k in keys), r.start, r.end) for r in df.collect())


# text


def test_normalise(spark):
    got = values(spark, ["  Ａ  b c ", "Straße", None, "", "\x1ca\x1d"], tx.normalise(F.col("t"), True))
    assert got == ["a b c", "strasse", "", "", "a"]
    assert values(spark, [" a \x1c　b ", None], tx.collapse_space(F.col("t"))) == ["a b", None]
    assert values(spark, ["x"], tx.content_identity(F.col("t"))) == [quality.label_hash(" X ")]
    odd = ["a\ue000 b", None, " \u0301x", "", " ", "ΑΣ", "Σ"]  # the mark of the batch itself, and texts that could melt together
    for part in (odd, odd[1:]):
        assert values(spark, part, tx.normalise(F.col("t"))) == [tx.normalise_value(t) for t in part]
        assert values(spark, part, tx.evaluation_text(F.col("t"))) == [None if t is None else tx._evaluation(t) for t in part]


def test_scripts(spark):
    assert [tx.script_of(c) for c in "กあアー漢々aж가"] == ["thai", "hiragana", "katakana", "hiragana", "han", "other", "latin", "cyrillic", "hangul"]
    p = values(spark, ["ab กา 1", "123", "漢字か", None], tx.script_profile(F.col("t")))
    assert p[0] == {"latin": pytest.approx(0.5), "thai": pytest.approx(0.5)} and p[1] == {} and p[2] == {"han": pytest.approx(2 / 3), "hiragana": pytest.approx(1 / 3)}
    assert values(spark, ["กา a1 漢", "é ๑ ① が́・"], tx.foreign_scripts(F.col("t"))) == [{"CJK": 1}, {"Hiragana": 1}]
    assert values(spark, ["é ๑ ②"], tx.script_counts(F.col("t"))) == [{"Thai": 1, "Digit": 1}]
    rng = random.Random(4)
    texts = ["".join(rng.choice("กข์่ a-b9'é漢か々ー_1! Z๑") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    want = []
    for t in texts:
        spans, active = [], None
        for i, c in enumerate(t):
            lang = tx.route_char(c, active)
            if lang and lang == active:
                spans[-1][2] = i + 1
            elif lang:
                spans.append([lang, i, i + 1])
            active = lang
        want.append([(*x, t[x[1] : x[2]]) for x in map(tuple, spans)])
    assert [[tuple(s) for s in r] for r in values(spark, texts, tx.script_spans(F.col("t"), True))] == want
    spans = tx.split_spans("ทีม api-2 漢字です")
    assert [(s[0], s[3]) for s in spans] == [("thai", "ทีม"), ("english", "api-2"), ("japanese", "漢字です")]
    assert tx.split_spans(None) == [] and tx.split_spans("12 !") == []


def test_thai_repairs(spark):
    assert values(spark, ["ก า ร ป ร ะ ชุ ม วั น นี้", "การประชุม วันนี้ครับผม"], tx.thai_spacing(F.col("t"))) == ["การประชุมวันนี้", "การประชุม วันนี้ครับผม"]
    assert values(spark, ["ก\tา\tร\tป\tร\tะ\tชุ\tม\tวั\tน"], tx.thai_spacing(F.col("t"))) == ["ก\tา\tร\tป\tร\tะ\tชุ\tม\tวั\tน"]
    assert values(spark, ["ก็ก็ก็ดี", "ก็ก็ดี", "ถ้า ถ้า ถ้า", "มัน มัน มัน"], tx.collapse_hesitation(F.col("t"))) == ["ก็ดี", "ก็ก็ดี", "ถ้า", "มัน มัน มัน"]


def test_tokens_and_terms(spark):
    assert values(spark, ["abc12 กำดี, 漢字!", ""], tx.tokens(tx.evaluation_text(F.col("t")))) == [["abc12", "กํ", "า", "ดี", "漢", "字"], []]
    assert values(spark, ["café ๑๒ab", "e\u0331 , \u0331x", "\u0331a"], tx.tokens(tx.evaluation_text(F.col("t")))) == [["caf", "é", "๑๒ab"], ["e\u0331\u0331", "x"], ["\u0331", "a"]]
    got = values(spark, ["Use the API and api with scikit-learn, v2.0, ok at it"], tx.terms(F.col("t")))[0]
    assert "API" in got and "api" not in got and "scikit-learn" in got and "the" not in got
    assert got == sorted(got, key=str.lower)
    texts = ["about context prompt Foo x-y A_b C# GPU", "Use the API and api, v2.0 it", "naïve C+ไทย abcd"]
    assert values(spark, texts, tx.terms(F.col("t"))) == [tx.term_list(t) for t in texts] == [["A_b", "GPU"], ["API", "v2.0"], ["abcd", "C+"]]
    assert values(spark, ["of café ok OK"], tx.evaluated_terms(F.col("t"))) == [["OK"]]


def test_context_functions(spark):
    df = spark.createDataFrame([("bcdef", "xxabcd", ["alpha", "beta", "gamma"])], "l string, c string, a array<string>")
    r = df.select(tx.copied_context(F.col("l"), F.col("c")).alias("n"), tx.terms_line(F.col("a"), 19).alias("line"), tx.prompt(F.lit("be brief"), F.col("a"), F.col("c"), 90, 20).alias("p")).first()
    assert r.n == 3 and r.line == "Terms: alpha, beta" and r.p == "be brief\nTerms: alpha, beta, gamma\nRecent transcript: xxabcd"
    assert values(spark, ["one two three", "short"], tx.tail(F.col("t"), 9)) == ["three", "short"]
    pairs = spark.createDataFrame([("hello there", "hello there"), ("hello", "x x x x"), ("hello big world", "big"), ("a", "new text"), ("a", None)], "c string, n string")
    assert [r[0] for r in pairs.select(tx.rejects_replacement(F.col("c"), F.col("n"))).collect()] == [True, True, True, False, True]
    assert tx.similarity_value("abc", "abcdef") == pytest.approx(2 * 3 / 9) and tx.similarity_value("", "a") == 0.0


def test_keys(spark):
    sha = "a" * 64
    r = spark.createDataFrame([(sha, 1.0, None, "A\\B.wav"), ("xyz", 1.0, 2.0, "u")], "h string, s double, e double, u string").select(tx.chunk_key(F.col("h"), F.col("s"), F.col("e"), F.col("u")), tx.path_key(F.col("u"))).collect()
    assert r[0][0] == f"{sha}:1.000000::A/B.wav" and r[0][1] == "a/b.wav" and r[1][0] is None
    assert values(spark, [" TH", "ja / en", "English", "th/en", "mixed", "jp", None], tx.language_name(F.col("t"))) == ["Thai", "Japanese", "English", "Thai", None, None, None]
    assert values(spark, ["a b/c", "///"], tx.safe_name(F.col("t"))) == ["a_b_c", "model"]


# numbers


def test_token_distance_equals_the_textbook():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (["".join(rng.choice("ab")) for _ in range(rng.randint(0, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        assert nu.token_distance(a, b) == row[-1]


def test_numbers(spark):
    assert values(spark, ["1.5", "inf", "NaN", "x", None], nu.to_number(F.col("t"))) == [1.5, None, None, None, None]
    v = spark.createDataFrame([([3.0, 4.0, float("nan")],), ([0.0, 0.0, 0.0],)], "v array<double>").select(nu.unit_vector(F.col("v"))).collect()
    assert v[0][0] == [0.6, 0.8, 0.0] and v[1][0] == [0.0, 0.0, 0.0]
    assert nu.mono_floats(nu.to_pcm16([0.5, float("nan"), 2.0]))[1:] == [0.0, pytest.approx(32767 / 32768)]
    assert len(nu.resample_values([0.0, 1.0] * 50, 100, 50)) == 50 and nu.resample_values(None, 1, 2) is None
    assert nu.fingerprint({"a": 1, "b": 2}) == nu.fingerprint({"b": 2, "a": 1}) and len(nu.fingerprint({})) == 16
    x = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(100.0,)], "x double").agg(nu.percentile(F.col("x"), 0.9), nu.nearest_rank("x", 0.95)).first()
    assert x[0] == 10.0 and x[1] == 100.0


def test_json(spark):
    assert values(spark, ['["a","b"]', "plain", '"s"', None, ""], nu.lenient_list(F.col("t"))) == [["a", "b"], ["plain"], ["s"], [], []]
    got = values(spark, ['```json\n{"transcript_text":"hi","language":"en"}\n```', "no json"], nu.response_fields(F.col("t")))
    assert (got[0].text, got[0].language) == ("hi", "en") and got[1].text == "no json"
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert df.select(nu.json_record("a", "b")).first()[0] == '{"a":1,"b":null}'
    one = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert nu.table_fingerprint(one, ["k"]) == nu.table_fingerprint(one.repartition(3), ["k"]) != nu.table_fingerprint(one, ["k"], {"s": 1})


# intervals


def brute_cover(rows):
    out = []
    for s, e in sorted(r for r in rows if r[1] > r[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block", [7, 50, 10_000])
def test_periods_and_gaps_in_any_blocks(spark, block):
    rng = random.Random(block)
    data = []
    for k in ("a", "b", None):
        for _ in range(120):
            s = rng.randint(-300, 700)
            data.append((k, s, s + rng.choice([-3, 0, 1, 2, 5, 9, 60, 300 if rng.random() < 0.1 else 4]), "x"))
    data += data[:20] + [("c", None, 5, "x"), ("c", 1, None, "x"), ("c", 5, 5, "x"), ("d", 0, 10, "x"), ("d", 10, 20, "x"), ("d", 21, 22, "x")]
    df = spark.createDataFrame(data, "k string, s long, e long, b string")
    got = {tuple(r) for r in coverage.merge_periods(df, ["k"], "s", "e", block=block, salts=3).collect()}
    want = set()
    for k in ("a", "b", None, "d"):
        per = brute_cover([(s, e) for kk, s, e, _ in data if kk == k and s is not None and e is not None])
        want |= {(k, "period", s, e) for s, e in per} | {(k, "gap", a[1], b[0]) for a, b in zip(per, per[1:])}
    assert got == want
    assert coverage.merge_periods(df.limit(0), ["k"], "s", "e").count() == 0


def test_p1_on_dirty_turns(spark, tmp_path):
    schema = "turn_id string, source_id string, speaker_id string, start_sec double, end_sec double, version int, arrived_at timestamp_ntz, kind string"
    rows = [("t1", "s", "a", 0.0, 1.0, 1, None, "x"), ("t1", "s", "a", 0.0, 2.0, 2, None, "x"), ("t1", "s", "a", 0.0, 2.0, 2, None, "x"), ("t2", "s", "a", 2.0, 3.0, None, None, "x"), ("t3", "s", None, 0.0, 9.0, 1, None, "x"), ("t4", "s", "a", 5.0, 5.0, 1, None, "x"), ("t5", "s", "a", 7.0, 8.0, 1, None, "x"), ("t5", "s", "a", None, 8.0, 3, None, "x")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/diarization_turns.parquet")
    assert {tuple(r) for r in coverage.p1_found(spark, str(tmp_path)).collect()} == {("s", "a", "period", 0, 3000), ("s", "a", "gap", 3000, 7000), ("s", "a", "period", 7000, 8000)}


def frame(spark, rows):
    return spark.createDataFrame([("s", float(a), float(b)) for a, b in rows], "k string, start double, end double")


def test_interval_algebra(spark):
    speech = frame(spark, [(0, 10), (9, 12), (20, 30), (5, 5), (40, 41)])
    assert spans_of(iv.merge(speech, ["k"]), "k") == [("s", 0, 12), ("s", 20, 30), ("s", 40, 41)]
    assert spans_of(iv.merge(speech, ["k"], 8), "k") == [("s", 0, 30), ("s", 40, 41)]
    assert spans_of(iv.subtract(speech, frame(spark, [(3, 4), (11, 21), (29, 99)]), ["k"]), "k") == [("s", 0, 3), ("s", 4, 11), ("s", 21, 29)]
    assert spans_of(iv.gaps(iv.merge(speech, ["k"]), ["k"], 9), "k") == [("s", 30, 40)]
    assert iv.union_length(speech, ["k"]).first().seconds == 23
    assert iv.intersection_length(speech, frame(spark, [(8, 25), (8, 9)]), ["k"]).first().seconds == 9
    assert spans_of(iv.concurrency(speech, ["k"], 0.5), "k") == [("s", 8.5, 10.5)]
    assert spans_of(iv.clip(speech, F.lit(9.0), F.lit(25.0)), "k") == [("s", 9, 10), ("s", 9, 12), ("s", 20, 25)]
    assert iv.risky_boundaries(frame(spark, [(0, 5), (5, 10), (10, 15)]), frame(spark, [(4, 6), (9.8, 20)]), ["k"]).collect()[0].point == 5.0
    assert spans_of(iv.truncate(speech, 10), "k") == [("s", 0, 10), ("s", 9, 10)]
    groups = iv.bridged_groups(frame(spark, [(0, 100), (1, 2), (50, 60)]), ["k"], 0.8).orderBy("start").collect()
    assert [r.group_no for r in groups] == [0, 0, 1]


def test_interval_arrays(spark):
    df = spark.createDataFrame([([(5.0, 6.0), (0.0, 2.0), (1.0, 3.0), (7.0, 7.0)], [(0.0, 1.0, "a"), (0.9, 1.4, "b"), (1.5, 1.9, "c")])], "s array<struct<start:double,end:double>>, w array<struct<start:double,end:double,text:string>>")
    r = df.select(iv.merge_array(F.col("s")).alias("m"), iv.words_inside(F.col("w"), F.lit(0.0), F.lit(1.2)).alias("i"), iv.straddling(F.col("w"), F.lit(1.2)).alias("x"), iv.clip_segment(F.col("w"), F.lit("t"), F.lit(1.2), F.lit(2.0)).alias("c")).first()
    assert [tuple(x) for x in r.m] == [(0, 3), (5, 6)] and [w.text for w in r.i] == ["a"] and [w.text for w in r.x] == ["b"]
    assert r.c.text == "bc" and r.c.words[0].start == 1.2


def test_islands_runs_and_slices(spark):
    blocks = spark.createDataFrame([("s", i / 10, (i + 1) / 10, 0.001 if 3 <= i < 6 else 1.0) for i in range(20)], "k string, start double, end double, rms double")
    assert spans_of(iv.low_energy_islands(blocks, ["k"], 0.1), "k") == [("s", pytest.approx(0.3), pytest.approx(0.6))]
    runs = iv.speaker_runs(spark.createDataFrame([("s", "a", 0.0, 1.0), ("s", "a", 1.5, 2.0), ("s", "b", 5.0, 6.0)], "k string, sp string, start double, end double"), "k", "sp").orderBy("start").collect()
    assert [(r.sp, r.start, r.end) for r in runs] == [("a", 0, 2), (None, 2, 5), ("b", 5, 6)]
    chunks = spark.createDataFrame([("s", 0.0, [1.0, 2.0]), ("s", 1.0, [3.0, 4.0])], "k string, start double, samples array<float>")
    assert iv.filled_slice(chunks, ["k"], 0.5, 2.0, 2).first().samples == [2.0, 3.0, 4.0]


# quality


def test_signals_and_policy(spark):
    df = spark.createDataFrame([("a", "", "1"), ("b", "hello", None), ("c", "hello", "0.1"), ("d", "x" * 200, "31"), ("e", "x", "30"), ("f", "ไทย", "1"), ("g", "fine", "2")], "key string, label string, seconds string")
    got = {r.key: list(r.reasons) for r in quality.signals(df, "label", "seconds", ["latin"]).collect()}
    assert got == {"a": ["empty_label"], "b": ["invalid_duration"], "c": ["too_short", "char_rate_high"], "d": ["too_long"], "e": ["char_rate_low"], "f": ["script_mismatch"], "g": []}
    d = spark.createDataFrame([(["empty_label"], None), (["empty_label"], "fix"), (["too_long"], None), ([], None)], "r array<string>, p string").select(quality.disposition(F.col("r"), F.col("p")))
    assert [r[0] for r in d.collect()] == ["drop", "correct", "review", "keep"]


def test_manifest_order_of_rules(spark):
    clips = spark.createDataFrame([("dup1", "a b c", 1.0, "h1"), ("dup2", "a b c", 1.0, "h1"), ("empty", "", 1.0, "h2"), ("gold", "a b c", 1.0, "h3"), ("fix", "a b c", 1.0, "h4"), ("bad", "a b c", 1.0, None)], "key string, label string, seconds double, content_sha string")
    gold = spark.createDataFrame([("h3",), ("h3",), (None,)], "content_sha string")
    proposals = spark.createDataFrame([(k, "better") for k in ("dup1", "empty", "gold", "fix", "bad")], "key string, proposal string")
    got = {r.key: (r.disposition, list(r.reasons)) for r in quality.candidate_manifest(clips, gold, proposals).collect()}
    assert got["fix"][0] == "correct" and got["empty"][0] == "correct" and got["gold"][0] == "drop"
    assert got["dup1"] == ("review", ["duplicate_content", "prediction_disagreement"]) and got["bad"][0] == "review"


def test_consensus_rules(spark):
    df = spark.createDataFrame([(1, "a", "Yes"), (1, "b", "yes "), (1, "c", "no"), (2, "a", "x"), (2, "a", "x"), (3, "a", " "), (4, "a", "p"), (4, "b", "q")], "k int, v string, t string")
    got = [(r.k, r.text_key, r.n, r.total) for r in quality.consensus(df, "k", "v", "t").collect()]
    assert got == [(1, "yes", 2, 3)]


def test_spelling(spark):
    check = {"english": quality.english_checker(quality.WordList({"hello": 5, "world": 3})), "thai": quality.dictionary_checker(quality.WordList(frozenset(["ภาษา", "ไทย"])), "thai")}
    df = spark.createDataFrame([("a", "hello wrold API ABCDEFGHI"), ("b", "ภาษาไทย"), ("c", None), ("d", "ภาษาไทบ x")], "key string, label string")
    units = quality.spelling(df, "key", "label", check)
    assert sorted((r.key, r.checked, r.suspicious, r.issues) for r in units.collect()) == [("a", 3, 2, ["ABCDEFGHI", "wrold"]), ("b", 2, 0, []), ("d", 2, 1, ["ไทบ"])]
    assert quality.spelling_rows(units, "key").filter("key = 'a'").first().review
    words = quality.WordList({"hello": 5, "help": 2})
    assert words.close("hlelo") == ["hello"] and words.close("zzzz") == [] and words.cut("helloxhelp") == ["hello", "x", "help"]


def test_guards(spark):
    with pytest.raises(Exception, match="record breaks"):
        quality.checked(spark.range(2), {"small": F.col("id") < 1}).collect()
    with pytest.raises(Exception, match="leaves its root"):
        values(spark, ["../x"], quality.safe_relative(F.col("t")))
    with pytest.raises(Exception, match="legacy"):
        spark.createDataFrame([(None,)], "f boolean").select(quality.eligible(F.col("f"))).collect()
    r = spark.createDataFrame([(None,), (False,), (True,)], "f boolean").select(quality.eligible(F.col("f"), "exclude", True)).collect()
    assert [x[0] for x in r] == [False, True, True]


# evaluation


def test_scores(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("", "x"), (None, None)], "r string, h string")
    got = evaluate.scores(df, "r", "h").collect()
    assert got[0].cer == 0.25 and got[1].cer is None and evaluate.scores(df, "r", "h", strict=False).collect()[1].cer == 1.0
    s = evaluate.summary(evaluate.scores(df, "r", "h")).first()
    assert s.n == 3 and s.mean_cer == 0.25 and s.micro_cer == 0.5


def test_boundary_f1_and_der(spark):
    seg, ref = frame(spark, [(0, 5), (5, 10.2), (10.2, 15)]), frame(spark, [(0, 5.1), (5.1, 10), (10, 12), (12, 15)])
    r = evaluate.boundary_f1(seg, ref, "k").first()
    assert (r.hits, r.precision, r.recall) == (2, 1.0, pytest.approx(2 / 3))
    a = spark.createDataFrame([("s", 0.0, 10.0, "x"), ("s", 10.0, 20.0, "y")], "k string, start double, end double, speaker string")
    b = spark.createDataFrame([("s", 0.0, 12.0, "1"), ("s", 12.0, 18.0, "2")], "k string, start double, end double, speaker string")
    d = evaluate.diarization_error(a, b, "k").first()
    assert (d.missed, d.false_alarm, d.confused, d.der) == (2, 0, 2, pytest.approx(0.2))
    with pytest.raises(Exception, match="drifted"):
        evaluate.drift_gate(spark.createDataFrame([(0.5,)], "m double"), "m", 10.0).collect()


def test_worst_and_changed(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (10, 0.5), (9, 0.1)], "i int, s double")
    assert [r.i for r in evaluate.worst(df, "s", "i", 3).collect()] == [10, 1, 9]
    other = spark.createDataFrame([(1, 0.5), (2, None), (10, 0.6)], "i int, s double")
    assert evaluate.changed_rows(df, other, "i", ["s"]).first().changed == 2


# mapping


def test_generation_map(spark):
    schema = "clip long, source_key string, start double, end double, sha string"
    old = spark.createDataFrame([(1, "s", 0.0, 5.0, "A"), (2, "s", 5.0, 9.0, "b"), (3, "s", 20.0, 80.0, "c"), (4, "s", 90.0, 95.0, "d"), (5, None, 0.0, 5.0, "a"), (6, "s", 7.0, 7.0, "e"), (7, "s", 29.9, 30.1, "f")], schema)
    new = spark.createDataFrame([(11, "s", 0.0, 5.0, "a"), (12, "s", 5.0, 9.0, "x"), (13, "s", 20.0, 40.0, "y"), (14, "s", 40.0, 80.0, "z"), (15, None, 0.0, 5.0, "a")], schema)
    got = {r.clip: (r.status, r.new_clip) for r in mapping.generation_map(old, new).collect()}
    again = "changed_boundary_needs_relabel"
    assert got == {1: ("unchanged", 11), 2: ("ambiguous", 12), 3: ("ambiguous", None), 4: (again, None), 5: (again, None), 6: (again, None), 7: (again, 13)}


def test_reviews(spark):
    df = spark.createDataFrame([("k", "2024-01-02", 1, "a", "x"), ("k", "2024-01-02", 2, "b", "y"), ("k", "2024-01-01", 3, "c", "z")], "key string, saved_at string, line long, action string, label string")
    assert mapping.current_reviews(df).first().action == "a"
    r = lambda rows: spark.createDataFrame(rows, "key string, action string, label string")
    ours, theirs, known = r([("a", "accept", "1"), ("b", "accept", "1")]), r([("a", "accept", "1"), ("b", "correct", "2"), ("c", "accept", "3"), ("d", "accept", "4")]), r([("a", "", ""), ("b", "", ""), ("c", "", "")])
    assert {x.key: x.state for x in mapping.import_diff(ours, theirs, known).collect()} == {"a": "unchanged", "b": "conflict", "c": "new", "d": "unmatched"}
    assert {x.key: x.label for x in mapping.import_apply(ours, theirs, known, "theirs").collect()} == {"a": "1", "b": "2", "c": "3"}
    assert {x.key: x.label for x in mapping.import_apply(ours, theirs, known, "ours").collect()} == {"a": "1", "b": "1", "c": "3"}


def test_best_overlap_ties(spark):
    left = spark.createDataFrame([("s", 1, 0.0, 10.0), ("s", 2, 50.0, 51.0), ("s", 3, 5.0, 5.0)], "k string, i long, start double, end double")
    turns = spark.createDataFrame([("s", "t2", "late", 0.5, 5.0, 10.0), ("s", "t1", "early", 0.5, 0.0, 5.0), ("s", "t3", "less", 0.9, 0.0, 4.0)], "k string, turn_id string, speaker string, confidence double, start double, end double")
    assert {r.i: r.speaker for r in mapping.best_overlap(left, turns, "k", "i", 3.0).collect()} == {1: "early", 2: "UNKNOWN", 3: "UNKNOWN"}


def test_neighbour_context_equals_a_walk_back(spark):
    """The nearest row within the gap is taken however long, and as many rows as the seconds allow."""
    rng, rows, at = random.Random(12), [], 0
    for i in range(300):  # milliseconds; stretches of very short rows, long rows, overlaps and pauses
        at += rng.choice([0, 100, 700, 1500, 1501, -50]) if i % 60 < 30 else 10
        d = rng.choice([400, 2000, 4000, 9000]) if i % 60 < 30 else rng.choice([100, 150])
        rows.append((rng.choice("ab"), at / 1000, (at + d) / 1000, f"w{i}"))
        at += d
    want = {}
    for k in "ab":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])
        for i, r in enumerate(own):
            texts, used, j = [], 0, i - 1
            while j >= 0 and own[j + 1][1] - own[j][2] <= 1.5:
                d = round((own[j][2] - own[j][1]) * 1000)
                if used + d > 4000 and texts:
                    break
                texts.insert(0, own[j][3])
                used, j = used + d, j - 1
                if used >= 4000:
                    break
            want[r[3]] = " ".join(texts)
    assert max(len(t.split()) for t in want.values()) > 8
    got = {r.t: r.context for r in mapping.neighbour_context(spark.createDataFrame(rows, "k string, start double, end double, t string"), "k", "t").collect()}
    assert got == want


def test_carried_context_of_many_short_rows(spark):
    rng = random.Random(3)
    rows = [(k, i, "".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 40])))) for k in "xy" for i in range(150)] + [("x", 150, "l" * 500), ("x", 151, "z"), ("y", 150, ""), ("y", 151, "z")]
    got = {(r.k, r.i): (r.previous_tail, r.context) for r in mapping.carried_context(spark.createDataFrame(rows, "k string, i int, t string"), "k", "i", "t", 3, 400).collect()}
    for k in "xy":
        before = []
        for _, i, t in (r for r in rows if r[0] == k and r[2]):
            assert got[k, i] == ((before[-1] if before else "")[-3:], " ".join(before)[-400:])
            before.append(t)
    short = spark.createDataFrame([("x", i, "ab") for i in range(200)], "k string, i int, t string")
    assert max(len(r.context) for r in mapping.carried_context(short, "k", "i", "t").collect()) == 199 * 3 - 1


def test_rolling_prompts_keep_600_characters(spark, sf):
    """The registered query against its SQL with the 600 characters of the reference and of SURVEY WN06."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW asr_segments AS SELECT * FROM '{sf}/asr_segments.parquet'")
    sql = entry.oracle_sql()["rolling_prompts"]
    want = con.sql(f"select asr_id, prompt from ({re.sub(r', [0-9]+[)] AS prompt', ', 600) AS prompt', sql)})").fetchall()
    got = [(r.asr_id, r.prompt) for r in entry.queries()["rolling_prompts"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and max(len(p) for _, p in got) > 120


def test_context_windows(spark):
    rows = spark.createDataFrame([("s", 0.0, 1.0, "one"), ("s", 1.2, 2.0, "two"), ("s", 5.0, 6.0, "three"), ("s", 6.1, 9.0, "four"), ("s", 9.5, 10.0, "five")], "k string, start double, end double, t string")
    got = [r.context for r in mapping.neighbour_context(rows, "k", "t", 1.5, 3.0).orderBy("start").collect()]
    assert got == ["", "one", "", "three", "four"]
    assert [r.prompt for r in mapping.rolling_prompt(rows, "k", "start", "t", 2, 6).orderBy("start").collect()] == ["", "one", "ne two", " three", "e four"]
    assert [r.group_no for r in mapping.merge_short(rows, "k").orderBy("start").collect()] == [0, 0, 1, 1, 1]
    assert [r.id for r in mapping.numbered_ids(rows, "seg_", ["k"], ["start"]).orderBy("start").collect()][:2] == ["seg_000000", "seg_000001"]


# planning


def test_window_plan_uses_grounded_boundaries():
    c = planner.PlanConfig()
    windows = planner.plan_source(c, [(0, 18), (18.6, 40)], [], [], [], None)
    assert [(w["start"], w["end"], w["method"]) for w in windows] == [(0, pytest.approx(18.3), "silero_vad_gap"), (pytest.approx(18.3), 40, "source_end")]
    fixed = planner.plan_source(c, [(0, 70)], [], [], [(17.9, 18.1)], None)
    assert [w["method"] for w in fixed] == ["continuous_speech_fallback", "continuous_speech_fallback", "pre_roll_target_pending_alignment"]
    assert fixed[1]["labeling_start"] == 24.0 and not fixed[1]["eligible"] and fixed[0]["eligible"]
    both = planner.plan_source(c, [(0, 40)], [], [(0, 17.8), (18.2, 40)], [(17.9, 18.1)], None)
    assert both[0]["method"] == "low_energy_gap+whisper_timestamp_gap" and both[0]["confidence"] == pytest.approx(0.934, abs=1e-3)
    assert planner.plan_source(c, [], [], [], [], None) == []
    with pytest.raises(ValueError):
        planner.PlanConfig(target=40)


def test_window_plan_properties(spark):
    rng = random.Random(8)
    rows = []
    for s in range(6):
        t = 0.0
        for _ in range(60):
            t += rng.random() * 2
            e = t + rng.random() * 15
            rows.append((f"s{s}", "speech", t, e))
            t = e
    out = planner.owned_windows(spark.createDataFrame(rows, "k string, kind string, start double, end double"), "k").collect()
    by = {}
    for w in sorted(out, key=lambda w: (w.k, w["index"])):
        assert w.end > w.start and w.end - w.start <= 30 + 1e-9 and w.labeling_start <= w.start
        assert w.start >= by.get(w.k, 0) - 1e-9
        by[w.k] = w.end


def test_fixed_windows_and_gate(spark):
    df = spark.createDataFrame([("s", 45.0), ("t", 10.0), ("u", 0.0)], "k string, duration double")
    assert [(r.k, r.start, r.end) for r in planner.fixed_windows(df, "k", 20, 12).orderBy("k", "start").collect()] == [("s", 0, 20), ("s", 12, 32), ("s", 24, 44), ("s", 36, 45), ("t", 0, 10)]
    g = planner.ownership_gate
    assert g("x", [], [], 0, False, True)["status"] == "not_required"
    assert g("hello world", ["hello", "world"], ["before"], 0, True, False)["status"] == "passed"
    assert g("hello", ["hello"], [], 1, True, False)["reason"] == "timestamp_straddles_ownership_boundary"
    assert g("context hello", ["hello"], ["some", "context"], 0, True, False)["reason"] == "label_contains_or_matches_preroll_context"
    assert g("zzz", ["hello"], [], 0, True, False)["reason"] == "owned_target_alignment_below_threshold"


# speakers


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5)]:
        cost = rng.integers(0, 9, (n, m)).astype(float)
        got = sum(cost[i, j] for i, j in optimal_assignment(cost))
        small, big = (cost, m) if n <= m else (cost.T, n)
        assert got == min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(big), len(small)))
    assert optimal_assignment(np.zeros((0, 3))) == [] and optimal_assignment(np.array([[np.inf]])) == []


def test_identities_stay_when_labels_flip(spark):
    rng = np.random.default_rng(0)
    people = {n: rng.normal(size=16) for n in "abc"}
    rows, truth = [], {}
    for chunk in range(8):
        present = ["a", "b"] + (["c"] if chunk >= 4 else [])
        labels = [f"L{i}" for i in rng.permutation(len(present))]
        for who, label in zip(present, labels):
            rows.append(("s", chunk, label, (people[who] + rng.normal(size=16) * 0.05).tolist(), 7.0, float(chunk)))
            truth[chunk, label] = who
    out = speakers.assign_in_order(spark.createDataFrame(rows, "k string, chunk long, label string, vector array<double>, seconds double, end double"), "k").collect()
    names = {}
    for r in out:
        names.setdefault(truth[r.chunk, r.label], set()).add(r.speaker)
    assert all(len(v) == 1 for v in names.values()) and len(set.union(*names.values())) == 3


def test_average_linkage_merges_nearest_first():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(12, 6))
    got = speakers.average_linkage(v)
    assert len(got) == 11 and [d for *_, d, _ in got] == sorted(d for *_, d, _ in got) and got[-1][3] == 12
    u = np.stack([speakers.unit(x) for x in v])
    parts = {i: [i] for i in range(12)}
    for new, (a, b, d, size) in enumerate(got, 12):
        assert d == pytest.approx(np.mean([1 - u[i] @ u[j] for i in parts[a] for j in parts[b]]))
        parts[new] = parts.pop(a) + parts.pop(b)
        assert len(parts[new]) == size


def test_identity_scenario_in_overlapping_chunks(spark):
    rows = [("s", i, label, who, vector, chunk * 12.0 + 1, chunk * 12.0 + 9) for i, (chunk, label, who, vector) in enumerate(speakers.identity_scenario())]
    df = spark.createDataFrame(rows, "k string, i int, label string, who string, vector array<double>, start double, end double")
    one = speakers.chunked_identities(df.withColumn("label", F.col("who")), "k", 20.0, 12.0).collect()
    assert {r.speaker for r in one} == {"SPEAKER_00", "SPEAKER_01", "SPEAKER_02"} and max(r.chunk for r in one) == 7
    assert len({(r.label, r.speaker) for r in one}) == 3


def test_windows_equal_the_plan_in_memory(spark):
    rng = random.Random(6)
    rows = []
    for s in range(4):
        for kind, n, span in (("speech", 40, 14), ("word", 300, 0.6), ("quiet", 40, 0.3), ("dirty", 8, 3)):
            rows += [(f"s{s}", kind, t, round(t + rng.random() * span + 0.01, 3)) for t in (round(rng.random() * 300, 3) for _ in range(n))]
    df = spark.createDataFrame(rows, "k string, kind string, start double, end double")
    near = lambda w: (round(w["start"], 4), round(w["end"], 4), round(w["labeling_start"], 4), w["method"], round(w["confidence"], 3))
    for config in (planner.PlanConfig(), planner.PlanConfig(exclude_overlap=True)):
        got = {}
        for r in planner.owned_windows(df, "k", config).collect():
            got.setdefault(r.k, []).append((r["index"], near(r)))
        for s in {r[0] for r in rows}:
            of = lambda kind: [(a, b) for k, n, a, b in rows if k == s and n == kind]
            want = planner.plan_source(config, of("speech"), of("dirty"), of("word"), of("quiet"), None)
            assert sorted(got[s]) == [(w["index"], near(w)) for w in want]
    base = planner.baseline_windows(df.filter("kind = 'speech'").select("k", "start", "end"), "k", "wall_clock").collect()
    assert base and all(0 < r.end - r.start <= 25 + 1e-6 for r in base)
    one = spark.createDataFrame([("s", 0.0, 20.0), ("s", 20.5, 50.0), ("s", 60.0, 61.0)], "k string, start double, end double")
    assert [(r["index"], r.start, r.end, r.speech) for r in planner.baseline_windows(one, "k").orderBy("index").collect()] == [(0, 0.0, 20.0, 20.0), (1, 20.5, 45.5, 25.0), (2, 45.5, 50.0, 4.5), (3, 60.0, 61.0, 1.0)]


def test_speaker_book_rules():
    book = speakers.SpeakerBook()
    e = np.eye(4)
    got = book.match(["x", "y", "z", "w"], [e[0], [0] * 4, e[1]], {"x": 7.0, "y": 1.0, "z": 0.0})
    assert [got[k]["decision"] for k in "xyzw"] == ["new", "invalid", "overlap_only", "invalid"]
    first = book.commit("e1", "UNASSIGNED_x", "x", e[0], 2.0, 0.0, 0.9, 1.0)
    assert first == "CANDIDATE_00" and book.commit("e1", "other", "x", e[0], 2.0, 0.0, 0.9, 1.0) == first
    assert book.commit("e2", first, "x", e[0], 2.0, 0.0, 0.9, 2.0) == "SPEAKER_00" and not book.candidates
    assert book.match(["q"], [e[0]], {"q": 1.0})["q"]["decision"] == "match"
    assert len(speakers.average_linkage(np.stack([e[0], e[0] + 0.1, e[1]]))) == 2 and speakers.average_linkage(e[:1]) == []


def test_nearest_and_centroids(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [0.0, 1.0]), (4, "b", None)], "i long, sp string, v array<double>")
    c = speakers.centroids(rows.withColumn("w", F.lit(1.0)), "sp", "v", "w").withColumnRenamed("sp", "speaker")
    for most in (10, 1):
        got = {r.i: r.speaker for r in speakers.nearest_profile(rows.filter("v is not null"), c, "i", "v", most=most).collect()}
        assert got == {1: "a", 2: "a", 3: "b"}


# selection


def test_source_split(spark):
    df = spark.createDataFrame([(i, f"s{i % 40}") for i in range(200)] + [(999, " ")], "i long, s string")
    out = selection.source_split(df, "s", 0.1, 5).collect()
    held = {r.s for r in out if r.held_out}
    assert len(held) == 4 and not held & {r.s for r in out if r.held_out is False}
    assert next(r for r in out if r.i == 999).held_out is None
    with pytest.raises(Exception, match="two or more"):
        selection.source_split(df.filter("s = 's1'"), "s", 0.1, 5).collect()
    assert selection.evaluation_split(["train", "test"]) == "test" and selection.evaluation_split(["train"]) is None


def test_math_is_finite():
    assert not math.isnan(nu.token_distance([], ["a"]))


def test_wave_helper(tmp_path, spark):
    from tidescribe.sources import files

    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.array([16384, 0, -16384, -16384], dtype="<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[-1]: (r.rate, r.samples) for r in files.wav_samples(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": (8000, [0.25, -0.5]), "b.wav": (None, None)}
    assert [r.path[-5:] for r in files.media_files(spark, str(tmp_path)).collect()] == ["a.wav", "b.wav"]
