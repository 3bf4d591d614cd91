"""Languages of texts and of their stretches: sparse multinomial logistic regression.

Features are hashed character n-grams of words (of pieces, in scripts written without spaces),
weighted by TF-IDF with document frequencies of the whole table. Training is online:
follow-the-regularised-leader with elastic-net penalties on short spans of a bounded sample of
labelled chunks (SAMPLE per language, least hashes first); the fit is repeated on the sample
as the first fit reads it, since labels may be wrong. A temperature fitted on held-out spans
calibrates the probabilities. A chunk's units are then labelled by the best path with a fixed
cost for a change of language, and stretches too short to be more than a foreign word fall to
their neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidescribe.llm import textops

LANGUAGES = ["th", "en", "ja", "zh", "de", "es", "id"]
#: Spellings of the languages in labels — fixed values.
SPELLINGS = {
    "th": ["th", "tha", "thai", "ไทย", "ภาษาไทย"],
    "en": ["en", "eng", "english", "อังกฤษ", "英語"],
    "ja": ["ja", "jp", "jpn", "japanese", "日本語", "ญี่ปุ่น"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "漢語", "中国語", "จีน"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "id": ["id", "ind", "in", "indonesian", "bahasa indonesia", "bahasa"],
}
#: Labelled chunks per language that the classifier is fitted on, at most.
SAMPLE = 900
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 0.3, 1.0, 0.02, 0.01, 4, 128
#: Cost of a change of language, and the most a word may weigh against a language (nats).
SWITCH, FLOOR = 7.0, 3.5
#: Letters that weigh as one word in scripts without spaces, and letters of a piece of them.
LETTERS_A_WORD, PIECE = 5, 10
ANNOTATION = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|（[^（）]*）|【[^【】]*】|〔[^〔〕]*〕|\{[^{}]*\}|<[^<>]*>|\*[^*\s][^*]*\*|♪[^♪]*♪|♪+")
THAI = "ก-ฺเ-๎"
CJK = "々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
UNIT = re.compile(rf"[{THAI}]+|[{CJK}]+|[^\W\d_{THAI}{CJK}]+(?:['’\-][^\W\d_{THAI}{CJK}]+)*")
DENSE = re.compile(rf"[{THAI}{CJK}]")


def units(text: str) -> list[str]:
    """Words of a text without annotations and numbers; runs of scripts without spaces in pieces."""
    out = []
    for m in UNIT.finditer(ANNOTATION.sub(" ", text)):
        w = m.group().casefold()
        if DENSE.match(w) and len(w) > PIECE:
            n = -(-len(w) // PIECE)
            out += [w[len(w) * i // n : len(w) * (i + 1) // n] for i in range(n)]
        else:
            out.append(w)
    return out


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of padded words."""
    a = textops.codes("".join(f"_{w}_" for w in words))
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    limit = np.repeat(end, size)
    prefix = textops.prefix_hash(a)
    at, bucket = [], []
    for n in ORDERS:
        h = textops.rolling_hash(prefix, n)
        ok = np.flatnonzero(np.arange(len(h)) + n <= limit[: len(h)])
        if n == 1:
            ok = ok[a[ok] != ord("_")]
        at.append(owner[ok])
        bucket.append((h[ok] >> np.uint64(64 - 17)).astype(np.int64))
    return np.concatenate(at), np.concatenate(bucket)


def tfidf(owner: np.ndarray, bucket: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the L2-normalised vectors of n rows."""
    key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
    row, col = key // BUCKETS, key % BUCKETS
    value = (1 + np.log(count)) * idf[col]
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    return row, col, (value / norm[row]).astype(np.float32)


class Classifier:
    """FTRL-proximal multinomial logistic regression on hashed sparse rows."""

    def __init__(self, idf: np.ndarray):
        self.idf, self.temperature = idf, 1.0
        self.z, self.n = (np.zeros((BUCKETS, len(LANGUAGES)), dtype=np.float32) for _ in range(2))
        self.weights = np.zeros_like(self.z)

    def fit(self, spans: list[list[str]], labels: np.ndarray, seed: int = 7) -> "Classifier":
        """Online passes in a seeded order; a fifth is held out for the temperature."""
        words = [w for s in spans for w in s]
        of = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
        owner, bucket = features(words)
        row, col, value = tfidf(of[owner], bucket, len(spans), self.idf)
        start = np.searchsorted(row, np.arange(len(spans) + 1))
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(spans))
        held, order = order[: len(spans) // 5], order[len(spans) // 5 :]
        for _ in range(EPOCHS):
            rng.shuffle(order)
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                at = np.concatenate([np.arange(start[j], start[j + 1]) for j in part])
                of_row = np.repeat(np.arange(len(part)), start[part + 1] - start[part])
                self._step(of_row, col[at], value[at], labels[part])
        self.weights = self._solve(np.arange(BUCKETS))
        self.z = self.n = None
        if len(held):
            at = np.concatenate([np.arange(start[j], start[j + 1]) for j in held])
            logits = self._logits(np.repeat(np.arange(len(held)), start[held + 1] - start[held]), col[at], value[at], len(held))
            grid = np.exp(np.linspace(np.log(0.2), np.log(5), 41))
            loss = [-self._soft(logits / t)[np.arange(len(held)), labels[held]].mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _solve(self, cols: np.ndarray) -> np.ndarray:
        z = self.z[cols]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[cols])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0, w).astype(np.float32)

    def _step(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, label: np.ndarray) -> None:
        cols, local = np.unique(col, return_inverse=True)
        w = self._solve(cols)
        # Rows are sorted: their logits are sums of stretches; gradients are summed per feature, one language at a time.
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        logits = np.zeros((len(label), len(LANGUAGES)))
        logits[row[head]] = np.add.reduceat(w[local] * value[:, None], head, axis=0)
        miss = np.exp(self._soft(logits))
        miss[np.arange(len(label)), label] -= 1
        part = miss[row] * value[:, None]
        g = np.column_stack([np.bincount(local, part[:, k], len(cols)) for k in range(len(LANGUAGES))])
        n = self.n[cols]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[cols] += (g - sigma * w).astype(np.float32)
        self.n[cols] = n + g * g

    @staticmethod
    def _soft(x: np.ndarray) -> np.ndarray:
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    def _logits(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Sums per row; ``row`` is sorted."""
        out = np.zeros((n, len(LANGUAGES)))
        for i in range(0, len(row), 1_000_000):
            r = row[i : i + 1_000_000]
            x = self.weights[col[i : i + 1_000_000]] * value[i : i + 1_000_000, None]
            head = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            out[r[head]] += np.add.reduceat(x, head, axis=0)
        return out

    def word_scores(self, distinct: list[str]) -> np.ndarray:
        """Calibrated log-probabilities of words."""
        row, col, value = tfidf(*features(distinct), len(distinct), self.idf)
        return self._soft(self._logits(row, col, value, len(distinct)) / self.temperature)

    def stretches(self, texts: list[str | None]) -> list[list[tuple[int, float, int]]]:
        """Of every text its stretches: language number, confidence, words.

        Distinct words are scored once. A text whose words all lean to one language is that language; the best
        paths of the others are found together, step by step over their padded words.
        """
        split = [units(t) if t else [] for t in texts]
        size = np.array([len(u) for u in split])
        number: dict[str, int] = {}
        which = np.array([number.setdefault(w, len(number)) for u in split for w in u], dtype=np.int64)
        if not len(which):
            return [[] for _ in texts]
        distinct = list(number)
        score = self.word_scores(distinct)
        letters, dense = np.array([len(w) for w in distinct]), np.array([bool(DENSE.match(w)) for w in distinct])
        weight = np.where(dense, np.maximum(1.0, letters / LETTERS_A_WORD), np.minimum(1.0, 0.4 + letters / 8))
        gain = (np.maximum(score - score.max(axis=1, keepdims=True), -FLOOR) * weight[:, None])[which]
        sums = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(np.exp(score)[which], axis=0)])
        letters, dense = letters[which], dense[which]
        start = np.concatenate([[0], np.cumsum(size)])
        lean = gain.argmax(axis=1)
        held = np.flatnonzero(size)
        path = np.repeat(lean[start[held]], size[held])
        mixed = held[np.bitwise_or.reduceat(lean != path, start[held])]
        for part in _parts(mixed[np.argsort(-size[mixed], kind="stable")], size):
            _best_paths(gain, start, size, part, path)
        owner = np.repeat(np.arange(len(texts)), size)
        edge = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])))
        ends, of = np.append(edge[1:], len(path)), owner[edge]
        first = np.searchsorted(of, np.arange(len(texts) + 1))
        out = []
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            runs = [[int(path[a]), a, b] for a, b in zip(edge[i:j].tolist(), ends[i:j].tolist())]
            runs = _without_short(runs, letters, dense) if len(runs) > 1 else runs
            out.append([(lang, float((sums[b, lang] - sums[a, lang]) / (b - a)), b - a) for lang, a, b in runs])
        return out


def _parts(texts: np.ndarray, size: np.ndarray, cells: int = 300_000) -> list[np.ndarray]:
    """Texts by descending size in parts whose padded words stay within ``cells`` (a longer text is a part of its own)."""
    out, i = [], 0
    while i < len(texts):
        n = max(1, cells // int(size[texts[i]]))
        out.append(texts[i : i + n])
        i += n
    return out


def _best_paths(gain: np.ndarray, start: np.ndarray, size: np.ndarray, texts: np.ndarray, path: np.ndarray) -> None:
    """Writes the best language of every word of the texts (of descending size) into ``path``: a change costs SWITCH."""
    k = gain.shape[1]
    n = size[texts]
    best, back = gain[start[texts]].copy(), np.zeros((int(n[0]), len(texts), k), dtype=np.int8)
    same = np.arange(k)
    for i in range(1, int(n[0])):
        m = int(np.searchsorted(-n, -i, side="left"))  # the texts that have a word i
        top = best[:m].argmax(axis=1)
        most = best[np.arange(m), top] - SWITCH
        change = most[:, None] > best[:m]
        back[i, :m] = np.where(change, top[:, None], same)
        best[:m] = np.where(change, most[:, None], best[:m]) + gain[start[texts[:m]] + i]
    at = best.argmax(axis=1)
    for i in range(int(n[0]) - 1, -1, -1):
        m = int(np.searchsorted(-n, -i, side="left"))
        path[start[texts[:m]] + i] = at[:m]
        at[:m] = back[i, np.arange(m), at[:m]]


def _without_short(runs: list[list[int]], letters: np.ndarray, dense: np.ndarray) -> list[list[int]]:
    """The shortest run that is no more than a foreign word or name falls to its longer neighbour, again and again."""
    while len(runs) > 1:
        size = [int(letters[s:e].sum()) if e - s >= 3 or dense[s:e].any() else 0 for _, s, e in runs]
        k = size.index(min(size))
        if size[k] >= 8:
            break
        near = [j for j in (k - 1, k + 1) if 0 <= j < len(runs)]
        runs[k][0] = runs[max(near, key=lambda j: runs[j][2] - runs[j][1])][0]
        merged = [runs[0]]
        for run in runs[1:]:
            if run[0] == merged[-1][0]:
                merged[-1][2] = run[2]
            else:
                merged.append(run)
        runs = merged
    return runs


def parse_label(label: str | None) -> str | None:
    """The languages a label names, sorted and joined by '+'; null for placeholders and unknown names."""
    if label is None:
        return None
    known = {s: k for k, all_ in SPELLINGS.items() for s in all_}
    out = set()
    for part in re.split(r"[+,;/&|、]|\band\b", label.casefold()):
        name = part.strip()
        code = known.get(name) or known.get(re.split(r"[-_]", name)[0].strip())
        if code is None:
            return None
        out.add(code)
    return "+".join(sorted(out))


def label_set(col: Column) -> Column:
    """`parse_label` of a column."""
    return F.arrow_udf(lambda c: pa.array([parse_label(v) for v in c.to_pylist()], pa.string()), "string")(col)


def frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequencies of all buckets over every text of the table (one row a bucket comes back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            split = [units(t) if t else [] for t in batch.column(0).to_pylist()]
            words = [w for u in split for w in u]
            seen += sum(1 for u in split if u)
            if words:
                of = np.repeat(np.arange(len(split)), [len(u) for u in split])
                owner, bucket = features(words)
                total += np.bincount(np.unique(of[owner] * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], seen))], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total, count = int(rows.loc[rows.bucket == -1, "n"].sum()), np.zeros(BUCKETS)
    rows = rows[rows.bucket >= 0]
    count[rows.bucket.to_numpy()] = rows.n.to_numpy()
    return np.log((1 + total) / (1 + count)) + 1


def spans_of(texts: list[str], labels: list[int], rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Short runs of words of the texts (1 to 6 words each), with their labels."""
    spans, out = [], []
    for text, label in zip(texts, labels):
        u = units(text)
        i = 0
        while i < len(u):
            n = int(rng.integers(1, 7))
            spans.append(u[i : i + n])
            out.append(label)
            i += n
    return spans, np.array(out, dtype=np.int64)


def train(chunks: DataFrame, text: str, label: str, sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` chunks of each single-language label; labels may be wrong or free in spelling."""
    idf = frequencies(chunks.select(F.col(text)))
    held = chunks.select(F.col(text).alias("t"), label_set(F.col(label)).alias("l")).filter(F.col("l").isin(LANGUAGES) & (F.length(F.trim("t")) > 0))
    # The least hashes of every language in one scan: each partition keeps its own least, and the ranks are taken of those.
    held = held.withColumn("h", F.xxhash64("t", "l"))
    best = held.withColumn("p", F.spark_partition_id()).withColumn("r", F.row_number().over(Window.partitionBy("l", "p").orderBy("h", "t"))).filter(F.col("r") <= sample)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).filter(F.col("r") <= sample)
    rows = best.orderBy("l", "r").select("t", "l").collect()
    rows = [r for lang in LANGUAGES for r in rows if r.l == lang]
    texts, labels = [r.t for r in rows], [LANGUAGES.index(r.l) for r in rows]
    model = Classifier(idf)
    for again in range(3):
        if not texts:
            break
        model = Classifier(idf).fit(*spans_of(texts, labels, np.random.default_rng(11)))
        if again == 2:
            break
        read = model.stretches(texts)  # the sample as the fit reads it: mixed chunks go, wrong labels are put right
        kept = [(t, s[0][0]) for t, s in zip(texts, read) if len(s) == 1]
        texts, labels = [t for t, _ in kept], [s for _, s in kept]
    return model


def identify(df: DataFrame, key: str, text: str, label: str, model: Classifier) -> DataFrame:
    """``key, label_set, seg_no, language, confidence, words`` of every stretch of every text.

    Exactly repeated rows count once; texts without letters (null, blank, numbers, annotations
    only) have no stretch. ``confidence`` is the mean calibrated probability of the stretch's words.
    The model has a fixed size (BUCKETS by languages), whatever the table's.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = shared.value.stretches(batch.column(1).to_pylist())
            row = np.repeat(np.arange(len(read)), [len(s) for s in read])
            flat = [s for one in read for s in one]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    batch.column(2).take(pa.array(row)),
                    pa.array([i for one in read for i in range(len(one))], pa.int64()),
                    pa.array([LANGUAGES[s[0]] for s in flat], pa.string()),
                    pa.array([s[1] for s in flat], pa.float64()),
                    pa.array([s[2] for s in flat], pa.int64()),
                ],
                names=[key, "label_set", "seg_no", "language", "confidence", "words"],
            )

    rows = df.select(key, F.col(text).alias("_t"), F.col(label).alias("_l")).distinct().select(key, "_t", label_set(F.col("_l")).alias("_l"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, label_set string, seg_no bigint, language string, confidence double, words bigint")


def _stretches(spark, sf_dir: str) -> DataFrame:
    chunks = spark.read.parquet(f"{sf_dir}/labeled_chunks.parquet").select("chunk_id", "transcript_text", "language")
    return identify(chunks, "chunk_id", "transcript_text", "language", train(chunks.distinct(), "transcript_text", "language"))


def p3_segments(spark, sf_dir: str) -> DataFrame:
    """Every chunk's stretches with language and confidence, and the languages its label names."""
    return _stretches(spark, sf_dir)


def p3_found(spark, sf_dir: str) -> DataFrame:
    """The stretches of the chunks whose label is missing, a placeholder or not the set of their languages."""
    chunk = _stretches(spark, sf_dir).groupBy("chunk_id", "label_set").agg(F.sort_array(F.collect_list(F.struct("seg_no", "language"))).alias("s"))
    named = F.concat_ws("+", F.array_sort(F.array_distinct(F.col("s.language"))))
    chunk = chunk.filter(F.col("label_set").isNull() | (F.col("label_set") != named))
    return chunk.select("chunk_id", F.inline("s"))
