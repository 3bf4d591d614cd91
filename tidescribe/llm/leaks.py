"""Held-out passages inside a corpus, by suffix arrays of the corpus' shards.

Each Arrow batch of documents is a shard: its folded texts get a suffix array, in which every
suffix of every test item is looked up by binary search; the ranges found give the places where
at least ``run`` characters stand verbatim, consecutive places on one diagonal the longest match.
Suffixes that cannot match (their first ``anchor`` characters, by hash, begin no test suffix) are
left out before sorting. Documents are whole within a shard, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescribe.llm import textops

#: Bytes of the keys of test suffixes that go to the executors at once; more are done block by block.
ITEM_BYTES = 64_000_000


def _keys(a: np.ndarray, at: np.ndarray, limit: np.ndarray, depth: int, width: int | None = None) -> np.ndarray:
    """Order-preserving fixed-width byte keys of the first ``depth`` characters of suffixes."""
    out = np.zeros((len(at), width or depth, 3), dtype=np.uint8)
    step = np.arange(depth)
    index = at[:, None] + step
    value = np.where(index < limit[:, None], a[np.minimum(index, len(a) - 1)] + 1, 0)
    out[:, :depth, 0], out[:, :depth, 1], out[:, :depth, 2] = value >> 16, (value >> 8) & 255, value & 255
    return np.ascontiguousarray(out).reshape(len(at), -1).view(f"S{3 * (width or depth)}").ravel()


class TestSuffixes:
    """All suffixes of at least ``run`` characters of the folded test items."""

    def __init__(self, ids: list[int], texts: list[str | None], run: int, anchor: int):
        a, rows = textops.fold_codes(pa.array(texts, type=pa.string()))
        self.ids, self.run, self.anchor = np.array(ids, dtype=np.int64), run, anchor
        self.size = np.diff(rows)
        count = np.maximum(self.size - run + 1, 0)
        self.item = np.repeat(np.arange(len(ids)), count)
        self.offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(rows[:-1], count) + self.offset
        end = at + run
        self.low = _keys(a, at, end, run) if len(at) else np.zeros(0, dtype=f"S{3 * run}")
        h = textops.window_hash(textops.prefix_hash(a), at, at + anchor)
        self.bits = max(16, int(len(h) * 16).bit_length())
        self.cell = h >> np.uint64(64 - self.bits)
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self.cell] = True

    def matches(self, a: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Per row of the shard and item: characters of the item covered, longest match, its place."""
        empty = {k: np.zeros(0, dtype=np.int64) for k in ("row", "item", "covered", "longest", "place")}
        h = textops.rolling_hash(textops.prefix_hash(a), self.anchor)
        cell = h >> np.uint64(64 - self.bits)
        at = np.flatnonzero(self.seen[cell]) if len(h) and len(self.low) else np.zeros(0, dtype=np.int64)
        row = np.searchsorted(rows, at, side="right") - 1
        keep = at + self.run <= rows[row + 1]
        at, row = at[keep], row[keep]
        if not len(at):
            return empty
        key = _keys(a, at, at + self.run, self.run)
        suffix_array = np.argsort(key, kind="stable")
        ordered = key[suffix_array]
        # Only test suffixes whose first characters stand in this shard are looked up: the work follows what may match.
        here = np.zeros(len(self.seen), dtype=bool)
        here[cell[at]] = True
        asked = np.flatnonzero(here[self.cell])
        left, right = np.searchsorted(ordered, self.low[asked], "left"), np.searchsorted(ordered, self.low[asked], "right")
        n = right - left
        q = np.repeat(asked, n)
        if not len(q):
            return empty
        p = suffix_array[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)]
        item, offset, doc = self.item[q], self.offset[q], row[p]
        place = at[p] - rows[doc]
        pair = doc * len(self.ids) + item
        order = np.lexsort((offset, pair))
        u, v = pair[order], offset[order]
        last = np.append(u[1:] != u[:-1], True)
        step = np.where(last, self.run, np.minimum(np.append(v[1:] - v[:-1], 0), self.run))
        heads = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        covered = np.add.reduceat(step, heads)
        order = np.lexsort((offset, place - offset, pair))
        u2, v2, d2 = pair[order], offset[order], (place - offset)[order]
        new = np.append(True, (u2[1:] != u2[:-1]) | (d2[1:] != d2[:-1]) | (v2[1:] != v2[:-1] + 1))
        at_run = np.flatnonzero(new)
        length = np.diff(np.append(at_run, len(new))) + self.run - 1
        best = np.lexsort((place[order][at_run], -length, u2[at_run]))
        best = best[np.append(True, u2[at_run][best][1:] != u2[at_run][best][:-1])]
        return {"row": u[heads] // len(self.ids), "item": u[heads] % len(self.ids), "covered": covered, "longest": length[best], "place": place[order][at_run][best]}


def find_leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 30, anchor: int = 16) -> DataFrame:
    """``key, item_key, covered, item_chars, longest, place`` of each pair with a run in common.

    Texts are folded (NFKC, case, only letters, digits, marks). ``covered`` counts the item's
    characters that lie in runs of ``run`` or more which stand unbroken in the document;
    ``longest`` is the longest verbatim match and ``place`` its start in the folded document.
    Null and empty texts, and items shorter than ``run``, match nothing; exactly repeated items
    count once; items may repeat one another. Test items are bounded held-out data: their
    keys are counted, and beyond ``ITEM_BYTES`` of them they are searched block by block.
    """
    spark = corpus.sparkSession
    held = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    total = held.agg(F.sum(F.greatest(F.length("t") - run + 1, F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-total * 3 * run // ITEM_BYTES))
    kind = corpus.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` bigint, covered bigint, item_chars bigint, longest bigint, place bigint"
    out = None
    for b in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(TestSuffixes([r.i for r in rows], [r.t for r in rows], run, anchor))

        def run_batches(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            test = shared.value
            for batch in batches:
                step = max(1, int(batch.num_rows * min(1.0, 4_000_000 / max(1, batch.column(1).nbytes))))
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    m = test.matches(*textops.fold_codes(part.column(1)))
                    ids = part.column(0).take(pa.array(m["row"]))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(test.ids[m["item"]]), pa.array(m["covered"]), pa.array(test.size[m["item"]]), pa.array(m["longest"]), pa.array(m["place"])],
                        names=[key, item_key, "covered", "item_chars", "longest", "place"],
                    )

        found = corpus.select(F.col(key), F.col(text).cast("string")).mapInArrow(run_batches, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(corpus: DataFrame, key: str, leaks: DataFrame) -> DataFrame:
    """The corpus without the affected documents; documents with a null key stay."""
    return corpus.join(leaks.select(key).distinct(), key, "left_anti")


def _leaks(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "eval_items"))
    return find_leaks(docs, "doc_id", "text", items, "item_id", "text").filter("covered * 2 >= item_chars")


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of an item in runs of 30 or more folded characters."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_clean(spark, sf_dir: str) -> DataFrame:
    """Ids and sources of the documents that remain once the affected ones are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return without_leaks(docs, "doc_id", _leaks(spark, sf_dir))


def p9_sql() -> tuple[str, str]:
    """SQL of `p9_found` and `p9_clean`: folded texts, every window of 30 characters of the items looked up in those of the documents."""
    from tidescribe.plans.text_queries import mapped, nfkc, unicode_tables

    u = unicode_tables()
    folded = lambda n, src, key: f"{nfkc(n + '1', src, key, 'text')}, {mapped(n + '2', n + '1', 'k', 't', 'cf')}, {n} AS (SELECT k, regexp_replace(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g') t FROM {n}2)"
    window = lambda n: f"SELECT k, i, substr(t, CAST(i AS BIGINT), 30) w FROM (SELECT k, t, unnest(range(1, CAST(length(t) AS BIGINT) - 28)) i FROM {n})"
    found = f"""WITH {u['nk']}, {u['cf']}, {folded('it', 'eval_items', 'item_id')}, {folded('dc', 'documents', 'doc_id')}, iw AS ({window('it')}), dw AS (SELECT DISTINCT k, w FROM ({window('dc')}) WHERE w IN (SELECT w FROM iw)),
m AS (SELECT DISTINCT dw.k d, iw.k it, iw.i FROM iw JOIN dw USING (w)), g AS (SELECT *, coalesce(least(lead(i) OVER (PARTITION BY d, it ORDER BY i) - i, 30), 30) c FROM m)
SELECT d AS doc_id, g.it AS item_id FROM g JOIN it ON it.k = g.it GROUP BY 1, 2, it.t HAVING sum(c) * 2 >= length(it.t)"""
    return found, f"WITH found_ AS ({found}) SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found_)"
