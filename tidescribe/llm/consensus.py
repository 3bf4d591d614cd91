"""Consensus of annotators' labels by confidence-aware truth discovery.

Alternating minimisation of the weighted label distance: given weights, an item's truth is its
label of most support; given truths, an annotator's error rate gets a chi-squared upper bound
(few opinions: a wide one, so the long tail never dominates), and its log-odds are the weight.
Dependence: annotators who nearly always cite one evidence source that others cite too draw on
a common pool; their equal opinions on an item count as one together.
"""

from __future__ import annotations

import statistics

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescribe.llm import textops
from tidescribe.runtime import cut, written

#: One-sided level of the chi-squared bound, and its normal quantile.
LEVEL = 0.05
Z = statistics.NormalDist().inv_cdf(LEVEL)
#: Wrong labels an erring annotator is taken to choose from.
WRONG = 3.0
#: Share of its cited opinions from which an annotator counts as dependent on one shared source.
POOLED = 0.5
#: Weight of an annotator of whose errors nothing is known.
PRIOR = 0.3


def fold(col: Column) -> Column:
    """Folded text of a column; null gives ''."""
    return F.arrow_udf(lambda c: pa.array(textops.fold_batch(c), pa.string()), "string")(col)


def chi2_low(n: Column) -> Column:
    """Lower chi-squared quantile at LEVEL, n degrees of freedom (Wilson and Hilferty's cube)."""
    c = F.lit(2.0) / (n * 9)
    return n * F.pow(F.greatest(1 - c + F.lit(Z) * F.sqrt(c), F.lit(0.01)), 3)


def proposals(df: DataFrame) -> DataFrame:
    """``item, annotator, label, proposal, refs, confidence, at`` of every proposal with a text; texts are folded once and written.

    Exactly repeated rows count once; blank and null texts are no proposals, null items are
    dropped, a null annotator is one of its own; a null or impossible confidence is missing.
    """
    rows = df.select("proposal_id", F.col("item_id").alias("item"), F.coalesce("annotator_id", F.lit("")).alias("annotator"), fold(F.col("text")).alias("folded"), "evidence_refs", "confidence", "submitted_at")
    sure = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    rows = rows.filter("item is not null and folded <> ''").select("item", "annotator", F.xxhash64("folded").alias("label"), F.col("proposal_id").alias("proposal"), F.col("evidence_refs").alias("refs"), sure.alias("confidence"), F.col("submitted_at").alias("at"))
    return written(rows, "proposals")


def opinions(rows: DataFrame) -> DataFrame:
    """``item, annotator, label, refs, confidence``: each annotator's latest proposal on an item; equally late: the greater proposal id."""
    best = F.max(F.struct("at", "proposal", "label", "refs", "confidence")).alias("o")
    return rows.groupBy("item", "annotator").agg(best).select("item", "annotator", "o.label", "o.refs", "o.confidence")


def dependence(votes: DataFrame) -> DataFrame:
    """``annotator, pool``: the evidence source that an annotator draws on nearly always, with others.

    A reference names its source once the item's own id is cut from it (``view:17:pool`` of item
    17: ``view:pool``). Only sources that several annotators of one item have cited count, and an
    annotator depends on one if more than POOLED of its cited opinions name it. Counts only: no
    pairs of annotators are formed.
    """
    cited = votes.filter("size(refs) > 0").select("item", "annotator", F.explode(F.array_distinct("refs")).alias("ref")).filter("ref is not null")
    own = F.array_join(F.filter(F.split("ref", "[:/]"), lambda x: x != F.col("item").cast("string")), ":")
    cited = cited.withColumn("source", own).select("item", "annotator", "source").distinct()
    shared = cited.groupBy("item", "source").agg(F.count("*").alias("k")).filter("k > 1").select("source").distinct()
    size = cited.select("item", "annotator").distinct().groupBy("annotator").agg(F.count("*").alias("n"))
    count = cited.join(shared, "source", "left_semi").groupBy("annotator", "source").agg(F.count("*").alias("c"))
    return count.join(size, "annotator").filter((F.col("c") > POOLED * F.col("n")) & (F.col("n") >= 3)).groupBy("annotator").agg(F.max_by("source", "c").alias("pool"))


def weight_of(bound: Column) -> Column:
    """Weight of an annotator: the log-odds of the upper bound of its error (variance of 0-or-1 distances).

    The plain inverse of the bound also grows with worth, but overrates several poor annotators that agree.
    """
    u = F.least(F.greatest(bound, F.lit(0.001)), F.lit(0.99))
    return F.greatest(F.log(WRONG * (1 - u) / u), F.lit(0.01))


def discover(votes: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Truths ``item, label, support, total, voters, same`` and annotators ``annotator, weight, error, opinions, overconfidence``.

    Rounds go on until no truth changes, ``most`` at most. Of equal support the label of more voters, then the smaller
    hash wins. Only items of three or more opinions tell of an annotator's errors; who has none of them has no
    error, opinions 0 and the weight PRIOR that the truths are found with. ``overconfidence`` is the mean of an
    annotator's own stated confidence less the share of opinions that agree with the truths, null without either.
    An empty table gives empty results.
    """
    flags = dependence(votes)
    rows = votes.join(flags, "annotator", "left")
    pooled = rows.filter("pool is not null").groupBy("item", "label", "pool").agg(F.count("*").alias("together"))
    sizes = rows.groupBy("item").agg(F.count("*").alias("n"))
    rows = rows.join(pooled, ["item", "label", "pool"], "left").join(sizes, "item")
    rows = written(rows.select("item", "annotator", "label", "n", "confidence", F.coalesce(1 / F.col("together"), F.lit(1.0)).alias("share")), "votes")
    truth, weights = written(_truths(rows, None), "truths"), None
    for _ in range(most):
        judged = rows.filter("n >= 3").join(truth.select("item", F.col("label").alias("truth")), "item")
        wrong = (F.col("label") != F.col("truth")).cast("double")
        seen = judged.groupBy("annotator").agg(F.sum(wrong).alias("e"), F.count("*").alias("opinions"), F.avg("confidence").alias("told"))
        bound = (F.col("e") + 0.5) / chi2_low(F.col("opinions") + 1)
        weights = cut(seen.select("annotator", weight_of(bound).alias("weight"), (F.col("e") / F.col("opinions")).alias("error"), "opinions", (F.col("told") - 1 + F.col("e") / F.col("opinions")).alias("overconfidence")))
        before, truth = truth, written(_truths(rows, weights), "truths")
        moved = truth.join(before.select("item", F.col("label").alias("before")), "item").filter("label <> before")
        if moved.isEmpty():
            break
    everyone = rows.select("annotator").distinct().join(weights, "annotator", "left")
    return truth, everyone.select("annotator", F.coalesce("weight", F.lit(PRIOR)).alias("weight"), "error", F.coalesce("opinions", F.lit(0)).alias("opinions"), "overconfidence")


def _truths(rows: DataFrame, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        w, held = F.lit(1.0), rows
    else:
        w, held = F.coalesce("weight", F.lit(PRIOR)), rows.join(weights.select("annotator", "weight"), "annotator", "left")
    support = held.groupBy("item", "label").agg(F.round(F.sum(w * F.col("share")), 9).alias("s"), F.count("*").alias("c"))
    best = F.max(F.struct("s", "c", (-F.col("label")).alias("l"))).alias("b")
    out = support.groupBy("item").agg(best, F.sum("s").alias("total"), F.sum("c").alias("voters"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    return out.select("item", (-F.col("b.l")).alias("label"), F.col("b.s").alias("support"), "total", "voters", "same")


def _run(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = proposals(spark.read.parquet(f"{sf_dir}/proposed_labels.parquet"))
    return rows, *discover(opinions(rows))


def p7_found(spark, sf_dir: str) -> DataFrame:
    """The consensus label of every item, as the smallest proposal with that folded text."""
    rows, truth, _ = _run(spark, sf_dir)
    named = rows.groupBy("item", "label").agg(F.min("proposal").alias("proposal_id"))
    return named.join(truth.select("item", "label"), ["item", "label"]).select(F.col("item").alias("item_id"), "proposal_id")


def p7_items(spark, sf_dir: str) -> DataFrame:
    """Per item: voters, the share of weighted support of its consensus, the share of agreeing pairs."""
    _, truth, _ = _run(spark, sf_dir)
    pairs = F.col("voters") * (F.col("voters") - 1)
    return truth.select(F.col("item").alias("item_id"), "voters", (F.col("support") / F.col("total")).alias("support_share"), F.when(pairs > 0, F.col("same") / pairs).alias("pair_agreement"))


def p7_annotators(spark, sf_dir: str) -> DataFrame:
    """Per annotator: opinions on items of three or more, error rate against the consensus (null without any), weight, overconfidence."""
    _, _, weights = _run(spark, sf_dir)
    return weights.select(F.col("annotator").alias("annotator_id"), "opinions", F.col("error").alias("error_rate"), "weight", "overconfidence")
