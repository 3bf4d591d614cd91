"""Splits that keep related records together, by random-mate contraction of the relation graph.

Each round every vertex flips a coin (a hash of its name and the round); a tail that has head
neighbours collapses into the least of them; edges are relabelled and those within one vertex
vanish. Pairs of every kind lose at least a quarter of their vertices a round on average, so the
edges shrink geometrically until none is left. The contractions form a forest whose depth is the
number of rounds; labels are unwound by pointer doubling.
"""

from __future__ import annotations

import re
import unicodedata
import urllib.parse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidescribe.runtime import scratch_path


def recording_name(value: str | None) -> str | None:
    """File name apart from folder, extension, case, percent escapes, separators, Unicode form, outer blanks.

    Null for null and blank values; a name of separators only is kept as it is written.
    """
    if value is None or not value.strip():
        return None
    text = unicodedata.normalize("NFKC", urllib.parse.unquote(value)).casefold().strip()
    name = re.split(r"[/\\]", text.rstrip("/\\"))[-1].strip()
    name = re.sub(r"\.(?=[a-z0-9]*[a-z])[a-z0-9]{1,5}$", "", name)
    bare = "".join(c for c in name if unicodedata.category(c)[0] in "LMN")
    return bare or value


def recording_key(col: Column) -> Column:
    """`recording_name` of a column."""
    return F.arrow_udf(lambda c: pa.array([recording_name(v) for v in c.to_pylist()], pa.string()), "string")(col)


class _Steps:
    """Small tables of the rounds, in the shared folder."""

    def __init__(self, spark):
        self.spark, self.base, self.n = spark, scratch_path(spark, "contract"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``vertex, root`` of every vertex of ``edges`` (u, v), names as strings; loops are ignored.

    Null ends are ignored; an empty table gives an empty result; repeated edges count once. The
    root is a member of the component. ``rounds`` is a guard: reaching it raises an error.
    """
    steps = _Steps(edges.sparkSession)
    live = edges.filter("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    live = steps.keep(live)
    moves = None
    for r in range(rounds):
        if live.isEmpty():
            break
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(r)), F.lit(2))  # noqa: E731, B023
        mate = live.withColumns({"cu": coin("u"), "cv": coin("v")}).filter("cu <> cv")
        mate = mate.select(F.when(F.col("cu") == 0, F.col("u")).otherwise(F.col("v")).alias("vertex"), F.when(F.col("cu") == 0, F.col("v")).otherwise(F.col("u")).alias("to"))
        mate = steps.keep(mate.groupBy("vertex").agg(F.min("to").alias("to")))
        moves = mate if moves is None else moves.unionByName(mate)
        a, b = mate.toDF("u", "mu"), mate.toDF("v", "mv")
        live = live.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("mu", "u").alias("u"), F.coalesce("mv", "v").alias("v")).filter("u <> v")
        live = steps.keep(live.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError(f"edges are left after {rounds} rounds")
    if moves is None:
        return live.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    label = moves
    for _ in range(max(1, (r - 1).bit_length())):  # depth r forest: log2(r) doublings
        label = steps.keep(label.alias("a").join(label.alias("b"), F.col("a.to") == F.col("b.vertex"), "left").select("a.vertex", F.coalesce("b.to", "a.to").alias("to")))
    tops = label.select(F.col("to").alias("vertex"), F.col("to")).distinct()
    return label.unionByName(tops).select("vertex", F.col("to").alias("root"))


def unit_of(df: DataFrame, file: str, source: str, own: Column) -> DataFrame:
    """``df`` with ``unit``: the root of each row's file name or source, or its own name if it has neither.

    Null and blank names and sources are none. A column ``unit`` of ``df`` is replaced, others stay.
    """
    names = df.select(file).distinct().withColumn("_f", F.concat(F.lit("f:"), recording_key(F.col(file)))).filter("_f is not null")
    held = df.join(names, file, "left").withColumn("_s", F.when(F.trim(source) != "", F.concat(F.lit("s:"), F.col(source))))
    root = components(held.select(F.col("_f").alias("u"), F.col("_s").alias("v")).distinct())
    held = held.withColumn("_v", F.coalesce("_f", "_s", F.concat(F.lit("r:"), own)))
    return held.join(root.toDF("_v", "_root"), "_v", "left").withColumn("unit", F.coalesce("_root", "_v")).drop("_f", "_s", "_v", "_root")


def assign_splits(units: DataFrame, configs: DataFrame, buckets: int = 256) -> DataFrame:
    """``config_id, unit, weight, split`` by cumulative weight in a seeded random order of the units.

    Shares that are null, NaN, not above 0 or together 1 or more are unusable and count as 0
    (of an unusable pair, both). A unit heavier than half the smaller positive share goes to train. The
    running sums are taken within hash ranges, offset by the ranges' totals, so no task holds all.
    """
    ok = lambda c: F.when((F.col(c) > 0) & (F.col(c) < 1) & ~F.isnan(c), F.col(c)).otherwise(0.0)
    conf = configs.select("config_id", ok("validation_size").alias("val"), ok("test_size").alias("test"), F.coalesce("seed", F.lit(0)).alias("seed"))
    conf = conf.withColumns({c: F.when(F.col("val") + F.col("test") < 1, F.col(c)).otherwise(0.0) for c in ("val", "test")})
    total = units.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
    conf = conf.join(F.broadcast(total))  # one row
    least = F.least(F.when(F.col("val") > 0, F.col("val")), F.when(F.col("test") > 0, F.col("test")))
    rows = units.join(F.broadcast(conf))  # the configurations are a handful of rows
    rows = rows.withColumn("h", F.xxhash64("unit", "seed")).withColumn("giant", F.coalesce(F.col("weight") > F.col("total") * least / 2, F.lit(False)))
    rows = rows.withColumn("b", F.pmod(F.shiftrightunsigned("h", 40), F.lit(buckets))).withColumn("w", F.when(F.col("giant"), 0).otherwise(F.col("weight")))
    sums = rows.groupBy("config_id", "b").agg(F.sum("w").alias("bw"))
    before = F.coalesce(F.sum("bw").over(Window.partitionBy("config_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("config_id", "b", before.alias("before"))
    inner = F.sum("w").over(Window.partitionBy("config_id", "b").orderBy("h", "unit").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", inner).join(sums, ["config_id", "b"])
    middle = F.col("before") + F.col("run") - F.col("w") / 2
    split = F.when(F.col("giant"), "train").when(middle < F.col("test") * F.col("total"), "test").when(middle < (F.col("test") + F.col("val")) * F.col("total"), "validation").otherwise("train")
    return rows.select("config_id", "unit", "weight", split.alias("split"))


def _clips(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/clips_metadata.parquet").select("clip_id", "source_file", "source_id").distinct()


def p2_found(spark, sf_dir: str, salts: int = 4) -> DataFrame:
    """Pairs of different non-blank source files, as written, whose clips must stay together."""
    clips = _clips(spark, sf_dir).select("source_file", "source_id").distinct()
    files = unit_of(clips, "source_file", "source_id", F.lit("")).filter("trim(source_file) <> ''").select("source_file", "unit").distinct()
    a = files.select(F.col("source_file").alias("source_file_a"), "unit", F.pmod(F.xxhash64("source_file"), F.lit(salts)).alias("z"))
    b = files.select(F.col("source_file").alias("source_file_b"), "unit", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])).alias("z"))
    return a.join(b, ["unit", "z"]).filter("source_file_a < source_file_b").select("source_file_a", "source_file_b")


def p2_splits(spark, sf_dir: str) -> DataFrame:
    """Of every configuration: the split of each clip, all clips of one recording or session alike."""
    clips = unit_of(_clips(spark, sf_dir), "source_file", "source_id", F.col("clip_id").cast("string"))
    path = scratch_path(spark, "units")
    clips.select("clip_id", "unit").write.parquet(path)
    clips = spark.read.parquet(path)
    units = clips.groupBy("unit").agg(F.countDistinct("clip_id").alias("weight"))
    configs = spark.read.parquet(f"{sf_dir}/training_configs.parquet")
    out = assign_splits(units, configs).join(clips.distinct(), "unit")
    return out.select("config_id", "clip_id", "unit", "split")


def p2_sql() -> str:
    """SQL of `p2_found`: names of recordings by the same rule, and everything reachable over names and source ids."""
    from tidescribe.plans.text_queries import mapped, nfkc, unicode_tables

    u = unicode_tables()
    return f"""WITH RECURSIVE {u['nk']}, {u['cf']}, r AS (SELECT DISTINCT source_file f, source_id s FROM clips_metadata WHERE trim(coalesce(source_file, '')) <> '' OR trim(coalesce(source_id, '')) <> ''),
d AS (SELECT DISTINCT f, url_decode(f) u FROM r WHERE regexp_matches(f, '[^\\s]')), {nfkc('n1', 'd', 'f', 'u')}, {mapped('n2', 'n1', 'k', 't', 'cf')},
n3 AS (SELECT k, trim(list_last(string_split(replace(rtrim(trim(t), '/' || chr(92)), chr(92), '/'), '/'))) b FROM n2), n4 AS (SELECT k, CASE WHEN regexp_matches(regexp_extract(b, '[.][a-z0-9]{{1,5}}$'), '[a-z]') THEN regexp_replace(b, '[.][a-z0-9]{{1,5}}$', '') ELSE b END b FROM n3),
nm AS (SELECT k f, coalesce(nullif(regexp_replace(b, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g'), ''), k) n FROM n4), e AS (SELECT DISTINCT 'f' || n a, 's' || s b FROM r JOIN nm USING (f) WHERE trim(s) <> ''),
ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(v, w) AS (SELECT DISTINCT 'f' || n, 'f' || n FROM nm UNION SELECT c.v, ee.b FROM c JOIN ee ON c.w = ee.a)
SELECT DISTINCT x.f AS source_file_a, y.f AS source_file_b FROM c JOIN nm x ON c.v = 'f' || x.n JOIN nm y ON c.w = 'f' || y.n WHERE encode(x.f) < encode(y.f)"""
