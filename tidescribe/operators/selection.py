"""Choice of training rows (SRC15, FLT04, SET04, SET05, SNK12, HSH04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidescribe.operators.quality import eligible


def split_name(file_name: Column) -> Column:
    """SRC15: first folder of the file name, else 'train'."""
    path = F.translate(file_name, "\\", "/")
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("train")


def training_rows(meta: DataFrame, legacy: str = "exclude", research: bool = False) -> DataFrame:
    """SRC15: eligible rows with a file name and a text, and their split."""
    ok = F.coalesce(F.col("file_name"), F.lit("")) != ""
    rows = meta.filter(eligible(F.col("training_eligible"), legacy, research) & ok & (F.coalesce(F.trim("text"), F.lit("")) != ""))
    return rows.withColumn("split", split_name(F.col("file_name")))


def source_split(df: DataFrame, source: str, share: float, seed: int) -> DataFrame:
    """SET04: ``held_out`` by source: max(1, min(n - 1, round(n share))) sources in a seeded order.

    The order is that of sha2(seed, source): the same on every engine and cluster. Fewer than two
    sources raise an error; rows with a blank source are excluded (null). Sources are ranked by
    ranges of their hash, so no task sorts them all.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    names = df.select(F.col(source).alias("_s")).filter("trim(_s) <> ''").distinct().withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}\x1f"), "_s"), 256))
    names = names.withColumn("_b", F.substring("_h", 1, 2))
    sizes = names.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_before": before, "_all": F.sum("_n").over(Window.partitionBy(F.lit(0)))})  # at most 256 rows
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_s"))
    take = F.greatest(F.lit(1), F.least(F.col("_all") - 1, F.round(F.col("_all") * share)))
    names = names.join(sizes, "_b").withColumn("held_out", F.when(F.col("_all") < 2, F.raise_error("two or more sources are needed").cast("boolean")).otherwise(rank <= take))
    return df.join(names.select("_s", "held_out"), F.col(source) == F.col("_s"), "left").drop("_s")


def evaluation_split(names: list[str]) -> str | None:
    """SET05: the split to evaluate on, if there is one; else a held-out sample is to be drawn."""
    return next((n for n in ("validation", "test", "eval") if n in names), None)


def selection_report(df: DataFrame) -> DataFrame:
    """SNK12: rows and sources per split and state of eligibility."""
    state = F.when(F.col("training_eligible").isNull(), "legacy").when(F.col("training_eligible"), "included").otherwise("excluded")
    return df.groupBy(split_name(F.col("file_name")).alias("split"), state.alias("state")).agg(F.count("*").alias("rows"), F.count_distinct("source_id").alias("sources"))
