"""Consolidation of archived knowledge: similar pairs within a category, and a plan of what to keep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CATEGORY = "未分类"


def category_of(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(NO_CATEGORY))


#: Items of a category that are compared at a time.
BLOCK_ITEMS = 2_048


def _near_in_blocks(least: float):
    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, y = np.stack(left["e"].to_numpy()), np.stack(right["r_e"].to_numpy())
            same = left["i"].iloc[0] == left["j"].iloc[0]
            norm = lambda m: np.where((n := np.sqrt((m * m).sum(axis=1))) == 0, 1.0, n)
            similarity = np.round(x @ y.T / np.outer(norm(x), norm(y)), 6)
            p, q = np.nonzero(similarity >= least)
            if same:
                p, q = p[p != q], q[p != q]
            one, two = left.iloc[p].reset_index(drop=True), right.iloc[q].reset_index(drop=True)
            ahead = (one["confidence"] > two["r_confidence"]) | ((one["confidence"] == two["r_confidence"]) & (one["id"] < two["r_id"]))
            pick = lambda c: (one[c].where(ahead, two[f"r_{c}"]), two[f"r_{c}"].where(ahead, one[c]))
            (a, b), (conf_a, conf_b) = pick("id"), pick("confidence")
            found = pd.DataFrame({"category": one["category"], "a": a, "b": b, "conf_a": conf_a, "conf_b": conf_b, "similarity": similarity[p, q]})
            out.append(found[ahead] if same else found)  # within a block each pair is met twice
        return pd.concat(out) if out else pd.DataFrame({"category": [], "a": [], "b": [], "conf_a": [], "conf_b": [], "similarity": []})

    return near


def similar_pairs(items: DataFrame, least: float = 0.7) -> DataFrame:
    """a, b, similarity of items(id, category, confidence, embedding): pairs of a category from `least` on.

    a comes before b: higher confidence, then the smaller id. Every pair of a category is compared, which is what the plan asks
    for: a category is dealt into blocks by its size, and each pair of blocks is one matrix product in one task. Items without
    a vector, and vectors of different lengths, make no pairs; a length of zero counts as one.
    """
    rows = items.where(F.col("embedding").isNotNull() & F.col("id").isNotNull()).select(category_of(F.col("category")).alias("category"), F.size("embedding").alias("width"), "id", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.col("embedding").cast("array<double>").alias("e"))
    sizes = rows.groupBy(F.col("category").alias("c"), F.col("width").alias("w")).agg(F.ceil(F.count("*") / BLOCK_ITEMS).cast("int").alias("blocks"))
    dealt = rows.join(sizes, (F.col("category") == F.col("c")) & (F.col("width") == F.col("w"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    keys = ["category", "width", "i", "j"]
    left = dealt.select("category", "width", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "id", "confidence", "e")
    right = dealt.select("category", "width", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), "id", "confidence", "e").toDF(*[f"r_{k}" for k in keys], "r_id", "r_confidence", "r_e")
    paired = left.groupBy(*keys).cogroup(right.groupBy(*[f"r_{k}" for k in keys]))
    return paired.applyInPandas(_near_in_blocks(least), "category string, a long, b long, conf_a double, conf_b double, similarity double")


def merge_plan(pairs: DataFrame) -> DataFrame:
    """id, action, confidence: b of every pair goes and a gains 0.1, up to 1; of an id that gains and goes, it goes."""
    keep = pairs.select(F.col("a").alias("id"), F.lit("update").alias("action"), F.least(F.lit(1.0), F.round(F.col("conf_a") + 0.1, 4)).alias("confidence"))
    gone = pairs.select(F.col("b").alias("id"), F.lit("delete").alias("action"), F.lit(None).cast("double").alias("confidence"))
    return keep.union(gone).groupBy("id").agg(F.min("action").alias("action"), F.max("confidence").alias("gained")).select("id", "action", F.when(F.col("action") == "update", F.col("gained")).alias("confidence"))


def next_batch(log: DataFrame, column: str = "batch") -> DataFrame:
    return log.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_batch"))
